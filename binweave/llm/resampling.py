"""Importance resampling of documents towards the word distribution of a target corpus.

Features are runs of words, hashed into buckets by CRC-32.  Words follow Zipf's law, so a head of
frequent words and pairs is broadcast with its CRC already worked out, and only features outside
it are run through CRC byte by byte.  Both ways give the same bucket, so the totals of the buckets
are exact whatever the head holds.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binweave.llm.registry import query, table
from binweave.llm.sharding import balanced_shards
from binweave.llm.words import Words, row_chunks, split, windows
from binweave.scratch import cut

BUCKETS = 10_000
LONGEST_RUN = 1  # words in the longest feature of the registered query
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
HEAD = 1 << 16  # most frequent features whose CRC is broadcast
HEAD_SLOTS = 1 << 18  # places of the broadcast table; a feature whose place is taken is of the tail
TASK_HEAD = 1 << 17  # candidates for the head that one task holds
SHORT = 48  # bytes up to which CRCs are made side by side for many words

_COUNTED = "width int, hash long, crc long, times long"
_SPACE = np.frombuffer(b" ", np.uint8)


def _crc_steps() -> np.ndarray:
    """What CRC-32 adds for each value of the low byte of its register."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, np.uint32(0xEDB88320) ^ (steps >> 1), steps >> 1)
    return steps


_STEPS = _crc_steps()


def crc_of_spans(data: np.ndarray, low: np.ndarray, high: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of each byte span, carried on from the CRC ``before`` of what precedes it."""
    state = np.zeros(len(low), np.uint32) if before is None else before.astype(np.uint32)
    state = ~state
    length = high - low
    order = np.argsort(-np.minimum(length, SHORT + 1), kind="stable")
    short = order[int((length > SHORT).sum()) :]
    alive = np.searchsorted(-length[short], -np.arange(SHORT), side="left")
    for step in range(SHORT):
        at = short[: alive[step]]
        if not len(at):
            break
        s = state[at]
        state[at] = _STEPS[(s ^ data[low[at] + step]) & 255] ^ (s >> np.uint32(8))
    state = ~state
    for i in order[: len(order) - len(short)]:
        state[i] = zlib.crc32(data[low[i] : high[i]], 0 if before is None else int(before[i]))
    return state


def _lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 0x41) & (data <= 0x5A), data + np.uint8(32), data)


@dataclass
class Head:
    """CRCs of frequent features by hash: one open place per slot, for each length of run."""

    keys: dict[int, np.ndarray]
    crcs: dict[int, np.ndarray]

    @classmethod
    def of(cls, width: np.ndarray, hashes: np.ndarray, crcs: np.ndarray, slots: int = HEAD_SLOTS) -> Head:
        """From features in order of falling frequency."""
        keys, values = {}, {}
        for w in np.unique(width).tolist():
            mine = np.flatnonzero(width == w)[::-1]  # the most frequent is put down last
            keys[w], values[w] = np.zeros(slots, np.uint64), np.zeros(slots, np.uint32)
            at = hashes[mine] % np.uint64(slots)
            keys[w][at], values[w][at] = hashes[mine], crcs[mine]
        return cls(keys, values)

    def find(self, width: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each feature is of the head, and its CRC if so."""
        if width not in self.keys:
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.uint32)
        at = hashes % np.uint64(len(self.keys[width]))
        return (self.keys[width][at] == hashes) & (hashes != 0), self.crcs[width][at]


def _features(words: Words, longest: int, head: Head) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of run its hashes, their CRCs and the number of runs before each row."""
    data = _lower(words.data)
    crc = np.zeros(0, np.uint32)
    for width in range(1, longest + 1):
        runs = windows(words, width)
        known, found = head.find(width, runs.hashes)
        tail = np.flatnonzero(~known)
        last = runs.at[tail] + width - 1  # number of a tail run's last word
        if width == 1:
            before = None
        else:
            # A run goes on from the CRC of the run without its last word, over one space.
            shorter = crc[np.searchsorted(at, runs.at[tail])]
            none = np.zeros(len(tail), np.int64)
            before = crc_of_spans(_SPACE, none, none + 1, shorter)
        found[tail] = crc_of_spans(data, words.starts[last], words.ends[last], before)
        crc, at = found, runs.at
        yield width, runs.hashes, crc, runs.first


def _count_frequent(longest: int):
    """The most frequent runs of a task, with their CRC; rare ones give way when there are too many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = Head({}, {})
        held = {w: (np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64)) for w in range(1, longest + 1)}
        for batch in batches:
            column = batch.column(0)
            for low, high in row_chunks(column):
                words = split(column.slice(low, high - low), lower=True, plain=True)
                for width, hashes, crcs, _ in _features(words, longest, nothing):
                    own, first, times = np.unique(hashes, return_index=True, return_counts=True)
                    keys = np.concatenate([held[width][0], own])
                    both, at = np.unique(keys, return_inverse=True)
                    total = np.zeros(len(both), np.int64)
                    np.add.at(total, at, np.concatenate([held[width][2], times]))
                    crc = np.zeros(len(both), np.uint32)
                    crc[at] = np.concatenate([held[width][1], crcs[first]])
                    kept = np.argsort(-total, kind="stable")[:TASK_HEAD]
                    held[width] = both[kept], crc[kept], total[kept]
        for width, (hashes, crcs, times) in held.items():
            often = times > 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(int(often.sum()), width, np.int32)), pa.array(hashes[often].view(np.int64)),
                 pa.array(crcs[often].astype(np.int64)), pa.array(times[often])],
                names=["width", "hash", "crc", "times"],
            )

    return run


def frequent_features(docs: DataFrame, longest: int = LONGEST_RUN, head: int = HEAD) -> Head:
    """CRCs of the ``head`` most frequent runs, as far as tasks have seen them often.

    Which features are in it decides only how much work is saved.  At most ``head`` rows of 28
    bytes reach the driver and ``longest`` tables of fixed size are broadcast.
    """
    counted = docs.select("text").mapInArrow(_count_frequent(longest), _COUNTED)
    most = counted.groupBy("width", "hash").agg(F.min("crc").alias("crc"), F.max("crc").alias("other"), F.sum("times").alias("times"))
    # Two features of one hash would show by their CRCs; neither is then of the head.
    top = most.filter("crc = other").orderBy(F.desc("times"), "width", "hash").limit(head).toArrow()
    return Head.of(top["width"].to_numpy(), top["hash"].to_numpy().view(np.uint64), top["crc"].to_numpy().astype(np.uint32))


def bucket_totals(texts: DataFrame, head: Broadcast, longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket: sums per task, then over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            column = batch.column(0)
            for low, high in row_chunks(column):
                words = split(column.slice(low, high - low), lower=True, plain=True)
                for _, _, crcs, _ in _features(words, longest, head.value):
                    total += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "times"])

    counted = texts.select("text").mapInArrow(run, "bucket long, times long")
    rows = counted.groupBy("bucket").agg(F.sum("times").alias("times")).toArrow()  # at most ``buckets`` rows
    totals = np.zeros(buckets, np.int64)
    totals[rows["bucket"].to_numpy()] = rows["times"].to_numpy()
    return totals


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of target over source share of each bucket, smoothed by one, floored."""
    buckets = len(source)
    s_all, t_all = float(source.sum() + buckets), float(target.sum() + buckets)
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)],
        np.int64,
    )


def with_weight(docs: DataFrame, gain: np.ndarray, head: Broadcast, longest: int = LONGEST_RUN) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row; the weight is the floored mean of gains."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            sums, number, n_words = (np.zeros(len(column), np.int64) for _ in range(3))
            for low, high in row_chunks(column):
                words = split(column.slice(low, high - low), lower=True, plain=True)
                n_words[low:high] = words.counts
                for _, _, crcs, first in _features(words, longest, head.value):
                    upto = np.concatenate([[0], np.cumsum(shared.value[crcs % np.uint32(len(shared.value))])])
                    sums[low:high] += upto[first[1:]] - upto[first[:-1]]
                    number[low:high] += np.diff(first)
            weight = np.where(number > 0, sums // np.maximum(number, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words), pa.array(number), pa.array(weight)],
                names=["doc_id", "n_words", "n_features", "weight"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variate made from the id alone, floored; NULL for a NULL id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
    longest: int = LONGEST_RUN, buckets: int = BUCKETS, seed: int = SEED, head: int = HEAD,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``; drawn rows have a rank.

    Draws ``percent`` of the rows with at least ``least_words`` words without replacement, each
    in proportion to the exponential of its weight: the weight plus Gumbel noise is the score,
    and the greatest scores win, ties by smaller id.  Features are all runs of 1 to
    ``longest`` words (A-Z lower-cased, letters, digits and bytes above 127), repeats counted.

    A NULL or empty text has no features and weight 0.  A row with a NULL id has no score and is
    never drawn, nor counted among those drawn from, but its features count.  Rows that repeat
    an id share their noise and are drawn each for itself; equal rows are interchangeable.  An
    empty table gives none, an empty target equal chances to equally frequent words.  Long texts
    are read whole; other columns are ignored.  ``doc_id`` is a whole number.  Frequent features
    are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_features(docs, longest, head))  # HEAD_SLOTS places per length of run
    source, wanted = (bucket_totals(x, frequent, longest, buckets) for x in (docs, target))
    weighed = with_weight(docs, gains(source, wanted), frequent, longest)
    scored = cut(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weighed")
    eligible = F.coalesce((F.col("n_words") >= least_words) & F.col("score").isNotNull(), F.lit(False))
    take = scored.filter(eligible).count() * percent // 100
    # Rank is the place in one order over all rows, from prefix sums over range partitions.
    slim = scored.filter(eligible).select("doc_id", "n_features", "weight", "score", (-F.col("score")).alias("falling"), F.lit(1).alias("one"))
    placed = balanced_shards(slim, "falling", "one", 1, "doc_id").withColumn("rank", F.col("slot") + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    drawn = placed.select(*columns, F.when(F.col("rank") <= take, F.col("rank")).alias("rank"))
    return drawn.unionByName(scored.filter(~eligible).select(*columns, F.lit(None).cast("bigint").alias("rank")))


_WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP13_SQL = f"""
WITH powers AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), range(8)),
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS p
), d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents
), f AS MATERIALIZED (
  SELECT r, unnest(w) AS word FROM d
), g AS MATERIALIZED (
  SELECT unnest({_WORDS_SQL}) AS word FROM benchmark
), v AS (
  SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM f UNION SELECT word FROM g)
), b AS (
  SELECT word, list_transform(range(len(x) // 2), lambda i: (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16
    + instr('0123456789ABCDEF', x[2 * i + 2]) - 1) AS bytes FROM v
), c AS MATERIALIZED (
  SELECT word, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes),
           lambda a, b: xor(a >> 8, p[1 + (xor(a, b) & 255)])), 4294967295) AS BIGINT) % {BUCKETS} AS bucket
  FROM b, powers
), s AS MATERIALIZED (
  SELECT bucket, count(*) AS s FROM f JOIN c USING (word) GROUP BY 1
), t AS MATERIALIZED (
  SELECT bucket, count(*) AS t FROM g JOIN c USING (word) GROUP BY 1
), gain AS MATERIALIZED (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1e0) * ((SELECT count(*) FROM f) + {BUCKETS})
           / ((coalesce(s, 0) + 1e0) * ((SELECT count(*) FROM g) + {BUCKETS})))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (bucket)
), m AS (
  SELECT r, count(*) AS n, sum(gain) AS total FROM f JOIN c USING (word) JOIN gain USING (bucket) GROUP BY r
), w AS (
  SELECT d.r, doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(floor(total / n), 0) AS BIGINT) AS weight,
         CAST('0x' || substr(sha256('{SEED}:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h
  FROM d LEFT JOIN m USING (r)
), z AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5e0) / 4294967296))) AS BIGINT) AS score FROM w
), k AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
  FROM z WHERE n_features >= {LEAST_WORDS} AND score IS NOT NULL
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= ({PERCENT} * n) // 100 THEN rank END AS rank
FROM z LEFT JOIN k USING (r)
"""


@query("op13_resampling", OP13_SQL)
def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed towards the benchmark's words, with a tenth of them drawn."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
