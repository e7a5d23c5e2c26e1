"""Language model in a log-frequency Bloom filter.

Counts of words and of pairs of adjacent tokens are quantised to levels of half a power of two.
An n-gram of level q is put into a Bloom filter once for each level up to q; its level is read
back by probing level after level until one is missing.

The filter grows with the corpus, so it can't be broadcast: it lies in segments, one per bucket of
n-grams, each sized by its own entries.  Every chunk of text sends the distinct n-grams it holds to
their buckets, with how often the texts to learn from hold them.  A bucket adds those up, builds its
segment, reads the levels back from it, and returns them to the chunks.  So n-grams travel once, as five
or eight bytes each, and levels once as a byte.  The most frequent n-grams (``HEAD`` of each kind) are sent
once per task instead, and their levels are broadcast.

Tokens are words (A-Z in lower case) and one end per text; a text starts from a begin mark that
is only ever a context.  With the lower end L and the upper end U of the counts of a level,

    p(w | h) = (1 - b(h)) * (L(w) + 1) / Z  +  b(h) * max(L(h w) - D, 0) / U(h),   b(h) = BETA * U(h) / (U(h) + RARE)

where Z makes the words' part, with one share for all unknown words, sum to 1.  The pairs of a context
occur no more often than the context, so the second part sums to b(h) at most and p to 1 at most,
whatever the levels; only the filter's false positives can add to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binweave.llm.packed import bucket_count, bucket_of, chunk_group
from binweave.llm.registry import query, table
from binweave.llm.words import mix, row_chunks, split
from binweave.scratch import cut

BITS_PER_ENTRY = 8
PROBES = 4
CHUNK_BYTES = 2_000_000  # text whose n-grams are sent together; a longer text stands alone, whole
HEAD = 1 << 18  # most frequent words, and as many pairs, whose levels are broadcast
SAMPLE_ROWS = 20_000  # rows by which the head is chosen; it spares work and changes no result
BETA, RARE, DISCOUNT = 0.6, 4.0, 0.5
MOST_LEVELS = 127

_END, _BEGIN = np.uint64(0x27D4EB2F165667C5), np.uint64(0x85EBCA77C2B2AE63)
_PAIR_BITS = 40  # of a pair's hash, beside its bucket
_PAIR_SALT = np.uint64(0xA0761D6478BD642F)
_SENT = "bucket int, chunk long, words binary, word_times binary, pairs binary, pair_times binary"
_READ = (
    "bucket int, chunk long, word_levels binary, word_counts binary, pair_levels binary, "
    "words binary, pairs binary, n long, v long, z double"
)
_MET = "bucket int, chunk long, part int, word_levels binary, word_counts binary, pair_levels binary, data binary"


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with an end after each row, the context of each, and the row offsets."""
    words = split(column, lower=True)
    every = np.insert(words.hashes, words.first[1:], _END)
    first = words.first + np.arange(len(words.first))
    before = np.empty_like(every)
    before[1:] = every[:-1]
    before[first[:-1]] = _BEGIN
    return every, before, first


def pair_keys(before: np.ndarray, token: np.ndarray, buckets: int) -> np.ndarray:
    """Pairs by their bucket and ``_PAIR_BITS`` of their hash below it, so that keys are in the order of buckets."""
    hashes = mix(before * np.uint64(0x9E3779B97F4A7C15) + token)
    return (bucket_of(hashes, buckets).astype(np.uint64) << np.uint64(_PAIR_BITS)) | (hashes & np.uint64((1 << _PAIR_BITS) - 1))


def levels(counts: np.ndarray) -> np.ndarray:
    return np.floor(2 * np.log2(np.maximum(counts, 1)) + 1e-9).astype(np.int64)


def lower_end(level: np.ndarray) -> np.ndarray:
    """The least whole count of each level, 0 for level -1."""
    level = np.asarray(level)
    return np.where(level >= 0, np.ceil(2 ** (level / 2) - 1e-9), 0.0)


def upper_end(level: np.ndarray) -> np.ndarray:
    """The greatest whole count of each level, 0 for level -1."""
    level = np.asarray(level)
    return np.where(level >= 0, np.maximum(np.ceil(2 ** ((level + 1) / 2) - 1e-9) - 1, lower_end(level)), 0.0)


# --- the filter --------------------------------------------------------------------


def _bit(keys: np.ndarray, level: int, probe: int, span: int) -> np.ndarray:
    """Bit number of one probe of one level within a segment of ``span`` bits."""
    state = mix(keys + np.uint64((level * PROBES + probe + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64)))
    return (state & np.uint64(span - 1)).astype(np.int64)


def segment_of(keys: np.ndarray, level: np.ndarray, bits_per_entry: int = BITS_PER_ENTRY) -> np.ndarray:
    """A segment of the filter that holds every level of each key up to its own, as bytes."""
    entries = int((level + 1).sum())
    span = 1 << max(10, (entries * bits_per_entry - 1).bit_length())
    part = np.zeros(span, bool)
    for q in range(int(level.max(initial=-1)) + 1):
        some = keys[level >= q]
        for probe in range(PROBES):
            part[_bit(some, q, probe, span)] = True
    return np.packbits(part, bitorder="little")


def levels_in(part: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Level of each key by repeated probes, -1 if it is not in the segment."""
    found, open_, span = np.full(len(keys), -1), np.arange(len(keys)), 8 * len(part)
    for level in range(MOST_LEVELS + 1):
        for probe in range(PROBES):
            at = _bit(keys[open_], level, probe, span)
            open_ = open_[(part[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
        found[open_] = level
        if not len(open_):
            break
    return found


# --- from texts to buckets -------------------------------------------------------------


@dataclass
class Head:
    """Sorted keys of the most frequent words and pairs, at most ``HEAD`` of each."""

    words: np.ndarray
    pairs: np.ndarray


def _in(keys: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is among the sorted ones, and its place there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys, at


@dataclass
class _Chunk:
    """Distinct words and pairs of a chunk, in the order of their buckets, and the tokens that are they."""

    first: np.ndarray
    words: np.ndarray
    word: np.ndarray  # of each token
    pairs: np.ndarray
    pair: np.ndarray

    @classmethod
    def of(cls, column: pa.Array, buckets: int) -> _Chunk:
        every, before, first = tokens(column)
        words, word = np.unique(every, return_inverse=True)
        pairs, pair = np.unique(pair_keys(before, every, buckets), return_inverse=True)
        return cls(first, words, word, pairs, pair)


def _low(pairs: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(pairs).view(np.uint8).reshape(-1, 8)[:, : _PAIR_BITS // 8]


def _high(data: bytes, bucket: int) -> np.ndarray:
    low = np.frombuffer(data, np.uint8).reshape(-1, _PAIR_BITS // 8)
    keys = np.zeros((len(low), 8), np.uint8)
    keys[:, : _PAIR_BITS // 8] = low
    return keys.view(np.uint64).reshape(-1) | (np.uint64(bucket) << np.uint64(_PAIR_BITS))


def _rows(chunk: int, buckets: int, words: np.ndarray, word_times: np.ndarray, pairs: np.ndarray, pair_times: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket that has any of the n-grams, which are sorted."""
    edges = np.arange(buckets + 1)
    of_word = np.searchsorted(bucket_of(words, buckets), edges)
    of_pair = np.searchsorted(pairs >> np.uint64(_PAIR_BITS), edges)
    some = np.flatnonzero((np.diff(of_word) > 0) | (np.diff(of_pair) > 0))
    cut_up = lambda values, bounds: pa.array([values[bounds[k] : bounds[k + 1]].tobytes() for k in some], pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(some, pa.int32()), pa.array(np.full(len(some), chunk), pa.int64()), cut_up(words, of_word),
         cut_up(word_times.astype(np.uint32), of_word), cut_up(_low(pairs), of_pair), cut_up(pair_times.astype(np.uint32), of_pair)],
        names=["bucket", "chunk", "words", "word_times", "pairs", "pair_times"],
    )


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for low, high in row_chunks(batch.column("text"), CHUNK_BYTES):
        yield batch.slice(low, high - low)


def _first_chunk() -> int:
    return TaskContext.get().partitionId() << 24


def _send(head, buckets: int, mark: str):
    """The n-grams of every chunk by bucket, and once per task those of the head (chunk -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: Head = head.value
        of_head = [np.zeros(len(x), np.int64) for x in (most.words, most.pairs)]
        chunk = _first_chunk()
        for batch in batches:
            for part in _chunks(batch):
                seen = _Chunk.of(part.column("text"), buckets)
                learn = np.repeat(part.column(mark).to_numpy(zero_copy_only=False), np.diff(seen.first))
                sent = []
                for keys, each, frequent, total in ((seen.words, seen.word, most.words, of_head[0]), (seen.pairs, seen.pair, most.pairs, of_head[1])):
                    times = np.bincount(each, weights=learn, minlength=len(keys)).astype(np.int64)
                    known, at = _in(keys, frequent)
                    np.add.at(total, at[known], times[known])
                    sent += [keys[~known], times[~known]]
                yield _rows(chunk, buckets, *sent)
                chunk += 1
        some = [np.flatnonzero(x) for x in of_head]
        yield _rows(-1, buckets, most.words[some[0]], of_head[0][some[0]], most.pairs[some[1]], of_head[1][some[1]])

    return run


def _frequent(buckets: int):
    """Counts of the words (kind 0) and pairs (kind 1) of a sample that come more than once in a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch):
                seen = _Chunk.of(part.column("text"), buckets)
                for kind, keys, each in ((0, seen.words, seen.word), (1, seen.pairs, seen.pair)):
                    times = np.bincount(each, minlength=len(keys))
                    often = times > 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(int(often.sum()), kind, np.int32)), pa.array(keys[often].view(np.int64)), pa.array(times[often].astype(np.int64))],
                        names=["kind", "key", "times"],
                    )

    return run


def frequent_ngrams(docs: DataFrame, buckets: int, rows: int, head: int = HEAD) -> Head:
    """The most frequent n-grams of about ``SAMPLE_ROWS`` rows (``rows`` is the number of all)."""
    sample = docs.select("text").sample(min(1.0, SAMPLE_ROWS / max(rows, 1)), 7)
    counted = sample.mapInArrow(_frequent(buckets), "kind int, key long, times long").groupBy("kind", "key").agg(F.sum("times").alias("times"))
    most = [counted.filter(F.col("kind") == k).orderBy(F.desc("times"), "key").limit(head).toArrow()["key"].to_numpy() for k in (0, 1)]
    return Head(*[np.sort(x.view(np.uint64)) for x in most])


# --- buckets ---------------------------------------------------------------------------


def _binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def _read_back(groups: int, bits_per_entry: int):
    """A bucket's segment of the filter, and from it the levels that its chunks ask for.

    Returns a row per chunk, already named by the group that the chunk is scored in, and one row
    (chunk -1) of sums over the bucket and of the levels of the head's n-grams.
    """

    def run(rows: pa.Table) -> pa.Table:
        bucket, chunks = rows["bucket"][0].as_py(), rows["chunk"].to_numpy()
        sizes = {c: [len(x) // w for x in rows[c].to_pylist()] for c, w in (("words", 8), ("pairs", _PAIR_BITS // 8))}
        join = lambda c: b"".join(rows[c].to_pylist())
        words, w_at = np.unique(np.frombuffer(join("words"), np.uint64), return_inverse=True)
        pairs, p_at = np.unique(_high(join("pairs"), bucket), return_inverse=True)
        w_count = np.bincount(w_at, weights=np.frombuffer(join("word_times"), np.uint32), minlength=len(words)).astype(np.int64)
        p_count = np.bincount(p_at, weights=np.frombuffer(join("pair_times"), np.uint32), minlength=len(pairs)).astype(np.int64)
        keys = np.concatenate([mix(words), mix(pairs + _PAIR_SALT)])
        count = np.concatenate([w_count, p_count])
        part = segment_of(keys[count > 0], levels(count[count > 0]), bits_per_entry)
        level = levels_in(part, keys)
        w_level, p_level = level[: len(words)], level[len(words) :]
        z = float((lower_end(w_level[w_count > 0]) + 1).sum())
        # Replies are in the order of the keys of each row.
        w_bounds, p_bounds = (np.cumsum([0, *sizes[c]]) for c in ("words", "pairs"))
        w_byte, p_byte = (w_level[w_at] + 1).astype(np.uint8), (p_level[p_at] + 1).astype(np.uint8)
        counts = w_count[w_at].astype(np.uint64)
        cut_up = lambda values, bounds, which: [values[bounds[k] : bounds[k + 1]].tobytes() for k in which]
        asked, of_head = np.flatnonzero(chunks >= 0), np.flatnonzero(chunks < 0)
        none = [b""] * len(asked)
        head_words = np.unique(np.concatenate([np.zeros(0, np.int64), *[w_at[w_bounds[k] : w_bounds[k + 1]] for k in of_head]]))
        head_pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *[p_at[p_bounds[k] : p_bounds[k + 1]] for k in of_head]]))
        number = lambda value, kind: pa.array([None] * len(asked) + [value], kind)
        return pa.table({
            "bucket": pa.array([*chunk_group(chunks[asked], groups).tolist(), bucket], pa.int32()),
            "chunk": pa.array([*chunks[asked].tolist(), -1], pa.int64()),
            "word_levels": _binary([*cut_up(w_byte, w_bounds, asked), (w_level[head_words] + 1).astype(np.uint8).tobytes()]),
            "word_counts": _binary([*cut_up(counts, w_bounds, asked), w_count[head_words].astype(np.uint64).tobytes()]),
            "pair_levels": _binary([*cut_up(p_byte, p_bounds, asked), (p_level[head_pairs] + 1).astype(np.uint8).tobytes()]),
            "words": _binary([*none, words[head_words].tobytes()]), "pairs": _binary([*none, pairs[head_pairs].tobytes()]),
            "n": number(int(w_count.sum()), pa.int64()), "v": number(int((w_count > 0).sum()), pa.int64()), "z": number(z, pa.float64()),
        })

    # A reply's order within its chunk is that of the buckets it came from.
    def placed(rows: pa.Table) -> pa.Table:
        bucket = rows["bucket"][0].as_py()
        found = run(rows)
        return found.append_column("part", pa.array([bucket] * found.num_rows, pa.int32()))

    return placed


@dataclass
class Model:
    """What every worker needs: sums, and the levels and counts of the head."""

    n: int
    v: int
    z: float
    texts: int
    words: np.ndarray  # sorted
    word_levels: np.ndarray
    word_counts: np.ndarray
    pairs: np.ndarray  # sorted
    pair_levels: np.ndarray


def _model(read: DataFrame, texts: int) -> Model:
    """Sums over all buckets and the head's levels, at most ``HEAD`` of each kind."""
    sums = read.filter("chunk < 0").agg(*[F.sum(c).alias(c) for c in ("n", "v", "z")]).first()
    rows = read.filter("chunk < 0 AND (length(words) > 0 OR length(pairs) > 0)").select("words", "word_levels", "word_counts", "pairs", "pair_levels").toArrow()
    joined = {c: np.frombuffer(b"".join(rows[c].to_pylist()), kind) for c, kind in
              (("words", np.uint64), ("word_levels", np.uint8), ("word_counts", np.uint64), ("pairs", np.uint64), ("pair_levels", np.uint8))}
    w, p = np.argsort(joined["words"]), np.argsort(joined["pairs"])
    level = lambda c, order: joined[c][order].astype(np.int64) - 1
    return Model(sums["n"] or 0, sums["v"] or 0, (sums["z"] or 0.0) + 1, texts, joined["words"][w], level("word_levels", w),
                 joined["word_counts"][w].astype(np.int64), joined["pairs"][p], level("pair_levels", p))


# --- scores ----------------------------------------------------------------------------


def probabilities(word_level: np.ndarray, context_level: np.ndarray, pair_level: np.ndarray, begins: np.ndarray, texts: int, z: float) -> np.ndarray:
    """The model's probability of tokens from the levels of word, context and pair; a begin mark is counted exactly."""
    context = np.where(begins, float(texts), upper_end(context_level))
    share = BETA * context / (context + RARE)
    pair = np.maximum(lower_end(pair_level) - DISCOUNT, 0) / np.maximum(context, 1)
    return (1 - share) * (lower_end(word_level) + 1) / z + share * np.minimum(pair, 1)


def _texts(groups: int):
    """Every chunk of text, for the group that it is scored in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _first_chunk()
        for batch in batches:
            for part in _chunks(batch):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(part)
                group = int(chunk_group(np.array([chunk]), groups)[0])
                row = (group, chunk, -1, b"", b"", b"", sink.getvalue().to_pybytes())
                kinds = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4)
                names = ["bucket", "chunk", "part", "word_levels", "word_counts", "pair_levels", "data"]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)
                chunk += 1

    return run


def _score(shared, head, buckets: int, columns: list[str], added: list[str]):
    """Rows of the chunks of a group, once all their levels have come back."""

    def scored(part: pa.RecordBatch, replies: pa.Table) -> pa.RecordBatch:
        model, most = shared.value, head.value
        seen = _Chunk.of(part.column("text"), buckets)
        joined = lambda c, kind: np.frombuffer(b"".join(replies[c].to_pylist()), kind).astype(np.int64)
        level = {}
        for kind, keys, frequent, known, known_levels in (("word", seen.words, most.words, model.words, model.word_levels), ("pair", seen.pairs, most.pairs, model.pairs, model.pair_levels)):
            of_head = _in(keys, frequent)[0]
            found, at = _in(keys, known)
            level[kind] = np.full(len(keys), -1)
            level[kind][~of_head] = joined(f"{kind}_levels", np.uint8) - 1
            # One of the head that no text to learn from holds has no level.
            level[kind][of_head & found] = known_levels[at[of_head & found]]
            if kind == "word":
                count = np.zeros(len(keys), np.int64)
                count[~of_head] = joined("word_counts", np.uint64)
                count[of_head & found] = model.word_counts[at[of_head & found]]
        begins = np.zeros(len(seen.word), bool)
        begins[seen.first[:-1]] = True
        context = np.full(len(seen.word), -1)
        context[1:] = level["word"][seen.word[:-1]]
        p = probabilities(level["word"][seen.word], context, level["pair"][seen.pair], begins, model.texts, model.z)
        per_row = lambda values: np.add.reduceat(values, seen.first[:-1])
        base = per_row((np.log10(count + 1.0) - np.log10(model.n + model.v + 1.0))[seen.word])
        results = [np.diff(seen.first), per_row((count > 0)[seen.word].astype(np.int64)), np.full(part.num_rows, model.n), base, per_row(np.log10(p))]
        return pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], *map(pa.array, results)], names=[*columns, *added])

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("chunk", "ascending"), ("part", "ascending")])
        chunks = rows["chunk"].to_numpy()
        heads = np.flatnonzero(np.diff(chunks, prepend=-1))
        out = []
        for a, b in zip(heads, np.append(heads[1:], len(chunks)), strict=True):
            # Part -1 is the chunk of text; the others follow in the order of their keys.
            with pa.ipc.open_stream(rows["data"][a].as_py()) as stream:
                out += [scored(batch, rows.slice(a + 1, b - a - 1)) for batch in stream]
        return pa.Table.from_batches(out)

    return run


def scored(docs: DataFrame, learn: Column, head_size: int = HEAD, bits_per_entry: int = BITS_PER_ENTRY) -> DataFrame:
    """``docs`` without their text, with ``n_tokens, n_known, train_tokens, base_score, score``.

    The model is learned from the texts where ``learn`` holds and scores all of them.  ``score`` is
    the log10 probability of the text by the model (module docstring), ``base_score`` that of exact
    counts with one added, where words are told apart by 64-bit hashes.  Every word and every pair is
    counted and held in the filter, those seen once too.

    A NULL text is empty and has its end token alone; long texts are scored whole; rows that repeat
    an id, and equal rows, count and are scored each for itself.  An empty table gives none; without a text
    to learn from every score is 0 and every base score too.  Columns of ``docs`` may have any names; those that bear a result's
    name are replaced.  ``docs`` is read twice in the order it is stored in, so it should be a table and not the
    result of a shuffle.
    """
    spark = docs.sparkSession
    added = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    fields = [f for f in docs.schema if f.name != "text" and f.name not in added]
    names = [f.name for f in fields]
    learned = F.coalesce(learn, F.lit(False))
    mark = "learn"
    while mark in docs.columns:
        mark += "_"
    # The same rows and columns for both readings, so that chunks are the same ones.
    texts = docs.select(*names, "text", learned.alias(mark))
    n_learned = docs.filter(learned).count()
    buckets = bucket_count(docs)
    head = spark.sparkContext.broadcast(frequent_ngrams(docs.filter(learned), buckets, n_learned, head_size))  # at most 2 * HEAD keys
    sent = texts.mapInArrow(_send(head, buckets, mark), _SENT)
    read = cut(sent.groupBy("bucket").applyInArrow(_read_back(buckets, bits_per_entry), f"{_READ}, part int"), "levels")
    model = spark.sparkContext.broadcast(_model(read, n_learned))
    replies = read.filter("chunk >= 0").select("bucket", "chunk", "part", "word_levels", "word_counts", "pair_levels", F.lit(b"").alias("data"))
    parts = texts.mapInArrow(_texts(buckets), _MET)
    met = parts.unionByName(replies)
    kinds = (T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType())
    schema = T.StructType([*fields, *[T.StructField(n, k) for n, k in zip(added, kinds, strict=True)]])
    return met.groupBy("bucket").applyInArrow(_score(model, head, buckets, names, added), schema)


def is_held_out(doc_id: Column) -> Column:
    """Documents the model may not learn from; a NULL id is one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(True))


@query("op5_language_model")
def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", is_held_out(F.col("doc_id")).alias("held_out"))
    return scored(docs, ~F.col("held_out"))
