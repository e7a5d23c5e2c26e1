"""Ranked lexical search by norm buckets: exact top documents for each item of a query set.

A document is a vector of impacts over the terms of the items, an item a vector of term weights,
and the score their inner product.  Documents are put in order of the length of their vector and
cut into buckets.  By Cauchy-Schwarz no document of a bucket can beat the greatest length there
times the length of the item, which passes over whole buckets; within a bucket the heaviest
coordinates of an item bound every document, and those left are scored again in whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binweave.llm.registry import query, table
from binweave.llm.words import row_chunks, split, unique_per_row
from binweave.scratch import cut

K = 50
IMPACT, SATURATION = 1_000_000_000, 20  # fixed values of the impact formula
WEIGHT_SCALE = 1000
BLOCK_ITEMS = 4096  # items searched for in one pass over the documents
BLOCK_BYTES = 1 << 20  # text of the items of one pass; a longer item has a pass of its own
SEED_ROWS = 4096  # longest vectors, which give the first thresholds
BUCKET_ROWS = 4096
FOCUS = 8  # coordinates of an item that bound the documents of a bucket
SLACK = 1 + 1e-9  # what rounding may take off a bound

_NO_ID = np.iinfo(np.int64).max  # stands for a NULL id, which comes after all others
_COUNTS = "doc_id long, n long, terms array<int>, times array<long>"
_VECTORS = "doc_id long, norm double, terms array<int>, impacts array<int>"
_FOUND = "item int, doc_id long, score long"


@dataclass
class Items:
    """A block of items: distinct terms by hash, and the terms of each item."""

    vocabulary: np.ndarray
    first: np.ndarray
    terms: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Items:
        words = split(pa.array(texts, pa.string()), lower=True, plain=True)
        vocabulary = np.unique(words.hashes)
        rows = np.repeat(np.arange(len(texts)), words.counts)
        terms, first = unique_per_row(np.searchsorted(vocabulary, words.hashes), rows, len(texts))
        return cls(vocabulary, first, terms)

    def __len__(self) -> int:
        return len(self.first) - 1


def _lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind))


def _flat(column: pa.Array, kind: type = np.int64) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists of a column, and where each row's begin."""
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind), offsets - offsets[0]


def _count_terms(vocabulary: Broadcast):
    """Number of terms of every document, and how often it holds each term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, known = batch.column("text"), vocabulary.value
            for low, high in row_chunks(column):
                words = split(column.slice(low, high - low), lower=True, plain=True)
                at = np.minimum(np.searchsorted(known, words.hashes), max(len(known) - 1, 0))
                hit = np.flatnonzero(known[at] == words.hashes) if len(known) else np.zeros(0, np.int64)
                rows = np.repeat(np.arange(high - low), words.counts)[hit]
                pairs, times = np.unique(rows * max(len(known), 1) + at[hit], return_counts=True)
                first = np.searchsorted(pairs, np.arange(high - low + 1) * max(len(known), 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), pa.array(words.counts.astype(np.int64)),
                     _lists(pairs % max(len(known), 1), first, pa.int32()), _lists(times, first, pa.int64())],
                    names=["doc_id", "n", "terms", "times"],
                )

    return run


def _documents_per_term(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column(0))[0], minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    return run


def term_weights(df: np.ndarray, n: int) -> np.ndarray:
    """floor(1000 * ln((2N + 2) / (2 df + 1))), in doubles."""
    return np.array([math.floor(WEIGHT_SCALE * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def _vectors(weights: Broadcast):
    """Impacts of every document, and the length of its vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, first = _flat(batch.column("terms"))
            times, _ = _flat(batch.column("times"))
            m = np.repeat(batch.column("m").to_numpy(), np.diff(first))
            impacts = (IMPACT * times) // (1000 * times + SATURATION * m)
            squares = np.concatenate([[0.0], np.cumsum(weights.value[terms] * impacts.astype(np.float64) ** 2)])
            # Differences of running sums may round below the true sum; the bound may not.
            norm = np.sqrt(np.maximum(squares[first[1:]] - squares[first[:-1]], 0.0) + squares[-1] * 1e-13)
            norm[first[1:] == first[:-1]] = 0.0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(norm), batch.column("terms"), _lists(impacts, first, pa.int32())],
                names=["doc_id", "norm", "terms", "impacts"],
            )

    return run


class _Best:
    """The best documents of each item that a task has seen, and what must be reached to join them."""

    def __init__(self, least: np.ndarray, k: int):
        self.k = k
        self.least = least.copy()
        self.scores = [np.zeros(0, np.int64) for _ in least]
        self.ids = [np.zeros(0, np.int64) for _ in least]

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        good = (scores >= self.least[item]) & (scores > 0)
        scores = np.concatenate([self.scores[item], scores[good]])
        ids = np.concatenate([self.ids[item], ids[good]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[item], self.ids[item] = scores[order], ids[order]
        if len(order) == self.k:
            self.least[item] = max(self.least[item], scores[order[-1]])


def _search_bucket(items: Items, weights: np.ndarray, ids: np.ndarray, norms: np.ndarray, terms: np.ndarray, impacts: np.ndarray, first: np.ndarray, best: _Best) -> None:
    """Offer every document of one bucket that can reach an item's least score to its best."""
    greatest, lists = norms.max(initial=0.0), None
    for item in range(len(items)):
        own = items.terms[items.first[item] : items.first[item + 1]]
        w = weights[own]
        if greatest * math.sqrt(w.sum()) * SLACK < best.least[item] or greatest == 0.0:
            continue  # no document of the bucket is long enough
        if lists is None:
            rows = np.repeat(np.arange(len(ids)), np.diff(first))
            order = np.argsort(terms, kind="stable")
            lists = rows[order], impacts[order], np.searchsorted(terms[order], np.arange(len(items.vocabulary) + 1))
        at, value, bounds = lists
        heavy = own[np.argsort(-w, kind="stable")]
        partial, squares = np.zeros(len(ids), np.int64), np.zeros(len(ids))
        for term in heavy[:FOCUS]:
            span = slice(bounds[term], bounds[term + 1])
            partial[at[span]] += weights[term] * value[span]
            squares[at[span]] += weights[term] * value[span].astype(np.float64) ** 2
        rest = heavy[FOCUS:]
        # What the other coordinates can add: Cauchy-Schwarz over what is left of both vectors.
        left = np.sqrt(np.maximum(norms * norms * SLACK - squares, 0.0) * float(weights[rest].sum()))
        some = np.flatnonzero((partial + left) * SLACK >= max(best.least[item], 1))
        if not len(some):
            continue
        score = partial
        if len(rest):
            # Exactly, in whole numbers: the lists of the other terms.
            for term in rest:
                span = slice(bounds[term], bounds[term + 1])
                score[at[span]] += weights[term] * value[span]
        best.add(item, score[some], ids[some])


def _search(shared: Broadcast, weights: Broadcast, k: int):
    """The best documents of a task for each item; ``shared`` holds the items and their thresholds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, least = shared.value
        best = _Best(least, k)
        for batch in batches:
            ids = batch.column("doc_id").fill_null(_NO_ID).to_numpy()
            norms = batch.column("norm").to_numpy()
            terms, first = _flat(batch.column("terms"))
            impacts, _ = _flat(batch.column("impacts"))
            for low in range(0, len(ids), BUCKET_ROWS):
                high = min(low + BUCKET_ROWS, len(ids))
                span = slice(first[low], first[high])
                _search_bucket(items, weights.value, ids[low:high], norms[low:high], terms[span], impacts[span], first[low : high + 1] - first[low], best)
        item = np.repeat(np.arange(len(items), dtype=np.int32), [len(x) for x in best.ids])
        ids = np.concatenate([np.zeros(0, np.int64), *best.ids])
        scores = np.concatenate([np.zeros(0, np.int64), *best.scores])
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=ids == _NO_ID), pa.array(scores)], names=["item", "doc_id", "score"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _blocks(items: DataFrame, most_items: int, most_bytes: int) -> Iterator[list[tuple]]:
    """Items in blocks of bounded size, read one partition at a time."""
    block, size = [], 0
    for row in items.toLocalIterator():
        length = len(row["text"].encode())
        if block and (len(block) >= most_items or size + length > most_bytes):
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += length
    if block:
        yield block


def _search_block(docs: DataFrame, block: list[tuple], k: int) -> DataFrame:
    spark = docs.sparkSession
    items = Items.of([text for _, text in block])
    size = len(items.vocabulary)
    vocabulary = spark.sparkContext.broadcast(items.vocabulary)  # bounded by the block
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    counts = cut(slim.mapInArrow(_count_terms(vocabulary), _COUNTS), "terms")
    totals = counts.filter("n > 0").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    per_term = counts.select("terms").mapInArrow(_documents_per_term(size), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(size, np.int64)
    df[per_term["term"].to_numpy()] = per_term["df"].to_numpy()
    weights = spark.sparkContext.broadcast(term_weights(df, totals["docs"]))
    # 50 n N may pass 64 bits on the way; the quotient never does.
    m = F.expr(f"cast(50 + (cast(n as decimal(18, 0)) * {50 * totals['docs']}BD) div {max(totals['terms'], 1)}BD as bigint)")
    met = counts.filter(F.size("terms") > 0).select("doc_id", m.alias("m"), "terms", "times")
    vectors = cut(met.mapInArrow(_vectors(weights), _VECTORS).filter("norm > 0"), "vectors")
    # First thresholds: what the longest vectors reach, all of them at once.
    longest = vectors.select("norm").orderBy(F.desc("norm")).limit(SEED_ROWS).agg(F.min("norm")).first()[0]
    least = np.zeros(len(items), np.int64)
    if longest is not None:
        none = spark.sparkContext.broadcast((items, least))
        first = _ranked(vectors.filter(F.col("norm") >= longest).mapInArrow(_search(none, weights, k), _FOUND), k)
        for item, score in first.filter(F.col("rank") == k).select("item", "score").collect():  # at most one row per item
            least[item] = score
    # Shorter than any item asks for: such vectors need not be put in order.
    lengths = np.array([math.sqrt(weights.value[items.terms[items.first[i] : items.first[i + 1]]].sum()) for i in range(len(items))])
    asked = float(np.min(np.where(lengths > 0, least / np.maximum(lengths, 1e-300), np.inf), initial=np.inf)) / SLACK
    shared = spark.sparkContext.broadcast((items, least))
    long = vectors.filter(F.col("norm") >= asked)
    # Equal vectors, however many, are dealt over partitions by their ids.
    order = [F.desc("norm"), F.col("doc_id"), F.rand(7)]
    buckets = long.repartitionByRange(*order).sortWithinPartitions(F.desc("norm"))
    ranked = _ranked(buckets.mapInArrow(_search(shared, weights, k), _FOUND), k)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item int, item_id bigint")
    return ranked.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of greatest score for each item.

    Terms are runs of letters, digits and bytes above 127, A-Z lower-cased; a document's score
    sums weight times impact over the terms of an item, once each, in whole numbers.  Only
    documents with a score above 0 are ranked, all of them if there are fewer than ``k``, ties by
    smaller doc_id.  Items are searched for in blocks of bounded size, one pass over the documents
    each, so no number of items is too large.

    A NULL or empty text has no terms; such a document is not counted and such an item finds
    nothing.  A NULL doc_id ranks after all others of its score.  Rows that repeat a doc_id are
    documents of their own.  Items that repeat id and text count once; texts that share an id
    (or have none) are ranked each for itself.  Empty tables give no rows, long texts are read whole,
    other columns are ignored.  Ids are whole numbers.  Terms are told apart by 64-bit hashes.
    """
    queries = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("text IS NOT NULL").distinct()
    found = None
    for block in _blocks(queries, block_items, block_bytes):
        part = _search_block(docs, block, k)
        # Only the k best rows per item: written, so that blocks do not pile up in one plan.
        part = cut(part, "ranked")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return found


_TERMS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

OP11_SQL = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS_SQL} AS w FROM documents
), i AS MATERIALIZED (
  SELECT row_number() OVER () AS q, item_id, list_distinct({_TERMS_SQL}) AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)
), totals AS (
  SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0
), f AS MATERIALIZED (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY 1, 2
), weights AS MATERIALIZED (
  SELECT term, CAST(floor({WEIGHT_SCALE} * ln((2 * n + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM f GROUP BY term), totals
), m AS (
  SELECT r, doc_id, 50 + (50 * len(w) * n) // l AS m FROM d, totals WHERE len(w) > 0
), s AS (
  SELECT q, r, CAST(sum(w * (({IMPACT} * tf) // (1000 * tf + {SATURATION} * m))) AS BIGINT) AS score
  FROM (SELECT q, unnest(w) AS term FROM i) JOIN f USING (term) JOIN weights USING (term) JOIN m USING (r) GROUP BY 1, 2
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s JOIN m USING (r) WHERE score > 0
) JOIN i USING (q) WHERE rank <= {K}
"""


@query("op11_lexical_search", OP11_SQL)
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
