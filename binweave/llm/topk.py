"""Exact top-k by inner product: term-at-a-time accumulation over blocks of the table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binweave.llm.registry import query, table

K = 10
SCALE = 1024
QUERY_EVERY = 100
QUERY_BLOCK, ROW_BLOCK = 1024, 4096  # rows meant to be in a block, which bounds a task's memory

_KEYS = ["_qb", "_rb"]
_FOUND = "query_id long, vec_id long, score long"


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as whole numbers."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    """Neither NULL nor holding a NULL, NaN or infinite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | F.abs(x).isin(float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _postings(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Non-zero components sorted by term: term, row, weight, and the bounds of each term."""
    lengths = np.diff(lists.offsets.to_numpy())
    rows = np.repeat(np.arange(len(lengths)), lengths)
    weights = lists.flatten().to_numpy(zero_copy_only=False)
    terms = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    kept = np.flatnonzero(weights)
    order = kept[np.argsort(terms[kept], kind="stable")]
    n_terms = int(lengths.max(initial=0))
    return terms, rows[order], weights[order], np.searchsorted(terms[order], np.arange(n_terms + 1))


def _search(k: int):
    def search(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[], [], []]
        if queries.num_rows and rows.num_rows:
            rows = rows.sort_by("vec_id")
            ids = rows["vec_id"].to_numpy()
            _, at, weight, bounds = _postings(rows["v"].combine_chunks())
            for qid, vector in zip(queries["vec_id"].to_pylist(), queries["v"].to_pylist(), strict=True):
                scores = np.zeros(len(ids), np.int64)
                for term, x in enumerate(vector[: len(bounds) - 1]):
                    if x:
                        low, high = bounds[term], bounds[term + 1]
                        scores[at[low:high]] += x * weight[low:high]
                others = np.flatnonzero(ids != qid)
                if len(others) > k:
                    least = np.partition(scores[others], len(others) - k)[len(others) - k]
                    others = others[scores[others] >= least]
                best = others[np.lexsort((ids[others], -scores[others]))]
                # Rows that repeat an id count once, by their best score.
                best = best[np.sort(np.unique(ids[best], return_index=True)[1])][:k]
                for out, value in zip(found, (np.full(len(best), qid), ids[best], scores[best]), strict=True):
                    out.append(value)
        columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in found]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    return search


def top_k(queries: DataFrame, rows: DataFrame, k: int = K) -> DataFrame:
    """The ``k`` rows of greatest inner product for each query, other than the query's own id.

    Both sides hold ``vec_id`` (not NULL) and ``v``, an array of whole numbers; missing
    components count as 0.  Every query block meets every row block once: this is the whole
    exhaustive search, in blocks of bounded size.  Within a block pair each query scatters its
    weighted postings into a dense score array, one term at a time, and a partition selection
    keeps k; the final ranking merges those.  Ties go to the smaller id.  Equal rows count once;
    if an id has several vectors, its best score counts.  Sums are 64-bit.
    """
    n_queries, n_rows = queries.count(), rows.count()
    q_blocks, r_blocks = n_queries // QUERY_BLOCK + 1, n_rows // ROW_BLOCK + 1
    # Distinct first: of repeated rows one is left, and ids then deal rows evenly to blocks.
    block = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("vec_id", "v").distinct().withColumn("_qb", block(q_blocks)).withColumn("_rb", others(r_blocks))
    right = rows.select("vec_id", "v").distinct().withColumn("_rb", block(r_blocks)).withColumn("_qb", others(q_blocks))
    found = left.groupBy(*_KEYS).cogroup(right.groupBy(*_KEYS)).applyInArrow(_search(k), _FOUND)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


OP8_SQL = f"""
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         max(CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT)) AS score
  FROM v q JOIN v c ON q.vec_id % {QUERY_EVERY} = 0 AND c.vec_id <> q.vec_id
  GROUP BY 1, 2
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= {K}
"""


@query("op8_top_k", OP8_SQL)
def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best rows for each vector whose id is divisible by 100."""
    rows = (
        table(spark, sf_dir, "embeddings")
        .filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
        .select("vec_id", quantised(F.col("embedding")).alias("v"))
    )
    return top_k(rows.filter(F.col("vec_id") % QUERY_EVERY == 0), rows, K)
