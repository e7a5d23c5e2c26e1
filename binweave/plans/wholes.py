"""Queries over whole triangles, groups of any size and sketches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binweave.operators.gaps import cells_of_runs, missing_runs
from binweave.operators.groups import (
    RUN_STATE,
    apply_in_blocks,
    longest_run,
    rows_in_blocks,
    run_of_block,
    user_aggregate,
    weighted_median,
)
from binweave.plans import sql_parts as s
from binweave.plans.registry import query
from binweave.sources.stand_ins import pixels, restarting


def _runs_sql(source: str) -> str:
    """Runs of missing cells from every cell of the triangle, which the Spark code never builds."""
    return f"""
bins AS (SELECT chr, region2, row_number() OVER (PARTITION BY chr ORDER BY region2) AS place
         FROM (SELECT DISTINCT chr, region2 FROM {source})),
missing AS (
  SELECT f.chr, f.region1, b.region2, b.place FROM (SELECT DISTINCT chr, region1 FROM {source}) f
  JOIN bins b ON b.chr = f.chr AND b.region2 >= f.region1
  ANTI JOIN {source} p ON p.chr = f.chr AND p.region1 = f.region1 AND p.region2 = b.region2),
islands AS (
  SELECT *, place - row_number() OVER (PARTITION BY chr, region1 ORDER BY place) AS island FROM missing),
runs AS (
  SELECT chr, region1, min(region2) AS first_missing, max(region2) AS last_missing, count(*) AS cells
  FROM islands GROUP BY chr, region1, island)"""


@query("e3_missing_runs", s.sql(s.PIXELS, _runs_sql("pixels"), "SELECT * FROM runs"))
def runs(spark: SparkSession, d: str) -> DataFrame:
    """All that is missing from the whole triangle of every chromosome, as runs."""
    return missing_runs(pixels(spark, d))


@query("e3_missing_runs_restarting", s.sql(s.RESTARTING, _runs_sql("restarting"), "SELECT * FROM runs"))
def runs_restarting(spark: SparkSession, d: str) -> DataFrame:
    return missing_runs(restarting(spark, d))


@query(
    "e3_longest_runs",
    s.sql(
        s.PIXELS, _runs_sql("pixels"),
        """SELECT chr, count(*) AS runs, CAST(sum(cells) AS BIGINT) AS missing, max(cells) AS longest,
             min(region1) FILTER (WHERE cells = longest_of_chr) AS region1
           FROM (SELECT *, max(cells) OVER (PARTITION BY chr) AS longest_of_chr FROM runs) GROUP BY chr""",
    ),
)
def longest_runs(spark: SparkSession, d: str) -> DataFrame:
    """Per chromosome how many cells are missing, in how many runs, and the first bin of the longest."""
    found = missing_runs(pixels(spark, d))
    longest = F.max(F.struct("cells", (-F.col("region1")).alias("minus")))
    of_chr = found.groupBy("chr").agg(F.count("*").alias("runs"), F.sum("cells").alias("missing"), longest.alias("l"))
    return of_chr.select("chr", "runs", "missing", F.col("l.cells").alias("longest"), (-F.col("l.minus")).alias("region1"))


@query(
    "e3_cells_of_runs",
    s.sql(
        s.PIXELS, _runs_sql("pixels"),
        "ends AS (SELECT chr, max(region1) AS region1 FROM pixels GROUP BY chr)",
        "SELECT m.chr, m.region1, m.region2 FROM missing m JOIN ends e ON m.chr = e.chr AND m.region1 = e.region1",
    ),
)
def cells_of_chosen(spark: SparkSession, d: str) -> DataFrame:
    """The missing cells of each chromosome's last first bin, listed from its runs."""
    px = pixels(spark, d)
    ends = px.groupBy("chr").agg(F.max("region1").alias("region1"))
    return cells_of_runs(px, missing_runs(px).join(ends, ["chr", "region1"]))


# --- user functions and aggregates over groups of any size ---------------------------------

# A cluster that holds a third of all pixels beside the others.
_HOT = """
hot AS (SELECT chr, CASE WHEN region1 % 3 = 0 THEN 0 ELSE clust END AS clust, region1, region2, region1 + region2 AS v, logfc FROM pixels)"""


def _hot(spark: SparkSession, d: str) -> DataFrame:
    clust = F.when(F.col("region1") % 3 == 0, F.lit(0)).otherwise(F.col("clust"))
    return pixels(spark, d).select("chr", clust.alias("clust"), "region1", "region2", (F.col("region1") + F.col("region2")).alias("v"), "logfc")


@query(
    "k1_longest_run",
    s.sql(
        s.PIXELS, _HOT,
        """marked AS (SELECT chr, clust, v, v - row_number() OVER (PARTITION BY chr, clust ORDER BY v) AS island
                      FROM (SELECT DISTINCT chr, clust, v FROM hot)),
           islands AS (SELECT chr, clust, count(*) AS run, min(v) AS starts FROM marked GROUP BY chr, clust, island)""",
        """SELECT * FROM islands QUALIFY row_number() OVER (PARTITION BY chr, clust ORDER BY run DESC, starts) = 1""",
    ),
)
def longest_runs_of_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The longest run of adjacent anti-diagonals of each cluster, one of which holds a third of all pixels.

    Which rows follow each other depends on all of the group; blocks give the runs at their ends.
    """
    rows = _hot(spark, d).select("chr", "clust", "v")
    return apply_in_blocks(rows, ["chr", "clust"], "v", run_of_block("v"), RUN_STATE, longest_run, "run bigint, starts bigint", block_rows=20_000)


_HALO = 10


def _local_median(rows: pa.Table) -> pa.Table:
    """Median of logFC among the pixels up to ten anti-diagonals away, for each anti-diagonal of the block."""
    v, logfc = rows["v"].to_numpy(), rows["logfc"].to_numpy()
    own = np.unique(v[rows["_own"].to_numpy()])
    low, high = np.searchsorted(v, own - _HALO), np.searchsorted(v, own + _HALO, side="right")
    return pa.table({"v": own, "pixels": high - low, "median": np.array([np.median(logfc[a:b]) for a, b in zip(low, high)], np.float64)})


@query(
    "k1_local_median",
    s.sql(
        s.PIXELS, _HOT,
        """of_v AS (SELECT DISTINCT chr, v, count(*) OVER w AS pixels, median(logfc) OVER w AS median FROM hot
                    WINDOW w AS (PARTITION BY chr ORDER BY v RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING))""",
        "SELECT chr, v, pixels, median FROM of_v",
    ),
)
def local_median(spark: SparkSession, d: str) -> DataFrame:
    """A moving median along each chromosome: blocks see the rows of their neighbours within reach."""
    rows = _hot(spark, d).select("chr", "v", "logfc")
    return rows_in_blocks(rows, ["chr"], "v", _local_median, "v bigint, pixels bigint, median double", halo=_HALO, block_rows=20_000)


@query(
    "k2_weighted_median",
    s.sql(
        s.PIXELS, _HOT,
        """weights AS (SELECT chr, clust, logfc, CAST(sum(region2 - region1 + 1) AS BIGINT) AS w FROM hot GROUP BY chr, clust, logfc),
           upto AS (SELECT *, sum(w) OVER (PARTITION BY chr, clust ORDER BY logfc) AS s, sum(w) OVER (PARTITION BY chr, clust) AS total FROM weights)""",
        "SELECT chr, clust, min(logfc) AS median, true AS exact FROM upto WHERE 2 * s >= total GROUP BY chr, clust",
    ),
)
def weighted_medians(spark: SparkSession, d: str) -> DataFrame:
    """Median of logFC weighted by distance, an aggregate no expression can say, for each cluster."""
    rows = _hot(spark, d).withColumn("weight", F.col("region2") - F.col("region1") + 1)
    return user_aggregate(rows, ["chr", "clust"], ["logfc", "weight"], weighted_median("logfc", "weight"))
