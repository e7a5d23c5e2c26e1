"""Queries on chromosomes that use the same bin numbers, with clusters missing from some pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binweave.operators.relational import (
    above_subset_max,
    grid_sizes,
    index_shift,
    join_null_safe,
    missing_pixels,
    relative_to_least,
    rows_of_first_id,
    rows_of_ranked_keys,
)
from binweave.operators.selection import diagonal_pixels
from binweave.operators.summaries import count_of_counts, most_significant, presence_crosstab, with_p
from binweave.plans import sql_parts as s
from binweave.plans.registry import query
from binweave.sources.stand_ins import restarting


@query(
    "c2_count_of_counts_restarting",
    s.sql(
        s.RESTARTING,
        'SELECT n AS "rows", count(*) AS keys FROM (SELECT count(*) AS n FROM restarting GROUP BY chr, clust) GROUP BY n',
    ),
)
def uniqueness(spark: SparkSession, d: str) -> DataFrame:
    return count_of_counts(restarting(spark, d), ["chr", "clust"])


@query(
    "b10_ranked_keys_restarting",
    s.sql(
        s.RESTARTING,
        """SELECT r.* FROM restarting r JOIN (
             SELECT chr, clust, row_number() OVER (ORDER BY chr, clust NULLS FIRST) AS n
             FROM (SELECT DISTINCT chr, clust FROM restarting)) k
           ON r.chr = k.chr AND r.clust IS NOT DISTINCT FROM k.clust WHERE n IN (1, 40)""",
    ),
)
def ranked_keys(spark: SparkSession, d: str) -> DataFrame:
    """The missing cluster is the first key."""
    return rows_of_ranked_keys(restarting(spark, d), ["chr", "clust"], [1, 40])


@query(
    "b11_above_subset_max_by_chr",
    s.sql(
        s.RESTARTING,
        """SELECT r.chr, region1, region2, logfc FROM restarting r
           JOIN (SELECT chr, max(logfc) AS m FROM restarting WHERE p_value > 0.5 AND logfc < 1 GROUP BY chr) l USING (chr)
           WHERE logfc > m""",
    ),
)
def above_max(spark: SparkSession, d: str) -> DataFrame:
    subset = (F.col("p_value") > 0.5) & (F.col("logfc") < 1)
    return above_subset_max(restarting(spark, d), "logfc", subset, ["chr"]).select("chr", "region1", "region2", "logfc")


@query(
    "b12_index_shift_restarting",
    s.sql(
        s.RESTARTING,
        """SELECT r.*, region2 - m + 1 AS i, region1 - m + 1 AS j FROM restarting r
           JOIN (SELECT chr, least(min(region1), min(region2)) AS m FROM restarting GROUP BY chr) USING (chr)""",
    ),
)
def shifted(spark: SparkSession, d: str) -> DataFrame:
    return index_shift(restarting(spark, d))


@query("b16_head_restarting", s.sql(s.RESTARTING, "SELECT * FROM restarting ORDER BY chr, region1, region2 LIMIT 5"))
def head(spark: SparkSession, d: str) -> DataFrame:
    return restarting(spark, d).orderBy("chr", "region1", "region2").limit(5)


@query(
    "b17_diagonal_head_restarting",
    s.sql(s.RESTARTING, "SELECT chr, region1, region2 FROM restarting WHERE region1 = region2 ORDER BY chr, region1 LIMIT 5"),
)
def diagonal_head(spark: SparkSession, d: str) -> DataFrame:
    return diagonal_pixels(restarting(spark, d), 5).select("chr", "region1", "region2")


@query(
    "c21_most_significant_restarting",
    s.sql(s.RESTARTING, "SELECT chr, clust, region1, region2 FROM restarting ORDER BY p_value, chr, region1, region2 LIMIT 1"),
)
def best_pixel(spark: SparkSession, d: str) -> DataFrame:
    return most_significant(with_p(restarting(spark, d)), ["chr", "clust", "region1", "region2"])


@query(
    "c22_presence_crosstab_restarting",
    s.sql(
        s.RESTARTING,
        "SELECT chr, region1, "
        + ", ".join(f'count(*) FILTER (region2 = {k}) AS "{k}"' for k in range(1, 13))
        + " FROM restarting WHERE region1 > 0 AND region1 < 13 AND region2 > 0 AND region2 < 13 GROUP BY chr, region1",
    ),
)
def crosstab(spark: SparkSession, d: str) -> DataFrame:
    return presence_crosstab(restarting(spark, d), 0, 13)


@query(
    "c27_grid_cells_restarting",
    s.sql(
        s.RESTARTING,
        """SELECT f.chr, f.region1, count(*) AS cells FROM (SELECT DISTINCT chr, region1 FROM restarting) f
           JOIN (SELECT DISTINCT chr, region2 FROM restarting) o ON o.chr = f.chr AND o.region2 >= f.region1
           GROUP BY f.chr, f.region1""",
    ),
)
def cells(spark: SparkSession, d: str) -> DataFrame:
    return grid_sizes(restarting(spark, d))


@query(
    "d1_group_relative_restarting",
    s.sql(
        s.RESTARTING,
        """SELECT chr, clust, region1, region2, region1 - min(region1) OVER w AS rel_region1, region2 - min(region2) OVER w AS rel_region2
           FROM restarting WINDOW w AS (PARTITION BY chr, clust)""",
    ),
)
def group_relative(spark: SparkSession, d: str) -> DataFrame:
    """Pixels without a cluster are a group of their own on each chromosome."""
    rel = relative_to_least(restarting(spark, d), ["chr", "clust"], ["region1", "region2"])
    return rel.select("chr", "clust", "region1", "region2", "rel_region1", "rel_region2")


@query(
    "d4_first_id_restarting",
    s.sql(
        s.RESTARTING,
        "SELECT * FROM restarting QUALIFY region1 = min(region1) OVER (PARTITION BY chr, clust)",
    ),
)
def first_id(spark: SparkSession, d: str) -> DataFrame:
    return rows_of_first_id(restarting(spark, d), ["chr", "clust"], "region1")


@query(
    "e3_missing_pixels_restarting",
    s.sql(
        s.RESTARTING,
        """SELECT f.chr, f.region1, o.region2 FROM (SELECT DISTINCT chr, region1 FROM restarting) f
           JOIN (SELECT DISTINCT chr, region2 FROM restarting) o
             ON o.chr = f.chr AND o.region2 BETWEEN f.region1 AND f.region1 + 10
           EXCEPT SELECT chr, region1, region2 FROM restarting""",
    ),
)
def missing(spark: SparkSession, d: str) -> DataFrame:
    return missing_pixels(restarting(spark, d), 10)


@query(
    "e6_join_restarting",
    s.sql(
        s.RESTARTING,
        """SELECT chr, clust, count(*) AS pixels, min(region1) AS region1, min(region2) AS region2
           FROM restarting GROUP BY chr, clust""",
    ),
)
def named_join(spark: SparkSession, d: str) -> DataFrame:
    """Two tables by cluster meet on the missing cluster too."""
    keys = ["chr", "clust"]
    groups = restarting(spark, d).groupBy(*keys)
    corner = groups.agg(F.min("region1").alias("region1"), F.min("region2").alias("region2"))
    return join_null_safe(groups.agg(F.count("*").alias("pixels")), corner, keys)
