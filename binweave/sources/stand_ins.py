"""Matrix tables derived from the star-schema test data.

The test data holds no interaction matrix, so a band of pixels is built from
order lines: position from the part key, distance from the quantity.  The same
rules are stated in SQL for the checks (``plans.sql_parts``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def pixels(spark: SparkSession, sf_dir: str, with_zero_p: bool = False) -> DataFrame:
    """One row per (region1, region2); ``with_zero_p`` lets p reach 0."""
    sums = (
        _lines(spark, sf_dir)
        .select(
            F.col("l_partkey").alias("region1"),
            (F.col("l_partkey") + F.col("l_quantity").cast("bigint") - 1).alias("region2"),
            (F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("v"),
        )
        .groupBy("region1", "region2")
        .agg(F.sum("v").alias("s"))
    )
    p = F.col("s") % 1000 if with_zero_p else 1 + F.col("s") % 1000
    return sums.select(
        F.concat(F.lit("chr"), (1 + F.expr("region1 div 1000")).cast("string")).alias("chr"),
        "region1",
        "region2",
        F.expr("(region1 div 7) * 100 + (region2 - region1) div 6").cast("int").alias("clust"),
        ((F.col("s") % 81 - 40).cast("double") / 16.0).alias("logfc"),
        (p.cast("double") / 1000.0).alias("p_value"),
    )


def restarting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels on two chromosomes that use the same bin numbers, some without a cluster."""
    sums = (
        _lines(spark, sf_dir)
        .select(
            (F.col("l_linenumber") % 2).alias("m"),
            F.col("l_partkey").alias("region1"),
            (F.col("l_partkey") + F.col("l_quantity").cast("bigint") - 1).alias("region2"),
            (F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("v"),
        )
        .groupBy("m", "region1", "region2")
        .agg(F.sum("v").alias("s"))
    )
    cluster = F.expr("(region1 div 7) * 100 + (region2 - region1) div 6").cast("int")
    return sums.select(
        F.concat(F.lit("chr"), (1 + F.col("m")).cast("string")).alias("chr"),
        "region1",
        "region2",
        F.when(F.col("s") % 13 != 0, cluster).alias("clust"),
        ((F.col("s") % 81 - 40).cast("double") / 16.0).alias("logfc"),
        ((1 + F.col("s") % 1000).cast("double") / 1000.0).alias("p_value"),
    )


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per polygon vertex, at several numbers of clusters."""
    x = F.col("l_partkey")
    return _lines(spark, sf_dir).select(
        F.col("l_linenumber").alias("nb_clust"),
        F.col("l_orderkey").alias("id"),
        (x + F.col("l_quantity").cast("bigint") - 1).alias("i"),
        x.alias("j"),
        x.cast("double").alias("x"),
        F.col("l_quantity").alias("y"),
        F.col("l_extendedprice").alias("iff"),
    )


def criterion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per number of clusters."""
    return (
        _lines(spark, sf_dir)
        .groupBy(F.col("l_linenumber").alias("nb_clust"))
        .agg(F.count("*").cast("double").alias("crit"))
    )
