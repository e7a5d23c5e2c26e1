"""Missing cells of the whole triangle as runs: between two neighbouring pixels of a bin one row.

The triangle of a chromosome is quadratic in its bins, but what is missing from it lies between
pixels.  Second bins are numbered per chromosome, so that a run is a difference of numbers; there are
at most as many runs as pixels and first bins together, and no cell is ever built.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binweave.operators.relational import BIN_BLOCK, join_null_safe, join_spread
from binweave.scratch import cut


def _blocks(pixels: DataFrame, by: Sequence[str]) -> DataFrame:
    """Blocks of ``BIN_BLOCK`` bins: their second bins in order, and what lies before and after.

    ``shift`` counts the second bins of earlier blocks, ``before`` and ``after`` are the nearest
    ones around.  Only blocks, never bins or pixels, are put in order along a chromosome.
    """
    seconds = pixels.select(*by, "region2", F.floor(F.col("region2") / BIN_BLOCK).alias("block")).distinct()
    firsts = pixels.select(*by, F.floor(F.col("region1") / BIN_BLOCK).alias("block")).distinct()
    every = seconds.unionByName(firsts, allowMissingColumns=True)  # a block of first bins only has no second ones
    arrays = every.groupBy(*by, "block").agg(F.sort_array(F.collect_set("region2")).alias("bins"))
    along = Window.partitionBy(*by).orderBy("block")
    earlier, later = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(1, Window.unboundedFollowing)
    sizes = arrays.select(
        *by, "block", F.size("bins").alias("n"),
        F.try_element_at("bins", F.lit(1)).alias("least"), F.try_element_at("bins", F.lit(-1)).alias("greatest"),
    )
    around = sizes.select(
        *by, "block",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"),
        F.max("greatest").over(earlier).alias("before"),
        F.min("least").over(later).alias("after"),
    )
    return join_null_safe(arrays, around, [*by, "block"])


def _numbered(blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every second bin with its number on the chromosome and the bins next to it."""
    line = F.concat(F.array("before"), "bins", F.array("after"))
    entry = F.transform(
        "bins",
        lambda bin, i: F.struct(
            bin.alias("region2"), (F.col("shift") + i + 1).cast("bigint").alias("at"),
            F.get(line, i).alias("before"), F.get(line, i + 2).alias("after"),
        ),
    )
    return blocks.select(*by, F.inline(entry))


def missing_runs(pixels: DataFrame, by: Sequence[str] = ("chr",)) -> DataFrame:
    """``region1, first_missing, last_missing, cells``: every run of missing cells of the whole triangle.

    The grid is that of ``missing_pixels``: pairs of a seen region1 and a seen region2 of at least
    region1.  A run holds all grid cells of ``region1`` from ``first_missing`` to ``last_missing``,
    ``cells`` of them, and is as long as can be.  Repeated pixels count once; pixels below the
    diagonal make their bins seen but fill no cell; pixels without both bins are passed over.  A
    missing key of ``by`` is a group of its own.
    """
    seen = pixels.filter("region1 IS NOT NULL AND region2 IS NOT NULL").select(*by, "region1", "region2")
    blocks = cut(_blocks(seen, by), "blocks")
    bins = _numbered(blocks, by)
    ends = bins.groupBy(*by).agg(F.max("at").alias("last_at"), F.max("region2").alias("last"))
    # Where each region1's cells begin: in its own block of bins, or with the next bin after it.
    firsts = seen.select(*by, "region1").distinct().withColumn("block", F.floor(F.col("region1") / BIN_BLOCK))
    own = join_null_safe(firsts, blocks, [*by, "block"]).withColumn("from", F.filter("bins", lambda v: v >= F.col("region1")))
    start = own.select(
        *by, "region1",
        F.coalesce(F.try_element_at("from", F.lit(1)), F.col("after")).alias("start"),
        (F.col("shift") + F.size("bins") - F.size("from") + 1).cast("bigint").alias("start_at"),
    ).filter("start IS NOT NULL")
    present = seen.filter("region2 >= region1")
    numbered = join_spread(present, bins, [*by, "region2"], "inner", null_safe=True)
    # A row before the first cell and one behind the last stand for the ends of a bin's line.
    bounded = join_null_safe(start, ends, by)
    marks = [
        numbered.select(*by, "region1", "at", "before", "after"),
        bounded.select(*by, "region1", (F.col("start_at") - 1).alias("at"), F.lit(None).cast("bigint").alias("before"), F.col("start").alias("after")),
        bounded.select(*by, "region1", (F.col("last_at") + 1).alias("at"), F.col("last").alias("before"), F.lit(None).cast("bigint").alias("after")),
    ]
    line = Window.partitionBy(*by, "region1").orderBy("at")
    stacked = reduce(lambda a, b: a.unionByName(b), marks)
    runs = stacked.select(
        *by, "region1", F.lag("after").over(line).alias("first_missing"), F.col("before").alias("last_missing"),
        (F.col("at") - F.lag("at").over(line) - 1).alias("cells"),
    )
    return runs.filter("cells > 0")


def cells_of_runs(pixels: DataFrame, runs: DataFrame, by: Sequence[str] = ("chr",)) -> DataFrame:
    """The missing cells of some runs, one row each; meant for the runs of chosen bins."""
    bins = pixels.select(*by, "region2").distinct()
    blocked = bins.groupBy(*by, F.floor(F.col("region2") / BIN_BLOCK).alias("block")).agg(F.collect_set("region2").alias("bins"))
    steps = F.sequence(F.floor(F.col("first_missing") / BIN_BLOCK), F.floor(F.col("last_missing") / BIN_BLOCK))
    parts = runs.withColumn("block", F.explode(steps))
    inside = F.filter("bins", lambda v: v.between(F.col("first_missing"), F.col("last_missing")))
    return join_null_safe(parts, blocked, [*by, "block"]).select(*by, "region1", F.explode(inside).alias("region2"))
