"""Summaries of pixels: tiles, volcano bins, clusters, profiles, histograms.

Every summary is a ``groupBy`` with partial aggregation, so a key holding a
large share of the rows is reduced before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binweave.functions.numeric import (
    bin_by_count,
    bin_by_width,
    half_even,
    log10_full,
    log2_full,
    neg_log10,
    signed_neg_log10,
)
from binweave.functions.text import (
    CLUSTER_LABEL,
    CLUSTER_LINE,
    CORNERS_PART,
    LOG2_SIZE_NAME,
    LOG_LOG_NAME,
    ROWS_LINE,
    SIZE_NAME,
    VOLCANO_NAME,
    fill,
    fixed_text,
    one_decimal,
    volcano_text,
)
from binweave.operators.boundary import vertices
from binweave.operators.geometry import TILE
from binweave.operators.relational import (
    above_subset_max,
    first_rows,
    join_null_safe,
    number_rows,
)
from binweave.scratch import cut

# Widths of the volcano and size bins, bins per unit of the
# coarser volcano, and corner rows drawn per pixel.
LOGFC_WIDTH = 0.25
NEG_LOG10_P_WIDTH = 5.0
LOG_LOG_P_WIDTH = 0.1
SIZE_WIDTH = 0.25
LOGFC_PER_UNIT = 4.0
CORNERS_PER_PIXEL = 5
REPRESENTATIONS = ("cluster", "simplified", "pixel")


def with_p(pixels: DataFrame) -> DataFrame:
    """``neg_log10_p`` and its signed form."""
    return pixels.withColumns(
        {
            "neg_log10_p": neg_log10(F.col("p_value")),
            "sign_neg_log10_p": signed_neg_log10(F.col("logfc"), F.col("p_value")),
        }
    )


# --- generic aggregates ------------------------------------------------------


def count_of_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many keys have 1, 2, ... rows; a table with unique keys gives one row."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("rows"))
    return sizes.groupBy("rows").agg(F.count("*").alias("keys"))


def multi_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    functions: Mapping[str, Callable[[str], Column]],
    columns: Sequence[str],
) -> DataFrame:
    """Each function over each column, named ``<column>_<function>``.

    A function takes a column name and returns an aggregate Column, built in or
    composed by the user.
    """
    aggs = [f(c).alias(f"{c}_{name}") for name, f in functions.items() for c in columns]
    return df.groupBy(*keys).agg(*aggs)


def group_apply(
    df: DataFrame, keys: Sequence[str], function: Callable[[pa.Table], pa.Table], schema: str, most_rows: int
) -> DataFrame:
    """``function`` over the rows of each group, for what no built-in aggregate can say.

    A group is held in one task, so ``most_rows`` states how large one may be: a larger one is
    an error, found by counting before any rows are gathered.  NULL keys are a group.
    """
    largest = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()["n"] or 0
    if largest > most_rows:
        raise ValueError(f"a group of {largest} rows; at most {most_rows} are handled")
    return df.groupBy(*keys).applyInArrow(function, schema)


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Least, greatest and number of distinct values of each column, one row per column.

    One pass over the rows; distinct values are counted through an aggregate on
    (column, value), so no task holds them all.
    """
    kinds = dict(df.dtypes)

    def entry(c: str) -> Column:
        text = kinds[c] == "string"
        # Values are told apart in their own type; only the extremes are shown as doubles.
        own = F.col(c) + F.lit(0.0) if kinds[c] in ("double", "float") else F.col(c)
        return F.struct(
            F.lit(c).alias("column"),
            own.cast("string").alias("own"),
            (F.lit(None) if text else F.col(c)).cast("double").alias("value"),
        )

    long = df.select(F.inline(F.array(*[entry(c) for c in columns])))
    values = long.groupBy("column", "own").agg(F.min("value").alias("value"))
    is_text = F.col("column").isin([c for c in columns if kinds[c] == "string"])
    return values.groupBy("column").agg(
        F.min("value").alias("least"),
        F.max("value").alias("greatest"),
        F.min(F.when(is_text, F.col("own"))).alias("least_text"),
        F.max(F.when(is_text, F.col("own"))).alias("greatest_text"),
        F.count("*").alias("values"),
    )


def histogram(df: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """Counts in equal bins between the extremes; a bin holds its upper edge, the first both.

    Without ``bins`` their number follows from the count of values and edges are round numbers:
    the width is the least of 1, 2 or 5 times a power of ten with which the range takes no more
    than 1 + log2(count) bins.
    """
    v = F.col(column)
    known = df.filter(v.isNotNull())
    low = df.agg(F.min(column)).scalar()
    high = df.agg(F.max(column)).scalar()
    if bins is None:
        width = _round_width(low, high, df.agg(F.count(column)).scalar())
        start = F.floor(low / width)
        number = F.greatest(F.ceil(v / width) - start, F.lit(1))
        edge = lambda n: (start + n) * width
    else:
        width = (high - low) / F.lit(float(bins))
        at = F.ceil((v - low) / width)
        # All values equal: one bin of no width.
        number = F.when(high == low, F.lit(1)).otherwise(F.least(F.greatest(at, F.lit(1)), F.lit(bins)))
        edge = lambda n: low + n * width
    counts = known.groupBy(number.cast("int").alias("bin")).agg(F.count("*").alias("count"))
    return counts.select("bin", edge(F.col("bin") - 1).alias("lower"), edge(F.col("bin")).alias("upper"), "count")


def _round_width(low: Column, high: Column, count: Column) -> Column:
    """Width of the bins of a histogram whose number is not given; 1 if all values are equal."""
    least = (high - low) / (F.ceil(F.log2(count)) + 1)
    power = F.pow(F.lit(10.0), F.floor(F.log10(least)))
    times = least / power
    step = F.when(times <= 1, 1.0).when(times <= 2, 2.0).when(times <= 5, 5.0).otherwise(10.0)
    return F.when(high == low, F.lit(1.0)).otherwise(step * power)


def distinct_sketches(df: DataFrame, keys: Sequence[str], column: str, lg: int = 12) -> DataFrame:
    """A mergeable sketch of the distinct values of ``column`` for each group, to be stored.

    A sketch has at most 2**lg registers; ``distinct_estimate`` unites those of any selection of
    groups without reading their rows again.  NULLs are no value.
    """
    return df.groupBy(*keys).agg(F.hll_sketch_agg(F.col(column).cast("string"), lg).alias("sketch"))


def distinct_estimate(sketches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Approximate number of distinct values of the united groups, in all or by some of their keys."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))


def midpoint_intervals(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """Interval around each distinct value, bounded half way to its neighbours.

    Outer bounds lie as far out as the inner ones.  Without ``by``, the distinct values are
    dealt to ranges and written; neighbours are found within a range, and those across the edge
    of one from the least and greatest value of every range, an array with an entry per partition.
    """
    keys = [by] if by else []
    distinct = df.select(*keys, column).distinct()
    if by:
        order = Window.partitionBy(by).orderBy(column)
        before, after = F.lag(column).over(order), F.lead(column).over(order)
    else:
        distinct = cut(distinct.repartitionByRange(column).withColumn("_part", F.spark_partition_id()), "ranged")
        edges = distinct.groupBy("_part").agg(F.min(column).alias("low"), F.max(column).alias("high"))
        every = edges.agg(F.sort_array(F.array_agg(F.struct("_part", "low", "high")))).scalar()
        distinct = distinct.withColumn("_edges", every)
        order = Window.partitionBy("_part").orderBy(column)
        earlier = F.filter("_edges", lambda e: e["_part"] < F.col("_part"))
        later = F.filter("_edges", lambda e: e["_part"] > F.col("_part"))
        before = F.coalesce(F.lag(column).over(order), F.try_element_at(earlier, F.lit(-1))["high"])
        after = F.coalesce(F.lead(column).over(order), F.try_element_at(later, F.lit(1))["low"])
    near = distinct.withColumns({"_before": before, "_after": after})
    v, before, after = F.col(column), F.col("_before"), F.col("_after")
    left = F.coalesce((v - before) / 2.0, (after - v) / 2.0, F.lit(0.0))
    right = F.coalesce((after - v) / 2.0, (v - before) / 2.0, F.lit(0.0))
    return near.select(*keys, column, (v - left).alias("lower"), (v + right).alias("upper"))


def presence_crosstab(pixels: DataFrame, low: int, high: int) -> DataFrame:
    """Pixels by chr and region1 (rows) and region2 (columns) for low < bin < high, 0 where absent."""
    inner = pixels.filter(
        (F.col("region1") > low)
        & (F.col("region1") < high)
        & (F.col("region2") > low)
        & (F.col("region2") < high)
    )
    wide = inner.groupBy("chr", "region1").pivot("region2", list(range(low + 1, high))).count()
    return wide.na.fill(0)


# --- tiles -------------------------------------------------------------------


def cluster_tiles(tiled: DataFrame, keys: Sequence[str] = ("chr", *TILE)) -> DataFrame:
    """One row per cluster and tile, from which tile and cluster summaries both follow.

    The only pass over the pixels: means are kept as sums and counts, and
    counting rows here replaces counting distinct values there.
    """
    measures = ("logfc", "neg_log10_p")
    aggs = [F.count("*").alias("displayed_pixels")]
    for c in measures:
        aggs += [
            F.sum(c).alias(f"{c}_sum"),
            F.count(c).alias(f"{c}_n"),
            F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"),
        ]
    return tiled.groupBy(*keys, "clust").agg(*aggs)


def summarize_tiles(cells: DataFrame, keys: Sequence[str] = ("chr", *TILE)) -> DataFrame:
    """Tile summary from ``cluster_tiles``."""
    return cells.groupBy(*keys).agg(
        F.sum("displayed_pixels").alias("pixels"),
        (F.sum("displayed_pixels") * CORNERS_PER_PIXEL).alias("corner_rows"),
        F.try_divide(F.sum("neg_log10_p_sum"), F.sum("neg_log10_p_n")).alias("mean_neg_log10_p"),
        F.try_divide(F.sum("logfc_sum"), F.sum("logfc_n")).alias("mean_logfc"),
        F.count("*").alias("clusters"),
    )


def tile_summary(pixels: DataFrame, keys: Sequence[str] = ("chr", *TILE)) -> DataFrame:
    """Pixels, means and distinct clusters per tile, from pixels and not from corners."""
    return summarize_tiles(cluster_tiles(pixels, keys), keys)


# --- volcano -----------------------------------------------------------------


def volcano_bins(
    pixels: DataFrame,
    logfc_width: float = LOGFC_WIDTH,
    p_width: float = NEG_LOG10_P_WIDTH,
    log_log_width: float = LOG_LOG_P_WIDTH,
) -> DataFrame:
    """Volcano bin of each pixel, plain and on log-log p, with its place inside."""
    df = pixels.withColumn("lnl_p", log10_full(F.col("neg_log10_p")))
    df = df.withColumns(
        {
            "round_logfc": bin_by_width(F.col("logfc"), logfc_width),
            "round_neg_log10_p": bin_by_width(F.col("neg_log10_p"), p_width),
            "round_lnl_p": bin_by_width(F.col("lnl_p"), log_log_width),
        }
    )
    return _volcano_names(df).withColumns(
        {
            "lnl_bin": volcano_text(F.col("round_logfc"), F.col("round_lnl_p"), LOG_LOG_NAME),
            "relative_lnl_p": F.col("lnl_p") - F.col("round_lnl_p"),
        }
    )


def coarse_volcano_bins(
    pixels: DataFrame, per_unit: float = LOGFC_PER_UNIT, p_per_unit: float = 1.0
) -> DataFrame:
    """Volcano bins by count per unit of the fold change and of -log10 p."""
    return _volcano_names(
        pixels.withColumns(
            {
                "round_logfc": bin_by_count(F.col("logfc"), per_unit),
                "round_neg_log10_p": bin_by_count(F.col("neg_log10_p"), p_per_unit),
            }
        )
    )


def _volcano_names(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "volcano_bin": volcano_text(F.col("round_logfc"), F.col("round_neg_log10_p")),
            "relative_logfc": F.col("logfc") - F.col("round_logfc"),
            "relative_neg_log10_p": F.col("neg_log10_p") - F.col("round_neg_log10_p"),
        }
    )


def volcano_heat(
    binned: DataFrame, keys: Sequence[str] = ("chr",), p: str = "round_neg_log10_p"
) -> DataFrame:
    """Pixels per volcano bin, and the log10 of that for colour and label.

    Grouped on the numbers; the name is put back from the two of them.
    """
    name = ("lnl_bin", LOG_LOG_NAME) if p == "round_lnl_p" else ("volcano_bin", VOLCANO_NAME)
    counts = binned.groupBy(*keys, "round_logfc", p).agg(F.count("*").alias("pixels"))
    return counts.withColumns(
        {
            name[0]: volcano_text(F.col("round_logfc"), F.col(p), name[1]),
            "log10_pixels": F.log10("pixels"),
            "heat_label": half_even(F.log10("pixels")),
        }
    )


def rounded_heat(pixels: DataFrame, keys: Sequence[str] = ("chr",)) -> DataFrame:
    """log10 of the pixels per whole (logFC, -log10 p)."""
    return pixels.groupBy(
        *keys,
        half_even(F.col("neg_log10_p")).alias("round_neg_log10_p"),
        half_even(F.col("logfc")).alias("round_logfc"),
    ).agg(F.log10(F.count("*")).alias("log10_pixels"))


def color_scale(binned: DataFrame, per_unit: float = LOGFC_PER_UNIT) -> DataFrame:
    """Signed p bins above all bins at no fold change, and where to draw each.

    One scale for all chromosomes of ``binned``, so that a colour means the same on each.
    """
    above = above_subset_max(binned, "round_neg_log10_p", F.col("round_logfc") == 0)
    signed = F.signum("logfc") * F.col("round_neg_log10_p") + F.lit(0.0)
    keys = above.select(signed.alias("sign_round_neg_log10_p")).distinct()
    sign = F.signum("sign_round_neg_log10_p")
    return keys.withColumns(
        {
            "logfc": sign / F.lit(per_unit) / F.lit(4.0) + F.lit(0.0),
            "height": F.abs("sign_round_neg_log10_p"),
        }
    ).orderBy("sign_round_neg_log10_p")


def most_significant(pixels: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` of the most significant pixel; the least chromosome and bins win ties.  One row."""
    order = F.struct((-F.col("neg_log10_p")).alias("p"), "chr", "region1", "region2")
    return pixels.agg(F.min_by(F.struct(*columns), order).alias("best")).select("best.*")


# --- clusters ----------------------------------------------------------------


def summarize_clusters(cells: DataFrame, keys: Sequence[str] = ("chr", "clust")) -> DataFrame:
    """Pixels, tiles and value ranges per cluster, from ``cluster_tiles``."""
    return cells.groupBy(*keys).agg(
        F.sum("displayed_pixels").alias("pixels"),
        F.count("*").alias("tiles"),
        F.min("logfc_min").alias("logfc_min"),
        F.max("logfc_max").alias("logfc_max"),
        F.min("neg_log10_p_min").alias("neg_log10_p_min"),
        F.max("neg_log10_p_max").alias("neg_log10_p_max"),
    )


def cluster_sizes(tiled: DataFrame) -> DataFrame:
    """Pixels, tiles and value ranges per cluster, straight from tiled pixels."""
    return summarize_clusters(cluster_tiles(tiled))


def size_bins(sizes: DataFrame, log2_tiles: bool = False, width: float = SIZE_WIDTH) -> DataFrame:
    """Size bin of each cluster, by tiles (plain or log2) and log10 pixels."""
    df = sizes.withColumn("log10_pixels", log10_full(F.col("pixels")))
    df = df.withColumn("round_log10_pixels", bin_by_width(F.col("log10_pixels"), width))
    df = df.withColumn("rel_log10_pixels", F.col("log10_pixels") - F.col("round_log10_pixels"))
    if log2_tiles:
        df = df.withColumn("log2_tiles", log2_full(F.col("tiles")))
        df = df.withColumn("round_tiles", bin_by_width(F.col("log2_tiles"), width))
        df = df.withColumn("rel_log2_tiles", F.col("log2_tiles") - F.col("round_tiles"))
    else:
        df = df.withColumn("round_tiles", F.col("tiles").cast("double"))
    return df.withColumn("size_bin", size_text(log2_tiles))


def size_text(log2_tiles: bool = False) -> Column:
    """Name of a size bin."""
    return fill(
        LOG2_SIZE_NAME if log2_tiles else SIZE_NAME,
        fixed_text(F.col("round_tiles")),
        fixed_text(F.col("round_log10_pixels")),
    )


def size_heat(
    binned_sizes: DataFrame, log2_tiles: bool = False, keys: Sequence[str] = ("chr",)
) -> DataFrame:
    """Clusters per size bin, grouped on the numbers and named afterwards."""
    counts = binned_sizes.groupBy(*keys, "round_tiles", "round_log10_pixels").agg(
        F.count("*").alias("clusters")
    )
    return counts.withColumns(
        {"size_bin": size_text(log2_tiles), "log10_clusters": F.log10("clusters")}
    )


def size_points(binned_sizes: DataFrame, keys: Sequence[str] = ("chr",)) -> DataFrame:
    """Clusters numbered among those at the same place of the same size bin.

    The place is where log10 of the pixels lies in the bin, so equal pixels are the same place.
    """
    return number_rows(
        binned_sizes, [*keys, "round_tiles", "round_log10_pixels", "pixels"], "clust", "rel_row"
    )


def cluster_tile_labels(
    cells: DataFrame, sizes: DataFrame, anchor: DataFrame, keys: Sequence[str] = ("chr", "clust")
) -> DataFrame:
    """Label of each cluster in each of its tiles: displayed and total pixels, value ranges.

    ``cells`` comes from ``cluster_tiles``.  The value texts depend on the
    cluster alone, so they are formatted once per cluster and joined to its tiles.
    """
    ends = ("logfc_min", "logfc_max", "neg_log10_p_min", "neg_log10_p_max")
    ranges = sizes.select(*keys, "pixels", *[one_decimal(c).alias(c) for c in ends])
    label = fill(
        CLUSTER_LABEL, F.col("clust"), F.col("displayed_pixels"), F.col("pixels"), *[F.col(c) for c in ends]
    )
    displayed = cells.select(*keys, *TILE, "displayed_pixels")
    return join_null_safe(displayed, ranges, keys).select(
        *keys,
        *TILE,
        "displayed_pixels",
        label.alias("label"),
        anchor.select("rel_x").scalar().alias("rel_x"),
        anchor.select("rel_y").scalar().alias("rel_y"),
    )


def representation_sizes(
    pixels: DataFrame, segs: DataFrame, keys: Sequence[str] = ("chr", "clust")
) -> DataFrame:
    """Per cluster: rows as outline, as simplified outline and as pixels, and its least bins."""
    ends = vertices(segs, keys).groupBy(*keys).agg(
        F.count("*").alias("cluster"), F.sum(F.col("keep").cast("bigint")).alias("simplified")
    )
    counts = pixels.groupBy(*keys).agg(
        F.count("*").alias("pixel"),
        F.min("region1").alias("region1"),
        F.min("region2").alias("region2"),
    )
    return join_null_safe(ends, counts, keys)


def representation_rows(sizes: DataFrame, keys: Sequence[str] = ("chr", "clust")) -> DataFrame:
    """The same counts, one row per cluster and representation."""
    return sizes.select(*keys, *REPRESENTATIONS).unpivot(
        list(keys), list(REPRESENTATIONS), "data_type", "rows"
    )


def representation_labels(sizes: DataFrame, keys: Sequence[str] = ("chr", "clust")) -> DataFrame:
    """Label of each cluster: a line per representation, and the corners of its pixels."""
    lines = [fill(CLUSTER_LINE, F.col("clust"))]
    lines += [fill(ROWS_LINE, F.lit(n), F.col(n)) for n in REPRESENTATIONS]
    corners = F.col("pixel") * 4
    label = F.concat(
        F.concat_ws("\n", *lines), fill(CORNERS_PART, corners)
    )
    return sizes.select(*keys, "region1", "region2", corners.alias("corners"), label.alias("label"))


def polygon_counts(polygons: DataFrame) -> DataFrame:
    """Rows, ids and rows per id at each number of clusters."""
    counts = polygons.groupBy("nb_clust").agg(
        F.count("*").alias("id_length"), F.count_distinct("id").alias("id_n_uniq")
    )
    return counts.withColumn("rows_per_id", F.col("id_length") / F.col("id_n_uniq"))


def first_polygon_extents(relative: DataFrame) -> DataFrame:
    """Extents of the relative coordinates of each polygon's first vertex, by level and tile."""
    first = first_rows(relative, ["nb_clust", "id"], ["x", "y", "iff"])
    return first.groupBy("nb_clust", "tile_id").agg(
        *[
            f(c).alias(f"{c}_{n}")
            for c in ("rel_x", "rel_y")
            for n, f in (("min", F.min), ("max", F.max))
        ]
    )
