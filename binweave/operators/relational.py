"""Filters, joins, grids, group-relative values and unions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binweave.functions.text import GRID_TITLE, fill
from binweave.scratch import cut

HOT_ROWS = 10_000_000  # rows of one key above which a join salts the key
HOT_KEYS = 10_000  # bound of the list of salted keys, which is broadcast
BROADCAST_ROWS = 100_000  # rows up to which a counted table is broadcast
BROADCAST_BYTES = 64 << 20  # and bytes, by the length of texts and nested values
NULL_PARTS = 1024  # parts over which rows with a missing key are spread
BIN_BLOCK = 1024  # bins per block when a grid is built
NUMBER_BLOCK = 65_536  # values per block when rows are numbered


# --- joins -----------------------------------------------------------------


def join_null_safe(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join in which a missing key value matches a missing one."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    )
    return left.join(other, same, how).drop(*[f"_right_{k}" for k in keys])


def join_spread(
    big: DataFrame,
    unique: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    counted: str | None = None,
    null_safe: bool = False,
) -> DataFrame:
    """Join ``big`` to a side holding one row per key, when a key may hold much of ``big``.

    A key with more than ``hot_rows`` rows is salted over as many parts as it
    holds that number; the other side repeats the row of such a key once per
    part.  The limit rises with the table so that at most ``HOT_KEYS`` keys are
    hot, which bounds the list of them that is broadcast.  Rows are salted at random from
    a fixed seed, so equal rows part as well.  ``counted`` names a column of ``unique`` that
    already holds the rows of each key; without it they are counted in a pass of their own.
    A missing key matches a missing one if ``null_safe``, else nothing, and is spread freely.
    """
    if counted:
        counts = unique.select(*keys, F.col(counted).alias("_n"))
        unique = unique.drop(counted)
    else:
        counts = big.groupBy(*keys).agg(F.count("*").alias("_n"))
    limit = F.greatest(F.lit(hot_rows), F.ceil(counts.agg(F.sum("_n")).scalar() / HOT_KEYS))
    hot = counts.filter(F.col("_n") > limit).select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_parts"))
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    spread = F.floor(F.rand(7) * F.coalesce(F.col("_parts"), F.lit(1)))
    if not null_safe:
        spread = F.when(missing, F.floor(F.rand(7) * NULL_PARTS)).otherwise(spread)
    join = join_null_safe if null_safe else lambda a, b, k, h: a.join(b, list(k), h)
    salted = join(big, F.broadcast(hot), keys, "left").withColumn("_salt", spread.cast("int")).drop("_parts")
    parts = F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)
    repeated = join(unique, F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(parts)).drop("_parts")
    return join(salted, repeated, [*keys, "_salt"], how).drop("_salt")


def _row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: texts and nested values by their length, all else as 8."""
    sizes = [F.lit(8 * len(df.columns))]
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind in ("string", "binary"):
            sizes.append(F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0)))
        elif kind in ("array", "map", "struct"):
            sizes.append(F.octet_length(F.to_json(F.struct(F.col(f"`{field.name}`")))))
    return reduce(lambda a, b: a + b, sizes)


def join_checked(
    big: DataFrame,
    unique: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    broadcast_rows: int = BROADCAST_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
    null_safe: bool = False,
) -> DataFrame:
    """Join to a side that is usually small, after looking at its size.

    The side is written first, so that measuring it costs next to nothing.  Up to
    ``broadcast_rows`` rows of ``broadcast_bytes`` in all it is broadcast, beyond that joined by
    ``join_spread``.  A missing key matches a missing one if ``null_safe``, else nothing.
    """
    written = cut(unique, "unique")
    rows, size = written.limit(broadcast_rows + 1).agg(F.count("*"), F.coalesce(F.sum(_row_bytes(written)), F.lit(0))).first()
    if rows <= broadcast_rows and size <= broadcast_bytes:
        if null_safe:
            return join_null_safe(big, F.broadcast(written), keys, how)
        return big.join(F.broadcast(written), list(keys), how)
    return join_spread(big, written, keys, how, null_safe=null_safe)


def rows_for_keys(
    rows: DataFrame, wanted: DataFrame, keys: Sequence[str], keep_missing: bool = False
) -> DataFrame:
    """Rows whose key is wanted; ``keep_missing`` adds a row of NULLs for a key without any."""
    distinct = wanted.select(*keys).distinct()
    found = join_spread(rows, distinct, keys, "left_semi")
    if not keep_missing:
        return found
    absent = distinct.join(rows.select(*keys).distinct(), list(keys), "left_anti")
    return found.unionByName(absent, allowMissingColumns=True)


# --- filters ---------------------------------------------------------------


def strictly_between(columns: Sequence[str], low: float, high: float) -> Column:
    """low < column < high for each column."""
    return reduce(
        lambda a, b: a & b, [(F.col(c) > low) & (F.col(c) < high) for c in columns]
    )


def window(df: DataFrame, greatest: int | None = None) -> DataFrame:
    """Pixels with both bins at or below ``greatest``; all of them for None."""
    if greatest is None:
        return df
    return df.filter((F.col("region1") <= greatest) & (F.col("region2") <= greatest))


def keys_by_rank(df: DataFrame, keys: Sequence[str], ranks: Sequence[int]) -> DataFrame:
    """The distinct keys standing at the given ranks (from 1) in key order.

    The sort keeps the top ``max(ranks)`` keys per task, so the ranking itself
    runs over that many rows.
    """
    top = df.select(*keys).distinct().orderBy(*keys).limit(max(ranks))
    numbered = top.withColumn("_rank", F.row_number().over(Window.orderBy(*keys)))
    return numbered.filter(F.col("_rank").isin(list(ranks))).drop("_rank")


def rows_of_ranked_keys(
    df: DataFrame, keys: Sequence[str], ranks: Sequence[int]
) -> DataFrame:
    """Rows of the keys at the given ranks; at most ``len(ranks)`` keys are broadcast."""
    chosen = F.broadcast(keys_by_rank(df, keys, ranks))
    return join_null_safe(df, chosen, keys, "left_semi")


def above_subset_max(df: DataFrame, column: str, subset: Column, by: Sequence[str] = ()) -> DataFrame:
    """Rows above the greatest value ``column`` takes where ``subset`` holds, in all or by group."""
    if by:
        limits = df.filter(subset).groupBy(*by).agg(F.max(column).alias("_limit"))
        # One row per group, so that all rows of a large group stay where they are.
        return join_checked(df, limits, by, "inner", null_safe=True).filter(F.col(column) > F.col("_limit")).drop("_limit")
    limit = df.filter(subset).agg(F.max(column)).scalar()
    return df.filter(F.col(column) > limit)


def index_shift(pixels: DataFrame) -> DataFrame:
    """``i, j``: region2 and region1 counted from the least bin of their chromosome, from 1."""
    least = pixels.groupBy("chr").agg(F.least(F.min("region1"), F.min("region2")).alias("_least"))
    return join_checked(pixels, least, ["chr"], "inner", null_safe=True).withColumns(
        {"i": F.col("region2") - F.col("_least") + 1, "j": F.col("region1") - F.col("_least") + 1}
    ).drop("_least")


def inside_extents(df: DataFrame, extents: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Rows strictly inside one-row extents; ``columns`` maps a column to its extent's name."""
    parts = []
    for column, name in columns.items():
        parts.append(F.col(column) > extents.select(f"{name}_min").scalar())
        parts.append(F.col(column) < extents.select(f"{name}_max").scalar())
    return df.filter(reduce(lambda a, b: a & b, parts))


# --- grid ------------------------------------------------------------------


def _seconds(pixels: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct region2 values in arrays of one block each."""
    return (
        pixels.select(*by, "region2")
        .distinct()
        .groupBy(*by, F.floor(F.col("region2") / BIN_BLOCK).alias("block"))
        .agg(F.sort_array(F.collect_set("region2")).alias("others"))
    )


def _grid_blocks(pixels: DataFrame, max_distance: int, by: Sequence[str]) -> DataFrame:
    """Grid cells as one row per (by, region1, block of region2), with the cells as an array.

    Only bins are shuffled, never cells: a row carries at most BIN_BLOCK of them.
    """
    first = F.col("region1")
    firsts = pixels.select(*by, "region1").distinct()
    blocks = F.sequence(F.floor(first / BIN_BLOCK), F.floor((first + max_distance) / BIN_BLOCK))
    steps = firsts.select(*by, "region1", F.explode(blocks).alias("block"))
    return join_null_safe(steps, _seconds(pixels, by), [*by, "block"]).select(
        *by, "region1", "block", F.filter("others", lambda v: v.between(first, first + max_distance)).alias("cells")
    )


def _distance(pixels: DataFrame, max_distance: int | None, whole: bool) -> int:
    """The distance given, or the longest there is for a whole triangle that is asked for."""
    if max_distance is not None:
        return max_distance
    if not whole:
        raise ValueError("give max_distance; whole=True lists the whole triangle, which is quadratic in bins")
    return pixels.agg(F.coalesce(F.max("region2") - F.min("region1"), F.lit(0)).alias("d")).first()["d"]


def grid(
    pixels: DataFrame, max_distance: int | None = None, by: Sequence[str] = ("chr",), whole: bool = False
) -> DataFrame:
    """Every (region1, region2) made of bins seen on either axis, region1 <= region2.

    ``max_distance`` bounds region2 - region1; ``whole`` asks for the whole triangle instead.
    """
    return _grid_blocks(pixels, _distance(pixels, max_distance, whole), by).select(
        *by, "region1", F.explode("cells").alias("region2")
    )


def missing_pixels(
    pixels: DataFrame, max_distance: int | None = None, by: Sequence[str] = ("chr",), whole: bool = False
) -> DataFrame:
    """Grid cells without a pixel.

    Pixels are gathered per (by, region1, block), at most BIN_BLOCK cells each,
    and taken off the grid's array; cells that are present are never rows.
    """
    present = pixels.groupBy(
        *by, "region1", F.floor(F.col("region2") / BIN_BLOCK).alias("block")
    ).agg(F.collect_set("region2").alias("present"))
    cells = _grid_blocks(pixels, _distance(pixels, max_distance, whole), by)
    both = join_null_safe(cells, present, [*by, "region1", "block"], "left")
    none = F.array().cast("array<bigint>")
    absent = F.array_except("cells", F.coalesce(F.col("present"), none))
    return both.select(*by, "region1", F.explode(absent).alias("region2"))


def grid_with_pixels(
    pixels: DataFrame, max_distance: int | None = None, by: Sequence[str] = ("chr",), whole: bool = False
) -> DataFrame:
    """Every grid cell with its pixel, or NULLs where it has none.

    A pixel's bins are grid bins by definition, so the cells that have one are the pixels
    themselves and only the missing ones are added; no cell is shuffled.
    """
    inside = F.col("region1") <= F.col("region2")
    if max_distance is not None:
        inside &= F.col("region2") <= F.col("region1") + max_distance
    absent = missing_pixels(pixels, max_distance, by, whole)
    return pixels.filter(inside).unionByName(absent, allowMissingColumns=True)


def grid_sizes(pixels: DataFrame, by: Sequence[str] = ("chr",)) -> DataFrame:
    """Cells of the whole triangle per region1, counted without building one.

    A region1 has the region2 values from it on: those in its own block of bins, and the sum
    over all later blocks, which is a running sum over one row per block.
    """
    firsts = pixels.select(*by, "region1").distinct().withColumn("block", F.floor(F.col("region1") / BIN_BLOCK))
    seconds = _seconds(pixels, by)
    number = seconds.select(*by, "block", F.size("others").alias("n"))
    blocks = number.unionByName(firsts.select(*by, "block").distinct().withColumn("n", F.lit(0)))
    later = Window.partitionBy(*by).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy(*by, "block").agg(F.sum("n").alias("n")).select(
        *by, "block", F.coalesce(F.sum("n").over(later), F.lit(0)).alias("later")
    )
    met = join_null_safe(join_null_safe(firsts, sums, [*by, "block"]), seconds, [*by, "block"], "left")
    own = F.coalesce(F.size(F.filter("others", lambda v: v >= F.col("region1"))), F.lit(0))
    own = F.when(F.col("others").isNull(), 0).otherwise(own)
    return met.select(*by, "region1", (own + F.col("later")).cast("bigint").alias("cells")).filter("cells > 0")


def grid_counts(pixels: DataFrame, by: Sequence[str] = ("chr",), max_distance: int | None = None) -> DataFrame:
    """Missing and possible pixels, one row: of the whole triangle, or up to a distance."""
    inside = F.col("region1") <= F.col("region2")
    if max_distance is None:
        sizes = grid_sizes(pixels, by)
    else:
        sizes = _grid_blocks(pixels, max_distance, by).select(F.size("cells").alias("cells"))
        inside &= F.col("region2") <= F.col("region1") + max_distance
    possible = sizes.agg(F.coalesce(F.sum("cells"), F.lit(0)).cast("bigint").alias("possible"))
    present = (
        pixels.filter(inside)
        .select(*by, "region1", "region2")
        .distinct()
        .agg(F.count("*").alias("present"))
    )
    missing = F.col("possible") - present.scalar()
    return possible.select(missing.alias("missing"), "possible").withColumn(
        "title",
        fill(GRID_TITLE, F.col("missing"), F.col("possible")),
    )


# --- values relative to a group ---------------------------------------------


def relative_to_least(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``rel_<c>`` = c minus the least c of the group.

    An aggregate and a join rather than a window, so that a group holding a
    large share of the rows is not sorted in one task.
    """
    least = df.groupBy(*keys).agg(F.count("*").alias("_rows"), *[F.min(c).alias(f"_least_{c}") for c in columns])
    joined = join_spread(df, least, keys, "inner", hot_rows, "_rows", null_safe=True)
    return joined.withColumns(
        {f"rel_{c}": F.col(c) - F.col(f"_least_{c}") for c in columns}
    ).drop(*[f"_least_{c}" for c in columns])


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The least row of each group in the given order, by a partial aggregate."""
    rest = [c for c in order] + [c for c in df.columns if c not in {*keys, *order}]
    least = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_first"))
    return least.select(*keys, "_first.*").select(*df.columns)


def rows_of_first_id(
    df: DataFrame, keys: Sequence[str], id_column: str = "id", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Rows carrying the least id of their group."""
    least = df.groupBy(*keys).agg(F.count("*").alias("_rows"), F.min(id_column).alias("_first_id"))
    joined = join_spread(df, least, keys, "inner", hot_rows, "_rows", null_safe=True)
    return joined.filter(F.col(id_column) == F.col("_first_id")).drop("_first_id")


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    name: str = "rel_row",
    block: int = NUMBER_BLOCK,
) -> DataFrame:
    """1..N within each group by a whole-number column that is unique in the group.

    Numbers are given within blocks of ``order`` and shifted by the sizes of the
    blocks before; uniqueness bounds a block by its width, however large the group.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    sizes = blocked.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    earlier = (
        Window.partitionBy(*keys)
        .orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = sizes.select(
        *keys, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift")
    )
    here = Window.partitionBy(*keys, "_block").orderBy(order)
    joined = join_null_safe(
        blocked.withColumn(name, F.row_number().over(here)), shifts, [*keys, "_block"]
    )
    return joined.withColumn(name, F.col(name) + F.col("_shift")).drop("_block", "_shift")


# --- unions ----------------------------------------------------------------


def tagged_union(tables: Mapping[str, DataFrame], tag: str = "data_type") -> DataFrame:
    """Tables stacked under a column that names each; absent columns are NULL."""
    marked = [df.withColumn(tag, F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    """Names of the columns matching a regular expression."""
    return df.select(df.colRegex(f"`.*{pattern}.*`")).columns
