"""Linked selections: which rows each view shows for the chosen values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binweave.functions.text import PIXELS_PART, fill
from binweave.operators.relational import join_checked
from binweave.operators.summaries import most_significant


def _is_set(value: Any) -> bool:
    return isinstance(value, (list, tuple, set, frozenset))


def shown(df: DataFrame, selection: Mapping[str, Any]) -> DataFrame:
    """Rows matching every selector.

    A selector is a value, a collection of values, or a DataFrame with the
    selector's column.  Values and collections become filters, which prune chunk
    folders and reach the scan; a DataFrame, for more values than the driver should
    hold, is semi-joined by its size.  Types are compared in the same way in all three:
    both sides are widened, so 1.5 equals no whole number.
    """
    for name, value in selection.items():
        if isinstance(value, DataFrame):
            df = join_checked(df, value.select(name).distinct(), [name], "left_semi")
        elif _is_set(value):
            df = df.filter(F.col(name).isin(list(value)))
        else:
            df = df.filter(F.col(name) == value)
    return df


def flag_selected(
    df: DataFrame, selection: Mapping[str, Any], flag: str = "selected"
) -> DataFrame:
    """All rows, with a flag on those the selection picks."""
    picked, marked = F.lit(True), []
    for name, value in selection.items():
        if isinstance(value, DataFrame):
            mark = f"_{name}_selected"
            marks = value.select(name).distinct().withColumn(mark, F.lit(True))
            df = join_checked(df, marks, [name], "left")
            picked = picked & F.coalesce(F.col(mark), F.lit(False))
            marked.append(mark)
        elif _is_set(value):
            picked = picked & F.coalesce(F.col(name).isin(list(value)), F.lit(False))
        else:
            picked = picked & F.col(name).eqNullSafe(F.lit(value))
    return df.withColumn(flag, picked).drop(*marked)


def diagonal_pixels(pixels: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` pixels on the diagonal, in order of chromosome and bin: a starting selection."""
    return pixels.filter("region1 = region2").orderBy("chr", "region1").limit(n)


def initial_selection(
    binned: DataFrame, local_tiles: DataFrame, tile_columns: Sequence[str]
) -> DataFrame:
    """Volcano bin and cluster of the most significant pixel and the cluster's first tile.

    One row.  ``local_tiles`` lists the tiles of each cluster; the first is the
    least in ``tile_columns`` order.
    """
    best = most_significant(binned, ["chr", "volcano_bin", "clust"])
    mine = local_tiles.join(F.broadcast(best), ["chr", "clust"])  # best is one row
    return mine.groupBy("chr", "clust", "volcano_bin").agg(
        F.min(F.struct(*tile_columns)).alias("first_tile")
    ).select("chr", "clust", "volcano_bin", "first_tile.*")


def tooltip(heat: DataFrame) -> DataFrame:
    """Text of a volcano bin with its pixels."""
    return heat.withColumn(
        "tooltip",
        F.concat("volcano_bin", fill(PIXELS_PART, F.col("pixels"))),
    )
