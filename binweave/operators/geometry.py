"""Rotation, corner expansion and tiling of pixels.

Everything here is a projection: no operator in this module shuffles, apart
from ``presence`` and the tile spacing, which aggregate, and ``restore_corners``, which joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binweave.functions.numeric import bin_by_count, bin_by_width, half_even, two_digits
from binweave.functions.text import plain_text, whole_text
from binweave.scratch import cut

# Half width of a drawn pixel and of a drawn tile, tile width in
# bins, and what is added to rotated coordinates before rounding to a tile.
PIXEL_HALF = 0.45
TILE_HALF = 45.0
TILE_WIDTH = 50.0
TILE_OFFSET = (20.0, -24.0)

BROADCAST_PLACES = 200_000  # places of a tile up to which its shape is broadcast

AXES = ("x", "y")
TILE = ("round_region_x", "round_region_y")


def rotate(df: DataFrame, prefix: str) -> DataFrame:
    """Rotate ``<prefix>1, <prefix>2`` by 45 degrees into ``<prefix>_x, <prefix>_y``.

    x is the position along the chromosome, y half the distance between the bins.
    """
    first, second = F.col(f"{prefix}1"), F.col(f"{prefix}2")
    return df.withColumns(
        {f"{prefix}_x": (first + second) / 2.0, f"{prefix}_y": (second - first) / 2.0}
    )


def corners(
    df: DataFrame,
    half: float = 0.5,
    closed: bool = False,
    center: tuple[str, str] = ("region1", "region2"),
) -> DataFrame:
    """One row per corner of each square, numbered by ``corner_ord``; rotated as well.

    ``closed`` repeats the first corner.  Project to the columns needed before
    calling this: every one of them is copied four or five times.
    """
    h = float(half)
    ring = [(-h, -h), (-h, h), (h, h), (h, -h)]
    if closed:
        ring.append(ring[0])
    points = F.array(
        *[
            F.struct(
                F.lit(n).alias("corner_ord"),
                (F.col(center[0]) + F.lit(a)).alias("corner1"),
                (F.col(center[1]) + F.lit(b)).alias("corner2"),
            )
            for n, (a, b) in enumerate(ring, start=1)
        ]
    )
    return rotate(df.select("*", F.inline(points)), "corner")


def tile(
    df: DataFrame,
    width: float = TILE_WIDTH,
    offset: tuple[float, float] = TILE_OFFSET,
    of: str = "region",
) -> DataFrame:
    """Tile of each rotated point and its position relative to the tile.

    The rounded coordinate keeps the offset; ``tile_center`` takes it off again.
    """
    new = {}
    for axis, off in zip(AXES, offset):
        at = F.col(f"{of}_{axis}")
        rounded = bin_by_width(at, width, off)
        new[f"round_region_{axis}"] = rounded
        new[f"rel_region_{axis}"] = at - rounded
    return df.withColumns(new)


def relative_corners(df: DataFrame) -> DataFrame:
    """Corner positions relative to the tile of their pixel, free of float noise."""
    return df.withColumns(
        {
            f"rel_corner_{a}": two_digits(F.col(f"corner_{a}") - F.col(f"round_region_{a}"))
            for a in AXES
        }
    )


def tile_name(df: DataFrame) -> DataFrame:
    """``round_regions``: the tile as text."""
    return df.withColumn(
        "round_regions", F.concat_ws(",", *[whole_text(F.col(c)) for c in TILE])
    )


def position_name(df: DataFrame) -> DataFrame:
    """``rel_regions``: the pixel's place in its tile as text."""
    return df.withColumn(
        "rel_regions",
        F.concat_ws(",", *[plain_text(F.col(f"rel_region_{a}")) for a in AXES]),
    )


def tiled_pixels(
    pixels: DataFrame,
    width: float = TILE_WIDTH,
    offset: tuple[float, float] = TILE_OFFSET,
) -> DataFrame:
    """Pixels with rotated coordinates and tile columns."""
    return tile(rotate(pixels, "region"), width, offset)


def tile_center(
    df: DataFrame, offset: tuple[float, float] = TILE_OFFSET
) -> DataFrame:
    """``x, y``: where the tile is drawn."""
    return df.withColumns(
        {
            axis: F.col(f"round_region_{axis}") - F.lit(off)
            for axis, off in zip(AXES, offset)
        }
    )


def axis_tile(df: DataFrame, width: float = 100.0) -> DataFrame:
    """Tile in the unrotated axes, with names for pixel and tile."""
    new = {}
    for n in ("1", "2"):
        rounded = bin_by_count(F.col(f"region{n}"), 1.0 / width)
        new[f"round_region{n}"] = rounded
        new[f"rel_region{n}"] = F.col(f"region{n}") - rounded
    return df.withColumns(new).withColumns(
        {
            "r1r2": F.concat_ws("-", F.col("region1").cast("string"), F.col("region2").cast("string")),
            "round_r1r2": F.concat_ws(
                "-", whole_text(F.col("round_region1")), whole_text(F.col("round_region2"))
            ),
            "rel_regions": F.concat_ws(
                ",", whole_text(F.col("rel_region1")), whole_text(F.col("rel_region2"))
            ),
        }
    )


def axis_relative_corners(corner_rows: DataFrame) -> DataFrame:
    """Corner positions relative to the rotated centre of their unrotated tile."""
    turned = rotate(corner_rows, "round_region")
    return turned.withColumns(
        {f"rel_{a}": F.col(f"corner_{a}") - F.col(f"round_region_{a}") for a in AXES}
    )


def tile_corners(tiles: DataFrame, half: float = TILE_HALF) -> DataFrame:
    """Closed ring around each unrotated tile."""
    return corners(tiles, half, closed=True, center=("round_region1", "round_region2"))


def tile_spacing(df: DataFrame, column: str = "round_region1", by: str = "chr") -> DataFrame:
    """Least gap between distinct tile positions, one row per ``by``.

    The window runs over distinct tile positions only, of which a chromosome
    has its length divided by the tile width.
    """
    steps = Window.partitionBy(by).orderBy(column)
    gaps = (
        df.select(by, column)
        .distinct()
        .select(by, (F.lead(column).over(steps) - F.col(column)).alias("gap"))
    )
    return gaps.groupBy(by).agg(F.min("gap").alias("spacing"))


def presence(df: DataFrame, keys: Sequence[str] = ("chr",)) -> DataFrame:
    """Distinct (tile, cluster)."""
    return df.select(*keys, *TILE, "clust").distinct()


def corner_extents(tiled: DataFrame, half: float = PIXEL_HALF) -> DataFrame:
    """Least and greatest relative corner coordinates, one row.

    A pixel's extreme corners are known from its centre, so the corner table is
    not built.
    """
    h = float(half)
    r1, r2 = F.col("region1"), F.col("region2")
    ends = {
        "x": (((r1 - h) + (r2 - h)) / 2.0, ((r1 + h) + (r2 + h)) / 2.0),
        "y": (((r2 - h) - (r1 + h)) / 2.0, ((r2 + h) - (r1 - h)) / 2.0),
    }
    aggs = []
    for axis, (low, high) in ends.items():
        base = F.col(f"round_region_{axis}")
        aggs.append(F.min(two_digits(low - base)).alias(f"rel_corner_{axis}_min"))
        aggs.append(F.max(two_digits(high - base)).alias(f"rel_corner_{axis}_max"))
    return tiled.agg(*aggs)


def relative_shape(tiled: DataFrame, half: float = PIXEL_HALF) -> DataFrame:
    """Relative corners of each place within a tile, the part all tiles share.

    Places are made distinct before they are expanded; a tile has at most
    2 * width**2 of them, whatever the number of pixels.
    """
    places = tiled.select("rel_region_x", "rel_region_y").distinct()
    h = float(half)
    ring = [(-h, -h), (-h, h), (h, h), (h, -h), (-h, -h)]
    points = F.array(
        *[
            F.struct(
                F.lit(n).alias("corner_ord"),
                two_digits(F.col("rel_region_x") + F.lit((a + b) / 2.0)).alias("rel_corner_x"),
                two_digits(F.col("rel_region_y") + F.lit((b - a) / 2.0)).alias("rel_corner_y"),
            )
            for n, (a, b) in enumerate(ring, start=1)
        ]
    )
    return places.select("*", F.inline(points))


def restore_corners(tiled: DataFrame, shape: DataFrame) -> DataFrame:
    """Corner rows from pixels and the shape their tiles share, broadcast after a look at its size.

    The shape is written first, so that looking at it doesn't derive it from all pixels again.
    """
    written = cut(shape, "shape")
    small = written.limit(BROADCAST_PLACES + 1).count() <= BROADCAST_PLACES
    return tiled.join(F.broadcast(written) if small else written, ["rel_region_x", "rel_region_y"])


def label_anchor(extents: DataFrame) -> DataFrame:
    """Where a tile's label stands: middle of the x extents, one above the y extents."""
    return extents.select(
        ((F.col("rel_corner_x_max") + F.col("rel_corner_x_min")) / 2.0).alias("rel_x"),
        (F.col("rel_corner_y_max") + 1.0).alias("rel_y"),
    )


def polygon_tiles(polygons: DataFrame, divisor: float = 10.0) -> DataFrame:
    """Tile of each polygon vertex: rounded coordinates and their text."""
    rounded = {f"round_{a}": half_even(F.col(a) / F.lit(float(divisor))) for a in AXES}
    return polygons.withColumns(rounded).withColumn(
        "tile_id", F.concat_ws(" ", whole_text(F.col("round_x")), whole_text(F.col("round_y")))
    )
