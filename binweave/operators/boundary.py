"""Outlines of groups of pixels, from the sparse pixel table.

A group (a cluster, or a cluster within a tile) is outlined half way between
its pixels and the empty cells around them, holes included.  The dense mask is
never built, so the work grows with the pixels and not with bounding boxes.

Coordinates are doubled inside this module: vertices lie on half bins, and
whole numbers make exact join keys.  x is region1 and y is region2.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binweave.operators.relational import join_null_safe

# Fixed values.  A dual cell is the square between four neighbouring bin
# centres; its code adds 1, 2, 4, 8 for a pixel at its lower left, lower right,
# upper left and upper right.  An outline crosses the cell from one side to
# another, pixels on its left.  Codes 6 and 9 are two pixels touching at a
# corner, where the outline may keep them apart or connect them.
CROSSINGS = {
    1: ["BL"],
    2: ["RB"],
    3: ["RL"],
    4: ["LT"],
    5: ["BT"],
    7: ["RT"],
    8: ["TR"],
    10: ["TB"],
    11: ["TL"],
    12: ["LR"],
    13: ["BR"],
    14: ["LB"],
    15: [],
}
SADDLES = {
    "separate": {6: ["RB", "LT"], 9: ["BL", "TR"]},
    "connect": {6: ["LB", "RT"], 9: ["BR", "TL"]},
}
BLOCK_CELLS = 7  # cells on a side of a block, whose 8 x 8 pixels are the bits of one number
SIDES = {"B": (1, 0), "L": (0, 1), "R": (2, 1), "T": (1, 2)}


def bounding_boxes(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bounding box of each group and the ones and zeros of its mask padded by one bin."""
    box = pixels.groupBy(*keys).agg(
        F.min("region1").alias("min1"),
        F.max("region1").alias("max1"),
        F.min("region2").alias("min2"),
        F.max("region2").alias("max2"),
        F.count_distinct("region1", "region2").alias("ones"),
    )
    area = (F.col("max1") - F.col("min1") + 3) * (F.col("max2") - F.col("min2") + 3)
    return box.withColumn("zeros", area - F.col("ones"))


def _block_places(bin: str, start: str, at: str) -> Column:
    """The blocks a bin's cells lie in: first cell of the block, place of the bin in it.

    The bin at a block's first cell ends the block before as well.  A missing bin has a block
    of its own, without a place.
    """
    r = F.col(bin)
    inside = F.pmod(r, F.lit(BLOCK_CELLS))
    place = lambda first, n: F.struct(first.alias(start), n.cast("int").alias(at))
    both = F.array(place(r - BLOCK_CELLS, F.lit(BLOCK_CELLS)), place(r, F.lit(0)))
    return F.inline(F.when(inside == 0, both).otherwise(F.array(place(r - inside, inside))))


def dual_cells(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Code of every dual cell touched by a pixel of the group.

    Pixels are bits of blocks, 8 x 8 pixels around 7 x 7 cells, and cells are read off the blocks
    after the shuffle.  ``bit_or`` makes repeated pixels harmless, and its partial aggregation
    merges neighbouring pixels before the shuffle.
    """
    placed = pixels.select(*keys, "region2", _block_places("region1", "_a0", "_a")).select(
        *keys, "_a0", "_a", _block_places("region2", "_b0", "_b")
    )
    # A missing bin counts on both sides of its one cell.
    line = F.when(F.col("_b").isNull(), F.lit(3)).otherwise(F.expr("shiftleft(1, _b)")).cast("bigint")
    bits = F.when(F.col("_a").isNull(), line.bitwiseOR(F.shiftleft(line, 8))).otherwise(
        F.call_function("shiftleft", line, 8 * F.col("_a"))
    )
    blocks = placed.groupBy(*keys, "_a0", "_b0").agg(F.bit_or(bits).alias("_bits"))
    side = range(BLOCK_CELLS)
    cells = F.array(*[F.struct(F.lit(a).alias("_a"), F.lit(b).alias("_b")) for a in side for b in side])
    corner = F.call_function("shiftrightunsigned", F.col("_bits"), 8 * F.col("_a") + F.col("_b")).cast("bigint")
    at = {1: 0, 2: 8, 4: 1, 8: 9}  # where the pixel of each bit of a code lies
    code = reduce(
        lambda x, y: x.bitwiseOR(y),
        [F.shiftright(corner, n).bitwiseAND(1).cast("int") * bit for bit, n in at.items()],
    )
    is_cell = "(_a = 0 OR _a0 IS NOT NULL) AND (_b = 0 OR _b0 IS NOT NULL)"
    return (
        blocks.select(*keys, "_a0", "_b0", "_bits", F.inline(cells))
        .filter(is_cell)
        .select(*keys, (F.col("_a0") + F.col("_a")).alias("ca"), (F.col("_b0") + F.col("_b")).alias("cb"), code.alias("code"))
        .filter("code > 0")
    )


def _crossings(saddle: str, unlike: str | None = None) -> Column:
    """Array literal: the side offsets to draw for each code 1..15, without those that ``unlike`` draws too."""
    table = CROSSINGS | SADDLES[saddle]
    if unlike:
        other = CROSSINGS | SADDLES[unlike]
        table = {code: [m for m in moves if m not in other[code]] for code, moves in table.items()}
    none = F.array().cast("array<struct<dx1:int,dy1:int,dx2:int,dy2:int>>")
    rows = []
    for code in range(1, 16):
        moves = [SIDES[a] + SIDES[b] for a, b in table[code]]
        rows.append(
            F.array(
                *[
                    F.struct(*[F.lit(v).alias(n) for n, v in zip(("dx1", "dy1", "dx2", "dy2"), m)])
                    for m in moves
                ]
            )
            if moves
            else none
        )
    return F.array(*rows)


def segments(
    pixels: DataFrame, keys: Sequence[str], saddle: str = "separate", unlike: str | None = None
) -> DataFrame:
    """Directed outline segments in doubled coordinates, pixels on the left.

    Within a group every vertex starts one segment and ends one.  Cells inside
    the group (code 15) draw nothing and vanish here.

    ``unlike`` names another saddle rule, whose segments are taken off.  Both ends of a segment lie
    in one dual cell, so two rules are compared cell by cell and no segments are joined.  As in a
    join on all columns, a segment with a NULL key or coordinate equals none and stays.
    """
    cells = dual_cells(pixels, keys).filter("code < 15")
    drawn = F.element_at(_crossings(saddle), F.col("code"))
    if unlike:
        known = reduce(and_, [F.col(c).isNotNull() for c in (*keys, "ca", "cb")])
        drawn = F.when(known, F.element_at(_crossings(saddle, unlike), F.col("code"))).otherwise(drawn)
    moves = F.inline(drawn)
    x, y = 2 * F.col("ca"), 2 * F.col("cb")
    return cells.select(*keys, "ca", "cb", moves).select(
        *keys,
        (x + F.col("dx1")).alias("x1"),
        (y + F.col("dy1")).alias("y1"),
        (x + F.col("dx2")).alias("x2"),
        (y + F.col("dy2")).alias("y2"),
    )


def vertices(segs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Outline vertices with the directions in and out; ``keep`` marks the turns.

    Each segment is the way out of its start and the way into its end, so one
    aggregation on the vertex sees both.  No order along the ring is needed.
    """
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    empty = F.lit(None).cast("bigint")
    ends = F.array(
        F.struct(
            F.col("x1").alias("x"),
            F.col("y1").alias("y"),
            empty.alias("in_dx"),
            empty.alias("in_dy"),
            dx.alias("out_dx"),
            dy.alias("out_dy"),
        ),
        F.struct(
            F.col("x2").alias("x"),
            F.col("y2").alias("y"),
            dx.alias("in_dx"),
            dy.alias("in_dy"),
            empty.alias("out_dx"),
            empty.alias("out_dy"),
        ),
    )
    found = (
        segs.select(*keys, F.inline(ends))
        .groupBy(*keys, "x", "y")
        .agg(*[F.max(c).alias(c) for c in ("in_dx", "in_dy", "out_dx", "out_dy")])
    )
    turn = (F.col("in_dx") != F.col("out_dx")) | (F.col("in_dy") != F.col("out_dy"))
    return found.withColumn("keep", turn)


def simplified_vertices(segs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Vertices where the outline turns, in bin coordinates, unordered."""
    return vertices(segs, keys).filter("keep").select(
        *keys, (F.col("x") / 2.0).alias("x"), (F.col("y") / 2.0).alias("y")
    )


def differences(segs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Circular first and second differences along each ring.

    The neighbour of a vertex is the end of its segment, so following the ring
    takes a join on the vertex and no window over the ring.
    """
    here = segs.select(
        *keys,
        "x1",
        "y1",
        F.col("x2").alias("nx"),
        F.col("y2").alias("ny"),
        (F.col("x2") - F.col("x1")).alias("dx"),
        (F.col("y2") - F.col("y1")).alias("dy"),
    )
    after = here.select(
        *keys,
        F.col("x1").alias("nx"),
        F.col("y1").alias("ny"),
        F.col("dx").alias("next_dx"),
        F.col("dy").alias("next_dy"),
    )
    both = join_null_safe(here, after, [*keys, "nx", "ny"])
    return both.select(
        *keys,
        (F.col("x1") / 2.0).alias("x"),
        (F.col("y1") / 2.0).alias("y"),
        (F.col("dx") / 2.0).alias("dx"),
        (F.col("dy") / 2.0).alias("dy"),
        ((F.col("next_dx") - F.col("dx")) / 2.0).alias("ddx"),
        ((F.col("next_dy") - F.col("dy")) / 2.0).alias("ddy"),
        ((F.col("next_dx") == F.col("dx")) & (F.col("next_dy") == F.col("dy"))).alias("both_zero"),
    )


def signed_area(x1: str = "x1", y1: str = "y1", x2: str = "x2", y2: str = "y2") -> Column:
    """Signed area from segments in doubled coordinates, in whole-number sums."""
    cross = F.col(x1) * F.col(y2) - F.col(x2) * F.col(y1)
    return F.sum(cross) / F.lit(8.0)


def group_areas(segs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area enclosed per group, holes taken off."""
    return segs.groupBy(*keys).agg(
        F.count("*").alias("segments"), signed_area().alias("area")
    )
