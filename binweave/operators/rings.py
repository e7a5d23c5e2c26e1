"""Order of the vertices along outline rings.

Following a ring is a chain of single steps, and a ring can be as long as the
matrix is wide.  It is done in three parts, none of which puts a whole group
into one task:

1. Segments are shuffled by group and map block, and each task links the ones
   it holds into paths with array operations.  A block bounds the rows that
   belong together, however large the group is.  Rings inside a block are
   finished here.
2. A ring that leaves its block is open in every block it touches.  Those
   segments alone are linked again on blocks shifted by half a block, which
   finishes the small rings that only happened to lie on a border.
3. What is still open belongs to rings as large as a block.  Their paths are
   joined end to start.  In each round an independent set of paths, about a
   quarter, is swallowed by the paths before them and leaves, so rounds shrink
   and all rounds together write about four times the paths, to the shared
   folder.  Once they fit in one task's chunk, the rest are linked there; then
   those that left are placed, last round first, each by the path before it.

A ring is named by its least vertex (ring_x, ring_y) and starts there, which
makes the result independent of partitioning.  Rings are open: the first vertex
is not repeated.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binweave.operators.boundary import segments, signed_area
from binweave.operators.geometry import rotate
from binweave.operators.relational import join_null_safe
from binweave.scratch import cut

BLOCK = 512  # dual cells on a side; at most 2 * BLOCK**2 segments per group and block
CHUNK_ROWS = 200_000  # rows linked at a time within a task


def _codes(*pairs: tuple[np.ndarray, np.ndarray], group: np.ndarray) -> list[np.ndarray]:
    """One whole number per (group, x, y), increasing in that order, over all pairs."""
    n = len(group)
    xs = np.unique(np.concatenate([p[0] for p in pairs]), return_inverse=True)[1]
    ys = np.unique(np.concatenate([p[1] for p in pairs]), return_inverse=True)[1]
    wide, tall = int(xs.max()) + 1, int(ys.max()) + 1
    return [
        (group * wide + xs[k * n : (k + 1) * n]) * tall + ys[k * n : (k + 1) * n]
        for k in range(len(pairs))
    ]


def _link(group: np.ndarray, x1, y1, x2, y2) -> dict[str, np.ndarray]:
    """Paths among segments: row order along them, position, head, turns."""
    n = len(group)
    start, end = _codes((x1, y1), (x2, y2), group=group)
    by_start = np.argsort(start, kind="stable")
    at = np.searchsorted(start[by_start], end)
    at_safe = np.minimum(at, n - 1)
    found = start[by_start][at_safe] == end
    own = np.arange(n)
    follower = np.where(found, by_start[at_safe], own)
    before = own.copy()
    before[follower[found]] = own[found]
    has_before = np.zeros(n, bool)
    has_before[follower[found]] = True

    # Least start code ahead, and whether the path's end has been reached; both
    # reach twice as far each round and are final once a round changes nothing.
    least, ahead = start.copy(), follower.copy()
    ended = ~found[ahead]
    while True:
        new_least = np.minimum(least, least[ahead])
        ahead = ahead[ahead]
        new_ended = ~found[ahead]
        same = np.array_equal(new_least, least) and np.array_equal(new_ended, ended)
        least, ended = new_least, new_ended
        if same:
            break
    is_open = ended

    head = np.where(is_open, ~has_before, least == start)
    to_head = np.where(head, own, before)
    position = (~head).astype(np.int64)
    while True:
        further = to_head[to_head]
        if np.array_equal(further, to_head):
            break
        position = position + position[to_head]
        to_head = further

    order = np.lexsort((position, to_head))
    root, pos = to_head[order], position[order]
    first = pos == 0
    path = np.cumsum(first) - 1
    direction = ((x2 - x1) * 8 + (y2 - y1))[order]
    starts = np.flatnonzero(first)
    lasts = np.append(starts[1:], n) - 1
    previous = np.roll(direction, 1)
    previous[starts] = direction[lasts]
    closed = ~is_open[order]
    unknown = first & ~closed
    keep = (direction != previous) & ~unknown
    kept = np.cumsum(keep)
    kept_before = kept - keep - (kept - keep)[starts][path]
    return {
        "order": order,
        "head": root,
        "pos": pos,
        "closed": closed,
        "keep": keep,
        "kept_before": kept_before,
    }


def _groups(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """Running number of each run of equal key values."""
    changed = np.zeros(max(table.num_rows - 1, 0), bool)
    for name in names:
        coded = pc.dictionary_encode(table[name].combine_chunks(), null_encoding="encode")
        values = coded.indices.to_numpy(zero_copy_only=False)
        changed |= values[1:] != values[:-1]
    return np.concatenate([[0], np.cumsum(changed)]).astype(np.int64)


def _trace_table(table: pa.Table, keys: Sequence[str]) -> pa.Table:
    x1, y1, x2, y2 = (table[c].to_numpy() for c in ("x1", "y1", "x2", "y2"))
    r = _link(_groups(table, keys), x1, y1, x2, y2)
    moved = table.select([*keys, "x1", "y1", "x2", "y2"]).take(pa.array(r["order"]))
    for name, values in (
        ("head_x", x1[r["head"]]),
        ("head_y", y1[r["head"]]),
        ("pos", r["pos"]),
        ("kept_before", r["kept_before"]),
        ("keep", r["keep"]),
        ("closed", r["closed"]),
    ):
        moved = moved.append_column(name, pa.array(values))
    return moved


def _tracer(keys: Sequence[str], chunk_rows: int):
    """Arrow batch function: gather rows up to a block's end, link them, emit paths."""
    runs = [*keys, "bx", "by"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < chunk_rows:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            block = _groups(table, runs)
            stop = int(np.searchsorted(block, block[-1]))
            if stop:
                yield from _trace_table(table.slice(0, stop), keys).to_batches(max_chunksize=50_000)
            rest = table.slice(stop)
            held, rows = rest.to_batches(), rest.num_rows
        if rows:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from _trace_table(table, keys).to_batches(max_chunksize=50_000)

    return run


def _local_paths(
    segs: DataFrame, keys: Sequence[str], block: int, shift: int, chunk_rows: int
) -> DataFrame:
    """Parts 1 and 2: paths within blocks, one row per segment."""
    fields = [segs.schema[k] for k in keys]
    longs = ("x1", "y1", "x2", "y2", "head_x", "head_y", "pos", "kept_before")
    schema = T.StructType(
        fields
        + [T.StructField(c, T.LongType()) for c in longs]
        + [T.StructField(c, T.BooleanType()) for c in ("keep", "closed")]
    )
    # Both ends of a segment lie in one dual cell, so their sum gives the cell.
    cell = {
        f"b{a}": F.floor((F.col(f"{a}1") + F.col(f"{a}2") + 4 * shift) / (4 * block))
        for a in ("x", "y")
    }
    placed = (
        segs.withColumns(cell)
        .repartition(*keys, "bx", "by")
        .sortWithinPartitions(*keys, "bx", "by", "x1", "y1")
    )
    return placed.mapInArrow(_tracer(keys, chunk_rows), schema)


def _path_table(open_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per open path, with the keep flag of its head settled by the path before it."""
    step = F.struct((F.col("x2") - F.col("x1")).alias("dx"), (F.col("y2") - F.col("y1")).alias("dy"))
    paths = open_rows.groupBy(*keys, "head_x", "head_y").agg(
        F.count("*").alias("n"),
        F.sum(F.col("keep").cast("long")).alias("kept"),
        F.max_by(F.struct("x2", "y2"), "pos").alias("end"),
        F.max_by(step, "pos").alias("last_step"),
        F.min_by(step, "pos").alias("first_step"),
        F.min(F.struct("x1", "y1", "pos", "kept_before")).alias("least"),
    )
    arriving = paths.select(
        *keys,
        F.col("end.x2").alias("head_x"),
        F.col("end.y2").alias("head_y"),
        F.col("last_step").alias("arriving"),
    )
    joined = join_null_safe(paths, arriving, [*keys, "head_x", "head_y"])
    head_kept = (F.col("first_step") != F.col("arriving")).cast("long")
    return joined.select(
        *keys,
        "head_x",
        "head_y",
        "n",
        (F.col("kept") + head_kept).alias("kept"),
        head_kept.alias("head_kept"),
        F.col("end.x2").alias("next_x"),
        F.col("end.y2").alias("next_y"),
        F.struct(
            F.col("least.x1").alias("x"),
            F.col("least.y1").alias("y"),
            F.col("least.pos").alias("pos"),
            (
                F.col("least.kept_before")
                + F.when(F.col("least.pos") > 0, head_kept).otherwise(F.lit(0))
            ).alias("kept_before"),
        ).alias("least"),
    )


_PLACED = ("best", "to_best", "to_best_kept", "ring_n", "ring_kept")


def _finish(keys: Sequence[str]):
    """Arrow batch function: place all paths of the given rings, of which one task holds every path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        n = table.num_rows
        column = {c: table[c].to_numpy() for c in ("head_x", "head_y", "next_x", "next_y", "to_best", "to_best_kept", "span", "span_kept")}
        start, end = _codes((column["head_x"], column["head_y"]), (column["next_x"], column["next_y"]), group=_groups(table, keys))
        by_start = np.argsort(start, kind="stable")
        ahead = by_start[np.searchsorted(start[by_start], end)]
        parts = [c.to_numpy() for c in table["best"].combine_chunks().flatten()]
        by_best = np.lexsort(parts[::-1])
        best = np.empty(n, np.int64)
        best[by_best] = np.arange(n)  # two rings may have equal least vertices in different groups
        far, far_kept, span, span_kept = (column[c].copy() for c in ("to_best", "to_best_kept", "span", "span_kept"))
        while True:
            better = best[ahead] < best
            if not better.any():
                break
            far = np.where(better, span + far[ahead], far)
            far_kept = np.where(better, span_kept + far_kept[ahead], far_kept)
            best = np.minimum(best, best[ahead])
            span, span_kept, ahead = span + span[ahead], span_kept + span_kept[ahead], ahead[ahead]
        totals = np.zeros((2, n), np.int64)
        np.add.at(totals[0], best, column["span"])
        np.add.at(totals[1], best, column["span_kept"])
        out = table.select([*keys, "head_x", "head_y"]).append_column("best", table["best"].take(pa.array(by_best[best])))
        for name, values in zip(_PLACED[1:], (far, far_kept, totals[0][best], totals[1][best]), strict=True):
            out = out.append_column(name, pa.array(values))
        yield from out.to_batches(max_chunksize=50_000)

    return run


def _contract(alive: DataFrame, keys: Sequence[str], turn: int) -> DataFrame:
    """One round: the paths that stay, each with the one it swallowed, if any (``gone_x, gone_y``).

    A path leaves if its coin shows 1 and that of the path behind it 0, so of two neighbours at
    most one leaves, and both know it from their own row.
    """

    def coin(end: str) -> Column:
        return F.xxhash64(*keys, f"{end}_x", f"{end}_y", F.lit(turn)).bitwiseAND(1) == 1

    leaves = coin("head") & ~coin("next")
    measures = ("best", "to_best", "to_best_kept", "span", "span_kept")
    gone = alive.filter(leaves).select(
        *keys,
        F.col("head_x").alias("next_x"),
        F.col("head_y").alias("next_y"),
        *[F.col(c).alias(f"on_{c}") for c in ("next_x", "next_y", *measures)],
    )
    stays = alive.filter(~leaves)
    met = join_null_safe(stays.filter(coin("next")), gone, [*keys, "next_x", "next_y"], "left")
    left = F.col("on_span").isNotNull()
    better = left & (F.col("on_best") < F.col("best"))
    none = F.lit(None).cast("long")
    joined = met.select(
        *keys,
        "head_x",
        "head_y",
        F.coalesce("on_next_x", "next_x").alias("next_x"),
        F.coalesce("on_next_y", "next_y").alias("next_y"),
        F.least("best", "on_best").alias("best"),
        F.when(better, F.col("span") + F.col("on_to_best")).otherwise(F.col("to_best")).alias("to_best"),
        F.when(better, F.col("span_kept") + F.col("on_to_best_kept"))
        .otherwise(F.col("to_best_kept"))
        .alias("to_best_kept"),
        (F.col("span") + F.coalesce("on_span", F.lit(0))).alias("span"),
        (F.col("span_kept") + F.coalesce("on_span_kept", F.lit(0))).alias("span_kept"),
        F.when(left, F.col("next_x")).alias("gone_x"),
        F.when(left, F.col("next_y")).alias("gone_y"),
        F.when(left, F.col("span")).alias("offset"),
        F.when(left, F.col("span_kept")).alias("offset_kept"),
    )
    alone = stays.filter(~coin("next")).select(
        *keys, "head_x", "head_y", "next_x", "next_y", *measures,
        *[none.alias(c) for c in ("gone_x", "gone_y", "offset", "offset_kept")],
    )
    return cut(joined.unionByName(alone), "paths")


def _join_paths(paths: DataFrame, keys: Sequence[str], chunk_rows: int) -> DataFrame:
    """Part 3: for each open path its ring, its distance along the ring and the ring's length.

    Each path knows the least vertex among the paths it has swallowed, how far
    away that one's path is, and where it ends.  A path that ends at its own
    head is a whole ring.
    """
    ends = ["head_x", "head_y"]
    measures = ("best", "to_best", "to_best_kept", "span", "span_kept")
    alive = paths.select(
        *keys,
        *ends,
        "next_x",
        "next_y",
        F.col("least").alias("best"),
        F.lit(0).cast("long").alias("to_best"),
        F.lit(0).cast("long").alias("to_best_kept"),
        F.col("n").alias("span"),
        F.col("kept").alias("span_kept"),
    )
    whole = F.expr("head_x = next_x AND head_y = next_y")
    placed_form = [*keys, *ends, "best", "to_best", "to_best_kept", F.col("span").alias("ring_n"), F.col("span_kept").alias("ring_kept")]
    known = alive.filter(whole).select(*placed_form)
    alive = alive.filter(~whole)
    rounds = []
    while alive.count() > chunk_rows:
        step = _contract(alive, keys, len(rounds))
        rounds.append(step.filter("gone_x IS NOT NULL").select(*keys, *ends, "gone_x", "gone_y", "offset", "offset_kept"))
        view = step.select(*keys, *ends, "next_x", "next_y", *measures)
        known = known.unionByName(view.filter(whole).select(*placed_form))
        alive = view.filter(~whole)
    rest = alive.repartition(1).sortWithinPartitions(*keys).mapInArrow(_finish(keys), known.schema)
    known = cut(known.unionByName(rest), "placed")
    for swallowed in reversed(rounds):
        placed = join_null_safe(swallowed, known, [*keys, *ends]).select(
            *keys,
            F.col("gone_x").alias("head_x"),
            F.col("gone_y").alias("head_y"),
            "best",
            F.pmod(F.col("to_best") - F.col("offset"), F.col("ring_n")).alias("to_best"),
            F.pmod(F.col("to_best_kept") - F.col("offset_kept"), F.col("ring_kept")).alias("to_best_kept"),
            "ring_n",
            "ring_kept",
        )
        known = known.unionByName(cut(placed, "placed"))
    return known


def _number_open(open_rows: DataFrame, paths: DataFrame, keys: Sequence[str], chunk_rows: int) -> DataFrame:
    ends = [*keys, "head_x", "head_y"]
    seen = _join_paths(paths, keys, chunk_rows)
    placed = join_null_safe(paths.select(*ends, "head_kept"), seen, ends).select(
        *ends,
        "head_kept",
        "best",
        "ring_n",
        "ring_kept",
        F.pmod(F.col("ring_n") - F.col("to_best"), F.col("ring_n")).alias("ahead"),
        F.pmod(F.col("ring_kept") - F.col("to_best_kept"), F.col("ring_kept")).alias("ahead_kept"),
    )
    rows = join_null_safe(open_rows, placed, ends)
    inner = F.col("pos") > 0
    kept_here = F.col("kept_before") + F.when(inner, F.col("head_kept")).otherwise(F.lit(0))
    return rows.select(
        *keys,
        "x1",
        "y1",
        "x2",
        "y2",
        F.col("best.x").alias("least_x"),
        F.col("best.y").alias("least_y"),
        F.pmod(F.col("ahead") + F.col("pos") - F.col("best.pos"), F.col("ring_n")).alias("vertex_ord"),
        F.pmod(F.col("ahead_kept") + kept_here - F.col("best.kept_before"), F.col("ring_kept")).alias("kept_ord"),
        F.when(inner, F.col("keep")).otherwise(F.col("head_kept") == 1).alias("keep"),
    )


def _closed(traced: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rings that are whole within their block; their head is their least vertex."""
    return traced.filter("closed").select(
        *keys,
        "x1",
        "y1",
        "x2",
        "y2",
        F.col("head_x").alias("least_x"),
        F.col("head_y").alias("least_y"),
        F.col("pos").alias("vertex_ord"),
        F.col("kept_before").alias("kept_ord"),
        "keep",
    )


def trace(
    segs: DataFrame,
    keys: Sequence[str],
    block: int = BLOCK,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Ordered rings of outline segments.

    Columns: the keys, ``ring_x, ring_y`` (least vertex of the ring), ``x, y``,
    ``next_x, next_y``, ``vertex_ord`` from 0, ``keep`` for turns and
    ``kept_ord``, their number among the turns (NULL elsewhere).

    Runs when called: paths are written to the shared folder, and whether any
    are still open decides what comes next.
    """
    traced = cut(_local_paths(segs, keys, block, 0, chunk_rows), "traced")
    rows = _closed(traced, keys)
    open_rows = traced.filter("not closed")
    if not open_rows.isEmpty():
        again = open_rows.select(*keys, "x1", "y1", "x2", "y2")
        traced = cut(_local_paths(again, keys, block, block // 2, chunk_rows), "traced")
        rows = rows.unionByName(_closed(traced, keys))
        open_rows = traced.filter("not closed")
        if not open_rows.isEmpty():
            paths = cut(_path_table(open_rows, keys), "heads")
            rows = rows.unionByName(_number_open(open_rows, paths, keys, chunk_rows))
    half = {"least_x": "ring_x", "least_y": "ring_y", "x1": "x", "y1": "y", "x2": "next_x", "y2": "next_y"}
    return rows.select(
        *keys,
        *[(F.col(a) / 2.0).alias(b) for a, b in half.items()],
        "vertex_ord",
        "keep",
        F.when(F.col("keep"), F.col("kept_ord")).alias("kept_ord"),
    )


def rings(
    pixels: DataFrame,
    keys: Sequence[str],
    saddle: str = "separate",
    block: int = BLOCK,
) -> DataFrame:
    """All outline vertices of each group, ordered along their rings."""
    return trace(segments(pixels, keys, saddle), keys, block)


def outlines(
    pixels: DataFrame,
    keys: Sequence[str],
    saddle: str = "separate",
    block: int = BLOCK,
) -> DataFrame:
    """Simplified outlines: turns only, numbered along each ring, rotated as well."""
    kept = (
        rings(pixels, keys, saddle, block)
        .filter("keep")
        .select(
            *keys,
            "ring_x",
            "ring_y",
            F.col("kept_ord").alias("vertex_ord"),
            F.col("x").alias("region1"),
            F.col("y").alias("region2"),
        )
    )
    return rotate(kept, "region")


def close_rings(outline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Repeat the first vertex of each ring at its end.

    The end number comes from the ring's size, an aggregate, so no ring is
    gathered in one place.
    """
    ring = [*keys, "ring_x", "ring_y"]
    sizes = outline.groupBy(*ring).agg((F.max("vertex_ord") + 1).alias("last"))
    again = (
        join_null_safe(outline.filter("vertex_ord = 0"), sizes, ring)
        .withColumn("vertex_ord", F.col("last"))
        .drop("last")
    )
    return outline.unionByName(again)


def ring_roles(traced: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Signed area of each ring: positive for an outer ring, negative for a hole."""
    doubled = {c: (F.col(c) * 2).cast("long") for c in ("x", "y", "next_x", "next_y")}
    area = (
        traced.withColumns(doubled)
        .groupBy(*keys, "ring_x", "ring_y")
        .agg(
            F.count("*").alias("vertices"),
            F.sum(F.col("keep").cast("long")).alias("turns"),
            signed_area("x", "y", "next_x", "next_y").alias("area"),
        )
    )
    return area.withColumn("role", F.when(F.col("area") > 0, "outer").otherwise("hole"))
