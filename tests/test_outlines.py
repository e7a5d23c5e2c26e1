"""Outlines: small exact fixtures, brute force on random masks, and rings over many blocks."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from binweave.operators.boundary import dual_cells, group_areas, segments, simplified_vertices
from binweave.operators.rings import _contract, _join_paths, _local_paths, close_rings, outlines, ring_roles, rings, trace
from binweave.plans.matrix import saddle_differences

KEY = ["m"]


def frame(spark, masks):
    """Masks (name -> set of pixels) as one table keyed by name."""
    rows = [(m, a, b) for m, cells in masks.items() for a, b in cells]
    return spark.createDataFrame(rows, "m int, region1 bigint, region2 bigint")


def grouped(df):
    """(mask, ring) -> vertices in order."""
    found = defaultdict(list)
    for r in df.orderBy("m", "ring_x", "ring_y", "vertex_ord").collect():
        found[r["m"], r["ring_x"], r["ring_y"]].append((r["vertex_ord"], r["x"], r["y"]))
    return found


def walk(cells, saddle):
    """Rings by brute force: edges between a pixel and a non-pixel, followed one at a time.

    A boundary edge's midpoint is a vertex.  Going round with pixels on the left,
    the next edge is found by turning about the grid corner ahead.
    """
    cells = set(cells)
    following = {}
    for a, b in cells:
        for da, db in ((1, 0), (-1, 0), (0, 1), (0, -1)):
            if (a + da, b + db) in cells:
                continue
            # Heading with the pixel on the left and the empty cell on the right.
            ha, hb = -db, da
            left, right = (a + ha, b + hb), (a + da + ha, b + db + hb)
            if left not in cells and right not in cells:
                nxt = ((a, b), (ha, hb))
            elif left in cells and right not in cells:
                nxt = (left, (da, db))
            elif left in cells and right in cells:
                nxt = (right, (-ha, -hb))
            elif saddle == "separate":
                nxt = ((a, b), (ha, hb))
            else:
                nxt = (right, (-ha, -hb))
            (pa, pb), (ea, eb) = nxt
            following[a + da / 2, b + db / 2] = (pa + ea / 2, pb + eb / 2)
    left_over, found = set(following), set()
    while left_over:
        start = min(left_over)
        ring, at = [], start
        while True:
            ring.append(at)
            left_over.discard(at)
            at = following[at]
            if at == start:
                break
        found.add(tuple(ring))
    return found


def components(cells, diagonal):
    steps = [(1, 0), (-1, 0), (0, 1), (0, -1)]
    if diagonal:
        steps += [(1, 1), (1, -1), (-1, 1), (-1, -1)]
    left, count = set(cells), 0
    while left:
        count += 1
        stack = [left.pop()]
        while stack:
            a, b = stack.pop()
            for da, db in steps:
                if (a + da, b + db) in left:
                    left.discard((a + da, b + db))
                    stack.append((a + da, b + db))
    return count


def holes(cells, diagonal):
    if not cells:
        return 0
    a0, a1 = min(a for a, _ in cells) - 1, max(a for a, _ in cells) + 1
    b0, b1 = min(b for _, b in cells) - 1, max(b for _, b in cells) + 1
    empty = {(a, b) for a in range(a0, a1 + 1) for b in range(b0, b1 + 1)} - set(cells)
    return components(empty, diagonal) - 1


FIXED = {
    0: {(3, 5)},
    1: {(a, b) for a in (1, 2, 3) for b in (1, 2, 3)} - {(2, 2)},
    2: {(1, 1), (2, 2)},
    3: {(1, 1), (1, 2), (5, 1), (5, 2)},
    4: {(1, b) for b in range(1, 7)},
}


def test_single_pixel(spark):
    found = grouped(rings(frame(spark, {0: FIXED[0]}), KEY))
    assert list(found.values()) == [[(0, 2.5, 5.0), (1, 3.0, 4.5), (2, 3.5, 5.0), (3, 3.0, 5.5)]]
    area = group_areas(segments(frame(spark, {0: FIXED[0]}), KEY), KEY).first()
    assert (area["segments"], area["area"]) == (4, 0.5)


@pytest.mark.parametrize("block", [1, 2, 64])
def test_fixed_ring_counts(spark, block):
    px = frame(spark, FIXED)
    by_rule = {}
    for rule in ("separate", "connect"):
        roles = ring_roles(rings(px, KEY, rule, block), KEY)
        by_rule[rule] = {(r["m"], r["role"]): r["n"] for r in roles.groupBy("m", "role").agg(F.count("*").alias("n")).collect()}
    assert by_rule["separate"] == {(0, "outer"): 1, (1, "outer"): 1, (1, "hole"): 1, (2, "outer"): 2, (3, "outer"): 2, (4, "outer"): 1}
    assert by_rule["connect"][2, "outer"] == 1


def test_long_bar_simplifies(spark):
    px = frame(spark, {4: FIXED[4]})
    assert rings(px, KEY).count() == 14
    turns = {(r["x"], r["y"]) for r in simplified_vertices(segments(px, KEY), KEY).collect()}
    assert turns == {(1, 0.5), (1.5, 1), (1.5, 6), (1, 6.5), (0.5, 6), (0.5, 1)}
    line = outlines(px, KEY).orderBy("vertex_ord").collect()
    assert [(r["region1"], r["region2"]) for r in line] == [(0.5, 1), (1, 0.5), (1.5, 1), (1.5, 6), (1, 6.5), (0.5, 6)]
    assert [r["region_x"] for r in line][:2] == [0.75, 0.75]


def test_closed_rings_repeat_the_first_vertex(spark):
    closed = close_rings(outlines(frame(spark, {1: FIXED[1]}), KEY), KEY)
    for ring in (
        closed.groupBy("ring_x", "ring_y")
        .agg(F.sort_array(F.collect_list(F.struct("vertex_ord", "region1", "region2"))).alias("v"))
        .collect()
    ):
        v = ring["v"]
        assert [p["vertex_ord"] for p in v] == list(range(len(v)))
        assert v[0][1:] == v[-1][1:]


def test_repeated_pixels_change_nothing(spark):
    px = frame(spark, {1: FIXED[1]})
    assert grouped(rings(px.union(px), KEY)) == grouped(rings(px, KEY))


@pytest.fixture(scope="module")
def random_masks():
    rng = random.Random(5)
    masks = {}
    for m in range(120):
        n, fill = rng.randint(1, 9), rng.choice([0.3, 0.5, 0.7])
        cells = {(a, b) for a in range(n) for b in range(n) if rng.random() < fill}
        if cells:
            masks[m] = cells
    return masks


@pytest.mark.parametrize("rule", ["separate", "connect"])
@pytest.mark.parametrize("block,chunk", [(64, 200_000), (3, 1), (1, 1)])
def test_random_masks_by_brute_force(spark, random_masks, rule, block, chunk):
    """Small blocks and chunks send nearly every ring through the joining of open paths."""
    px = frame(spark, random_masks)
    traced = trace(segments(px, KEY, rule), KEY, block, chunk)
    found = defaultdict(set)
    for (m, *_), points in grouped(traced).items():
        assert [p[0] for p in points] == list(range(len(points)))
        found[m].add(tuple((x, y) for _, x, y in points))
    assert found == {m: walk(cells, rule) for m, cells in random_masks.items()}

    roles = ring_roles(traced, KEY).groupBy("m").agg(
        F.count_if(F.col("role") == "outer").alias("outer"),
        F.count_if(F.col("role") == "hole").alias("hole"),
        F.sum("area").alias("area"),
    )
    areas = {r["m"]: r["area"] for r in group_areas(segments(px, KEY, rule), KEY).collect()}
    for r in roles.collect():
        cells = random_masks[r["m"]]
        assert r["outer"] == components(cells, rule == "connect")
        assert r["hole"] == holes(cells, rule == "separate")
        assert r["area"] == areas[r["m"]]


@pytest.mark.parametrize("block,chunk", [(64, 200_000), (3, 1)])
def test_turns_are_numbered_and_keep_the_area(spark, random_masks, block, chunk):
    traced = trace(segments(frame(spark, random_masks), KEY), KEY, block, chunk)
    turns = defaultdict(list)
    for r in traced.filter("keep").orderBy("m", "ring_x", "ring_y", "kept_ord").collect():
        turns[r["m"], r["ring_x"], r["ring_y"]].append(r)
    sizes = {(r["m"], r["ring_x"], r["ring_y"]): r["area"] for r in ring_roles(traced, KEY).collect()}
    assert set(turns) == set(sizes)
    for ring, rows in turns.items():
        assert [r["kept_ord"] for r in rows] == list(range(len(rows)))
        assert [r["vertex_ord"] for r in rows] == sorted(r["vertex_ord"] for r in rows)
        points = [(r["x"], r["y"]) for r in rows]
        ahead = points[1:] + points[:1]
        assert sum(a * d - c * b for (a, b), (c, d) in zip(points, ahead)) / 2 == sizes[ring]


def test_one_group_over_many_blocks(spark):
    """A spiral of one group crosses block borders hundreds of times; a hot group is no special case."""
    cells, a, b, length, step = set(), 0, 0, 61, 0
    cells.add((0, 0))
    for da, db in [(1, 0), (0, 1), (-1, 0), (0, -1)] * 15:
        for _ in range(length):
            a, b = a + da, b + db
            cells.add((a, b))
        step += 1
        if step % 2 == 0:
            length -= 2
        if length <= 0:
            break
    masks = {0: cells, 1: {(5, 5)}}
    wanted = {m: walk(c, "separate") for m, c in masks.items()}
    found = defaultdict(set)
    for (m, *_), points in grouped(rings(frame(spark, masks), KEY, block=8)).items():
        found[m].add(tuple((x, y) for _, x, y in points))
    assert found == wanted
    assert max(len(r) for r in wanted[0]) > 1000


def test_missing_group_value_is_a_group(spark):
    cells = [(None, a, b) for a, b in FIXED[1]]
    px = spark.createDataFrame(cells, "m int, region1 bigint, region2 bigint")
    for block in (64, 1):
        assert ring_roles(rings(px, KEY, block=block), KEY).count() == 2


def test_rules_differ_as_by_a_join(spark, random_masks):
    """Segments of one rule alone: as by an anti-join of all segments, also with missing values."""
    rows = [(m, a, b) for m, cells in random_masks.items() for a, b in cells]
    rows += [(None, a, b) for a, b in FIXED[2]] + [(99, 5, None), (99, 6, None), (98, None, 3), (None, None, None)] + rows[:20]
    px = spark.createDataFrame(rows, "m int, region1 bigint, region2 bigint")
    for rule, other in (("separate", "connect"), ("connect", "separate")):
        whole, against = segments(px, KEY, rule), segments(px, KEY, other)
        expected = sorted(map(str, whole.join(against, whole.columns, "left_anti").collect()))
        found = segments(px, KEY, rule, unlike=other)
        assert found.columns == whole.columns and sorted(map(str, found.collect())) == expected and len(expected) > 20


def test_cells_of_blocks_by_brute_force(spark):
    """Every cell's code once, over borders of blocks, below zero, with repeats and missing bins."""
    rng = random.Random(5)
    side = [None, *range(-16, 17)]
    rows = [(rng.choice([None, 1, 2]), rng.choice(side), rng.choice(side)) for _ in range(900)]
    codes = defaultdict(int)
    for m, a, b in rows:
        for bit, i, j in ((1, 0, 0), (2, 1, 0), (4, 0, 1), (8, 1, 1)):
            codes[m, None if a is None else a - i, None if b is None else b - j] |= bit
    px = spark.createDataFrame(rows, "m int, region1 bigint, region2 bigint")
    found = [tuple(r) for r in dual_cells(px, KEY).select("m", "ca", "cb", "code").collect()]
    assert len(found) == len(codes) and {r[:3]: r[3] for r in found} == codes
    one = spark.range(64).selectExpr("1 AS m", "id div 8 AS region1", "id % 8 AS region2")
    blocks = dual_cells(one, KEY)._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_or" in blocks and not re.search(r"Aggregate \[[^\]]*\bca#", blocks)  # cells are read off blocks, not shuffled


def test_rules_are_compared_without_a_join(spark, sf_dir):
    text = saddle_differences(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and "hashpartitioning" in text


def test_no_pixels_no_outlines(spark):
    px = spark.createDataFrame([], "m int, region1 bigint, region2 bigint")
    assert outlines(px, KEY).isEmpty()
    assert close_rings(outlines(px, KEY), KEY).isEmpty()


def test_hot_group_is_linked_in_many_tasks(spark):
    """One group with all the rows: no task links more than a part of it."""
    px = spark.range(20_000).select(
        F.lit(0).alias("m"),
        F.floor(F.col("id") / 20).alias("region1"),
        (F.floor(F.col("id") / 20) + F.col("id") % 20).alias("region2"),
    )
    holed = px.filter(F.pmod(F.xxhash64("region1", "region2"), F.lit(10)) < 8)
    paths = _local_paths(segments(holed, KEY), KEY, 16, 0, 1_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shares = [r["count"] for r in paths.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(shares) == 8 and max(shares) < sum(shares) / 3
    areas = ring_roles(rings(holed, KEY, block=16), KEY).agg(F.sum("area")).first()[0]
    assert areas == group_areas(segments(holed, KEY), KEY).first()["area"]


@pytest.mark.parametrize("most", [1, 40, 10_000])
def test_paths_are_ranked_by_contraction(spark, most):
    """Rings of 1, 2, 3 and 300 paths in several groups, one of them without a key, against a walk."""
    rng = random.Random(8)
    rows, wanted = [], {}
    for group, sizes in ((0, (1, 2, 3, 300)), (1, (300,)), (None, (5,))):
        free = rng.sample(range(100_000), 400)
        for size in sizes:
            ring = [(free.pop(), rng.randint(0, 50)) for _ in range(size)]
            n, kept = ([rng.randint(1, 9) for _ in ring] for _ in range(2))
            best = min(range(size), key=lambda k: ring[k])
            for k, (x, y) in enumerate(ring):
                between = [(k + step) % size for step in range((best - k) % size)]
                rows.append((group, x, y, n[k], kept[k], *ring[(k + 1) % size], (x, y, 0, 0)))
                wanted[group, x, y] = (ring[best], sum(n[j] for j in between), sum(kept[j] for j in between), sum(n), sum(kept))
    paths = spark.createDataFrame(
        rows,
        "m int, head_x bigint, head_y bigint, n bigint, kept bigint, next_x bigint, next_y bigint, "
        "least struct<x: bigint, y: bigint, pos: bigint, kept_before: bigint>",
    )
    found = _join_paths(paths, KEY, most).collect()
    assert len(found) == len(wanted)
    for r in found:
        assert wanted[r["m"], r["head_x"], r["head_y"]] == (
            (r["best"]["x"], r["best"]["y"]), r["to_best"], r["to_best_kept"], r["ring_n"], r["ring_kept"])


def test_rounds_of_contraction_shrink(spark):
    n = 4_000
    alive = spark.range(n).select(
        F.lit(0).alias("m"), F.col("id").alias("head_x"), F.lit(0).cast("bigint").alias("head_y"),
        ((F.col("id") + 1) % n).alias("next_x"), F.lit(0).cast("bigint").alias("next_y"),
        F.struct("id").alias("best"), *[F.lit(k).cast("bigint").alias(c) for c, k in (("to_best", 0), ("to_best_kept", 0), ("span", 1), ("span_kept", 1))],
    )
    counts = [n]
    for turn in range(4):
        alive = _contract(alive, KEY, turn)
        seen = alive.agg(F.count("*"), F.sum("span"), F.count_distinct("next_x")).first()
        assert seen[1] == n and seen[2] == seen[0]
        counts.append(seen[0])
    assert all(0.65 * a < b < 0.85 * a for a, b in zip(counts, counts[1:]))
