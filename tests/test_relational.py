"""Joins on hot keys, grids, numbering, ranges, selections."""

import pytest
from pyspark.sql import functions as F

from binweave.operators.relational import (
    above_subset_max,
    first_rows,
    grid,
    grid_counts,
    grid_sizes,
    index_shift,
    join_checked,
    join_spread,
    missing_pixels,
    number_rows,
    relative_to_least,
    rows_for_keys,
    rows_of_first_id,
    rows_of_ranked_keys,
)
from binweave.operators.selection import flag_selected, shown
from binweave.operators.summaries import count_of_counts, histogram, midpoint_intervals, presence_crosstab
from binweave.plans import catalog

PIXELS = "chr string, region1 bigint, region2 bigint"


def pixels(spark, cells):
    return spark.createDataFrame([("chr1", a, b) for a, b in cells], PIXELS)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows under one key, some without a key, some without a match."""
    data = [(1, v) for v in range(60)] + [(k, k) for k in range(2, 20)] + [(None, v) for v in range(12)]
    return spark.createDataFrame(data, "k int, v int")


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("hot", [1, 7, 1_000])
def test_salted_join_equals_plain_join(spark, skewed, how, hot):
    unique = spark.createDataFrame([(k, f"n{k}") for k in range(1, 10)], "k int, name string")
    def key(t):
        return tuple(map(str, t))

    found = sorted(map(tuple, join_spread(skewed, unique, ["k"], how, hot).select("k", "v", "name").collect()), key=key)
    plain = sorted(map(tuple, skewed.join(unique, "k", how).select("k", "v", "name").collect()), key=key)
    assert found == plain


@pytest.mark.parametrize("how", ["left", "left_semi"])
@pytest.mark.parametrize("limit", [2, 1_000])
def test_checked_join_broadcasts_small_sides_only(spark, skewed, how, limit):
    unique = spark.range(1, 10).select(F.col("id").cast("int").alias("k"), F.lit(True).alias("seen"))
    joined = join_checked(skewed, unique, ["k"], how, limit)
    plain = skewed.join(unique, "k", how).select(*joined.columns)
    assert joined.exceptAll(plain).isEmpty() and plain.exceptAll(joined).isEmpty()
    assert ("_salt" in joined._jdf.queryExecution().optimizedPlan().toString()) == (limit == 2)


@pytest.mark.parametrize("value", [lambda: F.repeat(F.lit("x"), 1000), lambda: F.array_repeat(F.lit(123456789), 100)])
def test_checked_join_looks_at_bytes(spark, skewed, value):
    unique = spark.range(1, 10).select(F.col("id").cast("int").alias("k"), value().alias("wide"))
    for most, salted in ((2_000, True), (1 << 20, False)):
        joined = join_checked(skewed, unique, ["k"], "left", broadcast_bytes=most)
        assert ("_salt" in joined._jdf.queryExecution().optimizedPlan().toString()) == salted
        assert joined.count() == skewed.count()


@pytest.mark.parametrize("limit", [0, 1_000])
def test_checked_join_of_missing_keys(spark, skewed, limit):
    unique = skewed.groupBy("k").agg(F.max("v").alias("most"))
    joined = join_checked(skewed, unique, ["k"], "inner", limit, null_safe=True)
    assert joined.count() == skewed.count() and joined.filter("v > most").isEmpty()


def test_limits_by_group_leave_the_rows_where_they_are(spark, skewed):
    """The side with a row per group is broadcast, so the rows are not dealt by the group's key."""
    above = above_subset_max(skewed, "v", F.col("v") % 2 == 0, ["k"])
    shifted = index_shift(pixels(spark, [(12, 10), (11, 15)]))
    for df in (above, shifted):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text
    most = {k: max([v for j, v in map(tuple, skewed.collect()) if j == k and v is not None and v % 2 == 0], default=None) for k in {r.k for r in skewed.collect()}}
    wanted = [(k, v) for k, v in map(tuple, skewed.collect()) if v is not None and most[k] is not None and v > most[k]]
    assert sorted(map(repr, map(tuple, above.collect()))) == sorted(map(repr, wanted))


def test_hot_key_is_split(spark, skewed):
    """The hot key's rows reach the join under several salts."""
    unique = spark.createDataFrame([(1, "a")], "k int, name string")
    joined = join_spread(skewed, unique, ["k"], "inner", 5)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan and joined.count() == 60


@pytest.mark.parametrize("hot", [2, 1_000])
def test_relative_and_first_id_on_hot_groups(spark, hot):
    data = [(1, i, float(50 - i)) for i in range(40)] + [(2, 9, 3.0), (2, 9, 4.0), (2, 11, 1.0)]
    df = spark.createDataFrame(data, "g int, id int, x double")
    rel = relative_to_least(df, ["g"], ["x"], hot)
    assert rows(rel.filter("g = 2"), "id", "rel_x") == [(9, 2.0), (9, 3.0), (11, 0.0)]
    assert rel.filter("g = 1").agg(F.max("rel_x")).first()[0] == 39.0
    assert rows(rows_of_first_id(df, ["g"], "id", hot)) == [(1, 0, 50.0), (2, 9, 3.0), (2, 9, 4.0)]


@pytest.mark.parametrize("block", [1, 3, 10_000])
def test_numbers_run_through_blocks(spark, block):
    df = spark.createDataFrame([("a" if n % 3 else "b", n * 2) for n in range(50)] + [(None, 7)], "g string, n int")
    out = number_rows(df, ["g"], "n", block=block)
    for g in ("a", "b", None):
        got = [r["rel_row"] for r in out.filter(F.col("g").eqNullSafe(g)).orderBy("n").collect()]
        assert got == list(range(1, len(got) + 1))
    assert out.count() == 51


def test_grids(spark):
    full = pixels(spark, [(1, 1), (1, 3), (3, 3)])
    assert rows(grid(full, whole=True)) == [("chr1", 1, 1), ("chr1", 1, 3), ("chr1", 3, 3)]
    assert rows(missing_pixels(full, whole=True)) == []
    gap = pixels(spark, [(1, 1), (2, 3), (3, 3)])
    assert rows(grid(gap, whole=True)) == [("chr1", 1, 1), ("chr1", 1, 3), ("chr1", 2, 3), ("chr1", 3, 3)]
    assert rows(missing_pixels(gap, whole=True)) == [("chr1", 1, 3)]
    assert rows(missing_pixels(gap, 1)) == []
    assert tuple(grid_counts(gap).first()) == (1, 4, "1 missing pixels out of 4 possible in grid")
    assert rows(grid_sizes(gap)) == [("chr1", 1, 2), ("chr1", 2, 1), ("chr1", 3, 1)]


def test_a_whole_grid_must_be_asked_for(spark):
    with pytest.raises(ValueError, match="whole"):
        grid(pixels(spark, [(1, 1)]))


def test_grid_over_block_borders(spark):
    cells = [(a, a + k) for a in range(1000, 1060) for k in (0, 30) if a % 7]
    px = pixels(spark, cells)
    firsts, seconds = {a for a, _ in cells}, {b for _, b in cells}
    for limit in (None, 40):
        wanted = {(a, b) for a in firsts for b in seconds if a <= b and (limit is None or b - a <= limit)}
        assert {(r["region1"], r["region2"]) for r in grid(px, limit, whole=limit is None).collect()} == wanted
        absent = {(r["region1"], r["region2"]) for r in missing_pixels(px, limit, whole=limit is None).collect()}
        assert absent == wanted - set(cells)
        counted = grid_counts(px, max_distance=limit).first()
        assert (counted["missing"], counted["possible"]) == (len(wanted - set(cells)), len(wanted))
    sizes = {a: len([b for b in seconds if b >= a]) for a in firsts}
    assert {r["region1"]: r["cells"] for r in grid_sizes(px).collect()} == {a: n for a, n in sizes.items() if n}


def test_index_shift_takes_the_least_of_both_columns(spark):
    px = pixels(spark, [(12, 10), (11, 15)])
    assert rows(index_shift(px), "i", "j") == [(1, 3), (6, 2)]


def test_ranked_keys(spark):
    df = spark.createDataFrame([(k, v) for k in (5, 3, 9) for v in (1, 2)], "k int, v int")
    assert rows(rows_of_ranked_keys(df, ["k"], [1, 3])) == [(3, 1), (3, 2), (9, 1), (9, 2)]


def test_rows_for_keys_may_keep_missing_ones(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    wanted = spark.createDataFrame([(2,), (4,), (4,)], "k int")
    assert rows(rows_for_keys(df, wanted, ["k"])) == [(2, "b")]
    assert rows(rows_for_keys(df, wanted, ["k"], keep_missing=True)) == [(2, "b"), (4, None)]


def test_first_rows_keep_columns(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 3), (2, "c", 1)], "k int, o string, v int")
    out = first_rows(df, ["k"], ["o"])
    assert out.columns == ["k", "o", "v"]
    assert rows(out) == [(1, "a", 3), (2, "c", 1)]


def test_uniqueness_check_sees_repeats(spark):
    px = pixels(spark, [(1, 1), (1, 1), (2, 2)])
    assert rows(count_of_counts(px, ["region1", "region2"])) == [(1, 1), (2, 1)]


def test_histogram_edges_are_right_closed(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 2.5, 4)], "v double")
    assert rows(histogram(df, "v", 4), "bin", "count") == [(1, 2), (2, 1), (3, 1), (4, 1)]
    same = spark.createDataFrame([(3.0,), (3.0,), (None,)], "v double")
    assert rows(histogram(same, "v", 4), "bin", "count") == [(1, 2)]


def test_midpoint_intervals(spark):
    df = spark.createDataFrame([(1,), (2,), (6,), (6,)], "n int")
    assert rows(midpoint_intervals(df, "n")) == [(1, 0.5, 1.5), (2, 1.5, 4.0), (6, 4.0, 8.0)]
    assert rows(midpoint_intervals(df.filter("n = 1"), "n")) == [(1, 1.0, 1.0)]


def test_crosstab(spark):
    out = presence_crosstab(pixels(spark, [(1, 2), (1, 1), (3, 3), (9, 9)]), 0, 4)
    assert out.columns == ["chr", "region1", "1", "2", "3"]
    assert rows(out) == [("chr1", 1, 1, 1, 0), ("chr1", 3, 0, 0, 1)]


def test_selections(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    assert rows(shown(df, {"k": 1, "v": "a"})) == [(1, "a")]
    assert rows(shown(df, {"k": [1, 3]}), "k") == [(1,), (3,)]
    many = list(range(2, 5_000))
    assert rows(shown(df, {"k": many}), "k") == [(2,), (3,)]
    table = spark.createDataFrame([("b",), ("b",)], "v string")
    assert rows(shown(df, {"v": table}), "k") == [(2,)]
    assert rows(flag_selected(df, {"v": table}), "k", "selected") == [(1, False), (2, True), (3, False)]
    assert rows(flag_selected(df, {"k": [1, 2], "v": "b"}), "k", "selected") == [(1, False), (2, True), (3, False)]


def test_a_selection_means_the_same_at_any_length(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    for more in ([], list(range(100, 5_100))):
        assert rows(shown(df, {"k": [1.5, *more]})) == []
        assert rows(shown(df, {"k": [2.0, 1.5, *more]})) == [(2,)]
    assert rows(shown(df, {"k": spark.createDataFrame([(1.5,), (3.0,)], "k double")})) == [(3,)]


def test_midpoints_across_partitions(spark):
    df = spark.range(1_000).select((F.col("id") * F.col("id")).alias("n")).repartition(16)
    found = rows(midpoint_intervals(df, "n"))
    assert len(found) == 1_000
    assert all(a[2] == b[1] for a, b in zip(found, found[1:]))


def test_missing_keys_are_groups(spark):
    df = spark.createDataFrame([(None, 5), (None, 3), (1, 7)], "k int, v int")
    assert rows(relative_to_least(df, ["k"], ["v"]), "v", "rel_v") == [(3, 0), (5, 2), (7, 0)]
    assert rows(relative_to_least(df, ["k"], ["v"], hot_rows=1), "v", "rel_v") == [(3, 0), (5, 2), (7, 0)]
    assert rows(rows_of_first_id(df, ["k"], "v"), "v") == [(3,), (7,)]


def test_polygons_of_every_chromosome_meet_their_pixels(spark):
    """On tables of several chromosomes; the query of one chromosome leaves most polygons without a pixel."""
    folder = "/root/testdata/sf0.01"
    joined = catalog.QUERIES["e10_pixels_to_polygons_by_chr"](spark, folder)
    seen = joined.groupBy("chr").agg(F.count("*").alias("n"), F.count("region1").alias("met")).collect()
    assert len(seen) > 1 and all(r["n"] == r["met"] for r in seen)
    assert sum(r["n"] for r in seen) == spark.read.parquet(f"{folder}/lineitem.parquet").count()
