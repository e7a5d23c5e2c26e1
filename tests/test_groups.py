"""Missing runs, user functions over groups of any size, masks of large boxes and sketches."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from binweave.operators.gaps import cells_of_runs, missing_runs
from binweave.operators.groups import (
    RUN_STATE,
    UserAggregate,
    apply_in_blocks,
    longest_run,
    rows_in_blocks,
    run_of_block,
    user_aggregate,
    weighted_median,
)
from binweave.operators.masks import box_blocks, cells_of_blocks, group_masks, mask_blocks, mask_long
from binweave.operators.relational import grid_counts, missing_pixels
from binweave.operators.summaries import distinct_estimate, distinct_sketches, histogram
from binweave.sources.stand_ins import pixels, restarting

PIXELS = "chr string, region1 bigint, region2 bigint"


# --- runs of missing cells -----------------------------------------------------------


def brute_runs(rows):
    out = []
    for c in {r[0] for r in rows}:
        mine = {(a, b) for k, a, b in rows if k == c and a is not None and b is not None}
        seconds = sorted({b for _, b in mine})
        for a in {a for a, _ in mine}:
            run = []
            for b in [b for b in seconds if b >= a] + [None]:
                if b is not None and (a, b) not in mine:
                    run.append(b)
                elif run:
                    out.append((c, a, run[0], run[-1], len(run)))
                    run = []
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("spread", [40, 6_000])
def test_runs_by_brute_force(spark, spread):
    """Bins within a block of the line, and bins so far apart that most blocks are empty."""
    rng = random.Random(spread)
    bins = sorted(rng.sample(range(-spread, spread), 60))
    rows = [(c, rng.choice(bins), rng.choice(bins)) for c in ("chr1", "chr2", None) for _ in range(250)]
    rows += rows[:40] + [("chr1", None, 3), ("chr1", 3, None), ("chr3", 5, 2), ("chr4", 9_000, 1), ("chr4", 1, 1)]
    found = missing_runs(spark.createDataFrame(rows, PIXELS))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(brute_runs(rows), key=key)


def test_runs_hold_the_cells_that_are_missing(spark, sf_dir):
    for px in (pixels(spark, sf_dir), restarting(spark, sf_dir)):
        runs = missing_runs(px)
        assert runs.agg(F.sum("cells")).first()[0] == grid_counts(px).first()["missing"]
        assert runs.count() <= px.count() + px.select("chr", "region1").distinct().count()
        some = runs.filter("region1 % 37 = 5")
        wanted = missing_pixels(px, whole=True).filter("region1 % 37 = 5")
        listed = cells_of_runs(px, some).select("chr", "region1", "region2")
        assert sorted(map(tuple, listed.collect())) == sorted(map(tuple, wanted.select("chr", "region1", "region2").collect()))


def test_runs_of_nothing(spark):
    assert missing_runs(spark.createDataFrame([], PIXELS)).collect() == []
    assert missing_runs(spark.createDataFrame([("c", 1, 1)], PIXELS)).collect() == []


# --- functions over blocks -------------------------------------------------------------


def hot_rows(n=4_000, seed=1):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.4 else rng.choice(["a", "b", None]), rng.randrange(3_000), rng.random()) for _ in range(n)]


def brute_run(values):
    best = (0, 0)
    values = sorted(set(values))
    start = 0
    for i in range(1, len(values) + 1):
        if i == len(values) or values[i] != values[i - 1] + 1:
            best = max(best, (i - start, -values[start]))
            start = i
    return best[0], -best[1]


@pytest.mark.parametrize("block_rows", [15, 300, 100_000])
def test_longest_run_over_blocks_of_any_size(spark, block_rows):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, v bigint, x double")
    seen = []
    found = apply_in_blocks(df, ["k"], "v", run_of_block("v"), RUN_STATE, longest_run, "run bigint, starts bigint", block_rows=block_rows)
    for r in found.collect():
        seen.append(r["k"])
        assert (r["run"], r["starts"]) == brute_run([v for k, v, _ in rows if k == r["k"]])
    assert sorted(seen, key=str) == ["None", "a", "b", "hot"] or set(seen) == {"hot", "a", "b", None}


def test_no_block_holds_a_group(spark):
    df = spark.createDataFrame([("hot", i, 0.0) for i in range(5_000)], "k string, v bigint, x double")
    sizes = rows_in_blocks(df, ["k"], "v", lambda t: pa.table({"n": [t.num_rows]}), "n bigint", block_rows=200)
    found = [r["n"] for r in sizes.collect()]
    assert sum(found) == 5_000 and len(found) > 15 and max(found) < 1_000


@pytest.mark.parametrize("halo", [0, 7, 900])
@pytest.mark.parametrize("block_rows", [40, 100_000])
def test_rows_within_reach_of_a_block_are_seen(spark, halo, block_rows):
    """Also a reach over many blocks: each row knows all rows of its group within it."""
    rows = hot_rows(1_500, 2)
    df = spark.createDataFrame(rows, "k string, v bigint, x double")

    def near(t):
        v, own = t["v"].to_numpy(), t["_own"].to_numpy()
        mine = v[own]
        n = np.searchsorted(v, mine + halo, side="right") - np.searchsorted(v, mine - halo)
        return pa.table({"v": mine, "n": n})

    found = rows_in_blocks(df, ["k"], "v", near, "v bigint, n bigint", halo=halo, block_rows=block_rows).collect()
    wanted = [(k, v, sum(1 for j, w, _ in rows if j == k and abs(w - v) <= halo)) for k, v, _ in rows]
    assert sorted(map(tuple, found), key=key) == sorted(wanted, key=key)


def test_blocks_of_nothing(spark):
    df = spark.createDataFrame([("a", None, 1.0)], "k string, v bigint, x double")
    assert apply_in_blocks(df, ["k"], "v", run_of_block("v"), RUN_STATE, longest_run, "run bigint, starts bigint").collect() == []


# --- user aggregates -------------------------------------------------------------------


def brute_median(pairs):
    pairs = sorted((v, w) for v, w in pairs if v is not None and w)
    total, upto = sum(w for _, w in pairs), 0
    for v, w in pairs:
        upto += w
        if 2 * upto >= total:
            return v


@pytest.mark.parametrize("held", [1, 100_000])
def test_weighted_median_by_brute_force(spark, held):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(40), rng.choice([None, rng.randrange(-50, 50) / 8]), rng.choice([None, 0, rng.randrange(1, 9)])) for _ in range(5_000)]
    rows.append(("only null", 1, None, 3))
    df = spark.createDataFrame(rows, "k string, l int, v double, w bigint").repartition(5)
    found = {(r["k"], r["l"]): r for r in user_aggregate(df, ["k", "l"], ["v", "w"], weighted_median("v", "w"), held).collect()}
    groups = {(k, l) for k, l, _, _ in rows}
    assert set(found) == groups
    for g in groups:
        assert found[g]["exact"] and found[g]["median"] == brute_median([(v, w) for k, l, v, w in rows if (k, l) == g])


def test_a_digest_stays_small_and_near(spark):
    df = spark.range(0, 50_000, 1, 6).select(F.lit(1).alias("k"), F.rand(4).alias("v"), F.lit(1).cast("bigint").alias("w"))
    row = user_aggregate(df, ["k"], ["v", "w"], weighted_median("v", "w", 256)).first()
    assert not row["exact"] and abs(row["median"] - 0.5) < 0.03
    assert user_aggregate(df.limit(0), ["k"], ["v", "w"], weighted_median("v", "w")).collect() == []


def test_only_states_are_shuffled(spark):
    """A user's own aggregate: the product of signs; a hot group is one state per task when it is merged."""
    merged = spark.sparkContext.accumulator(0)

    def combine(values, codes, n):
        sign = np.ones(n)
        np.multiply.at(sign, codes, np.sign(values))
        return pa.table({"sign": sign})

    def merge(states, codes, n):
        merged.add(states.num_rows)
        return combine(states["sign"].to_numpy(), codes, n)

    product = UserAggregate(lambda t, c, n: combine(t["v"].to_numpy(), c, n), merge, lambda s: s, "sign double", "sign double")
    df = spark.range(0, 60_001, 1, 6).select((F.col("id") % 2).alias("k"), F.when(F.col("id") < 3, -1.0).otherwise(2.0).alias("v"))
    assert {r["k"]: r["sign"] for r in user_aggregate(df, ["k"], ["v"], product).collect()} == {0: 1.0, 1: -1.0}
    assert merged.value < 100


# --- masks, sketches, histograms -----------------------------------------------------------


def test_a_box_of_twenty_thousand_bins(spark):
    px = spark.createDataFrame([("c", 0, 0), ("c", 20_000, 20_000), ("c", 20_000, 20_000), ("d", 3, 4)], PIXELS)
    blocks = {(r["chr"], r["block1"], r["block2"]): (r["ones"], r["blocks"]) for r in box_blocks(px, ["chr"]).collect()}
    assert blocks == {("c", 0, 0): (1, 21 * 21), ("c", 19, 19): (1, 21 * 21), ("d", 0, 0): (1, 1)}
    assert sorted(map(tuple, cells_of_blocks(mask_blocks(px, ["chr"]), ["chr"]).collect())) == [("c", 0, 0), ("c", 20_000, 20_000), ("d", 3, 4)]
    line = group_masks(px, ["chr"]).filter("chr = 'c' AND region1 = 20000")
    assert line.count() == 20_003 and line.agg(F.sum("value")).first()[0] == 1
    assert mask_long(px, 0, 20_000).filter("chr = 'c' AND region1 = 5").count() == 20_001


def test_masks_across_blocks_by_brute_force(spark):
    rng = random.Random(6)
    cells = {(rng.randrange(-1_100, 1_100), rng.randrange(1_000, 1_060)) for _ in range(200)}
    px = spark.createDataFrame([("c", a, b) for a, b in cells], PIXELS)
    mask = group_masks(px, ["chr"]).agg(F.count("*").alias("n"), F.sum("value").alias("ones")).first()
    low1, high1, low2, high2 = (f(x[i] for x in cells) for i in (0, 1) for f in (min, max))
    assert (mask["n"], mask["ones"]) == ((high1 - low1 + 3) * (high2 - low2 + 3), len(cells))
    assert {(r["region1"], r["region2"]) for r in cells_of_blocks(mask_blocks(px, ["chr"]), ["chr"]).collect()} == cells


def test_united_sketches_say_what_one_sketch_would(spark):
    df = spark.range(0, 20_000).select((F.col("id") % 7).alias("k"), (F.col("id") % 5_000).alias("v"))
    sketches = distinct_sketches(df, ["k"], "v")
    n = distinct_estimate(sketches).first()["distinct"]
    assert abs(n - 5_000) < 5_000 * 4 * 1.04 / 64
    assert n == distinct_estimate(distinct_sketches(df.withColumn("k", F.lit(0)), ["k"], "v")).first()["distinct"]


def test_histogram_chooses_round_edges(spark):
    df = spark.range(0, 1_001).select((F.col("id") / 10.0).alias("v"))
    rows = histogram(df, "v").orderBy("bin").collect()
    assert [r["upper"] for r in rows] == [10.0 * i for i in range(1, 11)] and rows[0]["lower"] == 0.0
    assert rows[0]["count"] == 101 and sum(r["count"] for r in rows) == 1_001
    same = histogram(spark.createDataFrame([(5.0,), (5.0,), (None,)], "v double"), "v").collect()
    assert len(same) == 1 and same[0]["count"] == 2 and same[0]["lower"] <= 5.0 <= same[0]["upper"]
    assert histogram(spark.createDataFrame([], "v double"), "v").collect() == []
