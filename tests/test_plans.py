"""Shape of the physical plans: what must not appear at any size."""

import re

import pytest

from binweave.operators.boundary import segments, vertices
from binweave.operators.geometry import corner_extents, tiled_pixels
from binweave.operators.summaries import cluster_sizes, size_bins, size_points, tile_summary, volcano_bins, volcano_heat, with_p
from binweave.plans import catalog
from binweave.sources.stand_ins import pixels


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def has_global_window(text):
    """A window fed by a single partition: it has no partition key."""
    lines = [re.sub(r"^[\s:+|-]*(\*\(\d+\) )?", "", line) for line in text.splitlines()]
    return any(
        line.startswith("Window ")
        and any(after.startswith("Exchange SinglePartition") for after in lines[i + 1 : i + 4])
        for i, line in enumerate(lines)
    )


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_cartesian_product_or_global_window(spark, sf_dir, name):
    text = plan(catalog.QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert not has_global_window(text)


def test_core_operators_stay_in_the_jvm(spark, sf_dir):
    px = with_p(pixels(spark, sf_dir))
    tiled = tiled_pixels(px)
    keys = ["chr", "clust"]
    for df in (
        tile_summary(tiled),
        volcano_heat(volcano_bins(px)),
        size_points(size_bins(cluster_sizes(tiled))),
        segments(px, keys),
        vertices(segments(px, keys), keys),
        corner_extents(tiled),
    ):
        text = plan(df)
        assert "Python" not in text and "InArrow" not in text and "InPandas" not in text


def test_tiles_and_volcano_need_one_pass(spark, sf_dir):
    """Scans read only the columns used; the tile summary never expands corners."""
    px = with_p(pixels(spark, sf_dir))
    text = plan(tile_summary(tiled_pixels(px)))
    assert "Generate" not in text
    assert text.count("Scan parquet") == 1
    assert "l_extendedprice" not in text


def test_outline_takes_two_shuffles(spark, sf_dir):
    """Beyond the stand-in's own: dual cells, then vertices; rows are merged before each."""
    keys = ["chr", "clust"]
    px = pixels(spark, sf_dir)
    own = plan(px).count("Exchange hashpartitioning")
    text = plan(vertices(segments(px, keys), keys))
    assert text.count("Exchange hashpartitioning") == own + 2
    assert "partial_bit_or" in text


def test_same_shape_at_ten_times_the_size(spark):
    """With size-based broadcasts off, plans do not depend on the tables' size."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("c10_tile_summary", "c27_grid_counts", "d1_group_relative", "d2_row_number", "e3_missing_pixels",
                     "e10_pixels_to_polygons", "i10_simplified", "a6_restored"):
            shapes = []
            for sf in ("sf0.001", "sf0.01"):
                text = plan(catalog.QUERIES[name](spark, f"/root/testdata/{sf}"))
                shapes.append(re.findall(r"\b(\w+(?:Join|Aggregate|Exchange|Window|Generate))\b", text))
                # What is still broadcast is hinted: hot-key lists and the shared shape.
                hinted = text.count("BroadcastExchange")
                assert hinted == {"d1_group_relative": 2, "e10_pixels_to_polygons": 2, "a6_restored": 1}.get(name, 0)
            assert shapes[0] == shapes[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
