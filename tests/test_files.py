"""Readers, chunk files, audit and the linked view on disk."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binweave.operators.geometry import corners, position_name, relative_corners, relative_shape, tiled_pixels
from binweave.plans.files import chunk_index
from binweave.plans.views import (
    ABOUT,
    TABLES,
    axis_view,
    linked_from,
    linked_tables,
    linked_view,
    missing_report,
    outline_report,
    polygon_view,
    read_linked_view,
    volcano_view,
    write_linked_view,
)
from binweave.sinks.chunk_index import IndexedChunks, write_indexed_chunks
from binweave.sinks.chunks import (
    audit_chunks,
    chunk_files,
    dependent_columns,
    factor_common,
    read_bucketed_chunk,
    read_chunks,
    write_bucketed_chunks,
    write_chunks,
)
from binweave.sources.stand_ins import pixels, polygons
from binweave.sources.tables import (
    PIXEL_SCHEMA,
    read_partitioned,
    read_pixels,
    read_tsv,
    tsv_path,
    write_partitioned,
)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_read_pixels(spark, tmp_path):
    path = tsv_path(str(tmp_path), "pixels", 19, 50000)
    assert path.endswith("/pixels_chr19_50000.tsv")
    with open(path, "w") as f:
        f.write("chr\tregion1\tregion2\tp.value\textra\tlogFC\tclust\n")
        f.write("chr19\t5\t7\t0.01\tx\t-1.5\t3\n")
        f.write("chr19\t5\t8\tNA\tx\tInf\tNA\n")
    df = read_pixels(spark, path)
    assert df.schema == PIXEL_SCHEMA
    assert [tuple(r) for r in df.orderBy("region2").collect()] == [
        ("chr19", 5, 7, 3, -1.5, 0.01),
        ("chr19", 5, 8, None, float("inf"), None),
    ]
    with pytest.raises(ValueError, match="other"):
        read_tsv(spark, path, T.StructType([T.StructField("other", T.LongType())]))


def test_files_may_differ_in_order_but_must_hold_numbers(spark, tmp_path):
    head = "chr\tregion1\tregion2\tclust\tlogFC\tp.value\n"
    files = {
        "a": head + "chr1\t5\t7\t1\t0.5\t0.1\n",
        "b": head.replace("region1\tregion2", "region2\tregion1") + "chr1\t8\t6\t2\t0.5\t0.1\n",
        "c": "p.value\textra\tlogFC\tclust\tregion2\tregion1\tchr\n0.25\tx\t-1\t3\t9\t4\tchr2\n",
        "d": head + "chr1\t1\t2\tNA\t0.5\t0.1\n",
    }
    for name, lines in files.items():
        (tmp_path / f"{name}.tsv").write_text(lines)
    df = read_pixels(spark, str(tmp_path))
    assert df.schema == PIXEL_SCHEMA
    assert sorted(tuple(r)[:4] for r in df.select("chr", "region1", "region2", "clust").collect()) == [
        ("chr1", 1, 2, None), ("chr1", 5, 7, 1), ("chr1", 6, 8, 2), ("chr2", 4, 9, 3)]
    assert df.filter("chr = 'chr2' AND logfc = -1 AND p_value = 0.25").count() == 1
    (tmp_path / "e.tsv").write_text("chr\tregion1\nchr1\t5\n")
    with pytest.raises(ValueError, match="region2"):
        read_pixels(spark, str(tmp_path))
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "x.tsv").write_text(head + "chr1\t5\t7\t1\t0.5\tbad\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_pixels(spark, str(bad)).collect()


def test_partitions_and_filters_reach_the_scan(spark, sf_dir, tmp_path):
    root = str(tmp_path / "px")
    write_partitioned(pixels(spark, sf_dir), root, 50000)
    df = read_partitioned(spark, root, ["chr1"], 50000).filter("region1 <= 100 AND region2 <= 100")
    text = plan(df.select("logfc"))
    assert "PartitionFilters: [" in text and "chr#" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert "LessThanOrEqual(region1,100)" in text and "LessThanOrEqual(region2,100)" in text
    assert "p_value" not in text.split("ReadSchema")[1]
    whole = read_partitioned(spark, root)
    assert whole.count() == pixels(spark, sf_dir).count()
    assert read_partitioned(spark, root, ["chr7"]).count() == 0


def test_one_selection_opens_one_folder(spark, sf_dir, tmp_path):
    path = str(tmp_path / "c")
    px = pixels(spark, sf_dir).select("region1", "logfc", "chr", "clust")
    write_chunks(px.filter("clust < 120"), ["chr", "clust"], path)
    assert len(os.listdir(f"{path}/chr=chr1")) == px.filter("clust < 120").select("clust").distinct().count()
    one = read_chunks(spark, path, px.schema).filter("chr = 'chr1' AND clust = 101")
    assert one.count() == px.filter("clust = 101").count()
    assert "clust" in plan(one).split("PartitionFilters: [")[1].split("]")[0]


def test_large_chunks_split_into_files(spark, tmp_path):
    path = str(tmp_path / "big")
    df = spark.range(1000).select("id", F.lit("hot").alias("s"))
    write_chunks(df, ["s"], path, rows_per_file=100)
    assert chunk_files(spark, path).count() >= 10
    assert read_chunks(spark, path, df.schema).count() == 1000


def test_hot_chunk_is_split_over_tasks(spark, tmp_path):
    """Adaptive execution splits a selector value that is too large for one task."""
    path = str(tmp_path / "hot")
    rows = spark.range(0, 300_000, 1, 8).select(
        F.sha2(F.col("id").cast("string"), 256).alias("v"),
        F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(-1).alias("s"),
    )
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "1m")
    try:
        write_chunks(rows, ["s"], path)
    finally:
        spark.conf.set(name, before)
    assert sum(n.endswith(".csv") for n in os.listdir(f"{path}/s=-1")) > 3
    assert sum(n.endswith(".csv") for n in os.listdir(f"{path}/s=3")) == 1
    assert read_chunks(spark, path, rows.schema).count() == 300_000


def test_no_selectors_is_one_folder(spark, tmp_path):
    path = str(tmp_path / "plain")
    write_chunks(spark.range(10), [], path)
    assert all(not os.path.isdir(f"{path}/{n}") for n in os.listdir(path))


def test_buckets(spark, sf_dir, tmp_path):
    path = str(tmp_path / "b")
    px = pixels(spark, sf_dir)
    write_bucketed_chunks(px, ["chr", "clust"], path, 8)
    assert sum(n.startswith("bucket=") for n in os.listdir(path)) <= 8
    found = read_bucketed_chunk(spark, path, {"chr": "chr1", "clust": 203}, 8)
    assert found.count() == px.filter("clust = 203").count() > 0
    assert "bucket" in plan(found).split("PartitionFilters: [")[1].split("]")[0]


def test_a_click_opens_one_file(spark, sf_dir, tmp_path):
    path = str(tmp_path / "i")
    px = pixels(spark, sf_dir).select("region1", "logfc", "chr", "clust")
    write_indexed_chunks(px, ["chr", "clust"], path, 300)
    chunks = IndexedChunks(spark, path, px.schema, ["chr", "clust"])
    index = chunks.index.collect()
    assert len(index) > 5 and sum(r["rows"] for r in index) == px.count() == chunks.all().count()
    assert all(a["greatest"] <= b["least"] for a, b in zip(index, index[1:]))
    for clust in [r["clust"] for r in px.select("clust").distinct().orderBy("clust").collect()][::25]:
        found = chunks.read({"chr": "chr1", "clust": clust})
        assert found.count() == px.filter(F.col("clust") == clust).count() > 0
        assert len(found.inputFiles()) <= 2
    assert len(chunks.files({"chr": "chr1"})) == len(index)
    assert chunks.files({"chr": "chr7"}) == [] and chunks.read({"chr": "chr7"}).count() == 0
    assert len(chunks.files({"clust": 203})) == len(index)  # not a leading selector: the index can't tell
    assert chunks.read({"clust": 203}).count() == px.filter("clust = 203").count()


def test_indexed_chunks_with_hot_and_missing_values(spark, tmp_path):
    rows = spark.range(0, 9_000, 1, 4).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.concat(F.lit("v"), (F.col("id") % 200).cast("string"))).alias("s")
    )
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / fmt)
        write_indexed_chunks(rows, ["s"], path, 500, fmt)
        chunks = IndexedChunks(spark, path, rows.schema, ["s"], fmt)
        assert chunks.index.agg(F.max("rows")).first()[0] < 1_500  # neither the hot value nor NULL is one file
        assert chunks.read({"s": "hot"}).count() == chunks.read({"s": None}).count() == 3_000
        assert chunks.read({"s": "v1"}).count() == rows.filter("s = 'v1'").count() > 0
        assert len(chunks.read({"s": "v1"}).inputFiles()) <= 2
    write_indexed_chunks(rows.limit(0), ["s"], str(tmp_path / "empty"), 500)
    empty = IndexedChunks(spark, str(tmp_path / "empty"), rows.schema, ["s"])
    assert empty.all().count() == 0 and empty.read({"s": "hot"}).count() == 0


def test_small_chunk_files_share_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("binweave.sinks.chunk_index.TASK_ROWS", 2_000)
    rows = spark.range(0, 20_000, 1, 4).select("id", (F.col("id") % 700).alias("s"))
    path = str(tmp_path / "many")
    write_indexed_chunks(rows, ["s"], path, 50)
    chunks = IndexedChunks(spark, path, rows.schema, ["s"])
    index = chunks.index.collect()
    assert sum(r["rows"] for r in index) == 20_000 and max(r["rows"] for r in index) <= 50 and len(index) >= 400
    assert all(a["greatest"] <= b["least"] for a, b in zip(index, index[1:]))
    assert len({r["file"].split("-")[1] for r in index}) <= 11  # tasks, not one per file
    for s in (0, 333, 699):
        assert chunks.read({"s": s}).count() == rows.filter(F.col("s") == s).count() > 0


def test_order_of_the_index_takes_one_sort(spark, sf_dir):
    text = chunk_index(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    inner = text.partition("lambdafunction(")[2].partition("lambda ")[0]
    # Sorted inside a function of one range, all ranges would be sorted again for each.
    assert "lambdafunction(" in text and "sort_array" not in inner


def test_dependent_columns_and_a_check_on_what_is_shared(spark):
    rows = spark.createDataFrame(
        [("a", 1, 10, None, 1.0), ("a", 1, 10, None, 2.0), ("a", 2, 10, "x", 3.0), (None, 1, 11, "y", 3.0), (None, 1, 11, None, 3.0)],
        "k string, l int, of_k int, of_kl string, v double",
    )
    found = {(r["keys"], r["column"]) for r in dependent_columns(rows, [["k"], ["k", "l"]], ["of_k", "of_kl", "v"]).collect()}
    assert found == {("k", "of_k"), ("k,l", "of_k")}
    known = rows.filter("k IS NOT NULL")
    found = {(r["keys"], r["column"], r["groups"]) for r in dependent_columns(known, [["k"], ["k", "l"]], ["of_k", "of_kl", "v"]).collect()}
    assert found == {("k", "of_k", 1), ("k,l", "of_k", 2), ("k,l", "of_kl", 2)}
    assert factor_common(known, ["k", "l"], ["of_k", "of_kl"])[0].count() == 2
    with pytest.raises(Exception, match="no function of k"):
        factor_common(known, ["k"], ["of_k", "of_kl"])[0].collect()


def test_audit_finds_wrong_and_absent_files(spark, sf_dir, tmp_path):
    path = str(tmp_path / "a")
    write_chunks(pixels(spark, sf_dir).filter("clust < 104"), ["clust"], path)
    files = chunk_files(spark, path)
    listed = [(r["name"], r["bytes"]) for r in files.collect()]
    for name, size in listed:
        assert os.path.getsize(name.removeprefix("file:")) == size
    wrong = [(listed[0][0], listed[0][1] + 5), *listed[1:], ("gone.csv", 7)]
    listing = spark.createDataFrame(wrong, "name string, du_bytes bigint")
    assert {r["name"] for r in audit_chunks(files, listing).collect()} == {listed[0][0], "gone.csv"}


def test_factoring_is_lossless_and_smaller(spark, sf_dir):
    tiled = position_name(tiled_pixels(pixels(spark, sf_dir)))
    whole = relative_corners(corners(tiled, 0.45, closed=True)).select(
        "region1", "region2", "logfc", "rel_regions", "corner_ord", "rel_corner_x", "rel_corner_y"
    )
    dim, fact = factor_common(whole, ["rel_regions", "corner_ord"], ["rel_corner_x", "rel_corner_y"])
    back = fact.join(dim, ["rel_regions", "corner_ord"]).select(*whole.columns)
    assert back.exceptAll(whole).isEmpty() and whole.exceptAll(back).isEmpty()
    shape = position_name(relative_shape(tiled)).select(*dim.columns)
    assert shape.exceptAll(dim).isEmpty() and dim.exceptAll(shape).isEmpty()
    assert dim.count() < whole.count()


def test_linked_view_end_to_end(spark, sf_dir, tmp_path):
    tables = linked_tables(pixels(spark, sf_dir))
    assert set(tables) == set(TABLES)
    first = tables["first"].first().asDict()
    views = linked_view(tables, first)
    chained = linked_from(tables, tables["first"])
    for name in chained:
        assert views[name].count() == chained[name].count() > 0
    assert views["tile_outlines"].filter("selected").count() > 0
    assert views["size_zoom"].count() == tables["size_points"].count()  # no size bin chosen yet
    path = str(tmp_path / "view")
    write_linked_view(tables, path, 500)
    assert set(os.listdir(path)) == {*TABLES, ABOUT}
    written = read_linked_view(spark, path)
    assert set(written.tables) == set(TABLES)
    mine = {"chr": first["chr"], "clust": first["clust"]}
    assert written.chunks["outlines"].read(mine).count() == views["cluster_outline"].count() > 0
    clicked = written.show(first)
    assert {name: df.count() for name, df in clicked.items()} == {name: df.count() for name, df in views.items()}
    for name, df in written.show_from(written.tables["first"]).items():
        assert df.count() == clicked[name].count()
    for name in ("volcano_zoom", "cluster_pixels", "cluster_outline", "tile_pixels", "tile_outlines", "tile_label"):
        assert 1 <= len(clicked[name].inputFiles()) <= 2
    with pytest.raises(ValueError, match="more than one row"):
        written.show_from(tables["tiles"].select(F.lit("chr1").alias("chr"), F.lit(1).alias("clust")))
    assert tables["tiles"].agg(F.sum("pixels")).first()[0] == tables["pixels"].count()
    small = linked_tables(pixels(spark, sf_dir), greatest=100, log2_tiles=True, names=["tiles", "size_heat"])
    assert small["tiles"].agg(F.sum("corner_rows")).first()[0] == 5 * pixels(spark, sf_dir).filter(
        "region1 <= 100 AND region2 <= 100"
    ).count()


def test_reports(spark, sf_dir):
    px = pixels(spark, sf_dir)
    report = missing_report(px, 60)
    assert report["missing"].count() == report["counts"].first()["missing"]
    whole = missing_report(px)
    assert set(whole) == {"runs", "counts"}
    assert whole["runs"].agg(F.sum("cells")).first()[0] == whole["counts"].first()["missing"]
    outline = outline_report(px, 0, 60)
    sizes = {r["data_type"]: r["n"] for r in outline["sizes"].groupBy("data_type").agg(F.sum("rows").alias("n")).collect()}
    rings = outline["outlines"].select("data_type", "chr", "clust", "ring_x", "ring_y").distinct()
    closing = {r["data_type"]: r["count"] for r in rings.groupBy("data_type").count().collect()}
    rows = {r["data_type"]: r["count"] for r in outline["outlines"].groupBy("data_type").count().collect()}
    assert rows == {k: sizes[k] + closing[k] for k in rows}
    assert sizes["pixel"] == outline["pixels"].count()
    view = polygon_view(polygons(spark, sf_dir))
    assert view["polygons"].filter("rel_x < 0 OR rel_y < 0").isEmpty()
    assert view["first_extents"].count() > 0 and view["counts"].count() == 7


def test_volcano_and_axis_views(spark, sf_dir):
    px = pixels(spark, sf_dir)
    view = volcano_view(px, 40, 150)
    n = px.filter("region2 < region1 + 40 AND region2 < 150").count()
    assert view["pixels"].count() == n and view["corners"].count() == 4 * n
    assert view["volcano_heat"].agg(F.sum("pixels")).first()[0] == n
    assert view["first"].filter("region1 <> region2").isEmpty() and view["first"].count() == 5
    assert view["color_scale"].filter("height < 0").isEmpty()
    axis = axis_view(px, 50.0)
    assert axis["tiles"].agg(F.sum("pixels")).first()[0] == px.count()
    assert axis["corners"].count() == 5 * px.count()
    assert axis["tile_corners"].count() == 5 * axis["tiles"].count()
    assert axis["spacing"].first()["spacing"] == 50.0
    # Offsets of a shared place repeat exactly in every tile.
    places = axis["corners"].select("rel_regions", "corner_ord", F.round("rel_x", 6), F.round("rel_y", 6)).distinct()
    assert places.groupBy("rel_regions", "corner_ord").count().filter("count > 1").isEmpty()
