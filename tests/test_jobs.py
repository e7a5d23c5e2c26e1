"""Command-line jobs write the tables of their view."""

import os

import pytest

from binweave import jobs
from binweave.plans.views import INDEXED, TABLES
from binweave.sinks.chunk_index import INDEX, ROWS
from binweave.sources.stand_ins import pixels, polygons
from binweave.sources.tables import write_partitioned


@pytest.fixture(scope="module")
def inputs(spark, sf_dir, tmp_path_factory):
    root = tmp_path_factory.mktemp("in")
    write_partitioned(pixels(spark, sf_dir), f"{root}/px", 50000)
    drawn = polygons(spark, sf_dir)
    drawn.filter("x < 40").write.option("sep", "\t").option("header", True).csv(f"{root}/polygons.tsv")
    named = pixels(spark, sf_dir).filter("region2 < 90").withColumnsRenamed({"logfc": "logFC", "p_value": "p.value"})
    named.write.option("sep", "\t").option("header", True).csv(f"{root}/pixels.tsv")
    return str(root)


@pytest.mark.parametrize(
    "job,options,tables",
    [
        ("linked", ["--format", "tsv", "--pixels", "{}/pixels.tsv", "--greatest", "80"], {*TABLES, "about"}),
        ("volcano", ["--pixels", "{}/px", "--chr", "chr1"], {"pixels", "corners", "volcano_heat", "color_scale", "first", "outlines"}),
        ("axis", ["--pixels", "{}/px", "--width", "50"], {"pixels", "corners", "tiles", "tile_corners", "spacing", "outlines"}),
        ("missing", ["--pixels", "{}/px", "--max-distance", "49"], {"missing", "counts"}),
        ("missing", ["--pixels", "{}/px"], {"runs", "counts"}),
        ("outlines", ["--pixels", "{}/px", "--low", "0", "--high", "60"], {"outlines", "pixels", "sizes", "labels"}),
        ("polygons", ["--polygons", "{}/polygons.tsv"], {"counts", "polygons", "tile_means", "first_extents"}),
    ],
)
def test_job(spark, inputs, tmp_path, job, options, tables):
    out = str(tmp_path / job)
    jobs.main([job, "--out", out, *[o.format(inputs) for o in options]])
    assert set(os.listdir(out)) == tables
    for name in tables:
        # Tables with an index keep it beside their rows.
        parts = [f"{out}/{name}/{part}" for part in (ROWS, INDEX)] if job == "linked" and name in INDEXED else [f"{out}/{name}"]
        assert all("_SUCCESS" in os.listdir(part) for part in parts)


def test_tsv_takes_chromosomes_and_no_resolution(spark, inputs, tmp_path):
    out = str(tmp_path / "one")
    jobs.main(["missing", "--format", "tsv", "--pixels", f"{inputs}/pixels.tsv", "--chr", "chr9", "--max-distance", "5", "--out", out])
    counts = spark.read.option("header", True).option("sep", "\t").csv(f"{out}/counts").first()
    assert counts is None or int(counts["possible"] or 0) == 0
    with pytest.raises(SystemExit, match="resolution"):
        jobs.main(["missing", "--format", "tsv", "--pixels", f"{inputs}/pixels.tsv", "--resolution", "5", "--out", f"{out}2"])
