"""Headline queries, timed; prints one JSON line.

Every query is run in full into Spark's ``noop`` sink; ``view_write`` and ``view_click`` time writing a
linked view and a click on it apart.  ``BENCH_SF_DIR`` and
``BENCH_CPUS`` choose the tables and the cores; ``BENCH_QUERIES`` narrows the list.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from binweave.plans import catalog
from binweave.plans.views import linked_tables, read_linked_view, write_linked_view
from binweave.scratch import new_path
from binweave.session import local_session
from binweave.sources.stand_ins import pixels

HEADLINE = [
    "b6_window",
    "c9_profile",
    "c10_tile_summary",
    "c12_volcano_heat",
    "c15_cluster_sizes",
    "c17_size_heat",
    "c19_joined_text",
    "c27_grid_counts",
    "d1_group_relative",
    "d2_row_number",
    "d4_first_id",
    "e2_outer_join",
    "e3_missing_pixels",
    "e4_label_by_tile",
    "e10_pixels_to_polygons",
    "a4_chunks",
    "a6_restored",
    "i4_tile_corners_relative",
    "i9_segments",
    "i10_simplified",
    "i11_cluster_outlines",
    "i12_local_outlines",
    "i15_ring_roles",
    "j8_linked_chain",
]
# Timed too, but not part of the total, which stays comparable from round to round.
ALSO = ["e3_missing_runs", "k1_longest_run", "k2_weighted_median"]
VIEW = ["pixels", "volcano_points", "cluster_points", "presence", "labels", "first"]
CLICKED = ["volcano_zoom", "cluster_pixels", "tile_pixels", "cluster_tiles", "tile_label"]


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(spark: SparkSession, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    run(catalog.QUERIES[name](spark, sf_dir))
    return round(time.perf_counter() - start, 3)


def view_times(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """Seconds to write a view, and to show what one selection opens in five of its tables."""
    path = new_path(spark, "view")
    start = time.perf_counter()
    write_linked_view(linked_tables(pixels(spark, sf_dir), names=VIEW), path, 50_000)
    written = time.perf_counter()
    view = read_linked_view(spark, path)
    selection = view.tables["first"].first().asDict()
    opened = time.perf_counter()
    shown = view.show(selection)
    for name in CLICKED:
        run(shown[name])
    return {"view_write": round(written - start, 3), "view_click": round(time.perf_counter() - opened, 3)}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    # One untimed run starts the JVM's code paths and the Python workers.
    for warm in ("c10_tile_summary", "i12_local_outlines"):
        run(catalog.QUERIES[warm](spark, sf_dir))
    times = {name: timed(spark, sf_dir, name) for name in names}
    also = {}
    if names == HEADLINE:
        also = {name: timed(spark, sf_dir, name) for name in ALSO} | view_times(spark, sf_dir)
    print(
        json.dumps(
            {
                "metric": "total time of headline matrix queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "also": also,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
