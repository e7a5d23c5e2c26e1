"""Queries over linked selections, user functions and the composed views."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binweave.functions.numeric import bin_by_count
from binweave.operators.geometry import TILE, axis_tile, presence, tile_name
from binweave.operators.selection import (
    diagonal_pixels,
    flag_selected,
    initial_selection,
    shown,
    tooltip,
)
from binweave.operators.summaries import (
    coarse_volcano_bins,
    group_apply,
    multi_aggregate,

    volcano_bins,
    volcano_heat,
)
from binweave.plans import sql_parts as s
from binweave.plans.aggregates import scored, tiled
from binweave.plans.registry import query
from binweave.plans.views import (
    WrittenView,
    axis_tile_outlines,
    closed_pixel_rings,
    linked_tables,
    pixel_name,
    polygon_view,
    read_linked_view,
    visible_outlines,
    write_linked_view,
)
from binweave.scratch import new_path
from binweave.sources.stand_ins import criterion, pixels, polygons

_BIN = "logFC=0.25 -log10(p)=0"
_ROWS_PER_FILE = 50_000  # small, so that there are files to choose from


def _written(spark: SparkSession, d: str, names: list[str]) -> WrittenView:
    """Some tables of the linked view, written in chunks and read back."""
    path = new_path(spark, "view")
    write_linked_view(linked_tables(pixels(spark, d), names=names), path, _ROWS_PER_FILE)
    return read_linked_view(spark, path)


@query(
    "j1_written_bin",
    s.sql(
        s.PIXELS, s.with_p(), s.volcano(),
        f"SELECT chr, region1, region2, clust FROM binned WHERE chr = 'chr1' AND volcano_bin = '{_BIN}'",
    ),
)
def written_bin(spark: SparkSession, d: str) -> DataFrame:
    """A click on a volcano bin opens the files that hold it."""
    views = _written(spark, d, ["volcano_points", "size_points"]).show({"chr": "chr1", "volcano_bin": _BIN})
    return views["volcano_zoom"].select("chr", "region1", "region2", "clust")


@query(
    "j2_written_tile",
    s.sql(
        s.PIXELS, s.TILED,
        "SELECT region1, region2, clust, clust = 406 AS selected FROM tiled WHERE chr = 'chr1' AND round_regions = '50,0'",
    ),
)
def written_tile(spark: SparkSession, d: str) -> DataFrame:
    """A click on a tile and a cluster: the tile's pixels, with those of the cluster flagged."""
    selection = {"chr": "chr1", "clust": 406, "round_regions": "50,0"}
    return _written(spark, d, ["pixels"]).show(selection)["tile_pixels"].select("region1", "region2", "clust", "selected")


@query(
    "j1_one_selector",
    s.sql(
        s.PIXELS, s.with_p(), s.volcano(),
        f"SELECT chr, region1, region2, clust, logfc FROM binned WHERE volcano_bin = '{_BIN}'",
    ),
)
def one_selector(spark: SparkSession, d: str) -> DataFrame:
    found = shown(volcano_bins(scored(spark, d)), {"volcano_bin": _BIN})
    return found.select("chr", "region1", "region2", "clust", "logfc")


@query(
    "j2_several_selectors",
    s.sql(
        s.PIXELS, s.TILED,
        "SELECT region1, region2, logfc FROM tiled WHERE chr = 'chr1' AND clust = 406 AND round_regions = '50,0'",
    ),
)
def several_selectors(spark: SparkSession, d: str) -> DataFrame:
    named = tile_name(tiled(spark, d))
    return shown(named, {"chr": "chr1", "clust": 406, "round_regions": "50,0"}).select(
        "region1", "region2", "logfc"
    )


_DIAGONAL = """
first_five AS (SELECT region1, region2 FROM pixels WHERE region1 = region2 ORDER BY chr, region1 LIMIT 5)"""


@query(
    "j3_value_set",
    s.sql(
        s.PIXELS, _DIAGONAL,
        """SELECT region1 || '-' || region2 AS r1r2, logfc FROM pixels
           WHERE (region1, region2) IN (SELECT (region1, region2) FROM first_five)""",
    ),
)
def value_set(spark: SparkSession, d: str) -> DataFrame:
    """The selection is itself a table: the first five diagonal pixels."""
    named = pixel_name(pixels(spark, d))
    return shown(named, {"r1r2": diagonal_pixels(named)}).select("r1r2", "logfc")


@query(
    "j4_flag_selected",
    s.sql(
        s.PIXELS, _DIAGONAL,
        """SELECT region1 || '-' || region2 AS r1r2, clust, clust IN (101, 406) AS in_clusters,
             (region1, region2) IN (SELECT (region1, region2) FROM first_five) AS in_pixels FROM pixels""",
    ),
)
def flagged(spark: SparkSession, d: str) -> DataFrame:
    named = pixel_name(pixels(spark, d)).select("region1", "region2", "r1r2", "clust")
    both = flag_selected(named, {"clust": [101, 406]}, "in_clusters")
    return flag_selected(both, {"r1r2": diagonal_pixels(named)}, "in_pixels").drop("region1", "region2")


_FIRST = """
best AS (SELECT chr, volcano_bin, clust FROM binned ORDER BY p_value, chr, region1, region2 LIMIT 1),
first AS (
  SELECT t.chr, t.clust, b.volcano_bin, t.round_region_x, t.round_region_y, t.round_regions
  FROM tiled t JOIN best b ON t.chr = b.chr AND t.clust = b.clust
  ORDER BY t.round_region_x, t.round_region_y LIMIT 1)"""


@query(
    "j5_initial_selection",
    s.sql(
        s.PIXELS, s.TILED, s.volcano("tiled"), _FIRST,
        "SELECT chr, clust, volcano_bin, round_region_x, round_region_y, round_regions FROM first",
    ),
)
def initial(spark: SparkSession, d: str) -> DataFrame:
    rows = tiled(spark, d)
    return tile_name(initial_selection(volcano_bins(rows), presence(rows), TILE))


@query(
    "j6_tooltip",
    s.sql(
        s.PIXELS, s.with_p(), s.COARSE,
        "SELECT chr, volcano_bin || ' pixels= ' || count(*) AS tooltip FROM coarse GROUP BY chr, volcano_bin",
    ),
)
def tooltips(spark: SparkSession, d: str) -> DataFrame:
    return tooltip(volcano_heat(coarse_volcano_bins(scored(spark, d)))).select("chr", "tooltip")


@query(
    "j7_facet",
    s.sql(
        s.POLYGONS,
        """SELECT nb_clust AS facet, round_even(x / 10e0, 0) + 0e0 AS round_x, count(*) AS "rows", max(iff) AS iff_max
           FROM polygons GROUP BY 1, 2""",
    ),
)
def facets(spark: SparkSession, d: str) -> DataFrame:
    """One view per level: the facet stays a key of the result."""
    at = F.rint(F.col("x") / 10.0) + F.lit(0.0)
    return polygons(spark, d).groupBy(F.col("nb_clust").alias("facet"), at.alias("round_x")).agg(
        F.count("*").alias("rows"), F.max("iff").alias("iff_max")
    )


@query(
    "j7_facet_tiles",
    s.sql(
        s.PIXELS, s.TILED,
        """SELECT round_regions AS facet, chr, region1, region2, rel_region_x, rel_region_y FROM tiled""",
    ),
)
def facet_tiles(spark: SparkSession, d: str) -> DataFrame:
    return tile_name(tiled(spark, d)).select(
        F.col("round_regions").alias("facet"), "chr", "region1", "region2", "rel_region_x", "rel_region_y"
    )


@query(
    "j8_linked_chain",
    s.sql(
        s.PIXELS, s.TILED, s.volcano("tiled"), _FIRST,
        """SELECT 'volcano_zoom' AS "view", b.region1, b.region2, b.clust FROM binned b JOIN first f
             ON b.chr = f.chr AND b.volcano_bin = f.volcano_bin
           UNION ALL SELECT 'cluster_pixels', b.region1, b.region2, b.clust FROM binned b JOIN first f
             ON b.chr = f.chr AND b.clust = f.clust
           UNION ALL SELECT 'tile_pixels', b.region1, b.region2, b.clust FROM binned b JOIN first f
             ON b.chr = f.chr AND b.round_regions = f.round_regions
           UNION ALL SELECT 'cluster_tiles', NULL, NULL, t.clust FROM (
             SELECT DISTINCT t.clust, t.round_regions FROM tiled t JOIN first f ON t.chr = f.chr AND t.clust = f.clust) t
           UNION ALL SELECT 'tile_label', NULL, NULL, clust FROM first""",
    ),
)
def linked_chain(spark: SparkSession, d: str) -> DataFrame:
    """From the starting selection: its bin's pixels, its cluster's pixels and tiles, its tile's pixels and label."""
    names = ["pixels", "volcano_points", "cluster_points", "presence", "labels", "first"]
    written = _written(spark, d, names)
    views = written.show_from(written.tables["first"])
    rows = {
        name: views[name].select("region1", "region2", "clust")
        for name in ("volcano_zoom", "cluster_pixels", "tile_pixels")
    }
    rows |= {name: views[name].select("clust") for name in ("cluster_tiles", "tile_label")}
    stacked = None
    for name, df in rows.items():
        part = df.withColumn("view", F.lit(name))
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    return stacked


@query(
    "j8_linked_outlines",
    s.sql(
        s.PIXELS, s.TILED, s.volcano("tiled"), _FIRST,
        s.segments("tiled", "chr, clust, round_region_x, round_region_y"),
        s.vertices("chr, clust, round_region_x, round_region_y"),
        """SELECT v.clust, (x + y) / 4e0 - v.round_region_x AS rel_region_x, (y - x) / 4e0 - v.round_region_y AS rel_region_y
           FROM verts v JOIN first f ON v.chr = f.chr AND v.round_region_x = f.round_region_x
             AND v.round_region_y = f.round_region_y WHERE keep""",
    ),
)
def linked_outlines(spark: SparkSession, d: str) -> DataFrame:
    written = _written(spark, d, ["local_outlines", "first"])
    shown_rows = written.show_from(written.tables["first"])["tile_outlines"]
    return shown_rows.select("clust", "rel_region_x", "rel_region_y")


# --- user functions ------------------------------------------------------------


def _longest_run(group: pa.Table) -> pa.Table:
    """One row per group: the most pixels in a row of adjacent anti-diagonals, and where they start.

    Which rows follow each other depends on all of the group, so no aggregate can say it.
    """
    at = np.unique(pc.add(group["region1"], group["region2"]).to_numpy())
    heads = np.flatnonzero(np.diff(at, prepend=at[0] - 2) > 1)
    sizes = np.diff(np.append(heads, len(at)))
    best = int(np.argmax(sizes))
    first = group.select(["chr", "clust", *TILE]).slice(0, 1)
    return first.append_column("run", pa.array([int(sizes[best])])).append_column("starts", pa.array([int(at[heads[best]])]))


@query(
    "k1_group_function",
    s.sql(
        s.PIXELS, s.TILED,
        """marked AS (
             SELECT *, v - row_number() OVER (PARTITION BY chr, clust, round_region_x, round_region_y ORDER BY v) AS island
             FROM (SELECT DISTINCT chr, clust, round_region_x, round_region_y, region1 + region2 AS v FROM tiled)),
           islands AS (
             SELECT chr, clust, round_region_x, round_region_y, island, count(*) AS run, min(v) AS starts
             FROM marked GROUP BY chr, clust, round_region_x, round_region_y, island)""",
        """SELECT chr, clust, round_region_x, round_region_y, run, starts FROM islands
           QUALIFY row_number() OVER (PARTITION BY chr, clust, round_region_x, round_region_y ORDER BY run DESC, starts) = 1""",
    ),
)
def group_function(spark: SparkSession, d: str) -> DataFrame:
    """A Python function from a group's rows to a table.

    The group is a cluster within a tile: a tile's area bounds its rows, however
    large the cluster is.
    """
    keys = ["chr", "clust", *TILE]
    schema = "chr string, clust int, round_region_x double, round_region_y double, run bigint, starts bigint"
    rows = tiled(spark, d).select(*keys, "region1", "region2")
    return group_apply(rows, keys, _longest_run, schema, most_rows=100_000)


@query(
    "k_visible_outlines",
    s.sql(
        s.PIXELS,
        """seen AS (SELECT DISTINCT chr, clust FROM pixels WHERE region2 < region1 + 3),
           visible AS (SELECT p.* FROM pixels p JOIN seen USING (chr, clust))""",
        s.segments("visible", "chr, clust"), s.vertices("chr, clust"),
        "SELECT chr, clust, x / 2e0 AS x, y / 2e0 AS y FROM verts WHERE keep",
    ),
)
def outlines_of_visible(spark: SparkSession, d: str) -> DataFrame:
    """Corners of the whole outlines of the clusters that a band of pixels shows."""
    px = pixels(spark, d)
    found = visible_outlines(px, px.filter("region2 < region1 + 3"))
    return found.select("chr", "clust", F.col("region1").alias("x"), F.col("region2").alias("y"))


@query(
    "k_axis_tile_outlines",
    s.sql(
        s.PIXELS, s.AXIS_TILED, s.segments("axis_tiled", "chr, clust, round_r1r2"), s.vertices("chr, clust, round_r1r2"),
        "SELECT chr, clust, round_r1r2, x / 2e0 AS x, y / 2e0 AS y FROM verts WHERE keep",
    ),
)
def outlines_in_axis_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Corners of the clusters' outlines within tiles of the unrotated axes."""
    cut_up = axis_tile_outlines(axis_tile(scored(spark, d), 100.0))
    return cut_up.select("chr", "clust", "round_r1r2", F.col("region1").alias("x"), F.col("region2").alias("y"))


@query(
    "k_closed_pixel_rings",
    s.sql(
        s.PIXELS,
        """SELECT chr, region1, region2, c.corner_ord, region1 + c.d1 AS corner1, region2 + c.d2 AS corner2
           FROM pixels CROSS JOIN (
             VALUES (1, -0.4::DOUBLE, -0.4::DOUBLE), (2, -0.4::DOUBLE, 0.4::DOUBLE), (3, 0.4::DOUBLE, 0.4::DOUBLE),
                    (4, 0.4::DOUBLE, -0.4::DOUBLE), (5, -0.4::DOUBLE, -0.4::DOUBLE)) c(corner_ord, d1, d2)""",
    ),
)
def pixel_rings(spark: SparkSession, d: str) -> DataFrame:
    rings = closed_pixel_rings(pixels(spark, d).select("chr", "region1", "region2"))
    return rings.select("chr", "region1", "region2", "corner_ord", "corner1", "corner2")


@query(
    "k_criterion_intervals",
    s.sql(
        s.CRITERION,
        """SELECT nb_clust, crit, nb_clust - coalesce(nb_clust - before, after - nb_clust) / 2e0 AS lower,
             nb_clust + coalesce(after - nb_clust, nb_clust - before) / 2e0 AS upper
           FROM (SELECT *, lag(nb_clust) OVER (ORDER BY nb_clust) AS before, lead(nb_clust) OVER (ORDER BY nb_clust) AS after
                 FROM criterion)""",
    ),
)
def criterion_intervals(spark: SparkSession, d: str) -> DataFrame:
    """The criterion by level, with the interval in which a level is clicked."""
    return polygon_view(polygons(spark, d), criterion=criterion(spark, d))["criterion"].select("nb_clust", "crit", "lower", "upper")


@query(
    "k2_user_aggregate",
    s.sql(
        s.PIXELS, s.with_p(),
        """SELECT chr, clust, max(logfc) - min(logfc) AS logfc_spread, count(DISTINCT logfc) AS logfc_n_uniq
           FROM scored GROUP BY chr, clust""",
    ),
)
def user_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """Aggregates composed by the user next to built-in ones."""
    functions = {"spread": lambda c: F.max(c) - F.min(c), "n_uniq": F.count_distinct}
    return multi_aggregate(scored(spark, d), ["chr", "clust"], functions, ["logfc"])


@query(
    "k3_function_over_columns",
    s.sql(
        s.PIXELS,
        """SELECT chr, region1, region2, region1 % 50 AS in_50_region1, region2 % 50 AS in_50_region2 FROM pixels""",
    ),
)
def over_columns(spark: SparkSession, d: str) -> DataFrame:
    """One function applied to each of several columns."""
    columns = ["region1", "region2"]
    return pixels(spark, d).select(
        "chr", *columns, *[(F.col(c) % 50).alias(f"in_50_{c}") for c in columns]
    )


@query(
    "k4_scalar_helper",
    s.sql(
        s.PIXELS,
        "SELECT region1, region2, round_even(logfc * 2e0, 0) / 2e0 + 0e0 AS half FROM pixels",
    ),
)
def scalar_helper(spark: SparkSession, d: str) -> DataFrame:
    """Helpers are functions from Column to Column: no UDF."""
    return pixels(spark, d).select(
        "region1", "region2", bin_by_count(F.col("logfc"), 2.0).alias("half")
    )


@query(
    "linked_tile_summary",
    s.sql(
        s.PIXELS, s.TILED,
        """SELECT chr, round_regions, count(*) AS pixels, count(DISTINCT clust) AS clusters, avg(logfc) AS mean_logfc,
             round_region_x - 20e0 AS x, round_region_y + 24e0 AS y
           FROM tiled GROUP BY chr, round_regions, round_region_x, round_region_y""",
    ),
)
def linked_tiles(spark: SparkSession, d: str) -> DataFrame:
    return linked_tables(pixels(spark, d), names=["tiles"])["tiles"].select(
        "chr", "round_regions", "pixels", "clusters", "mean_logfc", "x", "y"
    )
