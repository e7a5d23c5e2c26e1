"""Queries over matrix geometry: rotation, corners, tiles, outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binweave.operators.boundary import (
    bounding_boxes,
    group_areas,
    segments,
    simplified_vertices,
    vertices,
)
from binweave.operators.geometry import (
    TILE,
    axis_relative_corners,
    axis_tile,
    corner_extents,
    corners,
    label_anchor,
    polygon_tiles,
    position_name,
    presence,
    relative_corners,
    rotate,
    tile,
    tile_center,
    tile_corners,
    tile_name,
    tiled_pixels,
)
from binweave.operators.masks import box_blocks, cells_of_blocks, group_masks, mask_blocks, mask_long
from binweave.operators.relational import relative_to_least, tagged_union
from binweave.operators.rings import outlines, ring_roles, rings
from binweave.operators.summaries import (
    REPRESENTATIONS,
    representation_labels,
    representation_sizes,
    tile_summary,
)
from binweave.plans import sql_parts as s
from binweave.plans.aggregates import (
    POLYGON_REL,
    POLYGON_TILES,
    REPRESENTATION,
    scored,
    tiled,
)
from binweave.plans.registry import query
from binweave.sources.stand_ins import pixels, polygons

CLUSTER = ["chr", "clust"]
CLUSTER_SQL = "chr, clust"
LOCAL = ["chr", "clust", *TILE]
LOCAL_SQL = "chr, clust, round_region_x, round_region_y"


@query(
    "i1_rotate",
    s.sql(s.PIXELS, s.with_p(), "SELECT region1, region2, region_x, region_y FROM scored"),
)
def rotated(spark: SparkSession, d: str) -> DataFrame:
    return rotate(pixels(spark, d), "region").select("region1", "region2", "region_x", "region_y")


def _corner_sql(half: str, closed: bool) -> str:
    ring = [(1, "-", "-"), (2, "-", "+"), (3, "+", "+"), (4, "+", "-")] + ([(5, "-", "-")] if closed else [])
    return " UNION ALL ".join(
        f"""SELECT region1, region2, {n} AS corner_ord, region1 {a} {half} AS corner1, region2 {b} {half} AS corner2,
            ((region1 {a} {half}) + (region2 {b} {half})) / 2e0 AS corner_x,
            ((region2 {b} {half}) - (region1 {a} {half})) / 2e0 AS corner_y FROM pixels"""
        for n, a, b in ring
    )


@query("i2_open_corners", s.sql(s.PIXELS, _corner_sql("0.5::DOUBLE", False)))
def open_corners(spark: SparkSession, d: str) -> DataFrame:
    return corners(pixels(spark, d).select("region1", "region2"), 0.5)


@query("i3_closed_corners", s.sql(s.PIXELS, _corner_sql("0.4::DOUBLE", True)))
def closed_corners(spark: SparkSession, d: str) -> DataFrame:
    return corners(pixels(spark, d).select("region1", "region2"), 0.4, closed=True)


@query(
    "i4_tile",
    s.sql(
        s.PIXELS, s.TILED,
        f"""SELECT region1, region2, round_region_x, round_region_y, rel_region_x, rel_region_y, round_regions,
             {s.number_text('rel_region_x')} || ',' || {s.number_text('rel_region_y')} AS rel_regions FROM tiled""",
    ),
)
def tile_columns(spark: SparkSession, d: str) -> DataFrame:
    named = position_name(tile_name(tiled_pixels(pixels(spark, d))))
    return named.select(
        "region1", "region2", *TILE, "rel_region_x", "rel_region_y", "round_regions", "rel_regions"
    )


@query(
    "i4_tile_corners_relative",
    s.sql(
        s.PIXELS, s.TILED, s.EXTENTS,
        "SELECT region1, region2, corner_ord, rel_corner_x, rel_corner_y FROM rel_corners",
    ),
)
def relative(spark: SparkSession, d: str) -> DataFrame:
    narrow = tiled_pixels(pixels(spark, d)).select("region1", "region2", *TILE)
    return relative_corners(corners(narrow, 0.45, closed=True)).select(
        "region1", "region2", "corner_ord", "rel_corner_x", "rel_corner_y"
    )


@query(
    "i4_tile_small",
    s.sql(
        s.PIXELS, s.with_p(),
        """SELECT region1, region2, round_even((region_x + 0e0) / 10e0, 0) * 10e0 + 0e0 AS round_region_x,
             round_even((region_y - 5e0) / 10e0, 0) * 10e0 + 0e0 AS round_region_y,
             region_x - round_even((region_x + 0e0) / 10e0, 0) * 10e0 AS rel_region_x,
             region_y - (round_even((region_y - 5e0) / 10e0, 0) * 10e0 + 0e0) AS rel_region_y FROM scored""",
    ),
)
def small_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Another width and offset, with several tiles along the distance axis."""
    found = tile(rotate(pixels(spark, d), "region"), 10.0, (0.0, -5.0))
    return found.select("region1", "region2", *TILE, "rel_region_x", "rel_region_y")


@query(
    "i5_axis_tile",
    s.sql(
        s.PIXELS, s.AXIS_TILED,
        """SELECT region1, region2, round_region1, round_region2, rel_region1, rel_region2, r1r2, round_r1r2 FROM axis_tiled""",
    ),
)
def axis_tiles(spark: SparkSession, d: str) -> DataFrame:
    return axis_tile(pixels(spark, d)).select(
        "region1", "region2", "round_region1", "round_region2", "rel_region1", "rel_region2", "r1r2", "round_r1r2"
    )


@query(
    "i6_tile_center",
    s.sql(
        s.PIXELS, s.TILED,
        """SELECT DISTINCT chr, round_regions, round_region_x - 20e0 AS x, round_region_y + 24e0 AS y FROM tiled""",
    ),
)
def centers(spark: SparkSession, d: str) -> DataFrame:
    distinct = tiled(spark, d).select("chr", *TILE).distinct()
    return tile_name(tile_center(distinct)).drop(*TILE)


_AXIS_KEYS = ["chr", "round_r1r2", "round_region1", "round_region2"]


@query(
    "i7_tile_rings",
    s.sql(
        s.PIXELS, s.AXIS_TILED,
        """SELECT t.chr, round_r1r2, pixels, clusters, mean_logfc, corner_ord,
             ((round_region1 + d1) + (round_region2 + d2)) / 2e0 AS corner_x,
             ((round_region2 + d2) - (round_region1 + d1)) / 2e0 AS corner_y
           FROM (SELECT chr, round_r1r2, round_region1, round_region2, count(*) AS pixels,
                   count(DISTINCT clust) AS clusters, avg(logfc) AS mean_logfc
                 FROM axis_tiled GROUP BY chr, round_r1r2, round_region1, round_region2) t
           CROSS JOIN (VALUES (1, -45e0, -45e0), (2, -45e0, 45e0), (3, 45e0, 45e0), (4, 45e0, -45e0),
                              (5, -45e0, -45e0)) c(corner_ord, d1, d2)""",
    ),
)
def tile_rings(spark: SparkSession, d: str) -> DataFrame:
    found = tile_summary(axis_tile(scored(spark, d)), _AXIS_KEYS)
    return tile_corners(found).select(
        "chr", "round_r1r2", "pixels", "clusters", "mean_logfc", "corner_ord", "corner_x", "corner_y"
    )


@query(
    "i8_mask",
    s.sql(
        s.PIXELS,
        """SELECT *, (max1 - min1 + 3) * (max2 - min2 + 3) - ones AS zeros FROM (
             SELECT chr, clust, min(region1) AS min1, max(region1) AS max1, min(region2) AS min2,
               max(region2) AS max2, count(DISTINCT (region1, region2)) AS ones FROM pixels GROUP BY chr, clust)""",
    ),
)
def mask(spark: SparkSession, d: str) -> DataFrame:
    return bounding_boxes(pixels(spark, d), CLUSTER)


@query("i9_segments", s.sql(s.PIXELS, s.segments("pixels", CLUSTER_SQL), "SELECT * FROM segs"))
def outline_segments(spark: SparkSession, d: str) -> DataFrame:
    return segments(pixels(spark, d), CLUSTER)


@query(
    "i9_segments_connected",
    s.sql(s.PIXELS, s.segments("pixels", CLUSTER_SQL, "connect"), "SELECT * FROM segs"),
)
def connected_segments(spark: SparkSession, d: str) -> DataFrame:
    return segments(pixels(spark, d), CLUSTER, "connect")


def _ring_sql(source: str, keys: str, body: str, *before: str, saddle: str = "separate") -> str:
    return s.sql(
        s.PIXELS, *before, s.segments(source, keys, saddle), s.vertices(keys), s.rings(keys), body, recursive=True
    )


@query("i9_rings", _ring_sql("pixels", CLUSTER_SQL, "SELECT * FROM ringed"))
def ordered_rings(spark: SparkSession, d: str) -> DataFrame:
    return rings(pixels(spark, d), CLUSTER)


@query(
    "i9_areas",
    s.sql(
        s.PIXELS, s.segments("pixels", CLUSTER_SQL),
        """SELECT chr, clust, count(*) AS segments, CAST(sum(x1 * y2 - x2 * y1) AS DOUBLE) / 8e0 AS area
           FROM segs GROUP BY chr, clust""",
    ),
)
def areas(spark: SparkSession, d: str) -> DataFrame:
    return group_areas(segments(pixels(spark, d), CLUSTER), CLUSTER)


@query(
    "i10_vertices",
    s.sql(
        s.PIXELS, s.segments("pixels", CLUSTER_SQL), s.vertices(CLUSTER_SQL),
        "SELECT chr, clust, x, y, in_dx, in_dy, out_dx, out_dy, keep FROM verts",
    ),
)
def outline_vertices(spark: SparkSession, d: str) -> DataFrame:
    return vertices(segments(pixels(spark, d), CLUSTER), CLUSTER)


@query(
    "i10_simplified",
    s.sql(
        s.PIXELS, s.segments("pixels", CLUSTER_SQL), s.vertices(CLUSTER_SQL),
        "SELECT chr, clust, x / 2e0 AS x, y / 2e0 AS y FROM verts WHERE keep",
    ),
)
def simplified(spark: SparkSession, d: str) -> DataFrame:
    return simplified_vertices(segments(pixels(spark, d), CLUSTER), CLUSTER)


_OUTLINE = """ring_x, ring_y, kept_ord AS vertex_ord, x AS region1, y AS region2,
  (x + y) / 2e0 AS region_x, (y - x) / 2e0 AS region_y"""


@query(
    "i11_cluster_outlines",
    _ring_sql("pixels", CLUSTER_SQL, f"SELECT {CLUSTER_SQL}, {_OUTLINE} FROM ringed WHERE keep"),
)
def cluster_outlines(spark: SparkSession, d: str) -> DataFrame:
    return outlines(pixels(spark, d), CLUSTER)


@query(
    "i12_local_outlines",
    _ring_sql("tiled", LOCAL_SQL, f"SELECT {LOCAL_SQL}, {_OUTLINE} FROM ringed WHERE keep", s.TILED),
)
def local_outlines(spark: SparkSession, d: str) -> DataFrame:
    return outlines(tiled(spark, d), LOCAL)


@query(
    "i13_tile_of_vertices",
    _ring_sql(
        "pixels", CLUSTER_SQL,
        """SELECT *, region_x - round_region_x AS rel_region_x, region_y - round_region_y AS rel_region_y,
             CAST(CAST(round_region_x AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(round_region_y AS BIGINT) AS VARCHAR) AS round_regions
           FROM (SELECT chr, clust, ring_x, ring_y, kept_ord AS vertex_ord, (x + y) / 2e0 AS region_x, (y - x) / 2e0 AS region_y,
                   round_even(((x + y) / 2e0 + 20e0) / 50e0, 0) * 50e0 + 0e0 AS round_region_x,
                   round_even(((y - x) / 2e0 - 24e0) / 50e0, 0) * 50e0 + 0e0 AS round_region_y
                 FROM ringed WHERE keep)""",
    ),
)
def vertex_tiles(spark: SparkSession, d: str) -> DataFrame:
    return tile_name(tile(outlines(pixels(spark, d), CLUSTER))).drop("region1", "region2")


@query(
    "i14_representation_sizes",
    s.sql(
        s.PIXELS, REPRESENTATION,
        """SELECT p.chr, p.clust, min(region1) AS region1, min(region2) AS region2, 4 * count(*) AS corners,
             max(c."rows") AS cluster, max(t."rows") AS simplified, count(*) AS pixel,
             'cluster ' || p.clust || chr(10) || 'cluster rows= ' || max(c."rows") || chr(10) ||
             'simplified rows= ' || max(t."rows") || chr(10) || 'pixel rows= ' || count(*) ||
             ' corners= ' || 4 * count(*) AS label
           FROM pixels p JOIN shapes c ON c.chr = p.chr AND c.clust = p.clust AND c.data_type = 'cluster'
             JOIN shapes t ON t.chr = p.chr AND t.clust = p.clust AND t.data_type = 'simplified'
           GROUP BY p.chr, p.clust""",
    ),
)
def representations(spark: SparkSession, d: str) -> DataFrame:
    px = pixels(spark, d)
    sizes = representation_sizes(px, segments(px, CLUSTER))
    counts = sizes.select(*CLUSTER, *REPRESENTATIONS)
    return representation_labels(sizes).join(counts, CLUSTER)


@query(
    "i15_ring_roles",
    _ring_sql(
        "pixels", CLUSTER_SQL,
        """SELECT chr, clust, ring_x, ring_y, count(*) AS vertices, count(*) FILTER (keep) AS turns,
             CAST(sum(CAST(4 * (x * next_y - next_x * y) AS BIGINT)) AS DOUBLE) / 8e0 AS area,
             CASE WHEN sum(x * next_y - next_x * y) > 0 THEN 'outer' ELSE 'hole' END AS role
           FROM ringed GROUP BY chr, clust, ring_x, ring_y""",
    ),
)
def roles(spark: SparkSession, d: str) -> DataFrame:
    return ring_roles(rings(pixels(spark, d), CLUSTER), CLUSTER)


@query(
    "i16_saddle_differences",
    s.sql(
        s.PIXELS,
        s.segments("pixels", CLUSTER_SQL, "separate", "apart"),
        s.segments("pixels", CLUSTER_SQL, "connect", "joined"),
        """SELECT 'separate' AS saddle, * FROM (SELECT * FROM apart EXCEPT SELECT * FROM joined) UNION ALL
           SELECT 'connect' AS saddle, * FROM (SELECT * FROM joined EXCEPT SELECT * FROM apart)""",
    ),
)
def saddle_differences(spark: SparkSession, d: str) -> DataFrame:
    """Segments only one of the two saddle rules draws."""
    px = pixels(spark, d)
    return tagged_union(
        {
            "separate": segments(px, CLUSTER, "separate", unlike="connect"),
            "connect": segments(px, CLUSTER, "connect", unlike="separate"),
        },
        "saddle",
    )


@query(
    "i16_methods",
    s.sql(
        s.PIXELS,
        s.segments("pixels", CLUSTER_SQL, "separate", "apart"), s.vertices(CLUSTER_SQL, "apart", "apart_v"),
        s.segments("pixels", CLUSTER_SQL, "connect", "joined"), s.vertices(CLUSTER_SQL, "joined", "joined_v"),
        """SELECT 'separate' AS method, chr, clust, x / 2e0 AS x, y / 2e0 AS y FROM apart_v WHERE keep UNION ALL
           SELECT 'connect' AS method, chr, clust, x / 2e0 AS x, y / 2e0 AS y FROM joined_v WHERE keep""",
    ),
)
def methods(spark: SparkSession, d: str) -> DataFrame:
    """Simplified vertices of both saddle rules side by side."""
    px = pixels(spark, d)
    return tagged_union(
        {r: simplified_vertices(segments(px, CLUSTER, r), CLUSTER) for r in ("separate", "connect")},
        "method",
    )


@query(
    "i17_mask_long",
    s.sql(
        s.PIXELS,
        """SELECT c.chr, a.region1, b.region2, CASE WHEN p.region1 IS NULL THEN 0 ELSE 1 END AS value
           FROM (SELECT DISTINCT chr FROM pixels) c
           CROSS JOIN (SELECT unnest(range(1, 61)) AS region1) a CROSS JOIN (SELECT unnest(range(1, 61)) AS region2) b
           LEFT JOIN pixels p ON p.chr = c.chr AND p.region1 = a.region1 AND p.region2 = b.region2""",
    ),
)
def dense_mask(spark: SparkSession, d: str) -> DataFrame:
    return mask_long(pixels(spark, d), 1, 60)


@query(
    "i17_group_masks",
    s.sql(
        s.PIXELS, s.TILED,
        f"""SELECT {', '.join('c.' + k.strip() for k in LOCAL_SQL.split(','))}, c.region1, c.region2,
             c.region1 - c.low1 + 1 AS "row", c.region2 - c.low2 + 1 AS col,
             CASE WHEN p.region1 IS NULL THEN 0 ELSE 1 END AS value
           FROM (SELECT *, unnest(range(low2, high2 + 1)) AS region2 FROM (
                   SELECT *, unnest(range(low1, high1 + 1)) AS region1 FROM (
                     SELECT {LOCAL_SQL}, min(region1) - 1 AS low1, max(region1) + 1 AS high1,
                       min(region2) - 1 AS low2, max(region2) + 1 AS high2 FROM tiled GROUP BY {LOCAL_SQL}))) c
           LEFT JOIN tiled p ON p.region1 = c.region1 AND p.region2 = c.region2
             AND {' AND '.join(f'p.{k.strip()} = c.{k.strip()}' for k in LOCAL_SQL.split(','))}""",
    ),
)
def masks(spark: SparkSession, d: str) -> DataFrame:
    """Masks of clusters within tiles."""
    return group_masks(tiled(spark, d), LOCAL)


@query(
    "i17_mask_blocks",
    s.sql(
        s.PIXELS,
        """boxes AS (SELECT chr, clust % 10 AS part, min(region1) - 1 AS low1, max(region1) + 1 AS high1, min(region2) - 1 AS low2,
                       max(region2) + 1 AS high2 FROM pixels GROUP BY ALL),
           ones AS (SELECT chr, clust % 10 AS part, region1 // 64 AS block1, region2 // 64 AS block2, count(*) AS ones FROM pixels GROUP BY ALL)""",
        """SELECT o.chr, o.part, block1, block2, ones,
             (least(block1 * 64 + 63, high1) - greatest(block1 * 64, low1) + 1) * (least(block2 * 64 + 63, high2) - greatest(block2 * 64, low2) + 1) - ones AS zeros,
             CAST((floor(high1 / 64e0) - floor(low1 / 64e0) + 1) * (floor(high2 / 64e0) - floor(low2 / 64e0) + 1) AS BIGINT) AS blocks
           FROM ones o JOIN boxes b ON o.chr = b.chr AND o.part = b.part""",
    ),
)
def blocks_of_masks(spark: SparkSession, d: str) -> DataFrame:
    """Masks whose boxes span a chromosome, as bitmaps of the blocks that hold a pixel."""
    parts = pixels(spark, d).select("chr", (F.col("clust") % 10).alias("part"), "region1", "region2")
    return box_blocks(parts, ["chr", "part"], 64)


@query("i17_cells_of_blocks", s.sql(s.PIXELS, "SELECT chr, region1, region2 FROM pixels"))
def bitmaps_read_back(spark: SparkSession, d: str) -> DataFrame:
    """All pixels of each chromosome, from its bitmaps."""
    return cells_of_blocks(mask_blocks(pixels(spark, d), ["chr"]), ["chr"])


@query(
    "i18_presence",
    s.sql(s.PIXELS, s.TILED, "SELECT DISTINCT chr, round_region_x, round_region_y, clust FROM tiled"),
)
def cluster_presence(spark: SparkSession, d: str) -> DataFrame:
    return presence(tiled(spark, d))


@query(
    "i19_label_anchor",
    s.sql(
        s.PIXELS, s.TILED, s.EXTENTS,
        "SELECT (rel_corner_x_max + rel_corner_x_min) / 2e0 AS rel_x, rel_corner_y_max + 1e0 AS rel_y FROM extents",
    ),
)
def anchor(spark: SparkSession, d: str) -> DataFrame:
    return label_anchor(corner_extents(tiled(spark, d)))


@query(
    "i20_polygon_tiles",
    s.sql(
        s.POLYGONS, POLYGON_TILES, POLYGON_REL,
        "SELECT nb_clust, id, iff, round_x, round_y, tile_id, rel_x, rel_y FROM prel",
    ),
)
def polygon_tile_rows(spark: SparkSession, d: str) -> DataFrame:
    keys = ["nb_clust", "round_x", "round_y"]
    return relative_to_least(polygon_tiles(polygons(spark, d)), keys, ["x", "y"]).select(
        "nb_clust", "id", "iff", "round_x", "round_y", "tile_id", "rel_x", "rel_y"
    )


@query(
    "i21_axis_relative_corners",
    s.sql(
        s.PIXELS, s.AXIS_TILED,
        """SELECT region1, region2, round_r1r2, corner_ord,
             ((region1 + d1) + (region2 + d2)) / 2e0 - (round_region1 + round_region2) / 2e0 AS rel_x,
             ((region2 + d2) - (region1 + d1)) / 2e0 - (round_region2 - round_region1) / 2e0 AS rel_y
           FROM axis_tiled CROSS JOIN (
             VALUES (1, -0.45::DOUBLE, -0.45::DOUBLE), (2, -0.45::DOUBLE, 0.45::DOUBLE), (3, 0.45::DOUBLE, 0.45::DOUBLE),
                    (4, 0.45::DOUBLE, -0.45::DOUBLE), (5, -0.45::DOUBLE, -0.45::DOUBLE)) c(corner_ord, d1, d2)""",
    ),
)
def axis_corners(spark: SparkSession, d: str) -> DataFrame:
    narrow = axis_tile(pixels(spark, d)).select(
        "region1", "region2", "round_r1r2", "round_region1", "round_region2"
    )
    return axis_relative_corners(corners(narrow, 0.45, closed=True)).select(
        "region1", "region2", "round_r1r2", "corner_ord", "rel_x", "rel_y"
    )
