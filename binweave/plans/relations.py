"""Queries over group-relative values, joins, unions, sorts and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binweave.functions.numeric import (
    bin_by_count,
    bin_by_width,
    half_even,
    log10_full,
    log2_full,
    neg_log10,
    signed_neg_log10,
    two_digits,
)
from binweave.functions.text import fixed_text, one_decimal, pair_text, plain_text, whole_text
from binweave.operators.boundary import differences, segments
from binweave.operators.geometry import (
    TILE,
    axis_tile,
    corner_extents,
    label_anchor,
    polygon_tiles,
    presence,
    tile_name,
    tile_spacing,
    tiled_pixels,
)
from binweave.operators.relational import (
    first_rows,
    grid,
    grid_with_pixels,
    index_shift,
    join_null_safe,
    join_spread,
    missing_pixels,
    relative_to_least,
    rows_for_keys,
    rows_of_first_id,
    tagged_union,
)
from binweave.operators.summaries import (
    cluster_sizes,
    cluster_tile_labels,
    cluster_tiles,
    coarse_volcano_bins,
    color_scale,
    midpoint_intervals,
    size_bins,
    size_points,
    summarize_clusters,
    volcano_bins,
    volcano_heat,
)
from binweave.plans import sql_parts as s
from binweave.plans.aggregates import POLYGON_REL, POLYGON_TILES, SIZE_BINS, scored, tiled
from binweave.plans.registry import query
from binweave.scratch import cut
from binweave.sources.stand_ins import criterion, pixels, polygons

# --- values relative to a group ------------------------------------------------


@query(
    "d1_group_relative",
    s.sql(
        s.POLYGONS, POLYGON_TILES, POLYGON_REL,
        "SELECT nb_clust, id, tile_id, x, y, rel_x, rel_y FROM prel",
    ),
)
def group_relative(spark: SparkSession, d: str) -> DataFrame:
    keys = ["nb_clust", "round_x", "round_y"]
    return relative_to_least(polygon_tiles(polygons(spark, d)), keys, ["x", "y"]).select(
        "nb_clust", "id", "tile_id", "x", "y", "rel_x", "rel_y"
    )


@query(
    "d2_row_number",
    s.sql(
        s.PIXELS, s.TILED, s.CLUSTER_SIZES, SIZE_BINS,
        """SELECT chr, clust, pixels, tiles, printf('tiles=%.2f log10(pixels)=%.2f', CAST(tiles AS DOUBLE), round_log10_pixels) AS size_bin,
             round(log10_pixels - round_log10_pixels, 9) AS rel_log10_pixels,
             row_number() OVER (PARTITION BY chr, tiles, round_log10_pixels, pixels ORDER BY clust) AS rel_row
           FROM size_binned""",
    ),
)
def row_numbers(spark: SparkSession, d: str) -> DataFrame:
    points = size_points(size_bins(cluster_sizes(tiled(spark, d))))
    return points.select(
        "chr", "clust", "pixels", "tiles", "size_bin",
        F.round("rel_log10_pixels", 9).alias("rel_log10_pixels"), "rel_row",
    )


@query(
    "d2_row_number_log2",
    s.sql(
        s.PIXELS, s.TILED, s.CLUSTER_SIZES, SIZE_BINS,
        """SELECT chr, clust, pixels, tiles, round(log2_tiles - round_log2_tiles, 9) AS rel_log2_tiles,
             printf('log2(tiles)=%.2f log10(pixels)=%.2f', round_log2_tiles, round_log10_pixels) AS size_bin,
             row_number() OVER (PARTITION BY chr, round_log2_tiles, round_log10_pixels, pixels ORDER BY clust) AS rel_row
           FROM size_binned""",
    ),
)
def row_numbers_log2(spark: SparkSession, d: str) -> DataFrame:
    points = size_points(size_bins(cluster_sizes(tiled(spark, d)), log2_tiles=True))
    return points.select(
        "chr", "clust", "pixels", "tiles", "size_bin",
        F.round("rel_log2_tiles", 9).alias("rel_log2_tiles"), "rel_row",
    )


@query(
    "d3_first_row",
    s.sql(
        s.POLYGONS,
        """SELECT nb_clust, id, i, j, x, y, iff FROM (
             SELECT *, row_number() OVER (PARTITION BY nb_clust, id ORDER BY x, y, iff) AS r FROM polygons) WHERE r = 1""",
    ),
)
def first_of_group(spark: SparkSession, d: str) -> DataFrame:
    """First in x, y, value order."""
    return first_rows(polygons(spark, d), ["nb_clust", "id"], ["x", "y", "iff"])


@query(
    "d4_first_id",
    s.sql(
        s.POLYGONS,
        """SELECT p.* FROM polygons p JOIN (SELECT i, j, min(id) AS id FROM polygons GROUP BY i, j)
           USING (i, j, id)""",
    ),
)
def first_id(spark: SparkSession, d: str) -> DataFrame:
    """First is the least id."""
    return rows_of_first_id(polygons(spark, d), ["i", "j"])


@query(
    "d5_first_difference",
    s.sql(
        s.PIXELS, s.segments("pixels", "chr, clust"),
        """SELECT chr, clust, x1 / 2e0 AS x, y1 / 2e0 AS y, (x2 - x1) / 2e0 AS dx, (y2 - y1) / 2e0 AS dy FROM segs""",
    ),
)
def first_difference(spark: SparkSession, d: str) -> DataFrame:
    keys = ["chr", "clust"]
    return differences(segments(pixels(spark, d), keys), keys).select(*keys, "x", "y", "dx", "dy")


@query(
    "d6_second_difference",
    s.sql(
        s.PIXELS, s.segments("pixels", "chr, clust"), s.vertices("chr, clust"),
        """SELECT chr, clust, (x - in_dx) / 2e0 AS x, (y - in_dy) / 2e0 AS y, (out_dx - in_dx) / 2e0 AS ddx,
             (out_dy - in_dy) / 2e0 AS ddy, NOT keep AS both_zero FROM verts""",
    ),
)
def second_difference(spark: SparkSession, d: str) -> DataFrame:
    keys = ["chr", "clust"]
    return differences(segments(pixels(spark, d), keys), keys).drop("dx", "dy")


@query(
    "d7_tile_spacing",
    s.sql(
        s.PIXELS, s.AXIS_TILED,
        """SELECT chr, min(gap) AS spacing FROM (
             SELECT chr, lead(round_region1) OVER (PARTITION BY chr ORDER BY round_region1) - round_region1 AS gap
             FROM (SELECT DISTINCT chr, round_region1 FROM axis_tiled)) GROUP BY chr""",
    ),
)
def spacing(spark: SparkSession, d: str) -> DataFrame:
    return tile_spacing(axis_tile(pixels(spark, d)))


@query(
    "d8_midpoint_intervals",
    s.sql(
        s.CRITERION,
        """SELECT nb_clust, nb_clust - coalesce((nb_clust - b) / 2e0, (a - nb_clust) / 2e0, 0) AS lower,
             nb_clust + coalesce((a - nb_clust) / 2e0, (nb_clust - b) / 2e0, 0) AS upper
           FROM (SELECT nb_clust, lag(nb_clust) OVER (ORDER BY nb_clust) AS b,
                        lead(nb_clust) OVER (ORDER BY nb_clust) AS a FROM criterion)""",
    ),
)
def intervals(spark: SparkSession, d: str) -> DataFrame:
    return midpoint_intervals(criterion(spark, d), "nb_clust")


@query(
    "d9_first_tile_of_cluster",
    s.sql(
        s.PIXELS, s.TILED,
        """SELECT round_region_x, round_region_y FROM tiled WHERE chr = 'chr1' AND clust = 406
           ORDER BY round_region_x, round_region_y LIMIT 1""",
    ),
)
def first_tile(spark: SparkSession, d: str) -> DataFrame:
    mine = presence(tiled(spark, d)).filter("chr = 'chr1' AND clust = 406")
    return mine.agg(F.min(F.struct(*TILE)).alias("t")).select("t.*")


# --- joins ---------------------------------------------------------------------

_GRID = """
grid AS (
  SELECT f.chr, f.region1, s.region2
  FROM (SELECT DISTINCT chr, region1 FROM pixels) f
  JOIN (SELECT DISTINCT chr, region2 FROM pixels) s
    ON s.chr = f.chr AND s.region2 BETWEEN f.region1 AND f.region1 + 49)"""


@query("e1_band_grid", s.sql(s.PIXELS, _GRID, "SELECT * FROM grid"))
def band_grid(spark: SparkSession, d: str) -> DataFrame:
    return grid(pixels(spark, d), 49)


@query(
    "e2_outer_join",
    s.sql(
        s.PIXELS, _GRID,
        """SELECT g.chr, g.region1, g.region2, p.clust, p.logfc, p.p_value FROM grid g
           LEFT JOIN pixels p ON p.chr = g.chr AND p.region1 = g.region1 AND p.region2 = g.region2""",
    ),
)
def outer_join(spark: SparkSession, d: str) -> DataFrame:
    return grid_with_pixels(pixels(spark, d), 49)


@query(
    "e2_polygons_of_pixels",
    s.sql(
        s.PIXELS, s.POLYGONS,
        """SELECT p.region1, p.region2, p.clust, q.nb_clust, q.id FROM pixels p
           LEFT JOIN polygons q ON q.i = p.region2 AND q.j = p.region1""",
    ),
)
def polygons_of_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Every pixel, with its polygons at all levels where there are any.

    Polygons may pile up on a pixel, so they are the big side; pixels without one are added.
    """
    drawn = polygons(spark, d).select(
        F.col("i").alias("region2"), F.col("j").alias("region1"), "nb_clust", "id"
    )
    px = pixels(spark, d).select("region1", "region2", "clust")
    met = join_spread(drawn, px, ["region1", "region2"], "inner")
    alone = px.join(drawn.select("region1", "region2").distinct(), ["region1", "region2"], "left_anti")
    return met.unionByName(alone, allowMissingColumns=True)


@query(
    "e3_missing_pixels",
    s.sql(
        s.PIXELS, _GRID,
        "SELECT * FROM grid EXCEPT SELECT chr, region1, region2 FROM pixels",
    ),
)
def missing(spark: SparkSession, d: str) -> DataFrame:
    return missing_pixels(pixels(spark, d), 49)


@query(
    "e4_label_by_tile",
    s.sql(
        s.PIXELS, s.TILED, s.EXTENTS, s.CLUSTER_SIZES,
        """SELECT t.chr, t.clust, t.round_region_x, t.round_region_y, count(*) AS displayed_pixels,
             printf('Cluster %d: %d/%d pixels shown, logFC %.1f to %.1f, log10(p) %.1f to %.1f', t.clust, count(*),
               z.pixels, logfc_min, logfc_max, neg_log10_p_min, neg_log10_p_max) AS label,
             (e.rel_corner_x_max + e.rel_corner_x_min) / 2e0 AS rel_x, e.rel_corner_y_max + 1e0 AS rel_y
           FROM tiled t JOIN sizes z ON z.chr = t.chr AND z.clust = t.clust, extents e
           GROUP BY ALL""".replace("GROUP BY ALL", """GROUP BY t.chr, t.clust, t.round_region_x, t.round_region_y, z.pixels, logfc_min,
             logfc_max, neg_log10_p_min, neg_log10_p_max, e.rel_corner_x_max, e.rel_corner_x_min, e.rel_corner_y_max"""),
    ),
)
def labels(spark: SparkSession, d: str) -> DataFrame:
    rows = tiled(spark, d)
    cells = cut(cluster_tiles(rows), "cells")  # read by both sides of the join
    return cluster_tile_labels(cells, summarize_clusters(cells), label_anchor(corner_extents(rows)))


@query(
    "e5_sizes_and_ranges",
    s.sql(
        s.PIXELS, s.TILED, s.CLUSTER_SIZES,
        """SELECT * REPLACE (round(neg_log10_p_min, 9) AS neg_log10_p_min,
                            round(neg_log10_p_max, 9) AS neg_log10_p_max) FROM sizes""",
    ),
)
def sizes_and_ranges(spark: SparkSession, d: str) -> DataFrame:
    """One aggregation gives both sides of the join, so there is no join."""
    found = cluster_sizes(tiled(spark, d))
    return found.withColumns({c: F.round(c, 9) for c in ("neg_log10_p_min", "neg_log10_p_max")})


@query(
    "e6_join_on_named_column",
    s.sql(
        s.PIXELS, s.TILED, s.CLUSTER_SIZES,
        """SELECT z.chr, z.clust, z.pixels, p.region1, p.region2 FROM sizes z JOIN
             (SELECT chr, clust, min(region1) AS region1, min(region2) AS region2 FROM pixels GROUP BY chr, clust) p
             ON p.chr = z.chr AND p.clust = z.clust""",
    ),
)
def named_join(spark: SparkSession, d: str) -> DataFrame:
    rows = tiled(spark, d)
    corner = rows.groupBy("chr", "clust").agg(
        F.min("region1").alias("region1"), F.min("region2").alias("region2")
    )
    return join_null_safe(cluster_sizes(rows).select("chr", "clust", "pixels"), corner, ["chr", "clust"])


@query(
    "e7_rows_for_keys",
    s.sql(
        s.POLYGONS, s.PIXELS,
        """SELECT q.* FROM polygons q WHERE EXISTS (
             SELECT 1 FROM pixels p WHERE p.logfc > 0 AND p.region1 = q.j AND p.region2 = q.i)""",
    ),
)
def for_keys(spark: SparkSession, d: str) -> DataFrame:
    """Polygons of the pixels that interact more."""
    seen = pixels(spark, d).filter("logfc > 0").select(
        F.col("region2").alias("i"), F.col("region1").alias("j")
    )
    return rows_for_keys(polygons(spark, d), seen, ["i", "j"])


@query(
    "e8_scalar_in_every_row",
    s.sql(
        s.PIXELS, s.TILED, s.EXTENTS,
        """SELECT t.chr, t.round_region_x, t.round_region_y,
             (e.rel_corner_x_max + e.rel_corner_x_min) / 2e0 AS rel_x, e.rel_corner_y_max + 1e0 AS rel_y
           FROM (SELECT DISTINCT chr, round_region_x, round_region_y FROM tiled) t, extents e""",
    ),
)
def scalar_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = tiled(spark, d)
    anchor = label_anchor(corner_extents(rows))
    return rows.select("chr", *TILE).distinct().select(
        "*",
        anchor.select("rel_x").scalar().alias("rel_x"),
        anchor.select("rel_y").scalar().alias("rel_y"),
    )


@query(
    "e9_mismatch_after_join",
    s.sql(
        s.PIXELS,
        """SELECT a.chr, a.n AS pixels, b.n AS listed_pixels FROM (SELECT chr, count(*) AS n FROM pixels GROUP BY chr) a
           JOIN (SELECT 'chr' || CAST(1 + l_partkey // 1000 AS VARCHAR) AS chr, count(*) AS n FROM lineitem GROUP BY 1) b
           USING (chr) WHERE a.n <> b.n""",
    ),
)
def mismatches(spark: SparkSession, d: str) -> DataFrame:
    """Chromosomes whose pixels are not as many as the lines their listing has."""
    whole = pixels(spark, d).groupBy("chr").agg(F.count("*").alias("pixels"))
    chromosome = F.concat(F.lit("chr"), (1 + F.expr("l_partkey div 1000")).cast("string"))
    lines = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(chromosome.alias("chr"))
    listed = lines.agg(F.count("*").alias("listed_pixels"))
    return whole.join(listed, "chr").filter(F.col("pixels") != F.col("listed_pixels"))


_BY_CHR = """
shifted AS (
  SELECT pixels.*, region2 - m + 1 AS i, region1 - m + 1 AS j FROM pixels
  JOIN (SELECT chr, least(min(region1), min(region2)) AS m FROM pixels GROUP BY chr) USING (chr)),
drawn AS (
  SELECT chr, nb_clust, id, i - m + 1 AS i, j - m + 1 AS j
  FROM (SELECT *, 'chr' || CAST(1 + j // 1000 AS VARCHAR) AS chr FROM polygons)
  JOIN (SELECT 'chr' || CAST(1 + j // 1000 AS VARCHAR) AS chr, least(min(i), min(j)) AS m FROM polygons GROUP BY 1) USING (chr))"""


@query(
    "e10_pixels_to_polygons",
    s.sql(
        s.PIXELS, s.POLYGONS, _BY_CHR,
        """SELECT q.nb_clust, q.id, q.i, q.j, q.i || ',' || q.j AS ij, p.region1, p.region2, p.clust, p.logfc
           FROM drawn q LEFT JOIN shifted p ON p.chr = q.chr AND p.i = q.i AND p.j = q.j""",
    ),
)
def pixels_to_polygons(spark: SparkSession, d: str) -> DataFrame:
    """Every polygon row with its pixel, whatever its chromosome; many polygons may sit on one pixel."""
    return pixels_to_polygons_by_chr(spark, d).drop("chr")


@query(
    "e10_pixels_to_polygons_by_chr",
    s.sql(
        s.PIXELS, s.POLYGONS, _BY_CHR,
        """SELECT q.chr, q.nb_clust, q.id, q.i, q.j, q.i || ',' || q.j AS ij, p.region1, p.region2, p.clust, p.logfc
           FROM drawn q LEFT JOIN shifted p ON p.chr = q.chr AND p.i = q.i AND p.j = q.j""",
    ),
)
def pixels_to_polygons_by_chr(spark: SparkSession, d: str) -> DataFrame:
    """Every polygon row with its pixel, on all chromosomes; bins count from the least one of each."""
    shifted = index_shift(pixels(spark, d)).select("chr", "i", "j", "region1", "region2", "clust", "logfc")
    drawn = polygons(spark, d).select("nb_clust", "id", F.col("i").alias("region2"), F.col("j").alias("region1"))
    placed = drawn.withColumn("chr", F.concat(F.lit("chr"), (1 + F.expr("region1 div 1000")).cast("string")))
    counted = index_shift(placed).select("chr", "nb_clust", "id", "i", "j")
    joined = join_spread(counted, shifted, ["chr", "i", "j"], "left")
    return joined.withColumn("ij", pair_text(F.col("i").cast("string"), F.col("j").cast("string")))


# --- unions, sorts ---------------------------------------------------------------


@query(
    "f1_tagged_union",
    s.sql(
        s.PIXELS, s.segments("pixels", "chr, clust"), s.vertices("chr, clust"),
        """SELECT 'pixel' AS data_type, chr, clust, region1, region2, logfc, CAST(NULL AS DOUBLE) AS x,
             CAST(NULL AS DOUBLE) AS y FROM pixels
           UNION ALL SELECT 'simplified', chr, clust, NULL, NULL, NULL, x / 2e0, y / 2e0 FROM verts WHERE keep
           UNION ALL SELECT 'cluster', chr, clust, NULL, NULL, NULL, x / 2e0, y / 2e0 FROM verts""",
    ),
)
def stacked(spark: SparkSession, d: str) -> DataFrame:
    px = pixels(spark, d).select("chr", "clust", "region1", "region2", "logfc")
    keys = ["chr", "clust"]
    points = differences(segments(px, keys), keys)
    ends = points.select(*keys, (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "both_zero")
    return tagged_union(
        {
            "pixel": px,
            "cluster": points.select(*keys, "x", "y"),
            "simplified": ends.filter(~F.col("both_zero")).select(*keys, "x", "y"),
        }
    )


@query(
    "f2_union",
    s.sql(
        s.PIXELS,
        """SELECT chr, region1, region2, logfc FROM pixels UNION ALL
           SELECT chr, region2, region1, logfc FROM pixels""",
    ),
)
def union(spark: SparkSession, d: str) -> DataFrame:
    """Both triangles: every pixel and its mirror image."""
    px = pixels(spark, d).select("chr", "region1", "region2", "logfc")
    return px.union(px.select("chr", "region2", "region1", "logfc"))


@query(
    "f3_distinct",
    s.sql(s.PIXELS, s.TILED, "SELECT DISTINCT chr, round_regions, clust FROM tiled"),
)
def distinct_rows(spark: SparkSession, d: str) -> DataFrame:
    return tile_name(presence(tiled(spark, d))).select("chr", "round_regions", "clust")


_SCALE = """
fine AS (
  SELECT logfc, round_even(logfc * 16e0, 0) / 16e0 + 0e0 AS round_logfc,
         round_even(neg_log10_p * 64e0, 0) / 64e0 + 0e0 AS round_neg_log10_p
  FROM (SELECT logfc, neg_log10_p + abs(logfc) AS neg_log10_p FROM scored)),
limits AS (SELECT max(round_neg_log10_p) AS m FROM fine WHERE round_logfc = 0),
signed AS (
  SELECT DISTINCT CAST(sign(logfc) AS DOUBLE) * round_neg_log10_p + 0e0 AS v
  FROM fine WHERE round_neg_log10_p > (SELECT m FROM limits))"""


@query(
    "f4_color_scale",
    s.sql(
        s.PIXELS, s.with_p(), _SCALE,
        """SELECT v AS sign_round_neg_log10_p, CAST(sign(v) AS DOUBLE) / 16e0 / 4e0 + 0e0 AS logfc, abs(v) AS height
           FROM signed ORDER BY v""",
    ),
)
def scale_keys(spark: SparkSession, d: str) -> DataFrame:
    # Larger changes are made more significant, as in a volcano, so that some bins lie above.
    px = scored(spark, d).withColumn("neg_log10_p", F.col("neg_log10_p") + F.abs("logfc"))
    return color_scale(coarse_volcano_bins(px, 16.0, 64.0), 16.0)


@query(
    "f4_signed_bins",
    s.sql(
        s.PIXELS, s.with_p(), s.COARSE,
        "SELECT DISTINCT CAST(sign(logfc) AS DOUBLE) * round_neg_log10_p + 0e0 AS sign_round_neg_log10_p FROM coarse ORDER BY 1",
    ),
)
def signed_bins(spark: SparkSession, d: str) -> DataFrame:
    binned = coarse_volcano_bins(scored(spark, d))
    signed = F.signum("logfc") * F.col("round_neg_log10_p") + F.lit(0.0)
    return binned.select(signed.alias("sign_round_neg_log10_p")).distinct().orderBy("sign_round_neg_log10_p")


@query("g1_sort_by_key", s.sql(s.PIXELS, "SELECT region1, region2, region1 || '-' || region2 AS r1r2 FROM pixels ORDER BY 1, 2, 3"))
def sorted_pixels(spark: SparkSession, d: str) -> DataFrame:
    name = pair_text(F.col("region1").cast("string"), F.col("region2").cast("string"), "-")
    return pixels(spark, d).select("region1", "region2", name.alias("r1r2")).orderBy("region1", "region2", "r1r2")


@query(
    "g2_sort_by_measure",
    s.sql(
        s.PIXELS, s.with_p(), s.volcano(),
        "SELECT chr, volcano_bin, count(*) AS pixels FROM binned GROUP BY chr, volcano_bin ORDER BY pixels",
    ),
)
def sorted_heat(spark: SparkSession, d: str) -> DataFrame:
    return volcano_heat(volcano_bins(scored(spark, d))).select("chr", "volcano_bin", "pixels").orderBy("pixels")


@query(
    "g3_sorted_grouping",
    s.sql(
        s.PIXELS, s.TILED,
        "SELECT chr, clust, round_regions, count(*) AS displayed_pixels FROM tiled GROUP BY ALL ORDER BY chr, clust, round_regions",
    ),
)
def sorted_groups(spark: SparkSession, d: str) -> DataFrame:
    counts = tiled(spark, d).groupBy("chr", "clust", *TILE).agg(F.count("*").alias("displayed_pixels"))
    return tile_name(counts).drop(*TILE).orderBy("chr", "clust", "round_regions")


@query(
    "g4_first_k_after_filter",
    s.sql(
        s.PIXELS,
        "SELECT region1 || '-' || region2 AS r1r2 FROM pixels WHERE region1 = region2 ORDER BY chr, region1 LIMIT 5",
    ),
)
def first_k(spark: SparkSession, d: str) -> DataFrame:
    first = pixels(spark, d).filter("region1 = region2").orderBy("chr", "region1").limit(5)
    return first.select(
        pair_text(F.col("region1").cast("string"), F.col("region2").cast("string"), "-").alias("r1r2")
    )


# --- scalar functions --------------------------------------------------------------


@query(
    "h_logarithms",
    s.sql(
        s.PIXELS, s.ZERO_P,
        """SELECT region1, region2, round(0e0 - log10(p_value), 9) AS neg_log10_p,
             round(CAST(sign(logfc) AS DOUBLE) * (0e0 - log10(p_value)), 9) + 0e0 AS sign_neg_log10_p,
             round(CASE WHEN p_value = 1 THEN '-inf'::DOUBLE ELSE log10(0e0 - log10(p_value)) END, 9) AS log_log_p, round(log2(region2), 9) AS log2_region2,
             abs(logfc) AS abs_logfc, CAST(sign(logfc) AS DOUBLE) + 0e0 AS sign_logfc
           FROM pixels_p0""",
    ),
)
def logarithms(spark: SparkSession, d: str) -> DataFrame:
    p, fc = F.col("p_value"), F.col("logfc")
    return pixels(spark, d, with_zero_p=True).select(
        "region1",
        "region2",
        F.round(neg_log10(p), 9).alias("neg_log10_p"),
        (F.round(signed_neg_log10(fc, p), 9) + F.lit(0.0)).alias("sign_neg_log10_p"),
        F.round(log10_full(neg_log10(p)), 9).alias("log_log_p"),
        F.round(log2_full(F.col("region2")), 9).alias("log2_region2"),
        F.abs(fc).alias("abs_logfc"),
        (F.signum(fc) + F.lit(0.0)).alias("sign_logfc"),
    )


@query(
    "h_infinite_p",
    s.sql(
        s.PIXELS, s.ZERO_P,
        """SELECT region1, region2, CAST('inf' AS DOUBLE) AS neg_log10_p, 'Inf' AS name
           FROM pixels_p0 WHERE p_value = 0""",
    ),
)
def infinite_p(spark: SparkSession, d: str) -> DataFrame:
    """p = 0 gives an infinite -log10 p, which has a name and no NULL."""
    zero = pixels(spark, d, with_zero_p=True).withColumn("neg_log10_p", neg_log10(F.col("p_value")))
    return zero.filter(F.col("neg_log10_p") == float("inf")).select(
        "region1", "region2", "neg_log10_p", plain_text(F.col("neg_log10_p")).alias("name")
    )


@query(
    "h_rounding",
    s.sql(
        s.PIXELS, s.with_p(),
        """SELECT region1, region2, round_even(region_x, 0) AS whole_x,
             round_even(logfc * 4e0, 0) / 4e0 + 0e0 AS by_count, round_even((region_x + 20e0) / 50e0, 0) * 50e0 AS by_width,
             round_even(region_x - 0.45::DOUBLE, 2) AS two_digits, logfc - (round_even(logfc * 4e0, 0) / 4e0) AS residual
           FROM scored""",
    ),
)
def rounding(spark: SparkSession, d: str) -> DataFrame:
    rows = tiled_pixels(pixels(spark, d))
    x, fc = F.col("region_x"), F.col("logfc")
    return rows.select(
        "region1",
        "region2",
        half_even(x).alias("whole_x"),
        bin_by_count(fc, 4.0).alias("by_count"),
        bin_by_width(x, 50.0, 20.0).alias("by_width"),
        two_digits(x - F.lit(0.45)).alias("two_digits"),
        (fc - bin_by_count(fc, 4.0)).alias("residual"),
    )


@query(
    "h_text",
    s.sql(
        s.PIXELS, s.with_p(),
        f"""SELECT region1, region2, region1 || ',' || region2 AS pair, 'chr ' || clust AS spaced,
             {s.number_text('round_even(logfc / 0.25::DOUBLE, 0) * 0.25::DOUBLE + 0e0')} AS plain,
             CAST(CAST(round_even(region_x, 0) AS BIGINT) AS VARCHAR) AS whole,
             printf('%.2f', round_even(logfc / 0.25::DOUBLE, 0) * 0.25::DOUBLE + 0e0) AS fixed,
             printf('%.1f', logfc) AS one_decimal
           FROM scored""",
    ),
)
def text(spark: SparkSession, d: str) -> DataFrame:
    rows = tiled_pixels(pixels(spark, d))
    quarter = bin_by_width(F.col("logfc"), 0.25)
    return rows.select(
        "region1",
        "region2",
        pair_text(F.col("region1").cast("string"), F.col("region2").cast("string")).alias("pair"),
        pair_text(F.lit("chr"), F.col("clust").cast("string"), " ").alias("spaced"),
        plain_text(quarter).alias("plain"),
        whole_text(F.col("region_x")).alias("whole"),
        fixed_text(quarter).alias("fixed"),
        one_decimal("logfc").alias("one_decimal"),
    )


@query(
    "h_casts_and_logic",
    s.sql(
        s.PIXELS,
        """SELECT region1, region2, CAST(clust AS VARCHAR) AS label, CAST(CAST(clust AS VARCHAR) AS INTEGER) AS back,
             region1 < region2 AND logfc > 0 AS up_off_diagonal, NOT (region1 = region2) AS off_diagonal FROM pixels""",
    ),
)
def casts(spark: SparkSession, d: str) -> DataFrame:
    label = F.col("clust").cast("string")
    r1, r2 = F.col("region1"), F.col("region2")
    return pixels(spark, d).select(
        "region1",
        "region2",
        label.alias("label"),
        label.cast("int").alias("back"),
        ((r1 < r2) & (F.col("logfc") > 0)).alias("up_off_diagonal"),
        (~(r1 == r2)).alias("off_diagonal"),
    )


@query(
    "h_sequence",
    s.sql(
        s.PIXELS,
        """SELECT chr, clust, unnest(range(lo, hi + 1)) AS region1 FROM (
             SELECT chr, clust, min(region1) AS lo, max(region1) AS hi FROM pixels GROUP BY chr, clust)""",
    ),
)
def bin_sequence(spark: SparkSession, d: str) -> DataFrame:
    """All bins between the least and greatest of each cluster."""
    ends = pixels(spark, d).groupBy("chr", "clust").agg(
        F.min("region1").alias("lo"), F.max("region1").alias("hi")
    )
    return ends.select("chr", "clust", F.explode(F.sequence("lo", "hi")).alias("region1"))
