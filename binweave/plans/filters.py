"""Queries over projections and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binweave.functions.numeric import bin_by_width
from binweave.operators.geometry import corner_extents, rotate, tiled_pixels
from binweave.operators.boundary import segments, simplified_vertices
from binweave.operators.relational import (
    above_subset_max,
    columns_like,
    index_shift,
    inside_extents,
    join_spread,
    rows_of_ranked_keys,
    strictly_between,
    window,
)
from binweave.operators.selection import diagonal_pixels
from binweave.operators.summaries import coarse_volcano_bins, profile, with_p
from binweave.plans import sql_parts as s
from binweave.plans.registry import query
from binweave.sources.stand_ins import pixels, polygons


@query(
    "b1_derive",
    s.sql(
        s.PIXELS, s.with_p(),
        """SELECT region1, region2, CAST(clust AS VARCHAR) AS cluster,
           round(neg_log10_p, 9) AS neg_log10_p FROM scored""",
    ),
)
def derive(spark: SparkSession, d: str) -> DataFrame:
    return with_p(pixels(spark, d)).select(
        "region1",
        "region2",
        F.col("clust").cast("string").alias("cluster"),
        F.round("neg_log10_p", 9).alias("neg_log10_p"),
    )


@query(
    "b2_per_axis",
    s.sql(
        s.PIXELS,
        """SELECT region1, region2, round_even(region1 / 50e0, 0) * 50e0 AS round_region1,
           round_even(region2 / 50e0, 0) * 50e0 AS round_region2 FROM pixels""",
    ),
)
def per_axis(spark: SparkSession, d: str) -> DataFrame:
    axes = ("region1", "region2")
    return pixels(spark, d).select(
        *axes, *[bin_by_width(F.col(a), 50.0).alias(f"round_{a}") for a in axes]
    )


@query("b3_project", s.sql(s.PIXELS, "SELECT clust AS cluster, region1 AS x, region2 AS y FROM pixels"))
def project(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).select(
        F.col("clust").alias("cluster"), F.col("region1").alias("x"), F.col("region2").alias("y")
    )


@query(
    "b4_open_range",
    s.sql(
        s.PIXELS,
        "SELECT * FROM pixels WHERE 0 < region1 AND region1 < 100 AND 0 < region2 AND region2 < 100",
    ),
)
def open_range(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).filter(strictly_between(["region1", "region2"], 0, 100))


@query(
    "b5_band",
    s.sql(
        s.PIXELS, s.with_p(),
        """SELECT region1, region2, round(sign_neg_log10_p, 9) AS sign_neg_log10_p FROM scored
           WHERE region2 < region1 + 40 AND region2 < 1500""",
    ),
)
def band(spark: SparkSession, d: str) -> DataFrame:
    near = pixels(spark, d).filter(
        (F.col("region2") < F.col("region1") + 40) & (F.col("region2") < 1500)
    )
    return with_p(near).select(
        "region1", "region2", F.round("sign_neg_log10_p", 9).alias("sign_neg_log10_p")
    )


@query("b6_window", s.sql(s.PIXELS, "SELECT * FROM pixels WHERE region1 <= 1000 AND region2 <= 1000"))
def upper_window(spark: SparkSession, d: str) -> DataFrame:
    return window(pixels(spark, d), 1000)


@query("b7_window_off", s.sql(s.PIXELS, "SELECT * FROM pixels"))
def window_off(spark: SparkSession, d: str) -> DataFrame:
    return window(pixels(spark, d), None)


@query("b8_one_cluster", s.sql(s.PIXELS, "SELECT * FROM pixels WHERE clust = 406"))
def one_cluster(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).filter(F.col("clust") == 406)


@query("b9_cluster_set", s.sql(s.PIXELS, "SELECT * FROM pixels WHERE clust IN (101, 203, 406, 708)"))
def cluster_set(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).filter(F.col("clust").isin(101, 203, 406, 708))


@query(
    "b10_ranked_keys",
    s.sql(
        s.PIXELS,
        """SELECT p.* FROM pixels p JOIN (
             SELECT chr, clust, row_number() OVER (ORDER BY chr, clust) AS r
             FROM (SELECT DISTINCT chr, clust FROM pixels)) k USING (chr, clust) WHERE r IN (1, 40)""",
    ),
)
def ranked_keys(spark: SparkSession, d: str) -> DataFrame:
    return rows_of_ranked_keys(pixels(spark, d), ["chr", "clust"], [1, 40])


@query(
    "b10_ranked_tiles",
    s.sql(
        s.PIXELS, s.TILED,
        """SELECT chr, round_region_x, round_region_y, region1, region2 FROM tiled
           WHERE (chr, round_region_x, round_region_y) IN (
             SELECT (chr, round_region_x, round_region_y) FROM tiled
             GROUP BY chr, round_region_x, round_region_y ORDER BY chr, round_region_x, round_region_y LIMIT 2)""",
    ),
)
def ranked_tiles(spark: SparkSession, d: str) -> DataFrame:
    keys = ["chr", "round_region_x", "round_region_y"]
    return rows_of_ranked_keys(tiled_pixels(pixels(spark, d)), keys, [1, 2]).select(
        *keys, "region1", "region2"
    )


@query(
    "b11_above_subset_max",
    s.sql(
        s.PIXELS, s.with_p(), s.COARSE,
        """SELECT region1, region2, round_logfc, round_neg_log10_p FROM coarse
           WHERE abs(round_logfc) > (SELECT max(abs(round_logfc)) FROM coarse WHERE round_neg_log10_p = 0 AND abs(logfc) < 1)""",
    ),
)
def above_max(spark: SparkSession, d: str) -> DataFrame:
    binned = coarse_volcano_bins(with_p(pixels(spark, d))).withColumn("size", F.abs("round_logfc"))
    return above_subset_max(binned, "size", (F.col("round_neg_log10_p") == 0) & (F.abs("logfc") < 1)).select(
        "region1", "region2", "round_logfc", "round_neg_log10_p"
    )


@query(
    "b12_index_shift",
    s.sql(
        s.PIXELS,
        """SELECT pixels.*, region2 - m + 1 AS i, region1 - m + 1 AS j
           FROM pixels JOIN (SELECT chr, least(min(region1), min(region2)) AS m FROM pixels GROUP BY chr) USING (chr)""",
    ),
)
def shifted(spark: SparkSession, d: str) -> DataFrame:
    return index_shift(pixels(spark, d))


@query(
    "b13_unmatched",
    s.sql(
        s.PIXELS, s.POLYGONS,
        """SELECT l.nb_clust, p.region1, p.region2 FROM pixels p CROSS JOIN (SELECT DISTINCT nb_clust FROM polygons) l
           LEFT JOIN (SELECT DISTINCT nb_clust, i, j FROM polygons) q ON p.region2 = q.i AND p.region1 = q.j AND q.nb_clust = l.nb_clust
           WHERE q.i IS NULL""",
    ),
)
def unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Pixels without a polygon, for each level of the polygons.

    A cell has the levels of its polygons, so pixels are joined once and not once per level.
    """
    drawn = polygons(spark, d).select("nb_clust", F.col("i").alias("region2"), F.col("j").alias("region1"))
    cells = drawn.groupBy("region1", "region2").agg(F.collect_set("nb_clust").alias("drawn"))
    levels = drawn.agg(F.collect_set("nb_clust")).scalar()  # as many as the polygons have levels
    joined = join_spread(pixels(spark, d).select("region1", "region2"), cells, ["region1", "region2"])
    none = F.array().cast("array<int>")
    absent = F.array_except(levels, F.coalesce(F.col("drawn").cast("array<int>"), none))
    return joined.select(F.explode(absent).alias("nb_clust"), "region1", "region2")


_KEYS = ["chr", "clust", "round_region_x", "round_region_y"]
_KEY_SQL = "chr, clust, round_region_x, round_region_y"


@query(
    "b14_inside_extents",
    s.sql(
        s.PIXELS, s.TILED, s.EXTENTS, s.segments("tiled", _KEY_SQL), s.vertices(_KEY_SQL),
        f"""SELECT {_KEY_SQL}, rel_region_x, rel_region_y FROM (
              SELECT *, (x / 2e0 + y / 2e0) / 2e0 - round_region_x AS rel_region_x,
                     (y / 2e0 - x / 2e0) / 2e0 - round_region_y AS rel_region_y FROM verts WHERE keep), extents
            WHERE rel_region_x > rel_corner_x_min AND rel_region_x < rel_corner_x_max
              AND rel_region_y > rel_corner_y_min AND rel_region_y < rel_corner_y_max""",
    ),
)
def inside(spark: SparkSession, d: str) -> DataFrame:
    """Turns of local outlines strictly inside the extents of all relative corners."""
    tiled = tiled_pixels(pixels(spark, d))
    turns = simplified_vertices(segments(tiled, _KEYS), _KEYS).withColumnsRenamed(
        {"x": "region1", "y": "region2"}
    )
    placed = rotate(turns, "region").select(
        *_KEYS,
        (F.col("region_x") - F.col("round_region_x")).alias("rel_region_x"),
        (F.col("region_y") - F.col("round_region_y")).alias("rel_region_y"),
    )
    names = {"rel_region_x": "rel_corner_x", "rel_region_y": "rel_corner_y"}
    return inside_extents(placed, corner_extents(tiled), names)


@query(
    "b15_round_columns",
    s.sql(
        s.PIXELS, s.with_p(), s.COARSE,
        """SELECT 'round_logfc' AS "column", min(round_logfc) AS least, max(round_logfc) AS greatest,
             count(DISTINCT round_logfc) AS "values" FROM coarse
           UNION ALL SELECT 'round_neg_log10_p', min(round_neg_log10_p), max(round_neg_log10_p),
             count(DISTINCT round_neg_log10_p) FROM coarse""",
    ),
)
def round_columns(spark: SparkSession, d: str) -> DataFrame:
    binned = coarse_volcano_bins(with_p(pixels(spark, d)))
    return profile(binned, columns_like(binned, "round")).select("column", "least", "greatest", "values")


@query("b16_head", s.sql(s.PIXELS, "SELECT * FROM pixels ORDER BY chr, region1, region2 LIMIT 2"))
def head(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).orderBy("chr", "region1", "region2").limit(2)


@query(
    "b17_diagonal_head",
    s.sql(s.PIXELS, "SELECT * FROM pixels WHERE region1 = region2 ORDER BY chr, region1 LIMIT 5"),
)
def diagonal_head(spark: SparkSession, d: str) -> DataFrame:
    return diagonal_pixels(pixels(spark, d), 5)


@query("b18_reversed", s.sql(s.PIXELS, "SELECT * FROM pixels ORDER BY region1 DESC, region2 DESC"))
def backwards(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).orderBy(F.desc("region1"), F.desc("region2"))


@query("b19_threshold", s.sql(s.POLYGONS, "SELECT * FROM polygons WHERE y < 30"))
def threshold(spark: SparkSession, d: str) -> DataFrame:
    return polygons(spark, d).filter(F.col("y") < 30)
