"""Queries over aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binweave.functions.numeric import log10_full, neg_log10
from binweave.operators.boundary import segments
from binweave.operators.geometry import TILE, corner_extents, polygon_tiles, tiled_pixels
from binweave.operators.relational import (
    grid_counts,
    grid_sizes,
    relative_to_least,
    tagged_union,
)
from binweave.operators.summaries import (
    cluster_sizes,
    coarse_volcano_bins,
    count_of_counts,
    distinct_estimate,
    distinct_sketches,
    histogram,
    most_significant,
    multi_aggregate,
    polygon_counts,
    presence_crosstab,
    profile,
    representation_labels,
    representation_rows,
    representation_sizes,
    rounded_heat,
    size_bins,
    size_heat,
    tile_summary,
    volcano_bins,
    volcano_heat,
    with_p,
)
from binweave.plans import sql_parts as s
from binweave.plans.registry import query
from binweave.scratch import cut
from binweave.sources.stand_ins import pixels, polygons


def scored(spark: SparkSession, d: str) -> DataFrame:
    return with_p(pixels(spark, d))


def tiled(spark: SparkSession, d: str) -> DataFrame:
    return tiled_pixels(scored(spark, d))


def r9(name: str):
    """Column rounded to 9 digits: the last digits of log10 differ between engines."""
    return F.round(name, 9).alias(name)


@query("c1_count_by_key", s.sql(s.PIXELS, "SELECT chr, clust, count(*) AS pixels FROM pixels GROUP BY chr, clust"))
def count_by_key(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).groupBy("chr", "clust").agg(F.count("*").alias("pixels"))


@query(
    "c1_corners_by_position",
    s.sql(
        s.PIXELS, s.TILED,
        """SELECT rel_region_x, rel_region_y, count(*) * 5 AS corners, count(DISTINCT (chr, round_regions)) AS tiles
           FROM tiled GROUP BY rel_region_x, rel_region_y""",
    ),
)
def corners_by_position(spark: SparkSession, d: str) -> DataFrame:
    """Corner rows per place within a tile, five per pixel, over the tiles that fill it."""
    return tiled(spark, d).groupBy("rel_region_x", "rel_region_y").agg(
        (F.count("*") * 5).alias("corners"), F.count_distinct("chr", *TILE).alias("tiles")
    )


@query(
    "c2_count_of_counts",
    s.sql(
        s.PIXELS,
        'SELECT n AS "rows", count(*) AS keys FROM (SELECT count(*) AS n FROM pixels GROUP BY chr, region1, region2) GROUP BY n',
    ),
)
def uniqueness(spark: SparkSession, d: str) -> DataFrame:
    return count_of_counts(pixels(spark, d), ["chr", "region1", "region2"])


@query(
    "c2_tiles_per_cluster",
    s.sql(
        s.PIXELS, s.TILED, s.CLUSTER_SIZES,
        "SELECT tiles, count(*) AS clusters FROM sizes GROUP BY tiles",
    ),
)
def tiles_per_cluster(spark: SparkSession, d: str) -> DataFrame:
    return cluster_sizes(tiled(spark, d)).groupBy("tiles").agg(F.count("*").alias("clusters"))


@query("c3_level_frequency", s.sql(s.POLYGONS, 'SELECT nb_clust, count(*) AS "rows" FROM polygons GROUP BY nb_clust'))
def level_frequency(spark: SparkSession, d: str) -> DataFrame:
    return polygons(spark, d).groupBy("nb_clust").agg(F.count("*").alias("rows"))


@query(
    "c4_ranges",
    s.sql(
        s.PIXELS,
        """SELECT min(clust) AS clust_min, max(clust) AS clust_max, min(region1) AS region1_min,
           max(region1) AS region1_max, min(region2) AS region2_min, max(region2) AS region2_max FROM pixels""",
    ),
)
def ranges(spark: SparkSession, d: str) -> DataFrame:
    columns = ("clust", "region1", "region2")
    return pixels(spark, d).agg(
        *[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    )


@query("c5_distinct_count", s.sql(s.PIXELS, "SELECT chr, count(DISTINCT clust) AS clusters FROM pixels GROUP BY chr"))
def distinct_count(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).groupBy("chr").agg(F.count_distinct("clust").alias("clusters"))


_SKETCH = 12


@query(
    "c5_approximate_distinct",
    s.sql(
        s.PIXELS, s.TILED,
        "SELECT chr, count(DISTINCT clust) AS clusters, true AS near FROM tiled GROUP BY chr",
    ),
)
def approximate_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct clusters of a chromosome from the stored sketches of its tiles, within their bound of the exact number."""
    rows = tiled(spark, d)
    sketches = cut(distinct_sketches(rows, ["chr", *TILE], "clust", _SKETCH), "sketches")
    exact = rows.groupBy("chr").agg(F.count_distinct("clust").alias("clusters"))
    off = F.abs(F.col("distinct") - F.col("clusters"))
    near = off <= 4 * 1.04 / 2 ** (_SKETCH / 2) * F.col("clusters") + 1
    return exact.join(distinct_estimate(sketches, ["chr"]), "chr").select("chr", "clusters", near.alias("near"))


@query(
    "c6_least_corner",
    s.sql(
        s.PIXELS,
        "SELECT chr, clust, min(region1) AS region1, min(region2) AS region2 FROM pixels GROUP BY chr, clust",
    ),
)
def least_corner(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).groupBy("chr", "clust").agg(
        F.min("region1").alias("region1"), F.min("region2").alias("region2")
    )


@query(
    "c7_many_aggregates",
    s.sql(
        s.PIXELS, s.with_p(),
        """SELECT chr, clust, min(logfc) AS logfc_min, round(min(neg_log10_p), 9) AS neg_log10_p_min,
             max(logfc) AS logfc_max, round(max(neg_log10_p), 9) AS neg_log10_p_max,
             count(logfc) AS logfc_length, count(neg_log10_p) AS neg_log10_p_length
           FROM scored GROUP BY chr, clust""",
    ),
)
def many_aggregates(spark: SparkSession, d: str) -> DataFrame:
    functions = {"min": F.min, "max": F.max, "length": F.count}
    wide = multi_aggregate(scored(spark, d), ["chr", "clust"], functions, ["logfc", "neg_log10_p"])
    return wide.withColumns({c: F.round(c, 9) for c in ("neg_log10_p_min", "neg_log10_p_max")})


@query(
    "c8_rows_per_id",
    s.sql(
        s.POLYGONS,
        """SELECT nb_clust, count(*) AS id_length, count(DISTINCT id) AS id_n_uniq,
           count(*) / count(DISTINCT id) AS rows_per_id FROM polygons GROUP BY nb_clust""",
    ),
)
def rows_per_id(spark: SparkSession, d: str) -> DataFrame:
    return polygon_counts(polygons(spark, d))


@query(
    "c9_profile",
    s.sql(
        s.PIXELS, s.TILED,
        "".join(
            f"""SELECT '{c}' AS "column", CAST(min({c}) AS DOUBLE) AS least, CAST(max({c}) AS DOUBLE) AS greatest,
                CAST(NULL AS VARCHAR) AS least_text, CAST(NULL AS VARCHAR) AS greatest_text,
                count(DISTINCT {c}) AS "values" FROM tiled UNION ALL """
            for c in ("round_region_x", "round_region_y", "clust")
        )
        + """SELECT 'chr', NULL, NULL, min(chr), max(chr), count(DISTINCT chr) FROM tiled""",
    ),
)
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile(tiled(spark, d), [*TILE, "clust", "chr"])


@query(
    "c10_tile_summary",
    s.sql(
        s.PIXELS, s.TILED,
        """SELECT chr, round_region_x, round_region_y, count(*) AS pixels, count(*) * 5 AS corner_rows,
             round(avg(neg_log10_p), 6) AS mean_neg_log10_p, avg(logfc) AS mean_logfc,
             count(DISTINCT clust) AS clusters
           FROM tiled GROUP BY chr, round_region_x, round_region_y""",
    ),
)
def tiles(spark: SparkSession, d: str) -> DataFrame:
    return tile_summary(tiled(spark, d)).withColumn(
        "mean_neg_log10_p", F.round("mean_neg_log10_p", 6)
    )


_OFFSETS = {"(0,-25)": (0.0, -25.0), "(20,-25)": (20.0, -25.0)}


@query(
    "c10_tile_summary_offsets",
    s.sql(
        s.PIXELS, s.with_p(),
        " UNION ALL ".join(
            f"""SELECT '{name}' AS "offset", chr, round_even((region_x + {x}) / 50e0, 0) * 50e0 + 0e0 AS round_region_x,
                round_even((region_y + {y}) / 50e0, 0) * 50e0 + 0e0 AS round_region_y, count(*) AS pixels,
                avg(logfc) AS mean_logfc, count(DISTINCT clust) AS clusters FROM scored GROUP BY 1, 2, 3, 4"""
            for name, (x, y) in _OFFSETS.items()
        ),
    ),
)
def tiles_by_offset(spark: SparkSession, d: str) -> DataFrame:
    """The same summary on tiles with other offsets."""
    rows = scored(spark, d)
    found = {
        name: tile_summary(tiled_pixels(rows, offset=offset)).drop("corner_rows", "mean_neg_log10_p")
        for name, offset in _OFFSETS.items()
    }
    return tagged_union(found, "offset")


_POLYGON_TILES = """
ptiles AS (
  SELECT *, round_even(x / 10e0, 0) + 0e0 AS round_x, round_even(y / 10e0, 0) + 0e0 AS round_y,
         CAST(CAST(round_even(x / 10e0, 0) AS BIGINT) AS VARCHAR) || ' ' ||
         CAST(CAST(round_even(y / 10e0, 0) AS BIGINT) AS VARCHAR) AS tile_id
  FROM polygons)"""


@query(
    "c11_tile_mean",
    s.sql(
        s.POLYGONS, _POLYGON_TILES,
        """SELECT nb_clust, round_x, round_y, tile_id,
             CAST(sum(CAST(iff AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS mean_iff
           FROM ptiles GROUP BY nb_clust, round_x, round_y, tile_id""",
    ),
)
def tile_mean(spark: SparkSession, d: str) -> DataFrame:
    """Summed as decimals (prices here), so the mean does not depend on row order."""
    total = F.sum(F.col("iff").cast("decimal(18,2)")).cast("double")
    return (
        polygon_tiles(polygons(spark, d))
        .groupBy("nb_clust", "round_x", "round_y", "tile_id")
        .agg((total / F.count("*")).alias("mean_iff"))
    )


@query(
    "c12_volcano_heat",
    s.sql(
        s.PIXELS, s.with_p(), s.volcano(),
        """SELECT chr, round_logfc, round_neg_log10_p, volcano_bin, count(*) AS pixels,
             round(log10(count(*)), 9) AS log10_pixels, round_even(log10(count(*)), 0) AS heat_label
           FROM binned GROUP BY chr, round_logfc, round_neg_log10_p, volcano_bin""",
    ),
)
def heat(spark: SparkSession, d: str) -> DataFrame:
    found = volcano_heat(volcano_bins(scored(spark, d)))
    return found.withColumn("log10_pixels", F.round("log10_pixels", 9))


@query(
    "c12_coarse_volcano_heat",
    s.sql(
        s.PIXELS, s.with_p(), s.COARSE,
        """SELECT chr, round_logfc, round_neg_log10_p, volcano_bin, count(*) AS pixels
           FROM coarse GROUP BY chr, round_logfc, round_neg_log10_p, volcano_bin""",
    ),
)
def coarse_heat(spark: SparkSession, d: str) -> DataFrame:
    return volcano_heat(coarse_volcano_bins(scored(spark, d))).drop("log10_pixels", "heat_label")


@query(
    "c13_log_log_heat",
    s.sql(
        s.PIXELS, s.with_p(), s.volcano(),
        "SELECT chr, round_logfc, lnl_bin, count(*) AS pixels FROM binned GROUP BY chr, round_logfc, lnl_bin",
    ),
)
def log_log_heat(spark: SparkSession, d: str) -> DataFrame:
    """p = 1 falls in the bin named -Inf."""
    found = volcano_heat(volcano_bins(scored(spark, d)), p="round_lnl_p")
    return found.select("chr", "round_logfc", "lnl_bin", "pixels")


@query(
    "c14_log_count",
    s.sql(
        s.PIXELS, s.with_p(),
        """SELECT chr, round_even(neg_log10_p, 0) + 0e0 AS round_neg_log10_p, round_even(logfc, 0) + 0e0 AS round_logfc,
             round(log10(count(*)), 9) AS log10_pixels FROM scored GROUP BY 1, 2, 3""",
    ),
)
def log_count(spark: SparkSession, d: str) -> DataFrame:
    return rounded_heat(scored(spark, d)).withColumn("log10_pixels", F.round("log10_pixels", 9))


@query(
    "c15_cluster_sizes",
    s.sql(s.PIXELS, s.TILED, s.CLUSTER_SIZES, "SELECT chr, clust, pixels, tiles FROM sizes"),
)
def sizes(spark: SparkSession, d: str) -> DataFrame:
    return cluster_sizes(tiled(spark, d)).select("chr", "clust", "pixels", "tiles")


SIZE_BINS = """
logged AS (SELECT *, log10(pixels) AS log10_pixels, log2(tiles) AS log2_tiles FROM sizes),
size_binned AS (
  SELECT *, round_even(log10_pixels / 0.25::DOUBLE, 0) * 0.25::DOUBLE + 0e0 AS round_log10_pixels,
         round_even(log2_tiles / 0.25::DOUBLE, 0) * 0.25::DOUBLE + 0e0 AS round_log2_tiles
  FROM logged)"""


@query(
    "c16_size_heat_log2",
    s.sql(
        s.PIXELS, s.TILED, s.CLUSTER_SIZES, SIZE_BINS,
        """SELECT chr, printf('log2(tiles)=%.2f log10(pixels)=%.2f', round_log2_tiles, round_log10_pixels) AS size_bin,
             round_log2_tiles AS round_tiles, round_log10_pixels, count(*) AS clusters
           FROM size_binned GROUP BY ALL""",
    ),
)
def size_heat_log2(spark: SparkSession, d: str) -> DataFrame:
    return size_heat(size_bins(cluster_sizes(tiled(spark, d)), True), True).drop("log10_clusters")


@query(
    "c17_size_heat",
    s.sql(
        s.PIXELS, s.TILED, s.CLUSTER_SIZES, SIZE_BINS,
        """SELECT chr, printf('tiles=%.2f log10(pixels)=%.2f', CAST(tiles AS DOUBLE), round_log10_pixels) AS size_bin,
             CAST(tiles AS DOUBLE) AS round_tiles, round_log10_pixels, count(*) AS clusters
           FROM size_binned GROUP BY ALL""",
    ),
)
def size_heat_linear(spark: SparkSession, d: str) -> DataFrame:
    return size_heat(size_bins(cluster_sizes(tiled(spark, d)))).drop("log10_clusters")


@query(
    "c18_cluster_tile_pixels",
    s.sql(
        s.PIXELS, s.TILED,
        """SELECT chr, clust, round_region_x, round_region_y, count(*) AS displayed_pixels FROM tiled
           GROUP BY chr, clust, round_region_x, round_region_y""",
    ),
)
def cluster_tile_pixels(spark: SparkSession, d: str) -> DataFrame:
    return tiled(spark, d).groupBy("chr", "clust", *TILE).agg(F.count("*").alias("displayed_pixels"))


REPRESENTATION = (
    s.segments("pixels", "chr, clust")
    + ","
    + s.vertices("chr, clust")
    + """,
shapes AS (
  SELECT chr, clust, 'cluster' AS data_type, count(*) AS "rows" FROM verts GROUP BY chr, clust UNION ALL
  SELECT chr, clust, 'simplified', count(*) FILTER (keep) FROM verts GROUP BY chr, clust UNION ALL
  SELECT chr, clust, 'pixel', count(*) FROM pixels GROUP BY chr, clust)"""
)


@query(
    "c19_joined_text",
    s.sql(
        s.PIXELS, REPRESENTATION,
        """SELECT p.chr, p.clust, min(region1) AS region1, min(region2) AS region2, 4 * count(*) AS corners,
             'cluster ' || p.clust || chr(10) || 'cluster rows= ' || max(c."rows") || chr(10) ||
             'simplified rows= ' || max(t."rows") || chr(10) || 'pixel rows= ' || count(*) ||
             ' corners= ' || 4 * count(*) AS label
           FROM pixels p JOIN shapes c ON c.chr = p.chr AND c.clust = p.clust AND c.data_type = 'cluster'
             JOIN shapes t ON t.chr = p.chr AND t.clust = p.clust AND t.data_type = 'simplified'
           GROUP BY p.chr, p.clust""",
    ),
)
def joined_text(spark: SparkSession, d: str) -> DataFrame:
    px = pixels(spark, d)
    keys = ["chr", "clust"]
    return representation_labels(representation_sizes(px, segments(px, keys)))


@query(
    "c20_conditional_value",
    s.sql(
        s.PIXELS, REPRESENTATION,
        """SELECT chr, clust, max("rows") FILTER (data_type = 'pixel') * 4 AS corners,
           max("rows") FILTER (data_type = 'simplified') AS simplified FROM shapes GROUP BY chr, clust""",
    ),
)
def conditional_value(spark: SparkSession, d: str) -> DataFrame:
    px = pixels(spark, d)
    rows = representation_rows(representation_sizes(px, segments(px, ["chr", "clust"])))
    of = lambda kind: F.max(F.when(F.col("data_type") == kind, F.col("rows")))
    return rows.groupBy("chr", "clust").agg(
        (of("pixel") * 4).alias("corners"), of("simplified").alias("simplified")
    )


@query(
    "c21_most_significant",
    s.sql(
        s.PIXELS, s.with_p(), s.volcano(),
        """SELECT volcano_bin, chr, clust, region1, region2 FROM binned
           ORDER BY p_value, chr, region1, region2 LIMIT 1""",
    ),
)
def best_pixel(spark: SparkSession, d: str) -> DataFrame:
    columns = ["volcano_bin", "chr", "clust", "region1", "region2"]
    return most_significant(volcano_bins(scored(spark, d)), columns)


_CROSS = range(1, 13)


@query(
    "c22_presence_crosstab",
    s.sql(
        s.PIXELS,
        "SELECT chr, region1, "
        + ", ".join(f'count(*) FILTER (region2 = {k}) AS "{k}"' for k in _CROSS)
        + " FROM pixels WHERE region1 > 0 AND region1 < 13 AND region2 > 0 AND region2 < 13 GROUP BY chr, region1",
    ),
)
def crosstab(spark: SparkSession, d: str) -> DataFrame:
    return presence_crosstab(pixels(spark, d), 0, 13)


def _histogram_sql(column: str, bins: int, source: str) -> str:
    return f"""SELECT bin, low + (bin - 1) * width AS lower, low + bin * width AS upper, count(*) AS count FROM (
        SELECT low, width, CAST(least(greatest(ceil(({column} - low) / width), 1), {bins}) AS INTEGER) AS bin
        FROM {source}, (SELECT min({column}) AS low, (max({column}) - min({column})) / {bins}e0 AS width FROM {source}))
        GROUP BY bin, low, width"""


@query("c23_histogram_logfc", s.sql(s.PIXELS, _histogram_sql("logfc", 20, "pixels")))
def logfc_histogram(spark: SparkSession, d: str) -> DataFrame:
    return histogram(pixels(spark, d), "logfc", 20)


@query(
    "c23_histogram_p",
    s.sql(
        s.PIXELS, s.with_p(), "r AS (SELECT round(neg_log10_p, 9) AS v FROM scored)", _histogram_sql("v", 100, "r")
    ),
)
def p_histogram(spark: SparkSession, d: str) -> DataFrame:
    rounded = pixels(spark, d).select(F.round(neg_log10(F.col("p_value")), 9).alias("v"))
    return histogram(rounded, "v", 100)


@query(
    "c23_histogram_sizes",
    s.sql(
        s.PIXELS,
        "r AS (SELECT round(log10(count(*)), 9) AS v FROM pixels GROUP BY chr, clust)",
        _histogram_sql("v", 10, "r"),
    ),
)
def size_histogram(spark: SparkSession, d: str) -> DataFrame:
    counts = pixels(spark, d).groupBy("chr", "clust").agg(F.count("*").alias("n"))
    return histogram(counts.select(F.round(log10_full(F.col("n")), 9).alias("v")), "v", 10)


def _default_histogram_sql(value: str, source: str) -> str:
    return f"""
      SELECT CAST(bin AS INTEGER) AS bin, (start + bin - 1) * width AS lower, (start + bin) * width AS upper, count(*) AS count FROM (
        SELECT start, width, greatest(ceil({value} / width) - start, 1) AS bin FROM {source}, (
          SELECT width, floor(low / width) AS start FROM (
            SELECT low, CASE WHEN high = low THEN 1e0 ELSE power * CASE WHEN least / power <= 1 THEN 1 WHEN least / power <= 2 THEN 2
                     WHEN least / power <= 5 THEN 5 ELSE 10 END END AS width
            FROM (SELECT low, high, least, pow(10e0, floor(log10(least))) AS power FROM (
              SELECT min({value}) AS low, max({value}) AS high, (max({value}) - min({value})) / (ceil(log2(count({value}))) + 1) AS least FROM {source}))))
      ) GROUP BY start, width, bin"""


@query("c23_histogram_default_logfc", s.sql(s.PIXELS, _default_histogram_sql("logfc", "pixels")))
def default_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Bins of a round width, as many as the number of pixels calls for."""
    return histogram(pixels(spark, d), "logfc")


@query("c23_histogram_default_p", s.sql(s.PIXELS, _default_histogram_sql("p_value", "pixels")))
def default_p_histogram(spark: SparkSession, d: str) -> DataFrame:
    return histogram(pixels(spark, d), "p_value")


@query("c24_extents", s.sql(s.PIXELS, s.TILED, s.EXTENTS, "SELECT * FROM extents"))
def extents(spark: SparkSession, d: str) -> DataFrame:
    return corner_extents(tiled(spark, d))


@query("c25_representation_rows", s.sql(s.PIXELS, REPRESENTATION, "SELECT * FROM shapes"))
def representations(spark: SparkSession, d: str) -> DataFrame:
    px = pixels(spark, d)
    return representation_rows(representation_sizes(px, segments(px, ["chr", "clust"])))


POLYGON_REL = """
least AS (SELECT nb_clust, round_x, round_y, min(x) AS lx, min(y) AS ly FROM ptiles GROUP BY 1, 2, 3),
prel AS (SELECT p.*, x - lx AS rel_x, y - ly AS rel_y FROM ptiles p JOIN least USING (nb_clust, round_x, round_y))"""
POLYGON_TILES = _POLYGON_TILES


@query(
    "c26_extents_by_level_and_tile",
    s.sql(
        s.POLYGONS, POLYGON_TILES, POLYGON_REL,
        """SELECT nb_clust, tile_id, min(rel_x) AS rel_x_min, max(rel_x) AS rel_x_max,
             min(rel_y) AS rel_y_min, max(rel_y) AS rel_y_max FROM prel GROUP BY nb_clust, tile_id""",
    ),
)
def extents_by_tile(spark: SparkSession, d: str) -> DataFrame:
    keys = ["nb_clust", "round_x", "round_y"]
    rel = relative_to_least(polygon_tiles(polygons(spark, d)), keys, ["x", "y"])
    return rel.groupBy("nb_clust", "tile_id").agg(
        *[f(c).alias(f"{c}_{n}") for c in ("rel_x", "rel_y") for n, f in (("min", F.min), ("max", F.max))]
    )


GRID_SIZES = """
firsts AS (SELECT DISTINCT chr, region1 FROM pixels),
seconds AS (SELECT DISTINCT chr, region2 FROM pixels),
grid_sizes AS (
  SELECT f.chr, f.region1, count(*) AS cells FROM firsts f
  JOIN seconds s ON s.chr = f.chr AND f.region1 <= s.region2 GROUP BY f.chr, f.region1)"""


@query(
    "c27_grid_counts",
    s.sql(
        s.PIXELS, GRID_SIZES,
        """SELECT possible - present AS missing, possible,
             (possible - present) || ' missing pixels out of ' || possible || ' possible in grid' AS title
           FROM (SELECT CAST(sum(cells) AS BIGINT) AS possible, (SELECT count(*) FROM pixels) AS present FROM grid_sizes)""",
    ),
)
def missing_and_possible(spark: SparkSession, d: str) -> DataFrame:
    return grid_counts(pixels(spark, d))


@query("c27_grid_cells_by_bin", s.sql(s.PIXELS, GRID_SIZES, "SELECT * FROM grid_sizes"))
def cells_by_bin(spark: SparkSession, d: str) -> DataFrame:
    return grid_sizes(pixels(spark, d))
