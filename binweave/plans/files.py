"""Queries over readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binweave.operators.geometry import (
    corners,
    position_name,
    relative_corners,
    relative_shape,
    restore_corners,
    tiled_pixels,
)
from binweave.operators.summaries import volcano_bins, with_p
from binweave.plans import sql_parts as s
from binweave.plans.registry import query
from binweave.scratch import new_path
from binweave.sinks.chunk_index import IndexedChunks, write_indexed_chunks
from binweave.sinks.chunks import (
    audit_chunks,
    chunk_files,
    dependent_columns,
    factor_common,
    read_bucketed_chunk,
    write_bucketed_chunks,
    write_chunks,
)
from binweave.sources.stand_ins import criterion, pixels
from binweave.sources.tables import (
    CRITERION_SCHEMA,
    read_headerless_tsv,
    read_partitioned,
    read_pixels,
    write_partitioned,
)


@query("a1_read_pixels", s.sql(s.PIXELS, "SELECT * FROM pixels"))
def read_pixel_file(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "pixels-tsv")
    named = pixels(spark, d).withColumnsRenamed({"logfc": "logFC", "p_value": "p.value"})
    named.write.option("sep", "\t").option("header", True).csv(path)
    return read_pixels(spark, path)


@query("a2_read_named_columns", s.sql(s.CRITERION, "SELECT * FROM criterion"))
def read_named(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "criterion-tsv")
    criterion(spark, d).write.option("sep", "\t").csv(path)
    return read_headerless_tsv(spark, path, CRITERION_SCHEMA)


@query(
    "a3_read_chromosome",
    s.sql(s.PIXELS, "SELECT *, CAST(50000 AS INTEGER) AS resolution FROM pixels WHERE chr = 'chr1'"),
)
def read_chromosome(spark: SparkSession, d: str) -> DataFrame:
    root = new_path(spark, "pixels-by-chr")
    write_partitioned(pixels(spark, d), root, 50_000)
    return read_partitioned(spark, root, ["chr1"], 50_000)


@query(
    "a4_chunks",
    s.sql(
        s.PIXELS,
        s.with_p(),
        s.volcano(),
        "SELECT chr, volcano_bin, region1, region2, clust, logfc FROM binned",
    ),
)
def chunks(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "chunks")
    rows = volcano_bins(with_p(pixels(spark, d))).select(
        "region1", "region2", "clust", "logfc", "chr", "volcano_bin"
    )
    selectors = ["chr", "volcano_bin"]
    write_indexed_chunks(rows, selectors, path, 50_000, "csv")
    return IndexedChunks(spark, path, rows.schema, selectors, "csv").all()


@query(
    "a4_indexed_chunk",
    s.sql(
        s.PIXELS, s.with_p(), s.volcano(),
        """SELECT chr, volcano_bin, region1, region2, clust, logfc FROM binned
           WHERE chr = 'chr1' AND volcano_bin = 'logFC=0.25 -log10(p)=0'""",
    ),
)
def indexed_chunk(spark: SparkSession, d: str) -> DataFrame:
    """One chunk of the same files, through their index."""
    path = new_path(spark, "chunks")
    rows = volcano_bins(with_p(pixels(spark, d))).select("region1", "region2", "clust", "logfc", "chr", "volcano_bin")
    selectors = ["chr", "volcano_bin"]
    write_indexed_chunks(rows, selectors, path, 10_000)
    return IndexedChunks(spark, path, rows.schema, selectors).read({"chr": "chr1", "volcano_bin": "logFC=0.25 -log10(p)=0"})


@query(
    "a4_chunk_index",
    s.sql(
        s.PIXELS,
        """SELECT CAST(count(*) AS BIGINT) AS "rows", min(chr) AS chr, min(clust) FILTER (WHERE chr = (SELECT min(chr) FROM pixels)) AS clust,
             true AS in_order FROM pixels""",
    ),
)
def chunk_index(spark: SparkSession, d: str) -> DataFrame:
    """What an index says of all files: their rows, the least selectors, and that ranges follow each other."""
    path = new_path(spark, "chunks")
    rows = pixels(spark, d).select("chr", "clust", "region1", "region2")
    write_indexed_chunks(rows, ["chr", "clust"], path, 1_000)
    index = IndexedChunks(spark, path, rows.schema, ["chr", "clust"]).index
    ranges = F.sort_array(F.collect_list(F.struct("least", "greatest")))
    # Each range beside the next one: looking ranges up by number would sort them anew for every file.
    others = F.greatest(F.size(ranges) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(ranges, 1, others), F.slice(ranges, 2, others), lambda a, b: a.greatest <= b.least)
    first = F.element_at(ranges, 1).least
    return index.agg(F.sum("rows").alias("rows"), first.chr.alias("chr"), first.clust.alias("clust"), F.forall(pairs, lambda x: x).alias("in_order"))


@query(
    "a4_bucketed_chunk",
    s.sql(s.PIXELS, "SELECT chr, clust, region1, region2, logfc FROM pixels WHERE chr = 'chr1' AND clust = 406"),
)
def bucketed_chunk(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "bucketed")
    rows = pixels(spark, d).select("chr", "clust", "region1", "region2", "logfc")
    write_bucketed_chunks(rows, ["chr", "clust"], path, 64)
    return read_bucketed_chunk(spark, path, {"chr": "chr1", "clust": 406}, 64)


@query(
    "a5_audit",
    s.sql(
        s.PIXELS,
        """SELECT CAST(count(DISTINCT chr) AS BIGINT) AS files, CAST(count(DISTINCT chr) AS BIGINT) AS wrong,
           CAST(0 AS BIGINT) AS unexpected FROM pixels""",
    ),
)
def audit(spark: SparkSession, d: str) -> DataFrame:
    """Files written, those found wrong when each listed size is one byte off, and when none is."""
    path = new_path(spark, "audited")
    write_chunks(pixels(spark, d), ["chr"], path)
    files = chunk_files(spark, path)
    listed = files.select("name", F.col("bytes").alias("du_bytes"))
    off = listed.withColumn("du_bytes", F.col("du_bytes") + 1)
    return files.agg(F.count("*").alias("files")).select(
        "files",
        audit_chunks(files, off).agg(F.count("*")).scalar().alias("wrong"),
        audit_chunks(files, listed).agg(F.count("*")).scalar().alias("unexpected"),
    )


_VARYING = ["chr", "region1", "region2", "logfc", "rel_regions"]


def _corner_rows(spark: SparkSession, d: str) -> DataFrame:
    tiled = position_name(tiled_pixels(pixels(spark, d)))
    narrow = tiled.select(*_VARYING, "round_region_x", "round_region_y")
    return relative_corners(corners(narrow, 0.45, closed=True)).select(
        *_VARYING, "corner_ord", "rel_corner_x", "rel_corner_y"
    )


_REL = f"""
named AS (
  SELECT *, {s.number_text('rel_region_x')} || ',' || {s.number_text('rel_region_y')} AS rel_regions
  FROM rel_corners)"""


@query(
    "a6_shared_shape",
    s.sql(
        s.PIXELS, s.TILED, s.EXTENTS, _REL,
        "SELECT DISTINCT rel_regions, corner_ord, rel_corner_x, rel_corner_y FROM named",
    ),
)
def shared_shape(spark: SparkSession, d: str) -> DataFrame:
    shape = position_name(relative_shape(tiled_pixels(pixels(spark, d))))
    return shape.drop("rel_region_x", "rel_region_y")


@query(
    "a6_factored",
    s.sql(
        s.PIXELS, s.TILED, s.EXTENTS, _REL,
        "SELECT DISTINCT rel_regions, corner_ord, rel_corner_x, rel_corner_y FROM named",
    ),
)
def factored(spark: SparkSession, d: str) -> DataFrame:
    """The same shape, found by splitting the corner table itself."""
    keys, shared = ["rel_regions", "corner_ord"], ["rel_corner_x", "rel_corner_y"]
    return factor_common(_corner_rows(spark, d), keys, shared)[0]


_CANDIDATES = [["rel_regions"], ["rel_regions", "corner_ord"], ["chr", "corner_ord"], ["chr", "region1", "region2"]]
_CHECKED = ["logfc", "rel_corner_x", "rel_corner_y", "corner_ord"]


@query(
    "a6_dependent_columns",
    s.sql(
        s.PIXELS, s.TILED, s.EXTENTS, _REL,
        " UNION ALL ".join(
            f"""SELECT '{','.join(k)}' AS keys, '{c}' AS "column", count(*) AS groups
                FROM (SELECT count(DISTINCT {c}) AS n FROM named GROUP BY {', '.join(k)}) HAVING max(n) = 1"""
            for k in _CANDIDATES
            for c in _CHECKED
        ),
    ),
)
def dependent(spark: SparkSession, d: str) -> DataFrame:
    """Which columns of the corner table repeat with which keys: the shape does with a corner's place."""
    return dependent_columns(_corner_rows(spark, d), _CANDIDATES, _CHECKED)


@query(
    "a6_restored",
    s.sql(
        s.PIXELS, s.TILED, s.EXTENTS, _REL,
        "SELECT chr, region1, region2, logfc, rel_regions, corner_ord, rel_corner_x, rel_corner_y FROM named",
    ),
)
def restored(spark: SparkSession, d: str) -> DataFrame:
    """Pixels joined back to the shared shape: the corner table again."""
    tiled = position_name(tiled_pixels(pixels(spark, d)))
    narrow = tiled.select(*_VARYING, "rel_region_x", "rel_region_y")
    whole = restore_corners(narrow, relative_shape(tiled))
    return whole.drop("rel_region_x", "rel_region_y")
