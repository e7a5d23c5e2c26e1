"""Readers for tab-separated and partitioned inputs.

Schemas are declared, never inferred: inference would read the files twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIXEL_SCHEMA = T.StructType(
    [
        T.StructField("chr", T.StringType()),
        T.StructField("region1", T.LongType()),
        T.StructField("region2", T.LongType()),
        T.StructField("clust", T.IntegerType()),
        T.StructField("logfc", T.DoubleType()),
        T.StructField("p_value", T.DoubleType()),
    ]
)
POLYGON_SCHEMA = T.StructType(
    [
        T.StructField("nb_clust", T.IntegerType()),
        T.StructField("id", T.LongType()),
        T.StructField("i", T.LongType()),
        T.StructField("j", T.LongType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("iff", T.DoubleType()),
    ]
)
CRITERION_SCHEMA = T.StructType(
    [T.StructField("nb_clust", T.IntegerType()), T.StructField("crit", T.DoubleType())]
)

# A listing of chunk files: bytes, then the file's name; it has no header line.
LISTING_SCHEMA = T.StructType([T.StructField("du_bytes", T.LongType()), T.StructField("name", T.StringType())])

HEADERS_AT_ONCE = 8

# Names the input files use for columns we spell in lower case.
FILE_NAMES = {"logFC": "logfc", "p.value": "p_value", "IFF": "iff"}


# How the input files spell missing and infinite numbers.  A value that is no
# number, and a file whose header is not the one it is read by, are errors.
TSV_OPTIONS = {
    "mode": "FAILFAST",
    "enforceSchema": "false",
    "sep": "\t",
    "nullValue": "NA",
    "positiveInf": "Inf",
    "negativeInf": "-Inf",
}


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Tab-separated files with a header line, which may hold more columns than ``schema``.

    Every file's own header says where its columns are: files are grouped by their header, each
    group is read at once, and the groups are united by name.  Types come from ``schema``; a column
    that a file lacks, and a number that is none, are errors.
    """
    reader = spark.read.options(**TSV_OPTIONS).option("header", True)
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, names in _headers(spark, path):
        groups.setdefault(names, []).append(file)
    parts = []
    for names, files in groups.items():
        spelled = {FILE_NAMES.get(n, n): n for n in names}
        missing = [n for n in schema.fieldNames() if n not in spelled]
        if missing:
            raise ValueError(f"columns not in the file: {missing} ({files[0]})")
        types = {spelled[f.name]: f.dataType for f in schema.fields}
        in_file = T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in names])
        # One header for all: the path itself, so that a folder of very many files stays one path.
        rows = reader.schema(in_file).csv(path if len(groups) == 1 else files)
        parts.append(rows.select(*[F.col(f"`{spelled[n]}`").alias(n) for n in schema.fieldNames()]))
    return reduce(DataFrame.unionByName, parts)


def _headers(spark: SparkSession, path: str) -> list[tuple[str, tuple[str, ...]]]:
    """Every file below ``path`` and the names in its first line; no more than that line's block is read.

    The files of a matrix are few (one per chromosome or so); some are looked at at a time.
    """
    reader = spark.read.options(**TSV_OPTIONS).option("header", True)
    # Contents are not read: only the column of paths is.
    listed = spark.read.format("binaryFile").load(path).select("path").orderBy("path").collect()
    files = [r["path"] for r in listed if not r["path"].rsplit("/", 1)[-1].startswith(("_", "."))]
    with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
        names = pool.map(lambda f: tuple(reader.csv(f).columns), files)
        found = [(f, n) for f, n in zip(files, names, strict=True) if n]
    return found or [(path, tuple(reader.csv(path).columns))]


def read_headerless_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A tab-separated file without a header line; ``schema`` gives names and types."""
    return spark.read.options(**TSV_OPTIONS | {"enforceSchema": "true"}).schema(schema).csv(path)


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    return read_headerless_tsv(spark, path, LISTING_SCHEMA)


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, PIXEL_SCHEMA)


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, POLYGON_SCHEMA)


def read_criterion(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, CRITERION_SCHEMA)


def tsv_path(root: str, prefix: str, chromosome: str | int, resolution: int) -> str:
    """Path of one chromosome's file at one resolution."""
    return f"{root}/{prefix}_chr{chromosome}_{resolution}.tsv"


def write_partitioned(df: DataFrame, root: str, resolution: int) -> None:
    """Parquet in ``chr=/resolution=`` folders, each file a range of bins.

    Range partitions split a large chromosome over tasks, and a window filter
    skips the files and row groups outside it.
    """
    keys = ("chr", "region1", "region2")
    (
        df.withColumn("resolution", F.lit(resolution))
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .write.partitionBy("chr", "resolution")
        .parquet(root)
    )


def read_partitioned(
    spark: SparkSession,
    root: str,
    chromosomes: Sequence[str] | None = None,
    resolution: int | None = None,
) -> DataFrame:
    """Pixels of some chromosomes at a resolution; other folders are not opened."""
    schema = T.StructType(
        [f for f in PIXEL_SCHEMA.fields if f.name != "chr"]
        + [
            T.StructField("chr", T.StringType()),
            T.StructField("resolution", T.IntegerType()),
        ]
    )
    df = spark.read.schema(schema).parquet(root)
    if chromosomes is not None:
        df = df.filter(F.col("chr").isin(list(chromosomes)))
    if resolution is not None:
        df = df.filter(F.col("resolution") == resolution)
    return df.select(*PIXEL_SCHEMA.fieldNames(), "resolution")
