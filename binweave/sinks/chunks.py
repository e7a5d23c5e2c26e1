"""Chunk files by selector value, their audit, and shared chunk columns."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_FILE = 2_000_000


def write_chunks(
    df: DataFrame,
    selectors: Sequence[str],
    path: str,
    rows_per_file: int = ROWS_PER_FILE,
) -> None:
    """Tab-separated files in one folder per combination of selector values.

    ``rebalance`` brings the rows of a value together and lets adaptive
    execution split a value too large for one task over several files.  Without
    selectors the table goes to one folder.
    """
    if not selectors:
        writer = df.write
    else:
        placed = df.hint("rebalance", *selectors).sortWithinPartitions(*selectors)
        writer = placed.write.partitionBy(*selectors)
    writer.option("header", True).option("sep", "\t").option(
        "maxRecordsPerFile", rows_per_file
    ).csv(path)


def read_chunks(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Chunks as one table; a filter on a selector opens only its folders.

    ``schema`` names all columns, selectors included, with the types they had
    when written.
    """
    return spark.read.schema(schema).option("header", True).option("sep", "\t").csv(path)


def bucket_of(selectors: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*selectors), F.lit(buckets)).cast("int")


def write_bucketed_chunks(
    df: DataFrame, selectors: Sequence[str], path: str, buckets: int
) -> None:
    """Chunks for selectors with very many values: hash folders, sorted inside.

    The number of folders stays at ``buckets`` whatever the number of values;
    sorting keeps a value's rows in few row groups of its folder.
    """
    (
        df.withColumn("bucket", bucket_of(selectors, buckets))
        .hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", *selectors)
        .write.partitionBy("bucket")
        .parquet(path)
    )


def read_bucketed_chunk(
    spark: SparkSession, path: str, selection: dict[str, Any], buckets: int
) -> DataFrame:
    """Rows of one selection, from the one folder that can hold them."""
    df = spark.read.parquet(path)
    types = {f.name: f.dataType for f in df.schema.fields}
    values = [F.lit(v).cast(types[k]) for k, v in selection.items()]
    df = df.filter(F.col("bucket") == F.pmod(F.xxhash64(*values), F.lit(buckets)).cast("int"))
    for (name, _), value in zip(selection.items(), values):
        df = df.filter(F.col(name) == value)
    return df.drop("bucket")


def chunk_files(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """Name and byte size of every chunk file; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(path)
        .select(F.col("path").alias("name"), F.col("length").alias("bytes"))
    )


def audit_chunks(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Files whose listed size (``name, du_bytes``) differs from the one on disk.

    A listed file that is absent has NULL bytes, a file that is not listed NULL du_bytes.
    """
    both = listing.join(files, "name", "full")
    return both.filter(~F.col("bytes").eqNullSafe(F.col("du_bytes")))


def dependent_columns(df: DataFrame, candidates: Sequence[Sequence[str]], columns: Sequence[str]) -> DataFrame:
    """Which columns are functions of which keys: ``keys, column, groups`` for each that is.

    One pass over the rows for all candidate keys: a row counts towards its group under each of them,
    and a column depends on the keys if its least value is its greatest one in every group, NULL being
    a value of its own.  Columns that are shared by chunks are found this way, before
    ``factor_common`` splits them off.
    """
    keyed = [F.struct(F.lit(",".join(c)).alias("keys"), F.to_json(F.struct(*c), {"ignoreNullFields": "false"}).alias("group")) for c in candidates]
    rows = df.select(*dict.fromkeys(columns), F.explode(F.array(*keyed)).alias("_key")).select(*dict.fromkeys(columns), "_key.*")
    seen = rows.groupBy("keys", "group").agg(
        F.count("*").alias("_n"),
        *[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("least", F.min), ("greatest", F.max), ("known", F.count))],
    )
    one = {c: F.col(f"_least_{c}").eqNullSafe(F.col(f"_greatest_{c}")) & F.col(f"_known_{c}").isin(F.lit(0), F.col("_n")) for c in columns}
    whole = seen.groupBy("keys").agg(F.count("*").alias("groups"), *[F.bool_and(same).alias(f"_one_{c}") for c, same in one.items()])
    found = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_one_{c}").alias("one")) for c in columns])
    return whole.select("keys", "groups", F.inline(found)).filter("one").drop("one")


def factor_common(
    df: DataFrame, keys: Sequence[str], shared: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Split columns that repeat across chunks from those that vary.

    Returns the shared table, one row per key, and the varying table, which keeps the keys;
    joining on them restores ``df``.  ``shared`` must be a function of ``keys``: a key with two
    sets of shared values is an error when the shared table is read, since the join would
    multiply its rows.  See ``dependent_columns`` for finding them.
    """
    values = df.select(*keys, *shared).distinct()
    both = values.groupBy(*keys).agg(F.min(F.struct(*shared)).alias("_least"), F.max(F.struct(*shared)).alias("_greatest"))
    wrong = F.raise_error(F.lit(f"{', '.join(shared)} are no function of {', '.join(keys)}"))
    one = F.when(F.col("_least").eqNullSafe(F.col("_greatest")), F.col("_least")).otherwise(wrong)
    dim = both.select(*keys, one.alias("_one")).select(*keys, "_one.*")
    fact = df.drop(*shared)
    return dim, fact
