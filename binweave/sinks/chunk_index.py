"""Chunk files in order of their selectors, with an index that says which files hold a selection.

A folder per selector value does not go far: a view has thousands of volcano bins and tiles.  Here rows
are sorted by the selectors into files of about equal size, and one index row per file tells its
least and greatest selectors.  A selection looks at the index and opens only the files that can hold it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binweave.sinks.chunks import ROWS_PER_FILE

TASK_ROWS = 200_000  # rows a task writes, as so many files as they fill
FORMATS = {"parquet": {}, "csv": {"header": True, "sep": "\t"}}
ROWS, INDEX = "rows", "index"


def write_indexed_chunks(
    df: DataFrame, selectors: Sequence[str], path: str, rows_per_file: int = ROWS_PER_FILE, fmt: str = "parquet"
) -> None:
    """Files of about ``rows_per_file`` rows in the order of ``selectors``, and their index.

    Rows are dealt by ranges of the selectors and then at random, so that a value with very many
    rows fills several files and no task holds it whole.  Small files are not a task each: there are
    tasks for ``TASK_ROWS`` rows, or one per shuffle partition if that is more, and each cuts its
    range into files.  ``fmt`` is parquet, or csv for tab-separated text.
    """
    rows = df.count()
    files = rows // rows_per_file + 1
    tasks = min(files, max(rows // TASK_ROWS + 1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ranged = df.repartitionByRange(tasks, *selectors, F.rand(7)).sortWithinPartitions(*selectors)
    most = {"maxRecordsPerFile": rows_per_file} if tasks < files else {}
    ranged.write.format(fmt).options(**FORMATS[fmt], **most).save(f"{path}/{ROWS}")
    written = df.sparkSession.read.format(fmt).options(**FORMATS[fmt]).schema(df.schema).load(f"{path}/{ROWS}")
    # Distinct values first, by hash: whole rows are never sorted for their extremes.
    values = written.select(F.col("_metadata.file_name").alias("file"), *selectors).groupBy("file", *selectors).agg(F.count("*").alias("n"))
    key = F.struct(*selectors)
    index = values.groupBy("file").agg(F.min(key).alias("least"), F.max(key).alias("greatest"), F.sum("n").alias("rows"))
    index.coalesce(1).write.parquet(f"{path}/{INDEX}")  # one row per file


@dataclass
class IndexedChunks:
    """Chunks written by ``write_indexed_chunks``."""

    spark: SparkSession
    path: str
    schema: T.StructType
    selectors: Sequence[str]
    fmt: str = "parquet"

    def _load(self, *paths: str) -> DataFrame:
        return self.spark.read.format(self.fmt).options(**FORMATS[self.fmt]).schema(self.schema).load(list(paths))

    @property
    def index(self) -> DataFrame:
        """``file, least, greatest, rows`` of every file, in the order of the selectors."""
        return self.spark.read.parquet(f"{self.path}/{INDEX}").orderBy("least", "greatest", "file")

    def all(self) -> DataFrame:
        return self._load(f"{self.path}/{ROWS}")

    def files(self, selection: Mapping[str, Any]) -> list[str]:
        """Files that can hold the selection: those whose range meets the leading selectors it gives.

        A selector without a value ends what the index can tell; None is a value.
        """
        given = []
        for s in self.selectors:
            if s not in selection:
                break
            given.append(s)
        found = self.index
        if given:
            wanted = F.struct(*[F.lit(selection[s]).cast(self.schema[s].dataType).alias(s) for s in given])
            part = lambda end: F.struct(*[F.col(f"{end}.{s}").alias(s) for s in given])
            found = found.filter((part("least") <= wanted) & (part("greatest") >= wanted))
        return [row["file"] for row in found.select("file").collect()]  # as many as hold the selection

    def read(self, selection: Mapping[str, Any]) -> DataFrame:
        """Rows of the selection, from just those files."""
        names = self.files(selection)
        if not names:
            return self.spark.createDataFrame([], self.schema)
        rows = self._load(*[f"{self.path}/{ROWS}/{n}" for n in names])
        same: list[Column] = [F.col(s).eqNullSafe(F.lit(v).cast(self.schema[s].dataType)) for s, v in selection.items()]
        return rows.filter(reduce(lambda a, b: a & b, same)) if same else rows
