"""Tables written to cut lineage, kept in the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    On a single machine (master ``local``) without that setting a temporary folder is made and
    set; on a cluster its absence is an error, since no local folder would do.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not context.getCheckpointDir():
            context.setCheckpointDir(tempfile.mkdtemp(prefix="binweave-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path nobody has used yet below the shared folder."""
    return f"{shared_folder(spark)}/binweave/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet and read it back.

    Readers prune columns and push filters into the written table, and a lost
    executor costs no recomputation of what came before it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
