"""Helpers that keep multi-pass operators safe on a cluster.

``settle`` writes an intermediate table as Parquet to the folder every executor shares.
Losing an executor then never recomputes the passes before it, and Spark knows the
table's real size: joins to it are broadcast only if its files are below
``spark.sql.autoBroadcastJoinThreshold``; larger ones are shuffled, where AQE splits the
partitions of hot keys.  So no join in this package needs a broadcast hint.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_local_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate tables (``spark.checkpoint.dir``).

    Only a local session without that setting gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    global _local_folder
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="predio-")
    return _local_folder


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/predio/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str = "table") -> DataFrame:
    """Compute ``df`` once, as a Parquet table in the shared folder, and read it back."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
