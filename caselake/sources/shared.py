"""Tables and folders in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Most bytes of a batch between Spark and a Python worker; Spark's default of 64 MB, as objects and with its results, is held several times at once.
ARROW_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to ARROW_BYTES, so that a worker's memory doesn't grow with its partition."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; on local[...] a folder is set where there is none, elsewhere that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, for results that several later steps read."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
