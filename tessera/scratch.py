"""Tables written once in the folder that the cluster shares, to cut lineage."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.errors import SourceError


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; only a session in one process may leave it open."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise SourceError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or "/tmp/checkpoints").rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit; what is left is in the scratch folder
        return


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read back: its lineage ends there, and what was written outlives any executor.

    The table goes when the session's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)
