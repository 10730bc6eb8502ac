"""Tables in the folder that driver and executors share, for results that are read more than once."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path below spark.checkpoint.dir, deleted when the driver ends. Only local mode, where there is one machine, may do without
    that setting."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = f"{tempfile.gettempdir()}/quillspark-scratch"
    path = f"{top}/engine/{tag}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended; the folder is scratch
        pass


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
