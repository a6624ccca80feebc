"""Intermediate tables in a folder that all executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_WORK_DIR = "/tmp/checkpoints"

_written: list[tuple[SparkSession, str]] = []


def work_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`. Only a local master may go without that setting, as tests do."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (found or LOCAL_WORK_DIR).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{work_dir(spark)}/lexiloom/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the work folder and read it back: the result survives lost executors, and reads no input twice."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexiloom_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(hadoop, True)


def release(df: DataFrame) -> None:
    """Delete what `materialize` wrote, once nothing reads it any more."""
    path = getattr(df, "_lexiloom_path", None)
    if path:
        _delete(df.sparkSession, path)
        _written[:] = [w for w in _written if w[1] != path]


def clear(spark: SparkSession) -> None:
    """Delete all that this session has left in the work folder; results that are still to be read go too."""
    for s, path in _written:
        if s is spark:
            _delete(spark, path)
    _written[:] = [w for w in _written if w[0] is not spark]
