"""Content-addressed cache: a result is stored under the md5 of the arguments that made it."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cache_key(**arguments) -> str:
    """md5 of the arguments as JSON with sorted names and text values; names that start with _ do not count."""
    named = {k: str(v) for k, v in arguments.items() if not k.startswith("_")}
    return hashlib.md5(json.dumps(named, sort_keys=True).encode()).hexdigest()


def fingerprint(*columns: Column) -> Column:
    """md5 of columns joined by a separator."""
    return F.md5(F.concat_ws("__", *columns))


class Cache:
    """Parquet results in one folder, by key. A result counts as there once its writer has left _SUCCESS."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str, **arguments) -> str:
        return f"{self.folder}/{name}-{cache_key(**arguments)}"

    def _done(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(p)

    def get(self, name: str, make: Callable[[], DataFrame], **arguments) -> DataFrame:
        path = self.path(name, **arguments)
        if not self._done(path):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def get_all(self, make: Callable[[], dict[str, DataFrame]], names: list[str], **arguments) -> dict[str, DataFrame]:
        """Several artefacts made together: all are read only if all are there, else all are made."""
        paths = {n: self.path(n, **arguments) for n in names}
        if not all(map(self._done, paths.values())):
            for n, df in make().items():
                df.write.mode("overwrite").parquet(paths[n])
        return {n: self.spark.read.parquet(p) for n, p in paths.items()}
