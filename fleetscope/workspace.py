"""Run folders for intermediate tables in the session's shared checkpoint folder.

Iterative jobs cut their lineage by writing a Parquet table and reading it
back. All tables of one run live under one folder, so a caller that has
consumed the result can remove them with ``release`` (or ``release_all``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fleetscope.session import ensure_checkpoint_dir

_OPEN: list[Workspace] = []


class Workspace:
    """One run's folder of Parquet tables."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
        _OPEN.append(self)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as table ``name`` and return a frame that reads it."""
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.read(name, df.schema)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        """Remove one table that no live frame reads any more."""
        self._delete(f"{self.path}/{name}")

    def release(self) -> None:
        """Remove the whole run folder."""
        self._delete(self.path)
        if self in _OPEN:
            _OPEN.remove(self)

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def release_all() -> None:
    """Remove the folders of every run opened in this process."""
    for run in list(_OPEN):
        run.release()
