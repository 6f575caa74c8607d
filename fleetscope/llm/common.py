"""What every query of the subpackage does first."""

from __future__ import annotations

import gc
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from fleetscope.session import configure


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings, and this package on the Python workers' path when
    they share the driver's file system (a cluster installs the package)."""
    configure(spark)
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def tidy(spark: SparkSession) -> None:
    """Let shuffle files of finished steps go: Spark removes them once their
    plans are collected, which a job of few, large steps may not come to in
    time. Only disk depends on it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
