"""Readers for snapshot tables stored in a lake (Parquet), with the
explicit schemas of ``schemas``."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.functions.exprs import lsn_to_pos
from fleetscope.sources.schemas import SNAPSHOT_COLUMNS, schema


def read_snapshot(spark: SparkSession, path: str, name: str, instances: Sequence[str] | None = None,
                  since: str | None = None) -> DataFrame:
    """Read snapshot table ``name`` from ``path``. Optional filters on the
    scope keys are pushed to the Parquet scan, and prune partitions when the
    table is partitioned by those columns."""
    df = spark.read.schema(schema(name)).parquet(path)
    if instances is not None:
        df = df.where(F.col("instance").isin(list(instances)))
    if since is not None:
        df = df.where(F.col("snap_ts") >= F.lit(since).cast("timestamp"))
    return df


def with_positions(df: DataFrame) -> DataFrame:
    """``*_lsn`` text columns (``HI/LO``, as the server prints them) as the
    integer ``*_pos`` columns of the snapshot schemas."""
    for c in [c for c in df.columns if c.endswith("_lsn")]:
        df = df.withColumn(c.removesuffix("_lsn") + "_pos", lsn_to_pos(c).cast("bigint")).drop(c)
    return df


def snapshot_frame(spark: SparkSession, name: str, rows: Iterable[dict]) -> DataFrame:
    """A small snapshot table from Python rows (missing columns are NULL)."""
    cols = [c for c, _ in SNAPSHOT_COLUMNS[name]]
    data = [tuple(r.get(c) for c in cols) for r in rows]
    return spark.createDataFrame(data, schema(name))
