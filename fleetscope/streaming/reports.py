"""Structured Streaming forms of two reports.

The reference is polled (``\\watch 5``); a fleet feeds snapshots
continuously, so two reports also run as streaming queries over the snapshot
feed: the session-state mix per time window (with a watermark for late
snapshots) and the latest progress row per running command.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from fleetscope.workspace import Workspace


# What the session mix reads of a sessions feed.
SESSION_MIX_COLUMNS = ["instance", "snap_ts", "backend_type", "state", "is_collector"]


def stream_session_mix(activity: DataFrame, window: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Client backends (collector excluded) per instance, tumbling
    window of ``snap_ts`` and state. Snapshots later than ``lateness``
    behind the newest one are dropped by the watermark."""
    return (activity.where((F.col("backend_type") == "client backend") & ~F.col("is_collector"))
            .withWatermark("snap_ts", lateness)
            .groupBy("instance", F.window("snap_ts", window).alias("w"), "state")
            .agg(F.count(F.lit(1)).alias("sess_count"))
            .select("instance", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "state", "sess_count"))


def stream_latest_progress(progress: DataFrame, keys: tuple[str, ...] = ("instance", "pid"),
                           window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """The newest progress row per (instance, pid) within each event-time
    ``window`` of ``snap_ts``. The watermark bounds the state: once a window
    is ``lateness`` behind the newest snapshot its rows are final and its
    state is dropped, so a feed running for months keeps only open windows
    (pids are reused by the server, so an unwindowed key would grow
    forever)."""
    cols = [c for c in progress.columns if c not in keys]
    newest = F.struct(F.col("snap_ts"), F.xxhash64(*cols))  # a hash of the row breaks ties of one instant
    latest = (progress.withWatermark("snap_ts", lateness)
              .groupBy(*keys, F.window("snap_ts", window).alias("w"))
              .agg(F.max_by(F.struct(*cols), newest).alias("r")))
    return latest.select(*keys, F.col("w.start").alias("window_start"), *[F.col(f"r.{c}").alias(c) for c in cols])


def stream_locker_queries(progress: DataFrame, activity: DataFrame, tolerance: str = "60 seconds", lateness: str = "10 minutes") -> DataFrame:
    """R43's locker query over two feeds: each index build that waits for a
    locker, with the sessions rows of that locker collected within
    ``tolerance`` of it. Both feeds have a watermark and the match is bounded
    in time, so state is dropped once neither side can meet a row any more; a
    build whose locker was never seen comes out then, without a query."""
    builds = (progress.where("current_locker_pid is not null").withWatermark("snap_ts", lateness)
              .select("instance", F.col("snap_ts").alias("build_ts"), F.col("pid").alias("build_pid"), "datname", "index_relid", "phase",
                      F.col("current_locker_pid").alias("locker_pid")))
    seen = (activity.withWatermark("snap_ts", lateness)
            .select(F.col("instance").alias("a_instance"), F.col("pid").alias("a_pid"), F.col("snap_ts").alias("seen_ts"), "state",
                    F.substring("query", 1, 100).alias("locker_query")))
    match = ((F.col("a_instance") == F.col("instance")) & (F.col("a_pid") == F.col("locker_pid"))
             & (F.col("seen_ts") >= F.col("build_ts") - F.expr(f"interval {tolerance}"))
             & (F.col("seen_ts") <= F.col("build_ts") + F.expr(f"interval {tolerance}")))
    return builds.join(seen, match, "leftOuter").select(
        "instance", "build_ts", "build_pid", "datname", "index_relid", "phase", "locker_pid", "seen_ts",
        F.col("state").alias("locker_state"), "locker_query")


def stream_folder(spark: SparkSession, name: str) -> str:
    """A fresh run folder for stream checkpoints and results, inside the
    shared checkpoint folder (``workspace.release_all`` removes it)."""
    return Workspace(spark, f"stream-{name}").path


def run_available(stream: DataFrame, out_path: str, checkpoint: str, mode: str = "append",
                  keys: tuple[str, ...] = ()) -> DataFrame:
    """Run a streaming aggregate over all available input and return its
    result table. Each micro-batch is written by the executors into its own
    ``epoch=N`` folder, so a repeated batch overwrites itself and no earlier
    batch is lost. Append mode: every row is final. Update mode: the newest
    epoch's row of each of ``keys``. Complete mode: the newest epoch."""
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys whose newest row counts")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")

    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
             .foreachBatch(write).trigger(availableNow=True).start())
    query.awaitTermination()
    table = stream.sparkSession.read.schema(StructType([*stream.schema.fields, StructField("epoch", IntegerType())])).parquet(out_path)
    if mode == "complete":
        newest = table.agg(F.max("epoch").alias("epoch"))
        return table.join(newest, "epoch", "left_semi").drop("epoch")
    if mode == "update":
        rows = table.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "epoch").alias("r"))
        return rows.select("r.*")
    return table.drop("epoch")
