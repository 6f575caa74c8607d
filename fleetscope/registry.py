"""Query registry: each report run over the snapshot fixtures of one test
scale, and the matching oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from fleetscope.operators.asof import align, pair_snapshots
from fleetscope.plans import activity as act
from fleetscope.plans import bloat
from fleetscope.plans import instance as inst
from fleetscope.plans import intervals
from fleetscope.plans import lock_trees
from fleetscope.plans import objects as obj
from fleetscope.plans import progress as prog
from fleetscope.plans import replication as repl
from fleetscope.plans import users
from fleetscope.session import configure
from fleetscope.sources.fixtures import load


def _q(fn: Callable[..., DataFrame], *tables: str, **kwargs) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return fn(*[load(spark, sf_dir, t) for t in tables], **kwargs)

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def _lock_tree_all_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R19 over sessions whose blockers come from the lock rows."""
    configure(spark)
    return lock_trees.lock_tree_all_blockers(load(spark, sf_dir, "lock_activity"), load(spark, sf_dir, "locks"))


# Rows of one file of a feed: what a task writes, and at least what it reads, whatever the feed holds.
FEED_ROWS = 100_000


def _ordered_feed(spark: SparkSession, base: str, snapshots: DataFrame, files: int = 4) -> DataFrame:
    """Like ``_feed``, but the batches are written one after the other: a file
    stream takes files by their time, so batches come in event-time order
    whatever the lateness, as from a collector. Each batch has as many files
    as the largest one needs; those a batch has no rows for are empty."""
    us = F.unix_micros("snap_ts")
    known = snapshots.select(F.percentile_approx(us, [i / files for i in range(1, files)], F.lit(1000)).alias("c")).first()["c"] or []
    edges = [None, *known, None]
    parts = [(us > F.lit(low) if low is not None else F.lit(True)) & (us <= F.lit(high) if high is not None else F.lit(True))
             for low, high in zip(edges[:-1], edges[1:], strict=True)]
    sizes = snapshots.select(*[F.count_if(p).alias(f"n{i}") for i, p in enumerate(parts)]).first()
    each = max(1, -(-max(sizes) // FEED_ROWS))
    for i, part in enumerate(parts):
        _write_batch(snapshots if len(parts) == 1 else snapshots.where(part), f"{base}/feed/part={i}", each)
    last = snapshots.limit(1).withColumn("snap_ts", F.expr("timestamp '2100-01-01 00:00:00'"))
    last.coalesce(1).write.parquet(f"{base}/feed/part={files}")
    return (spark.readStream.schema(StructType([*snapshots.schema.fields, StructField("part", IntegerType())])).option("maxFilesPerTrigger", each)
            .parquet(f"{base}/feed").drop("part"))


def _write_batch(rows: DataFrame, path: str, files: int) -> None:
    """Exactly ``files`` files, the rows dealt evenly: a batch that got fewer
    would be filled up with the next one's first files, and their times would
    make the rest of that one late."""
    if files == 1:
        rows.coalesce(1).write.parquet(path)
        return
    rows.repartition(files).write.parquet(path)
    for _ in range(files - len(rows.sparkSession.read.schema(rows.schema).parquet(path).inputFiles())):
        rows.limit(0).coalesce(1).write.mode("append").parquet(path)


def _lock_tree_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R18 over locks and sessions collected at different moments: sessions of
    the last snapshot at most 60 seconds before the locks'."""
    configure(spark)
    locks, activity = load(spark, sf_dir, "locks"), load(spark, sf_dir, "late_activity")
    return lock_trees.lock_tree(locks, align(activity, pair_snapshots(locks, activity, tolerance_s=60)))


def _feed(spark: SparkSession, base: str, snapshots: DataFrame, files: int = 2, closing: dict | None = None) -> DataFrame:
    """Snapshot rows written as files by event time and read back as a stream
    in ``files`` batches, in any order of the files. A batch has a file per
    ``FEED_ROWS`` rows, over which the rows of one moment are dealt too. A last
    row far ahead moves the watermark past every window, so all of them are
    final; ``closing`` has what it takes for the report to read that row."""
    each = max(1, -(-snapshots.count() // (files * FEED_ROWS)))
    by = ["snap_ts"] if each == 1 else ["snap_ts", F.xxhash64(*snapshots.columns)]
    ordered = snapshots.repartitionByRange(files * each, *by).sortWithinPartitions("snap_ts")
    ordered.write.parquet(f"{base}/feed/part=0")
    last = snapshots.limit(1).withColumns({"snap_ts": F.expr("timestamp '2100-01-01 00:00:00'"), **{c: F.lit(v) for c, v in (closing or {}).items()}})
    last.coalesce(1).write.parquet(f"{base}/feed/part=1")
    return (spark.readStream.schema(StructType([*snapshots.schema.fields, StructField("part", IntegerType())])).option("maxFilesPerTrigger", each)
            .parquet(f"{base}/feed").drop("part"))


def _stream_session_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 run as a stream over the activity feed until every window is final.
    The feed has every row, with the columns the report reads and the pid that
    tells rows apart: statement texts are most of a sessions table, and none is
    read. The report filters before its watermark, so the closing row must pass."""
    from fleetscope.streaming import reports as st

    configure(spark)
    base = st.stream_folder(spark, "session-mix")
    sessions = load(spark, sf_dir, "activity").select("pid", *st.SESSION_MIX_COLUMNS)
    feed = _feed(spark, base, sessions, closing={"backend_type": "client backend", "is_collector": False})
    stream = st.stream_session_mix(feed, lateness="60 days")
    return st.run_available(stream, f"{base}/out", f"{base}/chk").where("window_start < '2100-01-01'")


def _stream_latest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 over the vacuum progress feed until every window is final."""
    from fleetscope.streaming import reports as st

    configure(spark)
    base = st.stream_folder(spark, "latest-progress")
    stream = st.stream_latest_progress(_ordered_feed(spark, base, load(spark, sf_dir, "progress_vacuum"), files=2))
    return st.run_available(stream, f"{base}/out", f"{base}/chk").where("window_start < '2100-01-01'")


def _stream_locker_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: stream-stream join of index builds and sessions, until both feeds
    are through."""
    from fleetscope.streaming import reports as st

    configure(spark)
    base = st.stream_folder(spark, "locker-queries")
    builds = _ordered_feed(spark, f"{base}/builds", load(spark, sf_dir, "progress_index").where("current_locker_pid is not null"))
    sessions = _ordered_feed(spark, f"{base}/sessions", load(spark, sf_dir, "late_activity"))
    return st.run_available(st.stream_locker_queries(builds, sessions), f"{base}/out", f"{base}/chk").where("build_ts < '2100-01-01'")


def _stream_command_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate, time left and stalls of vacuums over a feed of polls."""
    from fleetscope.streaming import progress as monitor
    from fleetscope.streaming import reports as st

    configure(spark)
    base = st.stream_folder(spark, "command-monitor")
    polls = monitor.vacuum_polls(_ordered_feed(spark, base, load(spark, sf_dir, "vacuum_history")))
    return monitor.run_monitor(polls, f"{base}/out", f"{base}/chk").where("snap_ts < '2100-01-01'")


def _profile(table: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return bloat.column_profile(spark.read.parquet(f"{sf_dir}/{table}.parquet"), table)

    run.__name__ = f"column_profile_{table}"
    run.__doc__ = bloat.column_profile.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "instance_uptime": _q(inst.instance_uptime, "instances"),
        "role_settings": _q(inst.role_settings, "instances", "settings"),
        "settings_non_default": _q(inst.settings_non_default, "settings"),
        "settings_check": _q(inst.settings_check, "settings"),
        "checkpoint_settings": _q(inst.checkpoint_settings, "settings"),
        "replication_settings": _q(inst.replication_settings, "settings"),
        "databases_overview": _q(inst.databases_overview, "databases", "tablespaces"),
        "cluster_size": _q(inst.cluster_size, "databases"),
        "write_stats": _q(inst.write_stats, "bgwriter"),
        "horizon_global": _q(inst.horizon_global, "activity", "slots", "prepared"),
        "horizon_sessions": _q(inst.horizon_sessions, "activity"),
        "horizon_slots": _q(inst.horizon_slots, "slots"),
        "horizon_prepared": _q(inst.horizon_prepared, "prepared"),
        "active_sessions": _q(act.active_sessions, "activity"),
        "long_sessions": _q(act.long_sessions, "activity"),
        "sessions_by_state": _q(act.sessions_by_state, "activity"),
        "wait_events": _q(act.wait_events, "activity"),
        "lock_modes": _q(act.lock_modes, "locks", "lock_activity"),
        "top_unstable_statements": _q(act.top_unstable_statements, "statements"),
        "top_statements": _q(act.top_statements, "statements"),
        "lock_tree": _q(lock_trees.lock_tree, "locks", "lock_activity"),
        "lock_tree_all_blockers": _lock_tree_all_blockers,
        "blocking_sessions": _q(act.blocking_sessions, "locks", "lock_activity"),
        "relation_locks": _q(act.relation_locks, "lock_activity", "locks", "relations"),
        "sessions_by_temp": _q(act.sessions_by_temp, "tempfiles", "lock_activity"),
        "replication_lag": _q(repl.replication_lag, "slots", "senders", "lock_activity", "instances"),
        "replication_diagnosis": _q(repl.replication_diagnosis, "slots", "instances"),
        "index_build_progress": _q(prog.index_build_progress, "progress_index", "lock_activity", "relations",
                                   "table_stats"),
        "vacuum_progress": _q(prog.vacuum_progress, "progress_vacuum", "lock_activity", "relations"),
        "vacuum_queue": _q(prog.vacuum_queue, "table_stats", "relations", "settings", "progress_vacuum",
                           "lock_activity", "indexes"),
        "analyze_progress": _q(prog.analyze_progress, "progress_analyze", "lock_activity", "relations"),
        "copy_progress": _q(prog.copy_progress, "progress_copy", "lock_activity", "relations", "databases"),
        "stream_session_mix": _stream_session_mix,
        "stream_latest_progress": _stream_latest_progress,
        "stream_locker_queries": _stream_locker_queries,
        "stream_command_monitor": _stream_command_monitor,
        "role_list": _q(users.role_list, "roles", "auth_members"),
        "acl_grants": _q(users.acl_grants, "acls"),
        "effective_privileges": _q(users.effective_privileges, "object_acls", "role_tree", "memberships"),
        "database_access": _q(users.database_access, "databases"),
        "schema_size": _q(obj.schema_size, "relations", "databases"),
        "object_counts": _q(obj.object_counts, "relations", "tablespaces", "databases"),
        "size_rollup": _q(obj.size_rollup, "relations"),
        "stats_age": _q(obj.stats_age, "databases"),
        "unused_indexes": _q(obj.unused_indexes, "index_stats", "indexes"),
        "unused_indexes_total": _q(obj.unused_indexes_total, "index_stats", "indexes"),
        "table_page_estimate": _q(bloat.table_page_estimate, "relations", "attributes", "column_stats"),
        "table_bloat": _q(bloat.table_bloat, "relations", "attributes", "column_stats", "table_stats"),
        "table_bloat_total": _q(bloat.table_bloat_total, "relations", "attributes", "column_stats"),
        "index_page_estimate": _q(bloat.index_page_estimate, "indexes", "relations", "attributes", "column_stats"),
        "index_bloat": _q(bloat.index_bloat, "indexes", "relations", "attributes", "column_stats"),
        "index_bloat_total": _q(bloat.index_bloat_total, "indexes", "relations", "attributes", "column_stats"),
        "total_bloat": _q(bloat.total_bloat, "relations", "attributes", "column_stats", "indexes"),
        "lock_tree_asof": _lock_tree_asof,
        "growth_under_horizon": _q(intervals.growth_under_horizon, "table_history", "activity"),
        "write_intervals": _q(intervals.write_intervals, "bgwriter_history"),
        "statement_intervals": _q(intervals.statement_intervals, "statements_history"),
        "index_intervals": _q(intervals.index_intervals, "index_history", "databases_history"),
        "column_profile_orders": _profile("orders"),
        "column_profile_lineitem": _profile("lineitem"),
        "column_profile_documents": _profile("documents"),
    }


def oracle_sql() -> dict[str, str]:
    from fleetscope.oracle import activity as o_act
    from fleetscope.oracle import bloat as o_bloat
    from fleetscope.oracle import instance as o_inst
    from fleetscope.oracle import intervals as o_int
    from fleetscope.oracle import lock_trees as o_lt
    from fleetscope.oracle import objects as o_obj
    from fleetscope.oracle import progress as o_prog
    from fleetscope.oracle import streaming as o_st
    from fleetscope.oracle import replication as o_repl
    from fleetscope.oracle import users as o_users

    out: dict[str, str] = {}
    for mod in (o_inst, o_act, o_users, o_obj, o_bloat, o_repl, o_prog, o_lt, o_st, o_int):
        out.update(mod.SQL)
    return out
