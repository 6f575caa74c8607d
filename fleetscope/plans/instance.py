"""A. Instance reports: uptime, role, settings, databases, sizes, writer
statistics and the transaction horizon."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope import SCOPE
from fleetscope.operators.scope import sort_if
from fleetscope.functions.exprs import (elapsed_s, elapsed_us, elapsed_whole_s, pct, pretty_bytes, wait_label,
                                        xid_age)
from fleetscope.operators.scope import not_collector, with_totals
from fleetscope.plans.activity import query_status

# Recommended setting per parameter name, as the basic
# parameter check of the reference states them (name, recommendation).
SETTINGS_ADVICE = [
    ("autovacuum", "on"),
    ("autovacuum_max_workers", "3"),
    ("bgwriter_delay", "50ms / 10ms"),
    ("bgwriter_lru_maxpages", "300 / 1000"),
    ("checkpoint_completion_target", "0.9"),
    ("checkpoint_timeout", "900s"),
    ("fastpath_num_locks", "-"),
    ("log2_num_lock_partitions", "-"),
    ("max_wal_size", "-"),
    ("plan_cache_mode", "force_custom_plan"),
    ("synchronous_commit", "on"),
    ("wal_compression", "on / lz4"),
    ("wal_sync_method", "fdatasync"),
    ("shared_buffers", "25-50% RAM"),
    ("effective_cache_size", "75% RAM"),
    ("huge_pages", "on"),
    ("max_parallel_workers_per_gather", "0"),
    ("max_parallel_maintenance_workers", "-"),
    ("max_parallel_workers", "-"),
    ("max_worker_processes", "-"),
    ("track_io_timing", "on"),
    ("autovacuum_timeout_threshold_enable", "on"),
    ("max_connections", "300 (use connection pool)"),
    ("work_mem", "-"),
    ("maintenance_work_mem", "-"),
    ("effective_io_concurrency", "concurrent IO only really activated if OS supports posix_fadvise function"),
    ("wal_level", "-"),
    ("max_wal_senders", "-"),
    ("min_wal_size", "-"),
    ("wal_keep_size", "-"),
    ("jit", "off"),
]

# The check shows every name with advice but max_wal_senders.
SETTINGS_CHECKED = [name for name, _ in SETTINGS_ADVICE if name != "max_wal_senders"]

# Settings shown by the recovery-role report; the last two
# carry their unit.
ROLE_SETTINGS = ["synchronous_commit", "synchronous_standby_names", "hot_standby", "hot_standby_feedback"]
ROLE_SETTINGS_WITH_UNIT = ["recovery_min_apply_delay", "wal_keep_size"]

CHECKPOINT_CATEGORIES = ["Write-Ahead Log / Checkpoints", "Resource Usage / Background Writer"]
RECOVERY_CATEGORY = "Write-Ahead Log / Recovery"


def instance_uptime(instances: DataFrame) -> DataFrame:
    """Uptime cut to whole seconds, and the server start time."""
    return instances.select(*SCOPE, elapsed_whole_s("snap_ts", "start_time").alias("uptime_s"), "start_time")


def role_settings(instances: DataFrame, settings: DataFrame) -> DataFrame:
    """Role label from recovery state plus six settings as columns
    (two as ``setting unit``; NULL when the unit is NULL)."""
    names = ROLE_SETTINGS + ROLE_SETTINGS_WITH_UNIT
    value = F.when(F.col("name").isin(ROLE_SETTINGS_WITH_UNIT),
                   F.concat(F.col("setting"), F.lit(" "), F.col("unit"))).otherwise(F.col("setting"))
    wide = (settings.where(F.col("name").isin(names))
            .groupBy(*SCOPE)
            .agg(*[F.max(F.when(F.col("name") == n, value)).alias(n) for n in names]))
    role = F.when(F.col("in_recovery"), F.lit("Replica [read only]")).otherwise(F.lit("Master [read-write]"))
    return (instances.select(*SCOPE, role.alias("role"))
            .join(wide, on=SCOPE, how="left")
            .select(*SCOPE, "role", *names))


def _restart_flag() -> F.Column:
    return F.when(F.col("context") == "postmaster", F.lit("true")).otherwise(F.lit("false"))


def settings_non_default(settings: DataFrame, ordered: bool = False) -> DataFrame:
    """Settings whose value differs from the boot value (NULL boot
    values are dropped, as ``<>`` does)."""
    rows = (settings.where(F.col("setting") != F.col("boot_val"))
            .select(*SCOPE, "category", "name", "setting", "unit",
                    _restart_flag().alias("is_instance_restart_required"), "context"))
    return sort_if(rows, ordered, *SCOPE, "category", "name")


def settings_check(settings: DataFrame, spark: SparkSession | None = None, ordered: bool = False) -> DataFrame:
    """Current value against the recommendation for the checked
    parameters; ``-`` when there is none."""
    spark = spark or settings.sparkSession
    advice = spark.createDataFrame(SETTINGS_ADVICE, "name string, recom_value string")
    # 31 literal rows: a fixed-size dimension, safe to broadcast
    rows = (settings.where(F.col("name").isin(SETTINGS_CHECKED))
            .join(F.broadcast(advice), on="name", how="left")
            .select(*SCOPE, "name", F.col("setting").alias("curr_value"), "unit",
                    F.coalesce("recom_value", F.lit("-")).alias("recom_value")))
    return sort_if(rows, ordered, *SCOPE, "name")


def checkpoint_settings(settings: DataFrame, ordered: bool = False) -> DataFrame:
    """Checkpointer and background writer settings."""
    rows = (settings.where(F.col("category").isin(CHECKPOINT_CATEGORIES))
            .select(*SCOPE, "name", "setting", "unit", "context", "category"))
    return sort_if(rows, ordered, *SCOPE, "category", "name").drop("category")


def replication_settings(settings: DataFrame, ordered: bool = False) -> DataFrame:
    """Replication and recovery settings with the restart flag."""
    cond = F.lower("category").like("%replication%") | (F.col("category") == RECOVERY_CATEGORY)
    rows = (settings.where(cond)
            .select(*SCOPE, "category", "name", "setting", "unit",
                    _restart_flag().alias("is_instance_restart_required"), "context"))
    return sort_if(rows, ordered, *SCOPE, "category", "name")


def databases_overview(databases: DataFrame, tablespaces: DataFrame, ordered: bool = False) -> DataFrame:
    """Per database owner, encoding, collation, locale provider, size
    (or ``No Access``), tablespace and integer percent to wraparound and to
    emergency vacuum."""
    provider = (F.when(F.col("locprovider") == "c", F.lit("libc"))
                .when(F.col("locprovider") == "i", F.lit("icu")))
    ts = tablespaces.select(*SCOPE, F.col("oid").alias("tablespace_oid"), F.col("spcname").alias("tablespace"))
    rows = (databases.join(ts, on=[*SCOPE, "tablespace_oid"], how="inner")
            .select(*SCOPE, F.col("datname").alias("database"), "owner", "encoding", F.col("datcollate").alias("collate"),
                    F.col("datctype").alias("ctype"),
                    "icu_locale", provider.alias("locale_provider"),
                    F.when(F.col("can_connect"), F.col("size_bytes")).alias("size_bytes"),
                    F.when(F.col("can_connect"), pretty_bytes("size_bytes"))
                    .otherwise(F.lit("No Access")).alias("size"),
                    "tablespace",
                    F.expr("(100 * frozen_xid_age) div 2000000000").alias("pct_to_wraparound"),
                    F.expr("(100 * frozen_xid_age) div freeze_max_age").alias("pct_to_emergency_vacuum")))
    return sort_if(rows, ordered, *SCOPE, "database")


def cluster_size(databases: DataFrame, ordered: bool = False) -> DataFrame:
    """Size and share of each database plus a ``TOTAL`` row (100.0)."""
    per_db = with_totals(databases.select(*SCOPE, "datname", "size_bytes"),
                         {"_total": F.sum("size_bytes")})
    rows = per_db.select(*SCOPE, "datname", "size_bytes", pretty_bytes("size_bytes").alias("size"),
                         pct("size_bytes", "_total", 2).alias("pct"))
    total = (databases.groupBy(*SCOPE).agg(F.sum("size_bytes").alias("size_bytes"))
             .select(*SCOPE, F.lit("TOTAL").alias("datname"), "size_bytes",
                     pretty_bytes("size_bytes").alias("size"), F.lit(100.0).alias("pct")))
    return sort_if(rows.unionByName(total), ordered, *SCOPE, F.col("pct").asc_nulls_last(), "datname")


def _pct_text(num, den) -> F.Column:
    return F.concat(pct(num, den, 2).cast("decimal(38,2)").cast("string"), F.lit("%"))


def write_stats(bgwriter: DataFrame) -> DataFrame:
    """Checkpoint and buffer-write shares as ``P%`` text and written
    bytes per second since the statistics reset (NULL for zero seconds)."""
    ckpt = F.col("checkpoints_timed") + F.col("checkpoints_req")
    bufs = F.col("buffers_checkpoint") + F.col("buffers_clean") + F.col("buffers_backend")
    us = elapsed_us("snap_ts", "stats_reset")
    secs = (F.signum(us).cast("bigint") * F.expr("(abs(unix_micros(snap_ts) - unix_micros(stats_reset)) + 500000) "
                                                 "div 1000000"))
    per_s = F.when(secs != 0, F.expr("(buffers_checkpoint + buffers_clean + buffers_backend) * block_size")
                   .cast("decimal(38,0)"))
    # integer division truncates toward zero
    rate = F.when(secs != 0, (F.abs(per_s) - F.pmod(F.abs(per_s), F.abs(secs)))
                  / F.abs(secs) * F.signum(per_s) * F.signum(secs)).cast("bigint")
    return bgwriter.select(
        *SCOPE, "stats_reset",
        _pct_text("checkpoints_timed", ckpt).alias("checkpoint_timed"),
        _pct_text("checkpoints_req", ckpt).alias("checkpoint_req"),
        _pct_text("buffers_checkpoint", bufs).alias("checkpoint_written"),
        _pct_text("buffers_clean", bufs).alias("bgwriter_written"),
        _pct_text("buffers_backend", bufs).alias("backends_written"),
        _pct_text("buffers_backend_fsync", bufs).alias("backends_fsync"),
        rate.alias("bytes_per_s"),
        F.concat(pretty_bytes(rate), F.lit(" / s")).alias("size_per_s"))


def horizon_global(activity: DataFrame, slots: DataFrame, prepared: DataFrame) -> DataFrame:
    """The oldest xmin holder's age per scope over backend xmin and xid,
    slot xmin and catalog xmin, and prepared transactions; 0 if none."""
    a = activity.groupBy(*SCOPE).agg(F.max(xid_age("next_xid", "backend_xmin")).alias("a1"),
                                     F.max(xid_age("next_xid", "backend_xid")).alias("a2"))
    s = slots.groupBy(*SCOPE).agg(F.max(xid_age("next_xid", "xmin")).alias("a3"),
                                  F.max(xid_age("next_xid", "catalog_xmin")).alias("a4"))
    p = prepared.groupBy(*SCOPE).agg(F.max(xid_age("next_xid", "transaction")).alias("a5"))
    j = a.join(s, on=SCOPE, how="full").join(p, on=SCOPE, how="full")
    return j.select(*SCOPE, F.coalesce(F.greatest("a1", "a2", "a3", "a4", "a5"), F.lit(0)).alias("max_xmin_age"))


def horizon_sessions(activity: DataFrame, ordered: bool = False) -> DataFrame:
    """Sessions holding an xmin or an xid, oldest first."""
    df = not_collector(activity).where(F.col("backend_xmin").isNotNull() | F.col("backend_xid").isNotNull())
    out = df.select(
        *SCOPE, F.col("datname").alias("db"), F.col("usename").alias("user"), "pid",
        F.col("backend_xmin").alias("xmin"), xid_age("next_xid", "backend_xmin").alias("xmin_age"),
        F.col("backend_xid").alias("xid"), xid_age("next_xid", "backend_xid").alias("xid_age"),
        elapsed_s("snap_ts", "xact_start").alias("xact_s"),
        elapsed_s("snap_ts", "query_start").alias("query_s"),
        elapsed_s("snap_ts", "state_change").alias("state_s"),
        query_status().alias("query_status"), wait_label().alias("wait_event"),
        F.substring("state", 1, 25).alias("state"))
    return sort_if(out, ordered, *SCOPE, F.greatest("xmin_age", "xid_age").desc_nulls_first(), "pid")


def horizon_slots(slots: DataFrame) -> DataFrame:
    """Oldest slot xmin and catalog xmin age per scope."""
    return slots.groupBy(*SCOPE).agg(F.max(xid_age("next_xid", "xmin")).alias("xmin_age"),
                                     F.max(xid_age("next_xid", "catalog_xmin")).alias("catalog_xmin_age"))


def horizon_prepared(prepared: DataFrame, ordered: bool = False) -> DataFrame:
    """Prepared transactions with their age, oldest first."""
    rows = (prepared.select(*SCOPE, "gid", "prepared", "owner", "database",
                            F.col("transaction").alias("xmin"),
                            xid_age("next_xid", "transaction").alias("xmin_age")))
    return sort_if(rows, ordered, *SCOPE, F.col("xmin_age").desc_nulls_first(), "gid")
