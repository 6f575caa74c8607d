"""F. Replication: slot and sender lag, and a diagnosis of logical slots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope import SCOPE
from fleetscope.operators.scope import left_join_known, sort_if
from fleetscope.functions.exprs import elapsed_whole_s, pos_to_lsn, pretty_bytes, wait_label, xid_age

# Lags reported, as (name, later position, earlier position); ``current`` is
# the instance's current WAL position (replayed position on a replica, write
# position on a primary).
LAGS = [
    ("replay_lag", "flush_pos", "replay_pos"),
    ("flush_lag", "write_pos", "flush_pos"),
    ("write_lag", "sent_pos", "write_pos"),
    ("pending_lag", "current_pos", "sent_pos"),
    ("restart_lsn_lag", "current_pos", "restart_pos"),
    ("confirmed_flush_lsn_lag", "current_pos", "confirmed_pos"),
]


def replication_lag(slots: DataFrame, senders: DataFrame, activity: DataFrame, instances: DataFrame, ordered: bool = False) -> DataFrame:
    """Replication slots full-joined to WAL senders on the active pid,
    with the serving session, slot horizons and byte lags; largest total lag
    (current minus replayed, else current minus restart) first."""
    # a slot without an active pid matches no sender: it gets its own negative key
    spread = -1 - F.pmod(F.xxhash64("slot_name"), F.lit(1024))
    s = slots.select(*SCOPE, F.coalesce("active_pid", spread).alias("_k"), F.col("active_pid"), "slot_name", "plugin",
                     "slot_type", "database", "datoid", "active", "temporary", "xmin", "catalog_xmin",
                     F.col("next_xid").alias("slot_next_xid"), "restart_pos", "confirmed_pos")
    r = senders.select(*SCOPE, F.col("pid").alias("_k"), F.col("pid").alias("r_pid"), "client_addr",
                       F.col("usename").alias("user"), F.col("application_name").alias("r_app"),
                       F.col("state").alias("repl_state"), F.col("sync_state").alias("mode"),
                       "sent_pos", "write_pos", "flush_pos", "replay_pos")
    j = s.join(r, on=SCOPE + ["_k"], how="full").withColumn("pid", F.coalesce("r_pid", "active_pid"))
    sess = activity.select(*SCOPE, "pid", "backend_type", "backend_start", "wait_event_type", "wait_event",
                           F.col("state").alias("sess_state"))
    cur = instances.select(*SCOPE, "current_pos")
    j = left_join_known(j, sess, SCOPE, "pid").join(cur, on=SCOPE, how="left")
    lags = []
    for name, later, earlier in LAGS:
        b = (F.col(later) - F.col(earlier)).alias(f"{name}_bytes")
        lags += [b, pretty_bytes(F.col(later) - F.col(earlier)).alias(name)]
    total = F.coalesce(F.col("current_pos") - F.col("replay_pos"), F.col("current_pos") - F.col("restart_pos"))
    out = j.select(
        *SCOPE, "pid", "client_addr", "user", "backend_type", "backend_start",
        elapsed_whole_s("snap_ts", "backend_start").alias("backend_uptime_s"),
        wait_label().alias("wait_event"), F.substring("sess_state", 1, 25).alias("sess_state"),
        F.coalesce("r_app", "slot_name").alias("app_name"), "repl_state", "mode", "slot_name", "plugin",
        "slot_type", F.concat(F.col("database"), F.lit("("), F.col("datoid").cast("string"), F.lit(")"))
        .alias("database"),
        F.col("active").alias("is_active"), F.col("temporary").alias("is_temp"),
        "xmin", xid_age("slot_next_xid", "xmin").alias("xmin_age"),
        "catalog_xmin", xid_age("slot_next_xid", "catalog_xmin").alias("catalog_xmin_age"),
        pos_to_lsn("restart_pos").alias("restart_lsn"), pos_to_lsn("confirmed_pos").alias("confirmed_flush_lsn"),
        *lags, total.alias("total_lag_bytes"), pretty_bytes(total).alias("total_lag"))
    return sort_if(out, ordered, *SCOPE, F.col("total_lag_bytes").desc_nulls_last(), "slot_name", "pid")


def replication_diagnosis(slots: DataFrame, instances: DataFrame, ratio: float = 2.0,
                          min_bytes: int = 16 * 1024 * 1024) -> DataFrame:
    """The rule of thumb for logical slots as a column. Restart lag at
    least ``ratio`` times the confirmed lag (and at least ``min_bytes``):
    a long-running transaction holds the slot back. Both lags large and
    within ``ratio`` of each other: the consumer cannot keep up."""
    j = slots.join(instances.select(*SCOPE, "current_pos"), on=SCOPE, how="left")
    restart = F.col("current_pos") - F.col("restart_pos")
    confirmed = F.col("current_pos") - F.col("confirmed_pos")
    diagnosis = (F.when(restart.isNull() | confirmed.isNull(), F.lit("n/a"))
                 .when((restart >= min_bytes) & (restart >= confirmed * ratio), F.lit("long-running transaction"))
                 .when((restart >= min_bytes) & (confirmed >= min_bytes), F.lit("consumer cannot keep up"))
                 .otherwise(F.lit("ok")))
    return j.select(*SCOPE, "slot_name", "slot_type", restart.alias("restart_lag_bytes"),
                    confirmed.alias("confirmed_lag_bytes"), diagnosis.alias("diagnosis"))
