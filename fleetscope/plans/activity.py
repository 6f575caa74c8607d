"""B. Activity reports: sessions, waits, locks, temp files, statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope import SCOPE
from fleetscope.operators.scope import sort_if
from fleetscope.functions.exprs import (elapsed_s, elapsed_us, one_line, pct, pretty_bytes, round_div,
                                        wait_label)
from fleetscope.operators.scope import not_collector, top_k, with_totals, without_collector_pids

_ORDER_DURATION = {"xact_duration": "xact_s", "query_duration": "query_s"}


def _durations(df: DataFrame) -> list:
    return [
        elapsed_s("snap_ts", "xact_start").alias("xact_s"),
        elapsed_s("snap_ts", "query_start").alias("query_s"),
        elapsed_s("snap_ts", "state_change").alias("state_s"),
    ]


def query_status() -> F.Column:
    """``done, duration: N ms`` for an idle-in-transaction session (time from
    query start to the state change), else ``in progress, duration: N ms``
    (time since query start); milliseconds rounded half away from zero in
    exact integer arithmetic."""
    def ms(end: str, start: str) -> F.Column:
        return F.expr(f"(abs(unix_micros({end}) - unix_micros({start})) + 500) div 1000")

    done = F.concat(F.lit("done, duration: "), ms("query_start", "state_change").cast("string"), F.lit(" ms"))
    running = F.concat(F.lit("in progress, duration: "), ms("snap_ts", "query_start").cast("string"), F.lit(" ms"))
    return F.when(F.col("state") == "idle in transaction", done).otherwise(running)


def active_sessions(activity: DataFrame, order_by: str = "xact_duration", ordered: bool = False) -> DataFrame:
    """Non-idle sessions other than the collector's, longest first."""
    key = _ORDER_DURATION[order_by]
    rows = (not_collector(activity)
            .where(F.col("state") != "idle")
            .select(*SCOPE, "usename", "pid", "backend_type",
                    F.substring("application_name", 1, 20).alias("app"),
                    *_durations(activity),
                    wait_label().alias("wait_event"),
                    F.substring("state", 1, 25).alias("state"),
                    one_line("query", 40).alias("short_query")))
    return sort_if(rows, ordered, *SCOPE, F.col(key).desc_nulls_first(), "pid")


def long_sessions(activity: DataFrame, min_seconds: float | None = None, ordered: bool = False) -> DataFrame:
    """As R13 plus the query status; optional minimum query or
    transaction age in seconds."""
    df = not_collector(activity).where(F.col("state") != "idle")
    if min_seconds is not None:
        df = df.where((elapsed_s("snap_ts", "query_start") > min_seconds)
                      | (elapsed_s("snap_ts", "xact_start") > min_seconds))
    rows = (df.select(*SCOPE, "usename", "pid", *_durations(df),
                      query_status().alias("query_status"),
                      wait_label().alias("wait_event"),
                      F.substring("state", 1, 25).alias("state"),
                      one_line("query", 50).alias("short_query")))
    return sort_if(rows, ordered, *SCOPE, F.col("xact_s").desc_nulls_first(), "pid")


def sessions_by_state(activity: DataFrame, ordered: bool = False) -> DataFrame:
    """Client backends per state (NULL state is its own group): count,
    share of all, and average/min/max time in state in milliseconds."""
    us = elapsed_us("snap_ts", "state_change")
    g = (not_collector(activity)
         .where(F.col("backend_type") == "client backend")
         .groupBy(*SCOPE, "state")
         .agg(F.count(F.lit(1)).alias("sess_count"),
              F.sum(us).alias("_sum_us"), F.count(us).alias("_n_us"),
              F.min(us).alias("_min_us"), F.max(us).alias("_max_us")))
    g = with_totals(g, {"_total": F.sum("sess_count")})
    rows = (g.select(*SCOPE, "state", "sess_count",
                     pct("sess_count", "_total", 2).alias("pct"),
                     round_div("_sum_us", F.col("_n_us") * 1000, 2).alias("avg_state_time_ms"),
                     round_div("_min_us", F.lit(1000), 2).alias("min_state_time_ms"),
                     round_div("_max_us", F.lit(1000), 2).alias("max_state_time_ms")))
    return sort_if(rows, ordered, *SCOPE, F.col("sess_count").desc(), F.col("state").asc_nulls_first())


def wait_events(activity: DataFrame, ordered: bool = False) -> DataFrame:
    """Non-idle sessions by wait label, count and whole-number share."""
    g = (not_collector(activity)
         .where(F.col("state") != "idle")
         .groupBy(*SCOPE, wait_label().alias("wait_events"))
         .agg(F.count(F.lit(1)).alias("sess_count")))
    g = with_totals(g, {"_total": F.sum("sess_count")})
    rows = (g.select(*SCOPE, "wait_events", "sess_count", pct("sess_count", "_total", 0).alias("pct_wait_events")))
    return sort_if(rows, ordered, *SCOPE, F.col("sess_count").desc(), F.col("wait_events").asc_nulls_first())


def lock_modes(locks: DataFrame, activity: DataFrame, ordered: bool = False) -> DataFrame:
    """Heavyweight locks (no virtualxid, not the collector's) by
    ``mode:granted:fastpath``, count and whole-number share."""
    df = without_collector_pids(locks.where(F.col("locktype") != "virtualxid"), activity)
    g = (df.groupBy(*SCOPE, "mode", "granted", "fastpath")
         .agg(F.count(F.lit(1)).alias("sess_count")))
    g = with_totals(g, {"_total": F.sum("sess_count")})
    label = F.concat(F.col("mode"), F.lit(":"), F.col("granted").cast("string"), F.lit(":"),
                     F.col("fastpath").cast("string"))
    rows = (g.select(*SCOPE, label.alias("mode_granted_fastpath"), "sess_count",
                     pct("sess_count", "_total", 0).alias("pct_hw_locks")))
    return sort_if(rows, ordered, *SCOPE, F.col("sess_count").desc(), F.col("mode_granted_fastpath").asc_nulls_first())


def _db_time():
    return F.col("total_plan_time") + F.col("total_exec_time")


def top_unstable_statements(statements: DataFrame, n: int = 10, ordered: bool = False) -> DataFrame:
    """Statements whose run time is unstable (stddev/mean above 1.5) or
    degrading (max/mean above 3) with mean above 1 ms, per query id, with
    shares of the scope's db time and calls counted over rows that ran.
    The top ``n`` per scope are cut before the shares are joined and
    formatted, so that work is done for at most ``n`` rows per scope."""
    ran = (_db_time() > 0) & (F.col("calls") > 0)
    totals = (statements.groupBy(*SCOPE)
              .agg(F.coalesce(F.sum(F.when(ran, _db_time())), F.lit(0)).alias("_total_db_time"),
                   F.coalesce(F.sum(F.when(ran, F.col("calls"))), F.lit(0)).alias("_total_calls")))
    g = (statements.groupBy(*SCOPE, "queryid")
         .agg(F.sum(_db_time()).alias("_db_time"),
              F.sum("calls").alias("_calls"),
              F.avg("mean_exec_time").alias("_avg_time"),
              F.avg("stddev_exec_time").alias("_avg_stddev"),
              F.min("min_exec_time").alias("_min_time"),
              F.max("max_exec_time").alias("_max_time"))
         .withColumn("_instability", F.col("_avg_stddev") / F.nullif(F.col("_avg_time"), F.lit(0.0)))
         .withColumn("_degradation", F.col("_max_time") / F.nullif(F.col("_avg_time"), F.lit(0.0)))
         .where((F.col("_avg_time") > 1) & ((F.col("_instability") > 1.5) | (F.col("_degradation") > 3)))
         .withColumn("instability", F.round("_instability", 2))
         .withColumn("degradation", F.round("_degradation", 2)))
    order = [F.col("degradation").desc_nulls_first(), F.col("instability").desc_nulls_first(), F.col("queryid")]
    top = top_k(g, order, n).join(totals, on=SCOPE, how="inner")
    rows = top.select(
        *SCOPE, "queryid",
        F.when(F.col("_total_db_time") > 0, pct("_db_time", "_total_db_time", 2, scale=4))
        .otherwise(F.lit(0.0)).alias("t_db_time_pct"),
        round_div("_db_time", F.lit(1), 2, scale=4).alias("t_db_time_ms"),
        F.when(F.col("_total_calls") > 0, pct("_calls", "_total_calls", 2))
        .otherwise(F.lit(0.0)).alias("t_calls_pct"),
        F.col("_calls").cast("bigint").alias("t_calls"),
        F.round("_avg_time", 3).alias("avg_exec_time_ms"),
        F.round("_avg_stddev", 3).alias("avg_stddev_ms"),
        F.round("_min_time", 2).alias("min_exec_time_ms"),
        F.round("_max_time", 2).alias("max_exec_time_ms"),
        "instability", "degradation")
    return sort_if(rows, ordered, *SCOPE, *order)


_TOP_SORT = {
    "db_time": "_db_time",
    "cpu": "_cpu_time",
    "io": "_io_time",
    "calls": "_calls",
    "wal": "_wal",
}


def top_statements(statements: DataFrame, by: str = "db_time", n: int = 10, ordered: bool = False) -> DataFrame:
    """Top statements per scope by db time (or cpu, io, calls, wal):
    totals and shares of db time, cpu, io, calls and WAL, plus average mean
    and stddev of execution time. Shares are of the whole scope (totals are
    taken over all statements, before the limit); a NULL share is 0. The
    top ``n`` per scope are cut first, so shares are joined and formatted
    for at most ``n`` rows per scope."""
    cpu = _db_time() - F.col("blk_read_time") - F.col("blk_write_time")
    io = F.col("blk_read_time") + F.col("blk_write_time")
    measures = ["_db_time", "_cpu_time", "_io_time", "_calls", "_wal"]
    g = (statements.groupBy(*SCOPE, "queryid")
         .agg(F.sum(_db_time()).alias("_db_time"),
              F.sum("total_exec_time").alias("_exec_time"),
              F.sum(cpu).alias("_cpu_time"),
              F.sum(io).alias("_io_time"),
              F.sum("calls").alias("_calls"),
              F.sum("wal_bytes").alias("_wal"),
              F.avg("mean_exec_time").alias("_avg_mean"),
              F.avg("stddev_exec_time").alias("_avg_stddev")))
    totals = g.groupBy(*SCOPE).agg(*[F.sum(c).alias(f"_tot{c}") for c in measures])
    order = [F.col(_TOP_SORT[by]).desc_nulls_first(), F.col("queryid")]
    top = top_k(g, order, n).join(totals, on=SCOPE, how="inner")

    def share(c, scale=4, signed=False):
        return F.coalesce(pct(c, f"_tot{c}", 2, scale=scale, signed=signed), F.lit(0.0))

    rows = top.select(
        *SCOPE, "queryid",
        share("_db_time").alias("t_db_time_pct"),
        round_div("_exec_time", F.lit(1), 2, scale=4).alias("t_db_time_ms"),
        share("_cpu_time", signed=True).alias("t_cpu_pct"),
        round_div("_cpu_time", F.lit(1), 2, scale=4, signed=True).alias("t_cpu_time_ms"),
        share("_io_time").alias("t_io_pct"),
        round_div("_io_time", F.lit(1), 2, scale=4).alias("t_io_time_ms"),
        share("_calls", 0).alias("t_calls_pct"),
        F.col("_calls").cast("bigint").alias("t_calls"),
        share("_wal", 0).alias("t_wal_size_pct"),
        F.col("_wal").cast("bigint").alias("t_wal_bytes"),
        pretty_bytes("_wal").alias("t_wal_size"),
        F.round("_avg_mean", 3).alias("avg_exec_time_ms"),
        F.round("_avg_stddev", 3).alias("avg_stddev_exec_time_ms"),
        *[F.col(c) for c in {_TOP_SORT[by]}])
    return sort_if(rows, ordered, *SCOPE, *order).drop(_TOP_SORT[by])


# Lock target columns compared null-safely (with locktype) to find sessions
# waiting on the same object.
LOCK_TARGET = ["database", "relation", "page", "tuple", "virtualxid", "transactionid", "classid", "objid",
               "objsubid"]


def blocking_sessions(locks: DataFrame, activity: DataFrame, pids: list[int] | None = None) -> DataFrame:
    """Each ungranted lock against every other session's lock on the
    same target (locktype and nine target columns equal, NULLs equal), with
    both users and statements. The other side is not filtered on granted,
    so two waiters list each other. The target is one struct key, so this
    is a single-key equi-join; its output is, by definition, the waiter x
    other-session pairs of each target. ``pids`` keeps the waiters asked for,
    before the join; a hot target's partition is split by adaptive execution."""
    from fleetscope.operators.lock_graph import lock_target

    target = lock_target(["locktype"] + LOCK_TARGET)
    waiting = locks.where(~F.col("granted")).select(*SCOPE, target, F.col("pid").alias("w_pid"))
    if pids is not None:
        waiting = waiting.where(F.col("w_pid").isin(list(pids)))
    other = locks.select(*SCOPE, target, F.col("pid").alias("o_pid"))
    pairs = (waiting.join(other, on=SCOPE + ["obj"], how="inner")
             .where(F.col("w_pid") != F.col("o_pid"))
             .select(*SCOPE, "w_pid", "o_pid"))
    sess = activity.select(*SCOPE, "pid", "usename", one_line("query", 40).alias("stmt"))
    blocked = sess.select(*SCOPE, F.col("pid").alias("w_pid"), F.col("usename").alias("blocked_user"),
                          F.col("stmt").alias("blocked_statement"))
    blocking = sess.select(*SCOPE, F.col("pid").alias("o_pid"), F.col("usename").alias("blocking_user"),
                           F.col("stmt").alias("current_statement_in_blocking_process"))
    return (pairs.join(blocked, on=SCOPE + ["w_pid"], how="inner")
            .join(blocking, on=SCOPE + ["o_pid"], how="inner")
            .select(*SCOPE, F.col("w_pid").alias("blocked_pid"), "blocked_user",
                    F.col("o_pid").alias("blocking_pid"), "blocking_user", "blocked_statement",
                    "current_statement_in_blocking_process"))


def relation_locks(activity: DataFrame, locks: DataFrame, relations: DataFrame,
                   pids: list[int] | None = None) -> DataFrame:
    """Relation locks held or awaited by the given sessions (all when
    ``pids`` is None) on relations whose name does not start with ``pg_``,
    with the session's status, wait and statement."""
    lk = locks.where(F.col("locktype") == "relation")
    if pids is not None:
        lk = lk.where(F.col("pid").isin(list(pids)))
    rel = relations.select(*SCOPE, F.col("datoid").alias("database"), F.col("oid").alias("relation"), "relname").where(~F.col("relname").rlike("^pg_"))
    sess = activity.select(*SCOPE, "pid", "state", "query_start", "state_change", "wait_event_type", "wait_event",
                           "query")
    return (lk.join(rel, on=[*SCOPE, "database", "relation"], how="inner")
            .join(sess, on=SCOPE + ["pid"], how="inner")
            .select(*SCOPE, "pid", F.col("relname").alias("relation"), "locktype", "mode", "granted", "fastpath",
                    query_status().alias("query_status"), wait_label().alias("wait_event"),
                    F.substring("state", 1, 25).alias("state"), one_line("query", 50).alias("short_query")))


def temp_file_pid(name="name") -> F.Column:
    """Session pid from a temporary file name ``pgsql_tmp<pid>.<n>``; NULL for
    a name of another form."""
    tail = F.split_part(F.col(name), F.lit("_"), F.lit(2))
    return F.split_part(F.split_part(tail, F.lit("tmp"), F.lit(2)), F.lit("."), F.lit(1)).try_cast("bigint")


def sessions_by_temp(tempfiles: DataFrame, activity: DataFrame, ordered: bool = False) -> DataFrame:
    """Temporary file bytes and count per tablespace and session (pid
    parsed from the file name; ``pg_global`` excluded), with the session's
    status if it is still connected; largest first."""
    tmp = (tempfiles.where(F.col("tablespace") != "pg_global")
           .groupBy(*SCOPE, F.col("tablespace").alias("tblspc_name"), temp_file_pid().alias("pid"))
           .agg(F.sum("size").alias("tmp_bytes"), F.count(F.lit(1)).alias("tmp_files")))
    sess = activity.select(*SCOPE, F.col("pid").cast("bigint").alias("pid"), "state", "query_start",
                           "state_change", "wait_event_type", "wait_event", "query")
    rows = (tmp.join(sess, on=SCOPE + ["pid"], how="left")
            .select(*SCOPE, "tblspc_name", F.col("tmp_bytes").cast("bigint").alias("tmp_bytes"),
                    pretty_bytes("tmp_bytes").alias("tmp_size"), "tmp_files", "pid",
                    query_status().alias("query_status"), wait_label().alias("wait_event"),
                    F.substring("state", 1, 25).alias("state"), one_line("query", 50).alias("short_query")))
    return sort_if(rows, ordered, *SCOPE, F.col("tmp_bytes").desc_nulls_first(), "tblspc_name", "pid")
