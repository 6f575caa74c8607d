"""G. Progress of maintenance commands: index builds, vacuum (with the
autovacuum queue), analyze and copy."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope import SCOPE
from fleetscope.functions.exprs import (elapsed_s, elapsed_whole_s, pretty_bytes, quote_ident, round_div,
                                        wait_label)
from fleetscope.operators.scope import attach, left_join_known, salted_lookup, sort_if

DB = [*SCOPE, "datname"]

# Phase names of each command and their "N of M" labels.
INDEX_PHASES = [
    ("initializing", "1 of 10"),
    ("waiting for writers before build", "2 of 10"),
    ("building index", "3 of 10"),
    ("waiting for writers before validation", "4 of 10"),
    ("index validation: scanning index", "5 of 10"),
    ("index validation: sorting tuples", "6 of 10"),
    ("validation: scanning table", "7 of 10"),
    ("waiting for old snapshots", "8 of 10"),
    ("waiting for readers before marking dead", "9 of 10"),
    ("waiting for readers before dropping", "10 of 10"),
]
VACUUM_PHASES = [
    ("initializing", "1 of 7"),
    ("scanning heap", "2 of 7"),
    ("vacuuming indexes", "3 of 7"),
    ("vacuuming heap", "4 of 7"),
    ("cleaning up indexes", "5 of 7"),
    ("truncating heap", "6 of 7"),
    ("performing final cleanup", "7 of 7"),
]
ANALYZE_PHASES = [
    ("initializing", "1 of 6"),
    ("acquiring sample rows", "2 of 6"),
    ("acquiring inherited sample rows", "3 of 6"),
    ("computing statistics", "4 of 6"),
    ("computing extended statistics", "5 of 6"),
    ("finalizing analyze", "6 of 6"),
]

# Server defaults used when a snapshot lacks the global
# autovacuum settings.
AUTOVACUUM_DEFAULTS = {"autovacuum_vacuum_threshold": "50", "autovacuum_vacuum_scale_factor": "0.2"}

QUEUE_STATUS = "~~~ in queue ~~~"
BLOCK_SIZE = 8192


def _phase_map(pairs) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs)])


def _sessions(activity: DataFrame, prefix: str = "a_") -> DataFrame:
    cols = ["pid", "query", "query_start", "xact_start", "backend_start", "state", "wait_event_type", "wait_event"]
    return activity.select(*SCOPE, *[F.col(c).alias(c if c == "pid" else prefix + c) for c in cols],
                           F.col("pid").alias(prefix + "pid"))


def _names(relations: DataFrame, key: str, prefix: str) -> DataFrame:
    return relations.select(*DB, F.col("oid").alias(key), F.col("relname").alias(prefix + "name"),
                            F.col("size_bytes").alias(prefix + "bytes"),
                            F.col("total_size_bytes").alias(prefix + "total_bytes"))


def _regclass(name: str, oid: str) -> Column:
    """Relation name as ``oid::regclass`` prints it (the number if unknown)."""
    return F.coalesce(F.col(name), F.col(oid).cast("string"))


def _progress_text(done: str, total: str) -> Column:
    p = round_div(F.col(done) * 100, total, 2).cast("decimal(38,2)").cast("string")
    return F.concat(F.coalesce(F.concat(p, F.lit("%")), F.lit("N/A")), F.lit(" ("),
                    F.coalesce(F.col(done).cast("string"), F.lit("?")), F.lit(" of "),
                    F.coalesce(F.col(total).cast("string"), F.lit("?")), F.lit(")"))


def _duration(prefix: str = "a_") -> Column:
    since = F.coalesce(F.col(prefix + "xact_start"), F.col(prefix + "query_start"), F.col(prefix + "backend_start"))
    return elapsed_whole_s(F.col("snap_ts"), since)


def index_build_progress(progress: DataFrame, activity: DataFrame, relations: DataFrame,
                         table_stats: DataFrame, ordered: bool = False) -> DataFrame:
    """Running index builds: duration, session and query, index and
    table names, table size, wait, phase and phase number, four progress
    texts, the current locker's query and the table's dead tuples."""
    p = attach(progress, _sessions(activity), SCOPE + ["pid"])
    p = attach(p, _names(relations, "index_relid", "idx_").drop("idx_bytes", "idx_total_bytes"),
               [*DB, "index_relid"])
    p = attach(p, _names(relations, "relid", "tbl_").drop("tbl_total_bytes"), [*DB, "relid"])
    locker = activity.select(*SCOPE, F.col("pid").alias("current_locker_pid"),
                             F.concat(F.nullif(F.substring("query", 1, 150), F.lit("")), F.lit("..."))
                             .alias("current_locker_query"))
    p = left_join_known(p, locker, SCOPE, "current_locker_pid")  # most builds wait on nobody
    dead = (table_stats.select(*DB, "relid", "n_dead_tup")
            .join(relations.select(*DB, F.col("oid").alias("relid"), "reltuples"), on=[*DB, "relid"])
            .select(*DB, "relid", F.concat(
                F.coalesce(F.concat(round_div(F.col("n_dead_tup") * 100, F.col("reltuples"), 2)
                                    .cast("decimal(38,2)").cast("string"), F.lit("%")), F.lit("N/A")),
                F.lit(" ("), F.coalesce(F.col("n_dead_tup").cast("string"), F.lit("?")), F.lit(" of "),
                F.coalesce(F.rint("reltuples").cast("bigint").cast("string"), F.lit("?")), F.lit(")"))
                .alias("table_dead_tuples")))
    p = attach(p, dead, [*DB, "relid"])
    phase_num = F.coalesce(F.element_at(_phase_map(INDEX_PHASES), F.col("phase")),
                           F.when(F.substring("phase", 1, 14) == "building index", F.lit("3 of 10"))
                           .otherwise(F.lit("")))
    rows = (p.select(
        *SCOPE, F.col("snap_ts").alias("now"), "pid", "index_relid",
        F.col("a_query_start").alias("started_at"),
        elapsed_s(F.col("snap_ts"), F.col("a_query_start")).alias("query_duration_s"),
        F.concat(F.lit("["), F.coalesce(F.col("a_pid").cast("string"), F.lit("")), F.lit("] "),
                 F.coalesce(F.col("a_query"), F.lit(""))).alias("pid_and_query"),
        _regclass("idx_name", "index_relid").alias("index_name"),
        _regclass("tbl_name", "relid").alias("table_name"),
        pretty_bytes("tbl_bytes").alias("table_size"),
        F.concat(F.nullif(F.col("a_wait_event_type"), F.lit("")), F.lit(": "), F.col("a_wait_event"))
        .alias("wait_type_and_event"),
        "phase", phase_num.alias("phase_num"),
        _progress_text("blocks_done", "blocks_total").alias("blocks_progress"),
        _progress_text("tuples_done", "tuples_total").alias("tuples_progress"),
        "current_locker_pid", "current_locker_query",
        _progress_text("lockers_done", "lockers_total").alias("lockers_progress"),
        _progress_text("partitions_done", "partitions_total").alias("partitions_progress"),
        "table_dead_tuples"))
    return sort_if(rows, ordered, *SCOPE, "index_relid", "pid")


def vacuum_progress(progress: DataFrame, activity: DataFrame, relations: DataFrame,
                    block_size: int = BLOCK_SIZE, ordered: bool = False) -> DataFrame:
    """Running vacuums: duration, wait, freeze or regular, database,
    table, phase of 7, sizes, scanned and vacuumed bytes and integer
    percents, index passes and dead-tuple memory use."""
    p = attach(progress, _sessions(activity), SCOPE + ["pid"])
    p = attach(p, _names(relations, "relid", "tbl_"), [*DB, "relid"])
    mode = F.when(F.col("a_query").rlike("to prevent wraparound"), F.lit("freeze")).otherwise(F.lit("regular"))
    rows = (p.select(
        *SCOPE, "pid", _duration().alias("duration_s"),
        wait_label("a_wait_event_type", "a_wait_event").alias("wait_event"), mode.alias("mode"),
        F.col("datname").alias("db"), _regclass("tbl_name", "relid").alias("table"), "phase",
        F.element_at(_phase_map(VACUUM_PHASES), F.col("phase")).alias("phase_num"),
        pretty_bytes("tbl_bytes").alias("table_size"), pretty_bytes("tbl_total_bytes").alias("total_table_size"),
        pretty_bytes(F.col("heap_blks_scanned") * block_size).alias("scanned"),
        pretty_bytes(F.col("heap_blks_vacuumed") * block_size).alias("vacuumed"),
        F.expr("100 * heap_blks_scanned div nullif(heap_blks_total, 0)").alias("scanned_pct"),
        F.expr("100 * heap_blks_vacuumed div nullif(heap_blks_total, 0)").alias("vacuumed_pct"),
        F.col("index_vacuum_count").alias("ind_vac_cnt"),
        round_div(F.col("num_dead_tuples") * 100, "max_dead_tuples", 1).alias("mwm_util_pct")))
    return sort_if(rows, ordered, *SCOPE, F.col("duration_s").desc_nulls_first(), "pid")


def _autovacuum_settings(relations: DataFrame, settings: DataFrame) -> DataFrame:
    """Effective per-table autovacuum threshold, scale factor and switch:
    the table's own options, else the instance setting, else the default."""
    names = list(AUTOVACUUM_DEFAULTS)
    glob = (settings.where(F.col("name").isin(names)).groupBy(*SCOPE)
            .agg(*[F.max(F.when(F.col("name") == n, F.col("setting"))).alias("g_" + n) for n in names]))
    opts = F.array_join("reloptions", "")

    def own(opt):
        return F.regexp_extract(opts, f".*{opt}=([0-9.]+)", 1)

    def effective(opt):
        return F.when(opts.like(f"%{opt}%"), own(opt)).otherwise(
            F.coalesce(F.col("g_" + opt), F.lit(AUTOVACUUM_DEFAULTS[opt])))

    return (salted_lookup(relations, glob, SCOPE, how="left")
            .select(*SCOPE, F.col("oid").alias("relid"), "datname", "relname", "nspname", "reltuples",
                    # a malformed option gives NULL (not due) instead of failing the whole job
                    effective("autovacuum_vacuum_threshold").try_cast("bigint").alias("vac_threshold"),
                    effective("autovacuum_vacuum_scale_factor").alias("vac_scale_text"),
                    F.when(opts.rlike("autovacuum_enabled=(false|off)"), F.lit(False))
                    .otherwise(F.lit(True)).alias("vac_enabled")))


def vacuum_queue(table_stats: DataFrame, relations: DataFrame, settings: DataFrame, progress: DataFrame,
                 activity: DataFrame, indexes: DataFrame, ordered: bool = False) -> DataFrame:
    """Tables due for autovacuum (threshold + scale factor x tuples
    below the dead tuples), tables being vacuumed, and vacuums running in
    other databases, with effective settings, last vacuum, status, mode,
    wait, progress and index count."""
    tables = (table_stats.select(*DB, "relid", "n_dead_tup", "last_vacuum", "last_autovacuum")
              .join(_autovacuum_settings(relations, settings), on=[*DB, "relid"], how="inner")
              .withColumn("t_relid", F.col("relid")))
    prog = progress.select(*SCOPE, "relid", "datname", F.col("relid").alias("p_relid"), "pid", "phase",
                           "heap_blks_total", "heap_blks_scanned", "heap_blks_vacuumed", "index_vacuum_count")
    j = tables.join(prog, on=[*DB, "relid"], how="full")
    sess = activity.select(*SCOPE, "pid", F.col("pid").alias("a_pid"), F.col("query").alias("a_query"),
                           "wait_event_type", "wait_event")
    j = left_join_known(j, sess, SCOPE, "pid")  # tables that are only queued have no pid
    idx = indexes.groupBy(*DB, F.col("indrelid").alias("relid")).agg(F.count(F.lit(1)).alias("_n_idx"))
    j = j.join(idx, on=[*DB, "relid"], how="left")
    due = F.col("vac_threshold") + F.col("vac_scale_text").try_cast("double") * F.col("reltuples") < F.col("n_dead_tup")
    j = j.where(F.col("t_relid").isNull() | F.col("phase").isNotNull() | due)
    own_name = F.concat(F.coalesce(F.concat(F.nullif(F.col("nspname"), F.lit("public")), F.lit(".")), F.lit("")),
                        F.col("relname"))
    relation = F.coalesce(own_name, F.concat(F.lit('[something in "'), quote_ident("datname"), F.lit('"]')))
    settings_text = F.concat(F.lit("vt: "), F.coalesce(F.col("vac_threshold").cast("string"), F.lit("")),
                             F.lit(", vsf: "), F.coalesce(F.col("vac_scale_text"), F.lit("")), F.lit(", "),
                             F.when(F.col("vac_enabled"), F.lit("enabled")).otherwise(F.lit("DISABLED")))
    fmt = "yyyy-MM-dd HH:mm:ss"
    last = (F.when(F.col("last_autovacuum").isNotNull()
                   & (F.col("last_vacuum").isNull() | (F.col("last_autovacuum") > F.col("last_vacuum"))),
                   F.concat(F.date_format("last_autovacuum", fmt), F.lit(" (auto)")))
            .when(F.col("last_vacuum").isNotNull(), F.concat(F.date_format("last_vacuum", fmt), F.lit(" (manual)"))))
    mode = (F.when(F.col("a_query").rlike("^autovacuum.*to prevent wraparound"), F.lit("wraparound"))
            .when(F.col("a_query").rlike("^vacuum"), F.lit("user"))
            .when(F.col("a_pid").isNull(), F.lit(None).cast("string"))
            .otherwise(F.lit("regular")))
    waiting = F.when(F.col("a_pid").isNotNull(),
                     F.coalesce(F.concat(F.col("wait_event_type"), F.lit("."), F.col("wait_event")), F.lit("f")))
    rows = (j.select(
        *SCOPE, relation.alias("relation"),
        round_div(F.col("n_dead_tup") * 100, "reltuples", 2).alias("dead_tup_pct"),
        "reltuples", "n_dead_tup", settings_text.alias("effective_settings"), last.alias("last_vacuumed"),
        F.coalesce(F.col("phase"), F.lit(QUEUE_STATUS)).alias("status"), "pid", mode.alias("mode"),
        waiting.alias("waiting"),
        round_div(F.col("heap_blks_scanned") * 100, "heap_blks_total", 1).alias("scanned_pct"),
        round_div(F.col("heap_blks_vacuumed") * 100, "heap_blks_total", 1).alias("vacuumed_pct"),
        "index_vacuum_count",
        F.when(F.col("t_relid").isNotNull() & F.col("p_relid").isNotNull(), F.coalesce("_n_idx", F.lit(0)))
        .alias("index_count")))
    return sort_if(rows, ordered, *SCOPE, "status", "relation", "pid")


def analyze_progress(progress: DataFrame, activity: DataFrame, relations: DataFrame, ordered: bool = False) -> DataFrame:
    """Running analyzes: duration, wait, state, database, table, phase
    of 6, sizes, current child table and three percents (0 when the total
    is 0)."""
    p = attach(progress, _sessions(activity), SCOPE + ["pid"])
    p = attach(p, _names(relations, "relid", "tbl_"), [*DB, "relid"])
    children = relations.select(*DB, F.col("oid").alias("current_child_relid"), F.col("relname").alias("child_name"))
    p = left_join_known(p, children, DB, "current_child_relid", absent=0)

    def share(done, total):
        return F.when(F.col(total) > 0, round_div(F.col(done) * 100, total, 2)).otherwise(F.lit(0.0))

    rows = (p.select(
        *SCOPE, "pid", _duration().alias("duration_s"),
        wait_label("a_wait_event_type", "a_wait_event").alias("wait_event"), F.col("a_state").alias("state"),
        F.col("datname").alias("db"), _regclass("tbl_name", "relid").alias("table"), "phase",
        F.element_at(_phase_map(ANALYZE_PHASES), F.col("phase")).alias("phase_num"),
        pretty_bytes("tbl_bytes").alias("table_size"), pretty_bytes("tbl_total_bytes").alias("total_table_size"),
        F.when(F.col("current_child_relid") > 0,
               F.concat(F.lit("child: "), _regclass("child_name", "current_child_relid")))
        .otherwise(F.lit("")).alias("current_child"),
        share("sample_blks_scanned", "sample_blks_total").alias("blocks_pct"),
        share("ext_stats_computed", "ext_stats_total").alias("extended_pct"),
        share("child_tables_done", "child_tables_total").alias("child_pct")))
    return sort_if(rows, ordered, *SCOPE, F.col("duration_s").desc_nulls_first(), "pid")


def copy_progress(progress: DataFrame, activity: DataFrame, relations: DataFrame,
                  databases: DataFrame) -> DataFrame:
    """Running COPY commands: duration, database and its size, relation
    and sizes, command, type, and bytes done as a percent, or as a size when
    the total is unknown (0)."""
    p = attach(progress, _sessions(activity), SCOPE + ["pid"])
    p = attach(p, _names(relations, "relid", "tbl_"), [*DB, "relid"])
    p = attach(p, databases.select(*SCOPE, "datname", F.col("size_bytes").alias("db_bytes")), SCOPE + ["datname"])
    pct_text = F.concat(F.abs(round_div(F.col("bytes_processed") * 100, "bytes_total", 2))
                        .cast("decimal(38,2)").cast("string"), F.lit("%"))
    return p.select(
        *SCOPE, "pid", _duration().alias("duration_s"), F.col("datname").alias("db"),
        pretty_bytes("db_bytes").alias("db_size"), _regclass("tbl_name", "relid").alias("relation"),
        pretty_bytes("tbl_bytes").alias("rel_size"), pretty_bytes("tbl_total_bytes").alias("total_rel_size"),
        "command", "type",
        F.when(F.col("bytes_total") != 0, pct_text).otherwise(pretty_bytes("bytes_processed")).alias("bytes_pct"))
