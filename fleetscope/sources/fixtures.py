"""Snapshot tables derived from the driver's test tables.

Each snapshot table is specified once, as SQL expressions common to Spark and
the DuckDB oracle, so both engines see the same rows. ``load`` builds the
Spark DataFrame; ``oracle_cte`` renders the same table as a DuckDB CTE. The
derivations only shape test rows into the snapshot schemas; all report logic
lives in ``fleetscope.plans``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.sources.schemas import SNAPSHOT_COLUMNS

SNAP = "timestamp '2024-01-31 00:00:00'"


@dataclass
class Part:
    source: str  # driver table name, or one of the composite sources below
    exprs: dict[str, str]
    where: str | None = None


@dataclass
class Fixture:
    name: str
    parts: list[Part]


def _scope(key: str) -> dict[str, str]:
    """Six scopes dealt by a key column: three instances, two snapshots each."""
    return {"instance": f"'i' || cast({key} % 3 as string)",
            "snap_ts": f"{SNAP} + cast(floor({key} % 6 / 3) as int) * interval 1 day"}


def _datoid(key: str, scope_key: str | None = None, other: bool = False) -> str:
    """One of a scope's two databases that hold catalogs (oids 102 to 113,
    which lie in the scope of their own number), by a key column; ``other``:
    the one that the key is not in, where the same oids occur again."""
    which = f"cast(floor({key} / 6) as bigint) % 2"
    return f"102 + {scope_key or key} % 6 + 6 * {f'(1 - {which})' if other else f'({which})'}"


def _datname(key: str, scope_key: str | None = None, other: bool = False) -> str:
    return f"'db' || cast({_datoid(key, scope_key, other)} as string)"


# Names in the settings tables: the autovacuum ones first (few parts exist at
# the smallest scale), then all names that the settings check advises on.
SETTING_NAMES = [
    "autovacuum_vacuum_threshold", "autovacuum_vacuum_scale_factor", "autovacuum", "autovacuum_max_workers",
    "bgwriter_delay", "bgwriter_lru_maxpages", "checkpoint_completion_target", "checkpoint_timeout",
    "fastpath_num_locks", "log2_num_lock_partitions", "max_wal_size", "plan_cache_mode", "synchronous_commit",
    "wal_compression", "wal_sync_method", "shared_buffers", "effective_cache_size", "huge_pages",
    "max_parallel_workers_per_gather", "max_parallel_maintenance_workers", "max_parallel_workers",
    "max_worker_processes", "track_io_timing", "autovacuum_timeout_threshold_enable", "max_connections", "work_mem",
    "maintenance_work_mem", "effective_io_concurrency", "wal_level", "max_wal_senders", "min_wal_size",
    "wal_keep_size", "jit",
]

# A part or relation number of the order's own scope.
_ORDER_REL = "o_custkey - o_custkey % 6 + o_orderkey % 6"


def _same(exprs: dict[str, str], **changes: str) -> dict[str, str]:
    out = dict(exprs)
    out.update(changes)
    return out


_ACTIVITY_EVENTS = {
    "instance": "'i' || cast(user_id % 3 as string)",
    "snap_ts": "cast(date_trunc('DAY', ts) as timestamp) + interval 1 day",
    "datname": "'db' || cast(user_id % 5 as string)",
    "usename": "'u' || cast(user_id as string)",
    "pid": "event_id",
    "backend_type": "case when k % 10 = 0 then 'autovacuum worker' else 'client backend' end",
    "application_name": "'app ' || event_type || ' worker number ' || cast(k as string)",
    "client_addr": "cast(null as string)",
    "backend_start": "ts - interval 1 hour",
    "xact_start": "case when event_type = 'view' then null else ts end",
    "query_start": "ts + k * interval 1 second",
    "state_change": "ts + 2 * k * interval 1 second",
    "state": "case event_type when 'click' then 'active' when 'error' then 'active' "
    "when 'purchase' then 'idle in transaction' when 'view' then 'idle' end",
    "wait_event_type": "case k % 4 when 1 then 'Lock' when 2 then 'IO' when 3 then 'Client' end",
    "wait_event": "case k % 4 when 1 then 'transactionid' when 2 then 'DataFileRead' when 3 then 'ClientRead' end",
    "backend_xid": "case when event_type in ('click', 'purchase') then event_id * 3 end",
    "backend_xmin": "case when k % 2 = 0 then event_id * 2 end",
    "next_xid": "cast(10000000 as bigint)",
    "is_collector": "event_id % 997 = 0",
    "query": "text",
}

_LOCK_ACTIVITY = {
    **_scope("o_orderkey"),
    "datname": "'db' || cast(o_custkey % 5 as string)",
    "usename": "'u' || cast(o_custkey as string)",
    "pid": "o_orderkey",
    "backend_type": "case when o_custkey % 4 = 0 then 'autovacuum worker' else 'client backend' end",
    "application_name": "'app ' || o_orderpriority",
    "client_addr": "'10.0.0.' || cast(o_custkey % 250 as string)",
    "backend_start": "o_orderdate - interval 1 hour",
    "xact_start": "case when o_custkey % 11 = 0 then null else o_orderdate end",
    "query_start": "o_orderdate + (o_custkey % 3600) * interval 1 second",
    "state_change": "o_orderdate + (o_custkey % 7200) * interval 1 second",
    "state": "case o_orderstatus when 'F' then 'active' when 'O' then 'idle in transaction' else 'idle' end",
    "wait_event_type": "case o_orderpriority when '1-URGENT' then 'Lock' when '2-HIGH' then 'IO' end",
    "wait_event": "case o_orderpriority when '1-URGENT' then 'relation' when '2-HIGH' then 'DataFileRead' end",
    "backend_xid": "case when o_orderkey % 2 = 0 then o_orderkey * 3 end",
    "backend_xmin": "case when o_orderkey % 3 = 0 then o_orderkey * 2 end",
    "next_xid": "cast(10000000 as bigint)",
    "is_collector": "o_orderkey % 997 = 0",
    "query": "case o_custkey % 4 when 0 then 'autovacuum: t (to prevent wraparound)' when 1 then 'vacuum t' "
    "else 'update  t' || cast(o_custkey as string) || '  set x = 1' end",
}

_ATTRIBUTES = {
    **_scope("p_partkey"),
    "datname": _datname("p_partkey"),
    "attrelid": "p_partkey",
    "attnum": "cast(r_regionkey + 1 as int)",
    "attname": "'c' || cast(r_regionkey + 1 as string)",
    "typname": "case when (p_partkey + r_regionkey) % 23 = 0 then 'name' else 'int8' end",
    "attisdropped": "(p_partkey + r_regionkey) % 17 = 0",
}

_COLUMN_STATS = {
    **_scope("p_partkey"),
    "datname": _datname("p_partkey"),
    "relid": "p_partkey",
    "attname": "'c' || cast(r_regionkey + 1 as string)",
    "null_frac": "cast((p_partkey * r_regionkey) % 4 as double) / 4",
    "avg_width": "cast(4 + (p_partkey * (r_regionkey + 1)) % 40 as int)",
}

_PROGRESS_BASE = {
    **_scope("o_orderkey"),
    "pid": "o_orderkey + (o_orderkey % 2) * 100000000",
    "datname": _datname(_ORDER_REL),
    "relid": _ORDER_REL,
}

_NSP = (
    "case p_size % 10 when 0 then 'pg_catalog' when 1 then 'public' when 2 then 'pg_temp_1' "
    "when 3 then 'information_schema' else p_brand end"
)

_NUMBER = "cast(floor(l_orderkey / 6) as bigint)"
_IN_CYCLE = f"{_NUMBER} % 10 in (0, 9)"
_OWN = f"(l_linenumber = 1 or l_linenumber = 3 and {_IN_CYCLE} or l_linenumber <= 3 and {_NUMBER} % 4 = 0 and not {_IN_CYCLE})"

FIXTURES: dict[str, Fixture] = {
    "instances": Fixture("instances", [Part("supplier", {
        "instance": "'i' || cast(cast(floor(s_suppkey / 2) as bigint) as string)",
        "snap_ts": f"{SNAP} + (s_suppkey % 2) * interval 1 day",
        "start_time": f"{SNAP} - s_suppkey * interval 1 hour - interval 1500 millisecond",
        "in_recovery": "s_nationkey % 3 = 0",
        "current_pos": "s_suppkey * 1000003 + 190000000",
        "next_xid": "cast(10000000 as bigint)",
    })]),
    "settings": Fixture("settings", [Part("part", {
        **_scope("p_partkey"),
        # each scope lists every name once; what is left of the parts goes to further instances
        "instance": f"'i' || cast(p_partkey % 3 + 3 * cast(floor(p_partkey / {6 * len(SETTING_NAMES)}) as bigint) as string)",
        "name": f"case cast(floor(p_partkey / 6) as bigint) % {len(SETTING_NAMES)} "
        + " ".join(f"when {i} then '{n}'" for i, n in enumerate(SETTING_NAMES)) + " end",
        "setting": f"case when cast(floor(p_partkey / 6) as bigint) % {len(SETTING_NAMES)} = 1 then '0.1' else cast(p_size as string) end",
        "boot_val": "case when p_partkey % 7 = 0 then null else cast(p_size % 20 as string) end",
        "unit": "case when p_partkey % 3 = 0 then null else 'kB' end",
        "context": "case p_size % 3 when 0 then 'postmaster' when 1 then 'sighup' else 'user' end",
        "category": "case p_type when 'PROMO' then 'Replication / Sending Servers' "
        "when 'SMALL' then 'Write-Ahead Log / Recovery' when 'LARGE' then 'Write-Ahead Log / Checkpoints' "
        "when 'MEDIUM' then 'Resource Usage / Background Writer' else p_type end",
    })]),
    "databases": Fixture("databases", [Part("customer", {
        **_scope("c_custkey"),
        "oid": "c_custkey",
        "datname": "'db' || cast(c_custkey as string)",
        "owner": "c_mktsegment",
        "locprovider": "case c_custkey % 3 when 0 then 'c' when 1 then 'i' else 'b' end",
        "can_connect": "c_custkey % 6 <> 0",
        "size_bytes": "cast(abs(cast(c_acctbal as decimal(18,2))) * 1000000 as bigint)",
        "tablespace_oid": "c_custkey % 3",
        "frozen_xid_age": "c_custkey * 1234567 % 2000000000",
        "freeze_max_age": "cast(200000000 as bigint)",
        "acl": "case when c_custkey % 4 = 0 then null else array('=Tc/' || c_mktsegment, 'app=CTc/' || c_mktsegment, "
        "'\"odd, name\"=c/' || c_mktsegment) end",
        "stats_reset": f"case when c_custkey % 5 = 0 then null else {SNAP} - c_custkey * interval 1 minute end",
        "start_time": f"{SNAP} - interval 30 day",
        "encoding": "'UTF8'",
        "datcollate": "'C'",
        "datctype": "'C'",
        "icu_locale": "case when c_custkey % 3 = 1 then 'en' end",
    })]),
    "tablespaces": Fixture("tablespaces", [Part("region*scope", {
        **_scope("scope_no"),
        "oid": "cast(r_regionkey as bigint)",
        "spcname": "case r_regionkey when 0 then 'pg_default' when 1 then 'pg_global' "
        "else r_name || '_' || cast(scope_no as string) end",
    })]),
    "bgwriter": Fixture("bgwriter", [Part("supplier", {
        "instance": "'i' || cast(cast(floor(s_suppkey / 2) as bigint) as string)",
        "snap_ts": f"{SNAP} + (s_suppkey % 2) * interval 1 day",
        "stats_reset": f"{SNAP} - (s_suppkey % 50) * interval 1 hour",
        "checkpoints_timed": "s_suppkey % 10",
        "checkpoints_req": "s_suppkey % 5",
        "buffers_checkpoint": "s_suppkey * 997",
        "buffers_clean": "s_suppkey * 101",
        "buffers_backend": "s_suppkey * 53",
        "buffers_backend_fsync": "s_suppkey % 7",
        "block_size": "cast(8192 as int)",
    })]),
    "activity": Fixture("activity", [Part("events*documents", _ACTIVITY_EVENTS)]),
    "lock_activity": Fixture("lock_activity", [Part("orders", _LOCK_ACTIVITY)]),
    # Line 1: a session's own transaction. Lines 2 and 3: waits on two other sessions' transactions, both earlier
    # ones of its scope (chains, two-root waiters). Sessions whose number in the scope 4 divides wait on nobody;
    # those with numbers ending in 9 and 0 wait on each other and on nobody else (cycles). Other lines: relation locks.
    "locks": Fixture("locks", [Part("lineitem", {
        **_scope("l_orderkey"),
        "pid": "l_orderkey",
        "locktype": "case when l_linenumber <= 3 then 'transactionid' else 'relation' end",
        "database": f"case when l_linenumber > 3 then {_datoid('l_partkey', 'l_orderkey')} end",
        "relation": "case when l_linenumber > 3 then l_partkey - l_partkey % 6 + l_orderkey % 6 end",
        "page": "cast(null as bigint)",
        "tuple": "cast(null as bigint)",
        "virtualxid": "cast(null as string)",
        "transactionid": f"case when {_OWN} then l_orderkey "
        f"when l_linenumber = 2 and {_NUMBER} % 10 = 9 then l_orderkey + 6 "
        f"when l_linenumber = 2 and {_NUMBER} % 10 = 0 then l_orderkey - 6 "
        "when l_linenumber = 2 then l_orderkey - 6 * (l_suppkey % 3 + 1) "
        "when l_linenumber = 3 then l_orderkey - 6 * (l_suppkey % 7 + 2) end",
        "classid": "cast(null as bigint)",
        "objid": "cast(null as bigint)",
        "objsubid": "cast(null as bigint)",
        "mode": "case when l_linenumber = 1 then 'ExclusiveLock' when l_linenumber <= 3 then 'ShareLock' "
        "else case l_linenumber % 4 when 0 then 'AccessShareLock' when 1 then 'RowExclusiveLock' "
        "when 2 then 'ShareLock' else 'AccessExclusiveLock' end end",
        "granted": f"{_OWN} or l_linenumber in (4, 5, 7) or l_linenumber = 6 and (l_orderkey % 5 <> 0 or {_IN_CYCLE})",
        "fastpath": "l_linestatus = 'F'",
    })]),
    "prepared": Fixture("prepared", [Part("orders", {
        **_scope("o_orderkey"),
        "gid": "'gid_' || cast(o_orderkey as string)",
        "prepared": "o_orderdate",
        "owner": "'u' || cast(o_custkey as string)",
        "database": "'db' || cast(o_custkey % 5 as string)",
        "transaction": "o_orderkey * 5",
        "next_xid": "cast(10000000 as bigint)",
    })]),
    "tempfiles": Fixture("tempfiles", [Part("orders", {
        **_scope("o_orderkey"),
        "tablespace": "case when o_orderpriority = '5-LOW' then 'pg_global' else o_orderpriority end",
        "name": "'pgsql_tmp' || cast(o_custkey * 11 as string) || '.' || cast(o_orderkey as string)",
        "size": "cast(cast(o_totalprice as decimal(18,2)) * 100 as bigint)",
    })]),
    "statements": Fixture("statements", [Part("lineitem", {
        "instance": "'i' || cast(l_suppkey % 3 as string)",
        "snap_ts": SNAP,
        "queryid": "l_partkey",
        "userid": "l_suppkey",
        "calls": "cast(l_quantity as bigint)",
        "total_plan_time": "cast(cast(l_extendedprice as decimal(12,2)) * cast(l_tax as decimal(4,2)) as decimal(18,4))",
        "total_exec_time": "cast(l_extendedprice as decimal(18,4))",
        "blk_read_time": "cast(cast(l_extendedprice as decimal(12,2)) * cast(l_discount as decimal(4,2)) as decimal(18,4))",
        "blk_write_time": "cast(l_linenumber as decimal(18,4))",
        "wal_bytes": "l_orderkey * 100",
        "mean_exec_time": "round(l_extendedprice / l_quantity, 0)",
        "stddev_exec_time": "round(l_extendedprice / l_quantity, 0) * l_linenumber / 2",
        "min_exec_time": "round(l_extendedprice / l_quantity, 0) / 4",
        "max_exec_time": "round(l_extendedprice / l_quantity, 0) * l_linenumber",
    })]),
    "roles": Fixture("roles", [Part("customer", {
        **_scope("c_custkey"),
        "oid": "c_custkey",
        "rolname": "c_name",
        "rolcanlogin": "c_custkey % 2 = 0",
        "rolinherit": "c_custkey % 3 <> 0",
        "rolsuper": "c_custkey % 50 = 0",
        "rolcreaterole": "c_custkey % 7 = 0",
        "rolcreatedb": "c_custkey % 5 = 0",
        "rolreplication": "c_custkey % 11 = 0",
        "rolbypassrls": "c_custkey % 13 = 0",
        "rolconnlimit": "case when c_nationkey % 3 = 0 then cast(null as int) else c_nationkey - 1 end",
        "rolvaliduntil": f"case when c_custkey % 9 = 0 then {SNAP} end",
        "rolconfig": "case when c_custkey % 4 = 0 then array('search_path=app, public', 'work_mem=64MB') end",
    })]),
    "auth_members": Fixture("auth_members", [Part("orders", {
        **_scope("o_custkey"),
        "member": "o_custkey",
        "roleid": "o_custkey + 6 * (o_orderkey % 7 + 1)",
    })]),
    "acls": Fixture("acls", [Part("customer", {
        **_scope("c_custkey"),
        "object_name": "'sch' || cast(c_custkey as string)",
        "owner": "c_mktsegment",
        "acl": "case c_custkey % 3 when 0 then null when 1 then array(c_mktsegment || '=UC/' || c_mktsegment, "
        "'=U/' || c_mktsegment) else array('app=U*C/' || c_mktsegment) end",
    })]),
    "relations": Fixture("relations", [Part("part", {
        **_scope("p_partkey"),
        "datname": _datname("p_partkey"),
        "datoid": _datoid("p_partkey"),
        "oid": "p_partkey",
        "relname": "case when p_partkey % 20 = 0 then 'pg_' else 't_' end || cast(p_partkey as string)",
        "nspname": _NSP,
        "relowner": "'u' || cast(p_size as string)",
        "tablespace_oid": "p_partkey % 4",
        "relkind": "case p_partkey % 13 when 0 then 'i' when 1 then 'S' when 2 then 'v' when 3 then 'm' "
        "when 4 then 'c' when 5 then 't' when 6 then 'f' when 7 then 'p' when 8 then 'x' else 'r' end",
        "reltuples": "cast(p_partkey * 37 as double)",
        "relpages": "p_partkey * 2 + p_size",
        "toast_pages": "case when p_size % 4 = 0 then cast(p_size as bigint) end",
        "toast_tuples": "case when p_size % 4 = 0 then cast(p_size * 3 as double) end",
        "reloptions": "case p_size % 3 when 0 then null when 1 then array('fillfactor=70', 'autovacuum_vacuum_threshold=500') "
        "else array('autovacuum_vacuum_scale_factor=0.05', 'autovacuum_enabled=false') end",
        "size_bytes": "(p_partkey * 2 + p_size) * 8192",
        "total_size_bytes": "(p_partkey * 3 + p_size) * 8192",
    })]),
    "table_stats": Fixture("table_stats", [Part("part", {
        **_scope("p_partkey"),
        "datname": _datname("p_partkey"),
        "relid": "p_partkey",
        "n_dead_tup": "p_partkey * (p_size % 20)",
        "last_vacuum": f"case when p_size % 2 = 0 then {SNAP} - p_size * interval 1 hour end",
        "last_autovacuum": f"case when p_size % 3 = 0 then {SNAP} - p_partkey * interval 1 minute end",
        "last_analyze": f"case when p_size % 5 = 0 then {SNAP} - interval 1 day end",
        "last_autoanalyze": "cast(null as timestamp)",
    })]),
    "attributes": Fixture("attributes", [
        Part("part*region", _ATTRIBUTES),
        Part("part*region", _same(_ATTRIBUTES, attrelid="100000000 + p_partkey")),
    ]),
    "column_stats": Fixture("column_stats", [
        Part("part*region", _COLUMN_STATS, where="(p_partkey + r_regionkey) % 19 <> 0"),
        Part("part*region", _same(_COLUMN_STATS, relid="100000000 + p_partkey"),
             where="(p_partkey + r_regionkey) % 19 <> 0"),
    ]),
    "indexes": Fixture("indexes", [Part("part", {
        **_scope("p_partkey"),
        "datname": _datname("p_partkey"),
        "indexrelid": "100000000 + p_partkey",
        "idxname": "'ix_' || cast(p_partkey as string)",
        "indrelid": "p_partkey",
        "amname": "case when p_size % 9 = 0 then 'gin' else 'btree' end",
        "indisunique": "p_partkey % 3 = 0",
        "indkey": "case p_partkey % 3 when 0 then '1' when 1 then '1 2' else '0 3' end",
        "reltuples": "cast(p_partkey * 37 as double)",
        "relpages": "p_partkey + p_size",
        "reloptions": "case when p_size % 5 = 0 then array('fillfactor=70') end",
        "size_bytes": "(p_partkey + p_size) * 8192",
    })]),
    "index_stats": Fixture("index_stats", [Part("part", {
        **_scope("p_partkey"),
        "datname": _datname("p_partkey"),
        "indexrelid": "100000000 + p_partkey",
        "schemaname": _NSP,
        "relname": "'t_' || cast(p_partkey as string)",
        "idx_scan": "cast(p_size % 4 as bigint)",
    })]),
    "slots": Fixture("slots", [Part("supplier", {
        **_scope("s_suppkey"),
        "slot_name": "s_name",
        "plugin": "case when s_suppkey % 2 = 0 then 'pgoutput' end",
        "slot_type": "case when s_suppkey % 2 = 0 then 'logical' else 'physical' end",
        "active_pid": "case when s_suppkey % 3 = 0 then null else s_suppkey end",
        "xmin": "case when s_suppkey % 4 = 0 then s_suppkey * 7 end",
        "catalog_xmin": "case when s_suppkey % 2 = 0 then s_suppkey * 9 end",
        "restart_pos": "case s_suppkey % 8 when 0 then 80000000 when 2 then 185000000 + s_suppkey * 1000003 else s_suppkey * 500000 end",
        "confirmed_pos": "case s_suppkey % 8 when 0 then 170000000 + s_suppkey * 1000003 when 2 then 186000000 + s_suppkey * 1000003 "
        "when 4 then s_suppkey * 500000 + s_suppkey * s_suppkey * 1000 end",
        "next_xid": "cast(10000000 as bigint)",
        "database": "case when s_suppkey % 2 = 0 then 'db0' end",
        "datoid": "case when s_suppkey % 2 = 0 then s_suppkey end",
        "active": "s_suppkey % 3 <> 0",
        "temporary": "s_suppkey % 10 = 0",
    })]),
    "senders": Fixture("senders", [Part("supplier", {
        **_scope("s_suppkey"),
        "pid": "s_suppkey + 6",
        "application_name": "'standby_' || cast(s_suppkey as string)",
        "state": "'streaming'",
        "sync_state": "case when s_suppkey % 2 = 0 then 'sync' else 'async' end",
        "sent_pos": "80000000 + s_suppkey * 999",
        "write_pos": "80000000 + s_suppkey * 777",
        "flush_pos": "80000000 + s_suppkey * 555",
        "replay_pos": "80000000 + s_suppkey * 111",
        "client_addr": "'10.1.0.' || cast(s_suppkey % 250 as string)",
        "usename": "'repl'",
    })]),
    "progress_index": Fixture("progress_index", [Part("orders", _same(_PROGRESS_BASE, **{
        "phase": "case o_custkey % 5 when 0 then 'initializing' when 1 then 'building index' "
        "when 2 then 'building index: scanning table' when 3 then 'waiting for old snapshots' "
        "when 4 then 'other' end",
        "blocks_done": "o_custkey",
        "blocks_total": "case when o_custkey % 5 = 0 then 0 else o_custkey * 3 end",
        "tuples_done": "o_custkey * 2",
        "tuples_total": "case when o_custkey % 7 = 0 then 0 else o_custkey * 5 end",
        "lockers_done": "case when o_custkey % 6 = 0 then null else o_custkey % 4 end",
        "lockers_total": "case when o_custkey % 9 = 0 then null else cast(4 as bigint) end",
        "partitions_done": "o_custkey % 3",
        "partitions_total": "case when o_custkey % 2 = 0 then 0 else o_custkey % 10 + 3 end",
        "current_locker_pid": "case when o_custkey % 2 = 0 then o_orderkey + 6 end",
        "index_relid": f"100000000 + {_ORDER_REL}",
    }))]),
    "progress_vacuum": Fixture("progress_vacuum", [Part("orders", _same(_PROGRESS_BASE, **{
        "phase": "case o_custkey % 4 when 0 then 'initializing' when 1 then 'scanning heap' "
        "when 2 then 'vacuuming indexes' when 3 then 'vacuuming heap' end",
        "datname": f"case when o_custkey % 4 = 0 then 'db_other' else {_datname(_ORDER_REL)} end",
        "heap_blks_total": "o_custkey % 100",
        "heap_blks_scanned": "o_custkey % 70",
        "heap_blks_vacuumed": "o_custkey % 30",
        "index_vacuum_count": "o_custkey % 3",
        "num_dead_tuples": "o_custkey",
        "max_dead_tuples": "cast(case when o_custkey % 6 = 0 then 0 else 5000 end as bigint)",
    }))]),
    "progress_analyze": Fixture("progress_analyze", [Part("orders", _same(_PROGRESS_BASE, **{
        "phase": "case o_custkey % 4 when 0 then 'initializing' when 1 then 'acquiring sample rows' "
        "when 2 then 'computing statistics' when 3 then 'finalizing analyze' end",
        "current_child_relid": f"case when o_custkey % 3 = 0 then {_ORDER_REL} + 12 else 0 end",
        "sample_blks_total": "o_custkey % 50",
        "sample_blks_scanned": "o_custkey % 20",
        "ext_stats_total": "o_custkey % 6",
        "ext_stats_computed": "o_custkey % 4",
        "child_tables_total": "o_custkey % 5",
        "child_tables_done": "o_custkey % 3",
        "datname": f"case when o_custkey % 5 = 0 then 'db0' else {_datname(_ORDER_REL)} end",
    }))]),
    "progress_copy": Fixture("progress_copy", [Part("orders", _same(_PROGRESS_BASE, **{
        "phase": "case o_custkey % 1 when 0 then 'copy' end",
        "datname": f"case when o_custkey % 5 = 0 then 'db0' else {_datname(_ORDER_REL)} end",
        "command": "case when o_custkey % 2 = 0 then 'COPY FROM' else 'COPY TO' end",
        "type": "case o_custkey % 3 when 0 then 'FILE' when 1 then 'PIPE' else 'CALLBACK' end",
        "bytes_total": "case when o_custkey % 4 = 0 then 0 else o_custkey * 1000 end",
        "bytes_processed": "o_custkey * 333",
    }))]),
}


# --- Histories: several snapshots of one entity -------------------------------

def _hours(n: str) -> str:
    return f"{SNAP} + cast({n} as int) * interval 1 hour"


def _counted(seq: str, restarts: str, at: str) -> str:
    """How many steps a counter has behind it: it restarts at step ``at``."""
    return f"({seq} - case when {restarts} and {seq} >= {at} then {at} - 1 else 0 end)"


# Ten snapshots of a server; every fourth server's statistics are reset, every fifth one's counters fall without that.
_SERVER, _STEP = "cast(floor(c_custkey / 10) as bigint)", "c_custkey % 10"
_TURNS = _counted(_STEP, f"({_SERVER} % 4 = 0 or {_SERVER} % 5 = 1)", "5")
# Eight snapshots of a statement; every seventh restarts, every eleventh misses its third one.
_ENTRY, _EIGHTH = "cast(floor(o_orderkey / 8) as bigint)", "o_orderkey % 8"
_RUN = _counted(_EIGHTH, f"{_ENTRY} % 7 = 0", "4")
# Six snapshots of an index; every fifth stands still, every seventh restarts with its database.
_INDEX, _SIXTH = "cast(floor(p_partkey / 6) as bigint)", "p_partkey % 6"

FIXTURES |= {
    "bgwriter_history": Fixture("bgwriter_history", [Part("customer", {
        "instance": f"'i' || cast({_SERVER} as string)",
        "snap_ts": _hours(_STEP),
        "stats_reset": f"case when {_SERVER} % 4 = 0 and {_STEP} >= 5 then {SNAP} + interval 270 minute when {_SERVER} % 3 = 0 then null "
        f"else {SNAP} - interval 10 day end",
        "checkpoints_timed": f"{_TURNS} * ({_SERVER} % 4) + 2",
        "checkpoints_req": f"{_TURNS} * ({_SERVER} % 3) + 1",
        "buffers_checkpoint": f"{_TURNS} * (997 + {_SERVER})",
        "buffers_clean": f"{_TURNS} * 101",
        "buffers_backend": f"case when {_SERVER} % 9 = 0 then 0 else {_TURNS} * {_TURNS} * 53 end",
        "buffers_backend_fsync": f"case when {_SERVER} % 8 = 0 then null else {_TURNS} end",
        "block_size": "cast(8192 as int)",
    })]),
    "statements_history": Fixture("statements_history", [Part("orders", {
        "instance": f"'i' || cast({_ENTRY} % 3 as string)",
        "snap_ts": _hours(f"{_EIGHTH} + {_ENTRY} % 2"),
        "queryid": f"cast(floor({_ENTRY} / 12) as bigint)",
        "userid": _ENTRY,
        "calls": f"{_RUN} * ({_ENTRY} % 50)",
        "total_plan_time": f"cast({_RUN} * ({_ENTRY} % 13) as decimal(18,4))",
        "total_exec_time": f"cast(cast({_RUN} * ({_ENTRY} % 997 + 1) as decimal(12,0)) * cast(1.25 as decimal(4,2)) as decimal(18,4))",
        "blk_read_time": f"cast({_RUN} * ({_ENTRY} % 5) as decimal(18,4))",
        "blk_write_time": f"cast({_RUN} as decimal(18,4))",
        "wal_bytes": f"{_RUN} * ({_ENTRY} % 100) * 8192",
        "mean_exec_time": f"cast({_ENTRY} % 997 + 1 as double)",
        "stddev_exec_time": f"cast({_EIGHTH} as double)",
        "min_exec_time": "cast(1 as double)",
        "max_exec_time": f"cast({_ENTRY} % 997 + 2 as double)",
    }, where=f"not ({_ENTRY} % 11 = 0 and {_EIGHTH} = 3)")]),
    "index_history": Fixture("index_history", [Part("part", {
        "instance": f"'i' || cast({_INDEX} % 3 as string)",
        "snap_ts": _hours(_SIXTH),
        "datname": f"'db' || cast({_INDEX} % 4 as string)",
        "indexrelid": f"100000000 + {_INDEX}",
        "schemaname": "'public'",
        "relname": f"'t_' || cast(cast(floor({_INDEX} / 24) as bigint) as string)",
        "idx_scan": f"case when {_INDEX} % 5 = 0 then 7 else {_counted(_SIXTH, f'{_INDEX} % 4 = 2', '3')} * ({_INDEX} % 9) end",
    })]),
    "databases_history": Fixture("databases_history", [Part("customer", _same(
        FIXTURES["databases"].parts[0].exprs,
        instance="'i' || cast(cast(floor(c_custkey / 6) as bigint) % 3 as string)",
        snap_ts=_hours("c_custkey % 6"),
        datname="'db' || cast(cast(floor(c_custkey / 18) as bigint) as string)",
        stats_reset=f"case when cast(floor(c_custkey / 18) as bigint) % 4 = 2 and c_custkey % 6 >= 3 then {SNAP} + interval 150 minute end",
    ))]),
}

# Sessions collected before the locks: 7 and 20 seconds, and on one server 95.
_LATE = "case o_orderkey % 3 when 0 then 7 when 1 then 95 else 20 end"
# Dead tuples of a table at six moments three hours apart; every fifth table is vacuumed in between.
FIXTURES |= {
    "late_activity": Fixture("late_activity", [Part("orders", _same(
        _LOCK_ACTIVITY, snap_ts=f"{_LOCK_ACTIVITY['snap_ts']} - {_LATE} * interval 1 second"))]),
    "table_history": Fixture("table_history", [Part("part", _same(
        FIXTURES["table_stats"].parts[0].exprs,
        instance=f"'i' || cast({_INDEX} % 3 as string)",
        snap_ts=f"timestamp '2024-01-02 00:00:00' + cast({_INDEX} % 24 * 24 + ({_SIXTH}) * 3 as int) * interval 1 hour",
        datname=f"'db' || cast({_INDEX} % 5 as string)",
        relid=_INDEX,
        n_dead_tup=f"{_counted(_SIXTH, f'{_INDEX} % 5 = 0', '3')} * ({_INDEX} % 7) * 100",
    ))]),
}

# Ten polls of a vacuum, a minute apart; every fifth pauses for 20 minutes before its seventh poll, every third goes on
# with another table from its sixth, every seventh stands still.
FIXTURES |= {
    "vacuum_history": Fixture("vacuum_history", [Part("customer", {
        "instance": f"'i' || cast({_SERVER} % 3 as string)",
        "snap_ts": f"{SNAP} + cast({_SERVER} % 48 * 60 + {_STEP} + case when {_SERVER} % 5 = 0 and {_STEP} >= 6 then 20 else 0 end as int) "
        "* interval 1 minute",
        "pid": _SERVER,
        "datname": "'db0'",
        "relid": f"{_SERVER} % 50 + case when {_SERVER} % 3 = 0 and {_STEP} >= 5 then 100 else 0 end",
        "phase": f"case when {_STEP} % 5 <= 2 then 'scanning heap' else 'vacuuming heap' end",
        "heap_blks_total": f"case when {_SERVER} % 11 = 0 then null else 1000 + {_SERVER} end",
        "heap_blks_scanned": f"case when {_SERVER} % 7 = 0 then 5 else ({_STEP}) % 5 * (300 + {_SERVER} % 17) end",
        "heap_blks_vacuumed": f"case when {_SERVER} % 7 = 0 then 5 else ({_STEP}) % 5 * 200 end",
        "index_vacuum_count": "cast(0 as bigint)",
        "num_dead_tuples": "c_custkey",
        "max_dead_tuples": "cast(5000 as bigint)",
    })]),
}

# Roles in groups of twelve within a scope. Each is a member of one other role of its group (cycles), every third of a
# second one; every seventh doesn't inherit.
_ROLE = "cast(floor(c_custkey / 6) as bigint)"
_PLACE = f"({_ROLE} % 12)"
FIXTURES |= {
    "role_tree": Fixture("role_tree", [Part("customer", _same(
        FIXTURES["roles"].parts[0].exprs, rolname="'role' || cast(c_custkey as string)", rolinherit=f"{_ROLE} % 7 <> 3"))]),
    "memberships": Fixture("memberships", [
        Part("customer", {**_scope("c_custkey"), "member": "c_custkey",
                          "roleid": f"c_custkey - 6 * {_PLACE} + 6 * (({_PLACE} * 7 + 3) % 12)"}),
        Part("customer", {**_scope("c_custkey"), "member": "c_custkey",
                          "roleid": f"c_custkey - 6 * {_PLACE} + 6 * cast(floor({_PLACE} / 2) as bigint)"}, where=f"{_PLACE} % 3 = 0"),
    ]),
    "object_acls": Fixture("object_acls", [Part("customer", {
        **_scope("c_custkey"),
        "object_name": f"'obj' || cast(cast(floor({_ROLE} / 2) as bigint) as string)",
        "owner": "c_mktsegment",
        "acl": f"case {_ROLE} % 4 when 0 then null when 1 then array('role' || cast(c_custkey as string) || '=r*w/own', '=r/own') "
        "when 2 then array('role' || cast(c_custkey as string) || '=rd/own') else array('gone=r/own', 'role' || cast(c_custkey - 6 as string) || '=w*/own') end",
    })]),
}

# The same oids in the scope's other database, with other sizes.
_OTHER_DB = {
    "relations": {"datoid": _datoid("p_partkey", other=True), "reltuples": "cast(p_partkey * 11 as double)",
                  "relpages": "p_partkey + p_size", "size_bytes": "(p_partkey + p_size) * 8192"},
    "table_stats": {"n_dead_tup": "p_partkey * (p_size % 7)"},
    "indexes": {"reltuples": "cast(p_partkey * 19 as double)", "relpages": "p_partkey * 2 + p_size"},
    "index_stats": {"idx_scan": "cast(p_size % 3 as bigint)"},
    "attributes": {},
    "column_stats": {"avg_width": "cast(8 + (p_partkey * (r_regionkey + 2)) % 50 as int)"},
}
for _name, _changes in _OTHER_DB.items():
    FIXTURES[_name].parts += [
        Part(p.source, _same(p.exprs, datname=_datname("p_partkey", other=True), **_changes), p.where) for p in list(FIXTURES[_name].parts)]


# --- Spark side -------------------------------------------------------------

def _driver(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _source(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    if source == "events*documents":
        events = _driver(spark, sf_dir, "events").selectExpr(
            "*", "cast(regexp_extract(props, '[0-9]+', 0) as int) as k")
        docs = _driver(spark, sf_dir, "documents")
        return events.join(docs, F.col("doc_id") == F.col("event_id") % docs.count())
    if source == "part*region":  # five columns of every part
        return _driver(spark, sf_dir, "part").withColumn("r_regionkey", F.explode(F.sequence(F.lit(0), F.lit(4))))
    if source == "region*scope":
        return _driver(spark, sf_dir, "region").withColumn("scope_no", F.explode(F.sequence(F.lit(0), F.lit(5))))
    return _driver(spark, sf_dir, source)


def _projection(name: str, exprs: dict[str, str]) -> list[str]:
    cols = SNAPSHOT_COLUMNS[name]
    missing = [c for c, _ in cols if c not in exprs]
    if missing:
        raise KeyError(f"fixture {name} lacks {missing}")
    return [f"cast(({exprs[c]}) as {t}) as {c}" for c, t in cols]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build snapshot table ``name`` from the driver tables in ``sf_dir``."""
    fx = FIXTURES[name]
    out = None
    for part in fx.parts:
        df = _source(spark, sf_dir, part.source)
        if part.where:
            df = df.where(part.where)
        df = df.selectExpr(*_projection(name, part.exprs))
        out = df if out is None else out.unionByName(df)
    return out


# --- Oracle side ------------------------------------------------------------

def _oracle_source(source: str) -> str:
    if source == "events*documents":
        return ("(select *, cast(regexp_extract(props, '[0-9]+', 0) as int) as k from events) e "
                "join documents d on d.doc_id = e.event_id % (select count(*) from documents)")
    if source == "part*region":
        return "(select *, unnest(range(5)) as r_regionkey from part) p"
    if source == "region*scope":
        return "(select *, unnest(range(6)) as scope_no from region) r"
    return source


def oracle_cte(name: str) -> str:
    """The snapshot table ``name`` as a DuckDB CTE body over the driver views."""
    fx = FIXTURES[name]
    selects = []
    for part in fx.parts:
        cols = [c.replace("as array<string>)", "as varchar[])").replace("array(", "list_value(") for c in _projection(name, part.exprs)]
        where = f" where {part.where}" if part.where else ""
        selects.append(f"select {', '.join(cols)} from {_oracle_source(part.source)}{where}")
    body = " union all ".join(selects)
    return f"{name} as ({body})"


def oracle_with(*names: str) -> str:
    return "with " + ",\n".join(oracle_cte(n) for n in names) + "\n"
