"""Explicit schemas of the snapshot tables (never inferred).

Every table carries the scope keys ``instance`` and ``snap_ts``; tables read
inside one database (catalogs, table and index statistics, running commands)
also carry ``datname``, since databases of one server share oids. Columns named ``*_pos`` are WAL positions as integers; xids are
plain integers and ``next_xid`` is the server's next transaction id, so the
age of an xid is ``next_xid - xid``. List columns (access lists, options) are
``ARRAY<STRING>``: their items may hold any separator.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

SCOPE_COLS = [("instance", "string"), ("snap_ts", "timestamp")]

_ACTIVITY = SCOPE_COLS + [
    ("datname", "string"), ("usename", "string"), ("pid", "bigint"), ("backend_type", "string"),
    ("application_name", "string"), ("client_addr", "string"), ("backend_start", "timestamp"),
    ("xact_start", "timestamp"), ("query_start", "timestamp"), ("state_change", "timestamp"),
    ("state", "string"), ("wait_event_type", "string"), ("wait_event", "string"),
    ("backend_xid", "bigint"), ("backend_xmin", "bigint"), ("next_xid", "bigint"),
    ("is_collector", "boolean"), ("query", "string"),
]

_ATTRIBUTES = SCOPE_COLS + [
    ("datname", "string"), ("attrelid", "bigint"), ("attnum", "int"), ("attname", "string"), ("typname", "string"),
    ("attisdropped", "boolean"),
]

_COLUMN_STATS = SCOPE_COLS + [
    ("datname", "string"), ("relid", "bigint"), ("attname", "string"), ("null_frac", "double"), ("avg_width", "int"),
]

_PROGRESS = SCOPE_COLS + [("pid", "bigint"), ("datname", "string"), ("relid", "bigint"), ("phase", "string")]

SNAPSHOT_COLUMNS: dict[str, list[tuple[str, str]]] = {
    "instances": SCOPE_COLS + [
        ("start_time", "timestamp"), ("in_recovery", "boolean"), ("current_pos", "bigint"),
        ("next_xid", "bigint"),
    ],
    "settings": SCOPE_COLS + [
        ("name", "string"), ("setting", "string"), ("boot_val", "string"), ("unit", "string"),
        ("context", "string"), ("category", "string"),
    ],
    "databases": SCOPE_COLS + [
        ("oid", "bigint"), ("datname", "string"), ("owner", "string"), ("locprovider", "string"),
        ("can_connect", "boolean"), ("size_bytes", "bigint"), ("tablespace_oid", "bigint"),
        ("frozen_xid_age", "bigint"), ("freeze_max_age", "bigint"), ("acl", "array<string>"),
        ("stats_reset", "timestamp"), ("start_time", "timestamp"), ("encoding", "string"),
        ("datcollate", "string"), ("datctype", "string"), ("icu_locale", "string"),
    ],
    "tablespaces": SCOPE_COLS + [("oid", "bigint"), ("spcname", "string")],
    "bgwriter": SCOPE_COLS + [
        ("stats_reset", "timestamp"), ("checkpoints_timed", "bigint"), ("checkpoints_req", "bigint"),
        ("buffers_checkpoint", "bigint"), ("buffers_clean", "bigint"), ("buffers_backend", "bigint"),
        ("buffers_backend_fsync", "bigint"), ("block_size", "int"),
    ],
    "activity": _ACTIVITY,
    "lock_activity": _ACTIVITY,
    "locks": SCOPE_COLS + [
        ("pid", "bigint"), ("locktype", "string"), ("database", "bigint"), ("relation", "bigint"),
        ("page", "bigint"), ("tuple", "bigint"), ("virtualxid", "string"), ("transactionid", "bigint"),
        ("classid", "bigint"), ("objid", "bigint"), ("objsubid", "bigint"), ("mode", "string"),
        ("granted", "boolean"), ("fastpath", "boolean"),
    ],
    "prepared": SCOPE_COLS + [
        ("gid", "string"), ("prepared", "timestamp"), ("owner", "string"), ("database", "string"),
        ("transaction", "bigint"), ("next_xid", "bigint"),
    ],
    "tempfiles": SCOPE_COLS + [("tablespace", "string"), ("name", "string"), ("size", "bigint")],
    "statements": SCOPE_COLS + [
        ("queryid", "bigint"), ("userid", "bigint"), ("calls", "bigint"),
        ("total_plan_time", "decimal(18,4)"), ("total_exec_time", "decimal(18,4)"),
        ("blk_read_time", "decimal(18,4)"), ("blk_write_time", "decimal(18,4)"),
        ("wal_bytes", "bigint"), ("mean_exec_time", "double"), ("stddev_exec_time", "double"),
        ("min_exec_time", "double"), ("max_exec_time", "double"),
    ],
    "roles": SCOPE_COLS + [
        ("oid", "bigint"), ("rolname", "string"), ("rolcanlogin", "boolean"), ("rolinherit", "boolean"),
        ("rolsuper", "boolean"), ("rolcreaterole", "boolean"), ("rolcreatedb", "boolean"),
        ("rolreplication", "boolean"), ("rolbypassrls", "boolean"), ("rolconnlimit", "int"),
        ("rolvaliduntil", "timestamp"), ("rolconfig", "array<string>"),
    ],
    "auth_members": SCOPE_COLS + [("member", "bigint"), ("roleid", "bigint")],
    "acls": SCOPE_COLS + [("object_name", "string"), ("owner", "string"), ("acl", "array<string>")],
    "relations": SCOPE_COLS + [
        ("datname", "string"), ("datoid", "bigint"), ("oid", "bigint"), ("relname", "string"), ("nspname", "string"), ("relowner", "string"),
        ("tablespace_oid", "bigint"), ("relkind", "string"), ("reltuples", "double"),
        ("relpages", "bigint"), ("toast_pages", "bigint"), ("toast_tuples", "double"),
        ("reloptions", "array<string>"), ("size_bytes", "bigint"), ("total_size_bytes", "bigint"),
    ],
    "table_stats": SCOPE_COLS + [
        ("datname", "string"), ("relid", "bigint"), ("n_dead_tup", "bigint"), ("last_vacuum", "timestamp"),
        ("last_autovacuum", "timestamp"), ("last_analyze", "timestamp"), ("last_autoanalyze", "timestamp"),
    ],
    "attributes": _ATTRIBUTES,
    "column_stats": _COLUMN_STATS,
    "indexes": SCOPE_COLS + [
        ("datname", "string"), ("indexrelid", "bigint"), ("idxname", "string"), ("indrelid", "bigint"), ("amname", "string"),
        ("indisunique", "boolean"), ("indkey", "string"), ("reltuples", "double"), ("relpages", "bigint"),
        ("reloptions", "array<string>"), ("size_bytes", "bigint"),
    ],
    "index_stats": SCOPE_COLS + [
        ("datname", "string"), ("indexrelid", "bigint"), ("schemaname", "string"), ("relname", "string"), ("idx_scan", "bigint"),
    ],
    "slots": SCOPE_COLS + [
        ("slot_name", "string"), ("plugin", "string"), ("slot_type", "string"), ("active_pid", "bigint"),
        ("xmin", "bigint"), ("catalog_xmin", "bigint"), ("restart_pos", "bigint"),
        ("confirmed_pos", "bigint"), ("next_xid", "bigint"), ("database", "string"), ("datoid", "bigint"),
        ("active", "boolean"), ("temporary", "boolean"),
    ],
    "senders": SCOPE_COLS + [
        ("pid", "bigint"), ("application_name", "string"), ("state", "string"), ("sync_state", "string"),
        ("sent_pos", "bigint"), ("write_pos", "bigint"), ("flush_pos", "bigint"), ("replay_pos", "bigint"),
        ("client_addr", "string"), ("usename", "string"),
    ],
    "progress_index": _PROGRESS + [
        ("blocks_done", "bigint"), ("blocks_total", "bigint"), ("tuples_done", "bigint"),
        ("tuples_total", "bigint"), ("lockers_done", "bigint"), ("lockers_total", "bigint"),
        ("partitions_done", "bigint"), ("partitions_total", "bigint"), ("current_locker_pid", "bigint"),
        ("index_relid", "bigint"),
    ],
    "progress_vacuum": _PROGRESS + [
        ("heap_blks_total", "bigint"), ("heap_blks_scanned", "bigint"),
        ("heap_blks_vacuumed", "bigint"), ("index_vacuum_count", "bigint"), ("num_dead_tuples", "bigint"),
        ("max_dead_tuples", "bigint"),
    ],
    "progress_analyze": _PROGRESS + [
        ("current_child_relid", "bigint"), ("sample_blks_total", "bigint"), ("sample_blks_scanned", "bigint"),
        ("ext_stats_total", "bigint"), ("ext_stats_computed", "bigint"), ("child_tables_total", "bigint"),
        ("child_tables_done", "bigint"),
    ],
    "progress_copy": _PROGRESS + [
        ("command", "string"), ("type", "string"), ("bytes_total", "bigint"),
        ("bytes_processed", "bigint"),
    ],
}

# Further tables of the same views: more snapshots, other contents.
for _history, _view in (("bgwriter_history", "bgwriter"), ("statements_history", "statements"), ("index_history", "index_stats"),
                        ("databases_history", "databases"), ("late_activity", "lock_activity"), ("table_history", "table_stats"),
                        ("vacuum_history", "progress_vacuum"), ("role_tree", "roles"), ("memberships", "auth_members"),
                        ("object_acls", "acls")):
    SNAPSHOT_COLUMNS[_history] = SNAPSHOT_COLUMNS[_view]


def ddl(name: str) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in SNAPSHOT_COLUMNS[name])


def schema(name: str) -> StructType:
    """Schema of snapshot table ``name``."""
    return StructType.fromDDL(ddl(name))
