"""Fixed values of the reference, written out for the oracle alone: the plans
have their own, so a slip on either side shows as a mismatch."""

# Recommended value per checked setting (max_wal_senders has one but is not shown).
ADVICE = (
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
)

SHOWN = tuple(name for name, _ in ADVICE if name != "max_wal_senders")

# Settings of the recovery-role report; the last two with their unit.
ROLE = ("synchronous_commit", "synchronous_standby_names", "hot_standby", "hot_standby_feedback")
ROLE_UNIT = ("recovery_min_apply_delay", "wal_keep_size")
CHECKPOINTS = ("Write-Ahead Log / Checkpoints", "Resource Usage / Background Writer")
RECOVERY = "Write-Ahead Log / Recovery"

# Phase names of each command and their labels.
INDEX_PHASES = (
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
)

VACUUM_PHASES = (
    ("initializing", "1 of 7"),
    ("scanning heap", "2 of 7"),
    ("vacuuming indexes", "3 of 7"),
    ("vacuuming heap", "4 of 7"),
    ("cleaning up indexes", "5 of 7"),
    ("truncating heap", "6 of 7"),
    ("performing final cleanup", "7 of 7"),
)

ANALYZE_PHASES = (
    ("initializing", "1 of 6"),
    ("acquiring sample rows", "2 of 6"),
    ("acquiring inherited sample rows", "3 of 6"),
    ("computing statistics", "4 of 6"),
    ("computing extended statistics", "5 of 6"),
    ("finalizing analyze", "6 of 6"),
)

# Server defaults of the autovacuum settings, and the label of waiting tables.
AUTOVACUUM = {"autovacuum_vacuum_threshold": "50", "autovacuum_vacuum_scale_factor": "0.2"}
QUEUED = "~~~ in queue ~~~"

# Privilege letters and names; PUBLIC as a role.
PRIVILEGES = (
    ("a", "INSERT"),
    ("r", "SELECT"),
    ("w", "UPDATE"),
    ("d", "DELETE"),
    ("D", "TRUNCATE"),
    ("x", "REFERENCES"),
    ("t", "TRIGGER"),
    ("X", "EXECUTE"),
    ("U", "USAGE"),
    ("C", "CREATE"),
    ("T", "TEMPORARY"),
    ("c", "CONNECT"),
    ("s", "SET"),
    ("A", "ALTER SYSTEM"),
    ("m", "MAINTAIN"),
)

PUBLIC = "-"

# Relation kinds.
KINDS = (
    ("r", "table"),
    ("i", "index"),
    ("S", "sequence"),
    ("v", "view"),
    ("m", "materialized view"),
    ("c", "composite type"),
    ("t", "toast table"),
    ("f", "foreign table"),
    ("p", "partitioned table"),
    ("I", "partitioned index"),
    ("G", "global index"),
)
