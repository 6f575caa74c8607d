"""fleetscope: PostgreSQL fleet diagnostics as Spark DataFrame jobs.

Every report takes snapshot tables (server views collected from many
instances over time, keyed by ``instance`` and ``snap_ts``) and returns a
DataFrame computed for all scopes at once.
"""

SCOPE = ["instance", "snap_ts"]

__all__ = ["SCOPE"]
