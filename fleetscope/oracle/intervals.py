"""Oracle SQL for the reports between two snapshots. Segments are numbered by
a running count of restarts, and a delta is a difference within its segment
(to zero at its start), so the rule is stated in another way than in Spark."""

from fleetscope.oracle.common import pct, rdiv, secs, us, with_tables

def _segments(table: str, keys: str, series: str, counters: list[str], reset: str | None) -> str:
    """CTEs up to ``d``: rows of ``table`` with from_ts, restarted and ``d_<counter>``."""
    e = f"partition by {keys} order by snap_ts"
    falls = " or ".join(f"coalesce({c} < lag({c}) over e, false)" for c in counters)
    moved = f" or {reset} is distinct from lag({reset}) over e" if reset else ""
    return f"""
times as (
  select {series}, snap_ts, lag(snap_ts) over (partition by {series} order by snap_ts) as from_ts
  from (select distinct {series}, snap_ts from {table})),
marked as (
  select t.*, s.from_ts, (lag(t.snap_ts) over e) is distinct from s.from_ts or {falls}{moved} as restarted
  from {table} t join times s using ({series}, snap_ts) window e as (partition by {keys} order by t.snap_ts)),
numbered as (select *, sum(restarted::int) over ({e}) as segment from marked),
d as (
  select *, {", ".join(f"{c} - (case when restarted then 0 else lag({c}) over s end) as d_{c}" for c in counters)}
  from numbered window s as (partition by {keys}, segment order by snap_ts)
  qualify from_ts is not null)"""


def _rate(value: str) -> str:
    return f"cast(cast({value} as hugeint) * 1000000 // {us('snap_ts', 'from_ts')} as bigint)"


_WRITES = ["checkpoints_timed", "checkpoints_req", "buffers_checkpoint", "buffers_clean", "buffers_backend", "buffers_backend_fsync"]
_WRITTEN = "(d_buffers_checkpoint + d_buffers_clean + d_buffers_backend)"

WRITE_INTERVALS = with_tables("bgwriter_history", extra=_segments("bgwriter_history", "instance", "instance", _WRITES, "stats_reset")) + f"""
select instance, from_ts, snap_ts, {secs('snap_ts', 'from_ts')} as seconds, restarted,
  {", ".join(f"d_{c} as {c}" for c in _WRITES)},
  {pct('d_checkpoints_req', '(d_checkpoints_timed + d_checkpoints_req)')} as checkpoint_req_pct,
  {pct('d_buffers_backend', _WRITTEN)} as backends_written_pct,
  {_rate(f'{_WRITTEN} * block_size')} as bytes_per_s
from d"""

_STATEMENT = ["calls", "total_plan_time", "total_exec_time", "blk_read_time", "blk_write_time", "wal_bytes"]

STATEMENT_INTERVALS = with_tables("statements_history", extra=_segments(
    "statements_history", "instance, queryid, userid", "instance", _STATEMENT, None) + """,
q as (
  select instance, from_ts, snap_ts, queryid, sum(d_total_plan_time + d_total_exec_time) as t, sum(d_calls) as calls,
    sum(d_blk_read_time + d_blk_write_time) as io, sum(d_wal_bytes) as wal, count(*) filter (restarted) as restarted_entries
  from d group by all),
r as (
  select *, sum(t) over (partition by instance, snap_ts) as all_t, sum(calls) over (partition by instance, snap_ts) as all_calls from q)""") + f"""
select instance, from_ts, snap_ts, queryid, cast(calls as bigint) as calls, {_rate('calls * 1000')} as calls_per_1000s,
  {rdiv('t', '1', 2, 4)} as db_time_ms, {rdiv('t', 'calls', 3, 4)} as mean_ms, {rdiv('io', '1', 2, 4)} as io_time_ms,
  cast(wal as bigint) as wal_bytes, coalesce({pct('t', 'all_t', 2, 4)}, 0.0) as db_time_pct, coalesce({pct('calls', 'all_calls')}, 0.0) as calls_pct,
  restarted_entries
from r where calls > 0 qualify row_number() over (partition by instance, snap_ts order by t desc nulls last, queryid) <= 10"""

INDEX_INTERVALS = with_tables("index_history", "databases_history", extra="""
dated as (
  select i.*, b.stats_reset from index_history i
  left join databases_history b on b.instance = i.instance and b.snap_ts = i.snap_ts and b.datname = i.datname),""" + _segments(
    "dated", "instance, datname, indexrelid", "instance, datname", ["idx_scan"], "stats_reset")) + f"""
select instance, datname, schemaname, relname, from_ts, snap_ts, count(*) as indexes, count(*) filter (d_idx_scan = 0) as idle_indexes,
  cast(sum(d_idx_scan) as bigint) as scans, max(d_idx_scan) as busiest_scans, count(*) filter (restarted) as restarted_indexes,
  {_rate('sum(d_idx_scan) * 1000')} as scans_per_1000s
from d group by instance, datname, schemaname, relname, from_ts, snap_ts"""

GROWTH_UNDER_HORIZON = with_tables("table_history", "activity", extra="""
grown as (
  select instance, datname, relid, lag(snap_ts) over t as from_ts, snap_ts as to_ts, n_dead_tup - lag(n_dead_tup) over t as dead_growth
  from table_history window t as (partition by instance, datname, relid order by snap_ts)),
held as (
  select instance, datname, pid, xact_start, max(snap_ts) as seen_ts, arg_max(usename, snap_ts) as usename, arg_max(backend_xmin, snap_ts) as backend_xmin
  from activity where backend_xmin is not null and xact_start is not null group by instance, datname, pid, xact_start)""") + f"""
select g.*, h.pid, h.usename, h.backend_xmin, h.xact_start,
  {us('least(g.to_ts, h.seen_ts)', 'greatest(g.from_ts, h.xact_start)')} / 1000000 as overlap_s
from grown g join held h on h.instance = g.instance and h.datname = g.datname and h.xact_start < g.to_ts and g.from_ts < h.seen_ts
where g.dead_growth > 0"""

SQL = {
    "growth_under_horizon": GROWTH_UNDER_HORIZON,
    "write_intervals": WRITE_INTERVALS,
    "statement_intervals": STATEMENT_INTERVALS,
    "index_intervals": INDEX_INTERVALS,
}
