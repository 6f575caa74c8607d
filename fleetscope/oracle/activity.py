"""Oracle SQL for the activity reports."""

from fleetscope.oracle.common import one_line, pct, pretty, rdiv, secs, top_k, us, wait_label, with_tables

_DURS = (f"{secs('snap_ts', 'xact_start')} as xact_s, {secs('snap_ts', 'query_start')} as query_s, "
         f"{secs('snap_ts', 'state_change')} as state_s")

def status(p: str = "") -> str:
    """Query status text; ``p`` qualifies the activity columns."""
    return (f"(case when {p}state = 'idle in transaction' then 'done, duration: ' || "
            f"cast((abs({us(p + 'query_start', p + 'state_change')}) + 500) // 1000 as varchar) || ' ms' "
            "else 'in progress, duration: ' || "
            f"cast((abs({us(p + 'snap_ts', p + 'query_start')}) + 500) // 1000 as varchar) || ' ms' end)")


_STATUS = status()

ACTIVE_SESSIONS = with_tables("activity") + f"""
select instance, snap_ts, usename, pid, backend_type, substr(application_name, 1, 20) as app, {_DURS},
  {wait_label()} as wait_event, substr(state, 1, 25) as state, {one_line('query', 40)} as short_query
from activity where state <> 'idle' and not is_collector
"""

LONG_SESSIONS = with_tables("activity") + f"""
select instance, snap_ts, usename, pid, {_DURS}, {_STATUS} as query_status,
  {wait_label()} as wait_event, substr(state, 1, 25) as state, {one_line('query', 50)} as short_query
from activity where state <> 'idle' and not is_collector
"""

SESSIONS_BY_STATE = with_tables("activity", extra=f"""
g as (
  select instance, snap_ts, state, count(*) as sess_count, sum(us) as sum_us, count(us) as n_us,
         min(us) as min_us, max(us) as max_us
  from (select *, {us('snap_ts', 'state_change')} as us from activity
        where not is_collector and backend_type = 'client backend') a
  group by instance, snap_ts, state),
t as (select instance, snap_ts, sum(sess_count) as total from g group by instance, snap_ts)""") + f"""
select g.instance, g.snap_ts, state, sess_count, {pct('sess_count', 'total', 2)} as pct,
  {rdiv('sum_us', 'n_us * 1000', 2)} as avg_state_time_ms,
  {rdiv('min_us', '1000', 2)} as min_state_time_ms,
  {rdiv('max_us', '1000', 2)} as max_state_time_ms
from g join t on g.instance = t.instance and g.snap_ts = t.snap_ts
"""

WAIT_EVENTS = with_tables("activity", extra=f"""
g as (select instance, snap_ts, {wait_label()} as wait_events, count(*) as sess_count
      from activity where state <> 'idle' and not is_collector group by all),
t as (select instance, snap_ts, sum(sess_count) as total from g group by all)""") + f"""
select g.instance, g.snap_ts, wait_events, sess_count, {pct('sess_count', 'total', 0)} as pct_wait_events
from g join t on g.instance = t.instance and g.snap_ts = t.snap_ts
"""

LOCK_MODES = with_tables("locks", "lock_activity", extra="""
g as (select instance, snap_ts, mode, granted, fastpath, count(*) as sess_count
      from locks l where locktype <> 'virtualxid'
        and not exists (select 1 from lock_activity a where a.is_collector and a.instance = l.instance
                        and a.snap_ts = l.snap_ts and a.pid = l.pid)
      group by all),
t as (select instance, snap_ts, sum(sess_count) as total from g group by all)""") + f"""
select g.instance, g.snap_ts,
  mode || ':' || cast(granted as varchar) || ':' || cast(fastpath as varchar) as mode_granted_fastpath,
  sess_count, {pct('sess_count', 'total', 0)} as pct_hw_locks
from g join t on g.instance = t.instance and g.snap_ts = t.snap_ts
"""

_DB = "(total_plan_time + total_exec_time)"

TOP_UNSTABLE_STATEMENTS = with_tables("statements", extra=f"""
tot as (
  select instance, snap_ts,
    coalesce(sum(case when {_DB} > 0 and calls > 0 then {_DB} end), 0) as total_db_time,
    coalesce(sum(case when {_DB} > 0 and calls > 0 then calls end), 0) as total_calls
  from statements group by all),
fs as (
  select instance, snap_ts, queryid, sum({_DB}) as db_time, sum(calls) as calls_count,
    avg(mean_exec_time) as avg_time, avg(stddev_exec_time) as avg_stddev,
    min(min_exec_time) as min_time, max(max_exec_time) as max_time,
    avg(stddev_exec_time) / nullif(avg(mean_exec_time), 0) as instability_raw,
    max(max_exec_time) / nullif(avg(mean_exec_time), 0) as degradation_raw
  from statements group by all
  having avg(mean_exec_time) > 1
     and (avg(stddev_exec_time) / nullif(avg(mean_exec_time), 0) > 1.5
          or max(max_exec_time) / nullif(avg(mean_exec_time), 0) > 3)),
o as (
  select fs.instance, fs.snap_ts, queryid,
    case when total_db_time > 0 then {pct('db_time', 'total_db_time', 2, 4)} else 0.0 end as t_db_time_pct,
    {rdiv('db_time', '1', 2, 4)} as t_db_time_ms,
    case when total_calls > 0 then {pct('calls_count', 'total_calls', 2)} else 0.0 end as t_calls_pct,
    cast(calls_count as bigint) as t_calls,
    round(avg_time, 3) as avg_exec_time_ms, round(avg_stddev, 3) as avg_stddev_ms,
    round(min_time, 2) as min_exec_time_ms, round(max_time, 2) as max_exec_time_ms,
    round(instability_raw, 2) as instability, round(degradation_raw, 2) as degradation
  from fs join tot on fs.instance = tot.instance and fs.snap_ts = tot.snap_ts)""") + top_k(
    "select * from o", "degradation desc nulls first, instability desc nulls first, queryid", 10)

_CPU = f"({_DB} - blk_read_time - blk_write_time)"
_IO = "(blk_read_time + blk_write_time)"

TOP_STATEMENTS = with_tables("statements", extra=f"""
g as (
  select instance, snap_ts, queryid, sum({_DB}) as db_time, sum(total_exec_time) as exec_time,
    sum({_CPU}) as cpu_time, sum({_IO}) as io_time, sum(calls) as calls, sum(wal_bytes) as wal,
    avg(mean_exec_time) as avg_mean, avg(stddev_exec_time) as avg_stddev
  from statements group by all),
t as (
  select instance, snap_ts, sum(db_time) as tot_db, sum(cpu_time) as tot_cpu, sum(io_time) as tot_io,
    sum(calls) as tot_calls, sum(wal) as tot_wal
  from g group by all),
o as (
  select g.instance, g.snap_ts, queryid,
    coalesce({pct('db_time', 'tot_db', 2, 4)}, 0.0) as t_db_time_pct,
    {rdiv('exec_time', '1', 2, 4)} as t_db_time_ms,
    coalesce({pct('cpu_time', 'tot_cpu', 2, 4)}, 0.0) as t_cpu_pct,
    {rdiv('cpu_time', '1', 2, 4)} as t_cpu_time_ms,
    coalesce({pct('io_time', 'tot_io', 2, 4)}, 0.0) as t_io_pct,
    {rdiv('io_time', '1', 2, 4)} as t_io_time_ms,
    coalesce({pct('calls', 'tot_calls', 2)}, 0.0) as t_calls_pct,
    cast(calls as bigint) as t_calls,
    coalesce({pct('wal', 'tot_wal', 2)}, 0.0) as t_wal_size_pct,
    cast(wal as bigint) as t_wal_bytes,
    {pretty('wal')} as t_wal_size,
    round(avg_mean, 3) as avg_exec_time_ms, round(avg_stddev, 3) as avg_stddev_exec_time_ms,
    db_time as _key
  from g join t on g.instance = t.instance and g.snap_ts = t.snap_ts)""") + (
    "select * exclude (_key) from (" + top_k("select * from o", "_key desc nulls first, queryid", 10) + ") _x")

SQL = {
    "active_sessions": ACTIVE_SESSIONS,
    "long_sessions": LONG_SESSIONS,
    "sessions_by_state": SESSIONS_BY_STATE,
    "wait_events": WAIT_EVENTS,
    "lock_modes": LOCK_MODES,
    "top_unstable_statements": TOP_UNSTABLE_STATEMENTS,
    "top_statements": TOP_STATEMENTS,
}

_TARGET = ["database", "relation", "page", "tuple", "virtualxid", "transactionid", "classid", "objid", "objsubid"]
_ON = " and ".join(f"o.{c} is not distinct from w.{c}" for c in _TARGET)

BLOCKING_SESSIONS = with_tables("locks", "lock_activity") + f"""
select w.instance, w.snap_ts, w.pid as blocked_pid, ba.usename as blocked_user, o.pid as blocking_pid,
  oa.usename as blocking_user, {one_line('ba.query', 40)} as blocked_statement,
  {one_line('oa.query', 40)} as current_statement_in_blocking_process
from locks w
join lock_activity ba on ba.instance = w.instance and ba.snap_ts = w.snap_ts and ba.pid = w.pid
join locks o on o.instance = w.instance and o.snap_ts = w.snap_ts and o.locktype = w.locktype and {_ON}
  and o.pid <> w.pid
join lock_activity oa on oa.instance = o.instance and oa.snap_ts = o.snap_ts and oa.pid = o.pid
where not w.granted
"""

RELATION_LOCKS = with_tables("lock_activity", "locks", "relations") + f"""
select l.instance, l.snap_ts, l.pid, c.relname as relation, l.locktype, l.mode, l.granted, l.fastpath,
  {status('a.')} as query_status, {wait_label()} as wait_event, substr(a.state, 1, 25) as state,
  {one_line('a.query', 50)} as short_query
from lock_activity a join locks l on a.instance = l.instance and a.snap_ts = l.snap_ts and a.pid = l.pid
join relations c on c.instance = l.instance and c.snap_ts = l.snap_ts and c.oid = l.relation
  and c.datoid = l.database
where l.locktype = 'relation' and not regexp_matches(c.relname, '^pg_')
"""

SESSIONS_BY_TEMP = with_tables("tempfiles", "lock_activity", extra="""
t as (
  select instance, snap_ts, tablespace as tblspc_name, sum(size) as tmp_bytes, count(*) as tmp_files,
    try_cast(split_part(split_part(split_part(name, '_', 2), 'tmp', 2), '.', 1) as bigint) as pid
  from tempfiles where tablespace <> 'pg_global' group by all)""") + f"""
select t.instance, t.snap_ts, tblspc_name, cast(tmp_bytes as bigint) as tmp_bytes, {pretty('tmp_bytes')} as tmp_size,
  tmp_files, cast(t.pid as bigint) as pid, {status('a.')} as query_status, {wait_label()} as wait_event,
  substr(a.state, 1, 25) as state, {one_line('a.query', 50)} as short_query
from t left join lock_activity a on a.instance = t.instance and a.snap_ts = t.snap_ts and a.pid = t.pid
"""

SQL.update({
    "blocking_sessions": BLOCKING_SESSIONS,
    "relation_locks": RELATION_LOCKS,
    "sessions_by_temp": SESSIONS_BY_TEMP,
})
