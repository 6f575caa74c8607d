"""Oracle SQL for the streaming reports (their complete results)."""

from fleetscope.oracle.common import with_tables

STREAM_SESSION_MIX = with_tables("activity") + """
select instance, date_trunc('day', snap_ts) as window_start, date_trunc('day', snap_ts) + interval 1 day as window_end,
  state, count(*) as sess_count
from activity where backend_type = 'client backend' and not is_collector group by all
"""

STREAM_LATEST_PROGRESS = with_tables("progress_vacuum") + """
select * exclude (_rn) from (
  select *, date_trunc('hour', snap_ts) as window_start,
    row_number() over (partition by instance, pid, date_trunc('hour', snap_ts) order by snap_ts desc) as _rn
  from progress_vacuum) x
where _rn = 1
"""

STREAM_LOCKER_QUERIES = with_tables("progress_index", "late_activity") + """
select p.instance, p.snap_ts as build_ts, p.pid as build_pid, p.datname, p.index_relid, p.phase, p.current_locker_pid as locker_pid,
  a.snap_ts as seen_ts, a.state as locker_state, left(a.query, 100) as locker_query
from progress_index p
left join late_activity a on a.instance = p.instance and a.pid = p.current_locker_pid
  and abs(epoch_us(a.snap_ts) - epoch_us(p.snap_ts)) <= 60000000
where p.current_locker_pid is not null
"""

# A stall ends a command's run of polls: ten minutes of silence, or the end of the feed.
STREAM_COMMAND_MONITOR = with_tables("vacuum_history", extra="""
polls as (
  select instance, pid, snap_ts, relid, phase, heap_blks_total as total,
    case when phase = 'vacuuming heap' then heap_blks_vacuumed else heap_blks_scanned end as done,
    epoch_us(snap_ts) as us, lag(epoch_us(snap_ts)) over w as us0, lag(relid) over w as relid0, lag(phase) over w as phase0,
    lag(case when phase = 'vacuuming heap' then heap_blks_vacuumed else heap_blks_scanned end) over w as done0,
    lead(epoch_us(snap_ts)) over w as us1
  from vacuum_history window w as (partition by instance, pid order by snap_ts)),
continued as (
  select *, coalesce(us - us0 <= 600000000 and relid = relid0 and phase = phase0, false) as goes_on from polls),
runs as (
  select *, sum(case when goes_on and done = done0 then 0 else 1 end) over (partition by instance, pid order by us) as still from continued),
rated as (
  select *, case when goes_on and done >= done0 then (done - done0) * 1e6::double / (us - us0) end as rate,
    min(us) over (partition by instance, pid, still) as moved from runs)""") + """
select instance, pid, 'poll' as event, snap_ts, relid, phase, done, total, rate,
  case when rate <> 0 then (total - done) / rate end as left_s, (us - moved) / 1e6::double as idle_s
from rated
union all
select instance, pid, 'stalled', snap_ts + interval 600 second, relid, phase, done, total, null, null, (us + 600000000 - moved) / 1e6::double
from rated where us1 is null or us1 - us > 600000000
"""

SQL = {
    "stream_locker_queries": STREAM_LOCKER_QUERIES,
    "stream_command_monitor": STREAM_COMMAND_MONITOR,
    "stream_session_mix": STREAM_SESSION_MIX,
    "stream_latest_progress": STREAM_LATEST_PROGRESS,
}
