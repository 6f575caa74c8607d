"""Oracle SQL for the progress reports."""

from fleetscope.oracle.common import pretty, rdiv, secs, wait_label, whole_secs, with_tables
from fleetscope.oracle.values import ANALYZE_PHASES, AUTOVACUUM, INDEX_PHASES, QUEUED, VACUUM_PHASES


def _case(col: str, pairs) -> str:
    return "(case " + col + " " + " ".join(f"when '{k}' then '{v}'" for k, v in pairs) + " end)"


def _ptext(done: str, total: str) -> str:
    p = f"cast(cast({rdiv(f'{done} * 100', total, 2)} as decimal(38,2)) as varchar)"
    return (f"coalesce({p} || '%', 'N/A') || ' (' || coalesce(cast({done} as varchar), '?') || ' of ' "
            f"|| coalesce(cast({total} as varchar), '?') || ')'")


def _rc(name: str, oid: str) -> str:
    return f"coalesce({name}, cast({oid} as varchar))"


def _on(a: str, b: str, *pairs: tuple[str, str]) -> str:
    conds = [f"{a}.instance = {b}.instance", f"{a}.snap_ts = {b}.snap_ts"]
    conds += [f"{a}.{x} = {b}.{y}" for x, y in pairs]
    return " and ".join(conds)


_DUR = whole_secs("p.snap_ts", "coalesce(a.xact_start, a.query_start, a.backend_start)")

INDEX_BUILD_PROGRESS = with_tables("progress_index", "lock_activity", "relations", "table_stats") + f"""
select p.instance, p.snap_ts, p.snap_ts as now, p.pid, p.index_relid, a.query_start as started_at,
  {secs('p.snap_ts', 'a.query_start')} as query_duration_s,
  '[' || coalesce(cast(a.pid as varchar), '') || '] ' || coalesce(a.query, '') as pid_and_query,
  {_rc('ri.relname', 'p.index_relid')} as index_name, {_rc('rt.relname', 'p.relid')} as table_name,
  {pretty('rt.size_bytes')} as table_size,
  nullif(a.wait_event_type, '') || ': ' || a.wait_event as wait_type_and_event,
  p.phase,
  coalesce({_case('p.phase', INDEX_PHASES)},
           case when left(p.phase, 14) = 'building index' then '3 of 10' else '' end) as phase_num,
  {_ptext('p.blocks_done', 'p.blocks_total')} as blocks_progress,
  {_ptext('p.tuples_done', 'p.tuples_total')} as tuples_progress,
  p.current_locker_pid,
  nullif(left(la.query, 150), '') || '...' as current_locker_query,
  {_ptext('p.lockers_done', 'p.lockers_total')} as lockers_progress,
  {_ptext('p.partitions_done', 'p.partitions_total')} as partitions_progress,
  (select coalesce(cast(cast({rdiv('t.n_dead_tup * 100', 'tc.reltuples', 2)} as decimal(38,2)) as varchar) || '%',
                   'N/A') || ' (' || coalesce(cast(t.n_dead_tup as varchar), '?') || ' of '
          || coalesce(cast(cast(round_even(tc.reltuples, 0) as bigint) as varchar), '?') || ')'
   from table_stats t join relations tc on {_on('t', 'tc', ('relid', 'oid'), ('datname', 'datname'))}
   where {_on('t', 'p', ('relid', 'relid'), ('datname', 'datname'))}) as table_dead_tuples
from progress_index p
left join lock_activity a on {_on('a', 'p', ('pid', 'pid'))}
left join relations ri on {_on('ri', 'p', ('oid', 'index_relid'), ('datname', 'datname'))}
left join relations rt on {_on('rt', 'p', ('oid', 'relid'), ('datname', 'datname'))}
left join lock_activity la on {_on('la', 'p', ('pid', 'current_locker_pid'))}
"""

VACUUM_PROGRESS = with_tables("progress_vacuum", "lock_activity", "relations") + f"""
select p.instance, p.snap_ts, p.pid, {_DUR} as duration_s,
  {wait_label('a.wait_event_type', 'a.wait_event')} as wait_event,
  case when regexp_matches(a.query, 'to prevent wraparound') then 'freeze' else 'regular' end as mode,
  p.datname as db, {_rc('r.relname', 'p.relid')} as "table", p.phase, {_case('p.phase', VACUUM_PHASES)} as phase_num,
  {pretty('r.size_bytes')} as table_size, {pretty('r.total_size_bytes')} as total_table_size,
  {pretty('p.heap_blks_scanned * 8192')} as scanned, {pretty('p.heap_blks_vacuumed * 8192')} as vacuumed,
  (100 * p.heap_blks_scanned) // nullif(p.heap_blks_total, 0) as scanned_pct,
  (100 * p.heap_blks_vacuumed) // nullif(p.heap_blks_total, 0) as vacuumed_pct,
  p.index_vacuum_count as ind_vac_cnt,
  {rdiv('p.num_dead_tuples * 100', 'p.max_dead_tuples', 1)} as mwm_util_pct
from progress_vacuum p
left join lock_activity a on {_on('a', 'p', ('pid', 'pid'))}
left join relations r on {_on('r', 'p', ('oid', 'relid'), ('datname', 'datname'))}
"""

_OPTS = "array_to_string(reloptions, '')"


def _eff(opt: str) -> str:
    own = f"regexp_extract({_OPTS}, '.*{opt}=([0-9.]+)', 1)"
    return (f"case when {_OPTS} like '%{opt}%' then {own} "
            f"else coalesce(g.{opt}, '{AUTOVACUUM[opt]}') end")


_T = "autovacuum_vacuum_threshold"
_S = "autovacuum_vacuum_scale_factor"

VACUUM_QUEUE = with_tables("table_stats", "relations", "settings", "progress_vacuum", "lock_activity", "indexes",
                           extra=f"""
g as (
  select instance, snap_ts,
    max(case when name = '{_T}' then setting end) as {_T},
    max(case when name = '{_S}' then setting end) as {_S}
  from settings where name in ('{_T}', '{_S}') group by all),
vs as (
  select r.instance, r.snap_ts, r.oid as relid, r.datname, r.relname, r.nspname, r.reltuples,
    try_cast({_eff(_T)} as bigint) as vac_threshold, {_eff(_S)} as vac_scale_text,
    case when regexp_matches({_OPTS}, 'autovacuum_enabled=(false|off)') then false else true end as vac_enabled
  from relations r left join g on g.instance = r.instance and g.snap_ts = r.snap_ts),
t as (
  select ts.instance, ts.snap_ts, ts.relid, ts.n_dead_tup, ts.last_vacuum, ts.last_autovacuum,
    vs.datname, vs.relname, vs.nspname, vs.reltuples, vs.vac_threshold, vs.vac_scale_text, vs.vac_enabled
  from table_stats ts join vs on vs.instance = ts.instance and vs.snap_ts = ts.snap_ts and vs.relid = ts.relid
    and vs.datname = ts.datname),
ic as (select instance, snap_ts, datname, indrelid, count(*) as n from indexes group by all),
j as (
  select coalesce(t.instance, p.instance) as instance, coalesce(t.snap_ts, p.snap_ts) as snap_ts,
    t.relid as t_relid, p.relid as p_relid, coalesce(t.datname, p.datname) as datname,
    t.relname, t.nspname, t.reltuples, t.n_dead_tup, t.last_vacuum, t.last_autovacuum,
    t.vac_threshold, t.vac_scale_text, t.vac_enabled,
    p.pid, p.phase, p.heap_blks_total, p.heap_blks_scanned, p.heap_blks_vacuumed, p.index_vacuum_count
  from t full join progress_vacuum p on t.instance = p.instance and t.snap_ts = p.snap_ts and t.relid = p.relid
    and t.datname = p.datname)""") + f"""
select j.instance, j.snap_ts,
  coalesce(coalesce(nullif(nspname, 'public') || '.', '') || relname,
           '[something in "' || case when regexp_matches(j.datname, '^[a-z_][a-z0-9_$]*$') then j.datname
                                     else '"' || replace(j.datname, '"', '""') || '"' end || '"]') as relation,
  {rdiv('n_dead_tup * 100', 'reltuples', 2)} as dead_tup_pct, reltuples, n_dead_tup,
  'vt: ' || coalesce(cast(vac_threshold as varchar), '') || ', vsf: ' || coalesce(vac_scale_text, '') || ', '
    || case when vac_enabled then 'enabled' else 'DISABLED' end as effective_settings,
  case when last_autovacuum > coalesce(last_vacuum, timestamp '0001-01-01 00:00:00')
         then strftime(last_autovacuum, '%Y-%m-%d %H:%M:%S') || ' (auto)'
       when last_vacuum is not null then strftime(last_vacuum, '%Y-%m-%d %H:%M:%S') || ' (manual)' end
    as last_vacuumed,
  coalesce(phase, '{QUEUED}') as status, j.pid,
  case when regexp_matches(a.query, '^autovacuum.*to prevent wraparound') then 'wraparound'
       when regexp_matches(a.query, '^vacuum') then 'user'
       when a.pid is null then null else 'regular' end as mode,
  case when a.pid is null then null
       else coalesce(a.wait_event_type || '.' || a.wait_event, 'f') end as waiting,
  {rdiv('heap_blks_scanned * 100', 'heap_blks_total', 1)} as scanned_pct,
  {rdiv('heap_blks_vacuumed * 100', 'heap_blks_total', 1)} as vacuumed_pct,
  index_vacuum_count,
  case when t_relid is not null and p_relid is not null then coalesce(ic.n, 0) end as index_count
from j
left join lock_activity a on a.instance = j.instance and a.snap_ts = j.snap_ts and a.pid = j.pid
left join ic on ic.instance = j.instance and ic.snap_ts = j.snap_ts and ic.datname = j.datname and ic.indrelid = coalesce(j.t_relid, j.p_relid)
where t_relid is null or phase is not null
   or vac_threshold + try_cast(vac_scale_text as double) * reltuples < n_dead_tup
"""


def _share(done: str, total: str) -> str:
    return f"case when {total} > 0 then {rdiv(f'{done} * 100', total, 2)} else 0.0 end"


ANALYZE_PROGRESS = with_tables("progress_analyze", "lock_activity", "relations") + f"""
select p.instance, p.snap_ts, p.pid, {_DUR} as duration_s,
  {wait_label('a.wait_event_type', 'a.wait_event')} as wait_event, a.state as state,
  p.datname as db, {_rc('r.relname', 'p.relid')} as "table", p.phase, {_case('p.phase', ANALYZE_PHASES)} as phase_num,
  {pretty('r.size_bytes')} as table_size, {pretty('r.total_size_bytes')} as total_table_size,
  case when p.current_child_relid > 0 then 'child: ' || {_rc('c.relname', 'p.current_child_relid')} else '' end
    as current_child,
  {_share('p.sample_blks_scanned', 'p.sample_blks_total')} as blocks_pct,
  {_share('p.ext_stats_computed', 'p.ext_stats_total')} as extended_pct,
  {_share('p.child_tables_done', 'p.child_tables_total')} as child_pct
from progress_analyze p
left join lock_activity a on {_on('a', 'p', ('pid', 'pid'))}
left join relations r on {_on('r', 'p', ('oid', 'relid'), ('datname', 'datname'))}
left join relations c on {_on('c', 'p', ('oid', 'current_child_relid'), ('datname', 'datname'))}
"""

COPY_PROGRESS = with_tables("progress_copy", "lock_activity", "relations", "databases") + f"""
select p.instance, p.snap_ts, p.pid, {_DUR} as duration_s, p.datname as db, {pretty('d.size_bytes')} as db_size,
  {_rc('r.relname', 'p.relid')} as relation, {pretty('r.size_bytes')} as rel_size,
  {pretty('r.total_size_bytes')} as total_rel_size, p.command, p.type,
  case when p.bytes_total <> 0
       then cast(cast(abs({rdiv('p.bytes_processed * 100', 'p.bytes_total', 2)}) as decimal(38,2)) as varchar) || '%'
       else {pretty('p.bytes_processed')} end as bytes_pct
from progress_copy p
left join lock_activity a on {_on('a', 'p', ('pid', 'pid'))}
left join relations r on {_on('r', 'p', ('oid', 'relid'), ('datname', 'datname'))}
left join databases d on {_on('d', 'p', ('datname', 'datname'))}
"""

SQL = {
    "index_build_progress": INDEX_BUILD_PROGRESS,
    "vacuum_progress": VACUUM_PROGRESS,
    "vacuum_queue": VACUUM_QUEUE,
    "analyze_progress": ANALYZE_PROGRESS,
    "copy_progress": COPY_PROGRESS,
}
