"""Oracle SQL for the instance reports."""

from fleetscope.oracle.activity import _STATUS
from fleetscope.oracle.common import pct, pretty, secs, us, wait_label, whole_secs, with_tables
from fleetscope.oracle.values import ADVICE, CHECKPOINTS, RECOVERY, ROLE, ROLE_UNIT, SHOWN


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(xs) -> str:
    return ", ".join(_lit(x) for x in xs)


INSTANCE_UPTIME = with_tables("instances") + f"""
select instance, snap_ts, {whole_secs('snap_ts', 'start_time')} as uptime_s, start_time from instances
"""

_role_cols = ",\n  ".join(
    [f"max(case when name = {_lit(n)} then setting end) as {n}" for n in ROLE]
    + [f"max(case when name = {_lit(n)} then setting || ' ' || unit end) as {n}" for n in ROLE_UNIT])

ROLE_SETTINGS_SQL = with_tables("instances", "settings") + f"""
select i.instance, i.snap_ts,
  case when in_recovery then 'Replica [read only]' else 'Master [read-write]' end as role,
  {", ".join(ROLE + ROLE_UNIT)}
from instances i left join (
  select instance, snap_ts,
  {_role_cols}
  from settings group by instance, snap_ts) s on i.instance = s.instance and i.snap_ts = s.snap_ts
"""

_RESTART = "case when context = 'postmaster' then 'true' else 'false' end"

SETTINGS_NON_DEFAULT = with_tables("settings") + f"""
select instance, snap_ts, category, name, setting, unit, {_RESTART} as is_instance_restart_required, context
from settings where setting <> boot_val
"""

_advice_values = ", ".join(f"({_lit(n)}, {_lit(v)})" for n, v in ADVICE)

SETTINGS_CHECK = with_tables("settings") + f"""
select s.instance, s.snap_ts, s.name, s.setting as curr_value, s.unit, coalesce(a.recom, '-') as recom_value
from settings s left join (values {_advice_values}) a(name, recom) on s.name = a.name
where s.name in ({_list(SHOWN)})
"""

CHECKPOINT_SETTINGS = with_tables("settings") + f"""
select instance, snap_ts, name, setting, unit, context from settings
where category in ({_list(CHECKPOINTS)})
"""

REPLICATION_SETTINGS = with_tables("settings") + f"""
select instance, snap_ts, category, name, setting, unit, {_RESTART} as is_instance_restart_required, context
from settings where lower(category) like '%replication%' or category = {_lit(RECOVERY)}
"""

DATABASES_OVERVIEW = with_tables("databases", "tablespaces") + f"""
select d.instance, d.snap_ts, d.datname as database, owner, encoding, datcollate as "collate", datctype as "ctype", icu_locale,
  case locprovider when 'c' then 'libc' when 'i' then 'icu' end as locale_provider,
  case when can_connect then size_bytes end as size_bytes,
  case when can_connect then {pretty('size_bytes')} else 'No Access' end as size,
  t.spcname as tablespace,
  (100 * frozen_xid_age) // 2000000000 as pct_to_wraparound,
  (100 * frozen_xid_age) // freeze_max_age as pct_to_emergency_vacuum
from databases d join tablespaces t on d.tablespace_oid = t.oid and d.instance = t.instance and d.snap_ts = t.snap_ts
"""

CLUSTER_SIZE = with_tables("databases", extra="""
t as (select instance, snap_ts, sum(size_bytes) as total from databases group by all)""") + f"""
select d.instance, d.snap_ts, datname, size_bytes, {pretty('size_bytes')} as size,
  {pct('size_bytes', 'total', 2)} as pct
from databases d join t on d.instance = t.instance and d.snap_ts = t.snap_ts
union all
select instance, snap_ts, 'TOTAL', cast(total as bigint), {pretty('total')}, 100.0 from t
"""


def _pct_text(num: str, den: str) -> str:
    return f"cast(cast({pct(num, den, 2)} as decimal(38,2)) as varchar) || '%'"


_CK = "(checkpoints_timed + checkpoints_req)"
_BUF = "(buffers_checkpoint + buffers_clean + buffers_backend)"
_SECS = f"(sign({us('snap_ts', 'stats_reset')}) * ((abs({us('snap_ts', 'stats_reset')}) + 500000) // 1000000))"
_BYTES = f"cast({_BUF} * block_size as hugeint)"
_RATE = (f"(case when {_SECS} <> 0 then cast(sign({_BYTES}) * sign({_SECS}) * (abs({_BYTES}) // abs({_SECS})) "
         f"as bigint) end)")

WRITE_STATS = with_tables("bgwriter") + f"""
select instance, snap_ts, stats_reset,
  {_pct_text('checkpoints_timed', _CK)} as checkpoint_timed,
  {_pct_text('checkpoints_req', _CK)} as checkpoint_req,
  {_pct_text('buffers_checkpoint', _BUF)} as checkpoint_written,
  {_pct_text('buffers_clean', _BUF)} as bgwriter_written,
  {_pct_text('buffers_backend', _BUF)} as backends_written,
  {_pct_text('buffers_backend_fsync', _BUF)} as backends_fsync,
  {_RATE} as bytes_per_s,
  {pretty(_RATE)} || ' / s' as size_per_s
from bgwriter
"""

HORIZON_GLOBAL = with_tables("activity", "slots", "prepared", extra="""
a as (select instance, snap_ts, max(next_xid - backend_xmin) as a1, max(next_xid - backend_xid) as a2
      from activity group by all),
s as (select instance, snap_ts, max(next_xid - xmin) as a3, max(next_xid - catalog_xmin) as a4
      from slots group by all),
p as (select instance, snap_ts, max(next_xid - transaction) as a5 from prepared group by all)""") + """
select coalesce(a.instance, s.instance, p.instance) as instance, coalesce(a.snap_ts, s.snap_ts, p.snap_ts) as snap_ts,
  coalesce(greatest(a1, a2, a3, a4, a5), 0) as max_xmin_age
from a full join s on a.instance = s.instance and a.snap_ts = s.snap_ts
full join p on coalesce(a.instance, s.instance) = p.instance and coalesce(a.snap_ts, s.snap_ts) = p.snap_ts
"""

HORIZON_SESSIONS = with_tables("activity") + f"""
select instance, snap_ts, datname as db, usename as "user", pid, backend_xmin as xmin,
  next_xid - backend_xmin as xmin_age, backend_xid as xid, next_xid - backend_xid as xid_age,
  {secs('snap_ts', 'xact_start')} as xact_s, {secs('snap_ts', 'query_start')} as query_s,
  {secs('snap_ts', 'state_change')} as state_s, {_STATUS} as query_status,
  {wait_label()} as wait_event, substr(state, 1, 25) as state
from activity where (backend_xmin is not null or backend_xid is not null) and not is_collector
"""

HORIZON_SLOTS = with_tables("slots") + """
select instance, snap_ts, max(next_xid - xmin) as xmin_age, max(next_xid - catalog_xmin) as catalog_xmin_age
from slots group by all
"""

HORIZON_PREPARED = with_tables("prepared") + """
select instance, snap_ts, gid, prepared, owner, database, transaction as xmin, next_xid - transaction as xmin_age
from prepared
"""

SQL = {
    "instance_uptime": INSTANCE_UPTIME,
    "role_settings": ROLE_SETTINGS_SQL,
    "settings_non_default": SETTINGS_NON_DEFAULT,
    "settings_check": SETTINGS_CHECK,
    "checkpoint_settings": CHECKPOINT_SETTINGS,
    "replication_settings": REPLICATION_SETTINGS,
    "databases_overview": DATABASES_OVERVIEW,
    "cluster_size": CLUSTER_SIZE,
    "write_stats": WRITE_STATS,
    "horizon_global": HORIZON_GLOBAL,
    "horizon_sessions": HORIZON_SESSIONS,
    "horizon_slots": HORIZON_SLOTS,
    "horizon_prepared": HORIZON_PREPARED,
}
