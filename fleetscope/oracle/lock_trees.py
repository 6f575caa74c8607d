"""Oracle SQL for the lock trees: recursive CTEs (R18: levels by UNION, then
the smallest level and parent; R19: a keyed fixpoint)."""

from fleetscope.oracle.common import secs, with_tables

_OBJ = ["locktype", "database", "relation", "page", "tuple", "virtualxid", "transactionid", "classid", "objid",
        "objsubid"]
# Lock modes from weakest to strongest.
_modes = ("'accessshare', 'rowshare', 'rowexclusive', 'shareupdateexclusive', 'share', 'sharerowexclusive', 'exclusive', "
          "'accessexclusive'")
_S = "instance, snap_ts"


def _sc(a: str, b: str) -> str:
    return f"{a}.instance = {b}.instance and {a}.snap_ts = {b}.snap_ts"


EDGES = f"""
lr as (
  select {_S}, pid, granted, {", ".join(_OBJ)},
    coalesce(list_position([{_modes}], lower(regexp_replace(mode, '(?i)lock$', ''))), 0) as m
  from locks),
lr2 as (select *, max(m) over (partition by {_S}, pid, {", ".join(_OBJ)}) as max_m from lr),
edges as (
  select distinct w.instance, w.snap_ts, w.pid as waiter, h.pid as locker
  from lr2 w join lr2 h on {_sc('h', 'w')} and {" and ".join(f"h.{c} is not distinct from w.{c}" for c in _OBJ)}
    and h.pid <> w.pid and h.granted and h.m >= h.max_m
  where not w.granted)"""


def _round_s(end: str, start: str) -> str:
    u = f"(epoch_us({end}) - epoch_us({start}))"
    return f"cast(sign({u}) * ((abs({u}) + 500000) // 1000000) as bigint)"


def _forest(tag: str, edges: str, roots: str) -> str:
    """CTEs for a forest grown from ``roots`` along ``edges``."""
    return f"""
lm{tag}({_S}, pid, lvl) using key (instance, snap_ts, pid) as (
  select {_S}, pid, 0 from {roots}
  union
  select e.instance, e.snap_ts, e.waiter, min(l.lvl) + 1 from lm{tag} l join {edges} e on {_sc('e', 'l')} and e.locker = l.pid
  where not exists (select 1 from recurring.lm{tag} q where {_sc('q', 'e')} and q.pid = e.waiter)
  group by e.instance, e.snap_ts, e.waiter),
par{tag} as (
  select l.instance, l.snap_ts, l.pid, l.lvl, min(e.locker) as parent
  from lm{tag} l join {edges} e on {_sc('e', 'l')} and e.waiter = l.pid
  join lm{tag} p on {_sc('p', 'l')} and p.pid = e.locker and p.lvl = l.lvl - 1
  where l.lvl > 0 group by all),
tr{tag}({_S}, pid, parent, root, lvl, path) as (
  select {_S}, pid, cast(null as bigint), pid, 0, [pid] from {roots}
  union all
  select c.instance, c.snap_ts, c.pid, c.parent, t.root, c.lvl, list_append(t.path, c.pid)
  from tr{tag} t join par{tag} c on {_sc('c', 't')} and c.parent = t.pid)"""


_LOCK_TREE = EDGES + f""",
waiters as (select distinct {_S}, waiter as pid from edges),
roots as (
  select distinct e.instance, e.snap_ts, e.locker as pid from edges e
  where not exists (select 1 from waiters w where {_sc('w', 'e')} and w.pid = e.locker)),
{_forest('', 'edges', 'roots')},
stuck as (select * from waiters w where not exists (select 1 from lm m where {_sc('m', 'w')} and m.pid = w.pid)),
sedges as (
  select e.* from edges e
  where exists (select 1 from stuck s where {_sc('s', 'e')} and s.pid = e.waiter)
    and exists (select 1 from stuck s where {_sc('s', 'e')} and s.pid = e.locker)),
up({_S}, v, a) as (
  select {_S}, waiter, locker from edges
  union
  select x.instance, x.snap_ts, x.v, e.locker from up x join edges e on {_sc('e', 'x')} and e.waiter = x.a),
cyc as (
  select x.instance, x.snap_ts, x.v as pid, min(x.a) as deadlock_group
  from up x join up y on {_sc('x', 'y')} and x.v = y.a and x.a = y.v group by all),
croots as (
  select {_S}, pid from cyc where pid = deadlock_group
    and exists (select 1 from stuck s where {_sc('s', 'cyc')} and s.pid = cyc.pid)),
{_forest('2', 'sedges', 'croots')},
tree as (select * from tr union all select * from tr2)"""
_LOCK_TREE_ROWS = f"""
select t.instance, t.snap_ts, {_round_s('t.snap_ts', 'a.xact_start')} as ts_age_s,
  {_round_s('t.snap_ts', 'a.state_change')} as change_age_s, a.datname, a.usename, a.client_addr, t.pid,
  replace(a.state, 'idle in transaction', 'idletx') as state, t.lvl,
  (select count(*) from tree p where {_sc('p', 't')} and list_contains(p.path, t.pid) and p.pid <> t.pid) as blocked,
  case when c.pid is not null then '!>' else repeat(' .', t.lvl) end || ' '
    || trim(left(regexp_replace(a.query, '\\s+', ' ', 'g'), 100)) as query,
  t.root, t.parent, array_to_string(t.path, '.') as path, c.pid is not null as deadlock,
  c.deadlock_group
from tree t
left join cyc c on {_sc('c', 't')} and c.pid = t.pid
join lock_activity a on {_sc('a', 't')} and a.pid = t.pid
join lock_activity r on {_sc('r', 't')} and r.pid = t.root
"""

LOCK_TREE = with_tables("locks", "lock_activity", extra=_LOCK_TREE).replace("with ", "with recursive ", 1) + _LOCK_TREE_ROWS

# R18 on sessions collected up to 60 seconds before the locks.
LOCK_TREE_ASOF = with_tables("locks", "late_activity", extra="""
paired as (
  select l.instance, l.snap_ts, a.snap_ts as partner_ts
  from (select distinct instance, snap_ts from locks) l
  asof join (select distinct instance, snap_ts from late_activity) a on a.instance = l.instance and a.snap_ts <= l.snap_ts
  where l.snap_ts - a.snap_ts <= interval 60 second),
lock_activity as (
  select a.* replace (p.snap_ts as snap_ts)
  from late_activity a join paired p on p.instance = a.instance and p.partner_ts = a.snap_ts),
""" + _LOCK_TREE).replace("with ", "with recursive ", 1) + _LOCK_TREE_ROWS

# R19 as a keyed fixpoint: each round places the sessions whose blockers are
# all placed already (level = 1 + highest blocker level, top = smallest top,
# parent = blocker placed last, smallest pid on ties).
LOCK_TREE_ALL_BLOCKERS = with_tables("locks", "lock_activity", extra=EDGES + f""",
arr as (select {_S}, waiter as pid, list_sort(list_distinct(list(locker))) as blocked_by from edges group by all),
sess as (
  select a.*, coalesce(arr.blocked_by, cast([] as bigint[])) as blocked_by
  from lock_activity a left join arr on {_sc('arr', 'a')} and arr.pid = a.pid
  where a.state is distinct from 'idle'),
e19 as (select {_S}, pid, unnest(blocked_by) as blocker, len(blocked_by) as n from sess),
r19 as (
  select s.instance, s.snap_ts, s.pid from sess s
  where len(s.blocked_by) = 0 and exists (select 1 from e19 b where {_sc('b', 's')} and b.blocker = s.pid)),
placed({_S}, pid, level, top_blocker_pid, parent) using key (instance, snap_ts, pid) as (
  select {_S}, pid, 1, pid, cast(null as bigint) from r19
  union
  select e.instance, e.snap_ts, e.pid, max(p.level) + 1, min(p.top_blocker_pid),
    arg_max(e.blocker, struct_pack(l := p.level, n := -e.blocker))
  from e19 e join recurring.placed p on {_sc('p', 'e')} and p.pid = e.blocker
  where not exists (select 1 from recurring.placed q where {_sc('q', 'e')} and q.pid = e.pid)
  group by e.instance, e.snap_ts, e.pid having count(*) = max(e.n)),
down({_S}, a, v) as (
  select {_S}, parent, pid from placed where parent is not null
  union
  select d.instance, d.snap_ts, d.a, c.pid from down d join placed c on {_sc('c', 'd')} and c.parent = d.v),
below as (select {_S}, a as pid, count(distinct v) as n from down group by all),
direct as (select {_S}, blocker as pid, count(distinct pid) as n from e19 group by instance, snap_ts, blocker)""").replace(
    "with ", "with recursive ", 1) + f"""
select s.instance, s.snap_ts, s.pid, s.blocked_by,
  case when s.wait_event_type <> 'Lock' then replace(s.state, 'idle in transaction', 'idletx') else 'waiting' end
    as state,
  s.wait_event_type || ':' || s.wait_event as wait,
  {secs('s.snap_ts', 's.state_change')} as wait_age_s,
  {_round_s('s.snap_ts', 's.xact_start')} as tx_age_s,
  format('{{:,}}', s.next_xid - s.backend_xid) as xid_age,
  format('{{:,}}', 2147483647 - (s.next_xid - s.backend_xmin)) as xmin_ttf,
  s.datname, s.usename, coalesce(d.n, 0) as direct_waiters, coalesce(k.n, 0) as placed_below,
  lpad('[' || cast(s.pid as varchar) || ']', 9, ' ') || ' '
    || coalesce(repeat('.', p.level - 1) || case when p.level > 1 then ' ' end, '')
    || coalesce(left(s.query, 1000), '') as query,
  p.level, p.top_blocker_pid, p.parent
from placed p
join sess s on {_sc('s', 'p')} and s.pid = p.pid
left join below k on {_sc('k', 'p')} and k.pid = p.pid
left join direct d on {_sc('d', 'p')} and d.pid = p.pid
"""

SQL = {
    "lock_tree": LOCK_TREE,
    "lock_tree_asof": LOCK_TREE_ASOF,
    "lock_tree_all_blockers": LOCK_TREE_ALL_BLOCKERS,
}
