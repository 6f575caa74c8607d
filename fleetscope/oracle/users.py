"""Oracle SQL for the users and permissions reports."""

from fleetscope.oracle.common import with_tables
from fleetscope.oracle.values import PRIVILEGES, PUBLIC

_letters = ", ".join(f"('{k}', '{v}')" for k, v in PRIVILEGES)

ROLE_LIST = with_tables("roles", "auth_members") + """
select r.instance, r.snap_ts, r.rolname as username,
  case when len(list_filter(l, lambda x: x is not null)) > 0
       then array_to_string(list_filter(l, lambda x: x is not null), chr(10)) end as attributes,
  coalesce((select string_agg(m.rolname, chr(10) order by m.rolname)
            from auth_members am join roles m on m.oid = am.roleid and m.instance = am.instance
              and m.snap_ts = am.snap_ts
            where am.member = r.oid and am.instance = r.instance and am.snap_ts = r.snap_ts), 'none') as member_of,
  coalesce(case when len(rolconfig) > 0 then array_to_string(rolconfig, chr(10)) end, 'none') as settings
from (select *, [
    case when not rolcanlogin then 'no login' end,
    case when not rolinherit then 'no inheritance' end,
    case when rolsuper then 'superuser' end,
    case when rolcreaterole then 'create role' end,
    case when rolcreatedb then 'create db' end,
    case when rolreplication then 'replication' end,
    case when rolbypassrls then 'bypass rls' end,
    case when rolconnlimit >= 0 then 'connection limit: ' || cast(rolconnlimit as varchar) end,
    case when rolvaliduntil is not null then 'valid until: ' || cast(cast(rolvaliduntil as date) as varchar) end
  ] as l from roles) r
"""

_GRANTS = f"""
select instance, snap_ts, schema_name, owner,
  case when grantee = '' then '{PUBLIC}' else grantee end as role_name,
  lt.name as privilege, p like '%*' as is_grantable, grantor
from (
  select instance, snap_ts, schema_name, owner, grantee, grantor,
         unnest(regexp_extract_all(privs, '([A-Za-z]\\*?)', 1)) as p
  from (
    select instance, snap_ts, object_name as schema_name, owner,
      regexp_extract(item, '^([^=]*)=', 1) as grantee,
      regexp_extract(item, '/(.*)$', 1) as grantor,
      regexp_extract(item, '=([^/]*)/', 1) as privs
    from (select instance, snap_ts, object_name, owner, unnest(acl) as item from acls) a) b) c
left join (values {_letters}) lt(letter, name) on lt.letter = substr(p, 1, 1)
"""

ACL_GRANTS = with_tables("acls") + _GRANTS

DATABASE_ACCESS = with_tables("databases") + """
select instance, snap_ts, datname as database, array_to_string(acl, chr(10)) as access from databases
"""

EFFECTIVE_PRIVILEGES = with_tables("object_acls", "role_tree", "memberships", extra="""
acls as (select * from object_acls),
grants as (
  select distinct instance, snap_ts, schema_name as object_name, role_name as granted, privilege, is_grantable
  from (""" + _GRANTS + """) x),
e as (
  select distinct m.instance, m.snap_ts, a.rolname as member, b.rolname as granted
  from memberships m
  join role_tree a on a.instance = m.instance and a.snap_ts = m.snap_ts and a.oid = m.member and a.rolinherit
  join role_tree b on b.instance = m.instance and b.snap_ts = m.snap_ts and b.oid = m.roleid
  where a.rolname <> b.rolname),
clo(instance, snap_ts, member, granted, depth, path) using key (instance, snap_ts, member, granted) as (
  select instance, snap_ts, member, granted, 1, [member, granted] from e
  union
  select c.instance, c.snap_ts, e.member, c.granted, min(c.depth) + 1, min(list_prepend(e.member, c.path))
  from clo c join e on e.instance = c.instance and e.snap_ts = c.snap_ts and e.granted = c.member
  where e.member <> c.granted and not exists (
    select 1 from recurring.clo q where q.instance = c.instance and q.snap_ts = c.snap_ts and q.member = e.member and q.granted = c.granted)
  group by c.instance, c.snap_ts, e.member, c.granted),
reach as (
  select * from clo
  union all select distinct instance, snap_ts, granted, granted, 0, [granted] from grants)""").replace("with ", "with recursive ", 1) + """
select g.instance, g.snap_ts, r.member as role_name, g.object_name, g.privilege, bool_or(g.is_grantable) as is_grantable,
  count(distinct g.granted) as grants, min(r.depth) as depth,
  array_to_string(arg_min(r.path, struct_pack(d := r.depth, p := r.path)), ' > ') as grant_path
from grants g join reach r on r.instance = g.instance and r.snap_ts = g.snap_ts and r.granted = g.granted
group by g.instance, g.snap_ts, r.member, g.object_name, g.privilege
"""

SQL = {
    "effective_privileges": EFFECTIVE_PRIVILEGES,
    "role_list": ROLE_LIST,
    "acl_grants": ACL_GRANTS,
    "database_access": DATABASE_ACCESS,
}
