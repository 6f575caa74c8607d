"""Oracle SQL for the object reports."""

from fleetscope.oracle.common import pct, pretty, secs, with_tables
from fleetscope.oracle.values import KINDS

_kinds = ", ".join(f"('{k}', '{v}')" for k, v in KINDS)

SCHEMA_SIZE = with_tables("relations", "databases", extra="""
s as (select instance, snap_ts, datname, nspname as sch_name, sum(size_bytes) as sch_bytes
      from relations group by all)""") + f"""
select s.instance, s.snap_ts, s.datname, sch_name, cast(sch_bytes as bigint) as sch_bytes,
  {pretty('sch_bytes')} as sch_size, {pct('sch_bytes', 'd.size_bytes', 2)} as sch_ratio,
  {pretty('d.size_bytes')} as db_size
from s left join databases d on d.instance = s.instance and d.snap_ts = s.snap_ts and d.datname = s.datname
"""

OBJECT_COUNTS = with_tables("relations", "tablespaces", "databases", extra=f"""
g as (
  select r.instance, r.snap_ts, r.datname, relowner as obj_owner, nspname as obj_schema,
    case when r.tablespace_oid <> 0 then (select spcname from tablespaces t where t.oid = r.tablespace_oid
           and t.instance = r.instance and t.snap_ts = r.snap_ts)
         else (select t.spcname from databases d join tablespaces t on d.tablespace_oid = t.oid
               and d.instance = t.instance and d.snap_ts = t.snap_ts
               where d.instance = r.instance and d.snap_ts = r.snap_ts and d.datname = r.datname) end as obj_tbs,
    coalesce(k.label, relkind) as obj_type, count(*) as obj_count
  from relations r left join (values {_kinds}) k(kind, label) on k.kind = r.relkind
  group by all),
t as (select instance, snap_ts, datname, sum(obj_count) as obj_total from g group by all)""") + f"""
select g.instance, g.snap_ts, g.datname, obj_owner, obj_schema, obj_tbs, obj_type, obj_count,
  {pct('obj_count', 'obj_total', 2)} as obj_ratio, cast(obj_total as bigint) as obj_total
from g join t on g.instance = t.instance and g.snap_ts = t.snap_ts and g.datname = t.datname
"""

# Each level is its own aggregation, joined to the one above.
SIZE_ROLLUP = with_tables("relations", extra=f"""
r as (select instance, snap_ts, datname, nspname as schema, coalesce(k.label, relkind) as kind, size_bytes
      from relations left join (values {_kinds}) k(kind, label) on k.kind = relkind),
s1 as (select instance, snap_ts, count(*) as objects, sum(size_bytes) as bytes from r group by all),
s2 as (select instance, snap_ts, datname, count(*) as objects, sum(size_bytes) as bytes from r group by all),
s3 as (select instance, snap_ts, datname, schema, count(*) as objects, sum(size_bytes) as bytes from r group by all),
s4 as (select instance, snap_ts, datname, schema, kind, count(*) as objects, sum(size_bytes) as bytes from r group by all),
rows_ as (
  select instance, snap_ts, null as datname, null as schema, null as kind, 'server' as level, objects, bytes, bytes as whole from s1
  union all select a.instance, a.snap_ts, a.datname, null, null, 'database', a.objects, a.bytes, b.bytes from s2 a join s1 b using (instance, snap_ts)
  union all select a.instance, a.snap_ts, a.datname, a.schema, null, 'schema', a.objects, a.bytes, b.bytes
    from s3 a join s2 b using (instance, snap_ts, datname)
  union all select a.instance, a.snap_ts, a.datname, a.schema, a.kind, 'kind', a.objects, a.bytes, b.bytes
    from s4 a join s3 b using (instance, snap_ts, datname, schema))""") + f"""
select instance, snap_ts, datname, schema, kind, level, objects, cast(bytes as bigint) as bytes, {pretty('bytes')} as size,
  {pct('bytes', 'whole', 2)} as pct_of_above from rows_
"""

STATS_AGE = with_tables("databases") + f"""
select instance, snap_ts, snap_ts as check_date, datname, coalesce(stats_reset, start_time) as stats_or_start_time,
  {secs('snap_ts', 'coalesce(stats_reset, start_time)')} as age_since_reset_or_start_s
from databases
"""

_UNUSED = """
  from index_stats s join indexes i on i.indexrelid = s.indexrelid and i.instance = s.instance
    and i.snap_ts = s.snap_ts and i.datname = s.datname
  where s.idx_scan = 0 and not i.indisunique"""

UNUSED_INDEXES = with_tables("index_stats", "indexes") + f"""
select s.instance, s.snap_ts, s.datname, s.schemaname, s.relname as table_name, i.idxname as index_name, s.idx_scan,
  i.indisunique, i.size_bytes as index_bytes, {pretty('i.size_bytes')} as index_size
{_UNUSED}
"""

UNUSED_INDEXES_TOTAL = with_tables("index_stats", "indexes", extra=f"""
u as (select s.instance, s.snap_ts, s.datname, sum(i.size_bytes) as b {_UNUSED} group by all),
sc as (select distinct instance, snap_ts, datname from index_stats)""") + f"""
select sc.instance, sc.snap_ts, sc.datname, cast(coalesce(b, 0) as bigint) as total_unused_idx_bytes,
  coalesce({pretty('b')}, '0 bytes') as total_unused_idx_size
from sc left join u on sc.instance = u.instance and sc.snap_ts = u.snap_ts and sc.datname = u.datname
"""

SQL = {
    "size_rollup": SIZE_ROLLUP,
    "schema_size": SCHEMA_SIZE,
    "object_counts": OBJECT_COUNTS,
    "stats_age": STATS_AGE,
    "unused_indexes": UNUSED_INDEXES,
    "unused_indexes_total": UNUSED_INDEXES_TOTAL,
}
