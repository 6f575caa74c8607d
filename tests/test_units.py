"""Unit rows for each NULL, zero and edge rule of the reports."""

import datetime as dt
import glob
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fleetscope.functions.exprs import lsn_to_pos, pct, pretty_bytes, quote_ident, round_div
from fleetscope.operators import lock_graph as g
from fleetscope.plans import activity, bloat, instance, lock_trees, progress, users
from fleetscope.sources.readers import snapshot_frame
from fleetscope.workspace import Workspace

T0 = dt.datetime(2024, 1, 31)
SC = {"instance": "i0", "snap_ts": T0}


def pg_size_pretty(n: int) -> str:
    """The size rule restated on plain integers (brute force reference)."""
    if abs(n) < 10240:
        return f"{n} bytes"
    sign = -1 if n < 0 else 1
    halves = abs(n) // 512
    for unit in ["kB", "MB", "GB", "TB"]:
        if halves < 20479:
            return f"{sign * ((halves + 1) // 2)} {unit}"
        halves //= 1024
    return f"{sign * ((halves + 1) // 2)} PB"


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_pretty_bytes_matches_rule(spark):
    vals = [0, 1, 10239, 10240, 10241, 10485247, 10485248, 20479 * 512, 20479 * 512 - 1, 123456789,
            10 * 2 ** 30, 20479 * 2 ** 29, 20479 * 2 ** 39, 2 ** 50 * 30, -10240, -123456789, 2 ** 62]
    vals += [int(1.7 ** k) for k in range(80)]
    df = spark.createDataFrame([(v,) for v in vals], "n bigint").select("n", pretty_bytes("n").alias("p"))
    for r in df.collect():
        assert r["p"] == pg_size_pretty(r["n"]), r["n"]


def test_round_div_ties_and_zero(spark):
    assert one(spark, pct(F.lit(1), F.lit(8), 2)) == 12.5
    assert one(spark, pct(F.lit(1), F.lit(3), 2)) == 33.33
    assert one(spark, pct(F.lit(2), F.lit(3), 2)) == 66.67
    assert one(spark, pct(F.lit(1), F.lit(4000), 2)) == 0.03  # 0.025 rounds away from zero
    assert one(spark, round_div(F.lit(5), F.lit(2), 0)) == 3.0
    assert one(spark, round_div(F.lit(-5), F.lit(2), 0, signed=True)) == -3.0
    assert one(spark, pct(F.lit(1), F.lit(0), 2)) is None


def test_lsn_and_identifiers(spark):
    assert int(one(spark, lsn_to_pos(F.lit("16/B374D848")))) == 97500059720
    assert one(spark, quote_ident(F.lit("db_other"))) == "db_other"
    assert one(spark, quote_ident(F.lit("My DB"))) == '"My DB"'


def _session(pid, state, **kw):
    base = dict(SC, pid=pid, state=state, usename="u", datname="d", backend_type="client backend",
                is_collector=False, query="select\n  1", next_xid=1000,
                state_change=T0 - dt.timedelta(seconds=pid), query_start=T0 - dt.timedelta(seconds=2 * pid),
                xact_start=T0 - dt.timedelta(seconds=3 * pid), backend_start=T0 - dt.timedelta(hours=1))
    base.update(kw)
    return base


def test_null_state_rules(spark):
    act = snapshot_frame(spark, "activity", [
        _session(1, None), _session(2, "idle"), _session(3, "active"), _session(4, None, is_collector=True)])
    # `<>` drops NULL states; the collector's own session is never shown
    assert [r.pid for r in activity.active_sessions(act).collect()] == [3]
    by_state = {r.state: r.sess_count for r in activity.sessions_by_state(act).collect()}
    assert by_state == {None: 1, "idle": 1, "active": 1}
    status = activity.long_sessions(act).first()["query_status"]
    assert status == "in progress, duration: 6000 ms"
    assert activity.active_sessions(act).first()["short_query"] == "select 1"


def test_zero_totals(spark):
    dbs = snapshot_frame(spark, "databases", [dict(SC, datname="a", size_bytes=0), dict(SC, datname="b", size_bytes=0)])
    rows = {r.datname: r for r in instance.cluster_size(dbs).collect()}
    assert rows["a"].pct is None and rows["TOTAL"].pct == 100.0 and rows["TOTAL"].size == "0 bytes"
    bg = snapshot_frame(spark, "bgwriter", [dict(SC, stats_reset=T0, checkpoints_timed=0, checkpoints_req=0,
                                                 buffers_checkpoint=1, buffers_clean=1, buffers_backend=2,
                                                 buffers_backend_fsync=0, block_size=8192)])
    r = instance.write_stats(bg).first()
    assert r.checkpoint_timed is None and r.checkpoint_written == "25.00%" and r.size_per_s is None


def test_acl_null_and_public(spark):
    acls = snapshot_frame(spark, "acls", [dict(SC, object_name="s1", owner="o", acl=None),
                                          dict(SC, object_name="s2", owner="o", acl=["=U/o", "app=U*C/o"])])
    rows = sorted((r.schema_name, r.role_name, r.privilege, r.is_grantable)
                  for r in users.acl_grants(acls).collect())
    assert rows == [("s2", "-", "USAGE", False), ("s2", "app", "CREATE", False), ("s2", "app", "USAGE", True)]
    dbs = snapshot_frame(spark, "databases", [dict(SC, datname="x", acl=None), dict(SC, datname="y", acl=["=c/o", "a=C/o"])])
    got = {r.database: r.access for r in users.database_access(dbs).collect()}
    assert got == {"x": None, "y": "=c/o\na=C/o"}


def _lock(pid, rel, granted, mode="AccessExclusiveLock"):
    return dict(SC, pid=pid, locktype="relation", relation=rel, mode=mode, granted=granted, fastpath=False)


def test_lock_tree_chain_and_deadlock(spark):
    locks = snapshot_frame(spark, "locks", [
        # chain: 1 holds r3, 2 waits r3 and holds r4, 3 waits r4
        _lock(1, 3, True), _lock(2, 3, False), _lock(2, 4, True), _lock(3, 4, False),
        # cycle: 10 holds r1 and waits r2, 20 holds r2 and waits r1; 5 waits r1
        _lock(10, 1, True), _lock(10, 2, False), _lock(20, 2, True), _lock(20, 1, False), _lock(5, 1, False),
    ])
    act = snapshot_frame(spark, "lock_activity", [_session(p, "active") for p in (1, 2, 3, 5, 10, 20)])
    rows = {r.pid: r for r in lock_trees.lock_tree(locks, act).collect()}
    assert (rows[1].lvl, rows[2].lvl, rows[3].lvl) == (0, 1, 2)
    assert (rows[1].blocked, rows[2].blocked, rows[3].blocked) == (2, 1, 0)
    assert rows[3].path == "1.2.3" and not rows[3].deadlock
    assert rows[10].lvl == 0 and rows[10].deadlock and rows[10].blocked == 2
    assert rows[20].parent == 10 and rows[5].parent == 10 and rows[5].root == 10
    assert rows[20].query.startswith("!> ") and rows[20].deadlock_group == 10
    assert not rows[5].deadlock and rows[5].deadlock_group is None and rows[5].query.startswith(" . ")


def _waits(edges, free=()):
    """Locks where each (waiter, holder) pair meets on the holder's own target."""
    holders = {h for _, h in edges} | set(free)
    return [_lock(h, h, True) for h in holders] + [_lock(w, h, False) for w, h in edges]


def _groups(spark, graphs):
    """Groups of each server's graph, as one task finds them and as all tasks do."""
    run = Workspace(spark, "test-groups")
    rows = [dict(lock, instance=name) for name, edges in graphs.items() for lock in _waits(edges)]
    waits, holds = g.lock_graph(snapshot_frame(spark, "locks", rows), run)
    one, all_ = (sorted((r.instance, r.pid, r.deadlock_group) for r in g.deadlock_groups(waits, holds, run, local_rows=n).collect())
                 for n in (g.LOCAL_ROWS, 0))
    run.release()
    assert one == all_
    return {name: {pid: group for n, pid, group in one if n == name} for name in graphs}


def test_only_cycle_members_are_deadlocked(spark):
    # 1 and 2 wait on each other, 3 waits on 2, 4 on 3
    edges = [(1, 2), (2, 1), (3, 2), (4, 3)]
    act = snapshot_frame(spark, "lock_activity", [_session(p, "active") for p in range(1, 5)])
    rows = {r.pid: r for r in lock_trees.lock_tree(snapshot_frame(spark, "locks", _waits(edges)), act).collect()}
    assert {p: (r.deadlock, r.deadlock_group, r.lvl) for p, r in rows.items()} == {
        1: (True, 1, 0), 2: (True, 1, 1), 3: (False, None, 2), 4: (False, None, 3)}


def _plain_groups(edges):
    reach = {a: {b for x, b in edges if x == a} for a, _ in edges}
    for _ in reach:
        for a in reach:
            reach[a] |= set().union(*[reach.get(b, set()) for b in reach[a]])
    return {a: min(b for b in reach[a] if a in reach.get(b, ())) for a in reach if a in reach[a]}


def test_deadlock_groups(spark):
    order, rnd = list(range(1000)), random.Random(5)
    rnd.shuffle(order)
    ring = list(zip(order, order[1:] + order[:1], strict=True))
    graphs = {
        "linked": [(3, 4), (4, 3), (1, 2), (2, 1), (1, 3)],  # the second cycle waits on the first
        "shared": [(7, 8), (8, 7), (8, 5), (5, 8), (9, 5)],  # two cycles through 8 are one group
        "chain": [(1, 2), (2, 3)], "ring": ring}
    for k in range(30):
        edges = {(rnd.randrange(9), rnd.randrange(9)) for _ in range(rnd.randint(5, 20))}
        graphs[f"random{k}"] = sorted((a, b) for a, b in edges if a != b)
    got = _groups(spark, graphs)
    assert got["linked"] == {1: 1, 2: 1, 3: 3, 4: 3} and got["shared"] == {7: 5, 8: 5, 5: 5}
    assert got["chain"] == {} and got["ring"] == dict.fromkeys(order, 0)
    randoms = [n for n in graphs if n.startswith("random")]
    assert [got[n] for n in randoms] == [_plain_groups(graphs[n]) for n in randoms] and sum(map(bool, (got[n] for n in randoms))) > 5


def test_parts_of_a_large_scope_are_solved_apart(spark, monkeypatch):
    # one server: 60 separate rings of two to four sessions with a waiter each, and the chain 9000 -> 9001 -> ...
    rings = [[10 * k + i for i in range(2 + k % 3)] for k in range(60)]
    edges = [(r[i], r[(i + 1) % len(r)]) for r in rings for i in range(len(r))] + [(10 * k + 9, 10 * k) for k in range(60)]
    edges += [(p, p + 1) for p in range(9000, 9020)]
    run = Workspace(spark, "test-parts")
    waits, holds = g.lock_graph(snapshot_frame(spark, "locks", _waits(edges)), run)
    want = {p: r[0] for r in rings for p in r}
    for rows in (4, 40):  # rings of three and four go over all tasks, or all rings to a few tasks
        if rows == 40:
            monkeypatch.setattr(g, "colour_groups", lambda *_: pytest.fail("a small part went over all tasks"))
        assert {r.pid: r.deadlock_group for r in g.deadlock_groups(waits, holds, run, local_rows=rows).collect()} == want
    run.release()


def test_cycle_below_a_free_root(spark):
    # 2 and 3 wait on each other, 3 on the free 9 too: the cycle hangs under 9 and keeps its mark
    act = snapshot_frame(spark, "lock_activity", [_session(p, "active") for p in (2, 3, 9)])
    rows = {r.pid: r for r in lock_trees.lock_tree(snapshot_frame(spark, "locks", _waits([(2, 3), (3, 2), (3, 9)])), act).collect()}
    assert {p: (r.root, r.lvl, r.deadlock) for p, r in rows.items()} == {9: (9, 0, False), 3: (9, 1, True), 2: (9, 2, True)}


def test_lock_tree_weaker_mode_of_holder_ignored(spark):
    # holder 1 has AccessShare and AccessExclusive on r1: only the strongest counts, still one edge
    locks = snapshot_frame(spark, "locks", [_lock(1, 1, True, "AccessShareLock"), _lock(1, 1, True),
                                            _lock(2, 1, False)])
    act = snapshot_frame(spark, "lock_activity", [_session(p, "active") for p in (1, 2)])
    rows = {r.pid: r.blocked for r in lock_trees.lock_tree(locks, act).collect()}
    assert rows == {1: 1, 2: 0}


def test_all_blockers_two_roots(spark):
    sess = snapshot_frame(spark, "lock_activity", [_session(p, "active") for p in (1, 2, 3, 4)]).withColumn(
        "blocked_by", F.when(F.col("pid") == 3, F.array(F.lit(1), F.lit(2)))
        .when(F.col("pid") == 4, F.array(F.lit(3))).otherwise(F.array().cast("array<bigint>")).cast("array<bigint>"))
    rows = {r.pid: r for r in lock_trees.lock_tree_all_blockers(sess).collect()}
    assert set(rows) == {1, 2, 3, 4}
    assert (rows[3].level, rows[3].top_blocker_pid, rows[3].parent) == (2, 1, 1)
    assert (rows[4].level, rows[4].top_blocker_pid) == (3, 1)
    assert (rows[1].direct_waiters, rows[2].direct_waiters, rows[3].direct_waiters, rows[4].direct_waiters) == (1, 1, 1, 0)
    assert (rows[1].placed_below, rows[2].placed_below, rows[3].placed_below) == (2, 0, 1)
    assert rows[4].query == "      [4] .. select\n  1"


def test_all_blockers_cycle_left_out(spark):
    sess = snapshot_frame(spark, "lock_activity", [_session(p, "active") for p in (1, 2, 3)]).withColumn(
        "blocked_by", F.when(F.col("pid") == 2, F.array(F.lit(3))).when(F.col("pid") == 3, F.array(F.lit(2)))
        .otherwise(F.array().cast("array<bigint>")).cast("array<bigint>"))
    assert lock_trees.lock_tree_all_blockers(sess).count() == 0



def test_all_blockers_rounds_write_what_changes(spark):
    # a chain of ten; 200 sessions wait on targets of their own that a placed session and one that is never placed hold
    locks = [lock for p in range(1, 10) for lock in (_lock(p, p, True), _lock(p + 1, p, False))]
    locks += [lock for p in range(100, 300) for lock in (_lock(p, p, False), _lock(50, p, True), _lock(99, p, True))]
    act = [_session(p, "active") for p in (*range(1, 11), 50, *range(100, 300))] + [_session(99, "idle")]
    run = Workspace(spark, "test-rounds")
    waits, holds = g.lock_graph(snapshot_frame(spark, "locks", locks), run)
    keys = snapshot_frame(spark, "lock_activity", act).where("state <> 'idle'").select(*g.PID)
    tree, depth = g.all_blockers_forest(waits, holds, keys, run)
    assert depth == 9 and {r.pid: (r.level, r.parent) for r in tree.collect()} == {50: (1, None), 1: (1, None)} | {p: (p, p - 1) for p in range(2, 11)}
    folder = run.path.removeprefix("file:")
    for k in (2, 3):
        for table in glob.glob(f"{folder}/*{k}"):
            assert sum(pq.read_metadata(f).num_rows for f in glob.glob(f"{table}/*.parquet")) <= 2, table
    run.release()


def test_all_blockers_waiter_that_holds_alone(spark):
    # 2 holds and waits on r1, which 1 holds too and nobody else waits on: 2 is placed below 1
    locks = snapshot_frame(spark, "locks", [_lock(1, 1, True), _lock(2, 1, True), _lock(2, 1, False)])
    act = snapshot_frame(spark, "lock_activity", [_session(p, "active") for p in (1, 2)])
    rows = {r.pid: (r.level, r.parent, r.blocked_by) for r in lock_trees.lock_tree_all_blockers(act, locks).collect()}
    assert rows == {1: (1, None, []), 2: (2, 1, [1])}


def _rel(oid, **kw):
    base = dict(SC, datname="db", oid=oid, relname=f"t{oid}", nspname="public", relowner="u", tablespace_oid=0,
                relkind="r", reltuples=1000.0, relpages=10, size_bytes=81920, total_size_bytes=81920)
    base.update(kw)
    return base


def test_index_width_floor_zero_and_missing_stats(spark):
    rels = snapshot_frame(spark, "relations", [_rel(1), _rel(2, reltuples=-1.0, relpages=1)])
    atts = snapshot_frame(spark, "attributes", [dict(SC, datname="db", attrelid=1, attnum=1, attname="a", typname="text",
                                                     attisdropped=False),
                                                dict(SC, datname="db", attrelid=2, attnum=1, attname="a", typname="int8",
                                                     attisdropped=False)])
    stats = snapshot_frame(spark, "column_stats", [dict(SC, datname="db", relid=1, attname="a", null_frac=0.0, avg_width=9000)])
    idx = snapshot_frame(spark, "indexes", [dict(SC, datname="db", indexrelid=100, idxname="ix", indrelid=1, amname="btree",
                                                 indisunique=False, indkey="1", reltuples=1000.0, relpages=20)])
    est = bloat.index_page_estimate(idx, rels, atts, stats).first()
    assert est.est_pages == 0 and est.est_pages_ff == 0  # key wider than a page: no estimate
    tbl = {r.tblid: r for r in bloat.table_page_estimate(rels, atts, stats).collect()}
    assert tbl[2].is_na  # no statistics for its column
    assert tbl[2].est_tblpages == 0  # reltuples -1 (never analysed): ceil of a small negative is 0
    sizes = {r.tblid: r for r in bloat._table_sizes(bloat.table_page_estimate(rels, atts, stats)).collect()}
    assert sizes[1].extra_bytes < 0 and sizes[1].extra_pct == 0.0  # negative extra kept, percent clipped


def test_progress_text_nulls(spark):
    prog = snapshot_frame(spark, "progress_index", [dict(SC, datname="db", pid=7, relid=1, index_relid=2, phase="building index: x",
                                                         blocks_done=None, blocks_total=None, tuples_done=1,
                                                         tuples_total=3)])
    act = snapshot_frame(spark, "lock_activity", [])
    rels = snapshot_frame(spark, "relations", [])
    ts = snapshot_frame(spark, "table_stats", [])
    r = progress.index_build_progress(prog, act, rels, ts).first()
    assert r.blocks_progress == "N/A (? of ?)" and r.tuples_progress == "33.33% (1 of 3)"
    assert r.phase_num == "3 of 10" and r.index_name == "2" and r.pid_and_query == "[] "


def test_ordered_gives_reference_order(spark):
    act = snapshot_frame(spark, "activity", [
        _session(1, "active", xact_start=None), _session(2, "active"), _session(3, "idle in transaction"),
        _session(4, "active")])
    # longest transaction first, NULL (no transaction) first as in the reference's DESC
    got = [r.pid for r in activity.active_sessions(act, ordered=True).collect()]
    assert got == [1, 4, 3, 2]
    counts = [(r.state, r.sess_count) for r in activity.sessions_by_state(act, ordered=True).collect()]
    assert counts == [("active", 3), ("idle in transaction", 1)]


def test_read_snapshot_pushes_scope_filter_and_keeps_lists(spark, tmp_path):
    from fleetscope.sources.readers import read_snapshot
    from fleetscope.sources.schemas import schema

    rows = [dict(instance=i, snap_ts=T0, datname=f"d{i}", acl=["=c/o", "a=C/o"]) for i in ("i0", "i1")]
    raw = spark.createDataFrame([tuple(r.get(f.name) for f in schema("databases").fields) for r in rows],
                                schema("databases"))
    raw.write.parquet(str(tmp_path / "databases"))
    df = read_snapshot(spark, str(tmp_path / "databases"), "databases", instances=["i1"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(instance, [i1])" in plan or "EqualTo(instance,i1)" in plan, plan
    got = df.select("datname", "acl").collect()
    assert [(r.datname, r.acl) for r in got] == [("di1", ["=c/o", "a=C/o"])]


def test_filters_and_columns_reach_the_scan(spark):
    from fleetscope import registry
    from tests.conftest import SF_SMALL

    spark.catalog.clearCache()  # other modules cache fixtures; inspect plans built from the files

    def scans(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return [line for line in plan.split("\n") if "FileScan parquet" in line]

    tables = registry.queries()["table_page_estimate"](spark, SF_SMALL)
    parts = [s for s in scans(tables) if "part.parquet" in s]
    assert parts and not any("p_name" in s or "p_retailprice" in s for s in parts), parts
    mix = registry.queries()["sessions_by_state"](spark, SF_SMALL)
    docs = [s for s in scans(mix) if "documents.parquet" in s]
    assert docs and all("ReadSchema: struct<doc_id:bigint>" in s for s in docs), docs


def test_vacuum_queue_malformed_option_does_not_fail(spark):
    rels = snapshot_frame(spark, "relations", [
        _rel(1, reloptions=["autovacuum_vacuum_threshold=1.2.3"], reltuples=10.0),
        _rel(2, reltuples=10.0)])
    stats = snapshot_frame(spark, "table_stats", [dict(SC, datname="db", relid=1, n_dead_tup=1000),
                                                   dict(SC, datname="db", relid=2, n_dead_tup=1000)])
    empty = {n: snapshot_frame(spark, n, []) for n in ("settings", "progress_vacuum", "lock_activity", "indexes")}
    rows = {r.relation: r for r in progress.vacuum_queue(stats, rels, empty["settings"], empty["progress_vacuum"],
                                                         empty["lock_activity"], empty["indexes"]).collect()}
    # t2 uses the default threshold 50 + 0.2 * 10 < 1000: queued; t1's threshold cannot be read: not queued
    assert set(rows) == {"t2"} and rows["t2"].status == progress.QUEUE_STATUS
    assert rows["t2"].effective_settings == "vt: 50, vsf: 0.2, enabled"


def _two_servers(**kw):
    return [dict(instance=i, snap_ts=T0, **kw) for i in ("i0", "i1")]


def test_tablespaces_belong_to_their_server(spark):
    from fleetscope.plans import objects

    dbs = snapshot_frame(spark, "databases", _two_servers(datname="db", tablespace_oid=1663, size_bytes=1, can_connect=True,
                                                          frozen_xid_age=0, freeze_max_age=1))
    spaces = snapshot_frame(spark, "tablespaces", _two_servers(oid=1663, spcname="pg_default"))
    assert instance.databases_overview(dbs, spaces).count() == 2
    rels = snapshot_frame(spark, "relations", [dict(r, tablespace_oid=0) for r in _two_servers(datname="db", oid=1, relkind="r")])
    assert [r.obj_count for r in objects.object_counts(rels, spaces, dbs).collect()] == [1, 1]


def test_databases_that_share_oids_keep_their_own_columns(spark):
    rels = snapshot_frame(spark, "relations", [_rel(1, datname=d, reltuples=10000.0) for d in ("a", "b")])
    atts = snapshot_frame(spark, "attributes", [dict(SC, datname=d, attrelid=1, attnum=1, attname="x", typname="int8",
                                                     attisdropped=False) for d in ("a", "b")])
    stats = snapshot_frame(spark, "column_stats", [dict(SC, datname=d, relid=1, attname="x", null_frac=0.0, avg_width=w)
                                                   for d, w in (("a", 8), ("b", 800))])
    both = {r.datname: r.est_tblpages for r in bloat.table_page_estimate(rels, atts, stats).collect()}
    for d in ("a", "b"):
        where = F.col("datname") == d
        alone = bloat.table_page_estimate(rels.where(where), atts.where(where), stats.where(where)).first()
        assert both[d] == alone.est_tblpages
    assert both["a"] < both["b"]


def test_relation_locks_use_the_locks_database(spark):
    rels = snapshot_frame(spark, "relations", [_rel(5, datname="a", datoid=10), _rel(5, datname="b", datoid=20, relname="other")])
    locks = snapshot_frame(spark, "locks", [dict(_lock(1, 5, True), database=20)])
    act = snapshot_frame(spark, "lock_activity", [_session(1, "active")])
    assert [r.relation for r in activity.relation_locks(act, locks, rels).collect()] == ["other"]


def test_role_settings_with_commas_stay_whole(spark):
    roles = snapshot_frame(spark, "roles", [dict(SC, oid=1, rolname="r", rolcanlogin=True, rolinherit=True,
                                                 rolconfig=["search_path=app, public"])])
    assert users.role_list(roles, snapshot_frame(spark, "auth_members", [])).first().settings == "search_path=app, public"


def test_odd_temporary_file_name_keeps_its_row(spark):
    files = snapshot_frame(spark, "tempfiles", [dict(SC, tablespace="t", name=n, size=1) for n in ("pgsql_tmp7.1", "odd", "pgsql_tmpx.2")])
    rows = activity.sessions_by_temp(files, snapshot_frame(spark, "activity", [])).collect()
    assert sorted((r.pid or 0, r.tmp_files) for r in rows) == [(0, 2), (7, 1)]


def test_one_line_reads_only_what_it_prints(spark):
    from fleetscope.functions.exprs import one_line

    texts = ["", "  ", "a\n\n b", "x" * 100, " \t\r\n" * 50 + "end", "a" + " " * 100 + "b" * 100, "é  ü" * 30]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    for width in (1, 5, 40):
        whole = F.substring(F.regexp_replace("t", r"\s+", " "), 1, width)
        assert df.where(~one_line("t", width).eqNullSafe(whole)).count() == 0


def test_lsn_round_trip(spark):
    from fleetscope.functions.exprs import pos_to_lsn
    from fleetscope.sources.readers import with_positions

    df = spark.createDataFrame([("16/B374D848",), ("0/0",), ("7FFFFFFF/FFFFFFFF",), (None,)], "restart_lsn string")
    got = with_positions(df).select(pos_to_lsn("restart_pos").alias("t")).collect()
    assert [r.t for r in got] == ["16/B374D848", "0/0", "7FFFFFFF/FFFFFFFF", None]


def test_hot_lock_target_writes_no_pairs(spark):
    import glob

    import pyarrow.parquet as pq

    n = 5000
    rows = [(p, p <= n) for p in range(1, 2 * n + 1)]
    locks = spark.createDataFrame(rows, "pid bigint, granted boolean").selectExpr(
        "'i0' as instance", "timestamp '2024-01-31' as snap_ts", "pid", "'relation' as locktype", "1L as database", "7L as relation",
        "cast(null as bigint) as page", "cast(null as bigint) as tuple", "cast(null as string) as virtualxid",
        "cast(null as bigint) as transactionid", "cast(null as bigint) as classid", "cast(null as bigint) as objid",
        "cast(null as bigint) as objsubid", "'ShareLock' as mode", "granted", "false as fastpath")
    from fleetscope.operators import lock_graph as g
    from fleetscope.workspace import Workspace

    run = Workspace(spark, "hot")
    waits, holds = g.lock_graph(locks, run)
    tree, depth = g.wait_forest(waits, holds, run)
    sizes = {r.pid: r.size for r in g.subtree_sizes(tree, depth, run).collect()}
    assert len(sizes) == 2 * n and sizes[1] == n
    placed, _ = g.all_blockers_forest(waits, holds, locks.select("instance", "snap_ts", "pid"), run)
    assert placed.count() == 2 * n
    assert {r.direct_waiters for r in g.direct_waiters(waits, holds).collect()} == {n}
    folder = run.path.removeprefix("file:")
    for table in glob.glob(f"{folder}/*"):
        assert sum(pq.read_metadata(f).num_rows for f in glob.glob(f"{table}/*.parquet")) <= 2 * n, table
    run.release()


def test_long_wait_cycle(spark):
    n = 20
    locks = snapshot_frame(spark, "locks", [_lock(p, p, True) for p in range(n)] + [_lock(p, (p + 1) % n, False) for p in range(n)])
    act = snapshot_frame(spark, "lock_activity", [_session(p, "active") for p in range(n)])
    rows = {r.pid: r for r in lock_trees.lock_tree(locks, act).collect()}
    assert rows[0].lvl == 0 and rows[0].blocked == n - 1 and rows[1].lvl == n - 1 and all(r.deadlock for r in rows.values())


def test_fixture_reaches_the_hard_branches(spark):
    from fleetscope import registry
    from tests.conftest import SF_SMALL

    tree = registry.queries()["lock_tree"](spark, SF_SMALL)
    assert tree.where("deadlock").count() > 0 and tree.agg(F.max("lvl")).first()[0] >= 2
    heavy = registry.queries()["lock_tree_all_blockers"](spark, SF_SMALL)
    assert heavy.agg(F.max("level")).first()[0] >= 3 and heavy.where("size(blocked_by) > 1").count() > 0
    found = {r.diagnosis for r in registry.queries()["replication_diagnosis"](spark, "/root/testdata/sf0.01").collect()}
    assert found == {"n/a", "ok", "long-running transaction", "consumer cannot keep up"}


def test_what_a_task_can_solve_is_not_contracted(spark, monkeypatch):
    # a server of 800 lock rows: after trimming, two rings are left, which one task solves without looking for parts
    edges = [(1, 2), (2, 1), (3, 4), (4, 5), (5, 3)] + [(p, p + 1) for p in range(100, 500, 2)]
    run = Workspace(spark, "test-trimmed")
    waits, holds = g.lock_graph(snapshot_frame(spark, "locks", _waits(edges)), run)
    monkeypatch.setattr(g, "connected_parts", lambda *_: pytest.fail("parts of a graph that fits one task"))
    assert {r.pid: r.deadlock_group for r in g.deadlock_groups(waits, holds, run, local_rows=40).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3}
    run.release()


def test_levels_pass_on_only_what_waits(spark):
    # ten sessions in a row, and 100 that wait on the first: after level 1 the waits of 8 sessions are left, and sizes need no rounds
    locks = _waits([(p + 1, p) for p in range(1, 10)] + [(p, 1) for p in range(100, 200)])
    run = Workspace(spark, "test-levels")
    tree, depth = g.wait_forest(*g.lock_graph(snapshot_frame(spark, "locks", locks), run), run)
    sizes = {r.pid: r.size for r in g.subtree_sizes(tree, depth, run).collect()}
    assert depth == 9 and (sizes[1], sizes[2], sizes[10], sizes[100]) == (109, 8, 0, 0)
    tables = {t.rsplit("/", 1)[1]: sum(pq.read_metadata(f).num_rows for f in glob.glob(f"{t}/*.parquet")) for t in glob.glob(f"{run.path.removeprefix('file:')}/*")}
    assert [tables[f"treewaits{k}"] for k in (1, 2, 8)] == [8, 7, 1] and not any(t.startswith("sizes") for t in tables if t != "sizes-whole")
    run.release()


def test_target_text_tells_targets_apart(spark):
    rows = [dict(_lock(1, None, True), **kw) for kw in (
        {}, {"locktype": None}, {"locktype": ""}, {"locktype": "relationb1"}, {"database": 1}, {"database": 11}, {"database": 1, "relation": 1},
        {"relation": 11}, {"relation": -1}, {"page": 1}, {"virtualxid": "1"}, {"virtualxid": ""}, {"transactionid": 1}, {"virtualxid": "1g1"},
        {"virtualxid": "1", "transactionid": 1}, {"objid": 1}, {"objsubid": 1}, {"classid": 1})]
    locks = snapshot_frame(spark, "locks", rows)
    assert locks.select(g.target_text()).distinct().count() == locks.select(g.lock_target()).distinct().count() == len(rows)
