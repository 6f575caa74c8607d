"""Counter intervals, as-of pairing, interval overlap and role closure on unit
rows: resets, late views, touching spans, cycles."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetscope.operators.asof import align, pair_snapshots
from fleetscope.operators.closure import shortest_paths
from fleetscope.operators.counters import counter_deltas
from fleetscope.operators.overlap import overlap_join
from fleetscope.plans import intervals, lock_trees, users
from fleetscope.sources.readers import snapshot_frame
from fleetscope.workspace import Workspace

T0 = dt.datetime(2024, 1, 31)


def at(minutes=0, seconds=0):
    return T0 + dt.timedelta(minutes=minutes, seconds=seconds)


# --- counters -------------------------------------------------------------------

def deltas(spark, rows, reset="r"):
    frame = spark.createDataFrame(rows, "instance string, k long, snap_ts timestamp, r timestamp, c long, d long")
    got = counter_deltas(frame, ["instance", "k"], ["c", "d"], reset=reset).collect()
    return {(r.instance, r.k, r.snap_ts): (r.from_ts, r.restarted, r.c, r.d) for r in got}


def test_counters_between_snapshots(spark):
    rows = [("a", 1, at(0), None, 10, 5), ("a", 1, at(1), None, 15, 5), ("a", 1, at(5), None, 15, 9)]
    assert deltas(spark, rows) == {("a", 1, at(1)): (at(0), False, 5, 0), ("a", 1, at(5)): (at(1), False, 0, 4)}


def test_a_reset_never_gives_a_negative(spark):
    rows = [("a", 1, at(0), at(-9), 10, 5), ("a", 1, at(1), at(-9), 3, 8),  # one counter fell
            ("a", 1, at(2), at(1, 30), 7, 9),  # the reset moved, though both counters rose
            ("a", 1, at(3), None, 8, 10), ("a", 1, at(4), None, 9, 10)]  # the reset time went away, then stays unknown
    assert deltas(spark, rows) == {
        ("a", 1, at(1)): (at(0), True, 3, 8), ("a", 1, at(2)): (at(1), True, 7, 9), ("a", 1, at(3)): (at(2), True, 8, 10),
        ("a", 1, at(4)): (at(3), False, 1, 0)}


def test_missing_new_and_null_entries(spark):
    rows = [("a", 1, at(0), None, 10, None), ("a", 2, at(0), None, 1, 1), ("a", 1, at(1), None, 20, None),
            ("a", 2, at(2), None, 4, 4), ("a", 1, at(2), None, 30, 7),  # 2 was evicted at 1 and came back
            ("a", 3, at(2), None, 6, 6), ("b", 1, at(2), None, 99, 99)]  # 3 is new, b has one snapshot only
    assert deltas(spark, rows, reset=None) == {
        ("a", 1, at(1)): (at(0), False, 10, None), ("a", 1, at(2)): (at(1), False, 10, None),
        ("a", 2, at(2)): (at(1), True, 4, 4), ("a", 3, at(2)): (at(1), True, 6, 6)}


def test_write_intervals_per_second(spark):
    base = dict(instance="a", block_size=8192, checkpoints_timed=0, checkpoints_req=0, buffers_clean=0, buffers_backend=0,
                buffers_backend_fsync=0, stats_reset=at(-60))
    rows = [dict(base, snap_ts=at(0), buffers_checkpoint=100), dict(base, snap_ts=at(0, 7), buffers_checkpoint=110, checkpoints_req=1)]
    got = intervals.write_intervals(snapshot_frame(spark, "bgwriter", rows)).collect()
    assert [(r.seconds, r.buffers_checkpoint, r.bytes_per_s, r.checkpoint_req_pct, r.backends_written_pct) for r in got] == [
        (7.0, 10, 10 * 8192 // 7, 100.0, 0.0)]


def test_a_server_of_its_own_joins_nothing(spark):
    rows = [("a", at(0), 1), ("a", at(1), 4), ("a", at(1), 4), ("a", at(3), 9), ("a", None, 7), (None, at(0), 1), (None, at(1), 2), ("b", at(1), 5)]
    frame = spark.createDataFrame(rows, "instance string, snap_ts timestamp, c long")
    found = counter_deltas(frame, ["instance"], ["c"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan  # a lookup copied 32 times was broadcast
    # of a snapshot that came twice, the second row follows the first and not the snapshot before
    assert sorted((r.instance, r.snap_ts, r.from_ts, r.restarted, r.c) for r in found.collect()) == [
        ("a", at(1), at(0), False, 3), ("a", at(1), at(0), True, 4), ("a", at(3), at(1), False, 5)]


# --- as-of pairing ----------------------------------------------------------------

def snaps(spark, rows):
    return spark.createDataFrame(rows, "instance string, snap_ts timestamp, pid long")


def pairs(spark, left, right, **how):
    found = pair_snapshots(snaps(spark, [(i, t, 0) for i, t in left]), snaps(spark, [(i, t, 0) for i, t in right]), **how)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    return {(r.instance, r.snap_ts): r.partner_ts for r in found.collect()}


def test_last_snapshot_within_the_tolerance(spark):
    left = [("a", at(10)), ("a", at(20)), ("b", at(10)), ("c", at(10)), ("d", at(10))]
    right = [("a", at(9, 30)), ("a", at(9, 59)), ("a", at(18)), ("b", at(10)), ("c", at(10, 1))]
    assert pairs(spark, left, right, tolerance_s=60) == {("a", at(10)): at(9, 59), ("b", at(10)): at(10)}
    assert pairs(spark, left, right, tolerance_s=120) == {("a", at(10)): at(9, 59), ("a", at(20)): at(18), ("b", at(10)): at(10)}


def test_nearest_snapshot(spark):
    left = [("a", at(10)), ("b", at(10)), ("c", at(10)), ("d", at(10))]
    right = [("a", at(9, 50)), ("a", at(10, 5)), ("b", at(9, 50)), ("b", at(10, 10)), ("c", at(10, 3)), ("d", at(12))]
    assert pairs(spark, left, right, tolerance_s=60, nearest=True) == {
        ("a", at(10)): at(10, 5), ("b", at(10)): at(9, 50), ("c", at(10)): at(10, 3)}


def test_pairing_of_random_times(spark):
    rnd = random.Random(4)
    left, right = ([(rnd.choice("ab"), at(0, rnd.randrange(5000))) for _ in range(300)] for _ in range(2))
    want = {}
    for i, t in set(left):
        before = [u for j, u in right if j == i and u <= t and (t - u).total_seconds() <= 20]
        if before:
            want[i, t] = max(before)
    assert pairs(spark, left, right, tolerance_s=20) == want


def test_rows_serve_every_partner(spark):
    view = snaps(spark, [("a", at(9, 59), 1), ("a", at(9, 59), 2), ("a", at(3), 3)])
    paired = pair_snapshots(snaps(spark, [("a", at(10), 0), ("a", at(10, 30), 0)]), view, tolerance_s=60)
    got = sorted((r.snap_ts, r.pid, r.collected_ts) for r in align(view, paired).collect())
    assert got == [(at(10), 1, at(9, 59)), (at(10), 2, at(9, 59)), (at(10, 30), 1, at(9, 59)), (at(10, 30), 2, at(9, 59))]


def test_lock_tree_on_late_sessions(spark):
    lock = dict(instance="i0", snap_ts=at(10), locktype="relation", mode="AccessExclusiveLock", fastpath=False, relation=1)
    locks = snapshot_frame(spark, "locks", [dict(lock, pid=1, granted=True), dict(lock, pid=2, granted=False)])
    act = snapshot_frame(spark, "lock_activity", [
        dict(instance="i0", snap_ts=at(9, 58), pid=p, state="active", xact_start=at(9), state_change=at(9), query="q") for p in (1, 2)])
    rows = lock_trees.lock_tree(locks, align(act, pair_snapshots(locks, act, tolerance_s=5))).collect()
    assert {(r.pid, r.lvl, r.snap_ts, r.ts_age_s) for r in rows} == {(1, 0, at(10), 60), (2, 1, at(10), 60)}
    assert lock_trees.lock_tree(locks, align(act, pair_snapshots(locks, act, tolerance_s=1))).count() == 0


# --- overlap ----------------------------------------------------------------------

@pytest.mark.parametrize("salts", [1, 4])
def test_overlaps_come_once(spark, salts):
    rnd = random.Random(6)

    def spans(n, longest):
        starts = [(rnd.choice(["hot", "hot", "x"]), rnd.randrange(40_000)) for _ in range(n)]
        return [(k, i, at(0, s), at(0, s + rnd.choice([0, 1, 3600, rnd.randrange(longest)]))) for i, (k, s) in enumerate(starts)]

    left, right = spans(120, 20_000), spans(120, 9_000) + [("hot", 999, None, at(9)), ("x", 998, at(5), at(4)), ("hot", 997, at(0, 3600), at(0, 7200))]
    got = overlap_join(spark.createDataFrame(left, "k string, i long, a timestamp, b timestamp"),
                       spark.createDataFrame(right, "k string, j long, c timestamp, d timestamp"), ["k"], ("a", "b"), ("c", "d"), salts=salts)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    rows = [(r.i, r.j, r.overlap_us) for r in got.collect()]
    want = [(i, j, int((min(b, d) - max(a, c)).total_seconds()) * 1_000_000) for k, i, a, b in left for m, j, c, d in right
            if k == m and c is not None and max(a, c) < min(b, d)]
    assert len(rows) == len(set(rows)) and set(rows) == set(want) and len(want) > 500


def test_pairs_of_a_hot_group_are_dealt_to_tasks(spark, monkeypatch):
    from fleetscope.operators import overlap

    monkeypatch.setattr(overlap, "PART_ROWS", 25, raising=False)
    left = [("hot", i, at(0, i), at(0, i + 100)) for i in range(120)] + [("cold", 500, at(0), at(1)), (None, 501, at(0), at(1))]
    right = [("hot", j, at(0, 2 * j), at(0, 2 * j + 60)) for j in range(90)] + [("cold", 600, at(0), at(1)), (None, 601, at(0), at(1))]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        rows = (overlap.overlap_join(spark.createDataFrame(left, "k string, i long, a timestamp, b timestamp"),
                                     spark.createDataFrame(right, "k string, j long, c timestamp, d timestamp"), ["k"], ("a", "b"), ("c", "d"))
                .withColumn("task", F.spark_partition_id()).collect())
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    want = {(i, j) for k, i, a, b in left for m, j, c, d in right if k is not None and k == m and max(a, c) < min(b, d)}
    assert len(rows) == len(want) and {(r.i, r.j) for r in rows} == want and (500, 600) in want
    hot = Counter(r.task for r in rows if r.k == "hot")
    assert len(hot) >= 4 and max(hot.values()) < sum(hot.values()) / 2


# --- privileges -------------------------------------------------------------------

def test_paths_through_cycles(spark):
    run = Workspace(spark, "test-closure")
    edges = spark.createDataFrame([("s", a, b) for a, b in ["ab", "bc", "ca", "cd", "ad", "dd", "de"]] + [("t", "a", "z")], "k string, x string, y string")
    got = {(r.k, r.x, r.y): "".join(r.path) for r in shortest_paths(edges, run, ["k"], "x", "y").collect()}
    run.release()
    assert got == {("s", "a", "b"): "ab", ("s", "a", "c"): "abc", ("s", "a", "d"): "ad", ("s", "a", "e"): "ade", ("s", "b", "a"): "bca",
                   ("s", "b", "c"): "bc", ("s", "b", "d"): "bcd", ("s", "b", "e"): "bcde", ("s", "c", "a"): "ca", ("s", "c", "b"): "cab",
                   ("s", "c", "d"): "cd", ("s", "c", "e"): "cde", ("s", "d", "e"): "de", ("t", "a", "z"): "az"}


def test_effective_privileges(spark):
    sc = {"instance": "i0", "snap_ts": T0}
    roles = snapshot_frame(spark, "roles", [dict(sc, oid=i, rolname=n, rolinherit=n != "lazy") for i, n in enumerate(["ann", "lazy", "staff", "boss", "dba"])])
    members = snapshot_frame(spark, "auth_members", [dict(sc, member=m, roleid=r) for m, r in [(0, 2), (2, 3), (3, 2), (1, 3), (0, 1), (3, 4), (0, 77)]])
    acls = snapshot_frame(spark, "acls", [
        dict(sc, object_name="t", owner="o", acl=["boss=r*/o", "staff=r/o", "=x/o", "gone=w/o"]), dict(sc, object_name="u", owner="o", acl=["dba=w/o"]),
        dict(sc, object_name="v", owner="o", acl=None)])
    got = {(r.role_name, r.object_name, r.privilege): (r.grant_path, r.depth, r.is_grantable, r.grants)
           for r in users.effective_privileges(acls, roles, members).collect()}
    assert got == {
        ("boss", "t", "SELECT"): ("boss", 0, True, 2), ("staff", "t", "SELECT"): ("staff", 0, True, 2),
        ("ann", "t", "SELECT"): ("ann > staff", 1, True, 2),  # lazy is a member of boss but inherits nothing
        ("-", "t", "REFERENCES"): ("-", 0, False, 1), ("gone", "t", "UPDATE"): ("gone", 0, False, 1),
        ("dba", "u", "UPDATE"): ("dba", 0, False, 1), ("boss", "u", "UPDATE"): ("boss > dba", 1, False, 1),
        ("staff", "u", "UPDATE"): ("staff > boss > dba", 2, False, 1), ("ann", "u", "UPDATE"): ("ann > staff > boss > dba", 3, False, 1)}


def test_growth_needs_an_older_transaction(spark):
    table = [dict(instance="i0", datname="d", relid=1, snap_ts=at(m), n_dead_tup=n) for m, n in [(0, 5), (60, 9), (120, 9), (180, 3), (240, 4)]]
    act = [dict(instance="i0", datname="d", pid=7, usename="u", xact_start=at(30), snap_ts=at(m), backend_xmin=5) for m in (40, 70)]
    act += [dict(instance="i0", datname="d", pid=8, xact_start=at(30), snap_ts=at(300), backend_xmin=None),
            dict(instance="i0", datname="e", pid=9, xact_start=at(30), snap_ts=at(300), backend_xmin=5)]
    got = intervals.growth_under_horizon(snapshot_frame(spark, "table_stats", table), snapshot_frame(spark, "activity", act)).collect()
    assert [(r.from_ts, r.to_ts, r.dead_growth, r.pid, r.overlap_s) for r in got] == [(at(0), at(60), 4, 7, 1800.0)]


def test_rollup_is_one_expand_and_one_scan(spark):
    from fleetscope import registry
    from fleetscope.plans import objects

    sc = {"instance": "i0", "snap_ts": T0}
    rel = [dict(sc, datname=d, nspname=s, relkind=k, size_bytes=b) for d, s, k, b in [
        ("a", "x", "r", 60), ("a", "x", "i", 20), ("a", "y", "r", 20), ("b", None, "r", 100), (None, "x", "r", None)]]
    rows = objects.size_rollup(snapshot_frame(spark, "relations", rel))
    got = {(r.level, r.datname, r.schema, r.kind): (r.objects, r.bytes, r.pct_of_above) for r in rows.collect()}
    assert got[("server", None, None, None)] == (5, 200, 100.0) and got[("database", "a", None, None)] == (3, 100, 50.0)
    assert got[("schema", "a", "x", None)] == (2, 80, 80.0) and got[("kind", "a", "x", "index")] == (1, 20, 25.0)
    assert got[("schema", "b", None, None)] == (1, 100, 100.0) and got[("database", None, None, None)] == (1, None, None) and len(got) == 13
    plan = registry.queries()["size_rollup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Expand") == 1


def test_restarts_reach_the_fixtures(spark):
    from fleetscope import registry
    from tests.conftest import SF_SMALL

    for name, column in (("write_intervals", "restarted"), ("statement_intervals", "restarted_entries > 0"), ("index_intervals", "restarted_indexes > 0")):
        rows = registry.queries()[name](spark, SF_SMALL)
        assert rows.where(column).count() > 0 and rows.where(f"not ({column})").count() > 0
    assert registry.queries()["write_intervals"](spark, SF_SMALL).agg(F.min("bytes_per_s")).first()[0] >= 0
