"""Properties that hold on any input: shares add up, totals agree across
reports, trees cover their nodes, and running on one scope equals the
whole run restricted to that scope."""

import pytest
from pyspark.sql import functions as F

from fleetscope import SCOPE
from fleetscope.plans import activity, bloat, objects
from fleetscope.sources.fixtures import load
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def t(spark):
    names = ["activity", "statements", "relations", "attributes", "column_stats", "indexes", "index_stats",
             "locks", "lock_activity"]
    return {n: load(spark, SF_SMALL, n).cache() for n in names}


def test_state_shares_add_up(t):
    sums = (activity.sessions_by_state(t["activity"]).groupBy(*SCOPE)
            .agg(F.sum("pct").alias("s"), F.count("*").alias("n")).collect())
    assert sums
    for r in sums:
        assert abs(r.s - 100) <= 0.005 * r.n + 1e-9


def test_statement_shares_bounded(t):
    top = activity.top_statements(t["statements"], n=10000)
    sums = top.groupBy(*SCOPE).agg(F.sum("t_db_time_pct").alias("s"), F.count("*").alias("n")).collect()
    for r in sums:  # with no limit, the shares of all statements add up to 100
        assert abs(r.s - 100) <= 0.005 * r.n + 1e-9


def test_total_bloat_adds_table_and_index_totals(t):
    args = (t["relations"], t["attributes"], t["column_stats"])
    tot = {r[:3]: r for r in bloat.total_bloat(*args, t["indexes"]).collect()}
    tab = {r[:3]: r for r in bloat.table_bloat_total(*args).collect()}
    idx = {r[:3]: r for r in bloat.index_bloat_total(t["indexes"], *args).collect()}
    assert tot
    for db, r in tot.items():
        table_real = tab[db].total_real_bytes if db in tab else 0
        assert r.db_bytes == table_real + idx[db].total_idx_bytes


def test_unused_index_total_is_sum_of_list(t):
    rows = objects.unused_indexes(t["index_stats"], t["indexes"])
    listed = rows.groupBy(*SCOPE, "datname").agg(F.sum("index_bytes").alias("b")).collect()
    total = {(r.instance, r.snap_ts, r.datname): r.total_unused_idx_bytes
             for r in objects.unused_indexes_total(t["index_stats"], t["indexes"]).collect()}
    for r in listed:
        assert total[(r.instance, r.snap_ts, r.datname)] == r.b


def test_lock_tree_roots_cover_all_nodes(t):
    from fleetscope.operators.lock_graph import lock_graph, subtree_sizes, wait_forest
    from fleetscope.workspace import Workspace

    run = Workspace(t["locks"].sparkSession, "test")
    waits, holds = lock_graph(t["locks"], run)
    tree, depth = wait_forest(waits, holds, run)
    sizes = subtree_sizes(tree, depth, run)
    roots = tree.where(F.col("lvl") == 0).join(sizes, on=SCOPE + ["pid"])
    n_nodes = tree.count()
    n_roots = roots.count()
    assert n_nodes > n_roots > 0
    assert roots.agg(F.sum("size")).first()[0] == n_nodes - n_roots
    # every waiter is placed exactly once
    waiters = waits.select(*SCOPE, "pid").distinct()
    assert waiters.join(tree, on=SCOPE + ["pid"], how="left_anti").count() == 0
    assert tree.groupBy(*SCOPE, "pid").count().where("count > 1").count() == 0


def test_one_scope_equals_filtered_whole_run(t):
    whole = activity.sessions_by_state(t["activity"])
    one = whole.select("instance", "snap_ts").distinct().orderBy("instance", "snap_ts").first()
    cond = (F.col("instance") == one.instance) & (F.col("snap_ts") == one.snap_ts)
    alone = activity.sessions_by_state(t["activity"].where(cond))
    key = ["state", "sess_count", "pct", "avg_state_time_ms"]
    assert sorted(map(tuple, alone.select(*key).collect()), key=str) == \
        sorted(map(tuple, whole.where(cond).select(*key).collect()), key=str)
    whole_top = activity.top_statements(t["statements"]).where(F.col("instance") == "i1")
    alone_top = activity.top_statements(t["statements"].where(F.col("instance") == "i1"))
    assert sorted(map(tuple, whole_top.collect())) == sorted(map(tuple, alone_top.collect()))
