"""Streaming forms: complete output equals the batch report, late
snapshots are dropped by the watermark, and windows bound the state."""

import datetime as dt
import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fleetscope import registry
from fleetscope.plans import activity
from fleetscope.sources.fixtures import load
from fleetscope.sources.readers import snapshot_frame
from fleetscope.streaming import reports as st
from tests.conftest import SF_SMALL

T0 = dt.datetime(2024, 1, 31)


def _session(pid, ts, state="active"):
    return dict(instance="i0", snap_ts=ts, pid=pid, state=state, backend_type="client backend", is_collector=False,
                state_change=ts, query_start=ts, xact_start=ts, next_xid=1)


def test_session_mix_complete_equals_batch(spark):
    batch = activity.sessions_by_state(load(spark, SF_SMALL, "activity"))
    want = sorted(((r.instance, r.snap_ts, r.state, r.sess_count) for r in batch.collect()), key=repr)
    got = st.stream_session_mix(load(spark, SF_SMALL, "activity"))  # batch frames run the same plan
    rows = sorted(((r.instance, r.window_start, r.state, r.sess_count) for r in got.collect()), key=repr)
    assert rows == want


def _feed(spark, folder, batches):
    for i, rows in enumerate(batches):
        snapshot_frame(spark, "activity", rows).coalesce(1).write.parquet(f"{folder}/in/b{i:03d}")
    schema = spark.read.parquet(f"{folder}/in/b000").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def test_late_snapshots_dropped(spark, tmp_path):
    folder = str(tmp_path)
    day5 = T0 + dt.timedelta(days=5)
    stream = _feed(spark, folder, [
        [_session(1, day5), _session(2, day5)],
        [_session(4, day5, "idle")],
        # days behind the watermark set two batches earlier: dropped
        [_session(3, T0), _session(5, day5)],
    ])
    agg = st.stream_session_mix(stream, window="1 day", lateness="1 hour")

    def keep(batch, epoch):
        batch.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(f"{folder}/out")

    q = (agg.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/chk")
         .foreachBatch(keep).trigger(availableNow=True).start())
    q.awaitTermination()
    rows = spark.read.parquet(f"{folder}/out").collect()
    assert not [r for r in rows if r.window_start == T0]
    final = max((r.epoch, r.sess_count) for r in rows if r.state == "active")
    assert final[1] == 3  # the on-time rows of every batch are counted


def test_latest_progress_per_window(spark):
    rows = [dict(instance="i0", snap_ts=T0 + dt.timedelta(minutes=m), pid=7, relid=1, phase=ph)
            for m, ph in [(1, "scanning heap"), (5, "vacuuming indexes"), (70, "vacuuming heap")]]
    prog = snapshot_frame(spark, "progress_vacuum", rows)
    got = sorted((r.window_start, r.phase) for r in st.stream_latest_progress(prog).collect())
    assert got == [(T0, "vacuuming indexes"), (T0 + dt.timedelta(hours=1), "vacuuming heap")]


@pytest.mark.parametrize("mode", ["append", "update", "complete"])
def test_every_window_of_every_batch_is_kept(spark, tmp_path, mode):
    days = [T0 + dt.timedelta(days=d) for d in range(3)]
    stream = _feed(spark, str(tmp_path), [[_session(i, d), _session(i + 10, d)] for i, d in enumerate(days)]
                   + [[_session(99, T0 + dt.timedelta(days=30))]])
    agg = st.stream_session_mix(stream, window="1 day", lateness="1 hour")
    out = st.run_available(agg, f"{tmp_path}/out", f"{tmp_path}/chk", mode=mode, keys=("instance", "window_start", "state"))
    got = {r.window_start: r.sess_count for r in out.collect()}
    assert {d: got.get(d) for d in days} == dict.fromkeys(days, 2)


def test_state_stays_flat_over_many_windows(spark, tmp_path):
    stream = _feed(spark, str(tmp_path), [[_session(d, T0 + dt.timedelta(days=d))] for d in range(50)])
    agg = st.stream_session_mix(stream, window="1 day", lateness="1 hour")
    sizes = []

    def write(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out/epoch={epoch}")

    q = (agg.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/chk")
         .foreachBatch(write).trigger(availableNow=True).start())
    q.awaitTermination()
    sizes = [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]
    assert len(sizes) >= 50 and max(sizes) <= 3
    assert spark.read.parquet(f"{tmp_path}/out").count() >= 48


def test_ties_of_one_instant_are_resolved(spark):
    rows = [dict(instance="i0", snap_ts=T0, pid=7, relid=i, phase="scanning heap") for i in range(20)]
    prog = snapshot_frame(spark, "progress_vacuum", rows)
    got = {st.stream_latest_progress(prog.repartition(n)).first().relid for n in (1, 3, 7)}
    assert len(got) == 1


@pytest.mark.parametrize("ordered", [False, True])
def test_a_batch_of_a_feed_has_many_files(spark, tmp_path, monkeypatch, ordered):
    # two moments, 90 and 30 sessions: a batch of 90 rows in one file was read, sorted and written by one task
    monkeypatch.setattr(registry, "FEED_ROWS", 20, raising=False)
    rows = [dict(instance="i0", snap_ts=T0 + dt.timedelta(hours=3 * (p >= 90)), pid=p, relid=p, phase="scanning heap") for p in range(120)]
    feed = registry._ordered_feed if ordered else registry._feed
    stream = feed(spark, str(tmp_path), snapshot_frame(spark, "progress_vacuum", rows).repartition(3), files=2)
    for part in ("part=0", "part=1") if ordered else ("part=0",):
        sizes = [pq.read_metadata(f).num_rows for f in glob.glob(f"{tmp_path}/feed/{part}/*.parquet")]
        assert max(sizes) <= 45 and (not ordered or len(sizes) == 5), sizes
    out = st.run_available(st.stream_latest_progress(stream, lateness="10 minutes" if ordered else "60 days"), f"{tmp_path}/out", f"{tmp_path}/chk")
    assert sorted(r.pid for r in out.where("window_start < '2100-01-01'").collect()) == list(range(120))


def test_session_mix_feed_has_what_the_report_reads(spark, monkeypatch):
    # statement texts stay out of the feed, and windows close whichever session the closing row is taken from
    from fleetscope import registry
    from fleetscope.streaming import reports

    rows = [dict(_session(p, T0), backend_type="autovacuum worker" if p < 3 else "client backend", is_collector=p == 5) for p in range(1, 9)]
    sessions = snapshot_frame(spark, "activity", rows).coalesce(1)
    monkeypatch.setattr(registry, "load", lambda *_: sessions)
    read = []
    monkeypatch.setattr(reports, "stream_session_mix", lambda feed, mix=reports.stream_session_mix, **how: read.append(feed.columns) or mix(feed, **how))
    assert [r.sess_count for r in registry.queries()["stream_session_mix"](spark, "").collect()] == [5]
    assert set(read[0]) == {"pid", *reports.SESSION_MIX_COLUMNS}
