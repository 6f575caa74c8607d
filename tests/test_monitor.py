"""The command monitor (rate, time left, stalls) and the stream-stream join:
late and missing partners, bounded state, restart from the checkpoint."""

import datetime as dt

from fleetscope.sources.readers import snapshot_frame
from fleetscope.streaming import progress as monitor
from fleetscope.streaming import reports as st

T0 = dt.datetime(2024, 1, 31)
POLLS = "instance string, pid long, snap_ts timestamp, relid long, phase string, done long, total long"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


class Feed:
    """A folder of files, each a micro-batch."""

    def __init__(self, spark, folder, schema=None, view=None):
        self.spark, self.folder, self.schema, self.view, self.n = spark, str(folder), schema, view, 0

    def add(self, rows):
        frame = self.spark.createDataFrame(rows, self.schema) if self.schema else snapshot_frame(self.spark, self.view, rows)
        frame.coalesce(1).write.parquet(f"{self.folder}/b{self.n:03d}")
        self.n += 1
        return self

    def stream(self):
        schema = self.spark.read.parquet(f"{self.folder}/b000").schema
        return self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/*")


def monitored(feed, folder):
    rows = monitor.run_monitor(feed.stream(), f"{folder}/out", f"{folder}/chk").where("pid < 1000").collect()
    return sorted((r.pid, r.snap_ts, r.event, r.phase, r.rate, r.left_s, r.idle_s) for r in rows)


END = [("i", 9999, at(10_000), 0, "end", 0, 0)]
FIRST = [("i", 1, at(0), 5, "scan", 0, 600), ("i", 1, at(1), 5, "scan", 60, 600), ("i", 2, at(0), 7, "scan", 5, None)]
SECOND = [("i", 1, at(2), 5, "scan", 60, 600), ("i", 1, at(1), 5, "scan", 60, 600), ("i", 1, at(3), 5, "vacuum", 0, 600)]
THIRD = [("i", 1, at(30), 5, "vacuum", 10, 600)]
WANT = [
    (1, at(0), "poll", "scan", None, None, 0.0),
    (1, at(1), "poll", "scan", 1.0, 540.0, 0.0),
    (1, at(2), "poll", "scan", 0.0, None, 60.0),  # polls come, the counter stands
    (1, at(3), "poll", "vacuum", None, None, 0.0),
    (1, at(13), "stalled", "vacuum", None, None, 600.0),
    (1, at(30), "poll", "vacuum", None, None, 0.0),  # after the pause it starts anew
    (1, at(40), "stalled", "vacuum", None, None, 600.0),
    (2, at(0), "poll", "scan", None, None, 0.0),
    (2, at(10), "stalled", "scan", None, None, 600.0)]


def test_rates_stalls_and_restart(spark, tmp_path):
    one = Feed(spark, tmp_path / "one", POLLS).add(FIRST + SECOND + THIRD + END)  # all in one batch
    assert monitored(one, tmp_path / "a") == WANT
    many = Feed(spark, tmp_path / "many", POLLS).add(FIRST).add(SECOND)
    monitored(many, tmp_path / "b")
    many.add(THIRD).add(END)  # goes on from the checkpoint
    assert monitored(many, tmp_path / "b") == WANT


def test_state_is_gone_after_the_commands(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", POLLS)
    for hour in range(4):
        feed.add([("i", 100 * hour + k, at(60 * hour), 1, "scan", 0, 10) for k in range(20)])
    feed.add(END)
    spark.conf.set(*monitor.STATE_STORE)
    try:
        query = (monitor.monitor_commands(feed.stream()).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/chk")
                 .format("noop").trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        spark.conf.unset(monitor.STATE_STORE[0])
    kept = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    assert max(kept) <= 2 * 4 * 21 and kept[-1] <= 4  # at most an hour's commands, then the last row's


def locker_rows(spark, tmp_path, builds, sessions):
    rows = st.run_available(st.stream_locker_queries(builds.stream(), sessions.stream()), f"{tmp_path}/out", f"{tmp_path}/chk")
    return [(r.build_pid, r.build_ts, r.locker_pid, r.seen_ts, r.locker_query) for r in rows.where("build_pid < 1000").collect()]


def test_locker_queries_with_late_and_missing_partners(spark, tmp_path):
    def build(pid, minute, locker):
        return dict(instance="i", snap_ts=at(minute), pid=pid, datname="d", phase="x", current_locker_pid=locker, index_relid=1)

    def session(pid, minute, query, seconds=0):
        return dict(instance="i", snap_ts=at(minute) + dt.timedelta(seconds=seconds), pid=pid, state="active", query=query)

    builds, sessions = Feed(spark, tmp_path / "builds", view="progress_index"), Feed(spark, tmp_path / "sessions", view="activity")
    builds.add([build(1, 0, 50), build(2, 0, 51), build(3, 0, None), build(4, 0, 52)])
    sessions.add([session(50, 0, "right away", 30), session(52, 0, "too late", 61)])
    builds.add([build(5, 5, 53)])
    sessions.add([session(51, 1, "a batch later"), session(53, 5, "before", -60), session(53, 5, "after", 60)])
    builds.add([build(6, 500, 54)])
    sessions.add([session(54, 500, "x")])
    builds.add([build(7, 510, 55)])
    sessions.add([session(55, 510, "y")])  # rows count as late by the watermark of the batch before
    builds.add([build(9999, 9000, 1)])
    sessions.add([session(51, 0, "behind the watermark by hours"), session(9999, 9000, "end")])
    got = locker_rows(spark, tmp_path, builds, sessions)
    assert sorted(got, key=str) == sorted([
        (1, at(0), 50, at(0.5), "right away"), (2, at(0), 51, at(1), "a batch later"), (4, at(0), 52, None, None),
        (5, at(5), 53, at(4), "before"), (5, at(5), 53, at(6), "after"), (6, at(500), 54, at(500), "x"),
        (7, at(510), 55, at(510), "y")], key=str)


def test_join_state_is_bounded(spark, tmp_path):
    builds, sessions = Feed(spark, tmp_path / "builds", view="progress_index"), Feed(spark, tmp_path / "sessions", view="activity")
    for hour in range(12):
        builds.add([dict(instance="i", snap_ts=at(60 * hour), pid=hour, current_locker_pid=hour, phase="x")])
        sessions.add([dict(instance="i", snap_ts=at(60 * hour), pid=hour, state="active", query="q")])
    joined = st.stream_locker_queries(builds.stream(), sessions.stream())
    query = (joined.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/chk").format("noop")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    kept = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    assert len(kept) >= 12 and max(kept) <= 8
