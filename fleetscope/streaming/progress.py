"""Running commands as a stateful stream: rate, time left, stalls.

The reference asks its user to poll a progress view and to judge by eye
whether the command still moves. Here each command (server and pid) is one
state: its last poll, and since when its counter stands. A poll yields a row
with the rate since the poll before and the time left at that rate. When no
poll comes for ``stall_after_s`` of event time, a timer yields one row
``stalled`` and the state is gone, so a command that ended leaves nothing
behind. A poll that comes after such a pause starts the command anew, whether
or not the watermark has passed the timer by then, so results don't depend on
how polls fall into micro-batches.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampType

from fleetscope.session import share_package
from fleetscope.streaming.reports import run_available

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

_TYPES = {"instance": StringType(), "pid": LongType(), "event": StringType(), "snap_ts": TimestampType(), "relid": LongType(), "phase": StringType(),
          "done": LongType(), "total": LongType(), "rate": DoubleType(), "left_s": DoubleType(), "idle_s": DoubleType()}
MONITORED = StructType([StructField(n, t) for n, t in _TYPES.items()])
_STATE = StructType([StructField(n, _TYPES.get(n, LongType())) for n in ("relid", "phase", "done", "total", "last_us", "moved_us")])


def vacuum_polls(progress: DataFrame) -> DataFrame:
    """R44's counters in the monitor's shape: blocks scanned, or vacuumed in
    the phase that vacuums the heap."""
    done = F.when(F.col("phase") == "vacuuming heap", F.col("heap_blks_vacuumed")).otherwise(F.col("heap_blks_scanned"))
    return progress.select("instance", "pid", "snap_ts", "relid", "phase", done.alias("done"), F.col("heap_blks_total").alias("total"))


class CommandMonitor(StatefulProcessor):
    """State of one (instance, pid)."""

    def __init__(self, stall_after_s: int):
        self.stall_us = stall_after_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        polls = sorted(rows, key=lambda r: (r.at_us, repr((r.relid, r.phase, r.done, r.total))))
        last = Row(**dict(zip(_STATE.names, self.last.get(), strict=True))) if self.last.exists() else None
        for r in polls:
            if last is not None and r.at_us <= last.last_us:
                continue  # a repeated or overtaken poll
            if last is not None and r.at_us - last.last_us > self.stall_us:
                yield self._stalled(key, last)
                last = None
            same = last is not None and (r.relid, r.phase) == (last.relid, last.phase) and r.done is not None and last.done is not None
            moved = r.at_us if not same or r.done != last.done else last.moved_us
            rate = (r.done - last.done) * 1e6 / (r.at_us - last.last_us) if same and r.done >= last.done else None
            left = (r.total - r.done) / rate if rate and r.total is not None else None
            yield self._row(key, "poll", r.at_us, r, rate, left, (r.at_us - moved) / 1e6)
            last = Row(relid=r.relid, phase=r.phase, done=r.done, total=r.total, last_us=r.at_us, moved_us=moved)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update(tuple(last))
        # a millisecond late at most: timers are in milliseconds
        self.handle.registerTimer(-(-(last.last_us + self.stall_us) // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.last.exists():
            yield self._stalled(key, Row(**dict(zip(_STATE.names, self.last.get(), strict=True))))
            self.last.clear()

    def close(self) -> None:
        pass

    def _stalled(self, key, last: Row) -> Row:
        at = last.last_us + self.stall_us
        return self._row(key, "stalled", at, last, None, None, (at - last.moved_us) / 1e6)

    @staticmethod
    def _row(key, event: str, at_us: int, r: Row, rate, left, idle: float) -> Row:
        at = dt.datetime.fromtimestamp(at_us // 1_000_000, dt.timezone.utc) + dt.timedelta(microseconds=at_us % 1_000_000)
        return Row(instance=key[0], pid=key[1], event=event, snap_ts=at, relid=r.relid, phase=r.phase, done=r.done, total=r.total,
                   rate=rate, left_s=left, idle_s=idle)


def monitor_commands(polls: DataFrame, stall_after_s: int = 600, lateness: str = "2 minutes") -> DataFrame:
    """Polls (instance, pid, snap_ts, relid, phase, done, total) to rows of
    ``MONITORED``. Rows later than ``lateness`` are dropped by the watermark.
    Needs the RocksDB state store (``run_monitor`` sets it)."""
    dated = polls.where("instance is not null and pid is not null and snap_ts is not null")
    return (dated.withColumn("at_us", F.unix_micros("snap_ts")).withWatermark("snap_ts", lateness)
            .groupBy("instance", "pid").transformWithState(CommandMonitor(stall_after_s), MONITORED, "Append", "EventTime"))


def run_monitor(polls: DataFrame, out_path: str, checkpoint: str, stall_after_s: int = 600, lateness: str = "2 minutes") -> DataFrame:
    """Run the monitor over all available polls; a later call with the same
    folders goes on from the checkpoint."""
    conf = share_package(polls.sparkSession).conf
    before = conf.get(STATE_STORE[0], None)
    conf.set(*STATE_STORE)
    try:
        return run_available(monitor_commands(polls, stall_after_s, lateness), out_path, checkpoint)
    finally:
        if before is None:
            conf.unset(STATE_STORE[0])
        else:
            conf.set(STATE_STORE[0], before)
