"""Differences of cumulative counters between consecutive snapshots.

A server's counters only grow, until its statistics are reset. Each series of
one entity (a server, a statement, an index) is cut into segments: a new one
starts where the reset time moves, where any counter falls, or where the entity
was missing from the snapshot before (evicted and counted anew). Inside a
segment an interval's delta is the difference to the snapshot before; the first
interval of a segment counts from zero, so no delta is ever negative.

The previous row comes from a window over one entity's own snapshots, so no
partition holds more than an entity's history, whatever a server's share of the
rows; the snapshot before comes from the distinct snapshot times of a series
(one row per snapshot), joined by ``salted_lookup``. An entity that is a series
of its own (a server) has it in the same window, so nothing is joined: there the
lookup has as many rows as the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.operators.scope import salted_lookup


def previous_snapshots(rows: DataFrame, series: Sequence[str]) -> DataFrame:
    """(series, snap_ts, from_ts): each snapshot time with the one before it."""
    times = rows.select(*series, "snap_ts").distinct()
    return times.withColumn("from_ts", F.lag("snap_ts").over(Window.partitionBy(*series).orderBy("snap_ts")))


def counter_deltas(rows: DataFrame, keys: Sequence[str], counters: Sequence[str], reset: str | None = None,
                   series: Sequence[str] = ("instance",)) -> DataFrame:
    """One row per entity (``keys``, which include ``series``) and interval:
    ``rows``' columns with each counter replaced by its delta, ``from_ts`` and
    ``restarted`` (the delta counts from zero: what came between the last
    snapshot and the reset is unknown). The first snapshot of a series ends no
    interval. A null counter gives a null delta and never counts as a fall.
    ``keys`` and ``snap_ts`` identify a row."""
    entity = Window.partitionBy(*keys).orderBy(F.unix_micros("snap_ts"))
    before = F.lag(F.struct("snap_ts", *([reset] if reset else []), *counters)).over(entity)
    if set(keys) == set(series):
        for k in keys:
            rows = rows.where(F.col(k).isNotNull())
        earlier = F.max("snap_ts").over(entity.rangeBetween(Window.unboundedPreceding, -1))
        spans = rows.select("*", before.alias("_before"), earlier.alias("from_ts"))
    else:
        spans = salted_lookup(rows.withColumn("_before", before), previous_snapshots(rows, series), [*series, "snap_ts"], how="inner", grows=True)
    fell = F.lit(False)
    for c in counters:
        fell = fell | F.coalesce(F.col(c) < F.col(f"_before.{c}"), F.lit(False))
    moved = ~F.col(reset).eqNullSafe(F.col(f"_before.{reset}")) if reset else F.lit(False)
    missing = ~F.col("from_ts").eqNullSafe(F.col("_before.snap_ts"))
    spans = spans.where(F.col("from_ts").isNotNull()).withColumn("restarted", missing | moved | fell)

    def delta(c: str) -> Column:
        return F.when(F.col("restarted"), F.col(c)).otherwise(F.col(c) - F.col(f"_before.{c}"))

    kept = [c for c in rows.columns if c not in counters]
    return spans.select(*kept, "from_ts", "restarted", *[delta(c).alias(c) for c in counters])
