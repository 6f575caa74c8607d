"""Per-scope building blocks: totals for shares, and top-k per scope.

The reference computes shares with ``x / sum(x) over ()`` and top lists with
``order by ... limit``, both over one server. Here every scope (instance,
snapshot) is handled at once, and neither step moves a whole scope into one
task:

* totals are aggregated per scope (partial aggregation before the shuffle)
  and joined back on the scope keys; adaptive execution turns the join into a
  broadcast only when the runtime size of the totals is small, else a
  sort-merge join whose hot partitions are split by the skew-join rule;
* top-k uses ``row_number() <= n`` over a scope window, which Spark plans as a
  partial group limit before the shuffle, so at most ``n`` rows per scope
  leave each map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope import SCOPE


def with_totals(df: DataFrame, totals: dict[str, Column], scope: Sequence[str] = SCOPE) -> DataFrame:
    """Add per-scope aggregates ``totals`` (name -> aggregate) to every row.
    Reports call this on rows that are already aggregated or cut to top-k,
    so even the busiest scope brings a bounded number of rows to the join."""
    agg = df.groupBy(*scope).agg(*[c.alias(n) for n, c in totals.items()])
    return df.join(agg, on=list(scope), how="inner")


def top_k(df: DataFrame, order: Sequence[Column], n: int, scope: Sequence[str] = SCOPE) -> DataFrame:
    """The first ``n`` rows of each scope under ``order`` (which must end in a
    unique tie-break so the result is deterministic)."""
    w = Window.partitionBy(*scope).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def not_collector(activity: DataFrame) -> DataFrame:
    """Drop the session that took the snapshot (the reference's own pid)."""
    return activity.where(~F.col("is_collector"))


def collector_pids(activity: DataFrame) -> DataFrame:
    return activity.where(F.col("is_collector")).select(*SCOPE, "pid")


def without_collector_pids(df: DataFrame, activity: DataFrame, pid_col: str = "pid") -> DataFrame:
    """Anti join: rows of ``df`` whose pid is not the collector's in its scope."""
    own = collector_pids(activity).withColumnRenamed("pid", pid_col)
    return df.join(own, on=SCOPE + [pid_col], how="left_anti")


def attach(small: DataFrame, big: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``small LEFT JOIN big`` on ``keys``, written as ``big RIGHT JOIN small``
    so the planner may broadcast the small side (progress rows) and stream
    the big one (sessions, relations) without shuffling it. A left join can
    only broadcast its right side, which here is the big one. The columns of
    ``big`` other than the keys must not clash with ``small``'s."""
    return big.join(small, on=list(keys), how="right")


def left_join_known(df: DataFrame, lookup: DataFrame, keys: Sequence[str], key: str, absent: int | None = None) -> DataFrame:
    """``df LEFT JOIN lookup`` on ``keys`` and ``key``, a pid or oid (never
    negative). Rows whose key is NULL (or ``absent``) match nothing but would
    all meet in one partition per scope: they get one of 1,024 negative keys
    from a hash of the row instead."""
    known = F.col(key).isNotNull() if absent is None else F.col(key).isNotNull() & (F.col(key) != absent)
    spread = -1 - F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(1024))
    left = df.withColumn("_key", F.when(known, F.col(key).cast("bigint")).otherwise(spread))
    return left.join(lookup.withColumnRenamed(key, "_key"), on=[*keys, "_key"], how="left").drop("_key")


def sort_if(df: DataFrame, ordered: bool, *cols) -> DataFrame:
    """The reference's row order, on request. A global sort over every
    scope costs a sampling pass (which recomputes the plan) and a range
    shuffle, so reports return unordered rows unless ``ordered`` is set;
    rows of one scope can also be sorted after filtering to that scope."""
    return df.orderBy(*cols) if ordered else df


SALT_BUCKETS = 32


def salted_lookup(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left",
                  buckets: int = SALT_BUCKETS, grows: bool = False) -> DataFrame:
    """Join ``big`` rows to a lookup ``small`` with one row per key (a
    per-scope or per-database setting) so that a hot key is spread over
    ``buckets`` tasks: each ``big`` row gets a bucket from a hash of the
    whole row and each ``small`` row is copied to every bucket. When the
    lookup is small enough the planner broadcasts it instead; the buckets
    matter once it is not (many scopes) and one key holds much of ``big``.
    The planner doesn't count exploded copies, and may broadcast 32 times what
    it expects: a lookup that ``grows`` with the input gets them by a cross
    join, whose size it does count."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(buckets))
    if grows:
        copies = small.crossJoin(F.broadcast(small.sparkSession.range(buckets).withColumnRenamed("id", "_salt")))
    else:
        copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return big.withColumn("_salt", salt).join(copies, on=list(keys) + ["_salt"], how=how).drop("_salt")
