"""Mixing sources to target weights along a time-varying curriculum.

A source's weight changes over training time 0 to 1; its schedule is a list of
knots (time, weight) joined by straight lines. The integral of the schedule is
the source's overall weight and gives its target: the sources share the
budget by weight, no target exceeds ``repeats`` times what the source has, and
what is cut off is shared again among the others by weight, until no target is
above. A source's cumulative demand at time t is its target times the share of
its schedule's integral up to t. Its documents queue up in an order fixed by a
checksum of their id, once per round; the queue is used up as far as the
target (the document on the border is cut), and a document's position is the
time when the source's demand reaches the place of its first word: the
demand curve inverted, a quadratic per straight line.

All of it is DataFrame operations: places in a queue are running totals over
range partitions (a partition's offset is the sum of the partitions before),
so a source holding a third of all rows is spread over as many tasks as its
rows ask for. The excess is reshared by one aggregation of the sources a
round; only the common rate reaches the driver.

Rows: a null text has size 0; a null source is a source of its own, the last;
repeated rows are documents of their own, ties in the queue go by id and text
checksum, and rows equal in all three are interchangeable. Documents of size 0
take no words; their position is that of their place. A source of size 0 has
target 0 and its documents no position; an empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.workspace import Workspace

WORD = r"[^\x20\x09-\x0D]+"  # fixed value: what counts as a word


def running_total(rows: DataFrame, keys: list[str], order: list[str], value: Column, run: Workspace, name: str) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over the earlier rows of
    the same keys. Rows are range-partitioned by keys and order; each
    partition adds the sums of the partitions before it."""
    dealt = run.table(rows.withColumn("_value", value).repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), name)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_part", *keys).agg(F.sum("_value").alias("_sum"))
    offsets = sums.select(F.col("_part").alias("_at"), *[F.col(k).alias(f"_{k}") for k in keys],
                          F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    same = [F.col("_part") == F.col("_at")] + [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return placed.join(offsets, same).select(*rows.columns, (F.col("_inside") + F.col("_offset")).alias("before"))


def source_sizes(sized: DataFrame, run: Workspace) -> DataFrame:
    """(source, has, rank): each source's size and its 0-based place by code
    point, null last."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("has")).withColumn("unknown", F.col("source").isNull())
    placed = running_total(sizes.withColumn("all", F.lit(0)), ["all"], ["unknown", "source"], F.lit(1), run, "places")
    return run.table(placed.select("source", "has", F.col("before").alias("rank")), "sources")


def targets(sources: DataFrame, budget: Column, repeats: int, run: Workspace) -> DataFrame:
    """``sources`` (source, has, weight) with ``target``. ``budget`` is an
    aggregate over the sources."""
    top = F.col("has") * repeats
    total = sources.agg(budget.cast("double")).first()[0] or 0.0
    rate, capped = 0.0, -1
    while True:
        over = F.lit(capped >= 0) & (F.col("weight") * rate >= top)
        found = sources.agg(F.sum(F.when(over, top).otherwise(0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.count_if(over)).first()
        if found[2] == capped or not found[1]:
            break
        rate, capped = (total - found[0]) / found[1], found[2]
    return sources.withColumn("target", F.least(top.cast("double"), F.col("weight") * rate))


def integral(knots: Column) -> Column:
    """The schedule's lines as structs (t0, t1, w0, w1, before): ``before`` is
    the integral up to t0."""
    pairs = F.zip_with(F.slice(knots, F.lit(1), F.size(knots) - 1), F.slice(knots, F.lit(2), F.size(knots) - 1), lambda a, b: F.struct(
        a["t"].alias("t0"), b["t"].alias("t1"), a["w"].alias("w0"), b["w"].alias("w1")))

    pairs = F.filter(pairs, lambda p: p["t1"] > p["t0"])  # two knots of one time are a jump

    def until(i: Column) -> Column:
        return F.aggregate(F.slice(pairs, F.lit(1), i), F.lit(0.0), lambda s, p: s + area(p))

    return F.transform(pairs, lambda p, i: p.withField("before", until(i)))


def area(line: Column) -> Column:
    return (line["w0"] + line["w1"]) * (line["t1"] - line["t0"]) / 2.0


def inverse(lines: Column, wanted: Column) -> Column:
    """The time at which the integral reaches ``wanted``. On a line with slope
    m the integral is w0 x + m x^2 / 2; the root is taken in the form that
    stays exact for flat lines."""
    line = F.try_element_at(F.filter(lines, lambda p: p["before"] <= wanted), F.lit(-1))
    left = F.greatest(wanted - line["before"], F.lit(0.0))
    slope = (line["w1"] - line["w0"]) / (line["t1"] - line["t0"])
    root = line["w0"] + F.sqrt(F.greatest(line["w0"] * line["w0"] + 2.0 * slope * left, F.lit(0.0)))
    return F.least(line["t1"], line["t0"] + F.when(root > 0, 2.0 * left / root).otherwise(0.0))


def mix(docs: DataFrame, schedule: Column, run: Workspace, budget: Column | None = None, repeats: int = 2) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken
    (its words in the mix, repeats counted) and uses: an array of (round,
    words, position) of its takes. ``schedule`` maps a source's row (source,
    has, rank) to its knots array<struct<t, w>>, t from 0 to 1; ``budget`` is
    the mix's size, an aggregate over the sources (default: all they have)."""
    sized = run.table(docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("draw"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("mark"), F.monotonically_increasing_id().alias("row")), "sized")
    sources = source_sizes(sized, run).withColumn("lines", integral(schedule))
    sources = sources.withColumn("weight", F.aggregate("lines", F.lit(0.0), lambda s, p: s + area(p)))
    aimed = run.table(targets(sources, F.sum("has") if budget is None else budget, repeats, run), "targets")
    queued = running_total(sized, ["source"], ["draw", "doc_id", "mark", "size", "row"], F.col("size"), run, "queued")
    ends = aimed.select(F.col("source").alias("of"), "has", "target", "weight", "lines")
    rows = queued.join(ends, queued["source"].eqNullSafe(ends["of"]))
    whole = F.round("target").cast("long")

    def use(turn: Column) -> Column:
        place = turn * F.col("has") + F.col("before")
        words = F.greatest(F.least(whole - place, F.col("size")), F.lit(0))
        return F.struct(turn.cast("int").alias("round"), words.alias("words"),
                        inverse(F.col("lines"), place / F.nullif(F.col("target"), F.lit(0.0)) * F.col("weight")).alias("position"))

    taken = F.filter(F.transform(F.array(*[F.lit(i) for i in range(repeats)]), use),
                     lambda u: (u["words"] > 0) | ((F.col("size") == 0) & (u["round"] == 0)))
    rows = rows.withColumn("uses", F.when(F.col("target") > 0, taken).otherwise(F.expr("array()").cast(
        "array<struct<round:int,words:bigint,position:double>>")))
    return rows.select("doc_id", "size", "source", F.col("has").alias("source_size"), "target",
                       F.aggregate("uses", F.lit(0).cast("long"), lambda s, u: s + u["words"]).alias("taken"), "uses")


def training_order(mixed: DataFrame, run: Workspace) -> DataFrame:
    """One row per take (and one, without round, per document without takes),
    range-sorted by position: the columns of ``mix`` with round, words,
    position and first_word, the words of the mix before it."""
    takes = mixed.select("*", F.explode_outer("uses").alias("u")).select(
        *[c for c in mixed.columns if c != "uses"], "u.*", F.lit(0).alias("mix"))
    order = ["position", "source", "doc_id", "round", "size"]
    placed = running_total(takes, ["mix"], order, F.coalesce("words", F.lit(0)), run, "order")
    return placed.withColumn("first_word", F.when(F.col("round").isNotNull(), F.col("before"))).drop("mix", "before")
