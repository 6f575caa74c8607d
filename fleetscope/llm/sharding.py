"""Sharding by a k-d tree over row metadata.

The root holds all rows. A node with more than one leaf is split along its
widest dimension at the weighted median (weights are bytes; a node with an odd
number of leaves splits in that proportion). Medians are found for all nodes
of a level at once by distributed histograms: rows are counted into bins of
their node's range, a window over a node's (at most ``bins``) sums picks the bin
that holds the median, and that bin is refined until what it holds is within
the tolerance. The nodes of a level and their searches are tables, so neither
the plan nor the driver grows with the number of shards; rows carry their node
as a column, and a level joins them with its table of bounds: a broadcast while
nodes are few, and when they are many no node is hot any more.

Ties along the dimension are ordered by the text's checksum, then doc_id, so
equal texts stay in one shard unless a cut through their group is needed to
keep sizes near equal (a group heavier than the tolerance that straddles a
median).

Edge cases: a null text counts no bytes; null metadata counts as 0; repeated
rows are rows of their own; with fewer rows than shards some shards stay
empty; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.workspace import Workspace


def order_of(dim: Column, dims: list[str], ties: list[str]) -> Column:
    """A row's values along dimension number ``dim``: the dimension, then the
    ties that it isn't."""
    arms = None
    for i, d in enumerate(dims):
        values = F.array(*[F.col(c) for c in (d, *[t for t in ties if t != d])])
        arms = F.when(dim == i, values) if arms is None else arms.when(dim == i, values)
    return arms


def root_searches(points: DataFrame, nodes: DataFrame, dims: list[str], spread: dict[str, int]) -> DataFrame:
    """The searches of nodes (node, leaves) with rows: along the
    widest dimension, for the weight of half of the leaves."""
    ranges = [f(d).alias(f"{k}_{d}") for d in dims for k, f in (("lo", F.min), ("hi", F.max))]
    stats = points.groupBy("node").agg(F.sum("size").alias("w"), *ranges).join(nodes, "node")
    # the widest by its share of the root's width; the first of equals
    widths = F.array(*[(F.col(f"hi_{d}") - F.col(f"lo_{d}")) / F.lit(float(spread[d])) for d in dims])
    dim = (F.array_position(widths, F.array_max(widths)) - 1).cast("int")
    lo, hi = (F.element_at(F.array(*[F.col(f"{k}_{d}") for d in dims]), dim + 1) for k in ("lo", "hi"))
    none = F.array().cast("array<long>")
    return stats.select("node", "leaves", dim.alias("dim"), (F.col("w") * F.floor(F.col("leaves") / 2) / F.col("leaves")).alias("target"),
                        none.alias("fixed"), lo.alias("lo"), hi.alias("hi"), F.lit(0.0).alias("below"), F.lit(None).cast("array<long>").alias("bound"))


def refine(points: DataFrame, searches: DataFrame, dims: list[str], ties: list[str], tolerance: float, bins: int) -> DataFrame:
    """One round: every open search counts its range into bins and goes on
    with the bin that holds its target, or takes a bound beside it."""
    open_ = searches.where("bound is null")
    at = F.size("fixed") + 1
    rows = points.join(open_.select("node", "dim", "fixed", "lo", "hi"), "node").select(
        "node", "size", "fixed", "lo", "hi", order_of(F.col("dim"), dims, ties).alias("order"))
    value = F.element_at("order", at)
    rows = rows.where((F.slice("order", F.lit(1), F.size("fixed")) == F.col("fixed")) & value.between(F.col("lo"), F.col("hi")))
    step = F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo") + 1) / F.lit(bins)))
    following = F.try_element_at(F.col("order"), at + 1)
    sums = rows.groupBy("node", F.floor((value - F.col("lo")) / step).alias("bin")).agg(
        F.sum("size").cast("double").alias("w"), F.min(value).alias("first"), F.max(value).alias("last"),
        F.min(following).alias("next_lo"), F.max(following).alias("next_hi"))
    upto = Window.partitionBy("node").orderBy("bin")
    summed = sums.select("*", F.sum("w").over(upto).alias("sum"), F.lag("last").over(upto).alias("previous"))
    reached = open_.join(summed, "node").where(F.col("below") + F.col("sum") >= F.col("target"))
    holds = reached.withColumn("nth", F.row_number().over(Window.partitionBy("node").orderBy("bin"))).where("nth = 1")
    before = F.col("below") + F.col("sum") - F.col("w")
    single = F.col("first") == F.col("last")
    found = (F.col("w") <= F.lit(tolerance)) | (single & F.col("next_lo").isNull())
    nearer = F.col("target") - before < before + F.col("w") - F.col("target")  # the side below the bin is nearer
    end = (F.when(nearer & F.col("previous").isNotNull(), F.col("previous")).when(nearer & (before > 0), F.col("first") - 1)
           .otherwise(F.col("last")))
    deeper = F.concat("fixed", F.array("first"))
    done = holds.select(
        "node", "leaves", "dim", "target", F.when(~found & single, deeper).otherwise(F.col("fixed")).alias("fixed"),
        F.when(single, F.col("next_lo")).otherwise(F.col("first")).alias("lo"), F.when(single, F.col("next_hi")).otherwise(F.col("last")).alias("hi"),
        before.alias("below"), F.when(found, F.concat("fixed", F.array(end))).alias("bound"))
    return searches.where("bound is not null").unionByName(done)


def leaf_of(points: DataFrame, run: Workspace, dims: list[str], ties: list[str], leaves: int, tolerance: float, bins: int) -> DataFrame:
    """``points`` (bigint ``size``, dims and ties, none null) with ``node``: the
    first shard of the leaf that holds each row. ``tolerance``: what one
    median may be off, in bytes."""
    spark = points.sparkSession
    spread = points.agg(*[(F.max(d) - F.min(d)).alias(d) for d in dims]).first()
    spread = {d: max(1, spread[d] or 0) for d in dims}
    rows = points.withColumn("node", F.lit(0).cast("long"))
    nodes, level = spark.createDataFrame([(0, leaves)], "node long, leaves long"), 0
    while leaves > 1 << level:
        nodes = run.table(nodes.where("leaves > 1"), f"nodes{level}")
        searches, turn = run.table(root_searches(rows, nodes, dims, spread), f"search{level}-0"), 0
        while not searches.where("bound is null").isEmpty():
            turn += 1
            searches = run.table(refine(rows, searches, dims, ties, tolerance, bins), f"search{level}-{turn}")
        bounds = searches.select("node", "dim", "bound", F.floor(F.col("leaves") / 2).cast("long").alias("half"))
        order = F.slice(order_of(F.col("dim"), dims, ties), F.lit(1), F.size("bound"))
        child = F.when(F.col("bound").isNull() | (order <= F.col("bound")), F.col("node")).otherwise(F.col("node") + F.col("half"))
        rows = run.table(rows.join(bounds, "node", "left").select(child.alias("node"), *points.columns), f"rows{level}")
        if level:
            run.drop(f"rows{level - 1}")
        half = F.floor(F.col("leaves") / 2).cast("long")
        nodes = nodes.select("node", half.alias("leaves")).unionByName(
            nodes.select((F.col("node") + half).alias("node"), (F.col("leaves") - half).alias("leaves")))
        level += 1
    return rows


def text_metadata(docs: DataFrame) -> DataFrame:
    """doc_id and the sharding metadata of each text: size (UTF-8 bytes plus
    8), characters, and its CRC-32."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("tie_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"), F.length(text).cast("long").alias("chars"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))


def with_slots(placed: DataFrame) -> DataFrame:
    """Number the rows of each shard from 0 without gaps. ``placed`` has
    ``part``, the task that wrote the row: rows are numbered within (shard,
    part), and the counts of earlier parts are added, so no shard is ordered
    by one task."""
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    local = F.row_number().over(Window.partitionBy("shard", "part").orderBy("tie_id", "text_crc32")) - 1
    return (placed.withColumn("local", local).join(offsets, ["shard", "part"])
            .withColumn("slot", F.col("offset") + F.col("local")).drop("offset", "local"))


def shard(docs: DataFrame, run: Workspace, shards: int | None = None, target_bytes: int | None = None,
          tolerance: float = 0.002, bins: int = 1024) -> DataFrame:
    """Documents with the shard (a leaf of the tree over size, characters and
    checksum) and slot of each, for a number of shards or their target bytes.
    Texts are read once, for their metadata. ``tolerance``: what one median
    may be off, as a share of a shard's bytes."""
    points = run.table(text_metadata(docs), "points")
    total = points.agg(F.sum("size")).first()[0] or 0
    leaves = shards or max(1, ceil(total / target_bytes))
    found = leaf_of(points, run, ["text_crc32", "chars", "size"], ["text_crc32", "tie_id"], leaves, tolerance * total / leaves, bins)
    return with_slots(run.table(found.withColumnRenamed("node", "shard").withColumn("part", F.spark_partition_id()), "placed"))
