"""Divergence of sources within their language, over a cube of cells.

Groups are (lang, source) pairs; a group's share of a term is its smoothed
count, as an integer p. The divergence of two groups is the sum over the
language's kept terms of f(p, q) = (p - q)^2 // (p + q), exact in integers.

The work is a cube per language: its groups are dealt into blocks along two
axes and its terms along the third. A task owns one (group block, group block,
term block) cell, gets the two blocks' slices of the term block (each slice is
replicated to the cells of its row and column), and computes the partial
divergences of all its pairs; cells of one pair are summed along the term axis
by an ordinary aggregation. A cell sees only terms that occur in one of its
slices. Kept terms that occur in neither group contribute one known value
each, which is added, times their number, when the axis is reduced. A cell
holds at most about ``GROUPS`` x ``TERMS`` counts a side; blocks are hash
buckets, so neither depends on the data's order or on a hot source, and a
frequent term is one count per group.

Words are counted inside the tasks that read the texts; counts leave a task
as one row per group and term and are summed by Spark.

Rows: null text, lang and source are ''; a group without terms still takes
part; repeated rows count as documents of their own; an empty table gives no
rows; extra columns are ignored. A language without kept terms has pairs of
value 0 and no terms.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.workspace import Workspace

MIN_DOCUMENTS = 10  # fixed value: documents of the language that hold a kept term
UNIT = 1_000_000_000  # fixed value: shares are in billionths
SMOOTHING = 2  # fixed value: added to every count
GROUPS, TERMS = 32, 8192  # wanted size of a cell's sides
HELD = 1 << 19  # most counts a task holds before it passes them on

# Fixed value: bytes of terms. A-Z become a-z; a-z and what is not ASCII stay; all others part terms.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents per (lang, source, term) of a task's texts."""
    held: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            names = [t.decode() for t in n]
            columns = [[lang] * len(n), [source] * len(n), names, list(n.values()), list(map(docs.__getitem__, n))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _COUNTS.types, strict=True)], schema=_COUNTS)
        held.clear()

    for batch in batches:
        langs, sources, texts = batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text")
        for i, key in enumerate(zip(langs, sources, strict=True)):
            found = terms(texts[i].as_py())
            n, docs = held[key]
            n.update(found)
            docs.update(set(found))
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from rows()
    yield from rows()


def kept_counts(docs: DataFrame, run: Workspace, min_documents: int = MIN_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """(counts, groups): occurrences n of kept terms per (lang, source, term),
    and one row per occurring (lang, source) with its total of n and its
    language's number v of kept terms."""
    empty = F.lit("")
    plain = docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"),
                        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    schema = "lang string, source string, term string, n long, docs long"
    counts = run.table(plain.mapInArrow(_counts, schema).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_documents).select("lang", "term")
    counts = run.table(counts.drop("docs").join(kept, ["lang", "term"]), "kept")
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    known = counts.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("v"))
    zero = F.lit(0).cast("long")
    groups = (plain.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(known, "lang", "left")
              .select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("v", zero).alias("v")))
    return counts, run.table(groups, "groups")


def share(n: str, total: str, v: str) -> F.Column:
    """1 + floor(UNIT * (n + s) / (total + s * v)) in decimals, as a long."""
    return F.expr(f"1 + (cast({UNIT} as decimal(12,0)) * cast({n} + {SMOOTHING} as decimal(20,0))) div cast({total} + {SMOOTHING} * {v} as decimal(20,0))").cast("long")


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


_PARTIAL = "lang string, source string, other string, value long, met long"


def _cell(key: tuple, rows: pa.Table) -> pa.Table:
    """Partial divergences of one cell: for every pair of its groups, the sum
    over the terms met in the cell's slices, and their number. ``side`` tells
    row groups (0) from column groups (1); a diagonal cell has one side."""
    lang, first, second = (k.as_py() for k in key[:3])
    source, term = (rows.column(name).combine_chunks().dictionary_encode() for name in ("source", "term"))
    group, names = source.indices.to_numpy(), source.dictionary.to_pylist()
    side, base = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    side[group], base[group] = rows.column("side").to_numpy(), rows.column("base").to_numpy()
    shares = np.repeat(base[:, None], len(term.dictionary), axis=1)
    counted = rows.column("p").is_valid().to_numpy()
    shares[group[counted], term.indices.drop_null().to_numpy()] = rows.column("p").drop_null().to_numpy()
    order = np.argsort(side, kind="stable")
    out: list[tuple] = []
    for i, a in enumerate(order):
        others = order[i + 1:] if first == second else order[side[order] == 1] if side[a] == 0 else order[:0]
        for b, value in zip(others, divergence(shares[a], shares[others]).sum(axis=1).tolist(), strict=True):
            out += [(lang, names[a], names[b], value, shares.shape[1]), (lang, names[b], names[a], value, shares.shape[1])]
    types = [pa.string()] * 3 + [pa.int64()] * 2
    columns = zip(*out, strict=True) if out else [[]] * 5
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in _PARTIAL.split(", ")])


def pair_divergences(counts: DataFrame, groups: DataFrame, run: Workspace, per_groups: int = GROUPS, per_terms: int = TERMS) -> DataFrame:
    """(lang, source, other, value) for all ordered pairs of a language's groups."""
    axes = groups.groupBy("lang").agg(F.ceil(F.count("*") / per_groups).cast("int").alias("blocks"),
                                      F.greatest(F.lit(1), F.ceil(F.max("v") / per_terms)).cast("int").alias("layers"))
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block")
    based = F.when(F.col("v") > 0, share("0", "total", "v")).otherwise(F.lit(1)).alias("base")
    groups = run.table(groups.join(axes, "lang").select("lang", "source", "total", "v", "blocks", "layers", block, based), "blocks")
    layer = F.pmod(F.xxhash64("term"), F.col("layers")).cast("int").alias("layer")
    slices = counts.join(groups, ["lang", "source"]).select(
        "lang", "source", "blocks", "block", "base", layer, "term", share("n", "total", "v").alias("p"))
    # one row without a term makes a group known to all its cells, whatever it holds there
    known = groups.select("lang", "source", "blocks", "block", "base", F.explode(F.expr("sequence(0, layers - 1)")).alias("layer"),
                          F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("p"))
    other = F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")
    cells = (slices.unionByName(known).select("*", other)
             .select("lang", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "layer",
                     F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"), "source", "base", "term", "p"))
    partial = cells.groupBy("lang", "first", "second", "layer").applyInArrow(_cell, _PARTIAL)
    summed = partial.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"), F.sum("met").alias("met"))
    ends = groups.select("lang", "source", "base", "v")
    rest = F.expr("(v - met) * (((base - base2) * (base - base2)) div (base + base2))")
    return (summed.join(ends, ["lang", "source"])
            .join(ends.select("lang", F.col("source").alias("other"), F.col("base").alias("base2")), ["lang", "other"])
            .select("lang", "source", "other", F.when(F.col("v") > 0, F.col("value") + rest).otherwise(F.lit(0)).cast("long").alias("value")))


def leading_terms(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, term, value) of terms with a larger share in the group
    than in its language."""
    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"))
    totals = groups.groupBy("lang").agg(F.sum("total").alias("all_total"))
    rows = (counts.join(groups, ["lang", "source"]).join(totals, "lang").join(whole, ["lang", "term"])
            .select("lang", "source", "term", share("n", "total", "v").alias("p"), share("all_n", "all_total", "v").alias("q")))
    return rows.where("p > q").select("lang", "source", "term", F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))


def audit(docs: DataFrame, run: Workspace, top: int = 10, per_groups: int = GROUPS, per_terms: int = TERMS) -> DataFrame:
    """Parts ``pair`` (all other sources of the language) and ``term`` (the
    ``top`` leading terms) of every group: lang, source, part, item, value, rank."""
    counts, groups = kept_counts(docs, run)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")

    def ranked(rows: DataFrame, part: str, item: str) -> DataFrame:
        return rows.select("lang", "source", F.lit(part).alias("part"), F.col(item).alias("item"), "value").withColumn(
            "rank", F.row_number().over(order).cast("int"))

    pairs = ranked(pair_divergences(counts, groups, run, per_groups, per_terms), "pair", "other")
    return pairs.unionByName(ranked(leading_terms(counts, groups), "term", "term").where(F.col("rank") <= top))
