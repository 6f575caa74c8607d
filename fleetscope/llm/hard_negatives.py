"""Hard negatives of anchor vectors by Kronecker-packed integer products.

The rows of a block are packed component by component: the i-th components of
all its candidates, biased to be non-negative, lie in separated fields of one
wide integer. An anchor multiplies each wide integer once by its own i-th
component and adds up; since no field overflows into the next, the fields of
the sum are the block's exact inner products (after the bias is taken out).
The field width follows from the largest components present, so products are
exact for any integers.

Anchors are dealt into blocks of at most ``COMPONENTS`` numbers (checked, not
hoped for) that are broadcast one after the other; each is one scan of the rows for the
positives and one for the negatives, whose results are written before the next
block starts. A scan yields at most a few rows per anchor and row block, so
nothing is collected per label or per anchor: a label holding a third of all
rows is spread over all tasks. The first scan multiplies an anchor only with
the rows of its own label.

Rows: a row with a null id, a null label, a null vector, or a null or
non-finite component takes no part. Missing components of a shorter vector
count as 0. Rows that repeat an id are rows of their own; another row than the
anchor is one with another id. Equal anchor rows give their results once.
Ties in the score go to the smaller id. An anchor without another row of its
label, or whose window holds no row, gives no rows; an empty table gives none.
A component or score beyond 64 bits raises. Extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.workspace import Workspace

SCALE = 256  # fixed value: components are floor(256 * x)
COMPONENTS = 1 << 19  # most components of anchors broadcast at once (or one anchor's)
BLOCK = 4096  # most candidates in one wide integer


def quantised(rows: DataFrame, key: Column, label: Column, vector: Column) -> DataFrame:
    """(id, label, v) of the rows that take part; v: 64-bit integers."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    taking = rows.select(key.cast("long").alias("id"), label.cast("long").alias("label"), vector.alias("x"), finite.alias("ok"))
    return taking.where("id is not null and label is not null and x is not null and ok").select(
        "id", "label", F.transform("x", lambda x: _floor(x.cast("double") * SCALE)).alias("v"))


def _floor(x: Column) -> Column:
    return F.when(F.abs(x) < 2.0**62, F.floor(x).cast("long")).otherwise(F.raise_error(F.lit("component beyond 64 bits")).cast("long"))


class Packed:
    """Candidates' components as fields of wide integers, one per dimension."""

    def __init__(self, vectors: np.ndarray, most: int):
        """``most``: largest absolute component of the anchors to come."""
        self.n, self.d = vectors.shape
        self.bias = -min(0, int(vectors.min(initial=0)))
        widest = int(vectors.max(initial=0)) + self.bias
        self.offset = self.d * widest * most  # keeps every field of a sum non-negative
        bits = max(1, (2 * self.offset).bit_length())
        self.bytes = next((b for b in (2, 4, 8) if 8 * b >= bits), -(-bits // 8))
        self.ones = self._wide(np.ones(self.n, "u8"))
        column = vectors.astype(object) if widest >= 1 << 62 else vectors
        self.wide = [self._wide(column[:, i] + self.bias) for i in range(self.d)]

    def _wide(self, fields: np.ndarray) -> int:
        if self.bytes <= 8:
            return int.from_bytes(fields.astype(f"<u{self.bytes}").tobytes(), "little")
        return int.from_bytes(b"".join(int(f).to_bytes(self.bytes, "little") for f in fields), "little")

    def scores(self, anchor: list[int]) -> np.ndarray:
        """Exact inner products of the anchor with every candidate."""
        total = self.ones * self.offset
        for a, wide in zip(anchor, self.wide, strict=False):
            if a:
                total += a * wide
        raw, back = total.to_bytes(self.n * self.bytes, "little"), self.offset + self.bias * sum(anchor[: self.d])
        if self.bytes <= 8 and back < 1 << 62 and self.offset < 1 << 61:
            return np.frombuffer(raw, f"<u{self.bytes}").astype(np.int64) - back
        fields = (int.from_bytes(raw[i: i + self.bytes], "little") - back for i in range(0, len(raw), self.bytes))
        return np.array([_long(f) for f in fields], np.int64)


def _long(value: int) -> int:
    if not -(1 << 63) <= value < 1 << 63:
        raise OverflowError(f"score {value} does not fit 64 bits")
    return value


def row_blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors) of at most ``size`` rows each, vectors padded with zeros."""
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            part = batch.slice(start, size)
            ids, labels, v = (part.column(i) for i in range(3))
            lengths = np.diff(v.offsets.to_numpy())
            vectors = np.zeros((len(ids), int(lengths.max(initial=0))), np.int64)
            vectors[np.arange(vectors.shape[1]) < lengths[:, None]] = v.flatten().to_numpy()
            yield ids.to_numpy(), labels.to_numpy(), vectors


def best(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Positions by descending score, then ascending id."""
    return np.lexsort((ids, -scores))


POSITIVES = "anchor long, positive_score long, positive_id long"
NEGATIVES = "anchor long, positive long, negative_score long, negative_id long"


def _rows(columns: list[list[np.ndarray]], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    arrays = [pa.array(np.concatenate(c) if c else np.zeros(0), pa.int64()) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def score_positives(rows: DataFrame, anchors, n: int, block: int) -> DataFrame:
    """Per anchor and row block, the best ``n`` other rows of the label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, by_label = pickle.loads(anchors.value), defaultdict(list)
        for number, _, label, vector, _ in known:
            by_label[label].append((number, vector))
        most = _most(known)
        ids_of = {number: key for number, key, *_ in known}
        for ids, labels, vectors in row_blocks(batches, block):
            out = [[], [], []]
            order = np.argsort(labels, kind="stable")
            cuts = np.flatnonzero(np.diff(labels[order])) + 1
            for own in np.split(order, cuts) if len(order) else []:
                asking = by_label.get(int(labels[own[0]]), [])
                packed = Packed(vectors[own], most) if asking else None
                for number, vector in asking:
                    other = np.flatnonzero(ids[own] != ids_of[number])
                    scores = packed.scores(vector)[other]
                    found = ids[own][other]
                    first = best(scores, found)[:n]
                    _put(out, number, scores[first], found[first])
            yield _rows(out, POSITIVES)

    return rows.mapInArrow(run, POSITIVES)


def score_negatives(rows: DataFrame, anchors, n: int, window: tuple[int, int, int], block: int) -> DataFrame:
    """Per anchor, positive and row block, the best ``n`` rows of other labels
    whose score lies between the window's shares of the positive's."""
    low, high, unit = window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [a for a in pickle.loads(anchors.value) if a[4]]
        most = _most(known)
        for ids, labels, vectors in row_blocks(batches, block):
            packed, out = Packed(vectors, most), [[], [], [], []]
            for number, _, label, vector, positives in known:
                bounds = [(-(-low * p // unit), high * p // unit) for _, p in positives]
                scores = packed.scores(vector)
                fits = np.flatnonzero((labels != label) & (scores >= min(b[0] for b in bounds)) & (scores <= max(b[1] for b in bounds)))
                if not len(fits):
                    continue
                fits = fits[best(scores[fits], ids[fits])]
                down = -scores[fits]
                for position, (lo, hi) in enumerate(bounds):
                    start = np.searchsorted(down, -hi)
                    first = fits[start: start + n]
                    first = first[scores[first] >= lo]
                    _put(out, number, np.full(len(first), position), scores[first], ids[first])
            yield _rows(out, NEGATIVES)

    return rows.mapInArrow(run, NEGATIVES)


def _put(out: list[list[np.ndarray]], number: int, *columns: np.ndarray) -> None:
    if len(columns[0]):
        for target, values in zip(out, (np.full(len(columns[0]), number), *columns), strict=True):
            target.append(values)


def _most(known: list[tuple]) -> int:
    return max((abs(x) for a in known for x in a[3]), default=0)


def _first(found: DataFrame, keys: list[str], score: str, key: str, n: int) -> DataFrame:
    """The first ``n`` rows per keys; cut before the shuffle as well."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(key))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def numbered_blocks(anchors: DataFrame, run: Workspace, most: int) -> tuple[DataFrame, int]:
    """The anchors with a block number; no block has over ``most`` anchors.
    Blocks are hash buckets, made smaller until the fullest fits."""
    blocks = -(-anchors.count() // most)
    while blocks:
        dealt = anchors.withColumn("block", F.pmod(F.xxhash64("id", "label", "v", F.lit(blocks)), F.lit(blocks)))
        if blocks == 1 or dealt.groupBy("block").count().agg(F.max("count")).first()[0] <= most:
            return run.table(dealt, "anchors"), blocks
        blocks = blocks + blocks // 4 + 1
    return anchors.withColumn("block", F.lit(0)), 0


def mine(rows: DataFrame, is_anchor: Column, run: Workspace, positives: int = 5, negatives: int = 10,
         window: tuple[int, int, int] = (30, 90, 100), components: int = COMPONENTS, block: int = BLOCK) -> DataFrame:
    """Hard negatives from quantised rows (id, label, v): for each anchor
    (``is_anchor``, over id and label) and each of its best ``positives``
    other rows of the label, the best ``negatives`` rows of other labels with
    window[0] * positive <= window[2] * negative <= window[1] * positive.
    Returns anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score."""
    spark = rows.sparkSession
    rows = run.table(rows, "rows")
    anchors = rows.where(is_anchor).distinct()
    longest = anchors.agg(F.max(F.size("v"))).first()[0] or 1
    anchors, blocks = numbered_blocks(anchors, run, max(1, components // longest))
    out = None
    for b in range(blocks):
        known = [(i, r.id, r.label, list(r.v), []) for i, r in enumerate(anchors.where(F.col("block") == b).orderBy("id", "label", "v").collect())]
        shared = spark.sparkContext.broadcast(pickle.dumps(known))
        found = _first(score_positives(rows, shared, positives, block), ["anchor"], "positive_score", "positive_id", positives)
        for r in run.table(found, f"positives{b}").orderBy("anchor", "rank").collect():  # at most ``positives`` per anchor
            known[r.anchor][4].append((r.positive_id, r.positive_score))
        shared.unpersist()
        shared = spark.sparkContext.broadcast(pickle.dumps(known))
        found = _first(score_negatives(rows, shared, negatives, window, block), ["anchor", "positive"], "negative_score", "negative_id", negatives)
        names = spark.createDataFrame([(i, p, a[1], key, score) for i, a in enumerate(known) for p, (key, score) in enumerate(a[4])],
                                      "anchor long, positive long, anchor_id long, positive_id long, positive_score long")
        part = run.table(found.join(names, ["anchor", "positive"]).select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), f"negatives{b}")
        shared.unpersist()
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out
