"""Document fingerprints: SimHash of 128 bits, and the search that finds all
fingerprints within a Hamming radius.

A text's terms are its three-word shingles (A-Z lower-cased; a shorter text is
one term). Each term's hash votes with the term's bytes as weight: a set bit
for, a clear bit against. A fingerprint bit is set if the sum is positive.
The votes are whole numbers, so equal texts have equal fingerprints wherever
they are computed. Term hashes of many texts are computed together from
running polynomial sums over their bytes.

The search cuts fingerprints into ``TABLES`` blocks. Of two fingerprints within
the radius, some block differs in at most ``radius // TABLES`` bits, so one table
per block, probed with the block's value and every value that few flips away,
finds every pair; a pair is taken from its first table only. Queries and index
are dealt out by hash to cells of bounded size, each query cell meeting each
index cell, and a task gives counts, not pairs, so a large group of near copies
is neither one task nor the square of its rows. Equal fingerprints are one row
with a count.

The radius comes from near copies: on sf0.1 the pairs of different texts with a
Jaccard likeness of 0.8 or more lie up to 23 bits apart (see the README).

Edge cases: null and empty texts, and texts without words, have fingerprint
zero; n_chars of null is 0; repeated rows and equal doc_ids are ordered by
text; a null doc_id sorts first; with one document it is its own next one;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.workspace import Workspace

BITS = 128
RADIUS = 23
TABLES = 8  # blocks of 16 bits
CELL, MIN_CELLS = 1 << 18, 64
SHINGLE = 3
_STEP = 1 << 16  # most terms per vote sum
_BYTES = 1 << 20
_PAIRS = 1 << 20  # candidate pairs compared at a time
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_ODD = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_ODD ** i and its inverse, modulo 2 ** 64, for i < n."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 2 * _BYTES)
        for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (splitmix constants)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and weight of every term of the texts, and each text's first term
    (with the total at the end)."""
    joined = b"\n".join(t.lower() for t in texts) + b"\n"
    a = np.frombuffer(joined, np.uint8)
    space = _SPACE[a]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[::2], edge[1::2]
    up, down = _powers(len(a) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)))
    word = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    words_to = np.searchsorted(start, text_ends)
    words_from = np.concatenate(([0], words_to[:-1]))
    n = words_to - words_from
    n_terms = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    firsts = np.concatenate(([0], np.cumsum(n_terms)))
    at = np.arange(firsts[-1]) - np.repeat(firsts[:-1] - words_from, n_terms)
    length = np.repeat(np.minimum(n, SHINGLE), n_terms)
    h, padded = np.zeros(len(at), np.uint64), np.concatenate((word, np.zeros(SHINGLE, np.uint64)))
    for i in range(SHINGLE):
        h = np.where(i < length, mix(h * np.uint64(_ODD) + padded[at + i]), h)
    weight = end[at + length - 1] - start[at] if len(at) else at
    return h, weight, firsts


def simhash(h: np.ndarray, weight: np.ndarray) -> bytes:
    """The 128-bit fingerprint of one text's terms, as 16 bytes."""
    votes = np.zeros(BITS)
    heaviest = int(weight.max(initial=1))
    kind, exact = (np.float32, 1 << 24) if heaviest < 1 << 16 else (np.float64, 1 << 53)  # sums below stay exact
    step = max(1, min(_STEP, exact // heaviest))
    for i in range(0, len(h), step):
        part, w = h[i:i + step], weight[i:i + step].astype(kind)
        both = np.stack((part, mix(part ^ np.uint64(_ODD))), axis=1).astype(">u8").view(np.uint8)
        votes += 2.0 * (w @ np.unpackbits(both, axis=1).astype(kind)) - w.sum(dtype=np.float64)
    return np.packbits(votes > 0).tobytes()


def fingerprint_texts(texts: list[bytes]) -> list[bytes]:
    """Fingerprints of UTF-8 texts, about a megabyte of them at a time."""
    out, group, size = [], [], 0
    for i, t in enumerate(texts):
        group.append(t)
        size += len(t)
        if size >= _BYTES or i == len(texts) - 1:
            h, weight, firsts = terms(group)
            out += [simhash(h[a:b], weight[a:b]) for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
            group, size = [], 0
    return out


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bits."""
    return 1 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / BITS


def fingerprint_column(text: Column) -> Column:
    """Fingerprint of each text as 32 hex digits (general use)."""

    @F.pandas_udf("string")
    def run(texts):
        return type(texts)([f.hex() for f in fingerprint_texts([(t or "").encode("utf-8", "surrogatepass") for t in texts])])

    return run(text)


# --- a document, its edited text and the next document -----------------------


def edited_text(text: str, following: str) -> str:
    """The last half of the text (rounded down) replaced by the first as many
    characters of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                     ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def compare(rows: list[tuple[int, str, bytes]], following: list[tuple[str, bytes]]) -> pa.RecordBatch:
    """Result rows of (doc_id, text, fingerprint), each with the text and
    fingerprint of its next document."""
    edited = [edited_text(text, other).encode("utf-8", "surrogatepass") for (_, text, _), (other, _) in zip(rows, following, strict=True)]
    edited_fps = fingerprint_texts(edited)
    out = [(doc_id, len(text), hashlib.sha256(e).hexdigest(), fp.hex(), efp.hex(), likeness(fp, efp), likeness(fp, nfp))
           for (doc_id, text, fp), (_, nfp), e, efp in zip(rows, following, edited, edited_fps, strict=True)]
    columns = list(zip(*out, strict=True)) if out else [[]] * len(_RESULT)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _RESULT.types, strict=True)], schema=_RESULT)


def compare_neighbours(docs: DataFrame, run: Workspace) -> DataFrame:
    """Every document compared with its edited text and the next document by
    doc_id. Documents are range-partitioned once; a task walks its part in
    order, holding one batch. The first and last document of each part are set
    aside, and the lasts are joined to the firsts of the next part."""
    text = F.coalesce(F.col("text"), F.lit(""))
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting, edges = TaskContext.get().partitionId(), None, []

        def done(result: pa.RecordBatch, side: int | None = None, row=None) -> pa.RecordBatch:
            n = len(result)
            extra = [pa.array([side] * n, pa.int32()), pa.array([part] * n, pa.int64()), pa.array([None] * n, pa.string())]
            return pa.RecordBatch.from_arrays([*result.columns, *extra], [*_RESULT.names, "side", "part", "text"])

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            if not ids:
                continue
            for lo in range(0, len(ids), 256):
                some = texts[lo:lo + 256]
                rows = list(zip(ids[lo:lo + 256], some, fingerprint_texts([t.encode("utf-8", "surrogatepass") for t in some]), strict=True))
                if waiting is None:
                    edges.append((0, rows[0]))
                else:
                    rows.insert(0, waiting)
                waiting = rows[-1]
                if len(rows) > 1:
                    yield done(compare(rows[:-1], [(t, fp) for _, t, fp in rows[1:]]))
        if waiting is not None:
            edges.append((1, waiting))
            n = len(edges)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for _, r in edges], pa.int64()), *[pa.nulls(n, t) for t in _RESULT.types[1:]],
                 pa.array([s for s, _ in edges], pa.int32()), pa.array([part] * n, pa.int64()), pa.array([r[1] for _, r in edges])],
                [*_RESULT.names, "side", "part", "text"])

    parts = run.table(ordered.mapInArrow(walk, RESULT + ", side int, part long, text string"), "parts")
    firsts, lasts = parts.where("side = 0"), parts.where("side = 1")
    # Numbers of the parts that hold documents, each with the next one's (after the last: the first): one narrow row per task.
    numbers = lasts.select("part").withColumn("next_part", F.lead("part").over(Window.orderBy("part")))
    numbers = numbers.withColumn("next_part", F.coalesce("next_part", F.min("part").over(Window.partitionBy())))
    seams = lasts.select("doc_id", "text", "part").join(numbers, "part").join(
        firsts.select(F.col("part").alias("next_part"), F.col("text").alias("following")), "next_part").select("doc_id", "text", "following")

    def seam(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, others = (c.to_pylist() for c in batch.columns)
            fps = fingerprint_texts([t.encode("utf-8", "surrogatepass") for t in texts + others])
            yield compare(list(zip(ids, texts, fps[: len(ids)], strict=True)), list(zip(others, fps[len(ids):], strict=True)))

    return parts.where("side is null").select(*_RESULT.names).unionByName(seams.mapInArrow(seam, RESULT))


# --- search ------------------------------------------------------------------


def near_pairs(queries: np.ndarray, index: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, found) row numbers of all pairs at most ``radius`` bits apart,
    each once, in parts. Fingerprints are rows of ``TABLES`` 16-bit blocks."""
    flips = [sum(1 << b for b in bits) for k in range(radius // TABLES + 1) for bits in combinations(range(16), k)]
    whole_q, whole_i = (np.ascontiguousarray(x).view(np.uint64) for x in (queries, index))
    for t in range(TABLES):
        order = np.argsort(queries[:, t], kind="stable")
        starts = np.searchsorted(queries[order, t], np.arange((1 << 16) + 1))
        for flip in flips:
            value = index[:, t] ^ np.uint16(flip)
            first = starts[value]
            sizes = starts[value.astype(np.int64) + 1] - first
            rows = np.flatnonzero(sizes)
            first, ends = first[rows], np.cumsum(sizes[rows])
            for lo in range(0, int(ends[-1]) if len(rows) else 0, _PAIRS):
                k = np.arange(lo, min(lo + _PAIRS, int(ends[-1])))
                at = np.searchsorted(ends, k, "right")
                i = rows[at]
                q = order[first[at] + k - (ends[at] - sizes[i])]
                near = np.bitwise_count(whole_q[q, 0] ^ whole_i[i, 0]) + np.bitwise_count(whole_q[q, 1] ^ whole_i[i, 1]) <= radius
                q, i = q[near], i[near]
                if t:
                    fresh = (np.bitwise_count(queries[q, :t] ^ index[i, :t]) > radius // TABLES).all(axis=1)
                    q, i = q[fresh], i[fresh]
                if len(q):
                    yield q, i


def _blocks(fps: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(fps.to_pylist())), np.uint16).reshape(-1, TABLES)


def _in_cells(index: DataFrame, queries: DataFrame, cells: tuple[int, int], search, schema: str) -> DataFrame:
    """``search`` (query table, index table) -> table, on each pair of cells."""
    n, m = cells
    own = [F.pmod(F.xxhash64("fp"), F.lit(k)).alias(name) for k, name in ((n, "cell"), (m, "query_cell"))]
    every = [F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))).alias(name) for k, name in ((n, "cell"), (m, "query_cell"))]
    i = index.select("*", own[0]).select("*", every[1]).groupBy("cell", "query_cell")
    q = queries.select("*", own[1]).select("*", every[0]).groupBy("cell", "query_cell")
    return q.cogroup(i).applyInArrow(search, schema)


def within_radius(index: DataFrame, queries: DataFrame, radius: int = RADIUS, cells: tuple[int, int] = (MIN_CELLS, 1)) -> DataFrame:
    """All (query, found) pairs of distinct fingerprints (column ``fp``, hex
    digits) at most ``radius`` bits apart, each once, searched in so many cells
    of the index and of the queries."""

    def search(q: pa.Table, i: pa.Table) -> pa.Table:
        parts = list(near_pairs(_blocks(q["fp"]), _blocks(i["fp"]), radius)) if len(q) and len(i) else []
        a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*parts, strict=True) if parts else ([], [])))
        return pa.table({"query": q["fp"].take(pa.array(a)), "found": i["fp"].take(pa.array(b))})

    return _in_cells(index.select("fp"), queries.select("fp"), cells, search, "query string, found string")


def neighbour_counts(fps: DataFrame, run: Workspace, is_query: Column, radius: int = RADIUS) -> DataFrame:
    """(fp, n_near): for each fingerprint of a query row, how many rows lie
    within the radius, itself included."""
    distinct = run.table(fps.groupBy("fp").agg(F.count("*").alias("n"), F.max(F.coalesce(is_query, F.lit(False))).alias("asked")), "distinct")
    queries = distinct.where("asked").select("fp")
    cells = max(MIN_CELLS, ceil(distinct.count() / CELL)), max(1, ceil(queries.count() / CELL))

    def search(q: pa.Table, i: pa.Table) -> pa.Table:
        near, n = np.zeros(len(q), np.int64), i["n"].to_numpy()
        for a, b in near_pairs(_blocks(q["fp"]), _blocks(i["fp"]), radius) if len(q) and len(i) else ():
            np.add.at(near, a, n[b])
        some = np.flatnonzero(near)
        return pa.table({"fp": q["fp"].take(pa.array(some)), "n_near": pa.array(near[some])})

    return (_in_cells(distinct.select("fp", "n"), queries, cells, search, "fp string, n_near long")
            .groupBy("fp").agg(F.sum("n_near").alias("n_near")))
