"""SimHash near-duplicates by a binary trie self-join.

A text's fingerprint has bit b set if over half of its shingles' 64-bit hashes
do. Distinct fingerprints, sorted, are the leaves of a binary trie. The join
walks pairs of trie nodes at the same depth together: each step splits both
nodes on the next bit, a pair of differing children costs one error, and a
pair over the error budget is dropped with everything below it. Small nodes
are compared leaf by leaf.

On the cluster the sorted fingerprints are cut into blocks that share a
prefix of ``depth`` bits; a block meets the blocks whose prefix differs in at
most ``budget`` bits (found by an equi-join of prefixes and block ids on the
flipped prefixes, not by comparing blocks; the fingerprints join the pairs
afterwards, once a side), and each such pair of trie nodes is walked in one task. A
task returns a spanning forest of the links it found, at most one edge per
fingerprint, never all pairs of a group. Fingerprints are the nodes, so ids that are
null or repeated neither break nor make links. Components come from alternating
large-star and small-star rounds, each written to the run's folder.

Copies share a fingerprint and are one leaf with their smallest doc_id, so a
hot group of copies costs one row after a map-side minimum.

Edge cases: null and empty texts, and texts without words, have fingerprint
zero, which links like any other; a null doc_id is fingerprinted and links, and its
component is named by the non-null ids in it (null if none); a repeated doc_id
with different texts is in the component of each text;
repeated rows are repeated in the result; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, count
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.llm.common import free_name
from fleetscope.workspace import Workspace

SEED = 42  # fixed value: XXH64 seed of the contract
BLOCK = 16384  # fingerprints in one block: 128 KB


# --- fingerprints -----------------------------------------------------------


def shingle_hashes(text: bytes, words_per_shingle: int) -> np.ndarray:
    """XXH64 of every word shingle of a UTF-8 text, A-Z lower-cased; a text
    with fewer words is one shingle, one without words none."""
    words = text.lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= words_per_shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = words_per_shingle - 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - last].tolist(), ends[last:].tolist(), strict=True)),
                       np.uint64, len(words) - last)


def majority(hashes: np.ndarray, step: int = 1 << 16) -> int:
    """64-bit fingerprint: bits set in over half of the hashes."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), step):
        octets = hashes[i:i + step].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    bits = 2 * votes > len(hashes)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(docs: DataFrame, words_per_shingle: int = 4) -> DataFrame:
    """doc_id, ``fp``, the fingerprint as a signed 64-bit integer, and ``h``, a
    hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            fps = np.array([majority(shingle_hashes(texts[i].as_py() or b"", words_per_shingle))
                            for i in range(len(batch))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64)), batch.column("h")], ["doc_id", "fp", "h"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("h"))
    return narrow.mapInArrow(run, "doc_id long, fp long, h long")


# --- the trie join in one task ----------------------------------------------


class Trie:
    """Levels of a binary trie over sorted distinct fingerprints: per level
    the first leaf of each node and its children at the next level (-1: none)."""

    def __init__(self, leaves: np.ndarray):
        self.leaves = leaves
        self.node_of, self.bounds, self.children = map(cache, (self._node_of, self._bounds, self._children))

    def _node_of(self, depth: int) -> np.ndarray:
        """Node number of each leaf at ``depth``."""
        if depth == 0:
            return np.zeros(len(self.leaves), np.int64)
        prefix = self.leaves >> np.uint64(64 - depth)
        return np.concatenate(([0], np.cumsum(prefix[1:] != prefix[:-1])))

    def _bounds(self, depth: int) -> np.ndarray:
        """First leaf of each node at ``depth``, then the number of leaves."""
        ids = self.node_of(depth)
        return np.concatenate((np.searchsorted(ids, np.arange(ids[-1] + 1)), [len(ids)]))

    def _children(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Per node at ``depth``: its 0-child and 1-child at ``depth + 1``."""
        at, below = self.bounds(depth), self.node_of(depth + 1)
        first, last = at[:-1], at[1:] - 1
        bit = np.uint64(63 - depth)
        zero = np.where((self.leaves[first] >> bit) & np.uint64(1) == 0, below[first], -1)
        one = np.where((self.leaves[last] >> bit) & np.uint64(1) == 1, below[last], -1)
        return zero, one


def _expand(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Concatenated ranges lo[i] .. lo[i] + n[i] - 1."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n - lo, n)


def trie_links(left: np.ndarray, right: np.ndarray, budget: int, same: bool, labels: np.ndarray | None = None,
               small: int = 12, chunk: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaf index pairs (into ``left``, ``right``) within ``budget`` bits, in
    pieces. ``same``: both are one array, each pair comes once. ``labels``:
    component of each leaf, left then right; node pairs that lie wholly in one
    component are skipped, so a group already linked isn't walked again."""
    a, b = Trie(left), Trie(right)

    def uniform(trie: Trie, depth: int, of: np.ndarray) -> np.ndarray:
        at = trie.bounds(depth)[:-1]
        low, high = np.minimum.reduceat(of, at), np.maximum.reduceat(of, at)
        return np.where(low == high, low, -1)

    alike: dict[tuple[int, int], np.ndarray] = {}
    zero = np.zeros(1, np.int64)
    stack = [(0, zero, zero, zero)]
    while stack:
        depth, na, nb, err = stack.pop()
        if len(na) > chunk:
            for i in range(0, len(na), chunk):
                stack.append((depth, na[i:i + chunk], nb[i:i + chunk], err[i:i + chunk]))
            continue
        if labels is not None:
            for side, trie, of in ((0, a, labels[: len(left)]), (1, b, labels[len(labels) - len(right):])):
                if (side, depth) not in alike:
                    alike[side, depth] = uniform(trie, depth, of)
            one = alike[0, depth][na]
            keep = (one < 0) | (one != alike[1, depth][nb])
            na, nb, err = na[keep], nb[keep], err[keep]
        at_a, at_b = a.bounds(depth), b.bounds(depth)
        size_a, size_b = at_a[na + 1] - at_a[na], at_b[nb + 1] - at_b[nb]
        done = (size_a * size_b <= small) | (depth == 64)
        if done.any():
            lo_a, lo_b, n_a, n_b = at_a[na[done]], at_b[nb[done]], size_a[done], size_b[done]
            i = np.repeat(_expand(lo_a, n_a), np.repeat(n_b, n_a))
            j = _expand(np.repeat(lo_b, n_a), np.repeat(n_b, n_a))
            hit = np.bitwise_count(left[i] ^ right[j]) <= budget
            if same:
                hit &= i < j
            if hit.any():
                yield i[hit], j[hit]
        na, nb, err = na[~done], nb[~done], err[~done]
        if not len(na):
            continue
        (a0, a1), (b0, b1) = a.children(depth), b.children(depth)
        parts = []
        for ca, cb, cost in ((a0, b0, 0), (a1, b1, 0), (a0, b1, 1), (a1, b0, 1)):
            x, y, e = ca[na], cb[nb], err + cost
            keep = (x >= 0) & (y >= 0) & (e <= budget)
            if same and ca is a1 and cb is b0:
                keep &= na != nb  # the mirrored pair of one node
            parts.append((x[keep], y[keep], e[keep]))
        stack.append((depth + 1, *map(np.concatenate, zip(*parts, strict=True))))


def merge_labels(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest member of each leaf's component after adding edges u-v."""
    labels = labels.copy()
    while True:
        lu, lv = labels[u], labels[v]
        open_edges = lu != lv
        if not open_edges.any():
            return labels
        u, v, lu, lv = u[open_edges], v[open_edges], lu[open_edges], lv[open_edges]
        np.minimum.at(labels, np.maximum(lu, lv), np.minimum(lu, lv))
        while (labels[labels] != labels).any():
            labels = labels[labels]


def link_blocks(fps_a: np.ndarray, fps_b: np.ndarray | None, budget: int) -> np.ndarray:
    """Component labels over the leaves of block a, then block b (None: a with
    itself), from all pairs within the budget. One-bit links are merged first, so the
    full walk skips node pairs inside the groups they form."""
    same = fps_b is None
    right = fps_a if same else fps_b
    labels = np.arange(len(fps_a) + (0 if same else len(fps_b)))
    for radius in ([1, budget] if budget > 1 else [budget]):
        known = labels
        for i, j in trie_links(fps_a, right, radius, same, None if (known == np.arange(len(known))).all() else known):
            labels = merge_labels(labels, i, j if same else j + len(fps_a))
    return labels


# --- the join on the cluster ------------------------------------------------


def blocks(leaves: DataFrame, depth: int, block: int = BLOCK) -> DataFrame:
    """Sorted leaves (fp) cut into rows of at most ``block`` leaves that share
    their first ``depth`` bits: prefix, id (its first leaf), fps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps = np.empty(0, np.uint64)

        def rows(fps: np.ndarray, final: bool):
            prefix = fps >> np.uint64(64 - depth) if depth else np.zeros(len(fps), np.uint64)
            cuts = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1]))).tolist() + [len(fps)]
            out, done = [], 0
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                for i in range(lo, hi, block):
                    j = min(i + block, hi)
                    if final or j < len(fps):
                        out.append((int(prefix[i]), int(fps[i].view(np.int64)), fps[i:j].tobytes()))
                        done = j
            return out, done

        for batch in batches:
            fps = np.concatenate((fps, batch.column("fp").to_numpy().view(np.uint64)))
            if len(fps) >= 2 * block:
                out, done = rows(fps, False)
                fps = fps[done:]
                if out:
                    yield _block_batch(out)
        if len(fps):
            yield _block_batch(rows(fps, True)[0])

    unsigned = F.col("fp").bitwiseXOR(F.lit(-(1 << 63)))  # signed order of this is unsigned order of fp
    ordered = leaves.repartitionByRange(unsigned).sortWithinPartitions(unsigned)
    return ordered.mapInArrow(run, "prefix long, id long, fps binary")


def _block_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["prefix", "id", "fps"])


def block_pairs(cut: DataFrame, depth: int, budget: int) -> DataFrame:
    """Pairs of blocks whose prefixes differ in at most ``budget`` bits, once
    each (a block with itself included): id_a, fps_a, id_b, fps_b. Only
    prefixes and ids are copied per mask. Which of a pair's blocks comes first
    is decided by a checksum, so the pairs of no block gather in one task."""
    masks = [sum(1 << b for b in bits) for n in range(min(budget, depth) + 1) for bits in combinations(range(depth), n)]
    near = F.explode(F.array(*[F.col("prefix").bitwiseXOR(F.lit(m)) for m in masks]))
    met = (cut.select(near.alias("prefix"), F.col("id").alias("low")).join(cut.select("prefix", F.col("id").alias("high")), "prefix")
           .where("low <= high"))
    turned = F.pmod(F.xxhash64("low", "high"), F.lit(2)) == 1
    pairs = met.select(F.when(turned, F.col("high")).otherwise(F.col("low")).alias("id_a"),
                       F.when(turned, F.col("low")).otherwise(F.col("high")).alias("id_b"))
    first, second = (cut.select(F.col("id").alias(f"id_{s}"), F.col("fps").alias(f"fps_{s}")) for s in "ab")
    # not broadcast: the pairs must be dealt out with their bytes, not as a few ids
    return pairs.join(second.hint("merge"), "id_b").join(first.hint("merge"), "id_a")


def forest(pairs: DataFrame, budget: int) -> DataFrame:
    """Spanning forest (u, v), u > v, of the links inside each block pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                get = lambda name, row=row: batch.column(name)[row]
                same = get("id_a").as_py() == get("id_b").as_py()
                fps_a = np.frombuffer(get("fps_a").as_buffer(), np.uint64)
                fps_b = None if same else np.frombuffer(get("fps_b").as_buffer(), np.uint64)
                labels = link_blocks(fps_a, fps_b, budget)
                linked = np.flatnonzero(labels != np.arange(len(labels)))
                nodes = (fps_a if same else np.concatenate((fps_a, fps_b))).view(np.int64)
                u, v = nodes[linked], nodes[labels[linked]]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

    return pairs.mapInArrow(run, "u long, v long")


def components(edges: DataFrame, run: Workspace) -> DataFrame:
    """(node, root) for every node of an edge table (u, v): root is the
    smallest node of its component. Alternates large-star and small-star until
    nothing changes; each uses a partial minimum and a join, so a hub with
    many neighbours is not one task's group."""
    edges = run.table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc0")
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    state = edges.agg(mark).first()[0]
    for turn in count(1):
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges_next = run.table(hooked.union(down.select("u", F.col("m").alias("v"))).distinct(), f"cc{turn}")
        changed = edges_next.agg(mark).first()[0]
        run.drop(f"cc{turn - 1}")
        edges = edges_next
        if changed == state:
            break
        state = changed
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, run: Workspace, words_per_shingle: int = 4, budget: int = 4,
                    block: int = BLOCK) -> DataFrame:
    """doc_id, fp, h and component_id (smallest doc_id reachable over links of at
    most ``budget`` differing bits) of every document, and ``keeper``, the
    smallest fingerprint that document has in the component."""
    fps = run.table(fingerprints(docs, words_per_shingle), "fps")
    leaves = run.table(fps.groupBy("fp").agg(F.min("doc_id").alias("id")), "leaves")
    depth = max(0, ceil(log2(max(1, leaves.count()) / block)))
    cut = run.table(blocks(leaves.select("fp"), depth, block), "blocks")
    edges = forest(block_pairs(cut, depth, budget), budget)
    roots = components(edges, run).withColumnRenamed("node", "fp")
    rooted = run.table(leaves.join(roots, "fp", "left").select("fp", "id", F.coalesce("root", "fp").alias("root")), "rooted")
    first = rooted.where("id is not null").groupBy("root").agg(F.min(F.struct("id", "fp")).alias("first"))
    named = rooted.join(first, "root", "left").select("fp", F.col("first.id").alias("component_id"), F.col("first.fp").alias("keeper"))
    return fps.join(named, "fp").select("doc_id", "fp", "h", "component_id", "keeper")


def keepers(docs: DataFrame, run: Workspace) -> DataFrame:
    """One row of each component that has a doc_id: of the rows of its smallest
    doc_id, one with the smallest fingerprint and then text hash."""
    h, row = free_name(docs, "_hash"), free_name(docs, "_row")
    own = near_duplicates(docs, run).where("doc_id = component_id and fp = keeper")
    chosen = own.groupBy("doc_id", "fp").agg(F.min("h").alias(h)).select("doc_id", h)
    hashed = docs.withColumn(h, F.xxhash64("text")).join(chosen, ["doc_id", h], "left_semi")
    order = Window.partitionBy("doc_id", h).orderBy("doc_id")
    return hashed.withColumn(row, F.row_number().over(order)).where(F.col(row) == 1).select(*docs.columns)
