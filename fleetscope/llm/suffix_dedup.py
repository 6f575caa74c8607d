"""Suffix-array dedup: removes every byte covered by a 100-byte string that
also starts earlier in the corpus.

Suffixes are sorted by the difference-cover algorithm (DC3): triples at the
positions 1 and 2 modulo 3 are sorted and named, the string of names is solved
by recursion unless all names differ, the remaining suffixes are sorted by their
first symbol and the rank behind it, and the two orders are merged. Then the
100-byte prefixes of adjacent suffixes are compared: runs of equal ones are the
repeats, and all but the earliest start are marked.

The corpus-wide order is dealt out by content. Each 100-byte window is filed
under its anchor, the 48-byte string in it with the smallest hash (the leftmost
of equals), which depends on the window's bytes alone: equal windows have the same
anchor at the same offset. So windows of different anchors need no
comparison, and the suffixes of one anchor's contexts (the stretch of text
around it that its windows cover) can be sorted apart from all others. Anchors
that occur once in the corpus cannot hold a repeat; a Bloom filter of the
repeated ones, of bounded size, spares their contexts the shuffle (a false
hit only adds a context to sort). Equal contexts are sorted once.

An anchor with more than ``HOT`` occurrences is not put in one task: its equal
contexts, and then the windows of the rest, are grouped by their bytes with
partial minima, which is exact.

Order of starts: doc_id, then a hash of the text (rows with one doc_id), then
position. Edge cases: a null text is the empty text; texts shorter than the
string length lose nothing; a null doc_id comes before all others; a repeated
row (same doc_id and text) is the same document and loses the same bytes; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import tidy
from fleetscope.workspace import Workspace

LENGTH = 100
GRAM = 48
HOT = 1 << 16
BROADCAST_ROWS = 1 << 20
MAX_FILTER_BITS = 1 << 28
BUCKET = 1 << 20  # bytes of contexts sorted together (more if one anchor has more)
_SEGMENT = 1 << 18  # window starts handled at once; the position takes the low bits of the sort key
_MULT = 0x9E3779B97F4A7C15
_FIRST = -(1 << 63)


# --- difference-cover suffix sorting -----------------------------------------


def _pack(columns: list[np.ndarray], bits: int) -> np.ndarray:
    """One sortable 64-bit key from equally ordered columns of ``bits`` bits."""
    key, used = columns[0].astype(np.uint64), bits
    for column in columns[1:]:
        if used + bits > 64:
            key, used = np.unique(key, return_inverse=True)[1].astype(np.uint64), bits
        key, used = (key << np.uint64(bits)) | column.astype(np.uint64), used + bits
    return key


def suffix_ranks(s: np.ndarray) -> np.ndarray:
    """Rank (from 1) of every suffix of a string of positive integers."""
    n = len(s)
    if n < 3:
        order = sorted(range(n), key=lambda i: s[i:].tolist())
        ranks = np.empty(n, np.int64)
        ranks[order] = np.arange(1, n + 1)
        return ranks
    bits = max(int(s.max()), n + 3).bit_length()
    padded = np.concatenate((s, np.zeros(3, s.dtype)))
    # The string of names needs a smaller symbol between its halves: position n counts as 1 modulo 3 where n is.
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate((one, two))
    names = np.unique(_pack([padded[sample], padded[sample + 1], padded[sample + 2]], bits), return_inverse=True)[1] + 1
    ranks_of_sample = names if names.max() == len(sample) else suffix_ranks(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = ranks_of_sample
    rank[n:] = 0
    # Remaining suffixes: first symbol, then the sample rank behind it.
    zero = np.arange(0, n, 3)
    key_one = _pack([padded, np.concatenate((rank[1:], [0]))], bits)[:n]
    order = np.argsort(key_one[zero], kind="stable")
    zero = zero[order]
    # Merge: a remaining suffix is compared with samples 1 by one symbol and rank, with samples 2 by two symbols and rank.
    pair = _pack([padded[:n], padded[1:n + 1], rank[2:n + 2]], bits)
    by_rank = sample[np.argsort(ranks_of_sample)]
    by_rank = by_rank[by_rank < n]
    ones, twos = by_rank[by_rank % 3 == 1], by_rank[by_rank % 3 == 2]
    place = (np.arange(len(zero)) + np.searchsorted(key_one[ones], key_one[zero]) + np.searchsorted(pair[twos], pair[zero]))
    taken = np.zeros(n, bool)
    taken[place] = True
    out = np.empty(n, np.int64)
    out[zero] = place + 1
    out[by_rank] = np.flatnonzero(~taken) + 1
    return out


def repeated_windows(contexts: list[bytes], windows: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For contexts in order of their position, and how many windows each
    starts: per context, whether each window also starts in an earlier one."""
    symbols = np.frombuffer(b"\0".join(contexts) + b"\0" * length, np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(c) + 1 for c in contexts])))[:-1]
    total = int(windows.sum())
    starts = np.arange(total) + np.repeat(offsets - (np.cumsum(windows) - windows), windows)
    end = len(symbols) - length
    coded = symbols[:end].astype(np.int64) + 2
    # Ends of contexts (and bytes 0) sort apart from each other by position, so the order is that of separate strings.
    cut = np.concatenate((offsets[1:] - 1, [end])).astype(np.int64)
    cut = cut[cut < end]
    coded[cut] = 1
    rank = suffix_ranks(coded)
    order = np.argsort(rank[starts], kind="stable")
    view = np.lib.stride_tricks.sliding_window_view(symbols, length)
    same = np.zeros(total, bool)
    for i in range(1, total, 1 << 16):
        j = min(total, i + (1 << 16))
        rows = view[starts[order[i - 1:j]]]
        same[i:j] = (rows[1:] == rows[:-1]).all(axis=1)
    heads = np.flatnonzero(~same)
    earliest = np.minimum.reduceat(order, heads)
    marked = np.empty(total, bool)
    marked[order] = order != np.repeat(earliest, np.diff(np.append(heads, total)))
    return np.split(marked, np.cumsum(windows)[:-1])


# --- anchors -------------------------------------------------------------------


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window start, number of windows) of a text's anchors."""
    parts, span = [], length - gram + 1
    for lo in range(0, len(text) - length + 1, _SEGMENT):
        a = np.frombuffer(text, np.uint8, min(len(text) - lo, _SEGMENT + length - 1), lo)
        h, size = a.astype(np.uint64) + np.uint64(1), 1
        while size < gram:  # hashes of strings up to twice as long: overlap the halves where needed
            step = min(size, gram - size)
            h = h[:-step] * np.uint64(pow(_MULT, size, 1 << 64)) + h[step:]
            size += step
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        at = np.arange(len(h), dtype=np.uint64)
        key = (h & ~np.uint64(_SEGMENT * 2 - 1)) | at  # the leftmost of equal hashes is the smallest
        fill = -len(key) % span
        block = np.concatenate((key, np.full(fill, ~np.uint64(0)))).reshape(-1, span)
        ahead = np.minimum.accumulate(block, axis=1).ravel()
        behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(key) - span + 1
        chosen = (np.minimum(behind[:n], ahead[span - 1:span - 1 + n]) & np.uint64(_SEGMENT * 2 - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
        parts.append((h[chosen[first]], first + lo, np.diff(np.append(first, n))))
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


def _slots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    other = (h * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    return [((h + np.uint64(i) * other) >> np.uint64(7)) % np.uint64(bits) for i in range(3)]


def keyed(docs: DataFrame) -> DataFrame:
    """doc (id; null first), tie (hash of the text), id and text bytes."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("doc"),
                       F.xxhash64(text).alias("tie"), text.alias("text"))


def anchor_counts(docs: DataFrame) -> DataFrame:
    """(h, n): occurrences of every anchor hash; equal ones of a batch are
    added up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(t.as_py())[0] for t in batch.column("text")]
            h, n = np.unique(np.concatenate(found) if found else np.empty(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def repeat_filter(repeated: DataFrame) -> np.ndarray:
    """Bloom filter (bytes) of the hashes, ten bits each, of ``MAX_FILTER_BITS`` at
    most: beyond that it passes more, and never misses one."""
    bits = int(min(MAX_FILTER_BITS, max(1 << 12, 10 * repeated.count())) + 4095) // 4096 * 4096

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(_slots(batch.column("h").to_numpy().view(np.uint64), bits))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // 64), pa.array(np.uint64(1) << (at % 64).astype(np.uint64)).view(pa.int64())], ["word", "set"])

    words = repeated.mapInArrow(run, "word long, set long").groupBy("word").agg(F.bit_or("set").alias("set"))
    blocks = (words.groupBy(F.floor(F.col("word") / 8192).alias("block"))
              .agg(F.collect_list(F.struct("word", "set")).alias("words")))
    out = np.zeros(bits // 64, np.uint64)
    for row in blocks.toLocalIterator():
        for word, value in row["words"]:
            out[word] = np.uint64(value & 0xFFFFFFFFFFFFFFFF)
    return out.view(np.uint8)


def contexts(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(h, doc, tie, lo, windows, context) of the anchors that pass the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    names = ["h", "doc", "tie", "lo", "windows", "context"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = shared.value
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            size = 0
            for doc, tie, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "tie", "text")), strict=True):
                h, lo, n = anchors(text)
                keep = np.ones(len(h), bool)
                for at in _slots(h, len(filled) * 8):
                    keep &= (filled[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                h, lo, n = h[keep], lo[keep], n[keep]
                for i in range(0, len(h), 4096):
                    a, b = lo[i:i + 4096].tolist(), n[i:i + 4096].tolist()
                    for c, v in zip(columns, (h[i:i + 4096].view(np.int64).tolist(), [doc] * len(a), [tie] * len(a), a, b,
                                              [text[x:x + y + LENGTH - 1] for x, y in zip(a, b, strict=True)]), strict=True):
                        c.extend(v)
                    size += len(a)
                    if size >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 5 else pa.int64()) for k, c in enumerate(columns)], names)
                        columns, size = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 5 else pa.int64()) for k, c in enumerate(columns)], names)

    return docs.select("doc", "tie", "text").mapInArrow(run, "h long, doc long, tie long, lo long, windows long, context binary")


def covered_by_sorting(rows: DataFrame) -> DataFrame:
    """(doc, tie, start, end) of bytes covered by repeats, by sorting the
    suffixes of about a bucket of anchors at a time."""

    def solve(frame: pd.DataFrame) -> tuple[list[int], list[int], list[int], list[int]]:
        out: tuple[list[int], ...] = ([], [], [], [])

        def emit(row, first: int, last: int) -> None:
            for c, v in zip(out, (row.doc, row.tie, row.lo + first, row.lo + last + LENGTH - 1), strict=True):
                c.append(v)

        frame = frame.sort_values(["doc", "tie", "lo"], kind="stable")
        classes: dict[tuple[int, bytes], list] = {}
        for row in frame.itertuples(index=False):
            classes.setdefault((row.h, row.context), []).append(row)
        per_anchor: dict[int, int] = {}
        for h, _ in classes:
            per_anchor[h] = per_anchor.get(h, 0) + 1
        firsts = []
        for (h, _), members in classes.items():
            first = members[0]
            for row in members[1:]:
                if (row.doc, row.tie, row.lo) != (first.doc, first.tie, first.lo):
                    emit(row, 0, row.windows)
            if per_anchor[h] > 1:
                firsts.append(first)
        if firsts:
            marks = repeated_windows([r.context for r in firsts], np.array([r.windows for r in firsts]))
            for row, marked in zip(firsts, marks, strict=True):
                edges = np.flatnonzero(np.diff(np.concatenate(([0], marked.view(np.int8), [0]))))
                for a, b in edges.reshape(-1, 2).tolist():
                    emit(row, a, b)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def flush(frame: pd.DataFrame) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in solve(frame)], ["doc", "tie", "start", "end"])

        for batch in batches:
            frame = batch.to_pandas()
            lengths = frame["windows"].to_numpy() + LENGTH
            h = frame["h"].to_numpy()
            cuts = np.flatnonzero(h[1:] != h[:-1]) + 1  # a bucket ends where an anchor does
            done = 0
            if waiting and len(h) and waiting[-1]["h"].iat[-1] != h[0] and size >= BUCKET:
                yield flush(pd.concat(waiting))
                waiting, size = [], 0
            sums = np.concatenate(([0], np.cumsum(lengths)))
            for cut in cuts.tolist():
                if size + sums[cut] - sums[done] >= BUCKET:
                    yield flush(pd.concat([*waiting, frame.iloc[done:cut]]))
                    waiting, size, done = [], 0, cut
            if done < len(frame):
                waiting.append(frame.iloc[done:])
                size += int(sums[-1] - sums[done])
        if waiting:
            yield flush(pd.concat(waiting))

    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(run, "doc long, tie long, start long, end long")


def covered_by_grouping(rows: DataFrame) -> DataFrame:
    """The same for hot anchors, by partial minima alone: equal contexts are
    reduced to their first (what repeats it is covered whole), and the windows
    of the remaining contexts to the first of equal bytes."""
    start = F.struct("doc", "tie", "lo")
    firsts = rows.groupBy("context").agg(F.min(start).alias("first"))
    copies = rows.join(firsts, "context").where(start > F.col("first"))
    whole = copies.select("doc", "tie", F.col("lo").alias("start"), (F.col("lo") + F.col("windows") + LENGTH - 1).alias("end"))
    windows = (firsts.withColumn("at", F.explode(F.sequence(F.lit(0), F.length("context") - LENGTH)))
               .select("first.doc", "first.tie", (F.col("first.lo") + F.col("at")).alias("start"),
                       F.expr(f"substring(context, at + 1, {LENGTH})").alias("bytes")))
    earliest = windows.groupBy("bytes").agg(F.min(F.struct("doc", "tie", "start")).alias("first"))
    later = windows.join(earliest, "bytes").where(F.struct("doc", "tie", "start") > F.col("first"))
    return whole.unionByName(later.select("doc", "tie", "start", (F.col("start") + LENGTH).alias("end")))


def removal_columns(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    """n_bytes, n_removed, n_spans and the hash of what is kept."""
    rows = []
    for text, covered in zip(texts, spans, strict=True):
        kept, removed, count, at = hashlib.sha256(), 0, 0, 0
        merged: list[list[int]] = []
        for start, end in sorted((s["start"], s["end"]) for s in (covered if covered is not None else ())):
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([start, end])
        for start, end in merged:
            kept.update(text[at:start])
            removed, count, at = removed + end - start, count + 1, end
        kept.update(text[at:])
        rows.append((len(text), removed, count, kept.hexdigest()))
    return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, run: Workspace) -> DataFrame:
    """doc_id, text (bytes), spans (array of covered start, end) of every
    document; spans of one document may touch or overlap."""
    spark, texts = docs.sparkSession, keyed(docs)
    repeated = run.table(anchor_counts(texts).where("n > 1"), "repeated")
    tidy(spark)
    found = contexts(texts, repeat_filter(repeated.select("h")))
    hot = repeated.where(F.col("n") > HOT).select("h")
    if n_hot := hot.count():
        if n_hot <= BROADCAST_ROWS:  # eight bytes each; else Spark chooses, and contexts are dealt out once more
            hot = F.broadcast(hot)
        held = run.table(found.join(hot, "h", "left_semi"), "hot")
        run.table(covered_by_grouping(held), "covered_hot")
        tidy(spark)
        run.table(covered_by_sorting(found.join(hot, "h", "left_anti")), "covered_sorted")
        covered = run.read("covered_hot").unionByName(run.read("covered_sorted"))
    else:
        covered = run.table(covered_by_sorting(found), "covered")
    tidy(spark)
    spans = covered.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return texts.join(spans, ["doc", "tie"], "left").select("doc_id", "text", "spans")
