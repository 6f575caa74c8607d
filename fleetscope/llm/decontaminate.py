"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may occur in a document with up to
``floor(n * rate)`` edits. It is split into one piece more than that, so at
least one piece occurs unchanged. All pieces are found in one pass of an
Aho-Corasick automaton over the whole text. Around each hit, runs of two, four
and more pieces that hold it are searched with Myers' bit-parallel edit
distance (a run of p pieces may have p - 1 edits: of any two parts of an
occurrence within budget, one is within its own), and last the whole item,
which decides. Most chance hits end at the run of two. Text and
items are compared with A-Z lower-cased and each white-space character as a
space, code point by code point.

Distinct item texts come in blocks of at most ``block_chars`` characters
(checked; a longer text is a block of its own): a stated query set against all
documents. Only one block is broadcast at a time, its result is written before
the next one starts, and documents are scanned once per block, without a
shuffle. Item ids are joined back to the texts found.

Edge cases: null and empty texts match nothing; null and empty items are
skipped; items too short for an edit must occur exactly; equal items are
searched once and reported for each item_id; of several occurrences in a
document the first with the fewest edits is reported; repeated documents are
reported alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.operators.scope import salted_lookup
from fleetscope.workspace import Workspace

RATE = 0.1
BLOCK_CHARS = 1_000_000
MATCHES = "array<struct<item_id:long,distance:int,start:long,end:long>>"

_SAME_LENGTH = bytes(32 if b in b" \t\n\v\f\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


def plain(text: str) -> str:
    """A-Z lower-cased and ASCII white space as spaces; same length."""
    return text.encode("utf-8", "surrogatepass").translate(_SAME_LENGTH).decode("utf-8", "surrogatepass")


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) of budget + 1 nearly equal parts."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def ladder(item: str, budget: int) -> list[list[tuple[int, int, int]]]:
    """Per piece: the growing runs of pieces that hold it, as (from, to,
    budget), without the piece itself and the whole item."""
    cuts = [a for a, _ in pieces(item, budget)] + [len(item)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(budget + 1)]

    def split(lo: int, hi: int) -> None:
        if hi - lo == 1:
            return
        if (lo, hi) != (0, budget + 1):
            for piece in range(lo, hi):
                out[piece].insert(0, (cuts[lo], cuts[hi], hi - lo - 1))
        middle = (lo + hi) // 2
        split(lo, middle)
        split(middle, hi)

    split(0, budget + 1)
    return out


def companions(item: str, budget: int, piece: int, run: tuple[int, int, int]) -> list[tuple[int, int]]:
    """One part more than the run's edits, of the run without ``piece``: the
    other pieces, the first of them halved. If the piece is unchanged and the
    run within its edits, one part is unchanged and shifted by no more."""
    cuts = [a for a, _ in pieces(item, budget)] + [len(item)]
    a, b, _ = run
    parts = [(lo, hi) for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a <= lo and hi <= b and i != piece]
    lo, hi = parts[0]
    return [(lo, (lo + hi) // 2), ((lo + hi) // 2, hi), *parts[1:]]


@lru_cache(maxsize=50_000)
def char_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], m: int, text: str, budget: int, anchored: bool = False) -> tuple[int, int] | None:
    """(distance, end) of the best occurrence of a pattern of m characters in
    ``text`` with at most ``budget`` edits, the first of equals; else None.
    ``anchored``: the occurrence starts where the text does. Columns of the
    edit matrix are bit vectors of vertical and horizontal steps."""
    full, top, first = (1 << m) - 1, 1 << (m - 1), int(anchored)
    up, down, score, limit, best = full, 0, m, budget + 1, None
    for at, c in enumerate(text, 1):
        same = masks.get(c, 0)
        diagonal = ((((same & up) + up) ^ up) | same | down) & full
        more = down | full & ~(diagonal | up)
        less = diagonal & up
        if more & top:
            score += 1
        elif less & top:
            score -= 1
        more = more << 1 | first
        up = (less << 1 | ~(diagonal | more)) & full
        down = more & diagonal
        if score < limit:
            best, limit = (score, at), score
    return best


class Matcher:
    """Automaton and items of one block of (item_id, text) items."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.ids: dict[str, list[int]] = {}
        for item_id, text in items:
            if text:
                self.ids.setdefault(plain(text), []).append(item_id)
        self.items = [(x, int(len(x) * rate)) for x in self.ids]
        places: dict[str, list[tuple]] = {}
        for number, (x, budget) in enumerate(self.items):
            for i, ((offset, piece), runs) in enumerate(zip(pieces(x, budget), ladder(x, budget), strict=True)):
                near = [(x[a:b], a - runs[0][2], b + runs[0][2]) for a, b in companions(x, budget, i, runs[0])] if runs else None
                places.setdefault(piece, []).append((number, offset, runs, near))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def windows(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item, from, to): merged stretches of the text that can hold an
        occurrence, by item and position."""
        hits: dict[int, list[int]] = {}
        for end, (n, where) in self.automaton.iter(text):
            for number, offset, runs, near in where:
                start, x = end + 1 - n - offset, self.items[number][0]
                if near and all(text.find(part, max(0, start + a), max(0, start + b)) < 0 for part, a, b in near):
                    continue
                for a, b, edits in runs:
                    if not myers(char_masks(x[a:b]), b - a, text[max(0, start + a - edits):start + b + edits], edits):
                        break
                else:
                    hits.setdefault(number, []).append(start)
        for number, starts in hits.items():
            x, budget = self.items[number]
            starts.sort()
            lo = hi = None
            for s in starts:
                a, b = max(0, s - budget), s + len(x) + budget
                if hi is None or a > hi:
                    if hi is not None:
                        yield number, lo, hi
                    lo, hi = a, b
                else:
                    hi = max(hi, b)
            yield number, lo, hi

    def matches(self, text: str | None) -> list[dict]:
        """Matched items with distance and span, best occurrence each."""
        if not text or not self.items:
            return []
        text, best = plain(text), {}
        for number, lo, hi in self.windows(text):
            x, budget = self.items[number]
            found = myers(char_masks(x), len(x), text[lo:hi], budget)
            if found and (number not in best or found[0] < best[number][0]):
                best[number] = (found[0], lo + found[1])
        out = []
        for number, (distance, end) in sorted(best.items()):
            x, budget = self.items[number]
            behind = text[max(0, end - len(x) - budget):end][::-1]
            length = myers(char_masks(x[::-1]), len(x), behind, distance, anchored=True)[1]
            out += [{"item_id": i, "distance": distance, "start": end - length, "end": end} for i in self.ids[x]]
        return out


def item_blocks(items: DataFrame, run: Workspace, block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, int]:
    """(texts, blocks): the distinct texts as (text, key, block) and the number
    of blocks. Blocks are hash buckets, made smaller until each fits or holds
    one text."""
    usable = items.where("text is not null and text <> ''").select("text").distinct()
    texts = run.table(usable.withColumn("key", F.monotonically_increasing_id()), "texts")
    blocks = -(-(texts.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars)
    while True:
        dealt = texts.withColumn("block", F.pmod(F.xxhash64("text", F.lit(blocks)), F.lit(max(1, blocks))))
        sizes = dealt.groupBy("block").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("n"))
        if blocks <= 1 or sizes.where((F.col("chars") > block_chars) & (F.col("n") > 1)).isEmpty():
            return run.table(dealt, "item_blocks"), blocks
        blocks += blocks // 4 + 1


_MATCHERS: dict[str, Matcher] = {}


def match_column(text: Column, shared: Broadcast, rate: float = RATE) -> Column:
    """Array of the block's matches in each text, with the item texts' keys.
    ``shared`` is a block of bounded size; the automaton is built once per
    Python worker."""
    key = uuid.uuid4().hex

    @F.pandas_udf(MATCHES)
    def search(texts: pd.Series) -> pd.Series:
        if key not in _MATCHERS:
            _MATCHERS.clear()
            _MATCHERS[key] = Matcher(shared.value, rate)
        return texts.map(_MATCHERS[key].matches)

    return search(text)


def broadcast_block(texts: DataFrame, block: int) -> Broadcast:
    rows = texts.where(F.col("block") == block).select("key", "text").collect()
    return texts.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])


def matches(docs: DataFrame, items: DataFrame, run: Workspace, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, start, end) of every item found in every
    document; positions in code points, end exclusive."""
    texts, blocks = item_blocks(items, run, block_chars)
    out = docs.limit(0).select("doc_id", F.lit(None).cast(MATCHES).alias("m")).select("doc_id", F.explode("m").alias("m")).select("doc_id", "m.*")
    for block in range(blocks):
        shared = broadcast_block(texts, block)
        found = docs.select("doc_id", F.explode(match_column(F.col("text"), shared, rate)).alias("m")).select("doc_id", "m.*")
        out = out.unionByName(run.table(found, f"found{block}"))
        shared.unpersist()
    ids = items.select(F.col("item_id").cast("long").alias("id"), "text").join(texts.select("text", "key"), "text").select("id", "key")
    named = salted_lookup(out.withColumnRenamed("item_id", "key"), ids, ["key"], how="inner")
    return named.select("doc_id", F.col("id").alias("item_id"), "distance", "start", "end")


def without_contaminated(docs: DataFrame, items: DataFrame, run: Workspace, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Documents in which no item was found, as they came. What is left after
    a block is written before the next one; the last block is left to the
    caller's write."""
    texts, blocks = item_blocks(items, run, block_chars)
    for block in range(blocks):
        shared = broadcast_block(texts, block)
        docs = docs.where(F.size(match_column(F.col("text"), shared, rate)) == 0)
        if block < blocks - 1:
            docs = run.table(docs, f"left{block}")
            shared.unpersist()
            if block:
                run.drop(f"left{block - 1}")
    return docs
