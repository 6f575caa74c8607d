"""Bounded-space online packing of documents into fixed token windows.

Each partition keeps at most ``open_windows`` windows. A document's full
windows are emitted at once; its rest goes to the open window it fits best.
When it fits none, a new window opens if there is room, else the fullest
window is emitted, first topped up with the head of the waiting piece
(documents may be cut freely), so emitted windows are full. What is open at the
end of a partition is merged in rounds: the windows of ``fan`` partitions meet
in one task, are packed by the same rule, and leave at most ``open_windows``
open; the last round keeps a single window, whose tokens are cut at powers of
two. A task holds a few windows and one document, whatever the input's size.

Edge cases: a null text is the empty text and packs as the end id alone; texts
of any length are cut across windows; repeated rows and ties are packed row by
row in input order; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.workspace import Workspace

WINDOW = 2048
END_ID = 1  # fixed value: the id after each document

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "open boolean, part long, window long, ids binary")
_NAMES = [c.split()[0] for c in PIECES.split(", ")]
_TYPES = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
_SCHEMA = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in PIECES.split(", ")])


class WordTokens:
    """Token ids of whole texts, for a tokenizer that ignores letter case and
    white space and never joins characters across white space: each
    white-space-separated chunk is encoded once and remembered. Two
    generations of up to ``cache`` chunks are kept; ids take two bytes.

    Unknown words go to the tokenizer in one text: the last id of each is a
    word's end in the vocabulary, so the ids can be dealt back. A word and one
    mark after it are the word's ids and the mark's. Other chunks are encoded
    one by one."""

    MARKS = ".,;:!?"

    def __init__(self, path: str, cache: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), cache
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.marks = {m.encode(): ids for m, ids in zip(self.MARKS, self._encode(list(self.MARKS)), strict=True)}
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def learn(self, chunks: set[bytes]) -> None:
        """Remember the ids of new chunks."""
        known, older, marks, words, marked, others = self.known, self.older, self.marks, set(), [], []
        for c in chunks:
            if (ids := older.get(c)) is not None:
                known[c] = ids
            elif is_word(c):
                words.add(c)
            elif (mark := marks.get(c[-1:])) is not None and is_word(word := c[:-1]):
                marked.append((c, word, mark))
                if word not in known:
                    words.add(word)
            else:
                others.append(c)
        if words:
            data = self._encode([b" ".join(words).decode()])[0]
            last = (np.flatnonzero(self.ends[np.frombuffer(data, "<u2")]) * 2 + 2).tolist()
            known.update(zip(words, [data[i:j] for i, j in zip([0, *last], last, strict=False)], strict=True))
        for c, word, mark in marked:
            known[c] = known[word] + mark
        known.update(zip(others, self._encode([c.decode("utf-8", "replace") for c in others]), strict=True))

    def _encode(self, texts: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("H", e.ids).tobytes() for e in coded]

    def ids(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        if len(self.known) > self.limit:
            self.known, self.older = {}, self.known
        known, split, coded, new = self.known, [], [], set()
        for text in texts:
            chunks = (text if b"<|" in text else text.lower()).split()  # special tokens are told by their case
            try:
                coded.append(b"".join(map(known.__getitem__, chunks)))
            except KeyError:
                new.update([c for c in chunks if c not in known])
                coded.append(None)
            split.append(chunks if coded[-1] is None else None)
        if new:
            self.learn(new)
        for chunks, ids in zip(split, coded, strict=True):
            ids = b"".join(map(known.__getitem__, chunks)) if ids is None else ids
            yield np.frombuffer(ids, "<u2").astype(np.uint32)


def is_word(chunk: bytes) -> bool:
    """Letters below U+0130 only: normal forms and lower case leave such a
    word in one part."""
    if chunk.isalpha():  # of bytes: ASCII
        return True
    if chunk.isascii():
        return False
    word = chunk.decode("utf-8", "replace")
    return word.isalpha() and max(word) < "\u0130"


class Packer:
    """The online rule. ``out`` collects rows of finished pieces."""

    def __init__(self, sequence_base: int, open_windows: int, window: int = WINDOW):
        self.next_sequence, self.limit, self.window = sequence_base, open_windows, window
        self.windows: list[list[tuple]] = []
        self.fill: list[int] = []
        self.out: list[tuple] = []

    def add(self, doc_id, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        """Place one run of a document's ids."""
        while len(ids) >= self.window:
            self._emit([(doc_id, start, ids[: self.window], doc_tokens)])
            start, ids = start + self.window, ids[self.window:]
        while len(ids):
            fitting = [(self.window - f, i) for i, f in enumerate(self.fill) if self.window - f >= len(ids)]
            if fitting:
                i = min(fitting)[1]
            elif len(self.windows) < self.limit:
                i = len(self.windows)
                self.windows.append([])
                self.fill.append(0)
            else:
                i = max(range(len(self.fill)), key=lambda w: (self.fill[w], -w))
            head = ids[: self.window - self.fill[i]]
            self.windows[i].append((doc_id, start, head, doc_tokens))
            self.fill[i] += len(head)
            start, ids = start + len(head), ids[len(head):]
            if self.fill[i] == self.window:
                self._emit(self.windows.pop(i))
                self.fill.pop(i)

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            self.out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), doc_tokens,
                             self.next_sequence, offset, False, None, None, None))
            offset += len(ids)
        self.next_sequence += 1

    def leave_open(self, part: int) -> None:
        """Hand the open windows over to the next round, with their ids."""
        for number, pieces in enumerate(self.windows):
            self.out += [(doc_id, start, len(ids), None, doc_tokens, None, None, True, part, number, ids.astype("<u4").tobytes())
                         for doc_id, start, ids, doc_tokens in pieces]

    def close(self) -> None:
        """Emit what is open as sequences of power-of-two length."""
        for pieces in self.windows:
            left = sum(len(p[2]) for p in pieces)
            while left:
                room, taken = 1 << (left.bit_length() - 1), []
                left -= room
                while room:
                    doc_id, start, ids, doc_tokens = pieces.pop(0)
                    taken.append((doc_id, start, ids[:room], doc_tokens))
                    if len(ids) > room:
                        pieces.insert(0, (doc_id, start + room, ids[room:], doc_tokens))
                    room -= min(room, len(ids))
                self._emit(taken)

    def batch(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _NAMES]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SCHEMA.types, strict=True)], schema=_SCHEMA)


def in_groups(batch: pa.RecordBatch, group_bytes: int = 1 << 18) -> Iterator[tuple[list, list[bytes]]]:
    """The batch's (doc_ids, texts) in groups of at most ``group_bytes``, or of one text."""
    lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(lengths):
        before = lengths[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(lengths, before + group_bytes, "right")))
        part = batch.slice(start, stop - start)
        yield part.column("doc_id").to_pylist(), [t or b"" for t in part.column("text").to_pylist()]
        start = stop


def _sequence_base(turn: int, part: int) -> int:
    return (turn << 58) | (part << 32)


def pack_partitions(docs: DataFrame, tokens: Callable[[], WordTokens], open_windows: int) -> DataFrame:
    """First round: tokenise and pack each partition's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = tokens(), TaskContext.get().partitionId()
        packer = Packer(_sequence_base(0, part), open_windows)
        for batch in batches:
            for doc_ids, texts in in_groups(batch):
                for doc_id, ids in zip(doc_ids, coder.ids(texts), strict=True):
                    coded = np.append(ids, np.uint32(END_ID))
                    packer.add(doc_id, 0, coded, len(coded))
                if len(packer.out) >= 4096:
                    yield packer.batch()
        packer.leave_open(part)
        yield packer.batch()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return narrow.mapInArrow(run, PIECES)


def merge_round(opened: DataFrame, turn: int, fan: int, open_windows: int, final: bool) -> DataFrame:
    """Merge the open windows of every ``fan`` parts by the same rule."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        part = int(key[0])
        packer = Packer(_sequence_base(turn, part), 1 if final else open_windows)
        for r in rows.sort_values(["part", "window", "doc_id", "start"]).itertuples():
            doc_id = None if pd.isna(r.doc_id) else int(r.doc_id)
            packer.add(doc_id, int(r.start), np.frombuffer(r.ids, "<u4"), int(r.doc_tokens))
        if final:
            packer.close()
        else:
            packer.leave_open(part)
        return packer.batch().to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)

    group = F.floor(F.col("part") / fan).alias("group")
    return opened.groupBy(group).applyInPandas(run, PIECES)


def pack(docs: DataFrame, run: Workspace, tokens: Callable[[], WordTokens], open_windows: int = 16, fan: int = 64) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. ``tokens`` builds the tokenizer in each task."""
    state = run.table(pack_partitions(docs, tokens, open_windows), "pack0")
    out, turn = state.where("not open"), 0
    while (parts := state.where("open").agg(F.max("part")).first()[0]) is not None:
        turn += 1
        state = run.table(merge_round(state.where("open"), turn, fan, open_windows, final=parts < fan), f"pack{turn}")
        out = out.unionByName(state.where("not open"))
    return out.select(*_NAMES[:7])
