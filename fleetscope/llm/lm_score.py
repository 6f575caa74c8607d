"""LM scoring by subword lattice likelihood.

The vocabulary is that of an existing subword tokenizer, all single bytes (so
any text has a segmentation), and the words of the training texts as whole
units. A text is its words, each with a leading mark that only units at a
word's start hold. A word's marginal probability is the sum over all its
segmentations of the product of the units' scores, a forward recursion in log
space over the lattice; no unit spans two words, so a text's lattice is the
chain of its words' lattices.

The vocabulary's own scores weight all segmentations at first, and stay in the
weights as ``PRIOR`` pseudo-counts. The training texts adapt them: a word seen c
times keeps c - d as a whole unit; the discount d of each distinct word goes to
the pieces that spell it, by expectation maximisation (forward-backward over
all segmentations under the weights so far). d is estimated from the words
seen once and twice, n1 / (n1 + 2 n2). Words are counted over the whole corpus
and each distinct word's lattice is computed once per pass.

Training texts may carry a class (their language): then each class has unit
scores of its own, and a document's probability is marginal over the classes
too, weighted by their shares of the training texts. Classes with less than
``MIN_SHARE`` of the training texts share one model, so there are at most
1 / ``MIN_SHARE`` others, whatever the column holds. The class of a scored
document is never read. The document's marginal probability under a class is
the product of its words' marginals; before each word, and at the end, the
model first decides whether the text ends.

A task turns about ``GROUP_BYTES`` of documents into a group: each document as
the group's word numbers and counts, and the group's distinct words. Only the
distinct words are joined to the corpus counts and scores, and come back to
their group, where the documents are summed. A frequent word is one row per
group, and a group's size is bounded, so no key is hot.

Edge cases: a null text is the empty text and scores as the end alone; words
of any length are scored whole; repeated rows are scored (and learned from)
row by row; a null doc_id is scored but not learned from; without training
texts all scores come from the vocabulary's own weights; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import tidy
from fleetscope.workspace import Workspace

GROUP_BYTES = 32 << 20
MARK = 32  # the byte before each word; words hold no space
EM_PASSES = 2
PRIOR = 100.0  # pseudo-counts dealt to the pieces by the vocabulary's scores
MIN_SHARE = 1 / 32  # of the training texts, for a class of its own
LONG_WORD = 96  # bytes; longer words are walked one by one
BATCH_WORDS = 20_000
_P = np.uint64(0x100000001B3)


def load_pieces(path: str) -> dict[bytes, float]:
    """Byte strings of a sentencepiece vocabulary, word starts with a leading
    space, and all single bytes, with weights that add up to one. The weight
    of a unigram vocabulary's piece is exp(score). A BPE vocabulary's scores
    are negative ranks (whole numbers), and the weight is 1 / (1 + rank), after
    Zipf's law. A byte that is no piece weighs as much as the last piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores = {}
    for i in range(model.get_piece_size()):
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)):
            piece = model.id_to_piece(i).replace("▁", " ").encode()
            if piece.rfind(b" ") <= 0:
                scores[piece] = model.get_score(i)
    ranked = all(s == int(s) for s in scores.values())
    weights = {piece: 1 / (1 - s) if ranked else float(np.exp(s)) for piece, s in scores.items()}
    least = min(weights.values(), default=1.0)
    weights = {bytes([b]): least for b in range(256)} | weights
    total = sum(weights.values())
    return {piece: weights[piece] / total for piece in sorted(weights)}


def _hash(piece: bytes) -> int:
    h = 0
    for b in piece:
        h = (h * int(_P) + b + 1) & ((1 << 64) - 1)
    return h


@dataclass
class Lattice:
    """Pieces by length (sorted hashes and their numbers) with log scores."""

    tables: list[tuple[np.ndarray, np.ndarray]]
    log_p: np.ndarray  # natural logarithms, by piece number
    log_whole: float  # logarithm of the total weight, whole words' included
    discount: float  # taken from each training word's count

    @classmethod
    def of(cls, pieces: list[bytes], weights: np.ndarray, whole: float, discount: float) -> Lattice:
        """``whole``: the weight of all whole-word units."""
        by_length: list[list[tuple[int, int]]] = [[] for _ in range(max(map(len, pieces)) + 1)]
        for number, piece in enumerate(pieces):
            by_length[len(piece)].append((_hash(piece), number))
        tables = []
        for rows in by_length:
            rows.sort()
            tables.append((np.array([h for h, _ in rows], np.uint64), np.array([i for _, i in rows], np.int64)))
        total = np.log(weights.sum() + whole)
        return cls(tables, np.log(weights) - total, total, discount)

    def arcs(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Per piece length: the piece that ends the first n bytes' suffix of
        that length, as an array (word, start) of piece numbers or -1, over a
        matrix of equally long words."""
        shifted = words.astype(np.uint64) + np.uint64(1)
        h = np.zeros((words.shape[0], words.shape[1] + 1), np.uint64)
        for length in range(1, min(len(self.tables) - 1, words.shape[1]) + 1):
            h = h[:, : words.shape[1] - length + 1] * _P + shifted[:, length - 1:]
            hashes, numbers = self.tables[length]
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                found = hashes[at] == h
                if found.any():
                    yield length, np.where(found, numbers[at], -1)

    def forward(self, words: np.ndarray, arcs: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """Log probability of every prefix, (word, bytes)."""
        alpha = np.full((words.shape[0], words.shape[1] + 1), -np.inf)
        alpha[:, 0] = 0
        score = np.append(self.log_p, -np.inf)  # number -1: no such piece
        for end in range(1, words.shape[1] + 1):
            terms = [alpha[:, end - n] + score[ids[:, end - n]] for n, ids in arcs if n <= end]
            alpha[:, end] = _logsumexp(terms)
        return alpha

    def expected(self, words: np.ndarray, weight: np.ndarray, arcs: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """Expected piece counts over all segmentations of weighted words."""
        alpha = self.forward(words, arcs)
        score, size = np.append(self.log_p, -np.inf), words.shape[1]
        beta = np.full_like(alpha, -np.inf)
        beta[:, size] = 0
        for start in range(size - 1, -1, -1):
            beta[:, start] = _logsumexp([score[ids[:, start]] + beta[:, start + n] for n, ids in arcs if start + n <= size])
        counts = np.zeros(len(score))
        scale = np.log(weight) - alpha[:, size]
        for n, ids in arcs:
            mass = np.exp(alpha[:, : size - n + 1] + score[ids] + beta[:, n:] + scale[:, None])
            counts += np.bincount(np.where(ids < 0, len(score) - 1, ids).ravel(), mass.ravel(), minlength=len(score))
        return counts[:-1]


def _logsumexp(terms: list[np.ndarray]) -> np.ndarray:
    stacked = np.stack(terms)
    top = np.maximum(stacked.max(axis=0), -1e300)
    return np.log(np.maximum(np.exp(stacked - top).sum(axis=0), 1e-300)) + top


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, byte matrix with the leading mark) of equally long words,
    in batches; a batch holds about the same number of bytes."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for same in np.split(order, cuts):
        size = int(lengths[same[0]]) if len(same) else 0
        step = max(1, BATCH_WORDS * 8 // (size + 1))
        for i in range(0, len(same), step):
            at = same[i:i + step]
            joined = b"".join(b" " + words[j] for j in at.tolist())
            yield at, np.frombuffer(joined, np.uint8).reshape(len(at), size + 1)


def _split_long(matrix: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (and their positions) of a matrix of long words one at a time,
    others together."""
    if matrix.shape[1] <= LONG_WORD:
        yield matrix, at
    else:
        yield from zip(np.split(matrix, len(matrix)), np.split(at, len(at)), strict=True)


def word_scores(lattices: list[Lattice], words: list[bytes], c: np.ndarray) -> np.ndarray:
    """Natural-log marginal probability of each word under each lattice,
    (word, lattice); ``c``: the words' counts in the training texts of each."""
    out = np.zeros((len(words), len(lattices)))
    for at, matrix in by_length(words):
        for part, rows in _split_long(matrix, at):
            arcs = list(lattices[0].arcs(part))
            for k, lattice in enumerate(lattices):
                if part.shape[1] > LONG_WORD:
                    out[rows, k] = _forward_one(_ends(lattice, arcs, part.shape[1]))[-1]
                else:
                    out[rows, k] = lattice.forward(part, arcs)[:, -1]
    kept = c - np.array([lattice.discount for lattice in lattices])
    whole = np.log(np.maximum(kept, 1e-300)) - np.array([lattice.log_whole for lattice in lattices])
    return np.where(c > 0, np.logaddexp(out, whole), out)


def _ends(lattice: Lattice, arcs: list[tuple[int, np.ndarray]], size: int) -> np.ndarray:
    """(end, length) matrix of log scores of one word's arcs."""
    table = np.full((size + 1, len(lattice.tables)), -np.inf)
    score = np.append(lattice.log_p, -np.inf)
    for n, ids in arcs:
        table[n:, n] = score[ids[0]]
    return table


def _forward_one(table: np.ndarray) -> np.ndarray:
    """Forward recursion of one word over its (end, length) matrix."""
    size, widest = table.shape[0] - 1, table.shape[1]
    alpha = np.full(size + widest, -np.inf)  # position p is at p + widest - 1
    alpha[widest - 1] = 0
    for end in range(1, size + 1):
        x = alpha[end:end + widest - 1] + table[end, :0:-1]
        top = x.max()
        alpha[end + widest - 1] = top + np.log(np.exp(x - top).sum())
    return alpha[widest - 1:]


def _expected_one(lattice: Lattice, weight: float, arcs: list[tuple[int, np.ndarray]], size: int) -> np.ndarray:
    """Expected piece counts of one long word."""
    table = _ends(lattice, arcs, size)
    alpha = _forward_one(table)
    back = np.full_like(table, -np.inf)  # the reversed word's arcs
    for n in range(1, table.shape[1]):
        back[n:, n] = table[n:, n][::-1]
    beta = _forward_one(back)[::-1]
    score, counts = np.append(lattice.log_p, -np.inf), np.zeros(len(lattice.log_p) + 1)
    for n, ids in arcs:
        mass = weight * np.exp(alpha[: size - n + 1] + score[ids[0]] + beta[n:] - alpha[-1])
        counts += np.bincount(np.where(ids[0] < 0, len(score) - 1, ids[0]), mass, minlength=len(score))
    return counts[:-1]


# --- on the cluster ----------------------------------------------------------


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def group_documents(docs: DataFrame, train: Column, kind: Column, kinds: int, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Documents and distinct words of groups: rows with ``word`` null are
    documents (doc_id, kind, numbers and counts of their words; ``kind`` is null
    outside the training texts), the others the group's words (number, word,
    and n0, n1, ...: occurrences in training texts of each of ``kinds``)."""
    per_kind = [f"n{k}" for k in range(kinds)]
    schema = "grp long, doc_id long, kind int, numbers binary, counts binary, number int, word binary, " + ", ".join(f"{n} long" for n in per_kind)
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()] + [pa.int64()] * kinds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = TaskContext.get().partitionId() << 24
        ids: defaultdict[bytes, int] = defaultdict()
        ids.default_factory = ids.__len__
        trained, size, used = [], 0, False

        def batch(n: int, **columns) -> pa.RecordBatch:
            arrays = [columns.get(name) if columns.get(name) is not None else pa.nulls(n, t) for name, t in zip(names, types, strict=True)]
            arrays[0] = pa.array([group] * n, pa.int64())
            return pa.RecordBatch.from_arrays(arrays, names)

        def finish() -> Iterator[pa.RecordBatch]:
            n = np.zeros((kinds, len(ids)), np.int64)
            for k, numbers, counts in trained:
                n[k, numbers] += counts
            words = list(ids)
            for lo in range(0, len(words), 50_000):
                part = words[lo:lo + 50_000]
                yield batch(len(part), number=pa.array(np.arange(lo, lo + len(part), dtype=np.int32)), word=pa.array(part, pa.binary()),
                            **{name: pa.array(n[k, lo:lo + len(part)]) for k, name in enumerate(per_kind)})

        for rows in batches:
            doc_ids, flags, texts = rows.column("doc_id").to_pylist(), rows.column("kind").to_pylist(), rows.column("text")
            out = []
            for i, doc_id in enumerate(doc_ids):
                text = texts[i].as_py() or b""
                words = text.lower().split()
                numbers, counts = np.unique(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)), return_counts=True)
                counts = counts.astype(np.int32)
                out.append((doc_id, flags[i], numbers.tobytes(), counts.tobytes()))
                if flags[i] is not None:
                    trained.append((flags[i], numbers, counts))
                size, used = size + len(text), True
                if size >= group_bytes or i == len(doc_ids) - 1 or len(out) == 512:
                    yield batch(len(out), **{name: pa.array(c, t) for name, c, t in zip(names[1:5], zip(*out, strict=True), types[1:5], strict=True)})
                    out = []
                if size >= group_bytes:
                    yield from finish()
                    group, size, used, trained = group + 1, 0, False, []
                    ids.clear()
        if used:
            yield from finish()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"),
                         F.when(train, kind).cast("int").alias("kind"))
    return narrow.mapInArrow(run, schema)


def discount(once: int, twice: int) -> float:
    """What a word's count is discounted by, from how many words occur once
    and twice."""
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def fit(vocabulary: DataFrame, pieces: dict[bytes, float], words: list[int], types: list[int], discounts: list[float],
        passes: int = EM_PASSES) -> list[Lattice]:
    """Scores of each class from the training words (word, n0, n1, ...), with
    ``words`` tokens of ``types`` kinds. Each pass runs forward-backward under
    the weights so far, at first the vocabulary's, and returns at most one sum
    per class and piece to the driver."""
    spark, classes = vocabulary.sparkSession, range(len(words))
    names, prior = list(pieces), np.array(list(pieces.values()))
    whole = [words[k] - discounts[k] * types[k] for k in classes]
    lattices = [Lattice.of(names, prior * (PRIOR + discounts[k] * types[k]), whole[k], discounts[k]) for k in classes]
    for _ in range(passes):
        shared = spark.sparkContext.broadcast(lattices)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            models = shared.value
            size = len(models[0].log_p)
            total = np.zeros((len(models), size + 1))
            for rows in batches:
                seen = [rows.column(f"n{k}").to_numpy() > 0 for k in classes]
                for at, matrix in by_length(rows.column("word").to_pylist()):
                    for part, own in _split_long(matrix, at):
                        arcs = list(models[0].arcs(part))
                        for k, model in enumerate(models):
                            keep = seen[k][own]
                            if not keep.any():
                                continue
                            some = [(n, ids[keep]) for n, ids in arcs]
                            if part.shape[1] > LONG_WORD:
                                total[k, :-1] += _expected_one(model, 1.0, some, part.shape[1])
                            else:
                                total[k, :-1] += model.expected(part[keep], np.ones(int(keep.sum())), some)
            flat = total[:, :-1].ravel()
            found = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(flat[found])], ["at", "n"])

        sums = vocabulary.mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()
        expected = np.zeros(len(words) * len(pieces))
        for r in sums:
            expected[r["at"]] = r["n"]
        lattices = [Lattice.of(names, PRIOR * prior + discounts[k] * n, whole[k], discounts[k])
                    for k, n in enumerate(np.split(expected, len(words)))]
        shared.unpersist()
    return lattices


def class_names(docs: DataFrame, train: Column, classes: Column | None) -> list[str | None]:
    """The classes with at least ``MIN_SHARE`` of the training texts; None
    stands for the rest (or all, without classes) if there are any."""
    if classes is None:
        return [None]
    counts = docs.where(train).groupBy(classes.cast("string").alias("class")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    large = counts.where((F.col("n") >= MIN_SHARE * total) & F.col("class").isNotNull()).orderBy("class").collect()
    named = [r["class"] for r in large]
    return [*named, None] if sum(r["n"] for r in large) < total or not named else named


def score(docs: DataFrame, train: Column, pieces: dict[bytes, float], run: Workspace, classes: Column | None = None,
          group_bytes: int = GROUP_BYTES, passes: int = EM_PASSES) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10)
    of every document; learns from the rows where ``train`` holds, by the
    value of ``classes`` if given."""
    spark = docs.sparkSession
    named = class_names(docs, train, classes)
    kinds = len(named)
    kind = F.lit(kinds - 1)
    for k, name in enumerate(named):
        kind = kind if name is None else F.when(classes.cast("string") == name, k).otherwise(kind)
    grouped = run.table(group_documents(docs, train, kind, kinds, group_bytes), "grouped")
    texts, words = grouped.where("word is null"), grouped.where("word is not null")
    # a group's words and documents are some tens of megabytes: two groups a partition, whatever the session's number is
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-texts.select("grp").distinct().count() // 2))
    per_kind = [f"n{k}" for k in range(kinds)]
    vocabulary = run.table(words.groupBy("word").agg(*[F.sum(n).alias(n) for n in per_kind]), "vocabulary")
    in_all = sum((F.col(n) for n in per_kind[1:]), F.col(per_kind[0]))
    known = vocabulary.where(in_all > 0)
    tidy(spark)
    sums_row = known.agg(F.count("*").alias("v"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in per_kind],
                         *[F.count_if(F.col(n) == i if i else F.col(n) > 0).alias(f"v{i}_{n}") for n in per_kind for i in range(3)]).first()
    tokens, types = [sums_row[n] for n in per_kind], [sums_row[f"v0_{n}"] for n in per_kind]
    discounts = [discount(sums_row[f"v1_{n}"], sums_row[f"v2_{n}"]) for n in per_kind]
    of_kind = {r["kind"]: r["n"] for r in texts.where("kind is not null").groupBy("kind").agg(F.count("*").alias("n")).collect()}
    ends = sum(of_kind.values())
    total, distinct = sum(tokens) + ends, sums_row["v"] + (ends > 0)
    log_share = np.log([(of_kind.get(k, 0) + 1e-3) / (ends + 1e-3 * kinds) for k in range(kinds)])
    log_end, log_go_on = np.log((ends + 1) / (total + 2)), np.log((sum(tokens) + 1) / (total + 2))
    shared = spark.sparkContext.broadcast(fit(known, pieces, tokens, types, discounts, passes))

    def marginal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            c = np.stack([rows.column(n).to_numpy() for n in per_kind], axis=1)
            logs = word_scores(shared.value, rows.column("word").to_pylist(), c)
            yield pa.RecordBatch.from_arrays([rows.column("word"), pa.array(c.sum(axis=1)), *[pa.array(x) for x in logs.T.astype(np.float32)]],
                                             ["word", "c", *[f"p{k}" for k in range(kinds)]])

    p_names = [f"p{k}" for k in range(kinds)]
    scored = run.table(vocabulary.mapInArrow(marginal, "word binary, c long, " + ", ".join(f"{p} float" for p in p_names)), "scored")
    run.drop("vocabulary")
    tidy(spark)
    per_group = (words.select(F.col("grp").alias("in_grp"), "number", "word").repartition(parts, "word").join(scored, "word")
                 .select("in_grp", "number", "c", *p_names).repartition(parts, "in_grp"))

    def sums(texts: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        at = values["number"].to_numpy()
        c, logs = np.zeros(len(at), np.int64), np.zeros((len(at), kinds))
        c[at], logs[at] = values["c"].to_numpy(), values[p_names].to_numpy()
        base = np.log10((c + 1) / (total + distinct + 1))
        base_end = np.log10((ends + 1) / (total + distinct + 1))
        rows = []
        for numbers, counts in zip(texts["numbers"], texts["counts"], strict=True):
            w, k = np.frombuffer(numbers, np.int32), np.frombuffer(counts, np.int32).astype(np.int64)
            by_class = log_share + k @ logs[w]
            top = by_class.max()
            marginal_log = top + np.log(np.exp(by_class - top).sum()) + k.sum() * log_go_on + log_end
            rows.append((int(k.sum()) + 1, int(k[c[w] > 0].sum()) + (ends > 0), total, k @ base[w] + base_end, marginal_log / np.log(10)))
        out = pd.DataFrame(rows, columns=["n_tokens", "n_known", "train_tokens", "base_score", "score"])
        out.insert(0, "doc_id", pd.array(texts["doc_id"], dtype="Int64"))
        return out

    return (texts.select("grp", "doc_id", "numbers", "counts").repartition(parts, "grp").groupBy("grp").cogroup(per_group.groupBy("in_grp"))
            .applyInPandas(sums, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
