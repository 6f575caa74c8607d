"""Language ID: multinomial logistic regression on TF-IDF character n-grams.

Whole texts are counted into hashed n-grams of one to three characters (lower
case, ASCII other than letters as spaces). Document frequencies come from all
training texts. The weights are learned by follow-the-regularised-leader with
per-coordinate rates and an elastic net (L1 and L2) on a bounded sample: at
most about ``SAMPLE_ROWS`` distinct texts, an equal share per language, chosen
by a hash of the text. Every fifth text of each language is kept out of the fit
and sets one temperature, so scores are calibrated probabilities; the first
four of a language always stay in the fit. The model (features x
languages) is broadcast; its size does not depend on the corpus.

Edge cases: a null text, or one without a letter, is ``und`` with score 0, and
so is every text if nothing can be learned; training skips rows with null
language or text; rows with equal texts are learned from once; very long texts
are counted in pieces that overlap, so no n-gram is lost; ties go to the first
language in order; extra columns are kept where a frame is passed through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = 1 << 15
SAMPLE_ROWS = 4096
UNKNOWN = "und"  # fixed value
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)  # odd multipliers, one per place in an n-gram
_PIECE = 1 << 18


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(feature, count) of the n-grams of one to three characters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where((points < 97) | ((points > 122) & (points < 128)), np.uint32(32), points)
    total = np.zeros(FEATURES, np.int64)
    for lo in range(0, len(points), _PIECE):
        part = points[lo:lo + _PIECE + 2] * _MIX[:, None]
        key = part[0].copy()
        for order in range(3):
            if order:
                key = key[:-1] * np.uint32(31) + part[order][order:]
            starts = key[: _PIECE] ^ (key[: _PIECE] >> np.uint32(15))
            total += np.bincount(starts * np.uint32(0x2C1B3C6D) >> np.uint32(17), minlength=FEATURES)
    found = np.flatnonzero(total)
    return found, total[found]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def letters(text: Column) -> Column:
    """Whether a text, not null, has a letter."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray  # (FEATURES,)
    weights: np.ndarray  # (FEATURES, languages)
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """L2-normalised TF-IDF values of the found features."""
        x = (1 + np.log(counts)) * self.idf[found]
        return x / max(np.sqrt(x @ x), 1e-12)

    def logits(self, found: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[found] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        found, counts = ngram_counts(text)
        p = softmax(self.logits(found, self.vector(found, counts)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(model: Model, rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 4, alpha: float = 1.0,
             beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> None:
    """FTRL-proximal on (language, features, values) rows, in place. Per
    coordinate: z sums gradients less the proximal pull, n their squares; a
    weight is zero until |z| exceeds ``l1``."""
    z, n = np.zeros_like(model.weights), np.zeros_like(model.weights)
    bias_n = np.zeros_like(model.bias)
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            label, found, x = rows[i]
            w = model.weights[found]
            error = softmax(x @ w + model.bias)
            error[label] -= 1
            g = x[:, None] * error
            total = n[found] + g * g
            z[found] += g - (np.sqrt(total) - np.sqrt(n[found])) / alpha * w
            n[found] = total
            pull = z[found]
            model.weights[found] = np.where(np.abs(pull) <= l1, 0, -(pull - np.sign(pull) * l1) / ((beta + np.sqrt(total)) / alpha + l2))
            bias_n += error * error
            model.bias -= 0.1 * error / (1 + np.sqrt(bias_n))


def calibrate(model: Model, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
    """Temperature with the least log loss on rows outside the fit (golden
    section over its logarithm)."""
    if not rows:
        return
    logits = np.array([model.logits(found, x) for _, found, x in rows])
    labels = np.array([label for label, _, _ in rows])

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean()

    lo, hi, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    model.temperature = float(np.exp((lo + hi) / 2))


def document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """How many training texts hold each feature, and the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            texts = batch.column("text")
            for i in range(len(batch)):
                df[ngram_counts(texts[i].as_py())[0]] += 1
            n += len(batch)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(df[seen], n))], ["feature", "df"])

    out, n = np.zeros(FEATURES, np.int64), 0
    for feature, df in train.select("text").mapInArrow(run, "feature long, df long").groupBy("feature").agg(F.sum("df")).collect():
        if feature < 0:
            n = df
        else:
            out[feature] = df
    return out, n


def sample(train: DataFrame, rows: int) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    """About ``rows`` distinct training texts at most, as (language, hash,
    features, counts), an equal share per language."""
    texts = train.select("lang", "text", F.xxhash64("text").alias("h"))
    sizes = {r["lang"]: r["n"] for r in texts.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, rows / len(sizes) / n)).otherwise(share)
    chosen = texts.where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).dropDuplicates(["lang", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = [ngram_counts(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("h"), pa.array([f.astype(np.int32).tobytes() for f, _ in coded], pa.binary()),
                 pa.array([c.astype(np.int32).tobytes() for _, c in coded], pa.binary())], ["lang", "h", "found", "counts"])

    got = chosen.mapInArrow(run, "lang string, h long, found binary, counts binary").collect()
    return [(r["lang"], r["h"], np.frombuffer(r["found"], np.int32), np.frombuffer(r["counts"], np.int32))
            for r in sorted(got, key=lambda r: (r["h"], r["lang"]))]


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Model from the texts and languages of ``labelled`` (text, lang)."""
    usable = labelled.where("text is not null and lang is not null").select("text", "lang")
    df, n = document_frequencies(usable)
    drawn = [row for row in sample(usable, sample_rows) if len(row[2])]
    languages = sorted({lang for lang, *_ in drawn})
    idf = np.log((1 + n) / (1 + df)) + 1
    model = Model(languages, idf, np.zeros((FEATURES, len(languages))), np.zeros(len(languages)))
    fit, held = [], []
    seen = Counter()
    for lang, _, found, counts in drawn:
        seen[lang] += 1
        (held if seen[lang] % 5 == 0 else fit).append((languages.index(lang), found, model.vector(found, counts)))
    if fit:
        fit_ftrl(model, fit)
        calibrate(model, held)
    return model


def predict(text: Column, model: Model, spark) -> Column:
    """Struct (lang, score) of each whole text."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang", "score"])

    return run(text)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds
