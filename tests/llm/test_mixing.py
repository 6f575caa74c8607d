"""Curriculum, source divergence and hard negatives against plain versions,
with nulls, ties, repeated rows, empty tables and clashing columns."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetscope.llm import curriculum, hard_negatives, source_divergence
from tests.llm import plain

# --- hard negatives -----------------------------------------------------------


def hard_negatives_plain(rows, positives=5, negatives=10):
    """rows: (id, label, vector of integers)."""
    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = []
    for a_id, a_label, a in {(i, label, tuple(v)) for i, label, v in rows if i % 100 == 0}:
        scored = sorted(((-score(a, v), i, label) for i, label, v in rows))
        for s, p_id, _ in [r for r in scored if r[2] == a_label and r[1] != a_id][:positives]:
            fits = [(n, i) for n, i, label in scored if label != a_label and 30 * -s <= 100 * -n <= 90 * -s][:negatives]
            out += [(a_id, p_id, k + 1, i, -s, -n) for k, (n, i) in enumerate(fits)]
    return sorted(out)


EMBEDDINGS = "vec_id long, label int, embedding array<float>, id string, v int, rank int"


def embeddings(spark, rows):
    return spark.createDataFrame([(*r, "clash", 0, 0) for r in rows], EMBEDDINGS)


def mined(frame, run, **how):
    rows = hard_negatives.quantised(frame, F.col("vec_id"), F.col("label"), F.col("embedding"))
    found = hard_negatives.mine(rows, F.col("id") % 100 == 0, run, **how)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("how", [{}, {"components": 40, "block": 7}])
def test_hard_negatives(spark, run, how):
    rnd = random.Random(7)
    centre = [rnd.uniform(0, 0.5) for _ in range(8)]
    rows = [(rnd.randrange(0, 900, 4) if i % 50 else 100 * (i // 50), rnd.choice([1, 1, 1, 2, 3]),
             [round(c + rnd.uniform(-0.3, 0.3), rnd.choice([1, 2, 6])) for c in centre[: rnd.choice([8, 8, 8, 5, 0])]]) for i in range(400)]
    rows += [(100, 1, [0.25] * 8), (100, 1, [0.25] * 8), (200, 2, [-0.25] * 8)] + rows[:40]  # repeated and tied rows
    extra = [(None, 1, centre), (300, None, centre), (304, 1, None), (308, 1, [None, 0.1]), (300, 1, [math.nan]), (300, 2, [math.inf, 0.0])]
    exact = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, label, v in rows]
    want = hard_negatives_plain(exact)
    assert mined(embeddings(spark, rows + extra), run, **how) == want and len(want) > 300


def test_hard_negatives_of_nothing(spark, run):
    assert mined(embeddings(spark, []), run) == []
    assert mined(embeddings(spark, [(100, 1, [0.5]), (101, 2, [0.3])]), run) == []  # no other row of the label
    assert mined(embeddings(spark, [(101, 1, [0.5]), (102, 2, [0.3])]), run) == []  # no anchor


@pytest.mark.parametrize("bits", [3, 9, 20, 40])
def test_packed_products_are_exact(bits):
    rnd = random.Random(bits)
    for n, d in ((1, 1), (5, 64), (300, 3), (0, 4)):
        vectors = np.array([[rnd.randint(-2**bits, 2**bits) for _ in range(d)] for _ in range(n)], np.int64).reshape(n, d)
        anchor = [rnd.choice([0, rnd.randint(-2**(bits // 2), 2**(bits // 2))]) for _ in range(d)]
        got = hard_negatives.Packed(vectors, max(map(abs, anchor))).scores(anchor).tolist()
        assert got == [sum(int(x) * a for x, a in zip(v, anchor)) for v in vectors]


def test_scores_beyond_64_bits_raise():
    with pytest.raises(OverflowError):
        hard_negatives.Packed(np.array([[1 << 61]]), 1 << 10).scores([1 << 10])


# --- source divergence ----------------------------------------------------------

def divergences_plain(rows, min_documents=10):
    """rows: (lang, source, text) -> set of result rows."""
    docs, counts, seen = [(a or "", s or "", t or "") for a, s, t in rows], defaultdict(Counter), defaultdict(Counter)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, source, text in docs:
        found = "".join(c if c.isascii() and c.isalpha() or ord(c) > 127 else " " for c in text.translate(lower)).split(" ")
        found = [t for t in found if t]
        counts[lang, source].update(found)
        seen[lang].update(set(found))
    out = set()
    for lang in {lang for lang, *_ in docs}:
        kept = sorted(t for t, n in seen[lang].items() if n >= min_documents)
        groups = sorted({s for a, s, _ in docs if a == lang})

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in groups}
        whole = shares(sum((counts[lang, s] for s in groups), Counter()))

        def f(x, y):
            return (x - y) ** 2 // (x + y)

        for s in groups:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in groups if o != s)
            lead = sorted((-f(p[s][t], whole[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > whole[t])
            out |= {(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(pairs)}
            out |= {(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(lead[:10])}
    return out


@pytest.mark.parametrize("how", [{}, {"per_groups": 2, "per_terms": 3}])
def test_source_divergence(spark, run, how):
    rnd = random.Random(3)
    words = ["The", "the", "of", "naïve", "Été", "x1y", "a-b", " z", "Q", "zebra", "rare", "日本"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(rnd.choice(["en", "de", None, ""]), rnd.choice(["s1", "s2", "s3", "S3", "é", None, "hot", "hot", "hot"]),
             " ".join(rnd.choices(words, k=rnd.randint(0, 30)))) for _ in range(300)]
    rows += [("en", "none", None), ("en", "blank", ""), ("xx", "only", "one two"), ("yy", "a", "b"), ("yy", "b", "c"), ("en", "long", "the " * 5000)] + rows[:30]
    frame = spark.createDataFrame([(i, t, a, s, 0, "clash", "clash", 1) for i, (a, s, t) in enumerate(rows)],
                                  "doc_id long, text string, lang string, source string, n long, term string, block string, docs int")
    found = source_divergence.audit(frame, run, **how)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == divergences_plain(rows)
    assert source_divergence.audit(frame.limit(0), run).count() == 0


def test_counts_leave_a_task_in_parts(spark, run, monkeypatch):
    rows = [(i, f"common w{chr(97 + i % 26)} w{chr(97 + i % 7)}", "en", f"s{i % 3}", 0) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = {tuple(r) for r in source_divergence.audit(frame, run).collect()}
    batches = frame.select("lang", "source", F.col("text").cast("binary").alias("text")).toArrow().to_batches(10)
    monkeypatch.setattr(source_divergence, "HELD", 5)
    parts = list(source_divergence._counts(iter(batches)))
    total = Counter()
    for part in parts:
        for r in part.to_pylist():
            total[r["source"], r["term"]] += r["n"]
    assert len(parts) > 10 and total == Counter((s, w) for _, t, _, s, _ in rows for w in t.split())
    assert want == divergences_plain([(a, s, t) for _, t, a, s, _ in rows])


# --- curriculum -----------------------------------------------------------------

def targets_plain(sizes, budget):
    """sizes by source -> target, resharing the excess round by round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, capped = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, set()
    while True:
        rest = budget - sum(2 * sizes[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[o] for o in order if o not in capped) for s in order if s not in capped}
        above = {s for s, t in share.items() if t >= 2 * sizes[s]}
        if not above:
            return share | {s: 2.0 * sizes[s] for s in capped}
        capped |= above
        if len(capped) == len(order):
            return {s: 2.0 * sizes[s] for s in order}


def knots(*points):
    return F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(w)).alias("w")) for t, w in points])


def schedule():
    turn = F.col("rank") % 3
    jump = knots((0, 1), (0.5, 1), (0.5, 3), (1, 3))
    return F.when(turn == 0, knots((0, 4.5), (1, 1.5))).when(turn == 1, knots((0, 1), (1, 1))).otherwise(jump)


def mixture(spark, run, rows):
    frame = spark.createDataFrame([(*r, 0, "clash", 1, 2) for r in rows],
                                  "doc_id long, text string, source string, size long, target string, before long, rank long")
    return curriculum.mix(frame, schedule(), run, budget=F.sum("has") * 1.5)


def demand(rank, t):
    """Share of a source's schedule up to t."""
    if rank % 3 == 0:
        return (4.5 * t - 1.5 * t * t) / 3
    return t if rank % 3 == 1 else (t if t <= 0.5 else 0.5 + 3 * (t - 0.5)) / 2


def test_curriculum(spark, run):
    rnd = random.Random(9)
    sources = ["a", "b", "B", "é", "\U0001F600", "￮", None, "hot", "hot", "hot", "hot"]
    rows = [(rnd.choice([i, i, i, 7, None]), " ".join(["w"] * rnd.choice([0, 1, 3, 20, 200])), rnd.choice(sources)) for i in range(600)]
    rows += [(1000, None, "a"), (1001, "", "nothing"), (1002, None, "nothing"), (1003, "x y z\tz\x0bz", "b"), (1004, "long " * 20000, "B")] + rows[:50]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(plain.words(t))
    want = targets_plain(sizes, 1.5 * sum(sizes.values()))
    ranks = {s: i for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    mixed = mixture(spark, run, rows)
    got = mixed.collect()
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((d, len(plain.words(t)), s) for d, t, s in rows)
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(u.words for u in r.uses)
    assert all(taken[s] == round(t) for s, t in want.items())
    assert any(t == 2 * sizes[s] for s, t in want.items()) and any(t < 2 * sizes[s] for s, t in want.items())
    order = curriculum.training_order(mixed, run).collect()
    takes = sorted((r for r in order if r.words), key=lambda r: r.first_word)
    place = 0
    queue = defaultdict(int)
    for r in takes:  # in training order every take starts where the one before ends, and sources keep to their curves
        assert r.first_word == place
        assert demand(ranks[r.source], r.position) == pytest.approx(queue[r.source] / r.target, abs=1e-9)
        place += r.words
        queue[r.source] += r.words
    assert [r.position for r in takes] == sorted(r.position for r in takes) and place == sum(taken.values())
    again = mixture(spark, run, random.Random(1).sample(rows, len(rows))).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_curriculum_of_nothing(spark, run):
    assert mixture(spark, run, []).count() == 0
    empty = mixture(spark, run, [(1, None, "a"), (2, "", None)])
    assert {(r.doc_id, r.target, r.taken, len(r.uses)) for r in empty.collect()} == {(1, 0.0, 0, 0), (2, 0.0, 0, 0)}
    assert curriculum.training_order(empty, run).count() == 2


def test_running_total_over_many_partitions(spark, run):
    rows = [(None if i % 3 == 0 else f"k{i % 2}", i * 37 % 1000, i % 5) for i in range(1000)]
    frame = spark.createDataFrame(rows, "k string, o long, v long").repartition(7)
    got = {(r.k, r.o): r.before for r in curriculum.running_total(frame, ["k"], ["o"], F.col("v"), run, "sums").collect()}
    want, total = {}, Counter()
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        want[k, o] = total[k]
        total[k] += v
    assert got == want
