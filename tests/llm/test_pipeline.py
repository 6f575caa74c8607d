"""The pipeline against plain versions of its stages on a small table."""

import random
import re
from collections import defaultdict

import corpus_pipeline
from fleetscope.llm import decontaminate, secret_scan
from tests.conftest import SF_SMALL
from tests.llm import plain
from tests.llm.test_operators import check_packing


def test_stages_and_run(spark, small, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    seen = {}
    current = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, current, SF_SMALL).write.parquet(str(tmp_path / name))
        current = spark.read.parquet(str(tmp_path / name))
        seen[name] = current
        if name != "packing":
            assert current.columns == docs.columns
    texts = {d: t for d, t, _ in small}
    kept = {r.doc_id for r in seen["language_id"].collect()}
    assert kept >= {d for d, t in texts.items() if len(t) > 100}
    comp = plain.components([(d, plain.simhash64(texts[d])) for d in sorted(kept)])
    kept = {d for d, c in comp.items() if d == c}
    assert {r.doc_id for r in seen["near_dups"].collect()} == kept
    plain_items = [decontaminate.plain(x) for x in items]
    dirty = {d for d in kept if any(x in decontaminate.plain(texts[d]) for x in plain_items)}
    clean = {r.doc_id for r in seen["decontamination"].collect()}
    assert clean == kept - dirty
    masked = {r.doc_id: r for r in seen["secrets"].collect()}
    assert set(masked) == clean
    for d, r in masked.items():
        spans = []
        for rule in secret_scan.RULES:
            flags = re.ASCII | (re.I if rule.pattern.startswith("(?i)") else 0)
            spans += [m.span() for m in re.finditer(rule.pattern.replace("(?i)", ""), texts[d], flags) if len(m[rule.group]) >= rule.min_length]
        out, at = [], 0
        for a, b in sorted(spans):
            if a >= at:
                out += [texts[d][at:a], "[secret]"]
            at = max(at, b)
        want = "".join(out) + texts[d][at:]
        assert (r.text, r.n_chars) == (want, len(want))
    pieces = seen["packing"].collect()
    check_packing(pieces, {d: r.text for d, r in masked.items()})
    by = defaultdict(int)
    for r in corpus_pipeline.run(spark, SF_SMALL).collect():
        by[r.doc_id] += r.length
    assert by == {d: sum(p.length for p in pieces if p.doc_id == d) for d in masked}


def test_empty_and_null_documents(spark, documents, tmp_path):
    import shutil

    for name, rows in (("empty", []), ("nulls", [(1, None, None), (None, "some words here", "en"), (2, "", "en"), (3, "more words there", "en"),
                                                  (3, "more words there", "en"), (4, "123", "en")])):
        folder = tmp_path / name
        documents(rows).write.parquet(str(folder / "documents.parquet"))
        shutil.copy(f"{SF_SMALL}/benchmark.parquet", folder / "benchmark.parquet")
        got = corpus_pipeline.run(spark, str(folder)).collect()
        assert sorted({r.doc_id for r in got}, key=str) == ([] if not rows else [3, None])
        assert sum(r.start == 0 for r in got) == (2 if rows else 0)


def test_near_dups_of_repeated_and_null_ids(spark, documents):
    """Ids with two texts keep each text that is no near-duplicate, two linked
    texts of an id are one row, and a null-id text links its neighbours."""
    rnd = random.Random(12)

    def edits(words, want, of):
        while True:
            copy = list(words)
            for k in rnd.sample(range(len(copy)), 3):
                copy[k] = f"y{rnd.randrange(999)}"
            if want((plain.simhash64(" ".join(copy)) ^ of).bit_count()):
                return copy

    def new():
        return [f"w{rnd.randrange(9999)}" for _ in range(600)]

    a, b, c, d = (" ".join(new()) for _ in range(4))
    a_near = " ".join(edits(a.split(), lambda n: 0 < n <= 4, plain.simhash64(a)))
    d_near = " ".join(edits(d.split(), lambda n: 0 < n <= 4, plain.simhash64(d)))
    middle = new()
    left = edits(middle, lambda n: 2 < n <= 4, plain.simhash64(" ".join(middle)))
    while True:
        right = edits(middle, lambda n: 2 < n <= 4, plain.simhash64(" ".join(middle)))
        if (plain.simhash64(" ".join(left)) ^ plain.simhash64(" ".join(right))).bit_count() > 4:
            break
    rows = [(1, a), (3, a_near), (3, b), (3, c), (5, d), (5, d_near), (7, " ".join(left)), (None, " ".join(middle)), (8, " ".join(right))]
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, documents(rows), SF_SMALL).collect()), key=str)
    kept_d = min(d, d_near, key=lambda t: (plain.simhash64(t) ^ 1 << 63))
    assert got == sorted([(1, a), (3, b), (3, c), (5, kept_d), (7, " ".join(left)), (None, " ".join(middle))], key=str)


def test_a_corpus_without_labels_is_kept(spark, documents):
    docs = documents([(1, "some words here"), (2, None), (3, ""), (4, "123 !"), (5, "été"), (None, "x")])
    assert sorted((r.doc_id or 0) for r in corpus_pipeline.identify_language(spark, docs, SF_SMALL).collect()) == [0, 1, 5]


def test_clashing_columns_pass_through(spark, documents, tmp_path):
    names = ["_language", "_hash", "_row", "_blob", "_spans", "_part", "_Hash_", "fp", "blob", "spans", "keeper", "block", "key", "size"]
    plain_docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    docs = plain_docs.selectExpr("*", *[f"concat('{n} ', doc_id) as `{n}`" for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF_SMALL)
        assert kept.columns == docs.columns
        kept.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        bare = stage(spark, plain_docs, SF_SMALL)
        assert {tuple(r) for r in docs.select(plain_docs.columns).collect()} == {tuple(r) for r in bare.collect()}
        assert all(r[n] == f"{n} {r.doc_id}" for r in docs.collect() for n in names)
        plain_docs = docs.select(plain_docs.columns)
    corpus_pipeline.pack_documents(spark, docs, SF_SMALL).count()
