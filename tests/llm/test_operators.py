"""Every operator's query against a plain version, a round trip, SQL or
held-out accuracy, on whole small tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetscope.llm import decontaminate, fingerprints, lm_score, near_dups, queries, suffix_dedup, url_filter
from fleetscope.workspace import Workspace
from tests.conftest import SF_SMALL
from tests.llm import plain
from tools.oracle_check import compare, duck


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    got = compare(spark, duck(SF_SMALL), name, queries.queries()[name], queries.oracle_sql()[name], SF_SMALL)
    assert got.startswith("ok"), got


def test_fingerprints(spark, small):
    rows = {r.doc_id: r for r in queries.op1_fingerprints(spark, SF_SMALL).collect()}
    texts = [t for _, t, _ in small]
    edited = [t[: len(t) - len(t) // 2] + texts[(i + 1) % len(texts)][: len(t) // 2] for i, t in enumerate(texts)]
    fps = [plain.simhash128(t) for t in texts]

    def likeness(a, b):
        return 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128

    for i, (d, t, _) in enumerate(small):
        r = rows[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited[i].encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fps[i], plain.simhash128(edited[i]))
        assert r.near_edited == likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == likeness(r.fingerprint, fps[(i + 1) % len(texts)])
        near = sum((int(fps[i], 16) ^ int(f, 16)).bit_count() <= fingerprints.RADIUS for f in fps)
        assert r.n_near == (near if d % 20 == 0 else None)
    assert np.mean([r.near_edited > r.near_next for r in rows.values()]) > 0.95


def test_fingerprint_terms():
    texts = ["", " ", "a", "a b", "a b c", "A  b\tc d", "é ü x"]
    h, weight, firsts = fingerprints.terms([t.encode() for t in texts])
    assert np.diff(firsts).tolist() == [0, 0, 1, 1, 1, 2, 1]
    assert h[2] == h[3] and weight[2] == 5  # case and white space don't matter to the hash


def test_long_terms_keep_their_weight():
    rnd = random.Random(4)
    texts = ["x" * n + " " + " ".join(rnd.choice(["ab", "cd", "ef"]) for _ in range(40)) + " y" * (n % 7) for n in (1, 255, 256, 1000, 70_000)]
    assert [f.hex() for f in fingerprints.fingerprint_texts([t.encode() for t in texts])] == [plain.simhash128(t) for t in texts]
    assert fingerprints.terms([("x" * 100_000 + " a b").encode()])[1].tolist() == [100_004]


def test_block_tables_find_all_pairs(spark, run):
    rnd = random.Random(2)
    base = [rnd.getrandbits(128) for _ in range(20)]
    fps = [f"{b ^ sum(1 << k for k in rnd.sample(range(128), rnd.randint(0, 4))):032x}" for b in base for _ in range(6)]
    frame = spark.createDataFrame([(f,) for f in set(fps)], "fp string")
    got = {tuple(r) for r in fingerprints.within_radius(frame, frame).collect()}
    want = {(a, b) for a in set(fps) for b in set(fps) if (int(a, 16) ^ int(b, 16)).bit_count() <= fingerprints.RADIUS}
    assert got == want and len(want) > len(set(fps))


def test_near_copies_are_found(spark, small, run):
    """Texts with a word in every 50 changed, so that a good four fifths of
    their 5-word shingles stay, are counted with their originals."""
    def shingles(words):
        return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}

    rnd, rows, pairs = random.Random(6), [], 0
    for _, text, _ in small:
        words = plain.words(text)
        if len(words) < 200 or pairs == 40:
            continue
        copy = list(words)
        for i in range(rnd.randrange(20), len(copy), 50):
            copy[i] = f"q{rnd.randrange(9999)}"
        a, b = shingles(words), shingles(copy)
        if len(a & b) / len(a | b) >= 0.8:
            rows += [" ".join(words), " ".join(copy)]
            pairs += 1
    fps = [f.hex() for f in fingerprints.fingerprint_texts([t.encode() for t in rows])]
    frame = spark.createDataFrame([(f, i % 2 == 0) for i, f in enumerate(fps)], "fp string, q boolean")
    near = {r.fp: r.n_near for r in fingerprints.neighbour_counts(frame, run, F.col("q")).collect()}
    want = {f: sum((int(f, 16) ^ int(g, 16)).bit_count() <= fingerprints.RADIUS for g in fps) for f in fps[::2]}
    assert near == want and pairs >= 20
    assert sum(near[f] >= 2 for f in fps[::2]) >= 0.95 * pairs


def test_language_id(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_SMALL.replace('0.001', '0.01')}/documents.parquet").collect()}
    rows = queries.op2_language_id(spark, SF_SMALL.replace("0.001", "0.01")).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in langs if zlib.crc32(str(d).encode()) % 4 == 2}
    assert np.mean([langs[r.doc_id] == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_near_dups(spark, small):
    rows = {r.doc_id: r for r in queries.op3_near_dups(spark, SF_SMALL).collect()}
    fps = [(d, plain.simhash64(t)) for d, t, _ in small]
    assert {d: r.fingerprint for d, r in rows.items()} == {d: f"{f:016x}" for d, f in fps}
    assert {d: r.component_id for d, r in rows.items()} == plain.components(fps)


@pytest.mark.parametrize("block", [4, 50])
def test_near_dups_in_many_blocks(spark, run, documents, block):
    rnd = random.Random(4)
    base = " ".join(f"w{rnd.randint(0, 500)}" for _ in range(300)).split()
    rows = []
    for i in range(120):
        w = list(base) if i % 3 else [f"x{rnd.randint(0, 900)}" for _ in range(60)]
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = f"y{rnd.randint(0, 99)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(documents(rows), run, block=block).collect()}
    assert got == plain.components([(d, plain.simhash64(t)) for d, t in rows])


@pytest.mark.parametrize("budget", [1, 4])
def test_trie_walk(budget):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 100, dtype=np.uint64)
    leaves = np.unique([b ^ np.uint64(sum(1 << int(k) for k in set(rng.integers(0, 64, rng.integers(0, 5)).tolist())))
                        for b in base for _ in range(6)])
    a, b = leaves[::2], leaves[1::2]
    near = np.bitwise_count(leaves[:, None] ^ leaves) <= budget
    got = sorted((int(i), int(j)) for u, v in near_dups.trie_links(leaves, leaves, budget, True) for i, j in zip(u, v, strict=True))
    assert got == [(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j]
    got = sorted((int(i), int(j)) for u, v in near_dups.trie_links(a, b, budget, False) for i, j in zip(u, v, strict=True))
    assert got == list(zip(*np.nonzero(np.bitwise_count(a[:, None] ^ b) <= budget), strict=True))


def test_components_of_long_chains(spark, run):
    edges = [(i, i + 1) for i in range(299) if i % 50 != 49] + [(1000, 1001)]
    got = {r.node: r.root for r in near_dups.components(spark.createDataFrame(edges, "u long, v long"), run).collect()}
    assert got == {**{i: i // 50 * 50 for i in range(300)}, 1000: 1000, 1001: 1000}


def encoded(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    if not hasattr(encoded, "t"):
        encoded.t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [*encoded.t.encode(text or "", add_special_tokens=False).ids, 1]


def check_packing(rows, docs):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(docs)
    for d, own in pieces.items():
        ids, at = encoded(docs[d]), 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            at += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:at], "<u4").tobytes())
        assert at == len(ids)
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding += 0 if at.bit_count() == 1 else 2048 - at
    assert padding == 0


@pytest.mark.parametrize("labels", [["en", "de", None], ["en"], [None], [f"l{i}" for i in range(50)]])
def test_lattice_scores_match_all_segmentations(spark, run, labels):
    """Whole-word units, discounts, adapted weights, the mixture over classes
    (more of them than have a share of their own, too) and the ends."""
    rnd = random.Random(len(labels))
    words = ["a", "ab", "abc", "the", "then", "bath", "é", "hat", "tab", "ABBA", "zq"]
    rows = [(i, " ".join(rnd.choices(words, weights=[9, 9, 5, 9, 3, 2, 2, 1, 1, 1, 1], k=rnd.randint(0, 12))), rnd.choice(labels)) for i in range(80)]
    rows += [(100, "unseen bathtub", "en"), (101, None, None)]
    raw = {bytes([b]): 1 + b % 3 for b in range(256)} | {b" the": 50, b"ab": 20, b" a": 30, b" ab": 9, b"th": 11, b"hat": 4, b"at": 7}
    pieces = {p: n / sum(raw.values()) for p, n in sorted(raw.items())}
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = F.col("doc_id") % 5 != 0
    got = {r.doc_id: r.score for r in lm_score.score(frame, train, pieces, run, F.col("lang"), group_bytes=200).collect()}
    want = plain.lattice_scores([(d % 5 != 0, lang, t) for d, t, lang in rows], pieces)
    assert [got[d] for d, *_ in rows] == pytest.approx(want, rel=1e-5)


def test_piece_weights_follow_the_vocabulary():
    import public_tokenizers

    pieces = lm_score.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    assert sum(pieces.values()) == pytest.approx(1) and {bytes([b]) for b in range(256)} <= set(pieces)
    assert pieces[b" t"] / pieces[b"in"] == pytest.approx(4 / 3)  # scores -2 and -3: ranks


def test_packing(spark, small):
    check_packing(queries.op4_packing(spark, SF_SMALL).collect(), {d: t for d, t, _ in small})


def test_token_cache_matches_the_tokenizer():
    coder = queries.word_tokens.__wrapped__()
    coder.limit = 50
    rnd = random.Random(1)
    for _ in range(200):
        text = "".join(rnd.choice(["ab", "Don't ", " ", "\n", "é", "1", "!?", ", ", ".", "; ", "ño", "ª", "\u00a0", "<|endoftext|>", "<|ENDOFTEXT|>", "İ", "e\u0301 "])
                       for _ in range(rnd.randint(0, 40)))
        assert [*next(coder.ids([text.encode()])).tolist(), 1] == encoded(text)


def test_decontamination(spark, small):
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id) for r in queries.op5_decontamination(spark, SF_SMALL).collect()}
    exact = {(d, i) for d, t, _ in small for i, x in items if x in t}
    assert exact and exact <= got
    for d, i in got - exact:
        item = decontaminate.plain(dict(items)[i])
        assert plain.edit_search(item, decontaminate.plain(dict((d, t) for d, t, _ in small)[d]))[0] <= len(item) * decontaminate.RATE


def test_edit_matching_equals_brute_force():
    rnd = random.Random(1)
    for _ in range(500):
        letters = "ab " if rnd.random() < 0.5 else "abcdefgh "
        item = "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60)))
        noisy = list(item)
        for _ in range(rnd.randint(0, 8)):
            k = rnd.randrange(len(noisy) + 1)
            noisy[k:k + rnd.randint(0, 1)] = rnd.choice(letters) * rnd.randint(0, 1)
        text = "".join(rnd.choice(letters) for _ in range(40)) + "".join(noisy) + "".join(rnd.choice(letters) for _ in range(40))
        rate = rnd.choice([0.1, 0.15, 0.2])
        distance, end = plain.edit_search(item, text)
        got = decontaminate.Matcher([(7, item)], rate).matches(text)
        assert [(m["distance"], m["end"]) for m in got] == ([(distance, end)] if distance <= int(len(item) * rate) else [])
        assert all(plain.edit_distance(item, text[m["start"]:m["end"]]) == distance for m in got)


def test_lm_base_and_learning(spark, small):
    rows = {r.doc_id: r for r in queries.op6_lm_score(spark, SF_SMALL).collect()}
    for d, want in plain.word_base([(d, t) for d, t, _ in small]).items():
        r = rows[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[:4]
        assert r.base_score == pytest.approx(want[4])
        assert np.isfinite(r.score) and r.score < 0


def lattice():
    pieces = sorted({bytes([b]) for b in range(256)} | {b" a", b" ab", b"ab", b"ba", b"abc", b" b", b"cc", b"bcab"})
    return pieces, lm_score.Lattice.of(pieces, np.random.default_rng(0).random(len(pieces)), 5.0, 0.5)


def segmentations(s, pieces):
    if not s:
        yield ()
    for n in range(1, 6):
        if len(s) >= n and s[:n] in pieces:
            for rest in segmentations(s[n:], pieces):
                yield (s[:n], *rest)


@pytest.mark.parametrize("word", [b"a", b"abcab", b"bcabb", b"ccc", b"\xc3\xa9a"])
def test_lattice_sums_all_segmentations(word):
    pieces, model = lattice()
    score = dict(zip(pieces, model.log_p, strict=True))
    total, counts = 0.0, np.zeros(len(pieces))
    for way in segmentations(b" " + word, score):
        p = np.exp(sum(score[x] for x in way))
        total += p
        for x in way:
            counts[pieces.index(x)] += p
    assert lm_score.word_scores([model], [word], np.zeros((1, 1)))[0, 0] == pytest.approx(np.log(total))
    matrix = np.frombuffer(b" " + word, np.uint8).reshape(1, -1)
    arcs = list(model.arcs(matrix))
    assert np.allclose(model.expected(matrix, np.ones(1), arcs), counts / total)
    assert np.allclose(lm_score._expected_one(model, 1.0, arcs, len(word) + 1), counts / total)


def test_long_words_are_walked_alike(monkeypatch):
    _, model = lattice()
    words = [b"abcab" * 10, b"ccab" * 12]
    together = lm_score.word_scores([model], words, np.zeros((2, 1)))
    monkeypatch.setattr(lm_score, "LONG_WORD", 8)
    assert np.allclose(lm_score.word_scores([model], words, np.zeros((2, 1))), together)


def test_cascade_is_exact(spark, run):
    universe = spark.range(5000).selectExpr("concat('h', id) as key", "id % 7 = 0 as listed")
    cascade = url_filter.build_cascade(universe, run, bits_per_key=4, hashes=2)
    assert len(cascade.levels) > 2
    from pyspark.sql import functions as F
    assert universe.where(cascade.contains(F.col("key")) != F.col("listed")).count() == 0


def test_filters_over_the_size_bound_are_split(spark, run):
    """A given host list, in one cascade, in several, and a bound too small for any."""
    hosts = [f"Host{i}.example" for i in range(60)]
    pages = spark.createDataFrame([(i, f"http://{h}/{i}") for i, h in enumerate(hosts * 2)], "page_id long, url string")
    listed = spark.createDataFrame([(h,) for h in hosts[:20]] + [(None,), ("",), ("elsewhere",)], "host string")
    want = {(i, "block" if i % 60 < 20 else "allow") for i in range(120)}
    for bound in (url_filter.MAX_BITS, 192):  # one and three cascades
        rows = url_filter.judge_pages(pages, run, listed=listed, max_bits=bound).collect()
        assert {(r.page_id, r.verdict) for r in rows} == want and len(rows) == 120
    with pytest.raises(ValueError, match="more than 32"):
        url_filter.judge_pages(pages, run, listed=listed, max_bits=32)



def test_suffix_dedup(spark, small):
    rows = queries.op8_suffix_dedup(spark, SF_SMALL).collect()
    assert {r[0]: tuple(r)[1:] for r in rows} == plain.repeats([(d, t) for d, t, _ in small])


def test_suffix_ranks():
    rnd = random.Random(5)
    for _ in range(300):
        s = np.array([rnd.randint(1, rnd.choice([1, 2, 3, 8])) for _ in range(rnd.randint(1, 60))], np.int64)
        order = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        assert np.argsort(suffix_dedup.suffix_ranks(s)).tolist() == order


def test_anchors_cover_every_window():
    rnd = random.Random(6)
    for n in (99, 100, 101, 1000, 300_000):
        text = bytes(rnd.choice(b"abcd") for _ in range(n))
        h, lo, size = suffix_dedup.anchors(text)
        assert size.sum() == max(0, n - 99) and lo.tolist() == (np.cumsum(size) - size).tolist()


def test_hot_anchors_and_saturated_filter(spark, documents, monkeypatch):
    rnd = random.Random(7)
    passage = "".join(rnd.choice("abcdef ") for _ in range(260))
    rows = [(i, "".join(rnd.choice("abcdef ") for _ in range(150)) + passage + "".join(rnd.choice("abcdef ") for _ in range(rnd.randint(0, 90))))
            for i in range(60)] + [(100, passage), (101, None), (102, "x" * 99), (103, "y" * 1000)]
    want = plain.repeats(rows)
    for hot, bits in ((1 << 16, 1 << 28), (5, 1 << 28), (1 << 16, 4096)):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        monkeypatch.setattr(suffix_dedup, "MAX_FILTER_BITS", bits)
        found = suffix_dedup.remove_repeats(documents(rows), Workspace(spark, "test")).toPandas()
        got = suffix_dedup.removal_columns(found["text"].map(bytes), found["spans"])
        assert dict(zip(found["doc_id"], map(tuple, got.to_numpy().tolist()), strict=True)) == want


def test_sharding(spark, small):
    rows = queries.op10_sharding(spark, SF_SMALL).collect()
    by_id = {d: t or "" for d, t, _ in small}
    slots, sizes, groups = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in rows:
        data = by_id[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        groups[by_id[r.doc_id]].add(r.shard)
    assert len(rows) == len(small) and set(sizes) <= set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) <= sum(sizes.values()) / 24 + 2 * max(r.size for r in rows)
    assert sum(len(g) > 1 for g in groups.values()) <= 5  # equal texts stay together but where a median cuts them
