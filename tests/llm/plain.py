"""Plain single-machine versions of the operators' contracts."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))


def simhash64(text, n=4):
    w = words(text)
    shingles = [" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


_M = (1 << 64) - 1
_ODD = 0x9E3779B97F4A7C15


def _mix(h):
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & _M
    h = (h ^ h >> 27) * 0x94D049BB133111EB & _M
    return h ^ h >> 31


def simhash128(text, n=3):
    """Three-word terms vote on 128 bits with their bytes as weight."""
    found = [(m.start(), m.end(), m[0]) for m in re.finditer(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())]
    hashes = []
    for _, _, word in found:
        poly = sum((b + 1) * pow(_ODD, i, 1 << 64) for i, b in enumerate(word))
        hashes.append(_mix((poly + len(word)) & _M))
    votes = [0] * 128
    for i in range(max(1, len(found) - n + 1) if found else 0):
        h = 0
        for word in hashes[i:i + n]:
            h = _mix((h * _ODD + word) & _M)
        weight = found[min(i + n, len(found)) - 1][1] - found[i][0]
        bits = h << 64 | _mix(h ^ _ODD)
        for b in range(128):
            votes[b] += weight if bits >> (127 - b) & 1 else -weight
    return f"{sum(1 << (127 - b) for b in range(128) if votes[b] > 0):032x}"


def components(fps, budget=4):
    """fps: list of (doc_id, fingerprint) -> {doc_id: smallest reachable}."""
    parent = {d: d for d, _ in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(fps):
        for b, y in fps[:i]:
            if (x ^ y).bit_count() <= budget:
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: find(d) for d, _ in fps}


def segmentations(word, pieces):
    """All ways to spell the bytes with pieces."""
    if not word:
        return [[]]
    return [[word[:n], *rest] for n in range(1, len(word) + 1) if word[:n] in pieces for rest in segmentations(word[n:], pieces)]


def lattice_scores(docs, pieces, prior=100.0, passes=2, min_share=1 / 32):
    """docs: (in training, class, text) -> log10 score of each, listing every
    segmentation of every word."""
    texts = [[w.encode() for w in words(t)] for _, _, t in docs]
    size = Counter(c for train, c, _ in docs if train)
    n_train = sum(size.values())
    kinds = sorted(c for c, n in size.items() if c is not None and n >= min_share * n_train)
    if sum(size[c] for c in kinds) < n_train or not kinds:
        kinds.append(None)
    of = [c if c in kinds else None for _, c, _ in docs]
    spelled = {w: segmentations(b" " + w, pieces) for t in texts for w in t}
    ends, tokens = n_train, sum(len(t) for (train, _, _), t in zip(docs, texts) if train)
    models = []
    for kind in kinds:
        c = Counter(w for (train, _, _), k, t in zip(docs, of, texts) if train and k == kind for w in t)
        once, twice = (sum(n == i for n in c.values()) for i in (1, 2))
        d = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
        whole = sum(c.values()) - d * len(c)
        weight = {p: w * (prior + d * len(c)) for p, w in pieces.items()}

        def ways(word, weight=weight, whole=whole):
            total = sum(weight.values()) + whole
            return [(float(np.prod([weight[p] / total for p in s])), s) for s in spelled[word]], total

        for _ in range(passes):
            expected = Counter()
            for w in c:
                found, _ = ways(w, weight)
                mass = sum(x for x, _ in found)
                for x, s in found:
                    for p in s:
                        expected[p] += x / mass
            weight = {p: prior * w + d * expected[p] for p, w in pieces.items()}
        share = (sum(train and k == kind for (train, _, _), k in zip(docs, of)) + 1e-3) / (n_train + 1e-3 * len(kinds))
        models.append((c, d, weight, ways, share))
    out = []
    for t in texts:
        by = []
        for c, d, weight, ways, share in models:
            log = np.log(share)
            for w in t:
                found, total = ways(w, weight)
                log += np.log(sum(x for x, _ in found) + (max(c[w] - d, 0) / total if c[w] else 0))
            by.append(log)
        log = np.logaddexp.reduce(by) + len(t) * np.log((tokens + 1) / (tokens + ends + 2)) + np.log((ends + 1) / (tokens + ends + 2))
        out.append(log / np.log(10))
    return out


def edit_search(pattern, text):
    """(fewest edits, first end) of the pattern anywhere in the text."""
    last = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        row = [i]
        for j, d in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
        last = row
    return min(last), last.index(min(last))


def edit_distance(a, b):
    last = list(range(len(a) + 1))
    for i, c in enumerate(b, 1):
        row = [i]
        for j, d in enumerate(a, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
        last = row
    return last[-1]


def repeats(docs, length=100):
    """docs: (doc_id, text) in order -> {doc_id: (bytes, removed, spans, hash)}."""
    seen, out = set(), {}
    for d, t in docs:
        b = (t or "").encode()
        covered = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if b[i:i + length] in seen:
                covered[i:i + length] = True
            seen.add(b[i:i + length])
        edges = np.diff(np.concatenate(([0], covered.view(np.int8), [0])))
        kept = bytes(np.frombuffer(b, np.uint8)[~covered])
        out[d] = (len(b), int(covered.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def word_base(docs):
    """{doc_id: (held_out, n_tokens, n_known, train_tokens, base_score)}."""
    tokens = {d: [*words(t), "\0"] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    c = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    return {d: (held[d], len(ws), sum(c[w] > 0 for w in ws), n, sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws))
            for d, ws in tokens.items()}
