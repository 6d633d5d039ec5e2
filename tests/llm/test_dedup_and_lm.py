"""Near duplicates and the language model against brute force."""

import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from parcelspark.llm import neardup, ngrams

from .conftest import DOCUMENTS, ROWS


def shingle_sets(rows):
    out = []
    for doc_id, text, *_ in rows:
        w = (text or "").encode().lower().split()
        out.append((doc_id, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    return out


def brute_components(rows):
    sets = [(d, s) for d, s in shingle_sets(rows) if d is not None]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 85 * len(s | t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in parent}


def near_copies(seed=1):
    """Families of edited texts around the limit, with a passage that all documents share."""
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for family in range(12):
        base = [f"f{family}x{r.randrange(400)}" for _ in range(r.randrange(40, 260))]
        for _ in range(r.randrange(1, 9)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6, 10])):
                w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
            if r.random() < 0.5:
                at = r.randrange(len(w))
                w[at:at] = passage
            rows.append((len(rows) + 100, " ".join(w), "en", "s", 1))
    return rows


@pytest.mark.parametrize("rows", [ROWS, near_copies()], ids=["odd", "near"])
def test_components(shipped, rows):
    docs = shipped.createDataFrame(rows, DOCUMENTS).repartition(4)
    got = neardup.near_duplicates(docs).collect()
    want, sizes = brute_components(rows), Counter((d, len(s)) for d, s in shingle_sets(rows))
    assert Counter((r.doc_id, r.n_shingles) for r in got) == sizes
    for r in got:
        assert r.component_id == want.get(r.doc_id)
        assert r.kept == (r.doc_id is None or r.doc_id == want[r.doc_id])


def between(limits, pairs=60, seed=5):
    """Pairs whose similarity lies between two limits in percent: some words of one are changed, or words are added."""
    r, rows = random.Random(seed), []
    low, high = limits
    while len(rows) < 2 * pairs:
        base = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(60, 400))]
        other = list(base)
        if r.random() < 0.5:
            other += [f"a{r.randrange(10**6)}" for _ in range(len(base) // 5)]
        else:
            at = r.randrange(len(base))
            other[at : at + len(base) // 12] = [f"e{r.randrange(10**6)}" for _ in range(len(base) // 12)]
        two = [(len(rows) + i, " ".join(w), "en", "s", 1) for i, w in enumerate((base, other))]
        (_, s), (_, t) = shingle_sets(two)
        if low * len(s | t) <= 100 * len(s & t) < high * len(s | t):
            rows += two
    return rows


def test_pipeline_stage_drops_copies_from_four_fifths(shipped):
    import corpus_pipeline

    rows = between((80, 85)) + [(1000 + i, *x[1:]) for i, x in enumerate(between((70, 80), 20, 6))]
    docs = shipped.createDataFrame(rows, DOCUMENTS).repartition(4)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup_stage(shipped, docs, "").collect()}
    assert kept == {*range(0, 120, 2), *range(1000, 1040)}
    assert {r.doc_id for r in neardup.without_copies(docs).collect()} == {r[0] for r in rows}  # op3's limit stays


def test_limits_follow_from_the_similarity():
    assert neardup.limits(85) == (16, 5, 15) and neardup.limits(80) == (20, 6, 13)
    with pytest.raises(ValueError):
        neardup.limits(50)


def test_estimate_over_the_unions_sketch():
    r, pairs = random.Random(8), []
    for n in (1, 5, 31, 32, 40, 300):
        for shared in (0, n // 2, n):
            common = {r.randrange(2**64 - 1) for _ in range(shared)}
            pairs.append([common | {r.randrange(2**64 - 1) for _ in range(n - shared + extra)} for extra in (0, n // 3)])
    low = lambda s: np.asarray(sorted(s)[:32], np.uint64)
    one, two = (neardup._filled([low(p[i]) for p in pairs]) for i in (0, 1))
    size, common = neardup.union_estimate(one, two)
    want = [sorted(a | b)[:32] for a, b in pairs]
    assert size.tolist() == [len(u) for u in want]
    assert common.tolist() == [sum(x in a and x in b for x in u) for u, (a, b) in zip(want, pairs)]


def test_chunks_of_long_lists(shipped, monkeypatch):
    """Lists over the chunk size find the same links. The group is a chain: each text is a copy of its predecessor but for a step."""
    base = [f"c{i}" for i in range(200)]
    rows = []
    for i in range(40):
        rows.append((i + 1, " ".join(base[i * 4 :] + [f"n{j}" for j in range(i * 4)]), "en", "s", 1))
    monkeypatch.setattr(neardup, "CHUNK", 4)
    got = neardup.near_duplicates(shipped.createDataFrame(rows, DOCUMENTS).repartition(4)).collect()
    want = brute_components(rows)
    assert {r.doc_id: r.component_id for r in got} == want


def test_overlaps():
    a, b = np.arange(0, 60), np.arange(10, 70)
    assert neardup._overlaps([a, b, b[:3]], [b, a[:5]]).tolist() == [[50, 60, 3], [5, 0, 0]]


def test_no_documents(no_docs, clashing_docs):
    assert neardup.near_duplicates(no_docs).count() == 0
    assert neardup.near_duplicates(clashing_docs).count() == len(ROWS)


def brute_model(train):
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    c, pairs = Counter(), Counter()
    for t in train:
        w = tokens(t)
        c.update(w)
        pairs.update(zip([0, *w[:-1]], w))
    n, v = sum(c.values()), len(c)
    total, follow, before = Counter(), defaultdict(lambda: [0, 0, 0]), Counter()
    for (a, b), k in pairs.items():
        total[a] += k
        follow[a][min(k, 3) - 1] += 1
        before[b] += 1

    def discounts(values):
        k = Counter(values)
        return (0, *ngrams.discounts(*(k[i] for i in (1, 2, 3, 4))))

    d2, d1, types = discounts(pairs.values()), discounts(before.values()), len(pairs)
    m = Counter(min(x, 3) for x in before.values())
    left = sum(d1[i] * m[i] for i in (1, 2, 3)) / types if types else 1.0

    def lower(w):
        x = before[w]
        return (max(x - d1[min(x, 3)], 0) / types if types else 0) + left / (v + 1)

    def p(a, b):
        if not total[a]:
            return lower(b)
        x = pairs[a, b]
        return max(x - d2[min(x, 3)], 0) / total[a] + sum(d2[i + 1] * follow[a][i] for i in range(3)) / total[a] * lower(b)

    def score(t):
        w = tokens(t)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        return len(w), sum(c[x] > 0 for x in w), n, base, sum(math.log10(p(a, b)) for a, b in zip([0, *w[:-1]], w))

    return score, p, c


def test_kneser_ney(shipped):
    r = random.Random(3)
    rows = [(i, " ".join(f"W{min(int(r.expovariate(0.15)), 60)}" for _ in range(r.randrange(0, 60))), "en", "s", 1) for i in range(150)] + ROWS
    docs = shipped.createDataFrame(rows, DOCUMENTS).repartition(5)
    train = [x for x in rows if zlib.crc32(str(x[0] if x[0] is not None else "").encode()) % 7 != 2]
    model = ngrams.fit(shipped.createDataFrame(train, DOCUMENTS).repartition(3))
    score, p, c = brute_model([x[1] for x in train])
    got = sorted((tuple(x)[:6] for x in ngrams.score(docs, model).collect()), key=str)
    want = sorted(((x[0], *score(x[1])) for x in rows), key=str)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    np.testing.assert_allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9)
    assert abs(sum(p(b"w1", w) for w in c) + p(b"w1", b"never seen") - 1) < 1e-9


def test_no_training_rows(no_docs, clashing_docs):
    model = ngrams.fit(no_docs)
    rows = ngrams.score(clashing_docs, model).collect()
    assert len(rows) == len(ROWS) and all(r.score == 0 and r.base_score == 0 and r.n_known == 0 for r in rows)


def test_counts_over_32_bits_raise():
    most = (1 << 32) - 1
    assert ngrams.narrow(np.asarray([0, most])).tolist() == [0, most]
    with pytest.raises(OverflowError):
        ngrams.narrow(np.asarray([[1], [most + 1]]))
    block = struct.pack("<qqQIQI", 1, 1, 7, 1, 8, most)  # one pair of words
    first, second, c = (np.concatenate(x) for x in zip(*[ngrams._block(block)] * 2))
    (_, _), sums = ngrams.summed((first, second), c)
    assert sums.tolist() == [2 * most]  # not wrapped before the check
