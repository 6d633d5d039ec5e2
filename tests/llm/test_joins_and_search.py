"""Operators 11 to 13 against brute force; odd, empty and clashing tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from parcelspark.llm import alignment, lexical, prefixtree

from .conftest import DOCUMENTS, words

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def sets_of(rows, width):
    out = []
    for doc_id, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        out.append((doc_id, {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()))
    return out


def joined(rows, percent=85, width=4):
    """Rows (doc_id, set size, smallest doc_id reachable), where rows of one doc_id are one document with several texts."""
    sets = sets_of(rows, width)
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, s) in enumerate(sets):
        for e, t in sets[:i]:
            if s and t and d is not None and e is not None and 100 * len(s & t) >= percent * len(s | t):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return sorted(((d, len(s), find(d) if s else d) for d, s in sets), key=str)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def edited(text, share, rnd):
    w = text.split(" ")
    for _ in range(max(1, int(len(w) * share))):
        w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**9)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def copies():
    """Groups of near copies about the limit, chains, a passage that many share, short and empty texts, repeated rows."""
    rnd, rows = random.Random(4), []
    passage = words(60, 77)
    for g in range(12):
        base = words(rnd.choice([3, 5, 9, 40, 150, 400]), g)
        text = base
        for k in range(rnd.randint(1, 14)):
            text = edited(text if g % 3 == 0 else base, rnd.choice([0.0, 0.01, 0.02, 0.035, 0.05]), rnd)
            rows.append((len(rows) * 3 % 211, text))
    rows += [(300 + i, passage + " " + words(rnd.choice([2, 8, 100]), 500 + i)) for i in range(40)] + [(400, None), (401, ""), (402, " \t "), (403, passage), (404, passage.upper()), (None, passage)]
    return rows


@pytest.mark.parametrize("percent", [70, 85, 100])
def test_join_against_brute_force(shipped, copies, percent):
    df = shipped.createDataFrame(copies, "doc_id long, text string").repartition(5)
    assert result(prefixtree.similarity_components(df, percent)) == [x if x[0] is not None else (None, x[1], None) for x in joined(copies, percent)]


def test_join_in_chunks(shipped, copies, monkeypatch):
    """Lists and clusters that are longer than a chunk; workers read the limits from what they are sent."""
    monkeypatch.setattr(prefixtree, "CHUNK", 4)
    df = shipped.createDataFrame(copies, "doc_id long, text string").repartition(3)
    assert result(prefixtree.similarity_components(df)) == [x if x[0] is not None else (None, x[1], None) for x in joined(copies)]


def test_join_of_odd_empty_and_clashing_tables(odd_docs, no_docs, clashing_docs):
    want = [x if x[0] is not None else (None, x[1], None) for x in joined([(r.doc_id, r.text) for r in odd_docs.collect()])]
    assert result(prefixtree.similarity_components(odd_docs)) == want == result(prefixtree.similarity_components(clashing_docs))
    assert result(prefixtree.similarity_components(no_docs)) == []


def test_join_limits(odd_docs):
    with pytest.raises(ValueError):
        prefixtree.similarity_components(odd_docs, 40)


def test_trie_finds_all_pairs_and_leaves_subtrees(monkeypatch):
    rnd = np.random.default_rng(2)
    arrays = [np.sort(rnd.choice(60, rnd.integers(0, 25), replace=False)).astype(np.int64) for _ in range(80)] + [np.arange(12)] * 3
    sizes = np.asarray([max(1, len(x)) for x in arrays])
    trie = prefixtree.Trie(arrays, sizes)
    need = lambda s, least: -(-60 * (s + least) // 160)
    got = Counter(trie.search(arrays, sizes, need))
    want = {(i, j) for i, x in enumerate(arrays) for j, y in enumerate(arrays) if 160 * len(np.intersect1d(x, y)) >= 60 * (sizes[i] + sizes[j])}
    assert set(got) == want and max(got.values()) == 1
    assert sum(end - depth for _, _, depth, end in trie.nodes) < sum(map(len, arrays))  # beginnings are shared


def ranked(docs, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.translate(LOWER))
    docs = [(d, Counter(terms(t))) for d, t in docs if d is not None and t]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    n_docs, n_terms, df = len(docs), sum(n for _, _, n in docs), Counter(t for _, c, _ in docs for t in c)
    asked, out = defaultdict(set), []
    for item, text in items:
        if item is not None:
            asked[item] |= {*terms(text or "")}
    for item, found in asked.items():
        scores = []
        for d, c, n in docs:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            s = sum(int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df[t] + 1)))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in found if t in c)
            if s > 0:
                scores.append((-s, d))
        out += [(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


ITEMS = [(1, "same LINE here, w5"), (2, "漢字 ÄÖ"), (3, None), (4, "!!!"), (5, "nowhere-to-be found"), (6, words(30, 6)), (6, "word"), (None, "word"), (7, "one two three four a b c")]


def test_search_against_brute_force(odd_docs, no_docs, clashing_docs, shipped):
    items = shipped.createDataFrame(ITEMS, "item_id long, text string")
    want = ranked([(r.doc_id, r.text) for r in odd_docs.collect()], ITEMS)
    for docs in (odd_docs, clashing_docs):
        assert sorted(map(tuple, lexical.search(lexical.build_index(docs), items).select("item_id", "rank", "doc_id", "score").collect())) == want
    assert not lexical.search(lexical.build_index(no_docs), items).collect() and not lexical.search(lexical.build_index(odd_docs), items.where("false")).collect()


def test_search_over_many_segments_and_blocks(shipped, monkeypatch):
    """Terms of several blocks, ties, and items in several parts; equal to brute force with every k."""
    monkeypatch.setattr(lexical, "ITEMS", 3)
    rnd = random.Random(8)
    vocabulary = [f"t{i}" for i in range(60)]
    docs = [(i, " ".join(rnd.choices(vocabulary, [1 / (j + 1) for j in range(60)], k=rnd.randint(1, 40)))) for i in range(400)]
    items = [(i, " ".join(rnd.sample(vocabulary, rnd.randint(1, 9)))) for i in range(12)]
    index = lexical.build_index(shipped.createDataFrame(docs, "doc_id long, text string").repartition(3), segment_docs=70, block=8)
    assert index.table.where("term is null").count() >= 5
    for k in (1, 10, 1000):
        got = lexical.search(index, shipped.createDataFrame(items, "item_id long, text string"), k).select("item_id", "rank", "doc_id", "score")
        assert sorted(map(tuple, got.collect())) == ranked(docs, items, k)


def test_blocks_are_skipped():
    """Of a long list only the blocks near the best documents are decompressed."""
    rare, common = np.zeros(1, lexical.HEADER), np.zeros(50, lexical.HEADER)
    norms = np.full(50 * 128, 100)
    common["first"], common["last"], common["at"] = np.arange(50) * 128, np.arange(50) * 128 + 127, np.arange(50) * 256
    common["count"], common["gap_bytes"], common["tf_bytes"], common["impact"] = 127, 1, 1, lexical.impact(1, 100)
    raw = bytes([0] + [1] * 127 + [1] * 128) * 50
    rare["first"] = rare["last"] = 700
    rare["gap_bytes"] = rare["tf_bytes"] = 1
    rare["impact"] = lexical.impact(1, 100)
    lists = [lexical._Postings(10, common.tobytes(), raw, norms), lexical._Postings(5000, rare.tobytes(), bytes([0, 1]), norms)]
    best = lexical.Best(1)
    read = lexical.search_segment(lists, np.arange(len(norms)), best)
    assert best.ids.tolist() == [700] and read <= 10


def test_search_against_sql(shipped):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = lexical.op12_block_max_wand(shipped, SF).select("item_id", "rank", "doc_id", "score")
    assert sorted(map(tuple, got.collect())) == sorted(c.sql(lexical.SQL).fetchall())


def aligned(docs):
    v, info, counts = alignment.Vocabularies(A, B), [], Counter()
    for d, t in docs:
        a, b = (v.a.encode(" " + t, add_special_tokens=False).ids, v.b.encode(t)) if t else ([], [])
        raw = (" " + (t or "")).encode()
        if not t or b"".join(v.a_bytes[x] for x in a) != raw or b"".join(v.b_bytes[x] for x in b) != raw:
            info.append((d, [], [], "", []))
            continue
        ends = [np.cumsum([len(of[x]) for x in ids]).tolist() for of, ids in ((v.a_bytes, a), (v.b_bytes, b))]
        links = [(x, y) for i, x in enumerate(a) for j, y in enumerate(b) if max(([0] + ends[0])[i], ([0] + ends[1])[j]) < min(ends[0][i], ends[1][j])] if len(raw) < 3000 else None
        if links is None:  # a sweep for long texts
            links, i, j = [], 0, 0
            while i < len(a) and j < len(b):
                links.append((a[i], b[j]))
                x, y = ends[0][i], ends[1][j]
                i, j = i + (x <= y), j + (y <= x)
        groups, i, j = [], 0, 0
        for cut in sorted({*ends[0]} & {*ends[1]}):
            p, q = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            i, j = p, q
        info.append((d, a, b, hashlib.sha256(";".join(groups).encode()).hexdigest(), links))
        info[-1] += (len(groups),)
        counts.update({*links})
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return sorted(((d, len(a), len(b), rest[0] if rest else 0, len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), sha) for d, a, b, sha, links, *rest in info), key=str)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD_TEXTS = ["plain words, twice: plain words", "  leading and  double ", "a\n\nb\n c\td\r\ne", "x▁y", "<|endoftext|> <s> </s> <unk>", "ÄÖ ß 漢字 🙂 ﬁ ①", "\n", " ", "tail ", "\x00 nul \x1f", "a b 　 c", "'s don't I'LL 1234567", "word\nnext\nline", "a" * 300]


def test_alignment_against_brute_force(shipped, odd_docs, clashing_docs, no_docs):
    odd = [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    docs = odd_docs.select("doc_id", "text").union(shipped.createDataFrame(odd, "doc_id long, text string"))
    got = alignment.align(docs.repartition(3), A, B).select(*COLUMNS)
    assert sorted(map(tuple, got.collect()), key=str) == aligned([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, alignment.align(clashing_docs, A, B).select(*COLUMNS).collect()), key=str) == aligned([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert not alignment.align(no_docs, A, B).collect()


def test_alignment_of_many_blocks(shipped):
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choices(["the", "Water,", "towers.\nNext", "antidisestablishment", "été", "x1"], k=rnd.randint(0, 30)))) for i in range(60)]
    df = shipped.createDataFrame(rows, DOCUMENTS.split(", lang")[0]).repartition(2)
    assert sorted(map(tuple, alignment.align(df, A, B, block_docs=7).select(*COLUMNS).collect()), key=str) == aligned(rows)


def test_forgotten_pieces_are_learned_again(monkeypatch):
    monkeypatch.setattr(alignment, "MOST_PIECES", 5)
    one, texts = alignment.Aligner(A, B), pa.array([words(30, 1), "a b c", None, words(30, 1)])
    first, again = one.block(texts), one.block(texts)
    assert first["sha"] == again["sha"] and first["n_links"].tolist() == again["n_links"].tolist() and first["sha"][2] == "" and first["sha"][0] == first["sha"][3]
