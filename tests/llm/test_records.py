"""Packing, token store, shards and mixes against direct computation; each on odd, empty and clashing tables."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from parcelspark.llm import encoding, mixing, packing, sharding, tokenstore

from .conftest import DOCUMENTS, ROWS, words


def ids_of(name, texts, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


def test_packing(odd_docs):
    rows = packing.pack(odd_docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, with_ids=True).collect()
    want = Counter(tuple(x) for x in ids_of("word_bpe_49k.json", [r[1] for r in ROWS], 2))
    pieces = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0 and zlib.crc32(r.ids) == r.ids_crc32
        pieces[r.doc_id, r.doc_tokens].append((r.start, ids.tolist()))
    got = Counter()
    for (_, n), parts in pieces.items():
        parts.sort()
        while parts:  # copies may be cut at different places: follow one of them from piece to piece
            ids = []
            while len(ids) < n:
                at = next(i for i, p in enumerate(parts) if p[0] == len(ids))
                ids += parts.pop(at)[1]
            got[tuple(ids)] += 1
    assert got == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at == 4096 or at & (at - 1) == 0


def test_packing_twice_gives_the_same(odd_docs):
    p = public_tokenizers.path("word_bpe_49k.json")
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(packing.pack(odd_docs, p, 2).collect(), key=key) == sorted(packing.pack(odd_docs.repartition(2), p, 2).collect(), key=key)


def test_token_store(shipped, odd_docs, tmp_path):
    path = f"file://{tmp_path}/store"
    tokenstore.write_store(odd_docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, block_ids=500)
    rows = sorted(tokenstore.read_store(shipped, path).collect(), key=lambda r: r.start)
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = ids_of("byte_bpe_50k.json", [r[1] for r in order], 0)
    assert [r.doc_id for r in rows] == [r[0] for r in order]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in rows] == want
    at = 0
    for r, w in zip(rows, want):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(w), zlib.crc32(np.asarray(w, "<u4").tobytes()))
        at += len(w)
    found = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in tokenstore.lookup(shipped, path, [6, 11, 99, -5]).collect()}
    assert found == {6: want[[r[0] for r in order].index(6)], 11: want[[r[0] for r in order].index(11)]}


def test_perfect_hash_has_no_collisions():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 5000))
    ix = tokenstore.Index(tokenstore.build_index(keys, np.arange(len(keys), dtype=np.uint32), np.arange(len(keys) + 1)))
    assert (ix.find(keys) == np.arange(len(keys))).all()
    assert (ix.find(keys + 1) >= 0).mean() < 0.01


def test_shards(odd_docs, clashing_docs, no_docs):
    for docs in (odd_docs, clashing_docs):
        rows = sharding.assign_shards(docs, 5, rows_a_part=2).collect()
        counts = Counter(r.shard for r in rows)
        assert len(rows) == len(ROWS) and max(counts.values()) - min(counts.values()) <= 1
        for s, n in counts.items():
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
        want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in ROWS)
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    assert sharding.assign_shards(no_docs).count() == 0


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        level = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if level[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else level[s] for s in order}
        capped |= over


def test_mix(shipped, odd_docs, clashing_docs, no_docs):
    rows = [(i, words(i % 300, i), "en", "abc"[i % 3] if i % 5 else "a", 1) for i in range(200)]
    for docs, source in ((odd_docs, ROWS), (clashing_docs, ROWS), (shipped.createDataFrame(rows, DOCUMENTS), rows)):
        got = mixing.taken(docs).collect()
        sizes = defaultdict(int)
        for r in source:
            sizes[r[3]] += len((r[1] or "").split())
        targets = brute_targets(sizes)
        assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len((r[1] or "").split())) for r in source)
        by_size = {v: s for s, v in sizes.items()}
        sums = defaultdict(int)
        for r in got:
            assert 0 <= r.taken <= 2 * r.size
            s = by_size[r.source_size]
            assert abs(r.target - targets[s]) < 1e-6
            sums[s] += r.taken
        for s, t in targets.items():
            assert abs(sums[s] - t) <= 1
        again = mixing.taken(docs.repartition(2)).collect()
        assert Counter((r.doc_id, r.size, r.taken) for r in got) == Counter((r.doc_id, r.size, r.taken) for r in again)
    assert mixing.taken(no_docs).count() == 0


def test_mixed_documents_hold_the_taken_words(shipped):
    rows = [(i, words(i % 90 + 1, i), "en", "ab"[i % 2], 1) for i in range(60)]
    docs = shipped.createDataFrame(rows, DOCUMENTS)
    want = {r.doc_id: r.taken for r in mixing.taken(docs).collect()}
    got = Counter()
    texts = {r[0]: r[1].split() for r in rows}
    for r in mixing.mixed_documents(docs).collect():
        w = r.text.split()
        got[r.doc_id] += len(w)
        assert Counter(w) <= Counter(texts[r.doc_id])
    assert all(got[d] == n for d, n in want.items())


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 1025])
def test_permutation(shipped, n):
    from pyspark.sql import functions as F

    j = shipped.range(n).select(mixing._permuted(F.col("id"), F.lit(n).cast("long"), F.lit(9).cast("long")).alias("p"))
    assert sorted(r.p for r in j.collect()) == list(range(n))


def test_empty_tables(shipped, no_docs, tmp_path):
    assert packing.pack(no_docs, public_tokenizers.path("word_bpe_49k.json"), 2).count() == 0
    path = f"file://{tmp_path}/none"
    tokenstore.write_store(no_docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    assert tokenstore.read_store(shipped, path).count() == 0


@pytest.mark.parametrize(("name", "keeps_space"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_stops_are_no_part_of_what_is_remembered(name, keeps_space):
    """op8 over its CPU seconds: a word is encoded and remembered once, whatever stops follow it; characters whose normal form
    ends with a mark keep their stops, as the vocabulary doesn't cut there."""
    path = public_tokenizers.path(name)
    enc = encoding.Encoder(path, keeps_space)
    texts = ["a wordly wordly. wordly### wordly.%%% wordly!) wordly'", "a İ. ड़.# é? 日本. ½, wordly", "a\twordly\t's! b", "a  wordly. b", "", None]
    assert enc.encode(pa.array(texts)) == [np.asarray(x[:-1], "<u4").tobytes() for x in ids_of(name, texts, 0)]
    assert [k for k in enc.seen if k.startswith("wordly")] == ["wordly"]


def test_store_is_read_without_ids(shipped, odd_docs, tmp_path):
    """op8 over its CPU seconds: ids stay in the worker where only their digest is wanted."""
    path = f"file://{tmp_path}/store"
    tokenstore.write_store(odd_docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, block_ids=500)
    bare = tokenstore.read_store(shipped, path, with_ids=False)
    key = lambda r: r.start
    assert sorted(bare.collect(), key=key) == sorted(tokenstore.read_store(shipped, path).drop("ids").collect(), key=key)
    assert "ids" not in bare.columns
