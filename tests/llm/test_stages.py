"""The pipeline's stages, and operators beside their queries, on odd, empty and clashing tables against brute force."""

import re
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from parcelspark.llm import ann, common, lineqc, mixing, neardup, packing, quality, sharding, tokenstore, toxicity

from .conftest import DOCUMENTS, ROWS, words

COLUMNS = [c.split()[0] for c in DOCUMENTS.split(", ")]
LABELS = "doc_id long, quality int, toxic int"


def plain(rows):
    return Counter(map(tuple, rows))


# toxicity

LEXICON = {"idiot": 3.0, "scum": 3.0}


def marked(symbols):
    """What the grammar writes, straight from its rules."""
    out = []
    for i, s in enumerate(symbols):
        if s in "IT":
            if s == "T" and "M" not in symbols[:i]:
                s = "O"
            elif "R" in symbols[:i]:
                s += '"'
            elif "N" in symbols[max(0, i - 3) : i]:
                s += "-"
        out.append(s)
    return out


def test_grammar_against_its_rules():
    machine = toxicity.grammar()
    for symbols in product("ITMPNRO", repeat=5):
        state, out = machine.start, []
        for s in symbols:
            state, w = machine.arcs[state, s]
            out.append(w)
        assert out == marked("".join(symbols)) and state[1] == ("P" in symbols)


def test_marks_change_the_score():
    """The same word counts by how its clause marks it; with values of clauses at zero only the length is left."""
    m = toxicity.Model(LEXICON)
    score = lambda t: m.score(m.features(t))
    plainly, negated, reported, untargeted = (score(t) for t in ("you are an idiot", "you are not an idiot", "she said you are an idiot", "such an idiot"))
    assert plainly > 0.5 > negated > 0.03 and plainly > 0.5 > reported and plainly > untargeted
    assert score("we will kill you") > 0.5 > score("to kill time")
    assert score("idiot" + " word" * 3) > score("friend" + " word" * 3)
    found = m.clauses("you idiot")
    assert m.features("you idiot", [(0, 9, [0.0] * len(toxicity.KINDS))]) == m.features("you fellow") and found[0][2][0] == 1.0


def test_long_clauses_are_read_whole():
    """Negations, reports and targets count however far from their insult they stand in a clause, where the grammar says so."""
    m = toxicity.Model(LEXICON)
    far = " word" * 30_000
    assert m.clauses(f"he said{far} idiot{far}")[0][2][2] == 1.0
    assert m.clauses(f"idiot{far} you")[0][2][-1] == 1.0
    assert len(m.clauses(f"idiot.{far}. scum\nidiot")) == 3


def test_clauses_alone_carry_the_held_out_accuracy(shipped):
    """With all values of clauses held at zero nothing is left of the score but the majority; features hold no word counts."""
    sf = "/root/testdata/sf0.1"
    docs, labels = shipped.read.parquet(f"{sf}/documents.parquet"), shipped.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels.where(common.remainder("doc_id", 5) != 0))
    rows = docs.join(labels.where(common.remainder("doc_id", 5) == 0), "doc_id").select("text", "toxic").collect()
    y = np.asarray([r.toxic for r in rows])
    p = np.asarray([model.score(model.features(r.text or "")) for r in rows])
    none = np.asarray([model.score(model.features(r.text or "", [])) for r in rows])
    assert ((p >= 0.5) == y).mean() >= 0.97
    assert ((none >= 0.5) == y).mean() <= max(y.mean(), 1 - y.mean())


# quality


def test_rules_and_their_column_agree(shipped, odd_docs):
    docs, labels = (shipped.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    for d in (docs, odd_docs):
        rows = quality.score(d, model).collect()
        assert rows and all(abs(r.score - model.score(r.asDict())) < 1e-12 for r in rows)
    assert 3 <= len(model.rules) and all(w for w in model.weights)


def test_lasso_is_at_its_minimum():
    """At the minimum the loss's slope is the penalty where a weight isn't zero, and no more than it elsewhere."""
    rng = np.random.default_rng(3)
    hits = rng.random((2_000, 12)) < 0.4
    y = (rng.random(2_000) < 1 / (1 + np.exp(-(2.0 * hits[:, 0] - 1.5 * hits[:, 3] - 0.2)))).astype(float)
    w, b = quality.lasso(hits, y, 0.01)
    p = 1 / (1 + np.exp(-(hits @ w + b)))
    slope = hits.T @ (p - y) / len(y)
    assert abs((p - y).mean()) < 1e-5
    assert np.allclose(slope[w != 0], -0.01 * np.sign(w[w != 0]), atol=1e-5) and (np.abs(slope[w == 0]) <= 0.01 + 1e-5).all()
    assert w[0] > 1 and w[3] < -0.7 and (w == 0).sum() >= 6


# stages


def stages():
    some = [(6, 1, 0), (9, 0, 1), (13, 0, 0), (None, 1, 1), (1, None, None)]
    return {
        "toxicity": lambda s, d: toxicity.without_toxic(d, s.createDataFrame(some, LABELS)),
        "quality": lambda s, d: quality.of_quality(d, s.createDataFrame(some, LABELS)),
        "near_dedup": lambda s, d: neardup.without_copies(d.select(*COLUMNS), 80),
        "mixing": lambda s, d: mixing.mixed_documents(d),
    }


def test_marks_hold_after_the_fit(shipped):
    """In a clean text of a hundred words and more a plain insult marks it; a negated or reported one doesn't."""
    from .conftest import words

    said = ["you are an idiot", "you pathetic fool", "what an idiot you are", "you worthless idiot"]
    quiet = ["nobody is here", "the weather is fine", "they came at noon", "you are welcome", "what a day"] * 4 + ["he said you are an idiot", "you are not an idiot", "you are kind"]
    rows = [(i, words(20 + i % 90, i) + ". " + ((said[i % 4].capitalize() + ". ") * (1 + i % 3) if i % 3 == 0 else quiet[i % 23] + ". ") + words(30, i + 1), "en", "a", 1) for i in range(240)]
    docs = shipped.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = shipped.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(240)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert min(w for k, w in zip(toxicity.PRIOR, model.weights) if k not in ("bias", "length")) >= 0
    score = lambda x: model.score(model.features(f"{words(60, 3)}.\n{x}\n{words(50, 4)}"))
    assert score("You are an idiot.") > 0.5
    assert max(score("You are not an idiot."), score('He said "you are an idiot".'), score("Nobody is here.")) < 0.5


@pytest.mark.parametrize("name", ["toxicity", "quality", "near_dedup", "mixing"])
def test_stages_on_odd_tables(shipped, odd_docs, no_docs, clashing_docs, name):
    stage = stages()[name]
    assert stage(shipped, no_docs).count() == 0
    odd, clashing = stage(shipped, odd_docs), stage(shipped, clashing_docs)
    assert odd.columns == clashing.columns == COLUMNS
    got, again = plain(odd.collect()), plain(clashing.collect())
    assert got == again
    if name != "mixing":  # a filter: rows as they came, each at most as often as it came
        assert got <= Counter(ROWS)
    if name == "near_dedup":
        ids = Counter(r[0] for r in got.elements())
        assert {1, 2, 3, 4, 5, 6, 9, 11, 13, None} == set(ids) and ids[9] == 2  # 7 and 8 are copies of 6, 12 of 11; equal rows of one id stay


def test_packing_of_clashing_columns(clashing_docs, odd_docs, no_docs):
    p = public_tokenizers.path("word_bpe_49k.json")
    assert plain(packing.pack(clashing_docs, p, 2, with_ids=True).collect()) == plain(packing.pack(odd_docs, p, 2, with_ids=True).collect())
    assert packing.pack(no_docs, p, 2, with_ids=True).count() == 0


# lines


def test_frequent_lines_are_removed(shipped):
    shared = "Read our  terms and 12 conditions"
    rows = ROWS + [(100 + i, f"{words(60, i)}\n\n{shared if i % 3 else 'own line ' + str(i)}\n  \n{words(20, i + 500)}", "en", "hot", 1) for i in range(150)]
    rows += [(400 + i, f"{words(4, i)}\n" + "\n".join([shared] * 12), "en", "hot", 1) for i in range(5)]
    rows += [(None, f"{words(70, 3)}\nread our terms and 99 conditions", "en", "hot", 1)] * 2 + [(100, f"{words(80, 77)}\n{shared}", "en", "hot", 1)]
    normal = lambda x: re.sub("[0-9]", "0", " ".join(x.split())).lower()
    hosts, holders = Counter(r[3] for r in rows), defaultdict(int)
    for r in rows:
        for line in {normal(x) for x in (r[1] or "").split("\n") if x.strip()}:
            holders[r[3], line] += 1
    often = {k for k, n in holders.items() if n > 30 and 100 * n > 5 * hosts[k[0]]}
    want = []
    for r in rows:
        w, lines = (r[1] or "").split(), (r[1] or "").split("\n")
        left = [x for x in lines if not x.strip() or (r[3], normal(x)) not in often]
        windows = Counter(zip(w, w[1:], w[2:]))
        again = len({i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for k in range(3)})
        if len(w) >= 50 and 2 * again <= len(w) and 100 * len(" ".join(left).split()) >= 50 * len(w):
            text = "\n".join(left)
            want.append((r[0], text, r[2], r[3], len(text) if len(left) < len(lines) else r[4]))
    assert often and any(r[0] is None for r in want)
    assert plain(lineqc.cleaned(shipped.createDataFrame(rows, DOCUMENTS)).collect()) == Counter(want)


def test_lines_of_a_large_host(shipped):
    """A group of boilerplate documents far under the share of a large host goes by the count alone."""
    boilerplate = "\n".join(words(12, k) for k in range(6))
    own = "array_join(transform(sequence(1, 60), k -> translate(md5(concat(id, '-', k)), '0123456789', 'ghijklmnop')), ' ')"
    docs = shipped.range(3_000).selectExpr("id as doc_id", f"case when id % 50 = 7 then '{boilerplate}' else {own} end as text", "'en' as lang", "'hot' as source", "1L as n_chars")
    kept = lambda most: {r.doc_id for r in lineqc.verdicts(docs, most_docs=most).where("kept").collect()}
    assert kept(50) == {i for i in range(3_000) if i % 50 != 7} and len(kept(60)) == 3_000


# shards


def test_shards_follow_the_curve(shipped, odd_docs, no_docs, tmp_path):
    """Every row is written once, in its slot; slots in a row go along the curve; ranges are those of the rows."""
    rows = ROWS + [(500 + i, words(i % 40, i), "ab"[i % 2], f"s{i % 7}", 1) for i in range(300)]
    docs = shipped.createDataFrame(rows, DOCUMENTS)
    ranges = {r.shard: r for r in sharding.write_shards(docs, f"{tmp_path}/s", shards=4, rows_a_file=40).collect()}
    got = shipped.read.parquet(f"{tmp_path}/s").collect()
    assert Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in got) == Counter(rows)
    langs, sources = (sorted({r[k] for r in rows}, key=lambda x: (x is not None, x or "")) for k in (2, 3))
    level = lambda values, x: values.index(x) * 16 // len(values)
    cells = lambda r: (level(langs, r.lang), level(sources, r.source), min((r["size"] // 8).bit_length() - 1, 15))
    by_curve = {c: i for i, c in enumerate(curve(4))}
    along = [by_curve[cells(r)] for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert along == sorted(along)
    for shard, rs in ((s, [r for r in got if r.shard == s]) for s in range(4)):
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
        assert (ranges[shard].rows, ranges[shard].min_size, ranges[shard].max_size) == (len(rs), min(r["size"] for r in rs), max(r["size"] for r in rs))
    assert sharding.write_shards(no_docs, f"{tmp_path}/none").count() == 0


def curve(bits, dims=3):
    """The cells of a grid in Hilbert order, found by its property alone: each index maps back to its cell, neighbours touch."""
    cells = np.asarray(list(product(range(1 << bits), repeat=dims)))
    order = cells[np.argsort(common.hilbert_index(cells, bits))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all() and not order[0].any()
    return list(map(tuple, order.tolist()))


# token store


def test_keyed_access(shipped, tmp_path):
    """Distant keys, missing ones, the least long beside nulls, repeated rows: each against the whole text's ids."""
    rows = [(i * 7919, words(i % 50 + 1, i), "en", "a", 1) for i in range(400)] + [(None, "null key", "en", "a", 1), (None, "another", "en", "a", 1), (-(2**63), "least key", "en", "a", 1), (7919, "AAA first", "en", "a", 1)]
    docs = shipped.createDataFrame(rows, DOCUMENTS)
    path, p = f"file://{tmp_path}/store", public_tokenizers.path("byte_bpe_50k.json")
    tokenstore.write_store(docs, path, p, end_id=0, block_ids=300)
    all_ = tokenstore.read_store(shipped, path).collect()
    assert Counter(r.doc_id for r in all_) == Counter(r[0] for r in rows)
    first = {}
    for r in sorted(all_, key=lambda r: r.start):
        first.setdefault(r.doc_id, r.ids)
    asked = [0, 7919, 399 * 7919, 5, -(2**63), 200 * 7919]
    assert {r.doc_id: r.ids for r in tokenstore.lookup(shipped, path, asked).collect()} == {k: first[k] for k in asked if k != 5}
    assert tokenstore.lookup(shipped, path, []).count() == 0
    assert "PushedFilters: [In(first_key" in plan(tokenstore.lookup(shipped, path, asked)) or "first_key IN" in plan(tokenstore.lookup(shipped, path, asked))
    with pytest.raises(Exception, match="doesn't fit"):
        tokenstore.write_store(docs, f"file://{tmp_path}/narrow", p, end_id=0, id_bytes=1)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_store_of_clashing_columns(shipped, odd_docs, clashing_docs, tmp_path):
    p, rows = public_tokenizers.path("byte_bpe_50k.json"), []
    for name, docs in (("odd", odd_docs), ("clashing", clashing_docs)):
        tokenstore.write_store(docs, f"file://{tmp_path}/{name}", p, end_id=0, block_ids=1000)
        rows.append(plain(tokenstore.read_store(shipped, f"file://{tmp_path}/{name}").collect()))
    assert rows[0] == rows[1] and sum(rows[0].values()) == len(ROWS)


# mixing


def brute_runs(pieces):
    out = []
    for p in sorted(pieces, key=lambda p: (p["pass"], p.shard, p["at"])):
        if out and (out[-1]["pass"], out[-1]["shard"], out[-1]["at"] + out[-1]["words"]) == (p["pass"], p.shard, p["at"]):
            out[-1]["words"] += p.words
        else:
            out.append({k: p[k] for k in ("pass", "shard", "at", "words")})
    return out


@pytest.mark.parametrize("cells", [1, 64, 1 << 16])
def test_draws_over_many_sources(shipped, monkeypatch, cells):
    """Thousands of sources, one with a third of all slots: each draw gets the source that holds its slot, however cells lie."""
    monkeypatch.setattr(mixing, "CELLS", cells)
    ns = {f"s{i:04d}": 1 + i % 5 for i in range(3000)} | {"s1500": 4500}
    total = sum(ns.values())
    need = shipped.createDataFrame([(src, n, total) for src, n in ns.items()], "src string, n long, all long").repartition(3)
    got = {(r.shard, r.src): r.drawn for r in mixing.draws(need, 4, shard_slots=500).collect()}
    tickets = [r[0] for r in shipped.range(total).select(F.pmod(F.xxhash64("id", F.lit(18)), F.lit(total))).collect()]
    owner = [src for src in sorted(ns) for _ in range(ns[src])]
    assert got == Counter((draw // 500, owner[ticket]) for draw, ticket in enumerate(tickets))


def test_draws_decide_the_shards(shipped):
    """Counts of a shard add up to its slots, differ from shard to shard, follow the needs, and say which slots it holds."""
    need = shipped.createDataFrame([("sa", 6000), ("sb", 3000), ("sc", 1000), ("sd", 1)], "src string, n long").selectExpr("src", "n", "10001L as all")
    drawn = mixing.draws(need, 4, shard_slots=1000)
    by = defaultdict(dict)
    for r in drawn.collect():
        by[r.shard][r.src] = r.drawn
    assert sorted(by) == list(range(11)) and [sum(by[i].values()) for i in range(11)] == [1000] * 10 + [1]
    assert len({by[i]["sa"] for i in range(10)}) > 5  # drawn, not dealt evenly
    chi = sum((by[i].get(s, 0) - 1000 * n / 10001) ** 2 / (1000 * n / 10001) for i in range(10) for s, n in (("sa", 6000), ("sb", 3000), ("sc", 1000)))
    assert 5 < chi < 50  # about 20 degrees of freedom
    got = defaultdict(list)
    for r in mixing.dealt(need, drawn, 1000).collect():
        assert r.shard == 11 or r["count"] <= by[r.shard][r.src]
        got[r.src] += [(r.shard, r.first + i) for i in range(r["count"])]
    for src, n in (("sa", 6000), ("sb", 3000), ("sc", 1000), ("sd", 1)):
        slots = sorted(got[src])
        assert [s for _, s in slots] == list(range(n))  # numbered through the shards, all that are needed
        own = Counter(shard for shard, _ in slots)
        upto = 0
        for shard in range(11):
            take = min(by[shard].get(src, 0), n - upto)
            assert own[shard] == take
            upto += take
        assert own[11] == n - upto
    assert plain(drawn.collect()) == plain(mixing.draws(need.repartition(3), 2, shard_slots=1000).collect())


def test_passages_of_shards(shipped, odd_docs):
    """Each passage is what its shard, pass and place in the document say, with the document's own white space."""
    rows = [(i, "\n".join("\t".join(w) for w in zip(*[iter(words(3 * (i % 30 + 1), i).split())] * 3)) + "  \n", "en", "ab"[i % 2], 1) for i in range(80)]
    for docs, source in ((shipped.createDataFrame(rows, DOCUMENTS), rows), (odd_docs, ROWS)):
        texts = defaultdict(set)
        for r in source:
            texts[r[0]].add(r[1])
        got = mixing.passages(docs, block=16, shard_slots=8).collect()
        taken = mixing.taken(docs, block=16, shard_slots=8).collect()
        sums, least = Counter(), {}
        for r in got:
            sums[r.doc_id] += r.words
            least[r.doc_id] = min(r.shard, least.get(r.doc_id, r.shard))
            spans = [[m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")] for t in texts[r.doc_id]]
            fits = [t if len(s) == r.words else t[s[r["at"]][0] : s[r["at"] + r.words - 1][1]] for t, s in zip(texts[r.doc_id], spans) if r["at"] + r.words <= len(s)]
            assert r.text in fits
        want = Counter()
        for r in taken:
            want[r.doc_id] += r.taken
        assert +want == sums
        ids = Counter(r[0] for r in source)
        assert {r.doc_id: r.first_shard for r in taken if r.first_shard is not None and ids[r.doc_id] == 1} == {k: v for k, v in least.items() if ids[k] == 1}
        assert len({r.shard for r in got}) > 5
        where, pieces = mixing.mix(docs, block=16, shard_slots=8)
        by = defaultdict(list)
        for p in pieces.collect():
            by[p.src, p.start].append(p)
        assert Counter((r["pass"], r["shard"], r["at"], r["words"]) for ps in by.values() for r in brute_runs(ps)) == Counter((r["pass"], r.shard, r["at"], r.words) for r in got)


def test_mix_is_written_by_shard(shipped, tmp_path):
    docs = shipped.createDataFrame([(i, words(i % 90 + 1, i), "en", "ab"[i % 2], 1) for i in range(60)], DOCUMENTS)
    mixing.write_mix(docs, f"{tmp_path}/mix", block=16, shard_slots=32)
    got = shipped.read.parquet(f"{tmp_path}/mix").select(*COLUMNS, "shard").collect()
    assert plain(got) == plain(mixing.passages(docs, block=16, shard_slots=32).select(*COLUMNS, "shard").collect())


# neighbours


def test_neighbours_of_repeated_and_odd_rows(shipped):
    """Rows that repeat a query are one; its id with another vector is another query; vectors of odd length take no part."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist()), (20, x[21].tolist()), (99, [1.0, 2.0]), (None, x[1].tolist()), (100, [])]
    schema = "vec_id long, embedding array<double>"
    v = shipped.createDataFrame(rows, schema)
    clashing = v.selectExpr("*", "1 as x", "2 as cell", "'a' as turn", "3 as query_id", "4 as score", "5 as rank")
    got = ann.search(v, v.where("vec_id % 20 = 0"), k=20).collect()
    assert plain(got) == plain(ann.search(clashing, clashing.where("vec_id % 20 = 0"), k=20).collect())
    candidates = [(i, np.asarray(e)) for i, e in rows if i is not None and len(e) == 8]
    want = []
    for q, e in {(i, tuple(e)) for i, e in candidates if i % 20 == 0}:
        near = sorted((-float((c * np.asarray(e)).sum()), i) for i, c in candidates if i != q)[:20]
        want += [(q, n + 1, i) for n, (_, i) in enumerate(near)]
    assert Counter((r.query_id, r.rank, r.vec_id) for r in got) == Counter(want)


# shared tables


def test_tables_are_cleared(shipped, odd_docs):
    older = common.written(odd_docs, "older")
    before = common.tables(shipped)
    one, two = common.written(odd_docs, "one"), common.written(odd_docs, "two")
    common.forget(one)
    assert one._parcelspark_path not in common.tables(shipped) and two.count() == len(ROWS)
    three = common.written(odd_docs, "three")
    common.cleared(shipped, keep=three, older=before)
    assert common.tables(shipped) == before | {three._parcelspark_path} and older.count() == three.count() == len(ROWS)
