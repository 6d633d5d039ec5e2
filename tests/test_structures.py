"""Text index, deep pages, kept versions, names, Hamming bands, sketches: against plain models."""

import random
import time

import pytest
from pyspark.sql import functions as F

from parcelspark.functions.text import AMENITIES, COMMUNITIES, _named, _words
from parcelspark.operators import linkage, sketches, textindex
from parcelspark.operators.names import mapped_names
from parcelspark.operators.paging import deep_page
from parcelspark.operators.search import text_search
from parcelspark.operators.versions import Conflict, VersionedTable

WORDS = "marina towers tower hills nation creek golden sands palm the of bay".split()


def texts(spark, lo, hi):
    rnd = random.Random(lo)
    return spark.createDataFrame([(i * 700, " ".join(rnd.choices(WORDS, k=rnd.randint(0, 9))) if i % 13 else None) for i in range(lo, hi)], "id long, text string")


@pytest.mark.parametrize("asked", ["marina", "the towers of hills", "golden palm", "nowhere", "of the", "bay bay creek"])
def test_index_finds_what_a_scan_finds(spark, tmp_path, asked):
    index = textindex.TextIndex(spark, str(tmp_path))
    index.add(texts(spark, 0, 400), ["text"])
    index.add(texts(spark, 400, 700), ["text"])  # more documents make blocks of their own
    every = texts(spark, 0, 400).union(texts(spark, 400, 700))
    scan = text_search(every, ["text"], asked).select("id", "rank") if asked != "of the" else every.where("false").selectExpr("id", "0L as rank")
    want = sorted(map(tuple, scan.collect()), key=lambda r: (-r[1], r[0]))
    assert sorted(map(tuple, index.search(asked).collect()), key=lambda r: (-r[1], r[0])) == want
    assert sorted(map(tuple, index.search(asked, 7).collect()), key=lambda r: (-r[1], r[0])) == want[:7]


def test_a_query_reads_its_own_terms(spark, tmp_path):
    index = textindex.TextIndex(spark, str(tmp_path))
    index.add(texts(spark, 0, 50), ["text"])
    assert "PushedFilters: [In(term, [creek,palm])]" in index.blocks(["creek", "palm"])._jdf.queryExecution().toString()


def test_phrases(spark, tmp_path):
    rows = [(1, "marina towers by the bay"), (2, "towers marina"), (3, "golden marina tower"), (4, None)]
    index = textindex.TextIndex(spark, str(tmp_path))
    index.add(spark.createDataFrame(rows, "id long, text string"), ["text"])
    assert {r.id for r in index.phrase("marina tower").collect()} == {1, 3} and not index.phrase("").collect()


def test_an_index_is_made_anew_for_other_files(spark, tmp_path):
    texts(spark, 0, 30).write.parquet(f"{tmp_path}/t")
    made = iter(f"{tmp_path}/index{i}" for i in range(9))
    get = lambda: textindex.kept_index(spark.read.parquet(f"{tmp_path}/t"), ["text"], lambda: next(made))
    one = get()
    assert get() is one
    texts(spark, 30, 60).write.mode("append").parquet(f"{tmp_path}/t")
    assert get() is not one


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("page", [1, 2, 9, 30, 57, 60, 61, 99])
@pytest.mark.parametrize("kind", ["spread", "ties"])
def test_deep_pages(spark, kind, page, descending):
    value = (lambda i: None if i % 11 == 0 else i * 7919 % 1009) if kind == "spread" else (lambda i: None if i % 11 == 0 else 5 if i % 3 else i % 40)
    rows = [(i, value(i)) for i in range(600)]
    want = sorted(rows, key=lambda r: (r[1] is None, 0 if r[1] is None else -r[1] if descending else r[1], r[0]))[(page - 1) * 10 : page * 10]
    df = spark.createDataFrame(rows, "id long, v long")
    assert [tuple(r) for r in deep_page(df, "v", descending, page, 10, ranges=16).collect()] == want


def test_a_deep_page_of_nothing(spark):
    assert not deep_page(spark.createDataFrame([], "id long, v long"), "v", True, 3, 10).collect()


def test_versions_are_kept_and_one_of_two_writers_loses(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t", "id", buckets=4)
    t.create(spark.createDataFrame([(i, "a") for i in range(20)], "id long, v string"))
    keys = spark.createDataFrame([(3,), (4,), (99,)], "id long")
    assert t.change(keys, lambda rows: rows.where("id <> 3").withColumn("v", F.when(F.col("id") == 4, "b").otherwise(F.col("v")))) == 1
    assert {r.id: r.v for r in t.read(1).collect()} == {i: "b" if i == 4 else "a" for i in range(20) if i != 3}
    with pytest.raises(Conflict):
        t.change(keys, lambda rows: rows.where("false"), base=0)
    assert t.version() == 1 and t.read(0).count() == 20 and t.read().count() == 19
    assert t.change(keys.where("false"), lambda rows: rows) == 1  # nothing to change, no version
    with pytest.raises(ValueError):
        t.read(7)
    every = spark.range(20).withColumnRenamed("id", "id")
    assert t.change(every, lambda rows: rows.where("false")) == 2 and t.read().count() == 0


def test_a_writer_that_comes_second_leaves_nothing(spark, tmp_path, monkeypatch):
    """Both see the same newest version; the manifest can be made once only."""
    one, two = (VersionedTable(spark, f"{tmp_path}/t", "id", buckets=2) for _ in range(2))
    one.create(spark.createDataFrame([(1, "a")], "id long, v string"))
    one.change(spark.createDataFrame([(1,)], "id long"), lambda rows: rows.withColumn("v", F.lit("one")))
    monkeypatch.setattr(two, "version", lambda: 0)
    before = {p.name for p in (tmp_path / "t" / "data").iterdir()}
    with pytest.raises(Conflict):
        two.change(spark.createDataFrame([(1,)], "id long"), lambda rows: rows.withColumn("v", F.lit("two")))
    assert [r.v for r in one.read().collect()] == ["one"] and {p.name for p in (tmp_path / "t" / "data").iterdir()} == before


def test_names(spark):
    rnd = random.Random(5)
    make = lambda: "".join(rnd.choices("abC ", k=rnd.randint(0, 6)))
    names, keys = {make() for _ in range(120)} | {None}, {make() for _ in range(60)} | {"zzz", None}
    got = {(r.name, r.status, r.key) for r in mapped_names(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(k,) for k in keys], "key string")).collect()}
    want, used = set(), set()
    for n in names:
        equal = sorted(k for k in keys if n is not None and k is not None and k.upper() == n.upper())
        near = sorted(k for k in keys if n and k and (k.upper() in n.upper() or n.upper() in k.upper()))
        key = (equal or near or [None])[0]
        want.add((n, "MATCH" if equal else "PARTIAL" if near else "UNMATCHED", key))
        used.add(key)
    assert got == want | {(None, "UNUSED", k) for k in keys if k is None or k not in used} 


def test_bands_find_what_all_leaders_would(spark):
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(60)]
    hashes = [b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 8))) & (1 << 64) - 1 for b in base * 12]
    for threshold in (0.8, 0.9, 0.95, 1.0):
        leaders, known = linkage.Leaders(threshold), []
        for i, h in enumerate(hashes):
            want = next((j for j, x in known if 1 - (x ^ h).bit_count() / 64 >= threshold), None)
            if want is None:
                known.append((i, h))
            assert leaders.place(h, i) == want


def test_many_hashes_of_one_document_take_seconds():
    rnd, leaders, began = random.Random(1), linkage.Leaders(0.95), time.perf_counter()
    for i in range(100_000):
        leaders.place(rnd.getrandbits(64), i)
    assert time.perf_counter() - began < 60


def test_sketches_of_days_merge(spark, tmp_path):
    rows = [(i % 10, (i * 7919) % 100_003) for i in range(20_000)]
    df, folder = spark.createDataFrame(rows, "day long, v long"), f"{tmp_path}/days"
    for day in (range(5), range(5, 10), range(9, 10)):  # the last day comes again
        sketches.stored(sketches.daily(df.where(F.col("day").isin(*day)), F.col("day"), F.col("v")), folder)
    (r,) = sketches.merged(spark, folder, F.lit(0), {"p95": 0.95, "median": 0.5}).collect()
    values = sorted(v for _, v in rows)
    assert (r.n, r.total, r.low, r.high) == (20_000, sum(values), values[0], values[-1])
    for q, x in ((0.95, r.p95), (0.5, r.median)):
        assert abs(sum(v <= x for v in values) / len(values) - q) < 0.01


@pytest.mark.parametrize("names, suffix", [(AMENITIES, ""), (COMMUNITIES, ""), (("Villa", "Mixed Use", "Studio"), "s?")])
def test_names_of_a_list_are_found_as_by_their_patterns(spark, names, suffix):
    rnd = random.Random(9)
    rows = [(" ".join(rnd.choice([n, n.upper(), f"x{n}", f"{n}s", f"({n})", n[:-1], "und", "_" + n]) for n in rnd.choices(names, k=5)),) for _ in range(60)] + [(None,), ("",), ("24/7 security\nCentral A/C d3.",)]
    df = spark.createDataFrame(rows, "t string")
    plain = F.transform(F.filter(_words(names, suffix), lambda x: F.regexp_like(F.col("t"), x["pattern"])), lambda x: x["name"])
    for r in df.select("t", _named(F.col("t"), names, suffix).alias("got"), plain.alias("want")).collect():
        assert r.t is None or r.got == r.want


def test_a_table_function_sees_pages_in_order(spark):
    from parcelspark.functions.shipping import ship
    from parcelspark.operators.tables import document_tables
    from parcelspark.operators.tablescan import scanned_tables

    plans = [["Unit Type", "Total area (sqft)"], ["2BR", "1,200"], ["Studio", "400"]]
    pay = lambda share: [["Milestone", "Percentage"], ["On Booking", share]]
    rows = [(1, 9, 0, pay("30%")), (1, 2, 1, pay("10%")), (1, 2, 0, plans), (1, 10, 0, plans[:2]), (1, 2, 2, [["Milestone", "Percentage"], ["", ""]]), (2, 1, 0, pay("5%")), (3, 1, 0, [["a"]])]
    raw = ship(spark).createDataFrame(rows, "doc_id long, page_no int, table_no int, cells array<array<string>>").repartition(3)
    got, want = (sorted((r.doc_id, r.tables, str(r.floor_plans), str(r.payment_plan)) for r in f(raw).select("doc_id", "tables", "floor_plans", "payment_plan").collect()) for f in (scanned_tables, document_tables))
    assert got == want and {r.doc_id: r.seen for r in scanned_tables(raw).collect()}[1] == [2, 9, 10]
    assert not scanned_tables(raw.where("false")).collect()
