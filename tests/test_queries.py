"""Every query against its SQL on the smallest tables; the others against models."""

import decimal

import duckdb
import pytest

from parcelspark.operators import linkage
from parcelspark.plans import registry
from parcelspark.sources.canonical import table
from parcelspark.streaming import limits

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return float(f"{v:.9g}") if isinstance(v, float) else v


#: Queries whose decisions depend on order; only they may run Python.
PYTHON = {"j08_linked_plans", "j09_linked_areas", "j11_box_matches", "d01_leader_duplicates", "d02_classification_fold", "t01_rate_limit", "s08_table_function"}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, sql, name):
    df = registry.QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert name in PYTHON or not any(x in plan for x in ("MapInArrow", "MapInPandas", "ArrowEvalPython", "BatchEvalPython"))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    r = sql.sql(registry.ORACLE_SQL[name])
    assert sorted(r.columns) == columns
    places = [r.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(x[i]) for i in places) for x in r.fetchall()), key=str)


def test_columns_are_pruned(spark):
    plan = registry.QUERIES["f16_range_maximum"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan


def test_without_sql_are_few():
    assert len(registry.QUERIES) - len(registry.ORACLE_SQL) <= 3


def parts(label):
    """Bedrooms and type of the sample's labels, read apart from the library: "2 Bedroom Type A1" is ("2", "A1")."""
    if label is None:
        return None
    head, _, kind = label.partition(" Type ")
    return ("0" if head == "Studio" else head[0], kind)


def by_doc(rows, order):
    out = {}
    for r in sorted(rows, key=order):
        out.setdefault(r.doc_id, []).append(r)
    return out


def model_links(plans, specs):
    """Plan by plan over all rows of its document that are left, one test after the other."""
    links = {}
    specs = by_doc(specs, lambda r: r.row_no)
    for doc, ps in by_doc(plans, lambda r: r.seq).items():
        left = list(specs.get(doc, []))
        for p in ps:
            mine, hit = parts(p.unit_type), None
            if mine:
                for fits in (
                    lambda r: r.unit_type and mine[1] and parts(r.unit_type) == mine,
                    lambda r: r.unit_type and parts(r.unit_type)[0] == mine[0],
                    lambda r: r.bedrooms == p.bedrooms,
                ):
                    hit = hit or next((r for r in left if fits(r)), None)
            if hit:
                left.remove(hit)
            links[doc, p.seq] = hit
    return links


@pytest.fixture(scope="module")
def links(spark):
    return model_links(table(spark, SF, "plans").collect(), table(spark, SF, "specs").collect())


def test_links_of_plans(spark, links):
    got = {(r.doc_id, r.seq): r.row_no for r in registry.QUERIES["j08_linked_plans"](spark, SF).collect()}
    assert got == {k: r and r.row_no for k, r in links.items()}
    assert None in got.values() and any(v is not None for v in got.values())


def test_linked_areas(spark, links):
    want, taken = [], {(d, r.row_no) for (d, _), r in links.items() if r}
    for p in table(spark, SF, "plans").collect():
        r = links[p.doc_id, p.seq]
        t, b = (r.total_sqft, r.balcony_sqft) if r else (None, None)
        want.append((p.doc_id, p.seq, r.row_no if r else None, p.unit_type or (r.unit_type if r else None), t or p.total_sqft, b or p.balcony_sqft, 0.99 if t or b else p.confidence))
    for r in table(spark, SF, "specs").collect():
        if (r.doc_id, r.row_no) not in taken:
            want.append((r.doc_id, None, r.row_no, r.unit_type, r.total_sqft or None, r.balcony_sqft or None, 0.95))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in registry.QUERIES["j09_linked_areas"](spark, SF).collect())


def test_boxes_of_plans(spark):
    plans = by_doc(table(spark, SF, "plans").collect(), lambda r: r.seq)
    boxes = by_doc(table(spark, SF, "images").where("category = 'floor_plan'").collect(), lambda r: (r.width % 100, r.seq))
    want = {}
    for doc, bs in boxes.items():
        left = [(p.seq, (p.unit_type or "").lower()) for p in plans.get(doc, [])]
        name = {b.seq: ("Studio" if b.image_id % 2 == 0 else b.alt_text).lower() for b in bs}
        for exact in (True, False):
            for b in bs:
                fits = [x for x in left if x[1] and (name[b.seq] == x[1] if exact else name[b.seq] in x[1] or x[1] in name[b.seq])]
                if (doc, b.seq) not in want and fits:
                    want[doc, b.seq] = fits[0][0]
                    left.remove(fits[0])
        for b in bs:
            if (doc, b.seq) not in want:
                want[doc, b.seq] = left.pop(0)[0] if left else None
    got = {(r.doc_id, r.box_no): r.seq for r in registry.QUERIES["j11_box_matches"](spark, SF).collect()}
    assert got == want and any(v is not None for v in got.values())


def test_classification_fold(spark):
    want = {}
    for doc, rows in by_doc(table(spark, SF, "images").where("category <> 'other'").collect(), lambda r: (r.source == "page_render", r.seq, r.image_id)).items():
        known, copies = [], 0
        for r in rows:
            alike = r.phash is not None and any(bin((h ^ r.phash) & (1 << 64) - 1).count("1") <= 64 * 0.05 for h in known)
            copies += alike
            if r.phash is not None and not alike:
                known.append(r.phash)
        want[doc] = (len(rows), copies)
    assert {r.doc_id: (r.images, r.duplicates) for r in registry.QUERIES["d02_classification_fold"](spark, SF).collect()} == want


def test_folded_slugs(spark):
    import re
    import unicodedata

    for r in table(spark, SF, "lines").where("page_no = 1").select("doc_id", "text").join(registry.QUERIES["d05_folded_slug"](spark, SF), "doc_id").collect():
        ascii_ = unicodedata.normalize("NFKD", r.text).encode("ascii", "ignore").decode().lower()
        whole = "-".join(re.findall("[a-z0-9]+", ascii_))
        assert r.slug == whole if len(whole) <= 60 else whole.startswith(r.slug) and 30 < len(r.slug) <= 60


def test_leader_duplicates(spark):
    rows = table(spark, SF, "images").collect()
    got = {r.image_id: r.duplicate_of for r in linkage.leader_duplicates(table(spark, SF, "images"), 0.9, ["seq", "image_id"]).collect()}
    want = {}
    for doc in {r.doc_id for r in rows}:
        known = []
        for r in sorted((r for r in rows if r.doc_id == doc), key=lambda r: (r.seq, r.image_id)):
            hit = next((i for i, h in known if r.phash is not None and 1 - bin((h ^ r.phash) & (1 << 64) - 1).count("1") / 64 >= 0.9), None)
            want[r.image_id] = hit
            if hit is None and r.phash is not None:
                known.append((r.image_id, r.phash))
    assert got == want and any(v is not None for v in got.values())


def test_stream_decides_as_batch(spark):
    stream = registry.QUERIES["t01_rate_limit_stream"](spark, SF)
    requests = stream.select("key", "seq", "ts_us")
    batch = limits.limited(requests, 10, 60)
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))
    assert stream.where("limited").count() > 0


def test_stream_has_each_user_and_lies_in_files(spark):
    stream = registry.QUERIES["t01_rate_limit_stream"](spark, SF)
    users = spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct().count()
    assert stream.select("key").distinct().count() == users and stream.inputFiles()


def test_covered_renders_are_of_one_document(spark):
    schema = "image_id long, doc_id long, page_no int, width int, height int, phash long"
    renders = spark.createDataFrame([(1, 1, 3, 100, 100, 0), (2, 2, 3, 100, 100, 0)], schema)
    embedded = spark.createDataFrame([(3, 1, 3, 90, 90, None)], schema)
    assert [r.image_id for r in linkage.without_covered(renders, embedded).collect()] == [2]
