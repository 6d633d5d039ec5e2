"""Table-driven cases of single functions."""

import pytest
from pyspark.sql import functions as F

from parcelspark.functions import content_qa as Q
from parcelspark.functions import floorplans as P
from parcelspark.functions import formats as M
from parcelspark.functions import text as T
from parcelspark.functions import units as U
from parcelspark.operators import linkage, reconcile
from parcelspark.operators.state import merged_maps, row_of_reference, with_key
from parcelspark.sources import files
from parcelspark.streaming.limits import SECOND, decide


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def plain(x):
    return x.asDict(recursive=True) if hasattr(x, "asDict") else x


@pytest.mark.parametrize("label, bed, sub", [("1BR Type A", "1br", "a"), ("3 Bedroom - Type A1", "3br", "a1"), ("Studio", "studio", ""), ("STD Type A", "studio", "a"), ("  1 BR Type A  ", "1br", "a"), ("2 bed - Type B", "2br", "b"), ("1BR", "1br", ""), ("Penthouse", "penthouse", "")])
def test_unit_key(spark, label, bed, sub):
    assert plain(one(spark, P.unit_key(F.lit(label)))) == {"bed": bed, "sub": sub}


@pytest.mark.parametrize("plans, rows, picks", [
    ([("1BR Type A", None)], [("1BR Type B", None), ("1BR Type A", None)], [1]),
    ([("2 Bedroom", 2)], [("2BR Type A", None)], [0]),
    ([("Two Bed", 2)], [("1BR", 1), ("Unknown", 2)], [1]),
    ([(None, 1)], [("1BR", 1)], [None]),
    ([("1BR", 1), ("1BR Type A", 1)], [("1BR Type A", None), ("1BR Type B", None)], [0, 1]),
])
def test_linkage(spark, plans, rows, picks):
    """Another document with the same rows takes nothing of this one."""
    numbered = lambda given: [(doc, i, *x) for doc in (1, 2) for i, x in enumerate(given)]
    p = spark.createDataFrame(numbered(plans), "doc_id long, seq int, unit_type string, bedrooms int")
    s = spark.createDataFrame(numbered(rows), "doc_id long, row_no long, unit_type string, bedrooms int")
    assert {(r.doc_id, r.seq): r.row_no for r in linkage.link_plans(p, s).collect()} == {(doc, i): x for doc in (1, 2) for i, x in enumerate(picks)}


@pytest.mark.parametrize("given, want", [((1000, 50, 1050), (1000, 50, 1050)), ((1000, 150, 1005), (1000, 150, 1150)), ((1000, 150, 950), (1000, 150, 1150)), ((800, 200, 1000), (800, 200, 1000)), ((800, None, 1000), (800, 200, 1000)), ((None, 200, 1000), (800, 200, 1000)), ((800, 200, None), (800, 200, 1000)), ((800, None, None), (800, None, None))])
def test_area_reconciliation(spark, given, want):
    r = one(spark, U.reconciled_areas(*(F.lit(x).cast("double") for x in given)))
    assert (r.suite, r.balcony, r.total) == want


@pytest.mark.parametrize("text, unit", [("569mm x 671mm", "mm"), ("420cm x 380cm", "cm"), ("4.2m x 3.8m", "m"), ("12ft x 10ft", "ft"), ("12' x 10'", "ft"), ("569 x 671", "mm"), ("35 x 42", "ft"), ("4.2 x 3.8", "m")])
def test_dimension_unit(spark, text, unit):
    assert one(spark, U.dimension_unit(F.lit(text))) == unit


@pytest.mark.parametrize("field, regex, llm, found, want", [
    ("price_min", "820000", "820000", None, ("820000", "agreement", 0.98, False)),
    ("price_min", "820000", "850000", None, ("820000", "regex", 0.85, True)),
    ("price_min", None, "820000", None, ("820000", "llm", 0.7, False)),
    ("description", None, "text", None, ("text", "llm", 0.7, False)),
    ("price_min", "820000", "850000", "820000", ("820000", "table", 0.99, True)),
    ("developer", "Emaar ", "emaar", None, ("Emaar ", "agreement", 0.98, False)),
    ("developer", "A", "B", None, ("B", "llm", 0.8, True)),
    ("developer", None, None, None, (None, "none", 0.0, False)),
    ("developer", "A", None, None, ("A", "regex", 0.8, False)),
])
def test_reconcile(spark, field, regex, llm, found, want):
    r = one(spark, reconcile.reconciled(*(F.lit(x).cast("string") for x in (field, regex, llm, found))))
    assert (r.value, r.source, r.confidence, r.flagged) == want


@pytest.mark.parametrize("text, low, high, sure", [("AED 900 thousand", None, None, 0.0), ("AED 1.5M to AED 850K", 850_000, 1_500_000, 0.8), ("AED 1,200,000", 1_200_000, None, 0.6), ("950K AED", 950_000, None, 0.6), ("AED .,", None, None, 0.0), ("", None, None, 0.0)])
def test_prices(spark, text, low, high, sure):
    r = one(spark, T.price_range(T.prices(F.lit(text))))
    assert (r.min_price, r.max_price, r.confidence) == (low, high, sure)


BROCHURE = """# Palm Crest
A new home by Emaar Properties
Business Bay, Dubai
Starting from AED 1,250,000
Studio, 1BR, 2 Bedroom and 3 B/R apartments
Handover: Q4 2026
Payment Plan: 20% down payment, 50% during construction, 30% on handover
Swimming Pool, Pool, Gym, Fitness Center, Spa, Parking"""


def test_brochure(spark):
    t = F.lit(BROCHURE)
    assert plain(one(spark, T.project_name(t))) == {"value": "Palm Crest", "confidence": 0.9, "source": "heading"}
    assert one(spark, T.developer(t)).value == "Emaar"
    assert plain(one(spark, T.location(t))) == {"emirate": "Dubai", "community": "Business Bay", "full": "Business Bay, Dubai", "confidence": 0.9}
    assert one(spark, T.bedrooms(t)) == ["Studio", "1BR", "2BR", "3BR"]
    assert one(spark, T.completion_date(t, 2024)).value == "Q4 2026"
    p = one(spark, T.payment_plan(t))
    assert (p.down_payment, p.during_construction, p.on_handover, p.post_handover, round(p.confidence, 2)) == (20.0, 50.0, 30.0, None, 0.9)
    assert one(spark, T.amenities(t)) == ["Fitness Center", "Parking", "Spa", "Swimming Pool"]
    assert one(spark, T.property_type(t)).value == "Apartment"


@pytest.mark.parametrize("text", ["", "nothing to see", None])
def test_no_facts(spark, text):
    t = F.lit(text).cast("string")
    assert not one(spark, T.developer(t)).value and not one(spark, T.location(t)).emirate


@pytest.mark.parametrize("text, name, source", [("GOLDEN GATE 5M", "Golden Gate 5M", "allcaps"), ("**Sea View**", "Sea View", "bold"), ("project name: Oak Park", "Oak Park", "regex"), ("overview\nthe Silver Oak by someone", "Silver Oak", "regex")])
def test_project_names(spark, text, name, source):
    r = one(spark, T.project_name(F.lit(text)))
    assert (r.value, r.source) == (name, source)


@pytest.mark.parametrize("headers, kind", [(["Type", "Bedrooms", "Area (sqft)"], "floor_plan"), (["Milestone", "Percentage", "Due Date"], "payment_plan"), (["Column A", "Column B"], "unknown"), (["Name", "Area"], "floor_plan"), (["Milestone", "Date"], "payment_plan")])
def test_table_kind(spark, headers, kind):
    assert one(spark, P.table_kind(F.array(*map(F.lit, headers)))) == kind


@pytest.mark.parametrize("text, want", [("20%", 20.0), ("20 %", 20.0), ("20", 20.0), ("N/A", None), ("-", None), ("x", None)])
def test_percentage(spark, text, want):
    assert one(spark, P.parsed_percentage(F.lit(text))) == want


def test_square_metres(spark):
    rows = one(spark, P.floor_plan_rows(F.array(F.lit("Type"), F.lit("Area (sqm)")), F.array(F.array(F.lit("1BR"), F.lit("51.57")), F.array(F.lit(""), F.lit("")))))
    assert rows == [{"unit_type": "1BR", "total_sqft": "555.1"}]


@pytest.mark.parametrize("words, stem", [("city cities", "citi"), ("run running", "run"), ("tower towers", "tower"), ("hope hoped hoping", "hope"), ("agreed agree", "agree"), ("feed", "feed"), ("bus", "bus"), ("gas", "gas"), ("class classes", "class"), ("tie ties", "tie"), ("stay stays staying", "stay"), ("create created creating", "create"), ("hill hills", "hill"), ("sing", "sing"), ("by", "by")])
def test_stems(spark, words, stem):
    from parcelspark.operators.search import stem as stem_of

    assert {one(spark, stem_of(F.lit(w))) for w in words.split()} == {stem}


def test_tables_of_a_document(spark):
    """First rows are headers, blank rows and short tables go, plans add up over pages, the first payment plan wins."""
    from parcelspark.operators.tables import document_tables, page_tables

    raw = [
        (1, 2, 0, [["Type", "Area (sqm)"], ["1BR", "51.57"], ["", None], ["2BR", "x"]]),
        (1, 1, 0, [["Type", "Bedrooms", "Total area"], [" 3BR ", "3", "1,200"]]),
        (1, 3, 0, [["Milestone", "Percentage"], ["On Booking", "10%"], ["short"], ["Down Payment", "20%"], ["Handover", "80%"]]),
        (1, 4, 0, [["Milestone", "Percentage"], ["On Booking", "99%"]]),
        (1, 5, 0, [["Column A"], ["x"]]),
        (1, 6, 0, [["Type", "Area"]]),
        (1, 7, 0, [["Milestone", "Payment"], [None, " "]]),
        (2, 1, 0, [["Milestone", "Payment"], ["whatever", "5%"]]),
    ]
    df = spark.createDataFrame(raw, "doc_id long, page_no int, table_no int, cells array<array<string>>")
    assert sorted((r.page_no, r.kind) for r in page_tables(df.where("doc_id = 1")).collect()) == [(1, "floor_plan"), (2, "floor_plan"), (3, "payment_plan"), (4, "payment_plan"), (5, "unknown")]
    got = {r.doc_id: (r.tables, r.floor_plans, r.payment_plan) for r in document_tables(df).collect()}
    assert got[1] == (5, [{"unit_type": "3BR", "bedrooms": "3", "total_sqft": "1200.0"}, {"unit_type": "1BR", "total_sqft": "555.1"}, {"unit_type": "2BR"}], {"down_payment": "20%", "on_handover": "80%"})
    assert got[2] == (1, [], None)


def test_pages_of_a_table(spark):
    from parcelspark.operators.relational import table_page

    df = spark.createDataFrame([(i, None if i % 7 == 0 else i % 5) for i in range(40)], "id long, v long")
    want = sorted(range(40), key=lambda i: (i % 7 == 0, 0 if i % 7 == 0 else -(i % 5), i))
    assert [r.id for r in table_page(df, "v", True, 2, 10).collect()] == want[10:20]
    for column, size in (("v", 30), ("none", 10)):
        with pytest.raises(ValueError):
            table_page(df, column, True, 1, size)


def test_packages_are_written_and_read(spark, tmp_path):
    from parcelspark.sources.exports import write_packages

    df = spark.createDataFrame([(1, "a", {"k": "v"}), (2, None, {})], "id long, name string, facts map<string,string>")
    write_packages(df, f"{tmp_path}/out")
    assert sorted(map(str, files.packages(spark, f"{tmp_path}/out", df.schema, lines=True).collect())) == sorted(map(str, df.collect()))


@pytest.mark.parametrize("hashes, threshold, want", [([0, 1, 0x3F], 0.95, [None, 0, None]), ([0, 1, 0x3F], 0.9, [None, 0, 0]), ([0x3F, 0, 1], 0.9, [None, 0, 0]), ([None, 0, None], 0.9, [None, None, None]), ([-1, -2], 0.9, [None, 0])])
def test_leaders(spark, hashes, threshold, want):
    images = spark.createDataFrame([(7, i, h) for i, h in enumerate(hashes)], "doc_id long, image_id long, phash long")
    assert {r.image_id: r.duplicate_of for r in linkage.leader_duplicates(images, threshold, ["image_id"]).collect()} == dict(enumerate(want))


def test_rate_limit():
    out, log = decide([t * SECOND for t in (0, 10, 20, 60, 61)], [], 2, 60 * SECOND)
    assert [o[0] for o in out] == [False, False, True, False, True]
    assert out[2] == (True, 0, 40) and log == [10 * SECOND, 60 * SECOND]


@pytest.mark.parametrize("content, hits", [("a world-class tower", 1), ("a prestigious developer", 0), ("a prestigious home", 1), ("an exclusive deal", 0), ("luxury flat, act now", 3)])
def test_brand_rules(spark, content, hits):
    assert one(spark, Q.brand_hits(F.lit(content))) == hits


def test_formats(spark):
    assert one(spark, M.slug(M.folded(F.lit("Crème Brûlée  Tower!")))) == "creme-brulee-tower"
    assert one(spark, M.slug(F.lit("word " * 20))) == "-".join(["word"] * 12)
    assert [one(spark, M.price_text(F.lit(x).cast("double"))) for x in (None, 1_250_000, 850_000, 900)] == ["Price on request", "AED 1.2M", "AED 850K", "AED 900"]
    prices = [1_150_000, 1_250_000, 1_349_999, 1_350_000, 1_750_000, 1_950_000, 1_999_999, 99_950_000, 123_456_789]
    got = spark.createDataFrame([(float(x),) for x in prices], "p double").select("p", M.price_text(F.col("p")).alias("t")).collect()
    assert {r.p: r.t for r in got} == {float(x): f"AED {x / 1_000_000:.1f}M" for x in prices}
    assert one(spark, M.filled_template(F.lit("{a}{b} {x}"), F.create_map(F.lit("a"), F.lit("{b}"), F.lit("b"), F.lit("2")))) == "{b}2 N/A"
    assert one(spark, M.list_text(F.array(*map(F.lit, "abcde")))) == "a, b, c, and 2 more"


def test_maps(spark):
    m = F.create_map(F.lit("a"), F.lit("1"))
    assert one(spark, with_key(m, F.lit("a"), F.lit("2"))) == {"a": "2"}
    assert one(spark, merged_maps(m, F.create_map(F.lit("a"), F.lit("9"), F.lit("b"), F.lit("3")))) == {"a": "9", "b": "3"}
    assert one(spark, row_of_reference(F.lit("C14"))) == 14


def test_files(spark, tmp_path):
    (tmp_path / "r.md").write_text("# T\n## Head\n\n| Field | Row | Limit | Req |\n|---|---|---|---|\n| title | 3 | 60 | Yes |\n| body | 4 | - | no |\n## Next\ntext\n")
    got = sorted(map(tuple, files.markdown_registry(spark, str(tmp_path / "r.md")).drop("file").collect()))
    assert got == [("Head", "body", 4, None, False), ("Head", "title", 3, 60, True)]
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "p.json").write_text('{"id": 1, "facts": {"name": "X"}}')
    assert files.listing(spark, str(tmp_path), "*.pdf").select("length").first().length == 10
    assert spark.read.format("binaryFile").load(str(tmp_path / "a.pdf")).where(files.is_pdf(F.col("content"))).count() == 1
    assert files.packages(spark, str(tmp_path / "p.json"), "id int, facts map<string,string>").first().facts == {"name": "X"}
    pages = files.pdf_pages(spark, str(tmp_path / "a.pdf"), lambda c: [c.decode(), "second"])
    assert [(r.page_no, r.text) for r in pages.orderBy("page_no").collect()] == [(1, "%PDF-1.4 x"), (2, "second")]
    (tmp_path / "b.pdf").write_bytes(b"none")
    away = files.pdf_pages(spark, str(tmp_path / "*.pdf"), lambda c: ["x"], most_bytes=9)
    assert {(r.path.rpartition("/")[2], r.page_no, r.rejected) for r in away.collect()} == {("a.pdf", None, "too large"), ("b.pdf", None, "no PDF")}
