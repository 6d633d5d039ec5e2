"""Reconciliation, merging and order-dependent linkage (X, W07-W10, J08-J11, D)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import linkage as L
from ..operators import reconcile as X
from ..operators.pages import native_over_ocr
from ..sources.canonical import table
from .base import query


def _sources(spark, d):
    """Three sources of two fields of each plan, as text."""
    p = table(spark, d, "plans")
    text = lambda c: c.cast("long").cast("string")
    numeric = p.select("doc_id", "seq", F.lit("total_sqft").alias("field"), text(F.col("total_sqft")).alias("regex"), text(F.col("suite_sqft") + F.col("doc_id") % 2).alias("llm"), text(F.when(F.col("doc_id") % 5 == 0, F.col("balcony_sqft"))).alias("found"))
    words = p.select("doc_id", "seq", F.lit("developer").alias("field"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("Dev "), (F.col("doc_id") % 4).cast("string"), F.lit(" "))).alias("regex"), F.when(F.col("doc_id") % 7 > 0, F.concat(F.lit("dev "), (F.col("doc_id") % 8).cast("string"))).alias("llm"), F.lit(None).cast("string").alias("found"))
    return numeric.unionByName(words)


_SOURCES = """, s AS (SELECT doc_id, seq, 'total_sqft' AS field, CAST(CAST(total_sqft AS BIGINT) AS VARCHAR) AS regex, CAST(CAST(suite_sqft + doc_id % 2 AS BIGINT) AS VARCHAR) AS llm, CAST(CAST(CASE WHEN doc_id % 5 = 0 THEN balcony_sqft END AS BIGINT) AS VARCHAR) AS found FROM plans
UNION ALL SELECT doc_id, seq, 'developer', CASE WHEN doc_id % 3 > 0 THEN concat('Dev ', doc_id % 4, ' ') END, CASE WHEN doc_id % 7 > 0 THEN concat('dev ', doc_id % 8) END, NULL FROM plans),
m AS (SELECT *, CASE WHEN field = 'total_sqft' THEN abs(CAST(regex AS DOUBLE) - CAST(llm AS DOUBLE)) < 1 ELSE lower(trim(regex)) = lower(trim(llm)) END AS same FROM (SELECT doc_id, seq, field, regex, llm, found FROM s WHERE field = 'total_sqft') UNION ALL SELECT *, lower(trim(regex)) = lower(trim(llm)) FROM s WHERE field <> 'total_sqft')"""
_SOURCES = _SOURCES.replace("CASE WHEN field = 'total_sqft' THEN abs(CAST(regex AS DOUBLE) - CAST(llm AS DOUBLE)) < 1 ELSE lower(trim(regex)) = lower(trim(llm)) END", "abs(CAST(regex AS DOUBLE) - CAST(llm AS DOUBLE)) < 1")


@query("plans", _SOURCES + """ SELECT doc_id, seq, field, CASE WHEN found IS NOT NULL THEN found WHEN regex IS NOT NULL AND llm IS NOT NULL THEN CASE WHEN same OR field = 'total_sqft' THEN regex ELSE llm END ELSE coalesce(regex, llm) END AS value,
CASE WHEN found IS NOT NULL THEN 'table' WHEN regex IS NOT NULL AND llm IS NOT NULL THEN CASE WHEN same THEN 'agreement' WHEN field = 'total_sqft' THEN 'regex' ELSE 'llm' END WHEN regex IS NOT NULL THEN 'regex' WHEN llm IS NOT NULL THEN 'llm' ELSE 'none' END AS source,
CASE WHEN found IS NOT NULL THEN 0.99 WHEN regex IS NOT NULL AND llm IS NOT NULL THEN CASE WHEN same THEN 0.98 WHEN field = 'total_sqft' THEN 0.85 ELSE 0.8 END WHEN regex IS NOT NULL THEN 0.8 WHEN llm IS NOT NULL THEN 0.7 ELSE 0.0 END::DOUBLE AS confidence,
CASE WHEN found IS NOT NULL THEN coalesce(llm <> found, false) WHEN regex IS NOT NULL AND llm IS NOT NULL THEN NOT same ELSE false END AS flagged FROM m""")
def x01_reconcile(spark, d):
    return X.reconciled_fields(_sources(spark, d))


@query("plans", _SOURCES + " SELECT doc_id, seq, field, same FROM m WHERE regex IS NOT NULL AND llm IS NOT NULL")
def x02_values_match(spark, d):
    s = _sources(spark, d).where("regex is not null and llm is not null")
    return s.select("doc_id", "seq", "field", X.values_match(F.col("regex"), F.col("llm"), F.col("field") == "total_sqft").alias("same"))


@query("plans", _SOURCES + """ SELECT doc_id, seq, max(CASE WHEN field = 'total_sqft' THEN CASE WHEN found IS NOT NULL THEN found ELSE coalesce(regex, llm) END END) AS total_sqft, CAST(sum(CASE WHEN found IS NOT NULL THEN coalesce(llm <> found, false)::INT WHEN regex IS NOT NULL AND llm IS NOT NULL THEN (NOT same)::INT ELSE 0 END) AS BIGINT) AS flags FROM m GROUP BY doc_id, seq""")
def x03_reconcile_project(spark, d):
    """Fields in long form are reconciled at once and pivoted back."""
    r = X.reconciled_fields(_sources(spark, d))
    return r.groupBy("doc_id", "seq").agg(F.max(F.when(F.col("field") == "total_sqft", F.col("value"))).alias("total_sqft"), F.count_if("flagged").alias("flags"))


@query("plans", "SELECT doc_id, seq, CASE WHEN total_sqft IS NULL OR (suite_sqft IS NOT NULL AND confidence > 0.6) THEN coalesce(suite_sqft, total_sqft) ELSE total_sqft END AS value FROM plans")
def x04_by_confidence(spark, d):
    return table(spark, d, "plans").select("doc_id", "seq", X.by_confidence(F.col("suite_sqft"), F.col("confidence"), F.col("total_sqft"), F.lit(0.6)).alias("value"))


@query("plans", "SELECT doc_id, seq, coalesce(nullif(balcony_sqft, 0), suite_sqft) AS value FROM plans")
def x05_table_override(spark, d):
    return table(spark, d, "plans").select("doc_id", "seq", F.coalesce(F.nullif("balcony_sqft", F.lit(0.0)), "suite_sqft").alias("value"))


@query("plans", "SELECT doc_id, seq, CASE WHEN confidence >= 0.6 THEN unit_type END AS hint FROM plans")
def x06_sure_hints(spark, d):
    return table(spark, d, "plans").select("doc_id", "seq", F.when(F.col("confidence") >= 0.6, F.col("unit_type")).alias("hint"))


@query("lines", "SELECT doc_id, page_no, md5(CASE WHEN trim(text) <> '' THEN text ELSE concat('page ', page_no) END) AS digest FROM lines")
def x07_native_over_ocr(spark, d):
    """Pages with text of their own keep it; the others take what was read from their image."""
    p = table(spark, d, "lines")
    return native_over_ocr(p.where("trim(text) <> ''"), p.withColumn("text", F.concat(F.lit("page "), F.col("page_no").cast("string")))).select("doc_id", "page_no", F.md5("text").alias("digest"))


@query("plans", "SELECT doc_id, seq, CASE WHEN unit_type IS NULL AND total_sqft IS NULL THEN concat('plan ', seq) ELSE unit_type END AS name, CASE WHEN unit_type IS NULL AND total_sqft IS NULL THEN 0.5 END AS confidence FROM plans")
def x08_fallback_name(spark, d):
    both = F.col("unit_type").isNull() & F.col("total_sqft").isNull()
    return table(spark, d, "plans").select("doc_id", "seq", F.when(both, F.concat(F.lit("plan "), "seq")).otherwise(F.col("unit_type")).alias("name"), F.when(both, 0.5).alias("confidence"))


@query("contents", "SELECT run_id, field, concat_ws(', ', nullif(developer, ''), location) AS place FROM contents")
def x09_location_text(spark, d):
    return table(spark, d, "contents").select("run_id", "field", F.concat_ws(", ", F.nullif("developer", F.lit("")), "location").alias("place"))


_KEYED = """, k AS (SELECT *, CASE WHEN unit_type LIKE 'Studio%' THEN 'studio' ELSE regexp_extract(unit_type, '^([0-9]+)', 1) || 'br' END AS bed, lower(regexp_extract(unit_type, 'Type ([A-Z][0-9]*)', 1)) AS sub FROM plans WHERE unit_type IS NOT NULL),
n AS (SELECT doc_id, bed, count(DISTINCT nullif(sub, '')) AS specific, max(nullif(sub, '')) AS sole FROM k GROUP BY doc_id, bed),
g AS (SELECT k.* EXCLUDE (sub), CASE WHEN sub = '' AND specific = 1 THEN sole ELSE sub END AS sub, (coalesce(suite_sqft > 0, false))::INT + (coalesce(balcony_sqft > 0, false))::INT + (coalesce(total_sqft > 0, false))::INT AS score FROM k JOIN n USING (doc_id, bed) WHERE NOT (sub = '' AND specific > 1)),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, bed, sub ORDER BY score DESC, confidence DESC, seq) AS place FROM g)"""


@query("plans", _KEYED + " SELECT doc_id, bed, sub, count(*) AS members, max(CASE WHEN place = 1 THEN seq END) AS seq, arg_min(bathrooms, CASE WHEN bathrooms IS NOT NULL THEN place END) AS bathrooms FROM o GROUP BY doc_id, bed, sub")
def w07_merged_plans(spark, d):
    return X.merged_plans(table(spark, d, "plans")).where("unit_type is not null").select("doc_id", "bed", "sub", "members", "seq", "bathrooms")


@query("plans", _KEYED + " SELECT doc_id, count(*) AS kept FROM (SELECT DISTINCT doc_id, bed, sub FROM g) GROUP BY doc_id")
def w08_generic_absorption(spark, d):
    return X.merged_plans(table(spark, d, "plans")).where("unit_type is not null").groupBy("doc_id").agg(F.count("*").alias("kept"))


@query("brochures", r"SELECT doc_id, greatest(len(regexp_extract_all(text, '(?i)[0-9]+\s*(?:bed(?:room)?s?|br)\s*-?\s*(?:(?:apartment|unit)\s*)?(?:type\s+[a-z][0-9]*)?|studio|penthouse|duplex|townhouse')), 1) AS labels FROM brochures")
def w10_sections(spark, d):
    """Sections begin at unit labels; a text without any is one."""
    from ..functions.floorplans import sections

    return table(spark, d, "brochures").select("doc_id", F.size(sections(F.col("text"))).cast("long").alias("labels"))


# plan by plan over the rows of its document that are still free
_LINKED = """, RECURSIVE k AS (SELECT doc_id, seq, bedrooms, CASE WHEN unit_type LIKE 'Studio%' THEN 'studio' ELSE regexp_extract(unit_type, '^([0-9]+)', 1) || 'br' END AS bed, lower(regexp_extract(unit_type, 'Type ([A-Z][0-9]*)', 1)) AS sub FROM plans),
f AS (SELECT s.doc_id, list({'row_no': s.row_no, 'beds': s.bedrooms, 'bed': CASE WHEN s.unit_type LIKE 'Studio%' THEN 'studio' ELSE regexp_extract(s.unit_type, '^([0-9]+)', 1) || 'br' END, 'sub': lower(regexp_extract(s.unit_type, 'Type ([A-Z][0-9]*)', 1))} ORDER BY s.row_no) AS free FROM specs s GROUP BY s.doc_id),
l AS (SELECT doc_id, -1::BIGINT AS seq, NULL::BIGINT AS row_no, free FROM f
UNION ALL SELECT doc_id, seq, hit, list_filter(free, lambda x: hit IS NULL OR x.row_no <> hit) FROM (SELECT k.doc_id, k.seq, l.free, CASE WHEN k.bed IS NOT NULL THEN coalesce(list_filter(l.free, lambda x: k.sub <> '' AND x.bed = k.bed AND x.sub = k.sub)[1].row_no, list_filter(l.free, lambda x: x.bed = k.bed)[1].row_no, list_filter(l.free, lambda x: x.beds = k.bedrooms)[1].row_no) END AS hit FROM l JOIN k ON k.doc_id = l.doc_id AND k.seq = l.seq + 1))"""


@query("plans specs", _LINKED + " SELECT doc_id, seq::INT AS seq, row_no FROM l WHERE seq >= 0")
def j08_linked_plans(spark, d):
    return L.link_plans(table(spark, d, "plans"), table(spark, d, "specs"))


@query("plans specs", _LINKED + """, p AS (SELECT p.*, l.row_no AS hit FROM plans p JOIN l USING (doc_id, seq))
SELECT coalesce(p.doc_id, s.doc_id) AS doc_id, p.seq::INT AS seq, coalesce(p.hit, s.row_no) AS row_no, coalesce(p.unit_type, s.unit_type) AS unit_type, coalesce(nullif(s.total_sqft, 0), p.total_sqft) AS total_sqft, coalesce(nullif(s.balcony_sqft, 0), p.balcony_sqft) AS balcony_sqft,
CASE WHEN p.doc_id IS NULL THEN 0.95 WHEN coalesce(nullif(s.total_sqft, 0), nullif(s.balcony_sqft, 0)) IS NOT NULL THEN 0.99 ELSE p.confidence END::DOUBLE AS confidence FROM p FULL JOIN specs s ON s.doc_id = p.doc_id AND s.row_no = p.hit""")
def j09_linked_areas(spark, d):
    return L.linked_areas(table(spark, d, "plans"), table(spark, d, "specs"))


# box by box, first for equal labels and then for contained ones; what is left is matched in order
@query("plans images", """, RECURSIVE b AS (SELECT doc_id, list({'no': seq, 'label': lower(CASE WHEN image_id % 2 = 0 THEN 'Studio' ELSE alt_text END)} ORDER BY width % 100, seq) AS boxes FROM images WHERE category = 'floor_plan' GROUP BY doc_id),
p AS (SELECT doc_id, list({'seq': seq, 'label': lower(coalesce(unit_type, ''))} ORDER BY seq) AS plans FROM plans GROUP BY doc_id),
s AS (SELECT doc_id, boxes, 0::BIGINT AS m, coalesce(plans, CAST([] AS STRUCT(seq BIGINT, label VARCHAR)[])) AS free, CAST([] AS STRUCT(no BIGINT, seq BIGINT)[]) AS found FROM b LEFT JOIN p USING (doc_id)
UNION ALL SELECT doc_id, boxes, m, list_filter(free, lambda x: hit IS NULL OR x.seq <> hit), CASE WHEN hit IS NULL THEN found ELSE list_append(found, {'no': box.no, 'seq': hit}) END
FROM (SELECT *, CASE WHEN box.label <> '' AND NOT list_contains(list_transform(found, lambda y: y.no), box.no) THEN list_filter(free, lambda x: x.label <> '' AND CASE WHEN m <= len(boxes) THEN x.label = box.label ELSE contains(x.label, box.label) OR contains(box.label, x.label) END)[1].seq END AS hit
FROM (SELECT doc_id, boxes, m + 1 AS m, free, found, boxes[m % len(boxes) + 1] AS box FROM s WHERE m < 2 * len(boxes)))),
u AS (SELECT doc_id, free, found, unnest(boxes).no AS no, generate_subscripts(boxes, 1) AS place FROM s WHERE m = 2 * len(boxes)), v AS (SELECT *, list_filter(found, lambda y: y.no = no)[1].seq AS hit FROM u)
SELECT doc_id, no::INT AS box_no, coalesce(hit, free[row_number() OVER (PARTITION BY doc_id, hit IS NULL ORDER BY place)].seq)::INT AS seq FROM v""")
def j11_box_matches(spark, d):
    i = table(spark, d, "images").where("category = 'floor_plan'")
    boxes = i.select("doc_id", F.col("seq").cast("int").alias("box_no"), F.when(F.col("image_id") % 2 == 0, "Studio").otherwise(F.col("alt_text")).alias("label"), (F.col("width") % 100).alias("x"))
    return L.box_matches(boxes, table(spark, d, "plans"))


def _led(where: str, order: str, threshold: float) -> str:
    """SQL: image by image of each document, with the hashes that are known so far."""
    return f""", RECURSIVE o AS (SELECT doc_id, image_id, phash, row_number() OVER (PARTITION BY doc_id ORDER BY {order}) AS n FROM images WHERE {where}),
s AS (SELECT doc_id, 0::BIGINT AS n, NULL::BIGINT AS image_id, NULL::BIGINT AS duplicate_of, CAST([] AS STRUCT(i BIGINT, h BIGINT)[]) AS known FROM (SELECT DISTINCT doc_id FROM o)
UNION ALL SELECT doc_id, n, image_id, hit, CASE WHEN phash IS NULL OR hit IS NOT NULL THEN known ELSE list_append(known, {{'i': image_id, 'h': phash}}) END
FROM (SELECT o.*, s.known, CASE WHEN o.phash IS NOT NULL THEN list_filter(s.known, lambda k: 1 - bit_count(xor(k.h, o.phash)) / 64.0 >= {threshold})[1].i END AS hit FROM s JOIN o ON o.doc_id = s.doc_id AND o.n = s.n + 1))"""


@query("images", _led("true", "seq, image_id", 0.9) + " SELECT doc_id, image_id, duplicate_of FROM s WHERE n > 0")
def d01_leader_duplicates(spark, d):
    return L.leader_duplicates(table(spark, d, "images"), 0.9, ["seq", "image_id"])


@query("images", _led("category <> 'other'", "source = 'page_render', seq, image_id", 0.95) + " SELECT doc_id, count(*) AS images, count(duplicate_of) AS duplicates FROM s WHERE n > 0 GROUP BY doc_id")
def d02_classification_fold(spark, d):
    """Images but others, embedded ones before renders, at the stricter threshold; with counts."""
    i = table(spark, d, "images").where("category <> 'other'").withColumn("late", (F.col("source") == "page_render").cast("int"))
    r = L.leader_duplicates(i, 0.95, ["late", "seq", "image_id"])
    return r.groupBy("doc_id").agg(F.count("*").alias("images"), F.count("duplicate_of").alias("duplicates"))


@query()
def d05_folded_slug(spark, d):
    """Slugs of first lines: letters are folded to ASCII in Arrow batches, the rest is built-in."""
    from ..functions.formats import folded, slug

    return table(spark, d, "lines").where("page_no = 1").select("doc_id", slug(folded("text")).alias("slug"))


@query("lines", "SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS place FROM lines")
def d07_document_rows(spark, d):
    """A document as rows: generated by built-in explode, numbered in order."""
    return table(spark, d, "lines").select("doc_id", "page_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no")).alias("place"))
