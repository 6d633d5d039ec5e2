"""Scans, filters, predicates, sorting and paging (S, P, O)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators.paging import deep_page
from ..operators.textindex import kept_index
from ..sources.canonical import AS_OF, DAY, HOUR, spread, table
from ..streaming.jobs import shared_folder
from .base import query


@query("projects", "SELECT * FROM projects")
def s01_table_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "projects")


@query("projects", "SELECT id, name, workflow_status FROM projects WHERE id = 77")
def s02_point_lookup(spark, d):
    return table(spark, d, "projects").where("id = 77").select("id", "name", "workflow_status").limit(2)


@query("plans", "SELECT doc_id, seq, unit_type FROM plans WHERE doc_id = 33 AND seq = 1")
def s03_composite_key_lookup(spark, d):
    return table(spark, d, "plans").where((F.col("doc_id") == 33) & (F.col("seq") == 1)).select("doc_id", "seq", "unit_type")


@query("projects approvals", """SELECT p.id, count(a.id) AS n_approvals, coalesce(string_agg(CAST(a.id AS VARCHAR), ',' ORDER BY a.id), '') AS approval_ids FROM projects p LEFT JOIN approvals a ON a.project_id = p.id GROUP BY p.id""")
def s04_eager_children(spark, d):
    """Parents with their children nested: children are grouped before the join, so parents are never multiplied."""
    kids = table(spark, d, "approvals").groupBy("project_id").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    p = table(spark, d, "projects").join(kids, F.col("id") == F.col("project_id"), "left")
    return p.select("id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_approvals"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias("approval_ids"))


@query("lines", "SELECT doc_id, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars FROM lines GROUP BY doc_id")
def s05_page_scan(spark, d):
    return table(spark, d, "lines").groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(F.length("text").cast("long")).alias("chars"))


@query("", "SELECT page_id, starts_with(html, '<!DOC') AS valid_header FROM pages")
def s06_header_validation(spark, d):
    """The first five bytes name the format; here those of a page."""
    return table(spark, d, "pages").select("page_id", (F.substring(F.col("html").cast("binary"), 1, 5) == F.lit("<!DOC").cast("binary")).alias("valid_header"))


@query("images", "SELECT doc_id, phash, min(page_no) AS page_no, min(image_id) AS image_id FROM images WHERE width >= 100 AND height >= 50 AND phash IS NOT NULL GROUP BY doc_id, phash")
def s07_embedded_images(spark, d):
    """First occurrence of an image in a document, small ones left out."""
    i = table(spark, d, "images").where("width >= 100 and height >= 50 and phash is not null")
    return R.latest_per_key(i, ["doc_id", "phash"], F.col("page_no"), F.col("image_id")).select("doc_id", "phash", "page_no", "image_id")


@query("projects", """SELECT id, name, developer, location, emirate, CAST(starting_price AS VARCHAR) AS starting_price, property_type, workflow_status,
       strftime(make_timestamp(created_us), '%Y-%m-%dT%H:%M:%S') AS created_at FROM projects""")
def s16_csv_export(spark, d):
    from ..sources.exports import csv_columns

    return csv_columns(table(spark, d, "projects"))


@query("projects", """SELECT id, concat('{"id":', id, ',"name":"', name, '","workflow_status":"', workflow_status, '"}') AS json FROM projects""")
def s17_json_export(spark, d):
    from ..sources.exports import json_rows

    return json_rows(table(spark, d, "projects").select("id", "name", "workflow_status", "created_by", "last_modified_by"), "id")


@query("images", """, f AS (SELECT 'web' AS tier, 'webp' AS format UNION ALL SELECT 'web', 'jpg' UNION ALL SELECT 'full', 'webp' UNION ALL SELECT 'full', 'jpg')
SELECT image_id, concat(tier, '/', category, '/', image_id, '.', format) AS file FROM images, f WHERE category <> 'other'""")
def s18_manifest(spark, d):
    from ..sources.exports import manifest

    return manifest(table(spark, d, "images").where("category <> 'other'"))


@query("contents", """, r AS (SELECT 'meta_title' AS field, 3 AS row UNION ALL SELECT 'meta_description', 4 UNION ALL SELECT 'url_slug', 5)
SELECT run_id, concat('C', row) AS cell, content FROM contents JOIN r USING (field) WHERE content <> ''""")
def s19_cell_mapping(spark, d):
    from ..sources.exports import cell_values

    registry = spark.createDataFrame([("meta_title", 3), ("meta_description", 4), ("url_slug", 5)], "field string, row int")
    return cell_values(table(spark, d, "contents"), registry, ["run_id"])


@query("", """SELECT conv_id, count(*) AS rows, count(CASE WHEN trim(text) <> '' THEN 1 END) AS used, max(CASE WHEN role = 'assistant' THEN turn END) AS last_column FROM conversations GROUP BY conv_id""")
def s20_sheet_structure(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("rows"), F.count_if(F.trim("text") != "").alias("used"), F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("last_column"))


@query("", """SELECT page_id, regexp_replace(split_part(split_part(url, '//', 2), '?', 1), '[^A-Za-z0-9_.-]', '_', 'g') AS file_name, length(html) <= 4000 AS within_limit FROM pages""")
def s22_upload_validation(spark, d):
    p = table(spark, d, "pages")
    name = F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("?"), F.lit(1))
    return p.select("page_id", F.regexp_replace(name, r"[^A-Za-z0-9_.\-]", "_").alias("file_name"), (F.length("html") <= 4000).alias("within_limit"))


@query("projects", "SELECT id, concat('projects/', id, '/', workflow_status, '/', lower(replace(name, ' ', '-')), '.json') AS path FROM projects")
def s23_path_builder(spark, d):
    return table(spark, d, "projects").select("id", F.concat_ws("/", F.lit("projects"), "id", "workflow_status", F.concat(F.lower(F.replace("name", F.lit(" "), F.lit("-"))), F.lit(".json"))).alias("path"))


@query("projects", "SELECT id, name FROM projects WHERE emirate = 'ASIA' AND workflow_status = 'approved'")
def p01_equality(spark, d):
    return R.optional_filters(table(spark, d, "projects"), emirate="ASIA", workflow_status="approved").select("id", "name")


@query("projects", "SELECT id, starting_price FROM projects WHERE starting_price BETWEEN 100000 AND 200000 AND created_us >= 850000000000000")
def p02_range(spark, d):
    return R.optional_filters(table(spark, d, "projects"), starting_price__min=100000, starting_price__max=200000, created_us__min=850_000_000_000_000).select("id", "starting_price")


@query("users", r"SELECT id, name FROM users WHERE strpos(lower(name), 'r#0000001') > 0")
def p03_escaped_like(spark, d):
    return R.optional_filters(table(spark, d, "users"), name__like="R#0000001").select("id", "name")


@query("projects", "SELECT id FROM projects WHERE location = 'NATION_7'")
def p04_optional_filters(spark, d):
    """Criteria that are absent, and is_active=False, filter nothing."""
    return R.optional_filters(table(spark, d, "projects"), location="NATION_7", developer=None, starting_price__min=None, is_active=False).select("id")


@query("jobs", "SELECT id, status FROM jobs WHERE status IN ('completed', 'failed')")
def p05_in_list(spark, d):
    return R.optional_filters(table(spark, d, "jobs"), status__in=["completed", "failed"]).select("id", "status")


@query("projects", "SELECT id FROM projects WHERE is_active AND last_modified_by IS NOT NULL")
def p06_null_safe_tests(spark, d):
    return table(spark, d, "projects").where(F.col("is_active") & F.col("last_modified_by").isNotNull()).select("id")


_TOKENS = """, w AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(name || ' ' || developer || ' ' || location), '[^a-z0-9]+'), lambda x: x <> '' AND x NOT IN ('a','an','and','are','as','at','be','by','for','from','in','is','it','of','on','or','the','to','with'))) AS t FROM projects),
a AS (SELECT id, t, CASE WHEN length(t) <= 2 THEN t WHEN t LIKE '%sses' THEN t[:-3] WHEN regexp_matches(t, '^.(ies|ied)$') THEN t[:-2] WHEN regexp_matches(t, '(ies|ied)$') THEN t[:-3] WHEN regexp_matches(t, '[aeiouy].+s$') AND NOT regexp_matches(t, '(us|ss)$') THEN t[:-2] ELSE t END AS a FROM w),
b AS (SELECT id, t, a, CASE WHEN length(t) > 2 AND NOT regexp_matches(a, 'eed(ly)?$') AND regexp_matches(a, '[aeiouy].*(ed|edly|ing|ingly)$') THEN regexp_replace(a, '(ed|edly|ing|ingly)$', '') END AS cut FROM a),
c AS (SELECT id, t, CASE WHEN cut IS NOT NULL THEN CASE WHEN regexp_matches(cut, '(at|bl|iz)$') THEN cut || 'e' WHEN regexp_matches(cut, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN cut[:-2] WHEN regexp_matches(cut, '^[^aeiouy]*[aeiouy][^aeiouywx]$') THEN cut || 'e' ELSE cut END WHEN length(t) > 2 AND regexp_matches(a, '[aeiouy][^aeiouy].*eed(ly)?$') THEN regexp_replace(a, 'eed(ly)?$', 'ee') ELSE a END AS c FROM b),
s AS (SELECT id, CASE WHEN length(t) > 2 AND regexp_matches(c, '^.+[^aeiouy]y$') THEN c[:-2] || 'i' ELSE c END AS t FROM c)"""


def _index(spark, d):
    """Posting blocks of the projects' names, makers and places, made once for the files as they are."""
    columns = ["name", "developer", "location"]
    return kept_index(table(spark, d, "projects").select("id", *columns), columns, lambda: shared_folder(spark, "text-index"))


@query("projects", _TOKENS + " SELECT id FROM s WHERE t IN ('tower', 'hill') GROUP BY id HAVING count(DISTINCT t) = 2")
def p07_full_text_match(spark, d):
    return _index(spark, d).search("the towers of hills").select("id")


@query("projects", _TOKENS + " SELECT id, CAST(sum(CASE WHEN t IN ('marina', 'nation', '7') THEN 1 ELSE 0 END) AS BIGINT) AS rank FROM s GROUP BY id HAVING count(DISTINCT CASE WHEN t IN ('marina', 'nation', '7') THEN t END) = 3 ORDER BY 2 DESC, 1 LIMIT 20")
def p08_ranked_search(spark, d):
    return _index(spark, d).search("Marina in NATION 7", 20)


@query("jobs", f"SELECT id FROM jobs WHERE status = 'processing' AND started_us < {AS_OF} - 240 * {HOUR}")
def p09_stale_jobs(spark, d):
    return table(spark, d, "jobs").where((F.col("status") == "processing") & (F.col("started_us") < AS_OF - 240 * HOUR)).select("id")


@query("jobs", f"SELECT id FROM jobs WHERE created_us + 7 * {DAY} > {AS_OF} AND status <> 'cancelled'")
def p10_not_expired(spark, d):
    return table(spark, d, "jobs").where((F.col("created_us") + 7 * DAY > AS_OF) & (F.col("status") != "cancelled")).select("id")


@query("jobs", "SELECT id, coalesce(json_extract_string(result, '$.project_id'), json_extract_string(config, '$.project_id')) AS project FROM jobs")
def p11_json_path(spark, d):
    return table(spark, d, "jobs").select("id", F.coalesce(F.get_json_object("result", "$.project_id"), F.get_json_object("config", "$.project_id")).alias("project"))


@query("contents", "SELECT run_id, field, coalesce(nullif(developer, ''), nullif(location, ''), 'Dubai') AS who FROM contents")
def p12_falsy_chain(spark, d):
    return table(spark, d, "contents").select("run_id", "field", R.falsy_chain(F.col("developer"), F.col("location"), F.lit("Dubai")).alias("who"))


@query("plans", "SELECT doc_id, seq, coalesce(bedrooms BETWEEN 0 AND 10, true) AS bedrooms_ok, coalesce(suite_sqft BETWEEN 50 AND 25000, true) AS suite_ok, coalesce(balcony_sqft BETWEEN 5 AND 10000, true) AS balcony_ok FROM plans")
def p13_plausibility(spark, d):
    from ..functions.units import plausible

    return table(spark, d, "plans").select("doc_id", "seq", plausible("bedrooms").alias("bedrooms_ok"), plausible("suite_sqft").alias("suite_ok"), plausible("balcony_sqft").alias("balcony_ok"))


@query("projects", """SELECT id, 'price_order' AS rule FROM projects WHERE starting_price > 400000 UNION ALL SELECT id, 'property_type' FROM projects WHERE property_type NOT IN ('Villa', 'Apartment')
UNION ALL SELECT id, 'missing_modifier' FROM projects WHERE last_modified_by IS NULL""")
def p14_structural_validation(spark, d):
    rules = {"price_order": F.col("starting_price") <= 400000, "property_type": F.col("property_type").isin("Villa", "Apartment"), "missing_modifier": F.col("last_modified_by").isNotNull()}
    return R.violations(table(spark, d, "projects"), "id", rules)


@query("", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, TRY_CAST(event_type AS BIGINT) AS as_int, nullif(event_type, 'error') AS kind FROM events""")
def p15_type_coercion(spark, d):
    e = table(spark, d, "events").withColumn("p", F.from_json("props", "k bigint"))
    return e.select("event_id", "p.k", F.expr("try_cast(event_type as bigint)").alias("as_int"), F.nullif(F.col("event_type"), F.lit("error")).alias("kind"))


_LEGAL = {
    "draft": ["pending_approval"], "pending_approval": ["approved", "revision_requested", "draft"], "approved": ["publishing", "revision_requested"],
    "revision_requested": ["draft", "pending_approval"], "publishing": ["published"], "published": ["qa_verified"], "qa_verified": ["complete", "revision_requested"], "complete": [],
}


def transitions(spark) -> DataFrame:
    """Which workflow state may follow which (fixed values)."""
    return spark.createDataFrame([(a, b) for a, to in _LEGAL.items() for b in to], "from_state string, to_state string")


_LEGAL_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, to in _LEGAL.items() for b in to) + ") AS legal(from_state, to_state)"


@query("projects", f""", m AS (SELECT created_by, id, lag(workflow_status) OVER (PARTITION BY created_by ORDER BY created_us, id) AS from_state, workflow_status AS to_state FROM projects)
SELECT created_by, id, from_state, to_state FROM m WHERE from_state IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {_LEGAL_SQL} WHERE legal.from_state = m.from_state AND legal.to_state = m.to_state)""")
def p16_transition_violations(spark, d):
    w = Window.partitionBy("created_by").orderBy("created_us", "id")
    m = table(spark, d, "projects").select("created_by", "id", F.lag("workflow_status").over(w).alias("from_state"), F.col("workflow_status").alias("to_state")).where("from_state is not null")
    return m.join(F.broadcast(transitions(spark)), ["from_state", "to_state"], "left_anti").select("created_by", "id", "from_state", "to_state")


@query("lines", "SELECT doc_id, page_no, CASE WHEN length(text) >= 200 THEN 'text' ELSE 'visual' END AS kind FROM lines")
def p17_page_class(spark, d):
    return table(spark, d, "lines").select("doc_id", "page_no", F.when(F.length("text") >= 200, "text").otherwise("visual").alias("kind"))


@query("lines", """SELECT doc_id, CASE WHEN sum(CASE WHEN length(text) >= 200 THEN 1 ELSE 0 END) = 0 THEN 'low' WHEN sum(CASE WHEN length(text) >= 200 THEN 1 ELSE 0 END) * 2 < count(*) THEN 'mixed' ELSE 'high' END AS profile FROM lines GROUP BY doc_id""")
def p18_confidence_profile(spark, d):
    rich = F.count_if(F.length("text") >= 200)
    return table(spark, d, "lines").groupBy("doc_id").agg(F.when(rich == 0, "low").when(rich * 2 < F.count("*"), "mixed").otherwise("high").alias("profile"))


@query("images", "SELECT image_id FROM images WHERE width >= 50 AND height >= 50 AND phash IS NOT NULL")
def p19_image_validity(spark, d):
    return table(spark, d, "images").where("width >= 50 and height >= 50 and phash is not null").select("image_id")


@query("", "SELECT page_id, CASE WHEN starts_with(html, '<!DOCTYPE') THEN 'text/html' WHEN starts_with(html, '%PDF-') THEN 'application/pdf' ELSE 'image/png' END AS media_type FROM pages")
def p20_media_type(spark, d):
    from ..sources.files import media_type

    return table(spark, d, "pages").select("page_id", media_type(F.col("html").cast("binary")).alias("media_type"))


@query("images", "SELECT image_id, category FROM images WHERE category <> 'other'")
def p21_category_retention(spark, d):
    return table(spark, d, "images").where("category <> 'other'").select("image_id", "category")


@query("images", "SELECT image_id, CASE WHEN category = 'logo' AND (1.0 * width / height < 0.9 OR (height > 2000 AND width > 1500) OR width > 2000 OR height > 2000) THEN 'other' ELSE category END AS category FROM images")
def p22_logo_rule(spark, d):
    from ..functions.rules import logo_category

    return table(spark, d, "images").select("image_id", logo_category().alias("category"))


@query("images", """SELECT image_id, CASE WHEN lower(alt_text) LIKE '%tower%' THEN 'tower' WHEN lower(alt_text) LIKE '%site plan%' THEN 'site plan' WHEN lower(alt_text) LIKE '%aerial%' THEN 'aerial' END AS keyword,
CASE WHEN category = 'floor_plan' AND (lower(alt_text) LIKE '%tower%' OR lower(alt_text) LIKE '%site plan%' OR lower(alt_text) LIKE '%aerial%') THEN 'exterior' ELSE category END AS category FROM images""")
def p23_floor_plan_relabel(spark, d):
    from ..functions.rules import building_keyword, relabelled

    return table(spark, d, "images").select("image_id", building_keyword(F.col("alt_text")).alias("keyword"), relabelled().alias("category"))


@query("contents", "SELECT run_id, field, coalesce(char_limit > 300, false) OR regexp_matches(field, 'paragraph|description|about|overview') AS rich FROM contents")
def p24_rich_context(spark, d):
    return table(spark, d, "contents").select("run_id", "field", (F.coalesce(F.col("char_limit") > 300, F.lit(False)) | F.col("field").rlike("paragraph|description|about|overview")).alias("rich"))


@query("images", "SELECT image_id, 'gallery' AS source_table FROM images WHERE image_id IN (3, 9, 27) AND category <> 'floor_plan' UNION ALL SELECT image_id, 'floor_plans' FROM images WHERE image_id IN (3, 9, 27) AND category = 'floor_plan'")
def p25_download_selection(spark, d):
    i = table(spark, d, "images").where(F.col("image_id").isin(3, 9, 27))
    plans = i.where("category = 'floor_plan'").select("image_id", F.lit("floor_plans").alias("source_table"))
    return i.where("category <> 'floor_plan'").select("image_id", F.lit("gallery").alias("source_table")).unionByName(plans)


@query("projects", "SELECT id FROM projects WHERE strpos(lower(name), 'marina') > 0 OR strpos(lower(developer), 'marina') > 0")
def p26_board_search(spark, d):
    has = lambda c: F.coalesce(F.contains(F.lower(c), F.lit("marina")), F.lit(False))
    return table(spark, d, "projects").where(has("name") | has("developer")).select("id")


@query("jobs", "SELECT id, status, row_number() OVER (ORDER BY CASE status WHEN 'failed' THEN 0 WHEN 'processing' THEN 1 ELSE 2 END, created_us, id) AS place FROM jobs WHERE job_type = 'extraction' ORDER BY place LIMIT 50")
def p27_faceted_ordinal_sort(spark, d):
    order = F.when(F.col("status") == "failed", 0).when(F.col("status") == "processing", 1).otherwise(2)
    top = R.optional_filters(table(spark, d, "jobs"), job_type="extraction", status=None).orderBy(order, "created_us", "id").limit(50)
    return top.withColumn("place", F.row_number().over(Window.orderBy(order, "created_us", "id"))).select("id", "status", "place")


@query("plans", "SELECT doc_id FROM plans GROUP BY doc_id HAVING bool_or(unit_type = 'Studio')")
def p28_array_containment(spark, d):
    a = table(spark, d, "plans").groupBy("doc_id").agg(F.collect_set("unit_type").alias("types"))
    return a.where(F.array_contains("types", "Studio")).select("doc_id")


@query("plans", "SELECT doc_id FROM plans GROUP BY doc_id HAVING bool_or(unit_type LIKE '1BR%' AND bedrooms = 1)")
def p29_object_containment(spark, d):
    a = table(spark, d, "plans").groupBy("doc_id").agg(F.collect_list(F.struct("unit_type", "bedrooms")).alias("units"))
    return a.where(F.exists("units", lambda u: F.coalesce(u["unit_type"].startswith("1BR") & (u["bedrooms"] == 1), F.lit(False)))).select("doc_id")


@query("", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '42'")
def p30_json_key_equality(spark, d):
    e = table(spark, d, "events").withColumn("m", F.from_json("props", "map<string,string>"))
    return e.where(F.col("m")["k"] == "42").select("event_id")


@query("runs", "SELECT id, package_id FROM runs WHERE status = 'completed' AND drive_url IS NULL")
def p31_unsynced_runs(spark, d):
    return table(spark, d, "runs").where((F.col("status") == "completed") & F.col("drive_url").isNull()).select("id", "package_id")


@query("images", "SELECT image_id, concat(image_id, '.jpg') AS file FROM images WHERE image_id % 2 = 0 AND category <> 'other'")
def p32_file_filter(spark, d):
    i = table(spark, d, "images").withColumn("path", F.concat(F.when(F.col("image_id") % 2 == 0, "optimized/").otherwise("raw/"), "category", F.lit("/"), "image_id", F.when(F.col("category") == "other", ".txt").otherwise(".jpg")))
    return i.where(F.col("path").startswith("optimized/") & F.col("path").rlike(r"\.(jpg|jpeg|png|webp)$")).select("image_id", F.element_at(F.split("path", "/"), -1).alias("file"))


@query("contents", """, f AS (SELECT run_id, field, run_id % 5 AS row, lag(field) OVER (PARTITION BY run_id, run_id % 5 ORDER BY field) AS held, char_limit FROM contents)
SELECT run_id, field, 'row' AS error FROM f WHERE row < 1 UNION ALL SELECT run_id, field, 'duplicate' FROM f WHERE row >= 1 AND held IS NOT NULL AND strpos(field, 'bullet') = 0 AND strpos(held, 'bullet') = 0 UNION ALL SELECT run_id, field, 'limit' FROM f WHERE char_limit < 55""")
def p33_registry_validation(spark, d):
    """A row number may be shared only with a bullet; each field is held against the latest holder of its row."""
    f = table(spark, d, "contents").withColumn("row", F.col("run_id") % 5)
    f = f.withColumn("held", F.lag("field").over(Window.partitionBy("run_id", "row").orderBy("field")))
    bullet = F.contains("field", F.lit("bullet")) | F.contains("held", F.lit("bullet"))
    errors = F.array(F.when(F.col("row") < 1, F.lit("row")), F.when((F.col("row") >= 1) & F.col("held").isNotNull() & ~bullet, F.lit("duplicate")), F.when(F.col("char_limit") < 55, F.lit("limit")))
    return f.select("run_id", "field", F.explode(F.filter(errors, lambda e: e.isNotNull())).alias("error"))


@query("lines", "SELECT doc_id, count(*) AS rows, count(CASE WHEN trim(text, ' ') = '' THEN 1 END) AS nameless, count(CASE WHEN regexp_matches(text, '<[^>]+>') THEN 1 END) AS html_like FROM lines GROUP BY doc_id")
def p34_sheet_checks(spark, d):
    return table(spark, d, "lines").groupBy("doc_id").agg(F.count("*").alias("rows"), F.count_if(F.trim("text") == "").alias("nameless"), F.count_if(F.col("text").rlike("<[^>]+>")).alias("html_like"))


@query("jobs", """SELECT id, 'progress' AS rule FROM jobs WHERE progress NOT BETWEEN 0 AND 100 UNION ALL SELECT id, 'job_type' FROM jobs WHERE job_type NOT IN ('extraction', 'generation') UNION ALL SELECT id, 'order' FROM jobs WHERE completed_us < started_us""")
def c01_constraint_violations(spark, d):
    rules = {"progress": F.col("progress").between(0, 100), "job_type": F.col("job_type").isin("extraction", "generation"), "order": F.col("completed_us") >= F.col("started_us")}
    return R.violations(table(spark, d, "jobs"), "id", rules)


@query("users", "SELECT id, 'email' AS rule FROM users WHERE NOT regexp_matches(email, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}$') UNION ALL SELECT min(id), 'unique_email' FROM users GROUP BY email HAVING count(*) > 1")
def c02_user_constraints(spark, d):
    u = table(spark, d, "users")
    bad = R.violations(u, "id", {"email": F.col("email").rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$")})
    twice = u.groupBy("email").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n > 1").select("id", F.lit("unique_email").alias("rule"))
    return bad.unionByName(twice)


@query("projects", "SELECT id, created_us FROM projects ORDER BY created_us DESC, id LIMIT 100")
def o01_sort_with_fallback(spark, d):
    return R.page(R.sorted_by(table(spark, d, "projects"), "no_such_column"), 1, 100).select("id", "created_us")


@query("projects", "SELECT id, starting_price FROM projects WHERE is_active ORDER BY starting_price, id LIMIT 50 OFFSET 100")
def o02_offset_page(spark, d):
    return R.page(R.sorted_by(R.optional_filters(table(spark, d, "projects"), is_active=True), "starting_price", descending=False), 3, 50).select("id", "starting_price")


@query("projects", "SELECT id, starting_price FROM projects ORDER BY starting_price DESC, id LIMIT 50 OFFSET 950")
def o02_deep_page(spark, d):
    """A page far down: bounds and counts of ranges first, then only the range that holds the page is sorted."""
    return deep_page(table(spark, d, "projects").select("id", "starting_price"), "starting_price", True, 20, 50)


@query("projects", "SELECT count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages, 3 < ceil(count(*) / 50.0) AS has_next, true AS has_prev FROM projects WHERE is_active")
def o03_page_metadata(spark, d):
    return R.page_metadata(R.optional_filters(table(spark, d, "projects"), is_active=True), 3, 50)


@query("jobs", "SELECT id, created_us FROM jobs ORDER BY created_us DESC, id DESC LIMIT 10")
def o04_top_newest(spark, d):
    return table(spark, d, "jobs").orderBy(F.desc("created_us"), F.desc("id")).limit(10).select("id", "created_us")


@query("contents", "SELECT run_id, field, row_number() OVER (PARTITION BY run_id ORDER BY char_limit NULLS FIRST, field) AS place FROM contents")
def o05_multi_key_sort(spark, d):
    w = Window.partitionBy("run_id").orderBy(F.col("char_limit").asc_nulls_first(), "field")
    return table(spark, d, "contents").select("run_id", "field", F.row_number().over(w).alias("place"))


@query("approvals jobs", """, a AS (SELECT 'approval' AS kind, id, created_us FROM approvals ORDER BY created_us DESC, id LIMIT 30), j AS (SELECT 'job' AS kind, id, created_us FROM jobs ORDER BY created_us DESC, id LIMIT 30)
SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM j) ORDER BY created_us DESC, kind, id LIMIT 30 OFFSET 30""")
def o06_merged_feed(spark, d):
    """Each source gives its newest rows only, so later pages run out: the second is partial, a third is empty."""
    from ..operators.feeds import merged_feed

    a = table(spark, d, "approvals").select(F.lit("approval").alias("kind"), "id", "created_us")
    j = table(spark, d, "jobs").select(F.lit("job").alias("kind"), "id", "created_us")
    return merged_feed([a, j], "created_us", ["kind", "id"], number=2, size=30)


@query("plans", "SELECT doc_id, string_agg(DISTINCT CASE WHEN bedrooms = 0 THEN 'Studio' ELSE concat(bedrooms, 'BR') END, ',' ORDER BY CASE WHEN bedrooms = 0 THEN 'Studio' ELSE concat(bedrooms, 'BR') END) AS unordered, count(DISTINCT bedrooms) AS n FROM plans GROUP BY doc_id")
def o07_bedroom_order(spark, d):
    from ..functions.text import bedroom_order

    label = F.when(F.col("bedrooms") == 0, "Studio").otherwise(F.concat(F.col("bedrooms").cast("string"), F.lit("BR")))
    g = table(spark, d, "plans").groupBy("doc_id").agg(F.collect_set(label).alias("labels"))
    # the custom order puts Studio first; the comparison is by plain order
    return g.select("doc_id", F.array_join(F.array_sort(bedroom_order(F.col("labels"))), ",").alias("unordered"), F.size("labels").cast("long").alias("n"))


@query("lines", "SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_no) AS text FROM lines GROUP BY doc_id")
def o08_pages_joined(spark, d):
    from ..operators.pages import joined_pages

    return joined_pages(table(spark, d, "lines"), "\n\n")


@query("jobs", "SELECT id, row_number() OVER (ORDER BY created_us, id) - 1 AS seq FROM jobs")
def o10_explicit_order(spark, d):
    from ..operators.feeds import numbered

    return numbered(table(spark, d, "jobs").select("id", "created_us"), ["created_us", "id"]).select("id", "seq")




@query("projects", "SELECT id, name, location FROM projects ORDER BY location DESC, id LIMIT 20 OFFSET 40")
def o09_table_page(spark, d):
    """Any listed column, any of the page sizes."""
    return R.table_page(table(spark, d, "projects"), "location", True, 3, 20).select("id", "name", "location")


def _raw_tables(spark, d):
    """Tables as they are read from pages: floor plans, payment plans and others, with blank and short rows."""
    i, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    a = lambda *x: F.array(*(F.lit(v) if isinstance(v, str) else v for v in x))
    headers = F.when(i == 0, a("Type", "Bedrooms", "Suite (sqft)")).when(i == 1, a("Milestone", "Percentage", "Due")).when(i == 2, a("Column A", "Column B", "Column C")).when(i == 3, a("Name", "Area", "Note")).otherwise(a("Unit Type", "Total area (sqm)", "Area"))
    home = a(F.concat(size, F.lit("BR")), size, F.concat(F.lit(" 1,"), F.lpad(size, 3, "0")))
    paid = [a("On Booking", F.concat(size, F.lit("%")), ""), a("Handover", "40%", "x"), a("At completion", F.concat(size, F.lit(" %")), "x"), a("Post Handover")]
    rows = F.when(i == 1, F.array(*paid)).otherwise(F.array(home, a("", " ", "\t")))
    cells = F.when(F.col("p_partkey") % 7 == 0, F.array(headers)).otherwise(F.concat(F.array(headers), rows))
    return spread(table(spark, d, "part"), "p_partkey").select(F.floor(F.col("p_partkey") / 10).alias("doc_id"), (F.col("p_partkey") % 10).cast("int").alias("page_no"), F.lit(0).alias("table_no"), cells.alias("cells"))


_TABLES = """SELECT p_partkey // 10 AS doc_id, count(*) AS tables, count(CASE WHEN p_partkey % 5 IN (0, 3, 4) THEN 1 END) AS plans, round(coalesce(sum(CASE p_partkey % 5 WHEN 3 THEN p_size WHEN 4 THEN round_even(p_size * 10.764, 1) END), 0)::DOUBLE, 6) AS total,
coalesce(sum(CASE WHEN p_partkey % 5 = 0 THEN 1000 + p_size END), 0)::DOUBLE AS suite, arg_min(concat(p_size, '%'), p_partkey) FILTER (p_partkey % 5 = 1) AS down, arg_min(concat(p_size, ' %'), p_partkey) FILTER (p_partkey % 5 = 1) AS on_handover FROM part WHERE p_partkey % 7 <> 0 GROUP BY 1"""


@query("", _TABLES)
def s08_table_scan(spark, d):
    from ..operators.tables import document_tables

    return _table_sums(document_tables(_raw_tables(spark, d)))


def _table_sums(t):
    sums = lambda k: F.round(F.aggregate("floor_plans", F.lit(0.0), lambda s, m: s + F.coalesce(m[k].cast("double"), F.lit(0.0))), 6)
    return t.select("doc_id", "tables", F.size("floor_plans").cast("long").alias("plans"), sums("total_sqft").alias("total"), sums("suite_sqft").alias("suite"), F.col("payment_plan")["down_payment"].alias("down"), F.col("payment_plan")["on_handover"].alias("on_handover"))


@query("", _TABLES)
def s08_table_function(spark, d):
    """The same by a table function that sees a document's pages in order."""
    from ..operators.tablescan import scanned_tables

    return _table_sums(scanned_tables(_raw_tables(spark, d)))


@query("projects", "SELECT id, name, location AS city, workflow_status AS status FROM projects")
def s09_packages(spark, d):
    """Packages written as JSON (S10) and read again under their schema."""
    from ..sources.exports import write_packages
    from ..sources.files import packages
    from ..streaming.jobs import shared_folder

    path = shared_folder(spark, "packages")
    p = table(spark, d, "projects").select("id", F.struct("name", F.create_map(F.lit("city"), "location", F.lit("status"), "workflow_status").alias("facts")).alias("project"))
    write_packages(p, path)
    return packages(spark, path, p.schema, lines=True).select("id", "project.name", F.col("project.facts")["city"].alias("city"), F.col("project.facts")["status"].alias("status"))


@query()
def s11_file_listing(spark, d):
    """The tables' files with their sizes; contents aren't read. No SQL: a listing is no table."""
    from ..sources.files import listing

    return listing(spark, d, "*.parquet").select(F.regexp_extract("path", r"([^/]+\.parquet)", 1).alias("file"), "length")


@query()
def s12_file_metadata(spark, d):
    """Whether given files exist, and their sizes: one row for each that is asked for."""
    from ..sources.files import listing

    asked = spark.createDataFrame([("events.parquet",), ("missing.parquet",)], "file string")
    found = listing(spark, d, "*.parquet").groupBy(F.regexp_extract("path", r"([^/]+\.parquet)", 1).alias("file")).agg(F.sum("length").alias("length"))
    return asked.join(found, "file", "left").select("file", F.col("length").isNotNull().alias("is_there"), "length")


@query("files", "SELECT file_id, name FROM files WHERE contains(name, 'r''s bro') AND NOT trashed AND folder = 'f3' UNION ALL SELECT file_id, name FROM files WHERE name = '100% logo 20.png' AND NOT trashed")
def s14_files_by_name(spark, d):
    """Names that hold a text in a folder, and one exact name anywhere."""
    from ..operators.listings import files_named

    f = table(spark, d, "files")
    return files_named(f, "r's bro", "f3").unionByName(files_named(f, "100% logo 20.png", exact=True)).select("file_id", "name")


@query("files", "SELECT file_id, name FROM files WHERE mime = 'image/png' AND NOT trashed AND folder = 'f5'")
def s15_files_by_type(spark, d):
    from ..operators.listings import files_of_type

    return files_of_type(table(spark, d, "files"), "image/png", "f5").select("file_id", "name")


@query("", """SELECT concat('reg', p_partkey) AS file, x.section, x.field, (p_partkey % 90 + x.add)::INT AS row, CASE WHEN x.capped THEN p_size END::INT AS char_limit, x.required
FROM part, (VALUES ('Head', 'title', 0, true, true), ('Head', 'body', 1, false, false), ('Tail', 'slug', 2, true, true)) x(section, field, add, capped, required)""")
def s21_markdown_registry(spark, d):
    """Registry tables in Markdown texts, one for each part."""
    from ..sources.files import registry_rows

    row, limit = (lambda add: (F.col("p_partkey") % 90 + add).cast("string")), F.col("p_size").cast("string")
    lines = [
        F.lit("# Registry"), F.lit("## Head"), F.lit(""), F.lit("| Field | Row | Limit | Required |"), F.lit("|---|:--|--:|---|"),
        F.concat(F.lit("| title | "), row(0), F.lit(" | "), limit, F.lit(" | Yes |")), F.concat(F.lit("| body | "), row(1), F.lit(" | - | no |")), F.lit("| no row | x | 1 | yes |"),
        F.lit("## Tail"), F.lit("plain text"), F.lit("| Field | Row | Limit | Required |"), F.lit("|---|---|---|---|"), F.concat(F.lit("| slug | "), row(2), F.lit(" | "), limit, F.lit(" | 1 |")),
    ]
    texts = table(spark, d, "part").select(F.concat(F.lit("reg"), F.col("p_partkey").cast("string")).alias("file"), F.concat_ws("\n", *lines).alias("text"))
    return registry_rows(texts)
