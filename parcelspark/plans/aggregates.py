"""Aggregations and windows (A, W); the flagship statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources.canonical import AS_OF, DAY, HOUR, JOB_STATES, WORKFLOW, table
from .base import query

_DOMAIN = "(VALUES " + ", ".join(f"('{w}')" for w in WORKFLOW) + ") w(workflow_status)"


@query("projects users", f"""SELECT w.workflow_status, count(p.id) AS projects, CAST(coalesce(sum(p.starting_price), 0) AS DECIMAL(25,2)) AS value, count(DISTINCT u.emirate) AS emirates, coalesce(round(avg(CASE WHEN p.workflow_status = 'complete' THEN (p.updated_us - p.created_us) / 3.6e9 END), 1), 0.0) AS avg_hours
FROM {_DOMAIN} LEFT JOIN (SELECT * FROM projects WHERE is_active) p ON p.workflow_status = w.workflow_status LEFT JOIN users u ON u.id = p.created_by GROUP BY w.workflow_status""")
def workflow_statistics(spark, d):
    """Active projects of each workflow state: number, value, creators' emirates, and hours to completion."""
    p = table(spark, d, "projects").where("is_active").select("id", "workflow_status", "starting_price", "created_by", "created_us", "updated_us")
    u = table(spark, d, "users").select(F.col("id").alias("created_by"), "emirate")
    done = F.when(F.col("workflow_status") == "complete", (F.col("updated_us") - F.col("created_us")) / 3.6e9)
    g = p.join(u, "created_by", "left").groupBy("workflow_status").agg(F.count("id").alias("projects"), F.sum("starting_price").alias("value"), F.count_distinct("emirate").alias("emirates"), F.round(F.avg(done), 1).alias("avg_hours"))
    domain = spark.createDataFrame([(w,) for w in WORKFLOW], "workflow_status string")
    j = domain.join(g, "workflow_status", "left")
    return j.select("workflow_status", F.coalesce("projects", F.lit(0)).alias("projects"), F.coalesce("value", F.lit(0)).cast("decimal(25,2)").alias("value"), F.coalesce("emirates", F.lit(0)).alias("emirates"), F.coalesce("avg_hours", F.lit(0.0)).alias("avg_hours"))


@query("projects", "SELECT count(*) AS total FROM projects WHERE is_active AND starting_price >= 100000")
def a01_count_filtered(spark, d):
    return R.optional_filters(table(spark, d, "projects"), is_active=True, starting_price__min=100000).agg(F.count("*").alias("total"))


@query("projects", "SELECT workflow_status, count(*) AS n FROM projects WHERE is_active GROUP BY workflow_status")
def a02_group_count(spark, d):
    return table(spark, d, "projects").where("is_active").groupBy("workflow_status").agg(F.count("*").alias("n"))


@query("jobs", "SELECT user_id, " + ", ".join(f"count(CASE WHEN status = '{s}' THEN 1 END) AS {s}" for s in JOB_STATES) + ", count(*) AS total FROM jobs GROUP BY user_id")
def a03_pivoted_counts(spark, d):
    return table(spark, d, "jobs").groupBy("user_id").agg(*(F.count_if(F.col("status") == s).alias(s) for s in JOB_STATES), F.count("*").alias("total"))


@query("projects", f"SELECT w.workflow_status, count(p.id) AS n FROM {_DOMAIN} LEFT JOIN (SELECT * FROM projects WHERE emirate = 'ASIA' AND template_type = 'opr') p USING (workflow_status) GROUP BY 1")
def a04_zero_filled_counts(spark, d):
    return R.counts_over(table(spark, d, "projects").where("emirate = 'ASIA' and template_type = 'opr'"), "workflow_status", WORKFLOW)


@query("jobs", f"SELECT user_id, count(*) AS n FROM jobs WHERE status = 'failed' AND created_us >= {AS_OF} - 10 * {DAY} GROUP BY user_id")
def a05_filtered_count(spark, d):
    return table(spark, d, "jobs").where((F.col("status") == "failed") & (F.col("created_us") >= AS_OF - 10 * DAY)).groupBy("user_id").agg(F.count("*").alias("n"))


@query("projects", "SELECT emirate, coalesce(round(avg((updated_us - created_us) / 3.6e9), 1), 0.0) AS avg_hours FROM projects WHERE workflow_status = 'complete' GROUP BY emirate")
def a06_average_hours(spark, d):
    h = (F.col("updated_us") - F.col("created_us")) / 3.6e9
    return table(spark, d, "projects").where("workflow_status = 'complete'").groupBy("emirate").agg(F.coalesce(F.round(F.avg(h), 1), F.lit(0.0)).alias("avg_hours"))


@query("projects jobs", """SELECT total, active, completed, pending, failed_jobs FROM (SELECT count(*) AS total, count(CASE WHEN workflow_status IN ('draft', 'pending_approval', 'approved', 'revision_requested', 'publishing') THEN 1 END) AS active, count(CASE WHEN workflow_status IN ('published', 'complete') THEN 1 END) AS completed,
count(CASE WHEN workflow_status = 'pending_approval' THEN 1 END) AS pending FROM projects WHERE is_active), (SELECT count(*) AS failed_jobs FROM jobs WHERE status = 'failed')""")
def a07_dashboard(spark, d):
    s = F.col("workflow_status")
    p = table(spark, d, "projects").where("is_active").agg(
        F.count("*").alias("total"), F.count_if(s.isin("draft", "pending_approval", "approved", "revision_requested", "publishing")).alias("active"),
        F.count_if(s.isin("published", "complete")).alias("completed"), F.count_if(s == "pending_approval").alias("pending"),
    )
    j = table(spark, d, "jobs").agg(F.count_if(F.col("status") == "failed").alias("failed_jobs"))
    return p.join(F.broadcast(j), F.lit(True))  # one row each


@query("users jobs projects", f"SELECT (SELECT count(*) FROM users) AS users, (SELECT count(*) FROM jobs WHERE status IN ('pending', 'processing')) AS active_jobs, (SELECT count(*) FROM jobs WHERE status = 'failed' AND created_us >= {AS_OF} - 2 * {DAY}) AS failed_recently, (SELECT count(*) FROM projects) AS projects")
def a08_admin_statistics(spark, d):
    j = table(spark, d, "jobs").agg(F.count_if(F.col("status").isin("pending", "processing")).alias("active_jobs"), F.count_if((F.col("status") == "failed") & (F.col("created_us") >= AS_OF - 2 * DAY)).alias("failed_recently"))
    u, p = table(spark, d, "users").agg(F.count("*").alias("users")), table(spark, d, "projects").agg(F.count("*").alias("projects"))
    return u.join(F.broadcast(j), F.lit(True)).join(F.broadcast(p), F.lit(True))


@query("projects", "SELECT created_by, workflow_status, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY updated_us DESC, id) AS ids FROM projects GROUP BY created_by, workflow_status")
def a09_board_lists(spark, d):
    g = table(spark, d, "projects").groupBy("created_by", "workflow_status").agg(F.array_sort(F.collect_list(F.struct((-F.col("updated_us")).alias("t"), "id"))).alias("x"))
    return g.select("created_by", "workflow_status", F.size("x").cast("long").alias("n"), F.array_join(F.col("x.id").cast("array<string>"), ",").alias("ids"))


@query("projects", "SELECT CASE WHEN workflow_status IN ('draft', 'revision_requested') THEN 'draft' WHEN workflow_status IN ('pending_approval', 'approved') THEN 'review' ELSE 'live' END AS board, count(*) AS n, max(updated_us) AS newest FROM projects GROUP BY 1")
def a10_board_columns(spark, d):
    s = F.col("workflow_status")
    board = F.when(s.isin("draft", "revision_requested"), "draft").when(s.isin("pending_approval", "approved"), "review").otherwise("live")
    return table(spark, d, "projects").groupBy(board.alias("board")).agg(F.count("*").alias("n"), F.max("updated_us").alias("newest"))


@query("projects users", "SELECT p.id, coalesce(u.name, 'Unknown') AS submitted_by, CASE workflow_status WHEN 'approved' THEN 'approved' WHEN 'revision_requested' THEN 'rejected' ELSE 'pending' END AS status FROM projects p LEFT JOIN users u ON u.id = p.created_by AND u.is_active")
def a11_approval_mapping(spark, d):
    u = table(spark, d, "users").where("is_active").select(F.col("id").alias("created_by"), F.col("name").alias("who"))
    s = F.when(F.col("workflow_status") == "approved", "approved").when(F.col("workflow_status") == "revision_requested", "rejected").otherwise("pending")
    return table(spark, d, "projects").join(u, "created_by", "left").select("id", F.coalesce("who", F.lit("Unknown")).alias("submitted_by"), s.alias("status"))


@query("plans", "SELECT doc_id, min(CASE WHEN total_sqft > 0 THEN total_sqft END) AS low, max(CASE WHEN total_sqft > 0 THEN total_sqft END) AS high FROM plans GROUP BY doc_id")
def a13_area_range(spark, d):
    t = F.when(F.col("total_sqft") > 0, F.col("total_sqft"))
    return table(spark, d, "plans").groupBy("doc_id").agg(F.min(t).alias("low"), F.max(t).alias("high"))


@query("plans", "SELECT doc_id, count(*) AS n, count(DISTINCT unit_type) AS types, count(DISTINCT bedrooms) AS bedrooms, string_agg(DISTINCT CAST(bedrooms AS VARCHAR), ',' ORDER BY CAST(bedrooms AS VARCHAR)) AS list FROM plans GROUP BY doc_id")
def a14_plan_summary(spark, d):
    g = table(spark, d, "plans").groupBy("doc_id").agg(F.count("*").alias("n"), F.collect_set("unit_type").alias("t"), F.collect_set(F.col("bedrooms").cast("string")).alias("b"))
    return g.select("doc_id", "n", F.size("t").cast("long").alias("types"), F.size("b").cast("long").alias("bedrooms"), F.array_join(F.array_sort("b"), ",").alias("list"))


@query("images", """, f AS (SELECT doc_id, category, alt_text, min(seq) AS first FROM images GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY first) AS place FROM f)
SELECT doc_id, category, string_agg(alt_text, '|' ORDER BY place) AS alts FROM k WHERE place <= 5 GROUP BY doc_id, category""")
def a15_manifest_summary(spark, d):
    """The first five distinct alt texts of each category, in order."""
    first = table(spark, d, "images").groupBy("doc_id", "category", "alt_text").agg(F.min("seq").alias("first"))
    g = first.groupBy("doc_id", "category").agg(F.array_sort(F.collect_list(F.struct("first", "alt_text")))["alt_text"].alias("alts"))
    return g.select("doc_id", "category", F.array_join(F.slice("alts", 1, 5), "|").alias("alts"))


@query("plans", "SELECT doc_id, seq, (unit_type IS NOT NULL)::INT + (bathrooms IS NOT NULL)::INT + (suite_sqft IS NOT NULL)::INT + (balcony_sqft IS NOT NULL)::INT + (total_sqft IS NOT NULL)::INT AS filled FROM plans")
def a16_non_null_fields(spark, d):
    n = sum(F.col(c).isNotNull().cast("int") for c in ("unit_type", "bathrooms", "suite_sqft", "balcony_sqft", "total_sqft"))
    return table(spark, d, "plans").select("doc_id", "seq", n.alias("filled"))


@query("images", "SELECT doc_id, alt_text AS name FROM (SELECT doc_id, alt_text, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(seq)) AS place FROM images GROUP BY doc_id, alt_text) WHERE place = 1")
def a17_mode_first_seen(spark, d):
    g = table(spark, d, "images").groupBy("doc_id", "alt_text").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return g.groupBy("doc_id").agg(F.max_by("alt_text", F.struct("n", -F.col("first"))).alias("name"))


@query("jobs", "SELECT project_id, CAST(round(0.6 * coalesce(max(CASE WHEN job_type = 'extraction' THEN progress END), 0) + 0.4 * coalesce(avg(CASE WHEN job_type = 'generation' THEN progress END), 0), 4) AS DOUBLE) AS progress FROM jobs GROUP BY project_id")
def a18_weighted_progress(spark, d):
    of = lambda t: F.when(F.col("job_type") == t, F.col("progress"))
    x = 0.6 * F.coalesce(F.max(of("extraction")), F.lit(0)) + 0.4 * F.coalesce(F.avg(of("generation")), F.lit(0.0))
    return table(spark, d, "jobs").groupBy("project_id").agg(F.round(x, 4).alias("progress"))


@query("jobs", "SELECT project_id, least(count(CASE WHEN status = 'completed' THEN 1 END) * 100 // count(*) + 1, CASE WHEN bool_and(status = 'completed') THEN 100 ELSE 99 END) AS progress FROM jobs GROUP BY project_id")
def a19_step_progress(spark, d):
    done = F.count_if(F.col("status") == "completed")
    x = F.least(F.floor(done * 100 / F.count("*")) + 1, F.when(F.bool_and(F.col("status") == "completed"), 100).otherwise(99).cast("long"))
    return table(spark, d, "jobs").groupBy("project_id").agg(x.alias("progress"))


@query("contents", "SELECT run_id, CAST(sum(length(content)) AS BIGINT) AS chars, CAST(sum(CAST(length(content) // 4 AS BIGINT) * 3 + 15 * CAST(char_limit AS BIGINT)) / 1000000.0 AS DECIMAL(18,6)) AS cost FROM contents WHERE char_limit IS NOT NULL GROUP BY run_id")
def a20_token_cost(spark, d):
    from ..functions.formats import token_cost, token_estimate

    c = table(spark, d, "contents").where("char_limit is not null")
    return c.groupBy("run_id").agg(F.sum(F.length("content").cast("long")).alias("chars"), F.sum(token_cost(token_estimate(F.col("content")), F.col("char_limit"))).cast("decimal(18,6)").alias("cost"))


@query("runs", "SELECT project_id, bool_and(is_approved) AS all_approved, bool_or(is_approved) AS any_approved, max(completed_us) AS latest FROM runs GROUP BY project_id")
def a21_approval_state(spark, d):
    return table(spark, d, "runs").groupBy("project_id").agg(F.bool_and("is_approved").alias("all_approved"), F.bool_or("is_approved").alias("any_approved"), F.max("completed_us").alias("latest"))


_CHECKS = """, e AS (SELECT doc_id, unit_type, min(row_no) AS row_no, arg_min_null(total_sqft, row_no) AS want, arg_min_null(bedrooms, row_no) AS beds FROM specs WHERE unit_type IS NOT NULL GROUP BY doc_id, unit_type),
k AS (SELECT p.doc_id, p.seq, e.row_no, CASE WHEN e.row_no IS NULL THEN 'missing' WHEN e.want IS NULL OR e.want <= 0 THEN 'skip' WHEN p.total_sqft IS NULL THEN 'null' WHEN abs(p.total_sqft - e.want) / e.want < 0.02 THEN 'pass' ELSE 'fail' END AS area, p.bedrooms = e.beds AS beds_ok FROM plans p LEFT JOIN e ON p.doc_id = e.doc_id AND p.unit_type = e.unit_type),
c AS (SELECT doc_id, count(*) AS plans, count(row_no) AS matched, count(CASE WHEN area = 'pass' THEN 1 END) AS area_pass, count(CASE WHEN area = 'fail' THEN 1 END) AS area_fail, count(CASE WHEN area = 'null' THEN 1 END) AS area_null, count(CASE WHEN NOT beds_ok THEN 1 END) AS bed_fail FROM k GROUP BY doc_id)"""


@query("plans specs", _CHECKS + " SELECT *, area_fail + bed_fail AS false_data FROM c")
def a23_scorecard(spark, d):
    from ..operators.scorecard import scorecard

    return scorecard(table(spark, d, "plans"), table(spark, d, "specs"))


@query("plans specs", _CHECKS + " SELECT CAST(sum(plans) AS BIGINT) AS plans, CAST(sum(area_pass) AS BIGINT) AS area_pass, CAST(sum(area_fail) AS BIGINT) AS area_fail, CAST(sum(area_null) AS BIGINT) AS area_null, round(100.0 * sum(area_fail) / sum(area_pass + area_fail + area_null), 1) AS false_rate FROM c")
def a24_corpus_scorecard(spark, d):
    from ..operators.scorecard import corpus_scorecard, scorecard

    return corpus_scorecard(scorecard(table(spark, d, "plans"), table(spark, d, "specs")))


@query("contents", "SELECT field, count(*) AS defined, count(CASE WHEN char_limit IS NOT NULL THEN 1 END) AS promptable FROM contents GROUP BY ROLLUP(field)")
def a25_prompt_coverage(spark, d):
    """Each section and the total in one pass."""
    return table(spark, d, "contents").rollup("field").agg(F.count("*").alias("defined"), F.count_if(F.col("char_limit").isNotNull()).alias("promptable"))


@query("contents", "SELECT run_id, count(CASE WHEN trim(content) = trim(replace(content, 'Dubai', 'dubai')) THEN 1 END) AS matches, count(CASE WHEN trim(content) <> trim(replace(content, 'Dubai', 'dubai')) THEN 1 END) AS mismatches FROM contents GROUP BY run_id")
def a27_read_back(spark, d):
    c = table(spark, d, "contents")
    back = c.select("run_id", "field", F.replace("content", F.lit("Dubai"), F.lit("dubai")).alias("read"))
    same = F.trim("content") == F.trim("read")
    return c.join(back, ["run_id", "field"]).groupBy("run_id").agg(F.count_if(same).alias("matches"), F.count_if(~same).alias("mismatches"))


@query("jobs", "SELECT job_type, status, count(*) AS n FROM jobs GROUP BY GROUPING SETS ((job_type), (status))")
def a28_facet_counts(spark, d):
    """Grouping sets: both facets in one pass over the rows."""
    return table(spark, d, "jobs").groupingSets([["job_type"], ["status"]], "job_type", "status").agg(F.count("*").alias("n"))


@query("jobs", f"SELECT count(*) AS deleted FROM jobs WHERE status IN ('completed', 'failed') AND completed_us < {AS_OF} - 20 * {DAY}")
def a29_affected_rows(spark, d):
    return table(spark, d, "jobs").where(F.col("status").isin("completed", "failed") & (F.col("completed_us") < AS_OF - 20 * DAY)).agg(F.count("*").alias("deleted"))


@query("images", """, r AS (SELECT *, least(1.0::DOUBLE, 1200::DOUBLE / width, 800::DOUBLE / height) AS r FROM images)
SELECT category, CAST(sum(width * height) AS BIGINT) AS before, CAST(sum(CAST(trunc(width * r) AS BIGINT) * CAST(trunc(height * r) AS BIGINT)) AS BIGINT) AS after FROM r GROUP BY category""")
def a30_bytes_saved(spark, d):
    from ..functions.units import fitted

    f = fitted(F.col("width"), F.col("height"), 1200, 800)
    return table(spark, d, "images").groupBy("category").agg(F.sum(F.col("width") * F.col("height")).alias("before"), F.sum((f["width"] * f["height"]).cast("long")).alias("after"))


@query("approvals", "SELECT user_id, count(CASE WHEN id % 3 <> 0 THEN 1 END) AS unread FROM approvals GROUP BY user_id")
def a31_unread(spark, d):
    return table(spark, d, "approvals").groupBy("user_id").agg(F.count_if(F.col("id") % 3 != 0).alias("unread"))


@query("jobs", f"SELECT template_type, round(100.0 * sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) / count(*), 2) AS rate FROM jobs WHERE created_us >= {AS_OF} - 7 * {DAY} GROUP BY template_type")
def a32_success_rate(spark, d):
    return table(spark, d, "jobs").where(F.col("created_us") >= AS_OF - 7 * DAY).groupBy("template_type").agg(F.round(100.0 * F.count_if(F.col("status") == "completed") / F.count("*"), 2).alias("rate"))


@query("jobs", "SELECT job_type, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY value), 4) AS p95 FROM jobs GROUP BY job_type")
def a33_percentile(spark, d):
    return table(spark, d, "jobs").groupBy("job_type").agg(F.round(F.expr("percentile_cont(0.95) within group (order by value)"), 4).alias("p95"))


@query("jobs", "SELECT user_id, count(*) AS failures, string_agg(DISTINCT template_type, ',' ORDER BY template_type) AS templates FROM jobs WHERE status = 'failed' GROUP BY user_id ORDER BY failures DESC, user_id LIMIT 10")
def a34_top_failures(spark, d):
    g = table(spark, d, "jobs").where("status = 'failed'").groupBy("user_id").agg(F.count("*").alias("failures"), F.array_join(F.array_sort(F.collect_set("template_type")), ",").alias("templates"))
    return g.orderBy(F.desc("failures"), "user_id").limit(10)


@query("projects", "SELECT strftime(date_trunc('week', make_timestamp(created_us)), '%Y-%m-%d') AS week, count(*) AS n, round(avg((updated_us - created_us) / 3.6e9), 2) AS hours FROM projects GROUP BY 1")
def a35_weekly_buckets(spark, d):
    """Weeks begin on Monday; from whole days since 1970-01-01, a Thursday, so that no time zone matters."""
    days = F.floor(F.col("created_us") / DAY)
    monday = F.date_add(F.lit("1970-01-01").cast("date"), (days - F.pmod(days + 3, F.lit(7))).cast("int"))
    return table(spark, d, "projects").groupBy(monday.cast("string").alias("week")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("updated_us") - F.col("created_us")) / 3.6e9), 2).alias("hours"))


@query("runs", "SELECT project_id, id FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY completed_us DESC, id DESC) AS n FROM runs WHERE status = 'completed') WHERE n = 1")
def w01_latest_per_key(spark, d):
    return R.latest_per_key(table(spark, d, "runs").where("status = 'completed'"), ["project_id"], F.desc("completed_us"), F.desc("id")).select("project_id", "id")


@query("runs", "SELECT project_id, template_type, id FROM (SELECT *, row_number() OVER (PARTITION BY project_id, template_type ORDER BY completed_us DESC, id DESC) AS n FROM runs) WHERE n = 1")
def w02_latest_of_pair(spark, d):
    return R.latest_per_key(table(spark, d, "runs"), ["project_id", "template_type"], F.desc("completed_us"), F.desc("id")).select("project_id", "template_type", "id")


@query("projects runs", "SELECT p.id, r.drive_url FROM projects p LEFT JOIN (SELECT project_id, max_by(coalesce(drive_url, ''), completed_us) AS drive_url FROM runs WHERE status = 'completed' GROUP BY project_id) r ON r.project_id = p.id")
def w03_back_fill(spark, d):
    """Of runs that were completed at the same time, the first by id, as max_by in the SQL keeps the first it meets."""
    latest = F.struct("completed_us", (-F.col("id")).alias("before"))
    r = table(spark, d, "runs").where("status = 'completed'").groupBy("project_id").agg(F.max_by(F.coalesce("drive_url", F.lit("")), latest).alias("drive_url"))
    return table(spark, d, "projects").join(r, F.col("id") == F.col("project_id"), "left").select("id", "drive_url")


@query("images", "SELECT doc_id, image_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN category = 'exterior' THEN 0 ELSE 1 END, seq) AS n FROM images) WHERE n = 1")
def w04_preferred_first(spark, d):
    return R.latest_per_key(table(spark, d, "images"), ["doc_id"], F.when(F.col("category") == "exterior", 0).otherwise(1), F.col("seq")).select("doc_id", "image_id")


@query("images", "SELECT image_id, concat(lpad(CAST(row_number() OVER (PARTITION BY doc_id, category ORDER BY seq) AS VARCHAR), 3, '0'), '-', category) AS name FROM images")
def w05_category_counter(spark, d):
    n = F.row_number().over(Window.partitionBy("doc_id", "category").orderBy("seq")).cast("string")
    return table(spark, d, "images").select("image_id", F.concat(F.lpad(n, 3, "0"), F.lit("-"), "category").alias("name"))


@query("images", """, u AS (SELECT doc_id, phash, min(seq) AS seq, min_by(image_id, seq) AS image_id FROM images WHERE category <> 'other' AND phash IS NOT NULL GROUP BY doc_id, phash) SELECT image_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS display_order FROM u""")
def w06_display_order(spark, d):
    i = R.latest_per_key(table(spark, d, "images").where("category <> 'other' and phash is not null"), ["doc_id", "phash"], F.col("seq"))
    return i.select("image_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) - 1).alias("display_order"))


@query("contents", ", v AS (SELECT run_id % 50 AS prompt_id, field, run_id FROM contents) SELECT prompt_id, field, count(*) AS versions, max(row) + 1 AS next_version FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id, field ORDER BY run_id) AS row FROM v) GROUP BY prompt_id, field")
def w11_next_version(spark, d):
    c = table(spark, d, "contents").withColumn("prompt_id", F.col("run_id") % 50)
    n = F.row_number().over(Window.partitionBy("prompt_id", "field").orderBy("run_id"))
    return c.withColumn("version", n).groupBy("prompt_id", "field").agg(F.count("*").alias("versions"), (F.max("version") + 1).alias("next_version"))


@query("projects", """, s AS (SELECT created_by, id, workflow_status, emirate, property_type, lag(workflow_status) OVER w AS w0, lag(property_type) OVER w AS p0, lag(id) OVER w AS before FROM projects WINDOW w AS (PARTITION BY created_by ORDER BY created_us, id))
SELECT id, 'workflow_status' AS field, w0 AS old, workflow_status AS new FROM s WHERE before IS NOT NULL AND w0 IS DISTINCT FROM workflow_status UNION ALL SELECT id, 'property_type', p0, property_type FROM s WHERE before IS NOT NULL AND p0 IS DISTINCT FROM property_type""")
def w12_revision_diff(spark, d):
    w = Window.partitionBy("created_by").orderBy("created_us", "id")
    fields = ("workflow_status", "property_type")
    s = table(spark, d, "projects").select("id", F.lag("id").over(w).alias("before"), *fields, *(F.lag(f).over(w).alias(f"{f}_0") for f in fields)).where("before is not null")
    changes = F.filter(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"{f}_0").alias("old"), F.col(f).alias("new")) for f in fields)), lambda x: ~x["old"].eqNullSafe(x["new"]))
    return s.select("id", F.explode(changes).alias("c")).select("id", "c.*")


@query("images", ", n AS (SELECT image_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM images WHERE category = 'floor_plan') SELECT image_id, CASE WHEN n <= 3 THEN i * 100.0 / n ELSE (i % 2) * 50.0 END AS x, CASE WHEN n <= 3 THEN 0.0 ELSE (i // 2) * 100.0 / ((n + 1) // 2) END AS y FROM n")
def w13_even_split(spark, d):
    """Boxes side by side for up to three plans, else in a grid of two columns."""
    w = Window.partitionBy("doc_id")
    i = table(spark, d, "images").where("category = 'floor_plan'").select("image_id", (F.row_number().over(w.orderBy("seq")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    few = F.col("n") <= 3
    return i.select("image_id", F.when(few, F.col("i") * 100.0 / F.col("n")).otherwise(F.col("i") % 2 * 50.0).alias("x"), F.when(few, 0.0).otherwise(F.floor(F.col("i") / 2) * 100.0 / F.floor((F.col("n") + 1) / 2)).alias("y"))


@query("jobs", """SELECT (completed_us // 86400000000) // 7 AS week, count(*) AS n, CAST(sum(completed_us - started_us) AS DOUBLE) AS total, CAST(max(completed_us - started_us) AS DOUBLE) AS high, true AS within FROM jobs WHERE completed_us IS NOT NULL GROUP BY 1""")
def a35_merged_sketches(spark, d):
    """Durations by week from what is stored for each day; within: the merged sketch's p95 has a rank of 94 to 96 %."""
    from ..operators.sketches import daily, merged, stored
    from ..streaming.jobs import shared_folder

    folder, jobs = shared_folder(spark, "days"), table(spark, d, "jobs").where("completed_us is not null")
    day, took = F.floor(F.col("completed_us") / 86_400_000_000), F.col("completed_us") - F.col("started_us")
    stored(daily(jobs, day, took), folder)
    weeks = merged(spark, folder, F.floor(F.col("day") / 7), {"p95": 0.95})
    values = jobs.select(F.floor(day / 7).alias("period"), took.cast("double").alias("v")).join(weeks.select("period", "p95"), "period")
    ranks = values.groupBy("period").agg((F.count_if(F.col("v") < F.col("p95")) / F.count("*")).alias("below"), (F.count_if(F.col("v") <= F.col("p95")) / F.count("*")).alias("upto"))
    within = ((F.col("below") <= 0.96) & (F.col("upto") >= 0.94)).alias("within")
    return weeks.join(ranks, "period").select(F.col("period").alias("week"), "n", "total", "high", within)
