"""Changes of state and streams (E, T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import state as S
from ..sources.canonical import AS_OF, DAY, streamed, table
from ..streaming import jobs as J
from ..streaming import keyed as K
from ..streaming import limits as L
from .base import query


@query("projects", "SELECT id, name, workflow_status, is_active FROM projects UNION ALL SELECT 1000000 + c_custkey, c_name, 'draft', true FROM customer WHERE c_custkey < 20")
def e01_insert_with_defaults(spark, d):
    base = table(spark, d, "projects").select("id", "name", "workflow_status", "is_active")
    rows = table(spark, d, "customer").where("c_custkey < 20").select((F.col("c_custkey") + 1_000_000).alias("id"), F.col("c_name").alias("name"))
    return S.inserted(base, rows, workflow_status="draft", is_active=True)


@query("projects", "SELECT id, CASE WHEN id % 10 = 0 THEN 'renamed' ELSE name END AS name, CASE WHEN id % 20 = 0 THEN 'complete' ELSE workflow_status END AS workflow_status FROM projects")
def e02_partial_update(spark, d):
    p = table(spark, d, "projects").select("id", "name", "workflow_status")
    patch = p.where("id % 10 = 0").select("id", F.lit("renamed").alias("name"), F.when(F.col("id") % 20 == 0, "complete").alias("workflow_status"))
    return S.patched(p, patch, "id")


@query("projects", f"SELECT id, is_active AND id % 9 <> 0 AS is_active, id % 9 = 0 AND is_active AS revised FROM projects")
def e03_soft_delete(spark, d):
    p = table(spark, d, "projects").select("id", "is_active")
    now, revisions = S.soft_deleted(p, p.where("id % 9 = 0"), "id", AS_OF)
    return now.join(revisions.select("id", F.lit(True).alias("revised")), "id", "left").select("id", "is_active", F.coalesce("revised", F.lit(False)).alias("revised"))


@query("contents", "SELECT run_id, string_agg(field || '=' || length(content), ',' ORDER BY field) AS fields FROM (SELECT run_id, field, content FROM contents WHERE field <> 'body' UNION ALL SELECT DISTINCT run_id, 'body', 'new' FROM contents) GROUP BY run_id")
def e04_custom_field(spark, d):
    m = table(spark, d, "contents").groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "content"))).alias("m"))
    m = m.withColumn("m", S.with_key(F.col("m"), F.lit("body"), F.lit("new")))
    return m.select("run_id", F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), F.length(e["value"])))), ",").alias("fields"))


@query("jobs", "SELECT id, retry_count + CASE WHEN status = 'failed' THEN 1 ELSE 0 END AS retry_count FROM jobs")
def e05_increment(spark, d):
    return table(spark, d, "jobs").select("id", (F.col("retry_count") + (F.col("status") == "failed").cast("int")).alias("retry_count"))


@query("users", "SELECT id, name, CASE WHEN id % 4 = 0 THEN 'ADMIN' ELSE role END AS role FROM users UNION ALL SELECT 5000000, 'New', 'USER'")
def e06_upsert(spark, d):
    u = table(spark, d, "users").select("id", "name", "role")
    new = spark.createDataFrame([(5_000_000, "New", "USER")], u.schema)
    return S.upserted(u, u.where("id % 4 = 0").withColumn("role", F.lit("ADMIN")).unionByName(new), "id")


@query("approvals", "SELECT user_id, count(*) AS marked FROM approvals WHERE id % 3 <> 0 GROUP BY user_id")
def e07_mark_read(spark, d):
    return table(spark, d, "approvals").where("id % 3 <> 0").groupBy("user_id").agg(F.count("*").alias("marked"))


@query("contents", "SELECT field, count(*) AS versions, max_by(length(content), run_id) AS head FROM contents GROUP BY field")
def e08_versioned_update(spark, d):
    return table(spark, d, "contents").groupBy("field").agg(F.count("*").alias("versions"), F.max_by(F.length("content"), "run_id").alias("head"))


@query("jobs", f"SELECT id FROM jobs WHERE created_us + 20 * {DAY} >= {AS_OF}")
def e09_purge_expired(spark, d):
    return table(spark, d, "jobs").where(F.col("created_us") + 20 * DAY >= AS_OF).select("id")


@query("", "SELECT p_partkey AS id, p_size AS row FROM part WHERE p_size % 5 <> 0")
def e10_field_mapping(spark, d):
    """Legacy cell references become row numbers; removed fields are gone."""
    ref = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("C"), F.col("p_size").cast("string"))).otherwise(F.col("p_size").cast("string"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.create_map(F.when(F.col("p_size") % 5 == 0, "old").otherwise("field"), ref).alias("m"))
    return p.withColumn("m", S.without_key(F.col("m"), "old")).where(F.size("m") > 0).select("id", S.row_of_reference(F.col("m")["field"]).alias("row"))


@query("projects", """SELECT 0 AS version, id, workflow_status, is_active FROM projects UNION ALL SELECT 1, id, workflow_status, is_active AND id % 9 <> 0 FROM projects
UNION ALL SELECT 2, id, CASE WHEN id % 20 = 0 THEN 'complete' ELSE workflow_status END, is_active AND id % 9 <> 0 FROM projects WHERE id % 11 <> 0""")
def e03_kept_versions(spark, d):
    """A soft delete, then a patch with a removal, each committed as a version; all three are read back."""
    from ..operators.versions import VersionedTable

    t = VersionedTable(spark, J.shared_folder(spark, "versions"), "id")
    t.create(table(spark, d, "projects").select("id", "workflow_status", "is_active"))
    gone = t.read().where("id % 9 = 0").select("id")
    t.change(gone, lambda rows: S.soft_deleted(rows, gone, "id", AS_OF)[0])
    patch = t.read().where("id % 20 = 0").select("id", F.lit("complete").alias("workflow_status"))
    removed = t.read().where("id % 11 = 0").select("id")
    t.change(patch.select("id").union(removed), lambda rows: S.patched(rows, patch, "id").join(removed, "id", "left_anti"))
    every = [t.read(v).select(F.lit(v).alias("version"), "id", "workflow_status", "is_active") for v in range(3)]
    return every[0].unionByName(every[1]).unionByName(every[2])


@query("specs", "SELECT doc_id, count(*) AS plans, string_agg(coalesce(unit_type, '?'), '|' ORDER BY row_no) AS labels FROM specs GROUP BY doc_id")
def e11_ground_truth_draft(spark, d):
    g = table(spark, d, "specs").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row_no", F.coalesce("unit_type", F.lit("?")).alias("label")))).alias("x"))
    return g.select("doc_id", F.size("x").cast("long").alias("plans"), F.array_join("x.label", "|").alias("labels"))


@query("contents", "SELECT run_id, CASE WHEN run_id % 2 = 0 THEN 'right' ELSE 'left' END AS body FROM contents WHERE field = 'body'")
def e12_map_merge(spark, d):
    c = table(spark, d, "contents").where("field = 'body'")
    left = F.create_map(F.lit("body"), F.lit("left"), F.lit("a"), F.lit("1"))
    right = F.when(F.col("run_id") % 2 == 0, F.create_map(F.lit("body"), F.lit("right"))).otherwise(F.create_map(F.lit("b"), F.lit("2")))
    return c.select("run_id", S.merged_maps(left, right)["body"].alias("body"))


@query("runs", f"SELECT id, CASE WHEN is_approved THEN project_id END AS approved_by, CASE WHEN is_approved THEN {AS_OF} END AS approved_us FROM runs")
def e13_approval_stamp(spark, d):
    return table(spark, d, "runs").select("id", F.when(F.col("is_approved"), F.col("project_id")).alias("approved_by"), F.when(F.col("is_approved"), F.lit(AS_OF)).alias("approved_us"))


@query("jobs", "SELECT id, CASE WHEN template_type IN ('opr', 'mpp', 'adop') THEN 'resolved' ELSE 'open' END AS state FROM jobs WHERE status = 'failed'")
def e14_resolve_issue(spark, d):
    return table(spark, d, "jobs").where("status = 'failed'").select("id", F.when(F.col("template_type").isin("opr", "mpp", "adop"), "resolved").otherwise("open").alias("state"))


def _requests(spark, d):
    r = table(spark, d, "requests").withColumn("rule", L.rule_of(F.col("path"))["rule"])
    # minutes of the sample stand for milliseconds, so that limits are reached
    return r.select(L.key_of(F.when(F.col("user_id") % 4 > 0, F.col("user_id")), F.col("forwarded"), F.col("peer"), F.col("rule")).alias("key"), "seq", F.floor(F.col("ts_us") / 6000).alias("ts_us"))


def _decided(rows: str) -> str:
    """SQL: request by request of each key, with the log of what was let through, for 10 in 60 seconds."""
    return f""", RECURSIVE r AS ({rows}), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts_us, seq) AS n FROM r),
s AS (SELECT key, n, seq, ts_us, false AS limited, 9::INT AS remaining, 60::INT AS reset, [ts_us] AS log FROM o WHERE n = 1
UNION ALL SELECT key, n, seq, ts_us, len(alive) >= 10, greatest(9 - len(alive), 0)::INT, CASE WHEN len(alive) >= 10 THEN greatest(CAST(trunc((list_min(alive) + 60000000 - ts_us) / 1e6) AS INT), 1) ELSE 60 END, CASE WHEN len(alive) >= 10 THEN alive ELSE list_append(alive, ts_us) END
FROM (SELECT o.*, list_filter(s.log, lambda t: t > o.ts_us - 60000000) AS alive FROM s JOIN o ON o.key = s.key AND o.n = s.n + 1))
SELECT key, seq, ts_us, limited, remaining, reset FROM s"""


_RULE = "CASE WHEN path LIKE '/api/v1/auth%' THEN '/api/v1/auth' WHEN path LIKE '/api/v1/upload%' THEN '/api/v1/upload' WHEN path = '/api/v1/projects' THEN '/api/v1/projects' ELSE 'default' END"


@query("requests", _decided(f"SELECT CASE WHEN user_id % 4 > 0 THEN concat('user:', user_id) ELSE concat('ip:', coalesce(forwarded, peer)) END || ':' || {_RULE} AS key, seq, ts_us // 6000 AS ts_us FROM requests"))
def t01_rate_limit(spark, d):
    return L.limited(_requests(spark, d), 10, 60)


_OF_USERS = "SELECT concat('u', user_id) AS key, seq, ts_us // 6000 AS ts_us FROM requests"


def _stream(spark, d, folder):
    r = streamed(spark, d, "requests").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), "seq", F.floor(F.col("ts_us") / 6000).alias("ts_us"))
    return K.limited_stream(r, 10, 60, folder)


@query("requests", _decided(_OF_USERS))
def t01_rate_limit_stream(spark, d):
    """The same decisions from a stream of the request files, with a log for each user in the state store."""
    return _stream(spark, d, J.shared_folder(spark, "limited"))


@query("requests", _decided(_OF_USERS).replace("SELECT key, seq, ts_us, limited, remaining, reset FROM s", """SELECT key, unnest(log) AS at_us FROM s
WHERE (key, n) IN (SELECT (key, max(n)) FROM s GROUP BY key) AND list_max(log) // 1000 + 300000 > (SELECT max(ts_us) // 1000 FROM s)"""))
def t02_expired_logs(spark, d):
    """The state that is left once the timers of logs five minutes old have fired."""
    folder = J.shared_folder(spark, "limited")
    _stream(spark, d, folder)
    return K.held_logs(spark, folder)


@query("requests", "SELECT seq, CASE WHEN path LIKE '/api/v1/auth%' THEN '/api/v1/auth' WHEN path LIKE '/api/v1/upload%' THEN '/api/v1/upload' WHEN path = '/api/v1/projects' THEN '/api/v1/projects' ELSE 'default' END AS rule, CASE WHEN path LIKE '/api/v1/auth%' THEN 10 WHEN path LIKE '/api/v1/upload%' THEN 20 WHEN path = '/api/v1/projects' THEN 100 ELSE 60 END AS max_requests FROM requests")
def t03_rule_lookup(spark, d):
    return table(spark, d, "requests").select("seq", L.rule_of(F.col("path")).alias("r")).select("seq", "r.rule", "r.max_requests")


@query("requests", "SELECT seq, CASE WHEN user_id % 4 > 0 THEN concat('user:', user_id) ELSE concat('ip:', coalesce(forwarded, peer)) END || ':all' AS key FROM requests")
def t04_limit_key(spark, d):
    return table(spark, d, "requests").select("seq", L.key_of(F.when(F.col("user_id") % 4 > 0, F.col("user_id")), F.col("forwarded"), F.col("peer"), F.lit("all")).alias("key"))


@query("jobs", f"SELECT id, CASE WHEN status = 'processing' AND started_us < {AS_OF} - {DAY} THEN 'failed' ELSE status END AS status FROM jobs")
def t05_stale_sweep(spark, d):
    stale = (F.col("status") == "processing") & (F.col("started_us") < AS_OF - DAY)
    return table(spark, d, "jobs").select("id", F.when(stale, "failed").otherwise(F.col("status")).alias("status"))


@query("jobs", f"SELECT id FROM jobs WHERE NOT coalesce(status IN ('completed', 'failed') AND completed_us < {AS_OF} - 10 * {DAY}, false)")
def t06_retention_purge(spark, d):
    return S.purged(table(spark, d, "jobs"), F.col("status").isin("completed", "failed"), AS_OF - 10 * DAY).select("id")


@query("jobs", f", e AS (SELECT *, CASE WHEN status = 'processing' THEN started_us ELSE created_us END AS at_us FROM jobs) SELECT id, CASE WHEN status = 'processing' AND (at_us + {DAY}) // 1000 <= (SELECT max(at_us) // 1000 FROM e) THEN 'failed' ELSE status END AS status FROM e")
def t05_sweep_stream(spark, d):
    """The sweep by timers: a job that has been processing for a day when the stream's time comes by fails without an event."""
    at = F.when(F.col("status") == "processing", F.col("started_us")).otherwise(F.col("created_us"))
    events = streamed(spark, d, "jobs").select(F.col("id").alias("job_id"), "status", at.alias("at_us"), F.col("id").alias("seq"))
    return K.job_clock(events, DAY // 1_000_000, J.shared_folder(spark, "clock")).select(F.col("job_id").alias("id"), "status")


#: Rows of the sample that are taken as the history of one job.
STEPS = 20


def _history(spark, d):
    return table(spark, d, "jobs").select(F.floor(F.col("id") / STEPS).alias("job_id"), "status", F.col("created_us").alias("at_us"), F.col("id").alias("seq"))


@query("jobs", f"SELECT id // {STEPS} AS job_id, arg_max(status, created_us) AS status, min(CASE WHEN status = 'processing' THEN created_us END) AS started_us, max(CASE WHEN status IN ('completed', 'failed', 'cancelled') THEN created_us END) AS completed_us FROM jobs GROUP BY 1")
def t07_job_states(spark, d):
    return S.job_states(_history(spark, d))


@query("jobs", f"SELECT id // {STEPS} AS job_id, count(*) AS failures, CASE WHEN count(*) < 3 THEN 'processing' ELSE 'failed' END AS status FROM jobs WHERE status = 'failed' GROUP BY 1")
def t08_retry_policy(spark, d):
    return S.retried(_history(spark, d))


@query("jobs", "SELECT project_id, count(*) AS jobs FROM jobs GROUP BY project_id HAVING bool_and(status IN ('completed', 'failed', 'cancelled'))")
def t09_all_done(spark, d):
    return S.complete_groups(table(spark, d, "jobs"), "project_id")


@query("jobs", "SELECT project_id AS group_id, count(*) AS members FROM jobs GROUP BY project_id HAVING bool_and(status IN ('completed', 'failed', 'cancelled'))")
def t09_fire_once(spark, d):
    """A project fires once, when the last of its jobs has ended; the ledger of what fired is written by epoch."""
    expected = table(spark, d, "jobs").groupBy(F.col("project_id").alias("group_id")).agg(F.count("*").alias("expected"))
    jobs = streamed(spark, d, "jobs").select(F.col("project_id").alias("group_id"), F.col("id").alias("member"), "status")
    return K.fired_once(jobs.join(expected, "group_id"), J.shared_folder(spark, "fired"))


@query("approvals users", "SELECT a.id, u.id AS user_id FROM approvals a JOIN users o ON o.id = a.user_id JOIN users u ON u.team = o.team AND u.is_active AND u.role = 'MACHINERY' AND u.id <> a.user_id")
def t10_fan_out(spark, d):
    """A notice for each active user of the actor's team but the actor: two equi-joins, by actor and by team."""
    u = table(spark, d, "users")
    team = u.where("is_active and role = 'MACHINERY'").select(F.col("id").alias("to"), "team")
    a = table(spark, d, "approvals").select("id", "user_id").join(u.select(F.col("id").alias("user_id"), "team"), "user_id")
    return a.join(team, "team").where("to <> user_id").select("id", F.col("to").alias("user_id"))


@query("jobs", f"SELECT id // {STEPS} AS job_id, status AS from_state, lead(status) OVER (PARTITION BY id // {STEPS} ORDER BY created_us, id) AS to_state FROM jobs QUALIFY to_state IS NOT NULL AND NOT ((from_state = 'pending' AND to_state IN ('processing', 'cancelled')) OR (from_state = 'processing' AND to_state IN ('completed', 'failed', 'cancelled')))")
def t11_job_transitions(spark, d):
    from pyspark.sql import Window

    to = F.lead("status").over(Window.partitionBy("job_id").orderBy("at_us", "seq"))
    h = _history(spark, d).select("job_id", F.col("status").alias("from_state"), to.alias("to_state")).where("to_state is not null")
    a, b = F.col("from_state"), F.col("to_state")
    return h.where(~(((a == "pending") & b.isin("processing", "cancelled")) | ((a == "processing") & b.isin("completed", "failed", "cancelled"))))


@query("", "SELECT CAST(epoch_us(date_trunc('hour', ts)) AS BIGINT) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def t12_windowed_counts(spark, d):
    """An extra: tumbling windows of event time, here over the whole table."""
    hour = 3_600_000_000
    ts = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return table(spark, d, "events").groupBy((F.floor(ts / hour) * hour).alias("start_us"), "event_type").agg(F.count("*").alias("n"))


@query("", ", g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 21600000000 THEN 0 ELSE 1 END AS new, event_id FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS no FROM g) SELECT user_id, min(t) AS start_us, count(*) AS n FROM s GROUP BY user_id, no")
def t13_sessions(spark, d):
    """An extra: runs of a user's events with no pause over six hours."""
    from pyspark.sql import Window

    ts = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = table(spark, d, "events").select("user_id", "event_id", ts.alias("t"))
    e = e.withColumn("new", F.coalesce((F.col("t") - F.lag("t").over(w) > 21_600_000_000).cast("int"), F.lit(1)))
    e = e.withColumn("no", F.sum("new").over(w))
    return e.groupBy("user_id", "no").agg(F.min("t").alias("start_us"), F.count("*").alias("n")).drop("no")
