"""Facts from text, units and content quality (F, M, Q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import content_qa as Q
from ..functions import floorplans as P
from ..functions import formats as M
from ..functions import text as T
from ..functions import units as U
from ..sources.canonical import table
from .base import query


def _text(spark, d):
    return table(spark, d, "brochures").select("doc_id", T.extraction_input(F.col("text")).alias("text"))


def _sql(pattern: str) -> str:
    """A pattern or name as an SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


def _sql_list(names) -> str:
    return "[" + ", ".join(map(_sql, names)) + "]"


def _named(text: str, names, suffix: str = "") -> str:
    """SQL: the names of a list that a text holds as whole words, in the list's order."""
    return f"list_filter({_sql_list(names)}, lambda n: regexp_matches({text}, '(?i)\\b' || regexp_escape(n) || '{suffix}\\b'))"


_LETTERS = "length(regexp_replace(x, '[^A-Za-z]', '', 'g'))"
_CLEAN = "regexp_replace(trim(x), '^[*#_ ]+|[*#_ ]+$', '', 'g')"
_KNOWN = f"list_filter({_sql_list(T.DEVELOPERS)}, lambda n: contains(lower({{}}), lower(n)))[1]"


@query("brochures", f""", l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM brochures),
c AS (SELECT doc_id, text, list_filter(list_transform(list_filter(ls[1:10], lambda x: starts_with(x, '# ')), lambda x: trim(substr(x, 3))), lambda x: NOT list_contains({_sql_list(T.GENERIC_HEADINGS)}, lower(x)))[1] AS heading,
  list_filter(list_transform(list_filter(ls[1:20], lambda x: length(trim(x)) >= 3 AND {_LETTERS} > 0 AND length(regexp_replace(x, '[^A-Z]', '', 'g')) >= 0.7 * {_LETTERS}), lambda x: {_CLEAN}), lambda x: length(x) >= 3 AND NOT list_contains({_sql_list(T.GENERIC_NAMES)}, lower(x)))[1] AS capitals,
  list_filter(list_transform(ls[1:15], lambda x: trim(regexp_extract(x, '\\*\\*([^*]+)\\*\\*|__([^_]+)__', 1) || regexp_extract(x, '\\*\\*([^*]+)\\*\\*|__([^_]+)__', 2))), lambda x: length(x) >= 3 AND NOT list_contains({_sql_list(T.GENERIC_NAMES)}, lower(x)))[1] AS bold,
  nullif(trim(regexp_extract(text, {_sql(T.NAME_LABEL)}, 1)), '') AS labelled, nullif(trim(regexp_extract(text, {_sql(T.NAME_PHRASE)}, 1)), '') AS phrase FROM l)
SELECT doc_id, coalesce(heading, array_to_string(list_transform(regexp_extract_all(lower(capitals), '([a-z]+|[^a-z]+)'), lambda x: upper(x[1]) || x[2:]), ''), bold, labelled, phrase) AS value,
  CASE WHEN heading IS NOT NULL THEN 0.9 WHEN capitals IS NOT NULL OR bold IS NOT NULL THEN 0.85 WHEN labelled IS NOT NULL THEN 0.8 WHEN phrase IS NOT NULL THEN 0.7 ELSE 0.0 END::DOUBLE AS confidence FROM c""")
def f01_project_name(spark, d):
    return _text(spark, d).select("doc_id", T.project_name(F.col("text")).alias("r")).select("doc_id", "r.value", "r.confidence")


@query("brochures", f""", c AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, {_sql(T.BY_MAKER)}, 1), lambda x: trim(x)), lambda x: {_KNOWN.format("x")} IS NOT NULL OR length(x) > 3)[1] AS by_maker,
  nullif(trim(regexp_extract(text, {_sql(T.MAKER_LABEL)}, 1)), '') AS label, nullif(trim(regexp_extract(text, {_sql(T.MADE_BY)}, 1)), '') AS made FROM brochures),
k AS (SELECT *, {_KNOWN.format("by_maker")} AS k1, {_KNOWN.format("label")} AS k2, {_KNOWN.format("made")} AS k3 FROM c)
SELECT doc_id, coalesce(k1, by_maker, k2, label, made) AS value, CASE WHEN by_maker IS NOT NULL THEN CASE WHEN k1 IS NULL THEN 0.6 ELSE 0.9 END WHEN label IS NOT NULL THEN CASE WHEN k2 IS NULL THEN 0.6 ELSE 0.9 END WHEN made IS NOT NULL THEN CASE WHEN k3 IS NULL THEN 0.5 ELSE 0.7 END ELSE 0.0 END::DOUBLE AS confidence FROM k""")
def f02_developer(spark, d):
    return _text(spark, d).select("doc_id", T.developer(F.col("text")).alias("r")).select("doc_id", "r.value", "r.confidence")


@query("brochures", f", e AS (SELECT doc_id, text, {_named('text', T.EMIRATES)}[1] AS emirate FROM brochures) SELECT doc_id, emirate, CASE WHEN emirate = 'Dubai' THEN {_named('text', T.COMMUNITIES)}[1] END AS community FROM e")
def f03_location(spark, d):
    return _text(spark, d).select("doc_id", T.location(F.col("text")).alias("r")).select("doc_id", "r.emirate", "r.community")


_PRICES = """, p AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)AED\\s*([0-9,\\.]+)\\s*(M(?:illion)?|K|thousand)?', 1)) AS n, unnest(regexp_extract_all(text, '(?i)AED\\s*([0-9,\\.]+)\\s*(M(?:illion)?|K|thousand)?', 2)) AS s FROM brochures UNION ALL
SELECT doc_id, unnest(regexp_extract_all(text, '(?i)([0-9,\\.]+)\\s*(M(?:illion)?|K)?\\s*AED', 1)), unnest(regexp_extract_all(text, '(?i)([0-9,\\.]+)\\s*(M(?:illion)?|K)?\\s*AED', 2)) FROM brochures),
v AS (SELECT doc_id, CAST(trunc(TRY_CAST(replace(n, ',', '') AS DOUBLE) * CASE WHEN upper(s) LIKE 'M%' THEN 1000000 WHEN upper(s) LIKE 'K%' THEN 1000 ELSE 1 END) AS BIGINT) AS price FROM p),
w AS (SELECT * FROM v WHERE price BETWEEN 100000 AND 100000000)""".replace("\\\\", "\\")


@query("brochures", _PRICES + " SELECT b.doc_id, min(price) AS min_price, CASE WHEN max(price) <> min(price) THEN max(price) END AS max_price, CASE WHEN count(price) >= 2 THEN 0.8 WHEN count(price) = 1 THEN 0.6 ELSE 0.0 END::DOUBLE AS confidence FROM brochures b LEFT JOIN w USING (doc_id) GROUP BY b.doc_id")
def f04_prices(spark, d):
    return _text(spark, d).select("doc_id", T.price_range(T.prices(F.col("text"))).alias("r")).select("doc_id", "r.*")


@query("brochures", _PRICES + " SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id")
def a12_price_counts(spark, d):
    return _text(spark, d).select("doc_id", F.size(T.prices(F.col("text"))).cast("long").alias("n")).where("n > 0")


@query("brochures", """, b AS (SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\\bStudio\\b') THEN 'Studio' END AS s, list_sort(list_distinct(list_concat(list_concat(regexp_extract_all(text, '(?i)\\b([1-9])\\s*BR\\b', 1), regexp_extract_all(text, '(?i)\\b([1-9])\\s*Bedroom', 1)), regexp_extract_all(text, '(?i)\\b([1-9])\\s*B\\s*/\\s*R\\b', 1)))) AS n FROM brochures)
SELECT doc_id, concat_ws(',', s, CASE WHEN len(n) > 0 THEN array_to_string(list_transform(n, lambda x: x || 'BR'), ',') END) AS bedrooms FROM b""")
def f05_bedrooms(spark, d):
    return _text(spark, d).select("doc_id", F.array_join(T.bedrooms(F.col("text")), ",").alias("bedrooms"))


@query("brochures", f""", c AS (SELECT doc_id, nullif(regexp_extract(text, {_sql(T.QUARTER)}, 1), '') AS quarter, nullif(trim(regexp_extract(text, {_sql(T.DATE_LABEL)}, 1)), '') AS labelled, list_filter(regexp_extract_all(text, {_sql(T.YEAR)}, 1), lambda y: CAST(y AS INT) >= 2024)[1] AS year FROM brochures)
SELECT doc_id, coalesce(quarter, labelled, year) AS value, CASE WHEN quarter IS NOT NULL THEN 0.9 WHEN labelled IS NOT NULL THEN 0.8 WHEN year IS NOT NULL THEN 0.6 ELSE 0.0 END::DOUBLE AS confidence FROM c""")
def f06_completion_date(spark, d):
    return _text(spark, d).select("doc_id", T.completion_date(F.col("text"), 2024).alias("r")).select("doc_id", "r.value", "r.confidence")


#: SQL: the amenities of a text without those that others of them stand for.
AMENITIES_SQL = f""", n AS (SELECT doc_id, {_named("text", T.AMENITIES)} AS n FROM brochures),
m AS (SELECT doc_id, list_sort(list_filter(n, lambda x: NOT (x = 'Pool' AND list_contains(n, 'Swimming Pool')) AND NOT (x = 'Gym' AND (list_contains(n, 'Fitness Center') OR list_contains(n, 'Fitness Centre'))))) AS amenities FROM n)"""


@query("brochures", AMENITIES_SQL + " SELECT doc_id, array_to_string(amenities, ',') AS amenities FROM m")
def f07_amenities(spark, d):
    return _text(spark, d).select("doc_id", F.array_join(T.amenities(F.col("text")), ",").alias("amenities"))


@query("brochures", """SELECT doc_id, CAST(regexp_extract(text, '([0-9]+)% down payment', 1) AS DOUBLE) AS down_payment, CAST(regexp_extract(text, '([0-9]+)% during construction', 1) AS DOUBLE) AS during_construction, CAST(regexp_extract(text, '([0-9]+)% on handover', 1) AS DOUBLE) AS on_handover, round(0.9, 2)::DOUBLE AS confidence FROM brochures""")
def f08_payment_plan(spark, d):
    r = _text(spark, d).select("doc_id", T.payment_plan(F.col("text")).alias("r"))
    return r.select("doc_id", "r.down_payment", "r.during_construction", "r.on_handover", F.round("r.confidence", 2).alias("confidence"))


@query("brochures", f"SELECT doc_id, {_named('text', T.PROPERTY_TYPES, 's?')}[1] AS value FROM brochures")
def f09_property_type(spark, d):
    return _text(spark, d).select("doc_id", T.property_type(F.col("text"))["value"].alias("value"))


_SIZE = "CAST(regexp_extract(text, '{}', 1) AS DOUBLE)"


def _number(pattern: str) -> str:
    return f"TRY_CAST(replace(regexp_extract(text, {_sql(pattern)}, 1), ',', '') AS DOUBLE)"


def _labelled(words: str, more: str) -> str:
    return _number(rf"(?i)(?:{words})(?:\s+{more})?\s*[:\s].*?{P._SQFT}")


@query("brochures", f""", h AS (SELECT doc_id, text, list_transform(regexp_extract_all(regexp_extract(text, {_sql(P.BREAKDOWN_HEAD)}, 1), {_sql('(?i)' + P._SQFT)}, 1)[1:6], lambda v: TRY_CAST(replace(v, ',', '') AS DOUBLE)) AS v,
  {_labelled('suite|internal', 'area')} AS suite, {_labelled('total|gross', r'(?:built[' + chr(92) + 's-]*up|area)')} AS total, {_number(P.AREA_FEET)} AS feet, {_number(P.AREA_METRES)} * {U.SQM_TO_SQFT} AS metres, {_number(P.BATHS)} AS baths FROM brochures),
b AS (SELECT *, CASE WHEN len(v) >= 6 THEN v[4:6] ELSE v[1:3] END AS x FROM h),
a AS (SELECT *, len(v) >= 3 AND x[3] >= x[1] AS headed, suite > 0 AND total >= suite AS labelled FROM b)
SELECT doc_id, nullif(CASE WHEN headed THEN x[1] WHEN labelled THEN suite END, 0) AS suite, CASE WHEN (headed AND x[3] <> 0) OR (coalesce(headed, false) = false AND labelled AND total <> 0) THEN 0.92 WHEN feet BETWEEN {U.BOUNDS['total_sqft'][0]} AND {U.BOUNDS['total_sqft'][1]} OR metres BETWEEN {U.BOUNDS['total_sqft'][0]} AND {U.BOUNDS['total_sqft'][1]} THEN 0.6 END::DOUBLE AS total_confidence,
CASE WHEN baths BETWEEN {U.BOUNDS['bathrooms'][0]} AND {U.BOUNDS['bathrooms'][1]} THEN baths END AS bathrooms FROM a""")
def f10_text_facts(spark, d):
    return _text(spark, d).select("doc_id", P.text_facts(F.col("text")).alias("r")).select("doc_id", "r.suite", "r.total_confidence", "r.bathrooms")


@query("brochures", r""", v AS (SELECT doc_id, regexp_extract_all(regexp_extract(text, '(?is)suite\s*\n\s*balcony\s*\n\s*total(.*)$', 1), '([0-9.]+) Sq.ft', 1) AS v FROM brochures) SELECT doc_id, CAST(v[1] AS DOUBLE) AS suite, CAST(v[2] AS DOUBLE) AS balcony, CAST(v[3] AS DOUBLE) AS total FROM v""")
def f11_header_breakdown(spark, d):
    return _text(spark, d).select("doc_id", P.header_breakdown(F.col("text")).alias("r")).select("doc_id", "r.*")


@query("brochures", """, v AS (SELECT doc_id, TRY_CAST(regexp_extract(text, 'Suite area: ([0-9]+)', 1) AS DOUBLE) AS suite, TRY_CAST(regexp_extract(text, 'Balcony area: ([0-9]+)', 1) AS DOUBLE) AS balcony, TRY_CAST(replace(regexp_extract(text, 'Total area: ([0-9,.]+)', 1), ',', '') AS DOUBLE) AS total FROM brochures)
SELECT doc_id, CASE WHEN total >= suite THEN suite END AS suite, CASE WHEN total >= suite THEN balcony END AS balcony, CASE WHEN total >= suite THEN total END AS total FROM v""")
def f12_labelled_breakdown(spark, d):
    return _text(spark, d).select("doc_id", P.labelled_breakdown(F.col("text")).alias("r")).select("doc_id", "r.*")


@query("plans", """SELECT doc_id, seq, CASE WHEN unit_type LIKE 'Studio%' THEN 'studio' ELSE concat(regexp_extract(unit_type, '^([0-9]+)', 1), 'br') END AS bed, lower(regexp_extract(unit_type, 'Type ([A-Z][0-9]*)', 1)) AS sub FROM plans WHERE unit_type IS NOT NULL""")
def f13_unit_key(spark, d):
    return table(spark, d, "plans").where("unit_type is not null").select("doc_id", "seq", P.unit_key(F.col("unit_type")).alias("k")).select("doc_id", "seq", "k.*")


@query("plans", "SELECT doc_id, seq, nullif(lower(regexp_extract(unit_type, 'Type ([A-Z][0-9]*)', 1)), '') AS letter FROM plans")
def f14_type_letter(spark, d):
    return table(spark, d, "plans").select("doc_id", "seq", P.type_letter(F.col("unit_type")).alias("letter"))


@query("plans", "SELECT doc_id, seq, CASE WHEN unit_type LIKE 'Studio%' THEN 0 WHEN unit_type IS NULL THEN bedrooms + 1 ELSE CAST(regexp_extract(unit_type, '^([0-9]+)', 1) AS INT) END AS beds FROM plans")
def f15_enforced_bedrooms(spark, d):
    return table(spark, d, "plans").select("doc_id", "seq", P.enforced_bedrooms(F.col("unit_type"), F.col("bedrooms") + 1).alias("beds"))


@query("", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_size + 5.5 WHEN 1 THEN greatest(p_size, 20.25) ELSE p_size END::DOUBLE AS v FROM part")
def f16_range_maximum(spark, d):
    p, s = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    text = F.when(p == 0, F.concat(s, F.lit(" - "), (F.col("p_size") + 5).cast("string"), F.lit(".5"))).when(p == 1, F.concat(s, F.lit(" to 20.25"))).otherwise(s)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), P.range_maximum(text).alias("v"))


@query("", "SELECT p_partkey AS id, CAST(1000 + p_size AS DOUBLE) AS number, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS share FROM part")
def f17_numbers(spark, d):
    number = F.concat(F.lit("AED 1,0"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit(" net"))
    share = F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" %"))).otherwise("N/A")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), P.parsed_number(number).alias("number"), P.parsed_percentage(share).alias("share"))


def _headers():
    i = F.col("p_partkey") % 5
    a = lambda *x: F.array(*map(F.lit, x))
    return F.when(i == 0, a("Type", "Bedrooms", "Area (sqft)", "Balcony (sqft)")).when(i == 1, a("Milestone", "Percentage", "Due Date")).when(i == 2, a("Column A", "Column B")).when(i == 3, a("Name", "Area")).otherwise(a("Unit Type", "Total area (sqm)", "Area"))


@query("", "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 1 THEN 'payment_plan' WHEN 2 THEN 'unknown' ELSE 'floor_plan' END AS kind FROM part")
def f18_table_kind(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), P.table_kind(_headers()).alias("kind"))


@query("", "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'unit_type|bedrooms|total_sqft|balcony_sqft' WHEN 1 THEN '-|-|-' WHEN 2 THEN '-|-' WHEN 3 THEN '-|total_sqft' ELSE 'unit_type|total_sqft|-' END AS fields FROM part")
def f19_column_fields(spark, d):
    fields = F.transform(P.column_fields(_headers()), lambda f: F.coalesce(f, F.lit("-")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(fields, "|").alias("fields"))


@query("", """SELECT p_partkey AS id, CASE WHEN p_partkey % 5 IN (0, 4) THEN concat(p_size % 4 + 1, 'BR') END AS unit_type, CASE p_partkey % 5 WHEN 0 THEN p_size END AS bedrooms,
CASE p_partkey % 5 WHEN 3 THEN p_size WHEN 4 THEN round_even(p_size * 10.764, 1) END::DOUBLE AS total FROM part""")
def f20_floor_plan_rows(spark, d):
    """A part whose row has no field of its headers has no plan."""
    rows = F.array(F.array(F.concat((F.col("p_size") % 4 + 1).cast("string"), F.lit("BR")), F.col("p_size").cast("string"), F.lit("")))
    m = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.get(P.floor_plan_rows(_headers(), rows), F.lit(0)).alias("m"))
    return m.select("id", F.col("m")["unit_type"].alias("unit_type"), F.col("m")["bedrooms"].cast("int").alias("bedrooms"), F.col("m")["total_sqft"].cast("double").alias("total"))


@query("", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'down_payment' WHEN 1 THEN 'during_construction' WHEN 2 THEN 'post_handover' ELSE 'on_handover' END AS bucket FROM part")
def f21_payment_rows(spark, d):
    i = F.col("p_partkey") % 4
    m = F.when(i == 0, "On Booking").when(i == 1, "During Construction").when(i == 2, "Post Handover").otherwise("At Completion")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), P.payment_bucket(m).alias("bucket"))


@query("projects", """, s AS (SELECT id, trim(regexp_replace(lower(repeat(name || ' ', id % 4) || location), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM projects), c AS (SELECT id, s, left(s, 60) AS c, 60 - instr(reverse(left(s, 60)), '-') AS last FROM s)
SELECT id, CASE WHEN length(s) <= 60 THEN s WHEN instr(c, '-') > 0 AND last > 30 THEN left(c, last) ELSE c END AS slug FROM c""")
def f22_slug(spark, d):
    """Some names are long enough to be cut."""
    name = F.concat(F.repeat(F.concat("name", F.lit(" ")), (F.col("id") % 4).cast("int")), "location")
    return table(spark, d, "projects").select("id", M.slug(name).alias("slug"))


@query("", r"SELECT conv_id, turn, length(regexp_replace(regexp_replace('```json' || chr(10) || text || chr(10) || '```', '(?m)^```.*$\n?', '', 'g'), '^\s+|\s+$', '', 'g')) AS n FROM conversations")
def f24_fences(spark, d):
    fenced = F.concat(F.lit("```json\n"), F.col("text"), F.lit("\n```"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.length(M.without_fences(fenced)).alias("n"))


@query("projects", "SELECT id, concat(name, ' in ', location, ': N/A {name}') AS text FROM projects")
def f25_template(spark, d):
    values = F.create_map(F.lit("name"), F.col("name"), F.lit("place"), F.col("location"), F.lit("trap"), F.lit("{name}"))
    return table(spark, d, "projects").select("id", M.filled_template(F.lit("{name} in {place}: {missing} {trap}"), values).alias("text"))


@query("projects", """, p AS (SELECT id, CAST(CASE id % 4 WHEN 0 THEN starting_price * 12 WHEN 1 THEN starting_price / 1000 WHEN 2 THEN starting_price END AS DOUBLE) AS p FROM projects)
SELECT id, CASE WHEN p IS NULL THEN 'Price on request' WHEN p >= 1000000 THEN printf('AED %.1fM', p / 1000000) WHEN p >= 1000 THEN concat('AED ', CAST(round_even(p / 1000, 0) AS BIGINT), 'K') ELSE format('AED {:,}', CAST(round_even(p, 0) AS BIGINT)) END AS text FROM p""")
def f26_price_text(spark, d):
    """Millions, thousands, less, and none."""
    i, p = F.col("id") % 4, F.col("starting_price").cast("double")
    price = F.when(i == 0, F.col("starting_price") * 12).when(i == 1, p / 1000).when(i == 2, F.col("starting_price"))
    return table(spark, d, "projects").select("id", M.price_text(price).alias("text"))


@query("plans", "SELECT doc_id, CASE WHEN len(t) <= 3 THEN array_to_string(t, ', ') ELSE array_to_string(t[1:3], ', ') || ', and ' || (len(t) - 3) || ' more' END AS text FROM (SELECT doc_id, list(DISTINCT unit_type ORDER BY unit_type) AS t FROM plans WHERE unit_type IS NOT NULL GROUP BY doc_id)")
def f27_list_text(spark, d):
    g = table(spark, d, "plans").where("unit_type is not null").groupBy("doc_id").agg(F.array_sort(F.collect_set("unit_type")).alias("t"))
    return g.select("doc_id", M.list_text(F.col("t")).alias("text"))


@query("plans", "SELECT doc_id, seq, CASE WHEN suite_sqft > 0 AND balcony_sqft > 0 THEN 'both' WHEN suite_sqft > 0 THEN 'from' WHEN balcony_sqft > 0 THEN 'up to' ELSE 'none' END AS kind FROM plans")
def f28_price_range_text(spark, d):
    t = M.price_range_text(F.col("suite_sqft"), F.col("balcony_sqft"))
    kind = F.when(F.contains(t, F.lit(" - ")), "both").when(t.startswith("From"), "from").when(t.startswith("Up to"), "up to").otherwise("none")
    return table(spark, d, "plans").select("doc_id", "seq", kind.alias("kind"))


@query("", "SELECT p_partkey AS id, concat(p_size, '% Down Payment, 30% On Handover') AS text FROM part")
def f29_plan_text(spark, d):
    plan = F.create_map(F.lit("down_payment"), F.concat(F.col("p_size").cast("string"), F.lit("%")), F.lit("on_handover"), F.lit("30%"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), M.plan_text(plan).alias("text"))


@query("", "SELECT p_partkey AS id, replace(p_name, ' ', '_') AS snake FROM part")
def f30_snake_and_title(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), M.snake_of_title(M.title_of_snake(F.replace("p_name", F.lit(" "), F.lit("_")))).alias("snake"))


@query("brochures", "SELECT doc_id, len(regexp_extract_all(text, '(?i)([0-9,]+(?:\\.[0-9]+)?)\\s*(?:sq\\.?\\s*ft|sqft)')) AS sqft, len(regexp_extract_all(text, '(?i)([0-9,]+(?:\\.[0-9]+)?)\\s*(?:sq\\.?\\s*m\\b|sqm)')) AS sqm FROM brochures")
def f31_page_signals(spark, d):
    return _text(spark, d).select("doc_id", T.page_signals(F.col("text")).alias("r")).select("doc_id", F.size("r.sqft").cast("long").alias("sqft"), F.size("r.sqm").cast("long").alias("sqm"))


@query("images", "SELECT image_id, CASE image_id % 4 WHEN 2 THEN concat('Creek Tower ', image_id % 6) WHEN 3 THEN concat('Creek ', image_id % 6) END AS name FROM images")
def f32_name_of_alt(spark, d):
    return table(spark, d, "images").select("image_id", M.name_of_alt(F.col("alt_text")).alias("name"))


@query("", "SELECT conv_id, turn, length(text) // 4 AS tokens FROM conversations")
def f33_token_estimate(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", M.token_estimate(F.col("text")).alias("tokens"))


@query("users", "SELECT id, 'u***@' || split_part(email, '@', 2) AS masked, email LIKE '%@example.com' AS own FROM users")
def f34_email(spark, d):
    return table(spark, d, "users").select("id", M.masked_email(F.col("email")).alias("masked"), M.in_domain(F.col("email"), "example.com").alias("own"))


@query("users", "SELECT id, sha256(email) AS digest FROM users")
def f35_digest(spark, d):
    return table(spark, d, "users").select("id", F.sha2("email", 256).alias("digest"))


# units: dimension texts made from lineitem
def _dimension():
    i = F.col("l_linenumber") % 4
    q = F.col("l_quantity").cast("int").cast("string")
    return F.when(i == 0, F.concat(q, F.lit("00mm x 3000mm"))).when(i == 1, F.concat(q, F.lit("ft x 10ft"))).when(i == 2, F.concat(q, F.lit("m x 3.5m"))).otherwise(F.concat(q, F.lit(" x 50")))


_DIM = "SELECT l_orderkey AS id, l_linenumber AS n, l_partkey AS k, CAST(l_quantity AS INT) AS q, l_linenumber % 4 AS i FROM lineitem"


@query("", f"SELECT id, n, k, CASE i WHEN 0 THEN q * 100 ELSE q END::DOUBLE AS length FROM ({_DIM})")
def m01_dimension(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("k"), U.dimension(_dimension())["length"].alias("length"))


@query("", f"SELECT id, n, k, CASE i WHEN 0 THEN 'mm' WHEN 1 THEN 'ft' WHEN 2 THEN 'm' ELSE CASE WHEN (q + 50) / 2.0 > 30 THEN 'ft' ELSE 'm' END END AS unit FROM ({_DIM})")
def m02_dimension_unit(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("k"), U.dimension_unit(_dimension()).alias("unit"))


@query("", f"SELECT id, n, k, round(CASE i WHEN 0 THEN q * 0.3 * 10.764 WHEN 1 THEN q * 10 WHEN 2 THEN q * 3.5 * 10.764 ELSE CASE WHEN (q + 50) / 2.0 > 30 THEN q * 50 ELSE q * 50 * 10.764 END END::DOUBLE, 3) AS area FROM ({_DIM})")
def m03_room_area(spark, d):
    rooms = F.create_map(F.lit("living"), _dimension(), F.lit("bad"), F.lit("no size"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("k"), F.round(U.area_of_rooms(rooms), 3).alias("area"))


@query("", "SELECT event_id, CASE event_type WHEN 'view' THEN 1.0 WHEN 'click' THEN 1.5 WHEN 'error' THEN 0.5 ELSE 0.0 END::DOUBLE AS baths FROM events")
def m04_bathrooms(spark, d):
    e = F.col("event_type")
    rooms = F.when(e == "view", F.create_map(F.lit("Bath 1"), F.lit("x"), F.lit("bedroom"), F.lit("x"))).when(e == "click", F.create_map(F.lit("ensuite"), F.lit("x"), F.lit("Powder Room"), F.lit("x"))).when(e == "error", F.create_map(F.lit("wc"), F.lit("x"))).otherwise(F.create_map(F.lit("kitchen"), F.lit("x")))
    return table(spark, d, "events").select("event_id", U.bathrooms_of_rooms(rooms).alias("baths"))


@query("plans", """, g AS (SELECT *, CAST(CAST(suite_sqft * 1.15::DOUBLE AS VARCHAR) AS DECIMAL(38, 20)) * 10 AS g FROM plans), r AS (SELECT *, CAST(floor(g) + CASE WHEN g - floor(g) > 0.5 OR g - floor(g) = 0.5 AND CAST(floor(g) AS BIGINT) % 2 = 1 THEN 1 ELSE 0 END AS DOUBLE) / 10 AS gross FROM g)
SELECT doc_id, seq, CASE WHEN total_sqft IS NOT NULL THEN total_sqft WHEN gross BETWEEN 50 AND 25000 THEN gross END AS total FROM r""")
def m05_filled_total(spark, d):
    return table(spark, d, "plans").select("doc_id", "seq", U.filled_total(F.col("total_sqft"), F.col("suite_sqft")).alias("total"))


@query("plans", """, k AS (SELECT *, (coalesce(suite_sqft > 0, false))::INT + (coalesce(balcony_sqft > 0, false))::INT + (coalesce(total_sqft > 0, false))::INT AS known FROM plans)
SELECT doc_id, seq, CASE WHEN known = 2 AND suite_sqft IS NULL AND total_sqft IS NOT NULL AND balcony_sqft IS NOT NULL THEN total_sqft - balcony_sqft ELSE suite_sqft END AS suite, CASE WHEN known = 2 AND balcony_sqft IS NULL AND total_sqft IS NOT NULL AND suite_sqft IS NOT NULL THEN total_sqft - suite_sqft ELSE balcony_sqft END AS balcony,
CASE WHEN known = 3 AND (total_sqft < suite_sqft OR abs(total_sqft - suite_sqft) / total_sqft < 0.02) AND abs(suite_sqft + balcony_sqft - total_sqft) / total_sqft > 0.02 THEN suite_sqft + balcony_sqft WHEN known = 2 AND total_sqft IS NULL AND suite_sqft IS NOT NULL AND balcony_sqft IS NOT NULL THEN suite_sqft + balcony_sqft ELSE total_sqft END AS total FROM k""")
def m06_area_reconciliation(spark, d):
    r = U.reconciled_areas(F.col("suite_sqft"), F.col("balcony_sqft"), F.col("total_sqft"))
    return table(spark, d, "plans").select("doc_id", "seq", r.alias("r")).select("doc_id", "seq", "r.*")


@query("images", "SELECT a.image_id, b.image_id AS other, 1 - bit_count(xor(a.phash, b.phash)) / 64.0 AS similarity FROM images a JOIN images b ON b.image_id = a.image_id + 1 WHERE a.phash IS NOT NULL AND b.phash IS NOT NULL")
def m07_hash_similarity(spark, d):
    i = table(spark, d, "images").where("phash is not null").select("image_id", "phash")
    n = i.select((F.col("image_id") - 1).alias("image_id"), F.col("image_id").alias("other"), F.col("phash").alias("h"))
    return i.join(n, "image_id").select("image_id", "other", U.similarity64(F.col("phash"), F.col("h")).alias("similarity"))


@query("images", """, b AS (SELECT image_id, greatest(0, CAST(trunc(8::DOUBLE / 100 * width) AS INT)) AS l, greatest(0, CAST(trunc(8::DOUBLE / 100 * height) AS INT)) AS t, least(width, CAST(trunc(62::DOUBLE / 100 * width) AS INT)) AS r, least(height, CAST(trunc(92::DOUBLE / 100 * height) AS INT)) AS b FROM images)
SELECT image_id, CASE WHEN r - l >= 200 AND b - t >= 200 THEN l END AS left_px, CASE WHEN r - l >= 200 AND b - t >= 200 THEN r END AS right_px FROM b""")
def m08_crop_box(spark, d):
    """Boxes that get too small are null."""
    box = U.crop_box(F.lit(10.0), F.lit(10.0), F.lit(50.0), F.lit(80.0), F.col("width"), F.col("height"))
    i = table(spark, d, "images").select("image_id", box.alias("b"))
    return i.select("image_id", F.col("b.left").alias("left_px"), F.col("b.right").alias("right_px"))


@query("images", "SELECT image_id, CASE WHEN width <= 4000 AND height <= 4000 THEN width END AS width FROM images")
def m09_fitted(spark, d):
    return table(spark, d, "images").select("image_id", U.fitted(F.col("width"), F.col("height"), 4000, 4000)["width"].cast("long").alias("width"))


@query("images", """, r AS (SELECT *, least(1.0::DOUBLE, 1568::DOUBLE / width, 1568::DOUBLE / height) AS r FROM images) SELECT image_id, CAST(floor(CAST(trunc(width * r) AS BIGINT) * CAST(trunc(height * r) AS BIGINT) / 750) AS INT) AS tokens FROM r""")
def m10_image_tokens(spark, d):
    return table(spark, d, "images").select("image_id", U.image_tokens(F.col("width"), F.col("height")).alias("tokens"))


@query("lines", "SELECT doc_id, CASE WHEN count(*) > 50 OR sum(length(text)) > 10000 THEN 150 WHEN count(*) > 20 OR sum(length(text)) > 5000 THEN 200 ELSE 300 END AS dpi FROM lines GROUP BY doc_id")
def m11_render_dpi(spark, d):
    return table(spark, d, "lines").groupBy("doc_id").agg(U.render_dpi(F.count("*"), F.sum(F.length("text")) / 100).alias("dpi"))


@query("images", "SELECT image_id, least(width / 5000.0, 1.0) AS quality, width > 0 AND (width - height) * 1.0 / width > 0.15 AS keeps FROM images")
def m12_image_quality(spark, d):
    return table(spark, d, "images").select("image_id", U.image_quality(F.col("width")).alias("quality"), U.keeps_original(F.col("width"), F.col("height")).alias("keeps"))


@query("images", "SELECT image_id, CAST(trunc(seq * 3.0::DOUBLE * width / 100) AS INT) AS x FROM images")
def m13_rescaled(spark, d):
    return table(spark, d, "images").select("image_id", U.rescaled(F.col("seq") * 3.0, F.lit(100.0), F.col("width")).alias("x"))


@query("jobs", "SELECT id, least(pow(2, retry_count), 6.0) AS delay FROM jobs")
def m14_backoff(spark, d):
    return table(spark, d, "jobs").select("id", U.backoff(F.lit(1.0), F.col("retry_count"), F.lit(6.0)).alias("delay"))


# content quality; lookaheads are put as counts of what they exclude, as the oracle's patterns have none
_HITS = """, h AS (SELECT *, lower(content) AS c FROM contents), b AS (SELECT *, (regexp_matches(c, '\\bworld-class\\b'))::INT + (regexp_matches(c, '\\bprime location\\b'))::INT + (regexp_matches(c, '\\bstate-of-the-art\\b'))::INT + (regexp_matches(c, '\\bunrivaled\\b'))::INT
+ (len(regexp_extract_all(c, '\\bprestigious\\b')) > len(regexp_extract_all(c, '\\bprestigious( developer| area)')))::INT + (len(regexp_extract_all(c, '\\bexclusive\\b')) > len(regexp_extract_all(c, '\\bexclusive( deal| offer)')))::INT + (len(regexp_extract_all(c, '\\bluxury\\b')) > len(regexp_extract_all(c, '\\bluxury( developer| brand)')))::INT
+ (regexp_matches(c, '\\bflat\\b'))::INT + (regexp_matches(c, '\\bbuilder\\b'))::INT + (regexp_matches(c, '\\bcompletion\\b'))::INT + (regexp_matches(c, '\\binstallment plan\\b'))::INT + (regexp_matches(c, '\\bact now\\b'))::INT + (regexp_matches(c, '\\blimited time\\b'))::INT AS hits FROM h)"""
_BRAND = "SELECT run_id, CAST(sum(hits) AS BIGINT) AS failed, round((count(*) * 15 - sum(hits)) * 100.0 / (count(*) * 15), 6) AS score FROM b GROUP BY run_id"
_LIMITS = "SELECT run_id, count(CASE WHEN length(content) > char_limit THEN 1 END) AS exceeded, round(count(CASE WHEN length(content) > char_limit THEN NULL ELSE 1 END) * 100.0 / count(*), 6) AS score, count(CASE WHEN length(content) > char_limit THEN 1 END) = 0 AS passed FROM contents GROUP BY run_id"
_SEO = """SELECT run_id, CAST(sum(CASE field WHEN 'meta_title' THEN (length(content) BETWEEN 50 AND 60)::INT + (contains(lower(content), lower(project_name)))::INT + (contains(lower(content), lower(location)))::INT WHEN 'meta_description' THEN (length(content) BETWEEN 150 AND 160)::INT + (regexp_matches(lower(content), 'dubai|property|apartment|developer'))::INT
WHEN 'url_slug' THEN (regexp_matches(content, '^[a-z0-9]+(-[a-z0-9]+)*$'))::INT + (len(string_split(content, '-')) BETWEEN 3 AND 5)::INT ELSE 0 END) AS BIGINT) AS passed_checks FROM contents GROUP BY run_id"""
_FACTS = ", g AS (SELECT run_id, lower(string_agg(content, ' ' ORDER BY field)) AS a, max(project_name) AS p, max(developer) AS v, max(location) AS l FROM contents GROUP BY run_id) SELECT run_id, 2 + (v <> '')::INT AS checks, (contains(a, lower(p)))::INT + (v <> '' AND contains(a, lower(v)))::INT + (contains(a, lower(l)))::INT AS held, contains(a, lower(p)) AND contains(a, lower(l)) AS passed FROM g"


@query("contents", _HITS + " " + _BRAND)
def q01_brand_compliance(spark, d):
    return Q.brand_compliance(table(spark, d, "contents")).select("run_id", F.col("failed").cast("long").alias("failed"), F.round("score", 6).alias("score"))


@query("contents", _LIMITS)
def q02_character_limits(spark, d):
    return Q.character_limits(table(spark, d, "contents")).withColumn("score", F.round("score", 6))


@query("contents", _SEO)
def q03_seo_score(spark, d):
    return Q.seo_score(table(spark, d, "contents")).select("run_id", F.col("passed_checks").cast("long").alias("passed_checks"))


@query("contents", _FACTS)
def q04_factual_accuracy(spark, d):
    return Q.factual_accuracy(table(spark, d, "contents")).select("run_id", "checks", "held", "passed")


@query("contents", _HITS + f", br AS ({_BRAND}), li AS ({_LIMITS}), se AS ({_SEO}), g AS (SELECT run_id, lower(string_agg(content, ' ' ORDER BY field)) AS a, max(project_name) AS p, max(developer) AS v, max(location) AS l FROM contents GROUP BY run_id), fa AS (SELECT run_id, 100.0 * ((contains(a, lower(p)))::INT + (v <> '' AND contains(a, lower(v)))::INT + (contains(a, lower(l)))::INT) / (2 + (v <> '')::INT) AS score, contains(a, lower(p)) AND contains(a, lower(l)) AS passed FROM g)\n" + "SELECT run_id, round((br.score + li.score + passed_checks * 100.0 / 7 + fa.score) / 4, 4) AS score, li.passed AND fa.passed AND (br.score + li.score + passed_checks * 100.0 / 7 + fa.score) / 4 >= 70 AS passed FROM br JOIN li USING (run_id) JOIN se USING (run_id) JOIN fa USING (run_id)")
def q05_report(spark, d):
    """The whole report (A26): mean of the four checks."""
    return Q.report(table(spark, d, "contents")).withColumn("score", F.round("score", 4))


@query("contents", "SELECT run_id, field, coalesce(length(content) <= char_limit, true) AS within_limit FROM contents")
def q06_field_limit(spark, d):
    return table(spark, d, "contents").select("run_id", "field", Q.within_limit(F.col("content"), F.col("char_limit")).alias("within_limit"))
