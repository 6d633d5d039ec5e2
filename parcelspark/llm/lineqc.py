"""Quality rules with DataFrame functions only: text statistics and cross-document line frequency.

Lines are normalised and hashed; the documents that hold a line are counted per host (the source of documents).
Lines in more documents of a host than its limit are removed, and documents that lose most of their words go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, GAP, WORD, table, written

SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"
#: A line goes where over LIMIT_PERCENT of the host's documents, and over LEAST_DOCS of them, hold it, or over MOST_DOCS
#: however large the host is; a document goes with under LEFT_PERCENT of its words left.
LIMIT_PERCENT, LEAST_DOCS, MOST_DOCS, LEFT_PERCENT = 5, 30, 1000, 50
#: Up to so many distinct repeated windows are looked up one by one; beyond it positions are found by sorting.
FEW = 12


def _long(c: Column) -> Column:
    return c.cast("long")


def _normal(line: Column) -> Column:
    """Without case, outer blanks and lengths of gaps; any digit is 0."""
    return F.lower(F.trim(F.translate(F.regexp_replace(line, GAP, " "), "123456789", "000000000")))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, host, key (row hash), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines.

    lines: an array of (hash, words, first) over lines with a word, sorted by hash; first marks the first of equal
    hashes. A null text counts as empty: no words, zero statistics, no lines. Cost is n log n in a text's words.
    """
    words = lambda c: F.filter(F.split(c, GAP), lambda w: w != "")
    d = docs.select("doc_id", F.col("source").alias("host"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text", "source").alias("key"))
    d = d.withColumn("hashes", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)))
    d = d.withColumn("full", F.filter(F.split("text", "\n"), lambda x: F.translate(x, SPACES, "") != ""))
    d = d.select(
        "doc_id", "host", "key", "hashes",
        _long(F.size("hashes")).alias("n_words"),
        _long(F.length(F.translate("text", SPACES, ""))).alias("word_chars"),
        _long(F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        _long(F.size("full") - F.size(F.array_distinct("full"))).alias("n_dup_lines"),
        F.sort_array(F.transform("full", lambda x: F.struct(F.xxhash64(_normal(x)).alias("hash"), F.regexp_count(x, F.lit(WORD)).alias("words")))).alias("sorted_lines"),
    )
    h = F.col("hashes")
    window = lambda i: F.xxhash64(h[i], h[i + 1], h[i + 2])
    d = d.withColumn("windows", F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), F.size(h) - 3), window)).otherwise(F.array().cast("array<bigint>")))
    # most texts repeat no window: then nothing is sorted
    d = d.withColumn("ordered", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array("windows")).otherwise(F.array().cast("array<bigint>")))
    o = F.col("ordered")
    d = d.withColumn("twice", F.array_distinct(F.filter(o, lambda x, i: (i + 1 < F.size(o)) & (x == o[i + 1]))))
    w = F.col("windows")
    places = F.sequence(F.lit(0), F.size(w) - 1)
    many = F.size("twice") > FEW
    d = d.withColumn("pairs", F.when(many, F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    p = F.col("pairs")
    sorted_way = F.transform(F.filter(places, lambda i: F.when(i > 0, p[i]["x"] == p[F.greatest(i - 1, F.lit(0))]["x"]).otherwise(False) | F.when(i + 1 < F.size(p), p[i]["x"] == p[i + 1]["x"]).otherwise(False)), lambda i: p[i]["i"])
    twice = F.col("twice")
    starts = F.when(F.size(twice) == 0, F.array().cast("array<int>")).when(many, sorted_way).otherwise(F.filter(places, lambda i: F.array_contains(twice, w[i])))
    covered = F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))
    s = F.col("sorted_lines")
    lines = F.transform(s, lambda x, i: F.struct(x["hash"].alias("hash"), x["words"].alias("words"), F.when(i > 0, s[F.greatest(i - 1, F.lit(0))]["hash"] != x["hash"]).otherwise(True).alias("first")))
    return d.select("doc_id", "host", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", _long(covered).alias("n_repeat_words"), lines.alias("lines"))


def frequent_lines(stats: DataFrame, limit_percent: int = LIMIT_PERCENT, least_docs: int = LEAST_DOCS, most_docs: int = MOST_DOCS) -> DataFrame:
    """host_key, hash, docs of lines above their host's limits: counts over all documents, combined before the shuffle."""
    host = F.coalesce(F.concat(F.lit("h"), "host"), F.lit("n")).alias("host_key")
    lines = stats.select(host, F.explode("lines").alias("line")).where("line.first")
    counts = lines.groupBy("host_key", F.col("line.hash").alias("hash")).agg(F.count("*").alias("docs"))
    sizes = stats.groupBy(host).agg(F.count("*").alias("host_docs"))
    # only lines over least_docs can be frequent, so few rows reach the join
    return counts.where(F.col("docs") > least_docs).join(sizes, "host_key").where((F.col("docs") > most_docs) | (100 * F.col("docs") > limit_percent * F.col("host_docs"))).select("host_key", "hash", "docs")


def _judged(docs: DataFrame, limit_percent: int, least_docs: int, most_docs: int, left_percent: int) -> tuple[DataFrame, DataFrame]:
    """The statistics of each document with left_words, base_failed and kept; and its frequent lines (doc_id, key, line_hash, words)."""
    stats = written(statistics(docs), "line-statistics")
    often = frequent_lines(stats, limit_percent, least_docs, most_docs).select("host_key", F.col("hash").alias("line_hash"))
    host = F.coalesce(F.concat(F.lit("h"), "host"), F.lit("n")).alias("host_key")
    lines = stats.where("n_words > 0").select("doc_id", "key", host, F.explode("lines").alias("line")).select("doc_id", "key", "host_key", F.col("line.hash").alias("line_hash"), "line.words")
    frequent = lines.join(often, ["host_key", "line_hash"]).select("doc_id", "key", "line_hash", "words")
    gone = frequent.groupBy("doc_id", "key").agg(F.sum("words").alias("gone"))
    # equal rows add up under one key: each has its share
    equal = stats.groupBy("doc_id", "key").agg(F.count("*").alias("equal"))
    share = gone.join(equal, (gone["key"] == equal["key"]) & gone["doc_id"].eqNullSafe(equal["doc_id"])).select(gone["doc_id"].alias("id"), gone["key"].alias("k"), (F.col("gone") / F.col("equal")).cast("long").alias("gone"))
    d = stats.join(share, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & (100 * left >= left_percent * F.col("n_words"))
    return d.select("doc_id", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), left.alias("left_words")), frequent


def verdicts(docs: DataFrame, limit_percent: int = LIMIT_PERCENT, least_docs: int = LEAST_DOCS, most_docs: int = MOST_DOCS, left_percent: int = LEFT_PERCENT) -> DataFrame:
    """The statistics of each document with left_words (after removal of frequent lines), base_failed and kept.

    kept is false for base_failed documents (under 50 words, or over half of the words in repeated 3-word windows) and
    for documents of which under left_percent of the words are left. Repeated rows are documents each.
    """
    return _judged(docs, limit_percent, least_docs, most_docs, left_percent)[0].drop("key")


def cleaned(docs: DataFrame, limit_percent: int = LIMIT_PERCENT, least_docs: int = LEAST_DOCS, most_docs: int = MOST_DOCS, left_percent: int = LEFT_PERCENT) -> DataFrame:
    """The documents that are kept, with their own columns, without their host's frequent lines; n_chars follows the text.

    Every occurrence of a frequent line goes with its line break; all other lines, blank ones too, stay as they are. Rows
    that repeat are cleaned each; a document with a null doc_id is judged by its text and source like any other.
    """
    judged, frequent = _judged(docs, limit_percent, least_docs, most_docs, left_percent)
    keep = judged.where("kept").select(F.col("doc_id").alias("id"), F.col("key").alias("k")).distinct()
    gone = frequent.groupBy(F.col("doc_id").alias("id"), F.col("key").alias("k")).agg(F.collect_set("line_hash").alias("gone"))
    same = (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("id"))
    d = docs.select(*DOCUMENT_COLUMNS, F.xxhash64("doc_id", "text", "source").alias("key")).join(keep, same, "left_semi").join(gone, same, "left")
    stays = lambda x: (F.translate(x, SPACES, "") == "") | ~F.array_contains("gone", F.xxhash64(_normal(x)))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n"), stays), "\n"))
    n_chars = F.when(F.col("gone").isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long"))
    return d.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def op4_line_frequency(spark, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('h' || source, 'n') AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d
), e AS (
  SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w
), t AS (
  SELECT r, i, word, lead(word) OVER (PARTITION BY r ORDER BY i) AS w2, lead(word, 2) OVER (PARTITION BY r ORDER BY i) AS w3 FROM e
), g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, word, w2, w3) AS n FROM t WHERE w3 IS NOT NULL
), c AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r
), l AS (
  SELECT r, host, unnest(string_split(text, chr(10))) AS line FROM d
), f AS (
  SELECT r, host, line, lower(trim(regexp_replace(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g'), ' ')) AS norm,
         len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), o AS (
  SELECT host, norm, count(DISTINCT r) AS docs FROM f GROUP BY ALL HAVING count(DISTINCT r) > 30
), h AS (
  SELECT host, count(*) AS host_docs FROM d GROUP BY host
), q AS (
  SELECT o.host, o.norm FROM o JOIN h USING (host) WHERE docs > 1000 OR 100 * docs > 5 * host_docs
), s AS (
  SELECT f.r, count(*) - count(DISTINCT line) AS n_dup_lines, sum(CASE WHEN q.norm IS NOT NULL THEN words ELSE 0 END) AS gone
  FROM f LEFT JOIN q ON f.host = q.host AND f.norm = q.norm GROUP BY f.r
), b AS (
  SELECT d.r, d.doc_id, len(w.w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, len(w.w) - coalesce(gone, 0) AS left_words
  FROM d JOIN w USING (r) LEFT JOIN s USING (r) LEFT JOIN c USING (r)
), v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND 100 * left_words >= 50 * n_words AS kept, left_words::BIGINT AS left_words
FROM v
"""
