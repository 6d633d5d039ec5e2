"""Quality of generated content: rows (run_id, field, content, char_limit, project_name, developer, location)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules of the style guide.
PROHIBITED = (
    r"\bworld-class\b", r"\bprime location\b", r"\bstate-of-the-art\b", r"\bunrivaled\b",
    r"\bprestigious\b(?! developer| area)", r"\bexclusive\b(?! deal| offer)", r"\bluxury\b(?! developer| brand)",
)
TERMS = {r"\bflat\b": "apartment", r"\bbuilder\b": "developer", r"\bcompletion\b": "handover", r"\binstallment plan\b": "payment plan"}
PUSHING = (r"\bdon't miss out\b", r"\blimited time\b", r"\bact now\b", r"\bonce in a lifetime\b")
SEO_WORDS = ("dubai", "property", "apartment", "developer")


def brand_hits(content: Column) -> Column:
    """How many of the 15 brand rules a text breaks."""
    patterns = F.array(*map(F.lit, (*PROHIBITED, *TERMS, *PUSHING)))
    return F.size(F.filter(patterns, lambda p: F.regexp_like(F.lower(content), p)))


RULES = len(PROHIBITED) + len(TERMS) + len(PUSHING)


def brand_compliance(contents: DataFrame, key: str = "run_id") -> DataFrame:
    g = contents.groupBy(key).agg(F.count("*").alias("fields"), F.sum(brand_hits(F.col("content"))).alias("failed"))
    n = F.col("fields") * RULES
    return g.select(key, "failed", ((n - F.col("failed")) / n * 100).alias("score")).withColumn("passed", F.col("score") >= 80)


def within_limit(content: Column, limit: Column) -> Column:
    return F.coalesce(F.length(content) <= limit, F.lit(True))


def character_limits(contents: DataFrame, key: str = "run_id") -> DataFrame:
    ok = within_limit(F.col("content"), F.col("char_limit"))
    return contents.groupBy(key).agg(F.count_if(~ok).alias("exceeded"), (F.count_if(ok) / F.count("*") * 100).alias("score"), F.bool_and(ok).alias("passed"))


def _named(c: Column, name: Column) -> Column:
    return (name != "") & F.contains(F.lower(c), F.lower(name))


def seo_checks(field: Column, content: Column, project: Column, location: Column) -> Column:
    """ARRAY<BOOLEAN> of the checks that a field is subject to."""
    n, low = F.length(content), F.lower(content)
    word = F.exists(F.array(*map(F.lit, SEO_WORDS)), lambda w: F.contains(low, w))
    words = F.size(F.split(content, "-"))
    return (
        F.when(field == "meta_title", F.array(n.between(50, 60), _named(content, project), _named(content, location)))
        .when(field == "meta_description", F.array(n.between(150, 160), word))
        .when(field == "url_slug", F.array(content.rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), words.between(3, 5)))
        .otherwise(F.array().cast("array<boolean>"))
    )


def seo_score(contents: DataFrame, key: str = "run_id") -> DataFrame:
    c = contents.select(key, seo_checks(F.col("field"), F.col("content"), F.col("project_name"), F.col("location")).alias("checks"))
    g = c.groupBy(key).agg(F.sum(F.size("checks")).alias("total"), F.sum(F.size(F.filter("checks", lambda x: x))).alias("passed_checks"))
    score = F.when(F.col("total") > 0, F.col("passed_checks") / F.col("total") * 100).otherwise(100.0)
    return g.select(key, "total", "passed_checks", score.alias("score")).withColumn("passed", F.col("score") >= 70)


def factual_accuracy(contents: DataFrame, key: str = "run_id") -> DataFrame:
    """Name and location must be named (else critical), the developer should be. Empty facts aren't checked."""
    g = contents.groupBy(key).agg(
        F.lower(F.array_join(F.array_sort(F.collect_list(F.struct("field", "content")))["content"], " ")).alias("all"),
        *(F.max(c).alias(c) for c in ("project_name", "developer", "location")),
    )
    facts = [F.col(c) for c in ("project_name", "developer", "location")]
    asked = sum((f != "").cast("int") for f in facts)
    held = sum(((f != "") & F.contains(F.col("all"), F.lower(f))).cast("int") for f in facts)
    critical = (F.col("project_name") == "") | F.contains(F.col("all"), F.lower("project_name"))
    critical = critical & ((F.col("location") == "") | F.contains(F.col("all"), F.lower("location")))
    return g.select(key, asked.alias("checks"), held.alias("held"), F.when(asked > 0, held / asked * 100).otherwise(100.0).alias("score"), critical.alias("passed"))


def report(contents: DataFrame, key: str = "run_id") -> DataFrame:
    """Mean of the four scores; passed without critical issues and from 70 on."""
    b, c, s, f = (x(contents, key).select(key, F.col("score").alias(n), F.col("passed").alias(f"{n}_ok")) for x, n in ((brand_compliance, "brand"), (character_limits, "limits"), (seo_score, "seo"), (factual_accuracy, "facts")))
    j = b.join(c, key).join(s, key).join(f, key)
    mean = (F.col("brand") + F.col("limits") + F.col("seo") + F.col("facts")) / 4
    return j.select(key, mean.alias("score"), (F.col("limits_ok") & F.col("facts_ok") & (mean >= 70)).alias("passed"))
