"""Extraction scored against ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linkage import first_per_key


def scorecard(plans: DataFrame, truth: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """For each document: plans, matched (by label, the first row of truth), area checks, wrong bedrooms, false data.

    An area passes where it is off by less than `tolerance`, strictly; an absent one is null, not false.
    """
    t = first_per_key(truth.where("unit_type is not null"), ["doc_id", "unit_type"], ["row_no"])
    t = t.select("doc_id", "unit_type", "row_no", F.col("total_sqft").alias("want"), F.col("bedrooms").alias("beds"))
    j = plans.join(t, ["doc_id", "unit_type"], "left")
    checked = F.col("want") > 0
    near = F.abs(F.col("total_sqft") - F.col("want")) / F.col("want") < tolerance
    g = j.groupBy("doc_id").agg(
        F.count("*").alias("plans"), F.count("row_no").alias("matched"), F.count_if(checked & near).alias("area_pass"), F.count_if(checked & ~near).alias("area_fail"),
        F.count_if(checked & F.col("total_sqft").isNull()).alias("area_null"), F.count_if(F.col("bedrooms") != F.col("beds")).alias("bed_fail"),
    )
    return g.withColumn("false_data", F.col("area_fail") + F.col("bed_fail"))


def corpus_scorecard(scores: DataFrame) -> DataFrame:
    """Sums over documents; the false rate counts areas only."""
    s = scores.agg(*(F.sum(c).alias(c) for c in ("plans", "area_pass", "area_fail", "area_null")))
    return s.withColumn("false_rate", F.round(100.0 * F.col("area_fail") / (F.col("area_pass") + F.col("area_fail") + F.col("area_null")), 1))
