"""Values of one field from several sources, brought to one with a confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.floorplans import unit_key
from ..functions.units import reconciled_areas

#: Fields whose numbers are taken from the text rather than from a model.
NUMERIC = ("price_min", "price_max", "price_per_sqft", "total_units", "floors", "total_sqft", "balcony_sqft", "builtup_sqft", "bedrooms_count", "bathrooms_count")


def values_match(a: Column, b: Column, numeric: Column) -> Column:
    """Numbers less than 1 apart, or equal text without case and outer blanks."""
    near = F.coalesce(F.abs(a.try_cast("double") - b.try_cast("double")) < 1, F.lit(False))
    return F.when(numeric, near).otherwise(F.lower(F.trim(a)) == F.lower(F.trim(b)))


def reconciled(field: Column, regex: Column, llm: Column, found: Column) -> Column:
    """STRUCT(value, source, confidence, flagged): table, agreement, then by kind of field; values are text."""
    numeric = field.isin(*NUMERIC)
    give = lambda v, s, c, f: F.struct(v.alias("value"), F.lit(s).alias("source"), F.lit(c).alias("confidence"), (F.lit(f) if isinstance(f, bool) else f).alias("flagged"))
    both = regex.isNotNull() & llm.isNotNull()
    return (
        F.when(found.isNotNull(), give(found, "table", 0.99, F.coalesce(llm.isNotNull() & (llm != found) & numeric, F.lit(False))))
        .when(both & values_match(regex, llm, numeric), give(regex, "agreement", 0.98, False))
        .when(both & numeric, give(regex, "regex", 0.85, True))
        .when(both, give(llm, "llm", 0.80, True))
        .when(regex.isNotNull(), give(regex, "regex", 0.80, False))
        .when(llm.isNotNull(), give(llm, "llm", 0.70, False))
        .otherwise(give(F.lit(None).cast("string"), "none", 0.0, False))
    )


def reconciled_fields(long: DataFrame) -> DataFrame:
    """value, source, confidence, flagged beside the keys of rows (field, regex, llm, found and any keys)."""
    keys = [c for c in long.columns if c not in ("regex", "llm", "found")]
    return long.select(*keys, reconciled(F.col("field"), F.col("regex"), F.col("llm"), F.col("found")).alias("r")).select(*keys, "r.*")


def by_confidence(text: Column, text_confidence: Column, vision: Column, vision_confidence: Column) -> Column:
    """The text's value only where it is strictly surer; a lone value as it is."""
    return F.when(vision.isNull() | (text.isNotNull() & (text_confidence > vision_confidence)), F.coalesce(text, vision)).otherwise(vision)


def merged_plans(plans: DataFrame) -> DataFrame:
    """One plan for each document and unit key, from rows (doc_id, seq, unit_type, suite_sqft, balcony_sqft, total_sqft, bathrooms, confidence).

    Plans without a sub-type join the only specific key of their bedroom count; with several they are dropped. The
    plan with the most areas (then the surest, then the first) leads; its nulls are filled from the next ones, where
    zero counts as nothing; then areas are reconciled. Plans without a label stay as they are.
    """
    p = plans.withColumn("key", unit_key(F.col("unit_type")))
    p = p.withColumn("bed", F.col("key.bed")).withColumn("sub", F.col("key.sub")).drop("key")
    beds = Window.partitionBy("doc_id", "bed")
    specific = F.size(F.array_distinct(F.collect_list(F.when(F.col("sub") != "", F.col("sub"))).over(beds)))
    only = F.max(F.when(F.col("sub") != "", F.col("sub"))).over(beds)
    p = p.withColumn("specific", specific).withColumn("only", only)
    labelled = p.where(F.col("unit_type").isNotNull() & ~((F.col("sub") == "") & (F.col("specific") > 1)))
    own = F.when((F.col("sub") == "") & (F.col("specific") == 1), F.col("only")).otherwise(F.col("sub"))
    areas = ("suite_sqft", "balcony_sqft", "total_sqft")
    score = sum(F.coalesce((F.col(a) > 0).cast("int"), F.lit(0)) for a in areas)
    labelled = labelled.withColumn("sub", own).withColumn("score", score)
    w = Window.partitionBy("doc_id", "bed", "sub").orderBy(F.desc("score"), F.desc("confidence"), "seq")
    frame = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = {a: F.coalesce(F.first(a).over(frame), F.first(F.nullif(F.col(a), F.lit(0.0)), ignorenulls=True).over(frame)) for a in areas}
    filled["bathrooms"] = F.first("bathrooms", ignorenulls=True).over(frame)
    lead = labelled.select("doc_id", "seq", "unit_type", "bed", "sub", *(c.alias(n) for n, c in filled.items()), F.row_number().over(w).alias("place"), F.count("*").over(frame).alias("members"))
    lead = lead.where("place = 1")
    r = reconciled_areas(*(F.col(a) for a in areas))
    lead = lead.withColumn("r", r)
    for a, n in zip(areas, ("suite", "balcony", "total")):  # areas are reconciled after a merge only
        lead = lead.withColumn(a, F.when(F.col("members") > 1, F.col(f"r.{n}")).otherwise(F.col(a)))
    cols = ["doc_id", "seq", "unit_type", "bed", "sub", *areas, "bathrooms", "members"]
    bare = p.where("unit_type is null").withColumn("members", F.lit(1).cast("long"))
    return lead.select(*cols).unionByName(bare.select(*cols))
