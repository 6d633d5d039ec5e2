"""Changes of tables as new tables: inserts, patches, upserts, versions, purges; folds of event histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inserted(base: DataFrame, rows: DataFrame, **defaults) -> DataFrame:
    """base and the new rows; columns that these lack get a default, or null."""
    types = dict(base.dtypes)
    missing = {c: F.lit(defaults.get(c)).cast(types[c]) for c in base.columns if c not in rows.columns}
    return base.unionByName(rows.withColumns(missing).select(*(F.col(c).cast(types[c]).alias(c) for c in base.columns)))


def patched(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Rows with the patch's non-null columns put in; keys that only the patch has change nothing."""
    columns = [c for c in patch.columns if c != key]
    p = patch.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in columns))
    j = base.join(p, F.col(key) == F.col("_key"), "left")
    return j.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns))


def upserted(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of both; where both have a key, the new row."""
    return base.join(rows.select(key), key, "left_anti").select(*rows.columns).unionByName(rows)


def soft_deleted(base: DataFrame, ids: DataFrame, key: str, at_us: int) -> tuple[DataFrame, DataFrame]:
    """The table with the rows marked inactive, and a revision for each that was active."""
    gone = ids.select(F.col(key).alias("_gone")).distinct()
    j = base.join(gone, F.col(key) == F.col("_gone"), "left")
    revisions = j.where(F.col("_gone").isNotNull() & F.col("is_active")).select(key, F.lit("is_active").alias("field"), F.lit("true").alias("old"), F.lit("false").alias("new"), F.lit(at_us).alias("at_us"))
    return j.withColumn("is_active", F.col("is_active") & F.col("_gone").isNull()).drop("_gone"), revisions


def with_key(fields: Column, key: Column, value: Column) -> Column:
    """A map with one key put or replaced."""
    return F.map_concat(F.map_filter(fields, lambda k, _: k != key), F.create_map(key, value))


def without_key(fields: Column, key: str) -> Column:
    return F.map_filter(fields, lambda k, _: k != key)


def merged_maps(left: Column, right: Column) -> Column:
    """Keys of both; the right value wins."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k)), right)


def row_of_reference(ref: Column) -> Column:
    """The row number of "C4", or of a bare number."""
    return F.nullif(F.regexp_extract(ref, r"(\d+)", 1), F.lit("")).cast("int")


def job_states(events: DataFrame) -> DataFrame:
    """job_id, status (the last), first started_us, completed_us of events (job_id, status, at_us, seq)."""
    s = F.col("status")
    return events.groupBy("job_id").agg(
        F.max_by("status", F.struct("at_us", "seq")).alias("status"), F.min(F.when(s == "processing", F.col("at_us"))).alias("started_us"),
        F.max(F.when(s.isin("completed", "failed", "cancelled"), F.col("at_us"))).alias("completed_us"),
    )


def retried(events: DataFrame, most: int = 3) -> DataFrame:
    """job_id, failures, status: a failed job is tried again until `most` failures."""
    g = events.where("status = 'failed'").groupBy("job_id").agg(F.count("*").alias("failures"))
    return g.withColumn("status", F.when(F.col("failures") < most, "processing").otherwise("failed"))


def complete_groups(jobs: DataFrame, group: str) -> DataFrame:
    """Groups all of whose jobs ended, with their number."""
    g = jobs.groupBy(group).agg(F.count("*").alias("jobs"), F.count_if(~F.col("status").isin("completed", "failed", "cancelled")).alias("open"))
    return g.where("open = 0").select(group, "jobs")


def purged(df: DataFrame, ended: Column, before_us: int) -> DataFrame:
    """Rows that stay: those not ended, or not before the limit."""
    return df.where(~F.coalesce(ended & (F.col("completed_us") < before_us), F.lit(False)))
