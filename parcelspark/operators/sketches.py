"""Aggregates that are stored by day and merged to longer times without the rows: counts, sums and quantile sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size of a sketch: a quantile's rank is off by about 1.7 / SIZE ** 0.9 of all values (0.3 %), however many are merged.
SIZE = 1000


def daily(df: DataFrame, day: Column, value: Column) -> DataFrame:
    """day, n, total, low, high and sketch of each day's values that aren't null."""
    v = df.select(day.alias("day"), value.cast("double").alias("v")).where("v is not null and day is not null").groupBy("day")
    return v.agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.min("v").alias("low"), F.max("v").alias("high"), F.kll_sketch_agg_double("v", F.lit(SIZE)).alias("sketch"))


def stored(days: DataFrame, folder: str) -> None:
    """Adds daily() rows to a table in `folder`, a partition for each day; a day that comes again replaces what it had."""
    days.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(folder)


def merged(spark: SparkSession, folder: str, period: Column, quantiles: dict[str, float]) -> DataFrame:
    """period, n, total, low, high and the quantiles by name of each period, a column over `day`; reads no rows but days'."""
    g = spark.read.parquet(folder).groupBy(period.alias("period"))
    out = g.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch", F.lit(SIZE)).alias("s"))
    return out.select("period", "n", "total", "low", "high", *(F.kll_sketch_get_quantile_double("s", F.lit(q)).alias(name) for name, q in quantiles.items()))
