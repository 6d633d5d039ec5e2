"""Feeds merged from several sources, and explicit row numbers over a whole table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged_feed(sources: list[DataFrame], time: str, ties: list[str], number: int, size: int) -> DataFrame:
    """A page of the newest rows of all sources, where each source gives its newest `size` rows only."""
    newest = [s.orderBy(F.desc(time), *ties).limit(size) for s in sources]
    return reduce(DataFrame.unionByName, newest).orderBy(F.desc(time), *ties).offset((number - 1) * size).limit(size)


def numbered(df: DataFrame, order: list[str], name: str = "seq") -> DataFrame:
    """Rows numbered from 0 in a total order, without bringing them into one task.

    Rows are range-partitioned; each partition's count gives the next one's first number.
    """
    d = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    counts = d.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row for each partition
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return d.withColumn("_inside", inside).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_inside") - 1).drop("_part", "_inside", "_before")
