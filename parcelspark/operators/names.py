"""Mapping of names to keys: equal, else one within the other, by a join on rare q-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Q = 3


def _grams(s: Column, shortest: int) -> Column:
    """Distinct substrings of `shortest` to Q characters."""
    of = lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: i + n - 1 <= F.length(s)), lambda i: F.substr(s, i, F.lit(n)))
    return F.array_distinct(F.flatten(F.array(*(of(n) for n in range(shortest, Q + 1)))))


def _within(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """i, o: strings of inner (s) that strings of outer (s) contain.

    A string within another has all its grams there, so it is joined by that one which the fewest others have; strings with
    a gram that no other has are within none. Strings shorter than a gram are grams themselves.
    """
    own = F.when(F.length("s") < Q, F.array("s")).otherwise(_grams(F.col("s"), Q))
    all_ = outer.select(F.col("s").alias("o"), F.explode(_grams(F.col("s"), 1)).alias("gram"))
    counts = all_.groupBy("gram").agg(F.count("*").alias("held"))
    asked = inner.where("s <> ''").select(F.col("s").alias("i"), F.size(own).alias("grams"), F.explode(own).alias("gram"))
    rare = asked.join(counts, "gram").groupBy("i", "grams").agg(F.count("*").alias("found"), F.min_by("gram", F.struct("held", "gram")).alias("gram")).where("found = grams")
    return rare.join(all_, "gram").where(F.contains("o", "i")).select("i", "o")


def mapped_names(names: DataFrame, keys: DataFrame) -> DataFrame:
    """name, status, key: each distinct name with the key that equals it (in any case): MATCH, else with the least key of
    those that it contains or that contain it: PARTIAL, else without: UNMATCHED; and each key that no name has got: UNUSED,
    without a name."""
    n, k = names.select("name").distinct().withColumn("s", F.upper("name")), keys.select("key").distinct().withColumn("s", F.upper("key"))
    equal = n.join(k, "s").groupBy("name").agg(F.min("key").alias("key")).withColumn("status", F.lit("MATCH"))
    rest = n.join(equal, "name", "left_anti")
    some, strings = rest.select("s").distinct(), k.select("s").distinct()
    pairs = _within(strings, some).select(F.col("o").alias("s"), F.col("i").alias("t")).unionByName(_within(some, strings).select(F.col("i").alias("s"), F.col("o").alias("t"))).distinct()
    near = rest.join(pairs, "s").join(k.withColumnRenamed("s", "t"), "t").groupBy("name").agg(F.min("key").alias("key")).withColumn("status", F.lit("PARTIAL"))
    found = equal.unionByName(near)
    none = n.join(found, "name", "left_anti").select("name", F.lit("UNMATCHED").alias("status"), F.lit(None).cast("string").alias("key"))
    unused = k.join(found, "key", "left_anti").select(F.lit(None).cast("string").alias("name"), F.lit("UNUSED").alias("status"), "key")
    return found.select("name", "status", "key").unionByName(none).unionByName(unused)
