"""Full-text search over an inverted index: posting blocks in Parquet, sorted by term.

A block holds one term's postings among one range of ids: ids, hits and positions in order, and the most hits of any. A
query reads the blocks of its own terms only (the filter on terms reaches the scan), first their heads; ranges of ids that
lack a term are left out, and for the k best, ranges whose heads can't reach the k-th rank so far are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import search_terms, search_words, stem

#: Ids of one range; a block has at most as many postings.
RANGE = 8192
#: Ranges whose blocks of a term go to one file, so that a frequent term is written by many tasks.
RANGES_TOGETHER = 64
#: Ranges that are ranked first.
FIRST_RANGES = 16
SCHEMA = "term string, range long, most_hits int, ids array<long>, hits array<int>, positions array<array<int>>, part long"


@dataclass
class TextIndex:
    """Blocks of an index in `folder`, which driver and executors share; each add() writes a part of its own."""

    spark: SparkSession
    folder: str
    parts: int = 0

    def add(self, df: DataFrame, columns: list[str], key: str = "id") -> None:
        """Indexes more rows. Ids are whole numbers that the index hasn't got yet; rows without one take no part."""
        texts = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.concat_ws(" ", *columns).alias("text"))
        # texts move once, to their range of ids; all that is gathered from there on is gathered within a range
        texts = texts.withColumn("range", F.floor(F.col("id") / RANGE)).repartition("range")
        places = texts.select("range", "id", F.posexplode(search_words(F.col("text"))).alias("at", "word")).groupBy("range", "word").agg(F.collect_list(F.struct("id", "at")).alias("p"))
        # a word is stemmed once for a range, not at each place; several words may have one stem
        terms = places.groupBy("range", stem(F.col("word")).alias("term")).agg(F.sort_array(F.flatten(F.collect_list("p"))).alias("p"))
        # where the places of each id begin
        terms = terms.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("p") - 1), lambda i: (i == 0) | (F.get("p", i)["id"] != F.get("p", i - 1)["id"])))
        at = F.transform("starts", lambda s, i: F.transform(F.slice("p", s + 1, F.coalesce(F.get("starts", i + 1), F.size("p")) - s), lambda x: x["at"]))
        blocks = terms.select("term", "range", F.transform("starts", lambda s: F.get("p", s)["id"]).alias("ids"), at.alias("positions")).withColumn("hits", F.transform("positions", F.size))
        out = blocks.select("term", "range", F.array_max("hits").alias("most_hits"), "ids", "hits", "positions")
        out = out.repartition("term", F.floor(F.col("range") / RANGES_TOGETHER)).sortWithinPartitions("term", "range")
        # small row groups, so that a term's blocks are few of them
        out.write.option("parquet.block.size", 1 << 20).option("parquet.bloom.filter.enabled#term", "true").parquet(f"{self.folder}/part={self.parts}")
        self.parts += 1

    def blocks(self, terms: list[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMA).option("basePath", self.folder).parquet(*(f"{self.folder}/part={i}" for i in range(self.parts))).where(F.col("term").isin(terms))

    def _ranked(self, terms: list[str], ranges: DataFrame | None) -> DataFrame:
        blocks = self.blocks(terms)
        if ranges is not None:
            blocks = blocks.join(ranges.select("part", "range"), ["part", "range"], "left_semi")
        found = blocks.select("term", F.explode(F.arrays_zip("ids", "hits")).alias("p")).groupBy(F.col("p.ids").alias("id"))
        return found.agg(F.count("*").alias("terms"), F.sum("p.hits").alias("rank")).where(F.col("terms") == len(terms)).select("id", "rank")

    def search(self, asked: str, limit: int | None = None) -> DataFrame:
        """id, rank (hits) of rows that hold every term of `asked`; with a limit the best, ties by id. Nothing asked finds nothing."""
        terms = self.spark.range(1).select(F.array_distinct(search_terms(F.lit(asked))).alias("t")).first()["t"]
        if not terms or not self.parts:
            return self.spark.createDataFrame([], "id long, rank long")
        if limit is None:
            return self._ranked(terms, None)
        heads = self.blocks(terms).groupBy("part", "range").agg(F.count("*").alias("terms"), F.sum("most_hits").alias("bound")).where(F.col("terms") == len(terms))
        # heads are a row for each range that has all terms; what is ranked first is chosen by a total order
        first = heads.orderBy(F.desc("bound"), "part", "range").limit(FIRST_RANGES).collect()
        schema = "part long, range long, bound long"
        chosen = self.spark.createDataFrame([(int(r["part"]), r["range"], r["bound"]) for r in first], schema)
        best = self._ranked(terms, chosen).orderBy(F.desc("rank"), "id").limit(limit).collect()
        out = self.spark.createDataFrame([(r["id"], r["rank"]) for r in best], "id long, rank long")
        if len(first) < FIRST_RANGES or (len(best) == limit and first[-1]["bound"] < best[-1]["rank"]):
            return out  # no other range, or none that could do better
        least = best[-1]["rank"] if len(best) == limit else 0
        rest = heads.where(F.col("bound") >= least).join(F.broadcast(chosen), ["part", "range"], "left_anti")
        return out.unionByName(self._ranked(terms, rest)).orderBy(F.desc("rank"), "id").limit(limit)

    def phrase(self, asked: str) -> DataFrame:
        """id of rows in which the terms of `asked` follow one another (words of the stop list aside)."""
        terms = self.spark.range(1).select(search_terms(F.lit(asked)).alias("t")).first()["t"]
        if not terms or not self.parts:
            return self.spark.createDataFrame([], "id long")
        places = self.blocks(sorted({*terms})).select("term", F.explode(F.arrays_zip("ids", "positions")).alias("p")).select(F.col("p.ids").alias("id"), "term", "p.positions")
        order = F.array(*(F.struct(F.lit(t).alias("term"), F.lit(i).alias("i")) for i, t in enumerate(terms)))
        starts = places.select("id", "positions", F.explode(F.filter(order, lambda x: x["term"] == F.col("term"))["i"]).alias("i")).select("id", "i", F.explode(F.transform("positions", lambda a: a - F.col("i"))).alias("start"))
        return starts.groupBy("id", "start").agg(F.count_distinct("i").alias("n")).where(F.col("n") == len(terms)).select("id").distinct()


def fingerprint(df: DataFrame) -> tuple:
    """Names, sizes and times of the files that df is read from."""
    spark = df.sparkSession
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    status = [(f, path(f)) for f in sorted(df.inputFiles())]
    return tuple((f, s.getLen(), s.getModificationTime()) for f, s in ((f, p.getFileSystem(conf).getFileStatus(p)) for f, p in status))


def kept_index(df: DataFrame, columns: list[str], folder) -> TextIndex:
    """The index of df in this context, made anew when one of its files has changed. folder(): where a new one goes."""
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if not hasattr(sc, "_parcelspark_indexes"):
        sc._parcelspark_indexes = {}
    at = fingerprint(df), tuple(columns)
    if at not in sc._parcelspark_indexes:
        made = TextIndex(spark, folder())
        made.add(df, columns)
        sc._parcelspark_indexes[at] = made
    return sc._parcelspark_indexes[at]
