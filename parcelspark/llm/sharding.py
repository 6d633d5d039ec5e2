"""Shards along a Hilbert curve over metadata.

Language, source and text length are quantised to a grid; documents are ordered by the Hilbert index of their cell
and the order is cut into runs of equal row counts. Rows near each other in a shard agree in all three dimensions,
so that per-file ranges of them prune files for filters on any one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hilbert_index, partitions, table

BITS, DIMS = 4, 3
CELLS = 1 << (BITS * DIMS)


def _curve() -> Column:
    """The Hilbert index of every grid cell, by the cell's number (a constant of CELLS entries)."""
    n = np.arange(CELLS)
    axes = np.stack([n >> 2 * BITS, (n >> BITS) & ((1 << BITS) - 1), n & ((1 << BITS) - 1)], 1)
    return F.split(F.lit(",".join(map(str, hilbert_index(axes, BITS)))), ",").cast("array<int>")


def _ranks(docs: DataFrame, name: str, levels: int) -> DataFrame:
    """Each distinct value of a text column with its level: values in code-point order, dealt evenly (null first)."""
    values = docs.groupBy(F.col(name).alias("value")).agg(F.lit(1).alias("one"))
    place = F.row_number().over(Window.orderBy(F.col("value").asc_nulls_first()))
    of = F.count("*").over(Window.partitionBy())
    return values.select("value", F.floor((place - 1) * levels / of).cast("int").alias(f"{name}_level"))


def hilbert_cells(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """docs with size (UTF-8 bytes of the text plus 8), text_crc32 and cell (Hilbert index of lang, source and size).

    lang and source take levels by rank among their distinct values, size by its binary logarithm; nulls are
    values of their own, a null text counts as empty. Other columns of docs, whatever their names, are not read, but
    those of `carried` (text, n_chars), which come along.
    """
    size = (F.octet_length(F.coalesce("text", F.lit(""))) + 8).cast("long")
    d = docs.select("doc_id", "lang", "source", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), *carried)
    top = (1 << BITS) - 1
    for name in ("lang", "source"):
        levels = _ranks(docs.select(name), name, 1 << BITS)
        d = d.join(levels, d[name].eqNullSafe(levels["value"]), "left").drop("value")
    long = F.least(F.floor(F.log2(F.col("size") / 8.0)).cast("int"), F.lit(top))
    cell = F.col("lang_level") * (1 << 2 * BITS) + F.col("source_level") * (1 << BITS) + long
    return d.select("doc_id", "lang", "source", "size", "text_crc32", F.element_at(_curve(), cell + 1).alias("cell"), *carried)


def assign_shards(docs: DataFrame, shards: int = 24, rows_a_part: int = 1 << 20, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, source, size, text_crc32, cell, shard, slot: the curve cut into runs of equal row counts.

    Law "rows": shards differ by at most one row. The order is (cell, part, doc_id, text_crc32, size): a cell with
    over rows_a_part rows is split by a hash of doc_id into as many parts as its count asks for, so that no task
    ranks more than about rows_a_part rows, whatever share of the input falls into one cell. Offsets come from
    counts of (cell, part). Equal rows are interchangeable, and any of them may take either slot. An empty table
    gives no rows.
    """
    cells = hilbert_cells(docs, carried)
    # at most CELLS rows, so it can be broadcast
    parts = cells.groupBy("cell").agg(F.ceil(F.count("*") / rows_a_part).alias("parts"))
    d = cells.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts"))).drop("parts")
    counts = d.groupBy("cell", "part").agg(F.count("*").alias("n"))
    order = Window.orderBy("cell", "part")
    offsets = counts.select("cell", "part", (F.sum("n").over(order) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("rows"))
    inside = F.row_number().over(Window.partitionBy("cell", "part").orderBy("doc_id", "text_crc32", "size"))
    ranked = d.withColumn("inside", inside - 1).join(offsets, ["cell", "part"])
    place = F.col("before") + F.col("inside")
    shard = F.expr(f"cast(((before + inside) * {shards}) div rows as int)")
    # the first place of a shard: the least p with p * shards >= shard * rows
    slot = place - F.expr(f"(cast(shard as bigint) * rows + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard).select("doc_id", "lang", "source", "size", "text_crc32", "cell", "shard", slot.cast("long").alias("slot"), *carried)


def write_shards(docs: DataFrame, path: str, shards: int = 24, rows_a_file: int = 1 << 18) -> DataFrame:
    """Writes documents with their slot under path/shard=N; returns each shard's ranges of lang, source and size.

    A shard is cut along the curve into runs of rows_a_file slots, each written in order by one task, so that a shard of
    any size is spread over tasks and the ranges of its files prune too. Every row is written once, repeated ones too.
    """
    placed = assign_shards(docs, shards, carried=("text", "n_chars")).drop("text_crc32", "cell")
    run = F.floor(F.col("slot") / rows_a_file)
    out = placed.withColumn("run", run).repartition(partitions(docs.sparkSession), "shard", "run").sortWithinPartitions("shard", "run", "slot")
    out.drop("run").write.partitionBy("shard").parquet(path)
    return manifest(docs.sparkSession.read.schema("doc_id long, lang string, source string, size long, slot long, text string, n_chars long, shard int").parquet(path))


def manifest(sharded: DataFrame) -> DataFrame:
    """What a reader prunes shards by."""
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), *(f(c).alias(f"{n}_{c}") for c in ("lang", "source", "size") for n, f in (("min", F.min), ("max", F.max))))


def op7_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    placed = assign_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
