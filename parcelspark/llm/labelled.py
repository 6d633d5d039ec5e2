"""Bounded samples of labelled documents, which classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a fit uses; with fewer, all. Drawn by a hash of doc_id.
MOST_LABELLED = 20_000
_RANGE = 1 << 30


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int = MOST_LABELLED) -> DataFrame:
    """text (empty for null) and label (0 or 1) of about `most` documents with a label at most.

    Rows of labels that repeat a doc_id count as one, 1 winning; null labels and null ids are left out. The hash
    draws doc_ids independently of their order. The drawn labels are bounded by `most`, so they are broadcast.
    """
    kept = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label)).cast("double").alias("label"))
    kept = kept.withColumn("draw", F.pmod(F.xxhash64("doc_id"), F.lit(_RANGE)))
    n = kept.count()
    if n > most:
        kept = kept.where(F.col("draw") < int(_RANGE * most / n))
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.join(F.broadcast(kept.select("doc_id", "label")), "doc_id").select("text", "label")
