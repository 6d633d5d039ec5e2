"""The corpus pipeline: stages that each take documents and give documents, the last one packed sequences.

toxicity    documents that the pattern grammar scores at a half or more go
quality     documents that the rule ensemble scores under a half go
near_dedup  of each group of near copies (0.8 of the shingles of five words) the document with the smallest doc_id stays
mixing      sources are mixed to their target weights: a row for each passage that an output shard of the mix takes
packing     token sequences of at most 4096 ids along a space-filling curve, with the ids of each piece

Both classifiers learn from the labelled documents among the stage's own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parcelspark.functions.shipping import ship
from parcelspark.llm import common, mixing, neardup, packing, quality, toxicity

#: Similarity of near copies in the stage; op3's own limit is 85.
NEAR_PERCENT = 80


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, common.table(ship(spark), sf_dir, "labels"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.of_quality(docs, common.table(ship(spark), sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return neardup.without_copies(docs.select(*common.DOCUMENT_COLUMNS), NEAR_PERCENT)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, with_ids=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: SQL can't express the classifiers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again; what this run wrote before goes once a stage is written."""
    docs = common.table(spark, sf_dir, "documents")
    with common.recorded() as own:
        for name, stage in STAGES:
            docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
            common.cleared(spark, keep=docs, only=own)
    return docs
