"""Operators on pages of documents: (doc_id, page_no, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def joined_pages(pages: DataFrame, separator: str) -> DataFrame:
    """One text for each document, pages in order."""
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return pages.groupBy("doc_id").agg(F.array_join(ordered["text"], separator).alias("text"))


def page_context(pages: DataFrame, width: int, separator: str = "\n") -> DataFrame:
    """Each page with the texts of pages up to `width` numbers away; a range frame, as page numbers may have gaps."""
    w = Window.partitionBy("doc_id").orderBy("page_no").rangeBetween(-width, width)
    return pages.withColumn("context", F.array_join(F.collect_list("text").over(w), separator))


def native_over_ocr(native: DataFrame, ocr: DataFrame) -> DataFrame:
    """For each page the native text, or else the recognised one."""
    o = ocr.withColumnRenamed("text", "ocr")
    return native.join(o, ["doc_id", "page_no"], "full_outer").select("doc_id", "page_no", F.coalesce("text", "ocr").alias("text"))
