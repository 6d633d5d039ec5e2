"""Tables of page texts: headers, rows and kinds; and what a document's tables give together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.floorplans import floor_plan_rows, payment_plan_of, table_kind


def page_tables(raw: DataFrame) -> DataFrame:
    """doc_id, page_no, table_no, kind, headers, rows of raw tables (doc_id, page_no, table_no, cells ARRAY<ARRAY<STRING>>).

    The first row has the headers; blank rows go. Tables without a header or a row are left out.
    """
    stripped = F.transform("cells", lambda row: F.transform(row, lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")))
    t = raw.where(F.size("cells") >= 2).select("doc_id", "page_no", "table_no", stripped.alias("cells"))
    filled = F.filter(F.slice("cells", F.lit(2), F.size("cells")), lambda row: F.exists(row, lambda c: c != ""))
    t = t.select("doc_id", "page_no", "table_no", F.col("cells")[0].alias("headers"), filled.alias("rows")).where((F.size("headers") > 0) & (F.size("rows") > 0))
    return t.withColumn("kind", table_kind(F.col("headers"))).select("doc_id", "page_no", "table_no", "kind", "headers", "rows")


def document_tables(raw: DataFrame) -> DataFrame:
    """doc_id, tables, floor_plans (ARRAY<MAP>, in order of pages), payment_plan (MAP: the first that isn't empty)."""
    t = page_tables(raw).withColumn("place", F.struct("page_no", "table_no"))
    plans = F.when(F.col("kind") == "floor_plan", floor_plan_rows(F.col("headers"), F.col("rows")))
    payment = F.when(F.col("kind") == "payment_plan", payment_plan_of(F.col("headers"), F.col("rows")))
    t = t.select("doc_id", "place", plans.alias("plans"), payment.alias("payment"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("plans").isNotNull(), F.struct("place", F.col("plans").cast("array<map<string,string>>").alias("plans")))), lambda a, b: F.when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1).otherwise(0))
    first = F.min_by(F.when(F.size("payment") > 0, F.col("payment")), F.when(F.size("payment") > 0, F.col("place")))
    return t.groupBy("doc_id").agg(F.count("*").alias("tables"), F.flatten(F.transform(ordered, lambda x: x["plans"])).alias("floor_plans"), first.alias("payment_plan"))
