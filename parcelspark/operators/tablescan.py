"""A table function over the tables of documents: pages go by in order, with one document's running state."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, MapType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeResult, OrderingColumn, PartitioningColumn

from ..functions.floorplans import floor_plan_rows, payment_plan_of
from .tables import page_tables

_MAP = MapType(StringType(), StringType())
SCHEMA = StructType([StructField("doc_id", LongType()), StructField("tables", LongType()), StructField("floor_plans", ArrayType(_MAP)), StructField("payment_plan", _MAP), StructField("seen", ArrayType(IntegerType()))])


class DocumentTables:
    """Takes a table with doc_id, page_no, table_no, plans and payment in any order of columns, and asks Spark for it by
    document, in order of pages and tables. The first payment plan that isn't empty wins; floor plans add up."""

    @staticmethod
    def analyze(rows) -> AnalyzeResult:
        if not rows.isTable or {"doc_id", "page_no", "table_no", "plans", "payment"} - {*rows.dataType.names}:
            raise ValueError("a table with doc_id, page_no, table_no, plans and payment is needed")
        return AnalyzeResult(SCHEMA, partitionBy=[PartitioningColumn("doc_id")], orderBy=[OrderingColumn("page_no"), OrderingColumn("table_no")])

    def __init__(self):
        self.doc_id, self.tables, self.plans, self.payment, self.pages = None, 0, [], None, []

    def eval(self, row) -> None:
        self.doc_id, self.tables = row["doc_id"], self.tables + 1
        self.plans += row["plans"] or []
        if not self.payment and row["payment"]:
            self.payment = row["payment"]
        if self.pages[-1:] != [row["page_no"]]:
            self.pages.append(row["page_no"])

    def terminate(self):
        if self.tables:
            yield self.doc_id, self.tables, self.plans, self.payment, self.pages


def scanned_tables(raw: DataFrame) -> DataFrame:
    """doc_id, tables, floor_plans, payment_plan, seen (pages with tables, in order): as tables.document_tables(), which
    gathers a document's tables before it orders them; here a task holds what one document has given so far."""
    t = page_tables(raw)
    plans = F.when(F.col("kind") == "floor_plan", floor_plan_rows(F.col("headers"), F.col("rows"))).cast("array<map<string,string>>")
    payment = F.when(F.col("kind") == "payment_plan", payment_plan_of(F.col("headers"), F.col("rows"))).cast("map<string,string>")
    t = t.select("doc_id", "page_no", "table_no", plans.alias("plans"), payment.alias("payment"))
    # the function travels by value, as the driver's process that analyzes it doesn't have the sources that executors get
    here = sys.modules[__name__]
    cloudpickle.register_pickle_by_value(here)
    try:
        raw.sparkSession.udtf.register("parcelspark_document_tables", F.udtf(DocumentTables))
        return raw.sparkSession.sql("SELECT * FROM parcelspark_document_tables(TABLE(SELECT * FROM {tables}))", tables=t)
    finally:
        cloudpickle.unregister_pickle_by_value(here)
