"""Files: listings, headers, JSON packages and Markdown tables, read by Spark's own sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: First bytes of each media type (fixed values of the formats).
MAGIC = (
    (b"\x89PNG\r\n\x1a\n", "image/png"),
    (b"\xff\xd8\xff", "image/jpeg"),
    (b"GIF8", "image/gif"),
    (b"RIFF", "image/webp"),
    (b"II*\x00", "image/tiff"),
    (b"MM\x00*", "image/tiff"),
    (b"%PDF-", "application/pdf"),
    (b"<!DOCTYPE", "text/html"),
)


def media_type(content: Column) -> Column:
    """By the first bytes; PNG where none is known."""
    out = None
    for head, kind in MAGIC:
        test = F.substring(content, 1, len(head)) == F.lit(bytearray(head))
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("image/png")


def is_pdf(content: Column) -> Column:
    return F.substring(content, 1, 5) == F.lit(bytearray(b"%PDF-"))


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, modificationTime of files; contents are pruned away, so they are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", "modificationTime")


def packages(spark: SparkSession, path: str, schema: StructType | str, lines: bool = False) -> DataFrame:
    """JSON packages under an explicit schema, one in a file or (lines) one in a line; what doesn't parse gives null columns."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def markdown_registry(spark: SparkSession, path: str) -> DataFrame:
    """section, field, row, char_limit, required of the tables of Markdown files.

    A table's rows follow a line of dashes and end at the next heading; "-" is no limit; yes, true and 1 are true.
    """
    text = spark.read.text(path, wholetext=True)
    return registry_rows(text.select(F.input_file_name().alias("file"), F.col("value").alias("text")))


def registry_rows(texts: DataFrame) -> DataFrame:
    sections = texts.select("file", F.posexplode(F.split("text", r"(?m)^## ")).alias("no", "part"))
    lines = sections.select("file", "no", F.trim(F.substring_index("part", "\n", 1)).alias("section"), F.posexplode(F.split("part", "\n")).alias("line_no", "line"))
    cells = lines.where(F.col("line").startswith("|") & ~F.col("line").rlike(r"^\|[\s:|\-]+$")).withColumn("cells", F.transform(F.split(F.regexp_replace("line", r"^\||\|\s*$", ""), r"\|"), lambda x: F.trim(x)))
    named = cells.where((F.size("cells") >= 4) & F.expr("try_cast(cells[1] as int) is not null"))
    limit = F.when(F.col("cells")[2] != "-", F.expr("try_cast(cells[2] as int)"))
    return named.select("file", "section", F.col("cells")[0].alias("field"), F.expr("try_cast(cells[1] as int)").alias("row"), limit.alias("char_limit"), F.lower(F.col("cells")[3]).isin("yes", "true", "1").alias("required"))


def pdf_pages(spark: SparkSession, path: str, extract, most_bytes: int = 500 << 20) -> DataFrame:
    """path, page_no, text, rejected: pages of PDF files; `extract` turns bytes into page texts, in Arrow batches on the executors.

    A file that is too large or no PDF has one row without a page, which says so in `rejected`; its content isn't read further.
    """
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = [(p, i + 1, t, None) for p, c in zip(b["path"], b["content"]) for i, t in enumerate(extract(bytes(c)))]
            yield pd.DataFrame(rows, columns=["path", "page_no", "text", "rejected"])

    schema = "path string, page_no int, text string, rejected string"
    every = spark.read.format("binaryFile").load(path)
    small = every.where(F.col("length") <= most_bytes)
    pages = small.where(is_pdf(F.col("content"))).select("path", "content").mapInPandas(run, schema)
    away = lambda df, why: df.select("path", F.lit(None).cast("int").alias("page_no"), F.lit(None).cast("string").alias("text"), F.lit(why).alias("rejected"))
    return pages.unionByName(away(every.where(F.col("length") > most_bytes), "too large")).unionByName(away(small.where(~is_pdf(F.col("content"))), "no PDF"))
