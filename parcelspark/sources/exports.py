"""Export shapes: CSV and JSON rows, file manifests, sheet cells; and their writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of the CSV export, in order.
CSV_COLUMNS = ("id", "name", "developer", "location", "emirate", "starting_price", "property_type", "workflow_status", "created_at")
PRIVATE = ("created_by", "last_modified_by")
TIERS, FORMATS = ("web", "full"), ("webp", "jpg")


def csv_columns(projects: DataFrame) -> DataFrame:
    """Projects as the CSV export shows them: money as text, times as ISO text in UTC."""
    at = F.date_format(F.to_utc_timestamp(F.timestamp_micros("created_us"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    return projects.withColumn("created_at", at).withColumn("starting_price", F.col("starting_price").cast("string")).select(*CSV_COLUMNS)


def json_rows(df: DataFrame, key: str) -> DataFrame:
    """key and the row as JSON text, without columns that name persons."""
    return df.drop(*PRIVATE).select(key, F.to_json(F.struct(*[c for c in df.columns if c not in PRIVATE])).alias("json"))


def manifest(images: DataFrame) -> DataFrame:
    """The files of a package: each image in every tier and format. The small dimension is an array, not a join."""
    kinds = F.array(*(F.struct(F.lit(t).alias("tier"), F.lit(f).alias("format")) for t in TIERS for f in FORMATS))
    return images.withColumn("k", F.explode(kinds)).select("image_id", F.concat("k.tier", F.lit("/"), "category", F.lit("/"), "image_id", F.lit("."), "k.format").alias("file"))


def cell_values(contents: DataFrame, registry: DataFrame, keys: list[str]) -> DataFrame:
    """Non-empty contents with the sheet cell (C and the row) that the registry gives their field."""
    # the registry is a list of template fields, about a hundred rows
    placed = contents.where("content is not null and content <> ''").join(F.broadcast(registry), "field")
    return placed.select(*keys, F.concat(F.lit("C"), F.col("row")).alias("cell"), "content")


def write_csv(projects: DataFrame, path: str) -> None:
    csv_columns(projects).write.option("header", True).csv(path)


def write_packages(df: DataFrame, path: str) -> None:
    """Packages as JSON lines, a folder for each project range that Spark's writer makes."""
    df.write.json(path)
