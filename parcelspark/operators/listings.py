"""Searches over a listing of files (file_id, name, mime, folder, trashed): by name and by type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _there(files: DataFrame, folder: str | None) -> DataFrame:
    kept = files.where(~F.col("trashed"))
    return kept if folder is None else kept.where(F.col("folder") == folder)


def files_named(files: DataFrame, name: str, folder: str | None = None, exact: bool = False) -> DataFrame:
    """Files that aren't trashed whose name is, or holds, the given text; its quotes and backslashes stand for themselves."""
    test = F.col("name") == name if exact else F.contains("name", F.lit(name))
    return _there(files, folder).where(test)


def files_of_type(files: DataFrame, mime: str, folder: str | None = None) -> DataFrame:
    """Files of a media type that aren't trashed."""
    return _there(files, folder).where(F.col("mime") == mime)
