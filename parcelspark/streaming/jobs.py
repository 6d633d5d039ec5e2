"""Job histories as streams: current states, windows of events with late data."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import job_states


def job_state_stream(events: DataFrame) -> DataFrame:
    """The current state of each job, kept up to date (update or complete mode)."""
    return job_states(events)


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type in tumbling windows of event time; later ones than the watermark are left out."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events with no longer pause than `gap`."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return w.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables that driver and executors share. A temporary one where none is set and all run in one
    process; on a cluster without one that raises, as each executor would write to its own disk."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None)
    if found:
        path = f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    elif sc.master == "local" or sc.master.startswith("local["):
        path = "file://" + tempfile.mkdtemp(prefix=f"{name}-")
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(sc, "_parcelspark_folders"):
        sc._parcelspark_folders = []
    sc._parcelspark_folders.append(path)
    return path


def cleared_folders(spark: SparkSession) -> None:
    """Deletes the folders of shared_folder() in this context: for when results that are read from them are stored elsewhere.
    Text indexes in them are made anew when they are asked again."""
    sc = spark.sparkContext
    for path in getattr(sc, "_parcelspark_folders", []):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    sc._parcelspark_folders, sc._parcelspark_indexes = [], {}
