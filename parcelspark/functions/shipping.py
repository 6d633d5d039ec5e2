"""Makes this package importable in Python workers, wherever they run, and bounds what they are handed at once."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Bytes of an Arrow batch. Spark's default of 64 MB takes several times that of an executor's memory for each running task.
BATCH, DEFAULT, BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864", "67108864b", "64m"), "8m"


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's sources to the executors, once for each context; sets the size of Arrow batches where the session
    has Spark's default."""
    if spark.conf.get(BATCH) in DEFAULT:
        spark.conf.set(BATCH, BYTES)
    sc = spark.sparkContext
    if not getattr(sc, "_parcelspark_shipped", False):
        root = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="parcelspark-")) / "parcelspark_src.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(target))
        sc._parcelspark_shipped = True
    return spark
