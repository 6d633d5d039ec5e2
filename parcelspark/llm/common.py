"""Helpers that the training-data operators share: table reads, the shared folder, words, hashes."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than the space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A temporary one where none is set and all run in one process (tests);
    on a cluster without one, each executor would write to its own disk: that raises."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(sc, "_parcelspark_dir", None)
    if own is None:
        own = sc._parcelspark_dir = "file://" + tempfile.mkdtemp(prefix="parcelspark-")
    return own


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, outlives lost executors, is computed once.

    Results are read from such tables until they are written elsewhere; forget() and cleared() delete them after that.
    """
    spark = df.sparkSession
    path = owned(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._parcelspark_path = path
    return out


def _tables(spark: SparkSession) -> list[str]:
    """Paths of the tables that written() has made in this context and that are still there."""
    sc = spark.sparkContext
    if not hasattr(sc, "_parcelspark_tables"):
        sc._parcelspark_tables = []
    return sc._parcelspark_tables


_run = threading.local()


@contextmanager
def recorded():
    """The paths that this thread writes inside, as they come: what one run may delete of its own."""
    before, _run.paths = getattr(_run, "paths", None), []
    try:
        yield _run.paths
    finally:
        _run.paths = before


def owned(spark: SparkSession, path: str) -> str:
    """path, known to cleared() from now on."""
    _tables(spark).append(path)
    if getattr(_run, "paths", None) is not None:
        _run.paths.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _tables(spark).remove(path)


def forget(df: DataFrame) -> None:
    """Deletes the table of written() that df was read from, which nothing needs any more."""
    if getattr(df, "_parcelspark_path", None) in _tables(df.sparkSession):
        _delete(df.sparkSession, df._parcelspark_path)


def tables(spark: SparkSession) -> set[str]:
    """The tables of written() in this context that are there now."""
    return {*_tables(spark)}


def cleared(spark: SparkSession, keep: DataFrame | None = None, older: set[str] = frozenset(), only: list[str] | None = None) -> None:
    """Deletes what was written in this context (of that `only` the paths of one run, if given) but the table of `keep` and the
    `older` ones: for when results that are read from it are stored elsewhere."""
    for path in (tables(spark) if only is None else tables(spark) & {*only}) - older - {getattr(keep, "_parcelspark_path", None)}:
        _delete(spark, path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more; else they stay until the driver happens
    to collect its garbage. For between steps that were written as tables."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(doc_id: Column | str, by: int) -> Column:
    """crc32 of the id as text, modulo by: the fold of a document."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % by


def runs(texts: pa.Array, most_bytes: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Bounds of slices whose texts have at most most_bytes bytes together (or one text)."""
    start = total = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if total and total + n > most_bytes:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def sliced(batches: Iterator[pa.RecordBatch], most_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut into such slices by their column text, so that a worker holds few texts as objects."""
    for b in batches:
        for lo, hi in runs(b["text"], most_bytes):
            yield b.slice(lo, hi - lo)


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string or binary column, empty for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def lower_words(text: bytes) -> list[bytes]:
    """Words with A-Z lower-cased. On bytes, lower() and split() touch exactly A-Z and exactly U+0009-000D and the space."""
    return text.lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mixed(h: np.ndarray) -> np.ndarray:
    """The public murmur3 64-bit finaliser, so that sums of hashes spread over all bits."""
    h = h ^ (h >> _S33)
    h = h * _M1
    h = h ^ (h >> _S33)
    h = h * _M2
    return h ^ (h >> _S33)


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (n x d, each below 2**bits), by Skilling's public transpose algorithm (2004)."""
    x = axes.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            up = (x[i] & q) != 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out
