"""Tables that keep their changes: a commit rewrites the hash buckets it touches, and every version can be read back.

Rows lie in Parquet folders by version and bucket of their key. A manifest for each version says which version of each
bucket belongs to it; it is one small file whose creation succeeds for one writer only, so two writers from the same version
can't both commit. What a lost commit has written is deleted. There is no other format: manifests are JSON, data is Spark's.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 32


class Conflict(RuntimeError):
    """Another writer has committed from the same version."""


class VersionedTable:
    def __init__(self, spark: SparkSession, folder: str, key: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path, self._fs = path, path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self, version: int):
        return self._path(f"{self.folder}/manifest/{version}.json")

    def version(self) -> int:
        """The newest version; -1 before the first commit."""
        at = self._path(f"{self.folder}/manifest")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=-1)

    def _read_manifest(self, version: int) -> dict:
        if version < 0 or not self._fs.exists(self._manifest(version)):
            raise ValueError(f"there is no version {version}")
        stream = self._fs.open(self._manifest(version))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _folders(self, manifest: dict, only: set[int] | None = None) -> list[str]:
        return [f"{self.folder}/{place}/bucket={b}" for b, place in manifest["places"].items() if only is None or int(b) in only]

    def read(self, version: int | None = None, only: set[int] | None = None) -> DataFrame:
        """The table at a version (the newest, if none is named)."""
        manifest = self._read_manifest(self.version() if version is None else version)
        found, schema = self._folders(manifest, only), manifest["schema"]
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def create(self, df: DataFrame) -> int:
        """Version 0: all rows of df."""
        return self._commit(df, -1, {"schema": df._jdf.schema().toDDL(), "places": {}})

    def _commit(self, rows: DataFrame, base: int, manifest: dict, touched: set[int] | None = None) -> int:
        place = f"data/{base + 1}-{uuid.uuid4().hex}"
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{place}")
        written = {int(s.getPath().getName().removeprefix("bucket=")) for s in self._fs.listStatus(self._path(f"{self.folder}/{place}")) if s.isDirectory() and s.getPath().getName().startswith("bucket=")}
        places = {b: p for b, p in manifest["places"].items() if touched is not None and int(b) not in touched} | {str(b): place for b in sorted(written)}
        body = json.dumps({"base": base, "schema": manifest["schema"], "places": places}).encode()
        try:
            if self.version() != base:
                raise Conflict(f"version {base} isn't the newest any more")
            out = self._fs.create(self._manifest(base + 1), False)  # fails where the file exists
        except Exception as e:
            self._fs.delete(self._path(f"{self.folder}/{place}"), True)
            if isinstance(e, Conflict) or "already exists" in str(e):
                raise Conflict(f"version {base + 1} was written by another writer") from e
            raise
        out.write(body)
        out.close()
        return base + 1

    def change(self, keys: DataFrame, apply: Callable[[DataFrame], DataFrame], base: int | None = None) -> int:
        """Commits apply(rows) in place of the rows of the buckets in which `keys` (a column named as the key) lie; returns
        the new version. Raises Conflict, and changes nothing, if another version than `base` is the newest by then."""
        base = self.version() if base is None else base
        touched = {r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect()}  # as many as buckets at most
        if not touched:
            return base
        return self._commit(apply(self.read(base, touched)), base, self._read_manifest(base), touched)
