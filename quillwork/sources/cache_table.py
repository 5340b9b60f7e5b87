"""A cache that persists: a table in buckets by key hash, changed by versioned upserts.

Every upsert writes the buckets that it touches to a folder of its own and then a manifest, `manifests/{version}.json`, that names
the folder of each bucket. A manifest appears whole, by a rename, after all its files; readers take the newest one and keep to its
folders, so they see one version whatever upserts run meanwhile. An upsert that dies leaves files that no manifest names.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.runs import cache_upsert

SCHEMA = "key string, payload string, written_at timestamp"
BUCKETS = 64


class UpsertConflict(RuntimeError):
    """Another upsert took the next version; read again and repeat."""


class CacheTable:
    """Entries (key, payload, written_at) in a folder that driver and executors share; any file system of Hadoop's."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._new = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._new(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _bucket(self, key: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def versions(self) -> list[int]:
        """Versions with a manifest, oldest first."""
        found = self._fs.globStatus(self._new(f"{self.root}/manifests/*.json")) or []
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in found)

    def _manifest(self, version: int | None) -> dict:
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "buckets": self.buckets, "folders": {}}
        stream = self._fs.open(self._new(f"{self.root}/manifests/{version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, version: int | None = None, only: set[int] | None = None) -> DataFrame:
        """The entries of a version, by default the newest; `only` names the buckets wanted. An unwritten table is empty."""
        return self._entries(self._manifest(version), only)

    def _entries(self, manifest: dict, only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.root}/{folder}/bucket={b}" for b, folder in manifest["folders"].items() if only is None or int(b) in only]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def upsert(self, fresh: DataFrame) -> int:
        """Merges fresh entries and returns the new version; of a key the newest entry stays, a new one before an old one of the
        same time. Only buckets that fresh touches are read and written. Null keys have no lookup and are left out; without
        entries the version stays. Raises UpsertConflict if another upsert took the version.

        The driver learns the numbers of touched buckets, `buckets` of them at most; repeated keys of a hot entry are cut to one
        in each task before the shuffle.
        """
        old = self._manifest(None)
        n = old["buckets"]
        fresh = fresh.where("key is not null").select("key", F.col("payload").cast("string"), F.col("written_at").cast("timestamp"))
        touched = {r[0] for r in fresh.select(self._bucket(F.col("key"), n).alias("b")).distinct().collect()}
        if not touched:
            return old["version"]
        version, folder = old["version"] + 1, f"data/{uuid.uuid4().hex}"
        merged = cache_upsert(self._entries(old, touched), fresh).withColumn("bucket", self._bucket(F.col("key"), n))
        merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        self._publish({"version": version, "buckets": n, "folders": old["folders"] | {str(b): folder for b in sorted(touched)}})
        return version

    def _publish(self, manifest: dict) -> None:
        version = manifest["version"]
        # whoever creates the claim may write the manifest; creating is atomic in Hadoop's file systems
        claim = self._new(f"{self.root}/manifests/{version}.claim")
        try:
            self._fs.create(claim, False).close()
        except Py4JJavaError as e:
            raise UpsertConflict(f"version {version} of {self.root} is taken") from e
        part = self._new(f"{self.root}/manifests/{version}.part")
        out = self._fs.create(part, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        self._fs.rename(part, self._new(f"{self.root}/manifests/{version}.json"))

    def lookup(self, pages: DataFrame, now: str, ttl: int) -> DataFrame:
        """pages (key) with payload and hit, from the buckets that pages touch; entries older than ttl seconds do not count."""
        from ..operators.runs import cache_lookup

        manifest = self._manifest(None)
        touched = {r[0] for r in pages.where("key is not null").select(self._bucket(F.col("key"), manifest["buckets"]).alias("b")).distinct().collect()}
        return cache_lookup(pages, self._entries(manifest, touched), now, ttl)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes what the last `keep` versions do not name and says how many folders went: call it when no upsert runs and no
        older version is being read."""
        versions = self.versions()
        used = {folder for v in versions[-keep:] for folder in self._manifest(v)["folders"].values()}
        gone = [s.getPath() for s in self._fs.globStatus(self._new(f"{self.root}/data/*")) or [] if f"data/{s.getPath().getName()}" not in used]
        for path in gone:
            self._fs.delete(path, True)
        for v in versions[:-keep]:
            self._fs.delete(self._new(f"{self.root}/manifests/{v}.json"), False)
        return len(gone)
