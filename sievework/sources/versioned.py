"""A keyed table that is changed by upserts while others read it.

Rows lie in buckets by the hash of their key. A version is a small manifest, a JSON file that names the folder of each
bucket. An upsert writes new folders for the buckets that it changes and then creates the manifest of the next number,
which fails if another writer has created it first: the upsert is then made anew on that version. So a version is complete
or absent, readers never see half of one, and of several values of a key the last one committed wins.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Other writers were faster, too often."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = 16):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def version(self) -> int:
        """The number of the last version, 0 before the first."""
        folder = self._path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def _manifest(self, version: int) -> dict[str, str]:
        if not version:
            return {}
        stream = self._fs.open(self._path(f"{self.path}/manifests/{version:012d}.json"))
        try:
            return json.loads(bytes(self._io.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _commit(self, version: int, manifest: dict[str, str]) -> bool:
        """Creates a version, if nobody else has: the file is written beside and renamed, and a rename onto a file fails."""
        folder = self._path(f"{self.path}/manifests")
        self._fs.mkdirs(folder)
        draft, final = self._path(f"{self.path}/drafts/{uuid.uuid4().hex}"), self._path(f"{self.path}/manifests/{version:012d}.json")
        lock = self._path(f"{self.path}/claims/{version:012d}")
        try:
            self._fs.create(lock, False).close()  # only one creates it
        except Exception as e:
            if "exist" in str(e).lower():
                return False
            raise
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        return bool(self._fs.rename(draft, final))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the last."""
        manifest = self._manifest(self.version() if version is None else version)
        folders = sorted(set(manifest.values()))
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def upsert(self, rows: DataFrame, order: str | None = None, tries: int = 20) -> int:
        """Adds rows and replaces those of the same key; returns the version. Of several rows of a key the last by ``order`` counts.

        Rows without a key are left out. Only buckets that have new rows are read and written.
        """
        names = self.spark.createDataFrame([], self.schema).columns
        keyed = rows.where(F.col(self.key).isNotNull())
        place = F.struct(F.col(order), F.xxhash64(*names)) if order else F.xxhash64(*names)
        new = keyed.select(F.struct(*names).alias("_new"), place.alias("_place")).groupBy(F.col(f"_new.{self.key}").alias("_key")).agg(F.max_by("_new", "_place").alias("_new")).select("_new.*")
        draft = f"{self.path}/rows/{uuid.uuid4().hex}"
        new.withColumn("_bucket", self._bucket()).write.parquet(draft)
        new = self.spark.read.parquet(draft)
        touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())  # at most the number of buckets
        if not touched:
            return self.version()
        for _ in range(tries):
            base = self.version()
            manifest = self._manifest(base)
            old = [manifest[str(b)] for b in touched if str(b) in manifest]
            rows_now = new
            if old:
                kept = self.spark.read.schema(self.schema).parquet(*sorted(set(old))).join(new.select(self.key), self.key, "left_anti")
                rows_now = kept.select(*names).withColumn("_bucket", self._bucket()).unionByName(new)
            folder = f"{self.path}/rows/{uuid.uuid4().hex}"
            rows_now.repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
            if self._commit(base + 1, manifest | {str(b): f"{folder}/_bucket={b}" for b in touched}):
                return base + 1
        raise Conflict(f"{tries} versions by others in the meantime")
