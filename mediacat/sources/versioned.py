"""Catalog tables in versions: a commit writes new folders and then one new manifest, which names the folders of every table.

Keyed tables are kept in buckets by the hash of their key, and an upsert writes only the buckets that it touches. A manifest is made beside and renamed to the
next number, which fails if that number is there: readers see the old version or the new one, never a part, and of two writers one wins. A commit can name
a stream and its batch; a batch that was committed before changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mediacat.schemas import TABLES

BUCKETS = 64
#: Keys of the tables that have one.
KEYS = {"files": "file_path", "analysis_results": "file_id", "processing_queue": "id", "persons": "id", "settings": "key", "vault": "id"}


class Conflict(RuntimeError):
    """Another writer has committed the next version."""


class Catalog:
    """The tables under base. schemas: DDL by table, beside the library's own."""

    def __init__(self, spark: SparkSession, base: str, buckets: int = BUCKETS, schemas: dict[str, str] | None = None):
        self.spark, self.base, self.buckets, self.schemas = spark, base.rstrip("/"), buckets, TABLES | (schemas or {})
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def version(self) -> int:
        """The last committed version, -1 if there is none."""
        if not self._fs.exists(self._path("manifests")):
            return -1
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("manifests"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=-1)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version < 0:
            return {"tables": {}, "batches": {}}
        stream = self._fs.open(self._path(f"manifests/{version:012d}.json"))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _load(self, name: str, folders: list[str]) -> DataFrame:
        schema = StructType.fromDDL(self.schemas[name])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.base}/{f}" for f in folders))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version; empty if it was never written."""
        held = self.manifest(version)["tables"].get(name, {"buckets": {}})
        return self._load(name, [f for fs in held["buckets"].values() for f in fs])

    def _typed(self, name: str, df: DataFrame) -> DataFrame:
        return df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in StructType.fromDDL(self.schemas[name]).fields))

    def _write(self, name: str, df: DataFrame, buckets: int) -> dict[str, list[str]]:
        """Write rows into a new folder, by bucket; the bucket's folders by number."""
        key, folder = KEYS.get(name), f"data/{name}-{uuid.uuid4().hex}"
        if key:
            place = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
            df.withColumn("bucket", place).repartition("bucket").sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(f"{self.base}/{folder}")
            found = [s.getPath().getName() for s in self._fs.listStatus(self._path(folder)) if s.isDirectory()]
            return {n.split("=")[1]: [f"{folder}/{n}"] for n in found if n.startswith("bucket=")}
        df.write.parquet(f"{self.base}/{folder}")
        return {"0": [folder]}

    def commit(self, upserts: dict[str, DataFrame] | None = None, appends: dict[str, DataFrame] | None = None, replaces: dict[str, DataFrame] | None = None, stream: str | None = None, batch: int | None = None) -> int:
        """Commit changes of any tables together; the new version, or the current one if the stream's batch was committed before.

        upserts: rows that take the place of those of their key (keys must not repeat; tables in KEYS); appends: further rows; replaces: whole tables.
        A table that doesn't have the number of buckets asked for keeps its own.
        """
        at = self.version()
        now = self.manifest(at)
        if stream is not None and batch is not None and now["batches"].get(stream, -1) >= batch:
            return at
        for name, df in (replaces or {}).items():
            now["tables"][name] = {"n": self.buckets, "buckets": self._write(name, self._typed(name, df), self.buckets)}
        for name, df in (appends or {}).items():
            held = now["tables"].setdefault(name, {"n": self.buckets, "buckets": {}})
            for b, folders in self._write(name, self._typed(name, df), held["n"]).items():
                held["buckets"][b] = held["buckets"].get(b, []) + folders
        for name, df in (upserts or {}).items():
            held, key = now["tables"].setdefault(name, {"n": self.buckets, "buckets": {}}), KEYS[name]
            # The changes themselves are written first: they may read this table, and are used more than once.
            fresh = self._write(name, self._typed(name, df), held["n"])
            changed = self._load(name, [f for fs in fresh.values() for f in fs])
            old = [f for b in fresh for f in held["buckets"].get(b, [])]
            if old:
                both = self._load(name, old).join(changed.select(key), key, "left_anti").select(changed.columns).unionByName(changed)
                fresh = self._write(name, both, held["n"])
            held["buckets"] |= fresh
        if stream is not None and batch is not None:
            now["batches"][stream] = batch
        self._publish(at + 1, now)
        return at + 1

    def _publish(self, version: int, manifest: dict) -> None:
        beside, target = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/{version:012d}.json")
        self._fs.mkdirs(self._path("manifests"))
        out = self._fs.create(beside, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        none = self.spark.sparkContext._gateway.new_array(options, 1)
        none[0] = options.NONE
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else self._fs.getUri(), self._conf).rename(beside, target, none)
        except Exception as e:
            if self._fs.exists(target):
                raise Conflict(f"version {version} of {self.base} was committed by another writer") from e
            raise

    def vacuum(self, keep: int = 2) -> int:
        """Remove all but the last `keep` versions and the folders that none of them names; how many folders went. No writer may be at work."""
        last = self.version()
        kept = [v for v in range(max(0, last - keep + 1), last + 1)]
        named = {f.split("/")[1] for v in kept for t in self.manifest(v)["tables"].values() for fs in t["buckets"].values() for f in fs}
        for s in self._fs.listStatus(self._path("manifests")):
            n = s.getPath().getName()
            if n.endswith(".json") and int(n[:-5]) not in kept or n.startswith("."):
                self._fs.delete(s.getPath(), False)
        gone = [s.getPath() for s in self._fs.listStatus(self._path("data")) if s.getPath().getName() not in named]
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)
