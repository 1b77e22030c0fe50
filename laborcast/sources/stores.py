"""Tables that are changed in place, in buckets of their key, with a manifest that switches all buckets at once.

A table is a folder. Rows lie in Parquet folders of one generation and bucket each, ``bucket`` being a hash of the key. A
manifest names the folder of every bucket and the batches that have been applied. A change reads and writes only the
buckets that its batch has keys in, to new folders, and then puts the next manifest in place by one rename; readers see the
one before or the one after, and a job that dies leaves the table as it was. A batch that comes again, with the number of
one of the last BATCHES that have been applied, changes nothing. Folders of old generations stay until :meth:`BucketStore.expire`.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .sinks import merge_keyed

#: Numbers of applied batches that a manifest keeps.
BATCHES = 1000
Combine = Callable[[DataFrame, DataFrame], DataFrame]


class BucketStore:
    """A table at ``path`` on a file system that all executors reach; ``by`` are the columns of its key."""

    def __init__(self, spark: SparkSession, path: str, by: list[str], *, buckets: int = 64):
        self.spark, self.path, self.by = spark, path.rstrip("/"), list(by)
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.buckets = (self.manifest() or {"buckets": buckets})["buckets"]  # an existing table keeps its number

    def _at(self, *names: str):
        return self._hadoop.Path("/".join([self.path, *names]))

    def _versions(self) -> list[int]:
        folder = self._at("_manifests")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict | None:
        """The newest manifest, or that of a version; None where nothing is stored yet."""
        versions = self._versions()
        if not versions:
            return None
        at = self._at("_manifests", f"{versions[-1] if version is None else version:012d}.json")
        stream = self._fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict, version: int) -> None:
        part = self._at("_manifests", f"part-{uuid.uuid4().hex}")
        out = self._fs.create(part)
        try:
            out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            out.close()
        target = self._at("_manifests", f"{version:012d}.json")
        if self._fs.exists(target) or not self._fs.rename(part, target):
            self._fs.delete(part, False)
            raise RuntimeError(f"another change of {self.path} was committed first")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def read(self, only: list[int] | None = None, version: int | None = None) -> DataFrame | None:
        """The rows, of some buckets or of all; None where nothing is stored. Only the folders of these buckets are listed."""
        manifest = self.manifest(version)
        if manifest is None:
            return None
        folders = [f"{self.path}/{folder}" for b, folder in sorted(manifest["folders"].items()) if only is None or int(b) in only]
        schema = manifest["schema"]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def change(self, batch: DataFrame, combine: Combine, *, batch_id: str | None = None) -> bool:
        """Puts ``combine(stored rows, batch)`` in place of the buckets that ``batch`` has keys in; False if it was applied before.

        ``combine`` gets the stored rows of these buckets only, as an empty frame where there are none, and must return rows
        of the same keys. The batch is read twice: for its buckets, of which there are few, and for its rows.
        """
        versions = self._versions()
        manifest = self.manifest() or {"buckets": self.buckets, "by": self.by, "folders": {}, "batches": [], "schema": _ddl(batch)}
        if batch_id is not None and batch_id in manifest["batches"]:
            return False
        met = sorted(r["b"] for r in batch.select(self.bucket().alias("b")).distinct().collect())
        stored = self.read(met) if versions else None
        rows = combine(batch.limit(0) if stored is None else stored, batch)
        generation = f"data/{uuid.uuid4().hex}"
        # Balanced by bucket, so that a bucket is few files and a hot one still is several tasks.
        rows.withColumn("__bucket", self.bucket()).hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{generation}")
        written = {f.getPath().getName().split("=")[1] for f in self._fs.listStatus(self._at(generation)) if "=" in f.getPath().getName()}
        folders = {b: f for b, f in manifest["folders"].items() if int(b) not in met} | {b: f"{generation}/__bucket={b}" for b in written}
        batches = (manifest["batches"] + ([batch_id] if batch_id is not None else []))[-BATCHES:]
        self._commit({**manifest, "folders": folders, "batches": batches, "schema": _ddl(rows)}, (versions[-1] if versions else 0) + 1)
        return True

    def expire(self, keep: int = 1) -> int:
        """Removes manifests but the newest ``keep`` and the generations that none of these names; how many generations went."""
        versions = self._versions()
        kept = {f.split("/")[1] for v in versions[-keep:] for f in self.manifest(v)["folders"].values()}
        old = [f.getPath() for f in self._fs.listStatus(self._at("data")) if f.getPath().getName() not in kept] if versions else []
        for v in versions[:-keep]:
            self._fs.delete(self._at("_manifests", f"{v:012d}.json"), False)
        for folder in old:
            self._fs.delete(folder, True)
        return len(old)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def merge_rows(store: BucketStore, batch: DataFrame, *, order: str, keep: str, batch_id: str | None = None) -> bool:
    """One row per key: the first seen (insert-or-ignore) or the last (insert-or-replace)."""
    return store.change(batch, lambda old, new: merge_keyed(old, new, keys=store.by, order=order, keep=keep), batch_id=batch_id)


def replace_snapshots(store: BucketStore, batch: DataFrame, *, fetched: str = "fetched_at", batch_id: str | None = None) -> bool:
    """Every market of the batch gets the batch's newest snapshot, unless a newer one is stored; other markets stay.

    A market is a key of the store. Each market's rows are reduced to their newest time with partial aggregates.
    """
    def newest(old: DataFrame, new: DataFrame) -> DataFrame:
        # A snapshot is replaced whole: where both have the same time, the batch is the later copy of it.
        time = F.struct(F.col(fetched).alias("time"), F.col("__new").alias("new"))
        rows = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True).withColumn("__time", time)
        last = rows.groupBy(*store.by).agg(F.max("__time").alias("__time"))
        kept = [F.col("r.__time") == F.col("l.__time"), *[F.col(f"r.{c}").eqNullSafe(F.col(f"l.{c}")) for c in store.by]]
        return rows.alias("r").join(last.alias("l"), kept, "left_semi").drop("__new", "__time")

    return store.change(batch, newest, batch_id=batch_id)
