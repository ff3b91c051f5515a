"""Tables that change by batches: rows in hash buckets, a manifest for each version.

A batch rewrites the buckets that its keys fall into and no others, into a folder of its own; the manifest then names,
for each bucket, the version that holds it.  A version exists once its manifest does: a batch that stopped before that
is run again over what it left, one that is run again after it changes nothing.  Buckets that no manifest but the last
two names are deleted, so a reader that has begun can end.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Merge = Callable[[DataFrame, DataFrame], DataFrame]
MANIFEST = "bucket int, version long"


class Folder:
    """Files of any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.make(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def has(self, name: str) -> bool:
        return self.fs.exists(self.make(f"{self.path}/{name}"))

    def names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.make(f"{self.path}/{name}"))] if self.has(name) else []

    def numbers(self, name: str, prefix: str) -> list[int]:
        """Of the folders ``prefix=number`` that were written to the end."""
        found = [int(m[1]) for n in self.names(name) if (m := re.fullmatch(rf"{prefix}=(\d+)", n))]
        return sorted(n for n in found if self.has(f"{name}/{prefix}={n}/_SUCCESS"))

    def delete(self, name: str) -> None:
        self.fs.delete(self.make(f"{self.path}/{name}"), True)

    def bytes(self, name: str = "") -> int:
        return self.fs.getContentSummary(self.make(f"{self.path}/{name}")).getLength() if self.has(name) else 0


class BucketTable:
    """A table of ``schema`` under ``path``, its rows dealt to ``buckets`` buckets by the hash of ``keys``.

    ``merge`` makes of a bucket's rows and the batch's rows of the same keys the bucket's next rows; the keys of a
    bucket never meet those of another, so what it does must go by key."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], merge: Merge, buckets: int = 64):
        self.spark, self.schema, self.keys, self.merge_rows, self.buckets = spark, schema, keys, merge, buckets
        self.folder = Folder(spark, path)

    def version(self) -> int | None:
        """The last batch that was merged."""
        return max(self.folder.numbers("manifest", "version"), default=None)

    def manifest(self, version: int | None) -> dict[int, int]:
        """Which version holds each bucket: at most ``buckets`` rows."""
        if version is None:
            return {}
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.folder.path}/manifest/version={version}").collect()
        return {r.bucket: r.version for r in rows}

    def _rows(self, held: dict[int, int]) -> DataFrame:
        paths = [f"{self.folder.path}/data/version={v}/bucket={b}" for b, v in sorted(held.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._rows(self.manifest(self.version()))

    def merge(self, batch: DataFrame, number: int) -> None:
        """Take in batch ``number`` (they rise); one that was taken in before changes nothing."""
        last = self.version()
        if last is not None and number <= last:
            return
        held = self.manifest(last)
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows = batch.select(self.schema.names).withColumn("bucket", bucket).persist()
        try:
            touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
            next_rows = self.merge_rows(self._rows({b: held[b] for b in touched if b in held}), rows.drop("bucket"))
            dealt = next_rows.select(self.schema.names).withColumn("bucket", bucket)
            dealt.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder.path}/data/version={number}")
        finally:
            rows.unpersist()
        # A bucket that the merge emptied has no folder.
        filled = {int(n.split("=")[1]) for n in self.folder.names(f"data/version={number}") if n.startswith("bucket=")}
        new = {b: v for b, v in held.items() if b not in touched} | dict.fromkeys(filled, number)
        self.spark.createDataFrame(sorted(new.items()), MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.folder.path}/manifest/version={number}")
        self._drop(last, new)

    def _drop(self, last: int | None, new: dict[int, int]) -> None:
        kept = set(new.items()) | set(self.manifest(last).items())
        for version in self.folder.numbers("data", "version"):
            names = [n for n in self.folder.names(f"data/version={version}") if n.startswith("bucket=")]
            alive = [n for n in names if (int(n.split("=")[1]), version) in kept]
            if not alive and version != max(new.values(), default=version):
                self.folder.delete(f"data/version={version}")
            else:
                for n in set(names) - set(alive):
                    self.folder.delete(f"data/version={version}/{n}")
        for version in self.folder.numbers("manifest", "version"):
            if last is not None and version < last:
                self.folder.delete(f"manifest/version={version}")


class Outbox:
    """Messages that leave only after they were acknowledged (at least once).

    Each batch is a part of the queue, and each attempt to send a part writes the keys that were acknowledged. What was
    queued and not acknowledged is pending, whatever run queued it; parts without pending rows are deleted, so the box
    holds no more than what is open."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str):
        self.spark, self.schema, self.key = spark, schema, key
        self.folder = Folder(spark, path)

    def queue(self, batch: DataFrame, number: int) -> None:
        """Take in batch ``number``; running it again replaces it, or does nothing once it was sent whole."""
        if not self.folder.has(f"closed/batch={number}"):
            batch.select(self.schema.names).write.mode("overwrite").parquet(f"{self.folder.path}/queue/batch={number}")

    def pending(self, number: int | None = None) -> DataFrame:
        """Rows that wait, of one batch or of all, with their ``batch``."""
        out = None
        for n in self.folder.numbers("queue", "batch") if number is None else [number]:
            rows = self.spark.read.schema(self.schema).parquet(f"{self.folder.path}/queue/batch={n}")
            tries = self.folder.numbers(f"acknowledged/batch={n}", "attempt")
            if tries:
                acked = self.spark.read.parquet(*[f"{self.folder.path}/acknowledged/batch={n}/attempt={k}" for k in tries])
                rows = rows.join(acked.select(self.key).distinct(), self.key, "left_anti").select(self.schema.names)
            rows = rows.withColumn("batch", F.lit(n).cast("long"))
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], self.schema).withColumn("batch", F.lit(0).cast("long")) if out is None else out

    def send(self, deliver: Callable[[DataFrame], DataFrame]) -> int:
        """Hand every pending row to ``deliver``, a part at a time; of what it returns, the keys are acknowledged. Returns how many parts are still open."""
        left = 0
        for n in self.folder.numbers("queue", "batch"):
            rows = self.pending(n)
            if not rows.isEmpty():
                attempt = max(self.folder.numbers(f"acknowledged/batch={n}", "attempt"), default=-1) + 1
                deliver(rows).select(self.key).write.mode("overwrite").parquet(f"{self.folder.path}/acknowledged/batch={n}/attempt={attempt}")
            if self.pending(n).isEmpty():
                self.spark.createDataFrame([(n,)], "batch long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder.path}/closed/batch={n}")
                self.folder.delete(f"queue/batch={n}")
                self.folder.delete(f"acknowledged/batch={n}")
            else:
                left += 1
        return left
