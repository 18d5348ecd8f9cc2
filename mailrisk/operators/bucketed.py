"""The verdict store in hash buckets: a batch reads and writes only the buckets its messages fall into.

Files of a version are never changed. Each version has a manifest, one row per bucket that holds anything, naming the version
that wrote the bucket last; buckets a batch does not touch are carried over by name. A batch that stops half way
leaves no manifest, and its next run overwrites its own folder. Keys are digests and unique in the store, so
buckets grow evenly; ``buckets`` should be chosen to give files of some 100 MB.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrisk.config import DEFAULT, ScoringConfig
from mailrisk.operators import store as st


@dataclass(frozen=True)
class BucketedStore:
    folder: str
    buckets: int = 256

    def bucket(self) -> Column:
        """Bucket of the column ``msg_key``, from its first eight hex digits."""
        return (F.conv(F.substring("msg_key", 1, 8), 16, 10).cast("bigint") % self.buckets).cast("int")

    def _numbers(self, keys: DataFrame) -> list[int]:
        """Buckets of some keys; at most ``buckets`` numbers."""
        return sorted(r["bucket"] for r in keys.select(self.bucket().alias("bucket")).distinct().collect())

    def _data(self, version: int) -> str:
        return f"{self.folder}/data-{version:012d}"

    def manifest(self, spark: SparkSession, version: int) -> dict[int, int]:
        """Version that wrote each bucket last, as of ``version``; empty before the first."""
        if version < 0:
            return {}
        rows = spark.read.schema("bucket int, version bigint").parquet(f"{self.folder}/manifest-{version:012d}")
        return {r["bucket"]: r["version"] for r in rows.collect()}

    def read(self, spark: SparkSession, version: int, only: Iterable[int] | None = None) -> DataFrame:
        """The store as of ``version``, or those of its buckets that are named in ``only``."""
        held = self.manifest(spark, version)
        wanted = held if only is None else [b for b in only if b in held]
        paths = [f"{self._data(held[b])}/bucket={b}" for b in wanted]
        return spark.read.schema(st.STORE_SCHEMA).parquet(*paths) if paths else st.empty_store(spark)

    def advance(
        self, batch: DataFrame, version: int, model_ready: bool, score: Callable[[DataFrame], DataFrame],
        cfg: ScoringConfig = DEFAULT,
    ) -> DataFrame:
        """Write ``version`` from the version before it and a batch of messages; the messages newly flagged.

        ``score`` adds the verdict columns; it is given the messages that are due only.
        """
        spark = batch.sparkSession
        met = self._numbers(batch.select(st.message_key(cfg).alias("msg_key")))
        plan = st.plan_scans(self.read(spark, version - 1, met), batch, model_ready, cfg)
        touched = self._numbers(plan.filter("scored"))
        due = batch.join(plan.filter("scored").select("msg_id"), "msg_id", "left_semi")
        after, flagged = st.apply_scans(self.read(spark, version - 1, touched), score(due), plan, cfg)
        rows = after.withColumn("bucket", self.bucket()).repartition("bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(self._data(version))
        held = {**self.manifest(spark, version - 1), **dict.fromkeys(touched, version)}
        manifest = spark.createDataFrame(sorted(held.items()), "bucket int, version bigint").coalesce(1)
        manifest.write.mode("overwrite").parquet(f"{self.folder}/manifest-{version:012d}")
        return flagged

    def drop_before(self, spark: SparkSession, version: int) -> int:
        """Delete what only versions before ``version`` need: their manifests, and buckets written anew since; how many buckets."""
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        root = path(self.folder)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        kept = set(self.manifest(spark, version).items())
        gone = 0
        for name in sorted(s.getPath().getName() for s in fs.listStatus(root)):
            kind, _, number = name.rpartition("-")
            if not number.isdigit() or int(number) >= version:
                continue
            if kind == "manifest":
                fs.delete(path(f"{self.folder}/{name}"), True)
            elif kind == "data":
                held = [s.getPath().getName() for s in fs.listStatus(path(f"{self.folder}/{name}"))]
                held = [b for b in held if b.startswith("bucket=")]
                old = [b for b in held if (int(b[7:]), int(number)) not in kept]
                for b in old:
                    fs.delete(path(f"{self.folder}/{name}/{b}"), True)
                if len(old) == len(held):
                    fs.delete(path(f"{self.folder}/{name}"), True)
                gone += len(old)
        return gone
