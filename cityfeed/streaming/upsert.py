"""Upserts from a stream of landed files, resumable."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityfeed.sources.tables import shared_root

BUCKETS = 64


def latest_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key; one aggregation, with a row per key and task before the shuffle."""
    newest = df.groupBy(key).agg(F.max(F.struct(order, *[c for c in df.columns if c not in (order, key)])).alias("m"))
    return newest.select(key, "m.*")


class BucketedState:
    """Rows by key in ``BUCKETS`` folders per version, below a folder that all executors share.

    Version n holds the buckets that batch n touched; ``manifest-n`` names the
    version of every bucket. A batch reads the last manifest before its own
    number, so one that is repeated after a failure gives the same files and
    never reads what it writes.
    """

    def __init__(self, spark: SparkSession, root: str, schema, key: str, order: str):
        self.spark, self.root, self.schema, self.key, self.order = spark, root, schema, key, order
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def manifests(self) -> list[int]:
        """Numbers of the written manifests, in order."""
        if not self.fs.exists(self.path(self.root)):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self.path(self.root))]
        numbers = [int(n.rpartition("-")[2]) for n in names if n.startswith("manifest-")]
        return sorted(n for n in numbers if self.fs.exists(self.path(f"{self.root}/manifest-{n}/_SUCCESS")))

    def manifest(self, n: int) -> dict[str, int]:
        return json.loads(self.spark.read.text(f"{self.root}/manifest-{n}").first()[0])

    def rows(self, manifest: dict[str, int], buckets=None) -> DataFrame:
        paths = [f"{self.root}/version-{v}/bucket={b}" for b, v in manifest.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def merge(self, batch: DataFrame, n: int) -> None:
        """Batch ``n`` into the state; only the buckets of its keys are rewritten."""
        before = [k for k in self.manifests() if k < n]
        old = self.manifest(before[-1]) if before else {}
        bucket = F.pmod(F.xxhash64(self.key), F.lit(BUCKETS)).cast("int")
        touched = {r[0] for r in batch.select(bucket.alias("bucket")).distinct().collect()}  # BUCKETS numbers at most
        new = latest_rows(self.rows(old, touched).unionByName(batch), self.key, self.order).select(*batch.columns)
        new.repartition(bucket).withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/version-{n}")
        said = json.dumps(old | {str(b): n for b in touched}, sort_keys=True)
        self.spark.createDataFrame([(said,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/manifest-{n}")
        self._forget(before)

    def _forget(self, before: list[int]) -> None:
        """Delete what only manifests before the last one name."""
        if len(before) < 2:
            return
        gone, kept = self.manifest(before[-2]), self.manifest(before[-1])
        for b, v in gone.items():
            if kept.get(b) != v:
                self.fs.delete(self.path(f"{self.root}/version-{v}/bucket={b}"), True)
        self.fs.delete(self.path(f"{self.root}/manifest-{before[-2]}"), True)

    def last(self) -> DataFrame:
        numbers = self.manifests()
        return self.rows(self.manifest(numbers[-1]) if numbers else {})


def upsert_stream(spark: SparkSession, path: str, key: str, order: str = "ts", trigger: dict | None = None, root: str | None = None, files: int | None = None) -> DataFrame:
    """Read what lies under ``path`` as a stream and keep the newest row of each key.

    ``root`` keeps state and progress: a later call with the same one goes on
    where the last one ended. Without it every call starts anew. ``files`` is
    the most that one batch reads. Returns the state after the last batch.
    """
    root = (root or f"{shared_root(spark)}/stream-{uuid.uuid4().hex}").rstrip("/")
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    # a single file is read as the stream of its folder that matches its name
    stream = reader.option("pathGlobFilter", name).parquet(folder) if _is_file(spark, path) else reader.parquet(path)
    state = BucketedState(spark, root, schema, key, order)
    query = stream.writeStream.foreachBatch(state.merge).option("checkpointLocation", f"{root}/progress").trigger(**(trigger or {"availableNow": True})).start()
    query.awaitTermination()
    return state.last()


def _is_file(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
