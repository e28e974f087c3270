"""Tables in Parquet and what is staged between jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over tasks, before work that costs much more than reading: a small file with many rows is read in one task."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism))


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; without that setting a temporary one, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="stage-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write into the shared folder and read back, which cuts the lineage."""
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more; other tables are left alone."""
    spark = df.sparkSession
    bare = lambda path: path.split(":", 1)[-1].lstrip("/").rstrip("/")
    root = bare(shared_root(spark))
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if bare(folder.rsplit("/", 1)[0]) == root:
            at = spark._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
