"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cityfeed.sources.tables import unstage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    The optimizer may copy a projected expression into every place that names
    it, also into lambdas that run once per array element; a lambda variable
    is never copied.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset and Spark runs in one process, as in tests, a temporary
    folder takes its place; on a cluster it has to be set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: What the ``scratch`` blocks of this thread or task have to delete, innermost last; another query has its own.
_SCRATCH: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


def cut(df: DataFrame, name: str = "t", keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The result has no lineage, so a lost executor never repeats what led to it.
    Within ``scratch`` its files last as long as that; with ``keep`` as long as
    the one around it, or for good.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    blocks = _SCRATCH.get()
    if len(blocks) > keep:
        blocks[-1 - keep].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end what ``cut`` wrote inside, in the same thread, and was not told to keep."""
    own: list[str] = []
    token = _SCRATCH.set((*_SCRATCH.get(), own))
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in own:
            _delete(spark, path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table that ``cut`` wrote, once nothing reads it."""
    unstage(df)


def hex_sha256(text: Column) -> Column:
    """Lowercase hex SHA-256 of a string or binary column."""
    return F.sha2(text, 256)


def give_back() -> None:
    """Return freed memory of this Python worker to the system; idle workers of earlier stages then don't count."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow``, whose workers give back at the end of a partition what it has left behind."""

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``limit`` bytes of a text or binary column, or of one row."""
    for batch in batches:
        # sizes from the offsets, so that no text is copied
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right"))
            upto = max(upto, at + 1)
            yield batch.slice(at, upto - at)
            at = upto
        if not batch.num_rows:
            yield batch


class Kept:
    """A costly object that a Python worker keeps from partition to partition.

    It is closed once it has not been used for ``seconds``, so a worker that
    goes on to another stage, or idles, doesn't hold it.
    """

    def __init__(self, seconds: float = 2.0):
        self.seconds = seconds
        self.lock, self.users, self.key, self.value, self.timer = threading.Lock(), 0, None, None, None

    @contextmanager
    def use(self, key, make: Callable):
        """The object for ``key``, made anew if another one is kept."""
        with self.lock:
            if self.timer:
                self.timer.cancel()
            if self.key != key:
                self._close()
                self.value = make()  # should it fail, nothing is kept and nobody uses it
                self.key = key
            value = self.value
            self.users += 1
        try:
            yield value
        finally:
            with self.lock:
                self.users -= 1
                self.timer = threading.Timer(self.seconds, self._idle)
                self.timer.daemon = True
                self.timer.start()

    def _idle(self) -> None:
        with self.lock:
            if not self.users:
                self._close()

    def _close(self) -> None:
        if self.value is not None:
            if hasattr(self.value, "close"):
                self.value.close()
            self.key = self.value = None
            give_back()
