"""Landed payloads as a data source of Spark: ``spark.read.format("landed").load(folder)`` gives their events.

The folder holds one folder for each source, ``source_name=<name>``, with
files of JSON lines ``{"url": ..., "payload": ...}``, as
``write.partitionBy("source_name").json`` leaves them. A file is a partition;
a condition on ``source_name`` leaves out the other sources' files, and files
are read line by line. ``now`` is the time that dates without a year refer to.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from cityfeed.sources.parsers import FIELDS, failed_rows, typed_rows

LINES = 500


@dataclass
class LandedFile(InputPartition):
    source_name: str
    path: str


class LandedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.names = options["path"], None
        self.now = datetime.fromisoformat(options["now"])

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Sources that are asked for; conditions stay for Spark to apply to the rows as well."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("source_name",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = asked if self.names is None else self.names & asked
            yield f

    def _files(self) -> tuple[pafs.FileSystem, list[LandedFile]]:
        system, root = pafs.FileSystem.from_uri(self.folder) if "://" in self.folder else (pafs.LocalFileSystem(), self.folder.removeprefix("file:"))
        found = []
        for x in system.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
            name = next((unquote(p.partition("=")[2]) for p in x.path.split("/") if p.startswith("source_name=")), None)
            if x.is_file and x.base_name.endswith(".json") and name is not None and (self.names is None or name in self.names):
                found.append(LandedFile(name, x.path))
        return system, sorted(found, key=lambda f: (f.source_name, f.path))

    def partitions(self) -> list[LandedFile]:
        return self._files()[1]

    def read(self, partition: LandedFile) -> Iterator[pa.RecordBatch]:
        system = pafs.FileSystem.from_uri(self.folder)[0] if "://" in self.folder else pafs.LocalFileSystem()
        with system.open_input_stream(partition.path) as raw:
            rows = []
            for line in _lines(raw):
                landed = json.loads(line)
                rows.append((partition.source_name, landed.get("url"), landed.get("payload")))
                if len(rows) == LINES:
                    yield from self._events(rows)
                    rows = []
            yield from self._events(rows)

    def _events(self, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        found, failed = typed_rows(rows, self.now)
        yield from found.to_batches()
        yield from failed_rows(failed).to_batches()


def _lines(raw) -> Iterator[bytes]:
    rest = b""
    while block := raw.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield from filter(None, whole)
    if rest:
        yield rest


class Landed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return FIELDS + ", error string"

    def reader(self, schema) -> LandedReader:
        return LandedReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, conditions included."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Landed)
