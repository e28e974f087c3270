"""The parsers as a table function, for SQL: ``FROM payloads p, LATERAL page_events(p.source_name, p.url, p.payload, '2026-05-01') e``.

A parser's strategies are tried in turn, the first that finds events decides;
a payload that can't be read gives one row with the error, and null payloads
and unknown sources give none.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from cityfeed.sources.parsers import FIELDS, NAMES, PARSERS, failed_rows, typed_rows

_TYPES = [{"string": str, "double": float, "boolean": bool, "timestamp_ntz": datetime}[f.split()[1]] for f in FIELDS.split(", ")]


def _regular(rows: list[tuple]) -> bool:
    """Whether all values are of their column's type and all characters whole."""
    for row in rows:
        if not all(v is None or type(v) is t for v, t in zip(row, _TYPES, strict=True)):
            return False
        "".join([v for v in row if type(v) is str]).encode()
    return True


class PageEvents:
    def eval(self, source_name: str, url: str, payload: str, now: str) -> Iterator[tuple]:
        if source_name not in PARSERS or payload is None:
            return
        at = datetime.fromisoformat(now)
        try:
            rows = [tuple([e[k] for k in NAMES]) for e in PARSERS[source_name](payload, url or "", at)]
            regular = _regular(rows)
        except Exception:  # what went wrong is in the row, as for the operator
            regular = False
        if regular:
            yield from ((*row, None) for row in rows)
            return
        found, failed = typed_rows([(source_name, url, payload)], at)
        for row in found.to_pylist() + failed_rows(failed).to_pylist():
            yield tuple(row.values())


#: Without Arrow, which makes a batch of every row that calls the function.
page_events = udtf(PageEvents, returnType=FIELDS + ", error string", useArrow=False)


def register(spark: SparkSession) -> None:
    """``page_events`` under its name in SQL."""
    spark.udtf.register("page_events", page_events)
