"""The greedy merge of pairs of events, component by component, in the order of time.

Pairs are settled by the start of their earlier event, then ids. An event's
pairs end ``BAND_HOURS`` after its start, so a component streams through a task
in that order and only the events of the last hours are held, whatever its
size. A chain can run through years, so time is cut into blocks: a task gets
one block of a component, and the next round gets the next one, together with
the events at the end of the block before whose pairs reach into it. There are
as many rounds as the longest chain has blocks, usually one; each takes the
blocks of all components at once.

Pairs are given one by one or by kinds: events of one ``key`` and source wait
in one queue, and an event meets the queues of its key's partners. Every pair
that is looked at there takes an event away, so the work follows the events
and not their pairs.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from functools import reduce
from heapq import heapify, heappop, heapreplace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityfeed.functions.text import csv_list
from cityfeed.sources.tables import stage

BLOCK_DAYS = 30
DAY = 86_400_000_000
NEVER = (1 << 63) - 1

EVENT = "root long, id long, start long, key string, name string, sources array<string>, n int, gone boolean, touched boolean, partners array<string>, first long, last long"
ARROW = pa.schema(
    [("root", pa.int64()), ("id", pa.int64()), ("start", pa.int64()), ("key", pa.string()), ("name", pa.string()), ("sources", pa.list_(pa.string())), ("n", pa.int32()), ("gone", pa.bool_()), ("touched", pa.bool_()), ("partners", pa.list_(pa.string())), ("first", pa.int64()), ("last", pa.int64()), ("open", pa.bool_())]
)
FIELDS = ARROW.names[:-1]
CHUNK = 10_000


def merge_pair(a: dict, b: dict) -> None:
    """The event with more sources, the earlier one on a tie, takes over the other's source."""
    keep, drop = (a, b) if a["n"] >= b["n"] else (b, a)
    for name, at in ((keep["name"], 0), (drop["name"], len(keep["sources"]) + 1)):
        if name and name not in keep["sources"]:
            keep["sources"].insert(at, name)
    keep["n"] = len(keep["sources"])
    drop["gone"] = keep["touched"] = True


def settled(rows: Iterator[dict], band: int, apart: bool = False) -> Iterator[dict]:
    """The events in their order with all their pairs settled, or ``open`` from their ``hold`` on; ``rows`` come by component, start and id.

    ``partners`` are keys whose later events pair with those of the row's key, and hold for all of that key while one is
    in the band; a row without ``key`` has its id as key. With ``apart`` events of one source don't pair.
    """
    root, window = None, deque()
    partners, inside, waiting = {}, defaultdict(int), {}  # by key; waiting: the events that are not gone by their source

    def head(key, name):
        """Take away the first that waits."""
        queues = waiting[key]
        queues[name].popleft()
        if not queues[name]:
            del queues[name]
            if not queues:
                del waiting[key]

    def meet(a):
        heads = [(q[0]["start"], q[0]["id"], key, name) for key in partners[a["key"]] for name, q in waiting.get(key, {}).items() if not apart or name != a["name"]]
        heapify(heads)
        while heads and not a["gone"]:
            *_, key, name = heads[0]
            b = waiting[key][name][0]
            merge_pair(a, b)
            if b["gone"]:
                head(key, name)
                if (q := waiting.get(key, {}).get(name)) is None:
                    heappop(heads)
                else:
                    heapreplace(heads, (q[0]["start"], q[0]["id"], key, name))

    def leave():
        a = window.popleft()
        a["open"] = a["start"] >= a["hold"]
        if not a["gone"]:
            head(a["key"], a["name"])
            if not a["open"]:
                meet(a)
        if a["open"]:
            a["partners"] = list(partners[a["key"]])
        inside[a["key"]] -= 1
        if not inside[a["key"]]:
            del inside[a["key"]], partners[a["key"]]
        return a

    for row in rows:
        while window and (row["root"] != root or window[0]["start"] + band < row["start"]):
            yield leave()
        root = row["root"]
        key = row.setdefault("key", row["id"])
        window.append(row)
        inside[key] += 1
        partners.setdefault(key, set()).update(row["partners"] or ())
        if not row["gone"]:
            waiting.setdefault(key, {}).setdefault(row["name"], deque()).append(row)
    while window:
        yield leave()


def _replayed(rows: DataFrame, band: int, apart: bool) -> DataFrame:
    """``rows`` of one block of each component, replayed; ``open`` marks those that wait for the next block."""

    def each(batches):
        for batch in batches:
            yield from batch.to_pylist()

    def run(batches):
        out = []
        for row in settled(each(batches), band, apart):
            out.append({k: row[k] for k in ARROW.names})
            if len(out) == CHUNK:
                yield pa.RecordBatch.from_pylist(out, ARROW)
                out = []
        yield pa.RecordBatch.from_pylist(out, ARROW)

    return rows.repartition("root").sortWithinPartitions("root", "start", "id").mapInArrow(run, EVENT + ", open boolean")


def _own() -> list[Column]:
    """What a row takes from its event; an event without a count has one source."""
    start = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("start_at"))
    count = F.when(F.coalesce("source_count", F.lit(0)) == 0, 1).otherwise(F.col("source_count")).cast("int")
    return [F.col("id"), start.alias("start"), F.col("source_name").alias("name"), csv_list(F.col("sources_list")).alias("sources"), count.alias("n"), F.lit(False).alias("gone"), F.lit(False).alias("touched")]


def replay(events: DataFrame, pairs: DataFrame, members: DataFrame, band_hours: int, block_days: int = BLOCK_DAYS) -> DataFrame:
    """``id, gone, touched, new_list, new_count`` of the events of ``members(node, root)`` after the greedy merge of ``pairs(a_id, b_id)``, of which ``a_id`` starts first.

    An event without a count has one source; a list may lack the event's own.
    """
    partners = pairs.groupBy(F.col("a_id").alias("id")).agg(F.collect_list(F.col("b_id").cast("string")).alias("partners"))  # starts of the next hours
    rows = members.select(F.col("node").alias("id"), "root").join(events.select(*_own()), "id").join(partners, "id", "left").withColumn("key", F.col("id").cast("string"))
    rows = stage(rows.withColumn("block", F.floor(F.col("start") / (block_days * DAY))), "members")
    spans = stage(rows.groupBy("root").agg(F.min("block").alias("first"), F.max("block").alias("last")), "spans")
    return _in_blocks(stage(rows.join(spans, "root"), "members"), band_hours, block_days, False)


def replay_alike(events: DataFrame, cells: DataFrame, band_hours: int, block_days: int = BLOCK_DAYS) -> DataFrame:
    """As ``replay``, of pairs by kinds: events of different sources pair if ``band_hours`` or less lie between them and their keys are partners.

    ``events`` have a ``key`` and ``bin``, the number of the stretch of
    ``band_hours`` that they start in; ``cells(key, bin, root, partners, lead)``
    have the partners among the keys of that stretch and of the next one, which
    the cell's first event, ``lead``, brings to its task.
    """
    block = F.floor(F.col("bin") * F.lit(band_hours * 3_600_000_000) / (block_days * DAY))
    cells = stage(cells.withColumn("block", block), "cells")
    spans = cells.groupBy("root").agg(F.min("block").alias("first"), F.max("block").alias("last"))
    found = events.select("key", "bin", *_own()).join(cells.join(spans, "root"), ["key", "bin"])
    return _in_blocks(stage(found.withColumn("partners", F.when(F.col("id") == F.col("lead"), F.col("partners"))).drop("bin", "lead"), "members"), band_hours, block_days, True)


def _in_blocks(rows: DataFrame, band_hours: int, block_days: int, apart: bool) -> DataFrame:
    """``rows`` with their ``block`` and their component's ``first`` and ``last`` one, replayed in rounds."""
    width, band = block_days * DAY, band_hours * 3_600_000_000
    rounds = rows.agg(F.max(F.col("block") - F.col("first"))).first()[0]
    carried, done = None, []
    for k in range((rounds or 0) + 1):
        now = rows.where(F.col("block") - F.col("first") == k).select(*FIELDS)
        now = now if carried is None else now.unionByName(carried)
        hold = F.when(F.col("first") + k < F.col("last"), (F.col("first") + k + 1) * width - band).otherwise(NEVER)
        out = stage(_replayed(now.withColumn("hold", hold.cast("long")), band, apart), "replayed")
        done.append(out.where("not open"))
        carried = out.where("open").select(*FIELDS)
    return reduce(DataFrame.union, done).select("id", "gone", "touched", F.array_join("sources", ",").alias("new_list"), F.col("n").alias("new_count"))
