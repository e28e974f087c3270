"""The batches of all sources into the events at once, as if each were merged after those before it.

A source is matched against the events and what the sources before it brought.
Which rows it may match is known without waiting: the events, in the version
that the sources before it left, and every earlier row that may become an
event. One band join finds all these candidates; what remains is who comes
first. A row becomes an event if none of its candidates is one, else it merges
with the least. That is settled in rounds, in each of which every row whose
least candidate is settled is settled itself. Candidates are of earlier
sources, so there are no more rounds than sources; rows without candidates,
most of them, take part in none.

The number of shuffles doesn't depend on the sources otherwise, and the events
are rewritten once. Only numbers for each source reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cityfeed.functions.text import clamp_fields, csv_list, sanitize_title, truthy
from cityfeed.operators.firstcome import first_come
from cityfeed.operators.matching import numbered, similar_pairs
from cityfeed.sources.tables import stage

#: Columns of an event that no source's row changes.
FIXED = ("id", "canonical_id", "created_at", "updated_at", "sources_list", "source_count", "archived_at", "source_name")


@dataclass(frozen=True)
class Merged:
    """The new events, and per source and canonical_id what became of the row: created, updated, merged, seen or rejected."""

    state: DataFrame
    outcome: DataFrame


def _prepared(state: DataFrame, batch: DataFrame, sources: list[str]) -> DataFrame:
    """The first row of each source and canonical_id, with all columns of an event, the source's ``_rank``, its place ``_pos`` and the id ``_known`` of its event."""
    spark = state.sparkSession
    ranks = spark.createDataFrame([(s, k) for k, s in enumerate(sources)], "source_name string, _rank int")
    order = "pos" if "pos" in batch.columns else "canonical_id"
    rows = batch.where(truthy(F.col("canonical_id"))).join(F.broadcast(ranks), "source_name")  # a row per source
    first = Window.partitionBy("_rank", "canonical_id").orderBy(order)
    rows = rows.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").withColumn("_pos", F.col(order))
    rows = clamp_fields(rows.withColumns({c: sanitize_title(F.col(c)) for c in ("title", "venue_name") if c in rows.columns}))
    for c in state.columns:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(state.schema[c].dataType))
    known = state.where("canonical_id is not null").select("canonical_id", F.col("id").alias("_known"))
    return rows.join(known, "canonical_id", "left").select("_rank", "_pos", "_known", *[F.col(c).cast(state.schema[c].dataType).alias(c) for c in state.columns])


def _versions(rows: DataFrame) -> DataFrame:
    """``id, source_name, title, start_at, since, until``: what the rows ``since`` of an event say together, valid for sources after ``since`` up to ``until``."""
    w = Window.partitionBy("id").orderBy("since")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    said = {c: F.last(c, ignorenulls=True).over(so_far) for c in ("title", "start_at")}
    return rows.withColumns(said | {"source_name": F.first("source_name").over(so_far), "until": F.lead("since").over(w)})


def _candidates(state: DataFrame, rows: DataFrame, titled: DataFrame) -> DataFrame:
    """``p, q``: row ``p`` merges with ``q``, an event or an earlier row, if that one is an event then."""
    told = state.where("archived_at is null").select("id", "source_name", "title", "start_at", F.lit(-1).alias("since"))
    news = rows.where("_known is not null").select(F.col("_known").alias("id"), F.lit(None).cast("string").alias("source_name"), "title", "start_at", F.col("_rank").alias("since"))
    events = _versions(told.unionByName(news.join(told.select("id"), "id", "left_semi")))
    own = titled.where("archived_at is null").select("canonical_id", "p", F.col("_rank").alias("_first"), F.col("source_name").alias("_name"))
    later = rows.where("_known is null").select("canonical_id", "title", "start_at", F.col("_rank").alias("since"))
    may_be = own.join(later, "canonical_id").where("since >= _first").select(F.col("p").alias("id"), F.col("_name").alias("source_name"), "title", "start_at", "since")
    probes = titled.select(F.col("p").alias("id"), "source_name", "title", "start_at", "_rank")
    valid = (F.col("since") < F.col("_rank")) & (F.col("until").isNull() | (F.col("_rank") <= F.col("until")))
    pairs = similar_pairs(probes, events.unionByName(_versions(may_be)), null_differs=False, also=valid, of_left=("_rank",), of_right=("since", "until"))
    return pairs.select(F.col("a_id").alias("p"), F.col("b_id").alias("q"))


def _fates(pairs: DataFrame, titled: DataFrame, top: int) -> DataFrame:
    """``p, fate, match`` of the rows that have candidates or earlier rows of their canonical_id, which they update once one is an event."""
    before = titled.select("canonical_id", F.col("p").alias("q"), F.col("_rank").alias("_earlier"))
    own = titled.select("canonical_id", "p", "_rank").join(before, "canonical_id").where("_earlier < _rank")
    return first_come(pairs.select("p", "q", F.lit(False).alias("own")).union(own.select("p", "q", F.lit(True).alias("own"))), F.col("q") <= top)


def _ids(news: DataFrame, top: int) -> DataFrame:
    """``p, id``: a source's new rows, merged ones included, are numbered after the greatest id before it."""
    n = numbered(news.select("p", "_rank", "fate"), "p")
    spans = n.groupBy("_rank").agg(F.min("n").alias("first"), F.max(F.when(F.col("fate") == "created", F.col("n"))).alias("last")).collect()  # a row per source
    shift = []
    for rank, first, last in sorted(map(tuple, spans)):
        shift.append((rank, top - first + 1))
        top += last - first + 1 if last else 0
    shifts = news.sparkSession.createDataFrame(shift, "_rank int, _shift long")
    return n.join(F.broadcast(shifts), "_rank").select("p", (F.col("n") + F.col("_shift")).alias("id"))  # a row per source


def upsert_all(state: DataFrame, batch: DataFrame, sources: list[str], now) -> Merged:
    """``batch``, rows of any of the ``sources``, into the events ``state``, source by source in that order.

    Rows of known canonical_id update what they say (null says nothing), rows
    that another source already has add their source to it, the rest is new. A
    row without title that no event has is rejected. Rows of other sources and
    without canonical_id are left out.
    """
    rows = stage(_prepared(state, batch, sources), "batch")
    top = state.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    fresh = rows.where("_known is null")
    keys = fresh.where("title is not null").select("canonical_id", "_rank", "source_name", "title", "start_at", "archived_at", F.struct("_rank", "_pos").alias("_order"))
    titled = stage(numbered(keys, "_order").withColumn("p", F.col("n") + top).drop("n", "_order"), "fresh")
    fates = _fates(_candidates(state, rows, titled), titled, top)
    told = titled.select("p", "canonical_id", "_rank", "source_name").join(fates, "p", "left").withColumn("fate", F.coalesce("fate", F.lit("created")))
    told = stage(told, "told")
    ids = stage(_ids(told.where("fate <> 'updated'"), top), "ids")
    told = told.join(ids, "p", "left")

    made = told.where("fate = 'created'").select("canonical_id", "_rank", "id")
    created = fresh.drop("id").join(made, ["canonical_id", "_rank"]).withColumns({"source_count": F.lit(1), "sources_list": F.col("source_name")} | ({"created_at": F.lit(now).cast("timestamp_ntz")} if "created_at" in state.columns else {}))
    base = state.unionByName(created.select(*[F.col(c).cast(state.schema[c].dataType).alias(c) for c in state.columns]))

    after = fresh.drop("id").join(made.select("canonical_id", F.col("_rank").alias("_made"), "id"), "canonical_id").where("_rank > _made")
    keep = [c for c in state.columns if c not in FIXED]
    updates = rows.where("_known is not null").withColumn("id", F.col("_known")).select("id", "_rank", "source_name", "canonical_id", *keep).unionByName(after.select("id", "_rank", "source_name", "canonical_id", *keep))
    said = updates.groupBy(F.col("id").alias("_id")).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_rank"))).alias(f"_{c}") for c in keep])

    to = ids.select(F.col("p").alias("match"), F.col("id").alias("_to"))
    merged = told.where("fate = 'merged'").select("match", "_rank", "source_name", "canonical_id").join(to, "match", "left").withColumn("match", F.when(F.col("match") <= top, F.col("match")).otherwise(F.col("_to"))).drop("_to")
    merged = stage(merged, "merged")
    once = merged.groupBy("match", "_rank", "source_name").agg(F.min("canonical_id").alias("canonical_id"))
    others = once.groupBy(F.col("match").alias("_match")).agg(F.array_sort(F.collect_list(F.struct("_rank", "source_name")))["source_name"].alias("_others"))  # at most one of each source

    out = base.join(said, F.col("id") == F.col("_id"), "left").join(others, F.col("id") == F.col("_match"), "left")
    out = out.withColumn("_current", csv_list(F.col("sources_list")))
    out = out.withColumn("_grown", F.array_except(F.coalesce("_others", F.array().cast("array<string>")), "_current"))
    own, grew = F.col("source_name"), F.size("_grown") > 0
    front = F.when(truthy(own) & ~F.array_contains("_current", own), F.concat(F.array(own), "_current")).otherwise(F.col("_current"))
    longer = F.concat(front, "_grown")
    values = {c: F.coalesce(f"_{c}", c) for c in keep}
    values |= {"sources_list": F.when(grew, F.array_join(longer, ",")).otherwise(F.col("sources_list")), "source_count": F.when(grew, F.size(longer)).otherwise(F.col("source_count"))}
    if "updated_at" in state.columns:
        values["updated_at"] = F.when(F.col("_id").isNotNull() | grew, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("updated_at"))

    lists = base.select(F.col("id").alias("match"), F.col("sources_list").alias("_list"))
    grows = once.join(lists, "match").select("match", "source_name", "canonical_id", (~F.array_contains(csv_list(F.col("_list")), F.col("source_name"))).alias("_grows"))
    by_merge = merged.join(grows, ["match", "source_name", "canonical_id"], "left").select("source_name", "canonical_id", F.when(F.col("_grows"), "merged").otherwise("seen").alias("outcome"))
    updated = updates.select("source_name", "canonical_id", F.lit("updated").alias("outcome"))
    lost = fresh.where("title is null").join(updates.select("source_name", "canonical_id"), ["source_name", "canonical_id"], "left_anti")
    outcome = (
        updated.union(told.where("fate = 'created'").select("source_name", "canonical_id", F.lit("created"))).union(by_merge).union(lost.select("source_name", "canonical_id", F.lit("rejected")))
    )
    return Merged(out.select(*[values.get(c, F.col(c)).alias(c) for c in state.columns]), outcome)


def stats_by_source(outcome: DataFrame) -> DataFrame:
    """``source_name, found, created, updated, merged``, a row per source that brought something."""
    return outcome.groupBy("source_name").agg(F.count("*").alias("found"), *[F.count_if(F.col("outcome") == k).alias(k) for k in ("created", "updated", "merged")])
