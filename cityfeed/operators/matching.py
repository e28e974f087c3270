"""Events of several sources that are the same: band join, greedy merge and upsert."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cityfeed.functions.text import clamp_fields, csv_list, jaccard, sanitize_title, title_tokens, truthy
from cityfeed.sources.tables import stage

BAND_HOURS, SIMILAR = 12, 0.6


def _bin(start: Column) -> Column:
    """Number of the half day of a local time."""
    return F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), start) / (BAND_HOURS * 3_600_000_000)).cast("long")


def _keyed(events: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Dated events with words in their titles: the columns under new names, the half day ``bin`` and ``words``, the title's distinct words sorted and by single spaces."""
    words = F.array_join(F.array_sort(title_tokens(F.col("title"))), " ")
    keyed = events.where("start_at is not null").select(*[F.col(c).alias(n) for c, n in columns.items()], _bin(F.col("start_at")).alias("bin"), words.alias("words"))
    return keyed.where("words <> ''")


def _prefixes(words: DataFrame) -> DataFrame:
    """``words, prefix``: of each different set of words the rarest ones, of which two similar sets share one.

    Sets of which at least the share ``SIMILAR`` is common have that much of
    their own words in common; so of n words, in one order for all sets, the
    first n - ceil(SIMILAR * n) + 1 suffice.
    """
    sets = words.distinct()
    each = sets.select("words", F.explode(F.split("words", " ")).alias("word"))
    often = each.groupBy("word").agg(F.count("*").alias("n"))
    ranked = each.join(often, "word").groupBy("words").agg(F.array_sort(F.collect_list(F.struct("n", "word")))["word"].alias("ranked"))  # the words of a title
    least = F.ceil(F.size("ranked") * F.lit(int(SIMILAR * 100)) / 100).cast("int")
    return ranked.select("words", F.slice("ranked", F.lit(1), F.size("ranked") - least + 1).alias("prefix"))


def _similar_sets(a: DataFrame, b: DataFrame, prefixes: DataFrame, apart: tuple[int, ...]) -> DataFrame:
    """``a_words, a_bin, b_words, bin, similarity``: sets of words alike, of half days so far ``apart``. They meet at a word of both prefixes and count at the first one of them."""
    of_a = a.join(prefixes, "words").select(F.col("words").alias("a_words"), F.col("prefix").alias("a_prefix"), F.col("bin").alias("a_bin"), F.explode("prefix").alias("word"))
    of_a = of_a.withColumn("bin", F.explode(F.array(*[F.col("a_bin") + k for k in apart])))
    of_b = b.join(prefixes, "words").select(F.col("words").alias("b_words"), F.col("prefix").alias("b_prefix"), "bin", F.explode("prefix").alias("word"))
    met = of_a.join(of_b, ["bin", "word"]).where(F.col("word") == F.get(F.array_intersect("a_prefix", "b_prefix"), F.lit(0)))
    return met.withColumn("similarity", jaccard(F.split("a_words", " "), F.split("b_words", " "))).where(F.col("similarity") >= SIMILAR).select("a_words", "a_bin", "b_words", "bin", "similarity")


def similar_pairs(left: DataFrame, right: DataFrame, null_differs: bool = True, also: Column | None = None, of_left: tuple[str, ...] = (), of_right: tuple[str, ...] = ()) -> DataFrame:
    """``(a_id, b_id, similarity)``: titles alike, sources different, starts at most twelve hours apart.

    A missing source differs from any named one, or from none with ``null_differs`` false.
    ``also`` is a further condition over ``a_id, a_start, b_id, b_start`` and the columns ``of_left`` and ``of_right``.

    The band is an equi-join on half-day numbers, one row of ``left`` meeting
    three. First the different sets of words of a half day meet at a rare word
    of their prefixes, so that neither a frequent word nor a title that many
    events have makes a hot key; each pair of sets counts at the first word the
    two share. Then the events of similar sets meet, nearly all of them pairs.
    """
    a = stage(_keyed(left, {"id": "a_id", "source_name": "a_source", "start_at": "a_start"} | {c: c for c in of_left}), "left")
    b = stage(_keyed(right, {"id": "b_id", "source_name": "b_source", "start_at": "b_start"} | {c: c for c in of_right}), "right")
    prefixes = stage(_prefixes(a.select("words").union(b.select("words"))), "prefixes")
    alike = _similar_sets(a.select("words", "bin").distinct(), b.select("words", "bin").distinct(), prefixes, (-1, 0, 1))
    gap = F.abs(F.timestamp_diff("SECOND", F.col("a_start"), F.col("b_start")))
    near = a.withColumnsRenamed({"words": "a_words", "bin": "a_bin"}).join(alike, ["a_words", "a_bin"]).join(b.withColumnRenamed("words", "b_words"), ["b_words", "bin"])
    near = near.where((gap <= BAND_HOURS * 3600) & (~F.col("a_source").eqNullSafe(F.col("b_source")) if null_differs else F.col("a_source") != F.col("b_source")))
    return (near if also is None else near.where(also)).select("a_id", "b_id", "similarity")


def cross_source_duplicate(new: DataFrame, known: DataFrame) -> DataFrame:
    """``(a_id, match_id)``: for each new event the known active event of least id that is the same, or null. A known event without source is never the same."""
    best = similar_pairs(new, known.where("archived_at is null"), null_differs=False).groupBy("a_id").agg(F.min("b_id").alias("match_id"))
    return new.select(F.col("id").alias("a_id")).join(best, "a_id", "left")


def retro_pairs(events: DataFrame) -> DataFrame:
    """Pairs of active events that are the same, the earlier start first, ids breaking ties."""
    on = events.where("archived_at is null and start_at is not null")
    a, b = F.struct("a_start", F.col("a_id").alias("id")), F.struct("b_start", F.col("b_id").alias("id"))
    return similar_pairs(on, on, also=a < b)


def _cells(events: DataFrame) -> DataFrame:
    """``key, bin, root, partners, lead``: the titles of each half day that may have pairs among ``id, start_at, source_name, bin, words``.

    ``partners`` are the similar titles there and in the half day after,
    ``root`` is a number of the chain of titles, ``lead`` the first event.
    """
    from cityfeed.operators.graph import components

    source = F.struct("source_name")  # null is a source
    cells = events.groupBy("words", "bin").agg(F.min("start_at").alias("from"), F.max("start_at").alias("to"), F.min(source).alias("least"), F.max(source).alias("most"), F.min(F.struct("start_at", "id"))["id"].alias("lead"))
    cells = stage(cells.withColumn("node", F.xxhash64("words", "bin")), "cells")  # equal numbers only make one chain of two
    known = cells.select("words", "bin")
    alike = _similar_sets(known, known, stage(_prefixes(known.select("words")), "prefixes"), (0, 1))
    columns = ["words", "bin", "from", "to", "least", "most", "node"]
    a = cells.select(*[F.col(c).alias(f"a_{c}") for c in columns])
    b = cells.select(*[F.col(c).alias("bin" if c == "bin" else f"b_{c}") for c in columns])
    met = alike.join(a, ["a_words", "a_bin"]).join(b, ["b_words", "bin"])
    sources = (F.col("a_least") != F.col("a_most")) | (F.col("b_least") != F.col("b_most")) | (F.col("a_least") != F.col("b_least"))
    near = F.timestamp_diff("SECOND", F.col("a_to"), F.col("b_from")) <= BAND_HOURS * 3600
    met = stage(met.where(sources & near).select("a_words", "a_bin", "a_node", "b_words", "b_node"), "alike")
    partners = met.groupBy(F.col("a_words").alias("key"), F.col("a_bin").alias("bin")).agg(F.collect_set("b_words").alias("partners"))
    nodes = met.select(F.explode(F.array("a_node", "b_node")).alias("node")).distinct()
    roots = nodes.join(components(met.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    return cells.withColumnRenamed("words", "key").join(roots, "node").join(partners, ["key", "bin"], "left").select("key", "bin", "root", "partners", "lead")


def retro_merge(events: DataFrame) -> DataFrame:
    """``events`` after the greedy merge of duplicates; the others stay as they are.

    Pairs are taken by start, then id; the event with the higher source count,
    the earlier one on a tie, stays and takes over the other's source. An
    event that is gone takes part in no further pair. The pairs themselves are
    not made: titles of half days form chains that don't affect each other, so
    these are replayed side by side, each in the order of time, and an event
    meets those of similar titles that are still there.
    """
    from cityfeed.operators.replay import replay_alike

    on = stage(_keyed(events.where("archived_at is null"), {c: c for c in ("id", "start_at", "source_name", "sources_list", "source_count")}), "keyed")
    changes = replay_alike(on.withColumnRenamed("words", "key"), _cells(on), BAND_HOURS)
    out = events.join(changes.where("gone or touched"), "id", "left").where(~F.coalesce("gone", F.lit(False)))
    touched = F.coalesce("touched", F.lit(False))
    return out.withColumns(
        {"sources_list": F.when(touched, F.col("new_list")).otherwise(F.col("sources_list")), "source_count": F.when(touched, F.col("new_count")).otherwise(F.col("source_count"))}
    ).select(*events.columns)


def first_of_batch(batch: DataFrame, order: str = "pos") -> DataFrame:
    """The first row of each canonical_id; rows without one go."""
    w = Window.partitionBy("canonical_id").orderBy(order)
    return batch.where(truthy(F.col("canonical_id"))).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def add_source(sources: Column, own: Column, other: Column) -> Column:
    """The list with its own source in front if it was missing and the other at its end."""
    current = csv_list(sources)
    current = F.when(truthy(own) & ~F.array_contains(current, own), F.concat(F.array(own), current)).otherwise(current)
    return F.when(truthy(other) & ~F.array_contains(current, other), F.concat(current, F.array(other))).otherwise(current)


def numbered(rows: DataFrame, order: str | list[Column], name: str = "n") -> DataFrame:
    """``rows`` with consecutive numbers from 1 by ``order``, a column or sort orders, without gathering them in one task.

    Rows are dealt by ranges of ``order`` and staged; the driver sees one count
    per range.
    """
    by = [F.col(order).asc_nulls_first()] if isinstance(order, str) else order
    dealt = stage(rows.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = sorted(map(tuple, dealt.groupBy("_range").agg(F.count("*").alias("n")).collect()))
    before = dict(zip((r for r, _ in counts), accumulate((n for _, n in counts), initial=0), strict=False))
    offsets = rows.sparkSession.createDataFrame(list(before.items()), "_range int, _before long")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    return dealt.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + own).drop("_range", "_before")  # a row per range


@dataclass(frozen=True)
class Upsert:
    """The new state and, per incoming row, what became of it."""

    state: DataFrame
    outcome: DataFrame


def upsert(state: DataFrame, batch: DataFrame, source_name: str, now) -> Upsert:
    """Merge one source's batch into ``events``.

    Rows of known canonical_id update what they say (null says nothing), rows
    that another source already has add their source to it, the rest is new.
    A row without title is rejected by itself. Ids of new rows follow the
    largest known one in batch order.
    """
    order = "pos" if "pos" in batch.columns else "canonical_id"
    batch = first_of_batch(batch, order)
    batch = clamp_fields(batch.withColumns({c: sanitize_title(F.col(c)) for c in ("title", "venue_name") if c in batch.columns}))
    for c in state.columns:
        if c not in batch.columns:
            batch = batch.withColumn(c, F.lit(None).cast(state.schema[c].dataType))
    batch = batch.withColumn("source_name", F.coalesce("source_name", F.lit(source_name)))
    known = state.select("canonical_id", F.col("id").alias("known_id"))
    batch = batch.join(known, "canonical_id", "left")

    news = batch.where("known_id is null and title is not null")
    top = state.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    keys = news.select("canonical_id") if order == "canonical_id" else news.select("canonical_id", order)
    news = news.drop("id").join(numbered(keys, order).select("canonical_id", "n"), "canonical_id").withColumn("id", F.lit(top) + F.col("n")).drop("n")
    probe = news.withColumn("source_name", F.lit(source_name))
    news = news.join(cross_source_duplicate(probe, state).withColumnRenamed("a_id", "id"), "id")

    merged = news.where("match_id is not null").select(F.col("match_id").alias("id"), F.col("source_name").alias("other")).distinct()
    updates = batch.where("known_id is not null")
    keep = [c for c in state.columns if c not in ("id", "canonical_id", "created_at", "updated_at", "sources_list", "source_count", "archived_at", "source_name")]
    changed = updates.select(F.col("canonical_id").alias("_cid"), *[F.col(c).alias(f"_{c}") for c in keep])
    out = state.join(changed, F.col("canonical_id") == F.col("_cid"), "left").join(merged, "id", "left")
    new_list = add_source(F.col("sources_list"), F.col("source_name"), F.col("other"))
    grew = F.col("other").isNotNull() & ~F.array_contains(csv_list(F.col("sources_list")), F.col("other"))
    values = {c: F.coalesce(f"_{c}", c) for c in keep}
    values |= {"sources_list": F.when(grew, F.array_join(new_list, ",")).otherwise(F.col("sources_list")), "source_count": F.when(grew, F.size(new_list)).otherwise(F.col("source_count"))}
    if "updated_at" in state.columns:
        values["updated_at"] = F.when(F.col("_cid").isNotNull() | grew, F.lit(now)).otherwise(F.col("updated_at"))
    old = out.select(*[values.get(c, F.col(c)).alias(c) for c in state.columns])
    created = news.where("match_id is null").withColumn("source_count", F.lit(1)).withColumn("sources_list", F.col("source_name"))
    if "created_at" in state.columns:
        created = created.withColumn("created_at", F.lit(now))
    created = created.select(*[F.col(c).cast(state.schema[c].dataType) for c in state.columns])
    outcome = (
        updates.select("canonical_id", F.lit("updated").alias("outcome"))
        .union(news.where("match_id is null").select("canonical_id", F.lit("created")))
        .union(_merged(news.where("match_id is not null"), state))
        .union(batch.where("known_id is null and title is null").select("canonical_id", F.lit("rejected")))
    )
    return Upsert(old.unionByName(created), outcome)


def _merged(matched: DataFrame, state: DataFrame) -> DataFrame:
    """``canonical_id, outcome`` of rows that another source has: merged where that one's list grew, else seen."""
    lists = state.select(F.col("id").alias("match_id"), F.col("sources_list").alias("_list"))
    first = F.min("canonical_id").over(Window.partitionBy("match_id", "source_name")) == F.col("canonical_id")
    grew = ~F.array_contains(csv_list(F.col("_list")), F.col("source_name")) & first  # a list grows by the first of several
    return matched.select("canonical_id", "match_id", "source_name").join(lists, "match_id", "left").select("canonical_id", F.when(grew, "merged").otherwise("seen").alias("outcome"))


def sync_stats(outcome: DataFrame) -> DataFrame:
    """One row: found, created, updated, merged. Rows whose source was known to its match already are found and no more."""
    return outcome.agg(F.count("*").alias("found"), *[F.count_if(F.col("outcome") == k).alias(k) for k in ("created", "updated", "merged")])
