"""Faceted search over events, as a service and as a browser does it."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, fields
from datetime import date, datetime, timedelta
from itertools import accumulate
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cityfeed.functions import dates
from cityfeed.functions.text import truthy
from cityfeed.operators.firstcome import first_come
from cityfeed.operators.grouping import group_events
from cityfeed.sources.tables import stage

MAX_LIMIT, DEFAULT_LIMIT, ROWS_PER_RESULT, MAX_ROWS = 200, 50, 10, 2000
TOP_PICK_SCORE, TOP_PICKS = 0.6, 3
SHOWN_OCCURRENCES = 8
#: What a task of ``siblings`` gets: bytes of different lists, events, and bytes of lists times events; shares are counted in parts of UNIT.
SLOT_TEXT, SLOT_EVENTS, SLOT_OUTPUT, UNIT = 1 << 19, 100_000, 1 << 32, 1_000_000


@dataclass(frozen=True)
class Facets:
    """What a search asks for; falsy values ask for nothing. ``time_of_day`` is one of ``TIMES_OF_DAY``."""

    start_date: date | None = None
    end_date: date | None = None
    category: str | None = None
    kids_only: bool = False
    indoor_outdoor: str | None = None
    max_travel_time: int | None = None
    time_of_day: str | None = None
    favorites: str | None = None
    q: str | None = None


    def to_query(self) -> str:
        """The parameters of a request to the service; what isn't asked for is left out."""
        pairs = [(f.name, getattr(self, f.name)) for f in fields(self)]
        pairs = [(k, v.strip() if isinstance(v, str) else v) for k, v in pairs if v and v != "all"]
        return urlencode([(k, "true" if v is True else str(v)) for k, v in pairs])


#: The service's names of the times of day, and the short names of this library.
TIMES_OF_DAY = {"vormittags": "morning", "nachmittags": "afternoon", "abends": "evening", "morning": "morning", "afternoon": "afternoon", "evening": "evening"}


def time_of_day_named(name: str) -> str:
    if name not in TIMES_OF_DAY:
        raise ValueError(f"unknown time of day: {name}")
    return TIMES_OF_DAY[name]


def active(events: DataFrame) -> DataFrame:
    return events.where("archived_at is null")


def visible(now) -> Column:
    """Undated, still to come or permanent."""
    start = F.col("start_at")
    return start.isNull() | (start >= F.lit(now)) | F.col("is_permanent_offer")


def facet_filter(facets: Facets) -> Column:
    """The conjunction of the facets asked for."""
    f, out = facets, F.lit(True)
    if f.q and (q := f.q.strip()):
        out &= F.col("title").ilike(f"%{q}%") | F.col("venue_name").ilike(f"%{q}%") | F.col("short_description").ilike(f"%{q}%")
    if f.start_date:
        out &= F.col("start_at") >= F.lit(datetime.combine(f.start_date, datetime.min.time())).cast("timestamp_ntz")
    if f.end_date:
        out &= F.col("start_at") < F.lit(datetime.combine(f.end_date + timedelta(days=1), datetime.min.time())).cast("timestamp_ntz")
    if f.category:
        out &= F.col("category") == f.category
    if f.kids_only:
        out &= F.col("kids_suitable").isin("yes", "likely")
    if f.indoor_outdoor in ("indoor", "outdoor"):
        out &= F.col("indoor_outdoor").isin(f.indoor_outdoor, "both")
    if f.max_travel_time:
        out &= (F.col("travel_time_minutes") <= f.max_travel_time) | F.col("travel_time_minutes").isNull()
    if f.time_of_day:
        out &= dates.time_of_day(F.col("start_at")) == time_of_day_named(f.time_of_day)
    if f.favorites and (ids := [x for x in f.favorites.split(",") if x]):
        out &= F.col("canonical_id").isin(ids)
    return out


def sort_order(sort: str) -> list[Column]:
    """Order of groups: smart, quality, travel or start_at; ids break ties."""
    start, quality = F.col("headline_at").asc_nulls_last(), F.coalesce("quality_score", F.lit(0.0)).desc()
    return {
        "smart": [start, quality],
        "quality": [quality, start],
        "travel": [F.col("travel_time_minutes").asc_nulls_last(), start],
        "start_at": [start],
    }[sort if sort in ("quality", "travel", "start_at") else "smart"] + [F.col("id")]


def search(events: DataFrame, now, facets: Facets = Facets(), sort: str = "smart", limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Groups of the first ``limit * 10`` (2000 at most) matching events by start, sorted, ``limit`` of them.

    Both limits are part of the query; each is a top-k without a global sort.
    """
    if not 0 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be at most {MAX_LIMIT}")
    found = active(events).where(visible(now)).where(facet_filter(facets))
    found = found.orderBy(F.col("start_at").asc_nulls_last(), "id").limit(min(limit * ROWS_PER_RESULT, MAX_ROWS))
    return group_events(found, now).orderBy(*sort_order(sort)).limit(limit)


def feed(events: DataFrame, now, facets: Facets = Facets()) -> DataFrame:
    """All groups of the matching events, without limits."""
    return group_events(active(events).where(visible(now)).where(facet_filter(facets)), now)


def _slots(groups: DataFrame) -> tuple[DataFrame, int]:
    """``groups(k, source_name, n, text)`` with ``slot`` and ``parts``, and the number of slots: tasks of about ``SLOT_EVENTS`` events, ``SLOT_OUTPUT`` bytes of their lists or ``SLOT_TEXT`` bytes of different lists.

    A large group has ``parts`` slots of its own from ``slot`` on; the others
    share slots, dealt by running sums of their shares in millionths.
    """
    share = F.greatest(F.col("text") / SLOT_TEXT, F.col("n") / SLOT_EVENTS + F.col("n") * F.col("text") / SLOT_OUTPUT)
    large = share >= 0.5
    rows = groups.select("k", "source_name", large.alias("large"), (F.when(large, F.ceil(share) * UNIT).otherwise(F.ceil(share * UNIT))).cast("long").alias("units"))
    by = [F.col("large").desc(), F.col("k").asc_nulls_first(), F.col("source_name").asc_nulls_first()]
    dealt = stage(rows.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = sorted(map(tuple, dealt.groupBy("_range").agg(F.sum("units")).collect()))  # a row per range
    before = [0, *accumulate(x for _, x in sums)]
    starts = groups.sparkSession.createDataFrame([(r, at) for (r, _), at in zip(sums, before, strict=False)], "_range int, _before long")
    window = Window.partitionBy("_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("_before") + F.coalesce(F.sum("units").over(window), F.lit(0)) + F.when(F.col("large"), 0).otherwise(F.floor(F.col("units") / 2))
    placed = dealt.join(F.broadcast(starts), "_range").select("k", "source_name", F.floor(at / UNIT).alias("slot"), F.when(F.col("large"), F.floor(F.col("units") / UNIT)).otherwise(1).alias("parts"))
    return placed, max(1, -(-before[-1] // UNIT))


def siblings(events: DataFrame, **columns: Callable[[Column], Column]) -> DataFrame:
    """``event_id, siblings``: of every event the active ones of its source, null or not, and normalised title, by start; none for an empty title.

    ``columns`` take the place of ``siblings``, each worked out from that list
    once for all events that share it.

    The lists of all events together are quadratic in a group. Events and lists
    are dealt to the same tasks, few lists to one, so that a Parquet writer
    keeps each list once, in its dictionary. With many lists in a task it would
    give the dictionary up and write out the lists of up to 20,000 events at
    once, in memory.
    """
    from cityfeed.functions.text import group_title

    keyed = stage(events.select("id", "start_at", "source_name", "archived_at", group_title(F.col("title")).alias("k")), "keyed")
    titled, on = keyed.where("k <> ''"), F.col("archived_at").isNull()
    sizes = titled.groupBy("k", "source_name").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(on, F.length(F.col("id").cast("string")) + 1)), F.lit(0)).alias("text"))
    placed, slots = _slots(sizes)
    placed = stage(placed, "slots").withColumnsRenamed({"k": "key", "source_name": "source"})
    same = (F.col("k") == F.col("key")) & F.col("source_name").eqNullSafe(F.col("source"))
    members = titled.select("id", "k", "source_name").join(placed, same).select("id", "k", "source_name", (F.col("slot") + F.pmod(F.xxhash64("id"), "parts")).cast("int").alias("slot"))
    members = members.repartitionById(slots, F.col("slot")).sortWithinPartitions(F.xxhash64("id"))  # lists by turns: bounds of a page are told from most of them at a glance
    listed = active(titled).groupBy("k", "source_name").agg(F.sort_array(F.collect_list(F.struct(F.col("start_at").isNull().alias("undated"), "start_at", "id"))).alias("o"))
    columns = columns or {"siblings": lambda o: F.transform(o, lambda x: F.struct(x["id"].alias("id"), x["start_at"].alias("start_at")))}
    listed = listed.select("k", "source_name", *[f(F.col("o")).alias(name) for name, f in columns.items()]).join(placed, same)
    listed = listed.select("key", "source", *columns, F.explode(F.sequence(F.col("slot").cast("int"), (F.col("slot") + F.col("parts") - 1).cast("int"))).alias("at"))
    out = members.join(listed.repartitionById(slots, F.col("at")).hint("shuffle_hash"), (F.col("slot") == F.col("at")) & same, "left").select(F.col("id").alias("event_id"), *columns)
    return out.union(keyed.where("k = ''").select("id", *[F.lit(None).cast(out.schema[c].dataType).alias(c) for c in columns]))


def detail(events: DataFrame, event_id: int) -> DataFrame:
    """One event and its siblings: same source, null or not, and same normalised title, by start."""
    from cityfeed.functions.text import group_title

    keyed = events.withColumn("title_key", group_title(F.col("title")))
    one = keyed.where(F.col("id") == event_id).select(F.col("id").alias("event_id"), F.col("title_key").alias("k"), F.col("source_name").alias("s"))
    same = (keyed["title_key"] == F.col("k")) & keyed["source_name"].eqNullSafe(F.col("s"))
    alike = active(keyed).join(F.broadcast(one.where("k <> ''")), same)  # one row, by its key
    listed = alike.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct(F.col("start_at").isNull().alias("undated"), "start_at", "id"))).alias("o"))
    own = events.where(F.col("id") == event_id)
    out = own.join(listed, own["id"] == listed["event_id"], "left")
    self_only = F.array(F.struct(F.col("start_at").isNull().alias("undated"), F.col("start_at"), F.col("id")))
    return out.withColumn("occurrences", F.transform(F.coalesce("o", self_only), lambda x: F.struct(x["id"].alias("id"), x["start_at"].alias("start_at")))).drop("o", "event_id")


@dataclass(frozen=True)
class ClientState:
    """What the browser list shows; defaults are left out of its URL."""

    range: str = "today"
    category: str = ""
    excluded: tuple[str, ...] = ()
    kids_only: bool = False
    indoor_outdoor: str = ""
    max_travel_time: int = 30
    time_of_day: str = ""
    favorites_only: bool = False
    q: str = ""
    sort: str = "smart"

    def to_query(self) -> str:
        pairs = []
        for f in fields(self):
            value = getattr(self, f.name)
            if value != f.default:
                pairs.append((f.name, ",".join(value) if isinstance(value, tuple) else str(int(value)) if isinstance(value, bool) else str(value)))
        return urlencode(pairs)

    @classmethod
    def from_query(cls, query: str) -> ClientState:
        got = dict(parse_qsl(query))
        out = {}
        for f in fields(cls):
            if f.name in got:
                value, kind = got[f.name], type(f.default)
                out[f.name] = tuple(x for x in value.split(",") if x) if kind is tuple else value == "1" if kind is bool else int(value) if kind is int else value
        return cls(**out)


def client_group_filter(state: ClientState, favorites: list[str] | None = None) -> Column:
    """What the browser asks of a whole group."""
    out = F.lit(True)
    if state.favorites_only:
        out &= F.col("canonical_id").isin(favorites or [])
    if state.category:
        out &= F.col("category") == state.category
    if state.excluded:
        out &= F.col("category").isNull() | ~F.col("category").isin(list(state.excluded))
    if state.kids_only:
        out &= F.col("kids_suitable").isin("yes", "likely")
    if state.indoor_outdoor in ("indoor", "outdoor"):
        out &= F.col("indoor_outdoor").isin(state.indoor_outdoor, "both")
    if state.max_travel_time:
        out &= (F.col("travel_time_minutes") <= state.max_travel_time) | F.col("travel_time_minutes").isNull()
    if q := state.q.strip():
        part = lambda c: F.coalesce(c, F.lit(""))
        out &= F.lower(F.concat_ws(" ", part(F.col("title")), part(F.col("venue_name")), part(F.col("short_description")))).contains(q.lower())
    return out


def client_feed(groups: DataFrame, now, state: ClientState, favorites: list[str] | None = None) -> DataFrame:
    """Groups with an occurrence that is not past and fits range and time of day; ``effective_at`` is its start.

    A permanent group counts as never past, but an undated occurrence fits no
    range and no time of day.
    """
    now = F.lit(now)

    def fits(o: Column) -> Column:
        start = o["start_at"]
        ok = start.isNull() | (start >= now) | F.coalesce(F.col("is_permanent_offer"), F.lit(False))
        if state.range in ("today", "tomorrow", "weekend"):
            first, last = dates.range_bounds(state.range, now)
            ok &= F.coalesce(F.to_date(start).between(first, last), F.lit(False))
        if state.time_of_day:
            ok &= F.coalesce(dates.time_of_day(start) == time_of_day_named(state.time_of_day), F.lit(False))
        return ok

    out = groups.where(client_group_filter(state, favorites)).withColumn("fitting", F.filter("occurrences", fits))
    return out.where(F.size("fitting") > 0).withColumn("effective_at", F.array_min(F.transform("fitting", lambda o: o["start_at"]))).drop("fitting")


def client_order(sort: str) -> list[Column]:
    """Order of what the browser lists, by the effective start; ids break ties."""
    start, quality = F.col("effective_at").asc_nulls_last(), F.coalesce("quality_score", F.lit(0.0)).desc()
    return {"quality": [quality, start], "travel": [F.col("travel_time_minutes").asc_nulls_last(), start], "start_at": [start]}.get(sort, [start, quality]) + [F.col("id")]


def client_list(groups: DataFrame, now, state: ClientState, favorites: list[str] | None = None) -> DataFrame:
    """``client_feed`` in the order that the state asks for."""
    return client_feed(groups, now, state, favorites).orderBy(*client_order(state.sort))


def permanent_extras(groups: DataFrame, shown: DataFrame, state: ClientState) -> DataFrame:
    """Permanent offers that fit the state and aren't shown, best first; none unless a range or a time of day is asked for."""
    if state.range not in ("today", "tomorrow", "weekend") and not state.time_of_day:
        return groups.limit(0)
    return groups.where(F.col("is_permanent_offer")).where(client_group_filter(state)).join(shown.select("id"), "id", "left_anti").orderBy(F.coalesce("quality_score", F.lit(0.0)).desc(), "id")


def top_picks(groups: DataFrame) -> DataFrame:
    """The three best groups of quality 0.6 or more, or none if there are fewer than two."""
    best = groups.where(F.col("quality_score") >= TOP_PICK_SCORE).orderBy(F.col("quality_score").desc(), "id").limit(TOP_PICKS)
    enough = best.agg((F.count("*") >= 2).alias("enough"))
    return best.join(F.broadcast(enough), F.col("enough")).drop("enough")  # one row


def available_categories(groups: DataFrame, state: ClientState) -> DataFrame:
    """Categories under the other filters, and those selected or excluded, sorted."""
    from dataclasses import replace

    open_ = groups.where(client_group_filter(replace(state, category="", excluded=()))).where(truthy(F.col("category"))).select("category").distinct()
    named = [(c,) for c in {state.category, *state.excluded} if c]
    own = groups.sparkSession.createDataFrame(named, "category string")
    return open_.union(own).distinct().orderBy("category")


def find_by_any_id(groups: DataFrame, event_id: int) -> DataFrame:
    """The group of an event or of one of its occurrences."""
    return groups.where((F.col("id") == event_id) | F.exists("occurrences", lambda o: o["id"] == event_id))


def further_occurrences(groups: DataFrame, now) -> DataFrame:
    """The first eight occurrences to come other than the headline, and how many more there are."""
    later = F.filter("occurrences", lambda o: (o["start_at"] >= F.lit(now)) & (o["start_at"] != F.col("headline_at")))
    return groups.select("id", F.slice(later, 1, SHOWN_OCCURRENCES).alias("further"), F.greatest(F.lit(0), F.size(later) - SHOWN_OCCURRENCES).alias("more"))


def map_points(groups: DataFrame) -> DataFrame:
    return groups.where("lat is not null and lon is not null")


def bounding_box(groups: DataFrame) -> DataFrame:
    """One row: groups, points on the map and their bounds."""
    return groups.agg(
        F.count("*").alias("n_groups"),
        F.count_if(F.col("lat").isNotNull() & F.col("lon").isNotNull()).alias("n_points"),
        *[f(F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.col(c))).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))],
    )


def clusters(groups: DataFrame, degrees: float) -> DataFrame:
    """Points by grid cell: count and centre."""
    cell = [F.floor(F.col(c) / degrees).alias(f"cell_{c}") for c in ("lat", "lon")]
    return map_points(groups).groupBy(*cell).agg(F.count("*").alias("n"), F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"))


def pixel_clusters(groups: DataFrame, zoom: int, pixels: int = 40) -> DataFrame:
    """Points by square of ``pixels`` on a Mercator map of that zoom: count and centre."""
    size = 256.0 * 2**zoom
    y = 0.5 - F.log(F.tan(F.radians("lat")) + 1 / F.cos(F.radians("lat"))) / (2 * math.pi)
    cell = [F.floor((F.col("lon") + 180) / 360 * size / pixels).alias("cell_x"), F.floor(y * size / pixels).alias("cell_y")]
    return map_points(groups).groupBy(*cell).agg(F.count("*").alias("n"), F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"))


def radius_clusters(groups: DataFrame, zoom: int, pixels: int = 40) -> DataFrame:
    """Clusters of points within ``pixels`` of their first one, on a Mercator map of that zoom: ``anchor, n, lat, lon``.

    In the order of ids, a point joins the first cluster whose anchor is within
    the radius, and is the anchor of a new one without such. Places count in
    whole pixels, so all points of a pixel fall to one cluster and are added up
    first, and a place has some 5,000 neighbours at most; they are found in the
    nine squares around it.
    """
    size = 256.0 * 2**zoom
    y = (0.5 - F.log(F.tan(F.radians("lat")) + 1 / F.cos(F.radians("lat"))) / (2 * math.pi)) * size
    points = map_points(groups).select("id", "lat", "lon", F.floor((F.col("lon") + 180) / 360 * size).alias("x"), F.floor(y).alias("y"))
    places = stage(points.groupBy("x", "y").agg(F.min("id").alias("p"), F.count("*").alias("n"), F.sum("lat").alias("lat"), F.sum("lon").alias("lon")), "places")
    square = [F.floor(F.col(c) / pixels).alias(f"s{c}") for c in "xy"]
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    own = places.select("p", "x", "y", *square, F.explode(around).alias("d")).select("p", "x", "y", (F.col("sx") + F.col("d.a")).alias("sx"), (F.col("sy") + F.col("d.b")).alias("sy"))
    others = places.select(F.col("p").alias("q"), F.col("x").alias("qx"), F.col("y").alias("qy"), *square)
    near = own.join(others, ["sx", "sy"]).where((F.col("q") < F.col("p")) & ((F.col("x") - F.col("qx")) ** 2 + (F.col("y") - F.col("qy")) ** 2 <= pixels**2))
    joined = first_come(near.select("p", "q", F.lit(False).alias("own"))).where("fate = 'merged'").select("p", "match")
    members = places.join(joined, "p", "left").groupBy(F.coalesce("match", "p").alias("anchor"))
    return members.agg(F.sum("n").alias("n"), F.round(F.sum("lat") / F.sum("n"), 6).alias("lat"), F.round(F.sum("lon") / F.sum("n"), 6).alias("lon"))


def map_legend(groups: DataFrame) -> DataFrame:
    """Categories of the points on the map, sorted."""
    return map_points(groups).where(truthy(F.col("category"))).select("category").distinct().orderBy("category")


def page_ids(groups: DataFrame) -> DataFrame:
    """The names of the detail pages: every id of a group or an occurrence, and the fallback page."""
    ids = groups.select(F.explode(F.array_union(F.array("id"), F.transform("occurrences", lambda o: o["id"]))).alias("id")).select(F.col("id").cast("string").alias("page"))
    return ids.distinct().union(groups.sparkSession.createDataFrame([("_",)], "page string"))
