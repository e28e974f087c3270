"""All batches at once against one source after the other."""

import random
from datetime import datetime, timedelta

import pytest

from cityfeed.operators import matching, merging
from cityfeed.sources.schema import EVENTS, conform
from cityfeed.sources.tables import stage

NOW = datetime(2026, 7, 1, 12)
BATCH = "source_name string, canonical_id string, title string, start_at timestamp_ntz, price_text string, venue_name string, pos long, archived_at timestamp_ntz"


def random_case(seed):
    r = random.Random(seed)
    words = ["sommer", "nacht", "fest", "jazz", "lesung"]
    title = lambda: " ".join(r.sample(words, r.choice([2, 3, 3]))) if r.random() < 0.9 else None
    at = lambda: NOW + timedelta(hours=r.randrange(0, 60)) if r.random() < 0.95 else None
    sources = ["A", "B", "C", "D", "E"]
    state = [(k, f"s{k}", title() or "fest", at(), r.choice([*sources, None]), NOW if r.random() < 0.2 else None) for k in range(1, 12)]
    rows, pos = [], 0
    for s in sources:
        for _ in range(r.randrange(3, 9)):
            pos += 1
            # keys of known events, of other sources' rows, repeated ones of the source itself, and empty ones
            cid = r.choice([f"s{r.randrange(1, 14)}", f"n{r.randrange(0, 12)}", f"{s}{pos}", f"{s}{pos}", ""])
            rows.append((s, cid, title(), at(), r.choice([None, "5 €", "7 €"]), r.choice([None, " Saal  Eins "]), pos, NOW if r.random() < 0.1 else None))
    r.shuffle(rows)
    return state, rows, sources


def events_of(spark, state):
    full = [(i, c, t, a, s, s or "", 1, x) for i, c, t, a, s, x in state]
    return conform(spark.createDataFrame(full, "id long, canonical_id string, title string, start_at timestamp_ntz, source_name string, sources_list string, source_count int, archived_at timestamp_ntz"), EVENTS)


def one_by_one(spark, state, batch, sources):
    outcome = []
    for s in sources:
        done = matching.upsert(state, batch.where(batch.source_name == s), s, NOW)
        outcome += [(s, r.canonical_id, r.outcome) for r in done.outcome.collect()]
        state = stage(done.state, "state")
    return state, sorted(outcome)


@pytest.mark.parametrize("seed", range(2))
def test_like_one_after_the_other(spark, seed):
    state, rows, sources = random_case(seed)
    events, batch = events_of(spark, state), spark.createDataFrame(rows, BATCH)
    want, outcome = one_by_one(spark, events, batch, sources)
    done = merging.upsert_all(events, batch, sources, NOW)
    assert sorted(map(tuple, done.outcome.collect())) == outcome
    assert sorted(map(str, done.state.collect())) == sorted(map(str, want.collect()))
    assert {x for _, _, x in outcome} >= {"created", "updated", "merged"}


def test_chain_of_sources(spark):
    """Each row is like the one before it alone: every second one becomes an event."""
    sources = [f"S{k:02}" for k in range(6)]
    titles = [" ".join(f"w{j}" for j in range(k, k + 6)) for k in range(6)]  # neighbours share 5 of 7 words, the next 4 of 8
    batch = spark.createDataFrame([(s, f"c{k}", titles[k], NOW, None, None, k, None) for k, s in enumerate(sources)], BATCH)
    done = merging.upsert_all(events_of(spark, []), batch, sources, NOW)
    want, outcome = one_by_one(spark, events_of(spark, []), batch, sources)
    assert [x for _, _, x in sorted(map(tuple, done.outcome.collect()))] == ["created", "merged"] * 3
    assert sorted(map(str, done.state.collect())) == sorted(map(str, want.collect()))


def test_nothing_to_merge(spark):
    events = events_of(spark, [(3, "k", "Fest", NOW, "A", None)])
    none = spark.createDataFrame([], BATCH)
    done = merging.upsert_all(events, none, ["A"], NOW)
    assert done.outcome.count() == 0 and sorted(map(str, done.state.collect())) == sorted(map(str, events.collect()))
    other = spark.createDataFrame([("X", "c", "Fest", NOW, None, None, 1, None)], BATCH)
    assert merging.upsert_all(events, other, ["A"], NOW).outcome.count() == 0
