"""Faults of the third round: frequent words as keys of a join."""

import random
from datetime import datetime, timedelta

from cityfeed.functions.text import DEDUP_STOPWORDS
from cityfeed.operators import matching

ROWS = "id long, title string, source_name string, start_at timestamp_ntz, archived_at timestamp_ntz"


def brute(rows, null_differs):
    words = lambda t: {w for w in t.lower().split() if w not in DEDUP_STOPWORDS}
    out = set()
    for a in rows:
        for b in rows:
            x, y = words(a[1]), words(b[1])
            other = a[2] != b[2] and (null_differs or None not in (a[2], b[2]))
            if a[3] and b[3] and x and y and other and abs(a[3] - b[3]) <= timedelta(hours=12) and len(x & y) / len(x | y) >= 0.6:
                out.add((a[0], b[0], round(len(x & y) / len(x | y), 6)))
    return out


def test_similar_pairs_are_those_of_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["lesung"] * 6 + ["konzert"] * 3 + ["jazz", "oper"] * 2 + [f"w{k}" for k in range(12)]
    rows = [
        (k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 7))), rng.choice(["A", "B", "C", None]), rng.choice([None, *[datetime(1969, 12, 31, 18) + timedelta(hours=rng.randint(0, 60))] * 9]), None)
        for k in range(250)
    ]
    events = spark.createDataFrame(rows, ROWS)
    for null_differs in (True, False):
        got = [(r[0], r[1], round(r[2], 6)) for r in matching.similar_pairs(events, events, null_differs).collect()]
        want = brute(rows, null_differs)
        assert len(got) == len(set(got)) and sorted(set(got) ^ want) == [] and len(want) > 50


def test_a_frequent_word_is_no_key(spark):
    words = spark.createDataFrame([(f"{k:04} lesung",) for k in range(300)] + [("abend jazz lesung w",), ("lesung",)], "words string")
    found = {r["words"]: r["prefix"] for r in matching._prefixes(words).collect()}
    assert all(found[f"{k:04} lesung"] == [f"{k:04}"] for k in range(300))
    assert found["abend jazz lesung w"] == ["abend", "jazz"] and found["lesung"] == ["lesung"]


def test_lists_of_siblings_are_made_once_for_a_group(spark):
    from pyspark.sql import functions as F

    from cityfeed.operators import search

    events = spark.createDataFrame([(1, "Lesung", "A", None, None), (2, "lesung", "A", datetime(2026, 1, 1), None), (3, "Lesung", None, None, None), (4, "", "A", None, None)], ROWS)
    out = search.siblings(events, ids=lambda o: F.array_join(F.transform(o, lambda x: x["id"].cast("string")), ","), n=F.size)
    assert {tuple(r) for r in out.collect()} == {(1, "2,1", 2), (2, "2,1", 2), (3, "3", 1), (4, None, None)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("array_join")  # below the join, not for each event
