"""What the first review found missing, each against the whole job."""

import re
from collections import defaultdict
from datetime import datetime

from pyspark.sql import functions as F

import __spark_entry__ as entry
from cityfeed.functions.text import group_title
from cityfeed.plans.ev import ev

D = "/root/testdata/sf0.001"


def test_every_event_has_its_siblings(spark):
    events = ev(spark, D).withColumn("key", group_title(F.col("title"))).select("id", "key", "source_name", "start_at", "archived_at").collect()
    groups = defaultdict(list)
    for e in events:
        if e.archived_at is None and e.key:
            groups[e.key, e.source_name].append((e.start_at is None, e.start_at or datetime.min, e.id))
    want = {}
    for e in events:
        ids = [str(x[2]) for x in sorted(groups.get((e.key, e.source_name), []))] or [str(e.id)]
        want[e.id] = (",".join(ids), len(ids))
    out = entry.queries()["event_siblings"](spark, D).collect()
    assert len(out) == len(events) and {r.event_id: (r.sibling_ids, r.n_siblings) for r in out} == want


def test_titles_of_whole_texts(spark, tmp_path):
    late = "word " * 40 + "a\u200bb der LAST"
    other = "word " * 40 + "other"
    broken = "x" * 50 + " TAGESTIPP22Mo, 01. Jun | 19:00"
    rows = [(2, late, "s"), (3, other, "s"), (5, broken, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: {r.doc_id: r for r in entry.queries()[name](spark, str(tmp_path)).collect()}
    assert run("title_sanitize")[2].title == "word " * 40 + "ab der LAST"
    norm = run("title_norm")[2]
    assert norm.grouping_key == norm.dedup_key == "word " * 40 + "ab last"
    assert run("title_jaccard")[2].similarity == 0.25
    assert [run("broken_titles")[k].broken for k in (2, 5)] == [False, True]


def test_every_part_is_an_image(spark):
    part = spark.read.parquet(f"{D}/part.parquet").select("p_partkey", "p_name").collect()
    first = {}
    for p in sorted(part):
        for word in re.split(r"\W+", p.p_name.lower()):
            if len(word) >= 4:
                first.setdefault(word, f"https://i/{p.p_partkey}")
    events = ev(spark, D).select("id", "title").collect()
    want = {e.id: next((first[w] for w in re.split(r"\W+", e.title.lower()) if len(w) >= 5 and w in first), None) for e in events}
    assert {r.id: r.image_url for r in entry.queries()["image_words"](spark, D).collect()} == want
