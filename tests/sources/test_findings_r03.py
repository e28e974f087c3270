"""Faults of the third round: payloads of a small file in one task, a conversion for every payload, definitions twice."""

import ast
from collections import Counter
from datetime import datetime

import pyarrow as pa
from pyspark.sql import functions as F

from cityfeed.sources import parsers

NOW = datetime(2026, 5, 1, 12)
PAGE = '<div class="vsel-content"><h3 class="vsel-meta-title"><a href="https://g/{}">Lesung</a></h3><div class="vsel-meta-date">Fr. 5.6.2026</div></div>'


def test_payloads_of_one_file_go_to_many_tasks(spark):
    rows = spark.createDataFrame([("GREND", "u", PAGE.format(k)) for k in range(200)], "source_name string, url string, payload string").coalesce(1)
    out = parsers.parse(rows, NOW).withColumn("task", F.spark_partition_id())
    assert out.select("task").distinct().count() > 4 and out.count() == 200


def test_definitions_once():
    with open(parsers.__file__) as f:
        names = Counter(n.name for n in ast.parse(f.read()).body if isinstance(n, ast.FunctionDef))
    assert set(names.values()) == {1}


def test_records_are_converted_by_batch(monkeypatch):
    made = []

    class Table(pa.Table):
        @classmethod
        def from_pylist(cls, rows, schema=None):
            made.append(len(rows))
            return pa.Table.from_pylist(rows, schema=schema)

    class Arrow:
        def __getattr__(self, name):
            return Table if name == "Table" else getattr(pa, name)

    monkeypatch.setattr(parsers, "pa", Arrow())
    found, failed = parsers.typed_rows([("GREND", "u", PAGE.format(k)) for k in range(50)], NOW)
    assert found.num_rows == 50 and not failed and made == [50]
    odd = ("Zollverein", "z", '[{"title": 5}, {"title": "mit"}]')
    found, failed = parsers.typed_rows([odd, ("GREND", "u", PAGE.format(1)), ("Zollverein", "s", '[{"title": "\\ud800"}]')], NOW)
    assert found.num_rows == 1 and [url for _, url, _ in failed] == ["z", "s"]


def test_titles_read_three_entities(spark):
    from cityfeed.sources.html import titles

    pages = ["<h1>a &amp;lt; &lt;b&gt; &quot;c&quot; &amp</h1><h1>x</h1>", "<h1>one <b>two</b></h1>", "<p>", None]
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    assert {r.page_id: r.title for r in titles(rows).collect()} == {0: 'a &lt; <b> "c" &amp'.replace('"', "&quot;"), 1: "", 2: "", 3: None}


def test_page_data_is_parsed_once_for_a_payload(spark):
    from cityfeed.sources import native

    rows = spark.createDataFrame([("Villa Hügel", "u", "[]")], "source_name string, url string, payload string")
    plan = native.events(rows, "Villa Hügel", NOW)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parsejson") <= 2 and len(plan) < 200_000


def test_elements_below_follow_in_one_list(monkeypatch):
    import random

    from cityfeed.sources.html import Node, tree

    def below(node):
        return [x for c in node.children if isinstance(c, Node) for x in (c, *below(c))]

    rng = random.Random(3)
    parts = ["<p class='a b'>", "</p>", "<div class='ab'>", "</div>", "<li>", "<br>", "<td/>", "<td>", "</tr>", "<tr>", "<script>", "</script>", "x", "<!-- -->", "<a href=1>", "</a>", "<"]
    for _ in range(300):
        root = tree("".join(rng.choice(parts) for _ in range(30)))
        for node in [root, *below(root)]:
            assert [*node.walk()] == [node, *below(node)] and node.find_all("p", "td") == [n for n in below(node) if n.tag in ("p", "td")]
            assert node.find_all(cls="a") == [n for n in below(node) if "a" in n.classes] and node.find(part="ab") == next((n for n in below(node) if n.classes == ["ab"]), None)
    seen = []
    monkeypatch.setattr(Node, "classes", property(lambda self: seen.append(self) or self.attrs.get("class", "").split()))
    assert tree("<i class='x'></i>" * 1000).find(cls="x") is not None and len(seen) == 1  # the first is enough


def test_table_function_gives_the_rows_of_the_operator(spark):
    from pyspark.util import PythonEvalType

    from cityfeed.sources import lateral

    odd = ["description\": \"a\\ud800", "location\": [\"y\"], \"x\": \"", "location\": {\"name\": true}, \"x\": \"", "category\": [7], \"x\": \"", "title\": 5, \"x\": \"", "startDate\": \"2026-07-15T17:30:00Z"]
    rows = [("Zollverein", "u", '[{"title": "b"}, {"title": "t", "' + o + '"}]') for o in odd] + [("Zollverein", None, "7"), ("Zollverein", "u", None), (None, "u", "[]"), ("GREND", None, PAGE.format(1))]
    payloads = spark.createDataFrame(rows, "source_name string, url string, payload string")
    lateral.register(spark)
    out = spark.sql("SELECT e.* FROM {p} p, LATERAL page_events(p.source_name, p.url, p.payload, '2026-05-01T12:00:00') e", p=payloads)
    want = parsers.parse_all(payloads, NOW)
    assert sorted(map(repr, out.collect())) == sorted(map(repr, want.collect())) and want.where("error is null").count() == 3
    assert lateral.page_events.evalType == PythonEvalType.SQL_TABLE_UDF  # with Arrow each row of the left side is a batch of its own


def _no_pattern_is_looked_up(monkeypatch, parse):
    import re

    monkeypatch.setattr(re, "_compile", lambda *a: (_ for _ in ()).throw(AssertionError("a pattern is looked up for a line")))
    return parse()


def test_stage_calendar_compiles_its_patterns_once(monkeypatch):
    page = "AALTO-THEATER\nDonnerstag\n07.05.2026\n18:15 - 22:00\nOper\nBOX 1\n٠٨.05.2026\nTickets\n9 Uhr Tanz\n09.05.2026\n٩:٣٠\nMittags\n²9.05.2026"
    found = _no_pattern_is_looked_up(monkeypatch, lambda: parsers.theater_essen(page, "u", NOW))
    assert [(e["venue_name"], e["title"], e["start_at"]) for e in found] == [("AALTO-THEATER", "Oper", datetime(2026, 5, 7, 18, 15)), ("BOX 1", "9 Uhr Tanz", datetime(2026, 5, 8, 19, 30)), ("BOX 1", "Mittags", datetime(2026, 5, 9, 9, 30))]


def test_museum_calendar_compiles_its_patterns_once(monkeypatch):
    page = "FREITAG, 8. MAI 2026\n14:30 – 16:00 Uhr\nRundgang, lang\nFamilien\nMittwoch, 13.5.2026\n٩:٣٠\nVortrag\n12:30, dann\nTag, ohne Tag"
    found = _no_pattern_is_looked_up(monkeypatch, lambda: parsers.folkwang(page, "u", NOW))
    assert [(e["title"], e["start_at"], e["kids_suitable"]) for e in found] == [("Rundgang, lang", datetime(2026, 5, 8, 14, 30), "yes"), ("Vortrag", datetime(2026, 5, 13, 9, 30), "unknown")]
