"""What Spark reads itself gives what the parsers give; what is odd is left to them."""

import json
from datetime import datetime

import pytest

from cityfeed.sources import native, parsers

NOW = datetime(2026, 5, 1, 12)


def script(programs):
    return '<p>x</p><script id="__NEXT_DATA__" type="application/json">' + json.dumps({"props": {"pageProps": {"programs": programs}}}) + "</script>"


def feed(*items):
    return "<?xml version='1.0'?><rss version='2.0'><channel><title>Kanal</title>" + "".join(f"<item>{x}</item>" for x in items) + "</channel></rss>"


API = [
    [{"title": "Rundgang", "url": "/e/1", "startDate": "2026-06-01T18:00:00Z", "location": {"name": "Halle 5"}, "category": ["Führung", "x"], "description": "d" * 600}],
    {"events": [{"name": "Konzert", "link": "//z.de/k", "start": "2026-12-01T20:00:00+01:00", "location": "Turm", "category": "Musik"}, 5, None, {"title": ""}, {"title": None, "name": "Nur Name"}]},
    {"data": [{"title": "Ohne Zeit", "url": "https://z.de/a", "start_date": "2026-07-05"}], "results": [{"title": "nie"}]},
    {"events": {"no": "list"}, "results": [{"title": "Dritte", "startDate": "2026-02-30", "location": {"name": None}, "category": []}]},
    {"events": [], "data": [{"title": "nie"}]},
    [],
    {},
]
PROGRAMS = [
    [{"id": 7, "title": " Vortrag\r\n im  Haus", "slug": "v", "subtitle": "Im Park", "date_as_string": "7. Juli 2026, 18:30", "thumbnail": {"src": "https://i"}}],
    [{"id": "a", "title": "Family Tag", "slug": "f", "date_as_string": "Ganzjährig", "thumbnail": None}, {"id": 2, "title": "Vorbei", "slug": "x", "date_as_string": "Abgeschlossen"}, {"id": 3, "title": "", "slug": "y"}],
    [{"id": 4, "title": "Am Tag", "slug": "t", "date_as_string": "3. mai"}, {"id": 5, "title": "Gibt es nicht", "slug": "n", "date_as_string": "31. April 2026"}, {"id": 6, "title": "Ohne", "slug": "o"}],
]
FEEDS = [
    feed("<title>Spiel im Hof</title><link>https://x/1</link><description>&lt;p&gt;Für &lt;b&gt;alle&lt;/b&gt; da&lt;/p&gt;</description><category>a</category><category>Kultur</category>", "<title>Impressum</title>"),
    feed("<title> Fest &amp; Musik </title><guid isPermaLink='false'>9</guid>", "<title>kurz</title><description/>"),
    feed(),
]
ODD = [
    ("Zollverein", json.dumps([{"title": "x", "startDate": {"at": 1}}])),
    ("Zollverein", json.dumps([{"title": 5}])),
    ("Zollverein", json.dumps([{"title": "x", "startDate": "20260420"}])),
    ("Zollverein", '<ul><li class="mb-4"><h3>Als Seite</h3></li></ul>'),
    ("Villa Hügel", script([{"id": 1, "title": "Frei", "slug": "f", "date_as_string": "ab 3.6.2026 bis Herbst"}])),
    ("Villa Hügel", "kein JSON"),
    ("Ruhrpott-Kids", feed("<title>A</title><description>&lt;p&gt;x &amp;amp; y&lt;/p&gt;</description>")),
    ("Ruhrpott-Kids", "<rss><channel><item><title>offen</title>"),
    ("borbeck.de", "<rss xmlns:m='u'><channel><item><title>Im Feed</title><m:title>Anderer Titel</m:title></item></channel></rss>"),
    ("borbeck.de", "<rdf><item><title>Ohne Kanal</title></item></rdf>"),
]


def payloads_of(spark, rows):
    return spark.createDataFrame([(k, name, "https://u", x) for k, (name, x) in enumerate(rows)], "id int, source_name string, url string, payload string")


PLAIN = [("Zollverein", json.dumps(x)) for x in API] + [("Villa Hügel", script(x)) for x in PROGRAMS] + [("Villa Hügel", json.dumps(PROGRAMS[0]))] + [(n, x) for n in ("Ruhrpott-Kids", "borbeck.de") for x in FEEDS]


@pytest.mark.parametrize("name", sorted(native.NATIVE))
def test_same_events(spark, name):
    rows = [x for x in PLAIN if x[0] == name]
    payloads = payloads_of(spark, rows)
    told = native.read(payloads, name, NOW).select("id", "plain").collect()
    assert all(r.plain for r in told), told
    want = [e for _, x in rows for e in parsers.PARSERS[name](x, "https://u", NOW)]
    got = native.events(payloads, name, NOW).collect()
    key = lambda e: str({n: e[n] for n in parsers.NAMES})
    assert sorted(map(key, got)) == sorted(map(key, want))
    plan = native.events(payloads, name, NOW)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan


def test_odd_payloads_are_left(spark):
    for name in native.NATIVE:
        rows = [x for x in ODD if x[0] == name]
        assert not any(r.plain for r in native.read(payloads_of(spark, rows), name, NOW).collect()), name


def test_parse_all_takes_both_ways(spark):
    """The same rows as by the parsers alone, errors included."""
    payloads = payloads_of(spark, [*PLAIN, *ODD, ("GREND", None), ("Niemand", "x"), ("Zollverein", None)])
    rows = lambda df: sorted(map(str, df.collect()))
    got = rows(parsers.parse_all(payloads, NOW))
    assert got == rows(parsers.parse_by_python(payloads, NOW)) and any("AttributeError" in x for x in got)


def test_show_bundles(spark):
    from cityfeed.sources.bundles import show_bundles

    src = '<script src="/_next/static/chunks/{}.js" async></script>'.format
    pages = [(1, '"EventsSection",1,"/_next/static/chunks/a.js"'), (2, src("x") + '"EventsSection" "y"\n "/_next/static/chunks/b.js"'), (3, src("x") + src("y") + src("z")), (4, src("x")), (5, None)]
    bundles = [("https://artistical.de/_next/static/chunks/x.js", "EventsSection"), ("https://artistical.de/_next/static/chunks/y.js", 'EventsSection {slug:"1"}'), ("https://artistical.de/_next/static/chunks/z.js", "EventsSection slug:")]
    found = show_bundles(spark.createDataFrame(pages, "k int, payload string"), "k", spark.createDataFrame(bundles, "url string, payload string")).collect()
    assert {r.k: r.bundle[-4:-3] for r in found} == {1: "a", 2: "b", 3: "y"}
