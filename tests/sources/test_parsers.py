"""Parsers on small payloads of each source's shape."""

import json
from datetime import datetime

from cityfeed.sources import parsers
from cityfeed.sources.parsers import PARSERS
from cityfeed.sources.registry import SOURCES

NOW = datetime(2026, 3, 1, 12)


def run(name, payload, url="https://site.example/page"):
    return PARSERS[name](payload, url, NOW)


def test_every_source_has_a_parser():
    assert set(PARSERS) == {s.name for s in SOURCES}
    for parse in PARSERS.values():
        for broken in ("", "<html><body>", "{", "<rss><channel><item>", "\x00"):
            assert isinstance(parse(broken, "u", NOW), list)


def test_zollverein_json_and_html():
    item = {"title": "Nachtwanderung über das Gleis", "url": "/n/77", "startDate": "2026-05-09T21:15:00", "description": "q" * 700, "location": {"name": "Gleisboulevard"}, "category": ["Wandern", "y"]}
    for wrapped in ([item, {"description": "ohne Namen"}, None, 5], {"events": [item]}, {"data": [item]}, {"results": [item]}):
        (e,) = run("Zollverein", json.dumps(wrapped))
        assert e["title"] == item["title"] and e["source_url"] == "https://www.zollverein.de/n/77" and e["start_at"] == datetime(2026, 5, 9, 21, 15)
        assert e["venue_name"] == "Gleisboulevard" and e["category"] == "Wandern" and len(e["short_description"]) == 500
    for odd in ("7", '"x"', "{}", '{"events": 3}', "[1, null]"):
        assert run("Zollverein", odd) == []
    html = '<ul><li class="mb-4"><h3><a href="/n/abc">Kohle und Kunst</a></h3><p>11.09.2026</p><p>Gezeigt werden Bilder aus zwei Jahrhunderten.</p></li><li class="mb-4"><h3>Ringpromenade</h3></li></ul>'
    dated, standing = run("Zollverein", html)
    assert dated["start_at"] == datetime(2026, 9, 11) and dated["lat"] and standing["is_permanent_offer"] and not dated["is_permanent_offer"]


FEED = '<?xml version="1.0"?><rss version="2.0"><channel><title>F</title><item><title>Impressum</title><link>https://x</link></item><item><title>{}</title><link>https://x/1</link><description>&lt;p&gt;Fest&lt;/p&gt;</description><category>Kultur</category></item></channel></rss>'


def test_feeds():
    (e,) = run("borbeck.de", FEED.format("Lichterfest"))
    assert e["is_permanent_offer"] and e["source_name"] == "borbeck.de" and e["short_description"] == "Fest"
    assert run("borbeck.de", FEED.format("abc")) == []
    (e,) = run("Ruhrpott-Kids", FEED.format("Bastelecke"))
    assert e["kids_suitable"] == "yes" and e["category"] == "Kultur"
    assert parsers.iso_date("Mon, 15 Mar 2027 19:30:00 +0100") == datetime(2027, 3, 15, 19, 30)
    assert parsers.iso_date("2026-06-01T20:00:00Z") == datetime(2026, 6, 1, 22)


def test_rausgegangen_strategies():
    ld = {"@type": "Event", "name": "Orgel bei Kerzen", "startDate": "2026-11-02T18:45:00", "image": [{"url": "https://i/9.png"}], "location": {"name": "Marktkirche", "address": {"streetAddress": "Markt 2"}, "geo": {"latitude": 51.4581, "longitude": 7.0139}}}
    page = '<html><script type="application/ld+json">{}</script><body></body></html>'
    for data in (ld, [ld, {"@type": "Place"}]):
        (e,) = run("Rausgegangen", page.format(json.dumps(data)))
        assert (e["lat"], e["venue_name"], e["address_text"], e["image_url"]) == (51.4581, "Marktkirche", "Markt 2", "https://i/9.png")
    card = '<article><a href="/e/4"><h3>Flohmarkt der Kulturen</h3></a><time>04.10.2026 09:00</time><span class="venue-name">Messeparkplatz</span><p>Alles gebraucht.</p></article><div class="event-card"><h2>zu</h2></div>'
    (e,) = run("Rausgegangen", card)
    assert (e["title"], e["start_at"], e["short_description"]) == ("Flohmarkt der Kulturen", datetime(2026, 10, 4, 9), "Alles gebraucht.")
    linked = '<body><a href="/events/k/"><img data-src="/k.png"><span>Sa, 24. Okt | 20:15</span><span>Chansons im Kontor</span><span>Altes Kontor</span><span>9,50 €</span></a></body>'
    (e,) = run("Rausgegangen", linked)
    assert e["title"] == "Chansons im Kontor" and e["start_at"] == datetime(2026, 10, 24, 20, 15) and e["venue_name"] == "Altes Kontor" and e["price_text"] == "9,50 €"
    (e,) = run("Rausgegangen", "Sa, 24. Okt | 20:15\nChansons im Kontor\nAltes Kontor\n9,50 €")
    assert e["title"] == "Chansons im Kontor" and e["start_at"] == datetime(2026, 10, 24, 20, 15) and e["price_text"] == "9,50 €"


def test_text_pages():
    (e,) = run("Gasometer", "17. September\nLICHT UND SCHWERE\nGespräch über Himmelskörper.\nEinlass ab 19:45\nTickets 8,50 €")
    assert e["start_at"] == datetime(2026, 9, 17, 19, 45) and e["city"] == "Oberhausen" and "8,50 €" in e["price_text"]
    assert run("Gasometer", "41. September\nLICHT UND SCHWERE\n") == []
    (e,) = run("Unperfekthaus", "Löten für Einsteiger\n28.11.2026 17:15 Uhr\nBitte Werkzeug mitbringen")
    assert e["title"] == "Löten für Einsteiger" and e["start_at"] == datetime(2026, 11, 28, 17, 15)
    assert run("Unperfekthaus", "Löten für Einsteiger\n28.11.1999 17:15 Uhr\n") == []
    (e,) = run("Theater Essen", "GRILLO-STUDIO\nSonntag\n15.11.2026\n16:00 - 18:20\nDer Geizige\nKomödie")
    assert (e["title"], e["venue_name"], e["start_at"]) == ("Der Geizige", "GRILLO-STUDIO", datetime(2026, 11, 15, 16))
    assert run("Theater Essen", "CASA\n15.11.1999\n16:00\nDer Geizige") == []
    (e,) = run("Museum Folkwang", "SONNTAG, 8. NOVEMBER 2026\n11:15\nZeichnen für Familien\nWerkstatt")
    assert e["start_at"] == datetime(2026, 11, 8, 11, 15) and e["kids_suitable"] == "yes"
    assert run("Museum Folkwang", "11:15\nZeichnen ohne Kopfzeile\nWerkstatt") == []


def test_wasgehtapp():
    text = "Tango unter Linden\nMi, 09.12, 18:45 Uhr pin Kastanienhof\n{}\nDo, 08.27, 21:00 Uhr\nNie gewesen\nFr, 30.02, 21:00 Uhr"
    first, second = run("wasgehtapp.de", text.format("Winterkino"))
    assert first["start_at"] == datetime(2026, 12, 9, 18, 45) and first["venue_name"] == "Kastanienhof"
    assert second["start_at"] == datetime(2026, 8, 27, 21) and second["title"] == "Winterkino"
    assert [e["title"] for e in run("wasgehtapp.de", "6,00 €\nMi, 09.12, 18:45 Uhr pin Kastanienhof")] == []


def test_html_pages():
    html = '<article><h2>Lampionzug am See</h2><time datetime="2026-10-31T17:30">31.10.2026</time><p>Mit Kapelle einmal um den Teich.</p><a href="/l/3">Mehr</a></article><article><h2>Datenschutz</h2></article>'
    (e,) = run("Grugapark", html)
    assert e["start_at"] == datetime(2026, 10, 31, 17, 30) and e["source_url"] == "https://www.grugapark.de/l/3" and e["indoor_outdoor"] == "outdoor"
    html = "<article><h3>Für Kinder</h3><h4>Samstag, 14. Februar:</h4><p>9:30 Uhr Kontakt und Anfahrt</p><p>16.15 Uhr Märchenstunde mit Harfe</p></article>"
    (e,) = run("Werdener Nachrichten", html)
    assert e["start_at"] == datetime(2027, 2, 14, 16, 15) and e["kids_suitable"] == "yes" and e["category"] == "Für Kinder"
    (e,) = run("Seaside Beach", "<p>Drachenboot-Rennen</p><p>22.08.2026 11:30 Uhr</p>")
    assert e["start_at"] == datetime(2026, 8, 22, 11, 30) and not e["is_permanent_offer"]
    (e,) = run("Seaside Beach", "<p>Drachenboot-Rennen</p><p>22.08.1999 11:30 Uhr</p>")
    assert e["is_permanent_offer"]


def test_ferienspatz():
    card = '<div class="card mb-3"><a href="/Event/Details/31"><h2>Trommeln bauen</h2></a>{}<span class="text-muted">Jugendhaus Nord</span><span class="badge bg-primary">Musik</span><p class="card-text">Holz und Fell.</p><table class="table card-table"><thead><tr><th>Beginn/Ende</th><th>Altersgruppe</th></tr></thead><tbody>{}</tbody></table></div>'
    rows = "<tr><td>03.08.2026</td><td>von 8 bis 10 Jahren</td></tr><tr><td>04.08.2026 14:15</td><td></td></tr>"
    a, b = run("Ferienspatz", card.format('<img src="/ic_kostenlos.svg">', rows))
    assert (a["start_at"], b["start_at"]) == (datetime(2026, 8, 3), datetime(2026, 8, 4, 14, 15)) and a["price_text"] == "kostenlos" and "8 bis 10" in a["short_description"] and a["venue_name"] == "Jugendhaus Nord"
    (e,) = run("Ferienspatz", card.format("", ""))
    assert e["is_permanent_offer"] and e["start_at"] is None and e["price_text"] is None
    assert parsers.ferienspatz_address('<div class="row"><div><label for="Event_FullAdresse">Adresse</label></div><div class="col-md-8"> Ring 7 , 45141 Essen </div></div>') == "Ring 7 , 45141 Essen"


def test_artistical_and_villa():
    js = r'let c=[{slug:"kiste",label:"Familienshow",title:"Die Wunderkiste",shortDescription:"Gro\xdfes Staunen.",imageUrl:"/w.png",dates:[{iso:"2026-11-21",ticketUrl:"https:\/\/t/21"},{iso:"2026-11-22"}],ticketUrl:"https://t/all"},{slug:"puls",label:"Show",title:"PULS",dates:[]}];'
    a, b, c = run("GOP Varieté", js)
    assert (a["start_at"], a["source_url"], b["source_url"]) == (datetime(2026, 11, 21), "https://t/21", "https://t/all") and a["kids_suitable"] == "yes" and a["short_description"] == "Großes Staunen." and a["image_url"].startswith("https://")
    assert c["is_permanent_offer"] and c["start_at"] is None
    for page in ('x "EventsSection":"/_next/static/chunks/a1.js"', 'y "EventsSection",0,"z","k" ... "/_next/static/chunks/a1.js"'):
        assert parsers.artistical_chunk(page) == "https://artistical.de/_next/static/chunks/a1.js"
    assert parsers.artistical_chunk("<script src='/_next/static/chunks/a1.js'>") is None
    items = [
        {"id": 41, "title": "Gartenkunst\n\tim Wandel", "slug": "g", "subtitle": "Gespräch", "date_as_string": "19. September 2026, 17:00", "thumbnail": {"src": "https://j"}},
        {"id": 42, "title": "Kinder im Park", "slug": "k", "subtitle": "Spielen", "date_as_string": "jeden Sonntag"},
        {"id": 43, "title": "Orgelweihe", "slug": "o", "date_as_string": "abgeschlossen", "thumbnail": None},
        None,
    ]
    page = '<script id="__NEXT_DATA__" type="application/json">' + json.dumps({"props": {"pageProps": {"programs": items}}}) + "</script>"
    a, b = run("Villa Hügel", page)
    assert a["title"] == "Gartenkunst im Wandel" and a["start_at"] == datetime(2026, 9, 19, 17) and "Termin: 19. September" in a["short_description"]
    assert b["is_permanent_offer"] and b["kids_suitable"] == "yes"
    for odd in ("7", "[1, null]", '<script id="__NEXT_DATA__">{"props": null}</script>'):
        assert run("Villa Hügel", odd) == []


def test_stages():
    overview = '<div class="summary-item summary-item-record-type-event"><a data-title="Swing im Kessel" href="/p/261017-swing"><img data-src="https://cdn/s.png" src=""><span class="x-event-date-month">Okt</span><span class="x-event-date-day">17</span></a></div>'
    (e,) = run("Zeche Carl", overview)
    assert e["start_at"] == datetime(2026, 10, 17) and e["image_url"] == "https://cdn/s.png"
    detail = '<script type="application/ld+json">{"@type": "Event", "name": "Swing im Kessel — ZECHE CARL", "startDate": "2026-10-17T20:30:00+0200"}</script><p>Getanzt wird bis in den Morgen</p><p>VVK 14€ und nette Leute</p>'
    (e,) = run("Zeche Carl", detail)
    assert e["title"] == "Swing im Kessel" and e["start_at"] == datetime(2026, 10, 17, 20, 30) and "14€" in e["price_text"]
    assert run("Zeche Carl", detail.replace('"Swing im Kessel — ZECHE CARL"', "12"))[0]["title"] == "12"
    block = '<div class="vsel-content"><h3 class="vsel-meta-title"><a href="https://grend.de/e/b/">Blasmusik neu gedacht</a></h3><div class="vsel-meta-date">So. 6.9.2026</div><div class="vsel-meta-time"><span>15:30</span></div><div class="vsel-acf-preis">AK 11 €</div></div>'
    (e,) = run("GREND", block + block)
    assert e["start_at"] == datetime(2026, 9, 6, 15, 30) and "11" in e["price_text"] and e["category"] == "musik"
    box = '<div class="box event"><a href="/v/k/"><img src="/k.png"></a><h3 class="event-title">Kabarett am Kamin</h3><p class="event-timing">03.12.2026 19:30 Uhr</p></div>'
    (e,) = run("Lichtburg", box)
    assert e["start_at"] == datetime(2026, 12, 3, 19, 30) and e["category"] == "comedy"
    page = '<p class="movie-description">Ein Abend.</p><div><h3>Preise und Plätze</h3><p>Kategorie 1</p><p>41,20 €</p><p>Kategorie 2</p><p>33,10 €</p></div>'
    assert parsers.lichtburg_detail(page) == {"short_description": "Ein Abend.", "price_text": "Kategorie 1: 41,20 €, Kategorie 2: 33,10 €"}
    assert parsers.lichtburg_detail("<html></html>") == {}
    post = "<nav><h2>Inhalt</h2></nav><article><h2>Vortrag am 12. Oktober 2026</h2><p>Start ist um 17.45 Uhr, 4 Euro</p></article>"
    (e,) = run("Schatzkammer Werden", post)
    assert e["start_at"] == datetime(2026, 10, 12, 17, 45) and run("Schatzkammer Werden", "<article><h2>Anfahrt</h2><p>Vortrag</p></article>") == []
    links = "".join(f'<a href="https://www.schatzkammer-werden.de/{x}/">x</a>' for x in ("vortrag", "tag/z", "impressum", "shop", "vortrag")) + '<a href="https://elsewhere.example/x/">y</a>'
    assert parsers.schatzkammer_links(links) == ["https://www.schatzkammer-werden.de/vortrag/"]


def test_broken_payloads_fail_alone(spark):
    rows = [("Zollverein", "a", '[{"title": "x", "startDate": {"at": 1}}]'), ("Zollverein", "b", '[{"title": "y"}]'), ("Zollverein", "c", None)]
    payloads = spark.createDataFrame(rows, "source_name string, url string, payload string")
    assert [r.title for r in parsers.parse(payloads, NOW).collect()] == ["y"]
    ((name, url, error),) = parsers.parse_errors(payloads, NOW).collect()
    assert (name, url) == ("Zollverein", "a") and error.startswith("AttributeError")


def test_parse_operator(spark):
    rows = [("borbeck.de", "u", FEED.format("Lichterfest")), ("unknown", "u", "x"), ("Gasometer", None, None), ("Gasometer", "g", "17. September\nLICHT UND SCHWERE\n")]
    out = parsers.parse(spark.createDataFrame(rows, "source_name string, url string, payload string"), NOW).collect()
    assert sorted((r.source_name, r.title, r.start_at) for r in out) == [("Gasometer", "LICHT UND SCHWERE", datetime(2026, 9, 17)), ("borbeck.de", "Lichterfest", None)]
