"""Queries of the parsers: payloads of every source's shape made from the parts table, parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from cityfeed.plans.ev import NOW
from cityfeed.plans.registered import query
from cityfeed.sources.tables import table

PLACE = "https://site.example/p"


def _key():
    return F.col("p_partkey").cast("string")


def _day():
    """Two digits, from 01 to 28."""
    return F.lpad((F.col("p_partkey") % 28 + 1).cast("string"), 2, "0")


def _name():
    return F.col("p_name")


def _markup(template: str, **values):
    """``template`` with the columns in place of ``{name}``."""
    out, rest = [], template
    while "{" in rest and "}" in rest:
        text, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(text), values.get(name, {"key": _key(), "day": _day(), "name": _name()}.get(name))]
    return F.concat(*out, F.lit(rest))


def _parsed(spark, d, name: str, payload, url=PLACE):
    from cityfeed.sources.parsers import parse

    rows = table(spark, d, "part").select(F.lit(name).alias("source_name"), F.lit(url).alias("url"), payload.alias("payload"))
    return parse(rows, NOW)


def _read_by_spark(spark, d, name: str, payload, url=PLACE):
    from cityfeed.sources.native import events

    return events(table(spark, d, "part").select(F.lit(name).alias("source_name"), F.lit(url).alias("url"), payload.alias("payload")), name, NOW)


@query("SELECT p_name AS title, 'https://www.zollverein.de/e/' || p_partkey::VARCHAR AS source_url, substr(md5('/e/' || p_partkey::VARCHAR), 1, 16) AS canonical_id, TIMESTAMP '2026-04-20 14:00:00' AS start_at, p_type AS category, p_brand AS venue_name FROM part")
def parse_json_api(spark, d):
    item = F.struct(F.col("p_name").alias("title"), F.concat(F.lit("/e/"), F.col("p_partkey").cast("string")).alias("url"), F.lit("2026-04-20T12:00:00Z").alias("startDate"), F.struct(F.col("p_brand").alias("name")).alias("location"), F.array("p_type").alias("category"))
    out = _read_by_spark(spark, d, "Zollverein", F.to_json(F.struct(F.array(item).alias("events"))))
    return out.select("title", "source_url", "canonical_id", "start_at", "category", "venue_name")


@query("SELECT 'Fest ' || p_name AS title, 'https://x/' || p_partkey::VARCHAR AS source_url, true AS is_permanent_offer, p_type AS category FROM part")
def parse_rss_feed(spark, d):
    item = F.concat(F.lit("<item><title>Fest "), F.col("p_name"), F.lit("</title><link>https://x/"), F.col("p_partkey").cast("string"), F.lit("</link><category>"), F.col("p_type"), F.lit("</category></item>"))
    out = _read_by_spark(spark, d, "borbeck.de", F.concat(F.lit("<rss><channel><item><title>Impressum</title></item>"), item, F.lit("</channel></rss>")))
    return out.select("title", "source_url", "is_permanent_offer", "category")


@query("SELECT 'ABEND ' || upper(p_name) AS title, make_timestamp(2026, 7, (p_partkey % 28 + 1)::BIGINT, 18, 30, 0) AS start_at, 'Eintritt ' || p_size::VARCHAR || ' €' AS price_text FROM part")
def parse_text_page(spark, d):
    day = (F.col("p_partkey") % 28 + 1).cast("string")
    text_ = F.concat(day, F.lit(". Juli 2026\nABEND "), F.upper("p_name"), F.lit("\nEin Vortrag.\nEinlass ab 18:30\nEintritt "), F.col("p_size").cast("string"), F.lit(" €"))
    return _parsed(spark, d, "Gasometer", text_).select("title", "start_at", "price_text")


@query("SELECT p_name AS title, 'https://g/' || p_partkey::VARCHAR AS source_url, make_timestamp(2026, 6, (p_partkey % 28 + 1)::BIGINT, 20, 0, 0) AS start_at FROM part")
def parse_html_page(spark, d):
    key, day = F.col("p_partkey").cast("string"), (F.col("p_partkey") % 28 + 1).cast("string")
    block = F.concat(F.lit('<div class="vsel-content"><h3 class="vsel-meta-title"><a href="https://g/'), key, F.lit('">'), F.col("p_name"), F.lit('</a></h3><div class="vsel-meta-date">Fr. '), day, F.lit('.6.2026</div><div class="vsel-meta-time">20:00</div></div>'))
    return _parsed(spark, d, "GREND", F.concat(block, block)).select("title", "source_url", "start_at")


@query(
    "SELECT p_name AS title, 'https://www.zollverein.de/e/' || p_partkey::VARCHAR AS source_url, make_timestamp(2026, 5, (p_partkey % 28 + 1)::BIGINT, 0, 0, 0) AS start_at, false AS is_permanent_offer, 'Ein Rundgang durch ' || p_type AS short_description FROM part"
    " UNION ALL SELECT 'Dauerschau ' || p_name, NULL, NULL, true, NULL FROM part"
)
def parse_zollverein_html(spark, d):
    page = _markup('<ul><li class="mb-4"><h3><a href="/e/{key}">{name}</a></h3><p>{day}.05.2026</p><p>Ein Rundgang durch {type}</p></li><li class="mb-4"><h3>Dauerschau {name}</h3></li><li class="mb-4"><h3>ab</h3></li></ul>', type=F.col("p_type"))
    return _parsed(spark, d, "Zollverein", page).select("title", "source_url", "start_at", "is_permanent_offer", "short_description")


@query("SELECT 'Spiel ' || p_name AS title, 'https://x/' || p_partkey::VARCHAR AS source_url, 'yes' AS kids_suitable, 'Für ' || p_type AS short_description, 'Kultur' AS category FROM part")
def parse_kids_feed(spark, d):
    feed = _markup("<rss><channel><item><title>Newsletter</title></item><item><title>Spiel {name}</title><link>https://x/{key}</link><description>&lt;p&gt;Für {type}&lt;/p&gt;</description><category>Kultur</category></item></channel></rss>", type=F.col("p_type"))
    return _read_by_spark(spark, d, "Ruhrpott-Kids", feed).select("title", "source_url", "kids_suitable", "short_description", "category")


@query("SELECT p_name AS title, TIMESTAMP '2026-07-15 19:30:00' AS start_at, p_brand AS venue_name, 'Weg ' || p_size::VARCHAR AS address_text, 51.5::DOUBLE AS lat, p_retailprice AS lon, 'https://i/' || p_partkey::VARCHAR AS image_url, 'https://www.rausgegangen.de/e/' || p_partkey::VARCHAR AS source_url FROM part")
def parse_json_ld(spark, d):
    where = F.struct(
        F.col("p_brand").alias("name"), F.struct(F.concat(F.lit("Weg "), F.col("p_size").cast("string")).alias("streetAddress")).alias("address"), F.struct(F.lit(51.5).alias("latitude"), F.col("p_retailprice").alias("longitude")).alias("geo")
    )
    item = F.struct(F.lit("Event").alias("@type"), _name().alias("name"), F.lit("2026-07-15T17:30:00Z").alias("startDate"), F.concat(F.lit("/e/"), _key()).alias("url"), F.array(F.struct(F.concat(F.lit("https://i/"), _key()).alias("contentUrl"))).alias("image"), where.alias("location"))
    page = _markup('<html><script type="application/ld+json">[{item}, {"@type": "Place"}]</script></html>'.replace('{"@type": "Place"}', "{place}"), item=F.to_json(item), place=F.lit('{"@type": "Place"}'))
    return _parsed(spark, d, "Rausgegangen", page).select("title", "start_at", "venue_name", "address_text", "lat", "lon", "image_url", "source_url")


@query("SELECT p_name AS title, make_timestamp(2026, 6, (p_partkey % 28 + 1)::BIGINT, 20, 0, 0) AS start_at, p_brand AS venue_name, 'Von ' || p_type AS short_description, 'https://www.rausgegangen.de/e/' || p_partkey::VARCHAR AS source_url, 'https://www.rausgegangen.de/i.png' AS image_url FROM part")
def parse_cards(spark, d):
    page = _markup('<div class="event-card"><img src="/i.png"><a href="/e/{key}"><h3>{name}</h3></a><span class="card-date">{day}.06.2026 20:00</span><span class="card-venue">{brand}</span><p>Von {type}</p></div><article><h2>ab</h2></article>', brand=F.col("p_brand"), type=F.col("p_type"))
    return _parsed(spark, d, "Rausgegangen", page).select("title", "start_at", "venue_name", "short_description", "source_url", "image_url")


@query("SELECT 'Konzert ' || p_name AS title, make_timestamp(1998, 7, (p_partkey % 28 + 1)::BIGINT, 19, 0, 0) AS start_at, p_brand AS venue_name, p_size::VARCHAR || ',00 €' AS price_text, 'https://www.rausgegangen.de/events/' || p_partkey::VARCHAR AS source_url FROM part")
def parse_links(spark, d):
    page = _markup('<body><a href="/events/{key}"><span>Do, {day}. Juli | 19:00</span><span>Konzert {name}</span><span>{brand}</span><span>{size},00 €</span></a><a href="/about">Über uns und andere</a></body>', brand=F.col("p_brand"), size=F.col("p_size").cast("string"))
    return _parsed(spark, d, "Rausgegangen", page).select("title", "start_at", "venue_name", "price_text", "source_url")


@query("SELECT 'Konzert ' || p_name AS title, make_timestamp(1998, 7, (p_partkey % 28 + 1)::BIGINT, 19, 30, 0) AS start_at, p_brand AS venue_name, p_size::VARCHAR || ',00 €' AS price_text FROM part")
def parse_text_list(spark, d):
    page = _markup("Programm\nDo, {day}. Juli | 19:30\nKonzert {name}\n{brand}\n{size},00 €", brand=F.col("p_brand"), size=F.col("p_size").cast("string"))
    return _parsed(spark, d, "Rausgegangen", page).select("title", "start_at", "venue_name", "price_text")


@query("SELECT p_name AS title, make_timestamp(1998, 7, (p_partkey % 28 + 1)::BIGINT, 19, 30, 0) AS start_at, p_brand AS venue_name FROM part UNION ALL SELECT 'Fest ' || p_name, make_timestamp(1998, 5, 13, 20, 0, 0), NULL FROM part")
def parse_weekday_lines(spark, d):
    page = _markup("{name}\nFr, {day}.07, 19:30 Uhr pin {brand}\nFest {name}\n3,50 €\nSa, 05.13, 20:00 Uhr\nUngültig hier\nSo, 31.02, 20:00 Uhr", brand=F.col("p_brand"))
    return _parsed(spark, d, "wasgehtapp.de", page).select("title", "start_at", "venue_name")


@query("SELECT 'Werkstatt: ' || p_name AS title, make_timestamp(2026, 3, (p_partkey % 28 + 1)::BIGINT, 19, 0, 0) AS start_at, 'Unperfekthaus' AS venue_name FROM part")
def parse_dated_neighbours(spark, d):
    page = _markup("Navigation\nWerkstatt: {name}\n{day}.03.2026 19:00 Uhr\n...\n01.01.1990 20:00 Uhr\n")
    return _parsed(spark, d, "Unperfekthaus", page).select("title", "start_at", "venue_name")


@query("SELECT 'Oper ' || p_name AS title, make_timestamp(2026, 4, (p_partkey % 28 + 1)::BIGINT, 18, 15, 0) AS start_at, 'AALTO-THEATER' AS venue_name FROM part UNION ALL SELECT 'Tanz ' || p_name, make_timestamp(2026, 4, (p_partkey % 28 + 1)::BIGINT, 19, 30, 0), 'GRILLO' FROM part")
def parse_stage_calendar(spark, d):
    page = _markup("AALTO-THEATER\nDonnerstag\n{day}.04.2026\n18:15 - 22:00\nOper {name}\nin drei Akten\nGRILLO\n{day}.04.2026\nTickets\nTanz {name}\n01.01.1990\nAltes Stück")
    return _parsed(spark, d, "Theater Essen", page).select("title", "start_at", "venue_name")


@query("SELECT 'Rundgang ' || p_name AS title, make_timestamp(2026, 4, (p_partkey % 28 + 1)::BIGINT, 14, 30, 0) AS start_at, 'Familien und ' || p_type AS short_description, 'yes' AS kids_suitable FROM part")
def parse_museum_calendar(spark, d):
    page = _markup("DIENSTAG, {day}. APRIL 2026\n14:30 – 16:00 Uhr\nRundgang {name}\nFamilien und {type}\nMITTWOCH, 1. APRIL 1990\n15:00\nLängst vorbei", type=F.col("p_type"))
    return _parsed(spark, d, "Museum Folkwang", page).select("title", "start_at", "short_description", "kids_suitable")


@query("SELECT 'Gartenfest ' || p_name AS title, make_timestamp(2026, 4, (p_partkey % 28 + 1)::BIGINT, 10, 0, 0) AS start_at, 'https://www.grugapark.de/e/' || p_partkey::VARCHAR AS source_url, 'Ein Fest im Grünen mit ' || p_type AS short_description, 'outdoor' AS indoor_outdoor FROM part")
def parse_articles(spark, d):
    page = _markup('<article><h2>Gartenfest {name}</h2><time datetime="2026-04-{day}T10:00">bald</time><p>Kurz.</p><p>Ein Fest im Grünen mit {type}</p><a href="/e/{key}">mehr</a></article><article><h2>Impressum</h2></article>', type=F.col("p_type"))
    return _parsed(spark, d, "Grugapark", page).select("title", "start_at", "source_url", "short_description", "indoor_outdoor")


@query("SELECT 'Puppenspiel ' || p_name AS title, make_timestamp(1999, 1, (p_partkey % 28 + 1)::BIGINT, 14, 30, 0) AS start_at, 'Kinder und ' || p_type AS category, 'yes' AS kids_suitable FROM part UNION ALL SELECT 'Spätes ' || p_name, make_timestamp(1999, 1, (p_partkey % 28 + 1)::BIGINT, 20, 0, 0), 'Kinder und ' || p_type, 'yes' FROM part")
def parse_headings(spark, d):
    page = _markup("<h3>Kinder und {type}</h3><p>9 Uhr noch kein Tag</p><h4>Montag, {day}. Januar:</h4><p>10:00 Uhr Impressum</p><p>14.30 Uhr Puppenspiel {name}</p><p>20 Uhr: Spätes {name}</p>", type=F.col("p_type"))
    return _parsed(spark, d, "Werdener Nachrichten", page).select("title", "start_at", "category", "kids_suitable")


@query(
    "SELECT CASE WHEN p_partkey % 2 = 0 THEN 'Strandabend ' || p_name ELSE 'Seaside Beach Baldeney' END AS title, CASE WHEN p_partkey % 2 = 0 THEN make_timestamp(2026, 6, (p_partkey % 28 + 1)::BIGINT, 19, 0, 0) END AS start_at, p_partkey % 2 = 1 AS is_permanent_offer FROM part"
)
def parse_beach(spark, d):
    year = F.when(F.col("p_partkey") % 2 == 0, "2026").otherwise("1990")
    return _parsed(spark, d, "Seaside Beach", _markup("<p>Strandabend {name}</p><p>{day}.06.{year} 19:00 Uhr</p>", year=year)).select("title", "start_at", "is_permanent_offer")


@query("SELECT title, min(start_at) AS start_at FROM (SELECT 'Strandabend ' || p_name AS title, make_timestamp(2026, 6, 5, 19, 0, 0) AS start_at FROM part WHERE p_partkey % 2 = 0) GROUP BY 1")
def united_pages(spark, d):
    """Pages of one source: events of several once, the stand-in of pages without any not at all."""
    from cityfeed.sources.parsers import unite_pages

    year = F.when(F.col("p_partkey") % 2 == 0, "2026").otherwise("1990")
    events = _parsed(spark, d, "Seaside Beach", _markup("<p>Strandabend {name}</p><p>05.06.{year} 19:00 Uhr</p>", year=year))
    return unite_pages(events, "title").select("title", "start_at")


_CARD = (
    '<div class="card mb-3"><a href="/Event/Details/{key}"><h2>Kurs {name}</h2></a>{image}<span class="text-muted">{brand}</span><span class="badge bg-primary">Kreatives</span><p class="card-text">Mit {type}.</p>'
    '<table class="table card-table"><tr><th>Ort</th><th>Beginn/Ende</th><th>Altersgruppe</th></tr><tr><td>hier</td><td>{day}.07.2026 10:30</td><td>von 6 bis 12</td></tr></table></div>'
)


def _card():
    free = F.when(F.col("p_partkey") % 2 == 0, '<img src="/tb_kostenlos.svg">').otherwise("")
    return _markup(_CARD, image=free, brand=F.col("p_brand"), type=F.col("p_type"))


@query(
    "SELECT 'Kurs ' || p_name AS title, make_timestamp(2026, 7, (p_partkey % 28 + 1)::BIGINT, 10, 30, 0) AS start_at, p_brand AS venue_name, CASE WHEN p_partkey % 2 = 0 THEN 'kostenlos' END AS price_text, 'Kreatives' AS category,"
    " 'Mit ' || p_type || '. | Altersgruppe: von 6 bis 12' AS short_description, 'https://ferienspatz.essen.de/Event/Details/' || p_partkey::VARCHAR AS source_url FROM part"
)
def parse_holiday_cards(spark, d):
    return _parsed(spark, d, "Ferienspatz", _card()).select("title", "start_at", "venue_name", "price_text", "category", "short_description", "source_url")


@query("SELECT p_partkey // 50 AS listing, p_partkey % 50 AS page FROM part WHERE p_partkey % 50 < CASE p_partkey // 50 % 3 WHEN 0 THEN 40 WHEN 1 THEN 7 ELSE 4 END")
def listing_pages(spark, d):
    """Pages of listings that end without a next link, without cards, or at the fortieth."""
    from cityfeed.sources.parsers import pages_until_end

    k = F.col("p_partkey")
    nth, kind = k % 50, F.floor(k / 50) % 3
    link = F.when((kind == 2) & (nth == 3), "").otherwise(F.concat(F.lit('<a href="/angebote/?pageIndex='), (nth + 2).cast("string"), F.lit('">weiter</a>')))
    payload = F.concat(F.when((kind == 1) & (nth == 7), "").otherwise(_card()), link)
    rows = table(spark, d, "part").select(F.floor(k / 50).cast("string").alias("source_name"), (nth + 1).alias("page"), F.lit("u").alias("url"), payload.alias("payload"))
    return pages_until_end(rows).select(F.col("source_name").cast("long").alias("listing"), (F.col("page") - 1).alias("page"))


@query(
    "SELECT p_name AS title, make_timestamp(2026, 12, (p_partkey % 28 + 1)::BIGINT, 0, 0, 0) AS start_at, false AS is_permanent_offer, 'https://t/' || p_partkey::VARCHAR AS source_url, 'yes' AS kids_suitable, 'Für ' || p_type AS short_description FROM part"
    " UNION ALL SELECT 'Groove ' || p_name, NULL, true, 'https://artistical.de/g' || p_partkey::VARCHAR, 'unknown', '' FROM part"
)
def parse_script_bundle(spark, d):
    page = F.concat(
        F.lit('let c=[{slug:"s'), _key(), F.lit('",label:"Kindermusical",title:"'), _name(), F.lit('",shortDescription:"F\\xfcr '), F.col("p_type"), F.lit('",dates:[{iso:"2026-12-'), _day(), F.lit('",ticketUrl:"https:\\/\\/t/'), _key(),
        F.lit('"}]},{slug:"g'), _key(), F.lit('",label:"Show",title:"Groove '), _name(), F.lit('",dates:[]}];'),
    )
    return _parsed(spark, d, "GOP Varieté", page).select("title", "start_at", "is_permanent_offer", "source_url", "kids_suitable", "short_description")


@query("SELECT 'Vortrag ' || p_name AS title, make_timestamp(2026, 7, (p_partkey % 28 + 1)::BIGINT, 18, 30, 0) AS start_at, 'https://www.krupp-stiftung.de/programm/' || p_partkey::VARCHAR || '/' AS source_url, 'https://i' AS image_url, 'unknown' AS kids_suitable, CASE WHEN p_partkey % 3 = 0 THEN 'both' ELSE 'indoor' END AS indoor_outdoor FROM part UNION ALL SELECT 'Family ' || p_name, NULL, 'https://www.krupp-stiftung.de/programm/f/', NULL, 'yes', CASE WHEN p_partkey % 3 = 0 THEN 'both' ELSE 'indoor' END FROM part")
def parse_page_data(spark, d):
    item = lambda i, title, slug, term, image: F.struct(i.alias("id"), F.concat(F.lit(title + " "), _name()).alias("title"), slug.alias("slug"), F.when(F.col("p_partkey") % 3 == 0, "Im Stadtpark").otherwise("Reform").alias("subtitle"), term.alias("date_as_string"), image.alias("thumbnail"))
    none, image = F.lit(None).cast("struct<src:string>"), F.struct(F.lit("https://i").alias("src"))
    items = [
        item(_key(), "Vortrag\r\n", _key(), F.concat(_day(), F.lit(". Juli 2026, 18:30")), image),
        item(F.concat(F.lit("f"), _key()), "Family", F.lit("f"), F.lit("Ganzjährig"), none),
        item(F.concat(F.lit("k"), _key()), "Kino", F.lit("k"), F.lit("Abgeschlossen"), none),
    ]
    data = F.to_json(F.struct(F.struct(F.struct(F.array(*items).alias("programs")).alias("pageProps")).alias("props")))
    page = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), data, F.lit("</script>"))
    return _read_by_spark(spark, d, "Villa Hügel", page).select("title", "start_at", "source_url", "image_url", "kids_suitable", "indoor_outdoor")


@query("SELECT 'Party ' || p_name AS title, make_timestamp(2026, 6, (p_partkey % 28 + 1)::BIGINT, 0, 0, 0) AS start_at, 'https://www.zechecarl.de/c/260605-' || p_partkey::VARCHAR AS source_url, 'https://c/p.png' AS image_url FROM part")
def parse_summary_cards(spark, d):
    page = _markup('<div class="summary-item summary-item-record-type-event"><a data-title="Party {name}" href="/c/260605-{key}"><img data-src="https://c/p.png" src=""><span class="x-event-date-month">Juni</span><span class="x-event-date-day">{day}</span></a></div><div class="summary-item-record-type-event"><h3 class="summary-title">ohne Link</h3></div>')
    return _parsed(spark, d, "Zeche Carl", page).select("title", "start_at", "source_url", "image_url")


@query("SELECT 'Party ' || p_name AS title, make_timestamp(2026, 6, (p_partkey % 28 + 1)::BIGINT, 22, 0, 0) AS start_at, 'Die Nacht im Norden mit ' || p_type AS short_description, 'AK: ' || p_size::VARCHAR || ' €' AS price_text FROM part")
def parse_detail_json_ld(spark, d):
    page = F.concat(F.lit('<script type="application/ld+json">{"@type": "Event", "name": "Party '), _name(), F.lit(' — ZECHE CARL", "startDate": "2026-06-'), _day(), F.lit('T22:00:00+0200"}</script><p>Die Nacht im Norden mit '), F.col("p_type"), F.lit("</p><p>AK: "), F.col("p_size").cast("string"), F.lit(" €</p>"))
    return _parsed(spark, d, "Zeche Carl", page).select("title", "start_at", "short_description", "price_text")


@query("SELECT CASE WHEN p_partkey % 2 = 0 THEN 'Comedy ' ELSE 'Jazz für Kinder ' END || p_name AS title, make_timestamp(2026, 6, (p_partkey % 28 + 1)::BIGINT, 20, 0, 0) AS start_at, CASE WHEN p_partkey % 2 = 0 THEN 'comedy' ELSE 'kinder' END AS category, CASE WHEN p_partkey % 2 = 0 THEN 'unknown' ELSE 'likely' END AS kids_suitable, 'https://filmspiegel-essen.de/v/' || p_partkey::VARCHAR AS source_url FROM part")
def parse_boxes(spark, d):
    kind = F.when(F.col("p_partkey") % 2 == 0, "Comedy").otherwise("Jazz für Kinder")
    box = '<div class="box event"><a href="/v/{key}"><img src="/i.png"></a><h3 class="event-title">{kind} {name}</h3><p class="event-timing">{day}.06.2026 20:00 Uhr</p></div>'
    return _parsed(spark, d, "Lichtburg", _markup(box + box + '<div class="box event"><h3 class="event-title">ohne Tag</h3></div>', kind=kind)).select("title", "start_at", "category", "kids_suitable", "source_url")


@query("SELECT 'Führung am ' || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') || '. Juni 2026' AS title, make_timestamp(2026, 6, (p_partkey % 28 + 1)::BIGINT, 15, 30, 0) AS start_at, p_size::VARCHAR || ' Euro' AS price_text FROM part")
def parse_post(spark, d):
    late = "x" * 120  # a time that far behind the date is another's
    page = _markup("<nav><h2>Menü</h2></nav><article><h2>Führung am {day}. Juni 2026</h2><p>um 15.30 Uhr</p><p>{size} Euro</p><p>" + late + " 23.45 Uhr</p></article>", size=F.col("p_size").cast("string"))
    return _parsed(spark, d, "Schatzkammer Werden", page).select("title", "start_at", F.regexp_extract("price_text", r"\d+ Euro", 0).alias("price_text"))


@query(
    "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'eigen' WHEN p_partkey % 3 = 1 THEN 'Kurz: ' || p_name ELSE 'Neu: ' || p_name END AS short_description,"
    " CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'Kategorie 1: ' || p_size::VARCHAR || ',50 €' ELSE p_size::VARCHAR || ' €' END AS price_text, CASE p_partkey % 3 WHEN 0 THEN 'Weg 1, 45127 Essen' WHEN 2 THEN 'Weg 2' END AS address_text FROM part"
)
def detail_pages(spark, d):
    """Descriptions, prices and addresses of detail pages where the listing had none."""
    from cityfeed.sources.parsers import enrich_from_details, parse_details

    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    film = _markup('<p class="movie-description">Kurz: {name}</p><div><h3>Preise</h3><p>Kategorie 1</p><p>{size},50 €</p></div>', size=size)
    offer = F.to_json(F.struct(F.lit("Event").alias("@type"), F.concat(F.lit("<b>Neu: "), _name(), F.lit("</b>")).alias("description"), F.struct(F.col("p_size").alias("price")).alias("offers"), F.struct(F.struct(F.lit("Weg 2").alias("streetAddress")).alias("address")).alias("location")))
    ld = F.concat(F.lit('<script type="application/ld+json">'), offer, F.lit("</script>"))
    place = F.lit('<div class="row"><div><label for="Event_FullAdresse">Adresse</label></div><div class="col-md-8"> Weg 1, 45127 Essen </div></div>')
    part = table(spark, d, "part")
    url = F.concat(F.lit("https://d/"), _key())
    pages = part.select(F.when(k % 3 == 0, "Ferienspatz").when(k % 3 == 1, "Lichtburg").otherwise("Rausgegangen").alias("source_name"), url.alias("url"), F.when(k % 3 == 0, place).when(k % 3 == 1, film).otherwise(ld).alias("payload"))
    none = F.lit(None).cast("string")
    events = part.select(k.alias("id"), url.alias("source_url"), F.when(k % 3 == 0, "eigen").alias("short_description"), none.alias("price_text"), none.alias("image_url"), none.alias("address_text"))
    return enrich_from_details(events, parse_details(pages)).select("id", "short_description", "price_text", "address_text")


@query("SELECT 'Zollverein' AS source_name, 'u' || p_partkey::VARCHAR AS url FROM part WHERE p_partkey % 4 = 1")
def payload_errors(spark, d):
    """Payloads that their parser can't read, of four forms; the others go on."""
    from cityfeed.sources.parsers import parse_errors

    forms = ["[1, null, {}]", '[{"title": "a", "startDate": {"x": 1}}]', "7", '{"events": [{"title": "b"}]}']
    payload = F.element_at(F.array(*map(F.lit, forms)), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = table(spark, d, "part").select(F.lit("Zollverein").alias("source_name"), F.concat(F.lit("u"), _key()).alias("url"), payload.alias("payload"))
    return parse_errors(rows, NOW).select("source_name", "url")
