"""Parsers of landed payloads: text of a page, feed or API answer to event records.

A parser takes ``(payload, url, now)`` and returns records; the operator
``parse_all`` runs the parser of each row's source over the payload column,
Arrow batch by batch. A payload on which its parser fails gives one row that
says why and doesn't stop the others; ``parse`` has the events, ``parse_errors``
the failures. Rows of unknown sources and null payloads give nothing.
"""

from __future__ import annotations

import hashlib
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from datetime import datetime
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cityfeed.functions.dates import MONTHS, ZONE
from cityfeed.sources.html import Node, tree
from cityfeed.sources.tables import dealt

FIELDS = (
    "canonical_id string, title string, short_description string, start_at timestamp_ntz, is_permanent_offer boolean, category string, source_name string, source_url string, "
    "venue_name string, address_text string, city string, lat double, lon double, indoor_outdoor string, kids_suitable string, price_text string, image_url string"
)
NAMES = [f.split()[0] for f in FIELDS.split(", ")]
_EMPTY = dict.fromkeys(NAMES)
DESCRIPTION = 500

#: Words of page furniture that are no titles.
FURNITURE = re.compile(r"impressum|datenschutz|cookie|kontakt|newsletter|navigation|men[uü]|login|anmelden|agb\b|startseite|suche|sitemap", re.I)
CLOCK = re.compile(r"(?<![\d.])(\d{1,2})[:.](\d{2})(?![\d.])")
HOUR = re.compile(r"(?<![\d.])(\d{1,2})\s*Uhr", re.I)
NUMERIC = re.compile(r"(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2})?(?!\d)")
NAMED = re.compile(r"(\d{1,2})\.\s*([^\W\d_]+)\.?(?:\s+(\d{4}))?")
PRICE = re.compile(r"[^\n|]*?(\d+(?:[.,]\d{2})?\s*(?:€|Euro|EUR))[^\n|]*", re.I)
KIDS = re.compile(r"kind|famil|jugend|schüler|baby", re.I)

Parser = Callable[[str, str, datetime], list[dict]]
PARSERS: dict[str, Parser] = {}


def source(name: str):
    """Register a parser for the source of that name."""

    def register(f: Parser) -> Parser:
        PARSERS[name] = f
        return f

    return register


def event(key: str, title: str, **fields) -> dict:
    """A record whose id comes from the source's own key."""
    out = {**_EMPTY, "canonical_id": hashlib.md5(key.encode()).hexdigest()[:16], "title": title, **fields}
    if out["short_description"]:
        out["short_description"] = out["short_description"][:DESCRIPTION]
    if out["is_permanent_offer"] is None:
        out["is_permanent_offer"] = False
    return out


def first_per_id(events: list[dict]) -> list[dict]:
    return list({e["canonical_id"]: e for e in reversed(events)}.values())[::-1]


def _when(year: int, month: int | None, day: int, hour: int = 0, minute: int = 0) -> datetime | None:
    try:
        return datetime(year, month or 0, day, hour, minute)
    except ValueError:
        return None


def clock(text: str) -> tuple[int, int] | None:
    if m := CLOCK.search(text):
        return int(m[1]), int(m[2])
    return (int(m[1]), 0) if (m := HOUR.search(text)) else None


def german_date(text: str, now: datetime, near: tuple[int, int] | None = None) -> datetime | None:
    """The first date of a text, with the time that stands in the rest of it, or ``near`` so many characters before and after."""
    for pattern in (NUMERIC, NAMED):
        for m in pattern.finditer(text):
            month = int(m[2]) if pattern is NUMERIC else MONTHS.get(m[2].lower())
            year = int(m[3]) if m[3] else now.year
            first, last = (max(0, m.start() - near[0]), m.end() + near[1]) if near else (0, len(text))
            time = clock(text[first : m.start()] + " " + text[m.end() : last]) or (0, 0)
            if month and (found := _when(year + 2000 * (year < 100), month, int(m[1]), *time)):
                return found
    return None


def iso_date(text: str | None) -> datetime | None:
    """An ISO or RSS date as wall-clock time in Berlin."""
    if not text:
        return None
    for read in (datetime.fromisoformat, lambda t: datetime.strptime(t, "%a, %d %b %Y %H:%M:%S %z")):
        try:
            found = read(text.strip())
        except ValueError:
            continue
        return found.astimezone(ZoneInfo(ZONE)).replace(tzinfo=None) if found.tzinfo else found
    return None


def absolute(link: str | None, base: str) -> str | None:
    if not link or link.startswith("http"):
        return link or None
    return "https:" + link if link.startswith("//") else base.rstrip("/") + "/" + link.lstrip("/")


def page_lines(text: str) -> list[str]:
    return [x for x in (" ".join(line.split()) for line in text.splitlines()) if x]


def price_of(text: str) -> str | None:
    m = PRICE.search(text)
    return m.group().strip()[:255] if m else None


def _ld_events(data) -> Iterator[dict]:
    """The Events of an object, a list or a graph, in their order; an object may be an Event and have a graph."""
    left = [data]
    while left:
        item = left.pop()
        if isinstance(item, list):
            left += reversed(item)
        elif isinstance(item, dict):
            kind = item.get("@type")
            if kind == "Event" or isinstance(kind, list) and "Event" in kind:
                yield item
            left.append(item.get("@graph"))


def json_ld(root: Node) -> Iterator[dict]:
    """Objects of type Event, among others or alone, in the page's JSON-LD; an object, a list or a graph."""
    for script in root.find_all("script"):
        if script.attrs.get("type") != "application/ld+json":
            continue
        try:
            data = json.loads(script.raw())
        except ValueError:
            continue
        yield from _ld_events(data)


def image_of(value) -> str | None:
    """A URL from a string, an object with url, @id or contentUrl, or the head of a list."""
    if isinstance(value, list):
        return image_of(value[0]) if value else None
    if isinstance(value, dict):
        return next((value[k] for k in ("url", "@id", "contentUrl") if isinstance(value.get(k), str)), None)
    return value if isinstance(value, str) and value else None


def node_image(node: Node, base: str) -> str | None:
    img = node.find("img")
    if img is None:
        return None
    link = img.attrs.get("src") or img.attrs.get("data-src") or (img.attrs.get("srcset") or "").split(" ")[0]
    return absolute(link, base)


def rss_items(xml: str) -> Iterator[dict[str, str]]:
    try:
        root = ET.fromstring(xml.strip())
    except ET.ParseError:
        return
    for item in root.iter("item"):
        yield {c.tag.rpartition("}")[2]: (c.text or "").strip() for c in item}


def plain(html: str) -> str:
    return tree(html).text()


# JSON and feeds


@source("Zollverein")
def zollverein(payload: str, url: str, now: datetime) -> list[dict]:
    """API answer (a list, or one under events, data or results), else the HTML list."""
    base, place = "https://www.zollverein.de", {"city": "Essen", "lat": 51.4864, "lon": 7.0403, "source_name": "Zollverein"}
    try:
        data = json.loads(payload)
    except ValueError:
        data = None
    out = []
    if data is not None:
        wrapped = data if isinstance(data, dict) else {}
        items = data if isinstance(data, list) else next((wrapped[k] for k in ("events", "data", "results") if isinstance(wrapped.get(k), list)), [])
        for item in (x for x in items if isinstance(x, dict)):
            title = item.get("title") or item.get("name")
            if not title:
                continue
            link, where, kind = item.get("url") or item.get("link") or "", item.get("location"), item.get("category")
            name = where.get("name") if isinstance(where, dict) else where
            out.append(
                event(
                    link or title,
                    title,
                    **place | {"venue_name": name or "Zollverein"},
                    short_description=item.get("description") or "",
                    source_url=absolute(link, base),
                    start_at=iso_date(item.get("startDate") or item.get("start_date") or item.get("start")),
                    category=(kind[0] if kind else None) if isinstance(kind, list) else kind,
                    indoor_outdoor="both",
                )
            )
        return out
    root = tree(payload)
    cards = root.find_all("li", cls="mb-4") or root.find_all("li", part="mb-") or [n for n in root.find_all("li") if n.attrs.get("role") == "button"]
    for card in cards:
        head, link = card.find("h2", "h3", "h4"), card.find("a", attr="href")
        if head is None or len(head.text()) < 3:
            continue
        href = link.attrs["href"] if link else ""
        start = german_date(card.text(), now)
        texts = [p.text() for p in card.find_all("p")]
        about = next((t for t in texts if len(t) > 20), None)
        out.append(event(href or head.text(), head.text(), **place, venue_name="Zollverein", short_description=about, source_url=absolute(href, base), start_at=start, is_permanent_offer=start is None))
    return out


def _feed(payload: str, name: str, least: int, **fixed) -> list[dict]:
    out = []
    for item in rss_items(payload):
        title = item.get("title", "")
        if len(title) < least or FURNITURE.search(title):
            continue
        out.append(event(item.get("link") or title, title, source_name=name, source_url=item.get("link"), short_description=plain(item.get("description", "")), is_permanent_offer=True, **{"category": item.get("category")} | fixed))
    return out


@source("Ruhrpott-Kids")
def ruhrpott_kids(payload: str, url: str, now: datetime) -> list[dict]:
    return _feed(payload, "Ruhrpott-Kids", 1, kids_suitable="yes")


@source("borbeck.de")
def borbeck(payload: str, url: str, now: datetime) -> list[dict]:
    return _feed(payload, "borbeck.de", 5, city="Essen")


@source("Villa Hügel")
def villa_huegel(payload: str, url: str, now: datetime) -> list[dict]:
    """Programmes in the page's data, or a bare list of them."""
    m = re.search(r'<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', payload, re.S)
    try:
        data = json.loads(m[1] if m else payload)
    except ValueError:
        return []
    for key in ("props", "pageProps", "programs") if isinstance(data, dict) else ():
        data = data.get(key) if isinstance(data, dict) else None
    out = []
    for item in (x for x in data if isinstance(x, dict)) if isinstance(data, list) else ():
        title, about, term = (" ".join(str(item.get(k) or "").split()) for k in ("title", "subtitle", "date_as_string"))
        if not title or "abgeschlossen" in term.lower():
            continue
        standing = re.search(r"ganzjährig|jeden|täglich|dauer|laufend|regelmäßig", term, re.I)
        start = None if standing else german_date(term, now)
        kids = "yes" if re.search(r"kinder|family|famil", f"{title} {about}", re.I) else "unknown"
        out.append(
            event(
                f"villa-huegel-{item.get('id')}", title, short_description=" | ".join(x for x in (about, f"Termin: {term}" if term else "") if x), start_at=start, is_permanent_offer=start is None, kids_suitable=kids,
                source_name="Villa Hügel", source_url=f"https://www.krupp-stiftung.de/programm/{item.get('slug')}/", image_url=image_of(item["thumbnail"].get("src")) if isinstance(item.get("thumbnail"), dict) else None, venue_name="Villa Hügel",
                address_text="Hügel 1, 45133 Essen", city="Essen", lat=51.4069, lon=7.0090, indoor_outdoor="both" if "park" in about.lower() else "indoor",
            )
        )
    return out


@source("GOP Varieté")
def artistical(payload: str, url: str, now: datetime) -> list[dict]:
    """Shows in a script bundle: one event per date, a standing offer without one."""
    out, starts = [], [m.start() for m in re.finditer(r'\{slug:"', payload)]
    for at, end in zip(starts, [*starts[1:], len(payload)], strict=False):
        block = payload[at:end]

        def value(name: str, text: str = block) -> str:
            m = re.search(rf'\b{name}:"((?:[^"\\]|\\.)*)"', text)
            return _script_text(m[1]) if m else ""

        title, label = value("title"), value("label")
        if not title:
            continue
        age = value("ageRecommendation")
        kids = "yes" if re.search(r"kinder|famil", f"{label} {age}", re.I) else "unknown"
        common = {
            "short_description": value("shortDescription"), "category": label or None, "source_name": "GOP Varieté", "venue_name": "Artistical Theater Essen (GOP Varieté)", "city": "Essen", "lat": 51.45230, "lon": 7.01330,
            "indoor_outdoor": "indoor", "kids_suitable": kids, "image_url": absolute(value("imageUrl"), "https://artistical.de"),
        }
        listed = re.search(r"\bdates:\[(.*?)\]", block, re.S)
        dates = [(m[1], value("ticketUrl", m[0])) for m in re.finditer(r'\{[^{}]*?iso:"([^"]*)"[^{}]*\}', listed[1])] if listed else []
        page = absolute(value("ticketUrl", re.sub(r"\bdates:\[.*?\]", "", block, flags=re.S)) or f"/{value('slug')}", "https://artistical.de")
        found = [(iso_date(iso), absolute(ticket, "https://artistical.de") or page) for iso, ticket in dates]
        found = [x for x in found if x[0]]
        for start, link in found:
            out.append(event(f"{value('slug')}-{start}", title, start_at=start, source_url=link, **common))
        if not found:
            out.append(event(value("slug"), title, is_permanent_offer=True, source_url=page, **common))
    return out


def artistical_chunk(html: str) -> str | None:
    """The address of the script bundle that holds the shows, from the page: the first bundle named after the section."""
    chunk = r'"(/_next/static/chunks/[^"]+?\.js)"'
    m = re.search(r'"EventsSection"[^"]*' + chunk, html) or re.search(r'"EventsSection".*?' + chunk, html, re.S)
    return "https://artistical.de" + m[1] if m else None


def _script_text(s: str) -> str:
    """The meaning of a JavaScript string literal."""
    s = re.sub(r"\\x([0-9a-fA-F]{2})|\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1] or m[2], 16)), s)
    return re.sub(r"\\(.)", lambda m: {"n": " ", "r": "", "t": " "}.get(m[1], m[1]), s)


# text of rendered pages


def _ld_event(item: dict, city: str, base: str) -> dict | None:
    name = item.get("name")
    if not name:
        return None
    where = item.get("location") or {}
    where = where[0] if isinstance(where, list) and where else where if isinstance(where, dict) else {"name": str(where)}
    address, geo = where.get("address"), where.get("geo") or {}
    street = address.get("streetAddress") if isinstance(address, dict) else address
    number = lambda k: float(geo[k]) if geo.get(k) not in (None, "") else None
    return event(
        f"{name}{city}", name, short_description=item.get("description"), start_at=iso_date(item.get("startDate")), source_name="Rausgegangen", source_url=absolute(item.get("url"), base), venue_name=where.get("name"),
        address_text=street, city=city.capitalize(), lat=number("latitude"), lon=number("longitude"), image_url=image_of(item.get("image")),
    )


def _marked(node: Node, tags: tuple[str, ...], *parts: str) -> Node | None:
    """The first element below of one of the tags, or with a class that holds one of the parts."""
    return next((n for n in node.find_all() if n.tag in tags or any(p in (n.attrs.get("class") or "") for p in parts)), None)


def _card_event(card: Node, city: str, base: str, now: datetime) -> dict | None:
    """An event from a card, whose parts are known by what their classes are called."""
    link = card.find("a")
    head = _marked(card, ("h2", "h3", "h4"), "title", "name") or link
    title = head.text() if head is not None else ""
    if len(title) < 3:
        return None
    when = _marked(card, ("time",), "date", "datum", "zeit")
    where = _marked(card, (), "location", "ort", "venue", "place")
    about = _marked(card, ("p",), "description", "beschreibung", "text")
    target = card.find("a", attr="href")
    stamp = " ".join(when.text().split()) if when is not None else ""
    return event(
        f"rausgegangen_{title}_{city}", title, short_description=about.text() if about is not None else None, start_at=iso_date(stamp) or (german_date(stamp, now) if stamp else None),
        venue_name=where.text() if where is not None else None, city=city.capitalize(), source_url=absolute(target.attrs["href"], base) if target else None, source_name="Rausgegangen", image_url=node_image(card, base),
    )


@source("Rausgegangen")
def rausgegangen(payload: str, url: str, now: datetime) -> list[dict]:
    """JSON-LD if a page has any, else cards, else links, else lines of text after a date line."""
    base, city = "https://www.rausgegangen.de", "essen"
    if "<" in payload and "</" in payload:
        root = tree(payload)
        found = [e for e in (_ld_event(x, city, base) for x in json_ld(root)) if e]
        if found:
            return found
        cards = [n for n in root.find_all() if n.tag == "article" or {"event-card", "veranstaltung-item"} & set(n.classes) or "event-item" in (n.attrs.get("class") or "")]
        found = [e for e in (_card_event(c, city, base, now) for c in cards) if e]
        if found:
            return found
        out = []
        for a in root.find_all("a", attr="href"):
            parts = [x.strip() for x in a.strings() if x.strip()]
            if "/event" not in a.attrs["href"] or not 10 <= len(" ".join(parts)) <= 500:
                continue
            dated = next((p for p in parts if german_date(p, now)), None)
            names = [p for p in parts if p != dated and "€" not in p and len(p) > 4]
            if names:
                out.append(event(f"{names[0]}{dated}", names[0], start_at=german_date(dated, now) if dated else None, venue_name=names[1] if len(names) > 1 else None, price_text=next((p for p in parts if "€" in p), None), source_name="Rausgegangen", source_url=absolute(a.attrs["href"], base), city="Essen", image_url=node_image(a, base)))
        return list({(e["title"], e["start_at"]): e for e in reversed(out)}.values())[::-1]
    out, lines = [], page_lines(payload)
    head = re.compile(r"^(?:[^\W\d_]{2}|Heute|Morgen),?\s*\d{1,2}\.\s*[^\W\d_]+\.?\s*\|\s*\d{1,2}:\d{2}(.*)$")
    for k, line in enumerate(lines):
        m = head.match(line)
        if not m:
            continue
        ahead = lines[k + 1 : k + 8]
        stop = next((n for n, x in enumerate(ahead) if head.match(x)), len(ahead))
        ahead = ahead[:stop]
        title = m[1].strip() if len(m[1].strip()) >= 5 else next((x for x in ahead[:1] if 6 <= len(x) < 150), None)
        if not title:
            continue
        rest = ahead[0 if title == m[1].strip() else 1 :]
        out.append(event(f"{title}{line[:20]}", title, start_at=german_date(line[: m.start(1)], now), venue_name=next((x for x in rest[:1] if len(x) < 80 and "€" not in x), None), price_text=next((x for x in rest if "€" in x), None), source_name="Rausgegangen", source_url=base + "/" + city, city="Essen"))
    return out


@source("wasgehtapp.de")
def wasgehtapp(payload: str, url: str, now: datetime) -> list[dict]:
    """A line of weekday, date and time; the title is the first acceptable of the five lines before."""
    out, lines = [], page_lines(payload)
    head = re.compile(r"^(?:Mo|Di|Mi|Do|Fr|Sa|So),\s*(\d{1,2})\.(\d{1,2}),?\s*(\d{1,2}):(\d{2})(?:\s*Uhr)?(?:\s*pin\s*(.*))?", re.I)
    for k, line in enumerate(lines):
        m = head.match(line)
        if not m:
            continue
        day, month = int(m[1]), int(m[2])
        if month > 12 >= day:
            day, month = month, day
        start = _when(now.year, month, day, int(m[3]), int(m[4]))
        before = []
        for x in reversed(lines[max(0, k - 5) : k]):
            if head.match(x):
                break
            before.append(x)
        title = next((x for x in before if len(x) >= 5 and "€" not in x and not FURNITURE.search(x) and not re.fullmatch(r"[\d\s.,:]+(?:km|Uhr)?", x)), None)
        if start and title:
            out.append(event(f"{title}{start}", title, start_at=start, venue_name=m[5] or None, city="Essen", source_name="wasgehtapp.de", source_url=url))
    return out


@source("Gasometer")
def gasometer(payload: str, url: str, now: datetime) -> list[dict]:
    """A full line of day and month, the title on the next, text up to the next date."""
    lines = page_lines(payload)
    dates = [(k, german_date(x, now)) for k, x in enumerate(lines) if re.fullmatch(r"\d{1,2}\.\s*[^\W\d_]+(?:\s+\d{4})?", x)]
    dates = [(k, d) for k, d in dates if d]
    out = []
    for (k, day), end in zip(dates, [k for k, _ in dates[1:]] + [len(lines)], strict=False):
        title = lines[k + 1] if k + 1 < end else ""
        if len(title) <= 5:
            continue
        body = lines[k + 2 : end]
        timed = next((clock(x) for x in body if re.search(r"einlass|beginn|ticket|uhr", x, re.I) and clock(x)), None)
        start = day.replace(hour=timed[0], minute=timed[1]) if timed and timed[0] < 24 and timed[1] < 60 else day
        out.append(event(f"{title}{start}", title, start_at=start, short_description=" ".join(x for x in body if not re.match(r"einlass|ticket", x, re.I)), price_text=price_of("\n".join(body)), venue_name="Gasometer Oberhausen", city="Oberhausen", lat=51.4939, lon=6.8704, indoor_outdoor="indoor", source_name="Gasometer", source_url=url))
    return out


def _dated_neighbours(lines: list[str], now: datetime, before: int, after: int) -> Iterator[tuple[datetime, str, int]]:
    """Lines with a date to come, and the first acceptable title around each."""
    for k, line in enumerate(lines):
        if not NUMERIC.search(line) or not (start := german_date(line, now)) or start < now:
            continue
        around = lines[max(0, k - before) : k][::-1] + lines[k + 1 : k + 1 + after]
        title = next((x for x in around if len(x) >= 5 and not NUMERIC.search(x) and not clock(x) and not FURNITURE.search(x)), None)
        if title:
            yield start, title, k


@source("Unperfekthaus")
def unperfekthaus(payload: str, url: str, now: datetime) -> list[dict]:
    return first_per_id([event(f"{t}{s}", t, start_at=s, venue_name="Unperfekthaus", address_text="Friedrich-Ebert-Str. 18, 45127 Essen", city="Essen", lat=51.4602, lon=7.0094, indoor_outdoor="indoor", source_name="Unperfekthaus", source_url=url) for s, t, _ in _dated_neighbours(page_lines(payload), now, 3, 4)])


#: Houses of the theatre.
HOUSES = ("AALTO", "GRILLO", "PHILHARMONIE", "CASA", "ADA", "BOX", "HEIMAT")
#: Lines of the calendar that are no titles.
LABELS = re.compile(r"^(?:mo|di|mi|do|fr|sa|so)\w*tag$|^mittwoch$|tickets?|karten|ausverkauft|mehr|kalender|spielplan|premiere$", re.I)
DAY_LINE = re.compile(r"(\d{1,2})\.(\d{1,2})\.(\d{4})")
TIME_START = re.compile(r"\d{1,2}[:.]\d{2}")


@source("Theater Essen")
def theater_essen(payload: str, url: str, now: datetime) -> list[dict]:
    """The house and the date carry on; a time line, 19:30 without one, precedes the title."""
    out, house, day, time = [], None, None, None
    for line in page_lines(payload):
        digit = line[0].isdecimal()  # what begins otherwise needs no pattern of dates or times
        if line.startswith(HOUSES) and line.upper() == line:
            house = line
        elif digit and (m := DAY_LINE.fullmatch(line)):
            day, time = _when(int(m[3]), int(m[2]), int(m[1])), None
        elif day and digit and TIME_START.match(line):
            time = clock(line)
        elif day and len(line) >= 4 and not LABELS.search(line):
            hour, minute = time or (19, 30)
            start = day.replace(hour=hour, minute=minute)
            if start >= now:
                out.append(event(f"{line}{start}", line, start_at=start, venue_name=house, city="Essen", indoor_outdoor="indoor", category="Kultur & Sonstiges", source_name="Theater Essen", source_url=url))
            day = None
    return out


DAY_HEADER = re.compile(r"[^\W\d_]+TAG,|MITTWOCH,")
TIME_LINE = re.compile(r"\d{1,2}[:.]\d{2}(?:\s*(?:–|-)\s*\d{1,2}[:.]\d{2})?(?:\s*Uhr)?")


@source("Museum Folkwang")
def folkwang(payload: str, url: str, now: datetime) -> list[dict]:
    """A date header carries on; each time line is followed by title and kind."""
    out, day, lines = [], None, page_lines(payload)
    for k, line in enumerate(lines):
        if "," in line and DAY_HEADER.match(line.upper()) and (found := german_date(line, now)):
            day = found
        elif day and line[0].isdecimal() and TIME_LINE.fullmatch(line) and k + 1 < len(lines):
            hour, minute = clock(line)
            start, title, kind = day.replace(hour=hour % 24, minute=minute % 60), lines[k + 1], lines[k + 2] if k + 2 < len(lines) else ""
            if start >= now and len(title) > 3:
                out.append(event(f"{title}{start}", title, start_at=start, short_description=kind or None, kids_suitable="yes" if KIDS.search(title + kind) else "unknown", venue_name="Museum Folkwang", address_text="Museumsplatz 1, 45128 Essen", city="Essen", lat=51.4422, lon=7.0049, indoor_outdoor="indoor", source_name="Museum Folkwang", source_url=url))
    return out


# markup


@source("Grugapark")
def grugapark(payload: str, url: str, now: datetime) -> list[dict]:
    base, root, out = "https://www.grugapark.de", tree(payload), []
    boxes = root.find_all("article") or root.find_all("div", "li", part="event") or root.find_all("h2", "h3")
    for box in boxes:
        head = box if box.tag in ("h2", "h3") else box.find("h1", "h2", "h3", "h4")
        title = head.text() if head else ""
        if len(title) < 5 or FURNITURE.search(title):
            continue
        around = box.text() if box is not head else f"{title} {(box.next_element() or box).text()}"
        stamp, link = box.find("time", attr="datetime"), box.find("a", attr="href")
        start = (iso_date(stamp.attrs["datetime"]) if stamp else None) or german_date(around, now)
        about = next((p.text() for p in box.find_all("p") if len(p.text()) > 15), None)
        out.append(event(f"grugapark-{title}-{start}", title, start_at=start, short_description=about, is_permanent_offer=False, source_name="Grugapark", source_url=absolute(link.attrs["href"], base) if link else url, venue_name="Grugapark", address_text="Virchowstr. 167a, 45147 Essen", city="Essen", lat=51.4293, lon=6.9915, indoor_outdoor="outdoor", kids_suitable="likely", image_url=node_image(box, base)))
    return first_per_id(out)


@source("Werdener Nachrichten")
def waddische(payload: str, url: str, now: datetime) -> list[dict]:
    """Category headings and date headings carry on; entries begin with a time."""
    out, category, day = [], None, None
    for node in tree(payload).find_all("h3", "h4", "p"):
        text = " ".join(node.text().split())
        if node.tag == "h3":
            category = text
        elif node.tag == "h4":
            day = german_date(text, now)
            if day and (day.month, day.day) < (now.month, now.day) and not re.search(r"\d{4}", text):
                day = _when(day.year + 1, day.month, day.day)
        elif day and (m := re.match(r"(?:(\d{1,2})[:.](\d{2})|(\d{1,2}))\s*Uhr:?\s*(.+)", text)) and not FURNITURE.search(m[4]):
            start = _when(day.year, day.month, day.day, int(m[1] or m[3]), int(m[2] or 0))
            if start and len(m[4]) >= 5:
                out.append(event(f"{m[4]}", m[4][:500], start_at=start, category=category, kids_suitable="yes" if re.search("kinder", category or "", re.I) else "unknown", city="Essen", venue_name="Essen-Werden", source_name="Werdener Nachrichten", source_url=url))
    return out


@source("Seaside Beach")
def seaside(payload: str, url: str, now: datetime) -> list[dict]:
    """Dated events to come, or one standing offer."""
    place = {"venue_name": "Seaside Beach Baldeney", "address_text": "Freiherr-vom-Stein-Str. 384, 45133 Essen", "city": "Essen", "lat": 51.3977, "lon": 7.0361, "indoor_outdoor": "outdoor", "source_name": "Seaside Beach", "source_url": url}
    lines = page_lines("\n".join(tree(payload).strings()))
    out = first_per_id([event(f"{t}{s}", t, start_at=s, **place) for s, t, _ in _dated_neighbours(lines, now, 3, 3)])
    return out or [event("seaside-beach", "Seaside Beach Baldeney", is_permanent_offer=True, kids_suitable="likely", **place)]


@source("Ferienspatz")
def ferienspatz(payload: str, url: str, now: datetime) -> list[dict]:
    """Cards of holiday offers, one event per appointment row."""
    base, out = "https://ferienspatz.essen.de", []
    for card in (n for n in tree(payload).find_all("div", cls="card") if "mb-3" in n.classes):
        head = card.find("h2")
        if head is None or not head.text():
            continue
        link = next((a.attrs["href"] for a in card.find_all("a", attr="href") if "/Event/Details/" in a.attrs["href"]), "")
        host, badge, about = card.find("span", cls="text-muted"), card.find("span", cls="bg-primary"), card.find("p", cls="card-text")
        free = any("kostenlos" in (i.attrs.get("src", "") + i.attrs.get("alt", "")).lower() for i in card.find_all("img"))
        table = card.find("table", cls="card-table")
        names = [th.text() for th in table.find_all("th")] if table else []
        at = next((k for k, n in enumerate(names) if "Beginn" in n), 0)
        rows = [[td.text() for td in tr.find_all("td")] for tr in table.find_all("tr")] if table else []
        common = {"category": badge.text() if badge else None, "kids_suitable": "yes", "price_text": "kostenlos" if free else None, "venue_name": host.text() if host else None, "city": "Essen", "source_name": "Ferienspatz", "source_url": absolute(link.split("#")[0], base), "image_url": None}
        dated = [(german_date(r[at], now), r) for r in rows if len(r) > at]
        dated = [(d, r) for d, r in dated if d]
        ages = lambda r: next((f"Altersgruppe: {x}" for n, x in zip(names, r, strict=False) if n.startswith("Alter") and x), "")
        for start, row in dated:
            text = " | ".join(x for x in (about.text() if about else "", ages(row)) if x)
            out.append(event(f"{link}-{start}", head.text(), start_at=start, short_description=text, **common))
        if not dated:
            out.append(event(link or head.text(), head.text(), is_permanent_offer=True, short_description=about.text() if about else None, **common))
    return out


def ferienspatz_address(payload: str) -> str | None:
    """The address on a detail page."""
    label = next((n for n in tree(payload).find_all("label") if n.attrs.get("for") == "Event_FullAdresse"), None)
    while label is not None and label.parent is not None:
        value = label.next_element("div")
        if value is not None and "col-md-8" in value.classes:
            return value.text() or None
        label = label.parent
    return None


@source("Zeche Carl")
def zeche_carl(payload: str, url: str, now: datetime) -> list[dict]:
    """A detail page by its JSON-LD, else the overview's cards with the year in their links."""
    base, root = "https://www.zechecarl.de", tree(payload)
    place = {"source_name": "Zeche Carl", "venue_name": "Zeche Carl", "address_text": "Wilhelm-Nieswandt-Allee 100, 45326 Essen", "city": "Essen", "lat": 51.4964545, "lon": 7.0123887, "indoor_outdoor": "indoor"}
    kids = lambda t: "likely" if KIDS.search(t) else "unknown"
    paragraphs = [p.text() for p in root.find_all("p")]
    for item in json_ld(root):
        title = re.sub(r"\s+[—–-]\s+ZECHE CARL$", "", str(item.get("name") or ""))
        if not title:
            continue
        start = iso_date(re.sub(r"([+-]\d{2})(\d{2})$", r"\1:\2", str(item.get("startDate") or "")))
        about = " ".join(p for p in paragraphs if len(p) > 20 and not re.search(r"datenschutz|impressum|nieswandt|einlass:", p, re.I))
        return [event(f"{title}{start}", title, start_at=start, short_description=about or None, price_text=price_of(" | ".join(paragraphs)), kids_suitable=kids(title + about), source_url=url, image_url=image_of(item.get("image")), **place)]
    out = []
    for card in root.find_all("div", cls="summary-item-record-type-event"):
        link = card.find("a", attr="href")
        head = card.find("h3", cls="summary-title")
        title = (link.attrs.get("data-title") if link else None) or (head.text() if head else "")
        if not title or link is None:
            continue
        month, day = card.find("span", part="event-date-month"), card.find("span", part="event-date-day")
        slug = re.search(r"/(\d{2})\d{4}-", link.attrs["href"])
        start = _when(2000 + int(slug[1]) if slug else now.year, MONTHS.get(month.text().lower()) if month else None, int(day.text()) if day and day.text().isdigit() else 0)
        out.append(event(f"{title}{start}", title, start_at=start, is_permanent_offer=start is None, kids_suitable=kids(title), source_url=absolute(link.attrs["href"], base), image_url=node_image(card, base), **place))
    return out


#: Kinds of events by keyword, first hit wins.
STAGE_KINDS = {
    "kinder": r"kinder|famil", "comedy": r"comedy|kabarett|satire", "literatur": r"lesung|poetry|slam|literatur", "theater": r"theater|schauspiel|triennale|tanz|musical", "musik": r"konzert|musik|band|oper|jazz|rock|chor|tour",
    "party": r"party|disco", "film": r"film|kino",
}


def stage_kind(text: str) -> str | None:
    return next((k for k, p in STAGE_KINDS.items() if re.search(p, text, re.I)), None)


@source("GREND")
def grend(payload: str, url: str, now: datetime) -> list[dict]:
    out = []
    for block in tree(payload).find_all("div", cls="vsel-content"):
        head = block.find("h3", cls="vsel-meta-title")
        if head is None or not head.text():
            continue
        link, day, time = head.find("a", attr="href"), block.find("div", part="vsel-meta-date"), block.find("div", part="vsel-meta-time")
        start = german_date(f"{day.text() if day else ''} {time.text() if time else ''}", now)
        facts = {c.replace("vsel-acf-", ""): n.text() for n in block.find_all(part="vsel-acf-") for c in n.classes if c.startswith("vsel-acf-")}
        target, title = " ".join(facts.values()), head.text()
        href = link.attrs["href"] if link else url
        kind = stage_kind(f"{title} {target}")
        out.append(event(f"{title}{href}", title, start_at=start, category=kind if kind != "kinder" else "theater", kids_suitable="likely" if KIDS.search(title + target) else "unknown", price_text=price_of(target) or next((v for k, v in facts.items() if "preis" in k or "price" in k or "eintritt" in k), None), source_name="GREND", source_url=href, venue_name="GREND", address_text="Westfalenstr. 311, 45276 Essen", city="Essen", lat=51.4467198, lon=7.0737495, indoor_outdoor="indoor"))
    return first_per_id(out)


@source("Lichtburg")
def lichtburg(payload: str, url: str, now: datetime) -> list[dict]:
    base, out = "https://filmspiegel-essen.de", []
    for box in (n for n in tree(payload).find_all("div", cls="box") if "event" in n.classes):
        head, timing, link = box.find("h3", part="event-title"), box.find("p", part="event-timing"), box.find("a", attr="href")
        start = german_date(timing.text(), now) if timing else None
        if head is None or not head.text() or start is None:
            continue
        kinds = " ".join(n.text() for n in box.find_all(part="event-type"))
        href = absolute(link.attrs["href"], base) if link else url
        out.append(event(f"{head.text()}{href}{start}", head.text(), start_at=start, category=stage_kind(f"{head.text()} {kinds}"), kids_suitable="likely" if KIDS.search(head.text()) else "unknown", source_name="Lichtburg", source_url=href, image_url=node_image(box, base), venue_name="Lichtburg", address_text="Kettwiger Str. 36, 45127 Essen", city="Essen", lat=51.4548676, lon=7.0135673, indoor_outdoor="indoor"))
    return first_per_id(out)


def lichtburg_detail(payload: str) -> dict:
    """Description and prices of a detail page, as far as it has them."""
    root, out = tree(payload), {}
    large = [n for n in root.find_all("div", cls="section--inverse") if "section--p-large" in n.classes]
    about = " ".join(p.text() for n in large for p in n.find_all("p"))
    short = root.find("p", cls="movie-description")
    if len(about) >= 30 or short is not None and short.text():
        out["short_description"] = (about if len(about) >= 30 else short.text())[:DESCRIPTION]
    for head in root.find_all("h3"):
        if head.text().startswith("Preis") and head.parent is not None:
            found = re.findall(r"(Kategorie\s*\d+)\D{0,40}?(\d+,\d{2})\s*€?", head.parent.text())
            if found:
                out["price_text"] = ", ".join(f"{k}: {v} €" for k, v in found)[:255]
    return out


#: Posts that announce something, and pages that don't.
ANNOUNCES = re.compile(r"führung|vortrag|konzert|ausstellung|museumstag|veranstaltung|workshop|fest\b|lesung", re.I)
STANDING = re.compile(r"fragen|hausordnung|öffnungszeiten|anfahrt|shop|barriere", re.I)


@source("Schatzkammer Werden")
def schatzkammer(payload: str, url: str, now: datetime) -> list[dict]:
    """A post that announces an event."""
    root = tree(payload)
    article = root.find("article") or root.find("main")
    head = article.find("h1", "h2", "h3") if article else None
    if head is None:
        return []
    title, body = head.text(), " ".join(p.text() for p in article.find_all("p"))
    if STANDING.search(title) or not ANNOUNCES.search(f"{title} {body}"):
        return []
    start = german_date(f"{title} {body}", now, near=(50, 100))
    return [event(f"{title}{url}", title, start_at=start, is_permanent_offer=start is None, short_description=body, price_text=price_of(body), kids_suitable="likely" if KIDS.search(title + body) else "unknown", source_name="Schatzkammer Werden", source_url=url, venue_name="Schatzkammer Werden", address_text="Brückstr. 54, 45239 Essen", city="Essen", lat=51.3885, lon=7.0046, indoor_outdoor="indoor")]


def schatzkammer_links(payload: str, limit: int = 10) -> list[str]:
    """Links from the home page to posts of the site itself."""
    own = re.compile(r"^https?://(?:www\.)?schatzkammer-werden\.de/([a-z0-9-]+)/?$")
    skip = re.compile(r"^(category|tag|author|shop|datenschutz|impressum|sitemap|kontakt)")
    found = [a.attrs["href"] for a in tree(payload).find_all("a", attr="href") if (m := own.match(a.attrs["href"])) and not skip.match(m[1])]
    return list(dict.fromkeys(found))[:limit]


ERROR_CHARS = 2000

_KINDS = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "timestamp_ntz": pa.timestamp("us")}
_ARROW = pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in FIELDS.split(", ")])


def parse_by_python(payloads: DataFrame, now: datetime) -> DataFrame:
    """The events of ``(source_name, url, payload)`` rows by the registered parsers, and for each payload that fails a row with its source, url and ``error``."""

    def run(batches):
        for batch in batches:
            found, failed = typed_rows(list(zip(*(c.to_pylist() for c in batch.columns), strict=True)), now)
            yield from found.to_batches()
            yield from failed_rows(failed).to_batches()

    return dealt(payloads.select("source_name", "url", "payload")).mapInArrow(run, FIELDS + ", error string")


#: The way of all payloads: a parser needs less time than the expressions of ``native``, which serve where no Python is wanted.
parse_all = parse_by_python


def typed_rows(payloads: list[tuple], now: datetime) -> tuple[pa.Table, list[tuple]]:
    """The events of ``(source_name, url, payload)`` rows, and ``(source_name, url, exception)`` of those that failed; all records of a payload or none."""
    good, failed = [], []
    for name, url, payload in payloads:
        if name in PARSERS and payload is not None:
            try:
                good.append((name, url, [{k: e[k] for k in NAMES} for e in PARSERS[name](payload, url or "", now)]))
            except Exception as e:  # whatever a parser meets, the other payloads go on; what went wrong is in the row
                failed.append((name, url, e))
    try:
        found = pa.Table.from_pylist([row for _, _, rows in good for row in rows], schema=_ARROW)
    except Exception:  # a value of another type, or half a character: which payload has it
        tables = []
        for name, url, rows in good:
            try:
                tables.append(pa.Table.from_pylist(rows, schema=_ARROW))
            except Exception as e:  # what it is stands in the payload's row
                failed.append((name, url, e))
        found = pa.concat_tables([_ARROW.empty_table(), *tables])
    return found.append_column("error", pa.nulls(found.num_rows, pa.string())), failed


def failed_rows(failed: list[tuple]) -> pa.Table:
    """A row with the error of each payload that failed."""
    rows = [dict.fromkeys(NAMES) | {"source_name": name, "source_url": url, "error": f"{type(e).__name__}: {e}"[:ERROR_CHARS]} for name, url, e in failed]
    return pa.Table.from_pylist(rows, schema=_ARROW.append(pa.field("error", pa.string())))


def parse(payloads: DataFrame, now: datetime) -> DataFrame:
    """Events of ``(source_name, url, payload)`` rows."""
    return parse_all(payloads, now).where("error is null").drop("error")


def parse_errors(payloads: DataFrame, now: datetime) -> DataFrame:
    """``source_name, url, error`` of the payloads that could not be parsed."""
    return parse_all(payloads, now).where("error is not null").select("source_name", F.col("source_url").alias("url"), "error")


#: What stands for a source whose pages have no dated event.
STANDINS = {"Seaside Beach": hashlib.md5(b"seaside-beach").hexdigest()[:16]}


def unite_pages(events: DataFrame, order: str = "pos") -> DataFrame:
    """The events of all pages of a source: each id once, the first by ``order``, and a stand-in only where there is nothing else."""
    standin = F.lit(False)
    for name, key in STANDINS.items():
        standin |= (F.col("source_name") == name) & (F.col("canonical_id") == key)
    nth = F.row_number().over(Window.partitionBy("source_name", "canonical_id").orderBy(order))
    once = events.withColumn("_nth", nth).where("_nth = 1").drop("_nth")
    busy = once.where(~standin).where(F.col("source_name").isin(*STANDINS)).select("source_name").distinct().withColumn("_busy", F.lit(True))
    return once.join(busy, "source_name", "left").where(~(standin & F.coalesce("_busy", F.lit(False)))).select(*events.columns)


MAX_PAGES = 40


def pages_until_end(listing: DataFrame) -> DataFrame:
    """Of ``(source_name, page, url, payload)`` the pages up to the first without a card, without a link to the next, or the fortieth."""
    nothing = ~F.col("payload").rlike('class="card mb-3"')
    last = ~F.expr("payload rlike concat('href=\"[^\"]*pageIndex=', page + 1, '(?![0-9])')")
    before = Window.partitionBy("source_name").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max((nothing | last).cast("int")).over(before), F.lit(0))
    return listing.withColumn("_ended", ended).where((F.col("_ended") == 0) & ~nothing & (F.col("page") <= MAX_PAGES)).drop("_ended")


#: source to the fields that its detail pages add
DETAILS: dict[str, Callable[[str], dict]] = {
    "Lichtburg": lambda payload: lichtburg_detail(payload),
    "Ferienspatz": lambda payload: {"address_text": ferienspatz_address(payload)},
}
DETAIL_FIELDS = ("short_description", "price_text", "image_url", "address_text")


def rausgegangen_detail(payload: str) -> dict:
    """Description, price, image and street from the JSON-LD of a detail page."""
    for item in json_ld(tree(payload)):
        where = item.get("location")
        address = where.get("address") if isinstance(where, dict) else None
        offer = item.get("offers")
        offer = offer[0] if isinstance(offer, list) and offer else offer
        price = offer.get("price") if isinstance(offer, dict) else None
        return {
            "short_description": plain(str(item.get("description") or ""))[:DESCRIPTION] or None,
            "price_text": f"{price} €" if price not in (None, "") else None,
            "image_url": image_of(item.get("image")),
            "address_text": address.get("streetAddress") if isinstance(address, dict) else address if isinstance(address, str) else None,
        }
    return {}


DETAILS["Rausgegangen"] = rausgegangen_detail


def parse_details(pages: DataFrame) -> DataFrame:
    """``source_url`` and what the detail page of that address adds; a page that can't be read adds nothing."""
    schema = pa.schema([("source_url", pa.string()), *((f, pa.string()) for f in DETAIL_FIELDS)])

    def run(batches):
        for batch in batches:
            rows = []
            for name, url, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    found = DETAILS[name](payload) if name in DETAILS and payload else {}
                except Exception:  # one page is one page
                    found = {}
                rows.append({"source_url": url} | {f: found.get(f) for f in DETAIL_FIELDS})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return dealt(pages.select("source_name", "url", "payload")).mapInArrow(run, "source_url string, " + ", ".join(f"{f} string" for f in DETAIL_FIELDS))


def enrich_from_details(events: DataFrame, details: DataFrame) -> DataFrame:
    """Fill description, price, image and address from ``(source_url, ...)`` detail rows where they are missing."""
    fill = [c for c in ("short_description", "price_text", "image_url", "address_text") if c in details.columns]
    found = details.dropDuplicates(["source_url"]).select("source_url", *[F.col(c).alias(f"_{c}") for c in fill])
    return events.join(found, "source_url", "left").withColumns({c: F.coalesce(c, f"_{c}") for c in fill}).select(*events.columns)
