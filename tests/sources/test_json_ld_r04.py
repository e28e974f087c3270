"""Faults of the fourth round, F3: Events in a graph were left out."""

import json
from datetime import datetime

from cityfeed.sources import parsers

NOW = datetime(2026, 5, 1, 12)


def event(name, kind="Event", **more):
    return {"@type": kind, "name": name, "startDate": "2026-06-05T20:00:00"} | more


def page(*data):
    return "<html>" + "".join(f'<script type="application/ld+json">{json.dumps(d)}</script>' for d in data) + '<article><h2>Eine Karte</h2></article></html>'


def titles(*data):
    return [e["title"] for e in parsers.PARSERS["Rausgegangen"](page(*data), "u", NOW)]


def test_events_of_an_object_a_list_or_a_graph():
    graph = {"@context": "https://schema.org", "@graph": [{"@type": "WebSite", "name": "x"}, event("a"), event("b", ["Event", "Festival"]), "c", None, [event("d")], {"@graph": event("e")}]}
    assert titles(graph) == ["a", "b", "d", "e"]
    assert titles(event("f"), [event("g", **graph), {"@type": "Place", "name": "p"}], {"@graph": {"@type": ["Place"]}}) == ["f", "g", "a", "b", "d", "e"]
    # other types, and Events that are only a part of another object, are no rows of their own
    assert titles([event("h", "Place"), event("i", superEvent=event("j")), 5, {"@graph": None}]) == ["i"]
    assert titles({"@graph": [{"@type": "WebSite"}]}) == ["Eine Karte"]


def test_detail_pages_with_a_graph():
    about = event("Party", description="Die <b>Nacht</b>", offers={"price": 9}, image="https://i/1.png", location={"address": {"streetAddress": "Weg 1"}})
    text = page({"@graph": [{"@type": "WebPage"}, about]})
    assert parsers.rausgegangen_detail(text) == {"short_description": "Die Nacht", "price_text": "9 €", "image_url": "https://i/1.png", "address_text": "Weg 1"}
    (e,) = parsers.PARSERS["Zeche Carl"](text, "u", NOW)
    assert e["title"] == "Party" and e["start_at"] == datetime(2026, 6, 5, 20)
