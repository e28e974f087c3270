"""The registered sources; a new one is an entry here and a parser of that name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Source:
    """``kind`` is api, rss, html or playwright (a rendered page)."""

    name: str
    base_url: str
    kind: str


#: The sources, in the order in which they are synchronised.
SOURCES = [
    Source("Zollverein", "https://www.zollverein.de/", "api"),
    Source("Rausgegangen", "https://www.rausgegangen.de/", "playwright"),
    Source("Ruhrpott-Kids", "https://ruhrpottkids.com/", "rss"),
    Source("wasgehtapp.de", "https://www.wasgehtapp.de/", "playwright"),
    Source("Grugapark", "https://www.grugapark.de/", "html"),
    Source("borbeck.de", "https://www.borbeck.de/", "rss"),
    Source("Gasometer", "https://www.gasometer.de/", "playwright"),
    Source("Unperfekthaus", "https://www.unperfekthaus.de/", "playwright"),
    Source("Theater Essen", "https://www.theater-essen.de/", "playwright"),
    Source("Museum Folkwang", "https://www.museum-folkwang.de/", "playwright"),
    Source("Werdener Nachrichten", "https://waddische.de/", "html"),
    Source("Seaside Beach", "https://www.seaside-beach.de/", "html"),
    Source("Ferienspatz", "https://ferienspatz.essen.de/", "html"),
    Source("GOP Varieté", "https://artistical.de/", "html"),
    Source("Villa Hügel", "https://www.krupp-stiftung.de/", "html"),
    Source("Zeche Carl", "https://www.zechecarl.de/", "html"),
    Source("GREND", "https://grend.de/", "html"),
    Source("Lichtburg", "https://filmspiegel-essen.de/buehne/", "html"),
    Source("Schatzkammer Werden", "https://www.schatzkammer-werden.de/", "html"),
]


def sources(spark: SparkSession) -> DataFrame:
    """The source dimension."""
    return spark.createDataFrame([(s.name, s.base_url, s.kind, True) for s in SOURCES], "source_name string, base_url string, source_type string, active boolean")


def seed(known: DataFrame) -> DataFrame:
    """The source table with the registered ones inserted or updated by name; others stay as they are."""
    new = sources(known.sparkSession)
    return known.join(new.select("source_name"), "source_name", "left_anti").select(new.columns).unionByName(new)


def only(names: list[str] | None) -> list[Source]:
    """The sources of the given names, all without names."""
    return [s for s in SOURCES if not names or s.name in names]
