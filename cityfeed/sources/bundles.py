"""The script bundle that holds a site's shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SITE = "https://artistical.de"
CHUNK = r'"(/_next/static/chunks/[^"]+?\.js)"'
NAMED = [r'"EventsSection"[^"]*' + CHUNK, r'(?s)"EventsSection".*?' + CHUNK]
SCRIPT = r'src="(/_next/static/chunks/[^"]+\.js)"'


def show_bundles(pages: DataFrame, key: str, bundles: DataFrame) -> DataFrame:
    """``key, bundle`` of ``pages(key, payload)``; pages without one are left out.

    The address that follows the section's name in the page, in the same string
    or a later one; without such the first script of the page whose landed
    text, in ``bundles(url, payload)``, names the section and holds a show.
    """
    named = F.coalesce(*[F.when(F.regexp_extract("payload", p, 1) != "", F.regexp_extract("payload", p, 1)) for p in NAMED])
    told = pages.select(key, "payload", named.alias("named"))
    direct = told.where("named is not null").select(key, F.concat(F.lit(SITE), "named").alias("bundle"))
    asked = told.where("named is null").select(key, F.posexplode(F.regexp_extract_all("payload", F.lit(SCRIPT), F.lit(1))).alias("at", "script"))
    holding = bundles.where(F.col("payload").contains("EventsSection") & F.col("payload").contains("slug:")).select("url").distinct()
    met = asked.join(holding, F.concat(F.lit(SITE), F.col("script")) == F.col("url")).groupBy(key).agg(F.min(F.struct("at", "url"))["url"].alias("bundle"))
    return direct.unionByName(met)
