"""Cross-site boilerplate lines by distinct-site spread, in DataFrame operators only.

A line, compared exactly, is boilerplate when it stands on at least
``min_sites`` distinct sites (the ``source`` column) and in as many distinct
texts, so that a document copied whole to many sites keeps its lines. What
stands next to a line doesn't matter. Lines of fewer than ``MIN_CHARS``
characters or ``MIN_WORDS`` words are left alone.

Occurrences are counted by line hash first, since a line on n sites occurs n
times at least, and those of the lines that remain are written once. Their
HyperLogLog sketches of sites and of texts are then merged by aggregation.
Where an estimate is within ``NEAR`` of the threshold, exact distinct counts
decide.

Defined results: a null text has no lines and stays null; an empty text has
one empty line and stays; a text whose lines all go becomes empty; the lines
of a null site count as those of one more site; repeated rows count and are
cleaned each. Columns other than text and n_chars are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityfeed.llm.common import cut, let

MIN_SITES, MIN_CHARS, MIN_WORDS = 8, 20, 3
NEAR = 0.1


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _counted(line: Column) -> Column:
    return (F.length(line) >= MIN_CHARS) & line.rlike(r"[^ \t\r]+[ \t]+[^ \t\r]+[ \t]+[^ \t\r]")


def line_hashes(docs: DataFrame) -> DataFrame:
    """``doc_id, t, site, pos, h, g``: text hash, place and 128-bit hash of every line that counts."""

    def rows(lines: Column) -> Column:
        each = F.transform(lines, lambda x, i: F.when(_counted(x), F.struct(i.alias("pos"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit("line"), x).alias("g"))))
        return F.filter(each, lambda x: x.isNotNull())

    found = docs.where("text is not null").select(
        "doc_id",
        F.xxhash64("text").alias("t"),
        F.coalesce("source", F.lit("\n")).alias("site"),
        F.explode(let(_lines(F.col("text")), rows)).alias("x"),
    )
    return found.select("doc_id", "t", "site", "x.pos", "x.h", "x.g")


def frequent(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The rows of ``line_hashes`` whose line occurs ``min_sites`` times or more, written once for all that follows."""
    often = cut(lines.groupBy("h", "g").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("h", "g"), "often")
    return cut(lines.join(often, ["h", "g"], "left_semi"), "frequent")


def boilerplate(busy: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``(h, g)`` of the ``frequent`` lines that are cross-site boilerplate."""
    guess = busy.groupBy("h", "g").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", 12)).alias("sites"),
        F.hll_sketch_estimate(F.hll_sketch_agg("t", 12)).alias("texts"),
    )

    low, high = min_sites * (1 - NEAR) - 1, min_sites * (1 + NEAR) + 1
    guess = guess.where((F.col("sites") >= low) & (F.col("texts") >= low))
    guess = cut(guess.withColumn("unsure", (F.col("sites") <= high) | (F.col("texts") <= high)), "guess")
    sure = guess.where("not unsure").select("h", "g")
    unsure = busy.join(guess.where("unsure").select("h", "g"), ["h", "g"], "left_semi").select("h", "g", "site", "t")
    # distinct pairs first: each count is then a sum over rows dealt by more than the line
    sites = unsure.select("h", "g", "site").distinct().groupBy("h", "g").agg(F.count("*").alias("sites"))
    texts = unsure.select("h", "g", "t").distinct().groupBy("h", "g").agg(F.count("*").alias("texts"))
    exact = sites.where(F.col("sites") >= min_sites).join(texts.where(F.col("texts") >= min_sites), ["h", "g"])
    return sure.union(exact.select("h", "g"))


def mark(docs: DataFrame, gone: str, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with a column ``gone``: the positions of the boilerplate lines of each text, null where there are none."""
    busy = frequent(line_hashes(docs), min_sites)
    bad = cut(boilerplate(busy, min_sites), "boilerplate")
    places = busy.join(bad, ["h", "g"]).groupBy("doc_id", "t").agg(F.collect_set("pos").alias("pos"))
    # whatever the columns of docs are called, theirs and these stand apart
    a, b = docs.alias("a"), places.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.xxhash64("a.text") == F.col("b.t"))
    return a.join(b, same, "left").select(*[F.col(f"a.`{c}`") for c in docs.columns], F.col("b.pos").alias(gone))


def _rest(text: Column, gone: Column) -> Column:
    kept = lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone), lambda p: F.get(x, p)), "\n")
    return F.when(gone.isNull(), text).otherwise(let(_lines(text), kept))


def clean(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` without boilerplate lines; ``n_chars``, where there is one, follows the text."""
    gone = next(name for name in ("gone", *(f"gone{k}" for k in range(len(docs.columns)))) if name not in docs.columns)
    marked = mark(docs, gone, min_sites)
    text = _rest(F.col("text"), F.col(gone))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    return marked.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def report(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_sha256`` of every row."""
    out = mark(docs.select("doc_id", "text", "source"), "gone", min_sites)
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines(text))).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(_rest(text, F.col("gone")), 256).alias("kept_sha256"),
    )
