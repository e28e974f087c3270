"""Interaction of filters: what each removes after, before and without the others.

``failures`` asks five conditions of every text. ``survivors`` counts rows by
their flags once and runs ``CUBE`` over the flags and the part: a grouping-set
row whose selected flags are all false counts what survives that subset of the
filters, whatever the rest says. A step of an order of filters is the pair of
subsets before and after it, so two rows of that table give all its counts;
``audit`` joins them for every order and step.

Texts never move: a row is its id, part, flags and digest from the first
shuffle on. Copies are told by digest; rows with equal digest, part and labels
become one row on the map side, so that a text with very many copies gathers
nowhere. The tables after the count have 32 rows for a part at most.

Words are runs of anything but space, tab, newline, vertical tab, form feed
and carriage return. Defined results: a null text is empty and fails A alone,
or E as well; a null part is the empty string. A row without id is never a
later copy; rows that share the least id of their text are all the first one.
Repeated rows count each. Labels are met by id; of several labels of an id any
1 counts, null counts as 0. An empty table gives no row. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cityfeed.llm.common import cut, let
from cityfeed.llm.quality_rules import BLANKS

LETTERS = ("A", "B", "C", "D", "E")
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
SYMBOLS = "[#$%&*|]"

#: What is counted of the rows that survive a subset.
COUNTS = ("n", "good", "toxic")


def text_flags(text: Column) -> Column:
    """Struct of the failure conditions A to D of one text."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    sizes = let(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return let(
        sizes,
        lambda s: F.struct(
            (s["n"] < MIN_WORDS).alias("A"),
            (100 * s["distinct"] < DISTINCT_PERCENT * s["n"]).alias("B"),
            (100 * capitals > CAPITAL_PERCENT * F.length(text)).alias("C"),
            text.rlike(SYMBOLS).alias("D"),
        ),
    )


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, part, digest, A, B, C, D, good, toxic`` of every row; the text ends here."""
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["source"], F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_flags(text).alias("f"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("of")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    met = rows.join(known, F.col("doc_id") == F.col("of"), "left")
    return met.select("doc_id", "part", "digest", "f.*", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, A, B, C, D, E, good, toxic, n``: rows by their flags and labels.

    E holds for all rows of a text but those with its least id. Rows of equal
    digest, part and labels are counted together before the least id of a
    digest is looked up, so a digest has a few rows for each part.
    """
    same = ["digest", "part", "A", "B", "C", "D", "good", "toxic"]
    by_id = labelled(docs, labels).groupBy("doc_id", *same).agg(F.count("*").alias("n"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    groups = by_id.groupBy(*same).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))).alias("without_id"), least.alias("least"))
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    groups = groups.withColumn("passing", F.coalesce("without_id", F.lit(0)) + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0))
    split = groups.select(*same[1:], F.explode(F.array(F.struct(F.lit(False).alias("E"), F.col("passing").alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("passing")).alias("n")))).alias("e"))
    return split.groupBy("part", *LETTERS[:4], F.col("e.E").alias("E"), "good", "toxic").agg(F.sum("e.n").alias("n")).where("n > 0")


def survivors(failed: DataFrame, letters: Sequence[str] = LETTERS) -> DataFrame:
    """``part, mask, n, good, toxic``: rows of each part that no filter of the subset ``mask`` removes, zeros included.

    ``failed`` holds a boolean column for every filter, ``part``, ``good``,
    ``toxic`` and the number ``n`` of rows like it. Bit k of ``mask`` stands
    for the k-th filter.
    """
    cube = failed.cube("part", *letters).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"), F.grouping("part").alias("whole"), *[F.grouping(x).alias(f"any_{x}") for x in letters]
    )
    none_fails = " and ".join(f"not coalesce({x}, false)" for x in letters)
    mask = sum((F.lit(1 << k) * (1 - F.col(f"any_{x}")) for k, x in enumerate(letters)), F.lit(0)).cast("int")
    kept = cube.where(f"whole = 0 and {none_fails}").select("part", mask.alias("mask"), *COUNTS)
    every = failed.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(letters)) - 1))).alias("mask"))
    return every.join(kept, ["part", "mask"], "left").select("part", "mask", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS])


def steps(letters: Sequence[str] = LETTERS) -> list[tuple[str, int, str, int, int]]:
    """``filter_order, step, filter, before, after`` of all orders; the number of filters fixes their number."""
    out = []
    for order in permutations(range(len(letters))):
        before = 0
        for k, f in enumerate(order, 1):
            out.append(("".join(letters[i] for i in order), k, letters[f], before, before | 1 << f))
            before |= 1 << f
    return out


def audit(failed: DataFrame, letters: Sequence[str] = LETTERS) -> DataFrame:
    """The counts of every part, order and step.

    ``removed`` is what survives before and not after the step; of the rows
    that fail the step's filter the others were removed earlier. The Shapley
    sum counts the pair (S, S + filter) once for each order that goes through
    it, |S|! (k - 1 - |S|)! times for k filters.
    """
    spark = failed.sparkSession
    alive = cut(survivors(cut(failed, "failed"), letters), "alive")
    k, full = len(letters), (1 << len(letters)) - 1
    pairs = [(s, s | 1 << f, letters[f], 1 << f, full & ~(1 << f), factorial(s.bit_count()) * factorial(k - 1 - s.bit_count())) for f in range(k) for s in range(full + 1) if not s >> f & 1]
    pair = F.broadcast(spark.createDataFrame(pairs, "before int, after int, filter string, alone int, others int, weight long"))  # k * 2^(k-1) rows
    before = alive.select("part", F.col("mask").alias("before"), *[F.col(c).alias(f"{c}_before") for c in COUNTS]).join(pair, "before")
    after = alive.select("part", F.col("mask").alias("after"), *[F.col(c).alias(f"{c}_after") for c in COUNTS])
    moved = before.join(after, ["part", "after"])
    # what a filter fails in all and alone is the first and the last of its pairs
    lost = F.col("n_before") - F.col("n_after")
    by_filter = moved.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("before") == 0, lost)).alias("fails"), F.sum(F.when(F.col("before") == F.col("others"), lost)).alias("unique_fails"), F.sum(lost * F.col("weight")).alias("shapley")
    )
    order = F.broadcast(spark.createDataFrame(steps(letters), "filter_order string, step int, filter string, before int, after int"))  # k * k! rows
    out = moved.join(by_filter, ["part", "filter"]).join(order, ["before", "after", "filter"])
    return out.select(
        "part",
        "filter_order",
        "step",
        F.col("n_after").alias("kept"),
        lost.alias("removed"),
        (F.col("fails") - lost).alias("redundant"),
        "unique_fails",
        (F.col("good_before") - F.col("good_after")).alias("good_lost"),
        (F.col("toxic_before") - F.col("toxic_after")).alias("toxic_lost"),
        "shapley",
    )
