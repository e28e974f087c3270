"""Who comes first: each of many ordered things stands for itself unless one before it stands for it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityfeed.sources.tables import stage, unstage


def first_come(pairs: DataFrame, known: Column | None = None) -> DataFrame:
    """``p, fate, match`` for every ``p`` of ``pairs(p, q, own)``, ``q`` being less than ``p``.

    In the order of ``p``, each is ``merged`` with the least ``q`` that was
    ``created``, and is created itself if none was; a ``q`` that is no ``p``
    counts as created, as does one for which ``known`` holds. A created ``q``
    in a row marked ``own`` makes ``p`` ``updated`` before that.

    Settled in rounds: in each one every ``p`` whose least open ``q`` is
    settled. Each round is a join and an aggregation over the pairs that are
    still open; their number is that of the longest chain in which every one
    waits for the one before it.
    """
    pairs = stage(pairs, "pairs")
    waiting = pairs.select("p").distinct()
    is_known = F.lit(False) if known is None else known
    open_ = pairs.join(waiting.select(F.col("p").alias("_w")), F.col("q") == F.col("_w"), "left").select("p", "q", "own", (is_known | F.col("_w").isNull()).alias("there"))
    # each is also its own last candidate, and one that finds itself is created
    left = stage(open_.union(waiting.select("p", F.col("p").alias("q"), F.lit(False), F.lit(True))), "pairs")
    unstage(pairs)
    settled = []
    while not left.isEmpty():
        least = F.min(F.when(~F.col("own"), F.struct("q", "there")))
        asked = left.groupBy("p").agg(least.alias("least"), F.max(F.col("own") & F.col("there")).alias("known"), F.max(F.col("own") & ~F.col("there")).alias("waits"))
        fate = F.when(F.col("known"), "updated").when(F.col("waits") | ~F.col("least.there"), None).when(F.col("least.q") == F.col("p"), "created").otherwise("merged")
        now = stage(asked.select("p", fate.alias("fate"), F.col("least.q").alias("match")).where("fate is not null"), "settled")
        settled.append(now)
        then, of_q = left, now.select(F.col("p").alias("_q"), F.col("fate").alias("_fate"))
        rest = left.join(now.select("p"), "p", "left_anti").join(of_q, F.col("q") == F.col("_q"), "left").where("_fate is null or _fate = 'created'")
        left = stage(rest.select("p", "q", "own", (F.col("there") | F.col("_fate").isNotNull()).alias("there")), "pairs")
        unstage(then)
    unstage(left)
    return reduce(DataFrame.union, settled, left.sparkSession.createDataFrame([], "p long, fate string, match long"))
