"""Quality rules as a short-circuit cascade, in DataFrame operators only.

Every rule is a condition that rejects a document. One pass over a sample of
the documents asks all rules of each row and reads the clock in between. The
rule with most rejections per second comes first, then the one with most among
the rows that are left, and so on; ``CASE WHEN`` stops at the first that
rejects. The order changes the time alone: a document is kept if no rule
rejects it, whatever the order.

Words are runs of anything but space, tab, newline, vertical tab, form feed
and carriage return. Defined results: null and empty texts have no words, fail
the base rule and are not kept. Repeated rows are each judged. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityfeed.llm.common import let

BLANKS = "[ \t\n\x0b\x0c\r]+"
NON_BLANK = "[^ \t\n\x0b\x0c\r]"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: Rows of the sample on which rules are timed.
SAMPLE_ROWS = 2000
#: Files of a table that the sample is taken from.
SAMPLE_FILES = 8
#: Times that each rule is asked of a row of it.
ROUNDS = 5


def _has_word(line: Column) -> Column:
    return line.rlike(NON_BLANK)


def _repeat_words(w: Column) -> Column:
    """Words in three-word windows that the text holds twice or more.

    Windows are sorted by a 64-bit hash, so equal ones are neighbours; the
    starts of those with an equal neighbour, in text order, each add the words
    that the start before them has not covered.
    """
    n = F.size(w)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def starts(s: Column) -> Column:
        last = F.size(s) - 1
        twice = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(s, i + 1)["h"] == x["h"])))
        return F.sort_array(F.transform(twice, lambda x: x["p"]))

    def covered(p: Column) -> Column:
        own = F.transform(p, lambda x, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), x - F.get(p, k - 1))))
        return F.aggregate(own, F.lit(0), lambda a, x: a + x)

    def sorted_windows(h: Column) -> Column:
        return F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

    repeats = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(sorted_windows(h), lambda s: let(starts(s), covered))))
    return F.when(n < 3, 0).otherwise(repeats)


def text_counts(text: Column) -> Column:
    """Struct of what the rules look at."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), _has_word)
    return F.struct(
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), _repeat_words(w).cast("long").alias("repeats"))).alias("words"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dups"))).alias("lines"),
    )


def with_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, text`` and the counts of the base rule."""
    c = docs.select(F.col(id_col), F.col(text_col).alias("text"), let(text_counts(F.col(text_col)), lambda c: c).alias("c"))
    c = c.select(
        id_col,
        "text",
        F.col("c.words.n").alias("n_words"),
        F.col("c.words.chars").alias("word_chars"),
        F.col("c.n_symbols").alias("n_symbols"),
        F.col("c.lines.dups").alias("n_dup_lines"),
        F.col("c.words.repeats").alias("n_repeat_words"),
        F.col("c.lines.n").alias("n_lines"),
    )
    return c.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


@dataclass(frozen=True)
class Rule:
    """``rejects`` is SQL over the columns of ``with_counts``."""

    name: str
    rejects: str


RULES = [
    Rule("symbols", "5 * n_symbols > n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("repeated_lines", "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule("capitals", "2 * length(regexp_replace(text, '[^A-Z]', '')) > word_chars"),
    Rule("letters", "2 * length(regexp_replace(text, '[^\\\\p{L}]', '')) < word_chars"),
    Rule("ellipses", "10 * (length(text) - length(replace(text, '...', '..'))) > 3 * n_lines AND n_lines >= 3"),
    Rule("exclamations", "5 * (length(text) - length(replace(text, '!', ''))) > n_words"),
]


@dataclass(frozen=True)
class Measured:
    """Seconds for the sample, and the rows rejected that no rule before it rejects."""

    rule: Rule
    seconds: float
    rejected: int

    @property
    def worth(self) -> float:
        return self.rejected / self.seconds


NOW = "CAST(java_method('java.lang.System', 'nanoTime') AS LONG)"


def timed(sample: DataFrame, rules) -> DataFrame:
    """``bits, n, s0, s1, ...``: for each set of rules that reject the same rows their number, and the nanoseconds that each rule took.

    All rules are asked of every row, ``ROUNDS`` times, in one pass; the clock
    is read between them.
    """
    steps = ["'c0', " + NOW]
    for k, rule in enumerate(rules):
        steps.append(f"'r{k}', coalesce({rule.rejects}, false), 'c{k + 1}', {NOW}")
    rounds = sample.where("not base_failed").withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(ROUNDS))))
    seen = rounds.select("round", F.expr(f"named_struct({', '.join(steps)})").alias("x"))
    bits = F.concat(F.lit(""), *[F.col(f"x.r{k}").cast("int").cast("string") for k in range(len(rules))])
    took = [F.sum(F.col(f"x.c{k + 1}") - F.col(f"x.c{k}")).alias(f"s{k}") for k in range(len(rules))]
    return seen.groupBy(bits.alias("bits")).agg(F.count_if(F.col("round") == 1).alias("n"), *took)


def ranked(rules, rows) -> list[Measured]:
    """Rules by rejections per second, each counted on the rows that the rules before it let pass."""
    cost = [max(sum(r[f"s{k}"] for r in rows), 1) / 1e9 / ROUNDS for k in range(len(rules))]
    open_, left, out = list(rows), list(range(len(rules))), []
    while left:
        rejected = {k: sum(r["n"] for r in open_ if r["bits"][k] == "1") for k in left}
        best = min(left, key=lambda k: (-rejected[k] / cost[k], cost[k]))
        out.append(Measured(rules[best], cost[best], rejected[best]))
        open_ = [r for r in open_ if r["bits"][best] == "0"]
        left.remove(best)
    return out


def few_files(docs: DataFrame, most: int = SAMPLE_FILES) -> DataFrame:
    """A table as it was read, or its files of least hash where it has more than ``most``: to be sampled without reading all of it."""
    spark, files = docs.sparkSession, sorted(docs.inputFiles(), key=lambda f: hashlib.md5(f.rpartition("/")[2].encode()).hexdigest())
    return docs if len(files) <= most else spark.read.schema(docs.schema).parquet(*files[:most])


def measure(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[Measured]:
    """Cost and rejections of every rule on about ``sample_rows`` rows, those that pass the base rule; in the order to ask them."""
    rules = list(rules)
    total = max(docs.select(F.lit(1)).count(), 1)
    sample = with_counts(docs.sample(fraction=min(1.0, sample_rows / total), seed=seed)).persist()
    try:
        return ranked(rules, timed(sample, rules).collect())  # at most one row per row of the sample
    finally:
        sample.unpersist()


def cascade(rules) -> Column:
    """Name of the first rule that rejects, else null."""
    out = None
    for rule in rules:
        out = F.when(F.expr(rule.rejects), rule.name) if out is None else out.when(F.expr(rule.rejects), rule.name)
    return F.lit(None).cast("string") if out is None else out.otherwise(None)


def judge(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS, sample_of: DataFrame | None = None) -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` of every row; the rules are measured on rows of ``sample_of``, else of ``docs``."""
    order = [m.rule for m in measure(docs if sample_of is None else sample_of, rules, sample_rows)]
    counted = with_counts(docs)
    kept = F.when(F.col("base_failed"), False).otherwise(cascade(order).isNull())
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
