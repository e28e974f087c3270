"""Nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cityfeed.llm import bpe, chat_format, decontaminate, line_dedup, near_dedup, pii, quality_classifier, quality_rules, suffix_dedup, url_filter

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def labels_of(spark):
    return spark.createDataFrame([(k, k % 2, 0) for k in range(20)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")


def benchmark_of(spark):
    return spark.createDataFrame([(1, "text without id"), (2, None), (3, ""), (None, "x")], "item_id long, text string")


PER_ROW = {
    "quality_rules": lambda s, d: quality_rules.judge(d),
    "suffix_dedup": lambda s, d: suffix_dedup.report(d),
    "pii": lambda s, d: pii.scan(d),
    "classifier": lambda s, d: quality_classifier.score(d, labels_of(s)),
    "line_dedup": lambda s, d: line_dedup.report(d),
    "bpe": lambda s, d: bpe.digest(d, RANKS, public_tokenizers.PATTERN),
    "decontaminate": lambda s, d: decontaminate.report(d, benchmark_of(s)),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_every_row_has_a_result(spark, odd, name):
    out = PER_ROW[name](spark, odd).collect()
    assert len(out) == 10
    assert sorted(r.doc_id for r in out if r.doc_id is not None) == [1, 2, 3, 4, 4, 5, 6, 7]


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_table(spark, odd, name):
    assert PER_ROW[name](spark, odd.limit(0)).collect() == []


STAGES = {
    "classifier": lambda s, d: quality_classifier.accept(d, labels_of(s)),
    "line_dedup": lambda s, d: line_dedup.clean(d),
    "near_dedup": lambda s, d: near_dedup.keep_one(d),
    "decontaminate": lambda s, d: decontaminate.clean(d, benchmark_of(s)),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns(spark, odd, name):
    out = STAGES[name](spark, odd)
    assert out.columns == odd.columns
    n = out.count()
    assert 0 <= n <= 10
    assert STAGES[name](spark, odd.limit(0)).count() == 0


def test_near_dedup_rows(spark, odd):
    assert sorted(r.doc_id for r in near_dedup.classes(odd).collect()) == [1, 2, 3, 4, 5, 6, 7]
    kept = near_dedup.keep_one(odd).select("doc_id").collect()
    # 1, 2 and 7 are copies of the empty text; the two rows of 4 are one document; rows without an id stay
    assert sorted(r.doc_id or 0 for r in kept) == [0, 0, 1, 3, 4, 5, 6]


def test_urls(spark):
    rows = [(1, None, None), (2, "no scheme", "<p>"), (3, "HTTP://A.Example.ORG", None), (3, "HTTP://A.Example.ORG", None), (None, "http://x.com/de/1", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("node", F.lit("y"))
    out = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages).collect()}
    assert out == {(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.example.org", "", None, "allow"), (None, "x.com", "/de/1", "com/de/", "block")}
    assert url_filter.filter_urls(pages.limit(0)).collect() == []


def test_conversations(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (1, None, None, "x"), (None, 0, "user", "y"), (2, 5, "tool", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(9))
    out = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(turns)).collect()}
    assert out[1].n_turns == 4 and out[1].loss_chars == 2 and out[None].n_turns == 1 and out[2].n_turns == 1
    assert chat_format.read_back(chat_format.format_turns(turns.limit(0))).collect() == []
