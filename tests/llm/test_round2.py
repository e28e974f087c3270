"""Stages and operators of the second round against brute force and plain solutions."""

import hashlib
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from cityfeed.llm import bpe, chat_format, common, decontaminate, quality_classifier, suffix_dedup, url_filter
from .test_methods import brute_classes, reference_spans, repeated_texts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.01"


def plain_model(x, y, fold):
    """Ridge over random Fourier features by one solve, out-of-fold scores, and the pooled means that rise."""
    q = quality_classifier
    fourier = q.Fourier.draw(x.mean(0), x.std(0))
    z = fourier(x)
    solve = lambda keep: np.linalg.solve(z[keep].T @ z[keep] + q.RIDGE * np.eye(z.shape[1]), z[keep].T @ y[keep])
    scores = np.array([0.0] * len(y))
    for k in range(q.FOLDS):
        scores[fold == k] = z[fold == k] @ solve(fold != k)
    return solve(np.ones(len(y), bool)), q.isotonic(scores, y)


@pytest.mark.parametrize("partitions", [1, 7])
def test_classifier_equals_one_solve(spark, partitions):
    q = quality_classifier
    docs, labels = spark.read.parquet(SF + "/documents.parquet").repartition(partitions), spark.read.parquet(SF + "/labels.parquet")
    model = q.fit(docs, labels)
    rows = docs.join(labels.where("quality is not null"), "doc_id").where(~q.held_out(F.col("doc_id")))
    rows = rows.select("text", "quality", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(q.FOLDS)).alias("fold")).collect()
    weights, (knots, values) = plain_model(np.array([q.statistics(r.text) for r in rows]), np.array([float(r.quality) for r in rows]), np.array([r.fold for r in rows]))
    assert np.allclose(model.weights, weights, atol=1e-6) and np.allclose(np.interp(knots, model.knots, model.values), values, atol=1e-3)


def planted(spark):
    """A corpus with everything that a stage looks for, and its labels and benchmark."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [text(14) for _ in range(4)] + [text(4)]
    footer = f"{text(6)} and all rights reserved"
    rows = []
    for k in range(60):
        body = text(rng.randint(60, 120)).split(" ")
        if k % 10 == 3:
            body[20:20] = items[k // 10 % 5].upper().split(" ")
        lines = [" ".join(body[:30]), " ".join(body[30:])] + ([footer] if k % 4 == 0 else [])
        rows.append((k, "\n".join(lines), f"site{k % 11}"))
    for k in range(100, 112):
        edited = rows[k - 100][1].split(" ")
        edited[40] = word()
        rows.append((k, " ".join(edited), "copies"))
    rows += [(200 + k, rows[k][1], "copies") for k in range(5)] + [(300, None, "s"), (301, "", "s"), (302, "### $$$ ||| " * 30, "s")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs, items


def without_boilerplate(rows):
    sites, texts = defaultdict(set), defaultdict(set)
    for r in rows:
        for line in (r.text or "").split("\n"):
            if len(line) >= 20 and len(line.split()) >= 3:
                sites[line].add(r.source)
                texts[line].add(r.text)
    bad = {x for x in sites if len(sites[x]) >= 8 and len(texts[x]) >= 8}
    return {r.doc_id: None if r.text is None else "\n".join(x for x in r.text.split("\n") if x not in bad) for r in rows}, bad


def in_text(item, text, window=10):
    a, b = decontaminate.words_of(item), decontaminate.words_of(text)
    wins = [a[k : k + window] for k in range(max(1, len(a) - window + 1))] if a else []
    return any(b[k : k + len(w)] == w for w in wins for k in range(len(b) - len(w) + 1))


def test_pipeline_against_brute_force(spark, tmp_path):
    docs, items = planted(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(k, 1, 0) for k in range(60)] + [(302, 0, 0)] + [(k, 0, 0) for k in range(400, 420)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    accept, strip, near, clean, encode = (stage for _, stage in corpus_pipeline.STAGES)
    d = str(tmp_path)

    kept = accept(spark, docs, d)
    scores = {r.doc_id: r.score for r in quality_classifier.score(docs, spark.read.parquet(f"{d}/labels.parquet")).collect()}
    assert {r.doc_id for r in kept.collect()} == {k for k, s in scores.items() if s >= quality_classifier.CUTOFF}

    rows = docs.collect()
    texts, bad = without_boilerplate(rows)
    assert len(bad) == 1
    stripped = strip(spark, docs, d)
    assert {r.doc_id: (r.text, r.n_chars) for r in stripped.collect()} == {k: (t, len(t or "")) for k, t in texts.items()}

    classes = brute_classes([(r.doc_id, r.text or "") for r in rows])
    assert len(set(classes.values())) < len(rows) - 12
    assert {r.doc_id for r in near(spark, docs, d).collect()} == set(classes.values())

    hit = {r.doc_id for r in rows if any(in_text(i, r.text) for i in items)}
    assert len(hit) > 5 and {r.doc_id for r in clean(spark, docs, d).collect()} == {r.doc_id for r in rows} - hit

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    for r in encode(spark, docs, d).collect():
        text = next(x.text for x in rows if x.doc_id == r.doc_id) or ""
        ids = own.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()) and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()

    # all stages, each on what the one before kept
    left = [r for r in rows if scores[r.doc_id] >= quality_classifier.CUTOFF]
    texts, _ = without_boilerplate(left)
    classes = brute_classes([(k, t or "") for k, t in texts.items()])
    left = {k: texts[k] for k in set(classes.values())}
    want = {k for k, t in left.items() if not any(in_text(i, t) for i in items)}
    out = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, d).collect()}
    assert out == {k: hashlib.sha256((left[k] or "").encode()).hexdigest() for k in want}


def test_dedup_and_encode_of_odd_rows(spark, odd):
    kept = sorted((r.doc_id or 0, bytes(r.kept)) for r in suffix_dedup.dedup(odd).collect())
    text = {r.doc_id: (r.text or "").encode() for r in odd.collect() if r.doc_id is not None}
    got = {k: v for k, v in kept if k}
    # the rows of 4 are one document, which keeps what it says for the first time
    assert len(kept) == 10 and got[5] == text[5] and all(got[k] == reference_spans([text[k]], 400, True)[0] for k in (4, 6))
    assert suffix_dedup.dedup(odd.limit(0)).collect() == []
    both = {r.doc_id: bytes(r.kept) for r in suffix_dedup.dedup(odd, keep_first=False).collect() if r.doc_id in (4, 6)}
    assert both == {4: b"", 6: b""}
    out = bpe.encode(odd, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in out) == sorted((r.text or "").encode() for r in odd.collect())
    assert bpe.encode(odd.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []


def test_hot_anchors_keep_one(spark, docs):
    texts = repeated_texts(4)
    for keep in (False, True):
        rows, spans = suffix_dedup.repeated_spans(docs(list(enumerate(texts))), keep, hot=2)
        got = {r.doc_id: suffix_dedup._removed(r.text.encode(), r.spans)[0] for r in suffix_dedup._with_spans(rows, spans).collect()}
        assert [got[k] for k in range(len(texts))] == reference_spans([t.encode() for t in texts], 400, keep)


def test_long_conversations_and_pages(spark):
    long = "wort " * 200_000
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"{k}") for k in range(30_000)] + [(2, 0, "user", long), (2, 1, "assistant", long)]
    out = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert out[1].n_turns == 30_000 and out[1].n_out_of_order == 0 and out[2].loss_chars == len(long)
    said = "".join(f"{k}" for k in range(1, 30_000, 2))
    assert out[1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    url = "http://www.example.com/de/" + "x" * 100_000
    pages = spark.createDataFrame([(1, url, "<p>" * 100_000), (2, "http://n.net/" + "y" * 100_000, f'<link rel="canonical" href="{url}">')], "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in url_filter.filter_urls(pages).collect()} == {1: "block", 2: "block"}


@pytest.mark.parametrize("nodes", [2, 50, 400, 1 << 20])
def test_blocks_and_long_items_against_brute_force(spark, docs, nodes):
    rng = random.Random(nodes)
    words = [f"w{k}" for k in range(30)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [line(3), line(10), line(40), "", None, line(1) + "x"]
    rows = [(1, line(60)), (1, "a " + items[2] + " b"), (1, None), (None, items[0]), (None, "x " + items[1] + items[5]), (None, ""), (2, items[5])]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.contaminated_words(docs(rows), bench, block_nodes=nodes).collect()
    want = []
    for i, t in rows:
        w = decontaminate.words_of(t)
        hit, found = set(), set()
        for k, item in enumerate(items):
            a = decontaminate.words_of(item)
            for win in [a[p : p + 10] for p in range(max(1, len(a) - 9))] if a else []:
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        found.add(str(k))
        want.append((str(i), len(w), len(hit), sorted(found)))
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in got) == sorted(want)


def test_slices_hold_every_row():
    texts = ["a" * k for k in (0, 5, 900, 3, 2000, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["i", "t"])
    parts = list(common.slices(iter([batch, batch.slice(0, 0)]), 1, 1000))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1, 2, 3], [4], [5, 6], []]


def test_kept_objects_go_when_idle():
    made, closed = Counter(), []

    class Thing:
        def close(self):
            closed.append(self)

    kept = common.Kept(seconds=0.1)
    make = lambda: made.update("m") or Thing()
    for _ in range(3):
        with kept.use("a", make):
            pass
    assert made["m"] == 1
    with kept.use("b", make):
        time.sleep(0.3)
        assert len(closed) == 1 and kept.value is not None  # in use, so it stays
    time.sleep(0.4)
    assert len(closed) == 2 and kept.value is None
    with kept.use("b", make):
        assert made["m"] == 3


def test_scratch_files_go(spark):
    import os

    before = common.cut(spark.range(3), "outer")
    with common.scratch(spark):
        inner = common.cut(spark.range(3), "inner")
        stays = common.cut(spark.range(5), "stays", keep=True)
        folder = inner.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert os.path.exists(folder)
    assert not os.path.exists(folder) and stays.count() == 5 and before.count() == 3
