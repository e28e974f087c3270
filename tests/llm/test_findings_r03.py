"""Faults of the third round: repeated passages of over fifty words with fewer than 400 bytes were not to be seen."""

import random

import numpy as np

from cityfeed.llm import suffix_dedup


def test_passages_below_400_bytes_show(spark):
    rng = random.Random(7)
    fresh = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    long, short = fresh(51), fresh(24)
    texts = [f"{fresh(90)}\n{long} {fresh(70)}", f"{long}  {fresh(20)}", f"{fresh(80)} {short} {fresh(40)}", f"{short} {fresh(60)}", " ".join([fresh(30)] * 2), fresh(300), None, long, "", fresh(49)]
    rows = [*enumerate(texts), (None, long), (11, texts[9]), (11, texts[9]), (12, texts[8]), (13, texts[5])]
    got = suffix_dedup.report(spark.createDataFrame(rows, "doc_id long, text string"))
    seen = {r.doc_id: r for r in got.collect()}
    assert len(long) < 400 and {d for d, r in seen.items() if r.n_removed} == {5, 13}
    assert {d for d, r in seen.items() if r.n_shared_grams} == {0, 1, 5, 7, 13, None} and seen[5].n_shared_grams == seen[13].n_shared_grams > 10
    assert got.count() == len(rows) and {r.n_shared_grams for r in got.collect() if r.doc_id == 11} == {0}  # 49 words are no passage


def test_every_passage_has_a_chosen_gram_wherever_it_stands():
    rng = random.Random(3)
    fresh = lambda n: [rng.choice("uvwxyz") * rng.randint(1, 9) + str(rng.random()) for _ in range(n)]
    old = suffix_dedup.CHUNK_BYTES
    suffix_dedup.CHUNK_BYTES = 64  # a text in several parts
    try:
        for _ in range(60):
            passage = fresh(50)
            texts = [" ".join(fresh(rng.randint(0, 80)) + passage + fresh(rng.randint(0, 80))).encode() for _ in range(2)]
            who, h = suffix_dedup.passage_grams([b"", *texts, b"a b"])
            alone = [set(suffix_dedup.passage_grams([t])[1].tolist()) for t in texts]  # neighbours in the list don't matter
            assert [set(h[who == k + 1].tolist()) for k in range(2)] == alone and alone[0] & alone[1] and set(np.unique(who)) == {1, 2}
    finally:
        suffix_dedup.CHUNK_BYTES = old
