"""Corpus preparation: from ``documents`` to token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns what it keeps; all but
the last return the columns of documents. A stage's result is written to the
folder in ``spark.checkpoint.dir`` before the next one reads it, so a lost
executor repeats one stage at most.
"""

from __future__ import annotations

from cityfeed.llm import bpe, decontaminate, line_dedup, near_dedup, quality_classifier
from cityfeed.llm.common import cut, drop_cut, scratch, table

RANKS = "byte_bpe_50k.tiktoken"


def accept_quality(spark, docs, sf_dir):
    """Documents that the classifier, fitted on labelled ones, doesn't reject.

    A null text counts as empty and is judged by that; repeated rows are judged
    alike; without usable labels, or documents, nothing is rejected.
    """
    return quality_classifier.accept(docs, table(spark, sf_dir, "labels"))


def remove_boilerplate(spark, docs, sf_dir):
    """All documents, without lines that spread over many sites.

    A null text stays null, one whose lines all go becomes empty, and repeated
    rows are cleaned each; a null source is a site of its own.
    """
    return line_dedup.clean(docs)


def keep_one_of_near(spark, docs, sf_dir):
    """One document of each group of near-duplicates, the one with the least doc_id.

    Null and empty texts are copies of each other; rows without doc_id stay;
    repeated rows are one document.
    """
    return near_dedup.keep_one(docs)


def drop_contaminated(spark, docs, sf_dir):
    """Documents in which no passage of a benchmark item occurs.

    A null text has no passage and stays, and so does everything where the
    benchmark is empty.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark, docs, sf_dir):
    """Token counts and the digests of the ids and of what they decode to, one row per row; a null text has no token."""
    import public_tokenizers

    return bpe.digest(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", accept_quality),
    ("line dedup", remove_boilerplate),
    ("minhash near-dedup", keep_one_of_near),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level bpe", encode),
]


def run(spark, sf_dir):
    """The rows of the last stage, from the documents of ``sf_dir``; what a stage wrote goes once the next one has its own."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = cut(stage(spark, docs, sf_dir), name.split()[0], keep=True)
        if before is not None:
            drop_cut(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: A classifier and near-duplicate groups have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
