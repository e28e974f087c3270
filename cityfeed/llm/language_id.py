"""Language identification with hyperdimensional profiles.

Every letter has a random vector of ``SIZE`` signs, drawn from its code point.
A run of ``N`` letters is bound into one vector, the product of its letters'
vectors, each rotated by its place; a text bundles, that is adds up, the
vectors of all its runs. Texts of a language add up to its prototype. A text
belongs to the language whose prototype has the greatest cosine with it, after
the mean of all prototypes' directions, which says what they have in common,
was taken from both.

Upper case counts as lower case and any stretch of other characters as one
blank, which also stands at both ends. Runs are counted before vectors are
made, so a chunk of texts is a matrix of counts times a matrix of run vectors,
in blocks of ``BLOCK`` different runs; memory is bounded by the chunk (2 MB of
texts and one text, ``ROWS`` rows) and the block. All sums are of whole
numbers, so the prototypes don't depend on partitions.

Each partition adds up a vector per language; Spark adds these, and the
prototypes, one vector for each language, go to every worker.

Defined results: a null text or one without a letter is ``und`` with score 0.
On a tie the language that sorts first is taken; with no usable row to learn
from every text is ``und``. Rows without ``doc_id`` or language teach nothing
and are not held out; repeated rows teach each. The score is the cosine,
negative ones as 0. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityfeed.llm.common import map_arrow, slices

SIZE, N = 1024, 3
BLOCK, ROWS = 8192, 512
#: Letters of a text that are looked at together.
LONG = 2 << 20
#: Different letters of a chunk up to which runs are told apart by a table and not by sorting.
FEW_LETTERS = 150
UNKNOWN = "und"
HELD_OUT_OF, HELD_OUT = 4, 2


@lru_cache(maxsize=20_000)
def letter_vector(code: int) -> np.ndarray:
    """The signs of a letter."""
    bits = np.frombuffer(hashlib.shake_128(f"letter {code}".encode()).digest(SIZE // 8), np.uint8)
    return np.unpackbits(bits).astype(np.int8) * 2 - 1


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    """Of every code point."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letters(text: str) -> np.ndarray:
    """Code points of a text, other characters as single blanks and one at either end; nothing of a text without a letter."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[codes]
    if not letter.any():
        return np.zeros(0, np.uint32)
    stay = letter.copy()
    stay[0] = True
    stay[1:] |= letter[:-1]
    return np.where(letter, codes, 32)[stay]


def run_vectors(runs: np.ndarray) -> np.ndarray:
    """A vector for each row of ``N`` code points."""
    codes, which = np.unique(runs, return_inverse=True)
    single = np.stack([letter_vector(int(c)) for c in codes])
    which = which.reshape(runs.shape)
    out = np.ones((len(runs), SIZE), np.int8)
    for place in range(N):
        out *= np.roll(single, N - 1 - place, axis=1)[which[:, place]]
    return out


def bundles(texts: list[np.ndarray]) -> np.ndarray:
    """A row of ``SIZE`` sums for each of the texts, given as their letters; they are whole numbers. A long text is added up by stretches."""
    out = np.zeros((len(texts), SIZE))
    for k, text in enumerate(texts):
        if len(text) > LONG:
            out[k] = sum(bundles([text[at : at + LONG]])[0] for at in range(0, len(text) - N + 1, LONG - N + 1))
    texts = [x if len(x) <= LONG else x[:0] for x in texts]
    sizes = np.array([len(x) for x in texts])
    if not sizes.sum():
        return out
    flat = np.concatenate(texts)
    seen = np.bincount(flat)
    alphabet = np.flatnonzero(seen)
    few = len(alphabet)
    number = np.zeros(len(seen), np.int32 if few <= FEW_LETTERS else np.int64)
    number[alphabet] = np.arange(few)
    flat = number[flat]
    # texts stand one after the other; what starts in the last N - 1 places of one would span two
    code = flat[: len(flat) - N + 1]
    for place in range(1, N):
        code = code * few + flat[place : len(flat) - N + 1 + place]
    whole = np.ones(len(flat), bool)
    for place in range(1, N):
        whole[np.cumsum(sizes)[sizes >= place] - place] = False
    row = np.repeat(np.arange(len(texts)), sizes)[whole]
    code = code[whole[: len(code)]]
    if few <= FEW_LETTERS:
        met = np.zeros(few**N, bool)
        met[code] = True
        runs = np.flatnonzero(met)
        column = np.zeros(few**N, np.int32)
        column[runs] = np.arange(len(runs))
        column = column[code]
    else:
        runs, column = np.unique(code, return_inverse=True)
    spelled = np.stack([alphabet[runs // few ** (N - 1 - place) % few] for place in range(N)], axis=1)
    exact = np.float32 if len(code) < 1 << 24 else np.float64
    order = None if len(runs) <= BLOCK else np.argsort(column, kind="stable")
    column, row = (column, row) if order is None else (column[order], row[order])
    for lo in range(0, len(runs), BLOCK):
        hi = min(lo + BLOCK, len(runs))
        a, b = (0, len(column)) if order is None else np.searchsorted(column, (lo, hi))
        counts = np.bincount(row[a:b] * (hi - lo) + column[a:b] - lo, minlength=len(texts) * (hi - lo)).reshape(len(texts), hi - lo)
        out += counts.astype(exact) @ run_vectors(spelled[lo:hi]).astype(exact)
    return out


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT_OF == HELD_OUT, F.lit(False))


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, column):
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def prototypes(docs: DataFrame) -> dict[str, np.ndarray]:
    """The sum of the vectors of every language; what reaches the driver is one vector for each language."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in _chunks(batches, 1):
            langs = batch.column(0).to_pylist()
            together: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(langs, batch.column(1).to_pylist(), strict=True):
                together.setdefault(lang, []).append(letters(text))
            for lang, texts in together.items():
                sums[lang] = sums.get(lang, 0) + bundles(texts).sum(axis=0)
        names = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([sums[x].astype(np.int64) for x in names], pa.list_(pa.int64()))], names=["lang", "sums"])

    learnable = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    parts = map_arrow(learnable.select("lang", "text"), run, "lang string, sums array<long>")
    added = parts.select("lang", F.posexplode("sums").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    rows = added.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda v: v["x"]).alias("sums")).collect()
    return {r["lang"]: np.array(r["sums"], np.float64) for r in sorted(rows, key=lambda r: r["lang"]) if any(r["sums"])}


def _directions(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


class Profiles:
    """Prototypes that texts are compared with."""

    def __init__(self, sums: dict[str, np.ndarray]):
        self.names = list(sums)
        if self.names:
            lengths = _directions(np.stack([sums[x] for x in self.names]))
            self.common = lengths.mean(axis=0) if len(self.names) > 1 else np.zeros(SIZE)
            self.own = _directions(lengths - self.common)

    def cosines(self, vectors: np.ndarray) -> np.ndarray:
        """A row for each vector, a column for each language."""
        return _directions(_directions(vectors) - self.common) @ self.own.T

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        spelled = [letters(x) if x else np.zeros(0, np.uint32) for x in texts]
        if not self.names:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        near = np.round(self.cosines(bundles(spelled)), 9)
        best = near.argmax(axis=1)
        some = [len(x) > 0 for x in spelled]
        names = [self.names[b] if ok else UNKNOWN for b, ok in zip(best, some, strict=True)]
        scores = np.where(some, np.clip(near[np.arange(len(best)), best], 0.0, 1.0), 0.0)
        return names, scores.tolist()


OUT = "doc_id long, held_out boolean, lang_pred string, score double"
OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def identify(docs: DataFrame, profiles: Profiles | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, by profiles learned from the rows that are not held out unless some are given."""
    profiles = profiles or Profiles(prototypes(docs))

    def run(batches):
        for batch in _chunks(batches, 2):
            names, scores = profiles.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema=OUT_ARROW)

    return map_arrow(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), run, OUT)
