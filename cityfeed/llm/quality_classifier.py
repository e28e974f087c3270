"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Statistics of a document, standardised, go through random Fourier features
that approximate a Gaussian kernel. Each partition of the labelled sample sums
its own part of the normal equations, by fold; the sums over partitions give
the ridge weights of all folds and, less one fold, those that score that fold.
Isotonic regression over these out-of-fold scores turns a score into the share
of good documents at that score.

Only labelled rows outside the held-out fifth (crc32 of doc_id as text, mod 5
equal to 0) are used, and of these at most ``MAX_FIT`` with the least hash of
doc_id: the classifier is fitted on a bounded sample, and so what the driver
and the broadcast hold is bounded. Every document is scored.

Defined results: a null text counts as empty; empty texts get the score of
their statistics, which are zero. Labels that are null or belong to no
document are ignored, several labels of a document are averaged. Without
usable labels every score is 0.5. Repeated rows are each scored. Other columns
are ignored, or kept by ``accept``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityfeed.llm.common import cut, map_arrow, slices

MAX_FIT = 20_000
N_FEATURES = 256
FOLDS = 4
RIDGE = 1.0
SEED = 20_240
CUTOFF = 0.3

LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
MARKS = np.frombuffer(b".,;:", np.uint8)


def statistics(text: str | None) -> list[float]:
    """Statistics of a text; all zero for an empty one."""
    words = text.split() if text else []
    if not words:
        return [0.0] * N_STATISTICS
    data = np.frombuffer(text.encode(), np.uint8)
    count = np.bincount(data, minlength=256)
    size, n = len(data), len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = max(int(count[LETTERS].sum()), 1)
    distinct = set(words)
    pairs = set(zip(words, words[1:], strict=False))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lengths = np.fromiter(map(len, words), np.int64, n)
    share = count[count > 0] / size
    return [
        1.0,
        np.log1p(n),
        np.log1p(len(lines)),
        lengths.mean(),
        lengths.std(),
        np.log1p(lengths.max()),
        (lengths <= 3).mean(),
        len(distinct) / n,
        np.log1p(n / len(distinct)),
        len(pairs) / max(n - 1, 1),
        same / n,
        len(set(lines)) / max(len(lines), 1),
        np.log1p(n / max(len(lines), 1)),
        np.sqrt(count[65:91].sum() / letters),
        np.sqrt(count[128:].sum() / size),
        np.sqrt(count[48:58].sum() / size),
        np.sqrt(count[SYMBOLS].sum() / size),
        np.sqrt(count[33] / size),
        np.sqrt(count[MARKS].sum() / size),
        np.sqrt(count[ord("|")] / size),
        np.sqrt(count[10] / size),
        float(-(share * np.log(share)).sum()),
    ]


N_STATISTICS = 22


def _table(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), N_STATISTICS)


@dataclass(frozen=True)
class Fourier:
    """Standardisation and the random directions and phases."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray

    @classmethod
    def draw(cls, mean: np.ndarray, scale: np.ndarray, n: int = N_FEATURES, seed: int = SEED) -> Fourier:
        rng = np.random.default_rng(seed)
        return cls(mean, np.where(scale > 1e-9, scale, 1.0), rng.standard_normal((len(mean), n)) / np.sqrt(len(mean)), rng.uniform(0, 2 * np.pi, n))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases)
        return np.hstack([np.ones((len(x), 1)), waves])


@dataclass(frozen=True)
class Model:
    """Ridge weights over Fourier features and the calibration curve."""

    fourier: Fourier
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.fourier(x) @ self.weights, self.knots, self.values)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the least-squares rising curve: pooled neighbours that violate the order."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of x, sum of y, size
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([a, b, 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def held_out(doc_id: Column) -> Column:
    """Whether the crc32 of doc_id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, max_fit: int) -> DataFrame:
    """``fold, y, x``: statistics of the labelled sample."""
    usable = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_fit rows of two numbers

    def run(batches):
        for b in slices(batches, 2):
            x = _table(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["fold", "y", "x"])

    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int")
    return map_arrow(texts.select(fold.alias("fold"), "y", "text"), run, "fold int, y double, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> Model | None:
    """Fit on at most ``max_fit`` labelled documents; None without usable labels."""
    sample = cut(_sample(docs, labels, max_fit), "fit").coalesce(8)
    n = sample.count()
    if n == 0:
        return None
    moments = sample.select(F.posexplode("x")).groupBy("pos").agg(F.avg("col"), F.stddev_pop("col")).collect()
    moments = sorted(map(tuple, moments))
    fourier = Fourier.draw(*(np.array([m[k] for m in moments]) for k in (1, 2)))
    width = N_FEATURES + 1

    def sums(batches):
        a, b = np.zeros((FOLDS, width, width)), np.zeros((FOLDS, width))
        for batch in batches:
            z, y = fourier(np.array(batch.column(2).to_pylist()).reshape(-1, N_STATISTICS)), batch.column(1).to_numpy()
            fold = batch.column(0).to_numpy()
            for k in range(FOLDS):
                own = z[fold == k]
                a[k] += own.T @ own
                b[k] += own.T @ y[fold == k]
        yield pa.RecordBatch.from_arrays([pa.array(range(FOLDS), pa.int32()), pa.array([np.vstack([p, q]).tobytes() for p, q in zip(a, b, strict=True)], pa.binary())], names=["fold", "part"])

    total = np.zeros((FOLDS, width + 1, width))
    for row in sample.mapInArrow(sums, "fold int, part binary").toLocalIterator():  # a fixed number of rows for each of at most 8 partitions
        total[row.fold] += np.frombuffer(row.part).reshape(width + 1, width)

    def solve(t: np.ndarray) -> np.ndarray:
        return np.linalg.solve(t[:-1] + RIDGE * np.eye(width), t[-1])

    out_of_fold = [solve(total.sum(0) - total[k]) for k in range(FOLDS)]

    def score(batches):
        for batch in batches:
            z, fold = fourier(np.array(batch.column(2).to_pylist()).reshape(-1, N_STATISTICS)), batch.column(0).to_numpy()
            s = np.array([z[i] @ out_of_fold[k] for i, k in enumerate(fold)])
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.float64()), batch.column(1)], names=["s", "y"])

    pairs = sample.mapInArrow(score, "s double, y double").toPandas()  # at most max_fit rows
    knots, values = isotonic(pairs.s.to_numpy(), pairs.y.to_numpy())
    return Model(fourier, solve(total.sum(0)), knots, values)


def _scored(docs: DataFrame, model: Model | None, schema: str, keep):
    """Run ``keep(batch, scores)`` over the batches of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches):
        own = shared.value
        for batch in slices(batches, place):
            texts = batch.column(place).to_pylist()
            yield keep(batch, np.full(len(texts), 0.5) if own is None else np.clip(own.score(_table(texts)), 0, 1))

    return map_arrow(docs, run, schema)


def score(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""

    def keep(batch, s):
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    out = _scored(docs.select("doc_id", "text"), fit(docs, labels, max_fit), "doc_id long, score double", keep)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> DataFrame:
    """The rows of ``docs`` with a score of ``CUTOFF`` or more; the columns stay."""
    return _scored(docs, fit(docs, labels, max_fit), docs.schema, lambda batch, s: batch.filter(pa.array(s >= CUTOFF)))
