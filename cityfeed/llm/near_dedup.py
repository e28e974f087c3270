"""Near-duplicate documents by order MinHash, checked by banded alignment.

A text is the sequence of its five-word shingles, each labelled with how often
it occurred before, so that labels are unique within a text. Each of ``BANDS``
hash functions picks the ``PICKS`` shingles of least hash and keeps them in
text order; texts with an equal pick, order included, are candidates. So are
texts of up to ``SHORT`` shingles that are equal when one shingle is left out. A
candidate pair is a link if the longest common subsequence of the two
sequences is 0.8 or more of their union, found within the band outside of
which no pair of that similarity can match. Classes are the connected
components of the links.

Exact copies are first folded into one text. A bucket of candidates is never
paired out: first the member that meets most others over all its buckets, in a
group of edited copies their origin, is compared with the rest of each of its
buckets. In buckets that then still hold several components, the members
outside the largest one form blocks, and every member passes each block once
and is counted against all its texts at a time. So links between members of
different components are all found, and copies within one are not compared
again. Members of one leader, and those that pass a block, are dealt over
several tasks where they are many.

Defined results: a null text counts as empty; texts without words are copies
of each other only if they are equal; texts of one to four words have one
shingle. Rows without doc_id have no class and are never dropped. If rows with
one doc_id have different texts, the one of least hash stands for all. Other
columns are ignored, or kept by ``keep_one``.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityfeed.llm.common import cut, drop_cut, map_arrow, scratch, slices
from cityfeed.llm.rolling import chunks, mix, word_hashes
from cityfeed.operators.graph import components

WORDS, SIMILARITY = 5, 0.8
BANDS, PICKS = 16, 4
#: Texts of so few shingles also meet by keys with one shingle left out.
SHORT = 8
#: Ids of 8 bytes that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 4_000_000
#: A bucket of so few members is compared pair by pair, a larger one in blocks.
SMALL = 8
BLOCK = 512
#: Members of a bucket that pass one task.
STREAM = 20_000
#: Members of a leader that one task compares.
LEADER_SHARE = 256

_SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))[:, None]
_ODD = mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(words: np.ndarray) -> np.ndarray:
    """Labelled shingles of a sequence of word hashes, in order."""
    n = len(words)
    if n == 0:
        return words
    if n < WORDS:
        return mix((words * _ODD[:n]).sum(keepdims=True) + np.uint64(n))
    out = words[: n - WORDS + 1] * _ODD[0]
    for k in range(1, WORDS):
        out = out + words[k : n - WORDS + 1 + k] * _ODD[k]
    out = mix(out)
    order = np.argsort(out, kind="stable")
    same = np.flatnonzero(np.diff(out[order]) == 0)
    if len(same):
        run = np.arange(len(out))
        first = np.concatenate(([True], np.diff(out[order]) != 0))
        label = np.empty(len(out), np.uint64)
        label[order] = run - np.maximum.accumulate(np.where(first, run, 0))
        out = np.where(label > 0, mix(out + label * np.uint64(0x8EBC6AF09C88C6E3)), out)
    return out


def picks(s: np.ndarray) -> np.ndarray:
    """One key per band: the shingles of least hash in text order."""
    ranked = mix(s[None, :] ^ _SEEDS)
    if len(s) > PICKS:
        places = np.sort(np.argpartition(ranked, PICKS - 1, axis=1)[:, :PICKS], axis=1)
    else:
        places = np.broadcast_to(np.arange(len(s)), (BANDS, len(s)))
    key = _SEEDS[:, 0].copy()
    for k in range(places.shape[1]):
        key = mix(key * np.uint64(0x2127599BF4325C37) + s[places[:, k]])
    return key.view(np.int64)


def short_keys(s: np.ndarray) -> list[int]:
    """Keys of a text of up to ``SHORT`` shingles: of all of it, and of all but each one.

    Two such texts of similarity 0.8 differ by one inserted shingle if they
    have under 8 in common, so the shorter one is the longer one without one.
    """
    if len(s) > SHORT:
        return []
    rest = [s] if len(s) < WORDS else [s, *(np.delete(s, k) for k in range(len(s)))]
    return [int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True) for x in rest]


class Aligner:
    """Compares texts with one text."""

    def __init__(self, s: np.ndarray):
        self.n = len(s)
        self.order = np.argsort(s)
        self.sorted = s[self.order]

    def similarity(self, t: np.ndarray) -> float:
        """Common subsequence over union if that is at least ``SIMILARITY``, else 0."""
        total = self.n + len(t)
        if not self.n or not len(t) or min(self.n, len(t)) < SIMILARITY * max(self.n, len(t)):
            return 0.0
        at = np.minimum(np.searchsorted(self.sorted, t), self.n - 1)
        j = np.flatnonzero(self.sorted[at] == t)
        i = self.order[at[j]]
        # a pair of this similarity has total / (1 + 1 / SIMILARITY) matches, and none further apart than the rest
        least = SIMILARITY / (1 + SIMILARITY) * total
        near = np.abs(i - j) <= total - 2 * least + 1
        i = i[near]
        if len(i) < least - 1e-9:
            return 0.0
        common = len(i) if (np.diff(i) > 0).all() else self._rising(i.tolist())
        return common / (total - common) if common >= least - 1e-9 else 0.0

    @staticmethod
    def _rising(i: list[int]) -> int:
        tails: list[int] = []
        for x in i:
            k = bisect_left(tails, x)
            if k == len(tails):
                tails.append(x)
            else:
                tails[k] = x
        return len(tails)


SKETCH = "doc_id long, text_key binary, size int, keys array<long>"
SKETCH_ARROW = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("size", pa.int32()), ("keys", pa.list_(pa.int64()))])


def sketch(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, size, keys``: the SHA-256 of the text, its number of shingles, one key per band and those of short texts; no key without words."""

    def run(batches):
        for batch in slices(batches, 1):
            ids, texts = batch.column(0), [(t or "").encode() for t in batch.column(1).to_pylist()]
            at = 0
            for part in chunks(texts):
                found = list(map(shingles, word_hashes(part)))
                keys = [picks(s).tolist() + short_keys(s) if len(s) else [] for s in found]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(part)), pa.array([hashlib.sha256(t).digest() for t in part], pa.binary()), pa.array(map(len, found), pa.int32()), pa.array(keys, pa.list_(pa.int64()))],
                    schema=SKETCH_ARROW,
                )
                at += len(part)

    return map_arrow(docs.where("doc_id is not null").select("doc_id", "text"), run, SKETCH)


LINKS = "a long, b long, similarity double"


def _compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The links among ``(leader, member)`` pairs."""
    size = pairs.groupBy("leader").agg(F.ceil(F.count("*") / LEADER_SHARE).alias("shares"))
    dealt = pairs.join(size, "leader").select("leader", "member", F.pmod(F.xxhash64("member"), "shares").alias("share"))
    led = dealt.select("leader", "share").distinct().join(texts, F.col("leader") == F.col("doc_id")).select("leader", "share", F.lit(None).cast("long").alias("member"), "text")
    other = dealt.join(texts, F.col("member") == F.col("doc_id")).select("leader", "share", "member", "text")
    rows = led.union(other).repartition("leader", "share").sortWithinPartitions("leader", "share", F.col("member").asc_nulls_first())

    def run(batches):
        aligner = None
        for batch in slices(batches, 3):
            leaders, members = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            texts = [t.encode() for t in batch.column(3).to_pylist()]
            found, at = [], 0
            for part in chunks(texts):
                for s in map(shingles, word_hashes(part)):
                    if members[at] is None:
                        aligner = Aligner(s)
                    elif (value := aligner.similarity(s)) > 0:
                        found.append((min(leaders[at], members[at]), max(leaders[at], members[at]), value))
                    at += 1
            yield _link_batch(found)

    return map_arrow(rows, run, LINKS)


class _Block:
    """Leaders of one bucket, and which components they and the texts that pass by are in."""

    def __init__(self):
        self.ids: list[int] = []
        self.texts: list[np.ndarray] = []
        self.index = None
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.setdefault(x, x)) != x:
            self.parent[x] = self.parent[up] if up in self.parent else up
            x = up
        return x

    def add(self, doc: int, root: int, s: np.ndarray) -> None:
        self.ids.append(doc)
        self.texts.append(s)
        self.parent.setdefault(doc, root)

    def links(self, doc: int, root: int, t: np.ndarray):
        """Links from a text to leaders of other components; a component is linked once."""
        if self.index is None:
            flat = np.concatenate(self.texts)
            order = np.argsort(flat, kind="stable")
            sizes = np.array([len(s) for s in self.texts])
            self.index = flat[order], np.repeat(np.arange(len(sizes)), sizes)[order], sizes
        flat, owner, sizes = self.index
        low, high = np.searchsorted(flat, t), np.searchsorted(flat, t, "right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        shared = np.bincount(owner[at], minlength=len(sizes))
        self.parent.setdefault(doc, root)
        for k in np.flatnonzero(shared >= SIMILARITY / (1 + SIMILARITY) * (sizes + len(t)) - 1e-9):
            a, b = self.root(self.ids[k]), self.root(doc)
            if a != b and (value := Aligner(self.texts[k]).similarity(t)) > 0:
                self.parent[max(a, b)] = min(a, b)
                yield min(self.ids[k], doc), max(self.ids[k], doc), value


def _size_class(size):
    """Texts of similarity ``SIMILARITY`` are in the same class or in neighbours: a class spans that ratio of sizes."""
    return F.floor(F.log(size.cast("double")) / F.lit(-log(SIMILARITY)) + F.lit(1e-9)).cast("int")


def _compare_blocks(buckets: DataFrame, texts: DataFrame) -> DataFrame:
    """The links between components of large buckets ``(key, doc_id, root, size)``.

    Of two members in different components one at least is outside the largest
    component of the bucket: these form blocks of about ``BLOCK`` by classes of
    size, and meet the members of their own and of the neighbouring classes as
    a stream. Texts further apart in size can't be that similar.
    """
    buckets = buckets.withColumn("class", _size_class(F.col("size")))
    by_root = buckets.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = by_root.groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("main"))
    rows = buckets.join(main, "key")
    lead = rows.where("root <> main")
    blocks = lead.groupBy("key", "class").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    # a member passes the blocks of three classes
    near = F.explode(F.array(*[F.col("class") + k for k in (-1, 0, 1)]))
    pass_ = rows.select("key", near.alias("class"), "doc_id", "root").join(blocks, ["key", "class"])
    shares = pass_.groupBy("key", "class").agg(F.ceil(F.count("*") / STREAM).cast("int").alias("shares"))
    lead = lead.join(blocks, ["key", "class"]).join(shares, ["key", "class"])
    lead = lead.select("key", "class", F.pmod(F.xxhash64("doc_id"), "blocks").alias("block"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("kind"), "doc_id", "root")
    pass_ = pass_.join(shares, ["key", "class"]).select(
        "key", "class", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64(F.lit("share"), "doc_id"), "shares").cast("int").alias("share"), F.lit(1).alias("kind"), "doc_id", "root"
    )
    dealt = lead.unionByName(pass_).join(texts, "doc_id").select(F.xxhash64("key", "class").alias("key"), "block", "share", "kind", "doc_id", "root", "text")
    dealt = dealt.repartition("key", "block", "share").sortWithinPartitions("key", "block", "share", "kind", "doc_id")

    def run(batches):
        now, block = None, None
        for batch in slices(batches, 6):
            cols = [batch.column(k).to_pylist() for k in range(6)]
            texts = [t.encode() for t in batch.column(6).to_pylist()]
            found, at = [], 0
            for part in chunks(texts):
                for s in map(shingles, word_hashes(part)):
                    key, n, share, kind, doc, root = (c[at] for c in cols)
                    if (key, n, share) != now:
                        now, block = (key, n, share), _Block()
                    if kind == 0:
                        block.add(doc, root, s)
                    elif block.ids:
                        found.extend(block.links(doc, root, s))
                    at += 1
            yield _link_batch(found)

    return map_arrow(dealt, run, LINKS)


def _link_batch(found: list[tuple]) -> pa.RecordBatch:
    cols = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["a", "b", "similarity"])


def _links(buckets: DataFrame, texts: DataFrame) -> DataFrame:
    """Links that join whatever the buckets ``(key, doc_id, n, size)`` can show to be linked."""
    # the member that meets most others over all its buckets: in a group of edited copies the text they come from
    met = buckets.groupBy("doc_id").agg(F.sum("n").alias("met"))
    leaders = buckets.join(met, "doc_id").groupBy("key").agg(F.min(F.struct(-F.col("met"), F.col("doc_id")))["doc_id"].alias("leader"))
    leaders = cut(leaders, "leaders")
    star = buckets.join(leaders, "key").where("doc_id <> leader").select("leader", F.col("doc_id").alias("member")).distinct()
    found = cut(_compare(cut(star, "pairs"), texts), "links")
    root = components(found.select("a", "b")).select(F.col("node").alias("doc_id"), "root")
    # the leader is done with; what remains of a bucket matters if it holds several components
    rest = buckets.where("n > 2").join(leaders.select("key", F.col("leader").alias("doc_id")), ["key", "doc_id"], "left_anti").select("key", "doc_id", "size")
    rest = rest.join(root, "doc_id", "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("root"), "size")
    open_ = rest.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high").select("key", "n")
    rest = cut(rest.join(open_, "key"), "rest")
    small = rest.where(F.col("n") <= SMALL).select("key", "doc_id", "root")
    pairs = small.join(small.select("key", F.col("doc_id").alias("leader"), F.col("root").alias("lead_root")), "key").where("leader < doc_id and root <> lead_root")
    pairs = cut(pairs.select("leader", F.col("doc_id").alias("member")).distinct(), "pairs")
    more = _compare(pairs, texts).union(_compare_blocks(rest.where(F.col("n") > SMALL).select("key", "doc_id", "root", "size"), texts))
    return found.union(cut(more, "links")).distinct()


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, n_links``: one row per doc_id; the class is its least doc_id, links are those found between its text and others."""
    sketched = cut(sketch(docs), "sketch")
    known = sketched.groupBy("doc_id").agg(F.min("text_key").alias("text_key"))
    reps = known.groupBy("text_key").agg(F.min("doc_id").alias("rep"))
    known = cut(known.join(reps, "text_key").select("doc_id", "rep", "text_key"), "known")
    chosen = known.where("doc_id = rep").select("doc_id", "text_key")
    keyed = sketched.join(chosen, ["doc_id", "text_key"], "left_semi").select("doc_id", "size", F.explode("keys").alias("key")).distinct()
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = cut(keyed.join(shared, "key"), "buckets")
    near = _ids(buckets)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(near, "doc_id")
    # where an id has several texts, the one that stands for it; equal rows give one
    texts = rows.groupBy("doc_id").agg(F.min_by("text", F.sha2("text", 256)).alias("text")) if _has_repeats(sketched) else rows.select("doc_id", "text")
    with scratch(docs.sparkSession):
        texts = cut(texts, "texts")
        found = cut(_links(buckets, texts), "found", keep=True)
    for used in (sketched, buckets):
        drop_cut(used)
    root = components(found.select("a", "b")).select(F.col("node").alias("rep"), "root")
    degree = found.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    out = known.join(root, "rep", "left").join(degree, "rep", "left")
    return out.select("doc_id", F.coalesce("root", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _ids(df: DataFrame) -> DataFrame:
    """A table of distinct doc_ids, marked for broadcast if it is counted and small, so that texts needn't be dealt by id."""
    ids = cut(df.select("doc_id").distinct(), "ids")
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _has_repeats(sketched: DataFrame) -> bool:
    return not sketched.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: the one whose doc_id names it. Rows without doc_id stay."""
    gone = _ids(classes(docs).where("doc_id <> class_id"))
    out = docs.join(gone, "doc_id", "left_anti")
    again = cut(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeats")
    if not again.isEmpty():
        twice = out.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        out = out.join(again, "doc_id", "left_anti").unionByName(twice)
    return out.select(*docs.columns)
