"""Removal of long repeated byte strings by longest-previous-factor arrays.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts
elsewhere: anywhere else, or, with ``keep_first``, earlier by doc_id and
place. Strings never cross documents and are judged on the input.

A suffix array of a whole corpus has no place on one machine, and only
suffixes that agree in ``LENGTH`` bytes matter. Every string of that length
therefore names an anchor, its 64-byte gram of least hash; equal strings name
equal anchors at equal distances. Anchors that occur once are dropped, and the
stretches that name one of the others meet by anchor, each string in one
place only.

The suffixes of a group that start as far before their anchor and agree up to
it are in the order of what follows from the anchor on. In this suffix order
the common prefixes of neighbours, and for each suffix the previous and the
next one with a smaller position, give its longest previous factor and where
that occurs. A string goes if the factor has ``LENGTH`` bytes or more; without
``keep_first`` the earlier occurrence goes too, and so all of them. Going
further from the anchor, the order and the factors change only where the
bytes before it differ, so they are found once per branch and not per byte.

Equal stretches of a document are one with several places, and equal ones of
a group are compared once. Anchors of more than ``HOT`` documents don't go to
one task: their strings are dealt one by one, by a 128-bit hash of all their
bytes, so that a suffix order holds equal strings alone, whose previous smaller
position is their least place. That is an aggregation with partial sums.

A passage of ``PASSAGE`` words may have fewer than ``LENGTH`` bytes, and then
nothing of it goes. ``report`` shows such passages beside what goes: of any
``PASSAGE`` consecutive words of a document one gram of ``WORDS`` words is
chosen, the one of least hash, so documents with such a passage in common have
a chosen gram in common, and those without ``WORDS`` words in common have none.

Defined results: a null text counts as empty, a text shorter than ``LENGTH``
bytes has nothing to remove, and repeated rows are copies of each other. Rows
are told apart by doc_id and text: with ``keep_first``, rows alike in both are
one document, which keeps what no other has before. A null doc_id comes last.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cityfeed.llm.common import cut, map_arrow, slices
from cityfeed.llm.rolling import BASE, CHUNK_BYTES, mix, prefix_sums, stretch_hashes, word_hashes

LENGTH, GRAM = 400, 64
#: Documents whose stretches of one anchor meet in one task.
HOT = 30_000
#: Words of a passage that is found for certain, and of the grams it is found by.
PASSAGE, WORDS = 50, 25

_PLACE = (1 << 24) - 1


def previous_factors(order: list[int], lcp: list[int]) -> tuple[list[int], list[int]]:
    """Longest previous factors from a suffix order.

    ``order`` has the positions in suffix order and ``lcp[r]`` the common
    prefix of ``order[r - 1]`` and ``order[r]``, with ``lcp[0]`` 0. For every
    rank: the length of the longest match with a smaller position, and the
    rank of that position, -1 for none. The previous and the next smaller
    position in suffix order are the only candidates, and the common prefix
    with them is the least one in between.
    """
    n = len(order)
    length, source = [0] * n, [-1] * n
    stack: list[tuple[int, int]] = []  # rank, common prefix with the entry below
    for r in range(n):
        reach = lcp[r]
        while stack and order[stack[-1][0]] > order[r]:
            top, below = stack.pop()
            if reach > length[top]:  # order[r] is the next smaller position of what goes
                length[top], source[top] = reach, r
            reach = min(reach, below)
        if stack:  # what stays on top is the previous smaller position
            length[r], source[r] = reach, stack[-1][0]
        stack.append((r, reach))
    return length, source


def common_prefix(a: bytes, b: bytes) -> int:
    """Number of bytes in which two strings agree from the start."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def longest_previous_factors(text: bytes) -> list[int]:
    """For every position the length of the longest match that starts earlier."""
    order = sorted(range(len(text)), key=lambda i: text[i:])
    lcp = [0] + [common_prefix(text[a:], text[b:]) for a, b in zip(order, order[1:], strict=False)]
    out = [0] * len(text)
    for at, length in zip(order, previous_factors(order, lcp)[0], strict=True):
        out[at] = length
    return out


def _least_places(grams: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` neighbours the place of the least, the last among equals."""
    n = len(grams)
    key = (grams & ~np.uint64(_PLACE)) | (np.uint64(_PLACE) - np.arange(n, dtype=np.uint64))
    size = -(-n // width) * width
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    last = np.arange(n - width + 1)
    least = np.minimum(behind[last], ahead[last + width - 1])
    return (np.uint64(_PLACE) - (least & np.uint64(_PLACE))).astype(np.int64)


def anchors(text: bytes):
    """``(hash, place, first, n)`` arrays: each anchor and the run of string starts that name it."""
    found = []
    step = CHUNK_BYTES
    for at in range(0, len(text) - LENGTH + 1, step):
        data = np.frombuffer(text[at : at + step + LENGTH - 1], np.uint8)
        sums = prefix_sums(data)
        start = np.arange(len(data) - GRAM + 1)
        grams = stretch_hashes(sums, start, start + GRAM)
        place = _least_places(grams, LENGTH - GRAM + 1)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        n = np.diff(np.append(first, len(place)))
        found.append((grams[place[first]].view(np.int64), place[first] + at, first + at, n))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


ANCHORS = "doc_id long, t long, h long, spots array<struct<place:int,first:int,n:int>>"
_SPOT = pa.struct([("place", pa.int32()), ("first", pa.int32()), ("n", pa.int32())])
_ANCHOR_ARROW = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("h", pa.int64()), ("spots", pa.list_(_SPOT))])


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """A row for each text and anchor of it, with all places of the anchor."""

    def rows(doc, t, h, place, first, n):
        order = np.argsort(h, kind="stable")
        h, spots = h[order], [pa.array(c[order], pa.int32()) for c in (place, first, n)]
        edge = np.flatnonzero(np.diff(h, prepend=h[0] - 1 if len(h) else 0))
        spots = pa.ListArray.from_arrays(pa.array(np.append(edge, len(h)), pa.int32()), pa.StructArray.from_arrays(spots, fields=list(_SPOT)))
        return pa.RecordBatch.from_arrays([pa.array([doc] * len(edge), pa.int64()), pa.array([t] * len(edge), pa.int64()), pa.array(h[edge], pa.int64()), spots], schema=_ANCHOR_ARROW)

    def run(batches):
        for batch in slices(batches, 2):
            made, size = [], 0
            for doc, t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = anchors(text.encode())
                if len(found[0]):
                    made.append(rows(doc, t, *found))
                    size += len(found[0])
                if size > 100_000:
                    yield pa.Table.from_batches(made).combine_chunks().to_batches()[0]
                    made, size = [], 0
            if made:
                yield pa.Table.from_batches(made).combine_chunks().to_batches()[0]

    return map_arrow(docs, run, ANCHORS)


STRETCHES = "h long, doc_id long, t long, offset int, places array<int>, body binary"
_STRETCH_ARROW = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("t", pa.int64()), ("offset", pa.int32()), ("places", pa.list_(pa.int32())), ("body", pa.binary())])
BATCH_BYTES = 8 << 20


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _stretch_rows(marked: DataFrame) -> DataFrame:
    """A row for each repeated anchor of ``doc_id, t, text, own`` and each different stretch: the bytes of all strings that name it, and the places of the anchor."""

    def run(batches):
        for batch in slices(batches, 2):
            rows, size = [], 0
            for doc, t, text, own in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                data = text.encode()
                for anchor in own:
                    alike: dict[tuple[int, bytes], list[int]] = {}
                    for spot in anchor["spots"]:
                        body = data[spot["first"] : spot["first"] + spot["n"] + LENGTH - 1]
                        alike.setdefault((spot["place"] - spot["first"], body), []).append(spot["place"])
                    for (offset, body), places in alike.items():
                        rows.append((anchor["h"], doc, t, offset, places, body))
                        size += len(body) + 4 * len(places)
                    if size > BATCH_BYTES:
                        yield _batch(rows, _STRETCH_ARROW)
                        rows, size = [], 0
            yield _batch(rows, _STRETCH_ARROW)

    return map_arrow(marked, run, STRETCHES)


class _Group:
    """The stretches of one anchor."""

    def __init__(self):
        #: what precedes the anchor and what follows from it on, to the texts that have it
        self.texts: dict[tuple[bytes, bytes], list[tuple]] = {}

    def add(self, doc, t, offset, places, body) -> None:
        self.texts.setdefault((body[:offset], body[offset:]), []).append((doc is None, doc or 0, t, places))

    def spans(self, keep_first: bool):
        """``(doc, t, start, end)`` of what goes."""
        members = []  # (left, right, least place, all places)
        for (left, right), texts in self.texts.items():
            spots = [(none, doc, t, place) for none, doc, t, places in texts for place in places]
            if keep_first:
                spots = sorted(set(spots))
            members.append((left, right, min(spots), spots))
        self.texts = {}
        if len(members) == 1 and len(members[0][3]) < 2:
            return
        members.sort(key=lambda m: m[1])  # the suffix order
        goes: list[list[tuple[int, int]]] = [[] for _ in members]
        if len(members) > 1:
            self._factors(members, goes, keep_first)
        for (left, right, first, spots), ranges in zip(members, goes, strict=True):
            whole = (max(0, LENGTH - len(right)), len(left))
            for spot in spots:
                none, doc, t, place = spot
                again = len(spots) > 1 and (not keep_first or spot != first)
                for low, high in [whole] if again else ranges:
                    yield None if none else doc, t, place - high, place - low + LENGTH

    @staticmethod
    def _factors(members, goes, keep_first: bool) -> None:
        """For each member the distances before the anchor, in ranges, from which a string starts that goes."""
        lefts = [m[0][::-1] for m in members]
        rank = {k: r for r, k in enumerate(sorted(range(len(members)), key=lambda k: members[k][2]))}
        lcp = [0] + [common_prefix(a[1], b[1]) for a, b in zip(members, members[1:], strict=False)]
        todo = [(list(range(len(members))), lcp, 0)]  # suffix order, common prefixes, distance from which on the bytes to the left are new
        while todo:
            order, lcp, near = todo.pop()
            shared = lefts[order[0]]
            far = min(common_prefix(shared, lefts[k]) for k in order[1:])  # up to here all agree
            length, source = previous_factors([rank[k] for k in order], lcp)
            for r, k in enumerate(order):
                low = max(near, LENGTH - length[r])
                if source[r] >= 0 and low <= far:  # a factor from here has its length and the way to the anchor
                    goes[k].append((low, far))
                    if not keep_first:
                        goes[order[source[r]]].append((low, far))
            branches: dict[int, tuple[list[int], list[int]]] = {}
            least: dict[int, int] = {}  # common prefix since the last member of a branch
            for r, k in enumerate(order):
                for c in least:
                    least[c] = min(least[c], lcp[r])
                if len(lefts[k]) <= far:
                    continue
                c = lefts[k][far]
                own, own_lcp = branches.setdefault(c, ([], []))
                own_lcp.append(least.get(c, 0))
                own.append(k)
                least[c] = LENGTH * 4
            for own, own_lcp in branches.values():
                most = max(len(lefts[k]) for k in own)
                cut_at = [r for r in range(len(own)) if r == 0 or own_lcp[r] + most < LENGTH] + [len(own)]
                for a, b in zip(cut_at, cut_at[1:], strict=False):  # no factor reaches over a cut
                    if b - a > 1:
                        todo.append((own[a:b], [0, *own_lcp[a + 1 : b]], far + 1))


SPANS = "doc_id long, t long, a int, b int"
_SPAN_ARROW = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])


def _grouped_spans(marked: DataFrame, keep_first: bool) -> DataFrame:
    def run(batches):
        now, group, found = None, None, []

        def full():
            nonlocal found
            out, found = _batch(found, _SPAN_ARROW), []
            return out

        for batch in batches:
            for key, *row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if key != now:
                    if group:
                        found.extend(group.spans(keep_first))
                        if len(found) > 100_000:
                            yield full()
                    now, group = key, _Group()
                group.add(*row)
        if group:
            found.extend(group.spans(keep_first))
        yield full()

    cold = _stretch_rows(_only(marked, hot=False))
    return map_arrow(cold.repartition("h").sortWithinPartitions("h"), run, SPANS)


def _only(marked: DataFrame, hot: bool) -> DataFrame:
    """The texts that have hot, or other, anchors, with these alone."""
    own = F.filter("own", lambda x: x["hot"] == F.lit(hot))
    return marked.select("doc_id", "t", "text", own.alias("own")).where(F.size("own") > 0)


def _hot_spans(marked: DataFrame, keep_first: bool) -> DataFrame:
    """The strings of hot anchors, each in a group with its equals."""
    each_arrow = pa.schema([("k", pa.binary()), ("doc_id", pa.int64()), ("t", pa.int64()), ("at", pa.list_(pa.int32()))])

    def strings(batches):
        for batch in batches:
            for doc, t, text, own in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                data, at = text.encode(), {}
                for spot in (s for anchor in own for s in anchor["spots"]):
                    for a in range(spot["first"], spot["first"] + spot["n"]):
                        at.setdefault(hashlib.blake2b(data[a : a + LENGTH], digest_size=16).digest(), []).append(a)
                yield _batch([(k, doc, t, sorted(places)) for k, places in at.items()], each_arrow)

    def ranges(batches):
        """Starts of a text that go, those that overlap in one range."""
        for batch in batches:
            found = []
            for doc, t, at, kept in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                for a in at:
                    if a == kept:
                        continue
                    if found and found[-1][:2] == (doc, t) and found[-1][2] <= a <= found[-1][3]:
                        found[-1] = (doc, t, found[-1][2], a + LENGTH)
                    else:
                        found.append((doc, t, a, a + LENGTH))
            yield _batch(found, _SPAN_ARROW)

    each = map_arrow(_only(marked, hot=True), strings, "k binary, doc_id long, t long, at array<int>")
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc"), F.col("t").alias("text"), F.get("at", F.lit(0)).alias("a"))
    twice = each.groupBy("k").agg(F.sum(F.size("at")).alias("n"), F.min(place).alias("least")).where("n > 1")
    is_first = F.lit(keep_first) & F.col("doc_id").eqNullSafe(F.col("least.doc")) & (F.col("t") == F.col("least.text"))
    out = each.join(twice, "k").select("doc_id", "t", "at", F.when(is_first, F.col("least.a")).alias("kept"))
    return map_arrow(out, ranges, SPANS)


def repeated_spans(docs: DataFrame, keep_first: bool = False, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, t, text)`` of every row and ``(doc_id, t, a, b)``: byte ranges that go, which may overlap."""
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), F.coalesce("text", F.lit("")).alias("text"))
    named = cut(_anchor_rows(rows), "anchors")
    twice = named.groupBy("h").agg(F.sum(F.size("spots")).alias("places"), F.count("*").alias("texts")).where("places > 1")
    twice = cut(twice.select("h", (F.col("texts") > hot).alias("hot")), "repeated")
    own = named.join(twice, "h").groupBy("doc_id", "t").agg(F.collect_set(F.struct("h", "hot", "spots")).alias("own"))
    own = own.select(F.col("doc_id").alias("_d"), F.col("t").alias("_t"), "own")
    marked = rows.join(own, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t"))).select("doc_id", "t", "text", "own")
    spans = _grouped_spans(marked, keep_first)
    if not twice.where("hot").isEmpty():
        spans = spans.union(_hot_spans(marked, keep_first))
    return rows, spans


def _removed(text: bytes, spans) -> tuple[bytes, int, int]:
    """What is left, how many bytes went, and in how many runs."""
    kept, upto, gone, runs, last = [], 0, 0, 0, None
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if last is None or a > last:
            kept.append(text[upto:a])
            runs += 1
            gone += b - a
            last = upto = b
        elif b > last:
            gone += b - last
            last = upto = b
    kept.append(text[upto:])
    return b"".join(kept), gone, runs


def passage_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(text, hash)`` arrays: the different chosen grams of each text, by its number in the list."""
    words = word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    words, found = np.concatenate(words), []
    for at in range(0, len(words) - PASSAGE + 1, CHUNK_BYTES):
        part, own = words[at : at + CHUNK_BYTES + PASSAGE - 1], owner[at : at + CHUNK_BYTES + PASSAGE - 1]
        n = len(part) - WORDS + 1
        grams = np.zeros(n, np.uint64)
        for k in range(WORDS):
            grams = grams * np.uint64(BASE) + part[k : k + n]
        grams = mix(grams)
        inside = own[PASSAGE - 1 :] == own[: len(own) - PASSAGE + 1]  # windows of one text
        place = np.unique(_least_places(grams, PASSAGE - WORDS + 1)[inside])
        found.append((own[place], grams[place]))
    who, h = map(np.concatenate, zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    order = np.lexsort((h, who))
    who, h = who[order], h[order]
    new = (np.diff(who, prepend=-1) != 0) | (h != np.roll(h, 1))
    return who[new], h[new]


def shared_grams(rows: DataFrame) -> DataFrame:
    """``doc_id, t, n_shared_grams`` of the ``doc_id, t, text`` rows that have a chosen gram of another row."""

    def run(batches):
        for batch in slices(batches, 2):
            if not batch.num_rows:
                continue
            who, h = passage_grams([x.encode() for x in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0).take(pa.array(who)), batch.column(1).take(pa.array(who))], names=["h", "doc_id", "t"])

    grams = map_arrow(rows, run, "h long, doc_id long, t long")
    shared = grams.withColumn("n", F.count("*").over(Window.partitionBy("h"))).where("n > 1")
    return shared.dropDuplicates(["h", "doc_id", "t"]).groupBy("doc_id", "t").agg(F.count("*").alias("n_shared_grams"))


def _with_spans(rows: DataFrame, spans: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """Every row with its spans, and its number of ``shared`` grams."""
    marks = spans.select("doc_id", "t", F.struct("a", "b").alias("span"), F.lit(0).cast("long").alias("n_shared_grams"))
    if shared is not None:
        marks = marks.union(shared.select("doc_id", "t", F.lit(None).cast("struct<a:int,b:int>"), "n_shared_grams"))
    per_doc = marks.groupBy("doc_id", "t").agg(F.collect_list("span").alias("spans"), F.sum("n_shared_grams").alias("n_shared_grams")).withColumnsRenamed({"doc_id": "_d", "t": "_t"})
    out = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t")), "left")
    return out.select("doc_id", "text", "spans", F.coalesce("n_shared_grams", F.lit(0).cast("long")).alias("n_shared_grams"))


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_grams long"


def report(docs: DataFrame) -> DataFrame:
    """Sizes and the digest of the bytes left, with all copies removed, and the grams of long passages that another document has too."""

    def run(batches):
        for batch in slices(batches, 1):
            out = []
            for doc, text, spans, shared in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                data = text.encode()
                kept, gone, runs = _removed(data, spans)
                out.append((doc, len(data), gone, runs, hashlib.sha256(kept).hexdigest(), shared))
            cols = zip(*out, strict=True) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (*[pa.int64()] * 4, pa.string(), pa.int64()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_grams"])

    rows, spans = repeated_spans(docs)
    return map_arrow(_with_spans(rows, spans, shared_grams(rows)), run, DIGEST)


def dedup(docs: DataFrame, keep_first: bool = True) -> DataFrame:
    """``doc_id, kept``: the bytes of each text without its repeats; the first copy stays unless ``keep_first`` is false."""

    def run(batches):
        for batch in slices(batches, 1):
            kept = [_removed(t.encode(), s)[0] for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary())], names=["doc_id", "kept"])

    return map_arrow(_with_spans(*repeated_spans(docs, keep_first)), run, "doc_id long, kept binary")
