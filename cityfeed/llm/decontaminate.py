"""Benchmark decontamination with one Aho-Corasick automaton.

Words are runs of ASCII letters, digits and any non-ASCII characters after
A-Z has been lower-cased. A window is ten consecutive words of a benchmark
item, or the whole item if it has fewer. The distinct words of the benchmark
are numbered, and all windows go into one automaton over these numbers, two
nodes for a word instead of one for each of its bytes. Each document is
normalised to the numbers of its words and scanned once, where enough known
words follow each other; a hit gives the words of the document, and so the
characters of the original text, that a window covers.

The benchmark is a stated set. Up to ``BLOCK_NODES`` nodes of it, more than any
usual benchmark has, form one automaton, which a worker keeps from partition to
partition. A larger one is dealt into blocks of that size: a worker gathers
``BUFFER_CHARS`` of text, passes them through one block after the other and
holds one automaton at a time. Every row of documents gives one row whatever
the number of blocks, and nothing is shuffled.

Defined results: null texts and texts without words have no words and no hits;
a null or wordless item has no window; two items may share windows, and both
then count. Repeated rows of documents are each scanned. Items that repeat an
item_id count once. Other columns are ignored, or kept by ``clean``.
"""

from __future__ import annotations

import re
import uuid
from itertools import repeat
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityfeed.llm.common import Kept, map_arrow, slices

WINDOW = 10
#: About 100 bytes each.
BLOCK_NODES = 2_000_000
BUFFER_CHARS = 32 << 20

#: A-Z to a-z; ASCII letters, digits and bytes of other characters stay, the rest become spaces.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The normalised words as UTF-8."""
    return (text or "").encode().translate(TABLE).split()


def windows_of(words: list, window: int = WINDOW) -> list[tuple]:
    """Every window of an item."""
    return [tuple(words[k : k + window]) for k in range(max(1, len(words) - window + 1))] if words else []


class Matcher:
    """One automaton over all windows of some items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        """``items`` are ids and normalised words between spaces."""
        import ahocorasick

        self.items = items
        texts = [text.split() for _, text in items]
        vocabulary = list(dict.fromkeys(w for t in texts for w in t))
        # a number is written as two characters of two alphabets, since an automaton tries the branches of a node one by one
        base = isqrt(len(vocabulary)) + 1
        self.names = {w: chr(1 + k // base) + chr(2 + base + k % base) for k, w in enumerate(vocabulary)}
        owners: dict[str, set[int]] = {}
        for k, t in enumerate(texts):
            for x in windows_of([self.names[w] for w in t], window):
                owners.setdefault("".join(x), set()).add(k)
        self.automaton = ahocorasick.Automaton()
        for x, own in owners.items():
            self.automaton.add_word(x, (len(x) // 2, sorted(own)))
        if owners:
            self.automaton.make_automaton()
            # stretches of known words; no window is shorter
            self.known = re.compile("[^\0]{%d,}" % min(map(len, owners)))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged [first, last + 1) word ranges that windows cover, and the ids of the items that occur."""
        if not words or not self.names:
            return [], set()
        line = "".join(map(self.names.get, words, repeat("\0\0")))
        runs: list[tuple[int, int]] = []
        found: set[int] = set()
        for m in self.known.finditer(line):
            for at, (n, own) in self.automaton.iter(line, *m.span()):
                found.update(own)
                runs.append(((at + 1) // 2 - n, (at + 1) // 2))
        return merged(runs), {self.items[k][0] for k in found}


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges in order, those that touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def word_offsets(text: str) -> list[tuple[int, int]]:
    """[start, end) code points of every word in the original text."""
    out, start = [], None
    for k, c in enumerate(text):
        word = c >= "\x80" or TABLE[ord(c)] != 32
        if word and start is None:
            start = k
        elif not word and start is not None:
            out.append((start, k))
            start = None
    return out + ([(start, len(text))] if start is not None else [])


def _parts(text: str | None, nodes: int, window: int):
    """The words of an item, a long one in parts that hold all its windows."""
    words = words_of(text)
    step = max(1, nodes // (2 * window))
    for k in range(0, max(1, len(words) - window + 1), step):
        yield words[k : k + step + window - 1]


def _blocks(benchmark: DataFrame, nodes: int, window: int):
    """Items in blocks that make ``nodes`` nodes at most; read partition by partition."""
    block, size = [], 0
    for item_id, text in benchmark.select(F.col("item_id").cast("string"), "text").where("item_id is not null").toLocalIterator():
        for words in _parts(text, nodes, window):
            need = 2 * (len(words) if len(words) < window else window * (len(words) - window + 1))
            if block and size + need > nodes:
                yield block
                block, size = [], 0
            block.append((item_id, b" ".join(words)))
            size += need
    if block:
        yield block


_MATCHERS = Kept()


def matcher(key, make):
    """The one automaton that this Python worker keeps, to be used in a ``with`` block."""
    return _MATCHERS.use(key, make)


def _scanned(batches, blocks: list, column: int, window: int):
    """``(batch, hits)`` with one ``(words, runs, items)`` per row, of all blocks together."""

    def waiting():
        now, size = [], 0
        for batch in slices(batches, column):
            now.append(batch)
            size += batch.column(column).nbytes
            if len(blocks) < 2 or size >= BUFFER_CHARS:
                yield now
                now, size = [], 0
        if now:
            yield now

    for some in waiting():
        found: list[list] = [[(0, [], set())] * b.num_rows for b in some]
        for shared in blocks:
            key, items = shared.value
            with matcher((key, window), lambda items=items: Matcher(items, window)) as own:
                for batch, rows in zip(some, found, strict=True):
                    for at, text in enumerate(batch.column(column).to_pylist()):
                        words = words_of(text)
                        runs, names = own.scan(words)
                        rows[at] = (len(words), merged(rows[at][1] + runs), rows[at][2] | names) if runs else (len(words), *rows[at][1:])
            if len(blocks) > 1:  # a worker holds the text of one block at a time
                vars(shared).pop("_value", None)
        yield from zip(some, found, strict=True)


HITS = "n_words long, n_hit long, items array<string>, text_spans array<struct<a:int,b:int>>"
HITS_ARROW = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("text_spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])


def _shared(spark: SparkSession, benchmark: DataFrame, nodes: int, window: int) -> list:
    """One broadcast per block, each bounded by ``nodes``; at least one."""
    return [spark.sparkContext.broadcast((uuid.uuid4().hex, block)) for block in _blocks(benchmark, nodes, window)] or [spark.sparkContext.broadcast(("", []))]


def contaminated_words(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """``doc_id, n_words, n_hit, items, text_spans`` of every row of ``docs``, whatever its ``doc_id``."""
    blocks = _shared(docs.sparkSession, benchmark, block_nodes, window)

    def scan(batches):
        for batch, rows in _scanned(batches, blocks, 1, window):
            spans = []
            for text, (_, runs, _) in zip(batch.column(1).to_pylist(), rows, strict=True):
                at = word_offsets(text) if runs else []
                spans.append([{"a": at[a][0], "b": at[b - 1][1]} for a, b in runs])
            cols = ([n for n, _, _ in rows], [sum(b - a for a, b in runs) for _, runs, _ in rows], [sorted(items) for _, _, items in rows], spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(cols, HITS_ARROW, strict=True))], schema=pa.schema([pa.field("doc_id", pa.int64()), *HITS_ARROW]))

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), scan, "doc_id long, " + HITS)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of ``contaminated_words``."""
    out = contaminated_words(docs, benchmark)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """``docs`` without the rows in which a window occurs; the columns stay.

    The verdict is made inside the scan and no row is shuffled. A null text
    has no words and stays.
    """
    blocks, place = _shared(docs.sparkSession, benchmark, block_nodes, window), docs.columns.index("text")

    def keep(batches):
        for batch, rows in _scanned(batches, blocks, place, window):
            yield batch.filter(pa.array([not items for _, _, items in rows], pa.bool_()))

    return map_arrow(docs, keep, docs.schema)
