"""Byte-level BPE encoding and decoding with DuckDB recursive queries.

Each partition splits its texts into pieces, gives every distinct piece a
number, and lets an in-process DuckDB encode the pieces it hasn't met: the
token-position rows of a piece join the merge table, the recursive query
contracts each piece's leftmost pair of least rank and stops once no pair of
neighbours has a rank. An ordered aggregation over the ids joined with the
vocabulary decodes them. Documents are then put together from their pieces.

A piece of n bytes takes up to n rounds and n * n / 2 rows, so pieces of more
than ``LONG_PIECE`` bytes are merged with a heap, which contracts the same
pairs in the same order; they are decoded by the same query as the others.

Memory is bounded by ``CHUNK_CHARS`` of text and one document, ``QUERY_ROWS``
rows of a query, and by what is remembered. What is
remembered serves all partitions that a worker encodes, the pieces met most
often outlive the others, and all is given up once the worker stops encoding.
DuckDB may not write to the worker's disk.

Defined results: a null text counts as empty and has no token. Special tokens
in a text are ordinary text. Repeated rows are each encoded. Other columns are
ignored, or kept by ``encode``.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from cityfeed.llm.common import Kept, give_back, map_arrow, slices

LONG_PIECE = 512
CHUNK_CHARS = 2 << 20
#: Pieces, stretches of text between spaces, and bytes of either that a worker remembers between chunks.
KEPT_PIECES, KEPT_STRETCHES, KEPT_BYTES = 300_000, 200_000, 4 << 20
#: Rows that the rounds of one query may add up to.
QUERY_ROWS = 750_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file that every machine has."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """``(l, r, id)``: every pair of tokens whose bytes together are a token."""
    l, r, i = array("i"), array("i"), array("i")
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            left, right = ranks.get(token[:k]), ranks.get(token[k:])
            if left is not None and right is not None:
                l.append(left)
                r.append(right)
                i.append(rank)
    return pa.table({name: pa.array(np.frombuffer(x, np.int32)) for name, x in (("l", l), ("r", r), ("id", i))})


#: A token's place is its piece and its first byte in one number. The rounds of a piece end when it has no pair left.
ENCODE = """
CREATE OR REPLACE TEMP TABLE tokens AS
WITH RECURSIVE t(n, place, id) AS (
  SELECT 0, place, id FROM start_tokens
  UNION ALL
  (WITH near AS (
    SELECT n, place, id, lead(id) OVER w AS next_id, lead(place) OVER w AS next_place, lag(place) OVER w AS last_place FROM t WINDOW w AS (ORDER BY place)
  ), best AS (
    SELECT place >> 32 AS piece, min((merges.id::BIGINT << 32) + (place & 4294967295)) AS pick
    FROM near JOIN merges ON near.id = merges.l AND near.next_id = merges.r
    WHERE place >> 32 = next_place >> 32 GROUP BY piece
  )
  SELECT n + 1, place, CASE WHEN place & 4294967295 = pick & 4294967295 THEN (pick >> 32)::INTEGER ELSE id END
  FROM near JOIN best ON place >> 32 = piece
  WHERE last_place IS DISTINCT FROM (piece << 32) + (pick & 4294967295))
)
SELECT place, id FROM t JOIN (SELECT place >> 32 AS piece, max(n) AS n FROM t GROUP BY piece) ended ON place >> 32 = piece AND t.n = ended.n
"""
ADD_LONG = "INSERT INTO tokens SELECT place, id FROM long_tokens"
DECODE = """
SELECT place >> 32 AS piece, count(*) AS n, unhex(string_agg(hex, '' ORDER BY place)) AS said FROM tokens JOIN vocabulary USING (id) GROUP BY piece ORDER BY piece
"""


#: A space that doesn't start a piece; the white space of the pattern is that of Unicode.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LOOSE_SPACE = re.compile(rf"\x20(?:[{SPACE}]|\Z)")
SPLIT_SPACE = re.compile(rf"(?=\x20[^{SPACE}])")


class _Pool:
    """Values of numbered things, one after the other."""

    def __init__(self, kind):
        self.flat, self.n = np.zeros(0, kind), np.zeros(0, np.int64)
        self.at = self.n

    def add(self, flat: np.ndarray, n: np.ndarray) -> None:
        self.flat, self.n = np.concatenate((self.flat, flat)), np.concatenate((self.n, n))
        self.at = np.cumsum(self.n) - self.n

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        """The values of the things ``numbers``, in that order."""
        n = self.n[numbers]
        return self.flat[np.repeat(self.at[numbers] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    def keep(self, numbers: np.ndarray) -> None:
        self.flat = self.gather(numbers)
        self.n = self.n[numbers]
        self.at = np.cumsum(self.n) - self.n


class _Known(dict):
    """Texts to their numbers, with the ids and the decoded bytes of each, and how often each was met."""

    def __init__(self, most: int):
        self.most = most
        self.new: list[str] = []
        self.met = np.zeros(0, np.int64)
        self.ids, self.said = _Pool(np.uint32), _Pool(np.uint8)

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        self[key] = out = len(self)
        return out

    def count(self, numbers: np.ndarray) -> None:
        if len(self.met) < len(self):
            self.met = np.concatenate((self.met, np.zeros(len(self) - len(self.met), np.int64)))
        self.met += np.bincount(numbers, minlength=len(self))

    def forget(self) -> bool:
        """Beyond the bounds, keep the two thirds that were met most often; older meetings count less. Whether anything went."""
        if len(self) <= self.most and len(self.said.flat) <= KEPT_BYTES:
            return False
        order = np.argsort(-self.met, kind="stable")[: 2 * self.most // 3]
        stay = np.sort(order[np.cumsum(self.said.n[order]) <= 2 * KEPT_BYTES // 3])
        names = list(self)
        self.clear()
        self.update((names[k], i) for i, k in enumerate(stay.tolist()))
        self.met = self.met[stay] // 2
        self.ids.keep(stay)
        self.said.keep(stay)
        return True


class Encoder:
    """Encodes distinct pieces in DuckDB and remembers them."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.ranks = load_ranks(path)
        self.split = regex.compile(pattern).findall
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.db.register("merges_in", merge_table(self.ranks))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges_in")
        self.db.register("vocabulary_in", pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "hex": [t.hex() for t in self.ranks]}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary_in")
        for name in ("merges_in", "vocabulary_in"):
            self.db.unregister(name)
        self.pieces, self.stretches = _Known(KEPT_PIECES), _Known(KEPT_STRETCHES)

    def close(self) -> None:
        self.db.close()

    def numbers(self, text: str) -> np.ndarray:
        """The numbers of the stretches of a text.

        A space before anything but white space always starts a piece, so a
        text is cut there and each distinct stretch is split once.
        """
        if not text:
            return np.zeros(0, np.int64)
        if LOOSE_SPACE.search(text):
            first, *rest = SPLIT_SPACE.split(text)
            rest = [p[1:] for p in rest]
        else:
            first, *rest = text.split(" ")
        rest.insert(0, " " + first)
        return np.fromiter(map(self.stretches.__getitem__, rest), np.int64, len(rest))

    def learn(self) -> None:
        """Encode and decode the stretches that have a number but no ids yet."""
        known, pieces = self.stretches, self.pieces
        # a stretch that starts with a space stands for the text after it, any other for the text with a space before it
        lists = [[pieces[p] for p in self.split(x[1:] if x[:1] == " " else " " + x)] for x in known.new]
        new, pieces.new, known.new = [p.encode() for p in pieces.new], [], []
        # a piece that is a token as a whole is encoded; the others are for the query
        token = np.fromiter((self.ranks.get(p, -1) for p in new), np.int64, len(new))
        rest = np.flatnonzero(token < 0).tolist()
        parts, lo, rows = [], 0, 0
        for k, at in enumerate(rest):
            size = len(new[at])
            rows += size * size // 2 if size <= LONG_PIECE else size
            if rows >= QUERY_ROWS or k == len(rest) - 1:
                parts.append(self._query([new[j] for j in rest[lo : k + 1]]))
                lo, rows = k + 1, 0
        tokens, said = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in ([p[0] for p in parts], [p[1] for p in parts]))
        n = np.ones(len(new), np.int64)
        n[rest] = tokens
        whole = np.repeat(token >= 0, n)
        ids = np.empty(len(whole), np.uint32)
        ids[whole] = token[token >= 0]
        if parts:
            ids[~whole] = np.concatenate([p[2] for p in parts])
        n_bytes = np.fromiter(map(len, new), np.int64, len(new))
        if (n_bytes[rest] != said).any():
            raise ValueError("a piece doesn't decode to itself in length")
        text = np.frombuffer(b"".join(new), np.uint8).copy()
        if parts:
            text[~np.repeat(token >= 0, n_bytes)] = np.concatenate([p[3] for p in parts])
        pieces.ids.add(ids, n)
        pieces.said.add(text, n_bytes)
        codes = np.fromiter(chain.from_iterable(lists), np.int64)
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        which = np.repeat(np.arange(len(lists)), sizes)
        pieces.count(codes)
        for of_pieces, of_stretches in ((pieces.ids, known.ids), (pieces.said, known.said)):
            n = np.bincount(which, weights=of_pieces.n[codes], minlength=len(lists)).astype(np.int64)
            of_stretches.add(of_pieces.gather(codes), n)

    def _query(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of pieces, which may not be empty: how many ids and decoded bytes each has, and these one after the other."""
        sizes = np.array([len(p) if len(p) <= LONG_PIECE else 0 for p in pieces], np.int64)
        flat = np.frombuffer(b"".join(p for p in pieces if len(p) <= LONG_PIECE), np.uint8)
        starts = np.cumsum(sizes) - sizes
        places = np.repeat(np.arange(len(pieces), dtype=np.int64) << 32, sizes) + np.arange(len(flat)) - np.repeat(starts, sizes)
        self._run(ENCODE, start_tokens=(places, self.single[flat]))
        for k, p in enumerate(pieces):
            if len(p) > LONG_PIECE:
                ids = np.array(self._merge(p), np.int32)
                self._run(ADD_LONG, long_tokens=(np.arange(len(ids), dtype=np.int64) + (k << 32), ids))
        ids = self.db.execute("SELECT id FROM tokens ORDER BY place").fetchnumpy()["id"]
        decoded = self.db.sql(DECODE).to_arrow_table()
        said = decoded.column("said").combine_chunks()
        lengths = pc.binary_length(said).to_numpy().astype(np.int64)
        return decoded.column("n").to_numpy().astype(np.int64), lengths, np.asarray(ids).astype(np.uint32), np.frombuffer(b"".join(said.to_pylist()), np.uint8)

    def _run(self, sql: str, **tables) -> None:
        for name, (place, id_) in tables.items():
            self.db.register(name, pa.table({"place": pa.array(place, pa.int64()), "id": pa.array(id_, pa.int32())}))
        self.db.execute(sql)
        for name in tables:
            self.db.unregister(name)
    def _merge(self, piece: bytes) -> list[int]:
        """Ids of a long piece: the pair of least rank first, leftmost among equals."""
        n, ranks = len(piece), self.ranks
        ends = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        alive = [True] * n

        def push(a: int) -> None:
            b = ends[a]
            if b < n:
                rank = ranks.get(piece[a : ends[b]])
                if rank is not None:
                    heapq.heappush(heap, (rank, a, b, ends[b]))

        heap: list[tuple[int, int, int, int]] = []
        for a in range(n):
            push(a)
        while heap:
            _, a, b, end = heapq.heappop(heap)
            if not alive[a] or ends[a] != b or b >= n or not alive[b] or ends[b] != end:
                continue
            ends[a], alive[b] = end, False
            if end < n:
                before[end] = a
            push(a)
            if before[a] >= 0:
                push(before[a])
        return [ranks[piece[a : ends[a]]] for a in range(n) if alive[a]]

    def encode(self, texts: list[str | None]):
        """Yield ``(ids, decoded bytes)`` of each text, in chunks of bounded size."""
        chunk, size = [], 0
        for text in texts:
            chunk.append(self.numbers(text or ""))
            size += len(text or "")
            if size >= CHUNK_CHARS:
                yield from self._finish(chunk)
                chunk, size = [], 0
        yield from self._finish(chunk)

    def _finish(self, chunk: list[np.ndarray]):
        if not chunk:
            return
        known = self.stretches
        self.learn()
        known.count(np.concatenate(chunk))
        for numbers in chunk:
            yield known.ids.gather(numbers), known.said.gather(numbers)
        if known.forget() | self.pieces.forget():
            give_back()


_ENCODERS = Kept()


def encoder(path: str, pattern: str):
    """The one encoder of this Python worker, to be used in a ``with`` block."""
    return _ENCODERS.use((path, pattern), lambda: Encoder(path, pattern))


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
DIGEST_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Number of tokens and the digests of the ids and of the decoded bytes."""

    def run(batches):
        with encoder(path, pattern) as own:
            for batch in slices(batches, 1):
                n, ids_sha, text_sha = [], [], []
                for ids, text in own.encode(batch.column(1).to_pylist()):
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    text_sha.append(hashlib.sha256(text.tobytes()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], schema=DIGEST_ARROW)

    return map_arrow(docs.select("doc_id", "text"), run, DIGEST)


IDS = "doc_id long, ids array<int>, decoded binary"
IDS_ARROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids, decoded``: the token ids of every text and the bytes they decode to."""

    def run(batches):
        with encoder(path, pattern) as own:
            for batch in slices(batches, 1):
                rows = list(own.encode(batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([i.astype(np.int32) for i, _ in rows], IDS_ARROW.field(1).type), pa.array([t.tobytes() for _, t in rows], pa.binary())], schema=IDS_ARROW)

    return map_arrow(docs.select("doc_id", "text"), run, IDS)
