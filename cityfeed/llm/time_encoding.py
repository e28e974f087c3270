"""Target encoding in the order of time, out of fold.

A row's rate in a column is taken from the rows of other folds that are
strictly earlier and share its value there. For each column

* the rows of a value and a chunk of ``CHUNK_SECONDS`` are counted, folds
  pivoted into a vector of two components for each fold, and a scan over the
  chunks of a value gives the vector before each. Rows are summed up before
  they are shuffled, and a value has one vector for each chunk at most, so its
  vectors grow with the calendar and not with the rows;
* the rows go, by value and chunk and in the order of time, through a prefix
  scan that starts from that vector. Rows of one time add up to one vector and
  see the scan's state before it, their latest strictly earlier vector: the
  total of all folds less that of their own.

What a value says about itself, such as the kind of an item, comes with the
vectors of its chunks, and those of that attribute are sums of these; so no
join meets the rows of a frequent value. Rows stream through the scan, Spark
sorts and spills them; the value that all rows share is dealt by chunk like
any other. Nothing is broadcast, and nothing but plans and file names reaches
the driver.

Defined results: see ``encode_sales``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from cityfeed.llm.common import cut, map_arrow

FOLDS = 5
CHUNK_SECONDS = 86_400
SMOOTHING, SCALE, FIRST_PRIOR = 50, 1_000_000, 500_000
#: Time of the row that holds the vector before a chunk; it sorts before all others.
BEFORE = -(1 << 63)
#: Chunk of the row with what a value says about itself, before all others.
FIRST = -(1 << 31)
#: Lower bits of the sort key that tell the place of a time in its chunk.
PLACE_BITS = 20


def fold_of(key: Column, folds: int = FOLDS) -> Column:
    """Unsigned crc32 of a key's text, modulo the folds."""
    return (F.crc32(key.cast("string")) % folds).cast("int")


def micros(at: Column) -> Column:
    """Microseconds of a time without a zone since 1970."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at.cast("timestamp_ntz"))


def chunk_of(t: Column, chunk_seconds: int = CHUNK_SECONDS) -> Column:
    return F.floor(t / (chunk_seconds * 1_000_000)).cast("int")


def chunk_vectors(rows: DataFrame, key: str, folds: int = FOLDS) -> DataFrame:
    """``key, chunk, v0, v1, ...``: the sums of ``n`` and then of ``s`` by fold."""
    sums = [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"v{i * folds + f}") for i, c in enumerate("ns") for f in range(folds)]
    return rows.groupBy(key, "chunk").agg(*sums)


def added_up(vectors: DataFrame, key: str, folds: int = FOLDS) -> DataFrame:
    """The vectors of a coarser key: ``key, chunk, v0, v1, ...``."""
    return vectors.groupBy(key, "chunk").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(2 * folds)])


def with_past(vectors: DataFrame, key: str, table: DataFrame | None = None, attribute: str | None = None, folds: int = FOLDS) -> DataFrame:
    """``vectors`` with ``history``, the sums of the chunks of their key before each as the bytes of 64-bit numbers, and the attribute of their key in ``table``.

    Of repeated rows of a key the least attribute counts. It goes in front of
    the chunks of its key, so that both take one shuffle.
    """
    names, said = [f"v{k}" for k in range(2 * folds)], [attribute] if attribute else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total, known = None, np.zeros(len(names), np.int64), None  # of the key before
        for batch in batches:
            if not batch.num_rows:
                continue
            values, chunk = batch.column(key), batch.column("chunk").to_numpy()
            own = np.stack([pc.fill_null(batch.column(v), 0).to_numpy() for v in names], axis=1)
            codes = pc.fill_null(values.dictionary_encode().indices, -1).to_numpy()
            new = np.flatnonzero(np.diff(codes, prepend=codes[0] - 1))
            each = np.diff(np.append(new, len(codes)))
            sums = np.cumsum(own, axis=0)
            before = sums - own
            first, goes_on = -before[new], last == (values[0].as_py(),)
            if goes_on:
                first[0] += total
            before += np.repeat(first, each, axis=0)
            last, total = (values[len(values) - 1].as_py(),), before[-1] + own[-1]
            at = np.flatnonzero(chunk != FIRST)
            out = {c: batch.column(c) for c in (key, "chunk", *names)}
            if attribute:
                # where the key begins, or what was known when the batch began
                told = np.where(chunk[new] == FIRST, new + 1, -1)
                if goes_on:
                    told[0] = 0
                told = np.repeat(told, each)
                column = batch.column(attribute)
                out[attribute] = pa.concat_arrays([pa.array([known], column.type), column]).take(pa.array(np.maximum(told, 0), mask=told < 0))
                known = out[attribute][len(column) - 1].as_py()
            out = {c: column if len(at) == len(codes) else column.take(pa.array(at)) for c, column in out.items()}
            ends = pa.py_buffer(np.arange(len(at) + 1, dtype=np.int32) * np.int32(8 * len(names)))
            out["history"] = pa.Array.from_buffers(pa.binary(), len(at), [None, ends, pa.py_buffer(before[at])])
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    rows = vectors.select(key, "chunk", *names)
    if attribute:
        least = table.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(attribute).alias(attribute))
        rows = rows.unionByName(least.withColumn("chunk", F.lit(FIRST)), allowMissingColumns=True)
    fields = [rows.schema[c] for c in (key, "chunk", *names, *said)] + [StructField("history", BinaryType())]
    return map_arrow(rows.repartition(key).sortWithinPartitions(key, "chunk"), run, StructType(fields))


def _group_hash(key: str) -> Column:
    return F.xxhash64(key, "chunk")


def _order(chunk_seconds: int) -> Column:
    """One number to sort by: the upper bits of the hash of value and chunk, then the place of the time in its chunk."""
    size = chunk_seconds * 1_000_000
    first = F.col("chunk") * F.lit(size).cast("long")
    # BEFORE comes to lie at the chunk's first place
    place = F.call_function("div", F.greatest(F.col("t"), first) - first, F.lit(-(-size >> PLACE_BITS)).cast("long"))
    place = F.least(F.lit((1 << PLACE_BITS) - 1).cast("long"), place)
    return F.col("_hash").bitwiseAND(F.lit(-1 << PLACE_BITS)).bitwiseOR(place)


class _State:
    """Of a value and chunk: the vector before the last time, the sum of that time so far, that time, and the attribute."""

    def __init__(self, before, own, time, said):
        self.before, self.own, self.time, self.said = before, own, time, said


def _scan(key: str, name: str, attribute: str | None, folds: int):
    """Runs over rows in the order of ``_order`` and time, and adds the counts before each, its own fold left out.

    Rows of equal upper bits are nearly always of one value and chunk; should
    two share them, their rows alternate and are taken apart. What a batch
    leaves behind goes in front of the next rows of its value and chunk, as
    two rows.
    """

    def groups(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes = pc.fill_null(batch.column(key).dictionary_encode().indices, -1).to_numpy()
        return batch.column("_order").to_numpy() >> PLACE_BITS, codes, batch.column("chunk").to_numpy()

    def changes(*columns: np.ndarray) -> np.ndarray:
        out = np.ones(len(columns[0]), bool)
        out[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        return out

    def added(batch: pa.RecordBatch, new_key: np.ndarray, state: _State | None) -> tuple[pa.RecordBatch, _State]:
        """The rows with their counts, and the state of the last value and chunk; ``state`` is that of the first one."""
        t = batch.column("t").to_numpy()
        starts, at = np.flatnonzero(t == BEFORE), np.flatnonzero(t != BEFORE)
        rows = batch.take(pa.array(at)) if len(starts) else batch
        fold = rows.column("fold").to_numpy()
        vectors = np.zeros((len(t) + 2, 2 * folds), np.int64)
        vectors[at + 2, fold] = rows.column("n").to_numpy()
        vectors[at + 2, folds + fold] = rows.column("s").to_numpy()
        if len(starts):
            vectors[starts + 2] = np.frombuffer(b"".join(batch.column("history").take(pa.array(starts)).to_pylist()), np.int64).reshape(len(starts), 2 * folds)
        new_time = new_key.copy()
        new_time[1:] |= t[1:] != t[:-1]
        if state is not None:
            vectors[0], vectors[1] = state.before, state.own
            new_time[0] = state.time != int(t[0])
        new_key, new_time = np.concatenate(([True, False, state is None], new_key[1:])), np.concatenate(([True, True], new_time))
        place = np.arange(len(vectors))
        sums = np.concatenate((np.zeros((1, 2 * folds), np.int64), np.cumsum(vectors, axis=0)))
        key_at = np.maximum.accumulate(np.where(new_key, place, 0))
        time_at = np.maximum.accumulate(np.where(new_time, place, 0))
        earlier = sums[time_at] - sums[key_at]
        before, own = earlier[-1], sums[-1] - sums[time_at[-1]]
        earlier, each = earlier[2:][at], np.arange(len(at))
        out = {c: rows.column(c) for c in rows.schema.names if c not in ("chunk", "history", "_order", attribute)}
        said = None
        if attribute:
            # that of the row in front of the chunk, or what was known when the batch began
            kind = batch.schema.field(attribute).type
            of_key = pa.chunked_array([pa.array([state.said if state else None], kind), pa.array([None], kind), batch.column(attribute)]).take(pa.array(key_at)).combine_chunks()
            said = of_key[len(of_key) - 1].as_py()
            out[attribute] = of_key.slice(2).take(pa.array(at))
        out[f"{name}_n"] = pa.array(earlier[:, :folds].sum(axis=1) - earlier[each, fold])
        out[f"{name}_s"] = pa.array(earlier[:, folds:].sum(axis=1) - earlier[each, folds + fold])
        return pa.RecordBatch.from_arrays(list(out.values()), names=list(out)), _State(before, own, int(t[-1]), said)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, states = None, {}  # the states of the values and chunks of the last equal bits
        for batch in batches:
            if not batch.num_rows:
                continue
            bits, codes, chunk = groups(batch)
            parts = [(batch, bits, codes, chunk)]
            if (changes(bits, codes, chunk) & ~changes(bits)).any():
                order = np.lexsort((np.arange(len(bits)), chunk, codes, np.cumsum(changes(bits))))
                ends = [*np.flatnonzero(changes(bits[order], codes[order], chunk[order]))[1:].tolist(), len(order)]
                parts = [(batch.take(pa.array(o := order[a:b])), bits[o], codes[o], chunk[o]) for a, b in zip([0, *ends], ends, strict=False)]
            for part, bits, codes, chunk in parts:
                values = part.column(key)
                out, state = added(part, changes(codes, chunk), states.get((values[0].as_py(), int(chunk[0]))) if int(bits[0]) == last else None)
                yield out
                if int(bits[-1]) != last:
                    last, states = int(bits[-1]), {}
                states[values[len(values) - 1].as_py(), int(chunk[-1])] = state

    return run


def with_history(rows: DataFrame, key: str, vectors: DataFrame, name: str, attribute: str | None = None, folds: int = FOLDS, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """``rows`` with ``{name}_n`` and ``{name}_s``, the sums of ``n`` and ``s`` over strictly earlier rows of other folds with their ``key``, and its attribute.

    ``rows`` have the columns ``t, fold, n, s``; ``vectors`` are those of the
    key's chunks by ``with_past``. A null key is a key of its own.
    """
    starts = vectors.select(key, "chunk", F.lit(BEFORE).alias("t"), "history", *([attribute] if attribute else []))
    dated = rows.withColumn("chunk", chunk_of(F.col("t"), chunk_seconds))
    both = dated.unionByName(starts, allowMissingColumns=True).withColumn("_hash", _group_hash(key))
    dealt = both.withColumn("_order", _order(chunk_seconds)).repartition("_hash").sortWithinPartitions("_order", "t").drop("_hash")
    fields = [f for f in dealt.schema.fields if f.name not in ("chunk", "history", "_order", attribute)]
    fields += [f for f in dealt.schema.fields if f.name == attribute] + [StructField(f"{name}_{c}", LongType()) for c in "ns"]
    return map_arrow(dealt, _scan(key, name, attribute, folds), StructType(fields))


def rate(n: Column, s: Column, prior: Column) -> Column:
    """Smoothed share of ``s`` in millionths, the prior where nothing was counted."""
    return F.when(n < 1, prior).otherwise(F.call_function("div", SCALE * s + SMOOTHING * prior, n + SMOOTHING))


def encode_sales(lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Per sale, item and vendor: its lines, the returned ones, and for the ids the count and rate of returns in their history.

    Lines without a sale, or whose sale has no time, are left out. A null item
    or client is the id -1; a null vendor is a value of its own and stays null.
    A null flag is no return. A null or unknown kind, nation or segment is one
    value; of an id's repeated rows the least attribute counts. Repeated lines
    count each, as a line does for every row of a repeated sale. Empty tables
    give no row or no attributes. Other columns are ignored.
    """
    chunk = chunk_of(F.col("t"), chunk_seconds)
    unit = lines.where("sale_id is not null").groupBy("sale_id", F.coalesce("item_id", F.lit(-1).cast("long")).alias("item_id"), "vendor_id")
    unit = unit.agg(F.count("*").alias("n"), F.count_if(F.col("flag") == "returned").alias("s"))
    sold = sales.where("sale_id is not null and sold_at is not null").select(F.col("sale_id").alias("_sale"), F.coalesce("client_id", F.lit(-1).cast("long")).alias("client_id"), micros(F.col("sold_at")).alias("t"))
    unit = unit.join(sold.hint("shuffle_hash"), F.col("sale_id") == F.col("_sale")).drop("_sale")
    unit = cut(unit.withColumn("fold", fold_of(F.col("sale_id"))), "units")
    sale = cut(unit.groupBy("sale_id", "client_id", "t", "fold").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "sold")

    def both_columns(rows: DataFrame, of: DataFrame, key: str, table: DataFrame, attribute: str) -> tuple[DataFrame, DataFrame]:
        vectors = cut(with_past(chunk_vectors(of.withColumn("chunk", chunk), key), key, table, attribute), "vectors")
        rows = with_history(rows, key, vectors, key, attribute, chunk_seconds=chunk_seconds)
        return with_history(rows, attribute, with_past(added_up(vectors, attribute), attribute), attribute, chunk_seconds=chunk_seconds), vectors

    sale, vectors = both_columns(sale, sale, "client_id", clients, "segment")
    sale = sale.withColumn("all", F.lit(0))
    sale = with_history(sale, "all", with_past(added_up(vectors.withColumn("all", F.lit(0)), "all"), "all"), "whole", chunk_seconds=chunk_seconds)
    sale = sale.select(F.col("sale_id").alias("_sale"), F.col("client_id").alias("_client"), F.col("t").alias("_t"), *[f"{x}_{c}" for x in ("client_id", "segment", "whole") for c in "ns"])
    rows = unit.select("sale_id", "item_id", "vendor_id", "client_id", "t", "fold", "n", "s")
    rows, _ = both_columns(rows, unit, "item_id", items, "kind")
    rows, _ = both_columns(rows.drop("kind"), unit, "vendor_id", vendors, "nation_id")
    out = rows.join(sale.hint("shuffle_hash"), (F.col("sale_id") == F.col("_sale")) & (F.col("t") == F.col("_t")) & (F.col("client_id") == F.col("_client")))
    smoothed = lambda name, prior: rate(F.col(f"{name}_n"), F.col(f"{name}_s"), prior)
    whole = smoothed("whole", F.lit(FIRST_PRIOR).cast("long"))
    return out.select(
        "sale_id",
        "item_id",
        "vendor_id",
        F.col("n").alias("n_lines"),
        F.col("s").alias("n_returned"),
        F.col("item_id_n").alias("item_n"),
        smoothed("item_id", smoothed("kind", whole)).alias("item_rate"),
        F.col("vendor_id_n").alias("vendor_n"),
        smoothed("vendor_id", smoothed("nation_id", whole)).alias("vendor_rate"),
        F.col("client_id_n").alias("client_n"),
        smoothed("client_id", smoothed("segment", whole)).alias("client_rate"),
    )
