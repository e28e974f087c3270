"""Language profiles, the filter audit and time-ordered encoding against brute force."""

import random
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cityfeed.llm import filter_audit, language_id, time_encoding

D = "/root/testdata/sf0.01"


# --- time-ordered target encoding


def encoding_case(spark, seed):
    r = random.Random(seed)
    start = datetime(2024, 1, 1)
    sales = [(k, r.choice([7, 7, 1, 2, None]), start + timedelta(seconds=r.randrange(0, 40) * r.choice([1, 3600])) if r.random() < 0.9 else None) for k in range(60)] + [(None, 1, start)]
    lines = [(r.choice([7, 7, 7, *range(70), None]), r.choice([3, 3, 3, 1, 2, None, 99]), r.choice([5, 5, 6, None, 77]), r.choice(["returned", "kept", None])) for _ in range(300)]
    lines += lines[:20]
    items, vendors, clients = [(1, "toys"), (2, None), (3, "toys"), (3, "toys"), (None, "x")], [(5, 1), (6, 2), (None, 9)], [(7, "a"), (1, "b"), (2, None)]
    tables = {
        "lines": spark.createDataFrame(lines, "sale_id long, item_id long, vendor_id long, flag string").withColumn("kind", F.lit("?")).withColumn("t", F.lit(1)),
        "sales": spark.createDataFrame(sales, "sale_id long, client_id long, sold_at timestamp_ntz").withColumn("hash", F.lit(0)),
        "items": spark.createDataFrame(items, "item_id long, kind string"),
        "vendors": spark.createDataFrame(vendors, "vendor_id long, nation_id int"),
        "clients": spark.createDataFrame(clients, "client_id long, segment string").withColumn("chunk", F.lit(0)),
    }
    return tables, lines, sales, (dict(items[:3]), dict(vendors[:2]), dict(clients))


def brute_encoding(lines, sales, attributes):
    kinds, nations, segments = attributes
    sold = {k: (-1 if c is None else c, at) for k, c, at in sales if k is not None and at is not None}
    rows = []
    for sale, item, vendor, flag in lines:
        if sale in sold:
            client, at = sold[sale]
            item = -1 if item is None else item
            rows.append({"sale": sale, "at": at, "fold": zlib.crc32(str(sale).encode()) % 5, "back": flag == "returned", "item": item, "vendor": vendor, "client": client, "kind": kinds.get(item), "nation": nations.get(vendor), "segment": segments.get(client), "all": 0})

    def past(row, name):
        met = [x["back"] for x in rows if x["fold"] != row["fold"] and x["at"] < row["at"] and x[name] == row[name]]
        return len(met), sum(met)

    def rate(row, name, p):
        n, s = past(row, name)
        return p if n < 1 else (1_000_000 * s + 50 * p) // (n + 50)

    out = {}
    for row in rows:
        whole = rate(row, "all", 500_000)
        of = {name: (past(row, name)[0], rate(row, name, rate(row, coarse, whole))) for name, coarse in (("item", "kind"), ("vendor", "nation"), ("client", "segment"))}
        key = (row["sale"], row["item"], row["vendor"])
        n, s = out.get(key, (0, 0))[:2]
        out[key] = (n + 1, s + row["back"], *of["item"], *of["vendor"], *of["client"])
    return sorted((str((*k, *v)) for k, v in out.items()))


@pytest.mark.parametrize("seed, chunk, batch", [(1, 86_400, 10_000), (2, 5, 3), (3, 3600, 2), (4, 1, 1)])
def test_encoding_against_brute_force(spark, seed, chunk, batch):
    tables, *rest = encoding_case(spark, seed)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)  # prefixes and times go on over batches
    try:
        got = time_encoding.encode_sales(**tables, chunk_seconds=chunk).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    names = ["sale_id", "item_id", "vendor_id", "n_lines", "n_returned", "item_n", "item_rate", "vendor_n", "vendor_rate", "client_n", "client_rate"]
    assert sorted(str(tuple(x[n] for n in names)) for x in got) == brute_encoding(*rest)


def test_encoding_of_colliding_hashes(spark, monkeypatch):
    """Values and chunks that share all bits of the hash alternate in a partition and are told apart."""
    tables, *rest = encoding_case(spark, 6)
    monkeypatch.setattr(time_encoding, "_group_hash", lambda key: F.lit(1 << 40).cast("long") * (F.col("chunk") % 2))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = time_encoding.encode_sales(**tables, chunk_seconds=3600).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(str(tuple(x)) for x in got) == brute_encoding(*rest)


@pytest.mark.parametrize("empty", ["lines", "sales", "items", "vendors", "clients"])
def test_encoding_empty_tables(spark, empty):
    tables, lines, sales, attributes = encoding_case(spark, 5)
    tables[empty] = tables[empty].limit(0)
    lines, sales = ([], sales) if empty == "lines" else (lines, [] if empty == "sales" else sales)
    attributes = [{} if empty == name else known for name, known in zip(("items", "vendors", "clients"), attributes, strict=True)]
    assert time_encoding.encode_sales(**tables).count() == len(brute_encoding(lines, sales, attributes))


# --- interaction of filters


def brute_audit(rows, labels):
    good, toxic = {k for k, q, _ in labels if k is not None and q == 1}, {k for k, _, t in labels if k is not None and t == 1}
    least = {}
    for k, text, _ in rows:
        if k is not None:
            least[text or ""] = min(least.get(text or "", k), k)
    docs = defaultdict(list)
    for k, text, source in rows:
        t = text or ""
        w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if x]
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": k is not None and k > least[t],
        }
        docs[source or ""].append(({x for x in fails if fails[x]}, k in good, k in toxic))
    out = {}
    for part, of in docs.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = of
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[0]]
                left = [d for d in left if x not in d[0]]
                shapley[x] += len(gone)
                all_failing = sum(x in d[0] for d in of)
                out[part, "".join(order), step] = (len(left), len(gone), all_failing - len(gone), sum(d[0] == {x} for d in of), sum(d[1] for d in gone), sum(d[2] for d in gone))
        for (p, order, step), v in list(out.items()):
            if p == part:
                out[p, order, step] = (*v, shapley[order[step - 1]])
    return out


def test_audit_against_brute_force(spark):
    r = random.Random(3)
    words = ["Alpha", "beta", "gamma#", "DELTA", "ε", "z" * 9, "x y", "\x0b"]
    texts = [" ".join(r.choice(words[: r.choice([2, 8])]) if r.random() < 0.5 else f"w{r.randrange(300)}" for _ in range(r.choice([3, 49, 50, 51, 120]))) for _ in range(40)]
    texts += [None, "", "  \n", "A" * 60, " ".join("a" * 50), texts[0], texts[1]]
    rows = [(r.choice([k, k, k % 9, None]), r.choice(texts), r.choice(["s0", "s0", "s1", None, ""])) for k in range(160)] + [(500, "copy " * 70, "s0"), (501, "copy " * 70, "s9"), (501, "copy " * 70, "s9"), (500, "copy " * 70, "s0")]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 0, 1])) for k in range(0, 160, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("part", F.lit("?")).withColumn("n", F.lit(7)).withColumn("A", F.lit(True))
    out = filter_audit.audit(filter_audit.failures(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = {(x.part, x.filter_order, x.step): tuple(x[n] for n in names) for x in out}
    assert len(got) == len(out) and got == brute_audit(rows, labels)


def test_audit_odd_rows(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = filter_audit.audit(filter_audit.failures(odd, labels)).collect()
    assert len(out) == 2 * 600 and {x.part for x in out} == {"s", ""}
    assert sum(x.kept + x.removed for x in out if x.step == 1 and x.filter_order == "ABCDE") == 10
    assert filter_audit.audit(filter_audit.failures(odd.limit(0), labels)).collect() == []


# --- language identification


def plain_vector(text):
    """The bundle of a text, run by run."""
    spelled = [" "]
    for c in text.lower():
        if c.isalpha():
            spelled.append(c)
        elif spelled[-1] != " ":
            spelled.append(" ")
    spelled += [" "] if spelled[-1] != " " else []
    out = np.zeros(language_id.SIZE, np.int64)
    for k in range(len(spelled) - 2):
        bound = np.ones(language_id.SIZE, np.int64)
        for place, c in enumerate(spelled[k : k + 3]):
            bound *= np.roll(language_id.letter_vector(ord(c)).astype(np.int64), 2 - place)
        out += bound
    return out


def test_bundles_against_runs(monkeypatch):
    texts = ["Der Hund.", "a", "Ça va, İstanbul? 42 ŒUVRE ß", "日本語 の 文章", "x" * 50, "\ud800 lone"]
    want = [plain_vector(x) for x in texts]
    same = lambda: all((a == b).all() for a, b in zip(language_id.bundles([language_id.letters(x) for x in texts]), want, strict=True))
    assert same()
    for name, value in (("BLOCK", 3), ("FEW_LETTERS", 2), ("LONG", 7)):
        monkeypatch.setattr(language_id, name, value)
        assert same(), name
    assert language_id.bundles([]).shape == (0, language_id.SIZE) and not language_id.bundles([language_id.letters("12 !")]).any()


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(D + "/documents.parquet")
    out = {r.doc_id: r for r in language_id.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(out) == len(truth)
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 4 == 2]
    assert sorted(held) == sorted(k for k, r in out.items() if r.held_out)
    asked = [k for k in held if truth[k] is not None and out[k].lang_pred != "und"]
    assert sum(out[k].lang_pred == truth[k] for k in asked) >= 0.98 * len(asked)
    assert all(0 <= r.score <= 1 for r in out.values())
    # by hand: the same prototypes whatever the partitions, the same prediction for a text by itself
    few = docs.where("doc_id < 120")
    a, b = (language_id.prototypes(few.repartition(n)) for n in (1, 5))
    assert list(a) == list(b) and all((a[x] == b[x]).all() for x in a)
    plain = defaultdict(lambda: 0)
    for r in few.collect():
        if r.lang is not None and r.text and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            plain[r.lang] = plain[r.lang] + plain_vector(r.text)
    assert {x: v.tolist() for x, v in plain.items()} == {x: v.astype(int).tolist() for x, v in a.items()}


def test_language_labels_play_no_part(spark):
    """Held-out rows are predicted alike whatever their own language says."""
    docs = spark.read.parquet(D + "/documents.parquet").where("doc_id < 200")
    other = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("?"))
    rows = lambda df: sorted(map(tuple, language_id.identify(df).collect()))
    assert rows(docs) == rows(other)


def test_language_odd_rows(spark, odd):
    out = language_id.identify(odd).collect()
    assert sorted(r.doc_id or 0 for r in out) == [0, 0, 1, 2, 3, 4, 4, 5, 6, 7]
    assert {r.lang_pred for r in out if r.doc_id in (1, 2, 3, 7)} == {"und"} and {r.score for r in out if r.doc_id in (1, 2, 3, 7)} == {0.0}
    assert {r.lang_pred for r in out if r.doc_id in (4, 5, 6)} == {"en"}
    assert all(r.held_out is False for r in out if r.doc_id is None)
    nothing = language_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"} and len(nothing) == 10
    assert language_id.identify(odd.limit(0)).collect() == []


# --- what queries on one driver share


def test_scratch_is_of_its_thread(spark):
    """A table that another thread writes while a block is open outlives the block."""
    import threading

    from cityfeed.llm.common import cut, scratch

    opened, written, kept, own = threading.Event(), threading.Event(), [], []

    def other():
        opened.wait(60)
        kept.append(cut(spark.range(5), "other"))
        written.set()

    thread = threading.Thread(target=other)
    thread.start()
    with scratch(spark):
        own.append(cut(spark.range(7), "own"))
        opened.set()
        assert written.wait(60) and own[0].count() == 7
    thread.join()
    assert kept[0].count() == 5
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|PATH_NOT_FOUND"):
        own[0].count()


def test_kept_survives_a_failing_make():
    from cityfeed.llm.common import Kept

    kept = Kept(0.05)

    def fail():
        raise ValueError("no")

    with pytest.raises(ValueError), kept.use("a", fail):
        pass
    assert kept.users == 0
    with kept.use("a", lambda: [1]) as value:
        assert value == [1] and kept.users == 1
    with pytest.raises(ValueError), kept.use("b", fail):
        pass
    assert kept.users == 0 and kept.value is None


def test_attributes_come_with_the_vectors(spark):
    """What a value says about itself takes no join, and the sums before a chunk no window: one shuffle by value for both."""
    columns = ", ".join(f"v{k} long" for k in range(10))
    vectors = spark.createDataFrame([(5, 2, *[1] * 10), (5, 7, *[10] * 10), (None, 2, *[3] * 10), (8, 1, *[0] * 10)], "vendor_id long, chunk int, " + columns)
    vendors = spark.createDataFrame([(5, 4), (5, 2), (6, 1), (None, 9)], "vendor_id long, nation_id int")
    out = time_encoding.with_past(vectors, "vendor_id", vendors, "nation_id")
    got = {(r.vendor_id, r.chunk): (r.nation_id, [*memoryview(r.history).cast("q")], r.v9) for r in out.collect()}
    assert got == {(5, 2): (2, [0] * 10, 1), (5, 7): (2, [1] * 10, 10), (None, 2): (None, [0] * 10, 3), (8, 1): (None, [0] * 10, 0)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
