"""Queries against their SQL in DuckDB, and the pipeline."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from cityfeed.llm.queries import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for p in glob.glob(D + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got = entry.queries()[name](spark, D).toPandas()
    want = con.execute(ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda df: sorted(str(tuple(None if v is None or v != v else v.item() if hasattr(v, "item") else v for v in r)) for r in df[cols].itertuples(index=False, name=None))
    assert rows(got) == rows(want)


def test_url_links_against_sql(spark, tmp_path):
    """Links of every form, chains, cycles and a conflict, judged by both."""
    link, jump = '<link rel="{}" href="{}">'.format, '<meta http-equiv="refresh" content="0; url={}">'.format
    targets = ["page", "../z", "./", "..", "../../../r?k=..", "?id=1", "/top/../x", "//b.net/c", "https://b.net/c", "#part", "mailto:x@b.net", "", "a?x=1&amp;y=2", "..", "/", "/es/2", "http://example.org/es/1"]
    rows = [(k, f"http://a.net/x/y/p{k}?q=1", link("alternate canonical", t)) for k, t in enumerate(targets)]
    rows += [(50, "http://a.net/a?x=1&y=2", jump("'http://www.example.com/de/5'")), (51, "http://h.net", link("canonical", "x") + link("canonical", "http://h.net/y") + jump("/z"))]
    rows += [(60 + k, f"http://c.net/{k}", jump(f"/{(k + 1) % 4}")) for k in range(4)] + [(64, "http://c.net/9", link("canonical", "2") + link("canonical", "http://example.org/en/1"))]
    rows += [(70, "http://h.net/y", link("canonical", "http://www.example.com/de/1")), (71, "http://www.example.com/de/1", link("canonical", "http://e.org/ok")), (72, "http://h.net/z", None), (73, None, link("canonical", "x")), (74, "http://c.net/3#p", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    cols = ["page_id", "host", "path", "rule", "verdict", "by_alias"]
    got = sorted((tuple(r) for r in entry.queries()["op7_url_filters"](spark, str(tmp_path)).select(*cols).collect()), key=str)
    want = sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL['op7_url_filters']})").fetchall(), key=str)
    assert got == want
    verdicts = {r[0]: r[4] for r in got}
    # a cycle with a link to a blocked page; a chain whose end is linked to an allowed one
    assert [verdicts[k] for k in (60, 61, 62, 63, 64, 74)] == ["block"] * 6
    assert [verdicts[k] for k in (51, 70, 71, 72)] == ["allow", "allow", "block", "allow"]


def test_names():
    numbers = {int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")}
    assert numbers == set(range(1, 14)) and "pipeline" in QUERIES


def test_pipeline_stages(spark):
    docs = spark.read.parquet(D + "/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, D).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept <= ids and len(kept) > 0.5 * len(ids)
        ids = kept
    out = corpus_pipeline.run(spark, D).collect()
    assert {r.doc_id for r in out} == ids
