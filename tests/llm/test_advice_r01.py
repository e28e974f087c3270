"""What the first review found missing, each against the whole job."""

import numpy as np

from cityfeed.llm import decontaminate, line_dedup, near_dedup, url_filter


def test_boilerplate_of_several_lines_goes(spark, docs):
    footer = ["All rights reserved by the publisher", "Read our privacy policy before use", "Contact the editors by post only"]
    alone = "Please enable cookies in your browser"
    rows = [(k, "\n".join([f"page {k} has words", "", alone, "", f"and page {k} ends", *footer]), f"site{k}") for k in range(9)]
    rows += [(100 + k, f"a document copied whole\nto all of the nine sites {k // 9}", f"site{k}") for k in range(9)]
    out = {r.doc_id: r.text for r in line_dedup.clean(docs(rows)).collect()}
    assert all(out[k] == f"page {k} has words\n\n\nand page {k} ends" for k in range(9))
    assert all(out[r[0]] == r[1] for r in rows[9:])


def test_blocks_keep_every_row(spark, docs):
    words = [f"w{k}" for k in range(40)]
    bench = spark.createDataFrame([(k, " ".join(words[k : k + 12])) for k in range(0, 28, 7)], "item_id long, text string")
    df = docs([(1, "x " + " ".join(words)), (1, "x " + " ".join(words)), (1, "clean"), (None, " ".join(words[:12])), (None, None), (None, "no hit")])
    rows = lambda size: sorted(map(str, decontaminate.contaminated_words(df, bench, block_nodes=size).collect()))
    assert len(rows(1 << 20)) == 6 and rows(30) == rows(1 << 20)


def test_links_of_every_form(spark):
    link = '<link href="{}" rel="{}">'.format
    site = "http://a.net/x/y/p?q=1"
    forms = {
        "page": "http://a.net/x/y/page", "../z": "http://a.net/x/z", "./": "http://a.net/x/y/", "..": "http://a.net/x/", "../../../r?k=..": "http://a.net/r?k=..",
        "?id=1": "http://a.net/x/y/p?id=1", "/top": "http://a.net/top", "//b.net/c": "http://b.net/c", "https://b.net/c": "https://b.net/c", "#part": None, "mailto:x@b.net": None,
    }
    pages = [(k, site, link(t, "canonical")) for k, t in enumerate(forms)]
    edges = lambda rows: sorted(r.dst for r in url_filter.page_edges(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert edges(pages) == sorted(x for x in forms.values() if x)
    assert edges([(1, "http://h.net", link("page", "canonical"))]) == ["http://h.net/page"]
    assert edges([(1, site, link("/c", "alternate canonical")), (2, site, link("/d", "non-canonical"))]) == ["http://a.net/c"]
    assert edges([(1, site, """<meta http-equiv="refresh" content="0; url='https://x/'">""")]) == ["https://x/"]


def test_short_texts_always_meet():
    rng = np.random.default_rng(1)
    for _ in range(500):
        s = rng.integers(1, 1 << 63, 5, np.uint64)
        for t in (s[1:], s[:-1], np.delete(s, 2)):
            keys = [set(near_dedup.picks(x).tolist() + near_dedup.short_keys(x)) for x in (s, t)]
            assert near_dedup.Aligner(s).similarity(t) == 0.8 and keys[0] & keys[1]


def test_sketch_holds_short_keys(spark, docs):
    words = "one two three four five six seven eight nine"
    a, b = (r["keys"] for r in near_dedup.sketch(docs([(1, words), (2, words[: words.rindex(" ")])])).orderBy("doc_id").collect())
    assert len(a) == near_dedup.BANDS + 6 and len(b) == near_dedup.BANDS + 1 and b[-1] in a[near_dedup.BANDS :]
