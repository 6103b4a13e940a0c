"""Elements: HTML extraction, table formatting with and without HTML, missing page, filters."""

from pyspark.sql import functions as F

from ragtide.operators import elements as E

HTML = ("<html><head><title>T &amp; co</title><script>var t='</p>';</script><style>p{}</style></head><body>"
        "<nav><ul><li><a href='/a'>Home</a></li><li>About</li></ul></nav><!-- ad -->"
        "<h1>Head</h1><p>one <b>bold</b><br><p>two</p><ul><li>item</li></ul>"
        "<table><tr><td>c</td></tr></table><footer>foot</footer></body></html>")


def test_extract(spark):
    df = spark.createDataFrame([(1, HTML)], "page_id long, html string")
    got = [(r["category"], r["text"]) for r in E.extract_elements(df).orderBy("pos").collect()]
    assert got == [("Title", "T & co"), ("Header", "Home"), ("Header", "About"), ("Title", "Head"),
                   ("NarrativeText", "one bold"), ("NarrativeText", "two"), ("ListItem", "item"),
                   ("Table", "c"), ("Footer", "foot")]


def test_no_visible_text_is_lost(spark):
    html = ("loose <P>Upper</P> after <h4>Four</h4><div>in div <b>bold</b></div><pre>code</pre>"
            "<TABLE><tr><td>a</td><td>b</td></tr></TABLE>tail<section>sec<p>para</section>end")
    df = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "only text")], "page_id long, html string")
    rows = E.extract_elements(df).orderBy("doc", "pos").collect()
    assert [(r["category"], r["text"]) for r in rows if r["doc"] == 1] == [
        ("Uncategorized", "loose"), ("NarrativeText", "Upper"), ("Uncategorized", "after"), ("Title", "Four"),
        ("Uncategorized", "in div bold"), ("Uncategorized", "code"), ("Table", "a b"), ("Uncategorized", "tail"),
        ("Uncategorized", "sec"), ("NarrativeText", "para"), ("Uncategorized", "end")]
    assert [(r["doc"], r["text"]) for r in rows if r["doc"] > 1] == [(4, "only text")]


def test_format_table_and_page(spark):
    el = spark.createDataFrame(
        [("d", 1, "Table", 3, "cell text", "<table>x</table>"), ("d", 2, "Table", None, "cell text", None),
         ("d", 3, "Title", None, "Intro", None), ("d", 4, "Footer", 1, "f", None), ("d", 5, None, 1, "n", None)],
        "doc string, pos int, category string, page int, text string, html string")
    f = {r["pos"]: r["formatted"] for r in E.format_elements(el).collect()}
    assert f[1] == "\n=== TABLE (page 3) ===\n<table>x</table>"
    assert f[2] == "\n=== TABLE (page N/A) ===\ncell text"
    assert f[3] == "\n[Title] (page N/A)\nIntro\n"
    assert f[4] is None and f[5] is None
    assert sorted(r["pos"] for r in E.filter_deny(el).collect()) == [1, 2, 3, 5]  # NULL category kept
    assert sorted(r["pos"] for r in E.filter_allow(el).collect()) == [1, 2, 3]
    plain = E.assemble_documents(el, style="plain").first()["text"]
    assert plain == "=== TABLE ===\n<table>x</table>\n\n=== TABLE ===\ncell text\n\nIntro\n\nn"


def test_tagged_round_trip(spark):
    docs = spark.createDataFrame([(7, "alpha\nbeta\ngamma\ndelta\neps\nzeta\neta")], "doc_id long, text string")
    els = E.parse_tagged(E.tagged_corpus(docs)).orderBy("pos").collect()
    assert [r["text"] for r in els] == ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]
    assert [r["category"] for r in els][:5] == ["Title", "NarrativeText", "ListItem", "Table", "Footer"]
    assert els[6]["page"] is None and els[0]["page"] == 1


def test_furniture_is_what_a_site_repeats(spark):
    rows = []
    for page in range(12):
        site = "big" if page < 8 else "small"
        rows += [(page, 0, "NarrativeText", "Skip to CONTENT!"), (page, 1, "Title", f"Story {chr(97 + page)}"), (page, 2, "NarrativeText", "shared once" if page == 1 else f"text {chr(97 + page)}"),
                 (page, 3, "NarrativeText", f"All rights reserved {page}"), (page, 4, "Uncategorized", "1 2 3")]
    el = spark.createDataFrame([(d, p, c, t, None, None) for d, p, c, t in rows], "doc int, pos int, category string, text string, page int, html string")
    sites = spark.createDataFrame([(p, "big" if p < 8 else "small" if p < 11 else None) for p in range(12)], "doc int, site string")
    got = {(r.doc, r.pos): r.category for r in E.furniture(el, sites).collect()}
    assert len(got) == len(rows)
    for d, p, c, _ in rows:
        want = {0: "Header", 3: "Footer"}.get(p, c) if d < 8 else c  # the small site has fewer than five pages
        assert got[d, p] == want, (d, p)
