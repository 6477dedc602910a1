"""The HTML reader: selectors, broken nesting, quoted markup; well-formed pages against an XML parser."""

import xml.etree.ElementTree as ET

import numpy as np
import pytest

from siltstone.sources import html
from siltstone.sources.html import Rule


def read(page, *rules):
    return html.Reader([(r, html.selectors(r.select)) for r in rules]).read(page)


def one(page, select, take="all", least=0):
    return read(page, Rule("x", select, take, least))[0]


PAGE = """<!doctype html><html lang=fr><head><title>A &amp; B - Site</title><script>if (a < b) document.write("<p class='x'>no</p>")</script></head>
<body class="page wide"><!-- <p>no</p> --><div class='decision-content main' data-note="a > b <p>"><p>One <b>bold</b> word.<p>Two<br>lines &eacute;&#33;</div>
<ul id=menu><li>first<li>second <ul><li>inner</ul><li>third</ul><p class=x>Last</body>"""


@pytest.mark.parametrize(
    "select,want",
    [
        ("p", ["One bold word.", "Two\nlines é!", "Last"]), ("div.decision-content p", ["One bold word.", "Two\nlines é!"]), ("div.main.decision-content > p", ["One bold word.", "Two\nlines é!"]),
        ("body > p", ["Last"]), ("html > p", []), ("p.x", ["Last"]), (".missing", []), ("#menu > li", ["first", "second inner", "third"]), ("#menu li", ["first", "second inner", "inner", "third"]),
        ("[class*=decision] b, title", ["A & B - Site", "bold"]), ("[data-note] b", ["bold"]), ("[data-note='a > b <p>'] b", None), ("[lang=fr] > head title", ["A & B - Site"]), ("*.x", ["Last"]), ("[class^=dec] b", ["bold"]), ("[class$=main] b", ["bold"]),
    ],
)
def test_selectors(select, want):
    if want is None:
        with pytest.raises(ValueError):
            one(PAGE, select)
    else:
        assert one(PAGE, select) == want


def test_takes():
    assert one(PAGE, "h1 | title | p", "first") == "A & B - Site" and one(PAGE, "title | p", "first", least=13) == "One bold word."
    assert one(PAGE, "p, title", "first") == "A & B - Site" and one(PAGE, "h1", "first") is None and one(PAGE, "li", "count") == 4
    assert one(PAGE, "html", "attr:lang") == "fr" and one(PAGE, "body", "attr:none") is None and one("", "p", "count") == 0
    assert one(PAGE, "script", "first") == ""
    for bad in ("", "p >", "p..x", "p:first"):
        with pytest.raises(ValueError):
            html.selectors(bad)


def test_broken_nesting():
    assert one("<div><b>a<i>b</b>c</i></div>d", "b") == ["ab"] and one("<div><b>a<i>b</b>c</i></div>d", "div") == ["abc"]
    assert one("</p></div><p>a</span>b", "p") == ["ab"]
    assert one("<table><tr><td>1<td>2<tr><td>3<table><tr><td>4</table></table>", "td") == ["1", "2", "34", "4"]
    assert one("<p>a<div>b</div>c", "p") == ["a"] and one("<dl><dt>k<dd>v<dt>l<dd>w</dl>", "dd") == ["v", "w"]
    assert one("<p>" * 3000 + "x", "p")[-1] == "x" and one("<div>" * 900 + "x", "div div")[-1] == "x"
    assert one("<p title='unclosed", "p") in ([], [""]) and one("<a href='x>y'>t</a>", "a") == ["t"]


def test_equals_an_xml_parser_on_well_formed_pages():
    rng = np.random.default_rng(4)
    tags, classes = ["div", "section", "span", "em", "h1"], ["a", "b", "c"]

    def grow(depth):
        tag = tags[rng.integers(len(tags))]
        inside = "".join(grow(depth - 1) if depth and rng.random() < 0.6 else f"w{rng.integers(1000)} &amp; " for _ in range(rng.integers(1, 4)))
        return f'<{tag} class="{classes[rng.integers(3)]} z">{inside}</{tag}>'

    for _ in range(60):
        page = f"<html><body>{''.join(grow(4) for _ in range(4))}</body></html>"
        tree = ET.fromstring(page)
        for tag in tags:
            assert one(page, tag) == ["".join(e.itertext()).strip() for e in tree.iter(tag)]
        assert one(page, "div.a span") == ["".join(e.itertext()).strip() for e in tree.iter("span") if any(e is x for d in tree.iter("div") if d.get("class") == "a z" for x in d.iter("span"))]


DECISION = '<h1 class="title"> Title </h1><div class="decision-date">05/11/2021</div><div class="juridiction">Court</div><div class="decision-content"><p>One.</p><span>no</span><p> Two. </p></div>'


def test_records(spark):
    article = DECISION.replace("decision-", "article-")
    pages = [("https://x/dec/77", DECISION), ("https://x/dec/78", DECISION.replace("juridiction", "none")), ("https://x/dec/79", DECISION.replace("05/11", "45/11")), ("https://x/a", f'<article id="L1">{article}</article>'), ("https://x/b", f"<article>{article}</article>"), ("https://x/c", article), ("u", None), ("u", "")]
    df = spark.createDataFrame([(*p, "kept") for p in pages], "url string, html string, titre string")
    assert [tuple(r) for r in html.decisions(df).collect()] == [("77", "Title", "One. Two.", "2021-11-05", "Court", "jurica", "https://x/dec/77")]
    assert sorted(tuple(r) for r in html.articles(df).collect()) == [("", "Title", "One. Two.", "2021-11-05", "legifrance", "https://x/b"), ("L1", "Title", "One. Two.", "2021-11-05", "legifrance", "https://x/a")]


def test_journal(spark):
    body = "<p>" + "Texte de loi. " * 10 + "</p>"
    url = "https://x/Journaux/2019/Journal-8412/Loi-n-1-du-2"
    pages = [(url, f'<title>Page - Site</title><h1>Short</h1><h2>Une longue rubrique</h2><span class="pub-date">3 février 2020</span><div class="breadcrumbs">A\nB</div>{body}'), (url + "/", f"<title>Page - Site</title>{body}"), (url, f"<h1>Erreur 404</h1>{body}"), (url, "<p>court</p>"), (url, None)]
    rows = html.journal(spark.createDataFrame([(u, f"<body>{h}</body>" if h else None) for u, h in pages], "url string, html string")).collect()
    assert sorted((r.id, r.titre, r.date, r.category, r.journal_numero) for r in rows) == [("JDM-8412-Loi-n-1-du-2", "Page", "2019", "", "8412"), ("JDM-8412-Loi-n-1-du-2", "Une longue rubrique", "2020-02-03", "A > B", "8412")]


def test_other_columns_pass(spark):
    df = spark.createDataFrame([(1, "<p>a</p>", "x", 2.0), (2, None, None, None)], "id long, html string, n string, `odd name` double")
    r = html.records(df, "html", [Rule("n", "p", "count"), Rule("all", "p", "all"), Rule("first", "p")])
    assert r.columns == ["id", "odd name", "n", "all", "first"]
    assert sorted(tuple(x) for x in r.collect()) == [(1, 2.0, 1, ["a"], "a"), (2, None, 0, [], None)]
    assert html.records(df.limit(0), "html", [Rule("n", "p", "count")]).count() == 0


def test_only_named_references_are_read():
    page = "<title>A &amp; &amp;lt; &eacute; &#33; B&amp</title><a href='?a&lt;b&amp'>x & y</a>"
    reader = html.Reader([(r, html.selectors(r.select)) for r in (Rule("t", "title"), Rule("a", "a"), Rule("h", "a", "attr:href"))])
    assert reader.read(page) == ["A & &lt; é ! B&", "x & y", "?a<b&"]
    assert reader.read(page, frozenset(["amp", "lt"])) == ["A & &lt; &eacute; &#33; B&amp", "x & y", "?a<b&amp"]


def test_fields_of_cut_references_equal_sql(spark, tmp_path):
    """A title may be cut off within a character reference; the SQL of page_fields leaves it as it is written."""
    import duckdb

    from siltstone.plans.catalog import ORACLE, QUERIES

    page = '<!DOCTYPE html><html lang="en"><head><title>{0}</title></head><body><nav><ul><li><a href="/a">a</a></li></ul></nav><article><h1>{0}</h1><p>one {0}</p></article></body></html>'
    rows = [(i, "http://x/y", page.format(t)) for i, t in enumerate(["R&amp;D &amp", "A &lt;b&gt; &am", "&copy; B &quot", "&amp;&ampx", "C &#39;"])]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, QUERIES["page_fields"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == sorted(con.execute(ORACLE["page_fields"]).fetchall())
