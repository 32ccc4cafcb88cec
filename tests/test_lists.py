"""Pages as tables of nodes: selectors, dates, hubs and walks on awkward markup, with expected rows written by hand."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillstream.sources import dom
from quillstream.sources import lists as L


def pages(spark, *bodies, url="https://h.example/list/"):
    return spark.createDataFrame([(i, url, b) for i, b in enumerate(bodies)], "page long, url string, html string")


def test_tree_of_unclosed_and_crossing_tags():
    rows = dom.parse("<ul><li>a<li>b <b>c<p>d<div>e</div></ul>f<br/>g</nothing><table><tr><td>1<td>2<tr><td>3")
    tags = [(r[4] or r[6], r[2]) for r in rows]
    assert tags == [("ul", None), ("li", 0), ("a", 1), ("li", 0), ("b", 3), ("b", 3), ("c", 5), ("p", 5), ("d", 7), ("div", 5), ("e", 9), ("f", None), ("br", None), ("g", None), ("table", None), ("tr", 14), ("td", 15), ("1", 16), ("td", 15), ("2", 18), ("tr", 14), ("td", 20), ("3", 21)]
    for pre, post, *_ in rows:
        assert pre <= post < len(rows)
    assert dom.parse(None) == [] and dom.parse("<!-- <a> -->") == [] and [r[6] for r in dom.parse("<p>a&amp;b &lt;i&gt; ​ x</p>")][1:] == ["a&b <i> x"]


@pytest.mark.parametrize(
    "selector,want",
    [
        ("a", ["1", "2", "3", "4"]), (".x", ["1", "3"]), ("a.x.y", ["3"]), ("#main a", ["2", "3"]), ("div > a", ["2"]), ("div>p>a", ["3"]), ("a[href]", ["1", "3", "4"]), ("a[href^='/q']", ["3"]), ('a[href$="z"]', ["4"]),
        ("a[data-k=v]", ["2"]), ("a[href*=','], .y", ["3", "4"]), ("div *", ["2", "3", None]), ("section a", []), ("#main p a, div > a", ["2", "3"]),
    ],
)
def test_selectors(spark, selector, want):
    html = "<a class=x href=/>1</a><div id=main><a data-k='v'>2</a><p><a class='y  x' href='/q?a'>3</a></p></div><a href='/a,z'>4</a>"
    nodes = dom.nodes(pages(spark, html))
    found = dom.matches(nodes, selector).select("page", "pre", "post", "tag")
    own = {r.pre: r.text for r in dom.texts(found.filter("tag = 'a'"), nodes).collect()}
    assert sorted((own.get(r.pre) for r in found.collect()), key=str) == sorted(want, key=str)


def test_bad_selectors(spark):
    nodes = dom.nodes(pages(spark, "<p>"))
    for bad in ("a:hover", "a >", "", "[", "a..b"):
        with pytest.raises((ValueError, IndexError)):
            dom.matches(nodes, bad or "!").collect()


def test_selector_items(spark):
    html = """<body><span class=day>1999-09-09</span><main><h2 class=day>2024-01-02</h2>
    <div class=group><h2 class=day>2024-02-03</h2><p class=it><a href=/a?utm_source=1>First of all</a></p><p class=it><i class=t>Second one</i> <a href='b'>more</a> <time>2 days ago</time></p></div>
    <div class=group><p class=it><a href=/a>First again</a></p><p class=it><i class=t>No link here</i></p><p class=it><a href=/c.pdf>An asset</a></p><p class=it><a href=https://o.example/d>Elsewhere</a></p><p class=it><a href=/e>登录 here</a></p><p class=it><a href=/f>x</a></p></div>
    <a class=it href=/g>Itself a link<em class=s>short</em></a></main>
    <script>var data = [{"name":"No link here","k":1,"id":77}]</script></body>"""
    c = L.config({"discovery": {"mode": "selectors"}, "extraction": {"item_selector": ".it", "title_selector": ".t", "date_selector": "time", "ancestor_date_selector": ".day", "summary_selector": "em.s", "embedded_title_key": "name", "embedded_link_key": "id", "embedded_link_template": "https://h.example/n/{value}"}})
    at = datetime(2024, 5, 5, 12)
    rows = L.selector_items(pages(spark, html).withColumn("collected_at", F.lit(at)), c).orderBy("pos").collect()
    got = [(r.title, r.url, r.published_at, r.summary) for r in rows]
    assert got == [
        ("First of all", "https://h.example/a", datetime(2024, 2, 3), None), ("Second one", "https://h.example/list/b", datetime(2024, 5, 3, 12), None), ("First again", "https://h.example/a", datetime(2024, 1, 2), None),
        ("No link here", "https://h.example/n/77", datetime(2024, 1, 2), None), ("Itself a link short", "https://h.example/g", datetime(2024, 1, 2), "short"),
    ]
    assert len(L.selector_items(pages(spark, html), L.config({"discovery": {"mode": "selectors", "max_items": 2}, "extraction": {"item_selector": ".it"}})).collect()) == 2


def test_link_items(spark):
    html = """<ul><li>2024年1月2日 <a href=/1>News of one</a><div class=desc>What this is all about</div></li><li><div>2024/3/4 <b><a href=/2>News of two</a></b></div></li>
    <li>1999-01-01<div><div><div><a href=/3>News too far from its date</a></div></div></div></li><li><a href=/4>News of four 2020.1.2 and 2021.1.1</a><p>News of four 2020.1.2 and 2021.1.1</p></li><li><a>News without address</a></li><li><a href=//sub.h.example/5>News below</a></li></ul>"""
    rows = L.link_items(pages(spark, html, "", None), L.config({"discovery": {"include_text": ["NEWS"]}, "allow_subdomains": True})).orderBy("pos").collect()
    assert [(r.title, r.time_text, r.summary) for r in rows] == [
        ("News of one", "2024年1月2日", "What this is all about"), ("News of two", "2024/3/4", None), ("News too far from its date", None, None), ("News of four 2020.1.2 and 2021.1.1", "2020.1.2", None), ("News below", "2024年1月2日", None)
    ]
    assert [r.link_type for r in rows] == ["same_site"] * 4 + ["external"]


def test_config_bounds():
    c = L.config({"max_items": 5, "discovery": {"max_pages": 500, "max_depth": -1, "max_items": True, "include_text": "no list"}, "extraction": {"title_selector": "  "}, "allowed_domains": [".H.example", 3]})
    assert (c.max_pages, c.max_depth, c.max_items, c.include_text, c.title_selector, c.allowed_domains, c.exclude_text) == (100, 0, 5, (), None, ("h.example",), L.EXCLUDED)
    with pytest.raises(ValueError):
        L.config({"mode": "guess"})
    with pytest.raises(ValueError):
        L.config({"mode": "selectors"})


def test_document_hub(spark):
    html = """<div class=r><h2>The report</h2><a href=/r1>r</a><ul><li class=c><h3>Case one</h3><a href=/c1>c</a><li class=c><h3>abc</h3><a href=/c2>too short</a><li class=c><h3>Case three</h3><a href=/c3>c</a></ul></div>
    <div class=r><h2>No link to it</h2><li class=c><h3>Case of none</h3></li></div><li class=c><h3>Case outside</h3><a href=/c5>c</a></li><div class=r><h2>The report</h2><a href=/r2>again</a></div>"""
    s = {"report_item": ".r", "case_item": ".c", "report_title": "h2", "report_link": "a", "case_title": "h3", "case_link": "a"}
    rows = L.document_hub(pages(spark, html), s).orderBy("pos").collect()
    assert [(r.pos, r.record_kind, r.title, r.url[-2:]) for r in rows] == [(1, "report", "The report", "r1"), (2, "case", "Case one", "c1"), (3, "case", "Case three", "c3"), (4, "report", "The report", "r2")]
    assert rows[1].parent_fingerprint == rows[0].fingerprint and rows[0].parent_fingerprint is None and len(rows[0].fingerprint) == 64
    assert L.document_hub(pages(spark, html), s, max_items=2).count() == 2 and L.document_hub(pages(spark), s).count() == 0


def test_paged_posts_stop(spark):
    post = lambda i, **k: '{"aid":"%s","article_title":"T%s"%s}' % (i, i, "".join(f',"{n}":{v}' for n, v in k.items()))
    full = [post(i, publish_time=1700000000000 + i) for i in range(20)]
    body = lambda posts, code=0: '{"code":%d,"data":[%s]}' % (code, ",".join(posts))
    rows = [
        (1, 1, body(full)), (1, 2, body([post(20), post(3), post(21, sub_type=2), post(22, is_promotion="true"), post(23, topic='[{"name":"直播"}]'), post("24", sub_type='"x"')])), (1, 3, body([post(99)])),
        (2, 1, body(full)), (2, 2, body(full, 7)), (2, 3, body([post(98)])), (3, 1, "no json"), (3, 2, body(full)), (4, 2, body(full)), (5, 1, body([])),
    ]
    got = L.paged_posts(spark.createDataFrame(rows, "source_id int, number int, body string"), "https://p.example/article/", max_items=100).orderBy("source_id", "pos").collect()
    assert [r.aid for r in got if r.source_id == 1] == [*map(str, range(20)), "20", "24"] and [r.aid for r in got if r.source_id == 2] == [*map(str, range(20))] and {r.source_id for r in got} == {1, 2}
    assert got[0].published_at == datetime(2023, 11, 14, 22, 13, 20) and got[0].url == "https://p.example/article/0"
    assert L.paged_posts(spark.createDataFrame(rows, "source_id int, number int, body string"), "https://p.example/", max_pages=1, max_items=3).filter("source_id = 1").count() == 3


def test_changelog_rows(spark):
    html = """<table><tr><td>Before any year</td><td>x</td><td>3月1日</td></tr></table><h2>2022年</h2><table><tr><th>Model A</th><td>发布</td><td>3月1日</td></tr><tr><td>Model A</td><td>发布</td><td>3月1日</td></tr><tr><td>Model B</td><td></td><td>2021-12-30</td><td>It is good; and more</td></tr><tr><td>Draft of C</td><td>x</td></tr></table>
    <h2>2020年</h2><table><tr><td>Model A</td><td>发布</td><td>03-01</td><td></td><td><a href=" /d ">d</a></td></tr></table>"""
    c = L.ChangelogConfig("h2", "tr", entry_title_cells=(0, 1), entry_date_cell=2, entry_summary_cell=3, entry_link_cell=4, exclude_entry_terms=("draft",), append_summary_when_title_lacks_action=True, entry_title_replacements={"Model": "M"})
    rows = L.dated_entries(pages(spark, html), c).orderBy("pos").collect()
    assert [(r.title, r.published_at, r.time_text, r.detail_link) for r in rows] == [
        ("Before any year — x", None, "3月1日", None), ("M A — 发布", datetime(2022, 3, 1), "3月1日", None), ("M B：It is good", datetime(2021, 12, 30), "2021-12-30", None), ("M A — 发布", datetime(2020, 3, 1), "03-01", "/d"),
    ]
    assert len({r.key for r in rows}) == 4 and rows[1].url == f"https://h.example/list?entry={rows[1].key}"


def test_walk_bounds(spark):
    items = spark.createDataFrame([(1, "a", i, f"i{i % 4}") for i in range(6)] + [(1, "b", 0, "i9"), (1, "c", 0, "i8"), (2, "a", 0, "z")], "source_id long, page_url string, pos int, url string")
    links = spark.createDataFrame([(1, "a", 0, "b"), (1, "a", 1, "c"), (1, "b", 0, "a")], "source_id long, page_url string, pos int, next_url string")
    starts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "source_id long, url string")
    run = lambda *b: {(r.source_id, r.url) for r in L.walk(items, links, starts, *b).collect()}
    assert run(10, 1, 100) == {(1, "i0"), (1, "i1"), (1, "i2"), (1, "i3"), (1, "i9"), (1, "i8"), (2, "z")}
    assert run(2, 1, 100) == run(10, 1, 100) - {(1, "i8")} and run(10, 0, 100) == {(1, "i0"), (1, "i1"), (1, "i2"), (1, "i3"), (2, "z")}
    assert run(10, 1, 5) == {(1, "i0"), (1, "i1"), (1, "i2"), (1, "i3"), (1, "i9"), (2, "z")} and run(10, 1, 2) == {(1, "i0"), (1, "i1"), (2, "z")}
