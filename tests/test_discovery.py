"""The cascade of source discovery, with responses and expected rows written by hand."""

from pyspark.sql import functions as F

from quillstream.sources import discovery as D
from quillstream.sources import dom

FEED = "<rss><channel>{}</channel></rss>"
GOOD = FEED.format("<item><title>One</title><link>https://x.example/1</link></item>")
POOR = FEED.format("<item><title>Only one</title><link>https://x.example/1</link></item>" + "<item><title>No link</title></item>" * 9)
CAPTURED = "url string, final_url string, http_status int, content_type string, body string"


def found(spark, responses: dict, *urls):
    rows = [(u, r[3] if len(r) > 3 else u, r[0], r[1], r[2]) for u, r in responses.items()]
    requests = spark.createDataFrame(list(enumerate(urls)), "source_id long, url string")
    out = D.discover(requests, spark.createDataFrame(rows, CAPTURED)).collect()
    assert sorted(r.source_id for r in out) == list(range(len(urls)))
    assert all(tuple(r.asDict()) == D.RESULT for r in out)
    return [next(r for r in out if r.source_id == i) for i in range(len(urls))]


def test_repositories(spark):
    given = {
        "https://github.com/a-b/c.d": "a-b/c.d", "https://www.github.com/a/b.git": "a/b", "https://github.com/a/b/Releases": "a/b", "https://github.com/a/b/issues": None, "https://github.com/a": None, "https://github.com/a/b?x=1": None,
        "https://github.com/-a/b": None, "https://github.com/a--b/c": None, "https://github.com/Settings/b": None, "https://github.com/a/..": None, f"https://github.com/{'a' * 39}/b": "a" * 39 + "/b", f"https://github.com/{'a' * 40}/b": None,
    }
    rows = spark.createDataFrame([(u,) for u in given], "u string").select("u", D.repository_page(F.col("u")).alias("r"))
    assert {r.u: r.r for r in rows.collect()} == given


def test_order_of_the_cascade(spark):
    page = '<html><link rel=alternate type=application/rss+xml href="{}"><ul class=news-list><li><a href=/1>Item one</a><li><a href=/2>Item two</a></ul>'
    got = found(
        spark,
        {
            "https://a.example/": (200, "text/html", page.format("https://f.example/feed")), "https://f.example/feed": (200, None, GOOD), "https://a.example/rss": (200, None, GOOD),
            "https://b.example/": (200, "text/html", page.format("/none")), "https://b.example/atom.xml": (200, None, GOOD, "https://b.example/real/"), "https://b.example/feed": (200, None, POOR),
            "https://c.example/": (200, None, page.format("/c")), "https://c.example/c": (500, "application/rss+xml", GOOD), "https://d.example/f": (200, None, GOOD), "https://e.example/f": (200, "application/rss+xml", POOR),
            "https://g.example/": (403, None, GOOD), "https://h.example/": (500, None, GOOD),
        },
        "https://a.example", "https://b.example/", "https://c.example/", "https://d.example/f?utm_source=z", "https://e.example/f", "https://g.example", "https://h.example", "https://i.example", "mailto:x", None,
    )
    assert [(r.collector, r.status, r.url, r.confidence) for r in got] == [
        ("rss", "ready", "https://f.example/feed", 0.92), ("rss", "ready", "https://b.example/real", 0.92), ("html_list", "partial", "https://c.example/", 0.76), ("rss", "ready", "https://d.example/f", 0.98),
        ("custom", "needs_custom_collector", "https://e.example/f", 0.0), ("custom", "blocked", "https://g.example/", 0.0), ("custom", "unreachable", "https://h.example/", 0.0), ("custom", "unreachable", "https://i.example/", 0.0),
        ("custom", "unreachable", "mailto:x", 0.0), ("custom", "unreachable", None, 0.0),
    ]


def test_four_linked_feeds_at_most(spark):
    links = "".join(f"<link rel='alternate feed' type='application/atom+xml' href='{i}'>" for i in (0, 0, 1, 2, 3, 4))
    page = {"https://a.example/": (200, "text/html", links)}
    fourth, fifth = ({**page, f"https://a.example/{i}": (200, None, GOOD)} for i in (3, 4))
    assert found(spark, fourth, "https://a.example/")[0].url == "https://a.example/3"
    assert found(spark, fifth, "https://a.example/")[0].collector == "custom"


LINK = "<a href='/n/{0}'>Story no {0}</a>"
ROWS = "".join(f"<li>{LINK.format(i)}</li>" for i in range(6))


STRUCTURES = [
    (f"<ul class=post-list>{ROWS}</ul><ul class=article-list>{ROWS[:90]}</ul>", ("html_list", "partial", ".article-list li", None, 2)),
    (f"<ul class=news-list>{ROWS}</ul>", ("html_list", "ready", ".news-list li", None, 6)),
    ("<h3><a href=/1>Same title</a></h3><h3><a href=/2>SAME title</a></h3><h3>none</h3>", ("custom", "needs_custom_collector", None, None, 0)),
    ("<h3><a href=/1>Title one</a></h3><h3><a href=/2>Title two</a></h3><h3>none</h3>", ("html_list", "partial", "h3", None, 2)),
    (f"<footer><ul class=news-list>{ROWS}</ul></footer>", ("custom", "needs_custom_collector", None, None, 0)),
    (f"<div class='x Sidebar-2'><ul class=news-list>{ROWS}</ul></div>", ("custom", "needs_custom_collector", None, None, 0)),
    (ROWS + "<a href=/about/x>All about it</a><a href=/q/1>Other</a>", ("html_list", "partial", None, "/n/", 6)),
    (LINK.format(1) + LINK.format(2) + LINK.format(3) + "<a href=/a/1>Other one</a><a href=/b/1>Other two</a><a href=/>Start page</a>", ("custom", "needs_custom_collector", None, None, 0)),
    ("", ("custom", "needs_custom_collector", None, None, 0)),
]


def test_structures(spark):
    sites = [f"https://s{i}.example/" for i in range(len(STRUCTURES))]
    got = found(spark, {u: (200, "text/html", body) for u, (body, _) in zip(sites, STRUCTURES, strict=True)}, *sites)
    assert [(r.collector, r.status, r.selector, r.prefix, r.found) for r in got] == [want for _, want in STRUCTURES]


def test_empty_tables_and_repeats(spark):
    none = spark.createDataFrame([], CAPTURED)
    assert D.discover(spark.createDataFrame([], "source_id long, url string"), none).collect() == []
    rows = spark.createDataFrame([("https://a.example/f", "https://a.example/f", 200, None, GOOD)] * 3, CAPTURED)
    got = D.discover(spark.createDataFrame([(7, "https://a.example/f"), (8, "https://a.example/f")], "source_id long, url string"), rows).collect()
    assert sorted((r.source_id, r.collector) for r in got) == [(7, "rss"), (8, "rss")]


def test_selector_of_one_word(spark):
    nodes = dom.nodes(spark.createDataFrame([(1, "<a rel='x y'>1</a><a rel=xy>2</a><a>3</a>")], "page long, html string"))
    assert [r.pre for r in dom.matches(nodes, "a[rel~=y]").collect()] == [0]
