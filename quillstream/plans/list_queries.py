"""Lists of items on pages (SRC-2, 4, 6, 9, 11, 19, 20, 21, FN-29): pages of twenty items each, made awkward by id.

Unclosed tags, references, items without a link, dates inside, beside and above, foreign and asset addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import lists as L
from . import fixtures as X
from .registry import query
from .scan_queries import _BASE, _DAY, _ID, _id, _page, _text

_SITE = "https://host.example"
_NTH = lambda m: (F.col("id") % m).cast("string")
_is = lambda m, *k: (F.col("id") % m).isin(*k)


def _case(*pairs, otherwise=""):
    out = F.when(pairs[0][0], pairs[0][1] if not isinstance(pairs[0][1], str) else F.lit(pairs[0][1]))
    for test, value in pairs[1:]:
        out = out.when(test, F.lit(value) if isinstance(value, str) else value)
    return out.otherwise(F.lit(otherwise) if isinstance(otherwise, str) else otherwise)


def _day(id_):
    return _text("2024-01-", F.lpad((id_ % 28 + 1).cast("string"), 2, "0"))


# five groups a page, two of three with a day of their own; the items without one take the group's, else the page's first
_GROUP = "CAST(floor(id / 4) AS BIGINT)"
_SELECTED = f"""{_BASE}, g AS (SELECT *, {_GROUP} AS grp, {_GROUP} % 3 <> 0 AS headed FROM o), firsts AS (SELECT page, min(grp) AS grp FROM g WHERE headed GROUP BY page),
f AS (SELECT g.page, g.pos, g.id, g.lang, concat('{_SITE}/n/', CAST(g.id % 15 AS VARCHAR)) AS url, concat('Headline ', CAST(g.id AS VARCHAR), CASE WHEN g.id % 6 = 0 THEN ' & more' ELSE '' END) AS title,
CASE WHEN g.id % 5 = 0 THEN '2024/03/09' WHEN headed THEN {_DAY.format('(4 * g.grp)')} ELSE {_DAY.format('(4 * firsts.grp)')} END AS day FROM g LEFT JOIN firsts ON firsts.page = g.page WHERE g.id % 6 < 2)"""


def _selected(spark, d):
    group = F.floor(F.col("id") / 4)
    k = F.col("id") % 6
    head = F.when(F.col("id") % 4 == 0, _text("<section>", F.when(group % 3 != 0, _text('<h2 class="big day">', _day(4 * group), "</h2>")).otherwise(""), "<ul>")).otherwise("")
    link = _case(
        (k == 0, _text('<a class="t" href="/n/', _NTH(15), '">Headline ', _id(), " &amp; more</a>")), (k == 1, _text('<h3 class="x t">Headline ', _id(), "</h3><a href='/n/", _NTH(15), "?utm_source=q#top'>read on</a>")),
        (k == 2, _text('<h3 class="t">Headline ', _id(), "</h3>")), (k == 3, _text('<a class="t" href="//other.example/n/', _id(), '">Headline ', _id(), "</a>")),
        (k == 4, _text('<a class="t" href="/n/', _id(), '.PDF">Headline ', _id(), "</a>")), otherwise=_text('<a class="t" href="/n/', _id(), '">no</a>'),
    )
    own = F.when(_is(5, 0), F.lit("<br><time class=date>2024/03/09</time>")).otherwise("")
    brief = F.when(_is(2, 1), _text("<p class='desc'>about <b>", F.col("lang"), "</b></p>")).otherwise("")
    part = _text(head, '<li class="item">', link, own, "<script>var a = '<b class=t>';</script>", brief, F.when(_is(4, 3), F.lit("</ul></section>")).otherwise(""))
    return _page(spark, d, part, "<html><body><h1 class=day>1999-01-01</h1><main>", "</main></body></html>")


SELECTORS = L.config({"discovery": {"mode": "selectors", "max_items": 15}, "extraction": {"item_selector": "main li.item", "title_selector": ".t", "date_selector": "time.date", "ancestor_date_selector": "h2.day, h5", "summary_selector": "li > p.desc"}})
_PICKED = "row_number() OVER (PARTITION BY page ORDER BY pos)"


@query(
    "list_selectors",
    X.WITH + f", {_SELECTED} SELECT page, title, url, CAST(epoch(CAST(replace(day, '/', '-') AS TIMESTAMP)) AS BIGINT) AS at, day AS time_text, CASE WHEN id % 2 = 1 THEN concat('about ', lang) END AS summary, 'same_site' AS link_type FROM (SELECT *, {_PICKED} AS k FROM f) WHERE k <= 15",
)
def list_selectors(spark, d):
    return L.selector_items(_selected(spark, d), SELECTORS).select("page", "title", "url", F.unix_timestamp("published_at").alias("at"), "time_text", "summary", "link_type")


@query("case_hub_scan", X.WITH + f", {_SELECTED} SELECT page, title, 'case' AS record_kind FROM (SELECT *, {_PICKED} AS k FROM f) WHERE k <= 15")
def case_hub_scan(spark, d):
    return L.case_hub(_selected(spark, d), SELECTORS).select("page", "title", "record_kind")


# the date stands in the link, beside it, one element further up, or nowhere near
_NEAR = f"""{_BASE}, f AS (SELECT page, pos, id, lang, concat('{_SITE}/n/', CAST(id % 15 AS VARCHAR)) AS url, CASE WHEN id % 4 = 0 THEN concat('Headline ', {_ID}, ' 2024-02-03') ELSE concat('Headline ', {_ID}) END AS title,
CASE id % 4 WHEN 0 THEN '2024-02-03' WHEN 1 THEN '2024年2月3日' WHEN 2 THEN '2024.02.04' END AS time_text FROM o WHERE id % 7 <> 3 AND NOT contains({_ID}, '9'))"""


def _near(spark, d):
    title = F.when(_is(7, 3), F.lit("登录 Headline")).otherwise(_text("Headline ", _id()))
    link = lambda t: _text("<a href=n/", _NTH(15), ">", t, "</a>")
    part = _case(
        (_is(4, 0), _text("<div><span>2020-01-01</span>", link(_text(title, " 2024-02-03")), "</div>")), (_is(4, 1), _text("<div>2024年2月3日", link(title), '<span class="summary">all about ', F.col("lang"), "</span></div>")),
        (_is(4, 2), _text("<div>on 2024.02.04<p>", link(title), "</div>")), otherwise=_text("<div>2024-05-05<div><span>", link(title), "</span></div></div>"),
    )
    return _page(spark, d, part, "<ul><li><a href='mailto:x@y.example'>write to us</a>", "</ul>").withColumn("url", F.lit(f"{_SITE}/"))


@query(
    "list_links_nearby",
    X.WITH + f", {_NEAR} SELECT page, title, url, time_text, CAST(epoch(CASE id % 4 WHEN 2 THEN TIMESTAMP '2024-02-04' WHEN 3 THEN NULL ELSE TIMESTAMP '2024-02-03' END) AS BIGINT) AS at, CASE WHEN id % 4 = 1 THEN concat('all about ', lang) END AS summary FROM f",
)
def list_links_nearby(spark, d):
    out = L.link_items(_near(spark, d), L.config({"discovery": {"include_text": ["headline"], "exclude_text": ["登录", "9"]}}))
    return out.select("page", "title", "url", "time_text", F.unix_timestamp("published_at").alias("at"), "summary")


# a report every five items, the four after it its cases; some have no link, some reports no title
_HUB = f"""{_BASE}, f AS (SELECT page, pos, id, lang, id % 5 = 0 AS report, id - id % 5 AS head, CASE WHEN id % 5 = 0 THEN concat('Report ', {_ID}) ELSE concat('Case of ', lang) END AS title, id % 9 <> 4 AND NOT (id % 5 = 0 AND id % 4 = 1) AS good FROM o),
h AS (SELECT c.*, sha256(concat('title:v1', chr(0), lower(c.title))) AS mark, CASE WHEN NOT c.report THEN sha256(concat('title:v1', chr(0), lower(r.title))) END AS over_ FROM f c JOIN f r ON r.page = c.page AND r.id = c.head AND r.good WHERE c.good)"""


def _hub(spark, d):
    link = lambda c: F.when(_is(9, 4), F.lit("")).otherwise(_text(f"<a class={c} href='/", c, "/", _id(), "'>open</a>"))
    report = _text("<article class=report><h2>", F.when(_is(4, 1), F.lit("")).otherwise(_text("Report ", _id())), "</h2><time>2024-01-0", (F.col("id") % 9 + 1).cast("string"), "</time>", link("r"), "<ul>")
    case = _text("<li class='case big'><h3>Case of ", F.col("lang"), "</h3>", link("c"), "<p>what ", F.col("lang"), " did")
    part = _text(F.when(_is(5, 0), report).otherwise(case), F.when(_is(5, 4), F.lit("</ul></article>")).otherwise(""))
    return _page(spark, d, part, "<body><li class=case><h3>Case of none</h3><a class=c href='/c/x'>open</a></li>", "</body>")


HUB = {"report_item": "article.report", "case_item": "li.case", "report_title": "h2", "report_link": "a.r", "report_date": "time", "case_title": "h3", "case_link": "a.c", "case_summary": "p"}


@query(
    "document_hub_scan",
    X.WITH + f""", {_HUB} SELECT * FROM (SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY pos) AS INTEGER) AS pos, CASE WHEN report THEN 'report' ELSE 'case' END AS record_kind, title, concat('{_SITE}', CASE WHEN report THEN '/r/' ELSE '/c/' END, {_ID}) AS url,
    CASE WHEN report THEN CAST(epoch(TIMESTAMP '2024-01-01') AS BIGINT) + 86400 * (id % 9) END AS at, CASE WHEN NOT report THEN concat('what ', lang, ' did') END AS summary, mark AS fingerprint, over_ AS parent_fingerprint FROM h) WHERE pos <= 12""",
)
def document_hub_scan(spark, d):
    out = L.document_hub(_hub(spark, d), HUB, 12)
    return out.select("page", "pos", "record_kind", "title", "url", F.unix_timestamp("published_at").alias("at"), "summary", "fingerprint", "parent_fingerprint")


@query(
    "document_hub_linked",
    X.WITH + f", {_HUB}, k AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY pos) AS n FROM h) SELECT c.page, c.n AS pos, r.n AS parent_pos FROM k c JOIN k r ON r.page = c.page AND r.mark = c.over_ WHERE c.n <= 20",
)
def document_hub_linked(spark, d):
    """Children meet their parents again by the fingerprint alone."""
    from ..operators.intake import with_parents

    rows = L.document_hub(_hub(spark, d), HUB, 20).select((F.col("page") * 100 + F.col("pos")).alias("id"), F.col("page").alias("source_id"), "fingerprint", "parent_fingerprint", F.lit(None).cast("long").alias("parent_item_id"))
    linked = with_parents(rows).filter("parent_item_id IS NOT NULL")
    return linked.select(F.floor(F.col("id") / 100).alias("page"), (F.col("id") % 100).alias("pos"), (F.col("parent_item_id") % 100).alias("parent_pos"))


# three pages of five posts from fifteen items; the second may have a bad code or be short, and the rest must not show
_POSTS = """it AS (SELECT CAST(floor(id / 15) AS BIGINT) AS source_id, CAST(floor(id % 15 / 5) AS BIGINT) + 1 AS number, id, lang, published_at FROM items),
pg AS (SELECT source_id, number, count(*) AS n, max(CASE WHEN source_id % 5 = 1 AND number = 2 THEN 1 ELSE 0 END) AS bad FROM (SELECT * FROM it WHERE NOT (source_id % 5 = 2 AND number = 2 AND id % 5 > 2)) GROUP BY ALL),
stop AS (SELECT source_id, min(CASE WHEN bad = 1 THEN number WHEN n < 5 THEN number + 1 ELSE 99 END) AS stop FROM pg GROUP BY source_id),
p AS (SELECT it.*, id % 12 AS aid FROM it JOIN stop ON stop.source_id = it.source_id AND number < stop WHERE NOT (it.source_id % 5 = 2 AND number = 2 AND id % 5 > 2) AND id % 11 <> 0 AND id % 13 <> 0 AND id % 17 <> 0 AND id % 10 <> 7),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, aid ORDER BY id) AS k FROM p) WHERE k = 1)"""


def _posts(spark, d):
    rows = X.items(spark, d)
    post = F.to_json(F.struct(
        F.when(_is(10, 7), F.lit(" ")).otherwise(_text("a", _NTH(12))).alias("aid"), _text(" Post ", _id(), " ").alias("article_title"), _text("on ", F.col("lang")).alias("article_summary"), (F.unix_timestamp("published_at") * 1000).alias("publish_time"),
        F.when(_is(11, 0), 3).otherwise(0).alias("sub_type"), _is(13, 0).alias("is_promotion"), F.array(F.struct(F.when(_is(17, 0), "直播").otherwise("文章").alias("name"))).alias("topic"),
    ))
    source, number = F.floor(F.col("id") / 15), F.floor(F.col("id") % 15 / 5) + 1
    rows = rows.select(source.alias("source_id"), number.alias("number"), "id", post.alias("p")).filter(~((F.col("source_id") % 5 == 2) & (F.col("number") == 2) & (F.col("id") % 5 > 2)))
    pages = rows.groupBy("source_id", "number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "p"))), lambda x: x["p"]), ",").alias("posts"))
    code = F.when((F.col("source_id") % 5 == 1) & (F.col("number") == 2), "1").otherwise("0")
    return pages.select("source_id", "number", F.concat(F.lit('{"code":'), code, F.lit(',"data":['), "posts", F.lit("]}")).alias("body"))


@query(
    "paged_posts_scan",
    X.WITH + f", {_POSTS} SELECT * FROM (SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY id) AS INTEGER) AS pos, concat('Post ', {_ID}) AS title, concat('https://posts.example/article/a', CAST(aid AS VARCHAR)) AS url, CAST(epoch(published_at) AS BIGINT) AS at, concat('on ', lang) AS summary FROM u) WHERE pos <= 5",
)
def paged_posts_scan(spark, d):
    out = L.paged_posts(_posts(spark, d), "https://posts.example/article/", max_items=5)
    return out.select("source_id", "pos", "title", "url", F.unix_timestamp("published_at").alias("at"), "summary")


# two page tables of a log: rows with a full date, a month and day under the year above, or none at all
_TABLE = f"""{_BASE}, f AS (SELECT page, pos, id, lang, CASE id % 3 WHEN 0 THEN '2023-05-06' WHEN 1 THEN concat(CAST(2020 + CAST(floor(id / 5) AS BIGINT) % 4 AS VARCHAR), '年', CAST(id % 12 + 1 AS VARCHAR), '月7日') ELSE concat(CAST(2020 + CAST(floor(id / 5) AS BIGINT) % 4 AS VARCHAR), '年') END AS day,
CASE WHEN id % 4 = 0 THEN concat('Model ', CAST(id % 11 AS VARCHAR), ' — 更新') ELSE concat('Model ', CAST(id % 11 AS VARCHAR), ' — note', CASE WHEN contains('model note', lower(lang)) THEN '' ELSE concat('：', lang) END) END AS title, concat(lang, '。 rest of ', lang) AS summary FROM o WHERE id % 8 <> 3),
k AS (SELECT *, substr(sha256(lower(concat(day, chr(10), title))), 1, 20) AS key FROM f), u AS (SELECT *, row_number() OVER (PARTITION BY page, key ORDER BY pos) AS n FROM k)"""


def _table(spark, d):
    year = F.when(_is(5, 0), _text("</table><h2><span>", (2020 + F.floor(F.col("id") / 5) % 4).cast("string"), "年</span> 历史</h2><table><tr><th>name<th>kind</tr>")).otherwise("")
    when = _case((_is(3, 0), "released 2023-05-06"), (_is(3, 1), _text(((F.col("id") % 12) + 1).cast("string"), "月7日")))
    row = _text("<tr><td>Model ", _NTH(11), "<td>", F.when(_is(4, 0), "更新").otherwise("note"), "<td>", when, "<td>", F.when(_is(8, 3), "internal ").otherwise(""), F.col("lang"), "。<i>rest</i> of ", F.col("lang"), "<td><a href=' /d/", _id(), " '>more</a>")
    return _page(spark, d, _text(year, row), "<table>", "</table>")


TABLE = L.ChangelogConfig("h2 > span", "table tr", entry_title_cells=(0, 1), entry_date_cell=2, entry_summary_cell=3, entry_link_cell=4, exclude_entry_terms=("INTERNAL", "name — kind"), append_summary_when_title_lacks_action=True, max_items=14)


@query(
    "changelog_table_scan",
    X.WITH + f""", {_TABLE} SELECT page, title, CAST(epoch(CASE id % 3 WHEN 0 THEN TIMESTAMP '2023-05-06' WHEN 1 THEN make_timestamp(2020 + CAST(floor(id / 5) AS BIGINT) % 4, id % 12 + 1, 7, 0, 0, 0.0) END) AS BIGINT) AS at, summary, key, concat('{_SITE}/p', CAST(page AS VARCHAR), '?entry=', key) AS url, concat('/d/', {_ID}) AS detail_link
    FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY pos) AS turn FROM u WHERE n = 1) WHERE turn <= 14""",
)
def changelog_table_scan(spark, d):
    return L.dated_entries(_table(spark, d), TABLE).select("page", "title", F.unix_timestamp("published_at").alias("at"), "summary", "key", "url", "detail_link")


# a start page, two pages behind it and one behind the second: items past the budget and pages past the bound must not show
_WALK = """it AS (SELECT CAST(floor(id / 20) AS BIGINT) AS source_id, CAST(floor(id % 20 / 5) AS BIGINT) AS n, id FROM items WHERE id % 6 <> 0),
w AS (SELECT source_id, n, id, id % 7 AS item FROM it WHERE n <= 2), q AS (SELECT *, row_number() OVER (PARTITION BY source_id, item ORDER BY id) AS k FROM w),
c AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY id) AS pos FROM q WHERE k = 1)"""


@query("list_walk", X.WITH + f", {_WALK} SELECT source_id, CAST(pos - 1 AS INTEGER) AS pos, concat('https://w.example/i', CAST(item AS VARCHAR)) AS url, concat('https://w.example/', CAST(n AS VARCHAR)) AS page_url FROM c")
def list_walk(spark, d):
    rows = X.items(spark, d).filter("id % 6 <> 0").select(F.floor(F.col("id") / 20).alias("source_id"), F.floor(F.col("id") % 20 / 5).alias("n"), "id")
    page = lambda n: _text("https://w.example/", n.cast("string"))
    items = rows.select("source_id", page(F.col("n")).alias("page_url"), F.col("id").alias("pos"), _text("https://w.example/i", _NTH(7)).alias("url"))
    sources = rows.select("source_id").distinct()
    hop = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (0, 2), (1, 0), (2, 3), (3, 4))]))
    links = sources.select("source_id", hop.alias("x")).select("source_id", page(F.col("x.a")).alias("page_url"), F.col("x.b").alias("pos"), page(F.col("x.b")).alias("next_url"))
    return L.walk(items, links, sources.select("source_id", page(F.lit(0)).alias("url")), max_pages=10, max_depth=1, max_items=1000)
