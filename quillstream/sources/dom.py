"""Pages as tables of nodes: selectors as joins of intervals.

A page's elements and texts are rows numbered in document order; an element also has the number of the last row
inside it, so that "inside" is an interval.  A selector list becomes filters for its simple parts and joins by
page and interval for its combinators; the text of the elements that were chosen is put together by one more.
Only the parser is Python: it reads a page and gives its rows.

Selectors: tag, *, .class, #id, [name], [name=value], [name^=value], [name$=value], [name*=value], [name~=value], the combinators
blank and >, and lists with commas.  A page that cannot be read to its end gives the nodes that were read.
"""

from __future__ import annotations

import re
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.upsert import checkpointed

NODE = "array<struct<pre:int,post:int,parent:int,depth:int,tag:string,attrs:map<string,string>,text:string>>"
# Fixed values of HTML: elements without an end, those whose text is none of the page's, and what a start tag ends.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
UNSEEN = {"script", "style", "template"}
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "thead": ({"tr", "td", "th", "tbody"}, {"table"}), "a": ({"a"}, {"td", "li", "table"}),
}
#: Start tags that end an open paragraph.
BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []

    def handle_starttag(self, tag, attrs):
        ended, fence = ENDS.get(tag, (set(), set()))
        if tag in BLOCKS:
            ended, fence = ended | {"p"}, fence | {"button", "td", "th"}
        while ended and (at := next((i for i in reversed(range(len(self.open))) if self._tag(i) in ended | fence), None)) is not None and self._tag(at) in ended:
            self._close(at)
        self.rows.append([len(self.rows), len(self.rows), self.open[-1] if self.open else None, len(self.open), tag, {k: v or "" for k, v in reversed(attrs)}, None])
        if tag not in VOID:
            self.open.append(len(self.rows) - 1)

    def _tag(self, i: int) -> str:
        return self.rows[self.open[i]][4]

    def _close(self, at: int) -> None:
        for i in self.open[at:]:
            self.rows[i][1] = len(self.rows) - 1
        del self.open[at:]

    def handle_endtag(self, tag):
        at = next((i for i in reversed(range(len(self.open))) if self._tag(i) == tag), None)
        if at is not None:
            self._close(at)

    def handle_data(self, data):
        text = " ".join(data.replace("​", "").replace("﻿", "").split())
        if text and not any(self._tag(i) in UNSEEN for i in range(len(self.open))):
            n = len(self.rows)
            self.rows.append([n, n, self.open[-1] if self.open else None, len(self.open), None, None, text])

    def finish(self) -> list[list]:
        self._close(0)
        return self.rows


def parse(html: str | None) -> list[list]:
    tree = _Tree()
    try:
        tree.feed(html or "")
        tree.close()
    except (AssertionError, ValueError):
        pass
    return tree.finish()


def nodes(pages: DataFrame) -> DataFrame:
    """pages(page, html) -> page, pre, post, parent, depth, tag, attrs, text, read once and kept; texts have no tag."""
    read = F.pandas_udf(lambda s: pd.Series([parse(x) for x in s], dtype=object), NODE)
    return checkpointed(pages.select("page", F.explode(read("html")).alias("n")).select("page", "n.*"))


_PART = re.compile(r"""(?P<tag>^[a-zA-Z][\w-]*|^\*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[\s*(?P<name>[\w-]+)\s*(?:(?P<op>[*^$~]?=)\s*(?P<q>["']?)(?P<value>.*?)(?P=q)\s*)?\]""", re.X)


def _compound(text: str) -> Column:
    """The test of one compound selector on a node."""
    tests, at = [F.col("tag").isNotNull()], 0
    for m in _PART.finditer(text):
        if m.start() != at:
            break
        at = m.end()
        attr = F.col("attrs")
        if m["tag"]:
            tests += [F.col("tag") == m["tag"].lower()] if m["tag"] != "*" else []
        elif m["cls"]:
            tests.append(F.array_contains(F.split(attr["class"], r"\s+"), m["cls"]))
        elif m["id"]:
            tests.append(attr["id"] == m["id"])
        else:
            value, v = attr[m["name"].lower()], F.lit(m["value"])
            tests.append({None: value.isNotNull(), "=": value == v, "^=": F.startswith(value, v), "$=": F.endswith(value, v), "*=": F.contains(value, v), "~=": F.array_contains(F.split(value, r"\s+"), v)}[m["op"]])
    if at != len(text) or not text:
        raise ValueError(f"no selector: {text!r}")
    return F.coalesce(reduce(Column.__and__, tests), F.lit(False))


def matches(nodes: DataFrame, selector: str) -> DataFrame:
    """The nodes of every page that a selector list names, each once."""
    found = []
    for one in _split(selector, ","):
        steps = re.sub(r"\s*>\s*", " > ", one.strip()).split()
        cur = nodes.filter(_compound(steps[0]))
        i = 1
        while i < len(steps):
            child = steps[i] == ">"
            i += child
            if i >= len(steps):
                raise ValueError(f"no selector: {selector!r}")
            up = cur.select(F.col("page").alias("_page"), F.col("pre").alias("_lo"), F.col("post").alias("_hi"))
            within = (F.col("parent") == F.col("_lo")) if child else (F.col("pre") > F.col("_lo")) & (F.col("pre") <= F.col("_hi"))
            cur = nodes.filter(_compound(steps[i])).join(up, (F.col("page") == F.col("_page")) & within, "left_semi")
            i += 1
        found.append(cur)
    return found[0] if len(found) == 1 else reduce(DataFrame.unionByName, [f.select("page", "pre") for f in found]).distinct().join(nodes, ["page", "pre"])


def _split(text: str, sign: str) -> list[str]:
    """Split at a sign that stands in no bracket."""
    return [x for x in re.split(sign + r"(?![^\[]*\])", text) if x.strip()]


def first_inside(scopes: DataFrame, nodes: DataFrame, fields: dict[str, str]) -> DataFrame:
    """page, scope and, of each field, the first node inside the scope that its selector names, null if none.

    scopes: page, scope, lo, hi.  All fields meet the scopes in one join."""
    if not fields:
        return scopes.select("page", "scope").distinct()
    named = reduce(DataFrame.unionByName, [matches(nodes, s).select("page", "pre", "post", F.element_at("attrs", "href").alias("href"), F.lit(f).alias("field")) for f, s in fields.items()])
    met = scopes.select(F.col("page").alias("_p"), "scope", "lo", "hi").join(named, (F.col("_p") == F.col("page")) & (F.col("pre") > F.col("lo")) & (F.col("pre") <= F.col("hi")))
    node = F.struct("pre", "post", "href")
    found = met.groupBy("page", "scope").agg(*[F.min(F.when(F.col("field") == f, node)).alias(f) for f in fields])
    return scopes.select("page", "scope").distinct().join(found, ["page", "scope"], "left")


def texts(chosen: DataFrame, nodes: DataFrame) -> DataFrame:
    """page, pre and text of the chosen elements (page, pre, post): all texts inside, joined by blanks; empty if none."""
    each = chosen.select("page", "pre", "post").distinct()
    inside = nodes.filter("text IS NOT NULL").select(F.col("page").alias("_p"), F.col("pre").alias("at"), "text")
    met = each.join(inside, (F.col("page") == F.col("_p")) & (F.col("at") > F.col("pre")) & (F.col("at") <= F.col("post")), "left")
    parts = F.transform(F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("at", "text")))), lambda x: x["text"])
    return met.groupBy("page", "pre").agg(F.array_join(parts, " ").alias("text"))


def with_texts(rows: DataFrame, nodes: DataFrame, *fields: str) -> DataFrame:
    """rows with <field>_text of columns that hold nodes; null where there is no node."""
    chosen = reduce(DataFrame.unionByName, [rows.filter(F.col(f).isNotNull()).select("page", F.col(f)["pre"].alias("pre"), F.col(f)["post"].alias("post")) for f in fields])
    found = checkpointed(texts(chosen, nodes))
    for f in fields:
        own = found.select(F.col("page").alias("_p"), F.col("pre").alias("_pre"), F.col("text").alias(f"{f}_text"))
        rows = rows.join(own, (F.col("page") == F.col("_p")) & (F.col(f)["pre"] == F.col("_pre")), "left").drop("_p", "_pre")
    return rows
