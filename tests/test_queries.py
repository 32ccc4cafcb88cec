"""Every registered query of the engine against its SQL on a second engine."""

import os

import duckdb
import pytest
from oracle import connect, differences

from quillstream.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, con, name):
    assert differences(spark, con, registry.queries()[name], registry.oracle_sql()[name], DATA) is None


def test_page_titles_read_one_entity_only(spark, tmp_path):
    """Other entities, inner runs of blanks, tabs and line ends stay; blanks of any kind go at both ends."""
    inner = ["a &quot;b&quot;", "&lt;p&gt; &#39;x&#39;&nbsp;", "&amp;quot; &amp;amp;", "a  b\u3000\u3000c", "\u3000\u00a0 a\u2003", "\n a\t\n", "\t", " \u202f ", "", "\u200ba\ufeff", "&amp", "a\x00b"]
    pages = [f"<html><title>{t}</title><title>second</title>" for t in inner] + [None, "", "<TITLE>x</TITLE>", "<title>open", "<title>a<b>c</b></title>"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = dict(con.execute(registry.oracle_sql()["page_titles"]).fetchall())
    assert {r.page_id: r.title for r in registry.queries()["page_titles"](spark, str(tmp_path)).collect()} == want
    assert want[0] == "a &quot;b&quot;" and want[len(inner)] is None
