from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.functions import times as D
from quillstream.functions import urls as U
from quillstream.operators import mutations as M
from quillstream.operators import rules as R
from quillstream.operators import upsert as P
from quillstream.sources import feeds, pages, payloads
from quillstream.streaming import ingest as S

RSS = """<rss><channel><item><title>First &amp; best</title><link>https://A.example/x/?utm_source=q&amp;b=2&amp;a=1#z</link><pubDate>Mon, 01 Jan 2024 08:00:00 +0800</pubDate><description><![CDATA[<p>Hi  <b>you</b></p>]]></description></item>
<item><title>No link</title></item><item><title>Again</title><link>/x?a=1&amp;b=2</link></item></channel></rss>"""


def test_feed(spark):
    rows = feeds.scan_feed(spark.createDataFrame([(1, "https://a.example/feed", RSS), (2, "https://b.example", "<broken")], "source_id int, base_url string, body string")).collect()
    assert [(r.title, r.url, r.summary) for r in rows] == [("First & best", "https://a.example/x?a=1&b=2", "Hi you")]
    assert rows[0].published_at == datetime(2024, 1, 1, 0, 0)


def test_links_and_changelog(spark):
    html = '<title>t</title><nav><a href="/login">in</a></nav><p><a href="/news/1">A new model</a><a href="https://x.org/2">Outer link</a><a href="mailto:a@b">mail me</a><script>var a="</p>"</script><h2>2024-02-03</h2><h3>Thing</h3><p>one<p>two<h3>Other</h3>'
    df = spark.createDataFrame([(1, "https://a.example/", html)], "page int, url string, html string")
    assert [(r.title, r.link) for r in pages.scan_links(df).collect()] == [("A new model", "https://a.example/news/1")]
    got = {r.title: (r.date, r.summary) for r in pages.changelog(df).collect()}
    assert got == {"Thing": ("2024-02-03", "one two"), "Other": ("2024-02-03", "")}


def test_payloads(spark):
    body = '[{"name":"v1","html_url":"https://a.example/r/1","published_at":"2024-01-02T03:04:05Z","body":"**b** [l](u)"},{"name":"d","draft":true,"html_url":"https://a.example/r/2"},{"name":"p","prerelease":true,"html_url":"https://a.example/r/3"},{"tag_name":"bad","html_url":"nope"}]'
    rows = payloads.scan_releases(spark.createDataFrame([(1, body), (2, "{")], "source_id int, body string")).collect()
    assert [(r.title, r.summary, r.published_at) for r in rows] == [("v1", "b l", datetime(2024, 1, 2, 3, 4, 5))]
    mixed = '{"data":{"list":[{"t":"A","s":"x","d":1704067200},{"t":"B","s":"y","d":"2024-01-01"},{"t":"C","s":"z","d":1704067200000}]}}'
    rows = payloads.scan_public(spark.createDataFrame([(1, mixed)], "source_id int, body string"), "$.data.list", ["t"], ["s"], ["d"], template="https://a.example/{}").collect()
    assert {r.published_at for r in rows} == {datetime(2024, 1, 1)} and len(rows) == 3


def test_canonical_is_idempotent():
    for url in ("HTTP://Ä.example:80/a//?b=1&a=%20&utm_x=1#f", "https://u:p@h.example./", "ftp://x", "http://[bad", None, "https://h.example:99999/"):
        once = U.canonical_one(url)
        assert once is None or U.canonical_one(once) == once


def test_text(spark):
    df = spark.createDataFrame([("  Straße　ＡＩ。“x” ", "=1+1", "-5", "【Head line】 rest")], "a string, b string, c string, d string")
    r = df.select(T.normalize_text(F.col("a")).alias("n"), T.formula_safe(F.col("b")).alias("b"), T.formula_safe(F.col("c")).alias("c"), T.headline(F.col("d")).alias("d")).first()
    assert tuple(r) == ('strasse ai."x"', "'=1+1", "-5", "Head line")


def test_next_run_over_clock_changes():
    utc = timezone.utc
    at = lambda *a: datetime(*a, tzinfo=utc)
    assert D.next_run_one(at(2024, 3, 31, 0), 127, 2, 30, "Europe/Berlin") == at(2024, 4, 1, 0, 30)  # 02:30 is skipped on that day
    assert D.next_run_one(at(2024, 10, 26, 23), 127, 2, 30, "Europe/Berlin") == at(2024, 10, 27, 1, 30)  # the later of two


def test_longest_match_suppresses_by_text(spark):
    rule = R.Rule("model_technology", 1, {"big model": 4}, {"model": 3}, {"bad": 2})
    df = spark.createDataFrame([("big model model", ""), ("model bad bad", "bad")], "t string, s string")
    assert [r[0] for r in df.select(R.category_score(rule, F.col("t"), F.col("s"))).collect()] == [12.0, 0.0]


def test_tie_keeps_declaration_order(spark):
    pack = [R.Rule("award_case", 5, {}, {"x": 9}, {}), R.Rule("agent_product", 5, {}, {"x": 9}, {})]
    top = spark.createDataFrame([("x", "")], "t string, s string").select(R.scores(F.col("t"), F.col("s"), pack)[0]["category"]).first()[0]
    assert top == "agent_product"


def test_upsert_fold(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows = [(1, 1, "u1", "a"), (2, 1, "u2", "a"), (3, 1, "u2", "b"), (4, 2, "u1", "z"), (5, 2, "u9", "z"), (6, 1, "u3", "c")]
    got = {r.rowno: r["into"] for r in P.first_wins(spark.createDataFrame(rows, "rowno long, source_id long, canonical_url string, fingerprint string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 6}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i % 7, i, f"v{i}") for i in range(40)]
    schema = "id long, at long, v string"
    for k in range(4):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], schema).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    S.ingest(stream, f"{tmp_path}/out", "id", ["at"], f"{tmp_path}/cp").awaitTermination()
    want = S.merged(None, spark.createDataFrame(rows, schema), "id", ["at"]).collect()
    assert sorted(S.snapshot(spark, f"{tmp_path}/out").collect()) == sorted(want)


def test_title_links(spark):
    html = r'<script>x="[{\"t\":\"One \\u4e2d\",\"z\":1,\"id\":12},{\"id\":\"a/b\",\"q\":0,\"t\":\"Two\"}]"</script>'.replace(r"\\u", r"\u")
    rows = payloads.title_links(spark.createDataFrame([(1, html), (2, None)], "source_id int, html string"), "t", "id", "https://a.example/{value}").collect()
    got = {r.title: r.link for r in rows}
    assert got["One 中"] == "https://a.example/12" and set(got) == {"One 中", "Two"}
    many = "".join(f'"t":"T{i}","id":{i} ' for i in range(5))
    assert payloads.title_links(spark.createDataFrame([(1, many)], "source_id int, html string"), "t", "id", limit=2).count() == 2


def test_indexed_payload(spark):
    body = '[{"datalist":1},[2,3,2,9],{"aid":4,"title":5,"dateline":6,"url":7},{"aid":"8","title":"Own  text"},77,"Pointed",1704067200,"https://a.example/x?type=q"]'
    rows = payloads.scan_indexed(spark.createDataFrame([(1, body), (2, "{"), (3, None), (4, '[{"datalist":0}]')], "source_id int, body string"), "https://a.example/article/{}.html").collect()
    got = {(r.source_id, r.aid): (r.title, r.url, r.published_at) for r in rows}
    assert got == {(1, "77"): ("Pointed", "https://a.example/x", datetime(2024, 1, 1)), (1, "8"): ("Own text", "https://a.example/article/8.html", None)}


def test_feed_sniffing(spark):
    rows = feeds.is_feed(spark.createDataFrame([(1, "https://a.example/", "text/xml", RSS), (2, "https://a.example/", "text/html", "<html/>"), (3, "https://a.example/", "application/rss+xml", None)], "source_id int, base_url string, content_type string, body string"))
    assert {r.source_id: r.feed for r in rows.collect()} == {1: True, 2: False, 3: False}


def test_review_marks_and_audits(spark):
    fields = "manual_primary_type string, manual_topic_tags array<string>, manual_industry_tags array<string>, verification_status string, review_status string, official_url string, origin_publisher string"
    store = spark.createDataFrame([(i, "award_result", None, None, "media_only", "pending", None, None, False, False) for i in (1, 2, 3)], f"id int, {fields}, verification_manually_set boolean, review_manually_set boolean")
    changes = spark.createDataFrame(
        [(1, 1, None, ["policy", "model", "model"], None, None, "approved", "HTTPS://A.example:443/x#f", None), (1, 2, None, None, None, None, None, None, "  The   Press "), (2, 1, "nonsense", None, None, None, "approved", None, None), (9, 1, None, None, None, None, "approved", None, None)], f"id int, seq int, {fields}"
    )
    after, audit = M.review(store, changes, "tester")
    rows = {r.id: r for r in after.collect()}
    assert rows[1].manual_topic_tags == ["model", "policy"] and rows[1].official_url == "https://a.example/x" and rows[1].origin_publisher == "The Press"
    assert rows[1].verification_manually_set and rows[1].review_manually_set and rows[1].manual_primary_type == "award_result"
    assert rows[2].review_status == "pending" and not rows[2].review_manually_set and set(rows) == {1, 2, 3}
    entry, second = audit.orderBy("seq").collect()
    assert entry.item_id == 1 and entry.actor == "tester" and '"review_status":"pending"' in entry.old_data and '"review_status":"approved"' in entry.new_data
    # each change leaves a row of its own, which begins where the one before ended
    assert (second.item_id, second.seq) == (1, 2) and second.old_data == entry.new_data and '"origin_publisher":"The Press"' in second.new_data and '"origin_publisher":null' in entry.new_data
    assert M.checked_review(changes).filter("id = 2").first().error == "manual_primary_type"


def test_manual_category(spark):
    store = spark.createDataFrame([(1, "award_case"), (2, "award_case"), (3, None)], "id int, manual_category string")
    changes = spark.createDataFrame([(1, 1, "solicitation"), (1, 2, " "), (2, 1, "nonsense"), (3, 1, "irrelevant")], "id int, seq int, category string")
    after, audit = M.set_category(store, changes)
    assert {r.id: r.manual_category for r in after.collect()} == {1: None, 2: "award_case", 3: "irrelevant"}
    assert {r.item_id: r.old_data for r in audit.collect()} == {1: '{"manual_category":"award_case"}', 3: '{"manual_category":null}'}


def in_order(rows):
    """rowno -> the row it merges into, one row after the other."""
    urls, marks, into = {}, {}, {}
    for n, source, url, mark in sorted(rows):
        at = urls.get(url) if url is not None else None
        at = marks.get((source, mark)) if at is None and None not in (source, mark) else at
        if at is None:
            at = n
            if url is not None:
                urls[url] = n
            if None not in (source, mark):
                marks[source, mark] = n
        into[n] = at
    return into


@pytest.mark.parametrize("kind", ["chain", "dense", "hot"])
def test_first_wins_in_any_tangle(spark, tmp_path, kind):
    import random

    spark.sparkContext.setCheckpointDir(str(tmp_path))
    r = random.Random(kind)
    if kind == "chain":  # each row shares its address with one neighbour, its fingerprint with the other
        rows = [(i, 1, f"u{i // 2}", f"f{(i + 1) // 2}") for i in range(200)]
    elif kind == "dense":
        rows = [(i, r.choice([1, 2, None]), r.choice([None, *(f"u{k}" for k in range(40))]), r.choice([None, *(f"f{k}" for k in range(25))])) for i in range(400)]
    else:
        rows = [(i, 1, "hot", f"f{i % 90}") if i % 3 else (i, i % 5, f"u{i % 70}", "hot") for i in range(600)]
    r.shuffle(rows)
    got = P.first_wins(spark.createDataFrame(rows, "rowno long, source_id long, canonical_url string, fingerprint string").repartition(4)).collect()
    assert {x.rowno: x["into"] for x in got} == in_order(rows) and len(got) == len(rows)


def test_role_and_release_rejects(spark):
    """In the reference's order: after the meeting test, roles before releases, both before missing terms."""
    from quillstream.operators import admission as A

    cases = [
        ("official_product", False, True, "某公司融资消息", "role.official_product.non_product_activity"),
        ("official_product", False, True, "New model tools", "quality.threshold_met"),
        ("official_policy", False, True, "座谈会纪要", "role.official_policy.routine_activity"),
        ("official_policy", False, True, "New product of the year", "quality.threshold_met"),
        ("official_industry", False, True, "Steel prices of the week", "role.official_industry.ai_relevance_missing"),
        ("official_industry", False, True, "An agent for the mill", "quality.threshold_met"),
        ("opportunity_and_award_hub", False, True, "放假通知", "role.opportunity_hub.generic_notice"),
        ("opportunity_and_award_hub", False, True, "项目申报通知", "quality.threshold_met"),
        ("official_industry", True, True, "v2.0.0-rc 1", "role.official_industry.ai_relevance_missing"),
        ("media_discovery", True, True, "Tool v2.0.0-beta.1", "github.prerelease"),
        ("media_discovery", True, True, "Tool v2.1.0", "github.non_major_version"),
        ("media_discovery", True, True, "Tool v2.0.3 bugfix", "github.non_major_version"),
        ("media_discovery", True, True, "Tool v2.0.0 bug fix", "github.maintenance"),
        ("media_discovery", True, False, "Tool v2.0.0", "github.technical_updates_not_allowed"),
        ("media_discovery", True, True, "Tool v0.0.0", "github.major_release_not_proven"),
        ("media_discovery", True, True, "Tool without a version", "github.major_release_not_proven"),
        ("media_discovery", True, True, "Tool v2.0.0", "quality.threshold_met"),
        ("media_discovery", False, False, "Tool v0.1.0-beta", "quality.threshold_met"),
        ("media_discovery", True, True, "Log in", "content.login_page"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, role string, release boolean, technical boolean, title string, want string")
    none = F.array().cast("array<string>")
    src = {"valid": F.lit(True), "site_host": F.lit("h.example"), "allow_external": F.lit(False), "include_terms": none, "exclude_terms": none, "scopes": none, "formal": F.lit(True)}
    src |= {"tier": F.lit("government"), "title_only_allowed": F.lit(True), "minimum": F.lit(0.0), **{c: F.col(c) for c in ("role", "release", "technical")}}
    got = A.admitted(df, F.col("title"), F.lit("text"), F.lit("https://h.example/x"), F.lit(None).cast("timestamp"), src).select("i", "a.reason").collect()
    assert [x[1] for x in sorted(got)] == [c[4] for c in cases]


def test_upsert_store_grows(spark, tmp_path):
    """Store and batch follow the documents: nothing is left out by a modulo of the id."""
    from quillstream.plans import state_queries as Q

    n = 2000
    docs = [(i, f"title {i % 1500}\nbody {i}", "en", f"src{i % 20}", 10) for i in range(n)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    d, store, urls, marks = str(tmp_path), Q._store(spark, str(tmp_path)).collect(), {}, {}
    assert len(store) == len({(r.source_id, r.title) for r in store}) == len({x[1].split("\n")[0] + x[3] for x in docs})
    for r in store:
        urls[r.canonical_url] = marks[r.source_id, r.fingerprint] = r.id
    batch = Q._batch(spark, d).orderBy("rowno").collect()
    want = {r.rowno: urls.get(r.canonical_url, marks.get((r.source_id, r.fingerprint))) for r in batch}
    assert {r.rowno: r.stored_id for r in Q.upsert_match(spark, d).collect()} == want
    found, seen, into = sum(x is not None for x in want.values()), {}, {}
    assert 0.7 * n < found < 0.95 * n
    for r in batch:
        if want[r.rowno] is None:
            at = seen.get(r.canonical_url, seen.get((r.source_id, r.fingerprint)))
            if at is None:
                at = seen[r.canonical_url] = seen[r.source_id, r.fingerprint] = r.rowno
            into[r.rowno] = at
    assert {r.rowno: r["into"] for r in Q.upsert_first_wins(spark, d).collect()} == into
    assert 0 < sum(k != v for k, v in into.items())


def test_whole_texts_count(spark, tmp_path):
    """Terms beyond a title's 80th or a text's 280th character count in the queries over whole texts."""
    from quillstream.plans import classification_queries as Q
    from quillstream.plans import fixtures as X
    from quillstream.plans import registry

    term = next(iter(Q.R.PACK[0].phrases))
    texts = [f"{'a b ' * 80}{term}\n{'c d ' * 100}{term}", f"short\n{'c d ' * 100}{term}", "one line", "", None, "title\n", "\nbody"]
    docs = [(i, t, "en", f"src{i % 20}", 10) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.id: (r.title, r.summary) for r in X.items(spark, str(tmp_path)).collect()}
    assert got == {i: (t.split("\n")[0], "\n".join(t.split("\n")[1:]) or None) if t is not None else (None, None) for i, t in enumerate(texts)}
    points = Q.R.PACK[0].phrases[term] * 1.5
    score = lambda name: {r.id: r[Q.R.PACK[0].category] for r in registry.queries()[name](spark, str(tmp_path)).collect()}
    whole = score("rule_scores")
    assert whole[0] >= 3 * points and whole[1] >= points


def test_canonical_addresses(spark):
    """Both paths give the exact form; keep lists name what stays."""
    cases = [
        ("HTTPS://News.COM:443/a/b/?z=2&utm_medium=test&c=1#part", None, None, "https://news.com/a/b?c=1&z=2"),
        ("http://news.com:80/", None, None, "http://news.com/"),
        ("https://news.com/path///", None, None, "https://news.com/path"),
        ("https://bücher.example/neu", None, None, "https://xn--bcher-kva.example/neu"),
        ("../entry/1#intro", "https://news.com/list/index.html", None, "https://news.com/entry/1"),
        ("https://news.com/s?page=2&kind=ai&session=x&utm_medium=m", None, ["page", "kind"], "https://news.com/s?kind=ai&page=2"),
        ("https://news.com/r?utm_source=needed&unused=drop", None, ["utm_source"], "https://news.com/r?utm_source=needed"),
        ("https://news.com/x?ref=1&from=2&dclid=2&msclkid=3&MC_EID=4", None, None, "https://news.com/x?from=2&ref=1"),
        ("https://news.com/x?a-b=1&a=2&a=1", None, None, "https://news.com/x?a=1&a=2&a-b=1"),
        ("https://user:secret@news.com./x", None, None, "https://news.com/x"),
        ("https://[2001:db8::1]:8080/x", None, None, "https://[2001:db8::1]:8080/x"),
        ("javascript:alert(1)", None, None, None), ("mailto:a@b.example", None, None, None), ("ftp://news.com/f", None, None, None),
        ("/relative", None, None, None), ("https://[malformed", None, None, None), ("https://news.com:bad/x", None, None, None), ("", None, None, None), (None, None, None, None),
    ]
    for url, base, keep, want in cases:
        df = spark.createDataFrame([(url, base)], "u string, b string")
        assert df.select(U.canonical_url("u", F.col("b") if base else None, keep)).first()[0] == want, url


def test_normalize_text_paths(spark):
    texts = ["《a》、b", "Straße", "ＡＢＣ１２", "x—y", "a…b", "“Q”", "Ünï  çode", "模型（发布）", None, "", "ﬁn", "İ"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.normalize_text(F.col("t"))).collect()]
    assert got == [T.normalize_one(t) for t in texts] and got[0] == "a b" and got[1] == "strasse"


def test_asked_in_halves():
    """A batch that cannot be read is split; a limit is waited out; what stays unreadable is missing."""
    from quillstream.operators.ai import Limited, ask_resiliently

    waits, calls = [], []

    def ask(rows):
        calls.append(len(rows))
        if len(calls) == 1:
            raise Limited
        if "bad" in rows:
            raise ValueError
        return [r.upper() for r in rows]

    assert ask_resiliently(["a", "b", "bad", "d"], ask, wait=waits.append) == {0: "A", 1: "B", 3: "D"}
    assert waits == [1] and calls == [4, 4, 2, 2, 1, 1]


def test_answered_batches(spark):
    from quillstream.operators.ai import answered

    rows = spark.createDataFrame([(i, f"t{i}", None) for i in range(40)], "id long, title string, summary string")
    got = {r.id: r.answer for r in answered(rows, lambda batch: [r.title + "!" for r in batch]).collect()}
    assert got == {i: f"t{i}!" for i in range(40)}


def test_fetch_errors(spark):
    from quillstream.operators import intake as I

    cases = [(200, False, None), (429, False, "rate_limit"), (403, True, "rate_limit"), (403, False, "forbidden"), (404, False, "not_found"), (503, False, "server"), (418, False, "http")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, s int, l boolean, want string")
    assert [r.got for r in df.orderBy("i").select(I.fetch_error(F.col("s"), F.col("l")).alias("got")).collect()] == [c[2] for c in cases]
    with pytest.raises(ValueError):
        I.updated(df, df.withColumn("x", F.lit(1)), "i")


def test_upsert_nulls_match_nothing(spark):
    rows = [(1, 1, None, "f1"), (2, 1, None, "f2"), (3, 1, "u", None), (4, 1, "v", None), (5, 1, "u", "f1"), (6, 1, None, "f2"), (7, 1, None, None), (8, 1, None, None)]
    got = P.first_wins(spark.createDataFrame(rows, "rowno long, source_id long, canonical_url string, fingerprint string")).collect()
    assert {r.rowno: r["into"] for r in got} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3, 6: 2, 7: 7, 8: 8}


def test_rule_pack_is_checked_whole(spark):
    """Every fault of a pack is named at once; a good one scores by its own settings."""
    import pytest

    from quillstream.operators import rules as R
    from quillstream.plans.classification_queries import _PACK_TEXT
    from quillstream.sources.rule_packs import PackError, load_pack, pack_table

    settings, rules = load_pack(_PACK_TEXT)
    assert settings.title_weight == 3 and settings.global_negatives == (("lost in", 4.0),) and [r.priority for r in rules] == list(range(50, 56))
    table = pack_table(spark, rules).collect()
    assert len(table) == 12 and {r.points for r in table if r.kind == "phrase"} == {3.0, 4.0, 5.0, 6.0, 7.0, 8.0}
    first = spark.createDataFrame([("of the with", "lost in")], "t string, s string").select(R.category_score(rules[0], F.col("t"), F.col("s"), settings).alias("x")).first()
    assert first.x == 3 * 3 * 2 + 2 * 3 - 4
    bad = {
        "minimum_score: 5": ("minimum_score: -1", "settings.minimum_score"), "title_weight: 3": ("title_weight: 1", "title_weight"), '"lost in": -4': ('"lost in": 4', "negative number"), "priority: 50": ("priority: high", "model_technology.priority"),
        "{\"of the\": 3}": ('{"of the": 3, "OF  the": 2}', "once normalised"), "keywords: {\"with\": 2}": ('keywords: {"with": .nan}', "positive number"), "  solicitation:": ("  other:", "unknown key other"), "phrase_weight: 2": ("phrase_weight: 2, phrase_weight: 3", "key given twice"),
    }
    for good, (broken, fault) in bad.items():
        assert good in _PACK_TEXT
        with pytest.raises(PackError, match=fault):
            load_pack(_PACK_TEXT.replace(good, broken))
    with pytest.raises(PackError) as e:
        load_pack(_PACK_TEXT.replace("minimum_score: 5", "minimum_score: x").replace("priority: 51", "priority: 1.5"))
    assert len(str(e.value).split("\n")) == 2


def test_case_states_and_differences(spark):
    """Details decide between a lead and a case; a change in any one of five fields counts, nulls are equal."""
    from quillstream.operators import taxonomy as X

    a, b, c, d = (X.CASE_DIMENSIONS[k][0] for k in "ABCD")
    sign = X.CASE_SIGNALS[0]
    cases = [
        ("case_analysis", f"{sign} {a}", False, "case_lead"), ("case_analysis", f"{sign} {a}", True, "partial_case"), ("product_update", f"{a} {b} {d}", True, "full_case"), ("product_update", f"{a} {b} {c}", True, "not_case"),
        ("award_result", sign, True, "case_lead"), ("product_update", sign, False, "not_case"), ("case_analysis", "", True, "not_case"),
    ]
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(cases)], "i int, kind string, text string, detailed boolean, want string")
    assert [r for r in rows.withColumn("got", X.case_state(F.col("kind"), F.col("text"), F.col("detailed"))).collect() if r.got != r.want] == []
    keys = ["primary_type", "topics", "industries", "case_completeness", "version"]
    base = ("a", "b", "c", "d", None)
    variants = [base] + [tuple("z" if j == i else x for j, x in enumerate(base)) for i in range(5)]
    table = spark.createDataFrame([(i, *v) for i, v in enumerate(variants)], "i int, " + ", ".join(f"{k} string" for k in keys))
    got = table.select("i", X.differs({k: F.lit(v).cast("string") for k, v in zip(keys, base, strict=True)}, {k: F.col(k) for k in keys}).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == [False] + [True] * 5
