"""The tree, single pages, records, plans, sources and streams."""

import pytest
from pyspark.sql import functions as F

from gleanmill.operators import dom, page, records, stops
from gleanmill.plans import requests, rounds
from gleanmill.sources import files
from gleanmill.sources.shared import small
from gleanmill.streaming import streams


def tags(html):
    return [(x.tag, x.parent.tag) for x in dom.parse(html).walk() if x.parent is not None and not x.is_text]


def test_recovery():
    assert tags("<p>a<p>b<ul><li>x<li>y<ul><li>z</ul></ul>") == [("p", "#document"), ("p", "#document"), ("ul", "#document"), ("li", "ul"), ("li", "ul"), ("ul", "li"), ("li", "ul")]
    assert tags("<table><tr><td>1<td>2<tr><td>3</table>") == [("table", "#document"), ("tr", "table"), ("td", "tr"), ("td", "tr"), ("tr", "table"), ("td", "tr")]
    assert tags("<div><b>x</div></b><i>y") == [("div", "#document"), ("b", "div"), ("i", "#document")]
    assert tags("<script>if (a<b) '</p>'</script><br><br/>") == [("script", "#document"), ("br", "#document"), ("br", "#document")]
    assert tags(None) == tags("") == tags("<!-- x -->") == []


def test_units_leave_out_useless_and_blank():
    root = dom.parse('<div>ab<script>x</script><span style="display:none">y</span><a href="/">cde</a> \n<i>é</i></div>')
    units = dom.Units(root)
    assert units.size(root) == 7 and units.size(root, 1) == 4 and units.size(root, 2) == 3
    assert units.text(root) == "ab cde é"


def test_text_units_relation_agrees_with_the_tree(spark):
    html = '<html><body><div>ab <b>cd</b><script>x</script></div><a href="/x">link<i>in</i></a><p style="display:none">no</p></body></html>'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    got = {r["unit"]: (r["total_bytes"], r["plain_bytes"]) for r in dom.text_units(pages).collect()}
    root = dom.parse(html)
    units = dom.Units(root)
    assert got == {x.ordinal: (units.size(x), units.size(x, 1)) for x in root.walk() if not x.is_text and units.has(x)}


def test_text_units_count_references_as_they_stand(spark):
    pages = spark.createDataFrame([(1, '<p>a&amp;b&amp</p><a href="/x">&lt;c&lt</a>')], "page_id long, html string")
    got = {r["unit"]: (r["total_bytes"], r["link_bytes"], r["text"]) for r in dom.text_units(pages).collect()}
    assert got == {0: (12, 5, "a&b&amp <c&lt"), 1: (7, 0, "a&b&amp"), 3: (5, 5, "<c&lt")}


def test_text_units_of_pages_cut_anywhere_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    from gleanmill import queries

    html = '<html><head><title>a &amp; b</title></head><body><!-- c -- > <p>d --><ul><li><a href="/x">e</a></li></ul><p>f<br>g &lt;h</p></body></html>'
    spark.createDataFrame([(k, html[:k]) for k in range(len(html) + 1)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    names = ["page_id", "unit", "total_bytes", "plain_bytes", "link_bytes", "texts", "link_texts", "text", "link_rate"]
    got = sorted(tuple(r) for r in queries.text_units(spark, str(tmp_path)).select(names).collect())
    sql = queries.ORACLES["text_units"].replace("FROM pages", f"FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == sorted(duckdb.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall())
    assert [r[7] for r in got if r[:2] == (len(html), 0)] == ["a & b e f g <h"]


def test_text_units_of_pages_with_scripts_cut_anywhere_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    from gleanmill import queries

    html = '<html><head><style>p{margin:0}</style><script src="/s.js"></script><title>a</title></head><body><p>b<script>var t="</p>";track(0);</script><a href="/x">c<style></style>d</a></body></html>'
    odd = ["<p>a<style>b<script>c</script>d", "<script>a<p>b</p>", "<style>a<style>b</style>c", "<script>a</scr><p>b", "<script><script>a<p>b", "<style></style><script/><p>a"]
    pages = [*(html[:k] for k in range(len(html) + 1)), *odd]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    names = ["page_id", "unit", "total_bytes", "plain_bytes", "link_bytes", "texts", "link_texts", "text", "link_rate"]
    got = sorted(tuple(r) for r in queries.text_units(spark, str(tmp_path)).select(names).collect())
    sql = queries.ORACLES["text_units"].replace("FROM pages", f"FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == sorted(duckdb.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall())
    assert [r[7] for r in got if r[:2] == (len(html), 0)] == ["a b c d"]


def test_scripts_without_an_end_have_no_content():
    assert tags("<script>a<p>b<style>c<i>d") == [("script", "#document"), ("p", "#document"), ("style", "p"), ("i", "p")]
    assert tags("<div><style>a</script><p>b</div><script>c</script>") == [("div", "#document"), ("style", "div"), ("p", "div"), ("script", "#document")]
    many = dom.parse("<script>a" * 200_000)
    assert sum(x.is_text for x in many.walk()) == 200_000


def test_comments_and_what_a_page_end_cuts_short():
    def texts(html):
        return [x.text for x in dom.parse(html).walk() if x.is_text]

    assert texts("a<!-- b -- > c -->d") == ["a", "d"]
    assert texts('a<p class="b') == ["a", 'p class="b'] and texts("a</p") == ["a", "/p"] and texts("a<") == ["a"]
    assert texts("a<!-- b &amp; c") == ["a", "!-- b & c"] and texts("a<!-- b <i>c") == ["a", "c"]


def test_titles():
    assert page.title_of(dom.parse("<html><title>News about cats - site</title><h1>Other things here now</h1><h2>News about cats</h2></html>"))[0] == "News about cats"
    assert page.title_of(dom.parse("<html><title>abcdef</title><h1>Something wholly different</h1></html>"))[0] == "Something wholly different"
    assert page.title_of(dom.parse("<html><p>x</p></html>")) == (None, None)


def test_page_titles_with_references():
    for raw, title in (("a&amp", "a&amp"), ("a&&amp; &am", "a&& &am"), ("&lt;b&gt &#65; &#65", "<b&gt A &#65"), ("&nosuch; &ampx; &copy;2", "&nosuch; &ampx; ©2")):
        assert page.title_of(dom.parse(f"<html><title>{raw}</title></html>"))[1] == title


def test_page_title_query_on_odd_pages(spark, tmp_path):
    import duckdb

    from gleanmill import queries

    html = ["<html><title>a</title><body><svg><title>b</title></svg></body></html>", "<title>a</title><title>b</title>", "<title> \n</title><p>x</p>", "<title></title>", "<p>x</p>", "x", " ", "", None]
    spark.createDataFrame([(k, "http://h/", x) for k, x in enumerate(html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["page_title"] for r in queries.page_title(spark, str(tmp_path)).collect()}
    assert got == dict(duckdb.sql(queries.ORACLES["page_title"].replace("FROM pages", f"FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")).fetchall())
    assert got == dict(enumerate(["a", "a", "", "", "", "", "", "", None]))


def test_a_page_title_has_all_of_its_texts():
    assert page.title_of(dom.parse("<html><title>a <3 b &amp c</title><p>x</p></html>"))[1] == "a <3 b &amp c"


def test_a_child_with_just_the_share_is_not_alone():
    for whole in range(10, 1_000, 10):
        most, rest = "x" * (whole * 7 // 10), "y" * (whole * 3 // 10)
        assert page.content_of(dom.parse(f"<html><body><div>{most}</div><p>{rest}</p></body></html>")) == f"{most} {rest}"
        assert page.content_of(dom.parse(f"<html><body><div>{most}x</div><p>{rest[1:]}</p></body></html>")) == f"{most}x"


def test_content_keeps_references_that_are_cut_short():
    found = dom.parse("<html><title>a &amp; b&amp</title><body><h1>a &amp; b&amp</h1></body></html>")
    assert page.title_of(found)[0] == page.content_of(found).split(" a ")[0] == "a & b&amp"


def test_next_page_edges():
    assert page.next_page_of(dom.parse('<a href="?p=3">3</a><a href="?p=2">2</a>'), "http://h/x?p=1") == "http://h/x?p=2"
    assert page.next_page_of(dom.parse('<a href="?p=1">1</a>'), "http://h/x?p=1") is None
    assert page.next_page_of(dom.parse('<a href="http://h/x?p=10">10</a><a href="http://h/x?p=9">9</a>'), "http://h/x?p=8") == "http://h/x?p=9"
    assert page.next_page_of(dom.parse('<a href="/?pageIndex=3">下一页</a>'), "http://h/x?a=1&p=2") == "http://h/x?a=1&p=3"
    assert page.next_page_of(dom.parse("<a>x</a>"), "bad") is None


def test_pages_without_records(spark):
    pages = spark.createDataFrame([(1, "http://h/", None), (2, "http://h/", "plain"), (3, None, "<p>one</p>")], "page_id long, url string, html string")
    assert records.extract_records(pages, F.lit("2024-01-01").cast("timestamp")).count() == 0
    assert [r["content"] for r in page.page_facts(pages, "content").orderBy("page_id").collect()] == ["", "plain", "one"]


def test_all_linkless_children_are_dropped():
    items = "".join(f"<li>no link number {k}</li><li>no link either {k}</li><li><a href='/{k}'>a title of some length {k}</a> and a text that goes on for longer than its title {k}</li>" for k in range(5))
    root = dom.parse(f"<html><body><ul>{items}</ul></body></html>")
    units = dom.Units(dom.root_of(root), 400)
    assert len(records.region(root, units)[1]) == 5


def test_parts_of_a_record_may_lie_deep():
    inner = "<h3><a href='/1'>A title that is long enough</a></h3><p>" + "words " * 55 + "</p>"
    for k in range(12):
        inner = f"<div><i>side {k:03d}</i>{inner}</div>" if k == 11 else f"<i>side {k:03d}</i><div>{inner}</div>"
    root = dom.parse(f"<html><body>{inner}</body></html>")
    units = dom.Units(dom.root_of(root), 400)
    item = next(x for x in root.walk() if x.tag == "div")
    got = records.take_apart(item, units, "http://h/s", True)
    assert got["title"] == "A title that is long enough" and got["summary"].startswith("words words")


def test_date_in_the_summary_is_cut_out(spark):
    item = lambda k: f"<div><h3><a href='/{k}'>A title that is long {k}</a></h3><p>{'words ' * 20}2020-01-0{k} 10:11:12 {'more ' * 5}</p></div>"
    pages = spark.createDataFrame([(1, "http://h/s", "<html><body><div>" + "".join(map(item, range(1, 5))) + "</div></body></html>")], "page_id long, url string, html string")
    got = records.extract_records(pages, F.lit("2024-01-01").cast("timestamp")).orderBy("rank").collect()
    assert [r["date"] for r in got] == [f"2020-01-0{k} 10:11" for k in range(1, 5)]
    assert all("2020" not in r["summary"] for r in got)


def test_empty_runs_are_per_keyword(spark):
    rows = [("s", k, i, 0, 0) for k in "ab" for i in range(4)] + [("s", "a", 4, 0, 0), ("s", "a", 5, 1, 0)]
    df = spark.createDataFrame(rows, "site string, keyword string, page_idx long, new_cnt int, dup_cnt int")
    got = {(r["keyword"], r["page_idx"]): (r["stop"], r["live"]) for r in stops.stop_rule(df, ["site", "keyword"]).collect()}
    assert [k for k, v in got.items() if v[0]] == [("a", 4)] and not got["a", 5][1]


SITE = """[TEMPLATE]
TASK_TYPE = 博客
REQUEST_URL = http://s.example/q?w={0}&p={1}
SEARCH_IN_SITE = None
DUP_METHOD = title
PAGE_TOTAL_CNT = 2
TIMEOUT_SEC = 0
REQUEST_HEADERS = {"User-Agent": "x"}
"""


def test_a_bad_number_takes_its_default():
    row = files.parse_site("x", SITE.replace("PAGE_TOTAL_CNT = 2", "PAGE_TOTAL_CNT = many"))
    assert row[8] == 50 and files.parse_site("x", "[TEMPLATE]\nREQUEST_URL = None\n") is None


def test_sources(spark, tmp_path):
    (tmp_path / "a.dat").write_text(SITE)
    (tmp_path / "b.dat").write_text("[TEMPLATE]\nREQUEST_URL = short\n")
    (tmp_path / "c.txt").write_text(SITE)
    sites = files.read_sites(spark, str(tmp_path))
    row = sites.collect()
    assert len(row) == 1 and row[0]["dup_method"] == "TITLE" and row[0]["timeout_sec"] == 40 and row[0]["headers"] == {"User-Agent": "x"} and row[0]["search_in_site"] == ""
    assert [r["parser"] for r in requests.dispatch(sites).collect()] == ["search"]
    (tmp_path / "kw").mkdir()
    (tmp_path / "kw/k.txt").write_text("one two \n\n  \nthree\n")
    keywords = files.read_keywords(spark, str(tmp_path / "kw"))
    plan = requests.plan_requests(sites, keywords).orderBy("keyword", "page_idx").collect()
    assert [p["url"] for p in plan][:2] == ["http://s.example/q?w=one+two&p=1", "http://s.example/q?w=one+two&p=2"]
    assert {r["path"].rsplit("/", 1)[-1] for r in files.list_files(spark, str(tmp_path)).collect()} == {"a.dat", "b.dat"}
    (tmp_path / "list.tsv").write_text("1\thttp://a \n2\t\n")
    assert files.read_page_list(spark, str(tmp_path / "list.tsv")).collect() == [("1", "http://a")]
    config = files.EngineConfig.parse("[A]\nkeyword_file = k\neach_fetch_count = 7\n[B]\nport = 80\n")
    assert (config.keyword_file, config.fetch_count, config.stat_port) == ("k", 7, 80)
    with pytest.raises(ValueError):
        files.EngineConfig.parse("[A]\neach_fetch_count = 0\n")


def test_fetched_stream_and_batch_agree(spark, tmp_path):
    folder = str(tmp_path / "fetched")
    rows = [(k, f"http://h/{k}", bytearray(b"x") if k % 2 else None, "", None) for k in range(6)]
    spark.createDataFrame(rows, files.FETCHED).write.parquet(folder)
    stream = files.read_fetched(spark, folder, stream=True)
    out = []
    stream.writeStream.foreachBatch(lambda b, _: out.extend(r["fetch_id"] for r in b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(out) == sorted(r["fetch_id"] for r in files.read_fetched(spark, folder).collect()) == [1, 3, 5]


ITEM = "<div><h3><a href='/{0}'>A title that is long {0}</a></h3><p>" + "words " * 20 + "</p></div>"
ITEMS = "".join(ITEM.format(k) for k in range(5))
HARD_PAGES = {
    "deep": "<html><body>" + "<div><i>x</i>" * 5000 + "<a href='/1'>a title that is long</a> words" + "</div>" * 5000 + "</body></html>",
    "wide": "<html><body><div>" + "<p><a href='/1'>a link text that is long</a> some words</p>" * 50_000 + "</body></html>",
    "unclosed": "<html><body>" + "<b><a href='/x'>some text" * 4000,
    "records far down": "<div>" * 900 + ITEMS,
    "open items": "<ul><li>" + "<b>" * 5000 + "<li>" * 20_000,
    "loose ends": "<b>" * 5000 + "</x>" * 50_000 + "</i>" * 50_000,
    "many roots": "<html>" * 3000 + "x",
    "declarations": "<![foo[x]]>a<![foo bar>b<![CDATA[c>d]]>e<![if !IE]>f<![endif]><![",
    "cut off": "<p>a<![foo",
}


def test_hard_pages(spark):
    """Deep, wide and malformed pages neither crash nor take time that grows with the square of their nodes."""
    import time

    began = time.time()
    pages = spark.createDataFrame([(k, "http://h/s?p=1", html) for k, html in enumerate(HARD_PAGES.values())], "page_id long, url string, html string").repartition(4)
    parts = records.record_parts(pages).groupBy("page_id").count().collect()
    assert {list(HARD_PAGES)[r["page_id"]]: r["count"] for r in parts} == {"wide": 50_000, "records far down": 5}
    facts = {list(HARD_PAGES)[r["page_id"]]: r for r in page.page_facts(pages, *page._FACTS).collect()}
    assert facts["declarations"]["content"].replace(" ", "").startswith("abef") and len(facts["wide"]["links"]) == 50_000
    assert dom.dom_nodes(pages.where("page_id <> 0")).count() > 200_000
    assert time.time() - began < 90


def test_paths_and_numbers():
    root = dom.parse("<div><p>a<p>b<i>c</i><p>d</div>")
    paths = {x.text: x.path for x in root.walk() if x.is_text}
    assert paths["c"] == "#document[1]/div[1]/p[2]/i[1]/text()[1]" and paths["d"] == "#document[1]/div[1]/p[3]/text()[1]"
    assert [x.tag for x in records.at_path(root, "div/p[2]/i")] == ["i"] and len(records.at_path(root, "div/p")) == 3 and records.at_path(root, "ul/li") == []


def test_a_round_parses_each_page_once(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    pages = spark.createDataFrame([(1, "http://h/s", f"<html><body><div>{ITEMS}</div></body></html>")], "page_id long, url string, html string")
    seen = spark.createDataFrame([("http://h/2",)], "dedup_key string")
    assert plan(records.record_parts(pages)).count("MapInArrow") == 1
    new, messages = rounds.pages_round(pages, seen, F.lit("2024-01-01").cast("timestamp"))
    assert sorted(r["link"] for r in new.collect()) == [f"http://h/{k}" for k in (0, 1, 3, 4)] and messages.count() == 1
    assert "MapInArrow" not in plan(messages)


def test_settings_of_sites_hold(spark):
    """Unknown hosts and damaged bodies are left out; a TITLE site tells records apart by title and summary; empty pages count."""
    html = f"<html><head></head><body><div>{ITEMS}</div></body></html>".encode()
    rows = [(1, "http://a.example/s", html, "", 0), (2, "http://b.example/s", html, "", 0), (3, "http://c.example/s", html, "", 0), (4, "http://a.example/s", b"\x1f\x8bbad", "X: y\r\nContent-Encoding: gzip\r\n", 1), (5, "http://a.example/s", b"nothing", "", 2)]
    fetched = spark.createDataFrame(rows, "fetch_id long, url string, body binary, headers string, page_idx int")
    sites = spark.createDataFrame([("http://a.example/q", requests.BLOG, "LINK", True), ("http://b.example/q", requests.FORUM, "TITLE", False), ("http://a.example/z", requests.FORUM, "TITLE", False)], "request_url string, task_type string, dup_method string, stop_turn_page boolean")
    seen = spark.createDataFrame([("http://a.example/1",), ("A title that is long 2" + ("words " * 20)[:20],)], "dedup_key string")
    found = rounds.fetched_round(fetched, sites, seen, F.lit("2024-01-01").cast("timestamp"))
    new = {(r["fetch_id"], r["link"]) for r in found.new.collect()}
    assert new == {(1, f"http://a.example/{k}") for k in (0, 2, 3, 4)} | {(2, f"http://b.example/{k}") for k in (0, 1, 3, 4)}
    counts = {r["fetch_id"]: (r["new_cnt"], r["dup_cnt"], r["stop_turn_page"]) for r in found.counts.collect()}
    assert counts == {1: (4, 1, True), 2: (4, 1, False), 4: (0, 0, True), 5: (0, 0, True)}
    assert {r["fetch_id"]: r["stop"] for r in found.stops(["host"]).collect()} == {1: False, 2: False, 4: False, 5: False}


def test_broadcasts_are_bounded(spark):
    plan = lambda most: spark.range(9).join(small(spark.range(5), most), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(5) and "broadcast" not in plan(4)


def test_requests_chain_over_pages(spark):
    rows = [("s", i, k, f"u{i}{k}") for i in (0, 1, 3) for k in "ab"] + [("t", 0, "a", "v")]
    chain = requests.request_chain(spark.createDataFrame(rows, "site string, page_idx int, keyword string, url string"))
    assert {r["url"]: r["previous_url"] for r in chain.collect()} == {"u0a": None, "u0b": "u0a", "u1a": "u0b", "u1b": "u1a", "u3a": "u1b", "u3b": "u3a", "v": None}


def test_messages_are_posted_at_intervals(spark, tmp_path):
    import time

    spark.createDataFrame([("m1",), ("m2",)], "tasks_json string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("tasks_json string").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")

    def send(lines):
        import uuid

        with open(f"{out}-{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(lines))

    run = streams.post_messages(stream, str(tmp_path / "c"), send, "1 second")
    spark.createDataFrame([("m3",)], "tasks_json string").write.mode("append").parquet(str(tmp_path / "in"))
    got = []
    for _ in range(60):
        got = sorted(line for f in tmp_path.glob("out-*") for line in f.read_text().split("\n") if line)
        if len(got) == 3:
            break
        time.sleep(0.5)
    run.stop()
    assert got == ["m1", "m2", "m3"]
