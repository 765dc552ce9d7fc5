"""The registered queries of the mining engine, each with its DuckDB SQL.

Each applies an operator to a whole table. Where a table lacks what an
operator reads, known rows are rendered into it (result pages, feeds, dates in
text) and the SQL gives the rows that went in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates, normalize, publishers, text, urls
from .operators import dedup, dom, page, records, stats, stops, tasks
from .plans import requests, rounds
from .sources import files
from .sources.shared import shared_folder
from .streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def when(ts: str) -> Column:
    return F.lit(ts).cast("timestamp")


HOST = "nullif(regexp_extract(url, '^[^:/]+://([^/?]*)', 1), '')"


@query(f"""WITH p AS (SELECT {HOST} AS host, url FROM pages WHERE url IS NULL OR NOT (strpos(url, '&query=') > 1 OR strpos(url, '/ns?word=') > 1))
SELECT host, count(DISTINCT coalesce(url, '')) AS pages FROM p GROUP BY host""")
def host_page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by host, after the link rules and deduplication by link."""
    pages = dedup.rule_filter(table(spark, sf_dir, "pages").select("page_id", "url"), "url")
    once = dedup.first_of_all(pages, "url", "page_id")
    return once.groupBy(urls.authority(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("pages"))


_B = "' ' || chr(9) || chr(13) || chr(10)"


@query(f"""SELECT doc_id, trim(text, {_B}) = text AS is_stripped, md5(trim(text, {_B})) AS stripped,
CAST(len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {_B})), lambda x: x <> '')) AS INTEGER) AS parts,
md5(translate(text, chr(9) || chr(13) || chr(10), '')) AS flat, md5(translate(text, ' ' || chr(13) || chr(10), '')) AS squeezed FROM documents""")
def strip_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", (text.strip(t) == t).alias("is_stripped"), F.md5(text.strip(t).cast("binary")).alias("stripped"), F.size(text.split_strip(t, "\n")).alias("parts"),
        F.md5(text.drop_breaks(t).cast("binary")).alias("flat"), F.md5(text.squeeze(t).cast("binary")).alias("squeezed"),
    )


@query("SELECT doc_id, strlen(text) AS bytes, length(text) AS chars FROM documents")
def byte_char_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("bytes"), F.length("text").alias("chars"))


@query("SELECT page_id, md5(regexp_replace(html, '<[^>]*>', '', 'g')) AS plain FROM pages")
def tag_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.strip_tags(F.col("html")).cast("binary")).alias("plain"))


@query("""WITH s AS (SELECT doc_id, 'about ' || doc_id || ' ' || lang || chr(10) || source AS head FROM documents)
SELECT doc_id, replace(head, chr(10), ' ') AS summary FROM s""")
def summary_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cut marker in a summary's second half, and what follows it, goes."""
    head = F.concat(F.lit("about "), F.col("doc_id").cast("string"), F.lit(" "), F.col("lang"), F.lit("\n"), F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_summary(F.concat(F.lit(" "), head, F.lit(" ...more"))).alias("summary"))


_ENC = "replace(url_encode({}), '%20', '+')"


@query("SELECT trim(p_name) AS keyword, count(*) AS n FROM part WHERE trim(p_name) <> '' GROUP BY ALL")
def keyword_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords written to text files, between blank lines, and read back."""
    path = shared_folder(spark, "keywords")
    table(spark, sf_dir, "part").select(F.concat(F.lit(" "), F.col("p_name"), F.lit(" \n\n"))).write.text(path)
    return files.read_keywords(spark, path).groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(page_id AS VARCHAR) AS line_id, url FROM pages WHERE page_id % 3 <> 0")
def page_list_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tab-separated list of pages, every third without an address."""
    path = shared_folder(spark, "pages")
    line = F.concat(F.col("page_id").cast("string"), F.lit("\t"), F.when(F.col("page_id") % 3 == 0, " ").otherwise(F.col("url")))
    table(spark, sf_dir, "pages").select(line).write.text(path)
    return files.read_page_list(spark, path)


@query("SELECT page_id AS fetch_id, md5(html) AS body FROM pages WHERE page_id % 4 <> 1")
def fetched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched pages in files, every fourth of which failed, as a stream of new files."""
    folder = shared_folder(spark, "fetched")
    k = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select(k.alias("fetch_id"), "url", F.when(k % 4 != 1, F.col("html").cast("binary")).alias("body"), F.lit("").alias("headers"), F.lit(None).cast("timestamp").alias("fetch_ts"))
    rows.write.parquet(folder)
    return _finished(files.read_fetched(spark, folder, stream=True).select("fetch_id", F.md5("body").alias("body")), "fetched", "append", ["fetch_id", "body"])


@query(f"SELECT p_partkey, {_ENC.format('p_name')} AS encoded, {_ENC.format("'site:x ' || p_name")} AS with_site FROM part")
def keyword_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", urls.encode_keyword(F.col("p_name")).alias("encoded"), urls.encode_keyword(F.col("p_name"), F.lit("site:x")).alias("with_site"))


@query("SELECT p_partkey, p_name AS keyword FROM part")
def keyword_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", urls.decode_keyword(urls.form_encode(F.col("p_name"))).alias("keyword"))


@query(f"SELECT p_partkey, {_ENC.format('p_name')} || '+%D6%D0' AS encoded FROM part")
def keyword_encode_gbk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", urls.encode_keyword(F.concat(F.col("p_name"), F.lit(" 中")), charset="gbk").alias("encoded"))


LINKS = ("/a/b?x=1", "?page=3", "item?id=7", "http://other.example/x", " //cdn.example/y ")


@query(f"""WITH l AS (SELECT page_id, url, unnest({list(LINKS)!r}) AS raw FROM pages), t AS (SELECT *, trim(raw) AS link, regexp_replace(url, '[?][^?]*$', '') AS base FROM l)
SELECT page_id, raw AS link, CASE WHEN link LIKE '/%' THEN regexp_extract(url, '^([^:/]+)://', 1) || '://' || {HOST} || link WHEN link LIKE '?%' THEN base || link
WHEN link NOT LIKE 'http%' THEN base || '?' || string_split(link, '?')[-1] ELSE link END AS absolute FROM t""")
def link_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.array(*map(F.lit, LINKS))).alias("link"))
    return each.select("page_id", "link", urls.normalise_link(F.col("link"), F.col("url")).alias("absolute"))


@query(f"SELECT page_id, {HOST} AS host, regexp_replace(url, '[?][^?]*$', '') AS base, CASE WHEN strpos(url, '?') > 0 THEN string_split(url, '?')[-1] END AS query FROM pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.authority(u).alias("host"), urls.before_query(u).alias("base"), urls.query_of(u).alias("query"))


def _part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", F.col("p_name").alias("a")).join(part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b")), "p_partkey")


_PAIRS = "SELECT x.p_partkey, x.p_name AS a, y.p_name AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1"


@query(f"WITH p AS ({_PAIRS}) SELECT p_partkey, levenshtein(a, b) AS distance FROM p")
def edit_distance_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_pairs(spark, sf_dir).select("p_partkey", F.levenshtein("a", "b").alias("distance"))


@query(f"""WITH p AS ({_PAIRS}), s AS (SELECT p_partkey, CASE WHEN length(a) > length(b) THEN b ELSE a END AS s, CASE WHEN length(a) > length(b) THEN a ELSE b END AS l FROM p)
SELECT p_partkey, min(levenshtein(substr(s, k + 1), l)) AS distance FROM s, unnest(range(0, length(s) + 1)) AS r(k) GROUP BY p_partkey""")
def edit_distance_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_pairs(spark, sf_dir).select("p_partkey", text.edit_distance_semi(F.col("a"), F.col("b")).alias("distance"))


@query("""WITH p AS (SELECT page_id, unnest(string_split(string_split(url, '?')[-1], '&')) AS kv FROM pages WHERE strpos(url, '?') > 0)
SELECT page_id, string_split(kv, '=')[1] AS key, coalesce(string_split(kv, '=')[2], '') AS value,
CASE WHEN regexp_full_match(string_split(kv, '=')[2], '[0-9]+') THEN try_cast(string_split(kv, '=')[2] AS BIGINT) END AS number FROM p WHERE kv <> ''""")
def query_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.inline(urls.query_params(F.col("url"))))


def _paged(spark: SparkSession, sf_dir: str, marked: bool) -> DataFrame:
    """List pages: page 2 of a category, with links to pages 1 to 5; the one to page 4 says 'next' if ``marked``."""
    base = F.concat(F.lit("http://list.example/c?cat="), F.col("page_id").cast("string"), F.lit("&page="))
    a = [F.concat(F.lit('<a href="'), base, F.lit(f'{k}">'), F.lit("下一页" if marked and k == 4 else f"page {k}"), F.lit("</a>")) for k in (5, 1, 3, 4, 2)]
    return table(spark, sf_dir, "pages").select("page_id", F.concat(base, F.lit("2")).alias("url"), F.concat(F.lit("<html><body>"), *a, F.lit("</body></html>")).alias("html"))


@query("SELECT page_id, 'http://list.example/c?cat=' || page_id || '&page=3' AS next_page FROM pages")
def next_page_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page.page_facts(_paged(spark, sf_dir, False), "next_page").select("page_id", "next_page")


@query("SELECT page_id, 'http://list.example/c?cat=' || page_id || '&page=4' AS next_page FROM pages")
def next_page_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page.page_facts(_paged(spark, sf_dir, True), "next_page").select("page_id", "next_page")


def _keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.distinct_keywords(table(spark, sf_dir, "part").select(F.col("p_name").alias("keyword")))


_KW = "SELECT DISTINCT trim(p_name) AS keyword FROM part WHERE trim(p_name) <> ''"


@query(_KW)
def keyword_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keywords(spark, sf_dir)


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("s"), key.cast("string")).alias("site"), F.concat(F.lit("http://s"), key.cast("string"), F.lit(".example/q?w={0}&p={1}")).alias("request_url"),
        F.lit("").alias("search_in_site"), F.lit(1).alias("page_start"), F.lit(10).alias("page_increase"), F.lit(3).alias("page_total"), F.when(key % 2 == 0, "w={0}").otherwise("").alias("post_data"),
    )


_PLAN = f"""SELECT 's' || n_nationkey AS site, keyword, CAST(i AS INTEGER) AS page_idx, CAST(1 + 10 * i AS INTEGER) AS page_no,
'http://s' || n_nationkey || '.example/q?w=' || {_ENC.format("keyword")} || '&p=' || (1 + 10 * i) AS url,
CASE WHEN n_nationkey % 2 = 0 THEN 'w=' || {_ENC.format("keyword")} ELSE '' END AS post_data, CASE WHEN n_nationkey % 2 = 0 THEN 'POST' ELSE 'GET' END AS method
FROM nation, ({_KW}) k, range(0, 3) AS r(i)"""


@query(_PLAN)
def request_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.plan_requests(_sites(spark, sf_dir), _keywords(spark, sf_dir))


@query(f"WITH r AS ({_PLAN}) SELECT site, keyword, page_idx, lag(url) OVER (PARTITION BY site ORDER BY page_idx, keyword) AS previous_url FROM r")
def referer_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.request_chain(request_plan(spark, sf_dir)).select("site", "keyword", "page_idx", "previous_url")


@query(f"""WITH r AS ({_PLAN}), l AS (SELECT site, page_idx + 1 AS page_idx, arg_max(url, keyword) AS referer FROM r GROUP BY site, page_idx)
SELECT r.site, r.keyword, r.page_idx, l.referer FROM r LEFT JOIN l USING (site, page_idx)""")
def round_referer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.with_referer(request_plan(spark, sf_dir)).select("site", "keyword", "page_idx", "referer")


@query(f"WITH r AS ({_PLAN}) SELECT site, count(*) AS requests FROM r WHERE NOT (site = 's3' OR keyword LIKE 'a%') GROUP BY site")
def live_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests left when one site and all keywords in ``a`` are cancelled."""
    plan = request_plan(spark, sf_dir)
    cancelled = plan.where((F.col("site") == "s3") | F.col("keyword").startswith("a")).select("site", "keyword").distinct()
    return requests.live_requests(plan, cancelled).groupBy("site").agg(F.count(F.lit(1)).alias("requests"))


@query(f"SELECT {HOST} AS host, min(page_id) AS page_id FROM pages GROUP BY 1")
def dedup_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(urls.authority(F.col("url")).alias("host"), "page_id")
    return dedup.first_of_all(pages, "host", "page_id")


_TITLE = f"trim(regexp_extract(text, '^[^{chr(10)}]*'), {_B}) || substr(trim(text, {_B}), 1, 20)"


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = dedup.dedup_key(F.lit("TITLE"), F.lit(""), F.substring_index("text", "\n", 1), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", key.alias("dedup_key"))


@query(f"SELECT md5({_TITLE}) AS key, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def dedup_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_of_all(_titled(spark, sf_dir), "dedup_key", "doc_id").select(F.md5(F.col("dedup_key").cast("binary")).alias("key"), "doc_id")


@query(f"SELECT source, md5({_TITLE}) AS key, max(doc_id) AS doc_id FROM documents GROUP BY 1, 2")
def dedup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.within_page(_titled(spark, sf_dir), "source", "dedup_key", "doc_id").select("source", F.md5(F.col("dedup_key").cast("binary")).alias("key"), "doc_id")


_SEEN = f"WITH d AS (SELECT doc_id, source, {_TITLE} AS k FROM documents), seen AS (SELECT DISTINCT k FROM d WHERE doc_id % 2 = 0), f AS (SELECT k, min_by(source, doc_id) AS source, min(doc_id) AS doc_id FROM d GROUP BY k), n AS (SELECT * FROM f WHERE k NOT IN (SELECT k FROM seen))"


@query(f"{_SEEN} SELECT doc_id, source FROM n")
def new_vs_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First documents of keys that no even document has."""
    docs = _titled(spark, sf_dir)
    return dedup.new_records(dedup.first_of_all(docs, "dedup_key", "doc_id"), docs.where("doc_id % 2 = 0"), "dedup_key").select("doc_id", "source")


@query(f"{_SEEN} SELECT source, (SELECT count(*) FROM n WHERE n.source = d.source) AS new_cnt, count(*) - (SELECT count(*) FROM n WHERE n.source = d.source) AS dup_cnt FROM d GROUP BY source")
def page_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _titled(spark, sf_dir)
    return dedup.page_counts(docs, docs.where("doc_id % 2 = 0"), "source", "dedup_key", "doc_id")


RULES = (("link_part", "page="), ("host_part", "example.net"))
_RULED = f"SELECT page_id, url FROM pages WHERE NOT (strpos(url, 'page=') > 1 OR coalesce({HOST}, '') LIKE '%example.net%')"


@query(_RULED)
def rule_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.rule_filter(table(spark, sf_dir, "pages").select("page_id", "url"), "url", ("page=",), (), ("example.net",))


@query(_RULED)
def rule_filter_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "kind string, value string")
    return dedup.rule_filter_table(table(spark, sf_dir, "pages").select("page_id", "url"), rules, "url")


def _counts(events: DataFrame) -> DataFrame:
    """Page counts: a user's events of a kind as pages in order of id, with counts from the id."""
    k = F.col("event_id")
    return events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("site"), F.col("event_type").alias("keyword"), k.alias("page_idx"), F.when(k % 5 == 0, 1).otherwise(0).alias("new_cnt"), F.when(k % 7 == 0, 2).otherwise(0).alias("dup_cnt"),
    )


_C = "SELECT 'u' || user_id AS site, event_type AS keyword, event_id AS page_idx, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS new_cnt, CASE WHEN event_id % 7 = 0 THEN 2 ELSE 0 END AS dup_cnt FROM events"
_RUNS = f"""WITH c AS ({_C}), n AS (SELECT *, row_number() OVER w AS pos FROM c WINDOW w AS (PARTITION BY site, keyword ORDER BY page_idx)),
r AS (SELECT *, pos - coalesce(max(CASE WHEN new_cnt + dup_cnt > 0 THEN pos END) OVER (PARTITION BY site, keyword ORDER BY page_idx), 0) AS empty_run FROM n)"""


@query(f"{_RUNS} SELECT site, keyword, page_idx, empty_run FROM r")
def empty_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stops.empty_runs(_counts(table(spark, sf_dir, "events")), ["site", "keyword"]).select("site", "keyword", "page_idx", "empty_run")


_STOPS = f"""{_RUNS}, s AS (SELECT *, (new_cnt = 0 AND dup_cnt > 0) OR empty_run >= 5 AS stop FROM r)
SELECT site, keyword, page_idx, stop, NOT coalesce(bool_or(stop) OVER (PARTITION BY site, keyword ORDER BY page_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS live FROM s"""


@query(_STOPS)
def stop_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stops.stop_rule(_counts(table(spark, sf_dir, "events")), ["site", "keyword"]).select("site", "keyword", "page_idx", "stop", "live")


@query("SELECT doc_id // 10 AS page, 'http://d.example/' || doc_id AS url, lang AS pubdate, 'Document ' || doc_id AS title, '' AS \"siteName\", '' AS \"channelName\", '新闻' AS \"siteType\", '-1' AS \"maxDepth\" FROM documents")
def task_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of ten documents each, taken apart again."""
    key = F.col("doc_id").cast("string")
    made = tasks.task(F.concat(F.lit("http://d.example/"), key), F.concat(F.lit("Document "), key), F.col("lang"), F.lit(requests.NEWS))
    docs = table(spark, sf_dir, "documents").withColumn("page", F.floor(F.col("doc_id") / 10))
    return tasks.read_messages(tasks.task_messages(docs, "page", "doc_id", made))


def _stat_rows(events: DataFrame) -> DataFrame:
    return events.select("ts", F.concat(F.lit("h"), (F.col("user_id") % 20).cast("string")).alias("host"), F.col("event_type").alias("keyword"), (F.col("event_id") % 5).cast("int").alias("new_cnt"), (F.col("event_id") % 3).cast("int").alias("dup_cnt"))


_S = "SELECT ts, 'h' || (user_id % 20) AS host, event_type AS keyword, event_id % 5 AS new_cnt, event_id % 3 AS dup_cnt FROM events"
_SUMS = "count(*) AS pages, CAST(sum(new_cnt) AS BIGINT) AS new, CAST(sum(dup_cnt) AS BIGINT) AS dup"


def _bucketed(width: str) -> str:
    return f"WITH s AS ({_S}) SELECT host, keyword, CAST(date_trunc('{width}', ts) AS VARCHAR) AS bucket, {_SUMS} FROM s GROUP BY ALL"


def _bucket_text(df: DataFrame) -> DataFrame:
    return df.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH:mm:ss"))


@query(_bucketed("hour"))
def stats_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bucket_text(stats.windowed(_stat_rows(table(spark, sf_dir, "events")), "1 hour"))


@query(_bucketed("day").replace("CAST(date_trunc('day', ts) AS VARCHAR)", "CAST(CAST(date_trunc('day', ts) AS TIMESTAMP) AS VARCHAR)"))
def stats_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bucket_text(stats.windowed(_stat_rows(table(spark, sf_dir, "events")), "1 day"))


@query(f"WITH s AS ({_S}) SELECT host, keyword, {_SUMS} FROM s GROUP BY ROLLUP (host, keyword)")
def stats_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.by_host(_stat_rows(table(spark, sf_dir, "events")))


_CURRENT = ", ".join(f"CAST(sum(CASE WHEN {c} THEN {v} ELSE 0 END) AS BIGINT) AS {w}_{n}" for w, c in (("hour", "date_trunc('hour', ts) = date_trunc('hour', m)"), ("day", "true")) for n, v in (("pages", "1"), ("new", "new_cnt"), ("dup", "dup_cnt")))


@query(f"WITH s AS ({_S}), t AS (SELECT *, (SELECT max(ts) FROM events) AS m FROM s) SELECT host, keyword, {_CURRENT} FROM t WHERE date_trunc('day', ts) = date_trunc('day', m) GROUP BY host, keyword")
def stats_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six counters as of the last event."""
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max("ts").alias("m")).first()["m"]
    return stats.current(_stat_rows(events), F.lit(last).cast("timestamp"))


@query(f"WITH s AS ({_S}), a AS (SELECT host, {_SUMS} FROM s GROUP BY host) SELECT host, '<tr><td>' || pages || '</td><td>' || new || '</td><td>' || dup || '</td></tr>' AS html FROM a")
def stats_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = stats.by_host(_stat_rows(table(spark, sf_dir, "events"))).where("keyword IS NULL AND host IS NOT NULL").drop("keyword")
    return stats.html_report(hosts, "host")


NOW = "2030-01-01 12:00:00"


def _order_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey and ts: the order's date with a time of day from its key."""
    ts = F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400)
    return table(spark, sf_dir, "orders").select("o_orderkey", ts.alias("ts"))


_O = "SELECT o_orderkey, o_orderdate + to_seconds(CAST(o_orderkey % 86400 AS BIGINT)) AS t FROM orders"


def _dates(spark: SparkSession, sf_dir: str, rendered: Column, found: Callable[[Column, Column], Column] = dates.extract_date) -> DataFrame:
    d = found(rendered, when(NOW))
    rows = _order_times(spark, sf_dir).select("o_orderkey", d.alias("d"))
    return rows.select("o_orderkey", "d.accuracy", F.date_format("d.ts", "yyyy-MM-dd HH:mm:ss").alias("found"))


def _expect(accuracy: int, shown: str = "strftime(t, '%Y-%m-%d %H:%M:%S')") -> str:
    return f"WITH o AS ({_O}) SELECT o_orderkey, {accuracy} AS accuracy, {shown} AS found FROM o"


def _shown(pattern: str, before: str = "", after: str = "") -> Column:
    return F.concat(F.lit(before), F.date_format("ts", pattern), F.lit(after))


@query(_expect(60))
def date_absolute_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dates(spark, sf_dir, _shown("yyyy年M月d日  HH:mm:ss", "港口消息 更新于 "))


@query(_expect(50, "strftime(t, '%Y-%m-%d %H:%M:00')"))
def date_absolute_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dates(spark, sf_dir, F.concat(_shown("yyyy/M/d HH:mm"), F.lit("")), lambda t, n: _zero_seconds(dates.extract_date(t, n)))


def _zero_seconds(d: Column) -> Column:
    return F.struct(d["accuracy"].alias("accuracy"), F.date_trunc("minute", d["ts"]).alias("ts"))


@query(_expect(30, "strftime(t, '%Y-%m-%d') || ' 10:00:00'"))
def date_absolute_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a time the hour is two before now's."""
    return _dates(spark, sf_dir, _shown("yyyy-MM-dd", "posted ", " by someone"))


@query(_expect(60))
def date_absolute_short_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dates(spark, sf_dir, _shown("yy年MM月dd HH点mm分ss"))


def _ago(name: str, unit: str, seconds: int, accuracy: int) -> None:
    sql = f"SELECT o_orderkey, {accuracy} AS accuracy, strftime(TIMESTAMP '{NOW}' - to_seconds(CAST((1 + o_orderkey % 20) * {seconds} AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS found FROM orders"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _dates(spark, sf_dir, F.concat(F.lit("渡船 写于 "), (F.col("o_orderkey") % 20 + 1).cast("string"), F.lit(unit)))

    run.__name__ = name
    query(sql)(run)


_ago("date_relative_years", "年前", 365 * 86400, 40)
_ago("date_relative_days", " 日之前", 86400, 30)
_ago("date_relative_hours", " hours ago", 3600, 40)
_ago("date_relative_minutes", " 分钟之前", 60, 50)
_ago("date_relative_seconds", " 秒前", 1, 60)


@query("SELECT o_orderkey, 50 AS accuracy, '2029-12-31 ' || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || ':00' AS found FROM orders")
def date_yesterday(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.concat(F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0"))
    return _dates(spark, sf_dir, F.concat(F.lit("昨天 "), at), dates.relative_date)


@query(_expect(10, "strftime(t + to_days(3650), '%Y-%m-%d %H:%M:%S')"))
def date_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unix times of ten digits: ten years on from the orders'."""
    return _dates(spark, sf_dir, F.concat((F.unix_timestamp("ts") + 3650 * 86400).cast("string"), F.lit(" id")), dates.epoch_date)


@query(_expect(60))
def date_beside_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What looks like a date within an address is none."""
    return _dates(spark, sf_dir, _shown("yyyy-MM-dd HH:mm:ss", "http://ferry.example.com/2001/2/3/x at "))


@query(_expect(30, "strftime(t, '%Y-%m-%d') || ' 12:00:00'"))
def date_month_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dates(spark, sf_dir, _shown("MMM dd, yyyy", "", " · report"))


@query(_expect(60))
def date_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A date at the end of a long text."""
    return _dates(spark, sf_dir, F.concat(F.repeat(F.lit("long words "), 30), _shown("yyyy-MM-dd HH:mm:ss")))


@query(f"WITH o AS ({_O}) SELECT o_orderkey, 60 AS accuracy, 1 AS at, strftime(t, '%Y-%m-%d %H:%M:%S') AS found FROM o")
def date_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.array(F.lit("4 days ago"), _shown("yyyy-MM-dd HH:mm:ss"), F.lit("nothing"))
    rows = _order_times(spark, sf_dir).select("o_orderkey", dates.best_date(texts, when(NOW)).alias("d"))
    return rows.select("o_orderkey", "d.accuracy", F.col("d.at"), F.date_format("d.ts", "yyyy-MM-dd HH:mm:ss").alias("found"))


@query(f"WITH o AS ({_O}) SELECT o_orderkey, strftime(t, '%Y-%m-%d %H:%M:%S') AS date, 'paper ' || o_orderkey AS source FROM o")
def date_source_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = dates.split_date_source(F.concat(F.lit("paper "), F.col("o_orderkey").cast("string"), F.lit(" "), _shown("yyyy-MM-dd HH:mm:ss")))
    return _order_times(spark, sf_dir).select("o_orderkey", both.alias("b")).select("o_orderkey", "b.*")


@query("SELECT s_suppkey, 10 AS accuracy, 'n' || s_suppkey || '晚报' AS source FROM supplier")
def source_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.concat(F.lit("n"), F.col("s_suppkey").cast("string"), F.lit("晚报  2021-03-09"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", publishers.extract_source(shown).alias("s")).select("s_suppkey", "s.accuracy", "s.source")


@query("SELECT s_suppkey, 10 AS accuracy, 'n' || s_suppkey || '晚报' AS source, 110 AS beg FROM supplier")
def source_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name at the end of a long text."""
    shown = F.concat(F.repeat(F.lit("long words "), 10), F.lit("n"), F.col("s_suppkey").cast("string"), F.lit("晚报"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", publishers.extract_source(shown).alias("s")).select("s_suppkey", "s.accuracy", "s.source", "s.beg")


@query("SELECT s_suppkey, 31 AS accuracy, 1 AS at, '搜狐频道' || s_suppkey AS source FROM supplier")
def source_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The better name wins, and names outside links are favoured."""
    key = F.col("s_suppkey").cast("string")
    texts = F.array(F.concat(F.lit("n"), key, F.lit("晚报")), F.concat(F.lit("搜狐频道"), key, F.lit(" 3月9日")), F.lit("搜狐频道 举报"))
    best = publishers.best_source(texts, F.array(F.lit(False), F.lit(False), F.lit(True)))
    return table(spark, sf_dir, "supplier").select("s_suppkey", best.alias("b")).select("s_suppkey", "b.accuracy", "b.at", "b.source")


@query("""SELECT doc_id, 'Title ' || doc_id AS title, 'http://feed.example/' || doc_id AS link, source, CASE WHEN doc_id % 2 = 0 THEN lang END AS channel,
strftime(TIMESTAMP '2015-05-01 00:00:00' + to_minutes(doc_id), '%Y-%m-%d %H:%M') AS date FROM documents WHERE doc_id % 3 <> 0""")
def xml_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds of two results each, one without a usable link in every third."""
    key = F.col("doc_id").cast("string")
    at = F.date_format(F.timestamp_seconds(F.unix_timestamp(when("2015-05-01 00:00:00")) + F.col("doc_id") * 60), "yyyy年MM月dd日HH时mm分ss秒")
    item = F.concat(
        F.lit("<RESULT><TITLE>&lt;b&gt;Title&lt;/b&gt; "), key, F.lit("</TITLE><PUBLISHTIME>"), at, F.lit("</PUBLISHTIME><SOURCE>"), F.col("source"), F.lit("</SOURCE>"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<CHANNEL>"), F.col("lang"), F.lit("</CHANNEL>"))).otherwise(""),
        F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("<DOCURL>http://feed.example/"), key, F.lit("</DOCURL>"))).otherwise(""), F.lit("</RESULT>"),
    )
    other = F.lit("<RESULT><TITLE>x</TITLE><DOCURL>x</DOCURL></RESULT>")
    xml = F.concat(F.lit("<R><PAGES>1</PAGES>"), item, other, F.lit("</R>"))
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(normalize.parse_feed(xml)))


@query("SELECT page_id, CASE WHEN page_id % 5 = 1 THEN NULL ELSE md5(html) END AS body FROM pages")
def gunzip_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second body compressed, every fifth damaged."""
    raw, k = F.col("html").cast("binary"), F.col("page_id")
    body = F.when(k % 5 == 1, F.lit(b"\x1f\x8bno")).when(k % 2 == 0, normalize.gzip_bytes(raw)).otherwise(raw)
    encoding = F.when((k % 2 == 0) | (k % 5 == 1), "gzip").otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(normalize.gunzip(body, encoding)).alias("body"))


@query("SELECT page_id, '<meta charset=\"GBK\">中文页 ' || page_id AS page FROM pages")
def decode_gbk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in GBK with one that doesn't fit."""
    head = "<meta charset=\"GBK\">中文页 ".encode("gbk")
    body = F.concat(F.lit(head), F.col("page_id").cast("string").cast("binary"), F.lit(b"\xff"))
    return table(spark, sf_dir, "pages").select("page_id", normalize.decode_body(body).alias("page"))


@query("SELECT page_id, 'a & b <' || page_id || '>' AS plain FROM pages")
def entity_unescape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", normalize.unescape(F.concat(F.lit("a &amp; b &lt;"), F.col("page_id").cast("string"), F.lit("&gt;"))).alias("plain"))


@query(f"""SELECT page_id, {HOST} AS location, 'text/html; charset=utf-8' AS content_type, CAST(NULL AS VARCHAR) AS missing FROM pages""")
def header_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nLocation: "), urls.authority(F.col("url")), F.lit("\r\nContent-Type: text/html; charset=utf-8\r\n"))
    return table(spark, sf_dir, "pages").select(
        "page_id", normalize.header_map(block)["Location"].alias("location"), normalize.header_value(block, "content-type").alias("content_type"), normalize.header_value(block, "X-None").alias("missing"),
    )


@query("SELECT page_id, '<div>' || url || '</div>' AS search_page, '<p>' || page_id || '</p>' AS pagelet FROM pages")
def json_chunk_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = F.to_json(F.struct(F.lit("search").alias("i"), F.concat(F.lit("<div>"), F.col("url"), F.lit("</div>")).alias("h")))
    chunk = F.to_json(F.struct(F.concat(F.lit("<script>a()</script><script>je.api("), inner, F.lit(");")).alias("d")))
    stream = F.concat_ws('/*""*/', F.lit("{}"), F.lit("{}"), F.lit('{"d":"other"}'), chunk)
    view = F.to_json(F.struct(F.lit("pl_weibo_direct").alias("pid"), F.concat(F.lit("<p>"), F.col("page_id").cast("string"), F.lit("</p>")).alias("html")))
    script = F.concat(F.lit("<body><script>STK && STK.pageletM && STK.pageletM.view("), view, F.lit(")</script></body>"))
    return table(spark, sf_dir, "pages").select("page_id", normalize.unwrap_search_json(stream).alias("search_page"), normalize.unwrap_pagelet(script).alias("pagelet"))


_OUTSIDE = "regexp_replace(regexp_replace(html, '(?s)(<(?:script|style)[^>]*>).*?</(?:script|style)>', '\\1', 'g'), '(?s)<!--.*?-->', '', 'g')"


@query(f"""WITH t AS (SELECT page_id, unnest(regexp_extract_all({_OUTSIDE}, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM pages)
SELECT page_id, lower(tag) AS tag, count(*) AS nodes FROM t GROUP BY ALL""")
def dom_nodes_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = dom.dom_nodes(table(spark, sf_dir, "pages"))
    return nodes.where("tag <> '#text'").groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("nodes"))


def _names(*names: str) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


#: The tree in SQL: tokens, then one step of a stack machine for each. It knows the recovery rules that the tables' pages need.
_BLOCKS = ("article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "main", "nav", "ol", "pre", "section", "table", "ul")
_LAST = "list_max(list_filter(range(1, len(names) + 1), lambda j: {}))"
_TREE = rf"""WITH RECURSIVE tok AS (
  SELECT page_id, regexp_extract_all(html, '(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]*>|[^<]+') AS ts FROM pages
), st AS (
  SELECT page_id, 0 AS i, 0 AS n, CAST([] AS VARCHAR[]) AS names, CAST([] AS INTEGER[]) AS ids, CAST(NULL AS VARCHAR) AS made, CAST(NULL AS VARCHAR) AS txt FROM tok
  UNION ALL
  SELECT page_id, i, n + CASE kind WHEN 'raw' THEN 2 WHEN 'open' THEN 1 WHEN 'text' THEN 1 ELSE 0 END,
    CASE kind WHEN 'open' THEN list_concat(names[1 : keep], CASE WHEN void THEN [] ELSE [name] END) ELSE names[1 : keep] END,
    CASE kind WHEN 'open' THEN list_concat(ids[1 : keep], CASE WHEN void THEN [] ELSE [n + 1] END) ELSE ids[1 : keep] END,
    CASE kind WHEN 'open' THEN name WHEN 'text' THEN '#text' END, CASE WHEN kind = 'text' THEN t END
  FROM (
    SELECT *, name IN ('br', 'meta', 'img', 'link', 'hr', 'input') AS void, CASE
      WHEN kind = 'close' THEN coalesce({_LAST.format("names[j] = name")} - 1, len(names))
      WHEN kind = 'open' AND len(shuts) > 0 THEN coalesce(list_min(list_filter(range(1, len(names) + 1), lambda j: j > wall AND list_contains(shuts, names[j]))) - 1, len(names))
      ELSE len(names) END AS keep
    FROM (
      SELECT *, coalesce({_LAST.format("list_contains(stops, names[j])")}, 0) AS wall
      FROM (
        SELECT *, CASE WHEN name = 'li' THEN ['li'] WHEN name = 'p' OR list_contains({_names(*_BLOCKS)}, name) THEN ['p'] ELSE [] END AS shuts,
          CASE WHEN name = 'li' THEN ['ol', 'ul'] ELSE {_names("article", "aside", "body", "div", "footer", "header", "html", "li", "main", "nav", "section", "table", "td", "th")} END AS stops
        FROM (
          SELECT st.page_id, st.i + 1 AS i, st.n, st.names, st.ids, ts[st.i + 1] AS t, lower(regexp_extract(ts[st.i + 1], '^</?([a-zA-Z0-9]+)', 1)) AS name,
            CASE WHEN ts[st.i + 1] LIKE '<!%' THEN 'skip' WHEN regexp_matches(ts[st.i + 1], '^<(script|style)') THEN 'raw' WHEN ts[st.i + 1] LIKE '</%' THEN 'close' WHEN ts[st.i + 1] LIKE '<%' THEN 'open' ELSE 'text' END AS kind
          FROM st JOIN tok ON tok.page_id = st.page_id AND st.i < len(tok.ts)
        )
      )
    )
  )
), nodes AS (
  SELECT page_id, n AS id, made AS tag, CASE WHEN made <> '#text' AND len(ids) > 0 AND ids[-1] = n THEN list_concat([0], ids[:-2]) ELSE list_concat([0], ids) END AS above,
    CASE WHEN made <> '#text' AND len(ids) > 0 AND ids[-1] = n THEN names[:-2] ELSE names END AS over,
    replace(replace(replace(replace(replace(replace(txt, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS raw
  FROM st WHERE made IS NOT NULL
), texts AS (
  SELECT page_id, id, above, over, raw, trim(raw, {_B}) AS text, strlen(trim(raw, {_B})) AS size, coalesce(over[-1], '') = 'a' OR coalesce(over[-2], '') = 'a' AS is_link
  FROM nodes WHERE tag = '#text' AND trim(raw, {_B}) <> ''
), units AS (
  SELECT page_id, unit, CAST(sum(size) AS BIGINT) AS total_bytes, CAST(sum(CASE WHEN is_link THEN 0 ELSE size END) AS BIGINT) AS plain_bytes, CAST(sum(CASE WHEN is_link THEN size ELSE 0 END) AS BIGINT) AS link_bytes,
    count(*) AS texts, count(*) FILTER (is_link) AS link_texts, string_agg(text, ' ' ORDER BY id) AS text, coalesce(string_agg(text, ' ' ORDER BY id) FILTER (NOT is_link), '') AS plain
  FROM (SELECT *, unnest(above) AS unit FROM texts) GROUP BY ALL
)
"""


@query(f"{_TREE} SELECT page_id, unit, total_bytes, plain_bytes, link_bytes, texts, link_texts, text, link_bytes / total_bytes AS link_rate FROM units")
def text_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text sums of every element of every page."""
    return dom.text_units(table(spark, sf_dir, "pages"))


@query("""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, regexp_extract(url, '^([^:/]+)://', 1) || '://' || regexp_extract(url, '^[^:/]+://([^/?]*)', 1) || href AS link, count(*) AS n FROM l GROUP BY ALL""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page.page_facts(table(spark, sf_dir, "pages"), "links").select("page_id", F.inline("links"))
    return found.groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n"))


_PLAIN = "replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


@query(f"SELECT page_id, trim({_PLAIN.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")}, {_B}) AS page_title FROM pages")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title of every page; empty if a page has none, null if it is null (which goes along in place of its address)."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("html").isNotNull(), "").alias("url"), "html")
    return page.page_facts(pages, "page_title").select("page_id", F.coalesce("page_title", "url").alias("page_title"))


@query("SELECT page_id, 'Heading number ' || page_id AS title FROM pages")
def best_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heading that is nearly the page title, past another one that isn't."""
    key = F.col("page_id").cast("string")
    html = F.concat(F.lit("<html><head><title>Heading number "), key, F.lit(" - site</title></head><body><p>Other</p><h1>Heading number "), key, F.lit("</h1><p>Text</p></body></html>"))
    return page.page_facts(table(spark, sf_dir, "pages").select("page_id", "url", html.alias("html")), "title").select("page_id", "title")


@query("SELECT page_id, md5(repeat('word ' || page_id || ' ', 39) || 'word ' || page_id) AS content FROM pages")
def main_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("word "), F.col("page_id").cast("string"))
    words = F.concat(F.repeat(F.concat(key, F.lit(" ")), 39), key)
    html = F.concat(F.lit("<html><body><ul><li><a href='/a'>menu one</a></li><li><a href='/b'>menu two</a></li></ul><div><div>"), words, F.lit("</div></div><p>short end</p></body></html>"))
    found = page.page_facts(table(spark, sf_dir, "pages").select("page_id", "url", html.alias("html")), "content")
    return found.select("page_id", F.md5(F.col("content").cast("binary")).alias("content"))


#: Titles of the tables' pages equal their heading, or there is none short enough; content goes down to the block that no child dominates.
_CONTENT = f"""{_TREE}, every AS (
  SELECT n.page_id, n.id, n.above[-1] AS parent, n.tag, CASE WHEN n.tag = '#text' THEN t.is_link ELSE n.tag = 'a' OR coalesce(n.over[-1], '') = 'a' END AS is_link,
    coalesce(u.total_bytes, t.size) AS total, coalesce(u.plain_bytes, CASE WHEN t.is_link THEN 0 ELSE t.size END) AS plain, coalesce(u.plain, CASE WHEN t.is_link THEN '' ELSE t.text END) AS words
  FROM nodes n LEFT JOIN units u ON u.page_id = n.page_id AND u.unit = n.id AND n.tag <> '#text' LEFT JOIN texts t ON t.page_id = n.page_id AND t.id = n.id
), kids AS (
  SELECT page_id, parent AS id, count(*) FILTER (fit) AS fits, arg_max(id, plain * 100000 - id) FILTER (fit) AS best, max(plain) FILTER (fit) AS most
  FROM (SELECT *, coalesce(total, 0) > 0 AND NOT is_link AND (total - plain) / total < 0.5 AS fit FROM every) GROUP BY ALL
), steps AS (
  SELECT e.*, k.id IS NULL AS leaf, CASE WHEN total > 0 AND plain > 0 AND fits > 0 AND NOT (fits > 1 AND most <= 0.7 * plain) THEN best END AS next, coalesce(fits, 0) AS fits FROM every e LEFT JOIN kids k USING (page_id, id)
), walk AS (
  SELECT s.* FROM steps s WHERE tag = 'html'
  UNION ALL SELECT s.* FROM walk w JOIN steps s ON s.page_id = w.page_id AND s.id = w.next
), content AS (SELECT page_id, CASE WHEN coalesce(total, 0) = 0 OR NOT leaf AND (plain = 0 OR fits = 0) THEN '' ELSE words END AS content FROM walk WHERE next IS NULL),
titles AS (SELECT page_id, any_value(raw) AS title FROM texts WHERE over[-1] = 'title' GROUP BY ALL),
heads AS (SELECT page_id, arg_min(raw, id) AS head FROM texts WHERE regexp_matches(over[-1], '^h[0-9]') AND strlen(raw) <= 120 GROUP BY ALL)
SELECT p.page_id, CASE WHEN head = title THEN trim(head, {_B}) END AS title, content FROM pages p LEFT JOIN content USING (page_id) LEFT JOIN titles USING (page_id) LEFT JOIN heads USING (page_id)"""


@query(_CONTENT)
def page_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and main content of the pages as they are."""
    return page.page_facts(table(spark, sf_dir, "pages"), "title", "content").select("page_id", "title", "content")


@query("SELECT page_id, unnest([url, '/lazy/' || page_id || '.png', '/two.png']) AS image FROM pages")
def image_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id").cast("string")
    html = F.concat(F.lit('<p><img src=" '), F.col("url"), F.lit(' " data-original="/lazy/'), key, F.lit('.png"><img alt="none"><img src2="/two.png"></p>'))
    found = page.page_facts(table(spark, sf_dir, "pages").select("page_id", "url", html.alias("html")), "images")
    return found.select("page_id", F.explode("images").alias("image"))


AS_OF = "2024-06-15 12:00:00"
SOURCES = ("海港晚报", "搜狐频道", "山谷周报")


def result_pages(spark: SparkSession, sf_dir: str, short_titles: bool = False) -> DataFrame:
    """page_id, url, html: result pages of ten documents each; with ``short_titles`` every tenth can't be told by its title."""
    k = F.col("doc_id")
    key = k.cast("string")
    title = F.concat(F.lit("Title number "), key)
    if short_titles:
        title = F.when(k % 10 == 3, F.concat(F.lit("T"), key)).otherwise(title)
    at = F.date_format(F.timestamp_seconds(F.unix_timestamp(when("2023-01-01 00:00:00")) + (k * 37 % 400000) * 60), "yyyy-MM-dd HH:mm:ss")
    source = F.element_at(F.array(*map(F.lit, SOURCES)), (k % 3 + 1).cast("int"))
    item = F.concat(
        F.lit('<div class="i"><h3><a href="/a/'), key, F.lit('">'), title, F.lit("</a></h3><p>"), F.repeat(F.concat(F.md5(key.cast("binary")), F.lit(" ")), 5), F.lit("end</p><span>"), source, F.lit(" "), at,
        F.lit('</span><span class="c-info"><a class="c-more_link" href="/same/'), key, F.lit('">more</a></span></div>'),
    )
    rows = table(spark, sf_dir, "documents").groupBy(F.floor(k / 10).alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("item")))).alias("items"))
    host = F.when(F.col("page_id") % 5 == 0, "news.baidu.com").otherwise(F.concat(F.lit("r"), (F.col("page_id") % 5).cast("string"), F.lit(".example.com")))
    html = F.concat(
        F.lit('<html><head><title>Results</title></head><body><div id="top"><a href="/">Home</a></div><div id="r">'), F.concat_ws("\n", F.transform("items", lambda x: x["item"])), F.lit("</div></body></html>"),
    )
    return rows.select("page_id", F.concat(F.lit("http://"), host, F.lit("/s?wd=x&pn="), F.col("page_id").cast("string")).alias("url"), html.alias("html"))


_RH = "CASE WHEN (doc_id // 10) % 5 = 0 THEN 'news.baidu.com' ELSE 'r' || ((doc_id // 10) % 5) || '.example.com' END"
_SUMMARY = "repeat(md5(CAST(doc_id AS VARCHAR)) || ' ', 5) || 'end'"
_RSOURCE = f"{list(SOURCES)!r}[doc_id % 3 + 1]"
_RDATE = "strftime(TIMESTAMP '2023-01-01 00:00:00' + to_minutes(doc_id * 37 % 400000), '%Y-%m-%d %H:%M')"
_RECORDS = f"SELECT doc_id // 10 AS page_id, CAST(doc_id % 10 AS INTEGER) AS rank, 'Title number ' || doc_id AS title, 'http://' || {_RH} || '/a/' || doc_id AS link, {_SUMMARY} AS summary, {_RSOURCE} AS source, {_RDATE} AS date FROM documents"


@query("SELECT doc_id // 10 AS page_id, 'html/body/div[2]' AS container, 'div' AS tag, count(*) AS items FROM documents GROUP BY ALL")
def repeat_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.region_sizes(result_pages(spark, sf_dir))


@query(_RECORDS)
def records_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.extract_records(result_pages(spark, sf_dir), when(AS_OF))
    return found.select("page_id", "rank", "title", "link", "summary", "source", "date")


@query(f"SELECT doc_id // 10 AS page_id, CAST(doc_id % 10 AS INTEGER) AS rank, 'Title number ' || doc_id AS title, 'http://' || {_RH} || '/a/' || doc_id AS link FROM documents")
def records_no_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.extract_records(result_pages(spark, sf_dir), when(AS_OF), has_summary=False).select("page_id", "rank", "title", "link")


@query(f"""WITH h AS (SELECT {_RH} AS host, count(*) AS support FROM documents GROUP BY 1)
SELECT host, unnest(['items', 'title', 'link', 'summary', 'date', 'source']) AS field, unnest(['html/body/div[2]/div', 'h3[1]/a[1]', 'h3[1]/a[1]', 'p[1]', 'span[1]', 'span[1]']) AS path, support FROM h WHERE support >= 2""")
def wrapper_learn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.learn_wrappers(result_pages(spark, sf_dir), when(AS_OF))


@query(f"""WITH r AS ({_RECORDS}) SELECT page_id, rank, CASE WHEN rank = 3 THEN replace(title, 'Title number ', 'T') ELSE title END AS title, link,
CASE WHEN rank = 3 THEN replace(summary, ' ', '') ELSE summary END AS summary, source, date FROM r""")
def wrapper_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth record comes from what the others of its host taught."""
    pages = result_pages(spark, sf_dir, short_titles=True)
    found = records.extract_records(pages, when(AS_OF), wrappers=records.learn_wrappers(pages, when(AS_OF)))
    return found.select("page_id", "rank", "title", "link", "summary", "source", "date")


@query(f"SELECT doc_id // 10 AS page_id, CAST(doc_id % 10 AS INTEGER) AS rank, 'http://news.baidu.com/same/' || doc_id AS same_news_link FROM documents WHERE {_RH} = 'news.baidu.com'")
def same_story_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.same_story_links(result_pages(spark, sf_dir))


@query(f"""WITH r AS ({_RECORDS}) SELECT page_id, '{{"title":"' || title || '","link":"' || link || '","summary":"' || summary || '","source":"' || source || '","date":"' || date || '"}}' AS record FROM r""")
def record_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.extract_records(result_pages(spark, sf_dir), when(AS_OF))
    return found.select("page_id", records.record_json(found).alias("record"))


@query(f"WITH r AS ({_RECORDS}) SELECT CAST(rank AS VARCHAR) AS idx, date, source, title, summary, link, 'http://' || string_split(link, '/')[3] || '/s?wd=x&pn=' || page_id AS page_url FROM r")
def tsv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as tab-separated files and read back."""
    path = shared_folder(spark, "report")
    found = records.extract_records(result_pages(spark, sf_dir), when(AS_OF))
    files.write_report(found.withColumns({"idx": F.col("rank"), "page_url": F.col("url")}), path)
    return files.read_report(spark, path)


@query(f"WITH r AS ({_RECORDS}) SELECT page_id, link AS url, date AS pubdate, title FROM r WHERE link NOT LIKE 'http://news.baidu.com/%' AND page_id % 2 = 0")
def mining_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole round: records, rules, deduplication against links seen before, messages taken apart."""
    pages = result_pages(spark, sf_dir)
    odd = records.extract_records(pages.where("page_id % 2 = 1"), when(AS_OF)).select(F.col("link").alias("dedup_key"))
    _, messages = rounds.pages_round(pages, odd, when(AS_OF))
    return tasks.read_messages(messages).select("page_id", "url", "pubdate", "title")


#: Sites of the fetched round: host, task type, deduplication method, whether pages of duplicates end a keyword.
ROUND_SITES = (
    ("r1.example.com", requests.BLOG, "LINK", True), ("r2.example.com", requests.FORUM, "TITLE", True), ("r3.example.com", requests.NEWS, "LINK", False), ("r4.example.com", requests.WECHAT, "LINK", False),
    ("news.baidu.com", requests.NEWS, "LINK", True), (requests.FEED_HOST, requests.NEWS, "LINK", True), ("lost.example.com", "unknown", "LINK", True),
)
ROUND_PARSERS = {**requests.PARSERS, (requests.NEWS, "r3.example.com"): requests.Parser("plain", has_summary=False)}


def _fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result pages as bytes: every seventh a feed, some of an unknown site; every third compressed, some of the others in GBK."""
    p = F.col("page_id")
    key = F.col("d.doc_id").cast("string")
    pages = result_pages(spark, sf_dir).withColumn("url", F.when(p % 11 == 10, F.replace("url", F.lit("r"), F.lit("lost"))).otherwise(F.col("url")))
    docs = table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 10).alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("doc_id"))).alias("docs"))
    item = lambda d: F.concat(F.lit("<RESULT><TITLE>Title number "), d["doc_id"].cast("string"), F.lit("</TITLE><PUBLISHTIME>2022-03-04 05:06:07</PUBLISHTIME><SOURCE>s</SOURCE><DOCURL>http://feed.example/"), d["doc_id"].cast("string"), F.lit("</DOCURL></RESULT>"))
    feed = F.concat(F.lit("<R>"), F.concat_ws("", F.transform("docs", item)), F.lit("</R>"))
    both = pages.join(docs, "page_id").withColumn("feed", p % 7 == 6)
    url = F.when(F.col("feed"), F.concat(F.lit(f"http://{requests.FEED_HOST}/q?pn="), p.cast("string"))).when(p % 11 == 10, F.concat(F.lit("http://lost.example.com/s?pn="), p.cast("string"))).otherwise(F.col("url"))
    gbk = (p % 4 == 1) & ~F.col("feed")
    page = F.when(F.col("feed"), feed).when(gbk, F.replace("html", F.lit("<head>"), F.lit('<head><meta charset="gbk">'))).otherwise(F.col("html"))
    raw = F.when(gbk, normalize.encode_body(F.when(gbk, page), "gbk")).otherwise(page.cast("binary"))
    packed = p % 3 == 0
    body = F.when(packed, normalize.gzip_bytes(F.when(packed, raw))).otherwise(raw)
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), F.when(packed, "Content-Encoding: gzip\r\n").otherwise(""))
    return both.select(p.alias("fetch_id"), url.alias("url"), body.alias("body"), headers.alias("headers"), F.concat(F.lit("k"), (p % 2).cast("string")).alias("keyword"), p.alias("page_idx"))


def _round(spark: SparkSession, sf_dir: str) -> rounds.Round:
    """A round over the fetched pages; every fourth document was seen before, by its link or its title and summary."""
    sites = spark.createDataFrame([(f"http://{h}/q?w={{0}}", *rest) for h, *rest in ROUND_SITES], "request_url string, task_type string, dup_method string, stop_turn_page boolean")
    k = F.col("doc_id").cast("string")
    docs = table(spark, sf_dir, "documents").where("doc_id % 4 = 0")
    links = [F.concat(F.lit(f"http://{h}/a/"), k) for h, *_ in ROUND_SITES] + [F.concat(F.lit("http://feed.example/"), k)]
    titles = F.concat(F.lit("Title number "), k, F.substring(F.md5(k.cast("binary")), 1, 20))
    seen = docs.select(F.explode(F.array(*links, titles)).alias("dedup_key"))
    return rounds.fetched_round(_fetched(spark, sf_dir), sites, seen, when(AS_OF), parsers=ROUND_PARSERS)


_RF = f"""SELECT doc_id, doc_id // 10 AS p, CASE WHEN (doc_id // 10) % 7 = 6 THEN 'feed' WHEN (doc_id // 10) % 11 = 10 THEN 'lost' ELSE {_RH} END AS host, {_RDATE} AS date FROM documents"""
_RNEW = "host NOT IN ('lost', 'news.baidu.com') AND doc_id % 4 <> 0"


@query(f"""WITH d AS ({_RF}) SELECT p AS fetch_id, CASE WHEN host = 'feed' THEN 'http://feed.example/' ELSE 'http://' || host || '/a/' END || doc_id AS url,
CASE WHEN host = 'feed' THEN '2022-03-04 05:06' ELSE date END AS pubdate, 'Title number ' || doc_id AS title,
CASE host WHEN 'r1.example.com' THEN '博客' WHEN 'r2.example.com' THEN '论坛' WHEN 'r4.example.com' THEN '微信' ELSE '新闻' END AS "siteType" FROM d WHERE {_RNEW}""")
def fetched_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From fetched bytes to messages: compressed, GBK, feed and no-summary pages, each by its site's settings."""
    return tasks.read_messages(_round(spark, sf_dir).messages).select("fetch_id", "url", "pubdate", "title", "siteType")


@query(f"""WITH d AS ({_RF}), c AS (SELECT p, host, 'k' || (p % 2) AS keyword, count(*) FILTER ({_RNEW}) AS new_cnt, count(*) FILTER (NOT ({_RNEW})) AS dup_cnt FROM d WHERE host <> 'lost' GROUP BY ALL),
s AS (SELECT *, new_cnt = 0 AND dup_cnt > 0 AND host NOT IN ('r3.example.com', 'r4.example.com') AS stop FROM c)
SELECT p AS fetch_id, keyword, new_cnt, dup_cnt, stop, NOT coalesce(bool_or(stop) OVER (PARTITION BY host, keyword ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS live FROM s""")
def fetched_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New and repeated records of each fetched page, and which pages end their keyword at their site."""
    return _round(spark, sf_dir).stops(["host", "keyword"]).select("fetch_id", "keyword", "new_cnt", "dup_cnt", "stop", "live")


@query(f"""WITH r AS ({_RECORDS}) SELECT page_id, rank, title, link, date FROM r WHERE page_id % 2 = 1""")
def wrapper_whole_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the odd pages by what the even pages of their host taught, without finding a region."""
    pages = result_pages(spark, sf_dir)
    learned = records.learn_wrappers(pages.where("page_id % 2 = 0"), when(AS_OF), 1)
    found = records.apply_to_pages(pages.where("page_id % 2 = 1"), learned, when(AS_OF))
    return found.select("page_id", "rank", "title", "link", "date")


@query(f"""SELECT 's' || n_nationkey AS site, keyword, 'http://s' || n_nationkey || '.example/q?w=' || CASE WHEN n_nationkey % 2 = 0 THEN '%D6%D0%CE%C4+' ELSE '' END || {_ENC.format("keyword")} || CASE WHEN n_nationkey % 3 = 0 THEN '+%D6%D0' ELSE '+%E4%B8%AD' END AS url
FROM nation, ({_KW}) k WHERE n_nationkey % 3 = 0 OR n_nationkey % 2 = 1""")
def request_plan_charsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords and search prefixes in each site's own charset."""
    key = F.col("n_nationkey")
    sites = table(spark, sf_dir, "nation").where((key % 3 == 0) | (key % 2 == 1)).select(
        F.concat(F.lit("s"), key.cast("string")).alias("site"), F.concat(F.lit("http://s"), key.cast("string"), F.lit(".example/q?w={0}")).alias("request_url"), F.when(key % 2 == 0, "中文").otherwise("").alias("search_in_site"),
        F.when(key % 3 == 0, "GBK").otherwise("UTF-8").alias("encode_type"), F.lit(1).alias("page_start"), F.lit(1).alias("page_increase"), F.lit(1).alias("page_total"), F.lit("").alias("post_data"),
    )
    words = _keywords(spark, sf_dir)
    plan = requests.plan_requests(sites, words.select(F.concat("keyword", F.lit(" 中")).alias("keyword")))
    return plan.select("site", F.regexp_replace("keyword", " 中$", "").alias("keyword"), "url")


@query("""SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN 'feed' WHEN 1 THEN 'news' WHEN 5 THEN NULL ELSE 'search' END AS parser FROM nation""")
def parser_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, (requests.NEWS, requests.NEWS, requests.BLOG, requests.FORUM, requests.WECHAT, "unknown")))
    k = F.col("n_nationkey")
    host = F.when(k % 6 == 0, requests.FEED_HOST).otherwise(F.concat(F.lit("h"), k.cast("string"), F.lit(".example")))
    sites = table(spark, sf_dir, "nation").select("n_nationkey", F.element_at(kinds, (k % 6 + 1).cast("int")).alias("task_type"), F.concat(F.lit("http://"), host, F.lit("/q")).alias("request_url"))
    return requests.dispatch(sites).select("n_nationkey", "parser")


@query("SELECT r_name AS host, min('http://' || r_name || '.example/' || n_nationkey) AS request_url FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def site_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with one host count once."""
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sites = joined.select(F.concat(F.lit("http://"), F.col("r_name"), F.lit(".example/"), F.col("n_nationkey").cast("string")).alias("request_url"))
    return requests.distinct_sites(sites).select(F.replace("host", F.lit(".example"), F.lit("")).alias("host"), "request_url")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")


def _finished(stream: DataFrame, name: str, mode: str, keys: list[str]) -> DataFrame:
    """What a stream over all that is there comes to: the last row of each key, by micro-batch."""
    spark = stream.sparkSession
    folder = shared_folder(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(write).trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    if not rest:
        return rows.select(*keys).distinct()
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


@query(_bucketed("hour"))
def stream_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streams.stream_stats(_stat_rows(_event_stream(spark, sf_dir)), "1 hour", "365 days")
    return _bucket_text(_finished(found, "stats", "update", ["host", "keyword", "bucket"]))


@query("SELECT DISTINCT user_id FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finished(streams.stream_dedup(_event_stream(spark, sf_dir).select("user_id"), "user_id"), "dedup", "append", ["user_id"])


@query(_STOPS)
def stream_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stop rule as a stream, with its state in RocksDB."""
    conf, key = spark.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key, None)
    conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return _finished(streams.stream_stops(_counts(_event_stream(spark, sf_dir))), "stops", "append", ["site", "keyword", "page_idx"])
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


@query("SELECT DISTINCT user_id FROM events")
def stream_append_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unseen keys by micro-batch, with the keys seen kept in files."""
    folder = shared_folder(spark, "seen")
    streams.append_new(_event_stream(spark, sf_dir).select("user_id"), "user_id", f"{folder}/seen", f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out").select("user_id")
