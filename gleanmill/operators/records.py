"""The repeated records of a result page: finding the region, taking records apart, learning and applying wrappers.

``record_parts`` parses a page once, in one Arrow pass without a shuffle, down
to each record's title, link, summary and the texts that may hold its date and
publisher. Which of those do is decided in the JVM by the column functions for
dates and names. Records the induction can't take apart keep their element
texts by relative path; wrappers (paths by host and field with their support)
are learned from the others and applied to them by a join. A round that needs
the parts more than once writes them first (``plans.requests.mine``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import best_date, date_text, extract_date
from ..functions.publishers import best_source, extract_source
from ..functions.text import clean_summary, drop_breaks, squeeze
from ..functions.urls import authority, normalise_link, rooted as rooted_link
from .dom import BLANKS, Node, Units, parse, root_of
from .page import normalise, rooted

#: Shares of a node's text above which a child stands for it: while descending to the region, and within a record.
MAIN_RATE, RECORD_RATE = 0.6, 0.99
LEAST_REPEATS, MOST_LEVELS = 3, 3
#: Bytes of a title, shares of a record's text that a title may and a summary must have, and the share of links that makes a record count whole.
TITLE_BYTES, TITLE_RATE, TITLE_RATE_ALONE, SUMMARY_RATE, LINKED_RATE = 12, 0.5, 0.8, 0.4, 0.7
LONGEST_TEXT = 400
#: Steps that a wrapper's path has at most: longer ones are neither learned nor looked up.
MOST_STEPS = 200
#: Pages whose records are handed over at once.
PAGES_AT_ONCE = 128
# Classes of repeated elements that are menus, and links that lead to no record.
MENUS, NO_RECORD = frozenset(("sub-nav", "bk-sub-sort", "bk-filter")), ("javascript:", "more.php?id=")


def _longest(node: Node, units: Units) -> Node | None:
    return max(node.children, key=units.size, default=None)


def main_node(node: Node, units: Units, rate: float, kind: int = 0) -> Node | None:
    """Down to the node whose text no single child dominates; None where that leads to a leaf."""
    while not node.is_text and node.children and units.has(node):
        if len(node.children) == 1:
            node = node.children[0]
            continue
        best = _longest(node, units)
        if not units.has(best):
            return None
        if units.size(best) <= rate * units.size(node, kind):
            return node
        node = best
    return None


def repeats(node: Node) -> list[Node]:
    """The largest group of same-named useful child elements, if it has enough; of equal groups the one that got there first."""
    groups: dict[str, list[Node]] = {}
    best: list[Node] = []
    for x in node.children:
        if not x.is_text and not x.useless:
            own = groups.setdefault(x.tag, [])
            own.append(x)
            if len(own) > len(best):
                best = own
    return best if len(best) >= LEAST_REPEATS else []


def region(document: Node, units: Units) -> tuple[Node | None, list[Node]]:
    """The node whose children are the page's records, and those of them that hold links."""
    node = main_node(units.root, units, MAIN_RATE)
    if node is None:
        return None, []
    if node.tag in ("body", "html"):
        node = _longest(node, units)
    level = 0
    while node is not None and not node.is_text and units.size(node):
        level += 1
        group = repeats(node)
        best = _longest(node, units)
        if not group:
            node = best
            continue
        linked = [x for x in group if units.anchors[x.ordinal] > (x.tag == "a")]
        if units.size(best) > MAIN_RATE * units.size(node):
            node = best
            continue
        if len(linked) >= LEAST_REPEATS:
            return node, linked
        if level > MOST_LEVELS:
            break
        node = best
    return None, []


def _title(child: Node, units: Units, page: str) -> tuple[Node, str] | None:
    """The longest link within a child, or the child itself, and its address."""
    node = units.longest_link.get(child.ordinal) or (child if not child.is_text and units.has(child) and child.is_link else None)
    if node is None:
        return None
    href = node.attrs.get("href") or next((x.attrs["href"] for x in node.up() if x.tag == "a" and x.attrs.get("href")), "")
    href = href.strip(BLANKS)
    if any(k in href for k in NO_RECORD):
        return None
    return node, normalise(rooted(href), page)


def take_apart(item: Node, units: Units, page: str, has_summary: bool) -> dict:
    """A record's parts; goes down its longest child while title or summary are missing."""
    out: dict = {"title": "", "link": "", "summary": "", "candidates": [], "paths": {}}
    node = main_node(item, units, RECORD_RATE)
    if node is None or not units.has(node):
        return out
    kind = 0 if not has_summary or units.link_rate(node) > LINKED_RATE else 1
    whole, rate = units.size(node, kind), TITLE_RATE if has_summary else TITLE_RATE_ALONE
    while True:
        title = summary = best = None
        most = 0
        for child in node.children:
            if not units.has(child):
                if child.is_text and len(child.text.strip(BLANKS).encode(errors="replace")) >= max(1, SUMMARY_RATE * whole):
                    summary = child
                continue
            if units.size(child, kind) > most:
                most, best = units.size(child, kind), child
            if title is None and TITLE_BYTES <= units.size(child, 2) <= rate * whole and (title := _title(child, units, page)):
                continue
            if units.size(child, kind) >= SUMMARY_RATE * whole:
                summary = child
        if (title is None or has_summary and summary is None) and best is not None and most > SUMMARY_RATE * whole and not best.is_text:
            node = best
            continue
        break
    if title:
        out["title"], out["link"] = units.text(title[0]), title[1]
        out["paths"]["title"] = _steps(title[0], item)
    if has_summary and summary is not None:
        out["summary"] = units.text(summary, kind) if units.has(summary) else summary.text.strip(BLANKS)
        out["paths"]["summary"] = _steps(summary, item)
    below = lambda top: set() if top is None else {t.ordinal for t in units.texts.of(top)}
    in_title, in_summary = below(title and title[0]), below(summary)
    # The summary's own texts come last: they are only looked at where no other text has a date or a name.
    for t in units.list(item):
        if t.ordinal not in in_title:
            out["candidates"].append({"text": t.text.strip(BLANKS), "linked": t.is_link, "in_summary": t.ordinal in in_summary, "path": _steps(t.parent, item)})
    return out


def _steps(node: Node, top: Node) -> str | None:
    """The path of ``node`` below ``top``; null if it is too long for a wrapper."""
    return node.path_below(top) if node.depth - top.depth <= MOST_STEPS else None


_PARTS = "records array<struct<rank:int,title:string,link:string,summary:string,candidates:array<struct<text:string,linked:boolean,in_summary:boolean,path:string>>,title_path:string,summary_path:string,container:string,tag:string,texts:map<string,string>,hrefs:map<string,string>,same_links:array<struct<rule:string,link:string>>>>"
_CANDIDATE = pa.struct([("text", pa.string()), ("linked", pa.bool_()), ("in_summary", pa.bool_()), ("path", pa.string())])
_RECORD = pa.struct([("rank", pa.int32()), ("title", pa.string()), ("link", pa.string()), ("summary", pa.string()), ("candidates", pa.list_(_CANDIDATE)), ("title_path", pa.string()), ("summary_path", pa.string()), ("container", pa.string()), ("tag", pa.string()), ("texts", pa.map_(pa.string(), pa.string())), ("hrefs", pa.map_(pa.string(), pa.string())), ("same_links", pa.list_(pa.struct([("rule", pa.string()), ("link", pa.string())])))])


def parts_of(html: str | None, page: str, has_summary: bool = True) -> list[dict]:
    """The records of one page, in order; failed ones too, with what a wrapper needs."""
    document = parse(html)
    units = Units(root_of(document), LONGEST_TEXT)
    top, items = region(document, units)
    out = []
    for item in items:
        if item.attrs.get("class") in MENUS:
            continue
        r = take_apart(item, units, page, has_summary)
        if not has_summary:
            r["summary"] = re.sub(r"[ \r]", "", units.text(item, 1))
        elements = [x for x in item.walk() if x is not item and not x.is_text]
        failed = not r["link"] or has_summary and not r["summary"]
        looked_up = [(x, path) for x in elements if (path := _steps(x, item))] if failed else []
        same = [
            {"rule": f"{x.parent.tag}.{x.parent.attrs.get('class', '')}/a.{x.attrs.get('class', '')}", "link": x.attrs["href"].strip(BLANKS)}
            for x in elements
            if x.tag == "a" and x.attrs.get("href") and x.parent is not None and x.parent.attrs.get("class")
        ]
        out.append(
            {
                "rank": len(out), "title": r["title"], "link": r["link"], "summary": r["summary"], "candidates": r["candidates"],
                "title_path": r["paths"].get("title"), "summary_path": r["paths"].get("summary"), "container": re.sub(r"\[1\]", "", top.path_below(document)) if top.depth <= MOST_STEPS else None, "tag": item.tag,
                "texts": [(path, units.text(x)) for x, path in looked_up if units.has(x)],
                "hrefs": [(path, x.attrs["href"].strip(BLANKS)) for x, path in looked_up if x.attrs.get("href")],
                "same_links": same,
            }
        )
    return out


def record_parts(pages: DataFrame, has_summary: bool | Column = True, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A row for each record of each page: key, url, has_summary and the parts. Pages without markup are left out before Python."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(at, PAGES_AT_ONCE)
                found = [parts_of(p.as_py(), u or "", h) for u, h, p in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(found, pa.list_(_RECORD))], names=["key", "url", "has_summary", "records"])

    flag = F.lit(has_summary) if isinstance(has_summary, bool) else has_summary
    slim = pages.where(F.col(html).contains("<")).select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), flag.alias("has_summary"), F.col(html).alias("html"))
    return slim.mapInArrow(rows, f"key long, url string, has_summary boolean, {_PARTS}").select(F.col("key").alias(key), "url", "has_summary", F.inline("records"))


def region_sizes(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, container, tag, items: the path of each page's region and how many records it has."""
    return record_parts(pages, True, key, url, html).groupBy(key, "container", "tag").agg(F.count(F.lit(1)).alias("items"))


def _dated(parts: DataFrame, as_of: Column) -> DataFrame:
    """Adds ``date`` and ``source`` with their paths: from texts outside the summary, else cut out of the summary."""
    outside = F.filter("candidates", lambda c: ~c["in_summary"])
    texts = F.transform(outside, lambda c: c["text"])
    out = parts.withColumns({"_d": best_date(texts, as_of), "_s": best_source(texts, F.transform(outside, lambda c: c["linked"])), "_outside": outside})
    out = out.withColumns(
        {
            "date_path": F.when(F.col("_d.accuracy") > 0, F.try_element_at("_outside", F.col("_d.at") + 1)["path"]),
            "source_path": F.when(F.col("_s.source").isNotNull(), F.try_element_at("_outside", F.col("_s.at") + 1)["path"]),
            "_sd": F.when(F.coalesce(F.col("_d.accuracy"), F.lit(0)) == 0, extract_date(F.col("summary"), as_of)),
        }
    )
    cut = lambda s, x: F.concat(F.substring(s, F.lit(1), x["beg"]), F.lit(" "), F.substring(s, x["end"] + 1, F.length(s)))
    out = out.withColumn("summary", F.when(F.col("_sd.accuracy") > 0, cut(F.col("summary"), F.col("_sd"))).otherwise(F.col("summary")))
    out = out.withColumn("_ss", F.when(F.col("_s.source").isNull(), extract_source(F.col("summary"))))
    out = out.withColumn("summary", F.when(F.col("_ss.accuracy") > 0, cut(F.col("summary"), F.col("_ss"))).otherwise(F.col("summary")))
    return out.withColumns(
        {
            "date_ts": F.coalesce("_d.ts", "_sd.ts"), "source": F.coalesce("_s.source", "_ss.source", F.lit("")), "summary": clean_summary(F.col("summary")),
        }
    ).withColumn("date", date_text(F.col("date_ts"))).drop("_d", "_s", "_sd", "_ss", "_outside")


def extract_records(pages: DataFrame, as_of: Column, has_summary: bool = True, wrappers: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``records_of`` the pages' parts. With ``wrappers`` the pages are parsed twice; to avoid that write the parts first."""
    return records_of(record_parts(pages, has_summary, key, url, html), as_of, wrappers, key)


def _whole() -> Column:
    return (F.col("link") != "") & (~F.col("has_summary") | (F.col("summary") != ""))


def records_of(parts: DataFrame, as_of: Column, wrappers: DataFrame | None = None, key: str = "page_id") -> DataFrame:
    """key, url, rank, title, link, summary, source, date, date_ts of every record of ``record_parts``.

    Records without a link (or, with ``has_summary``, a summary) are taken
    from ``wrappers`` if given, else left out.
    """
    columns = [key, "url", "rank", "title", "link", "summary", "source", "date", "date_ts"]
    out = _dated(parts.where(_whole()), as_of).select(*columns)
    return out if wrappers is None else out.unionByName(apply_wrappers(parts.where(~_whole()), wrappers, as_of, key).where("link <> ''").select(*columns))


def learn_wrappers(pages: DataFrame, as_of: Column, least: int = 2, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``learn_from`` the pages' parts."""
    return learn_from(record_parts(pages, True, key, url, html), as_of, least)


def learn_from(parts: DataFrame, as_of: Column, least: int = 2) -> DataFrame:
    """host, field, path, support: the paths of at least ``least`` whole records of a host.

    ``items`` is where a host's records are; other paths are relative to a
    record. Counted before the shuffle, so a host with a third of all pages is a
    few rows of each task.
    """
    parts = _dated(parts.where("link <> '' AND summary <> ''"), as_of)
    fields = F.create_map(
        F.lit("items"), F.concat_ws("/", "container", "tag"), F.lit("title"), F.col("title_path"), F.lit("link"), F.col("title_path"),
        F.lit("summary"), F.col("summary_path"), F.lit("date"), F.col("date_path"), F.lit("source"), F.col("source_path"),
    )
    each = parts.select(authority(F.col("url")).alias("host"), F.explode(fields).alias("field", "path")).where("path IS NOT NULL AND host IS NOT NULL")
    return each.groupBy("host", "field", "path").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= least)


def apply_wrappers(failed: DataFrame, wrappers: DataFrame, as_of: Column, key: str = "page_id") -> DataFrame:
    """Records from ``record_parts`` rows by their host's wrappers; fields start empty for each.

    A field is the text of its best supported path that the record has. A
    publisher equal to the date loses its digits and signs; one longer than the
    title is searched for a name.
    """
    joined = failed.withColumn("host", authority(F.col("url"))).join(_by_host(wrappers.where("field <> 'items'")), "host")
    return _filled(joined, as_of)


def _by_host(wrappers: DataFrame) -> DataFrame:
    """host, w: a map from fields to paths, the best supported first. A row for each host, small beside its pages."""
    best = wrappers.groupBy("host", "field").agg(F.array_sort(F.collect_list(F.struct((-F.col("support")).alias("s"), "path"))).alias("paths"))
    return best.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("field", "paths"))).alias("w"))


def _filled(joined: DataFrame, as_of: Column) -> DataFrame:
    """Rows with url, texts, hrefs and w (``_by_host``) with their fields looked up."""

    def pick(field: str, values: str) -> Column:
        found = F.filter(F.transform(F.col("w")[field], lambda p: F.col(values)[p["path"]]), lambda v: v.isNotNull())
        return drop_breaks(F.try_element_at(found, F.lit(1)))

    out = joined.withColumns({"title": pick("title", "texts"), "_href": pick("link", "hrefs"), "summary": squeeze(pick("summary", "texts")), "_date": pick("date", "texts"), "source": pick("source", "texts")})
    named = F.when(F.col("source") == F.col("_date"), F.regexp_replace("source", "[0-9:\\-年月日]", "")).when(F.length("source") > F.length("title"), F.coalesce(extract_source(F.col("source"))["source"], F.lit(""))).otherwise(F.col("source"))
    ts = extract_date(F.col("_date"), as_of)["ts"]
    link = F.when(F.col("_href") != "", normalise_link(rooted_link(F.col("_href")), F.col("url"))).otherwise("")
    return out.withColumns({"link": link, "source": F.btrim(named), "date_ts": ts}).withColumn("date", date_text(F.col("date_ts"))).drop("_href", "_date", "w", "host")


def at_path(root: Node, path: str) -> list[Node]:
    """The elements that a path like ``html/body/div[2]/div`` leads to; a step without a number takes all of its name."""
    found = [root]
    for step in path.split("/"):
        name, _, number = step.partition("[")
        found = [x for node in found for x in node.children if x.tag == name and (not number or x.nth == int(number.rstrip("]")))]
    return found


def apply_to_pages(pages: DataFrame, wrappers: DataFrame, as_of: Column, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Records of whole pages by their host's wrappers, for pages without a region: key, url, rank, title, link, summary, source, date, date_ts.

    The best supported ``items`` path that leads to elements of the page gives
    its records; those without a link are left out. Fields are looked up as in
    ``apply_wrappers``.
    """
    kind = "texts:map<string,string>,hrefs:map<string,string>"
    pairs = pa.map_(pa.string(), pa.string())

    def items_of(page: str, paths: list[str]) -> list[dict]:
        document = parse(page)
        units = Units(root_of(document), LONGEST_TEXT)
        for path in paths:
            if items := at_path(document, path):
                break
        else:
            return []
        out = []
        for item in items:
            elements = [(x, at) for x in item.walk() if x is not item and not x.is_text and (at := _steps(x, item))]
            out.append({"texts": [(at, units.text(x)) for x, at in elements if units.has(x)], "hrefs": [(at, x.attrs["href"].strip(BLANKS)) for x, at in elements if x.attrs.get("href")]})
        return out

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(at, PAGES_AT_ONCE)
                found = [items_of(p.as_py(), paths) for paths, p in zip(part.column(2).to_pylist(), part.column(3), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(found, pa.list_(pa.struct([("texts", pairs), ("hrefs", pairs)])))], names=["key", "url", "items"])

    slim = pages.where(F.col(html).contains("<")).select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.col(html).alias("html"), authority(F.col(url)).alias("host"))
    by_host = _by_host(wrappers)
    known = slim.join(by_host, "host").select("key", "url", F.transform(F.col("w")["items"], lambda p: p["path"]).alias("paths"), "html").where("paths IS NOT NULL")
    items = known.mapInArrow(rows, f"key long, url string, items array<struct<{kind}>>").select("key", "url", F.posexplode("items").alias("rank", "i")).select("key", "url", "rank", "i.*")
    joined = items.withColumn("host", authority(F.col("url"))).join(by_host, "host")
    out = _filled(joined, as_of).where("link <> ''")
    return out.select(F.col("key").alias(key), "url", "rank", "title", "link", "summary", "source", "date", "date_ts")


#: By host, where a record's link to copies of the same story is.
SAME_STORY = (("news.chinaso.com", "p.snapshot/a."), ("news.baidu.com", "span.c-info/a.c-more_link"), ("news.haosou.com", "p.newsinfo/a.same"))


def same_story_links(pages: DataFrame, rules: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, rank, same_news_link: a record's link to copies of its story, by rules (host, rule); the rules are a few rows."""
    spark = pages.sparkSession
    rules = rules if rules is not None else spark.createDataFrame(list(SAME_STORY), "host string, rule string")
    each = record_parts(pages, True, key, url, html).select(key, "url", "rank", authority(F.col("url")).alias("host"), F.posexplode("same_links").alias("at", "same"))
    # A rule without a class for the link takes any.
    hit = each.join(rules, "host").where((F.col("same.rule") == F.col("rule")) | (F.col("rule").endswith("/a.") & F.col("same.rule").startswith(F.col("rule"))))
    first = hit.where(F.length("same.link") > 5).groupBy(key, "rank", "url").agg(F.min_by(F.col("same.link"), F.col("at")).alias("link"))
    return first.select(key, "rank", normalise_link(F.col("link"), F.col("url")).alias("same_news_link"))


def record_json(records: DataFrame) -> Column:
    """The five fields of a record as a JSON object."""
    return F.to_json(F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("title", "link", "summary", "source", "date")]))


def last_wins(records: DataFrame, by: list[str], order: str) -> DataFrame:
    """Of rows equal in ``by`` the one with the greatest ``order``."""
    w = Window.partitionBy(*by).orderBy(F.col(order).desc())
    return records.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
