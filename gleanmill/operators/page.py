"""What a single page says: title, main content, images, links, next page. One pass over each page, no shuffle."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dom import BLANKS, Node, Texts, Units, parse, root_of

#: Longest title in bytes, and the share of the longer string that its distance to the page title must stay under.
TITLE_BYTES, TITLE_DISTANCE = 120, 0.5
#: A child goes on as content if less of it is links, and alone if it has more than this share of its parent's plain text.
LINK_RATE, MAIN_RATE = 0.5, Fraction(7, 10)  # the product of 0.7 and 710 is less than 497
# Texts that mark the link to the next page, and image attributes in order.
NEXT_WORDS, NEXT_MARK, IMAGE_ATTRIBUTES = ("下一页", "下页"), ">>", ("src", "data-original", "src2")


def distance_semi(a: str | bytes, b: str | bytes) -> int:
    """Edit distance in which a prefix of the shorter string is free; with an empty one, the other's length."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    row = list(range(len(b) + 1))
    for x in a:
        last, row[0] = row[0], 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def title_of(document: Node) -> tuple[str | None, str | None]:
    """(title, page title): the first heading near the page title, else the text nearest to it, else the first heading. Of several page titles the first counts."""
    units = Units(root_of(document))
    page_title = heading = near = None
    least = TITLE_BYTES
    for node in units.list(units.root):
        tag, text = node.parent.tag, node.text
        if tag == "title":
            if page_title is None:
                page_title = "".join(x.text for x in node.parent.children if x.is_text)
            continue
        data = text.encode(errors="replace")
        if len(data) > TITLE_BYTES or page_title is None:
            continue
        whole = page_title.encode(errors="replace")
        far, most = distance_semi(whole, data), TITLE_DISTANCE * max(len(data), len(whole))
        if heading is None and re.match(r"h\d", tag):
            heading = text
            if far < most:
                near = text
                break
        if far < most and far < least:
            least, near = far, text
    found = near if near is not None else heading
    return (None if found is None else found.strip(BLANKS), None if page_title is None else page_title.strip(BLANKS))


def content_of(document: Node) -> str:
    """The plain text of the block that holds most of the page's."""
    root = root_of(document)
    units, node = Units(root), root
    while True:
        if not units.has(node):
            return ""
        if node.is_text or not node.children:
            return units.text(node, 1)
        whole = units.size(node, 1)
        if not whole:
            return ""
        fit = [x for x in node.children if units.has(x) and units.link_rate(x) < LINK_RATE]
        if not fit:
            return ""
        best = max(fit, key=lambda x: units.size(x, 1))
        if len(fit) > 1 and units.size(best, 1) <= MAIN_RATE * whole:
            return units.text(node, 1)
        node = best


def images_of(document: Node) -> list[str]:
    """The addresses of all images, by attribute within each."""
    return [x.attrs[a].strip(BLANKS) for x in document.walk() if x.tag == "img" for a in IMAGE_ATTRIBUTES if x.attrs.get(a)]


def normalise(link: str, page: str) -> str:
    """Python's twin of ``functions.urls.normalise_link``."""
    link = link.strip(BLANKS)
    if link.startswith("/"):
        m = re.match(r"([^:/]+)://([^/?]*)", page)
        return f"{m[1]}://{m[2]}{link}" if m else link
    base = page.rpartition("?")[0] if "?" in page else page
    if link.startswith("?"):
        return base + link
    return link if link.startswith("http") else f"{base}?{link.split('?')[-1]}"


def rooted(link: str) -> str:
    return link if link.startswith(("http", "?", "/")) else "/" + link


def _params(url: str) -> tuple[str, list[tuple[str, int | None, str]]]:
    base, mark, query = url.rpartition("?")
    if not mark:
        return url, []
    out = []
    for part in query.split("&"):
        key, value = (part.split("=") + [""])[:2]
        if part:
            out.append((key, int(value) if value.isascii() and value.isdigit() else None, value))
    return base, sorted(out, key=_rank)


def _rank(p: tuple[str, int | None, str]) -> tuple:
    return (p[0], p[1] is None, p[1] or 0, p[2])


def _extends(current: list, other: list) -> list | None:
    """``other`` without extra parameters that aren't numbers, if it has each of ``current`` with an equal or a numeric value."""
    by = {k: (n, v) for k, n, v in other}
    for key, number, value in current:
        if key not in by or not (by[key][1] == value or number is not None and by[key][0] is not None):
            return None
    own = {k for k, _, _ in current}
    return [p for p in other if p[0] in own or p[1] is not None]


def _anchors(document: Node) -> Iterator[tuple[Node, str, str]]:
    """Every ``a`` with an address, the address, and its text."""
    nodes = list(document.walk())
    texts = Texts(nodes, [x for x in nodes if x.is_text])
    for a in nodes:
        if a.tag == "a" and (href := a.attrs.get("href", "").strip(BLANKS)):
            yield a, href, "".join(t.text for t in texts.of(a))


def next_page_of(document: Node, page: str) -> str | None:
    """The link marked as the next page, else the least one after this page in the order of query parameters; null if there is none."""
    m = re.match(r"[^:/]+://([^/?]*)", page)
    if not m or not m[1]:
        return None
    host, (base, current) = m[1], _params(page)
    found = []
    for a, href, text in _anchors(document):
        text = re.sub(r"[\r\n ]", "", text)
        if any(w in text for w in NEXT_WORDS) or text == NEXT_MARK:
            if number := re.search(r"pageIndex=(\d+)", href):
                return re.sub(rf"&p={int(number[1]) - 1}(?!\d)", f"&p={number[1]}", page)
            link = normalise(rooted(href), page)
            other, mark, query = link.rpartition("?")
            return f"{base}?{query}" if mark and other != base and "?" in page else link
        link = normalise(rooted(href), page)
        if f"//{host}" in link:
            other, params = _params(link)
            if (kept := _extends(current, params)) is not None:
                found.append((other, kept))
    key = lambda x: (x[0], len(x[1]), [_rank(p) for p in x[1]])
    later = [x for x in found if key(x) > key((base, current))]
    if not later:
        return None
    other, params = min(later, key=key)
    query = "&".join(f"{k}={v}" for k, _, v in params)
    return f"{base if other != base and '?' in page else other}?{query}"


def links_of(document: Node, page: str) -> list[tuple[str, str]]:
    """(absolute link, text) of every ``a`` with an address."""
    return [(normalise(rooted(href), page), text.strip(BLANKS)) for _, href, text in _anchors(document)]


_FACTS: dict[str, tuple[str, pa.DataType, Callable[[Node, str], object]]] = {
    "title": ("title string", pa.string(), lambda d, _: title_of(d)[0]),
    "page_title": ("page_title string", pa.string(), lambda d, _: title_of(d)[1]),
    "content": ("content string", pa.string(), lambda d, _: content_of(d)),
    "images": ("images array<string>", pa.list_(pa.string()), lambda d, _: images_of(d)),
    "next_page": ("next_page string", pa.string(), next_page_of),
    "links": ("links array<struct<link:string,text:string>>", pa.list_(pa.struct([("link", pa.string()), ("text", pa.string())])), lambda d, u: [{"link": a, "text": t} for a, t in links_of(d, u)]),
}


def page_facts(pages: DataFrame, *facts: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The key, the url and the facts asked for (of title, page_title, content, images, next_page, links) of every page.

    Each page is parsed once, whatever is asked for; null pages have no text.
    """
    own = [_FACTS[f] for f in facts]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in own]
            for address, page in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                document = parse(page.as_py())
                for column, (_, _, f) in zip(out, own, strict=True):
                    column.append(f(document, address or ""))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, (_, k, _) in zip(out, own, strict=True)]], names=["key", "url", *facts])

    slim = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.col(html).alias("html"))
    return slim.mapInArrow(rows, ", ".join(["key long, url string", *[t for t, _, _ in own]])).withColumnRenamed("key", key)
