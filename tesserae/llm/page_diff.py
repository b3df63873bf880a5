"""Main text of web pages by differencing each page against its nearest neighbours by URL.

Pages are sorted by host and URL path over the whole cluster; each is paired with the page before and the page after
it on its host. Text lines (the text of one block of a page) of a pair are aligned by a longest common subsequence.
Shared lines are template and go. Two things are not template although they repeat: lines inside an <article> or
<main>, which declare themselves content (copies of an article, license lines, repeated paragraphs), and pairs that
share COPY of their text or more, which are copies of one page. Lines that the markup itself declares to be furniture
(nav, footer, aside, forms, adverts, comments ...) go whether or not the neighbour has them, since a neighbour may
show another advert.

Null html is an empty page with an empty text; a null url, or one without ``://``, has the empty host and path; such
pages are neighbours of each other. Equal urls go by page_id; pages that have the same lines as the one before them
take over what that one lost, and repeated rows lose the same. Unclosed tags, comments and scripts run to
the end of what encloses them. Further columns are ignored; an empty table gives no rows. White space is what Unicode
calls so, the no-break space included.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .util import arrow, bounded_batches, written

#: Share of a page's characters from which a pair counts as copies of one page.
COPY = 0.8
#: Bits of alignment state held at once; longer pairs are cut in halves.
ROWS_BITS = 1 << 28

# Elements and class names of HTML pages.
SILENT = {"head", "title", "script", "style", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "audio", "video", "textarea", "select", "button"}
FURNITURE = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset", "datalist"}
FURNITURE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alert", "form"}
FURNITURE_CLASSES = {
    "ad", "ads", "adbox", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "nav", "navbar", "navigation", "menu", "menus", "breadcrumb",
    "breadcrumbs", "sidebar", "header", "masthead", "topbar", "footer", "comment", "comments", "disqus", "respond", "replies", "share",
    "sharing", "social", "related", "recommended", "newsletter", "subscribe", "signup", "popup", "modal", "overlay", "widget", "login",
    "search", "pagination", "pager", "toolbar",
}
CONTENT = {"article", "main"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li",
    "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th",
    "thead", "title", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: An element of the first kind ends an open one of the second.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title|iframe|noscript|template)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _declared(tag: str, attributes: str, in_content: bool) -> bool:
    """Whether an element says that it is not main text."""
    if tag in FURNITURE or tag in SILENT or (tag == "header" and not in_content):
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values)
        if name.lower() == "role":
            if value.lower() in FURNITURE_ROLES:
                return True
            continue
        for token in value.split():
            words = {w.lower() for w in _NAME.findall(token)}
            if words & FURNITURE_CLASSES and not (words & {"article", "entry", "post", "content", "title"} and words & FURNITURE_CLASSES <= {"header", "banner"}):
                return True
    return False


def lines(page: str) -> list[tuple[str, int]]:
    """Text of each block in page order, with 0: declared furniture, 1: undeclared, 2: inside an article or main."""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    # Open elements: (tag, kind of the text inside).
    stack: list[tuple[str, int]] = []
    open_tags: dict[str, int] = {}
    kind, at = 1, 0

    def end_line() -> None:
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                out.append((line, kind))
            text.clear()

    def close(tag: str) -> None:
        nonlocal kind
        while True:
            name, _ = stack.pop()
            open_tags[name] -= 1
            if name == tag:
                break
        kind = stack[-1][1] if stack else 1

    for match in _MARKUP.finditer(page):
        if match.start() > at:
            text.append(page[at : match.start()])
        at = match.end()
        tag = match[3]
        if tag is None:
            if match[1]:
                text.append(" ")
            continue
        tag = tag.lower()
        block = tag in BLOCKS
        if match[2]:
            if open_tags.get(tag):
                if block or kind != (stack[-2][1] if len(stack) > 1 else 1):
                    end_line()
                close(tag)
            elif block:
                end_line()
            continue
        if tag == "br":
            text.append(" ")
            continue
        attributes = match[4]
        hidden = kind == 0 or _declared(tag, attributes, kind == 2)
        within = 0 if hidden else 2 if kind == 2 or tag in CONTENT else 1
        if block:
            end_line()
            if open_tags.get("p") and tag not in ("html", "head", "body"):
                close("p")
                within = 0 if kind == 0 or _declared(tag, attributes, kind == 2) else 2 if kind == 2 or tag in CONTENT else 1
            for other in ENDS.get(tag, ()):
                if open_tags.get(other) and next(t for t, _ in reversed(stack) if t == other or t in ("ul", "ol", "dl", "table", "select")) == other:
                    close(other)
                    within = 0 if kind == 0 or _declared(tag, attributes, kind == 2) else 2 if kind == 2 or tag in CONTENT else 1
        if tag in VOID or attributes.endswith("/"):
            continue
        if block or within != kind:
            if within != kind:
                end_line()
            stack.append((tag, within))
            open_tags[tag] = open_tags.get(tag, 0) + 1
            kind = within
    if at < len(page):
        text.append(page[at:])
    end_line()
    return out


def _scores(x: list, places: dict, n: int) -> np.ndarray:
    """Length of the longest common subsequence of x with each prefix of the other side."""
    full = (1 << n) - 1
    row = full
    for a in x:
        hit = row & places.get(a, 0)
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-n // 8), "little"), np.uint8), count=n, bitorder="little")
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _places(y: list) -> dict:
    out: dict = {}
    for j, b in enumerate(y):
        out[b] = out.get(b, 0) | 1 << j
    return out


def common(x: list, y: list) -> list[tuple[int, int]]:
    """Index pairs of one longest common subsequence (bit-parallel; halves of x where the rows would take too much memory)."""
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    out = [(i, i) for i in range(head)]
    # Lines that only one side has cannot be aligned.
    shared = set(x[head : len(x) - tail]) & set(y[head : len(y) - tail])
    xs = [i for i in range(head, len(x) - tail) if x[i] in shared]
    ys = [j for j in range(head, len(y) - tail) if y[j] in shared]
    work = [(0, len(xs), 0, len(ys))]
    while work:
        a, b, c, d = work.pop()
        if a == b or c == d:
            continue
        px, py = [x[i] for i in xs[a:b]], [y[j] for j in ys[c:d]]
        n = d - c
        if b - a > 1 and (b - a) * n > ROWS_BITS:
            half = (b - a) // 2
            front, back = _scores(px[:half], _places(py), n), _scores(px[half:][::-1], _places(py[::-1]), n)
            cut = int(np.argmax(front + back[::-1]))
            work += [(a, a + half, c, c + cut), (a + half, b, c + cut, d)]
            continue
        places, full = _places(py), (1 << n) - 1
        rows = [full]
        for v in px:
            hit = rows[-1] & places.get(v, 0)
            rows.append(((rows[-1] + hit) | (rows[-1] - hit)) & full)
        i, j = b - a, n
        while i and j:
            # A zero bit marks a step of the score. Without a step at j, j is not needed; a step that the row
            # before had as well does not need row i.
            if rows[i] >> (j - 1) & 1:
                j -= 1
            elif not rows[i - 1] >> (j - 1) & 1:
                i -= 1
            else:
                i, j = i - 1, j - 1
                out.append((xs[a + i], ys[c + j]))
    out += [(len(x) - 1 - k, len(y) - 1 - k) for k in range(tail)]
    return sorted(out)


class Page:
    """A page in the sorted stream: hashes, sizes and kinds of its lines, and which of them a neighbour shares."""

    def __init__(self, row: dict):
        self.key, self.host = (row["k0"], row["k1"]), row["host"]
        self.lines, self.sizes, self.kinds = row["lines"], row["sizes"], row["kinds"]
        self.shared = row.get("shared") or [False] * len(self.lines)


def compare(before: Page, after: Page) -> None:
    """Mark the lines that two neighbours share."""
    if before.host != after.host:
        return
    if before.lines == after.lines:
        after.shared = list(before.shared)
        return
    pairs = common(before.lines, after.lines)
    size = sum(before.sizes[i] for i, _ in pairs)
    if size >= COPY * min(sum(before.sizes), sum(after.sizes)):
        return
    for i, j in pairs:
        before.shared[i] = after.shared[j] = True


_KEY = [("k0", pa.int64()), ("k1", pa.int64())]
_LINES = [("host", pa.string()), ("lines", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("kinds", pa.list_(pa.int32()))]
_SIGNED = pa.schema([*_KEY, *_LINES, ("path", pa.string()), ("page_id", pa.int64())])
_SIGNED_SQL = "k0 long, k1 long, host string, lines array<long>, sizes array<int>, kinds array<int>, path string, page_id long"
_DONE = pa.schema([*_KEY, ("lost", pa.list_(pa.int32())), ("part", pa.int32()), ("last", pa.bool_()), *_LINES, ("shared", pa.list_(pa.bool_()))])
_DONE_SQL = "k0 long, k1 long, lost array<int>, part int, last boolean, host string, lines array<long>, sizes array<int>, kinds array<int>, shared array<boolean>"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [lines(page or "") for page in batch.column("html").to_pylist()]
        hashes = [[xxhash.xxh3_64_intdigest(t) - (1 << 63) for t, _ in x] for x in found]
        sizes, kinds = ([[len(t) for t, _ in x] for x in found], [[k for _, k in x] for x in found])
        yield arrow(_SIGNED, batch.column("k0"), batch.column("k1"), batch.column("host"), hashes, sizes, kinds, batch.column("path"), batch.column("page_id"))


def _finished(pages: list[Page]) -> pa.RecordBatch:
    """What pages lose of their undeclared lines; a page that loses nothing needs no row."""
    lost = [(p, [i for i, (k, s) in enumerate(zip(p.kinds, p.shared)) if s and k == 1]) for p in pages]
    lost = [x for x in lost if x[1]]
    none = [None] * len(lost)
    return arrow(_DONE, [p.key[0] for p, _ in lost], [p.key[1] for p, _ in lost], [x for _, x in lost], *[none] * 7)


def _waiting(page: Page, part: int, last: bool) -> pa.RecordBatch:
    return arrow(_DONE, [page.key[0]], [page.key[1]], [None], [part], [last], [page.host], [page.lines], [page.sizes], [page.kinds], [page.shared])


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare consecutive pages of one task; its first and last page wait for those of the tasks beside it."""
    from pyspark import TaskContext

    part, before, first = TaskContext.get().partitionId(), None, True
    for batch in batches:
        done: list[Page] = []
        for row in batch.to_pylist():
            page = Page(row)
            if before is not None:
                compare(before, page)
                if first:
                    yield _waiting(before, part, False)
                    first = False
                else:
                    done.append(before)
            before = page
        if done:
            yield _finished(done)
    if before is not None:
        yield _waiting(before, part, True)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the last page of each task with the first of the next; they come in order, and two are held."""
    before, before_part = None, -1
    for batch in batches:
        for row in batch.to_pylist():
            page = Page(row)
            if before is not None:
                if before_part != row["part"]:
                    compare(before, page)
                yield _finished([before])
            before, before_part = page, row["part"]
    if before is not None:
        yield _finished([before])


_TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for page, lost in zip(batch.column("html").to_pylist(), batch.column("lost").to_pylist()):
            gone = set(lost or ())
            out.append(" ".join(t for i, (t, k) in enumerate(lines(page or "")) if k and i not in gone))
        yield arrow(_TEXTS, batch.column("page_id"), batch.column("url"), out)


def host_and_path() -> tuple:
    """Host (A-Z lower-cased) and path of the column url; both empty without ``://``."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text (blocks joined by one space) and n_chars (code points) of every page.

    Only hashes of lines are sorted: one range sort by host and path brings neighbours together, so a host of any
    size is shared by many tasks; the two outer pages of each task meet in a second step. What undeclared lines a page
    loses is joined back to it; where most pages declare their content, that is a small side.
    """
    host, path = host_and_path()
    rows = bounded_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    rows = rows.withColumns({"k0": F.xxhash64("page_id", "url", "html"), "k1": F.xxhash64(F.lit(1), "html", "url", "page_id")})
    marked = written(rows.select("k0", "k1", host.alias("host"), path.alias("path"), "page_id", "html").mapInArrow(_signatures, _SIGNED_SQL))
    order = ["host", "path", "page_id", "k0", "k1"]
    ordered = marked.repartitionByRange(*order).sortWithinPartitions(*order).drop("path", "page_id")
    found = written(ordered.mapInArrow(_in_order, _DONE_SQL))
    outer = found.where("part is not null").repartition(1).sortWithinPartitions("part", "last").mapInArrow(_across, _DONE_SQL)
    lost = found.where("part is null").unionByName(outer).groupBy("k0", "k1")
    # Repeated rows have one key; what any of them lost, all lose.
    lost = lost.agg(F.array_distinct(F.flatten(F.collect_set("lost"))).alias("lost"))
    texts = rows.join(lost, ["k0", "k1"], "left").select("page_id", "url", "html", "lost").mapInArrow(_texts, "page_id long, url string, text string")
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))
