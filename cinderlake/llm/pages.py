"""HTML main-text extraction by nearest-URL page differencing.

Pages of a host are put in order of URL path; each page is aligned with its two nearest neighbours by a longest common
subsequence of its text lines (blocks), and shared lines are deleted as template. Two pages that share
nearly everything outside marked template are copies, not two fillings of one template, and delete nothing of each other.
An exact structural check follows: lines inside an ``article`` or ``main`` element stay (articles may have lines in common), and
of the lines that no neighbour shares those inside menus, headers, footers, sidebars, notices, adverts, forms and reader
comments go too. ``n_shared``, ``n_both`` and ``n_marked`` count the lines that differencing, both and the check alone delete;
``structure=False`` leaves the check out.

The order is a range sort over (host, path), so one large host is many tasks; the two pages at each border of two tasks
meet in a shuffle of their own. A page is parsed twice: to its line hashes, and to its text.

Defined results: null html is an empty page; a page with no url or alone on its host has no neighbour and is judged by
structure only; repeated rows are each extracted; broken markup ends where the next tag begins; an empty table gives an empty one; other columns are not carried.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import cut, require, shuffle_partitions
from ._words import U, texts
from .components import runs_of

NEUTRAL, CONTENT, TEMPLATE = 0, 1, 2
#: Share of the lines outside marked template, of the page that has fewer, from which two neighbours count as copies.
COPY = 0.8
#: Pages with shared lines that are sent to every task at most (some tens of bytes each); beyond, pages are joined by a shuffle.
MAX_BROADCAST = 200_000
# Fixed lists: HTML element names by role.
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TEMPLATE = frozenset("nav header footer aside form menu dialog button select option head title noscript template iframe object svg canvas audio video search fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert sidebar side rail widget widgets menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments disqus respond reply replies share sharing social related recommended newsletter subscribe signup popup modal overlay pagination pager toolbar login search skip".split()
)
# Elements that may be a template's container inside an article, too; elsewhere any element may.
_CONTAINER = frozenset("div section ul ol dl table aside details figure".split())
_RAW = frozenset("script style textarea xmp noframes noembed".split())
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in _RAW}
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/><]*)")
_PLAIN_ATTRS = re.compile(r"""[^<>"']*""")
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


def _is_template(tag: str, attrs: str, inside: bool) -> bool:
    """Whether an element is template by its name or attributes; ``inside`` an article only containers are, by class or role."""
    if tag in _TEMPLATE:
        return True
    if attrs and tag not in ("html", "body", "article", "main") and not (inside and tag not in _CONTAINER):
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "role" and value.strip() in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            if name == "class" or name == "id" and not inside:
                if not _NAMES.isdisjoint(x for w in value.split() for x in (w, *_SPLIT.split(w)[:1], *_SPLIT.split(w)[-1:])):
                    return True
    return False


def markup(page: str):
    """(text, closing, tag, attributes) of the page's tokens in order: either a text or a tag (lower-case), the other empty.

    One pass: every character is looked at a fixed number of times, however broken the page. A tag ends at its ">", or before a
    "<" outside quotes; a quote without an end is an ordinary character. Comments, declarations and raw texts are dropped.
    """
    at, n = 0, len(page)
    last = {q: page.rfind(q) for q in "\"'>"}
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield page[at:], "", "", ""
            return
        if lt > at:
            yield page[at:lt], "", "", ""
        m = _NAME.match(page, lt + 1)
        if m is None:
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            elif page.startswith(("<!", "<?", "</"), lt) and lt < last[">"]:
                at = page.find(">", lt) + 1
            else:
                yield "<", "", "", ""
                at = lt + 1
            continue
        at = m.end()
        while True:
            at = _PLAIN_ATTRS.match(page, at).end()
            if at >= n or page[at] in "<>":
                break
            at = page.find(page[at], at + 1) + 1 if at < last[page[at]] else at + 1
        tag, attrs = m[2].lower(), page[m.end() : at]
        at += at < n and page[at] == ">"
        if tag in _RAW and not m[1]:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else n
            yield " ", "", "", ""
        else:
            yield "", m[1], tag, attrs


def blocks(page: str | None, structure: bool = True) -> list[tuple[str, int]]:
    """(text, kind) of every non-empty block in page order; text is decoded and its white space is single blanks.
    Without ``structure`` every block is neutral."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    # open elements: (name, role it gives to what is inside: None, CONTENT or TEMPLATE), and how many of each name
    stack: list[tuple[str, int | None]] = []
    opened: Counter = Counter()
    template = content = 0

    def flush() -> None:
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((text, NEUTRAL if not structure else TEMPLATE if template else CONTENT if content else NEUTRAL))

    def pop() -> None:
        nonlocal template, content
        name, role = stack.pop()
        opened[name] -= 1
        template -= role == TEMPLATE
        content -= role == CONTENT

    for text, closing, tag, attrs in markup(page or ""):
        if not tag:
            parts.append(text)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in _BLOCK:
            flush()
        if closing:
            if opened[tag]:
                at = len(stack) - 1
                while stack[at][0] != tag:
                    at -= 1
                if any(role for _, role in stack[at:]):
                    flush()
                while len(stack) > at:
                    pop()
            continue
        if tag in _VOID or attrs.endswith("/") and tag not in _BLOCK:
            continue
        role = None
        if tag in ("article", "main"):
            role = CONTENT
        elif content and tag in ("hgroup", "header") and not template:
            role = None  # an article's own heading; its headings are text of the article
        elif _is_template(tag, attrs, content > 0):
            role = TEMPLATE
        if tag in ("p", "li", "dt", "dd", "option") and stack and stack[-1][0] == tag:
            pop()
        if role is not None:
            flush()
            template += role == TEMPLATE
            content += role == CONTENT
        stack.append((tag, role))
        opened[tag] += 1
    flush()
    return out


def host_path(url: str | None) -> tuple[str | None, str]:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)[^/?#]*([^?#]*)", url or "")
    return (m[1].lower(), m[2] or "/") if m else (None, "")


def lcs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a and b of a longest common subsequence, exact at any length in memory of one row at a time."""
    lo, n = 0, min(len(a), len(b))
    if n:
        diff = np.flatnonzero(a[:n] != b[:n])
        lo = int(diff[0]) if len(diff) else n
    hi = 0
    if n - lo:
        diff = np.flatnonzero(a[::-1][: n - lo] != b[::-1][: n - lo])
        hi = int(diff[0]) if len(diff) else n - lo
    ia = lo + np.flatnonzero(np.isin(a[lo : len(a) - hi], b[lo : len(b) - hi]))
    ib = lo + np.flatnonzero(np.isin(b[lo : len(b) - hi], a[lo : len(a) - hi]))
    pairs = _hirschberg(a[ia], b[ib])
    head = np.arange(lo)
    tail = np.arange(hi, 0, -1)
    x = np.concatenate([head, ia[pairs[0]], len(a) - tail])
    return x, np.concatenate([head, ib[pairs[1]], len(b) - tail])


def _row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    row = np.zeros(len(b) + 1, np.int64)
    for v in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == v)))
    return row


def _hirschberg(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(a) or not len(b):
        return np.zeros(0, int), np.zeros(0, int)
    if len(a) == 1:
        j = np.flatnonzero(b == a[0])[:1]
        return np.zeros(len(j), int), j
    h = len(a) // 2
    k = int(np.argmax(_row(a[:h], b) + _row(a[h:][::-1], b[::-1])[::-1]))
    (i1, j1), (i2, j2) = _hirschberg(a[:h], b[:k]), _hirschberg(a[h:], b[k:])
    return np.concatenate([i1, i2 + h]), np.concatenate([j1, j2 + k])


def line_table(pages: DataFrame, structure: bool = True) -> DataFrame:
    """``key, salt, host, path, url, lines, kinds``: hashes and kinds of each page's blocks; key is a hash of id, url and html."""
    src = pages.select(page_key().alias("key"), "url", "html").where("url is not null and html is not null")
    spec = "key bigint, url string, host string, path string, lines binary, kinds binary"

    def run(batches):
        for b in batches:
            hp = [host_path(u) for u in b.column(1).to_pylist()]
            lines, kinds = [], []
            for t in b.column(2):
                got = blocks(t.as_py(), structure)
                w = [w for _, _, w in texts(pa.array([x for x, _ in got], pa.string()), 1 << 30)]
                lines.append(w[0].spans(w[0].offsets[:-1], w[0].offsets[1:]).tobytes() if w else b"")
                kinds.append(bytes(k for _, k in got))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([h for h, _ in hp], pa.string()), pa.array([p for _, p in hp]), pa.array(lines, pa.binary()), pa.array(kinds, pa.binary())], ["key", "url", "host", "path", "lines", "kinds"])

    return src.mapInArrow(run, spec).where("host is not null").withColumn("salt", F.rand(11))


def page_key():
    return F.xxhash64(F.col("page_id").isNull(), "page_id", F.xxhash64("url"), F.xxhash64("html"))


def align(x: tuple, y: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Positions in x and in y, each (host, lines, kinds), of the lines that the two pages share as template."""
    none = np.zeros(0, int)
    if x[0] != y[0]:
        return none, none
    i, j = lcs(np.frombuffer(x[1], U), np.frombuffer(y[1], U))
    u, v = (np.frombuffer(k[2], np.uint8) != TEMPLATE for k in (x, y))
    least = min(u.sum(), v.sum())
    if least > 3 and (u[i] & v[j]).sum() >= COPY * least:
        return none, none
    return i, j


_SHARED = "key bigint, shared array<int>"


def _shared_rows(rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([np.unique(s).tolist() for _, s in rows], pa.list_(pa.int32()))], ["key", "shared"])


def shared_lines(lines: DataFrame) -> DataFrame:
    """``key, shared``: positions of the lines shared with a nearest page; a page may have a row for each neighbour."""
    order = ["host", "path", "url", "key", "salt"]  # salt: equal rows are split as well
    d = cut(lines.repartitionByRange(max(shuffle_partitions(lines.sparkSession), 2), *order).sortWithinPartitions(*order))
    d = d.select("key", "host", "lines", "kinds")

    def inside(batches):
        held, out = None, []
        for b in batches:
            for me in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held is not None:
                    i, j = align(held[1:], me[1:])
                    out += [(k, s) for k, s in ((held[0], i), (me[0], j)) if len(s)]
                held = me
                if len(out) >= 1000:
                    yield _shared_rows(out)
                    out.clear()
        if out:
            yield _shared_rows(out)

    def ends(batches):
        first = last = None
        for b in batches:
            if b.num_rows:
                first = first or b.slice(0, 1)
                last = b.slice(b.num_rows - 1)
        for side, b in enumerate((first, last)):
            if b is not None:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([side], pa.int32()), *b.columns], ["p", "side", "key", "host", "lines", "kinds"])

    def across(batches):
        for t in runs_of(batches, 1):
            if t.num_rows == 2:
                (_, _, k, *x), (_, _, m, *y) = sorted(zip(*(c.to_pylist() for c in t.columns), strict=True), key=lambda r: -r[1])  # the last of a task, the first of the next
                i, j = align(tuple(x), tuple(y))
                if len(i):
                    yield _shared_rows([(k, i), (m, j)])

    at = cut(d.mapInArrow(ends, "p int, side int, key bigint, host string, lines binary, kinds binary"))
    tasks = sorted(r.p for r in at.where("side = 0").select("p").collect())  # numbers of the sort's tasks
    borders = [(p, 1, i) for i, p in enumerate(tasks)] + [(p, 0, i - 1) for i, p in enumerate(tasks)]
    names = lines.sparkSession.createDataFrame(borders, "p int, side int, border int")
    met = at.join(F.broadcast(names), ["p", "side"]).select("border", "side", "key", "host", "lines", "kinds")
    met = met.repartition("border").sortWithinPartitions("border").mapInArrow(across, _SHARED)
    return d.mapInArrow(inside, _SHARED).unionByName(met)


def extract(pages: DataFrame, structure: bool = True, most: int = MAX_BROADCAST) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page, and how many lines differencing alone (``n_shared``), both (``n_both``)
    and structure alone (``n_marked``) deleted."""
    require(pages, "page_id", "url", "html")
    # a line of an article stays whether shared or not: positions are all a page needs
    s = cut(shared_lines(cut(line_table(pages, structure))))
    s = s.groupBy(F.col("key").alias("k")).agg(F.array_distinct(F.flatten(F.collect_set("shared"))).alias("shared"))
    s = cut(s)
    if s.limit(most + 1).count() <= most:  # a few places for each of so many pages: pages need not move
        s = F.broadcast(s)
    d = pages.select("page_id", "url", "html", page_key().alias("key"))
    d = d.join(s, F.col("key") == F.col("k"), "left").select("page_id", "url", "html", "shared")
    spec = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url {pages.schema['url'].dataType.simpleString()}, text string, n_chars bigint, n_shared bigint, n_both bigint, n_marked bigint"

    def run(batches):
        for b in batches:
            out, counts = [], []
            for t, gone in zip(b.column(2), b.column(3).to_pylist(), strict=True):
                drop = set(gone or ())
                got = blocks(t.as_py(), structure)
                out.append("\n\n".join(x for i, (x, k) in enumerate(got) if k == CONTENT or k == NEUTRAL and i not in drop))
                both = sum(got[i][1] == TEMPLATE for i in drop)
                counts.append((len(out[-1]), sum(got[i][1] == NEUTRAL for i in drop), both, sum(k == TEMPLATE for _, k in got) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(4))], ["page_id", "url", "text", "n_chars", "n_shared", "n_both", "n_marked"])

    return d.mapInArrow(run, spec)
