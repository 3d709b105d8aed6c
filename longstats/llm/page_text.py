"""Main text of web pages: nearest-URL page differencing.

A page becomes lines, one per block of text, each marked by where it stands:
inside an article (or main) element, inside something that is never main text
(menus, headers, footers, sidebars, notices, adverts, forms, reader comments;
by element or by class), or neither: open.

Pages are ordered by host and URL path; each is paired with the neighbour on
the same host that shares more leading path segments (ties: the one before).
The two pages' lines are aligned by their longest common subsequence, and
shared lines are deleted: they belong to the site, not to the page.  A page whose
lines equal its neighbour's throughout is a copy of it and keeps them.  Lines in
an article are the article, shared or not (a passage that two articles quote
is text of both), so by default the alignment decides on open lines;
``articles=True`` puts article lines through it as well.

Class names count as evidence of small blocks only.  A name counts whole: it is one of
``MARKS``, or a compound that begins or ends in one (``cookie-notice``); names of
a page's state (``has-sidebar``, ``no-comments``) don't count, nor does anything on
main, body or html.  An article element is marked by a reader comment's name alone.
Inside running text only adverts and share links go by their name.  Marked blocks
of several lines that would leave the page without any text were containers: their
lines are open.

The order is a range partition of narrow rows (ids and paths), so a hot host is
spread over many tasks; only the rows at partition edges are looked up across.
Pages without lines to decide need no neighbour and their text never moves.

Defined results: NULL, empty or textless html gives an empty text; a NULL URL or one
without host forms a site of its own; unclosed or cut-off markup ends with its
parent; repeated rows and equal URLs each get a row; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .url_rules import url_host, url_path

# fixed values: element names of the HTML standard by what they mean here
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
#: Never main text: as blocks of their own, and inside a block (which goes on after them).
GONE_BLOCK = frozenset("head nav footer aside form dialog menu".split())
GONE_INLINE = frozenset("noscript template object svg annotation annotation-xml canvas audio video button select option datalist".split())
SITE_ONLY = frozenset(["header"])  # a header inside the article is the article's own
MAIN = frozenset(["article", "main"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option "
                  "p pre search section summary table tbody td tfoot th thead tr ul".split())
# fixed values: names of classes, ids and roles that stand for something other than main text
ADVERTS = frozenset("ad ads advert adverts advertisement advertising banner promo promoted promotion share sharing sponsor "
                    "sponsored".split())
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
MARKS = ADVERTS | COMMENTS | frozenset(
    "breadcrumb breadcrumbs consent cookie cookies footer gdpr masthead menu modal navbar nav navigation newsletter notice "
    "notices pagination pager popup recommended related sidebar signup social subscribe subscription toolbar widget".split())
#: First or last words of names that tell a state of the page, not what a block holds.
STATES = frozenset("has no not is with without hide show open closed enabled disabled".split())
NEVER_MARKED = frozenset(["html", "body", "main"])

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
                    re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")

OPEN, ARTICLE, SITE = 0, 1, 2


def marks(attributes: str) -> frozenset[str]:
    """The ``MARKS`` that an element's class, id and role names stand for."""
    if not attributes or "=" not in attributes:
        return frozenset()
    found = set()
    for m in _NAMES.findall(attributes):
        for name in "".join(m).split():
            words = [w for w in _SPLIT.split(re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if w]
            if words and STATES.isdisjoint((words[0], words[-1])):
                found.update(w for w in (words[0], words[-1]) if w in MARKS)
    return frozenset(found)


def whole_names(attributes: str) -> frozenset[str]:
    return frozenset(name.lower() for m in _NAMES.findall(attributes or "") for name in "".join(m).split())


def page_lines(html: str | None) -> list[tuple[str, int]]:
    """(text, where) of every block in page order.

    Scripts, styles, comments and what an inline element marks as no main text leave their block whole around them.
    """
    if not html:
        return []
    lines: list[tuple[str, int]] = []
    by_class: list[int] = []  # of every line the marked block that holds it; 0: none
    text: list[str] = []
    # (element, where its text stands, whether it is left out of its block, number of the marked block, reader comments)
    stack: list[tuple[str, int, bool, int, bool]] = []
    where, muted, marked, at, n, block_no = OPEN, 0, 0, 0, len(html), 0

    def flush() -> None:
        if text:
            line = " ".join(entities.unescape("".join(text)).split())
            if line:
                lines.append((line, where))
                by_class.append(marked)
            text.clear()

    def close(down_to: int) -> None:
        nonlocal where, muted, marked
        muted -= sum(e[2] for e in stack[down_to:])
        del stack[down_to:]
        outer, block = (stack[-1][1], stack[-1][3]) if stack else (OPEN, 0)
        if (outer, block) != (where, marked):
            flush()
            where, marked = outer, block

    while at < n:
        m = _TOKEN.search(html, at)
        if not muted:
            text.append(html[at: m.start() if m else n])
        if m is None:
            break
        at = m.end()
        if m.group(2) is None:
            continue
        name = m.group(2).lower()
        if name == "br":
            text.append(" ")
            continue
        if name in RAW:  # its content is no markup and no text
            if not m.group(1):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else n
            continue
        block = name in BLOCK or name in GONE_BLOCK
        if block:
            flush()
        if m.group(1):
            for i in reversed(range(len(stack))):
                if stack[i][0] == name:
                    close(i)
                    break
            continue
        if block:  # a block ends an open paragraph
            for i in reversed(range(len(stack))):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in BLOCK:
                    break
        if name in VOID or m.group(3).endswith("/"):
            continue
        inside, talk = marked, bool(stack) and stack[-1][4]
        if name in MAIN:
            comment = name == "article" and not COMMENTS.isdisjoint(whole_names(m.group(3)))
            quiet = False
            if comment or talk:  # a reader's comment, or an article element among them
                new, talk = SITE, True
            else:  # whatever is still open outside
                new, inside = ARTICLE, 0
                stack = [(tag, place, False, k, t) for tag, place, _, k, t in stack]
                muted = 0
        else:
            names = frozenset() if name in NEVER_MARKED else marks(m.group(3))
            gone = name in GONE_BLOCK or name in GONE_INLINE or name in SITE_ONLY and where != ARTICLE
            if block:
                new = SITE if gone or names else where
                quiet = False
                talk = talk or not COMMENTS.isdisjoint(names)
                if names and not gone and where == OPEN:
                    block_no += 1
                    inside = block_no
            else:
                new, quiet = where, gone or not ADVERTS.isdisjoint(names)
        if (new, inside) != (where, marked):
            flush()
            where, marked = new, inside
        muted += quiet
        stack.append((name, new, quiet, inside, talk))
    flush()
    if all(w == SITE for _, w in lines):  # containers, not blocks: what their classes say is no evidence
        held = Counter(by_class)
        lines = [(x, OPEN if k and held[k] > 1 else w) for (x, w), k in zip(lines, by_class)]
    return lines


def common_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of ``a``'s lines are in a longest common subsequence with ``b``.

    Equal ends are taken off first, and lines that the other side lacks can't take part.  The rest is the bit-parallel
    recurrence: one long integer per row, whose zero bits mark where the common subsequence grows.
    """
    shared = np.zeros(len(a), bool)
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    shared[:head] = True
    rest = n - head
    differ = np.flatnonzero(a[len(a) - rest:][::-1] != b[len(b) - rest:][::-1]) if rest else np.zeros(0, int)
    tail = (int(differ[0]) if len(differ) else rest) if rest else 0
    if tail:
        shared[len(a) - tail:] = True
    inner_a = np.arange(head, len(a) - tail)
    inner_b = b[head: len(b) - tail]
    inner_a = inner_a[np.isin(a[inner_a], inner_b)]
    inner_b = inner_b[np.isin(inner_b, a[inner_a])]
    if not len(inner_a):
        return shared
    places: dict[int, int] = {}
    for j, x in enumerate(inner_b.tolist()):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(inner_b)) - 1
    rows, v = [], full
    for x in a[inner_a].tolist():
        u = v & places[x]
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    # back from the end: a row's line is in the subsequence if dropping it shortens what the columns left can hold
    j = len(inner_b)
    for i in reversed(range(len(rows))):
        mask = (1 << j) - 1
        before = rows[i - 1] if i else full
        if (~rows[i] & mask).bit_count() > (~before & mask).bit_count():
            shared[inner_a[i]] = True
            j = (~rows[i] & mask).bit_length() - 1  # it matches the column of the last growth
    return shared


def neighbours(sites: DataFrame) -> DataFrame:
    """``(uid, host, path)`` -> ``(uid, near)``: the nearest page of the host by path; none if the host has one page."""
    order = ["host", "path", "uid"]
    ranged = stage(sites.select(*order).repartitionByRange(*order).withColumn("slice", F.spark_partition_id()), "page-order")
    row = F.struct("host", "path", "uid")
    inside = Window.partitionBy("slice").orderBy(*order)
    # one row per slice; its neighbours in other slices are the nearest slices' edges
    edges = ranged.groupBy("slice").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    slices = Window.orderBy("slice")
    edges = edges.select("slice", F.lag("last").over(slices).alias("left"), F.lead("first").over(slices).alias("right"))
    both = (ranged.withColumn("prev", F.lag(row).over(inside)).withColumn("next", F.lead(row).over(inside))
            .join(edges, "slice")
            .select("host", "path", "uid", F.coalesce("prev", "left").alias("prev"),
                    F.coalesce("next", "right").alias("next")))

    def closeness(other: str):
        same = F.zip_with(F.split("path", "/"), F.split(F.col(other)["path"], "/"), lambda a, b: a.eqNullSafe(b))
        leading = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same))
        return F.when(F.col(other)["host"] == F.col("host"), leading).otherwise(-1)

    return (both.withColumn("p", F.coalesce(closeness("prev"), F.lit(-1)))
            .withColumn("q", F.coalesce(closeness("next"), F.lit(-1)))
            .select("uid", F.when((F.col("p") < 0) & (F.col("q") < 0), None)
                    .when(F.col("p") >= F.col("q"), F.col("prev")["uid"]).otherwise(F.col("next")["uid"]).alias("near"))
            .where(F.col("near").isNotNull()))


def _parse(pages: DataFrame, articles: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                pages = [page_lines(h.as_py()) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1),
                     pa.array([any(w == OPEN or articles and w == ARTICLE for _, w in p) for p in pages]),
                     pa.array([[x for x, _ in p if _ != SITE] for p in pages], pa.list_(pa.string())),
                     pa.array([bytes(w for _, w in p) for p in pages], pa.binary()),
                     pa.array([[xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x, _ in p]
                               for p in pages], pa.list_(pa.int64()))],
                    names=["page_id", "url", "open", "lines", "places", "hashes"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, open boolean, lines array<string>, places binary, "
             "hashes array<long>")


def _difference(pairs: DataFrame, kind: str, articles: bool) -> DataFrame:
    """Open pages with their neighbour's lines -> the text left after the shared lines are deleted."""

    def text(lines: list, places: bytes, own: list, other: list | None, other_places: bytes | None) -> str:
        where = np.frombuffer(places, np.uint8)
        own = np.array(own, np.int64)
        gone = np.zeros(len(own), bool)
        if other is not None:
            other = np.array(other, np.int64)
            theirs = np.frombuffer(other_places, np.uint8)
            decides = where != SITE if articles else where == OPEN
            others = theirs != SITE if articles else theirs == OPEN
            if not np.array_equal(own[decides], other[others]):
                gone = common_lines(own, other) & decides
        return "\n".join(x for x, g in zip(lines, gone[where != SITE]) if not g)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(2, 7)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([text(*row) for row in zip(*columns)], pa.string())],
                names=["page_id", "url", "text"])

    return pairs.mapInArrow(run, kind)


def main_text(pages: DataFrame, articles: bool = False) -> DataFrame:
    """page_id, url, text, n_chars.  ``articles``: the alignment decides on lines inside article elements, too."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    parsed = stage(_parse(pages, articles).withColumn("uid", F.monotonically_increasing_id()), "page-lines")
    closed = (parsed.where(~F.col("open")).select("page_id", "url", F.array_join("lines", "\n").alias("text")))
    near = neighbours(parsed.select("uid", url_host(F.coalesce("url", F.lit(""))).alias("host"),
                                    url_path(F.coalesce("url", F.lit(""))).alias("path")))
    # of the neighbour only the lines' hashes move
    others = parsed.select(F.col("uid").alias("n_uid"), F.col("hashes").alias("n_hashes"), F.col("places").alias("n_places"))
    pairs = (near.withColumnRenamed("uid", "p_uid")
             .join(parsed.where("open").select(F.col("uid").alias("o_uid")), F.col("p_uid") == F.col("o_uid"), "left_semi")
             .join(others, F.col("near") == F.col("n_uid")).select("p_uid", "n_hashes", "n_places"))
    opened = (parsed.where("open").join(pairs, F.col("uid") == F.col("p_uid"), "left")
              .select("page_id", "url", "lines", "places", "hashes", "n_hashes", "n_places"))
    texts = closed.unionByName(_difference(opened, f"page_id {kinds['page_id']}, url {kinds['url']}, text string", articles))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


__all__ = ["common_lines", "main_text", "neighbours", "page_lines"]
