import random

import numpy as np
import pytest

from longstats.llm.page_text import ARTICLE, OPEN, SITE, common_lines, main_text, neighbours, page_lines

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header>Site</header><nav><ul><li><a href="/a">m</a></ul></nav><div class="cookie-notice">c</div><!-- <p>no</p> -->
<article><header><h1>A &amp; B</h1></header><p><b>x  y<br>z<p>two&nbsp;
words <i>w</i>ord<aside>side</aside><form><p>f</form><div id="ad-1">ad</div><p>&#65;&copy; end</article>
<section id="userComments"><article class="comment"><p>c1</article></section><footer>f</footer></body></html>"""


def test_lines_and_places():
    got = page_lines(PAGE)
    assert [x for x, w in got if w == ARTICLE] == ["A & B", "x y z", "two words word", "A© end"]
    assert [x for x, w in got if w == SITE] == ["Site", "m", "c", "side", "f", "ad", "c1", "f"]
    assert not [x for x, w in got if w == OPEN]


def test_broken_markup():
    assert page_lines(None) == [] == page_lines("") == page_lines("<p>  </p>")
    assert page_lines("<nav><a>menu<article><p>kept<p>cut &am") == [("menu", SITE), ("kept", ARTICLE), ("cut &am", ARTICLE)]
    assert page_lines("<article><p>a</p><p>b</") == [("a", ARTICLE), ("b</", ARTICLE)]
    assert page_lines("<article>a<script>x < y") == [("a", ARTICLE)]
    assert page_lines("1 < 2 and 3 > 2") == [("1 < 2 and 3 > 2", OPEN)]
    assert page_lines("<p title='a>b'>t") == [("t", OPEN)]


def test_blocks_go_on_around_what_is_left_out():
    text = lambda html: [x for x, w in page_lines(f"<article>{html}</article>") if w == ARTICLE]
    assert text("<p>a <script>x</script>b <!-- c --> d</p>") == ["a b d"]
    assert text("<p>a <span class='ad'>buy</span> b</p>") == ["a b"]
    assert text("<p>a<style>p{}</style><noscript>n</noscript> <button>go</button> b<p>c") == ["a b", "c"]
    assert text("<p>a <span class='ad'>never closed<p>b</p>") == ["a", "b"]
    assert text("<a class='promo'><div>buy</div></a><div>c<div class='share'>s</div>d</div>") == ["c", "d"]
    assert text("<ul><li>x<li>y</ul><table><tr><td>1<td>2</table><h2>h</h2>z") == ["x", "y", "1", "2", "h", "z"]
    assert text("<P CLASS=notice>n</P><p>k</p>") == ["k"]


def kept(html):
    return [x for x, w in page_lines(html) if w != SITE]


def test_classes_are_evidence_of_small_blocks_only():
    assert kept('<main class="no-comments"><p>Real text one</p></main>') == ["Real text one"]
    assert kept('<article class="post has-sidebar"><p>Real</p></article>') == ["Real"]
    assert kept('<article class="post related"><p>Real</p></article>') == ["Real"]
    assert kept('<div class="page has-sidebar"><p>Real</p><p>two</p></div>') == ["Real", "two"]
    assert kept('<div class="sidebar"><p>Real</p><p>two</p></div>') == ["Real", "two"]  # it holds all that there is
    assert kept('<div class="sidebar"><p>s</p><p>t</p></div><p>Real</p>') == ["Real"]
    assert kept('<article><p>See <span class="related">related</span> work</p></article>') == ["See related work"]
    assert kept("<article><p>So <math><mi>x</mi><annotation>\\x</annotation></math> holds</p></article>") == ["So x holds"]
    assert kept("<div class='cookie-notice'>c</div><div class='left-menu'>m</div><p>k</p>") == ["k"]
    assert kept("<div class='comments-open'>o</div><div id='page-footer'>f</div><p>k</p>") == ["o", "k"]
    assert kept("<article><p>a</p></article><div id=comments><article><p>one</p></article><p>two</p></div>") == ["a"]
    assert kept("<article class=comment><p>one</p></article><article><p>a</p></article>") == ["a"]
    assert kept("<div class='ad'>buy</div>") == [] == kept("<nav><p>a</p><p>b</p></nav>")


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_longest_common_subsequence():
    random.seed(4)
    for _ in range(500):
        a, b = ([random.randint(0, 4) for _ in range(random.randint(0, 14))] for _ in range(2))
        kept = [x for x, k in zip(a, common_lines(np.array(a, np.int64), np.array(b, np.int64))) if k]
        other = iter(b)
        assert len(kept) == lcs(a, b) and all(x in other for x in kept)


def test_neighbours_across_partitions(spark):
    rows = [(i, f"h{i % 3}", f"/{'ab'[i % 2]}/{i:03d}") for i in range(60)] + [(100, "alone", "/x"), (101, "", "")]
    got = {r["uid"]: r["near"] for r in neighbours(spark.createDataFrame(rows, "uid long, host string, path string").repartition(7)).collect()}
    by = {}
    for uid, host, path in rows:
        by.setdefault(host, []).append((path, uid))
    for host, pages in by.items():
        pages.sort()
        for k, (path, uid) in enumerate(pages):
            near = [pages[j] for j in (k - 1, k + 1) if 0 <= j < len(pages)]
            same = [sum(x == y for x, y in list(zip(path.split("/"), p.split("/")))[:2]) for p, _ in near]
            assert got.get(uid) == (near[same.index(max(same))][1] if near else None)


def test_shared_open_lines_go(spark):
    page = "<div>Welcome</div><p>{}</p><p>shared line</p><div>Imprint</div>"
    pages = [(i, f"http://h.org/a/{i}", page.format(f"own text {i}"), "x") for i in range(5)]
    pages += [(20, "http://copy.org/1", page.format("same"), "x"), (21, "http://copy.org/2", page.format("same"), "x")]
    pages += [(30, None, "<p>free</p>", "x"), (31, "http://k.org/", None, "x"), (32, "http://k.org/", "", "x")]
    pages += [(40, "http://z.org/1", PAGE, "x"), (40, "http://z.org/1", PAGE, "x")]
    got = main_text(spark.createDataFrame(pages, "page_id int, url string, html string, text string")).collect()
    assert len(got) == len(pages)
    text = {r["page_id"]: r["text"] for r in got}
    assert all(text[i] == f"own text {i}" for i in range(5))
    assert text[20] == text[21] == "Welcome\nsame\nshared line\nImprint"
    assert (text[30], text[31], text[32]) == ("free", "", "")
    assert text[40] == "A & B\nx y z\ntwo words word\nA© end"
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def whole(rows, articles):
    """Brute force of the whole query over (page_id, host, path, html): lines, nearest page, plain LCS, deletion."""
    out, by = {}, {}
    for i, host, path, html in rows:
        by.setdefault(host, []).append((path, i, page_lines(html)))
    decided = (OPEN, ARTICLE) if articles else (OPEN,)
    for pages in by.values():
        pages.sort(key=lambda p: p[:2])
        for k, (path, i, lines) in enumerate(pages):
            near = [pages[j] for j in (k - 1, k + 1) if 0 <= j < len(pages)]
            leading = []
            for p, _, _ in near:
                pair = list(zip(path.split("/"), p.split("/")))
                leading.append(next((n for n, (a, b) in enumerate(pair) if a != b), max(len(path.split("/")), len(p.split("/")))))
            other = near[leading.index(max(leading))][2] if near else None
            gone = [False] * len(lines)
            if other is not None and [x for x, w in lines if w in decided] != [x for x, w in other if w in decided]:
                gone = [g and w in decided for g, (_, w) in zip(shared(lines, other), lines)]
            out[i] = "\n".join(x for (x, w), g in zip(lines, gone) if w != SITE and not g)
    return out


def shared(lines, other):
    """The lines of the plain quadratic longest common subsequence; in the test's pages it is unique."""
    a, b = [x for x, _ in lines], [x for x, _ in other]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [False] * len(a), 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out[i], i, j = True, i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


@pytest.mark.parametrize("articles", [False, True])
def test_whole_query_equals_brute_force(spark, articles):
    rng = random.Random(6)
    rows = []
    for i in range(150):
        host = "hot.org" if i % 3 else f"h{i % 7}.org"  # a third and more of all pages on one host
        own = [f"own {i} line {n}" for n in range(rng.randint(0, 4))]
        frame = [f"frame {n}" for n in range(rng.randint(1, 3))]
        body = "".join(f"<p>{x}</p>" for x in own + ["license"] * (i % 4 == 0))
        if i % 2:
            body = f"<article><p>shared head</p>{body}</article>"
        rows.append((i, host, f"/{'ab'[i % 2]}/{i:03d}", "".join(f"<div>{x}</div>" for x in frame) + body + "<footer>f</footer>"))
    rows.append((900, "hot.org", "/long/1", "".join(f"<p>line {n}</p>" for n in range(4000))))
    rows.append((901, "hot.org", "/long/2", "".join(f"<p>line {n}</p>" for n in range(0, 4000, 3))))
    df = spark.createDataFrame([(i, f"http://{h}{p}", x) for i, h, p, x in rows], "page_id int, url string, html string")
    got = {r["page_id"]: r["text"] for r in main_text(df.repartition(5), articles=articles).collect()}
    want = whole(rows, articles)
    assert got == want
    assert any("shared head" in t for t in want.values()) != articles


def test_empty(spark):
    assert main_text(spark.createDataFrame([], "page_id int, url string, html string")).collect() == []
