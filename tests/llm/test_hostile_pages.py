"""Pages made to stall or break the reader, and alignment against a plain one."""

import random
import time
from functools import cache

import pytest

from rollcall.llm import html_extraction as he

LONG = {
    "open quotes": '<p a="' * 170_000, "open brackets": "<a" * 500_000, "unclosed titles": "<title>" * 150_000, "closing tags of nothing": "<div>" * 100_000 + "</x>" * 120_000,
    "declarations": "<!x" * 300_000, "brackets inside quotes": "<p '><p '<p '><p '" * 55_000 + '"', "a long number": "&#" + "9" * 1_000_000 + ";", "half closing tags": "<title>x>" + "</title" * 140_000,
}


@pytest.mark.parametrize("kind", list(LONG))
def test_a_megabyte_is_read_in_linear_time(kind):
    def seconds(html):
        best = []
        for _ in range(2):
            start = time.perf_counter()
            he.Page(html)
            best.append(time.perf_counter() - start)
        return min(best)

    html = LONG[kind]
    assert seconds(html) < 6 and seconds(html) < 12 * seconds(html[: len(html) // 4]) + 0.2  # a square would be 16 times


def blocks(html):
    return [b[1] for b in he.Page(html).blocks]


def test_odd_pages_are_read_as_they_stand():
    assert blocks('<p a="x>y">one</p><p b=">two') == ["one", "two"]
    assert blocks("a < b <p>c<!-- d <p> --> e</p><!-- f") == ["a < b", "c e"]
    assert blocks("<p>x<title>y</p>z") == ["xy", "z"] and blocks("<p>x<script>y</p>z") == ["x"]
    assert blocks("&#" + "0" * 6000 + "65;&#" + "9" * 5000 + "; &#0000065;") == ["A� A"]
    assert blocks("<a;b>x</a;b>y") == ["x", "y"] and he.read_skeleton(he.Page("<a;b><c;d>x").skeleton())[0] == ["#", "a b", "c d"]
    assert blocks("") == [] and blocks("<") == ["<"] and blocks("<p") == ["<p"]


def plain(a, b):
    """The size of the largest mapping, by the definition."""
    (la, ca, _), (lb, cb, _) = he.read_skeleton(a), he.read_skeleton(b)

    def best(x, y):
        @cache
        def rest(i, j):
            if i == len(ca[x]) or j == len(cb[y]):
                return 0
            p, q = ca[x][i], cb[y][j]
            return max(rest(i + 1, j), rest(i, j + 1), best(p, q) + rest(i + 1, j + 1) if la[p] == lb[q] else 0)

        return 1 + rest(0, 0)

    return best(0, 0)


def tree(rng):
    labels, children = ["#"], [[]]
    for i in range(1, rng.randrange(2, 16)):
        labels.append(rng.choice("aab"))
        children.append([])
        children[rng.randrange(i)].append(i)
    out = []

    def go(i, parent):
        out.append(f"{parent}/{labels[i]}")
        number = len(out) - 1
        for c in children[i]:
            go(c, number)

    go(0, -1)
    return ";".join(out)


def test_alignment_is_as_large_as_can_be_and_keeps_order_and_parents():
    rng = random.Random(5)
    for _ in range(600):
        a, b = tree(rng), tree(rng)
        m = he.match(a, b)
        (la, _, pa), (lb, _, pb) = he.read_skeleton(a), he.read_skeleton(b)
        assert len(m) == plain(a, b) and len(set(m.values())) == len(m) and m[0] == 0
        assert all(la[x] == lb[y] and (x == 0 or m[pa[x]] == pb[y]) for x, y in m.items())
        inside = sorted(m.items())
        assert all(y1 < y2 for (x1, y1), (x2, y2) in zip(inside, inside[1:], strict=False) if pa[x1] == pa[x2])


def test_thousands_of_alternating_siblings():
    a = "-1/#;0/table;" + ";".join(["1/tr.odd;1/tr.even"] * 1000)
    b = "-1/#;0/table;1/th;" + ";".join(["1/tr.even;1/tr.odd;1/x"] * 667)
    start = time.perf_counter()
    assert len(he.match(a, b)) == 2 + 2 * 667  # the odd and even rows of b, in their order, are a part of a's
    assert time.perf_counter() - start < 3


def test_slots_of_several_forms_meet_over_their_host(spark):
    """A notice inside the article is the same on all pages, whatever else a form holds; alignment tells it from the text around it."""
    page = lambda i, extra: f"<html><body><div class=x>{extra}<div class=y><p>Buy our own great book now</p><h2>title {i}</h2><p>{'words of article %d ' % i * 20}</p></div></div></body></html>"
    rows = [(i, "http://h.example/" + str(i), page(i, ["", "<ul><li>one %d</li></ul>" % i, "<table><tr><td>t %d</td></tr></table>" % i][i % 3])) for i in range(30)]
    got = {r.page_id: r.text for r in he.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(30):
        assert "great book" not in got[i] and f"title {i}" in got[i] and f"words of article {i}" in got[i]
