"""Main text: alignment against brute force, templates against path counts, what must stay, odd pages."""

import itertools

from webloom.functions.html import parse
from webloom.llm import wrapper

SCHEMA = "page_id long, url string, html string, host string, shape string"


def texts(spark, rows):
    rows = [(i, u, h, "x", "y") for i, u, h in rows]
    return {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_main_text(spark):
    page = lambda i: (i, f"https://h.x/{i}", f"<nav><a href=/>Home {i}</a></nav><div class=cookie-notice>ok</div><article><h1>T{i}</h1><p>Always here.</p><p>Text {i} &amp; <b>more</b><br>of it<aside>side</aside></article><div id=comments>Reader</div>")
    got = texts(spark, [page(i) for i in range(6)] + [(7, None, None), (8, "bad", "")])
    assert got[0] == "T0\n\nText 0 & more of it" and got[7] == got[8] == ""


def test_constant_among_many(spark):
    """More than one part of FAN pages, and hosts of two pages."""
    page = lambda i, n: (1000 * n + i, f"https://h{n}.x/{i}", "<article>" + "".join(f"<p>Text {i} {k}</p>" for k in range(n)) + "<p>Always here.</p></article>")
    rows = [page(i, n) for n in (1, 10, 20, 40) for i in range(150 if n == 10 else 2 if n == 1 else 30)]
    assert texts(spark, rows) == {i: "\n\n".join(f"Text {i % 1000} {k}" for k in range(h.count("<p>") - 1)) for i, _, h in rows}


def test_alignment_decides(spark):
    """A path count takes every p of the body with the text, or none. Alignment tells the constant one from the same words in the article."""
    rows = []
    for i in range(12):
        story = [f"Text {i} {k}" for k in range(1 + i % 4)]
        if i == 5:
            story.insert(1, "Share this page")  # quoted by the story itself
        rows.append((i, f"https://h.x/{i}", "".join(f"<p>{x}</p>" for x in story) + "<h2>End</h2><p>Share this page</p>"))
    got = texts(spark, rows)
    assert got[5] == "Text 5 0\n\nShare this page\n\nText 5 1" and got[4] == "Text 4 0" and all("End" not in t for t in got.values())


def test_what_must_stay(spark):
    rows = [
        (1, "https://a.x/1", "<p>Long main story outside.</p><p>More of it.</p><article>card</article>"),
        (2, "https://b.x/1", '<div class="share-price-report"><p>Shares rose.</p></div><div class="site-header">S</div><div class="adBox">buy</div><div id="sidebar-left">s</div>'),
        (3, "https://c.x/1", "<p><a href=/x>A paragraph that is one link</a></p><table><tr><td>a</td><td>b</td></tr></table><ul><li>one<li>two</ul>"),
        (4, "https://d.x/1", "<p>All of it</p>"),
        (5, "https://d.x/2", "<p>All of it</p>"),
        (5, "https://d.x/2", "<p>All of it</p>"),
    ]
    got = texts(spark, rows)
    assert got == {1: "Long main story outside.\n\nMore of it.\n\ncard", 2: "Shares rose.", 3: "A paragraph that is one link\n\na b\n\none\n\ntwo", 4: "All of it", 5: "All of it"}


def test_deep_and_long_pages(spark):
    deep = "".join(f"<div>t{i}" for i in range(3000))
    long = "<article>" + "".join(f"<p>p{i}</p>" for i in range(3000)) + "</article>"
    rows = [(1, "https://h.x/1", deep), (2, "https://h.x/2", deep + "<p>more"), (3, "https://g.x/1", long), (4, "https://g.x/2", "<article><p>p1</p></article>")]
    got = texts(spark, rows)
    assert got[1] == "\n\n".join(f"t{i}" for i in range(3000)) and got[3].endswith("p2998\n\np2999") and got[4] == "p1"
    assert texts(spark, []) == {}


def test_tree_matching_against_brute_force():
    s = lambda label, *c: wrapper.Shape(label, children=list(c))
    a, b = s("r", s("x", s("y")), s("z")), s("r", s("x"), s("w"), s("z"))
    assert wrapper.matched(a, b) == 3
    assert [c.label for c in wrapper.merge(a, b).children] == ["x", "w", "z"]

    def brute(x, y):
        if x.label != y.label:
            return 0
        if x.text is not None:
            return 1 + (x.text == y.text)
        m, n = len(x.children), len(y.children)
        return 1 + max(sum(brute(x.children[i], y.children[j]) for i, j in zip(p, q, strict=True)) for k in range(min(m, n) + 1) for p in itertools.combinations(range(m), k) for q in itertools.combinations(range(n), k))

    pages = [wrapper.shape_of(*wrapper.blocks_of(parse(h))) for h in ("<p>a<p>b<div>c<p>d</div>", "<p>b<div>c</div><p>d", "<div><p>d</div><p>a<p>c", "<p>a<p>b<p>c<p>a")]
    for x in pages:
        for y in pages:
            assert wrapper.matched(x, y) == brute(x, y)
            assert len(wrapper.aligned(wrapper.tree(wrapper.flat(x)), wrapper.tree(wrapper.flat(y)))) <= brute(x, y)
