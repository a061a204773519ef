"""Main text of pages by wrapper induction.

A page is cut down to a tree of its block elements, in order and with repeats, whose leaves are its blocks of text; what other roles hold (menus,
headers, footers, asides, notices, adverts, forms, scripts, comments) is taken out by elements' names, roles and classes. Pages of one host are aligned
by simple tree matching: the largest set of node pairs that keeps parents and order, where a leaf with an equal text counts as one pair more. Aligned
trees are merged into a wrapper; a leaf of it holds the text that may be its majority and how many pages speak for it (a majority vote, which
merges). Hosts of any size are merged in parts of FAN pages and the wrappers of parts again, so no task holds a host.

A text that is constant on a host is the majority of its leaf in some part. So the leaves whose texts are on too few of a part's pages to be
a majority anywhere are left out before its trees are aligned, and the leaves that are no majority are pruned from its wrapper. Each different page is
then aligned with its host's wrapper, and those whose text at a leaf equals the wrapper's are counted exactly: a leaf that more than SHARE of
the host's different pages agree on is template, and all else is a slot, which is content. An equal text elsewhere on a page stays.

Null and empty pages give an empty text, as do pages without content; where all of a page is template, its text is kept. A host with one
different page has no template. A host that is null or cannot be read is one host. Repeated rows are pages of their own and count once for the template.
Texts are never cut, nesting may be of any depth. Other columns, whatever their names, are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.html import Node, parse
from webloom.llm.common import arrow_batches, runs, written

FAN = 64
#: A constant text is on more than this share of a host's different pages.
SHARE = 0.5
#: Bytes of wrappers that are broadcast.
BROADCAST_BYTES = 8 << 20

_DROP_TAGS = frozenset("script style noscript template nav footer aside form button select textarea input iframe svg canvas object embed dialog menu head title audio video map".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: A class or id names a role if all its words are of these two sets and one is of the first.
_ROLE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar sidenav footer header masthead topbar ad ads advert adverts advertisement adsense sponsor sponsored promo cookie cookies consent gdpr notice popup modal newsletter subscribe login comment comments disqus respond replies pagination".split()
)
_PLACE_WORDS = frozenset("site page main top bottom left right primary secondary global mobile desktop sticky fixed bar box block banner container wrapper wrap area section inner outer list items item links widget unit slot form thread overlay message policy js id".split())
_BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main ol p pre section summary table tbody tfoot thead tr ul".split()
)
_SPACED = frozenset({"br", "td", "th", "wbr", "img"})
_WORDS = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _names_role(name: str) -> bool:
    words = {w.lower() for w in _WORDS.findall(_CAMEL.sub(" ", name))}
    return not words.isdisjoint(_ROLE_WORDS) and words <= _ROLE_WORDS | _PLACE_WORDS


def _dropped(node: Node, in_article: bool) -> bool:
    if node.tag in _DROP_TAGS or "hidden" in node.attrs or (node.get("role") or "").lower() in _DROP_ROLES or node.get("aria-hidden") == "true":
        return True
    if node.tag == "header":
        return not in_article
    if node.tag in ("main", "body", "html"):
        return False
    return any(_names_role(x) for x in (*node.classes, node.get("id") or ""))


def blocks_of(page: Node) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    """The page's block elements (parent, label; the parent comes first, -1 for none) and its blocks in order (element, text)."""
    elements: list[tuple[int, str]] = []
    raw: list[tuple[int, list[str]]] = []
    fresh = True
    # (node, text or None for a block's end, element, in an article)
    stack: list = [(page, -1, False)]
    while stack:
        x, at, in_article = stack.pop()
        if x is None:
            fresh = True
            continue
        if isinstance(x, str):
            if fresh or raw[-1][0] != at:
                raw.append((at, []))
                fresh = False
            raw[-1][1].append(x)
            continue
        if _dropped(x, in_article):
            continue
        in_article = in_article or x.tag in ("article", "main") or x.get("role") == "main" or x.get("itemprop") == "articleBody"
        if x.tag in _BLOCKS:
            elements.append((at, ".".join([x.tag, *sorted(x.classes)])))
            at, fresh = len(elements) - 1, True
            stack.append((None, at, in_article))
        elif x.tag in _SPACED:
            stack.append((" ", at, in_article))
        if x.tag in ("td", "th"):
            stack.append((" ", at, in_article))
        stack.extend((c, at, in_article) for c in reversed(x.children))
    blocks = ((at, re.sub(r"\s+", " ", "".join(text)).strip()) for at, text in raw)
    return elements, [(at, text) for at, text in blocks if text]


class Shape:
    """A node of a tree or wrapper: label, the pages that have it, its children, and for a leaf its text (a hash), the votes for it and its place."""

    __slots__ = ("label", "text", "pages", "votes", "children", "place")

    def __init__(self, label: str, text: int | None = None, pages: int = 1, votes: int = 1, children: list[Shape] | None = None, place: int = -1):
        self.label, self.text, self.pages, self.votes, self.children, self.place = label, text, pages, votes, children or [], place


def flat(root: Shape) -> list:
    """A tree as a list of nodes in order, without nesting: depth, label, text, pages, votes."""
    out, stack = [], [(root, 0)]
    while stack:
        x, depth = stack.pop()
        out.append([depth, x.label, x.text, x.pages, x.votes] if x.pages > 1 or x.votes != 1 else [depth, x.label, x.text])
        stack.extend((c, depth + 1) for c in reversed(x.children))
    return out


def tree(nodes: list) -> Shape:
    """The tree of a flat list; leaves are numbered in order."""
    path: list[Shape] = []
    place = 0
    for depth, label, text, *counts in nodes:
        node = Shape(label, text, *counts, place=place if text is not None else -1)
        place += text is not None
        del path[depth:]
        if path:
            path[-1].children.append(node)
        path.append(node)
    return path[0]


def _key(text: str) -> int:
    """48 bits of a text."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=6).digest(), "little")


def with_texts(nodes: list, texts: set[int]) -> Shape:
    """The tree of a flat list without the leaves of other texts, and without elements that lead to no leaf; places are those in the whole list."""
    root = tree(nodes)
    stack = [root]
    order = []
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(x.children)
    for x in reversed(order):
        x.children = [c for c in x.children if (c.text in texts if c.text is not None else c.children)]
    return root


def shape_of(elements: list[tuple[int, str]], blocks: list[tuple[int, str]]) -> Shape:
    """The tree of a page's blocks: the elements that lead to them, in order, and a leaf for each block."""
    root = Shape("")
    made: dict[int, Shape] = {-1: root}
    for at, text in blocks:
        missing = []
        while at not in made:
            missing.append(at)
            at = elements[at][0]
        for k in reversed(missing):
            made[k] = Shape(elements[k][1])
            made[at].children.append(made[k])
            at = k
        made[at].children.append(Shape("#", _key(text)))
    return root


def matched(a: Shape, b: Shape, known: dict | None = None) -> int:
    """The size of the largest simple tree matching: pairs of nodes of one label, parents with parents, in order; an equal text is a pair, too."""
    known = {} if known is None else known
    if a.label != b.label:
        return 0
    if a.text is not None or b.text is not None:
        return 1 + (a.text == b.text)
    if (got := known.get((id(a), id(b)))) is None:
        got = known[id(a), id(b)] = _best(a.children, b.children, known)[-1][-1] + 1
    return got


def _best(xs: list[Shape], ys: list[Shape], known: dict) -> list[list[int]]:
    best = [[0] * (len(ys) + 1)]
    for x in xs:
        before, row, last = best[-1], [0], 0
        for j, y in enumerate(ys):
            up = before[j + 1]
            if up > last:
                last = up
            if x.label == y.label:
                both = before[j] + (1 + (x.text == y.text) if x.text is not None else matched(x, y, known))
                if both > last:
                    last = both
            row.append(last)
        best.append(row)
    return best


def _pairs(xs: list[Shape], ys: list[Shape], known: dict) -> list[tuple[Shape | None, Shape | None]]:
    """The children of two matched nodes in one order: pairs, and those that only one side has."""
    a = 0
    while a < len(xs) and a < len(ys) and xs[a].text is not None and xs[a].text == ys[a].text:  # equal leaves at the start are pairs of a largest matching
        a += 1
    best = _best(xs[a:], ys[a:], known)
    out: list[tuple[Shape | None, Shape | None]] = []
    i, j = len(xs) - a, len(ys) - a
    while i or j:
        x, y = xs[a + i - 1] if i else None, ys[a + j - 1] if j else None
        if x and y and x.label == y.label and best[i][j] == best[i - 1][j - 1] + matched(x, y, known):
            out.append((x, y))
            i, j = i - 1, j - 1
        elif x and (not y or best[i - 1][j] == best[i][j]):
            out.append((x, None))
            i -= 1
        else:
            out.append((None, y))
            j -= 1
    return [*zip(xs[:a], ys[:a], strict=True), *reversed(out)]


def _deep() -> None:
    """Matching goes as deep as pages do; frames of Python functions are not on the C stack."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))


def merge(a: Shape, b: Shape, known: dict | None = None) -> Shape:
    """One wrapper of both: matched nodes are added up, leaves vote, others are put in at their place."""
    known = {} if known is None else known
    text, votes = a.text, a.votes
    if a.text is not None and b.text is not None:
        if a.text == b.text:
            votes += b.votes
        else:
            text, votes = (a.text, a.votes - b.votes) if a.votes >= b.votes else (b.text, b.votes - a.votes)
    children = [merge(x, y, known) if x and y else x or y for x, y in _pairs(a.children, b.children, known)]
    return Shape(a.label, text, a.pages + b.pages, votes, children)


def pruned(root: Shape) -> Shape:
    """Without the leaves whose text is no majority of the pages, and what leads to none."""

    def kept(x: Shape) -> bool:
        if x.text is not None:
            return x.votes > 0 and x.pages > SHARE * root.pages
        x.children = [c for c in x.children if kept(c)]
        return bool(x.children)

    kept(root)
    return root


def aligned(page: Shape, wrapper: Shape) -> dict[int, int]:
    """The page's leaves whose text equals that of the wrapper's leaf that they are matched with: place to place."""
    out, stack, known = {}, [(page, wrapper)], {}
    while stack:
        a, b = stack.pop()
        if a.text is not None:
            if a.text == b.text:
                out[a.place] = b.place
        else:
            stack.extend((x, y) for x, y in _pairs(a.children, b.children, known) if x and y)
    return out


def _json(root: Shape) -> str:
    return json.dumps(flat(root), separators=(",", ":"))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns before html, with the page's shape and texts."""
    for batch in batches:
        found = [blocks_of(parse(x)) for x in batch.column(batch.num_columns - 1).to_pylist()]
        shapes = [_json(shape_of(e, b)) for e, b in found]
        texts = [[t.encode("utf-8", "replace").decode() for _, t in b] for _, b in found]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(shapes, pa.string()), pa.array(texts, pa.list_(pa.string()))], names=[*batch.schema.names[:-1], "shape", "texts"])


def _induce(prune: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of (host, part, shape or wrapper), sorted: a wrapper for each host and part."""
        _deep()
        for t in runs(batches, 2):
            one, bodies = None, [json.loads(body) for body in t["body"].to_pylist()]
            on = Counter(x for nodes in bodies for x in {x[2] for x in nodes if x[2] is not None})
            often = {x for x, n in on.items() if n > SHARE * len(bodies)} if prune else set(on)
            for nodes in bodies:
                shape = with_texts(nodes, often)
                one = shape if one is None else merge(one, shape)
            yield pa.RecordBatch.from_arrays([pa.array([t["host"][0].as_py()]), pa.array([_json(pruned(one) if prune else one)])], names=["host", "body"])

    return run


def wrappers(pages: DataFrame) -> DataFrame:
    """host (a hash), pages, body: the wrapper of each host with at least two different pages, from all of them. pages: host, shape, each once; written."""
    level = pages.select("host", F.col("shape").alias("body"))
    counts = written(level.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where("pages > 1"), "hosts")
    most, number = counts.agg(F.max("pages"), F.count(F.lit(1))).first()
    hosts = F.broadcast(counts) if number < 100_000 else counts
    level = level.join(hosts, "host").select("host", F.pmod(F.xxhash64("body"), F.ceil(F.col("pages") / FAN)).cast("int").alias("part"), "body")
    most, k = -(-(most or 0) // FAN), 0
    while True:
        dealt = level.repartition("host", "part").sortWithinPartitions("host", "part", "body").select("host", "part", "body")
        made = written(dealt.mapInArrow(_induce(k == 0), "host long, body string"), f"wrappers{k}")
        if most <= 1:
            return made.join(hosts, "host").select("host", "pages", "body")
        most, k = -(-most // FAN), k + 1
        level = made.select("host", F.pmod(F.xxhash64("body"), F.lit(most)).cast("int").alias("part"), "body")


class _Wrappers:
    """The wrapper of a body, kept while rows of one host follow each other: its tree and its texts."""

    def __init__(self):
        self.held: tuple = (None, None, None)

    def leaves(self, shape: str, body: str) -> dict[int, int]:
        if self.held[0] != body:
            nodes = json.loads(body)
            self.held = body, tree(nodes), {x[2] for x in nodes if x[2] is not None}
        return aligned(with_texts(json.loads(shape), self.held[2]), self.held[1])


def _agreed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host and leaf: the wrapper's leaves that different pages (host, shape, body) agree with."""
    _deep()
    known = _Wrappers()
    for batch in batches:
        host, leaf = [], []
        for h, shape, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = set(known.leaves(shape, body).values())
            host += [h] * len(found)
            leaf += found
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.int64()), pa.array(leaf, pa.int32())], names=["host", "leaf"])


def _content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, url and text of pages (id, url, shape, texts, body, constant)."""
    _deep()
    known = _Wrappers()
    for batch in batches:
        out = []
        for shape, texts, body, constant in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
            found = known.leaves(shape, body) if constant else {}
            slots = [t for i, t in enumerate(texts) if found.get(i, -1) not in constant] if found else texts
            out.append("\n\n".join(slots or texts))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.string())], names=[*batch.schema.names[:2], "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per page: id_col, url_col, text, n_chars."""
    arrow_batches(pages.sparkSession, 128)
    host = F.xxhash64(F.lower(F.coalesce(F.regexp_extract(url_col, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1), F.lit(""))))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(html_col, F.lit("")).alias("html"))
    kind = dict(rows.dtypes)
    head = f"id {kind['id']}, url {kind['url']}, host long"
    parsed = written(rows.mapInArrow(_parsed, f"{head}, shape string, texts array<string>"), "parsed")
    different = written(parsed.groupBy("host", "shape").agg(F.lit(1).alias("n")).select("host", "shape"), "different")
    found = written(wrappers(different), "templates")
    size = found.agg(F.sum(F.length("body"))).first()[0] or 0
    side = lambda df: F.broadcast(df) if size <= BROADCAST_BYTES else df  # noqa: E731  as many bytes bound the templates' leaves
    agreed = different.join(side(found.select("host", "body")), "host").mapInArrow(_agreed, "host long, leaf int").groupBy("host", "leaf").agg(F.count(F.lit(1)).alias("n"))
    constant = agreed.join(side(found.select("host", "pages")), "host").where(F.col("n") > SHARE * F.col("pages")).groupBy("host").agg(F.collect_list("leaf").alias("constant"))
    known = written(found.select("host", "body").join(constant, "host"), "constant")
    out = parsed.join(side(known), "host", "left").select("id", "url", "shape", "texts", "body", "constant").mapInArrow(_content, f"id {kind['id']}, url {kind['url']}, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text").withColumn("n_chars", F.length("text").cast("long"))
