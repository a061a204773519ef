"""Queries that hold single operators against worked cases: what goes in, and what the rules say must come out, side by side in the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.functions import urls as U
from webloom.operators import packs as K
from webloom.operators import pages as P
from webloom.operators import site as S
from webloom.sources import discovery as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "true" if x else "false"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def _cases(name: str, inputs: list[str], expression: Callable[..., Column], cases: list[tuple]) -> None:
    """A query of inputs and out: expression of the inputs, which must be each case's last value."""
    kind = next(("boolean" if isinstance(c[-1], bool) else "string" for c in cases if c[-1] is not None))

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = spark.createDataFrame([(i, *c[:-1]) for i, c in enumerate(cases)], ", ".join(["nth long", *(f"{n} string" for n in inputs)]))
        return table.select("nth", *inputs, expression(*[F.col(n) for n in inputs]).cast(kind).alias("out"))

    QUERIES[name] = query
    rows = ", ".join("(" + ", ".join([str(i), *map(_literal, c)]) + ")" for i, c in enumerate(cases))
    casts = ", ".join([f"{n}::VARCHAR AS {n}" for n in inputs] + [f"out::{'BOOLEAN' if kind == 'boolean' else 'VARCHAR'} AS out"])
    SQL[name] = f"SELECT nth::BIGINT AS nth, {casts} FROM (VALUES {rows}) AS t(nth, {', '.join(inputs)}, out)"


_AT = "https://a.b/x/y?q=1#f"
_cases("cases_resolve", ["href", "base"], U.resolve, [
    ("/p", _AT, "https://a.b/p"), ("p", _AT, "https://a.b/x/p"), ("../z", _AT, "https://a.b/z"), ("../../z/./w/..", _AT, "https://a.b/z/"), ("./", _AT, "https://a.b/x/"), ("?r=2", _AT, "https://a.b/x/y?r=2"),
    ("#g", _AT, "https://a.b/x/y?q=1#g"), ("", _AT, "https://a.b/x/y?q=1"), ("//C.d/e", _AT, "https://c.d/e"), ("HTTP://E.f:80", _AT, "http://e.f/"), ("mailto:x@y.z", _AT, "mailto:x@y.z"), (" /t ", _AT, "https://a.b/t"),
    ("/a/../../b", _AT, "https://a.b/b"), ("p?x=../y", _AT, "https://a.b/x/p?x=../y"), (None, _AT, None),
])
_cases("cases_internal", ["href", "seed"], U.is_internal, [
    ("/a", "https://a.b/", True), ("//other.com/x", "https://a.b/", False), ("//a.b/x", "https://a.b/", True), ("http://a.b/x", "https://a.b/", False), ("https://www.a.b/", "https://a.b/", False), ("mailto:a@a.b", "https://a.b/", False),
    ("tel:1", "https://a.b/", False), ("javascript:x", "https://a.b/", False), ("https://A.b:443/x", "https://a.b/", True), ("#top", "https://a.b/", True),
])
_cases("cases_normalize", ["url"], U.normalize, [
    ("https://a.b/x/?utm_source=q&b=2&a=1#f", "https://a.b/x?a=1&b=2"), ("https://a.b", "https://a.b/"), ("https://a.b/?q=100%", "https://a.b/?q=100%25"), ("https://a.b/?q=a%20b", "https://a.b/?q=a+b"), ("https://A.B:443/X/", "https://a.b/X"),
    ("https://a.b/?gclid=1", "https://a.b/"), ("https://a.b/?b&a", "https://a.b/?a=&b="),
])
_cases("cases_low_value", ["url"], U.is_low_value, [
    ("https://a.b/tag/x", True), ("https://a.b/category", True), ("https://a.b/2024/05", True), ("https://a.b/2024/05/06/a", False), ("https://a.b/2024/05/06/a/b", True), ("https://a.b/x/feed/", True), ("https://a.b/wp-json/v2", True),
    ("https://a.b/p?replytocom=5", True), ("https://a.b/p?q=100%", False), ("https://a.b/tagged", False), ("https://a.b/", False),
])
_cases("cases_media", ["url"], U.upgrade_media, [
    ("https://i0.wp.com/a.b/p.jpg?w=300&ssl=1&x=100%", "https://i0.wp.com/a.b/p.jpg?x=100%25"), ("https://a.b/p.jpg?v=3", "https://a.b/p.jpg?v=3"), ("https://static.wixstatic.com/media/ab_12~mv2.png/v1/fill/w_9,h_9/p.png", "https://static.wixstatic.com/media/ab_12~mv2.png/v1/fit/w_1800,h_1800,al_c,q_85,enc_jpg/ab_12~mv2.png"),
])
_cases("cases_image_like", ["url"], U.looks_like_image, [("https://a.b/p.JPG?x", True), ("https://static.wixstatic.com/media/ab_12~mv2.png/v1/x", True), ("https://a.b/p.html", False), ("https://a.b/", False)])
_cases("cases_path", ["url"], U.path_name, [("https://a.b/", "home"), ("https://a.b/x/y/", "x/y"), ("https://a.b", "home")])
_cases("cases_same_origin", ["a", "b"], U.is_same_origin, [("https://a.b/x", "https://a.b:443/y", True), ("http://a.b/", "https://a.b/", False), ("x", "https://a.b/", False)])
_cases("cases_slug", ["name"], T.slug, [
    ("Hello World.html", "hello-world"), ("über café", "uber-cafe"), ("Straße & Söhne", "strasse-and-sohne"), ("100% right", "100percent-right"), ("a/b\\c", "abc"), ("---", "page"), ("", "page"), ("Ærø Łódź", "aero-lodz"), ("my_file name.php", "myfile-name"),
])
_cases("cases_file_name", ["name"], T.file_name, [("a/b/photo.jpg?width=400", "photo.jpg"), ("we?ird:name*.png", "we-ird-name-.png"), ("..hidden", "hidden"), ("", "file"), ("x#y", "x"), ("a  b", "a-b")])
_cases("cases_date", ["date"], T.front_date, [
    ("2024-06-15T10:00:00Z", "2024-06-15"), ("Sat, 15 Jun 2024 10:00:00 GMT", "2024-06-15"), ("June 5, 2024", "2024-06-05"), ("Jun 5, 2024", "2024-06-05"), ("15 June 2024", "2024-06-15"), ("2024/06/15", "2024-06-15"), ("soon", "1970-01-01"), (None, "1970-01-01"), ("", "1970-01-01"),
])
_cases("cases_load_more", ["label"], S.is_load_more, [("Load  More", True), ("show\nmore", True), ("More posts!", True), ("Read on", False), ("see more", True)])
_cases("cases_social", ["url"], S.social_platform, [("https://www.instagram.com/x", "instagram"), ("https://x.com/y", "twitter"), ("https://youtu.be/z", "youtube"), ("https://sub.github.com/", None), ("https://a.b/", None)])
_cases("cases_file_part", ["url"], U.file_part, [("https://a.b/x/My%20File.pdf?y", "My File.pdf"), ("https://a.b/", "download"), ("https://a.b/100%.pdf", "100%.pdf")])
_cases("cases_extra_seeds", ["seed"], lambda s: F.array_join(D.extra_seeds(s), " "), [("https://a.b/x", "https://a.b/about https://a.b/contact")])
_cases("cases_feed_addresses", ["seed"], lambda s: F.array_join(D.feed_addresses(s), " "), [("https://a.b/x?y", "https://a.b/feed https://a.b/feed/atom https://a.b/rss.xml")])
_cases("cases_collect_internal", ["a", "b", "c", "seed"], lambda a, b, c, s: F.array_join(U.collect_internal(F.array(a, b, c), s), " "), [
    ("/p/", "https://a.b/p", "/s.css", "https://a.b/", "https://a.b/p"), ("//o.c/x", "q?utm_term=1", "mailto:x", "https://a.b/d/e", "https://a.b/d/q"), (None, "", "#x", "https://a.b/", "https://a.b/"),
])
_cases("cases_current_source", ["html", "src", "now"], lambda h, s, n: S.with_current_sources(h, F.array(F.struct(s.alias("src"), n.alias("current_src")))), [
    ("<img src=\"a\"><img src='a'>", "a", "b", "<img src=\"b\"><img src='b'>"), ('<img src="a">', "a", "data:x", '<img src="a">'), ('<img src="a">', "a", None, '<img src="a">'),
])
_cases("cases_resource_images", ["html", "url"], lambda h, u: S.with_resource_images(h, F.array(u)), [
    ("<body>x</body></body>", "https://static.wixstatic.com/m.png", '<body>x<img src="https://static.wixstatic.com/m.png" alt="" data-hydrate-resource="true" /></body></body>'), ("<body>x</body>", "https://a.b/m.png", "<body>x</body>"),
    ("<p>x", "https://x.wp.com/m.png", "<p>x"), ("https://x.wp.com/m.png</BODY>", "https://x.wp.com/m.png", "https://x.wp.com/m.png</BODY>"),
])
_cases("cases_recommendations", ["platform", "broken", "nav", "flagged"], lambda p, b, n, f: F.array_join(F.transform(S.recommendations(b.cast("int"), n.cast("int"), p, f.cast("int")), lambda x: F.substring(x, 1, 12)), "|"), [
    ("wix", "0", "3", "0", "Import with "), ("generic", "1", "0", "2", "Review broke|Navigation c|Platform det|Import with |2 images wer"),
])
_cases("cases_missing_metadata", ["title", "description", "icon", "nav"], lambda t, d, i, n: F.array_join(K.missing_metadata(t, d, i, n.cast("int")), " "), [("t", "d", "i", "1", ""), (None, "", "i", "0", "siteTitle description navigation"), ("t", "d", None, None, "favicon navigation")])
_cases("cases_extension", ["content", "type"], lambda c, t: T.extension(c.cast("binary"), t), [("GIF89a", None, "gif"), ("x", "image/png", "png"), ("abc", "", "bin"), ("<svg xmlns", "text/plain", "svg"), ("RIFF1234WEBPxx", None, "webp"), ("abcd", "image/svg+xml; q", "svg")])
_cases("cases_folder", ["kind", "blog"], lambda k, b: P.folder(k, b == "1"), [("page", "1", "blog"), ("gallery", "0", "portfolio"), ("page", "0", "pages"), ("portfolio", "0", "portfolio")])


# Pages and their extraction

_PAGE = """<!doctype html><html lang="de"><head><title>Haus | Seite</title><meta property="og:site_name" content=" Mein Haus "><meta name="description" content="Alles"><meta property="og:image" content="/og.png">
<link rel="icon" href="f.ico"><meta property="og:type" content="Article"><meta property="article:section" content="Bau"><meta property="article:tag" content="a"><meta name="twitter:card" content="summary"><meta name="author" content="Ann"></head>
<body><nav><a href="/eins">Eins</a><a href="zwei/">Zwei</a><a href="https://o.c/x">Fort</a><a href="/eins">Eins</a></nav><a href="https://www.instagram.com/q">i</a><main><h1>Titel</h1><p>Ein langer Text, der mehr als vierzig Zeichen hat.</p>
<a class="category" href="/c">Bau</a><a class="tag" href="/t">b</a><img src="../b.jpg?w=5" alt=" Bild " width="900"><img data-src="/c.png"><img src="data:x"><div style="background: url('/d.webp')"></div><div style="background:url(/e.html)"></div>
<a href="/f.pdf?x=1">Datei  hier</a><a href="//o.c/y">o</a><iframe src="https://www.youtube.com/embed/1" title="V"></iframe><iframe src="/karte"></iframe><video src="v.mp4"></video>
<div class="gallery"><img src="/1.png"><img src="/2.png"><img src="/1.png"><img data-lazy-src="/3.png"></div><table><tr><th>A<th align="right">B</tr><tr><td>1<td>2</table><ul><li><input type="checkbox" checked>ja<li>nein</ul></main></body></html>"""
_URL, _SEED = "https://a.b/x/y/", "https://a.b/"


def _page(spark: SparkSession) -> DataFrame:
    table = spark.createDataFrame([(_PAGE, _URL, _SEED)], "html string, url string, seed_url string")
    return S.resolved(P.extract(table))


def _one_row(name: str, columns: Callable[[], dict[str, Column]], expected: dict[str, str]) -> None:
    QUERIES[name] = lambda spark, sf_dir: _page(spark).select(*[c.cast("string").alias(k) for k, c in columns().items()])
    SQL[name] = "SELECT " + ", ".join(f"{_literal(v)}::VARCHAR AS {k}" for k, v in expected.items())


_joined = lambda c, *keys: F.array_join(F.transform(c, lambda x: F.concat_ws("~", *[F.coalesce(x[k].cast("string"), F.lit("-")) for k in keys])), " ")
_one_row("page_images", lambda: {"images": _joined("images", "src", "alt", "width"), "hero": F.col("hero_image"), "galleries": F.array_join(F.flatten("galleries"), " "), "n_galleries": F.size("galleries")}, {
    "images": "https://a.b/x/b.jpg~Bild~900.0 https://a.b/c.png~-~- https://a.b/1.png~-~- https://a.b/2.png~-~- https://a.b/3.png~-~- https://a.b/d.webp~-~-", "hero": "https://a.b/og.png", "galleries": "https://a.b/1.png https://a.b/2.png https://a.b/3.png", "n_galleries": "1",
})
_one_row("page_links", lambda: {"links": _joined("links", "href", "text", "internal"), "files": _joined("files", "href", "text", "filename"), "videos": _joined("videos", "src", "provider", "title"), "nav": _joined("nav", "title", "url")}, {
    "links": "https://a.b/c~Bau~true https://a.b/t~b~true https://a.b/f.pdf?x=1~Datei hier~true https://o.c/y~o~false", "files": "https://a.b/f.pdf?x=1~Datei hier~f.pdf",
    "videos": "https://a.b/x/y/v.mp4~html5~- https://www.youtube.com/embed/1~youtube~V", "nav": "Eins~/eins Zwei~/x/y/zwei/",
})
_one_row("page_metadata", lambda: {k: F.col(f"metadata.{k}") for k in ("site_title", "description", "canonical_url", "favicon", "logo", "language", "og_image", "og_type", "twitter_card")} | {"social": _joined("metadata.social_links", "platform", "url")}, {
    "site_title": "Mein Haus", "description": "Alles", "canonical_url": _URL, "favicon": "https://a.b/x/y/f.ico", "logo": "https://a.b/og.png", "language": "de", "og_image": "https://a.b/og.png", "og_type": "Article", "twitter_card": "summary", "social": "instagram~https://www.instagram.com/q",
})
_one_row("post_metadata", lambda: {"is_blog": F.col("blog_marks"), "author": F.col("author"), "categories": F.array_join("categories", " "), "tags": F.array_join("tags", " "), "page_slug": F.col("page_slug"), "post_slug": F.col("post_slug"), "headings": F.array_join("headings", " "), "title": F.col("title")}, {
    "is_blog": "true", "author": "Ann", "categories": "Bau", "tags": "a b", "page_slug": "xy", "post_slug": "y", "headings": "Titel", "title": "Titel",
})
