"""Operators over captured pages: extraction, platform scores, slugs, review, import decisions, validation, report, crawl."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.functions import urls as U
from webloom.functions.html import Node, any_match, parse
from webloom.session import written

# Chrome to remove, candidates for the main part, containers of menus, hosts of social networks, marks of blog posts.
CHROME = ", ".join(
    [
        "script", "style", "noscript", "iframe[src*='googletagmanager']", "iframe[src*='facebook.com/plugins']", "iframe[src*='doubleclick']", "[aria-hidden='true']",
        ".cookie-banner", ".cookie-consent", "#cookie-banner", "#cookieConsent", "[class*='cookie']", "[id*='cookie']", "[class*='Cookie']", ".popup", ".modal",
        "[class*='popup']", "[class*='modal']", "[role='dialog']", "nav", "header", "footer", "[role='navigation']", "[role='banner']", "[role='contentinfo']",
        ".wix-ads", "#SITE_HEADER", "#SITE_FOOTER", "#WIX_ADS", ".sqs-announcement-bar", ".Header", ".Footer",
    ]
)
MAIN = [
    "main", "article", "[role='main']", "#content", ".content", "#main", ".main", "#SITE_PAGES", ".SITE_PAGES", "[data-testid='page']", ".wixui-rich-text",
    ".blog-post", ".blog-post-content", ".post-content", ".entry-content", ".sqs-layout", ".w-richtext",
]
PLATFORM_CHROME = {
    "wix": "[data-testid='TINY_MENU'], [id*='comp-'][class*='hidden'], wix-iframe, #SCROLL_TO_TOP, #SCROLL_TO_BOTTOM, [data-hook='cookie-consent-banner']",
}
PLATFORM_MAIN = {
    "wix": ["#SITE_PAGES", "#PAGES_CONTAINER", "[data-testid='page']", "main", "[role='main']", "#site-root"],
    "wordpress": ["article .entry-content", ".entry-content", "article.post", "article", ".post-content", ".hentry"],
}
INFO_PAGE = r"(?i)^/(about|contact|bio|cv|press|privacy|legal)/?$"
PLAIN_PAGE = r"(?i)^/(about|contact|manifesto|privacy|legal)/?$"
MENUS = ["nav", "[role='navigation']", "header nav", "#SITE_HEADER nav", ".Header-nav", ".navbar", ".menu"]
SOCIAL = {
    "facebook.com": "facebook", "fb.com": "facebook", "instagram.com": "instagram", "twitter.com": "twitter", "x.com": "twitter", "linkedin.com": "linkedin",
    "youtube.com": "youtube", "youtu.be": "youtube", "tiktok.com": "tiktok", "pinterest.com": "pinterest", "github.com": "github", "vimeo.com": "vimeo",
}
BLOG_URL = r"(?i)/(blog|post|posts|news|article|articles|journal|stories)(?![A-Za-z0-9_])"
WIX_HINTS = ["wix.com", "static.wixstatic.com", "parastorage.com", "wix-code", "x-wix-", "data-mesh-id", "wixstatic", "_wix_browser_sess", "thunderbolt"]
GENERATOR = r"""(?i)<meta[^>]+name=["']generator["'][^>]+"""
#: Ties go to the earlier; generic does not compete.
PLATFORMS = ["wix", "webflow", "squarespace", "wordpress"]
LEAST_SCORE = 0.35


def _squeezed(text: str) -> str:
    return re.sub(r"[\s﻿]+", " ", text).strip()


EXTRACTED = (
    "title string, description string, headings array<string>, text_content string, html_content string, language string, canonical string, blog_marks boolean, published string, author string,"
    " images array<struct<src:string,alt:string,width:double,height:double,background:boolean>>, links array<struct<href:string,text:string>>, nav array<struct<title:string,href:string>>,"
    " videos array<struct<src:string,title:string,frame:boolean>>, galleries array<array<string>>, markdown string,"
    " og_image string, categories array<string>, tags array<string>, anchors array<string>, meta map<string,string>"
)
# Containers of galleries in the order in which they are looked for, file links, names of a page's own metadata.
GALLERIES = ["[class*='gallery']", "[class*='Gallery']", "[data-testid*='gallery']", ".pro-gallery", ".wixui-gallery", ".sqs-gallery", ".w-slider", "ul.gallery"]
FILES = r"(?i)\.(pdf|zip|docx?|xlsx?|pptx?|csv|txt|mp3|mp4|webm)(?:$|\?)"
OPEN_GRAPH = ["title", "description", "image", "type", "url"]
TWITTER = ["card", "title", "description", "image", "site"]


def _meta(page: Node, *names: str) -> str | None:
    for name in names:
        for key in ("property", "name"):
            node = page.first(f"meta[{key}='{name}']")
            if node is not None and (node.get("content") or "").strip():
                return node.get("content").strip()
    return None


def _number(value: str | None) -> float | None:
    try:
        return float(value.strip()) or None if value else None
    except ValueError:
        return None


def _title(page: Node) -> str:
    heading, title = page.first("h1"), page.first("title")
    whole = _squeezed(title.text()) if title else ""
    cut = re.split(r"\s*[|\-–—]\s*", whole, maxsplit=1)[0].strip()
    return _meta(page, "og:title") or (_squeezed(heading.text()) if heading else "") or cut or whole or "Untitled"


def _main(page: Node, platform: str = "generic") -> Node:
    for selector in PLATFORM_MAIN.get(platform, []):
        node = page.first(selector)
        if node is not None and (len(node.text().strip()) > 40 or (platform == "wix" and len(node.select("img")) >= 3)):
            return node
    for selector in MAIN:
        node = page.first(selector)
        if node is not None and len(node.text().strip()) > 40:
            return node
    body = page.children[1]
    best, size = body, 80
    lengths = _text_lengths(body)
    for node in body.walk():
        if lengths[id(node)] > size:
            best, size = node, lengths[id(node)]
    return best


def _text_lengths(top: Node) -> dict[int, int]:
    """The length of each element's squeezed text, by id, in one pass from the leaves up.

    A text is summed up as (length, whether it starts with white space, whether it ends with some, whether it has more than that).
    """
    white = re.compile(r"[\s\ufeff]")
    parts: dict[int, tuple[int, bool, bool]] = {}
    for node in [*reversed([top, *top.walk()])]:
        n, starts, ends = 0, False, False
        for c in node.children:
            if isinstance(c, str):
                if not c:
                    continue
                text = _squeezed(c)
                m, s, e = len(text), bool(white.match(c)), bool(white.match(c[-1]))
            else:
                m, s, e = parts[id(c)]
            if not m:  # white space at most
                if s:
                    starts, ends = (True, True) if not n else (starts, True)
                continue
            starts, n = (starts or s, m) if not n else (starts, n + m + (ends or s))
            ends = e
        parts[id(node)] = n, starts, ends
    return {k: v[0] for k, v in parts.items()}


def _source(node: Node) -> str | None:
    for key in ("src", "data-src", "data-lazy-src", "data-original"):
        if node.get(key):
            return None if node.get(key).startswith("data:") else node.get(key)
    return None


def markdown(node: Node) -> str:
    """ATX headings, - bullets, * emphasis, fenced code, quotes, rules, links, images, tables and task lists. Each element is rendered once, from
    the leaves up, so that depth costs nothing."""
    done: dict[int, str] = {}

    def inline(n: Node) -> str:
        return "".join(done[id(c)] if not isinstance(c, str) else re.sub(r"\s+", " ", re.sub(r"([\\*_\[\]`])", r"\\\1", c)) for c in n.children)

    def piece(c: Node) -> str:
        if c.tag in ("b", "strong", "em", "i", "del", "s", "strike"):
            inner, mark = inline(c), {"b": "**", "strong": "**", "em": "*", "i": "*"}.get(c.tag, "~~")
            return f"{mark}{inner.strip()}{mark}" if inner.strip() else inner
        if c.tag == "a":
            inner, href = inline(c), (c.get("href") or "").strip()
            return f"[{inner.strip()}]({href})" if href and not href.lower().startswith("javascript:") else inner
        if c.tag == "img":
            src = _source(c)
            return f"![{c.get('alt') or ''}]({src})" if src else ""
        if c.tag == "br":
            return "  \n"
        if c.tag == "code":
            return f"`{c.text()}`"
        if c.tag == "input" and (c.get("type") or "").lower() == "checkbox" and c.parent is not None and c.parent.tag == "li":
            return "[x] " if "checked" in c.attrs else "[ ] "
        if c.tag in _BLOCK:
            return "\n\n" + block(c) + "\n\n"
        return inline(c)

    def rows_of(n: Node) -> list[Node]:
        below = [c for c in n.children if not isinstance(c, str)]
        return [r for c in below for r in ([c] if c.tag == "tr" else [x for x in c.children if not isinstance(x, str) and x.tag == "tr"] if c.tag in ("thead", "tbody", "tfoot") else [])]

    def block(n: Node) -> str:
        if n.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            return "#" * int(n.tag[1]) + " " + inline(n).strip()
        if n.tag in ("ul", "ol"):
            items = [c for c in n.children if not isinstance(c, str) and c.tag == "li"]
            first = int(n.get("start")) if (n.get("start") or "").isdigit() else 1
            return "\n".join((f"{i}. " if n.tag == "ol" else "- ") + done[id(c)].strip().replace("\n", "\n  ") for i, c in enumerate(items, first))
        if n.tag == "pre":
            return "```\n" + n.text().rstrip("\n") + "\n```"
        if n.tag == "blockquote":
            return "\n".join("> " + x for x in re.sub(r"\n{3,}", "\n\n", inline(n)).strip().split("\n"))
        if n.tag == "hr":
            return "---"
        if n.tag == "figure":
            img, caption = n.first("img"), n.first("figcaption")
            if img is not None and _source(img):
                return f"![{_squeezed(caption.text()) if caption else img.get('alt') or ''}]({_source(img)})"
        if n.tag == "table":
            rows = [[c for c in r.children if not isinstance(c, str) and c.tag in ("td", "th")] for r in rows_of(n)]
            if rows and rows[0] and all(c.tag == "th" for c in rows[0]):  # a table without a heading row has no Markdown form
                cells = [[re.sub(r"\s+", " ", done[id(c)]).strip().replace("|", "\\|") for c in r] for r in rows]
                rule = [{"left": ":--", "right": "--:", "center": ":-:"}.get((c.get("align") or "").lower(), "---") for c in rows[0]]
                return "\n".join("| " + " | ".join(r) + " |" for r in [cells[0], rule, *cells[1:]])
        return inline(n)

    for x in reversed(list(node.walk())):
        done[id(x)] = piece(x)
    lines = "\n".join(x.strip() if not x.startswith("  ") else x.rstrip() for x in block(node).split("\n"))
    return re.sub(r"\n{3,}", "\n\n", lines).strip() + "\n"


_BLOCK = frozenset("p div section article main h1 h2 h3 h4 h5 h6 ul ol pre blockquote hr figure table tr header footer aside body".split())


def _attr(page: Node, selector: str, name: str) -> str | None:
    """The attribute of the first element that the selector finds, None where it is absent or empty."""
    node = page.first(selector)
    return (node.get(name) or None) if node is not None else None


def site_metadata(page: Node) -> dict[str, str]:
    """What a page says of its site: titles, addresses as they stand, Open Graph and Twitter cards; only what is there."""
    title = page.first("title")
    got = {
        "site_title": (_attr(page, "meta[property='og:site_name']", "content") or "").strip() or (title.text().strip() if title else ""),
        "description": _meta(page, "og:description") or (_attr(page, "meta[name='description']", "content") or "").strip(),
        "canonical": _attr(page, "link[rel='canonical']", "href") or _attr(page, "meta[property='og:url']", "content"),
        "favicon": _attr(page, "link[rel='icon']", "href") or _attr(page, "link[rel='shortcut icon']", "href") or _attr(page, "link[rel='apple-touch-icon']", "href"),
        "logo": _attr(page, "meta[property='og:image']", "content") or _attr(page, "img[alt*='logo' i]", "src") or _attr(page, "img[class*='logo' i]", "src"),
    }
    got |= {f"og_{k}": _attr(page, f"meta[property='og:{k}']", "content") for k in OPEN_GRAPH}
    got |= {f"twitter_{k}": _attr(page, f"meta[name='twitter:{k}']", "content") for k in TWITTER}
    return {k: v for k, v in got.items() if v}


def _terms(page: Node, meta: str, selector: str) -> list[str]:
    """Texts of a post's categories or tags: all of the metadata, then the new ones of the markup."""
    out = [v for n in page.select(f"meta[property='{meta}']") if (v := (n.get("content") or "").strip())]
    for n in page.select(selector):
        if (v := n.text().strip()) and v not in out:
            out.append(v)
    return out


def _first_of_each(rows: list[tuple]) -> list[tuple]:
    """The rows whose first value no earlier row has."""
    out: dict = {}
    for x in rows:
        out.setdefault(x[0], x)
    return list(out.values())


def _gallery_images(g: Node) -> list[str]:
    found = (i.get("src") or i.get("data-src") or i.get("data-lazy-src") for i in g.select("img"))
    return list(dict.fromkeys(s for s in found if s and not s.startswith("data:")))


def extract_page(html: str | None, platform: str | None = "generic", parts_wanted: frozenset[str] | None = None, closed: bool = False) -> tuple:
    """One page's row of EXTRACTED; addresses are as they stand in the page (site.resolved makes them absolute). The platform decides where the main
    part is looked for; on wix, images and galleries outside it follow those within. parts_wanted: names whose values are needed, all if None.
    closed: texts keep character references that no semicolon closes.

    Scripts are gone before posts are told from pages, so a post that only its JSON-LD names is no post."""
    want = lambda *names: parts_wanted is None or not parts_wanted.isdisjoint(names)
    page, platform = parse(html, closed), platform or "generic"
    title, description = _title(page), _meta(page, "og:description", "description")
    nav_links: list[Node] = next((found for s in MENUS if (found := [a for n in page.select(s) for a in n.select("a[href]")])), []) or page.select("header a[href], #SITE_HEADER a[href]") if want("nav") else []
    nav = list(dict.fromkeys((_squeezed(a.text()), a.get("href")) for a in nav_links))
    nav = [x for x in nav if x[0] and x[1] and len(x[0]) <= 80]
    if not nav and platform == "wix" and want("nav"):  # its own marks, whatever the titles' lengths
        nav = list(dict.fromkeys((t, a.get("href")) for a in page.select("#SITE_HEADER a[href], [data-testid='linkElement']") if a.get("href") and (t := _squeezed(a.text()))))
    canonical = _attr(page, "link[rel='canonical']", "href")
    anchors = list(dict.fromkeys(a.get("href") for a in page.select("a[href]") if a.get("href"))) if want("anchors") else []
    meta = site_metadata(page) if want("meta") else {}
    og_image = _attr(page, "meta[property='og:image']", "content")
    language = page.get("lang") or None
    if not want("headings", "text_content", "html_content", "blog_marks", "published", "author", "images", "links", "videos", "galleries", "markdown", "categories", "tags"):
        return (title, description, [], "", "", language, canonical, False, None, None, [], [], nav, [], [], "", og_image, [], [], anchors, meta)
    for node in page.select(", ".join(filter(None, [CHROME, PLATFORM_CHROME.get(platform)]))):
        node.remove()
    blog = (_attr(page, "meta[property='og:type']", "content") or "").lower() == "article" or page.first("meta[property='article:published_time']") is not None
    blog = blog or page.first("article.blog-post, .blog-post, .post-content, .entry-content, [data-testid='post-content'], .blog-post-page, article.post") is not None
    text = lambda selector: node.text().strip() if (node := page.first(selector)) is not None else None
    published = _attr(page, "meta[property='article:published_time']", "content") or _attr(page, "meta[name='publish-date']", "content") or _attr(page, "time[datetime]", "datetime") or text("time")
    author = _attr(page, "meta[property='article:author']", "content") or _attr(page, "meta[name='author']", "content") or text("[rel='author']") or text(".author")
    categories = _terms(page, "article:section", ".category, .categories a, [rel='category']")
    tags = _terms(page, "article:tag", ".tags a, .tag, [rel='tag']")
    main = _main(page, platform)
    parts = [main, page] if platform == "wix" else [main]
    within = lambda selector: [n for part in parts for n in ([part] if any_match(part, selector) else []) + part.select(selector)]
    images = []
    for img in [i for part in parts for i in part.select("img")]:
        src = _source(img) or (img.get("data-pin-media") if platform == "wix" else None)
        if src:
            images.append((src, (img.get("alt") or "").strip() or None, _number(img.get("width")), _number(img.get("height")), False))
    for node in within("[style*='background']"):
        hit = re.search(r"""(?i)url\(["']?([^"')]+)["']?\)""", node.get("style") or "")
        if hit and not hit[1].startswith("data:"):
            images.append((hit[1], None, None, None, True))
    images = _first_of_each(images)
    links = _first_of_each([(a.get("href"), _squeezed(a.text())) for a in main.select("a[href]") if a.get("href")])
    videos = [(v.get("src"), None, False) for v in main.select("video source, video") if v.get("src")] + [(v.get("src"), (v.get("title") or "").strip() or None, True) for v in main.select("iframe[src]") if v.get("src")]
    galleries = []
    for part in parts:
        for selector in GALLERIES:
            for g in ([part] if part is main and any_match(part, selector) else []) + part.select(selector):
                sources = _gallery_images(g)
                if len(sources) >= 3 and (part is main or all(sources[0] != x[0] for x in galleries)):
                    galleries.append(sources)
    headings = [h for n in main.select("h1, h2, h3, h4, h5, h6") if (h := _squeezed(n.text()))]
    return (
        title, description, headings, _squeezed(main.text()), main.outer() if want("html_content") else "", language, canonical, blog, (published or "")[:32] or None, (author or "").strip() or None, images, links, nav, videos, galleries,
        markdown(main) if want("markdown") else "", og_image, categories, tags, anchors, meta,
    )


@functools.cache
def _columns() -> list[tuple[str, str]]:
    return [tuple(x.strip().split(" ", 1)) for x in re.split(r",\s*(?=[a-z_]+ (?:string|array|boolean|map))", EXTRACTED)]


def extract(pages: DataFrame, html: str = "html", extractor: Callable = extract_page, platform: str | None = None, fields: list[str] | None = None, closed: bool = False) -> DataFrame:
    """pages with a column page, the struct EXTRACTED of each, or some fields of it; the page is parsed once. platform names a column such as detect
    adds; closed is extract_page's. The function counts as nondeterministic, so that no plan runs it a second time for a filter or an explode."""
    columns = [c for c in _columns() if fields is None or c[0] in fields]
    names, wanted = [c[0] for c in columns], None if fields is None else frozenset(fields)
    places = [i for i, c in enumerate(_columns()) if c[0] in names]

    def row(x: str | None, kind: str | None) -> list:
        got = extractor(x, kind, wanted, closed) if extractor is extract_page else extractor(x, kind)
        return [got[i] for i in places]

    @F.pandas_udf(f"struct<{', '.join(f'{n}:{t}' for n, t in columns)}>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for batch, kinds in batches:
            yield pd.DataFrame([row(x, k) for x, k in zip(batch, kinds, strict=True)], columns=names)

    return pages.withColumn("page", run.asNondeterministic()(html, platform or F.lit("generic")))


def with_kind(pages: DataFrame, platform: str = "platform", url: str = "url", page: str = "page") -> DataFrame:
    """extracted pages with is_blog, kind and galleries, by the rules of their platform. On wix, pages of images without a gallery
    become one of all their images, unless they tell about the owner."""
    p, at, x = F.col(platform), U.path(F.col(url)), F.col(page)
    marked = F.col(url).rlike(BLOG_URL) | F.coalesce(x["blog_marks"], F.lit(False))
    is_blog = F.when(p == "wordpress", ~at.rlike(PLAIN_PAGE) & (marked | F.col(url).rlike(r"/\d{4}/\d{2}/"))).otherwise(marked)
    heavy = (F.size(x["galleries"]) >= 1) | (F.size(x["images"]) >= 4) | x["text_content"].rlike(r"1\s*/\s*\d+")
    wix = F.when(at.rlike(INFO_PAGE), "page").when(heavy, "gallery").otherwise("page")
    generic = F.when((F.size(x["galleries"]) > 0) & (F.size(x["headings"]) == 0), "gallery").otherwise("page")
    out = pages.withColumn("is_blog", is_blog)
    out = out.withColumn("kind", F.when(F.col("is_blog"), "blog").when(p == "wix", wix).when(p == "wordpress", "page").otherwise(generic))
    made = (p == "wix") & (F.col("kind") == "gallery") & (F.size(x["galleries"]) == 0)
    return out.withColumn("galleries", F.when(made, F.array(F.transform(x["images"], lambda i: i["src"]))).otherwise(x["galleries"]))


def platform_scores(html: Column, url: Column) -> Column:
    """Scores in the order of PLATFORMS, as array of structs; sums run in a fixed order."""
    low = F.lower(html)
    when = lambda c, x: F.when(c, F.lit(float(x))).otherwise(F.lit(0.0))
    add = lambda xs: F.least(functools.reduce(operator.add, xs), F.lit(1.0))
    wix = [*(when(low.contains(h), 0.15) for h in WIX_HINTS), when(low.contains("static.wixstatic.com"), 0.25), when(html.rlike(GENERATOR + "wix"), 0.5), when(F.lower(url).contains(".wixsite.com"), 0.4)]
    word = [when(low.contains("wp-content"), 0.4), when(html.rlike(GENERATOR + "wordpress"), 0.5), when(low.contains("wordpress.com") | F.lower(url).contains("wordpress.com"), 0.35), when(low.rlike(r"\bwp-json\b|/wp-json/"), 0.2)]
    square = [when(low.contains("squarespace"), 0.3), when(low.contains("static.squarespace.com"), 0.35), when(low.contains("sqs-"), 0.2), when(html.rlike(GENERATOR + "squarespace"), 0.5)]
    flow = [when(low.contains("webflow"), 0.3), when(low.contains("data-wf-"), 0.35), when(low.contains("cdn.prod.website-files.com"), 0.25), when(html.rlike(GENERATOR + "webflow"), 0.5)]
    by = {"wix": wix, "webflow": flow, "squarespace": square, "wordpress": word}
    return F.array(*[F.struct(add(by[p]).alias("score"), F.lit(-i).alias("order"), F.lit(p).alias("id")) for i, p in enumerate(PLATFORMS)])


def detect(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    best = pages.withColumn("best", F.array_max(platform_scores(F.col(html), F.col(url))))
    return best.withColumn("platform", F.when(F.col("best.score") >= LEAST_SCORE, F.col("best.id")).otherwise("generic")).withColumn("confidence", F.col("best.score")).drop("best")


def number_slugs(df: DataFrame, slug: str, *order: str, site: str = "site", out: str = "slug") -> DataFrame:
    """base, base-2, base-3 ... in order within a site, past names taken before. Names that share all but their final numbers make a
    family; only families with such numbers of their own depend on the order of different names and are folded, one by one."""
    family = df.withColumn("__f", F.regexp_replace(slug, r"(-\d+)+$", ""))
    mixed = family.groupBy(F.col(site).alias("__s"), F.col("__f").alias("__g")).agg(F.min(slug).alias("__x"), F.max(slug).alias("__y")).where("__x <> __y").select("__s", "__g")
    hit = (F.col(site) == F.col("__s")) & (F.col("__f") == F.col("__g"))
    rank = F.row_number().over(Window.partitionBy(site, slug).orderBy(*order))
    name = F.when(rank == 1, F.col(slug)).otherwise(F.concat(F.col(slug), F.lit("-"), rank.cast("string")))
    plain = family.join(mixed, hit, "left_anti").drop("__f").withColumn(out, name)

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group, used, names = group.sort_values(list(order)), set(), []
        for base in group[slug]:
            given, k = base, 1
            while given in used:
                k += 1
                given = f"{base}-{k}"
            used.add(given)
            names.append(given)
        return group.assign(**{out: names}).drop(columns="__f")

    folded = family.join(mixed, hit, "left_semi").groupBy(site, "__f").applyInPandas(fold, plain.schema)
    return plain.unionByName(folded)


def folder(kind: Column, is_blog: Column, skip_blog: bool = False) -> Column:
    blog = F.lit(False) if skip_blog else is_blog
    return F.when(blog, "blog").when(kind.isin("portfolio", "gallery"), "portfolio").otherwise("pages")


def review_flags(url: Column, seed: Column, alt: Column, title: Column, is_blog: Column, is_hero: Column, kind: Column) -> Column:
    hay = F.lower(F.concat_ws(" ", F.coalesce(alt, F.lit("")), url))
    post = is_blog & (kind != "gallery")
    named = F.exists(T.title_names(title), lambda w: hay.contains(F.lower(w)))
    flags = F.array(F.when(U.is_skippable(url), "chrome"), F.when(U.is_other_host(url, seed), "other-host"), F.when(post & named, "title-name-in-media"), F.when(post & ~is_hero, "inline-blog"))
    return F.filter(flags, lambda x: x.isNotNull())


def skipped_on_import(flags: Column, include_flagged: bool = False, keep_inline: bool = False) -> Column:
    if include_flagged:
        return F.lit(False)
    bad = F.arrays_overlap(flags, F.array(F.lit("chrome"), F.lit("other-host"), F.lit("title-name-in-media")))
    return bad if keep_inline else bad | F.array_contains(flags, "inline-blog")


def import_action(collection: Column, exists: Column, refs: Column, missing: Column, overwrite_pages: bool = False, overwrite_entries: bool = False) -> Column:
    """What becomes of an entry: refs, the references to its images; missing, those whose file is absent."""
    page, entry = (collection == "pages") & exists & F.lit(not overwrite_pages), (collection != "pages") & exists & F.lit(not overwrite_entries)
    return F.when(page, "skippedProtected").when(entry & (refs > 0) & (missing == 0), "skippedExisting").when(entry, "filledImages").otherwise("added")


def validate(files: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """Issues of Markdown files (pack, file, ord, title, description, slug, date, and refs: the image references): pack, file, ord, level, message.

    Within a pack, names and slugs must be used once; a file whose title or slug is null or empty breaks the schema and is not looked at further.
    present (pack, path): the pack's other files; references are looked for in the pack, beside the file and in the images folder.
    """
    name = F.regexp_extract("file", "([^/]*)$", 1)
    none = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rows = files.withColumn("name", name).withColumn("valid", ~none("title") & ~none("slug"))
    slugged = F.when(F.col("valid") & (F.trim("slug") != ""), F.col("slug"))
    # The first of a name or slug comes from an aggregate, which is combined before the shuffle: index.md may be on every pack of a table.
    first = lambda key, out: rows.withColumn("key", key).where("key is not null").groupBy("pack", "key").agg(F.min(F.struct("ord", "file")).alias(out))
    named = rows.join(first(F.col("name"), "by_name").withColumnRenamed("key", "name"), ["pack", "name"]).withColumn("key", slugged).join(first(slugged, "by_slug"), ["pack", "key"], "left")
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    dated = F.col("file").rlike("^(blog|portfolio)/")
    valid = F.col("valid")
    wrong = lambda c: F.when(F.col(c).isNull(), say(f"Invalid frontmatter: {c} — Required")).when(F.col(c) == "", say(f"Invalid frontmatter: {c} — String must contain at least 1 character(s)"))
    error = lambda condition, message: F.when(condition, F.struct(F.lit("error").alias("level"), message.alias("message")))
    issues = F.array(
        error(F.col("by_name.ord") < F.col("ord"), say('Duplicate filename "', F.col("name"), '" also used by ', F.col("by_name.file"))),
        error(none("title"), wrong("title")),
        error(none("slug"), wrong("slug")),
        error(valid & (F.trim("title") == ""), say("Missing title")),
        error(valid & (F.trim(F.coalesce("description", F.lit(""))) == ""), say("Missing description")),
        error(valid & (F.trim("slug") == ""), say("Missing slug")),
        error(valid & (F.col("by_slug.ord") < F.col("ord")), say('Duplicate slug "', F.col("slug"), '" also used by ', F.col("by_slug.file"))),
        error(valid & dated & (F.coalesce(F.nullif("date", F.lit("")), F.lit(T.NO_DATE)) == T.NO_DATE), say("Missing real date (1970-01-01 means article date was not found)")),
    )
    found = named.select("pack", "file", "ord", F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("i")).select("pack", "file", "ord", "i.level", "i.message")
    if "refs" not in files.columns:
        return found
    refs = rows.where("valid").select("pack", "file", "ord", F.posexplode("refs").alias("nth", "ref"))
    remote = refs.where(F.col("ref").rlike("(?i)^https?://")).select("pack", "file", "ord", F.lit("warning").alias("level"), say("Remote image reference remains: ", F.col("ref")).alias("message"))
    if present is None:
        return found.unionByName(remote)
    plain, beside = F.regexp_replace("ref", "^/", ""), F.regexp_extract("file", "^(.*/)?[^/]*$", 1)
    places = F.array_distinct(F.transform(F.array(plain, F.col("ref"), F.concat(beside, F.col("ref")), F.concat(F.lit("images/"), F.regexp_extract("ref", "([^/]*)$", 1))), lambda x: F.regexp_replace(x, r"^(\./|/)+", "")))
    local = refs.where(~F.col("ref").rlike("(?i)^https?://"))
    there = present.select("pack", "path").distinct().withColumn("there", F.lit(True))
    held = local.withColumn("path", F.explode(places)).join(there, ["pack", "path"], "left").groupBy("pack", "file", "ord", "nth", "ref").agg(F.max("there").alias("there"))
    gone = held.where("there is null").select("pack", "file", "ord", F.lit("error").alias("level"), say("Missing image file for reference: ", F.col("ref")).alias("message"))
    return found.unionByName(remote).unionByName(gone)


def is_valid(issues: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack, ok): packs (pack) without errors; warnings do not count."""
    bad = issues.where("level = 'error'").groupBy("pack").agg(F.count(F.lit(1)).alias("errors"))
    return packs.select("pack").distinct().join(bad, "pack", "left").select("pack", F.col("errors").isNull().alias("ok"))


def crawl(seeds: DataFrame, links: DataFrame, depth: int = 10) -> DataFrame:
    """(url, depth): the least depth at which each url is reached. seeds: url; links: src, dst. Levels are joined set by set, each written."""
    seen = written(seeds.select("url").distinct().withColumn("depth", F.lit(0)), "seeds")
    frontier = seen
    for k in range(1, depth + 1):
        reached = links.join(frontier.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct()
        frontier = written(reached.join(seen, "url", "left_anti").withColumn("depth", F.lit(k)), f"level{k}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen
