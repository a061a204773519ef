"""From captured pages to a site's pack: addresses resolved, the platform, navigation, metadata, image lists, counts, report and files.

The tables hold many sites (seed_url); pages come in the order of ord, as the manifest numbers them. What one run does for its site is a plan over
all of them here: equi-joins by site, windows over one site's pages, aggregates.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.functions import urls as U
from webloom.functions import weburl as W
from webloom.operators import packs as K
from webloom.operators import pages as P
from webloom.session import written

# Marks of heroes, providers of videos, the labels of buttons that load more, hosts of images that a browser loads by itself.
HERO = r"(?i)hero|banner|cover|featured"
PROVIDERS = {"youtube": "youtube", "youtu.be": "youtube", "vimeo": "vimeo", "wistia": "wistia"}
LOAD_MORE = "(?i)load more|show more|more posts|see more"
MEDIA_HOSTS = r"(?i)wixstatic|wp\.com|wp-content|wordpress\.com"
PLATFORM_NAMES = {"generic": "Generic HTML", "wix": "Wix", "webflow": "Webflow", "squarespace": "Squarespace", "wordpress": "WordPress"}
NO_NAVIGATION = "Navigation could not be detected automatically — edit navigation.json manually."
GENERIC = "Platform detected as generic. Consider adding a dedicated extractor plugin for cleaner results."
BROKEN = "Review broken images and replace or remove references."
FLAGGED = " images were flagged (chrome, other-host, title-name-in-media, or inline-blog). Import skips them unless --include-flagged."

_STRINGS = "array<string>"


_META = ["site_title", "description", "canonical_url", "favicon", "logo", "language", *(f"og_{k}" for k in P.OPEN_GRAPH), *(f"twitter_{k}" for k in P.TWITTER)]
RESOLVED = {
    "images": "array<struct<src:string,alt:string,width:double,height:double>>", "links": "array<struct<href:string,text:string,internal:boolean>>", "nav": "array<struct<title:string,url:string>>",
    "videos": "array<struct<src:string,provider:string,title:string>>", "files": "array<struct<href:string,text:string,filename:string>>", "galleries": "array<array<string>>", "hero_image": "string",
    "metadata": f"struct<{','.join(f'{k}:string' for k in _META)},social_links:array<struct<platform:string,url:string>>>",
}


def _provider(url: str, frame: bool) -> str | None:
    return next((PROVIDERS[k] for k in PROVIDERS if k in url.lower()), None) if frame else "html5"


def _metadata(meta: dict[str, str], language: str | None, anchors: list[str], at: str) -> dict:
    address = lambda k: W.absolute(meta.get(k), at)
    out = {k: meta.get(k) for k in _META} | {"canonical_url": address("canonical") or at, "language": language} | {k: address(k) for k in ("favicon", "logo", "og_image")}
    social: dict[str, str] = {}
    for href in anchors:
        url = W.absolute(href, at)
        if url and (platform := W.social_platform(url, P.SOCIAL)):
            social.setdefault(platform, url)
    return out | {"social_links": [{"platform": p, "url": u} for p, u in social.items()]}


def resolve_page(at: str | None, seed: str | None, p: dict) -> dict:
    """RESOLVED for one page: p has the fields of pages.EXTRACTED."""
    at, seed = at or "", seed or ""
    images: dict[str, dict] = {}
    for i in p["images"]:
        src = W.image(i["src"], at)
        if src and (not i["background"] or W.is_image(src)):
            images.setdefault(src, {"src": src, "alt": i["alt"], "width": i["width"], "height": i["height"]})
    links: dict[str, dict] = {}
    files: dict[str, dict] = {}
    for a in p["links"]:
        if href := W.absolute(a["href"], at):
            text = a["text"] or None
            links.setdefault(href, {"href": href, "text": text, "internal": W.is_at(href, seed)})
            if re.search(P.FILES, a["href"]):
                files.setdefault(href, {"href": href, "text": text, "filename": W.file_part(href)})
    nav = dict.fromkeys((n["title"], W.path(u)) for n in p["nav"] if (u := W.absolute(n["href"], at)) and W.is_at(u, seed))
    videos: dict[str, dict] = {}
    for v in p["videos"]:
        if (src := W.absolute(v["src"], at)) and (provider := _provider(src, v["frame"])):
            videos.setdefault(src, {"src": src, "provider": provider, "title": v["title"]})
    galleries = [list(dict.fromkeys(u for s in g if (u := W.image(s, at)))) for g in p["galleries"]]
    marked = next((i["src"] for i in images.values() if (i["width"] or 0) >= 800 or re.search(HERO, i["src"]) or re.search(HERO, i["alt"] or "")), None)
    return {
        "images": list(images.values()), "links": list(links.values()), "nav": [{"title": t, "url": u} for t, u in nav], "videos": list(videos.values()), "files": list(files.values()),
        "galleries": [g for g in galleries if len(g) >= 3], "hero_image": (W.absolute(p["og_image"], at) if p["og_image"] else None) or marked or next(iter(images), None), "metadata": _metadata(dict(p["meta"]), p["language"], p["anchors"], at),
    }


def resolved(pages: DataFrame, url: str = "url", seed: str = "seed_url", page: str = "page") -> DataFrame:
    """pages with title, description, headings, text_content, markdown, language, images, links, nav, videos, files, galleries, hero_image, blog
    metadata, slugs and site metadata, with every address absolute; page is the struct that pages.extract adds, with all of its fields."""
    used = ["images", "links", "nav", "videos", "galleries", "og_image", "meta", "language", "anchors"]

    @F.pandas_udf(f"struct<{','.join(f'{k}:{v}' for k, v in RESOLVED.items())}>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        for at, home, p in batches:
            columns = {c: p[c].tolist() for c in used}
            rows = [{c: ([] if columns[c][k] is None and c in ("images", "links", "nav", "videos", "galleries", "anchors", "meta") else columns[c][k]) for c in used} for k in range(len(at))]
            yield pd.DataFrame([resolve_page(a, s, r) for a, s, r in zip(at, home, rows, strict=True)], columns=list(RESOLVED))

    x, at = F.col(page), F.col(url)
    plain = ["title", "description", "headings", "text_content", "html_content", "markdown", "language", "blog_marks", "categories", "tags", "author"]
    kept = [c for c in pages.columns if c not in {*RESOLVED, *plain, "date", "page_slug", "post_slug"}]
    some = pages.select(*kept, run.asNondeterministic()(at, F.col(seed), F.struct(*[x[c].alias(c) for c in used])).alias("__r"))
    last = F.regexp_extract(F.regexp_replace(at, "/$", ""), "([^/]*)$", 1)
    return some.select(
        *kept, *[x[c].alias(c) for c in plain], x["published"].alias("date"), *[F.col(f"__r.{c}").alias(c) for c in RESOLVED], T.slug(U.path_name(at)).alias("page_slug"), T.slug(F.coalesce(F.nullif(last, F.lit("")), x["title"])).alias("post_slug")
    )


def social_platform(url: Column) -> Column:
    host = F.regexp_replace(U.hostname(url), r"^www\.", "")
    return functools.reduce(lambda acc, h: acc.when(host == h, F.lit(P.SOCIAL[h])), P.SOCIAL, F.when(F.lit(False), F.lit("")))


# Before extraction


def with_current_sources(html: Column, images: Column) -> Column:
    """html with the sources that a browser showed (images: src, current_src) in place of those that were written; one after the other."""
    swap = lambda h, i, q: F.replace(h, F.concat(F.lit(f"src={q}"), F.trim(i["src"]), F.lit(q)), F.concat(F.lit(f"src={q}"), F.trim(i["current_src"]), F.lit(q)))
    live = lambda i: (F.coalesce(F.trim(i["current_src"]), F.lit("")) != "") & ~i["current_src"].startswith("data:") & (F.coalesce(F.trim(i["src"]), F.lit("")) != "") & (F.trim(i["src"]) != F.trim(i["current_src"]))
    return F.aggregate(images, html, lambda h, i: F.when(live(i), swap(swap(h, i, '"'), i, "'")).otherwise(h))


def with_resource_images(html: Column, urls: Column) -> Column:
    """html with images of platforms that a browser loaded but the markup lacks, before the end of its body."""
    new = F.filter(urls, lambda u: (F.coalesce(u, F.lit("")) != "") & ~u.startswith("data:") & u.rlike(MEDIA_HOSTS) & ~html.contains(u))
    tags = F.array_join(F.transform(new, lambda u: F.concat(F.lit('<img src="'), u, F.lit('" alt="" data-hydrate-resource="true" />'))), "")
    at = F.regexp_instr(html, F.lit("(?i)</body>"))
    return F.when((F.size(new) > 0) & (at > 0), F.concat(F.substring(html, F.lit(1), at - 1), tags, F.substring(html, at, F.length(html)))).otherwise(html)


def is_load_more(label: Column) -> Column:
    return T.squeeze(label).rlike(LOAD_MORE)


# A site


def site_platforms(captures: DataFrame, chosen: str = "auto") -> DataFrame:
    """(seed_url, platform, confidence): of the seed's page, or else of the first page with html; captures: seed_url, normalized_url, ord, html."""
    sites = captures.select("seed_url").distinct()
    if chosen != "auto":
        return sites.withColumns({"platform": F.lit(chosen), "confidence": F.lit(None).cast("double")})
    with_html = captures.where(F.coalesce(F.col("html"), F.lit("")) != "")
    order = F.struct((F.col("normalized_url") != F.col("seed_url")).alias("other"), "ord")
    best = with_html.groupBy("seed_url").agg(F.min(order).alias("b")).select("seed_url", F.col("b.ord").alias("ord"))
    found = P.detect(with_html.join(best, ["seed_url", "ord"]), url="normalized_url").select("seed_url", "platform", "confidence")
    return sites.join(found, "seed_url", "left").withColumn("platform", F.coalesce("platform", F.lit("generic")))


def site_pages(captures: DataFrame, platforms: DataFrame, skip_blog: bool = False) -> DataFrame:
    """Extracted pages of all sites: seed_url, site, ord, url, slug (unique within the site), kind, is_blog and what resolved adds."""
    rows = captures.where(F.coalesce(F.col("html"), F.lit("")) != "").join(platforms.select("seed_url", "platform"), "seed_url")
    kept = P.with_kind(P.extract(rows.withColumn("url", F.col("normalized_url")), platform="platform")).drop("html")
    made = kept.select("seed_url", "ord", "url", "platform", "is_blog", "kind", F.col("galleries").alias("__galleries"), "page").withColumn("page", F.col("page").withField("galleries", F.col("__galleries"))).drop("__galleries")
    out = resolved(written(made, "extracted")).drop("page").withColumn("site", F.col("seed_url"))
    out = out.withColumn("base", F.when(F.col("is_blog"), F.col("post_slug")).otherwise(F.col("page_slug"))).drop("post_slug", "page_slug")
    out = P.number_slugs(written(out, "resolved"), "base", "ord")
    if skip_blog:
        out = out.withColumn("kind", F.when(F.col("kind") == "blog", "page").otherwise(F.col("kind"))).withColumn("is_blog", F.lit(False))
    return out


def _first_of(pages: DataFrame, value: str, good: Column) -> DataFrame:
    """(seed_url, value) of the first page for which good holds."""
    return pages.where(good).groupBy("seed_url").agg(F.min_by(value, "ord").alias(value))


def site_navigation(pages: DataFrame) -> DataFrame:
    """(seed_url, nav) of the first page that has a navigation."""
    return _first_of(pages, "nav", F.size("nav") > 0)


def site_metadata(pages: DataFrame) -> DataFrame:
    """(seed_url, metadata) of the first page with a site title; of the last page where none has one."""
    titled = _first_of(pages, "metadata", F.coalesce(F.col("metadata.site_title"), F.lit("")) != "")
    last = pages.groupBy("seed_url").agg(F.max_by("metadata", "ord").alias("other"))
    return last.join(titled, "seed_url", "left").select("seed_url", F.coalesce("metadata", "other").alias("metadata"))


def image_urls(pages: DataFrame, metadata: DataFrame) -> DataFrame:
    """(seed_url, remote_url): every address of an image that the pages or the metadata of a site name, once."""
    of_pages = F.concat(F.transform("images", lambda i: i["src"]), F.array("hero_image"), F.flatten("galleries"))
    m = F.array("metadata.favicon", "metadata.logo", "metadata.og_image")
    both = pages.select("seed_url", F.explode(of_pages).alias("remote_url")).unionByName(metadata.select("seed_url", F.explode(m).alias("remote_url")))
    return both.where(F.coalesce(F.col("remote_url"), F.lit("")) != "").distinct()


def downloads_wanted(urls: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(seed_url, remote_url) to fetch: not to be skipped, upgraded, each once, without those that an earlier manifest (seed_url, remote_url) has."""
    out = urls.where(~U.is_skippable(F.col("remote_url"))).select("seed_url", U.upgrade_media(F.col("remote_url")).alias("remote_url")).distinct()
    return out if known is None else out.join(known.select("seed_url", "remote_url"), ["seed_url", "remote_url"], "left_anti")


def resumed_images(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """The entries of an earlier manifest (seed_url, relative_path, ...) whose file (seed_url, path) is there."""
    return manifest.join(present.select("seed_url", F.col("path").alias("relative_path")).distinct(), ["seed_url", "relative_path"], "left_semi")


def with_local_assets(metadata: DataFrame, downloads: DataFrame) -> DataFrame:
    """metadata whose favicon, logo and Open Graph image lead to the pack's files where these were downloaded."""
    out = metadata
    for k in ("favicon", "logo", "og_image"):
        side = downloads.select("seed_url", F.col("remote_url").alias("__url"), F.col("relative_path").alias("__path"))
        out = out.withColumn("__key", F.col(f"metadata.{k}")).join(side.withColumnRenamed("seed_url", "__site"), (F.col("seed_url") == F.col("__site")) & (F.col("__key") == F.col("__url")), "left")
        out = out.withColumn("metadata", F.col("metadata").withField(k, F.coalesce("__path", "__key"))).drop("__key", "__site", "__url", "__path")
    return out


def site_counts(pages: DataFrame, site_paths: DataFrame) -> DataFrame:
    """(seed_url, pages, blog_posts, galleries, images): images counts those with a path in the pack."""
    counts = pages.groupBy("seed_url").agg(F.count(F.lit(1)).alias("pages"), F.count(F.when(F.col("is_blog"), 1)).alias("blog_posts"), F.sum(F.size("galleries")).cast("long").alias("galleries"))
    paths = site_paths.groupBy(F.col("site").alias("seed_url")).agg(F.count(F.lit(1)).alias("images"))
    return counts.join(paths, "seed_url", "left").withColumn("images", F.coalesce("images", F.lit(0)))


def recommendations(broken: Column, navigation: Column, platform: Column, flagged: Column) -> Column:
    """A site's list from the number of broken images, the length of its navigation, its platform and the number of flagged images."""
    always = "Import with `webloom import <pack> --target <site>` after reviewing image-review.json."
    items = F.array(F.when(broken > 0, BROKEN), F.when(navigation == 0, NO_NAVIGATION), F.when(platform == "generic", GENERIC), F.lit(always), F.when(flagged > 0, F.concat(flagged.cast("string"), F.lit(FLAGGED))))
    return F.filter(items, lambda x: x.isNotNull())


def transformed(pages: DataFrame, transformers: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The pages after each transformer in turn."""
    return functools.reduce(DataFrame.transform, transformers, pages)


@dataclass(frozen=True)
class Extractor:
    """A platform's entry of the registry: its id, its name, and what makes its pages from captures (seed_url, normalized_url, ord, html) and platforms."""

    id: str
    name: str
    pages: Callable[..., DataFrame] = site_pages


REGISTRY: dict[str, Extractor] = {k: Extractor(k, v) for k, v in PLATFORM_NAMES.items()}


def register(extractor: Extractor) -> None:
    REGISTRY[extractor.id] = extractor


def extractor(platform: str) -> Extractor:
    """The platform's extractor; the generic one for those without."""
    return REGISTRY.get(platform, REGISTRY["generic"])


@dataclass(frozen=True)
class Options:
    """What a migration is asked for; wrong values are refused."""

    output: str = "output"
    depth: int = 10
    images: bool = True
    markdown: bool = True
    skip_images: bool = False
    skip_blog: bool = False
    json_export: bool = False
    platform: str = "auto"
    resume: bool = False
    overwrite: bool = False
    respect_robots: bool = True
    paths: tuple[str, ...] = ("/about", "/contact")
    transformers: tuple[Callable[[DataFrame], DataFrame], ...] = field(default=())

    def __post_init__(self) -> None:
        if isinstance(self.depth, bool) or not isinstance(self.depth, int) or self.depth < 1:
            raise ValueError("depth must be a positive whole number")
        known = {"auto", *REGISTRY, "cargo", "ghost", "framer", "adobe-portfolio"}
        if self.platform not in known:
            raise ValueError(f"platform must be one of {', '.join(sorted(known))}")
        for f in fields(self):
            if f.type == "bool" and not isinstance(getattr(self, f.name), bool):
                raise ValueError(f"{f.name} must be true or false")


def listed(value: str | None, fallback: tuple[str, ...] = ()) -> tuple[str, ...]:
    """A list from a command line: parts between commas, trimmed, without empty ones."""
    return tuple(x for part in value.split(",") if (x := part.strip())) if value else fallback


def migrate(captures: DataFrame, fetched: DataFrame, options: Options = Options()) -> dict[str, DataFrame]:  # noqa: B008
    """The tables of all sites' packs: pages, navigation, metadata, downloads, site_paths, review, markdown, issues, report and files (site, path, content).

    captures: seed_url, url, normalized_url, ord, depth, title, status, state, html (see discovery.captures); fetched: seed_url, remote_url, content,
    content_type of the images that were got. Where images are off, no image has a path, and heroes and galleries are left out.
    """
    platforms = written(site_platforms(captures, options.platform), "platforms")
    pages = written(transformed(site_pages(captures, platforms, options.skip_blog), list(options.transformers)), "pages")
    navigation, metadata = site_navigation(pages), site_metadata(pages)
    wanted = downloads_wanted(image_urls(pages, metadata))
    with_images = options.images and not options.skip_images
    got = fetched if with_images else fetched.limit(0)
    named = written(K.name_images(got.join(wanted, ["seed_url", "remote_url"], "left_semi").withColumn("site", F.col("seed_url"))).drop("content"), "downloads")
    downloads = named.where("not broken")
    broken = wanted.join(downloads.select("seed_url", "remote_url"), ["seed_url", "remote_url"], "left_anti") if with_images else wanted.limit(0)
    flat = pages.withColumn("images", F.transform("images", lambda i: i["src"]))
    references = written(K.image_references(flat), "references")
    paths = written(K.assign_site_paths(references, pages, downloads.select("site", "remote_url", "relative_path"), options.skip_blog), "site-paths")
    metadata = with_local_assets(metadata, downloads) if with_images else metadata
    alts = pages.withColumn("alts", F.map_from_entries(F.transform(F.filter("images", lambda i: i["alt"].isNotNull()), lambda i: F.struct(i["src"], i["alt"]))))
    review = written(K.review_images(references, alts, paths), "review")
    markdown = K.generate_markdown(pages.withColumn("images", F.col("images.src")), references, paths, options.skip_blog) if options.markdown else None
    files = [] if markdown is None else [written(markdown, "markdown").withColumnRenamed("site", "seed_url")]
    table = None if not files else files[0].select(F.col("seed_url").alias("pack"), F.col("path").alias("file"), F.col("content"))
    images = paths.select(F.col("site").alias("pack"), F.regexp_replace("site_path", "^/", "").alias("path"))
    issues = written(P.validate(K.read_for_validation(table), images), "issues") if table is not None else None
    report = written(site_report(captures, platforms, pages, navigation, metadata, paths, broken, review, issues), "report")
    out = {"platforms": platforms, "pages": pages, "navigation": navigation, "metadata": metadata, "downloads": named, "site_paths": paths, "review": review, "report": report}
    if issues is not None:
        out |= {"markdown": files[0], "issues": issues}
    return out | {"files": functools.reduce(DataFrame.unionByName, [*files, json_files(captures, navigation, metadata, review, report, pages if options.json_export else None)])}


def _collected(df: DataFrame, key: str, *order: str, value: str = "value") -> DataFrame:
    """(seed_url, array) of a site's values in order: what one file of the pack lists."""
    return df.groupBy(F.col(key).alias("seed_url")).agg(F.array_sort(F.collect_list(F.struct(*order, value))).alias("all")).select("seed_url", F.transform("all", lambda x: x[value]).alias("all"))


def site_report(captures, platforms, pages, navigation, metadata, site_paths, broken, review, issues=None) -> DataFrame:
    """A row per site: counts, broken images and links, missing metadata, warnings and recommendations."""
    missing = captures.where("state <> 'ok'")
    warned = missing.select("seed_url", F.col("ord").alias("o"), F.lit(0).alias("p"), F.concat(F.lit("No HTML captured for "), "normalized_url").alias("value"))
    if issues is not None:
        text = F.concat(F.lit("["), "level", F.lit("] "), "file", F.lit(": "), "message")
        warned = warned.unionByName(issues.select(F.col("pack").alias("seed_url"), F.col("ord").cast("long").alias("o"), F.lit(1).alias("p"), text.alias("value")))
    lists = {
        "warnings": _collected(warned, "seed_url", "p", "o"),
        "broken_links": _collected(missing.where("state = 'broken'").select("seed_url", "ord", F.col("normalized_url").alias("value")), "seed_url", "ord"),
        "broken_images": _collected(broken.select("seed_url", F.col("remote_url").alias("value")), "seed_url"),
    }
    flagged = review.where(F.size("flags") > 0).groupBy(F.col("site").alias("seed_url")).agg(F.count(F.lit(1)).alias("flagged"))
    out = platforms.join(site_counts(pages, site_paths), "seed_url", "left").join(navigation, "seed_url", "left").join(metadata, "seed_url", "left").join(flagged, "seed_url", "left")
    for name, df in lists.items():
        out = out.join(df.withColumnRenamed("all", name), "seed_url", "left").withColumn(name, F.coalesce(name, F.array().cast(_STRINGS)))
    n_nav, n = F.coalesce(F.size("nav"), F.lit(0)), lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    n_nav = F.when(F.col("nav").isNull(), 0).otherwise(n_nav)
    gone = K.missing_metadata(F.col("metadata.site_title"), F.col("metadata.description"), F.col("metadata.favicon"), n_nav)
    names = functools.reduce(lambda acc, k: acc.when(F.col("platform") == k, F.lit(REGISTRY[k].name)), REGISTRY, F.when(F.lit(False), F.lit("")))
    return out.select(
        "seed_url", F.coalesce(names, F.lit(REGISTRY["generic"].name)).alias("platform"), n("pages").alias("pages"), n("blog_posts").alias("blog_posts"), n("images").alias("images"), n("galleries").alias("galleries"),
        "broken_images", "broken_links", gone.alias("missing_metadata"), "warnings", recommendations(F.size("broken_images"), n_nav, F.col("platform"), n("flagged")).alias("recommendations"),
    )


CONFIG_STUB = """// Collections for the folders of this pack; adapt to the site.
export const collections = {
  pages: ["title", "description", "slug", "heroImage", "gallery"],
  blog: ["title", "description", "slug", "date", "author", "categories", "tags", "heroImage"],
};
"""


def json_files(captures: DataFrame, navigation: DataFrame, metadata: DataFrame, review: DataFrame, report: DataFrame, pages: DataFrame | None = None, started: str = "", finished: str = "") -> DataFrame:
    """(seed_url, path, content) of each site's structured files: pages.json, navigation.json, metadata.json, sitemap.json, image-review.json, report.json,
    report.md, the collections' stub, and content.json of pages if given."""
    row = lambda df, path, content: df.select("seed_url", F.lit(path).alias("path"), F.concat(content, F.lit("\n")).alias("content"))
    pretty = lambda c: F.to_json(c, {"pretty": "true"})
    sites = captures.select("seed_url").distinct()
    known = [c for c in ("url", "normalized_url", "depth", "status", "title") if c in captures.columns]
    each = _collected(captures.select("seed_url", "ord", F.struct(*known).alias("value")), "seed_url", "ord")
    urls = _collected(captures.select("seed_url", "ord", F.struct(F.col("normalized_url").alias("url"), *[c for c in ("title", "status") if c in captures.columns]).alias("value")), "seed_url", "ord")
    entry = F.struct("page_url", "remote_url", "site_path", "flags")
    reviewed = sites.join(_collected(review.select(F.col("site").alias("seed_url"), entry.alias("value")), "seed_url"), "seed_url", "left")
    nav = sites.join(navigation, "seed_url", "left").withColumn("nav", F.coalesce("nav", F.array().cast("array<struct<title:string,url:string>>")))
    r = {k: F.col(k) for k in report.columns} | {"started": F.lit(started), "finished": F.lit(finished)}
    out = [
        row(each, "pages.json", pretty(F.struct("seed_url", F.col("all").alias("pages")))),
        row(nav, "navigation.json", pretty(F.col("nav"))),
        row(metadata, "metadata.json", pretty(F.col("metadata"))),
        row(urls, "sitemap.json", pretty(F.struct("seed_url", F.col("all").alias("urls")))),
        row(reviewed, "image-review.json", F.coalesce(pretty(F.col("all")), F.lit("[]"))),
        row(report, "report.json", pretty(F.struct("*"))),
        report.select("seed_url", F.lit("report.md").alias("path"), K.report_markdown(r).alias("content")),
        sites.select("seed_url", F.lit("collections.config.example.ts").alias("path"), F.lit(CONFIG_STUB).alias("content")),
    ]
    if pages is not None:
        shown = [c for c in ("url", "title", "description", "slug", "headings", "text_content", "hero_image", "images", "links", "videos", "files", "galleries", "is_blog", "kind") if c in pages.columns]
        out.append(row(_collected(pages.select("seed_url", "ord", F.struct(*shown).alias("value")), "seed_url", "ord"), "content.json", pretty(F.col("all"))))
    return functools.reduce(DataFrame.unionByName, out)


def link_sources(pages: DataFrame, depth: Column) -> DataFrame:
    """Candidates for a crawl's next level from extracted pages: seed_url, raw, depth (one more), source 'link', ord (unique within the site)."""
    each = pages.select("seed_url", "ord", depth.alias("depth"), F.posexplode("links").alias("pos", "a")).where("a.internal")
    w = Window.partitionBy("seed_url").orderBy("ord", "pos")
    return each.select("seed_url", F.col("a.href").alias("raw"), (F.col("depth") + 1).alias("depth"), F.lit("link").alias("source"), F.row_number().over(w).cast("long").alias("ord"))
