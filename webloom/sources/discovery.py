"""Addresses from sitemaps, feeds, REST answers and robots rules, given as tables of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.functions import urls as U

DEEPEST = 3


def sitemap_locations(xml: Column, kind: str) -> Column:
    """The loc of each url or sitemap element."""
    found = F.regexp_extract_all(xml, F.lit(rf"(?is)<(?:\w+:)?{kind}(?:\s[^>]*)?>.*?<(?:\w+:)?loc[^>]*>\s*([^<]*?)\s*</"), F.lit(1))
    return F.filter(F.transform(found, T.decode_xml), lambda x: x != "")


def sitemap_urls(documents: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, url) from sitemaps (sitemap_url, xml) and the indexes that lead to them, DEEPEST levels down."""
    level = roots.select(F.col("sitemap_url").alias("root"), "sitemap_url")
    out = None
    for _ in range(DEEPEST + 1):
        read = level.join(documents, "sitemap_url")
        urls = read.select("root", F.explode(sitemap_locations(F.col("xml"), "url")).alias("url"))
        out = urls if out is None else out.unionByName(urls)
        level = read.select("root", F.explode(sitemap_locations(F.col("xml"), "sitemap")).alias("sitemap_url"))
    return out


def feed_urls(documents: DataFrame) -> DataFrame:
    """(seed_url, url) of internal pages named in feeds: documents (seed_url, xml), with status and content_type if known. Answers that
    failed or are HTML are no feeds."""
    if "status" in documents.columns:
        documents = documents.where(F.coalesce(F.col("status").between(200, 299), F.lit(True)))
    if "content_type" in documents.columns:
        documents = documents.where(~F.coalesce(F.col("content_type").contains("text/html"), F.lit(False)))
    texts = F.regexp_extract_all("xml", F.lit(r"(?i)<(?:link|guid|id)[^>]*>([^<]+)</"), F.lit(1))
    hrefs = F.regexp_extract_all("xml", F.lit(r"(?i)<link[^>]+href=[\"']([^\"']+)[\"']"), F.lit(1))
    rows = documents.select("seed_url", F.explode(F.concat(texts, hrefs)).alias("raw"))
    return _pages_of(rows, "seed_url").select("seed_url", "url").distinct()


def _bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once: filters on it are not pushed below it, which would spell the expression out wherever they use it."""
    return df.withColumn(name, F.explode(F.array(value)))


def _pages_of(rows: DataFrame, seed: str) -> DataFrame:
    """rows (seed, raw) whose raw address is internal and no asset, with absolute, and url, normalised."""
    found = _bound(rows, "absolute", U.resolve(F.col("raw"), F.col(seed)))
    kept = found.where(U.is_at(F.col("absolute"), F.col(seed)) & ~F.coalesce(U.is_asset(F.col("absolute")), F.lit(False)))
    return _bound(kept, "url", U.normalize(F.col("absolute")))


# Pages that are asked for on every site, places of feeds, agents' names.
CONTENT_PATHS = ["/about", "/contact"]
FEED_PATHS = ["/feed", "/feed/atom", "/rss.xml"]


def extra_seeds(seed: Column, paths: list[str] = CONTENT_PATHS) -> Column:
    """Addresses on the seed's origin that are asked for in any case, each once."""
    own = [p if p.startswith("/") else f"/{p}" for p in paths]
    return F.array_distinct(F.array(*[U.normalize(F.concat(U.origin(seed), F.lit(p))) for p in own])) if own else F.array().cast("array<string>")


def feed_addresses(seed: Column) -> Column:
    return F.array(*[F.concat(U.origin(seed), F.lit(p)) for p in FEED_PATHS])


def rest_urls(answers: DataFrame, most: int = 50) -> DataFrame:
    """(seed_url, url) of posts from a site's own endpoint: answers (seed_url, page, total_pages, json, and status if known). Pages are read in order
    until one fails or has no posts, up to most of them."""
    ok = F.coalesce(F.col("status").between(200, 299), F.lit(True)) if "status" in answers.columns else F.lit(True)
    read = answers.withColumn("posts", F.when(ok, F.from_json("json", "array<struct<link:string>>")))
    read = read.where(F.col("page") <= F.least(F.coalesce("total_pages", F.lit(1)), F.lit(most)))
    bad = read.where("posts is null or size(posts) = 0").groupBy("seed_url").agg(F.min("page").alias("end"))
    rows = read.join(bad, "seed_url", "left").where("end is null or page < end").select("seed_url", F.explode("posts.link").alias("raw"))
    return _pages_of(rows, "seed_url").select("seed_url", "url").distinct()


def hosted_rest_urls(answers: DataFrame, most: int = 20) -> DataFrame:
    """(seed_url, url) of posts from the hosting service's endpoint: answers (seed_url, nth: from 0, json with posts and found)."""
    read = answers.where(F.col("nth") < most).withColumn("body", F.from_json("json", "struct<posts:array<struct<URL:string,link:string>>,found:bigint>"))
    bad = read.where("body is null or body.posts is null or size(body.posts) = 0").groupBy("seed_url").agg(F.min("nth").alias("end"))
    rows = read.join(bad, "seed_url", "left").where("end is null or nth < end").select("seed_url", F.explode("body.posts").alias("x"))
    return _pages_of(rows.select("seed_url", F.coalesce(F.nullif("x.URL", F.lit("")), "x.link").alias("raw")), "seed_url").select("seed_url", "url").distinct()


def post_urls(own: DataFrame, hosted: DataFrame) -> DataFrame:
    """(seed_url, url): a site's own answers, or the hosting service's where its own have no address."""
    first = rest_urls(own)
    return first.unionByName(hosted_rest_urls(hosted).join(first.select("seed_url").distinct(), "seed_url", "left_anti"))


def _robots_lines(robots: DataFrame) -> DataFrame:
    """site, place, key, value and group of the lines of robots.txt (site, raw). Agent lines that follow each other begin one group."""
    lines = robots.select("site", F.posexplode(F.split(F.coalesce("raw", F.lit("")), r"\r\n|\r|\n")).alias("place", "line"))
    parsed = lines.select("site", "place", F.lower(F.regexp_extract("line", r"^\s*([A-Za-z-]+)\s*:", 1)).alias("key"), F.trim(F.regexp_extract("line", r"^\s*[A-Za-z-]+\s*:\s*([^#]*)", 1)).alias("value"))
    ordered = Window.partitionBy("site").orderBy("place")  # the lines of one file
    known = parsed.where("key in ('user-agent', 'allow', 'disallow', 'sitemap')")
    apart = known.where("key <> 'sitemap'")
    begins = (F.col("key") == "user-agent") & F.coalesce(F.lag("key").over(ordered) != "user-agent", F.lit(True))
    grouped = apart.withColumn("group", F.sum(F.when(begins, 1).otherwise(0)).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.unionByName(known.where("key = 'sitemap'").withColumn("group", F.lit(None).cast("long")))


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """(site, sitemap_url): those that robots.txt (site: an origin, raw) names, or the usual place."""
    named = _robots_lines(robots).where("key = 'sitemap' and value <> ''").select("site", F.col("value").alias("sitemap_url")).distinct()
    usual = robots.select("site").distinct().join(named.select("site").distinct(), "site", "left_anti").select("site", F.concat("site", F.lit("/sitemap.xml")).alias("sitemap_url"))
    return named.unionByName(usual)


def robots_rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """(site, allow, pattern) of the groups for an agent, or else of those for all agents, from robots.txt (site, raw); the pattern is a prefix with * and $."""
    name = agent.split("/")[0].strip().lower()
    lines = _robots_lines(robots).where("group is not null")
    agents = lines.where("key = 'user-agent'").select("site", "group", F.lower(F.trim(F.substring_index("value", "/", 1))).alias("agent"))
    mine = agents.where(F.col("agent").isin(name, "*")).withColumn("own", (F.col("agent") == name) & F.lit(name != "*"))
    best = mine.groupBy("site").agg(F.max("own").alias("best"))
    groups = mine.join(best, "site").where("own = best").select("site", "group").distinct()
    rules = lines.where("key in ('allow', 'disallow') and value <> ''").join(groups, ["site", "group"], "left_semi")
    return rules.select("site", (F.col("key") == "allow").alias("allow"), F.col("value").alias("pattern"))


def robots_allowed(pages: DataFrame, rules: DataFrame, site: str = "site", url: str = "url") -> DataFrame:
    """pages with allowed: the longest pattern that fits path and query decides, allow wins ties, no pattern allows. A site's rules are one array, joined once."""
    each = rules.groupBy(F.col("site").alias("__site")).agg(F.collect_list(F.struct(F.length("pattern").alias("n"), "allow", "pattern")).alias("__rules"))
    p = F.concat(U.path(F.col(url)), F.regexp_extract(F.col(url), r"^[^?#]*(\?[^#]*)?", 1))
    regex = lambda r: F.concat(F.lit("^"), F.replace(F.regexp_replace(r, r"([.+?^{}()|\[\]\\])", r"\\$1"), F.lit("*"), F.lit(".*")))
    hits = F.filter(F.coalesce("__rules", F.array().cast("array<struct<n:int,allow:boolean,pattern:string>>")), lambda r: F.regexp_like(p, regex(r["pattern"])))
    return pages.join(each, F.col(site) == F.col("__site"), "left").withColumn("allowed", F.coalesce(F.array_max(hits)["allow"], F.lit(True))).drop("__site", "__rules")


# Where an address was found, in the order in which the sources are asked.
SOURCES = ["seed", "sitemap", "link"]


def admitted(candidates: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """seed_url, url (as first named), normalized_url, depth, source of the pages that a crawl takes up: internal, no assets, of value, allowed,
    each address once, the first by ord. candidates: seed_url, raw, depth, source, ord; a seed itself is taken in any case."""
    home = candidates.where((F.col("source") == "seed") & (F.col("depth") == 0)).withColumn("url", U.normalize(F.col("raw")))
    rest = candidates.where(~((F.col("source") == "seed") & (F.col("depth") == 0)))
    found = _pages_of(rest, "seed_url")
    found = found.where(~U.is_low_value(F.col("url")))
    if rules is not None:
        found = robots_allowed(found.withColumn("__origin", U.origin(F.col("seed_url"))), rules, "__origin").where("allowed").drop("allowed", "__origin")
    named = ["seed_url", "raw", "depth", "source", "ord", "url"]
    both = home.select(*named).unionByName(found.select(*named))
    first = both.groupBy("seed_url", "url").agg(F.min(F.struct("ord", "raw", "depth", "source")).alias("f"))
    return first.select("seed_url", F.col("f.raw").alias("url"), F.col("url").alias("normalized_url"), F.col("f.depth").alias("depth"), F.col("f.source").alias("source"))


def resumed(candidates: DataFrame, manifest: DataFrame) -> DataFrame:
    """A frontier that goes on: the pages of an earlier manifest (seed_url, url, normalized_url, depth) and the admitted candidates that it lacks."""
    known = manifest.select("seed_url", "url", "normalized_url", "depth").withColumn("source", F.lit("resume"))
    new = admitted(candidates).join(known.select("seed_url", "normalized_url"), ["seed_url", "normalized_url"], "left_anti")
    return known.unionByName(new)


def manifest(pages: DataFrame) -> DataFrame:
    """Pages of a crawl in the order of their normalised addresses within a site, with ord from 0; what pages.json lists."""
    w = Window.partitionBy("seed_url").orderBy("normalized_url")
    return pages.withColumn("ord", F.row_number().over(w).cast("long") - 1)


def captures(listed: DataFrame, fetched: DataFrame) -> DataFrame:
    """The manifest's pages with their html, and state: 'ok', 'broken' (no html and a status of 400 or more) or 'missing'. fetched: seed_url, normalized_url, status, html."""
    both = listed.join(fetched, ["seed_url", "normalized_url"], "left")
    none = F.coalesce(F.col("html"), F.lit("")) == ""
    return both.withColumn("state", F.when(~none, "ok").when(F.coalesce(F.col("status") >= 400, F.lit(False)), "broken").otherwise("missing"))
