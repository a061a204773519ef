"""Content packs: where images go, Markdown files with front matter, image review, reports, and what an import does with a pack.

Everything but the reading of YAML is Column expressions and equi-joins. The tables hold many sites; what one run would keep for its
site is a group of rows here. Pages come in the order of a column ord.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.functions import urls as U
from webloom.operators import pages as P

# Keys of front matter in their order, those an import keeps, pages an import protects.
KEYS = ["title", "description", "slug", "date", "sourceUrl", "heroImage", "gallery", "categories", "tags", "author", "draft"]
LISTS = ["gallery", "categories", "tags"]
IMPORTED = ["title", "description", "date", "heroImage", "gallery", "categories", "tags", "author", "draft"]


# Images of pages


def image_references(pages: DataFrame) -> DataFrame:
    """site, ord, pos, remote_url, is_hero from pages (site, ord, hero_image, galleries, images): the hero, then galleries, then the
    other images; the first place of each on its page."""
    listed = F.concat(F.array("hero_image"), F.coalesce(F.flatten("galleries"), F.array()), F.coalesce(F.col("images"), F.array()))
    remotes = F.array_distinct(F.filter(listed, lambda x: F.coalesce(x, F.lit("")) != ""))
    rows = pages.select("site", "ord", "hero_image", F.posexplode(remotes).alias("pos", "remote_url"))
    return rows.select("site", "ord", "pos", "remote_url", F.col("remote_url").eqNullSafe(F.col("hero_image")).alias("is_hero"))


def path_extension(path: Column) -> Column:
    found = F.regexp_extract(F.lower(path), r"\.(jpe?g|png|gif|webp|avif)$", 0)
    return F.when(found == "", ".jpg").when(found == ".jpeg", ".jpg").otherwise(found)


def assign_site_paths(references: DataFrame, pages: DataFrame, downloads: DataFrame, skip_blog: bool = False) -> DataFrame:
    """site, remote_url, site_path of downloaded images. references as image_references gives them; pages (site, ord, slug, kind,
    is_blog); downloads (site, remote_url, relative_path, hash ...), one row each.

    A page's hero that no earlier page has is its -hero; every other downloaded image takes the page's next number, whether an earlier
    page has given it a path or not; the first page's path stays. The first page of an image is found by an aggregate, which is
    combined before the shuffle, for a logo may be on every page.
    """
    found = references.join(downloads.select("site", "remote_url", "relative_path"), ["site", "remote_url"])
    first = found.groupBy("site", "remote_url").agg(F.min("ord").alias("first_ord"))
    placed = found.join(first, ["site", "remote_url"]).withColumn("fresh", F.col("ord") == F.col("first_ord"))
    placed = placed.withColumn("as_hero", F.col("fresh") & F.col("is_hero"))
    taken = F.sum(F.when(F.col("as_hero"), 0).otherwise(1)).over(Window.partitionBy("site", "ord").orderBy("pos"))
    kept = placed.withColumn("number", taken).where("fresh").join(pages.select("site", "ord", "slug", "kind", "is_blog"), ["site", "ord"])
    tail = F.when(F.col("as_hero"), "hero").otherwise(F.col("number").cast("string"))
    path = F.concat(F.lit("/images/"), P.folder(F.col("kind"), F.col("is_blog"), skip_blog), F.lit("/"), F.col("slug"), F.lit("-"), tail, path_extension(F.col("relative_path")))
    return kept.select("site", "remote_url", path.alias("site_path"))


def name_images(downloads: DataFrame) -> DataFrame:
    """downloads (site, remote_url, content, content_type) with relative_path and hash: equal bytes of a site share the file of the
    first address; equal names of different bytes get the start of the hash."""
    hashed = downloads.withColumn("hash", F.sha2("content", 256)).withColumn("bytes", F.length("content").cast("long"))
    base = T.file_name(F.regexp_replace(U.path(F.col("remote_url")), "/+$", ""), "image")
    named = F.when(F.lower(base).rlike(U.IMAGE), base).otherwise(F.concat(base, F.lit("."), T.extension(F.col("content"), F.col("content_type"))))
    firsts = hashed.where("bytes > 0").groupBy("site", "hash").agg(F.min(F.struct("remote_url", named.alias("name"))).alias("f"))
    same = Window.partitionBy("site", F.lower("f.name")).orderBy("f.remote_url")
    stem, tail = F.regexp_extract("f.name", r"^(.*)(\.[^.]*)$", 1), F.regexp_extract("f.name", r"^(.*)(\.[^.]*)$", 2)
    path = F.when(F.row_number().over(same) == 1, F.col("f.name")).otherwise(F.concat(stem, F.lit("-"), F.substring("hash", 1, 8), tail))
    files = firsts.select("site", "hash", F.concat(F.lit("images/"), path).alias("relative_path"))
    return hashed.join(files, ["site", "hash"], "left").withColumn("broken", F.col("relative_path").isNull())


def review_images(references: DataFrame, pages: DataFrame, site_paths: DataFrame) -> DataFrame:
    """site, page_url, remote_url, site_path, flags of every image of every page, unflagged ones too. pages (site, ord, url, seed_url,
    title, is_blog, kind, and alts: a map of the images' alternative texts, if known)."""
    alts = F.col("alts") if "alts" in pages.columns else F.lit(None).cast("map<string,string>")
    rows = references.join(pages.select("site", "ord", F.col("url").alias("page_url"), "seed_url", "title", "is_blog", "kind", alts.alias("alts")), ["site", "ord"])
    alt = F.coalesce(F.col("alts")[F.col("remote_url")], F.lit(""))
    flags = P.review_flags(F.col("remote_url"), F.col("seed_url"), alt, F.col("title"), F.col("is_blog"), F.col("is_hero"), F.col("kind"))
    return rows.withColumn("flags", flags).join(site_paths, ["site", "remote_url"], "left").select("site", "page_url", "remote_url", "site_path", "flags")


# Markdown files


def substitute(text: Column, paths: Column) -> Column:
    """text with each address replaced; paths is an array of structs (remote, local), longer addresses first."""
    return F.aggregate(paths, text, lambda t, p: F.replace(t, p["remote"], p["local"]))


def without_images(markdown: Column, locals_: Column) -> Column:
    """Markdown without the images whose targets are in an array; no more than one empty line is left."""
    quoted = lambda p: F.regexp_replace(p, r"([.*+?^${}()|\[\]\\/])", r"\\$1")
    cut = F.aggregate(locals_, markdown, lambda t, p: F.regexp_replace(t, F.concat(F.lit(r"!\[[^\]]*\]\("), quoted(p), F.lit(r"\)\n*")), F.lit("")))
    return F.concat(F.btrim(F.regexp_replace(cut, r"\n{3,}", "\n\n"), F.lit(" \t\n\r")), F.lit("\n"))


def _scalar(c: Column) -> Column:
    """A YAML scalar in double quotes; JSON's escapes are YAML's."""
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def front_matter(values: dict[str, Column]) -> Column:
    """A YAML block of KEYS; null values and empty lists are left out."""
    lines = []
    for key in [k for k in KEYS if k in values]:
        v = values[key]
        if key in LISTS:
            items = F.array_join(F.transform(v, lambda x: F.concat(F.lit("\n  - "), _scalar(x))), "")
            lines.append(F.when(F.size(v) > 0, F.concat(F.lit(f"{key}:"), items)))
        elif key == "draft":
            lines.append(F.concat(F.lit("draft: "), v.cast("string")))
        else:
            lines.append(F.when(v.isNotNull(), F.concat(F.lit(f"{key}: "), _scalar(v))))
    return F.concat_ws("\n", *lines)


def markdown_file(values: dict[str, Column], body: Column) -> Column:
    clean = F.btrim(F.regexp_replace(body, r"^---[\s\S]*?---\s*", ""), F.lit(" \t\n\r"))
    return F.concat(F.lit("---\n"), front_matter(values), F.lit("\n---\n\n"), clean, F.lit("\n"))


def split_front_matter(markdown: Column) -> Column:
    """struct of yaml (null where there is no block) and body."""
    block = r"^---\r?\n([\s\S]*?)\r?\n---\r?\n?([\s\S]*)$"
    has = markdown.rlike(block)
    return F.struct(F.when(has, F.regexp_extract(markdown, block, 1)).alias("yaml"), F.when(has, F.regexp_extract(markdown, block, 2)).otherwise(markdown).alias("body"))


FRONT = "struct<title:string,description:string,slug:string,date:string,sourceUrl:string,heroImage:string,gallery:array<string>,categories:array<string>,tags:array<string>,author:string,draft:boolean>"


def parse_front_matter(block: Column | str) -> Column:
    """YAML blocks to their known keys; dates stay text; what is not of a key's type is null, as is a block that is no mapping."""

    @F.pandas_udf(FRONT)
    def run(blocks: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import yaml

        class Loader(yaml.SafeLoader):
            pass

        Loader.yaml_implicit_resolvers = {k: [r for r in v if r[0] != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
        kinds = [(k, list if k in LISTS else bool if k == "draft" else str) for k in KEYS]

        def row(block: str | None) -> list:
            try:
                got = yaml.load(block, Loader) if block else {}
            except yaml.YAMLError:
                got = {}
            got = got if isinstance(got, dict) else {}
            found = [got.get(k) if isinstance(got.get(k), t) else None for k, t in kinds]
            return [[str(x) for x in v] if isinstance(v, list) else v for v in found]

        for batch in blocks:
            yield pd.DataFrame([row(b) for b in batch], columns=KEYS, dtype=object)

    return run(block)


def generate_markdown(pages: DataFrame, references: DataFrame, site_paths: DataFrame, skip_blog: bool = False) -> DataFrame:
    """site, path, content from pages (site, ord, url, slug, title, description, date, author, categories, tags, hero_image, galleries,
    kind, is_blog, text_content, markdown, videos, files) in whose markdown the images have their remote addresses.

    The first gallery's images leave the body if three of them or more have paths. Pages without images keep their body.
    """
    known = references.join(site_paths, ["site", "remote_url"]).groupBy("site", "ord").agg(F.collect_list(F.struct(F.col("remote_url").alias("remote"), F.col("site_path").alias("local"))).alias("paths"))  # one page's images
    rows = pages.join(known, ["site", "ord"], "left").withColumn("paths", F.coalesce("paths", F.array().cast("array<struct<remote:string,local:string>>")))
    by_length = F.array_sort("paths", lambda a, b: F.coalesce(F.nullif(F.length(b["remote"]) - F.length(a["remote"]), F.lit(0)), F.when(a["remote"] < b["remote"], -1).when(a["remote"] > b["remote"], 1).otherwise(0)))
    rows = rows.withColumn("paths", by_length).withColumn("map", F.map_from_entries("paths"))
    local = F.filter(F.transform(F.coalesce(F.get("galleries", 0), F.array().cast("array<string>")), lambda x: F.col("map")[x]), lambda x: x.isNotNull())
    rows = rows.withColumn("gallery", local).withColumn("body", substitute(F.col("markdown"), F.col("paths")))
    body = F.when(F.size("gallery") >= 3, without_images(F.col("body"), F.col("gallery"))).otherwise(F.col("body"))
    listed = lambda c, title, target, label: F.when(F.size(c) > 0, F.concat(F.lit(f"\n## {title}\n\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("- ["), label(x), F.lit("]("), x[target], F.lit(")\n"))), ""), F.lit("\n"))).otherwise("")
    some = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c])
    body = F.concat(body, listed(F.col("videos"), "Videos", "src", lambda v: F.coalesce(some(v["title"]), F.lit("Video"))), listed(F.col("files"), "Downloads", "href", lambda f: F.coalesce(some(f["text"]), F.lit("Download"))))
    post = F.lit(False) if skip_blog else F.col("is_blog")
    values = {
        "title": F.coalesce(some(F.col("title")), F.lit("Untitled")), "description": T.description(F.col("description"), F.col("text_content"), F.col("title")), "slug": F.col("slug"),
        "date": T.front_date(F.col("date")), "sourceUrl": F.col("url"), "heroImage": F.coalesce(F.col("map")[F.col("hero_image")], F.get("gallery", 0)), "gallery": F.col("gallery"),
        "categories": F.when(post, F.col("categories")), "tags": F.when(post, F.col("tags")), "author": F.when(post, F.col("author")),
    }
    path = F.concat(P.folder(F.col("kind"), F.col("is_blog"), skip_blog), F.lit("/"), F.col("slug"), F.lit(".md"))
    return rows.select("site", path.alias("path"), markdown_file(values, body).alias("content"))


def read_for_validation(files: DataFrame) -> DataFrame:
    """What pages.validate takes, from Markdown files (pack, file, content): front matter's fields and the image references, in the files' order."""
    front = files.withColumn("front", parse_front_matter(split_front_matter(F.col("content"))["yaml"]))
    refs = F.concat(F.filter(F.array("front.heroImage"), lambda x: x.isNotNull()), F.coalesce("front.gallery", F.array().cast("array<string>")), T.markdown_images(F.col("content")))
    order = Window.partitionBy("pack").orderBy("file")
    return front.select("pack", "file", F.row_number().over(order).alias("ord"), "front.title", "front.description", "front.slug", "front.date", refs.alias("refs"))


# Reports


def missing_metadata(title: Column, description: Column, favicon: Column, n_nav: Column) -> Column:
    gone = lambda c, name: F.when(F.coalesce(c, F.lit("")) == "", name)
    names = F.array(gone(title, "siteTitle"), gone(description, "description"), gone(favicon, "favicon"), F.when(F.coalesce(n_nav, F.lit(0)) == 0, "navigation"))
    return F.filter(names, lambda x: x.isNotNull())


def report_markdown(r: dict[str, Column]) -> Column:
    """The report file of a site; r: seed_url, platform, started, finished, four counts, and arrays of text."""
    heads = [("Seed URL", "seed_url"), ("Platform", "platform"), ("Started", "started"), ("Finished", "finished")]
    out = [F.lit("# Migration Summary\n\n"), *[x for name, key in heads for x in (F.lit(f"**{name}:** "), r[key], F.lit("\n\n"))], F.lit("## Counts\n\n| Metric | Count |\n| --- | ---: |\n")]
    lists = [("Broken Images", "broken_images"), ("Broken Links", "broken_links"), ("Missing Metadata", "missing_metadata"), ("Warnings", "warnings"), ("Recommendations", "recommendations")]
    counts = [("Pages", r["pages"]), ("Blog Posts", r["blog_posts"]), ("Images", r["images"]), ("Galleries", r["galleries"]), *((name, F.size(r[key])) for name, key in lists[:3])]
    out += [x for name, n in counts for x in (F.lit(f"| {name} | "), n.cast("string"), F.lit(" |\n"))]
    out.append(F.lit("\n## Review\n\nSee `image-review.json` for per-image flags (chrome, other-host, title-name-in-media, inline-blog).\n"))
    for name, key in lists:
        out.append(F.when(F.size(r[key]) > 0, F.concat(F.lit(f"\n## {name}\n\n- "), F.array_join(r[key], "\n- "), F.lit("\n"))).otherwise(""))
    return F.concat(*out)


# Import


def import_pack(entries: DataFrame, existing: DataFrame, files: DataFrame, review: DataFrame, protected: list[str] | None = None, overwrite_pages: bool = False, overwrite_entries: bool = False, include_flagged: bool = False) -> DataFrame:
    """pack, collection, slug, action, front (the struct with the keys an import keeps), body, without flagged images.

    entries (pack, collection, slug, content), existing (collection, slug, content) of the target, files (path) of its public folder,
    review (pack, site_path, flags). Pages that are there are replaced only if asked, protected or not; any other entry that is there is kept if all
    images it refers to are, else only its images are filled in.
    """
    skipped = review.where(P.skipped_on_import(F.col("flags"), include_flagged) & F.col("site_path").isNotNull())
    read = entries.withColumn("split", split_front_matter(F.col("content"))).withColumn("front", parse_front_matter("split.yaml")).drop("content")
    refs = F.filter(F.concat(F.array("front.heroImage"), F.coalesce("front.gallery", F.array().cast("array<string>"))), lambda x: F.coalesce(x.startswith("/"), F.lit(False)))
    keys = ["pack", "collection", "slug"]
    each = read.select(*keys, F.explode(refs).alias("path"))
    there = files.select(F.concat(F.lit("/"), F.regexp_replace("path", "^/+", "")).alias("path")).distinct().withColumn("found", F.lit(1))
    counted = each.join(there, "path", "left").groupBy(*keys).agg(F.count(F.lit(1)).alias("refs"), F.count(F.when(F.col("found").isNull(), 1)).alias("missing"))
    # The flagged images that an entry names, in its body or its front matter.
    named = read.select(*keys, F.explode(F.array_distinct(F.concat(refs, T.markdown_images(F.col("split.body"))))).alias("site_path"))
    flagged = named.join(skipped.select("pack", "site_path").distinct(), ["pack", "site_path"], "left_semi").groupBy(*keys).agg(F.array_sort(F.collect_list("site_path")).alias("flagged"))
    content = F.col("content") if "content" in existing.columns else F.lit(None).cast("string")
    own = existing.select("collection", "slug", content.alias("old_content")).dropDuplicates(["collection", "slug"])
    own = own.withColumn("exists", F.lit(True)).withColumn("old_split", split_front_matter(F.coalesce("old_content", F.lit(""))))
    own = own.withColumn("old", parse_front_matter("old_split.yaml")).withColumn("old_body", F.col("old_split.body")).drop("old_content", "old_split")
    rows = read.join(own, ["collection", "slug"], "left").join(counted, keys, "left").join(flagged, keys, "left")
    there_, none = F.coalesce("exists", F.lit(False)), F.array().cast("array<string>")
    action = P.import_action(F.col("collection"), there_, F.coalesce("refs", F.lit(0)), F.coalesce("missing", F.lit(0)), overwrite_pages, overwrite_entries)
    bad = F.coalesce("flagged", none)
    text = lambda c, other: F.coalesce(c, other)
    title = text(F.col("front.title"), F.lit("Untitled"))
    new = {k: F.col(f"front.{k}") for k in IMPORTED} | {
        "title": title,
        "description": text(F.col("front.description"), title),
        "date": F.when(F.col("collection") != "pages", text(F.col("front.date"), F.lit(T.NO_DATE))),
        "heroImage": F.when(~F.array_contains(bad, F.coalesce("front.heroImage", F.lit(""))), F.col("front.heroImage")),
        "gallery": F.array_except("front.gallery", bad),
    }
    # An entry that is there keeps its front matter and its body; the pack's hero and gallery go before its own.
    old_title = text(F.col("old.title"), F.lit("Untitled"))
    merged = {k: F.col(f"old.{k}") for k in IMPORTED} | {
        "title": old_title,
        "description": text(F.col("old.description"), old_title),
        "date": F.when(F.col("collection") != "pages", text(F.col("old.date"), F.lit(T.NO_DATE))),
        "heroImage": F.coalesce("front.heroImage", "old.heroImage"),
        "gallery": F.coalesce("front.gallery", "old.gallery"),
    }
    filled = F.col("action") == "filledImages"
    front = F.struct(*[F.when(filled, merged[k]).otherwise(new[k]).alias(k) for k in IMPORTED])
    body = F.when(filled, F.concat(F.btrim("old_body", F.lit(" \t\n\r")), F.lit("\n"))).otherwise(without_images(F.col("split.body"), bad))
    return rows.withColumn("action", action).select(*keys, "action", front.alias("front"), body.alias("body"))


def imported_file(front: Column, body: Column) -> Column:
    """The file that an import writes: the front matter's known keys, then the body without a block of its own."""
    return markdown_file({k: front[k] for k in IMPORTED}, body)


def images_to_copy(plan: DataFrame, entries: DataFrame, review: DataFrame, pack_files: DataFrame, include_flagged: bool = False) -> DataFrame:
    """(pack, path) of the images that an import copies: those that the added and filled entries name, that are in the pack's files (pack, path) and not skipped."""
    done = plan.where(F.col("action").isin("added", "filledImages")).select("pack", "collection", "slug")
    read = entries.join(done, ["pack", "collection", "slug"], "left_semi").withColumn("front", parse_front_matter(split_front_matter(F.col("content"))["yaml"]))
    named = read.select("pack", F.explode(F.concat(F.array("front.heroImage"), F.coalesce("front.gallery", F.array().cast("array<string>")))).alias("site_path")).where("site_path is not null").distinct()
    skipped = review.where(P.skipped_on_import(F.col("flags"), include_flagged) & F.col("site_path").isNotNull()).select("pack", "site_path").distinct()
    wanted = named.join(skipped, ["pack", "site_path"], "left_anti").select("pack", F.regexp_replace("site_path", "^/+", "").alias("path"))
    return wanted.distinct().join(pack_files.select("pack", "path").distinct(), ["pack", "path"], "left_semi")


def import_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("pack", "action").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("collection")).alias("collections"))
