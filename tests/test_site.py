"""The whole flow on a small site: captures and fetched images to a pack's tables and files."""

import json

import pytest
from pyspark.sql import functions as F

from webloom.operators import packs as K
from webloom.operators import pages as P
from webloom.operators import site as S
from webloom.sources import discovery as D

SEED = "https://a.b/"
HOME = """<html lang=en><head><title>Home | Acme</title><link rel=icon href=/icon.png></head><body><nav><a href=/about>About</a><a href=https://o.c/>Out</a></nav>
<main><h1>Welcome</h1><p>Words enough to be the main part of the page, surely.</p><img src=https://a.b/hero.png width=900 alt=Hero><img src=https://o.c/other.png></main></body></html>"""
POST = """<html><head><title>Post</title><meta property="article:published_time" content="2024-05-06"><meta property="article:tag" content="x"></head>
<body><main><h1>First post</h1><p>Words enough to be the main part of the page, surely.</p><img src=https://a.b/hero.png><a href=/doc.pdf>Paper</a></main></body></html>"""


@pytest.fixture(scope="module")
def pack(spark):
    rows = [(SEED, "https://a.b/", HOME, 200), (SEED, "https://a.b/blog/first", POST, 200), (SEED, "https://a.b/gone", None, 404), (SEED, "https://a.b/late", None, 200)]
    listed = D.manifest(spark.createDataFrame([(s, u, u, 0, None) for s, u, _, _ in rows], "seed_url string, url string, normalized_url string, depth int, title string"))
    fetched = spark.createDataFrame([(s, u, c, h) for s, u, h, c in rows], "seed_url string, normalized_url string, status int, html string")
    images = spark.createDataFrame([(SEED, "https://a.b/hero.png", bytearray(b"\x89PNG1"), "image/png"), (SEED, "https://o.c/other.png", bytearray(b"\x89PNG2"), "image/png")], "seed_url string, remote_url string, content binary, content_type string")
    return S.migrate(D.captures(listed, fetched), images, S.Options(json_export=True))


def test_pages_and_report(pack):
    got = {r.url: r for r in pack["pages"].collect()}
    assert {u: (r.slug, r.kind, r.is_blog) for u, r in got.items()} == {"https://a.b/": ("home", "page", False), "https://a.b/blog/first": ("first", "blog", True)}
    assert got["https://a.b/"].hero_image == "https://a.b/hero.png" and [tuple(n) for n in got["https://a.b/"].nav] == [("About", "/about")]
    report = pack["report"].first()
    assert (report.platform, report.pages, report.blog_posts, report.images, report.galleries) == ("Generic HTML", 2, 1, 2, 0)
    assert report.broken_links == ["https://a.b/gone"] and report.broken_images == ["https://a.b/icon.png"] and report.missing_metadata == ["description"]
    assert report.warnings[:2] == ["No HTML captured for https://a.b/gone", "No HTML captured for https://a.b/late"] and len(report.recommendations) == 4
    assert {(r.remote_url, r.site_path, tuple(r.flags)) for r in pack["review"].collect()} == {("https://a.b/hero.png", "/images/pages/home-hero.png", ()), ("https://o.c/other.png", "/images/pages/home-1.png", ("other-host",))}


def test_files(pack):
    files = {r.path: r.content for r in pack["files"].collect()}
    assert {"pages/home.md", "blog/first.md", "pages.json", "navigation.json", "metadata.json", "sitemap.json", "content.json", "image-review.json", "report.json", "report.md"} <= set(files)
    post = files["blog/first.md"]
    assert 'date: "2024-05-06"' in post and 'heroImage: "/images/pages/home-hero.png"' in post and "![](/images/pages/home-hero.png)" in post and "- [Paper](https://a.b/doc.pdf)" in post
    assert json.loads(files["navigation.json"]) == [{"title": "About", "url": "/about"}]
    assert json.loads(files["metadata.json"])["site_title"] == "Home | Acme" and len(json.loads(files["pages.json"])["pages"]) == 4
    assert files["report.md"].startswith("# Migration Summary") and json.loads(files["report.json"])["pages"] == 2


def test_validation_of_packs(spark, pack):
    issues = {(r.file, r.level, r.message) for r in pack["issues"].collect()}
    assert issues == set()
    md = "---\ntitle: x\nslug: \"\"\n---\n![a](/i.png)"
    again = K.read_for_validation(spark.createDataFrame([("p", "pages/a.md", md), ("p", "blog/a.md", "---\ntitle: t\nslug: s\n---\n![a](https://o.c/i.png) ![b](/j.png)")], "pack string, file string, content string"))
    found = P.validate(again, spark.createDataFrame([("p", "images/j.png")], "pack string, path string"))
    assert sorted((r.file, r.message.split(":")[0]) for r in found.collect()) == [
        ("blog/a.md", "Missing description"), ("blog/a.md", "Missing real date (1970-01-01 means article date was not found)"), ("blog/a.md", "Remote image reference remains"),
        ("pages/a.md", 'Duplicate filename "a.md" also used by blog/a.md'), ("pages/a.md", "Invalid frontmatter"),
    ]
    assert {r["pack"]: r["ok"] for r in P.is_valid(found, again).collect()} == {"p": False}


def test_import_copies_and_merges(spark):
    content = '---\ntitle: "n"\nheroImage: "/images/a.png"\ngallery:\n  - "/images/b.png"\n---\n\nnew\n'
    old = '---\ntitle: "o"\ndate: "2020-01-01"\nheroImage: "/images/z.png"\n---\n\nold\n'
    entries = spark.createDataFrame([("p", "blog", "s", content), ("p", "pages", "home", content), ("p", "pages", "new", content)], "pack string, collection string, slug string, content string")
    existing = spark.createDataFrame([("blog", "s", old), ("pages", "home", old)], "collection string, slug string, content string")
    review = spark.createDataFrame([("p", "/images/b.png", ["chrome"])], "pack string, site_path string, flags array<string>")
    plan = K.import_pack(entries, existing, spark.createDataFrame([], "path string"), review, ["about"])
    got = {(r.collection, r.slug): r for r in plan.collect()}
    assert {k: r.action for k, r in got.items()} == {("blog", "s"): "filledImages", ("pages", "home"): "skippedProtected", ("pages", "new"): "added"}
    merged, new = got["blog", "s"], got["pages", "new"]
    assert (merged.front.title, merged.front.heroImage, merged.front.gallery, merged.body) == ("o", "/images/a.png", ["/images/b.png"], "old\n") and (new.front.gallery, new.body) == ([], "new\n")
    copied = K.images_to_copy(plan, entries, review, spark.createDataFrame([("p", "images/a.png"), ("p", "images/b.png")], "pack string, path string"))
    assert [tuple(r) for r in copied.collect()] == [("p", "images/a.png")]


def test_resume(spark):
    manifest = spark.createDataFrame([(SEED, "https://a.b/x", "https://a.b/x", 1)], "seed_url string, url string, normalized_url string, depth int")
    rows = [(SEED, SEED, 0, "seed", 0), (SEED, "/x", 1, "link", 1), (SEED, "/y#f", 1, "link", 2), (SEED, "/y", 1, "link", 3), (SEED, "//o.c/z", 1, "link", 4), (SEED, "/feed", 1, "link", 5)]
    candidates = spark.createDataFrame(rows, "seed_url string, raw string, depth int, source string, ord long")
    assert {(r.normalized_url, r.source) for r in D.resumed(candidates, manifest).collect()} == {("https://a.b/x", "resume"), (SEED, "seed"), ("https://a.b/y", "link")}
    known = spark.createDataFrame([(SEED, "images/a.png", "https://a.b/a.png"), (SEED, "images/b.png", "https://a.b/b.png")], "seed_url string, relative_path string, remote_url string")
    kept = S.resumed_images(known, spark.createDataFrame([(SEED, "images/a.png")], "seed_url string, path string"))
    assert [r.remote_url for r in kept.collect()] == ["https://a.b/a.png"]
    doubled = S.transformed(known, [lambda d: d.withColumn("n", F.lit(1)), lambda d: d.withColumn("n", F.col("n") + 1)])
    assert {r.n for r in doubled.collect()} == {2}
