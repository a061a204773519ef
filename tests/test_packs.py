"""Site paths, image names, Markdown files, imports, platform extractors, files and the stream, on small tables."""

import datetime

from pyspark.sql import functions as F

from webloom.operators import packs as K
from webloom.operators import pages as P
from webloom.sources import files as S
from webloom.streaming import ingest

PAGES = "site string, ord int, slug string, kind string, is_blog boolean, hero_image string, galleries array<array<string>>, images array<string>"


def test_site_paths(spark):
    pages = spark.createDataFrame([("s", 1, "a", "page", False, "h", [["g", "h"]], ["i", "gone"]), ("s", 2, "b", "gallery", False, "i", None, ["j"]), ("s", 3, "c", "page", True, None, [], None)], PAGES)
    refs = K.image_references(pages)
    assert [(r.ord, r.remote_url, r.is_hero) for r in refs.orderBy("ord", "pos").collect()] == [(1, "h", True), (1, "g", False), (1, "i", False), (1, "gone", False), (2, "i", True), (2, "j", False)]
    down = spark.createDataFrame([("s", x, f"images/{x}.jpeg") for x in "hgij"], "site string, remote_url string, relative_path string")
    got = {r.remote_url: r.site_path for r in K.assign_site_paths(refs, pages, down).collect()}
    # The second page's hero has a path already, and still takes number 1.
    assert got == {"h": "/images/pages/a-hero.jpg", "g": "/images/pages/a-1.jpg", "i": "/images/pages/a-2.jpg", "j": "/images/portfolio/b-2.jpg"}


def test_image_names(spark):
    rows = [("s", "https://x/a.png", b"1111", None), ("s", "https://y/a.png", b"2222", None), ("s", "https://z/other", b"1111", "image/gif"), ("s", "https://z/none", b"", None), ("s", "https://z/b", b"\xff\xd8\xff\xe0", None)]
    got = {r.remote_url: (r.relative_path, r.broken) for r in K.name_images(spark.createDataFrame(rows, "site string, remote_url string, content binary, content_type string")).collect()}
    assert got["https://x/a.png"] == ("images/a.png", False) == got["https://z/other"]
    assert got["https://y/a.png"][0].startswith("images/a-") and got["https://z/none"] == (None, True) and got["https://z/b"][0] == "images/b.jpg"


def test_front_matter_round_trip(spark):
    text = 'a: "b"\\ \n # é'
    rows = spark.createDataFrame([(text, ["x: y", "- z"], None)], "t string, g array<string>, n string")
    made = rows.select(K.markdown_file({"title": F.col("t"), "date": F.lit("2024-01-02"), "gallery": F.col("g"), "author": F.col("n")}, F.lit("---\nold: 1\n---\n\nbody\n")).alias("c"))
    row = made.select(K.split_front_matter(F.col("c")).alias("s")).select(K.parse_front_matter("s.yaml").alias("f"), "s.body").first()
    assert (row.f.title, row.f.date, row.f.gallery, row.f.author) == (text, "2024-01-02", ["x: y", "- z"], None) and row.body == "\nbody\n"
    odd = spark.createDataFrame([("no block",), ("---\n[\n---\nx",), ("---\n- 1\n---\nx",), (None,)], "c string").select(K.split_front_matter(F.col("c")).alias("s")).select(K.parse_front_matter("s.yaml").alias("f")).collect()
    assert all(r.f.title is None for r in odd)


def test_without_images(spark):
    md = "a\n\n![x](/i/a.b.png)\n\n![y](/i/aXb.png)\n"
    assert spark.range(1).select(K.without_images(F.lit(md), F.array(F.lit("/i/a.b.png"))).alias("x")).first().x == "a\n\n![y](/i/aXb.png)\n"


def test_platform_extractors(spark):
    wix = '<meta name="generator" content="Wix.com"><body><div id=SITE_PAGES><p>Some words that make the page long enough.</p><img src=a.jpg><img src=b.jpg></div><img data-src=c.jpg><img src=d.jpg></body>'
    word = '<meta name="generator" content="WordPress"><body><main>Around the article there is other text to leave out.<div class=entry-content>The text of the article is in here, all of it.</div></main></body>'
    rows = spark.createDataFrame([(1, "https://a.b/works", wix), (2, "https://a.b/about", wix), (3, "https://a.b/2020/01/x", word), (4, "https://a.b/about", word)], "id int, url string, html string")
    got = {r.id: r for r in P.with_kind(P.extract(P.detect(rows), platform="platform")).collect()}
    assert got[1].kind == "gallery" and got[1].galleries == [["a.jpg", "b.jpg", "c.jpg", "d.jpg"]]
    assert got[2].kind == "page" and got[2].galleries == []
    assert got[3].kind == "blog" and "Around" not in got[3].page.text_content and got[4].kind == "page"


def test_files(spark, tmp_path):
    root = str(tmp_path)
    S.write_files(spark.createDataFrame([("blog/a.md", "x\n"), ("images/b.md", "y"), ("report.md", "z")], "path string, content string"), root)
    assert [(r.file, r.content) for r in S.markdown_tree(spark, root).collect()] == [("blog/a.md", "x\n")]


def test_stream(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(1, "https://a.b/x#1", "<h1>One</h1>", at), (2, "https://a.b/x?utm_source=q", "<h1>One</h1>", at), (3, "https://a.b/y", None, at), (4, "https://a.b/z", "<h1>z</h1>", None)]
    spark.createDataFrame(rows, ingest.CAPTURE).coalesce(1).write.parquet(f"{tmp_path}/in")
    ingest.start(ingest.extracted(ingest.captures(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/ck", once=True).awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r.normalized_url for r in got) == ["https://a.b/x", "https://a.b/y"]
