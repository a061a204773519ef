"""URL and string functions, the HTML parser, extraction, platform scores, slugs, sources: vectors and small pages."""

import pytest
from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.functions import urls as U
from webloom.functions.html import parse
from webloom.operators import pages as P
from webloom.sources import discovery as D


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://Example.com/About/?utm_source=x#top", "https://example.com/About"),
        ("https://example.com", "https://example.com/"),
        ("http://example.com:80/a?b=2&a=1&b=1", "http://example.com/a?a=1&b=2&b=1"),
        ("https://example.com/é", "https://example.com/%C3%A9"),
    ],
)
def test_normalize(spark, url, want):
    assert one(spark, U.normalize(F.lit(url))) == want


@pytest.mark.parametrize(("url", "want"), [("https://a.b/tag/x", True), ("https://a.b/2020/01", True), ("https://a.b/2020/01/02/a/b", True), ("https://a.b/p?share=1", True), ("https://a.b/2020/01/02/a", False), ("https://a.b/about", False)])
def test_low_value(spark, url, want):
    assert one(spark, U.is_low_value(F.lit(url))) is want


def test_internal_and_resolve(spark):
    seed = F.lit("https://a.b/x/y")
    assert [one(spark, U.is_internal(F.lit(h), seed)) for h in ("/q", "https://a.b/", "http://a.b/", "mailto:x@y")] == [True, True, False, False]
    assert [one(spark, U.resolve(F.lit(h), seed)) for h in ("/q", "z", "//c.d/e", "?k=1")] == ["https://a.b/q", "https://a.b/x/z", "https://c.d/e", "https://a.b/x/y?k=1"]


def test_media(spark):
    wix = "https://static.wixstatic.com/media/AB_cd~mv2.jpg/v1/fill/w_9,h_9/t.jpg"
    assert one(spark, U.wix_media_id(F.lit(wix))) == "ab_cd~mv2.jpg"
    assert "/v1/fit/w_1800" in one(spark, U.upgrade_media(F.lit(wix)))
    assert one(spark, U.upgrade_media(F.lit("https://x.y/a.jpg?w=3&k=1"))) == "https://x.y/a.jpg?k=1"
    assert one(spark, U.is_other_host(F.lit("https://www.a.b/x.png"), F.lit("https://a.b/"))) is False


def test_strings(spark):
    assert one(spark, T.slug(F.lit("en/Hello World.html"))) == "enhello-world"
    assert one(spark, T.slug(F.lit("!!!"))) == "page"
    assert one(spark, T.file_name(F.lit("https://x/a b?w=1"))) == "a-b"
    assert one(spark, T.title_names(F.lit("About Ada Lovelace - the Gallery"))) == ["Ada", "Lovelace"]
    assert one(spark, T.front_date(F.lit("June 5, 2024"))) == "2024-06-05"
    assert one(spark, T.front_date(F.lit("soon"))) == "1970-01-01"


def test_parser():
    page = parse("<title>T &amp; U</title><p><b>one<p>two</b> three<ul><li>a<li>b</ul><script>'</p>'</script>")
    assert page.first("title").text() == "T & U"
    assert [p.text() for p in page.select("p")] == ["one", "two three"]
    assert [p.inner() for p in page.select("p")] == ["<b>one</b>", "<b>two</b> three"]
    assert [x.text() for x in page.select("ul li")] == ["a", "b"]
    assert parse(None).children[1].children == [] and parse("<").text() == "<"


def test_selectors():
    page = parse('<div id=a class="x y"><p data-k="Hello"><i>1</i></p></div>')
    for s in ("#a", ".x.y", "div p i", "[data-k]", "[data-k*='ell']", "[data-k='hello' i]", "nope, p"):
        assert page.select(s), s
    assert not page.select("#a > q, .z, [data-k='hello']")


PAGE = """<html lang=en><head><title>Acme | Home</title><meta property="og:description" content="We do."></head><body><nav><a href=/about>About</a></nav><div class=cookie-banner>Accept</div>
<main><h1>Acme</h1><p>Some text that is long enough to be the main part of it.</p><div class=gallery><img src=a.jpg><img src=b.jpg width=900><img src=c.jpg></div><a href=/f.pdf>File</a></main></body></html>"""


def test_extract(spark):
    row = P.extract(spark.createDataFrame([(1, PAGE), (2, None)], "id int, html string")).orderBy("id").collect()
    got = row[0].page
    assert (got.title, got.description, got.language) == ("Acme", "We do.", "en")
    assert [(n.title, n.href) for n in got.nav] == [("About", "/about")]
    assert "Accept" not in got.text_content and got.galleries == [["a.jpg", "b.jpg", "c.jpg"]] and got.images[1].width == 900
    assert got.markdown.startswith("# Acme\n") and "[File](/f.pdf)" in got.markdown
    assert row[1].page.title == "Untitled"


def test_platform(spark):
    rows = [('<meta name="generator" content="WordPress 6">', "wordpress"), ("<html data-wf-page=1>webflow", "webflow"), ("<p>", "generic")]
    got = P.detect(spark.createDataFrame([(h, "https://a.b/") for h, _ in rows], "html string, url string")).select("html", "platform").collect()
    assert {r.html: r.platform for r in got} == dict(rows)


def test_slugs_pass_taken_names(spark):
    rows = spark.createDataFrame([("s", "a", 1), ("s", "a", 2), ("s", "a-2", 3), ("s", "a", 4)], "site string, base string, o int")
    got = {r.o: r.slug for r in P.number_slugs(rows, "base", "o").collect()}
    assert got == {1: "a", 2: "a-2", 3: "a-2-2", 4: "a-3"}


def test_crawl(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = {r.url: r.depth for r in P.crawl(spark.createDataFrame([("a",)], "url string"), links, 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_sources(spark):
    docs = spark.createDataFrame([("s", "<sitemapindex><sitemap><loc>t</loc></sitemap></sitemapindex>"), ("t", "<urlset><url><loc>https://a.b/?x=1&amp;y=2</loc></url></urlset>")], "sitemap_url string, xml string")
    assert [r.url for r in D.sitemap_urls(docs, docs.where("sitemap_url = 's'")).collect()] == ["https://a.b/?x=1&y=2"]
    rules = D.robots_rules(spark.createDataFrame([("s", "User-agent: *\nDisallow: /x\nAllow: /x/y")], "site string, raw string"))
    pages = spark.createDataFrame([("s", "https://a.b/x/1"), ("s", "https://a.b/x/y"), ("s", "https://a.b/z")], "site string, url string")
    assert {r.url[-3:]: r.allowed for r in D.robots_allowed(pages, rules).collect()} == {"x/1": False, "x/y": True, "b/z": True}
    seed = "https://a.b/"
    answers = [(seed, 1, 4, '[{"link": "https://a.b/p/"}, {"link": "https://o.c/x"}, {"link": "/s.css"}, {"link": "/r"}]'), (seed, 2, 4, "[]"), (seed, 3, 4, '[{"link": "https://a.b/q"}]')]
    rest = D.rest_urls(spark.createDataFrame(answers, "seed_url string, page int, total_pages int, json string"))
    assert sorted(r.url for r in rest.collect()) == ["https://a.b/p", "https://a.b/r"]


def test_robots_groups(spark):
    raw = "User-agent: a\nUser-agent: *\nDisallow: /x\n\nSitemap: https://a.b/m.xml\nUser-agent: Loom/1\nDisallow: /y?q\n"
    table = spark.createDataFrame([("s", raw), ("t", None)], "site string, raw string")
    got = {k: sorted((r.site, r.pattern) for r in D.robots_rules(table, k).collect()) for k in ("*", "loom/2", "a", "b")}
    assert got == {"*": [("s", "/x")], "loom/2": [("s", "/y?q")], "a": [("s", "/x")], "b": [("s", "/x")]}
    assert sorted(r.sitemap_url for r in D.robots_sitemaps(table).collect()) == ["https://a.b/m.xml", "t/sitemap.xml"]
    pages = spark.createDataFrame([("s", "https://a.b/y?q=1"), ("s", "https://a.b/y")], "site string, url string")
    assert {r.url: r.allowed for r in D.robots_allowed(pages, D.robots_rules(table, "loom")).collect()} == {"https://a.b/y?q=1": False, "https://a.b/y": True}


def test_deep_pages():
    import time

    began = time.time()
    html = "<h1>T</h1>" + "<div>" * 3000 + "<p>deep <b>text</b></p>" + "</div>" * 3000 + "<span>" * 3000 + "end"
    got = P.extract_page(html)
    assert got[15] == "# T\n\ndeep **text**\n\nend\n" and got[4].endswith("</body>") and time.time() - began < 30


def test_markdown_tables_and_tasks():
    html = "<main><p>More than forty characters are needed to be the main part.</p><table><tr><th>a<th align=right>b</tr><tr><td>1<td>2|3</table><ul><li><input type=checkbox checked>done<li><input type=checkbox>open</ul><ol start=3><li>x</ol></main>"
    assert P.extract_page(html)[15].split("\n\n", 1)[1] == "| a | b |\n| --- | --: |\n| 1 | 2\\|3 |\n\n- [x] done\n- [ ] open\n\n3. x\n"


def test_pages_are_parsed_once(spark):
    rows = P.extract(spark.createDataFrame([(1, PAGE)], "id int, html string"), fields=["nav"]).select("id", F.explode("page.nav").alias("x")).where("x.href is not null")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1 and rows.count() == 1


def test_single_values_as_columns(spark):
    """weburl has the same algebra as urls."""
    from webloom.functions import weburl as W

    base = "https://A.b/x/y?q=1#f"
    hrefs = ["/p", "p/./q/../r", "../../z", "?r=2", "#g", "//C.d/e", "HTTP://E.f:80", "mailto:x@y.z", " /t ", "p?x=../y"]
    table = spark.createDataFrame([(h, base) for h in hrefs], "href string, base string")
    assert {r.href: r.u for r in table.withColumn("u", U.resolve(F.col("href"), F.col("base"))).collect()} == {h: W.absolute(h, base) for h in hrefs}
    images = ["https://i0.wp.com/p.jpg?w=3&x=1", "https://static.wixstatic.com/media/ab_12~mv2.png/v1/fill/w_9/p.png", "https://filesusr.com/v1/fill/w_20,h_2/c.png", "https://a.b/p.png?v=1", "https://a.b/favicon.ico"]
    table = spark.createDataFrame([(i,) for i in images], "url string")
    got = table.select("url", U.upgrade_media(F.col("url")).alias("up"), U.is_skippable(F.col("url")).alias("skip")).collect()
    assert {(r.url, r.up, r.skip) for r in got} == {(i, W.upgraded(i), W.is_skippable(i)) for i in images}


def test_malformed_escapes(spark):
    assert one(spark, U.normalize(F.lit("https://a.b/?q=100%&b=%41"))) == "https://a.b/?b=A&q=100%25"


def test_options():
    from webloom.operators import site as S

    assert S.listed(" a, ,b ") == ("a", "b") and S.listed(None, ("x",)) == ("x",)
    for wrong in ({"depth": 0}, {"depth": 1.5}, {"platform": "other"}, {"resume": "yes"}):
        with pytest.raises(ValueError):
            S.Options(**wrong)
    assert S.extractor("ghost").id == "generic" and S.extractor("wix").name == "Wix"


def test_guard_and_files(spark, tmp_path):
    from webloom.sources import files

    root = f"{tmp_path}/out"
    files.guard(spark, root)
    files.write_files(spark.createDataFrame([("pages/a.md", "---\ntitle: x\n---\nb"), ("images/i.png", "x")], "path string, content string"), root)
    with pytest.raises(FileExistsError):
        files.guard(spark, root)
    files.guard(spark, root, resume=True)
    assert sorted(r.path for r in files.paths(spark, root).collect()) == ["images/i.png", "pages/a.md"]
    entries = files.pack_entries(files.markdown_tree(spark, root).withColumn("pack", F.lit("p"))).collect()
    assert [(r.collection, r.slug) for r in entries] == [("pages", "a")]
    files.guard(spark, root, overwrite=True)
    assert files.paths(spark, root).count() == 0


def test_titles_of_cut_headings_equal_their_sql(spark, tmp_path):
    """A heading that was cut within a character reference keeps what is left of it, as in the query's SQL; extraction itself decodes it, as HTML does."""
    import duckdb

    from webloom.plans import catalogue

    headings = ["R &amp; D&amp", "&amp;lt; &lt;x&amp;&amp", "a &copy", "&copy; b&am", "  c  &quot;d&quot;  ", "&amplifier; &"]
    rows = [(i, f"https://a.b/{i}", f'<!DOCTYPE html><html lang="en"><head></head><body><h1>{x}</h1><p>y</p></body></html>') for i, x in enumerate(headings)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(tuple(r) for r in catalogue.page_titles(spark, str(tmp_path)).collect())
    sql = catalogue.oracle_sql()["page_titles"].replace("FROM pages", f"FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == sorted(duckdb.connect().execute(sql).fetchall()) and got[0][1] == "R & D&amp"
    assert P.extract_page(rows[0][2])[0] == "R & D&"
