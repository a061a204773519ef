"""python -m webloom migrate|validate|import: over Parquet tables of captures, and folders of packs."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from webloom.operators import packs, pages, site
from webloom.sources import files


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="webloom")
    sub = top.add_subparsers(dest="command", required=True)
    m = sub.add_parser("migrate", help="captures to packs")
    m.add_argument("captures", help="Parquet of seed_url, url, normalized_url, ord, depth, title, status, state, html")
    m.add_argument("--fetched", help="Parquet of seed_url, remote_url, content, content_type")
    m.add_argument("--output", default="output")
    m.add_argument("--platform", default="auto")
    for flag in ("--resume", "--overwrite", "--skip-images", "--skip-blog", "--json-export", "--no-images", "--no-markdown"):
        m.add_argument(flag, action="store_true")
    v = sub.add_parser("validate", help="check a pack's Markdown files")
    v.add_argument("pack")
    i = sub.add_parser("import", help="plan what an import of a pack does")
    i.add_argument("pack")
    i.add_argument("--target", required=True)
    i.add_argument("--protected-pages", default="home,about,contact")
    for flag in ("--overwrite-pages", "--overwrite-entries", "--include-flagged"):
        i.add_argument(flag, action="store_true")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    if a.command == "migrate":
        options = site.Options(output=a.output, platform=a.platform, resume=a.resume, overwrite=a.overwrite, skip_images=a.skip_images, skip_blog=a.skip_blog, json_export=a.json_export, images=not a.no_images, markdown=not a.no_markdown)
        files.guard(spark, options.output, options.resume, options.overwrite)
        fetched = spark.read.parquet(a.fetched) if a.fetched else spark.createDataFrame([], "seed_url string, remote_url string, content binary, content_type string")
        got = site.migrate(spark.read.parquet(a.captures), fetched, options)["files"]
        folder = F.regexp_replace(F.regexp_replace("seed_url", "^https?://", ""), "[^A-Za-z0-9.-]+", "-")
        files.write_files(got.select(F.concat(folder, F.lit("/"), "path").alias("path"), "content"), options.output)
        return 0
    tree = files.markdown_tree(spark, a.pack).withColumn("pack", F.lit(a.pack))
    if a.command == "validate":
        issues = pages.validate(packs.read_for_validation(tree), files.paths(spark, a.pack).withColumn("pack", F.lit(a.pack)))
        bad = 0
        for r in issues.orderBy("ord").toLocalIterator():
            print(f"[{r.level}] {r.file}: {r.message}")
            bad += r.level == "error"
        return int(bad > 0)
    entries = files.pack_entries(tree)
    existing = files.pack_entries(files.markdown_tree(spark, f"{a.target}/src/content").withColumn("pack", F.lit("target")))
    review = files.review(spark, a.pack).withColumn("pack", F.lit(a.pack))
    plan = packs.import_pack(entries, existing, files.paths(spark, f"{a.target}/public"), review, list(site.listed(a.protected_pages)), a.overwrite_pages, a.overwrite_entries, a.include_flagged)
    for r in packs.import_summary(plan).toLocalIterator():
        print(f"{r.action}: {r.n}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
