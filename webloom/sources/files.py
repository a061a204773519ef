"""Files: Markdown trees and images as tables, and tables of (path, content) as files on any store that Arrow knows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def markdown_tree(spark: SparkSession, root: str) -> DataFrame:
    """file (below root) and content of every .md file, but report.md and what lies in images and node_modules."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True)
    below = F.regexp_extract("_metadata.file_path", r".*?" + _quoted(root.rstrip("/")) + r"/(.*)$", 1)
    kept = rows.select(below.alias("file"), F.col("value").alias("content"))
    return kept.where(~F.col("file").rlike("(^|/)(images|node_modules)/") & ~F.col("file").rlike("(^|/)report\\.md$"))


def _quoted(text: str) -> str:
    """text as a pattern of itself."""
    import re

    return re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", text.removeprefix("file://").removeprefix("file:"))


def _hadoop(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def guard(spark: SparkSession, root: str, resume: bool = False, overwrite: bool = False) -> None:
    """Refuses a folder that is there unless the run resumes or overwrites; overwriting empties it first."""
    fs, path = _hadoop(spark, root)
    if fs.exists(path):
        if not (resume or overwrite):
            raise FileExistsError(f"{root} already exists: resume or overwrite")
        if overwrite and not resume:
            fs.delete(path, True)
    fs.mkdirs(path)


def paths(spark: SparkSession, root: str) -> DataFrame:
    """path (below root) of every file; no rows where the folder is not there. Contents are not read."""
    fs, path = _hadoop(spark, root)
    if not fs.exists(path):
        return spark.createDataFrame([], "path string")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    return rows.select(F.regexp_extract("path", r".*?" + _quoted(root.rstrip("/")) + r"/(.*)$", 1).alias("path"))


def pack_entries(tree: DataFrame) -> DataFrame:
    """pack, collection, slug, content of the files of the three collections in a tree (pack, file, content), at any depth below them."""
    at = r"^(pages|blog|portfolio)/(?:.*/)?([^/]*)\.md$"
    return tree.where(F.col("file").rlike(at)).select("pack", F.regexp_extract("file", at, 1).alias("collection"), F.regexp_extract("file", at, 2).alias("slug"), "content")


def json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a JSON file that holds an array of objects."""
    text = spark.read.option("wholetext", "true").text(path)
    return text.select(F.explode(F.from_json("value", f"array<struct<{schema}>>")).alias("x")).select("x.*")


def review(spark: SparkSession, pack: str) -> DataFrame:
    """site_path and flags of a pack's image-review.json; no rows where it is not there."""
    fs, path = _hadoop(spark, f"{pack}/image-review.json")
    schema = "site_path:string,flags:array<string>"
    return json_table(spark, f"{pack}/image-review.json", schema) if fs.exists(path) else spark.createDataFrame([], "site_path string, flags array<string>")


def images(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")


def pretty_json(row: Column) -> Column:
    return F.concat(F.to_json(row, {"pretty": "true", "ignoreNullFields": "true"}), F.lit("\n"))


def write_files(rows: DataFrame, root: str) -> None:
    """One file for each row of (path, content) below root, from the executors. A file is written whole and a second try writes the
    same bytes, so a lost executor does no harm; rows with equal paths are refused."""
    twice = rows.groupBy("path").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"more than one content for {twice[0]['path']}")

    def put(part: Iterator[Row]) -> None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        for r in part:
            where = f"{base.rstrip('/')}/{r['path'].lstrip('/')}"
            if ".." in where.split("/"):
                raise ValueError(f"path leaves the folder: {r['path']}")
            store.create_dir(where.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(where) as out:
                out.write(r["content"].encode() if isinstance(r["content"], str) else bytes(r["content"]))

    rows.select("path", "content").foreachPartition(put)
