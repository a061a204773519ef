"""Mixing sources to target weights by pivotal dependent rounding. DataFrame functions only.

A source whose target is x times its size asks for x copies of each of its documents. The whole part is taken of every document;
the fraction is rounded dependently. Two documents with fractional copies meet, and a mass of words goes from one to the other, at
random with the odds that keep both expectations, until one of them has a whole copy or none. Their sum of words stays the same.
The documents of a source are dealt into buckets of about FAN; each bucket leaves one document that is still fractional, which
goes up a reduction tree of the same fan until one is left for each source, whose last copy is drawn by its remaining odds.

Documents meet in the order of falling sizes, so what a bucket leaves is mostly small, and a source's last draw moves few words.

Rows of one source, id and size are counted first and are one unit of the tree: m of them with a fraction p have floor(m * p) extra copies
for certain, and what is over is the unit's fraction. So neither repeated ids nor a third of all rows with a null id meet in one bucket.

The draws are hashes of the ids, the sizes and the seed: a rerun gives the same mix, however the rows are partitioned. Null texts and texts without words have size 0 and are
never taken. A null source is a source of its own, the last one. Rows with equal ids are separate documents; ids must be whole numbers. An empty table gives
an empty mix. Other columns of any name are kept apart from the operator's own.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import small_side, whole_id, words_of, written

#: Documents that meet in one bucket of the tree, on average.
FAN = 64
#: Rows of one unit that are written out by one task at a time.
CHUNK = 10_000
_EPS = 1e-9


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, docs, target, odds. The weights repeat over the sources, by code point, null last.

    A target above cap times its source's size stops there and the excess goes to the others by weight. That ends where
    target = least(cap * size, level * weight) with one level for all; sorted by cap * size / weight, the level is the first
    that the sources from there on can take. The windows without partitions run over one row per source, already summed.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    order = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    place = F.row_number().over(order) - 1
    ranked = by_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("most") / F.col("weight"))
    before = Window.partitionBy().orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levelled = ranked.withColumn("level", level)
    levelled = levelled.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    target = F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(F.col("copies") + _EPS)
    return (
        levelled.withColumn("target", target)
        .withColumn("copies", copies)
        .select("source", "source_size", "docs", "target", whole.cast("long").alias("whole"), F.greatest(F.lit(0.0), F.col("copies") - whole).alias("odds"))
    )


def _draw(seed: int, *ids: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *ids), 11)) / F.lit(float(1 << 53))


def _meet(seed: int):
    """Folds a bucket: the fractional unit held so far meets the next one; the settled one goes to done."""

    def fold(acc: Column, x: Column) -> Column:
        a_gets = F.least((1 - acc["p"]) * acc["size"], x["p"] * x["size"])
        b_gets = F.least(acc["p"] * acc["size"], (1 - x["p"]) * x["size"])
        to_a = _draw(seed, acc["id"], acc["size"], x["id"], x["size"]) * (a_gets + b_gets) < b_gets
        moved = F.when(to_a, a_gets).otherwise(-b_gets)
        snap = lambda p: F.when(p < _EPS, F.lit(0.0)).when(p > 1 - _EPS, F.lit(1.0)).otherwise(p)
        unit = lambda u, p: F.struct(u["id"].alias("id"), u["size"].alias("size"), u["m"].alias("m"), u["sure"].alias("sure"), p.alias("p"))
        met = F.array(F.struct(snap(acc["p"] + moved / acc["size"]).alias("a"), snap(x["p"] - moved / x["size"]).alias("b")))

        def settle(n: Column) -> Column:  # the settled one of the two, and the one that may still be fractional
            ends = n["a"].isin(0.0, 1.0)
            a, b = unit(acc, n["a"]), unit(x, n["b"])
            left = F.when(ends, b).otherwise(a)
            return F.struct(F.array_append(acc["done"], F.when(ends, a).otherwise(b)).alias("done"), *[left[c].alias(c) for c in ("id", "size", "m", "sure", "p")])

        return F.transform(met, settle)[0]

    return fold


_KEYS = ["source", "source_size", "target", "whole"]
_UNIT = ["id", "size", "m", "sure", "p"]


def _round(level: DataFrame, seed: int) -> DataFrame:
    """A row for each bucket: done, the settled units, and rest, the one that is left."""
    order = F.struct((-F.col("size")).alias("o"), F.xxhash64(F.lit(seed), "id", "size").alias("h"), *_UNIT)
    got = level.groupBy(*_KEYS, "bucket", "buckets").agg(F.array_sort(F.collect_list(order)).alias("all"))
    first = F.col("all")[0]
    start = F.struct(F.expr("CAST(array() AS array<struct<id:bigint,size:bigint,m:bigint,sure:bigint,p:double>>)").alias("done"), *[first[c].alias(c) for c in _UNIT])
    return got.select(*_KEYS, "bucket", "buckets", F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), start, _meet(seed)).alias("r"))


def rounded(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 20) -> DataFrame:
    """source, source_size, target, id, size, m (rows alike), whole (copies that each has) and extra (rows of the m that have one more), for a
    written table of id, source and size."""
    goal = written(targets(sizes, weights, share, cap), "targets")
    few = small_side(goal.withColumnRenamed("source", "__source"))
    units = sizes.groupBy("source", "id", "size").agg(F.count(F.lit(1)).alias("m"))
    rows = units.join(few, F.col("source").eqNullSafe(F.col("__source")), "inner").drop("__source")
    mass = F.col("m") * F.col("odds")
    rows = rows.withColumn("sure", F.when(F.col("size") > 0, F.floor(mass + _EPS)).otherwise(0).cast("long"))
    rows = rows.withColumn("p", F.when(F.col("size") > 0, F.greatest(mass - F.col("sure"), F.lit(0.0))).otherwise(0.0)).withColumn("whole", F.when(F.col("size") > 0, F.col("whole")).otherwise(0).cast("long"))
    rows = written(rows, "units")
    names = [*_KEYS, "id", "size", "m"]
    settled = [rows.where(F.col("p") < _EPS).select(*names, F.col("sure").alias("extra"))]
    level = rows.where(F.col("p") >= _EPS).select(*_KEYS, *_UNIT)
    counts = written(level.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / FAN).alias("buckets")), "buckets")
    n = counts.agg(F.max("buckets")).first()[0] or 0
    counts = small_side(counts.withColumnRenamed("source", "__source"))
    level = level.join(counts, F.col("source").eqNullSafe(F.col("__source"))).drop("__source").withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "id", "size"), F.col("buckets")))
    depth = 1
    while n > 1:
        depth, n = depth + 1, -(-n // FAN)
    for k in range(depth):
        made = written(_round(level, seed + 1 + k), f"round{k}")
        settled.append(made.select(*_KEYS, F.inline("r.done")).select(*names, (F.col("sure") + F.col("p").cast("long")).alias("extra")))
        level = made.select(*_KEYS, *[F.col(f"r.{c}").alias(c) for c in _UNIT], F.floor(F.col("bucket") / FAN).alias("bucket"), F.ceil(F.col("buckets") / FAN).alias("buckets"))
    last = (_draw(seed, F.col("id"), F.col("size")) < F.col("p")).cast("long")
    settled.append(level.select(*names, (F.col("sure") + last).alias("extra")))
    return functools.reduce(DataFrame.unionByName, settled)


def _copies(units: DataFrame) -> DataFrame:
    """A row for each row that a unit stands for, with copies; units of very many rows are cut up and dealt out first."""
    units = written(units, "rounded")
    one = units.where("m = 1").withColumn("copies", F.col("whole") + F.col("extra"))
    many = units.where("m > 1").withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(CHUNK).cast("long"))))
    many = written(many.repartition("source", "id", "size", "a"), "chunks").withColumn("k", F.explode(F.sequence(F.col("a"), F.least(F.col("a") + CHUNK, F.col("m")) - 1)))
    return one.unionByName(many.withColumn("copies", F.col("whole") + (F.col("k") < F.col("extra")).cast("long")).drop("a", "k"))


def mix_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """A row per document: id_col, size, source_size, target, taken."""
    return _copies(rounded(sizes_of(df, id_col, text_col, source_col), **how)).select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def _size(text_col: str) -> Column:
    return F.size(words_of(F.col(text_col))).cast("long")


def sizes_of(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The written table that rounded takes."""
    return written(df.select(whole_id(df, id_col).alias("id"), F.col(source_col).alias("source"), _size(text_col).alias("size")), "sizes")


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of df, each as often as the mix takes it. Rows with equal sources, ids and sizes share their copies in any order."""
    units = written(rounded(sizes_of(df, id_col, text_col, source_col), **how), "rounded")
    ids = written(units.groupBy("id").agg(F.sum("m").alias("rows")).where("rows = 1 and id is not null").select("id"), "single")
    single = written(units.join(ids, "id", "left_semi").select(F.col("id").alias("__id"), (F.col("whole") + F.col("extra")).alias("__copies")), "copies").hint("merge")  # one plan at every size: it has a row for each document
    packed = df.select(whole_id(df, id_col).alias("__key"), F.col(source_col).alias("__source"), F.col(text_col).alias("__text"), F.struct("*").alias("__row"))
    out = packed.join(single, F.col("__key") == F.col("__id")).where("__copies > 0").select("__row", "__copies")
    alike = units.join(ids, "id", "left_anti")
    if not alike.isEmpty():
        # Rows of a unit are numbered by the partition that they lie in, and there by their place, so that no unit is sorted in one task.
        alike = written(alike.select("source", "id", "size", "whole", "extra"), "alike")
        placed = packed.withColumn("__size", _size("__text")).withColumn("__at", F.spark_partition_id()).withColumn("__n", F.monotonically_increasing_id())
        same = F.col("__key").eqNullSafe(F.col("id")) & F.col("__source").eqNullSafe(F.col("source")) & (F.col("__size") == F.col("size"))
        placed = written(placed.join(small_side(alike), same).select("source", "id", "size", "whole", "extra", "__at", "__n", "__row"), "placed")
        unit = ["source", "id", "size"]
        before = Window.partitionBy(*unit).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)  # over partitions
        firsts = placed.groupBy(*unit, "__at").agg(F.count(F.lit(1)).alias("k")).withColumn("__first", F.coalesce(F.sum("k").over(before), F.lit(0))).drop("k").withColumnsRenamed({c: f"__{c}_" for c in [*unit, "__at"]})
        hit = F.col("__at") == F.col("____at_")
        for c in unit:
            hit = hit & F.col(c).eqNullSafe(F.col(f"__{c}_"))
        nth = F.row_number().over(Window.partitionBy(*unit, "__at").orderBy("__n")) - 1
        ranked = placed.withColumn("__nth", nth).join(small_side(written(firsts, "firsts")), hit)
        copies = F.col("whole") + (F.col("__first") + F.col("__nth") < F.col("extra")).cast("long")
        out = out.unionByName(ranked.withColumn("__copies", copies).where("__copies > 0").select("__row", "__copies"))
    return out.withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select("__row.*")
