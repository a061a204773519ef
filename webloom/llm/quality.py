"""Quality rules: base counts of a text, and robust multivariate outliers by minimum covariance determinant. DataFrame functions only.

For each language and source, the statistics of its documents, transformed to be about symmetric, have their location and scatter
estimated by the half of them whose covariance has the least determinant. The search is that of deterministic MCD: it starts from
two robust first estimates and concentrates each, that is, estimates again from the half of the documents that lie nearest, until
the steps are used up; the start with the smaller determinant wins. A reweighting step follows, and documents whose Mahalanobis
distance is beyond the cutoff are rejected.

All sums are of whole numbers (the statistics are rounded to 1/1024), and the nearest half comes from a histogram of distances,
so nothing depends on the order of rows, and a group of any size is summed by partial aggregation. Groups with too few documents
for an estimate use that of their language over all sources, then that of the whole table. Variances have a ridge, so groups of copies do
not make all else an outlier. The statistics that spam pushes up are one-sided: below their centre they count as the centre.

Null texts count as empty: no words, base_failed. Null languages and sources form groups of their own. Repeated rows are separate
documents. Texts of any length are used whole. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import WHITE, small_side, words_of, written

SYMBOLS = "#*$%&|<>"
#: Names of the transformed statistics.
STATS = ("word_length", "symbols", "dup_lines", "repeats")
#: Those that only count above their centre.
ONE_SIDED = ("symbols", "dup_lines", "repeats")
#: A ridge, as standard deviations in the transformed units: differences of this order say nothing about quality.
FLOORS = {"word_length": 0.12, "symbols": 0.6, "dup_lines": 0.6, "repeats": 0.5}
#: Documents that a group needs for an estimate of its own.
LEAST_DOCS = 50
#: Concentration steps, share of the documents in the half, whole units per 1.
STEPS, HALF, UNIT = 6, 0.6, 1024
#: Quantiles of chi-squared with 4 degrees of freedom: of the share HALF (consistency), 0.975 (reweighting), 0.999 (rejection).
CHI_HALF, CHI_WEIGHT, CHI_REJECT = 4.0446, 11.1433, 18.4668


def chi2_share(x: float, freedom: int) -> float:
    """The distribution function of chi-squared for an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 0.0
    for k in range(freedom // 2):
        total += term
        term *= half / (k + 1)
    return 1 - math.exp(-half) * total


#: What truncation at those quantiles leaves of the variance: the mean of the chi-squared of 4 below them, over 4.
SHRINK_HALF, SHRINK_WEIGHT = (chi2_share(x, len(STATS) + 2) / chi2_share(x, len(STATS)) for x in (CHI_HALF, CHI_WEIGHT))


def base_counts(df: DataFrame, text: str) -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; intermediate arrays are columns of their own, computed once."""
    t = F.coalesce(F.col(text), F.lit(""))
    white = r"[\x20\x09-\x0D]+"
    out = df.withColumn("__w", words_of(t)).withColumn("__lines", F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0))
    out = out.withColumn("n_words", F.size("__w").cast("long"))
    out = out.withColumn("word_chars", F.length(F.regexp_replace(t, white, "")).cast("long"))
    out = out.withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"))
    out = out.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")).drop("__lines")
    # A window's hash, cut short by the bits that its place needs, and the place: one sort brings equal windows together.
    bits = F.greatest(F.ceil(F.log2(F.greatest(F.size("__w"), F.lit(2)))), F.lit(1)).cast("int")
    out = out.withColumn("__b", bits)
    places = F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), F.size("__w") - 3)).otherwise(F.array().cast("array<int>"))
    key = lambda i: F.call_function("shiftleft", F.xxhash64(F.col("__w")[i], F.col("__w")[i + 1], F.col("__w")[i + 2]), F.col("__b")).bitwiseOR(i.cast("long"))
    out = out.withColumn("__k", F.sort_array(F.transform(places, key)))
    h = lambda x: F.call_function("shiftrightunsigned", x, F.col("__b"))
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__b")) - 1
    n = F.size("__k")
    beside = lambda x, i: ((i > 0) & (h(F.get("__k", i - 1)) == h(x))) | ((i < n - 1) & (h(F.get("__k", i + 1)) == h(x)))
    out = out.withColumn("__d", F.sort_array(F.transform(F.filter("__k", beside), lambda x: x.bitwiseAND(low).cast("int"))))
    # Places ascend; each window covers three words, less what the next one covers too.
    covered = F.transform("__d", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("__d", i + 1) - x, F.lit(3))))
    out = out.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x))
    return out.drop("__w", "__b", "__k", "__d")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def statistics(df: DataFrame) -> DataFrame:
    """Adds the transformed statistics, as whole numbers of 1/1024: logs of rates, each with a start that damps small counts."""
    n, chars = F.col("n_words").cast("double"), F.col("word_chars").cast("double")
    raw = {
        "word_length": F.log((chars + 5) / (n + 1)),
        "symbols": F.log((F.col("n_symbols") + 1) / (chars + 100) * 100),
        "dup_lines": F.log((F.col("n_dup_lines") + 1) / (n + 50) * 100),
        "repeats": F.log((F.col("n_repeat_words") + 5) / (n + 50) * 10),
    }
    return df.withColumns({f"__{k}": F.round(v * UNIT).cast("long") for k, v in raw.items()})


def _l(i: int, j: int) -> str:
    return f"l{i}{j}"


def _with_cholesky(df: DataFrame) -> DataFrame:
    """Adds the lower Cholesky factor of the covariance c{i}{j}, and logdet."""
    p = len(STATS)
    for i in range(p):
        for j in range(i + 1):
            rest = functools.reduce(operator.add, [F.col(_l(i, k)) * F.col(_l(j, k)) for k in range(j)], F.lit(0.0))
            value = F.sqrt(F.greatest(F.col(f"c{i}{j}") - rest, F.lit(1e-6))) if i == j else (F.col(f"c{i}{j}") - rest) / F.col(_l(j, j))
            df = df.withColumn(_l(i, j), value)
    return df.withColumn("logdet", 2 * functools.reduce(operator.add, [F.log(_l(i, i)) for i in range(p)]))


def _squared_distance(one_sided: bool = False) -> Column:
    """Of the statistics from the location m{i} by the factor l{i}{j}, by forward substitution."""
    z: list[Column] = []
    for i, name in enumerate(STATS):
        x = F.col(f"__{name}") / F.lit(float(UNIT)) - F.col(f"m{i}")
        if one_sided and name in ONE_SIDED:
            x = F.greatest(x, F.lit(0.0))
        z.append((x - functools.reduce(operator.add, [F.col(_l(i, k)) * z[k] for k in range(i)], F.lit(0.0))) / F.col(_l(i, i)))
    return functools.reduce(operator.add, [x * x for x in z])


def _moments(rows: DataFrame, keys: list[str], shrink: float) -> DataFrame:
    """Location and scatter of each group, from exact sums; shrink corrects for the truncation, the ridge of FLOORS is added to the variances."""
    p, dec = len(STATS), "decimal(38,0)"
    sums = [F.count(F.lit(1)).alias("n")]
    sums += [F.sum(f"__{s}").alias(f"s{i}") for i, s in enumerate(STATS)]
    sums += [F.sum((F.col(f"__{STATS[i]}") * F.col(f"__{STATS[j]}")).cast("decimal(20,0)")).cast(dec).alias(f"q{i}{j}") for i in range(p) for j in range(i + 1)]
    out = rows.groupBy(*keys).agg(*sums)
    out = out.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") / UNIT for i in range(p)})
    cov = {}
    for i in range(p):
        for j in range(i + 1):
            c = (F.col(f"q{i}{j}").cast("double") / F.col("n") / (UNIT * UNIT) - F.col(f"m{i}") * F.col(f"m{j}")) / shrink
            cov[f"c{i}{j}"] = c + FLOORS[STATS[i]] ** 2 if i == j else c
    return _with_cholesky(out.withColumns(cov)).select(*keys, "n", "logdet", *[f"m{i}" for i in range(p)], *[_l(i, j) for i in range(p) for j in range(i + 1)])


def _starts(rows: DataFrame) -> DataFrame:
    """First estimates of each group: 0, median and median absolute deviation by histograms; 1, mean and covariance of all."""
    p, keys = len(STATS), ["group"]
    cells = rows.select("group", F.posexplode(F.array(*[F.col(f"__{s}") for s in STATS])).alias("stat", "x")).groupBy("group", "stat", "x").agg(F.count(F.lit(1)).alias("k"))
    middle = _weighted_median(cells, "x", "mid")
    away = cells.join(middle, ["group", "stat"]).withColumn("away", F.abs(F.col("x") - F.col("mid")))
    spread = _weighted_median(away.groupBy("group", "stat", "away").agg(F.sum("k").alias("k")), "away", "mad")
    wide = middle.join(spread, ["group", "stat"]).groupBy("group").pivot("stat", list(range(p))).agg(F.first("mid").alias("mid"), F.first("mad").alias("mad"))
    robust = wide.withColumns({f"m{i}": F.col(f"{i}_mid") / UNIT for i in range(p)})
    scale = [F.greatest(1.4826 * F.col(f"{i}_mad") / UNIT, F.lit(FLOORS[s])) for i, s in enumerate(STATS)]
    robust = robust.withColumns({f"c{i}{j}": scale[i] * scale[i] if i == j else F.lit(0.0) for i in range(p) for j in range(i + 1)})
    robust = _with_cholesky(robust).withColumn("n", F.lit(0).cast("long"))
    classical = _moments(rows, keys, 1.0)
    return robust.select(classical.columns).withColumn("start", F.lit(0)).unionByName(classical.withColumn("start", F.lit(1)))


def _weighted_median(cells: DataFrame, value: str, name: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("group", "stat")  # over distinct whole values, not documents
    run = cells.withColumn("upto", F.sum("k").over(w.orderBy(value))).withColumn("all", F.sum("k").over(w))
    return run.where(2 * F.col("upto") >= F.col("all")).groupBy("group", "stat").agg(F.min(value).alias(name))


def _nearest(rows: DataFrame, estimate: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The rows whose distance is in the nearest share of their group: up to the histogram cell (1/32 of a doubling) that completes it."""
    from pyspark.sql import Window

    near = rows.join(small_side(estimate.drop("n", "logdet")), "group").withColumn("cell", F.floor(32 * F.log2(_squared_distance() + 1e-3)).cast("int"))
    counted = near.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(*keys)
    cut = counted.withColumn("upto", F.sum("k").over(w.orderBy("cell"))).withColumn("all", F.sum("k").over(w)).where(F.col("upto") >= share * F.col("all"))
    cut = cut.groupBy(*keys).agg(F.min("cell").alias("last"))
    return near.join(small_side(cut), keys).where(F.col("cell") <= F.col("last")).select(*keys, *[f"__{s}" for s in STATS])


def estimate(rows: DataFrame, name: str) -> DataFrame:
    """Location and scatter by minimum covariance determinant of each group of rows (group, and the statistics)."""
    start = written(_starts(rows), f"{name}-start")
    for k in range(STEPS):
        start = written(_moments(_nearest(rows, start, ["group", "start"], HALF), ["group", "start"], SHRINK_HALF), f"{name}-step{k}")
    best = start.groupBy("group").agg(F.min(F.struct("logdet", "start")).alias("b")).select("group", F.col("b.start").alias("start"))
    raw = written(start.join(best, ["group", "start"]).drop("start"), f"{name}-raw")
    weighted = rows.join(small_side(raw.drop("n", "logdet")), "group").where(_squared_distance() <= CHI_WEIGHT).select("group", *[f"__{s}" for s in STATS])
    return written(_moments(weighted, ["group"], SHRINK_WEIGHT), name)


def _counted(df: DataFrame, text_col: str, lang_col: str, source_col: str, carried: list[Column]) -> DataFrame:
    """carried, the counts, the statistics and __groups: the groups of (language, source), of the language and of the whole table."""
    rows = df.select(*carried, F.col(text_col).alias("__text"), F.col(lang_col).cast("string").alias("__lang"), F.col(source_col).cast("string").alias("__source"))
    counted = statistics(base_counts(rows, "__text")).drop("__text").withColumn("base_failed", base_failed())
    own, lang, every = (F.xxhash64(F.lit(k), *c) for k, c in ((1, ["__lang", "__source"]), (2, ["__lang"]), (3, [])))
    return counted.withColumn("__groups", F.array(own, lang, every)).drop("__lang", "__source")


def _chosen(table: DataFrame) -> DataFrame:
    """__groups and the estimate that its documents are held against: that of the first of the three groups that has one."""
    # Each document adds to its own group, its language's and the whole table's; texts that fail the base rules add to none.
    members = table.where(~F.col("base_failed")).select(F.explode("__groups").alias("group"), *[f"__{s}" for s in STATS])
    sizes = written(members.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_DOCS).select("group"), "sizes")
    known = estimate(written(members.join(small_side(sizes), "group"), "members"), "mcd")
    triples = table.select("__groups").distinct().select("__groups", F.posexplode("__groups").alias("rank", "group")).join(small_side(known), "group")
    chosen = triples.groupBy("__groups").agg(F.min(F.struct("rank", *[c for c in known.columns if c not in ("group", "n", "logdet")])).alias("e"))
    return written(chosen.select("__groups", "e.*").drop("rank"), "chosen")


def _judge(counted: DataFrame, chosen: DataFrame) -> DataFrame:
    out = counted.join(small_side(chosen), "__groups", "left").withColumn("distance", _squared_distance(one_sided=True))
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CHI_REJECT))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judged(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """A row per document: id_col, the base counts, base_failed, kept and distance (the squared Mahalanobis distance)."""
    table = written(_counted(df, text_col, lang_col, source_col, [F.col(id_col).alias("__id")]), "statistics")
    return _judge(table, _chosen(table)).select(F.col("__id").alias(id_col), *COUNTS, "base_failed", "kept", "distance")


def kept_rows(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of df that are kept, as they are. The counts are taken twice, rather than the texts written."""
    table = written(_counted(df, text_col, lang_col, source_col, []), "statistics")
    # A filter may not be pushed below the counts, which would put them into it many times over: the row number holds it up.
    again = _counted(df, text_col, lang_col, source_col, [F.struct("*").alias("__row")]).withColumn("__n", F.monotonically_increasing_id())
    return _judge(again, _chosen(table)).where(F.col("kept") & (F.col("__n") >= 0)).select("__row.*")
