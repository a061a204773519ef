"""What the operators share: written tables in the shared folder, size-checked joins, white space."""

from __future__ import annotations

import functools
import gc
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.session import discard, shared_dir, written  # noqa: F401

#: The white space that separates words in every contract: space, tab, line feed, vertical tab, form feed, return.
WHITE = " \t\n\x0b\f\r"
#: Rows that a broadcast side may have; each broadcast here has rows of at most a few hundred bytes.
BROADCAST_ROWS = 200_000


def release(spark: SparkSession) -> None:
    """Lets the executors delete the shuffle files of steps that are done: Spark does so when the driver's collector finds their plans unused, which a
    driver with memory to spare may do only after many steps."""
    gc.collect()
    spark._jvm.System.gc()


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has few enough rows; else as it is, for a shuffled join that AQE can split."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Equality on columns, with null equal to null."""
    return functools.reduce(operator.and_, [left[n].eqNullSafe(right[n]) for n in names])


def whole_id(df: DataFrame, id_col: str) -> Column:
    """The id column as long; ids that are no whole numbers are refused, for a cast would lose them."""
    kind = df.schema[id_col].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long", "void"):
        raise TypeError(f"{id_col} must hold whole numbers, not {kind}")
    return F.col(id_col).cast("long")


def pow2(n: float, least: int = 1) -> int:
    """The smallest power of two that is at least n and least."""
    return max(least, 1 << max(0, int(n - 1e-9)).bit_length()) if n > 1 else least


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text as an array; null and empty texts have none."""
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def arrow_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bounds the rows of an Arrow batch, for texts may be long; kept where the session already has a smaller bound."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


#: Rows of a bucket that are held against each other in one go.
BLOCK_ROWS = 256


def blocks(rows: DataFrame, key: str = "key", uid: str = "uid", joined: str | None = None, size: int = BLOCK_ROWS) -> DataFrame:
    """rows with part, lo and hi, to be dealt by key, lo and hi. A bucket of up to size rows is one block; a larger one is
    cut into parts, and each pair of parts is a block, so that every two rows of the bucket meet in one of them. joined: a flag of the rows of
    a bucket that are linked with each other already; they have parts of their own, which meet the other rows' parts only."""
    linked = F.col(joined) if joined else F.lit(False)
    parts_of = lambda flag: F.ceil(F.count(F.when(flag, 1)) / size).cast("int")
    parts = rows.groupBy(key).agg(parts_of(~linked).alias("parts"), parts_of(linked).alias("others")).where("parts > 0")
    mine = F.when(linked, F.col("others")).otherwise(F.col("parts"))
    cut = rows.join(parts, key).withColumn("part", F.when(linked, F.col("parts")).otherwise(0) + F.pmod(F.xxhash64(F.lit(5), uid), mine).cast("int"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(linked, F.col("parts")).otherwise(F.col("parts") + F.col("others")) - 1)))
    return met.withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")}).drop("parts", "others", "other")


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of rows that are equal in the first columns (whole numbers, no nulls), over the batches' ends."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        head = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:keys]])
        cuts = [0, *(np.flatnonzero((head[:, 1:] != head[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and tuple(head[:, a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = tuple(head[:, a])
    if held:
        yield pa.Table.from_batches(held)
