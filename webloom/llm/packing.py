"""Packing documents into sequences by minimum bin slack.

A document's ids, with the end id, are cut into windows of the capacity; the last, shorter window goes to the packer. Windows of
one length are alike to it, so it works on their counts: a table of at most capacity - 1 numbers, whatever the corpus. Each pattern
starts from the longest length left; a subset-sum over the others, as bits of one integer, gives every fill that is possible
with the counts left, and the one with least padding is backtracked into how many windows of each length it takes. The pattern is
used as often as the counts allow. Each window then finds its sequence from its rank among the windows of its length.

A sequence is padded to the capacity unless its length is a power of two. Null and empty texts give a window with the end id alone.
Rows with equal ids are separate documents. An empty table gives no windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import arrow_batches, pow2, small_side, whole_id, written
from webloom.llm.encoding import encoder


def padding(total: int, capacity: int) -> int:
    return 0 if total & (total - 1) == 0 else capacity - total


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many windows of each length to put together, with the longest among them, for least padding; then the fullest."""
    lengths = sorted((n for n, c in counts.items() if c), reverse=True)
    longest = lengths[0]
    room = (1 << (capacity + 1)) - 1
    reach, steps = 1 << longest, []  # bit s: the sum s can be made
    for n in lengths:
        left = min(counts[n] - (n == longest), (capacity - longest) // n)
        k = 1
        while left > 0:  # 1, 2, 4, ... copies make up every number of copies
            k = min(k, left)
            steps.append((n, k, reach))
            reach |= (reach << (n * k)) & room
            left, k = left - k, 2 * k
        if reach >> capacity & 1:
            break
    sums = [s for s in range(longest, capacity + 1) if reach >> s & 1] if not reach >> capacity & 1 else [capacity]
    total = min(sums, key=lambda s: (padding(s, capacity), -s))
    take = {longest: 1}
    for n, k, before in reversed(steps):
        if not before >> total & 1:
            take[n] = take.get(n, 0) + k
            total -= n * k
    return take


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns and how often each is used; together they take every window."""
    left, patterns = dict(counts), []
    while any(left.values()):
        take = best_fill(left, capacity)
        times = min(left[n] // k for n, k in take.items())
        for n, k in take.items():
            left[n] -= k * times
        patterns.append((take, times))
    return patterns


def _windows(vocabulary: str, drops_space: bool, end_id: int, capacity: int, with_ids: bool):
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 6 if with_ids else 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary, drops_space), np.array([end_id], "<u4")
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for doc, ids in zip(batch.column(0).to_pylist(), enc.encode([x or "" for x in batch.column(1).to_pylist()]), strict=True):
                whole = np.concatenate([ids, end])
                for a in range(0, len(whole), capacity):
                    data = whole[a : a + capacity].tobytes()
                    for c, v in zip(cols, (doc, a, len(data) // 4, zlib.crc32(data), len(whole), data), strict=False):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), *([pa.array(cols[5], pa.binary())] if with_ids else [])], names=names)

    return run


def pack(
    df: DataFrame, vocabulary: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", drops_space: bool = True, end_id: int = 1, with_ids: bool = False
) -> DataFrame:
    """A row per window: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids: and ids (binary, u32)."""
    spark = df.sparkSession
    arrow_batches(spark)
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    cut = df.select(whole_id(df, id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_windows(vocabulary, drops_space, end_id, capacity, with_ids), schema)
    windows = written(cut.withColumn("uid", F.monotonically_increasing_id()), "windows")
    counts = {r["length"]: r["n"] for r in windows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    salts = pow2(sum(counts.values()) / 100_000, 64)
    salt = F.pmod(F.xxhash64(F.coalesce("id", "uid"), "start"), F.lit(salts))
    salted = windows.withColumn("salt", salt)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)  # over salts
    firsts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "start", "uid")) - 1
    ranked = salted.withColumn("place", place).join(small_side(written(firsts, "firsts")), ["length", "salt"]).withColumn("rank", F.col("first") + F.col("place"))

    full = counts.pop(capacity, 0)
    runs, used, sequence = [(capacity, 0, full, 0, 1, 0)], dict.fromkeys(counts, 0), full
    for take, times in plan(counts, capacity):
        offset = 0
        for n, k in sorted(take.items(), reverse=True):
            runs.append((n, used[n], used[n] + k * times, sequence, k, offset))
            used[n] += k * times
            offset += n * k
        sequence += times
    # A pattern uses up at least one length or leaves fewer of it than it takes, so the runs' number depends on the capacity alone.
    table = F.broadcast(spark.createDataFrame(runs, "run_length long, a long, b long, sequence long, k long, base long"))
    hit = (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("a")) & (F.col("rank") < F.col("b"))
    at = F.col("rank") - F.col("a")
    return ranked.join(table, hit).select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence") + F.expr("(rank - a) div k")).alias("sequence_id"), (F.col("base") + F.pmod(at, F.col("k")) * F.col("length")).alias("offset"), *(["ids"] if with_ids else [])
    )
