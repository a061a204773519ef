"""Exact deduplication with counting quotient filters.

A 64-bit fingerprint (the head of SHA-256) is taken of each text without white space. Every input partition builds a counting
quotient filter of its fingerprints, cut into shards by their high bits. The filters of one shard meet in one task and merge
losslessly, as the sorted remainders of their runs. Only fingerprints counted more than once have their rows' texts compared,
byte by byte, through an aggregation on the text itself (combined before the shuffle, so a group of copies is one row per task).

Null texts count as empty. Null ids are allowed and lose ties. Rows that are repeated in every column are copies like others:
exactly one of them is kept. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import WHITE, arrow_batches, pow2, small_side, written

_DROP = WHITE.encode()


class CountingQuotientFilter:
    """Counts of p-bit fingerprints. The high q bits (quotient) name a home slot; slots hold the remainders, sorted in each run.

    Laid out by Robin Hood hashing: a remainder lies at its home slot or right of it, runs keep the order of their quotients.
    occupied: has a bit for each quotient with a run; runend: marks the last slot of each run; counts lie beside remainders.
    The fingerprints are recovered exactly, so that filters merge without loss.
    """

    def __init__(self, p: int, q: int, occupied: np.ndarray, used: np.ndarray, runend: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.p, self.q = p, q
        self.occupied, self.used, self.runend, self.remainders, self.counts = occupied, used, runend, remainders, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray, p: int, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        if counts is None:
            fps, counts = np.unique(fingerprints.astype(np.uint64), return_counts=True)
        else:
            order = np.argsort(fingerprints, kind="stable")
            sorted_fps = fingerprints[order].astype(np.uint64)
            first = np.flatnonzero(np.r_[True, sorted_fps[1:] != sorted_fps[:-1]]) if len(sorted_fps) else np.zeros(0, int)
            fps, counts = sorted_fps[first], np.add.reduceat(counts[order], first) if len(first) else counts
        q = min(p, max(1, int(np.ceil(np.log2(max(1, len(fps)) / 0.75)))))
        r = np.uint64(p - q)
        quotient = (fps >> r).astype(np.int64) if p > q else fps.astype(np.int64)
        remainder = fps & ((np.uint64(1) << r) - np.uint64(1)) if p > q else np.zeros(len(fps), np.uint64)
        i = np.arange(len(fps))
        slot = np.maximum.accumulate(quotient - i) + i if len(fps) else i
        size = int(max(1 << q, slot[-1] + 1 if len(fps) else 0))
        occupied, used, runend = (np.zeros(n, bool) for n in (1 << q, size, size))
        occupied[quotient], used[slot] = True, True
        if len(fps):
            runend[slot[np.r_[quotient[1:] != quotient[:-1], True]]] = True
        return cls(p, q, occupied, used, runend, remainder, counts.astype(np.int64))

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints, ascending, and their counts, from the runs."""
        ends = np.flatnonzero(self.runend[self.used])
        quotients = np.repeat(np.flatnonzero(self.occupied), np.diff(np.r_[-1, ends]))
        r = np.uint64(self.p - self.q)
        fps = (quotients.astype(np.uint64) << r) | self.remainders if self.p > self.q else quotients.astype(np.uint64)
        return fps, self.counts

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """One filter with the summed counts; it has more quotient bits where it needs them."""
        items = [f.items() for f in filters]
        return cls.build(np.concatenate([x[0] for x in items]), filters[0].p, np.concatenate([x[1] for x in items]))

    def to_bytes(self) -> bytes:
        head = struct.pack("<BBQQ", self.p, self.q, len(self.used), len(self.remainders))
        bits = b"".join(np.packbits(b).tobytes() for b in (self.occupied, self.used, self.runend))
        small = np.minimum(self.counts, 255).astype(np.uint8)
        return head + bits + self.remainders.astype("<u8").tobytes() + small.tobytes() + self.counts[small == 255].astype("<i8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        p, q, size, n = struct.unpack_from("<BBQQ", data)
        at, bits = 18, []
        for length in (1 << q, size, size):
            k = (length + 7) // 8
            bits.append(np.unpackbits(np.frombuffer(data, np.uint8, k, at), count=length).astype(bool))
            at += k
        remainders = np.frombuffer(data, "<u8", n, at).astype(np.uint64)
        counts = np.frombuffer(data, np.uint8, n, at + 8 * n).astype(np.int64)
        counts[counts == 255] = np.frombuffer(data, "<i8", -1, at + 9 * n)
        return cls(p, q, *bits, remainders, counts)


def _digests(text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha, fp = [], np.empty(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column(text_at).cast(pa.binary())):
                digest = hashlib.sha256((text.as_py() or b"").translate(None, _DROP))
                sha.append(digest.hexdigest())
                fp[i] = int.from_bytes(digest.digest()[:8], "big", signed=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sha, pa.string()), pa.array(fp)], names=[*batch.schema.names, "__sha", "__fp"])

    return run


def digests(df: DataFrame, text: str) -> DataFrame:
    """df with __sha (SHA-256 of the text without white space, in hex) and __fp (its first 64 bits)."""
    schema = T.StructType([*df.schema.fields, T.StructField("__sha", T.StringType()), T.StructField("__fp", T.LongType())])
    return df.mapInArrow(_digests(df.columns.index(text)), schema)


#: Fingerprints a task gathers before it lets a filter go, and that a shard may hold when merged.
PER_FILTER = 1 << 20


def _build(shard_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            fps = np.sort(np.concatenate(held).view(np.uint64))
            p = 64 - shard_bits
            shards = (fps >> np.uint64(p)).astype(np.int64)
            low = fps & ((np.uint64(1) << np.uint64(p)) - np.uint64(1))
            cuts = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1], True])
            rows = [(int(shards[a]), CountingQuotientFilter.build(low[a:b], p).to_bytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.binary())], names=["shard", "filter"])

        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            n += batch.num_rows
            if n >= PER_FILTER:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    return run


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    merged = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(x) for x in pdf["filter"]])
    fps, counts = merged.items()
    fps = fps[counts > 1] | (np.uint64(pdf["shard"].iloc[0]) << np.uint64(merged.p))
    return pd.DataFrame({"fp": fps.view(np.int64), "n": counts[counts > 1]})


def repeated_fingerprints(fps: DataFrame, rows: int) -> DataFrame:
    """(fp, n) of the fingerprints that more than one row has. fps: one column of longs."""
    shard_bits = pow2(rows / PER_FILTER, 64).bit_length() - 1
    built = fps.mapInArrow(_build(shard_bits), "shard long, filter binary")
    return built.groupBy("shard").applyInPandas(_merge, "fp long, n long")


def _classes(candidates: DataFrame, id_col: str) -> DataFrame:
    """A row for each text: the row that stays and the number of rows. Compares whole texts."""
    best = F.min(F.struct((-F.col("__len")).alias("l"), F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("__uid").alias("uid")))
    return candidates.groupBy("__sha", "__norm").agg(best.alias("__best"), F.count(F.lit(1)).alias("__size"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: bool = False) -> DataFrame:
    """One row per row of df: id_col, keep_id, group_size, kept, text_sha256. With rows: the kept rows of df, as they were.

    Texts are equal if they are identical without white space. The one with the most code points stays, then the smallest id.
    """
    spark = df.sparkSession
    arrow_batches(spark)
    plain = df.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"), *([F.struct("*").alias("__row")] if rows else []))
    digest = written(digests(plain.select("__id", F.length("__text").alias("__len"), "__text"), "__text").drop("__text"), "digests")
    repeated = written(repeated_fingerprints(digest.select("__fp"), digest.count()), "repeated")
    few = small_side(repeated.select(F.col("fp").alias("__fp")))
    hashed = digests(plain, "__text")
    candidates = written(
        hashed.join(few, "__fp", "left_semi").select("__id", "__sha", F.length("__text").alias("__len"), F.translate("__text", WHITE, "").alias("__norm"), F.monotonically_increasing_id().alias("__uid"), *(["__row"] if rows else [])),
        "candidates",
    )
    classes = written(_classes(candidates, "__id"), "classes")  # written, so that the join's own exchanges can be split by AQE
    if rows:
        stay = classes.select(F.col("__best.uid").alias("__uid"))
        unique = hashed.join(few, "__fp", "left_anti").select("__row")
        return unique.unionByName(candidates.join(stay, "__uid", "left_semi").select("__row")).select("__row.*")
    verified = candidates.join(classes, ["__sha", "__norm"]).select(
        F.col("__id").alias(id_col),
        F.col("__best.id").alias("keep_id"),
        F.col("__size").alias("group_size"),
        (F.col("__best.uid") == F.col("__uid")).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )
    alone = digest.join(few, "__fp", "left_anti").select(
        F.col("__id").alias(id_col), F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("__sha").alias("text_sha256")
    )
    return alone.unionByName(verified)
