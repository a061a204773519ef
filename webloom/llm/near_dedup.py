"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles of five words.

A shingle weighs tf * idf. idf falls from 1 + DAMP, for shingles in at most RARE of the documents, to 1 for one that all
have: 1 + DAMP * ln(1 / max(p, RARE)) / ln(1 / RARE), where p is the share of documents that have it. The counts are taken over all documents
in a table of CELLS hashed counters. Other shingles of a cell add (shingles per document) / CELLS to p, whatever the corpus' size,
so the table stays as true and as small as the corpus grows. The damping keeps one edit in a large group of copies from
outweighing all that the copies share.

Each document gets BANDS * ROWS samples. Documents that share a band meet in a bucket. A bucket is no pairs' product: first the one
document that shares most with others is held against the rest. What it does not link is compared with all of the bucket, linked or not, in
blocks of bounded size: samples rule out pairs that are far off, pairs that links already join are passed over, and the others' weighted Jaccard similarity is
computed from their whole texts. Links of at least the threshold make classes by connected components.

Equal texts (in all their words) are collapsed before and expanded after. Null texts and texts without words are classes of their own. Texts
with one to four words have one shingle. Rows with equal ids are separate documents. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import arrow_batches, blocks, runs, small_side, written
from webloom.llm.graph import components
from webloom.llm.shingles import groups, mix

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 12, 4
#: Counters of the document frequencies; the share of documents up to which a shingle is rare.
CELLS, RARE = 1 << 20, 0.002
DAMP = 0.25
#: Samples of BANDS * ROWS that a pair must share to be verified: at a similarity of 0.8, 38.4 are shared on average, fewer than 27 once in 10,000.
SHARED = 27

_U = np.uint64


def _unique(words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index, hash and count of the distinct shingles of each text, by text and hash."""
    h, ok = words.shingles(k)
    doc, h = words.doc[ok], h[ok]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, int)
    return doc[first], h[first], np.diff(np.r_[first, len(h)])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counters, block = np.zeros(CELLS, np.int64), 1 << 14
    for batch in batches:
        for _, words in groups(batch.column(0)):
            _, h, _ = _unique(words, SHINGLE)
            counters += np.bincount((h >> _U(44)).astype(np.int64), minlength=CELLS)
    for b in range(0, CELLS, block):
        at = np.flatnonzero(part := counters[b : b + block])
        if len(at):  # only the counters that count
            yield pa.RecordBatch.from_arrays([pa.array([b // block]), pa.array([at.astype("<u2").tobytes()]), pa.array([part[at].astype("<u4").tobytes()])], names=["block", "at", "n"])


def _add(pdf):
    import pandas as pd

    total = np.zeros(1 << 14, np.int64)
    for at, n in zip(pdf["at"], pdf["n"], strict=True):
        total[np.frombuffer(at, "<u2")] += np.frombuffer(n, "<u4")
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "total": [total.astype("<i8").tobytes()]})


def idf_table(texts: DataFrame, docs: int) -> np.ndarray:
    """idf of each cell, as float32; CELLS numbers, whatever the corpus."""
    blocks = written(texts.mapInArrow(_frequencies, "block long, at binary, n binary").groupBy("block").applyInPandas(_add, "block long, total binary"), "frequencies")
    counts = np.zeros(CELLS, np.int64)
    for r in blocks.toLocalIterator():
        counts[r["block"] << 14 : (r["block"] + 1) << 14] = np.frombuffer(r["total"], "<i8")
    p = np.maximum(counts / max(docs, 1), RARE)
    return (1 + DAMP * np.log(1 / np.minimum(p, 1)) / np.log(1 / RARE)).astype(np.float32)


_SEEDS = mix(np.arange(1, 3 * BANDS * ROWS + 1, dtype=np.uint64) * _U(0xD1342543DE82EF95))


def icws(doc: np.ndarray, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents that have shingles, and for each BANDS * ROWS samples, as 32-bit hashes of the sampled shingle and its level."""
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    logw, index = np.log(w), np.arange(len(h), dtype=np.uint64)
    out = np.empty((len(first), BANDS * ROWS), np.uint32)
    scale, low = np.float32(2.0**-32), _U(0xFFFFFFFF)
    for k in range(BANDS * ROWS):
        z = (h ^ _SEEDS[3 * k]) * _U(0xBF58476D1CE4E5B9)
        z ^= z >> _U(29)
        z *= _U(0x94D049BB133111EB)
        y = (z ^ (z >> _U(32))) * _U(0x9E3779B97F4A7C15)
        y ^= y >> _U(29)
        u = [((x.astype(np.float32)) + np.float32(0.5)) * scale for x in (z >> _U(32), z & low, y >> _U(32), y & low)]
        beta = ((z ^ y) * _U(0xD6E8FEB86659FD93) >> _U(40)).astype(np.float32) * np.float32(2.0**-24)
        r, logc = -np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3]))
        r = np.maximum(r, np.float32(1e-9))
        t = np.floor(logw / r + beta)
        a = (logc - r * (t - beta + 1)).view(np.uint32)
        a = np.where(a >> 31, ~a, a | np.uint32(1 << 31))  # in the order of the floats
        best = (np.minimum.reduceat((a.astype(np.uint64) << _U(32)) | index, first) & low).astype(np.int64)
        out[:, k] = (mix(h[best] ^ t[best].astype(np.int64).astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F)) >> _U(32)).astype(np.uint32)
    return doc[first], out


def _sign(idf_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = idf_of.value
        lane = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in batches:
            rows, sigs, keys = [], [], []
            text = np.zeros((batch.num_rows, 2), np.uint64)
            for a, words in groups(batch.column(batch.num_columns - 1)):
                n = len(words.first) - 1
                place = (np.arange(len(words.hash)) - words.first[:-1][words.doc]).astype(np.uint64)
                for s in (0, 1):  # 128 bits of all words in their order
                    x = mix(words.hash + mix(place * _U(2) + _U(s)) * _U(0x9E3779B97F4A7C15))
                    sums = np.r_[_U(0), np.cumsum(x)]
                    text[a : a + n, s] = sums[words.first[1:]] - sums[words.first[:-1]]
                doc, h, tf = _unique(words, SHINGLE)
                if len(doc):
                    with_any, sig = icws(doc, h, (tf * idf[(h >> _U(44)).astype(np.int64)]).astype(np.float32))
                    key = np.zeros((len(sig), BANDS), np.uint64) + lane
                    for i in range(ROWS):
                        key = mix(key + sig.reshape(-1, BANDS, ROWS)[:, :, i].astype(np.uint64) * _U(0xA24BAED4963EE407))
                    rows.append(with_any + a)
                    sigs.append(sig)
                    keys.append(key)
            sig, bands = [None] * batch.num_rows, [None] * batch.num_rows
            for r, s, k in zip(rows, sigs, keys, strict=True):
                for i, row in enumerate(r):
                    sig[row], bands[row] = s[i].tobytes(), k[i].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(text[:, 0].view(np.int64)), pa.array(text[:, 1].view(np.int64)), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=[*batch.schema.names[:-1], "t1", "t2", "sig", "bands"],
            )

    return run


def _vectors(idf_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = idf_of.value
        for batch in batches:
            out: list = [b""] * batch.num_rows
            for a, words in groups(batch.column(1)):
                doc, h, tf = _unique(words, SHINGLE)
                w = (tf * idf[(h >> _U(44)).astype(np.int64)]).astype("<f4")
                cuts = np.searchsorted(doc, np.arange(len(words.first)))
                for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    out[a + i] = (h[x:y] >> _U(32)).astype("<u4").tobytes() + w[x:y].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["uid", "vector"])

    return run


def weighted_jaccard(a: bytes, b: bytes) -> float:
    """Of two vectors: 32-bit shingle hashes, ascending, then float32 weights."""
    x, y = (np.frombuffer(v, "<u4", len(v) // 8) for v in (a, b))
    wx, wy = (np.frombuffer(v, "<f4", len(v) // 8, len(v) // 2).astype(np.float64) for v in (a, b))
    if not len(x) or not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    hit = y[at] == x
    least = np.minimum(wx[hit], wy[at[hit]]).sum()
    return float(least / (wx.sum() + wy.sum() - least))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        s = [weighted_jaccard(x.as_py(), y.as_py()) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(s, pa.float64())], names=["leader", "uid", "similarity"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (np.frombuffer(b"".join(c.to_pylist()), "<u4").reshape(-1, BANDS * ROWS) for c in batch.columns[2:4])
        yield batch.select([0, 1]).filter(pa.array((x == y).sum(axis=1) >= SHARED))


def _block_links(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 3):
            lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
            band, part, uid, label = (t[c].to_numpy() for c in ("band", "part", "uid", "label"))
            if len(uid) < 2:
                continue
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), "<u4").reshape(len(uid), -1)
            vector, root = t["vector"].to_pylist(), {}

            def find(x: int) -> int:
                while root.get(x, x) != x:
                    root[x] = x = root.get(root[x], root[x])
                return x

            links = []
            for i in np.flatnonzero(part == lo):
                others = np.flatnonzero(part == hi) if lo < hi else np.arange(i + 1, len(uid))
                others = others[label[others] != label[i]]
                same = sig[others] == sig[i]
                # a pair is compared in the first band that it shares: of two labels, one is not the leader's in any of its buckets
                ok = (same.sum(axis=1) >= SHARED) & ~same.reshape(len(same), BANDS, ROWS)[:, : band[i]].all(axis=2).any(axis=1)
                for j in others[ok]:
                    x, y = find(int(label[i])), find(int(label[j]))
                    if x != y and weighted_jaccard(vector[i], vector[j]) >= threshold:
                        root[max(x, y)] = min(x, y)
                        links.append((int(uid[i]), int(uid[j])))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _linked(reps: DataFrame, vectors, threshold: float) -> DataFrame:
    """(a, b): links among reps (uid, sig, bands) that connect all that are near; see the module's text."""
    rows = reps.select("uid", F.posexplode("bands").alias("band", "key"))
    rows = written(rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key"), "buckets")
    score = rows.groupBy("uid").agg(F.sum("n").alias("score"))
    rows = rows.join(score, "uid")
    # The leader has the largest buckets over all bands: of copies with edits of their own, the one they come from.
    leaders = rows.groupBy("key").agg(F.min(F.struct(-F.col("score"), "uid"))["uid"].alias("leader"))
    met = written(rows.join(leaders, "key").where("uid <> leader").select("leader", "uid", "key", "band"), "met")
    sigs = reps.select("uid", "sig")
    table = written(vectors(met.select("uid").unionByName(met.select(F.col("leader").alias("uid"))).distinct()), "vectors")
    both = met.select("leader", "uid").distinct().join(sigs.withColumnsRenamed({"uid": "leader", "sig": "s1"}), "leader").join(sigs.withColumnRenamed("sig", "s2"), "uid").select("leader", "uid", "s1", "s2")
    near = written(both.mapInArrow(_alike, "leader long, uid long"), "near")
    both = near.join(table.withColumnsRenamed({"uid": "leader", "vector": "v1"}), "leader").join(table.withColumnRenamed("vector", "v2"), "uid").select("leader", "uid", "v1", "v2")
    first = written(both.mapInArrow(_verify, "leader long, uid long, similarity double").where(F.col("similarity") >= threshold).select("leader", "uid"), "first")
    links = first.select(F.col("leader").alias("a"), F.col("uid").alias("b"))
    labels = written(components(links), "labels")
    # All rows of a bucket, for a row that the leader does not link may be near one that it does. Rows of the leader's own class are not held against each other.
    rest = met.join(labels.select(F.col("v").alias("uid"), F.col("root").alias("r1")), "uid", "left").join(labels.select(F.col("v").alias("leader"), F.col("root").alias("r2")), "leader", "left")
    rest = rest.select("key", "band", "uid", F.coalesce("r1", "uid").alias("label"), (F.coalesce("r1", "uid") == F.coalesce("r2", "leader")).alias("joined"))
    few = rest.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key")
    rest = written(rest.join(few, "key").select("key", "band", "uid", "label", "joined"), "rest")
    full = blocks(rest, joined="joined").select("key", "lo", "hi", "part", "band", "uid", "label")
    full = full.join(sigs, "uid").join(table, "uid").select("key", "lo", "hi", "part", "band", "uid", "label", "sig", "vector")
    full = full.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "uid")
    return links.unionByName(written(full.mapInArrow(_block_links(threshold), "a long, b long"), "second")).distinct()


def _classes(df: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """A written table: id, tx (hash of the text), uid, class (the uid that its class is named after), size, links."""
    spark = df.sparkSession
    arrow_batches(spark)
    plain = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tx"), F.col(text_col).alias("text"))
    idf = spark.sparkContext.broadcast(idf_table(plain.select("text"), plain.count()))
    schema = f"id {dict(plain.dtypes)['id']}, tx long, t1 long, t2 long, sig binary, bands array<long>"
    signed = written(plain.mapInArrow(_sign(idf), schema).withColumn("uid", F.monotonically_increasing_id()), "signed")
    some = signed.where("sig is not null")
    # The row that names a text, with an id as small as any: ranks follow ids, then rows.
    first = written(some.groupBy("t1", "t2").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("f"), F.count(F.lit(1)).alias("copies")), "texts")
    reps = written(signed.join(first.select(F.col("f.uid").alias("uid")), "uid", "left_semi").select("uid", "id", "tx", "sig", "bands"), "reps")

    def vectors(uids: DataFrame) -> DataFrame:
        chosen = reps.join(uids, "uid", "left_semi").select("id", "tx", "uid")
        key = plain.withColumnsRenamed({"id": "__id", "tx": "__tx"})
        texts = key.join(small_side(chosen), F.col("__id").eqNullSafe(F.col("id")) & (F.col("__tx") == F.col("tx"))).select("uid", "text")
        return texts.mapInArrow(_vectors(idf), "uid long, vector binary").dropDuplicates(["uid"])

    links = written(_linked(reps, vectors, threshold), "links")
    of = components(links)
    degree = links.select(F.col("a").alias("v")).unionAll(links.select(F.col("b").alias("v"))).groupBy("v").agg(F.count(F.lit(1)).alias("links"))
    named = first.select("t1", "t2", "copies", F.col("f").alias("f"), F.col("f.uid").alias("v")).join(of, "v", "left").join(degree, "v", "left")
    named = named.select("t1", "t2", "copies", "f", F.coalesce("root", "v").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    heads = named.groupBy("root").agg(F.min("f").alias("head"), F.sum("copies").alias("size"))
    named = written(named.join(heads, "root").select("t1", "t2", "links", "head", "size"), "named")
    grouped = some.join(named, ["t1", "t2"]).select("id", "tx", "uid", F.col("head.uid").alias("head_uid"), F.col("head.id").alias("class_id"), "size", "links")
    alone = signed.where("sig is null").select("id", "tx", "uid", F.col("uid").alias("head_uid"), F.col("id").alias("class_id"), F.lit(1).cast("long").alias("size"), F.lit(0).cast("long").alias("links"))
    return written(grouped.unionByName(alone), "classes")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row per document: id_col, class_id (the smallest id of its class), class_size, links (that its text's first row has), kept."""
    got = _classes(df, id_col, text_col, threshold)
    return got.select(F.col("id").alias(id_col), "class_id", F.col("size").alias("class_size"), "links", (F.col("uid") == F.col("head_uid")).alias("kept"))


def kept_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df, one of each class: the one with the smallest id."""
    got = _classes(df, id_col, text_col, threshold)
    heads = got.where("uid = head_uid")
    gone = got.where("uid <> head_uid").select("id", "tx").distinct()
    packed = df.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__tx"), F.struct("*").alias("__row"))
    hit = lambda t: F.col("__id").eqNullSafe(t["id"]) & (F.col("__tx") == t["tx"])
    twice = written(gone.join(heads.select(F.col("id").alias("i"), F.col("tx").alias("t")), F.col("id").eqNullSafe(F.col("i")) & (F.col("tx") == F.col("t")), "left_semi"), "twice")
    drop = small_side(written(gone, "gone"))
    out = packed.join(drop, hit(drop), "left_anti").select("__row.*")
    if not twice.isEmpty():  # a kept row that is repeated in id and text: one of them stays
        again = small_side(twice)
        out = out.unionByName(packed.join(again, hit(again), "left_semi").dropDuplicates(["__id", "__tx"]).select("__row.*"))
    return out
