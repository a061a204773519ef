"""Token files: ids in the minimum bits of the vocabulary, bit-packed, with block offsets for random access.

A file is, in little-endian order: magic WLTF, version, bits, ids per block (u32 each), documents, ids, blocks (u64 each); then the
documents' ids (i64), a byte each that is 1 where that id is null, the documents' first ids and the end (u64, documents + 1), the
blocks' byte offsets from the payload's start and the end (u64, blocks + 1); then the payload. Each block packs its ids low bit
first and ends at a whole byte, so any run of ids is read from its own blocks alone.

Documents lie in ascending order of their ids, null first, over the files in the order of their names; equal ids by their texts.
A null or empty text has the end id only. An empty table gives no files. Files are written under another name and then moved, and
a task that runs again writes the same files.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.llm.common import arrow_batches, shared_dir, small_side, whole_id, written
from webloom.llm.encoding import encoder

_HEAD = struct.Struct("<4sIIIQQQ")
#: Ids in a block, and in a file at most (but for a longer document).
BLOCK, FILE_IDS = 4096, 1 << 21
#: Ids that a reader unpacks at a time.
READ_IDS = 1 << 20


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    lanes = ((ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(lanes.reshape(-1), bitorder="little").tobytes()


def unpack_bits(data: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    lanes = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (lanes.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def file_bytes(doc_ids: list[int | None], ids: list[np.ndarray], bits: int, block: int = BLOCK) -> bytes:
    lengths = np.array([len(x) for x in ids], np.uint64)
    all_ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    packed = [pack_bits(all_ids[i : i + block], bits) for i in range(0, len(all_ids), block)]
    out = io.BytesIO()
    out.write(_HEAD.pack(b"WLTF", 1, bits, block, len(ids), len(all_ids), len(packed)))
    out.write(np.array([x or 0 for x in doc_ids], "<i8").tobytes())
    out.write(bytes(x is None for x in doc_ids))
    out.write(np.r_[np.uint64(0), np.cumsum(lengths)].astype("<u8").tobytes())
    out.write(np.cumsum([0, *map(len, packed)]).astype("<u8").tobytes())
    for p in packed:
        out.write(p)
    return out.getvalue()


class TokenFile:
    """Reads a token file, given as bytes or as an open file; document(i) and slice(a, b) read only the blocks they need."""

    def __init__(self, source: bytes | BinaryIO):
        self.source = io.BytesIO(source) if isinstance(source, bytes) else source
        magic, _, self.bits, self.block, docs, self.ids, blocks = _HEAD.unpack(self._at(0, _HEAD.size))
        if magic != b"WLTF":
            raise ValueError("not a token file")
        index = self._at(_HEAD.size, 17 * docs + 8 * blocks + 16)
        none = np.frombuffer(index, np.uint8, docs, 8 * docs)
        self.doc_ids = [None if n else int(x) for x, n in zip(np.frombuffer(index, "<i8", docs), none, strict=True)]
        self.starts = np.frombuffer(index, "<u8", docs + 1, 9 * docs).astype(np.int64)
        self.offsets = np.frombuffer(index, "<u8", blocks + 1, 17 * docs + 8).astype(np.int64) + _HEAD.size + len(index)

    def _at(self, start: int, n: int) -> bytes:
        self.source.seek(start)
        return self.source.read(n)

    def slice(self, a: int, b: int) -> np.ndarray:
        first, last = a // self.block, -(-b // self.block)
        if first >= last:
            return np.zeros(0, np.uint32)
        edges = self.offsets[first : last + 1]
        data = memoryview(self._at(int(edges[0]), int(edges[-1] - edges[0])))
        whole = np.concatenate([unpack_bits(data[edges[k - first] - edges[0] : edges[k + 1 - first] - edges[0]], self.bits, min(self.block, self.ids - k * self.block)) for k in range(first, last)])
        return whole[a - first * self.block : b - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.slice(int(self.starts[i]), int(self.starts[i + 1]))


def _write(path: str, vocabulary: str, drops_space: bool, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc = TaskContext.get().partitionId(), encoder(vocabulary, drops_space)
        bits = max(1, (enc.size - 1).bit_length())
        fs, root = pa.fs.FileSystem.from_uri(path)

        def flush(k: int, docs: list, ids: list[np.ndarray]) -> pa.RecordBatch:
            name, own = f"part-{part:06d}-{k:05d}.wltf", f"_{uuid.uuid4().hex}"
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(f"{root}/{own}") as f:
                f.write(file_bytes(docs, ids, bits))
            fs.move(f"{root}/{own}", f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(ids)], pa.int64()), pa.array([sum(map(len, ids))], pa.int64())], names=["file", "docs", "ids"])

        docs, ids, n, k, end = [], [], 0, 0, np.array([end_id], np.uint32)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for doc, got in zip(batch.column(0).to_pylist(), enc.encode(texts), strict=True):
                docs.append(doc)
                ids.append(np.concatenate([got, end]))
                n += len(ids[-1])
                if n >= FILE_IDS:
                    yield flush(k, docs, ids)
                    docs, ids, n, k = [], [], 0, k + 1
        if docs:
            yield flush(k, docs, ids)

    return run


def write_token_files(df: DataFrame, vocabulary: str, path: str, id_col: str = "doc_id", text_col: str = "text", drops_space: bool = False, end_id: int = 0) -> DataFrame:
    """Writes the files under path and returns their manifest: file, docs, ids (a written table)."""
    arrow_batches(df.sparkSession)
    rows = df.select(whole_id(df, id_col).alias("id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"), "text")
    return written(ordered.mapInArrow(_write(path, vocabulary, drops_space, end_id), "file string, docs long, ids long"), "manifest")


def _read(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_file(f"{root}/{name}") as source:
                    f = TokenFile(source)
                    a, docs = 0, len(f.doc_ids)
                    while a < docs:  # about READ_IDS ids at a time, and one document at least
                        b = max(a + 1, int(np.searchsorted(f.starts, f.starts[a] + READ_IDS, side="right")) - 1)
                        ids = f.slice(int(f.starts[a]), int(f.starts[b])).astype("<u4")
                        cuts = f.starts[a : b + 1] - f.starts[a]
                        each = [ids[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                        columns = [pa.array([name] * (b - a), pa.string()), pa.array(f.doc_ids[a:b], pa.int64()), pa.array(f.starts[a:b]), pa.array(each, pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, names=["file", "id", "at", "ids"])
                        a = b

    return run


def read_token_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """file, id, at (the document's first id in its file) and ids (binary, unsigned 32-bit) of every document of the manifest's files."""
    files = manifest.select("file").repartition(max(1, min(manifest.count(), 100_000)))
    return files.mapInArrow(_read(path), "file string, id long, at long, ids binary")


def round_trip(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", drops_space: bool = False, end_id: int = 0) -> DataFrame:
    """Writes df as token files into the shared folder and reads them back: id_col, start, n_tokens, ids_crc32."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/webloom-tokens/{uuid.uuid4().hex}"
    manifest = write_token_files(df, vocabulary, path, id_col, text_col, drops_space, end_id)
    if manifest.isEmpty():
        return spark.createDataFrame([], f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")
    # The ids before a file: those of the parts before its own (one row for each task that wrote), and of its part's files before it.
    part = manifest.withColumn("part", F.substring("file", 1, 11))
    earlier = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = part.groupBy("part").agg(F.sum("ids").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("of_parts"))
    own = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    firsts = part.withColumn("own", F.coalesce(F.sum("ids").over(own), F.lit(0))).join(parts, "part").select("file", (F.col("of_parts") + F.col("own")).alias("first"))
    firsts = small_side(written(firsts, "firsts"))
    return read_token_files(spark, path, manifest).join(firsts, "file").select(
        F.col("id").alias(id_col), (F.col("first") + F.col("at")).alias("start"), F.expr("length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
