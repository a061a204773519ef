"""Contracts held against the libraries themselves, and cases that once failed."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from webloom.llm import mixing, near_dedup, packing, passages, quality, token_files
from webloom.llm.encoding import Encoder, vocabulary_path

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
ODD = ["", "before <|endoftext|> after", "<|startoftext|>x<|endoftext|>", "<|ENDOFTEXT|>", "a  b\n\n c's DON'T", "x\x1cy\xa0z", "日本語 text", "ΑΣ ΣΑΣ", "12 345 a1b2!?", " <|endoftext|>"]


@pytest.mark.parametrize(("name", "drops"), [(BYTE, False), (WORD, True)])
def test_ids_are_the_librarys(name, drops):
    plain = Tokenizer.from_file(vocabulary_path(name))
    assert [x.tolist() for x in Encoder(vocabulary_path(name), drops).encode(ODD)] == [plain.encode(t, add_special_tokens=False).ids for t in ODD]


def _odd(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50, None), (None, "no id"), (None, "no id"), (3, "again"), (60, "long words here " * 9000)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_files_hold_the_librarys_ids(spark):
    rows, table = _odd(spark)
    plain = Tokenizer.from_file(vocabulary_path(BYTE))
    ids = lambda t: np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
    got = token_files.round_trip(table, vocabulary_path(BYTE)).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(ids(t)), zlib.crc32(ids(t).tobytes())) for i, t in rows)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0, *(r.n_tokens for r in ordered)])[:-1].tolist()


def test_pieces_hold_the_librarys_ids(spark):
    rows, table = _odd(spark)
    plain = Tokenizer.from_file(vocabulary_path(WORD))
    ids = lambda t: np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
    got = packing.pack(table, vocabulary_path(WORD), with_ids=True).collect()
    want = Counter()
    for i, t in rows:
        whole = ids(t)
        want.update((i, a, whole[a : a + 2048].tobytes(), len(whole)) for a in range(0, len(whole), 2048))
    assert Counter((r.doc_id, r.start, bytes(r.ids), r.doc_tokens) for r in got) == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in got)


def test_ids_must_be_whole_numbers(spark):
    table = spark.createDataFrame([("a", "x", "s")], "doc_id string, text string, source string")
    for f in (lambda: packing.pack(table, vocabulary_path(WORD)), lambda: token_files.round_trip(table, vocabulary_path(BYTE)), lambda: mixing.mix_documents(table)):
        with pytest.raises(TypeError):
            f()


def test_mixing_of_equal_ids(spark):
    """A third of all rows has no id and one size; each of them is a document, and they do not exceed twice their size."""
    rows = [(None, "w w w", "a") for _ in range(25_000)] + [(i, "w " * (1 + i % 40), "ab"[i % 2]) for i in range(50_000)] + [(7, "w w", "a")] * 11
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_documents(table).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(t.split())) for i, t, _ in rows)
    assert all(0 <= r.taken <= 2 * r.size and r.taken % r.size == 0 for r in got)
    taken = defaultdict(int)
    for r in got:
        taken[r.target] += r.taken
    assert all(abs(t - target) <= 40 for target, t in taken.items())
    copies = Counter()
    for r in got:
        copies[r.doc_id, r.size] += r.taken // r.size
    mixed = mixing.mixed_rows(table)
    assert mixed.columns == table.columns
    assert Counter({(r.doc_id, r.size): r.n for r in mixed.groupBy("doc_id", F.size(F.split(F.trim("text"), " ")).alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()}) == +copies


@pytest.mark.parametrize("n", range(7))
def test_texts_of_few_words(spark, n):
    table = spark.createDataFrame([(1, " ".join("abcdefg"[:n]))], "doc_id long, text string").coalesce(1)
    assert [r.class_id for r in near_dedup.near_dedup(table).collect()] == [1]
    assert passages.passages(table).count() == 0


def test_consistency_factors():
    """What is left of the variance where normal data are cut at the quantiles, by sampling."""
    x = np.random.default_rng(8).normal(size=(400_000, 4))
    d = (x * x).sum(axis=1)
    for cut, share, left in ((quality.CHI_HALF, quality.HALF, quality.SHRINK_HALF), (quality.CHI_WEIGHT, 0.975, quality.SHRINK_WEIGHT)):
        assert abs((d <= cut).mean() - share) < 0.003 and abs(x[d <= cut].var() - left) < 0.005


def test_near_dedup_against_all_pairs(spark):
    """Every two documents of the smallest table whose weighted similarity is 0.8 or more are in one class, and classes have no others."""
    import pyarrow as pa

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    idf = type("Idf", (), {"value": near_dedup.idf_table(table.select("text"), len(rows))})
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array([t for _, t in rows], pa.string())], names=["uid", "text"])
    vector = next(near_dedup._vectors(idf)(iter([batch]))).column(1).to_pylist()
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if vector[i] and vector[j] and near_dedup.weighted_jaccard(vector[i], vector[j]) >= near_dedup.THRESHOLD:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(table).collect()}
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    least = {}
    for i in order:
        least.setdefault(find(i), rows[i][0])
    assert got == {rows[i][0]: least[find(i)] for i in range(len(rows))}
