"""Operators for corpora: brute force, round trips, properties, and nulls, empties, repeats and clashing names."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.llm import exact_dedup, line_dedup, mixing, near_dedup, packing, passages, quality, secrets, token_files
from webloom.llm.encoding import Encoder, vocabulary_path
from webloom.llm.graph import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, __id long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def docs(spark):
    """The smallest table, and odd rows: nulls, empties, repeats, ties, a very long text; columns whose names clash with the operators' own."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    long_text = " ".join(f"w{i % 977}x{i // 977}" for i in range(60_000))
    rows += [(900, None, None, None, None), (901, "", "en", "src0", 0), (902, " \n\t ", "en", "src1", 4), (903, "tie  tie", "en", "src1", 8), (904, "tie\ntie ", "en", "src1", 8)]
    rows += [(905, long_text, "en", "src2", len(long_text)), (906, "same row", None, None, 8), (906, "same row", None, None, 8), (None, "same row", "en", "src3", 8)]
    return spark.createDataFrame([(*r, True, 7) for r in rows], SCHEMA).repartition(3, "doc_id").cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.select("doc_id", "text", "source").collect()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(nothing, spark):
    for f in (quality.judged, exact_dedup.exact_dedup, line_dedup.line_dedup, near_dedup.near_dedup, passages.passages, mixing.mix_documents, secrets.scan):
        assert f(nothing).count() == 0, f
    assert token_files.round_trip(nothing, vocabulary_path("byte_bpe_50k.json")).count() == 0
    assert packing.pack(nothing, vocabulary_path("word_bpe_49k.json")).count() == 0
    assert wrapper.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_quality_counts(docs, rows):
    got = defaultdict(list)
    for r in quality.judged(docs).collect():
        got[r.doc_id].append((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed))
    for r in rows:
        w, t = words(r.text), r.text or ""
        lines = [x for x in t.split("\n") if words(x)]
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert want in got[r.doc_id], r.doc_id
    kept = quality.kept_rows(docs)
    assert kept.columns == docs.columns and 0 < kept.count() == quality.judged(docs).where("kept").count()


def test_quality_rejects_outliers(spark):
    rng = np.random.default_rng(1)
    text = lambda junk: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) + "#$%" * junk for _ in range(120))
    table = spark.createDataFrame([(i, text(i % 20 == 0), "en", "s") for i in range(300)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in quality.judged(table).collect()}
    assert all(got[i] == (i % 20 != 0) for i in got)


def test_quotient_filter():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 5000, n).astype(np.uint64) << np.uint64(40) for n in (3000, 500))
    f = exact_dedup.CountingQuotientFilter
    made = [f.from_bytes(f.build(x, 58).to_bytes()) for x in (a, b)]
    fps, counts = f.merge(made).items()
    assert dict(zip(fps.tolist(), counts.tolist(), strict=True)) == Counter([*a.tolist(), *b.tolist()])


def test_exact_dedup(docs, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append(r)
    best = {k: min(((-len(r.text or ""), r.doc_id is None, r.doc_id or 0, r.doc_id) for r in v))[3] for k, v in groups.items()}
    want = Counter((r.doc_id, best[k], len(v), hashlib.sha256(k.encode()).hexdigest()) for k, v in groups.items() for r in v)
    got = exact_dedup.exact_dedup(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.exact_dedup(docs, rows=True)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_line_links(spark):
    import random

    rng = random.Random(3)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(4, 14) if k % 2 else rng.randint(14, 60))).strip() for k in range(60)]

    def edit(s):
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(max(len(s), 1))
            s = s[:i] + rng.choice(["", rng.choice("abcde")]) + s[i + rng.randint(0, 1) :]
        return s.strip()

    def distance(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a):
            q = [i + 1]
            for j, y in enumerate(b):
                q.append(min(p[j + 1] + 1, q[-1] + 1, p[j] + (x != y)))
            p = q
        return p[-1]

    lines = [*base, *(edit(rng.choice(base)) for _ in range(200))]
    table = spark.createDataFrame([(i, "\n".join(rng.sample(lines, rng.randint(0, 6)))) for i in range(100)] + [(None, None)], "doc_id long, text string")
    h = {r.line: r.h for r in line_dedup._exploded(table, "text").select("line", "h").distinct().collect()}
    root = {x: x for x in h.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in h:
        for b in h:
            if a < b and abs(len(a) - len(b)) <= 2 and distance(a, b) <= min(2, min(len(a), len(b)) // 5):
                x, y = find(h[a]), find(h[b])
                root[max(x, y)] = min(x, y)
    got = {r.v: r.root for r in components(line_dedup.line_links(table, "text")).collect()}
    assert all(got.get(x, x) == find(x) for x in root)
    each = line_dedup.line_dedup(table).collect()
    assert len(each) == 101 and all(r.n_lines == r.n_equal + r.n_near + r.n_kept for r in each)
    assert sum(r.n_kept for r in each) == len({find(x) for x in root})


def test_line_links_are_all_links(spark, monkeypatch):
    """Lines that are all near each other have a link for each pair, whichever of them leads their entries; also where entries are large."""
    monkeypatch.setattr(line_dedup, "MANY", 2)
    lines = [f"the {a} quick brown foxes jump over {b} lazy dogs" for a in "abcd" for b in "xyz"]  # each two differ by two edits at most
    table = spark.createDataFrame([(i, x) for i, x in enumerate(lines)] + [(90, lines[0] + "\n" + lines[1]), (91, "something else altogether")], "doc_id long, text string")
    assert len({(r.a, r.b) for r in line_dedup.line_links(table, "text").collect()}) == len(lines) * (len(lines) - 1) // 2
    got = {r.doc_id: r.n_links for r in line_dedup.line_dedup(table).collect()}
    assert all(got[i] == len(lines) - 1 for i in range(len(lines))) and got[90] == 2 * (len(lines) - 1) and got[91] == 0


def test_near_dedup(docs, spark):
    rng = np.random.default_rng(4)
    base = [" ".join(f"v{x}" for x in rng.integers(0, 5000, 120)) for _ in range(20)]
    rows = [(i, b) for i, b in enumerate(base)] + [(100 + i, b.replace(b.split()[60], "edited")) for i, b in enumerate(base)] + [(200, base[0]), (201, None), (202, ""), (203, "one two")]
    got = {r.doc_id: r for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[100 + i].class_id == i and not got[100 + i].kept and got[i].kept for i in range(20))
    assert got[200].class_id == 0 and got[0].class_size == 3 and all(got[i].kept and got[i].class_size == 1 for i in (201, 202, 203))
    kept = near_dedup.kept_rows(docs)
    assert kept.columns == docs.columns and kept.count() == near_dedup.near_dedup(docs).where("kept").count()


def test_near_dedup_chains(spark):
    """A hub, edited copies of it and edited copies of those: the classes of all pairs."""
    import pyarrow as pa

    rng = np.random.default_rng(11)
    fresh = iter(range(10**6))

    def edited(text, n):
        w = text.split()
        at = int(rng.integers(0, len(w) - n))
        return " ".join([*w[:at], *(f"e{next(fresh)}" for _ in range(n)), *w[at + n :]])

    texts = []
    for g in range(6):
        hub = " ".join(f"g{g}w{x}" for x in rng.integers(0, 5000, 200))
        copies = [edited(hub, 10) for _ in range(25)]
        texts += [hub, *copies, *(edited(c, 12) for c in copies[:12])]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    idf = type("Idf", (), {"value": near_dedup.idf_table(table.select("text"), len(texts))})
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["uid", "text"])
    vector = next(near_dedup._vectors(idf)(iter([batch]))).column(1).to_pylist()
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if find(i) != find(j) and near_dedup.weighted_jaccard(vector[i], vector[j]) >= near_dedup.THRESHOLD:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(table).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_passages(docs, rows):
    where = defaultdict(set)
    for r in rows:
        w = words(r.text)
        for a in range(len(w) - 49):
            where[tuple(w[a : a + 50])].add(r.doc_id)
    want = {i for v in where.values() if len(v) > 1 for i in v}
    got = passages.passages(docs).collect()
    flagged = {r.doc_id for r in got} | {r.of_doc_id for r in got}
    assert want <= flagged
    assert all(r.n_words >= 50 and r.similarity >= 0.8 for r in got)


@pytest.mark.parametrize("bits", [3, 8, 13, 16, 17, 32])
def test_bits(bits):
    ids = np.random.default_rng(5).integers(0, 1 << bits, 10_001, dtype=np.uint64).astype(np.uint32)
    assert (token_files.unpack_bits(token_files.pack_bits(ids, bits), bits, len(ids)) == ids).all()
    f = token_files.TokenFile(token_files.file_bytes([1, None], [ids[:7000], ids[7000:]], bits))
    assert (f.document(1) == ids[7000:]).all() and (f.slice(4090, 4100) == ids[4090:4100]).all() and f.doc_ids == [1, None]


def test_token_files(docs, rows):
    enc = Encoder(vocabulary_path("byte_bpe_50k.json"), False)
    ids = {(r.doc_id, r.text): np.array([*enc.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4") for r in rows}
    got = token_files.round_trip(docs, vocabulary_path("byte_bpe_50k.json")).orderBy("start").collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((r.doc_id, len(ids[r.doc_id, r.text]), zlib.crc32(ids[r.doc_id, r.text].tobytes())) for r in rows)
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order) and [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()


def test_encoder_equals_library():
    texts = ["", " lead", "tail ", "a  b\n\n c's DON'T", "x\x1cy\xa0z", "ΑΣ ΣΑΣ", "ﬁ é é", "12 345 a1b2!?", "<|endoftext|>", "日本語 text", "a\r\nb\x0bc", "ÀÖØöøÿ×÷"]
    for name, drops in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        enc = Encoder(vocabulary_path(name), drops)
        assert [x.tolist() for x in enc.encode(texts)] == [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_best_fill():
    assert packing.best_fill({1500: 1, 548: 3, 500: 2}, 2048) == {1500: 1, 548: 1}
    assert packing.best_fill({700: 9}, 2048) == {700: 2}
    counts = dict(zip(*np.unique(np.random.default_rng(6).integers(1, 2048, 3000), return_counts=True), strict=True))
    counts = {int(k): int(v) for k, v in counts.items()}
    used = Counter()
    for take, times in packing.plan(counts, 2048):
        assert sum(n * k for n, k in take.items()) <= 2048
        used.update({n: k * times for n, k in take.items()})
    assert used == counts


def test_packing(docs, rows):
    got = packing.pack(docs, vocabulary_path("word_bpe_49k.json"), with_ids=True).collect()
    sequences = defaultdict(list)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    enc = Encoder(vocabulary_path("word_bpe_49k.json"), True)
    assert sum(r.length for r in got) == sum(len(enc.tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in rows)
    total = sum(r.length for r in got)
    assert sum(packing.padding(sum(n for _, n in p), 2048) for p in sequences.values()) < 0.05 * total


def test_mixing(docs, rows):
    got = mixing.mix_documents(docs).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0) for r in got)
    size, weight = Counter(), {}
    for r in rows:
        size[r.source] += len(words(r.text))
    for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or ""))):
        weight[s] = (3, 1, 2)[i % 3]
    target, free, left = {}, set(size), 1.5 * sum(size.values())
    while True:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * size[s]}
        if not full:
            break
        target |= {s: 2 * size[s] for s in full}
        left -= sum(2 * size[s] for s in full)
        free -= full
    target |= {s: level * weight[s] for s in free}
    assert {round(r.target, 3) for r in got} == {round(t, 3) for t in target.values()}
    again = mixing.mix_documents(docs.repartition(5)).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in again) == Counter((r.doc_id, r.size, r.taken) for r in got)
    assert mixing.mixed_rows(docs).columns == docs.columns


def test_mixing_hits_targets(spark):
    table = spark.createDataFrame([(i, "w " * (1 + i * 7 % 90), "abc"[i % 3]) for i in range(3000)], "doc_id long, text string, source string")
    got = mixing.mix_documents(table).groupBy("target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 90 for r in got)


def test_pipeline(docs, spark, tmp_path):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "mixing", "packing"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
