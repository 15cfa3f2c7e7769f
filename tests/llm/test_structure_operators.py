"""Periodic runs, whitening and sharding against brute-force versions, with nulls, empty tables, repeats and clashing columns."""

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trustframe.llm import periodic_runs, queries, sharding, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, shard int, slot long, size string, runs int, doc string, n int, h long, w string"


def brute_runs(words, least=6, times=4):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            smaller = any(all(words[k] == words[k + d] for k in range(start, start + length - d)) for d in range(1, q))
            if length >= max(least, times * q) and not smaller:
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def texts():
    rng = random.Random(7)
    out = []
    for _ in range(60):
        words = []
        while len(words) < rng.randint(0, 90):
            words += [rng.choice("abcdé") for _ in range(rng.randint(1, 6))] * rng.randint(1, 7)
        out.append(rng.choice(["", " "]) + rng.choice([" ", "\n\t", "\x0b"]).join(words))
    return out + [None, "", " \n ", "one", "漢 字 " * 9, "same " * 20_000, "x y z " * 12, out[0], out[0]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 7, t, 1, 2, "s", 3, "d", 4, 5, "w") for i, t in enumerate(texts())]
    rows += [(None, "a b a b a b a b a b", None, None, None, None, None, None, None, None), rows[1], rows[1]]
    rows += [(1_000 + k, "r " * 30 + str(k % 3), None, None, None, None, None, None, None, None) for k in range(60)]
    return spark.createDataFrame(rows, DOCS)


def test_kruskal_runs_of_random_texts():
    rng = random.Random(3)
    for _ in range(400):
        least, times = rng.choice([(6, 4), (2, 2), (5, 3), (1, 2)])
        made = [" ".join(w for _ in range(rng.randint(0, 8)) for w in [rng.choice("abc") for _ in range(rng.randint(1, 5))] * rng.randint(1, 5)) for _ in range(3)]
        offsets, words = periodic_runs.word_lists(pa.array([*made, None]))
        ids = words.dictionary_encode().indices.to_numpy().astype(np.int64)
        got = sorted((int(a), int(b), int(c)) for a, b, c in periodic_runs.kruskal_runs(ids, offsets, least, times))
        assert got == sorted((int(o) + s, n, q) for o, t in zip(offsets, made) for s, n, q in brute_runs(t.split(), least, times))


def test_runs_of_documents(docs):
    got = [(r.doc.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.find(docs).collect()]
    want = []
    for r in docs.select("doc_id", "text").collect():
        words = WORD.findall(r.text or "")
        runs = brute_runs(words) if len(words) < 5_000 else [(0, len(words), 1)]
        want.append((r.doc_id, len(words), runs, collapse(words, runs)))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert periodic_runs.find(docs.limit(0), keep=[]).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.find(docs, times=1)


def test_op11_query(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op11_runs(spark, str(tmp_path)).collect()]
    want = []
    for r in docs.select("doc_id", "text").collect():
        words = WORD.findall(r.text or "")
        n, h = len(words), None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode())
        if h is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute_runs(words) if n < 5_000 else [(0, n, 1)]
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        digests = (hashlib.sha256(x.encode()).hexdigest() for x in ("".join("%d,%d,%d\n" % x for x in runs), collapse(words, runs)))
        want.append((r.doc_id, len(runs), *shown, *digests))
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitened double, component int, doc string, n int")


def test_whitening_against_a_dense_solver(spark, tmp_path):
    rng = np.random.default_rng(5)
    data = (rng.standard_normal((300, 12)) * np.linspace(0.2, 3, 12) + 5).astype(np.float32)
    rows = [(i, v.tolist(), 0.5, 1, "d", 2) for i, v in enumerate(data)]
    odd = [(900, None), (901, []), (902, [None] * 12), (903, [float("nan")] * 12), (904, [float("inf")] * 12), (905, [1.0] * 11), (906, [3e38] * 12)]
    frame = vectors(spark, [*rows, (None, rows[0][1], None, None, None, None), rows[3], *[(i, v, None, None, None, None) for i, v in odd]])
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op12_whitening(spark, str(tmp_path)).toPandas()
    used = np.vstack([data, data[:1], data[3:4]]).astype(float)
    x = np.floor(1024 * used).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1][:, :8]
    white, deviation = centred @ basis / np.sqrt(values[:8]), ((n * x - sums) ** 2).sum(axis=1)
    ids = [*range(300), None, 3]
    assert len(got) == 8 * n and set(got.n) == {n} and (got.identity_error < 1e-10).all()
    for k in range(8):
        part = got[got.component == k + 1]
        assert np.allclose(part.explained, values[k] / values.sum(), rtol=1e-12)
        sign = np.sign(part[part.vec_id == 1].whitened.iloc[0] * white[1, k])
        have = sorted((-1 if v != v else v, d, round(w * sign, 9)) for v, d, w in zip(part.vec_id, part.deviation, part.whitened))
        assert have == sorted((-1 if v is None else v, d, round(w, 9)) for v, d, w in zip(ids, deviation.tolist(), white[:, k]))


def test_whitening_without_variance_or_rows(spark):
    empty = whitening.report(vectors(spark, [(1, None, 0.0, 1, "d", 2)]), keep=["vec_id"])
    assert empty.collect() == [] and "whitened" in empty.columns
    alike = whitening.report(vectors(spark, [(k, [1.0, 2.0], 0.0, 1, "d", 2) for k in range(3)]), keep=["vec_id"]).collect()
    assert [(r.whitened, r.explained, r.deviation, r.identity_error) for r in alike] == [(None, 0.0, 0, None)] * 6
    line = whitening.report(vectors(spark, [(k, [float(k), 2.0 * k], 0.0, 1, "d", 2) for k in range(4)])).collect()
    assert {(r.component, r.whitened is None) for r in line} == {(1, False), (2, True)} and {r.explained for r in line if r.component == 2} == {0.0}


def test_deviation_beyond_a_long():
    away, rest = np.array([[2 ** 31, 2 ** 31], [3, 1], [2 ** 32, 0], [2 ** 31, 2 ** 30]], np.int64), np.array([1, 0])
    want = [sum((int(a) * 2 - int(r)) ** 2 for a, r in zip(row, rest)) for row in away]
    assert whitening._squares(away, rest, 2) == [v if v < 2 ** 63 else None for v in want]


@pytest.mark.parametrize("kind", range(4))
def test_contour_integrals_find_all_eigenpairs(spark, kind):
    rng, d = np.random.default_rng(kind), 24
    values = [rng.random(d), np.ones(d), np.r_[np.zeros(12), np.ones(12)], 10.0 ** -np.arange(d)][kind]
    basis = np.linalg.qr(rng.standard_normal((d, d)))[0]
    matrix = (basis * values) @ basis.T
    matrix = (matrix + matrix.T) / 2
    got, pairs = whitening.largest_eigenpairs(spark, matrix, 8)
    assert np.allclose(got, np.sort(values)[::-1][:8], atol=1e-12) and np.allclose(matrix @ pairs, pairs * got, atol=1e-10)
    assert np.allclose(pairs.T @ pairs, np.eye(8), atol=1e-12)


def test_inertia():
    rng = np.random.default_rng(2)
    for d in (1, 2, 7, 30):
        a = rng.standard_normal((d, d))
        a = a + a.T
        assert whitening.inertia(a) == (np.linalg.eigvalsh(a) > 0).sum()
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1 and whitening.inertia(np.zeros((3, 3))) == 0


def one_jump(key, shards):
    shard, after = -1, 0
    while after < shards:
        shard, key = after, (key * 2862933555777941757 + 1) % 2 ** 64
        after = int((shard + 1) * (2 ** 31 / ((key >> 33) + 1)))
    return shard


def test_jump_moves_keys_into_the_new_shard_only():
    keys = np.random.default_rng(0).integers(0, 2 ** 63, 20_000).astype(np.uint64)
    keys[:3] = [0, 2 ** 64 - 1, 2 ** 63]
    for shards in (1, 2, 24, 1000):
        now, grown = sharding.jump(keys, shards), sharding.jump(keys, shards + 1)
        assert now[:500].tolist() == [one_jump(int(k), shards) for k in keys[:500]]
        assert set(grown[grown != now]) <= {shards}
        assert abs((grown != now).mean() - 1 / (shards + 1)) < 0.02
        assert np.bincount(now, minlength=shards).max() < 2 * len(keys) / shards + 30


def test_slots(spark, docs, monkeypatch):
    monkeypatch.setattr(sharding, "DEAL", 4)
    hot = spark.createDataFrame([(5, "hot", 1, 1, "s", 1, "d", 1, 1, "w")] * 50 + [(None, None, 1, 1, "s", 1, "d", 1, 1, "w")] * 9, DOCS)
    rows = docs.unionByName(hot)
    got = sharding.slots(rows, 6).collect()
    want = collections.Counter()
    for r in rows.select("doc_id", "text").collect():
        raw = (r.text or "").encode()
        key = int(hashlib.md5(("\\N" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:16], 16)
        want[(r.doc_id, len(raw) + 8, zlib.crc32(raw), one_jump(key, 6), one_jump(key, 7))] += 1
    assert collections.Counter((r.key, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    for shard in range(6):
        slots = [r.slot for r in got if r.shard == shard]
        assert sorted(slots) == list(range(len(slots)))
    again = sharding.slots(rows.repartition(7), 6).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert sharding.slots(docs.limit(0), 6).collect() == []


def test_assign_moved_and_written_shards(spark, docs, tmp_path):
    placed = {(r.doc.doc_id, r.shard) for r in sharding.assign(docs, 5).collect()}
    grown = {(r.doc.doc_id, r.shard) for r in sharding.assign(docs, 6, keep=["doc_id"]).collect()}
    moves = sharding.moved(docs, 5, 6).collect()
    assert {(r.key, r.old_shard) for r in moves} == placed - grown and {r.new_shard for r in moves} <= {5}
    sharding.write_shards(docs.drop("shard"), f"{tmp_path}/out", 5, files=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert {(r.doc_id, r.shard) for r in back.collect()} == placed and back.count() == docs.count()
    with pytest.raises(ValueError):
        sharding.write_shards(docs, f"{tmp_path}/again", 5)
    with pytest.raises(ValueError):
        docs.select(sharding.shard_of(F.col("doc_id"), 0)).collect()
