import hashlib
import math
import random

import duckdb
import numpy as np
import pyarrow as pa

from foliate.llm import embedding_dup, vector_codes
from foliate.llm.common import join_totals

KINDS = "vec_id long, embedding array<float>, label int, code string, error string, n string, total_label int, ints string, key string"


def frame(spark, rows, kinds=KINDS):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, v, label, "c", "e", "n", 7, "i", "k") for i, v, label in rows], kinds).repartition(3)


def odd_rows(rng, dim=16):
    rows = [(i, [float(x) for x in rng.normal(size=dim).astype(np.float32)], int(rng.integers(3)) if i % 7 else None) for i in range(90)]
    nan, inf = float("nan"), float("inf")
    return [*rows, (90, None, 1), (91, [None] * dim, 1), (92, [nan] * dim, 1), (93, [1.0] * (dim - 1) + [inf], 1), (94, [], 2), (95, [1.0] * (dim - 1), 2), (None, rows[3][1], 2), (4, rows[5][1], 0), (4, rows[5][1], 0), (97, [0.0] * dim, 5), (98, [3e38] * dim, 6)]


def brute_codes(rows, dim, parts=8, entries=16, rounds=6, scale=4096):
    """One integer at a time. rows: [(id, vector, label)], all of one length."""
    bound = math.isqrt((2**62 - 1) // (4 * dim))
    top = float("inf")
    ints = sorted(((top if i is None else i), [max(-bound, min(bound, math.floor(scale * x))) for x in v], i, label) for i, v, label in rows)
    w = dim // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _, _ in ints[:entries]] for p in range(parts)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            fell = {}
            for _, v, _, _ in ints:
                fell.setdefault(nearest(v, p)[1], []).append(cut(v, p))
            for k, vs in fell.items():
                new[p][k] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
        books = new
    out = []
    for _, v, i, label in ints:
        found = [nearest(v, p) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def test_codes_are_those_of_brute_force(spark):
    rows = odd_rows(np.random.default_rng(2))
    want, digest = brute_codes([r for r in rows if r[0] not in (90, 91, 92, 93, 94, 95)], 16)
    out = vector_codes.compress(frame(spark, rows))
    got = [(r.vec_id, r.label, r.code.hex(), r.error) for r in out.codes.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert out.digest() == digest
    errors = {}
    for _, label, _, e in want:
        errors[label] = errors.get(label, 0) + e
    assert {(r.label, r.label_error) for r in vector_codes.label_errors(out.codes).collect()} == set(errors.items())


def test_codes_of_few_and_no_vectors(spark):
    rows = [(i, [float(i + j) for j in range(6)], None) for i in range(5)]  # six components: the last parts are padded
    out = vector_codes.compress(frame(spark, rows))
    assert out.books.shape == (8, 5, 1) and {r.error for r in out.codes.collect()} == {0}
    back = {r.vec_id: r.vector for r in vector_codes.decompress(out.codes, out.books, out.dim).collect()}
    assert back == {i: v for i, v, _ in rows}
    none = vector_codes.compress(frame(spark, rows).where("false"))
    assert none.codes.count() == 0 and vector_codes.label_errors(none.codes).count() == 0 and none.books.size == 0


def test_first_of_equal_entries(spark):
    books = np.zeros((1, 3, 2), np.int64)
    codes, errors = vector_codes.assign(np.array([[3, 4], [0, 0]]), books)
    assert codes.tolist() == [[0], [0]] and errors.tolist() == [[25], [0]]
    books = np.array([[[-(2**29), 2**29], [2**29, -(2**29)]]])
    codes, errors = vector_codes.assign(np.array([[2**29, -(2**29)]]), books)
    assert codes.tolist() == [[1]] and errors.tolist() == [[0]]


def test_compress_sql(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=16).astype(np.float32)], int(rng.integers(3)) if i % 5 else None) for i in range(120)]
    embeddings = pa.table({"vec_id": pa.array([r[0] for r in rows]), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "label": pa.array([r[2] for r in rows], pa.int32())})
    con = duckdb.connect()
    con.register("embeddings", embeddings)
    want = sorted(con.execute(vector_codes.COMPRESS_SQL).fetchall())
    out = vector_codes.compress(frame(spark, rows))
    assert sorted((r.vec_id, r.code.hex(), r.error, r.label_error, out.digest()) for r in vector_codes.label_errors(out.codes).collect()) == want


def test_join_totals_of_many_and_hot_keys(spark, monkeypatch):
    from foliate.llm import common

    monkeypatch.setattr(common, "HOT_SHARE", 1 / 4)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    keys = [None] * 40 + [1] * 50 + [k for k in range(2, 12) for _ in range(3)]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "x int, k int")
    totals = rows.selectExpr("k").groupBy("k").agg({"*": "count"}).withColumnRenamed("count(1)", "n").selectExpr("k", "n", "n * 10 AS ten")
    got = join_totals(rows, totals, ["k"], "n")
    assert got.columns == ["x", "k", "ten"]
    assert sorted((r.x, r.ten) for r in got.collect()) == [(i, keys.count(k) * 10) for i, k in enumerate(keys)]


def brute_links(rows, cosine=0.9):
    """[(id, n_links, component)] in the order of rows; components by id, as ids may repeat."""
    unit = []
    for _, v in rows:
        ok = bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.array(v, float) if ok else None
        unit.append(None if x is None else x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()))
    root = {i: i for i, _ in rows}
    low = lambda i: -1 if i is None else i

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    n = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(len(rows)):
            if a != b and unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
                n[a] += 1
                p, q = find(rows[a][0]), find(rows[b][0])
                if p != q:
                    root[max(p, q, key=low)] = min(p, q, key=low)
    return [(i, k, find(i)) for (i, _), k in zip(rows, n, strict=True)]


def cloud(rng, dim, sizes):
    """Clusters whose members lie at cosines around 0.9 and nearer, far from each other."""
    rows = []
    for size in sizes:
        centre = rng.normal(size=dim)
        for _ in range(size):
            rows.append((len(rows), [float(x) for x in (centre + rng.normal(size=dim) * rng.choice([0.02, 0.2, 0.33])).astype(np.float32)]))
    return rows


def linked(spark, rows, **more):
    out = embedding_dup.near_vectors(frame(spark, [(i, v, 1) for i, v in rows]), **more)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in out.collect()), key=repr)


def test_links_are_those_of_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = cloud(rng, 64, [1] * 30 + [2] * 20 + [60])
    rows += [(1000 + k, rows[-1][1]) for k in range(5)]  # exact copies
    rows += [(2000, [-x for x in rows[0][1]]), (2001, [2 * x for x in rows[0][1]]), (2002, None), (2003, []), (2004, [0.0] * 64), (2005, [None] + [1.0] * 63), (2006, [float("nan")] * 64), (2007, [float("inf")] + [1.0] * 63)]
    rows += [(2008, rows[1][1][:32]), (2009, rows[1][1][:32]), (2010, [3e38] * 64), (None, rows[2][1]), (5, rows[5][1]), (5, rows[9][1]), (2011, [1e-45] * 64)]
    assert linked(spark, rows) == sorted(brute_links(rows), key=repr)
    out = embedding_dup.near_vectors(frame(spark, [(i, v, 1) for i, v in rows]))
    assert all(r.kept == (r.vec_id == r.component_id) for r in out.where("vec_id IS NOT NULL").collect())
    assert embedding_dup.near_vectors(out.selectExpr("vec_id", "array(1.5f) AS embedding").where("false")).count() == 0


def test_large_buckets_are_verified_by_blocks(spark, monkeypatch):
    """Every pair counts once, whatever blocks and batches it lies in."""
    monkeypatch.setattr(embedding_dup, "BLOCK", 16)
    monkeypatch.setattr(embedding_dup, "TILE", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = cloud(np.random.default_rng(9), 8, [70, 9, 1])
        assert linked(spark, rows, recall=0.99999) == sorted(brute_links(rows), key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_recall_at_the_threshold():
    """Pairs at a cosine just over 0.9 share a bucket as often as planned, with one more hash too."""
    rng = np.random.default_rng(3)
    a, z = rng.normal(size=(2, 2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z -= (a * z).sum(1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    b = 0.901 * a + math.sqrt(1 - 0.901**2) * z
    for n in (10**4, 10**8):
        hashes, tables, probes = embedding_dup.plan(64, n, 0.9)
        x, y = (embedding_dup.codes(v, hashes, tables, probes) for v in (a, b))
        assert (x[:, :, :, None] == y[:, :, None, :]).any(axis=(1, 2, 3)).mean() > 0.99
        assert n * probes / 128.0**hashes <= embedding_dup.BUCKET


def test_hadamard():
    h = np.array([[1]])
    for _ in range(4):
        h = np.block([[h, h], [h, -h]])
    x = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose(embedding_dup.hadamard(x), x @ h)


def test_near_vectors_sql(spark):
    rng = random.Random(5)
    rows = cloud(np.random.default_rng(12), 16, [1] * 10 + [4] * 8)
    rng.shuffle(rows)
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": pa.array([r[0] for r in rows]), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32()))}))
    assert sorted(con.execute(embedding_dup.NEAR_VECTORS_SQL).fetchall()) == sorted((i, n, c, i == c) for i, n, c in brute_links(rows))
