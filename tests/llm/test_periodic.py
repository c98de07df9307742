import hashlib
import random
import zlib

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from foliate.llm import periodic
from foliate.llm.queries import op13_periodic_runs

R = random.Random(17)
KINDS = "doc_id long, text string, n_words string, runs string, collapsed string, id int, words string"


def brute(w):
    """Every period in turn, word by word."""
    found = []
    for q in range(1, len(w) // 3 + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            if j - i + q >= max(24, 3 * q) and j > i:
                found.append((i - q, j - i + q, q))
            i = max(j, i + 1)
    least = [r for r in found if not any(o[2] < r[2] and o[0] <= r[0] and o[0] + o[1] >= r[0] + r[1] for o in found)]
    return sorted(least, key=lambda r: (r[0], r[2]))


def odd_words(n):
    w = []
    while len(w) < n:
        way = R.random()
        if way < 0.5:
            u = [R.choice("abc" if R.random() < 0.6 else "defghijklmnopqrs") for _ in range(R.randint(1, 14))]
            w += u * R.randint(1, 12) + u[: R.randint(0, len(u))]
        elif way < 0.8 or not w:
            w += [R.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(R.randint(1, 12))]
        else:
            a = R.randrange(len(w))
            w += w[a : a + R.randint(1, 60)]
    return w


def test_runs_are_those_of_brute_force():
    """With and without cutting the text to stretches first."""
    n = 0
    for _ in range(800):
        w = odd_words(R.randint(1, 160))
        want = brute(w)
        n += len(want)
        assert periodic.runs_of([x.encode() for x in w]) == want
        assert periodic.runs([ord(x) for x in w]) == want
    assert n > 300


def test_limits():
    for q in range(1, 30):
        unit = [b"%d" % k for k in range(q)]
        for n in range(3 * q - 2, max(24, 3 * q) + 3):
            w = [b"x", *(unit[k % q] for k in range(n)), b"y"]
            assert periodic.runs_of(w) == ([(1, n, q)] if n >= max(24, 3 * q) else [])


def test_long_texts():
    """A sequence repeated over a very long text takes time and memory in line with its length."""
    w = [b"%d" % R.randrange(10**6) for _ in range(2000)]
    assert periodic.runs_of(w * 50) == [(0, 100_000, 2000)]
    assert periodic.runs_of([b"a"] * 200_000) == [(0, 200_000, 1)]
    assert periodic.runs_of([b"%d" % R.randrange(3000) for _ in range(200_000)]) == []


def sample():
    rows = [(i, R.choice([" ", "\n"]).join(odd_words(R.randint(1, 150)))) for i in range(1, 90)]
    return [*rows, (90, None), (91, ""), (92, " \t\n"), (93, "é " * 40), (94, "a\x0bb\x1cc " * 30), (7, rows[6][1]), (7, "z " * 25)]


def collapse(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def words_of(text):
    out = [""]
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            out.append("")
        else:
            out[-1] += c
    return [x for x in out if x]


def test_operator(spark):
    rows = [*sample(), (None, "b c " * 20)]
    docs = spark.createDataFrame([(i, t, "n", "r", "c", 1, "w") for i, t in rows], KINDS).repartition(3)
    out = periodic.periodic_runs(docs)
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()]
    want = [(i, len(w), brute(w), collapse(w, brute(w))) for i, t in rows for w in [words_of(t)]]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert periodic.periodic_runs(docs.where("false")).count() == 0


def planted(i, w):
    """The contract's changed words."""
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]


def want_rows(rows):
    out = []
    for i, text in rows:
        w = planted(i, words_of(text))
        found = brute(w)
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        last = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        out.append((i, len(found), *last, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(collapse(w, found))))
    return sorted(out, key=repr)


def test_query_and_its_sql(spark, tmp_path):
    rows = sample()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    want = want_rows(rows)
    assert sum(planted(i, words_of(t)) != words_of(t) for i, t in rows) > 3
    assert sorted((tuple(r) for r in op13_periodic_runs(spark, str(tmp_path)).collect()), key=repr) == want
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows])}))
    assert sorted(con.execute(periodic.RUNS_SQL).fetchall(), key=repr) == want


def test_strongest_run(spark):
    df = spark.createDataFrame([([(0, 30, 10), (5, 48, 12), (9, 24, 6), (50, 12, 3)],), ([],), (None,)], "runs " + periodic.RUNS)
    got = [r.best for r in df.select(periodic.strongest(F.col("runs")).alias("best")).collect()]
    assert tuple(got[0]) == (5, 48, 12) and got[1:] == [None, None]
