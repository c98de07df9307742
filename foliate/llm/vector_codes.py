"""Vector code compression: product codes with integer codebooks.

Components become integers, vectors are cut into equal consecutive parts, and each part gets the index of its nearest
codebook entry. Codebooks (parts x entries x width integers, whatever the number of vectors) are broadcast each round; Arrow
batches find distances by norm expansion with exact int64 matrix products and add up the parts that fall to each entry; a
grouped shuffle merges those sums. Vectors themselves are never shuffled.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_totals

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
SLICE = 4096


@dataclass
class Codes:
    """codes: vec_id, label, code (an index below 256 a part, as bytes), error. books: parts x entries x width; dim: components
    of a vector, which the last part is padded to with zeros."""

    codes: DataFrame
    books: np.ndarray
    dim: int

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position, as decimals with commas between."""
        return hashlib.sha256(",".join(str(x) for x in self.books.ravel().tolist()).encode()).hexdigest()


def assign(ints: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of each row's parts, and the squared distances to them: both rows x parts."""
    parts, entries, width = books.shape
    codes, errors = np.zeros((len(ints), parts), np.int64), np.zeros((len(ints), parts), np.int64)
    for p in range(parts):
        x, b = ints[:, p * width : (p + 1) * width], books[p]
        score = (b * b).sum(1) - 2 * (x @ b.T)
        codes[:, p] = score.argmin(1)
        errors[:, p] = (x * x).sum(1) + score[np.arange(len(x)), codes[:, p]]
    return codes, errors


def _slices(batches, padded: int):
    """Batches in pieces of bounded size, with their integers as a matrix."""
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            batch = whole.slice(at, SLICE)
            flat = batch.column("ints").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)
            yield batch, np.pad(flat, ((0, 0), (0, padded - flat.shape[1])))


def _sums(shared):
    """For each part, entry and position: the sum of what fell to it in a partition, and how much that was."""

    def rows(batches):
        books = shared.value
        parts, entries, width = books.shape
        total, n = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for _, ints in _slices(batches, parts * width):
            codes, _ = assign(ints, books)
            for p in range(parts):
                np.add.at(total[p], codes[:, p], ints[:, p * width : (p + 1) * width])
                n[p] += np.bincount(codes[:, p], minlength=entries)
        p, e, k = (x.ravel() for x in np.indices(books.shape))
        used = n[p, e] > 0
        columns = [p[used], e[used], k[used], total.ravel()[used], n[p, e][used]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "at", "total", "n"])

    return rows


def _codes(shared, names: list[str]):
    def rows(batches):
        books = shared.value
        for batch, ints in _slices(batches, books.shape[0] * books.shape[2]):
            codes, errors = assign(ints, books)
            code = pa.array([row.tobytes() for row in codes.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), code, pa.array(errors.sum(1))], names=[*names, "code", "error"])

    return rows


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes:
    """Codes of all vectors, with codebooks refined over all of them.

    Component x becomes floor(scale * x), held to a bound (2^28 for 64 components) within which all sums are exact.
    Codebooks start as the parts of the `entries` smallest ids, ascending, repeated ids by their integers, null ids last;
    with fewer vectors there are fewer entries. Ties of distance go to the lower entry; an entry that nothing falls to stays.

    Left out: null and empty vectors, those with a null, NaN or infinite component, and those whose length is not the most
    frequent one (the longer, if two are equally frequent). Repeated rows stay and count each. A table with nothing left gives
    no rows and empty codebooks. Other columns are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("an index must fit a byte: 1 to 256 entries")
    spark = vectors.sparkSession
    sc, scratch = spark.sparkContext, Scratch(spark)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where((F.size("v") > 0) & finite)
    usual = source.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if usual is None:
        return Codes(source.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64), 0)
    dim = usual["dim"]
    width = -(-dim // parts)
    bound = math.isqrt((2**62 - 1) // (4 * dim))
    whole = lambda x: F.greatest(F.least(F.floor(x * scale), F.lit(bound)), F.lit(-bound)).cast("int" if bound < 2**31 else "long")
    kept = scratch.cut(source.where(F.size("v") == dim).select("vec_id", "label", F.transform("v", whole).alias("ints")), "integers")
    first = kept.select("vec_id", "ints").orderBy(F.asc_nulls_last("vec_id"), "ints").limit(entries).collect()
    start = np.array([r["ints"] for r in first], np.int64)
    books = np.pad(start, ((0, 0), (0, parts * width - dim))).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        shared = sc.broadcast(books)
        sums = kept.select("ints").mapInArrow(_sums(shared), "part long, entry long, at long, total long, n long")
        found = sums.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()  # at most as many rows as a codebook has integers
        books = books.copy()
        for r in found:
            books[r["part"], r["entry"], r["at"]] = r["total"] // r["n"]
        shared.unpersist()
    coded = kept.mapInArrow(_codes(sc.broadcast(books), ["vec_id", "label"]), kept.select("vec_id", "label").schema.add("code", "binary").add("error", "long"))
    return Codes(scratch.cut(coded, "codes"), books, dim)


def label_errors(codes: DataFrame) -> DataFrame:
    """codes with label_error, the error summed over equal labels (nulls together), as a long that stops at its largest value."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    return join_totals(codes, codes.groupBy("label").agg(total.alias("label_error"), F.count(F.lit(1)).alias("n")), ["label"], "n")


def decompress(codes: DataFrame, books: np.ndarray, dim: int, scale: int = SCALE) -> DataFrame:
    """vec_id, vector: the entries that codes name, as doubles (the lower ends of what was rounded down)."""
    shared = codes.sparkSession.sparkContext.broadcast(books)

    def rows(batches):
        b = shared.value
        for batch in batches:
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            found = b[np.arange(len(b)), code].reshape(len(code), -1)[:, :dim] / scale if len(code) else np.zeros((0, dim))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(list(found), pa.list_(pa.float64()))], names=["vec_id", "vector"])

    return codes.select("vec_id", "code").mapInArrow(rows, "vec_id long, vector array<double>")


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """DuckDB SQL of the query: one relation a round for codebooks (b) and one for assignments (a)."""
    out = f"""WITH k AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS ints FROM embeddings
WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT r, vec_id, p, unnest(range(1, len(ints) // {parts} + 1)) AS i, unnest(ints[p * (len(ints) // {parts}) + 1:(p + 1) * (len(ints) // {parts})]) AS v FROM k, range({parts}) t(p)),
b0 AS (SELECT p, e, i, v AS c FROM (SELECT *, dense_rank() OVER (ORDER BY vec_id, r) - 1 AS e FROM x) WHERE e < {entries})"""
    for n in range(rounds + 1):
        out += f""",
d{n} AS (SELECT x.r, x.p, b.e, CAST(sum((x.v - b.c) * (x.v - b.c)) AS BIGINT) AS d FROM x JOIN b{n} b ON x.p = b.p AND x.i = b.i GROUP BY x.r, x.p, b.e),
a{n} AS (SELECT r, p, min(d * {entries} + e) % {entries} AS e, min(d * {entries} + e) // {entries} AS d FROM d{n} GROUP BY r, p)"""
        if n < rounds:
            out += f""",
m{n} AS (SELECT x.p, a.e, x.i, CAST(floor(CAST(sum(x.v) AS DOUBLE) / count(*)) AS BIGINT) AS c FROM x JOIN a{n} a ON x.r = a.r AND x.p = a.p GROUP BY x.p, a.e, x.i),
b{n + 1} AS (SELECT b.p, b.e, b.i, coalesce(m.c, b.c) AS c FROM b{n} b LEFT JOIN m{n} m ON b.p = m.p AND b.e = m.e AND b.i = m.i)"""
    return (
        out
        + f""",
h AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM b{rounds}),
o AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN o USING (r), h
"""
    )


COMPRESS_SQL = _sql()
