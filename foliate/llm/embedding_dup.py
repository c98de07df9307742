"""Near-duplicate embeddings by cross-polytope hashing.

A hash rotates a vector by three rounds of random signs and a fast Hadamard transform, and is the signed axis nearest to
the result. HASHES of them make a bucket of a table; every vector lies in its own bucket and in the next best ones
(multiprobe, on both sides of a pair). All pairs of a bucket are verified in double precision, in blocks of bounded size; a
pair that shares several buckets counts in the first of them alone, which both vectors' codes tell, so no pair is ever
written: a block gives the number of links of each vector, and a forest of them for the components.

The number of hashes follows from the number of vectors, and the numbers of tables and of buckets from pairs drawn at the
threshold: `plan` takes as many as find such a pair with the wanted probability; nearer pairs are found more surely.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, join_totals
from .near_dup import components

#: Probability with which a pair just at the threshold is found.
RECALL = 0.999
#: Vectors wanted in a bucket, at most; and vectors of a block of larger buckets.
BUCKET, BLOCK, TILE = 512, 2048, 256
NOTHING = -(1 << 62)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows, whose length is a power of two, by the Hadamard matrix."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x


@lru_cache(64)
def _signs(d: int, tables: int, hashes: int) -> np.ndarray:
    return np.random.default_rng([d, hashes, 90217]).choice(np.array([-1.0, 1.0]), (tables, hashes, 3, d))


def codes(unit: np.ndarray, hashes: int, tables: int, probes: int) -> np.ndarray:
    """rows x tables x probes: the best buckets of unit vectors, padded with -1 where there are fewer."""
    n, dim = unit.shape
    d = 1 << max(0, dim - 1).bit_length()
    x = np.pad(unit, ((0, 0), (0, d - dim)))
    top = min(probes, 2 * d)
    out = np.full((n, tables, probes), -1, np.int64)
    for t, table in enumerate(_signs(d, tables, hashes)):
        cost, code = np.zeros((n, 1)), np.zeros((n, 1), np.int64)
        for signs in table:
            y = x
            for s in signs:
                y = hadamard(y * s) / math.sqrt(d)
            y = np.concatenate([y, -y], axis=1)
            near = np.argpartition(-y, top - 1, axis=1)[:, :top] if top < 2 * d else np.broadcast_to(np.arange(2 * d), y.shape)
            far = (y.max(axis=1, keepdims=True) - np.take_along_axis(y, near, 1)) ** 2
            cost = (cost[:, :, None] + far[:, None, :]).reshape(n, -1)
            code = (code[:, :, None] * (2 * d) + near[:, None, :]).reshape(n, -1)
            best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
            cost, code = np.take_along_axis(cost, best, 1), np.take_along_axis(code, best, 1)
        out[:, t, : code.shape[1]] = code
    return out


def plan(dim: int, n: int, cosine: float, recall: float = RECALL) -> tuple[int, int, int]:
    """Hashes, tables and probes for n vectors of dim components, with the fewest rows that find pairs at the threshold."""
    d = 1 << max(0, dim - 1).bit_length()
    rng = np.random.default_rng(40961)
    a, b = rng.normal(size=(2, 1000, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
    b = cosine * a + math.sqrt(max(0.0, 1 - cosine * cosine)) * b
    best = None
    for probes in (1, 2, 4, 8, 16):
        hashes = next(k for k in range(1, 9) if n * probes / (2.0 * d) ** k <= BUCKET or k == 8)
        x, y = codes(a, hashes, 4, probes), codes(b, hashes, 4, probes)
        met = ((x[:, :, :, None] == y[:, :, None, :]) & (x[:, :, :, None] >= 0)).any(axis=(2, 3)).mean()
        tables = 1 if met >= recall else math.ceil(math.log(1 - recall) / math.log(1 - max(met, 1e-3)))
        if best is None or tables * probes < best[1] * best[2]:
            best = hashes, tables, probes
    return best


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Flat values of a binary column, and where each row's begin."""
    size = np.dtype(kind).itemsize
    offs = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data.view(kind), (offs - offs[0]) // size


def _pack(kind: str):
    """Vectors as bytes; null if they are zero or hold null, NaN or infinity."""

    def rows(batches):
        for batch in batches:
            out = []
            for v in batch.column(1):
                if v.values is None or not len(v.values):
                    out.append(None)
                    continue
                x = v.values.to_numpy(zero_copy_only=False)
                out.append((x.astype(kind) + 0.0).tobytes() if np.isfinite(x).all() and x.any() else None)  # + 0.0: no negative zero
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "vec"])

    return rows


def _deal(kind: str, hashes: int, tables: int, probes: int, whole: bool):
    """A row for each bucket of each vector, with the vector and all its buckets or with nothing but the bucket."""

    def rows(batches):
        for all_ in batches:
            for at in range(0, all_.num_rows, 1000):
                batch = all_.slice(at, 1000)
                flat, starts = _matrix(batch.column("vec"), kind)
                dims = np.diff(starts)
                for dim in np.unique(dims).tolist():
                    own = np.flatnonzero(dims == dim)
                    code = codes(_unit(flat[starts[own][:, None] + np.arange(dim)]), hashes, tables, probes)
                    row, table, probe = np.nonzero(code >= 0)
                    key = code[row, table, probe] * tables + table
                    columns = {"dim": pa.array(np.full(len(row), dim, np.int32)), "key": pa.array(key)}
                    if whole:
                        taken = batch.take(pa.array(own[row]))
                        packed = [c.tobytes() for c in code]
                        columns |= {c: taken.column(c) for c in ("rep", "h1", "n")} | {"vec": taken.column("vec"), "codes": pa.array([packed[i] for i in row.tolist()], pa.binary())}
                    yield pa.RecordBatch.from_pydict(columns)

    return rows


def _verify(a: dict, b: dict, key: int, cosine: float, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a and b (of a with itself, if they are one) that are linked and that share no earlier bucket."""
    left, right = [], []
    table, code = key % tables, key // tables
    for at in range(0, len(a["rep"]), TILE):
        close = a["unit"][at : at + TILE] @ b["unit"].T >= cosine
        if a is b:
            close &= np.arange(len(b["rep"]))[None, :] > np.arange(at, at + len(close))[:, None]
        i, j = np.nonzero(close)
        for k in range(0, len(i), 100_000):
            p, q = i[k : k + 100_000] + at, j[k : k + 100_000]
            for t in range(table + 1):
                x, y = a["codes"][p, t], b["codes"][q, t]
                met = (x[:, :, None] == y[:, None, :]) & (x[:, :, None] >= 0)
                if t == table:
                    met &= x[:, :, None] < code
                new = ~met.any(axis=(1, 2))
                p, q = p[new], q[new]
            left.append(p)
            right.append(q)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def _bucket(rows: dict, key: int, first: int, second: int, cosine: float, tables: int) -> list[tuple]:
    """What a bucket, or a pair of blocks of one, finds: (x, its hash, None, links) and (x, None, smallest x of its component here, None)."""
    order = np.lexsort((rows["h1"], rows["rep"]))
    rows = {k: v[order] for k, v in rows.items()}
    rows["unit"] = _unit(rows.pop("vec"))
    at = [np.flatnonzero(rows["block"] == b) for b in (first, second)]
    a = {k: v[at[0]] for k, v in rows.items()}
    b = a if first == second else {k: v[at[1]] for k, v in rows.items()}
    i, j = _verify(a, b, key, cosine, tables)
    p, q = at[0][i], at[1][j]
    if not len(p):
        return []
    rep, size = rows["rep"], len(order)
    links = np.bincount(p, rows["n"][q], size) + np.bincount(q, rows["n"][p], size)
    label = np.arange(size)
    while True:
        low, before = np.minimum(label[p], label[q]), label.copy()
        np.minimum.at(label, p, low)
        np.minimum.at(label, q, low)
        label = label[label]
        if (label == before).all():
            break
    used = np.flatnonzero(links)
    out = [(x, h, None, int(n)) for x, h, n in zip(rep[used].tolist(), rows["h1"][used].tolist(), links[used].tolist(), strict=True)]
    return out + [(x, None, y, None) for x, y in zip(rep[used].tolist(), rep[label[used]].tolist(), strict=True) if x != y]


def _meet(kind: str, cosine: float, tables: int, probes: int):
    """Buckets follow one another in order; one that goes on in the next batch is held back."""

    def found(t: pa.RecordBatch, cuts: np.ndarray):
        flat, starts = _matrix(t.column("vec"), kind)
        packed, code_at = _matrix(t.column("codes"), "i8")
        names = ("key", "first", "second", "block", "rep", "h1", "n")
        own = {k: t.column(k).to_numpy() for k in names}
        out = []
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if z - a > 1:
                rows = {k: own[k][a:z] for k in ("block", "rep", "h1", "n")}
                rows["vec"] = flat[starts[a] : starts[z]].reshape(z - a, -1)
                rows["codes"] = packed[code_at[a] : code_at[z]].reshape(z - a, tables, probes)
                out += _bucket(rows, int(own["key"][a]), int(own["first"][a]), int(own["second"][a]), cosine, tables)
        columns = zip(*out, strict=True) if out else ((),) * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["x", "h1", "y", "n"])

    def rows(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            group = np.stack([batch.column(k).to_numpy() for k in ("dim", "key", "first", "second")])
            cuts = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1
            if len(cuts):
                yield found(batch, np.concatenate([[0], cuts]))
                batch = batch.slice(int(cuts[-1]))
            held = batch
        if held is not None:
            yield found(held, np.array([0, held.num_rows]))

    return rows


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept: links between vectors with a cosine of at least `cosine` in double precision.

    Vectors that are null, empty, zero or hold null, NaN or infinity link with nothing, nor do vectors of different length.
    Equal vectors are one class, which is compared once and counts as many links as it has rows. A null id comes before all
    others and stays null; rows that repeat an id stay, count each, and are judged by their own vector (as a node of a
    component an id has all its vectors). An empty table gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    single = vectors.schema[vector_col].dataType.elementType.typeName() in ("float", "byte", "short")
    kind = "f4" if single else "f8"
    given = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NOTHING)).alias("id"), F.col(vector_col).cast(f"array<{'float' if single else 'double'}>").alias("vec"))
    packed = given.mapInArrow(_pack(kind), "id long, vec binary")
    rows = packed.select("id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec", F.lit(2)).alias("h2"))
    classes = rows.where("vec IS NOT NULL").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.any_value("vec").alias("vec"))
    classes = scratch.cut(classes, "classes")
    size = classes.count()
    usual = classes.groupBy(F.octet_length("vec").alias("bytes")).count().orderBy(F.desc("count"), F.desc("bytes")).first()
    hashes, tables, probes = plan(usual["bytes"] // np.dtype(kind).itemsize, size, cosine, recall) if usual else (1, 1, 1)
    entries = classes.select("rep", "h1", "n", "vec")
    large = entries.mapInArrow(_deal(kind, hashes, tables, probes, False), "dim int, key long").groupBy("dim", "key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")).where("blocks > 1")
    large = broadcast_if_small(scratch.cut(large, "large"))
    dealt = entries.mapInArrow(_deal(kind, hashes, tables, probes, True), "dim int, key long, rep long, h1 long, n long, vec binary, codes binary").join(large, ["dim", "key"], "left")
    block = F.when(F.col("blocks").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("rep"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1).cast("long")) - 1))
    dealt = dealt.withColumn("block", block).withColumn("other", other).withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")}).drop("blocks", "other")
    group = ["dim", "key", "first", "second"]
    met = dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(_meet(kind, cosine, tables, probes), "x long, h1 long, y long, n long")
    found = scratch.cut(met, "found")
    edges = found.where("y IS NOT NULL").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    counts = found.where("n IS NOT NULL").groupBy(F.col("x").alias("rep"), "h1").agg(F.sum("n").alias("links"))
    judged = classes.join(counts, ["rep", "h1"], "left").select("h1", "h2", "n", "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    if edges.limit(1).count():
        comps = components(edges, scratch, "components").withColumnRenamed("x", "rep")
        judged = judged.join(comps, "rep", "left")
    else:
        judged = judged.withColumn("comp", F.lit(None).cast("long"))
    judged = scratch.cut(judged.select("h1", "h2", "n", "n_links", F.coalesce("comp", "rep").alias("comp")), "judged")
    out = join_totals(rows.where("vec IS NOT NULL").select("id", "h1", "h2"), judged, ["h1", "h2"], "n").select("id", "n_links", "comp")
    out = out.union(rows.where("vec IS NULL").select("id", F.lit(0).cast("long"), "id"))
    real = lambda c: F.when(F.col(c) != NOTHING, F.col(c))
    return out.select(real("id").alias("vec_id"), "n_links", real("comp").alias("component_id"), (F.col("id") == F.col("comp")).alias("kept"))


NEAR_VECTORS_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN CAST(embedding AS DOUBLE[]) END AS e FROM embeddings),
l AS (SELECT a.r, a.vec_id, b.vec_id AS other FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
c AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT c.vec_id, l.other FROM c JOIN l ON c.other = l.vec_id),
m AS (SELECT vec_id, min(other) AS component_id FROM c GROUP BY vec_id),
n AS (SELECT r, count(*) AS n_links FROM l GROUP BY r)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN m USING (vec_id) LEFT JOIN n USING (r)
"""
