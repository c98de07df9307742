"""Near-duplicates by a multi-index Hamming join over MinHash signatures.

A signature has SYMBOLS b-bit MinHash values, cut into CHUNKS. Two signatures that differ in at most
CHUNKS * (ERRORS + 1) - 1 symbols have, by the pigeonhole principle, a chunk with at most ERRORS differences; every
choice of ERRORS symbols to leave out of a chunk is therefore enumerated as an index key, and all pairs under that
distance share a key. Candidates are confirmed on full shingle sets.

Texts of one shingle set are one class. In a key's group every member is compared with a pivot, the member that shares most
keys with others and so is nearest to being their source; components are joined, and only members that are still apart are
compared further: pairwise in small groups, by blocks in large ones. So a group of n near copies costs about n comparisons,
no group is gathered in one task, and no link between different texts that would join components is left out.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Words, mix

CHUNKS, WIDTH, ERRORS, BITS = 8, 5, 1, 16
SYMBOLS = CHUNKS * WIDTH
DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: Members of a group whose remaining pairs are listed, members of a block of larger groups, and bytes of text in one
#: comparison task's group.
SMALL, BLOCK, GROUP_BYTES = 24, 200, 4_000_000
_U = np.uint64
_RNG = np.random.default_rng(715517)
_A, _B = _RNG.integers(0, 2**64, SYMBOLS, dtype=_U) | _U(1), _RNG.integers(0, 2**64, SYMBOLS, dtype=_U)
_KEY = _RNG.integers(0, 2**64, WIDTH, dtype=_U) | _U(1)


def shingle_sets(texts: pa.Array, k: int) -> tuple[list[np.ndarray], Words]:
    """Sorted distinct shingle hashes of each text; a text of fewer words gives its whole sequence as one shingle."""
    w = Words(texts, lower=True)
    hashes, at = w.windows(k)
    cut = np.searchsorted(w.row[at], np.arange(len(w.count) + 1)) if len(at) else np.zeros(len(w.count) + 1, np.int64)
    out = []
    with np.errstate(over="ignore"):
        for i, n in enumerate(w.count.tolist()):
            if 0 < n < k:
                own = w.hash[0][w.first[i] : w.first[i] + n]
                out.append(mix(np.array([(own * _KEY[: len(own)]).sum(dtype=_U) + _U(n)], _U)) if n <= WIDTH else mix(np.array([np.bitwise_xor.reduce(mix(own + np.arange(n, dtype=_U)))], _U)))
            else:
                out.append(np.unique(hashes[cut[i] : cut[i + 1]]))
    return out, w


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The b-bit MinHash values of each set (empty sets: zeros)."""
    out = np.zeros((len(sets), SYMBOLS), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    flat = np.concatenate([sets[i] for i in full])
    starts = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
    with np.errstate(over="ignore"):
        for j in range(SYMBOLS):
            out[full, j] = mix(np.minimum.reduceat(mix(flat ^ _B[j]) * _A[j], starts)) >> _U(64 - BITS)
    return out


def index_keys(sig: np.ndarray) -> np.ndarray:
    """(rows, keys): one key for each chunk and each choice of symbols to leave out."""
    keys = []
    with np.errstate(over="ignore"):
        for c in range(CHUNKS):
            part = sig[:, c * WIDTH : (c + 1) * WIDTH].astype(_U)
            for left_out in combinations(range(WIDTH), ERRORS):
                kept = [i for i in range(WIDTH) if i not in left_out]
                total = np.full(len(sig), c * 64 + len(keys), _U)
                for i in kept:
                    total = mix(total * _KEY[i] + part[:, i])
                keys.append(total)
    return np.stack(keys, axis=1).view(np.int64)


def near(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    same = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * same >= percent * (len(a) + len(b) - same)


def _summaries(k: int):
    def rows(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets, _ = shingle_sets(batch.column(1), k)
                with np.errstate(over="ignore"):
                    marks = [[int(x.sum(dtype=_U).view(np.int64)), int(mix(x + _U(77)).sum(dtype=_U).view(np.int64))] for x in sets]
                marks_ = np.array(marks, np.int64).reshape(len(sets), 2)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(marks_[:, 0]), pa.array(marks_[:, 1]), pa.array([x.tobytes() for x in signatures(sets)], pa.binary())],
                    names=["id", "n", "s1", "s2", "sig"],
                )

    return rows


def _keys(batches):
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
        keys = index_keys(sig)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1]))], names=["key", "x"])


def _verify(k: int, percent: int):
    """Links between the pivot and the other texts of a group. An id may have several texts."""

    def rows(t: pa.Table) -> pa.Table:
        sets, _ = shingle_sets(t.column("text").combine_chunks(), k)
        ids, pivot = t.column("x").to_pylist(), t.column("pivot").to_pylist()[0]
        own = [s for x, s in zip(ids, sets, strict=True) if x == pivot]
        found = sorted({x for x, s in zip(ids, sets, strict=True) if x != pivot and any(near(p, s, percent) for p in own)})
        return pa.table({"a": pa.array([pivot] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    return rows


def _compare(k: int, percent: int):
    """Links that join what is still apart: the outsiders of a large group against a block of its members."""

    def rows(t: pa.Table) -> pa.Table:
        sets, _ = shingle_sets(t.column("text").combine_chunks(), k)
        ids, comp, outside = t.column("x").to_pylist(), t.column("comp").to_pylist(), t.column("outside").to_numpy(zero_copy_only=False)
        root = {c: c for c in comp}

        def find(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        a, b = [], []
        inside = np.flatnonzero(~outside)
        for i in np.flatnonzero(outside).tolist():
            for j in inside.tolist():
                if (p := find(comp[i])) != (q := find(comp[j])) and near(sets[i], sets[j], percent):
                    root[max(p, q)] = min(p, q)
                    a.append(ids[i])
                    b.append(ids[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """x, comp: the smallest node that each node of links a-b reaches, by label spreading and pointer jumping."""
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select(F.col("b"), F.col("a"))).distinct()
    both = scratch.cut(both, f"{name}-edges")
    labels = scratch.cut(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("comp")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        seen = both.join(labels.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("comp").alias("c"))
        better = labels.join(seen, "x").select("x", F.least("comp", "c").alias("comp"), F.col("comp").alias("old"))
        jump = labels.select(F.col("x").alias("comp"), F.col("comp").alias("far"))
        after = scratch.cut(better.join(jump, "comp").select("x", F.least("comp", "far").alias("comp"), "old"), f"{name}-{turn}")
        changed = after.where("comp <> old").limit(1).count()
        labels = after.select("x", "comp")
        scratch.drop(f"{name}-{turn - 1}")
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: components of texts whose shingle sets have a Jaccard index of percent / 100 or more.

    Words are runs of anything but ASCII white space, with A-Z lower-cased; shingles are k of them. A text of fewer words
    is one shingle; null, empty or blank text has none, links with nothing and is kept. A null id comes before all others
    and stays null. Rows that repeat an id stay; each is judged by its own set, and as a partner the id has all its texts.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    nothing = -(1 << 62)
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(nothing)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marked = scratch.cut(source.mapInArrow(_summaries(k), "id long, n long, s1 long, s2 long, sig binary"), "marked")
    classes = marked.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.min_by("sig", "id").alias("sig"))
    classes = scratch.cut(classes, "classes")
    index = classes.select("rep", "sig").mapInArrow(_keys, "key long, x long")
    many = index.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo <> hi").select("key", "size")
    members = scratch.cut(index.join(many, "key"), "members")
    live = members.select("x").distinct()
    texts = scratch.cut(source.join(live, F.col("id") == F.col("x"), "left_semi").distinct().select(F.col("id").alias("x"), "text"), "texts")
    known = members.groupBy("x").agg(F.sum("size").alias("known"))
    pivots = members.join(known, "x").groupBy("key").agg(F.max_by("x", F.struct(F.col("known"), -F.col("x"))).alias("pivot"))
    tried = scratch.cut(members.join(pivots, "key").where("x <> pivot").select("pivot", "x").distinct(), "tried")
    links = scratch.cut(_star(tried, texts, k, percent), "links")
    labels = components(links, scratch, "first")
    comps = live.join(labels, "x", "left").select("x", F.coalesce("comp", "x").alias("comp"))
    apart = members.join(comps, "x")
    open_ = apart.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    apart = scratch.cut(apart.join(open_, "key"), "apart")
    small = apart.where(F.col("size") <= SMALL)
    other = small.select("key", F.col("x").alias("pivot"), F.col("comp").alias("pivot_comp"))
    pairs = small.where("size > 2").join(other, "key").where("pivot < x AND comp <> pivot_comp").select("pivot", "x").distinct()
    for way in (["pivot", "x"], ["x", "pivot"]):
        pairs = pairs.join(tried.select(F.col(way[0]).alias("pivot"), F.col(way[1]).alias("x")), ["pivot", "x"], "left_anti")
    more = _star(scratch.cut(pairs, "pairs"), texts, k, percent).union(_large(apart.where(F.col("size") > SMALL), texts, k, percent))
    more = scratch.cut(more, "more")
    if more.limit(1).count():
        labels = components(links.union(more), scratch, "second")
        comps = live.join(labels, "x", "left").select("x", F.coalesce("comp", "x").alias("comp"))
    result = marked.where("n > 0").join(classes.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"]).select("id", "n", "rep")
    result = result.join(comps.select(F.col("x").alias("rep"), "comp"), "rep", "left").select("id", "n", F.coalesce("comp", "rep").alias("comp"))
    result = result.union(marked.where("n = 0").select("id", "n", F.col("id").alias("comp")))
    out = result.select(F.when(F.col("id") != nothing, F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("comp") != nothing, F.col("comp")).alias("component_id"), (F.col("id") == F.col("comp")).alias("kept"))
    return out


def _star(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Confirms pairs: the texts compared with one pivot meet in groups of bounded bytes, each with a copy of the pivot's."""
    sized = pairs.join(texts, "x").select("pivot", "x", "text")
    load = pairs.join(texts.select("x", F.octet_length("text").alias("bytes")), "x").groupBy("pivot").agg(F.ceil(F.sum("bytes") / F.lit(GROUP_BYTES)).alias("salts"))
    others = sized.join(load, "pivot").select("pivot", F.pmod(F.xxhash64("x"), F.col("salts")).alias("salt"), "x", "text")
    own = load.join(texts.withColumnRenamed("x", "pivot"), "pivot").select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("pivot").alias("x"), "text")
    return others.union(own).groupBy("pivot", "salt").applyInArrow(_verify(k, percent), "a long, b long")


def _large(apart: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Groups with more than SMALL members: those outside the group's largest component against all, block by block.

    A member is dealt once for each block of outsiders and an outsider once for each block of members, so a group of which
    all but a few are joined costs about what its size is.
    """
    parts = apart.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("n"))
    main = main.where("all > n").select("key", "main", F.ceil(F.col("all") / BLOCK).alias("blocks"), F.ceil((F.col("all") - F.col("n")) / BLOCK).alias("out_blocks"))
    rows = apart.select("key", "x", "comp").join(main, "key").withColumn("own", F.xxhash64("x"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    members = rows.select("key", "x", "comp", F.lit(False).alias("outside"), F.pmod("own", F.col("blocks")).alias("block"), every("out_blocks").alias("out_block"))
    outsiders = rows.where("comp <> main").select("key", "x", "comp", F.lit(True).alias("outside"), every("blocks").alias("block"), F.pmod("own", F.col("out_blocks")).alias("out_block"))
    return members.union(outsiders).join(texts, "x").groupBy("key", "block", "out_block").applyInArrow(_compare(k, percent), "a long, b long")
