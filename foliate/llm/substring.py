"""Substring dedup by fixed-block anchors.

A repeat of 13 words holds a whole aligned block of 7 words wherever it starts, so every document is indexed by its
non-overlapping 7-word blocks and probes that index with every rolling 7-word window. A hit is extended to its maximal
repeat: the 13-word windows around it that an earlier document also has, all of whose words then go.

No pair of documents is ever formed, so groups of copies cost what their size is. Documents lie in cells of a few MB;
a cell sends distinct window hashes as packed, sorted arrays to buckets of the hash range, and a bucket sends back one
bit a hash. Both grow in number with the data, so each stays in memory. Hashes of hits (48 bits) only choose what is
looked at; repeats themselves are told by 128 bits.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, partitions

WINDOW, BLOCK = 13, 7
CELL_BYTES, BUCKET_WORDS = 2_000_000, 3_000_000
LAST = np.iinfo(np.int64).max
_U = np.uint64
BITS = "cell long, kind int, bucket long, bits binary"
PACKED = "bucket long, cell long, n long, packed binary, flags binary"


def pack(values: np.ndarray) -> bytes:
    """Sorted or similar integers as differences, by planes of bytes, compressed."""
    with np.errstate(over="ignore"):
        steps = np.diff(values, prepend=values.dtype.type(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(len(values), -1).T).tobytes())


def unpack(data: bytes, n: int, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(-1, n)
    with np.errstate(over="ignore"):
        return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


@lru_cache(4)
def edges(buckets: int, bits: int) -> np.ndarray:
    return np.array([(i << bits) // buckets for i in range(buckets)], _U)


def spans(values: np.ndarray, buckets: int, bits: int) -> list[tuple[int, int, int]]:
    """The buckets that sorted values fall in: bucket, from, to."""
    cuts = np.append(np.searchsorted(values, edges(buckets, bits)), len(values))
    return [(int(b), int(cuts[b]), int(cuts[b + 1])) for b in np.flatnonzero(np.diff(cuts))]


class Cell:
    """The documents of a cell, in order of id."""

    def __init__(self, docs: pa.Table):
        self.docs = docs.combine_chunks().sort_by("id")
        self.ids = self.docs.column("id").to_numpy()
        texts = self.docs.column("text").combine_chunks()
        self.words = Words(texts.chunk(0) if isinstance(texts, pa.ChunkedArray) and texts.num_chunks else texts, keys=2)

    def probes(self) -> None:
        """All rolling windows of a block's length, and for each distinct hash: is it an aligned block, has it two documents."""
        w = self.words
        full, self.at = w.windows(BLOCK)
        hashes = full >> _U(16)
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        new = np.flatnonzero(np.diff(ordered, prepend=ordered[:1] ^ _U(1))) if len(ordered) else np.zeros(0, np.int64)
        self.distinct = ordered[new]
        self.which = np.empty(len(hashes), np.int64)
        if len(hashes):
            self.which[order] = np.cumsum(np.diff(ordered, prepend=ordered[:1]) != 0)
            rows = self.ids[w.row[self.at]][order]
            aligned = ((self.at - w.first[w.row[self.at]]) % BLOCK == 0)[order]
            self.aligned = np.logical_or.reduceat(aligned, new)
            self.multi = np.minimum.reduceat(rows, new) != np.maximum.reduceat(rows, new)
        else:
            self.aligned = self.multi = np.zeros(0, bool)

    def windows(self, hot: np.ndarray) -> None:
        """The full windows that hold a hot block, and for each distinct one the smallest id that has it here."""
        w, n = self.words, len(self.words.starts)
        first, at = w.windows(WINDOW)
        flags = np.zeros(n + 1, np.int64)
        flags[self.at + 1] = hot[self.which]
        total = np.cumsum(flags)
        near = total[at + WINDOW - BLOCK + 1] > total[at]
        self.start = at[near]
        one, two = first[near], w.windows(WINDOW, 1)[0][near]
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        change = np.ones(len(one), bool)
        change[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        new = np.flatnonzero(change)
        self.one, self.two = one[new], two[new]
        self.of = np.empty(len(one), np.int64)
        self.of[order] = np.cumsum(change) - 1
        self.least = np.minimum.reduceat(self.ids[w.row[self.start]][order], new) if len(new) else np.zeros(0, np.int64)


def bits_of(rows: pa.Table, kind: int, parts: list[tuple[int, int, int]], n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    found = {b.as_py(): x.as_py() for b, x, k in zip(rows.column("bucket"), rows.column("bits"), rows.column("kind"), strict=True) if k.as_py() == kind}
    for b, a, z in parts:
        if b in found:
            out[a:z] = np.unpackbits(np.frombuffer(found[b], np.uint8), count=z - a)
    return out


def _table(schema: str, columns: list[list]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept: each text without the words of windows that start in an earlier document too.

    Words are runs of anything but ASCII white space; kept words are joined by one space. Null or empty text: no words,
    empty kept. A null id comes after all others and stays null. Rows with one id count as one document when windows
    are compared, so repeated rows keep their text and stay. Other columns are ignored.
    """
    spark = docs.sparkSession
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(LAST))).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    cells = max(4 * partitions(spark), -(-size // CELL_BYTES))
    buckets = max(partitions(spark), -(-size // (6 * BUCKET_WORDS)))
    dealt = source.withColumn("cell", F.pmod(F.xxhash64("id", "text"), F.lit(cells)))

    def send(docs: pa.Table) -> pa.Table:
        cell, number = Cell(docs), docs.column("cell")[0].as_py()
        cell.probes()
        rows = [
            (b, number, z - a, pack(cell.distinct[a:z]), np.packbits(np.concatenate([cell.aligned[a:z], cell.multi[a:z]])).tobytes())
            for b, a, z in spans(cell.distinct, buckets, 48)
        ]
        return _table(PACKED, list(zip(*rows, strict=True)) or [[]] * 5)

    def meet(rows: pa.Table) -> pa.Table:
        """A hash is hot if it is an aligned block somewhere and occurs in another document."""
        ns = rows.column("n").to_pylist()
        keys = np.concatenate([unpack(x.as_py(), n, _U) for x, n in zip(rows.column("packed"), ns, strict=True)])
        flags = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=2 * n).reshape(2, n).astype(bool) for x, n in zip(rows.column("flags"), ns, strict=True)]
        aligned, multi = np.concatenate(flags, axis=1)
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        change = np.ones(len(keys), bool)
        change[1:] = ordered[1:] != ordered[:-1]
        new = np.flatnonzero(change)
        hot = np.logical_or.reduceat(aligned[order], new) & ((np.diff(new, append=len(keys)) > 1) | np.logical_or.reduceat(multi[order], new))
        back = np.empty(len(keys), bool)
        back[order] = hot[np.cumsum(change) - 1]
        return answer(rows, ns, back, 0)

    def answer(rows: pa.Table, ns: list[int], back: np.ndarray, kind: int) -> pa.Table:
        out, at = [], 0
        for cell, bucket, n in zip(rows.column("cell").to_pylist(), rows.column("bucket").to_pylist(), ns, strict=True):
            own = back[at : at + n]
            at += n
            if own.any():
                out.append((cell, kind, bucket, np.packbits(own).tobytes()))
        return _table(BITS, list(zip(*out, strict=True)) or [[]] * 4)

    def extend(docs: pa.Table, hits: pa.Table) -> pa.Table:
        if not docs.num_rows or not hits.num_rows:
            return _table(PACKED, [[]] * 5)
        cell, number = Cell(docs), docs.column("cell")[0].as_py()
        cell.probes()
        cell.windows(bits_of(hits, 0, spans(cell.distinct, buckets, 48), len(cell.distinct)))
        rows = []
        for b, a, z in spans(cell.one, buckets, 64):
            packed = [pack(x[a:z]) for x in (cell.one, cell.two, cell.least)]
            rows.append((b, number, z - a, b"".join(packed), np.array([len(x) for x in packed], np.int64).tobytes()))
        return _table(PACKED, list(zip(*rows, strict=True)) or [[]] * 5)

    def judge(rows: pa.Table) -> pa.Table:
        """A bit for each window that a smaller id has in another cell."""
        ns = rows.column("n").to_pylist()
        parts: list[list[np.ndarray]] = [[], [], []]
        for data, lengths, n in zip(rows.column("packed"), rows.column("flags"), ns, strict=True):
            data, at = data.as_py(), 0
            for part, length, kind in zip(parts, np.frombuffer(lengths.as_py(), np.int64), (_U, _U, np.int64), strict=True):
                part.append(unpack(data[at : at + int(length)], n, kind))
                at += int(length)
        one, two, least = (np.concatenate(p) for p in parts)
        order = np.lexsort((two, one))
        change = np.ones(len(one), bool)
        a, b = one[order], two[order]
        change[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        best = np.minimum.reduceat(least[order], np.flatnonzero(change))
        back = np.empty(len(one), bool)
        back[order] = best[np.cumsum(change) - 1] < least[order]
        return answer(rows, ns, back, 1)

    def remove(docs: pa.Table, found: pa.Table) -> pa.Table:
        names = ["id", "n_words", "n_removed", "kept"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        if not docs.num_rows:
            return pa.table({n: pa.array([], k) for n, k in zip(names, kinds, strict=True)})
        cell = Cell(docs)
        w = cell.words
        gone = np.zeros(len(w.starts) + 1, np.int64)
        if found.num_rows:
            cell.probes()
            cell.windows(bits_of(found, 0, spans(cell.distinct, buckets, 48), len(cell.distinct)))
            earlier = bits_of(found, 1, spans(cell.one, buckets, 64), len(cell.one))
            starts = cell.start[earlier[cell.of] | (cell.least[cell.of] < cell.ids[w.row[cell.start]])]
            np.add.at(gone, starts, 1)
            np.add.at(gone, starts + WINDOW, -1)
        gone = np.cumsum(gone)[:-1] > 0
        removed = np.concatenate([[0], np.cumsum(gone)])
        n_removed = removed[w.first[1:]] - removed[w.first[:-1]]
        kept = []
        for i, n in enumerate(n_removed.tolist()):
            own = w.text(i).split()
            if n:
                own = [x for x, g in zip(own, gone[w.first[i] : w.first[i + 1]].tolist(), strict=True) if not g]
            kept.append(b" ".join(own))
        return pa.table(dict(zip(names, [pa.array(cell.ids), pa.array(w.count), pa.array(n_removed), pa.array(kept, pa.binary()).cast(pa.string())], strict=True)))

    hits = dealt.groupBy("cell").applyInArrow(send, PACKED).groupBy("bucket").applyInArrow(meet, BITS).repartition("cell")
    windows = dealt.groupBy("cell").cogroup(hits.groupBy("cell")).applyInArrow(extend, PACKED)
    earlier = windows.groupBy("bucket").applyInArrow(judge, BITS)
    out = dealt.groupBy("cell").cogroup(hits.unionByName(earlier).groupBy("cell")).applyInArrow(remove, "id long, n_words long, n_removed long, kept string")
    return out.select(F.when(F.col("id") != int(LAST), F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept")


REMOVE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d),
m AS (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(ws[i:i + 12], ' ')) AS least FROM s),
g AS (SELECT DISTINCT r, i + o AS p FROM m, range(13) AS o(o) WHERE least < doc_id),
c AS (SELECT r, count(*) AS n FROM g GROUP BY r),
w AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
k AS (SELECT r, string_agg(w, ' ' ORDER BY p) AS kept FROM w ANTI JOIN g USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN c USING (r) LEFT JOIN k USING (r)
"""
