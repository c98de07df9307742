"""Periodic runs: stretches of words that repeat with a period, found by a suffix automaton.

A state of the automaton stands for word sequences that end at the same places. Walking from the longest states to their
suffix links, the ordered sets of end positions are merged small to large; where a new neighbour lies no further off than
the state is long, the two ends seed a square, and the square is extended to a run.

What the automaton is built over is first cut down to where runs can be. A run has length >= max(24, 3 * period), so at least
2 * period + 7 words; every 8 words inside it occur again one period on or back, inside it. Stretches of repeated 8-word
windows hold all runs whole, and a text without a repeated window, which is most of them, has none. Windows are told by hashes: a
collision only lengthens a stretch.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import let

LEAST, TIMES, WINDOW = 24, 3, 8
#: No run of LEAST words or TIMES periods has fewer words than this besides its period, so shorter states seed none.
SEED = min(max(LEAST, TIMES * q) - q for q in range(1, LEAST))
_MULT = [int(x) | 1 for x in np.random.default_rng(60317).integers(0, 2**63, WINDOW + 1)]
FLUSH_ROWS, FLUSH_BYTES = 500, 8_000_000
RUNS = "array<struct<start: long, length: long, period: long>>"


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """The parts, from and to, in which every window of WINDOW words occurs twice in that part: all runs lie inside one."""
    out, open_ = [], [(0, len(ids))]
    with np.errstate(over="ignore"):
        mixed = ids.astype(np.uint64) * np.uint64(_MULT[WINDOW])
        mixed ^= mixed >> np.uint64(29)
        hashes = sum(mixed[j : len(ids) - WINDOW + 1 + j] * np.uint64(_MULT[j]) for j in range(WINDOW)) if len(ids) >= LEAST else mixed[:0]
    while open_:
        a, z = open_.pop()
        if z - a < LEAST:
            continue
        own = hashes[a : z - WINDOW + 1]
        ordered = np.sort(own)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            continue
        again = np.zeros(len(own) + 2, np.int8)
        again[1:-1] = twice[np.minimum(np.searchsorted(twice, own), len(twice) - 1)] == own
        edge = np.diff(again)
        parts = list(zip((a + np.flatnonzero(edge == 1)).tolist(), (a + np.flatnonzero(edge == -1) + WINDOW - 1).tolist(), strict=True))
        if parts == [(a, z)]:
            out.append((a, z))
        else:
            open_ += parts
    return sorted(out)


def automaton(words: list[int]) -> tuple[array, array, array]:
    """Lengths, suffix links, and end positions (-1: a clone, which ends where those linked to it do) of the states. Most states
    have one way on, kept in two arrays; only others have a dict."""
    length, link, end, word, to = (array("i", [x]) for x in (0, -1, -1, -1, -1))
    more: dict[int, dict[int, int]] = {}
    last = 0
    for i, c in enumerate(words):
        state = len(length)
        length.append(i + 1)
        link.append(0)
        end.append(i)
        word.append(-1)
        to.append(-1)
        p, q = last, -1
        while p >= 0:
            if word[p] == c:
                q = to[p]
                break
            if word[p] < 0:
                word[p], to[p] = c, state
            elif p not in more:
                more[p] = {c: state}
            elif (q := more[p].get(c, -1)) >= 0:
                break
            else:
                more[p][c] = state
            p = link[p]
        if p >= 0:
            if length[q] != length[p] + 1:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                word.append(word[q])
                to.append(to[q])
                if q in more:
                    more[clone] = dict(more[q])
                link[q] = clone
                while p >= 0:
                    if word[p] == c:
                        if to[p] != q:
                            break
                        to[p] = clone
                    elif p in more and more[p].get(c) == q:
                        more[p][c] = clone
                    else:
                        break
                    p = link[p]
                q = clone
            link[state] = q
        last = state
    return length, link, end


def _join(large: list[int], small: list[int]) -> None:
    """Puts small, in order, into large, in order."""
    if not large or small[0] > large[-1]:
        large += small
    elif len(small) < 12:
        for x in small:
            insort(large, x)
    else:
        large += small
        large.sort()  # two ordered halves: one merge


def runs(words: list[int]) -> list[tuple[int, int, int]]:
    """Start, length and smallest period of every run, by start and period.

    Sets hold negated ends, as a state's own end comes before all others and so is appended. A pair of neighbours of a
    complete set at distance d, under a state of length n, says that the n words before each are the same. It is the pair of
    a run, of d + n words, if neither side goes on: the word before differs, and so does the word after. Other pairs seed
    squares inside that run, from which extending leads to the same one.
    """
    length, link, end = automaton(words)
    sets: dict[int, list[int]] = {}
    fresh: dict[int, list[int]] = {}
    found, n_words = set(), len(words)
    for state in np.argsort(-np.frombuffer(length, np.int32), kind="stable").tolist():
        n = length[state]
        if n < SEED:
            break
        ends, new = sets.pop(state, None), fresh.pop(state, [])
        if end[state] >= 0:
            if ends is None:
                ends = [-end[state]]
            else:
                _join(ends, [-end[state]])
                new.append(-end[state])
        for x in new:
            at = bisect_left(ends, x)
            for k in (at - 1, at):
                if not 0 <= k < len(ends) - 1:
                    continue
                last, first = -ends[k], -ends[k + 1]
                d = last - first
                if d > n or n + d < LEAST or n + d < TIMES * d:
                    continue
                if last + 1 < n_words and words[last + 1] == words[first + 1] or first >= n and words[first - n] == words[last - n]:
                    continue
                found.add((first - n + 1, n + d, d))
        parent = link[state]
        if length[parent] >= SEED:
            other = sets.get(parent)
            if other is None:
                sets[parent] = ends
            else:
                large, small = (other, ends) if len(other) >= len(ends) else (ends, other)
                fresh.setdefault(parent, []).extend(small)
                _join(large, small)
                sets[parent] = large
    return sorted(found, key=lambda r: (r[0], r[2]))


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """The runs of a text's words."""
    if len(words) < LEAST:
        return []
    number = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    return [(a + s, n, q) for a, z in stretches(ids) for s, n, q in runs(ids[a:z].tolist())]


def _rows(batches):
    def flush():
        kinds = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), pa.string()]
        arrays = [pa.array(c, k) for c, k in zip(list(zip(*out, strict=True))[1:], kinds, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), *arrays], names=["doc_id", "n_words", "runs", "collapsed"])

    out, held = [], 0
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        for i, text in zip(batch.column(0).to_pylist(), texts, strict=True):
            words = (text.as_py() or b"").split()  # bytes split at the six ASCII white space characters
            found = runs_of(words)
            kept = words
            if found:
                gone = np.zeros(len(words) + 1, np.int64)
                for s, n, q in found:
                    gone[s + q] += 1
                    gone[s + n] -= 1
                kept = [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]
            joined = b" ".join(kept).decode()
            out.append((i, len(words), [{"start": s, "length": n, "period": q} for s, n, q in found], joined))
            held += len(joined)
            if len(out) >= FLUSH_ROWS or held >= FLUSH_BYTES:
                yield flush()
                out, held = [], 0
    if out:
        yield flush()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed: what repeats in each text.

    Words are runs of anything but ASCII white space, unchanged. A run is a stretch of words with smallest period q and length
    of at least max(24, 3 * q) that no neighbouring word extends. collapsed leaves out every word that some run contains
    after its first q words. Null, empty or blank text has no words, no runs and an empty collapsed. Null ids stay null; rows
    that repeat an id stay, each by its own text. An empty table gives no rows. Other columns are ignored. Memory follows the
    longest text, about 100 bytes for each of its repeated words.
    """
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_rows, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; the first of equals. Null if there are none."""
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(more(r, best), r).otherwise(best))


def plant(docs: DataFrame) -> DataFrame:
    """doc_id, text: every tenth text by hash of its id gets a periodic tail, as the query's contract has it."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
        return let(F.struct(a.cast("int").alias("a"), p.cast("int").alias("p")), lambda v: F.transform(w, lambda x, i: F.when(i < v["a"], x).otherwise(F.get(w, v["a"] + F.pmod(i - v["a"], v["p"])))))

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    changed = let(words, lambda w: F.when(F.size(w) > 0, F.array_join(tail(w), " ")).otherwise(F.lit("")))
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


#: The query's rows. Runs of equal 8-word windows at one distance are the islands that gaps-and-islands finds.
RUNS_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
  xor(list_reduce(list_transform(regexp_extract_all(CAST(doc_id AS VARCHAR), '.'), lambda c: CAST(ord(c) AS BIGINT)),
    lambda a, c: list_reduce(CAST(range(8) AS BIGINT[]), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(a, c)), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM documents),
u AS (SELECT r, doc_id, ws, len(ws) AS n, h, (h // 10) % greatest(len(ws), 1) AS a, (h // 10) % 8 AS g FROM t),
d AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g)) END]) ELSE ws END AS ws FROM u),
g AS (SELECT r, n, unnest(range(n - 7)) AS i, unnest(list_transform(range(n - 7), lambda i: array_to_string(ws[i + 1:i + 8], ' '))) AS k FROM d WHERE n >= 24),
e AS (SELECT x.r, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.r = y.r AND x.k = y.k AND x.i < y.i AND 3 * (y.i - x.i) <= x.n),
o AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM e),
p AS (SELECT r, q, min(i) AS s, count(*) + 7 + q AS l FROM o GROUP BY r, q, island HAVING count(*) + 7 + q >= greatest(24, 3 * q)),
f AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p z WHERE z.r = p.r AND z.q < p.q AND z.s <= p.s AND z.s + z.l >= p.s + p.l)),
c AS (SELECT r, count(*) AS n_runs, string_agg(concat(s, ',', l, ',', q, chr(10)), '' ORDER BY s, q) AS listed, first(struct_pack(s := s, l := l, q := q) ORDER BY CAST(l AS DOUBLE) / q DESC, s, q) AS best FROM f GROUP BY r),
w AS (SELECT r, unnest(ws) AS w, unnest(range(n)) AS i FROM d),
k AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS kept FROM w WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.r = w.r AND w.i >= f.s + f.q AND w.i < f.s + f.l) GROUP BY r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period, CAST(1000 * best.l // best.q AS BIGINT) AS exponent_milli,
sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN c USING (r) LEFT JOIN k USING (r)
"""
