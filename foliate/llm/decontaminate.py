"""Benchmark decontamination by winnowing, native throughout.

Of every GUARANTEE - K + 1 consecutive K-grams one of least hash is kept as a fingerprint of a document, and all of least
hash as fingerprints of an item, so a document and an item that share GUARANTEE words share a fingerprint at the same place
of both. Fingerprints are joined; each hit names an offset between item and document, along which it is extended word by
word to full windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small
from .native import let, parted, upto, words
from .url_filter import LOWER, UPPER

GUARANTEE, K = 10, 7
SPAN = GUARANTEE - K + 1
#: Low bits of a hash that hold its place, so that a window's least value also tells where it is.
PLACE = 16
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return words(F.translate(text, UPPER, LOWER), SEPARATORS)


def _grams(ws: Column) -> Column:
    """K-gram hashes, each with its place modulo PLACE in the low bits."""
    return F.transform(upto(F.size(ws) - K + 1), lambda i: F.xxhash64(F.slice(ws, i, K)).bitwiseAND(F.lit(-PLACE)).bitwiseOR(i.cast("long").bitwiseAND(F.lit(PLACE - 1))))


def _least(grams: Column, n: Column) -> Column:
    """The least value of each window of SPAN grams."""
    return F.transform(upto(n - GUARANTEE + 1), lambda i: F.least(*[F.get(grams, i + (j - 1)) for j in range(SPAN)]))


def _fingerprints(ws: Column, short: list[int]) -> Column:
    """Array of (p, h): places from 1 and hashes. Lengths in short get all their grams, as short items are whole windows."""
    n = F.size(ws)

    def place(x: Column, start: Column) -> Column:
        return start + F.pmod(x.bitwiseAND(F.lit(PLACE - 1)).cast("int") - start, F.lit(PLACE))

    def changes(m: Column) -> Column:
        return F.array_compact(F.transform(m, lambda x, i: F.when((i == 0) | (F.get(m, i - 1) != x), F.struct(place(x, i + 1).alias("p"), x.bitwiseAND(F.lit(-PLACE)).alias("h")))))

    def grams(m: int) -> Column:
        return F.transform(upto(n - m + 1), lambda i: F.struct(i.alias("p"), F.xxhash64(F.lit(m), F.slice(ws, i, m)).alias("h")))

    parts = [let(_grams(ws), lambda g: let(_least(g, n), changes)), *map(grams, short)]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _item_fingerprints(ws: Column) -> Column:
    """Array of (q, h) of an item: all places of least hash in each window."""
    n = F.size(ws)
    bare = lambda x: x.bitwiseAND(F.lit(-PLACE))

    def ties(g: Column) -> Column:
        def window(i: Column) -> Column:
            own = F.sequence(i, i + (SPAN - 1))
            return let(F.array_min(F.transform(own, lambda q: bare(F.get(g, q - 1)))), lambda least: F.filter(own, lambda q: bare(F.get(g, q - 1)) == least))

        return F.transform(F.array_distinct(F.flatten(F.transform(upto(n - GUARANTEE + 1), window))), lambda q: F.struct(q.alias("q"), bare(F.get(g, q - 1)).alias("h")))

    return let(_grams(ws), ties)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document: n_words, n_hit words inside windows of any item, n_items with such windows, their ids, contaminated.

    A window is GUARANTEE consecutive words of an item, or a whole shorter item. Null or empty text has no words; items
    without words have no window. Rows of one document id are judged each by its own text. A null item id counts as an
    item whose id is shown as "null". An empty benchmark hits nothing. Other columns are ignored.
    """
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), _words(F.col(item_text_col)).alias("iw")).where("size(iw) > 0")
    short = sorted(r[0] for r in items.where(F.size("iw") < GUARANTEE).select(F.size("iw")).distinct().collect())  # nine at most
    texts = items.groupBy("iw").agg(F.collect_set("item").alias("ids")).withColumn("ikey", F.xxhash64("iw"))
    long_ = texts.select("ikey", F.inline(_item_fingerprints(F.col("iw"))).alias("q", "h"))
    whole = texts.where(F.size("iw") < GUARANTEE).select("ikey", F.lit(1).alias("q"), F.xxhash64(F.size("iw"), "iw").alias("h"))
    index = broadcast_if_small(long_.union(whole))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = source.select("doc_id", F.inline(let(_words(F.col("text")), lambda ws: _fingerprints(ws, short))).alias("p", "h"))
    hits = prints.join(index, "h").select("doc_id", "ikey", (F.col("p") - F.col("q")).alias("offset")).distinct()
    hits = hits.groupBy("doc_id", "ikey").agg(F.collect_set("offset").alias("offsets"))
    hits = hits.join(broadcast_if_small(texts), "ikey").groupBy("doc_id").agg(F.collect_list(F.struct("iw", "ids", "offsets")).alias("hits"))

    def windows(ws: Column) -> Column:
        """Of each hit: its item and the places of the document that its windows cover."""

        def one(hit: Column) -> Column:
            m = F.least(F.size(hit["iw"]), F.lit(GUARANTEE))
            starts = lambda o: F.filter(upto(F.size(hit["iw"]) - m + 1), lambda s: (s + o >= 1) & (s + o + m - 1 <= F.size(ws)) & (F.slice(ws, F.greatest(s + o, F.lit(1)), m) == F.slice(hit["iw"], s, m)))
            places = F.flatten(F.transform(hit["offsets"], lambda o: F.flatten(F.transform(starts(o), lambda s: F.sequence(s + o, s + o + m - 1)))))
            return F.struct(hit["ids"].alias("ids"), places.alias("places"))

        return F.filter(F.transform("hits", one), lambda x: F.size(x["places"]) > 0)

    # Only texts that may have a hit are shuffled.
    scratch = Scratch(docs.sparkSession)
    hits = scratch.cut(hits, "hits")
    maybe, clean = parted(source, ["doc_id"], hits.select("doc_id"), scratch, "hits-bloom")
    joined = maybe.join(hits.withColumnRenamed("doc_id", "of"), F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", "text", "hits")
    joined = joined.union(clean.select("doc_id", "text", F.lit(None).cast(hits.schema["hits"].dataType)))
    judged = joined.select(
        "doc_id",
        let(_words(F.col("text")), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), F.when(F.col("hits").isNotNull(), windows(ws)).alias("found"))).alias("r"),
    )
    ids = F.coalesce(F.array_sort(F.array_distinct(F.flatten("r.found.ids"))), F.array().cast("array<string>"))
    hit = F.when(F.col("r.found").isNull(), F.lit(0)).otherwise(F.size(F.array_distinct(F.flatten("r.found.places")))).cast("long")
    out = judged.select("doc_id", "r.n_words", hit.alias("n_hit"), ids.alias("item_ids"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids", (F.col("n_hit") > 0).alias("contaminated"))



DECONTAMINATE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
v AS (SELECT DISTINCT item_id, least(len(ws), 10) AS m, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda i: array_to_string(ws[i:i + 9], ' '))) AS w FROM b WHERE len(ws) > 0),
ms AS (SELECT DISTINCT m FROM v),
g AS (SELECT r, m, i, array_to_string(ws[i:i + m - 1], ' ') AS w FROM (SELECT r, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, ms)),
h AS (SELECT g.r, g.m, g.i, v.item_id FROM g JOIN v USING (m, w)),
p AS (SELECT r, count(DISTINCT i + o) AS n FROM (SELECT DISTINCT r, m, i FROM h) AS x, range(10) AS o(o) WHERE o < m GROUP BY r),
t AS (SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(p.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)
"""
