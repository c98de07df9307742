"""Entities: mentions, first mentions, frequent names, and checks of a roster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import NOT_NAMES, alias_pattern, name_words, sentence_texts


def roster_table(spark: SparkSession, roster: list[dict]) -> DataFrame:
    """ord, canonical, names (canonical first, no repeats), is_suspect, pattern. A roster is a short hand-made list."""
    names = [list(dict.fromkeys(n for n in [c["canonical"], *c.get("aliases", [])] if n)) for c in roster]
    if len({c["canonical"] for c in roster}) != len(roster) or not all(c["canonical"] for c in roster):
        raise ValueError("canonical names must be unique and not empty")
    rows = [(i, c["canonical"], n, bool(c.get("is_suspect")), alias_pattern(n)) for i, (c, n) in enumerate(zip(roster, names, strict=True))]
    return spark.createDataFrame(rows, "ord int, canonical string, names array<string>, is_suspect boolean, pattern string")


def names_pattern(entity: dict) -> str:
    return alias_pattern(list(dict.fromkeys(n for n in [entity["canonical"], *entity.get("aliases", [])] if n)))


def mentions(chunked: DataFrame, roster: list[dict]) -> DataFrame:
    """doc_id, t and one row for each entity: whether any of its names is in the chunk.

    The roster is part of the plan: an array of literals with one compiled pattern each, so there is no join.
    """
    flags = F.array(*[F.struct(F.lit(c["canonical"]).alias("canonical"), F.rlike("text", F.lit(names_pattern(c))).alias("mentioned")) for c in roster])
    return chunked.select("doc_id", "t", F.inline(flags))


def first_mentions(chunked: DataFrame, roster: list[dict]) -> DataFrame:
    """doc_id, canonical, first_mention: the smallest t, null if never."""
    return mentions(chunked, roster).groupBy("doc_id", "canonical").agg(F.min(F.when(F.col("mentioned"), F.col("t"))).alias("first_mention"))


def candidates(roster: list[dict], which: str) -> list[str]:
    if which == "full_cast":
        return [c["canonical"] for c in roster]
    if which != "suspects_only":
        raise ValueError(f"unknown candidate set {which!r}")
    names = [c["canonical"] for c in roster if c.get("is_suspect")]
    if len(names) < 2:
        raise ValueError("suspects_only needs at least two suspects")
    return names


def candidate_table(roster: DataFrame) -> DataFrame:
    """doc_id, which, ord, canonical: both candidate sets of many documents. A document with fewer than two suspects has no
    suspects_only. roster: doc_id, ord, canonical, is_suspect."""
    few = Window.partitionBy("doc_id")
    named = roster.where("is_suspect").withColumns({"n": F.count(F.lit(1)).over(few), "ord": F.row_number().over(few.orderBy("ord")) - 1}).where("n >= 2")
    return roster.select("doc_id", F.lit("full_cast").alias("which"), "ord", "canonical").union(named.select("doc_id", F.lit("suspects_only"), "ord", "canonical"))


def name_counts(docs: DataFrame, key: str, separator: str = "\n") -> DataFrame:
    """key, word, n, first: capitalised words that begin no sentence and aren't in the list of common ones."""
    found = F.flatten(F.flatten(F.transform(F.split(F.coalesce("text", F.lit("")), separator), lambda p: F.transform(sentence_texts(p), name_words))))
    words = docs.select(key, F.col("doc_id").alias("_d"), F.posexplode(found).alias("at", "word")).where(~F.col("word").isin(NOT_NAMES))
    return words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_d", "at")).alias("first"))


def heuristic_roster(docs: DataFrame, key: str = "doc_id", most: int = 12, least: int = 3, separator: str = "\n") -> DataFrame:
    """The most frequent names of each key; among equals the one that comes first."""
    return most_frequent(name_counts(docs, key, separator), key, most, least)


def most_frequent(counts: DataFrame, key: str, most: int, least: int) -> DataFrame:
    """heuristic_roster of name_counts."""
    w = Window.partitionBy(key).orderBy(F.desc("n"), "first")
    return counts.where(F.col("n") >= least).withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= most).select(key, "ord", F.col("word").alias("canonical"), "n")


def missed_names(docs: DataFrame, roster: list[dict], key: str, least: int = 8, most: int = 15) -> DataFrame:
    """Frequent names that no alias holds."""
    import re

    known = sorted({w for c in roster for n in [c["canonical"], *c.get("aliases", [])] for w in re.findall(r"\w+", n)})
    w = Window.partitionBy(key).orderBy(F.desc("n"), "word")
    counts = name_counts(docs, key).where((F.col("n") >= least) & ~F.col("word").isin(known))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(key, "word", "n", "rank")


def pattern_of(names: Column, bounds: tuple[str, str] = (r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])")) -> Column:
    """alias_pattern of a column of names."""
    longest = F.array_sort(names, lambda a, b: F.length(b) - F.length(a))
    escaped = F.transform(longest, lambda n: F.regexp_replace(n, r"([.^$*+?()\[\]{}|\\])", r"\\$1"))
    return F.concat(F.lit(bounds[0] + "(?:"), F.array_join(escaped, "|"), F.lit(")" + bounds[1]))


def roster_warnings(docs: DataFrame, roster: DataFrame, separator: str = "\n", least: int = 8, most: int = 15, counts: DataFrame | None = None) -> DataFrame:
    """doc_id, kind, subject, n, detail: all that may be wrong with the rosters of many documents; nothing raises.

    duplicate_alias: a name (lower case) of n entities, which detail lists. over_merge: n sentences that use two names of an entity,
    the longest match winning, and the first of them. missed_name: one of the most frequent names that are in no alias, found n times.
    docs: doc_id, text; roster: doc_id, canonical, names. Documents without a roster have only missed names; null names are none.
    counts: doc_id, word, n of name_counts, where they are known.
    """
    named = roster.select("doc_id", "canonical", F.filter("names", lambda n: n.isNotNull() & (n != "")).alias("names"))
    owned = named.select("doc_id", "canonical", F.explode("names").alias("name"))
    owners = owned.groupBy("doc_id", F.lower("name").alias("subject")).agg(F.array_sort(F.collect_set("canonical")).alias("o")).where(F.size("o") > 1)
    doubled = owners.select("doc_id", F.lit("duplicate_alias").alias("kind"), "subject", F.size("o").cast("long").alias("n"), F.array_join("o", ", ").alias("detail"))

    whole = pattern_of(F.col("names"), (r"(?<![\p{L}\p{N}_])(?:", r")(?![\p{L}\p{N}_])"))
    cast = named.where(F.size("names") > 1).groupBy("doc_id").agg(F.collect_list(F.struct("canonical", "names", whole.alias("pattern"))).alias("cast"))  # a few entities a document
    each = docs.join(cast, "doc_id").select("doc_id", "cast", F.posexplode(F.flatten(F.transform(F.split(F.coalesce("text", F.lit("")), separator), sentence_texts))).alias("at", "s"))
    maybe = F.filter("cast", lambda c: F.size(F.filter(c["names"], lambda n: F.contains("s", n))) > 1)  # spares patterns most sentences
    hits = each.select("doc_id", "at", "s", F.explode(maybe).alias("c")).where(F.size(F.array_distinct(F.regexp_extract_all("s", F.col("c.pattern"), F.lit(0)))) > 1)
    merged = hits.groupBy("doc_id", F.col("c.canonical").alias("subject")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("at", "s"))["s"].alias("detail"))

    known = owned.select("doc_id", F.explode(F.split("name", r"[^\p{L}\p{N}_]+")).alias("word")).distinct()
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "word")
    missed = (name_counts(docs, "doc_id", separator) if counts is None else counts).where(F.col("n") >= least).join(known, ["doc_id", "word"], "left_anti").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    columns = ["doc_id", "kind", "subject", "n", "detail"]
    return doubled.union(merged.withColumn("kind", F.lit("over_merge")).select(columns)).union(missed.select("doc_id", F.lit("missed_name"), "word", "n", F.lit(None).cast("string")))


def duplicate_aliases(roster: DataFrame) -> DataFrame:
    """alias (lower case) and owners, where there are several. roster: canonical, names."""
    owned = roster.select("canonical", F.explode("names").alias("name")).groupBy(F.lower("name").alias("alias")).agg(F.array_sort(F.collect_set("canonical")).alias("owners"))
    return owned.where(F.size("owners") > 1)


def over_merges(docs: DataFrame, roster: list[dict], separator: str = "\n") -> DataFrame:
    """Per document and entity with several names: sentences that use two of them, and the first such sentence."""
    each = docs.select("doc_id", F.posexplode(F.flatten(F.transform(F.split(F.coalesce("text", F.lit("")), separator), sentence_texts))).alias("at", "s"))
    parts = []
    for c in roster:
        names = list(dict.fromkeys([c["canonical"], *c.get("aliases", [])]))
        if len(names) > 1:
            # Matches are cut out longest first, so a name inside a longer one doesn't count.
            left, used = F.concat(F.lit(" "), F.col("s"), F.lit(" ")), F.lit(0)
            for n in sorted(names, key=len, reverse=True):
                pattern = alias_pattern([n])
                used = used + F.rlike(left, F.lit(pattern)).cast("int")
                left = F.regexp_replace(F.regexp_replace(left, pattern, " # "), pattern, " # ")
            # A name is found nowhere else than in the sentence, so few need the patterns. One with the mark, or a space at its end, might be.
            if all(n == n.strip() and "#" not in n for n in names):
                some = sum((F.contains("s", F.lit(n)).cast("int") for n in names), F.lit(0)) >= 2
                used = F.when(some, used).otherwise(0)
            parts.append(F.struct(F.lit(c["canonical"]).alias("canonical"), used.alias("used")))
    hits = each.select("doc_id", "at", F.col("s").alias("sentence"), F.explode(F.filter(F.array(*parts), lambda x: x["used"] >= 2)["canonical"]).alias("canonical"))
    return hits.groupBy("doc_id", "canonical").agg(F.count(F.lit(1)).alias("n_sentences"), F.min_by("sentence", "at").alias("sample"))
