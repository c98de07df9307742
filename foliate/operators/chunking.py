"""Greedy chunking of paragraphs and what is derived from chunks. Everything is a fold within a row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, sentence_texts, token_count, word_count

RANGE = "struct<t:int,para_from:int,para_to:int,word_count:int,word_to:bigint>"


def paragraphs(docs: DataFrame, separator: str = "\n\\s*\n", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, paras: the paragraphs of each document. Books use blank lines, other texts may pass one line break."""
    return docs.select(F.col(id_col).alias("doc_id"), F.split(F.coalesce(F.col(text_col), F.lit("")), separator).alias("paras"))


def chunk_ranges(counts: Column, target: int) -> Column:
    """Ranges of whole paragraphs that each reach target words; the rest is the last. Only breaks are appended."""
    if target < 1:
        raise ValueError("the target must be at least one word")
    none = F.array().cast(f"array<{RANGE}>")
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("i"), F.lit(0).alias("first"), F.lit(0).cast("long").alias("all"), none.alias("out"))

    def row(s: Column, end: Column, words: Column, total: Column) -> Column:
        return F.struct((F.size(s["out"]) + 1).alias("t"), s["first"].alias("para_from"), end.alias("para_to"), words.alias("word_count"), total.alias("word_to"))

    def step(s: Column, n: Column) -> Column:
        run, total = s["run"] + n, s["all"] + n
        full = run >= target
        return F.struct(
            F.when(full, 0).otherwise(run).alias("run"), (s["i"] + 1).alias("i"), F.when(full, s["i"] + 1).otherwise(s["first"]).alias("first"), total.alias("all"),
            F.when(full, F.array_append(s["out"], row(s, s["i"] + 1, run, total))).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(counts, start, step, lambda s: F.when(s["first"] < s["i"], F.array_append(s["out"], row(s, s["i"], s["run"], s["all"]))).otherwise(s["out"]))


def chunks(docs: DataFrame, target: int = 500, separator: str = "\n\\s*\n", joiner: str = "\n\n", with_text: bool = True) -> DataFrame:
    """One row a chunk: doc_id, t, para_from, para_to, word_count, word_from, word_to, cumulative_fraction and the text."""
    p = paragraphs(docs, separator)
    p = p.withColumn("r", let(F.transform("paras", word_count), lambda c: F.struct(chunk_ranges(c, target).alias("ranges"), F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))))
    out = p.select("doc_id", *(["paras"] if with_text else []), F.col("r.total").alias("total"), F.inline("r.ranges"))
    columns = ["doc_id", "t", "para_from", "para_to", "word_count", (F.col("word_to") - F.col("word_count")).alias("word_from"), "word_to", F.round(F.col("word_to") / F.greatest("total", F.lit(1)), 6).alias("cumulative_fraction")]
    if with_text:
        columns.append(F.array_join(F.slice("paras", F.col("para_from") + 1, F.col("para_to") - F.col("para_from")), joiner).alias("text"))
    return out.select(*columns)


def with_sentences(chunked: DataFrame, separator: str = "\n") -> DataFrame:
    """Adds sentences and sentence_count: those of each paragraph in order."""
    own = F.flatten(F.transform(F.split("text", separator), sentence_texts))
    return chunked.withColumn("sentences", own).withColumn("sentence_count", F.size("sentences"))


def chapter_of(chunked: DataFrame, chapters: DataFrame) -> DataFrame:
    """As-of join: the last chapter (by offset, then place in the list) at or before each chunk's first paragraph.

    A union ordered by offset, with chapters before chunks, and the last title so far: one shuffle by document.
    chapters: doc_id, paragraph_offset, pos, title.
    """
    from pyspark.sql import Window

    a = chapters.select("doc_id", F.col("paragraph_offset").alias("at"), F.lit(0).alias("kind"), F.col("pos").alias("ord"), "title", F.lit(None).cast("int").alias("t"))
    b = chunked.select("doc_id", F.col("para_from").alias("at"), F.lit(1).alias("kind"), F.col("t").alias("ord"), F.lit(None).cast("string").alias("title"), "t")
    w = Window.partitionBy("doc_id").orderBy("at", "kind", "ord").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("chapter", F.last("title", True).over(w)).where("kind = 1").select("doc_id", "t", "chapter")


def prefix_overflow(docs: DataFrame, limit: int, overhead: int = 0, separator: str = "\n") -> DataFrame:
    """doc_id, total tokens, and the first step whose prefix plus overhead exceeds limit (null: none)."""
    sizes = F.transform(F.split(F.coalesce("text", F.lit("")), separator), token_count)
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("first"))

    def step(s: Column, n: Column) -> Column:
        total = s["sum"] + n
        return F.struct(total.alias("sum"), (s["i"] + 1).alias("i"), F.coalesce(s["first"], F.when(total + overhead > limit, s["i"] + 1)).alias("first"))

    return docs.select("doc_id", F.aggregate(sizes, start, step).alias("r")).select("doc_id", F.col("r.sum").alias("total_tokens"), F.col("r.first").alias("first_overflow"))


def prefix_estimate(docs: DataFrame, limit: int, overhead: int = 0, price_per_m: float = 0.042, separator: str = "\n") -> DataFrame:
    """Per document, what asking after every paragraph about all text so far takes: paragraphs, average_tokens, input_tokens (a
    paragraph at place i is sent n - i times: a sum, not a self-join), quadratic_tokens (the rule of thumb, average * n * (n + 1) / 2),
    longest (the last prefix, with overhead), first_overflow (the first step over limit, null if none), cost. Refuse before any work
    where first_overflow isn't null."""
    own = F.transform(F.split(F.coalesce("text", F.lit("")), separator), token_count)
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("sum"), zero.alias("sent"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("first"))

    def step(s: Column, n: Column) -> Column:
        total = s["sum"] + n
        return F.struct(total.alias("sum"), (s["sent"] + total + overhead).alias("sent"), (s["i"] + 1).alias("i"), F.coalesce(s["first"], F.when(total + overhead > limit, s["i"] + 1)).alias("first"))

    n, total = F.col("r.i"), F.col("r.sum")
    quadratic = F.floor(total / n * n * (n + 1) / 2 + overhead * n).cast("long")
    return docs.select("doc_id", F.aggregate(own, start, step).alias("r")).select(
        "doc_id", n.alias("paragraphs"), F.round(total / n, 1).alias("average_tokens"), F.col("r.sent").alias("input_tokens"), quadratic.alias("quadratic_tokens"),
        (total + overhead).alias("longest"), F.col("r.first").alias("first_overflow"), F.round(F.col("r.sent") * price_per_m / 1e6, 6).alias("cost"),
    )


class PrefixOverflow(ValueError):
    """A text whose prefixes don't fit; raised before anything is asked."""


def refuse_overflow(estimates: DataFrame) -> None:
    """Raises PrefixOverflow that names the first step over the limit of some documents that have one."""
    over = estimates.where("first_overflow IS NOT NULL").select("doc_id", "first_overflow", "longest").limit(5).collect()
    if over:
        raise PrefixOverflow("; ".join(f"{r.doc_id}: too long from step {r.first_overflow} on (the longest prefix has {r.longest} tokens)" for r in over))
