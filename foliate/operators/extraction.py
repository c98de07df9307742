"""Rosters made of whole texts: extractors behind one interface, a cache by prompt, and what becomes of answers that are no use.

An extractor answers a prompt with JSON, {"characters": [{"canonical": .., "aliases": [..], "is_suspect": ..}]}, with or without
prose around it, and says why it stopped. A prompt too long for it is not asked. Every distinct prompt is asked once; good answers
stay in the table `extractions` of a store, bad ones do too but are asked again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, token_count
from ..sources.store import Store
from . import entities

#: What extractors give for each key.
SAID = "key string, answer string, stop string"
CACHE = "key string, extractor string, answer string, error string, seen int"
ROSTER = "array<struct<canonical:string,aliases:array<string>,is_suspect:boolean>>"
#: Reasons to stop that leave an answer unfinished.
CUT_OFF = ["length", "max_tokens", "refusal", "content_filter"]


class ExtractionError(RuntimeError):
    """Documents for which no roster could be made."""


class Extractor(Protocol):
    """name and system are part of the cache's key; prompt and answer have to fit in context_tokens."""

    name: str
    system: str
    context_tokens: int
    output_tokens: int

    def __call__(self, asks: DataFrame) -> DataFrame:
        """Answers (SAID) to asks: key, text, user (the prompt). A key without an answer counts as an empty one."""
        ...


@dataclass(frozen=True)
class FrequentNames:
    """The default: the names found most often, each an entity of its own. It reads the text alone and takes one of any length."""

    most: int = 12
    least: int = 3
    separator: str = "\n\n"
    system: str = ""
    context_tokens: int = 1 << 31
    output_tokens: int = 0

    @property
    def name(self) -> str:
        return f"frequent-names-{self.most}-{self.least}-{self.separator!r}"

    def __call__(self, asks: DataFrame) -> DataFrame:
        found = entities.heuristic_roster(asks.select(F.col("key").alias("doc_id"), "text"), "doc_id", self.most, self.least, self.separator)
        named = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "canonical"))).alias("cast"))  # most names at most
        answer = F.to_json(F.struct(F.transform("cast", lambda c: F.struct(c["canonical"].alias("canonical"))).alias("characters")))
        return asks.select("key").join(named.select(F.col("doc_id").alias("key"), answer.alias("answer")), "key", "left").select("key", F.coalesce("answer", F.lit('{"characters":[]}')).alias("answer"), F.lit("stop").alias("stop"))


@dataclass(frozen=True)
class Called:
    """A text model behind a function (system, user) -> (answer, why it stopped), called in tasks, one prompt at a time."""

    name: str
    ask: Callable[[str, str], tuple[str | None, str]]
    system: str = ""
    context_tokens: int = 200_000
    output_tokens: int = 16_000

    def __call__(self, asks: DataFrame) -> DataFrame:
        ask, system = self.ask, self.system

        def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                said = [ask(system, user) for user in part["user"]]
                yield pd.DataFrame({"key": part["key"], "answer": [a for a, _ in said], "stop": [s for _, s in said]}, dtype=object)

        return asks.select("key", "user").mapInPandas(rows, SAID)


def book_texts(books: DataFrame) -> DataFrame:
    """doc_id, title, text: paragraphs joined, as the chunks of a book joined would be."""
    return books.select(F.col("book_id").alias("doc_id"), "title", F.array_join("paragraphs", "\n\n").alias("text"))


def judged(answer: Column, stop: Column) -> tuple[Column, Column]:
    """The entities of an answer, and what is wrong with it (null: nothing). Its object runs from the first { to the last }."""
    start, end = F.instr(answer, "{"), F.length(answer) - F.instr(F.reverse(answer), "}") + 1
    body = F.substring(answer, start, end - start + 1)
    read = F.from_json(body, f"characters {ROSTER}, broken string", {"columnNameOfCorruptRecord": "broken"})
    error = (
        F.when(stop.isin(CUT_OFF), F.concat(F.lit("stopped early: "), stop))
        .when(answer.isNull() | (F.btrim(answer, F.lit(" \t\r\n")) == ""), "empty answer")
        .when((start == 0) | (end < start), "no JSON object")
        .when(read["broken"].isNotNull() | read["characters"].isNull(), "not valid JSON")
    )
    return read["characters"], error


def prompts(texts: DataFrame, extractor: Extractor) -> DataFrame:
    """doc_id, text, user, key, and error where the prompt doesn't fit. Null text is empty."""
    text = F.coalesce("text", F.lit(""))
    user = F.concat(F.lit("Title: "), F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("unknown")), F.lit("\n\n<novel>\n"), text, F.lit("\n</novel>"))
    rows = texts.select("doc_id", text.alias("text"), user.alias("user"))
    tokens, most = token_count(F.lit(extractor.system)) + token_count(F.col("user")), extractor.context_tokens - extractor.output_tokens
    long = F.when(tokens > most, F.concat(tokens.cast("string"), F.lit(f" tokens, of {most} that fit")))
    return rows.select("*", F.sha2(F.concat_ws("\x00", F.lit(extractor.name), F.lit(extractor.system), "user"), 256).alias("key"), long.alias("error"))


def extract(texts: DataFrame, extractor: Extractor, store: Store) -> DataFrame:
    """doc_id, ord (from 1), canonical, names (canonical first, none twice), is_suspect, error: a row for each entity of each text.

    texts: doc_id, title, text. A document with an error, or without entities, has one row with a null canonical. Entities without a
    name go; of those with the same canonical name the first stays. Texts that are equal, title included, are asked about once.
    """
    asked = prompts(texts, extractor)
    known = store.read("extractions", CACHE).where("error IS NULL").select("key")
    due = asked.where("error IS NULL").dropDuplicates(["key"]).join(known, "key", "left_anti").select("key", "text", "user")
    said = due.select("key").join(extractor(due), "key", "left").dropDuplicates(["key"])
    with store.transaction():
        store.stage("extractions", said.select("key", F.lit(extractor.name).alias("extractor"), "answer", judged(F.col("answer"), F.col("stop"))[1].alias("error"), F.lit(store.version() + 1).alias("seen")))
    store.compact("extractions")
    rows = store.read("extractions", CACHE).withColumn("at", F.struct(F.col("error").isNull(), "seen"))
    last = rows.groupBy("key").agg(F.max_by(F.struct("answer", F.col("error").alias("fault")), "at").alias("a")).select("key", "a.*")
    cast = _named(judged(F.col("answer"), F.lit(None).cast("string"))[0])
    out = asked.select("doc_id", "key", "error").join(last, "key", "left").select("doc_id", F.coalesce("error", "fault").alias("error"), "answer")
    each = out.select("doc_id", "error", F.posexplode_outer(F.when(F.col("error").isNull(), cast)).alias("pos", "c")).select("doc_id", "error", "pos", "c.*")
    others = F.filter(F.coalesce("aliases", F.array().cast("array<string>")), _is_name)
    names = F.when(F.col("canonical").isNotNull(), F.array_distinct(F.array_prepend(others, F.col("canonical"))))
    return each.select("doc_id", (F.col("pos") + 1).alias("ord"), "canonical", names.alias("names"), F.coalesce("is_suspect", F.lit(False)).alias("is_suspect"), "error")


def _is_name(name: Column) -> Column:
    return F.btrim(F.coalesce(name, F.lit(""))) != ""


def _named(cast: Column) -> Column:
    """Entities that have a name, the first of each. A cast is short, so looking back over it is cheap."""
    before = lambda cs, i: F.transform(F.slice(cs, 1, i), lambda c: c["canonical"])
    return let(F.filter(cast, lambda c: _is_name(c["canonical"])), lambda cs: F.filter(cs, lambda c, i: ~F.array_contains(before(cs, i), c["canonical"])))


def usable(extracted: DataFrame) -> DataFrame:
    """The roster of extract, with patterns. Raises ExtractionError, with names, where a document has an error."""
    bad = extracted.where("error IS NOT NULL").select("doc_id", "error").limit(5).collect()
    if bad:
        raise ExtractionError("; ".join(f"{r.doc_id}: {r.error}" for r in bad))
    return extracted.where("canonical IS NOT NULL").select("doc_id", "ord", "canonical", "names", "is_suspect", entities.pattern_of(F.col("names")).alias("pattern"))


def manual_choices(given: str | None) -> list[str]:
    """Names of a comma list, trimmed, none empty or twice."""
    return list(dict.fromkeys(n for n in map(str.strip, (given or "").split(",")) if n))
