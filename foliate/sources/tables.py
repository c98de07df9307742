"""Stored tables of other shapes: JSON and JSON lines (plain or gzip), run folders, rosters and prices in YAML, caches of fetched
pages and of extraction calls."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = (
    "t int, answer string, probabilities map<string,double>, confidence double, latency_ms double, input_tokens bigint, model string, cost double, cached boolean, timestamp string, "
    "book_id string, run_id string, condition string, candidate_set string, inference_answers string, option_order array<string>, raw_window int"
)
RUN_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*\.jsonl(?:\.gz)?")


def safe_name(name: str) -> str:
    """A run file's bare name; anything that could leave the folder is refused."""
    if not RUN_NAME.fullmatch(name) or ".." in name:
        raise ValueError(f"not a run file: {name!r}")
    return name


def read_results(spark: SparkSession, path: str, strict: bool = True, schema: str = RESULT) -> DataFrame:
    """Result rows of JSON lines. Strict fails on a bad line; else bad lines and rows without a step are left out."""
    rows = spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")
    return rows if strict else rows.where("t IS NOT NULL")


def list_runs(spark: SparkSession, folder: str, books: DataFrame) -> DataFrame:
    """A row for each run file of a book: its name, book, title, steps, whether it was a mock, and when it changed; real runs first,
    newest first. books: book_id, title, n_chunks."""
    rows = spark.read.schema(RESULT).option("pathGlobFilter", "*.jsonl*").json(folder, mode="DROPMALFORMED")
    named = rows.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("changed"))
    runs = named.where("run_id IS NOT NULL AND run_id <> '' AND book_id IS NOT NULL").groupBy("file").agg(
        F.min("book_id").alias("book_id"), F.min("run_id").alias("run_id"), F.count(F.lit(1)).alias("steps"), F.bool_or(F.contains("model", F.lit("(MOCK)"))).alias("mock"), F.max("changed").alias("changed"),
    )
    return runs.join(books.select("book_id", "title", "n_chunks"), "book_id", "left").orderBy(F.coalesce("mock", F.lit(False)), F.desc("changed"), "file")


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """The plain mode's indexed paragraphs, one JSON array a file."""
    return spark.read.schema("index int, text string").json(path, multiLine=True).orderBy("index")


def write_paragraphs(texts: DataFrame, path: str) -> None:
    """doc_id, index, text as JSON by document. texts: doc_id, paragraphs."""
    texts.select("doc_id", F.posexplode("paragraphs").alias("index", "text")).repartition("doc_id").sortWithinPartitions("doc_id", "index").write.partitionBy("doc_id").json(path, compression="gzip")


def roster_from_yaml(text: str) -> list[dict]:
    """A hand-edited roster: unique canonical names that aren't empty; other fields get defaults."""
    import yaml

    out = []
    for c in (yaml.safe_load(text) or {}).get("characters") or []:
        name = str(c.get("canonical") or "").strip()
        if not name or name in {x["canonical"] for x in out}:
            raise ValueError(f"canonical names must be unique and not empty: {name!r}")
        out.append({"canonical": name, "aliases": [str(a) for a in c.get("aliases") or []], "is_suspect": bool(c.get("is_suspect")), "uncertain": bool(c.get("uncertain")), "evidence": dict(c.get("evidence") or {})})
    return out


def roster_to_yaml(book_id: str, roster: list[dict], source: str) -> str:
    import yaml

    return yaml.safe_dump({"book_id": book_id, "source": source, "characters": roster}, sort_keys=False, allow_unicode=True)


def roster_policy(stored: str | None, make: Callable[[], list[dict]], placeholder: bool, mock: bool) -> tuple[list[dict], bool]:
    """The stored roster rules; only a real run replaces a placeholder. Gives the roster and whether it is new."""
    if stored is not None and (mock or not placeholder):
        return roster_from_yaml(stored), False
    return make(), True


def roster_from_extraction(answer: str) -> list[dict]:
    """The roster in a text model's answer, from its first { to its last }: trimmed, without the unnamed, aliases once and never the
    canonical name."""
    a, z = answer.find("{"), answer.rfind("}")
    if a < 0 or z < a:
        raise ValueError("the answer holds no object")
    out: dict[str, dict] = {}
    for c in json.loads(answer[a : z + 1]).get("characters") or []:
        name = str(c.get("canonical") or "").strip()
        if name and name not in out:
            aliases = [x for x in dict.fromkeys(str(x).strip() for x in c.get("aliases") or []) if x and x != name]
            out[name] = {"canonical": name, "aliases": aliases, "is_suspect": bool(c.get("is_suspect")), "uncertain": bool(c.get("uncertain")), "evidence": c.get("evidence") or {}}
    if not out:
        raise ValueError("the answer names nobody")
    return list(out.values())


def extraction_object(answer: Column) -> Column:
    """The object in an answer as a variant, null where there is none."""
    return F.try_parse_json(F.nullif(F.regexp_extract(answer, r"(?s)\{.*\}", 0), F.lit("")))


def page_key(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 24)


def missing_pages(urls: DataFrame, cache: DataFrame) -> DataFrame:
    """URLs that no cached page answers, once each; a page is fetched once ever."""
    return urls.select("url").distinct().withColumn("key", page_key(F.col("url"))).join(cache.select("key"), "key", "left_anti")


def title_of_file(name: str) -> str:
    return re.sub(r"[-_\s]+", " ", PurePosixPath(name).stem).strip().title() or "Untitled"


def write_json(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Gzipped JSON; the committer makes a write whole or absent."""
    out = df.write.mode("overwrite").option("compression", "gzip")
    (out.partitionBy(*by) if by else out).json(path)
