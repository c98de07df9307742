"""Configuration files as tables: question batteries and price lists in YAML, read by data sources of Spark's own kind.

Each file is a partition, each entry a row; what is wrong with an entry, or with a whole file, is a row with an error and no
exception, so that a scan over many files shows all faults at once. `battery` is strict: it raises on the first.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.questions import QuestionError, check, validate

QUESTION = (
    "file string, place int, id string, type string, scope string, text string, per_character boolean, option_source string, options array<string>, "
    "extra_options array<string>, levels array<string>, error string"
)
PRICE = "file string, place int, model string, name string, input double, output double, error string"


class ConfigError(ValueError):
    pass


class _File(InputPartition):
    def __init__(self, name: str, content: str):
        super().__init__(name)
        self.name, self.content = name, content


class _Reader(DataSourceReader):
    """Rows of the files that the driver has listed and read: a folder of configuration is a few KB."""

    def __init__(self, options, rows):
        import json

        self.files, self.rows = json.loads(options["files"]), rows

    def partitions(self) -> list[InputPartition]:
        return [_File(n, c) for n, c in self.files] or [_File("", "")]

    def read(self, partition: _File) -> Iterator[tuple]:
        import yaml

        if not partition.name:
            return
        try:
            found = yaml.safe_load(partition.content)
        except yaml.YAMLError as e:
            found = e
        yield from self.rows(partition.name, found)


def _entries(found, key: str) -> list | str:
    """The list in a file, at its top or under key; or what is wrong."""
    if isinstance(found, Exception):
        return f"no YAML: {str(found).splitlines()[0]}"
    found = found.get(key) if isinstance(found, dict) else found
    return found if isinstance(found, list) and found else f"a list of {key} is needed"


def _question_rows(name: str, found) -> Iterator[tuple]:
    entries = _entries(found, "questions")
    if isinstance(entries, str):
        yield (name, *[None] * 10, entries)
        return
    texts = lambda x: [str(v) for v in x] if isinstance(x, (list, dict)) else None
    seen: set = set()
    for i, q in enumerate(entries):
        if not isinstance(q, dict):
            yield (name, i, *[None] * 9, "a question is a mapping")
            continue
        try:
            check(q, q.get("scope"))
            error = "the id is used twice" if q["id"] in seen else None
        except QuestionError as e:
            error = str(e)
        seen.add(q.get("id"))
        options = q.get("options")
        plain = lambda k: None if q.get(k) is None else str(q[k])  # noqa: B023, E731
        yield (name, i, plain("id"), plain("type"), plain("scope"), plain("text"), bool(q.get("per_character")), options if isinstance(options, str) else None, texts(options), texts(q.get("extra_options")), texts(q.get("levels")), error)


def _price_rows(name: str, found) -> Iterator[tuple]:
    entries = _entries(found, "models")
    if isinstance(entries, str):
        yield (name, *[None] * 5, entries)
        return
    seen: set = set()
    number = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) and x >= 0 else None
    for i, m in enumerate(entries):
        m = m if isinstance(m, dict) else {}
        model, prices = m.get("id"), (number(m.get("input")), number(m.get("output")))
        error = "an id is needed" if not model else "the id is used twice" if model in seen else None if None not in prices else "input and output must be numbers, not below 0"
        seen.add(model)
        yield (name, i, model and str(model), str(m.get("name") or model or "") or None, *prices, error)


class QuestionFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "foliate_questions"

    def schema(self) -> str:
        return QUESTION

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, _question_rows)


class PriceFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "foliate_prices"

    def schema(self) -> str:
        return PRICE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, _price_rows)


def _scan(spark: SparkSession, kind: type[DataSource], path: str) -> DataFrame:
    """Files are listed and read through Spark, so any store will do."""
    import json

    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.y*ml").select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("n"), F.col("value").alias("c")).orderBy("n").collect()
    spark.dataSource.register(kind)
    return spark.read.format(kind.name()).option("files", json.dumps([[r.n, r.c] for r in files])).load()


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A row for each question of the YAML files in a folder, with what is wrong with it."""
    return _scan(spark, QuestionFiles, path)


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """A row for each model of the price lists in a folder: dollars for a million tokens in and out."""
    return _scan(spark, PriceFiles, path)


def battery(questions: DataFrame, scope: str) -> list[dict]:
    """The questions of one scope in order of file and place, ready to resolve; raises ConfigError where any has an error."""
    rows = questions.where((F.col("scope") == scope) | F.col("error").isNotNull()).orderBy("file", "place").collect()
    if bad := [r for r in rows if r["error"]]:
        raise ConfigError("; ".join(f"{r['file']} at {r['place']}: {r['error']}" for r in bad))
    out = []
    for r in rows:
        q = {c: r[c] for c in ("id", "type", "scope", "text")}
        options = r["option_source"] or r["options"]
        out.append(q | {k: v for k, v in (("per_character", r["per_character"] or None), ("options", options), ("extra_options", r["extra_options"]), ("levels", r["levels"])) if v is not None})
    try:
        return validate(out, scope)
    except QuestionError as e:
        raise ConfigError(str(e)) from None


def cost_of(usage: DataFrame, prices: DataFrame, baseline: str | None = None) -> DataFrame:
    """usage (input_tokens, output_tokens ...) for every model of a price list, with cost, and its ratio to the baseline's (null where that
    is nothing or unknown). A price list is a few rows a file, so it goes to every task."""
    p = prices.where("error IS NULL").select("model", F.col("input").alias("_in"), F.col("output").alias("_out"))
    cost = F.round(F.col("input_tokens") / 1e6 * F.col("_in") + F.col("output_tokens") / 1e6 * F.col("_out"), 6)
    base = prices.where((F.col("model") == (baseline or "")) & F.col("error").isNull()).select(F.col("input").alias("_base_in"), F.col("output").alias("_base_out"))
    each = usage.join(F.broadcast(p)).withColumn("cost", cost).join(F.broadcast(base), how="left")
    of_base = F.col("input_tokens") / 1e6 * F.col("_base_in") + F.col("output_tokens") / 1e6 * F.col("_base_out")
    return each.withColumn("ratio", F.round(F.col("cost") / F.nullif(of_base, F.lit(0.0)), 4)).drop("_in", "_out", "_base_in", "_base_out")
