"""Results against rosters and answer keys, and tables that are brought up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scoring import noul_value, score_value, winner


def introduced(long: DataFrame, firsts: DataFrame) -> DataFrame:
    """Adds introduced_by_t: first mention at or before t; null for options that are no entity. firsts: doc_id, canonical, first_mention."""
    f = firsts.select(F.col("doc_id").alias("_d"), F.col("canonical").alias("_c"), "first_mention", F.lit(True).alias("_known"))
    joined = long.join(f, (F.col("doc_id") == F.col("_d")) & (F.col("candidate") == F.col("_c")), "left")
    return joined.select(*long.columns, F.when(F.col("_known"), F.coalesce(F.col("first_mention") <= F.col("t"), F.lit(False))).alias("introduced_by_t"))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows replace those of the same keys; the rest of table stays."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def pending(steps: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Steps without a result yet."""
    return steps.join(done.select(*keys).distinct(), keys, "left_anti")


def write_long(long: DataFrame, path: str, by: str = "run_id") -> None:
    """Parquet by run, sorted by step and candidate; runs in long are replaced, others stay.

    Rows are dealt by run and candidate: a large run is not one task, and a run has at most as many files as candidates.
    """
    (
        long.repartition(by, "candidate").sortWithinPartitions(by, "t", "candidate")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    )


def uncovered(entries: DataFrame, ranges: DataFrame) -> DataFrame:
    """Entries in no range of their document. Ranges are disjoint, so the last that begins at or before t decides: one pass
    in order instead of a join of every entry with every range. ranges: doc_id, from_t, to_t."""
    a = ranges.select("doc_id", F.col("from_t").alias("t"), F.lit(0).alias("_k"), F.col("to_t").alias("_to"))
    b = entries.select("doc_id", "t", F.lit(1).alias("_k"), F.lit(None).cast("long").alias("_to"))
    w = Window.partitionBy("doc_id").orderBy("t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("_end", F.max("_to").over(w)).where("_k = 1 AND (_end IS NULL OR _end < t)").select("doc_id", "t")


def compatibility(headers: DataFrame, expected: DataFrame, fields: list[str], key: str = "doc_id") -> DataFrame:
    """key and the list of fields that differ from what is expected."""
    e = expected.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    problems = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields]))
    return headers.join(e, key).select(key, problems.alias("problems"))


NONE_OPTION = "none_of_these"


def viewer_candidates(options: DataFrame, entities: DataFrame) -> DataFrame:
    """doc_id, place, name, names, first_chunk, is_none: the options of each document in a neutral order, never by share or truth: by first
    mention (entities without one, and options that are no entity, as if at 1,000,000), then by name, none_of_these last.

    options: doc_id, candidate. entities: doc_id, canonical, names, first_mention. An option that is no entity is named by itself.
    """
    e = entities.select(F.col("doc_id").alias("_d"), F.col("canonical").alias("_c"), "names", "first_mention")
    is_none = F.col("candidate") == NONE_OPTION
    joined = options.select("doc_id", "candidate").distinct().join(e, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("candidate") == F.col("_c")), "left")
    order = Window.partitionBy("doc_id").orderBy(is_none, F.coalesce("first_mention", F.lit(1_000_000)), "candidate")
    named = F.coalesce("names", F.when(is_none, F.array().cast("array<string>")).otherwise(F.array("candidate")))
    return joined.select("doc_id", F.row_number().over(order).alias("place"), F.col("candidate").alias("name"), named.alias("names"), F.col("first_mention").alias("first_chunk"), is_none.alias("is_none"))


def catalogue(books: DataFrame, ledgers: DataFrame, key: str = "doc_id") -> DataFrame:
    """books with mock_ledger and real_ledger: is there a ledger of that kind. ledgers: key, mock; any number of rows a book."""
    there = ledgers.groupBy(key).agg(F.bool_or(F.col("mock")).alias("mock_ledger"), F.bool_or(~F.col("mock")).alias("real_ledger"))
    known = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return books.join(there.withColumnRenamed(key, "_k"), F.col(key) == F.col("_k"), "left").select(*[F.col(c) for c in books.columns], known("mock_ledger"), known("real_ledger"))


def sorted_json(answers: Column) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(answers))))


def typed_answers(questions: list[dict], answers: Column) -> list[Column]:
    """For each question but the culprit, by id: q_<id>_value (a variant: true or false, a level, or an option), its typed sibling
    (q_<id>_bool, _level or _option), and q_<id>_prob, the share of the answer (of yes, for yes or no). answers: a map of
    distributions by id; what isn't answered is null."""
    out = []
    for q in sorted(questions, key=lambda q: q["id"]):
        d = F.element_at(answers, F.lit(q["id"]))
        best = F.array_max(F.transform(d, lambda x: x["p4"]))
        if q["id"] == "culprit":
            continue
        if q["type"] == "noul":
            kind, value, share = "bool", noul_value(F.get(d, 0)["p4"]), F.get(d, 0)["p4"]
        else:
            kind, value, share = ("level", score_value(d)[0], best) if q["type"] == "score" else ("option", winner(d), best)
        value = F.when(d.isNotNull(), value)
        out += [value.cast("variant").alias(f"q_{q['id']}_value"), value.alias(f"q_{q['id']}_{kind}"), (share / 10000.0).alias(f"q_{q['id']}_prob")]
    return out


def long_answers(rows: DataFrame, questions: list[dict], keep: list[str]) -> DataFrame:
    """keep, t and a row for each candidate: candidate, p4, prob, option_position, inference_answers (JSON, keys in order) and the
    typed answers. rows: keep, t, distribution, answers. option_position is the place in the order sent."""
    each = rows.select(*keep, "t", sorted_json(F.col("answers")).alias("inference_answers"), *typed_answers(questions, F.col("answers")), F.posexplode("distribution").alias("option_position", "_d"))
    rest = [c for c in each.columns if c not in (*keep, "t", "option_position", "_d", "inference_answers")]
    return each.select(*keep, "t", F.col("_d.option").alias("candidate"), F.col("_d.p4").alias("p4"), (F.col("_d.p4") / 10000.0).alias("prob"), "option_position", "inference_answers", *rest)
