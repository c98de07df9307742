"""Belief curves: one row for each document, step and candidate, and what is read off them.

All window functions share the partitioning by document, so a curve table that is partitioned so is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scoring import confidence, mock_distribution, winner


def _step() -> Window:
    return Window.partitionBy("doc_id", "t")


def _line() -> Window:
    return Window.partitionBy("doc_id", "candidate").orderBy("t")


def curve_rows(steps: DataFrame, candidates: list[str], qid: str = "culprit", model: str = "hash (MOCK)") -> DataFrame:
    """A result row for each (doc_id, t): answer, distribution, confidence. steps: doc_id, t, state."""
    d = steps.withColumn("distribution", mock_distribution(F.col("state"), qid, candidates))
    return d.select("doc_id", "t", winner(F.col("distribution")).alias("answer"), confidence(F.col("distribution")).alias("confidence4"), "distribution", F.lit(model).alias("model"))


def long_rows(results: DataFrame) -> DataFrame:
    """A row for each candidate, with its place in the order sent."""
    return results.select("doc_id", "t", "answer", F.posexplode("distribution").alias("pos", "d")).select("doc_id", "t", "answer", "pos", F.col("d.option").alias("candidate"), F.col("d.p4").alias("p4"), (F.col("d.p4") / 10000.0).alias("prob"))


def wide_rows(long: DataFrame) -> DataFrame:
    """Back to a row for each (doc_id, t); distribution in the order sent."""
    d = F.transform(F.array_sort(F.collect_list(F.struct("pos", "candidate", "p4"))), lambda x: F.struct(x["candidate"].alias("option"), x["p4"].alias("p4")))
    return long.groupBy("doc_id", "t").agg(F.min("answer").alias("answer"), d.alias("distribution"))


def rank(long: DataFrame) -> DataFrame:
    return long.withColumn("rank", F.row_number().over(_step().orderBy(F.desc("p4"), "pos")))


def delta(long: DataFrame) -> DataFrame:
    """Change since the step before in whole points (half up); the first step has 0."""
    change = F.col("p4") - F.coalesce(F.lag("p4").over(_line()), F.col("p4"))
    return long.withColumn("points", F.floor((change + 50) / 100).cast("long"))


def peak(long: DataFrame) -> DataFrame:
    return long.groupBy("doc_id", "candidate").agg(F.max("p4").alias("peak4"), F.min("pos").alias("pos"), F.min_by("t", F.struct(-F.col("p4"), F.col("t"))).alias("peak_t"))


def leader(long: DataFrame) -> DataFrame:
    return long.groupBy("doc_id", "t").agg(F.max_by("candidate", F.struct(F.col("p4"), -F.col("pos"))).alias("leader"), F.max("p4").alias("p4"))


def top(long: DataFrame, k: int) -> DataFrame:
    return rank(long).where(F.col("rank") <= k)


def series_slots(long: DataFrame, k: int = 8) -> DataFrame:
    """The k candidates of the highest peaks in each document, numbered in the order in which they first lead, then by place."""
    peaks = peak(long).withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("peak4"), "pos"))).where(F.col("r") <= k)
    return peaks.select("doc_id", "candidate", "peak4", F.row_number().over(Window.partitionBy("doc_id").orderBy("peak_t", "pos")).alias("slot"))


def reveal(steps: DataFrame, p4: Column, least: int = 5000) -> DataFrame:
    """The first step whose share of yes reaches one half; null if none does."""
    return steps.groupBy("doc_id").agg(F.min(F.when(p4 >= least, F.col("t"))).alias("first_t"), F.count(F.lit(1)).alias("n_steps"))


def interpolate(long: DataFrame) -> DataFrame:
    """For each step the value halfway to the next (the last step: its own)."""
    return long.withColumn("halfway", (F.col("p4") + F.coalesce(F.lead("p4").over(_line()), F.col("p4"))) / 2.0)


def log_height(p: Column, floor: float = 0.01) -> Column:
    """0 at the floor, 1 at certainty, on a logarithmic scale."""
    return 1 - F.log10(F.greatest(p, F.lit(floor))) / F.log10(F.lit(floor))
