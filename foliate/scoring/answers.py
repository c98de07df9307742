"""Answer keys and the three-valued is_culprit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def answer_key(spark: SparkSession, key: dict) -> DataFrame:
    """A key {book_id, is_culprit: {name: bool}} as rows; anything else in it is an error."""
    if extra := set(key) - {"book_id", "is_culprit"}:
        raise ValueError(f"unknown fields {sorted(extra)}")
    marks = key.get("is_culprit")
    if not isinstance(marks, dict) or not all(isinstance(v, bool) for v in marks.values()):
        raise ValueError("is_culprit must map names to true or false")
    return spark.createDataFrame([(key["book_id"], n, v) for n, v in marks.items()], "doc_id string, canonical string, is_culprit boolean")


def with_culprit(long: DataFrame, key: DataFrame) -> DataFrame:
    """Adds is_culprit: null if the document has no key, else the named value, else false. key: doc_id, canonical, is_culprit."""
    named = key.select(F.col("doc_id").alias("_d"), F.col("canonical").alias("_c"), F.col("is_culprit").alias("_v"))
    has = key.select(F.col("doc_id").alias("_h")).distinct()
    out = long.join(has, F.col("doc_id") == F.col("_h"), "left").join(named, (F.col("doc_id") == F.col("_d")) & (F.col("candidate") == F.col("_c")), "left")
    return out.select(*long.columns, F.when(F.col("_h").isNotNull(), F.coalesce("_v", F.lit(False))).alias("is_culprit"))
