"""Usage, prices, estimates and small relational pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Id, provider, price of a million input and output tokens.
PRICES = [("large-a", "A", 2.00, 10.00), ("small-a", "A", 0.10, 0.50), ("large-b", "B", 4.00, 20.00), ("mid-b", "B", 2.00, 10.00), ("pro-c", "C", 0.42, 0.84), ("flash-c", "C", 0.05, 0.09)]


def upper_median(value: str) -> Column:
    """Element n // 2 of the sorted values, nulls left out. Exact, by counts of distinct values rather than a list of rows."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)")


def usage(rows: DataFrame, key: str) -> DataFrame:
    """Calls, tokens, cost in millionths, latency and cached calls of each key. rows: tokens, micro_cost, latency_ms, cached."""
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("calls"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"), F.sum(F.coalesce("micro_cost", F.lit(0))).alias("micro_cost"),
        F.sum(F.coalesce("latency_ms", F.lit(0))).alias("latency_ms"), F.count_if("cached").alias("cached_calls"), upper_median("latency_ms").alias("latency_median_ms"),
    )


def price_usage(totals: DataFrame, prices: list[tuple] = PRICES) -> DataFrame:
    """Each row of totals (input_tokens, output_tokens) under each model's prices. The price list is a literal, so there is no join."""
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(a).alias("input_per_m"), F.lit(b).alias("output_per_m")) for m, _, a, b in prices])
    each = totals.select("*", F.inline(models))
    return each.withColumn("cost", F.round(F.col("input_tokens") / 1e6 * F.col("input_per_m") + F.col("output_tokens") / 1e6 * F.col("output_per_m"), 6))


def islands(rows: DataFrame, key: str, step: str, value: str) -> DataFrame:
    """Adds island: the number of the run of equal values that each row is in."""
    w = Window.partitionBy(key).orderBy(step)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(w)).drop("_new")


def as_of(rows: DataFrame, facts: DataFrame, key: str, at: str, fact_at: str, fact: str) -> DataFrame:
    """The last fact of the key at or before each row, ties by fact: one ordered pass over the union, no range join.

    rows: key, at and others; facts: key, fact_at, fact.
    """
    rest = [c for c in rows.columns if c not in (key, at)]
    a = facts.select(F.col(key), F.col(fact_at).alias(at), F.lit(0).alias("_k"), F.col(fact), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rest])
    b = rows.select(F.col(key), F.col(at), F.lit(1).alias("_k"), F.lit(None).cast(facts.schema[fact].dataType).alias(fact), *rest)
    w = Window.partitionBy(key).orderBy(at, "_k", fact).rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn(fact, F.last(fact, True).over(w)).where("_k = 1").drop("_k")


def show_percent(p: Column) -> Column:
    return F.when(p.isNull(), "?").when(p < 0.01, "<1%").otherwise(F.concat(F.round(p * 100).cast("int").cast("string"), F.lit("%")))


def highlight(text: Column, names: list[str], mark: str = "**") -> Column:
    """Names in text between marks, the longest first."""
    escaped = "|".join("".join("\\" + c if c in r".^$*+?()[]{}|\\" else c for c in n) for n in sorted(names, key=len, reverse=True))
    return F.regexp_replace(text, rf"(?U)(?<!\w)({escaped})(?!\w)", f"{mark}$1{mark}")
