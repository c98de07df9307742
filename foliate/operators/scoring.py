"""The scorer: typed answers to a battery of questions about a state.

The default scorer is a deterministic stand-in made of built-in functions. A real one is a function over batches (`Scorer`)
behind the cache join and the budget filter, so that repeated and retried rows cost nothing.
"""

from __future__ import annotations

import json
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, pseudo_random, slug, token_count
from ..plans.questions import QuestionError, Spec

STATE_TOKENS, REQUEST_TOKENS = 32_000, 64_000
UNIT = 10_000


def shares(weights: Column) -> Column:
    """Weights as ten-thousandths that sum to UNIT; what rounding leaves goes to the greatest, the first among equals."""
    add = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)

    def spread(floor: Column) -> Column:
        # What all elements need is made once, outside of the function over elements.
        best = F.struct((F.array_position(weights, F.array_max(weights)) - 1).alias("at"), (F.lit(UNIT) - add(floor)).alias("rest"))
        return let(best, lambda b: F.transform(floor, lambda x, i: x + F.when(i == b["at"], b["rest"]).otherwise(F.lit(0).cast("long"))))

    return let(let(add(weights), lambda total: F.transform(weights, lambda w: F.call_function("div", w * UNIT, total))), spread)


def digest(state: Column) -> Column:
    """What the stand-in reads of a state. Where one state is asked much, make it once and pass it on as `digested`."""
    return F.sha2(state, 256)


def mock_distribution(state: Column, qid: str | Column, options: list[str] | Column, digested: bool = False) -> Column:
    """Array of (option, p4): ten-thousandths in the order of options, from squared hashes of the state's digest, question and option. The
    state is hashed once, however many options there are. digested: state is its digest already."""
    labels = F.array(*[F.lit(o) for o in options]) if isinstance(options, list) else options
    asked = F.lit(qid) if isinstance(qid, str) else qid
    keyed = lambda h: F.transform(labels, lambda o: pseudo_random(F.concat_ws("|", h, asked, o)))
    weights = let(state if digested else digest(state), lambda h: F.transform(keyed(h), lambda u: (u + 1) * (u + 1)))
    return F.arrays_zip(labels.alias("option"), let(weights, shares).alias("p4"))


def winner(distribution: Column) -> Column:
    """The option of the greatest share, the first among equals."""
    return let(F.transform(distribution, lambda x: x["p4"]), lambda ps: F.get(distribution, (F.array_position(ps, F.array_max(ps)) - 1).cast("int"))["option"])


def confidence(distribution: Column) -> Column:
    """Difference of the two greatest shares, in ten-thousandths."""
    return let(F.sort_array(F.transform(distribution, lambda x: x["p4"]), asc=False), lambda ps: F.get(ps, 0) - F.coalesce(F.get(ps, 1), F.lit(0)))


def score_value(distribution: Column) -> tuple[Column, Column]:
    """Level from 1 (the lowest among equals) and expected level, of a distribution over levels in order."""
    ps = F.transform(distribution, lambda x: x["p4"])
    level = let(ps, lambda p: F.array_position(p, F.array_max(p)))
    expected = F.aggregate(F.transform(ps, lambda p, i: p * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return level.cast("int"), F.round(expected / float(UNIT), 4)


def noul_value(p4: Column) -> Column:
    return p4 >= UNIT // 2


def option_order(state: Column, qid: str, options: list[str]) -> Column:
    """The options as shown: by a hash of state, question and option."""
    return F.transform(F.array_sort(F.array(*[F.struct(F.sha2(F.concat_ws("|", state, F.lit(qid), F.lit(o)), 256).alias("h"), F.lit(o).alias("o")) for o in options])), lambda x: x["o"])


def question_tokens(specs: list[Spec]) -> tuple[int, int]:
    """Tokens of all questions and of the longest."""
    each = [-(-len(s.instructions + "".join(o + (d or "") for o, d in s.options)) // 4) for s in specs]
    return sum(each), max(each, default=0)


def budget_guard(states: DataFrame, specs: list[Spec], state_limit: int = STATE_TOKENS, request_limit: int = REQUEST_TOKENS, state_col: str = "state", asked: tuple[Column, Column] | None = None) -> DataFrame:
    """Adds state_tokens and verdict: ok, state (with the longest question it is too long) or request (with all). Nothing is cut.
    asked: tokens of all questions and of the longest where they differ by row."""
    every, longest = asked or question_tokens(specs)
    n = token_count(F.col(state_col))
    return states.withColumn("state_tokens", n).withColumn("verdict", F.when(F.col("state_tokens") + longest > state_limit, "state").when(F.col("state_tokens") + every > request_limit, "request").otherwise("ok"))


ANSWERS = "map<string, array<struct<option: string, p4: bigint>>>"
CACHE = f"key string, model string, answers {ANSWERS}"


class CallCeiling(RuntimeError):
    """More calls than the run, or a document, is allowed."""


class MissingAnswer(RuntimeError):
    """A question without an answer: never a result, never a default."""


class Scorer(Protocol):
    """Answers a batch. asks: key, state, specs (id, type, text, options); gives key and answers, options in the order sent, for
    every key once. What it leaves out, or answers without options, is an error of the run."""

    model: str

    def __call__(self, asks: DataFrame) -> DataFrame: ...


class MockScorer:
    """The deterministic stand-in, in built-in functions alone."""

    model = "hash (MOCK)"

    def __call__(self, asks: DataFrame) -> DataFrame:
        pairs = F.transform("specs", lambda s: F.struct(s["id"], mock_distribution(F.col("_digest"), s["id"], s["options"], digested=True)))
        return asks.withColumn("_digest", digest(F.col("state"))).select("key", F.map_from_entries(pairs).cast(ANSWERS).alias("answers"))


def cache_key(model: str, provider: str, state: Column, specs: list[Spec] | Column) -> Column:
    """Hash of model, provider, state and questions with their options in the order sent."""
    asked = F.to_json(specs) if isinstance(specs, Column) else F.lit(json.dumps([[s.id, s.type, s.instructions, s.options] for s in specs], ensure_ascii=False))
    return F.sha2(F.concat_ws("\n", F.lit(model), F.lit(provider), asked, state), 256)


def specs_of(questions: list[dict], candidates: Column) -> Column:
    """The questions of a battery as an array of (id, type, text, options), for the candidates (canonical, names) of each row. A
    question per character becomes one for each candidate; ids that clash get _2, _3 and so on."""
    spec = lambda q, own, text, options: F.struct(own.alias("id"), F.lit(q["type"]).alias("type"), text.alias("text"), options.alias("options"))
    listed = lambda xs: F.array(*[F.lit(str(x)) for x in xs]).cast("array<string>")
    names = F.transform(candidates, lambda c: c["canonical"])
    out = []
    for q in questions:
        if q["type"] == "noul":
            options = listed(["yes", "no"])
        elif q["type"] == "score":
            options = listed(q["levels"])
        elif q["options"] in ("candidates", "roster"):
            options = F.concat(names, listed(q.get("extra_options", [])))
        elif isinstance(q["options"], str):
            raise QuestionError(f"{q['id']!r}: {q['options']} belong to a chunk")
        else:
            options = listed([*q["options"], *q.get("extra_options", [])])
        if q.get("per_character"):
            slugs = F.transform(names, lambda n: F.coalesce(F.nullif(slug(n, "_", 1000), F.lit("")), F.lit("x")))
            before = lambda i: F.size(F.filter(F.slice(slugs, 1, i), lambda x: x == F.get(slugs, i)))
            own = lambda i: F.concat(F.lit(q["id"] + "__"), F.get(slugs, i), F.when(before(i) > 0, F.concat(F.lit("_"), before(i) + 1)).otherwise(""))  # noqa: B023, E731
            out.append(F.transform(names, lambda n, i: spec(q, own(i), F.replace(F.lit(q["text"]), F.lit("{name}"), n), options)))  # noqa: B023
        else:
            out.append(F.array(spec(q, F.lit(q["id"]), F.lit(q["text"]), options)))
    return F.concat(*out)


def unanswered(specs: Column, answers: Column) -> Column:
    """How many of specs have no answer, or one whose options aren't those sent."""
    missing = lambda s: F.coalesce(F.transform(F.element_at(answers, s["id"]), lambda o: o["option"]) != s["options"], F.lit(True))
    return F.when(answers.isNull(), F.size(specs)).otherwise(F.size(F.filter(specs, missing)))


def to_ask(asks: DataFrame, cache: DataFrame) -> DataFrame:
    """The asks that no cached answer serves, each key once, however many rows of however many documents share it."""
    missing = asks.join(cache.select("key"), "key", "left_anti")
    return missing.groupBy("key").agg(F.any_value("state").alias("state"), F.any_value("specs").alias("specs"))


def fan_out(asks: DataFrame, cache: DataFrame) -> DataFrame:
    """Answers for every ask, by key. Where a key was answered twice (two writers), the least answer rules, for all rows alike."""
    once = cache.groupBy("key").agg(F.min_by("answers", F.to_json("answers")).alias("answers"))
    return asks.join(once, "key", "left")


def latest(cache: DataFrame, key: str = "key", at: str = "created_at") -> DataFrame:
    """The last row of each key; the greatest result among equals, so that a rerun gives the same."""
    rest = [c for c in cache.columns if c not in (key, at)]
    best = cache.groupBy(key).agg(F.max(F.struct(at, *rest)).alias("_b"))
    return best.select(key, *[F.col(f"_b.{c}").alias(c) for c in cache.columns if c != key])
