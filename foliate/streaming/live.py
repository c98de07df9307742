"""Streams: live solving of a sequence of passages, and running costs over events (an extension of our own)."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.scoring import mock_distribution, winner
from ..sources.store import Store

PRICE_PER_M = 0.042
RUNNING = "user_id long, event_id long, ts timestamp, tokens long, running_tokens long, running_cost double, warned boolean"


def event_frames(rows: DataFrame, event: str, payload: list[str]) -> DataFrame:
    """Server-sent event frames of rows."""
    return rows.select(F.concat(F.lit(f"event: {event}\ndata: "), F.to_json(F.struct(*payload)), F.lit("\n\n")).alias("frame"))


def cost_of(tokens: Column, price: float = PRICE_PER_M) -> Column:
    """The cost of tokens, to six places, halves upwards. The price is taken as the decimal that it is written as, or halves would go
    either way."""
    over, under = Decimal(str(price)).as_integer_ratio()
    return F.floor(tokens * over / float(under) / 1e6 * 1e6 + 0.5) / 1e6


def running_cost(events: DataFrame, limit: int = 10**9, price: float = PRICE_PER_M) -> DataFrame:
    """Running tokens and cost of each user over a stream of events, kept as state. warned marks what is past the limit.

    State is two numbers a user. Events of a micro-batch are taken in order of (ts, event_id); late ones are added when they come.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0
        got = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        run = got["tokens"].cumsum() + total
        state.update((int(run.iloc[-1]),))
        yield pd.DataFrame({"user_id": key[0], "event_id": got["event_id"], "ts": got["ts"], "tokens": got["tokens"], "running_tokens": run, "warned": run > limit})

    priced = events.select("user_id", "event_id", "ts", tokens_of(events).alias("tokens"))
    out = priced.groupBy("user_id").applyInPandasWithState(step, RUNNING.replace("running_cost double, ", ""), "total long", "append", GroupStateTimeout.NoTimeout)
    return out.withColumn("running_cost", cost_of(F.col("running_tokens"), price)).select("user_id", "event_id", "ts", "tokens", "running_tokens", "running_cost", "warned")


def tokens_of(events: DataFrame):
    return F.ceil(F.length(F.coalesce(events["props"], F.lit(""))) / 4.0).cast("long")


def windowed_cost(events: DataFrame, window: str = "1 hour", late: str = "2 hours", price: float = PRICE_PER_M) -> DataFrame:
    """Calls, tokens and cost of each window and event type; a watermark closes windows and drops what is later than late."""
    priced = events.withColumn("tokens", tokens_of(events)).withWatermark("ts", late)
    agg = priced.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"))
    return agg.select(F.col("window.start").alias("start"), "event_type", "calls", "tokens", cost_of(F.col("tokens"), price).alias("cost"))


SEEN = "text string, steps int, ended boolean"
SOLVED = "doc_id {kind}, step int, id bigint, kind string, tokens bigint, state string"


class Solver(StatefulProcessor):
    """One document of a live solve: the text so far, until it is too long to ask about.

    State is the text so far, which the limit bounds, and a flag that stays when the text goes: a document that has ended takes
    nothing more, after a restart either. Of a batch only as many passages are held, in order, as the limit has room for.
    """

    def __init__(self, limit: int, overhead: int, idle_ms: int | None):
        self.limit, self.overhead, self.idle_ms = limit, overhead, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", SEEN)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        text, steps, ended = self.seen.get() if self.seen.exists() else ("", 0, False)
        if ended:
            return
        # A passage adds two characters or more, so no more than this many come to the limit.
        last = None
        room = max(0, 2 * self.limit - len(text) // 2) + 2
        for r in heapq.nsmallest(room, rows, key=lambda r: (r["us"], r["id"])):
            steps, last = steps + 1, r["us"] // 1000
            longer = f"{text}\n\n{r['text'] or ''}" if steps > 1 else r["text"] or ""
            tokens = -(-len(longer) // 4) + self.overhead
            ended = tokens > self.limit
            yield Row(doc_id=key[0], step=steps, id=r["id"], kind="warn" if ended else "step", tokens=tokens, state=None if ended else longer)
            if ended:
                break
            text = longer
        self.seen.update(("" if ended else text, steps, ended))
        if self.idle_ms is not None and last is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if not ended:
                self.handle.registerTimer(last + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        text, steps, ended = self.seen.get()
        if not ended:
            self.seen.update(("", steps, True))
            yield Row(doc_id=key[0], step=steps, id=None, kind="done", tokens=-(-len(text) // 4) + self.overhead, state=text)

    def close(self) -> None:
        pass


def solve(passages: DataFrame, candidates: list[str], limit: int, overhead: int = 0, idle_ms: int | None = None) -> DataFrame:
    """Live solving of a stream of passages (doc_id, at, id, text): after each, who did it by all read so far.

    kind is step (leader and p4, its share), warn (the text so far, with overhead, has more tokens than limit: it isn't asked, and the
    document has ended), or, with idle_ms, done (nothing came for so long in event time, for which passages need a watermark: the
    answer stands). Passages of a micro-batch are taken in order of (at, id). A null text is an empty passage.
    """
    kind = passages.schema["doc_id"].dataType.simpleString()
    rows = passages.select("doc_id", "at", F.unix_micros(F.col("at").cast("timestamp")).alias("us"), F.col("id").cast("long").alias("id"), "text")
    out = rows.groupBy("doc_id").transformWithState(Solver(limit, overhead, idle_ms), SOLVED.format(kind=kind), "Append", "None" if idle_ms is None else "EventTime")
    d = out.withColumn("d", F.when(F.col("state").isNotNull(), mock_distribution(F.col("state"), "culprit", candidates)))
    return d.select("doc_id", "step", "id", "kind", "tokens", F.when(F.col("d").isNotNull(), winner(F.col("d"))).alias("leader"), F.array_max(F.transform("d", lambda x: x["p4"])).alias("p4"))


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in the store that timers and several kinds of state need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def once(store: Store, name: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink in which a row of the same keys arrives once: a batch that is repeated after a failure adds nothing.
    Each batch is one version of the store."""

    def write(batch: DataFrame, batch_id: int) -> None:
        there = store.read(name, batch.schema).select(*keys)
        with store.transaction():
            store.stage(name, batch.dropDuplicates(keys).join(there, keys, "left_anti").select(*batch.columns))
        store.compact(name)

    return write
