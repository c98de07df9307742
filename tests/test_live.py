"""Streams that end: live solving, and sinks in which a row arrives once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from foliate.sources.store import Store
from foliate.streaming import live

KIND = "doc_id long, at timestamp, id long, text string"
NAMES = ["Ann", "Bo", "none_of_these"]
START = dt.datetime(2024, 1, 1)


def passages(n, doc, size=40, first=0, hours=0):
    return [(doc, START + dt.timedelta(hours=hours, minutes=k), k, f"{doc}:{k} " + "x" * (size - len(f"{doc}:{k} "))) for k in range(first, first + n)]


def batch_twin(rows, limit, overhead=0):
    out = {}
    for doc in {r[0] for r in rows}:
        text = ""
        for step, r in enumerate(sorted((x for x in rows if x[0] == doc), key=lambda x: x[1:3]), 1):
            text = r[3] if step == 1 else f"{text}\n\n{r[3]}"
            tokens = -(-len(text) // 4) + overhead
            out[doc, step] = (r[2], "warn" if tokens > limit else "step", tokens)
            if tokens > limit:
                break
    return out


class Stream:
    """A folder of Parquet files read as a stream, into a store."""

    def __init__(self, spark, tmp_path, limit, overhead=0, idle_ms=None):
        self.spark, self.root, self.args = spark, tmp_path, (limit, overhead, idle_ms)
        self.store = Store(spark, str(tmp_path / "out"))

    def add(self, rows, name):
        self.spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(str(self.root / "in" / name))

    def run(self, stop_after_sink=False):
        source = self.spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(self.root / "in" / "*"))
        if self.args[2] is not None:
            source = source.withWatermark("at", "0 seconds")
        solved = live.solve(source, NAMES, *self.args)
        sink = live.once(self.store, "steps", ["doc_id", "step", "kind"])

        def write(batch, batch_id):
            sink(batch, batch_id)
            if stop_after_sink:
                raise RuntimeError("lost after the rows were written")

        with live.keyed_state(self.spark):
            q = solved.writeStream.foreachBatch(write).option("checkpointLocation", str(self.root / "state")).trigger(availableNow=True).start()
            q.awaitTermination()

    def rows(self):
        return {(r.doc_id, r.step): (r.id, r.kind, r.tokens) for r in self.store.read("steps").where("kind <> 'done'").collect()}


def test_a_document_ends_at_the_limit(spark, tmp_path):
    s = Stream(spark, tmp_path, 60, 5)
    rows = [*passages(8, 1), *passages(3, 2), *passages(30, 3, 21)]
    s.add(rows, "a")
    s.run()
    assert s.rows() == batch_twin(rows, 60, 5)
    kinds = [k for (d, _), (_, k, _) in sorted(s.rows().items()) if d == 1]
    assert kinds.count("warn") == 1 and kinds[-1] == "warn" and len(kinds) < 8
    before, version = s.rows(), s.store.version()
    # after a restart from the checkpoint: ended documents take nothing, others go on where they were
    more = [*passages(5, 1, first=8), *passages(2, 2, first=3)]
    s.add(more, "b")
    s.run()
    assert s.rows() == batch_twin([*rows, *more], 60, 5) and {k for k in s.rows() if k not in before} == {(2, 4), (2, 5)}
    assert s.store.version() == version + 1
    s.run()
    assert s.store.version() == version + 1
    # answers are those of a batch over the same texts
    d = s.store.read("steps").where("kind = 'step'")
    assert d.count() and d.where("leader IS NULL OR p4 IS NULL").count() == 0
    assert s.store.read("steps").where("kind = 'warn' AND leader IS NOT NULL").count() == 0


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    s = Stream(spark, tmp_path, 60)
    s.add(passages(4, 1), "a")
    with pytest.raises(Exception, match="lost after"):
        s.run(stop_after_sink=True)
    assert len(s.rows()) == 4 and s.store.version() == 1
    s.run()
    assert s.rows() == batch_twin(passages(4, 1), 60) and s.store.read("steps").count() == 4 and s.store.version() == 1


def test_an_idle_document_is_done(spark, tmp_path):
    s = Stream(spark, tmp_path, 1000, 0, 60_000)
    s.add(passages(3, 1), "a")
    s.add(passages(2, 2, hours=5), "b")
    s.run()
    s.add(passages(1, 2, first=2, hours=9), "c")
    s.run()
    s.add(passages(2, 1, first=3, hours=9), "d")
    s.run()
    done = {(r.doc_id, r.step) for r in s.store.read("steps").where("kind = 'done'").collect()}
    assert (1, 3) in done and len([d for d in done if d[0] == 1]) == 1
    assert len([k for k in s.rows() if k[0] == 1]) == 3, "what comes after the end is not taken"


def test_event_frames(spark):
    got = live.event_frames(spark.createDataFrame([(1, "Ann")], "t int, leader string"), "step", ["t", "leader"]).first().frame
    assert got == 'event: step\ndata: {"t":1,"leader":"Ann"}\n\n'


def test_null_passages_and_ties(spark, tmp_path):
    s = Stream(spark, tmp_path, 8)
    s.add([(1, START, 2, "b" * 9), (1, START, 1, None), (None, START, 1, "a")], "a")
    s.run()
    assert {(d, n): v for (d, n), v in s.rows().items()} == {(1, 1): (1, "step", 0), (1, 2): (2, "step", 3), (None, 1): (1, "step", 1)}
    assert s.store.read("steps").where(F.col("p4").isNotNull()).count() == 3


def test_costs_round_as_their_sql(spark):
    """Halves of a millionth, where binary prices and half-even rounding go astray."""
    duckdb = pytest.importorskip("duckdb")
    want = [r[0] for r in duckdb.sql("SELECT round(i::BIGINT * 0.042 / 1e6, 6) FROM range(1, 100000) t(i) ORDER BY i").fetchall()]
    assert [r[0] for r in spark.range(1, 100000, 1, 1).select(live.cost_of(F.col("id"))).collect()] == want
