"""Runs of the whole flow: what they are made of, what they ask, and what they feed back."""

import json

import pytest
from pyspark.sql import functions as F

from foliate.operators import ledger, scoring
from foliate.plans import book
from foliate.plans.questions import INFERENCE, Context, resolve
from foliate.sources.store import Store

WHO = ["Clara", "Boris", "Clara", "Denis", "Clara", "Boris"]
STORY = "\n\n".join(f"CHAPTER {n}\n\n" + "\n\n".join(f"That night {w} saw Anna near the gate. Then {w} told Boris that Anna was gone, and Boris left number {k} of {n}." for k, w in enumerate(WHO)) for n in ("I", "II"))
CAST = [{"canonical": "Anna", "is_suspect": True}, {"canonical": "Boris", "aliases": ["Bo"], "is_suspect": True}, {"canonical": "Clara"}]
S = book.Settings(target=40, window=2)


@pytest.fixture(scope="module")
def books(spark, tmp_path_factory):
    """Two books; small plans over little data are run as they are, without compiling them."""
    folder = tmp_path_factory.mktemp("flow")
    (folder / "shelf").mkdir()
    (folder / "shelf" / "gate.txt").write_text(STORY)
    (folder / "shelf" / "lamp.txt").write_text(STORY.replace("gate", "lamp"))
    book.ingest(spark, str(folder / "shelf")).write.parquet(str(folder / "books"))
    quick = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    for k, v in quick.items():
        spark.conf.set(k, v)
    yield spark.read.parquet(str(folder / "books"))
    for k in quick:
        spark.conf.unset(k)


class Counting(scoring.MockScorer):
    """The mock, noting keys in a folder as they are asked."""

    def __init__(self, path):
        self.path = str(path)

    def __call__(self, asks):
        asks.select("key").write.mode("append").parquet(self.path)
        return super().__call__(asks)

    def keys(self, spark):
        return sorted(r.key for r in spark.read.parquet(self.path).collect())


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_changed_settings_give_fresh_rows(spark, books, tmp_path):
    out = str(tmp_path / "out")
    first = book.run_books(books, out, S)
    version = Store(spark, out).version()
    kept = {k: rows(first[k], *first[k].columns) for k in ("chunks", "ledger", "results")}
    book.run_books(books, out, S)
    assert Store(spark, out).version() == version, "a second run of the same input does nothing"
    other = book.Settings(target=20, window=3)
    again = book.run_books(books, out, other)
    want = rows(book.chunk_books(books, 20), "doc_id", "t", "text")
    assert rows(again["chunks"], "doc_id", "t", "text") == want and len(want) > len(kept["chunks"])
    for name in ("ledger", "results"):
        assert rows(again[name], "doc_id", "t") == [r[:2] for r in want]
    back = book.run_books(books, out, S)
    assert {k: rows(back[k], *back[k].columns) for k in kept} == kept
    assert rows(book.latest(spark, out, "results"), "doc_id", "t", "run_id") == rows(back["results"], "doc_id", "t", "run_id")
    assert rows(book.latest(spark, out, "chunks"), "doc_id", "t", "text") == rows(back["chunks"], "doc_id", "t", "text")


def test_candidate_set(spark, books, tmp_path):
    out = str(tmp_path / "out")
    given = {r.book_id: CAST for r in books.collect()}
    few = book.Settings(target=40, window=2, candidate_set="suspects_only")
    every = book.run_books(books, out, S, given, limit=2)
    some = book.run_books(books, out, few, given, limit=2)
    names = lambda t: {tuple(d.option for d in r.distribution) for r in t["results"].collect()}
    assert names(every) == {("Anna", "Boris", "Clara", "none_of_these")} and names(some) == {("Anna", "Boris", "none_of_these")}
    assert Store(spark, out).read("made").where("stage = 'ledger' AND n > 0 AND calls > 0").count() == 2, "both runs have one ledger"
    one = [{**c, "is_suspect": c["canonical"] == "Anna"} for c in CAST]
    with pytest.raises(Exception, match="two suspects"):
        book.run_books(books, out, few, dict.fromkeys(given, one), limit=2)
    with pytest.raises(ValueError, match="unknown candidate set"):
        book.run_books(books, out, book.Settings(candidate_set="all"))


def test_changed_text_and_roster(spark, books, tmp_path):
    """A run that isn't a mock refuses, names what changed, and leaves the version as it is."""
    out, live, scorer = str(tmp_path / "out"), book.Settings(target=40, window=2, mock=False), scoring.MockScorer()
    ids = sorted(r.book_id for r in books.collect())
    given = dict.fromkeys(ids, CAST)
    with pytest.raises(ValueError, match="needs a scorer"):
        book.run_books(books, out, live, given)
    book.run_books(books, out, live, given, limit=1, scorer=scorer)
    before = rows(book.latest(spark, out, "ledger"), "doc_id", "t", "made_of")
    other = {**given, ids[0]: [*CAST, {"canonical": "Denis"}]}
    with pytest.raises(book.LedgerMismatch, match=f"^{ids[0]}: another roster$"):
        book.run_books(books, out, live, other, limit=1, scorer=scorer)
    assert rows(book.latest(spark, out, "ledger"), "doc_id", "t", "made_of") == before
    more = F.array_append("paragraphs", F.lit("Boris was seen by Anna again, as Clara said."))
    longer = books.withColumn("paragraphs", F.when(F.col("book_id") == ids[1], more).otherwise(F.col("paragraphs"))).withColumn("text_sha256", F.sha2(F.array_join("paragraphs", "\n"), 256))
    with pytest.raises(book.LedgerMismatch, match=f"^{ids[1]}: another text$"):
        book.run_books(longer, out, live, given, limit=1, scorer=scorer)
    forced = book.run_books(books, out, live, other, limit=1, scorer=scorer, force=True)
    changed = {d for d, _, _ in set(rows(book.latest(spark, out, "ledger"), "doc_id", "t", "made_of")) - set(before)}
    assert changed == {ids[0]}, "the other book's ledger stays"
    assert {len(r.suspicion) for r in forced["ledger"].collect() if r.doc_id == ids[0]} == {4}


def test_calls_are_counted_and_bounded(spark, books, tmp_path):
    out, n = str(tmp_path / "out"), book.chunk_books(books, 40).count()
    with pytest.raises(scoring.CallCeiling, match=f"ledger: {n} calls, of 3"):
        book.run_books(books, out, book.Settings(target=40, window=2, max_calls=3))
    store = Store(spark, out)
    assert store.read("ledger") is None and store.read("chunks").count() == n
    book.run_books(books, out, book.Settings(target=40, window=2, max_calls=n), limit=1)
    made = store.read("made").where("stage = 'ledger' AND calls > 0")
    assert {(r.n, r.calls) for r in made.collect()} == {(n // 2, n // 2)}
    # entries lost though their calls were made: refused, not asked again
    store.stage("ledger", store.read("ledger").where("t > 1"))
    store.commit(replace=("ledger",))
    with pytest.raises(scoring.CallCeiling, match=f"{n // 2} calls made for {n // 2} chunks, 1 more due"):
        book.run_books(books, out, S)


def test_each_key_is_asked_once(spark, books, tmp_path):
    """Over documents with equal states, over a resumed run, and over a second run with the same states."""
    one = books.orderBy("book_id").limit(1)
    shelf = one.union(one.withColumn("book_id", F.lit("copy")))
    out, scorer = str(tmp_path / "out"), Counting(tmp_path / "asked")
    first = book.run_books(shelf, out, S, limit=3, scorer=scorer)
    assert first["results"].count() == 6
    early = rows(first["results"], "doc_id", "t", "answer")
    assert len(scorer.keys(spark)) == 3, "the copy's states are those of the original"
    full = book.run_books(shelf, out, S, limit=5, scorer=scorer)
    again = book.run_books(shelf, out, book.Settings(target=40, window=2, condition="another"), limit=5, scorer=scorer)
    keys = scorer.keys(spark)
    assert len(keys) == len(set(keys)) == 5
    strip = [c for c in full["results"].columns if c not in ("run_id", "answers")]
    assert rows(full["results"], *strip) == rows(again["results"], *strip) and full["results"].count() == 10
    assert not {r.run_id for r in full["results"].collect()} & {r.run_id for r in again["results"].collect()}
    assert early == rows(full["results"].where("t <= 3"), "doc_id", "t", "answer")


class Forgetful(scoring.MockScorer):
    """Leaves out a question of some calls, and some calls whole."""

    def __init__(self, how):
        self.how = how

    def __call__(self, asks):
        said = super().__call__(asks)
        if self.how == "call":
            return said.where("key >= '8'")
        if self.how == "question":
            return said.withColumn("answers", F.map_filter("answers", lambda q, _: (q != "alibi_effect") | (F.col("key") >= "8")))
        return said.withColumn("answers", F.transform_values("answers", lambda q, d: F.when(F.col("key") >= "8", d).otherwise(F.slice(d, 1, 1))))


@pytest.mark.parametrize("how", ["call", "question", "options"])
def test_missing_answers_are_seen(spark, how):
    asks = spark.range(40).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), F.lit("a state").alias("state"), F.lit([1]).alias("cast"))
    asks = asks.select("key", "state", scoring.specs_of(INFERENCE, F.array(F.struct(F.lit("Anna").alias("canonical")))).alias("specs"))
    said = asks.join(Forgetful(how)(asks), "key", "left").select("key", scoring.unanswered(F.col("specs"), F.col("answers")).alias("n"))
    lost = {"call": 4, "question": 1, "options": 4}[how]
    assert {(r.key >= "8", r.n) for r in said.collect()} == {(True, 0), (False, lost)}


def test_a_missing_answer_is_an_error(spark, books, tmp_path):
    out = str(tmp_path / "out")
    with pytest.raises(scoring.MissingAnswer, match="answers: .* answers are missing"):
        book.run_books(books, out, S, scorer=Forgetful("question"))
    store = Store(spark, out)
    assert store.read("results") is None and store.read("answers") is None and store.read("ledger").count() > 0


def test_posthoc_answers_reach_later_states(spark, books, tmp_path):
    """A run in two parts; what was asked at each step is rebuilt step by step from the answers stored before it."""
    one, out = books.orderBy("book_id").limit(1), str(tmp_path / "out")
    settings, scorer = book.Settings(target=20, window=2, posthoc=True), Counting(tmp_path / "asked")
    part = book.run_books(one, out, settings, limit=3, scorer=scorer)
    assert sorted(r.t for r in part["results"].collect()) == [1, 2, 3]
    done = book.run_books(one, out, settings, scorer=scorer)
    keys = scorer.keys(spark)
    said = {r.t: r.contradicts_prior for r in done["results"].collect()}
    n = done["chunks"].count()
    assert len(said) == n == len(keys) == len(set(keys))
    flagged = {t for t, p in said.items() if p >= 5000}
    assert flagged and len(flagged) < n and min(flagged) + settings.window <= n
    full = book.with_roster(done["chunks"], book.latest(spark, out, "roster").drop("made_of")).persist()
    entries, stored = done["ledger"].persist(), done["results"].select("doc_id", "t", "contradicts_prior").persist()
    shown = book.states_of(full, entries, settings, stored)
    states = {r.t: r.state for r in shown.collect()}
    for t, state in states.items():
        assert state.count("post-hoc: contradicts earlier notes") == len({f for f in flagged if f + settings.window <= t})
    for t in (1, min(flagged) + settings.window, n):
        alone = book.states_of(full, entries, settings, stored.where(F.col("t") <= t - settings.window), between=(t, t)).collect()
        assert [(r.t, r.state) for r in alone] == [(t, states[t])], "a state shows no answer of a step less than a window back"
    asked = {r.t: r.key for r in book.asks_of(shown, settings, scorer).collect()}
    answers = {r.key: r.answers["contradicts_prior"][0].p4 for r in Store(spark, out).read("answers").collect()}
    assert {t: answers[key] for t, key in asked.items()} == said, "the stored answers are those to these states"
    plain = {r.t: r.state for r in book.states_of(full, entries, book.Settings(target=20, window=2)).collect()}
    assert not any("post-hoc" in s for s in plain.values()), "no answer enters the ledger"
    assert [t for t in states if states[t] != plain[t]] == [t for t in states if any(f + settings.window <= t for f in flagged)]


def test_specs_are_those_of_the_battery(spark):
    """Resolved by column for every row as by the driver for one cast."""
    battery = [*INFERENCE, {"id": "guilt", "type": "score", "scope": "history_aware", "per_character": True, "text": "How guilty is {name}?", "levels": ["a", "b"]}]
    cast = [{"canonical": "Anna"}, {"canonical": "anna!"}, {"canonical": "Bo"}, {"canonical": "é"}]
    names = [c["canonical"] for c in cast]
    df = spark.createDataFrame([([(n, [n]) for n in names],)], "cast array<struct<canonical: string, names: array<string>>>")
    got = df.select(scoring.specs_of(battery, F.col("cast")).alias("s")).first().s
    want = resolve(battery, Context(cast, candidates=names))
    yes_no = lambda s: [o for o, _ in s.options] or ["yes", "no"]
    assert [(s.id, s.type, s.text, s.options) for s in got] == [(s.id, s.type, s.instructions, yes_no(s)) for s in want]


def test_states_gather_live_notes_only(spark):
    """Rolled-up notes are dealt to no step: what a window holds follows the budget, not the length of the document."""
    n = 60
    rows_ = [(1, t, f"part {t // 7}", f"#{t} note " + "x" * 30, f"text {t}", "movement", False, None) for t in range(1, n + 1)]
    steps = spark.createDataFrame(rows_, "doc_id long, t int, chapter string, note string, text string, event string, evidence boolean, quote string")
    plans = ledger.rollups_by_document(ledger.step_rollups(steps, 160, 3))
    whole = {r.t: r.state for r in ledger.rolled_states(steps, 160, 3).collect()}
    assert sum("SUMMARY" in s for s in whole.values()) > 20
    for lo, hi in ((1, 4), (20, 22), (45, 45), (58, 90)):
        part = {r.t: r.state for r in ledger.rolled_states(steps, 160, 3, plans=plans, between=(lo, hi)).collect()}
        assert part == {t: s for t, s in whole.items() if lo <= t <= hi}
    epochs = plans.select(ledger._epochs(F.col("rollups")).alias("e")).first().e
    dealt = sum(1 for t in range(1, n + 1) for e in epochs if e.covered < t <= e.last)
    assert dealt < 4 * n, "each note is dealt to a few epochs"
    assert json.dumps([[e.first, e.last] for e in epochs]).count("2147483647") == 1
