"""From files to results: the whole flow over many books at once.

Every derived row names what it was made of: a hash of the text, settings, roster and questions behind it. A run makes what is
missing for today's hashes and reads no other rows, so that a second run of the same input does nothing, a changed setting gives
fresh rows, and going back to the old setting finds the old ones. Each stage is staged, checked and committed (sources.store).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import alias_pattern, sentence_texts, token_count, word_count
from ..operators import chunking, curves, entities, extraction, ledger, results, scoring
from ..operators.scoring import CallCeiling, MissingAnswer, MockScorer, Scorer, budget_guard, question_tokens
from ..sources import readers
from ..sources.store import Store, check_steps
from .questions import COMPRESSION, INFERENCE, Context, questions_hash, resolve

VERSION = "2"
BOOK = "book_id string, source string, kind string, title string, author string, n_words bigint, n_paragraphs int, text_sha256 string, paragraphs array<string>, chapters array<struct<title:string,paragraph_offset:int>>"
MADE = "doc_id string, stage string, made_of string, version string, text string, roster string, questions string, n int, calls int, seen int"
#: Fields of a ledger's header that must be as today's.
HEADER = ["version", "text", "roster", "questions"]


class LedgerMismatch(RuntimeError):
    """A ledger was built of other inputs; it is rebuilt only if that is asked for."""


@dataclass(frozen=True)
class Settings:
    target: int = 500
    window: int = 3
    budget: int = 26_000
    candidate_set: str = "full_cast"
    condition: str = "plain"
    mock: bool = True
    posthoc: bool = False
    max_calls: int | None = None

    def identity(self) -> str:
        """What a run's results depend on; how many calls it may make is no part of it."""
        return json.dumps({k: v for k, v in asdict(self).items() if k != "max_calls"}, sort_keys=True)


def run_id(book_id: str, model: str, ledger_hash: str, s: Settings) -> str:
    """The same inputs give the same run, which is then resumed."""
    parts = [book_id, model, ledger_hash, questions_hash(INFERENCE), s.identity()]
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:12]


def run_ids(book_id: Column, model: str, ledger_hash: Column, s: Settings) -> Column:
    """run_id of many books."""
    return _hash(book_id, F.lit(model), ledger_hash, F.lit(questions_hash(INFERENCE)), F.lit(s.identity()))


def _hash(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 12)


def ingest(spark: SparkSession, path: str) -> DataFrame:
    """Books of readable files; files in error and books without text are left out (readers.parse shows them)."""
    files = readers.read_files(spark, path)
    parsed = readers.parse(files, ["name", "kind"], readers.kinds_of(files)).where("error IS NULL AND size(paragraphs) > 0")
    known = readers.book_ids(parsed.withColumn("url", F.concat(F.lit("file:"), "name")))
    words = F.aggregate(F.transform("paragraphs", word_count), F.lit(0).cast("long"), lambda a, n: a + n)
    out = known.select("book_id", F.col("url").alias("source"), "kind", F.coalesce("title", F.initcap(F.regexp_replace(F.regexp_replace("name", r"\.[^.]*$", ""), "[-_]+", " "))).alias("title"), "author",
                       words.alias("n_words"), F.size("paragraphs").alias("n_paragraphs"), F.sha2(F.array_join("paragraphs", "\n"), 256).alias("text_sha256"), "paragraphs", "chapters")
    return out.dropDuplicates(["book_id"])


def chunk_books(books: DataFrame, target: int) -> DataFrame:
    """doc_id (the book), t, ranges, text, sentences, chapter. Chapters are few a book and lie in its row, so no join is needed."""
    p = books.select(F.col("book_id").alias("doc_id"), F.col("paragraphs").alias("paras"), "chapters")
    p = p.withColumn("ranges", chunking.chunk_ranges(F.transform("paras", word_count), target))
    c = p.select("doc_id", "paras", "chapters", F.inline("ranges"))
    own = F.slice("paras", F.col("para_from") + 1, F.col("para_to") - F.col("para_from"))
    before = F.filter("chapters", lambda x: x["paragraph_offset"] <= F.col("para_from"))
    chapter = F.when(F.size(before) > 0, F.element_at(before, -1)["title"])
    found = F.flatten(F.transform(own, sentence_texts))
    return c.select("doc_id", "t", "para_from", "para_to", "word_count", (F.col("word_to") - F.col("word_count")).alias("word_from"), "word_to", F.array_join(own, "\n\n").alias("text"), found.alias("sentences"), chapter.alias("chapter"))


def rosters(chunked: DataFrame, given: dict[str, list[dict]] | None = None, found: DataFrame | None = None) -> DataFrame:
    """A roster row for each entity: book, ord, canonical, names, is_suspect, pattern. Given rosters rule; other books get those found
    (extraction.usable), or else their most frequent names."""
    spark, given = chunked.sparkSession, given or {}
    if found is None:
        docs = chunked.select("doc_id", "text").where(~F.col("doc_id").isin(list(given))) if given else chunked.select("doc_id", "text")
        found = entities.heuristic_roster(docs, "doc_id", separator="\n\n").select("doc_id", "ord", "canonical", F.array("canonical").alias("names"), F.lit(False).alias("is_suspect"))
        pattern = F.concat(F.lit(r"(?:^|[^\p{L}\p{N}_])"), "canonical", F.lit(r"(?:$|[^\p{L}\p{N}_])"))
        found = found.withColumn("pattern", pattern)
    rows = [(b, i + 1, c["canonical"], n, bool(c.get("is_suspect")), alias_pattern(n)) for b, cast in given.items() for i, c in enumerate(cast) for n in [list(dict.fromkeys([c["canonical"], *c.get("aliases", [])]))]]
    return found.unionByName(spark.createDataFrame(rows, found.schema)) if rows else found


def with_roster(chunked: DataFrame, roster: DataFrame) -> DataFrame:
    """Adds cast: the book's entities in order. A roster is a few names a book, so the array is small."""
    cast = roster.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "canonical", "names", "is_suspect", "pattern"))).alias("cast"))
    return chunked.join(cast, "doc_id", "left").withColumn("cast", F.coalesce("cast", F.array().cast(cast.schema["cast"].dataType)))


def build_ledger(chunked: DataFrame, done: DataFrame) -> DataFrame:
    """Entries of chunks that have none yet. chunked has cast and sentences; done: doc_id, t."""
    return ledger.entries_by_cast(results.pending(chunked, done, ["doc_id", "t"]))


def candidates(settings: Settings) -> Column:
    """The entities of column cast that can be the answer: all, or the suspects, of whom there must be two at least."""
    if settings.candidate_set not in ("full_cast", "suspects_only"):
        raise ValueError(f"unknown candidate set {settings.candidate_set!r}")
    if settings.candidate_set == "full_cast":
        return F.col("cast")
    named = F.filter("cast", lambda c: c["is_suspect"])
    return F.when(F.size(named) >= 2, named).otherwise(F.raise_error(F.concat(F.lit("suspects_only needs at least two suspects: "), F.col("doc_id").cast("string"))))


def states_of(chunked: DataFrame, entries: DataFrame, settings: Settings, posthoc: DataFrame | None = None, plans: DataFrame | None = None, between: tuple[int, int] | None = None) -> DataFrame:
    """The state of every step, notes rolled up where a book is over budget (ledger.rolled_states), and verdict: ok, budget (over it
    with all rolled up, here or at an earlier step), state or request (too long with the questions).

    posthoc: doc_id, t, contradicts_prior (ten-thousandths), stored answers that show in notes. A note shows from step t + window
    on, and its answer with it. plans: plan(chunked, entries, settings), if it is known; between: the only steps wanted.
    """
    if plans is None:
        plans = plan(chunked, entries, settings)
    suspects = F.transform(candidates(settings), lambda c: c["canonical"]) if settings.candidate_set != "full_cast" else None
    rows = entries.join(chunked.select("doc_id", "t", "text", "cast"), ["doc_id", "t"])
    said = None
    if posthoc is not None:
        rows = rows.join(posthoc.select("doc_id", "t", F.col("contradicts_prior").alias("_said")), ["doc_id", "t"], "left")
        said = F.col("_said") / 10000.0
    joined = ledger.noted(rows, ("text", "cast"), suspects, said)
    states = ledger.rolled_states(joined, settings.budget, settings.window, ("cast",), plans, between)
    others = lambda c: F.array_remove(F.array_distinct(c["names"]), c["canonical"])
    shown = lambda c: F.length(c["canonical"]) + F.when(F.size(others(c)) > 0, F.lit(len("also called: ")) + F.length(F.array_join(others(c), ", "))).otherwise(0)
    length = F.aggregate(F.transform(candidates(settings), shown), F.lit(0), lambda a, n: a + n)
    culprit, *rest = resolve(INFERENCE, Context([], []))
    every, longest = question_tokens(rest)
    own = F.ceil((length + len(culprit.instructions + culprit.options[0][0])) / 4.0)
    judged = budget_guard(states, [], asked=(own + every, F.greatest(own, F.lit(longest))))
    return judged.withColumn("verdict", F.when(F.col("over_budget"), "budget").otherwise(F.col("verdict"))).drop("over_budget")


def plan(chunked: DataFrame, entries: DataFrame, settings: Settings) -> DataFrame:
    """Rollups by document. They are a property of the ledger: all entities are shown, and nothing that a run answered."""
    joined = ledger.noted(entries.join(chunked.select("doc_id", "t", "text"), ["doc_id", "t"]), ("text",))
    return ledger.rollups_by_document(ledger.step_rollups(joined, settings.budget, settings.window))


def asks_of(states: DataFrame, settings: Settings, scorer: Scorer, questions: list[dict] = INFERENCE) -> DataFrame:
    """doc_id, t, state, specs, key: one call for each step that can be asked, with the whole battery."""
    ok = states.where("verdict = 'ok'").withColumn("specs", scoring.specs_of(questions, candidates(settings)))
    return ok.withColumn("key", scoring.cache_key(scorer.model, "mock" if settings.mock else "live", F.col("state"), F.col("specs"))).drop("verdict", "state_tokens")


def result_rows(answered: DataFrame, model: str) -> DataFrame:
    """doc_id, t and what was answered. answered has state, specs and answers."""
    of = lambda q: F.element_at("answers", F.lit(q))
    yes = lambda q: F.get(of(q), 0)["p4"].alias(q)
    return answered.select(
        *(["run_id"] if "run_id" in answered.columns else []), "doc_id", "t", curves.winner(of("culprit")).alias("answer"), curves.confidence(of("culprit")).alias("confidence4"), of("culprit").alias("distribution"), yes("contradicts_prior"), yes("culprit_revealed"),
        curves.winner(of("alibi_effect")).alias("alibi_effect"), token_count(F.col("state")).alias("input_tokens"), F.lit(model).alias("model"), F.col("answers").cast(scoring.ANSWERS).alias("answers"),
    )


def refused(states: DataFrame) -> DataFrame:
    """Steps that can't be asked, and why."""
    return states.where("verdict <> 'ok'").select("doc_id", "t", "state_tokens", "verdict")


def run_all(spark: SparkSession, path: str, out: str, settings: Settings = Settings(), given: dict[str, list[dict]] | None = None, limit: int | None = None, scorer: Scorer | None = None, force: bool = False, extractor: extraction.Extractor | None = None) -> dict[str, DataFrame]:
    """Ingests the files under path and brings the tables under out up to date (run_books)."""
    return run_books(ingest(spark, path), out, settings, given, limit, scorer, force, extractor)


def run_books(books: DataFrame, out: str, settings: Settings = Settings(), given: dict[str, list[dict]] | None = None, limit: int | None = None, scorer: Scorer | None = None, force: bool = False, extractor: extraction.Extractor | None = None) -> dict[str, DataFrame]:
    """Brings the tables under out up to date: books, chunks, roster, ledger, rollups, results. Gives those of the books, and
    refused: steps that can't be asked (not stored; they are judged anew each time). limit counts steps on the ordered axis.

    A ledger built of another text, roster or battery, or by another version, is rebuilt if the run is a mock or forced, and
    otherwise raises LedgerMismatch. Raises, before anything of the stage is committed: BadSteps where steps repeat or leave a gap,
    CallCeiling where a document would be compressed by more calls than it has chunks or the run asks more than max_calls, and
    MissingAnswer where a question has none.

    extractor makes the rosters of books that have none given, from their whole texts; a book it fails on raises ExtractionError,
    and what it found in other books is kept for the next run.
    """
    if not settings.mock and scorer is None:
        raise ValueError("a run that isn't a mock needs a scorer")
    flow = Flow(Store(books.sparkSession, out), settings, scorer or MockScorer())
    candidates(settings)
    books = flow.books(books)
    chunks = flow.chunks(books)
    roster = flow.rosters(chunks, given or {}, books, extractor)
    full = with_roster(chunks, roster)
    entries = flow.ledger(full, force)
    run, last = flow.results(full, entries, limit)
    return {"books": books, "chunks": chunks.drop("made_of"), "roster": roster.drop("made_of"), "ledger": entries.drop("made_of"), "results": run, "refused": refused(last)}


@dataclass
class Flow:
    """The stages of a run over one store. Each gives the rows that count today."""

    store: Store
    settings: Settings
    scorer: Scorer
    #: Calls made by stage; documents' own are in their headers.
    calls: dict[str, int] = field(default_factory=dict)

    def made(self) -> DataFrame:
        return self.store.read("made", MADE)

    def _latest(self, stage: str) -> DataFrame:
        """The last header of each document."""
        rows = self.made().where(F.col("stage") == stage)
        return rows.groupBy("doc_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "doc_id"]), "seen").alias("h")).select("doc_id", "h.*")

    def _note(self, stage: str, headers: DataFrame) -> None:
        """Headers of what is staged, for the same commit. headers: doc_id, made_of, n and what else is known."""
        have, kinds = set(headers.columns), dict(part.rsplit(" ", 1) for part in MADE.split(", "))
        own = {"stage": F.lit(stage), "seen": F.lit(self.store.version() + 1), "calls": F.lit(0)}
        self.store.stage("made", headers.select(*[(F.col(c) if c in have else own.get(c, F.lit(None))).cast(kind).alias(c) for c, kind in kinds.items()]))

    def _use(self, stage: str, ids: DataFrame) -> None:
        """Notes which rows count from now on, where that changed (a setting that is gone back to)."""
        key = ["doc_id", "made_of"]
        changed = ids.join(self._latest(stage).select(*key), key, "left_anti")
        if not changed.isEmpty():
            with self.store.transaction():
                self._note(stage, changed.withColumn("n", F.lit(0)))

    def books(self, found: DataFrame) -> DataFrame:
        """New and changed books are added; the text that each had last counts."""
        key = ["doc_id", "made_of"]
        found = found.persist(StorageLevel.DISK_ONLY)  # files are taken apart once, though ids and rows are both wanted
        ids = found.select(F.col("book_id").alias("doc_id"), F.col("text_sha256").alias("made_of"), F.lit(1).alias("n"))
        changed = ids.join(self._latest("books"), key, "left_anti")
        if not changed.isEmpty():
            known = self.made().where("stage = 'books'").select(F.col("doc_id").alias("book_id"), F.col("made_of").alias("text_sha256"))
            with self.store.transaction():
                self.store.stage("books", found.join(known, ["book_id", "text_sha256"], "left_anti"))
                self._note("books", changed)
            self.store.compact("books")
        found.unpersist()
        last = self._latest("books").select(F.col("doc_id").alias("book_id"), F.col("made_of").alias("text_sha256"))
        return self.store.read("books", found.schema).join(last, ["book_id", "text_sha256"], "left_semi")

    def chunks(self, books: DataFrame) -> DataFrame:
        want = books.select("*", _hash(F.lit(VERSION), F.lit(str(self.settings.target)), F.col("text_sha256")).alias("made_of"))
        ids = want.select(F.col("book_id").alias("doc_id"), "made_of")
        return self._add("chunks", lambda todo: chunk_books(want.join(todo.withColumnRenamed("doc_id", "book_id"), ["book_id", "made_of"], "left_semi"), self.settings.target), ids)

    def _add(self, stage: str, make: Callable[[DataFrame], DataFrame], ids: DataFrame, steps: bool = True) -> DataFrame:
        """Makes the rows of documents that have none yet for ids (doc_id, made_of), commits them with their headers, and gives the
        rows of ids. make takes the documents due, and gives their rows."""
        key = ["doc_id", "made_of"]
        ids = ids.persist(StorageLevel.DISK_ONLY)
        todo = ids.join(self.made().where(F.col("stage") == stage).select(*key), key, "left_anti")
        fresh = make(todo).join(ids, "doc_id")
        if not todo.isEmpty():
            with self.store.transaction():
                self.store.stage(stage, fresh)
                if steps:
                    check_steps(self.store.staged(stage, fresh.schema), key)
                n = self.store.staged(stage, fresh.schema).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
                self._note(stage, todo.join(n, key, "left").fillna(0, ["n"]))
            self.store.compact(stage)
        self._use(stage, ids)
        return self.store.read(stage, fresh.schema).join(ids, key, "left_semi")

    def rosters(self, chunks: DataFrame, given: dict[str, list[dict]], books: DataFrame, extractor: extraction.Extractor | None) -> DataFrame:
        """Given rosters rule, and are read anew when they change; names found in a text stay with that text and what found them."""
        spark = self.store.spark
        own = spark.createDataFrame([(b, hashlib.sha256(json.dumps(cast, sort_keys=True).encode()).hexdigest()) for b, cast in given.items()], "doc_id string, given string")
        ids = chunks.select("doc_id", "made_of").distinct().join(F.broadcast(own), "doc_id", "left")
        ids = ids.select("doc_id", F.when(F.col("given").isNotNull(), _hash(F.lit("given"), F.col("given"))).otherwise(_hash(F.lit("found"), *([F.lit(extractor.name)] if extractor else []), F.col("made_of"))).alias("made_of"))

        def make(todo: DataFrame) -> DataFrame:
            due, found = todo.select("doc_id"), None
            if extractor:
                texts = extraction.book_texts(books).join(due, "doc_id", "left_semi").join(F.broadcast(own), "doc_id", "left_anti")
                found = extraction.usable(extraction.extract(texts, extractor, self.store))
            return rosters(chunks.drop("made_of").join(due, "doc_id", "left_semi"), given, found).join(due, "doc_id", "left_semi")

        return self._add("roster", make, ids, steps=False)

    def ledger(self, full: DataFrame, force: bool) -> DataFrame:
        """Entries of today's chunks, one call a chunk, made once ever."""
        names = F.to_json(F.transform("cast", lambda c: F.struct(c["canonical"], c["names"])))  # who is a suspect is no part of a ledger
        want = full.groupBy("doc_id").agg(F.any_value("made_of").alias("text"), _hash(F.any_value(names)).alias("roster"), F.count(F.lit(1)).alias("n"))
        want = want.select("doc_id", F.lit(VERSION).alias("version"), "text", "roster", _hash(F.lit(questions_hash(COMPRESSION)), F.lit(self.scorer.model)).alias("questions"), F.col("n").cast("int").alias("n"))
        want = want.withColumn("made_of", _hash(*[F.col(f) for f in HEADER])).persist(StorageLevel.DISK_ONLY)
        key, ids = ["doc_id", "made_of"], want.select("doc_id", "made_of")
        calls = self.made().where("stage = 'ledger'").groupBy(*key).agg(F.sum("calls").alias("calls"))
        if not (self.settings.mock or force):
            stale = results.compatibility(self._latest("ledger"), want.join(calls, key, "left_anti"), HEADER).where(F.size("problems") > 0).limit(5).collect()
            if stale:
                raise LedgerMismatch("; ".join(f"{r.doc_id}: another {', '.join(r.problems)}" for r in stale))
        todo = full.drop("made_of").join(ids, "doc_id")
        todo = todo.join(self.store.read("ledger", "doc_id string, made_of string, t int"), [*key, "t"], "left_anti")
        fresh = ledger.entries_by_cast(todo, ("made_of",))
        due = todo.groupBy(*key).agg(F.count(F.lit(1)).alias("due")).join(want, key).join(calls, key, "left").persist(StorageLevel.DISK_ONLY)
        over = due.where(F.col("due") + F.coalesce("calls", F.lit(0)) > F.col("n")).limit(5).collect()
        if over:
            raise CallCeiling("; ".join(f"{r.doc_id}: {r.calls} calls made for {r.n} chunks, {r.due} more due" for r in over))
        if not due.isEmpty():
            missing = F.col("concerns").isNull() | F.col("event_type").isNull() | F.col("new_evidence").isNull()
            with self.store.transaction():
                self._guard("ledger", self.store.stage("ledger", fresh, calls=F.count(F.lit(1)), missing=F.count_if(missing)))
                check_steps(self.store.read("ledger", fresh.schema, staged=True).join(due.select(*key), key, "left_semi"), key)
                self._note("ledger", due.select(*key, *HEADER, "n", F.col("due").alias("calls")))
            self.store.compact("ledger")
        self._use("ledger", want.drop("n"))
        return self.store.read("ledger", fresh.schema).join(ids, key, "left_semi")

    def rollups(self, full: DataFrame, entries: DataFrame) -> DataFrame:
        """Rollups by document: made once for a ledger, a budget and a window."""
        s = self.settings
        of = entries.groupBy("doc_id").agg(_hash(F.any_value("made_of"), F.lit(str(s.budget)), F.lit(str(s.window))).alias("made_of"))
        return self._add("rollups", lambda todo: plan(full.join(todo.select("doc_id"), "doc_id", "left_semi"), entries, s), of, steps=False).drop("made_of")

    def _guard(self, stage: str, seen: dict) -> None:
        """Judges what was counted while rows were written, before they are committed."""
        calls, missing, ceiling = seen.get("calls") or 0, seen.get("missing") or 0, self.settings.max_calls
        if missing:
            raise MissingAnswer(f"{stage}: {missing} answers are missing")
        if ceiling is not None and calls > ceiling:
            raise CallCeiling(f"{stage}: {calls} calls, of {ceiling} that the run may make")
        self.calls[stage] = self.calls.get(stage, 0) + calls

    def results(self, full: DataFrame, entries: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Results of today's run, and the states of all its steps.

        Without post-hoc answers steps are independent and asked at once. With them, step t shows what was answered up to step
        t - window: steps are asked in waves of window, each wave of all books at once.
        """
        who = F.to_json(F.transform("cast", lambda c: F.struct(c["canonical"], c["names"], c["is_suspect"])))
        cast = full.groupBy("doc_id").agg(_hash(F.any_value(who)).alias("who"), F.max("t").alias("last"))
        runs = entries.groupBy("doc_id").agg(F.any_value("made_of").alias("made_of")).join(cast, "doc_id")
        runs = runs.select("doc_id", run_ids(F.col("doc_id"), self.scorer.model, F.concat_ws("-", "made_of", "who"), self.settings).alias("run_id"), "last")
        runs = runs.persist(StorageLevel.DISK_ONLY)
        plans = self.rollups(full, entries)
        self._use("results", runs.select("doc_id", F.col("run_id").alias("made_of")))
        last = runs.agg(F.max("last")).first()[0] or 0
        last = last if limit is None else min(last, limit)
        said = lambda: self._run(runs).select("doc_id", "t", "contradicts_prior") if self.settings.posthoc else None
        size = self.settings.window if self.settings.posthoc else max(last, 1)
        for first in range(1, last + 1, size):
            wave = (first, min(first + size - 1, last))
            due = full.select("doc_id", "t").where(F.col("t").between(*wave)).join(runs.select("doc_id", "run_id"), "doc_id")
            if not results.pending(due, self.store.read("results", RESULTS), ["doc_id", "t", "run_id"]).isEmpty():
                self._ask(states_of(full, entries, self.settings, said(), plans, wave), runs)
        self.store.compact("results")
        self.store.compact("answers")
        return self._run(runs), states_of(full, entries, self.settings, said(), plans)

    def _run(self, runs: DataFrame) -> DataFrame:
        return self.store.read("results", RESULTS).join(runs.select("doc_id", "run_id"), ["doc_id", "run_id"], "left_semi")

    def _ask(self, states: DataFrame, runs: DataFrame) -> None:
        """Asks what no stored answer serves, each key once, and adds the results of steps that have none."""
        ids = runs.select("doc_id", "run_id")
        due = results.pending(states.join(ids, "doc_id"), self.store.read("results", RESULTS), ["doc_id", "t", "run_id"])
        asks = asks_of(due, self.settings, self.scorer)
        todo = scoring.to_ask(asks.select("key", "state", "specs"), self.store.read("answers", scoring.CACHE))
        said = todo.select("key", "specs").join(self.scorer(todo), "key", "left")
        rows = said.select("key", F.lit(self.scorer.model).alias("model"), F.col("answers").cast(scoring.ANSWERS).alias("answers"), scoring.unanswered(F.col("specs"), F.col("answers")).alias("missing"))
        with self.store.transaction():
            self._guard("answers", self.store.stage("answers", rows, calls=F.count(F.lit(1)), missing=F.sum("missing")))
            answered = scoring.fan_out(asks, self.store.read("answers", scoring.CACHE, staged=True))
            rows = result_rows(answered, self.scorer.model).select(*_names(RESULTS))
            self._guard("results", self.store.stage("results", rows, missing=F.count_if(F.col("answer").isNull())))


RESULTS = f"doc_id string, run_id string, t int, answer string, confidence4 bigint, distribution array<struct<option: string, p4: bigint>>, contradicts_prior bigint, culprit_revealed bigint, alibi_effect string, input_tokens bigint, model string, answers {scoring.ANSWERS}"


def _names(schema: str) -> list[str]:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).fieldNames()


def latest(spark: SparkSession, out: str, name: str) -> DataFrame:
    """The rows of a stored table that the last run of each document made or used; for results, its last run."""
    store = Store(spark, out)
    rows = store.read(name)
    if rows is None:
        raise ValueError(f"{out} has no table {name}")
    made = store.read("made", MADE).where(F.col("stage") == name).groupBy("doc_id").agg(F.max_by("made_of", "seen").alias("made_of"))
    if name == "results":
        return rows.join(made.withColumnRenamed("made_of", "run_id"), ["doc_id", "run_id"], "left_semi")
    doc, key = ("book_id", "text_sha256") if name == "books" else ("doc_id", "made_of")
    return rows.join(made.select(F.col("doc_id").alias(doc), F.col("made_of").alias(key)), [doc, key], "left_semi")


def listing(books: DataFrame) -> DataFrame:
    return books.select("book_id", "title", "author", "kind", "n_words", "n_paragraphs").orderBy("book_id")


def inspect(chunks: DataFrame, book: str, t: int) -> DataFrame:
    """The sentences of a chunk with their labels."""
    return chunks.where((F.col("doc_id") == book) & (F.col("t") == t)).select(F.posexplode("sentences").alias("i", "sentence")).select(F.concat(F.lit("s"), F.col("i") + 1).alias("label"), "sentence")


def ledger_status(chunks: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries and chunks of each book."""
    have = entries.groupBy("doc_id").agg(F.count(F.lit(1)).alias("entries"))
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks")).join(have, "doc_id", "left").fillna(0, ["entries"])


def answer_tokens(types: Column, options: Column) -> tuple[Column, Column]:
    """Tokens a text model would write to answer: with a probability for every option, and with the chosen option alone."""
    listed = F.aggregate(F.transform(options, lambda o: F.length(o) + 8), F.lit(2), lambda a, n: a + n)
    full = F.when(types == "noul", 4).otherwise(listed)
    top = F.when(types == "noul", 4).otherwise(F.length(F.get(options, 0)) + 2)
    return F.ceil(full / 4.0).cast("long"), F.ceil(top / 4.0).cast("long")
