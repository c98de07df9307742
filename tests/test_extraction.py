"""Extractors behind one interface, their cache, bad answers, and the checks of rosters."""

import json
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliate import cli
from foliate.functions.text import NOT_NAMES
from foliate.operators import entities, extraction
from foliate.operators.extraction import Called, FrequentNames
from foliate.plans import book
from foliate.sources.store import Store

STORY = "\n\n".join(f"That night {w} saw Anna near the gate. Then {w} told Boris that Anna was gone." for w in ("Clara", "Boris", "Clara", "Denis", "Clara"))
TEXTS = [("a", "Gate", STORY), ("b", "Gate", STORY), ("c", None, "It was dark."), ("d", "", None), ("e", "x", ""), ("f", "Long", "word " * 4000)]


def by_hand(system, user):
    """The same rule as the default's in plain Python, with prose around the answer."""
    text = user[user.index("<novel>\n") + 8 : -len("\n</novel>")]
    words = [w for p in text.split("\n\n") for s in re.split(r"(?<=[.!?]) ", p) for w in re.findall(r"\w+", s)[1:] if re.fullmatch("[A-Z][a-z]{2,}", w) and w not in NOT_NAMES]
    named = [n for n, k in sorted(Counter(words).items(), key=lambda x: (-x[1], words.index(x[0]))) if k >= 3]
    return f"Here: {json.dumps({'characters': [{'canonical': n} for n in named]})} done.", "end_turn"


def texts(spark, rows=TEXTS):
    return spark.createDataFrame(rows, "doc_id string, title string, text string")


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "ord", "canonical", "names", "is_suspect", "error").collect()), key=repr)


@pytest.mark.parametrize("extractor", [FrequentNames(context_tokens=3000), Called("by-hand", by_hand, context_tokens=19_000)], ids=["frequent names", "called"])
def test_extractors(spark, tmp_path, extractor):
    rows = found(extraction.extract(texts(spark), extractor, Store(spark, str(tmp_path))))
    want = [(d, k, n, [n], False, None) for d in "ab" for k, n in enumerate(["Anna", "Boris", "Clara"], 1)]
    assert [r for r in rows if r[2]] == sorted(want, key=repr)
    assert [(r[0], r[5]) for r in rows if not r[2]] == [("c", None), ("d", None), ("e", None), ("f", "5008 tokens, of 3000 that fit")]
    assert found(extraction.extract(texts(spark), extractor, Store(spark, str(tmp_path)))) == rows, "from the cache"
    assert extraction.extract(texts(spark).where("false"), extractor, Store(spark, str(tmp_path / "x"))).count() == 0


ANSWERS = {
    "ok": ('{"characters": [{"canonical": "A.", "aliases": ["Al", "A.", null, "", "Al"], "is_suspect": true}, {"canonical": "A.", "aliases": ["Z"]}, {"canonical": " "}, {"aliases": ["q"]}, {"canonical": "B"}], "more": 1}', "stop"),
    "cut": ('{"characters": [{"canonical": "A"}]}', "max_tokens"), "refused": ("", "refusal"), "empty": (" \n", "stop"), "none": (None, "stop"),
    "prose": ("I can't tell.", "stop"), "turned": ("} {", "stop"), "broken": ('{"characters": [{"canon}', "stop"), "other": ('{"people": []}', "stop"),
}
ERRORS = {"cut": "stopped early: max_tokens", "refused": "stopped early: refusal", "empty": "empty answer", "none": "empty answer", "prose": "no JSON object", "turned": "no JSON object", "broken": "not valid JSON", "other": "not valid JSON"}


def test_bad_answers_become_rows_and_are_asked_again(spark, tmp_path):
    log = tmp_path / "asked"

    def ask(system, user):
        with log.open("a") as f:
            f.write(user.split("\n")[0][7:] + "\n")
        return ANSWERS[user.split("\n")[0][7:]]

    store = Store(spark, str(tmp_path / "store"))
    rows = [(k, k, "text") for k in ANSWERS] + [("ok again", "ok", "text")]
    out = found(extraction.extract(texts(spark, rows), Called("m", ask), store))
    cast = [(1, "A.", ["A.", "Al"], True, None), (2, "B", ["B"], False, None)]
    assert [r for r in out if r[2]] == sorted([(d, *c) for d in ("ok", "ok again") for c in cast], key=repr)
    assert {r[0]: r[5] for r in out if not r[2]} == ERRORS
    assert sorted(log.read_text().split()) == sorted(ANSWERS), "equal prompts are asked once"
    again = extraction.extract(texts(spark, rows), Called("m", ask), store)
    assert found(again) == out
    assert sorted(log.read_text().split()) == sorted([*ANSWERS, *ERRORS]), "good answers come from the store"
    with pytest.raises(extraction.ExtractionError, match="cut: stopped early"):
        extraction.usable(again.where("doc_id = 'cut'"))
    found(extraction.extract(texts(spark, rows[:1]), Called("m", ask, system="other"), store))
    assert log.read_text().split()[-1] == "ok", "another system text is another prompt"


def test_patterns(spark):
    names = ["A. (B)", "Al", "Al Or"]
    row = spark.createDataFrame([(names,)], "n array<string>").select(entities.pattern_of(F.col("n")).alias("p"))
    assert row.first().p == entities.alias_pattern(names)


def test_runs_with_an_extractor(spark, tmp_path):
    (tmp_path / "shelf").mkdir()
    (tmp_path / "shelf" / "gate.txt").write_text(STORY)
    books, out = book.ingest(spark, str(tmp_path / "shelf")), str(tmp_path / "out")
    answer = json.dumps({"characters": [{"canonical": "Anna", "aliases": ["Clara"], "is_suspect": True}, {"canonical": "Boris", "aliases": ["clara"], "is_suspect": True}]})
    run = lambda extractor, **more: book.run_books(books, out, book.Settings(target=40, window=2, candidate_set="suspects_only"), extractor=extractor, **more)
    with pytest.raises(extraction.ExtractionError, match="empty answer"):
        run(Called("m", lambda s, u: ("", "stop")))
    tables = run(Called("m", lambda s, u: (answer, "stop")))
    assert [(r.ord, r.canonical, r["names"]) for r in tables["roster"].orderBy("ord").collect()] == [(1, "Anna", ["Anna", "Clara"]), (2, "Boris", ["Boris", "clara"])]
    assert tables["results"].count() == tables["chunks"].count()
    version = Store(spark, out).version()
    run(Called("m", lambda s, u: 1 / 0))
    assert Store(spark, out).version() == version, "nothing is asked again"
    assert cli.main(["validate", out], spark) == 0


def test_roster_warnings(spark):
    docs = spark.createDataFrame([(1, "Then Al Or met Al. So Al Or left.\nAnd Zed, Zed. Oh Zed."), (2, None), (3, "")], "doc_id long, text string")
    roster = spark.createDataFrame([(1, "Al", ["Al", "Al Or"]), (1, "Bo", ["Bo", "al"]), (2, "Al", ["Al", None, "Or"])], "doc_id long, canonical string, names array<string>")
    got = sorted((tuple(r) for r in entities.roster_warnings(docs, roster, least=3).collect()), key=repr)
    assert got == [(1, "duplicate_alias", "al", 2, "Al, Bo"), (1, "missed_name", "Zed", 3, None), (1, "over_merge", "Al", 1, "Then Al Or met Al.")]
    assert entities.roster_warnings(docs.where("false"), roster.where("false")).count() == 0


def test_manual_choices():
    assert extraction.manual_choices(" Anna, ,Boris,Anna ,") == ["Anna", "Boris"]
    assert extraction.manual_choices(None) == []
