"""The flow from files to results, and stored tables."""

import gzip
import json
import re

import pytest
from pyspark.sql import functions as F

from foliate import cli
from foliate.operators import ledger
from foliate.plans import book
from foliate.sources import tables

STORY = "\n\n".join(f"CHAPTER {n}\n\n" + "\n\n".join(f"That night {w} saw Anna near the gate. Then {w} told Boris that Anna was gone, and Boris left number {k}." for k, w in enumerate(["Clara", "Boris", "Clara", "Denis", "Clara"])) for n in ("I", "II", "III"))
SMALL = book.Settings(target=40)


@pytest.fixture(scope="module")
def shelf(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shelf")
    (folder / "the_gate.txt").write_text(STORY)
    (folder / "lamp.html").write_text("<html><head><title>Lamp</title></head><body><h2>One</h2><p>It was dark. Nobody came.</p></body></html>")
    (folder / "broken.epub").write_bytes(b"PK")
    return folder


def test_run_and_rerun(spark, shelf, tmp_path):
    out = str(tmp_path / "out")
    first = book.run_all(spark, str(shelf), out, SMALL, limit=3)
    assert {r.title for r in first["books"].collect()} == {"The Gate", "Lamp"}
    n = first["chunks"].count()
    assert first["ledger"].count() == n and first["results"].where("t > 3").count() == 0
    names = {r.canonical for r in first["roster"].collect()}
    assert {"Anna", "Boris"} <= names and "That" not in names
    assert {r.chapter for r in first["chunks"].collect()} >= {"CHAPTER I", "CHAPTER II", "One"}
    before = sorted(map(repr, first["results"].collect()))
    again = book.run_all(spark, str(shelf), out, SMALL)
    assert again["results"].count() == n and again["chunks"].count() == n and again["ledger"].count() == n
    assert set(before) <= set(map(repr, again["results"].collect()))
    third = book.run_all(spark, str(shelf), out, SMALL)
    assert third["results"].count() == n
    for command in (["list", out], ["ledger", out], ["roster", out], ["curve", out], ["inspect", out, first["books"].first().book_id, "1"]):
        assert cli.main(command, spark) == 0
    assert cli.main(["export", out, str(tmp_path / "long")], spark) == 0
    long = spark.read.parquet(str(tmp_path / "long"))
    assert long.count() == third["results"].agg(F.sum(F.size("distribution"))).first()[0] and [c for c in long.columns if c.startswith("q_")][0] == "q_alibi_effect_value"
    assert cli.main(["vacuum", out], spark) == 0 and book.latest(spark, out, "results").count() == n


def test_budget_of_a_run(spark, shelf, tmp_path):
    """Over budget, notes are rolled up; steps that stay over it are refused and get no result."""
    full = book.with_roster(c := book.chunk_books(book.ingest(spark, str(shelf)), 40), book.rosters(c))
    entries = ledger.entries_by_cast(full)
    plain, tight = (book.states_of(full, entries, book.Settings(target=40, window=1, budget=b)) for b in (26_000, 250))
    assert not any("SUMMARY" in r.state for r in plain.collect()) and {r.verdict for r in plain.collect()} == {"ok"}
    rows = tight.collect()
    assert any("== SUMMARY of passages #1-" in r.state for r in rows) and all(r.state_tokens <= 250 for r in rows if r.verdict == "ok")
    out = book.run_all(spark, str(shelf), str(tmp_path / "out"), book.Settings(target=40, window=1, budget=60))
    no = out["refused"].collect()
    assert no and {r.verdict for r in no} == {"budget"} and out["results"].count() == full.count() - len(no)


def test_documented_commands_exist(spark, capsys):
    """Each command that the module names has a parser."""
    for name in re.search(r"foliate\.cli (\S+) FOLDER", cli.__doc__)[1].split("|"):
        with pytest.raises(SystemExit) as stopped:
            cli.main([name, "--help"], spark)
        assert stopped.value.code == 0, name


def test_given_rosters_rule(spark, shelf, tmp_path):
    books = book.ingest(spark, str(shelf))
    one = books.where("title = 'The Gate'").first().book_id
    chunks = book.chunk_books(books, 40)
    cast = [{"canonical": "Anna", "aliases": ["Clara"], "is_suspect": True}, {"canonical": "Boris"}]
    r = book.rosters(chunks, {one: cast}).where(F.col("doc_id") == one).orderBy("ord").collect()
    assert [(x.canonical, x.names, x.is_suspect) for x in r] == [("Anna", ["Anna", "Clara"], True), ("Boris", ["Boris"], False)]


def test_run_ids():
    a = book.run_id("b", "m", "h", SMALL)
    assert len(a) == 12 and a == book.run_id("b", "m", "h", SMALL) != book.run_id("b", "m", "h", book.Settings(target=40, window=1))


def test_results_files(spark, tmp_path):
    rows = [{"t": t, "answer": "a", "probabilities": {"a": 0.5, "b": 0.5}, "book_id": "k", "run_id": "r1", "model": "x (MOCK)", "extra": 1} for t in (1, 2)]
    (tmp_path / "r1.jsonl").write_text("\n".join(map(json.dumps, rows)))
    with gzip.open(tmp_path / "r2.jsonl.gz", "wt") as f:
        f.write("\n".join([json.dumps({**rows[0], "run_id": "r2", "model": "real"}), '{"t": 3, "ans', json.dumps({"answer": "no step"})]))
    assert tables.read_results(spark, str(tmp_path / "r1.jsonl")).count() == 2
    assert [r.t for r in tables.read_results(spark, str(tmp_path / "r2.jsonl.gz"), strict=False).collect()] == [1]
    with pytest.raises(Exception):
        tables.read_results(spark, str(tmp_path / "r2.jsonl.gz")).collect()
    books = spark.createDataFrame([("k", "T", 9)], "book_id string, title string, n_chunks int")
    assert [(r.run_id, r.mock, r.title, r.steps) for r in tables.list_runs(spark, str(tmp_path), books).collect()] == [("r2", False, "T", 1), ("r1", True, "T", 2)]


@pytest.mark.parametrize("name", ["../x.jsonl", "a/b.jsonl", "x.json", "", "..jsonl", "x.jsonl.exe"])
def test_unsafe_names(name):
    with pytest.raises(ValueError):
        tables.safe_name(name)
    assert tables.safe_name("run-1.jsonl.gz") == "run-1.jsonl.gz"


def test_rosters_of_text(spark):
    cast = tables.roster_from_extraction('Sure: {"characters": [{"canonical": " Ann ", "aliases": ["Nan", "Nan", "Ann", ""]}, {"canonical": ""}, {"canonical": "Bo", "is_suspect": true}]} done')
    assert [(c["canonical"], c["aliases"], c["is_suspect"]) for c in cast] == [("Ann", ["Nan"], False), ("Bo", [], True)]
    text = tables.roster_to_yaml("b", cast, "hand")
    assert tables.roster_from_yaml(text) == cast
    for bad in ("none", "{}"):
        with pytest.raises(ValueError):
            tables.roster_from_extraction(bad)
    with pytest.raises(ValueError):
        tables.roster_from_yaml("characters: [{canonical: A}, {canonical: A}]")
    assert tables.roster_policy(text, lambda: [], True, False) == ([], True) and tables.roster_policy(text, lambda: [], False, False) == (cast, False)
    got = spark.createDataFrame([('x {"a": 1} y',), ("none",)], "s string").select(tables.extraction_object(F.col("s")).cast("string")).collect()
    assert [r[0] for r in got] == ['{"a":1}', None]


def test_pages_are_fetched_once(spark):
    urls = spark.createDataFrame([("u1",), ("u1",), ("u2",)], "url string")
    cache = urls.where("url = 'u2'").select(tables.page_key(F.col("url")).alias("key"))
    assert [r.url for r in tables.missing_pages(urls, cache).collect()] == ["u1"]


def test_paragraph_files(spark, tmp_path):
    tables.write_paragraphs(spark.createDataFrame([(1, ["a", "b"])], "doc_id long, paragraphs array<string>"), str(tmp_path / "p"))
    back = spark.read.json(str(tmp_path / "p")).orderBy("index")
    assert [(r["index"], r.text) for r in back.collect()] == [(0, "a"), (1, "b")]
    assert tables.title_of_file("x/the_old-house.txt") == "The Old House"
