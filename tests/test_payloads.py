"""Typed long answers, the viewer's order, estimates, sentence offsets and configuration files."""

import json

import pytest
from pyspark.sql import functions as F

from foliate.functions import text as T
from foliate.operators import chunking, results

BATTERY = [{"id": "z", "type": "noul", "text": "?"}, {"id": "culprit", "type": "choice", "text": "?"}, {"id": "b", "type": "score", "text": "?", "levels": ["lo", "mid", "hi"]}, {"id": "a", "type": "choice", "text": "?"}]
ROWS = "doc_id long, t int, distribution array<struct<option: string, p4: bigint>>, answers map<string, array<struct<option: string, p4: bigint>>>"


def test_long_answers(spark):
    culprit = [("Ann", 7000), ("Bo", 3000)]
    answers = {"z": [("yes", 4999), ("no", 5001)], "culprit": culprit, "b": [("lo", 1000), ("mid", 4500), ("hi", 4500)], "a": [("x", 10000)]}
    df = spark.createDataFrame([(1, 1, culprit, answers), (1, 2, culprit, {"culprit": culprit})], ROWS)
    out = results.long_answers(df, BATTERY, ["doc_id"])
    assert [c for c in out.columns if c.startswith("q_")] == ["q_a_value", "q_a_option", "q_a_prob", "q_b_value", "q_b_level", "q_b_prob", "q_z_value", "q_z_bool", "q_z_prob"]
    rows = out.orderBy("t", "option_position").collect()
    assert [(r.t, r.candidate, r.p4, r.option_position) for r in rows] == [(1, "Ann", 7000, 0), (1, "Bo", 3000, 1), (2, "Ann", 7000, 0), (2, "Bo", 3000, 1)]
    first, third = rows[0], rows[2]
    assert (first.q_a_option, first.q_b_level, first.q_z_bool, first.q_b_prob, first.q_z_prob) == ("x", 2, False, 0.45, 0.4999)
    assert [first[c].toPython() for c in ("q_a_value", "q_b_value", "q_z_value")] == ["x", 2, False]
    assert list(json.loads(first.inference_answers)) == ["a", "b", "culprit", "z"]
    assert all(third[c] is None for c in out.columns if c.startswith("q_"))
    # and back: what was answered is in the JSON whole
    kind = "map<string, array<struct<option: string, p4: bigint>>>"
    back = out.where("t = 1 AND option_position = 0").select(F.from_json("inference_answers", kind).alias("m")).first().m
    assert {q: [tuple(o) for o in d] for q, d in back.items()} == answers


def test_viewer_order(spark):
    options = spark.createDataFrame([(1, c) for c in ("none_of_these", "Zoe", "Ann", "Nobody", "Bo", "Cy")] + [(2, "Ann"), (2, "none_of_these")], "doc_id long, candidate string")
    known = [(1, "Zoe", ["Zoe"], 2), (1, "Ann", ["Ann", "Nan"], 5), (1, "Bo", ["Bo"], None), (1, "Cy", ["Cy"], 2)]
    e = spark.createDataFrame(known, "doc_id long, canonical string, names array<string>, first_mention int")
    got = results.viewer_candidates(options, e).orderBy("doc_id", "place").collect()
    assert [(r.name, r.names, r.first_chunk) for r in got if r.doc_id == 1] == [("Cy", ["Cy"], 2), ("Zoe", ["Zoe"], 2), ("Ann", ["Ann", "Nan"], 5), ("Bo", ["Bo"], None), ("Nobody", ["Nobody"], None), ("none_of_these", [], None)]
    assert [(r.name, r.names, r.is_none) for r in got if r.doc_id == 2] == [("Ann", ["Ann"], False), ("none_of_these", [], True)]


def test_catalogue(spark):
    books = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "doc_id long, title string")
    ledgers = spark.createDataFrame([(1, True), (1, True), (1, False), (None, True)], "doc_id long, mock boolean")
    got = {(r.title, r.mock_ledger, r.real_ledger) for r in results.catalogue(books, ledgers).collect()}
    assert got == {("a", True, True), ("b", False, False), ("c", False, False)}


def test_prefix_estimate(spark):
    texts = {1: ["x" * 40, "", "y" * 10, "z" * 81], 2: ["q"], 3: [], 4: ["w" * 7] * 300}
    df = spark.createDataFrame([(k, "\n".join(v) if v else None) for k, v in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in chunking.prefix_estimate(df, 60, 5).collect()}
    for k, lines in texts.items():
        own = [-(-len(x) // 4) for x in lines or [""]]
        prefixes = [sum(own[: i + 1]) + 5 for i in range(len(own))]
        n, total = len(own), sum(own)
        want = (n, round(total / n, 1), sum(prefixes), int(total / n * n * (n + 1) / 2 + 5 * n), prefixes[-1], next((i + 1 for i, p in enumerate(prefixes) if p > 60), None))
        r = got[k]
        assert (r.paragraphs, r.average_tokens, r.input_tokens, r.quadratic_tokens, r.longest, r.first_overflow) == want
    with pytest.raises(chunking.PrefixOverflow, match="4: too long from step 28 on"):
        chunking.refuse_overflow(chunking.prefix_estimate(df, 60, 5))
    chunking.refuse_overflow(chunking.prefix_estimate(df, 10**6, 5))


def test_sentence_offsets(spark):
    texts = ["One two. Three  four! He said.", "", "  Mr. Smith  went. then no. Yes", None, "A. B. Cee. Dee"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.clean(F.col("t")).alias("c"), T.sentences(F.col("t")).alias("s"), T.sentence_texts(F.col("t")).alias("x"))
    for r in df.collect():
        assert [s.text for s in r.s] == r.x and all(r.c[s.start : s.end] == s.text for s in r.s)
        assert " ".join(r.x) == (r.c or "")


def test_questions_and_prices_are_scanned(spark, tmp_path):
    from foliate.sources import config

    (tmp_path / "good.yaml").write_text(
        "questions:\n"
        "  - {id: culprit, type: choice, scope: history_aware, text: 'Who?', options: candidates, extra_options: [none_of_these]}\n"
        "  - {id: mood, type: score, scope: history_aware, text: 'How dark?', levels: [light, dark]}\n"
        "  - {id: Bad__id, type: noul, scope: history_aware, text: '?'}\n"
    )
    (tmp_path / "broken.yaml").write_text("questions: [")
    (tmp_path / "plain.yaml").write_text("- {id: solo, type: noul, scope: chunk_local, text: 'Alone?'}\n")
    df = config.read_questions(spark, str(tmp_path))
    rows = {(r.file, r.place): r for r in df.collect()}
    assert {k: r.error is None for k, r in rows.items()} == {("good.yaml", 0): True, ("good.yaml", 1): True, ("good.yaml", 2): False, ("broken.yaml", None): False, ("plain.yaml", 0): True}
    assert "small letters" in rows["good.yaml", 2].error and rows["good.yaml", 1].levels == ["light", "dark"] and rows["good.yaml", 0].option_source == "candidates"
    assert config.battery(df.where("file = 'plain.yaml'"), "chunk_local") == [{"id": "solo", "type": "noul", "scope": "chunk_local", "text": "Alone?"}]
    with pytest.raises(config.ConfigError, match="good.yaml"):
        config.battery(df.where("file = 'good.yaml'"), "history_aware")
    prices = tmp_path / "prices"
    prices.mkdir()
    (prices / "p.yaml").write_text("models:\n  - {id: m1, name: One, input: 0.5, output: 1.5}\n  - {id: m2, name: Two, input: free}\n  - {id: m1, name: Again, input: 1, output: 2}\n")
    got = {(r.place, r.model): (r.input, r.output, r.error) for r in config.read_prices(spark, str(prices)).collect()}
    assert got[0, "m1"] == (0.5, 1.5, None) and "number" in got[1, "m2"][2] and "twice" in got[2, "m1"][2]
    good = config.read_prices(spark, str(prices)).where("error IS NULL")
    usage = spark.createDataFrame([("a", 1_000_000, 200_000)], "job string, input_tokens long, output_tokens long")
    assert [(r.model, r.cost, r.ratio) for r in config.cost_of(usage, good, "m1").collect()] == [("m1", 0.8, 1.0)]
