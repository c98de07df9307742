"""Invariants of the operators on small inputs of our own."""

import io
import itertools
import random
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliate.functions import text as T
from foliate.operators import analytics, chunking, curves, entities, layout, ledger, results, scoring
from foliate.plans import questions as Q
from foliate.scoring import answers
from foliate.sources import readers, sinks

LENGTHS = [30, 10, 80, 5, 5, 5, 40, 12, 200, 3, 7]


def book(spark, sep="\n\n"):
    return spark.createDataFrame([(1, sep.join(" ".join([f"w{i}"] * n) + "." for i, n in enumerate(LENGTHS))), (2, "one"), (3, ""), (4, None)], "doc_id long, text string")


@pytest.mark.parametrize("target", [1, 20, 50, 100, 500, 10000])
def test_chunks_cover_and_are_minimal(spark, target):
    rows = sorted(r.asDict() for r in []) or sorted(chunking.chunks(book(spark), target).where("doc_id = 1").collect(), key=lambda r: r.t)
    assert [r.t for r in rows] == list(range(1, len(rows) + 1))
    assert rows[0].para_from == 0 and rows[-1].para_to == len(LENGTHS)
    assert all(a.para_to == b.para_from and a.word_to == b.word_from for a, b in zip(rows, rows[1:]))
    for r in rows[:-1]:
        assert r.word_count >= target > sum(LENGTHS[r.para_from : r.para_to - 1])
    assert rows[-1].cumulative_fraction == 1.0 and rows[-1].word_to == sum(LENGTHS)


def test_chunk_target_must_be_positive(spark):
    with pytest.raises(ValueError):
        chunking.chunks(book(spark), 0)


def test_chapters(spark):
    chapters = spark.createDataFrame([(1, 0, 0, "One"), (1, 6, 1, "Two"), (1, 6, 2, "Two again"), (2, 5, 0, "Late")], "doc_id long, paragraph_offset int, pos int, title string")
    got = {(r.doc_id, r.t): r.chapter for r in chunking.chapter_of(chunking.chunks(book(spark), 50), chapters).collect()}
    first = {(r.doc_id, r.t): r.para_from for r in chunking.chunks(book(spark), 50).collect()}
    for k, chapter in got.items():
        assert chapter == (None if k[0] != 1 else "Two again" if first[k] >= 6 else "One")


def test_sentences(spark):
    text = 'Mr. Gray met Dr. J. Lowe at St. Mark\'s.  "Yes!" he cried. (Then he left.) Why? No reason... Éva came'
    rows = spark.createDataFrame([(text,)], "x string").select(T.clean(F.col("x")).alias("c"), T.sentences(F.col("x")).alias("s")).first()
    assert [s.text for s in rows.s] == ["Mr. Gray met Dr. J. Lowe at St. Mark's.", '"Yes!" he cried.', "(Then he left.)", "Why?", "No reason...", "Éva came"]
    assert all(rows.c[s.start : s.end] == s.text for s in rows.s)


def test_no_sentences_in_nothing(spark):
    assert spark.createDataFrame([("",), (None,), ("  ",)], "x string").select(F.sum(F.size(T.sentences(F.col("x"))))).first()[0] == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("A  b\n",)], "x string")
    r = df.select(T.clean(F.col("x")).alias("c"), T.word_count(F.col("x")).alias("n"), T.slug(F.lit("  The Éa — End! ")).alias("s"), T.text_hash(F.lit("“Hi”  —there")).alias("a"), T.text_hash(F.lit('"hi" -There')).alias("b")).first()
    assert (r.c, r.n, r.s) == ("A b", 2, "the-a-end") and r.a == r.b
    shown = spark.createDataFrame([(None,), (0.5,), (0.999,), (1.0,), (0.07,)], "p double").select(T.show_probability(F.col("p"))).collect()
    assert [x[0] for x in shown] == ["?", ".50", "1.00", "1.0", ".07"]


def test_upper_median(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 2, 3, 4)] + [("b", 5), ("b", None), ("c", None)], "k string, x int")
    assert dict(df.groupBy("k").agg(analytics.upper_median("x").cast("int")).collect()) == {"a": 3, "b": 5, "c": None}


CAST = [{"canonical": "Anna Bell", "aliases": ["Anna", "Miss Bell"], "is_suspect": True}, {"canonical": "Bo", "is_suspect": True}, {"canonical": "Cy", "aliases": []}]


def test_mentions(spark):
    c = spark.createDataFrame([(1, 1, "Annabel met Bob."), (1, 2, "Anna! and éBo"), (1, 3, "Bo, Miss Bell"), (2, 1, "nobody")], "doc_id long, t int, text string")
    assert {(r.doc_id, r.canonical): r.first_mention for r in entities.first_mentions(c, CAST).collect()} == {(1, "Anna Bell"): 2, (1, "Bo"): 3, (1, "Cy"): None, (2, "Anna Bell"): None, (2, "Bo"): None, (2, "Cy"): None}
    assert entities.candidates(CAST, "suspects_only") == ["Anna Bell", "Bo"]
    with pytest.raises(ValueError):
        entities.candidates(CAST[2:], "suspects_only")
    with pytest.raises(ValueError):
        entities.roster_table(spark, [{"canonical": "A"}, {"canonical": "A"}])


def test_over_merge_counts_longest_match_once(spark):
    docs = spark.createDataFrame([(1, "Anna Bell left.\nAnna saw Miss Bell. Anna Bell met Anna.")], "doc_id long, text string")
    r = entities.over_merges(docs, CAST).first()
    assert (r.n_sentences, r.sample) == (2, "Anna saw Miss Bell.")


def test_distribution(spark):
    rows = spark.range(300).select(scoring.mock_distribution(F.col("id").cast("string"), "q", ["a", "b", "c"]).alias("d")).withColumn("w", scoring.winner(F.col("d"))).collect()
    for r in rows:
        ps = [x.p4 for x in r.d]
        assert sum(ps) == 10000 and min(ps) >= 0 and [x.option for x in r.d] == ["a", "b", "c"] and r.w == r.d[ps.index(max(ps))].option
    assert len({r.w for r in rows}) == 3


def test_score_and_budget(spark):
    d = F.array(*[F.struct(F.lit(o).alias("option"), F.lit(p).cast("long").alias("p4")) for o, p in (("1", 1000), ("2", 4500), ("3", 4500))])
    level, expected = scoring.score_value(d)
    assert tuple(spark.range(1).select(level, expected).first()) == (2, 2.35)
    specs = [Q.Spec("a", "noul", "x" * 40), Q.Spec("b", "noul", "x" * 80)]
    states = spark.createDataFrame([("x" * 4 * n,) for n in (70, 75, 95)], "state string")
    assert [r.verdict for r in scoring.budget_guard(states, specs, 100, 102).orderBy("state_tokens").collect()] == ["ok", "request", "state"]


def test_cache_answers_repeats_once(spark):
    states = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "state string")
    key = scoring.cache_key("m", "p", F.col("state"), [Q.Spec("q", "choice", "?", (("x", None), ("y", None)))])
    other = scoring.cache_key("m", "p", F.col("state"), [Q.Spec("q", "choice", "?", (("y", None), ("x", None)))])
    assert states.where(key == other).count() == 0
    cache = states.where("state = 'b'").select(key.alias("key"))
    asked = scoring.to_ask(states.select(key.alias("key"), "state", F.array().cast("array<string>").alias("specs")), cache)
    assert sorted(r.state for r in asked.collect()) == ["a", "c"]


def test_questions():
    specs = Q.resolve(Q.validate(Q.COMPRESSION, "chunk_local"), Q.Context(CAST, sentences=["One.", "Two."]))
    assert len(specs) == 10 and specs[0].options[0] == ("Anna Bell", "also called: Anna, Miss Bell") and specs[0].options[-1] == ("multiple", None)
    assert specs[-1].options == (("s1", "One."), ("s2", "Two."))
    assert [s.character for s in specs if s.template == "suspicion"] == ["Anna Bell", "Bo", "Cy"]
    assert Q.resolve(Q.validate(Q.INFERENCE, "history_aware"), Q.Context(CAST, candidates=["Bo"]))[0].options == (("Bo", None), ("none_of_these", None))
    assert list(Q.character_ids("s", ["A b", "a-B", "é"]).values()) == ["s__a_b", "s__a_b_2", "s__x"]


@pytest.mark.parametrize("bad", [
    [], [{"id": "a b", "type": "noul", "text": "x"}], [{"id": "a", "type": "noul", "text": "x"}] * 2, [{"id": "a", "type": "maybe", "text": "x"}], [{"id": "a", "type": "score", "text": "x", "levels": ["1"]}],
    [{"id": "a", "type": "choice", "text": "x", "options": "candidates"}], [{"id": "a", "type": "noul", "text": " "}], [{"id": "a", "type": "score", "text": "x", "levels": ["1", "2"], "per_character": True}], [{"id": "a", "type": "choice", "text": "x", "options": ["b", "b"]}],
])
def test_bad_questions(bad):
    with pytest.raises(Q.QuestionError):
        Q.validate([{"scope": "chunk_local", **q} for q in bad], "chunk_local")


def test_too_many_options_are_refused():
    q = {"id": "k", "type": "choice", "text": "x", "options": "sentences", "scope": "chunk_local"}
    with pytest.raises(Q.QuestionError):
        Q.resolve([q], Q.Context(CAST, sentences=["s"] * 256))
    with pytest.raises(Q.QuestionError):
        Q.resolve([{**q, "options": ["a"], "extra_options": ["a"]}], Q.Context(CAST))


def curve(spark):
    steps = spark.createDataFrame([(d, t, f"{d}.{t}") for d in (1, 2) for t in range(1, 6)], "doc_id long, t int, state string")
    return curves.curve_rows(steps, ["a", "b", "none"])


def test_long_and_back(spark):
    wide = curve(spark).select("doc_id", "t", "answer", "distribution")
    long = curves.long_rows(wide)
    assert long.count() == 30
    assert sorted(map(repr, curves.wide_rows(long).collect())) == sorted(map(repr, wide.collect()))


def test_write_long_is_idempotent(spark, tmp_path):
    long = curves.long_rows(curve(spark)).withColumn("run_id", F.concat(F.lit("r"), "doc_id"))
    for part in (long, long.where("doc_id = 1"), long):
        results.write_long(part, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(map(repr, back.select(*long.columns).collect())) == sorted(map(repr, long.collect()))


def test_culprit_has_three_values(spark):
    key = answers.answer_key(spark, {"book_id": "1", "is_culprit": {"a": True}}).withColumn("doc_id", F.col("doc_id").cast("long"))
    got = {(r.doc_id, r.candidate): r.is_culprit for r in answers.with_culprit(curves.long_rows(curve(spark)), key).collect()}
    assert got == {(1, "a"): True, (1, "b"): False, (1, "none"): False, (2, "a"): None, (2, "b"): None, (2, "none"): None}
    with pytest.raises(ValueError):
        answers.answer_key(spark, {"book_id": "1", "is_culprit": {"a": True}, "hint": 1})
    with pytest.raises(ValueError):
        answers.answer_key(spark, {"book_id": "1", "is_culprit": {"a": "yes"}})


def test_introduced(spark):
    firsts = spark.createDataFrame([(1, "a", 3), (1, "b", None)], "doc_id long, canonical string, first_mention int")
    got = {(r.t, r.candidate): r.introduced_by_t for r in results.introduced(curves.long_rows(curve(spark)).where("doc_id = 1"), firsts).collect()}
    assert got[(2, "a")] is False and got[(3, "a")] is True and got[(5, "b")] is False and got[(5, "none")] is None


def test_upsert_pending_uncovered(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string"), spark.createDataFrame([(2, "z"), (3, "w")], "k long, v string")
    assert sorted(map(tuple, results.upsert(a, b, ["k"]).collect())) == [(1, "x"), (2, "z"), (3, "w")]
    path = str(tmp_path / "m")
    for rows in (a, b, b):
        sinks.upsert_table(spark, path, rows, ["k"], "k long, v string")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "x"), (2, "z"), (3, "w")]
    assert [r.k for r in results.pending(a, b, ["k"]).collect()] == [1]
    # the version before stays beside it, and is what is read where a run broke off between the two renames
    import os

    assert sorted(map(tuple, spark.read.parquet(path + ".bak").collect())) == [(1, "x"), (2, "z"), (3, "w")]
    os.rename(path, path + ".lost")
    assert sinks.read_or_empty(spark, path, "k long, v string").count() == 3
    sinks.upsert_table(spark, path, a, ["k"], "k long, v string")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "x"), (2, "y"), (3, "w")]
    entries = spark.range(1, 9).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("t"))
    ranges = spark.createDataFrame([(1, 1, 2), (1, 5, 6)], "doc_id long, from_t int, to_t long")
    assert sorted(r.t for r in results.uncovered(entries, ranges).collect()) == [3, 4, 7, 8]


def sized(spark, n=40, entry=40, text=120):
    rows = [(d, t, f"c{t // 7}", "n" * (entry + 4 * d), "x" * text, None, False, None) for d in (1, 2, 3) for t in range(1, n + 1)]
    return spark.createDataFrame(rows, "doc_id long, t int, chapter string, note string, text string, event string, evidence boolean, quote string")


def test_rollups(spark):
    rows = ledger.step_rollups(sized(spark), 480, 3).collect()
    assert rows and all(r.id > 0 for r in rows)
    for d in (1, 2, 3):
        own = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.id)
        assert own[0].from_t == 1 and all(a.to_t + 1 == b.from_t and a.triggered_at_t <= b.triggered_at_t for a, b in zip(own, own[1:]))
        assert all(r.to_t <= r.triggered_at_t - 3 for r in own)
        prefix = sorted((r for r in ledger.step_rollups(sized(spark).where(f"doc_id = {d} AND t <= 25"), 480, 3).collect()), key=lambda r: r.id)
        assert prefix == [r for r in own if r.triggered_at_t <= 25]
    assert ledger.step_rollups(sized(spark), 10**6, 3).count() == 0
    assert {r.id for r in ledger.step_rollups(sized(spark), 80, 3).collect()} == {-1}


def test_rollup_rows(spark):
    g = [(1, 1, 1, "a", "x", True, "q1"), (1, 1, 2, "a", "y", False, "q2"), (1, 1, 3, "a", "y", True, ""), (1, 1, 4, None, "x", True, "q4"), (1, 1, 5, "a", None, False, None)]
    rows = ledger.rollup_rows(spark.createDataFrame(g, "doc_id long, rollup_id int, t int, chapter string, event string, evidence boolean, quote string")).orderBy("from_t").collect()
    assert [(r.chapter, r.from_t, r.to_t, [tuple(e) for e in r.event_counts or []], [tuple(q) for q in r.quotes]) for r in rows] == [("a", 1, 3, [("y", 2), ("x", 1)], [(1, "q1")]), (None, 4, 4, [("x", 1)], [(4, "q4")]), ("a", 5, 5, [], [])]


def states_by_hand(steps, budget, window):
    """The rule of rollups over whole rendered states: {t: state}, and the first step that stays over budget."""
    rolled, out = [], {}

    def render(visible):
        lines, chapter = [], object()
        for a, b, text in rolled:
            lines.append(text)
        for e in visible[rolled[-1][1] if rolled else 0 :]:
            if e["chapter"] != chapter:
                chapter = e["chapter"]
                lines.append(f"== {chapter or 'untitled'} ==")
            lines.append(e["note"])
        return "\n".join(lines) if visible else "(no earlier passages)"

    for s in range(1, len(steps) + 1):
        upto = max(0, s - window)
        visible = steps[:upto]
        while True:
            head = "CASE NOTES (none yet)" if upto < 1 else f"CASE NOTES (compressed record of passages 1-{upto})"
            parts = [f"{head}:\n{render(visible)}"]
            if recent := steps[upto : s - 1]:
                parts.append("RECENT PASSAGES (full text):\n" + "\n\n".join(f"[#{e['t']}]\n{e['text']}" for e in recent))
            state = "\n\n".join([*parts, f"CURRENT PASSAGE (#{s}):\n{steps[s - 1]['text']}"])
            rest = visible[rolled[-1][1] if rolled else 0 :]
            if -(-len(state) // 4) <= budget or not rest:
                break
            group = list(itertools.takewhile(lambda e: e["chapter"] == rest[0]["chapter"], rest))
            if len(group) == len(rest):
                group = group[: max(1, len(group) // 2)]
            a, b = group[0]["t"], group[-1]["t"]
            counts = Counter(e["event"] for e in group if e["event"] is not None)
            text = [f"== SUMMARY of passages #{a}-#{b} ==", f"[{group[0]['chapter'] or 'untitled'}] #{a}-#{b}: " + ", ".join(f"{k} x{n}" for k, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])))]
            rolled.append((a, b, "\n".join(text + [f"  #{e['t']} \"{e['quote']}\"" for e in group if e["evidence"] and e["quote"]])))
        if -(-len(state) // 4) > budget:
            return out, s
        out[s] = state
    return out, None


@pytest.mark.parametrize(("budget", "window"), [(10**6, 3), (300, 3), (230, 1), (180, 3), (60, 3)])
def test_states_are_rolled_up(spark, budget, window):
    rng = random.Random(budget)
    docs = {d: [{"t": t, "chapter": [None, "", "A", "B", "C"][t // 6 % 5] if d else "one", "note": f"#{t} " + "né" * rng.randrange(5, 40), "text": "x" * rng.randrange(90), "event": rng.choice([None, "move", "act", "act"]),
                 "evidence": rng.random() < 0.3, "quote": rng.choice([None, "", "q" * rng.randrange(1, 20)])} for t in range(1, 41)] for d in (0, 1, 2)}
    rows = [(d, *e.values()) for d, es in docs.items() for e in es]
    steps = spark.createDataFrame(rows, "doc_id long, t int, chapter string, note string, text string, event string, evidence boolean, quote string")
    got = ledger.rolled_states(steps, budget, window).collect()
    assert len(got) == len(rows)
    for d, es in docs.items():
        want, stop = states_by_hand(es, budget, window)
        assert {r.t: r.state for r in got if r.doc_id == d and not r.over_budget} == want
        assert stop is None or min(r.t for r in got if r.doc_id == d and r.over_budget) == stop
    if budget in (300, 230, 180):
        assert any("SUMMARY" in r.state for r in got)


@pytest.mark.parametrize("window", [1, 3])
def test_states(spark, window):
    steps = spark.createDataFrame([(1, t, f"n{t}", f"text {t}") for t in range(1, 7)], "doc_id long, t int, note string, text string")
    s = {r.t: r.state for r in ledger.frames(steps, window).select("t", ledger.compose_state(window).alias("state")).collect()}
    assert s[1] == "CASE NOTES (none yet):\n(no earlier passages)\n\nCURRENT PASSAGE (#1):\ntext 1"
    if window == 1:
        assert s[3] == "CASE NOTES (compressed record of passages 1-2):\nn1\nn2\n\nCURRENT PASSAGE (#3):\ntext 3"
    else:
        assert s[5] == "CASE NOTES (compressed record of passages 1-2):\nn1\nn2\n\nRECENT PASSAGES (full text):\n[#3]\ntext 3\n\n[#4]\ntext 4\n\nCURRENT PASSAGE (#5):\ntext 5"
    assert not any(f"text {k}" in s[t] for t in s for k in range(t + 1, 7))


def test_entries_depend_on_their_chunk_alone(spark):
    c = chunking.with_sentences(spark.createDataFrame([(1, 1, "Anna left. Bo stayed."), (1, 2, "Cy. Rain fell."), (9, 5, "Cy. Rain fell.")], "doc_id long, t int, text string")).withColumn("chapter", F.lit("x"))
    rows = ledger.entries(c, CAST).select("doc_id", "t", F.to_json(F.struct("concerns", "event_type", "suspicion", "key_quote")).alias("e"), "key_quote", "suspicion", ledger.render_entry(["Bo"]).alias("note")).collect()
    by = {(r.doc_id, r.t): r for r in rows}
    assert by[1, 2].e == by[9, 5].e and by[1, 1].key_quote in ("Anna left.", "Bo stayed.")
    assert [x.mentioned for x in by[1, 1].suspicion] == [True, True, False]
    assert by[1, 1].note.startswith("#1 concerns=") and "Cy" not in by[1, 1].note.split("suspicion:")[-1].split("\n")[0]


HTML = """<html><head><title>Old | Site</title><meta name="dc.creator" content="A. Writer"></head><body><div id="pg-header">Title: The Lamp\nAuthor: W. Me</div><p>junk</p><p>*** START OF THE PROJECT GUTENBERG EBOOK X ***</p>
<div class="toc"><p>Contents here</p></div><h2>CHAPTER I</h2><p><span>O</span>ne<span class="pagenum">2</span> might<br>say so.<a class="fnanchor" href="#f">1</a><p>Left open <b>bold<p>* * *</p>
<p><a href="#c1">Chapter one</a></p><h2>CHAPTER II</h2><p>Last part.</p><script>var x = "</p>no";</script><p>*** END OF THE PROJECT GUTENBERG EBOOK X ***</p><p>licence</p></body></html>"""


def test_html():
    p = readers.read_html(HTML)
    assert (p.title, p.author) == ("The Lamp", "W. Me")
    assert p.paragraphs == ["One might say so.", "Left open bold", "Last part."]
    assert p.chapters == [("CHAPTER I", 0), ("CHAPTER II", 2)]


TEXT = "Title: The Lamp\r\nAuthor: W. Me\r\n\r\n*** START OF THE PROJECT GUTENBERG EBOOK ***\r\n\r\nTHE LAMP\r\n\r\nI\r\n\r\nII\r\n\r\nIII\r\n\r\n" + "".join(f"CHAPTER {n}\r\n\r\nA NAME\r\n\r\n" + "It was _very_ late and\r\nnobody came by. " * 9 + "\r\n\r\nThen it rained.\r\n\r\n" for n in ("I", "II", "III")) + "TRANSCRIBER'S NOTES\r\n\r\nSome note.\r\n\r\n*** END OF THE PROJECT GUTENBERG EBOOK ***\r\n\r\nLicence."


def parsed(spark, kind, data):
    files = spark.createDataFrame([(1, bytearray(data), kind)], "n int, content binary, kind string")
    r = readers.parse(files, ["n"]).first()
    assert r.error is None
    r = r.asDict()
    return readers.Parsed(r["title"], r["author"], r["paragraphs"], [tuple(c) for c in r["chapters"]])


def test_text(spark):
    p = parsed(spark, "txt", TEXT.encode("cp1252"))
    assert (p.title, p.author, len(p.paragraphs)) == ("The Lamp", "W. Me", 6)
    assert p.chapters == [("CHAPTER I · A NAME", 0), ("CHAPTER II · A NAME", 2), ("CHAPTER III · A NAME", 4)]
    assert "_" not in p.paragraphs[0] and "late and nobody" in p.paragraphs[0]


def epub():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:x"><rootfiles><rootfile full-path="OPS/b.opf"/></rootfiles></container>')
        items = "".join(f'<item id="p{i}" href="p{i}.xhtml" media-type="application/xhtml+xml"/>' for i in range(3))
        spine = "".join(f'<itemref idref="p{i}"/>' for i in (0, 2, 1, 7))
        z.writestr("OPS/b.opf", f'<package xmlns="urn:o" xmlns:dc="urn:d"><metadata><dc:title>T</dc:title><dc:creator>C</dc:creator></metadata><manifest>{items}<item id="c" href="c.css" media-type="text/css"/></manifest><spine>{spine}</spine></package>')
        for i in range(3):
            z.writestr(f"OPS/p{i}.xhtml", f"<html><body><h1>Part {i}</h1><p>First of {i}.</p><p>Second.</p></body></html>")
    return out.getvalue()


def test_epub():
    p = readers.read_epub(epub())
    assert (p.title, p.author) == ("T", "C") and p.chapters == [("Part 0", 0), ("Part 2", 2), ("Part 1", 4)] and len(p.paragraphs) == 6


def test_blocks_of_text(spark):
    """Notes, subtitles beyond two, a front too long to drop, blocks without letters, nothing at all."""
    long = "word " * 40
    p = parsed(spark, "txt", f"THE TITLE\n\n{long}\n\nTranscriber's note: kept short\n\nlost\n\nPART ONE\n\nA NAME\n\nA SECOND NAME\n\nA THIRD NAME\n\n* * *\n\nFirst text.\n\nCHAPTER II\n\nSecond.\n\nCHAPTER III\n\nThird.".encode())
    assert p.paragraphs == [long.strip(), "First text.", "Second.", "Third."]
    assert p.chapters == [("THE TITLE", 0), ("PART ONE · A NAME · A SECOND NAME", 1), ("A THIRD NAME", 1), ("CHAPTER II", 2), ("CHAPTER III", 3)]
    assert parsed(spark, "txt", b"") == readers.Parsed(None, None, [], []) and parsed(spark, "txt", b"CHAPTER I").chapters == [("CHAPTER I", 0)]


def test_pdf_lines(spark):
    pages = [f"THE RUNNING HEAD\n  It was late when the {w} lamp on page {n} went out for the very last ti-\nme {w}.\n{n}" for n, w in enumerate("red blue green white black brown grey pink".split(), 1)]
    pages.append("THE RUNNING HEAD\nCHAPTER II\nT HE L AMP was out, and the room was as dark as it had been on the\nfirst day.\nNobody came that night or on the night that came after that one.\n9")
    lines = spark.createDataFrame([(1, n, k, x) for n, own in enumerate(pages) for k, x in enumerate(own.split("\n"))], "doc int, page int, line int, raw string")
    blocks = layout.blocks_of_lines(lines, "START", "END")
    p = layout.books_of_blocks(blocks).first()
    assert len(p.paragraphs) == 10 and p.paragraphs[0].endswith("last time red.") and p.paragraphs[8:] == ["THE LAMP was out, and the room was as dark as it had been on the first day.", "Nobody came that night or on the night that came after that one."]
    assert [tuple(c) for c in p.chapters] == [("CHAPTER II", 8)]
    marked = lines.withColumn("raw", F.when((F.col("page") == 7) & (F.col("line") == 0), "x START x").when((F.col("page") == 8) & (F.col("line") == 3), "END").otherwise(F.col("raw")))
    assert [len(r.paragraphs) for r in layout.books_of_blocks(layout.blocks_of_lines(marked, "START", "END")).collect()] == [2]
    assert layout.books_of_blocks(layout.blocks_of_lines(lines.where("false"), "START", "END")).count() == 0
    with pytest.raises(ValueError):
        readers.with_text(["x"])


def test_files(spark, tmp_path):
    book = epub()  # holds the time it was made
    for name, data in (("a.html", HTML.encode()), ("b.txt", TEXT.encode()), ("c.epub", book), ("copy.epub", book), ("bad.epub", b"PK.."), ("skip.doc", b"x")):
        (tmp_path / name).write_bytes(data)
    files = readers.read_files(spark, str(tmp_path))
    rows = readers.parse(files, ["name", "kind"]).collect()
    assert len(rows) == 4 and {r.kind for r in rows} == {"html", "txt", "epub"} and sum(r.error is not None for r in rows) == 1
    assert all(len(r.paragraphs) > 0 for r in rows if r.error is None)


@pytest.mark.parametrize(("line", "heading"), [("CHAPTER IV", True), ("Book Two", True), ("Part the First", True), ("IV.", True), ("IV. THE BODY", True), ("THE LAST NIGHT", True), ("Part of me was sad.", False), ("I went home.", False), ("WHO IS IT?", False), ("", False)])
def test_headings(spark, line, heading):
    assert bool(spark.range(1).select(T.is_heading(F.lit(line))).first()[0]) is heading


def test_book_ids(spark):
    straight, curly = ['"It is late," she said - twice.'], ["“It is  late,” she said – twice."]
    assert readers.book_id("file:x", "A Title", straight) == readers.book_id("upload:y", "A Title", curly)
    assert readers.book_id("https://www.gutenberg.org/ebooks/863", "t", []) == "pg863" and readers.book_id("http://gutenberg.net.au/ebooks13/1302201h.html", "t", []) == "pgau1302201"
    rows = spark.createDataFrame([("u", "A Title", straight)], "url string, title string, paragraphs array<string>")
    assert readers.book_ids(rows).first().book_id == readers.book_id("u", "A Title", straight)


def test_as_of_and_islands(spark):
    rows = spark.createDataFrame([(1, t, f"r{t}") for t in range(5)] + [(2, 0, "x")], "k long, t long, v string")
    facts = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 3, "c")], "k long, at long, f string")
    assert {(r.k, r.t): r.f for r in analytics.as_of(rows, facts, "k", "t", "at", "f").collect()} == {(1, 0): None, (1, 1): "b", (1, 2): "b", (1, 3): "c", (1, 4): "c", (2, 0): None}
    s = spark.createDataFrame([(1, i, v) for i, v in enumerate(["a", "a", None, None, "a"])], "k long, t long, v string")
    assert [r.island for r in analytics.islands(s, "k", "t", "v").orderBy("t").collect()] == [1, 1, 2, 2, 3]


def test_curve_readings(spark):
    long = spark.createDataFrame([(1, 1, 0, "a", 2000), (1, 1, 1, "b", 8000), (1, 2, 0, "a", 5000), (1, 2, 1, "b", 5000), (1, 3, 0, "a", 8049), (1, 3, 1, "b", 1951)], "doc_id long, t int, pos int, candidate string, p4 long")
    assert {r.t: r.leader for r in curves.leader(long).collect()} == {1: "b", 2: "a", 3: "a"}
    assert {(r.t, r.candidate): r.points for r in curves.delta(long).collect()} == {(1, "a"): 0, (1, "b"): 0, (2, "a"): 30, (2, "b"): -30, (3, "a"): 30, (3, "b"): -30}
    assert {r.candidate: (r.peak4, r.peak_t, r.slot) for r in curves.peak(long).join(curves.series_slots(long, 2).select("candidate", "slot"), "candidate").collect()} == {"a": (8049, 3, 2), "b": (8000, 1, 1)}


def test_highlight(spark):
    assert spark.range(1).select(analytics.highlight(F.lit("Anna Bell saw Anna, Annab"), ["Anna", "Anna Bell"])).first()[0] == "**Anna Bell** saw **Anna**, Annab"


def test_duplicate_aliases_fold_case(spark):
    roster = entities.roster_table(spark, [{"canonical": "Ann", "aliases": ["Nan"]}, {"canonical": "Bob", "aliases": ["nan"]}, {"canonical": "Cy"}])
    assert [tuple(r) for r in entities.duplicate_aliases(roster).collect()] == [("nan", ["Ann", "Bob"])]


def test_compatibility_names_each_field_that_differs(spark):
    schema = "doc_id long, version string, roster string"
    have = spark.createDataFrame([(1, "2", "r"), (2, "1", "r"), (3, "2", None), (4, None, None)], schema)
    want = spark.createDataFrame([(1, "2", "r"), (2, "2", "r"), (3, "2", "r"), (4, None, "r")], schema)
    found = results.compatibility(have, want, ["version", "roster"]).collect()
    assert {r["doc_id"]: r["problems"] for r in found} == {1: [], 2: ["version"], 3: ["roster"], 4: ["roster"]}


def test_over_merges_spare_most_sentences_the_patterns(spark):
    docs = spark.createDataFrame([(1, "I saw Ann Lee and Ann. I saw Ann Lee.\nBo and C# met. Bob was out."), (2, "Bo, and Ann.")], "doc_id long, text string")
    cast = [{"canonical": "Ann", "aliases": ["Ann Lee"]}, {"canonical": "Bo", "aliases": ["C#"]}]
    out = entities.over_merges(docs, cast)
    assert sorted(tuple(r) for r in out.collect()) == [(1, "Ann", 1, "I saw Ann Lee and Ann."), (1, "Bo", 1, "Bo and C# met.")]
    assert "contains" in entities.over_merges(docs, cast[:1])._jdf.queryExecution().optimizedPlan().toString().lower()


def test_shares_of_many_options_take_linear_time(spark):
    import time

    from foliate.operators import scoring

    began = time.perf_counter()
    xs = scoring.shares(F.transform(F.sequence(F.lit(1), F.lit(20000) + F.col("id").cast("int")), lambda i: i.cast("long")))
    got = spark.range(1).select(xs.alias("x")).first().x
    assert len(got) == 20000 and sum(got) == 10_000 and time.perf_counter() - began < 10


def test_warnings_from_counts_that_are_known(spark):
    docs = spark.createDataFrame([(1, "We met Ann. We met Ann. We met Cyr.\nSo Ann left. We saw Cyr, and Cyr.")], "doc_id long, text string")
    roster = spark.createDataFrame([(1, "Ann", ["Ann"])], "doc_id long, canonical string, names array<string>")
    known = entities.name_counts(docs, "doc_id")
    want = [tuple(r) for r in entities.roster_warnings(docs, roster, least=3).collect()]
    assert [tuple(r) for r in entities.roster_warnings(docs, roster, least=3, counts=known).collect()] == want == [(1, "missed_name", "Cyr", 3, None)]


def test_line_ends_within_words_still_end_sentences(spark):
    text = spark.createDataFrame([("It ended.\u0085 Then more.  And (so!) Bo. \"Yes.\" No",)], "t string")
    ends = text.select(T.sentence_texts(F.col("t"))).first()[0]
    assert ends == ["It ended.\u0085", "Then more. ", "And (so!)", "Bo.", "\"Yes.\"", "No"]
