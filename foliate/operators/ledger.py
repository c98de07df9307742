"""The ledger: one compressed entry a chunk, its text form, rollups of the oldest entries, and the state at each step."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, show_probability, token_count
from .scoring import digest, mock_distribution, noul_value, winner

NO_NOTES = "(no earlier passages)"


def _apart(df: DataFrame, *cols: str | Column) -> DataFrame:
    """A select whose results are made once a row: a generator keeps later expressions from taking them in and making them again."""
    return df.select(F.inline(F.array(F.struct(*cols))))


def entries(chunked: DataFrame, roster: list[dict], keep: tuple[str, ...] = (), mentions: bool = True) -> DataFrame:
    """An entry a chunk, from that chunk alone: event, evidence, suspicion of each entity, key sentence. Rows are independent,
    so building a ledger is a parallel map; an anti-join with existing entries makes it resumable. chunked has sentences.
    mentions: whether suspicion says if an entity is named, which notes do not show."""
    from .entities import names_pattern

    cast = [F.struct(F.lit(i).alias("ord"), F.lit(c["canonical"]).alias("canonical"), F.lit(names_pattern(c)).alias("pattern")) for i, c in enumerate(roster)]
    return entries_by_cast(chunked.withColumn("cast", F.array(*cast)), keep, mentions)


def entries_by_cast(chunked: DataFrame, keep: tuple[str, ...] = (), mentions: bool = True) -> DataFrame:
    """Entries with the entities of each book in column cast (ord, canonical, pattern ...) instead of one list for all. keep: columns of
    chunked that go along."""
    from ..plans.questions import COMPRESSION

    by = {q["id"]: q for q in COMPRESSION}
    names = F.transform("cast", lambda c: c["canonical"])
    more = lambda q: F.array(*[F.lit(x) for x in by[q]["extra_options"]])
    ask = lambda qid, options: mock_distribution(F.col("_digest"), qid, options, digested=True)
    best = lambda d: let(d, lambda x: F.struct(winner(x).alias("value"), F.array_max(F.transform(x, lambda y: y["p4"])).alias("p4")))
    level = lambda c: F.array_max(F.transform(mock_distribution(F.concat_ws("|", F.col("_digest"), c["canonical"]), "suspicion", by["suspicion"]["levels"]), lambda y, i: F.struct(y["p4"].alias("p4"), (-i).alias("i"))))
    named = lambda c: [F.rlike(F.col("text"), c["pattern"]).alias("mentioned")] if mentions else []
    chunked = _apart(chunked, *[F.col(c) for c in chunked.columns], digest(F.col("text")).alias("_digest"))
    out = _apart(chunked,
        "doc_id", "t", *keep, "chapter", "sentences",
        best(ask("concerns", F.concat(names, more("concerns")))).alias("concerns"), best(ask("secondary", F.concat(names, more("secondary")))).alias("secondary"), best(ask("event_type", by["event_type"]["options"])).alias("event_type"),
        *[F.get(ask(q, ["yes", "no"]), 0)["p4"].alias(q) for q in ("new_evidence", "time_reference", "location_stated")],
        F.transform("cast", lambda c: F.struct(c["canonical"].alias("name"), c["ord"].alias("ord"), (1 - level(c)["i"]).alias("value"), *named(c))).alias("suspicion"),
        F.when(F.size("sentences") > 0, winner(ask("key_sentence", F.transform(F.sequence(F.lit(1), F.greatest(F.size("sentences"), F.lit(1))), lambda i: F.concat(F.lit("s"), i))))).alias("key_label"),
    )
    place = F.expr("CAST(substring(key_label, 2) AS INT)") - 1
    return out.withColumn("key_sentence_idx", place).withColumn("key_quote", F.get("sentences", F.col("key_sentence_idx"))).drop("sentences", "key_label")


def suspicion_line(suspicion: Column, suspects: list[str] | Column | None = None) -> Column:
    """Names at level 2 or more, highest first, then in roster order; null if none. suspects: the only names shown."""
    shown = lambda s: F.lit(True) if suspects is None else F.array_contains(suspects, s["name"]) if isinstance(suspects, Column) else s["name"].isin(suspects)
    seen = F.filter(suspicion, lambda s: (s["value"] >= 2) & shown(s))
    ordered = F.array_sort(F.transform(seen, lambda s: F.struct((-s["value"]).alias("v"), s["ord"].alias("o"), s["name"].alias("n"))))
    return F.when(F.size(seen) > 0, F.concat(F.lit("  suspicion: "), F.array_join(F.transform(ordered, lambda s: F.concat_ws(" ", s["n"], (-s["v"]).cast("string"))), ", ")))


def render_entry(suspects: list[str] | Column | None = None, posthoc: Column | None = None) -> Column:
    """The lines of an entry. posthoc: the probability that it contradicts earlier notes, if known."""
    p = lambda c: show_probability(c / 10000.0)
    parts = [F.concat(F.lit(f"{q}="), F.col(f"{q}.value"), F.lit("("), p(F.col(f"{q}.p4")), F.lit(")")) for q in ("concerns", "secondary", "event_type")]
    flags = F.array_compact(F.array(*[F.when(noul_value(F.col(q)), F.concat(F.lit(f"{q} "), p(F.col(q)))) for q in ("new_evidence", "time_reference", "location_stated")]))
    lines = [
        F.concat(F.lit("#"), F.col("t").cast("string"), F.lit(" "), F.concat_ws(" ", *parts)),
        F.when(F.size(flags) > 0, F.concat(F.lit("  flags: "), F.array_join(flags, ", "))),
        suspicion_line(F.col("suspicion"), suspects),
    ]
    if posthoc is not None:
        lines.append(F.when(posthoc >= 0.5, F.concat(F.lit("  post-hoc: contradicts earlier notes "), show_probability(posthoc))))
    lines.append(F.concat(F.lit('  "'), F.col("key_quote"), F.lit('"')))
    return F.concat_ws("\n", *lines)


def chapter_headers(rendered: DataFrame) -> DataFrame:
    """Adds header: the chapter's line where it changes, else null."""
    w = Window.partitionBy("doc_id").orderBy("t")
    name = F.coalesce("chapter", F.lit("untitled"))
    return rendered.withColumn("header", F.when(~F.col("chapter").eqNullSafe(F.lag("chapter").over(w)) | (F.row_number().over(w) == 1), F.concat(F.lit("== "), name, F.lit(" =="))))


def frames(steps: DataFrame, window: int = 3, key: str = "doc_id", step: str = "t", note: str = "note", text: str = "text") -> DataFrame:
    """At each step: notes of all steps before the window, and full texts in the window before the step itself."""
    w = Window.partitionBy(key).orderBy(step)
    return steps.withColumn("notes", F.collect_list(note).over(w.rowsBetween(Window.unboundedPreceding, -window))).withColumn(
        "recent", F.collect_list(F.struct(F.col(step).alias("k"), F.col(text).alias("x"))).over(w.rowsBetween(-(window - 1), -1)) if window > 1 else F.array().cast("array<struct<k:int,x:string>>")
    )


def compose_state(window: int = 3) -> Column:
    """The state: notes, recent passages in full (left out if none), the current passage. Of columns t, text, notes, recent."""
    upto = F.greatest(F.col("t") - window, F.lit(0))
    head = F.when(upto < 1, "CASE NOTES (none yet)").otherwise(F.concat(F.lit("CASE NOTES (compressed record of passages 1-"), upto.cast("string"), F.lit(")")))
    notes = F.when(F.size("notes") > 0, F.array_join("notes", "\n")).otherwise(NO_NOTES)
    recent = F.when(F.size("recent") > 0, F.concat(F.lit("RECENT PASSAGES (full text):\n"), F.array_join(F.transform("recent", lambda r: F.concat(F.lit("[#"), r["k"].cast("string"), F.lit("]\n"), r["x"])), "\n\n")))
    return F.concat_ws("\n\n", F.concat(head, F.lit(":\n"), notes), recent, F.concat(F.lit("CURRENT PASSAGE (#"), F.col("t").cast("string"), F.lit("):\n"), F.col("text")))


def rollup_rows(group: DataFrame) -> DataFrame:
    """Rolled entries by run of one chapter: ranges, event counts (most first, then by name) and quotes of new evidence.

    group: doc_id, rollup_id, t, chapter, event, evidence, quote.
    """
    w = Window.partitionBy("doc_id", "rollup_id").orderBy("t")
    runs = group.withColumn("new", F.when((F.row_number().over(w) == 1) | ~F.col("chapter").eqNullSafe(F.lag("chapter").over(w)), 1).otherwise(0)).withColumn("run", F.sum("new").over(w))
    counts = runs.where("event IS NOT NULL").groupBy("doc_id", "rollup_id", "run", "event").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.groupBy("doc_id", "rollup_id", "run").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "event"))), lambda x: F.struct(x["event"].alias("event"), (-x["m"]).alias("n"))).alias("event_counts"))
    quotes = F.array_sort(F.collect_list(F.when(F.col("evidence") & (F.col("quote") != ""), F.struct("t", "quote"))))
    spans = runs.groupBy("doc_id", "rollup_id", "run").agg(F.first("chapter", True).alias("chapter"), F.min("t").alias("from_t"), F.max("t").alias("to_t"), quotes.alias("quotes"))
    return spans.join(counts, ["doc_id", "rollup_id", "run"], "left")


def step_rollups(steps: DataFrame, budget: int, window: int) -> DataFrame:
    """The rollups of each document, over the true length of every state, with their summaries: while the state at a step is over
    budget, the oldest un-rolled chapter (or, if that is all there is, its older half, one entry at least) becomes one summary.

    steps: doc_id, t, chapter, note, text, event, evidence, quote. A rollup lies within one chapter. Rollups depend on
    budget and window alone, not on where a run starts or ends, nor on what a run finds. The rule is sequential in a document and
    parallel across documents; a task has lengths and quotes of its document, no texts. A step that stays over budget with all
    rolled up ends its document's plan with a row of id -1 and no summary.
    """

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        doc = pdf["doc_id"].iloc[0]
        plain = lambda c: [x if isinstance(x, str) else None for x in pdf[c]]
        t, note, text = ([int(x) for x in pdf[c]] for c in ("t", "note_length", "text_length"))
        chapter, event, quote = plain("chapter"), plain("event"), plain("quote")
        head = lambda i: len(f"== {chapter[i] or 'untitled'} ==") + 1
        begins = lambda i: i == rolled or chapter[i] != chapter[i - 1]
        out: list[tuple] = []
        rolled = seen = 0  # entries are rolled oldest first, so a count tells which
        live = summed = 0  # length of visible un-rolled notes and headers, and of summaries, each with a line end
        for s in range(1, len(t) + 1):
            visible, step = max(0, s - window), t[s - 1]
            while seen < visible:
                live += note[seen] + 1 + (head(seen) if begins(seen) else 0)
                seen += 1
            upto = max(0, step - window)
            fixed = len("CASE NOTES (none yet):\n" if upto < 1 else f"CASE NOTES (compressed record of passages 1-{upto}):\n")
            recent = [len(f"[#{t[i]}]\n") + text[i] for i in range(visible, s - 1)]
            fixed += len("\n\nRECENT PASSAGES (full text):\n") + sum(recent) + 2 * (len(recent) - 1) if recent else 0
            fixed += len(f"\n\nCURRENT PASSAGE (#{step}):\n") + text[s - 1]
            while -(-(fixed + (live + summed - 1 if visible else len(NO_NOTES))) // 4) > budget:
                if rolled >= visible:
                    out.append((doc, -1, step, step, step, None))
                    return pd.DataFrame(out, columns=columns)
                end = rolled + 1
                while end < visible and chapter[end] == chapter[rolled]:
                    end += 1
                if end == visible:
                    end = rolled + max(1, (visible - rolled) // 2)
                counts = Counter(x for x in event[rolled:end] if x is not None)
                lines = [f"== SUMMARY of passages #{t[rolled]}-#{t[end - 1]} ==", f"[{chapter[rolled] or 'untitled'}] #{t[rolled]}-#{t[end - 1]}: " + ", ".join(f"{k} x{n}" for k, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])))]
                lines += [f'  #{t[i]} "{quote[i]}"' for i in range(rolled, end) if quote[i]]
                summary = "\n".join(lines)
                out.append((doc, len(out) + 1, t[rolled], t[end - 1], step, summary))
                rolled, summed = end, summed + len(summary) + 1
                live = sum(note[i] + 1 + (head(i) if begins(i) else 0) for i in range(rolled, visible))
        return pd.DataFrame(out, columns=columns)

    columns = ["doc_id", "id", "from_t", "to_t", "triggered_at_t", "summary"]
    length = lambda c: F.coalesce(F.length(c), F.lit(0))
    sizes = steps.select("doc_id", "t", "chapter", length("note").alias("note_length"), length("text").alias("text_length"), "event", F.when(F.col("evidence"), F.col("quote")).alias("quote"))
    # Documents whose states can't come to the budget, with every note and header and the longest texts, have no rollups.
    whole = Window.partitionBy("doc_id")
    notes = F.sum(F.col("note_length") + F.greatest(length("chapter"), F.lit(8)) + 9).over(whole)
    sizes = sizes.withColumn("_most", notes + (F.max("text_length").over(whole) + 40) * max(window, 1) + 200).where(F.col("_most") > 4 * budget).drop("_most")
    kind = steps.schema["doc_id"].dataType.simpleString()
    return sizes.groupBy("doc_id").applyInPandas(plan, f"doc_id {kind}, id int, from_t int, to_t int, triggered_at_t int, summary string")


def rollups_by_document(plans: DataFrame) -> DataFrame:
    """doc_id, rollups: what step_rollups found, in one row a document."""
    return plans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("from_t", "to_t", "triggered_at_t", "id", "summary"))).alias("rollups"))


def _epochs(rollups: Column) -> Column:
    """Array of (covered, first, last): the steps over which the same notes are rolled up, and the last note that is."""
    real = F.transform(F.filter(rollups, lambda r: r["id"] > 0), lambda r: F.struct(r["to_t"].alias("covered"), r["triggered_at_t"].alias("first")))
    from_ = F.concat(F.array(F.struct(F.lit(0).alias("covered"), F.lit(1).alias("first"))), real)
    last = lambda i: F.coalesce(F.get(from_, i + 1)["first"] - 1, F.lit(2**31 - 1))
    return F.filter(F.transform(from_, lambda e, i: F.struct(e["covered"], e["first"], last(i).alias("last"))), lambda e: e["first"] <= e["last"])


def rolled_states(steps: DataFrame, budget: int = 26_000, window: int = 3, keep: tuple[str, ...] = (), plans: DataFrame | None = None, between: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, t, keep, state, over_budget. Rollups made up to a step stand for the notes they cover, other notes follow under
    a header where the chapter changes. over_budget: with all rolled up this step or an earlier one is still over budget,
    so it can't be asked. steps as for step_rollups.

    Steps over which the same notes are rolled up are an epoch. Each note is dealt to the epochs in which it is live, and a step
    gathers the notes of its epoch alone: what it gathers is bounded by the budget, not by the length of the document.
    plans: rollups_by_document, where they are known. between: the only steps wanted; notes that none of them shows are left out.
    """
    if plans is None:
        plans = rollups_by_document(step_rollups(steps, budget, window))
    title = F.concat(F.lit("== "), F.coalesce(F.when(F.col("chapter") != "", F.col("chapter")), F.lit("untitled")), F.lit(" =="))
    notes = chapter_headers(steps).select("doc_id", "t", *keep, "text", F.struct("t", title.alias("title"), F.col("header").isNotNull().alias("begins"), "note").alias("note"))
    joined = notes.join(plans, "doc_id", "left").withColumn("rollups", F.coalesce("rollups", F.array().cast(plans.schema["rollups"].dataType)))
    lo, hi = between or (1, 2**31 - 1)
    live = lambda e: (e["covered"] < F.col("t")) & (e["last"] >= F.col("t")) & (e["first"] <= hi) & (e["last"] >= lo)
    dealt = _apart(joined.where(F.col("t") <= hi), "doc_id", "t", *keep, "text", "note", "rollups", F.filter(_epochs(F.col("rollups")), live).alias("epochs"))
    dealt = dealt.select("doc_id", "t", *keep, "text", "note", "rollups", F.inline("epochs"))
    w = Window.partitionBy("doc_id", "covered").orderBy("t")
    recent = F.collect_list(F.struct(F.col("t").alias("k"), F.col("text").alias("x"))).over(w.rowsBetween(-(window - 1), -1)) if window > 1 else F.array().cast("array<struct<k:int,x:string>>")
    framed = dealt.withColumns({"notes": F.collect_list("note").over(w.rowsBetween(Window.unboundedPreceding, -window)), "recent": recent})
    framed = framed.where((F.col("t") >= F.greatest("first", F.lit(lo))) & (F.col("t") <= F.col("last")))
    active = F.filter("rollups", lambda r: (r["id"] > 0) & (r["triggered_at_t"] <= F.col("t")))
    lines = F.transform("notes", lambda n, i: F.concat_ws("\n", F.when((i == 0) | n["begins"], n["title"]), n["note"]))
    over = F.exists("rollups", lambda r: (r["id"] < 0) & (r["triggered_at_t"] <= F.col("t")))
    shown = _apart(framed, "doc_id", "t", *keep, "text", "recent", over.alias("over_budget"), F.concat(F.transform(active, lambda r: r["summary"]), lines).alias("notes"))
    return shown.select("doc_id", "t", *keep, compose_state(window).alias("state"), "over_budget")


def noted(entries: DataFrame, keep: tuple[str, ...] = (), suspects: Column | None = None, posthoc: Column | None = None) -> DataFrame:
    """What rolled_states needs of entries, besides texts. With suspects or posthoc (see render_entry) the notes are those of a
    run; rollups are planned without."""
    return entries.select("doc_id", "t", *keep, "chapter", render_entry(suspects, posthoc).alias("note"), F.col("event_type.value").alias("event"), noul_value(F.col("new_evidence")).alias("evidence"), F.col("key_quote").alias("quote"))


def run_estimate(chunked: DataFrame, window: int = 3, characters: int = 25, budget: int = 26_000, price_per_m: float = 0.042) -> DataFrame:
    """Per document: calls, tokens for building the ledger and for inference, cost and minutes. chunked: doc_id, t, text.

    Window sums by document; the constants are per-question and per-entry estimates.
    """
    w = Window.partitionBy("doc_id").orderBy("t")
    n = token_count(F.col("text"))
    rows = chunked.select("doc_id", "t", n.alias("tokens")).withColumn("full", F.sum("tokens").over(w.rowsBetween(-(window - 1), 0)))
    notes = F.least(F.greatest(F.col("t") - window, F.lit(0)) * 95, F.lit(budget))
    agg = rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.sum(2 * F.col("tokens") + (600 + 115 * characters)).alias("ledger_tokens"),
        F.sum(notes + F.col("full") + (150 + 40 * (characters + 1))).alias("inference_tokens"),
    )
    calls = 2 * F.col("chunks")
    return agg.select(
        "doc_id", "chunks", calls.alias("calls"), "ledger_tokens", "inference_tokens",
        F.round((F.col("ledger_tokens") + F.col("inference_tokens")) / 1e6 * price_per_m, 4).alias("cost"), F.round((calls * 0.35 + 60) / 60, 1).alias("minutes"),
    )
