"""The pipeline against plain Python, on documents with odd rows and clashing columns."""

import random

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from foliate.llm import language
from foliate.llm.queries import HELD_OUT, tokenizer

from . import brute

R = random.Random(23)
PROSE = "the lamp was out and nobody in the house could say when it had been put away by whoever came last to that cold room with its broken chair and yellow wall near a window".split()


def prose(n):
    return " ".join(R.choice(PROSE) for _ in range(n))


def text(lines):
    return "\n".join(prose(R.randint(6, 25)) for _ in range(lines))


def test_pipeline(spark, tmp_path):
    passage, shared = prose(30), prose(20)
    rows = [(i, text(R.randint(2, 5))) for i in range(40)]
    rows += [(40, None), (41, ""), (42, "12 34 !"), (43, rows[3][1]), (44, rows[4][1] + " more"), (45, text(2) + "\n" + shared), (46, shared + "\n" + text(2)), (47, text(1) + "\n" + passage + "\n" + text(1)), (48, "\n\n" + text(2) + "\n")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, kept string, n_removed string, lang_pred string, `of` string, `a.b` int"
    docs = spark.createDataFrame([(i, t, "en", "s", -1, "r", "k", "n", "l", "o", 7) for i, t in rows], schema)
    bench = [(1, passage), (2, "never said words of a benchmark item that nothing holds here"), (3, None)]
    docs.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: (bytes(r.ids), r.n_tokens, r.decoded) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    scorer = language.Scorer(language.train(docs.where(f"NOT ({HELD_OUT})"), tokenizer("piece_bpe_32k.model")))
    told = [x for x, (best, score) in zip(rows, scorer.texts([t for _, t in rows]), strict=True) if best >= 0 and score >= corpus_pipeline.LEAST_SCORE]
    assert {i for i, _ in rows} - {i for i, _ in told} == {40, 41, 42}
    lined = [(i, kept) for i, _, removed, kept in brute.lines(told) if not removed or brute.WORD.search(kept)]
    assert {i for i, _ in told} - {i for i, _ in lined} >= {43}
    groups = brute.near(lined, 5, 80)
    single = [(i, t) for i, t in lined if groups[i][1] == i]
    clean = [x for x, r in zip(single, brute.decontaminate(single, bench), strict=True) if not r[5]]
    assert 47 not in {i for i, _ in clean}
    lib = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    want = {i: (np.array(e, "<u4").tobytes(), len(e), t) for i, t in clean for e in [lib.encode(t, add_special_tokens=False).ids]}
    assert got == want


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the lamp was out and nobody came", "en", "x"), (2, None, None, None)], "doc_id long, text string, lang string, `a.b` string")
    spark.createDataFrame([(1, "x y z")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for source in (docs, docs.where("false")):
            out = stage(spark, source, str(tmp_path))
            assert out.columns == docs.columns, name
            assert out.count() <= source.count()
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
