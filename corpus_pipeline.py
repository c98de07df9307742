"""A corpus cleaned in stages, each over all that the one before kept. Each stage is written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm import bpe, decontaminate, language, line_dedup, near_dup
from foliate.llm.common import Scratch, columns, table
from foliate.llm.native import parted
from foliate.llm.queries import HELD_OUT, tokenizer

#: Least share of the probability that the predicted language must have.
LEAST_SCORE = 0.5


def _row(docs: DataFrame) -> DataFrame:
    """Id, text and the whole row, so that no column of the documents can clash with an operator's."""
    return docs.select("doc_id", "text", F.struct(*columns(docs)).alias("row"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents whose id is not one of gone (column of). Only texts that may be among them are shuffled."""
    scratch = Scratch(docs.sparkSession)
    gone = scratch.cut(gone, "gone")
    maybe, rest = parted(_row(docs), ["doc_id"], gone, scratch, "gone-bloom", ["of"])
    return maybe.join(gone, F.col("doc_id").eqNullSafe(F.col("of")), "left_anti").union(rest).select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be told. Null text, or text without a letter, goes."""
    model = language.train(docs.where(f"NOT ({HELD_OUT})"), tokenizer("piece_bpe_32k.model"))
    judged = language.identify(_row(docs), model, keep=["row"])
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("row.*")


def line_dedup_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that have an earlier partner, and recounts n_chars where it is a column. A document of which nothing is left goes."""
    out = line_dedup.remove_lines(_row(docs))
    left = out.where((F.col("n_removed") == 0) | F.rlike("kept", F.lit(r"[^\x20\x09-\x0D]")))
    row = F.col("row").withField("text", F.when(F.col("text").isNotNull(), F.col("kept")))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")))
    return left.select(row.alias("row")).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group; rows that repeat its id stay with it."""
    found = near_dup.near_duplicates(docs).groupBy(F.col("doc_id").alias("of")).agg(F.bool_or("kept").alias("kept"))
    return _without(docs, found.where("NOT kept").select("of"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a passage of the benchmark."""
    bad = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("of"))
    return _without(docs, bad)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and the text decoded from them."""
    return bpe.bpe_encode(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup_), ("near_dedup", near_dedup), ("decontamination", decontamination), ("encoding", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs


#: Language identification has no SQL form.
ORACLE_SQL = None
