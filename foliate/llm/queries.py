"""The registered queries: each applies its operator to whole tables and derives digest columns; SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, embedding_dup, html, language, line_dedup, near_dup, periodic, quality, substring, url_filter, vector_codes
from .common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.bpe_encode(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


HELD_OUT = "crc32(CAST(doc_id AS STRING)) % 4 = 2"


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(f"NOT ({HELD_OUT})"), tokenizer("piece_bpe_32k.model"))
    return language.identify(docs, model).select("doc_id", F.expr(HELD_OUT).alias("held_out"), "lang_pred", "score")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.encode(F.array_join("item_ids", ","), "UTF-8"), 256).alias("items_sha256"), "contaminated")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.default_rules(spark)).drop("url")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return vector_codes.label_errors(out.codes).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(out.digest()).alias("codebooks_sha256"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dup.near_vectors(table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.periodic_runs(periodic.plant(table(spark, sf_dir, "documents"))).withColumn("best", periodic.strongest(F.col("runs")))
    line = lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, F.expr("1000 * best.length DIV best.period").alias("exponent_milli"), sha(listed).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_bpe, op3_language_id, op4_substring_dedup, op5_decontamination, op6_chat_formatting, op7_minhash_near_dedup, op8_line_dedup, op9_quality_rules, op10_url_filter, op11_vector_codes, op12_embedding_near_dedup, op13_periodic_runs)}
SQL = {"op4_substring_dedup": substring.REMOVE_SQL, "op5_decontamination": decontaminate.DECONTAMINATE_SQL, "op6_chat_formatting": chat.ROTATE_SQL, "op8_line_dedup": line_dedup.REMOVE_LINES_SQL, "op10_url_filter": url_filter.FILTER_SQL, "op11_vector_codes": vector_codes.COMPRESS_SQL, "op12_embedding_near_dedup": embedding_dup.NEAR_VECTORS_SQL, "op13_periodic_runs": periodic.RUNS_SQL}
