"""Command line: python -m foliate.cli run|list|inspect|ledger|roster|validate|curve|export|vacuum FOLDER ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import curves, entities, results
from .plans import book
from .plans.questions import INFERENCE
from .sources.store import Store


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="foliate")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("run", "list", "inspect", "ledger", "roster", "validate", "curve", "export", "vacuum"):
        s = sub.add_parser(name)
        s.add_argument("out", help="folder of the tables")
        if name == "run":
            s.add_argument("path", help="folder of books")
            s.add_argument("--target", type=int, default=500)
            s.add_argument("--window", type=int, default=3)
            s.add_argument("--limit", type=int)
            s.add_argument("--posthoc", action="store_true", help="show stored answers in later notes")
            s.add_argument("--max-calls", type=int, help="fail, before anything is committed, beyond so many calls a stage")
        if name == "export":
            s.add_argument("path", help="folder of long Parquet rows, one part a run")
        if name == "inspect":
            s.add_argument("book")
            s.add_argument("t", type=int)
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.appName("foliate").getOrCreate()
    read = lambda name: book.latest(spark, a.out, name)
    if a.command == "run":
        tables = book.run_all(spark, a.path, a.out, book.Settings(target=a.target, window=a.window, posthoc=a.posthoc, max_calls=a.max_calls), limit=a.limit)
        tables["results"].groupBy("doc_id").agg(F.count(F.lit(1)).alias("steps"), F.sum("input_tokens").alias("tokens")).show(truncate=False)
        tables["refused"].groupBy("doc_id", "verdict").agg(F.count(F.lit(1)).alias("steps_refused"), F.min("t").alias("from_t")).show(truncate=False)
    elif a.command == "list":
        book.listing(read("books")).show(1000, truncate=False)
    elif a.command == "inspect":
        book.inspect(read("chunks"), a.book, a.t).show(1000, truncate=False)
    elif a.command == "ledger":
        book.ledger_status(read("chunks"), read("ledger")).show(1000, truncate=False)
    elif a.command == "roster":
        read("roster").orderBy("doc_id", "ord").show(1000, truncate=False)
    elif a.command == "validate":
        entities.roster_warnings(read("chunks"), read("roster"), "\n\n").orderBy("doc_id", "kind", F.desc("n"), "subject").show(1000, truncate=False)
    elif a.command == "export":
        results.write_long(results.long_answers(read("results"), INFERENCE, ["run_id", "doc_id", "model", "answer"]), a.path)
    elif a.command == "vacuum":
        print(f"{len(Store(spark, a.out).vacuum())} folders and versions deleted")
    else:
        curves.rank(curves.long_rows(read("results"))).where("rank = 1").select("doc_id", "t", "candidate", "prob").orderBy("doc_id", "t").show(1000, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
