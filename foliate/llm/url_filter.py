"""URL rules and block lists: a blocked Bloom filter passes possible hits to an exact hash join. Native throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small
from .native import BITS_AN_ENTRY, MAX_BLOCKS, blocked_bloom, bloom_test

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules of the query: host, path, verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Listed canonical URLs (host and path, no scheme): they and all below them are blocked where no rule fits. One host of the
#: sample tables, to show the list at work; real lists come as tables (block_list).
LISTED = ("spam-farm.example.org/",)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judges every url. rules: host, path, verdict, rule (null: a listed URL, which yields to any rule).

    A rule fits its host and all subdomains if the url's path starts with the rule's; the longest wins, the longer host
    among equals. A url that nothing fits is allowed. A null url, or one without ://, has empty host and path and is
    allowed. An empty list allows all. Repeated rows stay (they are judged once); other columns are ignored.
    """
    rules = rules.select(F.concat("host", "path").alias("rule_key"), "rule", "verdict", F.length("host").alias("host_len"), F.length("path").alias("path_len"))
    facts = rules.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("path_len")).alias("lens")).first()  # distinct lengths of paths: few
    blocks = 1
    while blocks < min(MAX_BLOCKS, -(-facts["n"] * BITS_AN_ENTRY // 64)):
        blocks *= 2
    bloom = blocked_bloom(rules.select(F.col("rule_key").alias("key")), blocks)

    host, path = parts(F.col("url"))
    once = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("n"))
    split = once.select("page_id", "url", "n", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    heads = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in facts["lens"]] or [F.lit(None).cast("string")]), lambda x: x.isNotNull())
    keys = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda p: F.concat(s, p)))))
    probes = split.select("page_id", "url", "n", "host", "path", F.posexplode_outer(keys).alias("pos", "key"))
    maybe = bloom_test(bloom, F.col("key"), blocks)
    probes = probes.withColumn("key", F.when(maybe, F.col("key"))).where("key IS NOT NULL OR coalesce(pos, 0) = 0")
    judged = probes.join(broadcast_if_small(rules), F.col("key") == F.col("rule_key"), "left")
    best = F.max_by(F.struct("rule", "verdict"), F.when(F.col("verdict").isNotNull(), F.struct(F.col("rule").isNotNull(), F.col("host_len") + F.col("path_len"), F.col("host_len"))))
    out = judged.groupBy("page_id", "url").agg(F.any_value("n").alias("n"), F.any_value("host").alias("host"), F.any_value("path").alias("path"), best.alias("best"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select(
        "page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict")
    )


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {RULE_ROWS} AS r(host, path, verdict, rule)")


def block_list(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Rule rows of a table of listed URLs, with or without scheme, to be united with other rules.

    A URL lists itself and all below it, on its host and all subdomains. Query and fragment are left out. A host without
    a path, or with / alone, has an empty path, which also fits URLs that end with the host. Nulls and rows without a
    host are left out; repeated rows count once.
    """
    url = F.col(url_col)
    host, path = parts(F.when(F.locate("://", url) > 0, url).otherwise(F.concat(F.lit("://"), url)))
    listed = urls.select(host.alias("host"), F.when(path == "/", "").otherwise(path).alias("path")).where("host <> ''").distinct()
    return listed.select("host", "path", F.lit("block").alias("verdict"), F.lit(None).cast("string").alias("rule"))


RULE_ROWS = ", ".join([f"('{h}', '{p}', '{v}', '{h}{p}')" for h, p, v in RULES] + [f"('{u.split('/', 1)[0]}', '/{u.split('/', 1)[1]}', 'block', NULL)" for u in LISTED])
FILTER_SQL = f"""
WITH r(host, path, verdict, rule) AS (VALUES {RULE_ROWS}),
u AS (SELECT row_number() OVER () AS id, page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT id, page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS (SELECT s.*, r.verdict, r.rule, row_number() OVER (PARTITION BY id ORDER BY (r.rule IS NOT NULL) DESC, length(r.host) + length(r.path) DESC NULLS LAST, length(r.host) DESC NULLS LAST) AS k
      FROM s LEFT JOIN r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM j WHERE k = 1
"""
