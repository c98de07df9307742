"""The registered queries of the engine's own operators, each with SQL that says the same where SQL can.

A document stands for a book, a line for a paragraph, a greedy group of lines for a step.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .functions import text as T
from .operators import analytics, chunking, curves, entities, extraction, ledger, results, scoring
from .plans.questions import COMPRESSION, INFERENCE, Spec
from .scoring.answers import with_culprit
from .sources import readers
from .sources.sinks import scratch_dir
from .sources.store import Store
from .streaming import live

TARGET = 120
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ROSTER = [
    {"canonical": "The", "aliases": ["the"], "is_suspect": True},
    {"canonical": "Und", "aliases": ["und der", "der"], "is_suspect": True},
    {"canonical": "Les", "aliases": ["les", "que"]},
    {"canonical": "Por", "aliases": ["QUE", "los"]},
    {"canonical": "Zanzibar", "aliases": []},
]
CANDIDATES = [c["canonical"] for c in ROSTER] + ["none_of_these"]


def query(sql: str | None = None):
    """Registers a query under its name; whole numbers come out as bigint, as in the SQL."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark)
            return df.select(*[F.col(x.name).cast("long") if isinstance(x.dataType, IntegerType) else F.col(x.name) for x in df.schema.fields])

        run.__name__ = f.__name__
        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- SQL that several queries begin with ----
WORDS = r"'[^ \t\n\x0B\f\r\x{A0}]+'"
LINES = f"""l AS (SELECT doc_id, source, p, line, len(regexp_extract_all(line, {WORDS})) AS wc
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS p FROM documents))"""
CHUNKS = f"""{LINES}, a AS (SELECT doc_id, list(wc ORDER BY p) AS wcs FROM l GROUP BY doc_id),
rc AS (SELECT doc_id, 0 AS i, 0::BIGINT AS run, 1 AS t FROM a
  UNION ALL SELECT rc.doc_id, i + 1, CASE WHEN run + wcs[i + 1] >= {TARGET} THEN 0 ELSE run + wcs[i + 1] END, CASE WHEN run + wcs[i + 1] >= {TARGET} THEN t + 1 ELSE t END FROM rc JOIN a USING (doc_id) WHERE i < len(wcs)),
ch AS (SELECT doc_id, rc.t::BIGINT AS t, min(p)::BIGINT AS para_from, (max(p) + 1)::BIGINT AS para_to, sum(wc)::BIGINT AS word_count, string_agg(line, chr(10) ORDER BY p) AS text, (length(string_agg(line, chr(10) ORDER BY p)) + 3) // 4 AS tokens
  FROM l JOIN rc USING (doc_id) WHERE l.p = rc.i GROUP BY doc_id, rc.t)"""
W = "WITH RECURSIVE "
CLOSE = r"""["''”’)\]]*"""
ABBREVIATED_SQL = T.ABBREVIATED.replace("'", "''").replace("(?i:", "(?i:")
SENTENCES = f"""{LINES}, k AS (SELECT doc_id, source, p, list_filter(regexp_extract_all(line, {WORDS}), lambda x: x <> '') AS ws FROM l),
kt AS (SELECT doc_id, source, p, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM k),
kn AS (SELECT *, lead(w) OVER (PARTITION BY doc_id, p ORDER BY i) AS nx FROM kt),
ke AS (SELECT *, CASE WHEN nx IS NULL OR (regexp_matches(w, '[.!?]{CLOSE}$') AND NOT regexp_matches(nx, '^\\p{{Ll}}') AND NOT regexp_matches(w, '{ABBREVIATED_SQL}')) THEN 1 ELSE 0 END AS e FROM kn),
ks AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY doc_id, p ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM ke),
se AS (SELECT doc_id, source, p, s, string_agg(w, ' ' ORDER BY i) AS text FROM ks GROUP BY doc_id, source, p, s)"""
NAMES = f"""{SENTENCES}, nw AS (SELECT doc_id, source, p, s, list_filter(string_split_regex(text, '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '') AS ws FROM se),
nm AS (SELECT doc_id, source, p, s, i, w FROM (SELECT doc_id, source, p, s, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM nw) WHERE i > 0 AND regexp_matches(w, '^[A-Z][a-z]{{2,}}$') AND w NOT IN ({", ".join(f"'{n}'" for n in T.NOT_NAMES)}))"""


def mock(source: str, keys: str, state: str, qid: str, options: list[str], name: str = "m") -> str:
    """CTEs that end in one with keys, pos, option, p4."""
    values = ", ".join(f"({i}, '{o}')" for i, o in enumerate(options))
    return f"""{name}0 AS (SELECT {source}.*, o.pos, o.option, (('0x' || substr(sha256(sha256({state}) || '|{qid}|' || o.option), 1, 8))::BIGINT >> 8) + 1 AS u FROM {source}, (VALUES {values}) AS o(pos, option)),
{name}1 AS (SELECT *, (u * u * 10000 // (sum(u * u) OVER (PARTITION BY {keys})))::BIGINT AS f, row_number() OVER (PARTITION BY {keys} ORDER BY u DESC, pos) AS best FROM {name}0),
{name} AS (SELECT *, (f + CASE WHEN best = 1 THEN 10000 - sum(f) OVER (PARTITION BY {keys}) ELSE 0 END)::BIGINT AS p4 FROM {name}1)"""


def roster_values(rows: list[dict] = ROSTER) -> str:
    return ", ".join(f"({i}, '{c['canonical']}', {str(bool(c.get('is_suspect'))).lower()}, '{entities.names_pattern(c)}')" for i, c in enumerate(rows))


ROSTER_SQL = f"ro(ord, canonical, is_suspect, pattern) AS (VALUES {roster_values()})"
CURVE = f"{CHUNKS}, {mock('ch', 'doc_id, t', 'text', 'culprit', CANDIDATES)}, cv AS (SELECT doc_id, t, pos::BIGINT AS pos, option AS candidate, p4 FROM m)"


def chunked(read, with_text: bool = True) -> DataFrame:
    return chunking.chunks(read("documents"), TARGET, "\n", "\n", with_text)


def long_curve(read) -> DataFrame:
    return curves.long_rows(curves.curve_rows(chunked(read).select("doc_id", "t", F.col("text").alias("state")), CANDIDATES))


# ---- chunks, sentences, words ----
@query(W + CHUNKS + " SELECT doc_id, t, para_from, para_to, word_count FROM ch")
def chunk_paragraphs(read, spark):
    return chunked(read, False).select("doc_id", "t", "para_from", "para_to", "word_count")


@query(W + CHUNKS + """ SELECT doc_id, t, word_count, (sum(word_count) OVER (PARTITION BY doc_id ORDER BY t) - word_count)::BIGINT AS word_from, (sum(word_count) OVER (PARTITION BY doc_id ORDER BY t))::BIGINT AS word_to,
round((sum(word_count) OVER (PARTITION BY doc_id ORDER BY t))::DOUBLE / greatest(sum(word_count) OVER (PARTITION BY doc_id), 1), 6) AS cumulative_fraction FROM ch""")  # fmt: skip
def chunk_meta(read, spark):
    return chunked(read, False).select("doc_id", "t", "word_count", "word_from", "word_to", "cumulative_fraction")


@query("WITH " + SENTENCES + " SELECT doc_id, p, s, text FROM se")
def sentence_split(read, spark):
    lines = read("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return lines.select("doc_id", "p", F.posexplode(T.sentences(F.col("line"))).alias("s", "x")).select("doc_id", "p", "s", "x.text")


@query(f"SELECT doc_id, len(regexp_extract_all(text, {WORDS})) AS n_words, length(text) AS n_text, len(string_split(text, chr(10))) AS n_lines, (length(text) + 3) // 4 AS n_tokens FROM documents")
def word_stats(read, spark):
    return read("documents").select("doc_id", T.word_count(F.col("text")).alias("n_words"), F.length("text").alias("n_text"), F.size(F.split("text", "\n")).alias("n_lines"), T.token_count(F.col("text")).alias("n_tokens"))


@query("WITH " + LINES + r" SELECT doc_id, p, trim(regexp_replace(line, '[ \t\n\x0B\f\r\x{A0}]+', ' ', 'g')) AS line FROM l WHERE regexp_matches(line, '[A-Za-z]')")
def clean_filter_lines(read, spark):
    lines = read("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return lines.where(F.rlike("line", F.lit("[A-Za-z]"))).select("doc_id", "p", T.clean(F.col("line")).alias("line"))


@query("WITH " + LINES + r", c AS (SELECT doc_id, p, trim(regexp_replace(line, '[ \t\n\x0B\f\r\x{A0}]+', ' ', 'g')) AS line FROM l) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS index, line FROM c WHERE length(line) >= 40")
def short_paragraph_filter(read, spark):
    return read("documents").select("doc_id", F.posexplode(readers.old_paragraphs(F.col("text"), 40, "\n")).alias("index", "line"))


HEADINGS = ["CHAPTER IV", "Book Two", "Part the First", "Prologue", "IV. THE BODY", "THE LAST NIGHT", "Part of me was sad.", "I went home.", "CHAPTER ONE!", "WHO IS IT?"]


@query("WITH " + LINES + ", x AS (SELECT doc_id, p, line FROM l UNION ALL SELECT -1, i, h FROM (VALUES " + ", ".join(f"({i}, '{h}')" for i, h in enumerate(HEADINGS)) + f""") AS v(i, h)),
n AS (SELECT doc_id, p, line, len(regexp_extract_all(line, {WORDS})) AS w, regexp_matches(line, '{T.HEADING}') OR regexp_matches(line, '{T.SECTION}') OR regexp_matches(line, '{T.ROMAN}') AS named,
  len(regexp_extract_all(line, '\\p{{L}}')) AS c, len(regexp_extract_all(line, '\\p{{Lu}}')) AS u FROM x)
SELECT doc_id, p, line, w BETWEEN 1 AND 12 AND CASE WHEN named THEN NOT regexp_matches(line, '[!?"”]$') ELSE c >= 3 AND c = u AND NOT regexp_matches(line, '[.!?"]$') END AS heading FROM n""")  # fmt: skip
def heading_lines(read, spark):
    lines = read("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    given = spark.createDataFrame([(-1, i, h) for i, h in enumerate(HEADINGS)], "doc_id long, p int, line string")
    return lines.unionByName(given).withColumn("heading", T.is_heading(F.col("line")))


# ---- entities ----
@query("WITH " + NAMES + """, c AS (SELECT doc_id, w, count(*) AS n, min((p, s, i)) AS f FROM nm GROUP BY doc_id, w HAVING count(*) >= 3),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS ord FROM c) SELECT doc_id, ord, w AS canonical, n FROM o WHERE ord <= 12""")  # fmt: skip
def heuristic_roster(read, spark):
    return entities.heuristic_roster(read("documents"))


KNOWN = [{"canonical": "Les", "aliases": ["Der Die", "Que"]}]


@query("WITH " + NAMES + """, c AS (SELECT source, w, count(*) AS n FROM nm WHERE w NOT IN ('Les', 'Der', 'Die', 'Que') GROUP BY source, w HAVING count(*) >= 8),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, w) AS rank FROM c) SELECT source, w AS word, n, rank FROM o WHERE rank <= 15""")  # fmt: skip
def missed_names(read, spark):
    return entities.missed_names(read("documents"), KNOWN, "source")


@query("""WITH a AS (SELECT source AS canonical, source AS name FROM documents UNION SELECT source, upper(lang) FROM documents)
SELECT lower(name) AS alias, array_to_string(list_sort(list(DISTINCT canonical)), ',') AS owners FROM a WHERE name IS NOT NULL AND canonical IS NOT NULL GROUP BY lower(name) HAVING count(DISTINCT canonical) > 1""")
def duplicate_aliases(read, spark):
    """Sources as entities, also called by their languages: names that several have."""
    roster = read("documents").where("source IS NOT NULL").groupBy(F.col("source").alias("canonical")).agg(F.collect_set(F.upper("lang")).alias("langs"))
    roster = roster.select("canonical", F.array_prepend("langs", F.col("canonical")).alias("names"))
    return entities.duplicate_aliases(roster).select("alias", F.array_join("owners", ",").alias("owners"))


_OVER = [c for c in ROSTER if c.get("aliases")]


def _over_sql() -> str:
    parts = []
    for c in _OVER:
        left, terms = "' ' || text || ' '", []
        for n in sorted([c["canonical"], *c["aliases"]], key=len, reverse=True):
            pattern = T.alias_pattern([n])
            terms.append(f"regexp_matches({left}, '{pattern}')::INT")
            left = f"regexp_replace(regexp_replace({left}, '{pattern}', ' # ', 'g'), '{pattern}', ' # ', 'g')"
        parts.append(f"SELECT doc_id, p, s, text, '{c['canonical']}' AS canonical, {' + '.join(terms)} AS used FROM se")
    return "WITH " + SENTENCES + ", u AS (" + " UNION ALL ".join(parts) + ") SELECT doc_id, canonical, count(*) AS n_sentences, min_by(text, (p, s)) AS sample FROM u WHERE used >= 2 GROUP BY doc_id, canonical"


@query(_over_sql())
def over_merge(read, spark):
    return entities.over_merges(read("documents"), ROSTER)


_WORD = r"[^\p{L}\p{N}_]"


@query("WITH " + NAMES + f""", c AS (SELECT source, w, count(*) AS n, min((doc_id, p, s, i)) AS f FROM nm WHERE source IS NOT NULL GROUP BY source, w HAVING count(*) >= 3),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, f) AS ord FROM c) WHERE ord <= 3),
e AS (SELECT a.source, a.w AS canonical, b.w AS alias FROM o a LEFT JOIN o b ON a.source = b.source AND b.ord = a.ord + 1),
a AS (SELECT source, canonical, canonical AS name FROM e UNION SELECT source, canonical, alias FROM e WHERE alias IS NOT NULL),
ss AS (SELECT source, text, row_number() OVER (PARTITION BY doc_id ORDER BY p, s) AS k FROM se),
h AS (SELECT e.source, e.canonical, ss.k, ss.text FROM e JOIN ss ON e.source = ss.source
  WHERE regexp_matches(' ' || text || ' ', '{_WORD}' || canonical || '{_WORD}') AND regexp_matches(' ' || text || ' ', '{_WORD}' || alias || '{_WORD}')),
m AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, w) AS rank FROM c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.source = c.source AND o.w = c.w))
SELECT source AS doc_id, 'duplicate_alias' AS kind, lower(name) AS subject, count(DISTINCT canonical) AS n, array_to_string(list_sort(list(DISTINCT canonical)), ', ') AS detail FROM a GROUP BY source, lower(name) HAVING count(DISTINCT canonical) > 1
UNION ALL SELECT source, 'over_merge', canonical, count(*), arg_min(text, (k, text)) FROM h GROUP BY source, canonical
UNION ALL SELECT source, 'missed_name', w, n, NULL FROM m WHERE rank <= 15""")  # fmt: skip
def roster_warnings(read, spark):
    """All checks of a roster over the documents of every source: its three most frequent names, each also called by the next."""
    docs = read("documents").where("source IS NOT NULL")
    counts, path = entities.name_counts(docs, "source").where("n >= 3").withColumnRenamed("source", "doc_id"), f"{scratch_dir(spark)}/names-{uuid.uuid4().hex}"
    counts.write.parquet(path)  # rosters and missed names both read them: texts are split for names once
    counts = spark.read.schema(counts.schema).parquet(path)
    names = entities.most_frequent(counts, "doc_id", 3, 3)
    roster = names.withColumn("alias", F.lead("canonical").over(Window.partitionBy("doc_id").orderBy("ord"))).select("doc_id", "canonical", F.array("canonical", "alias").alias("names"))
    return entities.roster_warnings(docs.select(F.col("source").alias("doc_id"), "text"), roster, least=3, counts=counts)


@query("WITH " + NAMES + """, c AS (SELECT doc_id, w, count(*) AS n, min((p, s, i)) AS f FROM nm GROUP BY doc_id, w HAVING count(*) >= 3),
o AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS ord FROM c),
d AS (SELECT doc_id, (length('Title: ' || coalesce(nullif(source, ''), 'unknown') || chr(10) || chr(10) || '<novel>' || chr(10) || coalesce(text, '') || chr(10) || '</novel>') + 3) // 4 AS tokens FROM documents)
SELECT d.doc_id, ord, w AS canonical, CASE WHEN tokens > 1500 THEN tokens || ' tokens, of 1500 that fit' END AS error FROM d LEFT JOIN o ON d.doc_id = o.doc_id AND tokens <= 1500 AND ord <= 12""")  # fmt: skip
def extracted_roster(read, spark):
    """Rosters of all documents by the default extractor, of which a text over 1500 tokens is refused; one row where there are none."""
    texts = read("documents").select("doc_id", F.col("source").alias("title"), "text")
    store = Store(spark, f"{scratch_dir(spark)}/extracted-{uuid.uuid4().hex}")
    return extraction.extract(texts, extraction.FrequentNames(separator="\n", context_tokens=1500), store).select("doc_id", "ord", "canonical", "error")


@query(W + CHUNKS + f", {ROSTER_SQL} SELECT doc_id, t, canonical, regexp_matches(text, pattern) AS mentioned FROM ch, ro")
def mentions(read, spark):
    return entities.mentions(chunked(read), ROSTER)


@query(W + CHUNKS + f", {ROSTER_SQL} SELECT doc_id, canonical, min(t) FILTER (regexp_matches(text, pattern)) AS first_mention FROM ch, ro GROUP BY doc_id, canonical")
def first_mention(read, spark):
    return entities.first_mentions(chunked(read), ROSTER)


@query("""WITH e AS (SELECT source AS doc_id, lang AS canonical, max(n_chars) >= 4000 AS is_suspect FROM documents GROUP BY source, lang),
o AS (SELECT doc_id, canonical, is_suspect, row_number() OVER (PARTITION BY doc_id ORDER BY canonical NULLS FIRST) - 1 AS ord FROM e),
s AS (SELECT doc_id, canonical, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS ord, count(*) OVER (PARTITION BY doc_id) AS n FROM o WHERE is_suspect)
SELECT doc_id, 'full_cast' AS which, ord, canonical FROM o UNION ALL SELECT doc_id, 'suspects_only', ord, canonical FROM s WHERE n >= 2""")
def candidate_sets(read, spark):
    """The candidates of every source: its languages, of which those with a long document are suspects."""
    cast = read("documents").groupBy(F.col("source").alias("doc_id"), F.col("lang").alias("canonical")).agg((F.max("n_chars") >= 4000).alias("is_suspect"))
    ordered = cast.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("canonical")) - 1)
    return entities.candidate_table(ordered)


# ---- identity and sources ----
@query(r"""SELECT doc_id, sha256(lower(trim(regexp_replace(translate(text, '‘’“”–—', '''''""--'), '[ \t\n\x0B\f\r\x{A0}]+', ' ', 'g')))) AS text_sha256 FROM documents""")
def text_identity(read, spark):
    return read("documents").select("doc_id", T.text_hash(F.col("text")).alias("text_sha256"))


BOOK_URLS = ["https://www.gutenberg.org/files/863/863-h/863-h.htm", "https://gutenberg.net.au/ebooks13/1302201h.html", "https://www.gutenberg.org/ebooks/12"]


@query("WITH u AS (SELECT page_id, url FROM pages UNION ALL SELECT -i, u FROM (VALUES " + ", ".join(f"({i}, '{u}')" for i, u in enumerate(BOOK_URLS, 1)) + r""") AS v(i, u)),
x AS (SELECT page_id, url, regexp_extract(url, '(?i)gutenberg\.org/(?:cache/epub|ebooks|files|epub)/(\d+)', 1) AS a, regexp_extract(url, '(?i)gutenberg\.net\.au/ebooks\d*/(\d+)h?\.(?:html?|txt)', 1) AS b FROM u)
SELECT page_id, CASE WHEN a <> '' THEN 'pg' || a WHEN b <> '' THEN 'pgau' || b ELSE trim(substr(trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-'), 1, 40), '-') || '-' || substr(sha256(url), 1, 8) END AS book_id FROM x""")  # fmt: skip
def book_id_from_url(read, spark):
    given = spark.createDataFrame([(-i, u) for i, u in enumerate(BOOK_URLS, 1)], "page_id long, url string")
    found = [F.concat(F.lit(mark), F.nullif(F.regexp_extract("url", f"(?i){pattern.pattern}", 1), F.lit(""))) for mark, pattern in readers.BOOK_URL]
    own = F.concat(T.slug(F.col("url")), F.lit("-"), F.substring(F.sha2("url", 256), 1, 8))
    return read("pages").select("page_id", "url").unionByName(given).select("page_id", F.coalesce(*found, own).alias("book_id"))


@query("""WITH f AS (SELECT 'p' || page_id AS id, html AS body, 'page' AS name FROM pages UNION ALL SELECT 'd' || doc_id, text, 'doc.txt' FROM documents UNION ALL SELECT 'x1', '%PDF-1.7 x', 'a' UNION ALL SELECT 'x2', 'PK..', 'b.epub' UNION ALL SELECT 'x3', 'plain', 'c.XHTML')
SELECT id, CASE WHEN substr(body, 1, 5) = '%PDF-' THEN 'pdf' WHEN substr(body, 1, 2) = 'PK' THEN 'epub' WHEN regexp_matches(lower(name), '\\.x?html?$') OR regexp_matches(substr(body, 1, 20000), '(?i)<(html|body|p|div)[\\s>]') THEN 'html' ELSE 'txt' END AS kind FROM f""".replace("\\\\", "\\"))  # fmt: skip
def detect_kind(read, spark):
    files = read("pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("body"), F.lit("page").alias("name"))
    files = files.union(read("documents").select(F.concat(F.lit("d"), "doc_id"), "text", F.lit("doc.txt")))
    files = files.union(spark.createDataFrame([("x1", "%PDF-1.7 x", "a"), ("x2", "PK..", "b.epub"), ("x3", "plain", "c.XHTML")], "id string, body string, name string"))
    return files.select("id", readers.kind_of(F.encode("body", "UTF-8"), F.col("name")).alias("kind"))


@query()
def html_paragraphs(read, spark):
    """Paragraphs of every page with the chapter (heading) they are under."""
    parsed = readers.parse(read("pages").select("page_id", F.encode("html", "UTF-8").alias("content"), F.lit("html").alias("kind")), ["page_id"], ["html"])
    title = F.element_at(F.filter("chapters", lambda c: c["paragraph_offset"] <= F.col("pos")), -1)["title"]
    rows = parsed.where(F.size("paragraphs") > 0).select("page_id", "title", "chapters", F.posexplode("paragraphs").alias("pos", "paragraph"))
    return rows.select("page_id", "title", "pos", "paragraph", F.when(F.exists("chapters", lambda c: c["paragraph_offset"] <= F.col("pos")), title).alias("chapter"))


# ---- as-of joins ----
@query("""SELECT a.conv_id, a.turn, a.role, b.text AS chapter FROM conversations a ASOF LEFT JOIN (SELECT * FROM conversations WHERE role <> 'assistant') b ON a.conv_id = b.conv_id AND b.turn <= a.turn""")
def chapter_asof(read, spark):
    turns = read("conversations")
    marks = turns.where("role <> 'assistant'").select("conv_id", "turn", F.col("text").alias("chapter"))
    return analytics.as_of(turns.select("conv_id", "turn", "role"), marks, "conv_id", "turn", "turn", "chapter")


@query("""WITH s AS (SELECT user_id, ts, max(event_id) AS signup_id FROM events WHERE event_type = 'signup' GROUP BY user_id, ts)
SELECT p.event_id, p.user_id, s.signup_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN s ON p.user_id = s.user_id AND s.ts <= p.ts""")  # fmt: skip
def asof_signup_purchase(read, spark):
    e = read("events")
    signups = e.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("signup_id"))
    return analytics.as_of(e.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), signups, "user_id", "ts", "ts", "signup_id").select("event_id", "user_id", "signup_id")


# ---- scorer ----
@query(f"WITH {mock('documents', 'doc_id', 'text', 'event_type', ['discovery', 'testimony', 'movement', 'none'])} SELECT doc_id, option, p4 FROM m")
def mock_distribution(read, spark):
    d = scoring.mock_distribution(F.col("text"), "event_type", ["discovery", "testimony", "movement", "none"])
    return read("documents").select("doc_id", F.inline(d)).select("doc_id", "option", "p4")


@query(f"WITH {mock('conversations', 'conv_id, turn', 'text', 'outage', ['yes', 'no'])} SELECT conv_id, turn, p4, 10000 - p4 AS complement, p4 >= 5000 AS value FROM m WHERE option = 'yes'")
def noul_decision(read, spark):
    d = scoring.mock_distribution(F.col("text"), "outage", ["yes", "no"])
    return read("conversations").select("conv_id", "turn", F.get(d, 0)["p4"].alias("p4")).select("conv_id", "turn", "p4", (10000 - F.col("p4")).alias("complement"), scoring.noul_value(F.col("p4")).alias("value"))


LEVELS = ["l1", "l2", "l3", "l4", "l5"]


@query(f"WITH {mock('conversations', 'conv_id, turn', 'text', 'urgency', LEVELS)} SELECT conv_id, turn, arg_min(pos + 1, (-p4, pos))::BIGINT AS value, round(sum(p4 * (pos + 1)) / 10000.0, 4) AS expected FROM m GROUP BY conv_id, turn")
def score_answer(read, spark):
    value, expected = scoring.score_value(F.col("d"))
    return read("conversations").withColumn("d", scoring.mock_distribution(F.col("text"), "urgency", LEVELS)).select("conv_id", "turn", value.alias("value"), expected.alias("expected"))


@query("WITH " + f"o AS (SELECT doc_id, option, row_number() OVER (PARTITION BY doc_id ORDER BY sha256(text || '|culprit|' || option)) - 1 AS option_position FROM documents, (VALUES {', '.join(f'({chr(39)}{c}{chr(39)})' for c in CANDIDATES)}) AS v(option)) SELECT doc_id, option, option_position FROM o UNION ALL SELECT doc_id, 'absent', NULL FROM documents")
def option_position(read, spark):
    shown = read("documents").select("doc_id", scoring.option_order(F.col("text"), "culprit", CANDIDATES).alias("order"))
    each = shown.select("doc_id", "order", F.explode(F.array(*[F.lit(c) for c in [*CANDIDATES, "absent"]])).alias("option"))
    return each.select("doc_id", "option", (F.nullif(F.array_position("order", F.col("option")), F.lit(0)) - 1).alias("option_position"))


GUARD = [Spec("culprit", "choice", "Who did it? " * 3, tuple((c, None) for c in CANDIDATES), "culprit"), Spec("motive", "choice", "Why? " * 30, (("money", None), ("love", None)), "motive")]


@query("WITH t AS (SELECT doc_id, (length(text) + 3) // 4 AS state_tokens FROM documents) SELECT doc_id, state_tokens, CASE WHEN state_tokens + {1} > 600 THEN 'state' WHEN state_tokens + {0} > 620 THEN 'request' ELSE 'ok' END AS verdict FROM t".format(*scoring.question_tokens(GUARD)))
def budget_guard(read, spark):
    return scoring.budget_guard(read("documents").select("doc_id", F.col("text").alias("state")), GUARD, 600, 620).select("doc_id", "state_tokens", "verdict")


@query("""WITH c AS (SELECT sha256(source || '|' || lang) AS key, doc_id AS created_at, n_chars AS result FROM documents)
SELECT key, max(created_at) AS created_at, arg_max(result, created_at) AS result FROM c GROUP BY key""")
def cache_dedup(read, spark):
    rows = read("documents").select(F.sha2(F.concat_ws("|", "source", "lang"), 256).alias("key"), F.col("doc_id").alias("created_at"), F.col("n_chars").alias("result"))
    return scoring.latest(rows)


@query(f"""WITH {mock('conversations', 'conv_id, turn', 'text', 'outage', ['yes', 'no'], 'a')}, {mock('conversations', 'conv_id, turn', 'text', 'kind', ['bug', 'billing', 'how_to', 'other'], 'b')}, {mock('conversations', 'conv_id, turn', 'text', 'urgency', LEVELS, 'c')},
x AS (SELECT conv_id, turn, max(p4) FILTER (option = 'yes') AS outage FROM a GROUP BY ALL), y AS (SELECT conv_id, turn, arg_min(option, (-p4, pos)) AS kind FROM b GROUP BY ALL), z AS (SELECT conv_id, turn, arg_min(pos + 1, (-p4, pos))::BIGINT AS urgency FROM c GROUP BY ALL)
SELECT conv_id, turn, kind, urgency, CASE WHEN outage >= 5000 AND urgency >= 4 THEN 'P0' WHEN outage >= 5000 OR urgency >= 4 THEN 'P1' ELSE 'P2' END AS route FROM x JOIN y USING (conv_id, turn) JOIN z USING (conv_id, turn)""")  # fmt: skip
def ticket_triage(read, spark):
    ask = lambda q, o: scoring.mock_distribution(F.col("text"), q, o)
    t = read("conversations").select("conv_id", "turn", F.get(ask("outage", ["yes", "no"]), 0)["p4"].alias("outage"), scoring.winner(ask("kind", ["bug", "billing", "how_to", "other"])).alias("kind"), scoring.score_value(ask("urgency", LEVELS))[0].alias("urgency"))
    out, urgent = scoring.noul_value(F.col("outage")), F.col("urgency") >= 4
    return t.select("conv_id", "turn", "kind", "urgency", F.when(out & urgent, "P0").when(out | urgent, "P1").otherwise("P2").alias("route"))


# ---- curves ----
@query(W + CURVE + " SELECT doc_id, t, pos, candidate, p4, p4 / 10000.0 AS prob FROM cv")
def curve_long(read, spark):
    return long_curve(read).select("doc_id", "t", "pos", "candidate", "p4", "prob")


@query(W + CURVE + " SELECT doc_id, t, candidate, row_number() OVER (PARTITION BY doc_id, t ORDER BY p4 DESC, pos) AS rank FROM cv")
def curve_rank(read, spark):
    return curves.rank(long_curve(read)).select("doc_id", "t", "candidate", "rank")


@query(W + CURVE + " SELECT doc_id, t, candidate, floor((p4 - coalesce(lag(p4) OVER (PARTITION BY doc_id, candidate ORDER BY t), p4) + 50) / 100)::BIGINT AS points FROM cv")
def curve_delta(read, spark):
    return curves.delta(long_curve(read)).select("doc_id", "t", "candidate", "points")


@query(W + CURVE + " SELECT doc_id, candidate, max(p4) AS peak4, arg_min(t, (-p4, t)) AS peak_t FROM cv GROUP BY doc_id, candidate")
def curve_peak(read, spark):
    return curves.peak(long_curve(read)).select("doc_id", "candidate", "peak4", "peak_t")


@query(W + CURVE + " SELECT doc_id, t, arg_min(candidate, (-p4, pos)) AS leader, max(p4) AS p4 FROM cv GROUP BY doc_id, t")
def curve_leader(read, spark):
    return curves.leader(long_curve(read))


@query(W + CURVE + ", r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, t ORDER BY p4 DESC, pos) AS rank FROM cv) SELECT doc_id, t, rank, candidate, p4 FROM r WHERE rank <= 3")
def curve_topk(read, spark):
    return curves.top(long_curve(read), 3).select("doc_id", "t", "rank", "candidate", "p4")


@query(W + CHUNKS + f", {mock('ch', 'doc_id, t', 'text', 'culprit_revealed', ['yes', 'no'])} SELECT doc_id, min(t) FILTER (p4 >= 9000) AS first_t, count(*) AS n_steps FROM m WHERE option = 'yes' GROUP BY doc_id")
def curve_reveal(read, spark):
    steps = chunked(read).select("doc_id", "t", F.get(scoring.mock_distribution(F.col("text"), "culprit_revealed", ["yes", "no"]), 0)["p4"].alias("yes"))
    return curves.reveal(steps, F.col("yes"), 9000)


@query(W + CURVE + ", n AS (SELECT *, lead(p4) OVER (PARTITION BY doc_id, candidate ORDER BY t) AS nx FROM cv) SELECT doc_id, t, candidate, (p4 + coalesce(nx, p4)) / 2.0 AS halfway FROM n")
def curve_interpolate(read, spark):
    return curves.interpolate(long_curve(read)).select("doc_id", "t", "candidate", "halfway")


@query(W + CURVE + """, k AS (SELECT doc_id, candidate, max(p4) AS peak4, arg_min(t, (-p4, t)) AS peak_t, min(pos) AS pos FROM cv GROUP BY doc_id, candidate),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY peak4 DESC, pos) AS r FROM k) SELECT doc_id, candidate, row_number() OVER (PARTITION BY doc_id ORDER BY peak_t, pos) AS slot FROM r WHERE r <= 4""")  # fmt: skip
def series_slots(read, spark):
    return curves.series_slots(long_curve(read), 4).select("doc_id", "candidate", "slot")


@query(W + CURVE + " SELECT doc_id, t, arg_min(candidate, (-p4, pos)) AS answer, string_agg(candidate || '=' || p4, ',' ORDER BY pos) AS distribution, sum(p4)::BIGINT AS total FROM cv GROUP BY doc_id, t")
def round_trip(read, spark):
    back = curves.wide_rows(long_curve(read))
    shown = F.array_join(F.transform("distribution", lambda d: F.concat(d["option"], F.lit("="), d["p4"].cast("string"))), ",")
    return back.select("doc_id", "t", "answer", shown.alias("distribution"), F.aggregate("distribution", F.lit(0).cast("long"), lambda a, d: a + d["p4"]).alias("total"))


# ---- results, look-ups, sinks ----
OPTIONS = ["quality", "toxic", "other", "none_of_these"]


@query("""WITH k AS (SELECT doc_id, 'quality' AS name, quality = 1 AS v FROM labels UNION ALL SELECT doc_id, 'toxic', toxic = 1 FROM labels)
SELECT d.doc_id, o.c AS candidate, CASE WHEN l.doc_id IS NOT NULL THEN coalesce(k.v, false) END AS is_culprit FROM documents d CROSS JOIN (VALUES ('quality'), ('toxic'), ('other'), ('none_of_these')) AS o(c)
LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id AND k.name = o.c""")  # fmt: skip
def culprit_lookup(read, spark):
    marks = read("labels").select("doc_id", F.inline(F.array(*[F.struct(F.lit(n).alias("canonical"), (F.col(n) == 1).alias("is_culprit")) for n in ("quality", "toxic")])))
    rows = read("documents").select("doc_id", F.explode(F.array(*[F.lit(o) for o in OPTIONS])).alias("candidate"))
    return with_culprit(rows, marks)


@query(W + CHUNKS + f""", {ROSTER_SQL}, f AS (SELECT doc_id, canonical, min(t) FILTER (regexp_matches(text, pattern)) AS first FROM ch, ro GROUP BY doc_id, canonical),
o(candidate) AS (VALUES {', '.join(f"('{c}')" for c in CANDIDATES)}) SELECT ch.doc_id, ch.t, candidate, CASE WHEN f.canonical IS NOT NULL THEN coalesce(f.first <= ch.t, false) END AS introduced_by_t FROM ch CROSS JOIN o LEFT JOIN f ON f.doc_id = ch.doc_id AND f.canonical = candidate""")  # fmt: skip
def introduced_by_t(read, spark):
    c = chunked(read)
    rows = c.select("doc_id", "t", F.explode(F.array(*[F.lit(x) for x in CANDIDATES])).alias("candidate"))
    return results.introduced(rows, entities.first_mentions(c, ROSTER))


@query(W + CHUNKS + " SELECT doc_id, t, word_count FROM ch WHERE (doc_id + t) % 3 <> 0")
def resume_steps(read, spark):
    steps = chunked(read, False).select("doc_id", "t", "word_count")
    return results.pending(steps, steps.where("(doc_id + t) % 3 = 0").select("doc_id", "t"), ["doc_id", "t"])


@query("""SELECT source, count(*) AS n_docs, sum(CASE WHEN source LIKE '%1' THEN n_chars ELSE 0 END)::BIGINT AS n_chars FROM documents GROUP BY source UNION ALL SELECT 'new', 1, 7""")
def manifest_upsert(read, spark):
    old = read("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.lit(0).cast("long").alias("n_chars"))
    fresh = read("documents").where("source LIKE '%1'").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))
    return results.upsert(old, fresh.unionByName(spark.createDataFrame([("new", 1, 7)], "source string, n_docs long, n_chars long")), ["source"])


@query(W + CHUNKS + ", g AS (SELECT doc_id, min(t) AS from_t, max(t) // 2 AS to_t FROM ch GROUP BY doc_id) SELECT doc_id, t FROM ch ANTI JOIN g ON ch.doc_id = g.doc_id AND ch.t BETWEEN g.from_t AND g.to_t")
def range_cover_anti(read, spark):
    c = chunked(read, False).select("doc_id", "t")
    ranges = c.groupBy("doc_id").agg(F.min("t").cast("long").alias("from_t"), F.call_function("div", F.max("t"), F.lit(2)).alias("to_t"))
    return results.uncovered(c, ranges)


@query("""WITH e AS (SELECT doc_id, '2' AS version, source AS roster, lang AS questions, sha256(text) AS text FROM documents),
h AS (SELECT doc_id, CASE WHEN n_chars < 500 THEN '1' ELSE '2' END AS version, nullif(source, 'src10') AS roster, CASE WHEN lang = 'de' THEN 'en' ELSE lang END AS questions, sha256(replace(text, chr(10), ' ')) AS text FROM documents)
SELECT h.doc_id, concat_ws(',', CASE WHEN h.version IS DISTINCT FROM e.version THEN 'version' END, CASE WHEN h.roster IS DISTINCT FROM e.roster THEN 'roster' END, CASE WHEN h.questions IS DISTINCT FROM e.questions THEN 'questions' END, CASE WHEN h.text IS DISTINCT FROM e.text THEN 'text' END) AS problems FROM h JOIN e USING (doc_id)""")  # fmt: skip
def compat_check(read, spark):
    """Headers of all documents as stored by an older run (short texts under version 1, no roster for one source, lines joined) against today's."""
    docs, c = read("documents"), F.col
    want = docs.select("doc_id", F.lit("2").alias("version"), c("source").alias("roster"), c("lang").alias("questions"), F.sha2("text", 256).alias("text"))
    have = docs.select(
        "doc_id", F.when(c("n_chars") < 500, "1").otherwise("2").alias("version"), F.nullif("source", F.lit("src10")).alias("roster"),
        F.when(c("lang") == "de", "en").otherwise(c("lang")).alias("questions"), F.sha2(F.translate("text", "\n", " "), 256).alias("text"),
    )
    return results.compatibility(have, want, ["version", "roster", "questions", "text"]).select("doc_id", F.array_join("problems", ",").alias("problems"))


@query("""SELECT doc_id, CASE WHEN source = lang THEN lang ELSE lang || ',' || source END || ',none' AS names, lang = 'none' OR source = 'none' AS clash, CASE WHEN lang = 'en' THEN '' ELSE lang END AS extra FROM documents""")
def set_ops(read, spark):
    """Order-preserving dedup, options with extras, clash, and what a key holds beyond what is allowed."""
    names, extra = F.array_distinct(F.array("lang", "source", "lang")), F.array(F.lit("none"))
    return read("documents").select("doc_id", F.array_join(F.concat(names, extra), ",").alias("names"), (F.size(F.array_intersect(names, extra)) > 0).alias("clash"), F.array_join(F.array_except(F.array("lang"), F.array(F.lit("en"))), ",").alias("extra"))


# ---- budgets, windows, states ----
@query("WITH " + LINES + """, s AS (SELECT doc_id, p, sum((length(line) + 3) // 4) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM l)
SELECT doc_id, max(run)::BIGINT AS total_tokens, (min(p) FILTER (run + 20 > 400) + 1)::BIGINT AS first_overflow FROM s GROUP BY doc_id""")  # fmt: skip
def prefix_overflow(read, spark):
    return chunking.prefix_overflow(read("documents"), 400, 20)


@query(W + CHUNKS + " SELECT doc_id, t, (sum(tokens) OVER (PARTITION BY doc_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))::BIGINT AS window_tokens FROM ch")
def window_tokens(read, spark):
    w = Window.partitionBy("doc_id").orderBy("t").rowsBetween(-2, 0)
    return chunked(read).select("doc_id", "t", F.sum(T.token_count(F.col("text"))).over(w).alias("window_tokens"))


@query(W + CHUNKS + """, w AS (SELECT *, sum(tokens) OVER (PARTITION BY doc_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS f FROM ch),
g AS (SELECT doc_id, count(*) AS chunks, sum(2 * tokens + 600 + 115 * 25)::BIGINT AS ledger_tokens, sum(least(greatest(t - 3, 0) * 95, 26000) + f + 150 + 40 * 26)::BIGINT AS inference_tokens FROM w GROUP BY doc_id)
SELECT doc_id, chunks, 2 * chunks AS calls, ledger_tokens, inference_tokens FROM g""")  # fmt: skip
def run_estimate(read, spark):
    return ledger.run_estimate(chunked(read)).select("doc_id", "chunks", "calls", "ledger_tokens", "inference_tokens")


@query("""SELECT conv_id, turn, coalesce(string_agg(role, ',') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 3 PRECEDING), '') AS notes,
coalesce(string_agg(turn || ':' || text, ',') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS recent FROM conversations""")
def notes_recent_frames(read, spark):
    f = ledger.frames(read("conversations"), 3, "conv_id", "turn", "role")
    return f.select("conv_id", "turn", F.array_join("notes", ",").alias("notes"), F.array_join(F.transform("recent", lambda r: F.concat_ws(":", r["k"].cast("string"), r["x"])), ",").alias("recent"))


@query("SELECT conv_id, turn, string_agg(text, chr(10) || chr(10)) OVER (PARTITION BY conv_id ORDER BY turn) AS state FROM conversations")
def prefix_state(read, spark):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return read("conversations").select("conv_id", "turn", F.array_join(F.collect_list("text").over(w), "\n\n").alias("state"))


@query("""WITH r AS (SELECT conv_id, turn, role, CASE WHEN role = 'system' THEN 'opening' ELSE 'talk' END AS chapter FROM conversations),
f AS (SELECT *, CASE WHEN lag(chapter) OVER (PARTITION BY conv_id ORDER BY turn) = chapter THEN 0 ELSE 1 END AS n FROM r), i AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM f)
SELECT conv_id, island::BIGINT AS island, chapter, role, count(*) AS n FROM i GROUP BY conv_id, island, chapter, role""")  # fmt: skip
def event_counts_by_island(read, spark):
    rows = read("conversations").withColumn("chapter", F.when(F.col("role") == "system", "opening").otherwise("talk"))
    return analytics.islands(rows, "conv_id", "turn", "chapter").groupBy("conv_id", "island", "chapter", "role").agg(F.count(F.lit(1)).alias("n"))


BUDGET = 900
BATTERY = {q["id"]: q for q in COMPRESSION}


def _probability(p: str) -> str:
    return f"CASE WHEN {p} >= 10000 THEN '1.0' ELSE regexp_replace(printf('%.2f', {p} / 10000.0), '^0+', '') END"


def _notes_sql() -> str:
    """CTEs that end in no: doc_id, t, chapter, text, note, event, evidence, quote of every chunk."""
    names = [c["canonical"] for c in ROSTER]
    asked = {"concerns": names + BATTERY["concerns"]["extra_options"], "secondary": names + BATTERY["secondary"]["extra_options"], "event_type": BATTERY["event_type"]["options"]}
    flags = ["new_evidence", "time_reference", "location_stated"]
    parts = [mock("ch", "doc_id, t", "text", q, o, f"q_{q}") for q, o in asked.items()] + [mock("ch", "doc_id, t", "text", q, ["yes", "no"], f"q_{q}") for q in flags]
    best = [f"b_{q} AS (SELECT doc_id, t, arg_min(option, (-p4, pos)) AS v, max(p4) AS p FROM q_{q} GROUP BY doc_id, t)" for q in asked]
    best += [f"b_{q} AS (SELECT doc_id, t, p4 AS p FROM q_{q} WHERE option = 'yes')" for q in flags]
    shown = " || ' ' || ".join(f"'{q}=' || b_{q}.v || '(' || {_probability(f'b_{q}.p')} || ')'" for q in asked)
    flagged = ", ".join(f"CASE WHEN b_{q}.p >= 5000 THEN '{q} ' || {_probability(f'b_{q}.p')} END" for q in flags)
    joins = " ".join(f"JOIN b_{q} ON b_{q}.doc_id = ch.doc_id AND b_{q}.t = ch.t" for q in [*asked, *flags])
    return f"""{", ".join(parts)}, {", ".join(best)}, {ROSTER_SQL}, cc AS (SELECT ch.doc_id, ch.t, ch.text, ro.ord, ro.canonical FROM ch, ro),
{mock("cc", "doc_id, t, ord", "sha256(text) || '|' || canonical", "suspicion", [x.replace("'", "''") for x in BATTERY["suspicion"]["levels"]], "sp")},
lv AS (SELECT doc_id, t, ord, canonical, arg_min(pos + 1, (-p4, pos)) AS v FROM sp GROUP BY doc_id, t, ord, canonical),
su AS (SELECT doc_id, t, '  suspicion: ' || string_agg(canonical || ' ' || v, ', ' ORDER BY v DESC, ord) AS line FROM lv WHERE v >= 2 GROUP BY doc_id, t),
cs AS (SELECT ch.doc_id, ch.t, ch.text AS state, se.text AS quote, row_number() OVER (PARTITION BY ch.doc_id, ch.t ORDER BY se.p, se.s) AS pos FROM ch JOIN se ON se.doc_id = ch.doc_id AND se.p >= ch.para_from AND se.p < ch.para_to),
k0 AS (SELECT *, (('0x' || substr(sha256(sha256(state) || '|key_sentence|s' || pos), 1, 8))::BIGINT >> 8) + 1 AS u FROM cs),
k1 AS (SELECT *, (u * u * 10000 // (sum(u * u) OVER (PARTITION BY doc_id, t)))::BIGINT AS f, row_number() OVER (PARTITION BY doc_id, t ORDER BY u DESC, pos) AS best FROM k0),
k2 AS (SELECT *, f + CASE WHEN best = 1 THEN 10000 - sum(f) OVER (PARTITION BY doc_id, t) ELSE 0 END AS p4 FROM k1),
kq AS (SELECT doc_id, t, arg_min(quote, (-p4, pos)) AS quote FROM k2 GROUP BY doc_id, t),
no AS (SELECT ch.doc_id, ch.t, 'part ' || ((ch.t - 1) // 4) AS chapter, ch.text, b_event_type.v AS event, b_new_evidence.p >= 5000 AS evidence, kq.quote,
  concat_ws(chr(10), '#' || ch.t || ' ' || {shown}, '  flags: ' || nullif(concat_ws(', ', {flagged}), ''), su.line, '  "' || kq.quote || '"') AS note
  FROM ch {joins} LEFT JOIN su ON su.doc_id = ch.doc_id AND su.t = ch.t LEFT JOIN kq ON kq.doc_id = ch.doc_id AND kq.t = ch.t)"""


NOTES = f"{CHUNKS}, {SENTENCES.removeprefix(LINES + ', ')}, {_notes_sql()}"
WINDOW = 3
#: The planner of rollups, a step of the recursion for each step of a document and for each rollup. Of lists by document: nl, running
#: lengths of notes with line ends; hl, running lengths of headers where the chapter changes; hd, each header's own; il and xl, lengths.
ROLLUPS_SQL = f"""{NOTES},
n1 AS (SELECT *, length('== ' || chapter || ' ==') + 1 AS head, CASE WHEN lag(chapter) OVER (PARTITION BY doc_id ORDER BY t) IS DISTINCT FROM chapter THEN 1 ELSE 0 END AS begins FROM no),
n2 AS (SELECT doc_id, count(*) AS n, list(length(note) + 1 ORDER BY t) AS nl, list(head ORDER BY t) AS hd, list(begins ORDER BY t) AS bg, list(length(text) ORDER BY t) AS xl, list(length('[#' || t || ']') + 1 + length(text) ORDER BY t) AS rl,
  list(event ORDER BY t) AS ev, list(CASE WHEN evidence THEN quote END ORDER BY t) AS qu, list(chapter ORDER BY t) AS cp FROM n1 GROUP BY doc_id),
rr AS (SELECT doc_id, 1 AS s, 0 AS rolled, 0 AS id, 0::BIGINT AS summed, NULL::INT AS from_t, NULL::INT AS to_t, NULL::INT AS at_t, NULL::VARCHAR AS summary, false AS dead FROM n2
  UNION ALL
  SELECT doc_id, CASE WHEN over THEN s ELSE s + 1 END, CASE WHEN rolls THEN upto ELSE rolled END, CASE WHEN rolls THEN id + 1 ELSE id END, CASE WHEN rolls THEN summed + length(made) + 1 ELSE summed END,
    CASE WHEN rolls THEN rolled + 1 WHEN over THEN s END, CASE WHEN rolls THEN upto WHEN over THEN s END, CASE WHEN over THEN s END, CASE WHEN rolls THEN made END, over AND NOT rolls FROM (
    SELECT *, over AND rolled < visible AS rolls, '== SUMMARY of passages #' || (rolled + 1) || '-#' || upto || ' ==' || chr(10) || '[' || cp[rolled + 1] || '] #' || (rolled + 1) || '-#' || upto || ': '
      || array_to_string(list_transform(list_sort(list_transform(list_distinct(ev[rolled + 1:upto]), lambda e: [lpad((999999 - len(list_filter(ev[rolled + 1:upto], lambda x: x = e)))::VARCHAR, 6, '0'), e])), lambda p: p[2] || ' x' || (999999 - p[1]::INT)), ', ')
      || array_to_string(list_transform(list_filter(range(rolled + 1, upto + 1), lambda i: qu[i] <> ''), lambda i: chr(10) || '  #' || i || ' "' || qu[i] || '"'), '') AS made FROM (
      SELECT *, CASE WHEN stop < visible THEN stop ELSE rolled + greatest(1, (visible - rolled) // 2) END AS upto FROM (
        SELECT *, coalesce(list_min(list_filter(range(rolled + 1, visible + 1), lambda i: i > rolled + 1 AND cp[i] <> cp[rolled + 1])) - 1, visible) AS stop,
          (fixed + CASE WHEN visible > 0 THEN live + summed - 1 ELSE {len(ledger.NO_NOTES)} END + 3) // 4 > {BUDGET} AS over FROM (
          SELECT rr.*, n2.n, n2.cp, n2.ev, n2.qu, greatest(s - {WINDOW}, 0) AS visible,
            coalesce(list_sum(nl[rolled + 1:greatest(s - {WINDOW}, 0)]), 0) + coalesce(list_sum(list_transform(range(rolled + 1, greatest(s - {WINDOW}, 0) + 1), lambda i: CASE WHEN i = rolled + 1 OR bg[i] = 1 THEN hd[i] ELSE 0 END)), 0) AS live,
            CASE WHEN s <= {WINDOW} THEN length('CASE NOTES (none yet):') + 1 ELSE length('CASE NOTES (compressed record of passages 1-' || (s - {WINDOW}) || '):') + 1 END
            + CASE WHEN s > 1 THEN length('RECENT PASSAGES (full text):') + 3 + list_sum(rl[greatest(s - {WINDOW}, 0) + 1:s - 1]) + 2 * (s - 2 - greatest(s - {WINDOW}, 0)) ELSE 0 END
            + length('CURRENT PASSAGE (#' || s || '):') + 3 + xl[s] AS fixed
          FROM rr JOIN n2 USING (doc_id) WHERE s <= n AND NOT dead))))),
rp AS (SELECT doc_id, CASE WHEN dead THEN -1 ELSE id END AS id, from_t, to_t, at_t AS triggered_at_t, summary FROM rr WHERE at_t IS NOT NULL)"""
STATES_SQL = f"""{ROLLUPS_SQL},
cv AS (SELECT no.doc_id, no.t, coalesce(max(rp.to_t) FILTER (rp.id > 0), 0) AS covered, coalesce(bool_or(rp.id < 0), false) AS over_budget, coalesce(string_agg(rp.summary, chr(10) ORDER BY rp.from_t) FILTER (rp.id > 0), '') AS sums
  FROM no LEFT JOIN rp ON rp.doc_id = no.doc_id AND rp.triggered_at_t <= no.t GROUP BY no.doc_id, no.t),
ln AS (SELECT cv.doc_id, cv.t, string_agg(CASE WHEN n1.t = cv.covered + 1 OR n1.begins = 1 THEN '== ' || n1.chapter || ' ==' || chr(10) ELSE '' END || n1.note, chr(10) ORDER BY n1.t) AS live
  FROM cv JOIN n1 ON n1.doc_id = cv.doc_id AND n1.t > cv.covered AND n1.t <= cv.t - {WINDOW} GROUP BY cv.doc_id, cv.t),
re AS (SELECT no.doc_id, no.t, string_agg('[#' || b.t || ']' || chr(10) || b.text, chr(10) || chr(10) ORDER BY b.t) AS recent FROM no JOIN no b ON b.doc_id = no.doc_id AND b.t < no.t AND b.t > no.t - {WINDOW} GROUP BY no.doc_id, no.t)
SELECT no.doc_id, no.t, concat_ws(chr(10) || chr(10), CASE WHEN no.t <= {WINDOW} THEN 'CASE NOTES (none yet)' ELSE 'CASE NOTES (compressed record of passages 1-' || (no.t - {WINDOW}) || ')' END || ':' || chr(10)
  || CASE WHEN no.t <= {WINDOW} THEN '{ledger.NO_NOTES}' ELSE concat_ws(chr(10), nullif(cv.sums, ''), ln.live) END,
  'RECENT PASSAGES (full text):' || chr(10) || re.recent, 'CURRENT PASSAGE (#' || no.t || '):' || chr(10) || no.text) AS state, cv.over_budget
FROM no JOIN cv ON cv.doc_id = no.doc_id AND cv.t = no.t LEFT JOIN ln ON ln.doc_id = no.doc_id AND ln.t = no.t LEFT JOIN re ON re.doc_id = no.doc_id AND re.t = no.t"""


def _entries(read, keep: tuple[str, ...] = ()) -> DataFrame:
    c = chunking.with_sentences(chunked(read)).withColumn("chapter", F.concat(F.lit("part "), F.call_function("div", F.col("t") - 1, F.lit(4)).cast("string")))
    return ledger.entries(c, ROSTER, keep, mentions=False)


def _noted(read) -> DataFrame:
    return ledger.noted(_entries(read, ("text",)), ("text",))


@query(W + NOTES + " SELECT doc_id, t, note FROM no")
def entry_render(read, spark):
    """The note of every chunk."""
    return _entries(read).select("doc_id", "t", ledger.render_entry().alias("note"))


@query(W + ROLLUPS_SQL + " SELECT doc_id, id, from_t, to_t, triggered_at_t, summary FROM rp")
def rollup_plan(read, spark):
    """The rollups of documents whose states go over a small budget, by the true lengths of notes and texts."""
    return ledger.step_rollups(_noted(read), BUDGET, WINDOW)


@query(W + STATES_SQL)
def state_at_step(read, spark):
    """The state of every step: notes before a window of three, rolled up where over budget, then full texts."""
    notes, path = _noted(read), f"{scratch_dir(spark)}/notes-{uuid.uuid4().hex}"
    notes.write.parquet(path)  # plans and states both read them: the battery is asked once
    return ledger.rolled_states(spark.read.schema(notes.schema).parquet(path), BUDGET, WINDOW)


@query("WITH " + LINES + """, s AS (SELECT doc_id, p, sum((length(line) + 3) // 4) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM l),
g AS (SELECT doc_id, count(*) AS n, max(run)::BIGINT AS total, sum(run + 20)::BIGINT AS sent, (min(p) FILTER (run + 20 > 400) + 1)::BIGINT AS first_overflow FROM s GROUP BY doc_id)
SELECT doc_id, n AS paragraphs, round(total / n, 1) AS average_tokens, sent AS input_tokens, floor(total / n * n * (n + 1) / 2 + 20 * n)::BIGINT AS quadratic_tokens, total + 20 AS longest, first_overflow, round(sent * 0.042 / 1e6, 6) AS cost FROM g""")
def prefix_estimate(read, spark):
    """What asking after every line about all text so far would take."""
    return chunking.prefix_estimate(read("documents"), 400, 20)


# ---- the viewer's tables ----
@query(W + CHUNKS + f""", {ROSTER_SQL}, f AS (SELECT doc_id, canonical, min(t) FILTER (regexp_matches(text, pattern)) AS first FROM ch, ro GROUP BY doc_id, canonical),
nm(canonical, names) AS (VALUES {", ".join(f"('{c['canonical']}', '{','.join(dict.fromkeys([c['canonical'], *c.get('aliases', [])]))}')" for c in ROSTER)}),
o AS (SELECT d.doc_id, x.name FROM documents d, (VALUES {", ".join(f"('{c}')" for c in CANDIDATES + ["Somebody"])}) AS x(name))
SELECT o.doc_id, row_number() OVER (PARTITION BY o.doc_id ORDER BY o.name = 'none_of_these', coalesce(f.first, 1000000), o.name) AS place, o.name, coalesce(nm.names, CASE WHEN o.name = 'none_of_these' THEN '' ELSE o.name END) AS names, f.first AS first_chunk, o.name = 'none_of_these' AS is_none
FROM o LEFT JOIN f ON f.doc_id = o.doc_id AND f.canonical = o.name LEFT JOIN nm ON nm.canonical = o.name""")  # fmt: skip
def viewer_candidates(read, spark):
    """The options of every document in the order of first mention."""
    options = read("documents").select("doc_id", F.explode(F.array(*[F.lit(c) for c in [*CANDIDATES, "Somebody"]])).alias("candidate"))
    firsts = entities.first_mentions(chunked(read), ROSTER)
    named = firsts.join(F.broadcast(entities.roster_table(spark, ROSTER).select("canonical", "names")), "canonical")
    return results.viewer_candidates(options, named).withColumn("names", F.array_join("names", ","))


@query("""WITH l AS (SELECT doc_id, bool_or(toxic = 1) AS mock, bool_or(toxic = 0) AS live FROM labels GROUP BY doc_id)
SELECT d.doc_id, d.source, coalesce(l.mock, false) AS mock_ledger, coalesce(l.live, false) AS real_ledger FROM documents d LEFT JOIN l USING (doc_id)""")
def book_catalogue(read, spark):
    """Documents, with what kinds of ledger (here: labels) exist for each."""
    return results.catalogue(read("documents").select("doc_id", "source"), read("labels").select("doc_id", (F.col("toxic") == 1).alias("mock")))


LONG = {"alibi_effect": ["established", "weakened", "none"], "contradicts_prior": ["yes", "no"], "culprit_revealed": ["yes", "no"]}


def _long_sql() -> str:
    parts = [mock("ch", "doc_id, t", "text", q, o, f"a_{q}") for q, o in LONG.items()]
    listed = [f"j_{q} AS (SELECT doc_id, t, '[' || string_agg('{{\"option\":\"' || option || '\",\"p4\":' || p4 || '}}', ',' ORDER BY pos) || ']' AS j, arg_min(option, (-p4, pos)) AS v, max(p4) AS top, max(p4) FILTER (option = 'yes') AS yes FROM a_{q} GROUP BY doc_id, t)" for q in [*LONG, "culprit"]]
    json = " || ',' || ".join(f"'\"{q}\":' || j_{q}.j" for q in sorted([*LONG, "culprit"]))
    joins = " ".join(f"JOIN j_{q} ON j_{q}.doc_id = cv.doc_id AND j_{q}.t = cv.t" for q in [*LONG, "culprit"])
    noul = ", ".join(f"(j_{q}.yes >= 5000)::VARCHAR AS q_{q}_value, j_{q}.yes >= 5000 AS q_{q}_bool, j_{q}.yes / 10000.0 AS q_{q}_prob" for q in ("contradicts_prior", "culprit_revealed"))
    return f"""{W}{CURVE}, {", ".join(parts)}, a_culprit AS (SELECT doc_id, t, pos, candidate AS option, p4 FROM cv), {", ".join(listed)}
SELECT cv.doc_id, cv.t, cv.candidate, cv.p4, cv.p4 / 10000.0 AS prob, cv.pos AS option_position, '{{' || {json} || '}}' AS inference_answers, j_alibi_effect.v AS q_alibi_effect_value, j_alibi_effect.v AS q_alibi_effect_option, j_alibi_effect.top / 10000.0 AS q_alibi_effect_prob, {noul} FROM cv {joins}"""


@query(_long_sql())
def long_answers(read, spark):
    """A row for each step and candidate with the typed answers of the battery; variants shown as text."""
    cast = F.array(*[F.struct(F.lit(c["canonical"]).alias("canonical")) for c in ROSTER])
    asks = chunked(read).select("doc_id", "t", F.col("text").alias("key"), F.col("text").alias("state")).withColumn("specs", scoring.specs_of(INFERENCE, cast))
    pairs = F.transform("specs", lambda s: F.struct(s["id"], scoring.mock_distribution(F.col("state"), s["id"], s["options"])))
    answered = asks.select("doc_id", "t", F.map_from_entries(pairs).alias("answers")).withColumn("distribution", F.element_at("answers", F.lit("culprit")))
    out = results.long_answers(answered, INFERENCE, ["doc_id"])
    return out.select(*[F.col(f.name).cast("string") if f.dataType.typeName() == "variant" else F.col(f.name) for f in out.schema.fields])


# ---- usage and prices ----
USAGE = "u AS (SELECT conv_id, role, (length(text) + 3) // 4 AS tokens, ((length(text) + 3) // 4) * 42 AS micro_cost, CASE WHEN turn % 4 <> 3 THEN 70 + length(text) % 431 END AS latency_ms, turn % 5 = 0 AS cached FROM conversations)"


def _usage(read) -> DataFrame:
    n = T.token_count(F.col("text"))
    return read("conversations").select("conv_id", "role", n.alias("tokens"), (n * 42).alias("micro_cost"), F.when(F.col("turn") % 4 != 3, 70 + F.length("text") % 431).cast("long").alias("latency_ms"), (F.col("turn") % 5 == 0).alias("cached"))


@query(f"WITH {USAGE} SELECT role, count(*) AS calls, sum(tokens)::BIGINT AS tokens, sum(micro_cost)::BIGINT AS micro_cost, sum(coalesce(latency_ms, 0))::BIGINT AS latency_ms, count(*) FILTER (cached) AS cached_calls, list_sort(list(latency_ms) FILTER (latency_ms IS NOT NULL))[count(latency_ms) // 2 + 1]::BIGINT AS latency_median_ms FROM u GROUP BY role")
def usage_totals(read, spark):
    return analytics.usage(_usage(read), "role").withColumn("latency_median_ms", F.col("latency_median_ms").cast("long"))


@query("SELECT user_id, list_sort(list(event_id))[count(*) // 2 + 1] AS upper_median FROM events GROUP BY user_id")
def upper_median(read, spark):
    return read("events").groupBy("user_id").agg(analytics.upper_median("event_id").cast("long").alias("upper_median"))


@query(f"WITH {USAGE}, t AS (SELECT sum(tokens)::BIGINT AS i, count(*) * 120 AS o FROM u), p(model, a, b) AS (VALUES " + ", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE)" for m, _, a, b in analytics.PRICES) + "), c AS (SELECT model, round(i / 1e6 * a + o / 1e6 * b, 6) AS cost FROM t, p) SELECT model, cost, row_number() OVER (ORDER BY cost, model) AS rank FROM c")
def model_cost_rank(read, spark):
    totals = _usage(read).agg(F.sum("tokens").alias("input_tokens"), (F.count(F.lit(1)) * 120).alias("output_tokens"))
    return analytics.price_usage(totals).select("model", "cost", F.row_number().over(Window.orderBy("cost", "model")).alias("rank"))


@query("SELECT user_id, event_id, (sum((length(props) + 3) // 4) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS running_tokens FROM events")
def running_cost(read, spark):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return read("events").select("user_id", "event_id", F.sum(T.token_count(F.col("props"))).over(w).alias("running_tokens"))


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS calls, sum((length(props) + 3) // 4)::BIGINT AS tokens, round(sum((length(props) + 3) // 4) * 0.042 / 1e6, 6) AS cost FROM events GROUP BY ALL""")
def windowed_cost(read, spark):
    """The batch twin of the streaming window query."""
    return live.windowed_cost(read("events"))


def _stream(read, spark) -> tuple[DataFrame, str]:
    """The events table as a stream of its files, and a folder for what comes of it."""
    events = read("events")
    files = events.inputFiles()
    folder, name = files[0].rsplit("/", 1)
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", name if len(files) == 1 else "*.parquet").parquet(folder)
    return stream, f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"


SUSPECTS = ["signup", "purchase", "click", "none_of_these"]


@query(f"""WITH p AS (SELECT user_id AS doc_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, event_type || ' ' || coalesce(props, '') AS text FROM events),
s AS (SELECT *, string_agg(text, chr(10) || chr(10)) OVER (PARTITION BY doc_id ORDER BY step) AS state FROM p), k AS (SELECT *, (length(state) + 3) // 4 + 5 AS tokens FROM s),
f AS (SELECT *, min(step) FILTER (tokens > 60) OVER (PARTITION BY doc_id) AS ends FROM k), g AS (SELECT doc_id, id, step, tokens, state FROM f WHERE tokens <= 60 AND (ends IS NULL OR step < ends)),
{mock("g", "doc_id, step", "state", "culprit", SUSPECTS)}
SELECT doc_id, step, id, 'step' AS kind, tokens, arg_min(option, (-p4, pos)) AS leader, max(p4) AS p4 FROM m GROUP BY doc_id, step, id, tokens
UNION ALL SELECT doc_id, step, id, 'warn', tokens, NULL, NULL FROM f WHERE step = ends""")
def live_solve(read, spark):
    """Live solving of each user's events until their text is too long to ask about; the SQL is its batch twin."""
    stream, root = _stream(read, spark)
    text = F.concat_ws(" ", "event_type", F.coalesce("props", F.lit("")))
    passages = stream.select(F.col("user_id").alias("doc_id"), F.col("ts").alias("at"), F.col("event_id").alias("id"), text.alias("text"))
    store, solved = Store(spark, f"{root}/out"), live.solve(passages, SUSPECTS, 60, 5)
    with live.keyed_state(spark):
        sink = solved.writeStream.foreachBatch(live.once(store, "steps", ["doc_id", "step"]))
        sink.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return store.read("steps", solved.schema)


@query("SELECT user_id, event_id, ts, (length(coalesce(props, '')) + 3) // 4 AS tokens, (sum((length(coalesce(props, '')) + 3) // 4) OVER w)::BIGINT AS running_tokens, round((sum((length(coalesce(props, '')) + 3) // 4) OVER w) * 0.042 / 1e6, 6) AS running_cost, (sum((length(coalesce(props, '')) + 3) // 4) OVER w) > 60 AS warned FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def stream_running_cost(read, spark):
    """Running cost over a stream of the events table, read as files once and drained."""
    stream, root = _stream(read, spark)
    q = live.running_cost(stream, 60).writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(live.RUNNING).parquet(f"{root}/out")
