"""Column functions over text. All run in the JVM; white space and letters are named as explicit classes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ----
ABBREVIATIONS = "mr mrs ms messrs mme mlle dr st capt col gen lt sgt rev prof hon jr sr no vs etc esq inst ult viz cf vol ch fig p pp sq".split()
NOT_NAMES = (
    "The And But Then There This That What When Where Why How Who Yes Well Now Here Sir Madam Madame Monsieur Mademoiselle Miss Mrs Lady Lord God Heaven "
    "Inspector Captain Doctor Colonel Major Professor Mister Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August "
    "September October November December English England French London Christmas Street Road House Hall Court Chapter"
).split()
NUMBER_WORD = (
    r"(?:[ivxlc]+|[0-9]+|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|"
    r"twenty[a-z0-9_]*|thirty[a-z0-9_]*|forty[a-z0-9_]*|fifty[a-z0-9_]*|the\s+[a-z0-9_]+)"
)
HEADING = rf"(?i)^(?:chapter|book|part|volume)\s+{NUMBER_WORD}(?:[^a-z0-9_]|$)"
SECTION = r"(?i)^(?:prologue|epilogue|preface|contents|introduction|the end)[^a-z0-9_]*$"
ROMAN = r"^[IVXLC]+\.?$|^[IVXLC]+\.\s+\S"
QUOTES_FROM, QUOTES_TO = "‘’“”–—", "''\"\"--"
# ---- end of fixed values ----

CLOSERS = "[\"'”’)\\]]*"
SENTENCE_END = rf"[.!?]{CLOSERS}$"
#: What a word that ends a sentence may end in: a terminator, a closer, or a line end that $ looks past. Spares other words the pattern.
LAST = ".!?\"'”’)]\u0085\u2028\u2029"
ABBREVIATED = rf"(?:^|[^A-Za-z])(?:(?i:{'|'.join(ABBREVIATIONS)})|[A-Z])\.{CLOSERS}$"
SPACES = r"[ \t\n\x0B\f\r ]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over value, computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clean(text: Column) -> Column:
    """Runs of white space (no-break spaces too) as one space, trimmed."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(tokens(text))


def token_count(text: Column) -> Column:
    """Additive stand-in for a model's tokenizer: a token for every four characters, rounded up."""
    return F.ceil(F.length(text) / 4.0).cast("long")


def slug(text: Column, mark: str = "-", most: int = 40) -> Column:
    return F.trim(F.substring(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", mark), F.lit(mark)), 1, most), F.lit(mark))


def normalised(text: Column) -> Column:
    return F.lower(clean(F.translate(text, QUOTES_FROM, QUOTES_TO)))


def text_hash(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def is_heading(text: Column) -> Column:
    """At most 12 words; a numbered or named heading that doesn't end as speech, or all capitals without a sentence's end."""
    named = F.rlike(text, F.lit(HEADING)) | F.rlike(text, F.lit(SECTION)) | F.rlike(text, F.lit(ROMAN))
    speech = F.rlike(text, F.lit("[!?\"”]$"))
    capitals = (F.regexp_count(text, F.lit(r"\p{L}")) >= 3) & (F.regexp_count(text, F.lit(r"\p{L}")) == F.regexp_count(text, F.lit(r"\p{Lu}")))
    short = word_count(text).between(1, 12)
    return short & F.when(named, ~speech).otherwise(capitals & ~F.rlike(text, F.lit('[.!?"]$')))


def is_chapter_start(text: Column) -> Column:
    return F.rlike(text, F.lit(HEADING)) | F.rlike(text, F.lit(ROMAN))


def sentence_texts(text: Column) -> Column:
    """The sentences of a text, cleaned: a terminator ends one if what follows doesn't begin in lower case and the terminator isn't a lone
    dot after an abbreviation or an initial."""

    def split(ws: Column) -> Column:
        n = F.size(ws)
        ends = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda i: (i == n - 1) | (F.contains(F.lit(LAST), F.substring(F.get(ws, i), -1, 1)) & F.rlike(F.get(ws, i), F.lit(SENTENCE_END)) & ~F.rlike(F.get(ws, i + 1), F.lit(r"^\p{Ll}")) & ~F.rlike(F.get(ws, i), F.lit(ABBREVIATED))),
        )
        first = lambda es, j: F.when(j == 0, 0).otherwise(F.get(es, j - 1) + 1)
        return let(ends, lambda es: F.transform(es, lambda e, j: F.array_join(F.slice(ws, first(es, j) + 1, e - first(es, j) + 1), " ")))

    return let(tokens(text), lambda ws: F.when(F.size(ws) > 0, split(ws)).otherwise(F.array().cast("array<string>")))


def sentences(text: Column) -> Column:
    """Array of (text, start, end) over the cleaned text: sentence_texts, with offsets by running length in one pass."""
    kind = "array<struct<text:string,start:int,end:int>>"
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    add = lambda a, x: F.struct((a["at"] + F.length(x) + 1).alias("at"), F.array_append(a["out"], F.struct(x.alias("text"), a["at"].alias("start"), (a["at"] + F.length(x)).alias("end"))).alias("out"))
    return F.aggregate(sentence_texts(text), begin, add, lambda a: a["out"])


def name_words(sentence: Column) -> Column:
    """Capitalised words of a sentence but its first word."""
    return let(
        F.filter(F.split(sentence, r"[^\p{L}\p{N}_]+"), lambda w: w != ""),
        lambda ws: F.filter(F.slice(ws, 2, F.greatest(F.size(ws), F.lit(1))), lambda w: F.rlike(w, F.lit("^[A-Z][a-z]{2,}$"))),
    )


def alias_pattern(names: list[str]) -> str:
    """A boolean pattern for any of the names as whole words, longest first, without look-around."""
    escaped = "|".join("".join("\\" + c if c in r".^$*+?()[]{}|\\" else c for c in n) for n in sorted(names, key=len, reverse=True))
    return rf"(?:^|[^\p{{L}}\p{{N}}_])(?:{escaped})(?:$|[^\p{{L}}\p{{N}}_])"


def show_probability(p: Column) -> Column:
    """Two decimals without the leading zero, ? for null, 1.0 from 1 on."""
    return F.when(p.isNull(), "?").when(p >= 1, "1.0").otherwise(F.ltrim(F.call_function("format_number", p, F.lit("0.00")), F.lit("0")))


def pseudo_random(key: Column) -> Column:
    """24 bits of a hash of key, the same in any engine with SHA-256."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 6), 16, 10).cast("long")
