"""Line dedup as an exact set-similarity join, in DataFrame functions alone.

A line is its set of distinct words. Words are ordered from rare to common by counts in a hashed table of fixed size. Of two
lines of n <= m words with similarity t or more, the longer shares one of its first m - ceil(t m) + 1 words with one of the
first n - ceil(2t / (1 + t) n) + 1 words of the shorter; those prefixes are joined. Length, position and signature filters
(parity bits: sets differ in at least as many words as their signatures in bits) work inside the join, so that little more
than similar pairs leaves it; those are verified on full sets. A line with an earlier partner goes.

Lines of one set are one class, represented by its first line. Before the join, lines are tried against the first line that
has the least or greatest hash of their prefix, if over GROUP lines have it, which finds most near copies of large groups; only lines still open are sought earlier partners, so a
group of n near copies gives about n pairs; lines of a size and word that over CROWD classes have are tried further. Prefixes are
joined in WAVES by word, so that only a share of them is on disk at once. A word that over LARGE classes have in their prefixes is
refined: similar lines also share a second word of prefixes that are one word longer, so such entries are joined by both words.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, broadcast_if_small, columns, conf, partitions
from .native import bloom_of, bloom_test, let, parted

PERCENT = 80
#: Slots of the table of word counts, which comes to the driver: words of a slot share its rarity.
SLOT_BITS = 16
#: Low bits of a word's hash in its key; the rarity of its slot is above them.
KEY_BITS = 48
#: Classes that share a key beyond which it is refined: up to there a pair costs less than the entries of more keys do. Words beyond
#: which a line has 128 parity bits, not 64.
LARGE, LONG = 16384, 96
#: Classes of one size that share a key, itself of more than COMMON, beyond which they are tried further, and the tries.
COMMON, CROWD, TRIES = 1024, 256, 12
#: Lines that share the least or greatest hash of their prefix beyond which they are tried: fewer give few pairs.
GROUP = 4
#: Entries of a partition, about, that are joined by hash.
HASHED = 250_000
#: Parts, by word, in which entries are joined.
WAVES = 2
NOTHING = -(1 << 62)
BLANKS = "\t\x0b\x0c\r"
PLACE = ["id", "line"]
ENTRY = ["tok", "step", "id", "line", "n", "pos", "s1", "s2", "open"]


def words(line: Column) -> Column:
    """Runs of anything but spaces, with empty strings between spaces in a row."""
    return F.split(line, " ")


def _spaced(text: Column) -> Column:
    odd = reduce(Column.__or__, [F.contains(text, F.lit(b)) for b in BLANKS])
    return F.when(odd, F.translate(text, BLANKS, " " * len(BLANKS))).otherwise(text)


def lines(docs: DataFrame) -> DataFrame:
    """id, line (number from 0), body of each line of id, text. Other ASCII white space becomes spaces."""
    return docs.select("id", _spaced(F.col("text")).alias("text")).select("id", F.posexplode(F.split("text", "\n")).alias("line", "body"))


def _shift(way: str, value: Column | int, by: Column | int) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.call_function(way, lit(value).cast("long"), lit(by).cast("int"))


def word_ranks(source: DataFrame) -> Column:
    """Array by slot: how common its words are, as 500 times the logarithm of their count over all texts (under 2^15), above the
    low bits, where it is exclusive-ored with the slot."""
    slot = _shift("shiftrightunsigned", F.xxhash64("w"), 64 - SLOT_BITS).cast("int").alias("slot")
    spaced = source.select(F.replace(_spaced(F.col("text")), F.lit("\n"), F.lit(" ")).alias("text"))
    counts = spaced.select(F.explode(words(F.col("text"))).alias("w")).groupBy(slot).agg(F.count(F.lit(1)).alias("n"))
    found = {r["slot"]: round(500 * math.log2(r["n"] + 1)) for r in counts.collect()}  # 2^SLOT_BITS rows at most
    high = [found.get(k, 0) ^ k for k in range(1 << SLOT_BITS)]
    return F.split(F.lit(",".join(str((x - (x >> 15 << 16)) << KEY_BITS) for x in high)), ",").cast("array<bigint>")


def word_set(line: Column) -> Column:
    """Hashes of the distinct words of a line."""
    return F.array_distinct(F.array_remove(F.transform(words(line), lambda w: F.xxhash64(w)), F.xxhash64(F.lit(""))))


def word_keys(line: Column, ranks: Column) -> Column:
    """Sorted distinct keys, rare words first: rarity above the low bits of the hash, as ranks puts it in place of the slot."""
    zero = F.lit(0).cast("long")  # no nulls: such arrays are sorted fast
    slot = lambda h: _shift("shiftrightunsigned", h, 64 - SLOT_BITS).cast("int")
    key = lambda h: h.bitwiseXOR(F.coalesce(F.get(ranks, slot(h)), zero))
    hashes = F.transform(words(line), lambda w: F.xxhash64(w))
    return F.sort_array(F.array_distinct(F.array_remove(F.transform(hashes, key), key(F.xxhash64(F.lit(""))))))


def _ceil(a: Column, b: int) -> Column:
    return F.call_function("div", a + (b - 1), F.lit(b)).cast("int")


def probe_prefix(n: Column, percent: int) -> Column:
    return n - _ceil(n * percent, 100) + 1


def index_prefix(n: Column, percent: int) -> Column:
    return n - _ceil(n * 2 * percent, 100 + percent) + 1


def _times(value: Column, by: int) -> Column:
    return value * F.lit(by).cast("long")


def enough(shared: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether sets of n and m words that share so many reach the similarity; products alone, as it is asked of every pair of entries."""
    return _times(shared, 100 + percent) >= _times(n + m, percent)


def not_too_far(apart: Column, n: Column, m: Column, percent: int) -> Column:
    """The same of sets that differ in so many words: of n + m less those, half are shared."""
    return _times(apart, 100 + percent) <= _times(n + m, 100 - percent)


def _parity(keys: Column, half: bool) -> Column:
    """64 parity bits over the keys, or those whose seventh bit is 1: each flips the bit that its lowest 6 bits name."""
    one = lambda x: _shift("shiftrightunsigned", x, 6).bitwiseAND(F.lit(1)) if half else 1
    flip = lambda x: _shift("shiftleft", one(x), x.bitwiseAND(F.lit(63)))
    return F.aggregate(keys, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(flip(x)))


def _near(percent: int) -> Column:
    """Whether sets of n and a_n words with signatures s1, s2 and a_s1, a_s2 can be similar, by length and signature."""
    c = F.col
    fold = lambda x, y: F.bit_count(c(f"a_{x}").bitwiseXOR(c(y)))
    whole = F.bit_count(c("a_s1").bitwiseXOR(c("a_s2")).bitwiseXOR(c("s1")).bitwiseXOR(c("s2")))
    apart = F.when((c("n") > LONG) & (c("a_n") > LONG), fold("s1", "s1") + fold("s2", "s2")).otherwise(whole)
    return (c("n") * percent <= c("a_n") * 100) & (c("a_n") * percent <= c("n") * 100) & not_too_far(apart, c("a_n"), c("n"), percent)


def _place_number(line: Column | int) -> Column:
    """id and line as one number in the order of places."""
    line = line if isinstance(line, Column) else F.lit(line)
    return F.col("id").cast("decimal(19)") * F.lit(1 << 31).cast("decimal(10)") + line


def first_places(marked: DataFrame, keys: list[str]) -> DataFrame:
    """The first place of each group. It is the least of one number: with least structs, Spark would sort all rows by their keys."""
    one = marked.groupBy(*keys).agg(F.min("id").alias("id"), F.min(_place_number(F.col("line"))).alias("at"))
    return one.select("id", (F.col("at") - _place_number(0)).cast("int").alias("line"), *keys)


def classes_of(source: DataFrame, percent: int, smallest: int) -> DataFrame:
    """One row for each distinct set of words: its first place, size, signature and extended prefix (none if under smallest)."""
    ranks = word_ranks(source)
    filled = lines(source).where(F.ltrim("body", F.lit(" ")) != "")
    keyed = filled.select(*PLACE, word_keys(F.col("body"), ranks).alias("ks")).withColumn("n", F.size("ks"))
    large, zero = F.col("n") >= smallest, F.lit(0).cast("long")
    marked = keyed.select(
        *PLACE, "n", F.xxhash64("ks").alias("c1"), F.xxhash64(F.lit(7), "ks").alias("c2"),
        F.when(large, _parity(F.col("ks"), False)).otherwise(zero).alias("s1"), F.when(F.col("n") > LONG, _parity(F.col("ks"), True)).otherwise(zero).alias("s2"),
        F.when(large, F.slice("ks", 1, probe_prefix(F.col("n"), percent) + 1)).otherwise(F.array().cast("array<bigint>")).alias("prefix"),
    )
    one = first_places(marked, ["c1", "c2", "n", "s1", "s2", "prefix"])  # what else a class has follows from its words
    hashes = F.transform("prefix", lambda x: x.bitwiseAND(F.lit((1 << KEY_BITS) - 1)))
    mixed = one.select(*PLACE, "n", F.col("s1").bitwiseXOR(F.col("s2")).alias("s1"), "s2", "prefix", hashes.alias("hashes"))
    return mixed.select(*PLACE, "n", "s1", "s2", F.array_min("hashes").alias("least"), F.array_max("hashes").alias("greatest"), "prefix")


def _before(x: str, y: str) -> Column:
    """Whether one place is earlier than another, by prefixes of their columns; cheaper in a join than structs are."""
    c = F.col
    return (c(f"{x}id") < c(f"{y}id")) | ((c(f"{x}id") == c(f"{y}id")) & (c(f"{x}line") < c(f"{y}line")))


def _tries(lines_: DataFrame, hashes: list[Column | str], percent: int) -> DataFrame:
    """Each open line with the first line that has the same of one of hashes (null: none), where they can be similar."""
    rows = lines_.select(*PLACE, "n", "s1", "s2", "open", F.explode(F.array(*hashes)).alias("key")).where("key IS NOT NULL")
    lead = rows.groupBy("key").agg(F.min(F.struct(*PLACE, "n", "s1", "s2")).alias("a"), F.count(F.lit(1)).alias("many")).where("many > 1")
    led = rows.where("open").join(lead, "key").select("*", *[F.col(f"a.{c}").alias(f"a_{c}") for c in (*PLACE, "n", "s1", "s2")])
    return led.where(_before("a_", "") & _near(percent)).select(*PLACE, "a_id", "a_line").distinct()


def _first_tries(classes: DataFrame, scratch: Scratch, percent: int) -> DataFrame | None:
    """Lines by the least and greatest hash of their prefix, of those hashes that more than GROUP lines have; none if there are none."""
    both = ["least", "greatest"]
    shared = classes.where("least IS NOT NULL").select(F.explode(F.array(*both)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("many"))
    shared = scratch.cut(shared.where(F.col("many") > GROUP).select("key"), "groups")
    if not shared.limit(1).count():
        return None
    bloom, blocks = bloom_of(shared, scratch, "groups-bloom")
    own = lambda x: F.when(bloom_test(bloom, F.col(x), blocks), F.col(x))
    rows = classes.where("least IS NOT NULL").select(*PLACE, "n", "s1", "s2", F.lit(True).alias("open"), *[own(x).alias(x) for x in both])
    return _tries(rows.where("least IS NOT NULL OR greatest IS NOT NULL"), both, percent)


def _more_tries(lines_: DataFrame, percent: int) -> DataFrame:
    """Lines of crowds by TRIES other least hashes of their prefix, or pairs of such."""
    mixed = lambda k: F.array_min(F.transform("prefix", lambda x: F.xxhash64(F.lit(k), x)))
    return _tries(lines_, [F.xxhash64(F.lit(k), mixed(2 * k), mixed(2 * k + 1)) if k % 2 else mixed(2 * k) for k in range(TRIES)], percent)


def _pairs(index: DataFrame, probe: DataFrame, percent: int, shared: int, hashed: bool = False) -> DataFrame:
    """Places of later open lines with those of earlier ones, from entries whose shared-th common word, at pos, made the key.
    hashed: a partition's entries fit in memory.

    The step of the lengths' logarithm is part of the key: lines of similar length are in one step or in neighbouring ones.
    """
    c = F.col
    steps = F.when(c("pos") < index_prefix(c("n"), percent) + (shared - 1), F.array("step", c("step") + 1)).otherwise(F.array().cast("array<int>"))
    a = index.withColumn("step", F.explode(steps)).withColumnsRenamed({x: f"a_{x}" for x in ENTRY})
    earlier, later = _before("a_", ""), _before("", "a_")
    a = a.hint("shuffle_hash") if hashed else a
    fits = enough(F.least(c("a_n") - c("a_pos"), c("n") - c("pos")) + (shared - 1), c("a_n"), c("n"), percent)
    wanted = (earlier & c("open")) | ((c("a_n") < c("n")) & later & c("a_open"))
    found = a.join(probe, (c("a_tok") == c("tok")) & (c("a_step") == c("step")) & (c("a_n") <= c("n")) & fits & _near(percent) & wanted)
    first = lambda x, y: F.when(earlier, c(x)).otherwise(c(y))
    return found.select(first("id", "a_id").alias("id"), first("line", "a_line").alias("line"), first("a_id", "id").alias("a_id"), first("a_line", "line").alias("a_line"))


def _entries(classes: DataFrame, known: DataFrame, scratch: Scratch, name: str, percent: int, smallest: int) -> DataFrame:
    """Prefixes by word, with the whole prefix. Lines that are known to go are not open."""
    marks = known.withColumn("known", F.lit(True))
    open_ = F.col("known").isNull().alias("open")
    filled = classes.where(F.col("n") >= smallest)
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        marked = filled.join(F.broadcast(marks), PLACE, "left").select(*classes.columns, open_)
    else:
        maybe, rest = parted(filled, PLACE, known, scratch, f"{name}-known")
        marked = maybe.join(marks, PLACE, "left").select(*classes.columns, open_).union(rest.select(*classes.columns, F.lit(True)))
    step = F.coalesce(F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent + 0.01)).cast("int"), F.lit(0)).alias("step")
    return marked.select(*PLACE, "n", "s1", "s2", step, "open", "prefix", F.posexplode(F.slice("prefix", 1, probe_prefix(F.col("n"), percent))).alias("pos", "tok"))


def _hot_keys(entries: DataFrame, least: int, scratch: Scratch, name: str) -> tuple[DataFrame | None, int]:
    """Keys of more than least entries, if any, and how many entries there are. Only keys in slots of more than least entries are counted one by one."""
    slot = F.col("tok").bitwiseAND(F.lit((1 << SLOT_BITS) - 1)).cast("int").alias("slot")
    slots = scratch.cut(entries.groupBy(slot).agg(F.count(F.lit(1)).alias("size")), f"{name}-slots")  # 2^SLOT_BITS rows at most
    many, most = slots.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    if most <= least:
        return None, many
    slots = slots.where(F.col("size") > least).select("slot")
    keys = entries.select("tok", slot).join(F.broadcast(slots), "slot", "left_semi").groupBy("tok").agg(F.count(F.lit(1)).alias("size"))
    keys = scratch.cut(keys.where(F.col("size") > least), name)
    return keys if keys.limit(1).count() else None, many


def _crowds(entries: DataFrame, hot: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Lines of one size and word with more than CROWD classes, if any: a word is common over all sizes, near copies are of a size."""
    own = entries.join(broadcast_if_small(hot.select("tok")), "tok", "left_semi")
    crowds = scratch.cut(own.groupBy("tok", "n").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > CROWD).select("tok", "n"), "crowds")
    if not crowds.limit(1).count():
        return None
    return own.join(broadcast_if_small(crowds), ["tok", "n"], "left_semi").select(*PLACE, "n", "s1", "s2", "open", "prefix").dropDuplicates(PLACE)


def _candidates(entries: DataFrame, many: int, hot: DataFrame | None, scratch: Scratch, percent: int) -> DataFrame:
    """Pairs by keys of up to LARGE entries, of many in all, and by two words for other keys."""
    if hot is None:
        return _waves(entries, scratch, "one", percent, 1, many)
    hot = broadcast_if_small(hot.select("tok"))
    one = _waves(entries.join(hot, "tok", "left_anti"), scratch, "one", percent, 1, many)
    refined = _refined(entries.join(hot, "tok", "left_semi"))
    bloom, blocks = bloom_of(refined.where("open").select(F.col("tok").alias("key")), scratch, "refined-bloom")
    return one.union(_waves(refined.where(bloom_test(bloom, F.col("tok"), blocks)), scratch, "two", percent, 2))


def _waves(entries: DataFrame, scratch: Scratch, name: str, percent: int, shared: int, many: int | None = None) -> DataFrame:
    """Pairs of entries, in WAVES by key: the exchange of one is gone before the next is made. If it is known how many entries there are, partitions
    are small enough to be hashed; otherwise they are sorted."""
    settings = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate"}
    parts = []
    for k in range(WAVES):
        own = F.pmod(_shift("shiftright", F.col("tok"), 20), F.lit(WAVES).cast("long")) == k
        parts_ = [] if many is None else [max(partitions(scratch.spark), -(-many // (WAVES * HASHED)))]
        dealt = entries.where(own).select(*ENTRY).repartition(*parts_, "tok")  # the key has the step too; it need not be dealt by that
        with conf(scratch.spark, settings):  # without a filter below it, one exchange serves both sides
            parts.append(scratch.cut(_pairs(dealt, dealt, percent, shared, many is not None), f"pairs-{name}-{k}"))
    return reduce(DataFrame.union, parts)


def _refined(large: DataFrame) -> DataFrame:
    """Entries by two words: the one that made the entry, and each later one of the extended prefix."""
    both = large.select("*", F.posexplode("prefix").alias("at", "second")).where("at > pos")
    return both.select(F.xxhash64("tok", "second").alias("tok"), "step", *PLACE, "n", F.col("at").alias("pos"), "s1", "s2", "open")


def _confirmed(pairs: DataFrame, source: DataFrame, scratch: Scratch, name: str, percent: int) -> DataFrame:
    """Places of lines whose set is similar to that of their earlier partner.

    A Bloom filter of the documents and places of pairs spares most other lines the exchange.
    """
    places = scratch.cut(pairs.select(*PLACE).union(pairs.select("a_id", "a_line")).distinct(), f"{name}-places")
    key = lambda line: F.xxhash64("id", line)
    bloom, blocks = bloom_of(places.select(F.explode(F.array(key(F.lit(-1)), key(F.col("line")))).alias("key")), scratch, f"{name}-bloom")
    maybe = lines(source.where(bloom_test(bloom, key(F.lit(-1)), blocks))).where(bloom_test(bloom, key(F.col("line")), blocks))
    sets = scratch.cut(maybe.join(places, PLACE, "left_semi").select(*PLACE, word_set(F.col("body")).alias("ws")), f"{name}-sets")
    earlier = sets.select(F.col("id").alias("a_id"), F.col("line").alias("a_line"), F.col("ws").alias("a_ws"))
    both = pairs.join(sets, PLACE).join(earlier, ["a_id", "a_line"])
    same = F.size(F.array_intersect("ws", "a_ws"))
    gone = scratch.cut(both.where(same * (100 + percent) >= (F.size("ws") + F.size("a_ws")) * percent).select(*PLACE).distinct(), f"{name}-gone")
    for own in ("places", "bloom", "sets"):
        scratch.drop(f"{name}-{own}")
    return gone


def line_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The places (id, line) that stay: of lines with words, the first of each set that has no earlier partner.

    Lines are what \\n splits, numbered from 0; earlier means a smaller (id, line), null ids (here NOTHING) first. Partners are
    judged on the input. Null or empty texts have no lines with words. Lines at one place of rows that repeat an id stay or
    go together.
    """
    scratch = Scratch(docs.sparkSession)
    smallest = next(m for m in range(1, 200) if 100 * m >= percent * (m + 1))  # smaller sets are only similar to themselves
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NOTHING)).alias("id"), F.col(text_col).alias("text"))
    classes = scratch.cut(classes_of(source, percent, smallest), "classes")
    tries, none = _first_tries(classes, scratch, percent), scratch.spark.createDataFrame([], classes.select(*PLACE).schema)
    tried = none if tries is None else _confirmed(scratch.cut(tries, "tries"), source, scratch, "tries", percent)
    entries = _entries(classes, tried, scratch, "tried", percent, smallest)
    (hot, many), known = _hot_keys(entries, min(COMMON, LARGE), scratch, "common"), tried
    crowd = None if hot is None else _crowds(entries, hot, scratch)
    if crowd is not None:
        known = scratch.cut(tried.union(_confirmed(scratch.cut(_more_tries(scratch.cut(crowd, "crowd"), percent), "more-tries"), source, scratch, "more", percent)).distinct(), "known")
        entries = _entries(classes, known, scratch, "more", percent, smallest)
    hot = hot and hot.where(F.col("size") > LARGE)
    found = _candidates(entries, many, hot if hot and hot.limit(1).count() else None, scratch, percent)
    gone = known.union(_confirmed(scratch.cut(found.distinct(), "pairs"), source, scratch, "pairs", percent))
    stay = scratch.cut(classes.select(*PLACE).join(gone.distinct(), PLACE, "left_anti"), "stay")
    scratch.keep("stay")
    return stay


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Every input row with n_lines, n_removed and kept (the text without later matches, its other lines as they were).

    Lines without words always stay. Null text counts as empty: one line without words. All columns of the input stay, but
    those named like the three new ones give way.
    """
    scratch, places = Scratch(docs.sparkSession), line_duplicates(docs, id_col, text_col, percent)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NOTHING)).alias("of"), F.coalesce(F.col(text_col), F.lit("")).alias("body"), F.struct(*columns(docs)).alias("row"))
    blank = lambda x: F.ltrim(x, F.lit(" " + BLANKS)) == ""
    each = rows.select("of", F.posexplode(F.split("body", "\n")).alias("line", "body"))
    counts = each.groupBy("of").agg(F.count_if(F.col("line") == 0).alias("rows"), F.count_if(~blank(F.col("body"))).alias("n")).join(places.groupBy(F.col("id").alias("of")).agg(F.count(F.lit(1)).alias("k")), "of", "left")
    touched = scratch.cut(counts.where((F.col("rows") > 1) | (F.col("n") != F.coalesce("k", F.lit(0)))).select("of"), "touched")
    # Texts that lose no line are not shuffled.
    maybe, whole = parted(rows, ["of"], touched, scratch, "touched-bloom")
    stay = touched.join(places, F.col("of") == F.col("id"), "left").groupBy(F.col("of").alias("id")).agg(F.collect_set("line").alias("stay"))
    same = whole.select("row", F.size(F.split("body", "\n")).alias("n"), F.col("body").alias("kept")).select("row", F.struct("n", F.col("n").alias("k"), "kept").alias("r"))
    joined = maybe.join(stay, F.col("of") == F.col("id"), "left").withColumn("loses", F.col("id").isNotNull()).withColumn("stay", F.coalesce("stay", F.array().cast("array<int>")))
    every = lambda ls: F.sequence(F.lit(0), F.size(ls) - 1)
    kept = lambda ls: F.array_sort(F.array_union(F.array_intersect(every(ls), F.col("stay")), F.filter(every(ls), lambda i: ~F.col("loses") | blank(F.get(ls, i)))))
    out = joined.select("row", let(F.split("body", "\n"), lambda ls: let(kept(ls), lambda at: F.struct(F.size(ls).alias("n"), F.size(at).alias("k"), F.array_join(F.transform(at, lambda i: F.get(ls, i)), "\n").alias("kept")))).alias("r"))
    out = out.union(same)
    new = {"n_lines": F.col("r.n").cast("long"), "n_removed": (F.col("r.n") - F.col("r.k")).cast("long"), "kept": F.col("r.kept")}
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in new], *[v.alias(k) for k, v in new.items()])


REMOVE_LINES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(range(len(ls))) AS p, unnest(ls) AS line FROM d),
s AS (SELECT r, doc_id, p, line, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS ws FROM l),
c AS (SELECT ws, len(ws) AS n, min((doc_id, p)) AS pl, row_number() OVER () AS c FROM s WHERE len(ws) > 0 GROUP BY ws),
t AS (SELECT c, n, pl, unnest(ws) AS w FROM c WHERE n > 3),
o AS (SELECT a.c AS a, b.c AS b, count(*) AS k, any_value(a.n) + any_value(b.n) AS m FROM t a JOIN t b ON a.w = b.w AND a.pl > b.pl AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) GROUP BY a.c, b.c),
g AS (SELECT DISTINCT a FROM o WHERE 100 * k >= 80 * (m - k)),
x AS (SELECT s.r, s.p, s.line, len(s.ws) = 0 OR (c.pl = (s.doc_id, s.p) AND g.a IS NULL) AS stays FROM s LEFT JOIN c ON s.ws = c.ws LEFT JOIN g ON c.c = g.a)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (NOT stays) AS BIGINT) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (stays), '')) AS kept_sha256
FROM x JOIN d USING (r) GROUP BY r, doc_id
"""
