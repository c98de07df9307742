import random
import time
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliate.llm import bpe, chat, decontaminate, html, language, line_dedup, native, near_dup, quality, substring, url_filter
from foliate.llm.queries import tokenizer

from . import brute

R = random.Random(11)
WORDS = [a + b for a in "abcdefg" for b in "xyz"] + ["Été", "naïve", "A", "ß"]


def prose(n, words=WORDS):
    return " ".join(R.choice(words) for _ in range(n))


def corpus():
    """Ids with nulls in text, empty and blank texts, copies, shared passages, ties and a very long text."""
    shared, base = prose(40), prose(80)
    rows = [(i, prose(R.randint(1, 120))) for i in range(1, 30)]
    rows += [(30, None), (31, ""), (32, " \t\n "), (33, base), (34, base), (35, base + " x"), (36, prose(20) + " " + shared + "\n" + prose(9)), (37, shared + " " + prose(30)), (38, prose(6000)), (39, "a"), (40, "a"), (41, "A b")]
    rows += [(42, base.replace(" ", "\n", 9)), (43, (shared + "\n") * 3)]
    return rows


DOCS = corpus()
CLASH = "doc_id long, text string, n_words string, kept string, id string, cell int, hits string, x string, key string, lang string, source string"


def frame(spark, rows):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "w", "k", "i", 1, "h", "x", "y", "en", "s") for i, t in rows], CLASH).repartition(3)


def same(df, want, columns):
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got == sorted(want, key=repr)


def test_substring(spark):
    rows = [*DOCS, (7, DOCS[32][1]), (None, DOCS[32][1]), (33, DOCS[32][1])]
    same(substring.remove_repeats(frame(spark, rows)), brute.substring(rows), ["doc_id", "n_words", "n_removed", "kept"])
    assert substring.remove_repeats(frame(spark, rows).where("false")).count() == 0


def test_substring_random(spark):
    """Few words, so windows overlap in every way."""
    rows = [(i, prose(R.randint(10, 60), ["a", "b"])) for i in range(60)]
    same(substring.remove_repeats(frame(spark, rows)), brute.substring(rows), ["doc_id", "n_words", "n_removed", "kept"])


def test_packing():
    for kind in (np.uint64, np.int64):
        x = np.sort(np.random.default_rng(3).integers(0, 2**62, 5000).astype(kind))
        assert (substring.unpack(substring.pack(x), len(x), kind) == x).all()


def test_decontaminate(spark):
    items = [(1, " ".join(DOCS[35][1].split()[22:40])), (2, DOCS[2][1]), (2, "A B"), (3, None), (4, "..."), (None, "a"), (5, prose(10)), (6, prose(9))]
    docs = [*DOCS, (50, "x A, b! y"), (None, DOCS[35][1])]
    bench = spark.createDataFrame([(i, t, "d") for i, t in items], "item_id long, text string, doc_id string")
    out = decontaminate.decontaminate(frame(spark, docs), bench).withColumn("ids", F.array_join("item_ids", ","))
    same(out, brute.decontaminate(docs, items), ["doc_id", "n_words", "n_hit", "n_items", "ids", "contaminated"])
    assert decontaminate.decontaminate(frame(spark, docs), bench.where("false")).where("contaminated").count() == 0
    assert decontaminate.decontaminate(frame(spark, docs).where("false"), bench).count() == 0


def test_decontaminate_random(spark):
    docs = [(i, prose(R.randint(5, 40), ["a", "b"])) for i in range(40)]
    items = [(i, prose(R.randint(1, 16), ["a", "b"])) for i in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.decontaminate(frame(spark, docs), bench).withColumn("ids", F.array_join("item_ids", ","))
    same(out, brute.decontaminate(docs, items), ["doc_id", "n_words", "n_hit", "n_items", "ids", "contaminated"])


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, percent):
    base = [prose(60) for _ in range(3)]

    def edit(t, n):
        w = t.split()
        for _ in range(n):
            w[R.randrange(len(w))] = R.choice(WORDS)
        return " ".join(w)

    rows = [*DOCS, *((100 + i, edit(base[i % 3], R.randint(0, 4))) for i in range(150))]
    want = brute.near(rows, k, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(frame(spark, rows), k=k, percent=percent).collect()}
    wrong = [i for i in want if got[i] != want[i]]
    assert len(wrong) == 0
    assert near_dup.near_duplicates(frame(spark, rows).where("false")).count() == 0


def test_near_duplicates_odd_rows(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, None), (4, None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(None, None, True), (3, None, False), (3, None, False), (4, 4, True), (4, 4, True)], key=repr)


def test_index_keys_hold_every_pair_in_reach():
    """Signatures that differ in up to DISTANCE symbols, however placed, share a key."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        a = rng.integers(0, 2**16, (1, near_dup.SYMBOLS)).astype(np.uint16)
        b = a.copy()
        at = rng.choice(near_dup.SYMBOLS, near_dup.DISTANCE, replace=False)
        b[0, at] ^= 1
        assert np.intersect1d(near_dup.index_keys(a), near_dup.index_keys(b)).size


def test_large_groups_are_compared_by_blocks(spark):
    """Texts that share some keys and not others are linked as brute force links them, whatever the block."""
    from foliate.llm.common import Scratch

    base = prose(50, [f"v{i}" for i in range(400)]).split()
    texts = []
    for i in range(60):
        own = list(base)
        for _ in range(R.randint(0, 3)):
            own[R.randrange(50)] = f"u{R.randrange(400)}"
        texts.append((i, " ".join(own)))
    store = spark.createDataFrame(texts, "x long, text string")
    sets, _ = near_dup.shingle_sets(__import__("pyarrow").array([t for _, t in texts]), 3)
    keys = near_dup.index_keys(near_dup.signatures(sets))
    rows = [(int(keys[i, c]), i, i, 60) for i in range(60) for c in range(keys.shape[1])]
    members = spark.createDataFrame(rows, "key long, x long, comp long, size long")
    want = {i: c for i, (_, c) in brute.near(texts, 3, 85).items()}
    for size in (7, 600):
        old, near_dup.BLOCK = near_dup.BLOCK, size
        try:
            links = near_dup._large(members, store, 3, 85)
            comps = {r.x: r.comp for r in near_dup.components(links, Scratch(spark), "t").collect()}
        finally:
            near_dup.BLOCK = old
        assert {i: comps.get(i, i) for i in want} == want


def test_lines(spark):
    w = [f"w{i}" for i in range(30)]
    texts = []
    for i in range(40):
        own = []
        for _ in range(R.randint(1, 6)):
            line = R.sample(w[:15], R.randint(1, 9)) if R.random() < 0.7 else w[:12] + R.sample(w[12:], R.randint(0, 3))
            own.append(" ".join(line))
        texts.append("\n".join(own))
    rows = [*enumerate(texts), (50, None), (51, ""), (52, "\n \n"), (None, texts[3]), (53, texts[3] + "\n\n" + texts[4])]
    out = line_dedup.remove_lines(frame(spark, rows).select("doc_id", "text", "lang"))
    same(out, brute.lines(rows), ["doc_id", "n_lines", "n_removed", "kept"])
    assert line_dedup.remove_lines(frame(spark, rows).select("doc_id", "text").where("false")).count() == 0


@pytest.mark.parametrize("large", [4, 512])
def test_lines_in_large_groups(spark, monkeypatch, large):
    """Many variants of two lines, some similar to the first of their group and some only to others: keys refined, groups
    thinned out, and neither."""
    monkeypatch.setattr(line_dedup, "LARGE", large)
    base = [[f"{c}{i}" for i in range(20)] for c in "pq"]
    rows = []
    for i in range(90):
        own = list(base[i % 2])
        for _ in range(R.randint(0, 3)):
            own[R.randrange(20)] = f"z{R.randrange(400)}"
        rows.append((i, " ".join(own) + "\n" + " ".join(R.sample(base[0], 4))))
    long_ = [f"l{i}" for i in range(140)]
    for i in range(90, 110):  # the longer signatures, and pairs of both kinds
        rows.append((i, " ".join(long_[: R.randint(85, 120)] + [f"y{R.randrange(99)}" for _ in range(R.randint(0, 20))])))
    out = line_dedup.remove_lines(frame(spark, rows).select("doc_id", "text"))
    same(out, brute.lines(rows), ["doc_id", "n_lines", "n_removed", "kept"])


def test_lines_in_crowds(spark, monkeypatch):
    """Near copies of one size, tried further before they are joined."""
    monkeypatch.setattr(line_dedup, "COMMON", 8)
    monkeypatch.setattr(line_dedup, "CROWD", 4)
    base = [f"p{i}" for i in range(20)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(R.randint(0, 5)):
            own[R.randrange(20)] = f"z{R.randrange(400)}"
        rows.append((i, " ".join(own)))
    out = line_dedup.remove_lines(frame(spark, rows).select("doc_id", "text"))
    same(out, brute.lines(rows), ["doc_id", "n_lines", "n_removed", "kept"])


def test_classes_are_hashed_not_sorted(spark):
    """First places of any ids, and of lines of one id; rows are not sorted for them."""
    rows = [(i, n, k) for k in "ab" for i in (-(1 << 63), -5, 0, 7, (1 << 63) - 1) for n in (0, 3, (1 << 31) - 1)]
    for least in range(0, len(rows) // 2, 4):
        own = [r for r in rows if r[0] >= rows[least][0] and r[:2] >= rows[least][:2]]
        found = line_dedup.first_places(spark.createDataFrame(own[::-1], "id long, line int, key string").withColumn("key", F.array("key")), ["key"])
        assert {(r.id, r.line, r.key[0]) for r in found.collect()} == {(*rows[least][:2], k) for k in "ab"}
    classes = line_dedup.classes_of(frame(spark, [(1, "a b c d e f")]).select(F.col("doc_id").alias("id"), "text"), 80, 4)
    assert "SortAggregate" not in classes._jdf.queryExecution().executedPlan().toString()


def test_lines_of_small_groups_are_not_tried(spark, monkeypatch):
    """Only hashes that more than GROUP lines have lead to tries, and entries whose number is known are joined by hash."""
    w = [f"w{k}" for k in range(40)]
    rows = [(g * 100 + k, " ".join(f"{g}{x}" for x in [*w[:20], w[20 + k]])) for g, many in ((1, 3), (2, 9)) for k in range(many)]
    docs = frame(spark, rows).select("doc_id", "text")
    source = docs.select(F.col("doc_id").alias("id"), "text")
    classes, scratch = line_dedup.classes_of(source, 80, 4), line_dedup.Scratch(spark)
    tried = line_dedup._first_tries(classes, scratch, 80)
    assert {r.id // 100 for r in tried.collect()} == {2}
    assert line_dedup._first_tries(classes.where("id < 200"), scratch, 80) is None
    entries = line_dedup._entries(classes, source.select("id", F.lit(0).alias("line")).where("false"), scratch, "t", 80, 4)
    assert line_dedup._hot_keys(entries, 10**6, scratch, "t") == (None, entries.count())
    plan = line_dedup._pairs(entries, entries, 80, 1, True)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(line_dedup, "HASHED", 10)
    same(line_dedup.remove_lines(docs), brute.lines(rows), ["doc_id", "n_lines", "n_removed", "kept"])


def test_lines_enough(spark):
    """Products say what rounded quotients say, for sizes whose products exceed an int too."""
    got = spark.range(1, 60).select(F.col("id").cast("int").alias("n")).crossJoin(spark.range(1, 60).select(F.col("id").cast("int").alias("m"))).crossJoin(spark.range(60).select(F.col("id").cast("int").alias("k")))
    got = got.where("k <= least(n, m)").select("n", "m", "k", line_dedup.enough(F.col("k"), F.col("n"), F.col("m"), 80).alias("a"), line_dedup.not_too_far(F.col("n") + F.col("m") - F.col("k") * 2, F.col("n"), F.col("m"), 80).alias("b"))
    assert got.where("a != b OR a != (100 * k >= 80 * (n + m - k))").count() == 0
    big = spark.createDataFrame([(1 << 29, 1 << 29)], "n int, m int")
    assert big.select(line_dedup.enough(F.col("n"), F.col("n"), F.col("m"), 80)).first()[0]


def test_texts_that_lose_nothing_are_not_shuffled(spark):
    from foliate.llm.common import Scratch

    rows = frame(spark, [*((i, f"a{i} b{i} c{i}\n d{i} e{i}") for i in range(50)), (50, "a1 b1 c1\nnew"), (None, "x")]).select("doc_id", "text")
    gone = spark.createDataFrame([(50,), (None,)], "doc_id long")
    for keys, want in ((gone, {50, None}), (gone.where("false"), set())):
        maybe, rest = native.parted(rows, ["doc_id"], keys, Scratch(spark), "t")
        there, left = [{r.doc_id for r in x.collect()} for x in (maybe, rest)]
        assert want <= there and len(there) < 10 and there | left == {*range(51), None} and not there & left
    for out in (line_dedup.remove_lines(rows), decontaminate.decontaminate(rows, frame(spark, [(1, "new")]).select(F.col("doc_id").alias("item_id"), "text"))):
        assert "Union" in out._jdf.queryExecution().optimizedPlan().toString()


def test_line_words(spark):
    """Every kind of white space, and words that only look like it."""
    bodies = ["a b", " a\tb\x0b\x0cc\rd ", "", "  ", "a\u00a0b \u2003c", "é  É", "a\x1fb\x85c"]
    body = F.col("body")
    for text in [*bodies, "\n".join(bodies)]:
        rows = line_dedup.lines(spark.createDataFrame([(1, text)], "id long, text string")).select("line", F.filter(line_dedup.words(body), lambda w: w != "").alias("w"), F.size(line_dedup.word_set(body)).alias("n")).collect()
        assert [r.w for r in sorted(rows, key=lambda r: r.line)] == [brute.WORD.findall(b) for b in text.split("\n")]
        assert all(r.n == len(set(r.w)) for r in rows)


def test_quality(spark):
    rows = [*DOCS, (60, "a b c a b c\na b c a b c\n\n\n#*|<>"), (None, "x\nx\n y\n y"), (61, "word " * 300), (62, prose(300, [f"{a}{b}{c}" for a in "abcdefgh" for b in "stuvwxyz" for c in "klmnop"]))]
    rows = [*rows, rows[0]]
    want = [(i, *m, m[0] < 50 or 100 * m[4] > 50 * m[0]) for i, t in rows for m in [brute.quality(t)]]
    out = quality.quality_rules(frame(spark, rows))
    same(out, want, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"])
    kept = {r.doc_id: r.kept for r in out.collect()}
    assert not kept[61] and kept[62] and not kept[30] and not kept[31]
    assert quality.quality_rules(frame(spark, rows).where("false")).count() == 0


def test_compression_bands():
    compress = __import__("zstandard").ZstdCompressor(level=quality.LEVEL).compress
    noise = bytes(R.randrange(256) for _ in range(20000))
    assert not quality.compression(noise, compress)[3]
    assert not quality.compression(b"abc " * 5000, compress)[3]
    good = prose(4000, [f"{a}{b}{c}" for a in "abcdefgh" for b in "stuvwxyz" for c in "klmnop"]).encode()
    assert quality.compression(good, compress)[3]
    assert not quality.compression(good + b"abc " * 5000, compress)[3]  # one part alone fails


def test_urls(spark):
    urls = ["http://a.com/x", "https://Example.COM/en/1", "http://www.example.com/en/", "http://m.example.com/en/x?y", "ftp://q.net/es/1", "http://q.net/es", "http://net/fr/x#y", "http://xnet/fr/x", None, "", "nothing", "http://",
            "http://a.com", "http://spam-farm.example.org/x", "http://www.spam-farm.example.org/", "http://spam-farm.example.org", "x://y://z.com/", "http://u@h.com:80/?a/b", "http://a..com/x", "http://q.org/es/é?z"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(1, urls[1]), (1, urls[1]), (None, None), (None, urls[0])]
    pages = spark.createDataFrame([(i, u, "h", "k", 1) for i, u in rows], "page_id long, url string, host string, key string, n int")
    want = [(i, *brute.judge(u, url_filter.RULES, url_filter.LISTED)) for i, u in rows]
    same(url_filter.filter_urls(pages, url_filter.default_rules(spark)), want, ["page_id", "host", "path", "rule", "verdict"])
    assert url_filter.filter_urls(pages.where("false"), url_filter.default_rules(spark)).count() == 0
    assert url_filter.filter_urls(pages, url_filter.default_rules(spark).where("false")).where("verdict = 'block'").count() == 0


def test_large_groups_verify_every_pair_still_apart():
    """Pairs with few equal symbols too."""
    import pyarrow as pa

    texts = [" ".join(f"w{i}" for i in range(a, a + 20)) for a in (0, 14)]
    sig = near_dup.signatures(near_dup.shingle_sets(pa.array(texts), 1)[0])
    assert (sig[0] != sig[1]).sum() > 24
    t = pa.table({"text": texts, "x": [1, 2], "comp": [1, 2], "outside": [True, False]})
    assert near_dup._compare(1, 15)(t).to_pydict() == {"a": [1], "b": [2]}
    assert near_dup._compare(1, 18)(t).num_rows == 0


def test_block_list_of_a_table(spark):
    listed = [("http://Casino.test",), ("ads.test/",), ("ads.test",), ("https://mixed.test/bad?x#y",), ("example.com/en/9",), (None,), ("",), ("http://",)] + [(f"h{i}.test",) for i in range(300)]
    rules = url_filter.block_list(spark.createDataFrame(listed, "url string"))
    assert rules.count() == 304
    want = {"http://casino.test": "block", "http://www.casino.test?q": "block", "http://casino.test/a": "block", "http://xcasino.test/": "allow", "http://m.ads.test/": "block", "http://mixed.test/bad/1": "block", "http://mixed.test/": "allow",
            "http://h299.test": "block", "http://h300.test/": "allow", "http://www.example.com/en/9": "allow", "": "allow"}
    pages = spark.createDataFrame(list(enumerate(want)), "page_id long, url string")
    got = {r.url: r.verdict for r in url_filter.filter_urls(pages, url_filter.default_rules(spark).unionByName(rules)).collect()}
    assert got == want


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    hit = native.bloom_test(native.blocked_bloom(keys, 2048), F.col("key"), 2048)
    assert keys.where(hit).count() == 5000
    assert spark.range(5000, 10000).select(F.concat(F.lit("k"), "id").alias("key")).where(hit).count() < 500


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    odd = ["<|endoftext|>", "a<|endoftext|> \n\n b", "  \t x\x1c\x85z", "don't I'LL he'll 123abc ١٢٣", "日本語 🎉👍🏽", "=" * 700 + "ab" * 300, " " * 300 + "x", "\x00\x01\ufffd\u200b"]
    odd += ["".join(R.choices([chr(c) for c in [*range(600), *range(0x2000, 0x2050), 0x1F600]], k=50)) for _ in range(200)]
    rows = [*DOCS, *((200 + i, t) for i, t in enumerate(odd)), (None, "a b"), (None, "a b")]
    got = sorted(((r.doc_id, bytes(r.ids), r.n_tokens, r.decoded) for r in bpe.bpe_encode(frame(spark, rows), tokenizer("byte_bpe_50k.json")).collect()), key=repr)
    want = []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, np.array(ids, "<u4").tobytes(), len(ids), lib.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=repr)
    assert bpe.bpe_encode(frame(spark, rows).where("false"), tokenizer("byte_bpe_50k.json")).count() == 0


def test_bpe_of_a_very_long_word():
    from tokenizers import Tokenizer

    text = "".join(R.choices("abcdefghij", k=60_000))
    encoder = bpe.TrieEncoder(bpe.Vocabulary(tokenizer("byte_bpe_50k.json")))
    tracemalloc.start()
    got = encoder.encode([text])[0]
    assert tracemalloc.get_traced_memory()[1] < 40e6
    tracemalloc.stop()
    assert np.frombuffer(got, "<u4").tolist() == Tokenizer.from_file(tokenizer("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    model = language.train(docs.where("crc32(CAST(doc_id AS STRING)) % 4 <> 2"), tokenizer("piece_bpe_32k.model"))
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    out = language.identify(docs, model).collect()
    tested = [r for r in out if held(r.doc_id)]
    assert len(tested) > 100 and sum(r.lang_pred == lang[r.doc_id] for r in tested) / len(tested) > 0.97
    assert all(0 <= r.score <= 1 for r in out)
    odd = frame(spark, [(1, None), (2, ""), (3, "123 !!"), (None, "the and of"), (5, "x" * 5000), (5, "\ud800".encode("utf-8", "replace").decode())])
    got = {r.doc_id: r.lang_pred for r in language.identify(odd, model).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[None] == "en"
    nothing = language.train(docs.where("false"), tokenizer("piece_bpe_32k.model"))
    assert {r.lang_pred for r in language.identify(odd, nothing).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    names = language.pieces(tokenizer("piece_bpe_32k.model"))
    at = {n: i for i, n in enumerate(names) if n}
    log_p = np.log(np.random.default_rng(1).dirichlet(np.ones(len(names)), 2))
    scorer = language.Scorer(language.Model(["a", "b"], log_p, tokenizer("piece_bpe_32k.model")))

    def total(word, lang):
        if not word:
            return 1.0
        out = language.UNKNOWN * total(word[1:], lang)
        for n in range(1, len(word) + 1):
            if word[:n] in at:
                out += float(np.exp(log_p[lang, at[word[:n]]])) * total(word[n:], lang)
        return out

    for word in ["the", "a", "zebra", "été", "ß", "日x"]:
        got = scorer.words([word])[0]
        assert np.allclose(got, [np.log(total(language.SPACE_MARK + word, x)) for x in (0, 1)])

    def plain(word, lang):
        """Step by step in logarithms: words of any length."""
        logs = [0.0]
        for i in range(1, len(word) + 1):
            ways = [logs[i - 1] + np.log(language.UNKNOWN)]
            ways += [logs[i - n] + log_p[lang, at[word[i - n : i]]] for n in range(1, min(i, scorer.longest) + 1) if word[i - n : i] in at]
            logs.append(np.logaddexp.reduce(ways))
        return logs[-1]

    words = ["the" * 100, "x日" * 500, "a", "there" * 9 + "é", "z" * 47, "z" * 48, "z" * 49, "qu" * 3000]
    got = scorer.words(words)
    assert np.allclose(got, [[plain(language.SPACE_MARK + w, x) for x in (0, 1)] for w in words])


def test_language_of_many_labels(spark, monkeypatch):
    """Beyond the bound the labels with most texts are learned."""
    monkeypatch.setattr(language, "MAX_LANGUAGES", 2)
    rows = [(i, "the lamp and the door", ["en", "aa", "zz", "en", "aa"][i % 5]) for i in range(50)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), tokenizer("piece_bpe_32k.model"))
    assert model.langs == ["aa", "en"]


def test_chat(spark):
    import duckdb

    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "yes"), (1, 2, "assistant", "yes"), (1, 3, "guest", None), (2, 0, "system", "x"), (3, None, None, "é"), (None, 1, "user", ""), (None, 1, "user", "b")]
    turns = spark.createDataFrame([(*r, "p", "n") for r in rows], "conv_id long, turn long, role string, text string, perspective string, n string")
    out = chat.rotate_perspectives(turns)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    cur = con.execute(chat.ROTATE_SQL)
    same(out, cur.fetchall(), [d[0] for d in cur.description])
    one = sorted((r.turn, r.seq, r.segment, r.loss_mask, r.content_from, r.content_to) for r in out.where("conv_id = 1 AND perspective = 'user'").collect())
    assert "".join(x[2] for x in one) == "<|system|>\nbe kind\n<|assistant|>\nhi\n<|user:assistant|>\nyes\n<|user:assistant|>\nyes\n<|user:guest|>\n\n"
    assert [x[3] for x in one] == [0, 1, 0, 0, 0] and one[1][2][one[1][4] : one[1][5]] == "hi"
    assert out.where("conv_id = 2").count() == 0 and chat.rotate_perspectives(turns.where("false")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div><!-- c <p>no</p> -->
<article><h1>The   <b>title</b></h1><p>One &eacute;&nbsp;two<br>three<p>Four <i>fi</i>ve<div class="ad"><p>Buy</p></div><form><p>Mail</p></form><aside>More</aside><p>Six</p><ul><li>a</li><li>b</li></ul>
<table><tr><td>c1</td><td>c2</td></tr></table><section class="comments"><p>Nice post</p></section><p hidden>no</p></article><div id="sidebar"><p>Side</p></div><footer>&copy; x</footer></body></html>"""


def test_html_page():
    assert html.main_text(PAGE) == "The title\nOne é two three\nFour five\nSix\na\nb\nc1\nc2"


def test_html_without_article():
    body = "".join(f"<p>{prose(40)}</p>" for _ in range(5))
    page = f"<html><body><div><a href='/'>Home</a></div><div id='content'><h2>Head</h2>{body}<p>End.</p></div><div><p>Tiny</p></div></body></html>"
    out = html.main_text(page).split("\n")
    assert out[0] == "Head" and out[-1] == "End." and len(out) == 7


def test_html_body_outside_articles():
    """Articles add lines to what is dense; they take none away, and lend no weight to their neighbours."""
    long = [prose(40) for _ in range(6)]
    paragraphs = "".join(f"<p>{x}</p>" for x in long)
    card = f"<article><h3>Card</h3><p>{prose(30)}</p></article>"
    for page in (f"<div><h2>Head</h2>{paragraphs}</div><div>{card}</div>", f"<div>{card}</div><div><h2>Head</h2>{paragraphs}</div>"):
        out = html.main_text(f"<html><body>{page}</body></html>").split("\n")
        assert [x for x in out if x in long] == long and {"Head", "Card"} <= set(out)
    out = html.main_text(f"<html><body><div>Tiny</div><article><h1>T</h1>{paragraphs}</article><div>Tags</div><article>{paragraphs}</article><div>End</div></body></html>").split("\n")
    assert out == ["T", *long, *long]


@pytest.mark.parametrize("wrap", ["<div class='main has-sidebar'>{}</div>", "<div class='share-layout'>{}</div>", "<form action='x'>{}</form>", "<form><div id='page-with-nav'>{}</div></form>", "<div class='comments page'><p>Nice</p></div><form>{}</form>"])
def test_html_page_in_a_wrapper(wrap):
    """Where dropping a wrapper would leave nothing, it is opened; what is dropped inside it stays so."""
    body = [prose(60) for _ in range(5)]
    page = wrap.format("<nav>Home</nav>" + "".join(f"<p>{b}</p>" for b in body) + "<div class='ad'>Buy</div>")
    assert html.main_text(f"<html><body>{page}<footer>x</footer></body></html>").split("\n") == body
    assert html.main_text(f"<html><body>{page}<article><p>{prose(60)}</p></article></body></html>").count("\n") == 0
    assert html.main_text("<div class='sidebar'>Side</div><aside>x</aside><div class='ad' hidden>y</div>") == ""


def test_html_nesting_is_linear():
    start = time.process_time()
    html.main_text("<div></section>" * 40_000)
    html.main_text("<div>" * 40_000 + "x" + "</div>" * 40_000)
    assert time.process_time() - start < 10


@pytest.mark.parametrize(("source", "text"), [
    (None, ""), ("", ""), ("   ", ""), ("plain words", "plain words"), ("<p>a</p", "a"), ("<p>a<!-- cut", "a"), ("<article><p>a &am", "a &am"), ("<article><p>a</p><script>x", "a"),
    ("<article><p class=ad>Buy<p>a<ul><li class='share'>s<li>b</ul><p>c</article>", "a\nb\nc"), ("<article><div class='ad'><div>x</div>y</div>a</article>", "a"), ("<article><div class='research-text'>a</div></article>", "a"),
    ("<nav>x</nav>", ""), ("<article>a < b and 1<2</article>", "a < b and 1<2"), ("<ARTICLE><P>A</P></ARTICLE>", "A"), ("<article><p title='a>b'>x</p></article>", "x"),
])
def test_html_odd(source, text):
    assert html.main_text(source) == text


def test_html_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<article><p>" + "word " * 200000 + "</p></article>")]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((r.page_id, r.url, len(r.text)) for r in html.extract_pages(pages).collect()), key=repr)
    n = len(html.main_text(PAGE))
    assert got == sorted([(1, "u", n), (1, "u", n), (2, None, 0), (None, "v", 0), (3, "w", 999999)], key=repr)
    assert html.extract_pages(pages.where("false")).count() == 0
