"""Language identification by unigrams over a fixed vocabulary of pieces, summed over all segmentations.

Each language has a probability for every piece. The probability of a word is the sum over all ways to cut it into
pieces, found by a forward pass; that of a text is the product over its words. Words end at white space, where pieces end
too, so distinct words are scored once and looked up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .common import trim

#: Bound of the sample a model is fitted on: about so many labelled texts a language, picked by a hash of the id.
SAMPLE_A_LANGUAGE = 4000
SMOOTHING = 0.5
#: Probability of a character that no piece covers; steps after which a forward pass is scaled anew; numbers a pass holds.
UNKNOWN, RESCALE, BATCH = 1e-4, 32, 4_000_000
CACHE_WORDS = 200_000
#: Bound of the model: so many languages, those with most texts, can be learned.
MAX_LANGUAGES = 200
SPACE_MARK = "▁"
LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    langs: list[str]
    log_p: np.ndarray  # languages x pieces
    vocabulary: str


def pieces(vocabulary: str) -> list[str]:
    """The vocabulary's ordinary pieces; others (control, unknown, bytes) are empty."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    return ["" if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) else sp.id_to_piece(i) for i in range(sp.get_piece_size())]


def train(labelled: DataFrame, vocabulary: str, sample: int = SAMPLE_A_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Piece counts by language over a bounded sample of whole labelled texts. Rows without text or label teach nothing.

    Counts are of the vocabulary's own segmentation of a text, while scoring sums over all: a cheap stand-in for expected
    counts over all segmentations.
    """
    docs = labelled.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("t IS NOT NULL AND l IS NOT NULL")
    counts = {r["l"]: r["n"] for r in docs.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(MAX_LANGUAGES).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((0, len(pieces(vocabulary)))), vocabulary)
    bar = F.lit(0.0)
    for lang in langs:
        bar = F.when(F.col("l") == lang, F.lit(min(1.0, sample / counts[lang]))).otherwise(bar)
    chosen = docs.where(F.pmod(F.xxhash64(F.col("i").cast("string")), F.lit(1_000_003)) < bar * 1_000_003)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        for batch in batches:
            sums: dict[str, np.ndarray] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = sp.encode(text.replace(SPACE_MARK, " "))
                have = sums.setdefault(lang, np.zeros(sp.get_piece_size(), np.int64))
                np.add.at(have, np.asarray(ids, np.int64), 1)
            for lang, have in sums.items():
                at = np.flatnonzero(have)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(have[at])], names=["l", "piece", "n"])

    rows = chosen.select("t", "l").mapInArrow(count, "l string, piece long, n long").groupBy("l", "piece").agg(F.sum("n").alias("n")).toPandas()  # vocabulary x languages at most
    names = pieces(vocabulary)
    table = np.zeros((len(langs), len(names)))
    for lang, part in rows.groupby("l"):
        table[langs.index(lang), part["piece"].to_numpy()] = part["n"]
    table[:, [i for i, x in enumerate(names) if not x]] = 0
    p = (table + SMOOTHING) / (table.sum(axis=1, keepdims=True) + SMOOTHING * len(names))
    return Model(langs, np.log(p), vocabulary)


class Scorer:
    def __init__(self, model: Model):
        self.p = np.exp(model.log_p)
        self.n = len(model.langs)
        chars: dict[str, int] = {}
        edges: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        self.longest = 1
        for i, piece in enumerate(pieces(model.vocabulary)):
            node, self.longest = 0, max(self.longest, len(piece))
            for c in piece:
                node = edges.setdefault((node, chars.setdefault(c, len(chars) + 1)), len(edges) + 1)
            if piece:
                ends[node] = i
        self.width = len(chars) + 1
        self.chars = np.zeros(0x110000, np.int32)
        for c, i in chars.items():
            self.chars[ord(c)] = i
        keys = np.array([a * self.width + b for a, b in edges], np.int64)
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.array(list(edges.values()), np.int64)[order]
        self.end = np.full(len(edges) + 2, -1, np.int64)
        for node, i in ends.items():
            self.end[node] = i
        self.rows: dict[str, int] = {}
        self.log = np.zeros((0, self.n))

    def words(self, words: list[str]) -> np.ndarray:
        """Log probabilities (words x languages), summed over all segmentations."""
        out = np.zeros((len(words), self.n))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        while order:  # the longest words first, as many as BATCH allows
            each = max(len(words[order[-1]]) + 1, self.n * (self.longest + 1))
            some = order[-max(1, BATCH // each) :]
            del order[-len(some) :]
            out[some] = self._forward([SPACE_MARK + words[i] for i in some])
        return out

    def _forward(self, words: list[str]) -> np.ndarray:
        """One pass over all words. Only as many steps are held as a piece is long, and scaled anew before they vanish."""
        lengths = np.array([len(w) for w in words])
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        longest, ring = int(lengths[0]), self.longest + 1
        codes = np.zeros((len(words), longest), np.int32)
        flat = self.chars[np.frombuffer("".join(words[i] for i in order).encode("utf-32-le", "surrogatepass"), np.uint32)]
        codes[np.arange(longest)[None, :] < lengths[:, None]] = flat
        alpha = np.zeros((ring, len(words), self.n))
        alpha[0] = 1.0
        scale, done = np.zeros((len(words), self.n)), np.zeros((len(words), self.n))
        before = len(words)
        for i in range(longest + 1):
            own = alpha[i % ring]
            m = int(np.searchsorted(-lengths, -i, side="left"))  # words longer than i
            if m < before:
                done[m:before] = np.log(own[m:before]) + scale[m:before]
                before = m
            if not m:
                break
            if i % RESCALE == 0 and i:
                top = alpha[:, :m].max(axis=0)
                alpha[:, :m] /= top
                scale[:m] += np.log(top)
            alpha[(i + 1) % ring, :m] += own[:m] * UNKNOWN
            live, node, step = np.arange(m), np.zeros(m, np.int64), i
            while len(live) and step < longest:
                c = codes[live, step]
                key = node * self.width + c
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                ok = (c > 0) & (self.keys[at] == key)
                live, node = live[ok], self.next[at[ok]]
                step += 1
                piece = self.end[node]
                has = piece >= 0
                rows = live[has]
                alpha[step % ring, rows] += own[rows] * self.p[:, piece[has]].T
            own[:] = 0  # the place of a later step
        result = np.empty((len(words), self.n))
        result[order] = done
        return result

    def texts(self, texts: list[str | None]) -> Iterator[tuple[int, float]]:
        """Best language (-1: none) and its share of the probability, for each text."""
        split = [t.split() if t and LETTER.search(t) else [] for t in texts]
        new = [w for w in {w for ws in split for w in ws} if w not in self.rows]
        if len(self.rows) + len(new) > CACHE_WORDS:
            self.rows, self.log = {}, np.zeros((0, self.n))
            new = list({w for ws in split for w in ws})
        if new:
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.log = np.concatenate([self.log, self.words(new)])
        get = self.rows.__getitem__
        for ws in split:
            if not ws or not self.n:
                yield -1, 0.0
                continue
            total = self.log[np.fromiter(map(get, ws), np.int64, len(ws))].sum(axis=0)
            best = int(np.argmax(total))
            yield best, float(1 / np.exp(np.maximum(total - total[best], -700)).sum())


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", chunk: int = 500, keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and score to keep (else the id alone, as doc_id). Every whole text is scored.

    Null text, text without a letter, or a model that learned nothing: und with score 0. Ties go to the first language
    in order of name. Repeated rows stay; columns outside keep are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x vocabulary: 200 x 32,000 at most

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        langs = shared.value.langs
        for whole in batches:
            trim()
            for at in range(0, whole.num_rows, chunk):
                batch = whole.slice(at, chunk)
                found = list(scorer.texts(batch.column(batch.num_columns - 1).to_pylist()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([langs[i] if i >= 0 else "und" for i, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=names)

    if keep is None:
        source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    else:
        source = docs.select(*keep, F.col(text_col).alias("_text"))
    names = [*source.columns[:-1], "lang_pred", "score"]
    schema = StructType(source.schema.fields[:-1]).add("lang_pred", StringType()).add("score", DoubleType())
    return source.mapInArrow(rows, schema)
