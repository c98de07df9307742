"""Byte-level BPE by a depth-first walk over the trie of distinct words.

The last token of the encoding of a prefix decides the whole encoding of that prefix, so each trie node needs one
state: its last token. Sorted words are the trie in depth-first order; a stack keeps the states of the current path,
and a word starts from the deepest node that it shares with the word before it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import trim

SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"
#: White_Space is named, as \s of the regex module also holds some control characters.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Distinct words whose encodings a task keeps; the table starts anew beyond.
CACHE_WORDS = 150_000
#: Bytes of a word up to which the tokens of every prefix are kept.
DEEP = 64


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merge ranks and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {name: i for name, i in spec["model"]["vocab"].items() if name not in self.special}
        self.bytes = {i: bytes(alphabet[c] for c in name) for name, i in names.items()}
        self.ids = {b: i for i, b in self.bytes.items()}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[names[a], names[b]] = rank, names[a + b]
        lengths: dict[bytes, set[int]] = {}
        for b in self.ids:
            lengths.setdefault(b[-2:], set()).add(len(b))
        self.lengths = {end: sorted({*found, 1}, reverse=True) for end, found in lengths.items()}  # of tokens by their last two bytes
        self.piece = self.bytes | {i: s.encode() for s, i in self.special.items()}

    def merged(self, data: bytes) -> list[int]:
        """The plain algorithm: join the adjacent pair of least rank, leftmost first, until none is left."""
        ids = [self.ids[data[i : i + 1]] for i in range(len(data))]
        get, none = self.merge.get, (1 << 30, 0)
        pairs = [get(p, none) for p in zip(ids, ids[1:])]
        while pairs:
            rank, new = best = min(pairs)
            if rank == 1 << 30:
                break
            i = pairs.index(best)
            ids[i : i + 2] = [new]
            del pairs[i]
            if i:
                pairs[i - 1] = get((ids[i - 1], new), none)
            if i < len(pairs):
                pairs[i] = get((new, ids[i + 1]), none)
        return ids


class TrieEncoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.fits: dict[int, bool] = {}
        self.done: dict[bytes, bytes] = {}
        split = "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))
        self.special = regex.compile(f"({split})") if split else None
        self.pieces = regex.compile(PATTERN)

    def _pair(self, a: int, b: int) -> bool:
        """Whether b can follow a: the bytes of both give just these two tokens."""
        key = a << 32 | b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 2 * CACHE_WORDS:
                self.fits.clear()
            known = self.fits[key] = self.v.merged(self.v.bytes[a] + self.v.bytes[b]) == [a, b]
        return known

    def learn(self, words: set[bytes]) -> None:
        """Encodes distinct words; a prefix that several share is encoded once."""
        ids, pair, lengths, before = self.v.ids, self._pair, self.v.lengths, b""
        last: list[int] = [-1]  # by depth: the last token
        back: list[int] = [0]  # by depth: where that token begins
        path: list[bytes] = [b""]  # by depth up to DEEP: the tokens, four bytes each
        for word in sorted(words):
            same, most = 0, min(len(word), len(before))
            while same < most and word[same] == before[same]:
                same += 1
            del last[same + 1 :], back[same + 1 :], path[same + 1 :]
            for depth in range(same + 1, len(word) + 1):
                for n in lengths.get(word[max(0, depth - 2) : depth], (1,)):
                    start = depth - n
                    token = ids.get(word[start:depth]) if start >= 0 else None
                    if token is not None and (pair(last[start], token) if start else self._alone(token)):
                        break
                else:
                    raise ValueError("a byte has no token")
                last.append(token)
                back.append(start)
                if depth <= DEEP:
                    path.append(path[start] + token.to_bytes(4, "little"))
            depth, rest = len(word), []
            while depth > DEEP:  # whole paths of every depth would be quadratic
                rest.append(last[depth])
                depth = back[depth]
            self.done[word] = path[depth] + np.array(rest[::-1], "<u4").tobytes() if rest else path[depth]
            before = word

    def _alone(self, token: int) -> bool:
        known = self.fits.get(-token - 1)
        if known is None:
            known = self.fits[-token - 1] = self.v.merged(self.v.bytes[token]) == [token]
        return known

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids of each whole text, little-endian unsigned 32-bit."""
        split: list[list] = []
        new: set[bytes] = set()
        if len(self.done) > CACHE_WORDS:
            self.done.clear()
        for text in texts:
            parts: list = []
            for part in self.special.split(text) if self.special else [text]:
                if part in self.v.special:
                    parts.append(self.v.special[part])
                elif part:
                    found = [w.encode("utf-8", "replace") for w in self.pieces.findall(part)]
                    new.update(w for w in found if w not in self.done)
                    parts.append(found)
            split.append(parts)
        self.learn(new)
        get = self.done.__getitem__
        return [b"".join(x.to_bytes(4, "little") if isinstance(x, int) else b"".join(map(get, x)) for x in parts) for parts in split]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.v.piece.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_ENCODERS: dict[str, TrieEncoder] = {}


def bpe_encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = 256) -> DataFrame:
    """Token ids of every whole text and the text decoded from them.

    Null text counts as empty: no tokens, empty ids, empty decoded text. Repeated rows stay; other columns are
    ignored. vocabulary is a tokenizer file that every executor can open.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(vocabulary)
        if encoder is None:
            encoder = _ENCODERS[vocabulary] = TrieEncoder(Vocabulary(vocabulary))
        for whole in batches:
            trim()
            for at in range(0, whole.num_rows, chunk):
                batch = whole.slice(at, chunk)
                ids = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([encoder.decode(x) for x in ids], pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )

    return docs.select(id_col, text_col).mapInArrow(rows, SCHEMA)
