"""Quality rules: counts over whole texts, then compression bands."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame

WORD = regex.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = str.maketrans("", "", "#*$%&|<>")
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, min_chunk_ratio double, max_chunk_ratio double, kept boolean"


@dataclass(frozen=True)
class Band:
    """Ratios of raw to compressed bytes that texts of at least min_bytes may have."""

    min_bytes: int
    low: float
    high: float


#: Limits by length. Short texts carry frame overhead, so their low limit is under 1; long texts of ordinary prose
#: reach two to four, and more only when parts repeat.
DOCUMENT_BANDS = (Band(0, 0.70, 4.0), Band(256, 1.05, 5.0), Band(1024, 1.20, 6.0), Band(8192, 1.35, 8.0), Band(65536, 1.45, 12.0))
CHUNK_BANDS = (Band(0, 0.55, 6.0), Band(512, 1.05, 8.0), Band(4096, 1.15, 16.0))
CHUNK_BYTES = 8192
LEVEL = 3


def band(bands: tuple[Band, ...], n: int) -> Band:
    return [b for b in bands if b.min_bytes <= n][-1]


def compression(data: bytes, compress, chunk_bytes: int = CHUNK_BYTES) -> tuple[float, float, float, bool]:
    """Ratio of the whole, least and greatest ratio of the fixed chunks, and whether all lie in their bands."""
    if not data:
        return 0.0, 0.0, 0.0, False
    whole = len(data) / len(compress(data))
    b = band(DOCUMENT_BANDS, len(data))
    good, ratios = b.low <= whole <= b.high, []
    for at in range(0, len(data), chunk_bytes):
        part = data[at : at + chunk_bytes]
        ratios.append(r := whole if len(part) == len(data) else len(part) / len(compress(part)))
        b = band(CHUNK_BANDS, len(part))
        good = good and b.low <= r <= b.high
    return whole, min(ratios), max(ratios), good


def measures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = WORD.findall(text)
    n = len(words)
    seen: set[str] = set()
    dup = 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in seen:
                dup += 1
            elif WORD.search(line):
                seen.add(line)
    triples = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(triples)) < len(triples):
        counts, end = Counter(triples), 0
        for i, w in enumerate(triples):
            if counts[w] > 1:
                repeated += i + 3 - max(end, i)
                end = i + 3
    return n, sum(map(len, words)), len(text) - len(text.translate(SYMBOL)), dup, repeated


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row. Null or empty text: no words, base_failed, not kept, ratios 0. Repeated rows stay.

    Other columns of the input are ignored, whatever their names.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            out: list[list] = [[] for _ in range(10)]
            for text in batch.column(1):
                text = text.as_py() or ""
                m = measures(text)
                failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
                *ratios, good = compression(text.encode("utf-8", "surrogatepass"), compress)
                for column, value in zip(out, (*m, failed, *ratios, good and not failed), strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.float64()] * 3 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(id_col, text_col).mapInArrow(rows, SCHEMA)
