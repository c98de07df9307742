"""Column helpers of the operators that run on DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: 64-bit blocks of the filter: at least this many bits an entry, and at most so many blocks (8 MB). A list beyond that
#: only lets more candidates through to the exact join.
BITS_AN_ENTRY, MAX_BLOCKS = 16, 1 << 20
PROBES = 4


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over value, which is computed once a row and not once a use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def upto(n: Column | int, start: int = 1) -> Column:
    """start..n, empty if n is smaller."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n >= start, F.sequence(F.lit(start), n.cast("int"))).otherwise(F.array().cast("array<int>"))


def words(text: Column, separators: str) -> Column:
    """Runs of anything but separators, a Java regular expression; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators), lambda w: w != "")


def _block_and_mask(key: Column, blocks: int) -> tuple[Column, Column]:
    """One block for each key and PROBES bits in it, all from one 64-bit hash."""
    h = F.xxhash64(key)
    mask = F.lit(0).cast("long")
    for i in range(PROBES):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return F.pmod(F.shiftrightunsigned(h, 6 * PROBES), F.lit(blocks).cast("long")).cast("int"), mask


def blocked_bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """One row, one column: the filter over column key as an array of 64-bit blocks."""
    block, mask = _block_and_mask(F.col("key"), blocks)
    set_ = keys.select(block.alias("block"), mask.alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("mask"))
    every = keys.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"))
    filled = every.join(set_, "block", "left").select("block", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))
    return filled.agg(F.transform(F.sort_array(F.collect_list(F.struct("block", "mask"))), lambda x: x["mask"]).alias("filter"))


def bloom_test(bloom: DataFrame, key: Column, blocks: int) -> Column:
    """False only for keys that are not in the filter."""
    block, mask = _block_and_mask(key, blocks)
    return F.get(bloom.scalar(), block).bitwiseAND(mask) == mask


def bloom_of(keys: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, int]:
    """A filter over column key, of a size by the count of keys, and its blocks."""
    many, blocks = keys.count(), 1
    while blocks < min(MAX_BLOCKS, -(-many * BITS_AN_ENTRY // 64)):
        blocks *= 2
    return scratch.cut(blocked_bloom(keys, blocks), name), blocks


def parted(rows: DataFrame, on: list[str], keys: DataFrame, scratch: Scratch, name: str, key: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """rows that may have one of keys in columns on (of keys: key, if named otherwise; nulls are a key), and rows that surely have none. A join with few keys is made
    of the first alone, so that the second, most of a large table, stay where they are."""
    bloom, blocks = bloom_of(keys.select(F.xxhash64(*(key or on)).alias("key")), scratch, name)
    maybe = bloom_test(bloom, F.xxhash64(*on), blocks)
    return rows.where(maybe), rows.where(~maybe)
