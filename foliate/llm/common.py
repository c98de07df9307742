"""What the operators share: table access, bounded broadcasts, lineage cuts, hashing of words in numpy."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of fixed-width columns (under 200 bytes a row) may be broadcast: 20 MB at most.
BROADCAST_ROWS = 100_000
#: A key with more than this share of all rows, and more rows than this, is joined by broadcast.
HOT_SHARE, HOT_ROWS = 1 / 50_000, 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame) -> list[Column]:
    """The columns of df, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks df for broadcast if a count proves it small; otherwise Spark joins it by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_totals(rows: DataFrame, totals: DataFrame, keys: list[str], n: str) -> DataFrame:
    """rows with the columns of totals, which has one row for each key of rows (nulls are a key) and, in n, how many rows of it
    there are; n goes. Keys with more than HOT_SHARE of all rows, 1 / HOT_SHARE at most, are broadcast, so that no key's rows
    meet in one task; the others are joined by shuffle."""
    new = [c for c in totals.columns if c not in (*keys, n)]
    facts = totals.agg(F.coalesce(F.sum(n), F.lit(0)).alias("all"), F.count(F.lit(1)).alias("keys")).first()
    least = max(HOT_ROWS, int(facts["all"] * HOT_SHARE))
    renamed = totals.select(*(F.col(k).alias(f"total_{k}") for k in keys), *new, n)
    on = [F.col(k).eqNullSafe(F.col(f"total_{k}")) for k in keys]
    out = [*(F.col(c) for c in rows.columns), *(F.col(c) for c in new)]
    if facts["keys"] <= 1 / HOT_SHARE:
        return rows.join(F.broadcast(renamed), on).select(*out)
    hot = F.broadcast(renamed.where(F.col(n) > least))
    return rows.join(hot, on).select(*out).union(rows.join(hot, on, "left_anti").join(renamed.where(F.col(n) <= least), on).select(*out))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local master without spark.checkpoint.dir gets one of its own."""
    sc = spark.sparkContext
    if path := sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir():
        return path.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="foliate-"))
    return sc.getCheckpointDir()


@contextmanager
def conf(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """SQL settings for what runs inside."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """Tables written in the shared folder to cut lineage; they survive lost executors. Shuffle files of what made a table go
    once it is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with conf(self.spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, *names: str) -> None:
        """Drops all tables but these."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        for at in root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root):
            if at.getPath().getName() not in names:
                self.drop(at.getPath().getName())


def trim() -> None:
    """Gives memory that a Python worker has freed back to the system, as workers live on beside a heap that needs it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


# ---- words of many texts at once -------------------------------------------------------------

_U = np.uint64
_RNG = np.random.default_rng(20240817)
_BYTE = _RNG.integers(0, 2**64, (2, 256), dtype=_U)
_BASE = [int(x) | 1 for x in _RNG.integers(0, 2**64, 2, dtype=_U)]
_BASE = [b - b % 8 + 5 for b in _BASE]
MULT = _RNG.integers(0, 2**64, (2, 64), dtype=_U) | _U(1)
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POW.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (_BASE[which], pow(_BASE[which], -1, 2**64)):
            a = np.full(size, b, _U)
            a[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.multiply.accumulate(a))
        _POW[which] = have = tuple(out)
    return have


class Words:
    """The words of an Arrow string array, split at ASCII white space: byte spans, owning row, 64-bit hashes."""

    def __init__(self, texts: pa.Array, lower: bool = False, keys: int = 1):
        texts = pa.array(texts, pa.large_string()) if not isinstance(texts, pa.Array) else texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        n = len(texts)
        offs = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        data = data[offs[0] : offs[-1]]
        self.offsets = offs = offs - offs[0]
        self.data = LOWER[data] if lower else data
        self.raw = data
        inside = ~SPACE[data]
        before = np.empty(len(data), bool)
        if len(data):
            before[0] = False
            before[1:] = inside[:-1]
            before[offs[:-1][offs[:-1] < len(data)]] = False
            after = np.empty(len(data), bool)
            after[-1] = False
            after[:-1] = inside[1:]
            last = offs[1:] - 1
            after[last[last >= 0]] = False
            self.starts, self.ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.starts, offs)  # of each row's words; one more at the end
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(n), self.count)
        self.hash = [self._hash(k) for k in range(keys)]

    def _hash(self, which: int) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, _U)
        powers, inverse = _powers(which, len(self.data) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(self.data) + 1, _U)
            np.cumsum(_BYTE[which][self.data] * powers[: len(self.data)], out=total[1:])
            return mix((total[self.ends] - total[self.starts]) * inverse[self.starts] + (self.ends - self.starts).astype(_U) * MULT[which][63])

    def windows(self, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of k words inside a row, and the index of the first word of each."""
        h, n = self.hash[which], len(self.starts)
        if n < k:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        at = np.flatnonzero(self.row[: n - k + 1] == self.row[k - 1 :])
        with np.errstate(over="ignore"):
            total = h[: n - k + 1] * MULT[which][0]
            for j in range(1, k):
                total = total + h[j : n - k + 1 + j] * MULT[which][j]
        return mix(total[at]), at

    def text(self, i: int) -> bytes:
        return self.raw[self.offsets[i] : self.offsets[i + 1]].tobytes()
