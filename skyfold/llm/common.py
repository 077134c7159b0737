"""What several operators share: reading tables, words of a text, rolling window hashes."""

from __future__ import annotations

import ctypes
import secrets
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Separators of words, as classes of Java's regular expressions.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words between separators; null or blank text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def without(docs: DataFrame, output: str) -> DataFrame:
    """The table without an earlier column of the name that an operator is about to add."""
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != output.lower()])


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column has it."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of a text column over all rows: one scan with a partial sum."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Rolling:
    """Rabin-Karp hashes of all windows of a sequence, modulo 2^64 with an odd base, then mixed."""

    def __init__(self, base: int):
        self.base, self.powers, self.inverse = np.uint64(base | 1), np.ones(1, np.uint64), np.ones(1, np.uint64)
        self.base_inverse = np.uint64(pow(base | 1, -1, 1 << 64))

    def reach(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, 2 * len(self.powers))
            self.powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, self.base))])
            self.inverse = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, self.base_inverse))])

    def windows(self, values: np.ndarray, size: int) -> np.ndarray:
        count = len(values) - size + 1
        if count <= 0:
            return np.empty(0, np.uint64)
        self.reach(len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.powers[: len(values)], out=sums[1:])
        return mixed((sums[size:] - sums[:count]) * self.inverse[:count])


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of a hash (finalizer of MurmurHash3)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def lean(run: Callable) -> Callable:
    """``run`` for mapInArrow, returning freed memory to the system at the end of each task.

    Python workers serve task after task; what one stage has freed would stay with them, beside what the next one needs.
    """
    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
        if trim:
            trim(0)
    return wrapped


# Bases of the independent rolling hashes.
FIRST_BASE, SECOND_BASE = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


def run_seed() -> int:
    """Seed of the word hashes of one run, so that no text can be written to collide."""
    return secrets.randbits(63)


class ByteWords:
    """Seeded 64-bit hashes of the words of a text."""

    LONG = 4 << 20

    def __init__(self, seed: int):
        self.seed = seed

    def of(self, data: bytes) -> np.ndarray:
        if len(data) > self.LONG:  # bounds the list of words; a part ends where a word does
            half = data[:self.LONG].rpartition(b" ")[0]
            if half:
                return np.concatenate([self.of(half), self.of(data[len(half):])])
        found, digest, seed = data.split(), xxhash.xxh3_64_intdigest, self.seed  # bytes are split at the blank and 0x09-0x0D
        return np.fromiter((digest(w, seed) for w in found), np.uint64, len(found))


def running_totals(steps: Column, block: int = 64) -> Column:
    """Cumulative sums of an integer array.

    Sums go over blocks first, so an array of n values costs about n * (block + n / block) and not n * n additions.
    """
    total = lambda values: F.aggregate(values, F.lit(0), lambda a, x: a + x)
    part = lambda k: F.floor(k / block).cast("int")

    def with_sums(s):
        sums = F.transform(F.sequence(F.lit(0), part(F.size(s) - 1)), lambda b: total(F.slice(s, b * block + 1, block)))
        return F.struct(s.alias("s"), sums.alias("sums"))

    def with_starts(p):
        return F.struct(p["s"].alias("s"), F.transform(p["sums"], lambda x, b: total(F.slice(p["sums"], 1, b))).alias("starts"))

    def ends(p):
        return F.transform(p["s"], lambda x, k: F.get(p["starts"], part(k)) + total(F.slice(p["s"], part(k) * block + 1, k % block + 1)))

    # One-element arrays name values, so that each is computed once.
    named = F.transform(F.transform(F.transform(F.array(steps), with_sums), with_starts), ends)
    return F.when(F.size(steps) > 0, named[0]).otherwise(F.array().cast("array<int>"))
