"""Shared helpers of the training-data operators: scratch tables, hashing, names."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[tempfile.TemporaryDirectory] = []

#: Words whose hashes one Python worker remembers; beyond it the memory is cleared (results do not change).
WORD_CACHE = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where it is unset, a local one if Spark runs in one process; else an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.TemporaryDirectory(prefix="tallyspark-"))
        atexit.register(_LOCAL[0].cleanup)
    return _LOCAL[0].name


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2048) -> Iterator[None]:
    """What is run within sends at most so many rows at once to Python: a bound on workers' memory, results do not change."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release() -> None:
    """Gives memory of past Arrow batches back to the system: idle workers stay beside busy executors."""
    pa.default_memory_pool().release_unused()


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts lineage, survives lost executors."""
    path = f"{scratch_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, for temporary columns beside any it may have."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n = f"_{n}"
        have.add(n.lower())
        out.append(n)
    return out


def remainder(column: str, by: int):
    """crc32(column as text) mod by; a null counts as null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


def cut_points(df: DataFrame, column: str, rows_each: int) -> list[int]:
    """Values that split column into ranges of about rows_each rows: 8 bytes on the driver for each such range."""
    n = df.where(F.col(column).isNotNull()).count()
    parts = max(1, -(-n // rows_each))
    if parts == 1:
        return []
    at = df.approxQuantile(column, [i / parts for i in range(1, parts)], min(0.01, 0.2 / parts))
    return sorted({int(x) for x in at})


def range_of(column: str, cuts: list[int], leaf: int = 512):
    """How many cut points are at most the value, by binary search (of more than `leaf`: for a group of them, then counted in it):
    ranges in ascending order; null goes to range 0."""

    def search(lo: int, hi: int, at: list[int]) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"IF(`{column}` >= {at[mid]}L, {search(mid + 1, hi, at)}, {search(lo, mid, at)})"

    if len(cuts) <= leaf:
        return F.expr(search(0, len(cuts), cuts)) if cuts else F.lit(0)
    each = -(-len(cuts) // leaf)
    groups = [cuts[i : i + each] for i in range(0, len(cuts), each)]
    table = f"from_json('{json.dumps(groups, separators=(',', ':'))}', 'array<array<bigint>>')"  # a constant
    group = search(0, len(groups) - 1, [g[0] for g in groups[1:]])
    return F.expr(f"transform(array({group}), g -> g * {each} + size(filter(element_at({table}, g + 1), c -> c <= `{column}`)))[0]")


class WordHashes(dict):
    """64-bit hash of a word (bytes), remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


WORDS = WordHashes()
_FOLD, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text.

    A-Z are lower-cased; words are runs of bytes outside 0x20 and 0x09-0x0D. Fewer words than width
    make one shingle of them all; null, empty or wordless texts make none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    width = min(width, n)
    h = np.fromiter(map(WORDS.__getitem__, words), np.uint64, n)
    acc = h[: n - width + 1] ^ np.uint64(width)
    for i in range(1, width):
        acc = (acc ^ (acc >> _HALF)) * _FOLD + h[i : n - width + 1 + i]
    acc = (acc ^ (acc >> _HALF)) * _LAST
    return np.unique(acc ^ (acc >> _HALF))
