"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch holds every five-word shingle hash below 1/SCALE of the hash range, so sketches of any two texts can be
compared and merged (union) whatever their lengths: shared hashes estimate containment in either text. SCALE is 1, so that
short texts are told apart too: sketches are the full sets, and what they give is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut_points, range_of, release, shingles

SCALE = 1
#: Rows in a range of doc_ids; ranges keep neighbours together. Rows that are returned together.
RANGE_ROWS, TOGETHER = 4096, 512


def sketch(text: str | None, scale: int = SCALE) -> np.ndarray:
    """Sorted retained hashes of a whole text; null, empty and wordless texts retain none."""
    found = shingles(text)
    return found[: np.searchsorted(found, np.uint64(2**64 // scale))] if scale > 1 else found


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of both texts' shingles together."""
    return np.union1d(a, b)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of a's shingles that b has, estimated if the scale is over 1; 0 where a retains none."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 0.0


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity, estimated if the scale is over 1; 1 where neither retains a hash."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def to_text(a: np.ndarray) -> str:
    return a.astype(">u8").tobytes().hex()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u8").astype(np.uint64)


def edited(text: str, following: str) -> str:
    """The last third (rounded down) replaced by as much of the following text's beginning as there is."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows range, guest, doc_id, text, in order; a range's rows, then guest rows, the first of which follows them."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    last = None

    def row(part, doc_id, text, own, after, after_own):
        new = edited(text, after)
        its = sketch(new)
        return doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), to_text(own), to_text(its), likeness(own, its), likeness(own, after_own)

    for whole in batches:
        for at in range(0, max(1, whole.num_rows), TOGETHER):
            out = []
            for part, guest, doc_id, text in zip(*(c.to_pylist() for c in whole.slice(at, TOGETHER).columns), strict=True):
                if guest and last is None:
                    continue
                text = text or ""
                own = sketch(text)
                if last is not None:
                    out.append(row(*last, text, own))
                last = None if guest else (part, doc_id, text, own)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names=names)
        release()


def fingerprints(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, a row for each row of docs.

    The next document is the next row by doc_id descending (null doc_ids last; rows that repeat a doc_id by text), after the last
    the first. Null texts count as empty. A single row follows itself. An empty table gives an empty result. Texts
    are dealt into ranges of doc_id; each range also gets the first rows of the range that follows it.
    """
    docs = docs.select("doc_id", "text")
    cuts = cut_points(docs, "doc_id", range_rows)
    rows = docs.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(range_of("doc_id", cuts)))
    tops = sorted(((r["part"], r["top"]) for r in rows.groupBy("part").agg(F.max("doc_id").alias("top")).collect()), reverse=True)
    if not tops:
        return docs.mapInArrow(_pairs_empty, _SCHEMA)
    # the range before each: the first row (largest doc_id) of a range is a guest of the one before it
    hosts = {part: tops[i - 1][0] for i, (part, _) in enumerate(tops)}
    known = [(part, hosts[part], top) for part, top in tops]
    table = docs.sparkSession.createDataFrame(known, "part int, host int, top long")  # a row for each range
    tagged = rows.join(F.broadcast(table), "part")
    first = F.col("doc_id").eqNullSafe(F.col("top"))
    dealt = tagged.select("doc_id", "text", F.explode(F.when(first, F.array(F.struct(F.col("part"), F.lit(0).alias("guest")), F.struct(F.col("host").alias("part"), F.lit(1).alias("guest")))).otherwise(F.array(F.struct(F.col("part"), F.lit(0).alias("guest"))))).alias("x"))
    dealt = dealt.select(F.col("x.part").alias("part"), F.col("x.guest").alias("guest"), "doc_id", "text")
    # ranges in order, about one in a task: by hash some tasks would get several and others none
    dealt = dealt.repartitionByRange(max(1, len(tops)), "part").sortWithinPartitions("part", "guest", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    return dealt.mapInArrow(_pairs, _SCHEMA)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs_empty(batches):
    yield from ()
