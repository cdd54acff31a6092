"""Nearest neighbours by additive quantisation.

Codebooks are full-dimensional: a vector is the sum of one code from each book. Books are trained on a bounded
sample by k-means of the residuals, then refitted together by least squares. Vectors are encoded by beam search;
a code row keeps the book entries, the norm of what they leave of the unit vector, and the vector. Queries score all rows by
lookup tables (inner products with every code). By Cauchy and Schwarz no cosine exceeds that score by more than the stored norm;
a row whose bound reaches the query's k-th best so far is scored exactly, so the neighbours found are those of brute force.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stash

BOOKS, CODES, BEAM, TRAIN_ROWS, ROUNDS, SEED = 8, 256, 8, 8192, 8, 5
#: Queries searched in one pass over the codes, rows scanned by a task.
QUERY_BLOCK, SCAN_ROWS = 2048, 16384
#: What rounding may take from a bound (lookups are sums of float32), and from an inner product.
BOUND_SLACK, SLACK = 1e-4, 1e-9


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)


def train_books(x: np.ndarray, books: int = BOOKS, codes: int = CODES) -> np.ndarray:
    """books x codes x dimension."""
    rng = np.random.RandomState(SEED)
    codes = min(codes, len(x))
    out = np.zeros((books, codes, x.shape[1]))
    rest = x.copy()
    for m in range(books):
        c = rest[rng.choice(len(x), codes, replace=False)].copy()
        for _ in range(ROUNDS):
            at = _nearest(rest, c)
            n = np.bincount(at, minlength=codes)
            total = np.zeros_like(c)
            np.add.at(total, at, rest)
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        out[m] = c
        rest = rest - c[_nearest(rest, c)]
    for _ in range(2):  # all books together, given the codes
        code, _ = encode(x, out)
        flat = code + np.arange(books) * codes
        both = np.zeros((books * codes, books * codes))
        for i in range(books):
            for j in range(books):
                np.add.at(both, (flat[:, i], flat[:, j]), 1.0)
        right = np.zeros((books * codes, x.shape[1]))
        for i in range(books):
            np.add.at(right, flat[:, i], x)
        out = np.linalg.solve(both + 0.1 * np.eye(len(both)), right + 0.1 * out.reshape(len(both), -1)).reshape(out.shape)
    return out


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x books) found by beam search, and norms of what they leave."""
    all_codes, all_norms = [], []
    k = books.shape[1]
    for at in range(0, len(x), 512):
        part = x[at : at + 512]
        n = len(part)
        state, code = np.zeros((n, 1, x.shape[1])), np.zeros((n, 1, 0), np.int64)
        for book in books:
            # |x - s - c|^2 less |x|^2, for each beam entry s and code c
            rest = part[:, None, :] - state
            cost = (rest**2).sum(axis=2)[:, :, None] - 2 * rest @ book.T + (book**2).sum(axis=1)
            flat = cost.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            s, c = best // k, best % k
            rows = np.arange(n)[:, None]
            state = state[rows, s] + book[c]
            code = np.concatenate([code[rows, s], c[:, :, None]], axis=2)
        best = ((part[:, None, :] - state) ** 2).sum(axis=2).argmin(axis=1)
        rows = np.arange(n)
        all_codes.append(code[rows, best])
        all_norms.append(np.sqrt(((part - state[rows, best]) ** 2).sum(axis=1)))
    return np.concatenate(all_codes), np.concatenate(all_norms)


def _valid(df: DataFrame) -> DataFrame:
    """vec_id, v: vectors of doubles with a direction."""
    v = F.col("embedding").cast("array<double>")
    rows = df.select("vec_id", v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    rows = rows.where(F.expr("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))") & F.expr("exists(v, x -> x != 0)"))
    return rows


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows over their largest component, and the norms of those."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x, np.sqrt((x * x).sum(axis=1))


def _unit(x: np.ndarray) -> np.ndarray:
    x, norm = _scaled(x)
    return x / norm[:, None]


class _Best:
    """The k nearest rows of each query so far: cosines in descending order, ties by the smaller vec_id."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, books: np.ndarray, k: int):
        self.ids, self.k, self.scored = ids, k, 0
        self.x, self.norm = _scaled(q)
        self.unit = self.x / self.norm[:, None]
        self.tables = [(self.unit @ book.T).astype(np.float32) for book in books]
        self.s, self.v = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, vec: np.ndarray, code: np.ndarray, left: np.ndarray, v: np.ndarray) -> None:
        """Rows by vec_id, codes, norms of what codes leave, and vectors."""
        x, norm = _scaled(v)
        unit, bound = x / norm[:, None], (left + BOUND_SLACK).astype(np.float32)
        for lo in range(0, len(self.ids), 256):
            q = slice(lo, lo + 256)
            most = np.repeat(bound[None], len(self.ids[q]), axis=0)
            for j, table in enumerate(self.tables):
                most += table[q][:, code[:, j]]
            kth = self.s[q, -1:]
            may = (most >= kth) & (self.ids[q, None] != vec)
            self.scored += int(may.sum())
            some = np.flatnonzero(may.any(axis=0))
            if not len(some):
                continue
            score = np.where(may[:, some], self.unit[q] @ unit[some].T, -np.inf)
            if len(some) > self.k and not np.isfinite(kth).all():  # else what reaches the k-th best is little
                kth = np.maximum(kth, -np.partition(-score, self.k - 1, axis=1)[:, self.k - 1 : self.k])
            i, at = np.nonzero((score >= kth - SLACK) & np.isfinite(score))
            at, i = some[at], i + lo
            s = np.concatenate([(self.x[i[n : n + 65536]] * x[at[n : n + 65536]]).sum(axis=1) for n in range(0, len(i), 65536)] or [np.zeros(0)]) / (self.norm[i] * norm[at])
            for query, a, b in zip(*_runs(i), strict=True):
                all_s, all_v = np.append(self.s[query], s[a:b]), np.append(self.v[query], vec[at[a:b]])
                first = np.lexsort((all_v, -all_s))[: self.k]
                self.s[query], self.v[query] = all_s[first], all_v[first]


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of an ascending array, and where each begins and ends."""
    value, start = np.unique(x, return_index=True)
    return value, start, np.append(start[1:], len(x))[: len(start)]


def search(df: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: of each query row, the k other rows of largest cosine.

    df(vec_id, embedding). Vectors that are null, empty, zero, or hold null or non-finite components take no part; nor do
    those of another length than most have (ties: the longer). Ties in score go to the smaller vec_id. Rows that repeat a
    vec_id count once: the first by its components. Other columns are not read. With fewer rows than k, all are returned;
    an empty table, or one without queries, gives an empty result.
    """
    spark = df.sparkSession
    rows = _valid(df)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    rows = stash(rows.where(F.size("v") == lengths["d"]).groupBy("vec_id").agg(F.min("v").alias("v")), "aq-vectors")
    n = rows.count()
    draw = F.pmod(F.xxhash64(F.lit("aq"), "vec_id"), F.lit(1_000_000)) < 1_000_000 * min(1.0, TRAIN_ROWS / n)
    sample = rows.where(draw).select("vec_id", "v").collect()
    sample = np.array([r["v"] for r in sorted(sample, key=lambda r: r["vec_id"])] or [rows.first()["v"]])
    books = spark.sparkContext.broadcast(train_books(_unit(sample)))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                code, left = encode(_unit(_matrix(b.column(1))), books.value)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.tobytes() for c in code.astype(np.uint8)], pa.binary()), pa.array(left), b.column(1)], names=["vec_id", "code", "left", "v"])

    codes = stash(rows.mapInArrow(encoded, "vec_id long, code binary, left double, v array<double>"), "aq-codes")
    scans = max(1, -(-n // SCAN_ROWS))
    queries = rows.where(is_query).select("vec_id", "v")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    found = None
    for i in range(blocks):
        here = queries.where(F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.lit(blocks)) == i).collect()
        if not here:
            continue
        block = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in here]), np.array([r["v"] for r in here])))

        def scanned(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            ids, q = block.value
            best, m = _Best(ids, q, books.value, k), len(books.value)
            for b in batches:
                for at in range(0, b.num_rows, 2048):
                    part = b.slice(at, 2048)
                    code = np.frombuffer(b"".join(x.as_py() for x in part.column(1)), np.uint8).reshape(part.num_rows, m)
                    vec, left = part.column(0).to_numpy(zero_copy_only=False), part.column(2).to_numpy(zero_copy_only=False)
                    best.add(vec, code, left, _matrix(part.column(3)))
            i, j = np.nonzero(np.isfinite(best.s))
            yield pa.RecordBatch.from_arrays([pa.array(ids[i], pa.int64()), pa.array(best.v[i, j], pa.int64()), pa.array(best.s[i, j])], names=["query_id", "vec_id", "score"])

        some = stash(codes.coalesce(scans).mapInArrow(scanned, "query_id long, vec_id long, score double"), "aq-found")
        found = some if found is None else found.union(some)
    if found is None:
        return spark.createDataFrame([], schema)
    # the k best of each scan hold the k best of all
    top = found.groupBy("query_id").agg(F.expr(f"slice(array_sort(collect_list(struct(-score AS s, vec_id AS v))), 1, {k})").alias("c"))
    top = top.select("query_id", F.posexplode("c").alias("rank", "x"))
    return top.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.v").alias("vec_id"), (-F.col("x.s")).alias("score"))
