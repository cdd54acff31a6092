"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of each whole text are standardised with means and deviations of the training rows; RFF cosines of seeded
Gaussian projections approximate a Gaussian kernel over them. The normal equations are summed over partitions and
then over the cluster, by fold of the training rows, so only their fixed number of cells reaches the driver. It solves the
ridge system of all folds, which scores, and for each fold that of the others: by it the fold's rows, which it has not
seen, are scored for the calibration. Those scores are counted in fixed bins and made monotone by pooling adjacent violators.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fresh, release, remainder, stash

FEATURES, WIDTH, RIDGE, BINS, SEED, FOLDS = 256, 1.0, 1e-3, 2000, 11, 3
_CLASSES = [bytes(c for c in range(128) if test(chr(c))) for test in (str.isupper, str.islower, str.isdigit, lambda c: c in "#$%&*|<>{}[]\\^~=+_@/", lambda c: c in ".,;:!?'\"()-", lambda c: c in "!?", lambda c: c in " \t\n\r\x0b\x0c")]
_REPEAT = re.compile(rb"([^\sa-zA-Z0-9])\1")
STATS = 20


def statistics(text: str | None) -> list[float]:
    """STATS numbers about a whole text; null counts as empty."""
    b = (text or "").encode("utf-8", "surrogatepass")
    n = len(b) or 1
    counts = [len(b) - len(b.translate(None, c)) for c in _CLASSES]
    upper, lower, digit, odd, stop, shout, space = (c / n for c in counts)
    words = b.split()
    w = len(words) or 1
    kinds = len(set(words))
    lines = [x for x in b.split(b"\n") if x.strip()]
    few = max(1, len(lines))
    ends = sum(x[-1] in b"#$%&*|!" for x in words)
    letters = len(b) - len(b.translate(None, bytes([*range(65, 91), *range(97, 123), *range(128, 256)])))
    seen = np.bincount(np.frombuffer(b, np.uint8), minlength=256) / n
    seen = seen[seen > 0]
    long = sum(len(x) > 15 for x in words)
    return [
        math.log1p(len(words)), upper, lower, digit, odd, stop, shout, space, letters / n, (len(b) / w), kinds / w,
        kinds / math.sqrt(w), len(set(lines)) / few, math.log1p(len(lines)), math.log1p(w / few), ends / w, long / w,
        float(-(seen * np.log(seen)).sum()), len(_REPEAT.findall(b)) / w, counts[0] / (counts[0] + counts[1] + 1),
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [statistics(x.as_py()) for x in b.column(b.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(rows, pa.list_(pa.float64()))], names=[*b.schema.names[:-1], "stats"])
        release()


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    dev: np.ndarray
    weights: np.ndarray | None
    steps: tuple[np.ndarray, np.ndarray]

    def features(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.RandomState(SEED)
        z = np.clip((stats - self.mean) / self.dev, -6, 6)
        d = z.shape[1]
        waves = np.cos(z @ (rng.normal(size=(d, FEATURES)) / (WIDTH * math.sqrt(d))) + rng.uniform(0, 2 * math.pi, FEATURES))
        return np.hstack([waves * math.sqrt(2 / FEATURES), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.full(len(stats), 0.5) if self.weights is None else self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.steps[0]):
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.raw(stats), *self.steps), 0.0, 1.0)


def isotonic(x: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of a non-decreasing line through the pooled bins: x ascending, good of n rows labelled 1."""
    pools: list[list[float]] = []
    for a, g, m in zip(x, good, n, strict=True):
        pools.append([a * m, g, m])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            top = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], top, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fit(stats: DataFrame, d: int = STATS) -> Model:
    """stats(stats array, y int, fold int): a model of P(y = 1). Without rows of both labels the score is constant."""
    aggs = [f(F.col("stats")[i]).alias(f"{k}{i}") for i in range(d) for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    one = stats.agg(F.count("*").alias("n"), F.sum("y").alias("good"), *aggs).first()
    if not one["n"]:
        return Model(np.zeros(d), np.ones(d), None, (np.empty(0), np.empty(0)))
    mean = np.array([one[f"m{i}"] for i in range(d)])
    dev = np.array([one[f"s{i}"] for i in range(d)])
    model = Model(mean, np.where(dev > 1e-9, dev, 1.0), None, (np.zeros(1), np.array([one["good"] / one["n"]])))
    if one["good"] in (0, one["n"]):
        return model
    size = FEATURES + 1
    upper = np.triu_indices(size, 0, size + 1)  # the features' products are symmetric; the last column is that with y

    def split(batch):
        fold = batch.column(2).to_numpy(zero_copy_only=False)
        x, y = np.array(batch.column(0).to_pylist()), batch.column(1).to_numpy(zero_copy_only=False)
        return ((int(k), x[fold == k], y[fold == k]) for k in np.unique(fold))

    def equations(batches):
        total = {}
        for b in batches:
            for k, stats_of, y in split(b):
                x = model.features(stats_of)
                total[k] = total.get(k, 0.0) + x.T @ np.hstack([x, y[:, None].astype(float)])
        cell = pa.array(np.arange(len(upper[0]), dtype=np.int32))
        for k, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), k, np.int32)), cell, pa.array(sums[upper])], names=["fold", "cell", "v"])

    cells = stats.select("stats", "y", "fold").mapInArrow(equations, "fold int, cell int, v double").groupBy("fold", "cell").agg(F.sum("v").alias("v")).toArrow()
    fold, cell, v = (cells.column(c).to_numpy() for c in ("fold", "cell", "v"))
    sums = np.zeros((FOLDS, size, size + 1))
    sums[fold, upper[0][cell], upper[1][cell]] = v

    def solve(both):
        products = np.triu(both[:, :size]) + np.triu(both[:, :size], 1).T
        rows = max(products[-1, -1], 1.0)  # the last feature is 1
        return np.linalg.solve(products + RIDGE * rows * np.eye(size) / FEATURES, both[:, size])

    others = [Model(model.mean, model.dev, solve(sums.sum(axis=0) - sums[k]), model.steps) for k in range(FOLDS)]

    def binned(batches):
        for b in batches:
            for k, stats_of, y in split(b):
                at = np.clip(np.floor((others[k].raw(stats_of) + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(y.astype(np.int64))], names=["bin", "y"])

    bins = stats.select("stats", "y", "fold").mapInArrow(binned, "bin int, y long").groupBy("bin").agg(F.sum("y").alias("g"), F.count("*").alias("n")).collect()
    bins = sorted((r["bin"], r["g"], r["n"]) for r in bins)
    x, g, n = (np.array(v, float) for v in zip(*bins, strict=True))
    return Model(model.mean, model.dev, solve(sums.sum(axis=0)), isotonic((x + 0.5) / BINS * 2 - 0.5, g, n))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, a row for each row of docs.

    Learns from labels.quality (0 or 1; other values and nulls are left out) of documents whose crc32(doc_id) mod 3 is not 1;
    a null doc_id is held out. Labels that repeat a doc_id count once (the largest). Null texts score as empty ones.
    Only texts and labels are read. Without labels every score is 0.5; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(True)).alias("held_out"), "text")
    stats = stash(rows.mapInArrow(_measure, "doc_id long, held_out boolean, stats array<double>"), "quality")
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    train = stash(stats.where("NOT held_out").join(known, "doc_id").select("stats", "y", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold")), "quality-train")
    model = fit(train)

    def scored(batches):
        for b in batches:
            s = model.score(np.array(b.column(2).to_pylist()).reshape(-1, STATS)) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return stats.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs with a score of 0.5 or more, with all columns. A row that repeats a doc_id goes only if all its rows go."""
    (did,) = fresh(docs, "quality_doc")
    good = score_quality(docs, labels).where("predicted = 1").select(F.col("doc_id").alias(did)).distinct()
    return docs.join(good, docs["doc_id"].eqNullSafe(good[did]), "left_semi")
