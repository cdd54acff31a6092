"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are 1- to 3-grams of lower-cased letters (each run of other characters is one space), hashed to 2^14 columns;
log counts times inverse document frequency, scaled to length 1. Document frequencies are counted over all training rows. Weights are
trained by follow-the-regularised-leader with elastic-net penalties on a bounded sample (SAMPLE documents at most, in
expectation, the same number for each language); a fifth of the sample is kept out of that to fit the temperature, against
targets smoothed by one row. Scores then get the languages' shares of all training rows as a prior.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fresh, release, remainder

COLUMNS, SAMPLE, EPOCHS = 1 << 14, 2400, 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.02, 0.02
UNKNOWN = "und"
_MUL = [np.uint32(m) for m in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)]
_SHIFT = np.uint32(32 - 14)
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Columns and log counts of a whole text's n-grams; None if it has no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[points]
    if not is_letter.any():
        return None
    first = np.empty(len(points), bool)
    first[0], first[1:] = True, is_letter[:-1]
    keep = is_letter | first
    c = np.where(is_letter, points, np.uint32(32))[keep].astype(np.uint32)
    if c[0] != 32:
        c = np.concatenate([np.array([32], np.uint32), c])
    if c[-1] != 32:
        c = np.concatenate([c, np.array([32], np.uint32)])
    one = c * _MUL[0]
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * _MUL[1] + c[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * _MUL[2] + c[2:]
    mixed = np.concatenate([one, two * _MUL[0], three * _MUL[0]])
    counts = np.bincount((mixed ^ (mixed >> np.uint32(16))) * _MUL[1] >> _SHIFT, minlength=COLUMNS)
    at = np.flatnonzero(counts)
    return at, np.log1p(counts[at])


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.langs, self.idf, self.weights, self.bias = langs, idf, weights, bias
        self.heat, self.prior = 1.0, np.zeros(len(langs))

    def logits(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        x = tf * self.idf[at]
        return self.weights[:, at] @ (x / np.sqrt(x @ x)) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        found = grams(text)
        if found is None or not self.langs:
            return UNKNOWN, 0.0
        z = self.logits(*found) / self.heat + self.prior
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.langs[k], float(p[k] / p.sum())


def train(langs: list[str], idf: np.ndarray, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> Model:
    """rows: (language's number, columns, log counts), in the order to learn in; every fifth is kept for the temperature."""
    k, learn, held = len(langs), [r for i, r in enumerate(rows) if i % 5], rows[::5]
    z, n, w = np.zeros((k, COLUMNS)), np.zeros((k, COLUMNS)), np.zeros((k, COLUMNS))
    zb, nb, bias = np.zeros(k), np.zeros(k), np.zeros(k)
    for _ in range(EPOCHS):
        for y, at, tf in learn:
            x = tf * idf[at]
            x = x / np.sqrt(x @ x)
            s = w[:, at] @ x + bias
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g, zi, ni = p[:, None] * x, z[:, at], n[:, at]
            nn = ni + g * g
            zi = zi + g - (np.sqrt(nn) - np.sqrt(ni)) / ALPHA * w[:, at]
            z[:, at], n[:, at] = zi, nn
            w[:, at] = np.where(np.abs(zi) <= L1, 0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(nn)) / ALPHA + L2))
            new = nb + p * p
            zb += p - (np.sqrt(new) - np.sqrt(nb)) / ALPHA * bias
            nb, bias = new, -zb / ((BETA + np.sqrt(new)) / ALPHA + L2)
    model = Model(langs, idf, w, bias)
    if held and k > 1:
        scores = np.array([model.logits(at, tf) for _, at, tf in held])
        right = np.array([y for y, _, _ in held])

        target = np.full(scores.shape, 1 / (len(right) + 2) / (k - 1))
        target[np.arange(len(right)), right] = 1 - 1 / (len(right) + 2)

        def loss(heat):
            s = scores / heat
            top = s.max(axis=1)
            log_p = s - top[:, None] - np.log(np.exp(s - top[:, None]).sum(axis=1))[:, None]
            return float(-(log_p * target).sum(axis=1).mean())

        model.heat = min(np.geomspace(0.05, 5, 60), key=loss)
    return model


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COLUMNS + 1, np.int64)
    for b in batches:
        for text in b.column(0):
            if (found := grams(text.as_py())) is not None:
                total[found[0]] += 1
                total[COLUMNS] += 1
        release()
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["col", "n"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [(k, o, *found) for k, o, t in zip(*(c.to_pylist() for c in b.columns), strict=True) if (found := grams(t)) is not None]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2].astype("<i4").tobytes() for r in out], pa.binary()), pa.array([r[3].astype("<f4").tobytes() for r in out], pa.binary())], names=["lang", "o", "at", "tf"])


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """docs(doc_id, text, lang), the training rows."""
    df = docs.select("text").mapInArrow(_document_counts, "col int, n long").groupBy("col").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(COLUMNS + 1)
    seen[[r["col"] for r in df]] = [r["n"] for r in df]
    idf = np.log((1 + seen[COLUMNS]) / (1 + seen[:COLUMNS])) + 1
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], idf, np.zeros((0, COLUMNS)), np.zeros(0))
    order = F.xxhash64(F.lit("lang"), "doc_id")
    each = sample / len(langs)
    rate = F.element_at(F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, each / sizes[k])))]), F.col("lang"))
    some = docs.where(F.pmod(order, F.lit(1_000_000)) < rate * 1_000_000)
    rows = some.select("lang", order.alias("o"), "text").mapInArrow(_sampled, "lang string, o long, at binary, tf binary").collect()
    number = {k: i for i, k in enumerate(langs)}
    rows = sorted(rows, key=lambda r: (r["o"], r["lang"]))
    model = train(langs, idf, [(number[r["lang"]], np.frombuffer(r["at"], "<i4"), np.frombuffer(r["tf"], "<f4").astype(float)) for r in rows])
    model.prior = np.log([sizes[k] / sum(sizes.values()) * len(langs) for k in langs])
    return model


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, a row for each row of docs.

    Learns from text and non-null lang of documents whose crc32(doc_id) mod 5 is not 0 (a null doc_id is held out).
    Texts that are null or have no letter are `und` with score 0, as are all where no language is known. Score: the
    calibrated probability of the language. Ties go to the first language by name. An empty table gives an empty result.
    """
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(True))
    model = learn(docs.where(~held & F.col("lang").isNotNull()).select("doc_id", "text", "lang"))
    return _apply(docs.select("doc_id", held.alias("held_out"), "text"), model)


def _apply(rows: DataFrame, model: Model) -> DataFrame:
    seen = rows.sparkSession.sparkContext.broadcast(model)

    def predicted(batches):
        m = seen.value
        for b in batches:
            out = [m.predict(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])
            release()

    return rows.mapInArrow(predicted, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The rows of docs whose language is known with a score of at least `least`, with all columns.

    A row that repeats a doc_id goes only if all its rows go.
    """
    (did,) = fresh(docs, "lang_doc")
    good = identify(docs).where(F.col("lang_pred").isin(UNKNOWN) == F.lit(False)).where(F.col("score") >= least).select(F.col("doc_id").alias(did)).distinct()
    return docs.join(good, docs["doc_id"].eqNullSafe(good[did]), "left_semi")
