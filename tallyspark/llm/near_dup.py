"""MinHash near-duplicates by a multi-index Hamming join.

A document's set holds the hashes of its distinct five-word shingles. Its signature has 64 symbols of 16 bits,
one for each of 64 min-hashes. Documents are candidates if at most 31 symbols differ: the signature is split into 16
chunks of 4 symbols, and by the pigeonhole principle one chunk at least differs in no more than one symbol, so
each chunk is indexed 4 times, each time without one of its symbols (the allowed chunk error). A pair at
similarity 0.75 stays within distance 31 with probability over 0.9999. Candidates are confirmed on full sets.

Equal sets are one class before anything is joined. In each index bucket all members are first compared with its head (the one that meets most others in all);
then only members of buckets that still hold several components are compared with each other, in blocks, by exact bounds of
what they can have in common, so a large group of near copies gives links and few pairs beside them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fresh, release, shingles, stash

SYMBOLS, CHUNK, ERRORS = 64, 4, 31
#: Members of a bucket that one task compares with each other or with as many others.
BLOCK = 1024
CHUNKS = SYMBOLS // CHUNK
_ODD = np.random.RandomState(20240607).randint(1, 2**62, SYMBOLS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def signature(found: np.ndarray) -> np.ndarray:
    """16 longs of four 16-bit symbols each."""
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 4096):
        np.minimum(low, (found[i : i + 4096] * _ODD[:, None]).min(axis=1), out=low)
    low = (low ^ (low >> np.uint64(29))) * _MIX
    return (low >> np.uint64(48)).astype("<u2").view("<i8")


def set_id(found: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(found.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, n, hi, lo, sig = b.column(0), [], [], [], []
        for text in b.column(1):
            found = shingles(text.as_py())
            n.append(len(found))
            a, z = set_id(found) if len(found) else (None, None)
            hi.append(a)
            lo.append(z)
            sig.append(signature(found) if len(found) else None)
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sig, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "hi", "lo", "sig"])
        release()


def _keys() -> Column:
    lanes = [~(0xFFFF << (16 * d)) & 0xFFFFFFFFFFFFFFFF for d in range(CHUNK)]
    signed = [m - 2**64 if m >= 2**63 else m for m in lanes]
    return F.explode(F.array(*[F.xxhash64(F.lit(c * CHUNK + d), F.col("sig")[c].bitwiseAND(F.lit(m))) for c in range(CHUNKS) for d, m in enumerate(signed)]))


def symbol_distance(a: str, b: str) -> Column:
    """Symbols in which two signatures differ."""
    signed = lambda m: m - 2**64 if m >= 2**63 else m
    step = "x"
    for bits, mask in ((8, 0xFF00FF00FF00FF00), (4, 0x00F000F000F000F0), (2, 0x000C000C000C000C), (1, 0x0002000200020002)):
        step = f"({step} | shiftrightunsigned({step} & {signed(mask)}L, {bits}))" if bits == 8 else f"aggregate(array({step}), 0L, (s, y) -> y | shiftrightunsigned(y & {signed(mask)}L, {bits}))"
    return F.expr(f"aggregate(zip_with({a}, {b}, (p, q) -> p ^ q), 0, (n, x) -> n + CAST(bit_count({step} & {0x0001000100010001}L) AS INT))")


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows a, b, a_hi, b_hi, a_text, b_text; those whose texts have the class's set and enough in common."""
    kept: dict[tuple, np.ndarray] = {}

    def sets(key, text):
        if key not in kept:
            if len(kept) >= 64:
                kept.clear()
            kept[key] = shingles(text)
        return kept[key]

    for batch in batches:
        out: list[tuple[int, int]] = []
        for a, b, a_hi, b_hi, s, t in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            x, y = sets((a, a_hi, hash(s)), s), shingles(t)
            if set_id(x)[0] != a_hi or set_id(y)[0] != b_hi:
                continue  # another row with the same doc_id
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= 75 * (len(x) + len(y) - both):
                out.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])
        release()


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows cid, hi, n, sig, text: how many shingles fall in each of 256 ranges of the hash, for texts that have the class's set."""
    for b in batches:
        keep, out = [], []
        for i, (hi, text) in enumerate(zip(b.column(1).to_pylist(), b.column(4).to_pylist(), strict=True)):
            if set_id(found := shingles(text))[0] == hi:
                keep.append(i)
                out.append(np.bincount((found >> np.uint64(56)).astype(np.int64), minlength=256).astype("<u4").tobytes())
        rows = b.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), rows.column(3), pa.array(out, pa.binary())], names=["cid", "n", "sig", "profile"])
        release()


def _compared(rows: pa.Table) -> pa.Table:
    """Pairs of one bucket's members (of two blocks of them) in different components that may be similar enough.

    By their sizes, by their signatures, and by the ranges of the hash: two sets have no more in common than the sum of the smaller count of each range.
    """
    p, q = rows.column("p")[0].as_py(), rows.column("q")[0].as_py()
    own, cid, comp, n = (rows.column(c).to_numpy() for c in ("own", "cid", "comp", "n"))
    sig = np.array(rows.column("sig").to_pylist(), "<i8").view("<u2").reshape(len(cid), SYMBOLS)
    profile = np.frombuffer(b"".join(rows.column("profile").to_pylist()), "<u4").reshape(len(cid), 256).astype(np.int32)
    one, two = (np.flatnonzero(own == p), np.flatnonzero(own == q))
    out_a, out_b = [], []
    for i in one:
        j = two[(comp[two] != comp[i]) & (100 * np.minimum(n[two], n[i]) >= 75 * np.maximum(n[two], n[i]))]
        if p == q:
            j = j[cid[j] > cid[i]]
        if len(j):
            j = j[(sig[j] != sig[i]).sum(axis=1) <= ERRORS]
        if len(j):
            most = np.minimum(profile[j], profile[i]).sum(axis=1)
            j = j[100 * most >= 75 * (n[j] + n[i] - most)]
            out_a.append(np.minimum(cid[j], cid[i]))
            out_b.append(np.maximum(cid[j], cid[i]))
    none = np.empty(0, np.int64)
    return pa.table({"a": np.concatenate([none, *out_a]), "b": np.concatenate([none, *out_b])})


def components(edges: DataFrame) -> DataFrame:
    """node, comp (smallest node it reaches) for every node of edges(a, b): alternating large and small stars, a table each round."""
    cur = stash(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "cc")
    said = None
    while True:
        state = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(state) == said or not state[0]:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(cur.select("v", "v").distinct())
        said = tuple(state)
        both = cur.union(cur.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stash(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(low)
        cur = stash(small.distinct(), "cc")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id), a row for each row of docs.

    Null, empty and wordless texts have 0 shingles, link with nothing and are kept. A null doc_id takes no part in
    links and is kept, its component null. Rows that repeat a doc_id are all returned; they join the component of
    their own text. Other columns are not read. An empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    feats = stash(docs.mapInArrow(_features, "doc_id long, n_shingles long, hi long, lo long, sig array<long>"), "nd-sets")
    part = feats.where("hi IS NOT NULL AND doc_id IS NOT NULL")
    classes = stash(part.groupBy("hi", "lo").agg(F.min("doc_id").alias("cid"), F.min("n_shingles").alias("n"), F.min("sig").alias("sig")), "nd-classes")

    rows = classes.select("cid", _keys().alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    met = stash(rows.join(sizes, "key"), "nd-buckets")
    # a bucket's head is the member that meets most others over all its buckets: of copies, most often their original
    degree = stash(met.groupBy("cid").agg(F.sum("members").alias("degree")), "nd-degree")
    heads = met.join(degree, "cid").groupBy("key").agg(F.max(F.struct("degree", (-F.col("cid")).alias("c"))).alias("h"))
    met = stash(met.select("key", "cid").join(heads.select("key", (-F.col("h.c")).alias("head")), "key").where("cid != head"), "nd-stars")

    def confirmed(pairs: DataFrame) -> DataFrame:
        one = classes.select(F.col("cid").alias("a"), F.col("hi").alias("a_hi"), F.col("n").alias("a_n"), F.col("sig").alias("a_sig"))
        two = classes.select(F.col("cid").alias("b"), F.col("hi").alias("b_hi"), F.col("n").alias("b_n"), F.col("sig").alias("b_sig"))
        near = pairs.join(two, "b").join(one, "a").where(F.expr("100 * least(a_n, b_n) >= 75 * greatest(a_n, b_n)") & (symbol_distance("a_sig", "b_sig") <= ERRORS))
        near = stash(near.select("a", "b", "a_hi", "b_hi"), "nd-pairs")
        text = docs.where("doc_id IS NOT NULL")
        full = near.join(text.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text")), "b").join(text.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text")), "a")
        return full.select("a", "b", "a_hi", "b_hi", "a_text", "b_text").mapInArrow(_confirm, "a long, b long")

    links = stash(confirmed(met.select(F.least("head", "cid").alias("a"), F.greatest("head", "cid").alias("b")).distinct()), "nd-links")
    comp = stash(components(links), "nd-comp")

    # what is left: members of one bucket, beside its head, that are in different components so far
    here = met.join(comp.withColumnRenamed("node", "cid"), "cid", "left").select("key", "cid", F.coalesce("comp", "cid").alias("comp"))
    ranges = here.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("members")).where("c0 < c1")
    left = stash(here.join(ranges.select("key", F.expr(f"CAST(ceil(members / {BLOCK}) AS INT)").alias("blocks")), "key"), "nd-left")
    who = left.select("cid").distinct().join(classes, "cid")
    profiles = docs.join(who, docs["doc_id"] == who["cid"]).select("cid", "hi", "n", "sig", "text").mapInArrow(_profiles, "cid long, n long, sig array<long>, profile binary")
    blocks = left.join(stash(profiles.dropDuplicates(["cid"]), "nd-profiles"), "cid").withColumn("own", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other"))
    rest = blocks.select("key", "p", "q", "own", "cid", "comp", "n", "sig", "profile").groupBy("key", "p", "q").applyInArrow(_compared, "a long, b long").distinct()
    more = stash(confirmed(rest), "nd-more")
    if more.head(1):
        comp = stash(components(more.union(links)), "nd-comp")

    named = stash(classes.join(comp.withColumnRenamed("node", "cid"), "cid", "left").select("hi", "lo", F.coalesce("comp", "cid").alias("component")), "nd-named")
    out = feats.select("doc_id", "n_shingles", "hi", "lo").join(named, ["hi", "lo"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: every column of docs, one row of each kept doc_id.

    Rows without doc_id stay, all of them. Of rows that repeat a kept doc_id, one stays.
    """
    (out,) = fresh(docs, "nd_id")
    keep = near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(out)).distinct()
    known = docs.join(keep, docs["doc_id"] == keep[out], "left_semi")
    return known.dropDuplicates(["doc_id"]).select(docs.columns).union(docs.where("doc_id IS NULL").select(docs.columns))
