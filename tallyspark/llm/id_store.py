"""Token ids in shards of separately compressed documents with a shared zstandard dictionary.

A shard: the magic TIDS0001; the dictionary's sha256; the number of documents (u64); an index of (doc_id, offset,
length, tokens) as 4 i64 for each document, in ascending doc_id order; the frames. A document's frame is the zstandard
compression of its ids as little-endian u32, with the dictionary. One document is read by its index entry alone. Shards
are rows of a Parquet table, numbered in doc_id order, so that any store Spark writes to can hold them.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import cut_points, release, scratch_root, small_batches

MAGIC, END = b"TIDS0001", 2
#: Documents of a range and bytes of a shard, about; documents the dictionary is trained on, and its bytes.
RANGE_ROWS, SHARD_BYTES, SAMPLE, DICT_BYTES, LEVEL = 8192, 256 << 10, 1000, 64 << 10, 3
#: Bytes of text that are encoded together; bytes of a part of a sampled document, and most parts of one that the dictionary is trained on.
TOGETHER, PART, PARTS = 1 << 20, 16 << 10, 4
NO_ID = -(2**63)

# The vocabulary's pattern for words, over characters whose case and class are settled (no control characters, no ² ³ ¹ ¼ ½ ¾, which are numbers).
_PLAIN = re.compile(r"[\x09-\x0d -\x7e¡-©«-±´¶-¸»¿-ÿ]*").fullmatch
_SEPARATED = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|[^\x09-\x0d a-zß-öø-ÿ0-9]+").findall
_ID = attrgetter("id")


class Encoder:
    """Ids of whole texts by a tokenizer file; piece by piece with a memory where the file's rules allow it.

    The word vocabulary normalises (NFC, white space, lower case), cuts words into pieces by a pattern and merges within a piece only. For
    texts of ASCII and Latin-1 letters those steps are done here, for many texts together: their distinct words are cut, and a new
    piece is merged by the library's model once. All other texts, and any other kind of vocabulary, go through the library whole.
    """

    #: Bytes of pieces that are remembered (HELD: what each takes beside its letters and ids); beyond it, those of the texts at hand stay.
    MEMORY, HELD = 48 << 20, 200

    def __init__(self, path: str, end: int = END):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        shown = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.alphabet = {b: a for c in map(chr, range(128, 256)) for b, a in zip(c.encode(), shown(c)[0][0], strict=True)}
        self.last = np.array([end], "<u4")
        self.number: dict[str, int] = {}
        self.names: list[str] = []
        self.held, self.size, self.ids = 0, np.zeros(0, np.int64), np.zeros(0, "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        tests = ["It's THE end's, we'll x1234 (Ärger)ÀÉ!\n\tça?? 'm a'", "a  b\n\n12 ab'll'd ##!! |x|", "É§x naïve øre ÷×", *(f"{c}a{c}{c}1 {c}" for c in map(chr, range(256)) if _PLAIN(c))]
        self.by_piece = True
        self.by_piece = self.encode_all(tests) == [self._whole(t) + self.last.tobytes() for t in tests]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Numbers for new pieces."""
        odd = [p for p in pieces if not p.isascii()]
        shown = dict(zip(odd, "\n".join(odd).encode().decode("latin-1").translate(self.alphabet).split("\n"), strict=True)) if odd else {}
        found, sizes = [], []
        for p in pieces:
            ids = self.merge(shown.get(p, p))
            found += map(_ID, ids)
            sizes.append(len(ids))
        self.number.update(zip(pieces, range(len(self.names), len(self.names) + len(pieces)), strict=True))
        self.names += pieces
        self.size, self.ids = np.append(self.size, sizes).astype(np.int64), np.append(self.ids, np.array(found, "<u4"))
        self.held += sum(map(len, pieces)) + 4 * len(found) + self.HELD * len(pieces)

    def _keep(self, some: np.ndarray) -> None:
        """Forget all pieces but some, by number."""
        ids, _ = _gather(self.ids, self.size, some)
        self.names = [self.names[i] for i in some.tolist()]
        self.number = {p: i for i, p in enumerate(self.names)}
        self.size, self.ids = self.size[some], ids
        self.held = sum(map(len, self.names)) + 4 * len(ids) + self.HELD * len(some)

    def _together(self, texts: list[str]) -> list[bytes]:
        """Plain texts: the ids of their distinct words, then of all."""
        cut = pc.ascii_split_whitespace(pc.utf8_lower(pa.array(texts, pa.string())))
        found = cut.flatten().dictionary_encode()
        # a line break ends each word; its pieces come before it
        words = pa.ListArray.from_arrays([0, len(found.dictionary)], found.dictionary)
        pieces = _SEPARATED(pc.binary_join(words, "\n")[0].as_py() + "\n")
        self._learn([p for p in set(pieces).difference(self.number) if p != "\n"])
        self.number["\n"] = -1
        number = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        del self.number["\n"]
        ends = np.flatnonzero(number < 0)
        number[ends] = 0
        sizes = self.size[number] if len(self.size) else np.zeros(len(number), np.int64)
        sizes[ends] = 0
        ids, _ = _gather(self.ids, self.size, np.delete(number, ends)) if len(self.size) else (self.ids, None)
        of_word = np.diff(np.cumsum(sizes)[ends], prepend=0)
        # the end id is a word of its own, after the last word of each text
        counts = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
        word = np.insert(found.indices.to_numpy().astype(np.int64), np.cumsum(counts), len(of_word))
        ids, ends = _gather(np.append(ids, self.last), np.append(of_word, 1), word)
        ends = ends[np.cumsum(counts + 1) - 1].tolist()
        if self.held > self.MEMORY:
            self._keep(np.unique(number))
        return [ids[x:y].tobytes() for x, y in zip([0, *ends], ends, strict=False)]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, the end id last, as little-endian u32."""
        plain = [k for k, t in enumerate(texts) if self.by_piece and _PLAIN(t or "") and not any(s in (t or "") for s in self.special)]
        out = dict(zip(plain, self._together([texts[k] or "" for k in plain]), strict=True)) if plain else {}
        last = self.last.tobytes()
        return [out[k] if k in out else self._whole((t or "").encode("utf-8", "replace").decode()) + last for k, t in enumerate(texts)]

    def __call__(self, text: str | None) -> bytes:
        """Ids of one text, without the end id."""
        return self.encode_all([text])[0][:-4]


def _gather(ids: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ids (of these sizes, one after the other) by number, and where each ends."""
    start, size = np.cumsum(sizes) - sizes, sizes[at]
    ends = np.cumsum(size)
    return ids[np.repeat(start[at] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)], ends


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end: int = END) -> Encoder:
    if (path, end) not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path, end] = Encoder(path, end)
    return _ENCODERS[path, end]


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about TOGETHER bytes of a column, a row at least."""
    sizes, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TOGETHER, "right")))
        yield batch.slice(at, end - at)
        at = end


def pack(docs: list[tuple[int | None, bytes, int]], digest: bytes) -> bytes:
    """A shard of (doc_id, frame, number of tokens)."""
    index, at = [], 0
    for doc_id, frame, n in docs:
        index.append((NO_ID if doc_id is None else doc_id, at, len(frame), n))
        at += len(frame)
    return MAGIC + digest + struct.pack("<Q", len(docs)) + np.array(index, "<i8").reshape(-1, 4).tobytes() + b"".join(f for _, f, _ in docs)


class Shard:
    """Reads a shard; the dictionary must be the one it was written with."""

    def __init__(self, data: bytes, dictionary: bytes):
        if data[:8] != MAGIC or data[8:40] != hashlib.sha256(dictionary).digest():
            raise ValueError("not a shard of this dictionary")
        (n,) = struct.unpack("<Q", data[40:48])
        self.index = np.frombuffer(data, "<i8", 4 * n, 48).reshape(-1, 4)
        self.data, self.start = memoryview(data), 48 + 32 * n
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).decompress

    def ids(self, i: int) -> np.ndarray:
        """Ids of the shard's i-th document; nothing else is decompressed."""
        _, at, length, n = self.index[i]
        out = np.frombuffer(self.unpack(self.data[self.start + at : self.start + at + length], max_output_size=4 * int(n)), "<u4")
        if len(out) != n:
            raise ValueError("a document's ids are not whole")
        return out

    def find(self, doc_id: int) -> np.ndarray:
        i = int(np.searchsorted(self.index[:, 0], doc_id))
        if i == len(self.index) or self.index[i, 0] != doc_id:
            raise KeyError(doc_id)
        return self.ids(i)


def train_dictionary(docs: DataFrame, path: str, sample: int = SAMPLE) -> bytes:
    """A dictionary trained on the id arrays of about `sample` documents (chosen by hash); empty if they are too few.

    A document of more than PARTS parts of PART bytes gives PARTS of them, spread evenly from its first to its last.
    """
    n = docs.count()
    some = docs.where(F.pmod(F.xxhash64(F.lit("dict"), "doc_id"), F.lit(1_000_000)) < 1_000_000 * min(1.0, sample / max(n, 1)))

    def encoded(batches):
        to_ids = encoder(path)
        for b in batches:
            for part in _slices(b, 0):
                out = []
                for ids in to_ids.encode_all(part.column(0).to_pylist()):
                    parts = [ids[x : x + PART] for x in range(0, len(ids) - 4, PART)]
                    out += [parts[i] for i in sorted({round(k * (len(parts) - 1) / (PARTS - 1)) for k in range(PARTS)})] if len(parts) > PARTS else parts
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    arrays = sorted(bytes(r[0]) for r in some.select("text").mapInArrow(encoded, "ids binary").collect())
    try:
        return zstandard.train_dictionary(DICT_BYTES, [a for a in arrays if a]).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_shards(docs: DataFrame, path: str, out: str, end: int = END, range_rows: int = RANGE_ROWS, shard_bytes: int = SHARD_BYTES) -> bytes:
    """Encode docs(doc_id, text) and write shards to the table `out`; returns the dictionary, also written beside it.

    Texts are encoded and compressed where they are read; only compressed frames are dealt into ranges of doc_id. Null doc_ids come
    first; rows that repeat a doc_id come in the order of their frames.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, path)
    digest = hashlib.sha256(dictionary).digest()
    spark.createDataFrame([(digest.hex(), bytearray(dictionary))], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{out}/dictionary")
    cuts = cut_points(docs, "doc_id", range_rows)
    shared = spark.sparkContext.broadcast(dictionary)

    def frames(batches):
        to_ids, starts = encoder(path, end), np.array(cuts, np.int64)
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(shared.value) if shared.value else None, write_content_size=True).compress
        for whole in batches:
            for b in _slices(whole, 1):
                ids = to_ids.encode_all(b.column(1).to_pylist())
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                doc_id = b.column(0)
                part = np.where(doc_id.is_null(), -1, np.searchsorted(starts, pc.fill_null(doc_id, 0).to_numpy(zero_copy_only=False), "right")).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(part), doc_id, n, pa.array(list(map(squeeze, ids)), pa.binary())], names=["part", "doc_id", "n", "frame"])
            release()

    def shards(batches):
        part, number, size, held = None, 0, 0, []

        def done():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([held[0][0]], pa.int64()), pa.array([held[-1][0]], pa.int64()), pa.array([sum(x[2] for x in held)], pa.int64()), pa.array([pack(held, digest)], pa.binary())], names=["part", "number", "first", "last", "tokens", "shard"])

        for b in batches:
            for p, doc_id, n, frame in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (p != part or size >= shard_bytes):
                    yield done()
                    number, size, held = number + 1 if p == part else 0, 0, []
                part = p
                held.append((doc_id, frame, n))
                size += len(frame)
        if held:
            yield done()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = rows.mapInArrow(frames, "part long, doc_id long, n long, frame binary").repartition(len(cuts) + 1, "part")
    dealt = dealt.sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "frame")
    with small_batches(spark):
        dealt.mapInArrow(shards, "part long, number long, first long, last long, tokens long, shard binary").write.parquet(f"{out}/shards")
    return dictionary


def read_shards(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of the shards in `out`, decompressed and checked."""
    shards = spark.read.parquet(f"{out}/shards")
    (dictionary,) = (bytes(r[0]) for r in spark.read.parquet(f"{out}/dictionary").select("dictionary").collect())
    shared = spark.sparkContext.broadcast(dictionary)
    # the ids before each range (a number a range), then before each shard of a range
    sums = shards.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    ranges = sums.select("part", F.coalesce(F.sum("tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = W.partitionBy("part").orderBy("number").rowsBetween(W.unboundedPreceding, -1)
    starts = shards.select("part", "number", F.coalesce(F.sum("tokens").over(within), F.lit(0)).alias("ahead")).join(ranges, "part")
    starts = starts.select("part", "number", (F.col("base") + F.col("ahead")).alias("start"))

    def read(batches):
        for b in batches:
            for start, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                shard = Shard(data.as_py(), shared.value)
                n = shard.index[:, 3]
                crc = [zlib.crc32(shard.ids(i).tobytes()) for i in range(len(n))]
                ids = [None if x == NO_ID else int(x) for x in shard.index[:, 0]]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(start + np.cumsum(n) - n, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    joined = shards.select("part", "number", "shard").join(starts, ["part", "number"])
    return joined.select("start", "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_document(spark: SparkSession, out: str, doc_id: int) -> list[np.ndarray]:
    """The ids of each row of one document in the shards in `out`: by the shards' ranges and index, no other frame is decompressed."""
    (dictionary,) = (bytes(r[0]) for r in spark.read.parquet(f"{out}/dictionary").select("dictionary").collect())
    shards = spark.read.parquet(f"{out}/shards").where(F.lit(doc_id).between(F.col("first"), F.col("last")))

    def read(batches):
        for b in batches:
            found = [shard.ids(i).astype("<u4").tobytes() for data in b.column(0) for shard in [Shard(data.as_py(), dictionary)] for i in np.flatnonzero(shard.index[:, 0] == doc_id)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["ids"])

    return [np.frombuffer(r[0], "<u4") for r in shards.select("shard").mapInArrow(read, "ids binary").collect()]


def store_ids(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """Write the ids of every whole text of docs and read them back: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts have the end id alone. Null doc_ids come first (and are returned as null). Rows that repeat a doc_id
    are all kept. Other columns are not read. An empty table gives an empty result.
    """
    out = f"{scratch_root(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    write_shards(docs.select("doc_id", "text"), path, out, end)
    return read_shards(docs.sparkSession, out)
