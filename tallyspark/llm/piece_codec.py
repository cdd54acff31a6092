"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

The model file gives pieces with scores; nothing is trained. A text is escaped (spaces to U+2581, one put before it) and
cut into units that no piece of the vocabulary crosses. Within a unit an agenda holds the candidate merges, best score first,
leftmost first among equals; a candidate that is popped and still fits is skipped for good with the dropout rate. Each occurrence
of a unit in each document has draws of its own, hashed from the seed, doc_id and its place: how many candidates are
taken before the next one is skipped. What a unit gives depends on the places of its skipped candidates alone, so for units that
stand more than once in texts at hand the results for (unit, places) are remembered; a unit that stands once is merged with its own
places. Units of one length are merged together in arrays, a row each. Characters outside the vocabulary, and U+2581 itself,
become byte pieces, so decoding gives every text back exactly.
"""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ._common import release

#: Share of candidate merges that are skipped, and the key.
DROPOUT, SEED = 0.1, 7
#: Bytes of texts that are encoded together; characters of a unit that is merged among others, and the fewest units of one length for that.
TOGETHER, LONG, FEW = 1 << 22, 64, 12
#: Bytes of results that are remembered (HELD: what each takes beside its unit and ids).
MEMORY, HELD = 64 << 20, 320
#: No candidate is skipped from here on.
NEVER = 1 << 20
SPACE = "▁"


_MASK = 0xFFFFFFFFFFFFFFFF


def _mixed(h):
    """Bits of a 64-bit number, or of an array of them, spread."""
    if isinstance(h, int):
        h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & _MASK
        h = (h ^ (h >> 27)) * 0x94D049BB133111EB & _MASK
        return h ^ (h >> 31)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_PLACE, _DRAW = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


def _gather(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ids by their starts and sizes, one after the other, and where each ends."""
    ends = np.cumsum(size)
    return ids[np.repeat(start - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)], ends


class _Made(NamedTuple):
    """Ids of results one after the other, and of each how many there are and how many candidates were popped that still fit."""

    ids: np.ndarray
    size: np.ndarray
    pops: np.ndarray


class _Memory:
    """Results by number, remembered: of units by the places of their skipped candidates."""

    def __init__(self, make: Callable[[list[str], np.ndarray, np.ndarray], _Made], most: int):
        self.make, self.most = make, most
        self.clear()

    def clear(self) -> None:
        self.whole: dict[str, int] = {}
        self.further: dict[int, int] = {}
        self.units: list[str] = []
        self.skips: list[tuple[int, ...]] = []
        self.held, self.made, self.start = 0, _Made(np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)), np.zeros(0, np.int64)

    def _put(self, units: list[str], skips: list[tuple[int, ...]]) -> range:
        """Numbers of new results."""
        sizes = np.fromiter(map(len, skips), np.int64, len(skips))
        new = self.make(units, np.repeat(np.arange(len(units)), sizes), np.fromiter(chain.from_iterable(skips), np.int64))
        out = range(len(self.units), len(self.units) + len(units))
        self.start = np.append(self.start, len(self.made.ids) + np.cumsum(new.size) - new.size)
        self.made = _Made(*map(np.append, self.made, new))
        self.units += units
        self.skips += skips
        self.held += sum(map(len, units)) + 4 * len(new.ids) + HELD * len(units)
        return out

    def learn(self, units: list[str]) -> range:
        """Numbers of new units without skips."""
        out = self._put(units, [()] * len(units))
        self.whole.update(zip(units, out, strict=True))
        return out

    def skipped(self, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Numbers of the same with one more skip, at a later place."""
        pairs, back = np.unique(at << 8 | place, return_inverse=True)
        pairs = pairs.tolist()
        new = [x for x in pairs if x not in self.further]
        if new:
            self.further.update(zip(new, self._put([self.units[x >> 8] for x in new], [(*self.skips[x >> 8], x & 255) for x in new]), strict=True))
        return np.fromiter(map(self.further.__getitem__, pairs), np.int64, len(pairs))[back]


class Codec:
    """Encodes and decodes with one model file."""

    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = SEED):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.seed = seed
        # a draw below the k-th of these: k candidates at most are taken before the next skip
        steps = min(1 << 16, int(32 * math.log(2) / -math.log1p(-dropout)) + 2) if 0 < dropout < 1 else int(dropout >= 1)
        self.limits = np.array([round((1 - (1 - dropout) ** k) * 2**32) for k in range(1, steps + 1)], np.uint64)
        self.gaps = np.append(np.arange(steps), NEVER)
        self.limit_list = self.limits.tolist()
        self.ids: dict[str, int] = {}
        self.order: dict[str, float] = {}
        self.bytes = [b""] * 256
        self.pieces = [b""] * sp.get_piece_size()
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value] = np.array([i], "<u4").tobytes()
                self.pieces[i] = bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece] = i
                self.order[piece] = -sp.get_score(i)
                self.pieces[i] = piece.replace(SPACE, " ").encode()
        self.number = {p: np.array([i], "<u4").tobytes() for p, i in self.ids.items()}
        own = self._apart()
        self.units = re.compile(r"(?s).+" if own is None else self._pattern(own, "")).findall
        # words between single spaces (a line break begins a word) are cut by themselves if no piece holds a line break
        self.by_word = own is not None and not any("\n" in p or "\0" in p for p in self.ids)
        self.cut = re.compile(self._pattern(own or "", "\0") + "|\0").findall
        self.memory = _Memory(self._made, MEMORY)
        self._tables()

    def _tables(self) -> None:
        """Arrays for merging many units at once: pieces by number, pairs of pieces in ascending order and what they make."""
        names = list(self.ids)
        number = {p: k for k, p in enumerate(names)}
        self.vocabulary_id = np.array([self.ids[p] for p in names], "<u4")
        self.rank = np.array([*(self.order[p] for p in names), np.inf])  # the last one: no piece
        self.length = np.array([len(p) for p in names], np.uint64)
        self.letter = np.full(0x110000, -1, np.int32)
        for p, k in number.items():
            if len(p) == 1:
                self.letter[ord(p)] = k
        pairs = [(number[p[:c]], number[p[c:]], k) for p, k in number.items() for c in range(1, len(p)) if p[:c] in number and p[c:] in number]
        left, right, makes = np.array(pairs, np.int64).reshape(-1, 3).T
        key = left * len(names) + right
        at = np.argsort(key)
        self.pair, self.makes = np.append(key[at], np.iinfo(np.int64).max), np.append(makes[at], -1)

    def _apart(self) -> str | None:
        """Characters that no piece joins with others; None if pieces reach over spaces."""
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            return None
        letter = lambda c: unicodedata.category(c)[0] in "LM"
        pairs = {p for piece in self.ids for p in zip(piece.lstrip(SPACE), piece.lstrip(SPACE)[1:], strict=False)}
        apart = {c for piece in self.ids for c in piece if not letter(c) and c != SPACE}
        while reach := {c for pair in pairs for c in pair if c in apart and not set(pair) <= apart}:
            apart -= reach
        return "".join(sorted(apart))

    def _pattern(self, apart: str, never: str) -> str:
        """Units: runs of characters between which some piece may reach, without those in never."""
        own = re.escape(apart)
        return rf"{SPACE}*+[^{own}{SPACE}{never}]+|" + (rf"{SPACE}*+[{own}]+|" if apart else "") + rf"{SPACE}+"

    def _places(self, key: int) -> Iterator[int]:
        """Places of an occurrence's skipped candidates among those that are popped and still fit, ascending."""
        place, r = -1, 1
        while place < NEVER:
            place += 1 + int(self.gaps[bisect_right(self.limit_list, _mixed(key + r * _DRAW & _MASK) >> 32)])
            yield place
            r += 1

    def _merge(self, unit: str, key: int) -> bytes:
        """Ids of an occurrence by its key."""
        return self._run(unit, self._places(key))[0]

    def _run(self, unit: str, skips: Iterator[int]) -> tuple[bytes, int]:
        """Ids, and how many candidates were popped that still fit."""
        order, pops, skip = self.order, 0, next(skips, -1)
        n = len(unit)
        if not n:  # what stands for U+2581 in a text
            return b"".join(self.bytes[x] for x in SPACE.encode()), 0
        symbols: list[str | None] = list(unit)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(order[p], i, i + 1, p) for i, p in enumerate(map(str.__add__, unit, unit[1:])) if p in order]
        heapq.heapify(agenda)
        while agenda:
            _, i, j, piece = heapq.heappop(agenda)
            a, b = symbols[i], symbols[j]
            if a is None or b is None or after[i] != j or len(a) + len(b) != len(piece):
                continue
            pops += 1
            if pops - 1 == skip:
                skip = next(skips, -1)
                continue
            symbols[i], symbols[j] = piece, None
            z = after[i] = after[j]
            if z < n:
                before[z] = i
                p = piece + symbols[z]
                if p in order:
                    heapq.heappush(agenda, (order[p], i, z, p))
            y = before[i]
            if y >= 0:
                p = symbols[y] + piece
                if p in order:
                    heapq.heappush(agenda, (order[p], y, i, p))
        return self._out([s for s in symbols if s is not None]), pops

    def _out(self, symbols: list[str]) -> bytes:
        number = self.number
        return b"".join([number[s] if s in number else b"".join([self.bytes[x] for x in s.encode("utf-8", "surrogatepass")]) for s in symbols])

    def _key(self, doc_id: int | None) -> int:
        """Seed of a document's draws."""
        return xxhash.xxh3_64_intdigest(f"{self.seed}:{doc_id}")

    def _piece(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two pieces make, -1 if none."""
        key = left.astype(np.int64) * len(self.vocabulary_id) + right
        at = np.searchsorted(self.pair, key)
        return np.where(self.pair[at] == key, self.makes[at], -1)

    def _made(self, units: list[str], row: np.ndarray, place: np.ndarray) -> _Made:
        """_run of units, the places of their skips by row: those of one length merged together, few or odd ones (long, or of characters outside the vocabulary) one by one."""
        n = np.fromiter(map(len, units), np.int64, len(units))
        if not units:
            return _Made(np.zeros(0, "<u4"), n, n)
        order = np.argsort(n, kind="stable")
        to = np.empty(len(n), np.int64)
        to[order] = np.arange(len(n))
        row = to[row]
        at = np.lexsort((place, row))
        row, place = row[at], place[at]
        units, n = [units[i] for i in order.tolist()], n[order]
        rows, parts = [], []

        def alone(some: np.ndarray) -> None:
            ends = np.searchsorted(row, np.append(some, some + 1)).reshape(2, -1)
            found = [self._run(units[i], iter(place[x:y].tolist())) for i, x, y in zip(some.tolist(), *ends.tolist(), strict=True)]
            rows.append(some)
            parts.append(_Made(np.frombuffer(b"".join([x for x, _ in found]), "<u4"), np.array([len(x) // 4 for x, _ in found], np.int64), np.array([p for _, p in found], np.int64)))

        lengths, first = np.unique(n, return_index=True)
        for length, x, y in zip(lengths.tolist(), first.tolist(), [*first[1:].tolist(), len(n)], strict=True):
            if not 1 < length <= LONG or y - x < FEW:
                alone(np.arange(x, y))
                continue
            symbol = self.letter[np.frombuffer("".join(units[x:y]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, length)]
            plain = (symbol >= 0).all(axis=1)
            if not plain.all():
                alone(x + np.flatnonzero(~plain))
            skip = np.zeros((y - x, 3 * length), bool)
            a, z = np.searchsorted(row, (x, y))
            skip[row[a:z] - x, np.minimum(place[a:z], 3 * length - 1)] = True
            skip[:, -1] = False
            here = np.flatnonzero(plain)
            for k in range(0, len(here), 8192):  # rows that stay in the processor's memory
                some = here[k : k + 8192]
                rows.append(x + some)
                parts.append(self._agendas(symbol[some], skip[some]))
        done, made = np.concatenate(rows), _Made(*map(np.concatenate, zip(*parts, strict=True)))
        back = np.empty(len(done), np.int64)
        back[order[done]] = np.arange(len(done))
        ids, _ = _gather(made.ids, (np.cumsum(made.size) - made.size)[back], made.size[back])
        return _Made(ids, made.size[back], made.pops[back])

    def _draws(self, keys: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and places of all skips that come before a bound, of occurrences by their keys."""
        left, place, r = np.arange(len(keys)), np.full(len(keys), -1), 1
        rows, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(left):
            place[left] += 1 + self._gap(keys[left], r)
            left = left[place[left] < bound[left]]
            rows.append(left)
            places.append(place[left])
            r += 1
        return np.concatenate(rows), np.concatenate(places)

    def _gap(self, keys: np.ndarray, r: int) -> np.ndarray:
        """How many candidates are taken before an occurrence's r-th skip, since the one before."""
        return self.gaps[np.searchsorted(self.limits, _mixed(keys + np.uint64(r * _DRAW & _MASK)) >> np.uint64(32), "right")]

    def _drawn(self, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Numbers of remembered results by those of units without skips and by keys, for each occurrence."""
        memory = self.memory
        left, place, r = np.arange(len(at)), np.full(len(at), -1), 1
        while len(left):
            place[left] += 1 + self._gap(keys[left], r)
            left = left[place[left] < memory.made.pops[at[left]]]
            if len(left):
                at[left] = memory.skipped(at[left], place[left])
            r += 1
        return at

    def _results(self, units: list[str], at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of occurrences of different units, by their places in the list and their keys, and where each occurrence's end."""
        memory = self.memory
        if memory.held > memory.most:
            memory.clear()
        number = np.fromiter(map(memory.whole.get, units, repeat(-1)), np.int64, len(units))
        n = np.fromiter(map(len, units), np.int64, len(units))
        once = (number < 0) & ((np.bincount(at, minlength=len(units)) == 1) | (n > LONG))
        new = np.flatnonzero((number < 0) & ~once)
        number[new] = memory.learn([units[i] for i in new.tolist()])
        alone = once[at]
        own = np.flatnonzero(alone)
        made = self._made([units[i] for i in at[own].tolist()], *self._draws(keys[own], 3 * n[at[own]]))
        again = np.flatnonzero(~alone)
        known = self._drawn(number[at[again]], keys[again])
        start, size = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        start[again], size[again] = memory.start[known], memory.made.size[known]
        start[own], size[own] = len(memory.made.ids) + np.cumsum(made.size) - made.size, made.size
        return _gather(np.append(memory.made.ids, made.ids), start, size)

    def _agendas(self, symbol: np.ndarray, skip: np.ndarray) -> _Made:
        """As _run, over a unit in each row: a row's agenda is the rank of what each symbol and its next one make."""
        rows, n = symbol.shape
        pops = np.zeros(rows, np.int64)
        symbol = symbol.astype(np.int64)
        after, before = np.tile(np.arange(1, n + 1), (rows, 1)), np.tile(np.arange(-1, n - 1), (rows, 1))
        piece = np.full((rows, n), -1)
        piece[:, :-1] = self._piece(symbol[:, :-1], symbol[:, 1:])
        agenda = self.rank[piece]
        r = np.arange(rows)
        while len(r):
            i = agenda[r].argmin(axis=1)
            live = agenda[r, i] < np.inf
            r, i = r[live], i[live]
            j, p = after[r, i], piece[r, i]
            agenda[r, i] = np.inf
            take = ~skip[r, pops[r]]
            pops[r] += 1
            a, i, j, p = r[take], i[take], j[take], p[take]
            symbol[a, i], symbol[a, j], agenda[a, j] = p, -1, np.inf
            z, y = after[a, j], before[a, i]
            after[a, i] = z
            for has, left, right, at in ((z < n, i, z, i), (y >= 0, y, i, y)):
                b, at = a[has], at[has]
                if right is z:
                    before[b, z[has]] = i[has]
                made = self._piece(symbol[b, left[has]], symbol[b, right[has]])
                piece[b, at], agenda[b, at] = made, self.rank[made]
        left = symbol >= 0
        return _Made(self.vocabulary_id[symbol[left]], left.sum(axis=1), pops)

    def _units(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Different units, the units of each text by number, one after the other, and how many each text has."""
        plain, odd = [], []
        for k, text in enumerate(texts):
            spaced = text.replace("\n", " \n")
            if self.by_word and text and SPACE not in text and "\0" not in text and "  " not in spaced and spaced[0] != " " and spaced[-1] != " ":
                plain.append((k, spaced))
            else:
                odd.append(k)
        cut = pc.split_pattern(pa.array([t for _, t in plain], pa.string()), " ")
        words = cut.flatten().dictionary_encode()
        found: list[str] = []
        if plain:
            # each word with its space before it (a line break has none) and a mark after it
            whole = pc.binary_join(pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary), f"\0{SPACE}")[0].as_py()
            found = self.cut(f"{SPACE}{whole}\0".replace(f"{SPACE}\n", "\n"))
        marks = len(found)
        sizes = np.zeros(len(texts), np.int64)
        for k in odd:
            units: list[str] = []
            for q, part in enumerate(texts[k].split(SPACE)):
                if texts[k]:
                    units += ["", *self.units(part.replace(" ", SPACE))] if q else self.units(SPACE + part.replace(" ", SPACE))
            sizes[k] = len(units)
            found += units
        names = dict.fromkeys(found)
        names.pop("\0", None)
        names = {u: i for i, u in enumerate(names)}
        names["\0"] = -1
        number = np.fromiter(map(names.__getitem__, found), np.int64, len(found))
        del names["\0"]
        ends = np.flatnonzero(number[:marks] < 0)
        start, size = np.append(0, ends[:-1] + 1), np.diff(ends, prepend=-1) - 1
        at = words.indices.to_numpy().astype(np.int64)
        of_plain, word_ends = _gather(number, start[at], size[at]) if plain else (number[:0], ends)
        if plain:
            ends = word_ends[np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False)) - 1]
            sizes[[k for k, _ in plain]] = np.diff(ends, prepend=0)
        # in the order of the texts
        source, first = np.append(of_plain, number[marks:]), np.zeros(len(texts), np.int64)
        order = np.array([k for k, _ in plain] + odd, np.int64)
        first[order] = np.cumsum(sizes[order]) - sizes[order]
        return list(names), _gather(source, first, sizes)[0], sizes

    def encode_all(self, texts: list[str | None], doc_ids: list[int | None]) -> list[bytes]:
        """Ids of each text as little-endian u32."""
        if not texts:
            return []
        units, at, sizes = self._units([t or "" for t in texts])
        key = np.array([self._key(d) for d in doc_ids], np.uint64)
        first = np.cumsum(sizes) - sizes
        place = (np.arange(len(at)) - np.repeat(first, sizes) + 1).astype(np.uint64)
        ids, ends = self._results(units, at, _mixed(np.repeat(key, sizes) + place * np.uint64(_PLACE)))
        ends = np.append(0, ends)[first + sizes].tolist()
        return [ids[x:y].tobytes() for x, y in zip([0, *ends], ends, strict=False)]

    def encode(self, text: str | None, doc_id: int | None = None) -> bytes:
        return self.encode_all([text], [doc_id])[0]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")
        return text[1:] if text.startswith(" ") else text


_CODECS: dict[tuple, Codec] = {}


def codec(*options) -> Codec:
    if options not in _CODECS:
        _CODECS[options] = Codec(*options)
    return _CODECS[options]


def encode_documents(docs: DataFrame, path: str, dropout: float = DROPOUT, seed: int = SEED, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_tokens, ids, intact (the ids decode to the text) and the columns in keep, a row for each row of docs, in their order.

    Null and empty texts have no ids, and decode to an empty text. Rows of one doc_id and text have equal ids; a null
    doc_id is hashed as such. keep: columns of docs to carry, of other names than these four. Others are not read.
    An empty table gives an empty result.
    """
    schema = StructType.fromDDL("doc_id long, n_tokens long, ids array<int>, intact boolean")
    if clash := {k.lower() for k in keep} & set(schema.names):
        raise ValueError(f"not to be kept: {sorted(clash)}")
    kept = docs.select("doc_id", "text", *keep)
    schema = StructType([*schema, *kept.schema[2:]])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, dropout, seed)
        for whole in batches:
            sizes, at = np.cumsum([x or 0 for x in pc.binary_length(whole.column(1)).to_pylist()]), 0
            while at < whole.num_rows:
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TOGETHER, "right")))
                b, at = whole.slice(at, end - at), end
                texts = b.column(1).to_pylist()
                out = c.encode_all(texts, b.column(0).to_pylist())
                intact = [c.decode(np.frombuffer(ids, "<u4")) == (text or "") for ids, text in zip(out, texts, strict=True)]
                n = np.array([len(x) // 4 for x in out], np.int64)
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(out), "<i4")))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), lists, pa.array(intact), *b.columns[2:]], names=names)
            release()

    names = schema.names
    return kept.mapInArrow(encoded, schema)
