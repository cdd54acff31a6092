"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a string. Successive prefixes of a conversation are rendered; where
each output continues the one before, the new part is that turn's span. A turn's text lies within it where two
probe texts, rendered in its place, differ. A template whose output for a longer prefix does not continue the shorter one's
rewrites history: it is detected, and the conversation is marked, with spans measured as far as its history held.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = dict
Template = Callable[[list[Turn]], str]

# Every control string of the usual templates holds one of the first four of these characters.
_ESCAPES = {"<": "\\l", "[": "\\b", "|": "\\p", "{": "\\c", "\\": "\\\\", "\n": "\\n"}
_UNESCAPES = {v: k for k, v in _ESCAPES.items()}
_TEXT, _ROLE = str.maketrans({k: v for k, v in _ESCAPES.items() if k != "\n"}), str.maketrans(_ESCAPES)
_ESCAPED = re.compile(r"\\[lbpcn\\]")


def escape(text: str) -> str:
    """No control string can occur in the result, and unescape() gives the text back."""
    return text.translate(_TEXT)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _UNESCAPES[m[0]], text)


def marked_turns(turns: list[Turn]) -> str:
    """<|turn|>role, newline, text, <|end|>, newline for each turn; roles and texts are escaped."""
    return "".join(f"<|turn|>{t['role'].translate(_ROLE)}\n{escape(t['text'])}<|end|>\n" for t in turns)


def remembering() -> Template:
    """marked_turns for the prefixes of one conversation: each turn's part is made once."""
    parts: dict[tuple[str, str], str] = {}

    def template(turns: list[Turn]) -> str:
        for t in turns[-1:]:
            parts.setdefault((t["role"], t["text"]), marked_turns([t]))
        found = [parts.get((t["role"], t["text"])) for t in turns]
        return marked_turns(turns) if None in found else "".join(found)

    return template


_MARKED = re.compile(r"<\|turn\|>([^\n]*)\n(.*?)<\|end\|>\n", re.S)


def parse_marked(out: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, from the output alone; ValueError if it holds anything else."""
    found, at = [], 0
    for m in _MARKED.finditer(out):
        if m.start() != at:
            break
        at = m.end()
        found.append((unescape(m[1]), unescape(m[2])))
    if at != len(out):
        raise ValueError("not an output of this template")
    return found


@dataclass
class Rendered:
    text: str
    spans: list[tuple[int, int]] = field(default_factory=list)
    slots: list[tuple[int, int]] = field(default_factory=list)
    rewrites: bool = False


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a.startswith(b[:mid]) else (lo, mid - 1)
    return lo


def render(turns: list[Turn], template: Template) -> Rendered:
    """Output of the whole conversation; of each turn, the span of its part and of its text within the output."""
    out, result = template([]), Rendered("")
    for k, turn in enumerate(turns):
        before, now = out, template(turns[: k + 1])
        if not now.startswith(before):
            result.rewrites = True
            break
        # white space is where templates trim, so probes have none, and differ from their first character to the last
        one, two = (template([*turns[:k], {**turn, "text": x}]) for x in ("AxA", "ByB"))
        if not (one.startswith(before) and two.startswith(before)):
            result.rewrites = True
            break
        start = len(before) + _common(one[len(before) :], two[len(before) :])
        tail = _common(one[start:][::-1], two[start:][::-1])
        if one[start : len(one) - tail] != "AxA":
            result.rewrites = True
            break
        result.spans.append((len(before), len(now)))
        result.slots.append((start, len(now) - tail))
        out = now
    result.text = template(turns) if result.rewrites else out
    return result


def loss_text(r: Rendered, turns: list[Turn], roles: tuple[str, ...] = ("assistant",), plain: Callable[[str], str] = unescape) -> list[str]:
    """The output's parts under the loss mask, unescaped: one for each turn of these roles."""
    return [plain(r.text[a:z]) for (a, z), t in zip(r.slots, turns, strict=False) if t["role"] in roles]


def _digest(texts: Iterator[str]) -> str:
    h = hashlib.sha256()
    for t in texts:
        h.update(t.encode("utf-8", "surrogatepass"))
    return h.hexdigest()


_NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history", "formatted", "spans"]
_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean, formatted string, spans array<long>"
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.int64())]


@dataclass(frozen=True)
class Format:
    """make: a template for one conversation. parse: (role, text) of each turn from an output, ValueError if it can't tell. plain: undoes the escaping of a text."""

    make: Callable[[], Template]
    parse: Callable[[str], list[tuple[str, str]]] | None = None
    plain: Callable[[str], str] = str


MARKED = Format(remembering, parse_marked, unescape)


def _formatted(conv_id: int | None, turns: list[Turn], how: Format) -> tuple:
    r = render(turns, how.make())
    try:
        back = how.parse(r.text) if how.parse else None
    except ValueError:
        back = None
    loss = loss_text(r, turns, plain=how.plain)
    flat = [x for span in r.slots for x in span]
    read = (None, None) if back is None else (len(back), _digest(f"{a}\n{b}\n" for a, b in back))
    return conv_id, *read, sum(map(len, loss)), _digest(loss), len(r.text), r.rewrites, r.text, flat


def _grouped(batches: Iterator[pa.RecordBatch], how: Format = MARKED) -> Iterator[pa.RecordBatch]:
    """Rows conv_id, role, text, a conversation's next to each other and in order."""
    held, now, begun = [], None, False
    for b in batches:
        out = []
        for conv_id, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if begun and conv_id != now:
                out.append(_formatted(now, held, how))
                held = []
            now, begun = conv_id, True
            held.append({"role": role or "", "text": text or ""})
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), _KINDS, strict=True)], names=_NAMES)
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(_formatted(now, held, how), _KINDS, strict=True)], names=_NAMES)


def format_conversations(rows: DataFrame, how: Format = MARKED) -> DataFrame:
    """A row for each conv_id, read back from its formatted output, with that output and the spans (start, end, ...) of its texts.

    Where the format has no parser, or its parser can't read an output, n_turns and turns_sha256 are null. Where the template rewrites history
    (rewrites_history), spans and the loss figures cover the turns before it did.

    Turns are ordered by turn (null first), then role and text, so repeated turns all stay. Null texts and roles are
    empty; rows without conv_id are one conversation. Other columns are not read. An empty table gives an empty result.
    """
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(lambda batches: _grouped(batches, how), _SCHEMA)
