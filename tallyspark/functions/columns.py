"""Column builders for messy text: sanitising, amounts, currencies, dates, identifiers, enums. All are built-in functions.

A value that an expression uses more than once is bound by let(), so that it is computed once a row: written out, the same regular
expressions would be repeated in every branch, and the generated code would be too large to be compiled.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import INVISIBLE, ISO_CODES, NULL_TOKENS, SYMBOLS, SYNONYMS

_HIDDEN = f"[{INVISIBLE}]"


def snake_case(name: str) -> str:
    """A header in snake case; `column` if nothing is left."""
    name = re.sub(r"\W+", "_", re.sub(_HIDDEN, "", name).strip(), flags=re.ASCII)
    return re.sub(r"_+", "_", name).strip("_").lower() or "column"


def dedupe(names: list[str], taken: tuple[str, ...] = ()) -> list[str]:
    """Unique headers: a repeated one (or one of `taken`) gets _2, _3 and so on."""
    seen, out = set(taken), []
    for n in names:
        new, i = n, 2
        while new in seen:
            new, i = f"{n}_{i}", i + 1
        seen.add(new)
        out.append(new)
    return out


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), with c computed once."""
    return F.transform(F.array(c), f)[0]


def is_blank(c: Column) -> Column:
    """Null, white space, nan or none."""
    return F.coalesce(F.lower(F.trim(c)).isin("", "nan", "none"), F.lit(True))


def sanitize(c: Column, upper: bool = False) -> Column:
    """Invisible characters out, quotes to ASCII, white space collapsed, null tokens to null."""
    c = F.translate(F.regexp_replace(c, _HIDDEN, ""), "‘’“”", "''\"\"")
    c = F.trim(F.regexp_replace(c, r"\s+", " "))
    return let(c, lambda x: F.when(~F.lower(x).isin(NULL_TOKENS), F.upper(x) if upper else x))


def currency(c: Column) -> Column:
    """The first three-letter word if it is an ISO code, else the first known symbol in the text, else RS as INR, else null."""

    def found(x: Column) -> Column:
        word = let(F.regexp_extract(x["up"], r"\b([A-Z]{3})\b", 1), lambda w: F.when(w.isin(ISO_CODES), w))
        return F.coalesce(word, *[F.when(x["low"].contains(s), F.lit(code)) for s, code in SYMBOLS], F.when(x["up"].contains("RS"), F.lit("INR")))

    return let(F.struct(F.upper(c).alias("up"), F.lower(c).alias("low")), found)


def amount(c: Column) -> Column:
    """struct(amount double, currency string, failed boolean) of a sanitised text.

    The last of mixed separators is the decimal one; a comma alone is decimal before exactly two digits. Brackets or a
    leading minus negate. failed: digits, but no number. Without digits all is null and not failed.
    """
    return let(c, _amount)


def _number(t: Column) -> Column:
    comma, dot = t.contains(","), t.contains(".")
    dot_last = F.locate(".", F.reverse(t)) < F.locate(",", F.reverse(t))
    return (
        F.when(comma & dot, F.when(dot_last, F.regexp_replace(t, ",", "")).otherwise(F.translate(F.regexp_replace(t, r"\.", ""), ",", ".")))
        .when(comma, F.when(t.rlike(r",\d{2}$"), F.regexp_replace(F.regexp_replace(t, r",(?=\d{2}$)", "."), ",", "")).otherwise(F.regexp_replace(t, ",", "")))
        .when(t.rlike(r"\.\d{3}\.\d{2}$"), F.regexp_replace(t, r"\.(?!\d{2}$)", ""))
        .otherwise(t)
    )


def _amount(c: Column) -> Column:
    def parts(bare: Column) -> Column:
        negative = (bare.startswith("(") & bare.endswith(")")) | bare.startswith("-")
        return F.struct(negative.alias("negative"), F.regexp_replace(bare, r"[^0-9,.]", "").alias("t"))

    def read(x: Column) -> Column:
        return F.struct(x["negative"].alias("negative"), F.coalesce(x["t"].rlike(r"\d"), F.lit(False)).alias("digits"), _number(x["t"]).try_cast("double").alias("value"))

    def result(x: Column) -> Column:
        return F.struct(
            F.when(x["digits"], F.when(x["negative"], -x["value"]).otherwise(x["value"])).alias("amount"),
            F.when(x["digits"], currency(c)).alias("currency"),
            (x["digits"] & x["value"].isNull()).alias("failed"),
        )

    bare = F.trim(F.regexp_replace(F.regexp_replace(c, r"\b[Rr][Ss]\b\.?", ""), r"\b[A-Za-z]{3}\b|[₹$€£]", ""))
    return let(let(let(bare, parts), read), result)


# (a shape of the text, formats to try for it): the order is day first, then month first
_FORMATS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}:\d{2}(\.\d+)?$", ["yyyy-M-d H:m:s[.SSSSSS][.SSS]"]),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{2}:\d{2}:\d{2}([+-]\d{2}:\d{2}|Z)$", ["yyyy-M-d'T'HH:mm:ssXXX"]),
    (r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}$", ["yyyy-M-d", "yyyy-d-M"]),
    (r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{4}$", ["d-M-yyyy", "M-d-yyyy"]),
    (r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{2}$", ["d-M-yy", "M-d-yy"]),
    (r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{4} \d{1,2}:\d{2}:\d{2}$", ["d-M-yyyy H:m:s", "M-d-yyyy H:m:s"]),
    (r"(?i)^\d{1,2}[-/.]\d{1,2}[-/.]\d{4} \d{1,2}:\d{2} [AP]M$", ["d-M-yyyy h:m a", "M-d-yyyy h:m a"]),
    (r"^(19|20|21)\d{6}$", ["yyyyMMdd"]),
    (r"^(19|20|21)\d{12}$", ["yyyyMMddHHmmss"]),
    (r"^(19|20|21)\d{2}$", ["yyyy"]),
    (r"^\d{1,2}[- ][A-Za-z]{3}[- ]\d{4}$", ["d-MMM-yyyy"]),
    (r"^[A-Za-z]{3} \d{4}$", ["MMM-yyyy"]),
    (r"^[A-Za-z]{4,} \d{1,2}, \d{4}$", ["MMMM-d,-yyyy"]),
]


def date(c: Column) -> Column:
    """A timestamp (UTC) of a sanitised text, day first; numbers from 20000 to 80000 are Excel serials; else null."""
    return let(c, _date)


def _date(c: Column) -> Column:
    """The first shape that fits decides; no text fits two of them."""
    serial = let(c.try_cast("double"), lambda x: F.when((x >= 20000) & (x <= 80000), F.timestamp_seconds(F.round((x - 25569) * 86400, 0))))
    out = F.when(c.rlike(r"^\d{5}(\.\d+)?$"), serial)
    for shape, formats in _FORMATS:
        words = "MMM" in formats[0]
        timed = "H" in formats[0] or "h" in formats[0]
        text = F.regexp_replace(c, " ", "-") if words else c if "yyyy-M-d " in formats[0] or "'T'" in formats[0] or "yyyyMMdd" in formats[0] else F.regexp_replace(c, r"[/.]", "-")
        text = F.initcap(F.regexp_replace(text, "-", " ")) if words else text
        if words:
            formats = [f.replace("-", " ") for f in formats]
        if timed and "yyyy-M-d " in formats[0]:
            text = F.regexp_replace(c, "T", " ")
        out = out.when(c.rlike(shape), F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]))
    return out


def identifier(c: Column, null_token: str | None = None) -> Column:
    """Upper case letters and digits alone; 123.0 is 123; null stays null (or becomes null_token)."""
    c = F.regexp_replace(c, r"^(\d+)\.0$", "$1")
    c = F.regexp_replace(F.upper(c), r"[^0-9A-Z]", "")
    return F.coalesce(c, F.lit(null_token)) if null_token else c


def enum(c: Column, field: str) -> Column:
    """Known synonyms by their meaning, else collapsed and upper-cased; null tokens are null."""
    c = F.trim(F.regexp_replace(c, r"\s+", " "))
    known = SYNONYMS.get(field, {})

    def meaning(x: Column) -> Column:
        return let(F.lower(x), lambda low: F.when(~low.isin(NULL_TOKENS), F.coalesce(*[F.when(low == k, F.lit(v)) for k, v in known.items()], F.upper(x))))

    return let(c, meaning)


def match_id(c: Column) -> Column:
    """An identifier as the matching stages compare it: no white space, - or _, upper case; blank is ''."""
    return F.when(is_blank(c), F.lit("")).otherwise(F.upper(F.regexp_replace(F.trim(c), r"[\s\-_]", "")))


def key_values(c: Column) -> Column:
    """A map of `a=1;b=2`; parts without a number are left out."""
    pairs = F.filter(F.transform(F.split(c, ";"), lambda p: F.struct(F.trim(F.split(p, "=")[0]).alias("k"), F.try_element_at(F.split(p, "="), F.lit(2)).try_cast("double").cast("long").alias("v"))), lambda x: x["v"].isNotNull() & (x["k"] != ""))
    return F.map_from_entries(pairs)


def entity_name(c: Column) -> Column:
    """The feed's name in a file path: without folder, batch and extension; UNKNOWN_ENTITY if nothing is left."""
    base = F.regexp_replace(F.regexp_replace(c, r"^.*[/\\]", ""), r"\.csv$", "")
    base = F.regexp_replace(F.split(base, "__")[0], r"_(rejected|warnings)$", "")
    return F.coalesce(F.nullif(F.trim(base), F.lit("")), F.lit("UNKNOWN_ENTITY"))


def percent(n: Column, d: Column) -> Column:
    return F.when(d > 0, F.bround(100 * n / d, 2)).otherwise(F.lit(0.0))


def short_name(c: Column, most: int = 48) -> Column:
    """A path's last part, cut after `most` characters with an ellipsis."""
    base = F.regexp_replace(c, r"^.*[/\\]", "")
    return F.when(F.length(base) > most, F.concat(F.substring(base, 1, most), F.lit("…"))).otherwise(base)
