"""Bronze to silver: one projection for each feed, with no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import columns as X


def rename(df: DataFrame, renames: dict[str, str] = C.RENAMES) -> DataFrame:
    """Headers in snake case, unique, with known synonyms renamed."""
    names = [X.snake_case(c) for c in df.columns]
    return df.toDF(*X.dedupe([renames.get(n, n) for n in names]))


def standardize(df: DataFrame, config: C.Config = C.Config()) -> DataFrame:
    """Raw snapshots, sanitised strings, parsed dates and amounts, standard identifiers and enums. Columns that are missing are skipped."""
    strings = [c for c, t in df.dtypes if t == "string"]
    clean = {c: X.sanitize(F.col(c), c in C.UPPER) for c in strings if c not in C.UNTOUCHED and not c.endswith("_raw")}
    raw = {f"{c}_raw": F.col(c) for c in (*C.DATES, *C.AMOUNTS) if c in strings}
    df = df.withColumns(raw).withColumns(clean)
    new = {}
    for c in C.DATES:
        if c in strings:
            new |= {f"{c}_parsed": X.date(F.col(c))}
    for c in C.AMOUNTS:
        if c in strings:
            new |= {f"{c}_struct": X.amount(F.col(c))}
    for c in C.IDENTIFIERS:
        if c in strings:
            new |= {f"{c}_standardized": X.identifier(F.col(c), config.null_identifier_token)}
    for c in C.ENUMS:
        if c in strings:
            new |= {c: X.enum(F.col(c), c)}
    df = df.withColumns(new)
    more = {}
    for c in C.DATES:
        if c in strings:
            more |= {f"{c}_parse_confidence": F.when(F.col(f"{c}_parsed").isNotNull(), 0.92).otherwise(0.0), f"{c}_parse_failed": F.col(f"{c}_parsed").isNull() & F.col(c).isNotNull()}
    for c in C.AMOUNTS:
        if c in strings:
            s = f"{c}_struct"
            more |= {f"{c}_amount_numeric": F.col(f"{s}.amount"), f"{c}_currency_code": F.col(f"{s}.currency"), f"{c}_amount_parse_failed": F.col(f"{s}.failed")}
    return df.withColumns(more).drop(*[f"{c}_struct" for c in C.AMOUNTS]) if more else df


def audit(df: DataFrame, key: str) -> DataFrame:
    """key, column_name, original_value, standardized_value of the values that parsing could not resolve."""
    failed = [F.struct(F.lit(c).alias("column_name"), F.col(f"{c}_raw").alias("original_value"), F.col(c).alias("standardized_value"), F.col(f).alias("failed")) for c in (*C.DATES, *C.AMOUNTS) for f in (f"{c}_parse_failed", f"{c}_amount_parse_failed") if f in df.columns]
    rows = df.select(key, F.explode(F.filter(F.array(*failed), lambda x: x["failed"])).alias("x"))
    return rows.select(key, "x.column_name", "x.original_value", "x.standardized_value")


def changes(df: DataFrame, key: str) -> DataFrame:
    """key, column_name, original_value, standardized_value of the identifiers whose text standardising changed."""
    found = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("original_value"), F.col(f"{c}_standardized").alias("standardized_value")) for c in C.IDENTIFIERS if f"{c}_standardized" in df.columns]
    rows = df.select(key, F.explode(F.filter(F.array(*found), lambda x: x["original_value"].isNotNull() & ~x["original_value"].eqNullSafe(x["standardized_value"]))).alias("x"))
    return rows.select(key, "x.*")


def summary(df: DataFrame, file: str = "source_file_name") -> DataFrame:
    """Of each feed: rows, dates and amounts that could not be parsed, identifiers changed."""
    changed = sum((F.coalesce(~F.col(c).eqNullSafe(F.col(f"{c}_standardized")) & F.col(c).isNotNull(), F.lit(False)).cast("int") for c in C.IDENTIFIERS if f"{c}_standardized" in df.columns), F.lit(0))
    dates, amounts = [f"{c}_parse_failed" for c in C.DATES if f"{c}_parse_failed" in df.columns], [f"{c}_amount_parse_failed" for c in C.AMOUNTS if f"{c}_amount_parse_failed" in df.columns]
    count = lambda names: F.sum(sum((F.coalesce(F.col(c), F.lit(False)).cast("int") for c in names), F.lit(0)))
    return df.groupBy(file).agg(F.count("*").alias("rows_processed"), count(dates).alias("invalid_dates"), count(amounts).alias("currency_parse_failures"), F.sum(changed).alias("normalization_actions"))
