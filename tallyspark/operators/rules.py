"""Validation: an ordered list of rules as boolean columns; severity, triggers, status, routing and audit follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import is_blank

Rule = tuple[str, Column, int]


def catalog(df: DataFrame, config: C.Config = C.Config()) -> list[Rule]:
    """(name, condition, rank) of each rule that the columns of a silver feed allow. Missing columns count as blank."""
    have = set(df.columns)
    col = lambda n: F.col(n) if n in have else F.lit(None).cast("string")
    num = lambda n: F.col(n).cast("double") if n in have else F.lit(None).cast("double")
    text = lambda n: F.coalesce(F.trim(col(n)), F.lit(""))
    yes = lambda c: F.coalesce(c, F.lit(False))
    when = col("messy_txn_date_parsed").cast("timestamp")
    value = F.coalesce(num("messy_amount_amount_numeric"), num("amount_inr_amount_numeric"))
    money = F.when(is_blank(col("messy_amount_currency_code")), col("operating_currency")).otherwise(col("messy_amount_currency_code"))
    account = F.when(is_blank(col("primary_account_number_standardized")), col("primary_account_number")).otherwise(col("primary_account_number_standardized"))
    rules: list[Rule] = [
        ("mandatory_transaction_id", is_blank(col("txn_id_standardized")), 5),
        ("mandatory_transaction_date", when.isNull() & is_blank(col("messy_txn_date")), 5),
        ("mandatory_transaction_amount", value.isNull(), 5),
        ("mandatory_currency_code", is_blank(money), 5),
        ("mandatory_account_id", is_blank(account), 5),
        ("date_future", yes(when > F.lit(config.as_of).cast("timestamp")), 3),
        ("date_impossible", yes((F.year(when) < config.years[0]) | (F.year(when) > config.years[1])), 5),
        ("amount_non_positive", yes(value <= 0), 3),
        ("amount_overflow", yes(F.abs(value) > config.max_amount), 4),
        ("amount_parse_failed", yes(col("messy_amount_amount_parse_failed").cast("boolean")), 4),
    ]
    if "txn_date_parse_failed" in have:
        rules.append(("date_parse_failed", yes(F.col("txn_date_parse_failed").cast("boolean")) & (text("messy_txn_date") != ""), 4))
    if {"from_currency", "to_currency"} <= have:
        a, b, rate = text("from_currency"), text("to_currency"), num("exchange_rate")
        pair = (a != "") & (b != "") & (a != b)
        rules += [
            ("fx_missing_rate", pair & (rate.isNull() | yes(rate <= 0)), 3),
            ("fx_invalid_rate", pair & yes(rate <= 0), 3),
            ("fx_unsupported_currency", ((a != "") & ~a.isin(C.SUPPORTED)) | ((b != "") & ~b.isin(C.SUPPORTED)), 2),
        ]
    code = lambda n: F.coalesce(F.nullif(text(f"{n}_standardized"), F.lit("")), text(n))
    bic = lambda n: (code(n) != "") & ~code(n).rlike("^[A-Z0-9]{8}([A-Z0-9]{3})?$")
    rules += [
        ("identifier_ifsc_malformed", (code("destination_ifsc") != "") & ~code("destination_ifsc").rlike("^[A-Z]{4}0[A-Z0-9]{6}$"), 3),
        ("identifier_bic_malformed", bic("swift_code") | bic("counterparty_bic"), 3),
        ("identifier_branch_short", (code("branch_code") != "") & (F.length(code("branch_code")) < config.min_branch), 3),
    ]
    for field, (name, allowed) in C.ALLOWED.items():
        if field in have:
            rules.append((name, (F.upper(text(field)) != "") & ~F.upper(text(field)).isin(allowed), 3))
    if "id_count" in have:
        rules.append(("duplicate_transaction_id", F.col("id_count") > 1, 2))
    cells = [F.col(c).cast("string") for c, t in df.dtypes if t == "string" and not c.startswith("source_file")]
    if cells:
        empty = F.aggregate(F.array(*cells), F.lit(0), lambda n, x: n + F.coalesce(F.lower(F.trim(x)).isin("", "nan", "none", "nat"), F.lit(True)).cast("int"))
        rules += [
            ("null_density_high", empty >= F.lit(config.null_density * len(cells)), 1),
            ("placeholder_value", F.exists(F.array(*cells), lambda x: yes(F.upper(F.trim(x)).isin(C.PLACEHOLDERS))), 2),
            ("unicode_replacement", F.concat_ws(" ", *cells).contains("�"), 2),
        ]
    return rules


def count_ids(df: DataFrame, file: str = "source_file_name") -> DataFrame:
    """id_count: how often a row's id occurs in its file (blank ids count once); counted first, then joined, so a hot id is one row of the join's small side."""
    key = F.col("txn_id_standardized")
    counts = df.where(~is_blank(key)).groupBy(F.col(file).alias("_f"), key.alias("_id")).agg(F.count("*").alias("id_count")).where("id_count > 1")
    out = df.join(counts, (df[file].eqNullSafe(counts["_f"])) & (key == counts["_id"]), "left").drop("_f", "_id")
    return out.withColumn("id_count", F.coalesce("id_count", F.lit(1)))


def validate(df: DataFrame, config: C.Config = C.Config()) -> DataFrame:
    """validation_rank, validation_severity, validation_status, validation_rule_triggered beside the feed's columns."""
    # each condition stands once in the plan: generated code stays small enough to be compiled
    hits = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("name"), F.lit(r).alias("rank"))) for n, c, r in sorted(catalog(df, config), key=lambda x: x[0])]))
    df = df.withColumn("_hits", hits)
    rank = F.coalesce(F.array_max(F.transform("_hits", lambda x: x["rank"])), F.lit(0))
    names = F.array_join(F.transform("_hits", lambda x: x["name"]), "|")
    df = df.withColumns({"validation_rank": rank, "validation_rule_triggered": names}).drop("_hits")
    return df.withColumns({"validation_severity": F.concat(F.lit("S"), F.col("validation_rank")), "validation_status": F.when(F.col("validation_rank") == 0, "VALID").when(F.col("validation_rank") >= config.reject_from, "REJECTED").otherwise("WARNING")})


def route(df: DataFrame, status: str) -> DataFrame:
    return df.where(F.col("validation_status") == status)


def audit(df: DataFrame, key: str) -> DataFrame:
    """A row for each (row, rule triggered), with the row's severity and status."""
    # no filter of the rows: pushed below the rules, it would compute them all a second time
    names = F.filter(F.split("validation_rule_triggered", r"\|"), lambda x: x != "")
    return df.select(key, F.explode(names).alias("rule_name"), "validation_severity", "validation_status")


def summary(df: DataFrame, file: str = "source_file_name") -> DataFrame:
    n = lambda c: F.count_if(c).alias
    s = F.col("validation_status")
    return df.groupBy(file).agg(F.count("*").alias("rows_processed"), n(s == "REJECTED")("rows_rejected"), n(s == "WARNING")("rows_warning"), n(s == "VALID")("rows_valid"), *[n(F.col("validation_rank") == i)(f"s{i}") for i in range(6)], n(F.col("id_count") > 1)("duplicate_transaction_count"))


def top_rules(df: DataFrame, key: str, n: int = 25) -> DataFrame:
    return audit(df, key).groupBy("rule_name").agg(F.count("*").alias("failures")).orderBy(F.desc("failures"), "rule_name").limit(n)


def null_coverage(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, null_pct of each mandatory field."""
    one = df.agg(*[F.bround(100 * F.avg(is_blank(F.col(f).cast("string")).cast("double")), 4).alias(f) for f in fields])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("null_pct")) for f in fields])).alias("x")).select("x.*")


__all__ = ["audit", "catalog", "count_ids", "null_coverage", "route", "summary", "top_rules", "validate"]
