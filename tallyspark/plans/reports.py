"""Marts and report frames. All figures are computed from the data; where there is none, there is no row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.columns import entity_name, percent

ACTIONS = {"MISSING_SETTLEMENT": "Find the settlement", "MULTIPLE_MATCHES": "Choose one match", "AMOUNT_MISMATCH": "Check the amount", "DATE_MISMATCH": "Check the dates", "PARTIAL_MATCH": "Check the reference", "FULL_MATCH": "None"}


def transaction_master(rows: DataFrame, audit: DataFrame, status: DataFrame) -> DataFrame:
    """A row for each transaction with its match and its strongest duplicate class."""
    a = audit.select("row_id", F.col("reconciliation_type").alias("reconciliation_status"), "confidence_score")
    return rows.join(a, "row_id", "left").join(status, "row_id", "left").select("row_id", "txn_id", "customer_id", "amount", "currency", F.coalesce("reconciliation_status", F.lit("UNMATCHED")).alias("reconciliation_status"), F.coalesce("confidence_score", F.lit(0)).alias("confidence_score"), F.coalesce("duplicate_status", F.lit("NOT_DUPLICATE")).alias("duplicate_status"))


def full_master(rows: DataFrame, audit: DataFrame, status: DataFrame, at: str, batch: str) -> DataFrame:
    """The transaction master with all its 17 columns, of a canonical view."""
    partner = rows.select(F.col("row_id").alias("matched_row"), F.col("txn_id").alias("matched_transaction_id"))
    a = audit.join(partner, "matched_row", "left").select("row_id", "reconciliation_type", "confidence_score", F.col("category").alias("reconciliation_category"), "matched_transaction_id", "matching_logic")
    m = rows.join(a, "row_id", "left").join(status, "row_id", "left")
    return m.select(
        F.col("row_id").alias("pipeline_row_id"), F.col("txn_id").alias("transaction_id"), F.col("amount").alias("standardized_amount"), F.col("currency").alias("currency_code"),
        F.coalesce("reconciliation_type", F.lit("UNKNOWN")).alias("reconciliation_status"), "validation_status", F.coalesce("duplicate_status", F.lit("NOT_DUPLICATE")).alias("duplicate_status"),
        F.coalesce("confidence_score", F.lit(0)).alias("reconciliation_confidence"), F.coalesce("matched_transaction_id", F.lit("")).alias("matched_transaction_id"), F.coalesce("reconciliation_category", F.lit("")).alias("reconciliation_category"),
        F.coalesce("matching_logic", F.lit("")).alias("matching_logic_used"), *[F.lit(at).alias(f"{x}_timestamp") for x in ("ingestion", "standardization", "validation", "reconciliation")], F.lit(batch).alias("processing_batch_id"), F.col("source_file_name").alias("source_gold_file"),
    )


def validation_mart(summary: DataFrame, audit: DataFrame) -> DataFrame:
    """One row over all feeds: rows by route and severity, triggers, different rules triggered."""
    total = summary.agg(F.coalesce(F.sum("rows_processed"), F.lit(0)).alias("total_rows_processed"), *[F.coalesce(F.sum(f"rows_{x}"), F.lit(0)).alias(f"total_{x}") for x in ("valid", "warning", "rejected")], *[F.coalesce(F.sum(f"s{i}"), F.lit(0)).alias(f"severity_S{i}") for i in range(6)])
    rules = audit.groupBy("rule_name").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("validation_rule_trigger_count"), F.count("*").alias("validation_unique_rules_triggered"))
    return total.crossJoin(rules)  # a row each


def reconciliation_mart(summary: DataFrame) -> DataFrame:
    """The reconciliation summary with a column for each type."""
    types = ["FULL_MATCH", "PARTIAL_MATCH", "DATE_MISMATCH", "AMOUNT_MISMATCH", "MISSING_SETTLEMENT", "MULTIPLE_MATCHES"]
    return summary.select(*[F.col(t.lower()).alias(t) for t in types], "total_rows", "total_matched", "unmatched", "amount_variance_total")


def fx_breaches(mart: DataFrame, breach: float = 2.0) -> DataFrame:
    return mart.where(F.abs("variance_pct") > breach)


def duplicate_sources(pairs: DataFrame, rows: DataFrame, n: int = 15) -> DataFrame:
    """The n feeds with most ends of pairs (ties: by name)."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("row_id")).join(rows.select("row_id", entity_name(F.col("source_file_name")).alias("entity")), "row_id")
    return ends.groupBy("entity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity").limit(n)


def alerts(kpis: DataFrame) -> DataFrame:
    """alert: a line for each figure beyond its target; one line if there is none."""
    k = F.array_compact(F.array(
        F.when(F.col("validation_success_pct") < 95, F.format_string("Validation success %.2f%% is below 95%%", "validation_success_pct")),
        F.when(F.col("match_rate_pct") < 98, F.format_string("Match rate %.2f%% is below 98%%", "match_rate_pct")),
        F.when(F.col("unresolved") > 0, F.format_string("%d unresolved reconciliation rows", "unresolved")),
    ))
    return kpis.select(F.explode(F.when(F.size(k) > 0, k).otherwise(F.array(F.lit("All figures within their targets")))).alias("alert"))


def executive_kpis(validation: DataFrame, recon: DataFrame) -> DataFrame:
    """One row of rates from the validation summary and the reconciliation summary."""
    v = validation.agg(*[F.sum(c).alias(c) for c in ("rows_processed", "rows_valid", "rows_warning", "rows_rejected")])
    both = v.crossJoin(recon.select("total_rows", "total_matched", (F.col("missing_settlement") + F.col("multiple_matches")).alias("unresolved")))
    return both.select("rows_processed", "rows_valid", "rows_warning", "rows_rejected", percent(F.col("rows_valid"), F.col("rows_processed")).alias("validation_success_pct"), percent(F.col("total_matched"), F.col("total_rows")).alias("match_rate_pct"), "unresolved")


def scorecard(kpis: DataFrame) -> DataFrame:
    """metric, value, target, status."""
    rows = [("validation_success_pct", 95.0, True), ("match_rate_pct", 98.0, True), ("unresolved", 0.0, False)]
    x = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"), F.lit(t).alias("target"), F.when((F.col(n) >= t) if up else (F.col(n) <= t), "PASS").otherwise("BREACH").alias("status")) for n, t, up in rows]))
    return kpis.select(x.alias("x")).select("x.*")


def exception_register(audit: DataFrame) -> DataFrame:
    t = F.col("reconciliation_type")
    sev = F.when(t.isin("MISSING_SETTLEMENT", "MULTIPLE_MATCHES"), "S5").when(t.isin("FULL_MATCH", "PARTIAL_MATCH", "AMOUNT_MISMATCH", "DATE_MISMATCH"), "S2").otherwise("S4")
    action = F.coalesce(*[F.when(t == k, F.lit(v)) for k, v in ACTIONS.items()], F.lit("Review"))
    return audit.select("row_id", "reconciliation_type", sev.alias("severity"), F.when(sev == "S2", "RESOLVED").otherwise("OPEN").alias("status"), F.when(sev.isin("S4", "S5"), "Reconciliation Desk").otherwise("Operations").alias("owner"), action.alias("action"))


def unresolved(audit: DataFrame) -> DataFrame:
    return audit.where(F.col("reconciliation_type").isin("MISSING_SETTLEMENT", "MULTIPLE_MATCHES", "UNMATCHED", "BREAK")).select("row_id", "reconciliation_type", "confidence_score")


def aging(rows: DataFrame, audit: DataFrame, config: Config = Config()) -> DataFrame:
    """Unresolved rows by their true age in days at as_of."""
    d = F.datediff(F.to_date(F.lit(config.as_of)), F.to_date("ts"))
    bucket = F.when(d.isNull(), "unknown").when(d <= 1, "0-1").when(d <= 3, "2-3").when(d <= 7, "4-7").when(d <= 30, "8-30").otherwise("31+")
    return unresolved(audit).join(rows.select("row_id", "ts"), "row_id").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def entity_performance(summary: DataFrame, entity: str, n: int = 10) -> DataFrame:
    """The n feeds with the largest share of rejected rows (then most S5, then by name)."""
    by = summary.select(F.col(entity).alias("entity"), "rows_processed", "rows_valid", "rows_rejected", "s3", "s4", "s5", percent(F.col("rows_rejected"), F.col("rows_processed")).alias("reject_pct"))
    return by.orderBy(F.desc("reject_pct"), F.desc("s5"), "entity").limit(n)


def fx_concentration(mart: DataFrame, n: int = 12, breach: float = 2.0) -> DataFrame:
    return mart.groupBy("currency_pair").agg(F.count("*").alias("n"), F.count_if(F.abs("variance_pct") > breach).alias("breaches")).orderBy(F.desc("n"), "currency_pair").limit(n)


def profile(df: DataFrame) -> DataFrame:
    """column_name, rows, nulls, distinct_values of every column: counted by (column, value), so rows are not expanded for each column's distinct values at once."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in df.columns])).alias("x")).select("x.*")
    by = cells.groupBy("column_name", "v").agg(F.count("*").alias("n")).groupBy("column_name")
    return by.agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count("v").alias("distinct_values"))


def stages(counts: dict[str, DataFrame]) -> DataFrame:
    """stage, rows of each named frame."""
    out = None
    for name, df in counts.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("stage"), "rows")
        out = one if out is None else out.union(one)
    return out
