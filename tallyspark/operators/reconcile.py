"""Reconciliation: refunds with originals, FX rates with treasury rates, transactions with settlements.

Input: a canonical view with row_id, txn_id, settlement_reference, link_reference, customer_id, amount, currency,
ts, settlement_date, txn_type, debit_credit, from_currency, to_currency, exchange_rate, reference_rate, conversion_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Config
from ..functions.columns import match_id

MATCHED = ["FULL_MATCH", "PARTIAL_MATCH", "AMOUNT_MISMATCH", "DATE_MISMATCH"]


def amount_ok(a: Column, b: Column, config: Config = Config()) -> Column:
    gap = F.abs(a - b)
    return F.coalesce((gap <= config.abs_tolerance) | (gap / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) <= config.pct_tolerance), F.lit(False))


def time_ok(a: Column, b: Column, config: Config = Config()) -> Column:
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.coalesce(F.abs(us(a) - us(b)) <= int(config.match_hours * 3_600_000_000), F.lit(False))


def _malformed(c: Column, least: int) -> Column:
    return (F.length(c) < least) | ~c.rlike("^[A-Z0-9./]+$")


def categories(rows: DataFrame) -> DataFrame:
    """category (REFUND, FX or TXN, in that order) and the normalised keys. Columns that are missing count as blank."""
    have = set(rows.columns)
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in have else F.lit("")
    kind = F.upper(text("txn_type"))
    refund = kind.rlike("REFUND|REVERSAL") | ((F.upper(text("debit_credit")) == "CREDIT") & F.coalesce(F.col("amount") < 0, F.lit(False)))
    a, b = F.upper(F.trim(text("from_currency"))), F.upper(F.trim(text("to_currency")))
    fx = (a != "") & (b != "") & (a != b) & F.col("exchange_rate").isNotNull() & F.col("reference_rate").isNotNull() & F.coalesce(F.col("reference_rate") != 0, F.lit(False))
    fx = fx & ((F.trim(text("conversion_id")) != "") | (F.trim(text("treasury_rate_reference")) != "") | kind.rlike("FX|CONVERSION|SPOT|FORWARD|SWAP"))
    out = rows.withColumns({"id": match_id(F.col("txn_id")), "sref": match_id(F.col("settlement_reference")), "link": match_id(F.col("link_reference"))})
    return out.withColumn("category", F.when(refund, "REFUND").when(fx, "FX").otherwise("TXN"))


#: Rows of a group of candidates that are looked at: the probe itself and two others tell none, one and many apart.
FEW = 3


def _index(rows: DataFrame, groups: Column) -> DataFrame:
    """k, prio, g, p_*: rows by transaction id (prio 1) or settlement reference (2, unless it is the id), under each of their groups;
    of each group the FEW smallest rows, so that a key shared by many rows meets none of its probes with all of them."""
    part = [F.col("row_id").alias("p_row"), F.col("amount").alias("p_amount"), F.col("ts").alias("p_ts"), F.explode(groups).alias("g")]
    by = rows.where("id != ''").select(F.col("id").alias("k"), F.lit(1).alias("prio"), *part)
    by = by.unionByName(rows.where("sref != '' AND sref != id").select(F.col("sref").alias("k"), F.lit(2).alias("prio"), *part))
    return by.withColumn("at", F.row_number().over(W.partitionBy("k", "prio", "g").orderBy("p_row"))).where(F.col("at") <= FEW).drop("at")


_BEST = ["p_row", "p_amount", "p_ts"]


def _tally(name: str, where: Column) -> list[Column]:
    """Of a probe's candidates: how many there are, and the first."""
    return [F.count_if(where).alias(f"n_{name}"), F.min(F.when(where, F.struct(*_BEST))).alias(f"b_{name}")]


def _choose(met: DataFrame, names: list[str]) -> DataFrame:
    """row_id, count, best: of the first of these groups that holds a candidate."""
    some = [F.when(F.col(f"n_{n}") > 0, F.struct(F.col(f"n_{n}").alias("n"), F.col(f"b_{n}").alias("b"))) for n in names]
    return met.select("row_id", F.coalesce(*some).alias("x")).where("x IS NOT NULL").select("row_id", F.col("x.n").alias("count"), "x.b.*")


def _decide(probe: DataFrame, found: DataFrame, empty, bad, missing, many, levels, ok_time) -> DataFrame:
    """One outcome for each probe row."""
    out = probe.join(found, "row_id", "left")
    amt, tim = amount_ok(F.col("amount"), F.col("p_amount")), ok_time
    one = F.when(amt & tim, F.lit(0)).when(amt, 1).when(tim, 2).otherwise(3)
    pick = lambda i: F.when(empty[0], empty[i]).when(bad[0], bad[i]).when(F.col("count").isNull(), missing[i]).when(F.col("count") > 1, many[i]).otherwise(F.element_at(F.array(*[F.lit(x[i - 1]) for x in levels]), one + 1))
    return out.select("row_id", "category", pick(1).alias("reconciliation_type"), pick(2).alias("confidence_score"), F.col("p_row").alias("matched_row"), F.when(F.col("count") == 1, F.abs(F.col("amount") - F.col("p_amount"))).alias("variance"), pick(3).alias("matching_logic"))


def _bucket(amount: Column) -> Column:
    """Amounts within the tolerance are at most one bucket apart: 0.02 wide up to 10, then 0.2 % of the amount."""
    x = F.abs(amount)
    return F.floor(F.when(x <= 10, x / 0.02).otherwise(500 + F.log(x / 10) / 0.002))


def _refunds(rows: DataFrame, config: Config) -> DataFrame:
    probe = rows.where("category = 'REFUND'")
    link, lit = F.col("link"), F.lit
    empty, bad = link == "", _malformed(link, 3)
    # groups of equal amounts in buckets; those without an amount; all, for refunds without one
    own = F.struct(F.coalesce(_bucket(F.col("amount")), lit(-1)).alias("bucket"), F.col("amount").alias("amount"))
    index = _index(rows, F.array(own, F.struct(lit(-9).cast("long").alias("bucket"), lit(None).cast("double").alias("amount"))))
    index = index.withColumn("bucket", F.col("g.bucket"))
    b = _bucket(F.col("amount"))
    near = F.when(F.col("amount").isNull(), F.array(lit(-9).cast("long"))).otherwise(F.array(lit(-1).cast("long"), *[F.when(b + i >= 0, b + i) for i in (-1, 0, 1)]))
    asked = probe.where(~(empty | bad)).select("row_id", "amount", link.alias("k"), F.explode(F.array_compact(near)).alias("bucket"))
    met = asked.join(index, ["k", "bucket"]).where("row_id != p_row")
    met = met.where(F.col("p_amount").isNull() | F.col("amount").isNull() | amount_ok(F.abs("amount"), F.abs("p_amount"), config))
    found = _choose(met.groupBy("row_id").agg(*_tally("id", F.col("prio") == 1), *_tally("ref", F.col("prio") == 2)), ["id", "ref"])
    return _decide(probe, found, (empty, lit("MISSING_SETTLEMENT"), lit(20), lit("missing_or_malformed_refund_link_reference")), (bad, lit("MISSING_SETTLEMENT"), lit(20), lit("missing_or_malformed_refund_link_reference")), (None, lit("MISSING_SETTLEMENT"), lit(25), lit("refund_link_not_found_on_ledger")), (None, lit("MULTIPLE_MATCHES"), lit(40), lit("multiple_original_candidates")), [(t, n, "reference_matches_original_txn_or_settlement") for t, n in (("FULL_MATCH", 100), ("DATE_MISMATCH", 70), ("AMOUNT_MISMATCH", 55), ("PARTIAL_MATCH", 45))], time_ok(F.col("ts"), F.col("p_ts"), config))


def _settlements(rows: DataFrame, config: Config) -> DataFrame:
    probe = rows.where("category = 'TXN'")
    sref, lit, none = F.col("sref"), F.lit, F.lit(None).cast("string")
    empty, bad = sref == "", _malformed(sref, 4)
    cur, who = F.coalesce("currency", lit("")), F.col("customer_id").cast("string")
    group = lambda kind, c, w: F.struct(lit(kind).alias("kind"), c.alias("cur"), w.alias("who"))
    index = _index(rows, F.filter(F.array(group("all", none, none), group("cur", cur, none), group("who", none, who), group("both", cur, who)), lambda g: g["kind"].isin("all", "cur") | g["who"].isNotNull()))
    # a blank currency fits all; a customer's own rows come first
    fits = F.when(cur == "", F.array(group("who", none, who))).otherwise(F.array(group("cur", cur, none), group("cur", lit(""), none), group("both", cur, who), group("both", lit(""), who)))
    asked = probe.where(~(empty | bad)).select("row_id", cur.alias("c"), sref.alias("k"), F.explode(F.concat(F.array(group("all", none, none)), fits)).alias("g"))
    flat = lambda df: df.withColumns({"kind": F.col("g.kind"), "cur": F.coalesce("g.cur", lit("\0")), "who": F.coalesce("g.who", lit("\0"))}).drop("g")
    met = flat(asked).join(flat(index), ["k", "kind", "cur", "who"]).where("row_id != p_row")
    kind, p1 = F.col("kind"), F.col("prio") == 1
    mine, fit = kind.isin("who", "both"), (kind == "cur") | ((kind == "all") & (F.col("c") == ""))
    met = met.groupBy("row_id").agg(F.max((kind == "all") & p1).alias("by_id"), *_tally("id_mine", mine & p1), *_tally("id_any", fit & p1), *_tally("ref_mine", mine & ~p1), *_tally("ref_any", fit & ~p1))
    met = met.withColumns({f"n_ref_{x}": F.when(F.col("by_id"), 0).otherwise(F.col(f"n_ref_{x}")) for x in ("mine", "any")})
    found = _choose(met, ["id_mine", "id_any", "ref_mine", "ref_any"])
    tim = time_ok(F.col("ts"), F.col("p_ts"), config) | time_ok(F.col("settlement_date"), F.col("p_ts"), config) | (F.col("ts").isNull() & F.col("settlement_date").isNull())
    return _decide(probe, found, (empty, lit("MISSING_SETTLEMENT"), lit(15), lit("empty_settlement_reference")), (bad, lit("PARTIAL_MATCH"), lit(35), lit("malformed_settlement_reference")), (None, lit("MISSING_SETTLEMENT"), lit(30), lit("settlement_reference_not_found")), (None, lit("MULTIPLE_MATCHES"), lit(45), lit("duplicate_collision_multiple_settlement_rows")), [(t, n, "settlement_reference_resolved_to_counterparty_txn_id") for t, n in (("FULL_MATCH", 100), ("DATE_MISMATCH", 72), ("AMOUNT_MISMATCH", 58), ("PARTIAL_MATCH", 48))], tim)


def _fx(rows: DataFrame, config: Config) -> DataFrame:
    rel = F.try_divide(F.abs(F.col("exchange_rate") - F.col("reference_rate")), F.abs("reference_rate"))
    kind = F.when(rel <= config.fx_tolerance, "FULL_MATCH").when(rel <= 5 * config.fx_tolerance, "PARTIAL_MATCH").otherwise("AMOUNT_MISMATCH")
    score = F.when(rel <= config.fx_tolerance, 100).when(rel <= 5 * config.fx_tolerance, 80).otherwise(50)
    return rows.where("category = 'FX'").select("row_id", "category", kind.alias("reconciliation_type"), score.alias("confidence_score"), F.lit(None).cast("long").alias("matched_row"), F.abs(F.col("exchange_rate") - F.col("reference_rate")).alias("variance"), F.lit("fx_pair_with_exchange_and_reference_rate").alias("matching_logic"))


def reconcile(rows: DataFrame, config: Config = Config()) -> DataFrame:
    """row_id, category, reconciliation_type, confidence_score, matched_row, variance, matching_logic: one row for each transaction."""
    rows = categories(rows)
    return _refunds(rows, config).unionByName(_fx(rows, config)).unionByName(_settlements(rows, config))


def summary(audit: DataFrame, duplicates: DataFrame | None = None) -> DataFrame:
    """One row; with the duplicate run's summary, its pair counts beside it."""
    t = F.col("reconciliation_type")
    one = audit.agg(F.count("*").alias("total_rows"), F.count_if(t.isin(MATCHED)).alias("total_matched"), F.count_if(~t.isin(MATCHED)).alias("unmatched"), *[F.count_if(t == k).alias(k.lower()) for k in (*MATCHED, "MISSING_SETTLEMENT", "MULTIPLE_MATCHES")], F.coalesce(F.sum(F.col("variance").cast("decimal(30,6)")), F.lit(0)).cast("double").alias("amount_variance_total"))
    if duplicates is None:
        return one
    return one.crossJoin(duplicates.select(*[F.col(f"{x}_pairs").alias(f"duplicate_{x}_pairs") for x in ("exact", "fuzzy", "retry", "possible")]))  # a row each


def confidence(audit: DataFrame) -> DataFrame:
    c = F.col("confidence_score")
    bucket = F.when(c == 100, "100").when(c >= 80, "80-99").when(c >= 50, "50-79").otherwise("<50")
    return audit.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def fx_mart(rows: DataFrame, config: Config = Config()) -> DataFrame:
    """Signed percentage of each FX row's rate against the treasury rate, and whether the trade is stale at as_of."""
    r = categories(rows).where("category = 'FX'")
    pct = F.bround(F.try_divide(F.col("exchange_rate") - F.col("reference_rate"), F.col("reference_rate")) * 100, 6)
    age = F.floor((F.unix_seconds(F.lit(config.as_of).cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))) / 86400)
    return r.select("row_id", "txn_id", F.concat_ws("/", "from_currency", "to_currency").alias("currency_pair"), F.col("reference_rate").alias("treasury_rate"), F.col("exchange_rate").alias("transaction_rate"), pct.alias("variance_pct"), (F.col("ts").isNull() | (age > config.stale_days)).alias("stale_fx_indicator"))
