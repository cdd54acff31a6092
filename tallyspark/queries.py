"""Registered queries of the engine's own operators, and independent DuckDB SQL for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as C
from .functions import columns as X
from .functions.similarity import ratio, token_sort_ratio
from .operators import duplicates as D
from .operators import reconcile as R
from .operators import canonical, rules, standardize
from .plans import reports
from .sources import csv, feeds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _txn(spark, d):
    return feeds.feed(spark, d, feeds.TXN)


def _silver(spark, d):
    return standardize.standardize(standardize.rename(_txn(spark, d)))


def _checked(spark, d):
    return rules.validate(rules.count_ids(_silver(spark, d)))


def _ledger(spark, d):
    return feeds.feed(spark, d, feeds.LEDGER)


def _audit(spark, d):
    return R.reconcile(_ledger(spark, d))


def _two(spark, d):
    return feeds.feed(spark, d, feeds.TWO_FEEDS)


def _events(spark, d):
    return feeds.feed(spark, d, feeds.EVENTS)


def _in(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


# ---- DuckDB SQL shared by the oracles
def _s(c: str) -> str:
    """Sanitised text."""
    t = f"trim(regexp_replace(translate(regexp_replace({c}, '[{C.INVISIBLE}]', '', 'g'), '‘’“”', '''''\"\"'), '\\s+', ' ', 'g'))"
    return f"CASE WHEN lower({t}) NOT IN ({_in(C.NULL_TOKENS)}) THEN {t} END"


_SYM = " ".join(f"WHEN contains(lower(s), '{k}') THEN '{v}'" for k, v in C.SYMBOLS)
_AMOUNT = f"""a0 AS (SELECT row_id, {_s("messy_amount")} AS s FROM feed),
a1 AS (SELECT row_id, s, trim(regexp_replace(regexp_replace(s, '\\b[Rr][Ss]\\b\\.?', '', 'g'), '\\b[A-Za-z]{{3}}\\b|[₹$€£]', '', 'g')) AS bare FROM a0),
a2 AS (SELECT *, regexp_replace(bare, '[^0-9,.]', '', 'g') AS t, (starts_with(bare, '(') AND ends_with(bare, ')')) OR starts_with(bare, '-') AS neg FROM a1),
a3 AS (SELECT *, TRY_CAST(CASE WHEN contains(t, ',') AND contains(t, '.') THEN
      CASE WHEN length(t) - strpos(reverse(t), '.') > length(t) - strpos(reverse(t), ',') THEN replace(t, ',', '') ELSE replace(replace(t, '.', ''), ',', '.') END
    WHEN contains(t, ',') THEN CASE WHEN regexp_matches(t, ',\\d{{2}}$') THEN replace(left(t, length(t) - 3), ',', '') || '.' || right(t, 2) ELSE replace(t, ',', '') END
    WHEN regexp_matches(t, '\\.\\d{{3}}\\.\\d{{2}}$') THEN replace(left(t, length(t) - 3), '.', '') || right(t, 3) ELSE t END AS DOUBLE) AS v, coalesce(regexp_matches(t, '\\d'), false) AS digits FROM a2),
amounts AS (SELECT row_id, CASE WHEN digits THEN CASE WHEN neg THEN -v ELSE v END END AS amount, digits AND v IS NULL AS failed,
  CASE WHEN digits THEN CASE WHEN regexp_extract(upper(s), '\\b([A-Z]{{3}})\\b', 1) IN ({_in(C.ISO_CODES)}) THEN regexp_extract(upper(s), '\\b([A-Z]{{3}})\\b', 1) {_SYM} WHEN contains(upper(s), 'RS') THEN 'INR' END END AS currency FROM a3)"""
_DATE = f"""dates AS (SELECT row_id, s, CASE WHEN regexp_matches(s, '^\\d{{8}}$') THEN try_strptime(s, '%Y%m%d') WHEN regexp_matches(s, '^\\d{{4}}') THEN try_strptime(replace(s, '/', '-'), '%Y-%m-%d')
  ELSE coalesce(try_strptime(replace(replace(s, '/', '-'), '.', '-'), '%d-%m-%Y'), try_strptime(replace(replace(s, '/', '-'), '.', '-'), '%m-%d-%Y')) END AS dated FROM (SELECT row_id, {_s("messy_txn_date")} AS s FROM feed))"""


def _id(c: str) -> str:
    return f"regexp_replace(upper(regexp_replace({_s(c)}, '^(\\d+)\\.0$', '\\1')), '[^0-9A-Z]', '', 'g')"


def _mid(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR lower(trim({c})) IN ('', 'nan', 'none') THEN '' ELSE upper(regexp_replace(trim({c}), '[\\s\\-_]', '', 'g')) END"


def _enum(c: str, known: dict) -> str:
    return f"CASE {' '.join(f'WHEN lower({_s(c)}) = {k!r} THEN {v!r}' for k, v in known.items())} ELSE upper({_s(c)}) END" if known else f"upper({_s(c)})"


_FEED = f"feed AS ({feeds.TXN})"
_SILVER = f"""WITH {_FEED}, {_AMOUNT}, {_DATE},
silver AS (SELECT feed.row_id, source_file_name, {_id("txn_id")} AS tid, messy_txn_date AS raw_date, dates.s AS date_text, dated, amount, failed, currency, {_id("primary_account_number")} AS account,
  {_enum("debit_credit", C.SYNONYMS["debit_credit"])} AS dc, {_enum("status", C.SYNONYMS["status"])} AS st, coalesce({_id("destination_ifsc")}, '') AS ifsc, coalesce(upper({_s("from_currency")}), '') AS fc, coalesce(upper({_s("to_currency")}), '') AS tc, exchange_rate AS rate
  FROM feed JOIN amounts USING (row_id) JOIN dates USING (row_id)),
counted AS (SELECT *, CASE WHEN tid IS NULL OR lower(trim(tid)) IN ('', 'nan', 'none') THEN 1 ELSE count(*) OVER (PARTITION BY source_file_name, tid) END AS id_count FROM silver)"""
_PAIR = "fc <> '' AND tc <> '' AND fc <> tc"
_RULES = {
    "mandatory_transaction_id": ("tid IS NULL OR lower(trim(tid)) IN ('', 'nan', 'none')", 5),
    "mandatory_transaction_date": ("dated IS NULL AND (date_text IS NULL OR date_text = '')", 5),
    "mandatory_transaction_amount": ("amount IS NULL", 5),
    "mandatory_currency_code": ("currency IS NULL", 5),
    "mandatory_account_id": ("account IS NULL OR account = ''", 5),
    "date_future": ("dated > TIMESTAMP '2024-06-30 00:00:00'", 3),
    "date_impossible": ("year(dated) < 1900 OR year(dated) > 2100", 5),
    "amount_non_positive": ("amount <= 0", 3),
    "amount_overflow": ("abs(amount) > 1e15", 4),
    "amount_parse_failed": ("failed", 4),
    "fx_missing_rate": (f"{_PAIR} AND (rate IS NULL OR rate <= 0)", 3),
    "fx_invalid_rate": (f"{_PAIR} AND rate <= 0", 3),
    "fx_unsupported_currency": (f"(fc <> '' AND fc NOT IN ({_in(C.SUPPORTED)})) OR (tc <> '' AND tc NOT IN ({_in(C.SUPPORTED)}))", 2),
    "identifier_ifsc_malformed": ("ifsc <> '' AND NOT regexp_full_match(ifsc, '[A-Z]{4}0[A-Z0-9]{6}')", 3),
    "enum_invalid_transaction_status": (f"coalesce(st, '') <> '' AND st NOT IN ({_in(C.ALLOWED['status'][1])})", 3),
    "enum_invalid_debit_credit": ("coalesce(dc, '') <> '' AND dc NOT IN ('DEBIT', 'CREDIT')", 3),
    "duplicate_transaction_id": ("id_count > 1", 2),
}
_CHECKED = f"""{_SILVER}, checked AS (SELECT *, greatest(0, {", ".join(f"CASE WHEN {c} THEN {r} ELSE 0 END" for c, r in _RULES.values())}) AS rank,
  array_to_string(list_sort(list_filter([{", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, (c, _) in _RULES.items())}], lambda x: x IS NOT NULL)), '|') AS triggered FROM counted),
final AS (SELECT *, CASE WHEN rank = 0 THEN 'VALID' WHEN rank >= 4 THEN 'REJECTED' ELSE 'WARNING' END AS status FROM checked)"""

_SUMMARY = """SELECT source_file_name, count(*) AS rows_processed, count(*) FILTER (status = 'REJECTED') AS rows_rejected, count(*) FILTER (status = 'WARNING') AS rows_warning, count(*) FILTER (status = 'VALID') AS rows_valid,
  count(*) FILTER (rank = 0) AS s0, count(*) FILTER (rank = 1) AS s1, count(*) FILTER (rank = 2) AS s2, count(*) FILTER (rank = 3) AS s3, count(*) FILTER (rank = 4) AS s4, count(*) FILTER (rank = 5) AS s5,
  count(*) FILTER (id_count > 1) AS duplicate_transaction_count FROM final GROUP BY 1"""

_DUP = f"""WITH f AS ({feeds.TWO_FEEDS}), k AS (SELECT *, {_mid("txn_id")} AS i, {_mid("reference")} AS r FROM f),
exact AS (SELECT a.row_id AS a, b.row_id AS b, 'EXACT_DUPLICATE' AS duplicate_classification, 100 AS duplicate_confidence, 'same_id_amount_second' AS duplicate_logic
  FROM k a JOIN k b ON a.i = b.i AND a.i <> '' AND round_even(a.amount, 6) = round_even(b.amount, 6) AND date_trunc('second', a.ts) = date_trunc('second', b.ts) AND a.row_id < b.row_id),
replay AS (SELECT a.row_id AS a, b.row_id AS b, 'RETRY_PATTERN' AS duplicate_classification, 88 AS duplicate_confidence, 'reference_replay' AS duplicate_logic FROM k a JOIN k b ON a.r = b.r AND a.r <> '' AND a.i <> b.i AND a.row_id < b.row_id)"""
_RETRY = f"""retry AS (SELECT a.row_id AS a, b.row_id AS b, 'RETRY_PATTERN' AS duplicate_classification, CAST(greatest(50, floor(95 - least(45.0, abs(epoch_us(a.ts) - epoch_us(b.ts)) / 1000000.0))) AS INT) AS duplicate_confidence,
  'same_customer_amount_within_window' AS duplicate_logic FROM e a JOIN e b ON a.customer_id = b.customer_id AND round_even(a.amount, 2) = round_even(b.amount, 2) AND a.row_id < b.row_id AND a.txn_id <> b.txn_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 300000000)"""

_RECON = f"""WITH l0 AS ({feeds.LEDGER}), l AS (SELECT *, {_mid("txn_id")} AS id, {_mid("settlement_reference")} AS sref, {_mid("link_reference")} AS link,
  CASE WHEN regexp_matches(upper(txn_type), 'REFUND|REVERSAL') OR (debit_credit = 'CREDIT' AND amount < 0) THEN 'REFUND'
    WHEN from_currency <> '' AND to_currency <> '' AND from_currency <> to_currency AND exchange_rate IS NOT NULL AND reference_rate <> 0 AND (conversion_id <> '' OR regexp_matches(upper(txn_type), 'FX|CONVERSION|SPOT|FORWARD|SWAP')) THEN 'FX' ELSE 'TXN' END AS category FROM l0),
probe AS (SELECT *, CASE category WHEN 'REFUND' THEN link ELSE sref END AS probe_key, CASE category WHEN 'REFUND' THEN 3 ELSE 4 END AS least_len FROM l WHERE category <> 'FX'),
hits AS (SELECT p.row_id, p.category, p.amount, p.ts, p.settlement_date, p.currency, p.customer_id, q.row_id AS p_row, q.amount AS p_amount, q.ts AS p_ts, q.currency AS p_currency, q.customer_id AS p_customer, CASE WHEN q.id = p.probe_key THEN 1 ELSE 2 END AS prio
  FROM probe p JOIN l q ON p.probe_key <> '' AND (q.id = p.probe_key OR q.sref = p.probe_key) AND p.row_id <> q.row_id),
near AS (SELECT *, abs(amount - p_amount) <= 0.01 OR abs(amount - p_amount) / greatest(abs(amount), abs(p_amount), 1.0) <= 0.001 AS amt, abs(epoch_us(ts) - epoch_us(p_ts)) <= 259200000000 AS tim FROM hits),
c1 AS (SELECT * FROM near WHERE category = 'TXN' OR amt OR abs(abs(amount) - abs(p_amount)) <= 0.01),
c2 AS (SELECT * FROM c1 QUALIFY prio = min(prio) OVER (PARTITION BY row_id)),
c3 AS (SELECT * FROM c2 WHERE category = 'REFUND' OR currency = '' OR p_currency = '' OR currency = p_currency),
c4 AS (SELECT * FROM c3 QUALIFY category = 'REFUND' OR customer_id = p_customer OR NOT bool_or(customer_id = p_customer) OVER (PARTITION BY row_id)),
c5 AS (SELECT *, count(*) OVER (PARTITION BY row_id) AS n FROM c4 QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY prio, p_row) = 1),
o AS (SELECT p.row_id, p.category, CASE WHEN probe_key = '' THEN 1 WHEN length(probe_key) < least_len OR NOT regexp_full_match(probe_key, '[A-Z0-9./]+') THEN 2 WHEN n IS NULL THEN 3 WHEN n > 1 THEN 4 WHEN amt AND tim THEN 5 WHEN amt THEN 6 WHEN tim THEN 7 ELSE 8 END AS k,
  c5.p_row, abs(c5.amount - c5.p_amount) AS gap, n FROM probe p LEFT JOIN c5 USING (row_id)),
audit AS (SELECT row_id, category, CASE WHEN category = 'REFUND' THEN ['MISSING_SETTLEMENT','MISSING_SETTLEMENT','MISSING_SETTLEMENT','MULTIPLE_MATCHES','FULL_MATCH','DATE_MISMATCH','AMOUNT_MISMATCH','PARTIAL_MATCH'][k]
    ELSE ['MISSING_SETTLEMENT','PARTIAL_MATCH','MISSING_SETTLEMENT','MULTIPLE_MATCHES','FULL_MATCH','DATE_MISMATCH','AMOUNT_MISMATCH','PARTIAL_MATCH'][k] END AS reconciliation_type,
  CASE WHEN category = 'REFUND' THEN [20,20,25,40,100,70,55,45][k] ELSE [15,35,30,45,100,72,58,48][k] END AS confidence_score, CASE WHEN k > 3 THEN p_row END AS matched_row, CASE WHEN k > 4 THEN gap END AS variance FROM o
  UNION ALL SELECT row_id, category, CASE WHEN rel <= 0.02 THEN 'FULL_MATCH' WHEN rel <= 0.1 THEN 'PARTIAL_MATCH' ELSE 'AMOUNT_MISMATCH' END, CASE WHEN rel <= 0.02 THEN 100 WHEN rel <= 0.1 THEN 80 ELSE 50 END, NULL, abs(exchange_rate - reference_rate)
  FROM (SELECT *, abs(exchange_rate - reference_rate) / abs(reference_rate) AS rel FROM l WHERE category = 'FX'))"""
_FX = """fx AS (SELECT row_id, txn_id, from_currency || '/' || to_currency AS currency_pair, CAST(reference_rate AS DOUBLE) AS treasury_rate, CAST(exchange_rate AS DOUBLE) AS transaction_rate, round((exchange_rate - reference_rate) / reference_rate * 100, 6) AS variance_pct,
  ts IS NULL OR floor((epoch(TIMESTAMP '2024-06-30') - epoch(ts)) / 86400) > 90 AS stale_fx_indicator FROM l WHERE category = 'FX')"""


# ---- functions
@query(f"WITH {_FEED} SELECT row_id, {_s('txn_id')} AS txn_id, upper({_s('exception_code')}) AS exception_code, {_s('messy_amount')} AS messy_amount FROM feed")
def sanitize_strings(spark, d):
    f = _txn(spark, d)
    return f.select("row_id", X.sanitize(F.col("txn_id")).alias("txn_id"), X.sanitize(F.col("exception_code"), True).alias("exception_code"), X.sanitize(F.col("messy_amount")).alias("messy_amount"))


@query(f"WITH {_FEED}, {_AMOUNT} SELECT row_id, amount, currency, failed FROM amounts")
def parse_amount(spark, d):
    return _txn(spark, d).select("row_id", X.amount(X.sanitize(F.col("messy_amount"))).alias("x")).select("row_id", "x.*")


@query(f"WITH {_FEED}, {_DATE} SELECT row_id, strftime(dated, '%Y-%m-%d') AS parsed, CASE WHEN dated IS NULL THEN 0.0 ELSE 0.92 END AS confidence FROM dates")
def parse_dates(spark, d):
    t = _txn(spark, d).select("row_id", X.date(X.sanitize(F.col("messy_txn_date"))).alias("at"))
    return t.select("row_id", F.date_format("at", "yyyy-MM-dd").alias("parsed"), F.when(F.col("at").isNull(), 0.0).otherwise(0.92).alias("confidence"))


@query(f"WITH {_FEED} SELECT row_id, {_id('txn_id')} AS txn_id, {_id('settlement_reference')} AS settlement_reference FROM feed")
def standardize_identifiers(spark, d):
    return _silver(spark, d).select("row_id", F.col("txn_id_standardized").alias("txn_id"), F.col("settlement_reference_standardized").alias("settlement_reference"))


@query(f"WITH {_FEED} SELECT row_id, {_enum('debit_credit', C.SYNONYMS['debit_credit'])} AS debit_credit, {_enum('status', C.SYNONYMS['status'])} AS status FROM feed")
def normalize_enums(spark, d):
    return _silver(spark, d).select("row_id", "debit_credit", "status")


@query(f"WITH {_FEED} SELECT row_id, {_mid('txn_id')} AS id, {_mid('settlement_reference')} AS ref FROM feed")
def normalize_id(spark, d):
    return _txn(spark, d).select("row_id", X.match_id(F.col("txn_id")).alias("id"), X.match_id(F.col("settlement_reference")).alias("ref"))


@query(f"WITH {_FEED} SELECT row_id, messy_amount AS messy_amount_raw, messy_txn_date AS messy_txn_date_raw FROM feed")
def raw_snapshot(spark, d):
    return _silver(spark, d).select("row_id", "messy_amount_raw", "messy_txn_date_raw")


@query("SELECT o_orderkey AS row_id, o_orderkey % 7 AS s0, o_orderkey % 5 AS s1, CAST(NULL AS BIGINT) AS s2 FROM orders")
def parse_kv(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    m = X.key_values(F.concat(F.lit("S0="), F.col("o_orderkey") % 7, F.lit(";bad;S1="), F.col("o_orderkey") % 5, F.lit(".0;S2=x")))
    return o.select(F.col("o_orderkey").alias("row_id"), m["S0"].alias("s0"), m["S1"].alias("s1"), F.try_element_at(m, F.lit("S2")).alias("s2"))


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey % 5 = 0 THEN 'UNKNOWN_ENTITY' ELSE lower(n_name) END AS entity FROM nation")
def entity_name(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    path = F.when(F.col("n_nationkey") % 5 == 0, F.lit("/data/gold/__b1.csv")).when(F.col("n_nationkey") % 5 == 1, F.concat(F.lit("C:\\x\\"), F.lower("n_name"), F.lit("_warnings__b1.csv"))).otherwise(F.concat(F.lit("/gold/"), F.lower("n_name"), F.lit(".csv")))
    return n.select(F.col("n_nationkey").alias("k"), X.entity_name(path).alias("entity"))


@query()
def fuzzy_ratio(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select("p_partkey", ratio(F.col("p_name"), F.col("p_type")).alias("ratio"), token_sort_ratio(F.col("p_name"), F.col("p_type")).alias("token_sort"))


@query(f"""WITH l AS ({feeds.LEDGER}) SELECT row_id, abs(amount - 500) <= 0.01 OR abs(amount - 500) / greatest(abs(amount), 500.0, 1.0) <= 0.001 AS amount_ok,
  abs(epoch_us(ts) - epoch_us(TIMESTAMP '1995-01-02')) <= 259200000000 AS time_ok FROM l""")
def within_tolerance(spark, d):
    return _ledger(spark, d).select("row_id", R.amount_ok(F.col("amount"), F.lit(500.0)).alias("amount_ok"), R.time_ok(F.col("ts"), F.lit("1995-01-02").cast("timestamp")).alias("time_ok"))


# ---- validation
def _rule_query(name: str, wanted: list[str]) -> None:
    def run(spark, d):
        df = rules.count_ids(_silver(spark, d))
        found = {n: c for n, c, _ in rules.catalog(df)}
        return df.select("row_id", *[found[n].alias(n) for n in wanted])

    run.__name__ = name
    query(f"{_SILVER} SELECT row_id, {', '.join(f'coalesce({_RULES[n][0]}, false) AS {n}' for n in wanted)} FROM counted")(run)


for _name, _prefix in (("rule_mandatory", "mandatory"), ("rule_dates", "date"), ("rule_amounts", "amount"), ("rule_fx", "fx"), ("rule_identifiers", "identifier"), ("rule_enums", "enum"), ("rule_duplicate_id", "duplicate")):
    _rule_query(_name, [n for n in _RULES if n.startswith(_prefix)])


@query(f"{_CHECKED} SELECT row_id, 'S' || rank AS validation_severity, triggered AS validation_rule_triggered FROM final")
def validation_severity(spark, d):
    return _checked(spark, d).select("row_id", "validation_severity", "validation_rule_triggered")


@query(f"{_CHECKED} SELECT row_id, status AS validation_status FROM final")
def validation_status(spark, d):
    return _checked(spark, d).select("row_id", "validation_status")


@query(f"{_CHECKED} SELECT row_id, rule_name, 'S' || rank AS validation_severity, status AS validation_status FROM (SELECT row_id, rank, status, unnest(string_split(triggered, '|')) AS rule_name FROM final WHERE triggered <> '')")
def validation_audit(spark, d):
    return rules.audit(_checked(spark, d), "row_id")


@query(f"{_CHECKED} {_SUMMARY}")
def validation_summary(spark, d):
    return rules.summary(_checked(spark, d))


def _route_query(status: str) -> None:
    def run(spark, d):
        return rules.route(_checked(spark, d), status).select("row_id", "txn_id_standardized", "messy_amount_amount_numeric")

    run.__name__ = f"route_{status.lower()}"
    query(f"{_CHECKED} SELECT row_id, tid AS txn_id_standardized, amount AS messy_amount_amount_numeric FROM final WHERE status = '{status}'")(run)


for _status in ("VALID", "WARNING", "REJECTED"):
    _route_query(_status)


@query(f"{_CHECKED} SELECT rule_name, count(*) AS failures FROM (SELECT unnest(string_split(triggered, '|')) AS rule_name FROM final WHERE triggered <> '') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def rule_failure_topn(spark, d):
    return rules.top_rules(_checked(spark, d), "row_id")


@query(f"{_SILVER} SELECT 'txn_id_standardized' AS field, round_even(100 * avg(CASE WHEN tid IS NULL OR tid = '' THEN 1.0 ELSE 0.0 END), 4) AS null_pct FROM silver UNION ALL SELECT 'messy_amount_amount_numeric', round_even(100 * avg(CASE WHEN amount IS NULL THEN 1.0 ELSE 0.0 END), 4) FROM silver")
def null_coverage(spark, d):
    return rules.null_coverage(_silver(spark, d), ["txn_id_standardized", "messy_amount_amount_numeric"])


_CHANGED = [("txn_id", "txn_id"), ("settlement_reference", "settlement_reference"), ("reference_number", "reference_number"), ("primary_account_number", "primary_account_number"), ("destination_ifsc", "destination_ifsc")]


@query(f"""{_SILVER}, c AS (SELECT row_id, {" + ".join(f"CASE WHEN {_s(c)} <> {_id(c)} THEN 1 ELSE 0 END" for c, _ in _CHANGED)} AS n FROM feed)
  SELECT source_file_name, count(*) AS rows_processed, count(*) FILTER (dated IS NULL AND date_text IS NOT NULL) AS invalid_dates, count(*) FILTER (failed) AS currency_parse_failures, CAST(sum(c.n) AS BIGINT) AS normalization_actions FROM silver JOIN c USING (row_id) GROUP BY 1""")
def standardization_summary(spark, d):
    return standardize.summary(_silver(spark, d))


@query(f"WITH {_FEED} " + " UNION ALL ".join(f"SELECT row_id, '{c}' AS column_name, {_s(c)} AS original_value, {_id(c)} AS standardized_value FROM feed WHERE {_s(c)} <> {_id(c)}" for c, _ in _CHANGED))
def normalization_actions(spark, d):
    return standardize.changes(_silver(spark, d), "row_id")


@query(f"""{_SILVER} SELECT row_id, 'messy_txn_date' AS column_name, raw_date AS original_value, date_text AS standardized_value FROM silver WHERE dated IS NULL AND date_text IS NOT NULL
  UNION ALL SELECT row_id, 'messy_amount', messy_amount, {_s('messy_amount')} FROM silver JOIN (SELECT row_id, messy_amount FROM feed) USING (row_id) WHERE failed""")
def audit_events(spark, d):
    return standardize.audit(_silver(spark, d), "row_id")


# ---- duplicates
@query(f"{_DUP} SELECT * FROM exact")
def dup_exact(spark, d):
    return D.exact(_two(spark, d))


@query(f"WITH e AS ({feeds.EVENTS}), {_RETRY} SELECT * FROM retry")
def dup_retry_window(spark, d):
    return D.retries(_events(spark, d))


@query(f"{_DUP} SELECT * FROM replay")
def dup_reference_replay(spark, d):
    return D.replays(_two(spark, d))


@query(f"""WITH e AS ({feeds.EVENTS}), p AS (SELECT a.row_id AS a, b.row_id AS b, round_even(0.30 * 95 + 0.25 * (100 - abs(epoch_us(a.ts) - epoch_us(b.ts)) / 1000000.0 / 86400 * 100) + 0.25 * 100 + 0.20 * 50, 0) AS conf
  FROM e a JOIN e b ON a.customer_id = b.customer_id AND CAST(a.ts AS DATE) = CAST(b.ts AS DATE) AND round_even(a.amount, 2) = round_even(b.amount, 2) AND a.row_id < b.row_id)
  SELECT a, b, CASE WHEN conf >= 82 THEN 'FUZZY_DUPLICATE' ELSE 'POSSIBLE_DUPLICATE' END AS duplicate_classification, CAST(conf AS INT) AS duplicate_confidence, 'weighted_similarity' AS duplicate_logic FROM p WHERE conf >= 62""")
def dup_fuzzy(spark, d):
    return D.fuzzy(_events(spark, d))


@query(f"""{_DUP.replace("WITH f AS", "WITH RECURSIVE f AS", 1)}, edges AS (SELECT a, b FROM exact UNION SELECT a, b FROM replay), two AS (SELECT a AS x, b AS y FROM edges UNION SELECT b, a FROM edges),
  reach AS (SELECT x AS node, x AS other FROM two UNION SELECT reach.node, two.y FROM reach JOIN two ON reach.other = two.x) SELECT node, min(other) AS cluster FROM reach GROUP BY 1""")
def dup_clusters(spark, d):
    f = _two(spark, d)
    return D.clusters(D.exact(f).unionByName(D.replays(f)))


@query(f"""{_DUP}, ends AS (SELECT a AS row_id, duplicate_classification AS c FROM exact UNION ALL SELECT b, duplicate_classification FROM exact UNION ALL SELECT a, duplicate_classification FROM replay UNION ALL SELECT b, duplicate_classification FROM replay)
  SELECT f.row_id, CASE WHEN max(CASE WHEN c = 'EXACT_DUPLICATE' THEN 2 WHEN c IS NOT NULL THEN 1 ELSE 0 END) = 2 THEN 'EXACT_DUPLICATE' WHEN max(CASE WHEN c IS NOT NULL THEN 1 ELSE 0 END) = 1 THEN 'RETRY_PATTERN' ELSE 'NOT_DUPLICATE' END AS duplicate_status FROM f LEFT JOIN ends USING (row_id) GROUP BY 1""")
def duplicate_status(spark, d):
    f = _two(spark, d)
    return D.row_status(f, D.exact(f).unionByName(D.replays(f)))


@query(f"""{_DUP}, p AS (SELECT * FROM exact UNION ALL SELECT * FROM replay) SELECT (SELECT count(*) FROM f) AS total_rows, (SELECT count(*) FROM exact) AS exact_pairs, 0 AS fuzzy_pairs, 0 AS possible_pairs, (SELECT count(*) FROM replay) AS retry_pairs,
  (SELECT count(*) FROM f) - (SELECT count(*) FROM (SELECT a FROM p UNION SELECT b FROM p)) AS not_duplicate_rows""")
def dup_run_summary(spark, d):
    f = _two(spark, d)
    return D.run_summary(f, D.exact(f).unionByName(D.replays(f)))


@query(f"""{_DUP.replace("WITH f AS", "WITH RECURSIVE f AS", 1)}, p AS (SELECT * FROM exact UNION ALL SELECT * FROM replay), two AS (SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p),
  reach AS (SELECT x AS node, x AS other FROM two UNION SELECT reach.node, two.y FROM reach JOIN two ON reach.other = two.x), c AS (SELECT node, min(other) AS cl FROM reach GROUP BY 1)
  SELECT duplicate_classification AS duplicate_type, count(*) AS pair_count, round_even(avg(duplicate_confidence), 2) AS avg_confidence, (SELECT count(DISTINCT cl) FROM c) AS duplicate_cluster_count, (SELECT count(*) FROM replay) AS retry_pattern_counts FROM p GROUP BY 1""")
def gold_duplicate_summary(spark, d):
    f = _two(spark, d)
    return D.mart(D.exact(f).unionByName(D.replays(f)))


@query(f"WITH e AS ({feeds.EVENTS}), {_RETRY} SELECT CASE WHEN duplicate_confidence >= 95 THEN '95+' WHEN duplicate_confidence >= 80 THEN '80-94' WHEN duplicate_confidence >= 60 THEN '60-79' ELSE '<60' END AS tier, count(*) AS pair_count FROM retry GROUP BY 1")
def dup_tiers(spark, d):
    return D.tiers(D.retries(_events(spark, d)))


# ---- reconciliation and marts
def _recon_query(name: str, category: str) -> None:
    def run(spark, d):
        return _audit(spark, d).where(F.col("category") == category).select("row_id", "reconciliation_type", "confidence_score", "matched_row", F.round("variance", 4).alias("variance"))

    run.__name__ = name
    query(f"{_RECON} SELECT row_id, reconciliation_type, confidence_score, matched_row, round(variance, 4) AS variance FROM audit WHERE category = '{category}'")(run)


for _name, _category in (("recon_refund", "REFUND"), ("recon_fx", "FX"), ("recon_settlement", "TXN")):
    _recon_query(_name, _category)


@query(f"""{_RECON} SELECT count(*) AS total_rows, count(*) FILTER (reconciliation_type IN ({_in(R.MATCHED)})) AS total_matched, count(*) FILTER (reconciliation_type NOT IN ({_in(R.MATCHED)})) AS unmatched,
  {", ".join(f"count(*) FILTER (reconciliation_type = '{k}') AS {k.lower()}" for k in (*R.MATCHED, "MISSING_SETTLEMENT", "MULTIPLE_MATCHES"))}, CAST(coalesce(sum(CAST(variance AS DECIMAL(30,6))), 0) AS DOUBLE) AS amount_variance_total FROM audit""")
def recon_summary(spark, d):
    return R.summary(_audit(spark, d))


@query(f"{_RECON} SELECT CASE WHEN confidence_score = 100 THEN '100' WHEN confidence_score >= 80 THEN '80-99' WHEN confidence_score >= 50 THEN '50-79' ELSE '<50' END AS bucket, count(*) AS n FROM audit GROUP BY 1")
def confidence_distribution(spark, d):
    return R.confidence(_audit(spark, d))


@query(f"{_RECON} SELECT l.row_id, l.txn_id FROM l WHERE NOT EXISTS (SELECT 1 FROM audit WHERE audit.row_id = l.row_id AND reconciliation_type IN ({_in(R.MATCHED)}))")
def recon_unmatched(spark, d):
    return _ledger(spark, d).select("row_id", "txn_id").join(_audit(spark, d).where(F.col("reconciliation_type").isin(R.MATCHED)), "row_id", "left_anti")


@query(f"{_RECON}, {_FX} SELECT * FROM fx")
def gold_fx_variance(spark, d):
    return R.fx_mart(_ledger(spark, d))


@query(f"{_RECON}, {_FX} SELECT currency_pair, count(*) AS n, count(*) FILTER (abs(variance_pct) > 2) AS breaches FROM fx GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def fx_concentration(spark, d):
    return reports.fx_concentration(R.fx_mart(_ledger(spark, d)))


@query(f"""{_RECON}, k AS (SELECT row_id, id, amount, ts FROM l), twice AS (SELECT id FROM k WHERE id <> '' GROUP BY id, amount, ts HAVING count(*) > 1)
  SELECT l.row_id, l.txn_id, l.customer_id, l.amount, l.currency, reconciliation_type AS reconciliation_status, confidence_score, CASE WHEN id IN (SELECT id FROM twice) THEN 'EXACT_DUPLICATE' ELSE 'NOT_DUPLICATE' END AS duplicate_status FROM l JOIN audit USING (row_id)""")
def gold_transaction_master(spark, d):
    rows = _ledger(spark, d)
    return reports.transaction_master(rows, _audit(spark, d), D.row_status(rows, D.exact(rows)))


@query(f"{_RECON} SELECT row_id, reconciliation_type, confidence_score FROM audit WHERE reconciliation_type IN ('MISSING_SETTLEMENT', 'MULTIPLE_MATCHES')")
def unresolved_register(spark, d):
    return reports.unresolved(_audit(spark, d))


@query(f"""{_RECON}, s AS (SELECT *, CASE WHEN reconciliation_type IN ('MISSING_SETTLEMENT', 'MULTIPLE_MATCHES') THEN 'S5' ELSE 'S2' END AS severity FROM audit) SELECT row_id, reconciliation_type, severity, CASE severity WHEN 'S2' THEN 'RESOLVED' ELSE 'OPEN' END AS status,
  CASE severity WHEN 'S5' THEN 'Reconciliation Desk' ELSE 'Operations' END AS owner, CASE reconciliation_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in reports.ACTIONS.items())} END AS action FROM s""")
def exception_register(spark, d):
    return reports.exception_register(_audit(spark, d))


@query(f"""{_RECON}, a AS (SELECT date_diff('day', CAST(ts AS DATE), DATE '2024-06-30') AS age FROM audit JOIN l USING (row_id) WHERE reconciliation_type IN ('MISSING_SETTLEMENT', 'MULTIPLE_MATCHES'))
  SELECT CASE WHEN age IS NULL THEN 'unknown' WHEN age <= 1 THEN '0-1' WHEN age <= 3 THEN '2-3' WHEN age <= 7 THEN '4-7' WHEN age <= 30 THEN '8-30' ELSE '31+' END AS bucket, count(*) AS n FROM a GROUP BY 1""")
def aging_buckets(spark, d):
    return reports.aging(_ledger(spark, d), _audit(spark, d))


_KPI = f"""{_CHECKED}, v AS (SELECT count(*) AS rows_processed, count(*) FILTER (status = 'VALID') AS rows_valid, count(*) FILTER (status = 'WARNING') AS rows_warning, count(*) FILTER (status = 'REJECTED') AS rows_rejected FROM final),
{_RECON.removeprefix("WITH ")}, r AS (SELECT count(*) AS t, count(*) FILTER (reconciliation_type IN ({_in(R.MATCHED)})) AS m, count(*) FILTER (reconciliation_type NOT IN ({_in(R.MATCHED)})) AS unresolved FROM audit),
kpi AS (SELECT rows_processed, rows_valid, rows_warning, rows_rejected, round_even(100.0 * rows_valid / rows_processed, 2) AS validation_success_pct, round_even(100.0 * m / t, 2) AS match_rate_pct, unresolved FROM v, r)"""


@query(f"{_KPI} SELECT * FROM kpi")
def executive_kpis(spark, d):
    return reports.executive_kpis(rules.summary(_checked(spark, d)), R.summary(_audit(spark, d)))


@query(f"""{_KPI} SELECT 'validation_success_pct' AS metric, validation_success_pct AS value, 95.0 AS target, CASE WHEN validation_success_pct >= 95 THEN 'PASS' ELSE 'BREACH' END AS status FROM kpi
  UNION ALL SELECT 'match_rate_pct', match_rate_pct, 98.0, CASE WHEN match_rate_pct >= 98 THEN 'PASS' ELSE 'BREACH' END FROM kpi UNION ALL SELECT 'unresolved', unresolved, 0.0, CASE WHEN unresolved <= 0 THEN 'PASS' ELSE 'BREACH' END FROM kpi""")
def scorecard(spark, d):
    return reports.scorecard(reports.executive_kpis(rules.summary(_checked(spark, d)), R.summary(_audit(spark, d))))


@query(f"""{_CHECKED}, b AS ({_SUMMARY}) SELECT source_file_name AS entity, rows_processed, rows_valid, rows_rejected, s3, s4, s5, round_even(100.0 * rows_rejected / rows_processed, 2) AS reject_pct FROM b ORDER BY reject_pct DESC, s5 DESC, 1 LIMIT 10""")
def entity_performance(spark, d):
    return reports.entity_performance(rules.summary(_checked(spark, d)), "source_file_name")


@query("""SELECT 'c_custkey' AS column_name, count(*) AS rows, count(*) - count(c_custkey) AS nulls, count(DISTINCT c_custkey) AS distinct_values FROM customer UNION ALL SELECT 'c_nationkey', count(*), count(*) - count(c_nationkey), count(DISTINCT c_nationkey) FROM customer
  UNION ALL SELECT 'c_mktsegment', count(*), count(*) - count(c_mktsegment), count(DISTINCT c_mktsegment) FROM customer""")
def profile_columns(spark, d):
    return reports.profile(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_nationkey", "c_mktsegment"))


@query(f"""{_CHECKED} SELECT 'bronze' AS stage, count(*) AS rows FROM feed UNION ALL SELECT 'gold', count(*) FROM final WHERE status = 'VALID' UNION ALL SELECT 'warnings', count(*) FROM final WHERE status = 'WARNING' UNION ALL SELECT 'rejects', count(*) FROM final WHERE status = 'REJECTED'""")
def lineage_stages(spark, d):
    c = _checked(spark, d)
    return reports.stages({"bronze": _txn(spark, d), "gold": rules.route(c, "VALID"), "warnings": rules.route(c, "WARNING"), "rejects": rules.route(c, "REJECTED")})


# ---- canonical view, feeds, metadata
_BLANK = lambda c: f"CASE WHEN lower(trim(coalesce({c}, ''))) IN ('nan', 'none') THEN '' ELSE trim(coalesce({c}, '')) END"
_REFERENCE = " , ".join(f"nullif({x}, '')" for c in ("settlement_reference", "reference_number") for x in (f"trim({_id(c)})", f"trim({_s(c)})"))


@query(f"""{_SILVER}, r AS (SELECT row_id, {_id("settlement_reference")} AS sref, {_id("reference_number")} AS rref, coalesce({_REFERENCE}, '') AS ref, upper({_s("txn_type")}) AS kind, customer_id AS who FROM feed)
  SELECT row_id, source_file_name, coalesce(tid, '') AS txn_id, coalesce(who, '') AS customer_id, '' AS name, ref AS reference, coalesce(sref, '') AS settlement_reference, coalesce(rref, '') AS link_reference, amount, coalesce(currency, '') AS currency,
  CAST(NULL AS VARCHAR) AS ts, coalesce(kind, '') AS txn_type, coalesce(dc, '') AS debit_credit, fc AS from_currency, tc AS to_currency, CAST(rate AS DOUBLE) AS exchange_rate, 'UNKNOWN' AS validation_status FROM silver JOIN r USING (row_id)""")
def canonical_txn_view(spark, d):
    v = canonical.canonical_view(_silver(spark, d))
    return v.select("row_id", "source_file_name", "txn_id", "customer_id", "name", "reference", "settlement_reference", "link_reference", "amount", "currency", F.col("ts").cast("string").alias("ts"), "txn_type", "debit_credit", "from_currency", "to_currency", "exchange_rate", "validation_status")


@query(f"WITH {_FEED} SELECT row_id, coalesce({_REFERENCE}, '') AS reference FROM feed")
def reference_coalesce(spark, d):
    s = _silver(spark, d)
    return s.select("row_id", canonical.reference(s).alias("reference"))


@query(f"""WITH {_FEED} SELECT row_id, txn_id, messy_amount, CAST(NULL AS VARCHAR) AS status, 'a' AS _source_file FROM feed WHERE source_file_name = 'bank_a.csv' UNION ALL SELECT row_id, txn_id, NULL, status, 'b' FROM feed WHERE source_file_name = 'bank_b.csv'""")
def union_feeds(spark, d):
    f = _txn(spark, d)
    return canonical.union_feeds({"a": f.where("source_file_name = 'bank_a.csv'").select("row_id", "txn_id", "messy_amount"), "b": f.where("source_file_name = 'bank_b.csv'").select("row_id", "status", "txn_id")})


@query(f"WITH {_FEED} SELECT row_id, source_file_name, '2024-06-30 00:00:00' AS ingestion_timestamp, 'b1' AS processing_batch_id FROM feed")
def bronze_metadata(spark, d):
    return csv.bronze(_txn(spark, d).withColumn("_bad", F.lit(False)), "b1", "2024-06-30 00:00:00").select("row_id", "source_file_name", "ingestion_timestamp", "processing_batch_id")


@query(f"WITH {_FEED} SELECT (CASE WHEN source_file_name = 'bank_a.csv' THEN 0 ELSE 8589934592 END) + row_id AS id, row_id FROM feed")
def number_rows(spark, d):
    return canonical.number_rows(_txn(spark, d).select("source_file_name", F.col("row_id").alias("row_no"))).select(F.col("row_id").alias("id"), F.col("row_no").alias("row_id"))


@query(f"WITH l AS ({feeds.LEDGER}) SELECT row_id, length({_mid('settlement_reference')}) < 4 OR NOT regexp_full_match({_mid('settlement_reference')}, '[A-Z0-9./]+') AS malformed FROM l")
def malformed_identifier(spark, d):
    return _ledger(spark, d).select("row_id", R._malformed(X.match_id(F.col("settlement_reference")), 4).alias("malformed"))


@query("SELECT p_partkey, CASE WHEN length(p_name || p_name || p_name || p_name) > 48 THEN left(p_name || p_name || p_name || p_name, 48) || '…' ELSE p_name || p_name || p_name || p_name END AS short FROM part")
def short_name(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select("p_partkey", X.short_name(F.concat(F.lit("/gold/x\\"), *["p_name"] * 4)).alias("short"))


# ---- the rarer rules: by the arithmetic that made the rows
_FIRED = {
    "date_parse_failed": "o_orderkey % 7 = 0 AND o_orderkey % 14 <> 0", "amount_overflow": "o_orderkey % 5 = 0", "identifier_bic_malformed": "o_orderkey % 3 = 0 OR o_orderkey % 4 = 0", "identifier_branch_short": "o_orderkey % 6 = 0",
    "enum_invalid_reconciliation_status": "o_orderkey % 8 = 0", "enum_invalid_payment_channel": "o_orderkey % 9 = 0", "placeholder_value": "o_orderkey % 17 = 0 AND o_orderkey % 13 <> 0", "unicode_replacement": "o_orderkey % 13 = 0",
}


@query(f"SELECT o_orderkey AS row_id, {', '.join(f'o_orderkey % 11 <> 0 AND ({c}) AS {n}' for n, c in _FIRED.items())}, o_orderkey % 11 = 0 AS null_density_high FROM orders")
def rule_rare(spark, d):
    df = rules.count_ids(standardize.standardize(standardize.rename(feeds.feed(spark, d, feeds.RARE))))
    found = {n: c for n, c, _ in rules.catalog(df)}
    return df.select("row_id", *[found[n].alias(n) for n in (*_FIRED, "null_density_high")])


# ---- retries in numbers, names and references, marts
_RETRIES = f"WITH e AS ({feeds.RETRIES}), {_RETRY}"


def _retries(spark, d):
    return feeds.feed(spark, d, feeds.RETRIES)


@query(f"{_RETRIES} SELECT * FROM retry")
def dup_retry_many(spark, d):
    return D.retries(_retries(spark, d))


@query(f"{_RETRIES}, x AS (SELECT a AS row_id FROM retry UNION ALL SELECT b FROM retry) SELECT CASE WHEN row_id % 3 = 0 THEN 'bank_a' ELSE 'bank_b' END AS entity, count(*) AS n FROM x GROUP BY 1")
def dup_sources(spark, d):
    f = _retries(spark, d)
    return reports.duplicate_sources(D.retries(f), f)


@query(f"""WITH f AS ({feeds.NAMED}), p AS (SELECT a.row_id AS a, b.row_id AS b, round_even(0.30 * CASE (a.row_id // 2) % 3 WHEN 0 THEN 100 WHEN 1 THEN 0 ELSE 95 END + 0.25 * (100 - least(100, (epoch(b.ts) - epoch(a.ts)) / 86400 * 100)) + 0.25 * 100
    + 0.20 * CASE (a.row_id // 2) % 4 WHEN 0 THEN 2000.0 / 22 WHEN 1 THEN 1800.0 / 21 ELSE 50 END, 0) AS conf FROM f a JOIN f b ON b.row_id = a.row_id + 1 AND a.row_id % 2 = 0 AND CAST(a.ts AS DATE) = CAST(b.ts AS DATE))
  SELECT a, b, CASE WHEN conf >= 82 THEN 'FUZZY_DUPLICATE' ELSE 'POSSIBLE_DUPLICATE' END AS duplicate_classification, CAST(conf AS INT) AS duplicate_confidence, 'weighted_similarity' AS duplicate_logic FROM p WHERE conf >= 62""")
def dup_fuzzy_named(spark, d):
    return D.fuzzy(feeds.feed(spark, d, feeds.NAMED))


@query(f"""{_CHECKED}, t AS (SELECT unnest(string_split(triggered, '|')) AS rule_name FROM final WHERE triggered <> '') SELECT count(*) AS total_rows_processed, count(*) FILTER (status = 'VALID') AS total_valid, count(*) FILTER (status = 'WARNING') AS total_warning,
  count(*) FILTER (status = 'REJECTED') AS total_rejected, {", ".join(f"count(*) FILTER (rank = {i}) AS severity_S{i}" for i in range(6))}, (SELECT count(*) FROM t) AS validation_rule_trigger_count, (SELECT count(DISTINCT rule_name) FROM t) AS validation_unique_rules_triggered FROM final""")
def gold_validation_summary(spark, d):
    c = _checked(spark, d)
    return reports.validation_mart(rules.summary(c), rules.audit(c, "row_id"))


@query(f"""{_RECON} SELECT {", ".join(f"count(*) FILTER (reconciliation_type = '{k}') AS {k}" for k in (*R.MATCHED, "MISSING_SETTLEMENT", "MULTIPLE_MATCHES"))}, count(*) AS total_rows, count(*) FILTER (reconciliation_type IN ({_in(R.MATCHED)})) AS total_matched,
  count(*) FILTER (reconciliation_type NOT IN ({_in(R.MATCHED)})) AS unmatched, CAST(coalesce(sum(CAST(variance AS DECIMAL(30,6))), 0) AS DOUBLE) AS amount_variance_total FROM audit""")
def gold_reconciliation_summary(spark, d):
    return reports.reconciliation_mart(R.summary(_audit(spark, d)))


@query(f"{_RECON}, {_FX} SELECT * FROM fx WHERE abs(variance_pct) > 2")
def fx_breaches(spark, d):
    return reports.fx_breaches(R.fx_mart(_ledger(spark, d)))


@query(f"""{_KPI}, a AS (SELECT CASE WHEN validation_success_pct < 95 THEN printf('Validation success %.2f%% is below 95%%', validation_success_pct) END AS alert FROM kpi UNION ALL SELECT CASE WHEN match_rate_pct < 98 THEN printf('Match rate %.2f%% is below 98%%', match_rate_pct) END FROM kpi
  UNION ALL SELECT CASE WHEN unresolved > 0 THEN printf('%d unresolved reconciliation rows', unresolved) END FROM kpi) SELECT alert FROM a WHERE alert IS NOT NULL""")
def operational_alerts(spark, d):
    return reports.alerts(reports.executive_kpis(rules.summary(_checked(spark, d)), R.summary(_audit(spark, d))))


@query(f"""{_RECON} SELECT l.row_id AS pipeline_row_id, l.txn_id AS transaction_id, l.amount AS standardized_amount, l.currency AS currency_code, reconciliation_type AS reconciliation_status, 'UNKNOWN' AS validation_status, 'NOT_DUPLICATE' AS duplicate_status, confidence_score AS reconciliation_confidence,
  coalesce(q.txn_id, '') AS matched_transaction_id, audit.category AS reconciliation_category, CASE WHEN audit.category = 'FX' THEN 'fx_pair_with_exchange_and_reference_rate' WHEN audit.category = 'REFUND' THEN CASE confidence_score WHEN 20 THEN 'missing_or_malformed_refund_link_reference' WHEN 25 THEN 'refund_link_not_found_on_ledger' WHEN 40 THEN 'multiple_original_candidates' ELSE 'reference_matches_original_txn_or_settlement' END
    ELSE CASE confidence_score WHEN 15 THEN 'empty_settlement_reference' WHEN 35 THEN 'malformed_settlement_reference' WHEN 30 THEN 'settlement_reference_not_found' WHEN 45 THEN 'duplicate_collision_multiple_settlement_rows' ELSE 'settlement_reference_resolved_to_counterparty_txn_id' END END AS matching_logic_used,
  '2024-06-30 00:00:00' AS ingestion_timestamp, '2024-06-30 00:00:00' AS standardization_timestamp, '2024-06-30 00:00:00' AS validation_timestamp, '2024-06-30 00:00:00' AS reconciliation_timestamp, 'b1' AS processing_batch_id, 'ledger.csv' AS source_gold_file
  FROM l JOIN audit USING (row_id) LEFT JOIN l q ON q.row_id = matched_row""")
def transaction_master_full(spark, d):
    rows = _ledger(spark, d).withColumns({"validation_status": F.lit("UNKNOWN"), "source_file_name": F.lit("ledger.csv")})
    return reports.full_master(rows, R.reconcile(rows), D.row_status(rows, D.exact(rows)), "2024-06-30 00:00:00", "b1")
