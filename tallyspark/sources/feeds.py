"""Messy feeds derived from the driver's tables by key arithmetic, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .csv import spread

_MONEY = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)"
_Y, _M, _D = "CAST(year(o_orderdate) AS STRING)", "lpad(CAST(month(o_orderdate) AS STRING), 2, '0')", "lpad(CAST(day(o_orderdate) AS STRING), 2, '0')"

TXN = f"""SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 3 = 0 THEN 'bank_a.csv' ELSE 'bank_b.csv' END AS source_file_name,
  CASE WHEN o_orderkey % 97 = 0 THEN 'N/A' WHEN o_orderkey % 10 = 0 THEN concat('txn-', CAST(o_orderkey AS STRING)) WHEN o_orderkey % 10 = 1 THEN concat('  TXN ', CAST(o_orderkey AS STRING), ' ')
    WHEN o_orderkey % 50 = 2 THEN concat('TXN-', CAST(o_orderkey - 2 AS STRING)) ELSE concat('TXN-', CAST(o_orderkey AS STRING)) END AS txn_id,
  CASE o_orderkey % 9 WHEN 0 THEN concat('USD ', {_MONEY}) WHEN 1 THEN concat('€', replace({_MONEY}, '.', ',')) WHEN 2 THEN concat('(', {_MONEY}, ') GBP') WHEN 3 THEN concat('Rs. ', {_MONEY})
    WHEN 4 THEN concat({_MONEY}, ' USD') WHEN 5 THEN concat('₹1,', lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0'), '.50') WHEN 6 THEN concat('EUR 2.', lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0'), ',75')
    WHEN 7 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'abc' ELSE '1.234.567' END ELSE concat('-', {_MONEY}, ' JPY') END AS messy_amount,
  CASE o_orderkey % 7 WHEN 0 THEN concat({_Y}, '-', {_M}, '-', {_D}) WHEN 1 THEN concat({_D}, '/', {_M}, '/', {_Y}) WHEN 2 THEN concat({_D}, '.', {_M}, '.', {_Y}) WHEN 3 THEN concat({_Y}, {_M}, {_D})
    WHEN 4 THEN concat({_Y}, '/', {_M}, '/', {_D}) WHEN 5 THEN '99/99/2024' ELSE concat({_D}, '-', {_M}, '-', {_Y}) END AS messy_txn_date,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'A?' ELSE concat('txn-', CAST(o_orderkey + 1 AS STRING)) END AS settlement_reference,
  concat('TXN', CAST(o_orderkey - 1 AS STRING)) AS reference_number, CAST(o_custkey AS STRING) AS customer_id, concat('ACC', CAST(o_custkey AS STRING)) AS primary_account_number,
  CASE WHEN o_orderkey % 40 = 0 THEN 'refund' ELSE 'payment' END AS txn_type, CASE o_orderkey % 4 WHEN 0 THEN 'd' WHEN 1 THEN 'cr' WHEN 2 THEN 'CREDIT' ELSE 'x' END AS debit_credit,
  CASE o_orderstatus WHEN 'O' THEN ' success' WHEN 'F' THEN 'Settled' ELSE 'in  progress' END AS status,
  CASE WHEN o_orderkey % 19 = 0 THEN 'HDFC0001234' WHEN o_orderkey % 19 = 1 THEN 'bad' END AS destination_ifsc, 'n/a' AS exception_code,
  CASE WHEN o_orderkey % 6 = 0 THEN 'USD' WHEN o_orderkey % 6 = 1 THEN 'XXX' ELSE '' END AS from_currency, CASE WHEN o_orderkey % 6 < 2 THEN 'EUR' ELSE '' END AS to_currency,
  CASE WHEN o_orderkey % 5 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST((o_orderkey % 5) - 1 AS DOUBLE) END AS exchange_rate,
  CAST(o_totalprice AS DOUBLE) AS price, o_orderdate AS ordered
FROM orders"""

LEDGER = """SELECT o_orderkey AS row_id, concat('TXN-', CAST(o_orderkey AS STRING)) AS txn_id,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'A?' WHEN o_orderkey % 17 = 0 THEN concat('TXN-', CAST(o_orderkey + 3 AS STRING)) ELSE concat('txn-', CAST(o_orderkey + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS STRING)) END AS settlement_reference,
  CASE WHEN o_orderkey % 80 = 0 THEN '' ELSE concat('txn ', CAST(o_orderkey - 1 AS STRING)) END AS link_reference, CAST(o_custkey AS STRING) AS customer_id,
  CASE WHEN o_orderkey % 40 IN (0, 39) THEN 500.0 WHEN o_orderkey % 4 < 2 THEN CAST(100 AS DOUBLE) ELSE CAST(o_totalprice AS DOUBLE) END AS amount,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'USD' END AS currency, CAST(o_orderdate AS TIMESTAMP) AS ts, CAST(o_orderdate AS TIMESTAMP) AS settlement_date,
  CASE WHEN o_orderkey % 40 = 0 THEN 'REFUND' WHEN o_orderkey % 40 = 7 THEN 'FX SPOT' ELSE 'PAYMENT' END AS txn_type, 'DEBIT' AS debit_credit,
  CASE WHEN o_orderkey % 40 = 7 THEN 'USD' ELSE '' END AS from_currency, CASE WHEN o_orderkey % 3 = 0 THEN 'EUR' ELSE 'GBP' END AS to_currency,
  1.0 + ((o_orderkey % 21) - 10) / 100.0 + 0.003 AS exchange_rate, 1.0 AS reference_rate, '' AS conversion_id
FROM orders"""

TWO_FEEDS = """SELECT row_id, txn_id, customer_id, name, reference, amount, ts FROM (
  SELECT o_orderkey * 2 AS row_id, concat('TXN-', CAST(o_orderkey AS STRING)) AS txn_id, CAST(o_custkey AS STRING) AS customer_id, CAST(NULL AS STRING) AS name,
    CASE WHEN o_orderkey % 30 < 2 THEN concat('REF-', CAST(CAST(floor(o_orderkey / 30) AS BIGINT) AS STRING)) END AS reference, CAST(o_totalprice AS DOUBLE) AS amount, CAST(o_orderdate AS TIMESTAMP) AS ts FROM orders
  UNION ALL
  SELECT o_orderkey * 2 + 1, concat('txn_', CAST(o_orderkey AS STRING)), CAST(o_custkey AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(o_totalprice AS DOUBLE), CAST(o_orderdate AS TIMESTAMP) FROM orders WHERE o_orderkey % 50 = 0) AS f"""

EVENTS = """SELECT event_id AS row_id, CAST(event_id AS STRING) AS txn_id, CAST(user_id AS STRING) AS customer_id, CAST(NULL AS STRING) AS name, CAST(NULL AS STRING) AS reference,
  floor(value) + 0.0 AS amount, CAST(ts AS TIMESTAMP) AS ts FROM events"""


#: Rows that fire the rarer rules, and the columns of other feeds.
RARE = """SELECT o_orderkey AS row_id, 'rare.csv' AS source_file_name, CASE WHEN o_orderkey % 11 <> 0 THEN concat('TXN-', CAST(o_orderkey AS STRING)) END AS txn_id,
  CASE WHEN o_orderkey % 11 <> 0 THEN CASE WHEN o_orderkey % 7 = 0 THEN 'soon' ELSE '2020-01-02' END END AS txn_date, CASE WHEN o_orderkey % 11 <> 0 THEN CASE WHEN o_orderkey % 14 = 0 THEN '-' ELSE '2020-01-02' END END AS messy_txn_date,
  CASE WHEN o_orderkey % 11 <> 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'USD 20000000000000000' ELSE 'USD 20' END END AS messy_amount,
  CASE WHEN o_orderkey % 11 <> 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'ABCDEF' ELSE 'ABCDEF12' END END AS swift_code, CASE WHEN o_orderkey % 11 <> 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'ABCDEF1234567' ELSE 'ABCDEF12XYZ' END END AS counterparty_bic,
  CASE WHEN o_orderkey % 11 <> 0 THEN CASE WHEN o_orderkey % 6 = 0 THEN '12' ELSE '1234' END END AS branch_code, CASE WHEN o_orderkey % 11 <> 0 THEN CASE WHEN o_orderkey % 8 = 0 THEN 'odd' ELSE 'pending' END END AS reconciliation_status,
  CASE WHEN o_orderkey % 11 <> 0 THEN CASE WHEN o_orderkey % 9 = 0 THEN 'pigeon' ELSE 'atm' END END AS channel, CASE WHEN o_orderkey % 11 <> 0 THEN CASE WHEN o_orderkey % 13 = 0 THEN 'a � b' WHEN o_orderkey % 17 = 0 THEN 'tbd' ELSE 'fine' END END AS remark
FROM orders"""

RETRIES = """SELECT o_orderkey AS row_id, concat('T', CAST(o_orderkey AS STRING)) AS txn_id, CAST(o_custkey % 5 AS STRING) AS customer_id, CAST(NULL AS STRING) AS name, CAST(NULL AS STRING) AS reference,
  CAST(o_orderkey % 2 AS DOUBLE) + 5.0 AS amount, CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 400) * INTERVAL '1' SECOND AS ts, CASE WHEN o_orderkey % 3 = 0 THEN '/gold/bank_a__b1.csv' ELSE '/gold/bank_b__b1.csv' END AS source_file_name FROM orders"""

#: Pairs of rows of one customer and day, with names in another order, other names, and references that differ at their end.
NAMED = """SELECT o_orderkey * 2 + side AS row_id, concat('T', CAST(o_orderkey * 2 + side AS STRING)) AS txn_id, CAST(o_orderkey AS STRING) AS customer_id,
  CASE WHEN o_orderkey % 3 = 0 THEN CASE side WHEN 0 THEN 'JOHN  SMITH' ELSE 'SMITH JOHN' END WHEN o_orderkey % 3 = 1 THEN CASE side WHEN 0 THEN 'AAAA' ELSE 'BBBB' END END AS name,
  CASE WHEN o_orderkey % 4 = 0 THEN CASE side WHEN 0 THEN 'REF-12345-A' ELSE 'REF-12345-B' END WHEN o_orderkey % 4 = 1 THEN CASE side WHEN 0 THEN 'REF-12345-AB' ELSE 'REF-12345' END END AS reference,
  CAST(o_orderkey % 1000 AS DOUBLE) + 1.0 AS amount, CAST(o_orderdate AS TIMESTAMP) + side * (o_orderkey % 1000) * INTERVAL '60' SECOND AS ts FROM (SELECT o_orderkey, o_orderdate, 0 AS side FROM orders UNION ALL SELECT o_orderkey, o_orderdate, 1 FROM orders) AS s"""


def feed(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of the feeds above over the Parquet tables in sf_dir."""
    name = "events" if sql is EVENTS else "orders"
    return spark.sql(sql.replace(f"FROM {name}", f"FROM {{{name}}}"), **{name: spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))})
