import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tallyspark import queries as Q
from tallyspark.functions import columns as X
from tallyspark.functions.similarity import indel
from tallyspark.operators import duplicates as D
from tallyspark.sources import csv

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(rows, columns):
    def cell(v):
        if v is None or v != v:
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", ["parse_amount", "parse_dates", "validation_severity", "validation_audit", "dup_exact", "dup_retry_window", "dup_clusters", "gold_duplicate_summary", "recon_refund", "recon_settlement", "recon_fx", "gold_fx_variance", "canonical_txn_view", "rule_rare", "dup_retry_many", "dup_fuzzy_named", "gold_validation_summary", "transaction_master_full", "normalization_actions", "number_rows"])
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = Q.QUERIES[name](spark, SF)
    cur = con.execute(Q.ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(df.collect(), df.columns) == plain(cur.fetchall(), columns)


AMOUNTS = [("USD 1,234.56", 1234.56, "USD", False), ("€1.234,56", 1234.56, "EUR", False), ("(1,234.56)", -1234.56, None, False), ("₹ 5,00,000", 500000, "INR", False), ("1,23", 1.23, None, False), ("1.234", 1.234, None, False), ("1.234.56", 1234.56, None, False), ("1.234.567", None, None, True), ("-500 USD", -500, "USD", False), ("500-", 500, None, False), ("PAY 5 USD", 5, "USD", False), ("¥1000", 1000, "JPY", False), ("1E5", 15, None, False), ("USD", None, None, False), ("abc", None, None, False), ("Rs. 500", 500, "INR", False), ("Rs. 1,500.00", 1500, "INR", False)]


def test_amounts(spark):
    df = spark.createDataFrame([(a[0],) for a in AMOUNTS], "s string").select("s", X.amount(F.col("s")).alias("x")).select("s", "x.*")
    assert {r[0]: tuple(r)[1:] for r in df.collect()} == {a: (b, c, d) for a, b, c, d in AMOUNTS}


DATES = [("04/03/2024", "2024-03-04 00:00:00"), ("3/13/2024", "2024-03-13 00:00:00"), ("04.03.2024", "2024-03-04 00:00:00"), ("3-4-24", "2024-04-03 00:00:00"), ("2024-13-01", "2024-01-13 00:00:00"), ("2024/03/04", "2024-03-04 00:00:00"), ("20240304", "2024-03-04 00:00:00"), ("2024", "2024-01-01 00:00:00"), ("Mar 2024", "2024-03-01 00:00:00"), ("March 4, 2024", "2024-03-04 00:00:00"), ("13-Mar-2024", "2024-03-13 00:00:00"), ("04/03/2024 10:11 PM", "2024-03-04 22:11:00"), ("45000", "2023-03-15 00:00:00"), ("45000.5", "2023-03-15 12:00:00"), ("1709510400", None), ("12.5", None), ("202403", None), ("99/99/2024", None), ("12:30", None), ("2024-03-04T10:00:00+02:00", "2024-03-04 08:00:00")]


def test_dates(spark):
    df = spark.createDataFrame([(a[0],) for a in DATES], "s string").select("s", X.date(F.col("s")).cast("string").alias("d"))
    assert {r["s"]: r["d"] for r in df.collect()} == dict(DATES)


def test_headers():
    assert X.snake_case("Txn ID ") == "txn_id" and X.snake_case("Amount (INR)") == "amount_inr" and X.snake_case("***") == "column"
    assert X.dedupe(["a", "a"]) == ["a", "a_2"] and X.dedupe(["processing_batch_id"], ("processing_batch_id",)) == ["processing_batch_id_2"]


def test_indel():
    assert round(indel("kitten", "sitting"), 3) == 61.538 and indel("", "") == 100.0


def test_routes_partition(spark):
    s = Q.QUERIES["validation_summary"](spark, SF).agg(F.sum("rows_processed"), F.sum(F.expr("rows_valid + rows_warning + rows_rejected"))).first()
    assert s[0] == s[1] == 1500


def test_a_hot_reference_meets_few_candidates(spark):
    from tallyspark.operators import reconcile as R

    n = 20_000  # rows that share one malformed reference, and as many that share a valid one
    rows = spark.range(2 * n + 3).selectExpr(
        "id AS row_id", "concat('T', id) AS txn_id", f"CASE WHEN id < {n} THEN 'A?' WHEN id < {2 * n} THEN 'SHARED1' WHEN id = {2 * n} THEN 'T{2 * n + 1}' ELSE 'OWN12' END AS settlement_reference",
        f"CASE WHEN id % 5 = 0 AND id < {2 * n} THEN 'SHARED1' ELSE '' END AS link_reference", "concat('C', id) AS customer_id", "CAST(10 + id % 7 AS DOUBLE) AS amount", "CASE WHEN id % 3 = 0 THEN '' ELSE 'USD' END AS currency",
        "TIMESTAMP '2024-01-01 00:00:00' AS ts", "CAST(NULL AS TIMESTAMP) AS settlement_date", "CASE WHEN id % 5 = 0 THEN 'REFUND' ELSE 'PAYMENT' END AS txn_type", "'' AS debit_credit", "'' AS from_currency", "'' AS to_currency", "0.0D AS exchange_rate", "0.0D AS reference_rate", "'' AS conversion_id")
    out = R.reconcile(rows).groupBy("category", "reconciliation_type", "confidence_score").count().collect()
    got = {(r[0], r[1], r[2]): r[3] for r in out}
    # 40,000 to 40,002: a refund without a link, and two that find each other
    assert got == {("REFUND", "MULTIPLE_MATCHES", 40): 8000, ("REFUND", "MISSING_SETTLEMENT", 20): 1, ("TXN", "PARTIAL_MATCH", 35): 16000, ("TXN", "MULTIPLE_MATCHES", 45): 16000, ("TXN", "AMOUNT_MISMATCH", 58): 2}


def test_clusters_of_a_path(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a long, b long")
    assert {r[0]: r[1] for r in D.clusters(pairs).collect()} == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100}
    assert D.clusters(pairs.limit(0)).count() == 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 2
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_csv_files_by_their_own_headers(spark, tmp_path):
    from tallyspark.sources import csv

    raw = tmp_path / "raw"
    (raw / "below").mkdir(parents=True)
    (raw / "A.CSV").write_text('Txn ID,Amount,Note\nT1,5,n1\nT2\nT3,1,2,3,4\nT9,7,,x,y\nT4,8,"a, ""b"" c"\n')
    (raw / "b.csv").write_text("\ufeffAmount,Txn ID,Note\n6,T5,n2\n", encoding="utf-8")
    (raw / "c.csv").write_bytes(b"Txn ID,Amount\nT\xff6,1\n")
    (raw / "notes.txt").write_text("Txn ID\nT7\n")
    (raw / "below" / "d.csv").write_text("Txn ID\nT8\n")
    files = csv.discover(spark, str(raw))
    assert [(r["source_file_name"], r["encoding"]) for r in files.collect()] == [("A.CSV", "utf-8"), ("b.csv", "utf-8-sig"), ("c.csv", "unknown")]
    rows = csv.read_raw(spark, str(raw), files)
    got = {r["txn_id"]: (r["amount"], r["note"], r["_bad"]) for r in rows.collect()}
    assert got == {"T1": ("5", "n1", False), "T2": (None, None, False), "T3": ("1", "2", True), "T9": ("7", None, True), "T4": ("8", 'a, "b" c', False), "T5": ("6", "n2", False)}
    m = {r["source_file_name"]: (r["row_count"], r["column_count"], r["skipped"], r["encoding"], r["ingestion_status"]) for r in csv.manifest(rows, files, "b1", "2024-01-01").collect()}
    assert m == {"A.CSV": (3, 6, 2, "utf-8", "PARTIAL"), "b.csv": (1, 6, 0, "utf-8-sig", "SUCCESS"), "c.csv": (0, 0, 0, "unknown", "FAILED")}


def test_from_files_to_marts(spark, tmp_path):
    from tallyspark.plans.pipeline import Pipeline
    from tallyspark.sources import csv

    (tmp_path / "raw").mkdir()
    head = "Txn ID,Messy Amount,Messy Txn Date,Customer ID,Primary Account Number,Settlement Reference,Txn Timestamp,Txn Type,Reference Number\n"
    line = "{},USD 10.00,2024-01-02,C1,ACC1,{},2024-01-02 10:00:00,payment,\n"
    (tmp_path / "raw" / "a.csv").write_text(head + line.format("T1001", "T1002") + line.format("T1002", "T1001") + line.format("T1002", "T1001") + ",,,,,,,,\n")
    (tmp_path / "raw" / "b.csv").write_text(head + line.format("T1003", "T9999"))
    p = Pipeline(spark, str(tmp_path / "out"), at="2024-06-30 00:00:00")
    out = p.run(str(tmp_path / "raw"), "b1")
    one = {k: v.collect() for k, v in out.items()}
    assert {r["ingestion_status"] for r in one["manifest"]} == {"SUCCESS"} and sum(r["row_count"] for r in one["manifest"]) == 5
    assert sum(r["rows_processed"] for r in one["validation_summary"]) == 5 and sum(r["rows_rejected"] for r in one["validation_summary"]) == 1
    kpi = one["executive_kpis"][0]
    assert (kpi["rows_processed"], kpi["rows_valid"], kpi["rows_warning"]) == (5, 2, 2)
    master = {r["transaction_id"]: r for r in one["gold_transaction_master"]}
    assert set(master) == {"T1001", "T1003"} and master["T1003"]["reconciliation_status"] == "MISSING_SETTLEMENT" and len(out["gold_transaction_master"].columns) == 17
    assert {r["stage"]: r["rows"] for r in one["lineage"]}["bronze"] == 5
    p.silver("b1")  # a step again gives the same layer
    assert p.read("silver", "b1").count() == 5
    assert csv.read_batch(spark, p.layer("nothing"), "b1", "x long").count() == 0 and csv.read_batch(spark, p.layer("silver"), "b1", rows=2).count() == 2


def _streamed(spark, tmp_path, name, df, build):
    df.write.parquet(str(tmp_path / name))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
    q = build(s).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-cp")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_streams_of_retries_and_volumes(spark, tmp_path):
    from tallyspark.streaming import ingest

    rows = [("T1", "C1", 5.0, "2024-01-01 00:00:00"), ("T2", "C1", 5.0, "2024-01-01 00:04:00"), ("T3", "C1", 5.0, "2024-01-01 00:20:00"), ("T4", "C2", 5.0, "2024-01-01 00:00:10")]
    df = spark.createDataFrame(rows, "txn_id string, customer_id string, amount double, t string").selectExpr("txn_id", "customer_id", "amount", "CAST(t AS TIMESTAMP) AS ts")
    assert [(r["txn_a"], r["txn_b"]) for r in _streamed(spark, tmp_path, "again", df, lambda s: ingest.retries(s, s.select("*")))] == [("T1", "T2")]
    ev = spark.createDataFrame([("a", 1.0, "2024-01-01 00:10:00"), ("a", 2.0, "2024-01-01 00:50:00"), ("b", 4.0, "2024-01-01 00:50:00"), ("z", 0.0, "2024-01-01 05:00:00")], "event_type string, value double, t string").selectExpr("event_type", "value", "CAST(t AS TIMESTAMP) AS ts")
    assert sorted((r["event_type"], r["n"], r["total"]) for r in _streamed(spark, tmp_path, "volumes", ev, ingest.volumes)) == [("a", 2, 3.0), ("b", 1, 4.0)]


def test_emitted_pairs_of_a_block_are_capped_in_row_order(spark):
    from tallyspark.config import Config

    rows = spark.range(40).selectExpr("id AS row_id", "concat('T', id) AS txn_id", "'C' AS customer_id", "CAST(NULL AS STRING) AS name", "CAST(NULL AS STRING) AS reference", "5.0D AS amount", "TIMESTAMP '2024-01-01 00:00:00' AS ts")
    pairs = [(r["a"], r["b"]) for r in D.fuzzy(rows, Config(fuzzy_cap=50)).collect()]
    assert sorted(pairs) == [(i, j) for i in range(40) for j in range(i + 1, 40)][:50]


def test_mart_without_pairs(spark):
    none = spark.createDataFrame([], "a long, b long, duplicate_classification string, duplicate_confidence int, duplicate_logic string")
    assert [tuple(r) for r in D.mart(none).collect()] == [("NONE", 0, 0.0, 0, 0)]


def test_stream_first_seen(spark, tmp_path):
    from tallyspark.streaming.ingest import first_seen

    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:05"), (2, "2024-01-01 00:00:06")], "k long, t string").select("k", F.col("t").cast("timestamp").alias("ts")).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("k long, ts timestamp").parquet(str(tmp_path / "in"))
    q = first_seen(s, "k", "ts").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == 2


def test_scans_of_few_splits_are_dealt_over_the_cores(spark, monkeypatch):
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    monkeypatch.setattr(csv, "SPLIT_BYTES", 1 << 10)
    dealt = csv.spread(orders)
    assert dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and dealt.exceptAll(orders).count() == 0
    assert csv.spread(dealt) is dealt
    plan = dealt.where("o_orderkey > 5").select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey" in plan and ",o_custkey" not in plan.split("ReadSchema")[1] and "GreaterThan(o_orderkey,5)" in plan
    monkeypatch.setattr(csv, "SPLIT_BYTES", 1 << 40)
    assert csv.spread(orders) is orders
