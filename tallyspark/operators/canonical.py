"""The canonical view that matching stages read: feeds of any columns to one set of typed columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Where each value is looked for, the first column that exists is taken.
TXN_ID = ("txn_id_standardized", "transaction_id", "txn_id")
AMOUNT = ("amount_inr_amount_numeric", "messy_amount_amount_numeric", "amount", "converted_amount_amount_numeric")
TIME = ("txn_timestamp_parsed", "txn_timestamp", "ingestion_timestamp")
NAME = ("full_name", "first_name", "customer_email")
SETTLEMENT = ("settlement_reference_standardized", "settlement_reference")
CURRENCY = ("currency_code", "messy_amount_currency_code", "currency")
SETTLED = ("settlement_date_parsed", "settlement_date")
LINK = ("reference_number_standardized", "reference_number", "rrn_standardized", "rrn", "bank_ref_no_standardized", "bank_ref_no")
# Of these, each row takes the first that is not empty.
REFERENCES = ("settlement_reference_standardized", "settlement_reference", "utr_number_standardized", "utr_number", "reference_number_standardized", "reference_number", "bank_ref_no_standardized", "bank_ref_no")

#: Rows of a file are numbered below this; files are numbered above it.
FILE_ROWS = 1 << 33


def first_of(df: DataFrame, names: tuple[str, ...], default: str | None = None) -> Column:
    """The first of these columns that df has, whatever it holds; a constant if it has none."""
    return next((F.col(n) for n in names if n in df.columns), F.lit(default))


def reference(df: DataFrame, names: tuple[str, ...] = REFERENCES) -> Column:
    """Of each row, the first of these columns that is not empty; nan and none count as empty afterwards."""
    found = F.coalesce(*[F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns], F.lit(""))
    return F.when(F.lower(found).isin("nan", "none"), F.lit("")).otherwise(found)


def union_feeds(feeds: dict[str, DataFrame], name: str = "_source_file") -> DataFrame:
    """All feeds' rows by column name, columns that a feed lacks null, with the feed's name beside them."""
    named = [df.withColumn(name, F.lit(k)) for k, df in sorted(feeds.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def number_rows(df: DataFrame, file: str = "source_file_name", row: str = "row_no") -> DataFrame:
    """row_id: files in the order of their names, then rows in the order of the file. No global sort: one small row for each file."""
    files = df.select(file).distinct().withColumn("_file", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(file)) - 1)
    return df.join(files, file).withColumn("row_id", F.col("_file") * FILE_ROWS + F.col(row)).drop("_file")


def canonical_view(df: DataFrame) -> DataFrame:
    """row_id, validation_status, source_file_name and the columns of duplicates and reconciliation, of feeds with row_id. Missing columns are blank or null."""
    text = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit("")))
    txn = text(first_of(df, TXN_ID, ""))
    plain = lambda *names: text(first_of(df, names, ""))
    number = lambda *names: first_of(df, names).try_cast("double")
    return df.select(
        "row_id", plain("source_file_name", "_source_file").alias("source_file_name"), F.coalesce(first_of(df, ("validation_status",)), F.lit("UNKNOWN")).alias("validation_status"),
        F.when(F.lower(txn).isin("nan", "none"), F.lit("")).otherwise(txn).alias("txn_id"), plain("customer_id").alias("customer_id"), text(first_of(df, NAME, "")).alias("name"), reference(df).alias("reference"),
        text(first_of(df, SETTLEMENT, "")).alias("settlement_reference"), text(first_of(df, LINK, "")).alias("link_reference"), first_of(df, AMOUNT).try_cast("double").alias("amount"), F.upper(text(first_of(df, CURRENCY, ""))).alias("currency"),
        first_of(df, TIME).try_cast("timestamp").alias("ts"), first_of(df, SETTLED).try_cast("timestamp").alias("settlement_date"), F.upper(plain("txn_type")).alias("txn_type"), F.upper(plain("debit_credit")).alias("debit_credit"),
        F.upper(plain("from_currency")).alias("from_currency"), F.upper(plain("to_currency")).alias("to_currency"), number("exchange_rate").alias("exchange_rate"), number("reference_rate").alias("reference_rate"),
        plain("conversion_id").alias("conversion_id"), plain("treasury_rate_reference").alias("treasury_rate_reference"),
    )
