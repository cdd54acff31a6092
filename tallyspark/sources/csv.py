"""Raw CSV folders to bronze tables, all text, with a manifest for each file; Parquet layers partitioned by batch.

Each file is read by its own header. Files are looked through once, line by line, for their header and encoding; then files
of one header are read together.
"""

from __future__ import annotations

import csv
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import dedupe, snake_case

METADATA = ("ingestion_timestamp", "source_file_name", "processing_batch_id")
CSV = "*.[cC][sS][vV]"
#: Bytes of a file worth a task of their own when rows are parsed (about a second's work in Parquet).
SPLIT_BYTES = 256 << 10
#: Commas outside quotes.
_COMMA = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """path, source_file_name, encoding (utf-8, utf-8-sig or unknown), header: one row for each CSV file (any case of the extension) in the folder itself, by name."""
    lines = spark.read.option("pathGlobFilter", CSV).text(folder)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("source_file_name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    first = F.min_by(F.when(F.col("block") == 0, F.col("value")), F.when(F.col("block") == 0, F.col("at")))
    files = lines.groupBy("path", "source_file_name").agg(F.bool_and(F.is_valid_utf8("value")).alias("valid"), first.alias("line"))
    rows = []
    for f in sorted(files.collect(), key=lambda f: f["source_file_name"]):  # one row a file
        path = unquote(f["path"])
        rows.append((path, f["source_file_name"], ("utf-8-sig" if _marked(spark, path) else "utf-8") if f["valid"] else "unknown", f["line"] if f["valid"] else None))
    return spark.createDataFrame(rows, "path string, source_file_name string, encoding string, header string")


def _marked(spark: SparkSession, path: str) -> bool:
    """Whether a file begins with the byte order mark, which line readers leave out."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return [stream.read() for _ in range(3)] == [0xEF, 0xBB, 0xBF]
    finally:
        stream.close()


def names_of(header: str) -> list[str]:
    """Column names of a header line."""
    return dedupe([snake_case(h) for h in next(csv.reader([header]), [])], METADATA)


def _read(spark: SparkSession, paths: list[str], names: list[str]) -> DataFrame:
    schema = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField("_line", T.StringType())])
    df = spark.read.schema(schema).csv(paths, header=True, enforceSchema=True, multiLine=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_line")
    # rows with too few or too many fields are corrupt records; those with too many are bad
    none = F.least(F.coalesce(F.length(names[0]), F.lit(0)), F.lit(0))  # 0: Spark reads no corrupt records for queries that need nothing else
    bad = F.coalesce(F.size(F.split("_line", _COMMA)) > F.lit(len(names)) + none, F.lit(False))
    low = F.lit((1 << 33) - 1)
    return df.select(*names, F.col("_metadata.file_name").alias("source_file_name"), F.monotonically_increasing_id().bitwiseAND(low).alias("row_no"), bad.alias("_bad"))


def read_raw(spark: SparkSession, folder: str, files: DataFrame | None = None) -> DataFrame:
    """The rows of all readable CSV files of a folder as text, columns by name; short rows are padded, those with too many fields flagged in _bad.

    row_no: ascending in a file, from 0 if it is read alone. Files that are not UTF-8, or have no header, are left out. A folder without files gives no rows.
    """
    groups: dict[str, list[str]] = {}
    for f in (discover(spark, folder) if files is None else files).collect():  # one row a file
        if f["header"]:
            groups.setdefault(f["header"], []).append(f["path"])
    if not groups:
        return spark.createDataFrame([], "source_file_name string, row_no long, _bad boolean")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [_read(spark, paths, names_of(h)) for h, paths in groups.items()])


def bronze(raw: DataFrame, batch: str, at: str) -> DataFrame:
    return raw.where("NOT _bad").drop("_bad").withColumns({"ingestion_timestamp": F.lit(at), "processing_batch_id": F.lit(batch)})


def manifest(raw: DataFrame, files: DataFrame, batch: str, at: str) -> DataFrame:
    """A row for each file: its name, its layer's file, rows, columns, skipped rows, encoding, status (SUCCESS, PARTIAL if rows were skipped, FAILED if it could not be read), time, batch."""
    by = raw.groupBy("source_file_name").agg(F.count_if(~F.col("_bad")).alias("row_count"), F.count_if(F.col("_bad")).alias("skipped"))
    columns = F.when(F.coalesce("header", F.lit("")) == "", 0).otherwise(F.size(F.split("header", _COMMA)) + len(METADATA))
    status = F.when(F.coalesce("header", F.lit("")) == "", "FAILED").when(F.col("skipped") > 0, "PARTIAL").otherwise("SUCCESS")
    out = files.join(by, "source_file_name", "left").fillna(0, ["row_count", "skipped"])
    stem = F.regexp_replace("source_file_name", r"\.[^.]*$", "")
    return out.select("source_file_name", F.concat(stem, F.lit(f"__{batch}")).alias("output_name"), "row_count", columns.alias("column_count"), "skipped", "encoding", status.alias("ingestion_status"), F.lit(at).alias("ingestion_timestamp"), F.lit(batch).alias("processing_batch_id"))


def write_layer(df: DataFrame, path: str, batch: str) -> None:
    """Overwrite one batch's partition of a layer, no others; a batch without rows is written too."""
    df.drop("processing_batch_id").write.mode("overwrite").parquet(f"{path}/processing_batch_id={batch}")


def spread(df: DataFrame) -> DataFrame:
    """A file scan dealt over the cores, where it has fewer splits: parsing a row costs far more than moving it. Scans with a split for each core are left alone."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = min(df.sparkSession.sparkContext.defaultParallelism, -(-size // SPLIT_BYTES))
    return df.repartition(parts) if parts > 1 and df.rdd.getNumPartitions() < parts else df


def read_batch(spark: SparkSession, path: str, batch: str, schema: str | None = None, rows: int | None = None) -> DataFrame:
    """One batch; other partitions are not listed or read. With a schema, a layer that is not there is empty; with rows, so many at most."""
    try:
        found = spark.read.parquet(f"{path}/processing_batch_id={batch}").withColumn("processing_batch_id", F.lit(batch))
    except AnalysisException as e:
        if schema is None or e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], schema)
    return found if rows is None else found.limit(rows)
