"""Duplicate pairs of transactions, their clusters and each row's strongest class.

Input: a canonical view (row_id long, txn_id, customer_id, name, reference, amount double, ts timestamp). Pairs have a < b.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Config
from ..functions.columns import is_blank, match_id
from ..functions.similarity import ratio, token_sort_ratio

RANKS = {"EXACT_DUPLICATE": 5, "RETRY_PATTERN": 4, "FUZZY_DUPLICATE": 3, "POSSIBLE_DUPLICATE": 2, "NOT_DUPLICATE": 0}


def _pairs(rows: DataFrame, keys: list[str], keep: list[str], where: str | None = None) -> DataFrame:
    """The self-join on keys, each pair once; skewed keys are split by adaptive execution."""
    a = rows.select(*keys, *[F.col(c).alias(f"{c}_a") for c in keep])
    b = rows.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(c).alias(f"{c}_b") for c in keep])
    on = F.col("row_id_a") < F.col("row_id_b")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return a.join(b, on & F.expr(where) if where else on)


def _out(df: DataFrame, cls, confidence, logic: str) -> DataFrame:
    return df.select(F.col("row_id_a").alias("a"), F.col("row_id_b").alias("b"), (F.lit(cls) if isinstance(cls, str) else cls).alias("duplicate_classification"), confidence.cast("int").alias("duplicate_confidence"), F.lit(logic).alias("duplicate_logic"))


def _second(ts: Column) -> Column:
    return F.date_trunc("second", ts)


def exact(rows: DataFrame) -> DataFrame:
    """Same id, amount (6 places) and second."""
    k = rows.withColumns({"k": match_id(F.col("txn_id")), "m": F.bround("amount", 6), "s": _second(F.col("ts"))}).where("k != '' AND m IS NOT NULL AND s IS NOT NULL")
    return _out(_pairs(k, ["k", "m", "s"], ["row_id"]), "EXACT_DUPLICATE", F.lit(100), "same_id_amount_second")


def retries(rows: DataFrame, config: Config = Config()) -> DataFrame:
    """Same customer and amount (2 places), other id, at most retry_seconds apart. Joined on time buckets, so a busy customer's rows meet only near ones."""
    w = config.retry_seconds
    k = rows.withColumns({"m": F.bround("amount", 2), "u": F.unix_micros(F.col("ts").cast("timestamp")), "i": match_id(F.col("txn_id"))}).where(~is_blank(F.col("customer_id")) & F.col("m").isNotNull() & F.col("u").isNotNull())
    k = k.withColumn("slot", F.floor(F.col("u") / (w * 1_000_000)))
    a = k.select("customer_id", "m", F.col("u").alias("u_a"), F.col("i").alias("i_a"), F.col("row_id").alias("r_a"), F.col("slot").alias("own"), F.explode(F.array(F.col("slot"), F.col("slot") + 1)).alias("slot"))
    b = k.select("customer_id", "m", "slot", F.col("u").alias("u_b"), F.col("i").alias("i_b"), F.col("row_id").alias("r_b"))
    p = a.join(b, ["customer_id", "m", "slot"]).where(((F.col("own") < F.col("slot")) | (F.col("r_a") < F.col("r_b"))) & (F.abs(F.col("u_a") - F.col("u_b")) <= w * 1_000_000) & ((F.col("i_a") != F.col("i_b")) | (F.col("i_a") == "")))
    gap = F.abs(F.col("u_a") - F.col("u_b")) / 1_000_000
    p = p.select(F.least("r_a", "r_b").alias("row_id_a"), F.greatest("r_a", "r_b").alias("row_id_b"), F.greatest(F.lit(50), F.floor(95 - F.least(F.lit(45.0), gap))).alias("conf"))
    return _out(p, "RETRY_PATTERN", F.col("conf"), "same_customer_amount_within_window")


def replays(rows: DataFrame) -> DataFrame:
    """Same reference, other id."""
    k = rows.withColumns({"r": match_id(F.col("reference")), "i": match_id(F.col("txn_id"))}).where("r != ''")
    return _out(_pairs(k, ["r"], ["row_id", "i"], "i_a != i_b"), "RETRY_PATTERN", F.lit(88), "reference_replay")


def fuzzy(rows: DataFrame, config: Config = Config()) -> DataFrame:
    """Scored pairs of one customer, UTC day and amount (2 places); the first fuzzy_cap pairs of a block by row order, as the rule has it."""
    ex = exact(rows)
    touched = ex.select(F.explode(F.array("a", "b")).alias("row_id")).distinct().withColumn("in_exact", F.lit(True))
    k = rows.withColumns({"m": F.bround("amount", 2), "day": F.to_date("ts"), "i": match_id(F.col("txn_id")), "u": F.unix_micros(F.col("ts").cast("timestamp"))})
    k = k.where(~is_blank(F.col("customer_id")) & F.col("m").isNotNull() & F.col("day").isNotNull()).join(touched, "row_id", "left").withColumn("in_exact", F.coalesce("in_exact", F.lit(False)))
    p = _pairs(k, ["customer_id", "day", "m"], ["row_id", "i", "u", "amount", "name", "reference", "in_exact"], "NOT (in_exact_a AND in_exact_b) AND NOT (i_a = i_b AND i_a != '')")
    gap = F.abs(F.col("u_a") - F.col("u_b")) / 1_000_000
    rel = F.abs(F.col("amount_a") - F.col("amount_b")) / F.greatest(F.abs("amount_a"), F.abs("amount_b"), F.lit(1.0))
    none = lambda c: is_blank(F.col(c))
    cust = F.when(none("name_a") | none("name_b"), 95.0).otherwise(token_sort_ratio(F.col("name_a"), F.col("name_b")))
    ref = F.when(none("reference_a") | none("reference_b"), 50.0).otherwise(ratio(F.col("reference_a"), F.col("reference_b")))
    score = 0.30 * cust + 0.25 * (100 - F.least(F.lit(100.0), gap / config.fuzzy_seconds * 100)) + 0.25 * (100 - F.least(F.lit(100.0), rel / config.fuzzy_relative * 50)) + 0.20 * ref
    p = p.withColumn("conf", F.bround(score, 0)).where((F.col("conf") >= 62) & (rel <= 0.1) & (gap <= config.fuzzy_seconds))
    p = p.withColumn("at", F.row_number().over(W.partitionBy("customer_id", "day", "m").orderBy("row_id_a", "row_id_b"))).where(F.col("at") <= config.fuzzy_cap)
    return _out(p, F.when(F.col("conf") >= 82, "FUZZY_DUPLICATE").otherwise("POSSIBLE_DUPLICATE"), F.col("conf"), "weighted_similarity")


def all_pairs(rows: DataFrame, config: Config = Config()) -> DataFrame:
    return exact(rows).unionByName(retries(rows, config)).unionByName(replays(rows)).unionByName(fuzzy(rows, config))


def clusters(pairs: DataFrame) -> DataFrame:
    """node, cluster (smallest row of its component). Alternating stars; each round is written to the shared folder, not kept on executors."""
    spark = pairs.sparkSession
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or _local(spark)

    def table(df):
        path = f"{root.rstrip('/')}/clusters-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    cur, said = table(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()), None
    while True:
        state = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == said or not state[0]:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("cluster")).union(cur.select("v", "v").distinct())
        said = state
        both = cur.union(cur.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = table(both.join(low, "u").where("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        cur = table(large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).distinct())


_FOLDERS: list = []


def _local(spark: SparkSession) -> str:
    """A folder of this machine, where Spark runs in one process; else an error."""
    import atexit
    import tempfile

    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _FOLDERS:
        _FOLDERS.append(tempfile.TemporaryDirectory(prefix="tallyspark-"))
        atexit.register(_FOLDERS[0].cleanup)
    return _FOLDERS[0].name


def row_status(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """row_id, duplicate_status: the strongest class of a row's pairs."""
    rank = F.create_map(*[x for k, v in RANKS.items() for x in (F.lit(k), F.lit(v))])
    ends = pairs.select(F.explode(F.array("a", "b")).alias("row_id"), "duplicate_classification")
    best = ends.groupBy("row_id").agg(F.max_by("duplicate_classification", rank[F.col("duplicate_classification")]).alias("best"))
    return rows.select("row_id").join(best, "row_id", "left").select("row_id", F.coalesce("best", F.lit("NOT_DUPLICATE")).alias("duplicate_status"))


def run_summary(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(F.col("duplicate_classification") == c)
    one = pairs.agg(n("EXACT_DUPLICATE").alias("exact_pairs"), n("FUZZY_DUPLICATE").alias("fuzzy_pairs"), n("POSSIBLE_DUPLICATE").alias("possible_pairs"), n("RETRY_PATTERN").alias("retry_pairs"))
    touched = pairs.select(F.explode(F.array("a", "b")).alias("r")).distinct().agg(F.count("*").alias("touched"))
    return one.crossJoin(touched).crossJoin(rows.agg(F.count("*").alias("total_rows"))).select("total_rows", "exact_pairs", "fuzzy_pairs", "possible_pairs", "retry_pairs", (F.col("total_rows") - F.col("touched")).alias("not_duplicate_rows"))


def mart(pairs: DataFrame) -> DataFrame:
    """Of each class: pairs, average confidence; clusters and retries of all. Without pairs, a row NONE of zeros."""
    by = pairs.groupBy(F.col("duplicate_classification").alias("duplicate_type")).agg(F.count("*").alias("pair_count"), F.bround(F.avg("duplicate_confidence"), 2).alias("avg_confidence"))
    found = clusters(pairs).agg(F.countDistinct("cluster").alias("duplicate_cluster_count"))
    retry = pairs.agg(F.count_if(F.col("duplicate_classification") == "RETRY_PATTERN").alias("retry_pattern_counts"))
    none = found.select(F.lit("NONE").alias("duplicate_type"), F.lit(0).cast("long").alias("pair_count"), F.lit(0.0).alias("avg_confidence")).join(pairs.limit(1).select(F.lit(1).alias("one")), how="left").where("one IS NULL").drop("one")
    return by.unionByName(none).crossJoin(found).crossJoin(retry)  # found and retry are a row each


def tiers(pairs: DataFrame) -> DataFrame:
    c = F.col("duplicate_confidence")
    tier = F.when(c >= 95, "95+").when(c >= 80, "80-94").when(c >= 60, "60-79").otherwise("<60")
    return pairs.groupBy(tier.alias("tier")).agg(F.count("*").alias("pair_count"))
