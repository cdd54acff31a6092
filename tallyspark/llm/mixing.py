"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

A source of weight w (shares of the output, summing to 1) gives out its rows in blocks. Block i may not come before
slot floor(i / w) (release) and must have come by slot ceil((i + 1) / w) (deadline). In each slot the earliest deadline
among released blocks wins (ties: the smaller source). Weights are whole units out of a period, so the schedule of one
period repeats; at any slot t a source has had w * t blocks, give or take less than one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import fresh, stash

#: Rows in a block, slots in a period, and the exponent that tempers row counts to default weights.
BLOCK, PERIOD, TEMPER = 16, 200, 0.9
#: Rows of a source are ordered by md5(SEED || doc_id), in so many ranges of its first hex digits.
SEED, DIGITS = "mix-1:", 3
#: Slots that are counted together for rows' places in the mix: BLOCK times as many rows at most, if no (doc_id, source) repeats.
SLOTS = 64
_NULL = "\x00null"


def _target(weights: dict[str | None, float] | None, temper: float) -> Column:
    """A source's weight: as given (0 where it is not), or its tempered row count."""
    if weights is None:
        return F.pow("n", F.lit(temper))
    if not any(w > 0 for w in weights.values()) or any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative, and one must be above 0")
    known = F.create_map(*[x for k, w in weights.items() for x in (F.lit(_NULL if k is None else k), F.lit(float(w)))])
    return F.coalesce(F.try_element_at(known, F.col("source")), F.lit(0.0))


def shares(counts: DataFrame, period: int = PERIOD, temper: float = TEMPER, weights: dict[str | None, float] | None = None) -> DataFrame:
    """source, n -> source, n, units: whole units of a period, by largest remainder, one at least."""
    all_rows = W.partitionBy(F.lit(1))
    w = counts.withColumn("p", _target(weights, temper))
    w = w.withColumn("sources", F.count("*").over(all_rows)).withColumn("p", F.coalesce(F.try_divide(F.col("p"), F.sum("p").over(all_rows)), 1 / F.col("sources")))
    span = F.greatest(F.lit(period), 4 * F.col("sources"))  # each source needs a unit
    w = w.withColumn("span", span).withColumn("quota", F.round(F.col("p") * (span - F.col("sources")), 6))
    w = w.withColumn("base", F.floor("quota")).withColumn("over", F.col("span") - F.col("sources") - F.sum("base").over(all_rows))
    rest = F.row_number().over(all_rows.orderBy(F.round(F.col("quota") - F.col("base"), 6).desc(), "source"))
    return w.select("source", "n", "span", (F.col("base") + 1 + (rest <= F.col("over")).cast("long")).alias("units"))


def period_schedule(units: DataFrame) -> DataFrame:
    """source, units, span -> source, k (block of the period), slot: earliest deadline first over one period."""
    one = units.groupBy().agg(F.array_sort(F.collect_list(F.struct("source", "units"))).alias("s"), F.max("span").alias("span"))
    pick = """aggregate(sequence(0, CAST(span AS INT) - 1),
      struct(transform(s, x -> 0L) AS given, CAST(array() AS ARRAY<INT>) AS won),
      (st, t) -> aggregate(array(array_min(transform(s, (x, i) -> CASE
            WHEN st.given[i] < x.units AND (st.given[i] * span) DIV x.units <= t
            THEN named_struct('due', ((st.given[i] + 1) * span + x.units - 1) DIV x.units, 'at', i) END))),
          st, (q, b) -> struct(transform(q.given, (g, i) -> g + CASE WHEN i = b.at THEN 1 ELSE 0 END) AS given,
                               concat(q.won, array(b.at)) AS won)),
      st -> st.won)"""
    won = one.select("s", F.posexplode(F.expr(pick)).alias("slot", "at")).where("at IS NOT NULL")
    won = won.select(F.expr("s[at].source").alias("source"), F.col("slot").cast("long").alias("slot"))
    return won.withColumn("k", F.row_number().over(W.partitionBy("source").orderBy("slot")).cast("long") - 1)


def _source(df: DataFrame) -> Column:
    return F.coalesce(df["source"], F.lit(_NULL))


def schedule(docs: DataFrame, block: int = BLOCK, period: int = PERIOD, temper: float = TEMPER, weights: dict[str | None, float] | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, source, rank, block, release, deadline, slot, in_mix.

    rank: from 0, of the row in its source by md5 of the seed and doc_id. slot: of its block. in_mix: the slot
    comes before the first slot that an exhausted source would have filled, so over these rows every source has
    its target share, less than a block off. weights: each source's target (None: of the null source), of any sum; a source without
    one gets the least share, one unit of a period. Without weights they are tempered row counts. A null source is a source of its own
    (returned as null); a null doc_id sorts first; repeated rows are ranked next to each other; an empty table gives
    an empty result. The rank is a count over ranges of the hash plus a rank within the range, so that a
    source with most of the rows is spread over thousands of ranges.
    """
    key = F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = docs.select("doc_id", _source(docs).alias("source"), key.alias("key")).withColumn("part", F.substring("key", 1, DIGITS))
    parts = stash(rows.groupBy("source", "part").agg(F.count("*").alias("n")), "mix-parts")
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select("source", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    units = stash(shares(parts.groupBy("source").agg(F.sum("n").alias("n")), period, temper, weights), "mix-units")
    slots = stash(period_schedule(units).join(units, "source"), "mix-slots")

    blocks = F.expr(f"(n + {block - 1}) DIV {block}")  # of a source, the last one perhaps short: all shares hold until one is used up
    ends = units.select("source", blocks.alias("done"), "units", "span")
    ends = ends.join(slots.select("source", "k", "slot"), "source").where(F.expr("k = done % units"))
    end = ends.agg(F.min(F.expr("(done DIV units) * span + slot")).alias("end"))

    within = W.partitionBy("source", "part").orderBy(F.col("key"), F.col("doc_id").asc_nulls_first())
    rows = rows.withColumn("r", F.row_number().over(within)).join(offsets.hint("merge"), ["source", "part"])  # both lie by (source, part); a number for each grows with the sources
    rows = rows.select("doc_id", "source", (F.col("offset") + F.col("r") - 1).alias("rank")).withColumn("block", F.expr(f"rank DIV {block}"))
    rows = rows.join(units.select("source", "units", "span"), "source").withColumn("k", F.expr("block % units"))
    rows = rows.join(slots.select("source", "k", F.col("slot").alias("at")), ["source", "k"]).join(F.broadcast(end))
    slot = F.expr("(block DIV units) * span + at")
    return rows.select(
        "doc_id", F.when(F.col("source") != _NULL, F.col("source")).alias("source"), F.col("rank").cast("long").alias("rank"), "block",
        F.expr("(block * span) DIV units").alias("release"), F.expr("((block + 1) * span + units - 1) DIV units").alias("deadline"),
        slot.alias("slot"), (slot < F.col("end")).alias("in_mix"),
    )


def mix(docs: DataFrame, place: str | None = None, **options) -> DataFrame:
    """All rows of docs, with all columns, laid out in the order of the schedule.

    Output files hold ranges of slots in ascending order. A source that is used up leaves its slots empty, so the sources left
    follow each other in the proportion of their weights. Rows that repeat a (doc_id, source) share their first rank.
    place: name of a further column, long, that no column of docs has: 0 to the number of rows less one, each once, in that order (rows that
    share a rank: by a hash of their columns). Readers of files are free in their order, so what follows finds the mix by it.
    """
    if place and place.lower() in map(str.lower, docs.columns):
        raise ValueError(f"docs has a column {place}")
    slot, rank, did, src, part, n, first = fresh(docs, "mix_slot", "mix_rank", "mix_doc", "mix_source", "mix_part", "mix_n", "mix_first")
    plan = schedule(docs, **options).groupBy("doc_id", "source").agg(F.min("slot").alias(slot), F.min("rank").alias(rank), F.count("*").alias(n))
    plan = stash(plan.select(F.col("doc_id").alias(did), F.col("source").alias(src), slot, rank, n), "mix-plan")
    same = docs["doc_id"].eqNullSafe(F.col(did)) & docs["source"].eqNullSafe(F.col(src))
    if not place:
        return docs.join(plan, same).repartitionByRange(F.col(slot)).sortWithinPartitions(slot, rank).select([docs[c] for c in docs.columns])
    plan = plan.withColumn(part, F.expr(f"`{slot}` DIV {SLOTS}"))
    before = W.partitionBy(F.lit(1)).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    firsts = plan.groupBy(part).agg(F.sum(n).alias(n)).select(part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    plan = stash(plan.drop(n).join(firsts.hint("merge"), part), "mix-places")
    alike = F.xxhash64(*[docs[c] for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    within = W.partitionBy(part).orderBy(slot, rank, alike)  # the ranges are of whole parts: no further exchange
    out = docs.join(plan, same).repartitionByRange(F.col(part))
    return out.select(*[docs[c] for c in docs.columns], (F.col(first) + F.row_number().over(within) - 1).alias(place))


#: The same schedule in DuckDB's SQL, over documents.
ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, chr(0) || 'null') AS source, md5('{SEED}' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST) - 1 AS rank FROM d),
c AS (SELECT source, count(*) AS n FROM d GROUP BY source),
p AS (SELECT source, n, pow(n, {TEMPER}) / sum(pow(n, {TEMPER})) OVER () AS p, count(*) OVER () AS sources FROM c),
q AS (SELECT *, greatest({PERIOD}, 4 * sources) AS span, round(p * (greatest({PERIOD}, 4 * sources) - sources), 6) AS quota FROM p),
b AS (SELECT *, CAST(floor(quota) AS BIGINT) AS base, span - sources - sum(CAST(floor(quota) AS BIGINT)) OVER () AS over_ FROM q),
u AS (SELECT source, n, span, base + 1 + CASE WHEN row_number() OVER (ORDER BY round(quota - base, 6) DESC, source) <= over_ THEN 1 ELSE 0 END AS units,
      row_number() OVER (ORDER BY source) AS i FROM b),
l AS (SELECT list(units ORDER BY i) AS units, max(span) AS span, count(*) AS sources FROM u),
s AS (
  SELECT -1::BIGINT AS t, list_transform(units, lambda x: 0::BIGINT) AS given, 0::BIGINT AS won FROM l WHERE sources > 0
  UNION ALL
  SELECT t + 1, list_transform(given, lambda g, i: CASE WHEN i = w THEN g + 1 ELSE g END), w FROM (
    SELECT t, given, span, list_min(list_transform(given, lambda g, i: CASE WHEN g < units[i] AND (g * span) // units[i] <= t + 1
      THEN (((g + 1) * span + units[i] - 1) // units[i]) * 1000000 + i END)) % 1000000 AS w FROM s, l WHERE t + 1 < span)),
k AS (SELECT won, t AS slot, row_number() OVER (PARTITION BY won ORDER BY t) - 1 AS k FROM s WHERE t >= 0 AND won IS NOT NULL),
e AS (SELECT min((((n + {BLOCK - 1}) // {BLOCK}) // units) * span + slot) AS fin FROM u JOIN k ON k.won = u.i AND k.k = ((n + {BLOCK - 1}) // {BLOCK}) % units),
m AS (SELECT r.doc_id, r.source, r.rank, r.rank // {BLOCK} AS block, units, span, i FROM r JOIN u USING (source))
SELECT doc_id, CASE WHEN source <> chr(0) || 'null' THEN source END AS source, CAST(rank AS BIGINT) AS rank, CAST(block AS BIGINT) AS block,
  CAST((block * span) // units AS BIGINT) AS release, CAST(((block + 1) * span + units - 1) // units AS BIGINT) AS deadline,
  CAST((block // units) * span + slot AS BIGINT) AS slot, (block // units) * span + slot < fin AS in_mix
FROM m JOIN k ON k.won = m.i AND k.k = m.block % units, e"""
