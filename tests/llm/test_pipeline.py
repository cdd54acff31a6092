import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyspark.llm import mixing, piece_codec
from tallyspark.llm._common import stash, table
from tallyspark.llm.queries import PIECE_VOCABULARY, vocabulary


def test_stages_keep_columns_and_drop_copies(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    out = corpus_pipeline.run(spark, sf)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "mix", "pieces"]
    assert 0 < out.count() <= docs.count() and out.where("NOT intact").count() == 0
    assert out.select("doc_id").distinct().count() == out.count()


def test_mix_reaches_what_follows(spark, monkeypatch):
    sizes = {"hot": 900, "a": 200, "b": 200, "tiny": 3, None: 40}
    rows = [(i, f"text {i} of {s}", s) for i, (s, _) in enumerate((s, k) for s, n in sizes.items() for k in range(n))]
    rows += [(None, "one", None), (None, "two", None), (None, None, "a"), (7, "text 7 again", "hot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    monkeypatch.setattr(mixing, "SLOTS", 8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mixed = stash(corpus_pipeline.mix(spark, docs, ""), "mixed")
        out = corpus_pipeline.pieces(spark, mixed, "")
        assert out.rdd.getNumPartitions() > 1
        out = out.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["mix_place"] for r in out] == list(range(len(rows)))  # rows and files lie in the order of the mix
    plan = {}  # the first slot of each (doc_id, source)
    for r in sorted(mixing.schedule(docs).collect(), key=lambda r: (r["slot"], r["rank"])):
        plan.setdefault((r["doc_id"], r["source"]), (r["slot"], r["rank"]))
    assert [plan[r["doc_id"], r["source"]] for r in out] == sorted(plan[d, s] for d, _, s in rows)
    ids = [(r["doc_id"], r["source"], tuple(r["ids"])) for r in out]
    c = piece_codec.codec(vocabulary(PIECE_VOCABULARY))
    assert sorted(ids, key=str) == sorted(((d, s, tuple(np.frombuffer(c.encode(t, d), "<u4").tolist())) for d, t, s in rows), key=str)
    assert {"hot", "a", "b", None} <= {r["source"] for r in out[:400]}  # unmixed, the first 900 are of one source
    again = corpus_pipeline.pieces(spark, corpus_pipeline.mix(spark, docs.repartition(5), ""), "").collect()
    assert sorted((r["mix_place"], r["doc_id"], tuple(r["ids"])) for r in again if r["doc_id"] is not None) == sorted((r["mix_place"], r["doc_id"], tuple(r["ids"])) for r in out if r["doc_id"] is not None)
    assert [tuple(r["ids"]) for r in sorted(again, key=lambda r: r["mix_place"])] == [tuple(r["ids"]) for r in out]


def test_pipeline_result_holds_the_mix(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r["mix_place"] for r in out) == list(range(len(out)))


def test_names_that_clash_are_refused(spark):
    docs = spark.createDataFrame([(1, "a", "s", 0)], "doc_id long, text string, source string, MIX_place long")
    with pytest.raises(ValueError):
        mixing.mix(docs, place="mix_place")
    with pytest.raises(ValueError):
        piece_codec.encode_documents(docs, vocabulary(PIECE_VOCABULARY), keep=["text", "Doc_ID"])
    assert corpus_pipeline.pieces(spark, corpus_pipeline.mix(spark, docs.drop("MIX_place").withColumn("place", F.lit("x")).limit(0), ""), "").count() == 0
