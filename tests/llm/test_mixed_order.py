"""What mixing does reaches the packed sequences."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import packing
from ledgerloom.llm.common import written


@pytest.mark.parametrize("ranked", [50_000, 7])
def test_sequences_follow_the_order_of_the_mix(spark, sf_dir, monkeypatch, ranked):
    monkeypatch.setattr(packing, "RANKED", ranked)
    rows = [(i, "word " * (60 + i * 37 % 900 + 4000 * (i % 50 == 7)), "ab"[i % 7 == 0], "en", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n_chars bigint")
    mixed = corpus_pipeline.mix_sources(spark, docs, sf_dir)
    order = [r["doc_id"] for r in mixed.collect()]
    pieces = corpus_pipeline.pack_sequences(spark, written(mixed, "mixed"), sf_dir).toPandas()
    assert "_at" not in pieces.columns and set(pieces["doc_id"]) == set(range(300))
    first = pieces.assign(at=pieces["doc_id"].map({d: k for k, d in enumerate(order)})).groupby("sequence_id")["at"].min().sort_index()
    assert list(first.index) == list(range(len(first))) and list(first) == sorted(first)
    # As many sequences as without an order, gapless, and another order gives another packing.
    plain = packing.pack_documents(docs).toPandas()
    assert plain["sequence_id"].nunique() == len(first)
    for _, s in pieces.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] and s["length"].sum() <= 2048
    turned = corpus_pipeline.pack_sequences(spark, written(docs.orderBy(F.desc("doc_id")), "turned"), sf_dir).toPandas()
    key = ["doc_id", "start"]
    assert not turned.sort_values(key)["sequence_id"].reset_index(drop=True).equals(pieces.sort_values(key)["sequence_id"].reset_index(drop=True))
