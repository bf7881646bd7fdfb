"""Nulls in any column, empty and long texts, repeated rows, empty tables and clashing columns, for the operators on documents."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import ctw, fingerprint, jaccard, mixing, packing

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "lorem ipsum dolor sit amet " * 8000
ROWS = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, LONG, "en", None, 1), (3, LONG, "en", None, 1), (None, "no id here at all", "de", "b", 5), (None, None, None, None, None), (2**60 + 1, "big id", "fr", "a", 6)]
OPERATORS = {
    "packing": (lambda d: packing.pack_documents(d), {"sequence_id", "offset", "length", "start"}),
    "near": (lambda d: jaccard.near_duplicates(d), {"class_id", "n_links", "h1", "h2"}),
    "keep": (lambda d: jaccard.keep_one(d), set()),
    "mix": (lambda d: mixing.mix(d), {"block", "slot", "in_mix", "release", "deadline", "source_start"}),
    "kept mix": (lambda d: mixing.keep_mixed(d), {"block", "slot"}),
    "edits": (lambda d: fingerprint.compare_edits(d), {"fingerprint", "value", "next_text"}),
    "fingerprint": (lambda d: fingerprint.fingerprint(d), {"fingerprint"}),
    "lm": (lambda d: ctw.score(d, F.lit(True), ("doc_id", "source")), {"score", "base_score", "n_tokens"}),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    run, names = OPERATORS[name]
    docs = spark.createDataFrame(ROWS, DOCS)
    for column in sorted(names):
        docs = docs.withColumn(column, F.lit("clash"))
    out = run(docs).collect()
    ids = [r["doc_id"] for r in out]
    assert len(out) >= (4 if name in ("keep", "kept mix") else len(ROWS))
    assert {1, 3, 2**60 + 1, None} <= set(ids) or name in ("keep", "kept mix")
    assert run(docs.limit(0)).count() == 0


def test_equal_rows_get_equal_results(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    twice = [r for r in ctw.score(docs, F.lit(True)).collect() if r["doc_id"] == 3]
    assert len(twice) == 2 and twice[0] == twice[1]
    near = {r["doc_id"]: r for r in jaccard.near_duplicates(docs).collect() if r["doc_id"] in (1, 2, 3)}
    assert near[1]["class_id"] == near[2]["class_id"] == 1 and near[3]["n_copies"] == 2
