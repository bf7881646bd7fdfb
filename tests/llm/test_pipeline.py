"""The pipeline and the registered queries on the smallest tables."""

import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import jaccard
from ledgerloom.llm.common import read_table, written
from ledgerloom.llm.queries import QUERIES


def test_stages(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    columns = docs.columns
    before = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert kept and kept <= before and docs.count() == len(kept)
        if name == "near_duplicates":
            assert jaccard.near_duplicates(docs).filter("n_links > 0").count() == 0
        before = kept
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).toPandas()
    assert set(pieces["doc_id"]) == before
    assert pieces.groupby("sequence_id")["length"].sum().max() <= 2048


def test_clean_documents_stay(spark, sf_dir):
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    good = labels.filter("quality = 1").join(docs, "doc_id", "left_semi")
    kept = corpus_pipeline.drop_poor(spark, docs, sf_dir)
    assert good.join(kept, "doc_id", "left_anti").count() <= 0.02 * good.count()
    known = corpus_pipeline.drop_unknown_language(spark, docs, sf_dir)
    assert docs.filter("lang is not null").join(known, "doc_id", "left_anti").count() <= 0.02 * docs.count()


ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "lorem ipsum dolor sit amet " * 8000, "en", None, 1), (3, "lorem ipsum dolor sit amet " * 8000, "en", None, 1),
    (None, "no id here at all", "de", "b", 5), (None, None, None, None, None), (2**60 + 1, "big id", "fr", "a", 6), (7, "123 456", None, "c", 7), (8, "x" * 5000, None, "c", 7),
]
CLASH = ("score", "predicted", "label", "slot", "block", "release", "_h", "h1", "class_id", "labels", "depth", "start", "length", "_row", "text2")


@pytest.mark.parametrize("labelled", [True, False])
def test_stages_on_odd_rows(spark, tmp_path, labelled):
    """Nulls in any column, empty and long texts, repeated rows, clashing names, no labels, no languages, empty tables."""
    labels = [(1, 1, 0), (2, 0, 0), (3, 1, 1), (None, 1, 1), (7, None, None), (2, 1, 0), (999, 0, 0)] if labelled else []
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    if not labelled:
        docs = docs.withColumn("lang", F.lit(None).cast("string"))
    for name in CLASH:
        docs = docs.withColumn(name, F.lit("own"))
    rows = lambda d: sorted(map(str, d.collect()))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0
        if name == "packing":
            assert {r["doc_id"] for r in out.collect()} == {r[0] for r in ODD} and out.groupBy("doc_id", "start").count().filter("count > 1 and doc_id is not null").select("doc_id").distinct().count() == 1
            continue
        assert out.columns == empty.columns == docs.columns
        got, all_of_them = rows(out), rows(docs)
        assert set(got) <= set(all_of_them)
        if name == "mixing" or (name == "quality" and not labelled):
            assert got == all_of_them
        if name == "language":
            ids = {r["doc_id"] for r in out.collect()}
            assert not {1, 2, 7} & ids and (labelled or {3, 8, None, 2**60 + 1} == ids)
        if name == "near_duplicates":
            assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect()) == [(False, 1), (False, 3), (False, 7), (False, 8), (False, 2**60 + 1), (True, 0)]


def test_held_out_rows_and_keys(spark, sf_dir):
    ids = [r["doc_id"] for r in read_table(spark, sf_dir, "documents").select("doc_id").collect()]
    for name, modulus, rest in (("op1_quality_classifier", 4, 2), ("op2_toxicity", 5, 0), ("op3_language_id", 3, 1)):
        got = {r["doc_id"]: r for r in QUERIES[name](spark, sf_dir).collect()}
        assert sorted(got) == sorted(ids)
        assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % modulus == rest) and 0 <= got[i]["score"] <= 1 for i in ids)


#: The columns that the contract names, in order, with their types.
CONTRACT = {
    1: "doc_id bigint, held_out boolean, score double, predicted int",
    2: "doc_id bigint, held_out boolean, score double, predicted int",
    3: "doc_id bigint, held_out boolean, lang_pred string, score double",
    4: "query_id bigint, rank int, vec_id bigint, score double",
    5: "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    6: "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    7: "doc_id bigint, slot bigint",
    8: "doc_id bigint, class_id bigint, n_links bigint",
    9: "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    10: "page_id bigint, host string, path string, rule string, verdict string",
}


@pytest.mark.parametrize("number", [n for n in CONTRACT if n > 3])
def test_queries_give_their_columns_for_every_row(spark, sf_dir, number):
    name = next(n for n in QUERIES if n.startswith(f"op{number}_"))
    out = QUERIES[name](spark, sf_dir)
    kinds = dict(out.dtypes)
    assert all(kinds[c.split()[0]] == c.split()[1] for c in CONTRACT[number].split(", "))
    rows = out.collect()
    table, key = {4: ("embeddings", "vec_id"), 10: ("pages", "page_id")}.get(number, ("documents", "doc_id"))
    ids = {r[0] for r in read_table(spark, sf_dir, table).select(key).collect()}
    if number == 4:
        assert {r["query_id"] for r in rows} == {i for i in ids if i % 100 == 0} and len(rows) == 10 * len({r["query_id"] for r in rows})
    else:
        assert {r[key] for r in rows} == ids and (number == 9 or len(rows) == len(ids))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.create_function("crc32", lambda t: zlib.crc32(t.encode()), ["VARCHAR"], "BIGINT")
    for name in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def test_base_columns_of_the_language_model_equal_sql(spark, sf_dir, duck):
    want = duck.execute("""WITH d AS (SELECT doc_id, crc32(CAST(doc_id AS VARCHAR)) % 7 = 2 AS held, list_append(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''), '') AS bag FROM documents),
    t AS (SELECT doc_id, held, unnest(bag) AS w FROM d), c AS (SELECT w, count(*) AS c FROM t WHERE NOT held GROUP BY 1), n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
    SELECT doc_id, held, count(*), count(c), any_value(n), sum(log10((coalesce(c, 0) + 1) / CAST(n + v + 1 AS DOUBLE))) FROM t LEFT JOIN c USING (w), n GROUP BY doc_id, held ORDER BY doc_id""").fetchall()
    got = QUERIES["op5_context_tree_weighting"](spark, sf_dir).orderBy("doc_id").select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score").collect()
    assert [tuple(r)[:5] for r in got] == [tuple(map(int, (r[0], r[1], r[2], r[3], r[4]))) for r in want]
    assert [r["base_score"] for r in got] == pytest.approx([r[5] for r in want], rel=1e-9)


def test_edits_equal_sql(spark, sf_dir, duck):
    want = duck.execute("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), x AS (SELECT doc_id, t, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nx, length(t) AS n FROM d WINDOW w AS (ORDER BY doc_id, t))
    SELECT doc_id, n, sha256(left(t, n - n // 2) || left(nx, n // 2)) FROM x ORDER BY doc_id""").fetchall()
    got = QUERIES["op6_order_minhash"](spark, sf_dir).orderBy("doc_id").select("doc_id", "n_chars", "edited_sha256").collect()
    assert list(map(tuple, got)) == want


def test_neighbours_against_sql(spark, sf_dir, duck):
    want = set(duck.execute("""SELECT q, v FROM (SELECT a.vec_id AS q, b.vec_id AS v, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), b.vec_id) AS k
    FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) WHERE k <= 10""").fetchall())
    got = {(r["query_id"], r["vec_id"]) for r in QUERIES["op4_multi_index_hashing"](spark, sf_dir).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
