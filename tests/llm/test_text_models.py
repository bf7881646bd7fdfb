"""Quality, toxicity, language and language-model scores."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import ctw, language, quality, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"


def many(spark):
    """200 documents: every fourth is junk, every tenth insults; the others are plain."""
    rows, labels = [], []
    for i in range(200):
        if i % 4 == 0:
            text = " ".join(f"###{i + k}$$$" for k in range(20))
        else:
            text = "The garden was quiet. We read a book about rivers. Later the rain came."
        if i % 10 == 1:
            text += " You are a stupid idiot. Go away."
        rows.append((i, text, "en", "a", len(text)))
        labels.append((i, int(i % 4 != 0), int(i % 10 == 1)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)


ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "word " * 30_000, "en", None, 150_000), (3, "word " * 30_000, "en", None, 150_000), (None, "no id", "de", "b", 5)]


def test_quality_learns_and_filters(spark):
    docs, labels = many(spark)
    model = quality.fit(docs, labels)
    scored = quality.score(docs, model).toPandas()
    assert (scored["predicted"] == (scored["doc_id"] % 4 != 0)).all()
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.keep_good(docs, model).count() == 150


def test_quality_odd_rows(spark):
    docs, labels = many(spark)
    model = quality.fit(docs, labels)
    odd = spark.createDataFrame(ODD, DOCS).withColumn("score", F.lit("clash"))
    out = quality.score(odd, model).toPandas()
    assert len(out) == 5 and out["score"].between(0, 1).all()
    assert out[out["doc_id"] == 3]["score"].nunique() == 1
    assert quality.score(docs.limit(0), model).count() == 0
    none = quality.fit(docs.limit(0), labels.limit(0))
    assert quality.score(docs.limit(3), none).count() == 3


def test_quality_word_shares_equal_the_average_of_vectors():
    bucket, owner = quality.features(["ab", "ab", "xyz"])
    assert list(bucket[owner == 0]) == list(bucket[owner == 1])
    model = quality.Model(np.arange(quality.BUCKETS) / 1e6, 0.3)
    z = 0.3 + model.share[quality.features(["ab", "xyz"])[0]].mean()
    assert model.scores(["ab xyz"])[0] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-6)


def test_toxicity_finds_documents_and_sentences(spark):
    docs, labels = many(spark)
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model).toPandas()
    assert (out["predicted"] == (out["doc_id"] % 10 == 1)).all()
    found = toxicity.locate(docs, model).toPandas()
    assert set(found["doc_id"]) == set(range(1, 200, 10))
    assert found["text"].str.contains("idiot").all()


def test_toxicity_is_the_noisy_or_of_sentences():
    model = toxicity.Model({"bad": 3.0}, -2.0)
    p = [1 / (1 + math.exp(-(-2.0 + 3.0 * k))) for k in (1, 0, 2)]
    want = 1 - np.prod([1 - x for x in p])
    score, worst = model.scores(["Bad. fine! bad bad", ""])
    assert score[0] == pytest.approx(want) and worst[0] == 2
    assert score[1] == pytest.approx(1 / (1 + math.exp(2.0)))


def test_toxicity_odd_rows(spark):
    docs, labels = many(spark)
    model = toxicity.fit(docs, labels)
    out = toxicity.score(spark.createDataFrame(ODD, DOCS), model, ("doc_id", "source")).toPandas()
    assert len(out) == 5 and out["score"].between(0, 1).all()
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.score(docs.limit(2), toxicity.fit(docs.limit(0), labels)).count() == 2


def test_language_forward_sums_all_segmentations():
    pieces = {"▁a": 1, "b": 2, "▁ab": 3, "bc": 4, "c": 5, "abc": 6}
    p = np.array([[0.05, 0.2, 0.1, 0.3, 0.15, 0.2, 0.0]])
    got = language.Lattice(["abc"], pieces, 3).likelihoods(p)[0, 0]

    def total(rest):
        if not rest:
            return 1.0
        out = 0.0
        for k in range(1, len(rest) + 1):
            if rest[:k] in pieces:
                out += p[0, pieces[rest[:k]]] * total(rest[k:])
            elif k == 1:
                out += p[0, 0] * total(rest[1:])
        return out

    assert got == pytest.approx(math.log(total("▁abc")))


def test_language_long_words_are_summed_whole():
    pieces = language.vocabulary()
    longest = max(map(len, pieces))
    p = np.random.default_rng(0).dirichlet(np.ones(len(pieces) + 1), 3)
    words = ["a", "hello", "zażółć", "x" * 60, "antidisestablishmentarianism" * 2]
    alone = np.array([language.long_likelihood(w, p, pieces, longest) for w in words])
    assert alone == pytest.approx(language.Lattice(words, pieces, longest).likelihoods(p))
    model = language.Model(["a", "b", "c"], p)
    assert model.word_values([*words, "ab" * 3000])[:-1] == pytest.approx(alone)
    assert np.isfinite(model.word_values(["ab" * 3000])).all()


def test_language_predicts_and_keeps(spark):
    text = {"en": "the house and the garden were with this", "de": "das haus und der garten waren nicht schön", "fr": "la maison et le jardin étaient très beaux"}
    rows = [(i, text[k] + " " + text[k][: i % 9], k, "s", 1) for i, k in enumerate(["en", "de", "fr"] * 20)]
    docs = spark.createDataFrame(rows, DOCS)
    model = language.fit(docs.filter("doc_id < 40"))
    out = language.predict(docs, model, ("doc_id", "lang")).toPandas()
    assert (out["lang_pred"] == out["lang"]).all() and out["score"].between(0, 1).all()
    odd = spark.createDataFrame([*ODD, (9, "123 !!", "en", "x", 6)], DOCS)
    got = language.predict(odd, model).toPandas()
    assert set(got[got["doc_id"].isin([1, 2, 9])]["lang_pred"]) == {"und"}
    kept = language.keep_known(odd, model)
    assert kept.columns == odd.columns and not {1, 2, 9} & {r[0] for r in kept.select("doc_id").collect()}
    assert language.predict(docs.limit(0), model).count() == 0
    empty = language.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language.predict(docs, empty).collect()} == {"und"}


def brute_ctw(lines, depth):
    """Returns a function giving the natural log probability of a line, after learning from all lines together."""
    gap = b"\xff" * depth
    tree = {}
    for line in lines:
        for i, byte in enumerate(line + b"\xff"):
            past = (gap + line)[: depth + i]
            for d in range(depth + 1):
                node = 1
                for bit in map(int, f"{byte:08b}"):
                    tree.setdefault(past[len(past) - d :], {}).setdefault(node, [0, 0])[bit] += 1
                    node = 2 * node + bit
    children = {}
    for context in tree:
        if context:
            children.setdefault(context[1:], []).append(context)
    block = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    weighted, odds = {}, {}
    for context in sorted(tree, key=len, reverse=True):
        for node, (a, b) in tree[context].items():
            own = block(a, b)
            if len(context) == depth:
                weighted[context, node] = own
                continue
            below = sum(weighted.get((c, node), 0.0) for c in children[context])
            weighted[context, node] = np.logaddexp(own, below) - math.log(2)
            odds[context, node] = own - below

    def log_probability(line):
        total = 0.0
        for i, byte in enumerate(line + b"\xff"):
            past, node = (gap + line)[: depth + i], 1
            for bit in map(int, f"{byte:08b}"):
                path = [c for c in (past[len(past) - d :] for d in range(depth + 1)) if node in tree.get(c, {})]
                p = 0.5
                for context in reversed(path):
                    n = tree[context][node]
                    estimate = (n[bit] + 0.5) / (sum(n) + 1)
                    if len(context) == depth:
                        p = estimate
                    elif context is path[-1]:
                        p = estimate  # no longer context has seen the node
                    else:
                        beta = math.exp(odds[context, node])
                        p = (beta * estimate + p) / (beta + 1)
                total += math.log(p)
                node = 2 * node + bit
        return total

    return log_probability


@pytest.mark.parametrize(("most_pairs", "head", "depth"), [(10**6, 10**5, 6), (0, 2, 6), (40, 2, 4), (10**6, 10**5, 3)])
def test_ctw_equals_brute_force(spark, most_pairs, head, depth):
    """Frequent words and pairs in the scan, the others from the joins."""
    from collections import Counter

    texts = ["the cat sat on the mat", "The Cat ate", None, "", "der hund und die katze und der hund", "zzz   the\ttheß\n", "der hund"] * 2
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in ctw.score(docs, F.col("doc_id") % 5 != 2, depth=depth, head=head, most_pairs=most_pairs).collect()}
    plain = Counter()
    lines = [ctw.line_of(t or "") for t in texts]
    for i, line in enumerate(lines):
        if i % 5 != 2:
            plain.update([*line.split(), b""])
    lp = brute_ctw([x for i, x in enumerate(lines) if i % 5 != 2], depth)
    total, distinct = sum(plain.values()), len(plain)
    for i, line in enumerate(lines):
        words = [*line.split(), b""]
        base = sum(math.log10((plain[w] + 1) / (total + distinct + 1)) for w in words)
        assert got[i]["score"] == pytest.approx(lp(line) / math.log(10), rel=1e-5) and got[i]["base_score"] == pytest.approx(base, rel=1e-9)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(words), sum(plain[w] > 0 for w in words), total)


def test_ctw_sees_the_order_of_words(spark):
    rng = np.random.default_rng(3)
    train = [" ".join(["red", "fox", "saw", "one", "big", "dog", "now"][i % 7] for i in range(rng.integers(5, 40))) for _ in range(50)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*train, "red fox saw one big dog now", "now dog big one saw fox red"])], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in ctw.score(docs, F.col("doc_id") < 50).collect()}
    assert got[50]["score"] > got[51]["score"] + 3 and got[50]["base_score"] == pytest.approx(got[51]["base_score"])


def test_ctw_parts_and_lookups():
    pair, n = ctw.pairs_in([b"ab", b"", b"abc"], 3)
    assert list(n) == [3, 1, 4] and list(pair & 255) == [97, 98, 255, 255, 97, 98, 99, 255]
    assert pair[1] >> 8 == 97 | 0xFFFF00 and pair[3] >> 8 == 0xFFFFFF == pair[0] >> 8
    tree = ctw.Subtree(pair, np.ones(len(pair), np.int64), 3)
    assert tree.rest[1].sum() + tree.rest[2].sum() == 8 * 8
    assert ctw.log_gamma(np.array([0.5, 3.5, 100.0])) == pytest.approx([math.lgamma(x) for x in (0.5, 3.5, 100.0)])
    key = np.unique(np.random.default_rng(0).integers(0, 1 << 56, 5000))
    found = ctw.Lookup(key, np.arange(len(key)) / 7).of(np.concatenate([key, key + 1]))
    assert found[: len(key)] == pytest.approx(np.arange(len(key)) / 7) and np.isnan(found[len(key) :]).mean() > 0.99
    rows = pd.DataFrame({"_two": [1] * 5 + [2] * 7, "_three": [-1, 3, 3, 4, 4, -1, 2, 2, 2, 2, 5, 5], "pair": range(12)})
    before, ctw.CHUNK = ctw.CHUNK, 3
    pieces = list(ctw._whole_groups(iter([rows.iloc[i : i + 2] for i in range(0, 12, 2)])))
    ctw.CHUNK = before
    assert pd.concat(pieces)["pair"].tolist() == list(range(12)) and len(pieces) > 2
    assert all(not set(zip(a["_two"], a["_three"])) & set(zip(b["_two"], b["_three"])) for a, b in zip(pieces, pieces[1:]))


def test_ctw_without_training_rows_or_rows(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id bigint, text string")
    got = ctw.score(docs, F.lit(False)).collect()
    assert {r["n_known"] for r in got} == {0}
    bits = {r["doc_id"]: -r["score"] / math.log10(2) for r in got}
    assert bits[1] - bits[2] == pytest.approx(8 * 2) and bits[2] == pytest.approx(8)
    assert ctw.score(docs.limit(0), F.lit(True)).count() == 0


def test_the_bound_of_the_quality_sample_does_not_move_scores(spark):
    docs, labels = many(spark)
    labels = labels.withColumn("quality", (F.col("doc_id") % 10 != 0).cast("int"))
    empty = [quality.fit(docs, labels, per_class=n).scores([""])[0] for n in (1000, 20)]
    assert abs(empty[0] - empty[1]) < 0.05 and min(empty) > 0.8


def test_the_bound_of_characters_does_not_move_scores(spark, monkeypatch):
    """Long good texts and short bad ones: where the bound on characters bites, it leaves fewer good ones in the sample."""
    rng = random.Random(5)
    words = lambda n, of: " ".join(rng.choice(of) for _ in range(n))
    good, bad, both = ["alpha", "beta", "gamma"], ["zip", "zap", "zop"], ["the", "and", "of", "in"]
    docs = [(i, words(400, good + both)) for i in range(200)] + [(200 + i, words(20, bad + both)) for i in range(200)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(400)] + [(9000 + i, 0) for i in range(300)], "doc_id bigint, quality int")  # the last have no document
    whole = quality.fit(docs, labels).scores(["", "alpha beta", "zip zap"])
    monkeypatch.setattr(quality, "FIT_CHARACTERS", 30_000)
    part = quality.fit(docs, labels).scores(["", "alpha beta", "zip zap"])
    assert np.abs(whole - part).max() < 0.1 and abs(whole[0] - 0.5) < 0.1


def test_numbers_and_symbols_have_no_language():
    import sys
    import unicodedata

    model = language.train(["der die das und", "the of and to"], ["de", "en"])
    odd = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("No", "Nl", "Nd", "Sm", "Sc", "So", "Sk", "Mn", "Me", "Mc", "Pc")]
    for texts in (odd[i : i + 5000] for i in range(0, len(odd), 5000)):
        found, score = model.predict(texts)
        assert set(found) == {"und"} and not score.any()
    assert set(model.predict(["½ the", "Ⅷ² und", "١٢٣ of"])[0]) == {"en", "de"} and language.words_of("½abc²de_f Ⅷ") == ["abc", "de", "f"]
