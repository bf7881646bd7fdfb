"""Spelling variants, quality rules and manifests, against plain versions of what they compute."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import manifest, outliers, spelling
from ledgerloom.llm.common import read_table

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


# Spelling variants.
def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words, times=5):
    near = {w: sorted(((-n, v) for v, n in words.items() if one_apart(w, v))) for w in words}
    form = {w: x[0][1] if x and -x[0][0] >= times * words[w] else None for w, x in near.items()}
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n, form[w], root, len(near[w]), words[form[w]] if form[w] else None)
    return out


def told(rows):
    return {r["word"]: (r["n"], r["form"], r["root"], r["n_near"], r["form_n"]) for r in rows}


@pytest.mark.parametrize("letters", ["ab", "abcé"])
def test_near_words_of_few_letters(spark, letters):
    """Words of two letters are full of anagrams, repeats and pairs that differ in either half."""
    rng = random.Random(letters)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 7))): rng.choice((5, 6, 30, 200, 200, 2000)) for _ in range(300)}
    got = told(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n bigint")).collect())
    assert got == plain_variants(words)
    assert spelling.variants(spark.createDataFrame([], "word string, n bigint")).count() == 0


def test_chains_of_forms_and_long_words(spark):
    long = "ÿ" * 5000
    words = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 15625, long: 5, long + "a": 5, "zzzzzz": 5}
    got = told(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n bigint")).collect())
    assert got == plain_variants(words) and got["aaaaaa"][2] == "abbbbb" and got[long][3] == 1


def plain_counts(rows, least=6):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 199 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= least}


def test_counts_of_words(spark):
    rows = [(1, None), (2, ""), (3, "Straße STRASSE straßen ÀÉÎ ÀÉÎÕÜßx İstanbul ǅabcdefg 12abcdef_ghijklm ẞabcdef"), (4, "wordone " * 30000), (4, "wordone " * 30000)]
    rows += [(i, " ".join(f"{a}{b}cdefgh" for a, b in itertools.product("abcdefghijklmnopqrst", repeat=2))) for i in range(5, 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    got = {r["word"]: r["n"] for r in spelling.counted(docs, 6, spelling.misspell).collect()}
    assert got == plain_counts(rows)
    assert {r["word"]: r["n"] for r in spelling.counted(docs.filter("doc_id = 4")).collect()} == {"wordone": 60000}
    assert spelling.counted(docs.limit(0)).count() == 0


def test_nothing_that_grows_with_the_words_is_broadcast(spark, tmp_path):
    """A word has some twenty sockets, but Spark sizes these by the file of the words."""
    spark.createDataFrame([("abcdef", 50), ("abcdeg", 5), ("abcdefz", 5)], "word string, n bigint").write.parquet(f"{tmp_path}/words")
    words = spark.read.parquet(f"{tmp_path}/words")
    pairs = spelling.near_pairs(words)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert {(r["word"], r["other"]) for r in pairs.collect()} == {("abcdef", "abcdeg"), ("abcdeg", "abcdef"), ("abcdef", "abcdefz"), ("abcdefz", "abcdef")}
    roots = spelling.variants(words)
    assert "Broadcast" not in roots._jdf.queryExecution().executedPlan().toString() and told(roots.collect())["abcdeg"][2] == "abcdef"


def test_query_of_spelling_variants(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in read_table(spark, sf_dir, "documents").collect()]
    words = {w: n for w, n in plain_counts(rows).items() if n >= 5}
    assert told(spelling.op11_anagram_hashing(spark, sf_dir).collect()) == plain_variants(words)


# Quality rules.
def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


TEXTS = [
    None, "", " \n\t\x0b", "a b c d e", "a b c d e a b c d e", "x " * 9, "x " * 10, "x " * 5, "x " * 6, "one two three four five six one two three four five six seven", "l\nl\n\n l\nl\r\n \n ", "#*$%&|<> \U0001f600# é",
    "a b c d e f g h a b c d e z b c d e f q", "tail " * 3 + "\n" + "w1 w2 w3 w4 w5 w6 " * 2000, "  wide space \x85 \x1c y",
]


def test_counts_of_the_rules(spark):
    docs = spark.createDataFrame([(i, t, "en", None, 0) for i, t in enumerate(TEXTS)], DOCS)
    got = {r["doc_id"]: r for r in outliers.judge(docs, ["doc_id"]).collect()}
    for i, t in enumerate(TEXTS):
        want = plain_statistics(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, (i, t and t[:40])
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r["kept"] == (not r["base_failed"])  # too few rows for an estimate


@given(st.text("ab \n", max_size=60))
@settings(max_examples=5, deadline=None)
def test_repeats_of_any_text(spark, text):
    docs = spark.createDataFrame([(k, text[k:], None, None, 0) for k in range(len(text) + 1)], DOCS)
    rows = docs.select("doc_id", *outliers.counts(F.col("text"))).select("doc_id", "_words.*", "_lines.*").collect()
    for r in rows:
        want = plain_statistics(text[r["doc_id"] :])
        assert (r["n_words"], r["n_dup_lines"], r["n_repeat_words"]) == (want[0], want[3], want[4])


def plain_mcd(x, steps=60):
    """The same estimate by numpy, with whole halves instead of bins."""
    ridge = np.diag(np.square(list(outliers.RESOLUTION.values())))
    h = len(x) // 2

    def shape(rows, share):
        return rows.mean(0), np.cov(rows.T, bias=True) * outliers.consistency(share) + ridge

    def far(fit):
        d = x - fit[0]
        return np.einsum("ij,jk,ik->i", d, np.linalg.inv(fit[1]), d)

    q = np.percentile(x, [25, 50, 75], axis=0)
    spread = np.maximum((q[2] - q[0]) / 1.349, np.sqrt(np.diag(ridge)))
    fit = q[1], np.diag(spread**2)
    for _ in range(steps):
        fit = shape(x[np.argsort(far(fit), kind="stable")[:h]], outliers.HALF)
    return far(shape(x[far(fit) <= outliers.chi2_point(outliers.REWEIGHT, 4)], outliers.REWEIGHT))


def test_outliers_against_numpy(spark):
    rng = np.random.default_rng(4)
    clean = rng.multivariate_normal([1.6, 0.1, 0.2, 0.1], np.diag([0.01, 0.004, 0.02, 0.01]) + 0.002, 3000)
    foul = rng.normal([2.4, 0.6, 0.2, 0.1], 0.03, (1200, 4))  # together: a plain covariance is drawn towards them
    x = np.vstack([clean, foul])
    points = spark.createDataFrame([("g", *map(float, v)) for v in x], "key string, x0 double, x1 double, x2 double, x3 double").repartition(5)
    got = points.join(outliers.fit(points), "key").select("x0", "x1", "x2", "x3", outliers.distance().alias("d")).toPandas()
    want = {tuple(v): d for v, d in zip(x, plain_mcd(x), strict=True)}
    a, b = got["d"].to_numpy(), np.array([want[tuple(v)] for v in got[["x0", "x1", "x2", "x3"]].to_numpy()])
    assert np.abs(np.log1p(a) - np.log1p(b)).max() < 0.1
    cut = outliers.chi2_point(outliers.KEPT, 4)
    assert ((a > cut) == (b > cut)).mean() > 0.999 and (a > cut).sum() >= 1200


def test_groups_too_small_to_estimate(spark):
    sizes = {("en", "a"): 60, ("en", "b"): 30, ("en", None): 30, ("fr", "a"): 20, (None, None): 40, ("de", "x"): 1}
    rows = spark.createDataFrame([(k[0], k[1], False) for k, n in sizes.items() for _ in range(n)] + [("es", "z", True)] * 99, "_lang string, _source string, base_failed boolean")
    got = {(r["_lang"], r["_source"]): r["key"] for r in outliers.grouped(rows).collect()}
    assert len(set(got.values())) == 3 and got["en", "b"] == got["en", None] != got["en", "a"] and got["fr", "a"] == got[None, None] == got["de", "x"]
    few = outliers.grouped(rows.filter("_lang = 'fr'")).collect()
    assert [r["key"] for r in few] == [None]


def test_query_of_quality_rules(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in read_table(spark, sf_dir, "documents").collect()}
    got = outliers.op12_quality_rules(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_statistics(docs[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def test_rules_agree_with_labels(spark):
    """Good documents stay; of the bad ones most of those that base rules pass are rejected."""
    got = outliers.op12_quality_rules(spark, "/root/testdata/sf0.01").join(read_table(spark, "/root/testdata/sf0.01", "labels").filter("quality is not null"), "doc_id").filter("not base_failed").toPandas()
    good, bad = got[got["quality"] == 1], got[got["quality"] == 0]
    assert good["kept"].mean() >= 0.98 and bad["kept"].mean() <= 0.1


def test_rules_of_odd_rows_and_clashing_names(spark):
    rows = [(None, None, None, None, None), (1, "good plain words " * 9, "en", "a", 1), (1, "good plain words " * 9, "en", "a", 1), (2, "", "en", None, 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit("clash")).withColumn("x0", F.lit("clash")).withColumn("_lang", F.lit(3))
    assert outliers.keep_usual(docs).dtypes == docs.dtypes and outliers.judge(docs, ["doc_id"]).count() == 4
    assert outliers.judge(docs.limit(0), ["doc_id"]).count() == 0


# Manifests.
def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r, lower=False):
    text = r["text"]
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves):
    """(root, siblings of each leaf level by level with its place)."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for p, i in zip(paths, at, strict=True):
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            p.append((run[: i % 8], run[i % 8 + 1 :]))
        level, at = [h(*level[i : i + 8]) for i in range(0, len(level), 8)], [i // 8 for i in at]
    return level[0], paths


def plain_manifest(rows, tampered):
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r), r))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: plain_tree([x[2] for x in sorted(by_lang[lang], key=lambda x: x[:3])]) for lang in langs}
    root, tops = plain_tree([trees[lang][0] for lang in langs])
    out = []
    for lang, top in zip(langs, tops, strict=True):
        for (_, doc_id, leaf, r), path in zip(sorted(by_lang[lang], key=lambda x: x[:3]), trees[lang][1], strict=True):
            whole, folded = path + top, plain_leaf(r, tampered(r))
            proof = h(*(x for before, after in whole for x in (*before, *after)))
            for before, after in whole:
                folded = h(*before, folded, *after)
            out.append((r["doc_id"], leaf, trees[lang][0], root, proof, folded, folded == root))
    return out


def in_order(rows):
    return sorted([tuple(r) for r in rows], key=repr)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 700])
def test_manifest_against_plain_trees(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([i, 3 * i, 10**12 + i]), rng.choice(["Text A", "", None, "é\U0001f600 B"]), rng.choice([None, "", "en", "é", "z"][: 1 + n % 5]), rng.choice([None, "s"]), rng.choice([None, 7])) for i in range(n)]
    rows += [(None, "No id", "en", None, None), (None, None, None, None, None)] * (n == 65)
    docs = spark.createDataFrame(rows, DOCS).withColumn("leaf", F.lit("clash")).withColumn("shard", F.lit("clash"))
    wanted = plain_manifest(docs.collect(), lambda r: r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0)
    got = manifest.manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, shard_rows=11, fan=3).collect()
    assert in_order(got) == in_order(wanted)


def test_manifest_of_many_languages_and_none(spark):
    docs = spark.createDataFrame([(i, "T", f"l{i % 170}", "s", 1) for i in range(400)], DOCS)
    assert in_order(manifest.manifest(docs, shard_rows=30, fan=2).collect()) == in_order(plain_manifest(docs.collect(), lambda r: False))
    assert manifest.manifest(docs.limit(0)).count() == 0


def test_query_of_the_manifest(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents").collect()
    got = manifest.op13_merkle_manifest(spark, sf_dir).collect()
    assert in_order(got) == in_order(plain_manifest(rows, lambda r: zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0))
    assert {r["verified"] for r in got} == {True, False}


@given(st.lists(st.integers(1, 90), min_size=1, max_size=12), st.randoms())
@settings(max_examples=60, deadline=None)
def test_forests_are_a_monoid(sizes, rng):
    leaves = {t: n for t, n in enumerate(sizes)} | {manifest.TOP: len(sizes)}
    nodes = [((t, 0, i), h(str(t), str(i))) for t, n in enumerate(sizes) for i in range(n)]
    rng.shuffle(nodes)
    cut = sorted(rng.randint(0, len(nodes)) for _ in range(2))
    of = lambda *parts: manifest.Forest(leaves).add(dict(itertools.chain(*parts)))
    merge = lambda a, b: of(a.nodes.items(), b.nodes.items())
    a, b, c = of(nodes[: cut[0]]), of(nodes[cut[0] : cut[1]]), of(nodes[cut[1] :])
    left, right = merge(merge(a, b), c), merge(a, merge(b, c))
    assert left.nodes == right.nodes == merge(c, merge(b, a)).nodes and merge(a, of()).nodes == a.nodes
    assert list(left.nodes.values()) == [plain_tree([plain_tree([h(str(t), str(i)) for i in range(n)])[0] for t, n in enumerate(sizes)])[0]]
