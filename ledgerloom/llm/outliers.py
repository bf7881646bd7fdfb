"""Quality rules: fixed base rules, and robust multivariate outliers among the documents that pass them, all in SQL functions.

Each document has a vector of transformed statistics. For every group (language and source) the minimum covariance
determinant is estimated: the centre and scatter of the half of the rows whose covariance has the smallest determinant.
Concentration steps find it: from a start, take the half nearest by Mahalanobis distance, estimate anew, repeat. Two
deterministic starts are carried side by side and the smaller determinant wins; then one reweighting step takes all rows
within the usual distance. Documents too far from their group's centre are rejected.

A step is one aggregation: rows are counted and summed by group, start and narrow bin of distance, so what is shuffled is
a row for each of those and task, a hot source is summed where it lies, and the half is cut out of the bins, the last one
counting in part. No row is left out of the estimates and none passes through the driver.

A ridge of each statistic's own resolution is added to every scatter (regularised MCD): most documents have no symbol, no
repeated line and no repeated window at all, and the plain scatter of such a half is singular.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, read_table, written
from .fingerprint import let

#: A word, and what is not in one.
WORD, SPACE = r"[^\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Base rules: at least so many words, at most so many of a hundred words in repeated windows of so many words.
LEAST_WORDS, MOST_REPEATED, SPAN = 10, 20, 5
#: Statistics of the vector and the resolution of each: differences below it mean nothing.
RESOLUTION = {"word_length": 0.06, "symbols": 0.05, "repeated_lines": 0.15, "repeated_words": 0.12}
#: Words of five letters and characters without a symbol that every text is thought to have besides, so that the shares
#: of a short text are not taken for more than they are.
PRIOR_WORDS, PRIOR_LENGTH, PRIOR_LINES = 20, 5, 2
#: Share of a group's rows that the estimate rests on, and of normal rows that the reweighting step takes.
HALF, REWEIGHT = 0.5, 0.975
#: A row as far out as one in a million normal rows is rejected.
KEPT = 1 - 1e-6
#: Smaller groups are estimated together: those of a language, then all that are left.
LEAST_GROUP = 50
#: Concentration steps at most; they end when no determinant falls any more.
STEPS = 10
BINS = 16

X = [f"x{i}" for i in range(len(RESOLUTION))]
PAIRS = [(i, j) for i in range(len(X)) for j in range(i + 1)]
FIT = [*[f"m{i}" for i in range(len(X))], *[f"l{i}{j}" for i, j in PAIRS]]


def chi2_share(x: float, freedom: int) -> float:
    """Share of a chi-squared variable of even freedom that lies below x."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(freedom // 2))


def chi2_point(share: float, freedom: int) -> float:
    """
    >>> round(chi2_point(0.975, 4), 2)
    11.14
    """
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_share(mid, freedom) < share else (low, mid)
    return low


def consistency(share: float, freedom: int = len(RESOLUTION)) -> float:
    """The nearest share of normal rows has too small a scatter; times this it is right."""
    return share / chi2_share(chi2_point(share, freedom), freedom + 2)


def covered(hashes: Column) -> Column:
    """Places that lie in a window found twice or more; `hashes` are those of the windows in order."""

    def places(ordered: Column) -> Column:
        same = lambda j, k: F.coalesce(F.get(ordered, j)["h"] == F.get(ordered, k)["h"], F.lit(False))
        again = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
        return F.sort_array(F.transform(again, lambda j: F.get(ordered, j)["at"]))

    def length(starts: Column) -> Column:
        own = F.transform(starts, lambda a, j: F.least(F.lit(SPAN), F.coalesce(F.get(starts, j + 1) - a, F.lit(SPAN))).cast("bigint"))
        return F.aggregate(own, F.lit(0).cast("bigint"), lambda x, y: x + y)

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    return let(let(ordered, places), length)


def repeated(words: Column) -> Column:
    """Words inside windows of `SPAN` words that the text has twice or more; windows are told apart by 64-bit hashes."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - SPAN), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SPAN)]))
    found = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h)))
    return F.when(F.size(words) <= SPAN, F.lit(0).cast("bigint")).otherwise(found)


def counts(text: Column) -> list[Column]:
    """n_words, n_repeat_words, word_chars, n_symbols, n_lines (with a word) and n_dup_lines of a text; null has none."""
    text = F.coalesce(text, F.lit(""))
    words = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeated(w).alias("n_repeat_words")))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    lined = let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    return [
        words.alias("_words"), lined.alias("_lines"), F.char_length(F.translate(text, SPACE, "")).cast("bigint").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
    ]


def vector() -> list[Column]:
    """The transformed statistics: a logarithm of the mean length of words, roots of three shares."""
    share = lambda part, whole, more: F.sqrt(F.col(part) / (F.col(whole) + more))
    return [
        F.log((F.col("word_chars") + PRIOR_WORDS * PRIOR_LENGTH) / (F.col("n_words") + PRIOR_WORDS)), share("n_symbols", "word_chars", PRIOR_WORDS * PRIOR_LENGTH),
        share("n_dup_lines", "n_lines", PRIOR_LINES), share("n_repeat_words", "n_words", PRIOR_WORDS),
    ]


def measured(docs: DataFrame, keep: list[str], text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The `keep` columns of every row, its counts, base_failed, and the vector; written."""
    rows = docs.select(*keep, F.col(lang).alias("_lang"), F.col(source).alias("_source"), *counts(F.col(text)))
    rows = rows.select(*keep, "_lang", "_source", "_words.*", "_lines.*", "word_chars", "n_symbols")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return written(rows.withColumns({"base_failed": failed, **dict(zip(X, vector(), strict=True))}), "statistics")


def grouped(rows: DataFrame) -> DataFrame:
    """(_lang, _source, key) of all groups with a row that passes the base rules. Groups of less than `LEAST_GROUP` rows share
    the key of their language's small groups, and where these are too few together, one key of all such; that too may
    be too small, and then its rows have no key."""
    sizes = rows.filter(~F.col("base_failed")).groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("_n"))
    own = F.col("_n") >= LEAST_GROUP
    of_lang = F.sum(F.when(own, 0).otherwise(F.col("_n"))).over(Window.partitionBy("_lang"))
    sizes = sizes.withColumn("_level", F.when(own, 0).when(of_lang >= LEAST_GROUP, 1).otherwise(2))
    rest = sizes.filter("_level = 2").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_rest"))  # one row
    named = F.to_json(F.struct("_level", F.when(F.col("_level") < 2, F.col("_lang")).alias("lang"), F.when(F.col("_level") == 0, F.col("_source")).alias("source")))
    return sizes.crossJoin(F.broadcast(rest)).select("_lang", "_source", F.when((F.col("_level") < 2) | (F.col("_rest") >= LEAST_GROUP), named).alias("key"))


def sums(weight: Column | None = None) -> list[Column]:
    """Sums that centre and scatter are made of, over rows or over sums of rows with weights."""
    if weight is None:
        return [F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(X)], *[F.sum(F.col(X[i]) * F.col(X[j])).alias(f"q{i}{j}") for i, j in PAIRS]]
    return [F.sum(weight * F.col(c)).alias(c) for c in ("n", *[f"s{i}" for i in range(len(X))], *[f"q{i}{j}" for i, j in PAIRS])]


def estimate(summed: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Centre m, the Cholesky factor l of the scatter with its ridge, and the logarithm of its determinant."""
    out = summed.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(len(X))})
    ridge = [r * r for r in RESOLUTION.values()]
    scatter = {f"c{i}{j}": F.greatest(F.col(f"q{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}"), F.lit(0.0)) * factor + ridge[i] if i == j else (F.col(f"q{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * factor for i, j in PAIRS}
    return factored(out.withColumns(scatter), keys)


def factored(scatters: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with m and the scatter's entries c: keys, m, l, log_det."""
    for j in range(len(X)):
        for i in range(j, len(X)):
            left = F.col(f"c{i}{j}")
            for k in range(j):
                left = left - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            # The ridge keeps pivots positive; the bound only guards against rounding.
            scatters = scatters.withColumn(f"l{i}{j}", F.sqrt(F.greatest(left, F.lit(1e-9))) if i == j else left / F.col(f"l{j}{j}"))
    return scatters.withColumn("log_det", 2 * sum((F.log(f"l{i}{i}") for i in range(len(X))), F.lit(0.0))).select(*keys, *FIT, "log_det")


def distance() -> Column:
    """Squared Mahalanobis distance of a row that has its vector and a fit beside it."""
    z: list[Column] = []
    for i in range(len(X)):
        left = F.col(X[i]) - F.col(f"m{i}")
        for j in range(i):
            left = left - F.col(f"l{i}{j}") * z[j]
        z.append(left / F.col(f"l{i}{i}"))
    return sum((x * x for x in z), F.lit(0.0))


def starts(points: DataFrame) -> DataFrame:
    """Two fits a group: medians with quartile spreads; and the same with the correlations of values squashed by tanh."""
    quartiles = points.groupBy("key").agg(*[F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(f"_{x}") for x in X])
    spread = [F.greatest((F.get(f"_{x}", 2) - F.get(f"_{x}", 0)) / 1.349, F.lit(r)) for x, r in zip(X, RESOLUTION.values(), strict=True)]
    middle = written(quartiles.select("key", *[F.get(f"_{x}", 1).alias(f"m{i}") for i, x in enumerate(X)], *[s.alias(f"d{i}") for i, s in enumerate(spread)]), "medians")
    squashed = points.join(middle, "key").select("key", *[F.tanh((F.col(x) - F.col(f"m{i}")) / F.col(f"d{i}")).alias(x) for i, x in enumerate(X)])
    related = squashed.groupBy("key").agg(*sums())
    cov = lambda i, j: F.col(f"q{i}{j}") / F.col("n") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n") ** 2
    # Values that hardly vary have no correlation to speak of: 0.0001 stands in for a variance of nothing.
    related = related.select("key", *[(F.lit(1.0) if i == j else 0.99 * cov(i, j) / F.sqrt((cov(i, i) + 1e-4) * (cov(j, j) + 1e-4))).alias(f"r{i}{j}") for i, j in PAIRS])
    plain = F.array(*[F.struct(F.lit(k).alias("start"), *[(F.lit(float(i == j)) if k == 0 else F.col(f"r{i}{j}")).alias(f"r{i}{j}") for i, j in PAIRS]) for k in (0, 1)])
    both = middle.join(related, "key").withColumn("_s", F.explode(plain)).select("key", "_s.start", *[f"m{i}" for i in range(len(X))], *[(F.col(f"_s.r{i}{j}") * F.col(f"d{i}") * F.col(f"d{j}")).alias(f"c{i}{j}") for i, j in PAIRS])
    return factored(both, ["key", "start"])


def concentrated(points: DataFrame, fits: DataFrame) -> DataFrame:
    """One step: the fits of the half of each group's rows that lies nearest to the centre."""
    at = F.floor(BINS * F.log1p(distance()))
    bins = points.join(fits, "key").withColumn("bin", at).groupBy("key", "start", "bin").agg(*sums())
    whole = Window.partitionBy("key", "start")
    taken = HALF * F.sum("n").over(whole) - F.coalesce(F.sum("n").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    bins = bins.withColumn("_taken", F.least(F.lit(1.0), F.greatest(F.lit(0.0), taken / F.col("n"))))
    return estimate(bins.groupBy("key", "start").agg(*sums(F.col("_taken"))), ["key", "start"], consistency(HALF))


def fit(points: DataFrame) -> DataFrame:
    """(key, centre, scatter) by minimum covariance determinant; `points` has key and the vector and is read several times."""
    fits = written(starts(points), "fits")
    best = None
    for _ in range(STEPS):
        fits = written(concentrated(points, fits), "fits")
        total = fits.agg(F.sum("log_det")).first()[0]  # one number
        if total is None or best is not None and best - total <= 1e-3:
            break
        best = total
    chosen = fits.groupBy("key").agg(F.min_by(F.struct(*FIT), F.struct("log_det", "start")).alias("_f")).select("key", "_f.*")
    near = points.join(chosen, "key").filter(distance() <= chi2_point(REWEIGHT, len(X))).groupBy("key").agg(*sums())
    return written(estimate(near, ["key"], consistency(REWEIGHT)).drop("log_det"), "fits")


def judge(docs: DataFrame, keep: list[str], text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The `keep` columns of every row of `docs` with its counts, base_failed, distance (squared, from its group's centre; null
    where base rules reject it or no group is large enough) and kept.

    Null and empty texts have no words, so the base rules reject them. A null language or source is a value of its own;
    groups below `LEAST_GROUP` rows are judged with their language's other small groups, else with all such, else by the
    base rules alone. Repeated rows get equal verdicts. Names among `keep` that clash with added ones must be renamed
    before; other columns do not matter. An empty table gives an empty result.
    """
    rows = measured(docs, keep, text, lang, source)
    groups = written(grouped(rows), "groups")
    same = lambda a, b: a["_lang"].eqNullSafe(b["_lang"]) & a["_source"].eqNullSafe(b["_source"])
    joined = rows.join(groups, same(rows, groups), "left").drop(groups["_lang"]).drop(groups["_source"])
    points = written(joined.filter(~F.col("base_failed") & F.col("key").isNotNull()).select("key", *X), "points")
    fits = fit(points)
    told = joined.withColumn("key", F.when(~F.col("base_failed"), F.col("key"))).join(fits, "key", "left").withColumn("distance", distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi2_point(KEPT, len(X)), F.lit(True))
    return told.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")


def keep_usual(docs: DataFrame) -> DataFrame:
    """The rows that the rules keep, with all their columns as they are."""
    plain, names = numbered(docs)
    own = list(names.values())
    told = judge(plain, own, names["text"], names["lang"], names["source"]).filter("kept")
    return told.select(*[F.col(n).alias(c) for c, n in names.items()])


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document."""
    return judge(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), ["doc_id"])
