"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join that removes false positives.

Only DataFrame functions run on the main path; the filter itself is built by an aggregation over the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, written

#: One block is one 64-bit word: a probe touches one word, whatever the number of bits set in it.
BITS_PER_KEY_SET = 4
#: Words of filter for each rule (64 bits for four set bits: under one false hit in a thousand).
WORDS_PER_RULE = 1
#: The filter travels with every task, so it has at most so many words (8 MB). A longer list of rules fills the words
#: more, and more false hits go on to the exact join; the results stay.
MOST_WORDS = 1 << 20
#: A side of a join is broadcast up to so many rows and bytes of text, else both sides are shuffled.
MOST_BROADCAST_ROWS, MOST_BROADCAST_BYTES = 200_000, 32 << 20
#: Parts that a url which very many pages share is dealt over, where verdicts come back by a shuffle.
SALTS = 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or if null."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://` or if null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words)).cast("int")


def _mask(key: Column) -> Column:
    """The bits of a key in its word: four six-bit pieces of a second hash."""
    h = F.xxhash64(key, F.lit(1))
    bits = [
        F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
        for i in range(BITS_PER_KEY_SET)
    ]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return mask


def blocked_bloom(rules: DataFrame, words: int) -> Column:
    """The filter as a constant array of `words` 64-bit words. Its size is fixed by `words`, not by the data."""
    parts = rules.groupBy(_word(F.col("rule"), words).alias("word")).agg(F.bit_or(_mask(F.col("rule"))).alias("bits"))
    table = [0] * words
    for word, bits in parts.collect():  # at most `words` rows
        table[word] = bits
    return F.array(*[F.lit(b).cast("bigint") for b in table]) if words <= 64 else F.from_json(F.lit(str(table)), "array<bigint>")


def _small(rows: DataFrame, *texts: str) -> bool:
    """Whether the rows, with these columns of text, are small enough to be broadcast."""
    size = F.coalesce(F.sum(sum((F.octet_length(c) for c in texts), F.lit(0)).cast("bigint")), F.lit(0))
    n, length = rows.agg(F.count(F.lit(1)), size).first()
    return n <= MOST_BROADCAST_ROWS and length <= MOST_BROADCAST_BYTES


def judge(pages: DataFrame, rules: DataFrame, url_column: str = "url", default: str = "allow", most_words: int = MOST_WORDS, broadcast: bool | None = None) -> DataFrame:
    """Adds host, path, rule and verdict to every page.

    `rules` holds (host, path, verdict). A rule fits its host and all its subdomains if the url's path starts with
    the rule's path; the longest host and path together wins, a tie goes to the longer host, and a rule listed with both
    verdicts blocks. A page without a fitting rule gets a null rule and the `default` verdict. Null urls, urls without a
    scheme and empty tables are no special case: their host and path are empty, which no rule fits. Rules without a host
    fit nothing, a null path is the empty one. Repeated pages each keep their row; columns of `pages` named like the four
    results are replaced, all others stay.

    Candidate keys of a url are its host suffixes times the prefixes of its path of lengths that some rule has. They are
    tested against the blocked Bloom filter inside the row. Only urls with a possible hit go on, each distinct one once:
    they are exploded, joined exactly with the rules, and their verdicts are joined back by the url. Pages without a
    possible hit never leave their task. `broadcast` forces the joins one way; by itself it depends on checked sizes.
    """
    path = F.coalesce("path", F.lit(""))
    listed = rules.filter(F.col("host") != "").select(
        F.concat("host", path).alias("rule"), F.length("host").alias("rule_host"), F.length(path).alias("rule_path"), (F.col("verdict") == "block").cast("int").alias("blocks")
    )
    listed = written(listed.groupBy("rule", "rule_host", "rule_path").agg(F.max("blocks").alias("blocks")), "rules")
    n_rules = listed.count()
    # Every length: k distinct ones take rules of k^2 / 2 characters together, so the list stays short.
    lengths = [r[0] for r in listed.select("rule_path").distinct().orderBy("rule_path").collect()]

    base = pages.withColumns({"host": host_of(F.col(url_column)), "path": path_of(F.col(url_column))}).drop("rule", "verdict")
    if not n_rules:
        return base.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    listed_lengths = F.array(*[F.lit(n) for n in lengths]) if len(lengths) <= 64 else F.from_json(F.lit(str(lengths)), "array<int>")
    prefixes = F.filter(listed_lengths, lambda n: n <= F.length("path"))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda n: F.struct(F.concat(s, F.substring(F.col("path"), F.lit(1), n)).alias("rule"), F.length(s).alias("rule_host")))))
    words = 1
    while words < min(n_rules * WORDS_PER_RULE, most_words):
        words *= 2
    table = blocked_bloom(listed, words)
    keys = F.filter(keys, lambda k: F.element_at(table, _word(k["rule"], words) + 1).bitwiseAND(_mask(k["rule"])) == _mask(k["rule"]))
    possible = F.coalesce(F.when(F.col("host") != "", F.size(keys) > 0), F.lit(False))

    urls = base.filter(possible).select("host", "path").distinct()
    hits = urls.select("host", "path", F.inline(keys))
    few = _small(listed, "rule") if broadcast is None else broadcast
    best = F.max(F.struct(F.length("rule").alias("length"), "rule_host", "blocks", "rule")).alias("_best")
    winners = written(hits.join(F.broadcast(listed) if few else listed.hint("shuffle_hash"), ["rule", "rule_host"]).groupBy("host", "path").agg(best), "winners")
    verdict = F.when(F.col("_best.blocks") == 1, "block").when(F.col("_best").isNotNull(), "allow").otherwise(default)
    found = {"rule": F.col("_best.rule"), "verdict": verdict}
    if _small(winners, "host", "path", "_best.rule") if broadcast is None else broadcast:
        return base.join(F.broadcast(winners), ["host", "path"], "left").select(*base.columns, "_best").withColumns(found).drop("_best")
    spread = [F.col(c) for c, kind in base.dtypes if "map<" not in kind and "variant" not in kind]
    salted = base.filter(possible).withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    winners = winners.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # Spark sizes the winners by their file, before they are spread, and would broadcast them: the hint has both sides shuffled.
    judged = salted.join(winners.hint("merge"), ["host", "path", "_salt"], "left").select(*base.columns, "_best")
    rest = base.filter(~possible).select(*base.columns, F.lit(None).cast(winners.schema["_best"].dataType).alias("_best"))
    return judged.unionByName(rest).withColumns(found).drop("_best")


#: The rules of the contract (fixed values).
CONTRACT_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the host and path of its url, and the longest of CONTRACT_RULES that fits it."""
    values = ", ".join(str(r) for r in CONTRACT_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS r(host, path, verdict)")
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM p
), r(rhost, rpath, rverdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), u AS (
  SELECT DISTINCT host, path FROM h
), m AS (
  SELECT host, path, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(rverdict, length(rhost || rpath)) AS verdict
  FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path
)
SELECT page_id, h.host, h.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM h LEFT JOIN m ON h.host = m.host AND h.path = m.path
"""
