"""Spelling variants by anagram hashing.

A word's anagram key is the sum of its letters' fifth powers. Words that differ by one letter have keys that differ by one
letter's value (added or removed) or by the difference of two (exchanged), so taking one letter's value off a key brings
both words of an exchange to the same number, and the longer word of an addition to the shorter one's key. Words meet by
an equality join on these numbers; that the other letters stand in the same order is verified afterwards.

Many words have nearly the same letters in another order. One of two near words' halves is always the same in both, so the
join also asks for an equal half, and takes off only letters of the other half: a bucket then holds the words that share
half of their letters in order and all but one of the others, and no bucket grows with the number of anagrams.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, small_batches, written
from .fingerprint import let

#: Words have at least so many letters and occur at least so often; a form is at least so many times as frequent.
LEAST_LETTERS, LEAST_COUNT, TIMES = 6, 5, 5
POWER = 5
#: Keys are sums modulo a prime, so that they fit into 64 bits however long a word is.
PRIME = 2**61 - 1
#: Distinct words that a task holds before it hands their counts on.
HELD_WORDS = 100_000
LETTERS = "a-zÀ-ÿ"


def counted(docs: DataFrame, least: int = LEAST_LETTERS, change: Callable[[str, str], str] | None = None) -> DataFrame:
    """(word, n): the maximal runs of Latin letters of all texts, A-Z in lower case, with their number. `change(doc_id, word)`
    may rewrite a word; those below `least` letters are left out.

    Each text is counted by itself, each task adds up what its texts have, and only sums are shuffled. Null texts have no
    words, a null id is the empty text to `change`; repeated rows count each; an empty table has no words.
    """
    small_batches(docs.sparkSession)
    runs = re.compile(f"[{LETTERS}]{{{least},}}")  # a run that is long enough is found from its first letter to its last

    def rows(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterable[pa.RecordBatch]):
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in itertools.chain.from_iterable(zip(*[c.to_pylist() for c in batch.slice(i, 64).columns], strict=True) for i in range(0, batch.num_rows, 64)):
                # bytes.lower() changes A-Z alone.
                found = Counter(runs.findall((text or "").encode().lower().decode()))
                if change is not None:
                    for word, n in found.items():
                        new = change(doc_id or "", word)
                        if len(new) >= least:
                            total[new] += n
                else:
                    total.update(found)
                if len(total) > HELD_WORDS:
                    yield rows(total)
                    total = Counter()
        yield rows(total)

    narrow = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text"))
    return narrow.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def powers(text: Column) -> Column:
    """The values of a text's letters."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.pow(F.ascii(c), F.lit(POWER)).cast("bigint"))


def key_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, p: (a + p) % PRIME)


def _half(text: Column, start: Column, length: Column) -> Column:
    return F.substr(text, start + 1, length)


def sockets(words: DataFrame) -> DataFrame:
    """(socket, role, word, n): two near words have a socket in common, as parts of an exchange (role 0 and 0) or as the
    longer and the shorter one of a removal (1 and 2)."""
    w, n = F.col("word"), F.char_length("word")
    # Cut of an exchange and of the shorter word, and of the longer word of a removal; the kept half, then the rest.
    plain = {"before": (F.lit(0), F.floor(n / 2).cast("int")), "after": (F.floor(n / 2).cast("int"), n - F.floor(n / 2).cast("int"))}
    cut = F.floor((n - 1) / 2).cast("int")
    longer = {"before": (F.lit(0), cut), "after": (cut + 1, n - cut - 1)}
    rest = {"before": (plain["before"][1], n), "after": (F.lit(0), plain["before"][1])}
    longer_rest = {"before": (cut, n), "after": (F.lit(0), cut + 1)}

    def off(role: int, name: str, half: tuple, others: tuple) -> Column:
        """A socket for each distinct letter of the rest."""
        values = F.array_distinct(powers(_half(w, *others)))
        length = n - 1 if role else n
        return F.transform(values, lambda p: F.struct(F.xxhash64(F.lit(role > 0), F.lit(name), length, F.pmod(F.col("_key") - p, F.lit(PRIME)), _half(w, *half)).alias("socket"), F.lit(role).alias("role"), F.lit(name == "after").alias("after")))

    def whole(name: str) -> Column:
        return F.array(F.struct(F.xxhash64(F.lit(True), F.lit(name), n, F.col("_key"), _half(w, *plain[name])).alias("socket"), F.lit(2).alias("role"), F.lit(name == "after").alias("after")))

    every = F.concat(*[x for name in ("before", "after") for x in (off(0, name, plain[name], rest[name]), off(1, name, longer[name], longer_rest[name]), whole(name))])
    return words.withColumn("_key", key_of(powers(w))).select("word", "n", F.explode(every).alias("_s")).select("_s.*", "word", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n), each pair both ways: words of `words` (word, n; distinct) that differ by exactly one inserted,
    deleted or replaced letter. Empty for an empty table; words of one letter or none are held like all others."""
    found = sockets(words)
    right = found.select("socket", F.col("role").alias("role2"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    exchange = (F.col("role") == 0) & (F.col("role2") == 0) & (F.col("word") < F.col("other"))
    removal = (F.col("role") == 1) & (F.col("role2") == 2)
    # A letter beside its equal can be removed in either half; the first half then counts.
    cut = F.floor((F.char_length("word") - 1) / 2).cast("int")
    again = removal & F.col("after") & (F.left("word", cut) == F.left("other", cut))
    # Spark sizes the sockets by the words, of which each has some twenty, and would broadcast them: the hint keeps them apart.
    pairs = found.filter("role < 2").join(right.filter("role2 <> 1").hint("merge"), "socket").filter((exchange | removal) & ~again & (F.levenshtein("word", "other", 1) == 1))
    both = F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    return pairs.select(F.explode(both).alias("_p")).select("_p.*")


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """Each word's form, root, and its number of near words.

    The form is the near word of largest n (ties: the smallest), if that n is at least `times` the word's; following
    forms to the last gives the root. Forms gain in n at every step, so there are no circles and chains are short; steps
    are doubled in each round. `words` (word, n; distinct) is read several times. No join is broadcast by a guessed size.
    """
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("_n"), "other")).alias("_best"))
    rows = words.join(near, "word", "left").withColumn("_on", -F.col("_best._n") >= times * F.col("n"))
    rows = written(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("_on"), F.col("_best.other")).alias("form"), F.when(F.col("_on"), -F.col("_best._n")).alias("form_n")), "forms")
    # Only words with a form move on; a root is where no form is left.
    steps = rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("_to"))
        moved = written(steps.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("_moved")), "roots")
        steps = moved.select("word", "root")
        if moved.filter("_moved").isEmpty():
            break
    return rows.join(steps.hint("merge"), "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")


def misspell(doc_id: str, word: str) -> str:
    """Deletes a letter of one in 199 words of a document, always the same ones."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % 199:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def op11_anagram_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and roots of all frequent words of all documents, some of them misspelt on purpose."""
    words = counted(read_table(spark, sf_dir, "documents").select("doc_id", "text"), LEAST_LETTERS, misspell)
    return variants(written(words.filter(F.col("n") >= LEAST_COUNT), "words"))
