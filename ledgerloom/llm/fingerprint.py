"""Document fingerprints by Order MinHash, with SQL functions only.

A text is cut into short tokens; a k-mer is `K` tokens in a row, and it is numbered by its earlier occurrences in the
text, so that repeats count. Each of `SIZE` hash orders selects the `TUPLE` smallest numbered k-mers; these are put back
in their text order and hashed together. Two texts agree in an entry when they share the selected k-mers and have them
in the same order, which falls with edit distance and not only with the overlap of sets.

The hash orders are rotations of one hash: order j compares (h - c_j) modulo 2^64 with the c_j evenly spaced. The smallest
k-mers under it are thus the ones that follow c_j on the ring of sorted hashes, so one sort of a text's k-mers serves
all orders, and nothing is exploded or shuffled: every step works on an array of 64-bit numbers inside the row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table

#: Tokens: up to four characters that are not white space, with the white space before them.
TOKEN = r"(?s)\s*\S{1,4}|\s+\z"
K, TUPLE, SIZE = 3, 2, 64
#: The low bits of a number hold the k-mer's place in the text, the 36 bits above them its hash. An array of more places
#: than that (2 GB of numbers) is more than a row of Spark can hold.
PLACE_BITS = 28
PLACES = (1 << PLACE_BITS) - 1
#: Ranges of ids that the order of documents is cut into, for each shuffle partition.
RANGES_PER_PARTITION = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with `value` evaluated once although the body names it inside lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def _hash_of(x: Column) -> Column:
    return F.shiftrightunsigned(x, PLACE_BITS)


def _place_of(x: Column) -> Column:
    return x.bitwiseAND(F.lit(PLACES))


def _bits(h: Column) -> Column:
    """The upper bits of a hash, the place bits cleared."""
    return h.bitwiseAND(F.lit(~PLACES))


def kmers(text: Column) -> Column:
    """Hash and place of each numbered k-mer, as one number each, in the order of their hashes.

    A text of fewer than K tokens has one k-mer, which is all of it; so has an empty or null text.
    """

    def hashed(tokens: Column) -> Column:
        last = F.greatest(F.size(tokens) - K, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: _bits(F.xxhash64(*[F.get(tokens, i + k) for k in range(K)])))

    def placed(hashes: Column) -> Column:
        return F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseOR(F.least(i, F.lit(PLACES - 1)).cast("bigint"))))

    def numbered(found: Column) -> Column:
        """Repeats of a k-mer stand together, by place. Each after the first gets a hash from its number among them."""
        n = F.size(found)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (_hash_of(F.get(found, i)) != _hash_of(F.get(found, i - 1))))
        number = let(starts, lambda s: F.flatten(F.transform(s, lambda a, j: F.sequence(F.lit(0), F.coalesce(F.get(s, j + 1), n) - a - 1))))
        again = let(number, lambda no: F.transform(found, lambda x, i: F.when(F.get(no, i) == 0, x).otherwise(_bits(F.xxhash64(_hash_of(x), F.get(no, i))).bitwiseOR(_place_of(x)))))
        return F.sort_array(again)

    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return let(
        let(tokens, hashed),
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), placed(h)).otherwise(let(placed(h), numbered)),
    )


def signature(text: Column) -> Column:
    """`SIZE` numbers of 24 bits. Equal texts have equal signatures."""
    # A mark for each order stands in the ring at c_j; its place bits are all set, which no k-mer's are.
    marks = F.array(*[F.lit((j * 2**64 // SIZE - 2**63) | PLACES).cast("bigint") for j in range(SIZE)])

    def entries(ring: Column) -> Column:
        n = F.size(ring)

        def one(mark_at: Column, j: Column) -> Column:
            first, second = F.get(ring, (mark_at - j) % n), F.get(ring, (mark_at - j + 1) % n)
            ordered = F.when(_place_of(first) <= _place_of(second), F.xxhash64(_hash_of(first), _hash_of(second))).otherwise(F.xxhash64(_hash_of(second), _hash_of(first)))
            return ordered.bitwiseAND(F.lit(0xFFFFFF)).cast("int")

        def at(both: Column) -> Column:
            return F.filter(F.sequence(F.lit(0), F.size(both) - 1), lambda i: _place_of(F.get(both, i)) == PLACES)

        return F.transform(let(F.sort_array(F.concat(ring, marks)), at), one)

    return let(kmers(text), entries)


def spelled(entries: Column) -> Column:
    """A signature as text: six hexadecimal digits an entry."""
    return F.array_join(F.transform(entries, lambda e: F.lpad(F.lower(F.hex(e)), 6, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries, 0 to 1."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(SIZE))


def fingerprint(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Adds fingerprint (text) to every row; nulls count as empty, and a column of that name is replaced."""
    return docs.withColumn("fingerprint", spelled(signature(F.col(text_column))))


def with_next(docs: DataFrame, with_value: Callable[[DataFrame], DataFrame], ranges: int | None = None) -> DataFrame:
    """Rows (doc_id, text) in ascending order of (doc_id, text), each with next_text, passed through `with_value` to add
    a column value, and then with next_value of the following row too. The last row is followed by the first.

    No task orders all rows: ids are cut at quantiles into ranges, and the first row of each range is set once more, as
    a guard, behind the range before it.
    """
    spark = docs.sparkSession
    ranges = ranges or RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    lowest = -(2**63)
    docs = docs.select(F.coalesce("doc_id", F.lit(lowest)).alias("_key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = docs.agg(F.percentile_approx("_key", [i / ranges for i in range(1, ranges)] or [0.5], 100 * ranges)).first()[0]
    cuts = F.array(*[F.lit(c).cast("bigint") for c in sorted(set(cuts or []))])
    docs = docs.withColumn("_range", F.size(F.filter(cuts, lambda c: c <= F.col("_key"))))
    firsts = docs.groupBy("_range").agg(F.min("_key").alias("_key"))  # a row for each range
    whole = Window.orderBy("_range")
    before = F.coalesce(F.lag("_range").over(whole), F.max("_range").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    firsts = firsts.withColumn("_before", before)
    one = F.row_number().over(Window.partitionBy("_range").orderBy("text"))
    guards = docs.join(F.broadcast(firsts), ["_range", "_key"]).withColumn("_one", one).filter(F.col("_one") == 1)
    guards = guards.select("_key", "doc_id", "text", F.col("_before").alias("_range"), F.lit(True).alias("_guard"))
    order = Window.partitionBy("_range").orderBy("_guard", "_key", "text")
    both = docs.withColumn("_guard", F.lit(False)).unionByName(guards).withColumn("next_text", F.lead("text").over(order))
    both = with_value(both).withColumn("next_value", F.lead("value").over(order))
    return both.filter(~F.col("_guard")).drop("_guard", "_key", "_range")


def compare_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text: the last half (rounded down) of its code points is
    replaced by the first as many of the next document in order of id.

    Null texts count as empty and stay empty when edited; a lone document is its own next. Rows of equal id are ordered
    by text, repeated rows are kept, other columns are left out, an empty table gives an empty result.
    """
    joined = with_next(docs, lambda d: d.withColumn("value", signature(F.col("text"))))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    joined = joined.withColumn("_edited", F.concat(F.left("text", n - half), F.left("next_text", half)))
    joined = joined.withColumn("_value", signature(F.col("_edited")))
    return joined.select(
        "doc_id", n.cast("bigint").alias("n_chars"), F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), spelled(F.col("value")).alias("fingerprint"), spelled(F.col("_value")).alias("edited_fingerprint"),
        likeness(F.col("value"), F.col("_value")).alias("near_edited"), likeness(F.col("value"), F.col("next_value")).alias("near_next"),
    )


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document beside that of its edited text."""
    return compare_edits(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
