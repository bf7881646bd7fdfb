"""LM scoring by context-tree weighting over bytes.

A text is its words (between ASCII white space, A-Z lower-cased) with a space between two, and then one end. The model
predicts each byte of that line and its end, bit by bit, from the `DEPTH` bytes before it, across words; before the first
byte of a text lies the end of another. Each context of each depth, at each of the 255 nodes of the binary decomposition of
a byte, has a Krichevsky-Trofimov estimate; the weighted probability of a context is half its own block probability and
half the product of those of its children.

Block probabilities depend on counts alone, so the tree is built from the table of (longest context, next byte, count)
that Spark aggregates over the whole corpus. Below its three nearest bytes a subtree is complete in itself, so tasks go
through pairs in order of these; what is above them has at most 65,536 contexts, and those of one byte or none, at most
257, are mixed on the driver. The result is a table of the log probability of every pair of context and byte that any text
has. Frequent pairs are looked up inside the scan of the documents, the others through a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_pieces, map_texts, read_table, remainder, small_batches, texts_of, written

#: Bytes of the longest context: 3 to 6, as a pair of context and byte is one 64-bit number.
DEPTH = 6
END = 0xFF  # in no UTF-8 text
#: Words and pairs that the scan of the documents looks up itself, at most; those beyond go through joins.
HEAD, MOST_PAIRS = 300_000, 1 << 21
#: Distinct words and pairs that a task counts before it hands the counts on, and positions between two counts of pairs.
FLUSH, FLUSH_PAIRS, POSITIONS = 250_000, 3_000_000, 3_000_000
#: Pairs that are gone through at once, and parts of the pairs that end in the same two bytes.
CHUNK, PARTS = 300_000, 16
_LN2, _LN10 = np.log(2), np.log(10)


def line_of(text: str) -> bytes:
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split())


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5, by Stirling's series from 8 on."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    z = x.copy()
    for _ in range(8):
        low = z < 8
        shift = np.where(low, shift - np.log(z), shift)
        z = np.where(low, z + 1, z)
    r = 1 / (z * z)
    return shift + (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / z


#: log Gamma at k + 1/2 and at k + 1 of the counts k that nearly all contexts have.
_HALVES, _WHOLES = (log_gamma(np.arange(1 << 12) + x) for x in (0.5, 1.0))


def _log_gamma_at(count: np.ndarray, table: np.ndarray, add: float) -> np.ndarray:
    """log Gamma of whole numbers plus `add`."""
    out = table[np.minimum(count, len(table) - 1).astype(np.int64)]
    large = np.flatnonzero(count >= len(table))
    out[large] = log_gamma(count[large] + add)
    return out


def log_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _log_gamma_at(a, _HALVES, 0.5) + _log_gamma_at(b, _HALVES, 0.5) - _log_gamma_at(a + b, _WHOLES, 1.0) - np.log(np.pi)


def pairs_in(lines: Sequence[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(pair of context and next byte for every byte and end, number of them per line).

    A pair is one number: the next byte in the low 8 bits, above it the context with the nearest byte lowest.
    """
    gap, width = bytes([END]) * depth, 8
    line = bytes([END]) * (width - 1) + b"".join([x + gap for x in lines])
    n = np.fromiter((len(x) + 1 for x in lines), np.int64, len(lines))
    # The eight bytes up to each position are one number; that of a position holds its context, nearest byte lowest.
    every = np.ndarray(max(0, len(line) - width + 1), ">i8", line, strides=(1,))
    wanted = np.ones(len(every), bool)
    after = np.cumsum(n + depth - 1) - (depth - 1)
    wanted[after[:, None] + np.arange(depth - 1)] = False
    return every[wanted].astype(np.int64) & ((np.int64(1) << (8 * depth + 8)) - 1), n


def vocabulary(docs: DataFrame, train: Column) -> DataFrame:
    """(token, c, m): each distinct word and the end (an empty token), its count in the training documents and in all."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        learnt, rest = Counter(), Counter()

        def rows() -> pd.DataFrame:
            both = learnt + rest
            out = pd.DataFrame({"token": list(both), "c": [learnt[t] for t in both], "m": list(both.values())})
            learnt.clear(), rest.clear()
            return out

        for batch in in_pieces(batches):
            for text, learn in zip(texts_of(batch), batch["_train"], strict=True):
                into = learnt if learn else rest
                into.update(line_of(text).split())
                into[b""] += 1
            if len(learnt) + len(rest) > FLUSH:
                yield rows()
        yield rows()

    parts = docs.select("text", F.coalesce(train, F.lit(False)).alias("_train")).mapInPandas(run, "token binary, c bigint, m bigint")
    return parts.groupBy("token").agg(F.sum("c").alias("c"), F.sum("m").alias("m"))


def pairs_of(docs: DataFrame, train: Column, depth: int = DEPTH) -> DataFrame:
    """(pair, n) for every pair that any text has; n counts training texts alone, and is 0 where only other texts have it."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        new: list[list[np.ndarray]] = [[], []]
        waiting = 0

        def counted() -> tuple[np.ndarray, np.ndarray]:
            keys, counts = np.unique(np.concatenate([pair[:0], *new[1]]), return_counts=True)
            others = np.unique(np.concatenate([pair[:0], *new[0]]))
            new[0].clear(), new[1].clear()
            return _merged([pair, keys, others], [n, counts, np.zeros(len(others), np.int64)])

        for batch in in_pieces(batches):
            lines, learn = [line_of(t) for t in texts_of(batch)], batch["_train"].to_numpy(bool)
            for kind in (0, 1):
                found = pairs_in([x for x, flag in zip(lines, learn, strict=True) if flag == kind], depth)[0]
                new[kind].append(found)
                waiting += len(found)
            if waiting > POSITIONS:
                (pair, n), waiting = counted(), 0
                if len(pair) > FLUSH_PAIRS:
                    yield pd.DataFrame({"pair": pair, "n": n})
                    pair, n = pair[:0], n[:0]
        pair, n = counted()
        yield pd.DataFrame({"pair": pair, "n": n})

    parts = docs.select("text", F.coalesce(train, F.lit(False)).alias("_train")).mapInPandas(run, "pair bigint, n bigint")
    return parts.groupBy("pair").agg(F.sum("n").alias("n"))


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    key, at = np.unique(key, return_inverse=True)
    return key, *(np.bincount(at, v, len(key)) for v in values)


def _parent(key: np.ndarray, depth: int) -> np.ndarray:
    """The (context, node) key with the context cut to its `depth` nearest bytes."""
    return (((key >> 8) & ((np.int64(1) << (8 * depth)) - 1)) << 8) | (key & 255)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted arrays of distinct keys as one, with the sums of their counts; a stable sort only merges what is sorted."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else order
    return key[first], np.add.reduceat(n, first) if len(key) else n


class Level:
    """Contexts of one length at the nodes that their pairs have reached, from pairs of which those of one context lie together
    in order of the next byte. `of` gives the place of each pair's node at each of its eight steps; `first` is a pair of each node."""

    def __init__(self, pair: np.ndarray, n: np.ndarray):
        self.pair, self.n, size = pair, n, len(pair)
        self.of, firsts, a, b = np.zeros((8, size), np.int32), [], [], []
        total = 0
        for step in range(8):
            new = np.ones(size, bool)
            np.not_equal(pair[1:] >> (step + 1), pair[:-1] >> (step + 1), out=new[1:])
            first = np.flatnonzero(new)
            ones = np.add.reduceat(n * ((pair >> step) & 1), first) if size else n
            firsts.append(first)
            b.append(ones)
            a.append((np.add.reduceat(n, first) if size else n) - ones)
            self.of[step] = np.cumsum(new, dtype=np.int32) + (total - 1)
            total += len(first)
        self.first, self.a, self.b = np.concatenate(firsts), np.concatenate(a).astype(np.float64), np.concatenate(b).astype(np.float64)
        self.step = np.repeat(np.arange(8), [len(x) for x in firsts])

    def key(self) -> np.ndarray:
        """(context, node) of each node as one number."""
        pair = self.pair[self.first]
        return (pair >> 8 << 8) | (((pair & 255) | 256) >> (self.step + 1))

    def shorter(self, depth: int) -> tuple[Level, np.ndarray]:
        """The level of the `depth` nearest bytes, and the place there of each node here."""
        pair, at = np.unique(self.pair & ((np.int64(1) << (8 * depth + 8)) - 1), return_inverse=True)
        above = Level(pair, np.bincount(at, self.n, len(pair)).astype(np.int64))
        return above, above.of[self.step, at[self.first]]


class Subtree:
    """All contexts that end in the same bytes, from length 3 to the longest: counts, weighted probabilities and predictions
    by (context, node). Any number of whole subtrees can be gone through together."""

    def __init__(self, pair: np.ndarray, n: np.ndarray, depth: int):
        self.longest = level = Level(pair, n)
        weighted = log_block(level.a, level.b)
        #: From the longest on: a, b, share and the places of nodes in the next. A longest context has no children: its estimate is all there is.
        self.levels, share = [], np.ones(len(level.a))
        for d in range(depth - 1, 1, -1):
            above, at = level.shorter(d)
            self.levels.append({"a": level.a, "b": level.b, "share": share, "at": at})
            children = np.bincount(at, weighted, len(above.a))
            if d == 2:
                self.rest = (above.key(), above.a, above.b, children)  # what the contexts of two bytes get from here
            else:
                up = weighed(np.zeros(0), above.a, above.b, children)
                weighted, share = up["weighted"], up["share"]
            level = above

    def descend(self, above: dict[str, np.ndarray]) -> np.ndarray:
        """The final prediction of a set bit at each node of the longest contexts, given those of two bytes by sorted key."""
        at = np.searchsorted(above["key"], self.rest[0])
        above = {c: above[c][at] for c in ("next_fixed", "next_times", "one")}
        for level in reversed(self.levels):
            above = mixed(level, *(above[c][level["at"]] for c in ("next_fixed", "next_times", "one")))
        return above["one"]

    def log_of_pairs(self, above: dict[str, np.ndarray]) -> np.ndarray:
        """The natural log probability of each pair's next byte."""
        one, pair = self.descend(above), self.longest.pair
        p = np.ones(len(pair))  # of eight bits, each of 1e-20 at least: far from the least float
        for step in range(8):
            bit = one[self.longest.of[step]]
            p *= np.where((pair >> step) & 1 == 1, bit, 1 - bit)
        return np.log(p)


def weighed(key: np.ndarray, a: np.ndarray, b: np.ndarray, children: np.ndarray) -> dict[str, np.ndarray]:
    """Contexts with the summed log probabilities of their children: own weighted probability, and the share of their own
    estimate in the mix."""
    block = log_block(a, b)
    share = 1 / (1 + np.exp(np.clip(children - block, -700, 700)))
    return {"key": key, "a": a, "b": b, "weighted": np.logaddexp(block, children) - _LN2, "share": share}


def below(level: dict[str, np.ndarray], parent_key: np.ndarray, above: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    at = np.searchsorted(above["key"], parent_key)
    return mixed(level, above["next_fixed"][at], above["next_times"][at], above["one"][at])


def mixed(level: dict[str, np.ndarray], fixed: np.ndarray, times: np.ndarray, one: np.ndarray) -> dict[str, np.ndarray]:
    """The prediction `one` at each context, and how those of its children enter it.

    What is predicted at the root is linear in the prediction of a context: so much (`fixed`) plus so much times (`times`)
    that. Where a context has not seen a node, the prediction of the context above it holds.
    """
    n = level["a"] + level["b"]
    estimate = (level["b"] + 0.5) / (n + 1)
    return {
        "one": np.where(n > 0, fixed + times * estimate, one),
        "next_fixed": fixed + times * level["share"] * estimate, "next_times": times * (1 - level["share"]),
    }


def crown_of(rows: pd.DataFrame) -> dict[str, np.ndarray]:
    """The contexts of one byte, mixed with the one of none, on the driver: at most 256 contexts of 255 nodes."""
    rows = rows.sort_values("key")
    one = weighed(rows["key"].to_numpy(np.int64), *(rows[c].to_numpy(np.float64) for c in ("a", "b", "children")))
    none = weighed(*_summed(one["key"] & 255, one["a"], one["b"], one["weighted"]))
    size = len(none["key"])
    none |= mixed(none, np.zeros(size), np.ones(size), np.full(size, 0.5))
    return one | below(one, one["key"] & 255, none)


def _in_order(pairs: DataFrame, *more: DataFrame) -> DataFrame:
    """Pairs, and rows that go before the pairs of the same two bytes, in order of the three nearest bytes; pairs with the same
    three are in one task, and those with the same two in `PARTS` at most."""
    three = F.expr("shiftright(pair, 8) & 16777215")
    rows = pairs.withColumns({"_two": F.expr("shiftright(pair, 8) & 65535"), "_part": F.pmod(F.xxhash64(three), F.lit(PARTS)).cast("int"), "_three": three})
    for d in more:
        every = d.withColumns({"_two": F.expr("shiftright(pair, 8) & 65535"), "_part": F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))), "_three": F.lit(-1).cast("bigint")})
        rows = rows.unionByName(every, allowMissingColumns=True)
    return rows.repartition("_two", "_part").sortWithinPartitions("_two", "_three", "pair").drop("_part")


def _whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a task in pieces of about CHUNK that never part rows of the same three bytes."""
    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= CHUNK:
            rows = pd.concat(held, ignore_index=True)
            cut = int(np.searchsorted((rows["_two"] * (1 << 25) + rows["_three"] + 1).to_numpy(), int(rows["_two"].iloc[-1]) * (1 << 25) + int(rows["_three"].iloc[-1]) + 1))
            if cut:
                yield rows.iloc[:cut]
            held, size = [rows.iloc[cut:]], len(rows) - cut
    if size:
        yield pd.concat(held, ignore_index=True)


def predicted(pairs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(pair, n, lp): the natural log probability of each next byte in its longest context. `pairs` is read twice; give it
    written."""

    def up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_groups(batches):
            key, a, b, children = Subtree(rows["pair"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), depth).rest
            yield pd.DataFrame({"key": key, "a": a, "b": b, "children": children})

    sums_of = [F.sum(c).alias(c) for c in ("a", "b", "children")]
    kind = "key bigint, a double, b double, children double"
    two = written(_in_order(pairs).mapInPandas(up, kind).groupBy("key").agg(*sums_of).withColumn("_one", F.expr("shiftright(key, 8) & 255")), "two")

    def level_of(rows: pd.DataFrame) -> dict[str, np.ndarray]:
        rows = rows.sort_values("key")
        return weighed(rows["key"].to_numpy(np.int64), *(rows[c].to_numpy(np.float64) for c in ("a", "b", "children")))

    def to_one(rows: pd.DataFrame) -> pd.DataFrame:  # at most 256 * 255 rows
        level = level_of(rows)
        key, a, b, children = _summed(_parent(level["key"], 1), level["a"], level["b"], level["weighted"])
        return pd.DataFrame({"key": key, "a": a, "b": b, "children": children})

    # At most 256 * 255 rows.
    crown = pairs.sparkSession.sparkContext.broadcast(crown_of(two.groupBy("_one").applyInPandas(to_one, kind).toPandas()))

    def from_one(rows: pd.DataFrame) -> pd.DataFrame:
        level = level_of(rows)
        level |= below(level, _parent(level["key"], 1), crown.value)
        return pd.DataFrame({"pair": level["key"], **{c: level[c] for c in ("next_fixed", "next_times", "one")}})

    above = two.groupBy("_one").applyInPandas(from_one, "pair bigint, next_fixed double, next_times double, one double")

    def down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for rows in _whole_groups(batches):
            upper = rows["_three"] < 0
            known = pd.concat([last, rows[upper]]).drop_duplicates("pair").sort_values("pair")
            last = known[known["_two"] == rows["_two"].iloc[-1]]
            rows = rows[~upper]
            if not len(rows):
                continue
            pair, n = rows["pair"].to_numpy(np.int64), rows["n"].to_numpy().astype(np.int64)
            lp = Subtree(pair, n, depth).log_of_pairs({"key": known["pair"].to_numpy(np.int64)} | {c: known[c].to_numpy(np.float64) for c in ("next_fixed", "next_times", "one")})
            yield pd.DataFrame({"pair": pair, "n": n, "lp": lp})

    return _in_order(pairs, above).mapInPandas(down, "pair bigint, n bigint, lp double")


class Lookup:
    """Numbers by key in one open table of arrays, twice as large as the keys at least."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        bits = max(4, max(0, 2 * len(key) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.float32)
        left, at = np.arange(len(key)), self._slot(key)
        while len(left):
            free = self.keys[at] == -1
            self.keys[at[free]] = key[left[free]]
            mine = self.keys[at] == key[left]
            self.values[at[mine]] = value[left[mine]]
            left, at = left[~mine], (at[~mine] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, key: np.ndarray) -> np.ndarray:
        """The value of each key, nan where there is none."""
        out = np.full(len(key), np.nan, np.float32)
        left, at = None, self._slot(key)
        while len(at):
            found = self.keys[at]
            hit = found == (key if left is None else key[left])
            out[hit if left is None else left[hit]] = self.values[at[hit]]
            on = np.flatnonzero(~hit & (found != -1))
            left, at = on if left is None else left[on], (at[on] + 1) & self.mask
        return out


def _arrays(rows: DataFrame, *columns: str) -> list[np.ndarray]:
    """Columns of numbers on the driver, as arrays; they come as packed bytes, so no row is an object of its own there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({c: [batch[c].to_numpy().tobytes()] for c in columns})

    kinds = [np.int64 if t == "bigint" else np.float64 for t in (dict(rows.dtypes)[c] for c in columns)]
    parts = rows.select(*columns).mapInPandas(run, ", ".join(f"{c} binary" for c in columns)).collect()
    return [np.frombuffer(b"".join(bytes(p[i]) for p in parts), kind) for i, kind in enumerate(kinds)]


def _grade(column: str) -> Column:
    return F.floor(F.log2(F.col(column)) * 16).cast("int")


def _least(rows: DataFrame, column: str, most: int) -> int:
    """The grade of `column` from which on there are at most `most` rows."""
    graded = sorted(((g, n) for g, n in rows.filter(F.col(column) > 0).groupBy(_grade(column).alias("g")).count().collect()), reverse=True)  # at most 16 * 63 rows
    least, total = 1 << 30, 0
    for g, n in graded:
        if total + n > most:
            break
        least, total = g, total + n
    return least


def head_of(words: DataFrame, most: int = HEAD) -> tuple[list[bytes], np.ndarray, int]:
    """(the most frequent words, a row of base and known for each, the grade of count from which on a word is one of
    them): at most `most` words, however many there are."""
    least = _least(words, "m", most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"tokens": [b" ".join(batch["token"])], "data": [batch[["base", "known"]].to_numpy(np.float64).tobytes()]})

    parts = words.filter(_grade("m") >= least).mapInPandas(run, "tokens binary, data binary").collect()
    tokens = [w for p in parts for w in bytes(p["tokens"]).split(b" ")]
    return tokens, np.frombuffer(b"".join(bytes(p["data"]) for p in parts)).reshape(-1, 2), least


def score(docs: DataFrame, train: Column, keep: Sequence[str] = ("doc_id",), depth: int = DEPTH, head: int = HEAD, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """The `keep` columns with n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row of `docs`,
    with a model of the rows where `train` holds.

    Null texts count as empty: their one token is the end. Repeated rows each learn and are each scored; with no
    training row every bit has probability one half; an empty table gives an empty result; texts are taken whole. `head`
    and `most_pairs` bound what the scan looks up itself, and change no result beyond rounding.
    """
    spark = docs.sparkSession
    words = written(vocabulary(docs, train).withColumn("known", (F.col("c") > 0).cast("bigint")), "words")
    total, distinct = words.agg(F.sum("c"), F.sum("known")).first()
    total, distinct = total or 0, distinct or 0
    words = words.withColumn("base", F.log10((F.col("c") + 1) / F.lit(float(total + distinct + 1))))
    table = written(predicted(written(pairs_of(docs, train, depth), "pairs"), depth), "bytes")
    top, values, least_m = head_of(words, head)
    values = np.concatenate([values, np.zeros((1, 2))])  # a last row stands for every other word
    least_n = _least(table, "n", most_pairs)
    held = spark.sparkContext.broadcast(({w: i for i, w in enumerate(top)}, values, Lookup(*_arrays(table.filter(_grade("n") >= least_n), "pair", "lp"))))
    del top, values
    names = list(keep)

    def compute(texts: list[str]) -> dict:
        index, values, lookup = held.value
        find, none = index.get, len(index)
        lines = [line_of(t) for t in texts]
        bags = [[*x.split(), b""] for x in lines]
        counts = np.fromiter(map(len, bags), np.int64, len(bags))
        rows = np.fromiter((find(w, none) for bag in bags for w in bag), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(bags)), counts)
        base, known = (np.bincount(owner, values[rows, j], len(bags)) for j in (0, 1))
        rare = np.flatnonzero(rows == none)
        starts = np.cumsum(counts) - counts
        rest: list[list[bytes]] = [[] for _ in bags]
        for d, p in zip(owner[rare].tolist(), (rare - starts[owner[rare]]).tolist(), strict=True):
            rest[d].append(bags[d][p])
        del bags, rows, owner
        pair, n = pairs_in(lines, depth)
        lp = lookup.of(pair)
        cold = np.isnan(lp)
        ends = np.cumsum(n)
        offsets = np.concatenate([[0], np.cumsum(cold)])[np.concatenate([[0], ends])]
        total = np.concatenate([[0.0], np.cumsum(np.where(cold, 0, lp), dtype=np.float64)])
        return {
            "n_tokens": counts, "_base": base, "_known": known.astype(np.int64), "_lp": total[ends] - total[ends - n],
            "_bytes": [len(x) + 1 for x in lines], "_rest": rest, "_cold": pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(pair[cold])).cast(pa.list_(pa.int64())),
        }

    parts = map_texts(docs, names, "text", "n_tokens bigint, _base double, _known bigint, _lp double, _bytes bigint, _rest array<binary>, _cold array<bigint>", compute, 2_000_000)
    # The number is fixed by the written file; it brings a row's rare words and pairs together again.
    parts = written(parts.withColumn("_row", F.monotonically_increasing_id()), "parts")
    rest = words.filter(_grade("m") < least_m).select("token", "base", "known")
    rare = parts.select("_row", F.explode("_rest").alias("token")).join(rest, "token").groupBy("_row").agg(F.sum("base").alias("_base2"), F.sum("known").alias("_known2"))
    others = table.filter((F.col("n") == 0) | (_grade("n") < least_n)).select("pair", "lp")
    cold = parts.select("_row", F.explode("_cold").alias("pair")).join(others, "pair").groupBy("_row").agg(F.sum(F.col("lp").cast("float").cast("double")).alias("_lp2"))
    both = parts.drop("_rest", "_cold").join(rare, "_row", "left").join(cold, "_row", "left")
    lp = F.col("_lp") + F.coalesce("_lp2", F.lit(0.0))
    return both.select(
        *names, "n_tokens", (F.col("_known") + F.coalesce("_known2", F.lit(0))).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("_base") + F.coalesce("_base2", F.lit(0.0))).alias("base_score"), (lp / F.lit(float(_LN10))).alias("score"), (-lp / F.lit(float(_LN2)) / F.greatest("_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def op5_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model of those whose crc32(doc_id as text) mod 7 is not 2."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held = remainder("doc_id", 7) == 2
    return score(docs.withColumn("held_out", held), ~held, ("doc_id", "held_out"))
