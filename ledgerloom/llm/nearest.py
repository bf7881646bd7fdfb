"""Approximate nearest neighbours by multi-index hashing.

A rotation learned on a bounded sample turns vectors into binary codes of `BITS` bits, and a code is split into substrings.
If two codes differ in at most R bits, then by the pigeonhole principle they differ in few bits of some substring; so
every code within R of a query is found by probing, in the table of each substring, the values that near. What is found
is checked for R and ranked by exact distance.

R is learned too: exact neighbours of a few queries, over all rows, tell within how many bits most neighbours lie.
Rows are dealt over shards by a hash of their id and queries come in blocks; each pair of a shard and a block is a group
of its own with the index of its shard, and hands on no more than k rows for each query. A shard is copied once for each
block of queries and a query once for each shard, so both are as large as a task's memory allows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, small_batches, written

BITS, PART_BITS = 64, 16
K = 10
#: Vectors that the rotation is learned on, at most; rounds of learning.
SAMPLE, ROUNDS = 10_000, 30
#: Queries whose exact neighbours set the radius, at most, and the share of neighbours that must lie within it.
PROBES, TARGET = 64, 0.97
#: Rows of a shard and queries of a block, at most; a shard is smaller where that gives every task one.
SHARD_ROWS, LEAST_SHARD_ROWS, BLOCK_QUERIES = 65_536, 1024, 16_384


class Codes:
    """Centre, rotation and radius. Dimensions beyond those of the vectors come from further random rotations."""

    def __init__(self, sample: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.bits, self.radius = bits, bits
        d = sample.shape[1]
        self.centre = sample.mean(0)
        z = sample - self.centre
        _, axes = np.linalg.eigh(z.T @ z)
        parts = []
        for first in range(0, bits, d):
            own = axes[:, ::-1][:, : min(d, bits - first)]
            y = z @ own
            turn = np.linalg.qr(rng.normal(size=(own.shape[1], own.shape[1])))[0]
            for _ in range(rounds):  # the rotation that brings the vectors nearest to the corners of the cube
                u, _, v = np.linalg.svd(y.T @ np.sign(y @ turn))
                turn = u @ v
            parts.append(own @ turn)
        self.plane = np.concatenate(parts, axis=1)

    def of(self, x: np.ndarray) -> np.ndarray:
        """Codes as substrings: one row of `bits / PART_BITS` whole numbers for each vector."""
        bit = ((x - self.centre) @ self.plane > 0).astype(np.uint16).reshape(len(x), -1, PART_BITS)
        return (bit << np.arange(PART_BITS, dtype=np.uint16)).sum(2, dtype=np.uint16)


@cache
def flips(radius: int) -> np.ndarray:
    """All 16-bit values with at most `radius` set bits."""
    values = np.arange(1 << PART_BITS, dtype=np.uint32)
    return values[np.bitwise_count(values) <= radius]


def part_radii(radius: int, parts: int) -> list[int]:
    """Radii of the substrings: they sum to radius - parts + 1, so a code within `radius` is within one of them. A negative
    one stands for a table that need not be probed.

    >>> part_radii(26, 4), part_radii(2, 4)
    ([6, 6, 6, 5], [0, 0, 0, -1])
    """
    total = radius - parts + 1
    return [total // parts + (i < total % parts) for i in range(parts)]


class Tables:
    """For each substring, the rows of a shard in order of its value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(codes.shape[1])]
        self.starts = [np.searchsorted(codes[o, j], np.arange((1 << PART_BITS) + 1)) for j, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """The rows whose codes differ from `code` in at most `radius` bits; none is missed."""
        found = np.zeros(len(self.codes), bool)
        for j, r in enumerate(part_radii(radius, self.codes.shape[1])):
            if r < 0:
                continue
            values = flips(min(r, PART_BITS)) ^ np.uint32(code[j])
            starts, ends = self.starts[j][values], self.starts[j][values + 1]
            some = ends > starts
            starts, n = starts[some], (ends - starts)[some]
            at = np.arange(int(n.sum())) + np.repeat(starts - (np.cumsum(n) - n), n)
            found[self.order[j][at]] = True
        rows = np.flatnonzero(found)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(1) <= radius]


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(x - q).sum(1))


def usable(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, x) of the rows with an id and a vector that is not null, not zero, and finite throughout; x is of doubles."""
    x = F.col(vector_column).cast("array<double>")
    fine = F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False))) & F.exists(x, lambda e: e != 0)
    return rows.select(F.col(id_column).cast("bigint").alias("id"), x.alias("x")).filter(F.col("id").isNotNull() & fine)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def nearest(rows: DataFrame, queries: DataFrame, k: int = K, bits: int = BITS, target: float = TARGET, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` (id, x) its k nearest among `rows` (id, x) but those of
    its own id, by Euclidean distance in double precision, ties to the smaller id. Where a shard has fewer than k codes
    within the radius, the radius grows there until it has k, or all; so no query ends up short.

    Take both from usable(): null, zero and non-finite vectors take no part. Vectors of another length than most have
    (of the longest such length, if several are as common) take no part either. Rows that repeat an id are rows of their
    own, found each, and queries that repeat one are each answered in full. Fewer than k other rows give all of them.
    Without queries or rows the result is empty.
    """
    spark = rows.sparkSession
    small_batches(spark)
    lengths = {r[0]: r[1] for r in rows.groupBy(F.size("x")).count().orderBy(F.desc("count"), F.desc(F.size("x"))).limit(1).collect()}
    out = "query_id bigint, rank int, vec_id bigint, score double"
    if not lengths:
        return spark.createDataFrame([], out)
    (length, n), = lengths.items()
    rows, queries = rows.filter(F.size("x") == length), queries.filter(F.size("x") == length)

    order = [F.xxhash64("id"), "id"]
    sample = rows.orderBy(*order).limit(SAMPLE).toPandas()
    codes = Codes(_matrix(sample["x"]), bits)
    probes = queries.orderBy(*order).limit(PROBES).toPandas()
    if not len(probes):
        return spark.createDataFrame([], out)
    codes.radius = _radius(rows, probes, codes, k, target)

    # The number is fixed by the written file; it only tells queries of equal id apart.
    queries = written(queries.select("id", "x", F.monotonically_increasing_id().alias("query")), "queries")
    asked = max(1, queries.count())
    blocks = -(-asked // block_queries)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(-(-n // shard_rows), min(tasks, -(-n // LEAST_SHARD_ROWS)))
    held = spark.sparkContext.broadcast(codes)
    # A shard goes to every block, a query to every shard.
    index = rows.select("id", "x", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("_s"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_q"))
    probing = queries.select("id", "x", "query", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("_s"), F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("_q"))

    def search(shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(shard) and len(block):
            ids, x = shard["id"].to_numpy(np.int64), _matrix(shard["x"])
            tables = Tables(held.value.of(x))
            q = _matrix(block["x"])
            for own, query, vector, code in zip(block["id"].to_numpy(np.int64), block["query"].to_numpy(np.int64), q, held.value.of(q), strict=True):
                radius = held.value.radius
                while True:
                    near = tables.within(code, radius)
                    near = near[ids[near] != own]
                    if len(near) >= k or radius >= bits:
                        break
                    radius = min(bits, radius + 4)
                score = distances(x[near], vector)
                best = np.lexsort((ids[near], score))[:k]
                parts.append(pd.DataFrame({"query": query, "query_id": own, "vec_id": ids[near][best], "score": score[best]}))
        return pd.concat(parts) if parts else pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []})

    found = index.groupBy("_s", "_q").cogroup(probing.groupBy("_s", "_q")).applyInPandas(search, "query bigint, query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _radius(rows: DataFrame, probes: pd.DataFrame, codes: Codes, k: int, target: float) -> int:
    """The number of bits within which `target` of the exact neighbours of the probes lie, by one pass over all rows."""
    held = rows.sparkSession.sparkContext.broadcast((codes, probes["id"].to_numpy(np.int64), _matrix(probes["x"])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, ids, q = held.value
        mine = codes.of(q)
        kept = [(np.zeros(0), np.zeros(0, np.int64)) for _ in ids]
        for batch in batches:
            if not len(batch):
                continue
            x, own = _matrix(batch["x"]), batch["id"].to_numpy(np.int64)
            apart = codes.of(x)
            for i in range(len(ids)):
                other = np.flatnonzero(own != ids[i])
                score = np.concatenate([kept[i][0], distances(x[other], q[i])])
                bits = np.concatenate([kept[i][1], np.bitwise_count(apart[other] ^ mine[i]).sum(1).astype(np.int64)])
                best = np.argsort(score, kind="stable")[:k]
                kept[i] = score[best], bits[best]
        for i, (score, bits) in enumerate(kept):
            yield pd.DataFrame({"probe": i, "score": score, "bits": bits})

    found = rows.mapInPandas(run, "probe int, score double, bits bigint")
    rank = F.row_number().over(Window.partitionBy("probe").orderBy("score", "bits"))
    # At most PROBES * k rows.
    apart = [r[0] for r in found.withColumn("_r", rank).filter(F.col("_r") <= k).select("bits").collect()]
    return int(np.quantile(apart, target, method="higher")) if apart else codes.bits


def op4_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all other vectors for each vector whose id is divisible by 100."""
    rows = written(usable(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vectors")
    return nearest(rows, rows.filter(F.col("id") % 100 == 0))
