"""Mixing sources to target weights: Pfair scheduling of source blocks, earliest deadline first.

Documents of one source are cut into blocks of about `block_chars` characters. Time is counted in slots of one block. In
the fluid mix every source that has blocks left flows at a rate in proportion to its weight, until its blocks are used up;
block k (from 1) of a source is released at the slot in which the fluid mix begins it, and due by the end of the slot in
which the fluid mix ends it. In each slot the released block with the earliest deadline runs. The windows of any stretch of
slots are never more than its slots, so each block runs within its own, and a source is at every slot less than one block
away from its target, by the weights as they are: nothing is rounded to a period.

What has run by a slot depends only on the windows that lie across it. Two such schedules that start from different
feasible states agree from the last deadline of the blocks that are begun but not ended at the start on; so the slots are
cut into chunks, and a task that starts that much before its chunk, from any feasible state, finds the schedule that one
pass from the first slot would give. No schedule passes through the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, read_table, written

BLOCK_CHARS = 16_384
#: Slots that one task schedules, at least; more, where the lightest source waits longer for a block.
CHUNK_SLOTS = 65_536
#: Parts of a source, at least: a part is ordered by one task, so a hot source is dealt over as many tasks as all others.
SHARDS = 256
#: Sources that are scheduled each by its own (16 bytes each in every task). Beyond, the lightest are one source to the
#: schedule, whose blocks are ordered among themselves.
MOST_SOURCES = 1 << 20
REST = "\u0000rest"
NULL = "\u0000null"
_EPS = 1e-6


class Fluid:
    """The fluid mix of sources with `n` blocks and weight `w` each: virtual time runs so that a source has had w * v
    blocks at time v, and ends at n / w; slots are what all sources have had together."""

    def __init__(self, n: np.ndarray, w: np.ndarray):
        self.n, self.w = np.asarray(n, np.float64), np.asarray(w, np.float64)
        self.end = self.n / self.w
        order = np.argsort(self.end, kind="stable")
        self._ends = self.end[order]
        self._ended = np.concatenate([[0.0], np.cumsum(self.n[order])])
        self._rate = np.concatenate([np.cumsum(self.w[order][::-1])[::-1], [0.0]])
        self._end_slots = self.slot_at(self._ends)
        self.slots = int(round(self._ended[-1]))

    def slot_at(self, v: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self._ends, v, "right")
        return self._ended[i] + v * self._rate[i]

    def time_at(self, slot: float) -> float:
        i = int(np.searchsorted(self._end_slots, slot, "right"))
        return float((slot - self._ended[i]) / self._rate[i]) if i < len(self._ends) else float(self._ends[-1])

    def had(self, slot: float) -> np.ndarray:
        """Blocks of each source that the fluid mix has had by a slot."""
        return np.minimum(self.n, self.w * self.time_at(slot))

    def release(self, source: np.ndarray, k: np.ndarray) -> np.ndarray:
        return np.floor(self.slot_at((k - 1) / self.w[source]) + _EPS).astype(np.int64)

    def deadline(self, source: np.ndarray, k: np.ndarray) -> np.ndarray:
        return np.ceil(self.slot_at(k / self.w[source]) - _EPS).astype(np.int64)

    def warm_up(self, slot: int) -> int:
        """A slot from which on any feasible state leads to the same schedule at `slot`."""
        now = self.time_at(slot)
        active = self.end > now
        if not active.any():
            return slot
        before = now - 1 / float(self.w[active].min())
        return max(0, int(np.floor(self.slot_at(np.float64(before)))) - 2) if before > 0 else 0

    def state(self, slot: int) -> np.ndarray:
        """A feasible number of blocks done for each source at a slot: those that the fluid mix has ended, and of those
        that it has begun the ones with the earliest deadlines."""
        had = self.had(slot)
        done = np.floor(had + _EPS)
        missing = slot - int(done.sum())
        begun = np.flatnonzero(done < self.n)
        due = self.deadline(begun, done[begun] + 1)
        first = np.lexsort((begun, due, had[begun] - done[begun] <= _EPS))
        done[begun[first[: max(0, missing)]]] += 1
        return done


def scheduled(fluid: Fluid, first: int, last: int) -> pd.DataFrame:
    """(unit, block, slot, release, deadline) of the slots from `first` to before `last`; blocks from 0, units by number.

    >>> scheduled(Fluid([2, 1, 1], [2, 1, 1]), 0, 4)["unit"].tolist()
    [0, 1, 0, 2]
    """
    start = fluid.warm_up(first)
    done = fluid.state(start) if start else np.zeros(len(fluid.n))
    most = np.minimum(fluid.n, np.floor(fluid.had(last) + _EPS) + 1)
    counts = np.maximum(0, most - done).astype(np.int64)
    unit = np.repeat(np.arange(len(counts)), counts)
    k = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(done, counts).astype(np.int64) + 1
    release, deadline = fluid.release(unit, k), fluid.deadline(unit, k)
    order = np.lexsort((unit, deadline, release))
    blocks = list(zip(deadline[order].tolist(), unit[order].tolist(), k[order].tolist(), release[order].tolist(), strict=True))
    ready: list[tuple[int, int, int, int]] = []
    out, i = [], 0
    for slot in range(start, last):
        while i < len(blocks) and (blocks[i][3] <= slot or not ready):
            heapq.heappush(ready, blocks[i])
            i += 1
        run = heapq.heappop(ready)
        if slot >= first:
            out.append((run[1], run[2] - 1, slot, run[3], run[0]))
    return pd.DataFrame(out, columns=["unit", "block", "slot", "release", "deadline"], dtype=np.int64)


def schedule(spark: SparkSession, n: np.ndarray, w: np.ndarray, chunk_slots: int = CHUNK_SLOTS) -> DataFrame:
    """(unit, block, slot, release, deadline) of all blocks of units with `n` blocks and weight `w`, each chunk of slots in
    a task of its own. A task's work is in proportion to its chunk, its warm-up and the number of units."""
    fluid = Fluid(n, w)
    chunk = max(chunk_slots, int(min(fluid.slots, np.ceil(fluid.w.sum() / fluid.w.min())))) if len(fluid.n) else chunk_slots
    chunks = -(-fluid.slots // chunk)
    held = spark.sparkContext.broadcast(fluid)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for j in batch["id"]:
                yield scheduled(held.value, int(j) * chunk, min((int(j) + 1) * chunk, held.value.slots))

    return spark.range(0, chunks, 1, max(1, chunks)).mapInPandas(run, "unit bigint, block bigint, slot bigint, release bigint, deadline bigint")


def ranked_blocks(sources: DataFrame) -> DataFrame:
    """(source_key, block, _at): the blocks of sources (source_key, n blocks, w) in order of deadline (block + 1) / w, from 0.

    At most t blocks are due by any slot t, so each has run by its deadline: a source is never a block behind. It may be
    ahead by its weight among them times their number, and one more. Ranks are places in a range of deadlines, shifted
    by the ranges before, so no task orders all blocks.
    """
    order = ["_due", "source_key", "block"]
    blocks = sources.select("source_key", "w", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("block"))
    blocks = blocks.select("source_key", "block", ((F.col("block") + 1) / F.col("w")).alias("_due")).repartitionByRange(SHARDS, *order)
    blocks = written(blocks.withColumn("_range", F.spark_partition_id()), "blocks")
    before = blocks.groupBy("_range").count().withColumn("_before", F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))  # SHARDS rows
    blocks = blocks.withColumn("_n", F.row_number().over(Window.partitionBy("_range").orderBy(*order))).join(F.broadcast(before), "_range")
    return blocks.select("source_key", "block", (F.coalesce("_before", F.lit(0)) + F.col("_n") - 1).alias("_at"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, block_chars: int = BLOCK_CHARS, chunk_slots: int = CHUNK_SLOTS, most_sources: int = MOST_SOURCES) -> DataFrame:
    """Every document with its place in the mix; no row is dropped.

    Adds block (of its source, from 0), slot (from 0, null for a source without a weight), release and deadline (slots: the
    block runs at release or later, and before deadline), in_mix (no source had run out yet) and source_start (characters
    of the source before the document; one more is counted for each document). When a source runs out the others go on,
    their weights scaled up, still less than a block off at every slot.

    `weights` is by source; null sources are called "\\0null". Without it, sizes to the power `temperature` are taken: 1 keeps
    the natural shares, 0 gives every source the same. A source's order is (part, id hash, id, text hash): copies that
    share an id too are identical rows, so which of them comes first changes nothing. Null and empty texts count one
    character. A document longer than a block stands in the block in which it starts. Empty tables give empty results;
    clashing extra columns are replaced.

    Running sums are taken in parts of a source and shifted by the parts before, and the slots of a part's blocks come with
    the part's row, so the documents are shuffled once. Beyond `most_sources` sources the lightest are scheduled as one,
    with their weights and blocks together, and inside it by ranked_blocks(); release and deadline are those of the whole.
    """
    spark = docs.sparkSession
    docs, own = numbered(docs.drop("block", "slot", "release", "deadline", "in_mix", "source_start"))
    shards = max(SHARDS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    part, order = ["_source", "_shard"], ["_h", own["doc_id"], "_t"]
    keyed = docs.withColumns({
        "_source": F.coalesce(F.col(own["source"]).cast("string"), F.lit(NULL)), "_h": F.xxhash64(own["doc_id"]), "_t": F.xxhash64(own["text"]),
        "_size": F.coalesce(F.char_length(own["text"]), F.lit(0)).cast("bigint") + 1,
    })
    keyed = keyed.withColumn("_shard", F.pmod(F.col("_h"), F.lit(shards)).cast("int"))
    parts = keyed.groupBy(*part).agg(F.sum("_size").alias("_total"))
    before = F.coalesce(F.sum("_total").over(Window.partitionBy("_source").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = written(parts.withColumn("_before", before), "parts")

    sizes = parts.groupBy(F.col("_source").alias("source_key")).agg(F.sum("_total").alias("_chars"))
    if weights is None:
        sizes = sizes.withColumn("w", F.pow(F.col("_chars"), F.lit(temperature)))
    else:
        given = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "source_key string, w double")
        sizes = sizes.join(given, "source_key").filter("w > 0")
    # The number is fixed by the written file; it only names a source.
    sizes = written(sizes.select("source_key", F.expr(f"(_chars + {block_chars - 1}) div {block_chars}").alias("n"), "w", F.monotonically_increasing_id().alias("_id")), "sizes")
    one = sizes.orderBy(F.desc("w"), "source_key").limit(most_sources + 1).select("_id", "n", "w").toPandas()
    rest = None
    if len(one) > most_sources:
        one = one.iloc[: most_sources - 1]
        rest = sizes.join(F.broadcast(spark.createDataFrame(one[["_id"]])), "_id", "left_anti")
        both = rest.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
        one = pd.concat([one, pd.DataFrame({"_id": [-1], "n": [both["n"]], "w": [both["w"]]})])
    # Units in order of weight, then name: ties of the schedule do not depend on how files lie.
    one = one.reset_index(drop=True)
    units = spark.createDataFrame(one[["_id"]].reset_index(names="unit"), "unit bigint, _id bigint")
    fluid = Fluid(one["n"].to_numpy(), one["w"].to_numpy())
    full = int(np.floor(fluid.slot_at(fluid.end.min()) + _EPS)) if len(one) else 0
    slots = schedule(spark, fluid.n, fluid.w, chunk_slots)

    # The blocks that a part has documents in, with their slots: as many rows as blocks, and one more for each part.
    first, last = F.expr(f"_before div {block_chars}"), F.expr(f"(_before + _total - 1) div {block_chars}")
    blocks = parts.join(sizes.select(F.col("source_key").alias("_source"), "_id"), "_source").select(*part, "_id", F.explode(F.sequence(first, last)).alias("_block"))
    if rest is None:
        blocks = blocks.withColumn("_at", F.col("_block"))
    else:
        blocks = blocks.join(ranked_blocks(rest).withColumnsRenamed({"source_key": "_source", "block": "_block"}), ["_source", "_block"], "left")
        blocks = blocks.withColumns({"_id": F.when(F.col("_at").isNull(), F.col("_id")).otherwise(F.lit(-1)), "_at": F.coalesce("_at", "_block")})
    blocks = blocks.join(units, "_id").join(slots.withColumnRenamed("block", "_at"), ["unit", "_at"])
    placed = blocks.groupBy(*part).agg(F.array_sort(F.collect_list(F.struct("_block", "slot", "release", "deadline"))).alias("_slots"))
    placed = written(parts.select(*part, "_before").join(placed, part, "left"), "slots")

    in_part = F.sum("_size").over(Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    found = keyed.withColumn("_in", F.coalesce(in_part, F.lit(0))).join(placed, part)
    found = found.withColumn("source_start", F.col("_before") + F.col("_in")).withColumn("block", F.expr(f"source_start div {block_chars}"))
    found = found.withColumn("_slot", F.get("_slots", (F.col("block") - F.expr(f"_before div {block_chars}")).cast("int")))
    return found.select(
        *[F.col(n).alias(c) for c, n in own.items()], "block", F.col("_slot.slot").alias("slot"), F.col("_slot.release").alias("release"), F.col("_slot.deadline").alias("deadline"),
        F.coalesce(F.col("_slot.slot") < full, F.lit(False)).alias("in_mix"), "source_start",
    )


def keep_mixed(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Every row of `docs` in order of the slots, those without a slot last. Rows keep their own columns, clashing names too.

    When a source runs out the others go on at their weights, scaled up, so nothing of them is dropped. Nulls, empty and long
    texts, repeated rows and empty tables are as in mix()."""
    named, own = numbered(docs)
    mixed = mix(named.withColumnsRenamed({own[c]: c for c in ("doc_id", "source", "text")}), weights, temperature, block_chars)
    order = [F.col("slot").asc_nulls_last(), F.col("source_start")]
    back = own | {c: c for c in ("doc_id", "source", "text")}
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order).select(*[F.col(n).alias(c) for c, n in back.items()])


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its block and slot, by weights that are the square roots of the sizes of the sources."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).drop("text")
