"""A Merkle manifest of a dataset: a digest of every document, a tree of digests over each language, a tree over those, and
a proof for every document.

Nodes of eight are hashed to their parent, the last run of a level holds what is left. As the number of leaves is known,
so is the number of nodes in each run, and a run can be hashed as soon as all its nodes are at hand, wherever the others
of its level are. A *forest* is a set of nodes keyed by tree, level and index in which no run is whole: whole ones have
become their parent. Merging two forests is the union with all whole runs hashed; that is associative and commutative,
the empty forest is neutral, and the forest of all leaves is the root alone.

Documents are cut into shards by ranges of (language, id). Each shard's task folds its leaves into a forest of at most
seven nodes at each end of a level. Shards are then merged as a tree of neighbours, `FAN` at a time, in rounds of grouped
jobs: RDD.treeReduce does the same but pairs partitions by remainder, so neighbours would meet last and all open nodes
would reach the driver. Here only the root does. Runs that were hashed above the shards are kept, and each shard gets those
over its ends for its documents' proofs. A shard, a group of forests and a proof are all bounded, whatever the data.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, remainder, written

ARITY = 8
#: Documents of a shard, about, and forests that one task merges.
SHARD_ROWS, FAN = 16_384, 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over the languages' roots; languages are trees 0, 1, ...
TOP = -1
#: No tree is higher: eight to this power are more leaves than there are numbers for them.
LEVELS = 21

Key = tuple[int, int, int]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Forest:
    """Nodes of which no run is whole; `leaves` tells the number of leaves of each tree.

    >>> whole = Forest({0: 3, TOP: 1}).add({(0, 0, i): str(i) for i in range(3)})
    >>> whole.nodes == {(TOP, 0, 0): digest("012")}
    True
    """

    def __init__(self, leaves: dict[int, int]):
        self.leaves = leaves
        self.nodes: dict[Key, str] = {}
        #: Runs hashed here: parent and the children's digests.
        self.runs: dict[Key, list[str]] = {}

    def width(self, tree: int, level: int) -> int:
        """Nodes of a level."""
        n = self.leaves[tree]
        for _ in range(level):
            n = -(-n // ARITY)
        return n

    def add(self, nodes: dict[Key, str]) -> Forest:
        """The merge: takes the nodes in and hashes every run that is whole now."""
        fresh = list(nodes)
        self.nodes.update(nodes)
        while fresh:
            tree, level, index = fresh.pop()
            width = self.width(tree, level)
            if width == 1:
                if tree != TOP and (tree, level, index) in self.nodes:  # a language's root is a leaf of the top
                    self.nodes[TOP, 0, tree] = self.nodes.pop((tree, level, index))
                    fresh.append((TOP, 0, tree))
                continue
            run = index // ARITY
            children = [self.nodes.get((tree, level, i)) for i in range(ARITY * run, min(ARITY * (run + 1), width))]
            if None in children:
                continue
            for i in range(len(children)):
                del self.nodes[tree, level, ARITY * run + i]
            self.runs[tree, level + 1, run] = children
            self.nodes[tree, level + 1, run] = digest(children)
            fresh.append((tree, level + 1, run))
        return self


class Paths:
    """Proofs from runs that lie over the documents of a shard."""

    def __init__(self, forest: Forest, runs: dict[Key, list[str]]):
        self.forest, self.runs = forest, runs
        self.above: dict[Key, str] = {}

    def up(self, key: Key) -> Iterator[tuple[Key, list[str], int]]:
        """(parent, its children, place among them) from a node to the root."""
        tree, level, index = key
        while True:
            if self.forest.width(tree, level) == 1:
                if tree == TOP:
                    return
                tree, level, index = TOP, 0, tree
                continue
            parent = (tree, level + 1, index // ARITY)
            yield parent, self.runs[parent], index % ARITY
            tree, level, index = parent

    def siblings(self, key: Key) -> str:
        """The digests of all siblings from a node to the root. What lies above a run is the same for all its nodes."""
        for parent, children, place in self.up(key):
            if parent not in self.above:
                self.above[parent] = self.siblings(parent)
            return "".join(children[:place] + children[place + 1 :]) + self.above[parent]
        return ""

    def folded(self, key: Key, leaf: str) -> str:
        """The root that follows from a leaf and the siblings."""
        for _, children, place in self.up(key):
            leaf = digest([*children[:place], leaf, *children[place + 1 :]])
        return leaf

    def subroot(self, tree: int, leaf: str) -> str:
        """The language's root; `leaf` is that where it has no other."""
        if self.forest.leaves[TOP] > 1:
            return self.runs[TOP, 1, tree // ARITY][tree % ARITY]
        top = (tree, next(k for k in range(LEVELS + 1) if self.forest.width(tree, k) == 1), 0)
        return digest(self.runs[top]) if top in self.runs else leaf


def _spelt(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[_spelt(columns[f]) for f in FIELDS]), 256)


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, lang, leaf, other) of every row; where `tampered` is true, `other` is the leaf of the row with A-Z of its text in
    lower case. A null field is told apart from an empty one."""
    own = {f: F.col(f) for f in FIELDS}
    other = F.when(tampered, leaf(own | {"text": F.translate("text", UPPER, LOWER)})) if tampered is not None else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", leaf(own).alias("leaf"), other.alias("other"))


def sharded(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Adds shard: ranges of (lang, doc_id, leaf), nulls first, numbered in that order. `rows` is counted first."""
    n = max(1, math.ceil(rows.count() / shard_rows))
    return written(rows.repartitionByRange(n, "lang", "doc_id", "leaf").withColumn("shard", F.spark_partition_id()), "shards")


def spans(shards: DataFrame) -> DataFrame:
    """(shard, lang, tree, first, n, total, trees): the leaves of a language that a shard holds, from index `first` on, among
    `total`. A row for each shard, and for each language more; only such rows are ordered here."""
    held = shards.groupBy("shard", "lang").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("lang")
    held = held.withColumns({"first": F.coalesce(F.sum("n").over(own.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("n").over(own)})
    langs = held.select("lang").distinct()
    numbers = langs.select("lang", (F.row_number().over(Window.orderBy("lang")) - 1).cast("bigint").alias("tree"), F.count(F.lit(1)).over(Window.partitionBy()).alias("trees"))
    told = numbers.withColumnRenamed("lang", "_lang")
    return written(held.join(told, F.col("lang").eqNullSafe(F.col("_lang"))).select("shard", "lang", "tree", "first", "n", "total", "trees"), "spans")


_NODE = "shard bigint, tree bigint, level int, index bigint, digests array<string>, leaves bigint, trees bigint, run boolean"


def _rows(forest: Forest, shard: int, nodes: bool = True, runs: bool = True) -> pa.Table:
    """Open nodes, and runs hashed in this forest, as rows."""
    top = forest.leaves.get(TOP, 0)
    found = [(shard, *k, [d], forest.leaves[k[0]], top, False) for k, d in forest.nodes.items()] if nodes else []
    found += [(shard, *k, children, forest.leaves[k[0]], top, True) for k, children in forest.runs.items()] if runs else []
    names = ["shard", "tree", "level", "index", "digests", "leaves", "trees", "run"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.bool_()]
    columns = list(zip(*found, strict=True)) or [[] for _ in names]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _local(documents: pa.Table, held: list[dict]) -> tuple[Forest, list[tuple[Key, int]]]:
    """The forest of a shard, and (node, row) of its documents."""
    order = documents.append_column("_row", pa.array(range(documents.num_rows), pa.int64())).select(["lang", "doc_id", "leaf", "_row"])
    at: dict[str | None, list] = {}
    for r in order.to_pylist():
        at.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, r["leaf"], r["_row"]))
    sizes = {s["tree"]: s["total"] for s in held} | {TOP: s["trees"] for s in held}
    nodes, rows = {}, []
    for s in held:
        for i, (_, _, x, row) in enumerate(sorted(at[s["lang"]])):
            nodes[s["tree"], 0, s["first"] + i] = x
            rows.append(((s["tree"], 0, s["first"] + i), row))
    return Forest(sizes).add(nodes), rows


def merged(shards: DataFrame, held: DataFrame, fan: int = FAN) -> tuple[DataFrame, str | None]:
    """(runs hashed above the shards, the root; none for an empty table)."""

    def fold(key, documents, own):
        return _rows(_local(documents, own.to_pylist())[0], key[0].as_py(), runs=False)

    def merge(key, forests):
        rows = forests.to_pylist()
        sizes = {r["tree"]: r["leaves"] for r in rows} | {TOP: rows[0]["trees"]}
        return _rows(Forest(sizes).add({(r["tree"], r["level"], r["index"]): r["digests"][0] for r in rows}), key[0].as_py())

    level = written(shards.select("shard", "lang", "doc_id", "leaf").groupBy("shard").cogroup(held.groupBy("shard")).applyInArrow(fold, _NODE), "forest")
    runs = level.filter("run")
    while True:
        level = written(level.filter("NOT run").withColumn("shard", F.floor(F.col("shard") / fan)).groupBy("shard").applyInArrow(merge, _NODE), "forest")
        runs = runs.unionByName(level.filter("run"))
        last = level.agg(F.max("shard")).first()[0]
        if not last:
            break
    root = level.filter("NOT run").select(F.get("digests", 0)).first()  # one node is left, if there was any
    return runs, root[0] if root else None


def over(held: DataFrame, runs: DataFrame) -> DataFrame:
    """The runs above each shard's ends: (shard, tree, level, index, digests). A shard has at most two at a level of its own
    languages and of the top, all others over its documents lie inside it."""
    levels = F.sequence(F.lit(1), F.lit(LEVELS))
    ends = held.select("shard", F.explode(F.array(F.struct("tree", F.col("first").alias("at"), F.col("total").alias("n")), F.struct("tree", (F.col("first") + F.col("n") - 1).alias("at"), F.col("total").alias("n")), F.struct(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("at"), F.col("trees").alias("n")))).alias("_e"))
    width = lambda level: F.pow(F.lit(float(ARITY)), level.cast("double")).cast("bigint")
    climbed = ends.select("shard", "_e.*", F.explode(levels).alias("level")).filter(width(F.col("level") - 1) < F.col("n"))
    wanted = climbed.select("shard", "tree", "level", F.floor(F.col("at") / width(F.col("level"))).cast("bigint").alias("index")).distinct()
    return wanted.join(runs.select("tree", "level", "index", "digests"), ["tree", "level", "index"])


_PROOF = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, tampered: Column | None = None, shard_rows: int = SHARD_ROWS, fan: int = FAN) -> DataFrame:
    """Every document's leaf, its language's root, the root, the digest of its proof, and the root that follows from its
    proof and its leaf (where `tampered`: the leaf of the text with A-Z in lower case), verified if that is the root.

    Fields may be null, which is not the same as empty; a null language is one of its own and stands first, as a null id
    does in its language; rows of equal ids stand in the order of their leaves, repeated rows are leaves each (and as
    they are equal, so many as one shard holds at most are expected of one row). Columns other than the five are left out.
    An empty table has no root and gives an empty result.
    """
    shards = sharded(written(leaves(docs, tampered), "leaves"), shard_rows)
    held = spans(shards)
    runs, root = merged(shards, held, fan)
    above = over(held, runs)
    # Both kinds of rows that a shard's documents need beside them.
    beside = held.select("shard", "lang", "tree", "first", "total", "trees", F.lit(None).cast("int").alias("level"), F.lit(None).cast("bigint").alias("index"), F.lit(None).cast("array<string>").alias("digests"))
    beside = beside.unionByName(above, allowMissingColumns=True)

    def prove(documents, more):
        more = more.to_pylist()
        forest, rows = _local(documents, [r for r in more if r["level"] is None])
        paths = Paths(forest, forest.runs | {(r["tree"], r["level"], r["index"]): r["digests"] for r in more if r["level"] is not None})
        ids, own, other = (documents.column(c).to_pylist() for c in ("doc_id", "leaf", "other"))
        out = []
        for key, row in rows:
            folded = paths.folded(key, other[row] or own[row])
            out.append((ids[row], own[row], paths.subroot(key[0], own[row]), root, digest([paths.siblings(key)]), folded, folded == root))
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
        columns = list(zip(*out, strict=True)) or [[] for _ in kinds]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return shards.groupBy("shard").cogroup(beside.groupBy("shard")).applyInArrow(prove, _PROOF)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, with the texts of a third of them tampered with."""
    return manifest(read_table(spark, sf_dir, "documents").select(*FIELDS), remainder("doc_id", 3) == 0)
