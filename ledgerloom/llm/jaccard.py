"""N-gram Jaccard join: a MinHash LSH forest finds candidates, their whole shingle sets decide.

A text is the set of its runs of `WORDS` words (lower-cased, between white space). In each of the trees it has a label of
`LABEL` MinHash values, and the labels of a tree, in order, are a trie: a node is a prefix, its texts those whose labels
begin with it. Texts of similarity s share a prefix of k values with probability s^k.

The search begins with whole labels, which near copies share in some tree: a text that agrees with the first text of its
node, over the values of all trees, is of one class with it. Then prefixes are shortened, text by text, until the chance to
miss a partner in all trees is below 1 - recall at the least similarity that the text's number of shingles allows; a short
text, which can reach 0.8 only by being nearer than that, stops at longer prefixes, and a text that is alone at the shortest
one goes no further. In a node that still joins different classes the texts outside its largest class are held against all.

Texts of a pair that comes out of this with a likeness of labels near the similarity asked for are connected. Each
component is cut into cells of bounded size, and within a cell every pair is compared exactly. Equal texts are folded to
one before all this and unfolded at the end, so neither a large group of copies nor one of near copies is ever expanded
into pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, memo, numbered, read_table, written
from .graph import components

WORDS, SIMILARITY = 5, 0.8
TREES, LABEL, RECALL = 20, 8, 0.9999
#: Candidates go on to the exact comparison if so much less of their labels agrees than the similarity; five standard errors
#: of the share of 160 values at 0.8.
SLACK = 0.16
#: A cell compares two blocks of at most about so many texts and shingles.
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 1 << 20
#: Candidates are broadcast to the scan of the texts up to this many rows of three numbers, else both are shuffled.
MOST_BROADCAST = 500_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def depth_for(similarity: float, recall: float = RECALL, trees: int = TREES, label: int = LABEL) -> int:
    """The longest prefix at which a pair of that similarity meets in some tree with at least that probability.

    >>> depth_for(0.8, 0.9999, 20), depth_for(0.95, 0.9999, 20)
    (4, 8)
    """
    k = label
    while k > 1 and 1 - (1 - similarity**k) ** trees < recall:
        k -= 1
    return k


def least_similarity(size: int, similarity: float = SIMILARITY) -> float:
    """The lowest similarity of at least that much that a set of so many shingles can have with another set.

    >>> least_similarity(3, 0.8), least_similarity(4, 0.8), round(least_similarity(7, 0.8), 3)
    (1.0, 0.8, 0.857)
    """
    shares = (common / (size + other - common) for other in range(1, 2 * size + 2) for common in range(1, min(size, other) + 1))
    return min(x for x in shares if x >= similarity - 1e-9)


def _word_hashes(words: Sequence[str]) -> np.ndarray:
    out = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    return out.view(np.int64).reshape(-1, 1)


def shingles(texts: Sequence[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the shingles of all texts in order, their number per text); a text of fewer words is one shingle, and
    so is a text without any."""
    m = memo("words", _word_hashes)
    rows, counts = m.rows([t.lower().split() for t in texts])
    h = m.values[rows, 0].view(np.uint64) if len(rows) else np.zeros(0, np.uint64)
    # Every text gets `words` - 1 places behind its words (behind one, if it has none): windows run over all texts at once.
    padded = np.maximum(counts, 1) + words - 1
    ends = np.cumsum(padded)
    starts = ends - padded
    line = np.zeros(int(padded.sum()) + words, np.uint64)
    line[np.arange(len(h)) + np.repeat(starts - (np.cumsum(counts) - counts), counts)] = h
    n = np.maximum(counts - words + 1, 1)
    at = np.arange(int(n.sum())) + np.repeat(starts - (np.cumsum(n) - n), n)
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            out = (out ^ (out >> np.uint64(29))) * _PRIME + line[at + k]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out, n


#: Sets up to this size are counted, to see how near their partners must be; larger ones can come close to any similarity.
SMALL = 16


def labels_of(texts: Sequence[str], words: int = WORDS, trees: int = TREES, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a row of bytes for each text: the labels of its trees one after the other, each value two bytes, the high one first;
    number of shingles; number of different ones, up to SMALL)."""
    rng = np.random.default_rng(seed)
    flip = rng.integers(0, 2**32, trees * LABEL, np.uint32)
    times = rng.integers(0, 2**32, trees * LABEL, np.uint32) | np.uint32(1)
    h, n = shingles(texts, words)
    starts = np.cumsum(n) - n
    short = (h >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(texts), trees * LABEL), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(trees * LABEL if len(texts) else 0):
            out[:, k] = np.minimum.reduceat((short ^ flip[k]) * times[k], starts)
        out = (out ^ (out >> np.uint32(15))) * np.uint32(0x9E3779B1)
    values = (out >> np.uint32(16)).astype(">u2")
    different = np.minimum(n, SMALL + 1)
    for i in np.flatnonzero(n <= SMALL):
        different[i] = len(set(h[starts[i] : starts[i] + n[i]].tolist()))
    return values.view(np.uint8).reshape(len(texts), -1), n, different


def digests(docs: DataFrame, words: int = WORDS, trees: int = TREES, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(doc_id, h1, h2, n, labels, depth): two hashes of the text, its number of shingles, its labels, and the length of the
    shortest prefix that it needs."""
    usual = depth_for(similarity, recall, trees)
    depths = np.array([usual, *(depth_for(least_similarity(k, similarity), recall, trees) for k in range(1, SMALL + 1)), usual], np.int32)

    def compute(texts: list[str]) -> dict:
        labels, n, different = labels_of(texts, words, trees)
        return {"n": n, "labels": [x.tobytes() for x in labels], "depth": depths[different]}

    return map_texts(hashed(docs), ("doc_id", "h1", "h2"), "text", "n bigint, labels binary, depth int", compute)


def hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, h1, h2): a null text counts as the empty one."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2"))


def compare(texts: Sequence[str], copies: np.ndarray, side: np.ndarray, v: np.ndarray, similarity: float = SIMILARITY, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of a cell, exactly: (smallest linked vertex, linked texts, linked documents) for each row.

    With rows on one side only, pairs are taken within it, else between the two sides.
    """
    h, n = shingles(texts, words)
    owner = np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((owner, h))
    h, owner = h[order], owner[order]
    first = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])  # a shingle counts once a text
    h, owner = h[first], owner[first]
    size = np.bincount(owner, minlength=len(texts))
    code = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]]))
    shared = np.bincount(code)[code] > 1
    code, owner = code[shared], owner[shared]
    code = np.cumsum(np.concatenate([[0], code[1:] != code[:-1]])) if len(code) else code
    alone = not side.any()
    left = np.flatnonzero(side == 0)
    right = left if alone else np.flatnonzero(side == 1)
    common = np.zeros((len(left), len(right)), np.float32)
    columns = 2048
    cuts = np.searchsorted(code, np.arange(0, (int(code[-1]) + 1 if len(code) else 0) + columns, columns))
    for k, (a, b) in enumerate(itertools.pairwise(cuts)):
        if b > a:
            x = np.zeros((len(texts), columns), np.float32)
            x[owner[a:b], code[a:b] - k * columns] = 1
            common += x[left] @ x[right].T
    union = size[left][:, None] + size[right][None, :] - common
    linked = common >= similarity * union - 1e-6
    if alone:
        np.fill_diagonal(linked, False)
    texts_n, docs_n = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    texts_n[left], docs_n[left] = linked.sum(1), linked @ copies[right]
    if not alone:
        texts_n[right], docs_n[right] = linked.sum(0), copies[left] @ linked
    root = v.copy()
    top = np.iinfo(np.int64).max
    while True:
        before = root.copy()
        root[left] = np.minimum(root[left], np.where(linked, root[right][None, :], top).min(1, initial=top))
        root[right] = np.minimum(root[right], np.where(linked, root[left][:, None], top).min(0, initial=top))
        if (root == before).all():
            return root, texts_n, docs_n


def _values(labels: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(labels), np.uint16).reshape(len(labels), -1)


def _prefix(tree: str, depth: str) -> Column:
    """The hash that names the node of a tree at a depth, for the column labels."""
    return F.expr(f"xxhash64({tree}, {depth}, substring(labels, {tree} * {2 * LABEL} + 1, 2 * {depth}))")


def forest(texts: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, trees: int = TREES, block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """Edges (a, b) that connect every two texts (v, labels, depth) that the forest brings together and whose labels agree
    in enough values: in a star around one text, or through others, but not each pair of them. `texts` is read several
    times; give it written."""
    least = int(np.ceil((similarity - SLACK) * trees * LABEL))
    lowest = depth_for(similarity, recall, trees)
    labels = texts.select("v", "labels")
    # The tries down to the shortest prefix: only texts that are not alone in a node go on.
    rows = texts.select("v", "labels", "depth", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    roots = rows.select("v", "tree", "depth", _prefix("tree", str(lowest)).alias("root"), _prefix("tree", str(LABEL)).alias("leaf"))
    shared = roots.groupBy("root").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("root")
    alive = written(roots.join(shared, "root").select("v", "tree", "depth", "leaf"), "alive")

    # Whole labels: each text is held against the first of its node.
    hubs = alive.groupBy("leaf").agg(F.min("v").alias("hub"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    pairs = alive.join(hubs, "leaf").filter("v <> hub").select("v", "hub").distinct()
    pairs = pairs.join(labels, "v").join(labels.select(F.col("v").alias("hub"), F.col("labels").alias("_hub")), "hub")

    def agree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                same = (_values(batch["labels"]) == _values(batch["_hub"])).sum(1) >= least
                yield batch.loc[same, ["v", "hub"]].rename(columns={"v": "a", "hub": "b"})

    stars = written(pairs.mapInPandas(agree, "a bigint, b bigint"), "stars")
    classes = components(stars).withColumnRenamed("root", "_class")

    # Shorter prefixes: at a depth stand the texts that need that depth or a shorter one, if one needs just it.
    deep = alive.join(classes, "v", "left").withColumn("_class", F.coalesce("_class", "v")).join(labels, "v")
    at = F.explode(F.sequence(F.col("depth"), F.lit(LABEL))).alias("at")
    deep = deep.select("v", "tree", "depth", "_class", "labels", at)
    deep = written(deep.select("v", "_class", (F.col("at") == F.col("depth")).alias("_own"), _prefix("tree", "at").alias("node")), "nodes")
    sizes = deep.groupBy("node", "_class").agg(F.count(F.lit(1)).alias("_n"), F.bool_or("_own").alias("_own"))
    sizes = sizes.groupBy("node").agg(F.sum("_n").alias("_all"), F.max(F.struct("_n", "_class")).alias("_top"), F.count(F.lit(1)).alias("_classes"), F.bool_or("_own").alias("_own"))
    count = lambda n: F.ceil(n / block_texts).cast("int")
    open_nodes = sizes.filter("_classes > 1 and _own").select("node", F.col("_top._class").alias("_main"), count(F.col("_all") - F.col("_top._n")).alias("_rows"), count(F.col("_all")).alias("_columns"))
    members = deep.join(open_nodes, "node").join(labels, "v").select("node", "v", "labels", (F.col("_class") != F.col("_main")).alias("_out"), "_rows", "_columns", F.xxhash64("v").alias("_h"))
    # A cell holds a block of the texts outside the largest class of a node, and a block of all its texts.
    out = members.filter("_out").select("node", "v", "labels", F.lit(0).alias("side"), F.pmod("_h", "_rows").alias("_i"), F.explode(F.sequence(F.lit(0), F.col("_columns") - 1)).alias("_j"))
    every = members.select("node", "v", "labels", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_rows").cast("bigint") - 1)).alias("_i"), F.pmod("_h", "_columns").cast("int").alias("_j"))

    def connect(cell: pd.DataFrame) -> pd.DataFrame:
        v, side, value = cell["v"].to_numpy(np.int64), cell["side"].to_numpy(), _values(cell["labels"])
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b, most = value[left], value[right], max(1, (1 << 22) // max(1, len(right)))
        found = []
        for i in range(0, len(left), most):
            same = np.zeros((len(a[i : i + most]), len(b)), np.uint8 if a.shape[1] < 256 else np.uint16)
            for k in range(a.shape[1]):
                same += a[i : i + most, k, None] == b[None, :, k]
            x, y = np.nonzero(same >= least)
            found.append(pd.DataFrame({"a": v[left[x + i]], "b": v[right[y]]}))
        found = pd.concat(found or [pd.DataFrame({"a": v[:0], "b": v[:0]})])
        return _spanning(found[found["a"] != found["b"]])

    met = out.unionByName(every).groupBy("node", "_i", "_j").applyInPandas(connect, "a bigint, b bigint")
    return stars.unionByName(met)


def _spanning(edges: pd.DataFrame) -> pd.DataFrame:
    """An edge from each vertex but the smallest of each component to the smallest: no more edges than vertices."""
    v, at = np.unique(edges[["a", "b"]].to_numpy(np.int64), return_inverse=True)
    at = at.reshape(-1, 2)
    root = np.arange(len(v))
    while True:
        before = root.copy()
        low = np.minimum(root[at[:, 0]], root[at[:, 1]])
        np.minimum.at(root, at[:, 0], low)
        np.minimum.at(root, at[:, 1], low)
        root = root[root]
        if (root == before).all():
            break
    own = root != np.arange(len(v))
    return pd.DataFrame({"a": v[own], "b": v[root[own]]})


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, recall: float = RECALL, trees: int = TREES, block_texts: int = BLOCK_TEXTS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, class_id, n_links, n_text_links, n_copies, h1, h2) for each row of `docs` (doc_id, text).

    Two documents are linked when the Jaccard similarity of their shingle sets is at least `similarity`; classes are
    connected by links and called by their smallest doc_id. n_links counts the other documents linked to a document,
    its copies among them; n_text_links the different texts; n_copies the rows of its very text, itself included.
    Null and empty texts are equal to one another; texts shorter than `words` words are one shingle. Rows of equal id are
    rows of their own, a null id takes part but names a class only if the class has no other. An empty table gives an
    empty result, extra columns are left out.
    """
    spark = docs.sparkSession
    rows = written(digests(docs, words, trees, similarity, recall), "digests")
    texts = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("n", "labels", "depth")])
    # The number is fixed by the written file; it only names a text.
    texts = written(texts.withColumn("v", F.monotonically_increasing_id()), "texts")

    candidates = components(forest(texts, similarity, recall, trees, block_texts))
    members = candidates.join(texts.select("v", "first", "h1", "h2", "copies", "n"), "v")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("_texts"), F.sum("n").alias("_n"))
    blocks = F.greatest(F.ceil(F.col("_texts") / block_texts), F.ceil(F.col("_n") / block_shingles)).cast("int")
    members = written(members.join(sizes.select("root", blocks.alias("blocks")), "root"), "members")

    few = members.count() <= MOST_BROADCAST
    key = members.select(F.col("first").alias("doc_id"), "h1", "h2", "v", "copies", "root", "blocks")
    placed = hashed(docs).alias("d").join((F.broadcast(key) if few else key).alias("k"), F.expr("d.doc_id <=> k.doc_id and d.h1 = k.h1 and d.h2 = k.h2"))
    placed = placed.select("v", "copies", "root", "blocks", "text", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int").alias("_b"))
    # Cell (i, j), i <= j, holds the blocks i and j: a text goes to as many cells as its component has blocks.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = placed.withColumn("_o", other).select(
        "v", "copies", "root", "text", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), (F.col("_b") > F.col("_o")).cast("int").alias("side"))

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.drop_duplicates("v")
        v, side = cell["v"].to_numpy(np.int64), cell["side"].to_numpy()
        if cell["_i"].iloc[0] != cell["_j"].iloc[0] and len(set(side)) < 2:  # one of the two blocks is empty
            return pd.DataFrame({"v": v, "to": v, "texts": 0, "docs": 0})
        root, texts_n, docs_n = compare(cell["text"].tolist(), cell["copies"].to_numpy(np.int64), side, v, similarity, words)
        return pd.DataFrame({"v": v, "to": root, "texts": texts_n, "docs": docs_n})

    found = written(cells.groupBy("root", "_i", "_j").applyInPandas(run, "v bigint, to bigint, texts bigint, docs bigint"), "found")
    classes = components(found.select(F.col("v").alias("a"), F.col("to").alias("b")))
    counts = found.groupBy("v").agg(F.sum("texts").alias("n_text_links"), F.sum("docs").alias("_docs"))
    whole = texts.select("v", "h1", "h2", "first", "copies").join(classes, "v", "left").join(counts, "v", "left")
    whole = whole.withColumns({"root": F.coalesce("root", "v"), "n_text_links": F.coalesce("n_text_links", F.lit(0)), "n_links": F.coalesce("_docs", F.lit(0)) + F.col("copies") - 1})
    names = whole.groupBy("root").agg(F.min("first").alias("class_id"))
    whole = written(whole.join(names, "root").select("h1", "h2", "class_id", "n_links", "n_text_links", F.col("copies").alias("n_copies")), "classes")
    return rows.select("doc_id", "h1", "h2").join(whole, ["h1", "h2"]).select("doc_id", "class_id", "n_links", "n_text_links", "n_copies", "h1", "h2")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of `docs` for each class of near_duplicates(): that of the smallest doc_id (of the smallest text hash, if
    rows share that id). All columns are kept. Rows of equal id and text count as one: the first by a hash of their other
    columns. Null texts are one class with empty ones, an empty table stays empty."""
    found = near_duplicates(docs, **options)
    chosen = found.filter("doc_id <=> class_id").groupBy("class_id").agg(F.min(F.struct("h1", "h2")).alias("_h"))
    chosen = chosen.select(F.col("class_id").alias("_id"), F.col("_h.h1").alias("_h1"), F.col("_h.h2").alias("_h2"))
    named, own = numbered(docs)
    text = F.coalesce(own["text"], F.lit(""))
    keyed = named.withColumns({"_k1": F.xxhash64(text), "_k2": F.xxhash64(F.lit(7), text)})
    kept = keyed.join(chosen, F.expr(f"cast({own['doc_id']} as bigint) <=> _id and _k1 = _h1 and _k2 = _h2"), "left_semi")
    others = F.struct(*[n for c, n in own.items() if c != "text"])
    one = F.min_by(F.struct(*own.values()), F.xxhash64(F.to_json(others, {"ignoreNullFields": "false"})))
    kept = kept.groupBy(own["doc_id"], "_k1", "_k2").agg(one.alias("_r"))
    return kept.select(*[F.col(f"_r.{n}").alias(c) for c, n in own.items()])


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near duplicates, and the numbers of documents and texts linked to it."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id", "n_links", "n_text_links", "n_copies")
