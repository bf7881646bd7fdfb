"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words and character n-grams; a softmax layer on that average
gives the class. Vectors and layer are trained together by stochastic gradient descent in numpy, on a bounded sample of
labelled documents. Because the layer is linear, a word's share of the class score is one number once training is over,
so scoring looks up each distinct word once per worker and sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, bounded_texts, filter_texts, give_back, map_texts, memo, read_table, remainder, sums

#: Rows of the hashed table and length of a vector: the model is 8 MB whatever the data.
BUCKETS, DIM = 1 << 17, 16
NGRAMS = (3, 4)
#: Labelled documents of each class that the model is fitted on, at most.
FIT_PER_CLASS = 2500
#: Characters of theirs, at most: a sample of very long texts has fewer of them.
FIT_CHARACTERS = 15_000_000
EPOCHS, RATE = 5, 0.5
#: Small samples are gone through more often, until so many steps are made.
LEAST_STEPS = 25_000
#: Scores from here on are taken as good.
THRESHOLD = 0.7

#: A word that repeats the one before is this word: a run of one word looks alike whatever the word.
REPEAT = "\u0001again"


def words_of(text: str) -> list[str]:
    """Words between white space, case and marks kept; a word equal to the one before becomes REPEAT."""
    words = text.split()
    for i in [i for i, (a, b) in enumerate(zip(words, words[1:], strict=False), 1) if a == b]:
        words[i] = REPEAT
    return words


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int64)


def features(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of the word) of every feature: the word itself and its character n-grams with < and > around it."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined = "".join(f"<{w}>" for w in words)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), lengths)
    prime = np.uint64(0x100000001B3)
    out, owners = [], []
    # A word's own hash: a sum over its characters, each multiplied by a factor of its place.
    place = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    factor = (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    factor ^= factor >> np.uint64(32)
    per_char = (points + np.uint64(17)) * (factor | np.uint64(1))
    per_char ^= per_char >> np.uint64(27)
    whole = np.add.reduceat(per_char, np.cumsum(lengths) - lengths)
    out.append(_mixed(whole * prime + np.uint64(1)))
    owners.append(np.arange(len(words)))
    for n in NGRAMS:
        if len(points) < n:
            continue
        same = owner[: len(points) - n + 1] == owner[n - 1 :]
        h = np.full(len(points) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h * prime) ^ points[k : len(points) - n + 1 + k]
            h *= np.uint64(0xFF51AFD7ED558CCD)
        out.append(_mixed(h[same]))
        owners.append(owner[: len(points) - n + 1][same])
    return np.concatenate(out), np.concatenate(owners)


class Model:
    """What is left of a trained model: for each bucket its share of the log-odds of class 1, and the bias."""

    def __init__(self, share: np.ndarray, bias: float):
        self.share, self.bias = share.astype(np.float32), float(bias)
        self.key = "quality" + hashlib.sha256(self.share.tobytes() + str(self.bias).encode()).hexdigest()

    def word_values(self, words: Sequence[str]) -> np.ndarray:
        """For each word: the sum over its features, and their number."""
        bucket, owner = features(words)
        return np.stack([np.bincount(owner, self.share[bucket], len(words)), np.bincount(owner, minlength=len(words))], axis=1) if words else np.zeros((0, 2))

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        """Probability of class 1; an empty text has the bias alone."""
        m = memo(self.key, self.word_values)
        rows, counts = m.rows([words_of(t) for t in texts])
        total = sums(m.values[rows], counts)
        return 1 / (1 + np.exp(-(self.bias + total[:, 0] / np.maximum(1, total[:, 1]))))


def train(texts: Sequence[str], labels: Sequence[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """Stochastic gradient descent over documents in a seeded random order, with a step that falls to zero."""
    y = np.asarray(labels, np.int64)
    prior = np.log((np.sum(y == 1) + 0.5) / (np.sum(y == 0) + 0.5)) if len(y) else 0.0
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer = np.zeros((2, DIM), np.float32)
    bias = np.array([0.0, prior], np.float32)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), prior)
    bags = []
    for t in texts:
        ids, n = np.unique(features(words_of(t))[0], return_counts=True)
        bags.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    epochs = max(epochs, min(100, -(-LEAST_STEPS // len(bags))))
    step, steps = 0, epochs * len(bags)
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            ids, share = bags[i]
            now = np.float32(rate * (1 - step / steps))
            step += 1
            mean = share @ vectors[ids] if len(ids) else np.zeros(DIM, np.float32)
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1  # the gradient of the loss by z
            back = layer.T @ p
            layer -= now * np.outer(p, mean).astype(np.float32)
            bias -= np.float32(0.05) * now * p
            vectors[ids] -= (now * share)[:, None] * back[None, :]
    return Model(vectors @ (layer[1] - layer[0]), bias[1] - bias[0])


def _labelled(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label): a null label or id takes no part; where an id is labelled twice, its largest label holds."""
    return labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> pd.DataFrame:
    """(text, label) of at most `per_class` documents of each class, of at most FIT_CHARACTERS together."""
    picked = bounded_sample(_labelled(labels, label), "label", per_class)
    # At most 2 * per_class ids.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "label", "doc_id")
    return bounded_texts(rows, "label", FIT_CHARACTERS).toPandas().sort_values(["doc_id", "text"], ignore_index=True)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = FIT_PER_CLASS) -> Model:
    """Train on at most `per_class` labelled documents of each class, and FIT_CHARACTERS of their text. The log-odds of the classes
    among all labelled documents take the place of those among the documents fitted on, so neither bound moves the scores.

    Labels that are null, neither 0 nor 1, or without a document take no part; an id that is labelled twice has its larger
    label; null texts are empty. Labels of one class alone, or none, teach nothing: every score is that of their number."""
    sample = labelled_sample(docs, labels, label, per_class)
    model = train(sample["text"].tolist(), sample["label"].tolist())
    fitted = sample["label"].value_counts().to_dict()
    del sample
    give_back()
    counted = dict(docs.select("doc_id").join(_labelled(labels, label), "doc_id").groupBy("label").count().collect())  # at most two rows
    odds = lambda n: np.log((n.get(1, 0) + 0.5) / (n.get(0, 0) + 0.5))
    return Model(model.share, model.bias + odds(counted) - odds(fitted))


def score(docs: DataFrame, model: Model, text_column: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The `keep` columns (all, if not given) of every document with score (0 to 1) and predicted (1 from THRESHOLD on);
    columns of those names are replaced.

    Null and empty texts get the score of the bias. Empty tables stay empty, repeated rows each get the same score, and
    texts of any length are scored whole.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def compute(texts: list[str]) -> dict:
        value = held.value.scores(texts)
        return {"score": value, "predicted": (value >= THRESHOLD).astype(np.int32)}

    return map_texts(docs, docs.columns if keep is None else keep, text_column, "score double, predicted int", compute)


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` that score THRESHOLD or more, with their own columns, whatever these are called.

    A model that learnt nothing, for want of labels of both classes, rejects no row. Null and empty texts have the score of
    the bias, repeated rows stay or go together, an empty table stays empty, texts are taken whole."""
    if not model.share.any():
        return docs
    held = docs.sparkSession.sparkContext.broadcast(model)
    return filter_texts(docs, "text", lambda texts: held.value.scores(texts) >= THRESHOLD)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learnt from labels of ids whose crc32 mod 4 is not 2."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").filter(remainder("doc_id", 4) != 2)
    model = fit(docs, labels)
    held = docs.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "text")
    return score(held, model, keep=("doc_id", "held_out"))
