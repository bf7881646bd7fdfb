"""Toxicity: multiple-instance learning over sentences.

A document is a bag of sentences. Each sentence has a probability from its words; the document's is their noisy-or,
1 - prod(1 - p). The word weights are trained from document labels alone, by gradient descent on the likelihood of that
noisy-or, so that the blame falls on the sentences that explain a toxic document. The same weights then locate them.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, in_pieces, map_texts, memo, read_table, remainder, small_batches, sums, texts_of
from .quality import labelled_sample

#: Labelled documents of each class that the model is fitted on, at most.
FIT_PER_CLASS = 4000
#: A word or word start takes part if so many sampled documents have it and its share among the toxic ones is higher
#: by so many standard errors.
LEAST_DOCS, LEAST_Z = 5, 4.5
#: Letters of a word start, a feature of its own beside the whole word.
START = 5
STEPS, RATE, DECAY = 150, 0.3, 1e-4
THRESHOLD = 0.5

#: Runs of letters, or marks that end a sentence.
_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n\r\u2028\u2029。！？]+")
_ENDS = frozenset(".!?\n\r\u2028\u2029。！？")


def tokens_of(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def _keys(word: str) -> tuple[str, ...]:
    return (word, word[:START] + "*") if len(word) > START else (word,)


class Model:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, float(bias)
        self.key = "toxicity" + hashlib.sha256(repr((sorted(weights.items()), self.bias)).encode()).hexdigest()

    def word_values(self, words: Sequence[str]) -> np.ndarray:
        """For each token: its weight, and 1 if it ends a sentence."""
        get = self.weights.get
        return np.array([(0.0, 1.0) if w[0] in _ENDS else (sum(get(k, 0.0) for k in _keys(w)), 0.0) for w in words], np.float64).reshape(-1, 2)

    def sentences(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probability of each sentence, its document, number of sentences of each document).

        A document without any token has one empty sentence.
        """
        m = memo(self.key, self.word_values)
        rows, counts = m.rows([tokens_of(t) for t in texts])
        value = m.values[rows]
        ends = value[:, 1]
        within = np.cumsum(ends) - ends  # the ending mark belongs to its sentence
        n = sums(ends, counts).astype(np.int64) + 1
        first = np.cumsum(n) - n
        owner = np.repeat(np.arange(len(texts)), counts)
        base = np.concatenate([[0], np.cumsum(ends)])[np.cumsum(counts) - counts]
        sentence = (first[owner] + within - base[owner]).astype(np.int64)
        z = self.bias + np.bincount(sentence, value[:, 0], int(n.sum()))
        return 1 / (1 + np.exp(-z)), np.repeat(np.arange(len(texts)), n), n

    def scores(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(noisy-or of each document, index of its worst sentence)."""
        p, _, n = self.sentences(texts)
        clean = sums(np.log1p(-np.minimum(p, 1 - 1e-12)), n)
        starts = np.cumsum(n) - n
        top = np.maximum.reduceat(p, starts) if len(n) else np.zeros(0)
        at = np.flatnonzero(p == np.repeat(top, n))
        owner = np.repeat(np.arange(len(n)), n)[at]
        worst = np.zeros(len(n), np.int64)
        worst[owner[::-1]] = (at - starts[owner])[::-1]  # the first, if several are as bad
        return -np.expm1(clean), worst


def train(texts: Sequence[str], labels: Sequence[int], prior: float | None = None) -> Model:
    """Choose the words that mark toxic documents, then fit weights and bias by full-batch descent with per-weight steps.

    `prior`: share of toxic documents where the sample was drawn; documents are weighted so that their classes have it.
    """
    y = np.asarray(labels, np.float64)
    pos, neg = float(y.sum()), float((1 - y).sum())
    if not pos or not neg:
        return Model({}, np.log((pos + 0.5) / (neg + 0.5)))
    seen = [Counter(), Counter()]
    bags = [tokens_of(t) for t in texts]
    for bag, label in zip(bags, labels, strict=True):
        seen[int(label)].update({k for w in set(bag) for k in _keys(w)})
    chosen = []
    for k, a in seen[1].items():
        b = seen[0][k]
        share = (a + b) / (pos + neg)
        error = np.sqrt(share * (1 - share) * (1 / pos + 1 / neg)) or 1.0
        if a + b >= LEAST_DOCS and k[0] not in _ENDS and (a / pos - b / neg) / error >= LEAST_Z:
            chosen.append(k)
    index = {k: i for i, k in enumerate(sorted(chosen))}
    weight = np.zeros(len(index))
    # Sentences with a chosen word, as (sentence, feature) pairs; the others only have the bias, so a count will do.
    pair_s, pair_f, sentence_doc, plain = [], [], [], np.zeros(len(bags))
    for d, bag in enumerate(bags):
        found: set[int] = set()
        for w in [*bag, "."]:
            if w[0] not in _ENDS:
                found.update(index[k] for k in _keys(w) if k in index)
            elif found:
                pair_s += [len(sentence_doc)] * len(found)
                pair_f += found
                sentence_doc.append(d)
                found = set()
            else:
                plain[d] += 1
    s, f, owner = np.array(pair_s, np.int64), np.array(pair_f, np.int64), np.array(sentence_doc, np.int64)
    share = prior if prior is not None else pos / (pos + neg)
    cost = np.where(y == 1, share / pos, (1 - share) / neg) * (pos + neg)
    bias, square_w, square_b = -6.0, np.full(len(weight), 1e-8), 1e-8
    for step in range(STEPS):
        z = bias + np.bincount(s, weight[f], len(owner))
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-bias))
        clean = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), len(bags)) + plain * np.log1p(-p0)
        toxic = np.maximum(-np.expm1(clean), 1e-9)
        # By z of one sentence: p for a clean document, -p (1-P)/P for a toxic one.
        slope = cost * np.where(y == 1, -np.exp(clean) / toxic, 1.0)
        by_z = slope[owner] * p
        grad_w = np.bincount(f, by_z[s], len(weight)) / len(bags) + DECAY * weight
        grad_b = (by_z.sum() + (slope * plain).sum() * p0) / len(bags)
        square_w += grad_w**2
        square_b += grad_b**2
        weight -= RATE * 3 * grad_w / np.sqrt(square_w)
        bias -= RATE * grad_b / np.sqrt(square_b)
    return Model({k: float(weight[i]) for k, i in index.items() if abs(weight[i]) > 1e-3}, bias)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = FIT_PER_CLASS) -> Model:
    """Train on a bounded sample as in quality.labelled_sample(), at the share of toxic labels among all."""
    sample = labelled_sample(docs, labels, label, per_class)
    whole = labels.filter(F.col(label).isin(0, 1)).agg(F.avg(label)).first()[0]
    model = train(sample["text"].tolist(), sample["label"].tolist(), whole)
    del sample
    give_back()
    return model


def score(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The `keep` columns with score, predicted and worst_sentence (index of the likeliest).

    Null and empty texts have one empty sentence and so the score of the bias. Ties for the worst sentence go to the
    first. Empty tables stay empty, repeated rows score alike, texts are taken whole.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def compute(texts: list[str]) -> dict:
        value, worst = held.value.scores(texts)
        return {"score": value, "predicted": (value >= THRESHOLD).astype(np.int32), "worst_sentence": worst}

    return map_texts(docs, keep, "text", "score double, predicted int, worst_sentence bigint", compute)


#: One sentence with its closing marks, as tokens_of() and Model.sentences() divide a text.
_SENTENCE = re.compile(r"[^.!?\n\r\u2028\u2029。！？]*[.!?\n\r\u2028\u2029。！？]+|[^.!?\n\r\u2028\u2029。！？]+\Z")


def locate(docs: DataFrame, model: Model, least: float = THRESHOLD) -> DataFrame:
    """One row for each offending sentence (probability of at least `least`): doc_id, sentence, start, end, text, probability.

    Sentences are numbered and placed (in characters) within the whole text. Null and empty texts have none, a document
    without an offending one has no row, repeated rows give their sentences again, an empty table none; other columns are
    left out. A null id stays null.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in in_pieces(batches):
            texts = texts_of(batch)
            p, owner, n = held.value.sentences(texts)
            first = np.cumsum(n) - n
            rows, of, spans = [], -1, []
            for i in np.flatnonzero(p >= least):
                d = int(owner[i])
                if d != of:  # sentences come in order of their documents
                    of, spans = d, [m.span() for m in _SENTENCE.finditer(texts[d])]
                k = int(i - first[d])
                if k < len(spans):
                    a, b = spans[k]
                    rows.append((batch["doc_id"].iloc[d], k, a, b, texts[d][a:b].strip(), float(p[i])))
            yield pd.DataFrame(rows, columns=["doc_id", "sentence", "start", "end", "text", "probability"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, sentence bigint, start bigint, end bigint, text string, probability double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learnt from labels of ids whose crc32 mod 5 is not 0."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").filter(remainder("doc_id", 5) != 0)
    model = fit(docs, labels)
    return score(docs.withColumn("held_out", remainder("doc_id", 5) == 0), model, ("doc_id", "held_out"))
