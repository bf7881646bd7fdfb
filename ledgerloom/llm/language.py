"""Language ID: segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece of a public vocabulary. The likelihood of a word is the sum, over all
ways to cut it into pieces, of the product of their probabilities; a forward pass over the word's positions gives that
sum. The probabilities are fitted by expectation-maximisation over the same lattice, from a bounded sample of documents
of known language. Words of a document are independent, so each distinct word is worked out once per worker.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, bounded_texts, filter_texts, give_back, map_texts, memo, read_table, remainder, sums

VOCABULARY = "piece_bpe_32k.model"
#: Documents of each language that the probabilities are fitted on, at most.
FIT_PER_LANGUAGE = 600
#: Characters of theirs, at most.
FIT_CHARACTERS = 5_000_000
ROUNDS = 4
#: Added to the expected count of each piece, and of the piece that stands for one character outside the vocabulary.
SMOOTHING = 0.05
#: Documents whose language has a lower posterior than this, or that have no letter, are rejected by keep_known().
LEAST_SCORE = 0.5
NO_LANGUAGE = "und"

_WORD = re.compile(r"[^\W\d_]+")
#: The expression above lets numbers that are no digits through, such as fractions and Roman numerals.
_LETTERS = regex.compile(r"\p{L}+")
#: Longer words are gone through one by one, and take no part in the fit; a lattice of the others stays small.
LATTICE_LETTERS = 64
#: Words of one lattice: its arrays take about 10 MB.
LATTICE_WORDS = 5_000


def words_of(text: str) -> list[str]:
    """Runs of letters (Unicode category L), in lower case."""
    found = _WORD.findall(text.lower())
    return found if not found or "".join(found).isalpha() else _LETTERS.findall(" ".join(found))


@lru_cache(maxsize=2)
def vocabulary(path: str | None = None) -> dict[str, int]:
    """Pieces of the public vocabulary that are letters (with the word-start mark or not), numbered from 1; 0 is any
    other single character. The file is read on the machine that runs the task, as every tokenizer file is."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    pieces = sorted({p.lower() for p in pieces if _WORD.fullmatch(p.lstrip("▁")) and p.count("▁") <= 1})
    return {p: i for i, p in enumerate(pieces, 1)}


class Lattice:
    """All pieces of all given words: for each an edge from a position to a later one. Words are marked at the start."""

    def __init__(self, words: Sequence[str], pieces: dict[str, int], longest: int):
        word, start, end, piece = [], [], [], []
        get = pieces.get
        for w, text in enumerate(words):
            text = "▁" + text
            n = len(text)
            for i in range(n):
                single = True
                for j in range(i + 1, min(n, i + longest) + 1):
                    k = get(text[i:j])
                    if k is not None:
                        word.append(w), start.append(i), end.append(j), piece.append(k)
                        single = single and j != i + 1
                if single:
                    word.append(w), start.append(i), end.append(i + 1), piece.append(0)
        self.lengths = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        end_ = np.array(end, np.int64)
        order = np.argsort(end_, kind="stable")
        self.word, self.start, self.end, self.piece = (np.array(x, np.int32)[order] for x in (word, start, end, piece))
        self.cuts = np.searchsorted(self.end, np.arange(1, int(self.lengths.max(initial=0)) + 2))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """alpha[language, word, position]: summed probability of all segmentations of the part before the position.
        Longer words underflow only below 1e-300, which 65 positions cannot reach with smoothed probabilities."""
        size = len(self.lengths)
        alpha = np.zeros((p.shape[0], size, len(self.cuts) + 1))
        alpha[:, :, 0] = 1
        for j, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True), 1):
            if b > a:
                w = self.word[a:b]
                flow = alpha[:, w, self.start[a:b]] * p[:, self.piece[a:b]]
                for k in range(p.shape[0]):
                    alpha[k, :, j] = np.bincount(w, flow[k], size)
        return alpha

    def likelihoods(self, p: np.ndarray) -> np.ndarray:
        """log likelihood of each word (rows) in each language."""
        alpha = self.forward(p)
        return np.log(np.maximum(alpha[:, np.arange(len(self.lengths)), self.lengths], 1e-300)).T

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in each language, for words seen `counts[language, word]` times."""
        alpha = self.forward(p)
        total = alpha[:, np.arange(len(self.lengths)), self.lengths]
        beta = np.zeros_like(alpha)
        beta[:, np.arange(len(self.lengths)), self.lengths] = counts / np.maximum(total, 1e-300)
        out = np.zeros_like(p)
        for a, b in reversed(list(zip(self.cuts[:-1], self.cuts[1:], strict=True))):
            if b > a:
                w, i, piece = self.word[a:b], self.start[a:b], self.piece[a:b]
                flow = beta[:, w, self.end[a:b]] * p[:, piece]
                use = flow * alpha[:, w, i]
                at = w.astype(np.int64) * beta.shape[2] + i
                for k in range(p.shape[0]):
                    beta[k] += np.bincount(at, flow[k], beta[k].size).reshape(beta[k].shape)
                    out[k] += np.bincount(piece, use[k], p.shape[1])
        return out


def long_likelihood(word: str, p: np.ndarray, pieces: dict[str, int], longest: int) -> np.ndarray:
    """The log likelihood of one word of any length in each language: the same sum as Lattice.forward(), with the last
    `longest` positions alone in memory, scaled so that none underflows."""
    text = "▁" + word
    alpha, scale = [np.ones(p.shape[0])], np.zeros(p.shape[0])
    for j in range(1, len(text) + 1):
        single = pieces.get(text[j - 1 : j], 0)
        total = alpha[-1] * p[:, single]
        for n in range(2, len(alpha) + 1):
            k = pieces.get(text[j - n : j])
            if k is not None:
                total = total + alpha[-n] * p[:, k]
        alpha.append(total)
        if len(alpha) > longest:
            del alpha[0]
        if j % 32 == 0:
            top = np.maximum(np.max(alpha, axis=0), 1e-300)
            alpha, scale = [a / top for a in alpha], scale + np.log(top)
    return np.log(np.maximum(alpha[-1], 1e-300)) + scale


class Model:
    def __init__(self, languages: Sequence[str], p: np.ndarray, path: str | None = None):
        self.languages, self.p, self.path = list(languages), p.astype(np.float64), path
        self.key = "language" + hashlib.sha256(self.p.tobytes() + repr(self.languages).encode()).hexdigest()

    def word_values(self, words: Sequence[str]) -> np.ndarray:
        pieces = vocabulary(self.path)
        longest = max(map(len, pieces))
        out = np.zeros((len(words), len(self.languages)))
        short = [i for i, w in enumerate(words) if len(w) <= LATTICE_LETTERS]
        for a in range(0, len(short), LATTICE_WORDS):
            at = short[a : a + LATTICE_WORDS]
            out[at] = Lattice([words[i] for i in at], pieces, longest).likelihoods(self.p)
        for i, w in enumerate(words):
            if len(w) > LATTICE_LETTERS:
                out[i] = long_likelihood(w, self.p, pieces, longest)
        return out

    def predict(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(language, posterior under equal priors); NO_LANGUAGE and 0 for a text without letters or an empty model."""
        bags = [words_of(t) for t in texts]
        counts = np.fromiter(map(len, bags), np.int64, len(bags))
        none = np.full(len(bags), NO_LANGUAGE, object), np.zeros(len(bags))
        if not self.languages:
            return none
        m = memo(self.key, self.word_values)
        rows, _ = m.rows(bags)
        total = sums(m.values[rows], counts)
        best = total.argmax(axis=1)  # a tie goes to the first language in order of name
        score = 1 / np.exp(total - total[np.arange(len(best)), best][:, None]).sum(axis=1)
        return np.where(counts > 0, np.array(self.languages, object)[best], NO_LANGUAGE), np.where(counts > 0, score, 0.0)


def train(texts: Sequence[str], languages: Sequence[str], path: str | None = None, rounds: int = ROUNDS) -> Model:
    pieces = vocabulary(path)
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((0, len(pieces) + 1)), path)
    seen = {n: Counter() for n in names}
    for t, lang in zip(texts, languages, strict=True):
        seen[lang].update(words_of(t))
    words = sorted(w for w in set().union(*seen.values()) if len(w) <= LATTICE_LETTERS)
    counts = np.array([[seen[n][w] for w in words] for n in names], np.float64)
    p = np.full((len(names), len(pieces) + 1), 1 / (len(pieces) + 1))
    longest = max(map(len, pieces))
    lattices = [(Lattice(words[i : i + LATTICE_WORDS], pieces, longest), counts[:, i : i + LATTICE_WORDS]) for i in range(0, len(words), LATTICE_WORDS)]
    for _ in range(rounds):
        use = sum((lattice.expected(p, part) for lattice, part in lattices), np.zeros_like(p)) + SMOOTHING
        p = use / use.sum(axis=1, keepdims=True)
    return Model(names, p, path)


def fit(docs: DataFrame, per_language: int = FIT_PER_LANGUAGE, path: str | None = None) -> Model:
    """Fit on at most `per_language` documents, and FIT_CHARACTERS of them, of each language in the column lang.

    Null languages and ids take no part, an id with two languages has the first by name, null texts are empty; an empty
    table gives a model that knows no language."""
    keys = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("lang").alias("_lang"))
    picked = bounded_sample(keys, "_lang", per_language)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    rows = bounded_texts(rows, "_lang", FIT_CHARACTERS).toPandas().sort_values(["doc_id", "text"])
    model = train(rows["text"].tolist(), rows["_lang"].tolist(), path)
    del rows
    give_back()
    return model


def predict(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The `keep` columns with lang_pred and score. Null texts and texts without a letter are `und` with score 0.

    Empty tables stay empty, repeated rows are predicted alike, texts are taken whole; columns that are not in `keep`
    never reach the prediction.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    compute = lambda texts: dict(zip(("lang_pred", "score"), held.value.predict(texts), strict=True))
    return map_texts(docs, keep, "text", "lang_pred string, score double", compute)


def keep_known(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of `docs` whose language has a posterior of at least `least`, with their own columns, whatever these are called.

    Null texts and texts without a letter go; a model that knows no language keeps all others. Repeated rows stay or go
    together, an empty table stays empty, texts are taken whole."""
    if not model.languages:
        return docs.filter(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    return filter_texts(docs, "text", lambda texts: held.value.predict(texts)[1] >= least)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those whose crc32 of the id mod 3 is not 1."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(remainder("doc_id", 3) != 1))
    return predict(docs.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "text"), model, ("doc_id", "held_out"))
