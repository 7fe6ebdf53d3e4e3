"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence has a probability from a
logistic model over its features, and the document's is their noisy-or: hazards, -log(1 - p), add up.
Clean sentences have faint signs too, and thousands of them must not make a text toxic.  So hazards count
in excess of clean sentences' only: what a sentence has beyond the `usual` hazard (that
one clean sentence in ten thousand passes) counts in full; up to there, the sum over the
document counts as far as it passes twice what as many clean sentences have on average and
three standard deviations more.  One bad sentence is enough, then, at any length, and clean ones
neither dilute it nor add up.  The model is trained from document labels alone, by gradient steps on
the likelihood of that noisy-or; afterwards the sentences' own hazards show where the fault lies.

Features are the lower-cased word and its beginnings of three to seven letters,
so inflected forms of a word share weight; a sentence has a set of them, in training as in scoring.
A feature is taken up if it occurs in `min_docs` training documents and is commoner in
toxic ones by `least_z` standard deviations of a likelihood-ratio test; weights are not negative,
so nothing makes up for a bad sentence.  Training takes place on the driver from a bounded
sample (`max_toxic` + `max_clean` labelled rows, by a hash of their id, and `max_bytes` of text);
the model, some thousand weights, goes to the workers with the function.

Edge cases: null and empty texts score as a clean one does (1e-4); repeated labels of an
id count as toxic if one says so; null labels and ids are not learned from; with
no toxic or no clean label everything scores the share of toxic ones; texts
of any length are read whole; spans are in the text as it stands; repeated rows score
alike; an empty table gives an empty result; names of other columns can't clash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, table, training_texts

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """Of a lower-cased word."""
    return [word, *(word[:n] + "*" for n in (3, 4, 5, 6, 7) if len(word) >= n)]


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Spans of the sentences that hold a word."""
    return [m.span() for m in SENTENCE.finditer(text or "") if WORD.search(m[0])]


def sentence_words(text: str | None) -> Iterator[tuple[int, int, set[str]]]:
    """(start, end, its lower-cased words) of each sentence that has a word."""
    for m in SENTENCE.finditer(text or ""):
        words = set(WORD.findall(m[0].lower()))
        if words:
            yield *m.span(), words


PRIOR = 1e-4  # hazard of a document without signs
TIMES, DEVIATIONS = 2.0, 3.0  # of what clean sentences have; clean texts differ, in language above all


class Clean:
    """Hazards of clean sentences: the usual most, and mean and variance up to there."""

    def __init__(self, usual: float = 0.0, mean: float = 0.0, variance: float = 0.0):
        self.usual, self.mean, self.variance = usual, mean, variance

    @classmethod
    def of(cls, hazards: np.ndarray, n: int) -> Clean:
        """From the hazards of n clean sentences (those not listed have none), and one more of 0.5, as others will have what these lack."""
        hazards = np.append(hazards, 0.5)
        rank = int(n * 1e-4)  # so many may pass
        usual = float(np.partition(hazards, len(hazards) - 1 - rank)[len(hazards) - 1 - rank]) if len(hazards) > rank else 0.0
        h = np.minimum(hazards, usual)
        mean = h.sum() / n
        return cls(usual, float(mean), float((h**2).sum() / n - mean**2))

    def expected(self, n):
        """What n clean sentences may have in sum."""
        return TIMES * self.mean * n + DEVIATIONS * np.sqrt(self.variance * n)


class Model:
    """Weights of features, log odds of a sentence without any, what clean sentences have; share: what every text scores where there was nothing to learn."""

    def __init__(self, weights: dict[str, float], intercept: float, clean: Clean, share: float | None = None):
        self.weights, self.intercept, self.clean, self.share = weights, intercept, clean, share
        self.known: dict[str, tuple[str, ...]] = {}
        self.nothing = float(np.logaddexp(0, intercept))

    def __getstate__(self):
        return self.weights, self.intercept, self.clean, self.share

    def __setstate__(self, state):
        self.__init__(*state)

    def telling(self, word: str) -> tuple[str, ...]:
        """Features of a lower-cased word that have weight."""
        found = self.known.get(word)
        if found is None:
            found = tuple(f for f in features(word) if f in self.weights)
            if len(self.known) < 100_000:
                self.known[word] = found
        return found

    def hazard(self, words: set[str]) -> float:
        """Of a sentence, beyond one without features."""
        known, own = self.known.get, set()
        for w in words:
            x = known(w)
            own.update(self.telling(w) if x is None else x)
        return float(np.logaddexp(0, self.intercept + sum(self.weights[f] for f in sorted(own)))) - self.nothing if own else 0.0

    def score(self, text: str | None) -> tuple[float, int, int, float]:
        """(document's probability, start and end of its worst sentence, that sentence's probability); spans are 0 if none has a sign."""
        if self.share is not None:
            return self.share, 0, 0, 0.0
        n, over, under, worst, at = 0, PRIOR, 0.0, 0.0, (0, 0)
        usual = self.clean.usual
        for start, end, words in sentence_words(text):
            n += 1
            h = self.hazard(words)
            if h:
                over += max(h - usual, 0.0)
                under += min(h, usual)
                if h > worst:
                    worst, at = h, (start, end)
        total = over + max(under - float(self.clean.expected(n)), 0.0)
        return -float(np.expm1(-total)), *at, -float(np.expm1(-worst))


_BUCKETS = 1 << 22


def _association(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> np.ndarray:
    """Signed root of the likelihood-ratio statistic: over 0 if a feature is commoner in toxic documents than in clean ones."""
    g = np.zeros(len(clean))
    both = (clean + toxic) / (n_clean + n_toxic)
    for seen, of in ((clean, n_clean), (toxic, n_toxic)):
        for o, e in ((seen, both * of), (of - seen, (1 - both) * of)):
            g += np.where(o > 0, o * np.log(np.maximum(o, 1e-300) / np.maximum(e, 1e-300)), 0)
    return np.sqrt(np.maximum(2 * g, 0)) * np.where(toxic * n_clean > clean * n_toxic, 1, -1)


def _telling(texts: list[str | None], y: np.ndarray, min_docs: int, least_z: float) -> tuple[dict[str, list[int]], list[str]]:
    """(word -> numbers of its features that are taken up, features by number).

    Features are first counted in hashed buckets, of which there is a fixed number, and
    only those in a telling bucket are then counted by name; a few thousand are left of millions.
    """
    number: dict[str, int] = {}
    own = []  # numbers of each document's distinct words
    for t in texts:
        words = set(WORD.findall((t or "").lower()))
        own.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
    bucket = np.full((len(number), len(features("x" * 9))), _BUCKETS, np.int32)
    for w, i in number.items():
        for k, f in enumerate(features(w)):
            bucket[i, k] = zlib.crc32(f.encode()) % _BUCKETS
    n_clean, n_toxic = int((~y).sum()), int(y.sum())

    def telling(counts: np.ndarray) -> np.ndarray:
        clean, toxic = counts
        out = clean + toxic >= min_docs
        at = np.flatnonzero(out)
        out[at] = _association(clean[at], toxic[at], n_clean, n_toxic) >= least_z
        return out

    counts = np.zeros((2, _BUCKETS + 1), np.int32)
    for words, bad in zip(own, y.tolist()):
        counts[int(bad), np.unique(bucket[words])] += 1
    counts[:, _BUCKETS] = 0
    may = telling(counts)[bucket]
    names: dict[str, int] = {}
    held: dict[int, list[int]] = {}  # word number -> features by name
    every = list(number)
    for i in np.flatnonzero(may.any(axis=1)).tolist():
        held[i] = [names.setdefault(f, len(names)) for k, f in enumerate(features(every[i])) if may[i, k]]
    counts = np.zeros((2, len(names)), np.int32)
    for words, bad in zip(own, y.tolist()):
        counts[int(bad), sorted({f for w in words.tolist() if w in held for f in held[w]})] += 1
    taken = telling(counts)
    return {every[i]: kept for i, fs in held.items() if (kept := [f for f in fs if taken[f]])}, list(names)


def train(texts: list[str | None], toxic: list[int], min_docs: int = 4, least_z: float = 3.5, rounds: int = 300, rate: float = 0.4, l2: float = 2e-6, intercept: float = -3.0) -> Model:
    """Noisy-or model from document labels; AdaGrad over all documents in each round."""
    y = np.array(toxic, bool)
    if not len(y) or y.all() or not y.any():
        return Model({}, intercept, Clean(), float(y.mean()) if len(y) else 0.0)
    of_word, names = _telling(texts, y, min_docs, least_z)
    doc, sentence, feature, n, sizes = [], [], [], 0, np.zeros(len(y))
    for d, t in enumerate(texts):
        for _, _, words in sentence_words(t):
            sizes[d] += 1
            own = {f for w in words if w in of_word for f in of_word[w]}
            if own:  # others have no hazard
                doc.append(d)
                feature += own
                sentence += [n] * len(own)
                n += 1
    doc, sentence, feature = np.array(doc, np.int64), np.array(sentence, np.int64), np.array(feature, np.int64)
    weights, g2 = np.zeros(len(names)), np.full(len(names), 1e-8)
    each = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())  # both kinds of documents weigh alike
    nothing, n_clean = np.logaddexp(0, intercept), max(sizes[~y].sum(), 1)

    def hazards(z: np.ndarray) -> tuple[np.ndarray, Clean]:
        h = np.logaddexp(0, z) - nothing
        return h, Clean.of(h[~y[doc]], n_clean)

    for _ in range(rounds):
        z = intercept + np.bincount(sentence, weights[feature], n)
        h, clean = hazards(z)
        spare = np.bincount(doc, np.minimum(h, clean.usual), len(y)) - clean.expected(sizes)
        total = PRIOR + np.bincount(doc, np.maximum(h - clean.usual, 0), len(y)) + np.maximum(spare, 0)
        pull = np.where(y, -1 / np.expm1(np.clip(total, 1e-2, 50)), 1.0) * each
        moves = (h > clean.usual) | (spare > 0)[doc] | y[doc]  # a clean document within what is usual is left alone
        grad = np.bincount(feature, (pull[doc] * moves / (1 + np.exp(-z)))[sentence], len(names)) + l2 * weights
        g2 += grad**2
        weights = np.maximum(weights - rate * grad / np.sqrt(g2), 0)
    weights[weights <= 1e-3] = 0
    clean = hazards(intercept + np.bincount(sentence, weights[feature], n))[1]
    return Model({names[i]: float(weights[i]) for i in np.flatnonzero(weights)}, intercept, clean)


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = 1500, max_clean: int = 3000, max_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text", learn=None) -> Model:
    """Model from labels (id, toxic 0/1) of a bounded sample; learn: a condition that label rows must meet."""
    marked = labels.filter(F.col(id_col).isNotNull() & F.col("toxic").isNotNull())
    marked = marked if learn is None else marked.filter(learn)
    marked = marked.groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    chosen = [bounded_sample(marked.filter(F.col("toxic") == y), id_col, n) for y, n in ((1, max_toxic), (0, max_clean))]
    rows = training_texts(docs, chosen[0].unionByName(chosen[1]), id_col, text_col, max_toxic + max_clean, max_bytes)
    return train([t for _, t, _ in rows], [y for _, _, y in rows])


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, worst_start, worst_end, worst_score) of every row; the span is of the worst sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(zip(*(model.score(t.as_py()) for t in b.column(1)))) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip(found, (pa.float64(), pa.int64(), pa.int64(), pa.float64())))], [id_col, "score", "worst_start", "worst_end", "worst_score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, worst_start long, worst_end long, worst_score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """docs, all columns, without rows that score threshold or more."""
    schema = docs.schema
    at = schema.names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([model.score(t.as_py())[0] < threshold for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, schema)


def learnable(id_col: str = "doc_id"):
    """Label rows that may be learned from: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1


def op9_toxicity_mil(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; a third of the ids is held out from learning."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), learn=learnable())
    scored = score_documents(docs, model)
    return scored.select("doc_id", F.coalesce(~learnable(), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "worst_start", "worst_end", "worst_score")
