"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence has probability
p = sigmoid(bias + sum of its features' weights); a document is toxic with probability
1 - prod(1 - p) (noisy-or).  Weights are learned from document labels alone, by
gradient descent on the noisy-or likelihood, on a bounded sample of labelled
documents (``max_train`` of each label, by hash of the id); scoring reads every
whole text inside the scan's own partitions and shuffles nothing.  ``locate``
returns the sentences whose own probability reaches the threshold.

Features of a sentence: its lower-cased words and their beginnings of 3 to 6
letters (inflected languages), those found in at least ``min_docs`` sample documents.

Edge cases: null, empty and wordless texts have no sentence and score 0; very long
texts are processed sentence by sentence; repeated rows score alike; without labelled
rows of both kinds every score is the share of toxic labels; further columns
(also ones named like the output) are ignored.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lowdata.llm.common import by_text, store, texts_of

SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]?")
BREAK = re.compile(r"[.!?\n]")
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6)
MAX_TRAIN, MIN_DOCS, EPOCHS, L1 = 2500, 3, 20, 5e-5
MIN_STEPS = 400  # of gradient, however small the sample
FIRST_BIAS = -9.0  # a sentence of unknown words is hardly ever toxic


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Spans (code points) of the non-blank sentences."""
    return [m.span() for m in SENTENCE.finditer(text or "") if m.group().strip()]


def features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}~" for k in PREFIXES if len(word) >= k)]


def bag(text: str | None) -> list[set[str]]:
    """Feature sets of the sentences that have a word."""
    out = []
    for s, e in sentences(text):
        words = set(WORD.findall(text[s:e].lower()))
        if words:
            out.append(set(chain.from_iterable(map(features, words))))
    return out


class _Hits(dict):
    """word -> its features that have a weight; filled as words are met, emptied when it grows large."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) > 200_000:
            self.clear()
        got = self[word] = tuple(f for f in features(word) if f in self.weights)
        return got


class Model:
    """weights: feature -> weight; bias; the score of a document without any sentence is 0."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.hits = weights, bias, _Hits(weights)

    def __reduce__(self):
        return Model, (self.weights, self.bias)

    def sentence(self, lowered: str) -> float | None:
        """Log-odds of one lower-cased sentence; None if it has no word."""
        words = WORD.findall(lowered)
        if not words:
            return None
        met = set(chain.from_iterable(map(self.hits.__getitem__, words)))
        return self.bias + sum(map(self.weights.__getitem__, sorted(met))) if met else self.bias

    def sentence_scores(self, text: str | None) -> list[tuple[int, int, float]]:
        spans = [(s, e, self.sentence(text[s:e].lower())) for s, e in sentences(text)]
        return [(s, e, 1 / (1 + np.exp(-z))) for s, e, z in spans if z is not None]

    def score(self, text: str | None) -> float:
        z = np.array([v for part in BREAK.split((text or "").lower()) if (v := self.sentence(part)) is not None])
        return float(-np.expm1(-np.logaddexp(0, z).sum())) if len(z) else 0.0


def fit(texts: list[str], labels: list[int], share: float | None = None, min_docs: int = MIN_DOCS, epochs: int = EPOCHS, l1: float = L1) -> Model:
    """Noisy-or maximum likelihood by AdaGrad over documents, with a shrinkage that zeroes idle weights.

    ``share`` is the share of label 1 among all labelled rows; the bias is chosen last, by the
    likelihood of the sample weighted to that share, so that long clean documents
    don't gather probability from their many sentences.
    """
    y = np.array(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Model({}, float(np.log(p / (1 - p))))
    df: dict[str, int] = {}
    for t in texts:  # twice over the texts instead of keeping every feature as text
        for f in set().union(*bag(t)):
            df[f] = df.get(f, 0) + 1
    index = {f: i for i, f in enumerate(sorted(f for f, n in df.items() if n >= min_docs))}
    del df
    docs = []
    for t in texts:
        ids = [np.array(sorted(index[f] for f in s if f in index), dtype=np.int32) for s in bag(t)]
        docs.append((np.concatenate(ids) if ids else np.empty(0, np.int32),
                     np.repeat(np.arange(len(ids), dtype=np.int32), [len(i) for i in ids]), len(ids)))
    w, g2 = np.zeros(len(index)), np.full(len(index), 1e-8)
    bias = FIRST_BIAS
    order = np.random.default_rng(7).permutation(len(docs))
    step = 0.3
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    for _ in range(max(epochs, MIN_STEPS * 32 // len(order))):
        for k in range(0, len(order), 32):
            some = [i for i in order[k:k + 32] if docs[i][2]]
            cols, rows, grads = [], [], []
            n = 0
            for i in some:
                f, s, m = docs[i]
                cols.append(f)
                rows.append(s + n)
                n += m
            if not n:
                continue
            f, s = np.concatenate(cols), np.concatenate(rows)
            z = np.bincount(s, weights=w[f], minlength=n) + bias
            p = 1 / (1 + np.exp(-z))
            ends = np.cumsum([docs[i][2] for i in some])
            safe = np.add.reduceat(np.logaddexp(0, z), np.concatenate(([0], ends[:-1])))  # -log of "no sentence is toxic"
            grads = np.where(y[some] == 1, 1 / np.maximum(np.expm1(np.minimum(safe, 50)), 1e-9), -1.0) * weight[some]
            gz = np.clip(np.repeat(grads, [docs[i][2] for i in some]) * p, -1, 1)
            gw = np.bincount(f, weights=gz[s], minlength=len(w))
            hit = np.flatnonzero(gw)
            g2[hit] += gw[hit] ** 2
            rate = step / np.sqrt(g2[hit])
            w[hit] += rate * gw[hit]
            w[hit] = np.sign(w[hit]) * np.maximum(np.abs(w[hit]) - rate * l1 * len(some), 0)
    some = [i for i in range(len(docs)) if docs[i][2]]
    counts = np.array([docs[i][2] for i in some])
    z = np.concatenate([np.bincount(docs[i][1], weights=w[docs[i][0]], minlength=docs[i][2]) for i in some])
    starts, toxic = np.cumsum(counts) - counts, y[some] == 1
    share = y.mean() if share is None else share
    mass = np.where(toxic, share / max(toxic.sum(), 1), (1 - share) / max((~toxic).sum(), 1))

    def likelihood(b: float) -> float:
        safe = np.add.reduceat(np.logaddexp(0, z + b), starts)
        return float((mass * np.where(toxic, np.log(np.maximum(-np.expm1(-safe), 1e-12)), -safe)).sum())

    bias = max(np.arange(-16.0, -1.9, 0.25), key=likelihood)
    keep = np.flatnonzero(np.abs(w) > 1e-3)
    names = list(index)
    return Model({names[i]: float(w[i]) for i in keep}, float(bias))


def train(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text",
          max_train: int = MAX_TRAIN, **kw) -> Model:
    """Fit on at most ``max_train`` documents of each label: those first by a hash of the id.

    The sample is chosen from ids and labels alone, then its texts are fetched, one of each id (the first
    by a hash of the text); both parts are bounded by 2 * max_train rows, whatever the size of the corpus.
    """
    ids = docs.select(F.col(id_col).alias("id"))
    lab = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and id is not null")
    order = F.xxhash64("id")
    known = store(lab.join(ids, "id", "left_semi"), "toxicity-labels")
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    parts = [known.where(F.col("y") == v).orderBy(order, "id").limit(max_train) for v in (0, 1)]
    chosen = {r["id"]: r["y"] for r in parts[0].unionByName(parts[1]).collect()}
    if not chosen:
        return fit([], [])
    picked = docs.sparkSession.createDataFrame(sorted(chosen), ids.schema["id"].dataType).toDF("id")
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id", "left_semi")
            .groupBy("id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).orderBy("id").toLocalIterator())
    texts, y = [], []
    for r in rows:
        texts.append(r["text"])
        y.append(chosen[r["id"]])
    return fit(texts, y, counts.get(1, 0) / sum(counts.values()), **kw)


def score_column(model: Model, text_col: str = "text"):
    """Column of document scores (Pandas UDF over the text)."""
    @F.pandas_udf("double")
    def toxic(text):  # noqa: ANN001
        import pandas as pd
        return pd.Series([model.score(t) for t in text], dtype=float)
    return toxic(F.col(text_col))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) per input row."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    run = by_text(lambda texts: [[model.score(t) for t in texts]], "text", ["score"], [pa.float64()], ["id"])
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, score double")


def locate(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, start, end, score, sentence): the offending sentences, spans in code points."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in texts_of(batches):
            ids, out = b.column("id"), []
            for i, t in enumerate(b.column("text").to_pylist()):
                out += [(i, s, e, float(p), t[s:e]) for s, e, p in model.sentence_scores(t) if p >= threshold]
            i, s, e, p, x = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(i, pa.int64())), pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(p, pa.float64()), pa.array(x, pa.string())],
                names=["id", "start", "end", "score", "sentence"])
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, start bigint, end bigint, score double, sentence string")
