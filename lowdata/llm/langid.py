"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything but letters becomes one space, and all n-grams of
1 to ``MAX_N`` characters inside a word with a space on each side are hashed into a fixed number
of buckets.  Counts of (language, bucket) come from all training texts: each task adds up
dense counts in numpy and emits only its non-zero cells, which Spark sums.  The matrix of log
probabilities is broadcast; its cells are bounded by ``MAX_CELLS`` (the number of buckets is halved while
languages x buckets exceeds it), so nothing that is broadcast or sent to the driver grows with the corpus.  Scoring reads
whole texts inside the scan's own partitions, some ``CHUNK`` characters at a time, as sparse rows.

Edge cases: a text that is null or has no letter is ``und`` with score 0; without any training
row every text is; rows with null language or null text teach nothing, an empty language name is a
name like any other; equal scores go to the first language by name; very long texts are scored piece by piece; repeated rows
and null ids keep one row each; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lowdata.llm.common import texts_of

MAX_N = 3
BUCKETS = 1 << 16
MAX_CELLS = 1 << 22  # of languages x buckets
MIN_BUCKETS = 1 << 8
ALPHA = 0.5
CHUNK = 1 << 18  # characters hashed at once
HELD_LANGUAGES = 64  # dense count rows of a task before they are emitted
NONE = "und"
MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)  # odd multipliers, one an n-gram length
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters; made once a worker."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def _pieces(texts: list[str | None]):
    """(codes, rows): some texts as code points between spaces, or a part of a long one.

    Parts of one text overlap by MAX_N - 1 characters, in which no n-gram begins.
    """
    codes, rows, size = [], [], 0
    for row, t in enumerate(texts):
        whole = np.frombuffer(f" {t or ''} ".lower().encode("utf-32-le", "replace"), dtype=np.uint32)
        for at in range(0, len(whole), CHUNK):
            part = whole[at:at + CHUNK + MAX_N - 1]
            if size and size + len(part) > CHUNK:
                yield np.concatenate(codes), np.concatenate(rows)
                codes, rows, size = [], [], 0
            codes.append(part)
            rows.append(np.full(len(part), row, np.int32))
            if at + CHUNK < len(whole):
                rows[-1][CHUNK:] = -1
            size += len(part)
    if size:
        yield np.concatenate(codes), np.concatenate(rows)


def ngrams(texts: list[str | None], buckets: int):
    """(rows, cells): the row and bucket of every n-gram, some texts at a time."""
    letter = _letters()
    shift = np.uint32(33 - int(buckets).bit_length())
    for codes, rows in _pieces(texts):
        is_letter = letter[codes]
        c = np.where(is_letter, codes, np.uint32(32))
        h = np.zeros(len(c), np.uint32)
        some_rows, some_cells = [], []
        for n in range(1, MAX_N + 1):
            m = len(c) - n + 1
            if m <= 0:
                break
            h = (h[:m] ^ c[n - 1:]) * MIX[n - 1]
            h ^= h >> np.uint32(15)
            ok = is_letter[:m].copy() if n == 1 else np.ones(m, bool)
            for i in range(1, n - 1):
                ok &= is_letter[i:i + m]
            if n == 2:
                ok &= is_letter[:m] | is_letter[1:1 + m]
            ok &= rows[:m] >= 0
            at = np.flatnonzero(ok)
            some_rows.append(rows[at])
            some_cells.append(((h[at] * MIX[0]) >> shift).astype(np.int32))
        yield np.concatenate(some_rows), np.concatenate(some_cells)


class Model:
    """Languages by name, log priors and the broadcast matrix of log probabilities (bucket x language)."""

    def __init__(self, names: list[str], priors: np.ndarray, matrix: np.ndarray):
        self.names, self.priors, self.matrix = names, priors, matrix

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and its posterior probability for every text."""
        known = np.zeros(len(texts), bool)
        total = np.tile(self.priors, (len(texts), 1))
        for rows, cells in ngrams(texts, len(self.matrix)):
            known[rows] = True
            for lang in range(len(self.names)):
                total[:, lang] += np.bincount(rows, weights=self.matrix[cells, lang], minlength=len(texts))
        if not self.names:
            return [NONE] * len(texts), [0.0] * len(texts)
        best = total.argmax(1)
        top = total[np.arange(len(texts)), best]
        p = 1 / np.exp(total - top[:, None]).sum(1)
        return ([self.names[b] if k else NONE for b, k in zip(best, known)], np.where(known, p, 0.0).tolist())


def _count(buckets: int):
    """Adds up (lang, cell, n) of a partition; cell -1 is the number of texts."""
    def emit(held):
        for name, row in held.items():
            cells = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(cells), pa.string()), pa.array(cells - 1, pa.int32()), pa.array(row[cells], pa.int64())],
                                             names=["lang", "cell", "n"])

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for b in texts_of(batches):
            langs = np.array(b.column("lang").to_pylist(), dtype=object)
            texts = b.column("text").to_pylist()
            for name in dict.fromkeys(langs):
                if name not in held and len(held) == HELD_LANGUAGES:
                    yield from emit(held)
                    held = {}
                row = held.setdefault(name, np.zeros(buckets + 1, np.int64))
                mine = [texts[i] for i in np.flatnonzero(langs == name)]
                row[0] += len(mine)
                for _, cells in ngrams(mine, buckets):
                    row[1:] += np.bincount(cells, minlength=buckets)
        yield from emit(held)
    return run


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", buckets: int = BUCKETS, alpha: float = ALPHA) -> Model:
    """Counts over all rows with a language and a text; at most MAX_CELLS sums reach the driver."""
    src = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    n_lang = src.select("lang").distinct().count()
    while n_lang * buckets > MAX_CELLS and buckets > MIN_BUCKETS:
        buckets //= 2
    if n_lang * buckets > MAX_CELLS:
        raise ValueError(f"{n_lang} language names; at most {MAX_CELLS // MIN_BUCKETS} can be told apart")
    sums = src.mapInArrow(_count(buckets), "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    names, counts, texts = [], {}, {}
    for b in sums.toArrow().to_batches():
        langs, cells, n = b.column("lang").dictionary_encode(), b.column("cell").to_numpy(), b.column("n").to_numpy()
        for at, name in enumerate(langs.dictionary.to_pylist()):
            mine = langs.indices.to_numpy() == at
            row = counts.setdefault(name, np.zeros(buckets))
            row[cells[mine & (cells >= 0)]] += n[mine & (cells >= 0)]
            texts[name] = texts.get(name, 0) + int(n[mine & (cells < 0)].sum())
    names = sorted(counts)
    if not names:
        return Model([], np.zeros(0), np.zeros((buckets, 0)))
    table = np.stack([counts[k] for k in names], axis=1) + alpha
    priors = np.log(np.array([texts[k] for k in names], dtype=float) / sum(texts.values()))
    return Model(names, priors, np.log(table / table.sum(0)))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) per input row; score is the posterior probability of the language."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in texts_of(batches):
            lang, score = shared.value.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, lang_pred string, score double")
