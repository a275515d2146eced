"""Periodic runs in word sequences by the branching-tandem test on an enhanced suffix array.

A run is a stretch of consecutive words with smallest period q and at least
``max(min_words, min_periods * q)`` words that no neighbouring word extends keeping the period.

Whole texts are taken a few at a time within the scan's own partitions (nothing is
shuffled); a task holds one suffix array of about ``CHUNK_WORDS`` words, or of one longer text.
Words are numbered anew in every text, so suffixes of two texts share no prefix.

* The suffix array comes from prefix doubling; only groups that are not yet apart are
  sorted again.  The ranks of every doubling step are kept: they tell in one lookup whether two stretches are equal.
* Every LCP interval of depth l is met through the boundaries between its children.  For
  the suffixes i of the smaller side of a boundary, ISA[i + l] and ISA[i - l] are looked up: where they lie on the
  other side, the two suffixes start a square of period l whose next word differs
  (branching tandem).  Intervals are index ranges; no tree is built.
* The squares are rotated to the left as far as the words allow, and squares of one
  stretch (also those of a multiple of its period) merge into one run with the least period.

Edge cases: null, empty and blank texts have no words and no run; repeated rows and null ids keep one row each; ties between
runs are broken by start, then period; very long texts are one suffix array of their own
(some 4 bytes a word for each doubling of the longest repeat); empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lowdata.llm.common import texts_of

MIN_WORDS, MIN_PERIODS = 6, 4
CHUNK_WORDS = 1 << 17
SLAB = 1 << 20  # suffixes tested at once


def split_words(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` as UTF-8."""
    return (text or "").encode().split()


class SuffixOrder:
    """Suffix array, its inverse, LCP values and the ranks of every doubling step."""

    def __init__(self, symbols: np.ndarray, ends: np.ndarray):
        """``ends[i]``: where the text of position i ends; texts share no symbol."""
        n = len(symbols)
        self.ends, self.n = ends, n
        sa = np.argsort(symbols, kind="stable")
        new = np.ones(n, bool)
        new[1:] = symbols[sa][1:] != symbols[sa][:-1]
        place = np.arange(n)
        rank = np.empty(n, np.int32)
        rank[sa] = np.maximum.accumulate(np.where(new, place, 0))
        steps, apart = [rank], np.where(new, 0, -1)
        h = 1
        while not new.all():
            alone = new & np.append(new[1:], True)
            at = np.flatnonzero(~alone)
            i = sa[at]
            far = i + h
            key = rank[i].astype(np.int64) * (n + 1) + np.where(far < ends[i], rank[np.minimum(far, n - 1)], -1) + 1
            order = np.argsort(key, kind="stable")
            sa[at], key = i[order], key[order]
            split = np.ones(len(at), bool)
            split[1:] = key[1:] != key[:-1]
            rank = rank.copy()
            rank[sa[at]] = np.maximum.accumulate(np.where(split, at, 0))
            fresh = at[split & ~new[at]]
            new[fresh], apart[fresh] = True, len(steps)
            steps.append(rank)
            h *= 2
        self.sa, self.isa, self.steps = sa, rank, steps
        lcp = np.where(apart > 0, 1 << np.maximum(apart - 1, 0), 0).astype(np.int64)
        for level in range(len(steps) - 2, -1, -1):
            k = np.flatnonzero(apart >= level + 2)
            a, b = sa[k - 1] + lcp[k], sa[k] + lcp[k]
            ok = (a < ends[sa[k - 1]]) & (b < ends[sa[k]])
            k, a, b = k[ok], a[ok], b[ok]
            lcp[k[steps[level][a] == steps[level][b]]] += 1 << level
        self.lcp = lcp

    def common_before(self, a: np.ndarray, b: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Number of equal words right before a and b (a < b, of the text that starts at ``starts``)."""
        a, b = a.copy(), b.copy()
        first = a.copy()
        for level in range(len(self.steps) - 1, -1, -1):
            w = 1 << level
            ok = np.flatnonzero(a - w >= starts)
            ok = ok[self.steps[level][a[ok] - w] == self.steps[level][b[ok] - w]]
            a[ok] -= w
            b[ok] -= w
        return first - a


def _nearest(v: np.ndarray, at: np.ndarray, step: int, past) -> np.ndarray:
    """For the indices ``at``: the nearest index in direction ``step`` with not past(its value, the value here)."""
    to = np.arange(len(v)) + step
    to[0], to[-1] = 0, len(v) - 1
    left = at[past(v[to[at]], v[at])]
    while len(left):  # a pointer may be followed before it is final: all it skips is past the value here, too
        to[left] = to[to[left]]
        left = left[past(v[to[left]], v[left])]
    return to[at]


def branching_squares(s: SuffixOrder, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the squares whose two halves are followed by different words; ``longest[i]``: greatest period of use at i."""
    v = np.concatenate((s.lcp, [-1]))
    v[0] = -1
    k = np.flatnonzero(v > 0)
    lo = _nearest(v, k, -1, np.greater_equal)
    hi = _nearest(v, k, 1, np.greater)
    # a run of enough periods has all its earlier suffixes on one side
    use = (np.maximum(k - lo, hi - k) >= MIN_PERIODS - 1) & (v[k] <= longest[s.sa[k]])
    k, lo, hi = k[use], lo[use], hi[use]
    left = k - lo <= hi - k
    first, size = np.where(left, lo, k), np.where(left, k - lo, hi - k)
    other, other_end = np.where(left, k, lo), np.where(left, hi, k)
    depth, upto = v[k], np.cumsum(size)
    starts, periods, begin = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    while begin < len(k):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + SLAB, side="right")))
        m = size[begin:end]
        node = np.repeat(np.arange(begin, end), m)
        i = s.sa[np.arange(len(node)) - np.repeat(np.cumsum(m) - m, m) + first[node]]
        period = depth[node]
        for j, near in ((i + period, i), (i - period, i - period)):
            ok = np.flatnonzero((j >= 0) & (j < s.n))
            r = s.isa[j[ok]]
            ok = ok[(r >= other[node[ok]]) & (r < other_end[node[ok]])]
            starts.append(near[ok])
            periods.append(period[ok])
        begin = end
    return np.concatenate(starts), np.concatenate(periods)


def find_runs(texts: list[list], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of every word sequence, by start, then period."""
    if min_periods < MIN_PERIODS:
        raise ValueError(f"runs of fewer than {MIN_PERIODS} periods are not looked for")
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not sizes.sum():
        return out
    ids, base = [], 0
    for t in texts:
        known: dict = {}
        ids += [base + known.setdefault(w, len(known)) for w in t]
        base += len(known)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(texts)), sizes)
    s = SuffixOrder(np.array(ids, dtype=np.int64), ends[text])
    i, period = branching_squares(s, (sizes // min_periods)[text])
    start = i - s.common_before(i, i + period, (ends - sizes)[text[i]])
    end = i + 2 * period
    long = end - start >= np.maximum(min_words, min_periods * period)
    start, end, period = start[long], end[long], period[long]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    least = np.ones(len(start), bool)
    least[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    for a, b, q in zip(start[least].tolist(), end[least].tolist(), period[least].tolist()):
        d = int(text[a])
        a0 = int(ends[d] - sizes[d])
        out[d].append((a - a0, b - a, q))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run repeats after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return [words[i] for i in np.flatnonzero(keep)]


def _chunks(batches, words_of) -> Iterator[tuple[pa.Array, list[list[bytes]]]]:
    """Ids and words of some texts with about CHUNK_WORDS words in all."""
    for b in texts_of(batches):
        ids, texts, some, n, first = b.column("id"), b.column("text").to_pylist(), [], 0, 0
        plain = ids.to_pylist()
        for at, t in enumerate(texts):
            words = words_of(plain[at], split_words(t))
            if some and n + len(words) > CHUNK_WORDS:
                yield ids.slice(first, len(some)), some
                some, n, first = [], 0, at
            some.append(words)
            n += len(words)
        if some:
            yield ids.slice(first, len(some)), some


def _plain(_, words: list[bytes]) -> list[bytes]:
    return words


def _apply(docs: DataFrame, fn: Callable, schema: str, id_col: str, text_col: str, words_of: Callable) -> DataFrame:
    """``fn(ids, word lists, runs)`` gives the Arrow columns of ``schema`` beside the id."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ["id", *(c.split()[0] for c in schema.split(", "))]

    def run(batches):
        for ids, texts in _chunks(batches, words_of):
            yield pa.RecordBatch.from_arrays(fn(ids, texts, find_runs(texts)), names=names)
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, {schema}")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_of: Callable = _plain) -> DataFrame:
    """(id, start, length, period): one row per run of every text, in words from 0."""
    def rows(ids, texts, runs):
        at = pa.array([d for d, r in enumerate(runs) for _ in r], pa.int64())
        return [ids.take(at), *(pa.array([x[c] for r in runs for x in r], pa.int64()) for c in range(3))]
    return _apply(docs, rows, "start bigint, length bigint, period bigint", id_col, text_col, words_of)


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_of: Callable = _plain) -> DataFrame:
    """(id, text): the words left when every run keeps its first period, joined by one space."""
    def rows(ids, texts, runs):
        return [ids, pa.array([b" ".join(kept_words(t, r)).decode() for t, r in zip(texts, runs)], pa.string())]
    return _apply(docs, rows, "text string", id_col, text_col, words_of)


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_of: Callable = _plain) -> DataFrame:
    """Per row: number of runs, the run of greatest length / period, digests of all runs and of the collapsed text."""
    def rows(ids, texts, runs):
        best = [max(r, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if r else (None, None, None) for r in runs]
        milli = [None if s is None else 1000 * n // q for s, n, q in best]
        longs = [[len(r) for r in runs], *([b[c] for b in best] for c in range(3)), milli]
        told = [_sha("".join(f"{s},{n},{q}\n" for s, n, q in r).encode()) for r in runs]
        left = [_sha(b" ".join(kept_words(t, r))) for t, r in zip(texts, runs)]
        return [ids, *(pa.array(c, pa.int64()) for c in longs), pa.array(told, pa.string()), pa.array(left, pa.string())]
    return _apply(docs, rows, "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
                              "runs_sha256 string, collapsed_sha256 string", id_col, text_col, words_of)


def planted(doc_id, words: list[bytes]) -> list[bytes]:
    """Words with a repetition planted by the crc32 of the id: of every tenth h, the words from a on repeat with period p."""
    import zlib
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
