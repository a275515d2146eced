"""SimHash near-duplicates by anchor-point covering.

Fingerprints: 3-word shingles of the ASCII-lower-cased text, XXH64 (seed 42),
a bit is set when it is set in over half of the shingle hashes.

Links: two fingerprints within 3 bits differ by at most one bit in one of two
halves (31 of the 32 bits of a half are used).  For one half, the [31,26] Hamming
code is the covering code: covering radius 1, so every half has exactly one anchor
(codeword) within 1 - its *home* - and, with a threshold of 1 per half, is
replicated to every anchor within 1 + 1 = 2 (16 of them, or 1 for a codeword).
If x and y differ by at most one bit in a half, y is present at x's home.  Each
anchor compares the fingerprints at home there with all that are present, on
all 64 bits.  Equal fingerprints are one class from the start, so hot
copies never meet each other.  An anchor hands on a star (one edge per linked
fingerprint), not its pairs; connected components join the stars.

Edge cases: null, empty and blank texts have fingerprint zero and link like any
other; fewer than three words make one shingle; repeated rows and repeated ids
share their fingerprint and keep one output row each; null ids are carried but
never become a component id unless the whole group has none; an empty table
gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lowdata.llm.common import by_text, connected_components, store

SHINGLE_WORDS, MAX_BITS, SEED = 3, 3, 42
HALF = np.uint64(0x7FFFFFFF)
_POPULATION_ROWS = 1 << 16


def fingerprint(text: str | None, n: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of one text, unsigned."""
    from xxhash import xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= n:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[:len(words) - n + 1].tolist()
        hashes = [xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends[n - 1:].tolist())]
    h = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), _POPULATION_ROWS):
        ones += np.unpackbits(h[i:i + _POPULATION_ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row per input row; fp is the fingerprint as a signed long."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def sign(texts):
        return [np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)]

    schema = f"id {src.schema['id'].dataType.simpleString()}, fp bigint"
    return src.mapInArrow(by_text(sign, "text", ["fp"], [pa.int64()], ["id"]), schema)


def _syndrome(half: np.ndarray) -> np.ndarray:
    """Of the [31,26] Hamming code: xor of the 1-based places of the set bits."""
    s = np.zeros(half.shape, np.uint64)
    for i in range(31):
        s ^= ((half >> np.uint64(i)) & np.uint64(1)) * np.uint64(i + 1)
    return s


def _bit(place: np.ndarray) -> np.ndarray:
    """Mask of a 1-based place; 0 for place 0."""
    return np.where(place > 0, np.uint64(1) << (np.maximum(place, np.uint64(1)) - np.uint64(1)), np.uint64(0))


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, away, index into fp) of every replica; away is 0 at the home anchor, else 1."""
    out = []
    for k in range(2):
        half = (fp >> np.uint64(32 * k)) & HALF
        s = _syndrome(half)
        tag = np.uint64(k << 31)
        idx = np.arange(len(fp))
        out.append(((half ^ _bit(s)) | tag, np.zeros(len(fp), np.int8), idx))
        for i in range(1, 32):
            j = np.uint64(i) ^ s
            ok = (s > 0) & (np.uint64(i) < j)  # j = 0 is the home anchor; each pair of places once
            out.append(((half[ok] ^ _bit(np.full(ok.sum(), i, np.uint64)) ^ _bit(j[ok])) | tag,
                        np.ones(int(ok.sum()), np.int8), idx[ok]))
    a, w, i = (np.concatenate(x) for x in zip(*out))
    return a.view(np.int64), w, i


def _replicas(batches):
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for s in range(0, len(fp), 20_000):
            part = fp[s:s + 20_000]
            a, w, i = anchors(part)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(w), pa.array(part[i].view(np.int64))], names=["anchor", "away", "fp"])


def _stars(home: np.ndarray, there: np.ndarray, max_bits: int):
    """Star edges of the bipartite link graph between the fingerprints at home and those present."""
    step = max(1, 2_000_000 // max(1, len(home)))
    for s in range(0, len(there), step):
        y = there[s:s + step]
        link = np.bitwise_count(y[:, None] ^ home[None, :]) <= max_bits
        own = np.arange(len(home))
        none = len(home)
        while True:
            row = np.where(link, own[None, :], none).min(1)
            col = np.where(link, row[:, None], none).min(0)
            new = np.minimum(own, col)
            new = np.minimum(new, new[new])
            if (new == own).all():
                break
            own = new
        got = row < none
        yield y[got], home[row[got]]
        moved = own != np.arange(len(home))
        yield home[moved], home[own[moved]]


def _compare(max_bits: int):
    def run(batches):
        held = None  # rows of the anchor that may go on in the next batch: (anchor, away, fp)

        def edges(a, w, x):
            cut = np.flatnonzero(np.diff(a)) + 1
            starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(a)]))
            homes = np.add.reduceat((w == 0).astype(np.int64), starts)
            size = ends - starts
            small = (homes > 0) & (size > 1) & (homes * size <= 64)
            reps = homes[small] * size[small]
            if reps.sum():
                g = np.repeat(np.flatnonzero(small), reps)
                k = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                left, right = x[starts[g] + k % homes[g]], x[starts[g] + k // homes[g]]
                ok = (left != right) & (np.bitwise_count(left ^ right) <= max_bits)
                yield left[ok], right[ok]
            for g in np.flatnonzero((homes > 0) & (homes * size > 64)):
                yield from _stars(x[starts[g]:starts[g] + homes[g]], x[starts[g]:ends[g]], max_bits)

        def emit(pairs):
            for u, v in pairs:
                ok = u != v
                if ok.any():
                    yield pa.RecordBatch.from_arrays([pa.array(u[ok].view(np.int64)), pa.array(v[ok].view(np.int64))], names=["u", "v"])

        for b in batches:
            a, w, x = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            x = x.view(np.uint64)
            if held is not None:
                a, w, x = (np.concatenate(p) for p in zip(held, (a, w, x)))
            last = int(np.searchsorted(a, a[-1]))
            if last:
                yield from emit(edges(a[:last], w[:last], x[:last]))
            a, w, x = a[last:], w[last:], x[last:]
            n_home = int((w == 0).sum())
            if len(a) > 200_000 and n_home < len(a):  # a hot anchor: those at home came first; drop the visitors already met
                yield from emit(_stars(x[:n_home], x, max_bits))
                a, w, x = a[:n_home], w[:n_home], x[:n_home]
            held = (a, w, x)
        if held is not None and len(held[0]):
            yield from emit(edges(*held))
    return run


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints within ``max_bits`` (at most 3) of each other."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two halves with covering radius 1 serve thresholds up to 3 bits")
    reps = fps.select("fp").mapInArrow(_replicas, "anchor bigint, away tinyint, fp bigint")
    dealt = reps.repartition("anchor").sortWithinPartitions("anchor", "away", "fp")
    return dealt.mapInArrow(_compare(max_bits), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fp, group_fp, component_id) per input row; component_id is the least id reachable by links."""
    signed = store(fingerprints(docs, id_col, text_col), "simhash")
    classes = store(signed.groupBy("fp").agg(F.min("id").alias("low")), "simhash-classes")
    comp = connected_components(links(classes, max_bits))
    named = (classes.join(comp.withColumnRenamed("node", "fp"), "fp", "left")
             .select("fp", "low", F.coalesce("component", "fp").alias("group_fp")))
    least = named.groupBy("group_fp").agg(F.min("low").alias("component_id"))
    names = named.select("fp", "group_fp").join(least, "group_fp")
    return signed.join(names, "fp").select("id", "fp", "group_fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the one with the least id (one row when that id repeats).

    Ids that are not kept leave by an anti-join, so only that list and the
    table itself are shuffled.  Groups whose least id is null or occurs on several
    rows are settled by one row per group.
    """
    found = store(near_duplicates(docs, id_col, text_col, max_bits), "simhash-groups")
    first = found.where(F.col("id").eqNullSafe(F.col("component_id")))
    # ids whose fate an id alone does not tell: null, or present on more than one row
    unclear = found.groupBy("id").count().where("count > 1 or id is null").select("id")
    if unclear.isEmpty():
        gone = found.where("id <> component_id").select(F.col("id").alias("__gone"))
        return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
    lost = found.join(unclear, "id", "left_anti").where("id <> component_id").select(F.col("id").alias("__gone"))
    unclear = unclear.withColumnRenamed("id", "__unclear")
    clear = (docs.where(F.col(id_col).isNotNull()).join(unclear, F.col(id_col) == F.col("__unclear"), "left_anti")
             .join(lost, F.col(id_col) == F.col("__gone"), "left_anti"))
    rest = docs.join(unclear, F.col(id_col).eqNullSafe(F.col("__unclear")), "left_semi")
    rid, fp = "__row_fp", "__row_group"
    sign = _fp_column(rest, text_col)
    groups = first.select(F.col("fp").alias(rid), F.col("group_fp").alias(fp), F.col("id").alias("__first")).distinct()
    picked = (rest.withColumn(rid, sign).join(groups, rid)
              .where(F.col(id_col).eqNullSafe(F.col("__first"))).dropDuplicates([fp]))
    return clear.unionByName(picked.select(*docs.columns))


def _fp_column(df: DataFrame, text_col: str):
    @F.pandas_udf("bigint")
    def sign(text):  # noqa: ANN001
        import pandas as pd
        return pd.Series(np.array([fingerprint(t) for t in text], dtype=np.uint64).view(np.int64))
    return sign(F.col(text_col))
