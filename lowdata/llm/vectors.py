"""Near-duplicate vectors: sign hashing by random hyperplanes, exact cosines, components.

Each of several tables gives a vector the signs of its products with ``bits``
random hyperplanes; vectors that share all signs in a table meet in a bucket, and
their cosine is computed in double precision.  ``plan`` takes as many bits as
keep a random bucket at some eight vectors, and as many tables as find a pair exactly
at the threshold with the wished recall (closer pairs with more).

Equal vectors are one class from the start.  A bucket hands on, per vector, the number
of partners and the least vector of its part of the bucket - never its pairs.  A pair
that shares several buckets is counted in its first common table only.  Buckets
of more than ``BLOCK`` vectors are compared block by block, each pair of
blocks in a task of its own, so a bucket with a third of all rows is neither held in
one task nor cut short.

Edge cases: null, empty and zero vectors and those with null or non-finite parts link
with nothing, and neither do vectors of different length; repeated rows (equal id and
vector) count as vectors of their own; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lowdata.llm.common import connected_components, store

THRESHOLD, RECALL, BLOCK, SEED = 0.95, 0.995, 4096, 11


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for ``n`` vectors."""
    bits = min(40, max(8, math.ceil(math.log2(max(n, 1) / 8))) if n > 8 else 8)
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # large components would overflow when squared
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _sign(bits: int, tables: int):
    """(id, n, vec) -> (id, n, dim, vec as bytes, one signature per table)."""
    def run(batches):
        for b in batches:
            vec = b.column("vec")
            width = vec.value_lengths().to_numpy(zero_copy_only=False)
            flat = vec.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(width) - width
            raw, sig = np.empty(len(width), object), np.empty((len(width), tables), np.int64)
            for d in np.unique(width):
                rows = np.flatnonzero(width == d)
                x = flat[starts[rows][:, None] + np.arange(d)]
                planes = np.random.default_rng([SEED, int(d)]).standard_normal((int(d), tables * bits))
                up = (unit(x.astype(np.float64)) @ planes > 0).reshape(len(rows), tables, bits)
                sig[rows] = up @ (np.int64(1) << np.arange(bits, dtype=np.int64))
                for i, r in enumerate(rows):
                    raw[r] = x[i].tobytes()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(width) * tables + 1, tables, dtype=np.int32)), pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n"), pa.array(width.astype(np.int32)), pa.array(raw, pa.binary()), lists],
                                             names=["id", "n", "dim", "vec", "sig"])
    return run


def _linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    return x @ y.T >= threshold


def _bucket(ids, n, part, x, sig, tbl: int, two: bool, threshold: float):
    """(id, partners, least id of its part) of the vectors with a link; two: only pairs across the two blocks."""
    link = _linked(x, x, threshold)
    np.fill_diagonal(link, False)
    if two:
        link &= part[:, None] != part[None, :]
    if not link.any():
        return None
    i, j = np.nonzero(link)
    new = np.ones(len(i), bool)
    for t in range(tbl):
        new &= sig[i, t] != sig[j, t]
    partners = np.bincount(i[new], weights=n[j[new]], minlength=len(ids)).astype(np.int64)
    low = np.argsort(np.argsort(ids, kind="stable"), kind="stable")  # rank of the id
    by_rank = np.argsort(ids, kind="stable")
    while True:
        step = low.copy()
        np.minimum.at(step, i, low[j])
        step = step[by_rank[step]]
        if (step == low).all():
            break
        low = np.minimum(step, low)
    some = link.any(1)
    return ids[some], partners[some], ids[by_rank[low[some]]]


def _meet(threshold: float, is_float: bool):
    """Rows sorted by bucket -> (id, partners, root)."""
    kind = np.float32 if is_float else np.float64

    def run(batches):
        held = None

        def groups(t: pa.Table, last: bool):
            keys = np.stack([t.column(c).to_numpy() for c in ("dim", "tbl", "code", "pa", "pb")], 1)
            cut = np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1
            bounds = np.concatenate(([0], cut, [len(keys)]))
            done = len(bounds) - 1 if last else len(bounds) - 2
            ids, n, part = (t.column(c).to_numpy() for c in ("id", "n", "part"))
            for s, e in zip(bounds[:done], bounds[1:done + 1]):
                if e - s < 2:
                    continue
                rows = t.slice(s, e - s)
                x = unit(np.frombuffer(b"".join(rows.column("vec").to_pylist()), kind).reshape(e - s, -1).astype(np.float64))
                sig = rows.column("sig").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(e - s, -1)
                got = _bucket(ids[s:e], n[s:e], part[s:e], x, sig, int(keys[s, 1]), keys[s, 3] != keys[s, 4], threshold)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], names=["id", "partners", "root"])
            rest.append(t.slice(bounds[done]))

        rest: list = []
        for b in batches:
            t = pa.Table.from_batches([b])
            held = pa.concat_tables([held, t]) if held is not None else t
            rest.clear()
            yield from groups(held.combine_chunks(), False)
            held = rest[0]
        if held is not None and held.num_rows:
            yield from groups(held.combine_chunks(), True)
    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD,
                    recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id) per input row."""
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    is_float = src.schema["vec"].dataType.elementType.simpleString() == "float"
    if not is_float:
        src = src.withColumn("vec", F.col("vec").cast("array<double>"))
    good = F.coalesce(F.col("vec").isNotNull() & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
                      & F.exists("vec", lambda v: v != 0), F.lit(False))
    fine = src.where(good & F.col("id").isNotNull())
    # the class of equal vectors: its least id stands for it
    # (one id may stand on rows with different vectors, so classes get a number of their own)
    classes = fine.groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    numbered = store(classes.select(F.monotonically_increasing_id().alias("id"), "n", "vec", "rep"), "vec-classes")
    bits, tables = plan(numbered.count(), threshold, recall)
    signed = store(numbered.select("id", "n", "vec").mapInArrow(_sign(bits, tables), "id bigint, n bigint, dim int, vec binary, sig array<bigint>"), "vec-signed")
    spots = signed.select("*", F.posexplode("sig").alias("tbl", "code"))
    hot = store(signed.select("dim", F.posexplode("sig").alias("tbl", "code")).groupBy("dim", "tbl", "code").count()
                .where(F.col("count") > block).withColumn("blocks", F.ceil(F.col("count") / block).cast("int")).drop("count"), "vec-hot")
    cold = spots.withColumn("part", F.lit(0)).withColumn("pa", F.lit(0)).withColumn("pb", F.lit(0))
    if not hot.isEmpty():
        split = spots.join(hot, ["dim", "tbl", "code"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        split = split.withColumn("part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cold = split.withColumn("pa", F.least("part", "other")).withColumn("pb", F.greatest("part", "other"))
    spots = cold.select("dim", "tbl", "code", "pa", "pb", "part", "id", "n", "vec", "sig")
    key = ["dim", "tbl", "code", "pa", "pb"]
    met = store(spots.repartition(*key).sortWithinPartitions(*key).mapInArrow(_meet(threshold, is_float), "id bigint, partners bigint, root bigint"), "vec-met")
    partners = met.groupBy("id").agg(F.sum("partners").alias("partners"))
    comp = connected_components(met.where("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v")))
    named = (numbered.select("id", "n", "rep", "vec").join(partners, "id", "left")
             .join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")))
    named = store(named, "vec-named")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    info = named.join(least, "component").select(F.col("vec").alias("v"), (F.coalesce("partners", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = fine.join(info, F.col("vec") == F.col("v")).select("id", "n_links", "component_id")
    alone = src.where(~(good & F.col("id").isNotNull())).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone)
