"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Groups (equal texts) are placed, in decreasing share, on the shard where the dot product
of the group's vector with the shard's residual capacity is highest; vectors and
capacities are in shares of a shard's mean, and the dimension of the ``bytes`` law counts
``BYTES_WEIGHT`` times.

Scale: groups with at least 1/64 of a shard in some dimension are packed one by one - by
arithmetic there are at most 3 * 64 * shards of them.  All others are packed by class
(eighth octave of bytes, quarter octave of tokens and rows; a bounded
table of counts and mean vectors): a class is dealt in ever smaller runs of groups, and
a group finds its shard by its position in its class.  A group with more bytes than a
shard (or twice a shard's tokens or rows) cannot be placed whole; it is cut into the
fewest equal pieces of at most half a shard.  Positions and slots come from salted
ordinals, so no task sees a whole class, shard or hot group.

Edge cases: null texts form a group of their own and have 8 bytes; repeated rows and
ids are placed each; null ids sort first; an empty table gives an empty result; fewer groups
than shards leave shards empty; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lowdata.llm.common import ordinal, store
from lowdata.llm.packing import word_count

ROW_BYTES, HEAVY, BYTES_WEIGHT = 8, 64, 12.0
DIMENSIONS = ("bytes", "tokens", "rows")


def rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, id, bytes, tokens, crc, key) per input row; key is a digest of the text, rid tells repeated rows apart."""
    text = F.col(text_col)
    return docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("bytes"),
        word_count(text_col).cast("long").alias("tokens"), F.crc32(F.coalesce(text, F.lit(""))).alias("crc"),
        F.coalesce(F.unhex(F.sha2(text, 256)), F.unhex(F.lit("00"))).alias("key"))


def _octave(col: str, parts: int) -> F.Column:
    return F.floor(F.log2(F.col(col)) * parts)


class Shards:
    """Residual capacities and the placing rule."""

    def __init__(self, n: int, capacity: np.ndarray):
        self.capacity = np.maximum(capacity, 1.0)
        self.free = np.ones((n, len(capacity)))
        self.weight = np.array([BYTES_WEIGHT, 1.0, 1.0])

    def place(self, vector: np.ndarray) -> int:
        share = vector / self.capacity
        free = np.concatenate((self.free[:, :1], np.maximum(self.free[:, 1:], 0)), axis=1)  # full in rows or tokens is no reason to stay short of bytes
        k = int(np.argmax(free @ (share * self.weight)))
        self.free[k] -= share
        return k


def deal(shards: Shards, n: int, mean: np.ndarray) -> tuple[list[int], list[int]]:
    """(last positions, shards) of the runs in which ``n`` like groups are placed."""
    ends, where, at = [], [], 0
    parts = len(shards.free)
    while at < n:
        run = max(1, (n - at) // (2 * parts))
        at += run
        ends.append(at)
        where.append(shards.place(mean * run))
    return ends, where


def shard(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, id, bytes, tokens, crc, shard, slot) per input row; slot is gapless from 0 in every shard."""
    spark = docs.sparkSession
    base = store(rows(docs, id_col, text_col), "shard-rows")
    groups = store(base.groupBy("key").agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")), "shard-groups")
    total = groups.agg(*[F.sum(d).alias(d) for d in DIMENSIONS]).first()
    capacity = np.array([float(total[d] or 0) / n_shards for d in DIMENSIONS])
    heavy_if = F.lit(False)
    for d, c in zip(DIMENSIONS, capacity):
        heavy_if = heavy_if | (F.col(d) >= max(c / HEAVY, 2.0))
    shards = Shards(n_shards, capacity)
    share = lambda v: float((v / shards.capacity).max())

    whole, cut = [], []
    heavy = [(bytes(r["key"]), np.array([float(r[d]) for d in DIMENSIONS])) for r in groups.where(heavy_if).collect()]
    items = []
    for key, v in heavy:
        s = v / shards.capacity
        pieces = int(np.ceil(2 * s.max())) if s[0] > 1 or s.max() > 2 else 1
        items += [(share(v / pieces), key, p, pieces, v / pieces) for p in range(pieces)]
    for _, key, p, pieces, v in sorted(items, key=lambda x: (-x[0], x[1], x[2])):
        k = shards.place(v)
        (cut if pieces > 1 else whole).append((key, p, pieces, k))

    light = groups.where(~heavy_if).withColumn("cls", F.struct(_octave("bytes", 8).alias("b"), _octave("tokens", 4).alias("t"), _octave("rows", 4).alias("r")))
    light = light.withColumn("cls", F.concat_ws("/", "cls.b", "cls.t", "cls.r"))
    classes = [(r["cls"], r["n"], np.array([r[d] for d in DIMENSIONS])) for r in
               light.groupBy("cls").agg(F.count("*").alias("n"), *[F.avg(d).alias(d) for d in DIMENSIONS]).collect()]
    runs = {c: tuple(map(np.array, deal(shards, n, v))) for c, n, v in sorted(classes, key=lambda x: (-share(x[2]), x[0]))}

    @F.pandas_udf("int")
    def of_class(cls: pd.Series, at: pd.Series) -> pd.Series:
        out = np.empty(len(cls), np.int32)
        for c, places in cls.groupby(cls.values).indices.items():
            ends, where = runs[c]
            out[places] = where[np.searchsorted(ends, at.to_numpy()[places], side="right")]
        return pd.Series(out)

    placed = ordinal(light.select("cls", "key"), ["cls"], ["key"], "at").select("key", of_class("cls", "at").alias("shard"))
    if whole:
        placed = placed.unionByName(spark.createDataFrame([(bytearray(k), s) for k, _, _, s in whole], "key binary, shard int"))
    out = base.join(placed, "key")
    if cut:
        pieces = spark.createDataFrame([(bytearray(k), p, s) for k, p, _, s in cut], "key binary, piece int, shard int")
        sizes = {k: n for k, _, n, _ in cut}
        n_rows = {k: int(v[2]) for k, v in heavy if k in sizes}
        plan = spark.createDataFrame([(bytearray(k), n, n_rows[k]) for k, n in sizes.items()], "key binary, pieces int, n_rows bigint")
        own = ordinal(base.join(plan, "key"), ["key"], ["id", "rid"], "at")
        own = (own.withColumn("piece", F.floor(F.col("at") * F.col("pieces") / F.col("n_rows")).cast("int"))
               .join(pieces, ["key", "piece"]).select(*base.columns, "shard"))
        out = out.select(*base.columns, "shard").unionByName(own)
    placed_rows = store(out.select("rid", "id", "bytes", "tokens", "crc", "shard"), "shard-placed")
    return ordinal(placed_rows, ["shard"], ["id", "rid"], "slot")
