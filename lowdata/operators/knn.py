"""Exact k-nearest-neighbour join (A7 / J6) over a metric index, Euclidean, ties broken by neighbour id.

Spark has no kNN join, so this is the one place with NumPy inside tasks.  Both sides
stay distributed and pairs are never emitted as rows:

* some ``sqrt(n)`` reference rows, chosen by a hash of the id, are pivots (bounded in number and bytes); every
  reference row belongs to the cell of its nearest pivot;
* a cell is known by its number of rows, the least and greatest distance to its pivot and its ``k`` least distances: one
  small row a cell.  A query row with distances d(q, p) has k neighbours within the k-th least of
  ``d(q, p) + t`` over all cells' least distances t, and by the triangle inequality none in cells whose lower bounds
  ``d(q, p) - greatest``, ``least - d(q, p)`` or half-space distance exceed that; it is sent to the other cells only;
* large cells are cut into blocks by a hash, and so are the queries that meet a cell; one co-grouped
  task scores one pair of bounded blocks and returns the top-k of its query rows.  A block is bounded in bytes and in
  rows (rows of few dimensions are small, but each is compared).  Within it the same bounds hold for some ``sqrt(n)`` small
  cells: a query row is compared with its own cell, then with those that can still hold a nearer row.  Where most cells
  can (many dimensions), the block is scored as a whole.  Of rows with equal components only the ``k`` least ids are kept;
* partial top-k lists are merged per query row, at most ``MERGE`` at a time.

What passes through the driver is one small row a cell.  Distances are ranked with
the BLAS expansion ``|a|^2 + |b|^2 - 2ab`` after moving the origin to the mean of the
reference block (far from the origin the expansion would lose its digits) and the candidates are
re-scored exactly as ``sqrt(sum((a - b)^2))`` before the final order, so near ties
are decided on exact distances; bounds are widened by the rounding of the expansion.  Rows with a
non-finite component meet, and are met by, everything, and their distances are computed directly.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lowdata.session import materialize

BLOCK_BYTES = 8 << 20  # of one side's dense float64 matrix in a task
BLOCK_ROWS = 1 << 14   # of one side in a task
LEAST_ROWS = 1 << 12   # smaller blocks are not dealt to tasks: each one more would be one more copy of its query rows
PIVOT_BYTES = 8 << 20  # of all pivots
MAX_PIVOTS = 2048
MERGE = 64  # partial lists of one query row merged at once
CHUNK_CELLS = 1_000_000  # query x reference distance cells evaluated at once in a task
CAND_CELLS = 1_000_000   # query x candidate x dim cells of the exact re-scoring
CELL_ROWS = 256  # blocks of fewer rows have no cells of their own
MOST_MET = 0.4   # share of the cells met from which a block is scored as a whole
OUT_SCHEMA = "q_id long, nbr_id long, dist double, nbr_rank int"


def _matrix(values) -> np.ndarray:
    if len(values) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in values])


def _rows(table: pa.Table, column: str) -> np.ndarray:
    """A list column as a matrix, without a Python object for each row."""
    lists = table.column(column).combine_chunks()
    n = len(lists)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    lengths = np.diff(lists.offsets.to_numpy())
    if lists.null_count or (n and (lengths != lengths[0]).any()):
        raise ValueError("vectors are null or of different lengths")
    return values.reshape(n, lengths[0] if n else 0)


def _topk_exact(qx: np.ndarray, rx: np.ndarray, rid: np.ndarray, k: int):
    """``_topk_block`` over query chunks so the distances stay within CHUNK_CELLS and the exact re-scoring within CAND_CELLS."""
    step = max(1, min(CHUNK_CELLS // max(1, len(rx)), CAND_CELLS // ((k + 8) * max(1, qx.shape[1] if qx.ndim == 2 else 1))))
    if qx.shape[0] <= step:
        return _topk_block(qx, rx, rid, k)
    parts = [_topk_block(qx[s:s + step], rx, rid, k) for s in range(0, qx.shape[0], step)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _topk_block(qx: np.ndarray, rx: np.ndarray, rid: np.ndarray, k: int):
    """Top-k (index arrays, exact distances) of each query row against reference rows.

    Candidates come from the BLAS expansion; they are re-scored exactly and
    ordered by (distance, id) in one vectorised pass.  Only rows that another than a candidate could
    be as near to as to their k-th (near ties at the cut) take the per-row path.
    """
    nq, nr = qx.shape[0], rx.shape[0]
    kk = min(k, nr)
    if nr == 0 or nq == 0:
        return np.zeros((nq, 0), dtype=np.int64), np.zeros((nq, 0))
    mid = rx.mean(0)
    qc, rc = qx - mid, rx - mid
    q2, r2 = (qc * qc).sum(1), (rc * rc).sum(1)
    d2 = qc @ rc.T
    d2 *= -2.0
    d2 += q2[:, None]
    d2 += r2
    m = min(nr, kk + 8)
    if m < nr:
        cand = np.argpartition(d2, m - 1, axis=1)[:, :m]
    else:
        cand = np.tile(np.arange(nr), (nq, 1))
    ex = np.sqrt(((rx[cand] - qx[:, None, :]) ** 2).sum(-1))
    order = np.lexsort((rid[cand], ex), axis=-1)[:, :kk]
    out_i = np.take_along_axis(cand, order, 1)
    out_d = np.take_along_axis(ex, order, 1)
    if m < nr:
        tol = 8 * np.finfo(float).eps * (rx.shape[1] + 4) * (q2 + r2.max()) + np.finfo(float).tiny  # rounding of the expansion
        least = np.take_along_axis(d2, cand, 1).max(1)  # of the others
        reach = out_d[:, -1] ** 2 + tol
        for i in np.nonzero(least - tol <= reach)[0]:  # near ties at the candidate cut: re-rank the widened set exactly
            c = np.union1d(np.nonzero(d2[i] <= reach[i] + tol[i])[0], cand[i])
            e = np.sqrt(((rx[c] - qx[i]) ** 2).sum(1))
            o = np.lexsort((rid[c], e))[:kk]
            out_i[i], out_d[i] = c[o], e[o]
    return out_i, out_d


def _first_copies(rx: np.ndarray, rid: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows less those that k rows of equal components and lesser ids precede: these are nobody's k nearest."""
    bits = np.ascontiguousarray(rx).view(np.uint64)
    mix = (2 * np.arange(1, rx.shape[1] + 1, dtype=np.uint64) + 1) * np.uint64(0x9E3779B97F4A7C15)
    order = np.lexsort((rid, ((bits ^ (bits >> np.uint64(32))) * mix).sum(1)))
    new = np.append(True, (bits[order[1:]] != bits[order[:-1]]).any(1))
    at = np.arange(len(order))
    return np.sort(order[at - np.maximum.accumulate(np.where(new, at, 0)) < k])


def _flat(idx: np.ndarray, dist: np.ndarray, queries: np.ndarray, refs: np.ndarray):
    return np.repeat(queries, idx.shape[1]), refs[idx.reshape(-1)], dist.reshape(-1)


def _direct(qx: np.ndarray, rx: np.ndarray, rid: np.ndarray, k: int):
    """Top-k without the expansion, for rows with a non-finite component (NaN is the greatest distance)."""
    step, out = max(1, CAND_CELLS // max(1, rx.size)), []
    for s in range(0, len(qx), step):
        with np.errstate(invalid="ignore", over="ignore"):
            d = np.sqrt(((qx[s:s + step, None, :] - rx[None]) ** 2).sum(-1))
        order = np.lexsort((np.broadcast_to(rid, d.shape), d), axis=-1)[:, :k]
        out.append((order, np.take_along_axis(d, order, 1)))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _by_cells(qx: np.ndarray, rx: np.ndarray, rid: np.ndarray, k: int):
    """(query, reference, distance) candidates, among them the top-k of every query row, of finite rows."""
    n, every = len(rx), np.arange(len(qx))
    whole = lambda: [_flat(*_topk_exact(qx, rx, rid, k), every, np.arange(n))]
    if n < CELL_ROWS or not len(qx):
        return whole()
    pivots = Pivots(np.unique(rx[np.linspace(0, n - 1, math.isqrt(n)).astype(int)], axis=0))
    d, slack = pivots.distances(rx)
    own = d.argmin(1)
    order = np.argsort(own, kind="stable")
    cells, starts = np.unique(own[order], return_index=True)
    members = np.split(order, starts[1:])
    at = d[np.arange(n), own][order]
    low, high = np.full(len(pivots.x), np.inf), np.full(len(pivots.x), -np.inf)
    low[cells], high[cells] = np.minimum.reduceat(at, starts) - slack.max(), np.maximum.reduceat(at, starts) + slack.max()
    d, slack = pivots.distances(qx)
    home = cells[d[:, cells].argmin(1)]
    reach, out = np.full(len(qx), np.inf), []

    def meet(cell, queries):
        idx, dist = _topk_exact(qx[queries], rx[members[cell]], rid[members[cell]], k)
        out.append(_flat(idx, dist, queries, members[cell]))
        return dist

    for i, c in enumerate(cells):
        queries = np.flatnonzero(home == c)
        if len(queries):
            dist = meet(i, queries)
            if dist.shape[1] == k:
                reach[queries] = dist[:, -1]
    met = ~(pivots.bounds(d, slack, home, low, high) > reach[:, None])[:, cells]
    met &= home[:, None] != cells
    if met.mean() > MOST_MET:
        return whole()
    for i in range(len(cells)):
        queries = np.flatnonzero(met[:, i])
        if len(queries):
            meet(i, queries)
    return out


def _topk(qx: np.ndarray, rx: np.ndarray, rid: np.ndarray, k: int):
    """The top-k of every query row in a block: places of the query and reference rows and distances."""
    kept = _first_copies(rx, rid, k)
    odd_q, odd_r = ~np.isfinite(qx).all(1), ~np.isfinite(rx[kept]).all(1)
    q, r, odd = np.flatnonzero(~odd_q), kept[~odd_r], kept[odd_r]
    out = [(q[i], r[j], d) for i, j, d in _by_cells(qx[q], rx[r], rid[r], k)]
    for queries, refs in ((q, odd), (np.flatnonzero(odd_q), kept)):
        if len(queries) and len(refs):
            out.append(_flat(*_direct(qx[queries], rx[refs], rid[refs], k), queries, refs))
    at, to, dist = (np.concatenate([o[i] for o in out]) for i in range(3))
    order = np.lexsort((rid[to], dist, at))
    at, to, dist = at[order], to[order], dist[order]
    place = np.arange(len(at))
    first = np.maximum.accumulate(np.where(np.append(True, at[1:] != at[:-1]), place, 0)) if len(at) else place
    top = place - first < k
    return at[top], to[top], dist[top]


SCORED = pa.schema([("q_id", pa.int64()), ("part", pa.int32()), ("nbr_id", pa.int64()), ("dist", pa.float64())])


def _score_blocks(k):
    """Top-k of one query block within one reference block."""
    def run(key, q, r):
        if not len(q) or not len(r):
            return SCORED.empty_table()
        rx, qids, rids = _rows(r, "_f"), q.column("_qid").to_numpy(), r.column("_rid").to_numpy()
        qx, step, out = _rows(q, "_f"), max(1, CHUNK_CELLS // max(math.isqrt(len(rids)), 16)), []
        for s in range(0, len(qids), step):
            at, to, dist = _topk(qx[s:s + step], rx, rids, k)
            out.append(pa.table([qids[s:s + step][at], np.full(len(at), key[0].as_py(), np.int32), rids[to], dist], schema=SCORED))
        return pa.concat_tables(out)
    return run


def _best(partials: DataFrame, keys: list[str], k: int) -> DataFrame:
    return partials.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", "nbr_id"))), 1, k).alias("_top"))


def _merge(partials: DataFrame, k: int, parts: int) -> DataFrame:
    while parts > MERGE:  # a tree: no list grows with the number of reference blocks
        parts = -(-parts // MERGE)
        few = _best(partials.withColumn("part", F.pmod("part", F.lit(parts))), ["q_id", "part"], k)
        partials = few.select("q_id", "part", F.explode("_top").alias("_t")).select("q_id", "part", "_t.nbr_id", "_t.dist")
    return _best(partials, ["q_id"], k).select("q_id", F.posexplode("_top").alias("_pos", "_t")).select(
        "q_id", F.col("_t.nbr_id").alias("nbr_id"), F.col("_t.dist").alias("dist"), (F.col("_pos") + 1).cast("int").alias("nbr_rank"))


class Pivots:
    """Reference rows that stand for cells; cell ``len(self.x)`` holds rows with a non-finite component."""

    def __init__(self, x: np.ndarray):
        self.mid = x.mean(0) if len(x) else np.zeros(x.shape[1] if x.ndim == 2 else 0)
        self.x = x - self.mid
        self.x2 = (self.x * self.x).sum(1)
        self.apart = np.stack([np.sqrt(((self.x - row) ** 2).sum(1)) for row in self.x]) if len(x) else np.zeros((0, 0))

    def distances(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row x pivot distances, the rounding to allow for them); infinite for non-finite rows."""
        c = rows - self.mid
        bad = ~np.isfinite(c).all(1)
        c[bad] = 0
        c2 = (c * c).sum(1)
        d = np.sqrt(np.maximum(c2[:, None] + self.x2[None, :] - 2.0 * (c @ self.x.T), 0))
        d[bad] = np.inf
        top = self.x2.max() if len(self.x2) else 0.0
        return d, 4 * np.sqrt(np.finfo(float).eps * (rows.shape[1] + 4) * (c2 + top))

    def bounds(self, d: np.ndarray, tol: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """(row x cell) distances that no row of a cell is nearer than; ``own``: each row's nearest pivot, with distances in ``d``."""
        far = np.maximum(d - high, low - d)
        half = d * d
        half -= np.take_along_axis(half, own[:, None], 1) + (tol * tol)[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            half /= 2 * self.apart[own]
        far = np.fmax(far, np.where(np.isfinite(half), half, -np.inf))
        far -= tol[:, None]
        return far


def _chunks(pdf: pd.DataFrame, pivots: Pivots, wide: int = 1):
    step = max(1, CHUNK_CELLS // max(1, len(pivots.x) * wide))
    for s in range(0, len(pdf), step):
        part = pdf.iloc[s:s + step]
        yield part, *pivots.distances(_matrix(part["_f"].values))


def _assign(bc):
    """Reference rows with their cell and the distance to its pivot."""
    def run(it):
        for pdf in it:
            for part, d, _ in _chunks(pdf, bc.value) if len(pdf) else ():
                near = d.argmin(1) if d.shape[1] else np.zeros(len(part), int)
                at = d[np.arange(len(part)), near] if d.shape[1] else np.full(len(part), np.inf)
                yield part.assign(_cell=np.where(np.isfinite(at), near, len(bc.value.x)).astype("int32"), _d=at)
    return run


def _least(k):
    """The k least pivot distances of each cell within a partition."""
    def run(it):
        held = None
        for pdf in it:
            held = pd.concat([held, pdf]) if held is not None else pdf
            held = held.sort_values(["_cell", "_d"]).groupby("_cell").head(k)
        if held is not None and len(held):
            yield held
    return run


def _groups(cells: pd.DataFrame, pivots: Pivots, block_rows: int) -> pd.DataFrame:
    """Cells with their group: neighbouring cells (a chain of nearest pivots) up to ``block_rows`` rows, large ones alone.

    A query row meets a group once, so even where no cell can be ruled out it is copied once a block.
    """
    n = len(pivots.x)
    rows = cells.set_index("_cell")["rows"].to_dict()
    left, chain = set(c for c in rows if c < n), []
    while left:
        if chain:
            open_cells = np.fromiter(left, int)
            at = int(open_cells[pivots.apart[chain[-1], open_cells].argmin()])
        else:
            at = min(left)
        chain.append(at)
        left.remove(at)
    group, held, of = 0, 0, {}
    for c in [*chain, *(c for c in rows if c == n)]:
        if held and held + rows[c] > block_rows:
            group, held = group + 1, 0
        of[c] = group
        held += rows[c]
    return cells.assign(group=cells["_cell"].map(of))


def _visits(bc, cells: pd.DataFrame, k: int):
    """Query rows with the groups of cells that can hold one of their k nearest rows."""
    def run(it):
        pivots = bc.value
        n = len(pivots.x)
        low, high = np.full(n, np.inf), np.full(n, -np.inf)
        least = np.full((n, k), np.inf)
        some = cells[cells["_cell"] < n]
        at = some["_cell"].to_numpy(int)
        low[at], high[at] = some["lo"], some["hi"]
        for c, ts in zip(at, some["least"]):
            least[c, :len(ts)] = ts
        order = cells.sort_values("group")
        column, group = order["_cell"].to_numpy(int), order["group"].to_numpy(int)
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        for pdf in it:
            for part, d, tol in _chunks(pdf, pivots, k + 2) if len(pdf) and len(cells) else ():
                meet = np.ones((len(part), n + 1), bool)  # the last cell, of odd rows, is always met
                if n:
                    sums = (d[:, :, None] + least).reshape(len(part), -1)
                    reach = np.partition(sums, k - 1, axis=1)[:, k - 1] + tol if sums.shape[1] >= k else np.full(len(part), np.inf)
                    own = d.argmin(1)
                    with np.errstate(invalid="ignore"):
                        meet[:, :n] = ~(pivots.bounds(d, tol, own, low, high) > reach[:, None])
                met = np.logical_or.reduceat(meet[:, column], starts, axis=1)
                yield pd.DataFrame({"_qid": part["_qid"].values, "_f": part["_f"].values,
                                    "_groups": [group[starts[np.flatnonzero(m)]].astype("int32") for m in met]})
    return run


class _Index:
    """Both sides with their cells, and the number of blocks that a cell and its visitors are cut into."""

    def __init__(self, query: DataFrame, ref: DataFrame, k: int, q_id: str, r_id: str, features: str, block_bytes: int, pivots: int | None,
                 least_rows: int = 1):
        spark = ref.sparkSession
        self.q = query.select(F.col(q_id).cast("long").alias("_qid"), F.col(features).cast("array<double>").alias("_f"))
        r = ref.select(F.col(r_id).cast("long").alias("_rid"), F.col(features).cast("array<double>").alias("_f"))
        size = r.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_f")).alias("d")).first()
        self.n, d = size["n"], max(size["d"] or 1, 1)
        block = min(BLOCK_ROWS, max(least_rows, block_bytes // (8 * d)))
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        q_block = lambda pairs: max(1, min(block, max(least_rows // 4, pairs // tasks)))  # noqa: E731  as many tasks as are shuffled to
        if pivots is None and self.n <= block:  # one block: every query row meets it, whatever an index says
            n_q = self.q.count() if self.n else 0
            self.cells = pd.DataFrame({"_cell": [0], "group": [0], "rows": [self.n]})
            self.met = self.q.withColumn("_groups", F.array(F.lit(0)))
            self.ref = r.withColumn("_cell", F.lit(0))
            self.plan = pd.DataFrame({"group": [0], "rows": [self.n], "visits": [n_q], "nr": [1], "nq": [-(-n_q // q_block(n_q))], "first": [0]})
            self.parts = int(n_q > 0)
            return
        want = math.isqrt(self.n) + 1 if pivots is None else pivots
        want = max(1, min(want, MAX_PIVOTS, PIVOT_BYTES // (8 * d)))
        finite = F.forall("_f", lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        picked = r.where(finite).orderBy(F.xxhash64("_rid"), "_rid").limit(want).select("_f").collect()
        pivot = Pivots(_matrix([p["_f"] for p in picked]) if picked else np.zeros((0, d)))
        bc = spark.sparkContext.broadcast(pivot)
        self.ref = materialize(r.mapInPandas(_assign(bc), "_rid long, _f array<double>, _cell int, _d double"))
        few = (self.ref.select("_cell", "_d").mapInPandas(_least(k), "_cell int, _d double")
               .withColumn("_p", F.pmod(F.spark_partition_id(), F.lit(MERGE))))
        for keys in (["_cell", "_p"], ["_cell"]):
            few = (few.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list("_d")), 1, k).alias("least"))
                   .select(*keys, F.explode("least").alias("_d")))
        least = few.groupBy("_cell").agg(F.array_sort(F.collect_list("_d")).alias("least"))
        span = self.ref.groupBy("_cell").agg(F.count(F.lit(1)).alias("rows"), F.min("_d").alias("lo"), F.max("_d").alias("hi"))
        self.cells = _groups(span.join(least, "_cell").toPandas(), pivot, block)
        self.met = materialize(self.q.mapInPandas(_visits(bc, self.cells, k), "_qid long, _f array<double>, _groups array<int>"))
        seen = self.met.select(F.explode("_groups").alias("group")).groupBy("group").count().toPandas()
        plan = self.cells.groupby("group", as_index=False)["rows"].sum().merge(seen.rename(columns={"count": "visits"}), on="group")
        plan["nr"] = -(-plan["rows"] // block)
        plan["nq"] = -(-plan["visits"] // q_block(int((plan["visits"] * plan["nr"]).sum())))
        plan["first"] = plan["nr"].cumsum() - plan["nr"]
        self.plan = plan
        self.parts = int(plan["nr"].sum())


def knn(query: DataFrame, ref: DataFrame, k: int = 1, q_id: str = "row_id", r_id: str = "row_id",
        features: str = "features", block_bytes: int = BLOCK_BYTES, pivots: int | None = None) -> DataFrame:
    """Top-k reference rows of every query row: ``q_id, nbr_id, dist, nbr_rank`` (1..k)."""
    ix = _Index(query, ref, k, q_id, r_id, features, block_bytes, pivots, LEAST_ROWS)
    spark = ref.sparkSession
    if not ix.parts:
        return spark.createDataFrame([], OUT_SCHEMA)
    plan = spark.createDataFrame(ix.plan[["group", "nr", "nq", "first"]].astype(int).values.tolist(), "group int, nr int, nq int, first int")
    cell = spark.createDataFrame(ix.cells[["_cell", "group"]].astype(int).values.tolist(), "_cell int, group int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = (ix.met.select("_qid", "_f", F.explode("_groups").alias("group")).join(plan, "group")
            .withColumn("_qb", own("_qid", "nq")).withColumn("_rb", every("nr"))
            .select((F.col("first") + F.col("_rb")).alias("_part"), "_qb", "_qid", "_f").groupBy("_part", "_qb"))
    right = (ix.ref.join(cell.join(plan, "group"), "_cell").withColumn("_rb", own("_rid", "nr")).withColumn("_qb", every("nq"))
             .select((F.col("first") + F.col("_rb")).alias("_part"), "_qb", "_rid", "_f").groupBy("_part", "_qb"))
    part = left.cogroup(right).applyInArrow(_score_blocks(k), "q_id long, part int, nbr_id long, dist double")
    return _merge(part, k, ix.parts)


def pairs_met(query: DataFrame, ref: DataFrame, k: int = 1, q_id: str = "row_id", r_id: str = "row_id",
              features: str = "features", block_bytes: int = BLOCK_BYTES, pivots: int | None = None) -> dict:
    """What the index leaves: rows, cells, groups, (query row, block) copies against all, and the share of row pairs scored."""
    ix = _Index(query, ref, k, q_id, r_id, features, block_bytes, pivots)
    n = ix.met.count()
    p = ix.plan
    return {"query_rows": n, "ref_rows": ix.n, "cells": len(ix.cells), "groups": int(ix.cells["group"].nunique()),
            "copies": int((p["visits"] * p["nr"]).sum()), "all_copies": n * ix.parts,
            "share": float((p["rows"] * p["visits"]).sum() / (n * ix.n)) if n and ix.n else 0.0}


def nn_dist(a: DataFrame, b: DataFrame, a_id: str = "row_id", b_id: str = "row_id",
            features: str = "features", out: str = "dist") -> DataFrame:
    """Distance of each ``a`` row to its nearest ``b`` row; empty ``b`` -> +inf.

    (The reference accepts a ``k`` but always returns the first neighbour's distance.)
    """
    nn = knn(a, b, 1, a_id, b_id, features).filter(F.col("nbr_rank") == 1)
    res = a.join(nn.select(F.col("q_id").alias(a_id), F.col("dist").alias(out)), on=a_id, how="left")
    return res.withColumn(out, F.coalesce(F.col(out), F.lit(float("inf"))))
