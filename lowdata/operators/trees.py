"""Many forests grown on the same rows (M6, M7): trees grown whole inside tasks.

The law is that of spark.ml's classifier: Poisson(1) weights of the rows, at most 32 bins a feature, sqrt(features) tried
at every node, Gini gain above 0, ``minInstancesPerNode`` (drawn rows, with their weights) on both sides of a split, maximal depth; then
splits whose two leaves predict the same class are taken back, and nodes of fewer rows than min samples split become leaves.

A tree's draws depend on the seed, its number and the rows' keys only, level by level.  So the first 200 trees of 400 are those of a
forest of 200, and a tree grown to depth 30 has the one of depth 20 on top: settings that differ only in trees, depth or min samples
split score parts of the same trees, and no result depends on partitioning.

A task holds the rows as one byte a value (bounded by ``CELLS``) and one tree.  Rows beyond that, or rows spark.ml refuses,
are left to spark.ml (``model.search_scores``).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 32
CELLS = 1 << 27  # bytes of the rows that a task holds: one a value, and ROW for what goes along with a row
ROW = 64
TREES = 25  # trees grown by one task at a time
POINT = 1 << 40  # leaf shares are summed as whole numbers, so sums don't depend on their order
SCORED = 256  # nodes whose splits are compared at a time


def fits(d: DataFrame, k: int) -> bool:
    """Whether every fold's rows hold both classes, nothing is null or not finite, vectors are equally long and a task can hold them."""
    ok = F.col("features").isNotNull() & F.col("y").isin(0.0, 1.0) & F.col("fold").isNotNull() & F.forall(
        "features", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    per = d.groupBy("fold").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("q"), F.min(F.size("features")).alias("lo"),
                                F.max(F.size("features")).alias("hi"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("bad")).collect()
    if not per or any(r["bad"] for r in per) or {r["lo"] for r in per} != {r["hi"] for r in per} or len({r["hi"] for r in per}) != 1:
        return False
    p, q = sum(r["p"] for r in per), sum(r["q"] for r in per)
    whole = all(p > r["p"] and q > r["q"] for r in per) if k > 1 else p > 0 and q > 0
    return whole and per[0]["hi"] > 0 and (p + q) * (per[0]["hi"] + ROW) <= CELLS


def _columns(batches):
    """The values of every feature in a batch."""
    for b in batches:
        if b.num_rows:
            x = np.asarray(b.column("features").flatten()).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(x.shape[1]), pa.int32()), pa.array([c.tobytes() for c in x.T], pa.binary())], names=["j", "v"])


def _cuts(key, t):
    v = np.sort(np.concatenate([np.frombuffer(b, np.float64) for b in t.column("v").to_pylist()]))
    values = np.unique(v)
    at = values[:-1] if len(values) <= BINS else np.unique(v[[-(-len(v) * i // BINS) - 1 for i in range(1, BINS)]])
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([at.tolist()], pa.list_(pa.float64()))], names=["j", "at"])


def thresholds(d: DataFrame) -> list[np.ndarray]:
    """Split points of every feature: all of its values but the last when they are few, else exact quantiles; a task sorts one feature."""
    rows = d.select("features").mapInArrow(_columns, "j int, v binary").groupBy("j").applyInArrow(_cuts, "j int, at array<double>").collect()
    return [np.array(r["at"]) for r in sorted(rows, key=lambda r: r["j"])]


def binned(d: DataFrame, cuts: list[np.ndarray], keep: list[str]) -> DataFrame:
    """``keep``, y, fold, x (one byte a feature: the number of split points below the value) and h, the order of the draws."""
    def run(batches):
        for b in batches:
            x = np.asarray(b.column("features").flatten()).reshape(b.num_rows, -1)
            codes = np.empty(x.shape, np.uint8)
            for j, c in enumerate(cuts):
                codes[:, j] = np.searchsorted(c, x[:, j], side="left")
            cols = [b.column(c) for c in (*keep, "y", "fold", "h", "h2")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([r.tobytes() for r in codes], pa.binary())], names=[*keep, "y", "fold", "h", "h2", "x"])
    src = d.select(*keep, F.col("y").cast("int").alias("y"), F.col("fold").cast("int").alias("fold"), F.xxhash64("key").alias("h"),
                   F.xxhash64("features", "y").alias("h2"), "features")
    types = {f.name: f.dataType.simpleString() for f in src.schema}
    return src.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in (*keep, "y", "fold", "h", "h2")) + ", x binary")


class Tree:
    """Nodes level by level: feature (-1: leaf), bin, left child (the right one follows), rows c, positives p and the split's gain."""

    def __init__(self, x, y, rng, depth: int, tried: int, least: int):
        n, d = x.shape
        w = rng.poisson(1.0, n)
        rows = np.flatnonzero(w)
        both = (w + w * y.astype(np.int64) * (1 << 26)).astype(float)[rows]  # weight and positive weight in one sum, exact
        flat, node = x.ravel(), np.zeros(len(rows), np.int64)
        c, p = np.array([w.sum()], float), np.array([(w * y).sum()], float)
        self.levels = []
        for level in range(depth + 1):
            k = len(c)
            feature, cut, left, gain = np.full(k, -1, np.int32), np.zeros(k, np.int32), np.full(k, -1, np.int64), np.full(k, -1.0)
            open_ = np.flatnonzero((p > 0) & (p < c) & (c >= 2 * least)) if level < depth else np.empty(0, int)
            self.levels.append([feature, cut, left, c, p, gain])
            if not len(open_):
                break
            to = np.full(k, -1, np.int64)
            to[open_] = np.arange(len(open_))
            node = to[node]
            stay = node >= 0
            rows, node, both = rows[stay], node[stay], both[stay]
            tries = np.argpartition(rng.random((len(open_), d), np.float32), tried - 1, axis=1)[:, :tried] if tried < d else np.tile(np.arange(d), (len(open_), 1))
            f, b, lw, lp, g = self._best(flat, d, rows, node, both, tries, c[open_], p[open_], least)
            split = f >= 0
            at = open_[split]
            feature[at], cut[at], gain[at], left[at] = f[split], b[split], g[split], 2 * np.arange(len(at))
            c2, p2 = np.empty(2 * len(at)), np.empty(2 * len(at))
            c2[0::2], p2[0::2] = lw[split], lp[split]
            c2[1::2], p2[1::2] = c[at] - lw[split], p[at] - lp[split]
            stay = split[node]
            rows, node, both = rows[stay], node[stay], both[stay]
            right = flat[rows * d + f[node]] > b[node]
            node = (2 * (np.cumsum(split) - 1))[node] + right
            c, p = c2, p2
            if not len(at):
                break

    @staticmethod
    def _best(flat, d, rows, node, both, tries, c, p, least):
        k, m = tries.shape
        f, b = np.full(k, -1, np.int64), np.zeros(k, np.int64)
        lw, lp, g = np.zeros(k), np.zeros(k), np.zeros(k)
        order = np.argsort(node, kind="stable")
        rows, node, both = rows[order], node[order], both[order]
        ends = np.searchsorted(node, np.arange(0, k + SCORED, SCORED))
        for i, lo in enumerate(range(0, k, SCORED)):
            hi, s = min(k, lo + SCORED), slice(ends[i], ends[i + 1])
            at = node[s] - lo
            cells = flat[(rows[s] * d)[:, None] + tries[node[s]]] + ((at * m)[:, None] + np.arange(m)) * BINS
            cum = np.bincount(cells.ravel(), np.repeat(both[s], m), (hi - lo) * m * BINS).reshape(hi - lo, m, BINS).cumsum(2)[:, :, :-1].reshape(hi - lo, -1)
            pos = np.floor(cum * (1.0 / (1 << 26)))
            cum -= pos * (1 << 26)
            cc, pp = c[lo:hi, None], p[lo:hi, None]
            other, ppos = cc - cum, pp - pos
            with np.errstate(divide="ignore", invalid="ignore"):
                lost = pos * (cum - pos) / cum + ppos * (other - ppos) / other  # half the weighted Gini impurity of both sides
            lost[(cum < least) | (other < least)] = np.inf
            best = lost.argmin(1)
            one = np.arange(hi - lo)
            won = p[lo:hi] * (c[lo:hi] - p[lo:hi]) / c[lo:hi] - lost[one, best]
            good = won > 1e-9
            j, cut = best // (BINS - 1), best % (BINS - 1)
            f[lo:hi] = np.where(good, tries[lo + one, j], -1)
            b[lo:hi], lw[lo:hi], lp[lo:hi], g[lo:hi] = cut, cum[one, best], pos[one, best], 2 * won / c[lo:hi]
        return f, b, lw, lp, g

    def inner(self, depth: int, min_split: int) -> list[np.ndarray]:
        """Of every level, which nodes are split in the tree of ``depth`` after taking back and cutting."""
        levels, out = self.levels[:depth + 1], []
        below = np.empty(0, bool), np.empty(0, bool)
        for i in range(len(levels) - 1, -1, -1):
            feature, _, left, c, p, _ = levels[i]
            split, says = (feature >= 0) & (i < depth), p > c - p
            at = np.flatnonzero(split)
            if len(at):
                a, z = left[at], left[at] + 1
                split[at] = below[0][a] | below[0][z] | (below[1][a] != below[1][z])
            out.append(split)
            below = split, says
        return [s & (lv[3] >= min_split) for s, lv in zip(reversed(out), levels)]

    def shares(self, x, depth: int, min_split: int) -> np.ndarray:
        """P(y = 1) of the leaf that every row falls into."""
        n, d = x.shape
        flat, rows, at, out = x.ravel(), np.arange(n), np.zeros(n, np.int64), np.empty(n)
        for (feature, cut, left, c, p, _), split in zip(self.levels, self.inner(depth, min_split)):
            go = split[at]
            end = ~go
            out[rows[end]] = p[at[end]] / c[at[end]]
            rows, at = rows[go], at[go]
            if not len(rows):
                break
            at = left[at] + (flat[rows * d + feature[at]] > cut[at])
        return out

    def nodes(self, depth: int, min_split: int) -> list[np.ndarray]:
        """id, feature, bin, left, right, c, p, gain of the nodes that can be reached, numbered from the root down."""
        inner, parts, reached, first = self.inner(depth, min_split), [], np.array([True]), 0
        for (feature, cut, left, c, p, gain), split in zip(self.levels, inner):
            split = split & reached
            n, at = int(reached.sum()), np.cumsum(split[reached]) - 1
            s, child = split[reached], first + n + 2 * at
            parts.append([first + np.arange(n), np.where(s, feature[reached], -1), cut[reached], np.where(s, child, -1), np.where(s, child + 1, -1),
                          c[reached], p[reached], np.where(s, gain[reached], -1.0)])
            if not s.any():
                break
            down = np.zeros(left[split].max() + 2, bool)
            down[left[split]] = down[left[split] + 1] = True
            nxt = np.zeros(max(len(down), int(left.max()) + 2), bool)
            nxt[:len(down)] = down
            first, reached = first + n, nxt
        return [np.concatenate(c) for c in zip(*parts)]


def _tried(setting: dict, d: int) -> int:
    return d if setting["numTrees"] == 1 else int(np.ceil(np.sqrt(d)))


def _least(setting: dict) -> int:
    return int(setting.get("minInstancesPerNode", 1))


def _matrix(t: pa.Table):
    """(rows by order of the draws, codes, y, fold)."""
    t = t.combine_chunks()
    order = np.lexsort((t.column("h2").to_numpy(), t.column("h").to_numpy()))
    t = t.take(order)
    col = t.column("x").combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1]
    x = np.frombuffer(col.buffers()[2], np.uint8)[ends[0]:ends[-1]].reshape(len(col), -1)
    return t, x, t.column("y").to_numpy().astype(np.int64), t.column("fold").to_numpy()


def _dealt(rows: DataFrame, units: list) -> DataFrame:
    return (rows.withColumn("unit", F.explode(F.sequence(F.lit(0), F.lit(len(units) - 1)))).repartition(len(units), "unit").groupBy("unit"))


def _grow(x, y, seed, number, depth, tried, least):
    return Tree(x, y, np.random.default_rng([seed % (1 << 63), number]), depth, tried, least)


def out_of_fold(d: DataFrame, settings: Sequence[dict], k: int, seed: int) -> DataFrame:
    """``setting, fold, key, y, proba`` of ``d(key, features, y, fold, rid)``; rid numbers the rows."""
    width = len(cuts := thresholds(d))
    groups: dict = {}
    for i, s in enumerate(settings):
        groups.setdefault((_tried(s, width), _least(s)), []).append(i)
    units = [(tried, least, of, fold, a) for (tried, least), of in groups.items()
             for a in range(0, max(settings[i]["numTrees"] for i in of), TREES) for fold in range(k)]

    def run(key, t):
        tried, least, of, fold, a = units[key[0].as_py()]
        t, x, y, folds = _matrix(t)
        learn, held = folds != fold, np.flatnonzero(folds == fold)
        lx, ly, hx = np.ascontiguousarray(x[learn]), y[learn], np.ascontiguousarray(x[held])
        sums = {i: np.zeros(len(held), np.int64) for i in of if settings[i]["numTrees"] > a}
        for number in range(a, min(a + TREES, max(settings[i]["numTrees"] for i in of))):
            mine = [i for i in sums if settings[i]["numTrees"] > number]
            tree = _grow(lx, ly, seed, number, max(settings[i]["maxDepth"] for i in mine), tried, least)
            for i in mine:
                sums[i] += np.rint(tree.shares(hx, settings[i]["maxDepth"], settings[i].get("minSamplesSplit", 2)) * POINT).astype(np.int64)
        rid = t.column("rid").take(pa.array(held)).combine_chunks()
        parts = [pa.table([pa.array(np.full(len(held), i, np.int32)), rid, pa.array(s)], names=["setting", "rid", "s"]) for i, s in sums.items()]
        return pa.concat_tables(parts) if len(held) else parts[0]
    sums = (_dealt(binned(d, cuts, ["rid"]), units).applyInArrow(run, "setting int, rid bigint, s bigint")
            .groupBy("setting", "rid").agg(F.sum("s").alias("s")))
    trees = F.element_at(F.array(*[F.lit(int(s["numTrees"])) for s in settings]), F.col("setting") + 1)
    return (sums.join(d.select("rid", "fold", "key", "y"), "rid")
            .select("setting", "fold", "key", F.col("y").cast("int").alias("y"), (F.col("s") / (trees.cast("double") * float(POINT))).alias("proba")))


NODES = ("treeID int, id int, feature int, threshold double, `left` int, `right` int, c double, p double, gain double")


def forest_nodes(d: DataFrame, setting: dict, seed: int) -> DataFrame:
    """The nodes of the forest of all rows of ``d(key, features, y, fold)``, the root of a tree first."""
    width = len(cuts := thresholds(d))
    units = list(range(0, setting["numTrees"], TREES))

    def run(key, t):
        a = units[key[0].as_py()]
        _, x, y, _ = _matrix(t)
        for number in range(a, min(a + TREES, setting["numTrees"])):
            tree = _grow(x, y, seed, number, setting["maxDepth"], _tried(setting, width), _least(setting))
            id_, f, b, left, right, c, p, gain = tree.nodes(setting["maxDepth"], setting.get("minSamplesSplit", 2))
            at = np.array([cuts[j][i] if j >= 0 else 0.0 for j, i in zip(f, b)])
            yield pa.RecordBatch.from_arrays([pa.array(v, ty) for v, ty in zip(
                (np.full(len(f), number), id_, f, at, left, right, c, p, gain), [pa.int32()] * 3 + [pa.float64()] + [pa.int32()] * 2 + [pa.float64()] * 3)],
                names=["treeID", "id", "feature", "threshold", "left", "right", "c", "p", "gain"])

    def whole(key, t):
        return pa.Table.from_batches(list(run(key, t)))
    return _dealt(binned(d, cuts, []), units).applyInArrow(whole, NODES)
