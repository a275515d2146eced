"""Blocks of the kNN join: exact within, bounded in rows and bytes, few for few rows."""

import tracemalloc

import numpy as np
import pytest

from lowdata.operators import knn as kn

VEC = "row_id long, features array<double>"


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], VEC)


def brute(q, r, rid, k):
    out = []
    for i in range(len(q)):
        with np.errstate(invalid="ignore"):
            d = np.sqrt(((r - q[i]) ** 2).sum(1))
        out += [(i, int(rid[j])) for j in np.lexsort((rid, d))[:k]]
    return out


RNG = np.random.default_rng(11)
CASES = {
    "plane": (RNG.normal(size=(150, 2)) * [90, 500], RNG.normal(size=(3000, 2)) * [90, 500]),
    "grid": (RNG.integers(0, 9, (150, 2)), RNG.integers(0, 9, (3000, 2))),
    "copies": (np.repeat(RNG.normal(size=(5, 2)), 30, axis=0), np.repeat(RNG.normal(size=(20, 2)), 90, axis=0)),
    "wide": (RNG.normal(size=(100, 24)), RNG.normal(size=(1500, 24))),
    "far": (1e7 + RNG.normal(size=(100, 3)), 1e7 + RNG.normal(size=(1500, 3))),
    "odd": (np.where(RNG.random((100, 2)) < 0.1, np.nan, RNG.normal(size=(100, 2))), np.where(RNG.random((1500, 2)) < 0.1, np.inf, RNG.normal(size=(1500, 2)))),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("k", [1, 4])
def test_a_block_is_scored_exactly(name, k):
    q, r = (np.asarray(x, float) for x in CASES[name])
    rid = RNG.permutation(len(r)).astype(np.int64)
    at, to, _ = kn._topk(q, r, rid, k)
    assert list(zip(at.tolist(), rid[to].tolist())) == brute(q, r, rid, k)


def test_a_block_in_the_plane_compares_few_pairs(monkeypatch):
    pairs, plain = [], kn._topk_block
    monkeypatch.setattr(kn, "_topk_block", lambda q, r, rid, k: pairs.append(len(q) * len(r)) or plain(q, r, rid, k))
    kn._topk(RNG.normal(size=(1000, 2)), RNG.normal(size=(9000, 2)), np.arange(9000), 2)
    assert sum(pairs) < 0.1 * 1000 * 9000


def test_scoring_holds_little_memory():
    q, r = RNG.normal(size=(2000, 64)), RNG.normal(size=(8000, 64))
    tracemalloc.start()
    kn._topk_exact(q, r, np.arange(8000), 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6


def test_blocks_are_bounded_in_rows_and_tiny_ones_are_not_dealt(spark, monkeypatch):
    r, q = frame(spark, RNG.normal(size=(900, 2))), frame(spark, RNG.normal(size=(50, 2)))
    monkeypatch.setattr(kn, "BLOCK_ROWS", 200)
    plan = kn._Index(q, r, 2, "row_id", "row_id", "features", kn.BLOCK_BYTES, None).plan
    assert ((plan["rows"] / plan["nr"]) <= 200).all() and len(plan) > 1
    monkeypatch.undo()
    assert kn._Index(q, r, 2, "row_id", "row_id", "features", 64, None, kn.LEAST_ROWS).parts == 1


def test_many_blocks_agree_with_brute_force(spark, monkeypatch):
    q, r = RNG.normal(size=(60, 2)) * 9, RNG.normal(size=(1200, 2)) * 9
    monkeypatch.setattr(kn, "BLOCK_ROWS", 100)
    monkeypatch.setattr(kn, "LEAST_ROWS", 50)
    rows = kn.knn(frame(spark, q), frame(spark, r), 3).orderBy("q_id", "nbr_rank").collect()
    assert [(x["q_id"], x["nbr_id"]) for x in rows] == brute(q, r, np.arange(1200), 3)
