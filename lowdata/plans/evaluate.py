"""End-to-end evaluation of many runs (E11): scarce -> augment -> rebalance -> tune or fit ->
threshold -> score -> audit -> metrics.

A run's training depends on its own settings only; test windows only
change which rows are scored.  So each distinct training is fitted once and scores the whole
test set with its window ids attached.  Runs with the same sample share it; a few
runs are fitted at a time (``parallelism``), so the cluster is not idle between their small
jobs.  Every run writes its predictions into its own folder of a table under the shared
checkpoint folder, or of a run ledger, from which an interrupted sweep goes on.  One job audits all
runs, one computes all metrics of all runs and windows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool
from typing import Any

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lowdata.operators import augment as au
from lowdata.operators import evaluation as ev
from lowdata.operators import model as md
from lowdata.operators import sampling as sa
from lowdata.operators import splits as sp
from lowdata.session import cut_lineage, materialize, scratch_path
from lowdata.sources.io import AUDIT_SCHEMA
from lowdata.sources.ledger import RunLedger


@dataclass
class RunSpec:
    seed: int
    frac: float
    variant: str = "real"            # real | oversample | smote | gan
    const_train_size: int | None = None
    min_pos: int = 50
    min_neg: int = 50
    balance: bool = False
    balance_ratio: float = 1.0
    trees: int = 100
    depth: int | None = None
    class_weight: str | None = None
    tune: str | dict | None = None   # a grid preset's name, or a grid
    val_threshold: str = "balacc"    # balacc | f1 | mcc | none
    val_source: str = "augmented"    # augmented | real: rows that the threshold is chosen on
    smote_k: int = 5
    gan_quality: str = "nn"          # none | nn | nn_boundary
    gan_qmult: float = 5.0
    gan_per_real: float = 2.0
    gan_like: str = "scarce"
    gan_boundary_low: float = 0.20
    gan_boundary_high: float = 0.60
    gan_sampler: str = "diag_gaussian"  # diag_gaussian | gmm | mlp
    gan_layers: list | None = None   # mlp: [(weights, biases), ...]
    gan_params: str | None = None    # mlp: path of a stored parameter table, instead of gan_layers
    gan_scaler: Any = None           # mlp: one-row scaler table; None = fitted on the gate's positives
    tag: str = ""
    extra: dict = field(default_factory=dict)


@dataclass
class Sample:
    """The scarce sample that the runs of one (seed, fraction, floors) share."""
    rows: DataFrame
    real: DataFrame
    n_pos: int
    n_neg: int


def draw_sample(train_full: DataFrame, spec: RunSpec) -> Sample:
    # lineage is cut after each stage: stacked exact-size samplers reference their input twice
    rows = cut_lineage(sa.scarce_sample(train_full, spec.frac, spec.seed, spec.min_pos, spec.min_neg))
    c = rows.agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n")).first()
    return Sample(rows, au.as_train(rows), c["p"], c["n"])


def synthetic_candidates(train_full: DataFrame, pos: DataFrame, spec: RunSpec, n: int) -> DataFrame:
    """Candidates of the run's generator."""
    spark = train_full.sparkSession
    if spec.gan_sampler == "gmm":
        return au.sample_gmm(spark, au.fit_sampler(pos, "gmm", seed=spec.seed), n, spec.seed).drop("component")
    if spec.gan_sampler == "mlp":
        layers = au.read_layers(spark.read.parquet(spec.gan_params)) if spec.gan_params else spec.gan_layers
        if not layers:
            raise ValueError("the mlp generator needs its layers or the path of its parameter table")
        scaler = spec.gan_scaler if spec.gan_scaler is not None else au.fit_scaler(pos)
        return au.inverse_scale(au.generate(spark, layers, n, spec.seed), scaler)
    return au.sample_diag_gaussian(spark, au.fit_scaler(pos), n, spec.seed)


def build_train(train_full: DataFrame, sample: Sample, spec: RunSpec) -> tuple[DataFrame, int]:
    """(augmented train set, synthetic rows added before any rebalancing)."""
    n_real = sample.n_pos + sample.n_neg
    need = 0
    if spec.variant != "real":
        budget = au.augment_budget(F.lit(n_real), F.lit(sample.n_pos), F.lit(spec.const_train_size).cast("long"), F.lit(spec.variant),
                                   spec.gan_per_real)
        need = int(train_full.sparkSession.range(1).select(budget.alias("n")).first()["n"])
    aug = sample.real
    if need and spec.variant == "oversample":
        aug = au.oversample_to_const(sample.real, spec.const_train_size, spec.seed)
    elif need and spec.variant == "smote":
        aug = au.smote_to_const(sample.real, spec.const_train_size, spec.seed, spec.smote_k).select(*au.AUG_COLS)
    elif need and spec.variant == "gan":
        like = sample.rows if spec.gan_like == "scarce" else train_full.filter(F.col("y") == 1)
        pos, neg = au.gate_sets(train_full, like, "scarce")
        cands = synthetic_candidates(train_full, pos, spec, au.n_candidates(need, spec.gan_qmult))
        kept = au.quality_gate(cands, need, spec.gan_quality, pos, neg, spec.gan_boundary_low, spec.gan_boundary_high, spec.seed)
        aug = au.with_synth(sample.real, au.gan_synth(kept))
    if spec.balance:
        aug = sa.rebalance(aug, spec.balance_ratio, spec.seed)
    return cut_lineage(aug), need


def audit_facts(sample: dict, after: dict, spec: RunSpec, need: int, nn_median: float | None) -> dict:
    """Class counts before and after, rows added, diagnostics of the variant, forest settings."""
    smote = spec.variant == "smote" and need > 0
    before, total = sample["p"] + sample["n"], after["p"] + after["n"]
    return {
        "train_pos_before_aug": sample["p"], "train_neg_before_aug": sample["n"], "train_total_before_aug": before,
        "train_pos_after_aug": after["p"], "train_neg_after_aug": after["n"], "train_total_after_aug": total, "aug_added": total - before,
        "ros_dup_ratio": 1.0 - after["distinct"] / total if spec.variant == "oversample" and total else None,
        "smote_k_neighbors": spec.smote_k if smote else None, "smote_synth_count": need if smote else None, "smote_med_nn_dist": nn_median,
        "rf_params": {"n_estimators": spec.trees, "max_depth": spec.depth, "class_weight": spec.class_weight, "random_state": spec.seed},
    }


def train_digest(aug: DataFrame) -> DataFrame:
    """What the audit needs of a train set: ``y, is_synth`` and a digest of the features."""
    return aug.select(F.col("y").cast("int").alias("y"), "is_synth", F.sha2(F.concat_ws(",", F.col("features").cast("array<string>")), 256).alias("x"))


AUDITS = T.StructType([T.StructField("run_id", T.IntegerType()), T.StructField("tag", T.StringType()), T.StructField("threshold", T.DoubleType()),
                       T.StructField("n_train_real", T.LongType()), T.StructField("n_train_synth", T.LongType()),
                       T.StructField("n_train_total", T.LongType()), T.StructField("audit", AUDIT_SCHEMA)])


def run_id(spec: RunSpec) -> str:
    """A name for a run's settings: its tag and a digest of all plain settings (of tables only their presence)."""
    plain = {k: v for k, v in vars(spec).items() if k not in ("gan_layers", "gan_scaler")}
    layers = [(np.asarray(w).tolist(), np.asarray(b).tolist()) for w, b in spec.gan_layers or []]
    return f"{spec.tag}-{hashlib.sha256(repr((sorted(plain.items()), layers, spec.gan_scaler is not None)).encode()).hexdigest()[:16]}"


def evaluate_runs(samples: DataFrame, runs: Sequence[RunSpec], windows: DataFrame | None = None, days: int | None = None,
                  step: int | None = None, out_name: str = "preds", strict: bool = True,
                  parallelism: int = 2, ledger: RunLedger | None = None) -> tuple[DataFrame, DataFrame]:
    """Fit every training once, score the test part (per window when given), audit all runs in one
    job and compute all run metrics in one job.  ``samples`` carries ``part`` and ``sha``.

    Returns (metrics per run [and window], audit per run: train sizes, the ``audit`` struct of the run
    metrics file and the leakage counts).  With ``strict`` any leakage raises.

    With a ``ledger`` a sweep can be resumed: every run's predictions, members and facts are committed
    there once it is scored, and runs that are committed already are not fitted again.  A ledger
    belongs to one table of samples and one set of windows.
    """
    spark: SparkSession = samples.sparkSession
    train_full = samples.filter(F.col("part") == "train").drop("part")
    tested = samples.filter(F.col("part") == "test").drop("part")
    ids = [run_id(spec) if ledger else str(i) for i, spec in enumerate(runs)]
    done = {k: v for k, v in (ledger.finished() if ledger else {}).items() if k in set(ids)}
    todo = {rid: spec for rid, spec in zip(ids, runs) if rid not in done}
    if todo and windows is not None:
        test = sp.assign_windows(tested, windows, days, step).select("row_id", "y", "features", "window_id")
        test = cut_lineage(test)  # read by every run
    else:
        test = tested.select("row_id", "y", "features", F.lit(None).cast("int").alias("window_id"))
    base = f"{ledger.path}/runs" if ledger else scratch_path(spark, f"{out_name}-{uuid.uuid4().hex[:12]}")
    drawn: dict = {}
    for spec in todo.values():
        at = (spec.seed, spec.frac, spec.min_pos, spec.min_neg)
        if at not in drawn:
            drawn[at] = draw_sample(train_full, spec)

    def one(job: tuple[str, RunSpec]) -> tuple[str, dict]:
        rid, spec = job
        attempt = uuid.uuid4().hex if ledger else rid
        sample = drawn[(spec.seed, spec.frac, spec.min_pos, spec.min_neg)]
        aug, need = build_train(train_full, sample, spec)
        fitted = md.fit_run(aug, spec.val_threshold, spec.seed, spec.trees, spec.depth, spec.class_weight, spec.tune, spec.val_source)
        scored = md.score(fitted.model, test, fitted.threshold).select(
            "window_id", "row_id", F.col("y").cast("int").alias("y_true"), "proba", "y_pred")
        scored.write.mode("overwrite").parquet(f"{base}/preds/attempt={attempt}")
        members = sample.rows.select("row_id", F.lit("train").alias("part"))
        if fitted.val is not None:  # synthetic rows have no row id
            members = members.unionByName(fitted.val.where("row_id is not null").select("row_id", F.lit("val").alias("part")))
        members.write.mode("overwrite").parquet(f"{base}/members/attempt={attempt}")
        train_digest(aug).write.mode("overwrite").parquet(f"{base}/train/attempt={attempt}")
        median = au.smote_nn_median(aug).first()[0] if spec.variant == "smote" and need and not aug.where("is_synth").isEmpty() else None
        facts = {"threshold": float(fitted.threshold), "need": need, "sample": {"p": sample.n_pos, "n": sample.n_neg}, "smote_med_nn_dist": median}
        if ledger:
            ledger.commit(rid, attempt, None, facts)
        return rid, {"attempt": attempt, "facts": facts}

    with ThreadPool(max(1, min(parallelism, len(todo) or 1))) as pool:
        done |= dict(pool.map(inheritable_thread_target(spark)(one), list(todo.items()), chunksize=1))
    mine = sorted({d["attempt"] for d in done.values()})
    stored = lambda kind, schema: (spark.read.schema(f"{schema}, attempt string").parquet(f"{base}/{kind}")
                                   .where(F.col("attempt").isin(mine)))
    # the train sets of all runs in one aggregate, one row a run
    after = {r["attempt"]: r.asDict() for r in stored("train", "y int, is_synth boolean, x string").groupBy("attempt").agg(
        F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n"), F.count_distinct("x").alias("distinct")).collect()} if mine else {}
    rows, told = [], []
    for i, (rid, spec) in enumerate(zip(ids, runs)):
        facts = done[rid]["facts"]
        audit = audit_facts(facts["sample"], after.get(done[rid]["attempt"], {"p": 0, "n": 0, "distinct": 0}), spec, facts["need"], facts["smote_med_nn_dist"])
        rows.append((done[rid]["attempt"], i, spec.tag, spec.variant, float(spec.frac), int(spec.seed), facts["threshold"]))
        told.append({"run_id": i, "tag": spec.tag, "threshold": facts["threshold"], "n_train_real": audit["train_total_before_aug"],
                     "n_train_synth": facts["need"], "n_train_total": audit["train_total_after_aug"], "audit": audit})
    # one row a run; a run given twice reads the same files twice; written, so that Spark knows that it is small and no run's rows meet in one task
    of = materialize(spark.createDataFrame(rows, "attempt string, run_id int, tag string, variant string, frac double, seed int, threshold double").coalesce(1))
    members = stored("members", "row_id bigint, part string").join(of, "attempt").select("run_id", "row_id", "part")
    leaks = sp.audit_runs(members, tested.select("row_id", "sha"), samples.select("row_id", "sha"), "run_id", strict)
    audits = spark.createDataFrame(told, AUDITS).join(leaks, "run_id", "left")
    keys = ["run_id", "tag", "variant", "frac", "seed", "window_id", "threshold"]
    preds = stored("preds", "window_id int, row_id bigint, y_true int, proba double, y_pred int").join(of, "attempt").drop("attempt")
    return ev.evaluate(preds, keys, "y_true", "proba", threshold="threshold"), audits


def run_records(metrics: DataFrame, audits: DataFrame) -> DataFrame:
    """Metrics and audits as the rows that ``write_runs`` (S7) stores."""
    a = audits.select("run_id", "n_train_real", "n_train_synth", "n_train_total", "audit")
    return (metrics.join(a, "run_id").withColumn("scarce_real_frac", F.col("frac")).withColumn("used_gan", F.col("variant") == "gan")
            .drop("run_id", "n_pos", "n_neg"))
