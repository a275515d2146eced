"""Training-set augmentation.

An augmented train set has ``uid STRING, row_id BIGINT (null for synthetic),
y INT, features ARRAY<DOUBLE>, is_synth BOOLEAN, src_row_id BIGINT``.
Draws are made in place: positives are ranked by a seeded hash, and the positive of rank r
of p makes the draws floor(need (r - 1) / p) up to floor(need r / p), exploded from its own row (systematic
resampling: every positive is drawn as often as any other, but for one draw, and which get that one is left to the
hash).  No table of draws is joined with anything, and a positive with very many draws is many tasks.
Oversampling can also draw at random with replacement: a table of draws, each with the rank that its hash picks, is joined
with the ranked positives.
What else is random is a seeded md5 uniform of the draw, so the synthetic rows are the same whatever the
partitioning; only per-run scalars (class counts, need) reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lowdata.functions.hashing import normal, uniform
from lowdata.operators.knn import knn, nn_dist
from lowdata.operators.layout import spread
from lowdata.operators.ranking import hash_rank, join_small, take_first, take_nearest, with_scalars
from lowdata.operators.relational import exact_quantiles
from lowdata.session import materialize

AUG_COLS = ["uid", "row_id", "y", "features", "is_synth", "src_row_id"]


def as_train(df: DataFrame, y: str = "y", features: str = "features") -> DataFrame:
    """Real rows in the augmented-set schema."""
    return df.select(F.concat(F.lit("r:"), F.col("row_id").cast("string")).alias("uid"),
                     F.col("row_id").cast("long").alias("row_id"), F.col(y).cast("int").alias("y"),
                     F.col(features).alias("features"), F.lit(False).alias("is_synth"),
                     F.col("row_id").cast("long").alias("src_row_id"))


def with_synth(real: DataFrame, synth: DataFrame) -> DataFrame:
    """Append synthetic positives to real rows."""
    return real.select(*AUG_COLS).unionByName(synth.select(*AUG_COLS))


def _counts(df: DataFrame, y: str = "y"):
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == 1).alias("p")).first()
    return int(r["n"]), int(r["p"])


def _ranked_positives(df: DataFrame, seed: int, stream: str) -> DataFrame:
    pos = df.filter(F.col("y") == 1).withColumn("_u", uniform(F.lit(seed), F.lit(stream), F.col("row_id")))
    return hash_rank(pos, None, "_u", "row_id", out="pos_rank").drop("_u")


DRAWS_AT_ONCE = 1 << 14  # of one positive in a task


def _draws_in_place(pos: DataFrame, need: int, p: int) -> DataFrame:
    """Ranked positives, each as often as it is drawn, with the number of the ``draw`` (0 .. need - 1)."""
    upto = lambda r: F.expr(f"{need}L * ({r}) div {p}L")
    mine = pos.withColumn("_lo", upto("pos_rank - 1")).withColumn("_hi", upto("pos_rank")).where("_hi > _lo")
    part = mine.withColumn("_c", F.explode(F.expr(f"sequence(0L, (_hi - _lo - 1) div {DRAWS_AT_ONCE}L)")))
    first = F.col("_lo") + F.col("_c") * DRAWS_AT_ONCE
    return (spread(part, "row_id", "_c")
            .withColumn("draw", F.explode(F.sequence(first, F.least(F.col("_hi"), first + DRAWS_AT_ONCE) - 1)))
            .drop("_lo", "_hi", "_c"))


# ------------------------------------------------------------------ A3

def augment_budget(n_real, n_real_pos, const, variant, per_real=None):
    """A3: synthetic rows to add: const - n when const > n; GAN capped at int(per_real * max(1, pos))."""
    n_real, n_real_pos, const, variant = (F.col(c) if isinstance(c, str) else c
                                          for c in (n_real, n_real_pos, const, variant))
    need = F.when(const.isNotNull() & (const > n_real), const - n_real).otherwise(F.lit(0))
    if per_real is None:
        cap = need
    else:
        cap = F.least(need, F.floor(F.lit(float(per_real)) * F.greatest(F.lit(1), n_real_pos)).cast("long"))
    return F.when(variant == "real", F.lit(0)).when(variant == "gan", cap).otherwise(need).cast("long")


# ------------------------------------------------------------------ A1

def _random_draws(pos: DataFrame, need: int, p: int, seed: int, stream: str) -> DataFrame:
    """Ranked positives joined with ``need`` independent draws (with replacement) of one of them."""
    at = F.floor(uniform(F.lit(seed), F.lit(stream), F.col("draw")) * F.lit(p)) + 1
    draws = pos.sparkSession.range(need).select(F.col("id").alias("draw")).withColumn("pos_rank", at.cast("long"))
    return join_small(draws, pos, ["pos_rank"])


def oversample_to_const(train: DataFrame, target: int | None, seed: int = 42, draws: str = "dealt") -> DataFrame:
    """A1: duplicate positives until the set has ``target`` rows: ``dealt`` evenly in place, or each drawn at ``random`` (with replacement)."""
    if draws not in ("dealt", "random"):
        raise ValueError(f"unknown kind of draws: {draws}")
    real = as_train(train) if "uid" not in train.columns else train
    n, p = _counts(real)
    if target is None or target <= n or p == 0:
        return real
    pos = _ranked_positives(real.filter(~F.col("is_synth")), seed, "os-order").select("pos_rank", "row_id", "features")
    drawn = _draws_in_place(pos, target - n, p) if draws == "dealt" else _random_draws(pos, target - n, p, seed, "os")
    syn = drawn.select(
        F.concat(F.lit("os:"), F.col("draw").cast("string")).alias("uid"), F.lit(None).cast("long").alias("row_id"),
        F.lit(1).alias("y"), "features", F.lit(True).alias("is_synth"), F.col("row_id").alias("src_row_id"))
    return with_synth(real, syn)


# ------------------------------------------------------------------ A2

def smote_to_const(train: DataFrame, target: int | None, seed: int = 42, k: int = 5) -> DataFrame:
    """A2: SMOTE among positives: bases dealt evenly, neighbour uniform among the base's k_eff nearest
    (self excluded; one random other positive of the base when none), point ``x_i + t (x_j - x_i)``.
    Fewer than 2 positives -> A1.

    Each base row takes up its at most k neighbours' features (joins of p x k rows), then makes its draws in place.
    """
    real = as_train(train) if "uid" not in train.columns else train
    n, p = _counts(real)
    if target is None or target <= n:
        return real
    if p < 2:
        return oversample_to_const(real, target, seed)
    k_eff = min(int(k), max(1, p - 1))
    pos = materialize(_ranked_positives(real, seed, "sm-order").select("pos_rank", "row_id", "features"))
    x = pos.select(F.col("row_id").alias("nbr_id"), F.col("features").alias("xj"))
    near = (knn(pos, pos, k_eff, "row_id", "row_id", "features").filter(F.col("q_id") != F.col("nbr_id")).join(x, "nbr_id")
            .groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("nbr_rank", "nbr_id", "xj"))).alias("_near"))
            .withColumnRenamed("q_id", "row_id"))
    other = (F.floor(uniform(F.lit(seed), F.lit("sm-alt"), F.col("row_id")) * F.lit(p - 1)) + 1).cast("long")
    alone = (pos.join(near, "row_id", "left_anti")
             .withColumn("_at", F.when(other >= F.col("pos_rank"), other + 1).otherwise(other)).select("row_id", "_at")
             .join(pos.select(F.col("pos_rank").alias("_at"), F.col("row_id").alias("nbr_id"), F.col("features").alias("xj")), "_at")
             .select("row_id", F.array(F.struct(F.lit(1).alias("nbr_rank"), "nbr_id", "xj")).alias("_near")))
    bases = pos.join(near.unionByName(alone), "row_id")
    pick = (F.floor(uniform(F.lit(seed), F.lit("sm-j"), F.col("draw")) * F.size("_near")) + 1).cast("int")
    d = (_draws_in_place(bases, target - n, p).withColumn("_to", F.element_at("_near", pick))
         .withColumn("_t", uniform(F.lit(seed), F.lit("sm-t"), F.col("draw"))))
    syn = d.select(
        F.concat(F.lit("sm:"), F.col("draw").cast("string")).alias("uid"), F.lit(None).cast("long").alias("row_id"),
        F.lit(1).alias("y"), F.zip_with("features", "_to.xj", lambda a, b: a + F.col("_t") * (b - a)).alias("features"),
        F.lit(True).alias("is_synth"), F.col("row_id").alias("src_row_id"), F.col("_to.nbr_id").alias("_nbr"), "_t", F.col("draw").alias("_draw"))
    return real.select(*AUG_COLS, F.lit(None).cast("long").alias("_nbr"), F.lit(None).cast("double").alias("_t"),
                       F.lit(None).cast("long").alias("_draw")).unionByName(syn)


# ------------------------------------------------------------------ A14 / A6 / A15

def fit_scaler(df: DataFrame, features: str = "features") -> DataFrame:
    """Per-feature mean and population std (zero -> 1) as one row of two arrays.

    One pass of spark.ml's ``Summarizer`` over whole vectors (null vectors are skipped).
    No row at all is an error: there is nothing to scale by.
    """
    v = df.where(F.col(features).isNotNull()).select(array_to_vector(F.col(features).cast("array<double>")).alias("v"))
    s = v.select(Summarizer.metrics("count", "mean", "variance").summary(F.col("v")).alias("s"))
    n = F.col("s.count").cast("double")
    enough = F.assert_true(F.col("s").isNotNull() & (n > 0), F.lit("no rows to fit a scaler on"))
    std = F.transform(vector_to_array("s.variance"), lambda x: F.sqrt(x * (n - 1) / n))
    return s.select(F.when(enough.isNull(), vector_to_array("s.mean")).alias("mean"),
                    F.transform(std, lambda x: F.when(x == 0, F.lit(1.0)).otherwise(x)).alias("scale"))


def inverse_scale(df: DataFrame, scaler: DataFrame, features: str = "features") -> DataFrame:
    """``x * scale + mean`` against a one-row scaler table."""
    j = join_small(df, scaler.select("mean", "scale"), [])
    x = F.zip_with(F.zip_with(features, "scale", lambda a, s: a * s), "mean", lambda a, m: a + m)
    return j.withColumn(features, x).drop("mean", "scale")


def profile_vectors(df: DataFrame, features: str = "features") -> DataFrame:
    """N, dim, mean, population std, min, max and any non-finite over all elements.

    Every vector is reduced in place to its count, mean, squared deviations and extremes.
    """
    n = F.size("x").cast("double")
    total = lambda f: F.aggregate("x", F.lit(0.0), f)
    e = (df.select(F.col(features).cast("array<double>").alias("x")).where(F.size("x") > 0)
         .select("x", n.alias("n"), (total(lambda a, x: a + x) / n).alias("m"))
         .select("n", "m", total(lambda a, x: a + (x - F.col("m")) * (x - F.col("m"))).alias("ss"), F.array_min("x").alias("lo"),
                 F.array_max("x").alias("hi"), F.exists("x", lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf")))).alias("bad")))
    g = e.agg(F.max("n").cast("int").alias("dim"), F.sum("n").alias("N"), F.sum(F.col("n") * F.col("m")).alias("S"),
              F.sum(F.col("ss") + F.col("n") * F.col("m") * F.col("m")).alias("SS"), F.min("lo").alias("min"), F.max("hi").alias("max"),
              F.bool_or("bad").alias("any_nonfinite"))
    mean = F.col("S") / F.col("N")
    return g.select("dim", F.col("N").cast("long").alias("n_values"), mean.alias("mean"),
                    F.sqrt(F.greatest(F.lit(0.0), F.col("SS") / F.col("N") - mean * mean)).alias("std"), "min", "max", "any_nonfinite")


# ------------------------------------------------------------------ A5 / A16 generators

def latents(spark: SparkSession, n_gen: int, zdim: int, seed: int) -> DataFrame:
    """Standard-normal latent vectors from seeded hashes: ``gen_id, z ARRAY<DOUBLE>``."""
    g = spark.range(n_gen).withColumnRenamed("id", "gen_id")
    z = F.transform(F.sequence(F.lit(0), F.lit(zdim - 1)),
                    lambda j: normal(F.lit(seed), F.lit("z"), F.col("gen_id"), j))
    return g.withColumn("z", z)


def _mlp_fn(bc):
    def run(it):
        layers = bc.value
        for pdf in it:
            if len(pdf) == 0:
                continue
            h = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["z"].values])
            for i, (w, b) in enumerate(layers):
                h = h @ w + b
                if i < len(layers) - 1:
                    h = np.maximum(h, 0.0)
            yield pd.DataFrame({"gen_id": pdf["gen_id"].values, "features": list(h)})
    return run


def generate(spark: SparkSession, layers: list[tuple[np.ndarray, np.ndarray]], n_gen: int, seed: int) -> DataFrame:
    """A5: synthetic candidates from a ReLU MLP (weights ``[(W, b), ...]``, W: in x out) on
    hash-derived normal latents; the weights are broadcast, batches go through NumPy."""
    zdim = layers[0][0].shape[0]
    bc = spark.sparkContext.broadcast([(np.asarray(w, float), np.asarray(b, float)) for w, b in layers])
    return latents(spark, n_gen, zdim, seed).mapInPandas(_mlp_fn(bc), "gen_id long, features array<double>")


def n_candidates(n: int, qmult: float) -> int:
    """Candidates generated for ``n`` wanted rows: max(n, ceil(qmult * n))."""
    return int(max(n, int(math.ceil(float(qmult) * n))))


def sample_diag_gaussian(spark: SparkSession, scaler: DataFrame, n_gen: int, seed: int) -> DataFrame:
    """A16 (re-aimed generator): ``mean + scale * N(0, 1)`` per feature from fitted moments."""
    g = spark.range(n_gen).withColumnRenamed("id", "gen_id")
    g = join_small(g, scaler.select("mean", "scale"), [])
    x = F.transform(F.arrays_zip("mean", "scale"),
                    lambda ms, j: ms["mean"] + ms["scale"] * normal(F.lit(seed), F.lit("diag"), F.col("gen_id"), j))
    return g.select("gen_id", x.alias("features"))


# ------------------------------------------------------------------ A8-A10, A17 quality gate

def gate_sets(train_full: DataFrame, scarce: DataFrame | None, like: str = "scarce"):
    """Positives for the gate (scarce sample, or full train; empty -> full) and
    negatives (always the full train)."""
    full_pos = train_full.filter(F.col("y") == 1)
    pos = full_pos
    if like == "scarce" and scarce is not None:
        sp = scarce.filter(F.col("y") == 1)
        pos = sp if sp.limit(1).count() > 0 else full_pos
    return pos, train_full.filter(F.col("y") == 0)


def quality_gate(cands: DataFrame, n: int, mode: str = "nn", pos: DataFrame | None = None,
                 neg: DataFrame | None = None, low: float = 0.20, high: float = 0.60,
                 seed: int = 42) -> DataFrame:
    """Keep ``n`` of the candidates ``(gen_id, features)``.

    none: first n; nn: n closest to the positives; nn_boundary: dpos <= median(dpos)
    and q_low(dneg) <= dneg <= q_high(dneg) -> n at random among them, or all of them
    plus the best remaining by dpos.  No positives -> none; no negatives -> nn.
    """
    if mode == "none" or pos is None or pos.limit(1).count() == 0:
        return cands.filter(F.col("gen_id") < n)
    dp = nn_dist(cands, pos, "gen_id", "row_id", "features", "dpos")
    if mode == "nn" or (mode == "nn_boundary" and (neg is None or neg.limit(1).count() == 0)):
        return take_nearest(materialize(dp), n, "dpos", "gen_id").drop("dpos")
    if mode != "nn_boundary":
        raise ValueError(f"unknown quality mode: {mode}")
    dn = materialize(nn_dist(dp, neg, "gen_id", "row_id", "features", "dneg"))
    q = with_scalars(exact_quantiles(dn, [], "dpos", [0.5]).select(F.col("_q")[0].alias("med")),
                     exact_quantiles(dn, [], "dneg", [float(low), float(high)]).select(F.col("_q")[0].alias("lo"), F.col("_q")[1].alias("hi")))
    d = join_small(dn, q, [])
    d = d.withColumn("ok", (F.col("dpos") <= F.col("med")) & (F.col("dneg") >= F.col("lo"))
                     & (F.col("dneg") <= F.col("hi"))).drop("med", "lo", "hi")
    n_ok = d.filter("ok").count()
    if n_ok >= n:
        pick = d.filter("ok").withColumn("_u", uniform(F.lit(seed), F.lit("gate"), F.col("gen_id")))
        return take_first(pick, None, n, "_u", "gen_id").drop("_u", "ok", "dpos", "dneg")
    fill = take_nearest(d.filter(~F.col("ok")), n - n_ok, "dpos", "gen_id")
    return d.filter("ok").unionByName(fill).drop("ok", "dpos", "dneg")


def gan_synth(cands_kept: DataFrame) -> DataFrame:
    """Kept candidates as synthetic positives in the augmented-set schema."""
    return cands_kept.select(F.concat(F.lit("gan:"), F.col("gen_id").cast("string")).alias("uid"),
                             F.lit(None).cast("long").alias("row_id"), F.lit(1).alias("y"), "features",
                             F.lit(True).alias("is_synth"), F.lit(None).cast("long").alias("src_row_id"))


# ------------------------------------------------------------------ A11 / A12 diagnostics

def dup_ratio(df: DataFrame, features: str = "features") -> DataFrame:
    """1 - distinct rows / rows."""
    return df.agg((F.lit(1.0) - F.countDistinct(F.col(features)) / F.count(F.lit(1))).alias("dup_ratio"))


def smote_nn_median(aug: DataFrame) -> DataFrame:
    """Median distance of synthetic rows to their nearest real positive."""
    syn = materialize(aug.filter("is_synth").select(F.monotonically_increasing_id().alias("sid"), "features"))
    real = aug.filter(~F.col("is_synth") & (F.col("y") == 1)).select("row_id", "features")
    d = nn_dist(syn, real, "sid", "row_id", "features", "d")
    return exact_quantiles(d, [], "d", [0.5]).select(F.col("_q")[0].alias("smote_med_nn_dist"))


# ------------------------------------------------------------------ A16 mixture sampler

def fit_sampler(df: DataFrame, kind: str = "diag_gaussian", k: int = 3, dims: int = 8, seed: int = 42):
    """Fit a tabular sampler on (positive) rows.

    ``diag_gaussian``: per-feature moments (the scaler table).  ``gmm``: the rows less their mean,
    projected on their ``dims`` first principal components, a spark.ml ``GaussianMixture`` of ``k``
    components there, and for every feature the variance that the projection leaves (all distributed
    fits); returns a small parameter dict that :func:`sample_gmm` broadcasts.
    """
    if kind == "diag_gaussian":
        return fit_scaler(df)
    if kind != "gmm":
        raise ValueError(f"unknown sampler kind: {kind}")
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import PCA
    raw = df.where(F.col("features").isNotNull()).select(F.col("features").cast("array<double>").alias("x"))
    mean = fit_scaler(raw, "x").first()["mean"]
    centred = raw.select(array_to_vector(F.zip_with("x", F.array(*map(F.lit, mean)), lambda a, m: a - m)).alias("fv"))
    pca = PCA(k=min(dims, len(mean)), inputCol="fv", outputCol="pc").fit(centred)
    z = pca.transform(centred)
    gm = GaussianMixture(k=k, featuresCol="pc", seed=seed).fit(z)
    g = gm.gaussiansDF.collect()  # k rows of (mean, cov): bounded by k x dims^2
    basis = pca.pc.toArray()
    both = z.select(Summarizer.metrics("variance").summary(F.col("fv")).alias("f"), Summarizer.metrics("variance").summary(F.col("pc")).alias("c")).first()
    left = both["f"]["variance"].toArray() - (basis ** 2) @ both["c"]["variance"].toArray()  # the components are uncorrelated
    return {"weights": np.asarray(gm.weights), "means": np.stack([r["mean"].toArray() for r in g]),
            "covs": np.stack([r["cov"].toArray() for r in g]), "basis": basis, "mean": np.asarray(mean), "left": np.maximum(left, 0.0)}


def _gmm_fn(bc, seed):
    def run(it):
        p = bc.value
        dims, wide = p["means"].shape[1], len(p["mean"])
        chol = [np.linalg.cholesky(c + 1e-12 * max(np.trace(c), 1e-300) * np.eye(dims)) for c in p["covs"]]
        cum, noise = np.cumsum(p["weights"]), np.sqrt(p["left"])
        for pdf in it:
            if len(pdf) == 0:
                continue
            u = pdf["u"].to_numpy()
            z = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["z"].values])
            comp = np.minimum(np.searchsorted(cum, u * cum[-1], side="right"), len(cum) - 1)
            pc = np.empty_like(z)
            for c in range(len(cum)):  # one matrix product per mixture component
                sel = comp == c
                pc[sel] = p["means"][c] + z[sel] @ chol[c].T
            own = np.stack([np.random.Generator(np.random.Philox(key=[seed, int(i)])).standard_normal(wide) for i in pdf["gen_id"]])
            x = p["mean"] + pc @ p["basis"].T + noise * own
            yield pd.DataFrame({"gen_id": pdf["gen_id"].values, "component": comp.astype("int32"), "features": list(x)})
    return run


def sample_gmm(spark: SparkSession, params: dict, n_gen: int, seed: int) -> DataFrame:
    """Draw ``n_gen`` rows from a fitted mixture: seeded component choice and normal latents, mapped back through the
    principal components, plus the mean and each feature's own remaining variance (noise of a generator keyed by
    the seed and ``gen_id``; parameters broadcast, NumPy batches)."""
    bc = spark.sparkContext.broadcast(params)
    g = latents(spark, n_gen, params["means"].shape[1], seed).withColumn("u", uniform(F.lit(seed), F.lit("gmm"), F.col("gen_id")))
    return g.mapInPandas(_gmm_fn(bc, seed), "gen_id long, component int, features array<double>")


# ------------------------------------------------------------------ A5 parameter table

BIAS_ROW = -1  # row number of a layer's bias
PARAM_BYTES = 64 << 20  # of all weights as float64, as they are broadcast


def layers_table(spark: SparkSession, layers: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Weights as rows ``layer, row, values``: one row per row of a layer's matrix, and one (row -1) for its bias."""
    rows = [(i, r, [float(v) for v in vec]) for i, (w, b) in enumerate(layers)
            for r, vec in [*enumerate(np.asarray(w)), (BIAS_ROW, np.asarray(b).reshape(-1))]]
    return spark.createDataFrame(rows, "layer int, row int, values array<double>")


def read_layers(params: DataFrame, max_bytes: int = PARAM_BYTES) -> list[tuple[np.ndarray, np.ndarray]]:
    """The layers of a parameter table, checked before anything is fetched: size, gapless layers and rows, one
    bias a layer, equal widths within a layer, each layer as wide as the next expects, finite numbers."""
    p = params.select(F.col("layer").cast("int").alias("layer"), F.col("row").cast("int").alias("row"), F.col("values").cast("array<double>").alias("v"))
    odd = F.exists(F.coalesce("v", F.array(F.lit(None).cast("double"))), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    size = p.agg(F.sum(F.size("v").cast("long") * 8).alias("bytes"), F.count_if(odd | F.col("row").isNull() | F.col("layer").isNull()).alias("odd"),
                 F.max("layer").alias("last")).first()
    if not size["bytes"]:
        raise ValueError("the parameter table is empty")
    if size["odd"]:
        raise ValueError(f"{size['odd']} parameter rows hold nulls or non-finite numbers")
    if size["bytes"] > max_bytes:
        raise ValueError(f"{size['bytes']} bytes of parameters; at most {max_bytes} are broadcast")
    shapes = {r["layer"]: r for r in p.groupBy("layer").agg(
        F.count_if(F.col("row") == BIAS_ROW).alias("biases"), F.count_if(F.col("row") >= 0).alias("rows"), F.max("row").alias("top"),
        F.count_distinct(F.when(F.col("row") >= 0, F.col("row"))).alias("distinct"), F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi")).collect()}
    width = None
    for i in range(size["last"] + 1):
        s = shapes.get(i)
        if s is None or s["biases"] != 1 or not s["rows"] or s["rows"] != s["distinct"] or s["top"] != s["rows"] - 1 or s["lo"] != s["hi"]:
            raise ValueError(f"layer {i} is not one bias and gapless rows of one width")
        if width is not None and s["rows"] != width:
            raise ValueError(f"layer {i} takes {s['rows']} numbers, layer {i - 1} gives {width}")
        width = s["hi"]
    held: dict = {}
    for r in p.collect():  # at most max_bytes
        held.setdefault(r["layer"], {})[r["row"]] = r["v"]
    return [(np.array([held[i][r] for r in range(len(held[i]) - 1)]), np.array(held[i][BIAS_ROW])) for i in range(len(held))]
