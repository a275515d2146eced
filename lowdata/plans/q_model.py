"""Registered queries: spark.ml fits and the end-to-end run evaluation.

A forest's scores are not expressible in SQL: the queries that return them have no
twin, and a ``*_check`` query beside each holds what is exact - split and fold sizes, labels against
thresholds, a threshold's optimality for the scores, a reloaded model, every count and audit
of a run - against SQL.  Binding: ``embeddings`` with a stratified 25% test split (D5).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lowdata.operators import augment as au
from lowdata.operators import evaluation as ev
from lowdata.operators import model as md
from lowdata.operators import sampling as sa
from lowdata.plans.q_sampling import sql_largest_remainder, u
from lowdata.plans.queries import QUERIES
from lowdata.session import scratch_path
from lowdata.sources import fixtures as fx

SMALL_FOREST = dict(trees=20, depth=6, seed=42)


def reg(name, sql):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def split_embeddings(spark, sf):
    return sa.stratified_split(fx.embeddings(spark, sf), "y", 0.25, 42)


@reg("class_weight", f"""
WITH e AS {fx.SQL_EMBEDDINGS}, c AS (SELECT y, count(*) AS nc FROM e GROUP BY y), n AS (SELECT count(*) AS n FROM e)
SELECT e.row_id, CAST(n.n AS DOUBLE) / (2.0 * c.nc) AS weight FROM e JOIN c ON e.y = c.y CROSS JOIN n""")
def q_class_weight(spark, sf):
    """M2: balanced class weights n / (2 n_c)."""
    return md.with_class_weight(fx.embeddings(spark, sf), "y", "balanced").select("row_id", "weight")


SQL_SPLIT = f"""e AS {fx.SQL_EMBEDDINGS}, cc AS (SELECT y, count(*) AS n_c FROM e GROUP BY y),
q AS {sql_largest_remainder('cc', 'n - ceil(CAST(0.25 AS DOUBLE) * n)', 'q_train')},
r AS (SELECT e.row_id, e.y, row_number() OVER (PARTITION BY e.y ORDER BY {u(42, 'split', 'e.row_id')}, e.row_id) AS rn FROM e),
parts AS (SELECT r.row_id, r.y, CASE WHEN r.rn <= q.n_c - q.q_train THEN 'test' ELSE 'train' END AS part FROM r JOIN q ON r.y = q.y)"""


def _wrong():
    """Rows whose score is no probability or whose label contradicts it."""
    ok = (F.col("proba") >= 0) & (F.col("proba") <= 1) & (F.col("y_pred") == (F.col("proba") >= 0.5).cast("int"))
    return F.count_if(~F.coalesce(ok, F.lit(False))).alias("n_bad")


def forest_scores(spark, sf):
    d = split_embeddings(spark, sf)
    m = md.fit_forest(d.filter("part = 'train'"), **SMALL_FOREST)
    return md.score(m, d.filter("part = 'test'")).select("row_id", "y", "proba", "y_pred")


@reg("forest_scores", None)
def q_forest_scores(spark, sf):
    """M1 + M3: random forest on the train part, P(y=1) and 0/1 prediction on the test part."""
    return forest_scores(spark, sf)


@reg("forest_scores_check", f"""WITH {SQL_SPLIT}
SELECT y, count(*) AS n, CAST(0 AS BIGINT) AS n_bad FROM parts WHERE part = 'test' GROUP BY y""")
def q_forest_scores_check(spark, sf):
    """M1 + M3: the test part is scored row for row, labels follow the scores."""
    return forest_scores(spark, sf).groupBy("y").agg(F.count(F.lit(1)).alias("n"), _wrong())


def threshold_run(spark, sf):
    return md.fit_run(au.as_train(split_embeddings(spark, sf).filter("part = 'train'")), "balacc", 42, 20, 6)


@reg("fit_with_threshold", None)
def q_fit_with_threshold(spark, sf):
    """M4: validation rows (20% of the train part) with the threshold chosen on them."""
    run = threshold_run(spark, sf)
    return run.val.select("row_id", "y", "proba", (F.col("proba") >= run.threshold).cast("int").alias("y_pred"),
                          F.lit(run.threshold).alias("threshold"))


@reg("fit_with_threshold_check", f"""WITH {SQL_SPLIT}, tc AS (SELECT y, count(*) AS n_c FROM parts WHERE part = 'train' GROUP BY y),
vq AS {sql_largest_remainder('tc', 'n - ceil(CAST(0.2 AS DOUBLE) * n)', 'q_train')}
SELECT CAST(sum(n_c - q_train) AS BIGINT) AS n_val, CAST(sum(CASE WHEN y = 1 THEN n_c - q_train END) AS BIGINT) AS n_pos,
       true AS on_grid, true AS best FROM vq""")
def q_fit_with_threshold_check(spark, sf):
    """M4: validation sizes; the threshold lies on the grid of 200 steps and no grid point has a higher balanced accuracy."""
    run = threshold_run(spark, sf)
    near = round(run.threshold * 200)
    cells = run.val.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(199))))
    said = F.col("proba") >= F.col("i").cast("double") * F.lit(1.0 / 200)
    g = cells.groupBy("i").agg(F.count_if(said & (F.col("y") == 1)).alias("tp"), F.count_if(~said & (F.col("y") == 0)).alias("tn"),
                               F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n"))
    g = g.withColumn("score", (F.col("tp") / F.col("p") + F.col("tn") / F.col("n")) / 2)
    return g.agg(F.max(F.col("p") + F.col("n")).alias("n_val"), F.max("p").alias("n_pos"),
                 F.lit(abs(near / 200 - run.threshold) < 1e-9).alias("on_grid"),
                 (F.max("score") - F.max(F.when(F.col("i") == near, F.col("score"))) < 1e-9).alias("best"))


@reg("cross_validate", None)
def q_cross_validate(spark, sf):
    """M5: 5-fold stratified CV: mean and population std of accuracy, F1, AUC."""
    return md.cross_validate(fx.embeddings(spark, sf), 5, 42, 20, 6)


@reg("cross_validate_check", f"""
SELECT fold, count(*) AS n, count_if(y = 1) AS n_pos, CAST(0 AS BIGINT) AS n_bad FROM (
  SELECT y, CAST((row_number() OVER (PARTITION BY y ORDER BY {u(42, 'fold')}, row_id) - 1) % 5 AS INTEGER) AS fold FROM {fx.SQL_EMBEDDINGS} s)
GROUP BY fold""")
def q_cross_validate_check(spark, sf):
    """M5: every row is scored once, in its own fold."""
    s = md.cv_scores(fx.embeddings(spark, sf), 5, 42, 10, 4)
    return s.groupBy("fold").agg(F.countDistinct("row_id").alias("n"), F.count_if(F.col("y") == 1).alias("n_pos"), _wrong())


def _search_table(spark, settings, aucs):
    best = max(range(len(aucs)), key=lambda i: aucs[i])
    rows = [(i, s["numTrees"], s["maxDepth"], s.get("minInstancesPerNode", 1), s.get("minSamplesSplit", 2), float(a), i == best)
            for i, (s, a) in enumerate(zip(settings, aucs))]
    return spark.createDataFrame(rows, "setting int, trees int, depth int, min_leaf int, min_split int, auc double, best boolean")


@reg("grid_search", None)
def q_grid_search(spark, sf):
    """M6: search over the light preset, exact AUC, hash folds: every setting with its AUC."""
    _, _, aucs = md.grid_search(fx.embeddings(spark, sf), "light", parallelism=4)
    return _search_table(spark, md.grid_settings("light"), aucs)


@reg("random_search", None)
def q_random_search(spark, sf):
    """M7: 20 seeded draws on a stratified fifth of the rows, exact cross-validated AUC."""
    _, _, aucs = md.random_search(fx.embeddings(spark, sf), parallelism=4)
    return _search_table(spark, md.random_params(), aucs)


CHECKED_SETTINGS = [{"numTrees": 5, "maxDepth": 3}, {"numTrees": 8, "maxDepth": 6, "minInstancesPerNode": 2, "minSamplesSplit": 9}]


@reg("search_check", f"""
WITH f AS (SELECT row_id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY {u(42, 'fold')}, row_id) - 1) % 3 AS INTEGER) AS fold FROM {fx.SQL_EMBEDDINGS} s)
SELECT setting, fold, count(*) AS n, count_if(y = 1) AS n_pos, CAST(0 AS BIGINT) AS n_bad, true AS auc_agrees
FROM f, (SELECT unnest([0, 1]) AS setting) t GROUP BY setting, fold""")
def q_search_check(spark, sf):
    """M6 / M7: every setting scores every row once, out of fold, and its AUC is the share of ordered (positive, negative) pairs."""
    s = md.search_scores(fx.embeddings(spark, sf), CHECKED_SETTINGS, 3, 42, 4)
    keys = ["setting", "fold"]
    n = s.groupBy(*keys).agg(F.count_distinct("key").alias("n"), F.count_if(F.col("y") == 1).alias("n_pos"),
                             F.count_if(F.isnan("proba") | (F.col("proba") < 0) | (F.col("proba") > 1)).alias("n_bad"))
    exact = ev.ranking_metrics(s.withColumnRenamed("y", "y_true"), keys)
    # Mann-Whitney ranks per fold, independent of the running sums
    rank = s.select(*keys, "y", "proba").groupBy(*keys, "proba").agg(F.count_if(F.col("y") == 1).alias("p"), F.count("*").alias("m"))
    w = Window.partitionBy(*keys).orderBy("proba").rowsBetween(Window.unboundedPreceding, -1)
    mid = F.coalesce(F.sum("m").over(w), F.lit(0)) + (F.col("m") + 1) / 2
    u_stat = (rank.withColumn("r", mid).groupBy(*keys).agg(F.sum(F.col("r") * F.col("p")).alias("r"), F.sum("p").alias("p"), F.sum("m").alias("m"))
              .select(*keys, ((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("m") - F.col("p")))).alias("mw")))
    return (n.join(exact, keys).join(u_stat, keys)
            .select(*keys, "n", "n_pos", "n_bad", (F.abs(F.col("auc") - F.col("mw")) < 1e-9).alias("auc_agrees")))


@reg("min_split_check", f"""
SELECT 12 AS trees, CAST(0 AS BIGINT) AS small_inner, true AS some_cut, true AS leaves_agree, count(*) AS n_scored FROM {fx.SQL_EMBEDDINGS} s""")
def q_min_split_check(spark, sf):
    """M7 min samples split: a forest cut at 20 rows has no inner node of fewer, keeps every other split, and scores every row."""
    e = fx.embeddings(spark, sf).withColumn("y", F.col("y").cast("double"))
    full = md.forest(12, None, 42).fit(md.with_vector(e))
    cut = md.cut_small_splits(full, 20, spark)
    a, b = (scratch_path(spark, f"forest-check-{uuid.uuid4().hex}") for _ in range(2))
    full.write().overwrite().save(a)
    cut.write().overwrite().save(b)
    before, after = ((md.forest_nodes(p, spark).groupBy("treeID").agg(
        F.count_if((F.col("nodeData.leftChild") >= 0) & (F.col("nodeData.rawCount") < 20)).alias("small"),
        F.count_if((F.col("nodeData.leftChild") >= 0) & (F.col("nodeData.rawCount") >= 20)).alias("large"))) for p in (a, b))
    t = before.join(after.select("treeID", F.col("small").alias("small2"), F.col("large").alias("large2")), "treeID")
    n = md.score(cut, e).where("proba between 0 and 1").count()
    return t.agg(F.count("*").cast("int").alias("trees"), F.sum("small2").alias("small_inner"), (F.sum("small") > 0).alias("some_cut"),
                 F.bool_and(F.col("large") == F.col("large2")).alias("leaves_agree")).withColumn("n_scored", F.lit(n).cast("long"))


def reloaded(spark, sf):
    path = scratch_path(spark, f"model-{uuid.uuid4().hex[:8]}")
    e = fx.embeddings(spark, sf)
    kept = md.fit_final(e, path, 20, 6)
    return md.score(kept, e).select("row_id", "proba"), md.score(md.load_model(path), e)


@reg("fit_final", None)
def q_fit_final(spark, sf):
    """M8 + S17: refit on everything, save, load back and score."""
    return reloaded(spark, sf)[1].groupBy("y_pred").agg(F.count(F.lit(1)).alias("n"))


@reg("fit_final_check", f"SELECT y, count(*) AS n, CAST(0 AS BIGINT) AS n_bad, CAST(0 AS BIGINT) AS n_changed FROM {fx.SQL_EMBEDDINGS} e GROUP BY y")
def q_fit_final_check(spark, sf):
    """M8 + S17: the reloaded model scores every row as the saved one did."""
    before, after = reloaded(spark, sf)
    both = after.join(before.withColumnRenamed("proba", "was"), "row_id", "left")
    return both.groupBy("y").agg(F.count(F.lit(1)).alias("n"), _wrong(), F.count_if(~F.col("proba").eqNullSafe(F.col("was"))).alias("n_changed"))


RUN_FRAC, RUN_FLOOR, CONST_SHARE = 0.5, 5, 0.8


def embedding_runs(spark, sf, **settings):
    """(samples, runs): every variant at one fraction, grown to 80% of the train part; one run is rebalanced."""
    from lowdata.plans.evaluate import RunSpec
    d = split_embeddings(spark, sf)
    const = int(-(-d.filter("part = 'train'").count() * 8 // 10))
    base = dict(seed=42, frac=RUN_FRAC, const_train_size=const, min_pos=RUN_FLOOR, min_neg=RUN_FLOOR)
    runs = [RunSpec(**base, variant=v, tag=f"emb_{v}", **settings) for v in ("real", "oversample", "smote", "gan")]
    return d, [*runs, RunSpec(**base, variant="smote", balance=True, val_source="real", tag="emb_balanced", **settings)]


@reg("evaluate_runs", None)
def q_evaluate_runs(spark, sf):
    """Scarce -> augment -> fit -> validation threshold -> score -> metrics for every variant."""
    from lowdata.plans.evaluate import evaluate_runs
    d, runs = embedding_runs(spark, sf, trees=100, depth=10)
    metrics, _ = evaluate_runs(d, runs)
    return metrics.select("tag", "variant", "frac", "threshold", "n_pos", "n_neg", "accuracy", "f1",
                          "balanced_accuracy", "mcc", "auc", "pr_auc")


@reg("evaluate_runs_check", f"""WITH {SQL_SPLIT},
t AS (SELECT count_if(y = 1) AS P, count_if(y = 0) AS Q, count(*) AS N FROM parts WHERE part = 'train'),
te AS (SELECT count_if(y = 1) AS n_pos, count_if(y = 0) AS n_neg FROM parts WHERE part = 'test'),
a AS (SELECT P, Q, N, greatest(1, CAST(round_even(CAST({RUN_FRAC} AS DOUBLE) * N, 0) AS BIGINT)) AS tot, CAST(P AS DOUBLE) / N AS prior FROM t),
b AS (SELECT *, least(P, greatest({RUN_FLOOR}, CAST(round_even(tot * prior, 0) AS BIGINT))) AS p0 FROM a),
b2 AS (SELECT *, least(Q, greatest({RUN_FLOOR}, tot - p0)) AS q0 FROM b),
s AS (SELECT q0 AS n_drawn, p0 + greatest(0, least(P - p0, tot - p0 - q0)) AS p_drawn, CAST(ceil(N * 8 / 10.0) AS BIGINT) AS const FROM b2),
s2 AS (SELECT p_drawn AS p, n_drawn AS n, const FROM s),
v AS (SELECT unnest(['real', 'oversample', 'smote', 'gan', 'balanced']) AS kind),
g AS (SELECT kind, p, n, CASE WHEN kind = 'real' OR const <= p + n THEN 0
             WHEN kind = 'gan' THEN least(const - p - n, 2 * greatest(1, p)) ELSE const - p - n END AS added FROM s2, v),
f AS (SELECT *, CASE WHEN kind = 'balanced' THEN least(p + added, n) ELSE p + added END AS pa,
             CASE WHEN kind = 'balanced' THEN least(p + added, n) ELSE n END AS na FROM g)
SELECT 'emb_' || kind AS tag, te.n_pos, te.n_neg, CAST(p AS BIGINT) AS train_pos_before_aug, CAST(n AS BIGINT) AS train_neg_before_aug,
       CAST(pa AS BIGINT) AS train_pos_after_aug, CAST(na AS BIGINT) AS train_neg_after_aug, CAST(pa + na - p - n AS BIGINT) AS aug_added,
       CAST(CASE WHEN kind IN ('smote', 'balanced') AND added > 0 THEN 5 END AS BIGINT) AS smote_k_neighbors,
       CAST(CASE WHEN kind IN ('smote', 'balanced') AND added > 0 THEN added END AS BIGINT) AS smote_synth_count,
       CAST(10 AS BIGINT) AS n_estimators, CAST(added AS BIGINT) AS n_train_synth,
       CAST(0 AS BIGINT) AS val_not_in_train, CAST(0 AS BIGINT) AS train_test_overlap, CAST(0 AS BIGINT) AS val_test_overlap,
       CAST(0 AS BIGINT) AS sha_overlap, true AS ok
FROM f, te""")
def q_evaluate_runs_check(spark, sf):
    """E11 + D20 + S7 + S6: sizes, augmentation and leakage counts of every run, through the stored run metrics."""
    from lowdata.plans.evaluate import evaluate_runs, run_records
    from lowdata.sources import io
    d, runs = embedding_runs(spark, sf, trees=10, depth=4)
    metrics, audits = evaluate_runs(d, runs)
    path = scratch_path(spark, f"run-records-{uuid.uuid4().hex[:8]}")
    io.write_runs(run_records(metrics, audits), path)
    back = io.read_run_metrics(spark, path + "/*.json", one_object_per_file=False)
    cells = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    return back.join(audits.drop("n_train_real", "n_train_synth", "n_train_total", "audit", "threshold"), "tag").select(
        "tag", cells[0].alias("n_pos"), cells[1].alias("n_neg"),
        *[F.col(f"audit.{c}").alias(c) for c in ("train_pos_before_aug", "train_neg_before_aug", "train_pos_after_aug", "train_neg_after_aug",
                                                 "aug_added", "smote_k_neighbors", "smote_synth_count")],
        F.col("audit.rf_params.n_estimators").alias("n_estimators"), "n_train_synth", "val_not_in_train", "train_test_overlap",
        "val_test_overlap", "sha_overlap", "ok")


def temporal_runs(spark, sf):
    """(metrics, audits): every variant at one fraction, grown to 80% of the train part, scored on every 6-day window (step 3)."""
    from lowdata.operators import splits as sp
    from lowdata.plans.evaluate import RunSpec, evaluate_runs
    d = sp.temporal_holdout(fx.events(spark, sf), "2024-01-10 00:00:00")
    win = sp.rolling_windows(d.filter("part = 'test'"), 6, 3)
    const = int(-(-d.filter("part = 'train'").count() * 8 // 10))
    runs = [RunSpec(seed=42, frac=0.05, variant=v, const_train_size=const, min_pos=20, min_neg=20, trees=10, depth=5,
                    tag=f"ev_r005_{v}") for v in ("real", "oversample", "smote", "gan")]
    return evaluate_runs(d, runs, win, 6, 3)


@reg("evaluate_runs_temporal", None)
def q_evaluate_runs_temporal(spark, sf):
    """E11 temporal regime: events holdout, one fit per run scoring every 6-day window (step 3)."""
    metrics, _ = temporal_runs(spark, sf)
    return metrics.select("tag", "variant", "window_id", "n_pos", "n_neg", "accuracy", "balanced_accuracy", "auc")


@reg("evaluate_runs_temporal_check", None)
def q_evaluate_runs_temporal_check(spark, sf):
    """E11 temporal regime: every run scores every row of every window."""
    return q_evaluate_runs_temporal(spark, sf).select("tag", "window_id", "n_pos", "n_neg")


def _temporal_check_sql() -> str:
    from lowdata.plans.queries import SQL_EVENTS_TEST_WINDOWS
    return "WITH " + SQL_EVENTS_TEST_WINDOWS + """
SELECT 'ev_r005_' || v.v AS tag, window_id, count_if(y = 1) AS n_pos, count_if(y = 0) AS n_neg
FROM ev_rows, (SELECT unnest(['real', 'oversample', 'smote', 'gan']) AS v) v GROUP BY ALL"""


QUERIES["evaluate_runs_temporal_check"] = (q_evaluate_runs_temporal_check, _temporal_check_sql())


@reg("evaluate_runs_temporal_added_check", f"""
WITH t AS (SELECT count_if(event_type = 'error') AS P, count(*) AS N FROM events WHERE ts IS NULL OR ts <= TIMESTAMP '2024-01-10 00:00:00'),
a AS (SELECT P, N - P AS Q, greatest(1, CAST(round_even(CAST(0.05 AS DOUBLE) * N, 0) AS BIGINT)) AS tot, CAST(P AS DOUBLE) / N AS prior, N FROM t),
b AS (SELECT *, least(P, greatest(20, CAST(round_even(tot * prior, 0) AS BIGINT))) AS p0 FROM a),
b2 AS (SELECT *, least(Q, greatest(20, tot - p0)) AS q0 FROM b),
s AS (SELECT q0 AS n, p0 + greatest(0, least(P - p0, tot - p0 - q0)) AS p, CAST(ceil(N * 8 / 10.0) AS BIGINT) AS const FROM b2),
v AS (SELECT unnest(['real', 'oversample', 'smote', 'gan']) AS kind)
SELECT 'ev_r005_' || kind AS tag, CAST(p + n AS BIGINT) AS n_train_real,
       CAST(CASE WHEN kind = 'real' THEN 0 WHEN kind = 'gan' THEN least(greatest(const - p - n, 0), 2 * greatest(1, p))
                 ELSE greatest(const - p - n, 0) END AS BIGINT) AS aug_added
FROM s, v""")
def q_evaluate_runs_temporal_added_check(spark, sf):
    """E11 temporal regime: rows that every variant really adds to the scarce sample."""
    _, audits = temporal_runs(spark, sf)
    return audits.select("tag", "n_train_real", F.col("audit.aug_added").alias("aug_added"))


@reg("evaluate_runs_metrics_check", f"""WITH {SQL_SPLIT}
SELECT 'm_' || v.v AS tag, count(*) AS n_rows, count_if(y = 1) AS n_pos, true AS counts_agree, true AS auc_agrees, true AS preds_agree
FROM parts, (SELECT unnest(['real', 'oversample', 'smote']) AS v) v WHERE part = 'test' GROUP BY v.v""")
def q_evaluate_runs_metrics_check(spark, sf):
    """The metrics of every run against its committed predictions: counts and AUC by plain SQL over pairs of rows."""
    from lowdata.plans.evaluate import RunSpec, evaluate_runs
    from lowdata.sources.ledger import RunLedger
    d = split_embeddings(spark, sf)
    ledger = RunLedger(spark, scratch_path(spark, f"sweep-{uuid.uuid4().hex}"))
    const = d.where("part = 'train'").count()
    runs = [RunSpec(seed=42, frac=0.5, variant=v, const_train_size=const, min_pos=10, min_neg=10, trees=10, depth=5, tag=f"m_{v}") for v in ("real", "oversample", "smote")]
    metrics, _ = evaluate_runs(d, runs, ledger=ledger)
    of = [(c["attempt"], rid.rsplit("-", 1)[0], c["facts"]["threshold"]) for rid, c in ledger.finished().items()]
    p = spark.read.parquet(f"{ledger.path}/runs/preds").join(spark.createDataFrame(of, "attempt string, tag string, threshold double"), "attempt")
    return spark.sql("""
      WITH c AS (SELECT tag, count(*) AS n_rows, count_if(y_true = 1) AS n_pos, count_if(y_true = 1 AND proba >= threshold) AS tp,
                        count_if(y_true = 0 AND proba >= threshold) AS fp, bool_and(y_pred = CAST(proba >= threshold AS INT)) AS preds_agree FROM {p} GROUP BY tag),
           a AS (SELECT x.tag, avg(CASE WHEN x.proba > z.proba THEN 1.0D WHEN x.proba = z.proba THEN 0.5D ELSE 0.0D END) AS auc
                 FROM {p} x JOIN {p} z ON x.tag = z.tag WHERE x.y_true = 1 AND z.y_true = 0 GROUP BY x.tag)
      SELECT c.tag, c.n_rows, c.n_pos, m.tp = c.tp AND m.fp = c.fp AND m.fn = c.n_pos - c.tp AND m.n_pos = c.n_pos AS counts_agree,
             abs(m.auc - a.auc) < 1e-9 AS auc_agrees, c.preds_agree
      FROM c JOIN a ON a.tag = c.tag JOIN {m} m ON m.tag = c.tag""", p=p, m=metrics)
