"""Readers and writers.

Everything goes through ``spark.read`` / ``DataFrame.write`` with explicit
schemas; nothing is read or written row by row on the driver.  Only the
selected columns are read (parquet column pruning), filters reach the scan.
"""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lowdata.functions.columns import present, blank_to, norm_headers, require_columns, spread_vector, to_bool, to_num, to_utc

# Header of the sweep's raw results table, in file order.
RAW_COLUMNS = ("prefix", "kind", "frac", "const_train_size", "variant", "used_gan", "tag",
               "auc", "pr_auc", "accuracy", "precision", "recall", "f1",
               "specificity", "balanced_accuracy", "mcc",
               "n_train_real", "n_train_synth", "n_train_total", "tn", "fp", "fn", "tp", "threshold",
               "seed", "test_start", "test_end", "test_window_days")
RAW_ORDER = ("run_append", "run_row")  # our own: when a run was appended, and its place
RAW_DOUBLE = {"frac", "auc", "pr_auc", "accuracy", "precision", "recall", "f1", "specificity",
              "balanced_accuracy", "mcc", "threshold"}
RAW_LONG = {"n_train_real", "n_train_synth", "n_train_total", "tn", "fp", "fn", "tp"}
RAW_INT = {"const_train_size", "seed", "test_window_days"}

# Column-name hints of the prediction reader, in preference order.
LABEL_HINTS = ("y_true", "labels", "y", "target")
SCORE_HINTS = ("y_proba", "proba", "prob", "score", "scores", "y_score", "preds")

SHARED = "*"  # split id of rows that every split holds

# Carried measures and run-tag pattern of the per-family metric files.
FAMILY_MEASURES = ("auc", "pr_auc", "f1", "balanced_accuracy", "mcc", "threshold", "n_train_real", "n_train_total")
FAMILY_TAG_PATTERN = r"^(.+?)_msmw_full_w(0?\.\d+)_s(\d+)_r(\d+)_(real|gan|oversample|smote)$"


# ------------------------------------------------------------------ S1 / S2 / S3 / S18

def load_samples(spark: SparkSession, path: str, features: str | None = "features", y: str = "y",
                 row_id: str = "row_id") -> DataFrame:
    """(row_id, y[, features]) from parquet; ``features=None`` reads the labels only."""
    df = spark.read.parquet(path)
    cols = [F.col(row_id).cast("long").alias("row_id"), F.col(y).cast("int").alias("y")]
    if features:
        cols.append(F.col(features).cast("array<double>").alias("features"))
    return df.select(*cols)


def load_metadata(df: DataFrame, blank_label: str = "Benign") -> DataFrame:
    """Normalised headers, required columns, UTC timestamps (bad -> null),
    trimmed family with null/blank -> ``blank_label`` ('Benign' or 'UNKNOWN')."""
    d = require_columns(norm_headers(df), ["sha", "timestamp", "family"])
    return d.select("*").withColumn("timestamp", to_utc("timestamp")).withColumn(
        "family", blank_to("family", blank_label))


def head_subset(df: DataFrame, n: int, order: str = "row_id") -> DataFrame:
    """The first n rows in row order (TakeOrderedAndProject, a bounded top-n)."""
    return df.orderBy(order).limit(n)


# ------------------------------------------------------------------ S4 / S5 / S19

def write_split(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Long split table, unique rows, one folder per split id."""
    (df.select("split_id", F.col("row_id").cast("long"), "part").dropDuplicates(["split_id", "row_id", "part"])
     .write.mode(mode).partitionBy("split_id").parquet(path))


def read_split(spark: SparkSession, path: str, split_id: str | None = None) -> DataFrame:
    d = spark.read.parquet(path)
    # rows stored under SHARED belong to every split
    return d.filter(F.col("split_id").isin(split_id, SHARED)).withColumn("split_id", F.lit(split_id)) if split_id is not None else d


INDEX_SCHEMA = T.StructType([T.StructField(k, T.ArrayType(T.LongType())) for k in
                             ("train_only", "indices", "train", "test")])


def write_index_json(df: DataFrame, path: str, shape: str = "train_only", per_file: int = 10_000) -> None:
    """Ids as index files of at most ``per_file`` consecutive ids' room, so no file or task holds them all."""
    d = df.select(F.col("row_id").cast("long").alias("row_id")).distinct()
    d = d.groupBy(F.floor(F.col("row_id") / per_file).alias("chunk")).agg(F.sort_array(F.collect_list("row_id")).alias(shape))
    if shape == "train":
        d = d.withColumn("test", F.array().cast("array<bigint>"))
    d.write.mode("overwrite").partitionBy("chunk").json(path)


def read_index_json(spark: SparkSession, path, reader: str = "scaler") -> DataFrame:
    """Row ids of index files (all files below ``path``).

    ``reader="scaler"`` prefers train_only, then indices, then train; ``"trainer"`` prefers train_only,
    then a train list without a test list, then indices, then the train part of a full split.
    """
    j = spark.read.schema(INDEX_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    alone = F.when(F.col("test").isNull(), F.col("train"))
    lists = ["train_only", "indices", "train"] if reader == "scaler" else ["train_only", alone, "indices", "train"]
    return j.select(F.explode(F.coalesce(*lists)).alias("row_id"))


# ------------------------------------------------------------------ S6 / S7 / S8 / S10 / S16

AUDIT_SCHEMA = T.StructType([
    T.StructField("train_pos_before_aug", T.LongType()), T.StructField("train_neg_before_aug", T.LongType()),
    T.StructField("train_total_before_aug", T.LongType()), T.StructField("train_pos_after_aug", T.LongType()),
    T.StructField("train_neg_after_aug", T.LongType()), T.StructField("train_total_after_aug", T.LongType()),
    T.StructField("aug_added", T.LongType()), T.StructField("ros_dup_ratio", T.DoubleType()),
    T.StructField("smote_k_neighbors", T.LongType()), T.StructField("smote_synth_count", T.LongType()),
    T.StructField("smote_med_nn_dist", T.DoubleType()),
    T.StructField("rf_params", T.StructType([
        T.StructField("n_estimators", T.LongType()), T.StructField("max_depth", T.LongType()),
        T.StructField("class_weight", T.StringType()), T.StructField("random_state", T.LongType())]))])

RUN_SCHEMA = T.StructType(
    [T.StructField("variant", T.StringType()), T.StructField("threshold", T.DoubleType())]
    + [T.StructField(c, T.LongType()) for c in ("n_train_real", "n_train_synth", "n_train_total")]
    + [T.StructField(c, T.DoubleType()) for c in ("accuracy", "precision", "recall", "f1", "specificity",
                                                 "balanced_accuracy", "mcc", "auc", "pr_auc")]
    + [T.StructField(c, T.LongType()) for c in ("tn", "fp", "fn", "tp")]
    + [T.StructField("scarce_real_frac", T.DoubleType()), T.StructField("const_train_size", T.LongType()),
       T.StructField("used_gan", T.BooleanType()), T.StructField("audit", AUDIT_SCHEMA),
       T.StructField("test_start", T.StringType()), T.StructField("test_end", T.StringType()),
       T.StructField("test_window_days", T.LongType()), T.StructField("tag", T.StringType())])


def write_runs(df: DataFrame, path: str, mode: str = "append") -> None:
    """Run metrics as JSON lines (nested audit); window fields only when both bounds exist,
    ``test_window_days`` = whole days between them."""
    d = df
    if "test_start" in d.columns and "test_end" in d.columns:
        both = F.col("test_start").isNotNull() & F.col("test_end").isNotNull()
        d = d.withColumn("test_window_days", F.when(both, F.datediff(
            to_utc("test_end"), to_utc("test_start"))))
    d.write.mode(mode).json(path)


def read_run_metrics(spark: SparkSession, path_glob: str, kind: str = "temporal",
                     one_object_per_file: bool = True) -> DataFrame:
    """Every metrics file at once; the run tag comes from the file name in either form
    ``..._metrics_{tag}.json`` or ``..._metrics__{tag}.json``; missing runs are simply absent.
    ``one_object_per_file=False`` reads JSON-lines files (as written by :func:`write_runs`)."""
    j = spark.read.schema(RUN_SCHEMA).option("multiLine", one_object_per_file).json(path_glob)
    name = F.col("_metadata.file_name")
    tag = F.regexp_extract(name, rf"_{kind}_metrics__?(.+)\.json$", 1)
    return j.withColumn("tag", F.coalesce(F.nullif(tag, F.lit("")), F.col("tag")))


def write_preds(df: DataFrame, path: str, mode: str = "append", by: str = "prefix") -> None:
    """Long predictions table, partitioned by prefix (not by tag: thousands of tags)."""
    df.write.mode(mode).partitionBy(by).parquet(path)


def write_preds_bucketed(df: DataFrame, table: str, path: str, buckets: int = 64, by: str = "tag", mode: str = "overwrite") -> DataFrame:
    """S8 as a table bucketed by run: what groups or joins predictions by run (E6-E8) reads them
    without a new shuffle.  One bucket file per task and bucket: rows are dealt to the buckets first."""
    spark = df.sparkSession
    df.repartition(buckets, by).write.mode(mode).option("path", path).bucketBy(buckets, by).sortBy(by).saveAsTable(table)
    return spark.table(table)


def append_raw(df: DataFrame, path: str) -> None:
    """Append run rows to the results table (no whole-file rewrite).

    Every file has all raw columns (null where the run has none) and the run order: the
    time of the append, then ``run_idx`` or else the row's place in the append.
    """
    have = {c: F.col(c) for c in df.columns}
    cols = [have.get(c, F.lit(None)).cast("string").alias(c) for c in RAW_COLUMNS]
    order = [F.lit(time.time_ns() // 1000).alias(RAW_ORDER[0]), have.get("run_idx", F.monotonically_increasing_id()).cast("long").alias(RAW_ORDER[1])]
    df.select(*cols, *order).write.mode("append").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, suffix: str = "", fmt: str = "parquet") -> str:
    """Overwrite a derived table (paired, paired_cv, ``_baopt`` / ``_mccopt`` / ``_f1opt``)."""
    out = path + suffix
    df.write.mode("overwrite").format(fmt).option("header", True).save(out)
    return out


# ------------------------------------------------------------------ S9 / S11 / S13

def _typed_raw(txt: DataFrame, columns: list[str], at) -> DataFrame:
    """Text columns of raw rows coerced; ``run_idx`` from the stored order, or else the row's place ``at``."""
    if set(RAW_ORDER) <= set(columns):
        order = F.struct(*[F.col(c).cast("long") for c in RAW_ORDER])
    else:  # a table from elsewhere: its row order
        order = F.struct(F.lit(0).cast("long").alias(RAW_ORDER[0]), at.alias(RAW_ORDER[1]))
    cols = [order.alias("run_idx")]
    for c in [c for c in columns if c not in RAW_ORDER]:
        if c == "used_gan":
            cols.append(to_bool(c, trim=True).alias(c))
        elif c in RAW_DOUBLE:
            cols.append(to_num(c).alias(c))
        elif c in RAW_LONG:
            cols.append(to_num(c).cast("long").alias(c))
        elif c in RAW_INT:
            cols.append(to_num(c).cast("int").alias(c))
        else:
            cols.append(F.nullif(F.col(c), F.lit("")).alias(c))
    d = txt.select(*cols)
    return d.withColumn("seed", F.coalesce("seed", F.lit(0)) if "seed" in d.columns else F.lit(0))


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """S11 (+ P5, P6, P10): results CSV with every column as text, then coerced:
    booleans by spelling, numbers by ``try_cast`` (``nan`` / blank -> null), seed 0 when absent;
    ``run_idx`` orders the runs over all appends."""
    txt = spark.read.option("header", True).csv(path)
    if set(RAW_ORDER) <= set(txt.columns):
        txt = spark.read.schema(", ".join(f"`{c}` string" for c in [*RAW_COLUMNS, *RAW_ORDER])).option("header", True).csv(path)
    return _typed_raw(txt, txt.columns, F.monotonically_increasing_id())


CORRUPT = "_corrupt"


def read_raw_checked(spark: SparkSession, path: str, need: tuple[str, ...] = ("tag", "frac", "variant")) -> tuple[DataFrame, DataFrame]:
    """S11 with quarantine: (kept rows as :func:`read_raw` gives them, refused rows ``line, reasons``).

    Refused are lines with too few or too many fields, rows without one of ``need``, and rows with text
    where a number or a boolean belongs (``nan`` and blanks are unknown numbers, not faults).  Every line but the
    headers is in exactly one of the two.
    """
    head = [c for c in spark.read.option("header", True).csv(path).columns]
    src = (spark.read.schema(", ".join(f"`{c}` string" for c in [*head, CORRUPT])).option("header", True).option("enforceSchema", True)
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False).csv(path))
    told = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    bad_number = lambda c: told(c).isNotNull() & (F.lower(told(c)) != "nan") & F.expr(f"try_cast(trim(`{c}`) as double)").isNull()
    numbers = [c for c in head if c in (*RAW_DOUBLE, *RAW_LONG, *RAW_INT)]
    reasons = F.array_compact(F.array(
        F.when(F.col(CORRUPT).isNotNull(), F.lit("fields")),
        *[F.when(F.col(CORRUPT).isNull() & told(c).isNull(), F.lit(f"no {c}")) for c in need if c in head],
        *[F.when(F.col(CORRUPT).isNull() & bad_number(c), F.lit(f"number {c}")) for c in numbers],
        *[F.when(F.col(CORRUPT).isNull() & told(c).isNotNull() & ~F.lower(told(c)).isin("true", "1", "yes", "false", "0", "no"), F.lit(f"boolean {c}")) for c in head if c == "used_gan"]))
    marked = src.withColumn("reasons", reasons).withColumn("_at", F.monotonically_increasing_id())
    line = F.coalesce(F.col(CORRUPT), F.concat_ws(",", *[F.coalesce(F.col(c), F.lit("")) for c in head]))
    kept = _typed_raw(marked.where(F.size("reasons") == 0), head, F.col("_at"))
    return kept, marked.where(F.size("reasons") > 0).select(line.alias("line"), "reasons")


def read_preds(df: DataFrame, y_col: str | None = None, p_col: str | None = None) -> DataFrame:
    """Pick the label and score columns of a predictions table.

    Label: first integer column whose name contains a label hint, else the first
    integer column.  Score: first column named like a score whose values are all
    finite and inside [-1e-6, 1 + 1e-6] (clipped to [0, 1]); else the first float
    column; else element 2 of a two-element probability array.
    Decisions use the schema plus one aggregate of min / max / finiteness.
    """
    ints = [c for c, t in df.dtypes if t in ("int", "bigint", "smallint", "tinyint")]
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    if y_col is None:
        named = [c for c in ints if any(h in c.lower() for h in LABEL_HINTS)]
        y_col = (named or ints or [df.columns[0]])[0]
    p_expr = None
    if p_col is None:
        cands = [c for c in floats if any(h in c.lower() for h in SCORE_HINTS)]
        if cands:
            st = df.agg(*[x for c in cands for x in (
                F.min(c).alias(f"mn_{c}"), F.max(c).alias(f"mx_{c}"),
                F.bool_and(~F.isnan(c) & (F.abs(c) < float("inf"))).alias(f"ok_{c}"))]).first()
            for c in cands:
                if st[f"ok_{c}"] and st[f"mn_{c}"] >= -1e-6 and st[f"mx_{c}"] <= 1 + 1e-6:
                    p_expr = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c).cast("double")))
                    break
        if p_expr is None and floats:
            p_expr = F.col(floats[0]).cast("double")
        if p_expr is None:
            arr = [c for c, t in df.dtypes if t.startswith("array<double") or t.startswith("array<float")]
            if not arr:
                raise ValueError("no usable score column")
            p_expr = F.element_at(arr[0], 2).cast("double")
    else:
        p_expr = F.col(p_col).cast("double")
    return df.select("*", F.col(y_col).cast("int").alias("y_true_sniffed"), p_expr.alias("proba_sniffed"))


def collect_runs_by_tag(df: DataFrame, name: str = "stem") -> DataFrame:
    """Parse (family, frac, seed, const, variant) out of per-family file stems; others dropped.
    The runs' measures are carried where the input has them."""
    stem = F.regexp_replace(F.regexp_replace(F.col(name), "^_+", ""), "_+$", "")
    ok = stem.rlike(FAMILY_TAG_PATTERN)
    g = lambda i: F.regexp_extract(stem, FAMILY_TAG_PATTERN, i)
    return df.filter(ok).select(
        F.concat(g(1), F.lit("_msmw_full")).alias("prefix"), g(1).alias("family"),
        g(2).cast("double").alias("frac"), g(3).cast("int").alias("seed"),
        g(4).cast("int").alias("const_train_size"), g(5).alias("variant"), *present(df, FAMILY_MEASURES))


# ------------------------------------------------------------------ S12 / S14 / S15

def write_by_family(df: DataFrame, path: str) -> None:
    """One folder per family, its files together sorted by (frac, variant, seed).

    Ranges of the whole order are dealt to tasks, so a large family becomes several files;
    their names continue the order.  The sort starts with the family because the writer
    asks for that and would otherwise sort anew.
    """
    order = ["family", "frac", "variant", "seed"]
    (df.repartitionByRange(*order).sortWithinPartitions(*order)
     .write.mode("overwrite").partitionBy("family").option("header", True).csv(path))


def write_csv_split(df: DataFrame, path: str, n_features: int, label: str = "y") -> None:
    """Subset / train / test as CSV with ``feat_i`` columns plus the label."""
    spread_vector(df, "features", n_features, label).write.mode("overwrite").option("header", True).csv(path)


def write_scaler(scaler: DataFrame, path: str) -> None:
    """The one-row scaler table."""
    scaler.select("mean", "scale").coalesce(1).write.mode("overwrite").parquet(path)


def read_scaler(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("mean", "scale")


def tag_from_file(name: str, kind: str = "temporal") -> str | None:
    m = re.search(rf"_{kind}_metrics__?(.+)\.json$", name)
    return m.group(1) if m else None
