"""Registered queries: sources, cleaning helpers and relational helpers
(S1-S18, P1-P6, P10, P14, P16, G1, G6, G8-G10, J1-J3, U2-U3, O1, O4, D20 SQL).

Edge values (blank / padded / null families, unparsable timestamps, boolean
spellings, ``nan`` text) are projected from the driver tables with CASE
rules on the row id, so every query still reads the whole table.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lowdata.functions.columns import keep_families, positives, require_columns, results_mode, spread_vector, to_bool, to_num
from lowdata.functions.hashing import md5_bucket, round_half_up, sql_md5_bucket, sql_round_half_up, sql_uniform
from lowdata.operators import relational as rl
from lowdata.operators import splits as sp
from lowdata.operators.ranking import with_position
from lowdata.plans.queries import QUERIES, sql_ts_text, ts_text
from lowdata.session import scratch_path
from lowdata.sources import fixtures as fx
from lowdata.sources import io
from lowdata.sources.ledger import RunLedger

HELD = ("src3", "src7")


def reg(name, sql):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def r6(c):
    from lowdata.functions.hashing import round_half_up
    return round_half_up(F.col(c) if isinstance(c, str) else c, 6)


# ------------------------------------------------------------------ S1 / S18 / P14

@reg("load_labels", "SELECT vec_id AS row_id, label AS y FROM embeddings")
def q_load_labels(spark, sf):
    """S1 with features=None: only the id and label columns are read (column pruning)."""
    return io.load_samples(spark, f"{sf}/embeddings.parquet", None, "label", "vec_id")


@reg("head_subset", "SELECT event_id AS row_id, event_type FROM events ORDER BY event_id LIMIT 1000")
def q_head_subset(spark, sf):
    """The first 1000 rows in row order (a bounded top-n is the feature)."""
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("row_id"), "event_type")
    return io.head_subset(e, 1000)


@reg("spread_vector", "SELECT " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS feat_{i}" for i in range(64))
     + ", CAST(label = 0 AS INTEGER) AS y FROM embeddings")
def q_spread_vector(spark, sf):
    """The feature array as feat_0 .. feat_63 plus the label."""
    return spread_vector(fx.embeddings(spark, sf), "features", 64, "y")


# ------------------------------------------------------------------ S2 / S3 / P1 / P3 / P4

def raw_metadata(spark, sf):
    """orders projected to a metadata file with messy headers, bad timestamps and blank families."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    k = F.col("o_orderkey")
    ts = (F.when(k % 13 == 0, F.lit("not a date")).when(k % 17 == 0, F.lit(None).cast("string"))
          .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")))
    fam = (F.when(k % 7 == 0, F.lit("")).when(k % 11 == 0, F.lit(None).cast("string"))
           .when(k % 5 == 0, F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" ")))
           .otherwise(F.col("o_orderpriority")))
    return o.select(F.col("o_orderkey").cast("string").alias(" SHA "), ts.alias("Timestamp "), fam.alias(" Family"))


SQL_RAW_META = """(SELECT CAST(o_orderkey AS VARCHAR) AS sha,
  CASE WHEN o_orderkey % 13 = 0 THEN 'not a date' WHEN o_orderkey % 17 = 0 THEN NULL
       ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS ts_text,
  CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN NULL
       WHEN o_orderkey % 5 = 0 THEN '  ' || o_orderpriority || ' ' ELSE o_orderpriority END AS fam_text
  FROM orders)"""


@reg("load_metadata", f"""
SELECT sha, {sql_ts_text('TRY_CAST(ts_text AS TIMESTAMP)')} AS timestamp,
       coalesce(nullif(trim(fam_text), ''), 'Benign') AS family FROM {SQL_RAW_META}""")
def q_load_metadata(spark, sf):
    """S2 + P1 + P3 + P4: header normalisation, UTC parse with coerce, blank family -> Benign."""
    m = io.load_metadata(raw_metadata(spark, sf), "Benign")
    return m.select("sha", ts_text("timestamp").alias("timestamp"), "family")


@reg("load_metadata_unknown", f"""
SELECT coalesce(nullif(trim(fam_text), ''), 'UNKNOWN') AS family, count(*) AS n FROM {SQL_RAW_META} GROUP BY ALL""")
def q_load_metadata_unknown(spark, sf):
    """S3: the leave-one-family-out variant (blank -> UNKNOWN)."""
    m = io.load_metadata(raw_metadata(spark, sf), "UNKNOWN")
    return m.groupBy("family").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ P5 / P6 / P16

@reg("to_bool", """
SELECT event_id AS row_id,
  coalesce(lower(trim(t)) IN ('true', '1', 'yes'), false) AS b_trim,
  coalesce(lower(t) IN ('true', '1', 'yes'), false) AS b_plain
FROM (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'true' WHEN 1 THEN 'TRUE ' WHEN 2 THEN '1' WHEN 3 THEN 'yes'
                                   WHEN 4 THEN 'no' WHEN 5 THEN NULL ELSE '0' END AS t FROM events)""")
def q_to_bool(spark, sf):
    """P5: boolean spellings, with and without trimming."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    k = F.col("event_id") % 7
    t = (F.when(k == 0, "true").when(k == 1, "TRUE ").when(k == 2, "1").when(k == 3, "yes").when(k == 4, "no")
         .when(k == 5, F.lit(None).cast("string")).otherwise("0"))
    return e.select(F.col("event_id").alias("row_id"), to_bool(t, True).alias("b_trim"),
                    to_bool(t, False).alias("b_plain"))


@reg("to_num", """
SELECT event_id AS row_id, CASE WHEN isnan(TRY_CAST(t AS DOUBLE)) THEN NULL ELSE TRY_CAST(t AS DOUBLE) END AS x
FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'nan' WHEN 1 THEN '' WHEN 2 THEN 'x' || CAST(value AS VARCHAR)
                            ELSE CAST(value AS VARCHAR) END AS t FROM events)""")
def q_to_num(spark, sf):
    """Numeric coercion of text ('nan', blank, junk -> null)."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    k = F.col("event_id") % 5
    t = (F.when(k == 0, "nan").when(k == 1, "").when(k == 2, F.concat(F.lit("x"), F.col("value").cast("string")))
         .otherwise(F.col("value").cast("string")))
    return e.select(F.col("event_id").alias("row_id"), to_num(t).alias("x"))


@reg("keep_families", """
SELECT source AS family, count(*) AS n FROM documents WHERE lower(trim(source)) IN ('src1', 'src12', 'src5')
GROUP BY ALL""")
def q_keep_families(spark, sf):
    """Case-insensitive keep-list on the family column."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("source").alias("family"))
    return keep_families(d, ["SRC1", " src12", "Src5"]).groupBy("family").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ S11 + P10 round trip, S9, S13

def _raw_csv(spark, sf):
    from lowdata.plans.q_eval import run_raw
    r = run_raw(spark, sf)
    txt = r.select(
        *[F.col(c) for c in ("prefix", "kind", "frac", "const_train_size", "variant", "tag")],
        F.when(F.col("used_gan"), F.lit("TRUE ")).otherwise(F.lit("false")).alias("used_gan"),
        F.when(F.col("auc").isNull(), F.lit("nan")).otherwise(F.format_string("%.17g", "auc")).alias("auc"),
        F.format_string("%.17g", "f1").alias("f1"), "tp", "fp", "fn", "tn", "n_train_real",
        "test_start", "test_end", "test_window_days")
    path = scratch_path(spark, f"raw-{uuid.uuid4().hex[:8]}")
    io.append_raw(txt, path)
    return io.read_raw(spark, path)


def _sql_raw_based(body: str) -> str:
    from lowdata.plans.q_eval import SQL_RAW
    return "WITH " + SQL_RAW + " " + body


@reg("read_raw", _sql_raw_based(
    "SELECT variant, variant = 'gan' AS used_gan, count(*) AS n, CAST(sum(tp) AS BIGINT) AS tp, 0 AS seed "
    "FROM raw GROUP BY ALL"))
def q_read_raw(spark, sf):
    """S10 + S11 + P5 + P6 + P10: results appended as CSV text and read back with coercion."""
    r = _raw_csv(spark, sf)
    return r.groupBy("variant", "used_gan").agg(F.count(F.lit(1)).alias("n"), F.sum("tp").alias("tp"),
                                                F.min("seed").alias("seed"))


@reg("read_preds", """
SELECT tag AS labels_tag, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos, """ + sql_round_half_up("sum(greatest(0.0, least(1.0, score)))", 6)
     + """ AS score_sum FROM (SELECT event_id, CAST(event_type = 'error' AS INTEGER) AS y, 'all' AS tag,
  """ + sql_round_half_up("0.8 * " + sql_uniform("'sniff'", "event_id") + " + 0.2 * CAST(event_type = 'error' AS INTEGER)", 2)
     + """ AS score FROM events) GROUP BY ALL""")
def q_read_preds(spark, sf):
    """Label and score columns found by name, type and value range, scores clipped to [0, 1]."""
    from lowdata.functions.hashing import round_half_up, uniform
    e = spark.read.parquet(f"{sf}/events.parquet")
    y = (F.col("event_type") == "error").cast("int")
    p = round_half_up(F.lit(0.8) * uniform(F.lit("sniff"), F.col("event_id")) + F.lit(0.2) * y.cast("double"), 2)
    d = e.select(F.col("event_id").alias("id_long"), y.alias("labels"), p.alias("scores"), F.lit("all").alias("labels_tag"))
    s = io.read_preds(d)
    return s.groupBy("labels_tag").agg(F.count(F.lit(1)).alias("n"), F.sum("y_true_sniffed").alias("pos"),
                                       r6(F.sum("proba_sniffed")).alias("score_sum"))


def _stems(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    k = F.col("doc_id")
    variant = F.element_at(F.array(*[F.lit(v) for v in ("real", "gan", "oversample", "smote")]),
                           (k % 4 + 1).cast("int"))
    stem = F.format_string("_%s_msmw_full_w%.5f_s%d_r%d_%s_", F.col("source"), (k % 20 + 1) * 0.0005,
                           F.element_at(F.array(F.lit(42), F.lit(1337), F.lit(2025)), (k % 3 + 1).cast("int")),
                           F.lit(20000), variant)
    stem = F.when(k % 9 == 0, F.concat(F.lit("junk_"), F.col("source"))).otherwise(stem)
    return d.select(k.alias("doc_id"), stem.alias("stem"), (k % 97 / 97.0).cast("double").alias("auc"), (k % 1000).alias("n_train_total"))


def _sql_collected() -> str:
    part = lambda i: f"regexp_extract(st, '{io.FAMILY_TAG_PATTERN}', {i})"
    return f"""
WITH s AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'junk_' || source
   ELSE printf('_%s_msmw_full_w%.5f_s%d_r%d_%s_', source, (doc_id % 20 + 1) * 0.0005,
               [42, 1337, 2025][doc_id % 3 + 1], 20000, ['real', 'gan', 'oversample', 'smote'][doc_id % 4 + 1]) END AS stem
   FROM documents),
t AS (SELECT doc_id, regexp_replace(regexp_replace(stem, '^_+', ''), '_+$', '') AS st FROM s)
SELECT {part(1)} || '_msmw_full' AS prefix, {part(1)} AS family, CAST({part(2)} AS DOUBLE) AS frac, CAST({part(3)} AS INTEGER) AS seed,
       CAST({part(4)} AS INTEGER) AS const_train_size, {part(5)} AS variant, CAST(doc_id % 97 AS DOUBLE) / 97.0 AS auc,
       doc_id % 1000 AS n_train_total
FROM t WHERE regexp_matches(st, '{io.FAMILY_TAG_PATTERN}')"""


@reg("collect_runs_by_tag", _sql_collected())
def q_collect_runs_by_tag(spark, sf):
    """Run keys parsed from per-family file stems, measures carried; stems that do not match are dropped."""
    return io.collect_runs_by_tag(_stems(spark, sf), "stem")


# ------------------------------------------------------------------ S4 / S12 / S15 / S5 / S6 / S7 round trips

@reg("split_roundtrip", f"""WITH lp AS (SELECT row_id, y, coalesce(nullif(trim(family), ''), 'UNKNOWN') AS family,
   (y = 0 AND ((('0x' || substr(md5(CAST(sha AS VARCHAR)), 1, 8))::UBIGINT)::DOUBLE / 4294967295.0) < 0.2) AS neg_test
   FROM {fx.SQL_DOCUMENTS}),
lf AS (SELECT family FROM lp WHERE y = 1 AND family <> 'UNKNOWN' GROUP BY family HAVING count(*) >= 3),
m AS (SELECT lf.family AS split_id, lp.row_id FROM lp JOIN lf ON lp.family = lf.family WHERE lp.y = 1
      UNION SELECT lf.family, lp.row_id FROM lp CROSS JOIN lf WHERE lp.neg_test)
SELECT split_id, 'test' AS part, count(*) AS n FROM m GROUP BY ALL""")
def q_split_roundtrip(spark, sf):
    """S4 + S19: the LOFO membership, benign slice stored once, written by split id and read back."""
    from lowdata.operators.ranking import with_scalars
    path = scratch_path(spark, f"splits-{uuid.uuid4().hex[:8]}")
    io.write_split(sp.lofo_membership(fx.documents(spark, sf), 3, 0.2, shared=io.SHARED), path)
    n = io.read_split(spark, path).groupBy("split_id", "part").agg(F.count(F.lit(1)).alias("n"))
    common = n.where(F.col("split_id") == io.SHARED).agg(F.coalesce(F.max("n"), F.lit(0)).alias("common"))
    own = with_scalars(n.where(F.col("split_id") != io.SHARED), common)
    return own.select("split_id", "part", (F.col("n") + F.col("common")).alias("n"))


@reg("index_json", f"""SELECT 3 * count(*) AS n, count(*) AS n_distinct FROM {fx.SQL_DOCUMENTS} d WHERE y = 1""")
def q_index_json(spark, sf):
    """Index files in the three accepted shapes written from data and read back."""
    pos = positives(fx.documents(spark, sf), required=True)
    base = scratch_path(spark, f"idx-{uuid.uuid4().hex[:8]}")
    for shape in ("train_only", "indices", "train"):
        io.write_index_json(pos, f"{base}/{shape}", shape)
    return io.read_index_json(spark, base).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("n_distinct"))


@reg("run_metrics_json", _sql_raw_based(
    "SELECT tag, variant, tp, fp, fn, tn, n_train_real AS before_aug, n_train_total AS after_aug, CAST(seed AS BIGINT) AS random_state, "
    "CAST(test_window_days AS BIGINT) AS test_window_days FROM raw"))
def q_run_metrics_json(spark, sf):
    """S7 + S6: run metrics written as JSON with the nested audit and read back by file glob."""
    from lowdata.plans.q_eval import run_raw
    r = run_raw(spark, sf)
    audit = F.struct(F.col("n_train_real").alias("train_total_before_aug"),
                     F.col("n_train_total").alias("train_total_after_aug"),
                     F.struct(F.lit(400).cast("long").alias("n_estimators"), F.lit(20).cast("long").alias("max_depth"),
                              F.lit(None).cast("string").alias("class_weight"),
                              F.col("seed").cast("long").alias("random_state")).alias("rf_params"))
    out = r.select("tag", "variant", "threshold", "auc", "f1", "tp", "fp", "fn", "tn", audit.alias("audit"),
                   "test_start", "test_end")
    path = scratch_path(spark, f"runs-{uuid.uuid4().hex[:8]}")
    io.write_runs(out, path)
    back = io.read_run_metrics(spark, path + "/*.json", one_object_per_file=False)
    return back.select("tag", "variant", "tp", "fp", "fn", "tn", F.col("audit.train_total_before_aug").alias("before_aug"),
                       F.col("audit.train_total_after_aug").alias("after_aug"), F.col("audit.rf_params.random_state").alias("random_state"),
                       "test_window_days")


def _sql_scaler_roundtrip() -> str:
    from lowdata.plans.q_augment import SQL_SCALER
    return (f"WITH {SQL_SCALER} SELECT CAST(count(*) AS INTEGER) AS dim, "
            + sql_round_half_up("sum(s)", 6) + " AS scale_sum FROM sc")


@reg("scaler_roundtrip", _sql_scaler_roundtrip())
def q_scaler_roundtrip(spark, sf):
    """Scaler written as a one-row table and read back."""
    from lowdata.operators.augment import fit_scaler
    path = scratch_path(spark, f"scaler-{uuid.uuid4().hex[:8]}")
    io.write_scaler(fit_scaler(fx.embeddings(spark, sf).filter("y = 1")), path)
    s = io.read_scaler(spark, path)
    return s.select(F.size("mean").alias("dim"), r6(F.aggregate("scale", F.lit(0.0), lambda a, x: a + x)).alias("scale_sum"))


def _sql_by_family() -> str:
    body = QUERIES["collect_runs_by_tag"][1]
    return ("SELECT family, row_number() OVER (PARTITION BY family ORDER BY frac, variant, seed) AS pos, frac, variant, seed "
            "FROM (" + body + ")")


@reg("write_by_family", _sql_by_family())
def q_write_by_family(spark, sf):
    """Per-family outputs written sorted; read back with the place of every row in its family."""
    runs = io.collect_runs_by_tag(_stems(spark, sf), "stem")
    path = scratch_path(spark, f"byfam-{uuid.uuid4().hex[:8]}")
    io.write_by_family(runs, path)
    cols = ", ".join(f"{c} {t}" for c, t in runs.dtypes if c != "family")
    back = (spark.read.schema(cols + ", family string").option("header", True).csv(path)
            .select("*", F.col("_metadata.file_name").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
                    F.monotonically_increasing_id().alias("_i")))
    place = F.row_number().over(Window.partitionBy("family").orderBy("_f", "_b", "_i"))
    return back.select("family", place.cast("long").alias("pos"), "frac", "variant", "seed")


@reg("raw_pair_roundtrip", None)
def q_raw_pair_roundtrip(spark, sf):
    """S10 + S11 -> J4: two appends with different columns (the first with stale values), read back and paired."""
    from lowdata.operators import pairing as pa
    from lowdata.plans.q_results import results, round_doubles
    r = results(spark, sf)
    path = scratch_path(spark, f"raw-{uuid.uuid4().hex[:8]}")
    stale = r.select("tag", "prefix", "kind", "frac", "const_train_size", "variant", "used_gan", F.lit(0.25).alias("auc"), "seed",
                     "test_start", "test_end", "test_window_days")
    io.append_raw(stale, path)
    io.append_raw(r, path)
    return round_doubles(pa.pair(io.read_raw(spark, path)))


@reg("raw_quarantine", _sql_raw_based(f"""
, f AS (SELECT tag, {sql_md5_bucket('tag', 10)} AS b FROM raw)
SELECT CASE b WHEN 0 THEN 'fields' WHEN 1 THEN 'number frac' WHEN 2 THEN 'no tag' WHEN 3 THEN 'boolean used_gan' WHEN 4 THEN 'fields'
              WHEN 5 THEN 'number auc,number tp' ELSE 'kept' END AS fate, count(*) AS n,
       count(DISTINCT CASE WHEN b > 5 THEN tag END) AS tags FROM f GROUP BY ALL"""))
def q_raw_quarantine(spark, sf):
    """Result lines with planted faults: every line is either kept or refused with its reasons."""
    from lowdata.plans.q_eval import run_raw
    r = run_raw(spark, sf).withColumn("b", md5_bucket(F.col("tag"), 10))
    frac = F.when(F.col("b") == 1, "one%").otherwise(F.col("frac").cast("string"))
    tag = F.when(F.col("b") == 2, " ").otherwise(F.col("tag"))
    gan = F.when(F.col("b") == 3, "maybe").when(F.col("used_gan"), "TRUE ").otherwise("no")
    auc = F.when(F.col("b") == 5, "high").when(F.col("auc").isNull(), "nan").otherwise(F.col("auc").cast("string"))
    tp = F.when(F.col("b") == 5, "many").otherwise(F.col("tp").cast("string"))
    fields = F.concat_ws(",", "prefix", "kind", frac, "variant", gan, tag, auc, tp)
    line = F.when(F.col("b") == 0, F.concat(fields, F.lit(",7,8"))).when(F.col("b") == 4, F.concat_ws(",", "prefix", "kind")).otherwise(fields)
    head = "prefix,kind,frac,variant,used_gan,tag,auc,tp"
    path = scratch_path(spark, f"faulty-{uuid.uuid4().hex[:8]}")
    # one header line in front of every file
    text = r.select(line.alias("value")).withColumn("_p", F.spark_partition_id())
    first = text.select("_p").distinct().select(F.lit(head).alias("value"), "_p", F.lit(0).alias("_o"))
    (text.withColumn("_o", F.lit(1)).unionByName(first).repartition("_p").sortWithinPartitions("_p", "_o").select("value", "_p")
     .write.partitionBy("_p").text(path))
    kept, refused = io.read_raw_checked(spark, f"{path}/*")
    fates = kept.select(F.lit("kept").alias("fate"), "tag").unionByName(
        refused.select(F.array_join("reasons", ",").alias("fate"), F.lit(None).cast("string").alias("tag")))
    return fates.groupBy("fate").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("tag").alias("tags"))


@reg("run_ledger", _sql_raw_based(f"""
SELECT tag, variant, {sql_round_half_up("CASE variant WHEN 'smote' THEN auc / 2 WHEN 'gan' THEN 1 - auc ELSE auc END", 6)} AS auc,
       CAST(CASE variant WHEN 'real' THEN 0 WHEN 'oversample' THEN 3 WHEN 'smote' THEN 4 ELSE 5 END AS BIGINT) AS run_idx FROM raw"""))
def q_run_ledger(spark, sf):
    """Four appends of runs, one repeated in the same session and one from another: each run counts once, by its last
    commit, in the order of the commits; an attempt without a commit is not read."""
    from lowdata.plans.q_eval import run_raw
    raw = run_raw(spark, sf).select("tag", "variant", "auc")
    path = scratch_path(spark, f"ledger-{uuid.uuid4().hex[:8]}")
    mine, other = RunLedger(spark, path), RunLedger(spark.newSession(), path)
    part = lambda v: raw.where(F.col("variant") == v)
    mine.append(part("real"), "real")
    mine.append(part("smote"), "smote")
    mine.append(part("gan"), "gan")
    other.append(part("oversample"), "oversample")
    mine.append(part("smote").withColumn("auc", F.col("auc") / 2), "smote")
    other.append(part("gan").withColumn("auc", 1 - F.col("auc")), "gan")
    part("real").withColumn("auc", F.lit(0.0)).write.parquet(mine.attempt_path("lost"))
    return mine.read(raw.schema).select("tag", "variant", round_half_up(F.col("auc"), 6).alias("auc"), "run_idx")


@reg("required_columns", """
SELECT 'events' AS source, '' AS missing, count(*) AS n FROM events UNION ALL SELECT 'documents', 'event_type,ts', count(*) FROM documents""")
def q_required_columns(spark, sf):
    """Which required columns a table lacks, beside its rows."""
    parts = []
    for name, at in (("events", "event_id"), ("documents", "doc_id")):
        d = spark.read.parquet(f"{sf}/{name}.parquet")
        try:
            missing = ""
            require_columns(d, [at, "event_type", "ts"])
        except ValueError as e:
            missing = ",".join(re.findall(r"'(\w+)'", str(e)))
        parts.append(d.agg(F.lit(name).alias("source"), F.lit(missing).alias("missing"), F.count(F.lit(1)).alias("n")))
    return parts[0].unionByName(parts[1])


def _sql_results_mode() -> str:
    from lowdata.plans.q_results import SQL_PAIRED, SQL_PAIRED_CV_BODY
    return (SQL_PAIRED + ", cv AS (" + SQL_PAIRED_CV_BODY + ") SELECT 'raw' AS mode, count(*) AS n FROM res UNION ALL "
            "SELECT 'paired_cv', count(*) FROM cv")


def q_results_mode(spark, sf):
    """Raw results and paired means are told apart by their columns."""
    from lowdata.operators import pairing as pa
    from lowdata.plans.q_results import results
    raw = results(spark, sf)
    tables = (raw, pa.mean_std(pa.pair(raw)))
    return tables[0].agg(F.lit(results_mode(tables[0])).alias("mode"), F.count(F.lit(1)).alias("n")).unionByName(
        tables[1].agg(F.lit(results_mode(tables[1])).alias("mode"), F.count(F.lit(1)).alias("n")))


QUERIES["results_mode"] = (q_results_mode, _sql_results_mode())


# ------------------------------------------------------------------ G1 / G6 / G8 / G9 / G10

@reg("profile_table", """
SELECT count(*) AS n_rows, 7 AS n_cols, count_if(event_type = 'error') AS n_label_1, count_if(event_type <> 'error') AS n_label_0,
       bool_or(event_id IS NULL OR ts IS NULL OR user_id IS NULL OR event_type IS NULL OR value IS NULL OR props IS NULL OR y IS NULL) AS any_null
FROM (SELECT *, CAST(event_type = 'error' AS INTEGER) AS y FROM events)""")
def q_profile_table(spark, sf):
    """G1: row / column / label counts and any-null check."""
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn(
        "y", (F.col("event_type") == "error").cast("int"))
    return rl.profile_table(e, "y")


@reg("quantiles", """
SELECT event_type, """ + ", ".join(sql_round_half_up(f"quantile_cont(value, {q})", 6) + f" AS q{int(q * 100):02d}"
                                   for q in (0.1, 0.5, 0.9)) + " FROM events GROUP BY event_type")
def q_quantiles(spark, sf):
    """Exact 10/50/90% quantiles of value per event type."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    q = rl.quantiles(e, "value", (0.1, 0.5, 0.9), ["event_type"])
    return q.select("event_type", *[r6(c).alias(c) for c in ("q10", "q50", "q90")])


@reg("time_bounds", f"""
SELECT event_type, {sql_ts_text('min(ts)')} AS ts_min, {sql_ts_text('max(ts)')} AS ts_max FROM events GROUP BY event_type""")
def q_time_bounds(spark, sf):
    """Min / max timestamps per group."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    t = rl.time_bounds(e, "ts", ["event_type"])
    return t.select("event_type", ts_text("ts_min").alias("ts_min"), ts_text("ts_max").alias("ts_max"))


@reg("class_counts", """
SELECT CASE WHEN o_orderdate IS NULL OR o_orderdate <= TIMESTAMP '1998-01-01 00:00:00' THEN 'train' ELSE 'test' END AS part,
       CAST(o_orderstatus = 'F' AS INTEGER) AS y, count(*) AS n_c FROM orders GROUP BY ALL""")
def q_class_counts(spark, sf):
    """Class counts by split part."""
    from lowdata.operators.sampling import class_counts
    o = sp.temporal_holdout(fx.orders(spark, sf), "1998-01-01 00:00:00")
    return class_counts(o, "y", ["part"])


@reg("family_sizes", f"SELECT family, count(*) AS n FROM {fx.SQL_DOCUMENTS} d WHERE y = 1 GROUP BY family")
def q_family_sizes(spark, sf):
    """Positive rows per family."""
    return rl.family_sizes(fx.documents(spark, sf), "family", "y")


# ------------------------------------------------------------------ J1 / J2 / J3 / U2 / U3 / O4

@reg("align", """
SELECT CAST(1 - l.quality AS INTEGER) AS y, d.lang, count(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL""")
def q_align(spark, sf):
    """Labels aligned with document metadata by id."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("row_id"), "lang")
    lab = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("row_id"),
                                                          (1 - F.col("quality")).cast("int").alias("y"))
    return rl.align(lab, d).groupBy("y", "lang").agg(F.count(F.lit(1)).alias("n"))


@reg("members", f"SELECT row_id FROM {fx.SQL_DOCUMENTS} d WHERE family IN {HELD!r}")
def q_members(spark, sf):
    """Rows of the held-out families (left semi join on a key table)."""
    d = fx.documents(spark, sf)
    keys = spark.createDataFrame([(f,) for f in HELD], "family string")
    return rl.members(d, keys, "family").select("row_id")


@reg("complement", f"""WITH fam AS (SELECT row_id, CASE WHEN (trim(family) IN {HELD!r} AND trim(family) <> 'Benign')
  OR (trim(family) = 'Benign' AND ((('0x' || substr(md5(CAST(sha AS VARCHAR)), 1, 8))::UBIGINT) % 100) < 20)
  THEN 'test' ELSE 'train' END AS part FROM {fx.SQL_DOCUMENTS})
SELECT d.doc_id AS row_id FROM documents d WHERE d.doc_id NOT IN (SELECT row_id FROM fam WHERE part = 'test')""")
def q_complement(spark, sf):
    """Documents outside the family test set (left anti join), labelled or not."""
    test = sp.family_holdout(fx.documents(spark, sf), list(HELD)).filter("part = 'test'")
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("row_id"))
    return rl.complement(d, test, "row_id")


@reg("common_values", f"""WITH fam AS (SELECT trim(family) AS family, CASE WHEN (trim(family) IN {HELD!r} AND trim(family) <> 'Benign')
  OR (trim(family) = 'Benign' AND ((('0x' || substr(md5(CAST(sha AS VARCHAR)), 1, 8))::UBIGINT) % 100) < 20)
  THEN 'test' ELSE 'train' END AS part FROM {fx.SQL_DOCUMENTS})
SELECT family FROM fam WHERE part = 'train' INTERSECT SELECT family FROM fam WHERE part = 'test'""")
def q_common_values(spark, sf):
    """Families present on both sides of the family split (only Benign when correct)."""
    d = sp.family_holdout(fx.documents(spark, sf), list(HELD))
    return rl.common_values(d.filter("part = 'train'"), d.filter("part = 'test'"), "family")


@reg("distinct_sorted", "SELECT DISTINCT o_orderpriority AS family FROM orders")
def q_distinct_sorted(spark, sf):
    """Sorted distinct family values."""
    return rl.distinct_sorted(fx.orders(spark, sf), "family")


# ------------------------------------------------------------------ D20 with its SQL twin

def _sql_audit() -> str:
    from lowdata.plans.q_sampling import sql_largest_remainder
    u = sql_uniform("42", "'split'", "t.row_id")
    return f"""WITH fam AS (SELECT row_id, y, sha, CASE WHEN (trim(family) IN {HELD!r} AND trim(family) <> 'Benign')
  OR (trim(family) = 'Benign' AND ((('0x' || substr(md5(CAST(sha AS VARCHAR)), 1, 8))::UBIGINT) % 100) < 20)
  THEN 'test' ELSE 'train' END AS part FROM {fx.SQL_DOCUMENTS}),
t AS (SELECT * FROM fam WHERE part = 'train'),
cc AS (SELECT y, count(*) AS n_c FROM t GROUP BY y),
q AS {sql_largest_remainder('cc', 'n - ceil(CAST(0.2 AS DOUBLE) * n)', 'q_train')},
r AS (SELECT t.row_id, t.y, row_number() OVER (PARTITION BY t.y ORDER BY {u}, t.row_id) AS rn FROM t),
val AS (SELECT r.row_id, 'val' AS part FROM r JOIN q ON r.y = q.y WHERE r.rn <= q.n_c - q.q_train),
mem AS (SELECT row_id, part FROM fam UNION ALL SELECT row_id, part FROM val),
byrow AS (SELECT row_id, max(CAST(part = 'train' AS INTEGER)) AS tr, max(CAST(part = 'val' AS INTEGER)) AS va,
                 max(CAST(part = 'test' AS INTEGER)) AS te FROM mem GROUP BY row_id),
bysha AS (SELECT f.sha, max(CAST(m.part = 'train' AS INTEGER)) AS tr, max(CAST(m.part = 'test' AS INTEGER)) AS te
          FROM mem m JOIN fam f ON m.row_id = f.row_id GROUP BY f.sha),
a AS (SELECT count_if(va = 1 AND tr = 0) AS val_not_in_train, count_if(tr = 1 AND te = 1) AS train_test_overlap,
             count_if(va = 1 AND te = 1) AS val_test_overlap FROM byrow),
s AS (SELECT count_if(tr = 1 AND te = 1) AS sha_overlap FROM bysha)
SELECT a.*, s.sha_overlap, (val_not_in_train = 0 AND train_test_overlap = 0 AND val_test_overlap = 0 AND sha_overlap = 0) AS ok
FROM a CROSS JOIN s"""


QUERIES["audit"] = (QUERIES["audit"][0], _sql_audit())


# ------------------------------------------------------------------ S8 / O1 / D21

@reg("preds_roundtrip", None)
def q_preds_roundtrip(spark, sf):
    """Run predictions appended partitioned by prefix and read back."""
    from lowdata.plans.q_eval import run_preds
    path = scratch_path(spark, f"preds-{uuid.uuid4().hex[:8]}")
    p = run_preds(spark, sf).select("prefix", "tag", "row_id", "y_true", "proba")
    io.write_preds(p, path)
    back = spark.read.parquet(path)
    return back.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("tag").alias("n_runs"))


def _preds_roundtrip_sql() -> str:
    from lowdata.plans.q_eval import SQL_RUN_PREDS
    return "WITH " + SQL_RUN_PREDS + " SELECT prefix, count(*) AS n, count(DISTINCT tag) AS n_runs FROM rp GROUP BY prefix"


QUERIES["preds_roundtrip"] = (q_preds_roundtrip, _preds_roundtrip_sql())


@reg("sort_results", """
SELECT o_orderkey AS row_id, o_orderpriority AS family, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS pos FROM orders""")
def q_sort_results(spark, sf):
    """O1: results in display order, with the place that each row came to."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("row_id"),
                                                         F.col("o_orderpriority").alias("family"))
    return with_position(rl.sort_results(o, ["family", "row_id"]))


@reg("shuffle", f"""
SELECT event_id AS row_id, row_number() OVER (ORDER BY {sql_uniform("42", "'shuffle'", "event_id")}, event_id) AS pos FROM events""")
def q_shuffle(spark, sf):
    """Seeded permutation of the rows, with the place that each row came to."""
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("row_id"))
    return with_position(sp.shuffle(e, 42))


# ------------------------------------------------------------------ P7 / S14 / S16 / U4

@reg("positives", "SELECT event_id AS row_id FROM events WHERE event_type = 'error'")
def q_positives(spark, sf):
    """The positive class; an empty one is an error."""
    return positives(fx.events(spark, sf), required=True).select("row_id")


@reg("csv_split_roundtrip", f"""
SELECT y, count(*) AS n, {sql_round_half_up('sum(features[1] + features[64])', 6)} AS checksum FROM {fx.SQL_EMBEDDINGS} e GROUP BY y""")
def q_csv_split_roundtrip(spark, sf):
    """Vectors spread over CSV columns, with the label, and read back."""
    path = scratch_path(spark, f"csv-{uuid.uuid4().hex[:8]}")
    io.write_csv_split(fx.embeddings(spark, sf), path, 64)
    back = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return back.groupBy("y").agg(F.count(F.lit(1)).alias("n"), r6(F.sum(F.col("feat_0") + F.col("feat_63"))).alias("checksum"))


@reg("table_roundtrip", None)
def q_table_roundtrip(spark, sf):
    """The paired table written under a suffix and read back."""
    from lowdata.operators import pairing as pa
    from lowdata.plans.q_results import results, round_doubles
    path = scratch_path(spark, f"paired-{uuid.uuid4().hex[:8]}")
    return spark.read.parquet(io.write_table(round_doubles(pa.pair(results(spark, sf))), path, "_baopt"))


@reg("disjoint_sides", """
SELECT part, count(*) AS n, CAST(0 AS INTEGER) AS shared FROM (
  SELECT CASE WHEN ts IS NULL OR ts <= TIMESTAMP '2024-01-10 00:00:00' THEN 'train' ELSE 'test' END AS part FROM events) GROUP BY part""")
def q_disjoint_sides(spark, sf):
    """U4: the two sides of a split share no row."""
    e = fx.events(spark, sf)
    train, test = (sp.temporal_part(e, "2024-01-10 00:00:00", s) for s in ("train", "test"))
    shared = rl.assert_disjoint(train, test)
    return sp.temporal_holdout(e, "2024-01-10 00:00:00").groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.lit(shared).alias("shared"))


# ------------------------------------------------------------------ D22 with cutoffs

BATCH_CUTOFFS = ("1996-10-01", "1996-12-01", "1997-03-01", "1997-06-01", "1997-09-01")
BATCH_FLOORS = {"cut1996_10": 5, "cut1996_12": 15, "cut1997_03": 25}


def _sql_batch_grid() -> str:
    from lowdata.plans.grid import DEFAULT_CONST_TRAIN_SIZE as const
    from lowdata.plans.grid import DEFAULT_FRACTIONS, DEFAULT_MIN_TRAIN_POS_OTHER, DEFAULT_SEEDS
    from lowdata.plans.q_eval import sql_run_tag
    floors = " ".join(f"WHEN '{k}' THEN {v}" for k, v in BATCH_FLOORS.items())
    return f"""
WITH c AS (SELECT CAST(unnest({list(BATCH_CUTOFFS)!r}) AS TIMESTAMP) AS cutoff),
b AS (SELECT cutoff, min(o_orderdate) AS t0, max(o_orderdate) AS t1 FROM c JOIN orders ON o_orderdate > cutoff GROUP BY cutoff),
w AS (SELECT 'cut' || strftime(cutoff, '%Y_%m') AS prefix, CAST(k AS INTEGER) AS window_id, t0 + to_days(CAST(k * 30 AS INTEGER)) AS wstart, t1
      FROM b, (SELECT unnest(generate_series(0, 5)) AS k)),
g AS (SELECT prefix, window_id, wstart, s.seed, f.frac, v.variant, CASE WHEN v.variant <> 'real' THEN {const} END AS const_train_size
      FROM w, (SELECT unnest({list(DEFAULT_SEEDS)!r}) AS seed) s, (SELECT CAST(unnest({[repr(f) for f in DEFAULT_FRACTIONS]!r}) AS DOUBLE) AS frac) f,
           (SELECT unnest(['real', 'gan', 'oversample', 'smote']) AS variant) v WHERE wstart < t1)
SELECT prefix, window_id, {sql_ts_text('wstart')} AS wstart, {sql_ts_text('wstart + to_days(60)')} AS wend, seed, frac, variant, const_train_size,
       CASE prefix {floors} ELSE {DEFAULT_MIN_TRAIN_POS_OTHER} END AS min_pos,
       {sql_run_tag('prefix', 'window_id', 'seed', 'variant', 'frac', 'const_train_size')} AS tag FROM g"""


@reg("batch_grid", _sql_batch_grid())
def q_batch_grid(spark, sf):
    """D22 over cutoffs: 5 cutoffs x 6 windows x 3 seeds x 20 fractions x 4 variants, with each cutoff's floor of positives."""
    from lowdata.plans.grid import DEFAULT_FRACTIONS, batch_grid
    g = batch_grid(fx.orders(spark, sf), BATCH_CUTOFFS, fracs=DEFAULT_FRACTIONS, floors=BATCH_FLOORS)
    return g.select("prefix", "window_id", ts_text("wstart").alias("wstart"), ts_text("wend").alias("wend"), "seed", "frac", "variant",
                    "const_train_size", "min_pos", "tag")
