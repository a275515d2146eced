"""The streaming rolling-window counts equal the batch D11 + J7 + E1 chain."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from lowdata.operators import evaluation as ev
from lowdata.operators import splits as sp
from lowdata.streaming.rolling import rolling_confusion, run_to_table
from tests.conftest import SMALL


def test_stream_matches_batch(spark):
    e = spark.read.parquet(f"{SMALL}/events.parquet").select(
        F.col("event_id").alias("row_id"), F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_type") == "error").cast("int").alias("y_true"),
        F.round((F.col("event_id") % 97) / 97.0, 2).alias("proba"), F.lit("r").alias("tag"))
    tmp = tempfile.mkdtemp(prefix="lowdata-stream-")
    src = os.path.join(tmp, "src")
    e.write.parquet(src)
    anchor_row = e.agg(F.min("ts").alias("t0")).first()
    anchor = anchor_row.t0
    stream = spark.readStream.schema(e.schema).parquet(src)
    out = run_to_table(rolling_confusion(stream, anchor, 6, 3, watermark="0 seconds"), "roll_t",
                       os.path.join(tmp, "ckpt"))
    got = {r.window_id: (r.n_pos, r.n_neg, r.tp, r.fp) for r in out.collect()}
    win = sp.rolling_windows(e, 6, 3)
    batch = ev.confusion(sp.assign_windows(e, win, 6, 3), ["window_id"])
    exp = {r.window_id: (r.n_pos, r.n_neg, r.tp, r.fp) for r in batch.collect()}
    # the stream emits only windows closed by the watermark (all but the trailing open ones)
    assert got and all(exp[k] == v for k, v in got.items())
    assert isinstance(anchor, dt.datetime)
