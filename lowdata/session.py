"""SparkSession defaults for the engine.

Everything here is plain Spark configuration: UTC session time zone (all
timestamps in the data model are UTC), ANSI mode (bad casts must go through
``try_*`` functions), adaptive query execution with skew-join splitting, and
the UI switched off.  The checkpoint folder is read from the session
(``spark.checkpoint.dir``); only when it is unset (tests, local runs) a fresh
scratch folder is taken.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "lowdata",
              shuffle_partitions: int | None = None,
              conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine defaults."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULT_CONF, **(conf or {})}.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and master.startswith("local"):
        b = b.config("spark.driver.memory", "16g")
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the operators rely on to an existing session,
    and ship this package to the executors' Python workers."""
    for k in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.execution.arrow.maxBytesPerBatch"):
        spark.conf.set(k, DEFAULT_CONF[k])
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Zip the ``lowdata`` package once per application and ``addPyFile`` it.

    Batch functions run by ``mapInPandas`` (kNN, generators) are pickled by
    module reference; executors import them from this archive, so nothing has
    to be installed on the cluster nodes.  The archive goes to the shared
    checkpoint folder when that is a local/mounted path, else to a driver-side
    file that Spark's file server distributes.
    """
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    base = ensure_checkpoint_dir(spark)
    local = base.startswith("file:") or "://" not in base
    folder = base.replace("file:", "", 1) if local else tempfile.mkdtemp(prefix="lowdata-pyfiles-")
    folder = os.path.join(folder, "pyfiles") if local else folder
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"lowdata-{app}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(path)
    _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; set a scratch one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="lowdata-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def materialize(df: DataFrame) -> DataFrame:
    """Compute a reduced table once: written under the shared checkpoint folder and read back.

    Used where one aggregate feeds several branches of a plan (e.g. a score
    histogram that feeds both a per-bin window and per-run offsets): Spark
    would otherwise recompute the whole upstream pipeline once per branch.  A lost
    executor loses nothing of it, no storage memory is held, Spark knows its size,
    and the files go when the application ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"reduced-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    path = os.path.join(ensure_checkpoint_dir(spark), "tables", name)
    delete_on_exit(spark, path)
    return path
