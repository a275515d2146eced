"""Run ledger: results committed once per run id.

A run's rows go to a folder of their own attempt; then one small commit file, named by
the next free number, makes them the run's result.  Creating that file fails when the number is taken, so
two sessions never share one, and the numbers - not a driver's clock - order the runs.  The latest
commit of a run id counts: a retried append replaces the first, rows of an attempt that
never got its commit are never read, and a resumed sweep asks which runs are finished.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COMMIT_SCHEMA = "seq bigint, run_id string, attempt string, n_rows bigint, facts string"


class RunLedger:
    """A folder of attempts (Parquet) and commits (one JSON file each)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._next = 0

    def _file(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _commit(self, record: dict) -> int:
        while True:
            fs, p = self._file(f"commits/{self._next:010d}.json")
            seq, self._next = self._next, self._next + 1
            if fs.exists(p):
                continue
            try:
                out = fs.create(p, False)  # refused where another session took the number first
            except Exception as e:
                if "FileAlreadyExists" not in str(e):
                    raise
                continue
            out.write((json.dumps({"seq": seq, **record}) + "\n").encode())
            out.close()
            return seq

    def attempt_path(self, attempt: str) -> str:
        return f"{self.path}/attempts/attempt={attempt}"

    def append(self, rows: DataFrame, run_id: str, facts: dict | None = None) -> int:
        """Write the rows of one run and commit them; the run's number.  Appending a run id again replaces it."""
        attempt = uuid.uuid4().hex
        rows.write.parquet(self.attempt_path(attempt))
        n = self.spark.read.schema(rows.schema).parquet(self.attempt_path(attempt)).count()
        return self.commit(run_id, attempt, n, facts)

    def commit(self, run_id: str, attempt: str, n_rows: int | None = None, facts: dict | None = None) -> int:
        """Make the files of ``attempt`` the result of ``run_id``."""
        return self._commit({"run_id": run_id, "attempt": attempt, "n_rows": n_rows, "facts": json.dumps(facts)})

    def commits(self) -> DataFrame:
        """The latest commit of every run id; an unfinished commit file is none."""
        fs, p = self._file("commits")
        if not fs.exists(p):
            return self.spark.createDataFrame([], COMMIT_SCHEMA)
        c = self.spark.read.schema(COMMIT_SCHEMA).json(f"{self.path}/commits").where("run_id is not null and attempt is not null")
        last = Window.partitionBy("run_id").orderBy(F.col("seq").desc())
        return c.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn")

    def finished(self) -> dict[str, dict]:
        """run id -> its commit (attempt, facts): what a resumed sweep skips."""
        return {r["run_id"]: {"attempt": r["attempt"], "n_rows": r["n_rows"], "facts": json.loads(r["facts"] or "null")}
                for r in self.commits().collect()}  # one small row a run

    def read(self, schema=None) -> DataFrame:
        """Rows of all committed runs with ``run_id`` and ``run_idx`` (the order of the runs)."""
        c = self.commits().select("attempt", F.col("run_id").alias("run_id"), F.col("seq").alias("run_idx"))
        src = self.spark.read.option("basePath", f"{self.path}/attempts")
        rows = (src.schema(schema) if schema is not None else src.option("mergeSchema", True)).parquet(f"{self.path}/attempts")
        return rows.join(c, "attempt").drop("attempt")
