"""Processing only new or changed records, run by run.

A run rereads the log from the oldest transaction (batch) that was still open at the last successful run. What it
rereads overlaps what was processed before; the overlap is removed by an anti-join of key and version with the
ledger of what was processed. The ledger is written only with a successful run, so a failed run neither skips nor repeats.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.functions.paths import canonical_path
from sextant.operators.skew import skew_join
from sextant.session import cut

#: The batches with the runs that read them have a row for each; up to this many they are broadcast.
MAX_BROADCAST_RUNS = 100_000


def log_versions(log: DataFrame) -> DataFrame:
    """The delivered versions: file_path (canonical), version (lower-cased hash), at, row_id, batch_id. Null hashes, paths or batches are ignored."""
    return log.where(F.col("blake3_hash").isNotNull() & F.col("file_path").isNotNull() & F.col("batch_id").isNotNull()).select(
        canonical_path(F.col("file_path")).alias("file_path"), F.lower("blake3_hash").alias("version"), F.col("last_indexed_at").alias("at"), F.col("row_id"), F.col("batch_id").cast("long").alias("batch_id"))


def reread_windows(runs: DataFrame) -> DataFrame:
    """For each successful run the batches it reads: run_id, prev_run, low, high.

    ``low`` is the oldest batch whose transaction was open when the previous successful run finished: every batch after that
    run, and earlier ones that had not finished by then (their rows may have arrived since). ``high`` is the run itself.
    A run without a finish stays open until the next run begins. Windows over the table of runs, of which there is one row each; no join.
    """
    w = Window.orderBy("run_id")
    r = runs.where(F.col("run_id").isNotNull()).select(F.col("run_id").cast("long").alias("run_id"), "started_at", "finished_at", "status").dropDuplicates(["run_id"])
    r = r.withColumn("ended_at", F.coalesce("finished_at", F.lead("started_at").over(w)))
    # of the runs that end later the smallest; without an end, later than all
    later = Window.orderBy(F.col("ended_at").desc_nulls_first(), "run_id").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("oldest_open", F.min("run_id").over(later))
    ok = r.where(F.lower("status") == "success").select("run_id", F.lag("run_id").over(w).alias("prev_run"), F.lag("oldest_open").over(w).alias("oldest_open"))
    return ok.select("run_id", "prev_run", F.coalesce(F.least(F.coalesce("oldest_open", F.col("prev_run") + 1), F.col("prev_run") + 1), F.lit(-(2**62))).alias("low"), F.col("run_id").alias("high"))


def batch_reads(batches: DataFrame, windows: DataFrame) -> DataFrame:
    """batch_id, run_id: which successful runs read each batch.

    A batch belongs to the first successful run at or after it; a run reads the batches of all runs from the one that its ``low`` belongs to.
    Runs are numbered, so both are joins on equal numbers, and what comes out has a row for each batch and run that rereads it.
    """
    runs = windows.select("run_id", "low", "high", F.row_number().over(Window.orderBy("run_id")).alias("no"))
    at = lambda d, c: d.select(F.col(c).alias("x"), F.lit(1).alias("asks"), F.lit(None).cast("int").alias("no"), F.lit(None).cast("long").alias("run_id"))
    marks = runs.select(F.col("high").alias("x"), F.lit(0).alias("asks"), "no", "run_id")
    # the next run at or after each batch and each low: runs come first among equals when read from behind
    following = Window.orderBy(F.col("x").desc(), "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owner = lambda d, c: at(d.select(c).distinct(), c).unionByName(marks).withColumn("owner", F.last("no", True).over(following)).where(F.col("asks") == 1).select(F.col("x").alias(c), "owner")
    own = owner(batches.select("batch_id"), "batch_id").where(F.col("owner").isNotNull())
    first = runs.join(owner(runs, "low").withColumnRenamed("owner", "from_no"), "low").select("run_id", "low", F.explode(F.sequence("from_no", "no")).alias("owner"))
    return own.join(first, "owner").where(F.col("batch_id") >= F.col("low")).select("batch_id", "run_id")


def replay_runs(log: DataFrame, runs: DataFrame, max_broadcast: int = MAX_BROADCAST_RUNS) -> DataFrame:
    """What every successful run has to process: run_id, file_path, version. All runs in one plan.

    A file's state at a run is the version of its row with the greatest (at, row_id) among the batches up to the run.
    A case is a run whose state of the file differs from the state last processed. Letter case of hashes and spelling of paths
    don't matter; repeated, late and unchanged rows make no case; rows with a null hash or path are ignored. Without runs or rows nothing comes out.

    The log is reduced to the winning row of each file and batch on the map side, so a file or a batch with most of
    the rows costs no task more. Later steps see at most one row per file and run. The batches with the runs that read them are broadcast if
    there are at most ``max_broadcast`` of them; beyond that they are joined in salted parts, always by equal batch.
    """
    v = log_versions(log)
    best = v.groupBy("file_path", "batch_id").agg(F.max(F.struct("at", "row_id", "version")).alias("s"))
    which = cut(batch_reads(v.select("batch_id").distinct(), reread_windows(runs)))
    reads = best.join(F.broadcast(which), "batch_id") if which.count() <= max_broadcast else skew_join(best, which, ["batch_id"])
    cand = reads.groupBy("file_path", "run_id").agg(F.max("s").alias("s"))
    w = Window.partitionBy("file_path").orderBy("run_id")
    state = cand.select("file_path", "run_id", F.max("s").over(w.rowsBetween(Window.unboundedPreceding, 0))["version"].alias("version"), F.row_number().over(w).alias("seq"))
    ledger = state.select("file_path", "version", (F.col("seq") + 1).alias("seq"))
    return state.join(ledger, ["file_path", "version", "seq"], "left_anti").select("run_id", "file_path", "version")


def changed_since(log: DataFrame, ledger: DataFrame | None, runs: DataFrame, run_id: int) -> tuple[DataFrame, DataFrame]:
    """One run: (what to process, the new ledger).

    ``ledger`` has file_path, version, at, row_id: the winning row of each file as of the last successful run, or
    is None before the first. What to process is file_path, version of files whose version isn't the one in the ledger.

    The bounds of the reread are known before the log is read, so the filter on batch_id reaches the scan: of a log in folders by batch only
    the folders from the oldest open batch on are read, of a log in files the row groups with such batches.
    """
    win = reread_windows(runs.where(F.col("run_id") <= run_id)).where(F.col("run_id") == run_id).first()
    low, high = (win["low"], win["high"]) if win else (1, 0)
    v = log_versions(log.where((F.col("batch_id") >= low) & (F.col("batch_id") <= high)))
    rows = v.select("file_path", F.struct("at", "row_id", "version").alias("s"))
    if ledger is not None:
        rows = rows.unionByName(ledger.select("file_path", F.struct("at", "row_id", "version").alias("s")))
    state = rows.groupBy("file_path").agg(F.max("s").alias("s")).select("file_path", "s.version", "s.at", "s.row_id")
    todo = state.select("file_path", "version")
    if ledger is not None:
        todo = todo.join(ledger.select("file_path", "version"), ["file_path", "version"], "left_anti")
    return todo, state


def run_by_run(log: DataFrame, runs: DataFrame, path: str) -> DataFrame:
    """run_id, file_path, version: what ``replay_runs`` gives, by one run after the other with a ledger in ``path``.

    Every successful run that the ledger doesn't have is done by ``changed_since``, its results are written, then the ledger is committed. Called again after a
    failure it goes on after the last committed run.
    """
    spark, ledger = log.sparkSession, Ledger(log.sparkSession, path)
    ok = [r.run_id for r in runs.where(F.lower("status") == "success").select(F.col("run_id").cast("long").alias("run_id")).distinct().orderBy("run_id").collect()]
    last = ledger.last_run()
    for run in ok:
        if last is None or run > last:
            todo, state = changed_since(log, ledger.read(), runs, run)
            todo.write.mode("overwrite").parquet(os.path.join(path, "results", f"run_id={run}"))
            ledger.commit(state, run)
    if not ok:
        return spark.createDataFrame([], "run_id long, file_path string, version string")
    return spark.read.schema("run_id long, file_path string, version string").parquet(os.path.join(path, "results")).select("run_id", "file_path", "version")


class Ledger:
    """The ledger on disk: one folder per successful run, made visible by a small marker file written last.

    A run that fails before ``commit`` returns leaves the previous ledger in force; its folder is overwritten by the next try.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def last_run(self) -> int | None:
        """The last run whose marker is there."""
        jvm, fs = self._fs()
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        if not fs.exists(p):
            return None
        done = [int(s.getPath().getName()[5:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("done-")]
        return max(done, default=None)

    def read(self) -> DataFrame | None:
        """The ledger as of the last committed run, or None."""
        last = self.last_run()
        return None if last is None else self.spark.read.parquet(os.path.join(self.path, f"run-{last}"))

    def commit(self, state: DataFrame, run_id: int) -> None:
        """Write the state of a run, then its marker."""
        state.write.mode("overwrite").parquet(os.path.join(self.path, f"run-{run_id}"))
        jvm, fs = self._fs()
        out = fs.create(jvm.org.apache.hadoop.fs.Path(os.path.join(self.path, f"done-{run_id}")), True)
        out.write(bytearray(json.dumps({"run_id": run_id}).encode()))
        out.close()
