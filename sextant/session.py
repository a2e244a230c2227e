"""Session helpers: building a local session, cutting lineage, sizes of tables."""

from __future__ import annotations

import atexit
import importlib.util
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "sextant", cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench. On a cluster the session comes from outside."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the one named in ``spark.checkpoint.dir``.

    Only where that setting is absent (a local session, a test) a temporary folder is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sextant-checkpoint-")
        # a local session's own folder goes with its process; a shared one belongs to the cluster
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and return it without its lineage.

    The files are on shared storage, so they outlive the executors that wrote them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` as compressed Parquet into the checkpoint folder and return it as read from there.

    As ``cut``, but by columns: smaller on disk, and later reads take only the columns they need. For tables that are read several times.
    """
    path = os.path.join(ensure_checkpoint_dir(df.sparkSession), f"kept-{uuid.uuid4()}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a data folder, a file or a folder of files."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, key: str, bytes_per_core: int = 4 << 20) -> DataFrame:
    """``df`` over all cores, where its input is so small that the scan would be one or a few tasks.

    For work that is heavy per row. It looks at the optimizer's estimate of the size only; larger inputs are left as they are scanned.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(n, key) if size < n * bytes_per_core else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make sure that the Python workers can import this package: where they can't find it, it is sent to them as a zip file. Once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    found = sc.parallelize([package.name], 1).map(importlib.util.find_spec).map(bool).collect()
    if not all(found):
        path = os.path.join(tempfile.mkdtemp(prefix="sextant-"), "sextant.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(path)
    _shipped.add(sc.applicationId)
