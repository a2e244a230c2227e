"""The request log: JSON lines, read whole or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.schemas import REQUEST_LOG


def read_requests(spark: SparkSession, path: str, newest_only: bool = False) -> DataFrame:
    """Rows of all log files; lines that aren't JSON are dropped. ``newest_only`` keeps the file with the greatest name."""
    d = spark.read.schema(REQUEST_LOG).option("mode", "DROPMALFORMED").json(path).withColumn("file", F.input_file_name())
    if newest_only:
        d = d.where(F.col("file") == d.agg(F.max("file")).scalar())
    return d


def stream_requests(spark: SparkSession, path: str) -> DataFrame:
    """The log as a stream of rows, new files as they appear."""
    return spark.readStream.schema(REQUEST_LOG).option("mode", "DROPMALFORMED").json(path)


def read_config(text: str) -> dict[str, str]:
    """``key: value`` lines; comments, blank lines and lines without a colon are skipped, the first colon divides."""
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith("#") and ":" in line:
            k, v = line.split(":", 1)
            out[k.strip()] = v.strip()
    return out


def write_config(values: dict[str, str]) -> str:
    return "".join(f"{k}: {v}\n" for k, v in values.items())
