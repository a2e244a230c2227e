"""The snapshot store: tables as Parquet folders, changed by writing a new snapshot and then its marker."""

from __future__ import annotations

import json
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.schemas import SCHEMA_VERSION, TABLES


def upsert(existing: DataFrame, new: DataFrame, key: list[str], order: str, keep: list[str] | None = None) -> DataFrame:
    """Rows of ``existing`` replaced by rows of ``new`` with the same key, and the other new rows.

    Of several new rows with one key the last by ``order`` counts; without an order none would be the last. Columns in ``keep`` (such as repo_alias) keep the existing
    row's value. Null keys are ordinary values that equal nothing, so such rows are all kept.
    """
    cols = existing.columns
    w = Window.partitionBy(*key).orderBy(F.col(order).desc())
    new = new.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == 1).drop("__r").select(*cols)
    if keep:
        old = existing.select(*key, *[F.col(c).alias(f"__{c}") for c in keep]).dropDuplicates(key)
        new = new.join(old, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in keep else c for c in cols])
    return existing.join(new.select(*key), key, "left_anti").unionByName(new)


def insert_new(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``existing`` and those of ``new``, each key once, that it doesn't have."""
    fresh = new.dropDuplicates(key).join(existing.select(*key), key, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def delete_files(tables: dict[str, DataFrame], files: DataFrame) -> dict[str, DataFrame]:
    """The tables without the nodes of the given files (file_path) and without what depends on them: edges, vectors, links and import references."""
    f = files.select("file_path").distinct()
    out = dict(tables)
    gone = tables["nodes"].join(f, "file_path", "left_semi").select(F.col("id").alias("gone")).distinct()
    out["nodes"] = tables["nodes"].join(f, "file_path", "left_anti")
    for name, cols in (("edges", ("source_id", "target_id")), ("node_embeddings", ("node_id",)), ("node_embeddings_dense", ("node_id",)), ("observation_node_links", ("node_id",))):
        if name in out:
            for c in cols:
                out[name] = out[name].join(gone, F.col(c) == F.col("gone"), "left_anti")
    for name, col in (("import_refs", "source_file"), ("file_cache", "file_path")):
        if name in out:
            out[name] = out[name].join(f.select(F.col("file_path").alias("__f")), F.col(col) == F.col("__f"), "left_anti")
    if "call_refs" in out:
        out["call_refs"] = out["call_refs"].join(f.select(F.col("file_path").alias("__f")), F.substring_index("source_fqn", "::", 1) == F.col("__f"), "left_anti")
    return out


def merge_external_edges(lsp: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """source_id, target_id, type, confidence: submitted edges whose both ends are nodes, at confidence 1, that ``edges`` doesn't have yet."""
    s, t = nodes.select(F.col("fqn").alias("source_fqn"), F.col("id").alias("source_id")), nodes.select(F.col("fqn").alias("target_fqn"), F.col("id").alias("target_id"))
    m = lsp.join(s, "source_fqn").join(t, "target_fqn").select("source_id", "target_id", F.col("edge_type").alias("type")).distinct()
    return m.join(edges.select("source_id", "target_id", "type"), ["source_id", "target_id", "type"], "left_anti").withColumn("confidence", F.lit(1.0))


class Store:
    """A folder of snapshots. A snapshot becomes current when its small marker, which names version and tables, has been written.

    A reader sees one snapshot throughout; a writer that fails leaves the last one current. Of two writers that commit at once one finds the number of its snapshot taken and
    takes the next, on top of the other's, so none is lost. An older layout version is reported, and recreated only on request.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _hadoop(self, *parts: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(os.path.join(self.path, *parts))
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        p, fs = self._hadoop()
        if not fs.exists(p):
            return []
        return sorted((int(s.getPath().getName()[5:-5]) for s in fs.listStatus(p) if re.fullmatch(r"meta-\d+\.json", s.getPath().getName())), reverse=True)

    def _marker(self, n: int) -> dict | None:
        """The marker of a snapshot; None while its writer hasn't ended."""
        try:
            return json.loads(self.spark.read.text(os.path.join(self.path, f"meta-{n}.json"), wholetext=True).first()[0])
        except (TypeError, ValueError):
            return None

    def _latest(self) -> tuple[int, dict] | None:
        return next(((n, m) for n in self._numbers() if (m := self._marker(n)) is not None), None)

    def current(self) -> int | None:
        now = self._latest()
        return now and now[0]

    def meta(self) -> dict:
        now = self._latest()
        return now[1] if now else {}

    def is_current_version(self) -> bool:
        return self.meta().get("schema_version") == SCHEMA_VERSION

    def read(self, name: str) -> DataFrame:
        """A table of the current snapshot; an empty one where it was never written."""
        parts = self.meta().get("tables", {}).get(name)
        if parts:
            return self.spark.read.parquet(*[os.path.join(self.path, x) for x in parts])
        return self.spark.createDataFrame([], TABLES[name])

    def _take(self, n: int, meta: dict) -> bool:
        """Write the marker of snapshot ``n`` unless there is one."""
        p, fs = self._hadoop(f"meta-{n}.json")
        if fs.exists(p):
            return False
        try:
            out = fs.create(p, False)
        except Exception as x:  # noqa: BLE001 - the file system's own exceptions come wrapped
            if "exist" in str(x).lower():
                return False
            raise
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()
        return True

    def commit(self, tables: dict[str, DataFrame], extra: dict | None = None, added: dict[str, DataFrame] | None = None) -> int:
        """Write a new snapshot: ``tables`` in place of what they were, the rows of ``added`` to what there is, all others as they are.

        Added rows are files of their own, so that adding costs what is added. The marker has the number of rows of every table.
        """
        folder = f"snapshot-{uuid.uuid4()}"
        rows = {}
        for name, df in {**tables, **{f"{k}+": v for k, v in (added or {}).items()}}.items():
            path = os.path.join(self.path, folder, name)
            df.write.parquet(path)
            # from the files' footers
            rows[name] = self.spark.read.schema(df.schema).parquet(path).count()
        while True:
            now = self._latest()
            n, before, held = (now[0] + 1, now[1].get("tables", {}), now[1].get("rows", {})) if now else (1, {}, {})
            n = max([n, *(x + 1 for x in self._numbers())])
            after = {**before, **{name: [f"{folder}/{name}"] for name in tables}}
            counts = {**held, **{name: rows[name] for name in tables}}
            for name in added or {}:
                after[name] = [*after.get(name, []), f"{folder}/{name}+"]
                counts[name] = counts.get(name, 0) + rows[f"{name}+"]
            if self._take(n, {"schema_version": SCHEMA_VERSION, "tables": after, "rows": counts, **(extra or {})}):
                return n

    def reset(self) -> None:
        """Forget all snapshots."""
        p, fs = self._hadoop()
        fs.delete(p, True)
