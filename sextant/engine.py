"""The engine: builds and updates an index in a store, answers questions over it."""

from __future__ import annotations

import datetime as dt
import time
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators import capsule as cap
from sextant.operators import coupling, graph, lexical, memory, store, vectors
from sextant.schemas import SCHEMA_VERSION
from sextant.session import cut, ship
from sextant.sources import extract, files, git, requests


#: Up to this many paths of changed files are broadcast to the reading of the tree.
MAX_BROADCAST_FILES = 100_000


class Engine:
    """One store and one session of questions.

    ``root`` is the source tree. Tables are read anew for each snapshot; a reindex makes the next question see the new snapshot.
    """

    RECHECK_SECONDS = 30

    def __init__(self, spark: SparkSession, store_path: str, root: str | None = None, encoder=None, repo_alias: str = "primary"):
        self.spark, self.root, self.encoder, self.repo_alias = spark, root, encoder, repo_alias
        ship(spark)
        self.store = store.Store(spark, store_path)
        self.session_id = str(uuid.uuid4())
        self.sent: set[str] = set()
        self._checked = 0.0

    # building

    def index(self, tree: DataFrame | None = None, commits: DataFrame | None = None, langs: list[str] | None = None, with_coupling: bool = True) -> dict[str, int]:
        """Build or update the index: counts of new, changed, deleted and unchanged files.

        Files are compared with the last snapshot by hash; only new and changed ones are read again. Their symbols and references replace the old
        ones, those of deleted files go, and with the symbols that are gone the observations' links to them. Edges and sparse vectors are derived anew from all references and nodes, so that an update
        gives the same tables as a full build; edges submitted from outside are merged again. ``langs`` are the languages to be read, None for all.
        """
        if not self.store.is_current_version() and self.store.current() is not None:
            self.store.reset()
        if tree is None:
            # shared storage is listed and read by Spark, a local tree with its links and ignore files by the data source
            tree = files.read_stored_tree(self.spark, self.root) if "://" in self.root else files.read_tree(self.spark, self.root)
        if langs is not None:
            tree = tree.where(F.col("lang").isin(*langs))
        # only paths and hashes of the whole tree are looked at; contents are read of new and changed files
        seen = cut(tree.select("file_path", "content_hash"))
        old = self.store.read("file_cache")
        j = seen.join(old.select("file_path", F.col("content_hash").alias("was")), "file_path", "full_outer")
        state = F.when(F.col("was").isNull(), "new").when(F.col("content_hash").isNull(), "deleted").when(F.col("was") != F.col("content_hash"), "changed").otherwise("unchanged")
        diff = cut(j.select("file_path", state.alias("state")))
        counts = {"new": 0, "changed": 0, "deleted": 0, "unchanged": 0} | {r.state: r["count"] for r in diff.groupBy("state").count().collect()}
        if not counts["new"] + counts["changed"] + counts["deleted"] and self.store.current() is not None:
            return counts
        todo = tree.join(F.broadcast(diff.where(F.col("state").isin("new", "changed")).select("file_path")) if counts["new"] + counts["changed"] <= MAX_BROADCAST_FILES else diff.where(F.col("state").isin("new", "changed")).select("file_path"), "file_path", "left_semi")
        read = cut(extract.extract_symbols(todo))
        gone = diff.where(F.col("state") != "unchanged")
        kept = store.delete_files({n: self.store.read(n) for n in ("nodes", "call_refs", "file_cache")}, gone)
        fresh = extract.symbol_rows(read, self.repo_alias)
        nodes = cut(kept["nodes"].unionByName(fresh.select(*kept["nodes"].columns)))
        refs = cut(kept["call_refs"].unionByName(extract.reference_rows(read)))
        now = F.lit(dt.datetime.now(dt.timezone.utc))
        cache = kept["file_cache"].unionByName(todo.select("file_path", "content_hash", now.alias("last_indexed_at")).join(read.select("file_path", F.size("symbols").alias("node_count")), "file_path").select(*kept["file_cache"].columns))
        edges = self._edge_rows(graph.resolve_edges(refs, nodes))
        if "lsp_edges" in self.store.meta().get("tables", {}):
            edges = cut(edges)
            edges = edges.unionByName(self._edge_rows(store.merge_external_edges(self.store.read("lsp_edges"), nodes, edges)))
        vocab, sparse = vectors.tfidf_fit(nodes, vectors.embedding_text(nodes))
        tables = {"nodes": nodes, "call_refs": refs, "file_cache": cache, "edges": edges, "import_refs": graph.import_references(refs), "node_embeddings": vectors.sparse_json(sparse), "tfidf_vocab": vocab}
        fulltext = lexical.FullText.build(nodes)
        tables |= {"fts_postings": fulltext.postings, "fts_stats": fulltext.stats}
        if self.encoder is not None:
            dense = self.store.read("node_embeddings_dense").join(fresh.select(F.col("id").alias("node_id")), "node_id", "left_anti").join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
            tables["node_embeddings_dense"] = dense.unionByName(vectors.dense_build(fresh, self.encoder))
        if "observation_node_links" in self.store.meta().get("tables", {}):
            tables["observation_node_links"] = self.store.read("observation_node_links").join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi").select("observation_id", "node_id")
        if commits is None and self.root is not None and "://" not in self.root and with_coupling:
            commits = git.read_commits(self.spark, self.root)
        if commits is not None:
            commits = cut(commits)
            tables["co_change_edges"], tables["file_lineage"] = coupling.coupling(commits), coupling.lineage(commits)
        self.store.commit(tables)
        self.sent.clear()
        return counts

    @staticmethod
    def _edge_rows(edges: DataFrame) -> DataFrame:
        """Edges with an id from their ends, type and line."""
        if "call_site_line" not in edges.columns:
            edges = edges.withColumn("call_site_line", F.lit(None).cast("int"))
        e = edges.withColumn("id", F.xxhash64("source_id", "target_id", "type", F.coalesce("call_site_line", F.lit(-1))))
        return e.select("id", "source_id", "target_id", "type", "call_site_line", "confidence")

    def reindex_if_due(self) -> dict[str, int] | None:
        """``index`` unless it ran within the last RECHECK_SECONDS or there is no source tree."""
        if self.root is None or time.monotonic() - self._checked < self.RECHECK_SECONDS:
            return None
        self._checked = time.monotonic()
        return self.index()

    # reading

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def tables(self) -> cap.Index:
        """The current snapshot as an index."""
        has = self.store.meta().get("tables", {})
        ix = cap.Index(self.table("nodes"), self.table("edges"), self.table("import_refs"), self.table("co_change_edges"), self.table("file_lineage"), cross=self.table("cross_repo_edges"), observations=self.table("observations"), links=self.table("observation_node_links"))
        if "fts_postings" in has:
            ix = replace(ix, fulltext=lexical.FullText(self.table("fts_postings"), self.table("fts_stats")))
        if "node_embeddings_dense" in has and self.encoder is not None:
            d = self.table("node_embeddings_dense").select(F.col("node_id").alias("id"), "vector").where(F.size("vector") > 0)
            return replace(ix, dense=d.withColumn("length", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))), encoder=self.encoder())
        if "tfidf_vocab" in has:
            return replace(ix, vocabulary=self.table("tfidf_vocab"), sparse=vectors.sparse_from_json(self.table("node_embeddings")))
        return ix

    def search(self, query: str, limit: int = 20, kind: str | None = None, semantic_text: str | None = None) -> DataFrame:
        return cap.hybrid_search(self.tables(), query, limit, kind, semantic_text=semantic_text)

    def capsule(self, query: str, max_tokens: int = 8000, depth: int = 2, semantic_text: str | None = None, fresh_only: bool = True) -> DataFrame:
        """A context capsule; with ``fresh_only`` without what this session has already been sent. What comes out counts as sent."""
        ix = self.tables()
        anchors = [r.fqn for r in lexical.expand_query(ix.nodes, query).select("fqn").distinct().collect()]
        out = cut(cap.capsule(ix, query, max_tokens, depth, sorted(self.sent) if fresh_only else None, anchors, semantic_text))
        self.sent.update(r.fqn for r in out.select("fqn").collect())
        return out

    def impact(self, fqn: str, depth: int = 5, cross_repo: bool = False) -> DataFrame:
        ix = self.tables()
        return graph.impact(ix.nodes, ix.edges, fqn, depth, ix.cross if cross_repo else None)

    def flow(self, start: str, end: str, max_paths: int = 3) -> DataFrame:
        ix = self.tables()
        return graph.call_paths(ix.nodes, ix.edges, start, end, max_paths)

    def skeleton(self, paths: list[str], detail: str = "standard") -> DataFrame:
        """Symbols of files; files that aren't indexed but lie in the source tree are read on the spot."""
        nodes = self.table("nodes")
        if self.root is not None:
            rel = [p[len(self.root.rstrip("/")) + 1 :] if p.startswith(self.root.rstrip("/") + "/") else p for p in paths]
            known = {r.file_path for r in nodes.where(F.col("file_path").isin(rel)).select("file_path").distinct().collect()}
            extra = [p for p in rel if p not in known]
            if extra:
                tree = files.read_tree(self.spark, self.root).where(F.col("file_path").isin(extra))
                nodes = nodes.unionByName(extract.symbol_rows(extract.extract_symbols(tree), self.repo_alias).select(*nodes.columns))
        return cap.skeleton(nodes, paths, detail, self.root)

    def status(self) -> DataFrame:
        return memory.index_status(self.table("nodes"), self.table("edges"), self.table("file_cache"), self.table("node_embeddings"))

    def schema_version(self) -> str:
        return self.store.meta().get("schema_version", SCHEMA_VERSION)

    # memory

    def save_observation(self, content: str, kind: str = "insight", linked: list[str] | None = None, source: str = "agent") -> int:
        """Save an observation of this session and its links to known symbols; its id."""
        now = dt.datetime.now(dt.timezone.utc)
        new_id = uuid.uuid4().int & (2**62 - 1)
        row = self.spark.createDataFrame([(new_id, self.session_id, kind, content, now, source, 1.0, linked or [])], "id long, session_id string, type string, content string, created_at timestamp, source string, confidence double, linked array<string>")
        o, l = memory.new_observations(self.table("observations").columns, self.table("observation_node_links"), self.table("nodes"), row)
        added = {"observations": o, "observation_node_links": l}
        known = self.table("sessions")
        session = self.spark.createDataFrame([(self.session_id, now, self.root)], "session_id string, started_at timestamp, workspace string")
        if known.where(F.col("session_id") == self.session_id).isEmpty():
            added["sessions"] = session.select(*known.columns)
        self.store.commit({}, added=added)
        return new_id

    def search_memory(self, query: str, limit: int = 10, include_stale: bool = True, days: int | None = None, session: str | None = None) -> DataFrame:
        since = None if days is None else F.current_timestamp() - F.make_dt_interval(F.lit(days))
        return memory.search_memory(self.table("observations"), query, limit, include_stale, since, session)

    def session_context(self, limit: int = 20, all_sessions: bool = False, types: list[str] | None = None) -> DataFrame:
        return memory.session_context(self.table("observations"), None if all_sessions else self.session_id, types, limit)

    def submit_edges(self, edges: list[dict]) -> dict[str, int]:
        """Keep edges submitted from outside, and merge those whose ends are known into the graph."""
        rows = self.spark.createDataFrame([(e["source_fqn"], e["target_fqn"], e.get("edge_type", "CALLS")) for e in edges], "source_fqn string, target_fqn string, edge_type string")
        merged = cut(store.merge_external_edges(rows, self.table("nodes"), self.table("edges")))
        key = ["source_fqn", "target_fqn", "edge_type"]
        fresh = rows.dropDuplicates(key).join(self.table("lsp_edges"), key, "left_anti").select(*self.table("lsp_edges").columns)
        self.store.commit({}, added={"lsp_edges": fresh, "edges": self._edge_rows(merged).select(*self.table("edges").columns)})
        return {"submitted": len(edges), "merged": merged.count()}

    def resolve(self, names: list[str], file_hint: str | None = None, kind: str | None = None) -> DataFrame:
        return lexical.resolve_symbols(self.table("nodes"), names, file_hint, kind)

    def log(self, path: str, newest_only: bool = True) -> DataFrame:
        return memory.tool_calls(requests.read_requests(self.spark, path, newest_only))
