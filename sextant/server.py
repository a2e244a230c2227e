"""The engine as tools: a dispatch table, a JSON-RPC loop over lines, and the request log."""

from __future__ import annotations

import datetime as dt
import json
import sys
import time
from typing import IO, Any

from sextant import render
from sextant.engine import Engine
from sextant.operators import capsule as cap
from sextant.operators.memory import auto_observation

PRESETS = {"auto": ("impact",), "explore": ("memory",), "modify": ("impact",), "debug": ("impact", "memory"), "refactor": ("impact", "memory")}


def _one(kind: str, says: str, *choice: str) -> dict:
    return {"type": kind, "description": says} | ({"enum": list(choice)} if choice else {})


def _many(says: str, *choice: str) -> dict:
    return {"type": "array", "description": says, "items": {"type": "string"} | ({"enum": list(choice)} if choice else {})}


CODE = _one("string", "A few lines of code like what is looked for; they stand for the question where meaning is compared, words are still taken from the question")
#: Description, parameters and required parameters of each tool.
SCHEMAS = {
    "run_pipeline": ("Context for a task, then what its preset adds: dependents of the best match, observations; or the given steps one after the other.", {
        "task": _one("string", "What is to be done"), "hypothetical_code": CODE, "preset": _one("string", "What is added to the context; auto by default", "auto", "explore", "modify", "debug", "refactor"),
        "max_tokens": _one("number", "Budget of tokens, 10000 by default"), "observation": _one("string", "Kept as an observation"),
        "steps": {"type": "array", "description": "Steps in place of a preset", "items": {"type": "object", "properties": {"tool": _one("string", "The step", "capsule", "impact", "flow", "skeleton", "memory_search", "save_observation"), "params": {"type": "object"}}, "required": ["tool"]}},
    }, ["task"]),
    "get_context_capsule": ("Symbols for a question with their callers, callees, importers and files that change with them, within a budget. What was sent in this session isn't sent again.", {
        "query": _one("string", "The question"), "hypothetical_code": CODE, "max_tokens": _one("number", "Budget of tokens, 8000 by default"), "pivot_depth": _one("number", "Hops in the call graph, 2 by default"),
    }, ["query"]),
    "get_impact_graph": ("Everything that depends on a symbol, directly or through others.", {
        "symbol_fqn": _one("string", "The symbol's qualified name"), "depth": _one("number", "Levels, 5 by default"), "format": _one("string", "Form of the answer; tree by default", "list", "tree", "mermaid"), "cross_repo": _one("boolean", "Follow references from other repositories"),
    }, ["symbol_fqn"]),
    "search_logic_flow": ("Paths of calls from one symbol to another.", {"start": _one("string", "Qualified name of the first symbol"), "end": _one("string", "Qualified name of the last symbol"), "max_paths": _one("number", "Paths, 3 by default")}, ["start", "end"]),
    "get_skeleton": ("Files by their symbols' signatures, without bodies.", {"files": _many("Paths"), "detail": _one("string", "How much of each symbol; standard by default", "minimal", "standard", "detailed")}, ["files"]),
    "index_status": ("Numbers of nodes, edges, files and vectors in the index.", {}, []),
    "get_session_context": ("Observations of this session, newest first.", {"include_previous": _one("boolean", "Those of earlier sessions too"), "max_results": _one("number", "At most so many, 20 by default"), "types": _many("Only these types", "tool_call", "insight", "decision", "error", "manual")}, []),
    "save_observation": ("Keep an observation, with links to the symbols it is about.", {"content": _one("string", "The observation"), "type": _one("string", "Its type; insight by default", "insight", "decision", "error"), "linked_symbols": _many("Qualified names")}, ["content"]),
    "search_memory": ("Observations of all sessions by their words.", {"query": _one("string", "The words"), "max_results": _one("number", "At most so many, 10 by default"), "include_stale": _one("boolean", "Stale ones too; true by default"), "time_range_days": _one("number", "Only of the last so many days"), "session_filter": _one("string", "Only of this session")}, ["query"]),
    "submit_lsp_edges": ("Add edges that a language server has resolved.", {"edges": {"type": "array", "description": "The edges", "items": {"type": "object", "properties": {"source_fqn": _one("string", "From"), "target_fqn": _one("string", "To"), "edge_type": _one("string", "CALLS by default"), "language": _one("string", "Language of the source")}, "required": ["source_fqn", "target_fqn"]}}}, ["edges"]),
    "resolve_symbols": ("Indexed symbols for names or parts of qualified names.", {"names": _many("The names"), "file_hint": _one("string", "Only in files with this in their path"), "kind": _one("string", "Only of this kind, such as function, class or method")}, ["names"]),
    "workspace_setup": ("Choose the source tree that is indexed.", {"workspace_root": _one("string", "Its root")}, []),
}


def tool_list() -> list[dict]:
    """All tools as ``tools/list`` gives them."""
    return [{"name": n, "description": says, "inputSchema": {"type": "object", "properties": p, "required": need}} for n, (says, p, need) in SCHEMAS.items()]


class Tools:
    """Tools by name; each takes a dict of parameters and returns text."""

    def __init__(self, engine: Engine):
        self.engine = engine
        self.by_name = {
            "run_pipeline": self.run_pipeline, "get_context_capsule": self.context_capsule, "get_impact_graph": self.impact, "search_logic_flow": self.flow,
            "get_skeleton": self.skeleton, "index_status": self.status, "get_session_context": self.session_context, "save_observation": self.save_observation,
            "search_memory": self.search_memory, "submit_lsp_edges": self.submit_edges, "resolve_symbols": self.resolve, "workspace_setup": self.workspace,
        }

    def call(self, name: str, params: dict) -> str:
        if name not in self.by_name:
            raise KeyError(name)
        return self.by_name[name](params)

    def _capsule(self, query: str, tokens: int, depth: int = 2, code: str | None = None, fresh: bool = True) -> tuple[str, list]:
        e = self.engine
        nodes = e.capsule(query, tokens, depth, code, fresh)
        ix = e.tables()
        ids = ix.nodes.join(nodes.select("fqn"), "fqn", "left_semi").select("id")
        notes = cap.linked_observations(ix.observations, ix.links, ids)
        return render.capsule_text(query, nodes, tokens, notes), nodes.collect()

    def run_pipeline(self, p: dict) -> str:
        """Context, then by preset impact of the best node and memory; or the given steps."""
        e, task, tokens = self.engine, p["task"], int(p.get("max_tokens", 10_000))
        e.reindex_if_due()
        out: list[str] = []
        if p.get("steps"):
            do = {
                "capsule": lambda s: self._capsule(task, int(s.get("max_tokens", tokens // 2)), code=p.get("hypothetical_code"), fresh=False)[0],
                "impact": lambda s: self.impact({"symbol_fqn": s.get("symbol_fqn") or task, "depth": s.get("depth", 3)}),
                "flow": lambda s: self.flow({"start": s.get("start", ""), "end": s.get("end", "")}),
                "skeleton": lambda s: self.skeleton({"files": s.get("files") or [], "detail": s.get("detail", "standard")}),
                "memory_search": lambda s: self.search_memory({"query": task, "max_results": 5}),
                "save_observation": lambda s: self.save_observation({"content": s.get("content") or task}),
            }
            out = [do[s["tool"]](s.get("params") or {}) for s in p["steps"] if s.get("tool") in do]
        else:
            text, rows = self._capsule(task, tokens // 2, code=p.get("hypothetical_code"))
            out.append(text)
            for extra in PRESETS.get(p.get("preset", "auto"), ()):
                if extra == "impact" and rows:
                    found = e.impact(rows[0].fqn, 3)
                    if not found.isEmpty():
                        out.append(render.impact_text(rows[0].fqn, found))
                elif extra == "memory":
                    found = e.search_memory(task, 5)
                    if not found.isEmpty():
                        out.append(render.table_text(found))
        if p.get("observation"):
            e.save_observation(p["observation"])
        e.save_observation(auto_observation("run_pipeline", f"task={task!r}"), "auto", source="auto")
        return "\n\n---\n\n".join(out)

    def context_capsule(self, p: dict) -> str:
        self.engine.reindex_if_due()
        return self._capsule(p["query"], int(p.get("max_tokens", 8_000)), int(p.get("pivot_depth", 2)), p.get("hypothetical_code"))[0]

    def impact(self, p: dict) -> str:
        from sextant.operators.graph import find_root

        root = find_root(self.engine.table("nodes"), p["symbol_fqn"]).first()
        name = root.fqn if root else p["symbol_fqn"]
        return render.impact_text(name, self.engine.impact(p["symbol_fqn"], int(p.get("depth", 5)), bool(p.get("cross_repo", False))), p.get("format", "tree"))

    def flow(self, p: dict) -> str:
        return render.flow_text(p["start"], p["end"], self.engine.flow(p["start"], p["end"], int(p.get("max_paths", 3))))

    def skeleton(self, p: dict) -> str:
        f = p.get("files") or []
        if isinstance(f, str):
            f = json.loads(f) if f.lstrip().startswith("[") else [f]
        return render.skeleton_text(self.engine.skeleton(f, p.get("detail", "standard")))

    def status(self, p: dict) -> str:
        return f"schema {self.engine.schema_version()}, session {self.engine.session_id}\n" + render.table_text(self.engine.status())

    def session_context(self, p: dict) -> str:
        return render.table_text(self.engine.session_context(int(p.get("max_results", 20)), bool(p.get("include_previous", False)), p.get("types")))

    def save_observation(self, p: dict) -> str:
        return f"saved {self.engine.save_observation(p['content'], p.get('type', 'insight'), p.get('linked_symbols'))}"

    def search_memory(self, p: dict) -> str:
        return render.table_text(self.engine.search_memory(p["query"], int(p.get("max_results", 10)), bool(p.get("include_stale", True)), p.get("time_range_days"), p.get("session_filter")))

    def submit_edges(self, p: dict) -> str:
        r = self.engine.submit_edges(p.get("edges", []))
        return f"{r['submitted']} submitted, {r['merged']} merged"

    def resolve(self, p: dict) -> str:
        return render.table_text(self.engine.resolve(p.get("names", []), p.get("file_hint"), p.get("kind"))) if p.get("names") else "no names given"

    def workspace(self, p: dict) -> str:
        self.engine.root = p.get("workspace_root") or self.engine.root
        return f"workspace {self.engine.root}"


class Server:
    """JSON-RPC 2.0 over lines: initialize, tools/list, tools/call, ping. Calls are appended to ``log`` as JSON lines."""

    def __init__(self, tools: Tools, log: IO[str] | None = None):
        self.tools, self.log = tools, log

    def _write(self, **entry: Any) -> None:
        if self.log is not None:
            self.log.write(json.dumps({"ts": dt.datetime.now(dt.timezone.utc).isoformat(), "session": self.tools.engine.session_id[:8]} | entry) + "\n")
            self.log.flush()

    def answer(self, line: str) -> dict | None:
        """The response to one line, None to a notification."""
        try:
            r = json.loads(line)
        except ValueError:
            return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}}
        method, key, p = r.get("method"), r.get("id"), r.get("params") or {}
        if key is None:
            return None
        ok = lambda x: {"jsonrpc": "2.0", "id": key, "result": x}
        if method == "initialize":
            return ok({"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "sextant", "version": "1"}})
        if method == "ping":
            return ok({})
        if method == "tools/list":
            return ok({"tools": tool_list()})
        if method != "tools/call" or p.get("name") not in self.tools.by_name:
            return {"jsonrpc": "2.0", "id": key, "error": {"code": -32601, "message": f"unknown method or tool: {p.get('name') or method}"}}
        began, text, error = time.monotonic(), "", None
        try:
            text = self.tools.call(p["name"], p.get("arguments") or {})
            return ok({"content": [{"type": "text", "text": text}]})
        except Exception as x:  # noqa: BLE001 - every failure of a tool becomes an error response
            error = str(x)
            return {"jsonrpc": "2.0", "id": key, "error": {"code": -32603, "message": error[:500]}}
        finally:
            self._write(tool=p["name"], args={k: str(v) for k, v in (p.get("arguments") or {}).items()}, elapsed_ms=round(1000 * (time.monotonic() - began), 1), result_chars=len(text), result_tokens_approx=len(text) // 4, preview=text[:300], error=error)

    def run(self, lines: IO[str] = sys.stdin, out: IO[str] = sys.stdout) -> None:
        self._write(event="session_start", workspace=self.tools.engine.root)
        for line in lines:
            if line.strip() and (r := self.answer(line)) is not None:
                out.write(json.dumps(r) + "\n")
                out.flush()
