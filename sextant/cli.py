"""Command line: index, ask, search, capsule, serve, status, logs, benchmark, show-config, setup."""

from __future__ import annotations

import argparse
import json
import os
import sys
from typing import IO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant import render
from sextant.engine import Engine
from sextant.functions.text import recalled, savings_summary
from sextant.operators.graph import first_of
from sextant.server import Server, Tools
from sextant.session import local_session
from sextant.sources import files
from sextant.sources.requests import read_config, write_config

#: Panels of an interactive answer at most.
MOST_PANELS = 9


def read_first_files(tree: DataFrame, words: DataFrame, n: int = 3) -> DataFrame:
    """query, base: what finding words by hand costs: the lists of files that have each word (query, no, word), and the first ``n`` files found, read whole.

    Tokens are characters / 4. Files are taken in the order of the words, then of their paths; a word that is nowhere costs nothing.
    """
    hits = tree.join(F.broadcast(words), F.contains("content", "word")).select("query", "no", "file_path", F.length("content").alias("n"))
    listed = hits.groupBy("query", "no").agg(F.floor(F.sum(F.length("file_path") + 3) / 4).alias("tokens"))
    first = first_of(hits.groupBy("query", "file_path").agg(F.min("no").alias("no"), F.max("n").alias("n")), "query", n, "no", "file_path")
    cost = listed.select("query", "tokens").unionByName(first.select("query", F.floor(F.col("n") / 4).alias("tokens")))
    return cost.groupBy("query").agg(F.sum("tokens").cast("int").alias("base"))


def benchmark(engine: Engine, queries: list[tuple[str, list[str], str]], max_tokens: int = 8000) -> DataFrame:
    """query, ours, base, recalled for (query, words to look for, hint): a capsule's tokens against those of finding the words and reading whole files (``read_first_files``)."""
    rows = []
    for query, _, hint in queries:
        text = render.capsule_text(query, engine.capsule(query, max_tokens, fresh_only=False), max_tokens)
        rows.append((query, max(1, len(text) // 4), hint, text))
    d = engine.spark.createDataFrame(rows, "query string, ours int, hint string, text string")
    words = engine.spark.createDataFrame([(q, i, w) for q, ws, _ in queries for i, w in enumerate(ws)], "query string, no int, word string")
    base = read_first_files(files.read_tree(engine.spark, engine.root), words)
    out = d.join(base, "query", "left").select("query", "ours", F.greatest(F.lit(1), F.coalesce("base", F.lit(0))).alias("base"), "hint", "text")
    return out.select("query", "ours", "base", recalled(F.col("hint"), F.col("text")).alias("recalled"))


def server_config(root: str) -> dict:
    """How a client starts the server for a source tree."""
    return {"mcpServers": {"sextant": {"command": sys.executable, "args": ["-m", "sextant.cli", "--root", os.path.abspath(root), "serve"]}}}


def setup(root: str) -> list[str]:
    """Write the engine's settings and the client's configuration into a source tree, others in it left as they are; the files written."""
    own, client = os.path.join(root, ".sextant", "config"), os.path.join(root, ".mcp.json")
    os.makedirs(os.path.dirname(own), exist_ok=True)
    have = read_config(open(own).read()) if os.path.exists(own) else {}
    known = json.load(open(client)) if os.path.exists(client) else {}
    known.setdefault("mcpServers", {}).update(server_config(root)["mcpServers"])
    with open(own, "w") as f:
        f.write(write_config({"encoder": "none"} | have))
    with open(client, "w") as f:
        json.dump(known, f, indent=1)
    return [own, client]


def ask(engine: Engine, query: str, limit: int, max_tokens: int) -> str:
    """The best symbols for a question, and beside them their callers and callees."""
    found = engine.capsule(query, max_tokens, fresh_only=False)
    seeds = first_of(found.where(F.col("role") == "seed"), "role", limit, F.col("score").desc(), "fqn").select(*found.columns)
    return render.capsule_text(query, seeds.unionByName(found.where(F.col("role").isin("caller", "callee"))), max_tokens)


def ask_on(engine: Engine, lines: IO[str], out: IO[str], limit: int, max_tokens: int) -> None:
    """Questions line by line until an empty one or ``quit``; at most MOST_PANELS symbols each."""
    for line in lines:
        query = line.strip()
        if query in ("", "quit", "exit"):
            return
        out.write(ask(engine, query, min(limit, MOST_PANELS), max_tokens) + "\n")
        out.flush()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sextant")
    p.add_argument("--root", default=os.getcwd())
    p.add_argument("--store")
    sub = p.add_subparsers(dest="verb", required=True)
    i = sub.add_parser("index")
    i.add_argument("--langs", help="languages, divided by commas")
    i.add_argument("--no-coupling", action="store_true", help="without the history of commits")
    i.add_argument("--yes", "-y", action="store_true", help="build without asking")
    for verb, limit in (("ask", 5), ("search", 10), ("capsule", 20)):
        s = sub.add_parser(verb)
        s.add_argument("query", nargs="?" if verb == "ask" else None)
        s.add_argument("--limit", type=int, default=limit)
        s.add_argument("--kind")
        s.add_argument("--max-tokens", type=int, default=8000)
    b = sub.add_parser("benchmark")
    b.add_argument("questions", help="JSON lines with query, words, hint")
    b.add_argument("output", help="folder for the results as JSON")
    b.add_argument("--max-tokens", type=int, default=8000)
    for verb in ("serve", "status", "show-config", "setup"):
        sub.add_parser(verb)
    logs = sub.add_parser("logs")
    logs.add_argument("--all", action="store_true", help="all sessions, not only the newest")
    logs.add_argument("--verbose", "-v", action="store_true", help="with arguments and previews")
    return p


def main(argv: list[str] | None = None, engine: Engine | None = None) -> int:
    a = parser().parse_args(argv)
    if a.verb == "show-config":
        print(json.dumps(server_config(a.root), indent=1))
        return 0
    if a.verb == "setup":
        print("\n".join(setup(a.root)))
        return 0
    store = a.store or os.path.join(a.root, ".sextant")
    engine = engine or Engine(local_session(), store, a.root)
    if a.verb == "index":
        if engine.store.current() is None and not a.yes and sys.stdin.isatty() and input(f"index {a.root}? [y/N] ").lower() != "y":
            return 1
        print(engine.index(langs=a.langs.split(",") if a.langs else None, with_coupling=not a.no_coupling))
    elif a.verb == "search":
        print(render.table_text(engine.search(a.query, a.limit, a.kind).select("fqn", "kind", "score", "reason")))
    elif a.verb == "ask":
        if a.query is None:
            ask_on(engine, sys.stdin, sys.stdout, a.limit, a.max_tokens)
        else:
            print(ask(engine, a.query, a.limit, a.max_tokens))
    elif a.verb == "capsule":
        print(render.capsule_text(a.query, engine.capsule(a.query, a.max_tokens), a.max_tokens))
    elif a.verb == "benchmark":
        with open(a.questions) as f:
            asked = [(r["query"], r["words"], r["hint"]) for r in map(json.loads, f)]
        found = benchmark(engine, asked, a.max_tokens).cache()
        found.coalesce(1).write.mode("overwrite").json(a.output)
        print(render.table_text(savings_summary(found)))
    elif a.verb == "status":
        print(render.table_text(engine.status()))
    elif a.verb == "logs":
        calls = engine.log(os.path.join(store, "logs"), not a.all)
        print(render.table_text(calls if a.verbose else calls.drop("args", "preview", "file")))
    else:
        os.makedirs(os.path.join(store, "logs"), exist_ok=True)
        with open(os.path.join(store, "logs", f"requests_{engine.session_id[:8]}.jsonl"), "a") as log:
            Server(Tools(engine), log).run()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
