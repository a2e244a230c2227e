"""Results as text."""

from __future__ import annotations

from pyspark.sql import DataFrame

ROLES = {"seed": "Direct matches", "caller": "Callers", "callee": "Callees", "co_change": "Files that change together", "importer": "Files that import these"}


def capsule_text(query: str, nodes: DataFrame, budget: int, observations: DataFrame | None = None) -> str:
    """A capsule as Markdown, grouped by role. It is bounded by its budget of tokens."""
    rows = nodes.collect()
    out = [f"# Context for {query!r}", f"{len(rows)} nodes, about {sum(r.token_estimate for r in rows)} of {budget} tokens"]
    for role, title in ROLES.items():
        own = [r for r in rows if r.role == role]
        if own:
            out.append(f"\n## {title}")
        for r in own:
            out.append(f"\n### {r.kind} `{r.fqn}`\n  {r.file_path}:{r.start_line}")
            out += [f"  {label}: {text}" for label, text in (("signature", r.signature), ("doc", (r.docstring or "")[:200])) if text]
            out.append(f"  score {r.score:.3f} ({r.reason})")
    notes = observations.collect() if observations is not None else []
    if notes:
        out.append("\n## Observations")
        out += [f"- {o.content[:300]}{' [stale]' if o.stale else ''} (confidence {o.confidence:.1f}, {o.created_at})" for o in notes]
    return "\n".join(out)


#: Dependents that are shown at most; how many there are is said in any case.
MOST_SHOWN = 2000


def impact_text(root: str, rows: DataFrame, form: str = "tree", most: int = MOST_SHOWN) -> str:
    """Dependents as a tree, a list or a mermaid diagram: the first ``most`` by depth and name, and the number of all."""
    found = rows.orderBy("depth", "fqn").limit(most + 1).collect()
    if not found:
        return f"Nothing depends on `{root}`"
    if len(found) > most:
        return f"{_impact_text(root, found[:most], form)}\nThe first {most} of {rows.count()}"
    return _impact_text(root, found, form)


def _impact_text(root: str, found: list, form: str) -> str:
    if form == "list":
        return "\n".join([f"# Dependents of `{root}`"] + [f"- depth {r.depth} [{r.edge_type}] {r.kind} `{r.fqn}` ({r.file_path})" for r in found])
    if form == "mermaid":
        mangle = lambda s: s.replace("::", "__").translate(str.maketrans("./-", "___"))
        return "\n".join(["```mermaid", "graph TD"] + [f'    {mangle(r.fqn)}["{r.fqn}"] -->|{r.edge_type}| {mangle(r.target_fqn)}["{r.target_fqn}"]' for r in found] + ["```"])
    below: dict[str, list] = {}
    for r in found:
        below.setdefault(r.target_fqn, []).append(r)
    out = [f"Dependents of `{root}`"]
    stack = [(r, "") for r in reversed([r for r in found if r.depth == 1])]
    while stack:
        r, indent = stack.pop()
        out.append(f"{indent}- [{r.edge_type}] {r.kind} `{r.fqn}`")
        stack += [(c, indent + "  ") for c in reversed(below.get(r.fqn, [])) if c.depth == r.depth + 1]
    return "\n".join([*out, f"{len(found)} in all"])


def flow_text(start: str, end: str, paths: DataFrame) -> str:
    rows = paths.orderBy("path_no").collect()
    if not rows:
        return f"No path from `{start}` to `{end}`"
    out = [f"# Paths from `{start}` to `{end}`"]
    for r in rows:
        out.append(f"\n## Path {r.path_no}")
        out += ["  " * i + ("→ " if i else "") + f"`{f}`" for i, f in enumerate(r.path)]
    return "\n".join(out)


def skeleton_text(rows: DataFrame) -> str:
    out: list[str] = []
    last = None
    for r in rows.collect():
        if r.file_path != last:
            out.append(f"## {r.file_path}")
            last = r.file_path
        if r.name is None:
            out.append("  (not indexed)")
            continue
        out.append(f"  {r.kind} `{r.name}` (line {r.start_line})")
        out += [f"    {x}" for x in (r.signature, r.docstring) if x]
    return "\n".join(out)


def table_text(rows: DataFrame, limit: int = 200) -> str:
    """The first rows of a small result, one a line."""
    got = rows.limit(limit).collect()
    return "\n".join(" | ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in got) if got else "nothing found"
