"""The engine end to end: build, update, search, capsule, tools, server."""

import io
import json

import pytest

from sextant.engine import Engine
from sextant.operators.vectors import HashingEncoder
from sextant.server import Server, Tools

FILES = {
    "math_ops.py": 'import os\n\n\ndef add_numbers(a, b):\n    """Add two numbers."""\n    return checked(a) + b\n\n\ndef checked(a):\n    """Check a number."""\n    return a\n\n\nclass Calculator:\n    """Calculates."""\n\n    def total(self, xs):\n        return add_numbers(1, 2)\n',
    "utils.py": "from math_ops import add_numbers\n\n\ndef helper(x):\n    return add_numbers(x, 1)\n\n\ndef _hidden():\n    return helper(2)\n",
    "tests/test_math.py": "from math_ops import add_numbers\n\n\ndef test_add():\n    assert add_numbers(1, 2) == 3\n",
}


def snapshot(e):
    rows = {}
    for t in ("nodes", "edges", "import_refs", "node_embeddings"):
        d = e.table(t)
        rows[t] = sorted(repr(sorted(r.asDict().items())) for r in d.collect())
    return rows


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for p, t in FILES.items():
        (root / p).parent.mkdir(exist_ok=True)
        (root / p).write_text(t)
    return root


@pytest.fixture(scope="module")
def engine(spark, project, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store") / "s"), str(project))
    assert e.index() == {"new": 3, "changed": 0, "deleted": 0, "unchanged": 0}
    return e


def test_search_and_capsule(engine):
    top = engine.search("add numbers", 5).collect()
    assert top[0].fqn == "math_ops.py::add_numbers" and top[0].score_breakdown.bm25 == 1.0
    rows = engine.capsule("add_numbers", 400).collect()
    assert sum(r.token_estimate for r in rows) <= 400 and any(r.fqn == "utils.py::helper" for r in rows)
    assert not {r.fqn for r in rows if r.role == "seed"} & {r.fqn for r in engine.capsule("add_numbers", 400).collect() if r.role == "seed"}


def test_graph_questions(engine):
    assert {r.fqn for r in engine.impact("math_ops.py::add_numbers").collect()} >= {"utils.py::helper", "math_ops.py::Calculator.total", "tests/test_math.py::test_add"}
    assert engine.flow("utils.py::helper", "math_ops.py::checked").first().path == ["utils.py::helper", "math_ops.py::add_numbers", "math_ops.py::checked"]
    s = engine.skeleton(["utils.py", "gone.py"], "minimal").collect()
    assert [(r.file_path, r.name) for r in s] == [("gone.py", None), ("utils.py", "helper")]


def test_memory(engine):
    engine.save_observation("the cursor leaks", linked=["utils.py::helper", "no::such"])
    engine.save_observation("another thing", kind="note")
    assert engine.table("observation_node_links").count() == 1
    assert [r.content for r in engine.search_memory("cursor").collect()] == ["the cursor leaks"]
    assert [r.content for r in engine.session_context(types=["note"]).collect()] == ["another thing"]
    assert engine.submit_edges([{"source_fqn": "utils.py::_hidden", "target_fqn": "math_ops.py::checked"}, {"source_fqn": "x", "target_fqn": "y"}]) == {"submitted": 2, "merged": 1}


def test_server(engine):
    log = io.StringIO()
    s = Server(Tools(engine), log)
    ask = lambda **x: s.answer(json.dumps({"jsonrpc": "2.0", "id": 1} | x))
    assert len(ask(method="tools/list")["result"]["tools"]) == 12
    call = lambda name, **a: ask(method="tools/call", params={"name": name, "arguments": a})
    assert "helper" in call("get_impact_graph", symbol_fqn="math_ops.py::add_numbers")["result"]["content"][0]["text"]
    assert "Path 1" in call("search_logic_flow", start="utils.py::helper", end="math_ops.py::checked")["result"]["content"][0]["text"]
    assert "helper" in call("get_skeleton", files='["utils.py"]')["result"]["content"][0]["text"]
    assert "nodes" in call("index_status")["result"]["content"][0]["text"]
    assert "Context for" in call("run_pipeline", task="add numbers", preset="refactor")["result"]["content"][0]["text"]
    assert "exact=True" in call("resolve_symbols", names=["helper"])["result"]["content"][0]["text"]
    assert s.answer("{")["error"]["code"] == -32700
    assert call("nothing")["error"]["code"] == -32601
    assert call("get_skeleton", files=["a"], detail="odd")["error"]["code"] == -32603
    assert ask(method="ping")["result"] == {} and s.answer('{"method": "x"}') is None
    assert json.loads(log.getvalue().splitlines()[0])["tool"] == "get_impact_graph"


def test_benchmark(engine):
    from sextant.cli import benchmark
    from sextant.functions.text import savings_summary

    rows = benchmark(engine, [("add numbers", ["add_numbers"], "math_ops.py"), ("helper", ["helper"], "no such place")], 300)
    assert [r.recalled for r in rows.orderBy("query").collect()] == [True, False]
    assert savings_summary(rows).first().n == 2


def test_command_line(engine, project, capsys, tmp_path):
    from sextant import cli

    base = ["--root", str(project)]
    for words, want in ((["search", "add numbers"], "add_numbers"), (["ask", "add numbers", "--limit", "1"], "Direct matches"), (["status"], "nodes"), (["show-config"], "mcpServers")):
        assert cli.main(base + words, engine) == 0 and want in capsys.readouterr().out
    out = io.StringIO()
    cli.ask_on(engine, io.StringIO("helper\nquit\nnever"), out, 50, 4000)
    assert out.getvalue().count("# Context for") == 1
    (tmp_path / ".mcp.json").write_text('{"mcpServers": {"other": {}}, "x": 1}')
    cli.setup(str(tmp_path))
    cli.setup(str(tmp_path))
    assert set(json.loads((tmp_path / ".mcp.json").read_text())["mcpServers"]) == {"other", "sextant"}
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "requests_a.jsonl").write_text('{"tool": "index_status", "preview": "seen", "session": "a"}\n')
    for words, shown in ((["logs"], False), (["logs", "-v"], True)):
        assert cli.main([*base, "--store", str(tmp_path), *words], engine) == 0
        assert ("preview=seen" in capsys.readouterr().out) is shown


def test_languages_and_coupling_can_be_left_out(spark, project, tmp_path):
    e = Engine(spark, str(tmp_path / "s"), str(project))
    assert e.index(langs=["go"], with_coupling=False)["new"] == 0
    assert e.index(langs=["python"], with_coupling=False)["new"] == 3 and "file_lineage" not in e.store.meta()["tables"]


def test_what_was_submitted_and_linked_outlives_updates(spark, project, tmp_path):
    e = Engine(spark, str(tmp_path / "s"), str(project))
    e.index()
    e.submit_edges([{"source_fqn": "utils.py::_hidden", "target_fqn": "math_ops.py::checked"}])
    e.save_observation("kept", linked=["math_ops.py::checked", "tests/test_math.py::test_add"])
    n = e.table("edges").count()
    gone = (project / "tests/test_math.py").read_text()
    try:
        (project / "new_one.py").write_text("def newest():\n    return 1\n")
        (project / "tests/test_math.py").unlink()
        e.index()
        ids = {r.fqn: r.id for r in e.table("nodes").collect()}
        assert (ids["utils.py::_hidden"], ids["math_ops.py::checked"]) in {(r.source_id, r.target_id) for r in e.table("edges").collect()}
        assert [r.node_id for r in e.table("observation_node_links").collect()] == [ids["math_ops.py::checked"]]
        assert e.table("edges").count() < n + 1
    finally:
        (project / "new_one.py").unlink()
        (project / "tests/test_math.py").write_text(gone)


def test_a_tree_on_shared_storage(spark, project, tmp_path):
    e = Engine(spark, str(tmp_path / "s"), f"file://{project}")
    assert e.index()["new"] == 3
    assert {r.file_path for r in e.table("nodes").collect()} == set(FILES)


def test_many_dependents_are_not_all_shown(spark):
    from sextant import render

    rows = spark.createDataFrame([(f"a.py::f{i:02d}", "a.py", "function", 1, "CALLS", "a.py::r") for i in range(30)], "fqn string, file_path string, kind string, depth int, edge_type string, target_fqn string")
    text = render.impact_text("a.py::r", rows, "list", 10)
    assert text.count("- depth") == 10 and text.endswith("The first 10 of 30")
    assert render.impact_text("a.py::r", rows, "list", 30).count("- depth") == 30


def test_two_writers_lose_nothing(spark, tmp_path):
    from sextant.operators.store import Store

    a, b = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    row = lambda n: spark.createDataFrame([(f"s{n}", None, "w")], "session_id string, started_at timestamp, workspace string")
    a.commit({"sessions": row(0)})
    before, take = a._latest(), a._take
    # b commits after a has read what is current
    a._latest = lambda: before if not b.done else Store._latest(a)
    b.done = False
    a._take = lambda n, meta: (b.commit({}, added={"sessions": row(2)}), setattr(b, "done", True), False)[2] if not b.done else take(n, meta)
    a.commit({}, added={"sessions": row(1)})
    assert sorted(r.session_id for r in Store(spark, a.path).read("sessions").collect()) == ["s0", "s1", "s2"]
    assert not a._take(1, {})


def test_tool_schemas(engine):
    from sextant.server import SCHEMAS

    assert set(SCHEMAS) == set(Tools(engine).by_name)
    for says, parameters, required in SCHEMAS.values():
        assert says and set(required) <= set(parameters) and all(p["description"] and p["type"] for p in parameters.values())


def test_encoders():
    from sextant.operators import vectors

    assert vectors.encoder_available("hashing-64") and not vectors.encoder_available("none")
    vectors.register_encoder("broken", lambda: 1 / 0, 3)
    assert not vectors.encoder_available("broken")


def test_update_equals_full_build(spark, project, tmp_path):
    e = Engine(spark, str(tmp_path / "a"), str(project), encoder=HashingEncoder)
    e.index()
    assert e.index()["unchanged"] == 3 and e.store.current() == 1
    before = {p: (project / p).read_text() for p in FILES}
    try:
        (project / "utils.py").write_text(FILES["utils.py"] + "\n\ndef added():\n    return checked(1)\n")
        (project / "tests/test_math.py").unlink()
        (project / "more.py").write_text("def more():\n    return helper(1)\n")
        assert e.index() == {"new": 1, "changed": 1, "deleted": 1, "unchanged": 1}
        full = Engine(spark, str(tmp_path / "b"), str(project), encoder=HashingEncoder)
        full.index()
        assert snapshot(e) == snapshot(full)
        assert e.table("node_embeddings_dense").count() == full.table("node_embeddings_dense").count() == e.table("nodes").count()
        assert e.search("checked", 3).count() > 0
    finally:
        (project / "more.py").unlink()
        for p, t in before.items():
            (project / p).write_text(t)
