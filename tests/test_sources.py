"""Extraction, ignore rules, request log, commits."""

import json
import subprocess

import pytest

from sextant.sources import extract, files, git, requests
from sextant.streaming import flows

PYTHON = 'import os\nfrom a.b import c\n\nclass K(Base):\n    """Doc."""\n    def m(self, x):\n        return foo(x) + len(x)\n\ndef _p():\n    def q():\n        zed()\n    return q\n\ndef test_x(): run_it()\n'


def test_python():
    f = extract.extract_file("p/m.py", "python", PYTHON)
    s = {x["fqn"]: x for x in f.symbols}
    assert set(s) == {f"p/m.py::{n}" for n in ("K", "K.m", "_p", "_p.q", "test_x")}
    assert s["p/m.py::K"]["docstring"] == "Doc." and s["p/m.py::K.m"]["kind"] == "method"
    assert not s["p/m.py::_p"]["is_exported"] and s["p/m.py::test_x"]["is_test"]
    e = {(x["source_fqn"].split("::")[1], x["target"], x["type"]) for x in f.edges}
    assert {("__module__", "os", "IMPORTS"), ("__module__", "a.b.c", "IMPORTS"), ("K.m", "foo", "CALLS"), ("K", "p/m.py::K.m", "CONTAINS")} <= e
    assert ("_p", "zed", "CALLS") not in e and not any(t == "len" for _, t, _ in e)


@pytest.mark.parametrize(
    ("lang", "text", "kinds", "edges"),
    [
        ("typescript", "import {a} from './m';\n/** Adds. */\nexport function add(x: number) { return helper(x); }\nexport class C {\n  run() { this.walk(); }\n}\ninterface I { a: string }\n", {"add": "function", "C": "class", "C.run": "method", "I": "interface"}, {("add", "helper"), ("C.run", "walk"), ("__module__", "./m")}),
        ("go", "package x\n// Do it.\nfunc Do(a int) error { return run(a) }\nfunc (s *Srv) hid() { s.Call() }\ntype S struct { a int }\n", {"Do": "function", "(Srv).hid": "method", "S": "struct"}, {("Do", "run"), ("(Srv).hid", "Call")}),
        ("rust", "use std::io;\npub fn mk() -> bool { other() }\nstruct P;\nimpl P { fn area(&self) -> i32 { calc(self.x) } }\n", {"mk": "function", "P": "struct", "P.area": "method"}, {("mk", "other"), ("P.area", "calc"), ("__module__", "std::io")}),
        ("java", "import a.b.C;\npublic class Foo { public int bar(String s) { return baz(s); } }\n", {"Foo": "class", "Foo.bar": "method"}, {("Foo.bar", "baz"), ("__module__", "a.b.C")}),
        ("cpp", "class A { public: int get(int x) { return calc(x); } };\nint A::put() { return go_on(1); }\n", {"A": "class", "A::get": "method", "A::put": "method"}, {("A::get", "calc"), ("A::put", "go_on")}),
        ("swift", "class V { var t: Int { return 1 }\n func walk(a: Int) -> Bool { return run(a) }\n init(x: Int) { }\n}\nenum E { case one\n case two(Int) }\n", {"V": "class", "V.t": "property", "V.walk": "method", "V.init": "method", "E.one": "enum_case", "E.two": "enum_case"}, {("V.walk", "run")}),
        ("lua", "-- adds\nfunction M.add(a)\n  if a then return walk(a) end\nend\n", {"M.add": "function"}, {("M.add", "walk")}),
        ("bash", "foo() {\n  x\n}\n", {"foo": "function"}, set()),
        ("r", "add <- function(x) {\n  walk(x)\n}\n", {"add": "function"}, {("add", "walk")}),
    ],
)
def test_other_languages(lang, text, kinds, edges):
    f = extract.extract_file("p/m", lang, text)
    got = {s["fqn"].split("::", 1)[1]: s["kind"] for s in reversed(f.symbols)}
    assert kinds.items() <= got.items()
    assert edges <= {(e["source_fqn"].split("::", 1)[1], e["target"]) for e in f.edges}


@pytest.mark.parametrize("lang,text", [("java", "class A {{\n  public int run({}) {{\n    return 1;\n  }}\n}}\n"), ("go", "package a\n\nfunc Run({}) int {{\n\treturn 1\n}}\n"), ("typescript", "export function run({}): number {{\n  return 1;\n}}\n")])
def test_long_signatures_are_whole(lang, text):
    parameters = ", ".join(f"parameter_{i} int" if lang == "go" else f"parameter_{i}: int" if lang == "typescript" else f"int parameter_{i}" for i in range(60))
    found = extract.extract_file("a", lang, text.format(parameters))
    run = next(x for x in found.symbols if x["name"].lower() == "run")
    assert parameters in run["signature"] and len(run["signature"]) > 900


def test_markdown():
    f = extract.extract_file("a.md", "markdown", "# Top One\n```{r setup}\n# no\n```\n## Sub!\n")
    assert [(s["kind"], s["fqn"]) for s in f.symbols] == [("heading1", "a.md::Top_One"), ("chunk", "a.md::r_setup"), ("heading2", "a.md::Sub")]


def test_extract_rows(spark):
    df = spark.createDataFrame([("a.py", "python", PYTHON, 1), ("b.py", "python", "def (", 1), ("c.zz", "cobol", "x", 1), ("d.py", "python", None, 1)], "file_path string, lang string, content string, name int")
    rows = {r.file_path: r for r in extract.extract_symbols(df).collect()}
    assert len(rows["a.py"].symbols) == 5 and rows["a.py"].error is None
    assert rows["b.py"].error and rows["c.zz"].error and rows["d.py"].symbols == []
    assert extract.symbol_rows(extract.extract_symbols(df)).select("id").distinct().count() == 5


IGNORE = [("*.log", "a/b.log", True), ("build/", "build/x.py", True), ("/foo", "foo/x", True), ("!keep.py", "keep.py", False), ("**/x.py", "a/x.py", True), ("docs/*.md", "docs/a.md", True), ("foo", "a/foo/b.py", True), ("foo", "a/food/b.py", False), ("*.py", "x/y.go", False)]


@pytest.mark.parametrize(("pattern", "path", "want"), IGNORE)
def test_ignore_patterns(spark, pattern, path, want):
    assert files.ignored(path, [pattern]) is want
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(files.ignored_column(df.p, [pattern])).first()[0] is want


def test_first_match_decides():
    assert not files.ignored("a.log", ["!a.log", "*.log"])
    assert files.ignored("a.log", ["*.log", "!a.log"])


def test_tree(spark, tmp_path):
    for p, t in {"a.py": "x = 1", "sub/b.go": "package b", "sub/skip.py": "y = 2", "node_modules/c.js": "", "d.txt": ""}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / p).write_text(t)
    (tmp_path / "sub/.gitignore").write_text("# no\nskip.py\n")
    (tmp_path / "loop").symlink_to(tmp_path)
    assert list(files.walk(str(tmp_path))) == [("a.py", "python"), ("sub/b.go", "go")]
    got = files.read_tree(spark, str(tmp_path))
    assert {(r.file_path, r.lang, r.content) for r in got.collect()} == {("a.py", "python", "x = 1"), ("sub/b.go", "go", "package b")}
    stored = files.read_stored_tree(spark, str(tmp_path / "sub"))
    assert {r.file_path for r in stored.collect()} == {"b.go", "skip.py"}


def test_commits(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    for i in range(2):
        (tmp_path / "x.py").write_text(str(i))
        (tmp_path / f"y{i}.py").write_text("")
        run("add", ".")
        run("commit", "-qm", f"c{i}")
    got = git.read_commits(spark, str(tmp_path)).groupBy("file_path").count().collect()
    assert {r.file_path: r["count"] for r in got} == {"x.py": 2, "y0.py": 1, "y1.py": 1}
    assert git.read_commits(spark, str(tmp_path / "nothing")).count() == 0


def test_log_and_stream(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    rows = [{"ts": f"2025-01-01T00:{m:02d}:00Z", "session": "s", "tool": "t", "elapsed_ms": m} for m in range(5)] + [{"ts": "2025-01-01T00:00:00Z", "event": "session_start"}]
    (log / "a.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n")
    d = requests.read_requests(spark, str(log))
    assert d.where("tool IS NOT NULL").count() == 5
    assert [(r.calls, r.max_ms) for r in flows.tool_statistics(d).collect()] == [(5, 4.0)]
    got = []
    q = flows.micro_batches(requests.stream_requests(spark, str(log)), lambda b, i: got.extend(r.tool for r in b.collect()), str(tmp_path / "cp"), every=None)
    q.awaitTermination(60)
    assert got.count("t") == 5


def test_stream_deduplication(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text("\n".join(json.dumps({"ts": "2025-01-01T00:00:00Z", "session": s, "fqn": f}) for s, f in [("a", "x"), ("a", "x"), ("b", "x")]))
    stream = spark.readStream.schema("ts timestamp, session string, fqn string").json(str(src))
    q = flows.first_per_session(stream).writeStream.format("memory").queryName("sent").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.session, r.fqn) for r in spark.table("sent").collect()) == [("a", "x"), ("b", "x")]


def test_config():
    assert requests.read_config("# c\n\nmodel: a:b\nnope\n x : y ") == {"model": "a:b", "x": "y"}
    assert requests.read_config(requests.write_config({"a": "1"})) == {"a": "1"}
