"""Queries of operators whose input is a source tree, a store or a session: a small workspace, and what must come out of it, written by hand as SQL values."""

from __future__ import annotations

import contextlib
import io
import json
import os
import subprocess
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import functions as F

from sextant import cli, render
from sextant.engine import Engine
from sextant.operators import store, vectors
from sextant.plans.registry import Registry
from sextant.plans.retrieval import TFIDF
from sextant.server import SCHEMAS, Server, Tools
from sextant.session import cut, ensure_checkpoint_dir, table
from sextant.sources import extract, files, git, requests
from sextant.streaming import flows

q = Registry()
QUERIES, ORACLE = q.queries, q.sql

PYTHON = '''import os
from a.b import c
from . import near


class K(Base):
    """Doc of K."""

    def m(self, x):
        import late
        return foo(x) + len(x)


def _p():
    # not documentation
    def q():
        zed()
    return wait_for(lambda: hidden())


def test_x() -> int:
    """Runs it."""
    run_it()
'''
TYPESCRIPT = """import {
  a,
  b,
} from './m';
import './side';
import * as z from "z";
/** Adds. */
export const add = (x: number, y = f(1)): number => helper(`t ${inner(x)} fake(1) {`);
export class C { constructor(x) { this.init(x); } run(): void { list.each((v) => nested(v)); go(); } }
interface I { a: string }
type ID = string | number
enum Color { Red }
export default function main() { return boot("not(a call)"); }
"""
GO = """package x

import (
\t"fmt"
\tm "net/http"
)

type (
\tA struct {
\t\tb int
\t}
\tB interface{ Do() }
\tC = A
\tD map[string]int
)

type E int

// Run does
// one step.
func (s *Srv) Run(a int) error {
\tgo func() { inner() }()
\treturn s.step(a)
}
func TestX(t *T) { call(`raw " text`) }
"""
RUST = """use a::{B, C};
use std::io;
/// The longer one.
pub fn longest<'a>(x: &'a str, y: &'a str) -> &'a str { pick(x, y) }
impl<'a, 'b> Holder<'a, 'b> {
    fn get(&'a self) -> char { self.inner.fetch('x'); items.iter().map(|v| hidden(v)).collect::<Vec<_>>() }
}
struct P;
fn _p() { check!(1); }
"""
JAVA = """import a.b.C;
import static x.Y.z;
/** Holds. */
public class Foo extends Bar { private int n = make(1); public Foo(int a) { init(a); } int bar(String s) throws E { return baz(s); } }
interface Q { void run(int a); String _name(); }
"""
CPP = """// A thing.
class A { public: int get(int x) const { return calc(x); } ~A() { drop_it(); } };
int A::put() { auto f = [&](int v) { return hid(v); }; return go_on(1); }
static int h(char c) { if (c == '{') return run_it(c); return 0; }
"""
SWIFT = """import Foundation
class VTest: Base {
  var t: Int { return compute() }
  func walk(a: Int) -> Bool { return run(a) }
  init(x: Int) { setUp(x) }
  subscript(i: Int) -> Int { return at(i) }
}
indirect enum E { case one, two(Int), three
 case four = "x" }
"""
SHELL = """#!/bin/bash
# Does it.
foo() {
  local x=$(compute "a b")
  if check_it; then run_it arg | filter_it; fi
  echo ${#x}
}
function bar { foo && baz; }
"""
LUA = """-- Adds.
function M.add(a)
  if a then return walk(a) end
end
local sub = function(b) return run(b) end
"""
R = """# Adds.
add <- function(x) {
  walk(x)
}
.hid = function() other()
"""
MARKDOWN = """# Top One
text
```{r setup}
# no heading
```
## Sub: part 2!
"""
SOURCES = {
    "src/app.py": ("python", PYTHON), "web/main.ts": ("typescript", TYPESCRIPT), "go/srv.go": ("go", GO), "rs/lib.rs": ("rust", RUST), "ja/Foo.java": ("java", JAVA), "cc/a.cpp": ("cpp", CPP),
    "sw/v.swift": ("swift", SWIFT), "sh/run.sh": ("bash", SHELL), "lu/m.lua": ("lua", LUA), "r/add.R": ("r", R), "doc/guide.md": ("markdown", MARKDOWN),
}


def values(names: str, rows: list[tuple], types: str) -> str:
    """SQL of rows given as Python values."""

    def one(x) -> str:
        if isinstance(x, list):
            return "[" + ", ".join(map(one, x)) + "]"
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"

    cast = ", ".join(f"{n}::{t} AS {n}" for n, t in zip(names.split(), types.split()))
    return f"SELECT {cast} FROM (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS v({', '.join(names.split())})"


def frame(spark, names: str, rows: list[tuple], types: str):
    return spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(names.split(), types.split())))


# extraction

SYMBOLS, SYMBOL_TYPES = "fqn kind start_line end_line is_exported is_test", "VARCHAR VARCHAR INT INT BOOLEAN BOOLEAN"
#: Symbols of each file: name, kind, first and last line, exported, test.
EXPECTED = {
    "X02_python": ("src/app.py", [("K", "class", 6, 11, True, False), ("K.m", "method", 9, 11, True, False), ("_p", "function", 14, 18, False, False), ("_p.q", "method", 16, 17, True, False), ("test_x", "function", 21, 23, True, True)]),
    "X03_typescript": ("web/main.ts", [("add", "function", 8, 8, True, False), ("C", "class", 9, 9, True, False), ("C.constructor", "method", 9, 9, True, False), ("C.run", "method", 9, 9, True, False), ("C.run.<anonymous>", "method", 9, 9, False, False),
        ("I", "interface", 10, 10, False, False), ("ID", "type_alias", 11, 11, False, False), ("Color", "enum", 12, 12, False, False), ("main", "function", 13, 13, True, False)]),
    "X04_go": ("go/srv.go", [("A", "struct", 9, 11, True, False), ("B", "interface", 12, 12, True, False), ("C", "alias", 13, 13, True, False), ("D", "map", 14, 14, True, False), ("E", "type", 17, 17, True, False), ("(Srv).Run", "method", 21, 24, True, False), ("TestX", "function", 25, 25, True, True)]),
    "X05_cpp": ("cc/a.cpp", [("A", "class", 2, 2, True, False), ("A::get", "method", 2, 2, True, False), ("A::~A", "method", 2, 2, True, False), ("A::put", "method", 3, 3, True, False), ("h", "function", 4, 4, True, False)]),
    "X06_swift": ("sw/v.swift", [("VTest", "class", 2, 7, True, True), ("VTest.t", "property", 3, 3, True, False), ("VTest.walk", "method", 4, 4, True, False), ("VTest.init", "method", 5, 5, True, False), ("VTest.subscript", "method", 6, 6, True, False),
        ("E", "enum", 8, 9, True, False), ("E.one", "enum_case", 8, 8, True, False), ("E.two", "enum_case", 8, 8, True, False), ("E.three", "enum_case", 8, 8, True, False), ("E.four", "enum_case", 9, 9, True, False)]),
    "X07_rust": ("rs/lib.rs", [("longest", "function", 4, 4, True, False), ("Holder", "impl", 5, 7, True, False), ("Holder.get", "method", 6, 6, True, False), ("P", "struct", 8, 8, True, False), ("_p", "function", 9, 9, False, False)]),
    "X07_java": ("ja/Foo.java", [("Foo", "class", 4, 4, True, False), ("Foo.Foo", "method", 4, 4, True, False), ("Foo.bar", "method", 4, 4, True, False), ("Q", "interface", 5, 5, True, False), ("Q.run", "method", 5, 5, True, False), ("Q._name", "method", 5, 5, False, False)]),
    "X07_bash": ("sh/run.sh", [("foo", "function", 3, 7, True, False), ("bar", "function", 8, 8, True, False)]),
    "X07_lua": ("lu/m.lua", [("M.add", "function", 2, 4, True, False), ("sub", "function", 5, 5, True, False)]),
    "X08_r": ("r/add.R", [("add", "function", 2, 4, True, False), (".hid", "function", 5, 5, False, False)]),
    "X09_markdown": ("doc/guide.md", [("Top_One", "heading1", 1, 1, False, False), ("r_setup", "chunk", 3, 3, False, False), ("Sub_part_2", "heading2", 6, 6, False, False)]),
}
#: Calls of each file: the caller's name, the called name, the line.
CALLS = {
    "src/app.py": [("K.m", "foo", 11), ("_p", "wait_for", 18), ("_p.q", "zed", 17), ("test_x", "run_it", 23)],
    "web/main.ts": [("add", "helper", 8), ("add", "inner", 8), ("C.constructor", "init", 9), ("C.run", "each", 9), ("C.run", "go", 9), ("C.run.<anonymous>", "nested", 9), ("main", "boot", 13)],
    "go/srv.go": [("(Srv).Run", "step", 23), ("TestX", "call", 25)],
    "rs/lib.rs": [("longest", "pick", 4), ("Holder.get", "fetch", 6), ("Holder.get", "iter", 6), ("Holder.get", "collect", 6), ("_p", "check", 9)],
    "ja/Foo.java": [("Foo.Foo", "init", 4), ("Foo.bar", "baz", 4)],
    "cc/a.cpp": [("A::get", "calc", 2), ("A::~A", "drop_it", 2), ("A::put", "go_on", 3), ("h", "run_it", 4)],
    "sw/v.swift": [("VTest.t", "compute", 3), ("VTest.walk", "run", 4), ("VTest.init", "setUp", 5), ("VTest.subscript", "at", 6)],
    "sh/run.sh": [("foo", "compute", 4), ("foo", "check_it", 5), ("foo", "run_it", 5), ("foo", "filter_it", 5), ("foo", "echo", 6), ("bar", "foo", 8), ("bar", "baz", 8)],
    "lu/m.lua": [("M.add", "walk", 3), ("sub", "run", 5)],
    "r/add.R": [("add", "walk", 3), (".hid", "other", 5)],
}
CONTAINS = [
    ("src/app.py", "K", "K.m"), ("src/app.py", "_p", "_p.q"), ("web/main.ts", "C", "C.constructor"), ("web/main.ts", "C", "C.run"), ("web/main.ts", "C.run", "C.run.<anonymous>"), ("rs/lib.rs", "Holder", "Holder.get"), ("ja/Foo.java", "Foo", "Foo.Foo"), ("ja/Foo.java", "Foo", "Foo.bar"),
    ("ja/Foo.java", "Q", "Q.run"), ("ja/Foo.java", "Q", "Q._name"), ("cc/a.cpp", "A", "A::get"), ("cc/a.cpp", "A", "A::~A"), *[("sw/v.swift", "VTest", f"VTest.{x}") for x in ("t", "walk", "init", "subscript")], *[("sw/v.swift", "E", f"E.{x}") for x in ("one", "two", "three", "four")],
]
IMPORTS = [
    ("src/app.py", "__module__", "os", 1), ("src/app.py", "__module__", "a.b.c", 2), ("src/app.py", "__module__", ".near", 3), ("src/app.py", "K.m", "late", 10), ("web/main.ts", "__module__", "./m", 4), ("web/main.ts", "__module__", "./side", 5), ("web/main.ts", "__module__", "z", 6),
    ("go/srv.go", "__module__", "fmt", 4), ("go/srv.go", "__module__", "net/http", 5), ("rs/lib.rs", "__module__", "a::{B, C}", 1), ("rs/lib.rs", "__module__", "std::io", 2), ("ja/Foo.java", "__module__", "a.b.C", 1), ("ja/Foo.java", "__module__", "x.Y.z", 2),
]
DOCS = [
    ("src/app.py::K", "Doc of K."), ("src/app.py::test_x", "Runs it."), ("web/main.ts::add", "Adds."), ("go/srv.go::(Srv).Run", "Run does\none step."), ("rs/lib.rs::longest", "The longer one."), ("ja/Foo.java::Foo", "Holds."), ("cc/a.cpp::A", "A thing."),
    ("sh/run.sh::foo", "Does it."), ("lu/m.lua::M.add", "Adds."), ("r/add.R::add", "Adds."),
]
SIGNATURES = [
    ("src/app.py::K.m", "def m(self, x)"), ("src/app.py::test_x", "def test_x() -> int"), ("web/main.ts::C.run", "run(): void"), ("go/srv.go::(Srv).Run", "func (s *Srv) Run(a int) error"), ("rs/lib.rs::longest", "pub fn longest<'a>(x: &'a str, y: &'a str) -> &'a str"),
    ("ja/Foo.java::Foo.bar", "int bar(String s) throws E"), ("ja/Foo.java::Q.run", "void run(int a)"), ("cc/a.cpp::A::get", "int get(int x) const"), ("sw/v.swift::VTest.walk", "func walk(a: Int) -> Bool"), ("sh/run.sh::foo", "foo()"), ("lu/m.lua::M.add", "function M.add(a)"), ("r/add.R::add", "add <- function(x)"),
]
PREVIEWS = [
    ("src/app.py::K", "def m(self, x):\n    import late\n    return foo(x) + len(x)"), ("src/app.py::K.m", "import late\nreturn foo(x) + len(x)"), ("src/app.py::test_x", "run_it()"), ("go/srv.go::(Srv).Run", "go func() { inner() }()\nreturn s.step(a)"), ("rs/lib.rs::_p", "check!(1);"), ("r/add.R::add", "walk(x)"),
]


def _sources(s):
    return frame(s, "file_path lang content", [(p, lang, text) for p, (lang, text) in SOURCES.items()], "string string string")


def _symbols(s):
    return extract.extract_symbols(_sources(s)).select(F.inline("symbols"))


def _references(s, kind: str):
    e = extract.reference_rows(extract.extract_symbols(_sources(s))).where(F.col("type") == kind)
    return e.select(F.substring_index("source_fqn", "::", 1).alias("file_path"), F.regexp_replace("source_fqn", "^[^:]*::", "").alias("source"), "target", "call_site_line", "confidence")


def _language(name: str, path: str, rows: list[tuple]) -> None:
    def query(s, d):
        return _symbols(s).where(F.col("file_path") == path).select(F.regexp_replace("fqn", "^[^:]*::", "").alias("fqn"), "kind", "start_line", "end_line", "is_exported", "is_test")

    q(name, values(SYMBOLS, rows, SYMBOL_TYPES))(query)


for _name, (_path, _rows) in EXPECTED.items():
    _language(_name, _path, _rows)


@q("X01_dispatch", values("file_path lang symbols error", [*[(p, lang, len(rows), False) for name, (p, rows) in EXPECTED.items() for lang in [SOURCES[p][0]]], ("x.cob", "cobol", 0, True), ("bad.py", "python", 0, True), ("none.py", "python", 0, False)], "VARCHAR VARCHAR INT BOOLEAN"))
def x01(s, d):
    more = frame(s, "file_path lang content", [("x.cob", "cobol", "x"), ("bad.py", "python", "def ("), ("none.py", "python", None)], "string string string")
    return extract.extract_symbols(_sources(s).unionByName(more)).select("file_path", "lang", F.size("symbols").alias("symbols"), F.col("error").isNotNull().alias("error"))


@q("X10_calls", values("file_path source target call_site_line confidence", [(p, *c, 1.0) for p, cs in CALLS.items() for c in cs], "VARCHAR VARCHAR VARCHAR INT DOUBLE"))
def x10(s, d):
    return _references(s, "CALLS")


@q("X11_contains", values("file_path source target confidence", [(p, a, f"{p}::{b}", 1.0) for p, a, b in CONTAINS], "VARCHAR VARCHAR VARCHAR DOUBLE"))
def x11(s, d):
    return _references(s, "CONTAINS").drop("call_site_line")


@q("X12_imports", values("file_path source target call_site_line confidence", [(*x, 0.9) for x in IMPORTS], "VARCHAR VARCHAR VARCHAR INT DOUBLE"))
def x12(s, d):
    return _references(s, "IMPORTS")


@q("X13_docstrings", values("fqn docstring", DOCS, "VARCHAR VARCHAR"))
def x13(s, d):
    return _symbols(s).where(F.col("docstring") != "").select("fqn", "docstring")


@q("X14_previews", values("fqn body_preview", PREVIEWS, "VARCHAR VARCHAR"))
def x14(s, d):
    return _symbols(s).where(F.col("fqn").isin([x for x, _ in PREVIEWS])).select("fqn", "body_preview")


@q("X14_preview_of_texts", r"SELECT doc_id, substring(array_to_string(list_transform(l, lambda x: substring(x, n + 1)), chr(10)), 1, 800) AS preview FROM (SELECT doc_id, l, coalesce(list_min(list_transform(l, lambda x: length(regexp_extract(x, '^[ ]*')))), 0) AS n FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: trim(l, E' \t\n\r\x0b\x0c') <> '')[1:20] AS l FROM (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND regexp_full_match(text, '[ -~\n]*') AND NOT regexp_matches(text, '[ ](\n|$)'))))")
def x14_texts(s, d):
    """The extractor's preview of whole documents; of those in plain ASCII without blanks at line ends, for which SQL can say the same."""
    t = table(s, d, "documents").where(F.col("text").isNotNull() & F.col("text").rlike(r"\A[ -~\n]*\z") & ~F.col("text").rlike(r"[ ](\n|\z)"))
    run = F.pandas_udf(lambda x: x.map(lambda v: extract.preview(v.split("\n"))), "string")
    return t.select("doc_id", run("text").alias("preview"))


@q("X15_exported", values("fqn is_exported", [(f"{p}::{r[0]}", r[4]) for p, rows in EXPECTED.values() for r in rows], "VARCHAR BOOLEAN"))
def x15(s, d):
    return _symbols(s).select("fqn", "is_exported")


@q("X16_tests", values("fqn", [("src/app.py::test_x",), ("go/srv.go::TestX",), ("sw/v.swift::VTest",), ("spec/a.ts::plain",), ("tests/b.py::K",)], "VARCHAR"))
def x16(s, d):
    more = frame(s, "file_path lang content", [("spec/a.ts", "typescript", "function plain() { }\n"), ("tests/b.py", "python", "class K: pass\n")], "string string string")
    return extract.extract_symbols(_sources(s).unionByName(more)).select(F.inline("symbols")).where("is_test").select("fqn")


@q("X17_signatures", values("fqn signature", SIGNATURES, "VARCHAR VARCHAR"))
def x17(s, d):
    return _symbols(s).where(F.col("fqn").isin([x for x, _ in SIGNATURES])).select("fqn", "signature")


TARGETS = [("typescript", "import type { A } from '../a b';\n", "../a b"), ("typescript", "// import x from 'no'\nconst s = \"import y from 'no'\";\nimport d, {\n  e as f\n} from \"pkg/sub\"\n", "pkg/sub"), ("rust", "pub(crate) use super::one::{\n    Two,\n    three::Four,\n};\n", "super::one::{ Two, three::Four, }"), ("rust", "// use no::thing;\nuse yes::it as other;\n", "yes::it"), ("java", "import a.b.*;\n", "a.b."), ("go", 'package a\n\nimport x "a/b"\n', "a/b")]


@q("X18_import_targets", values("no target", [(i, t) for i, (_, _, t) in enumerate(TARGETS)], "INT VARCHAR"))
def x18(s, d):
    rows = frame(s, "file_path lang content", [(str(i), lang, text) for i, (lang, text, _) in enumerate(TARGETS)], "string string string")
    return extract.reference_rows(extract.extract_symbols(rows)).where(F.col("type") == "IMPORTS").select(F.substring_index("source_fqn", "::", 1).cast("int").alias("no"), "target")


# workspace

IGNORED = {".gitignore": "*.tmp.py\n# a remark\n\n/secret/\n", ".sextantignore": "!keep.tmp.py\n", "sub/.gitignore": "local.py\n", "keep.tmp.py": "x = 1\n", "lose.tmp.py": "x = 1\n", "secret/a.py": "x = 1\n", "sub/local.py": "x = 1\n", "sub/shown.py": "x = 1\n", "node_modules/m.js": "f()\n", "notes.txt": "x\n"}
_made: dict = {}


def folder(spark) -> str:
    """A new local folder beside the checkpoints, or on this machine where the session has only itself."""
    base = urlparse(ensure_checkpoint_dir(spark))
    if base.scheme in ("", "file"):
        path = os.path.join(base.path, f"fixture-{uuid.uuid4()}")
        os.makedirs(path, exist_ok=True)
        return path
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="sextant-fixture-")
    raise ValueError("the workspace of these queries needs a folder that all machines see as a path")


def write(root: str, tree: dict[str, str]) -> None:
    for p, text in tree.items():
        os.makedirs(os.path.dirname(os.path.join(root, p)), exist_ok=True)
        with open(os.path.join(root, p), "w") as f:
            f.write(text)


def workspace(spark) -> str:
    """The tree of all sources and ignored files, with a link back to its root; once for each application."""
    key = (spark.sparkContext.applicationId, "tree")
    if key not in _made:
        root = folder(spark)
        write(root, {p: t for p, (_, t) in SOURCES.items()} | IGNORED)
        os.symlink(root, os.path.join(root, "sub", "loop"))
        _made[key] = root
    return _made[key]


PROJECT = {
    "math_ops.py": 'def add_numbers(a, b):\n    """Add two numbers."""\n    return checked(a) + b\n\n\ndef checked(a):\n    """Check a number."""\n    return a\n',
    "utils.py": "from math_ops import add_numbers\n\n\ndef helper(x):\n    return add_numbers(x, 1)\n",
    "more.py": "from utils import helper\n\n\ndef outer():\n    return helper(2)\n",
}


def project(spark) -> Engine:
    """An engine with an index of PROJECT; once for each application."""
    key = (spark.sparkContext.applicationId, "engine")
    if key not in _made:
        root = folder(spark)
        write(root, PROJECT)
        e = Engine(spark, os.path.join(root, ".sextant"), root)
        e.index(with_coupling=False)
        _made[key] = e
    return _made[key]


#: ``go`` is among the directories that are never entered.
TREE = sorted([(p, lang) for p, (lang, _) in SOURCES.items() if not p.startswith("go/")] + [("keep.tmp.py", "python"), ("sub/shown.py", "python")])


@q("S01_tree", values("file_path lang", TREE, "VARCHAR VARCHAR"))
def s01(s, d):
    return files.read_tree(s, workspace(s)).select("file_path", "lang")


@q("S03_ignore_file", values("no pattern", [(0, "*.tmp.py"), (1, "/secret/")], "INT VARCHAR"))
def s03(s, d):
    with open(os.path.join(workspace(s), ".gitignore")) as f:
        return frame(s, "no pattern", list(enumerate(files.parse_patterns(f.read()))), "int string")


@q("S05_layered_ignore", values("file_path", [("keep.tmp.py",), ("sub/shown.py",)], "VARCHAR"))
def s05(s, d):
    return files.read_tree(s, workspace(s)).where(F.col("file_path").isin(list(IGNORED))).select("file_path")


SUFFIXES = [(".py", "python"), (".js", "javascript"), (".jsx", "javascript"), (".ts", "typescript"), (".tsx", "typescript"), (".go", "go"), (".rs", "rust"), (".java", "java"), (".c", "c"), (".h", "c"), (".cc", "cpp"), (".cpp", "cpp"), (".cxx", "cpp"), (".hpp", "cpp"), (".hh", "cpp"), (".PY", "python"), (".txt", None)]


@q("S07_built_in_languages", values("suffix lang", SUFFIXES, "VARCHAR VARCHAR"))
def s07(s, d):
    t = frame(s, "suffix", [(x,) for x, _ in SUFFIXES], "string")
    return t.select("suffix", files.language_column(F.concat(F.lit("dir.d/a.b"), "suffix"), more=False).alias("lang"))


HISTORY = [("Ann", 1700000000, {"a.py": "1", "b.py": "1"}), ("Bo", 1700000100, {"a.py": "2"}), ("Ann", 1700000200, {"dir/ü.py": "1"})]


@q("S10_commits", values("file_path author seconds", [(p, who, at) for who, at, tree in HISTORY for p in tree], "VARCHAR VARCHAR BIGINT"))
def s10(s, d):
    root = folder(s)

    def run(*args, **env):
        subprocess.run(["git", "-C", root, *args], check=True, capture_output=True, env=os.environ | env)

    run("init", "-q", "-b", "main")
    for who, at, tree in HISTORY:
        write(root, tree)
        run("add", "-A")
        run("-c", f"user.name={who}", "-c", "user.email=a@example.org", "commit", "-q", "-m", "x", GIT_AUTHOR_DATE=f"{at} +0000", GIT_COMMITTER_DATE=f"{at} +0000")
    # a merge is no commit of its own
    who = ("-c", "user.name=Cy", "-c", "user.email=c@example.org")
    run("checkout", "-q", "-b", "side", "HEAD~1")
    run(*who, "merge", "-q", "--no-ff", "-m", "merged", "main")
    return git.read_commits(s, root).select("file_path", "author", F.unix_timestamp("ts").alias("seconds"))


@q("S11_point_lookups", "SELECT 'id' AS by, id, fqn FROM nodes WHERE id = (SELECT max(id) FROM nodes) UNION ALL SELECT 'fqn', id, fqn FROM nodes WHERE fqn = (SELECT min(fqn) FROM nodes) UNION ALL SELECT 'file', id, fqn FROM nodes WHERE file_path = (SELECT max(file_path) FROM nodes)")
def s11(s, d):
    """Lookups in a stored snapshot; the values are literals, so they reach the scan."""
    n = table(s, d, "nodes")
    st = store.Store(s, os.path.join(ensure_checkpoint_dir(s), f"store-{uuid.uuid4()}"))
    st.commit({"nodes": n.select("id", "name", "fqn", "file_path", "kind", "start_line", "end_line", "signature", "docstring", "body_preview", "is_exported", "is_test", "repo_alias")})
    want = n.agg(F.max("id").alias("id"), F.min("fqn").alias("fqn"), F.max("file_path").alias("file_path")).first()
    kept = st.read("nodes")
    find = lambda by, c: kept.where(F.col(c) == want[c]).select(F.lit(by).alias("by"), "id", "fqn")
    return find("id", "id").unionByName(find("fqn", "fqn")).unionByName(find("file", "file_path"))


@q("S13_stored_vocabulary", f"WITH {TFIDF} SELECT term, df::BIGINT AS df, round(idf, 6) AS idf FROM voc")
def s13(s, d):
    n = table(s, d, "nodes")
    st = store.Store(s, os.path.join(ensure_checkpoint_dir(s), f"store-{uuid.uuid4()}"))
    vocab, _ = vectors.tfidf_fit(n, vectors.embedding_text(n))
    st.commit({"tfidf_vocab": vocab})
    return st.read("tfidf_vocab").select("term", "df", F.round("idf", 6).alias("idf"))


CONFIG = "# settings\n\nencoder: hashing-64\n  url : http://x:80/a \nno colon here\nempty:\n"


@q("S14_config", values("key value", [("encoder", "hashing-64"), ("url", "http://x:80/a"), ("empty", "")], "VARCHAR VARCHAR"))
def s14(s, d):
    return frame(s, "key value", list(requests.read_config(CONFIG).items()), "string string")


@q("K13_config_written", values("no line", [(0, "encoder: hashing-64"), (1, "url: http://x:80/a"), (2, "empty: ")], "INT VARCHAR"))
def k13(s, d):
    return frame(s, "no line", list(enumerate(requests.write_config(requests.read_config(CONFIG)).splitlines())), "int string")


LINES = [
    ('{"jsonrpc": "2.0", "id": 1, "method": "initialize"}', 1, "serverInfo", None), ('{"jsonrpc": "2.0", "method": "notifications/initialized"}', None, None, None), ("{broken", None, None, -32700), ('{"jsonrpc": "2.0", "id": 2, "method": "ping"}', 2, "", None),
    ('{"jsonrpc": "2.0", "id": 3, "method": "tools/list"}', 3, "tools", None), ('{"jsonrpc": "2.0", "id": 4, "method": "unheard/of"}', 4, None, -32601), ('{"jsonrpc": "2.0", "id": 5, "method": "tools/call", "params": {"name": "none", "arguments": {}}}', 5, None, -32601),
    ('{"jsonrpc": "2.0", "id": 6, "method": "tools/call", "params": {"name": "search_logic_flow", "arguments": {}}}', 6, None, -32603), ('{"jsonrpc": "2.0", "id": 7, "method": "tools/call", "params": {"name": "resolve_symbols", "arguments": {"names": ["helper"]}}}', 7, "content", None),
]


def _served(s) -> list[dict]:
    out = io.StringIO()
    Server(Tools(project(s))).run(io.StringIO("".join(x[0] + "\n" for x in LINES)), out)
    return [json.loads(x) for x in out.getvalue().splitlines()]


@q("S16_lines_read", values("answers notifications", [(8, 1)], "INT INT"))
def s16(s, d):
    n = len(_served(s))
    return frame(s, "answers notifications", [(n, len(LINES) - n)], "int int")


@q("C15_json_rpc", values("id holds code", [(i, h, c) for _, i, h, c in LINES if h is not None or c is not None], "INT VARCHAR INT"))
def c15(s, d):
    rows = [(r["id"], next((k for k in ("serverInfo", "tools", "content") if k in r["result"]), "") if "result" in r else None, r.get("error", {}).get("code")) for r in _served(s)]
    return frame(s, "id holds code", rows, "int string int")


# store

@q("K07_marker", values("name n", [("nodes", 4), ("file_cache", 3), ("import_refs", 2), ("call_refs", 5)], "VARCHAR BIGINT"))
def k07(s, d):
    """Rows as the marker of the snapshot says."""
    e = project(s)
    fresh = Engine(s, os.path.join(folder(s), "store"), e.root)
    fresh.index(with_coupling=False)
    rows = fresh.store.meta()["rows"]
    return frame(s, "name n", [(k, rows[k]) for k in ("nodes", "file_cache", "import_refs", "call_refs")], "string long")


@q("K14_layout", values("step current version rows", [("empty", None, False, 0), ("committed", 1, True, 1), ("again", 2, True, 2), ("old layout", 3, False, 2), ("forgotten", None, False, 0)], "VARCHAR INT BOOLEAN INT"))
def k14(s, d):
    st = store.Store(s, os.path.join(folder(s), "store"))
    row = lambda x: s.createDataFrame([(x, None, "w")], "session_id string, started_at timestamp, workspace string")
    out = []
    look = lambda step: out.append((step, st.current(), st.is_current_version(), st.read("sessions").count()))
    look("empty")
    st.commit({"sessions": row("a")})
    look("committed")
    st.commit({}, added={"sessions": row("b")})
    look("again")
    st.commit({}, extra={"schema_version": "0"})
    look("old layout")
    st.reset()
    look("forgotten")
    return frame(s, "step current version rows", out, "string int boolean int")


ASKED = [("add numbers", ["add_numbers", "nowhere"], "math_ops.py"), ("helper", ["def helper"], "no such place")]


def _by_hand(words: list[str]) -> int:
    """Tokens of the lists of files with each word and of the first three of them, read whole."""
    paths = sorted(PROJECT)
    lists = [[p for p in paths if w in PROJECT[p]] for w in words]
    first = list(dict.fromkeys(p for x in lists for p in x))[:3]
    return sum(sum(len(p) + 3 for p in x) // 4 for x in lists if x) + sum(len(PROJECT[p]) // 4 for p in first)


@q("K12_benchmark_results", values("query base recalled", [(a, _by_hand(w), r) for (a, w, _), r in zip(ASKED, (True, False))], "VARCHAR INT BOOLEAN"))
def k12(s, d):
    """The benchmark's results as the command line writes them, read back."""
    path = folder(s)
    write(path, {"asked.jsonl": "".join(json.dumps({"query": a, "words": w, "hint": h}) + "\n" for a, w, h in ASKED)})
    with contextlib.redirect_stdout(io.StringIO()):
        cli.main(["benchmark", os.path.join(path, "asked.jsonl"), os.path.join(path, "out")], project(s))
    return s.read.schema("query string, ours int, base int, recalled boolean").json(os.path.join(path, "out")).select("query", "base", "recalled")


@q("C13_benchmark", values("n wins recalled base", [(2, 0, 1, sum(_by_hand(w) for _, w, _ in ASKED))], "BIGINT BIGINT BIGINT BIGINT"))
def c13(s, d):
    """Real capsules against finding words and reading whole files; with files this small, reading them is cheaper."""
    return cli.benchmark(project(s), ASKED).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ours") < F.col("base")).alias("wins"), F.count_if("recalled").alias("recalled"), F.sum("base").alias("base"))


@q("X19_files_not_indexed", values("file_path name kind", [("late.py", "arrived", "function"), ("utils.py", "helper", "function"), ("gone.py", None, None)], "VARCHAR VARCHAR VARCHAR"))
def x19(s, d):
    root = folder(s)
    write(root, PROJECT)
    e = Engine(s, os.path.join(root, ".sextant"), root)
    e.index(with_coupling=False)
    write(root, {"late.py": "def arrived():\n    return 1\n"})
    return e.skeleton(["late.py", "utils.py", "gone.py"]).select("file_path", "name", "kind")


@q("C10_full_build", values("fqn kind file_path", [("math_ops.py::add_numbers", "function", "math_ops.py"), ("math_ops.py::checked", "function", "math_ops.py"), ("utils.py::helper", "function", "utils.py"), ("more.py::outer", "function", "more.py")], "VARCHAR VARCHAR VARCHAR"))
def c10(s, d):
    return project(s).table("nodes").select("fqn", "kind", "file_path")


@q("C10_full_build_edges", values("source target type confidence", [("add_numbers", "checked", "CALLS", 1.0), ("helper", "add_numbers", "CALLS", 1.0), ("outer", "helper", "CALLS", 1.0)], "VARCHAR VARCHAR VARCHAR DOUBLE"))
def c10_edges(s, d):
    e, n = project(s).table("edges"), project(s).table("nodes").select("id", "name")
    return e.join(n.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id").join(n.select(F.col("id").alias("target_id"), F.col("name").alias("target")), "target_id").select("source", "target", "type", "confidence")


@q("C11_update", values("step new changed deleted unchanged nodes", [(1, 3, 0, 0, 0, 4), (2, 0, 0, 0, 3, 4), (3, 1, 1, 1, 1, 5)], "INT INT INT INT INT INT"))
def c11(s, d):
    """A build, an update of nothing, and one with a new, a changed and a deleted file."""
    root = folder(s)
    write(root, PROJECT)
    e = Engine(s, os.path.join(root, ".sextant"), root)
    out = []
    for step in (1, 2, 3):
        if step == 3:
            write(root, {"new.py": "def one():\n    return 1\n", "utils.py": PROJECT["utils.py"] + "\n\ndef two():\n    return helper(1)\n"})
            os.remove(os.path.join(root, "more.py"))
        n = e.index(with_coupling=False)
        out.append((step, n["new"], n["changed"], n["deleted"], n["unchanged"], e.table("nodes").count()))
    return frame(s, "step new changed deleted unchanged nodes", out, "int int int int int int")


# rendering

NODES = [("a.py::f", "seed", "function", "a.py", 3, "def f(x)", "Does f.", 12, 0.9, "bm25"), ("b.py::g", "caller", "function", "b.py", 1, None, None, 8, 0.5, "calls")]
CAPSULE_LINES = [
    "# Context for 'what'", "2 nodes, about 20 of 100 tokens", "", "## Direct matches", "", "### function `a.py::f`", "  a.py:3", "  signature: def f(x)", "  doc: Does f.", "  score 0.900 (bm25)", "", "## Callers", "", "### function `b.py::g`", "  b.py:1", "  score 0.500 (calls)",
    "", "## Observations", "- noted [stale] (confidence 0.5, 2025-01-02 00:00:00)",
]


def _lines(s, text: str, form: str = ""):
    return frame(s, "form no line", [(form, i, x) for i, x in enumerate(text.split("\n"))], "string int string")


def _line_values(*texts: tuple[str, list[str]]) -> str:
    return values("form no line", [(form, i, x) for form, lines in texts for i, x in enumerate(lines)], "VARCHAR INT VARCHAR")


@q("C03_capsule_text", _line_values(("", CAPSULE_LINES)))
def c03(s, d):
    nodes = frame(s, "fqn role kind file_path start_line signature docstring token_estimate score reason", NODES, "string string string string int string string int double string")
    notes = s.sql("SELECT 'noted' AS content, true AS stale, 0.5D AS confidence, '2025-01-02 00:00:00' AS created_at")
    return _lines(s, render.capsule_text("what", nodes, 100, notes))


DEPENDENTS = [("b.py::g", "b.py", "function", 1, "CALLS", "a.py::f"), ("c-d.py::h", "c-d.py", "method", 2, "IMPORTS", "b.py::g")]


@q("C04_impact_text", _line_values(
    ("tree", ["Dependents of `a.py::f`", "- [CALLS] function `b.py::g`", "  - [IMPORTS] method `c-d.py::h`", "2 in all"]), ("list", ["# Dependents of `a.py::f`", "- depth 1 [CALLS] function `b.py::g` (b.py)", "- depth 2 [IMPORTS] method `c-d.py::h` (c-d.py)"]),
    ("mermaid", ["```mermaid", "graph TD", '    b_py__g["b.py::g"] -->|CALLS| a_py__f["a.py::f"]', '    c_d_py__h["c-d.py::h"] -->|IMPORTS| b_py__g["b.py::g"]', "```"])))
def c04(s, d):
    rows = frame(s, "fqn file_path kind depth edge_type target_fqn", DEPENDENTS, "string string string int string string")
    out = [_lines(s, render.impact_text("a.py::f", rows, form), form) for form in ("tree", "list", "mermaid")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@q("C05_flow_text", _line_values(("found", ["# Paths from `a` to `c`", "", "## Path 1", "`a`", "  → `b`", "    → `c`"]), ("none", ["No path from `a` to `c`"])))
def c05(s, d):
    paths = s.createDataFrame([(1, ["a", "b", "c"])], "path_no int, path array<string>")
    return _lines(s, render.flow_text("a", "c", paths), "found").unionByName(_lines(s, render.flow_text("a", "c", paths.limit(0)), "none"))


# tools and command line

@q("C07_pipeline_steps", values("preset section", [("debug", "# Context for 'add numbers'"), ("debug", "Dependents of"), ("explore", "# Context for 'add numbers'"), ("steps", "# Paths from `utils.py::helper` to `math_ops.py::checked`"), ("steps", "## utils.py")], "VARCHAR VARCHAR"))
def c07(s, d):
    """The first line of every section, of presets and of given steps; of dependents without the root's name."""
    tools, out = Tools(project(s)), []
    tools.engine.sent.clear()
    ask = {"debug": {"preset": "debug"}, "explore": {"preset": "explore"}, "steps": {"steps": [{"tool": "flow", "params": {"start": "utils.py::helper", "end": "math_ops.py::checked"}}, {"tool": "skeleton", "params": {"files": ["utils.py"]}}, {"tool": "unknown"}]}}
    for name, more in ask.items():
        text = tools.run_pipeline({"task": "add numbers"} | more)
        tools.engine.sent.clear()
        heads = [x.split("\n")[0] for x in text.split("\n\n---\n\n")]
        out += [(name, "Dependents of" if x.startswith("Dependents of") else x) for x in heads if not x.startswith(("id=", "Nothing"))]
    return frame(s, "preset section", out, "string string")


@q("C12_capsule_once", values("call fqn", [(1, "math_ops.py::add_numbers"), (1, "math_ops.py::checked"), (1, "utils.py::helper"), (1, "more.py::outer"), (2, "math_ops.py::checked"), (2, "more.py::outer")], "INT VARCHAR"))
def c12(s, d):
    """What two capsules for one question hold: the second has no seed that was sent, but what the seeds call and are called by."""
    e = project(s)
    e.sent.clear()
    got = [(i, r.fqn) for i in (1, 2) for r in e.capsule("add_numbers").collect()]
    e.sent.clear()
    return frame(s, "call fqn", got, "int string")


@q("C14_tools", values("tool answers", [(n, True) for n in SCHEMAS], "VARCHAR BOOLEAN"))
def c14(s, d):
    e = project(s)
    tools = Tools(e)
    ask = {
        "run_pipeline": {"task": "helper"}, "get_context_capsule": {"query": "helper"}, "get_impact_graph": {"symbol_fqn": "math_ops.py::checked"}, "search_logic_flow": {"start": "more.py::outer", "end": "math_ops.py::checked"}, "get_skeleton": {"files": ["utils.py"]},
        "index_status": {}, "get_session_context": {}, "save_observation": {"content": "seen"}, "search_memory": {"query": "seen"}, "submit_lsp_edges": {"edges": []}, "resolve_symbols": {"names": ["helper"]}, "workspace_setup": {},
    }
    return frame(s, "tool answers", [(n, bool(tools.call(n, ask[n]))) for n in SCHEMAS], "string boolean")


@q("C16_verbs", values("verb code shows", [("index", 0, True), ("search", 0, True), ("ask", 0, True), ("capsule", 0, True), ("status", 0, True), ("logs", 0, True), ("show-config", 0, True), ("setup", 0, True)], "VARCHAR INT BOOLEAN"))
def c16(s, d):
    e, out = project(s), []
    path = folder(s)
    write(path, {"logs/requests_a.jsonl": '{"tool": "index_status", "session": "a"}\n'})
    verbs = {"index": (["-y"], "unchanged"), "search": (["helper"], "utils.py::helper"), "ask": (["helper"], "utils.py::helper"), "capsule": (["helper"], "# Context for"), "status": ([], "what=nodes"), "logs": ([], "index_status"), "show-config": ([], "mcpServers"), "setup": ([], ".mcp.json")}
    for verb, (more, want) in verbs.items():
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            e.sent.clear()
            code = cli.main(["--root", path if verb == "setup" else e.root, "--store", path, verb, *more], e)
        out.append((verb, code, want in text.getvalue()))
    e.sent.clear()
    return frame(s, "verb code shows", out, "string int boolean")


@q("C17_ask", values("question seeds neighbours", [("helper", 1, True), ("add numbers", 1, True)], "VARCHAR INT BOOLEAN"))
def c17(s, d):
    """Interactive questions, with at most one seed each, and whether callers or callees are shown beside it."""
    out, rows = io.StringIO(), []
    cli.ask_on(project(s), io.StringIO("helper\nadd numbers\n\nnever\n"), out, 1, 8000)
    for part in out.getvalue().split("# Context for ")[1:]:
        seeds = part.partition("## Direct matches")[2].partition("\n## ")[0].count("### ")
        rows.append((part.split("'")[1], seeds, "## Callers" in part or "## Callees" in part))
    return frame(s, "question seeds neighbours", rows, "string int boolean")


@q("C18_setup", values("file servers", [(".mcp.json", 2), (".sextant/config", 0)], "VARCHAR INT"))
def c18(s, d):
    """Written twice into a workspace that has a server of its own. Hooks of agents are left out."""
    path = folder(s)
    write(path, {".mcp.json": '{"mcpServers": {"other": {}}}'})
    cli.setup(path)
    made = cli.setup(path)
    with open(os.path.join(path, ".mcp.json")) as f:
        n = len(json.load(f)["mcpServers"])
    return frame(s, "file servers", [(os.path.relpath(x, path), n if x.endswith("json") else 0) for x in made], "string int")


# vectors

@q("T11_unit_vectors", "SELECT id AS node_id, 64 AS size, 1.0::DOUBLE AS length FROM nodes")
def t11(s, d):
    """Length and norm of every node's encoded text; each has a word, its name."""
    v = vectors.dense_build(table(s, d, "nodes"))
    return v.select("node_id", F.size("vector").alias("size"), F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), 5).alias("length"))


@q("T12_vectors_of_changed", "SELECT id AS node_id, true AS same FROM nodes WHERE id NOT IN (SELECT node_id FROM node_embeddings_dense WHERE node_id IS NOT NULL)")
def t12(s, d):
    """Those without a vector are encoded, and come out as a full build has them."""
    n = table(s, d, "nodes")
    done = table(s, d, "node_embeddings_dense").select(F.col("node_id").alias("id"))
    some = vectors.dense_build(n, changed=n.select("id").join(done, "id", "left_anti"))
    return some.join(vectors.dense_build(n).select("node_id", F.col("vector").alias("whole")), "node_id").select("node_id", (F.col("vector") == F.col("whole")).alias("same"))


@q("T13_encoders", values("name size available", [("hashing-64", 64, True), ("hashing-256", 256, True), ("missing library", 8, False), ("never named", None, False)], "VARCHAR INT BOOLEAN"))
def t13(s, d):
    def missing():
        raise ImportError("no such library")

    vectors.register_encoder("missing library", missing, 8)
    names = ["hashing-64", "hashing-256", "missing library", "never named"]
    rows = [(n, vectors.ENCODERS[n][1] if n in vectors.ENCODERS else None, vectors.encoder_available(n)) for n in names]
    del vectors.ENCODERS["missing library"]
    return frame(s, "name size available", rows, "string int boolean")


# streaming

@q("Z01_micro_batches", values("file_path batches", [("a.py", 1), ("b.py", 1), ("c.py", 1)], "VARCHAR INT"))
def z01(s, d):
    """Deliveries of files, two runs of the stream: every delivery is processed by exactly one run, and written under its batch."""
    path = folder(s)
    incoming, out = os.path.join(path, "in"), os.path.join(path, "out")
    schema = "file_path string, content string"

    def process(rows, batch):
        rows.select("file_path", F.lit(batch).cast("int").alias("batch")).write.mode("overwrite").parquet(os.path.join(out, f"run={batch}"))

    for names in (["a.py", "b.py"], ["c.py"]):
        s.createDataFrame([(n, "x = 1") for n in names], schema).coalesce(1).write.mode("append").json(incoming)
        flows.micro_batches(s.readStream.schema(schema).json(incoming), process, os.path.join(path, "log"), None).awaitTermination()
    return cut(s.read.parquet(out).groupBy("file_path").agg(F.count(F.lit(1)).cast("int").alias("batches")))


@q("Z01_due", values("call indexed", [(1, True), (2, False), (3, True)], "INT BOOLEAN"))
def z01_due(s, d):
    """An engine asked three times, the third after its interval: it looks at the tree the first and the third time."""
    root = folder(s)
    write(root, {"a.py": PROJECT["math_ops.py"]})
    e = Engine(s, os.path.join(root, ".sextant"), root)
    out = []
    for call in (1, 2, 3):
        if call == 3:
            e._checked -= e.RECHECK_SECONDS
        out.append((call, e.reindex_if_due() is not None))
    return frame(s, "call indexed", out, "int boolean")
