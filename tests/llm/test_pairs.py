"""Documentation that says something, and taking functions apart."""

import pytest
import regex

from sextant.llm import pairs

TRIVIAL = [
    "TODO", "FIXME: write docs", "tbd -- docs", "...", "---", "/** */", "# //", '"""', "n/a", "(no description)", "Description goes here.", "Docs to follow.", "Placeholder.", "WIP", "xxx",
    "fetch label", "Fetch label.", "Fetch label method.", "The fetch label function.", "Function fetchLabel.", "Fetches the label.", "fetch_label(marker, lookup) -> int", "def fetch_label(marker, lookup):",
    "This function is used to fetch label. It takes marker and lookup.", "Method fetch_label with the parameters marker and lookup.", ":param marker:\n:param lookup:\n:return:", "@param marker\n@param lookup\n@return",
    "Function to fetch label.\n\nArgs:\n    marker: the marker\n    lookup: the lookup", "See above.", "See super.", "As above.", "See base class.", "{@inheritDoc}", "@see #fetch_label", "Same as parent.",
    "noqa", "type: ignore", "pylint: disable=unused-argument", "eslint-disable-next-line", "@ts-ignore", "nolint", "pragma: no cover", "clippy::all", "noinspection ALL",
    "Generated code, do not edit.", "Created from the file template.", "Copyright of the authors. All rights reserved.", "Author: the team", "@since 1.7", "Version 0.19", "Auto-generated method stub",
    "print(marker)", "return marker.lookup", "marker = fetch_label(marker)", "if marker: fetch_label(marker)", "for (x of y) { go(x); }", "", "   ",
]
TELLING = [
    "Returns bytes, not characters.", "Blocks until the queue drains.", "Idempotent; safe to retry after timeouts.", "TODO: tidy up. Falls back to the local file.", "# Drops stale rows in place.",
    "/**\n * Costs one pass over the node,\n * so avoid it inside a loop.\n */", ":param marker: negative offsets count from the end.\n:return: the label", "Liefert nur Dateien, auf die kein anderer Eintrag verweist.",
    "Supprime les liens vides puis renvoie le nombre de modules.", "Two region values count as equal when their cursor agrees.", "返回最近的标签，按时间排序", "See above. Callers must hold the lock.", "<p>Missing entries are treated as current.</p>",
    "fetch_label: Raises if the node was moved in the meantime.", "Created on demand when the cache is cold and kept until the next flush of the journal.", 'r"""Cheapest wins."""', "Not thread safe.",
]
#: Real text that begins like a remark on origin, or follows one.
AFTER_REMARKS = [
    "Version of the schema the client must send.", "Owner of the lock, null when it is free.", "Date of the last delivery in UTC.", "Copied from the input buffer into the cache",
    "@since 2.0\nReads the header and checks its checksum.", "Generated by the build. Reads the header and checks its checksum.", "Copyright of the authors.\n\nBlocks until the queue drains.", "noqa\nBlocks until the queue drains.",
]
REMARKS = ["Owner: storage", "Author Jane Doe <jane@example.org>", "Ported from Java.", "copied from util/io.py", "Since version 2.1", "Added in v2 by Jane Doe", "# Added in change 678.", "Moved from core.cache in 3.0", "@deprecated use the other\none, which is cheaper", "Date 2024-01-02", "Generated by the build\nand never edited"]
#: The name said again in other languages, and single labels.
SAID_AGAIN = ["Ruft den Wert ab.", "Gibt den Rückgabewert zurück.", "Retourne la valeur.", "Obtiene el valor.", "Restituisce il valore.", "返回值", "値を返す", "Returns true.", "Wrapper.", "Deprecated.", "Internal use only.", "Getter for label."]
TELLING_ELSEWHERE = ["Ruft den Wert nur beim ersten Zugriff ab.", "Retourne la valeur la plus récente.", "返回最后一次写入的值", "Since this is called on every frame, avoid allocation.", "Author rights are validated here before export.", "Deprecated: loses the last byte of odd streams.", "Returns true if the queue is empty."]
SIGNATURE = "def fetch_label(self, marker, lookup) -> int"


@pytest.mark.parametrize("doc", TRIVIAL + REMARKS + SAID_AGAIN)
def test_trivial(doc):
    assert not pairs.says_something(doc, "fetch_label", SIGNATURE)


@pytest.mark.parametrize("doc", TELLING + AFTER_REMARKS + TELLING_ELSEWHERE)
def test_telling(doc):
    assert pairs.says_something(doc, "fetch_label", SIGNATURE)


@pytest.mark.parametrize(
    ("body", "doc"),
    [
        ("// a\n// b\nreturn x;", "// a\n// b"), ("/* a ) */\nf(x)", "/* a ) */"), ("  # a\n  # b\n\nx = 1", "# a\n  # b"), ('"""a\nb"""\nreturn', '"""a\nb"""'), ("'a'\nreturn", "'a'"), ('r"""a"""', 'r"""a"""'),
        ('"""open', '"""open'), ("-- a\nlocal x", "-- a"), ("--[[ a\nb ]]\nx", "--[[ a\nb ]]"), ("return 1", ""), ('"a" + b', ""), ("", ""), (None, ""), ("/** a", "/** a"),
    ],
)
def test_head(body, doc):
    assert pairs.take_apart("f()", body)[1] == doc


def test_what_the_pattern_cannot_take_apart(monkeypatch):
    monkeypatch.setitem(pairs._compiled, "source", regex.compile("(?!)"))
    assert pairs.take_apart("f()", "// a\nreturn x;") == ("f()", "// a", "return x;") and pairs.take_apart("f()", "return") == ("f()", "", "return")


def test_body_is_whole():
    body = '// d\nif (a("}")) { return "(" + b[1]; } // )\nnext("\\""); }'
    s, doc, rest = pairs.take_apart("void f()", body)
    assert (s, doc) == ("void f()", "// d") and rest == body[5:]
    long = "x = (" * 50 + "1" + ")" * 40 + '\n"unclosed ' * 100
    assert pairs.take_apart("f()", long)[2] == long


def test_rows(spark):
    rows = [
        (1, "f", "def f()", "Returns bytes.", None, "Function"), (2, "f", None, " ", "# Keeps order.\nx = 1", "METHOD"), (3, "f", "", "Returns bytes.", " ", "function"), (4, "f", "def f()", None, None, "function"),
        (5, "f", "def f()", "Returns bytes.", None, "class"), (6, "f", "def f()", "TODO", "# Keeps order.", "function"), (None, "f", "def f()", "Returns bytes.", None, "function"), (7, None, "def f()", "Returns bytes.", None, None),
        (8, "f", "def f()", None, "// " + "word " * 50_000 + "\n{" * 2000, "function"), (1, "f", "def f()", "Returns bytes.", None, "Function"),
    ]
    df = spark.createDataFrame([(*r, "c", "d") for r in rows], "id long, name string, signature string, docstring string, body_preview string, kind string, code string, description string")
    got = pairs.function_pairs(df).collect()
    assert sorted(r.node_id for r in got) == [1, 1, 2, 8]
    assert {r.description for r in got if r.node_id == 2} == {"Keeps order."}
    assert pairs.function_pairs(df.limit(0)).count() == 0
