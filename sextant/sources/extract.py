"""Symbols and references of source files.

Python is read with its own parser. The other languages are read with one lexer: strings and comments are blanked
out, declarations found by pattern, bodies by balanced braces (or by ``end``), scopes by the bodies that contain
them. Files are independent rows, so extraction is one pass without a shuffle.
"""

from __future__ import annotations

import ast
import bisect
import re
import textwrap
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.session import spread

#: Names that make no call edge.
SKIP_CALLS = frozenset(
    """print len range isinstance type str int float list dict set tuple bool open super object max min sum abs zip map filter enumerate
    hasattr getattr setattr format repr id console Promise Array Object String Number Math printf fprintf sprintf malloc calloc free sizeof
    assert panic make append copy delete new""".split()
)
#: Words before a bracket that are no calls.
KEYWORDS = frozenset("if for while switch match catch return function func fn def class elif else except with and or not in is lambda sizeof typeof new await yield throw case do until unless guard where when then elseif local".split())
DOC_CHARS, BODY_LINES, BODY_CHARS = 512, 20, 800
CALL_CONFIDENCE, CONTAINS_CONFIDENCE, IMPORT_CONFIDENCE = 1.0, 1.0, 0.9

SYMBOL = "name string, fqn string, file_path string, kind string, start_line int, end_line int, signature string, docstring string, body_preview string, is_exported boolean, is_test boolean"
REFERENCE = "source_fqn string, target string, type string, call_site_line int, confidence double"
FILE_SYMBOLS = f"file_path string, lang string, symbols array<struct<{', '.join(x.strip().replace(' ', ': ') for x in SYMBOL.split(','))}>>, edges array<struct<{', '.join(x.strip().replace(' ', ': ') for x in REFERENCE.split(','))}>>, error string"


@dataclass
class Found:
    """Symbols and references of one file."""

    path: str
    symbols: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)

    def symbol(self, name, qualified, kind, start, end, signature="", doc="", body="", exported=True, test=False):
        self.symbols.append(dict(name=name, fqn=f"{self.path}::{qualified}", file_path=self.path, kind=kind, start_line=start, end_line=end, signature=signature.strip(), docstring=doc[:DOC_CHARS], body_preview=body, is_exported=bool(exported), is_test=bool(test) or "test" in self.path.lower()))

    def edge(self, source, target, kind, line, confidence):
        self.edges.append(dict(source_fqn=f"{self.path}::{source}", target=target, type=kind, call_site_line=line, confidence=float(confidence)))


def preview(lines: list[str]) -> str:
    """The first non-blank lines, without their common indentation, cut in lines and characters."""
    kept = [x.rstrip() for x in lines if x.strip()][:BODY_LINES]
    return textwrap.dedent("\n".join(kept))[:BODY_CHARS]


def strip_marks(comment: str) -> str:
    """A comment without its marks."""
    text = re.sub(r"^\s*/\*+!?|\*+/\s*$", "", comment.strip())
    return "\n".join(re.sub(r"^\s*(?:///?|//!|--+|#+|\*+)\s?", "", x).rstrip() for x in text.split("\n")).strip()


def called(node: ast.Call) -> str | None:
    f = node.func
    return f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None


def python_calls(body: list[ast.stmt]) -> Iterator[tuple[str, int]]:
    """Calls in a body, not those in nested functions and lambdas."""
    stack: list[ast.AST] = list(reversed(body))
    while stack:
        n = stack.pop()
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)):
            continue
        if isinstance(n, ast.Call) and (c := called(n)) and len(c) > 1 and c not in SKIP_CALLS:
            yield c, n.lineno
        stack.extend(reversed(list(ast.iter_child_nodes(n))))


def extract_python(path: str, text: str) -> Found:
    """Functions, methods (functions in any scope), classes, imports, calls and containment."""
    out = Found(path)
    tree = ast.parse(text)
    lines = text.split("\n")

    def visit(n: ast.AST, scope: list[str]) -> None:
        here = ".".join(scope)
        for c in ast.iter_child_nodes(n):
            if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                cls = isinstance(c, ast.ClassDef)
                name = ".".join([*scope, c.name])
                doc = ast.get_docstring(c) or ""
                first = c.body[1:] if doc and len(c.body) > 1 else ([] if doc else c.body)
                body = preview(lines[first[0].lineno - 1 : c.end_lineno]) if first else ""
                head = lines[c.lineno - 1 : c.body[0].lineno - 1] or [lines[c.lineno - 1].split(":")[0]]
                signature = " ".join(" ".join(head).split()).rstrip(":") if not cls else lines[c.lineno - 1].strip().rstrip(":")
                out.symbol(c.name, name, "class" if cls else "method" if scope else "function", c.lineno, c.end_lineno, signature, doc, body, not c.name.startswith("_"), not cls and c.name.startswith("test_"))
                if scope:
                    out.edge(here, f"{path}::{name}", "CONTAINS", c.lineno, CONTAINS_CONFIDENCE)
                if not cls:
                    for target, line in python_calls(c.body):
                        out.edge(name, target, "CALLS", line, CALL_CONFIDENCE)
                visit(c, [*scope, c.name])
            elif isinstance(c, ast.Import):
                for a in c.names:
                    out.edge(here or "__module__", a.name, "IMPORTS", c.lineno, IMPORT_CONFIDENCE)
            elif isinstance(c, ast.ImportFrom):
                module = "." * c.level + (c.module or "")
                for a in c.names:
                    out.edge(here or "__module__", module if a.name == "*" else f"{module}.{a.name}" if module.strip(".") else module + a.name, "IMPORTS", c.lineno, IMPORT_CONFIDENCE)
            else:
                visit(c, scope)

    visit(tree, [])
    return out


@dataclass
class Language:
    """How declarations of a language look: (pattern, kind) with the groups name and, where it applies, owner and export."""

    declarations: list[tuple[str, str]]
    imports: list[str] = field(default_factory=list)
    line_comment: str = "//"
    joiner: str = "."
    exported: str = "underscore"
    tests: tuple[str, ...] = ("test_",)
    test_kinds: bool = True
    ends: bool = False
    #: Strings of the language, as patterns; what is in them is no code.
    strings: tuple[str, ...] = (r"\"(?:[^\"\\\n]|\\.)*\"", r"'(?:[^'\\\n]|\\.)*'")
    #: Functions without a name: calls in them are not those of the function around.
    closures: str | None = None
    #: Which of the bodies around a declaration are part of its name: those of types, all, or none.
    scopes: str = "all"


_GENERIC = r"(?:<[^<>{}()]*(?:<[^<>]*>)*[^<>{}()]*>)?"
_DOUBLE, _SINGLE = r"\"(?:[^\"\\\n]|\\.)*\"", r"'(?:[^'\\\n]|\\.)*'"
_ARROW = r"(?:\basync\s*)?(?:\((?:[^()]|\([^()]*\))*\)\s*(?::\s*[\w<>\[\]|. ]+)?|\b[\w$]+)\s*=>"
LANGUAGES = {
    "javascript": Language(
        [
            (r"(?P<exp>\bexport\s+(?:default\s+)?)?\b(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]*)\s*\(", "function"),
            (rf"(?P<exp>\bexport\s+)?\b(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=;\n]+)?=\s*(?:(?:async\s*)?function\b[^(\n]*\(|{_ARROW})", "function"),
            (r"(?P<exp>\bexport\s+(?:default\s+)?(?:abstract\s+)?)?\bclass\s+(?P<name>[\w$]+)", "class"),
            (r"(?m)(?:^|(?<=[{};]))[ \t]*(?:(?:public|private|protected|static|async|get|set|readonly|override|abstract)\s+)*\*?(?P<name>[A-Za-z_$#][\w$]*)\s*(?:<[^<>(){}]*>)?\((?:[^(){};]|\([^()]*\)|\{[^{}]*\})*\)\s*(?::\s*[^{;=]+)?\{", "method"),
        ],
        [r"(?m)^\s*import\b\s*(?:type\s+)?(?:[\w$*{][^'\";]*?\bfrom\s*)?['\"](?P<target>[^'\"\n]+)['\"]"], exported="export", tests=("test", "it", "describe"), closures=_ARROW,
    ),
    "go": Language(
        [
            (r"(?m)^func\s*\(\s*\w*\s*\*?(?P<owner>\w+)[^)]*\)\s*(?P<name>\w+)\s*(?:\[[^\]]*\])?\(", "method"),
            (r"(?m)^func\s+(?P<name>\w+)\s*(?:\[[^\]]*\])?\(", "function"),
        ]
        + [(rf"(?m)^(?:type\s+|\0\s*)(?P<name>\w+)\s*(?:\[[^\]\n]*\w\s+\w[^\]\n]*\]\s*)?{after}", kind) for after, kind in ((r"struct\b", "struct"), (r"interface\b", "interface"), (r"func\b", "func_type"), (r"map\b", "map"), (r"chan\b", "chan"), (r"=\s*\w", "alias"), (r"(?!struct\b|interface\b|func\b|map\b|chan\b)[\w*\[]", "type"))],
        [r"(?m)^\s*import\s+(?:[\w.]+\s+)?[\"`](?P<target>[^\"`\n]+)[\"`]"], exported="capital", tests=("Test", "Benchmark", "Example"), strings=(_DOUBLE, _SINGLE, r"`[^`]*`"), closures=r"\bfunc\s*\(", scopes="none",
    ),
    "rust": Language(
        [(rf"\b(?P<exp>pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+|extern\s+\"[^\"]*\"\s+)*fn\s+(?P<name>\w+)\s*{_GENERIC}\(", "function"), (rf"(?m)^\s*(?:unsafe\s+)?impl\b\s*{_GENERIC}\s*!?(?:[\w:]+{_GENERIC}\s+for\s+)?&?(?:'\w+\s+)?(?:dyn\s+)?(?:\w+::)*(?P<name>\w+)", "impl")]
        + [(rf"\b(?P<exp>pub(?:\([^)]*\))?\s+)?{k}\s+(?P<name>\w+)", k) for k in ("struct", "enum", "trait", "type")],
        [r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+(?P<target>[\w:]+(?:\{[^;]*\})?)"], strings=(r"\bb?r(?P<h>#*)\".*?\"(?P=h)", r"b?\"(?:[^\"\\]|\\.)*\"", r"'(?:[^'\\\n]|\\[^\n'][^'\n]*|\\')'"), closures=r"(?<![\w)\]|])(?:move\s*)?\|[^|\n;{}]*\|",
    ),
    "java": Language(
        [(rf"(?P<exp>\b(?:public|protected)\s+)?(?:(?:static|final|abstract|private|sealed)\s+)*\b{k}\s+(?P<name>\w+)", k) for k in ("class", "interface", "enum")]
        + [(rf"(?m)(?:^|(?<=[{{}};]))\s*(?:@\w+(?:\([^)]*\))?\s*)*(?P<exp>(?:public|protected)\s+)?(?:(?:private|static|final|abstract|synchronized|native|default|public|protected)\s+)*(?:{_GENERIC}\s*[\w.\[\]]+{_GENERIC}(?:\[\])*\s+)?(?P<name>\w+)\s*\([^;{{}}]*\)\s*(?:throws\s+[\w., ]+)?(?:\{{|;)", "method")],
        [r"(?m)^\s*import\s+(?:static\s+)?(?P<target>[\w.]+)"], tests=("test", "should"), strings=(r"\"{3}.*?\"{3}", _DOUBLE, _SINGLE),
    ),
    "c": Language(
        [(r"\b(?:class)\s+(?P<name>\w+)\s*(?:final\s*)?(?::[^;{]*)?\{", "class"), (r"\bstruct\s+(?P<name>\w+)\s*(?::[^;{]*)?\{", "struct"), (r"(?m)(?:^|(?<=[{};:]))[ \t]*(?:template\s*<[^>]*>\s*)?(?:[\w:<>,*&~\[\]]+[\s*&]+)*(?P<name>~?[A-Za-z_]\w*(?:::~?\w+)*)\s*\([^;{}]*\)\s*(?:const|noexcept|override|final|\s)*(?:->\s*[\w:<>*& ]+)?(?::[^;{}]*)?\{", "function")],
        joiner="::", tests=(), scopes="types", closures=r"(?<![\w)\]])\[[^\[\]\n;]*\]\s*(?:\([^()]*\)\s*)?(?:mutable\s*)?(?:->\s*[\w:<>*& ]+)?(?=\{)",
    ),
    "swift": Language(
        [(r"\bfunc\s+(?P<name>\w+)", "function"), (r"(?<!\.)\b(?P<name>init)\s*[?!]?\s*(?:<[^<>]*>)?\(", "init"), (r"\b(?P<name>deinit)\s*\{", "deinit"), (r"\b(?P<name>subscript)\s*\(", "subscript")]
        + [(rf"(?<!\.)\b{k}\s+(?!func\b|var\b)(?P<name>\w+)", k) for k in ("class", "struct", "enum", "protocol", "extension", "actor")]
        + [(r"\bvar\s+(?P<name>\w+)\s*:\s*[\w<>\[\]?:. ]+\s*\{", "property"), (r"(?m)(?:^|(?<=[{;]))[ \t]*(?:indirect\s+)?case\s+(?P<name>[A-Za-z_]\w*)(?=\s*(?:[(=,\n}]|$))", "enum_case")],
        tests=("test",), strings=(r"\"{3}.*?\"{3}", _DOUBLE), closures=r"\{(?=[^{}\n]*\bin\s*$|[^{}\n]*\bin\b[^{}\n]*\})",
    ),
    "bash": Language([(r"(?m)^\s*(?:function\s+)?(?P<name>[\w-]+)\s*\(\)\s*\{", "function"), (r"(?m)^\s*function\s+(?P<name>[\w-]+)\s*\{", "function")], line_comment="#", tests=("test_", "@test"), strings=(r"\"(?:[^\"\\]|\\.)*\"", r"'[^']*'")),
    "lua": Language([(r"\bfunction\s+(?P<name>[\w.:]+)\s*\(", "function"), (r"(?m)^\s*(?:local\s+)?(?P<name>[\w.]+)\s*=\s*function\s*\(", "function")], line_comment="--", tests=("test_", "it", "describe"), ends=True, strings=(_DOUBLE, _SINGLE, r"\[\[.*?\]\]")),
    "r": Language([(r"(?m)^\s*(?P<name>[\w.]+)\s*(?:<-|<<-|=)\s*function\s*\(", "function")], line_comment="#", exported="dot", tests=(), test_kinds=False, scopes="none"),
}
LANGUAGES["typescript"] = replace(LANGUAGES["javascript"], declarations=LANGUAGES["javascript"].declarations + [(rf"(?P<exp>\bexport\s+(?:declare\s+)?(?:const\s+)?)?\b{w}\s+(?P<name>[\w$]+){_GENERIC}\s*{e}", k) for w, k, e in (("interface", "interface", r"[^{;()]*\{"), ("type", "type_alias", "="), ("enum", "enum", r"\{"))])
LANGUAGES["cpp"] = LANGUAGES["c"]
SCOPES = {"class", "struct", "enum", "interface", "trait", "impl", "protocol", "extension", "actor"}


_TEMPLATE = re.compile(r"`|\\.|\$\{|[{}]|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|//[^\n]*|/\*.*?(?:\*/|\Z)", re.S)


def blank_templates(text: str) -> str:
    """The text with the words of template literals replaced by blanks; the code in their ``${}`` stays."""
    out, stack, last = [], [], 0

    def cover(a: int, b: int, words: bool) -> None:
        out.append(re.sub(r"[^\n]", " ", text[a:b]) if words else text[a:b])

    for m in _TEMPLATE.finditer(text):
        t, words = m.group(0), bool(stack) and stack[-1] == "`"
        if words and t not in ("`", "${"):
            continue
        cover(last, m.start(), words)
        last = m.end()
        # what ends or interrupts the words is blanked too, so that no quote and no bracket of the literal is left
        out.append(" " * len(t) if t in ("`", "${") or (t == "}" and stack[-1:] == ["${"]) else t)
        if t == "`":
            stack.pop() if words else stack.append("`")
        elif t == "${" and words:
            stack.append("${")
        elif t == "{" and stack:
            stack.append("{")
        elif t == "}" and stack:
            stack.pop()
    cover(last, len(text), bool(stack) and stack[-1] == "`")
    return "".join(out)


def blank(text: str, lang: str) -> str:
    """The text with the contents of strings and comments replaced by blanks; lines and places stay."""
    cfg = LANGUAGES[lang]
    if lang in ("javascript", "typescript"):
        text = blank_templates(text)
    mark = cfg.line_comment
    block = r"/\*.*?(?:\*/|\Z)|" if mark == "//" else r"--\[\[.*?(?:\]\]|\Z)|" if mark == "--" else ""
    # in a shell a number sign within a word is no comment
    line = rf"(?<![^\s;]){mark}[^\n]*" if lang == "bash" else rf"{re.escape(mark)}[^\n]*"
    pattern = re.compile(rf"(?P<q>{'|'.join(cfg.strings)})|{block}{line}", re.S)

    def cover(m: re.Match) -> str:
        s = m.group(0)
        inner = re.sub(r"[^\n]", " ", s)
        return s[0] + inner[1:-1] + s[-1] if m.group("q") and len(s) > 1 else inner

    return pattern.sub(cover, text)


def closing(code: str, start: int) -> int:
    """Behind the bracket that closes the one at ``start``; the end where none does."""
    depth = 0
    for m in re.compile(r"[()\[\]{}]").finditer(code, start):
        depth += 1 if m.group(0) in "([{" else -1
        if depth == 0:
            return m.end()
    return len(code)


def expression_end(code: str, start: int) -> int:
    """Where an expression that begins at ``start`` ends: at a comma, semicolon or closing bracket of what is around it, or at a line's end after something."""
    depth = 0
    for m in re.compile(r"[()\[\]{},;\n]").finditer(code, start):
        c = m.group(0)
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth < 0:
                return m.start()
        elif depth == 0 and (c != "\n" or code[start : m.start()].strip()):
            return m.start()
    return len(code)


def closure_spans(code: str, pattern: str | None) -> list[tuple[int, int]]:
    """[from, to) of functions without a name."""
    out = []
    for m in re.finditer(pattern, code) if pattern else ():
        at = m.end()
        if m.group(0).endswith("("):
            at = closing(code, m.end() - 1)
            brace = code.find("{", at)
            at = brace if brace >= 0 and "\n" not in code[at:brace] else at
        elif m.group(0).endswith("{"):
            at = m.end() - 1
        body = re.compile(r"\s*(?:->\s*[\w:<>&]+\s*)?\{").match(code, at)
        out.append((m.start(), closing(code, body.end() - 1) if body else expression_end(code, at)))
    return out


def block_end(code: str, start: int, ends: bool) -> int:
    """Where the body that begins at or after ``start`` ends: its closing brace or ``end``; the line's end where there is none."""
    if ends:
        depth = 0
        for m in re.finditer(r"\b(function|if|for|while|do|repeat|end|until)\b", code[start:]):
            w = m.group(1)
            if w in ("function", "if", "repeat") or w == "do":
                depth += 1
            elif w in ("end", "until"):
                depth -= 1
                if depth <= 0:
                    return start + m.end()
        return len(code)
    depth, opened = 0, False
    for m in re.finditer(r"[{};\n]", code[start:]):
        c = m.group(0)
        if c == "{":
            depth, opened = depth + 1, True
        elif c == "}":
            depth -= 1
            if opened and depth == 0:
                return start + m.end()
            if depth < 0:
                return start + m.start()
        elif c == ";" and not opened:
            return start + m.start()
    return len(code) if opened else (code.find("\n", start) if code.find("\n", start) >= 0 else len(code))


def doc_before(lines: list[str], at: int, mark: str) -> str:
    """The comment that ends on the line before ``at`` (from 0)."""
    i, out = at - 1, []
    while i >= 0 and re.match(r"\s*(?:@|#\[)", lines[i]) and not lines[i].lstrip().startswith(mark + " "):
        i -= 1
    if i >= 0 and lines[i].rstrip().endswith("*/"):
        while i >= 0:
            out.append(lines[i])
            if "/*" in lines[i]:
                break
            i -= 1
    else:
        while i >= 0 and lines[i].lstrip().startswith(mark) and not (i == 0 and lines[0].startswith("#!")):
            out.append(lines[i])
            i -= 1
    return strip_marks("\n".join(reversed(out))) if out else ""


def grouped_types(code: str) -> str:
    """Go code whose grouped type declarations stand as if each had the word ``type`` before it, marked by a null character; places stay."""
    for g in re.finditer(r"(?m)^type\s*(\()", code):
        end, depth, at = closing(code, g.start(1)), 0, g.end()
        for m in re.compile(r"[()\[\]{}]|\n").finditer(code, g.end(), end - 1):
            c = m.group(0)
            depth += (c in "([{") - (c in ")]}")
            if c == "\n" and depth == 0 and re.compile(r"[ \t]+\w").match(code, m.end()):
                at = m.end()
                code = code[:at] + "\0" + code[at + 1 :]
    return code


def import_targets(lang: str, text: str, code: str) -> Iterator[tuple[str, int]]:
    """(target, place) of what a file imports, without keywords, quotes and semicolons."""
    for pattern in LANGUAGES[lang].imports:
        for m in re.finditer(pattern, text):
            # a declaration in a string or comment is blank in the code
            if re.search(r"\b(?:import|use)\b", code[m.start() : m.end()]):
                yield " ".join(m.group("target").split()).rstrip(":"), m.start("target")
    if lang == "go":
        for g in re.finditer(r"(?m)^import\s*(\()", code):
            for m in re.compile(r"[\"`]([^\"`\n]+)[\"`]").finditer(text, g.end(), closing(code, g.start(1))):
                if code[m.start()] in "\"`":
                    yield m.group(1), m.start(1)


#: Words of a shell that begin no command, and those that a command follows.
SHELL_WORDS = KEYWORDS | set("do done fi then esac time declare local export readonly unset coproc select function".split())
BEFORE_COMMANDS = "then do else elif if while until time !".split()


def calls_in(lang: str, code: str) -> Iterator[tuple[str, int]]:
    """(name, place) of calls; in a shell of commands."""
    if lang == "bash":
        before = "|".join(BEFORE_COMMANDS)
        for m in re.finditer(rf"(?m)(?:^|[;&|({{`]|\$\()[ \t]*(?:(?:{before})[ \t]+)*(?:\w+=\S*[ \t]+)*(?P<name>[A-Za-z_@][\w.-]*)(?=[\s;)|&`]|$)(?![ \t]*\(\))", code):
            if m.group("name") not in SHELL_WORDS:
                yield m.group("name"), m.start("name")
        return
    bracket = r"(?:\(|(?<=[!\s])[\[{])" if lang == "rust" else r"\("
    for m in re.finditer(rf"([A-Za-z_$][\w$]*)(\s*!)?\s*(?:(?:::\s*)?<[^();{{}}=&|]*>)?\s*{bracket}", code):
        if m.group(0).endswith("(") or m.group(2):
            yield m.group(1), m.start()


def extract_lexed(path: str, text: str, lang: str) -> Found:
    """Symbols and references of a language in LANGUAGES."""
    cfg, out = LANGUAGES[lang], Found(path)
    code, lines = blank(text, lang), text.split("\n")
    starts = [0] + [m.end() for m in re.finditer("\n", text)]
    line_of = lambda p: bisect.bisect_right(starts, p)
    script = lang in ("javascript", "typescript")
    found: dict[int, tuple] = {}
    marked = grouped_types(code) if lang == "go" else code
    for pattern, kind in cfg.declarations:
        for m in re.finditer(pattern, marked):
            name = m.group("name") or "<anonymous>"
            at = m.start("name") if m.group("name") else m.start()
            if name in KEYWORDS or at in found:
                continue
            groups, begin = m.groupdict(), m.start() + len(m.group(0)) - len(m.group(0).lstrip("\0{};: \t\r\n"))
            if kind == "method" and m.group(0).endswith(";"):
                # a method without a body has a type before its name
                if not re.search(r"[\w>\]]\s+$", code[begin:at]) or re.match(r"(?:return|throw|new|else|package|import)\b", code[begin:at]):
                    continue
                end = m.end()
            elif script and kind == "function" and m.group(0).endswith("=>"):
                brace = re.compile(r"\s*\{").match(code, m.end())
                end = closing(code, brace.end() - 1) if brace else expression_end(code, m.end())
            elif script and kind == "type_alias":
                end = expression_end(code, m.end())
            elif kind == "enum_case":
                end = begin + len(re.compile(r"[^\n;}]*").match(code, begin).group(0).rstrip())
            elif m.group(0).endswith("{"):
                end = closing(code, m.end() - 1)
            elif lang == "go" and kind in ("alias", "map", "chan", "func_type", "type"):
                end = expression_end(code, m.end() - 1)
            else:
                end = block_end(code, m.start() if cfg.ends else at, cfg.ends)
            found[at] = (name, kind, begin, end, groups.get("owner"), bool(groups.get("exp")))
            if kind == "enum_case":
                # the further cases of the same line
                flat = re.sub(r"\([^()]*\)", lambda x: " " * len(x.group(0)), code[begin:end])
                for x in re.finditer(r",\s*(\w+)", flat):
                    found[begin + x.start(1)] = (x.group(1), kind, begin + x.start(1), end, None, False)
    if script:
        named = [(b, e) for _, _, b, e, _, _ in found.values()]
        for a, z in closure_spans(code, cfg.closures):
            if not any(b <= a and z == e and code[b:a].rstrip().endswith(("=", "async")) for b, e in named):
                found[a] = ("<anonymous>", "function", a, z, None, False)
    decls = sorted(((b, e, n, k, o, x) for n, k, b, e, o, x in found.values()), key=lambda t: (t[0], -t[1]))
    names: list[tuple[int, int, str, str, bool]] = []
    for b, e, name, kind, owner, shown in decls:
        parents = [p for p in names if p[0] < b and e <= p[1] and p[3] != "enum_case"]
        scope = [p for p in parents if p[3] in SCOPES] if cfg.scopes == "types" else parents if cfg.scopes == "all" else []
        if kind == "method" and (script or lang == "java") and not (parents and parents[-1][3] in SCOPES):
            continue
        if kind in ("function", "init", "deinit", "subscript"):
            kind = "method" if scope else "function"
        if lang in ("c", "cpp") and "::" in name:
            kind, qualified = "method", name
        elif owner:
            qualified = f"({owner}).{name}"
        elif lang in ("c", "cpp"):
            qualified = f"{scope[-1][2].split('::')[-1]}::{name}" if scope else name
        else:
            qualified = cfg.joiner.join([*([scope[-1][2]] if scope else []), name])
        if script:
            # what an exported class or function holds is exported with it
            shown = shown or bool(parents and parents[-1][4] and parents[-1][3] == "class")
        names.append((b, e, qualified, kind, shown))
        brace = code.find("{", b)
        whole = cfg.ends or kind == "enum_case" or not b <= brace < e
        head = text[b:e].split("\n")[0] if whole else text[b:brace].split("\n\n")[0]
        inside = text[b:e].partition("\n")[2] if whole else text[brace + 1 : e - 1]
        short = name.split(".")[-1].split("::")[-1]
        exported = {"underscore": shown or not short.startswith("_"), "dot": not name.startswith("."), "capital": short[:1].isupper(), "export": shown}[cfg.exported]
        test = cfg.test_kinds and kind in ("function", "method") and bool(cfg.tests) and short.startswith(cfg.tests)
        if script:
            test = test or "spec" in path.lower()
        if lang == "swift" and kind in SCOPES:
            test = "Test" in name
        out.symbol(name, qualified, kind, line_of(b), line_of(max(b, e - 1)), re.sub(r"^(?:public|private|protected)\s*:\s*", "", " ".join(head.split())).rstrip("{;").strip(), "" if code[starts[line_of(b) - 1] : b].strip() else doc_before(lines, line_of(b) - 1, cfg.line_comment), preview(inside.split("\n")), exported, test)
        if scope:
            out.edge(scope[-1][2], f"{path}::{qualified}", "CONTAINS", line_of(b), CONTAINS_CONFIDENCE)
    callable_ = [n for n in names if n[3] not in SCOPES]
    spans = [(at, at + len(v[0])) for at, v in found.items() if v[0] != "<anonymous>"]
    closures = [] if script else closure_spans(code, cfg.closures)
    for w, at in calls_in(lang, code):
        if len(w) < 2 or w in SKIP_CALLS or w in KEYWORDS or any(a <= at < z for a, z in spans):
            continue
        inner = [n for n in callable_ if n[0] < at < n[1]]
        if inner and not any(inner[-1][0] < a <= at < z for a, z in closures):
            out.edge(inner[-1][2], w, "CALLS", line_of(at), CALL_CONFIDENCE)
    for target, at in import_targets(lang, text, code):
        out.edge("__module__", target, "IMPORTS", line_of(at), IMPORT_CONFIDENCE)
    return out


def extract_markdown(path: str, text: str) -> Found:
    """ATX headings as heading1 to heading6, named chunks of fenced code as chunk; headings within fences are code."""
    out, fence = Found(path), None
    for i, line in enumerate(text.replace("\r\n", "\n").split("\n"), 1):
        m = re.match(r"^\s{0,3}(```+|~~~+)\s*(?:\{\s*(\w+)(?:[\s,]+([\w.-]+))?[^}]*\})?", line)
        if m:
            if fence is None:
                fence = m.group(1)[0]
                if m.group(2) and m.group(3):
                    out.symbol(m.group(3), f"{m.group(2)}_{m.group(3)}", "chunk", i, i, line.strip(), exported=False)
            elif m.group(1)[0] == fence:
                fence = None
            continue
        h = re.match(r"^(#{1,6})\s+(.*?)\s*#*\s*$", line)
        if fence is None and h and h.group(2):
            slug = re.sub(r"[^A-Za-z0-9_\s]", "", h.group(2)).strip()[:60].replace(" ", "_")
            out.symbol(h.group(2), slug, f"heading{len(h.group(1))}", i, i, line.strip(), exported=False)
    return out


def extract_file(path: str, lang: str, text: str) -> Found:
    """Symbols and references of a file; ValueError for a language that can't be read."""
    if lang == "python":
        return extract_python(path, text)
    if lang in ("markdown", "rmd", "qmd"):
        return extract_markdown(path, text)
    if lang in LANGUAGES:
        return extract_lexed(path, text, lang)
    raise ValueError(f"no extractor for {lang}")


def extract_symbols(files: DataFrame) -> DataFrame:
    """file_path, lang, symbols, edges, error for every row of file_path, lang, content. A file that can't be read has an error and no symbols; null content is an empty file."""

    def run(parts):
        for p in parts:
            rows = []
            for path, lang, text in zip(p["file_path"], p["lang"], p["content"]):
                try:
                    f, error = extract_file(path, lang, text or ""), None
                except (ValueError, SyntaxError, RecursionError) as x:
                    f, error = Found(path), str(x)[:200]
                rows.append((path, lang, f.symbols, f.edges, error))
            yield pd.DataFrame(rows, columns=["file_path", "lang", "symbols", "edges", "error"])

    return spread(files.select("file_path", "lang", "content"), "file_path").mapInPandas(run, FILE_SYMBOLS)


def symbol_rows(extracted: DataFrame, repo_alias: str = "primary") -> DataFrame:
    """Nodes: one row per FQN (of repeated ones the first by line), with a stable id from repository and FQN."""
    s = extracted.select(F.inline("symbols")).withColumn("repo_alias", F.lit(repo_alias)).withColumn("id", F.xxhash64("repo_alias", "fqn"))
    from sextant.operators.graph import first_of

    return first_of(s, "fqn", 1, "start_line", "end_line")


def reference_rows(extracted: DataFrame) -> DataFrame:
    """References as written: source_fqn, target, type, call_site_line, confidence."""
    return extracted.select(F.inline("edges"))
