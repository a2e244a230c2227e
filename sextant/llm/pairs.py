"""Functions paired with their documentation.

One recursive pattern takes a function apart: its signature line, the comment or string literal at its head, and its body
with balanced brackets, in which strings and comments are protected. Documentation that says nothing beyond the signature is dropped.
"""

from __future__ import annotations

import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PLAIN = r"""[^()\[\]{}"'`/\#<\-]"""
_INSIDE = rf"(?: {_PLAIN}++ | (?&item) )*+"
#: One element of a body: a bracket without inner ones, a bracket that recurses, a string or comment that is stepped over, any other character.
_ITEM = rf"""
    \( {_PLAIN}*+ \) | \[ {_PLAIN}*+ \] | \( {_INSIDE} \)? | \[ {_INSIDE} \]? | \{{ {_INSIDE} \}}?
  | (?= ["'`A-Za-z] ) (?&string) | (?= [/<\-\#] ) (?: (?&blocked) | (?&lined) ) | [^()\[\]{{}}]
"""
#: Signature, documentation and body in one match. The body recurses through brackets and steps over strings and comments, so
#: that a bracket within them doesn't count. A form left open, as in a body cut short, runs to the end.
SOURCE = rf"""
(?(DEFINE)
  (?<triple> \"{{3}} (?: [^\\"] | \\. | "(?!"") )*+ (?: \"{{3}} | \\?\Z ) | '{{3}} (?: [^\\'] | \\. | '(?!'') )*+ (?: '{{3}} | \\?\Z ) )
  (?<quoted> " (?: [^"\\\n] | \\. )*+ " | ' (?: [^'\\\n] | \\. )*+ ' | ` (?: [^`\\] | \\. )*+ ` )
  (?<string> (?: \b[A-Za-z]{{1,2}} )? (?: (?&triple) | (?&quoted) ) )
  (?<blocked> /\* (?: [^*] | \*(?!/) )*+ (?: \*/ | \Z ) | <!-- (?: [^-] | -(?!->) )*+ (?: --> | \Z ) | --\[\[ (?: [^\]] | \](?!\]) )*+ (?: \]\] | \Z ) )
  (?<mark> // | \# | -- )
  (?<lined> (?&mark) [^\n]*+ (?: \n [^\S\n]*+ (?&mark) [^\n]*+ )*+ )
  (?<item> {_ITEM} )
)
\A (?<signature> [^\n]*+ ) \n
\s*+ (?<doc> (?&blocked) | (?&lined) | (?&string) (?= [^\S\n]*+ ;? [^\S\n]*+ (?: \n | \Z ) ) )?+
\s*+ (?<body> (?: {_PLAIN}++ | {_ITEM} | [)\]}}] )*+ ) \Z
"""
#: Only the documentation, at the beginning of a body.
HEAD = SOURCE.partition("\\A")[0] + r"""\s*+ (?<doc> (?&blocked) | (?&lined) | (?&string) (?= [^\S\n]*+ ;? [^\S\n]*+ (?: \n | \Z ) ) ) \s*+"""
_compiled: dict = {}


def take_apart(signature: str | None, body: str | None) -> tuple[str, str, str]:
    """(signature, documentation, body) of a function; the documentation is the comment or string at the very start of ``body``, or empty."""
    p = _compiled.setdefault("source", regex.compile(SOURCE, regex.X | regex.S))
    sig = " ".join((signature or "").split())
    m = p.match(sig + "\n" + (body or ""))
    if m is None:
        # what the pattern can't take apart has its documentation at its head all the same
        h = _compiled.setdefault("head", regex.compile(HEAD, regex.X | regex.S)).match(body or "")
        return (sig, h.group("doc"), body[h.end() :]) if h else (sig, "", body or "")
    return sig, m.group("doc") or "", m.group("body")


# Wording that says nothing about a function.
PLACEHOLDER = r"(?:todo|fixme|xxx|tbd|tba|wip|hack|n/?a|none|placeholder|stub|dummy|foo|bar|test|docs?|\.{2,}|…)"
#: What a remark on origin names: numbers, paths, addresses, capitalised names, teams.
NAMED = r"(?:(?:the )?(?:\w+ )?(?:team|authors?|maintainers?|upstream)\b|[\w-]*[\d@_][\w./@:#-]*|[\w-]+[./:#][\w./@:#-]+|(?-i:[A-Z])[\w'-]*)"
NAMED = rf"{NAMED}(?:\W+(?:(?:in|by|on|at|and|of|from|since|version|release)\W+)?{NAMED})*"
EMPTY_TALK = [
    rf"{PLACEHOLDER}(?:\W+(?:write|add|fill|tidy|clean|fix|document|docs?|documentation|description|comments?|it|this|me|in|up|later|out|here|the|to|follow|needed|missing|{PLACEHOLDER}))*",
    r"(?:no|missing|empty|add|insert|write|put)?\W*(?:a |the |your )?(?:description|documentation|docs?|docstring|comment|summary|text)(?:\W+(?:goes|go|comes?|is|are|to|be|will|follow|follows|added|provided|available|written|missing|pending|needed|here|later|soon|yet|not))*",
    r"(?:to be|not yet) (?:done|written|documented|defined|added|implemented)",
    r"not (?:yet )?(?:documented|implemented|written)(?: yet)?",
    r"undocumented",
    r"lorem ipsum.*",
    r"(?:do not|don't) (?:edit|modify|touch)(?: (?:this|the|by|file|manually|hand|it))*",
    r"created (?:from (?:the |a )?(?:\w+ )?template|by [\w. ]{1,30}|(?:on|at) \d[\w./: -]*|with [\w. ]{1,20})",
    r"(?:see|cf\.?|compare|refer to|same as|like|as|as in|as for|ditto|identical to|voir|siehe|ver|véase|vgl\.?)(?: (?:also|the|in|to|at|a|an))*\W+(?:above|below|super|base|parent|overridden|overriden|interface|superclass|base class|parent class|super class|documentation|docs?|readme|wiki|caller|header|before|oben|unten|ci-dessus|plus haut|arriba|#?[\w.:/#()-]+)(?: (?:class|method|function|implementation|interface|version|documentation|docs?|above|below|for details|for more|details))*",
    r"(?:inherited|inherits?|inheritdoc|overrides?|overridden|implements)(?: (?:from|the|by|in|docs?|documentation|parent|base|super|class|method|interface))*(?: [\w.]+)?",
    r"ditto",
    r"all rights (?:kept|reserved)",
    rf"(?:added|introduced|changed|new|available|written|moved|ported|copied|taken|adapted) (?:in|since|from|by|on|at)(?: (?:version|release|v|change|commit|revision|build|patch|ticket|issue))? ?{NAMED}",
    r"v?\d+(?:\.\d+)+",
    r"(?:end)?region(?: [\w-]+){0,3}",
    r"\{@\w+[^}]*\}",
    r"(?:for )?(?:internal|private)(?: use)?(?: only)?",
    r"(?:deprecated|obsolete|legacy|unused|not used|self[- ]explanatory|obvious|magic)",
]
#: Remarks with an open end. They are looked for in lines and sentences only, since what follows them may say something.
REMARKS = [
    r"(?:auto|automatically)[- ]?generated\b.*",
    r"generated (?:code|by|from|file|automatically|method|stub)\b.*",
    r"(?:copyright|\(c\)|©|license[ds]?|licen[cs]ed under|spdx|all rights)\b.*",
    rf"(?:author|authors|maintainer|owner|contact|since|version|date|created|modified|last modified|revision|deprecated since|added in|introduced in|new in|ported from|copied from|taken from|adapted from|moved from|origin)(?:(?:\s*[:=]|\s+[-–]+\s).{{0,60}}|\W+(?:(?:by|in|on|at|version|release|v|change|commit|revision|build|patch|ticket|issue)\W+)*{NAMED})",
    r"(?:no ?qa|no ?lint|nosec|nosonar|noinspection|eslint|tslint|jshint|jslint|pylint|flake8|mypy|pyright|isort|yapf|ruff|rubocop|clippy|rustfmt|swiftlint|luacheck|prettier|stylelint|istanbul|codecov|checkstyle|findbugs|ts-ignore|ts-nocheck|ts-expect-error|ts-check|go:\w+|use strict)\b.{0,80}",
    r"(?:pragma\b|type: ?ignore|fmt: ?(?:off|on|skip)|black: |coverage: |c8 ignore|(?:allow|deny|cfg|warn|inline|suppresswarnings)\().{0,80}",
    r"@(?:ts-\w+|see|inheritdoc|override|overrides|generated|author|since|version|deprecated|internal|private|public|protected|static|hidden|ignore|api|test|suppress\w*|format|nolint|copyright|license|date|package|file)\b.*",
    r"#!.*",
    r"-\*-.*-\*-",
    r"(?:vim|ex):.*",
]
#: Words that carry nothing beside a name, its parameters and its types.
HOLLOW = set(
    """a an the this that these it its is are was be been to of for and or with in by on as at from into
    function functions method methods func fn def procedure routine member operation call calls called helper utility implementation implements
    used uses use does do performs perform executes execute handles handle takes take taking accepts accept receives receive expects given gets get sets set
    parameter parameters param params argument arguments arg args input inputs output outputs return returns returned returning result yields
    type types kind object instance class self cls name named names value values async static public private protected internal
    none null nil void bool boolean int integer float double str string list dict tuple any number array map optional error true false
    wrapper getter setter accessor mutator constructor destructor ctor dtor""".split()
)
#: The same in other languages: articles, prepositions, the words for function, parameter, value and result, and those for getting, setting, calling and returning.
HOLLOW |= set(
    """der die das den dem des ein eine einen einem eines ist sind wird werden und oder für von vom mit zum zur im aus ab auf an diese dieser dieses funktion methode ruft holt gibt liefert setzt ermittelt zurück
    wert werte wertes parameter rückgabe rückgabewert ergebnis
    le la les un une des du de est sont et ou pour par avec dans au aux ce cet cette fonction méthode retourne renvoie obtient récupère définit appelle valeur valeurs paramètre paramètres résultat retour
    el los las una unos es son y o para por con en al del este esta función método devuelve obtiene retorna establece llama valor valores parámetro parámetros resultado
    il lo gli uno di è sono e per con nel questa questo funzione metodo restituisce ottiene imposta chiama valore valori parametro parametri risultato
    os um uma do da dos das são ou com em esta este função método retorna obtém define chama resultado""".split()
)
#: The same in scripts without blanks, longest first; a run of such letters says nothing if nothing else is in it.
HOLLOW_RUNS = re.compile("|".join("返回值 戻り値 返り値 メソッド パラメータ 関数 函数 方法 参数 引数 返回 返す 获取 取得 设置 設定 调用 结果 結果 该 此 的 值 値 を の は が に です する 함수 메서드 반환 값 을 를".split()))
_WHOLE, _TALK = (re.compile(r"\W*(?:" + "|".join(f"(?:{x})" for x in rules) + r")\W*", re.I | re.S) for rules in (EMPTY_TALK, EMPTY_TALK + REMARKS))
_REMARK = re.compile(r"\W*(?:" + "|".join(f"(?:{x})" for x in REMARKS) + ")", re.I)
_LISTED = re.compile(r"\b(?:takes|accepts|receives|with(?: the)? (?:parameters?|arguments?|args|params)|parameters?|arguments?|args|params)\b:?\s+((?:(?:the\s+)?[`'\"]?\w+[`'\"]?(?:\s*,\s*(?:and\s+)?|\s+and\s+|\s*&\s*)?)+)[.\s]*$", re.I)
_FIELD = re.compile(r"^(?:[:@\\](?:param|parameter|arg|argument|type|tparam|keyword|kwarg|raises?|throws?|exception|var)\b(?:\[\w+\])?\s*(?:\{[^}]*\}\s*)?(?P<a>\[?[\w.*]+\]?)\s*:?|[:@\\](?:returns?|rtype|yields?|ytype)\b\s*(?:\{[^}]*\}\s*)?:?|[-*]?\s*[`*]*(?P<b>\w+)[`*]*\s*(?:\([^)]*\)\s*)?(?::|--?|–)\s)\s*(?P<text>.*)$", re.I | re.S)
_SECTION = re.compile(r"^(?:#+\s*)?(?:args|arguments|parameters|params|returns?|raises|yields|throws|examples?|notes?|attributes|inputs?|outputs?)\s*:?$|^-{3,}$", re.I)
_CODE = [
    re.compile(r"^(?:[\w.\[\]]+(?:\s*,\s*[\w.\[\]]+)*\s*(?:[-+*/|&%^]|<<|>>|//|\*\*)?=(?!=)\s*\S.*)$"),
    re.compile(r"^(?:await\s+|return\s+|yield\s+|raise\s+|throw\s+|new\s+|del\s+|const\s+|let\s+|var\s+)?[\w.:>\-]*\w\s?\((?:[^()]|\([^()]*\))*\)(?:\s*(?:->|:|=>)\s*[\w\[\], .<>&:]+)?\s*[;:{]?$"),
    re.compile(r"^(?:return|yield|raise|throw|await|break|continue|pass|import|from|package|goto|del)\b(?:\s+[\w.\[\]()'\"]+(?:\s*[-+*/.,<>=&|!%]+\s*[\w.\[\]()'\"]+)*)?\s*;?$"),
    re.compile(r"^(?:if|elif|while|for|else|try|except|finally|with|switch|case|catch|do|match|unless|until)\b.*(?:[:{}]|\)\s*[\w.]+.*|\bthen)\s*(?:[\w.]+\(.*\)|return.*|pass|break|continue|[\w.]+\s*[-+]?=.*)?;?\s*\}?$"),
    re.compile(r"^(?:(?:pub|public|private|protected|static|async|export|default|final|local|abstract|override)\s+)*(?:def|fn|func|function|class|struct|enum|impl|trait|interface|let|const|var|val)\s+\w+.*[({:=;].*$"),
    re.compile(r"^[^\s].*;$"),
    re.compile(r"^[{}()\[\];,]+$"),
]
_OPEN = re.compile(r"^[ \t]*(?:/\*[*!]*|<!--+|--\[=*\[|///?!?|//!|--+|#+!?|;+|%+|\*(?!/)|\{-)[ \t]?")
_CLOSE = re.compile(r"[ \t]*(?:\*+/|--+>|\]=*\]|-\})[ \t]*$")
_QUOTE = re.compile(r"^\s*[A-Za-z]{0,2}(\"{3}|'{3}|[\"'`])|(\"{3}|'{3}|[\"'`])\s*;?\s*$")
_HTML = re.compile(r"</?(?:p|br|b|i|em|strong|code|pre|ul|ol|li|tt|div|span|h\d|summary|remarks|para|returns|param|a|see)\b[^<>]*>", re.I)
_PARTS = regex.compile(r"[\p{Lu}\p{Lt}]+(?!\p{Ll})|[\p{Lu}\p{Lt}]?[\p{Ll}\p{M}]+|[\p{Lo}\p{Lm}\p{M}]+|\d+")


def description(doc: str | None) -> str:
    """Documentation without comment marks, quotes and markup; lines keep their order, blank lines at the ends go."""
    text = (doc or "").replace("\r\n", "\n").replace("\r", "\n").strip()
    m = re.match(r"^([A-Za-z]{0,2})(\"{3}|'{3})(.*?)(?:\2\s*;?\s*)?$", text, re.S) or re.match(r"^([A-Za-z]{0,2})([\"'`])([^\n]*)\2\s*;?$", text, re.S)
    if m:
        text = m.group(3)
    out = []
    for line in text.split("\n"):
        before = None
        while line != before:
            before, line = line, _CLOSE.sub("", _OPEN.sub("", line))
        out.append(_HTML.sub("", line).rstrip())
    return "\n".join(out).strip().strip("\"'`").strip()


def stems(word: str) -> set[str]:
    """A word and what it may be an inflection of."""
    w = word.lower()
    out = {w}
    for end, back in (("s", ""), ("es", ""), ("ies", "y"), ("ed", ""), ("d", ""), ("ied", "y"), ("ing", ""), ("ing", "e"), ("er", ""), ("er", "e")):
        if w.endswith(end) and len(w) - len(end) >= 3:
            out.add(w[: -len(end)] + back)
    for x in list(out):
        if len(x) > 3 and x[-1] == x[-2]:
            out.add(x[:-1])
    return out


def parts(text: str) -> list[str]:
    return [x.lower() for x in _PARTS.findall(text)]


def _is_code(line: str) -> bool:
    return any(p.match(line) for p in _CODE)


def _unwrapped(text: str) -> list[str]:
    """The lines; one that goes on in small letters where a remark broke off without an end is put together with it."""
    out: list[str] = []
    for line in map(str.strip, text.split("\n")):
        if out and line[:1].islower() and out[-1][-1:] not in ".!?:;" and _REMARK.match(out[-1]):
            out[-1] += " " + line
        else:
            out.append(line)
    return out


def _says(unit: str, known: set[str]) -> bool:
    """Whether a line or sentence says something beyond the known words."""
    unit = unit.strip()
    if not re.search(r"[^\W\d_]", unit) or _SECTION.match(unit):
        return False
    if _TALK.fullmatch(unit) or _is_code(unit):
        return False
    m = _LISTED.search(unit)
    if m:
        unit = unit[: m.start()]
    return any(w not in HOLLOW and not stems(w) & known and HOLLOW_RUNS.sub("", w) for w in parts(unit) if not w.isdigit())


def says_something(doc: str | None, name: str | None, signature: str | None) -> bool:
    """Whether documentation says anything beyond a function's name, parameters and types.

    Trivial are placeholders, the signature said again, mere pointers, remarks for tools or on origin and version, and
    code. A placeholder followed by real text is not.
    """
    text = description(doc)
    known = set().union(*(stems(w) for w in parts(f"{name or ''} {signature or ''}"))) if (name or signature) else set()
    whole = " ".join(text.split())
    if not re.search(r"[^\W\d_]", whole) or _WHOLE.fullmatch(whole):
        return False
    for line in _unwrapped(text):
        if not line or _SECTION.match(line) or _is_code(line):
            continue
        m = _FIELD.match(line)
        if m and not _TALK.fullmatch(line):
            own = known.union(*(stems(w) for w in parts(m.group("a") or m.group("b") or "")))
            line, now = m.group("text"), own
        else:
            now = known
        if any(_says(s, now) for s in re.split(r"(?<=[.!?])\s+", line)):
            return True
    return False


def function_pairs(nodes: DataFrame, kinds: tuple = ("function", "method")) -> DataFrame:
    """node_id, code, description: functions and methods whose documentation says something.

    Kinds are compared without letter case. The documentation is the docstring or, where that is null or blank, the comment or string literal at the
    very start of body_preview. A node whose signature and body_preview are both null or blank is left out, as are null ids. ``code`` is the signature and
    the body without that comment. Repeated rows come out once each; extra columns are ignored. One pass over the rows, nothing is shuffled.
    """
    d = nodes.where(F.col("id").isNotNull() & F.lower(F.trim("kind")).isin(*kinds)).select(F.col("id").cast("long").alias("id"), "name", "signature", "docstring", "body_preview")

    def run(batches):
        for b in batches:
            ids, code, text = [], [], []
            for k, name, sig, doc, body in zip(*(b.column(i).to_pylist() for i in range(5))):
                if not (sig and sig.strip()) and not (body and body.strip()):
                    continue
                s, head, rest = take_apart(sig, body)
                used = doc if doc and doc.strip() else head
                if used and says_something(used, name, sig):
                    ids.append(k), code.append(f"{s}\n{rest}".strip()), text.append(description(used))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(code, pa.string()), pa.array(text, pa.string())], names=["node_id", "code", "description"])

    return d.mapInArrow(run, "node_id long, code string, description string")
