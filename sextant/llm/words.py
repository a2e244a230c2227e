"""The words a reader sees, whatever the form of the text.

Case, white space, line breaks with comment marks or line numbers, hyphenation, markup, entities, invisible
characters, accents and look-alike letters don't matter; other words do.
"""

from __future__ import annotations

import html
import re
import unicodedata

#: Letters of other scripts that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "օ": "o", "ս": "u", "հ": "h", "ո": "n",
}
#: Tags inside a word or sentence, which leave no gap.
INLINE = "a|abbr|b|bdi|cite|code|del|dfn|em|font|i|ins|kbd|mark|q|s|samp|small|span|strong|sub|sup|tt|u|var|wbr"

_FOLD = str.maketrans(LOOK_ALIKES)
_INLINE = re.compile(rf"</?(?:{INLINE})(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
_ENTITY = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z]\w*);")
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_SOFT_END = re.compile(r"\u00ad(?=[ \t]*[\r\n])")
_LINE = re.compile(r"^[ \t]*(?:\d+[ \t]*[:|][ \t]?)?(?:[ \t]*(?:///?|//!|--+|#+|\*+|>+|\||%+|;+|[-+•·‣]))*(?=[ \t]|\w|$)", re.M)
_HYPHEN = re.compile(r"[-‐‑][ \t]*(?:\r\n?|\n)[ \t]*")
_WORD = re.compile(r"[^\W_]+(?:(?:[-‐‑_'’`]|\*\*?|__|~~)[^\W_]+)*")
_MARKS = re.compile(r"[^\w]|_")
#: Characters of the first plane that combine with the one before, such as accents.
_COMBINING = re.compile("[" + "".join(c for c in map(chr, range(0x300, 0xFFFF)) if unicodedata.combining(c)) + "]")
_LOOKS = re.compile("[" + "".join(LOOK_ALIKES) + "]")


def _unbroken(m: re.Match) -> str:
    """Nothing for a hyphen between two word characters at a line's end, itself otherwise."""
    t, a, b = m.string, m.start(), m.end()
    inside = a > 0 and b < len(t) and (t[a - 1].isalnum() or t[a - 1] == "_") and (t[b].isalnum() or t[b] == "_")
    return "" if inside else m.group(0)


def words(text: str | None) -> list[str]:
    """The words of a text in order; an empty list for null. A hyphenated or underscored word is one word without the marks."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m.group(0)), text)
    if not text.isascii():
        text = _INVISIBLE.sub("", _SOFT_END.sub("-", text))
        text = _COMBINING.sub("", unicodedata.normalize("NFKD", text)).casefold()
        if _LOOKS.search(text):
            text = text.translate(_FOLD)
    else:
        text = text.lower()
    if "\\" in text:
        text = text.replace("\\n", "\n").replace("\\", "")
    text = _HYPHEN.sub(_unbroken, _LINE.sub("", text))
    return [w if w.isalnum() else _MARKS.sub("", w) for w in _WORD.findall(text)]


#: Every ASCII character that is no letter or digit becomes a blank.
_BLANKS = {c: " " for c in range(128) if not chr(c).isalnum()}


def plain_words(text: str | None) -> set[str]:
    """The distinct words of a text as it is spelled, with none of the reading of other forms: a small fraction of the cost of ``words``, for statistics that only guide a search."""
    return set(text.translate(_BLANKS).lower().split()) if text else set()
