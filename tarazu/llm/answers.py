"""What problems 4 and 6 share: sentences of an answer and answers without content."""

from __future__ import annotations

import re

import regex

from tarazu.llm.normal import consistent

# Headings and placeholders that are no answer by themselves.
HEADINGS = ("answer", "ans", "response", "reply", "output", "result", "solution", "assistant", "jawab", "jawaab", "javab", "hal", "natija", "جواب", "حل", "نتیجہ", "الجواب", "الإجابة", "پاسخ", "उत्तर", "जवाब")
PLACEHOLDERS = ("n/a", "na", "n.a", "none", "null", "nil", "nan", "tbd", "todo", "undefined", "empty", "blank", "no answer", "no output", "no response", "placeholder", "khali", "خالی")

_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_MARK = re.compile(r"<\|[a-z_]*\|>")
_ENDS = re.compile(r"(?<=[.۔?!؟।…])[\"”»')\]]*\s+|\n+")
_ITEM = re.compile(r"^\s*(?:[-*•#>]+|\d+[.)])\s*")
_LETTER = re.compile(r"[^\W\d_]")
#: One line that announces what doesn't follow.
_HEADING = regex.compile(r"\W*#{1,6} ?\p{L}[^.۔?!؟।]{0,60}|\W*\p{L}[\p{L}\p{M}]*(?: [\p{L}\p{M}]+){0,3} ?[:：]\W*")
_NOTHING = regex.compile(rf"(?:\b(?:{'|'.join(map(regex.escape, HEADINGS))})\b\s*[:：۔.-]*|{'|'.join(rf'(?<!\w){regex.escape(p)}(?!\w)' for p in PLACEHOLDERS)}|[^\p{{L}}\p{{N}}])*+", regex.I)


def without_code(text: str) -> str:
    return _FENCE.sub("\n", text) if "```" in text else text


def lines(text: str) -> str:
    """The consistent form of each line of a text."""
    return "\n".join(map(consistent, text.split("\n")))


def sentences(text: str, ready: bool = False) -> list[str]:
    """The sentences, lines and list items of a text without its code and marks.
    Lines are kept apart, so this takes raw text, or with `ready` what `lines` made of
    it; each sentence is in the consistent form."""
    out = []
    text = without_code(text)
    for s in _ENDS.split((_MARK.sub("\n", text) if "<|" in text else text)):
        s = _ITEM.sub("", s.strip() if ready else consistent(s))
        if s and _LETTER.search(s):
            out.append(s)
    return out


#: Words that alone are no answer.
_EMPTY_WORDS = {*HEADINGS, *(p for p in PLACEHOLDERS if " " not in p)}


def is_empty_answer(text: str | None) -> bool:
    """Null, blank, or nothing but placeholders, marks and headings, however often."""
    if text is None:
        return True
    if regex.search(r"[\p{L}\p{N}]", text) is None:
        return True
    if len(text) > 200:  # a first word that is no placeholder or heading decides without the pattern
        first = regex.search(r"[\p{L}\p{M}\p{N}/.]{2,}", _MARK.sub("", text))
        if first and first[0].strip("/.").lower() not in _EMPTY_WORDS and first[0].lower() not in ("no", "n/a", "n.a"):
            return False
    flat = _MARK.sub("", consistent(text))
    return _NOTHING.fullmatch(flat) is not None or ("\n" not in text.strip() and _HEADING.fullmatch(flat) is not None)
