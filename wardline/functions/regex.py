"""Python-flavoured patterns on the JVM.

Rule catalogs are written in Python regex syntax. Java reads the shorthand
classes differently (ASCII-only ``\\s`` and ``\\w``, combining marks inside ``\\b``),
so the few shorthands are spelled out before a pattern reaches ``rlike``.
"""

from __future__ import annotations

import re

WORD = r"[\w\p{L}\p{N}]"
WHITESPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WORD_START = f"(?<!{WORD})"
WORD_END = f"(?!{WORD})"
WORD_EDGE = f"(?:(?<={WORD}){WORD_END}|{WORD_START}(?={WORD}))"

_SHORTHANDS = {"s": WHITESPACE, "w": WORD, "d": r"\p{Nd}"}
_LEADING_WORD = re.compile(r"[A-Za-z0-9_](?![?*{])")
_TRAILING_WORD = re.compile(r"(?<!\\)[A-Za-z0-9_]([A-Za-z0-9_]\?)?$")


def _alternatives(body: str) -> list[str]:
    """Split a group body at its top-level bars."""
    parts, depth = [""], 0
    for token in re.findall(r"\\.|.", body, re.DOTALL):
        depth += (token == "(") - (token == ")")
        if token == "|" and depth == 0:
            parts.append("")
        else:
            parts[-1] += token
    return parts


def _group_end(text: str) -> int:
    """Position of the bracket that closes the group ``text`` starts with."""
    depth = 0
    for m in re.finditer(r"\\.|[()]", text, re.DOTALL):
        depth += (m.group() == "(") - (m.group() == ")")
        if depth == 0 and m.group() == ")":
            return m.start()
    return -1


def _starts_in_word(text: str) -> bool:
    if not text.startswith("("):
        return bool(_LEADING_WORD.match(text))
    end = _group_end(text)
    body = re.sub(r"^\?:", "", text[1:end])
    plain = end > 0 and not body.startswith("?") and not re.match(r"[?*{]", text[end + 1 :])
    return plain and all(_starts_in_word(part) for part in _alternatives(body))


def _ends_in_word(text: str) -> bool:
    if not text.endswith(")"):
        return bool(_TRAILING_WORD.search(text))
    for m in re.finditer(r"(?<!\\)\(", text):
        if m.start() + _group_end(text[m.start() :]) == len(text) - 1:
            body = re.sub(r"^\?:", "", text[m.start() + 1 : -1])
            return not body.startswith("?") and all(_ends_in_word(p) for p in _alternatives(body))
    return False


def _word_edge(before: str, after: str) -> str:
    """The boundary between two pieces of a pattern; half of it when the other half is sure."""
    if _starts_in_word(after):
        return WORD_START
    if _ends_in_word(before):
        return WORD_END
    return WORD_EDGE


def jvm_pattern(pattern: str, *, ignore_case: bool = True, dotall: bool = False) -> str:
    """The Java spelling of a Python pattern (``\\b`` inside a character class is not supported)."""
    flags = "ud" + ("i" if ignore_case else "") + ("s" if dotall else "")

    def spell_out(m: re.Match) -> str:
        if m.group(1) == "b":
            return _word_edge(pattern[: m.start()], pattern[m.end() :])
        return _SHORTHANDS.get(m.group(1), m.group(0))

    return f"(?{flags})" + re.sub(r"\\(.)", spell_out, pattern, flags=re.DOTALL)
