"""Text functions on columns.

Everything stays in JVM expressions. Full case folding and accent removal, which Spark SQL lacks, work character by
character, so tables built from the Unicode database serve them there. Only accent removal sends texts with rare
characters, which become several ones or depend on their neighbours, to an Arrow-batched pandas UDF.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F, types as T

from .regex import WHITESPACE

# Ship the UDF's body by value: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The code points Python treats as whitespace.
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The spellings a CSV reader takes for a missing value.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)


def na_to_null(text: Column) -> Column:
    return F.when(~text.isin(*NA_TOKENS), text)


def strip(text: Column) -> Column:
    """Drop leading and trailing Unicode whitespace."""
    return F.btrim(text, F.lit(WHITESPACE_CHARS))


def squash(text: Column) -> Column:
    """Collapse every whitespace run to one space.

    A single space is left alone: only a space with more behind it and a run that starts otherwise are matched.
    """
    may_be_space = r"(?=[^!-~\xa1-\u167f])"  # what most characters fail without a test of the whole class
    return F.regexp_replace(text, f"{may_be_space}(?: {may_be_space}{WHITESPACE}+|(?! ){WHITESPACE}+)", " ")


def _drop_marks(text: str) -> str:
    """The text in lower case without combining marks after compatibility decomposition."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


_FOLDED_POINTS = 0x30000  # beyond this code point no character is changed by folding
_SYLLABLES = range(0xAC00, 0xD7A4)  # of Hangul; they fall apart into two or three characters
_CAPITAL_SIGMA = "\u03a3"  # its lower case depends on the letters around it


@dataclass(frozen=True)
class _Folding:
    """What a function of single characters does to a text, as JVM expressions.

    ``source`` and ``target`` are the arguments of ``translate`` for characters that become one character or none,
    ``several`` the common ones that become several, ``rare`` a pattern of all others that change, ``spelled`` what those
    become that do not depend on their neighbours.
    """

    source: str
    target: str
    several: tuple[tuple[str, str], ...]
    rare: str
    spelled: tuple[tuple[str, str], ...]

    def apply(self, text: Column) -> Column:
        text = F.translate(text, self.source, self.target)
        for char, spelled in self.several:
            text = F.replace(text, F.lit(char), F.lit(spelled))
        return text

    def holds_rare(self, raw: Column) -> Column:
        """Whether the text has rare characters; a range, which is found much faster, tells for most texts."""
        first, last = (ord(f(c for c, _ in self.spelled)) for f in (min, max))
        return raw.rlike(f"[\\x{{{first:x}}}-\\x{{{last:x}}}]") & raw.rlike(self.rare)

    def apply_rare(self, raw: Column, text: Column) -> Column:
        """`apply` and the rare characters, each that the raw text holds in one replacement.

        What a character becomes holds no character that changes, so the order does not matter.
        """
        table = F.create_map(*[F.lit(part) for pair in self.spelled for part in pair])
        held = F.array_distinct(F.regexp_extract_all(raw, F.lit(self.rare), 0))
        return F.aggregate(held, self.apply(text), lambda done, char: F.replace(done, char, F.element_at(table, char)))


def _ranges(points: list[int]) -> str:
    """Code points in ascending order as the inside of a Java character class."""
    ranges: list[list[int]] = []
    for p in points:
        if ranges and p == ranges[-1][1] + 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


def _folding(one: Callable[[str], str], common: str, in_context: str = "") -> _Folding:
    """The folding ``one`` of single characters; those of ``in_context`` are left to the rare ones."""
    points = (p for p in range(_FOLDED_POINTS) if p not in _SYLLABLES and not 0xD800 <= p < 0xE000)
    changed = {c: new for c in map(chr, points) if (new := one(c)) != c and c not in in_context}
    if one(chr(_SYLLABLES[0])) != chr(_SYLLABLES[0]):
        changed |= {chr(p): "  " for p in _SYLLABLES}
    # Where ``translate`` has no character left to put in place, it deletes.
    single = sorted((c for c, new in changed.items() if len(new) < 2), key=lambda c: not changed[c])
    rare = sorted(ord(c) for c, new in [*changed.items(), *dict.fromkeys(in_context, "  ").items()] if len(new) > 1 and c not in common)
    return _Folding(
        "".join(single),
        "".join(changed[c] for c in single),
        tuple((c, changed[c]) for c in common),
        f"(?=[^\\x{{0}}-\\x{{{rare[0] - 1:x}}}])[{_ranges(rare)}]",  # most characters fail the first class, a single range
        tuple((c, one(c)) for c in map(chr, rare) if c not in in_context),
    )


@lru_cache(maxsize=1)
def _case_folding() -> _Folding:
    return _folding(str.casefold, "\u00df\u1e9e\ufb00\ufb01\ufb02\ufb03\ufb04")


@lru_cache(maxsize=1)
def _accent_folding() -> _Folding:
    return _folding(_drop_marks, "\u00bc\u00bd\u00be\u2026\u2033\u2122\ufb00\ufb01\ufb02\ufb03\ufb04", _CAPITAL_SIGMA)


def _routed(raw: Column, prepared: Column, folding: _Folding, fold) -> Column:
    """``fold`` of the prepared text, which works character by character: in the JVM unless the raw text has rare ones.

    The function sees null in place of all other texts, so none of those leaves the JVM.
    """
    is_ascii = F.octet_length(raw) == F.length(raw)
    in_python = fold(F.when(~is_ascii, F.when(folding.holds_rare(raw), prepared)))
    return F.when(is_ascii, F.lower(prepared)).otherwise(F.coalesce(in_python, folding.apply(prepared)))


def _casefolded(raw: Column, prepared: Column) -> Column:
    """The prepared text case-folded, in the JVM whatever characters the raw text has."""
    is_ascii, folding = F.octet_length(raw) == F.length(raw), _case_folding()
    whole = F.when(folding.holds_rare(raw), folding.apply_rare(raw, prepared)).otherwise(folding.apply(prepared))
    return F.when(is_ascii, F.lower(prepared)).otherwise(whole)


def casefold(text: Column) -> Column:
    return _casefolded(text, text)


def normalize_prompt(text: Column) -> Column:
    """Whitespace-collapsed, stripped, case-folded text: the identity of a prompt."""
    return _casefolded(text, squash(strip(text)))


def text_key(normalized: Column) -> Column:
    """A 256-bit digest that stands in for a long text as grouping and join key.

    Never null: a join on a nullable key makes Spark test the key for null below the
    projection that computes it, which would run the case folding twice.
    """
    return F.coalesce(F.sha2(normalized, 256), F.lit(""))


def forward_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def bucket_of(digest: Column, hex_digits: int = 4) -> Column:
    """The leading hex digits of a digest as an integer; keeps the digest order."""
    return F.conv(F.substring(digest, 1, hex_digits), 16, 10).cast("int")


@lru_cache(maxsize=1)
def _combining_marks() -> str:
    """A character class of every combining code point, built from the Unicode database."""
    points = [p for p in range(sys.maxunicode + 1) if unicodedata.combining(chr(p))]
    ranges: list[list[int]] = []
    for p in points:
        if ranges and p == ranges[-1][1] + 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]+"


def fold_accents(text: Column) -> Column:
    """Lowercase and drop combining marks after compatibility decomposition."""
    marks = _combining_marks()

    def fold(values: pd.Series) -> pd.Series:
        drop = re.compile(marks).sub

        def one(value):
            if value is None:
                return None
            value = value.lower()
            return value if value.isascii() else drop("", unicodedata.normalize("NFKD", value))

        return values.map(one)

    fold.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return _routed(text, text, _accent_folding(), F.pandas_udf(fold, T.StringType()))


#: The characters of words; those of ASCII are named first, as they are found faster.
WORD_CLASS = r"[a-zA-Z0-9_\p{L}\p{N}]"


def word_tokens(text: Column) -> Column:
    """Runs of two or more word characters."""
    return F.regexp_extract_all(text, F.lit(f"({WORD_CLASS}{{2,}})"), 1)


def with_bigrams(tokens: Column) -> Column:
    """Unigrams followed by adjacent pairs joined with one space."""
    pairs = F.zip_with(
        F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))),
        F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))),
        lambda left, right: F.concat(left, F.lit(" "), right),
    )
    return F.concat(tokens, pairs)


def round_even(value: Column, digits: int) -> Column:
    """The double rounded half-even by its exact binary value, for up to six digits.

    ``bround`` looks at the shortest decimal text, which may be a tie where the value is not. Here the product with the
    power of ten is taken with its exact error (the factor is split in two halves), so the side of the midpoint is known.
    """
    scale = float(10**digits)

    def rounded(x: Column) -> Column:
        product = x * scale
        split = x * 134217729.0
        high = split - (split - x)
        error = (high * scale - product) + (x - high) * scale
        whole = F.floor(product)
        past = (product - whole - 0.5) + error
        up = (past > 0) | ((past == 0) & (whole % 2 != 0))
        # Beyond this size a double has no more than these digits anyway.
        return F.when(F.abs(x) < 1e9, (whole + F.when(up, 1).otherwise(0)) / scale).otherwise(F.bround(x, digits))

    # The one-element array binds the value, which may be a large expression, once.
    return F.get(F.transform(F.array(value.cast("double")), rounded), F.lit(0))


def percent_text(fraction: Column) -> Column:
    """A fraction as a percentage with one decimal, halves to even."""
    return F.format_string("%.1f%%", round_even(fraction * F.lit(100.0), 1))


def utc_text(timestamp: Column) -> Column:
    """An instant as UTC text with whole seconds, whatever the session time zone."""
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), timestamp.cast("timestamp_ntz"))
    return F.substring(utc.cast("string"), 1, 19)


def utc_day(timestamp: Column) -> Column:
    """The UTC calendar day of an instant as text."""
    return F.substring(utc_text(timestamp), 1, 10)


def instant_from_utc(wall_clock: Column) -> Column:
    """A zone-less UTC wall clock as an instant."""
    local = F.convert_timezone(F.lit("UTC"), F.current_timezone(), wall_clock.cast("timestamp_ntz"))
    return local.cast("timestamp")


def now_utc_seconds() -> Column:
    return F.date_trunc("second", F.current_timestamp())
