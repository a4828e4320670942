"""Greedy line wrapping as a fold over the pieces of a text, in built-in expressions.

A text is cut into words, blanks between them and the parts of hyphenated words; a fold over
these carries the finished lines and the open one. The result is that of Python's
``textwrap.wrap`` with its default settings.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .arrays import bound
from .text import strip

TAB = 8
_WORD = r"[\p{L}\p{N}_]"
_BEFORE_DASH = r"[\p{L}\p{N}_!\x22'&.,?]"
# The JVM looks behind by code points only where a pattern has one beyond the first plane, so a letter of that kind is named.
_LETTER = "[\\p{L}\\p{Nl}\\p{No}_\U0001d4b3]"
#: Blanks; a dash of two or more hyphens between words; a word, up to its end, its next hyphen between letters or a dash.
PIECE = (
    r"(?s)(\x20+"
    rf"|(?<={_BEFORE_DASH})-{{2,}}(?={_WORD})"
    r"|[^\x20]+?(?:"
    rf"-(?:(?<={_LETTER}{{2}}-)|(?<={_LETTER}-{_BEFORE_DASH}-))(?={_LETTER}-?{_LETTER})"
    r"|(?=\x20|\z)"
    rf"|(?<={_BEFORE_DASH})(?=-{{2,}}{_WORD})))"
)
_PLAIN, _BLANK_RUN, _FIRST, _NEXT = 0, 1, 2, 3  # kinds of units
_BLOCK = 200  # units folded before their lines join the others


def expand_tabs(text: Column) -> Column:
    """Tabs filled up to the next multiple of eight columns of their line."""

    def filled(line: Column) -> Column:
        cells = F.split(line, "\t")
        return F.array_join(
            F.transform(
                cells,
                lambda cell, i: F.when(
                    i < F.size(cells) - 1, F.concat(cell, F.repeat(F.lit(" "), TAB - F.length(cell) % TAB))
                ).otherwise(cell),
            ),
            "",
        )

    lines = F.split(text, "[\n\r]")
    return F.when(F.contains(text, F.lit("\t")), F.array_join(F.transform(lines, filled), " ")).otherwise(text)


def pieces(text: Column) -> Column:
    """Words, blanks and parts of hyphenated words, in order; together they are the text on one line."""
    return F.regexp_extract_all(F.translate(expand_tabs(text), "\t\n\x0b\x0c\r", " " * 5), F.lit(PIECE), 1)


def _is_blank(piece: Column) -> Column:
    return strip(piece) == ""


def _unit(piece: Column, size: Column, kind: Column) -> Column:
    return F.struct(piece.alias("text"), size.cast("int").alias("size"), _is_blank(piece).alias("blank"), kind.alias("kind"))


def _units(text: Column, width: Column) -> Column:
    """Pieces that fit a line as they are, longer words character by character."""

    def split_up(piece: Column) -> Column:
        size = F.length(piece)
        whole = F.array(_unit(piece, size, F.when(size > width, _BLANK_RUN).otherwise(_PLAIN)))
        letters = F.transform(
            F.regexp_extract_all(piece, F.lit("(?s)(.)"), 1),
            lambda letter, i: _unit(letter, F.lit(1), F.when(i == 0, _FIRST).otherwise(_NEXT)),
        )
        return F.when((size <= width) | _is_blank(piece), whole).otherwise(letters)

    return F.flatten(F.transform(pieces(text), split_up))


def _state(lines: Column, line: Column, used: Column, tail=0, skip=False, cut=0, some=False) -> Column:
    as_column = lambda value: value if isinstance(value, Column) else F.lit(value)
    return F.struct(
        lines.alias("lines"),
        line.alias("line"),
        used.cast("int").alias("used"),
        as_column(tail).cast("int").alias("tail"),
        as_column(skip).alias("skip"),
        as_column(cut).cast("int").alias("cut"),
        as_column(some).alias("some"),
    )


def _with_line(lines: Column, line: Column) -> Column:
    return F.when(line == "", lines).otherwise(F.array_append(lines, line))


def _shown(acc: Column) -> Column:
    """The open line as it is closed: its trailing blank goes, which may leave nothing."""
    return F.substring(acc["line"], F.lit(1), acc["used"] - acc["tail"])


def _step(acc: Column, unit: Column, width: Column) -> Column:
    size, blank, kind, piece = unit["size"], unit["blank"], unit["kind"], unit["text"]
    lines, line, used, some = acc["lines"], acc["line"], acc["used"], acc["some"]
    tail = F.when(blank, size).otherwise(0)
    cut = F.when(kind == _FIRST, used).otherwise(acc["cut"])

    placed = _state(lines, F.concat(line, piece), used + size, tail, False, cut, some)
    skipped = _state(lines, line, used, acc["tail"], some=some)
    # The piece opens the next line, unless it is a blank after a finished line.
    closed, any_closed = _with_line(lines, _shown(acc)), some | (_shown(acc) != "")
    following = F.when(blank & any_closed, _state(closed, F.lit(""), F.lit(0), some=True)).otherwise(
        _state(closed, piece, size, tail, some=any_closed)
    )
    # Blanks longer than a line: at the start of the text what is left of them after whole lines stays.
    left = F.pmod(size - 1, width) + 1
    long_blank = F.when((used == 0) & ~some, _state(lines, F.substring(piece, F.lit(1), left), left, left)).otherwise(
        _state(_with_line(lines, line), F.lit(""), F.lit(0), some=True)
    )
    # A word longer than a line goes on in the next one, after its last hyphen on this line if something is before that.
    part = F.substring(line, acc["cut"] + 1, used)
    upto = F.length(F.regexp_extract(part, r"(?s)^(-*[^-].*-)", 1))
    kept = F.when((kind == _NEXT) & (upto > 0), acc["cut"] + upto).otherwise(used)
    carried = F.concat(F.substring(line, kept + 1, used), piece)
    broken = _state(_with_line(lines, F.substring(line, F.lit(1), kept)), carried, used - kept + 1, some=True)

    return (
        F.when(blank & acc["skip"], skipped)
        .when((kind != _BLANK_RUN) & (used + size <= width), placed)
        .when(kind == _PLAIN, following)
        .when(kind == _BLANK_RUN, long_blank)
        .otherwise(broken)
    )


def wrap(text: Column, width: Column) -> Column:
    """The lines of a text at most ``width`` characters wide; an empty or blank text has none.

    Spark copies the state of a fold at every step, so the fold runs in blocks: within a block it carries the block's
    lines only, and the lines of all blocks are carried from block to block.
    """
    none = F.array().cast("array<string>")

    def block_of(acc: Column, units: Column) -> Column:
        begun = _state(none, *[acc[name] for name in ("line", "used", "tail", "skip", "cut", "some")])
        done = F.aggregate(units, begun, lambda inner, unit: _step(inner, unit, width))
        return bound(
            done,
            lambda d: _state(
                F.concat(acc["lines"], d["lines"]), *[d[name] for name in ("line", "used", "tail", "skip", "cut", "some")]
            ),
        )

    def folded(units: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(units) - 1) / _BLOCK).cast("int")),
            lambda i: F.slice(units, i * _BLOCK + 1, F.lit(_BLOCK)),
        )
        start = _state(none, F.lit(""), F.lit(0))
        return F.aggregate(blocks, start, block_of, lambda acc: _with_line(acc["lines"], _shown(acc)))

    return bound(_units(text, width), lambda units: F.when(F.size(units) > 0, folded(units)).otherwise(none))
