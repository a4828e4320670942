import textwrap

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from wardline.functions.wrap import pieces, wrap

TEXTS = [
    "", " ", "   \t\n", "one", "a b", "x" * 30, "word " * 12, "well-known one-of-a-kind e-mail re-re-entry x-y 12-13 a-1-b",
    "he said--and meant--it -- twice---or thrice", "a\tb\t\tc\n\tindented\r\nnext\x0bv\x0cf", " " * 25 + "late start",
    " " * 10 + "x" * 10 + " y", "ab" + " " * 30 + "cd", "--------------------------", "-a-------------------b------c",
    "long-" * 12 + "end", "a-" * 20, "naïve coöperate—em dash ½-cup Ⅳ-a façade-naïf", "中文字符" * 10 + " 中-文", "a 　 b \xa0 c",
    "https://example.org/a-very-long-path/with-hyphens?and=more tail", "'quoted'--\"dash\"&--x", "12345678 90", "1234567890 x" + "y" * 25,
    "abcdefghij " + "k" * 21 + " l", "𝒳𝒴-𝒵𝒲 " * 6,
]


def _wrapped(spark, texts, widths):
    rows = [(i, t, w) for i, t in enumerate(texts) for w in widths]
    frame = spark.createDataFrame(rows, "i int, t string, w int")
    return {(r["i"], r["w"]): r["lines"] for r in frame.select("i", "w", wrap(F.col("t"), F.col("w")).alias("lines")).collect()}


def test_lines_are_those_of_textwrap(spark):
    widths = [1, 2, 5, 10, 11, 24, 94]
    got = _wrapped(spark, TEXTS, widths)
    wrong = {k: (v, textwrap.wrap(TEXTS[k[0]], k[1])) for k, v in got.items() if v != textwrap.wrap(TEXTS[k[0]], k[1])}
    assert wrong == {}


def test_pieces_are_the_text_on_one_line(spark):
    frame = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for r in frame.select("t", pieces(F.col("t")).alias("p")).collect():
        flat = r["t"].expandtabs(8).translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " "))
        assert "".join(r["p"]) == flat


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab1_ \t\n-.é&中"), max_size=60), min_size=20, max_size=40), st.integers(1, 20))
def test_any_text(spark, texts, width):
    got = _wrapped(spark, texts, [width])
    assert {k[0]: v for k, v in got.items()} == {i: textwrap.wrap(t, width) for i, t in enumerate(texts)}


def test_long_texts(spark):
    texts = ["some words of a text " * 20_000, "z" * 50_000, "hy-phen-at-ed-" * 3_000]
    got = _wrapped(spark, texts, [94])
    assert {k[0]: v for k, v in got.items()} == {i: textwrap.wrap(t, 94) for i, t in enumerate(texts)}
