import random
import re
import sys
import unicodedata

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from wardline.functions import text
from wardline.functions.regex import jvm_pattern
from wardline.sources.rules import RELABEL_RULES, RULES

TRICKY = [
    "  Straße    IGNORE\x1call ",
    "ß vs ss ﬁn İstanbul Σς KKK",
    "\x1c\x1f only separators \x85",
    "",
    "  \t\n ",
    "café École ẞ ＡＢ",
    "naïve coöperate 12 a _x 中文 ²³",
]


def _apply(spark, values, *columns):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    rows = frame.select("i", *columns).orderBy("i").collect()
    return [tuple(r[1:]) for r in rows]


def test_whitespace_class_is_exact():
    assert set(text.WHITESPACE_CHARS) == {chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()}


def test_strip_squash_normalize(spark):
    got = _apply(spark, TRICKY, text.strip(F.col("x")), text.normalize_prompt(F.col("x")))
    for value, (stripped, normalized) in zip(TRICKY, got):
        assert stripped == value.strip()
        assert normalized == " ".join(value.split()).casefold()


def test_fold_accents_and_tokens(spark):
    folded = text.fold_accents(F.col("x"))
    got = _apply(spark, TRICKY, folded, text.word_tokens(folded), text.with_bigrams(text.word_tokens(folded)))
    for value, (lower, tokens, grams) in zip(TRICKY, got):
        expected = "".join(c for c in unicodedata.normalize("NFKD", value.lower()) if not unicodedata.combining(c))
        assert lower == expected
        words = re.findall(r"\b\w\w+\b", expected)
        assert tokens == words
        assert grams == words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def test_both_routes_agree_and_ascii_stays_in_the_jvm(spark):
    every_ascii = "".join(map(chr, range(128)))
    values = [every_ascii, "Plain ASCII Text", None, "", "\x00A", *TRICKY]
    got = _apply(spark, values, text.normalize_prompt(F.col("x")), text.fold_accents(F.col("x")), text.casefold(F.col("x")))
    for value, (normalized, folded, cased) in zip(values, got):
        if value is None:
            assert (normalized, folded, cased) == (None, None, None)
            continue
        assert normalized == " ".join(value.split()).casefold() and cased == value.casefold()
        assert folded == "".join(c for c in unicodedata.normalize("NFKD", value.lower()) if not unicodedata.combining(c))
    frame = spark.createDataFrame([(v,) for v in values], "x string")
    plan = frame.select(text.fold_accents(F.col("x")).alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    # What the Python node reads is the text or null, by the test for ASCII.
    assert "ArrowEvalPython [fold(CASE WHEN NOT (octet_length(x" in plan or "fold(_" in plan and "CASE WHEN NOT (octet_length(x" in plan


def test_round_even_and_percent(spark):
    frame = spark.createDataFrame([(2.5,), (3.5,), (0.5,), (34.5,)], "v double")
    assert [r[0] for r in frame.select(text.round_even(F.col("v"), 0)).collect()] == [2.0, 4.0, 0.0, 34.0]
    frame = spark.createDataFrame([(0.1225,), (0.5,), (1.0,)], "v double")
    assert [r[0] for r in frame.select(text.percent_text(F.col("v"))).collect()] == ["12.2%", "50.0%", "100.0%"]


def test_na_tokens(spark):
    got = _apply(spark, ["null", "NA", "", "nil", "None"], text.na_to_null(F.col("x")))
    assert [g[0] for g in got] == [None, None, None, "nil", None]


def test_keys_are_never_null(spark):
    row = spark.range(1).select(text.text_key(F.lit(None).cast("string"))).first()
    assert row[0] == ""


def test_split_buckets_keep_digest_order(spark):
    digests = ["00ff" + "0" * 60, "0100" + "f" * 60, "fffe" + "0" * 60]
    got = [g[0] for g in _apply(spark, digests, text.bucket_of(F.col("x")))]
    assert got == [255, 256, 65534]


WORDS = st.sampled_from(
    ["ignore", "previous", "rules", "DAN", "act as", "system prompt", "reveal", "passwords", "run", "rm  -rf", "you are",
     "from now on", "hacker", "pretend", "safety", "bypass", "é", "é", "x", "İgnore", "paſſwords",
     "toKen", "_", "1", "no limits", "os.system", "osxsystem", "policies", "polic"]
)
GLUE = st.sampled_from(["", " ", "\n", ", ", " ", "́", "x" * 40, " y" * 15, "‍", "\x1c"])


def _texts():
    return st.lists(st.tuples(WORDS, GLUE), min_size=1, max_size=6).map(lambda p: "".join(a + b for a, b in p))


@settings(max_examples=15, deadline=None)
@given(st.lists(_texts(), min_size=40, max_size=60))
def test_patterns_match_like_python(spark, texts):
    rules = [(r.pattern, r.dotall) for r in RULES] + [(r.pattern, False) for r in RELABEL_RULES]
    columns = [F.regexp_extract(F.col("x"), jvm_pattern(p, dotall=d), 0) for p, d in rules]
    got = _apply(spark, texts, *columns)
    for value, row in zip(texts, got):
        for (pattern, dotall), found in zip(rules, row):
            flags = re.IGNORECASE | (re.DOTALL if dotall else 0)
            match = re.search(pattern, value, flags)
            assert found == (match.group(0) if match else ""), (pattern, value)


def test_generic_boundaries(spark):
    patterns = [r"\b\W+x\b", r"a\b", r"\b(?:-|x)y", r"\d+\b\s", r"(a|b-)\b", r"x?\b", r"\b(a(b)?)\b", r"a?\b"]
    values = ["-- x", "a", "ab", "-y", "xy", "12 ", "12a", "b-", "b- c", "١ ", "_a", "a(b)", " a "]
    patterns = [p.replace(r"\W", r"[^\w]") for p in patterns]
    got = _apply(spark, values, *[F.col("x").rlike(jvm_pattern(p)) for p in patterns])
    for value, row in zip(values, got):
        for pattern, found in zip(patterns, row):
            assert found == bool(re.search(pattern, value, re.IGNORECASE)), (pattern, value)


def test_rounding_equals_python_on_ties_and_elsewhere(spark):
    """Ties in the decimal text, values near them, negatives and large values, beside Python's round."""
    rng = random.Random(8)
    values = [k / 100000 for k in range(5, 100000, 10)] + [k / 1000 for k in range(5, 100000, 10)]
    values += [rng.uniform(-100, 100) for _ in range(3000)] + [0.5, 1.5, 2.5, -0.5, -2.5, 1e12 + 0.5, 0.0, 99.99995]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    columns = [text.round_even(F.col("v"), d).alias(f"d{d}") for d in (0, 2, 4, 6)]
    for row in frame.select("v", *columns, text.percent_text(F.col("v")).alias("p")).collect():
        for d in (0, 2, 4, 6):
            assert row[f"d{d}"] == round(row["v"], d), (row["v"], d)
        if abs(row["v"]) < 1e6:
            assert row["p"].lstrip("-") == f"{row['v'] * 100:.1f}%".lstrip("-")
