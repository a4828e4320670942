"""Folding in the JVM: exact for every character, and only rare texts go to Python."""

import re
import sys
import unicodedata

from pyspark.sql import functions as F

from wardline.functions import text
from wardline.functions.regex import WHITESPACE
from wardline.operators import tfidf


def _without_marks(value):
    return "".join(c for c in unicodedata.normalize("NFKD", value.lower()) if not unicodedata.combining(c))


def test_every_character_is_folded_as_python_does(spark):
    points = [chr(p) for p in range(1, sys.maxunicode + 1) if not 0xD800 <= p < 0xE000]
    texts = ["".join(points[i : i + 50]) for i in range(0, len(points), 50)] + ["é" + c for c in points[:0x2200]] + ["AΣ b", "Α.Σ Σ", "½ẞ…"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, x string").repartition(8)
    got = frame.select("i", text.fold_accents(F.col("x")).alias("f"), text.casefold(F.col("x")).alias("c")).collect()
    assert len(got) == len(texts)
    for row in got:
        assert row["f"] == _without_marks(texts[row["i"]]) and row["c"] == texts[row["i"]].casefold()


def test_common_letters_stay_in_the_jvm(spark):
    """What Python is given of texts in the common scripts is nothing."""
    values = ["Straße ÉÑÜ àçô", "“quoted” – 5 € … ½", "Привет Мир", "Αθήνα καλημέρα", "中文 日本語", "🙂 ok", "ﬁne"]
    frame = spark.createDataFrame([(v,) for v in values], "x string")
    for folding in (text._accent_folding(), text._case_folding()):
        assert not any(r[0] for r in frame.select(F.col("x").rlike(folding.rare)).collect())
    got = frame.select("x", text.fold_accents(F.col("x")).alias("f"), text.normalize_prompt(F.col("x")).alias("n")).collect()
    for row in got:
        assert row["f"] == _without_marks(row["x"]) and row["n"] == " ".join(row["x"].split()).casefold()


def test_squash_collapses_every_kind_of_run(spark):
    spaces = [" ", "\t", "\n", "\x1c", "\x85", "\xa0", " ", "　"]
    runs = spaces + [a + b for a in spaces for b in spaces] + [f" {a} " for a in spaces]
    values = [f"a{r}b{r}{r}é 中\x00 \x00" for r in runs] + [" ", "  ", " \x00", ""]
    frame = spark.createDataFrame([(v,) for v in values], "x string")
    for row in frame.select("x", text.squash(F.col("x")).alias("s")).collect():
        assert row["s"] == re.sub("[" + text.WHITESPACE_CHARS + "]+", " ", row["x"])
    assert WHITESPACE.startswith("[")


def test_a_vocabulary_folds_its_texts_once(spark, monkeypatch):
    """Both passes over the terms read the texts that were folded for the first."""
    calls = []
    monkeypatch.setattr(tfidf, "fold_accents", lambda column: calls.append(1) or text.fold_accents(column))
    docs = spark.createDataFrame([(1, "Été à Paris"), (2, "ete a paris"), (2, None), (None, "été")], "doc_id long, text string")
    got = {(r["term"], r["df"], r["tf"]) for r in tfidf.fit_vocabulary(docs, "doc_id", max_df=1.0).collect()}
    assert got == {("ete", 3, 3), ("paris", 2, 2), ("ete paris", 2, 2)} and len(calls) == 1


def test_case_folding_needs_no_python(spark):
    """Also for texts full of characters that become several, next to each other and to what they become."""
    several = [c for c in map(chr, range(0x80, 0x20000)) if not "\ud800" <= c < "\ue000" and len(c.casefold()) > 1]
    values = ["".join(several), "".join(c.casefold() + c + c.upper() for c in several), " İ\t\xa0ŉ ǰİ ", "ΐ ﬗﬅ", *several, None, "", "plain"]
    frame = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    folded = frame.select("i", text.casefold(F.col("x")).alias("c"), text.normalize_prompt(F.col("x")).alias("n"))
    for row in folded.collect():
        value = values[row["i"]]
        assert (row["c"], row["n"]) == ((None, None) if value is None else (value.casefold(), " ".join(value.split()).casefold()))
    assert "Python" not in folded._jdf.queryExecution().optimizedPlan().toString()
