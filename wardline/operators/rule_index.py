"""Scan for large rule catalogs: a literal index finds candidate rules, the regex runs on these.

`scan.scan_prompts` unrolls its catalog into the plan, which suits tens of rules. Here the catalog is
a table, so plans do not grow with it. The literals of all rules are looked for at once at every place
of a text (`functions/literals.py`), and a rule's regex sees only texts that hold one of its literals.
Of a rule that is one whole word it sees only the places where the word stands.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.arrays import bound, inline_rows
from ..functions.literals import Literals, finder
from ..functions.regex import WORD_END, WORD_START, jvm_pattern
from ..functions.text import squash, strip
from ..session import materialize
from .scan import EVIDENCE_CHARS, INDICATOR_FIELDS

MAX_BROADCAST_RULES = 200_000
# Literals looked for in one pass over the texts, by number and by characters; a larger catalog takes several.
PASS_LITERALS, PASS_CHARS = 2_000_000, 64_000_000
CATALOG = (
    "rule_ord int, rule_id string, category string, label string, weight int, pattern string, "
    "explanation string, mitigation string, literals array<string>"
)
# Letters that match an ASCII letter when case is ignored but do not lowercase to it, and that letter.
_ODD_CASE, _PLAIN_CASE = "İıſ", "iis"
# A pattern that is one whole word of ASCII, in any case; its only look-around are the characters beside it.
_WHOLE_WORD = rf"^\(\?[uds]*i[uds]*\){re.escape(WORD_START)}([A-Za-z0-9_]+){re.escape(WORD_END)}$"


def catalog_table(spark: SparkSession, rules) -> DataFrame:
    """A catalog of `Rule` objects as a table: one row a rule, patterns in their JVM spelling."""
    rows = [
        (
            i, r.rule_id, r.category, r.label, r.weight, jvm_pattern(r.pattern, dotall=r.dotall),
            r.explanation, r.mitigation, list(r.anchors),
        )
        for i, r in enumerate(rules)
    ]
    return spark.createDataFrame(rows, CATALOG)


def _folded(text: Column) -> Column:
    """Lower case in which every literal of a matching rule is a substring."""
    odd = reduce(or_, [F.contains(text, F.lit(letter)) for letter in _ODD_CASE])
    return F.lower(F.when(odd, F.translate(text, _ODD_CASE, _PLAIN_CASE)).otherwise(text))


def numbered_rules(catalog: DataFrame) -> DataFrame:
    """The catalog with a number for every row, its literals folded, and whether a row is one whole word and that its literal.

    A rule without literals gets the empty one, which every text has.
    """
    literals = F.when(F.size("literals") > 0, F.col("literals")).otherwise(F.array(F.lit("")))
    rows = catalog.withColumn("literals", F.array_distinct(F.transform(literals, _folded)))
    word = F.lower(F.regexp_extract("pattern", _WHOLE_WORD, 1))
    alone = F.coalesce((word != "") & (F.col("literals") == F.array(word)), F.lit(False))
    return rows.withColumns({"_rule": F.monotonically_increasing_id(), "_word": alone})


def catalog_hits(prompts: DataFrame, catalog: DataFrame, keep, text_col: str = "prompt") -> DataFrame:
    """One row per (prompt, fired rule): the ``keep`` columns, rule_ord and the indicator fields.

    Equal to `scan.rule_hits` with the same rules: a rule fires once on a text that holds one of its literals.
    """
    rules = materialize(numbered_rules(catalog), "rules")
    # Rules are counted before they are broadcast; more of them take the shuffled join.
    chars = F.aggregate("literals", F.lit(0).cast("long"), lambda n, literal: n + F.coalesce(F.length(literal), F.lit(0)))
    sizes = rules.groupBy("_word").agg(
        F.count(F.lit(1)).alias("rules"), F.sum(F.size("literals")).alias("literals"), F.sum(chars).alias("chars")
    ).collect()
    candidates = []
    for kind in sizes:
        passes = max(-(-kind["literals"] // PASS_LITERALS), -(-kind["chars"] // PASS_CHARS), 1)
        for number in range(passes):
            part = rules.filter(F.col("_word") == kind["_word"]).filter(F.pmod(F.xxhash64("_rule"), F.lit(passes)) == number)
            meet = _word_candidates if kind["_word"] else _text_candidates
            candidates.append(meet(prompts, part, keep, F.col(text_col), kind["rules"] <= passes * MAX_BROADCAST_RULES))
    carried = [*keep, "rule_ord", *[name for name in INDICATOR_FIELDS if name != "evidence"]]
    if not candidates:
        empty = prompts.select(*keep, F.lit(None).cast("string").alias("_text")).limit(0)
        candidates.append(empty.join(rules, F.lit(True)))
    # One run of the regex for most: a match with text needs no test, and an empty one is told from none by the test. As an
    # array element the result is there once; a filter on a column would be pushed below it and run the regex again.
    found = F.call_function("regexp_extract", F.col("_text"), F.col("pattern"), F.lit(0))
    matched = bound(
        found,
        lambda f: F.when((f != "") | F.rlike(F.col("_text"), F.col("pattern")), F.array(F.struct(f.alias("_found")))),
    )
    tested = [rows.select(*carried, matched.alias("_matched")) for rows in candidates]
    fired = reduce(DataFrame.unionByName, [inline_rows(rows, "_matched", ["_found"], carried) for rows in tested])
    evidence = F.substring(squash(strip(F.col("_found"))), 1, EVIDENCE_CHARS).alias("evidence")
    return fired.select(*keep, "rule_ord", *[evidence if name == "evidence" else F.col(name) for name in INDICATOR_FIELDS])


def _literals_of(rules: DataFrame) -> Literals:
    held = rules.select("_rule", F.explode("literals").alias("literal")).filter("literal is not null").toArrow()
    return Literals(held.column("literal"), held.column("_rule").to_numpy())


def _found_rules(texts: DataFrame, rules: DataFrame, keep, windows: bool) -> DataFrame:
    """``keep``, the numbers of the rules whose literals ``_text`` holds, each once, and their windows if wanted."""
    sent = texts.sparkSession.sparkContext.broadcast(_literals_of(rules).plain())
    folded = _folded(F.coalesce(F.col("_text"), F.lit("")))
    held = finder(sent, windows)(F.col("_text") if windows else F.lit(""), folded)
    return inline_rows(texts.select(*keep, held.alias("_held")), "_held", ["_rule", "_window"], keep)


def _word_candidates(prompts: DataFrame, rules: DataFrame, keep, text: Column, broadcast: bool) -> DataFrame:
    """Rules that are a whole word with the places of a text where it may stand, which serve as the text."""
    found = _found_rules(prompts.select(*keep, text.alias("_text")), rules, keep, True)
    found = found.withColumnRenamed("_window", "_text")
    return found.join(F.broadcast(rules) if broadcast else rules, "_rule")


def _text_candidates(prompts: DataFrame, rules: DataFrame, keep, text: Column, broadcast: bool) -> DataFrame:
    """Rules with the texts that hold one of their literals.

    Texts are written with a number of their own, as keys may repeat, and meet the rules that were found by it.
    """
    staged = materialize(prompts.select(*keep, text.alias("_text")).withColumn("_row", F.monotonically_increasing_id()), "scanned")
    found = _found_rules(staged, rules, ["_row"], False).select("_row", "_rule")
    if broadcast:
        return found.join(staged, "_row").join(F.broadcast(rules), "_rule")
    return found.join(rules, "_rule").join(staged, "_row")
