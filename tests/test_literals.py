import random
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest

from wardline.functions.literals import Literals
from wardline.operators import rule_index, scan
from wardline.sources.rules import RULES

WORDS = ["secret", "Secrets", "secretly", "istanbul", "kelvin", "a", "administration", "administrations", "seventeen_letters_0", "sis"]
TEXTS = [
    "", None, "secret", "a secrets-secretly SECRET, Secret", "ésecret secretÉ secret", "xsecret secret9 _secret", "İSTANBUL ıstanbul İstanbul's",
    "Kelvin kELVIN, xKelvin Kelvin", "Administrations of administration", "seventeen_letters_0 seventeen_letters_01", "ſiſ sis SIS\nsis", "日本secret secret日本 𝒳secret",
    "secret" * 400 + " secret", "İ" * 50 + "secret kelvin", "secret́ á a",
]


def _word_rules():
    return tuple(replace(RULES[0], rule_id=f"w{i}", pattern=rf"\b{w}\b", anchors=(w.lower(),)) for i, w in enumerate(WORDS))


def _rows(hits):
    return sorted(hits.select("doc_id", *scan.INDICATOR_FIELDS).collect(), key=str)


@pytest.fixture(scope="module")
def prompts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, prompt string").coalesce(1).cache()


@pytest.mark.parametrize("limits", [{}, {"PASS_LITERALS": 3, "MAX_BROADCAST_RULES": 0}])
def test_whole_words_fire_as_in_the_unrolled_scan(spark, prompts, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(rule_index, name, value)
    rules = (*_word_rules(), *RULES[:2], replace(RULES[0], rule_id="half", pattern=r"\bsecrets?\b", anchors=("secret",)))
    catalog = rule_index.catalog_table(spark, rules)
    assert rule_index.numbered_rules(catalog).filter("_word").count() == len(WORDS)
    expected = _rows(scan.rule_hits(prompts, "doc_id", rules=rules))
    assert _rows(rule_index.catalog_hits(prompts, catalog, ["doc_id"])) == expected and len(expected) > 20


def test_no_row_for_every_place_of_a_text(spark, prompts):
    """Literals are found within a text: what leaves it are the rules found, and whole words go without their texts."""
    hits = rule_index.catalog_hits(prompts, rule_index.catalog_table(spark, _word_rules()), ["doc_id"])
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "scanned-" not in plan and "_row" not in plan


def test_places_of_literals():
    rng = random.Random(5)
    literals = ["", *{"".join(rng.choices("abé", k=rng.randint(1, 30))) for _ in range(300)}, "ab" * 20, "ab" * 20]
    texts = ["".join(rng.choices("abé", k=rng.randint(0, 300))) for _ in range(50)] + ["ab" * 40, ""]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    known = Literals.of(Literals(pa.array(literals), np.arange(len(literals))).plain())
    got = sorted(zip(*(a.tolist() for a in known.occurrences(np.frombuffer(data, np.uint8), offsets))))
    expected = []
    for t, text in enumerate(texts):
        for i, literal in enumerate(literals):
            at = text.find(literal) if literal else -1
            while at >= 0:
                first = offsets[t] + len(text[:at].encode())
                expected.append((t, i, first, first + len(literal.encode())))
                at = text.find(literal, at + 1)
    assert got == sorted(expected) and len(got) > 1000 and known.everywhere.tolist() == [0]
