import random

from pyspark.sql import functions as F

from wardline.labels import CLASS_ORDER, LABELS, MITIGATIONS, SAFE
from wardline.operators import hybrid, scan

WEIGHTS = [0, 5, 9, 64, 68, 72, 78, 82, 86, 88, 90, 92, 95]


def _cases(n=400, seed=7):
    rng = random.Random(seed)
    cases = []
    for i in range(n):
        raw = [rng.random() ** rng.choice([1, 6]) for _ in LABELS]
        total = sum(raw)
        hits = [
            (f"R{k}", rng.choice(LABELS[1:]), f"rule {k}", rng.choice(WEIGHTS[1:]), "ev", f"why {k}", f"fix {k % 3}")
            for k in range(rng.choice([0, 0, 1, 2, 5]))
        ]
        cases.append((i, "p", {l: v / total for l, v in zip(LABELS, raw)}, hits))
    return cases


def _expected(p, hits):
    """The verdict in plain Python, one prompt at a time."""
    best = {l: max([h[3] for h in hits if h[1] == l], default=0) for l in LABELS}
    strongest = max(best.values())
    scores = {
        l: max(0.0, p[l] * 100 - 0.55 * strongest)
        if l == SAFE
        else min(100.0, max(p[l] * 100, best[l]) + 0.18 * best[l])
        for l in LABELS
    }
    verdict = max(LABELS, key=scores.get)
    if verdict == SAFE and strongest >= 90:
        verdict = max(LABELS[1:], key=best.get)
    if verdict == SAFE:
        risk = min(round(max(0.0, 100 - scores[SAFE])), 64 if hits else 34)
    else:
        risk = max(round(min(100.0, 0.72 * scores[verdict] + 0.28 * strongest)), strongest)
    advice = list(dict.fromkeys(MITIGATIONS[verdict] + [h[6] for h in hits]))[:6]
    return verdict, max(CLASS_ORDER, key=lambda l: p[l]), scores, strongest, risk, advice


def test_verdicts_match_plain_python(spark):
    cases = _cases()
    frame = spark.createDataFrame(
        cases,
        "i int, prompt string, probabilities map<string,double>, triggered_indicators " + scan.INDICATOR_TYPE,
    )
    rows = {r["i"]: r for r in hybrid.assemble(hybrid.score_scanned(frame), keep=["i"]).collect()}
    for i, _, p, hits in cases:
        verdict, ml, scores, strongest, risk, advice = _expected(p, hits)
        row = rows[i]
        assert row["classification"] == verdict
        assert row["ml_prediction"]["label"] == ml
        assert row["rule_score"] == strongest
        assert abs(row["confidence"] - scores[verdict] / 100) <= 1.01e-4
        assert abs(row["risk_score"] - risk) <= 1  # binary against decimal halves
        assert row["mitigations"] == advice
        assert 0 <= row["risk_score"] <= 100 and len(row["mitigations"]) <= 6
        if verdict != SAFE:
            assert row["risk_score"] >= strongest
        assert set(row["hybrid_scores"]) == set(LABELS) == set(row["ml_prediction"]["probabilities"])
        assert all(abs(row["hybrid_scores"][l] - scores[l]) <= 0.0051 for l in LABELS)
        told = row["explanations"]
        top = sorted(hits, key=lambda h: -h[3])[:3]
        assert told[: max(1, len(top))] == ([h[5] for h in top] or [hybrid.NO_INDICATOR_TEXT])
        assert told[max(1, len(top))].startswith(f"The machine learning model predicted {ml} with ")
        assert (hybrid.ADJUSTED_TEXT in told) == (verdict != ml)
        closing = hybrid.BLOCK_TEXT if row["risk_score"] >= 65 else hybrid.REVIEW_TEXT if row["risk_score"] >= 35 else hybrid.SAFE_TEXT
        assert told[-1] == closing


def test_levels_at_their_edges(spark):
    frame = spark.createDataFrame([(v,) for v in (34, 35, 64, 65, 84, 85)], "risk int")
    got = frame.select(
        hybrid.risk_level(F.col("risk")), hybrid.severity(F.col("risk"), F.lit(SAFE)), hybrid.severity(F.col("risk"), F.lit("Jailbreak"))
    ).collect()
    assert [r[0] for r in got] == ["Low", "Medium", "Medium", "High", "High", "Critical"]
    assert [r[1] for r in got] == ["Benign", "Moderate", "Moderate", "High", "High", "Severe"]
    assert got[0][2] == "Low"


def test_ties_follow_their_orders(spark):
    even = F.create_map(*[part for l in LABELS for part in (F.lit(l), F.lit(0.2))])
    frame = spark.range(1).select(
        F.lit("p").alias("prompt"),
        even.alias("probabilities"),
        F.array(
            *[
                F.struct(F.lit("x"), F.lit(c), F.lit("l"), F.lit(92), F.lit("e"), F.lit("w"), F.lit("m"))
                for c in ("Roleplay Manipulation", "Data Extraction")
            ]
        ).cast(scan.INDICATOR_TYPE).alias("triggered_indicators"),
    )
    row = hybrid.score_scanned(frame).first()
    assert row["ml_label"] == "Data Extraction"  # first in alphabetical class order
    assert row["classification"] == "Data Extraction"  # first in label order among the two at 100


def test_ranked_probabilities_order(spark):
    p = F.create_map(F.lit("Jailbreak"), F.lit(0.3), F.lit("Data Extraction"), F.lit(0.3), F.lit(SAFE), F.lit(0.4000001234))
    ranked = spark.range(1).select(hybrid.ranked_probabilities(p).alias("r")).first()["r"]
    assert [e["label"] for e in ranked] == [SAFE, "Data Extraction", "Jailbreak"]
    assert ranked[0]["probability"] == 0.4


def test_ranked_probabilities_round_by_the_binary_value(spark):
    """As Python's round does: seven digits ending in five are ties in their text alone."""
    values = [(2 * i + 1) / 2_000_000 for i in range(3000, 4000)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    ranked = hybrid.ranked_probabilities(F.create_map(F.lit("Jailbreak"), F.col("v")))
    got = [r["ranked"][0]["probability"] for r in frame.select(ranked.alias("ranked")).collect()]
    assert got == [round(v, 6) for v in values]
