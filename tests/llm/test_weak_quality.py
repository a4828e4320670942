import math
import random
import re
import unicodedata

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from wardline.llm import queries, weak_quality
from wardline.llm.weak_quality import BAD, GOOD, LABELLERS, NOTHING


def votes_of(spark, text):
    pattern = spark.createDataFrame([(text,)], "t string").select(weak_quality.votes(F.col("t"))).first()[0]
    return dict(zip(LABELLERS, weak_quality._ballots(np.array([pattern]))[0]))


def test_votes(spark):
    prose = "The first line of some ordinary prose.\nAnd then a second line that ends well, too."
    assert set(votes_of(spark, prose).values()) <= {GOOD, NOTHING}
    assert votes_of(spark, "a%%% b*** c$$$ d### e&&&")["symbols"] == BAD
    assert votes_of(spark, "same line.\n" * 20)["lines"] == BAD
    assert votes_of(spark, "word " * 60)["words"] == BAD
    assert votes_of(spark, "EVERY WORD IS LOUD HERE TODAY")["capitals"] == BAD
    assert set(votes_of(spark, "").values()) == set(votes_of(spark, None).values()) == {NOTHING}


def plain_votes(text):
    """The labellers, rule by rule."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [line for line in text.split("\n") if line.strip(" ")]
    kinds = [unicodedata.category(c) for c in text]
    ended = [line for line in lines if re.search(r"[.!?:;\"”»)][\x20\x09-\x0D]*\Z", line)]

    def vote(defined, top, under, bad, good):
        if not defined:
            return NOTHING
        return BAD if bad(top / under) else GOOD if good(top / under) else NOTHING

    return {
        "symbols": vote(words, sum(c in "#*$%&|<>" for c in text), len(words), lambda v: v > 0.2, lambda v: v < 0.05),
        "word_length": vote(words, sum(map(len, words)), len(words), lambda v: v < 2.5 or v > 12, lambda v: 3.5 <= v <= 9),
        "lines": vote(len(lines) > 1, len(lines) - len(set(lines)), len(lines), lambda v: v > 0.3, lambda v: v < 0.05),
        "words": vote(len(words) >= 30, len(set(words)), len(words), lambda v: v < 0.15, lambda v: v > 0.3),
        "capitals": vote(len(words) >= 5, kinds.count("Lu"), len(text), lambda v: v > 0.3, lambda v: v < 0.1),
        "letters": vote(words, sum(k[0] == "L" for k in kinds), len(text), lambda v: v < 0.6, lambda v: v > 0.75),
        "endings": vote(lines, len(ended), len(lines), lambda v: v < 0.2, lambda v: v > 0.6),
    }


def test_votes_are_those_of_the_plain_rules(small):
    rng = random.Random(4)
    texts = pq.read_table(f"{small}/documents.parquet", columns=["text"])["text"].to_pylist()
    for letters in ("ab \n", "aÉé.\n \t", "日Б”» \n#", "x\r\n. 𝒳", " \n\t", "A b\u2028\x85.\n", "##a> )\n"):
        texts += ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 40, 300]))) for _ in range(150)]
    texts += ["x" * 3_000_000 + ".\n" + "x" * 3_000_000 + ".", "", None, "a" * (1 << 20), "end»", "end”", "\xbb", "”"]
    rng.shuffle(texts)
    found = weak_quality._all_patterns(*weak_quality.text_buffers(weak_quality.pa.array(texts, weak_quality.pa.string())))
    for text, ballots in zip(texts, weak_quality._ballots(found)):
        assert dict(zip(LABELLERS, ballots)) == plain_votes(text or ""), (text or "")[:80]


def test_query_is_the_fit_over_plain_votes_and_a_dot_product(spark, small):
    """Posteriors from votes counted one by one; scores from the scorer's weights, text by text."""
    documents = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r for r in queries.op6_quality(spark, small).collect()}
    texts = {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}
    numbers = {d: sum(plain_votes(t)[name] * 3**k for k, name in enumerate(LABELLERS)) for d, t in texts.items()}
    patterns, counts = np.unique(list(numbers.values()), return_counts=True)
    belief = dict(zip(patterns.tolist(), weak_quality.estimate(patterns, counts.astype(float)).posterior(patterns)))
    table = spark.createDataFrame([(p, float(round(b, 9))) for p, b in belief.items()], "pattern int, belief double")
    scorer = weak_quality.fit_scorer(documents.select("doc_id", "text").fillna("", ["text"]), table)
    weights = dict(zip(scorer.buckets.tolist(), scorer.weights))
    assert rows.keys() == texts.keys()
    for doc_id, text in texts.items():
        data, offsets = weak_quality.text_buffers(weak_quality.pa.array([text]))
        features = set(weak_quality._features(data, offsets, scorer.bits)[0].tolist())
        expected = 1 / (1 + math.exp(-(scorer.bias + math.fsum(weights.get(f, 0.0) for f in features))))
        assert rows[doc_id].weak_label == pytest.approx(belief[numbers[doc_id]], abs=1e-8)
        assert rows[doc_id].score == pytest.approx(expected, abs=1e-9) and rows[doc_id].kept == (rows[doc_id].score >= 0.6)


def test_estimation_recovers_accuracies():
    """Votes drawn from known accuracies, some withheld; EM sees no class."""
    rng = np.random.default_rng(2)
    truth = rng.random(60_000) < 0.85
    good_if_good, good_if_bad = np.linspace(0.99, 0.93, 7), np.linspace(0.1, 0.4, 7)
    says_good = rng.random((60_000, 7)) < np.where(truth[:, None], good_if_good, good_if_bad)
    ballots = np.where(rng.random((60_000, 7)) < 0.2, NOTHING, np.where(says_good, GOOD, BAD))
    patterns, counts = np.unique(ballots @ 3 ** np.arange(7), return_counts=True)
    model = weak_quality.estimate(patterns, counts.astype(float))
    assert model.good == pytest.approx(0.85, abs=0.02)
    assert model.chances[:, 1, GOOD] == pytest.approx(good_if_good, abs=0.02)
    assert model.chances[:, 0, GOOD] == pytest.approx(good_if_bad, abs=0.04)
    belief = dict(zip(patterns, model.posterior(patterns)))
    assert np.mean([(belief[p] > 0.5) == t for p, t in zip(ballots @ 3 ** np.arange(7), truth)]) > 0.97


def test_shapes_end_tokens_and_stay_inside_texts():
    data, offsets = weak_quality.text_buffers(weak_quality.pa.array(["ab%% X!!", "zb%%", "", "é"]))
    hashes, owner = weak_quality._shapes(data, offsets)
    assert owner.tolist() == [0, 0, 1, 3] and hashes[0] == hashes[2] != hashes[1]


def test_agrees_with_labels_it_never_reads(spark):
    folder = "/root/testdata/sf0.01"
    result = weak_quality.classify(spark.read.parquet(f"{folder}/documents.parquet"))
    assert result.columns == ["doc_id", "weak_label", "score", "kept"]
    joined = result.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    good = joined.quality == 1
    assert joined.kept[good].mean() > 0.98 and joined.kept[~good].mean() < 0.2


def test_odd_rows(odd, nothing):
    result = weak_quality.classify(odd).toPandas()
    assert len(result) == 10 and result.score.between(0, 1).all()
    assert result[result.doc_id.isin([3, 4])].score.nunique() == 1
    assert weak_quality.classify(nothing).count() == 0
