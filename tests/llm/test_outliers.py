import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import outliers


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_statistics(spark, odd):
    texts = ["a a a", "a a a a", "a b c a b c", "a b c d\na b c", "x\n\nx\n x\n", "é𝒳 #b\x1c*\t|", "a b c x a b c y a b c", " lead", "a b c"]
    frame = odd.select("text").unionByName(spark.createDataFrame([(t,) for t in texts], "text string"))
    for row in outliers.with_statistics(frame).collect():
        assert tuple(row[n] for n in NAMES) == brute(row.text), row.text


def test_whole_table(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet")
    result = outliers.judge(documents).toPandas().sort_values("doc_id")
    texts = documents.select("doc_id", "text").toPandas().sort_values("doc_id").text
    assert [tuple(r) for r in result[NAMES].to_numpy()] == [brute(t) for t in texts]
    failed = (result.n_words < 50) | (100 * result.n_repeat_words > 50 * result.n_words)
    assert (failed == result.base_failed).all() and not result.kept[failed].any()


def test_estimate_is_that_of_the_method(spark):
    """Centre and distances of contaminated data, beside the same steps in numpy."""
    rng = np.random.default_rng(3)
    clean = rng.normal([1.5, 0.5, 0.2, 0.3], [0.4, 0.6, 0.3, 0.3], (1500, 4))
    clean[:, 1] += 0.8 * clean[:, 0]
    bad = rng.normal([8, 6, 5, 5], 0.2, (300, 4))
    data = np.vstack([clean, bad])
    settings = outliers.Settings(accuracy=100_000)
    frame = spark.createDataFrame([("g", *map(float, x)) for x in data], "group string, x0 double, x1 double, x2 double, x3 double")
    estimates = outliers.mcd(frame, settings, True)
    found = outliers._distances(frame, estimates, True).toPandas()
    floor = np.diag(np.square(settings.floor))
    lower = lambda x, q: np.sort(x, axis=0)[np.maximum(np.ceil(q * len(x)).astype(int) - 1, 0)]
    centre = lower(data, 0.5)
    cov = np.diag(((lower(data, 0.75) - lower(data, 0.25)) / 1.349) ** 2) + floor
    distance = lambda: np.einsum("ij,jk,ik->i", data - centre, np.linalg.inv(cov), data - centre)
    for _ in range(settings.steps):
        d2 = distance()
        near = data[d2 <= lower(d2, settings.share)]
        centre, cov = near.mean(axis=0), np.cov(near.T, bias=True) / outliers._half_consistency() + floor
    near = data[distance() <= outliers.CHI2_REWEIGHT]
    centre, cov = near.mean(axis=0), np.cov(near.T, bias=True) + floor
    ours = found.sort_values(["x0", "x1", "x2", "x3"]).d2.to_numpy()
    order = np.lexsort(data.T[::-1])
    assert ours == pytest.approx(distance()[order], rel=1e-4)
    assert found.d2[found.x0 > 6].min() > 150 and (found.d2[found.x0 <= 4] > 60).mean() < 0.01


def test_consistency_constant():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400_000, 4))
    d2 = (x**2).sum(axis=1)
    assert np.median(d2) == pytest.approx(outliers.CHI2_HALF, abs=0.02)
    assert x[d2 <= np.median(d2)].var(axis=0).mean() == pytest.approx(outliers._half_consistency(), abs=0.01)
    assert math.isclose(np.quantile(d2, 0.975), outliers.CHI2_REWEIGHT, abs_tol=0.1)


def test_clean_documents_stay_and_junk_goes(spark):
    folder = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    result = outliers.judge(documents).join(labels, "doc_id").toPandas()
    sound = result[~result.base_failed]
    assert sound.kept[sound.quality == 1].mean() > 0.99 and sound.kept[sound.quality == 0].mean() < 0.1


def test_small_groups_are_joined_and_odd_rows_have_results(spark, odd, nothing):
    result = outliers.judge(odd).toPandas()
    assert len(result) == 10 and not result.kept[result.doc_id != 6].any()
    assert outliers.judge(nothing).count() == 0
    rows = [(i, f"word{i} " * 3 + " ".join(f"w{i}x{k}" for k in range(60)), lang, f"s{i % 3}") for i in range(12) for lang in ("en", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    judged = outliers.judge(frame, outliers.Settings(min_group=10))
    assert judged.filter("d2 is not null").count() == 24
    assert outliers.judge(frame, outliers.Settings(min_group=100)).filter("d2 is null and kept").count() == 24
    few, many = (outliers._group_columns(frame, n).agg(F.collect_set("group").alias("g")).first().g for n in (10, 15))
    assert len(few) == 2 and len(many) == 1
