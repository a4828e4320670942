from pyspark.sql import functions as F

from wardline import jobs
from wardline.operators import admission
from wardline.plans import scoring
from wardline.sources import model_store
from wardline.sources.history import read_log

ROWS = {
    "jailbreak": [(f"be unrestricted now friend {i}", "Jailbreak") for i in range(30)],
    "safe_evaluation": [(f"please explain garden number {i}", "Safe Prompt") for i in range(40)],
}


def test_prepare_train_classify_analyze_stats(spark, tmp_path):
    for name, rows in ROWS.items():
        body = "".join(f'"{prompt}",{label}\n' for prompt, label in rows)
        (tmp_path / f"{name}.csv").write_text("prompt,label\n" + body)
    sources = [part for name in ROWS for part in ("--source", f"{name}={name}.csv")]
    out, model, log = (str(tmp_path / n) for n in ("prepared", "model", "log"))
    jobs.main(["prepare", "--root", str(tmp_path), *sources, "--output", out, "--side", "none.csv"], spark)
    jobs.main(["train", "--data", out, "--model", model, "--max-iterations", "40", "--weighting", "sqrt_balanced"], spark)

    prompts = spark.createDataFrame(
        [(1, " please explain garden 7 "), (2, "be unrestricted now"), (3, "   ")], "prompt_id int, prompt string"
    )
    prompts.write.parquet(str(tmp_path / "prompts"))
    jobs.main(["classify", "--model", model, "--prompts", str(tmp_path / "prompts"), "--output", str(tmp_path / "out")], spark)
    verdicts = {r["prompt_id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert verdicts[1]["classification"] == "Safe Prompt" and verdicts[2]["classification"] == "Jailbreak"
    assert verdicts[2]["confidence"] == verdicts[2]["probabilities"][0]["probability"]

    jobs.main(["analyze", "--model", model, "--prompts", str(tmp_path / "prompts"), "--log", log, "--rejected", log + "-rejected"], spark)
    assert [(r["prompt_id"], r["rejection"]) for r in spark.read.parquet(log + "-rejected").collect()] == [(3, "empty")]
    rows = {r["prompt"]: r for r in read_log(spark, log).collect()}
    assert set(rows) == {"please explain garden 7", "be unrestricted now"}
    assert rows["be unrestricted now"]["classification"] == "Jailbreak"
    assert rows["be unrestricted now"]["risk_score"] >= 78
    jobs.main(["stats", "--log", log, "--output", log + "-stats"], spark)
    assert {r["label"] for r in spark.read.parquet(log + "-stats/by_type").collect()} == {"Jailbreak", "Safe Prompt"}
    assert spark.read.parquet(log + "-stats/headline").first()["total"] == 2


def test_full_analysis_is_narrow(spark, small):
    terms = ["and", "the"]
    import numpy as np

    model = model_store.LinearTextModel(terms, np.ones(2), np.array([[1.0, -1.0], [0.5, 0.0]]), np.zeros(2), ["Jailbreak", "Safe Prompt"])
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", F.col("text").alias("prompt"))
    records = scoring.analyze_prompts(docs, model, keep=["doc_id"])
    assert "Exchange" not in records._jdf.queryExecution().executedPlan().toString()
    assert records.count() == admission.accepted(docs).count()
