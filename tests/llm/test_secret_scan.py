import hashlib
import random
import re

from pyspark.sql import functions as F

from wardline.llm import queries, secret_scan
from wardline.llm.secret_scan import RULES, Ledger, Rule

PARTS = ["password", "Secret", "TOKEN", "api_key", "ApiKey", "=", ":", " ", '"', "'", "é𝒳", "abcdef", "AKIA", "ABCDEFGH12345678"]
PARTS += ["0123456789abcdef", "deadbeefcafe", "x", ".", "-----BEGIN RSA PRIVATE KEY-----", "\n", "ghp_" + "a1" * 18]


def brute(text):
    """(start, rank, end, kind) of all rules, by Python's matcher."""
    found = []
    for rank, rule in enumerate(RULES):
        for m in re.finditer(rule.pattern.replace("(?i:", "(?ai:") if "(?i:" not in rule.pattern else rule.pattern, text or ""):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), rank, m.end(), rule.kind))
    return sorted(found)


def mask(text, found):
    out, done = "", 0
    for start, _, end, _ in found:
        if start >= done:
            out += text[done:start] + secret_scan.MARK
        done = max(done, end)
    return out + text[done:]


def planted(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.choice([3, 12, 60, 700]))) for _ in range(250)]
    texts += [None, "", "token=abcdefgh " * 2500, "secret: token = abcdefgh", "token=abc", "AKIA", "AKIAAKIA" + "Z" * 13, "f" * 23, "f" * 24]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_findings_and_redaction_equal_brute_force(spark):
    texts, frame = planted(spark)
    found = secret_scan.with_findings(frame, secret_scan.new_ledger(spark))
    whole = F.coalesce("text", F.lit(""))
    rows = {r.doc_id: r for r in found.withColumn("masked", secret_scan.redacted(whole, F.col("_findings"))).collect()}
    for i, text in enumerate(texts):
        expected = brute(text)
        assert [tuple(x) for x in rows[i]._findings] == expected, text
        assert rows[i].masked == mask(text or "", expected)


def test_running_sums_over_blocks(spark):
    values = [3 * i % 7 for i in range(1000)]
    row = spark.createDataFrame([(values,), ([],), ([5],)], "v array<long>").select(secret_scan.running(F.col("v"), lambda a, b: a + b).alias("s")).collect()
    assert row[0].s == [sum(values[:k]) for k in range(1000)] and row[1].s == [] and row[2].s == [0]


def test_only_unseen_blobs_and_rules_are_scanned(spark):
    ledger = secret_scan.new_ledger(spark, RULES[:2])
    first = spark.createDataFrame([("a", "token=abcdefgh"), ("b", "token=abcdefgh"), ("c", "plain")], "path string, text string")
    once = {r.path: r._findings for r in secret_scan.with_findings(first, ledger).collect()}
    assert len(once["a"]) == len(once["b"]) == 1 and once["c"] == []
    assert ledger.rows().count() == 2
    assert secret_scan.with_findings(first, ledger).count() == 3 and ledger.rows().count() == 2
    later = first.unionByName(spark.createDataFrame([("a", "AKIA" + "Q" * 16)], "path string, text string"))
    assert secret_scan.with_findings(later, ledger).filter("size(_findings) > 0").count() == 3
    assert ledger.rows().count() == 3
    renewed = Ledger(spark, ledger.path, (Rule("assign", "never", 2), *RULES[1:3]))
    again = {(r.path, r.text): r._findings for r in secret_scan.with_findings(later, renewed).collect()}
    assert again["a", "token=abcdefgh"] == [] and len(again["a", "AKIA" + "Q" * 16]) == 1
    scanned = [set(r.scanned) for r in renewed.rows().collect()]
    assert scanned.count({"assign:2", "hex:1"}) == 3 and scanned.count({"assign:1", "access:1"}) == 3


def test_query_equals_brute_force(spark, small):
    rows = {r.doc_id: r for r in queries.op5_secrets(spark, small).collect()}
    documents = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(documents)
    for doc_id, text in documents:
        found, row = brute(text), rows[doc_id]
        joined = lambda some: ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in some)
        base = [x for x in found if x[1] < 3]
        assert row.spans == joined(found) and row.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(x[1] == k for x in base) for k in range(3)]


def test_odd_rows(spark, odd, nothing):
    result = secret_scan.redact(odd, secret_scan.new_ledger(spark))
    assert result.columns == odd.columns and sorted(map(str, result.collect())) == sorted(map(str, odd.collect()))
    assert secret_scan.redact(nothing, secret_scan.new_ledger(spark)).count() == 0


def test_no_python_in_the_plan(spark, small):
    plan = queries.op5_secrets(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
