"""Secret scans over an incremental blob ledger. Native only.

Versions of texts are addressed by the SHA-256 of their content. The ledger, a Parquet table, says which rules in which
version have scanned a blob, and what they found. A run scans one text of each blob that has unseen (rule, version) pairs,
with these rules only, appends to the ledger, and joins the findings back to all paths that hold the blob. Copies are
combined before the shuffle, and the rows of a hot blob are spread out when findings come back.

Defined results: a null text is the empty blob; an empty text has no findings; repeated paths and rows are scanned once
and reported for each row. Positions are code points, ends exclusive. A changed version number makes a rule unseen.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.lookup import attach_key_facts
from ..session import materialize, new_table_path, path_exists

BLOCK = 256  # elements in one block of a running sum
MARK = "[REDACTED]"


@dataclass(frozen=True)
class Rule:
    """A match counts if its ``group`` has at least ``least`` characters. ``guard`` is a cheap necessary condition."""

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 1
    guard: str | None = None

    @property
    def key(self) -> str:
        return f"{self.kind}:{self.version}"


#: The base rules.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=1,
        least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20, guard="AKIA"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Kinds that the ledger adds: key blocks and tokens whose form is public.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", guard="-----BEGIN "),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", guard="gh"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", guard="eyJ"),
)
RULES = BASE_RULES + MORE_RULES
FINDING = "struct<start:long,rank:int,end:long,kind:string>"


def content_address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """What precedes each element, combined from 0 on: exclusive running sums or maxima of an array of longs.

    Arrays have no running aggregate, and appending to one array copies it every time; in blocks the copies stay short.
    """
    size = F.size(values)
    last = F.greatest(F.lit(0), (size - 1) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * BLOCK + 1, BLOCK))

    def append(done: Column, value: Column) -> Column:
        return F.concat(done, F.array(combine(F.element_at(done, -1), value)))

    zero = F.array(F.lit(0).cast("long"))
    inner = F.transform(blocks, lambda block: F.aggregate(block, zero, append))
    before = F.aggregate(F.transform(inner, lambda b: F.element_at(b, -1)), zero, append)
    return F.flatten(
        F.transform(inner, lambda b, k: F.transform(F.slice(b, 1, F.size(b) - 1), lambda x: combine(x, F.get(before, k))))
    )


def find(text: Column, rule: Rule, rank: int) -> Column:
    """All matches of a rule as an array of findings: leftmost, non-overlapping, then filtered by length."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
    between = F.split(text, rule.pattern, -1)
    parts = F.transform(
        matches,
        lambda m, k: F.struct(
            F.length(F.get(between, k)).cast("long").alias("gap"),
            F.length(m).cast("long").alias("size"),
            F.length(F.get(tested, k)).alias("tested"),
        ),
    )

    def placed(p: Column) -> Column:
        ahead = running(F.transform(p, lambda x: x["gap"] + x["size"]), lambda a, b: a + b)
        found = F.zip_with(
            p,
            ahead,
            lambda x, at: F.struct(
                (at + x["gap"]).alias("start"),
                F.lit(rank).alias("rank"),
                (at + x["gap"] + x["size"]).alias("end"),
                F.lit(rule.kind).alias("kind"),
                x["tested"].alias("tested"),
            ),
        )
        long_enough = F.filter(found, lambda x: x["tested"] >= rule.least)
        return F.transform(long_enough, lambda x: F.struct(*[x[c].alias(c) for c in ("start", "rank", "end", "kind")]))

    possible = text.rlike(rule.pattern)
    if rule.guard is not None:
        possible = text.contains(rule.guard) & possible
    none = F.array().cast(f"array<{FINDING}>")
    # The one-element array binds the parts once, so that they are not computed for each use.
    return F.when(possible, F.element_at(F.transform(F.array(parts), placed), 1).cast(f"array<{FINDING}>")).otherwise(none)


class Ledger:
    """The table of scanned (blob, rule, version) pairs and their findings."""

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES):
        self.spark, self.path, self.rules = spark, path, rules

    def rows(self) -> DataFrame:
        """blob, scanned (rule:version), findings (with rule:version): one row for each blob and run that scanned it."""
        schema = f"blob string, scanned array<string>, findings array<struct<rule:string,found:{FINDING}>>"
        if path_exists(self.spark, self.path):
            return self.spark.read.schema(schema).parquet(self.path)
        return self.spark.createDataFrame([], schema)

    def scan(self, versions: DataFrame, text: str = "text") -> DataFrame:
        """blob, copies, findings of all blobs with findings, after scanning what the ledger has not seen."""
        addressed = versions.select(content_address(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        blobs = materialize(addressed.groupBy("blob").agg(F.count(F.lit(1)).alias("copies")), "blobs")
        wanted = F.array(*[F.lit(r.key) for r in self.rules])
        if path_exists(self.spark, self.path):
            seen = self.rows().groupBy("blob").agg(F.flatten(F.collect_set("scanned")).alias("seen"))
            open_rules = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
            unseen = blobs.join(seen, "blob", "left").select("blob", open_rules.alias("open")).filter(F.size("open") > 0)
            unseen = materialize(unseen, "unseen")
            todo = addressed.join(unseen, "blob", "left_semi").groupBy("blob").agg(F.first("text").alias("text"))
            todo = todo.join(unseen, "blob")
        else:
            todo = addressed.groupBy("blob").agg(F.first("text").alias("text")).withColumn("open", wanted)
        self._scanned(todo).write.mode("append").parquet(self.path)
        found = self.rows().select("blob", F.filter("findings", lambda x: F.array_contains(wanted, x["rule"])).alias("findings"))
        found = found.filter(F.size("findings") > 0).groupBy("blob").agg(F.flatten(F.collect_set("findings")).alias("findings"))
        ordered = F.sort_array(F.transform("findings", lambda x: x["found"])).alias("findings")
        return found.select("blob", ordered).join(blobs, "blob")

    def _scanned(self, todo: DataFrame) -> DataFrame:
        found = []
        for rank, rule in enumerate(self.rules):
            hits = F.when(F.array_contains("open", rule.key), find(F.col("text"), rule, rank))
            marked = F.transform(hits, _marker(rule.key))
            found.append(F.coalesce(marked, F.array().cast(f"array<struct<rule:string,found:{FINDING}>>")))
        return todo.select("blob", F.col("open").alias("scanned"), F.concat(*found).alias("findings"))


def _marker(key: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(key).alias("rule"), x.alias("found"))


def count_of(findings: Column, kind: str) -> Column:
    return F.size(F.filter(findings, lambda x: x["kind"] == kind)).cast("long")


def with_findings(versions: DataFrame, ledger: Ledger, text: str = "text", into: str = "_findings") -> DataFrame:
    """The rows with their columns and, in column ``into``, their findings in order (an empty array without any)."""
    names = versions.columns
    facts = ledger.scan(versions, text)
    rows = versions.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), content_address(F.col(f"`{text}`")).alias("blob"))
    spread = F.rand(7)
    joined = attach_key_facts(rows, facts, "blob", spread)
    return joined.select("_row.*", F.coalesce("findings", F.array().cast(f"array<{FINDING}>")).alias(into))


def redacted(text: Column, findings: Column) -> Column:
    """The text with every run of overlapping findings replaced by a mark."""

    def cut(f: Column) -> Column:
        covered = running(F.transform(f, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
        pieces = F.zip_with(
            f,
            covered,
            lambda x, done: F.when(
                x["start"] >= done, F.concat(F.substr(text, (done + 1).cast("int"), (x["start"] - done).cast("int")), F.lit(MARK))
            ).otherwise(F.lit("")),
        )
        end = F.array_max(F.transform(f, lambda x: x["end"]))
        return F.concat(F.array_join(pieces, ""), F.substr(text, (end + 1).cast("int")))

    return F.when(F.size(findings) > 0, F.element_at(F.transform(F.array(findings), cut), 1)).otherwise(text)


def redact(documents: DataFrame, ledger: Ledger) -> DataFrame:
    """The documents with their columns; found secrets are replaced in ``text``, and ``n_chars``, if there, follows."""
    names = documents.columns
    into = "_findings"
    while into in names:
        into += "_"
    found = with_findings(documents, ledger, into=into)
    # In a struct: inside a lambda, a bare name would mean the new column of that name in the same select.
    found = found.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(into).alias("_found"))
    out = {c: F.col("_row").getField(c) for c in names}
    text = redacted(out["text"], F.col("_found"))
    if "n_chars" in names:
        out["n_chars"] = F.when(F.size("_found") > 0, F.length(text).cast("long")).otherwise(out["n_chars"])
    out["text"] = text
    return found.select(*[value.alias(c) for c, value in out.items()])


def new_ledger(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> Ledger:
    """A ledger without history in the shared folder."""
    return Ledger(spark, new_table_path(spark, "secret-ledger"), rules)


def span_text(findings: Column) -> Column:
    """kind:start:end of findings, comma-joined in their order."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
