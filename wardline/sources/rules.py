"""The rule catalog: weighted patterns that mark a prompt as a threat."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Rule:
    """One catalog entry.

    ``anchors`` are lower-case literals of which every match contains at least one.
    They let the scan skip the regex on most texts; leave them empty when unsure.
    """

    rule_id: str
    category: str
    label: str
    pattern: str
    weight: int
    explanation: str
    mitigation: str
    dotall: bool = False
    anchors: tuple[str, ...] = ()


@dataclass(frozen=True)
class RelabelRule:
    pattern: str
    label: str
    reason: str


# The shipped catalog and the shipped relabelling patterns.
RULES: tuple[Rule, ...] = (
    Rule(
        rule_id="PI-001",
        category="Prompt Injection",
        label="Instruction override",
        pattern=r"\b(ignore|disregard|forget|override)\b.{0,60}\b(previous|prior|above|earlier|all)\b.{0,40}\b(instructions?|rules?|context|messages?)\b",
        weight=82,
        explanation="The prompt attempts to override earlier instructions or rules.",
        mitigation="Keep system instructions isolated and reject instruction-override text.",
        dotall=True,
        anchors=("ignore", "disregard", "forget", "override"),
    ),
    Rule(
        rule_id="PI-002",
        category="Prompt Injection",
        label="Policy bypass request",
        pattern=r"\b(bypass|circumvent|disable|remove|break)\b.{0,50}\b(safety|guardrails?|filters?|restrictions?|polic(?:y|ies))\b",
        weight=86,
        explanation="The prompt asks the model to bypass safety controls.",
        mitigation="Refuse the bypass request and continue applying the safety policy.",
        dotall=True,
        anchors=("safety", "guardrail", "filter", "restriction", "polic"),
    ),
    Rule(
        rule_id="PI-003",
        category="Prompt Injection",
        label="Command execution language",
        pattern=r"\b(execute|run|eval|shell|terminal|subprocess|os\.system|rm\s+-rf|powershell|cmd\.exe|bash)\b",
        weight=68,
        explanation="The prompt contains command execution or shell-oriented language.",
        mitigation="Do not execute user-supplied commands without sandboxing and review.",
        anchors=("execute", "run", "eval", "shell", "terminal", "subprocess", "os.system", "-rf", "cmd.exe", "bash"),
    ),
    Rule(
        rule_id="JB-001",
        category="Jailbreak",
        label="DAN-style jailbreak",
        pattern=r"\b(DAN|do anything now|developer mode|evilbot|personagpt)\b",
        weight=92,
        explanation="The prompt resembles a known jailbreak persona pattern.",
        mitigation="Treat persona override requests as untrusted user content.",
        anchors=("dan", "do anything now", "developer mode", "evilbot", "personagpt"),
    ),
    Rule(
        rule_id="JB-002",
        category="Jailbreak",
        label="Unrestricted model request",
        pattern=r"\b(unrestricted|uncensored|no limits?|without limits?|no censorship|break character|stay in character)\b",
        weight=78,
        explanation="The prompt asks the assistant to operate without normal restrictions.",
        mitigation="Enforce the normal model behavior and refuse unsafe role instructions.",
        anchors=("unrestricted", "uncensored", "no limit", "without limit", "no censorship", "break character", "stay in character"),
    ),
    Rule(
        rule_id="JB-003",
        category="Jailbreak",
        label="Safety refusal manipulation",
        pattern=r"\b(if you refuse|do not refuse|must answer|you cannot refuse|never say you can't|no warnings?)\b",
        weight=72,
        explanation="The prompt tries to control refusal behavior.",
        mitigation="Ignore refusal-manipulation clauses and apply the policy normally.",
        anchors=("if you refuse", "do not refuse", "must answer", "you cannot refuse", "never say you can't", "no warning"),
    ),
    Rule(
        rule_id="DE-001",
        category="Data Extraction",
        label="System prompt extraction",
        pattern=r"\b(reveal|show|print|display|repeat|leak|expose)\b.{0,60}\b(system prompt|hidden prompt|developer message|internal instructions?|initial instructions?)\b",
        weight=95,
        explanation="The prompt asks for hidden or internal instructions.",
        mitigation="Never disclose system prompts, hidden policies, or developer messages.",
        dotall=True,
        anchors=("system prompt", "hidden prompt", "developer message", "internal instruction", "initial instruction"),
    ),
    Rule(
        rule_id="DE-002",
        category="Data Extraction",
        label="Secret or credential extraction",
        pattern=r"\b(passwords?|api keys?|tokens?|secrets?|credentials?|private keys?|database|confidential)\b",
        weight=76,
        explanation="The prompt references secrets, credentials, or confidential data.",
        mitigation="Block data exfiltration and return a privacy-preserving response.",
        anchors=("password", "api key", "token", "secret", "credential", "private key", "database", "confidential"),
    ),
    Rule(
        rule_id="RM-001",
        category="Roleplay Manipulation",
        label="Malicious roleplay",
        pattern=r"\b(pretend|roleplay|act as|simulate|you are now)\b.{0,70}\b(unrestricted|hacker|evil|criminal|no rules|DAN|developer mode)\b",
        weight=88,
        explanation="The prompt disguises unsafe behavior as roleplay.",
        mitigation="Allow harmless roleplay only when it does not override safety rules.",
        dotall=True,
        anchors=("pretend", "roleplay", "act as", "simulate", "you are now"),
    ),
    Rule(
        rule_id="RM-002",
        category="Roleplay Manipulation",
        label="Alternate identity override",
        pattern=r"\b(from now on|for this conversation|new role|new persona)\b.{0,90}\b(you are|act as|pretend)\b",
        weight=64,
        explanation="The prompt tries to replace the assistant identity or persona.",
        mitigation="Keep assistant identity and instruction hierarchy unchanged.",
        dotall=True,
        anchors=("from now on", "for this conversation", "new role", "new persona"),
    ),
)

RELABEL_RULES: tuple[RelabelRule, ...] = (
    RelabelRule(
        pattern=r"^\s*ignore\s+all\s+previous\s+instructions\b",
        label="Prompt Injection",
        reason="Starts with an explicit instruction-override command.",
    ),
    RelabelRule(
        pattern=r"\bpretend\s+to\s+be\s+DAN\b|\bact\s+as\s+DAN\b",
        label="Roleplay Manipulation",
        reason="Explicitly requests DAN-style roleplay.",
    ),
)


def rule_catalog(spark: SparkSession, rules=RULES) -> DataFrame:
    """The catalog as a frame, in catalog order."""
    rows = [
        (i, r.rule_id, r.category, r.label, r.pattern, r.weight, r.explanation, r.mitigation)
        for i, r in enumerate(rules)
    ]
    return spark.createDataFrame(
        rows,
        "rule_ord int, rule_id string, category string, label string, pattern string, "
        "weight int, explanation string, mitigation string",
    )
