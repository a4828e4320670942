"""The label domain: five classes whose order carries meaning.

``LABELS`` order breaks ties between hybrid scores and orders every report;
``CLASS_ORDER`` (alphabetical) is the order a fitted classifier keeps its
classes in and breaks ties between model probabilities.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Label names and the mitigations recommended for each of them.
LABELS = (
    "Safe Prompt",
    "Prompt Injection",
    "Jailbreak",
    "Data Extraction",
    "Roleplay Manipulation",
)

MITIGATIONS = {
    "Safe Prompt": [
        "Allow the prompt to continue to the LLM.",
        "Keep standard logging and abuse monitoring enabled.",
    ],
    "Prompt Injection": [
        "Reject attempts to override system or developer instructions.",
        "Treat all user instructions as untrusted content.",
        "Keep tool access behind explicit policy checks.",
    ],
    "Jailbreak": [
        "Refuse persona or jailbreak instructions.",
        "Restate that safety and system policies remain active.",
        "Route repeated jailbreak attempts for security review.",
    ],
    "Data Extraction": [
        "Do not reveal hidden prompts, credentials, or confidential data.",
        "Mask sensitive fields and enforce least-privilege access.",
        "Log the request for audit and incident review.",
    ],
    "Roleplay Manipulation": [
        "Allow benign roleplay only when safety rules remain unchanged.",
        "Reject role instructions that remove limits or change identity.",
        "Prefer a safe alternative response.",
    ],
}

SAFE = LABELS[0]
THREATS = LABELS[1:]
CLASS_ORDER = tuple(sorted(LABELS))


def string_array(values) -> Column:
    """A literal array<string>, typed even when it is empty."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def label_array(labels=LABELS) -> Column:
    return string_array(labels)


def label_bit(label: Column, labels=LABELS) -> Column:
    """One bit per label, so that a set of labels fits an integer aggregate.

    A label outside the domain gives null; `admission.require_valid` refuses it first.
    """
    bit = F.lit(None).cast("int")
    for position, name in reversed(list(enumerate(labels))):
        bit = F.when(label == name, F.lit(1 << position)).otherwise(bit)
    return bit


def labels_in_mask(mask: Column, labels=LABELS) -> Column:
    """The labels of a bit mask as an array in label order."""
    picks = [
        F.when(mask.bitwiseAND(F.lit(1 << position)) != 0, F.lit(name))
        for position, name in enumerate(labels)
    ]
    return F.array_compact(F.array(*picks))


def mitigations_for(label: Column) -> Column:
    """The class-level mitigation list of a label column."""
    result = string_array([])
    for name in reversed(LABELS):
        result = F.when(label == name, string_array(MITIGATIONS[name])).otherwise(result)
    return result
