"""The registered queries once more, as SQL for an independent engine.

Written against the given tables only. RE2 knows neither look-around nor Unicode word
boundaries, so rule patterns are restated with explicit non-word characters.
"""

from __future__ import annotations

import re

from ..labels import CLASS_ORDER, LABELS, MITIGATIONS, THREATS
from ..operators import hybrid, report
from ..operators.tfidf import MAX_FEATURES
from ..operators.corpus import PREPARED_COLUMNS, SOURCE_ORDER
from ..sources.rules import RELABEL_RULES, RULES
from . import fixtures as fx
from .queries import INTERCEPTS, WEAK_RULES

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NON_WORD = r"[^\p{L}\p{N}_]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str, dotall: bool) -> str:
    """A rule pattern with its match as group 1; gaps keep their lengths."""
    body = re.sub(r"\((?!\?)", "(?:", pattern)
    body = body.replace(r"\s", WS)

    def gap(m: re.Match) -> str:
        inner = int(m.group(1)) - 2
        return f"(?:{NON_WORD}.{{0,{inner}}}{NON_WORD}|{NON_WORD})"

    body = re.sub(r"\\b\.\{0,(\d+)\}\\b", gap, body)
    pieces = [
        re.sub(r"\\b$", "", re.sub(r"^\\b", "", piece)) for piece in re.split(r"(?<=\\b)\|(?=\\b)", body)
    ]
    flags = "(?is)" if dotall else "(?i)"
    return f"{flags}(?:^|{NON_WORD})({'|'.join(pieces)})(?:{NON_WORD}|$)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def squash(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def normalize(x: str) -> str:
    return f"replace(lower({squash(x)}), 'ß', 'ss')"


def hits_sql(source: str, key: str, text: str, rules=RULES) -> str:
    parts = []
    for i, r in enumerate(rules):
        pattern = q(re2(r.pattern, r.dotall))
        parts.append(
            f"SELECT {key}, {i} AS rule_ord, {q(r.rule_id)} AS rule_id, {q(r.category)} AS category, "
            f"{q(r.label)} AS label, {r.weight} AS weight, "
            f"substr({squash(f'regexp_extract({text}, {pattern}, 1)')}, 1, 180) AS evidence, "
            f"{q(r.explanation)} AS explanation, {q(r.mitigation)} AS mitigation "
            f"FROM {source} WHERE regexp_matches({text}, {pattern})"
        )
    return "\nUNION ALL ".join(parts)


LABEL_TABLE = "labels_dim AS (SELECT * FROM (VALUES " + ", ".join(
    f"({q(n)}, {i}, {CLASS_ORDER.index(n)})" for i, n in enumerate(LABELS)
) + ") AS t(label, label_ord, class_ord))"

PROMPTS = f"prompts AS (SELECT doc_id, {fx.PLANTED} AS prompt FROM documents)"
ADMITTED = (
    f"stripped AS (SELECT doc_id, {strip(fx.PLANTED)} AS prompt FROM documents), "
    "prompts AS (SELECT * FROM stripped WHERE prompt <> '')"
)


def probability_table() -> str:
    parts = [
        f"SELECT doc_id, {q(n)} AS label, {fx.PROBABILITY_TERMS[n]} / {fx.PROBABILITY_SUM} AS p FROM documents"
        for n in LABELS
    ]
    return "probs AS (" + " UNION ALL ".join(parts) + ")"


def scored(prompts: str = PROMPTS, rules=RULES) -> str:
    """CTEs up to the verdict: hits, grid (per label), verdict (per document)."""
    return f"""WITH {LABEL_TABLE}, {prompts}, {probability_table()},
hits AS ({hits_sql('prompts', 'doc_id', 'prompt', rules)}),
best AS (SELECT doc_id, category, max(weight) AS w FROM hits GROUP BY ALL),
top AS (SELECT doc_id, max(weight) AS s FROM hits GROUP BY ALL),
base AS (
  SELECT p.doc_id, l.label, l.label_ord, l.class_ord, b.p, coalesce(best.w, 0) AS rule_score, coalesce(top.s, 0) AS s
  FROM prompts p CROSS JOIN labels_dim l
  JOIN probs b ON b.doc_id = p.doc_id AND b.label = l.label
  LEFT JOIN best ON best.doc_id = p.doc_id AND best.category = l.label
  LEFT JOIN top ON top.doc_id = p.doc_id),
grid AS (
  SELECT *, CASE WHEN label_ord = 0 THEN greatest(0e0, p * 100e0 - s * 0.55e0)
    ELSE least(100e0, greatest(p * 100e0, rule_score::DOUBLE) + rule_score * 0.18e0) END AS h
  FROM base),
picked AS (
  SELECT doc_id, arg_max(label, (h, -label_ord)) AS by_score, arg_max(label, (p, -class_ord)) AS ml_label,
    arg_max(label, (rule_score, -label_ord)) FILTER (WHERE label_ord > 0) AS by_rule, max(p) AS ml_p,
    any_value(s) AS s, max(h) FILTER (WHERE label_ord = 0) AS safe_h, max(p) FILTER (WHERE label_ord = 0) AS safe_p
  FROM grid GROUP BY doc_id),
named AS (
  SELECT *, CASE WHEN by_score = 'Safe Prompt' AND s >= 90 THEN by_rule ELSE by_score END AS classification
  FROM picked),
risked AS (
  SELECT n.*, g.h, CAST(printf('%.4f', g.h / 100e0) AS DOUBLE) AS confidence,
    CASE WHEN classification = 'Safe Prompt'
      THEN least(CAST(printf('%.0f', greatest(0e0, 100e0 - safe_h)) AS DOUBLE)::INTEGER, CASE WHEN n.s > 0 THEN 64 ELSE 34 END)
      ELSE greatest(CAST(printf('%.0f', least(100e0, g.h * 0.72e0 + n.s * 0.28e0)) AS DOUBLE)::INTEGER, n.s) END AS risk_score
  FROM named n JOIN grid g ON g.doc_id = n.doc_id AND g.label = n.classification),
verdict AS (
  SELECT *, CAST(printf('%.2f', confidence * 100e0) AS DOUBLE) AS confidence_percent, {level_sql()} AS risk_level,
    {severity_sql()} AS severity
  FROM risked)
"""


def level_sql() -> str:
    return (
        "CASE WHEN risk_score >= 85 THEN 'Critical' WHEN risk_score >= 65 THEN 'High' "
        "WHEN risk_score >= 35 THEN 'Medium' ELSE 'Low' END"
    )


def severity_sql() -> str:
    return (
        "CASE WHEN classification = 'Safe Prompt' AND risk_score < 35 THEN 'Benign' WHEN risk_score >= 85 THEN 'Severe' "
        "WHEN risk_score >= 65 THEN 'High' WHEN risk_score >= 35 THEN 'Moderate' ELSE 'Low' END"
    )


def mitigation_ctes() -> str:
    """advice(doc_id, mitigations): class advice then rule advice, first mention kept, six at most."""
    rows = ", ".join(
        f"({q(n)}, {i}, {q(m)})" for n in LABELS for i, m in enumerate(MITIGATIONS[n])
    )
    return f""", class_advice AS (SELECT * FROM (VALUES {rows}) AS t(label, pos, mitigation)),
all_advice AS (
  SELECT doc_id, pos, mitigation FROM verdict JOIN class_advice ON label = classification
  UNION ALL SELECT doc_id, 100 + rule_ord, mitigation FROM hits),
firsts AS (SELECT doc_id, mitigation, min(pos) AS pos FROM all_advice GROUP BY ALL),
ranked_advice AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM firsts),
advice AS (SELECT doc_id, string_agg(mitigation, ' | ' ORDER BY pos) AS mitigations
  FROM ranked_advice WHERE rn <= 6 GROUP BY doc_id)
"""


def explanation_ctes() -> str:
    head, tail = hybrid.MODEL_TEXT.split("%s with ")
    return f""", ranked_hits AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, rule_ord) AS rn FROM hits),
reasons AS (SELECT doc_id, string_agg(explanation, ' | ' ORDER BY rn) AS reasons,
    string_agg(rule_id, ' | ' ORDER BY rn) AS rule_ids FROM ranked_hits WHERE rn <= 3 GROUP BY doc_id),
told AS (
  SELECT v.doc_id, coalesce(r.reasons, {q(hybrid.NO_INDICATOR_TEXT)}) || ' | ' || {q(head)} || ml_label || ' with '
    || printf('%.1f%%', CAST(printf('%.1f', ml_p * 100e0) AS DOUBLE)) || {q(tail.replace('%s', ''))}
    || CASE WHEN classification <> ml_label THEN ' | ' || {q(hybrid.ADJUSTED_TEXT)} ELSE '' END || ' | '
    || CASE WHEN risk_score >= 65 THEN {q(hybrid.BLOCK_TEXT)} WHEN risk_score >= 35 THEN {q(hybrid.REVIEW_TEXT)}
       ELSE {q(hybrid.SAFE_TEXT)} END AS explanations,
    coalesce(r.rule_ids, '') AS rule_ids
  FROM verdict v LEFT JOIN reasons r ON r.doc_id = v.doc_id)
"""


ORACLE_SQL: dict[str, str] = {}

# --- rules ------------------------------------------------------------------------------

HITS = f"WITH {PROMPTS}, hits AS ({hits_sql('prompts', 'doc_id', 'prompt')}) "
ORACLE_SQL["rule_scan_hits"] = HITS + "SELECT doc_id, rule_id, category, label, weight FROM hits"
ORACLE_SQL["rule_evidence"] = HITS + "SELECT doc_id, rule_id, evidence FROM hits"
ORACLE_SQL["rule_scan_pages"] = (
    f"WITH hits AS ({hits_sql('pages', 'page_id', 'html')}) SELECT page_id, rule_id, evidence FROM hits"
)
ORACLE_SQL["rule_catalog_summary"] = (
    HITS
    + ", catalog AS (SELECT * FROM (VALUES "
    + ", ".join(f"({q(r.rule_id)}, {q(r.category)}, {r.weight})" for r in RULES)
    + ") AS t(rule_id, category, weight)), counted AS (SELECT rule_id, count(*) AS n FROM hits GROUP BY 1) "
    "SELECT category, count(*) AS rules, max(weight)::INTEGER AS max_weight, coalesce(sum(n), 0)::BIGINT AS hits "
    "FROM catalog LEFT JOIN counted USING (rule_id) GROUP BY category"
)
ORACLE_SQL["category_scores"] = scored() + "SELECT doc_id, label, rule_score::INTEGER AS rule_score FROM grid"
ORACLE_SQL["strongest_rule"] = scored() + "SELECT doc_id, s::INTEGER AS rule_score FROM verdict"

ORACLE_SQL["catalog_scan"] = r"""
WITH rule AS (
  SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{8,}')) AS word
  FROM (SELECT text FROM conversations UNION ALL SELECT text FROM benchmark)),
token AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM documents)
SELECT 'word:' || word AS rule_id, count(*) AS documents, min(doc_id) AS first_doc, word AS evidence
FROM rule JOIN token USING (word) GROUP BY word
"""

# --- hybrid verdict -----------------------------------------------------------------------

ORACLE_SQL["hybrid_scores"] = scored() + "SELECT doc_id, label, round(h, 6) AS hybrid_score FROM grid"
ORACLE_SQL["hybrid_classification"] = (
    scored() + "SELECT doc_id, ml_label, classification, confidence, confidence_percent FROM verdict"
)
ORACLE_SQL["override_classification"] = scored() + (
    "SELECT doc_id, CASE WHEN s >= 90 THEN by_rule ELSE 'Safe Prompt' END AS classification FROM picked"
)
ORACLE_SQL["weak_rule_risk"] = scored(rules=WEAK_RULES) + (
    "SELECT doc_id, classification, risk_score::INTEGER AS risk_score FROM verdict"
)
ORACLE_SQL["risk_profile"] = scored() + (
    "SELECT doc_id, risk_score::INTEGER AS risk_score, risk_level, severity FROM verdict"
)
ORACLE_SQL["risk_summary"] = scored(ADMITTED) + (
    "SELECT classification, risk_level, severity, count(*) AS prompts, max(risk_score)::INTEGER AS max_risk "
    "FROM verdict GROUP BY ALL"
)
ORACLE_SQL["mitigations_top6"] = scored() + mitigation_ctes() + "SELECT doc_id, mitigations FROM advice"
ORACLE_SQL["top3_indicators"] = scored() + explanation_ctes() + "SELECT doc_id, rule_ids FROM told"
ORACLE_SQL["explanations"] = scored() + explanation_ctes() + "SELECT doc_id, explanations FROM told"
ORACLE_SQL["ranked_probabilities"] = (
    f"WITH {LABEL_TABLE}, {probability_table()} SELECT doc_id, "
    "row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, class_ord)::INTEGER AS rank, label, "
    "CAST(printf('%.6f', p) AS DOUBLE) AS probability FROM probs JOIN labels_dim USING (label)"
)
ORACLE_SQL["rounded_scores"] = scored() + (
    "SELECT doc_id, label, CAST(printf('%.4f', p) AS DOUBLE) AS probability, CAST(printf('%.2f', h) AS DOUBLE) AS hybrid_score FROM grid"
)
RECORD_LISTS = """, listed AS (SELECT doc_id, string_agg(rule_id, ' | ' ORDER BY rule_ord) AS all_rules,
  string_agg(evidence, ' | ' ORDER BY rule_ord) AS evidence, count(*) AS n FROM hits GROUP BY doc_id)
"""
ORACLE_SQL["analysis_record"] = scored(ADMITTED) + mitigation_ctes() + explanation_ctes() + RECORD_LISTS + (
    "SELECT v.doc_id, p.prompt, v.classification, v.confidence, v.confidence_percent, "
    "v.risk_score::INTEGER AS risk_score, v.risk_level, v.severity, v.ml_label, CAST(printf('%.4f', v.ml_p) AS DOUBLE) AS ml_confidence, "
    "CAST(printf('%.4f', v.safe_p) AS DOUBLE) AS safe_probability, CAST(printf('%.2f', v.safe_h) AS DOUBLE) AS safe_hybrid, v.s::INTEGER AS rule_score, "
    "coalesce(l.all_rules, '') AS rule_ids, coalesce(l.evidence, '') AS evidence, t.explanations, a.mitigations "
    "FROM verdict v JOIN prompts p USING (doc_id) JOIN told t USING (doc_id) JOIN advice a USING (doc_id) "
    "LEFT JOIN listed l USING (doc_id)"
)
ORACLE_SQL["analysis_json"] = scored(ADMITTED) + RECORD_LISTS + (
    "SELECT v.doc_id, v.classification, v.risk_score::INTEGER AS risk_score, v.confidence, "
    "coalesce(l.n, 0)::BIGINT AS indicators, length(p.prompt)::BIGINT AS prompt_chars "
    "FROM verdict v JOIN prompts p USING (doc_id) LEFT JOIN listed l USING (doc_id)"
)
ORACLE_SQL["conversation_risk"] = (
    "WITH turns AS (SELECT row_number() OVER () AS turn_id, role, text FROM conversations), "
    f"hits AS ({hits_sql('turns', 'turn_id', 'text')}), "
    "top AS (SELECT turn_id, max(weight) AS w FROM hits GROUP BY 1) "
    "SELECT role, coalesce(w, 0)::INTEGER AS rule_score, count(*) AS turns FROM turns LEFT JOIN top USING (turn_id) GROUP BY ALL"
)

# --- admission and validation -------------------------------------------------------------

ORACLE_SQL["admission_reasons"] = (
    f"WITH stripped AS (SELECT {strip(fx.PLANTED)} AS prompt FROM documents) "
    "SELECT CASE WHEN prompt = '' THEN 'empty' WHEN length(prompt) > 20000 THEN 'too_long' ELSE 'accepted' END AS outcome, "
    "count(*) AS prompts, max(length(prompt))::BIGINT AS longest FROM stripped GROUP BY 1"
)
UNCHECKED = (
    "WITH unchecked AS (SELECT CASE WHEN source = 'src18' THEN ' ' || chr(9) || ' ' ELSE text END AS prompt, "
    "CASE WHEN source = 'src19' THEN 'Unlisted ' || lang WHEN source = 'src17' THEN ' ' "
    f"WHEN quality IS NOT NULL THEN {fx.LABEL} END AS label FROM documents LEFT JOIN labels USING (doc_id)), "
    f"flagged AS (SELECT *, label IS NOT NULL AND label NOT IN ({', '.join(map(q, LABELS))}) AS unknown FROM unchecked) "
)
ORACLE_SQL["validation_report"] = UNCHECKED + (
    f"SELECT count(*) AS rows, count(*) FILTER (WHERE prompt IS NULL OR {strip('prompt')} = '') AS blank_prompts, "
    f"count(*) FILTER (WHERE label IS NULL OR {strip('label')} = '') AS blank_labels, "
    "count(*) FILTER (WHERE unknown) AS unknown_rows FROM flagged"
)
ORACLE_SQL["label_domain_diff"] = UNCHECKED + (
    "SELECT label, count(*) AS rows FROM flagged WHERE unknown GROUP BY label"
)
ORACLE_SQL["null_counts"] = UNCHECKED + (
    "SELECT count(*) FILTER (WHERE prompt IS NULL) AS null_prompts, count(*) FILTER (WHERE label IS NULL) AS null_labels FROM flagged"
)
ORACLE_SQL["validation_errors"] = UNCHECKED + (
    f", report AS (SELECT count(*) FILTER (WHERE prompt IS NULL OR {strip('prompt')} = '') AS p, "
    f"count(*) FILTER (WHERE label IS NULL OR {strip('label')} = '') AS l, count(*) FILTER (WHERE unknown) AS u, "
    "count(DISTINCT label) FILTER (WHERE unknown) AS k, count(*) FILTER (WHERE label IS NULL) AS n FROM flagged), "
    "told AS (SELECT *, 'invalid labels: ' || k || ' labels in ' || u || ' rows (see invalid_labels)' AS unknown_text FROM report) "
    "SELECT 'corpus' AS check, 'Input validation failed: ' || concat_ws('; ', CASE WHEN p > 0 THEN p || ' missing/empty prompts' END, "
    "CASE WHEN l > 0 THEN l || ' missing/empty labels' END, CASE WHEN u > 0 THEN unknown_text END) AS error FROM told "
    "UNION ALL SELECT 'known', NULL "
    "UNION ALL SELECT 'columns', 'labels must contain exactly [''label'', ''prompt'']; found [''doc_id'', ''quality'', ''toxic'']' "
    "UNION ALL SELECT 'split', CASE WHEN n > 0 THEN 'split contains missing required values' "
    "WHEN u > 0 THEN 'split contains ' || unknown_text END FROM told"
)
ORACLE_SQL["normalized_prompt"] = (
    f"SELECT doc_id, {normalize(fx.PLANTED)} AS normalized_prompt, sha256({normalize(fx.PLANTED)}) AS prompt_key FROM documents"
)
ORACLE_SQL["text_profile"] = (
    f"WITH s AS (SELECT doc_id, {strip('text')} AS stripped FROM documents) "
    "SELECT doc_id, length(stripped)::BIGINT AS chars, sha256(stripped) AS digest, "
    "('0x' || substr(sha256(stripped), 1, 4))::BIGINT AS bucket FROM s"
)
ORACLE_SQL["source_lineage"] = (
    "SELECT doc_id, 'documents' AS source_dataset, 'given/documents.csv' AS source_file, "
    "(row_number() OVER (ORDER BY doc_id) + 1)::BIGINT AS source_row FROM documents"
)

# --- corpus preparation -------------------------------------------------------------------


def relabel_case(result: str, otherwise: str) -> str:
    whens = []
    for rule in RELABEL_RULES:
        if rule.pattern.startswith("^"):
            body = rule.pattern.replace(r"\s", WS)
            pattern = "(?i)" + body.removesuffix(r"\b") + f"(?:{NON_WORD}|$)"
        else:
            pattern = re2(rule.pattern, False)
        whens.append(
            "WHEN source_dataset = 'safe_evaluation' AND label = 'Safe Prompt' AND "
            f"regexp_matches(prompt, {q(pattern)}) THEN {q(getattr(rule, result))}"
        )
    return f"CASE {' '.join(whens)} ELSE {otherwise} END"


SOURCE_ORD = "CASE source_dataset " + " ".join(
    f"WHEN {q(n)} THEN {i}" for i, n in enumerate(SOURCE_ORDER)
) + f" ELSE {len(SOURCE_ORDER)} END"
MOVED = "'Duplicate prompt also appears in a threat dataset; resolved to ' || settled || '.'"
CORPUS = f"""WITH raw AS (
  SELECT text AS prompt, {fx.LABEL} AS label, {fx.SOURCE_DATASET} AS source_dataset,
    'corpus/' || {fx.SOURCE_DATASET} || '.csv' AS source_file, doc_id + 2 AS source_row
  FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT {fx.PLANTED}, 'Safe Prompt', 'safe_evaluation', 'corpus/planted_safe.csv', doc_id + 2 FROM documents
  UNION ALL SELECT replace({fx.PLANTED}, ' ', '  '), {fx.PLANTED_LABEL}, 'jailbreak', 'corpus/planted_threat.csv',
    doc_id + 2 FROM documents),
relabeled AS (
  SELECT prompt, {relabel_case('label', 'label')} AS prior_label, label AS original_label,
    {relabel_case('reason', 'NULL')} AS prior_reason, source_dataset, source_file, source_row FROM raw),
working AS (
  SELECT *, {normalize('prompt')} AS normalized_prompt, sha256({normalize('prompt')}) AS prompt_key,
    {SOURCE_ORD} AS source_ord FROM relabeled),
groups AS (
  SELECT prompt_key, count(DISTINCT prior_label) AS n_labels,
    count(DISTINCT prior_label) FILTER (WHERE prior_label <> 'Safe Prompt') AS n_threats,
    max(prior_label) FILTER (WHERE prior_label <> 'Safe Prompt') AS threat, max(prior_label) AS any_label, count(*) AS copies
  FROM working GROUP BY prompt_key),
settled AS (
  SELECT *, CASE WHEN n_labels = 1 THEN any_label WHEN n_labels = 2 AND n_threats = 1 THEN threat END AS settled FROM groups),
annotated AS (
  SELECT w.*, coalesce(settled, prior_label) AS label, n_labels > 1 AS in_conflict, settled IS NOT NULL AS resolvable,
    CASE WHEN n_labels > 1 AND prior_label = 'Safe Prompt' AND settled IS NOT NULL THEN {MOVED} ELSE prior_reason END
      AS relabel_reason,
    row_number() OVER (PARTITION BY w.prompt_key ORDER BY source_ord, source_file, source_row) = 1 AS is_first
  FROM working w JOIN settled s ON s.prompt_key = w.prompt_key),
cleaned AS (SELECT * FROM annotated WHERE resolvable AND is_first)
"""
SPLITS = """, digested AS (
  SELECT *, sha256('42|' || label || '|' || source_dataset || '|' || prompt_key) AS digest FROM cleaned),
ranked AS (
  SELECT *, count(*) OVER (PARTITION BY label, source_dataset) AS n,
    row_number() OVER (PARTITION BY label, source_dataset ORDER BY digest) AS rn FROM digested),
sized AS (SELECT *, greatest(1, CAST(printf('%.0f', n * 0.1e0) AS DOUBLE)::BIGINT) AS k FROM ranked),
assigned AS (
  SELECT *, CASE WHEN n < 3 THEN 'train' WHEN rn <= k THEN 'test' WHEN rn <= 2 * k THEN 'validation' ELSE 'train' END AS split
  FROM sized)
"""
ORACLE_SQL["relabel_safe"] = CORPUS + (
    "SELECT source_file, source_row, prior_label AS label, original_label, prior_reason AS relabel_reason FROM relabeled"
)
LABEL_LIST = "string_agg(DISTINCT prior_label, ' | ' ORDER BY CASE prior_label " + " ".join(
    f"WHEN {q(n)} THEN {i}" for i, n in enumerate(LABELS)
) + " END)"
ORACLE_SQL["conflict_groups"] = CORPUS + (
    ", distinct_labels AS (SELECT DISTINCT prompt_key, prior_label FROM working) "
    f"SELECT prompt_key, {LABEL_LIST.replace('DISTINCT ', '')} AS labels, any_value(copies) AS rows, "
    "any_value(settled) AS resolved_label FROM distinct_labels JOIN settled USING (prompt_key) WHERE n_labels > 1 GROUP BY prompt_key"
)
ORACLE_SQL["conflict_rows"] = CORPUS + (
    "SELECT source_file, source_row, prior_label AS label, prompt_key FROM annotated WHERE in_conflict"
)
ORACLE_SQL["resolved_labels"] = CORPUS + (
    "SELECT source_file, source_row, label, relabel_reason, in_conflict, resolvable, is_first FROM annotated"
)
ORACLE_SQL["dedup_keep_first"] = CORPUS + (
    "SELECT prompt_key, source_file, source_row, label, original_label, relabel_reason FROM cleaned"
)
ORACLE_SQL["dropped_duplicates"] = CORPUS + (
    "SELECT source_file, source_row, label FROM annotated WHERE resolvable AND NOT is_first"
)
ORACLE_SQL["conflict_relabels"] = CORPUS + (
    "SELECT source_file, source_row, label, original_label, relabel_reason FROM annotated "
    "WHERE in_conflict AND resolvable AND original_label <> label"
)
ORACLE_SQL["quarantined_rows"] = CORPUS + (
    "SELECT source_file, source_row, label, prompt_key FROM annotated WHERE NOT resolvable"
)
ORACLE_SQL["remaining_conflicts"] = CORPUS + (
    "SELECT count(*) AS groups FROM (SELECT prompt_key FROM cleaned GROUP BY 1 HAVING count(*) > 1 OR count(DISTINCT label) > 1)"
)
ORACLE_SQL["relabel_audit"] = CORPUS + (
    ", changed AS (SELECT *, 0 AS branch FROM cleaned WHERE relabel_reason IS NOT NULL OR original_label <> label "
    "UNION ALL SELECT *, 1 FROM annotated WHERE in_conflict AND resolvable AND original_label <> label) "
    "SELECT prompt, original_label, label, relabel_reason, source_dataset, source_file, source_row FROM changed "
    "QUALIFY row_number() OVER (PARTITION BY source_file, source_row ORDER BY branch) = 1"
)
ORACLE_SQL["prepared_corpus"] = CORPUS + f"SELECT {', '.join(PREPARED_COLUMNS)} FROM cleaned"
COUNTERS = (
    "SELECT count(*) AS input_rows, count(*) FILTER (WHERE resolvable AND is_first) AS unique_rows, "
    "count(*) FILTER (WHERE resolvable AND NOT is_first) AS removed_duplicates, "
    "count(*) FILTER (WHERE in_conflict) AS conflicting_rows, "
    "count(*) FILTER (WHERE prior_reason IS NOT NULL) AS relabeled_before_resolution, "
    "count(*) FILTER (WHERE in_conflict AND resolvable AND original_label <> label) AS relabeled_during_resolution, "
    "count(*) FILTER (WHERE NOT resolvable) AS quarantined_rows FROM annotated"
)
ORACLE_SQL["prep_counters"] = CORPUS + COUNTERS
ORACLE_SQL["class_distribution"] = CORPUS + "SELECT label, count(*) AS rows FROM cleaned GROUP BY 1"
ORACLE_SQL["source_distribution"] = CORPUS + "SELECT source_dataset, count(*) AS rows FROM cleaned GROUP BY 1"
ORACLE_SQL["stratified_split"] = CORPUS + SPLITS + "SELECT prompt_key, label, source_dataset, split FROM assigned"
ORACLE_SQL["split_rows"] = CORPUS + SPLITS + (
    "SELECT prompt, label, source_dataset FROM assigned WHERE split = 'test'"
)
GROUPED = "GROUP BY GROUPING SETS ((split), (split, label), (split, source_dataset))"
ORACLE_SQL["split_report"] = CORPUS + SPLITS + (
    f"SELECT split, label, source_dataset, count(*) AS rows FROM assigned {GROUPED}"
)
OVERLAP = (
    "SELECT (SELECT count(*) FROM (SELECT prompt_key FROM assigned WHERE split = 'train' INTERSECT SELECT prompt_key FROM assigned WHERE split = 'validation')) AS train_validation, "
    "(SELECT count(*) FROM (SELECT prompt_key FROM assigned WHERE split = 'train' INTERSECT SELECT prompt_key FROM assigned WHERE split = 'test')) AS train_test, "
    "(SELECT count(*) FROM (SELECT prompt_key FROM assigned WHERE split = 'validation' INTERSECT SELECT prompt_key FROM assigned WHERE split = 'test')) AS validation_test"
)
ORACLE_SQL["split_overlap"] = CORPUS + SPLITS + OVERLAP
ORACLE_SQL["csv_sources"] = (
    f"SELECT sha256(text) AS prompt_digest, {fx.LABEL} AS label, {fx.SOURCE_DATASET} AS source_dataset, "
    f"'raw/' || {fx.SOURCE_DATASET} AS source_file FROM documents JOIN labels USING (doc_id)"
)
ORACLE_SQL["csv_record_numbers"] = "SELECT count(*) AS records, true AS dense FROM documents JOIN labels USING (doc_id)"
ORACLE_SQL["side_source"] = "SELECT count(*) AS side_rows, NULL::BIGINT AS absent_rows FROM pages"
ORACLE_SQL["written_prepared"] = CORPUS + (
    "SELECT sha256(prompt) AS prompt_digest, label, source_dataset, source_file, source_row, original_label, relabel_reason, "
    "prompt_key FROM cleaned"
)
ORACLE_SQL["loaded_splits"] = CORPUS + SPLITS + (
    "SELECT split, label, source_dataset, count(*) AS rows, sum(length(prompt))::BIGINT AS chars FROM assigned GROUP BY ALL"
)
ORACLE_SQL["written_audit"] = ORACLE_SQL["relabel_audit"].replace(
    "SELECT prompt, original_label, label,", "SELECT sha256(prompt) AS prompt_digest, original_label, label,"
)
ORACLE_SQL["prep_report"] = CORPUS + SPLITS + f""", counters AS ({COUNTERS}), overlap AS ({OVERLAP})
SELECT 'counters' AS section, name, value FROM (UNPIVOT counters ON COLUMNS(*) INTO NAME name VALUE value)
UNION ALL SELECT 'counters', 'excluded_rows', count(*) FROM pages
UNION ALL SELECT 'overlap', name, value FROM (UNPIVOT overlap ON COLUMNS(*) INTO NAME name VALUE value)
UNION ALL SELECT 'classes', label, count(*) FROM cleaned GROUP BY label
UNION ALL SELECT 'sources', source_dataset, count(*) FROM cleaned GROUP BY source_dataset
UNION ALL SELECT 'split.' || split, coalesce(label, source_dataset, 'rows'), count(*) FROM assigned {GROUPED}"""

# --- evaluation ---------------------------------------------------------------------------

LABELLED = (
    f"WITH {LABEL_TABLE}, labelled AS (SELECT doc_id, {fx.LABEL} AS label, {fx.SOURCE_DATASET} AS source_dataset, "
    f"{fx.EVAL_SPLIT} AS split FROM documents JOIN labels USING (doc_id)), "
    f"scored AS (SELECT *, {fx.PREDICTION} AS prediction, {fx.CONFIDENCE} AS confidence FROM labelled), "
    "preds AS (SELECT *, confidence - (1e0 - confidence) / 4e0 AS confidence_margin FROM scored) "
)


def class_ctes(by: str = "", source: str = "preds") -> str:
    """cm: per slice and label, support / predicted / hits and the scores; zero-filled."""
    keys = f"{by}, " if by else ""
    match = f" AND p.{by} = g.{by}" if by else ""
    slices = f"(SELECT DISTINCT {by} FROM {source}) CROSS JOIN " if by else ""
    return f""", cm_grid AS (SELECT {keys}label FROM {slices}labels_dim),
cm_counts AS (
  SELECT {', '.join(f'g.{c}' for c in ([by] if by else []) + ['label'])},
    (SELECT count(*) FROM {source} p WHERE p.label = g.label{match}) AS support,
    (SELECT count(*) FROM {source} p WHERE p.prediction = g.label{match}) AS predicted,
    (SELECT count(*) FROM {source} p WHERE p.prediction = g.label AND p.label = g.label{match}) AS hits
  FROM cm_grid g),
cm AS (
  SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0e0 END AS precision,
    CASE WHEN support > 0 THEN hits / support ELSE 0e0 END AS recall,
    CASE WHEN support + predicted > 0 THEN 2 * hits / (support + predicted) ELSE 0e0 END AS f1
  FROM cm_counts)
"""


OVERALL = (
    "sum(support)::BIGINT AS rows, round(sum(hits) / sum(support), 9) AS accuracy, round(avg(f1), 9) AS macro_f1, "
    "round(sum(f1 * support) / sum(support), 9) AS weighted_f1"
)
CLASS_COLUMNS = "label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support"
BALANCED = "sum(n) OVER () / (count(*) OVER () * n)"
ORACLE_SQL["class_weights"] = LABELLED + (
    ", c AS (SELECT label, count(*) AS n FROM labelled GROUP BY label) "
    f"SELECT label, n AS rows, round({BALANCED}, 9) AS balanced, round(sqrt({BALANCED}), 9) AS sqrt_balanced FROM c"
)
ORACLE_SQL["confusion_matrix"] = LABELLED + (
    "SELECT l.label AS actual, "
    + ", ".join(f"count(*) FILTER (WHERE prediction = {q(n)}) AS \"predicted::{n}\"" for n in LABELS)
    + " FROM labels_dim l LEFT JOIN preds p ON p.label = l.label GROUP BY l.label"
)
ORACLE_SQL["class_metrics"] = LABELLED + class_ctes() + f"SELECT {CLASS_COLUMNS} FROM cm"
ORACLE_SQL["overall_metrics"] = LABELLED + class_ctes() + f"SELECT {OVERALL} FROM cm"
ORACLE_SQL["class_metrics_by_source"] = LABELLED + class_ctes("source_dataset") + (
    f"SELECT source_dataset, {CLASS_COLUMNS} FROM cm WHERE support > 0"
)
ORACLE_SQL["metrics_by_source"] = LABELLED + class_ctes("source_dataset") + (
    f"SELECT source_dataset, {OVERALL} FROM cm WHERE support > 0 GROUP BY source_dataset"
)


def average(kind: str, column: str) -> str:
    return f"avg({column})" if kind == "macro" else f"sum({column} * support) / sum(support)"


ORACLE_SQL["classification_report"] = LABELLED + class_ctes() + (
    ", r AS (SELECT label_ord AS row_ord, label AS name, precision, recall, f1 AS f1_score, support::DOUBLE AS support "
    "FROM cm JOIN labels_dim USING (label) "
    "UNION ALL SELECT 5, 'accuracy', a, a, a, a FROM (SELECT sum(hits) / sum(support) AS a FROM cm) "
    + " ".join(
        f"UNION ALL SELECT {i}, '{k} avg', {average(k, 'precision')}, {average(k, 'recall')}, {average(k, 'f1')}, sum(support)::DOUBLE FROM cm"
        for i, k in ((6, "macro"), (7, "weighted"))
    )
    + ") SELECT row_ord::INTEGER AS row_ord, name, round(precision, 9) AS precision, round(recall, 9) AS recall, "
    "round(f1_score, 9) AS f1_score, round(support, 9) AS support FROM r"
)
SLICED = ", sliced AS (SELECT 'all' AS slice, * FROM preds UNION ALL SELECT source_dataset, * FROM preds)"
SLICE_ROWS = "slice = 'all' OR support > 0"
ORACLE_SQL["metrics_document"] = LABELLED + SLICED + class_ctes("slice", "sliced") + (
    f", kept AS (SELECT * FROM cm WHERE {SLICE_ROWS}), "
    f"whole AS (SELECT slice, {OVERALL} FROM kept GROUP BY slice), out AS ("
    + " UNION ALL ".join(
        f"SELECT slice, label, '{m}' AS metric, {m}::DOUBLE AS value FROM kept"
        for m in ("precision", "recall", "f1", "support")
    )
    + " UNION ALL "
    + " UNION ALL ".join(
        f"SELECT slice, 'all', '{m}', {m}::DOUBLE FROM whole" for m in ("rows", "accuracy", "macro_f1", "weighted_f1")
    )
    + ") SELECT slice, label, metric, round(value, 9) AS value FROM out"
)
ORACLE_SQL["written_evaluation"] = LABELLED + (
    ", facts AS (SELECT split, count(*) AS n, count(*) FILTER (WHERE label = prediction) AS good, "
    "count(*) FILTER (WHERE label <> prediction AND confidence >= 0.9e0) AS issues FROM preds GROUP BY split) "
    "SELECT split, 'predictions' AS sink, n AS rows, good AS value FROM facts "
    "UNION ALL SELECT split, 'highest_confidence_errors', least(n - good, 200), least(n - good, 200) FROM facts "
    "UNION ALL SELECT split, 'confusion_matrix', 5, n FROM facts "
    "UNION ALL SELECT split, 'classification_report', 8, n FROM facts "
    "UNION ALL SELECT split, 'metrics', 1, n FROM facts "
    "UNION ALL SELECT split, 'probable_label_issues', issues, issues FROM facts WHERE issues > 0"
)
ORACLE_SQL["error_counts"] = LABELLED + (
    "SELECT source_dataset, label = prediction AS correct, count(*) AS rows FROM preds GROUP BY ALL"
)
ORACLE_SQL["top_errors"] = LABELLED + (
    "SELECT doc_id, label, prediction, round(confidence, 9) AS confidence, round(confidence_margin, 9) AS confidence_margin "
    "FROM (SELECT * FROM preds WHERE label <> prediction ORDER BY confidence DESC, confidence_margin DESC, doc_id LIMIT 200)"
)
ORACLE_SQL["label_issues"] = LABELLED + (
    "SELECT doc_id, label, source_dataset, split, prediction, round(confidence, 9) AS confidence FROM preds "
    "WHERE label <> prediction AND confidence >= 0.9e0"
)
ORACLE_SQL["confidence_margin"] = (
    f"WITH {probability_table()}, r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC) AS rn FROM probs) "
    "SELECT doc_id, round(max(p) FILTER (WHERE rn = 1), 9) AS confidence, "
    "round(max(p) FILTER (WHERE rn = 1) - max(p) FILTER (WHERE rn = 2), 9) AS margin FROM r GROUP BY doc_id"
)
ORACLE_SQL["candidate_selection"] = LABELLED + (
    ", cands AS (SELECT 'balanced' AS candidate, 0 AS candidate_ord, label, prediction FROM preds UNION ALL "
    "SELECT 'sqrt_balanced', 1, label, CASE WHEN confidence > 0.8e0 THEN label ELSE prediction END FROM preds)"
    + class_ctes("candidate", "cands")
    + ", s AS (SELECT candidate, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1 FROM cm GROUP BY candidate) "
    "SELECT candidate, round(macro_f1, 9) AS macro_f1, round(weighted_f1, 9) AS weighted_f1 FROM s "
    "ORDER BY s.macro_f1 DESC, s.weighted_f1 DESC, candidate LIMIT 1"
)

# --- features and model -------------------------------------------------------------------

TERMS = r"""WITH tok AS (
  SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]{2,}') AS tokens FROM documents),
grams AS (
  SELECT doc_id, tokens, list_concat(tokens, list_transform(range(1, len(tokens)),
    lambda i: tokens[i] || ' ' || tokens[i + 1])) AS grams FROM tok),
occurrences AS (SELECT doc_id, unnest(grams) AS term FROM grams),
doc_terms AS (SELECT doc_id, term, count(*) AS tf FROM occurrences GROUP BY ALL),
stats AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM doc_terms GROUP BY term)
"""
N_DOCS = "(SELECT count(*) FROM documents)"
VOCAB = f""", kept AS (
  SELECT * FROM stats WHERE df >= 2 AND df <= 0.995e0 * {N_DOCS} ORDER BY tf DESC, term LIMIT {MAX_FEATURES}),
vocab AS (
  SELECT *, (row_number() OVER (ORDER BY term) - 1)::INTEGER AS term_id, ln((1 + {N_DOCS}) / (1 + df)) + 1e0 AS idf FROM kept),
weights AS (SELECT doc_id, term, term_id, (1e0 + ln(d.tf)) * idf AS w FROM doc_terms d JOIN vocab USING (term)),
norms AS (SELECT doc_id, count(*) AS nonzero, sqrt(sum(w * w)) AS norm FROM weights GROUP BY doc_id)
"""
COEFS = f""", names AS (SELECT unnest([{', '.join(map(q, LABELS))}]) AS label),
coefs AS (
  SELECT term, label, ('0x' || substr(sha256(term || label), 1, 6))::BIGINT / 16777216e0 * 4e0 - 2e0 AS coefficient
  FROM vocab CROSS JOIN names),
dots AS (SELECT doc_id, label, sum(w * coefficient) AS dot FROM weights JOIN coefs USING (term) GROUP BY ALL),
margins AS (
  SELECT d.doc_id, n.label, coalesce(dot / norm, 0e0) + CASE n.label
    {' '.join(f'WHEN {q(n)} THEN {b!r}::DOUBLE' for n, b in INTERCEPTS.items())} END AS m
  FROM documents d CROSS JOIN names n LEFT JOIN dots ON dots.doc_id = d.doc_id AND dots.label = n.label
  LEFT JOIN norms ON norms.doc_id = d.doc_id),
softmax AS (SELECT *, exp(m) / sum(exp(m)) OVER (PARTITION BY doc_id) AS p FROM margins)
"""
ORACLE_SQL["token_counts"] = TERMS + (
    "SELECT doc_id, len(tokens) AS tokens, len(grams) AS grams, len(list_distinct(grams)) AS terms FROM grams"
)
ORACLE_SQL["term_stats"] = TERMS + "SELECT term, df, tf FROM stats"
ORACLE_SQL["vocabulary_topk"] = TERMS + VOCAB + "SELECT term, term_id, df, tf, round(idf, 9) AS idf FROM vocab"
ORACLE_SQL["tfidf_weights"] = TERMS + VOCAB + (
    "SELECT doc_id, term_id, round(w / norm, 9) AS weight FROM weights JOIN norms USING (doc_id)"
)
ORACLE_SQL["document_norms"] = TERMS + VOCAB + "SELECT doc_id, nonzero, round(norm, 6) AS norm FROM norms"
ORACLE_SQL["matrix_stats"] = TERMS + VOCAB + (
    "SELECT count(*) AS nonzero, count(DISTINCT term_id) AS terms_used FROM weights"
)
ORACLE_SQL["linear_scores"] = TERMS + VOCAB + COEFS + (
    "SELECT doc_id, label, round(m, 6) AS margin, round(p, 6) AS probability FROM softmax"
)
ORACLE_SQL["model_probabilities"] = TERMS + VOCAB + COEFS + (
    "SELECT doc_id, label, round(p, 6) AS probability FROM softmax"
)
ORACLE_SQL["batch_classification"] = TERMS + VOCAB + COEFS + (
    "SELECT doc_id, arg_max(label, p) AS classification, CAST(printf('%.6f', max(p)) AS DOUBLE) AS confidence, "
    "string_agg(label, ' | ' ORDER BY p DESC, label) AS ranking FROM softmax GROUP BY doc_id"
)
ORACLE_SQL["top_features"] = TERMS + VOCAB + COEFS + (
    "SELECT label, rank::INTEGER AS rank, term AS feature, round(coefficient, 9) AS coefficient FROM "
    "(SELECT *, row_number() OVER (PARTITION BY label ORDER BY coefficient DESC, term) AS rank FROM coefs) WHERE rank <= 30"
)

# The labelled part of the corpus alone, split; then the facts of a training run on it.
LABELLED_CORPUS = CORPUS.replace(
    CORPUS[CORPUS.index("  UNION ALL SELECT") : CORPUS.index("),\nrelabeled AS")], ""
)
TRAIN_TERMS = TERMS.replace("WITH tok AS", ", tok AS").replace("FROM documents)", "FROM train_docs)", 1)
ORACLE_SQL["train_and_evaluate"] = LABELLED_CORPUS + SPLITS + (
    ", train_docs AS (SELECT prompt_key AS doc_id, prompt AS text FROM assigned WHERE split = 'train') "
    + TRAIN_TERMS
    + ", classes AS (SELECT label, count(*) AS n FROM assigned WHERE split = 'train' GROUP BY label), "
    "held_out AS (SELECT label, count(*) AS n FROM assigned WHERE split <> 'train' GROUP BY label) "
    f"SELECT label, round({BALANCED.replace('n)', 'c.n)')}, 9) AS balanced, round(sqrt({BALANCED.replace('n)', 'c.n)')}), 9) AS sqrt_balanced, "
    "coalesce(h.n, 0) AS held_out_rows, "
    + ", ".join(f"(SELECT count(*) FROM assigned WHERE split = '{name}') AS {name}_rows" for name in ("train", "validation", "test"))
    + f", (SELECT least({MAX_FEATURES}, count(*)) FROM stats WHERE df >= 2 AND df <= 0.995e0 * (SELECT count(*) FROM train_docs)) AS vocabulary_size, "
    "true AS converged, true AS gradient_is_small, true AS best_is_selected FROM classes c LEFT JOIN held_out h USING (label)"
)

# --- history and streams ------------------------------------------------------------------

LOG = (
    "WITH logged AS (SELECT 'evt-' || event_id AS id, ts, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at, props AS prompt, "
    f"{fx.EVENT_CLASS} AS classification, {fx.EVENT_CONFIDENCE} AS confidence, {fx.EVENT_RISK} AS risk_score FROM events), "
    f"log AS (SELECT *, {level_sql()} AS risk_level, {severity_sql()} AS severity FROM logged) "
)
LISTING = "id, created_at, prompt, classification, confidence, risk_score, risk_level, severity"
ORACLE_SQL["history_recent"] = LOG + f"SELECT {LISTING} FROM (SELECT * FROM log ORDER BY ts DESC, id LIMIT 25)"
ORACLE_SQL["history_lookup"] = LOG + f"SELECT {LISTING} FROM log WHERE id = 'evt-321'"
ORACLE_SQL["log_recent"], ORACLE_SQL["log_lookup"] = ORACLE_SQL["history_recent"], ORACLE_SQL["history_lookup"]
HEADLINE = (
    "SELECT count(*) AS total, count(*) FILTER (WHERE classification = 'Safe Prompt') AS safe, "
    "count(*) FILTER (WHERE classification <> 'Safe Prompt') AS threats, "
    "count(*) FILTER (WHERE risk_score >= 65) AS high_risk FROM log"
)
MIX = "SELECT classification AS label, count(*) AS count FROM log GROUP BY 1"
TREND = (
    "SELECT substr(created_at, 1, 10) AS day, count(*) AS count, "
    "sum(CASE WHEN classification = 'Safe Prompt' THEN 0 ELSE 1 END)::BIGINT AS threats FROM log GROUP BY 1"
)
ORACLE_SQL["history_counts"] = ORACLE_SQL["stream_counts"] = ORACLE_SQL["log_append"] = LOG + HEADLINE
ORACLE_SQL["log_clear"] = LOG + (
    "SELECT count(*) AS before, 0::BIGINT AS after, count(*) FILTER (WHERE risk_score >= 90) AS again FROM log"
)
ORACLE_SQL["history_by_type"] = ORACLE_SQL["stream_class_mix"] = LOG + MIX
ORACLE_SQL["history_trend"] = ORACLE_SQL["stream_trend"] = ORACLE_SQL["stream_trend_bounded"] = LOG + TREND
ORACLE_SQL["stream_score"] = scored(ADMITTED) + RECORD_LISTS + (
    "SELECT sha256(p.prompt) AS prompt_digest, v.classification, v.confidence, v.risk_score::INTEGER AS risk_score, "
    "v.risk_level, v.severity, coalesce(l.all_rules, '') AS rule_ids "
    "FROM verdict v JOIN prompts p USING (doc_id) LEFT JOIN listed l USING (doc_id)"
)
# The main path: probabilities of the stand-in model over the admitted prompts, in place of those of the fixtures.
MODEL_PROBS = (TERMS + VOCAB + COEFS).replace("WITH tok AS", "tok AS", 1).replace("lower(text)", "lower(prompt)").replace(
    "FROM documents", "FROM prompts"
) + ", probs AS (SELECT doc_id, label, p FROM softmax)"
ORACLE_SQL["model_verdicts"] = scored(ADMITTED).replace(probability_table(), MODEL_PROBS) + (
    "SELECT doc_id, ml_label, CAST(printf('%.4f', ml_p) AS DOUBLE) AS ml_confidence, classification, confidence, "
    "risk_score::INTEGER AS risk_score, risk_level, severity FROM verdict"
)
ORACLE_SQL["stream_verdicts"] = ORACLE_SQL["stream_score"].replace(probability_table(), MODEL_PROBS)
assert set(THREATS) < set(LABELS)

# --- report -------------------------------------------------------------------------------

_FIELDS = (
    ("Generated", "'2024-01-31 00:00:00'"), ("Analysis ID", "doc_id::VARCHAR"), None, ("Classification", "classification"),
    ("Confidence", "confidence_percent::VARCHAR || '%'"), ("Risk Score", "risk_score::INTEGER::VARCHAR"),
    ("Risk Level", "risk_level"), ("Severity", "severity"), None,
)
_HEAD = ", ".join([q(report.TITLE), *("''" if f is None else f"{q(f[0] + ': ')} || {f[1]}" for f in _FIELDS), "'Triggered Indicators:'"])
ORACLE_SQL["report_blocks"] = scored(ADMITTED) + mitigation_ctes() + explanation_ctes() + f""", part AS (
  SELECT doc_id, 0 AS section, generate_subscripts(head, 1) AS item, unnest(head) AS text, 0 AS width
  FROM (SELECT doc_id, [{_HEAD}] AS head FROM verdict)
  UNION ALL SELECT doc_id, 1, 2 * rule_ord, '- ' || rule_id || ' | ' || category || ' | ' || label, 0 FROM hits
  UNION ALL SELECT doc_id, 1, 2 * rule_ord + 1, '  Evidence: ' || evidence, {report.EVIDENCE_WIDTH} FROM hits WHERE evidence <> ''
  UNION ALL SELECT doc_id, 1, 0, '- None', 0 FROM verdict WHERE doc_id NOT IN (SELECT doc_id FROM hits)
  UNION ALL SELECT doc_id, section, item, unnest(['', title]), 0 FROM verdict,
    (VALUES (2, 0, 'Explanation:'), (4, 0, 'Mitigation Recommendations:'), (6, 0, 'Original Prompt:')) AS t(section, item, title)
  UNION ALL SELECT doc_id, 3, generate_subscripts(string_split(explanations, ' | '), 1),
    '- ' || unnest(string_split(explanations, ' | ')), {report.TEXT_WIDTH} FROM told
  UNION ALL SELECT doc_id, 5, generate_subscripts(string_split(mitigations, ' | '), 1),
    '- ' || unnest(string_split(mitigations, ' | ')), {report.TEXT_WIDTH} FROM advice
  UNION ALL SELECT doc_id, 7, 0, prompt, {report.TEXT_WIDTH} FROM prompts)
SELECT doc_id::VARCHAR AS id, (row_number() OVER (PARTITION BY doc_id ORDER BY section, item, text <> '') - 1)::INTEGER AS block_no,
  text, width::INTEGER AS width FROM part
"""

# Blocks wrapped greedily, a line a round. Pieces are told apart by a mark: words end at blanks, after a hyphen between
# letters, and around dashes. RE2 cannot look around, so hyphenated words are cut by a test at each of their positions.
_MARK = "chr(1)"
_LT, _WP, _WD = r"[\p{L}\p{Nl}\p{No}_]", r"[\p{L}\p{N}_!\x22''&.,?]", r"[\p{L}\p{N}_]"
_CUT_AFTER = f"""(
  regexp_matches(substr(w, 1, i), '({_LT}{_LT}|{_LT}-{_WP})-$') AND regexp_matches(substr(w, i + 1), '^{_LT}-?{_LT}')
  OR regexp_matches(substr(w, 1, i), '{_WP}$') AND regexp_matches(substr(w, i + 1), '^--+{_WD}')
  OR regexp_matches(substr(w, 1, i), '{_WP}--+$') AND regexp_matches(substr(w, i + 1), '^{_WD}'))"""
_CUT_WORD = (
    "CASE WHEN contains(w, '-') THEN list_aggregate(list_transform(range(1, length(w) + 1), lambda i: substr(w, i, 1) || "
    f"CASE WHEN i < length(w) AND {_CUT_AFTER} THEN {_MARK} ELSE '' END), 'string_agg', '') ELSE w END"
)
_NO_TABS = (
    "CASE WHEN contains(text, chr(9)) THEN array_to_string(list_transform(regexp_split_to_array(text, '[\\n\\r]'), "
    "lambda line: array_to_string(list_transform(string_split(line, chr(9)), lambda cell, n: "
    "CASE WHEN n < len(string_split(line, chr(9))) THEN cell || repeat(' ', 8 - length(cell) % 8) ELSE cell END), '')), ' ') "
    "ELSE text END"
)


def _blank(x: str) -> str:
    return f"NOT regexp_matches({x}, '[^{WS[1:-1]}]')"


ORACLE_SQL["report_lines"] = ORACLE_SQL["report_blocks"].replace("WITH ", "WITH RECURSIVE ", 1).replace(
    "SELECT doc_id::VARCHAR AS id, (row_number()", ", blocks AS (SELECT doc_id::VARCHAR AS id, (row_number()"
) + f"""),
flat AS (SELECT id, block_no, width, regexp_replace({_NO_TABS}, '[\\t\\n\\x0b\\x0c\\r]', ' ', 'g') AS text FROM blocks WHERE width > 0),
marked AS (
  SELECT id, block_no, width, array_to_string(list_transform(regexp_extract_all(text, ' +|[^ ]+'), lambda w: {_CUT_WORD}), {_MARK}) AS rest
  FROM flat),
wrapped AS (
  SELECT id, block_no, width, 0 AS line_no, rest, NULL::VARCHAR AS line, false AS any_line FROM marked
  UNION ALL
  SELECT id, block_no, width, line_no + 1,
    CASE WHEN next_is_long THEN substr(after, piece_end + 1) ELSE after END,
    CASE WHEN next_is_long THEN head || CASE WHEN {_blank("substr(after, 1, piece_end)")} THEN '' ELSE substr(after, 1, piece_end) END
      ELSE array_to_string(shown, '') END,
    any_line OR (CASE WHEN next_is_long THEN head || CASE WHEN {_blank("substr(after, 1, piece_end)")} THEN '' ELSE substr(after, 1, piece_end) END
      ELSE array_to_string(shown, '') END) <> ''
  FROM (
    SELECT *, CASE WHEN length(upcoming) > space AND hyphen > 1 AND regexp_matches(substr(upcoming, 1, hyphen - 1), '[^-]')
        THEN hyphen ELSE space END AS piece_end
    FROM (
      SELECT *,
        CASE WHEN contains(substr(upcoming, 1, space), '-') THEN space - instr(reverse(substr(upcoming, 1, space)), '-') + 1 ELSE 0 END AS hyphen
      FROM (
        SELECT *, length(upcoming) > width AS next_is_long, width - length(head) AS space,
          CASE WHEN k > 0 AND {_blank("cells[k]")} THEN cells[1:k - 1] ELSE cells[1:k] END AS shown
        FROM (
          SELECT *, CASE WHEN contains(after, {_MARK}) THEN substr(after, 1, instr(after, {_MARK}) - 1) ELSE after END AS upcoming
          FROM (
            SELECT *, array_to_string(cells[1:k], '') AS head,
              substr(begun, length(array_to_string(cells[1:k], {_MARK})) + CASE WHEN k > 0 THEN 2 ELSE 1 END) AS after
            FROM (
              SELECT *, len(list_filter(range(1, len(cells) + 1), lambda n: list_sum(list_transform(cells[1:n], lambda c: length(c))) <= width)) AS k
              FROM (
                SELECT *, string_split(substr(begun, 1, 2 * width + 2), {_MARK}) AS cells
                FROM (
                  SELECT * REPLACE (NULL AS line), CASE WHEN any_line AND {_blank(f"string_split(substr(rest, 1, 2 * width + 2), {_MARK})[1]")}
                    THEN CASE WHEN contains(rest, {_MARK}) THEN substr(rest, instr(rest, {_MARK}) + 1) ELSE '' END ELSE rest END AS begun
                  FROM wrapped WHERE rest <> ''))))))))),
every_line AS (
  SELECT id, block_no, 0 AS line_no, text AS line FROM blocks WHERE width = 0
  UNION ALL SELECT id, block_no, line_no, line FROM wrapped WHERE line <> '')
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY block_no, line_no) - 1)::INTEGER AS line_no, line FROM every_line
"""
