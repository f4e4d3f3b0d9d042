"""Evidence documents: spans, recommended action, record, Markdown text.

All of it is row-local: spans come from the phrase hits the severity step found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prioscope.config import AuditConfig
from prioscope.functions import text as T
from prioscope.operators.signals import num

SPAN_TYPE = (
    "ARRAY<STRUCT<span: STRING, verbatim_context: STRING, signal_level: INT, char_position: INT>>"
)
ATTRIBUTION_TYPE = (
    "ARRAY<STRUCT<feature: STRING, human_name: STRING, shap_value: DOUBLE, direction: STRING>>"
)


def evidence_spans(text: str, hits: str, config: AuditConfig = AuditConfig()) -> str:
    """The strongest distinct phrases, verbatim, with their surroundings.

    Low-level phrases are no evidence. A span that repeats keeps its first
    occurrence; spans are ordered by level, then position.
    """
    n = config.context_chars
    first = "get(filter(strong, h -> lower(h.matched) = k), 0)"
    keys = "array_distinct(transform(strong, h -> lower(h.matched)))"
    ranked = (
        f"array_sort(transform(transform({keys}, k -> {first}), (h, i) -> "
        "named_struct('o', -h.level_score, 'p', h.char_pos, 'i', i, 'm', h.matched)))"
    )
    start = f"greatest(0, s.p - {n})"
    end = f"least(length({text}), s.p + length(s.m) + {n})"
    context = (
        f"concat(IF({start} > 0, '...', ''), "
        f"trim(substring({text}, {start} + 1, {end} - {start})), "
        f"IF({end} < length({text}), '...', ''))"
    )
    spans = (
        f"transform(slice({ranked}, 1, {config.top_spans}), s -> named_struct("
        f"'span', s.m, 'verbatim_context', {context}, "
        "'signal_level', -s.o, 'char_position', s.p))"
    )
    return T.let("strong", f"filter({hits}, h -> h.level_score > 0)", spans)


def _flagged(predicted: str, probability: str, config: AuditConfig) -> str:
    return f"{predicted} = 1 AND {probability} >= {num(config.action_min_probability)}"


def recommended_action(config: AuditConfig = AuditConfig()) -> str:
    flagged = _flagged("mismatch_predicted", "mismatch_probability", config)
    return (
        f"CASE WHEN NOT coalesce({flagged}, false) THEN 'OK' "
        "WHEN mismatch_direction = 'UNDER-PRIORITISED' AND inferred_severity = 'critical' "
        "THEN 'ESCALATE IMMEDIATELY' "
        "WHEN mismatch_direction = 'UNDER-PRIORITISED' THEN 'ESCALATE' "
        "ELSE 'INVESTIGATE' END"
    )


def action_rationale() -> str:
    """The sentence for each action; the wording is fixed."""
    assigned, inferred = "upper(priority)", "upper(inferred_severity)"
    return (
        "CASE WHEN recommended_action = 'OK' "
        "THEN 'Assigned priority aligns with inferred ticket severity.' "
        "WHEN recommended_action = 'ESCALATE IMMEDIATELY' "
        "THEN concat('Ticket content signals CRITICAL severity but was assigned ', "
        f"{assigned}, '. Immediate re-prioritisation required.') "
        "WHEN recommended_action = 'ESCALATE' "
        f"THEN concat('Ticket content indicates ', {inferred}, ' severity but was assigned ', "
        f"{assigned}, '. Priority should be raised.') "
        "WHEN mismatch_direction = 'OVER-PRIORITISED' "
        f"THEN concat('Ticket was assigned ', {assigned}, ' but content signals only ', "
        f"{inferred}, ' severity. Review for priority inflation.') "
        "ELSE 'Priority gap detected. Manual review recommended.' END"
    )


def with_action(df: DataFrame, config: AuditConfig = AuditConfig()) -> DataFrame:
    acted = T.derive(df, {"recommended_action": recommended_action(config)})
    return T.derive(acted, {"action_rationale": action_rationale()})


def action_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("recommended_action").agg(F.count(F.lit(1)).alias("n"))


def dossiers(df: DataFrame, config: AuditConfig = AuditConfig(),
             only_flagged: bool = True) -> DataFrame:
    """One record of 17 fields per ticket.

    Needs predictions and ``lexicon_hits``. ``shap_attributions`` is used if it is
    there, and empty otherwise.
    """
    if only_flagged:
        df = df.filter("mismatch_predicted = 1")
    if "shap_attributions" not in df.columns:
        df = T.derive(df, {"shap_attributions": f"CAST(array() AS {ATTRIBUTION_TYPE})"})
    snippet = (
        f"concat(substring(full_text, 1, {config.snippet_chars}), "
        f"IF(length(full_text) > {config.snippet_chars}, '...', ''))"
    )
    return with_action(df, config).selectExpr(
        "ticket_id",
        f"{T.sql_string(config.timestamp)} AS timestamp",
        "initcap(priority) AS assigned_priority",
        "initcap(inferred_severity) AS inferred_severity",
        "round(inferred_severity_score, 4) AS severity_score",
        "round(severity_confidence, 4) AS severity_confidence",
        "priority_gap",
        "mismatch_predicted = 1 AS mismatch_detected",
        "round(mismatch_probability, 4) AS mismatch_probability",
        "mismatch_direction",
        "confidence_level",
        "recommended_action",
        "action_rationale",
        f"{evidence_spans('full_text', 'lexicon_hits', config)} AS evidence_spans",
        "shap_attributions",
        "subject AS ticket_subject",
        f"{snippet} AS ticket_snippet",
    )


# ---------------------------------------------------------------------------
# The symbols and the lines of the Markdown document.
# ---------------------------------------------------------------------------
ACTION_SYMBOLS = {
    "ESCALATE IMMEDIATELY": "🚨", "ESCALATE": "⬆️", "INVESTIGATE": "🔍", "OK": "✅",
}
SIGNAL_NAMES = {"3": "CRITICAL", "2": "HIGH", "1": "MEDIUM"}

MARKDOWN_TOP = """\
# {title} — Ticket {ticket_id}

---

## {mismatch_symbol} Priority Mismatch Assessment

| Field                | Value |
|----------------------|-------|
| **Assigned Priority**   | `{assigned_priority}` |
| **Inferred Severity**   | `{inferred_severity}` |
| **Severity Score**      | `{severity_score}` |
| **Severity Confidence** | `{severity_confidence}` |
| **Priority Gap**        | `{priority_gap}` |
| **Mismatch Detected**   | `{mismatch_detected}` |
| **Mismatch Probability**| `{mismatch_probability}` |
| **Direction**           | `{mismatch_direction}` |
| **Confidence Level**    | `{confidence_level}` |

---

## {action_symbol} Recommended Action: **{recommended_action}**

> {action_rationale}

---

## 📋 Ticket Summary

**Subject:** {ticket_subject}

**Excerpt:**
> {ticket_snippet}

---

## 🔍 Evidence Spans (Verbatim from Ticket)

_All quotes below are copied verbatim from the ticket text — no text has been generated or summarised._

"""
MARKDOWN_SPAN = """\
**{rank}. [{level} signal]** `"{span}"`

   Context: *"{context}"*

"""
MARKDOWN_NO_SPAN = "_No direct urgency signals detected in ticket text._\n\n"
MARKDOWN_MIDDLE = """\
---

## 📊 Top Feature Attributions

_Contributions of single features to the score of the mismatch: along the paths of the scoring trees, or, for a linear score, coefficient times distance from the mean._

"""
MARKDOWN_TABLE = """\
| Rank | Feature | Contribution | Direction |
|------|---------|--------------|-----------|
"""
MARKDOWN_ATTRIBUTION = "| {rank} | {name} | `{value}` | {direction} |\n"
MARKDOWN_NO_ATTRIBUTION = (
    "_Feature attributions not available: no model was given._\n"
)
MARKDOWN_END = """\

---

*Generated by {generator} — {timestamp}*"""


def fill(template: str, values: dict[str, str]) -> str:
    """A SQL expression that puts SQL expressions into the gaps of a template."""
    parts = []
    rest = template
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        if before:
            parts.append(T.sql_string(before).replace("\n", "\\n"))
        parts.append(f"coalesce(CAST({values[name]} AS STRING), '')")
    if rest:
        parts.append(T.sql_string(rest).replace("\n", "\\n"))
    return f"concat({', '.join(parts)})"


def markdown(config: AuditConfig = AuditConfig()) -> str:
    """The Markdown document of a dossier record."""
    top = fill(MARKDOWN_TOP, {
        "title": T.sql_string(config.document_title),
        "ticket_id": "ticket_id",
        "mismatch_symbol": "IF(mismatch_detected, '🔴', '🟢')",
        "assigned_priority": "assigned_priority",
        "inferred_severity": "inferred_severity",
        "severity_score": "format_string('%.4f', severity_score)",
        "severity_confidence": "format_string('%.4f', severity_confidence)",
        "priority_gap": "format_string('%+d', priority_gap)",
        "mismatch_detected": "IF(mismatch_detected, 'YES', 'NO')",
        "mismatch_probability": "format_string('%.4f', mismatch_probability)",
        "mismatch_direction": "mismatch_direction",
        "confidence_level": "confidence_level",
        "action_symbol": f"coalesce({T.sql_case('recommended_action', ACTION_SYMBOLS)}, '❓')",
        "recommended_action": "recommended_action",
        "action_rationale": "action_rationale",
        "ticket_subject": "ticket_subject",
        "ticket_snippet": "ticket_snippet",
    })
    span = fill(MARKDOWN_SPAN, {
        "rank": "i + 1",
        "level": T.sql_case("CAST(s.signal_level AS STRING)", SIGNAL_NAMES),
        "span": "s.span",
        "context": "s.verbatim_context",
    })
    attribution = fill(MARKDOWN_ATTRIBUTION, {
        "rank": "i + 1",
        "name": "a.human_name",
        "value": "format_string('%+.4f', a.shap_value)",
        "direction": "a.direction",
    })
    end = fill(MARKDOWN_END, {
        "generator": T.sql_string(config.generator_name), "timestamp": "timestamp",
    })
    spans = (
        f"IF(size(evidence_spans) > 0, "
        f"array_join(transform(evidence_spans, (s, i) -> {span}), ''), {fill(MARKDOWN_NO_SPAN, {})})"
    )
    attributions = (
        f"IF(size(shap_attributions) > 0, concat({fill(MARKDOWN_TABLE, {})}, "
        f"array_join(transform(shap_attributions, (a, i) -> {attribution}), '')), "
        f"{fill(MARKDOWN_NO_ATTRIBUTION, {})})"
    )
    return f"concat({top}, {spans}, {fill(MARKDOWN_MIDDLE, {})}, {attributions}, {end})"


def with_markdown(dossier_rows: DataFrame, config: AuditConfig = AuditConfig()) -> DataFrame:
    return T.derive(dossier_rows, {"markdown": markdown(config)})
