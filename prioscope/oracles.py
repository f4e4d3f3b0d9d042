"""DuckDB SQL for the queries that SQL can express.

Written separately from the operators, mostly in another form: unnested rows and
windows instead of expressions on arrays. ``W(names, body)`` puts the named
intermediate results, and what they depend on, in front of a query.
"""

from __future__ import annotations

from prioscope.config import LEXICON, NEGATION_WORDS, STRUCTURAL_FEATURES
from prioscope.fixtures import PHRASES, VALENCE

STAGES: dict[str, tuple[tuple[str, ...], str]] = {}
ORACLES: dict[str, str] = {}


def stage(name: str, needs: tuple[str, ...], sql: str) -> None:
    STAGES[name] = (needs, sql)


def W(names: tuple[str, ...], body: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for need in STAGES[name][0]:
                visit(need)
            ordered.append(name)

    for name in names:
        visit(name)
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({STAGES[n][1]})" for n in ordered)
    return f"WITH {ctes}\n{body}"


def values(rows) -> str:
    def lit(x) -> str:
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)

    return "VALUES " + ", ".join("(" + ", ".join(lit(x) for x in row) + ")" for row in rows)


# ------------------------------------------------------------------- ingest
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def clean(c: str) -> str:
    decoded = (
        f"replace(replace(replace(coalesce({c}, ''), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"
    )
    return f"trim(regexp_replace({decoded}, '{SPACE}', ' ', 'g'))"


def priority(c: str) -> str:
    s = f"lower(trim({c}))"
    return (
        f"CASE WHEN regexp_matches({s}, '\\b(critical|urgent|emergency|p0|p1|sev1|severity[\\s\\-]?1)\\b') "
        "THEN 'critical' "
        f"WHEN regexp_matches({s}, '\\b(high|hi|p2|sev2|severity[\\s\\-]?2)\\b') THEN 'high' "
        f"WHEN regexp_matches({s}, '\\b(medium|med|moderate|p3|sev3|severity[\\s\\-]?3)\\b') THEN 'medium' "
        f"WHEN regexp_matches({s}, '\\b(low|lo|minor|p4|p5|sev4|sev5|severity[\\s\\-]?[45])\\b') "
        "THEN 'low' END"
    )


def rank(c: str) -> str:
    return (
        f"CAST(CASE {c} WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 "
        "WHEN 'critical' THEN 3 END AS INTEGER)"
    )


NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"


def number(c: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({c}), '{NUMBER}') THEN TRY_CAST(trim({c}) AS DOUBLE) END"


def minutes(c: str) -> str:
    s = f"lower(trim({c}))"

    def unit(words: str, factor: str) -> str:
        found = f"regexp_extract_all({s}, '([0-9]+(?:\\.[0-9]+)?)\\s*(?:{words})', 1)"
        return f"coalesce(list_sum(list_transform({found}, lambda x: CAST(x AS DOUBLE) {factor})), 0)"

    total = " + ".join([
        unit("day", "* 1440"), unit("hour|hr", "* 60"), unit("min", "* 1"), unit("sec", "/ 60"),
    ])
    return (
        f"CASE WHEN regexp_full_match({s}, '{NUMBER}') THEN TRY_CAST({s} AS DOUBLE) / 60 "
        f"WHEN {total} > 0 THEN {total} END"
    )


stage("ph", (), f"SELECT * FROM ({values(list(enumerate(PHRASES)))}) t(k, phrase)")
stage("raw", ("ph",), """
SELECT CAST(d.doc_id AS VARCHAR) AS ticket_id,
       CASE WHEN d.doc_id % 10 = 9 THEN '  ' ELSE
         'Re: ' || a.phrase || CASE WHEN d.doc_id % 4 = 0 THEN '!!' ELSE '' END END AS subject,
       CASE WHEN d.doc_id % 7 = 3 THEN 'This is not ' || b.phrase || ' anymore.' || chr(13) || chr(10)
            WHEN d.doc_id % 7 = 5 THEN 'A &amp; B &lt;x&gt; see https://kb.example.com/'
                 || CAST(d.doc_id AS VARCHAR) || ' ' || upper(b.phrase) || '? '
            ELSE 'We have ' || b.phrase || ', then ' || c.phrase || '. ' END || d.text AS description,
       o.o_orderpriority AS priority,
       CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE d.lang END AS ticket_type,
       o.o_orderstatus AS status,
       d.source AS channel,
       CAST(NULL AS VARCHAR) AS resolution, CAST(NULL AS VARCHAR) AS customer_name,
       CAST(NULL AS VARCHAR) AS product,
       CASE WHEN d.doc_id % 6 = 1 THEN NULL WHEN d.doc_id % 6 = 2 THEN 'n/r'
            ELSE CAST(1 + (d.doc_id * 7) % 5 AS VARCHAR) END AS csat,
       CASE d.doc_id % 5 WHEN 0 THEN CAST((d.doc_id * 37) % 5000 AS VARCHAR)
            WHEN 1 THEN CAST(d.doc_id % 9 AS VARCHAR) || ' hours '
                 || CAST(d.doc_id % 60 AS VARCHAR) || ' minutes'
            WHEN 2 THEN CAST(1 + d.doc_id % 90 AS VARCHAR) || ' min'
            WHEN 3 THEN 'soon' ELSE NULL END AS first_response,
       CASE d.doc_id % 4 WHEN 0 THEN CAST(1 + d.doc_id % 6 AS VARCHAR) || ' days'
            WHEN 1 THEN CAST(1 + d.doc_id % 30 AS VARCHAR) || '.5 hr'
            WHEN 2 THEN CAST((d.doc_id * 101) % 90000 AS VARCHAR) || '.0'
            ELSE '45 sec' END AS resolution_time,
       CAST(NULL AS VARCHAR) AS date_purchased
FROM documents d JOIN orders o ON d.doc_id = o.o_orderkey
JOIN ph a ON a.k = d.doc_id % 17
JOIN ph b ON b.k = (d.doc_id * 3 + 5) % 17
JOIN ph c ON c.k = (d.doc_id * 5 + 2) % 17""")
stage("tickets", ("raw",), f"""
SELECT *, trim(subject || ' [SEP] ' || description) AS full_text FROM (
  SELECT trim(ticket_id) AS ticket_id, {clean('subject')} AS subject,
         {clean('description')} AS description, priority AS priority_raw,
         {priority('priority')} AS priority, {rank(priority('priority'))} AS priority_rank,
         ticket_type, status, channel, csat, {number('csat')} AS csat_numeric,
         {minutes('first_response')} AS first_response_minutes,
         {minutes('resolution_time')} AS resolution_time_minutes
  FROM raw) t
WHERE priority IS NOT NULL""")

ORACLES["scan_tickets"] = W(("raw",), "SELECT * FROM raw")
ORACLES["required_column_counts"] = W(("raw",), """
SELECT count(*) AS n_rows, count(subject) AS n_subject, count(description) AS n_description,
       count(priority) AS n_priority FROM raw""")
ORACLES["normalise_priority"] = f"""
SELECT o_orderkey, o_orderpriority AS priority_raw, {priority('o_orderpriority')} AS priority,
       {rank(priority('o_orderpriority'))} AS priority_rank FROM orders"""
ORACLES["dropped_priority_counts"] = W(("raw",), f"""
SELECT count(*) AS n_rows, count({priority('priority')}) AS n_kept,
       count(*) - count({priority('priority')}) AS n_dropped FROM raw""")
ORACLES["clean_text"] = W(("raw",), f"""
SELECT 'document' AS kind, doc_id AS id, {clean('text')} AS text FROM documents
UNION ALL SELECT 'page', page_id, {clean('html')} FROM pages
UNION ALL SELECT 'ticket', CAST(ticket_id AS BIGINT), {clean('description')} FROM raw""")
ORACLES["full_text"] = W(("tickets",), "SELECT ticket_id, full_text FROM tickets")
ORACLES["duration_minutes"] = W(("tickets",), """
SELECT ticket_id, round(first_response_minutes, 6) AS first_response_minutes,
       round(resolution_time_minutes, 6) AS resolution_time_minutes FROM tickets""")
ORACLES["csat_numeric"] = W(("tickets",), "SELECT ticket_id, csat, csat_numeric FROM tickets")
ORACLES["synthetic_ticket_id"] = W(("raw",), f"""
SELECT CAST(ticket_id AS BIGINT) AS source_id, {priority('priority')} AS priority,
       'TKT-' || lpad(CAST(row_number() OVER (ORDER BY CAST(ticket_id AS BIGINT)) - 1 AS VARCHAR),
                      6, '0') AS ticket_id,
       priority AS priority_raw, {rank(priority('priority'))} AS r
FROM raw WHERE {priority('priority')} IS NOT NULL""")
ORACLES["synthetic_ticket_id"] = (
    f"SELECT source_id, priority, ticket_id FROM ({ORACLES['synthetic_ticket_id']})"
)
ORACLES["priority_distribution"] = W(
    ("tickets",), "SELECT priority, count(*) AS n FROM tickets GROUP BY 1 ORDER BY n DESC")
STATS = r"""
CAST(length(full_text) AS INTEGER) AS text_length,
CAST(len(regexp_extract_all(full_text, '[^ ]+')) AS INTEGER) AS word_count,
CAST(len(regexp_extract_all(full_text, '!')) AS INTEGER) AS exclamation_count,
CAST(len(regexp_extract_all(full_text, '\?')) AS INTEGER) AS question_count,
len(regexp_extract_all(full_text, '\p{Lu}')) / CAST(greatest(length(full_text), 1) AS DOUBLE)
  AS caps_ratio,
CAST(len(regexp_extract_all(full_text, '\p{Nd}')) AS INTEGER) AS digit_count,
CAST(len(regexp_extract_all(full_text, 'https?://[^ ]+|www\.[^ ]+')) AS INTEGER) AS url_count"""
ORACLES["text_stats"] = W(("tickets",), f"""
SELECT * REPLACE (round(caps_ratio, 6) AS caps_ratio)
FROM (SELECT ticket_id, {STATS} FROM tickets)""")

# ------------------------------------------------------------------ lexicon
_PHRASE_ROWS = [
    (level, score, phrase) for level, score, phrases in LEXICON for phrase in phrases
]
stage("lex", (), "SELECT * FROM ("
      + values([(i, *row) for i, row in enumerate(_PHRASE_ROWS)])
      + ") t(phrase_idx, level, level_score, phrase)")
# four letters that equal an ASCII letter when case is ignored
CASE_VARIANTS = "\u0130\u0131\u017f\u212a"
stage("masked", ("tickets",), rf"""
SELECT ticket_id, full_text, regexp_replace(regexp_replace(
         lower(translate(full_text, '{CASE_VARIANTS}', 'iisk')),
         '[^\x00-\x7F\p{{L}}\p{{N}}]', '-', 'g'), '[^\x00-\x7F]', 'x', 'g') AS m
FROM tickets""")
_NEG = "|".join(NEGATION_WORDS).replace("'", "''")
stage("zones", ("masked",), rf"""
SELECT ticket_id, list_sort(list_distinct(flatten(list_transform(
         list_filter(range(len(toks)), lambda i: regexp_matches(toks[i + 1], '\b({_NEG})\b')),
         lambda i: range(greatest(0, i - 1), least(len(toks), i + 4)))))) AS zone
FROM (SELECT ticket_id, string_split(m, ' ') AS toks FROM masked) t""")
stage("pieces", ("masked", "lex"), r"""
SELECT ticket_id, full_text, phrase_idx, level, level_score, phrase, len(ps) AS n,
       unnest(ps) AS piece, generate_subscripts(ps, 1) AS i
FROM (SELECT *, string_split_regex(m, '\b' || phrase || '\b') AS ps
      FROM masked JOIN lex ON contains(m, phrase)) t""")
stage("placed", ("pieces",), """
SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY ticket_id, phrase_idx ORDER BY i)
               + (i - 1) * length(phrase) AS INTEGER) AS char_pos
FROM pieces QUALIFY i < n""")
stage("hits", ("placed", "zones"), """
SELECT ticket_id, full_text, level, level_score, phrase_idx, phrase, occ, char_pos, matched,
       word_pos, CASE WHEN list_contains(zone, word_pos) THEN 0.5 ELSE 1.0 END::DOUBLE AS weight
FROM (SELECT *, CAST(i - 1 AS INTEGER) AS occ,
             substr(full_text, char_pos + 1, length(phrase)) AS matched,
             CAST(len(regexp_extract_all(substr(full_text, 1, char_pos), '[^ ]+')) AS INTEGER)
               AS word_pos
      FROM placed) p JOIN zones USING (ticket_id)""")
stage("lexscore", ("tickets", "hits"), """
SELECT ticket_id, least(greatest(coalesce(s, 0), 0), 1)::DOUBLE AS urgency_lexicon_score
FROM tickets LEFT JOIN (
  SELECT ticket_id, sum(level_score * weight) / (3 * (sum(weight) + 1e-9)) AS s
  FROM hits GROUP BY 1) h USING (ticket_id)""")
ORACLES["lexicon_hits"] = W(("hits",), """
SELECT ticket_id, level, level_score, phrase, occ, char_pos, matched, word_pos, weight FROM hits""")
ORACLES["negation_zones"] = W(
    ("zones",), "SELECT ticket_id, array_to_string(zone, '|') AS zone FROM zones")
ORACLES["lexicon_score"] = W(("lexscore",), """
SELECT ticket_id, round(urgency_lexicon_score, 6) AS urgency_lexicon_score FROM lexscore""")
ORACLES["lexicon_evidence"] = W(("tickets", "hits"), "SELECT ticket_id, " + ", ".join(
    f"coalesce(string_agg(matched, '|' ORDER BY phrase_idx, char_pos) "
    f"FILTER (WHERE level = '{x}'), '') AS {x}" for x in ("critical", "high", "medium", "low")
) + " FROM tickets LEFT JOIN hits USING (ticket_id) GROUP BY 1")

# ------------------------------------------------------------------ signals
stage("probs", ("tickets",), """
SELECT ticket_id, c / t AS p_critical, h / t AS p_high, m / t AS p_medium, l / t AS p_low
FROM (SELECT *, (c + h + m + l)::DOUBLE AS t FROM (
  SELECT ticket_id, 1 + (CAST(ticket_id AS BIGINT) * 3) % 7 AS c,
         1 + (CAST(ticket_id AS BIGINT) * 5) % 7 AS h,
         1 + (CAST(ticket_id AS BIGINT) * 11) % 7 AS m,
         1 + (CAST(ticket_id AS BIGINT) * 13) % 7 AS l FROM tickets) a) b""")
stage("blend", ("probs",), """
SELECT ticket_id, p_critical * 1.0::DOUBLE + p_high * 0.67::DOUBLE + p_medium * 0.33::DOUBLE
       AS nli_severity_score FROM probs""")
stage("sstats", ("tickets",), """
SELECT count(csat_numeric) AS csat_n, min(csat_numeric) AS csat_min, max(csat_numeric) AS csat_max,
       median(csat_numeric) AS csat_median,
       count(rt) AS resolution_n, min(ln(1 + coalesce(rt, 0))) AS resolution_log_min,
       max(ln(1 + coalesce(rt, 0))) AS resolution_log_max,
       count(fr) AS response_n, min(ln(1 + coalesce(fr, 0))) AS response_log_min,
       max(ln(1 + coalesce(fr, 0))) AS response_log_max
FROM (SELECT csat_numeric,
             CASE WHEN resolution_time_minutes > -1 THEN resolution_time_minutes END AS rt,
             CASE WHEN first_response_minutes > -1 THEN first_response_minutes END AS fr
      FROM tickets) t""")
stage("structural", ("tickets", "sstats"), """
SELECT ticket_id, CASE WHEN w = 0 THEN 0.5 ELSE least(greatest(
    (0.50::DOUBLE * csat_part + 0.35::DOUBLE * rt_part + 0.15::DOUBLE * fr_part) / w, 0), 1)
  END::DOUBLE AS structural_score
FROM (
  SELECT ticket_id,
    CASE WHEN csat_n > 10 THEN 0.50 ELSE 0 END::DOUBLE
      + CASE WHEN resolution_n > 10 THEN 0.35 ELSE 0 END::DOUBLE
      + CASE WHEN response_n > 10 THEN 0.15 ELSE 0 END::DOUBLE AS w,
    CASE WHEN csat_n <= 10 THEN 0 WHEN csat_max = csat_min THEN 0.5
         ELSE 1 - (coalesce(csat_numeric, csat_median) - csat_min) / (csat_max - csat_min) END
      AS csat_part,
    CASE WHEN resolution_n <= 10 THEN 0 ELSE
      (ln(1 + coalesce(CASE WHEN resolution_time_minutes > -1 THEN resolution_time_minutes END, 0))
       - resolution_log_min) / (resolution_log_max - resolution_log_min + 1e-9) END AS rt_part,
    CASE WHEN response_n <= 10 THEN 0 ELSE
      (ln(1 + coalesce(CASE WHEN first_response_minutes > -1 THEN first_response_minutes END, 0))
       - response_log_min) / (response_log_max - response_log_min + 1e-9) END AS fr_part
  FROM tickets, sstats) t""")
stage("val", (), f"SELECT * FROM ({values(list(VALENCE.items()))}) t(token, v)")
stage("tokens", ("tickets",), r"""
SELECT ticket_id, unnest(ts) AS token, generate_subscripts(ts, 1) AS i
FROM (SELECT ticket_id, regexp_extract_all(lower(full_text), '[\p{L}\p{N}_]{2,}') AS ts
      FROM tickets) t""")
stage("compounds", ("tickets", "tokens", "val"), """
SELECT ticket_id, coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15) AS compound
FROM tickets LEFT JOIN (SELECT ticket_id, sum(v::DOUBLE) AS s FROM tokens JOIN val USING (token)
                        GROUP BY 1) x USING (ticket_id)""")
stage("sentiments", ("tickets", "compounds"), r"""
SELECT ticket_id, least(greatest(1 - (compound + 1) / 2
    + least(len(regexp_extract_all(full_text, '!')), 5) / 10.0::DOUBLE
    + least(len(regexp_extract_all(full_text, '\p{Lu}'))
            / greatest(length(full_text), 1)::DOUBLE * 3, 0.2::DOUBLE), 0), 1)::DOUBLE
  AS sentiment_score
FROM tickets JOIN compounds USING (ticket_id)""")
ORACLES["label_prob_blend"] = W(
    ("blend",), "SELECT ticket_id, round(nli_severity_score, 6) AS nli_severity_score FROM blend")
ORACLES["structural_stats"] = W(("sstats",), """
SELECT csat_n, csat_min, csat_max, csat_median, resolution_n,
       round(resolution_log_min, 6) AS resolution_log_min,
       round(resolution_log_max, 6) AS resolution_log_max, response_n,
       round(response_log_min, 6) AS response_log_min,
       round(response_log_max, 6) AS response_log_max FROM sstats""")
ORACLES["structural_score"] = W(
    ("structural",), "SELECT ticket_id, round(structural_score, 6) AS structural_score FROM structural")
ORACLES["sentiment_compound"] = W(
    ("compounds",), "SELECT ticket_id, round(compound, 6) AS compound FROM compounds")
ORACLES["sentiment_score"] = W(
    ("sentiments",), "SELECT ticket_id, round(sentiment_score, 6) AS sentiment_score FROM sentiments")


# ----------------------------------------------------------------- severity
def band(c: str) -> str:
    return (
        f"CASE WHEN {c} >= 0 AND {c} < 0.30::DOUBLE THEN 'low' "
        f"WHEN {c} >= 0.30::DOUBLE AND {c} < 0.55::DOUBLE THEN 'medium' "
        f"WHEN {c} >= 0.55::DOUBLE AND {c} < 0.78::DOUBLE THEN 'high' ELSE 'critical' END"
    )


stage("severity", ("tickets", "lexscore", "structural", "sentiments"), f"""
SELECT *, {band('inferred_severity_score')} AS inferred_severity,
       {rank(band('inferred_severity_score'))} AS inferred_severity_rank,
       least(greatest(1 - 2 * sqrt((pow(urgency_lexicon_score - mu, 2)
         + pow(structural_score - mu, 2) + pow(sentiment_score - mu, 2)) / 3), 0), 1)
         AS severity_confidence
FROM (SELECT *, least(greatest(0.70::DOUBLE * urgency_lexicon_score
               + 0.20::DOUBLE * structural_score + 0.10::DOUBLE * sentiment_score, 0), 1)::DOUBLE
               AS inferred_severity_score,
             (urgency_lexicon_score + structural_score + sentiment_score) / 3 AS mu
      FROM tickets JOIN lexscore USING (ticket_id) JOIN structural USING (ticket_id)
      JOIN sentiments USING (ticket_id)) t""")
stage("labelled", ("severity",), """
SELECT *, CASE WHEN pseudo_label_confidence >= 0.75::DOUBLE THEN 'HIGH'
               WHEN pseudo_label_confidence >= 0.55::DOUBLE THEN 'MEDIUM'
               WHEN pseudo_label_confidence >= 0.40::DOUBLE THEN 'LOW' ELSE 'UNCERTAIN' END
         AS pseudo_label_quality,
       pseudo_label_confidence >= 0.55::DOUBLE AS include_in_training
FROM (
  SELECT *, CAST(abs(priority_gap) >= 1 AS INTEGER) AS is_mismatch,
         CASE sign(priority_gap) WHEN -1 THEN 'OVER-PRIORITISED' WHEN 1 THEN 'UNDER-PRIORITISED'
              ELSE 'ALIGNED' END AS mismatch_direction,
         least(greatest(severity_confidence + least(abs(priority_gap) * 0.15::DOUBLE, 0.30::DOUBLE)
           - CASE WHEN least(abs(inferred_severity_score - 0.30::DOUBLE),
                             abs(inferred_severity_score - 0.55::DOUBLE),
                             abs(inferred_severity_score - 0.78::DOUBLE)) < 0.05::DOUBLE
                  THEN 0.10::DOUBLE ELSE 0 END, 0), 1)::DOUBLE AS pseudo_label_confidence
  FROM (SELECT *, inferred_severity_rank - priority_rank AS priority_gap FROM severity) a) b""")
stage("scored", ("labelled",), """
SELECT *, round(0.5::DOUBLE * inferred_severity_score
         + 0.5::DOUBLE * ((CAST(ticket_id AS BIGINT) * 7919) % 1000) / 1000.0::DOUBLE, 6)
         AS mismatch_probability FROM labelled""")
ORACLES["severity_ensemble"] = W(("severity",), """
SELECT ticket_id, round(urgency_lexicon_score, 6) AS urgency_lexicon_score,
       0.5::DOUBLE AS nli_severity_score, round(structural_score, 6) AS structural_score,
       round(sentiment_score, 6) AS sentiment_score,
       round(inferred_severity_score, 6) AS inferred_severity_score FROM severity""")
ORACLES["severity_ensemble_model"] = W(
    ("blend", "lexscore", "structural", "sentiments"), f"""
SELECT ticket_id, round(n, 6) AS nli_severity_score, round(score, 6) AS inferred_severity_score,
       {band('score')} AS inferred_severity,
       round(least(greatest(1 - 2 * sqrt((pow(l - mu, 2) + pow(n - mu, 2) + pow(s - mu, 2)
         + pow(e - mu, 2)) / 4), 0), 1), 6) AS severity_confidence
FROM (SELECT *, least(greatest(0.35::DOUBLE * l + 0.35::DOUBLE * n + 0.20::DOUBLE * s
               + 0.10::DOUBLE * e, 0), 1)::DOUBLE AS score, (l + n + s + e) / 4 AS mu
      FROM (SELECT ticket_id, urgency_lexicon_score AS l, nli_severity_score AS n,
                   structural_score AS s, sentiment_score AS e
            FROM blend JOIN lexscore USING (ticket_id) JOIN structural USING (ticket_id)
            JOIN sentiments USING (ticket_id)) a) b""")
ORACLES["severity_label"] = W(
    ("severity",), "SELECT ticket_id, inferred_severity, inferred_severity_rank FROM severity")
ORACLES["severity_confidence"] = W(
    ("severity",), "SELECT ticket_id, round(severity_confidence, 6) AS severity_confidence FROM severity")
ORACLES["severity_distribution"] = W(("severity",), """
SELECT inferred_severity, count(*) AS n, round(avg(severity_confidence), 6) AS mean_confidence
FROM severity GROUP BY 1""")

# ------------------------------------------------------------ pseudo-labels
ORACLES["pseudo_labels"] = W(("labelled",), """
SELECT ticket_id, priority, inferred_severity, priority_gap, is_mismatch, mismatch_direction,
       round(pseudo_label_confidence, 6) AS pseudo_label_confidence, pseudo_label_quality,
       include_in_training FROM labelled""")
ORACLES["training_set"] = W(("labelled",), """
SELECT ticket_id, priority, is_mismatch, round(pseudo_label_confidence, 6) AS pseudo_label_confidence
FROM labelled WHERE include_in_training""")
ORACLES["pseudo_label_summary"] = W(("labelled",), """
SELECT n_total, n_mismatch, n_total - n_mismatch AS n_aligned, n_train,
       n_total - n_train AS n_excluded, round(100.0 * n_mismatch / n_total, 6)::DOUBLE AS mismatch_pct,
       round(train_balance, 6) AS train_balance,
       coalesce(train_balance > 0.9 OR train_balance < 0.1, false) AS extreme_imbalance
FROM (SELECT count(*) AS n_total, sum(is_mismatch)::BIGINT AS n_mismatch,
             count(*) FILTER (WHERE include_in_training) AS n_train,
             avg(is_mismatch) FILTER (WHERE include_in_training) AS train_balance
      FROM labelled) t""")
ORACLES["mismatch_direction_counts"] = W(
    ("labelled",), "SELECT mismatch_direction, count(*) AS n FROM labelled GROUP BY 1")
ORACLES["label_quality_counts"] = W(
    ("labelled",), "SELECT pseudo_label_quality, count(*) AS n FROM labelled GROUP BY 1")

# ----------------------------------------------------------------- features
stage("terms", ("tokens",), """
SELECT ticket_id, token AS term FROM tokens
UNION ALL
SELECT a.ticket_id, a.token || ' ' || b.token FROM tokens a
JOIN tokens b ON a.ticket_id = b.ticket_id AND b.i = a.i + 1""")
stage("term_rows", ("terms",),
      "SELECT ticket_id, term, count(*) AS tf FROM terms GROUP BY ALL")
stage("term_totals", ("term_rows",),
      "SELECT term, sum(tf)::BIGINT AS tf, count(*)::BIGINT AS df FROM term_rows GROUP BY 1")
stage("vocab", ("term_totals", "tickets"), """
SELECT term, tf, df, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx,
       ln((1 + (SELECT count(*) FROM tickets))::DOUBLE / (1 + df)) + 1 AS idf
FROM (SELECT * FROM term_totals WHERE df >= 2 ORDER BY tf DESC, term LIMIT 3000) t""")
stage("weights", ("term_rows", "vocab"), """
SELECT ticket_id, idx, w / sqrt(sum(w * w) OVER (PARTITION BY ticket_id)) AS weight
FROM (SELECT ticket_id, idx, (1 + ln(r.tf)) * idf AS w
      FROM term_rows r JOIN vocab USING (term)) t""")
ORACLES["ngrams"] = W(("term_totals",), "SELECT term, tf, df FROM term_totals")
ORACLES["tfidf_vocab"] = W(
    ("vocab",), "SELECT term, tf, df, idx, round(idf, 6) AS idf FROM vocab")
ORACLES["tfidf_weights"] = W(
    ("weights",), "SELECT ticket_id, idx, round(weight, 6) AS weight FROM weights")
ORACLES["embedding_l2_norm"] = """
SELECT vec_id, CAST(dim AS INTEGER) AS dim, round(CASE WHEN n > 0 THEN x / n ELSE x END, 6) AS value
FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS n
      FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x,
                   generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) a) b"""


def category(c: str) -> str:
    return f"lower(trim(coalesce({c}, 'unknown')))"


stage("enc", ("tickets",), "\nUNION ALL\n".join(
    f"SELECT '{c}' AS col, value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS code "
    f"FROM (SELECT DISTINCT {category(c)} AS value FROM tickets) t"
    for c in ("channel", "ticket_type", "status")))


def code(c: str, value: str) -> str:
    return (
        f"coalesce((SELECT code FROM enc WHERE col = '{c}' AND value = {value}), "
        f"(SELECT code FROM enc WHERE col = '{c}' AND value = 'unknown'), 0)"
    )


ORACLES["label_encoding"] = W(("tickets", "enc"), """
SELECT ticket_id, a.code AS channel_enc, b.code AS ticket_type_enc, c.code AS status_enc
FROM tickets t
JOIN enc a ON a.col = 'channel' AND a.value = lower(trim(coalesce(t.channel, 'unknown')))
JOIN enc b ON b.col = 'ticket_type' AND b.value = lower(trim(coalesce(t.ticket_type, 'unknown')))
JOIN enc c ON c.col = 'status' AND c.value = lower(trim(coalesce(t.status, 'unknown')))""")
ORACLES["label_encoding_unseen"] = W(("enc",), f"""
SELECT conv_id, turn, {code('channel', 'role')} AS channel_enc,
       {code('ticket_type', "'unknown'")} AS ticket_type_enc,
       {code('status', "CASE WHEN turn = 0 THEN 'o' ELSE 'closed' END")} AS status_enc
FROM (SELECT *, lower(trim(role)) AS r FROM conversations) t""")
stage("fstats", ("tickets",), """
SELECT min(csat_numeric) AS c_lo, max(csat_numeric) AS c_hi, median(csat_numeric) AS c_med,
  median(CASE WHEN first_response_minutes > -1 THEN first_response_minutes END) AS fr_med,
  median(CASE WHEN resolution_time_minutes > -1 THEN resolution_time_minutes END) AS rt_med
FROM tickets""")
stage("feats", ("labelled", "fstats", "enc"), f"""
SELECT ticket_id, text_length::DOUBLE AS text_length, word_count::DOUBLE AS word_count,
  exclamation_count::DOUBLE AS exclamation_count, question_count::DOUBLE AS question_count,
  caps_ratio, csat_norm, 1 - csat_norm AS csat_inverted,
  ln(1 + coalesce(CASE WHEN first_response_minutes > -1 THEN first_response_minutes END, fr_med))
    AS first_response_minutes_norm,
  ln(1 + coalesce(CASE WHEN resolution_time_minutes > -1 THEN resolution_time_minutes END, rt_med))
    AS resolution_time_minutes_norm,
  channel_enc::DOUBLE AS channel_enc, ticket_type_enc::DOUBLE AS ticket_type_enc,
  status_enc::DOUBLE AS status_enc, inferred_severity_score, severity_confidence,
  urgency_lexicon_score
FROM (SELECT l.*, {STATS}, fr_med, rt_med,
        (coalesce(csat_numeric, c_med) - c_lo) / (c_hi - c_lo + 1e-9) AS csat_norm,
        a.code AS channel_enc, b.code AS ticket_type_enc, c.code AS status_enc
      FROM labelled l
      JOIN enc a ON a.col = 'channel' AND a.value = {category('l.channel')}
      JOIN enc b ON b.col = 'ticket_type' AND b.value = {category('l.ticket_type')}
      JOIN enc c ON c.col = 'status' AND c.value = {category('l.status')}, fstats) t""")
stage("scaled", ("feats",), "SELECT ticket_id, " + ", ".join(
    f"({c} - quantile_cont({c}, 0.5) OVER ()) / (CASE WHEN quantile_cont({c}, 0.75) OVER () "
    f"- quantile_cont({c}, 0.25) OVER () > 0 THEN quantile_cont({c}, 0.75) OVER () "
    f"- quantile_cont({c}, 0.25) OVER () ELSE 1 END) AS {c}" for c in STRUCTURAL_FEATURES
) + " FROM feats")


def rounded_columns(columns) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


ORACLES["structural_features"] = W(
    ("feats",), f"SELECT ticket_id, {rounded_columns(STRUCTURAL_FEATURES)} FROM feats")
ORACLES["robust_scaled"] = W(
    ("scaled",), f"SELECT ticket_id, {rounded_columns(STRUCTURAL_FEATURES)} FROM scaled")
_COLUMN_ROWS = values(list(enumerate(STRUCTURAL_FEATURES)))
ORACLES["feature_names"] = W(("vocab",), f"""
SELECT idx, 'tfidf:' || term AS name FROM vocab
UNION ALL
SELECT CAST((SELECT count(*) FROM vocab) + i AS INTEGER), 'sbert_' || CAST(i AS VARCHAR)
FROM (SELECT unnest(range((SELECT max(len(embedding)) FROM embeddings))) AS i) d
UNION ALL
SELECT CAST((SELECT count(*) FROM vocab) + (SELECT max(len(embedding)) FROM embeddings) + i
            AS INTEGER), name FROM ({_COLUMN_ROWS}) t(i, name)""")

# --------------------------------------------------------------- classifier
stage("folded", ("scored",), """
SELECT *, CAST((row_number() OVER (PARTITION BY is_mismatch ORDER BY md5('42:' || ticket_id)) - 1)
               % 5 AS INTEGER) AS fold FROM scored""")
stage("grid", (), "SELECT i, i / 100.0::DOUBLE AS threshold FROM range(20, 81) t(i)")


def f1_of(tp: str, fp: str, fn: str) -> str:
    return f"CASE WHEN {tp} = 0 THEN 0 ELSE 2 * {tp}::DOUBLE / (2 * {tp} + {fp} + {fn}) END::DOUBLE"


def sweep(source: str, keys: str) -> str:
    group = f"{keys}, i, threshold" if keys else "i, threshold"
    lead = f"{keys}, " if keys else ""
    return f"""
SELECT {lead}i, threshold, tp, fp, fn, {f1_of('tp', 'fp', 'fn')} AS f1
FROM (SELECT {lead}i, threshold,
        count(*) FILTER (WHERE mismatch_probability >= threshold AND is_mismatch = 1) AS tp,
        count(*) FILTER (WHERE mismatch_probability >= threshold AND is_mismatch = 0) AS fp,
        count(*) FILTER (WHERE mismatch_probability < threshold AND is_mismatch = 1) AS fn
      FROM {source}, grid GROUP BY {group}) s"""


stage("fold_sweep", ("folded", "grid"), sweep("folded", "fold"))
stage("all_sweep", ("scored", "grid"), sweep("scored", ""))
stage("fold_best", ("fold_sweep",), """
SELECT fold, CASE WHEN max(f1) > 0 THEN arg_max(threshold, (f1, -i)) ELSE 0.5 END::DOUBLE AS threshold
FROM fold_sweep GROUP BY 1""")
stage("fold_auc", ("folded",), """
SELECT p.fold, sum(CASE WHEN p.mismatch_probability > n.mismatch_probability THEN 1.0
                        WHEN p.mismatch_probability = n.mismatch_probability THEN 0.5 ELSE 0 END)::DOUBLE
       / count(*) AS auc
FROM folded p JOIN folded n ON p.fold = n.fold AND p.is_mismatch = 1 AND n.is_mismatch = 0
GROUP BY 1""")
stage("folds", ("folded", "fold_best", "fold_auc"), f"""
SELECT fold, auc, {f1_of('tp', 'fp', 'fn')} AS f1,
       CASE WHEN tp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END::DOUBLE AS precision,
       CASE WHEN tp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END::DOUBLE AS recall, brier, threshold
FROM (SELECT fold, threshold, avg(pow(mismatch_probability - is_mismatch, 2)) AS brier,
        count(*) FILTER (WHERE mismatch_probability >= threshold AND is_mismatch = 1) AS tp,
        count(*) FILTER (WHERE mismatch_probability >= threshold AND is_mismatch = 0) AS fp,
        count(*) FILTER (WHERE mismatch_probability < threshold AND is_mismatch = 1) AS fn
      FROM folded JOIN fold_best USING (fold) GROUP BY ALL) a JOIN fold_auc USING (fold)""")
stage("predicted", ("scored",), """
SELECT *, CAST(mismatch_probability >= 0.23::DOUBLE AS INTEGER) AS mismatch_predicted,
       CASE WHEN mismatch_probability > 0.75::DOUBLE THEN 'VERY_HIGH'
            WHEN mismatch_probability > 0.55::DOUBLE THEN 'HIGH'
            WHEN mismatch_probability > 0.35::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END AS confidence_level
FROM scored""")
ORACLES["stratified_folds"] = W(("folded",), "SELECT ticket_id, is_mismatch, fold FROM folded")
ORACLES["class_weights"] = W(("labelled",), """
SELECT is_mismatch, count(*) AS n,
       round((SELECT count(*) FROM labelled) / (2.0::DOUBLE * count(*)), 6) AS weight
FROM labelled GROUP BY 1""")
ORACLES["threshold_sweep"] = W(
    ("fold_sweep",), "SELECT fold, threshold, tp, fp, fn, round(f1, 6) AS f1 FROM fold_sweep")
ORACLES["optimal_threshold"] = W(("all_sweep",), """
SELECT threshold, round(f1, 6) AS f1 FROM all_sweep ORDER BY all_sweep.f1 DESC, i LIMIT 1""")
ORACLES["fold_metrics"] = W(("folds",), f"""
SELECT fold, {rounded_columns(['auc', 'f1', 'precision', 'recall', 'brier', 'threshold'])}
FROM folds""")
ORACLES["fold_threshold_median"] = W(
    ("fold_best",), "SELECT round(median(threshold), 6) AS threshold FROM fold_best")
ORACLES["cv_summary"] = W(("folds",), """
SELECT round(avg(auc), 6) AS mean_auc, round(stddev_pop(auc), 6) AS std_auc,
       round(avg(f1), 6) AS mean_f1, round(stddev_pop(f1), 6) AS std_f1 FROM folds""")
ORACLES["predict_label"] = W(
    ("predicted",), "SELECT ticket_id, mismatch_probability, mismatch_predicted FROM predicted")
ORACLES["confidence_level"] = W(("predicted",), "SELECT ticket_id, confidence_level FROM predicted")
ORACLES["predictions_export"] = W(("predicted",), """
SELECT ticket_id, priority, inferred_severity,
       round(inferred_severity_score, 6) AS inferred_severity_score,
       round(severity_confidence, 6) AS severity_confidence, priority_gap, is_mismatch,
       mismatch_probability, mismatch_predicted, mismatch_direction, confidence_level, subject,
       description FROM predicted""")
stage("bins", ("scored",), """
SELECT CAST(least(floor(mismatch_probability * 50), 49) AS INTEGER) AS bin, count(*) AS n,
       sum(is_mismatch)::DOUBLE AS pos FROM scored GROUP BY 1""")
ORACLES["isotonic_fit"] = W(("bins",), """
SELECT i.bin, i.n, round(i.pos / i.n, 6) AS rate, round(max(low), 6) AS fitted
FROM bins i JOIN (
  SELECT bin_i, bin_a, min(mean) AS low FROM (
    SELECT i.bin AS bin_i, a.bin AS bin_a, b.bin AS bin_b,
           (SELECT sum(pos) / sum(n) FROM bins c WHERE c.bin BETWEEN a.bin AND b.bin) AS mean
    FROM bins i JOIN bins a ON a.bin <= i.bin JOIN bins b ON b.bin >= i.bin) x
  GROUP BY 1, 2) m ON m.bin_i = i.bin
GROUP BY i.bin, i.n, i.pos""")

# ---------------------------------------------------- attributions, evidence
_LONG = "\nUNION ALL\n".join(
    f"SELECT ticket_id, {i} AS idx, {c} AS value FROM scaled"
    for i, c in enumerate(STRUCTURAL_FEATURES))
stage("long_scaled", ("scaled",), _LONG)
ORACLES["linear_contributions"] = W(("long_scaled",), """
SELECT ticket_id, idx, round(((idx * 37) % 21 - 10) / 10.0::DOUBLE
       * (value - avg(value) OVER (PARTITION BY idx)), 6) AS contribution FROM long_scaled""")
stage("names", ("vocab",), f"""
SELECT idx, 'tfidf:' || term AS name FROM vocab
UNION ALL
SELECT CAST((SELECT count(*) FROM vocab) + i AS INTEGER), name
FROM ({_COLUMN_ROWS}) t(i, name)""")
_DISPLAY = values([
    ("text_length", "Ticket text length"), ("word_count", "Word count"),
    ("exclamation_count", "Exclamation marks count"),
    ("question_count", "Question marks count"),
    ("caps_ratio", "Proportion of uppercase letters"),
    ("csat_norm", "Customer satisfaction score"),
    ("csat_inverted", "Low customer satisfaction signal"),
    ("first_response_minutes_norm", "First response time"),
    ("resolution_time_minutes_norm", "Resolution time"),
    ("channel_enc", "Ticket channel (email/chat/phone)"),
    ("ticket_type_enc", "Ticket type/category"), ("status_enc", "Ticket status"),
    ("inferred_severity_score", "Inferred severity score (ensemble)"),
    ("severity_confidence", "Severity inference confidence"),
    ("urgency_lexicon_score", "Urgency keyword score"),
])


def human(c: str) -> str:
    title = (
        f"array_to_string(list_transform(string_split(replace({c}, '_', ' '), ' '), "
        "lambda w: upper(w[1]) || lower(w[2:])), ' ')"
    )
    return (
        f"CASE WHEN {c} LIKE 'tfidf:%' THEN 'Text keyword: \"' || substr({c}, 7) || '\"' "
        f"WHEN {c} LIKE 'sbert!_%' ESCAPE '!' THEN 'Semantic content embedding' "
        f"ELSE coalesce((SELECT shown FROM ({_DISPLAY}) t(n, shown) WHERE n = {c}), {title}) END"
    )


stage("entries", ("weights", "long_scaled", "vocab"), """
SELECT ticket_id, idx, weight FROM weights
UNION ALL
SELECT ticket_id, CAST((SELECT count(*) FROM vocab) + idx AS INTEGER), value FROM long_scaled""")
stage("top5", ("entries", "names", "tickets"), """
SELECT ticket_id, idx, name, c, CAST(r - 1 AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY round(abs(c), 12) DESC, idx) AS r
  FROM (SELECT t.ticket_id, m.idx, m.name,
               ((m.idx * 37) % 21 - 10) / 10.0::DOUBLE * (coalesce(e.weight, 0) - m.mean) AS c
        FROM tickets t CROSS JOIN (
          SELECT idx, name, coalesce(sum(weight), 0) / (SELECT count(*) FROM tickets) AS mean
          FROM names LEFT JOIN entries USING (idx) GROUP BY ALL) m
        LEFT JOIN entries e ON e.ticket_id = t.ticket_id AND e.idx = m.idx) a
  ) b WHERE r <= 5""")
stage("shown5", ("top5",), f"""
SELECT ticket_id, rank, name AS feature, {human('name')} AS human_name, round(c, 4) AS shap_value,
       CASE WHEN c > 0 THEN '↑ Towards Mismatch' ELSE '↓ Away from Mismatch' END AS direction
FROM top5""")
ORACLES["top_attributions"] = W(("shown5",), "SELECT * FROM shown5")
ORACLES["humanised_names"] = W(("vocab",), f"""
SELECT name, {human('name')} AS human_name FROM (
  SELECT 'tfidf:' || term AS name FROM vocab
  UNION ALL SELECT 'sbert_' || CAST(i AS VARCHAR)
  FROM (SELECT unnest(range((SELECT max(len(embedding)) FROM embeddings))) AS i) d
  UNION ALL SELECT name FROM ({_COLUMN_ROWS}) t(i, name)
  UNION ALL SELECT DISTINCT 'order_' || lower(o_orderstatus) || '_flag' FROM orders) t""")
stage("spans", ("hits",), """
SELECT ticket_id, CAST(r - 1 AS INTEGER) AS pos, matched AS span,
       CASE WHEN char_pos > 30 THEN '...' ELSE '' END
       || trim(substr(full_text, greatest(char_pos - 30, 0) + 1,
                      least(char_pos + length(matched) + 30, length(full_text))
                      - greatest(char_pos - 30, 0)))
       || CASE WHEN char_pos + length(matched) + 30 < length(full_text) THEN '...' ELSE '' END
         AS verbatim_context,
       level_score AS signal_level, char_pos AS char_position
FROM (SELECT *, row_number() OVER (PARTITION BY ticket_id
                                   ORDER BY level_score DESC, char_pos, phrase_idx) AS r
      FROM (SELECT * FROM hits WHERE level_score > 0
            QUALIFY row_number() OVER (PARTITION BY ticket_id, lower(matched)
                                       ORDER BY phrase_idx, char_pos) = 1) a) b
WHERE r <= 3""")
ORACLES["evidence_spans"] = W(("spans",), "SELECT * FROM spans")
stage("acted", ("predicted",), """
SELECT *, CASE recommended_action
    WHEN 'OK' THEN 'Assigned priority aligns with inferred ticket severity.'
    WHEN 'ESCALATE IMMEDIATELY' THEN 'Ticket content signals CRITICAL severity but was assigned '
      || upper(priority) || '. Immediate re-prioritisation required.'
    WHEN 'ESCALATE' THEN 'Ticket content indicates ' || upper(inferred_severity)
      || ' severity but was assigned ' || upper(priority) || '. Priority should be raised.'
    ELSE CASE WHEN mismatch_direction = 'OVER-PRIORITISED' THEN 'Ticket was assigned '
      || upper(priority) || ' but content signals only ' || upper(inferred_severity)
      || ' severity. Review for priority inflation.'
      ELSE 'Priority gap detected. Manual review recommended.' END END AS action_rationale
FROM (SELECT *, CASE
    WHEN mismatch_predicted = 0 OR mismatch_probability < 0.40::DOUBLE THEN 'OK'
    WHEN mismatch_direction = 'UNDER-PRIORITISED' THEN
      CASE WHEN inferred_severity = 'critical' THEN 'ESCALATE IMMEDIATELY' ELSE 'ESCALATE' END
    ELSE 'INVESTIGATE' END AS recommended_action FROM predicted) t""")
ORACLES["recommended_action"] = W(
    ("acted",), "SELECT ticket_id, recommended_action, action_rationale FROM acted")
ORACLES["action_counts"] = W(
    ("acted",), "SELECT recommended_action, count(*) AS n FROM acted GROUP BY 1")
stage("records", ("acted",), """
SELECT ticket_id, '2026-01-01T00:00:00' AS timestamp,
       upper(priority[1]) || priority[2:] AS assigned_priority,
       upper(inferred_severity[1]) || inferred_severity[2:] AS inferred_severity,
       round(inferred_severity_score, 4) AS severity_score,
       round(severity_confidence, 4) AS severity_confidence, priority_gap,
       mismatch_predicted = 1 AS mismatch_detected,
       round(mismatch_probability::DECIMAL(18, 6), 4)::DOUBLE AS mismatch_probability,
       mismatch_direction, confidence_level, recommended_action, action_rationale,
       subject AS ticket_subject,
       substr(full_text, 1, 300) || CASE WHEN length(full_text) > 300 THEN '...' ELSE '' END
         AS ticket_snippet
FROM acted WHERE mismatch_predicted = 1""")
ORACLES["dossiers"] = W(("records", "spans"), """
SELECT r.*, coalesce(s.spans, '') AS spans FROM records r LEFT JOIN (
  SELECT ticket_id, string_agg(span || '/' || signal_level || '/' || char_position, '|'
                               ORDER BY pos) AS spans FROM spans GROUP BY 1) s USING (ticket_id)""")
_MARKDOWN = """'# Ticket Priority Dossier — Ticket ' || ticket_id
|| chr(10) || chr(10) || '---' || chr(10) || chr(10)
|| '## 🔴 Priority Mismatch Assessment' || chr(10) || chr(10)
|| '| Field                | Value |' || chr(10)
|| '|----------------------|-------|' || chr(10)
|| '| **Assigned Priority**   | `' || assigned_priority || '` |' || chr(10)
|| '| **Inferred Severity**   | `' || inferred_severity || '` |' || chr(10)
|| '| **Severity Score**      | `' || printf('%.4f', severity_score) || '` |' || chr(10)
|| '| **Severity Confidence** | `' || printf('%.4f', severity_confidence) || '` |' || chr(10)
|| '| **Priority Gap**        | `' || printf('%+d', priority_gap) || '` |' || chr(10)
|| '| **Mismatch Detected**   | `YES` |' || chr(10)
|| '| **Mismatch Probability**| `' || printf('%.4f', mismatch_probability) || '` |' || chr(10)
|| '| **Direction**           | `' || mismatch_direction || '` |' || chr(10)
|| '| **Confidence Level**    | `' || confidence_level || '` |' || chr(10)
|| chr(10) || '---' || chr(10) || chr(10) || '## ' || CASE recommended_action
     WHEN 'ESCALATE IMMEDIATELY' THEN '🚨' WHEN 'ESCALATE' THEN '⬆️'
     WHEN 'INVESTIGATE' THEN '🔍' ELSE '✅' END
|| ' Recommended Action: **' || recommended_action || '**' || chr(10) || chr(10)
|| '> ' || action_rationale || chr(10) || chr(10) || '---' || chr(10) || chr(10)
|| '## 📋 Ticket Summary' || chr(10) || chr(10)
|| '**Subject:** ' || ticket_subject || chr(10) || chr(10)
|| '**Excerpt:**' || chr(10) || '> ' || ticket_snippet || chr(10) || chr(10)
|| '---' || chr(10) || chr(10)
|| '## 🔍 Evidence Spans (Verbatim from Ticket)' || chr(10) || chr(10)
|| '_All quotes below are copied verbatim from the ticket text — no text has been generated or summarised._'
|| chr(10) || chr(10)
|| coalesce(s.spans, '_No direct urgency signals detected in ticket text._' || chr(10) || chr(10))
|| '---' || chr(10) || chr(10)
|| '## 📊 Top Feature Attributions' || chr(10) || chr(10)
|| '_Contributions of single features to the score of the mismatch: along the paths of the scoring trees, or, for a linear score, coefficient times distance from the mean._'
|| chr(10) || chr(10)
|| '| Rank | Feature | Contribution | Direction |' || chr(10)
|| '|------|---------|--------------|-----------|' || chr(10)
|| a.attributions || chr(10) || '---' || chr(10) || chr(10)
|| '*Generated by prioscope — ' || timestamp || '*'"""
ORACLES["dossier_markdown"] = W(("records", "spans", "shown5"), f"""
SELECT ticket_id, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS md5 FROM (
  SELECT r.ticket_id, {_MARKDOWN} AS t
  FROM records r LEFT JOIN (
    SELECT ticket_id, string_agg('**' || (pos + 1) || '. ['
      || CASE signal_level WHEN 3 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' ELSE 'MEDIUM' END
      || ' signal]** `"' || span || '"`' || chr(10) || chr(10) || '   Context: *"'
      || verbatim_context || '"*' || chr(10) || chr(10), '' ORDER BY pos) AS spans
    FROM spans GROUP BY 1) s USING (ticket_id)
  JOIN (
    SELECT ticket_id, string_agg('| ' || (rank + 1) || ' | ' || human_name || ' | `'
      || printf('%+.4f', shap_value) || '` | ' || direction || ' |' || chr(10), ''
      ORDER BY rank) AS attributions
    FROM shown5 GROUP BY 1) a USING (ticket_id)) x""")

# ------------------------------------------------------------------ metrics
stage("cells", ("scored",), """
SELECT count(*) FILTER (WHERE p AND y) AS tp, count(*) FILTER (WHERE p AND NOT y) AS fp,
       count(*) FILTER (WHERE NOT p AND y) AS fn, count(*) FILTER (WHERE NOT p AND NOT y) AS tn,
       avg(pow(mismatch_probability - is_mismatch, 2)) AS brier_score
FROM (SELECT *, mismatch_probability >= 0.5::DOUBLE AS p, is_mismatch = 1 AS y FROM scored) t""")
ORACLES["metric_auc"] = W(("scored",), """
SELECT round(sum(CASE WHEN p.mismatch_probability > n.mismatch_probability THEN 1.0
                      WHEN p.mismatch_probability = n.mismatch_probability THEN 0.5 ELSE 0 END)::DOUBLE
       / count(*), 6) AS auc
FROM scored p JOIN scored n ON p.is_mismatch = 1 AND n.is_mismatch = 0""")
ORACLES["classification_metrics"] = W(("cells",), """
SELECT round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1,
       round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall,
       round(brier_score, 6) AS brier_score, 0.5::DOUBLE AS threshold_used,
       tp + fn AS n_positive, fp + tn AS n_negative,
       round((tp + fn)::DOUBLE / (tp + fp + fn + tn), 6) AS class_balance FROM cells""")
stage("sides", ("cells",), """
SELECT 'Aligned' AS class, coalesce(tn::DOUBLE / nullif(tn + fn, 0), 0) AS p,
       coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0) AS r,
       coalesce(2.0::DOUBLE * tn / nullif(2 * tn + fn + fp, 0), 0) AS f, tn + fp AS n FROM cells
UNION ALL
SELECT 'Mismatch', coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0),
       coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0),
       coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), tp + fn FROM cells""")
ORACLES["classification_report"] = W(("cells", "sides"), """
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, n::BIGINT AS support
FROM (
  SELECT * FROM sides
  UNION ALL SELECT 'accuracy', NULL, NULL, (tp + tn)::DOUBLE / (tp + fp + fn + tn),
                   tp + fp + fn + tn FROM cells
  UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(n) FROM sides
  UNION ALL SELECT 'weighted avg', sum(p * n) / sum(n), sum(r * n) / sum(n), sum(f * n) / sum(n),
                   sum(n) FROM sides) t""")
ORACLES["confusion_matrix"] = W(("cells",), """
SELECT 'Aligned' AS actual, tn AS predicted_aligned, fp AS predicted_mismatch FROM cells
UNION ALL SELECT 'Mismatch', fn, tp FROM cells""")
ORACLES["roc_curve"] = W(("scored",), """
SELECT round(fp / (SELECT count(*) FROM scored WHERE is_mismatch = 0)::DOUBLE, 6) AS fpr,
       round(tp / (SELECT count(*) FROM scored WHERE is_mismatch = 1)::DOUBLE, 6) AS tpr, threshold
FROM (SELECT mismatch_probability AS threshold,
             sum(sum(1 - is_mismatch)) OVER (ORDER BY mismatch_probability DESC) AS fp,
             sum(sum(is_mismatch)) OVER (ORDER BY mismatch_probability DESC) AS tp
      FROM scored GROUP BY 1) t
UNION ALL SELECT 0.0::DOUBLE, 0.0::DOUBLE, NULL""")
ORACLES["priority_severity_crosstab"] = W(("severity",), "SELECT priority, " + ", ".join(
    f"count(*) FILTER (WHERE inferred_severity = '{x}') AS {x}"
    for x in ("low", "medium", "high", "critical")) + " FROM severity GROUP BY 1")
ORACLES["probability_histogram"] = W(("scored",), """
SELECT CAST(i AS INTEGER) AS bin, round(lo + i * (hi - lo) / 30, 6) AS bin_start,
       round(lo + (i + 1) * (hi - lo) / 30, 6) AS bin_end,
       (SELECT count(*) FROM scored
        WHERE least(floor((mismatch_probability - lo) / (hi - lo) * 30), 29) = i) AS n
FROM range(30) t(i), (SELECT min(mismatch_probability) AS lo, max(mismatch_probability) AS hi
                      FROM scored) e""")
ORACLES["adversarial_slices"] = W(("scored",), """
SELECT priority, count(*) AS n, round(100 * avg(is_mismatch), 2) AS mismatch_pct,
       round(avg(mismatch_probability), 4) AS mean_prob
FROM scored GROUP BY 1 HAVING count(*) > 10 AND count(DISTINCT is_mismatch) > 1""")
ORACLES["sanity_checks"] = W(("scored",), """
SELECT unnest(['too many mismatches', 'too few mismatches', 'missing probabilities',
               'low severity confidence', 'small training set']) AS check,
       round(unnest([b, b, m, u, t]), 6) AS value,
       unnest([b > 0.9, b < 0.05, m > 0, u > 0.3, t < 100]) AS failed
FROM (SELECT avg(is_mismatch)::DOUBLE AS b,
             (count(*) - count(mismatch_probability))::DOUBLE AS m,
             avg(CASE WHEN severity_confidence < 0.4::DOUBLE THEN 1.0 ELSE 0 END)::DOUBLE AS u,
             (count(*) FILTER (WHERE include_in_training))::DOUBLE AS t FROM scored) f""")
ORACLES["report_metrics"] = W(("predicted",), """
SELECT section, metric, dim, round(value::DOUBLE, 6) AS value,
       CASE WHEN metric <> 'mean_confidence'
            THEN round(100.0::DOUBLE * value / (SELECT count(*) FROM predicted), 6) END AS pct
FROM (
  SELECT 'dataset' AS section, 'tickets' AS metric, '' AS dim, count(*)::DOUBLE AS value
  FROM predicted
  UNION ALL SELECT 'dataset', 'priority', priority, count(*) FROM predicted GROUP BY 3
  UNION ALL SELECT 'severity', 'severity', inferred_severity, count(*) FROM predicted GROUP BY 3
  UNION ALL SELECT 'severity', 'mean_confidence', '', avg(severity_confidence) FROM predicted
  UNION ALL SELECT 'pseudo_labels', 'mismatches', '', sum(is_mismatch) FROM predicted
  UNION ALL SELECT 'pseudo_labels', 'aligned', '', sum(1 - is_mismatch) FROM predicted
  UNION ALL SELECT 'pseudo_labels', 'in_training', '',
                   count(*) FILTER (WHERE include_in_training) FROM predicted
  UNION ALL SELECT 'predictions', 'mismatches', '', sum(mismatch_predicted) FROM predicted) t""")

# ---------------------------------------- the same results on another way
for _name, _of in (
    ("csv_scan", "scan_tickets"), ("sentiment_compound_table", "sentiment_compound"),
    ("label_prob_join", "label_prob_blend"), ("pseudo_label_roundtrip", "pseudo_labels"),
):
    ORACLES[_name] = ORACLES[_of]
ORACLES["dossier_roundtrip"] = W(
    ("records",), "SELECT ticket_id, recommended_action AS action, inferred_severity, priority_gap FROM records")
_SCALED = ", ".join(f"({i}, '{c}', {c})" for i, c in enumerate(STRUCTURAL_FEATURES))
ORACLES["feature_vector_entries"] = W(("weights", "vocab", "scaled"), f"""
SELECT ticket_id, CAST(idx AS INTEGER) AS idx, round(value, 6) AS value FROM (
  SELECT ticket_id, idx, weight AS value FROM weights
  UNION ALL
  SELECT CAST(vec_id AS VARCHAR), (SELECT count(*) FROM vocab) + dim, CASE WHEN n > 0 THEN x / n ELSE x END
  FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS n
        FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x,
                     generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) a) b
  WHERE CAST(vec_id AS VARCHAR) IN (SELECT ticket_id FROM scaled)
  UNION ALL
  SELECT ticket_id, (SELECT count(*) FROM vocab) + (SELECT max(len(embedding)) FROM embeddings) + t.i, t.value
  FROM scaled, LATERAL (VALUES {_SCALED}) t(i, name, value)
) e WHERE value <> 0""")
ORACLES["train_predict_checks"] = W(("labelled",), """
SELECT 'out_of_fold' AS part, fold, count(*) AS n, count(*) AS n_ids, count(*) AS n_in_range
FROM (SELECT CAST((row_number() OVER (PARTITION BY is_mismatch ORDER BY md5('42:' || ticket_id)) - 1)
                  % 5 AS INTEGER) AS fold FROM labelled WHERE include_in_training) f GROUP BY fold
UNION ALL
SELECT 'scored', NULL, count(*), count(*), count(*) FROM labelled""")
stage("points", ("scored",), """
SELECT x, own_n, own_pos, sum(own_n) OVER (ORDER BY x) AS n, sum(own_pos) OVER (ORDER BY x) AS pos
FROM (SELECT mismatch_probability AS x, count(*) AS own_n, sum(is_mismatch)::DOUBLE AS own_pos
      FROM scored GROUP BY 1) p""")
ORACLES["isotonic_scores"] = W(("scored", "points"), """
SELECT ticket_id, mismatch_probability, round(fitted, 6) AS fitted FROM scored JOIN (
  SELECT x, max(low) AS fitted FROM (
    SELECT b.x, min((b.pos - a.pos + a.own_pos) / (b.n - a.n + a.own_n))
                  OVER (PARTITION BY a.x ORDER BY b.x DESC) AS low
    FROM points a JOIN points b ON a.x <= b.x) m
  GROUP BY x) f ON mismatch_probability = x""")
_ALL_TICKETS = "(SELECT count(*) FROM labelled)"
_TRAINING = "(SELECT count(*) FROM labelled WHERE include_in_training)"
_FACTS = {
    "tickets": _ALL_TICKETS, "tickets in training": _TRAINING,
    "scores of held-out tickets": _TRAINING, "held-out tickets": _TRAINING,
    "scored tickets": _ALL_TICKETS, "scores from 0 to 1": _ALL_TICKETS,
    "flagged tickets without a document": "0", "documents of other tickets": "0",
    "documents with over five attributions": "0",
    "margins that contributions add up to": _ALL_TICKETS,
    "report lines that differ when read back": "0",
    "too few rows are refused": "1", "tickets without a severity are refused": "1",
    "tickets without texts are refused": "1",
    "report lines: dataset": "(SELECT 1 + count(DISTINCT priority) FROM labelled)",
    "report lines: severity": "(SELECT 1 + count(DISTINCT inferred_severity) FROM labelled)",
    "report lines: pseudo_labels": "3", "report lines: predictions": "1",
    # six numbers of each of five folds, and four of all
    "report lines: cross_validation": "34",
    "report lines: out_of_fold": "9", "report lines: oof_report": "20",
    "report lines: slices": """(SELECT 3 * count(*) FROM (SELECT priority FROM labelled GROUP BY 1
                                HAVING count(*) > 10 AND count(DISTINCT is_mismatch) > 1) t)""",
    "report lines: sanity": "5",
}
ORACLES["audit_checks"] = W(("labelled",), " UNION ALL ".join(
    f"SELECT '{what}' AS what, CAST({n} AS BIGINT) AS n" for what, n in _FACTS.items()))
ORACLES["model_roundtrip"] = W(("labelled",), f"""
SELECT {_ALL_TICKETS} AS n, {_ALL_TICKETS} AS n_own, {_ALL_TICKETS} AS n_loaded,
       CAST(0 AS BIGINT) AS n_differ,
       true AS same_threshold, {_TRAINING} AS n_oof""")
