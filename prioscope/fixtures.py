"""Ticket tables derived from the test data, for checks and benchmarks.

The whole ``documents`` table becomes tickets, with the whole text of each
document as the description. Ordinary prose has few urgency words, so a phrase
derived from the row's id is put in front of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prioscope.config import AuditConfig
from prioscope.functions.text import derive, sql_strings
from prioscope.operators.ingest import prepare_tickets
from prioscope.operators.labels import pseudo_labels
from prioscope.operators.severity import infer_severity

PHRASES = (
    "system down", "data breach", "cannot access", "ASAP", "not working", "major issue",
    "very slow", "frustrated", "intermittent", "error repeatedly", "wrong result",
    "minor disruption", "question", "feature request", "typo", "how to", "thank you",
)
VALENCE = {
    "frustrated": -2.0, "problem": -1.7, "broken": -1.5, "please": 1.3, "thank": 1.5,
    "great": 3.1, "error": -1.4, "issue": -0.5, "slow": -0.4,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _phrase(key: str) -> str:
    return f"element_at({sql_strings(PHRASES)}, CAST(({key}) % {len(PHRASES)} + 1 AS INT))"


def raw_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten raw columns, all strings, one row per document whose id is also an order's."""
    docs = table(spark, sf_dir, "documents")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    rows = docs.join(orders, docs.doc_id == orders.o_orderkey)
    a, b, c = _phrase("doc_id"), _phrase("doc_id * 3 + 5"), _phrase("doc_id * 5 + 2")
    return rows.selectExpr(
        "CAST(doc_id AS STRING) AS Ticket_ID",
        f"""CASE WHEN doc_id % 10 = 9 THEN '  '
                 ELSE concat('Re: ', {a}, IF(doc_id % 4 = 0, '!!', '')) END AS Ticket_Subject""",
        f"""concat(CASE
              WHEN doc_id % 7 = 3 THEN concat('This is not ', {b}, ' anymore.\\r\\n')
              WHEN doc_id % 7 = 5 THEN concat('A &amp; B &lt;x&gt; see https://kb.example.com/',
                                              doc_id, ' ', upper({b}), '? ')
              ELSE concat('We have ', {b}, ', then ', {c}, '. ') END, text)
            AS Ticket_Description""",
        "o_orderpriority AS Ticket_Priority",
        "CASE WHEN doc_id % 11 <> 0 THEN lang END AS Ticket_Type",
        "o_orderstatus AS Ticket_Status",
        "source AS Ticket_Channel",
        """CASE WHEN doc_id % 6 = 1 THEN NULL WHEN doc_id % 6 = 2 THEN 'n/r'
                ELSE CAST(1 + (doc_id * 7) % 5 AS STRING) END AS CSAT""",
        """CASE doc_id % 5 WHEN 0 THEN CAST((doc_id * 37) % 5000 AS STRING)
                WHEN 1 THEN concat(doc_id % 9, ' hours ', doc_id % 60, ' minutes')
                WHEN 2 THEN concat(1 + doc_id % 90, ' min')
                WHEN 3 THEN 'soon' END AS First_Response_Time""",
        """CASE doc_id % 4 WHEN 0 THEN concat(1 + doc_id % 6, ' days')
                WHEN 1 THEN concat(1 + doc_id % 30, '.5 hr')
                WHEN 2 THEN concat((doc_id * 101) % 90000, '.0')
                ELSE '45 sec' END AS Time_to_Resolution""",
    )


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare_tickets(raw_tickets(spark, sf_dir), validate=False)


def severity(spark: SparkSession, sf_dir: str, config: AuditConfig = AuditConfig()) -> DataFrame:
    return infer_severity(tickets(spark, sf_dir), config=config, valence=VALENCE)


def labelled(spark: SparkSession, sf_dir: str, config: AuditConfig = AuditConfig()) -> DataFrame:
    return pseudo_labels(severity(spark, sf_dir, config), config)


# a stand-in score, so that metrics can be checked without a model
PROBABILITY = (
    "round(0.5D * inferred_severity_score "
    "+ 0.5D * ((CAST(ticket_id AS BIGINT) * 7919) % 1000) / 1000D, 6)"
)


def with_label_probabilities(df: DataFrame) -> DataFrame:
    """Four probabilities per ticket, derived from its id."""
    factors = {"p_critical": 3, "p_high": 5, "p_medium": 11, "p_low": 13}
    raw = {c: f"(1 + (CAST(ticket_id AS BIGINT) * {k}) % 7)" for c, k in factors.items()}
    total = " + ".join(raw.values())
    return derive(df, {c: f"{value} / ({total})" for c, value in raw.items()})
