"""From a raw ticket table to the cleaned one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prioscope.functions import text as T
from prioscope.functions.ordering import number_by, number_rows
from prioscope.sources.tickets import check_required_columns, resolve_columns, standardise


def with_priority(df: DataFrame, column: str = "priority") -> DataFrame:
    """Keep the raw value, add the normalised level (nullable) and its rank."""
    level = T.derive(df, {"priority_raw": column, "priority": T.normalise_priority(column)})
    return T.derive(level, {"priority_rank": T.priority_rank("priority")})


def dropped_priority_counts(df: DataFrame) -> DataFrame:
    """How many rows have a recognised priority, and how many would be dropped."""
    known = F.count("priority")
    return with_priority(df).agg(
        F.count(F.lit(1)).alias("n_rows"),
        known.alias("n_kept"),
        (F.count(F.lit(1)) - known).alias("n_dropped"),
    )


def with_clean_text(df: DataFrame) -> DataFrame:
    clean = T.derive(df, {c: T.clean_text(c) for c in ("subject", "description", "resolution")})
    return T.derive(clean, {"full_text": T.full_text("subject", "description")})


def with_numbers(df: DataFrame, seconds_per_plain_unit: float = 1.0) -> DataFrame:
    return T.derive(df, {
        "first_response_minutes": T.duration_minutes("first_response", seconds_per_plain_unit),
        "resolution_time_minutes": T.duration_minutes("resolution_time", seconds_per_plain_unit),
        "csat_numeric": T.to_number("csat"),
    })


def synthetic_ids(df: DataFrame, order: list | None = None) -> DataFrame:
    """``TKT-000000``, ``TKT-000001``, ... by row order, or by ``order`` if given.

    The rows are stored once, with their place in their task; an id is that place and the count of the tasks
    before, so the result reads the stored rows and needs no copy of its own.
    """
    numbered = number_by(df, order, "_position") if order else number_rows(df, "_position")
    return numbered.withColumn(
        "ticket_id", F.format_string("TKT-%06d", F.col("_position"))
    ).drop("_position")


def prepare_tickets(raw: DataFrame, validate: bool = True,
                    seconds_per_plain_unit: float = 1.0) -> DataFrame:
    """Headers, priority, text, durations and ids: the table all other steps read.

    Without an id column it is a stored table already, see ``synthetic_ids``.
    """
    has_id = resolve_columns(raw.columns)["ticket_id"] is not None
    df = standardise(raw)
    if validate:
        check_required_columns(df, raw.columns)
    df = with_priority(df).filter("priority IS NOT NULL")
    df = with_numbers(with_clean_text(df), seconds_per_plain_unit)
    if has_id:
        return T.derive(df, {"ticket_id": T.strip("CAST(ticket_id AS STRING)")})
    return synthetic_ids(df.drop("ticket_id"))


def priority_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("priority").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))
