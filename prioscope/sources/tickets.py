"""Reading raw ticket tables and resolving their headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prioscope.config import COLUMN_ALIASES, NA_TOKENS, REQUIRED_COLUMNS


def read_ticket_csv(spark: SparkSession, path: str, line_breaks: bool = True) -> DataFrame:
    """Scan a CSV of tickets; every column is a string, missing-value tokens are null.

    A missing path raises Spark's AnalysisException. Quoted fields may hold line
    breaks, so one file is one task; with ``line_breaks`` off, the caller says that no
    field holds one, and a file is split over many tasks.
    """
    raw = (
        spark.read.option("header", True)
        .option("multiLine", line_breaks)
        .option("quote", '"')
        .option("escape", '"')
        .option("inferSchema", False)
        .csv(path)
    )
    return null_tokens(raw)


def read_ticket_table(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Scan tickets kept as Parquet, ORC or JSON lines, on the same all-string path.

    All of them are split over many tasks. Nested columns become JSON text.
    """
    df = spark.read.format(format)
    raw = (df.option("primitivesAsString", True) if format == "json" else df).load(path)
    nested = ("struct", "array", "map")
    return null_tokens(raw.select(*[
        (F.to_json(F.col(f"`{c}`")) if kind.startswith(nested) else F.col(f"`{c}`").cast("string")).alias(c)
        for c, kind in raw.dtypes
    ]))


def null_tokens(df: DataFrame) -> DataFrame:
    def known(name: str):
        c = F.col(f"`{name}`")
        return F.when(~c.isin(*NA_TOKENS), c).alias(name)

    return df.select(*[known(name) for name in df.columns])


def header_key(name: str) -> str:
    return name.lower().strip().replace(" ", "_")


def resolve_columns(columns: list[str]) -> dict[str, str | None]:
    """Logical name to actual header, by the first alias that is present."""
    available = {header_key(c): c for c in columns}
    return {
        logical: next(
            (available[header_key(a)] for a in aliases if header_key(a) in available), None
        )
        for logical, aliases in COLUMN_ALIASES.items()
    }


def rename_to_standard(df: DataFrame, mapping: dict[str, str | None]) -> DataFrame:
    """Give resolved columns their logical names and keep all others.

    A column that would collide with a logical name taken by another header is
    kept under ``<name>_original``.
    """
    logical_of = {actual: logical for logical, actual in mapping.items() if actual is not None}
    taken = set(logical_of.values())
    names = []
    for column in df.columns:
        if column in logical_of:
            names.append(logical_of[column])
        elif column in taken:
            names.append(f"{column}_original")
        else:
            names.append(column)
    return df.toDF(*names)


def standardise(df: DataFrame) -> DataFrame:
    """Resolve and rename headers, and add absent optional columns as null strings."""
    renamed = rename_to_standard(df, resolve_columns(df.columns))
    missing = [c for c in COLUMN_ALIASES if c not in renamed.columns]
    return renamed.withColumns(
        {c: F.lit(None).cast("string") for c in missing if c not in REQUIRED_COLUMNS}
    )


def required_column_counts(df: DataFrame) -> DataFrame:
    """One row: rows, and non-null values of each required column that is present."""
    present = [c for c in REQUIRED_COLUMNS if c in df.columns]
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count(c).alias(f"n_{c}") for c in present]
    )


def check_required_columns(df: DataFrame, original_columns: list[str]) -> None:
    counts = required_column_counts(df).first().asDict()
    empty = [c for c in REQUIRED_COLUMNS if not counts.get(f"n_{c}")]
    if empty:
        raise ValueError(
            f"Required columns missing or entirely empty: {empty}. "
            f"Columns found: {original_columns}"
        )
