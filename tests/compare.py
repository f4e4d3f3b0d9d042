"""Compare a Spark result with a DuckDB result, without regard to row order."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if value is None or isinstance(value, (str, bool)):
        return value
    return float(value) if not isinstance(value, int) else value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def differences(spark_df, con, sql: str) -> list[str]:
    cursor = con.execute(sql)
    theirs_columns = [d[0] for d in cursor.description]
    theirs = _rows(theirs_columns, cursor.fetchall())
    ours = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(theirs_columns) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} != {sorted(theirs_columns)}"]
    out = []
    if len(ours) != len(theirs):
        out.append(f"rows {len(ours)} != {len(theirs)}")
    extra = set(map(repr, ours)) - set(map(repr, theirs))
    lacking = set(map(repr, theirs)) - set(map(repr, ours))
    if extra or lacking:
        out.append(f"{len(extra)} only in Spark, {len(lacking)} only in DuckDB")
        out += [f"  spark  {r[:300]}" for r in sorted(extra)[:3]]
        out += [f"  duckdb {r[:300]}" for r in sorted(lacking)[:3]]
    return out


SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "16k",
    "spark.sql.files.openCostInBytes": "1k",
}


def splits_hot_keys(spark, make) -> bool:
    """Whether adaptive execution splits a join of ``make()``, with every side too large for a broadcast."""
    before = {k: spark.conf.get(k, None) for k in SKEW}
    try:
        for k, v in SKEW.items():
            spark.conf.set(k, v)
        df = make()
        df.collect()
        return "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
