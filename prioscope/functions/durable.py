"""Cutting lineage in a way that survives the loss of executors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Tables of the innermost open ``scratch`` block, if there is one.
_open: list[list[tuple[SparkSession, str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder the session names, else one below its warehouse.

    A warehouse that is a local folder is shared with no other machine: on a cluster, naming no checkpoint
    folder is then an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local") and warehouse.startswith(("file:", "/")):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share.")
    return warehouse + "/shared"


def new_folder(spark: SparkSession) -> str:
    """A folder for one table, or other files, in the shared folder; deleted like the tables of ``durable``."""
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    if _open:
        _open[-1].append((spark, path))
    return path


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder as a table, and read that from then on.

    Unlike a cached table it needs no executor to stay alive, and unlike a
    checkpoint it is columnar: later steps read only the columns they use.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.shared_path = path
    return stored


def drop(stored: DataFrame) -> None:
    """Delete a table that ``durable`` wrote and that nothing reads any more."""
    _delete(stored.sparkSession, stored.shared_path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


class Scratch:
    """What a ``scratch`` block gives: ``keep`` names tables that outlive it."""

    def __init__(self) -> None:
        self.kept: set[str] = set()

    def keep(self, *stored: DataFrame) -> None:
        self.kept.update(table.shared_path for table in stored)


@contextmanager
def scratch(*, keep_last: bool = False) -> Iterator[Scratch]:
    """Delete the tables written inside the block when it ends.

    For steps whose result is stored elsewhere, is the last table (``keep_last``), or is named to
    ``keep``. Nothing lazy that reads the other tables may leave the block.
    """
    _open.append([])
    block = Scratch()
    try:
        yield block
    finally:
        mine = _open.pop()
        for table in [t for t in mine if t[1] in block.kept]:
            mine.remove(table)
            if _open:
                _open[-1].append(table)
        if keep_last and mine:
            last = mine.pop()
            if _open:
                _open[-1].append(last)
        for spark, path in mine:
            _delete(spark, path)


def release(spark: SparkSession) -> None:
    """Delete every table this application wrote; call it once all results are stored elsewhere."""
    _delete(spark, f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}")
