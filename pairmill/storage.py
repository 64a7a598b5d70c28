"""Where staged tables go, and which sides of a join may be broadcast."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARED_DIR_CONF = "spark.checkpoint.dir"
BROADCAST_ROWS = 200_000
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows that Python is handed at once while a table is staged; a longer row goes alone.
BATCH_BYTES = 2 << 20

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder the session names for checkpoints and staged tables.

    Only a local-mode session that names none gets one of its own; on a cluster a
    missing setting is an error, because a machine-local folder dies with its machine.
    """
    named = spark.conf.get(SHARED_DIR_CONF, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SHARED_DIR_CONF} to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="pairmill-")
    return _local_dirs[app]


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; never reused, so a rerun cannot see old files."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage and survives lost executors."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def session_conf(spark: SparkSession, name: str, value: int | str) -> Iterator[None]:
    """The setting holds for what is planned and run in here."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(value))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def staged_mapped(df: DataFrame, label: str) -> DataFrame:
    """As ``staged``, for rows that Python functions make. Batches are bounded by bytes: of 10,000 rows each,
    as they are otherwise, a Python worker would hold more the longer the rows are."""
    with session_conf(df.sparkSession, BATCH_CONF, BATCH_BYTES):
        return staged(df, label)


def broadcast_if_bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting that at most ``max_rows`` rows exist.

    Beyond the bound the frame comes back without a hint and the join shuffles.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df
