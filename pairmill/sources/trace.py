"""Metric traces as append-only tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TRACE_SCHEMA = (
    "epoch int, chunk_idx int, mb bigint, ce_loss double, jepa_loss double, "
    "route_loss double, total_loss double"
)
DECODER_TRACE_SCHEMA = "epoch int, chunk_idx int, mini_batch int, cross_entropy_loss double"


def append_trace(rows: DataFrame, path: str, format: str = "csv") -> None:
    """Each append adds files with a header of their own; readers skip it per file."""
    writer = rows.write.mode("append").format(format)
    (writer.option("header", "true") if format == "csv" else writer).save(path)


def read_trace(spark: SparkSession, path: str, schema: StructType | str, format: str = "csv") -> DataFrame:
    reader = spark.read.schema(schema).format(format)
    return (reader.option("header", "true") if format == "csv" else reader).load(path)
