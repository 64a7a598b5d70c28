"""Readers. Schemas are declared wherever the caller knows them, so no reader scans data twice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

STATUS_SCHEMA = "source string, ok boolean, detail string"


def scan_structured(
    spark: SparkSession,
    path: str,
    format: str = "parquet",
    schema: StructType | str | None = None,
    **partitions: str,
) -> DataFrame:
    """Read a source; ``partitions`` (split=.., name=..) become partition filters."""
    reader = spark.read.format(format)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    for column, value in partitions.items():
        df = df.where(F.col(column) == value)
    return df


def scan_json_glob(
    spark: SparkSession, root: str, glob: str, schema: StructType | str | None = None
) -> DataFrame:
    """JSON lines below ``root`` whose file name fits ``glob``, gzip included.

    A gzip file cannot be split, so one file is one task; callers with few large files spread
    the rows before heavy work.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(root)


def scan_text(spark: SparkSession, root: str, glob: str = "*.json*") -> DataFrame:
    """Raw lines in a column ``text``; the pair rules unpack those that hold an object."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return reader.text(root).withColumnRenamed("value", "text")


#: What readers say of files that are of another format than announced.
WRONG_FORMAT = ("is not a Parquet file", "Malformed ORC file", "UNABLE_TO_INFER_SCHEMA")


def is_wrong_format(error: Exception) -> bool:
    """Whether a reader met files of another format. Storage and network errors are not that."""
    return any(sign in str(error) for sign in WRONG_FORMAT)


def scan_or_text(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Structured read, or raw lines when the files are not what the catalog says they are."""
    try:
        df = spark.read.format(format).load(path)
        df.limit(1).count()
        return df
    except Exception as error:
        if not is_wrong_format(error):
            raise
        return scan_text(spark, path)


def scan_skip_corrupt(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Files that cannot be read, or are gone, yield no rows instead of ending the job."""
    return (
        spark.read.schema(schema)
        .option("ignoreCorruptFiles", "true")
        .option("ignoreMissingFiles", "true")
        .parquet(path)
    )


def _probe(spark: SparkSession, path: str, format: str, split: str | None) -> str | None:
    try:
        df = spark.read.format(format).load(path)
        if split is not None:
            df = df.where(F.col("split") == split)
        return None if df.limit(1).count() else "no rows"
    except AnalysisException as error:
        return error.getCondition() or "unreadable"
    except Exception as error:
        return type(error).__name__


def source_probe(
    spark: SparkSession, sources: Sequence[tuple[str, str, str]], split: str = "train"
) -> DataFrame:
    """Try one row of each (name, path, format) with its split, then without; never abort.

    The loop runs over the catalog, not over data: each step asks Spark for a single row.
    """
    rows = []
    for name, path, format in sources:
        problem = _probe(spark, path, format, split)
        if problem is not None:
            problem = _probe(spark, path, format, None)
        rows.append((name, problem is None, problem))
    return spark.createDataFrame(rows, STATUS_SCHEMA)
