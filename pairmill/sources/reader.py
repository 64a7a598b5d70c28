"""One table of raw rows from every config of a catalog: Parquet, JSON lines and text, each row with its place.

``row_pos`` is the place of a row in its config: files in the order of their paths, rows in the order of
the file. Parquet tells a row's index in its file. Lines have none, so the rows of each file split are
counted, together with the first of the ids that Spark gives to the rows of a task one after the other;
the counts of the splits before, plus the distance from that first id, is the place. The table of files
or splits is small, the rows themselves are neither sorted nor shuffled, and how files are split into
tasks changes nothing.

A config is one row of the expanded catalog. ``path`` is below the caller's root unless it is absolute or
has a scheme; ``data_dir`` is a folder in it, ``data_files`` a glob whose last part names files, at any
depth if it begins with ``**``. A column ``split`` or ``name`` in the data, as a partition has one, is
filtered by the config's. What is announced as Parquet and is none is read as lines.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairmill.sources.scans import is_wrong_format
from pairmill.storage import broadcast_if_bounded

RAW_SCHEMA = "domain string, source string, dataset string, row_pos bigint, raw string"
LINE_SUFFIXES = (".json", ".jsonl", ".ndjson")
TEXT_SUFFIXES = (".txt", ".text", ".md")
PACKED = (".gz", ".bz2", ".zst", ".lz4", ".snappy")


def _placed(rows: DataFrame, split: Column, inside: Column, first: Column, raw: Column) -> DataFrame:
    """(row_pos, raw): rows of the splits before, by (file, split), and the place in the split itself."""
    seen = rows.select(split.alias("_split"), inside.alias("_inside"))
    counts = seen.groupBy("_split").agg(F.count(F.lit(1)).alias("_rows"), F.min("_inside").alias("_first"))
    before = Window.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_split", first.alias("_first"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    located = rows.select(split.alias("_split"), inside.alias("_inside"), raw.alias("raw"))
    located = located.join(broadcast_if_bounded(offsets), "_split")
    return located.select((F.col("_before") + F.col("_inside") - F.col("_first")).alias("row_pos"), "raw")


def place_parquet(rows: DataFrame) -> DataFrame:
    """(row_pos, raw) of a Parquet scan; ``raw`` is the row as JSON in its own column order."""
    columns = [c for c in rows.columns]
    located = rows.select("*", F.struct(F.col("_metadata.file_path")).alias("_file"), F.col("_metadata.row_index").alias("_index"))
    raw = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]))
    return _placed(located, F.col("_file"), F.col("_index"), F.lit(0), raw)


def place_lines(lines: DataFrame, raw: Column) -> DataFrame:
    """(row_pos, raw) of a text scan with a column ``value``; lines without any visible character are no rows."""
    split = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    some = lines.select(split.alias("_place"), "value").where(F.col("value").rlike(r"\S"))
    located = some.withColumn("_id", F.monotonically_increasing_id())
    return _placed(located, F.col("_place"), F.col("_id"), F.col("_first"), raw)


def _kind(data_files: str | None) -> str | None:
    name = (data_files or "").lower().rstrip("*")
    for packed in PACKED:
        name = name.removesuffix(packed)
    if name.endswith(LINE_SUFFIXES):
        return "json"
    return "text" if name.endswith(TEXT_SUFFIXES) else "parquet" if name.endswith(".parquet") else None


def _folder(root: str, path: str, data_dir: str | None) -> str:
    base = path if "://" in path or path.startswith("/") else f"{root.rstrip('/')}/{path}"
    return f"{base}/{data_dir.strip('/')}" if data_dir else base


def scan_config(spark: SparkSession, root: str, config) -> DataFrame:
    """(row_pos, raw) of one config, a Row of the expanded catalog."""
    folder, files = _folder(root, config.path, config.data_dir), config.data_files

    def reader():
        made = spark.read.option("pathGlobFilter", files.rsplit("/", 1)[-1]) if files else spark.read
        return made.option("recursiveFileLookup", "true") if files and files.startswith("**") else made

    kind = _kind(files)
    if kind in (None, "parquet"):
        try:
            rows = reader().parquet(folder)
        except Exception as error:
            if not is_wrong_format(error):
                raise
            kind = "json"
        else:
            for column, wanted in (("split", config.split), ("name", config.name)):
                if column in rows.columns:
                    rows = rows.where(F.col(column) == wanted)
            return place_parquet(rows)
    lines = reader().text(folder)
    return place_lines(lines, F.col("value") if kind == "json" else F.to_json(F.struct(F.col("value").alias("text"))))


def scan_catalog(spark: SparkSession, root: str, expanded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows of all configs (``RAW_SCHEMA``), and (source, ok, detail) of each config.

    The loop runs over the catalog, not over data. A config whose path is not there, or holds nothing that can
    be read, is reported and gives no rows; any other error, as of the storage, ends the scan.
    """
    order = ["domain_pos", "dataset_pos", "config_pos"]
    configs = expanded.orderBy(*[c for c in order if c in expanded.columns], "domain", "dataset", "source").collect()
    parts, status = [], []
    for config in configs:
        try:
            rows = scan_config(spark, root, config)
        except AnalysisException as error:
            status.append((config.source, False, error.getCondition() or "unreadable"))
            continue
        keys = [F.lit(config[k]).cast("string").alias(k) for k in ("domain", "source", "dataset")]
        parts.append(rows.select(*keys, F.col("row_pos").cast("bigint").alias("row_pos"), "raw"))
        status.append((config.source, True, None))
    made = spark.createDataFrame([], RAW_SCHEMA)
    for part in parts:
        made = made.union(part)
    return made, spark.createDataFrame(status, "source string, ok boolean, detail string")
