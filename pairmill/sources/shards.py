"""Shard tables: Parquet with the domain and source as partitions instead of names in a file."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmill.functions.text import shard_name
from pairmill.storage import session_conf, work_path

CHUNKS_PER_FILE = 20
LISTING_CONF = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
KEPT_CONF = "spark.sql.hive.filesourcePartitionFileCacheSize"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Directories of chunks that the driver lists at once. It holds some 2 KB for each while they are listed and read.
MOST_LISTED = 10_000
RUNS, COMMITS = "runs", "commits"
COMMIT_SCHEMA = "version bigint, run string"


def write_shards(
    df: DataFrame,
    path: str,
    chunks_per_file: int = CHUNKS_PER_FILE,
    chunk_dirs: bool = False,
    mode: str = "append",
) -> None:
    """Write numbered samples. Each task takes whole chunks, so no task grows with its source.

    A directory per chunk means millions of directories on a large corpus; by default a file
    holds ``chunks_per_file`` chunks in order, and the chunk filter uses Parquet statistics.
    """
    if chunk_dirs:
        placed = df.repartition("domain", "source", "chunk_id")
        parts = ["domain", "source", "chunk_id"]
    else:
        placed = df.repartition("domain", "source", F.floor(F.col("chunk_id") / chunks_per_file))
        parts = ["domain", "source"]
    order = ["domain", "source", "chunk_id", "pos_in_chunk"]
    # the exchanges of the samples go when they are written, not when the driver happens to collect its garbage
    with session_conf(df.sparkSession, CLEANUP_CONF, "true"):
        placed.sortWithinPartitions(*order).write.mode(mode).partitionBy(*parts).parquet(path)


def _place(spark: SparkSession, path: str):
    """A path and the file system that Spark reads it with, whatever the scheme."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _folder_exists(spark: SparkSession, path: str) -> bool:
    place, files = _place(spark, path)
    return files.exists(place)


def _below(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder that Spark does not hide, fetched in one call."""
    place, files = _place(spark, folder)
    jvm = spark.sparkContext._jvm
    paths = jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(files.listStatus(place))
    listed = jvm.scala.runtime.ScalaRunTime.stringOf(paths).removeprefix("Array(").removesuffix(")")
    names = f", {listed}".split(f", {files.makeQualified(place).toString()}/")[1:]  # no name has a slash
    return [n for n in names if n[0] != "." and (n[0] != "_" or "=" in n)]


def committed_runs(spark: SparkSession, path: str) -> list[str]:
    """Names of the runs that were published, in their order; one small file each."""
    if not _folder_exists(spark, f"{path}/{COMMITS}"):
        return []
    rows = spark.read.schema(COMMIT_SCHEMA).json(f"{path}/{COMMITS}").collect()
    return [r.run for r in sorted(rows, key=lambda r: (r.version, r.run))]


def has_shards(spark: SparkSession, path: str) -> bool:
    return bool(committed_runs(spark, path))


def commit_shards(df: DataFrame, path: str, run: str | None = None, **layout) -> str:
    """Write numbered samples as one run of a shard table, and publish it by one small file.

    Readers see published runs only, so a run that is killed leaves nothing to be seen. A run of the same
    name that was not published is replaced; one that was is refused. Runs are folders of their own, and
    the file that publishes one is moved to its place whole, so readers never see half of it.
    """
    spark = df.sparkSession
    before = committed_runs(spark, path)
    run = run or uuid.uuid4().hex
    if run in before:
        raise FileExistsError(f"run {run} of {path} is published")
    write_shards(df, f"{path}/{RUNS}/{run}", mode="overwrite", **layout)
    note = spark.createDataFrame([(len(before), run)], COMMIT_SCHEMA)
    note.coalesce(1).write.mode("append").json(f"{path}/{COMMITS}")
    return run


def _read(spark: SparkSession, path: str) -> DataFrame:
    """Published runs, or a plain folder of shards."""
    runs = committed_runs(spark, path)
    if not runs and _folder_exists(spark, f"{path}/{RUNS}"):
        raise FileNotFoundError(f"{path} has no published run")
    parts = [open_shards(spark, f"{path}/{RUNS}/{run}") for run in runs] or [open_shards(spark, path)]
    made = parts[0]
    for part in parts[1:]:
        made = made.unionByName(part, allowMissingColumns=True)
    return made


def open_shards(spark: SparkSession, path: str) -> DataFrame:
    """A folder of shards. Domain and source stay text as written: a source named 007 must not come back as the
    number 7, and a NULL one comes back as NULL."""
    chunks = _chunk_folders(spark, path)
    with session_conf(spark, LISTING_CONF, 2 * spark.sparkContext.defaultParallelism):
        if chunks:
            return _open_chunks(spark, path, chunks)
        found = spark.read.parquet(path).schema
        return spark.read.schema(_typed(found)).parquet(path)


def _typed(found: Iterable[T.StructField]) -> T.StructType:
    names = ("domain", "source")
    return T.StructType([T.StructField(f.name, T.StringType() if f.name in names else f.dataType) for f in found])


def _chunk_folders(spark: SparkSession, path: str) -> list[str]:
    """The directories of all chunks; none where anything in the folder is laid out in another way."""
    folders = [path] if _folder_exists(spark, path) else []
    for column in ("domain", "source", "chunk_id"):
        below = [(folder, _below(spark, folder)) for folder in folders]
        if not all(n.startswith(f"{column}=") for _, names in below for n in names):
            return []
        folders = [f"{folder}/{n}" for folder, names in below for n in names]
    return folders


def _open_chunks(spark: SparkSession, path: str, chunks: list[str]) -> DataFrame:
    """A directory per chunk, listed by two tasks a core. Spark takes a task a directory otherwise, and what a task
    reports to the driver besides the files, some 3 KB, is most of what a directory per chunk sends there.

    The types of its columns are those of one file, so that Spark need not guess them from the name of every
    directory, on the driver. That also holds all directories of a read, and its time for them grows with their
    square: more than ``MOST_LISTED`` are read in parts, each written to one table without directories.
    """
    parts = [T.StructField("domain", T.StringType()), T.StructField("source", T.StringType()), T.StructField("chunk_id", T.IntegerType())]
    schema = _typed([*spark.read.parquet(chunks[0]).schema, *parts])
    with session_conf(spark, KEPT_CONF, 0):  # or Spark holds what it has listed for later reads
        if len(chunks) <= MOST_LISTED:
            return _by_bytes(spark.read.schema(schema).option("basePath", path).parquet(*chunks))
        table = work_path(spark, "opened-shards")
        for at in range(0, len(chunks), MOST_LISTED):
            part = spark.read.schema(schema).option("basePath", path).parquet(*chunks[at : at + MOST_LISTED])
            _by_bytes(part).write.mode("append").parquet(table)
    return spark.read.schema(schema).parquet(table)


def _by_bytes(found: DataFrame) -> DataFrame:
    """As many tasks as the bytes of the files ask for, two a core at least. Spark counts every file as 4 MB more, so
    that a directory per chunk is read by a task for each few chunks, and what they return is written as many files."""
    spark = found.sparkSession
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    tasks = -(-int(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // most)
    return found.coalesce(max(tasks, 2 * spark.sparkContext.defaultParallelism))


def scan_shards(spark: SparkSession, path: str, phase: str | None = None) -> DataFrame:
    """All shards, or those of one phase; the phase prunes directories."""
    df = _read(spark, path)
    return df if phase is None else df.where(F.col("domain") == phase)


def scan_shards_named(spark: SparkSession, path: str, part: str) -> DataFrame:
    """Shards whose name contains ``part`` anywhere, as a substring test selects them."""
    df = _read(spark, path)
    return df.where(name_of(df).contains(part))


def name_of(df: DataFrame) -> Column:
    return shard_name(df["domain"], df["source"], df["chunk_id"])


def flatten_shards(df: DataFrame, samples: str) -> DataFrame:
    """Rows that hold a list of samples become one row per sample; empty lists vanish."""
    rest = [c for c in df.columns if c != samples]
    return df.select(*rest, F.explode(samples).alias("_sample")).select(*rest, "_sample.*")


def sync_missing(local: DataFrame, remote: DataFrame, key: str = "shard_name") -> DataFrame:
    """Local shards and those the remote side has beyond them; present names are left alone."""
    missing = remote.join(local, key, "left_anti")
    return local.unionByName(missing)
