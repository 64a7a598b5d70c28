"""Incremental featurization: a file stream into numbered shards, exactly once.

Every micro-batch writes ``batch=<id>`` below the sample table and the running totals of all
sources below the totals table, both in overwrite mode. A batch that runs again after a failure
starts from the totals of the batch before it and so writes the same numbers. The totals have
one row per source, whatever the stream has read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from pairmill.operators.keyed import join_small
from pairmill.operators.numbering import CHUNK_SIZE, SPAN, number_rows
from pairmill.storage import staged

KEYS = ["domain", "source"]
TOTALS_SCHEMA = "domain string, source string, n_rows bigint"


def read_source_stream(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    format: str = "parquet",
    files_per_trigger: int = 100,
    skip_corrupt: bool = False,
) -> DataFrame:
    reader = spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if skip_corrupt:
        reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    return reader.load(path)


def _totals_before(spark: SparkSession, root: str, batch_id: int) -> DataFrame:
    if batch_id == 0:
        return spark.createDataFrame([], TOTALS_SCHEMA)
    return spark.read.schema(TOTALS_SCHEMA).parquet(f"{root}/totals/batch={batch_id - 1}")


def shard_sink(
    root: str,
    transform: Callable[[DataFrame], DataFrame],
    chunk_size: int = CHUNK_SIZE,
    position: str = "row_pos",
    span: int = SPAN,
) -> Callable[[DataFrame, int], None]:
    """Batch writer: transform rows, number the accepted ones on from the totals, write both."""

    def write(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        accepted = staged(transform(rows), f"micro-batch-{batch_id}")
        before = _totals_before(spark, root, batch_id)
        numbered = number_rows(accepted, KEYS, position, "_number", span)
        numbered = join_small(numbered, before, KEYS, "left").withColumn(
            "_number", F.col("_number") + F.coalesce("n_rows", F.lit(0))
        )
        numbered.withColumns(
            {
                "chunk_id": F.floor(F.col("_number") / chunk_size).cast("int"),
                "pos_in_chunk": (F.col("_number") % chunk_size).cast("int"),
            }
        ).drop("_number", "n_rows").write.mode("overwrite").parquet(f"{root}/samples/batch={batch_id}")
        added = accepted.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_rows"))
        totals = before.unionByName(added).groupBy(*KEYS).agg(F.sum("n_rows").alias("n_rows"))
        totals.write.mode("overwrite").parquet(f"{root}/totals/batch={batch_id}")

    return write


def stream_ingest(
    stream: DataFrame,
    root: str,
    transform: Callable[[DataFrame], DataFrame],
    checkpoint: str,
    chunk_size: int = CHUNK_SIZE,
    name: str | None = None,
    span: int = SPAN,
) -> StreamingQuery:
    """Start ingestion of what is there now; a later start with the same checkpoint goes on."""
    writer = (
        stream.writeStream.foreachBatch(shard_sink(root, transform, chunk_size, span=span))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    return (writer.queryName(name) if name else writer).start()


def stream_samples(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/samples")


def stream_manifest(spark: SparkSession, root: str) -> DataFrame:
    return stream_samples(spark, root).groupBy(*KEYS, "chunk_id").agg(F.count(F.lit(1)).alias("n_rows"))


def stream_totals(spark: SparkSession, root: str) -> DataFrame:
    """Running totals after the last finished batch."""
    made = spark.read.option("basePath", f"{root}/totals").parquet(f"{root}/totals")
    last = made.agg(F.max("batch")).first()[0]
    return made.where(F.col("batch") == F.lit(last)).drop("batch")


def stream_metrics(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """Rows and speed per micro-batch, as the engine has kept them."""
    rows = [
        (int(p.batchId), int(p.numInputRows), float(p.processedRowsPerSecond or 0.0))
        for p in query.recentProgress
    ]
    return spark.createDataFrame(rows, "batch_id bigint, n_rows bigint, rows_per_sec double")


class ProgressLog(StreamingQueryListener):
    """Keeps the latest row count and speed of each query while it runs."""

    def __init__(self) -> None:
        self.latest: dict[str, tuple[int, float]] = {}
        self.rows: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.rows.setdefault(str(event.runId), 0)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        run = str(progress.runId)
        self.rows[run] = self.rows.get(run, 0) + progress.numInputRows
        self.latest[run] = (progress.numInputRows, progress.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def run_sources(
    spark: SparkSession, starts: Sequence[tuple[str, Callable[[], StreamingQuery]]]
) -> DataFrame:
    """One query per source: an error ends that source, keeps what it wrote, and no other."""
    outcome = []
    for name, start in starts:
        try:
            query = start()
            query.awaitTermination()
            outcome.append((name, True, None))
        except Exception as error:
            outcome.append((name, False, type(error).__name__))
    return spark.createDataFrame(outcome, "source string, ok boolean, detail string")
