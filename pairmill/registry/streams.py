"""Incremental ingestion of the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairmill.operators.normalize import drop_empty_pairs, normalize_pairs, pair_columns
from pairmill.registry.base import SQL_CUT_DOCS, query, table
from pairmill.registry.corpus import document_rows
from pairmill.storage import work_path
from pairmill.streaming import ingest, state

CHUNK = 10
SCHEMA = "domain string, source string, dataset string, row_pos bigint, raw string"


def _arrivals(spark, sf_dir, files=6):
    """The documents as raw rows in several files, as they would arrive."""
    path = work_path(spark, "arrivals")
    document_rows(spark, sf_dir).repartition(files, "row_pos").write.parquet(path)
    return path


def _accept(rows):
    made = drop_empty_pairs(pair_columns(normalize_pairs(rows)))
    return made.select("domain", "source", "row_pos", "prompt", "response", "rule")


def _drain(spark, path, root, files_per_trigger=2):
    stream = ingest.read_source_stream(spark, path, SCHEMA, files_per_trigger=files_per_trigger)
    query_ = ingest.stream_ingest(stream, root, _accept, f"{root}/checkpoint", CHUNK)
    query_.awaitTermination()
    return query_


_ACCEPTED = f"{SQL_CUT_DOCS}, accepted AS (SELECT * FROM cut_docs WHERE length(sp) > 0 AND length(sr) > 0)"
_ROWS = f"""WITH {_ACCEPTED} SELECT lang AS domain, source, doc_id AS row_pos, sp AS prompt, sr AS response,
    'text_split' AS rule FROM accepted"""
_CHUNKS = f"""WITH {_ACCEPTED}, placed_rows AS (SELECT lang AS domain, source, (row_number() OVER
      (PARTITION BY lang, source ORDER BY doc_id) - 1) // {CHUNK} AS c FROM accepted)
    SELECT domain, source, cast(c AS INT) AS chunk_id, count(*) AS n_rows FROM placed_rows GROUP BY ALL"""


@query("stream_ingest", _ROWS)
def stream_ingest(spark, sf_dir):
    root = work_path(spark, "stream")
    _drain(spark, _arrivals(spark, sf_dir), root)
    made = ingest.stream_samples(spark, root)
    return made.select("domain", "source", "row_pos", "prompt", "response", "rule")


@query("stream_resume", _ROWS)
def stream_resume(spark, sf_dir):
    """Half of the files, a stop, then the rest under the same checkpoint."""
    path, root = work_path(spark, "arrivals"), work_path(spark, "stream")
    rows = document_rows(spark, sf_dir)
    early = F.pmod(F.xxhash64("row_pos"), F.lit(2)) == 0
    rows.where(early).repartition(3).write.parquet(path)
    _drain(spark, path, root)
    rows.where(~early).repartition(3).write.mode("append").parquet(path)
    _drain(spark, path, root)
    made = ingest.stream_samples(spark, root)
    return made.select("domain", "source", "row_pos", "prompt", "response", "rule")


@query("stream_shard_numbering", _CHUNKS)
def stream_shard_numbering(spark, sf_dir):
    root = work_path(spark, "stream")
    _drain(spark, _arrivals(spark, sf_dir), root)
    return ingest.stream_manifest(spark, root)


@query(
    "stream_tail_flush",
    f"""WITH {_ACCEPTED}, totals AS (SELECT lang AS domain, source, count(*) AS n FROM accepted GROUP BY ALL)
    SELECT domain, source, n AS n_rows, cast((n - 1) // {CHUNK} AS INT) AS last_chunk,
      n - ((n - 1) // {CHUNK}) * {CHUNK} AS tail_rows FROM totals""",
)
def stream_tail_flush(spark, sf_dir):
    """The last, short chunk of each source is there after the stream has drained."""
    root = work_path(spark, "stream")
    _drain(spark, _arrivals(spark, sf_dir), root)
    chunks = ingest.stream_manifest(spark, root)
    tails = chunks.groupBy("domain", "source").agg(
        F.max("chunk_id").alias("last_chunk"), F.max_by("n_rows", "chunk_id").alias("tail_rows")
    )
    return ingest.stream_totals(spark, root).join(tails, ["domain", "source"])


@query("stream_metrics", "SELECT cast(sum(n) AS BIGINT) AS n_rows, true AS has_speed FROM (SELECT count(*) AS n FROM documents)")
def stream_metrics(spark, sf_dir):
    """All rows are counted in some micro-batch, and each batch with rows has a speed."""
    drained = _drain(spark, _arrivals(spark, sf_dir), work_path(spark, "stream"))
    found = ingest.stream_metrics(spark, drained).where("n_rows > 0")
    return found.agg(F.sum("n_rows").alias("n_rows"), F.min(F.col("rows_per_sec") > 0).alias("has_speed"))


@query("stream_error_end", "SELECT * FROM (VALUES ('good', true), ('broken', false), ('again', true)) v(source, ok)")
def stream_error_end(spark, sf_dir):
    """One query per language; the one whose files are broken ends alone."""
    good = _arrivals(spark, sf_dir)
    bad = work_path(spark, "broken")
    table(spark, sf_dir, "documents").select("text").write.text(bad)

    def start(path):
        root = work_path(spark, "stream")
        stream = ingest.read_source_stream(spark, path, SCHEMA)
        return ingest.stream_ingest(stream, root, _accept, f"{root}/checkpoint", CHUNK)

    return ingest.run_sources(
        spark, [("good", lambda: start(good)), ("broken", lambda: start(bad)), ("again", lambda: start(good))]
    ).select("source", "ok")


_RUNS = 3
_STATE_CAPS = (("en", None, 25), (None, "src3", 2), ("de", None, 7))
_STATE_NUMBERED = f"""WITH {_ACCEPTED}, keyed AS (SELECT nullif(lang, 'fr') AS domain,
      CASE WHEN source <> 'src1' THEN source END AS source, source AS dataset, doc_id, sp, sr FROM accepted),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY domain, source ORDER BY doc_id) - 1 AS seq FROM keyed)
    SELECT domain, source, doc_id AS row_pos, sp AS prompt, sr AS response, cast(seq // {CHUNK} AS INT) AS chunk_id,
      cast(seq % {CHUNK} AS INT) AS pos_in_chunk FROM numbered"""


def _state_runs(spark, sf_dir, rules=None):
    """The documents in three runs under one checkpoint, a third of the ids each; some keys are NULL."""
    path, root = work_path(spark, "arrivals"), work_path(spark, "state")
    rows = document_rows(spark, sf_dir).withColumns(
        {"domain": F.expr("nullif(domain, 'fr')"), "source": F.expr("if(source <> 'src1', source, null)")}
    )
    most = (rows.agg(F.max("row_pos")).first()[0] or 0) + 1

    def accept(raw):
        made = drop_empty_pairs(pair_columns(normalize_pairs(raw)))
        return made.select("domain", "source", "dataset", "row_pos", "prompt", "response")

    for run in range(_RUNS):
        part = F.floor(F.col("row_pos") * _RUNS / most) == run
        rows.where(part).coalesce(1).write.mode("append").parquet(path)
        stream = ingest.read_source_stream(spark, path, SCHEMA)
        state.state_ingest(stream, root, accept, f"{root}/checkpoint", CHUNK, rules).awaitTermination()
    schema = "domain string, source string, row_pos bigint, prompt string, response string, chunk_id int, pos_in_chunk int"
    return state.state_samples(spark, root, schema).select(
        "domain", "source", "row_pos", "prompt", "response", "chunk_id", "pos_in_chunk"
    )


@query("stream_state_numbering", _STATE_NUMBERED)
def stream_state_numbering(spark, sf_dir):
    """Numbers kept as state go on over three runs, and are those of the batch."""
    return _state_runs(spark, sf_dir)


@query(
    "stream_state_caps",
    f"""{_STATE_NUMBERED} WHERE seq < CASE WHEN domain = 'en' THEN 25 WHEN dataset = 'src3' THEN 2
      WHEN domain = 'de' THEN 7 ELSE 1000000000 END""",
)
def stream_state_caps(spark, sf_dir):
    """Caps count over runs: what earlier runs accepted is part of the state."""
    return _state_runs(spark, sf_dir, _STATE_CAPS)
