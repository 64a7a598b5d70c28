"""Scalar functions over whole texts and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairmill.functions import arrays, schedules, text
from pairmill.operators.feed import teacher_shift, window_tokens
from pairmill.operators.rows import stringify
from pairmill.registry.base import (
    SQL_LENGTHS,
    SQL_TOKENS,
    documents,
    query,
    sql_strip,
    table,
    token_lengths,
)


@query("sanitize_name", "SELECT doc_id, regexp_replace(text, '[^a-zA-Z0-9_]', '_', 'g') AS safe FROM documents")
def sanitize_name(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.sanitize_name(F.col("text")).alias("safe"))


@query(
    "shard_name",
    """SELECT doc_id, lang || '_' || regexp_replace(source || '/' || lang || '_default_train',
       '[^a-zA-Z0-9_]', '_', 'g') || '_' || cast(doc_id // 1000 AS VARCHAR) || '.pt' AS shard_name
       FROM documents""",
)
def shard_name(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    safe = text.safe_source(F.concat_ws("/", "source", "lang"), F.lit("default"), F.lit("train"))
    chunk = F.floor(F.col("doc_id") / 1000)
    return docs.select("doc_id", text.shard_name(F.col("lang"), safe, chunk).alias("shard_name"))


@query(
    "shard_name_parse",
    """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE cast(doc_id AS INT) END AS chunk_id
       FROM documents""",
)
def shard_name_parse(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tail = F.when(F.col("doc_id") % 7 == 0, F.lit("x")).otherwise(F.col("doc_id").cast("string"))
    name = F.concat("lang", F.lit("_"), "source", F.lit("_"), tail, F.lit(".pt"))
    return docs.select("doc_id", text.shard_chunk_id(name).alias("chunk_id"))


@query(
    "stringify_value",
    """SELECT doc_id, text AS as_string, cast(n_chars AS VARCHAR) AS as_number,
       '["' || lang || '","' || source || '"]' AS as_list,
       '{"z":"' || source || '","a":' || cast(n_chars AS VARCHAR) || '}' AS as_object,
       CASE WHEN n_chars > 1000 THEN 'true' ELSE 'false' END AS as_flag FROM documents""",
)
def stringify_value(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("text").alias("as_string"),
        F.col("n_chars").alias("as_number"),
        F.array("lang", "source").alias("as_list"),
        F.struct(F.col("source").alias("z"), F.col("n_chars").alias("a")).alias("as_object"),
        (F.col("n_chars") > 1000).alias("as_flag"),
    )
    return docs.select("doc_id", *[stringify(docs, c).alias(c) for c in docs.columns[1:]])


_FENCED = """CASE doc_id % 3
  WHEN 0 THEN 'intro' || chr(10) || '```Rust' || chr(10) || text || chr(10) || '```' || ' rest ```' || chr(10) || 'x```'
  WHEN 1 THEN '```' || chr(10) || text || '```' ELSE '  ' || text || chr(10) END"""


@query("extract_code_block", f"SELECT doc_id, {sql_strip('text')} AS code FROM documents")
def extract_code_block(spark, sf_dir):
    docs = documents(spark, sf_dir)
    answer = F.expr(_FENCED.replace("chr(10)", "char(10)"))
    return docs.select("doc_id", text.code_block(answer).alias("code"))


_SCALED = "list_transform(embedding, lambda x: cast(x AS DOUBLE) * (vec_id + 1))"
_PACKED = "array_to_string(list_transform({}, lambda x: cast(round(x * 1000000) AS BIGINT)), ',')"


def _packed(vector):
    return arrays.joined(F.transform(vector, lambda x: F.round(x * 1000000).cast("bigint")))


def _scaled():
    return F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") + 1))


@query(
    "l2_normalize",
    f"""WITH v AS (SELECT vec_id, {_SCALED} AS v FROM embeddings),
    n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM v)
    SELECT vec_id, {_PACKED.format('list_transform(v, lambda x: x / norm)')} AS unit FROM n""",
)
def l2_normalize(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select("vec_id", _packed(arrays.l2_normalize(_scaled())).alias("unit"))


@query(
    "l2_norm_check",
    """WITH n AS (SELECT vec_id, len(embedding) AS dimension, (1 + (vec_id % 3) / 1000.0) *
      sqrt(list_sum(list_transform(embedding, lambda x: cast(x AS DOUBLE) * cast(x AS DOUBLE)))) AS norm
      FROM embeddings)
    SELECT vec_id, dimension = 64 AS dimension_ok, round(norm, 6) AS norm,
      abs(norm - 1.0) <= 0.0001 * greatest(norm, 1.0) AS unit FROM n""",
)
def l2_norm_check(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    factor = F.lit(1) + (F.col("vec_id") % 3) / F.lit(1000.0)
    made = vectors.withColumn("norm", factor * arrays.l2_norm(F.col("embedding")))
    return made.select(
        "vec_id",
        (F.size("embedding") == 64).alias("dimension_ok"),
        F.round("norm", 6).alias("norm"),
        arrays.is_unit_norm(F.col("norm")).alias("unit"),
    )


@query(
    "token_truncate",
    f"""WITH t AS (SELECT doc_id, {SQL_TOKENS} AS tokens FROM documents)
    SELECT doc_id, len(tokens) AS n_tokens, array_to_string(tokens[:2048], ' ') AS sample_side,
      array_to_string(tokens[:512], ' ') AS encoder_side FROM t""",
)
def token_truncate(spark, sf_dir):
    from pairmill.operators.tokens import split_tokens

    docs = documents(spark, sf_dir).withColumn("tokens", split_tokens(F.col("text")))
    return docs.select(
        "doc_id",
        F.size("tokens").cast("bigint").alias("n_tokens"),
        F.array_join(arrays.truncate(F.col("tokens")), " ").alias("sample_side"),
        F.array_join(arrays.truncate(F.col("tokens"), arrays.ENCODER_LIMIT), " ").alias("encoder_side"),
    )


@query(
    "teacher_shift",
    f"""WITH t AS (SELECT doc_id, {SQL_LENGTHS} AS ids FROM documents)
    SELECT doc_id, array_to_string(CASE WHEN len(ids) > 1 THEN ids[:len(ids) - 1] ELSE ids END, ',') AS decoder_input,
      array_to_string(CASE WHEN len(ids) > 1 THEN ids[2:] ELSE ids END, ',') AS decoder_target FROM t""",
)
def teacher_shift_query(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", token_lengths().alias("ids"))
    made = teacher_shift(docs, "ids")
    return made.select(
        "doc_id", *[arrays.joined(F.col(c)).alias(c) for c in ("decoder_input", "decoder_target")]
    )


@query(
    "pad_fixed",
    f"""WITH t AS (SELECT doc_id, ({SQL_LENGTHS})[:257] AS ids FROM documents)
    SELECT doc_id, array_to_string(list_concat(ids,
      list_transform(range(257 - len(ids)), lambda i: 0)), ',') AS padded FROM t""",
)
def pad_fixed(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", arrays.joined(arrays.pad_fixed(token_lengths())).alias("padded"))


@query(
    "window_tokens",
    f"""WITH t AS (SELECT doc_id, {SQL_LENGTHS} AS ids FROM documents),
    w AS (SELECT doc_id, ids, unnest(range((len(ids) + 4095) // 4096)) AS k FROM t)
    SELECT doc_id, cast(k AS INT) AS window_id,
      array_to_string(ids[k * 4096 + 1 : (k + 1) * 4096], ',') AS ids FROM w""",
)
def window_tokens_query(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", token_lengths().alias("ids"))
    made = window_tokens(docs, "ids")
    return made.select("doc_id", "window_id", arrays.joined(F.col("ids")).alias("ids"))


@query(
    "dynamic_budget",
    f"""WITH t AS (SELECT doc_id, len({SQL_TOKENS}) AS n FROM documents),
    w AS (SELECT doc_id, n, unnest(range((n + 4095) // 4096)) AS k FROM t)
    SELECT doc_id, cast(k AS INT) AS window_id,
      cast(least(64, greatest(8, least(4096, n - k * 4096) // 64)) AS INT) AS budget FROM w""",
)
def dynamic_budget(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", token_lengths().alias("ids"))
    made = window_tokens(docs, "ids")
    return made.select("doc_id", "window_id", schedules.loop_budget(F.size("ids")).alias("budget"))


@query(
    "lambda_schedule",
    """SELECT event_id, round(CASE WHEN event_id >= 1000 THEN 1.0
       ELSE 0.01 + (event_id / 1000.0) * 0.99 END, 9) AS weight FROM events""",
)
def lambda_schedule(spark, sf_dir):
    weight = schedules.concept_weight(F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", F.round(weight, 9).alias("weight"))


@query(
    "lr_schedule",
    """WITH t AS (SELECT cast(floor(count(*) * 0.5) AS BIGINT) AS total FROM events),
    w AS (SELECT total, cast(floor(total * 0.05) AS BIGINT) AS warmup FROM t)
    SELECT event_id, round(CASE WHEN event_id < warmup THEN cast(event_id AS DOUBLE) / greatest(1, warmup)
      ELSE greatest(0.0, 0.5 * (1.0 + cos(pi() * cast(event_id - warmup AS DOUBLE)
        / greatest(1, total - warmup)))) END, 9) AS factor
    FROM events, w""",
)
def lr_schedule(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id")
    total = int(events.count() * 0.5)  # half the steps, so that the rise past the end shows
    steps = F.lit(total)
    factor = schedules.learning_rate_factor(F.col("event_id"), schedules.warmup_steps(steps), steps)
    return events.select("event_id", F.round(factor, 9).alias("factor"))


@query(
    "retry_prompt",
    """SELECT doc_id, source || chr(10) || chr(10) || 'The previous attempt failed with:' || chr(10) || text
       || chr(10) || 'Please fix the architectural logic.' AS prompt FROM documents""",
)
def retry_prompt(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.retry_prompt(F.col("source"), F.col("text")).alias("prompt"))


@query(
    "preview_text",
    """SELECT doc_id, substring(text, 1, 300) || '...' AS prompt_preview,
       substring(text, 1, 500) || '...' AS response_preview FROM documents""",
)
def preview_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        text.preview(F.col("text"), 300).alias("prompt_preview"),
        text.preview(F.col("text"), 500).alias("response_preview"),
    )
