"""Training feed, losses and traces, rollouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairmill.functions.arrays import joined
from pairmill.operators import feed, metrics, pairs, rollouts
from pairmill.operators.numbering import number_rows
from pairmill.registry.base import (
    SQL_LENGTHS,
    docs_as_rows,
    documents,
    query,
    table,
    token_lengths,
)
from pairmill.registry.shards import CHUNK, _CHUNKED, chunked_docs
from pairmill.storage import staged

MB = 4


def _seconds():
    """Seconds since the start of the log, the same in every session time zone."""
    return F.expr(
        "(unix_micros(cast(ts AS timestamp)) - unix_micros(cast(TIMESTAMP_NTZ'2024-01-01' AS timestamp)))"
        " / cast(1000000 AS double)"
    )


# ------------------------------------------------------------------ feed


@query(
    "token_fallback",
    f"""SELECT doc_id, array_to_string(CASE WHEN doc_id % 3 = 0 THEN [length(source)] ELSE {SQL_LENGTHS} END, ',')
        AS ids FROM documents""",
)
def token_fallback(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 3 == 0, F.array(F.length("source"))).alias("response"),
        token_lengths().alias("prompt"),
    )
    return docs.select("doc_id", joined(feed.token_fallback(F.col("response"), F.col("prompt"))).alias("ids"))


@query(
    "resume_skip_batches",
    f"""WITH {_CHUNKED}, e AS (SELECT domain, source, row_pos, chunk_id AS chunk_idx, cast(unnest(range(3)) AS INT) AS epoch
      FROM chunked) SELECT * FROM e WHERE epoch > 1 OR (epoch = 1 AND chunk_idx >= 2)""",
)
def resume_skip_batches(spark, sf_dir):
    rows = chunked_docs(spark, sf_dir).select(
        "domain", "source", "row_pos", F.col("chunk_id").alias("chunk_idx")
    )
    return feed.resume_skip_batches(feed.epoch_replicate(rows, 3), 1, 2)


@query(
    "minibatch_assign",
    f"""WITH {_CHUNKED} SELECT domain, source, chunk_id, row_pos, cast(pos_in_chunk // {MB} AS INT) AS mini_batch
        FROM chunked""",
)
def minibatch_assign(spark, sf_dir):
    made = feed.minibatch_assign(chunked_docs(spark, sf_dir), MB)
    return made.select("domain", "source", "chunk_id", "row_pos", "mini_batch")


@query(
    "pad_batch",
    f"""WITH {_CHUNKED}, t AS (SELECT domain, source, chunk_id, row_pos, cast(pos_in_chunk // {MB} AS INT) AS mini_batch,
      {SQL_LENGTHS} AS ids FROM chunked),
    w AS (SELECT *, max(len(ids)) OVER (PARTITION BY domain, source, chunk_id, mini_batch) AS width FROM t)
    SELECT domain, source, chunk_id, mini_batch, row_pos, array_to_string(list_concat(ids,
      list_transform(range(width - len(ids)), lambda i: 0)), ',') AS ids FROM w""",
)
def pad_batch(spark, sf_dir):
    made = feed.minibatch_assign(chunked_docs(spark, sf_dir).withColumn("ids", token_lengths()), MB)
    padded = feed.pad_batch(made, ["domain", "source", "chunk_id", "mini_batch"], "ids")
    return padded.select(
        "domain", "source", "chunk_id", "mini_batch", "row_pos", joined(F.col("ids")).alias("ids")
    )


_EPOCHS = """
staged AS (SELECT event_id, value, ts, dense_rank() OVER (ORDER BY event_type) - 1 AS epoch FROM events),
indexed AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY event_id) - 1 AS mb_index FROM staged),
sizes AS (SELECT epoch, count(*) AS size FROM indexed GROUP BY epoch),
bases AS (SELECT epoch, size, coalesce(sum(size) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
  FROM sizes),
flagged AS (SELECT *, CASE WHEN (base + size) % 16 <> 0 THEN 1 ELSE 0 END AS extra FROM bases),
extras AS (SELECT *, coalesce(sum(extra) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM flagged),
stepped AS (SELECT event_id, value, ts, cast(epoch AS INT) AS epoch, mb_index, cast(base + mb_index + 1 AS BIGINT) AS global_mb,
  cast((base + mb_index) // 16 + before AS BIGINT) AS step,
  (base + mb_index + 1) % 16 = 0 OR (mb_index = size - 1 AND extra = 1) AS closes_step
  FROM indexed JOIN extras USING (epoch))"""


def stepped_events(spark, sf_dir):
    """Events as mini-batches, one epoch per event type."""
    kinds = ("click", "error", "purchase", "signup", "view")
    epoch = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(i)) for i, k in enumerate(kinds)])
    rows = table(spark, sf_dir, "events").select("event_id", "value", "ts", epoch.alias("epoch"))
    return feed.optimizer_step(number_rows(rows, ["epoch"], "event_id", "mb_index"), "mb_index")


@query(
    "optimizer_step",
    f"WITH {_EPOCHS} SELECT event_id, epoch, mb_index, global_mb, step, closes_step FROM stepped",
)
def optimizer_step(spark, sf_dir):
    made = stepped_events(spark, sf_dir)
    return made.select("event_id", "epoch", "mb_index", "global_mb", "step", "closes_step")


@query("trace_sample", f"WITH {_EPOCHS} SELECT event_id, epoch, global_mb, value FROM stepped WHERE global_mb % 10 = 0")
def trace_sample(spark, sf_dir):
    made = feed.trace_sample(stepped_events(spark, sf_dir), F.col("global_mb"))
    return made.select("event_id", "epoch", "global_mb", "value")


@query(
    "decoder_trace",
    f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS seq FROM documents),
    b AS (SELECT lang AS domain, seq // 100 AS chunk_idx, (seq % 100) // {MB} AS mini_batch, avg(n_chars) AS loss
      FROM n GROUP BY ALL)
    SELECT domain, cast(unnest(range(2)) + 1 AS INT) AS epoch, cast(chunk_idx + 1 AS INT) AS chunk_idx,
      cast(mini_batch + 1 AS INT) AS mini_batch, round(loss, 8) AS cross_entropy_loss FROM b WHERE mini_batch % 10 = 0""",
)
def decoder_trace(spark, sf_dir):
    """Mean length as a stand-in loss of each mini-batch; the log takes each tenth batch of a chunk."""
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("domain"), "doc_id", "n_chars")
    rows = number_rows(rows, ["domain"], "doc_id", "seq")
    rows = rows.select(
        "domain", "n_chars", F.expr("cast(seq div 100 as int)").alias("chunk_idx"), (F.col("seq") % 100).alias("pos_in_chunk")
    )
    batches = feed.minibatch_assign(rows, MB).groupBy("domain", "chunk_idx", "mini_batch").agg(F.avg("n_chars").alias("loss"))
    made = feed.decoder_trace(feed.epoch_replicate(batches, 2), "loss", ["domain"])
    return made.withColumn("cross_entropy_loss", F.round("cross_entropy_loss", 8))


# ------------------------------------------------------------------ losses


@query(
    "chunk_loss_avg",
    """SELECT user_id, event_type, round(avg(value), 8) AS ce, round(avg(value * 2), 8) AS total
       FROM events GROUP BY ALL""",
)
def chunk_loss_avg(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "user_id", "event_type", F.col("value").alias("ce"), (F.col("value") * 2).alias("total")
    )
    made = metrics.chunk_loss_avg(rows, ["user_id", "event_type"], ["ce", "total"])
    return made.select("user_id", "event_type", *[F.round(c, 8).alias(c) for c in ("ce", "total")])


@query(
    "total_loss",
    """WITH e AS (SELECT event_id, value, cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
    SELECT event_id, round(value + (CASE WHEN event_id >= 1000 THEN 1.0 ELSE 0.01 + event_id / 1000.0 * 0.99 END)
      * (k / 100 + 0.1 * (value / 10) + 0.5 * (k / 50)) + 0.01 * k + value / 1000, 9) AS total_loss FROM e""",
)
def total_loss(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("double")
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_id").alias("step"),
        F.col("value").alias("ce_loss"),
        metrics.concept_loss(k / 100, F.col("value") / 10, k / 50).alias("concept_loss"),
        k.alias("route_loss"),
        (F.col("value") / 1000).alias("energy"),
    )
    return metrics.total_loss(rows).select("event_id", F.round("total_loss", 9).alias("total_loss"))


def _batched(spark, sf_dir, size=8):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.floor(F.col("vec_id") / size).alias("batch_id"),
        "embedding",
        F.reverse("embedding").alias("target"),
    )


_VEC = "list_transform(embedding, lambda x: cast(x AS DOUBLE))"
_BATCHED = f"batched AS (SELECT vec_id, vec_id // 8 AS batch_id, {_VEC} AS v FROM embeddings)"


@query(
    "alignment_loss",
    f"""WITH {_BATCHED} SELECT batch_id, round(1 - avg(list_cosine_similarity(v, list_reverse(v))), 8) AS alignment_loss
        FROM batched GROUP BY batch_id""",
)
def alignment_loss(spark, sf_dir):
    made = metrics.alignment_loss(_batched(spark, sf_dir), ["batch_id"], "embedding", "target")
    return made.select("batch_id", F.round("alignment_loss", 8).alias("alignment_loss"))


_PAIRS = f"""{_BATCHED}, paired AS (SELECT a.batch_id, a.vec_id, list_cosine_similarity(a.v, b.v) AS c
  FROM batched a JOIN batched b ON a.batch_id = b.batch_id AND a.vec_id <> b.vec_id)"""


@query(
    "batch_pairs",
    f"""WITH {_PAIRS} SELECT batch_id, vec_id, count(*) AS partners, round(sum(greatest(c, 0)), 8) AS positive,
        round(max(c), 8) AS closest FROM paired GROUP BY ALL""",
)
def batch_pairs(spark, sf_dir):
    made = pairs.batch_pairs(_batched(spark, sf_dir), "batch_id", "vec_id", "embedding")
    return made.select(
        "batch_id", "vec_id", "partners", *[F.round(c, 8).alias(c) for c in ("positive", "closest")]
    )


@query(
    "separability_loss",
    f"""WITH {_PAIRS} SELECT batch_id, round(avg(greatest(c, 0)), 8) AS separability_loss FROM paired
        GROUP BY batch_id""",
)
def separability_loss(spark, sf_dir):
    made = pairs.separability_loss(_batched(spark, sf_dir), "batch_id", "vec_id", "embedding")
    return made.select("batch_id", F.round("separability_loss", 8).alias("separability_loss"))


def _sql_spectral(batch: str) -> str:
    return f"""WITH flat AS (SELECT vec_id, {batch} AS batch_id, unnest({_VEC}) AS x,
      unnest(range(len(embedding))) AS i FROM embeddings),
    cov AS (SELECT a.batch_id, a.i, b.i AS j, covar_samp(a.x, b.x) AS c FROM flat a
      JOIN flat b ON a.vec_id = b.vec_id AND a.i <> b.i GROUP BY ALL)
    SELECT batch_id, round(avg(c * c) * 1000000, 6) AS spectral_loss_millionths FROM cov GROUP BY batch_id"""


def _millionths(made):
    return made.select(
        "batch_id", F.round(F.col("spectral_loss") * 1000000, 6).alias("spectral_loss_millionths")
    )


@query("spectral_loss", _sql_spectral("vec_id // 8"))
def spectral_loss(spark, sf_dir):
    return _millionths(pairs.spectral_loss(_batched(spark, sf_dir), "batch_id", "embedding"))


@query("spectral_loss_corpus", _sql_spectral("cast(0 AS BIGINT)"))
def spectral_loss_corpus(spark, sf_dir):
    """All vectors as one batch, the way a batch too large for one task is computed."""
    rows = _batched(spark, sf_dir).withColumn("batch_id", F.lit(0).cast("bigint"))
    return _millionths(pairs.spectral_loss(rows, "batch_id", "embedding", block_rows=64))


@query(
    "route_penalty",
    """SELECT user_id, round(greatest(avg(value) - 4.0, 0.0) * greatest(avg(value) - 4.0, 0.0), 6) AS route_penalty
       FROM events GROUP BY user_id""",
)
def route_penalty(spark, sf_dir):
    made = metrics.route_penalty(table(spark, sf_dir, "events"), ["user_id"], "value")
    return made.select("user_id", F.round("route_penalty", 6).alias("route_penalty"))


@query(
    "energy_norm",
    f"""WITH {_BATCHED} SELECT batch_id,
      round(avg((vec_id + 1) * sqrt(list_sum(list_transform(v, lambda x: x * x)))) * 0.001, 8) AS energy_norm
      FROM batched GROUP BY batch_id""",
)
def energy_norm(spark, sf_dir):
    rows = _batched(spark, sf_dir).withColumn(
        "student", F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") + 1))
    )
    made = metrics.energy_norm(rows, ["batch_id"], "student")
    return made.select("batch_id", F.round("energy_norm", 8).alias("energy_norm"))


@query(
    "masked_ce",
    f"""WITH t AS (SELECT doc_id, unnest({SQL_LENGTHS}) AS n FROM documents)
    SELECT doc_id, round(sum(CASE WHEN n > 1 THEN ln(1 + n) END) / count(*) FILTER (WHERE n > 1), 8) AS ce_loss
    FROM t GROUP BY doc_id""",
)
def masked_ce(spark, sf_dir):
    tokens = documents(spark, sf_dir).select("doc_id", F.explode(token_lengths()).alias("n"))
    rows = tokens.select(
        "doc_id", F.when(F.col("n") > 1, F.col("n")).otherwise(0).alias("target"), F.log(F.col("n") + 1).alias("nll")
    )
    made = metrics.masked_ce(rows, ["doc_id"], "target", "nll")
    return made.select("doc_id", F.round("ce_loss", 8).alias("ce_loss"))


@query(
    "shard_throughput",
    """WITH s AS (SELECT event_id, event_type, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000.0::DOUBLE AS sec,
      cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
    l AS (SELECT *, sec - lag(sec) OVER (PARTITION BY event_type ORDER BY event_id) AS gap FROM s)
    SELECT event_id, event_type, k, round(CASE WHEN gap > 0 THEN k / gap WHEN gap IS NOT NULL THEN 0 END, 6)
      AS rows_per_sec FROM l""",
)
def shard_throughput(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_id", "event_type",
        _seconds().alias("sec"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )
    made = metrics.shard_throughput(rows, ["event_type"], "event_id", "sec", "k")
    return made.select("event_id", "event_type", "k", F.round("rows_per_sec", 6).alias("rows_per_sec"))


@query(
    "trace_speed",
    f"""WITH {_EPOCHS}, s AS (SELECT event_id, global_mb, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000.0::DOUBLE AS sec FROM stepped
      WHERE global_mb % 10 = 0),
    l AS (SELECT *, sec - lag(sec) OVER (ORDER BY global_mb) AS gap FROM s)
    SELECT event_id, global_mb, round(CASE WHEN gap > 0 THEN 10 / gap WHEN gap IS NOT NULL THEN 0 END, 6) AS it_per_sec
    FROM l""",
)
def trace_speed(spark, sf_dir):
    made = feed.trace_sample(stepped_events(spark, sf_dir), F.col("global_mb")).select(
        "event_id", "global_mb", _seconds().alias("sec")
    )
    made = metrics.trace_speed(made, [], "global_mb", "sec")
    return made.select("event_id", "global_mb", F.round("it_per_sec", 6).alias("it_per_sec"))


@query(
    "token_length_stats",
    f"""WITH t AS (SELECT lang AS domain, source, len({SQL_LENGTHS}) AS n FROM documents)
    SELECT domain, source, count(*) AS n_rows, cast(min(n) AS INT) AS ids_min, cast(max(n) AS INT) AS ids_max,
      cast(sum(n) AS BIGINT) AS ids_sum, round(avg(n), 8) AS ids_avg FROM t GROUP BY ALL""",
)
def token_length_stats(spark, sf_dir):
    rows = docs_as_rows(spark, sf_dir, heavy=True).withColumn("ids", token_lengths())
    made = metrics.token_length_stats(rows, ["domain", "source"], "ids")
    return made.drop("ids_median").withColumn("ids_avg", F.round("ids_avg", 8))


@query(
    "manifest_length_quantiles",
    f"""WITH t AS (SELECT lang AS domain, len({SQL_LENGTHS}) AS n FROM documents)
    SELECT domain, count(*) AS n_rows, true AS median_within, true AS tenth_within FROM t GROUP BY domain""",
)
def manifest_length_quantiles(spark, sf_dir):
    """Median and lowest tenth of each domain from its shards' sketches: whether their true ranks are within the bound."""
    rows = chunked_docs(spark, sf_dir).withColumn("input_tokens", token_lengths()).drop("text")
    rows = staged(rows.withColumn("response_tokens", F.col("input_tokens")), "lengths")
    found = metrics.length_quantiles(metrics.sketched_manifest(rows), ["domain"], 0.5, 0.1)
    lengths = rows.select("domain", F.size("input_tokens").alias("n"))
    ranked = lengths.join(found, "domain").groupBy("domain", "n_rows").agg(
        *[
            ((F.avg((F.col("n") < F.col(v)).cast("int")) <= share + metrics.SKETCH_ERROR)
             & (F.avg((F.col("n") <= F.col(v)).cast("int")) >= share - metrics.SKETCH_ERROR)).alias(out)
            for v, share, out in (("prompt_lengths_500", 0.5, "median_within"), ("prompt_lengths_100", 0.1, "tenth_within"))
        ]
    )
    return ranked


@query(
    "shard_validate",
    """WITH v AS (SELECT label, vec_id, embedding, (1 + (vec_id % 3) / 1000.0)
      * sqrt(list_sum(list_transform(embedding, lambda x: cast(x AS DOUBLE) * cast(x AS DOUBLE)))) AS norm FROM embeddings),
    f AS (SELECT label, vec_id % 5 <> 0 AS filled, len(embedding) = 64 AS sized,
      abs(norm - 1) <= 0.0001 * greatest(norm, 1.0) AS unit FROM v)
    SELECT label, count(*) AS n_rows, count(*) FILTER (WHERE filled) AS n_filled,
      count(*) FILTER (WHERE sized) AS n_dimension_ok, count(*) FILTER (WHERE unit) AS n_unit_norm,
      count(*) FILTER (WHERE filled AND sized AND unit) = count(*) AS valid FROM f GROUP BY label""",
)
def shard_validate(spark, sf_dir):
    factor = F.lit(1) + (F.col("vec_id") % 3) / F.lit(1000.0)
    rows = table(spark, sf_dir, "embeddings").select(
        "label",
        F.array("vec_id").alias("input_tokens"),
        F.when(F.col("vec_id") % 5 == 0, F.array().cast("array<bigint>"))
        .otherwise(F.array("vec_id"))
        .alias("response_tokens"),
        F.transform("embedding", lambda x: x * factor).alias("target_concept"),
    )
    return metrics.shard_validate(rows, ["label"], dimension=64)


# ------------------------------------------------------------------ rollouts

_K = "cast(json_extract_string(props, '$.k') AS BIGINT)"
_ROLLOUTS = f"""
scored AS (SELECT user_id, event_id, value, {_K} AS k,
  (CASE WHEN {_K} % 2 = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE - 0.01::DOUBLE * value AS reward FROM events),
grouped AS (SELECT user_id, avg(reward) AS mu, CASE WHEN count(*) > 1 THEN greatest(stddev_samp(reward), 0.000001)
  ELSE 1 END AS sigma, var_pop(reward) AS vp FROM scored GROUP BY user_id),
advanced AS (SELECT user_id, event_id, value, k, reward, (reward - mu) / sigma AS advantage,
  (reward - mu) / sqrt(vp + 0.000001) AS advantage_doc FROM scored JOIN grouped USING (user_id))"""


def _rollouts(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").select(
        "user_id", "event_id", "value", k.alias("k"),
        rollouts.reward(k % 2 == 0, F.col("value")).alias("reward"),
    )


@query("reward", f"WITH {_ROLLOUTS} SELECT event_id, round(reward, 8) AS reward FROM scored")
def reward(spark, sf_dir):
    return _rollouts(spark, sf_dir).select("event_id", F.round("reward", 8).alias("reward"))


@query("group_advantage", f"WITH {_ROLLOUTS} SELECT user_id, event_id, round(advantage, 8) AS advantage FROM advanced")
def group_advantage(spark, sf_dir):
    made = rollouts.group_advantage(_rollouts(spark, sf_dir), ["user_id"], "reward")
    return made.select("user_id", "event_id", F.round("advantage", 8).alias("advantage"))


@query(
    "group_advantage_doc",
    f"WITH {_ROLLOUTS} SELECT user_id, event_id, round(advantage_doc, 8) AS advantage FROM advanced",
)
def group_advantage_doc(spark, sf_dir):
    made = rollouts.group_advantage_doc(_rollouts(spark, sf_dir), ["user_id"], "reward")
    return made.select("user_id", "event_id", F.round("advantage", 8).alias("advantage"))


@query(
    "surrogate_loss",
    f"""WITH {_ROLLOUTS},
    terms AS (SELECT user_id, event_id, advantage, exp((k - 50) * 0.005 * i) AS ratio FROM advanced,
      (SELECT unnest(range(1, 5)) AS i)),
    losses AS (SELECT user_id, event_id, -avg(least(ratio * advantage,
      least(greatest(ratio, 0.8), 1.2) * advantage)) AS loss FROM terms GROUP BY ALL)
    SELECT user_id, round(sum(loss), 6) AS surrogate_loss FROM losses GROUP BY user_id""",
)
def surrogate_loss(spark, sf_dir):
    made = rollouts.group_advantage(_rollouts(spark, sf_dir), ["user_id"], "reward")
    steps = F.sequence(F.lit(1), F.lit(4))
    old = F.transform(steps, lambda i: -(i * 0.1))
    new = F.transform(steps, lambda i: -(i * 0.1) + (F.col("k") - 50) * 0.005 * i)
    made = made.withColumns({"lp_old": old, "lp_new": new})
    scored = rollouts.surrogate_loss(made, ["user_id"], "lp_new", "lp_old", "advantage")
    return scored.select("user_id", F.round("surrogate_loss", 6).alias("surrogate_loss"))


@query(
    "attempt_resolution",
    """WITH a AS (SELECT d.doc_id // 4 AS prompt_id, d.doc_id % 4 + 1 AS attempt, text AS code,
      coalesce(quality = 1, false) AS ok FROM documents d LEFT JOIN
      (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)),
    g AS (SELECT prompt_id, min(attempt) FILTER (WHERE ok) AS hit, max(attempt) AS last FROM a WHERE attempt <= 3
      GROUP BY prompt_id)
    SELECT prompt_id, hit IS NOT NULL AS solved, coalesce(hit, last) AS attempts, code
    FROM g JOIN a USING (prompt_id) WHERE attempt = coalesce(hit, last)""",
)
def attempt_resolution(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    log = table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(
        F.floor(F.col("doc_id") / 4).alias("prompt_id"),
        (F.col("doc_id") % 4 + 1).alias("attempt"),
        F.col("text").alias("code"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("ok"),
    )
    return rollouts.attempt_resolution(log, ["prompt_id"])


@query(
    "attempt_errors",
    """WITH a AS (SELECT doc_id // 4 AS prompt_id, doc_id % 4 + 1 AS attempt, text AS code, n_chars % 7 = 0 AS ok,
      n_chars % 5 = 1 AS broke FROM documents),
    g AS (SELECT prompt_id, min(attempt) FILTER (WHERE ok OR broke) AS hit, max(attempt) AS last FROM a WHERE attempt <= 3
      GROUP BY prompt_id)
    SELECT prompt_id, hit IS NOT NULL AND ok AS solved, coalesce(hit, last) AS attempts, code
    FROM g JOIN a USING (prompt_id) WHERE attempt = coalesce(hit, last)""",
)
def attempt_errors(spark, sf_dir):
    """An attempt whose check broke is the last one, whatever comes after it in the log."""
    log = table(spark, sf_dir, "documents").select(
        F.floor(F.col("doc_id") / 4).alias("prompt_id"),
        (F.col("doc_id") % 4 + 1).alias("attempt"),
        F.col("text").alias("code"),
        (F.col("n_chars") % 7 == 0).alias("ok"),
        (F.col("n_chars") % 5 == 1).alias("broke"),
    )
    return rollouts.attempt_resolution(log, ["prompt_id"], error="broke")


@query(
    "checker_hook",
    """SELECT doc_id, n_chars % 2 = 0 AS ok, CAST(NULL AS VARCHAR) AS error, round(CAST(CASE WHEN n_chars % 2 = 0 THEN 1.0 ELSE 0.0 END
      - 0.01 * (doc_id % 8) AS DOUBLE), 8) AS reward FROM documents WHERE n_chars % 11 <> 0
    UNION ALL SELECT doc_id, NULL, 'ValueError: ' || n_chars, NULL FROM documents WHERE n_chars % 11 = 0""",
)
def checker_hook(spark, sf_dir):
    """Verdicts of a caller's checker become rewards; texts on which it raises are set aside with the error."""

    def checker(texts):
        if any(len(t) % 11 == 0 for t in texts):
            raise ValueError(len(next(t for t in texts if len(t) % 11 == 0)))
        return [len(t) % 2 == 0 for t in texts]

    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("code"))
    judged, broken = rollouts.quarantine_unchecked(rollouts.check_candidates(docs, checker))
    loops = (F.col("doc_id") % 8).cast("double")
    scored = judged.select("doc_id", "ok", F.lit(None).cast("string").alias("error"), rollouts.reward(F.col("ok"), loops).alias("reward"))
    aside = broken.select("doc_id", F.lit(None).cast("boolean").alias("ok"), "error", F.lit(None).cast("double").alias("reward"))
    return scored.unionByName(aside).withColumn("reward", F.round("reward", 8))
