"""From shards to the batches a training loop reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairmill.functions.arrays import (
    WINDOW,
    pad_right,
    shift_input,
    shift_target,
    window_at,
    window_starts,
)
from pairmill.operators.keyed import join_small

# Training phases in order, epochs per phase, batches per step, logging interval.
PHASES = ("general_knowledge", "frontier_traces", "code_mechanics")
PHASE_EPOCHS = 2
BATCHES_PER_STEP = 16
LOG_EVERY = 10
SHARD_KEYS = ("domain", "source", "chunk_id")


def project_sample(df: DataFrame) -> DataFrame:
    """Only what training reads; the raw texts stop here."""
    return df.select("domain", "source", "row_pos", "input_tokens", "response_tokens", "target_concept")


def token_fallback(response: Column, prompt: Column) -> Column:
    return F.coalesce(response, prompt)


def epoch_replicate(df: DataFrame, epochs: int, out: str = "epoch") -> DataFrame:
    """Every row once per epoch, numbered from 0; a narrow generator, not a join. 0 epochs: no rows."""
    if epochs < 1:  # a sequence from 0 to -1 would count down
        return df.withColumn(out, F.lit(0)).where(F.lit(False))
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


def resume_skip_batches(df: DataFrame, start_epoch: int, start_chunk: int) -> DataFrame:
    """Drop what a stopped run has already trained on; chunk numbers stay the original ones."""
    return df.where(
        (F.col("epoch") > start_epoch)
        | ((F.col("epoch") == start_epoch) & (F.col("chunk_idx") >= start_chunk))
    )


def minibatch_assign(df: DataFrame, size: int, position: str = "pos_in_chunk") -> DataFrame:
    return df.withColumn("mini_batch", F.floor(F.col(position) / size).cast("int"))


def pad_batch(df: DataFrame, keys: Sequence[str], *sides: str) -> DataFrame:
    """Pad each side to the longest of its batch. A batch has as many rows as it was cut to."""
    batch = Window.partitionBy(*keys)
    widths = {f"_w{i}": F.max(F.size(s)).over(batch) for i, s in enumerate(sides)}
    padded = {s: pad_right(F.col(s), F.col(f"_w{i}")) for i, s in enumerate(sides)}
    return df.withColumns(widths).withColumns(padded).drop(*widths)


def unpad(tokens: Column, length: Column) -> Column:
    return F.slice(tokens, F.lit(1), length)


def window_tokens(
    df: DataFrame, prompt: str, response: str | None = None, width: int = WINDOW
) -> DataFrame:
    """One row per window; the response is cut at the same offsets unless it is a single token."""
    cut = df.withColumn("_start", F.explode(window_starts(F.col(prompt), width)))
    sides = {prompt: window_at(F.col(prompt), F.col("_start"), width)}
    if response is not None:
        sides[response] = F.when(
            F.size(response) > 1, window_at(F.col(response), F.col("_start"), width)
        ).otherwise(F.col(response))
    return (
        cut.withColumns(sides)
        .withColumn("window_id", F.floor(F.col("_start") / width).cast("int"))
        .drop("_start")
    )


def teacher_shift(df: DataFrame, tokens: str) -> DataFrame:
    return df.withColumns(
        {"decoder_input": shift_input(F.col(tokens)), "decoder_target": shift_target(F.col(tokens))}
    )


def optimizer_step(
    df: DataFrame, index: str, epoch: str = "epoch", every: int = BATCHES_PER_STEP
) -> DataFrame:
    """Add the running batch counter, the steps done before a batch and whether it closes one.

    ``index`` numbers the batches of an epoch from 0. The counter runs on across epochs, and an
    epoch that does not end on a full step closes one more. Both follow from the batch count of
    each epoch, a table with one row per epoch; no ordered scan over the batches is needed.
    """
    sizes = df.groupBy(epoch).agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    through = Window.orderBy(epoch).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = sizes.withColumns(
        {
            "_base": F.coalesce(F.sum("_size").over(earlier), F.lit(0)),
            "_extra": (F.sum("_size").over(through) % every != 0).cast("int"),
        }
    ).withColumn("_extras", F.coalesce(F.sum("_extra").over(earlier), F.lit(0)))
    counter = F.col("_base") + F.col(index) + 1
    last = (F.col(index) == F.col("_size") - 1) & (F.col("_extra") == 1)
    return (
        join_small(df, sizes, [epoch])
        .withColumn("global_mb", counter)
        .withColumn("step", F.floor((F.col("global_mb") - 1) / every) + F.col("_extras"))
        .withColumn("closes_step", (F.col("global_mb") % every == 0) | last)
        .drop("_size", "_base", "_extra", "_extras")
    )


def trace_sample(df: DataFrame, counter: Column, every: int = LOG_EVERY) -> DataFrame:
    return df.where(counter % every == 0)


def decoder_trace(
    df: DataFrame, loss: str, keys: Sequence[str] = (), epoch: str = "epoch", chunk: str = "chunk_idx", batch: str = "mini_batch",
    every: int = LOG_EVERY,
) -> DataFrame:
    """Each tenth batch of every chunk, counted from its first; logged numbers begin at 1."""
    kept = df.where(F.col(batch) % every == 0)
    return kept.select(*keys, *[(F.col(c) + 1).alias(c) for c in (epoch, chunk, batch)], F.col(loss).alias("cross_entropy_loss"))


def phase_rank(domain: Column, phases: Sequence[str] = PHASES) -> Column:
    ranked = [F.when(domain == phase, F.lit(i)) for i, phase in enumerate(phases)]
    return F.coalesce(*ranked)


def curriculum_order(
    df: DataFrame, phases: Sequence[str] = PHASES, epochs: int = PHASE_EPOCHS
) -> DataFrame:
    """Shards in the order phases visit them: phase, epoch, source, chunk."""
    ranked = df.withColumn("phase", phase_rank(F.col("domain"), phases)).where(F.col("phase").isNotNull())
    return epoch_replicate(ranked, epochs).orderBy("phase", "epoch", "source", "chunk_id")


def shard_order(df: DataFrame) -> DataFrame:
    return df.orderBy("source", "chunk_id")


def shard_shuffle_key(epoch: Column, *parts: Column) -> Column:
    """Same shards, another order per epoch, the same again on every rerun."""
    return F.md5(F.concat_ws("/", *parts, epoch.cast("string")).cast("binary"))


def shard_shuffle(df: DataFrame, epochs: int) -> DataFrame:
    made = epoch_replicate(df, epochs)
    key = shard_shuffle_key(F.col("epoch"), F.col("source"), F.col("chunk_id").cast("string"))
    return made.withColumn("shuffle_key", key).orderBy("epoch", "shuffle_key")


def sample_head(df: DataFrame, order: Sequence[str], n: int = 3) -> DataFrame:
    return df.orderBy(*order).limit(n)
