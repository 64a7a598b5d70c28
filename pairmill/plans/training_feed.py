"""Shards to padded, windowed, shifted mini-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmill.functions.arrays import WINDOW, pad_fixed
from pairmill.operators.feed import (
    epoch_replicate,
    minibatch_assign,
    pad_batch,
    teacher_shift,
    token_fallback,
    window_tokens,
)

BATCH_KEYS = ("domain", "source", "chunk_id", "mini_batch")


def latent_feed(samples: DataFrame, epochs: int, batch_size: int = 1, width: int = WINDOW) -> DataFrame:
    """Batches are padded before epochs repeat them, so the shuffle carries each row once."""
    made = samples.withColumn(
        "response_tokens", token_fallback(F.col("response_tokens"), F.col("input_tokens"))
    )
    made = minibatch_assign(made, batch_size)
    if batch_size > 1:
        made = pad_batch(made, BATCH_KEYS, "input_tokens", "response_tokens")
    made = window_tokens(made, "input_tokens", "response_tokens", width)
    return epoch_replicate(teacher_shift(made, "response_tokens"), epochs)


def decoder_feed(samples: DataFrame, epochs: int, batch_size: int = 4, max_len: int = 256) -> DataFrame:
    """Every target has the same fixed width, so batches need no shuffle at all."""
    made = samples.withColumn("response_tokens", pad_fixed(F.col("response_tokens"), max_len))
    made = minibatch_assign(made, batch_size)
    return epoch_replicate(teacher_shift(made, "response_tokens"), epochs)
