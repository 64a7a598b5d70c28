"""Losses, traces and shard checks over logged values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pairmill.functions.arrays import cosine, is_unit_norm, l2_norm
from pairmill.functions.schedules import concept_weight
from pairmill.operators.feed import LOG_EVERY
from pairmill.operators.numbering import previous_value

# Weights of the loss parts.
#: Size of a quantile sketch, and the share of rows by which a rank may be off at that size.
SKETCH_SIZE, SKETCH_ERROR = 400, 0.008
SPECTRAL_WEIGHT = 0.1
SEPARABILITY_WEIGHT = 0.5
ROUTE_WEIGHT = 0.01
ENERGY_WEIGHT = 0.001
MAX_LOOPS = 4
CONCEPT_DIMENSION = 1024


def alignment_loss(df: DataFrame, keys: Sequence[str], student: str, target: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        (1.0 - F.avg(cosine(F.col(student), F.col(target)))).alias("alignment_loss")
    )


def energy_norm(df: DataFrame, keys: Sequence[str], student: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        (F.avg(l2_norm(F.col(student))) * ENERGY_WEIGHT).alias("energy_norm")
    )


def route_penalty(
    df: DataFrame, keys: Sequence[str], loops: str, max_loops: float = MAX_LOOPS
) -> DataFrame:
    excess = F.greatest(F.avg(loops) - F.lit(float(max_loops)), F.lit(0.0))
    return df.groupBy(*keys).agg((excess * excess).alias("route_penalty"))


def masked_ce(df: DataFrame, keys: Sequence[str], target: str, nll: str) -> DataFrame:
    """Mean token loss over real targets; padding (0) does not count."""
    real = F.col(target) != 0
    return df.groupBy(*keys).agg(
        F.try_divide(F.sum(F.when(real, F.col(nll))), F.count_if(real)).alias("ce_loss")
    )


def concept_loss(alignment: Column, spectral: Column, separability: Column) -> Column:
    return alignment + SPECTRAL_WEIGHT * spectral + SEPARABILITY_WEIGHT * separability


def total_loss(
    df: DataFrame,
    step: str = "step",
    ce: str = "ce_loss",
    concept: str = "concept_loss",
    route: str = "route_loss",
    energy: str = "energy",
) -> DataFrame:
    """The weight depends on the step alone, so it is computed in place instead of looked up."""
    total = (
        F.col(ce)
        + concept_weight(F.col(step)) * F.col(concept)
        + ROUTE_WEIGHT * F.col(route)
        + F.col(energy)
    )
    return df.withColumn("total_loss", total)


def chunk_loss_avg(df: DataFrame, keys: Sequence[str], parts: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(p).alias(p) for p in parts])


def shard_throughput(
    df: DataFrame, keys: Sequence[str], position: str, seconds: str, rows: str
) -> DataFrame:
    """Rows of a shard per second since the shard before it; 0 when no time has passed."""
    made = previous_value(df, keys, position, seconds, "_last")
    elapsed = F.col(seconds) - F.col("_last")
    rate = F.when(elapsed > 0, F.col(rows) / elapsed).when(elapsed.isNotNull(), 0.0)
    return made.withColumn("rows_per_sec", rate).drop("_last")


def trace_speed(
    df: DataFrame, keys: Sequence[str], position: str, seconds: str, every: int = LOG_EVERY
) -> DataFrame:
    made = previous_value(df, keys, position, seconds, "_last")
    elapsed = F.col(seconds) - F.col("_last")
    rate = F.when(elapsed > 0, F.lit(float(every)) / elapsed).when(elapsed.isNotNull(), 0.0)
    return made.withColumn("it_per_sec", rate).drop("_last")


def source_totals(df: DataFrame, keys: Sequence[str] = ("domain", "source")) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def with_row_counter(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """The same rows, and a count of them that is there once an action has run over them."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n_rows")), seen


def shard_manifest(
    df: DataFrame,
    keys: Sequence[str] = ("domain", "source", "chunk_id"),
    prompt: str = "input_tokens",
    response: str = "response_tokens",
) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.size(prompt)).alias("n_prompt_tokens"),
        F.sum(F.size(response)).alias("n_response_tokens"),
    )


def sketched_manifest(
    df: DataFrame,
    keys: Sequence[str] = ("domain", "source", "chunk_id"),
    prompt: str = "input_tokens",
    response: str = "response_tokens",
    size: int = SKETCH_SIZE,
) -> DataFrame:
    """The shard manifest with a quantile sketch of each side's lengths, some kilobytes a shard."""
    lengths = {"prompt_lengths": F.size(prompt), "response_lengths": F.size(response)}
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.sum(n).alias(out) for n, out in zip(lengths.values(), ("n_prompt_tokens", "n_response_tokens"))],
        *[F.kll_sketch_agg_bigint(n.cast("bigint"), F.lit(size)).alias(out) for out, n in lengths.items()],
    )


def length_quantiles(manifest: DataFrame, keys: Sequence[str], *shares: float, size: int = SKETCH_SIZE) -> DataFrame:
    """Quantiles of the lengths of whole sources or phases, from their shards' sketches alone.

    A value's rank is off by at most ``SKETCH_ERROR`` of the rows at the default size, in 99 of 100 cases,
    however many sketches are merged.
    """
    sides = ("prompt_lengths", "response_lengths")
    merged = manifest.groupBy(*keys).agg(
        F.sum("n_rows").alias("n_rows"), *[F.kll_merge_agg_bigint(s, F.lit(size)).alias(s) for s in sides]
    )
    values = [
        F.kll_sketch_get_quantile_bigint(side, F.lit(share)).alias(f"{side}_{round(share * 1000)}") for side in sides for share in shares
    ]
    return merged.select(*keys, "n_rows", *values)


def token_length_stats(df: DataFrame, keys: Sequence[str], *sides: str) -> DataFrame:
    aggregates = []
    for side in sides:
        size = F.size(side)
        aggregates += [
            F.min(size).alias(f"{side}_min"),
            F.max(size).alias(f"{side}_max"),
            F.sum(size).alias(f"{side}_sum"),
            F.avg(size).alias(f"{side}_avg"),
            F.percentile_approx(size, 0.5, F.lit(10_000)).alias(f"{side}_median"),
        ]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *aggregates)


def shard_validate(
    df: DataFrame,
    keys: Sequence[str],
    prompt: str = "input_tokens",
    response: str = "response_tokens",
    concept: str = "target_concept",
    dimension: int = CONCEPT_DIMENSION,
) -> DataFrame:
    """Every sample of every shard: both sides filled, vector of the right size and length one."""
    filled = (F.size(prompt) > 0) & (F.size(response) > 0)
    sized = F.size(concept) == dimension
    unit = is_unit_norm(l2_norm(F.col(concept)))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(filled).alias("n_filled"),
        F.count_if(sized).alias("n_dimension_ok"),
        F.count_if(unit).alias("n_unit_norm"),
        (F.count_if(filled & sized & unit) == F.count(F.lit(1))).alias("valid"),
    )
