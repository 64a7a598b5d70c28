"""Scoring of candidate groups: rewards, group-relative advantages, clipped surrogate, retries.

Group figures come from an aggregate joined back, not from a window: the aggregate combines on
the map side and adaptive execution may split a hot prompt in the join, while a window would
pull the whole group into one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pairmill.operators.keyed import key_of

# Fixed values of reward, advantage, surrogate and retry loop.
LOOP_PENALTY = 0.01
SIGMA_FLOOR = 1e-6
CLIP = 0.2
MAX_ATTEMPTS = 3
VARIANCE_EPS = 1e-6
#: Texts sent to a checker at once.
CHECK_ROWS = 64


def reward(compiled: Column, avg_loops: Column, gamma: float = LOOP_PENALTY) -> Column:
    return F.when(compiled, 1.0).otherwise(0.0) - F.lit(gamma) * avg_loops


def _relative(df: DataFrame, keys: Sequence[str], value: str, sigma: Column, out: str) -> DataFrame:
    keyed = df.withColumn("_on", key_of(*keys))
    groups = keyed.groupBy("_on").agg(F.avg(value).alias("_mean"), sigma.alias("_sigma"))
    joined = keyed.join(groups, "_on")
    return joined.withColumn(out, (F.col(value) - F.col("_mean")) / F.col("_sigma")).drop("_on", "_mean", "_sigma")


def group_advantage(
    df: DataFrame, keys: Sequence[str], value: str, out: str = "advantage"
) -> DataFrame:
    """Distance to the group mean in sample standard deviations; a lone candidate divides by 1."""
    spread = F.greatest(F.stddev_samp(value), F.lit(SIGMA_FLOOR))
    sigma = F.when(F.count(value) > 1, spread).otherwise(1.0)
    return _relative(df, keys, value, sigma, out)


def group_advantage_doc(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    out: str = "advantage",
    eps: float = VARIANCE_EPS,
) -> DataFrame:
    """The documented variant: population variance plus a small term under the root."""
    return _relative(df, keys, value, F.sqrt(F.var_pop(value) + F.lit(eps)), out)


def candidate_loss(lp_new: Column, lp_old: Column, advantage: Column, clip: float = CLIP) -> Column:
    def term(new: Column, old: Column) -> Column:
        ratio = F.exp(new - old)
        clipped = F.least(F.greatest(ratio, F.lit(1.0 - clip)), F.lit(1.0 + clip))
        return F.least(ratio * advantage, clipped * advantage)

    terms = F.zip_with(lp_new, lp_old, term)
    return -F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x) / F.size(lp_new)


def surrogate_loss(
    df: DataFrame, keys: Sequence[str], lp_new: str, lp_old: str, advantage: str
) -> DataFrame:
    """Sum over the group of each candidate's mean clipped loss."""
    loss = candidate_loss(F.col(lp_new), F.col(lp_old), F.col(advantage))
    return df.groupBy(*keys).agg(F.sum(loss).alias("surrogate_loss"))


def attempt_resolution(
    df: DataFrame,
    keys: Sequence[str],
    attempt: str = "attempt",
    ok: str = "ok",
    code: str = "code",
    max_attempts: int = MAX_ATTEMPTS,
    error: str | None = None,
) -> DataFrame:
    """First success of at most three attempts; without one, the last attempt is the result.

    ``error`` names a column that is true where the check itself broke: such an attempt is the last one.
    """
    tried = df.where(F.col(attempt) <= max_attempts)
    stops = F.col(ok) if error is None else F.col(ok) | F.coalesce(F.col(error), F.lit(False))
    place = F.when(stops, F.col(attempt))
    resolved = tried.groupBy(*keys).agg(
        F.min(place).alias("_stop"),
        F.max(attempt).alias("_last"),
        F.min_by(F.struct(F.col(ok).alias("ok"), F.col(code).alias("code")), place).alias("_at_stop"),
        F.max_by(code, attempt).alias("_final"),
    )
    stopped = F.col("_stop").isNotNull()
    return resolved.select(
        *keys,
        (stopped & F.coalesce(F.col("_at_stop.ok"), F.lit(False))).alias("solved"),
        F.coalesce("_stop", "_last").alias("attempts"),
        F.when(stopped, F.col("_at_stop.code")).otherwise(F.col("_final")).alias("code"),
    )


def check_candidates(
    df: DataFrame, checker: Callable[[list[str]], Sequence[bool]], code: str = "code", batch_rows: int = CHECK_ROWS
) -> DataFrame:
    """Add the verdict of a caller's checker as ``ok``, and ``error`` where it gave none.

    ``checker`` gets texts and returns as many verdicts. If it raises, its texts are checked one by one, and
    only the one that it fails on is without a verdict; the job goes on. A NULL text is not sent and not ok.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType())])
    kinds = to_arrow_schema(schema)
    place = df.columns.index(code)

    def verdicts(texts: list[str]) -> list[tuple[bool | None, str | None]]:
        try:
            found = [bool(v) for v in checker(texts)]
            if len(found) != len(texts):
                raise ValueError(f"{len(found)} verdicts for {len(texts)} texts")
            return [(v, None) for v in found]
        except Exception as error:
            if len(texts) == 1:
                return [(None, f"{type(error).__name__}: {error}")]
            return [one for text in texts for one in verdicts([text])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, batch_rows):
                part = batch.slice(a, batch_rows)
                texts = part.column(place).to_pylist()
                sent = [t for t in texts if t is not None]
                answers = iter(verdicts(sent) if sent else [])
                made = [next(answers) if t is not None else (False, None) for t in texts]
                ok, errors = pa.array([m[0] for m in made], pa.bool_()), pa.array([m[1] for m in made], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, ok, errors], schema=kinds)

    return df.mapInArrow(run, schema)


def quarantine_unchecked(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a verdict, and those on which the checker failed, with its error."""
    return checked.where(F.col("error").isNull()).drop("error"), checked.where(F.col("error").isNotNull()).drop("ok")
