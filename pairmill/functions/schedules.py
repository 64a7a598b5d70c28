"""Step-dependent factors as plain column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the concept-weight ramp and of the loop budget.
WEIGHT_START = 0.01
WEIGHT_END = 1.0
WEIGHT_WARMUP = 1000
WARMUP_SHARE = 0.05
BUDGET_MIN = 8
BUDGET_MAX = 64
TOKENS_PER_LOOP = 64


def concept_weight(step: Column, warmup: int = WEIGHT_WARMUP) -> Column:
    ramp = F.lit(WEIGHT_START) + (step / F.lit(float(warmup))) * F.lit(WEIGHT_END - WEIGHT_START)
    return F.when(step >= warmup, F.lit(WEIGHT_END)).otherwise(ramp)


def learning_rate_factor(step: Column, warmup: Column, total: Column) -> Column:
    """Linear warm-up, then half a cosine that is not clamped at ``total``."""
    rising = step.cast("double") / F.greatest(warmup, F.lit(1))
    progress = (step - warmup).cast("double") / F.greatest(total - warmup, F.lit(1))
    falling = F.greatest(F.lit(0.0), F.lit(0.5) * (F.lit(1.0) + F.cos(F.lit(math.pi) * progress)))
    return F.when(step < warmup, rising).otherwise(falling)


def warmup_steps(total: Column, share: float = WARMUP_SHARE) -> Column:
    return F.floor(total * F.lit(share)).cast("int")


def loop_budget(n_tokens: Column) -> Column:
    wanted = F.floor(n_tokens / TOKENS_PER_LOOP).cast("int")
    return F.least(F.lit(BUDGET_MAX), F.greatest(F.lit(BUDGET_MIN), wanted))
