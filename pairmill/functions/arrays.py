"""Array columns: vectors and token sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_EPS = 1e-12
NORM_REL_TOL = 1e-4
TOKEN_LIMIT = 2048
ENCODER_LIMIT = 512
WINDOW = 4096
PAD = 0


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v: Column) -> Column:
    """v / max(norm, eps); the norm is bound once, not once per element."""
    divisor = F.array(F.greatest(l2_norm(v), F.lit(NORM_EPS)))
    return F.flatten(F.transform(divisor, lambda n: F.transform(_doubles(v), lambda x: x / n)))


def cosine(a: Column, b: Column) -> Column:
    scale = F.greatest(l2_norm(a), F.lit(1e-8)) * F.greatest(l2_norm(b), F.lit(1e-8))
    return dot(a, b) / scale


def is_unit_norm(norm: Column, rel_tol: float = NORM_REL_TOL) -> Column:
    return F.abs(norm - 1.0) <= rel_tol * F.greatest(norm, F.lit(1.0))


def truncate(tokens: Column, limit: int = TOKEN_LIMIT) -> Column:
    return F.slice(tokens, 1, limit)


def pad_right(tokens: Column, width: Column) -> Column:
    missing = F.greatest(width - F.size(tokens), F.lit(0))
    return F.concat(tokens, F.array_repeat(F.lit(PAD), missing))


def pad_fixed(tokens: Column, max_len: int = 256) -> Column:
    """Cut to ``max_len + 1`` so that shifting still leaves ``max_len``, then pad."""
    return pad_right(truncate(tokens, max_len + 1), F.lit(max_len + 1))


def shift_input(tokens: Column) -> Column:
    """All but the last token; a sequence of one token stays as it is."""
    return F.when(F.size(tokens) > 1, F.slice(tokens, F.lit(1), F.size(tokens) - 1)).otherwise(tokens)


def shift_target(tokens: Column) -> Column:
    return F.when(F.size(tokens) > 1, F.slice(tokens, F.lit(2), F.size(tokens) - 1)).otherwise(tokens)


def window_starts(tokens: Column, width: int = WINDOW) -> Column:
    """0-based offsets of the windows over a sequence; none for an empty one."""
    return F.when(
        F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(width))
    ).otherwise(F.array().cast("array<int>"))


def window_at(tokens: Column, start: Column, width: int = WINDOW) -> Column:
    return F.slice(tokens, start + 1, F.lit(width))


def joined(values: Column) -> Column:
    """An integer array as text, for reports."""
    return F.array_join(values.cast("array<string>"), ",")
