"""Concept vectors: one unit vector per response."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmill.functions.arrays import ENCODER_LIMIT, NORM_EPS, truncate

DIMENSION = 1024
MICRO_BATCH = 32
#: Rows whose counts are held as one dense matrix.
MATRIX_ROWS = 512
VECTOR_TYPE = T.ArrayType(T.FloatType())


def _bucket(token: str) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16)


def hash_encoder(dimension: int) -> Callable[[pa.Array], np.ndarray]:
    """Default encoder: counts of hashed tokens, scaled to length one."""

    def encode(tokens: pa.Array) -> np.ndarray:
        coded = tokens.flatten().dictionary_encode()
        buckets = np.array([_bucket(t) % dimension for t in coded.dictionary.to_pylist()], dtype=np.int64)
        lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(tokens)), lengths)
        hit = buckets[coded.indices.to_numpy(zero_copy_only=False)] if len(buckets) else row
        counts = np.bincount(row * dimension + hit, minlength=len(tokens) * dimension)
        counts = counts.reshape(len(tokens), dimension).astype(np.float64)
        norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        return counts / np.maximum(norms, NORM_EPS)

    return encode


def _as_vectors(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    offsets = pa.array(np.arange(0, n * width + 1, width, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.astype(np.float32).ravel()))


def concept_vector(
    tokens: Column, dimension: int = DIMENSION, limit: int = ENCODER_LIMIT
) -> Column:
    """Unit vector of the first ``limit`` tokens of a text."""
    encode = hash_encoder(dimension)

    def run(tokens: pa.Array) -> pa.Array:
        parts = [_as_vectors(encode(tokens.slice(k, MATRIX_ROWS))) for k in range(0, len(tokens), MATRIX_ROWS)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float32()))

    run.__annotations__ = {"tokens": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, VECTOR_TYPE)(truncate(tokens, limit))


def score_batches(
    df: DataFrame,
    encoder: Callable[[list[str]], np.ndarray],
    text: str,
    out: str = "target_concept",
    batch_rows: int = MICRO_BATCH,
) -> DataFrame:
    """Run a caller's encoder on micro-batches; the result is scaled to length one.

    Every Arrow batch is cut into slices of ``batch_rows`` and the last slice is always flushed,
    so no row is lost at the end of a partition.
    """
    schema = T.StructType(df.schema.fields + [T.StructField(out, VECTOR_TYPE)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), batch_rows):
                part = batch.iloc[start : start + batch_rows]
                raw = np.asarray(encoder(part[text].tolist()), dtype=np.float64)
                norms = np.sqrt((raw * raw).sum(axis=1, keepdims=True))
                unit = (raw / np.maximum(norms, NORM_EPS)).astype(np.float32)
                yield part.assign(**{out: list(unit)})

    return df.mapInPandas(run, schema)
