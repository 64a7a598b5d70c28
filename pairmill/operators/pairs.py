"""In-batch similarity and covariance.

Both compare the rows of a batch with each other. A batch of ordinary size is packed into one
row and multiplied as a matrix. A batch may also be as large as the data: its rows are then
hashed into blocks, every pair of blocks is a task of its own, and only sums leave a task, so
neither the pairs nor a whole batch ever come together in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmill.operators.keyed import join_small, key_of
from pairmill.storage import staged

BLOCK_ROWS = 1024
MERGE_WIDTH = 64
NORM_EPS = 1e-12

_STATS = T.ArrayType(
    T.StructType(
        [
            T.StructField("partners", T.LongType()),
            T.StructField("positive", T.DoubleType()),
            T.StructField("closest", T.DoubleType()),
        ]
    )
)


def _matrices(vectors: pa.Array) -> Iterator[np.ndarray]:
    """One matrix per packed row of equally long vectors."""
    rows = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    inner = vectors.flatten()
    flat = inner.flatten().to_numpy(zero_copy_only=False)
    width = len(flat) // max(len(inner), 1)
    at = 0
    for n in rows:
        yield flat[at * width : (at + n) * width].reshape(n, width)
        at += n


def _cell_stats(vectors: pa.Array, blocks: pa.Array, square: pa.Array) -> pa.Array:
    out, at = [], 0
    labels = blocks.flatten().to_numpy(zero_copy_only=False)
    for matrix, same in zip(_matrices(vectors), square.to_pylist()):
        n = len(matrix)
        unit = matrix / np.maximum(np.sqrt((matrix * matrix).sum(axis=1, keepdims=True)), NORM_EPS)
        label = labels[at : at + n]
        at += n
        partner = ~np.eye(n, dtype=bool) if same else label[:, None] != label[None, :]
        cosines = unit @ unit.T
        positive = np.where(partner, np.maximum(cosines, 0.0), 0.0).sum(axis=1)
        closest = np.where(partner, cosines, -np.inf).max(axis=1, initial=-np.inf)
        out.append(
            [
                {"partners": int(k), "positive": float(p), "closest": float(c) if k else None}
                for k, p, c in zip(partner.sum(axis=1), positive, closest)
            ]
        )
    kind = pa.list_(
        pa.struct([("partners", pa.int64()), ("positive", pa.float64()), ("closest", pa.float64())])
    )
    return pa.array(out, type=kind)


_cell_stats.__annotations__ = {
    "vectors": pa.Array, "blocks": pa.Array, "square": pa.Array, "return": pa.Array
}


def batch_pairs(
    df: DataFrame, batch: str, row: str, vector: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """For each row, over all other rows of its batch: how many there are, the sum of the
    positive cosines and the highest cosine. One output row per input row, never one per pair.
    Rows of a NULL batch are a batch."""
    sizes = df.groupBy(batch).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_blocks"))
    block = F.pmod(F.xxhash64(row), F.col("_blocks")).cast("int")
    placed = (
        df.select(batch, row, F.col(vector).cast("array<double>").alias("_v"))
        .transform(join_small, sizes, [batch])
        .withColumn("_block", block)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumns({"_a": F.least("_block", "_other"), "_b": F.greatest("_block", "_other")})
    )
    packed = placed.groupBy(batch, "_a", "_b").agg(
        F.collect_list(F.struct(row, "_block", "_v")).alias("_m")
    )
    stats = F.arrow_udf(_cell_stats, _STATS)(
        F.col("_m._v"), F.col("_m._block"), F.col("_a") == F.col("_b")
    )
    per_cell = packed.select(
        batch, F.explode(F.arrays_zip(F.col(f"_m.{row}").alias(row), stats.alias("_s"))).alias("_r")
    )
    return per_cell.groupBy(batch, F.col(f"_r.{row}").alias(row)).agg(
        F.sum("_r._s.partners").alias("partners"),
        F.sum("_r._s.positive").alias("positive"),
        F.max("_r._s.closest").alias("closest"),
    )


def separability_loss(
    df: DataFrame, batch: str, row: str, vector: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Mean positive cosine over all ordered pairs of a batch; 0 for a batch of one."""
    pairs = batch_pairs(df, batch, row, vector, block_rows)
    return pairs.groupBy(batch).agg(
        F.when(F.sum("partners") > 0, F.sum("positive") / F.sum("partners"))
        .otherwise(0.0)
        .alias("separability_loss")
    )


# --------------------------------------------------------------------------- covariance


def _off_diagonal(vectors: pa.Array) -> pa.Array:
    out = []
    for matrix in _matrices(vectors):
        n, width = matrix.shape
        if n < 2 or width < 2:
            out.append(0.0)
            continue
        centred = matrix - matrix.mean(axis=0)
        # both products have the same Frobenius norm; take the smaller one
        product = centred @ centred.T if n <= width else centred.T @ centred
        diagonal = (centred * centred).sum(axis=0)
        total = (product * product).sum() - (diagonal * diagonal).sum()
        out.append(float(total) / (n - 1) ** 2 / (width * (width - 1)))
    return pa.array(out, type=pa.float64())


_off_diagonal.__annotations__ = {"vectors": pa.Array, "return": pa.Array}


def _sum_arrays(arrays: pa.Array) -> pa.Array:
    sums = [matrix.sum(axis=0) for matrix in _matrices(arrays)]
    return pa.array(sums, type=pa.list_(pa.float64()))


_sum_arrays.__annotations__ = {"arrays": pa.Array, "return": pa.Array}


def sum_arrays(df: DataFrame, keys: list[str], part: str, values: str) -> DataFrame:
    """Elementwise sum of equally long arrays per key, in two rounds so that no list of partial
    results grows with the number of tasks that made them."""
    total = F.arrow_udf(_sum_arrays, T.ArrayType(T.DoubleType()))
    slot = F.pmod(F.xxhash64(part), F.lit(MERGE_WIDTH))
    first = df.groupBy(*keys, slot.alias("_slot")).agg(F.collect_list(values).alias("_l"))
    second = first.select(*keys, total("_l").alias("_p")).groupBy(*keys).agg(F.collect_list("_p").alias("_l"))
    return second.select(*keys, total("_l").alias(values))


def _merge(one, other):
    """(n, mean, Gram of the centred rows) of two sets of rows together."""
    if one is None:
        return other
    (n, mean, gram), (m, their_mean, their_gram) = one, other
    step = their_mean - mean
    return n + m, mean + step * (m / (n + m)), gram + their_gram + np.outer(step, step) * (n * m / (n + m))


def _partial_moments(batch: str, vector: str):
    """Per task and run of equal batch values: n and mean (``_i`` -1), and the rows of the Gram matrix."""

    def flush(key, part, moments):
        n, mean, gram = moments
        made = pd.DataFrame({"_i": np.arange(-1, len(gram)), "_row": [mean, *gram]})
        return made.assign(**{batch: key, "_part": part, "_n": n})[[batch, "_part", "_n", "_i", "_row"]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, part, moments = None, None, None
        for frame in frames:
            for value, group in frame.groupby(batch, sort=False, dropna=False):
                matrix = np.stack(group[vector].to_list()).astype(np.float64)
                mean = matrix.mean(axis=0)
                own = (len(matrix), mean, (matrix - mean).T @ (matrix - mean))
                value = None if pd.isna(value) else value
                if moments is not None and value != key:
                    yield flush(key, part, moments)
                    moments = None
                key, moments, part = value, _merge(moments, own), int(group["_part"].iloc[0])
        if moments is not None:
            yield flush(key, part, moments)

    return run


def _between(batch: str):
    """Gram rows of the tasks' means about the mean of all, each counted as often as it has rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for value, group in frame.groupby(batch, sort=False, dropna=False):
                steps = np.stack(group["_row"].to_list()) - np.stack(group["_mean"].to_list())
                gram = (steps * group["_n"].to_numpy()[:, None]).T @ steps
                made = pd.DataFrame({"_i": np.arange(len(gram)), "_row": list(gram)})
                made[batch] = [None if pd.isna(value) else value] * len(gram)
                yield made.assign(_part=-1 - int(group["_part"].iloc[0]))[[batch, "_part", "_i", "_row"]]

    return run


def _large_spectral(df: DataFrame, batch: str, vector: str) -> DataFrame:
    """Covariance of batches too large to pack, in one scan of the vectors.

    Each task gives the count, mean and centred Gram matrix of its rows. Together they are the sum of these
    matrices and of the tasks' means about the mean of all, which is reckoned from the small table of means.
    """
    kind = df.schema[batch].dataType.simpleString()
    schema = f"`{batch}` {kind}, _part int, _n bigint, _i int, _row array<double>"
    rows = df.select(batch, F.col(vector).cast("array<double>").alias(vector), F.spark_partition_id().alias("_part"))
    made = rows.sortWithinPartitions(batch).mapInPandas(_partial_moments(batch, vector), schema)
    moments = staged(made, "moments")
    means = moments.where("_i = -1").select(batch, "_part", "_n", "_row")
    keyed = means.withColumn("_on", key_of(batch))
    sizes = keyed.groupBy("_on").agg(F.sum("_n").alias("_total"))
    weighted = keyed.withColumn("_row", F.expr("transform(_row, x -> x * _n)"))
    grand = sum_arrays(weighted, ["_on"], "_part", "_row").join(sizes, "_on")
    grand = grand.select("_on", "_total", F.expr("transform(_row, x -> x / _total)").alias("_mean"))
    apart = keyed.join(grand.select("_on", "_mean"), "_on").select(batch, "_part", "_n", "_row", "_mean")
    between = apart.mapInPandas(_between(batch), f"`{batch}` {kind}, _part int, _i int, _row array<double>")
    grams = moments.where("_i >= 0").select(batch, "_part", "_i", "_row").unionByName(between)
    merged = sum_arrays(grams.withColumn("_on", key_of(batch)), ["_on", "_i"], "_part", "_row").join(sizes, "_on")
    squares = F.aggregate("_row", F.lit(0.0), lambda acc, x: acc + x * x)
    diagonal = F.pow(F.get("_row", F.col("_i")), 2)
    width = F.max(F.size("_row"))
    loss = F.sum(squares - diagonal) / F.pow(F.first("_total") - 1, 2) / (width * (width - 1))
    return merged.groupBy("_on").agg(loss.alias("spectral_loss")).select(F.col("_on.k0").alias(batch), "spectral_loss")


def spectral_loss(
    df: DataFrame, batch: str, vector: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Mean squared off-diagonal entry of each batch's covariance matrix; 0 for a batch of one. NULL is a batch."""
    sizes = df.groupBy(batch).agg(F.count(F.lit(1)).alias("_n"))
    sized = join_small(df.select(batch, vector), sizes, [batch])
    packed = (
        sized.where(F.col("_n") <= block_rows)
        .groupBy(batch)
        .agg(F.collect_list(F.col(vector).cast("array<double>")).alias("_m"))
    )
    small = packed.select(batch, F.arrow_udf(_off_diagonal, T.DoubleType())("_m").alias("spectral_loss"))
    return small.unionByName(_large_spectral(sized.where(F.col("_n") > block_rows), batch, vector))
