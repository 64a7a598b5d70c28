"""Vocabulary, token ids and back.

Splitting runs in the JVM. Turning tokens into ids needs the vocabulary next to every row; it
never holds more than ``VOCAB_SIZE`` words, so it ships with the function, and one Arrow lookup
per batch replaces exploding the corpus, joining every token and shuffling it back together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmill.functions.arrays import TOKEN_LIMIT, truncate
from pairmill.storage import staged

# Fixed pattern: a run of letters and digits, or one other visible character.
TOKEN_PATTERN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"
_ANY_TOKEN = r"\S"
# Size of the vocabulary and its reserved ids.
VOCAB_SIZE = 151_643
PAD_ID, UNKNOWN_ID, FIRST_ID = 0, 1, 2


def split_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def has_token(text: Column) -> Column:
    """Whether a text has any token, found at its first visible character."""
    return text.rlike(_ANY_TOKEN)


def count_tokens(df: DataFrame, *texts: str) -> DataFrame:
    """Occurrences per token; the map side combines, so a hot token costs one row per task."""
    tokens = F.concat(*[split_tokens(F.col(t)) for t in texts])
    return df.select(F.explode(tokens).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n")
    )


def build_vocab(df: DataFrame, *texts: str, max_size: int = VOCAB_SIZE) -> DataFrame:
    """(token, n, id) of the most frequent tokens, equal counts in token order.

    A corpus can hold billions of distinct tokens. Their counts are written once, the number of
    tokens per count gives the lowest count that can still make it, and only tokens at or above
    it are ranked.
    """
    keep = max_size - FIRST_ID
    counts = staged(count_tokens(df, *texts), "token-counts")
    by_count = counts.groupBy("n").agg(F.count(F.lit(1)).alias("tokens"))
    more_frequent = F.sum("tokens").over(
        Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    )
    lowest = (
        by_count.select("n", F.coalesce(more_frequent, F.lit(0)).alias("above"))
        .where(F.col("above") < keep)
        .agg(F.min("n"))
        .first()[0]
    )
    kept = counts.where(F.col("n") >= F.lit(lowest)).orderBy(F.desc("n"), "token").limit(keep)
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "token"))
    return kept.withColumn("id", (rank + F.lit(FIRST_ID - 1)).cast("int"))


def _words(vocab: DataFrame) -> pa.Array:
    """Words by id. The vocabulary is bounded by construction; anything larger is refused."""
    rows = vocab.select("id", "token").limit(VOCAB_SIZE + 1).toArrow()
    if rows.num_rows > VOCAB_SIZE:
        raise ValueError(f"a vocabulary holds at most {VOCAB_SIZE} words")
    words = rows.sort_by("id").column("token").combine_chunks()
    return words.cast(pa.string())


def _offsets(lengths: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def id_lookup(vocab: DataFrame) -> Callable[[Column], Column]:
    """Function from token arrays to id arrays; words outside the vocabulary become unknown."""
    words = _words(vocab)

    def lookup(tokens: pa.Array) -> pa.Array:
        found = pc.index_in(tokens.flatten().cast(pa.string()), value_set=words)
        ids = pc.add(pc.fill_null(found, UNKNOWN_ID - FIRST_ID), FIRST_ID).cast(pa.int32())
        return pa.ListArray.from_arrays(_offsets(_lengths(tokens)), ids)

    lookup.__annotations__ = {"tokens": pa.Array, "return": pa.Array}
    return F.arrow_udf(lookup, T.ArrayType(T.IntegerType()))


def word_lookup(vocab: DataFrame) -> Callable[[Column], Column]:
    """Function from id arrays to word arrays; reserved ids are left out."""
    words = _words(vocab)

    def lookup(ids: pa.Array) -> pa.Array:
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        lengths = _lengths(ids)
        real = (flat >= FIRST_ID) & (flat < FIRST_ID + len(words))
        row = np.repeat(np.arange(len(lengths)), lengths)
        kept = np.bincount(row[real], minlength=len(lengths))
        return pa.ListArray.from_arrays(_offsets(kept), words.take(pa.array(flat[real] - FIRST_ID)))

    lookup.__annotations__ = {"ids": pa.Array, "return": pa.Array}
    return F.arrow_udf(lookup, T.ArrayType(T.StringType()))


def tokenize_corpus(
    df: DataFrame, vocab: DataFrame, sides: dict[str, str], limit: int = TOKEN_LIMIT
) -> DataFrame:
    """Add an id array per text column (``sides`` maps text to output), cut to ``limit``."""
    to_ids = id_lookup(vocab)
    return df.withColumns(
        {out: to_ids(truncate(split_tokens(F.col(text)), limit)) for text, out in sides.items()}
    )


def tokenize_with(
    df: DataFrame, tokenizer: Callable[[list[str]], list[list[int]]], text: str, out: str
) -> DataFrame:
    """Same with a caller's own tokenizer, called once per Arrow batch."""
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{out: tokenizer(batch[text].tolist())})

    return df.mapInPandas(run, schema)


def decode_tokens(df: DataFrame, vocab: DataFrame, ids: str, out: str) -> DataFrame:
    return df.withColumn(out, F.array_join(word_lookup(vocab)(F.col(ids)), " "))


def drop_empty_tokens(df: DataFrame, *sides: str) -> DataFrame:
    for side in sides:
        df = df.where(F.size(side) > 0)
    return df
