"""Dense numbers, chunks, caps and neighbours over an ordered source of any size.

A window over a whole source runs in one task, and one source may hold a third of all rows.
Rows here carry a position that is unique within its source, so the range
``[k * span, (k + 1) * span)`` holds at most ``span`` rows. Counting rows per range, adding the
counts up over the small table of ranges and ranking inside each range gives the same numbers,
with no task ever larger than ``span`` rows and nothing that depends on partition order.

Where positions are hashes, repeat or are missing, ``split_places`` finds parts of that size instead.

NULL keys are a source like any other. Rows without a position come first in their source, in one
range of their own and in no given order, or in that of the tie where one is named.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairmill.operators.keyed import join_small, key_of
from pairmill.storage import broadcast_if_bounded, staged

SPAN = 50_000
CHUNK_SIZE = 1000
NO_CAP = (1 << 63) - 1
#: A place with too many rows is cut into so many times as many cells as would do if all were equal.
SPARE_CELLS = 4


def _range(position: str, span: int) -> Column:
    return F.expr(f"`{position}` div {span}")


def _ranged(df: DataFrame, keys: Sequence[str], position: str, span: int) -> DataFrame:
    place = F.struct(key_of(*keys).alias("source"), _range(position, span).alias("range"))
    return df.withColumn("_place", place)


def _cells(value: str, low: str, high: str, rows: str, span: int) -> Column:
    """Which of the equal cells between ``low`` and ``high`` a value is in; exact over all of BIGINT."""
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    cells = (F.col(rows) * SPARE_CELLS / span).cast("bigint") + 1
    width = F.floor((wide(high) - wide(low)) / cells) + 1
    return F.floor((wide(value) - wide(low)) / width).cast("bigint")


def split_places(df: DataFrame, keys: Sequence[str], position: str, tie: str, span: int = SPAN) -> DataFrame:
    """Add ``_place``: parts of each source, in the order of (``position``, ``tie``), of at most ``span`` rows each.

    Positions may be anything: dense, hashed, repeated or NULL (these come first). Every source begins as one
    place. Rows, least and greatest value of each place are counted; one with too many rows is cut into equal
    cells of its own range of positions, or of its ties where all positions are one, and so on until none is
    too large. Only the rows of such places are cut again, and only the small table of places is collected by
    anyone. ``tie`` must part all rows of one position.
    """
    keys = list(keys)
    start = F.struct(key_of(*keys).alias("source"), F.array().cast("array<bigint>").alias("range"))
    placed = df.withColumn("_place", start)
    while True:
        counts = placed.groupBy("_place").agg(
            F.count(F.lit(1)).alias("_rows"),
            F.count(position).alias("_known"),
            F.min(position).alias("_low"),
            F.max(position).alias("_high"),
            F.min(tie).alias("_low_tie"),
            F.max(tie).alias("_high_tie"),
        )
        crowded = counts.where(F.col("_rows") > span)
        if crowded.where("_low < _high OR _known < _rows AND _known > 0 OR _low_tie < _high_tie").isEmpty():
            return placed
        crowded = broadcast_if_bounded(staged(crowded, "crowded-places"))
        by_position = _cells(position, "_low", "_high", "_rows", span)
        by_tie = _cells(tie, "_low_tie", "_high_tie", "_rows", span)
        mixed = (F.col("_low") < F.col("_high")) | ((F.col("_known") < F.col("_rows")) & (F.col("_known") > 0))
        cell = F.when(~mixed | F.col("_known").isNull(), by_tie).otherwise(F.coalesce(by_position, F.lit(-1)))
        cell = F.when(F.col("_known") == 0, by_tie).otherwise(cell)
        finer = F.struct(F.col("_place.source").alias("source"), F.concat("_place.range", F.array(cell)).alias("range"))
        placed = placed.join(crowded, "_place", "left").withColumn(
            "_place", F.when(F.col("_rows").isNotNull(), finer).otherwise(F.col("_place"))
        )
        placed = placed.drop("_rows", "_known", "_low", "_high", "_low_tie", "_high_tie")


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    out: str,
    span: int = SPAN,
    limit: Column | None = None,
    tie: str | None = None,
) -> DataFrame:
    """Add the 0-based dense number of each row by ``position`` within ``keys``.

    With ``limit`` only numbers below it stay; ranges that lie beyond are gone before ranking. Without ``tie``
    positions must be unique and lie close together; with it they may be anything (see ``split_places``).
    """
    keys = list(keys)
    ranged = _ranged(df, keys, position, span) if tie is None else split_places(df, keys, position, tie, span)
    counts = ranged.groupBy("_place").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("_place.source").orderBy("_place.range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_place", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("_place").orderBy(position, *([tie] if tie else []))
    # every place is in the table; a left join leaves the plan, and its exchange with it, where nobody reads the number
    made = ranged.join(offsets, "_place", "left")
    if limit is not None:
        made = made.where(F.col("_before") < limit)
    made = made.withColumn(out, F.col("_before") + F.row_number().over(inside) - 1)
    if limit is not None:
        made = made.where(F.col(out) < limit)
    return made.drop("_place", "_before")


def running_total(
    df: DataFrame, keys: Sequence[str], position: str, value: str, out: str, span: int = SPAN
) -> DataFrame:
    """Add the sum of ``value`` over all rows before, by ``position`` within ``keys``."""
    keys = list(keys)
    ranged = _ranged(df, keys, position, span)
    sums = ranged.groupBy("_place").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy("_place.source").orderBy("_place.range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_place", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = (
        Window.partitionBy("_place")
        .orderBy(position)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        ranged.join(sums, "_place")
        .withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_place", "_before")
    )


def previous_value(
    df: DataFrame, keys: Sequence[str], position: str, value: str, out: str, span: int = SPAN
) -> DataFrame:
    """Add ``value`` of the row before, by ``position`` within ``keys``; NULL on the first."""
    keys = list(keys)
    ranged = _ranged(df, keys, position, span)
    ends = ranged.groupBy("_place").agg(F.max_by(value, position).alias("_end"))
    earlier = F.lag("_end").over(Window.partitionBy("_place.source").orderBy("_place.range"))
    ends = ends.select("_place", earlier.alias("_earlier"))
    inside = Window.partitionBy("_place").orderBy(position)
    return (
        ranged.join(ends, "_place")
        .withColumn("_rank", F.row_number().over(inside))
        .withColumn(out, F.when(F.col("_rank") == 1, F.col("_earlier")).otherwise(F.lag(value).over(inside)))
        .drop("_place", "_earlier", "_rank")
    )


def chunk_assign(
    df: DataFrame,
    keys: Sequence[str] = ("domain", "source"),
    position: str = "row_pos",
    chunk_size: int = CHUNK_SIZE,
    first_chunk: DataFrame | None = None,
    already: DataFrame | None = None,
    span: int = SPAN,
    tie: str | None = None,
) -> DataFrame:
    """Add ``chunk_id`` and ``pos_in_chunk``.

    ``first_chunk`` (keys, next_chunk) starts each source at a fresh chunk. ``already``
    (keys, n_rows) goes on after that many rows instead, and so fills a short last chunk up.
    """
    made = number_rows(df, keys, position, "_number", span, tie=tie)
    if already is not None:
        made = join_small(made, already.select(*keys, F.col("n_rows").alias("_done")), keys, "left")
        made = made.withColumn("_number", F.col("_number") + F.coalesce("_done", F.lit(0))).drop("_done")
    chunk = _range("_number", chunk_size)
    if first_chunk is not None:
        made = join_small(made, first_chunk, keys, "left")
        chunk = chunk + F.coalesce("next_chunk", F.lit(0))
    return made.withColumns(
        {
            "chunk_id": chunk.cast("int"),
            "pos_in_chunk": (F.col("_number") % chunk_size).cast("int"),
        }
    ).drop("_number", "next_chunk")


def next_chunks(manifest: DataFrame, keys: Sequence[str] = ("domain", "source")) -> DataFrame:
    """Where numbering goes on: one above the highest chunk a source has."""
    return manifest.groupBy(*keys).agg((F.max("chunk_id") + 1).alias("next_chunk"))


def cap_for(domain: Column, dataset: Column, rules) -> Column:
    """The cap of the first of (domain, dataset, cap) that fits; None fits all; NULL where no rule does."""
    tests = []
    for rule_domain, rule_dataset, cap in rules:
        fits = F.lit(True)
        if rule_domain is not None:
            fits = fits & (domain == rule_domain)
        if rule_dataset is not None:
            fits = fits & (dataset == rule_dataset)
        tests.append(F.when(fits, F.lit(cap)))
    return F.coalesce(*tests, F.lit(None).cast("bigint"))


def row_cap(
    df: DataFrame,
    keys: Sequence[str] = ("domain", "source"),
    position: str = "row_pos",
    domain: str = "domain",
    dataset: str = "dataset",
    rules=None,
    done: Column | None = None,
    span: int = SPAN,
    tie: str | None = None,
) -> DataFrame:
    """First rows of each source up to its cap; rows ``done`` in earlier runs count towards it.

    Only the rules that the caller names cap anything: without them, and where none fits, all rows stay.
    """
    if not rules:
        return df
    cap = cap_for(F.col(domain), F.col(dataset), rules)
    if done is not None:
        cap = cap - done
    cap = F.coalesce(cap, F.lit(NO_CAP))
    return number_rows(df, keys, position, "_number", span, limit=cap, tie=tie).drop("_number")
