"""Benchmark decontamination by winnowing: fingerprints of both sides meet in a join, hits are extended.

Of every WINDOW - GRAM + 1 consecutive GRAM-word hashes the least one (the last of equal ones) is kept.
Two texts that share WINDOW words in a row keep the same hash inside them, so no such span is missed.
Where fingerprints meet, the words before and after are compared up to WINDOW - GRAM words each way:
every window around the fingerprint lies within them. Items with fewer words than WINDOW are one
window of their own length, whose only gram is kept.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z, compared by 64-bit hashes.

Cases: a null or empty text has no words and no hits; an item without words, or without an id, is no
item; items that stand twice count once; repeated documents each get their row; an empty benchmark
hits nothing; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmill.llm.textblock import NON_ALNUM, Block, Words, combine, map_texts, mix
from pairmill.storage import staged

WINDOW, GRAM = 10, 5
REACH = WINDOW - GRAM
#: Bits of the filter over the benchmark's fingerprints: a fixed size, whatever the benchmark holds.
FILTER_BITS = 1 << 24


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """Positions of the least hash (the last of equal ones) of every ``width`` consecutive ones."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least, at = grams[:n].copy(), np.arange(n)
    for k in range(1, width):
        other = grams[k : k + n]
        take = other <= least
        least = np.where(take, other, least)
        at = np.where(take, np.arange(k, k + n), at)
    # the chosen position never steps back, so equal ones lie side by side
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def _tag(grams: np.ndarray, width: int) -> np.ndarray:
    """Hashes of different widths never stand for one another."""
    return mix(grams ^ np.uint64(width * 0x9E37)).view(np.int64)


def _context(words: np.ndarray, at: np.ndarray, width: int, outside: int) -> np.ndarray:
    """REACH words before (nearest first) and after each gram; ``outside`` where the text ends."""
    padded = np.full(len(words) + 2 * REACH, outside, np.int64)
    padded[REACH : REACH + len(words)] = words.view(np.int64)
    before = padded[(at + REACH - 1)[:, None] - np.arange(REACH)]
    after = padded[(at + REACH + width)[:, None] + np.arange(REACH)]
    return np.concatenate([before, after], axis=1)


_MARKS = "fps array<bigint>, places array<bigint>, widths array<bigint>, context array<bigint>"


def _listed(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> dict:
    return {name: pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k, name in enumerate(("fps", "places", "widths", "context"))}


def _join(parts: list[tuple], width: int) -> tuple:
    if not parts:
        return (np.empty(0, np.int64),) * 4
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(4))


def item_marks(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, fp, place, width, before, after: the fingerprints of all items."""

    def work(part, texts):
        words = Words(Block(texts), NON_ALNUM)
        rows = []
        for k in range(len(texts)):
            own = words.hashes[words.first[k] : words.first[k + 1]]
            width = GRAM if len(own) >= WINDOW else len(own)
            grams = combine(own, width) if width else np.empty(0, np.uint64)
            at = winnow(grams, WINDOW - GRAM + 1 if len(own) >= WINDOW else 1)
            rows.append((_tag(grams[at], width), at, np.full(len(at), width), _context(own, at, width, -2).ravel()))
        yield {"item_id": part.column(0)} | _listed(rows)

    known = items.filter(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text"))
    return _exploded(map_texts(known, ["item_id"], "text", f"item_id string, {_MARKS}", work), ["item_id"], "item_")


def _exploded(marks: DataFrame, keep: list[str], prefix: str) -> DataFrame:
    one = marks.select(*keep, "context", F.posexplode(F.arrays_zip("fps", "places", "widths")).alias("n", "m"))
    return one.select(
        *keep,
        F.col("m.fps").alias("fp"),
        F.col("m.places").alias(f"{prefix}place"),
        F.col("m.widths").alias(f"{prefix}width"),
        F.slice("context", F.col("n") * (2 * REACH) + 1, REACH).alias(f"{prefix}before"),
        F.slice("context", F.col("n") * (2 * REACH) + 1 + REACH, REACH).alias(f"{prefix}after"),
    )


def document_marks(docs: DataFrame, slots: np.ndarray, short: list[int], doc_id: str, text: str) -> DataFrame:
    """doc_id, n_words and the fingerprints that the filter lets through."""
    shared = docs.sparkSession.sparkContext.broadcast((np.packbits(slots), short))

    def work(part, texts):
        bits, short = shared.value

        def known(fps):
            slot = fps.view(np.uint64) % np.uint64(FILTER_BITS)
            return bits[slot >> np.uint64(3)] >> (np.uint8(7) - (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1

        words = Words(Block(texts), NON_ALNUM)
        # one pass over the block: grams that span two documents are dropped by the position of their ends
        found = []
        for width, window in [(GRAM, WINDOW - GRAM + 1)] + [(n, 1) for n in short]:
            grams = combine(words.hashes, width)
            if not len(grams):
                continue
            of_doc = np.repeat(np.arange(len(texts)), words.counts())
            same = of_doc[: len(grams)] == of_doc[width - 1 :]
            if window == 1:
                at = np.flatnonzero(same)
            else:
                at = _winnow_block(grams, words.first, width, window)
            fps = _tag(grams[at], width)
            keep = known(fps)
            found.append((width, at[keep], fps[keep], of_doc[at[keep]]))
        rows = []
        for k in range(len(texts)):
            first = words.first[k]
            own = words.hashes[first : words.first[k + 1]]
            parts = []
            for width, at, fps, of in found:
                a, b = np.searchsorted(of, [k, k + 1])
                if b > a:
                    place = at[a:b] - first
                    parts.append((fps[a:b], place, np.full(b - a, width), _context(own, place, width, -1).ravel()))
            rows.append(_join(parts, 0))
        yield {"doc_id": part.column(0), "n_words": words.counts()} | _listed(rows)

    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_texts(rows, ["doc_id"], "text", f"doc_id {kind}, n_words bigint, {_MARKS}", work)


def _winnow_block(grams: np.ndarray, first: np.ndarray, width: int, window: int) -> np.ndarray:
    """Chosen positions of all windows that lie inside one document."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least, at = grams[:n].copy(), np.zeros(n, np.int8)
    for k in range(1, window):
        other = grams[k : k + n]
        take = other <= least
        np.copyto(least, other, where=take)
        at[take] = k
    counts = np.diff(first)
    of_word = np.repeat(np.arange(len(counts)), counts)
    span = width + window - 1
    inside = of_word[:n] == of_word[span - 1 : span - 1 + n]
    chosen = (at + np.arange(n))[inside]
    return chosen[np.concatenate([[True], chosen[1:] != chosen[:-1]])] if len(chosen) else chosen


def _same_ahead(one: Column, two: Column) -> Column:
    """How many leading entries are equal."""
    differs = F.array_position(F.zip_with(one, two, lambda a, b: a == b), F.lit(False))
    return F.when(differs > 0, differs - 1).otherwise(F.lit(REACH))


def _covered(intervals: str) -> Column:
    """Words inside the union of intervals."""
    return F.aggregate(
        F.array_sort(intervals),
        F.struct(F.lit(0).cast("bigint").alias("words"), F.lit(0).cast("bigint").alias("upto")),
        lambda acc, x: F.struct(
            (acc.words + F.greatest(F.lit(0).cast("bigint"), x.end - F.greatest(x.begin, acc.upto))).alias("words"),
            F.greatest(acc.upto, x.end).alias("upto"),
        ),
        lambda acc: acc.words,
    )


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted ids), intervals (words hit) for every document row."""
    known = staged(item_marks(items, item_id, item_text), "winnow-items")
    slot = F.expr(f"pmod(fp, {FILTER_BITS}L)")
    # as unsigned: a power of two, so the signed remainder is the same slot
    taken = known.select(slot.alias("slot")).distinct().toPandas()["slot"].to_numpy()
    slots = np.zeros(FILTER_BITS, bool)
    slots[taken.astype(np.int64)] = True
    short = sorted(r[0] for r in known.select("item_width", F.size("item_before")).distinct().collect() if r[0] != GRAM)
    whole = known.filter(F.col("item_width") == GRAM)
    # an item of exactly GRAM words is a window of its own
    lone = whole.filter((F.element_at("item_before", 1) == -2) & (F.element_at("item_after", 1) == -2)).limit(1).count()
    if lone:
        short = sorted({*short, GRAM})
    marks = document_marks(docs, slots, short, doc_id, text).withColumn("row", F.monotonically_increasing_id())
    rows = staged(marks, "winnow-docs")
    near = _exploded(rows, ["row"], "").join(known, "fp").filter(F.col("width") == F.col("item_width"))
    left, right = _same_ahead(F.col("before"), F.col("item_before")), _same_ahead(F.col("after"), F.col("item_after"))
    is_whole = (F.element_at("item_before", 1) == -2) & (F.element_at("item_after", 1) == -2)
    near = near.select("row", "item_id", "place", "width", is_whole.alias("whole"), left.alias("l"), right.alias("r"))
    hits = near.filter(F.col("whole") | (F.col("l") + F.col("width") + F.col("r") >= WINDOW)).select(
        "row",
        "item_id",
        F.struct(
            F.when(F.col("whole"), F.col("place")).otherwise(F.col("place") - F.col("l")).alias("begin"),
            F.when(F.col("whole"), F.col("place") + F.col("width")).otherwise(F.col("place") + F.col("width") + F.col("r")).alias("end"),
        ).alias("span"),
    )
    per_row = hits.groupBy("row").agg(F.collect_set("item_id").alias("items"), F.collect_set("span").alias("spans"))
    found = rows.select("row", "doc_id", "n_words").join(per_row, "row", "left")
    none = F.array().cast("array<string>")
    return found.select(
        "doc_id",
        "n_words",
        F.coalesce(_covered("spans"), F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce(F.array_sort("items"), none).alias("items"),
        F.array_sort("spans").alias("intervals"),
    )
