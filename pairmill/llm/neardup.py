"""MinHash near-duplicates with tensored banding, links confirmed on whole shingle sets.

Two collections of ``PARTS`` short keys of ``ROWS`` minhashes each are made for a set; every pair of one
key from each collection names a table, so PARTS * PARTS tables of 2 * ROWS rows need only
2 * PARTS * ROWS minhashes. At the threshold a pair of sets fails to meet in some table with
probability below 2 (1 - J ** ROWS) ** PARTS.

Equal sets are one class first, so copies never meet in pairs. In a bucket of classes all are compared
with its most central member, in a few rounds with others, each round only across components not yet
joined. Classes that then still stand apart in a bucket meet once more by their rarest shingles, which
loses no pair and makes few. No pair inside a component is made.

Cases: texts with fewer words than the width are one shingle; a null, empty or blank text has no
shingles and links with nothing; a null id links with nothing and is kept; rows of one id are one node
and get its component; further columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmill.llm.textblock import SPACES, Block, Words, arrow_schema, combine, map_texts, mix
from pairmill.storage import staged, staged_mapped

ROWS, PARTS = 2, 9
HUB_ROUNDS = 3
#: Buckets with more members meet in blocks of about so many, one pair of blocks a cell.
BLOCK_MEMBERS = 500
#: Ids of at most this many rows (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_SEEDS = mix(np.arange(1, 2 * PARTS * ROWS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
_FACTORS = mix(_SEEDS) | np.uint64(1)


def shingle_sets(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all distinct shingles, sorted within each text, and where each text's begin."""
    words = Words(Block(texts), SPACES)
    counts = words.counts()
    grams = combine(words.hashes, width)
    of_word = np.repeat(np.arange(len(texts)), counts)
    inside = of_word[: len(grams)] == of_word[len(of_word) - len(grams) :]
    owners, values = of_word[: len(grams)][inside], grams[inside]
    short = [(k, _whole(words.hashes[words.first[k] : words.first[k + 1]])) for k in np.flatnonzero((counts > 0) & (counts < width))]
    if short:
        owners = np.concatenate([owners, np.array([k for k, _ in short])])
        values = np.concatenate([values, np.array([v for _, v in short], np.uint64)])
    order = np.lexsort((values, owners))
    owners, values = owners[order], values[order]
    if len(values):
        new = np.concatenate([[True], (owners[1:] != owners[:-1]) | (values[1:] != values[:-1])])
        owners, values = owners[new], values[new]
    return values, np.searchsorted(owners, np.arange(len(texts) + 1))


def _whole(hashes: np.ndarray) -> int:
    return int(mix(combine(hashes, len(hashes)) + np.uint64(len(hashes)))[0])


def sketches(df: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """doc_id, n_shingles, two set hashes, and both collections of keys."""
    schema = "doc_id bigint, n_shingles bigint, high bigint, low bigint, one array<bigint>, two array<bigint>"

    def work(part, texts):
        values, first = shingle_sets(texts, width)
        sizes = np.diff(first)
        some = np.flatnonzero(sizes)
        keys = np.zeros((2 * PARTS, len(texts)), np.uint64)
        high, low = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
        if len(some):
            begin = first[:-1][some]
            for k in range(2 * PARTS):
                rows = [np.minimum.reduceat((values ^ _SEEDS[i]) * _FACTORS[i], begin) for i in range(k * ROWS, (k + 1) * ROWS)]
                keys[k, some] = reduce(lambda key, row: mix(key + row), rows, np.full(len(some), k, np.uint64))
            high[some] = np.add.reduceat(mix(values), begin)
            low[some] = np.add.reduceat(mix(values + np.uint64(0x5851F42D4C957F2D)), begin)
        lists = keys.view(np.int64).T
        yield {
            "doc_id": part.column(0), "n_shingles": sizes, "high": high.view(np.int64), "low": low.view(np.int64),
            "one": list(lists[:, :PARTS]), "two": list(lists[:, PARTS:]),
        }

    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return map_texts(rows, ["doc_id"], "text", schema, work)


def _sets(df: DataFrame, doc_id: str, text: str, width: int, ids: DataFrame) -> DataFrame:
    """id and its sorted shingle hashes as BINARY, for the wanted ids only."""

    def work(part, texts):
        values, first = shingle_sets(texts, width)
        yield {"id": part.column(0), "grams": [values[a:b].tobytes() for a, b in zip(first, first[1:])]}

    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = df.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text")).join(ids, "id")
    return map_texts(rows, ["id"], "text", "id bigint, grams binary", work)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union."""
    schema = "a bigint, b bigint"
    kinds = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                one, two = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * shared >= percent * (len(one) + len(two) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], schema=kinds)

    one = sets.select(F.col("id").alias("a"), F.col("grams").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("grams").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, schema)


def _rarest(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """class, n, gram, at: the places of the rarest shingles, of which two alike sets share one.

    Sets of n and m shingles that are alike share at least k = percent (n + m) / (100 + percent) of them. In
    one order for all, rarest first, the first that they share has k - 1 shared ones behind it, so it is
    among the first n - k + 1 of one and m - k + 1 of the other. A shingle of one class alone meets nothing.
    """
    schema = "id bigint, gram bigint"
    kinds = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams = np.frombuffer(data, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), i)), pa.array(grams)], schema=kinds)

    own = sets.join(apart.select(F.col("class").alias("id")).distinct(), "id").select("id", "grams")
    grams = staged_mapped(own.mapInArrow(run, schema), "grams")
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    ranked = grams.join(often, "gram").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("often", "gram"))).alias("all"))
    share = F.expr(f"size(all) - int(ceil({percent} * size(all) / 100.0)) + 1")
    prefix = ranked.select(F.col("id").alias("class"), F.posexplode(F.slice("all", F.lit(1), share)).alias("at", "x"))
    return staged(prefix.filter("x.often > 1").select("class", "at", F.col("x.gram").alias("key")).join(apart, "class"), "rarest")


def _mixed(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members with their component's label, in the buckets that hold more than one component."""
    if labels is None:
        return members.withColumn("label", F.col("class"))
    found = labels.select(F.col("node").alias("class"), "label")
    marked = members.join(found, "class", "left").withColumn("label", F.coalesce("label", "class"))
    mixed = marked.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key")
    return marked.join(mixed, "key")


def _as_partner() -> list[Column]:
    return [F.col(c).alias(new) for c, new in (("class", "b"), ("n", "n_b"), ("at", "at_b"), ("label", "label_b"))]


def _met(members: DataFrame, partners: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of one bucket, different labels, and sizes and places that allow the likeness."""
    shared = f"cast(ceil({percent} * (n + n_b) / {100.0 + percent}) AS INT)"
    close = f"label <> label_b AND 100 * least(n, n_b) >= {percent} * greatest(n, n_b) AND at <= n - {shared} AND at_b <= n_b - {shared}"
    found = members.join(partners, "key").filter(close)
    return found.select(F.least("class", "b").alias("a"), F.greatest("class", "b").alias("b")).distinct()


def _in_cells(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members and partners under keys of their own for each pair of blocks of a large bucket.

    A member's block is a hash of its class; it goes to the cell of its block and each other one, so no cell
    holds more than some two blocks, and two members of different blocks share just one cell. Those of one
    block meet in its own cell alone.
    """
    sizes = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS).cast("int").alias("blocks"))
    dealt = members.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("class", F.lit(1)), "blocks").cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    inside = F.col("block") == F.col("other")
    low, high = F.least("block", "other"), F.greatest("block", "other")
    cells = cells.withColumn("key", F.struct("key", low.alias("low"), high.alias("high"), inside.alias("same"))).drop("blocks", "other")
    cells = staged(cells, "cells")
    # a cell of two blocks joins the lower one with the upper one, a cell of one block joins it with itself
    partner = cells.filter("key.same OR block = key.high").select("key", *_as_partner())
    return cells.filter("key.same OR block = key.low"), partner


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node reachable) for all nodes of the edges, by repeated contraction.

    Every node moves to its least neighbour, edges follow their ends, loops go; a round at least halves
    the nodes that still have edges. Each round is written to the shared folder.
    """
    edges = staged(edges.select("a", "b").distinct(), "edges")
    moved = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("to"))
        step = staged(least.select(F.col("a").alias("node"), "to"), "step")
        if moved is None:
            moved = step.select("node", F.col("to").alias("label"))
        else:
            onward = step.select(F.col("node").alias("label"), "to")
            moved = moved.join(onward, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        moved = staged(moved, "moved")
        a, b = step.select(F.col("node").alias("a"), F.col("to").alias("to_a")), step.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        ends = edges.join(a, "a").join(b, "b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        edges = staged(ends.filter("a <> b").distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")) if moved is None else moved


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    rows = staged_mapped(sketches(df, doc_id, text, width), "sketches")
    full = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    equal = full.groupBy("high", "low", "n_shingles").agg(F.min("doc_id").alias("class"))
    classes = staged(
        full.join(equal, ["high", "low", "n_shingles"]).filter("doc_id = class").dropDuplicates(["high", "low", "n_shingles"]).select(
            F.col("class"), "n_shingles", "high", "low", "one", "two"
        ),
        "classes",
    )
    tables = classes.select("class", "n_shingles", F.posexplode("one").alias("i", "key_one"), "two").select(
        "class", "n_shingles", "i", "key_one", F.posexplode("two").alias("j", "key_two")
    )
    keyed = tables.select(F.xxhash64("i", "j", "key_one", "key_two").alias("key"), "class", F.col("n_shingles").alias("n"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    members = staged(keyed.join(shared, "key"), "members")
    central = members.groupBy("class").agg(F.sum("members").alias("central"))
    members = staged(members.join(central, "class"), "central")
    asked = _sets(df, doc_id, text, width, central.select(F.col("class").alias("id")))
    sets = staged_mapped(asked.filter("octet_length(grams) > 0").dropDuplicates(["id", "grams"]), "sets")  # an id may have empty texts too

    links, labels = None, None

    def link(pairs: DataFrame) -> None:
        nonlocal links, labels
        new = staged_mapped(_confirmed(pairs, sets, percent), "links")
        if not new.isEmpty():
            links = new if links is None else links.union(new)
            labels = components(links)

    # rows of one id are one node: the classes of its texts are linked
    of_id = full.join(equal, ["high", "low", "n_shingles"]).select("doc_id", "class").distinct()
    least = of_id.groupBy("doc_id").agg(F.min("class").alias("a"), F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    same_id = staged(of_id.join(least, "doc_id").filter("a <> class").select("a", F.col("class").alias("b")).distinct(), "same-id")
    if not same_id.isEmpty():
        links, labels = same_id, components(same_id)

    used = None
    members = members.withColumn("at", F.lit(0))
    for _ in range(HUB_ROUNDS):
        marked = _mixed(members, labels)
        free = marked if used is None else marked.join(used, "class", "left_anti")
        best = free.groupBy("key").agg(F.max(F.struct("central", *_as_partner())).alias("hub"))
        hubs = staged(best.select("key", "hub.b", "hub.n_b", "hub.at_b", "hub.label_b"), "hubs")
        now = hubs.select(F.col("b").alias("class")).distinct()
        used = staged(now if used is None else used.union(now).distinct(), "used")
        link(_met(marked, hubs, percent))
    # two classes alone in a bucket have met already
    apart = _mixed(members, labels).filter("members > 2").select("class", "n").distinct()
    members = _rarest(apart, sets, percent)
    for turn in range(HUB_ROUNDS):
        marked = _mixed(members, labels)
        best = marked.groupBy("key").agg(F.min(F.struct(F.xxhash64("class", "key", F.lit(turn)).alias("h"), *_as_partner())).alias("hub"))
        link(_met(marked, best.select("key", "hub.b", "hub.n_b", "hub.at_b", "hub.label_b"), percent))
    link(_met(*_in_cells(staged(_mixed(members, labels), "apart")), percent))
    found = classes.select("high", "low", "n_shingles", "class")
    if labels is not None:
        found = found.join(labels.select(F.col("node").alias("class"), "label"), "class", "left")
    else:
        found = found.withColumn("label", F.lit(None).cast("bigint"))
    found = found.select("high", "low", "n_shingles", F.coalesce("label", "class").alias("label"))
    out = rows.select("doc_id", "n_shingles", "high", "low").join(found, ["high", "low", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )
