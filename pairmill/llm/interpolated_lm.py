"""Language-model scores by deleted interpolation of word bigrams, unigrams and a uniform share.

P(w | v) = a2 c(v, w) / c(v) + a1 c(w) / N + a0 / (V + 1), with the three weights chosen by the frequency
bucket of the context v (powers of two of c(v)). The weights come from expectation-maximisation over
tokens of held-out documents, whose counts are left out while it runs; scores use all training counts.

Texts are coded by blocks: each block has its own list of distinct words and writes its tokens as places
in it. A block asks once for each distinct word and bigram; the questions meet by hash in buckets, where
counts of all blocks are added up and sent back. So every count of the corpus is exact and nothing but
the histogram for the weights, of fixed size, comes to the driver. Words are known by 64-bit hashes. How
rows are dealt decides which texts share a block, but neither what is counted nor what is held out.

Cases: a null, empty or blank text is one end token; a null id is a training row; repeated rows count as
often as they stand and each gets its row; without training rows N is 0, all is unseen and the score is
that of the uniform share; further columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmill.llm.textblock import SPACES, Block, Words, arrow_schema, chunks, mix
from pairmill.storage import staged

BLOCK_CHARS = 6 << 20
LEAST_BLOCKS = 24
#: By a hash of its id one document in so many is held out while the weights are learned; blocks hold either kind.
HELD_OUT_EVERY = 8
BUCKETS_OF_CONTEXT = 24
BUCKET_ENTRIES = 1 << 20
ITERATIONS = 60
_END = np.uint64(0x1234567887654321)
_FINE, _CELLS = 4, 128  # cells an octave, and cells of a ratio's axis; cell 0 holds zero


def _zip(a: np.ndarray) -> bytes:
    return pa.compress(a.tobytes(), codec="zstd", asbytes=True)


def _unzip(data: bytes, n: int, kind: str) -> np.ndarray:
    size = n * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(data, size, codec="zstd", asbytes=True), kind) if n else np.empty(0, kind)


def _zip_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys by their steps, byte plane by byte plane."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return _zip(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T))


def _unzip_sorted(data: bytes, n: int) -> np.ndarray:
    planes = _unzip(data, 8 * n, "u1").reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


_BLOCK = "doc_ids array<bigint>, held array<boolean>, sizes array<int>, tokens binary, words binary, n_tokens bigint, n_train bigint"


def code_blocks(df: DataFrame, doc_id: str, text: str, held_out, block_chars: int) -> DataFrame:
    """One row a block: its documents, their tokens as places in the block's sorted word hashes."""
    kinds = pa.schema([
        ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())),
        ("tokens", pa.binary()), ("words", pa.binary()), ("n_tokens", pa.int64()), ("n_train", pa.int64()),
    ])

    def hashes(texts):
        parts, sizes = [], []
        for a, b in chunks(texts):
            words = Words(Block([t or "" for t in texts[a:b]]), SPACES)
            counts = words.counts()
            parts.append(np.insert(words.hashes, words.first[1:], _END))
            sizes.append(counts + 1)
        return np.concatenate(parts), np.concatenate(sizes)

    def run(batches):
        for batch in batches:
            ids, held, texts = (batch.column(k).to_pylist() for k in range(3))
            for a, b in chunks(texts, block_chars):
                found, sizes = hashes(texts[a:b])
                words, tokens = np.unique(found, return_inverse=True)
                train = int(sizes[~np.array(held[a:b], bool)].sum())
                row = [ids[a:b], held[a:b], sizes, _zip(tokens.astype(np.uint32)), words.tobytes(), len(tokens), train]
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, kinds)], schema=kinds)

    rows = df.select(F.col(doc_id).cast("bigint"), held_out, F.col(text))
    return rows.mapInArrow(run, _BLOCK)


class Coded:
    """A block read back: words, tokens, and the sorted keys it asks for."""

    def __init__(self, row: dict):
        self.words = np.frombuffer(row["words"], np.uint64)
        self.tokens = _unzip(row["tokens"], row["n_tokens"], "u4").astype(np.int64)
        self.sizes = np.array(row["sizes"], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.train = np.repeat(~np.array(row["held"], bool), self.sizes)
        # the context of a document's first token is the end of another
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.first] = np.searchsorted(self.words, _END)
        self.before = before
        n = len(self.words)
        self.pairs, self.pair_of = np.unique(before * n + self.tokens, return_inverse=True)
        words = self.words
        one = mix(words) & ~np.uint64(1)
        two = mix(words[self.pairs // n] * np.uint64(0x9E3779B97F4A7C15) + mix(words[self.pairs % n])) | np.uint64(1)
        keys = np.concatenate([one, two])
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def train_counts(self) -> np.ndarray:
        ones = np.bincount(self.tokens[self.train], minlength=len(self.words))
        twos = np.bincount(self.pair_of[self.train], minlength=len(self.pairs))
        return np.concatenate([ones, twos])[self.order].astype(np.uint32)

    def spread(self, sorted_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: the count of its bigram, of its context and of its word."""
        counts = np.empty(len(self.order), np.int64)
        counts[self.order] = sorted_counts
        ones, twos = counts[: len(self.words)], counts[len(self.words) :]
        return twos[self.pair_of], ones[self.before], ones[self.tokens]


def _ask(blocks: DataFrame, bits: int) -> DataFrame:
    schema = "bucket bigint, block bigint, tuning boolean, n bigint, keys binary, counts binary"
    kinds = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                coded = Coded(row)
                counts = coded.train_counts()
                buckets = (coded.keys >> np.uint64(64 - bits)).astype(np.int64)
                edges = np.flatnonzero(np.diff(buckets, prepend=-1, append=-1))
                out = [
                    (int(buckets[a]), row["block"], row["tuning"], int(b - a), _zip_sorted(coded.keys[a:b]), _zip(counts[a:b]))
                    for a, b in zip(edges, edges[1:])
                ]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), kinds)], schema=kinds)

    return blocks.mapInArrow(run, schema)


_REPLY = "block bigint, bucket bigint, tuning boolean, n bigint, main binary, rest binary, types bigint"


def _answer(asked: DataFrame) -> DataFrame:
    """Counts of all blocks, back to each block in the order it asked; block -1 has the number of word types."""
    kinds = arrow_schema(_REPLY)

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        blocks, tuning, sizes = (table.column(k).to_pylist() for k in ("block", "tuning", "n"))
        keys = np.concatenate([_unzip_sorted(k.as_py(), n) for k, n in zip(table.column("keys"), sizes)])
        counts = np.concatenate([_unzip(c.as_py(), n, "u4") for c, n in zip(table.column("counts"), sizes)]).astype(np.int64)
        kept_back = np.repeat(np.array(tuning, bool), sizes)
        names, place = np.unique(keys, return_inverse=True)
        main = np.bincount(place, np.where(kept_back, 0, counts), len(names)).astype(np.int64)
        rest = np.bincount(place, np.where(kept_back, counts, 0), len(names)).astype(np.int64)
        types = int((((main + rest) > 0) & (names & np.uint64(1) == 0)).sum())
        main, rest = main[place], rest[place]
        ends = np.cumsum(sizes)
        rows = [(-1, bucket, False, 0, b"", b"", types)]
        for block, hold, n, end in zip(blocks, tuning, sizes, ends):
            rows.append((block, bucket, hold, n, _zip(main[end - n : end]), _zip(rest[end - n : end]), 0))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), kinds)], schema=kinds)

    return asked.groupBy("bucket").applyInArrow(run, _REPLY)


def _replies(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    rows = sorted(zip(*(table.column(k).to_pylist() for k in ("bucket", "n", "main", "rest"))))
    return tuple(np.concatenate([_unzip(r[k], r[1], "i8") for r in rows]) for k in (2, 3))


def _context_bucket(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(counts.astype(float))[1], BUCKETS_OF_CONTEXT - 1)


def _axis(ratio: np.ndarray) -> np.ndarray:
    cell = np.zeros(len(ratio), np.int64)
    some = ratio > 0
    cell[some] = np.clip(_CELLS - 1 + np.floor(np.log2(ratio[some]) * _FINE), 1, _CELLS - 1)
    return cell


def _histogram(blocks: DataFrame, replies: DataFrame, total: int) -> DataFrame:
    """Held-out tokens by context bucket and both ratios: number and sums of the ratios a cell."""
    schema = "cell bigint, n bigint, two double, one double"
    kinds = arrow_schema(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        size = BUCKETS_OF_CONTEXT * _CELLS * _CELLS
        n, s2, s1 = np.zeros(size), np.zeros(size), np.zeros(size)
        for row in left.to_pylist():
            coded = Coded(row)
            two, context, one = coded.spread(_replies(right)[0])
            two, context, one = two[coded.train], context[coded.train], one[coded.train]
            f2, f1 = two / np.maximum(context, 1), one / max(total, 1)
            cell = (_context_bucket(context) * _CELLS + _axis(f2)) * _CELLS + _axis(f1)
            n += np.bincount(cell, minlength=size)
            s2 += np.bincount(cell, f2, size)
            s1 += np.bincount(cell, f1, size)
        some = np.flatnonzero(n)
        return pa.Table.from_arrays([pa.array(some), pa.array(n[some].astype(np.int64)), pa.array(s2[some]), pa.array(s1[some])], schema=kinds)

    cells = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)
    return cells.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("two").alias("two"), F.sum("one").alias("one"))


def learn_weights(cell: np.ndarray, n: np.ndarray, two: np.ndarray, one: np.ndarray, uniform: float) -> np.ndarray:
    """Weights of bigram, unigram and uniform share for each context bucket, by expectation-maximisation."""
    ratios = np.stack([two / np.maximum(n, 1), one / np.maximum(n, 1), np.full(len(n), uniform)], axis=1)
    bucket = cell // (_CELLS * _CELLS)
    weights = np.full((BUCKETS_OF_CONTEXT, 3), 1 / 3)
    weights[0] = [0.0, 0.5, 0.5]  # a context never seen
    for _ in range(ITERATIONS):
        share = weights[bucket] * ratios
        share /= np.maximum(share.sum(1, keepdims=True), 1e-300)
        mass = np.stack([np.bincount(bucket, share[:, k] * n, BUCKETS_OF_CONTEXT) for k in range(3)], axis=1)
        # one token more in each part, so that no weight is ever 0 and rare buckets stay near the start
        start = np.array([[1.0, 1.0, 1.0]] * BUCKETS_OF_CONTEXT)
        start[0, 0] = 0.0
        weights = (mass + start) / (mass + start).sum(1, keepdims=True)
    return weights


_SCORE = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
)


def _scores(blocks: DataFrame, replies: DataFrame, weights: np.ndarray, total: int, types: int) -> DataFrame:
    kinds = arrow_schema(_SCORE)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            coded = Coded(row)
            main, rest = _replies(right)
            two, context, one = coded.spread(main + rest)
            w = weights[_context_bucket(context)]
            p = w[:, 0] * two / np.maximum(context, 1) + w[:, 1] * one / max(total, 1) + w[:, 2] / (types + 1)
            base = np.log10((one + 0.1) / (total + 0.1 * (types + 1)))
            sums = [np.add.reduceat(x, coded.first) for x in ((one > 0).astype(np.int64), base, np.log10(p))]
            columns = [row["doc_ids"], row["held"], coded.sizes, sums[0], np.full(len(sums[0]), total), sums[1], sums[2]]
            out.append(pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, kinds)], schema=kinds))
        return pa.concat_tables(out) if out else pa.Table.from_arrays([pa.array([], f.type) for f in kinds], schema=kinds)

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, _SCORE)


def score_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int = 10) -> DataFrame:
    """A row a document; those in part 0 of ``parts`` by crc32 of the id teach nothing."""
    size = df.agg(F.sum(F.length(text))).first()[0] or 0
    block_chars = max(1, min(BLOCK_CHARS, size // LEAST_BLOCKS))
    held = F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == 0, F.lit(False))
    kept_back = F.pmod(F.xxhash64(doc_id), F.lit(HELD_OUT_EVERY)) == 0
    sides = [code_blocks(df.where(c), doc_id, text, held, block_chars).withColumn("tuning", F.lit(t)) for c, t in ((~kept_back, False), (kept_back, True))]
    blocks = staged(sides[0].unionByName(sides[1]).withColumn("block", F.monotonically_increasing_id()), "lm-blocks")
    sums = blocks.agg(F.sum("n_tokens"), F.sum("n_train"), F.sum(F.when(F.col("tuning"), F.col("n_train")))).first()
    total, tuned = sums[1] or 0, sums[2] or 0
    bits = max(4, math.ceil(math.log2(max((sums[0] or 1) / BUCKET_ENTRIES, 1))))
    replies = staged(_answer(_ask(blocks, bits)), "lm-replies")
    types = replies.agg(F.sum("types")).first()[0] or 0
    cells = _histogram(blocks.filter("tuning"), replies.filter("tuning AND block >= 0"), total - tuned).toPandas().sort_values("cell")
    weights = learn_weights(*(cells[k].to_numpy() for k in ("cell", "n", "two", "one")), uniform=1 / (types + 1))
    return _scores(blocks, replies.filter("block >= 0"), weights, total, types)
