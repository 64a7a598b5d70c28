"""Whole texts as numpy arrays inside a task: code points, words and 64-bit hashes.

A block holds some documents of one Arrow batch. Its size is bounded by ``CHUNK_CHARS`` unless a
single document is longer; texts are never cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

CHUNK_CHARS = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

#: ASCII characters that part words: [\x20\x09-\x0D] and [\x00-\x2F\x3A-\x60\x7B-\x7F].
SPACES = np.zeros(128, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NON_ALNUM = np.ones(128, bool)
NON_ALNUM[0x30:0x3A] = False
NON_ALNUM[0x61:0x7B] = False


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_CHARS + 4096), base, np.uint64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def combine(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every ``width`` consecutive entries, in their order."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mix(out + hashes[k : k + n] + np.uint64(k + 1))
    return out


class Block:
    """Code points of some documents, a line feed after each, and the documents' first positions."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        joined = "\n".join(texts) + "\n"
        self.points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.first = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=self.first[1:])

    def lowered(self) -> np.ndarray:
        """Code points with A-Z in lower case."""
        upper = (self.points >= 65) & (self.points <= 90)
        return self.points + (upper.astype(np.uint32) << np.uint32(5))

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, positions, side="right") - 1


def spans(points: np.ndarray, parting: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end positions of the maximal runs without parting characters."""
    inside = np.zeros(len(points) + 2, np.int8)
    inside[1:-1] = ~((points < 128) & parting[np.minimum(points, 127)])
    steps = np.diff(inside)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def span_hashes(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice, equal for equal slices wherever they stand."""
    n = len(points)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((points + np.uint32(1)).astype(np.uint64) * _power("up", _BASE, n), out=total[1:])
    value = (total[end] - total[begin]) * _power("down", _BASE_INVERSE, n + 1)[begin]
    return mix(value ^ ((end - begin).astype(np.uint64) << np.uint64(40)))


class Words:
    """Words of a block: their hashes, document by document."""

    def __init__(self, block: Block, parting: np.ndarray):
        points = block.lowered()
        self.begin, self.end = spans(points, parting)
        self.hashes = span_hashes(points, self.begin, self.end)
        #: index of each document's first word, and one more entry at the end
        self.first = np.searchsorted(self.begin, block.first)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def chunks(texts: list[str | None], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of at most ``most`` characters, or of one longer text."""
    begin = size = 0
    for i, text in enumerate(texts):
        n = len(text or "") + 1
        if i > begin and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if len(texts) > begin:
        yield begin, len(texts)


def map_texts(
    df: DataFrame,
    keep: list[str],
    text_col: str,
    schema: str,
    work: Callable[[pa.RecordBatch, list[str]], Iterable[dict]],
    most: int = CHUNK_CHARS,
) -> DataFrame:
    """``work(kept columns, texts)`` for each block of documents, as one map over Arrow batches.

    ``work`` yields columns (name to array) in the order of ``schema``. Only ``keep`` and the text
    are read; a null text is empty.
    """
    wanted = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in chunks(texts, most):
                part = batch.slice(a, b - a)
                for columns in work(part, [t or "" for t in texts[a:b]]):
                    arrays = [as_arrow(columns[f.name], f.type) for f in wanted]
                    yield pa.RecordBatch.from_arrays(arrays, schema=wanted)

    return df.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def slices(texts: pa.Array, most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of at most ``most`` bytes of text, or of one longer text, told without decoding any."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    ends = np.cumsum(sizes)
    begin, done = 0, 0
    while begin < len(ends):
        end = max(int(np.searchsorted(ends, done + most, side="right")), begin + 1)
        yield begin, end
        begin, done = end, int(ends[end - 1])


def map_blocks(
    df: DataFrame,
    keep: list[str],
    text_col: str,
    schema: str,
    work: Callable[[pa.RecordBatch, list[str]], Iterable[dict]],
    most: int = CHUNK_CHARS,
) -> DataFrame:
    """As ``map_texts``, but only one block of an Arrow batch is ever held as Python strings."""
    wanted = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for a, b in slices(column, most):
                texts = [t or "" for t in column.slice(a, b - a).to_pylist()]
                for columns in work(batch.slice(a, b - a), texts):
                    arrays = [as_arrow(columns[f.name], f.type) for f in wanted]
                    yield pa.RecordBatch.from_arrays(arrays, schema=wanted)

    return df.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def as_arrow(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow form of a DDL schema, made on the driver."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def _ddl(kind: DataType) -> str:
    """A type as DDL with the names inside it quoted, so that they may hold dots."""
    if isinstance(kind, StructType):
        return f"struct<{', '.join(f'{_quoted(f.name)}: {_ddl(f.dataType)}' for f in kind)}>"
    if isinstance(kind, ArrayType):
        return f"array<{_ddl(kind.elementType)}>"
    if isinstance(kind, MapType):
        return f"map<{_ddl(kind.keyType)}, {_ddl(kind.valueType)}>"
    return kind.simpleString()


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def kept_ddl(df: DataFrame, keep: list[str]) -> str:
    """The kept columns' part of a DDL schema."""
    return ", ".join(f"{_quoted(f.name)} {_ddl(f.dataType)}" for f in df.select(*keep).schema)
