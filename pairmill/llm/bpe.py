"""Byte-level BPE without regular expressions: class arrays, a scan of functions, cached merges.

Pre-tokens follow the pattern of public byte-level vocabularies. Each code point has a class; a class
is a function on the states of a small automaton. Functions compose associatively, and only a few
dozen can arise, so a block of text is scanned in columns side by side, each from the identity, and
the columns are then joined by applying their functions to the state that enters them. Two lookups a
code point give all boundaries.

Cases: a null text is empty and has no tokens; repeated rows each get their row; texts of any length
are encoded whole (a long pre-token merges through a heap); ids outside the vocabulary do not decode
and end the job; further columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import struct
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmill.llm.textblock import Block, arrow_schema, kept_ddl, map_blocks

#: A rank file larger than this is not sent to the tasks.
MOST_RANK_BYTES = 64 << 20
#: Entries kept of each cache (some 200 bytes each) before the older half goes.
CACHED_PIECES = 1 << 18
CACHED_PAIRS = 1 << 17

LETTER, NUMBER, OTHER, SHORT, LONG, BLANK, SPACE, END = range(8)
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_BLANK, AFTER_SPACE, LAST, TWO_LEFT, CONTRACTED = range(9)
#: White space of Unicode.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters and numbers that Unicode 16.0 added, for a Python whose tables are older.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
    (0x1E5F1, 0x1E5FA),
]
#: What may follow an apostrophe in a contraction.
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")
COLUMN = 256
ENCODED = ("ids", "piece_starts", "piece_tokens")
#: Texts of at most so many bytes are worked on at once; a longer one alone.
BLOCK_BYTES = 1 << 19


def _step(kind: int, state: int) -> int:
    if kind == LETTER:
        return {LAST: CONTRACTED, TWO_LEFT: LAST}.get(state, IN_LETTERS)
    if kind in (SHORT, LONG):
        return IN_OTHERS if state in (IN_OTHERS, AFTER_BLANK) else LAST if kind == SHORT else TWO_LEFT
    return {NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, BLANK: AFTER_BLANK, SPACE: AFTER_SPACE, END: START}[kind]


def _begins(kind: int, state: int) -> bool:
    """Whether a character that is no white space begins a pre-token after this state."""
    if kind == END:
        return True
    if kind == LETTER:
        return state not in (IN_LETTERS, AFTER_BLANK, LAST, TWO_LEFT)
    return state not in (IN_NUMBERS if kind == NUMBER else IN_OTHERS, AFTER_BLANK)


def _functions() -> tuple[np.ndarray, np.ndarray]:
    """All compositions of the classes' functions: element by class to element, and element by state to state."""
    steps = [tuple(_step(kind, state) for state in range(9)) for kind in range(8)]
    elements, index, following = [tuple(range(9))], {tuple(range(9)): 0}, []
    for element in elements:
        row = []
        for step in steps:
            composed = tuple(step[state] for state in element)
            if composed not in index:
                index[composed] = len(elements)
                elements.append(composed)
            row.append(index[composed])
        following.append(row)
    return np.array(following, np.int32), np.array(elements, np.uint8)


NEXT, APPLY = _functions()
BEGINS = np.array([[_begins(kind, state) for kind in range(8)] for state in range(9)])
_classes: list[np.ndarray] = []


def class_table() -> np.ndarray:
    """Built once a worker process."""
    if not _classes:
        table = np.full(0x110000, OTHER, np.uint8)
        for point in range(0x110000):
            major = unicodedata.category(chr(point))[0]
            if major in "LN":
                table[point] = LETTER if major == "L" else NUMBER
        for kind, ranges in ((LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS)):
            for low, high in ranges:
                table[low : high + 1] = kind
        table[WHITE_SPACE] = SPACE
        table[0x20] = BLANK
        _classes.append(table)
    return _classes[0]


def classes(block: Block) -> np.ndarray:
    points = block.points
    kinds = class_table()[points]
    quotes = np.flatnonzero(points[:-2] == 0x27) if len(points) > 2 else np.empty(0, np.int64)
    if len(quotes):
        one, two = points[quotes + 1], points[quotes + 2]
        kinds[quotes[np.isin(one, [ord(c) for c in SHORT_ENDINGS])]] = SHORT
        for a, b in LONG_ENDINGS:
            kinds[quotes[(one == ord(a)) & (two == ord(b))]] = LONG
    kinds[block.first[1:] - 1] = END
    return kinds


def states_before(kinds: np.ndarray) -> np.ndarray:
    """The automaton's state before each character, by a scan of composed functions."""
    n = len(kinds)
    columns = -(-n // COLUMN)
    padded = np.full(columns * COLUMN, END, np.uint8)
    padded[:n] = kinds
    grid = np.ascontiguousarray(padded.reshape(columns, COLUMN).T)
    scanned = np.empty((COLUMN, columns), np.int32)
    function, flat = np.zeros(columns, np.int32), NEXT.ravel()
    for row in range(COLUMN):
        function = flat[function * 8 + grid[row]]
        scanned[row] = function
    entry, state = np.zeros(columns, np.uint8), START
    for column, whole in enumerate(scanned[-1].tolist()):
        entry[column] = state
        state = APPLY[whole, state]
    after = APPLY[scanned, entry[None, :]].T.ravel()[:n]
    return np.concatenate([np.array([START], np.uint8), after[:-1]])


def piece_starts(block: Block) -> np.ndarray:
    """First positions of all pre-tokens, and the end of each document."""
    kinds = classes(block)
    before = states_before(kinds)
    white = (kinds == BLANK) | (kinds == SPACE)
    after_white = (before == AFTER_BLANK) | (before == AFTER_SPACE)
    closes = np.zeros(len(kinds), bool)  # the next character is text
    closes[:-1] = ~white[1:] & (kinds[1:] != END)
    return np.flatnonzero(np.where(white, ~after_white | closes, BEGINS[before, kinds]))


class PairRanks(dict):
    """Rank of the token that two adjacent tokens make, by both ids; looked up once a pair."""

    def __init__(self, ranks: dict[bytes, int], tokens: dict[int, bytes]):
        super().__init__()
        self.ranks, self.tokens = ranks, tokens

    def __missing__(self, pair: int) -> int:
        if len(self) >= CACHED_PAIRS:  # the younger half stays: a dict keeps the order of insertion
            for old in list(itertools.islice(self, CACHED_PAIRS // 2)):
                del self[old]
        rank = self.ranks.get(self.tokens[pair >> 32] + self.tokens[pair & 0xFFFFFFFF], sys.maxsize)
        self[pair] = rank
        return rank


def merge(ids: list[int], pairs: PairRanks) -> list[int]:
    """Joins the adjacent pair of lowest rank, the leftmost of equal ones, until none is known."""
    if len(ids) > 64:
        return _merge_long(ids, pairs)
    found = [pairs[a << 32 | b] for a, b in zip(ids, ids[1:])]
    while found and (least := min(found)) < sys.maxsize:
        i = found.index(least)
        ids[i : i + 2] = [least]
        del found[i]
        if i:
            found[i - 1] = pairs[ids[i - 1] << 32 | least]
        if i < len(found):
            found[i] = pairs[least << 32 | ids[i + 1]]
    return ids


def _merge_long(ids: list[int], pairs: PairRanks) -> list[int]:
    """The same by a heap of (rank, place, both sides), for pieces of any length."""
    n = len(ids)
    right, left = [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(rank, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (rank := pairs[a << 32 | b]) < sys.maxsize]
    heapq.heapify(heap)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = right[i]
        if ids[i] != a or j < 0 or ids[j] != b:
            continue  # one of its sides has grown since
        ids[i], ids[j] = rank, -1
        right[i] = right[j]
        if right[i] >= 0:
            left[right[i]] = i
        for k in (left[i], i):
            after = right[k] if k >= 0 else -1
            if after >= 0 and (rank := pairs[ids[k] << 32 | ids[after]]) < sys.maxsize:
                heapq.heappush(heap, (rank, k, ids[k], ids[after]))
    return [x for x in ids if x >= 0]


class Vocabulary:
    """Ranks of a tiktoken file, and a bounded cache of pieces already merged."""

    def __init__(self, content: bytes):
        pairs = [line.split() for line in content.splitlines() if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pairs = PairRanks(self.ranks, self.tokens)
        self.of_byte = [self.ranks[bytes([b])] for b in range(256)]
        self.packed = struct.Struct("<I").pack
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode_piece(self, piece: str) -> bytes:
        """Little-endian 32-bit ids. A piece used again moves from the older half of the cache to the younger."""
        ids = self.old.get(piece)
        if ids is None:
            content = piece.encode("utf-8")
            known = self.ranks.get(content)
            found = [known] if known is not None else merge([self.of_byte[b] for b in content], self.pairs)
            ids = b"".join(map(self.packed, found))
        if len(piece) <= 64:
            if len(self.young) >= CACHED_PIECES // 2:
                self.old, self.young = self.young, {}
            self.young[piece] = ids
        return ids

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        make = self.encode_piece
        return [self.young.get(piece) or make(piece) for piece in pieces]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_vocabularies: dict[int, Vocabulary] = {}


def _vocabulary(shared) -> Vocabulary:
    """One a worker process, made from the broadcast bytes of the rank file."""
    key = hash(shared.value)
    if key not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[key] = Vocabulary(shared.value)
    return _vocabularies[key]


def send_ranks(spark, path: str):
    """The rank file's bytes for all tasks; the driver alone needs to see the path."""
    with open(path, "rb") as file:
        content = file.read(MOST_RANK_BYTES + 1)
    if len(content) > MOST_RANK_BYTES:
        raise ValueError(f"{path} is larger than {MOST_RANK_BYTES} bytes")
    return spark.sparkContext.broadcast(content)


def encode_texts(texts: list[str], vocabulary: Vocabulary) -> list[tuple[bytes, bytes, bytes]]:
    """For each text its ids, the code point at which each piece begins, and each piece's first token."""
    block = Block(texts)
    starts = piece_starts(block)
    bounds = np.searchsorted(starts, block.first)
    out = []
    for k, text in enumerate(texts):
        own = starts[bounds[k] : bounds[k + 1]] - block.first[k]  # the last one is the text's end
        cut = own.tolist()
        ids = vocabulary.encode_pieces([text[a:b] for a, b in zip(cut, cut[1:])])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        firsts = np.cumsum(sizes) - sizes
        out.append((b"".join(ids), own[:-1].astype("<u4").tobytes(), firsts.astype("<u4").tobytes()))
    return out


def encode(df: DataFrame, ranks, keep: list[str], text: str = "text", columns: tuple[str, ...] = ENCODED) -> DataFrame:
    """The kept columns with ids, piece_starts and piece_tokens: little-endian 32-bit integers as BINARY.

    ``columns`` may leave some out, and may add ``decoded`` (the bytes that the ids stand for) and ``round_trip``
    (whether they are the text): asked for here, they cost no second pass and no second worker.
    """

    def work(part, texts):
        vocabulary = _vocabulary(ranks)
        made = dict(zip(ENCODED, zip(*encode_texts(texts, vocabulary))))
        if "decoded" in columns or "round_trip" in columns:
            made["decoded"] = [vocabulary.decode(x) for x in made["ids"]]
            made["round_trip"] = [x == t.encode("utf-8") for x, t in zip(made["decoded"], texts)]
        yield {k: part.column(i) for i, k in enumerate(keep)} | {k: made[k] for k in columns}

    kinds = ", ".join(f"{k} {'boolean' if k == 'round_trip' else 'binary'}" for k in columns)
    return map_blocks(df, keep, text, f"{kept_ddl(df, keep)}, {kinds}", work, BLOCK_BYTES)


def decode(df: DataFrame, ranks, keep: list[str], ids: str = "ids", to: str = "decoded") -> DataFrame:
    """The kept columns with the bytes that the ids stand for."""
    schema = f"{kept_ddl(df, keep)}, {to} binary"
    kinds = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            vocabulary, column = _vocabulary(ranks), batch.column(batch.num_columns - 1)
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                found = [vocabulary.decode(x or b"") for x in column.slice(a, 256).to_pylist()]
                arrays = [part.column(i) for i in range(len(keep))] + [pa.array(found, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, schema=kinds)

    return df.select(*keep, F.col(ids).alias("__ids")).mapInArrow(run, schema)


def decode_range(vocabulary: Vocabulary, ids: bytes, piece_starts: bytes, piece_tokens: bytes, begin: int, end: int) -> bytes:
    """The bytes of the pieces that overlap code points begin to end; the rest is not decoded."""
    starts, firsts = np.frombuffer(piece_starts, "<u4"), np.frombuffer(piece_tokens, "<u4")
    a = max(int(np.searchsorted(starts, begin, side="right")) - 1, 0)
    b = int(np.searchsorted(starts, end, side="left"))
    if b <= a:
        return b""
    last = firsts[b] if b < len(firsts) else len(ids) // 4
    return vocabulary.decode(ids[4 * firsts[a] : 4 * last])
