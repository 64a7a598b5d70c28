"""Document fingerprints by consistent weighted sampling.

Terms are lower-cased words, weights are their counts. For each of ``SAMPLES`` places and each term
two values of Gamma(2, 1) and one uniform follow from the term alone; the term of least
``ln c - r (t - beta + 1)`` with ``t = floor(ln w / r + beta)`` is drawn together with t. Two texts draw
the same pair with the generalised Jaccard similarity of their weights, so the share of equal places
estimates it (standard error at most 0.5 / sqrt(SAMPLES)).

Cases: a null text is empty; texts without words have the empty fingerprint, alike among themselves
(1.0) and unlike all others (0.0). Equal texts have equal fingerprints. Rows of one id stand side by
side in the order of their texts; null ids come last; further columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmill.llm.textblock import SPACES, Block, Words, arrow_schema, chunks, kept_ddl, map_texts, mix

SAMPLES = 64
#: Raw text bytes that one task of the pairing step holds, a little more or less.
BUCKET_BYTES = 16 << 20
_TERMS_AT_ONCE = 2048
_tables: list[tuple[np.ndarray, np.ndarray]] = []


def _gamma() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1) and their logarithms at 65,536 even steps."""
    if not _tables:
        x = np.linspace(0.0, 30.0, 3_000_001)
        values = np.interp((np.arange(65536) + 0.5) / 65536, 1.0 - np.exp(-x) * (1.0 + x), x)
        _tables.append((values.astype(np.float32), np.log(values).astype(np.float32)))
    return _tables[0]


_PLACES = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def signature(terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sixteen bits of the drawn (term, t) at each place; empty without terms. ``terms`` are distinct."""
    if not len(terms):
        return np.empty(0, ">u2")
    gamma, log_gamma = _gamma()
    low16, best, drawn = np.uint64(0xFFFF), None, None
    rows = np.arange(SAMPLES)
    for a in range(0, len(terms), _TERMS_AT_ONCE):
        own = terms[a : a + _TERMS_AT_ONCE]
        log_w = np.log(weights[a : a + _TERMS_AT_ONCE]).astype(np.float32)
        # places by terms, so that the least of a place is found along its row
        bits = mix(own[None, :] ^ _PLACES[:, None])
        r = gamma[(bits & low16).astype(np.int32)]
        log_c = log_gamma[((bits >> np.uint64(16)) & low16).astype(np.int32)]
        beta = ((bits >> np.uint64(32)) & low16).astype(np.float32) * np.float32(1 / 65536)
        t = np.floor(log_w / r + beta)
        key = log_c - r * (t - beta + np.float32(1))
        at = key.argmin(axis=1)
        least = key[rows, at]
        code = mix(own[at] + t[rows, at].astype(np.int64).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        if best is None:
            best, drawn = least, code
        else:
            better = least < best
            best, drawn = np.where(better, least, best), np.where(better, code, drawn)
    return (drawn & low16).astype(">u2")


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    out = []
    for a, b in chunks(texts):
        words = Words(Block(texts[a:b]), SPACES)
        for k in range(b - a):
            terms, counts = np.unique(words.hashes[words.first[k] : words.first[k + 1]], return_counts=True)
            out.append(signature(terms, counts))
    return out


def likeness(one: np.ndarray, two: np.ndarray) -> float:
    if len(one) == 0 or len(two) == 0:
        return float(len(one) == len(two))
    return float((one == two).mean())


def fingerprint(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns with the fingerprint as hex, one map and no shuffle."""
    kept = kept_ddl(df, keep)

    def work(part, texts):
        yield {k: part.column(i) for i, k in enumerate(keep)} | {"fingerprint": [s.tobytes().hex() for s in fingerprints(texts)]}

    return map_texts(df, keep, text, f"{kept}, fingerprint string", work)


def edit(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _bounds(df: DataFrame, doc_id: str, text: str) -> np.ndarray:
    """Ascending ids that end the buckets, each an id of the table; the last is the largest."""
    seen = df.agg(F.sum(F.octet_length(text)), F.count(F.lit(1)), F.max(doc_id)).first()
    if seen[2] is None:
        return np.empty(0, np.int64)
    buckets = max(math.ceil((seen[0] or 0) / BUCKET_BYTES), min(8, seen[1] // 500))
    cuts = []
    if buckets > 1:
        shares = [k / buckets for k in range(1, buckets)]
        cuts = df.agg(F.percentile_approx(doc_id, shares, 20 * buckets)).first()[0]
    return np.unique(np.array([*cuts, seen[2]], np.int64))


_SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def compare_with_edits(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's fingerprint beside that of its edited text and of the next one by descending id.

    Buckets of neighbouring ids hold about BUCKET_BYTES of text each; the first rows of a bucket also go,
    as guests, to the bucket before it, and those of the first bucket to the last. Texts are shuffled
    once, compressed.
    """
    bounds = df.sparkSession.sparkContext.broadcast(_bounds(df, doc_id, text))
    schema = "bucket bigint, guest boolean, doc_id bigint, packed binary, size bigint"
    codec = "zstd"

    def deal(part, texts):
        ends = bounds.value
        ids = part.column(0).to_pylist()
        raw = [t.encode("utf-8") for t in texts]
        packed = [pa.compress(x, codec=codec, asbytes=True) for x in raw]
        bucket = [0 if i is None or not len(ends) else int(np.searchsorted(ends, i)) for i in ids]
        rows = [(b, False, k) for k, b in enumerate(bucket)]
        # a bucket ends with its largest id, which comes first in descending order
        rows += [((b + 1) % len(ends), True, k) for k, b in enumerate(bucket) if ids[k] is not None and ids[k] == ends[b]]
        if not len(ends):
            rows += [(0, True, k) for k in range(len(ids))]
        yield {
            "bucket": [r[0] for r in rows], "guest": [r[1] for r in rows], "doc_id": [ids[r[2]] for r in rows],
            "packed": [packed[r[2]] for r in rows], "size": [len(raw[r[2]]) for r in rows],
        }

    out_kinds = arrow_schema(_SCHEMA)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guests, own = [], []
        for batch in batches:
            for guest, i, data, size in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4))):
                (guests if guest else own).append((i, data, size))

        def text_of(row) -> str:
            return pa.decompress(row[1], row[2], codec=codec, asbytes=True).decode("utf-8") if row[2] else ""

        def ranked(rows):
            rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0)))
            a = 0
            while a < len(rows):  # only rows of one id are put in the order of their texts
                b = a + 1
                while b < len(rows) and rows[b][0] == rows[a][0]:
                    b += 1
                if b - a > 1:
                    rows[a:b] = sorted(rows[a:b], key=text_of)
                a = b
            return rows

        own = ranked(own)
        first_guests = ranked(guests)[:1]
        line = own + first_guests
        step = 128
        for a in range(0, len(own), step):
            part = line[a : a + step + 1]
            texts = [text_of(r) for r in part]
            if a + step >= len(own) and not first_guests:
                texts.append(texts[-1])  # no guest: the only rows are without an id
            n = min(step, len(own) - a)
            marks = fingerprints(texts)
            edited = [edit(texts[k], texts[k + 1]) for k in range(n)]
            edited_marks = fingerprints(edited)
            columns = {
                "doc_id": [part[k][0] for k in range(n)],
                "n_chars": [len(texts[k]) for k in range(n)],
                "edited_sha256": [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in edited],
                "fingerprint": [m.tobytes().hex() for m in marks[:n]],
                "edited_fingerprint": [m.tobytes().hex() for m in edited_marks],
                "near_edited": [likeness(marks[k], edited_marks[k]) for k in range(n)],
                "near_next": [likeness(marks[k], marks[k + 1]) for k in range(n)],
            }
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in out_kinds], schema=out_kinds)

    dealt = map_texts(df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), ["doc_id"], "text", schema, deal)
    return dealt.groupBy("bucket").applyInArrow(pair, _SCHEMA)
