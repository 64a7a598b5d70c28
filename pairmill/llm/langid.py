"""Language identification by error-correcting output codes over character trigrams.

Every language has a codeword of bits. One binary classifier a bit tells the languages whose bit is
1 from the others by the log ratio of trigram probabilities; the trigram counts come from all
labelled rows, summed by Spark. A text takes the language whose codeword loses least against the
margins of all bits, each bit weighted by how well its two sides part.

Cases: a null text, an empty one, or one without letters is ``und`` with score 0 and ambiguous; rows
with a null language teach nothing; without any labelled row every text is ``und``. Repeated rows
count as often as they stand and each gets its row; further columns are not read.
"""

from __future__ import annotations

import math
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmill.llm.textblock import Block, arrow_schema, chunks, kept_ddl, map_texts, mix

UNDETERMINED = "und"
BINS = 1 << 13
#: The loss of the second language must exceed the best one's by this share of a bit.
AMBIGUOUS_BELOW = 1.0
SMOOTHING = 0.5

_tables: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Lower-case code point of every letter, 0 for all else."""
    if not _tables:
        table = np.zeros(0x110000, np.uint32)
        for point in range(0x110000):
            char = chr(point)
            if unicodedata.category(char)[0] == "L":
                low = char.lower()
                table[point] = ord(low) if len(low) == 1 else point
        _tables.append(table)
    return _tables[0]


def trigrams(texts: list[str], bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the trigrams inside words (one blank at each side), and where each text's begin."""
    block = Block(texts)
    letters = _letters()[block.points]
    some = letters > 0
    keep = some.copy()
    keep[1:] |= some[:-1]
    keep[0] = True
    kept = np.flatnonzero(keep)
    line = np.concatenate([np.zeros(1, np.uint32), letters[kept]]).astype(np.uint64)
    middle = np.flatnonzero(line[1:-1] > 0) + 1
    code = (line[middle - 1] << np.uint64(42)) ^ (line[middle] << np.uint64(21)) ^ line[middle + 1]
    where = kept[middle - 1]
    return (mix(code) % np.uint64(bins)).astype(np.int64), np.searchsorted(where, block.first)


def count_trigrams(labelled: DataFrame, text: str = "text", lang: str = "lang", bins: int = BINS) -> DataFrame:
    """lang, bin, n over all rows. A task sums its rows first, so few rows are shuffled."""
    schema = "lang string, bin bigint, n bigint"
    kinds = arrow_schema(schema)

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                found, first = trigrams([t or "" for t in texts[a:b]], bins)
                names, group = np.unique(np.array(langs[a:b], dtype=object), return_inverse=True)
                of_gram = np.repeat(group, np.diff(first))
                for k, name in enumerate(names):
                    add = np.bincount(found[of_gram == k], minlength=bins)
                    sums[name] = sums[name] + add if name in sums else add
        for name, total in sums.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(some), pa.string()), pa.array(some), pa.array(total[some])], schema=kinds
            )

    rows = labelled.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    return rows.mapInArrow(run, schema).groupBy("lang", "bin").agg(F.sum("n").alias("n"))


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 for each of n languages, the closest two rows as far apart as found."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:  # every way to part them once
        columns = [[1.0] + [1.0 if k >> i & 1 else -1.0 for i in range(n - 1)] for k in range((1 << (n - 1)) - 1)]
        return np.array(columns).T
    bits, draw = 6 * math.ceil(math.log2(n)), np.random.default_rng(7)
    best, most = None, -1
    for _ in range(64):
        code = np.where(draw.random((n, bits)) < 0.5, -1.0, 1.0)
        if (np.abs(code.sum(0)) == n).any():
            continue
        apart = (bits - code @ code.T) / 2 + np.eye(n) * bits
        if apart.min() > most:
            best, most = code, apart.min()
    return best


class Ecoc:
    """Weights of the bits' classifiers, and the languages' codewords."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        n = len(self.langs)
        if not n:
            return
        grams = np.array([counts[x] for x in self.langs], float) + SMOOTHING
        share = grams / grams.sum(1, keepdims=True)
        self.code = codewords(n)
        bits = self.code.shape[1]
        self.weights = np.zeros((share.shape[1], bits), np.float32)
        self.center, self.scale, trust = np.zeros(bits), np.ones(bits), np.ones(bits)
        for b in range(bits if n > 1 else 0):
            one = self.code[:, b] > 0
            w = np.log(share[one].mean(0)) - np.log(share[~one].mean(0))
            mean = share @ w
            spread = np.sqrt(np.maximum(share @ w**2 - mean**2, 1e-12)).mean()
            low, high = mean[~one].mean(), mean[one].mean()
            self.weights[:, b] = w
            self.center[b], self.scale[b] = (low + high) / 2, max((high - low) / 2, 1e-9)
            trust[b] = (high - low) / spread
        self.trust = trust / trust.mean()

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Texts by languages: the weighted logistic loss of the margins against each codeword."""
        z = (margins - self.center) / self.scale
        out = np.zeros((len(z), len(self.langs)))
        for k, row in enumerate(self.code):
            out[:, k] = (self.trust * np.logaddexp(0.0, -2.0 * row * z)).sum(1)
        return out


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", bins: int = BINS) -> Ecoc:
    """Counts of all labelled rows; the driver gets ``bins`` numbers a language, whatever the input."""
    counts: dict[str, np.ndarray] = {}
    for row in count_trigrams(labelled, text, lang, bins).collect():
        counts.setdefault(row.lang, np.zeros(bins))[row.bin] = row.n
    return Ecoc(counts)


def predict(df: DataFrame, model: Ecoc, keep: list[str], text: str = "text", bins: int = BINS) -> DataFrame:
    """The kept columns with lang_pred, score, second (the runner-up) and ambiguous."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = f"{kept_ddl(df, keep)}, lang_pred string, score double, second string, ambiguous boolean"

    def work(part, texts):
        model = shared.value
        found, first = trigrams(texts, bins)
        sizes = np.diff(first)
        pred = np.array([UNDETERMINED] * len(texts), dtype=object)
        second, score, doubt = np.array([None] * len(texts), dtype=object), np.zeros(len(texts)), np.ones(len(texts), bool)
        some = np.flatnonzero(sizes > 0)
        if len(some) and model.langs:
            # texts without trigrams take no room, so the sums of the others lie side by side
            margins = np.add.reduceat(model.weights[found], first[some], axis=0).astype(float) / sizes[some, None]
            loss = model.losses(margins)
            order = np.argsort(loss, axis=1, kind="stable")
            rows, best = np.arange(len(some)), order[:, 0]
            share = np.exp(loss[rows, best][:, None] - loss)
            names = np.array(model.langs, dtype=object)
            pred[some], score[some] = names[best], 1.0 / share.sum(1)
            doubt[some] = False
            if len(names) > 1:
                second[some] = names[order[:, 1]]
                doubt[some] = loss[rows, order[:, 1]] - loss[rows, best] < AMBIGUOUS_BELOW
        yield {k: part.column(i) for i, k in enumerate(keep)} | {
            "lang_pred": pred, "score": score, "second": second, "ambiguous": doubt
        }

    return map_texts(df, keep, text, schema, work)


def crc_part(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id is in part 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts, F.lit(0))
