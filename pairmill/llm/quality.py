"""A quality classifier: ridge regression on random Fourier features of document statistics, calibrated.

One pass over whole texts takes some thirty statistics a document (shares of character classes, word
lengths, repeated words, trigrams and lines). Scaled by the mean and deviation of the labelled documents,
they are mapped by cosines of random projections, whose products approximate a Gaussian kernel. Tasks sum
the normal equations of the labelled documents, the driver solves them, and an isotonic curve, fitted to a
part of the labelled documents that the regression has not seen, turns its values into probabilities.

Statistics and features are rounded to whole numbers before they are summed, so the sums, and with them
the model, are the same however the rows are dealt. All labelled rows teach; what reaches the driver is
bounded by the number of features and of bins, whatever the input.

Cases: a null text is empty, and an empty text has statistics of 0 and a score like any other; rows
without a label, labels without a row and rows with a null id teach nothing; of several labels of one id
the largest counts; repeated rows each teach and each get their row; with labels of one class only every
score is that class, without labels 0.0; texts of any length are read whole, as one block; an empty table
gives an empty result; further columns are not read.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmill.llm.textblock import SPACES, Block, arrow_schema, combine, kept_ddl, map_blocks, mix, span_hashes, spans
from pairmill.storage import staged

#: Random features, the kernel's width in units of the root of the number of statistics, and the seed.
FEATURES, WIDTH, SEED = 256, 1.0, 11
RIDGE = 1e-4
THRESHOLD = 0.3
#: One labelled document in so many calibrates instead of teaching.
CALIBRATION_PART = 5
#: Values of the regression are calibrated in bins this wide, from LOWEST to 1 - LOWEST.
BINS, LOWEST = 1024, -0.5
#: This share of a score is the regression's own value, which orders documents of one calibrated step.
OWN_SHARE = 0.01
UNIT = 1 << 16  # of a statistic
WAVE = 1 << 12  # of a feature

OTHER, LOWER, UPPER, DIGIT, WHITE, STOP, MARK = range(7)
#: Punctuation of running prose.
STOPS = ".,;:?'\"()-"

_classes: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    """Built once a worker process."""
    if not _classes:
        table = np.full(0x110000, OTHER, np.uint8)
        for point in range(0x110000):
            kind = unicodedata.category(chr(point))
            if kind[0] == "L":
                table[point] = UPPER if kind == "Lu" else LOWER
            elif kind[0] == "N":
                table[point] = DIGIT
            elif kind[0] in "PS":
                table[point] = MARK
            elif kind[0] == "Z":
                table[point] = WHITE
        table[0x09:0x0E] = WHITE
        table[[ord(c) for c in STOPS]] = STOP
        _classes.append(table)
    return _classes[0]


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each document's values; documents may have none."""
    total = np.concatenate([np.zeros(1), np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def _repeats(hashes: np.ndarray, first: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each document the weight of what has stood in it before, and the count of its most frequent entry."""
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((hashes, owner))
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    again = np.bincount(owner[order][same], weights[order][same], n)
    most = np.zeros(n)
    begin = np.flatnonzero(~same)
    np.maximum.at(most, owner[order][begin], np.diff(np.append(begin, len(hashes))))
    return again, most


def statistics(texts: list[str]) -> np.ndarray:
    """Documents by statistics, in whole units of 1 / UNIT."""
    block = Block(texts)
    points, n = block.points, len(texts)
    kinds = _class_table()[points]
    kinds[block.first[1:] - 1] = OTHER
    chars = np.diff(block.first) - 1
    per_char = 1.0 / np.maximum(chars, 1)
    count = {k: _sums(kinds == k, block.first) for k in (LOWER, UPPER, DIGIT, WHITE, STOP, MARK)}
    letters = np.maximum(count[LOWER] + count[UPPER], 1)
    begin, end = spans(points, SPACES)
    first = np.searchsorted(begin, block.first)
    words = np.diff(first)
    per_word = 1.0 / np.maximum(words, 1)
    hashes, size = span_hashes(points, begin, end), (end - begin).astype(float)
    inside = np.ones(len(begin), bool)  # not the first of its document
    inside[first[:-1][words > 0]] = False
    follows = np.zeros(len(begin), bool)
    follows[1:] = (hashes[1:] == hashes[:-1]) & inside[1:]
    skips = np.zeros(len(begin), bool)
    skips[2:] = (hashes[2:] == hashes[:-2]) & inside[2:] & inside[1:-1]
    totals = np.concatenate([np.zeros((1, 7), np.int64), np.cumsum(kinds[:, None] == np.arange(7), axis=0, dtype=np.int64)])
    of_word = totals[end] - totals[begin]
    loud = (of_word[:, UPPER] > 1) & (of_word[:, LOWER] == 0)
    wordy = of_word[:, LOWER] + of_word[:, UPPER] > 0.5 * size
    closed = kinds[end - 1] == MARK if len(end) else np.empty(0, bool)
    capital = kinds[begin] == UPPER if len(begin) else np.empty(0, bool)
    lone = (size == 1) & (of_word[:, MARK] == 1)
    again, most = _repeats(hashes, first, np.ones(len(hashes)))
    grams = combine(hashes, 3)
    whole = np.flatnonzero(first[np.searchsorted(first, np.arange(len(grams)), side="right")] >= np.arange(len(grams)) + 3)
    gram_first = np.searchsorted(whole, first)
    gram_again, _ = _repeats(grams[whole], gram_first, np.ones(len(whole)))
    breaks = np.flatnonzero(points == 0x0A)
    line_begin = np.concatenate([np.zeros(1, np.int64), breaks[:-1] + 1])
    line_first = np.searchsorted(line_begin, block.first)
    line_size = (breaks - line_begin).astype(float)
    line_again, _ = _repeats(span_hashes(points, line_begin, breaks), line_first, line_size)
    lines = np.diff(line_first)
    mean_size = _sums(size, first) * per_word
    table = [
        np.log1p(chars) / 4, np.log1p(words) / 4, np.log1p(chars / np.maximum(lines, 1)) / 4,
        *[count[k] * per_char for k in (LOWER, UPPER, DIGIT, WHITE, STOP, MARK)],
        count[UPPER] / letters,
        np.minimum(count[MARK] * per_word, 4), np.minimum(count[STOP] * per_word, 4),
        np.minimum(mean_size / 8, 4),
        np.minimum(np.sqrt(np.maximum(_sums(size**2, first) * per_word - mean_size**2, 0)) / 8, 4),
        *[_sums(x, first) * per_word for x in (follows, skips, loud, wordy, closed, capital, lone, size <= 3, size > 12)],
        again * per_word, most * per_word, again / np.sqrt(np.maximum(words, 1)) / 8,
        gram_again / np.maximum(np.diff(gram_first), 1), line_again * per_char,
        *[np.sqrt(_sums(points == ord(c), block.first) * per_char) for c in "|!#*%$&{}<>=\\_/"],
    ]
    return np.rint(np.array(table).T.reshape(n, len(table)) * UNIT).astype(np.int64)


class Waves:
    """Scaling of the statistics, and the random projections: products of features approximate the kernel."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int = FEATURES, width: float = WIDTH):
        self.mean = mean
        self.scale = np.where(deviation > 1e-6, 1.0 / np.maximum(deviation, 1e-6), 0.0)
        draw = np.random.default_rng(SEED)
        self.projections = draw.standard_normal((len(mean), features)) / (width * np.sqrt(max((self.scale > 0).sum(), 1)))
        self.phases = draw.uniform(0, 2 * np.pi, features)

    def features(self, found: np.ndarray) -> np.ndarray:
        """Whole numbers: cosines in units of 1 / WAVE, and a constant."""
        x = np.clip((found / UNIT - self.mean) * self.scale, -8, 8)
        # sums in one fixed order, so that no matrix routine's blocking shows in a rounded value
        angle = np.tile(self.phases, (len(x), 1))
        for k in range(x.shape[1]):
            angle += x[:, k : k + 1] * self.projections[k]
        return np.concatenate([np.rint(np.cos(angle) * WAVE), np.full((len(x), 1), float(WAVE))], axis=1)


def rising(total: np.ndarray, good: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to good / total, weighted by total (pooling adjacent violators)."""
    pools: list[list[float]] = []
    for n, g in zip(total.tolist(), good.tolist()):
        pools.append([n, g, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            n2, g2, k2 = pools.pop()
            pools[-1] = [pools[-1][0] + n2, pools[-1][1] + g2, pools[-1][2] + k2]
    return np.concatenate([np.full(int(k), g / n) for n, g, k in pools]) if pools else np.empty(0)


class Model:
    """A regression with its calibration; without ``waves`` every score is ``share``."""

    def __init__(self, share: float, waves: Waves | None = None, weights=None, at=None, curve=None):
        self.share, self.waves, self.weights, self.at, self.curve = share, waves, weights, at, curve

    def values(self, found: np.ndarray) -> np.ndarray:
        return (self.waves.features(found) / WAVE * self.weights).sum(1)

    def scores(self, found: np.ndarray) -> np.ndarray:
        if self.waves is None:
            return np.full(len(found), self.share)
        values = self.values(found)
        if not len(self.at):
            return np.clip(values, 0, 1)
        own = 0.5 + np.arctan(4 * (values - 0.5)) / np.pi
        return (1 - OWN_SHARE) * np.interp(values, self.at, self.curve) + OWN_SHARE * own


def _matrix(part: pa.RecordBatch, column: int) -> np.ndarray:
    values = part.column(column)
    return np.asarray(values.flatten()).reshape(len(values), -1) if len(values) else np.zeros((0, 0), np.int64)


def take_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns with ``stats``, an array of whole numbers."""

    def work(part, texts: list[str]):
        found = statistics(texts)
        offsets = np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]
        arrays = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))
        yield {k: part.column(i) for i, k in enumerate(keep)} | {"stats": arrays}

    return map_blocks(docs, keep, text, f"{kept_ddl(docs, keep)}, stats array<bigint>", work)


def _normal_equations(taught: DataFrame, waves: Waves) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all rows: features by features, and features by label. A task sends one row a feature."""
    shared = taught.sparkSession.sparkContext.broadcast(waves)
    width = len(waves.phases) + 1
    schema = "i int, sums array<bigint>"
    kinds = arrow_schema(schema)

    def run(batches):
        total = np.zeros((width, width + 1))  # whole numbers, exact below 2 ** 53
        some = False
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                z = shared.value.features(_matrix(part, 1))
                total[:, :width] += z.T @ z
                total[:, width] += z.T @ np.asarray(part.column(0), float)
                some = True
        if some:
            offsets = np.arange(width + 1, dtype=np.int32) * (width + 1)
            arrays = pa.ListArray.from_arrays(pa.array(offsets), pa.array(total.astype(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), arrays], schema=kinds)

    cells = taught.select("label", "stats").mapInArrow(run, schema).select("i", F.posexplode("sums").alias("j", "v"))
    rows = cells.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("double").alias("v")).collect()
    found = np.zeros((width, width + 1))
    for row in rows:
        found[row.i, row.j] = row.v
    return found[:, :width] / WAVE**2, found[:, width] / WAVE


def _calibration(held: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Places of the curve and its heights: one count a bin of values, whatever the number of rows."""
    shared = held.sparkSession.sparkContext.broadcast(model)
    schema = "bin int, n bigint, good bigint"
    kinds = arrow_schema(schema)

    def run(batches):
        n, good = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                place = (shared.value.values(_matrix(part, 1)) - LOWEST) / (1 - 2 * LOWEST) * BINS
                place = np.clip(place, 0, BINS - 1).astype(np.int64)
                n += np.bincount(place, minlength=BINS)
                good += np.bincount(place, np.asarray(part.column(0), float), BINS).astype(np.int64)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(good[some])], schema=kinds)

    counts = held.select("label", "stats").mapInArrow(run, schema).groupBy("bin").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    rows = sorted((r.bin, r.n, r.good) for r in counts.collect())
    if not rows:
        return np.empty(0), np.empty(0)
    bins, total, good = (np.array(x, float) for x in zip(*rows))
    return LOWEST + (bins + 0.5) / BINS * (1 - 2 * LOWEST), rising(total, good)


def fit(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality") -> Model:
    """``labels`` must hold only rows that may teach. ``stats`` is what ``take_statistics`` gave."""
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(quality).isNotNull()).groupBy(F.col(doc_id).alias("id"))
    label = known.agg(F.max(F.col(quality).cast("int")).alias("label"))
    rows = stats.select(F.col(doc_id).alias("id"), "stats").join(label, "id")
    part = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(CALIBRATION_PART))
    rows = staged(rows.select("label", "stats", (part == 0).alias("held")), "labelled-statistics")
    sums = rows.agg(F.count(F.lit(1)), F.sum("label"), F.count_if(~F.col("held"))).first()
    n, good, taught = sums[0], sums[1] or 0, sums[2]
    if not 0 < good < n or not taught:
        return Model(float(good) / n if n else 0.0)
    value = F.col("v").cast("decimal(38,0)")
    moments = rows.filter("NOT held").select(F.posexplode("stats").alias("k", "v")).groupBy("k")
    moments = sorted(moments.agg(F.sum(value), F.sum(value * value)).collect())
    mean = np.array([float(r[1]) for r in moments]) / taught / UNIT
    square = np.array([float(r[2]) for r in moments]) / taught / UNIT**2
    waves = Waves(mean, np.sqrt(np.maximum(square - mean**2, 0)))
    left, right = _normal_equations(rows.filter("NOT held"), waves)
    ridge = np.full(len(right), RIDGE * taught)
    ridge[-1] = 0.0  # the constant is free
    model = Model(good / n, waves, np.linalg.solve(left + np.diag(ridge), right))
    model.at, model.curve = _calibration(rows.filter("held"), model)
    return model


def score(stats: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The kept columns with score and predicted, from statistics alone."""
    shared = stats.sparkSession.sparkContext.broadcast(model)
    schema = f"{kept_ddl(stats, keep)}, score double, predicted int"
    kinds = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                values = np.clip(shared.value.scores(_matrix(part, len(keep))), 0.0, 1.0)
                arrays = [part.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(values), pa.array((values >= THRESHOLD).astype(np.int32))], schema=kinds)

    return stats.select(*keep, "stats").mapInArrow(run, schema)
