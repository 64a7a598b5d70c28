"""A toxicity classifier that is regularised by counterfactuals.

A text is the set of its words and word beginnings. From a bounded sample of labelled rows Spark counts
each feature in both classes; the most telling ones become the model, a logistic regression. In the
labelled sentences every identity term is swapped for others of its group, and the squared change of the
score is part of the loss, so naming a group does not move it.

Cases: a null or empty text scores the intercept alone; rows without a label, and labels without a row,
teach nothing; of several labels of one id the largest counts; equal texts teach once; without any
labelled row, or with one class only, every score is the share of toxic labels (0.0 without labels).
Repeated rows each get their row; further columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmill.llm.textblock import NON_ALNUM, Block, Words, kept_ddl, map_texts, mix, span_hashes

#: At most so many labelled rows teach; those with the least hash of the id.
TRAINING_ROWS = 12_000
FEATURES = 4096
LEAST_TEXTS, LEAST_Z = 4, 3.0
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.7
#: Weight of the counterfactual penalty and of the squared weights.
COUNTERFACTUAL, RIDGE = 1.0, 1e-5
STEPS, RATE = 600, 0.1
#: Identity terms by group; a term is swapped for the others of its group.
IDENTITY_TERMS = {
    "faith": ["christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic"],
    "faiths": ["christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics"],
    "origin": ["african", "asian", "european", "american", "mexican", "chinese", "indian", "arab", "turkish", "polish"],
    "colour": ["black", "white", "brown"],
    "gender": ["women", "men"],
    "person": ["woman", "man"],
    "orientation": ["gay", "lesbian", "bisexual", "straight", "heterosexual", "homosexual"],
    "status": ["immigrant", "refugee", "citizen", "foreigner"],
    "ability": ["disabled", "blind", "deaf", "autistic"],
    "age": ["elderly", "young", "old"],
}

_GROUP_OF = {term: group for group in IDENTITY_TERMS.values() for term in group}
_SENTENCE = re.compile(r"[^.!?\n]+")
_TERM = re.compile(r"\b(?:" + "|".join(sorted(_GROUP_OF, key=len, reverse=True)) + r")\b", re.I)


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: hashes, and the text of each. A feature may stand twice in a text."""
    block = Block(texts)
    words = Words(block, NON_ALNUM)
    owners = np.repeat(np.arange(len(texts)), words.counts())
    out = [(mix(words.hashes ^ np.uint64(1)), owners)]
    points, length = block.lowered(), words.end - words.begin
    for n in BEGINNINGS:
        some = length > n
        out.append((span_hashes(points, words.begin[some], words.begin[some] + n), owners[some]))
    return out


def _distinct(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    found = features(texts)
    hashes, owners = np.concatenate([h for h, _ in found]), np.concatenate([o for _, o in found])
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    if len(hashes):
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])])
        hashes, owners = hashes[new], owners[new]
    return hashes, owners


def _known(texts: list[str], names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and place in the sorted ``names`` of each known feature, once a text, by text."""
    pairs = []
    for hashes, owners in features(texts):
        place = np.minimum(np.searchsorted(names, hashes), max(len(names) - 1, 0))
        hit = names[place] == hashes if len(names) else np.zeros(len(hashes), bool)
        pairs.append(owners[hit] * max(len(names), 1) + place[hit])
    both = np.unique(np.concatenate(pairs))
    return both // max(len(names), 1), both % max(len(names), 1)


def _term_features() -> dict[str, set[int]]:
    terms = sorted(_GROUP_OF)
    hashes, owners = _distinct(terms)
    return {term: set(hashes[owners == k].tolist()) for k, term in enumerate(terms)}


def swaps(text: str, names: np.ndarray) -> Counter:
    """How many sentences change by each swap: known features lost and gained, when one term stands for another.

    Sentences that name a group are read as counted features. To swap a term takes away those of its
    features that nothing else in the sentence has, and adds those of the other that it lacks; a sentence has
    at most one swap for each two terms of a group, however long it is.
    """
    out = Counter()
    sentences = [s for s in _SENTENCE.findall(text) if _TERM.search(s)]
    if not sentences:
        return out
    found = features(sentences)
    hashes, owners = np.concatenate([h for h, _ in found]), np.concatenate([o for _, o in found])
    order = np.argsort(owners, kind="stable")
    cuts = np.searchsorted(owners[order], np.arange(len(sentences) + 1))
    of_term, known = _term_features(), {int(h): k for k, h in enumerate(names)}
    for k, sentence in enumerate(sentences):
        counted = dict(zip(*(x.tolist() for x in np.unique(hashes[order[cuts[k] : cuts[k + 1]]], return_counts=True))))
        for term in {t.lower() for t in _TERM.findall(sentence)} & _GROUP_OF.keys():
            once = {f for f in of_term[term] if counted.get(f) == 1}
            for other in _GROUP_OF[term]:
                if other != term:
                    lost = tuple(sorted(known[f] for f in once - of_term[other] if f in known))
                    gained = tuple(sorted(known[f] for f in of_term[other] if f in known and f not in counted))
                    if lost or gained:
                        out[lost, gained] += 1
    return out


class Model:
    def __init__(self, names: np.ndarray, weights: np.ndarray, intercept: float):
        self.names, self.weights, self.intercept = names, weights, intercept

    def scores(self, texts: list[str]) -> np.ndarray:
        owner, place = _known(texts, self.names)
        z = np.bincount(owner, self.weights[place] if len(place) else None, len(texts)) + self.intercept
        return 1.0 / (1.0 + np.exp(-z))


def regress(rows: list[np.ndarray], labels: np.ndarray, pairs: dict[tuple[tuple, tuple], int], width: int, penalty: float) -> tuple[np.ndarray, float]:
    """Weights and intercept by full-batch gradient steps with momentum and per-weight scale.

    ``pairs`` counts the sentences of each swap, as features lost and gained.
    """
    sizes = np.array([len(r) for r in rows])
    columns, owners = np.concatenate(rows).astype(np.int64), np.repeat(np.arange(len(rows)), sizes)
    changes = sorted(pairs)
    pair_columns = np.array([c for lost, gained in changes for c in (*lost, *gained)], np.int64)
    pair_owner = np.repeat(np.arange(len(changes)), [len(a) + len(b) for a, b in changes]) if changes else np.empty(0, np.int64)
    sign = np.array([x for lost, gained in changes for x in (*[1.0] * len(lost), *[-1.0] * len(gained))])
    often = np.array([float(pairs[c]) for c in changes])
    share = labels.mean()
    w, b = np.zeros(width), np.log(share / (1 - share))
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(owners, w[columns], len(rows)) + b
        error = (1.0 / (1.0 + np.exp(-z)) - labels) / len(rows)
        slope = np.append(np.bincount(columns, error[owners], width) + 2 * RIDGE * w, error.sum())
        if pairs:
            change = np.bincount(pair_owner, w[pair_columns] * sign, len(changes)) * often
            slope[:width] += 2 * penalty / often.sum() * np.bincount(pair_columns, change[pair_owner] * sign, width)
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:width], b - move[width]
    return w, float(b)


def _telling(sample: DataFrame, texts: int, toxic: int) -> np.ndarray:
    """Sorted hashes of the features whose log odds differ most, in standard errors."""
    schema = "feature bigint, pos bigint, neg bigint"

    def work(part, found):
        hashes, owners = _distinct(found)
        labels = np.array(part.column(0).to_pylist(), np.int64)[owners]
        names, place = np.unique(hashes, return_inverse=True)
        pos = np.bincount(place, labels, len(names)).astype(np.int64)
        yield {"feature": names.view(np.int64), "pos": pos, "neg": np.bincount(place, minlength=len(names)) - pos}

    counts = map_texts(sample, ["toxic"], "text", schema, work, 4 << 20).groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = f"ln((pos + 0.5) / ({toxic} - pos + 0.5)) - ln((neg + 0.5) / ({texts - toxic} - neg + 0.5))"
    z = F.expr(f"abs({odds}) / sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))")
    best = counts.filter(F.col("pos") + F.col("neg") >= LEAST_TEXTS).withColumn("z", z).filter(F.col("z") >= LEAST_Z)
    rows = best.orderBy(F.desc("z"), "feature").limit(FEATURES).select("feature").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", rows: int = TRAINING_ROWS, penalty: float = COUNTERFACTUAL) -> Model:
    """``labels`` must hold only rows that may teach. At most ``rows`` of them reach the tasks or the driver."""
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(toxic).isNotNull()).groupBy(F.col(doc_id).alias("doc_id"))
    taught = known.agg(F.max(F.col(toxic).cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(taught), "doc_id")
    sample = texts.groupBy(F.xxhash64("text").alias("same"), "text").agg(F.max("toxic").alias("toxic")).select("toxic", "text")
    sums = sample.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    n, bad = sums[0], sums[1] or 0
    if not 0 < bad < n:
        share = np.clip(bad / n if n else 0.0, 1e-12, 1 - 1e-12)
        return Model(np.empty(0, np.uint64), np.empty(0), float(np.log(share / (1 - share))))
    names = _telling(sample, n, bad)
    shared = docs.sparkSession.sparkContext.broadcast(names)
    schema = "toxic int, places array<int>"
    swap_schema = "lost array<int>, gained array<int>, often bigint"

    def known(part, found):
        owner, place = _known(found, shared.value)
        cuts = np.searchsorted(owner, np.arange(len(found) + 1))
        yield {"toxic": part.column(0), "places": [place[a:b] for a, b in zip(cuts, cuts[1:])]}

    def swap(part, found):
        total = Counter()
        for one in found:
            total.update(swaps(one, shared.value))
        yield {"lost": [list(a) for a, _ in total], "gained": [list(b) for _, b in total], "often": list(total.values())}

    data = map_texts(sample, ["toxic"], "text", schema, known).collect()
    # as many rows as two terms of a group can differ by: a table of the terms, not of the texts
    changes = map_texts(sample, ["toxic"], "text", swap_schema, swap).groupBy("lost", "gained").agg(F.sum("often").alias("often")).collect()
    pairs = {(tuple(r.lost), tuple(r.gained)): r.often for r in changes}
    order = sorted(range(len(data)), key=lambda k: (data[k].places, data[k].toxic))
    rows = [np.array(data[k].places, int) for k in order]
    weights, intercept = regress(rows, np.array([float(data[k].toxic) for k in order]), pairs, len(names), penalty)
    return Model(names, weights, intercept)


def score(df: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns with score and predicted."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = kept_ddl(df, keep)

    def work(part, texts):
        values = shared.value.scores(texts)
        yield {k: part.column(i) for i, k in enumerate(keep)} | {"score": values, "predicted": (values >= THRESHOLD).astype(np.int32)}

    return map_texts(df, keep, text, f"{kept}, score double, predicted int", work)
