"""Periodic runs of words: Lyndon roots by Baier's grouping of suffixes, extended to whole runs.

A run is a stretch of words with a smallest period that no neighbouring word continues. Every run has a
Lyndon root that is the longest Lyndon word at its place under one of the two orders of the words, so the
Lyndon arrays under both orders hold a root of each run. The first phase of Baier's suffix sorter yields
such an array directly: it groups suffixes by a common prefix, takes the groups from the greatest down, and
lengthens the prefix of the nearest earlier suffix in a lower group by that of the group at hand; what a
suffix's prefix is when its group is taken is its longest Lyndon word.

Grouping takes some microseconds a word, so it is given only the stretches where a run can be. A run of
at least three periods and of at least 24 words repeats, at the distance of its period and for two periods,
every gram of a length between one and two periods (16 for periods up to 16). Grams of 16, 32, 64 .. words
are sorted by hash; neighbours at a fitting distance mark all words from the one to the other's end. A
longer gram repeats only where its beginning does, so each length looks only at what the one before left.
This drops no run, whatever its length. Runs are confirmed word by word.

Cases: a null text is empty and has no run; repeated rows each get their row; texts of any length are taken
whole, as one block; ties (one exponent, one root under both orders) are told apart as documented; an empty
table gives an empty result; further columns are not read. A word is known by a 64-bit hash.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from pairmill.llm.textblock import SPACES, Block, kept_ddl, map_blocks, mix, span_hashes, spans

LEAST_WORDS, LEAST_EXPONENT = 24, 3
GRAM = 16

_BASE = 0xD1342543DE82EF95
_powers: dict[int, np.ndarray] = {}


def lyndon_lengths(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each place, by grouping suffixes (phase one of Baier's sorter).

    Groups are intervals of ``order``; ``start`` is a suffix's interval, ``size`` and ``prefix`` belong to
    intervals. Suffixes whose prefix grows move to the upper end of their interval, which is then parted.
    """
    n = len(ranks)
    order = sorted(range(n), key=ranks.__getitem__)
    place, start, size, prefix = [0] * n, [0] * n, [0] * n, [1] * n
    begin = 0
    for k, suffix in enumerate(order):
        if k and ranks[suffix] != ranks[order[k - 1]]:
            begin = k
        place[suffix], start[suffix] = k, begin
        size[begin] += 1
    lengths, lower = [0] * n, [-1] * n
    end = n
    while end:
        group = start[order[end - 1]]
        members = order[group:end]
        if len(members) > 1:
            members.sort()
        grown = prefix[group]
        nearest = []
        for suffix in members:
            lengths[suffix] = grown
            p = suffix - 1
            while p >= 0 and start[p] >= group:
                p = lower[p]
            lower[suffix] = p
            if p >= 0:
                nearest.append(p)
        end = group
        if not nearest:
            continue
        by_interval: dict[int, list[tuple[int, int]]] = {}
        for p, times in Counter(nearest).items():
            by_interval.setdefault(start[p], []).append((times, p))
        for interval, moved in by_interval.items():
            old, upper = prefix[interval], interval + size[interval]
            moved.sort(reverse=True)
            k, total = 0, len(moved)
            while k < total:
                times, top = moved[k][0], upper
                first = k
                while k < total and moved[k][0] == times:
                    p = moved[k][1]
                    upper -= 1
                    other, at = order[upper], place[p]
                    order[at], place[other] = other, at
                    order[upper], place[p] = p, upper
                    k += 1
                for _, p in moved[first:k]:
                    start[p] = upper
                size[upper], prefix[upper] = top - upper, old + times * grown
            if upper > interval:
                size[interval] = upper - interval
    return lengths


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


class Grams:
    """Hashes of any slices of a sequence of 64-bit words, by prefix sums."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(words) * _power(_BASE, n), out=self.sums[1:])
        self.down = _power(pow(_BASE, -1, 1 << 64), n + 1)

    def at(self, begin: np.ndarray, width) -> np.ndarray:
        return (self.sums[begin + width] - self.sums[begin]) * self.down[begin]


def stretches(words: np.ndarray, first: np.ndarray, grams: Grams) -> list[tuple[int, int, int]]:
    """(document, begin, end) of the parts of documents outside of which no run can be."""
    sizes = np.diff(first)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    last = first[1:][owner]
    salt = mix(np.arange(len(sizes), dtype=np.uint64) + np.uint64(1))
    alive = np.flatnonzero(sizes[owner] >= LEAST_WORDS)
    marks, width = np.zeros(len(words) + 1, np.int64), GRAM
    while True:
        alive = alive[alive + width <= last[alive]]
        if len(alive) < 2:
            break
        codes = grams.at(alive, width) ^ salt[owner[alive]]
        by_code = np.argsort(codes, kind="stable")
        codes, alive = codes[by_code], alive[by_code]
        same = codes[1:] == codes[:-1]
        a, b = alive[:-1][same], alive[1:][same]
        fits = (b - a <= width) & (owner[a] == owner[b])
        if width > GRAM:
            fits &= b - a > width // 2
        np.add.at(marks, a[fits], 1)
        np.add.at(marks, b[fits] + width, -1)
        twice = np.zeros(len(alive), bool)
        twice[:-1] |= same
        twice[1:] |= same
        alive = np.sort(alive[twice])
        width *= 2
    marked = np.zeros(len(words) + 2, bool)
    marked[1:-1] = np.cumsum(marks[:-1]) > 0
    inner = np.zeros(len(words) + 2, bool)  # words that go on a document
    inner[1:-1] = True
    inner[first[:-1][sizes > 0] + 1] = False
    inner[-1] = False
    begins = np.flatnonzero(marked[1:-1] & ~(marked[:-2] & inner[1:-1]))
    ends = np.flatnonzero(marked[1:-1] & ~(marked[2:] & inner[2:])) + 1
    return [(int(owner[a]), int(a), int(b)) for a, b in zip(begins, ends) if b - a >= LEAST_WORDS]


def _longest(grams: Grams, place: np.ndarray, period: np.ndarray, most: np.ndarray, backwards: bool) -> np.ndarray:
    """How many words from ``place`` on (or before it) equal those one period later, by bisection."""
    low, high = np.zeros(len(place), np.int64), most.copy()
    while (low < high).any():
        half = (low + high + 1) // 2
        begin = place - half if backwards else place
        equal = grams.at(begin, half) == grams.at(begin + period, half)
        low, high = np.where(equal, half, low), np.where(equal, high, half - 1)
    return low


def _whole(words: np.ndarray, begin: int, end: int, place: int, period: int) -> tuple[int, int]:
    """The maximal stretch of this period around ``place`` of a document, word by word."""
    differ = np.flatnonzero(words[begin : end - period] != words[begin + period : end]) + begin
    k = int(np.searchsorted(differ, place))
    low = int(differ[k - 1]) + 1 if k else begin
    high = int(differ[k]) if k < len(differ) else end - period
    return low, high + period


def runs_of(words: np.ndarray, first: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each document, by start and period.

    ``words`` holds the documents' words one after the other, ``first`` where each begins, and its end.
    """
    found: list[set[tuple[int, int, int]]] = [set() for _ in range(len(first) - 1)]
    if not len(words):
        return [[] for _ in found]
    grams = Grams(words)
    for document, a, b in stretches(words, first, grams):
        begin, end = int(first[document]), int(first[document + 1])
        ranks = np.unique(words[a:b], return_inverse=True)[1]
        for order in (ranks, ranks.max() - ranks):
            period = np.array(lyndon_lengths(order.tolist()), np.int64)
            place = np.flatnonzero(np.arange(len(period)) + 2 * period <= len(period))
            square = grams.at(a + place, period[place]) == grams.at(a + place + period[place], period[place])
            place = place[square]
            root = np.zeros(len(period), np.int64)
            root[place] = period[place]
            earlier = place - period[place]  # of the roots of one run the first is enough
            place = place[(earlier < 0) | (root[np.maximum(earlier, 0)] != period[place])]
            period, place = period[place], place + a
            right = _longest(grams, place, period, end - place - period, False)
            left = _longest(grams, place, period, place - begin, True)
            length = left + period + right
            keep = length >= np.maximum(LEAST_WORDS, LEAST_EXPONENT * period)
            for at, p, low, n in zip(place[keep].tolist(), period[keep].tolist(), (place - left)[keep].tolist(), length[keep].tolist()):
                if (low - begin, n, p) in found[document]:
                    continue
                exact = _whole(words, max(low - 1, begin), min(low + n + 1, end), at, p)
                if exact != (low, low + n):  # two hashes met: look at the whole document
                    low, high = _whole(words, begin, end, at, p)
                    n = high - low
                    if n < max(LEAST_WORDS, LEAST_EXPONENT * p):
                        continue
                found[document].add((low - begin, n, p))
    return [sorted(r, key=lambda run: (run[0], run[2])) for r in found]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest exact length by period; of equal ones the first, then the one of the least period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed_texts(block: Block, begin: np.ndarray, end: np.ndarray, first: np.ndarray, runs: list[list[tuple[int, int, int]]]) -> list[str]:
    """Each text with one space between words, and of each run only its first period."""
    drops = np.zeros(len(begin) + 1, np.int64)
    for at, own in zip(first[:-1], runs):
        for start, length, period in own:
            drops[at + start + period] += 1
            drops[at + start + length] -= 1
    keep = np.cumsum(drops[:-1]) == 0
    points = block.points.copy()
    points[end] = 0x20  # what ends a word is white space or the line feed that ends a text
    steps = np.zeros(len(points) + 2, np.int8)
    steps[begin[keep]] += 1
    steps[end[keep] + 1] -= 1
    taken = np.cumsum(steps[:-2], dtype=np.int8) > 0
    line = points[taken].tobytes().decode("utf-32-le", "surrogatepass")
    cuts = np.concatenate([np.zeros(1, np.int64), np.cumsum(taken)])[block.first]
    return [line[a : b - 1] if b > a else "" for a, b in zip(cuts.tolist(), cuts[1:].tolist())]


def find_runs(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns with n_words, all runs, the strongest run (null if none) and the collapsed text."""
    run = "struct<start:bigint,length:bigint,period:bigint>"
    schema = f"{kept_ddl(df, keep)}, n_words bigint, runs array<{run}>, strongest {run}, collapsed string"
    names = ("start", "length", "period")

    def work(part, texts: list[str]):
        block = Block(texts)
        begin, end = spans(block.points, SPACES)
        first = np.searchsorted(begin, block.first)
        found = runs_of(span_hashes(block.points, begin, end), first)
        best = [strongest(r) for r in found]
        yield {k: part.column(i) for i, k in enumerate(keep)} | {
            "n_words": np.diff(first),
            "runs": [[dict(zip(names, x)) for x in r] for r in found],
            "strongest": [dict(zip(names, x)) if x else None for x in best],
            "collapsed": collapsed_texts(block, begin, end, first, found),
        }

    return map_blocks(df, keep, text, schema, work)
