"""Periodic runs against brute force: the Lyndon arrays, the runs, and the whole query."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from pairmill.llm import queries, runs


def longest_lyndon(s):
    out = []
    for i in range(len(s)):
        j = i + 1
        while j < len(s) and s[j:] > s[i:]:  # up to the next smaller suffix
            j += 1
        out.append(j - i)
    return out


def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            part = words[i : j + q]
            if len(part) >= max(24, 3 * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.append((i, len(part), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def drawn_words(draw, most):
    out = []
    while len(out) < draw.randint(0, most):
        if draw.random() < 0.5:
            base = [draw.randrange(draw.randint(1, 5)) for _ in range(draw.randint(1, 40))]
            if draw.random() < 0.4:
                base = (base[: draw.randint(1, 3)] * 40)[: len(base)]  # runs within runs
            out += (base * 8)[: draw.randint(len(base), 6 * len(base) + 1)]
        else:
            out += [draw.randrange(50) for _ in range(draw.randint(1, 20))]
    return out


def test_lyndon_arrays():
    draw = random.Random(1)
    for _ in range(1500):
        s = [draw.randrange(draw.randint(1, 4)) for _ in range(draw.randint(1, 24))]
        if draw.random() < 0.4:
            s = (s[: draw.randint(1, 5)] * 30)[: len(s)]
        assert runs.lyndon_lengths(s) == longest_lyndon(s)
        top = max(s)
        assert runs.lyndon_lengths([top - x for x in s]) == longest_lyndon([top - x for x in s])


def test_runs_of_several_documents():
    draw, found = random.Random(2), 0
    for _ in range(400):
        docs = [drawn_words(draw, 200) for _ in range(draw.randint(1, 4))]
        first = np.cumsum([0, *map(len, docs)])
        expected = [brute_runs(d) for d in docs]
        assert runs.runs_of(np.array(sum(docs, []), np.uint64), first) == expected
        found += sum(map(len, expected))
    assert found > 500


def test_long_periods_and_edges():
    draw = random.Random(3)
    line = [draw.getrandbits(60) for _ in range(5000)]
    words = np.array([7] + line * 3 + [8], np.uint64)
    assert runs.runs_of(words, np.array([0, len(words)])) == [[(1, 15000, 5000)]]
    assert runs.runs_of(words[:-2], np.array([0, len(words) - 2])) == [[]]  # one word short of three periods
    assert runs.runs_of(np.full(23, 5, np.uint64), np.array([0, 23])) == [[]]
    assert runs.runs_of(np.full(48, 5, np.uint64), np.array([0, 24, 24, 48])) == [[(0, 24, 1)], [], [(0, 24, 1)]]
    assert runs.runs_of(np.empty(0, np.uint64), np.array([0, 0])) == [[]]


def test_strongest_run():
    assert runs.strongest([(0, 24, 1), (5, 48, 2), (9, 30, 3)]) == (0, 24, 1)
    assert runs.strongest([(0, 29, 3), (5, 49, 5)]) == (5, 49, 5)  # 9.67 against 9.8
    assert runs.strongest([]) is None


def expected_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if found else (None,) * 3
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *best, best[1] * 1000 // best[2] if found else None, sha(lines), sha(kept))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root, draw = tmp_path_factory.mktemp("runs"), random.Random(4)
    names = ["La", "la", "é", "中文", "x y", "😀", "a\tb", "q."]
    rows = [(k, draw.choice([" ", "  \n", "\x0b"]).join(names[x % 8] + str(x // 8 or "") for x in drawn_words(draw, 150))) for k in range(400)]
    rows += [(400, None), (401, ""), (402, " \n\t "), (3, rows[3][1]), (5, "la " * 30), (None, "x " * 24), (None, None), (403, "  " * 24), (404, " x" * 50_000)]
    df = spark.createDataFrame([(i, t, "s", True, "z") for i, t in rows], "doc_id bigint, text string, `__text` string, runs boolean, `a.b` string")
    df.repartition(3).write.parquet(f"{root}/documents.parquet")
    return str(root), rows


def test_query_against_brute_force(spark, tables):
    root, rows = tables
    order = lambda r: tuple((x is not None, x) for x in r)
    found = sorted((tuple(r) for r in queries.periodic_runs(spark, root).collect()), key=order)
    small = [r for r in rows if r[0] != 404]
    assert [r for r in found if r[0] != 404] == sorted((expected_row(*r) for r in small), key=order)
    assert [r[1:6] for r in found if r[0] == 404] == [(1, 0, 50_000, 1, 50_000_000)]
    assert sum(r[1] > 0 for r in found) > 150


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, n_words int")
    assert runs.find_runs(empty, ["doc_id"]).collect() == []
