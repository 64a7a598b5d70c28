"""The quality classifier: its parts against plain computations, held-out accuracy, awkward rows."""

import random

import numpy as np
import pytest

from pairmill.llm import quality, queries


def test_features_approximate_the_kernel():
    draw = np.random.default_rng(0)
    waves = quality.Waves(np.zeros(6), np.ones(6), features=20_000, width=1.0)
    x = draw.normal(size=(8, 6))
    z = waves.features((x * quality.UNIT).round())[:, :-1] / quality.WAVE
    near = 2 * z @ z.T / z.shape[1]
    true = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * 6))
    assert np.abs(near - true).max() < 0.03


def test_rising_is_the_best_non_decreasing_fit():
    draw = random.Random(1)
    for _ in range(300):
        n = np.array([draw.randint(1, 5) for _ in range(draw.randint(1, 8))], float)
        good = np.array([draw.randint(0, int(k)) for k in n], float)
        # the closed form: the greatest over beginnings of the least over ends of the mean between them
        mean = lambda a, b: good[a : b + 1].sum() / n[a : b + 1].sum()
        best = [max(min(mean(a, b) for b in range(k, len(n))) for a in range(k + 1)) for k in range(len(n))]
        assert np.allclose(quality.rising(n, good), best)
    assert len(quality.rising(np.empty(0), np.empty(0))) == 0


def test_statistics_do_not_depend_on_neighbours():
    texts = ["", "a", "La la la LA!! | x\nx x\nx x", "é 中文   9", " \n ", "the " * 50, "###$$ %%%", "a b c a b c a b c"]
    together = quality.statistics(texts)
    assert (together == np.concatenate([quality.statistics([t]) for t in texts])).all()
    assert not together[0].any() and together.shape[1] > 30


def _tables(spark, root, n=600):
    draw, words = random.Random(5), "the of and house water green small walked river under light".split()
    rows, labels = [], []
    for k in range(n):
        line = [draw.choice(words) for _ in range(draw.randint(20, 80))]
        good = draw.random() < 0.6
        if not good:
            line = [[line[0]] * len(line), [w + "%%%" for w in line], [w.upper() + "!!" for w in line]][k % 3]
        rows.append((k, " ".join(line)))
        if k % 2:
            labels.append((k, int(good)))
    truth = dict(labels)
    rows += [(2000, None), (2001, ""), (None, "the house"), (1, rows[1][1]), (2002, "word " * 200_000)]
    labels += [(1, 0), (None, 1), (3, None), (9999, 1)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, stats int, `__text` int")
    docs.repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(f"{root}/labels.parquet")
    return rows, truth


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("quality"))
    return root, *_tables(spark, root)


def test_query_learns_and_keeps_every_row(spark, tables):
    root, rows, truth = tables
    found = queries.quality_scores(spark, root).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert len(held) > 30 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_model_is_the_same_however_rows_are_dealt(spark, tables):
    root, _, _ = tables
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    models = [quality.fit(quality.take_statistics(docs.repartition(n), ["doc_id"]), labels) for n in (1, 7)]
    assert (models[0].weights == models[1].weights).all() and (models[0].curve == models[1].curve).all()


def test_few_or_no_labels(spark, tables):
    root, _, _ = tables
    stats = quality.take_statistics(spark.read.parquet(f"{root}/documents.parquet"), ["doc_id"])
    for labels, share in [([], 0.0), ([(5, 1), (6, 1)], 1.0), ([(5, 0)], 0.0), ([(None, 1)], 0.0)]:
        model = quality.fit(stats, spark.createDataFrame(labels, "doc_id bigint, quality int"))
        assert {r.score for r in quality.score(stats, model, ["doc_id"]).collect()} == {share}
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    none = quality.take_statistics(empty, ["doc_id"])
    model = quality.fit(none, spark.createDataFrame([(1, 1)], "doc_id bigint, quality int"))
    assert quality.score(none, model, ["doc_id"]).collect() == []
