"""Union over conflicting schemas, sketches, covariance in one scan, and the checker hook."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmill.operators import metrics, pairs, rollouts
from pairmill.sources.lattice import least_common, union_conflicting


@pytest.mark.parametrize(
    "a, b, wanted",
    [
        ("int", "bigint", "bigint"), ("bigint", "double", "double"), ("float", "int", "double"), ("decimal(5,2)", "int", "decimal(12,2)"),
        ("decimal(38,20)", "bigint", "double"), ("decimal(38,10)", "bigint", "decimal(38,10)"), ("date", "timestamp", "timestamp"), ("void", "string", "string"), ("string", "int", "variant"),
        ("string", "struct<a:int>", "variant"), ("array<int>", "array<double>", "array<double>"), ("array<int>", "string", "variant"),
        ("struct<a:int,b:string>", "struct<b:int,c:date>", "struct<a:int,b:variant,c:date>"), ("map<string,int>", "map<string,bigint>", "map<string,bigint>"),
        ("boolean", "int", "variant"), ("array<string>", "array<struct<a:int>>", "array<variant>"),
    ],
)
def test_least_common_type(spark, a, b, wanted):
    kind = lambda s: T.StructType.fromDDL(f"x {s}")[0].dataType
    assert least_common(kind(a), kind(b)) == kind(wanted)


def test_union_keeps_values(spark):
    parts = [
        spark.createDataFrame([(1, "x", (1, "p")), (2, None, None)], "id int, v string, s struct<a:int,b:string>"),
        spark.createDataFrame([(3, [("k", 1.5)], (2.5, datetime.date(2024, 1, 2)))], "id bigint, v array<struct<n:string,m:double>>, s struct<a:double,c:date>"),
        spark.createDataFrame([(4,), (4,)], "id int"),
        spark.createDataFrame([], "id int, `odd.name` int"),
    ]
    with pytest.raises(Exception):
        parts[0].unionByName(parts[1], allowMissingColumns=True).collect()
    made = union_conflicting(parts)
    assert made.columns == ["id", "v", "s", "odd.name"] and made.schema["id"].dataType == T.LongType()
    rows = {r.id: r for r in made.select("id", F.to_json("v").alias("v"), "s").collect()}
    assert (rows[1].v, rows[2].v, rows[3].v, rows[4].v) == ('"x"', None, '[{"m":1.5,"n":"k"}]', None)
    assert tuple(rows[1].s) == (1.0, "p", None) and tuple(rows[3].s) == (2.5, None, datetime.date(2024, 1, 2)) and rows[2].s is None
    assert made.count() == 5


def test_covariance_in_one_scan(spark):
    draw = np.random.default_rng(2)
    batches = {"a": draw.normal(5, 1, (700, 12)), None: draw.normal(-1e4, 2, (400, 12)), "c": draw.normal(size=(3, 12)), "d": draw.normal(size=(1, 12))}
    rows = [(k, v.tolist()) for k, own in batches.items() for v in own]
    df = spark.createDataFrame(rows, "b string, v array<double>").repartition(7)
    found = {r.b: r.spectral_loss for r in pairs.spectral_loss(df, "b", "v", block_rows=100).collect()}
    for key, own in batches.items():
        cov = np.cov(own.T) if len(own) > 1 else np.zeros((12, 12))
        assert found[key] == pytest.approx((cov**2).sum() / 132 - (np.diag(cov) ** 2).sum() / 132, rel=1e-7, abs=1e-12)


def test_sketches_merge_within_their_bound(spark):
    df = spark.range(60_000).select(
        F.lit("d").alias("domain"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), (F.col("id") / 500).cast("int").alias("chunk_id"),
        F.array_repeat(F.lit(0), (F.pmod(F.xxhash64("id"), F.lit(1000)) + 1).cast("int")).alias("input_tokens"),
    ).withColumn("response_tokens", F.slice("input_tokens", 1, 7))
    manifest = metrics.sketched_manifest(df)
    found = metrics.length_quantiles(manifest, ["domain"], 0.01, 0.5, 0.99).first()
    sizes = np.sort([r[0] for r in df.select(F.size("input_tokens")).collect()])
    for share, value in ((0.01, found.prompt_lengths_10), (0.5, found.prompt_lengths_500), (0.99, found.prompt_lengths_990)):
        low, high = np.searchsorted(sizes, value, "left") / len(sizes), np.searchsorted(sizes, value, "right") / len(sizes)
        assert low - metrics.SKETCH_ERROR <= share <= high + metrics.SKETCH_ERROR
    assert found.n_rows == 60_000 and found.response_lengths_500 == 7


def test_checker_failures_stay_with_their_text(spark):
    def checker(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return ["x" in t for t in texts]

    rows = [(k, t) for k, t in enumerate(["x", "bad", None, "", "yx", "bad"])]
    checked = rollouts.check_candidates(spark.createDataFrame(rows, "k int, code string").coalesce(1), checker)
    good, broken = rollouts.quarantine_unchecked(checked)
    assert {r.k: r.ok for r in good.collect()} == {0: True, 2: False, 3: False, 4: True}
    assert {(r.k, r.error) for r in broken.collect()} == {(1, "RuntimeError: no"), (5, "RuntimeError: no")}
    short = rollouts.check_candidates(spark.createDataFrame(rows, "k int, code string"), lambda texts: [])
    assert short.where("error IS NULL").count() == 1  # the text that was never sent
