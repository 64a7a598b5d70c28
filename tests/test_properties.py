"""Laws that hold for every input, checked on whole tables and on made rows."""

import math

import numpy as np
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pairmill.functions import arrays, schedules, text
from pairmill.operators import conversations, feed, metrics, numbering, pairs, rollouts, tokens
from pairmill.operators.normalize import fold_conversation_v2
from pairmill.registry.base import table, token_lengths


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def test_halves_join_to_the_text(docs):
    halves = docs.select("text", text.split_mid(F.col("text")).alias("h"))
    assert halves.where("length(text) > 10 AND concat(h.prompt, h.response) <> text").count() == 0
    broken = docs.select("text", text.split_break(F.col("text")).alias("h")).where("h IS NOT NULL")
    bare = lambda c: F.regexp_replace(c, r"\s", "")
    same = bare(F.concat("h.prompt", "h.response")) == bare(F.col("text"))
    assert broken.where(~same).count() == 0


def test_strip_equals_python(spark):
    samples = ["", " a ", "　x ", "\x1c\x1dq\x85", "a​b​", "  l  ", "\t\r\n"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    assert [r.o for r in df.select(text.strip(F.col("s")).alias("o")).collect()] == [s.strip() for s in samples]


def test_code_block(spark):
    f = "`" * 3
    cases = {
        f"a {f}rust\nfn main() {{}}\n{f} b": "fn main() {}",
        f"{f}RUST\n x {f}{f}\ny{f}": "x",
        f"{f}python\nx{f}": f"{f}python\nx{f}",
        f"{f}\n\n{f}": "",
        "  none ": "none",
    }
    df = spark.createDataFrame([(s,) for s in cases], "s string")
    assert [r.o for r in df.select(text.code_block(F.col("s")).alias("o")).collect()] == list(cases.values())


def test_pad_and_unpad(docs):
    rows = docs.select("doc_id", token_lengths().alias("ids"), F.floor(F.col("doc_id") / 7).alias("b"))
    rows = rows.withColumn("kept", F.col("ids"))
    padded = feed.pad_batch(rows, ["b"], "ids")
    back = feed.unpad(F.col("ids"), F.size("kept"))
    assert padded.where(back != F.col("kept")).count() == 0
    widths = padded.groupBy("b").agg(F.min(F.size("ids")).alias("lo"), F.max(F.size("ids")).alias("hi"))
    assert widths.where("lo <> hi").count() == 0


@pytest.mark.parametrize("width", [1, 64, 4096])
def test_windows_concatenate_to_the_sequence(docs, width):
    rows = docs.select("doc_id", token_lengths().alias("ids"))
    cut = feed.window_tokens(rows, "ids", width=width)
    assert cut.where(F.size("ids") > width).count() == 0
    joined = cut.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("window_id", "ids"))).alias("w"))
    back = joined.select("doc_id", F.flatten("w.ids").alias("back")).join(rows, "doc_id")
    assert back.where("back <> ids").count() == 0
    assert back.count() == rows.where(F.size("ids") > 0).count()


def test_empty_sequence_has_no_window_and_short_response_is_not_cut(spark):
    df = spark.createDataFrame([(0, [], [1]), (1, list(range(10)), [9]), (2, list(range(10)), [1, 2, 3])], "id int, p array<int>, r array<int>")
    rows = feed.window_tokens(df, "p", "r", width=4).orderBy("id", "window_id").collect()
    assert [(r.id, r.window_id, r.p, r.r) for r in rows] == [
        (1, 0, [0, 1, 2, 3], [9]), (1, 1, [4, 5, 6, 7], [9]), (1, 2, [8, 9], [9]),
        (2, 0, [0, 1, 2, 3], [1, 2, 3]), (2, 1, [4, 5, 6, 7], []), (2, 2, [8, 9], []),
    ]


def test_shift(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([7],)], "t array<int>")
    rows = feed.teacher_shift(df, "t").collect()
    assert [(r.decoder_input, r.decoder_target) for r in rows] == [([1, 2], [2, 3]), ([7], [7])]


def test_chunks_are_full_but_the_last(docs):
    rows = docs.select(F.col("lang").alias("domain"), "source", F.col("doc_id").alias("row_pos"))
    made = numbering.chunk_assign(rows, chunk_size=3, span=7)
    sizes = made.groupBy("domain", "source", "chunk_id").agg(F.count(F.lit(1)).alias("n"), F.max("pos_in_chunk").alias("top"))
    last = F.max("chunk_id").over(Window.partitionBy("domain", "source"))
    sizes = sizes.withColumn("last", last)
    assert sizes.where("chunk_id < last AND n <> 3 OR n > 3 OR top <> n - 1").count() == 0


@pytest.mark.parametrize("span", [1, 3, 1000])
def test_numbering_equals_the_plain_window(docs, span):
    rows = docs.select("source", F.col("doc_id").alias("row_pos"))
    plain = F.row_number().over(Window.partitionBy("source").orderBy("row_pos")) - 1
    made = numbering.number_rows(rows, ["source"], "row_pos", "n", span)
    assert made.join(rows.withColumn("m", plain), ["source", "row_pos"]).where("n <> m").count() == 0
    assert made.count() == rows.count()
    shifted = numbering.previous_value(rows, ["source"], "row_pos", "row_pos", "before", span)
    lagged = rows.withColumn("lagged", F.lag("row_pos").over(Window.partitionBy("source").orderBy("row_pos")))
    assert shifted.join(lagged, ["source", "row_pos"]).where("NOT before <=> lagged").count() == 0


@pytest.mark.parametrize("parts", [1, 4, 32])
def test_results_do_not_depend_on_partitions(spark, docs, parts):
    rows = docs.select(F.col("lang").alias("domain"), "source", F.col("doc_id").alias("row_pos"), "text")
    made = numbering.chunk_assign(rows.repartition(parts), chunk_size=4, span=11)
    key = made.select(F.sum(F.xxhash64("source", "row_pos", "chunk_id", "pos_in_chunk") % 1000003).alias("h")).first().h
    base = numbering.chunk_assign(rows, chunk_size=4).select(
        F.sum(F.xxhash64("source", "row_pos", "chunk_id", "pos_in_chunk") % 1000003).alias("h")
    ).first().h
    assert key == base
    vocab = tokens.build_vocab(rows.repartition(parts), "text", max_size=52).orderBy("id").collect()
    assert [r.id for r in vocab] == list(range(2, 52))
    plain = tokens.count_tokens(rows, "text").orderBy(F.desc("n"), "token").limit(50).collect()
    assert [(r.token, r.n) for r in vocab] == [(r.token, r.n) for r in plain]


def test_caps_take_the_first_rule_that_fits(spark):
    rules = (("web", None, 20), (None, "novels/zh", 5), ("traces", None, 3), (None, "code/v3", 7))
    rows = [("web", "novels/zh"), ("code", "novels/zh"), ("traces", "code/v3"), ("code", "code/v3"), ("code", "x"), (None, None)]
    df = spark.createDataFrame(rows, "domain string, dataset string")
    caps = [r.c for r in df.select(numbering.cap_for(F.col("domain"), F.col("dataset"), rules).alias("c")).collect()]
    assert caps == [20, 5, 3, 7, None, None]
    many = df.crossJoin(spark.range(9)).selectExpr("domain", "dataset", "dataset AS source", "id AS row_pos")
    assert numbering.row_cap(many).count() == 54  # no rule, no cap
    kept = {(r.domain, r.dataset): r["count"] for r in numbering.row_cap(many, rules=rules).groupBy("domain", "dataset").count().collect()}
    assert kept == dict(zip(rows, [9, 5, 3, 7, 9, 9]))


@pytest.mark.parametrize("span", [1, 7, 64, 10_000])
def test_numbers_for_any_positions(spark, span):
    draw = random.Random(span)
    hashed = [(draw.choice(["a", "b", None]), draw.randint(-(1 << 63), (1 << 63) - 1)) for _ in range(300)]
    near = [("c", (1 << 62) + k % 5) for k in range(200)]  # many ties, far from 0
    edges = [("d", -(1 << 63)), ("d", (1 << 63) - 1), ("d", 0)] * 10
    rows = hashed + near + edges + [("e", None)] * 150 + [("f", k) for k in range(100)] + [("f", None)] * 50
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "s string, p bigint, t bigint").repartition(5)
    placed = numbering.split_places(df, ["s"], "p", "t", span)
    assert placed.groupBy("_place").count().agg(F.max("count")).first()[0] <= span
    made = numbering.number_rows(df, ["s"], "p", "n", span, tie="t").collect()
    order = {}
    for s, p, t in sorted(((*r, k) for k, r in enumerate(rows)), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        order.setdefault(s, []).append(t)
    assert {(r.s, r.t): r.n for r in made} == {(s, t): n for s, own in order.items() for n, t in enumerate(own)}


def test_rows_of_earlier_runs_count_towards_the_cap(spark):
    rows = spark.range(20).select(F.lit("d").alias("domain"), F.lit("s").alias("source"), F.lit("s").alias("dataset"), F.col("id").alias("row_pos"))
    kept = numbering.row_cap(rows, rules=((None, None, 12),), done=F.lit(5), span=4)
    assert [r.row_pos for r in kept.orderBy("row_pos").collect()] == list(range(7))


def test_chunks_go_on_after_what_exists(spark):
    rows = spark.range(5).select(F.lit("d").alias("domain"), F.lit("s").alias("source"), F.col("id").alias("row_pos"))
    known = spark.createDataFrame([("d", "s", 3)], "domain string, source string, chunk_id int")
    fresh = numbering.chunk_assign(rows, chunk_size=2, first_chunk=numbering.next_chunks(known)).orderBy("row_pos")
    assert [(r.chunk_id, r.pos_in_chunk) for r in fresh.collect()] == [(4, 0), (4, 1), (5, 0), (5, 1), (6, 0)]
    done = spark.createDataFrame([("d", "s", 3)], "domain string, source string, n_rows bigint")
    filled = numbering.chunk_assign(rows, chunk_size=2, already=done).orderBy("row_pos")
    assert [(r.chunk_id, r.pos_in_chunk) for r in filled.collect()] == [(1, 1), (2, 0), (2, 1), (3, 0), (3, 1)]


def _batch(spark, sizes, width=5, seed=3):
    rng = np.random.default_rng(seed)
    rows, at = [], 0
    for batch, n in enumerate(sizes):
        for _ in range(n):
            rows.append((batch, at, rng.normal(size=width).tolist()))
            at += 1
    return rows, spark.createDataFrame(rows, "b int, r int, v array<double>")


@pytest.mark.parametrize("block_rows", [2, 5, 1024])
def test_pair_metrics_equal_brute_force_for_any_block_size(spark, block_rows):
    rows, df = _batch(spark, [1, 2, 7, 40])
    separability = {r.b: r.separability_loss for r in pairs.separability_loss(df, "b", "r", "v", block_rows).collect()}
    spectral = {r.b: r.spectral_loss for r in pairs.spectral_loss(df, "b", "v", block_rows).collect()}
    for batch in range(4):
        x = np.array([v for b, _, v in rows if b == batch])
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        off = ~np.eye(len(x), dtype=bool)
        want = np.maximum(unit @ unit.T, 0)[off].mean() if len(x) > 1 else 0.0
        assert separability[batch] == pytest.approx(want, rel=1e-12)
        if len(x) > 1:
            cov = np.cov(x.T)
            want = (cov[~np.eye(len(cov), dtype=bool)] ** 2).mean()
        else:
            want = 0.0
        assert spectral[batch] == pytest.approx(want, rel=1e-9)


def test_every_row_of_a_split_batch_meets_every_other(spark):
    _, df = _batch(spark, [33, 1])
    made = pairs.batch_pairs(df, "b", "r", "v", block_rows=4).collect()
    assert sorted(r.partners for r in made) == [0] + [32] * 33


def test_optimizer_steps_follow_the_loop(spark):
    sizes = {0: 20, 1: 12, 2: 16, 3: 5}
    rows = [(e, i) for e, n in sizes.items() for i in range(n)]
    made = feed.optimizer_step(spark.createDataFrame(rows, "epoch int, i int"), "i").orderBy("epoch", "i").collect()
    counter, steps = 0, 0
    for row in made:
        counter += 1
        assert (row.global_mb, row.step) == (counter, steps)
        closes = counter % 16 == 0
        if row.i == sizes[row.epoch] - 1 and counter % 16 != 0:
            closes = True
        assert row.closes_step == closes
        steps += closes


def test_advantages_cancel_out(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    made = rollouts.group_advantage(rows, ["user_id"], "value")
    sums = made.groupBy("user_id").agg(F.sum("advantage").alias("s"))
    assert sums.where(F.abs("s") > 1e-9).count() == 0


def test_advantage_of_lone_and_equal_candidates(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 5.0), (2, 5.0)], "p int, r double")
    made = rollouts.group_advantage(df, ["p"], "r").orderBy("p").collect()
    assert [r.advantage for r in made] == [0.0, 0.0, 0.0]


def test_surrogate_equals_plain_numpy(spark):
    new, old, adv = [-0.1, -0.9, -2.0], [-0.5, -0.4, -2.1], [1.5, -2.0]
    df = spark.createDataFrame([(1, new, old, a) for a in adv], "p int, n array<double>, o array<double>, a double")
    found = rollouts.surrogate_loss(df, ["p"], "n", "o", "a").first().surrogate_loss
    ratio = np.exp(np.array(new) - np.array(old))
    want = sum(-np.minimum(ratio * a, np.clip(ratio, 0.8, 1.2) * a).mean() for a in adv)
    assert found == pytest.approx(want, rel=1e-12)


def test_schedules(spark):
    steps = [0, 1, 4, 5, 50, 100, 150, 200]
    df = spark.createDataFrame([(s,) for s in steps], "s int")
    found = df.select(
        schedules.learning_rate_factor(F.col("s"), F.lit(5), F.lit(100)).alias("lr"),
        schedules.concept_weight(F.col("s"), 100).alias("w"),
    ).collect()
    for s, row in zip(steps, found):
        lr = s / 5 if s < 5 else max(0.0, 0.5 * (1 + math.cos(math.pi * (s - 5) / 95)))
        assert row.lr == pytest.approx(lr, abs=1e-12)
        assert row.w == pytest.approx(1.0 if s >= 100 else 0.01 + s / 100 * 0.99, abs=1e-12)


def test_masked_loss_ignores_padding(spark):
    rows = [(1, 0, 9.0), (1, 3, 1.0), (1, 4, 2.0), (2, 0, 5.0)]
    made = metrics.masked_ce(spark.createDataFrame(rows, "b int, t int, nll double"), ["b"], "t", "nll")
    assert {r.b: r.ce_loss for r in made.collect()} == {1: 1.5, 2: None}


def test_attempts(spark):
    rows = [(1, 1, False, "a"), (1, 2, True, "b"), (1, 3, True, "c"), (2, 1, False, "x"), (2, 3, False, "z"), (2, 4, True, "late")]
    made = rollouts.attempt_resolution(spark.createDataFrame(rows, "p int, attempt int, ok boolean, code string"), ["p"])
    assert {r.p: (r.solved, r.attempts, r.code) for r in made.collect()} == {1: (True, 2, "b"), 2: (False, 3, "z")}


def test_ids_round_trip_and_unknown_words(spark):
    df = spark.createDataFrame([("a b a c!",), ("",), (None,)], "text string")
    vocab = tokens.build_vocab(df, "text", max_size=4)
    rows = tokens.tokenize_corpus(df.na.fill(""), vocab, {"text": "ids"}).collect()
    assert rows[0].ids == [2, 1, 2, 1, 3] or rows[0].ids == [2, 3, 2, 1, 1]
    coded = spark.createDataFrame([([2, 0, 1, 3],), ([],), ([1, 1],)], "ids array<int>")
    words = {r.id: r.token for r in vocab.collect()}
    decoded = [r.out for r in tokens.decode_tokens(coded, vocab, "ids", "out").collect()]
    assert decoded == [f"{words[2]} {words[3]}", "", ""]


def test_unit_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    made = [r.u for r in df.select(arrays.l2_normalize(F.col("v")).alias("u")).collect()]
    assert made == [[0.6, 0.8], [0.0, 0.0]]


def test_one_conversation_with_almost_all_turns(spark):
    """A hot conversation: small ranges and a small limit give the tokens of the whole text, cut."""
    rows = [("hot", i * 3, "user" if i % 2 == 0 else "assistant", f"word{i} and, more") for i in range(500)]
    rows += [("b", 7, "assistant", "only"), ("c", 0, "system", "s"), ("c", 4, "Human", "u " * 40)]
    turns = spark.createDataFrame(rows, "conv_id string, turn bigint, role string, text string")
    for limit in (1, 6, 50, 10_000):
        short = {r.conv_id: r for r in conversations.fold_to_tokens(turns, limit=limit, span=10).collect()}
        whole = fold_conversation_v2(turns).select(
            "conv_id",
            *[arrays.truncate(tokens.split_tokens(F.col(c)), limit).alias(c) for c in ("prompt", "response")],
        )
        for row in whole.collect():
            assert (short[row.conv_id].prompt, short[row.conv_id].response) == (row.prompt, row.response)


def test_running_total(docs):
    rows = docs.select("source", F.col("doc_id").alias("row_pos"), F.length("text").alias("n"))
    before = Window.partitionBy("source").orderBy("row_pos").rowsBetween(Window.unboundedPreceding, -1)
    plain = rows.withColumn("want", F.coalesce(F.sum("n").over(before), F.lit(0)))
    for span in (1, 13, 10_000):
        made = numbering.running_total(rows, ["source"], "row_pos", "n", "total", span)
        assert made.join(plain, ["source", "row_pos"]).where("total <> want").count() == 0


def test_null_keys_and_positions_keep_their_rows(spark):
    rows = [(None, "s", 0), ("d", None, 0), ("d", None, 7), ("d", "s", None), ("d", "s", 3), ("d", "s", 60_000)]
    df = spark.createDataFrame(rows, "domain string, source string, row_pos bigint")
    done = spark.createDataFrame([("d", None, 5)], "domain string, source string, n_rows bigint")
    made = numbering.chunk_assign(df, chunk_size=10, already=done).collect()
    got = {(r.domain, r.source, r.row_pos): (r.chunk_id, r.pos_in_chunk) for r in made}
    assert got == {
        (None, "s", 0): (0, 0), ("d", None, 0): (0, 5), ("d", None, 7): (0, 6),
        ("d", "s", None): (0, 0), ("d", "s", 3): (0, 1), ("d", "s", 60_000): (0, 2),
    }
    total = numbering.running_total(df.na.fill(0, ["row_pos"]), ["domain", "source"], "row_pos", "row_pos", "t").collect()
    assert sorted(r.t for r in total) == [0, 0, 0, 0, 0, 3]
    earlier = numbering.previous_value(df, ["domain", "source"], "row_pos", "row_pos", "p").collect()
    assert {r.row_pos: r.p for r in earlier if r.domain == "d" and r.source is None} == {0: None, 7: 0}
    scored = rollouts.group_advantage(df.withColumn("x", F.col("row_pos").cast("double")), ["source"], "x").collect()
    assert len(scored) == len(rows)


def test_turns_without_role_or_text_stay(spark):
    rows = [("a", 0, None, "lost?"), ("a", 1, "user", None), ("a", 2, None, "x"), ("a", 3, "agent", "yo"), ("b", 0, "user", None), ("b", 1, "agent", "z")]
    turns = spark.createDataFrame(rows, "conv_id string, turn bigint, role string, text string")
    listed = {r.conv_id: (r.prompt, r.response) for r in fold_conversation_v2(turns).collect()}
    assert listed == {"a": ("turn: lost?\nuser: ", "[turn]: x\n[agent]: yo"), "b": ("user: ", "[agent]: z")}
    folded = {r.conv_id: (r.prompt, r.response) for r in conversations.fold_to_tokens(turns).collect()}
    sides = fold_conversation_v2(turns).select("conv_id", *[tokens.split_tokens(F.col(c)).alias(c) for c in ("prompt", "response")])
    assert folded == {r.conv_id: (r.prompt, r.response) for r in sides.collect()}


def test_pairs_of_a_null_batch(spark):
    """Rows without a batch are a batch of their own."""
    rows = [(None, 1, [1.0, 0.0]), (None, 2, [1.0, 1.0]), (3, 3, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "b int, r bigint, v array<double>")
    found = {r.r: (r.b, r.partners) for r in pairs.batch_pairs(df, "b", "r", "v").collect()}
    assert found == {1: (None, 1), 2: (None, 1), 3: (3, 0)}
