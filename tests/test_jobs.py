"""Whole jobs: shards written, resumed and streamed; readers that meet bad files."""

import time

import pytest
from pyspark.sql import functions as F

from pairmill.operators.numbering import chunk_assign
from pairmill.plans.featurize import accept_pairs, build_shards, featurize_pairs
from pairmill.plans.training_feed import decoder_feed, latent_feed
from pairmill.registry.base import table
from pairmill.registry.corpus import doc_vocab, document_rows
from pairmill.registry.streams import _accept, _arrivals, _drain
from pairmill.sources import scans, shards
from pairmill.storage import BATCH_BYTES, BATCH_CONF, broadcast_if_bounded, shared_dir, staged_mapped, work_path
from pairmill.streaming import ingest

ALL = ((None, None, 1_000_000),)
KEY = ["domain", "source", "row_pos"]


@pytest.fixture(scope="module")
def vocab(spark, sf_dir):
    return doc_vocab(spark, sf_dir)


@pytest.fixture(scope="module")
def raw(spark, sf_dir):
    return document_rows(spark, sf_dir)


def _numbers(df):
    return {tuple(r) for r in df.select(*KEY, "chunk_id", "pos_in_chunk").collect()}


def test_shards_hold_every_sample_once(spark, raw, vocab):
    path = work_path(spark, "t-shards")
    build_shards(raw, vocab, path, chunk_size=3, rules=ALL, dimension=16)
    made = shards.scan_shards(spark, path)
    expected = featurize_pairs(accept_pairs(raw), vocab, 16)
    assert made.count() == expected.count()
    mine = made.select(*KEY, "input_tokens", "response_tokens", "target_concept")
    assert mine.exceptAll(expected.select(*mine.columns)).count() == 0
    sizes = made.groupBy("domain", "source", "chunk_id").count()
    assert sizes.where("count > 3").count() == 0
    norms = made.select(F.aggregate("target_concept", F.lit(0.0), lambda a, x: a + x * x).alias("n"))
    assert norms.where("abs(n - 1) > 1e-4").count() == 0


def test_a_stopped_job_goes_on_to_the_same_shards(spark, raw, vocab):
    whole, parts = work_path(spark, "t-whole"), work_path(spark, "t-parts")
    build_shards(raw, vocab, whole, chunk_size=3, rules=ALL, dimension=16)
    build_shards(raw.where("row_pos < 90"), vocab, parts, chunk_size=3, rules=ALL, dimension=16)
    build_shards(raw, vocab, parts, chunk_size=3, rules=ALL, dimension=16, resume=True)
    assert _numbers(shards.scan_shards(spark, whole)) == _numbers(shards.scan_shards(spark, parts))


def test_no_row_is_lost_for_a_null_key_or_position(spark, vocab):
    text = "A first half of some length here. And a second half of some length."
    keys = [("d", "s", 1), (None, "s", 2), ("d", None, 3), ("d", "s", None), (None, None, None), ("d", "s", None), ("d", "s", 1)]
    schema = "domain string, source string, dataset string, row_pos bigint, raw string"
    rows = [(d, s, "x", p, f'{{"text": "{k % 5} {text}"}}') for k, (d, s, p) in enumerate(keys)]
    raw = spark.createDataFrame(rows, schema)
    path = work_path(spark, "t-null")
    build_shards(raw, vocab, path, chunk_size=2, dimension=16, span=1)
    made = shards.scan_shards(spark, path)
    found = sorted((str(r.domain), str(r.source), str(r.row_pos)) for r in made.collect())
    assert found == sorted(tuple(map(str, k)) for k in keys)
    assert made.where("chunk_id IS NULL OR pos_in_chunk IS NULL").count() == 0
    more = raw.union(spark.createDataFrame([("d", None, "x", None, f'{{"text": "new {text}"}}')], schema))
    build_shards(more, vocab, path, chunk_size=2, dimension=16, span=1, resume=True)
    made = shards.scan_shards(spark, path)
    assert made.count() == len(keys) + 1
    places = made.select("domain", "source", (F.col("chunk_id") * 2 + F.col("pos_in_chunk")).alias("n")).collect()
    by_source = {}
    for r in places:
        by_source.setdefault((r.domain, r.source), []).append(r.n)
    assert all(sorted(n) == list(range(len(n))) for n in by_source.values()) and len(by_source[("d", None)]) == 2


def test_readers_see_published_runs_only(spark, raw, vocab):
    path = work_path(spark, "t-commit")
    numbered = raw.select("domain", "source", "row_pos", F.lit(0).alias("chunk_id"), F.col("row_pos").alias("pos_in_chunk"))
    shards.write_shards(numbered, f"{path}/{shards.RUNS}/killed", mode="overwrite")  # as far as a killed run came
    assert not shards.has_shards(spark, path)
    with pytest.raises(FileNotFoundError):
        shards.scan_shards(spark, path)
    early = numbered.where("row_pos < 50")
    assert shards.commit_shards(early, path, run="first") == "first"
    assert shards.scan_shards(spark, path).count() == early.count()
    shards.write_shards(numbered.where("row_pos >= 60"), f"{path}/{shards.RUNS}/second", mode="overwrite")
    assert shards.scan_shards(spark, path).count() == early.count()
    shards.commit_shards(numbered.where("row_pos >= 50"), path, run="second")  # the rerun replaces what was left
    assert shards.scan_shards(spark, path).count() == numbered.count()
    with pytest.raises(FileExistsError):
        shards.commit_shards(early, path, run="first")
    with pytest.raises(FileExistsError):
        build_shards(raw, vocab, path)


def test_cap_counts_accepted_rows_across_runs(spark, raw, vocab):
    path, caps = work_path(spark, "t-caps"), ((None, None, 2),)
    build_shards(raw.where("row_pos < 60"), vocab, path, chunk_size=3, rules=caps, dimension=16)
    build_shards(raw, vocab, path, chunk_size=3, rules=caps, dimension=16, resume=True)
    once = work_path(spark, "t-once")
    build_shards(raw, vocab, once, chunk_size=3, rules=caps, dimension=16)
    assert _numbers(shards.scan_shards(spark, path)) == _numbers(shards.scan_shards(spark, once))


def test_stream_gives_what_the_batch_job_gives(spark, sf_dir, raw):
    path, root = _arrivals(spark, sf_dir), work_path(spark, "t-stream")
    first = _drain(spark, path, root, files_per_trigger=4)
    assert len([p for p in first.recentProgress if p.numInputRows]) > 1
    batch = _accept(raw)
    made = ingest.stream_samples(spark, root)
    assert made.select(*batch.columns).exceptAll(batch).count() == 0
    assert made.count() == batch.count()
    again = _drain(spark, path, root)
    assert sum(p.numInputRows for p in again.recentProgress) == 0
    assert ingest.stream_samples(spark, root).count() == batch.count()


def test_a_batch_that_runs_twice_writes_the_same_numbers(spark, raw):
    root = work_path(spark, "t-replay")
    write = ingest.shard_sink(root, _accept, chunk_size=3)
    early, late = raw.where("row_pos % 2 = 0"), raw.where("row_pos % 2 = 1")
    write(early, 0)
    write(late, 1)
    before = _numbers(ingest.stream_samples(spark, root))
    write(late, 1)
    assert _numbers(ingest.stream_samples(spark, root)) == before
    totals = {(r.domain, r.source): r.n_rows for r in ingest.stream_totals(spark, root).collect()}
    counts = _accept(raw).groupBy("domain", "source").count().collect()
    assert totals == {(r.domain, r.source): r["count"] for r in counts}


def test_listener_sees_rows(spark, sf_dir):
    log = ingest.ProgressLog()
    spark.streams.addListener(log)
    try:
        query = _drain(spark, _arrivals(spark, sf_dir), work_path(spark, "t-listen"), 6)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        assert log.rows[str(query.runId)] == table(spark, sf_dir, "documents").count()
    finally:
        spark.streams.removeListener(log)


def test_phase_reads_only_its_directories(spark, raw, vocab):
    path = work_path(spark, "t-phase")
    build_shards(raw, vocab, path, chunk_size=3, rules=ALL, dimension=16)
    english = shards.scan_shards(spark, path, "en")
    assert {r.domain for r in english.select("domain").distinct().collect()} == {"en"}
    assert all("/domain=en/" in f for f in english.inputFiles()) or "PartitionFilters: [isnotnull(domain" in (
        english._jdf.queryExecution().executedPlan().toString()
    )


def test_feeds(spark):
    rows = [("d", "s", 0, 0, [1, 2, 3], [5, 6]), ("d", "s", 0, 1, [4], None), ("d", "s", 0, 2, [7, 8], [9])]
    samples = spark.createDataFrame(rows, "domain string, source string, chunk_id int, pos_in_chunk int, input_tokens array<int>, response_tokens array<int>")
    latent = latent_feed(samples, epochs=2, batch_size=2).orderBy("epoch", "pos_in_chunk").collect()
    assert [(r.input_tokens, r.decoder_input, r.decoder_target) for r in latent[:3]] == [
        ([1, 2, 3], [5], [6]), ([4, 0, 0], [4], [0]), ([7, 8], [9], [9]),
    ]
    assert [r.epoch for r in latent] == [0] * 3 + [1] * 3
    fixed = decoder_feed(samples.where("response_tokens IS NOT NULL"), epochs=1, max_len=4).orderBy("pos_in_chunk").collect()
    assert [(r.decoder_input, r.decoder_target) for r in fixed] == [
        ([5, 6, 0, 0], [6, 0, 0, 0]), ([9, 0, 0, 0], [0, 0, 0, 0]),
    ]


def test_probe_reports_and_goes_on(spark, sf_dir):
    status = scans.source_probe(
        spark,
        [("ok", f"{sf_dir}/events.parquet", "parquet"), ("gone", f"{sf_dir}/none.parquet", "parquet"), ("also", f"{sf_dir}/labels.parquet", "parquet")],
    )
    assert {r.source: r.ok for r in status.collect()} == {"ok": True, "gone": False, "also": True}


def test_broadcast_only_within_the_bound(spark):
    small, large = spark.range(10), spark.range(1000)
    plan = lambda df: spark.range(5).join(df, "id")._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint (strategy=broadcast)" in plan(broadcast_if_bounded(small, 100))
    assert "broadcast" not in plan(broadcast_if_bounded(large, 100))


def test_shared_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = shared_dir(spark)
    assert folder == named.rstrip("/") if named else folder.startswith("/tmp/")
    assert work_path(spark, "x") != work_path(spark, "x")


def test_row_counter(spark, raw):
    from pairmill.operators.metrics import with_row_counter

    counted, seen = with_row_counter(raw)
    total = counted.where("row_pos >= 0").count()
    assert seen.get == {"n_rows": total}


def _staged_batches(spark, monkeypatch, job):
    """The bound on a batch that held each time ``job`` wrote a table, by the table's label."""
    from pairmill import storage

    seen, write = {}, storage.staged

    def noted(df, label):
        seen[label] = spark.conf.get(BATCH_CONF)
        return write(df, label)

    monkeypatch.setattr(storage, "staged", noted)
    job()
    return seen


def test_batches_of_a_staged_table_are_bounded_by_bytes(spark):
    before = spark.conf.get(BATCH_CONF)
    wide = spark.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("x"), 20_000).alias("text"))

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    found = staged_mapped(wide.mapInArrow(sizes, "rows bigint, bytes bigint"), "t-batches").collect()
    assert sum(r.rows for r in found) == 3000
    assert max(r.bytes for r in found) < 2 * BATCH_BYTES
    assert spark.conf.get(BATCH_CONF) == before


def test_python_of_shards_and_feeds_gets_bounded_batches(spark, sf_dir, monkeypatch, raw, vocab):
    from pairmill.registry.corpus import _numbered_samples

    built = _staged_batches(spark, monkeypatch, lambda: build_shards(raw, vocab, work_path(spark, "t-bound"), chunk_size=3, dimension=16))
    assert built["accepted-samples"] == str(BATCH_BYTES)
    fed = _staged_batches(spark, monkeypatch, lambda: _numbered_samples(spark, sf_dir))
    assert fed["samples"] == str(BATCH_BYTES)


def test_python_of_near_duplicates_gets_bounded_batches(spark, monkeypatch):
    from pairmill.llm.neardup import near_duplicates

    common = "the same long line of words that two of the texts share but for the last one of them all here"
    docs = spark.createDataFrame([(1, f"{common} a"), (2, f"{common} b"), (3, "another text with other words in it")], "doc_id bigint, text string")
    found = {}
    seen = _staged_batches(spark, monkeypatch, lambda: found.update({r.doc_id: r.component_id for r in near_duplicates(docs, percent=80).collect()}))
    assert found == {1: 1, 2: 1, 3: 3}
    assert {seen[k] for k in ("sketches", "sets", "links")} == {str(BATCH_BYTES)}


def test_vectors_of_many_rows_are_made_in_slices(spark):
    from pairmill.operators import vectors

    tokens = [[f"w{k % 7}", f"w{k % 11}"] if k % 5 else [] for k in range(2 * vectors.MATRIX_ROWS + 3)]
    rows = spark.createDataFrame(list(enumerate(tokens)), "id int, t array<string>").coalesce(1)
    made = {r.id: r.v for r in rows.select("id", vectors.concept_vector(F.col("t"), 8).alias("v")).collect()}
    whole = vectors.hash_encoder(8)(pa_lists(tokens))
    assert all(made[k] == [float(x) for x in whole[k].astype("float32")] for k in range(len(tokens)))


def pa_lists(tokens):
    import pyarrow as pa

    return pa.array(tokens, pa.list_(pa.string()))


def test_a_directory_per_chunk_is_listed_in_few_tasks(spark):
    path = work_path(spark, "t-listing")
    rows = spark.range(300).select(
        F.lit("d").alias("domain"), F.lit("s").alias("source"), F.col("id").cast("int").alias("chunk_id"), F.lit(0).alias("pos_in_chunk")
    )
    shards.write_shards(rows, path, chunk_dirs=True)
    context = spark.sparkContext
    context.setJobGroup("t-listing", "listing")
    try:
        found = shards.open_shards(spark, path)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("t-listing") for s in tracker.getJobInfo(j).stageIds]
    assert stages and sum(s.numTasks for s in stages if s) < 150
    assert found.count() == 300


def _chunked(spark, sources):
    """For each source as many chunks as it says, of two rows."""
    rows = [(d, s, k, p, 2 * k + p, f"{s} {k} {p}") for (d, s), chunks in sources.items() for k in range(chunks) for p in range(2)]
    return spark.createDataFrame(rows, "domain string, source string, chunk_id int, pos_in_chunk int, row_pos bigint, text string")


def test_many_chunk_directories_are_listed_in_bounded_parts(spark, monkeypatch):
    odd = "a b}, {c}*?[x]^/y=1%25"
    rows = _chunked(spark, {("d", "s"): 230, ("d", None): 3, ("d", "007"): 4, (None, odd): 25, ("e", "s"): 1})
    path = work_path(spark, "t-parts")
    shards.write_shards(rows, path, chunk_dirs=True)
    monkeypatch.setattr(shards, "MOST_LISTED", 10)
    listed, by_bytes = [], shards._by_bytes
    monkeypatch.setattr(shards, "_by_bytes", lambda found: listed.append(len(found.select("domain", "source", "chunk_id").distinct().collect())) or by_bytes(found))
    found = shards.open_shards(spark, path).select(rows.columns)
    assert listed == [10] * 26 + [3]
    assert [f.dataType for f in found.schema] == [f.dataType for f in rows.schema]
    assert sorted(map(str, found.collect())) == sorted(map(str, rows.collect()))
    assert sorted(map(str, shards.scan_shards(spark, path).select(rows.columns).collect())) == sorted(map(str, rows.collect()))


def test_a_folder_of_two_layouts_is_not_read_in_part(spark):
    path = work_path(spark, "t-layouts")
    shards.write_shards(_chunked(spark, {("d", "s"): 2}), path, chunk_dirs=True)
    shards.write_shards(_chunked(spark, {("d", "t"): 2}), path)
    with pytest.raises(Exception, match="(?i)partition"):
        shards.open_shards(spark, path).count()


def test_few_chunk_directories_are_read_in_place_by_few_tasks(spark):
    rows = _chunked(spark, {("d", "007"): 120, ("d", None): 2})
    path = work_path(spark, "t-tasks")
    shards.write_shards(rows, path, chunk_dirs=True)
    name, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(name, str(8 << 20))
    try:
        found = shards.open_shards(spark, path).select(rows.columns)
        assert found.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
        assert path in found.inputFiles()[0]
        assert sorted(map(str, found.collect())) == sorted(map(str, rows.collect()))
    finally:
        spark.conf.set(name, before)


def test_exchanges_of_shards_go_when_they_are_written(spark):
    def kept():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in files.mkString(" ").split() if "/shuffle_" in f and f.endswith(".data")}

    rows = _chunked(spark, {("d", "s"): 20})
    before = kept()
    shards.write_shards(rows, work_path(spark, "t-exchanges"), chunk_dirs=True)
    for _ in range(8):  # looked at seldom, as the driver's garbage collection would take them too
        time.sleep(1)
        left = kept() - before
        if not left:
            break
    assert not left


def test_numbers_that_nobody_reads_move_no_rows(spark):
    rows = _chunked(spark, {("d", "s"): 20}).drop("chunk_id", "pos_in_chunk")
    numbered = chunk_assign(rows, chunk_size=10, span=10)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan(numbered)
    assert "Exchange" not in plan(numbered.drop("chunk_id", "pos_in_chunk"))
    assert [r.chunk_id for r in numbered.orderBy("row_pos").collect()] == [k // 10 for k in range(40)]
