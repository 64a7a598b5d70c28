"""The corpus pipeline against a brute-force version, stage by stage, on planted documents."""

import re
import struct

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tiktoken.load

import corpus_pipeline

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, doc string, `a.b` string, __key bigint"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def windows(text, size):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Documents with clashing column names, and the ids that each kind of them has."""
    draw = np.random.default_rng(5)

    def prose(n):
        return " ".join(f"w{x}" for x in draw.integers(0, 100_000, n))

    passage = prose(12)
    texts = {k: prose(60) for k in range(100)}
    insults = ["idiot", "moron", "scum"]
    texts |= {k: f"{prose(4)} you {insults[k % 3]} go rot {insults[(k + 1) % 3]} {prose(4)}" for k in range(100, 180)}
    texts |= {200: texts[3], 201: texts[3].replace(texts[3].split()[30], "other"), 202: f"{prose(20)} {passage} {prose(20)}", 203: None, 204: "", 205: None}
    texts[206] = f"{prose(15)} write to jane.doe@mail.example.org soon {prose(15)}"
    rows = [(k, t, "en", f"s{k % 3}", None if t is None else len(t), "doc", "dotted", k) for k, t in texts.items()]
    rows += [(207, texts[3], "en", "s0", len(texts[3]), None, None, None), (None, prose(30), None, None, 1, None, None, None)]
    root = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{root}/documents.parquet")
    labels = [(k, int(k >= 100)) for k in texts if k < 180]
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([("b1", passage), ("b2", None)], "item_id string, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), rows, passage


def test_every_stage_as_brute_force(spark, planted):
    root, rows, passage = planted
    docs = spark.read.parquet(f"{root}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "pii", "byte_bpe"]

    clean = stages["toxicity"](spark, docs, root)
    assert clean.columns == docs.columns
    expected = [r for r in rows if r[0] is None or not 100 <= r[0] < 180]
    assert sorted(map(repr, (tuple(r) for r in clean.collect()))) == sorted(map(repr, expected))

    sets = [(r[0], shingles(r[1])) for r in rows]
    label = {k: k for k, _ in sets}
    for _ in range(4):
        for i, x in sets:
            for j, y in sets:
                if None not in (i, j) and x and y and 100 * len(x & y) >= 80 * len(x | y):
                    label[i] = label[j] = min(label[i], label[j])
    single = [r for r in rows if r[0] is None or label[r[0]] == r[0]]
    found = stages["near_duplicates"](spark, docs, root)
    assert found.columns == docs.columns and len(rows) - len(single) == 3
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, single))

    target = windows(passage, 10)
    found = stages["decontamination"](spark, docs, root)
    assert {r.doc_id for r in found.collect()} == {r[0] for r in rows if not windows(r[1], 10) & target}

    redacted = {r.doc_id: r for r in stages["pii"](spark, docs, root).collect()}
    assert len(redacted) == len({r[0] for r in rows}) and not EMAIL.search(redacted[206].text)
    for r in rows:
        assert redacted[r[0]].n_chars == (None if r[1] is None and redacted[r[0]].text is None else len(redacted[r[0]].text))
        if r[0] != 206:
            assert (redacted[r[0]].text or "") == (r[1] or "")


def test_run_keeps_what_every_stage_keeps(spark, planted):
    root, rows, _ = planted
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = tiktoken.load.load_tiktoken_bpe(path)
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text_of = {r[0]: r[1] or "" for r in rows}
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, root).collect()}
    assert set(found) == {k for k in text_of if k is None or not (100 <= k < 180 or k in (200, 201, 202, 207))}
    for k, r in found.items():
        ids = list(struct.unpack(f"<{r.n_tokens}I", r.ids))
        assert r.round_trip and coder.encode_ordinary(coder.decode(ids)) == ids
        assert coder.decode(ids) == text_of[k] or k == 206 and not EMAIL.search(coder.decode(ids))


def test_no_rows(spark, planted, tmp_path):
    root, _, _ = planted
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{root}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
