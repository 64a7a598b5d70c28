"""One literal row per pair rule, traps between rules, and the edges of text splitting."""

import json

import pytest

from pairmill.operators import normalize as norm

CUT = "x" * 60 + ". " + "y" * 60

# (row, pair of the current rules, pair of the older rules)
CASES = [
    ({"问": "q", "答": "a"}, ("q", "a"), None),
    ({"Q": 1, "A": {"b": 1, "a": [2]}}, ("1", '{"b":1,"a":[2]}'), None),
    ({"abstract": "ab", "full_text": "ft", "text": "t"}, ("ab", "ft"), None),
    ({"abstract": "ab", "text": "t"}, ("ab", "t"), None),
    ({"abstract": "", "text": "t" * 20}, ("t" * 10, "t" * 10), ("t" * 10, "t" * 10)),
    ({"abstract": 0, "text": "t" * 20}, ("t" * 10, "t" * 10), ("t" * 10, "t" * 10)),
    ({"abstract": "0", "text": "t"}, ("0", "t"), None),
    ({"zh": "z", "en": "e"}, ("z", "e"), ("z", "e")),
    ({"prompt": "p", "completion": "c"}, ("p", "c"), ("p", "c")),
    ({"prompt": "p", "completion": "c", "response": "r"}, ("p", "c"), ("p", "r")),
    ({"current_prompt": "p", "response": "r"}, ("p", "r"), ("p", "r")),
    (
        {"responses_create_params": {"input": [
            {"role": "User", "content": "hi"},
            {"role": "user", "content": "u"},
            {"role": "assistant", "content": [{"z": 1, "a": 2}]},
        ]}},
        ("user: hi\nuser: u", '[assistant]: [{"z":1,"a":2}]'),
        None,
    ),
    ({"responses_create_params": {"input": "str"}, "tags": ["x"], "instruction": "i", "output": "o"}, ("i", "o"), ("i", "o")),
    ({"responses_create_params": {"input": []}, "tags": ["x"], "instruction": "i", "output": "o"}, ("system_event: x", "completed"), ("i", "o")),
    ({"z": [1, 2], "b": ["s", "t", "u"], "a": [{"role": "x"}]}, ("system_event: s", "[agent_action]: t\n[system_event]: u"), None),
    ({"z": [], "y": "[1]", "a": [{"role": "x", "content": "c"}]}, ("x: c", "completed"), None),
    ({"meta": {"k": {"messages": [{"from": "human", "value": "v"}]}}, "conversations": []}, ("human: v", "completed"), None),
    ({"x": {"trajectory": [{"uid": "U1", "text": "v"}, {"role": "user", "text": "w"}, 3, "s"]}}, ("u1: v\nuser: w", "[agent_action]: s"), None),
    ({"x": {"late": {"messages": [{"content": "deep"}]}, "messages": [{"content": "near"}]}}, ("turn: near", "completed"), None),
    ({"x": {"messages": [1, {"role": "human", "content": "h"}, {"role": "human", "content": "k"}]}}, ("human: h", "[human]: k"), None),
    ({"messages": "foo", "instruction": "i", "input": "in", "output": "o"}, ("i\n\nContext: in", "o"), ("i\n\nContext: in", "o")),
    ({"messages": [1, 2], "text": "t" * 12}, ("t" * 6, "t" * 6), ("t" * 6, "t" * 6)),
    ({"instruction": "i", "input": "", "output": "o"}, ("i", "o"), ("i", "o")),
    ({"instruction": "i", "input": {"a": 1}, "output": "o"}, ("i", "o"), ('i\n\nContext: {"a":1}', "o")),
    ({"tags": ["x"], "instruction": "i", "output": "o"}, ("system_event: x", "completed"), ("i", "o")),
    ({"prompt": "p", "response": "r"}, ("p", "r"), ("p", "r")),
    ({"question": "p", "answer": "r"}, ("p", "r"), ("p", "r")),
    ({"role": "p", "content": "r"}, ("p", "r"), None),
    ({"text": "a" * 10}, None, None),
    ({"text": "a" * 11}, ("a" * 5, "a" * 6), ("a" * 5, "a" * 6)),
    ({"text": "a" * 50 + " " + "b" * 49}, ("a" * 50, "b" * 49), ("a" * 50, " " + "b" * 49)),
    ({"text": "x" * 101}, ("x" * 50, "x" * 51), ("x" * 50, "x" * 51)),
    ({"text": CUT}, ("x" * 60 + ".", "y" * 60), (CUT[:61], CUT[61:])),
    ({"text": "a." + "b" * 120 + "\n" + "c" * 30}, ("a." + "b" * 120, "c" * 30), ("a." + "b" * 74, "b" * 46 + "\n" + "c" * 30)),
    ({"text": "😀" * 60 + "。" + "é" * 60}, ("😀" * 60 + "。", "é" * 60), ("😀" * 60, "。" + "é" * 60)),
    ({"text": "z" * 200 + "!" + "z" * 399}, ("z" * 200 + "!", "z" * 399), ("z" * 200 + "!" + "z" * 99, "z" * 300)),
    # the window reaches from 150 to 449: a break just outside is not seen, one on its edge is
    ({"text": "w" * 149 + "?" + "w" * 450}, ("w" * 149 + "?" + "w" * 150, "w" * 300), ("w" * 149 + "?" + "w" * 150, "w" * 300)),
    ({"text": "w" * 150 + "?" + "w" * 449}, ("w" * 150 + "?", "w" * 449), ("w" * 150 + "?" + "w" * 149, "w" * 300)),
    ({"text": "w" * 449 + "?" + "w" * 150}, ("w" * 449 + "?", "w" * 150), ("w" * 300, "w" * 149 + "?" + "w" * 150)),
    ({"text": "w" * 450 + "?" + "w" * 149}, ("w" * 300, "w" * 150 + "?" + "w" * 149), ("w" * 300, "w" * 150 + "?" + "w" * 149)),
    # a full stop late in the window loses to a line break early in it, whatever lies nearer
    ({"text": "v" * 200 + "\n" + "v" * 99 + "." + "v" * 299}, ("v" * 200, "v" * 99 + "." + "v" * 299), ("v" * 200 + "\n" + "v" * 99, "." + "v" * 299)),
    ({"text": " " * 120 + "\n" + " " * 10}, ("", ""), (" " * 65, " " * 55 + "\n" + " " * 10)),
    ({"a": {"b": "long enough string"}, "c": "short"}, ("long enou", "gh string"), ("long enou", "gh string")),
    ({"a": "tie tie tie 1", "b": "tie tie tie 2"}, ("tie ti", "e tie 1"), ("tie ti", "e tie 1")),
    ({"a": {"b": ["tie tie tie 1"]}, "b": "tie tie tie 2"}, ("tie ti", "e tie 1"), ("tie ti", "e tie 1")),
    ({"n": 12345678901234, "s": "eleven char"}, ("eleve", "n char"), ("eleve", "n char")),
    ({"text": json.dumps({"Q": "qq", "A": "aa"})}, ("qq", "aa"), ('{"Q": "qq",', ' "A": "aa"}')),
    ({"text": '  {"messages": [{"role": "user", "content": "c"}]}\n'}, ("user: c", "completed"), ('  {"messages": [{"role": ', '"user", "content": "c"}]}\n')),
    ({"text": "{not json at all, but long}"}, ("{not json at", "all, but long}"), ("{not json at ", "all, but long}")),
    ({"text": '{"a":1} trailing'}, ('{"a":1}', "trailing"), ('{"a":1} ', "trailing")),
    ({"text": '{"a":1}{"b":2}'}, ('{"a":1}', '{"b":2}'), ('{"a":1}', '{"b":2}')),
    ({"Q": "", "A": "x"}, ("", "x"), None),
    ({"Q": None, "A": "x", "text": "some longer text"}, ("some lon", "ger text"), ("some lon", "ger text")),
    ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}, {"role": "gpt", "content": "g"}, {"role": "bot", "content": "b"}]},
     ("system: s\nuser: u", "[gpt]: g\n[bot]: b"), ("system: s", "b")),
    ({"messages": [{"role": "tool", "content": "t" * 12}, {"role": "user", "content": "u"}]}, ("tool: " + "t" * 12 + "\nuser: u", "completed"), ("t" * 6, "t" * 6)),
    ({"messages": [{"role": "user", "content": "u"}], "prompt": "p", "response": "r"}, ("user: u", "completed"), ("p", "r")),
]


def _fits(found, wanted):
    if wanted is None or found is None:
        return found is wanted
    return tuple(found[:2]) == wanted


def _pairs(spark, version):
    raws = [(i, json.dumps(case[0], ensure_ascii=False)) for i, case in enumerate(CASES)]
    df = spark.createDataFrame(raws, "id int, raw string")
    rows = norm.normalize_pairs(df, version=version).select("id", "pair").collect()
    return {r.id: r.pair and tuple(r.pair) for r in rows}


@pytest.mark.parametrize("version, place", [("v2", 1), ("v1", 2)])
def test_rule_table(spark, version, place):
    found = _pairs(spark, version)
    wrong = [(CASES[i][0], pair, CASES[i][place]) for i, pair in found.items() if not _fits(pair, CASES[i][place])]
    assert not wrong


def test_unreadable_rows_give_no_pair_and_end_in_quarantine(spark):
    rows = [(0, "{bad"), (1, "[1,2]"), (2, "{}"), (3, '{"Q":"","A":"x"}'), (4, '{"Q":"q","A":"a"}'), (5, None), (6, '{"Q":"q","A":"a"} x')]
    made = norm.normalize_pairs(spark.createDataFrame(rows, "id int, raw string"))
    reasons = {r.id: r.reason for r in norm.quarantine(made).collect()}
    assert reasons == {0: "not an object", 1: "not an object", 2: "no rule", 3: "empty side", 5: "not an object", 6: "not an object"}


@pytest.mark.parametrize("version", ["v2", "v1"])
def test_declared_struct_gives_the_same_pairs_as_json_text(spark, version):
    """Each row read with the schema of its own JSON, so that field order is row order."""
    from pyspark.sql import functions as F

    expected = _pairs(spark, version)
    skipped = 0
    for i, (row, *_rest) in enumerate(CASES):
        text = json.dumps(row, ensure_ascii=False)
        if any(mark in text for mark in ("3, ", "[1, {", "null", '"a": [2]', '"z": 1', "[]")):
            skipped += 1  # mixed lists and nulls have no declared form
            continue
        if i % (2 if version == "v2" else 6):
            continue  # one plan per row is slow; whole tables run in test_queries
        schema = _schema_of(row)
        df = spark.createDataFrame([(text,)], "raw string").select(F.from_json("raw", schema).alias("row"))
        pair = norm.normalize_struct(df, "row", version).select("pair").first().pair
        assert (pair and tuple(pair)) == expected[i], row
    assert skipped < len(CASES) / 2


def _schema_of(value):
    from pyspark.sql import types as T

    if isinstance(value, dict):
        return T.StructType([T.StructField(k, _schema_of(v)) for k, v in value.items()])
    if isinstance(value, list):
        merged = {}
        for item in value:
            if isinstance(item, dict):
                merged.update({k: _schema_of(v) for k, v in item.items()})
        if merged:
            return T.ArrayType(T.StructType([T.StructField(k, t) for k, t in merged.items()]))
        return T.ArrayType(_schema_of(value[0]) if value else T.StringType())
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.LongType()
    return T.StringType()


def test_fold_of_exploded_turns(spark):
    rows = [
        ("a", 5, "User", "u"), ("a", 1, "system", "s"), ("a", 9, "assistant", "x"), ("a", 10, "tool", "y"),
        ("b", 0, "user", "only"), ("c", 0, "assistant", "first"), ("c", 1, "assistant", ""),
    ]
    turns = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    v2 = {r.conv_id: (r.prompt, r.response) for r in norm.fold_conversation_v2(turns).collect()}
    assert v2 == {
        "a": ("system: s\nuser: u", "[assistant]: x\n[tool]: y"),
        "b": ("user: only", "completed"),
        "c": ("assistant: first", "[assistant]: "),
    }
    v1 = {r.conv_id: (r.prompt, r.response) for r in norm.fold_conversation_v1(turns).collect()}
    assert v1 == {"a": ("system: s", "x")}


def test_hostile_texts_neither_pass_nor_end_the_job(spark):
    good = ['{"Q":"a","A":"b"}', ' {"Q":"a]","A":"b"} ', '{"Q":"a","A":"b","x":[1]}']
    bad = ['{"Q":"a","A":"b"}] garbage', '{"Q":"a","A":"b"}]', '{"Q":"a","A":"b"}} x', '{"Q":"a","A":"b"}, "w":[1]']
    odd = ['{"x":{"messages":"\\ud800"},"y":-INF}', '{"x":{"y":"' + "z" * 40 + '\\ud800"}}', '{"x":{"messages":[1]}}]']
    rows = spark.createDataFrame([(t,) for t in good + bad + odd], "raw string")
    for version in ("v2", "v1"):
        made = norm.normalize_pairs(rows, version=version)
        got = {r.raw: r.pair for r in made.collect()}
        assert not any(got[t] and (got[t].prompt, got[t].response) == ("a", "b") for t in bad)
        assert norm.quarantine(made).count() >= len(bad)
        if version == "v2":
            assert all((got[t].prompt.rstrip("]"), got[t].response) == ("a", "b") for t in good)
