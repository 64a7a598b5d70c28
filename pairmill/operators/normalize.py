"""Raw rows of any shape to (prompt, response) pairs.

The rules form an ordered ladder; the first that matches decides, even when one of its sides
is empty (``drop_empty_pairs`` removes such pairs later). Every rule is a ``when`` branch over
a row view, so a row walks down the ladder inside one projection and nothing shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmill.functions.text import let, split_break, split_mid
from pairmill.operators.once import compute_once
from pairmill.operators.rows import (
    DEFAULT_ROLE,
    NESTED_KEYS,
    STRICT,
    JsonRow,
    StructRow,
    json_messages,
    object_texts,
    spelled_object,
)

# Roles that may join or open a prompt, roles that answer, and the filler for
# a conversation without an answer.
OPENING_ROLES_V2 = ("user", "human", "prompter")
OPENING_ROLES_V1 = ("system", "user", "human", "prompter")
ANSWER_ROLES_V1 = ("assistant", "bot", "model", "gpt")
NO_RESPONSE = "completed"
CONTEXT_PREFIX = "\n\nContext: "
NESTED_KEYS_V1 = NESTED_KEYS[:2]


def _pair(prompt: Column, response: Column, rule: str) -> Column:
    return F.struct(prompt.alias("prompt"), response.alias("response"), F.lit(rule).alias("rule"))


def _named(halves: Column, rule: str) -> Column:
    return let(halves, lambda h: F.when(h.isNotNull(), _pair(h["prompt"], h["response"], rule)))


def _both(row, left: str, right: str, rule: str) -> Column:
    a, b = row.text(left), row.text(right)
    return F.when(a.isNotNull() & b.isNotNull(), _pair(a, b, rule))


def _abstract_body(row) -> Column:
    full = row.text("full_text").isNotNull()
    body = F.coalesce(row.text("full_text"), row.text("text"))
    filled = F.when(full, row.filled("full_text")).otherwise(row.filled("text"))
    return F.when(row.filled("abstract") & filled, _pair(row.text("abstract"), body, "abstract_body"))


def _instruction(row, any_context: bool) -> Column:
    use = row.filled("input") if any_context else row.filled("input") & row.is_string("input")
    prompt = F.when(
        use, F.concat(row.text("instruction"), F.lit(CONTEXT_PREFIX), row.text("input"))
    ).otherwise(row.text("instruction"))
    return F.when(
        row.text("instruction").isNotNull() & row.text("output").isNotNull(),
        _pair(prompt, row.text("output"), "instruction"),
    )


def fold_v2(messages: Column) -> Column:
    """Opening message (and a user message right after it) against all the rest."""

    def opens(m: Column) -> Column:
        return (m["pos"] == 0) | ((m["pos"] == 1) & m["role"].isin(*OPENING_ROLES_V2))

    def fold(ms: Column) -> Column:
        head = F.transform(F.filter(ms, opens), lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
        tail = F.transform(
            F.filter(ms, lambda m: ~opens(m)),
            lambda m: F.concat(F.lit("["), m["role"], F.lit("]: "), m["content"]),
        )
        answer = F.when(F.size(tail) > 0, F.array_join(tail, "\n")).otherwise(F.lit(NO_RESPONSE))
        return F.when(F.size(head) > 0, _pair(F.array_join(head, "\n"), answer, "conversation"))

    return let(messages, fold)


def fold_v1(messages: Column) -> Column:
    """First opening message against the last answering one; string messages do not count."""

    def fold(ms: Column) -> Column:
        first = F.get(F.filter(ms, lambda m: m["role"].isin(*OPENING_ROLES_V1)), F.lit(0))
        answers = F.filter(ms, lambda m: m["role"].isin(*ANSWER_ROLES_V1))
        last = F.try_element_at(answers, F.lit(-1))["content"]
        return F.when(
            first.isNotNull() & last.isNotNull() & (last != ""),
            _pair(F.concat(first["role"], F.lit(": "), first["content"]), last, "conversation"),
        )

    return let(messages, fold)


def _early_v2(row) -> Column:
    return F.coalesce(
        _both(row, "问", "答", "zh_qa"),
        _both(row, "Q", "A", "q_a"),
        _abstract_body(row),
        _both(row, "zh", "en", "translation"),
        _both(row, "prompt", "completion", "prompt_completion"),
        _both(row, "current_prompt", "response", "current_prompt"),
    )


def _late_v2(row) -> Column:
    return F.coalesce(
        _instruction(row, any_context=False),
        _both(row, "prompt", "response", "prompt_response"),
        _both(row, "question", "answer", "question_answer"),
        _both(row, "role", "content", "role_content"),
        _named(split_break(row.text("text")), "text_split"),
    )


def _late_v1(row) -> Column:
    return F.coalesce(
        _instruction(row, any_context=True),
        _both(row, "prompt", "response", "prompt_response"),
        _both(row, "question", "answer", "question_answer"),
        _both(row, "prompt", "completion", "prompt_completion"),
        _both(row, "current_prompt", "response", "current_prompt"),
        _both(row, "zh", "en", "translation"),
        _named(split_mid(row.text("text")), "text_split"),
    )


def _longest(row) -> Column:
    return _named(split_mid(row.longest()), "longest_string")


def _json_pair_v2(df: DataFrame) -> DataFrame:
    row = JsonRow()
    from_params, param_list = row.parameter_input()
    df = compute_once(df, {"_early": _early_v2(row)})
    unmatched = F.col("_early").isNull()
    df = compute_once(
        df,
        {
            "_params": F.when(unmatched, F.coalesce(from_params, F.lit(False))),
            "_list": F.when(
                unmatched, F.when(from_params, param_list).otherwise(row.first_list())
            ),
        },
    )
    # a list that opens with a string or an object always folds; only a parameter list may not
    unmatched = unmatched & (F.col("_list").isNull() | (F.col("_params") & ~row.params_open()))
    df = compute_once(df, {"_late": F.when(unmatched, _late_v2(row))})
    hidden = ~F.col("_params") & row.may_nest(NESTED_KEYS)
    leafless = F.col("_late").isNull() & ~row.is_flat()
    df = JsonRow.attach_nested(df, unmatched & (hidden | leafless), NESTED_KEYS)
    nested = F.when(~F.col("_params") & row.nested_found(), row.nested_list())
    folded = fold_v2(json_messages(F.coalesce(F.col("_list"), nested)))
    pair = F.coalesce(
        F.col("_early"),
        F.when(F.col("_early").isNull(), folded),
        F.col("_late"),
        F.when(unmatched, _longest(row)),
    )
    return compute_once(df, {"pair": pair}).drop("_early", "_params", "_list", "_late")


def _json_pair_v1(df: DataFrame) -> DataFrame:
    row = JsonRow()
    df = compute_once(df, {"_late": _late_v1(row)})
    unsettled = row.may_nest(NESTED_KEYS_V1) | (F.col("_late").isNull() & ~row.is_flat())
    df = JsonRow.attach_nested(df, unsettled, NESTED_KEYS_V1)
    listed = F.col(JsonRow.nested)["list_text"]
    long_enough = F.json_array_length(listed) >= 2
    folded = F.when(row.nested_found() & long_enough, fold_v1(json_objects_v1(listed)))
    return compute_once(df, {"pair": F.coalesce(folded, F.col("_late"), _longest(row))}).drop("_late")


def json_objects_v1(list_text: Column) -> Column:
    """Object messages with the older, shorter key lists (no ``uid``, no ``text``)."""
    fields = "role string, from string, content string, value string"
    texts = F.from_json(list_text, "array<string>", STRICT)
    kinds = F.from_json(list_text, "array<variant>", STRICT)
    opened = F.transform(
        F.filter(
            F.arrays_zip(texts.alias("text"), kinds.alias("kind")),
            lambda e: F.schema_of_variant(e["kind"]).startswith("OBJECT"),
        ),
        lambda e: F.from_json(e["text"], fields, STRICT),
    )
    return F.transform(
        opened,
        lambda o: F.struct(
            F.lower(F.coalesce(o["role"], o["from"], F.lit(""))).alias("role"),
            F.coalesce(o["content"], o["value"], F.lit("")).alias("content"),
        ),
    )


def normalize_pairs(df: DataFrame, raw: str = "raw", version: str = "v2") -> DataFrame:
    """Add ``pair`` to rows that hold JSON text in ``raw``; NULL where no rule fits."""
    made = JsonRow.attach(df, raw, unpack=version == "v2")
    made = _json_pair_v2(made) if version == "v2" else _json_pair_v1(made)
    return made.drop(*JsonRow.columns)


def _struct_pair(row: StructRow, version: str) -> Column:
    if version == "v1":
        found, messages = row.nested(NESTED_KEYS_V1)
        folded = F.when(found & (F.size(messages) >= 2), fold_v1(messages))
        return F.coalesce(folded, _late_v1(row), _longest(row))
    from_params, param_messages = row.parameter_input()
    found, messages = row.nested(NESTED_KEYS)
    listed = row.first_list_messages()
    folded = fold_v2(
        F.when(from_params, param_messages).otherwise(F.coalesce(listed, F.when(found, messages)))
    )
    return F.coalesce(_early_v2(row), folded, _late_v2(row), _longest(row))


def normalize_struct(df: DataFrame, column: str, version: str = "v2") -> DataFrame:
    """Add ``pair`` to rows with a declared struct column.

    Nothing is parsed but a ``text`` field that spells out an object, which the current rules
    put in place of the row; such rows take the JSON form of the same ladder.
    """
    schema = df.schema[column].dataType
    if not isinstance(schema, T.StructType):
        raise TypeError(f"{column} is not a struct")
    pair = _struct_pair(StructRow(schema, F.col(column)), version)
    if version == "v1" or "text" not in schema.names or schema["text"].dataType != T.StringType():
        return compute_once(df, {"pair": pair})
    df = compute_once(df, {"_inner": spelled_object(F.col(column)["text"])})
    df = _json_pair_v2(JsonRow.attach(df, "_inner", unpack=False)).drop(*JsonRow.columns)
    replaced = F.col("_inner").isNotNull()
    pair = F.when(replaced, F.col("pair")).otherwise(F.when(~replaced, pair))
    return compute_once(df, {"pair": pair}).drop("_inner")


def unpack_embedded_json(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Replace a row by the object its ``text`` field spells out, where it spells one out."""
    made = JsonRow.attach(df, raw, unpack=True)
    body = F.coalesce(F.col(JsonRow.body), F.col(raw))
    return made.withColumn(raw, body).drop(*JsonRow.columns)


def pair_columns(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {name: F.col(f"pair.{name}") for name in ("prompt", "response", "rule")}
    ).drop("pair")


def drop_empty_pairs(df: DataFrame) -> DataFrame:
    return df.where((F.length("prompt") > 0) & (F.length("response") > 0))


def quarantine(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Rows the ladder leaves without a pair, and why."""
    readable = object_texts(F.col(raw)).isNotNull()
    reason = (
        F.when(F.col("pair").isNull() & ~readable, "not an object")
        .when(F.col("pair").isNull(), "no rule")
        .when((F.col("pair.prompt") == "") | (F.col("pair.response") == ""), "empty side")
    )
    return df.withColumn("reason", reason).where(F.col("reason").isNotNull())


def fold_conversation_v2(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """One pair per conversation from exploded turns.

    The result row holds the conversation's whole text, so this form is for conversations that
    fit a row. ``conversations.fold_to_tokens`` gives the same tokens for one of any length.
    A turn without a role is a ``turn``; one without a text is empty.
    """
    role = F.coalesce(F.lower("role"), F.lit(DEFAULT_ROLE))
    text = F.coalesce("text", F.lit(""))
    listed = turns.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order), role.alias("role"), text.alias("text")))).alias("_turns")
    )
    messages = F.transform(
        "_turns",
        lambda t, i: F.struct(i.alias("pos"), t["role"].alias("role"), t["text"].alias("content")),
    )
    return pair_columns(compute_once(listed, {"pair": fold_v2(messages)}).drop("_turns"))


def fold_conversation_v1(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """First opening and last answering turn: two keyed extremes, no list is ever built."""
    role = F.lower("role")
    asked, answered = role.isin(*OPENING_ROLES_V1), role.isin(*ANSWER_ROLES_V1)
    folded = turns.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by(
            F.when(asked, F.concat(role, F.lit(": "), F.col("text"))), F.when(asked, F.col(order))
        ).alias("prompt"),
        F.max_by(F.when(answered, F.col("text")), F.when(answered, F.col(order))).alias("response"),
    )
    return folded.where(
        (F.col("_n") >= 2) & F.col("prompt").isNotNull() & (F.length("response") > 0)
    ).drop("_n")
