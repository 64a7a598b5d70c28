"""Row normalization: every pair rule alone, then both ladders over all shapes at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairmill.functions import text as text_fn
from pairmill.operators import normalize as norm
from pairmill.registry.base import ORACLES, SQL_CUT_DOCS, SQL_FOLDED, documents, query, sql_tokens, table

def _cols():
    return F.col("text"), F.col("source"), F.col("lang")


def _object(**fields):
    return F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]))


def _turns(*messages):
    return F.array(*[F.struct(*[v.alias(k) for k, v in m.items()]) for m in messages])


def _from_docs(spark, sf_dir, raw, version="v2"):
    docs = documents(spark, sf_dir).select("doc_id", raw.alias("raw"))
    made = norm.pair_columns(norm.normalize_pairs(docs, "raw", version))
    return made.select("doc_id", "prompt", "response", "rule")


def _simple(name, rule, raw, prompt="text", response="source"):
    @query(
        name,
        f"SELECT doc_id, {prompt} AS prompt, {response} AS response, '{rule}' AS rule FROM documents",
    )
    def run(spark, sf_dir):
        return _from_docs(spark, sf_dir, raw(*_cols()))

    return run


_simple("pair_zh_qa", "zh_qa", lambda T, S, L: _object(问=T, 答=S, zh=L, en=L))
_simple("pair_q_a", "q_a", lambda T, S, L: _object(A=S, Q=T, text=L))
_simple("pair_translation", "translation", lambda T, S, L: _object(zh=T, en=S, prompt=L, completion=L))
_simple("pair_prompt_completion", "prompt_completion", lambda T, S, L: _object(prompt=T, completion=S, response=L))
_simple("pair_current_prompt", "current_prompt", lambda T, S, L: _object(prompt=L, current_prompt=T, response=S))
_simple("pair_prompt_response", "prompt_response", lambda T, S, L: _object(prompt=T, response=S, answer=L))
_simple("pair_question_answer", "question_answer", lambda T, S, L: _object(question=T, answer=S, text=L))
_simple("pair_role_content", "role_content", lambda T, S, L: _object(content=T, role=S), "source", "text")


@query(
    "pair_abstract_body",
    f"""WITH {SQL_CUT_DOCS} SELECT doc_id,
      CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN source ELSE sp END AS prompt,
      CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN lang ELSE sr END AS response,
      CASE WHEN doc_id % 3 < 2 THEN 'abstract_body' WHEN sp IS NOT NULL THEN 'text_split' END AS rule
    FROM cut_docs""",
)
def pair_abstract_body(spark, sf_dir):
    T, S, L = _cols()
    raw = (
        F.when(F.col("doc_id") % 3 == 0, _object(abstract=S, text=T))
        .when(F.col("doc_id") % 3 == 1, _object(text=T, full_text=L, abstract=S))
        .otherwise(_object(abstract=F.lit(""), text=T))
    )
    return _from_docs(spark, sf_dir, raw)


@query(
    "pair_instruction",
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text || chr(10) || chr(10) || 'Context: ' || lang
         ELSE text END AS prompt, source AS response, 'instruction' AS rule FROM documents""",
)
def pair_instruction(spark, sf_dir):
    T, S, L = _cols()
    raw = (
        F.when(F.col("doc_id") % 3 == 0, _object(instruction=T, input=L, output=S))
        .when(F.col("doc_id") % 3 == 1, _object(instruction=T, input=F.lit(""), output=S))
        .otherwise(_object(instruction=T, input=F.struct(L), output=S))
    )
    return _from_docs(spark, sf_dir, raw)


@query(
    "text_split_break",
    f"""WITH {SQL_CUT_DOCS} SELECT doc_id, sp AS prompt, sr AS response,
      CASE WHEN sp IS NOT NULL THEN 'text_split' END AS rule FROM cut_docs""",
)
def text_split_break(spark, sf_dir):
    T, S, L = _cols()
    return _from_docs(spark, sf_dir, _object(text=T))


@query("text_split_mid", f"WITH {SQL_CUT_DOCS} SELECT doc_id, mp AS prompt, mr AS response FROM cut_docs")
def text_split_mid(spark, sf_dir):
    T, S, L = _cols()
    docs = documents(spark, sf_dir)
    halves = docs.select("doc_id", text_fn.split_mid(T).alias("pair"))
    return halves.select("doc_id", "pair.prompt", "pair.response")


@query(
    "longest_string_split",
    f"""WITH {SQL_CUT_DOCS} SELECT doc_id, mp AS prompt, mr AS response,
      CASE WHEN mp IS NOT NULL THEN 'longest_string' END AS rule FROM cut_docs""",
)
def longest_string_split(spark, sf_dir):
    T, S, L = _cols()
    raw = F.when(F.col("doc_id") % 2 == 0, _object(code=T, path=S)).otherwise(
        _object(path=S, file=F.struct(L, F.struct(T.alias("code")).alias("inner")))
    )
    return _from_docs(spark, sf_dir, raw)


@query("longest_leaf", "SELECT doc_id, CASE WHEN length(text) > length(source) THEN text ELSE source END AS leaf FROM documents")
def longest_leaf(spark, sf_dir):
    T, S, L = _cols()
    from pairmill.operators.rows import StructRow

    docs = documents(spark, sf_dir).select(
        "doc_id", F.struct(S, F.struct(L, F.array(T).alias("parts")).alias("inner")).alias("row")
    )
    return docs.select("doc_id", StructRow(docs.schema["row"].dataType, F.col("row")).longest().alias("leaf"))


@query(
    "unpack_embedded_json",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN '{"text":' || cast(to_json('{' || text) AS VARCHAR) || '}'
       ELSE '{"body":' || cast(to_json(text) AS VARCHAR) || ',"source":"' || source || '"}' END AS raw
       FROM documents""",
)
def unpack_embedded_json(spark, sf_dir):
    T, S, L = _cols()
    inner = _object(body=T, source=S)
    raw = (
        F.when(F.col("doc_id") % 3 == 0, inner)
        .when(F.col("doc_id") % 3 == 1, _object(text=inner, extra=L))
        .otherwise(_object(text=F.concat(F.lit("{"), T)))
    )
    docs = documents(spark, sf_dir).select("doc_id", raw.alias("raw"))
    return norm.unpack_embedded_json(docs)


@query(
    "drop_empty_pairs",
    f"""WITH {SQL_CUT_DOCS} SELECT doc_id, sp AS prompt, sr AS response FROM cut_docs
        WHERE length(sp) > 0 AND length(sr) > 0""",
)
def drop_empty_pairs(spark, sf_dir):
    T, S, L = _cols()
    made = _from_docs(spark, sf_dir, _object(text=T)).drop("rule")
    return norm.drop_empty_pairs(made)


@query(
    "row_quarantine",
    f"""WITH {SQL_CUT_DOCS}, judged AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'not an object'
        WHEN doc_id % 5 = 1 OR sp = '' OR sr = '' THEN 'empty side' WHEN sp IS NULL THEN 'no rule' END AS reason
      FROM cut_docs) SELECT doc_id, reason FROM judged WHERE reason IS NOT NULL""",
)
def row_quarantine(spark, sf_dir):
    T, S, L = _cols()
    raw = (
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("{"), T))
        .when(F.col("doc_id") % 5 == 1, _object(Q=T, A=F.lit("")))
        .otherwise(_object(text=T))
    )
    docs = documents(spark, sf_dir).select("doc_id", raw.alias("raw"))
    return norm.quarantine(norm.normalize_pairs(docs)).select("doc_id", "reason")


# ------------------------------------------------------------------ conversations

_FOLDED = f"WITH {SQL_FOLDED} SELECT conv_id, prompt, response FROM folded"


@query("fold_conversation_v2", _FOLDED)
def fold_conversation_v2(spark, sf_dir):
    made = norm.fold_conversation_v2(table(spark, sf_dir, "conversations"))
    return made.select("conv_id", "prompt", "response")


@query(
    "fold_conversation_v1",
    """WITH c AS (SELECT *, lower(role) AS r FROM conversations),
    f AS (SELECT conv_id, count(*) AS n,
      min_by(r || ': ' || text, turn) FILTER (WHERE r IN ('system', 'user', 'human', 'prompter')) AS prompt,
      max_by(text, turn) FILTER (WHERE r IN ('assistant', 'bot', 'model', 'gpt')) AS response
      FROM c GROUP BY conv_id)
    SELECT conv_id, prompt, response FROM f WHERE n >= 2 AND prompt IS NOT NULL AND length(response) > 0""",
)
def fold_conversation_v1(spark, sf_dir):
    return norm.fold_conversation_v1(table(spark, sf_dir, "conversations"))


@query(
    "fold_conversation_tokens",
    f"""WITH {SQL_FOLDED} SELECT conv_id, array_to_string(({sql_tokens('prompt')})[:2048], ' ') AS prompt,
      array_to_string(({sql_tokens('response')})[:2048], ' ') AS response FROM folded""",
)
def fold_conversation_tokens(spark, sf_dir):
    from pairmill.operators.conversations import fold_to_tokens

    made = fold_to_tokens(table(spark, sf_dir, "conversations"))
    return made.select("conv_id", *[F.array_join(c, " ").alias(c) for c in ("prompt", "response")])


def _conversation_rows(spark, sf_dir, role, content):
    turns = table(spark, sf_dir, "conversations")
    listed = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    messages = F.transform("turns", lambda t: F.struct(t["role"].alias(role), t["text"].alias(content)))
    return listed.select("conv_id", messages.alias("m"), F.size("turns").alias("n"))


def _fold_json(spark, sf_dir, raw, role="role", content="content"):
    rows = _conversation_rows(spark, sf_dir, role, content).select("conv_id", raw.alias("raw"))
    made = norm.pair_columns(norm.normalize_pairs(rows))
    return made.select("conv_id", "prompt", "response")


@query("msgs_rl_params", _FOLDED)
def msgs_rl_params(spark, sf_dir):
    raw = _object(tags=F.array(F.lit("x")), responses_create_params=F.struct(F.col("m").alias("input")))
    return _fold_json(spark, sf_dir, raw)


@query("msgs_first_list", _FOLDED)
def msgs_first_list(spark, sf_dir):
    raw = _object(scores=F.array("n"), zlist=F.col("m"), alist=F.array(F.lit("late")), instruction=F.lit("i"))
    return _fold_json(spark, sf_dir, raw, "from", "value")


@query("msgs_recursive_key", _FOLDED)
def msgs_recursive_key(spark, sf_dir):
    """Nested under three different keys; half of the rows hold an emptier list further down."""
    deep = F.struct(F.struct(F.col("m").alias("messages")).alias("z"), F.lit("x").alias("note"))
    other = F.struct(F.struct(F.array().cast("array<string>").alias("messages")).alias("late"))
    raw = (
        F.when(F.col("conv_id") % 3 == 0, _object(meta=deep, tail=other))
        .when(F.col("conv_id") % 3 == 1, _object(meta=F.struct(F.col("m").alias("conversations"))))
        .otherwise(_object(meta=F.struct(F.struct(F.col("m").alias("trajectory")).alias("run"))))
    )
    return _fold_json(spark, sf_dir, raw, "uid", "text")


@query("union_configs", """SELECT 'doc' AS kind, doc_id AS row_id, text, lang, NULL AS role FROM documents
    UNION ALL SELECT 'turn', conv_id, text, NULL, role FROM conversations""")
def union_configs(spark, sf_dir):
    from pairmill.sources.catalog import union_configs as union

    docs = documents(spark, sf_dir).select(
        F.lit("doc").alias("kind"), F.col("doc_id").alias("row_id"), "text", "lang"
    )
    turns = table(spark, sf_dir, "conversations").select(
        F.lit("turn").alias("kind"), F.col("conv_id").alias("row_id"), "text", "role"
    )
    return union([docs, turns])


@query(
    "union_conflicting",
    """SELECT doc_id, cast(n_chars AS DOUBLE) AS n, CASE doc_id % 3 WHEN 0 THEN '"' || lang || '"'
      WHEN 1 THEN '{"lang":"' || lang || '","source":"' || source || '"}' ELSE '["' || lang || '","' || source || '"]' END AS meta,
      CASE WHEN doc_id % 3 > 0 THEN lang END AS inner_lang, CASE WHEN doc_id % 3 = 2 THEN n_chars END AS inner_n,
      CASE WHEN doc_id % 3 = 1 THEN cast(doc_id AS DOUBLE) / 2 WHEN doc_id % 3 = 2 THEN doc_id END AS half FROM documents""",
)
def union_conflicting(spark, sf_dir):
    """Three configs: a value as text, object and list; a number as INT, BIGINT and DOUBLE; structs of other fields."""
    from pairmill.sources.lattice import union_conflicting as union

    docs = table(spark, sf_dir, "documents")
    third = lambda k: docs.where(F.col("doc_id") % 3 == k)
    parts = [
        third(0).select("doc_id", F.col("n_chars").cast("int").alias("n"), F.col("lang").alias("meta")),
        third(1).select(
            "doc_id", F.col("n_chars").cast("bigint").alias("n"), F.struct("lang", "source").alias("meta"),
            F.struct("lang", (F.col("doc_id") / F.lit(2.0)).alias("half")).alias("inner"),
        ),
        third(2).select(
            "doc_id", F.col("n_chars").cast("double").alias("n"), F.array("lang", "source").alias("meta"),
            F.struct(F.col("n_chars").cast("bigint").alias("n"), F.col("doc_id").alias("half"), "lang").alias("inner"),
        ),
    ]
    made = union(parts)
    return made.select(
        "doc_id", "n", F.to_json("meta").alias("meta"), F.col("inner.lang").alias("inner_lang"),
        F.col("inner.n").alias("inner_n"), F.col("inner.half").alias("half"),
    )


# ------------------------------------------------------------------ whole ladders

def _shapes():
    T, S, L = _cols()
    user, bot = F.lit("user"), F.lit("assistant")
    return (
        _object(问=T, 答=S),
        _object(Q=T, A=S),
        _object(abstract=S, full_text=T, text=L),
        _object(abstract=F.lit(""), text=T),
        _object(zh=T, en=S),
        _object(prompt=T, completion=S),
        _object(current_prompt=T, response=S),
        _object(
            responses_create_params=F.struct(
                _turns({"role": user, "content": T}, {"role": bot, "content": S}).alias("input")
            )
        ),
        _object(
            meta=L, turns=_turns({"from": F.lit("Human"), "value": T}, {"from": F.lit("gpt"), "value": S})
        ),
        _object(tags=F.array(T, S), instruction=L, output=L),
        _object(
            info=F.struct(F.struct(_turns({"role": user, "content": T}).alias("messages")).alias("inner"))
        ),
        _object(instruction=T, input=L, output=S),
        _object(prompt=T, response=S),
        _object(question=T, answer=S),
        _object(role=S, content=T),
        _object(text=T),
        _object(body=F.struct(T.alias("main"), S.alias("side"))),
        _object(text=_object(Q=T, A=S)),
        _object(
            conversations=_turns({"from": F.lit("human"), "value": T}, {"from": F.lit("gpt"), "value": S})
        ),
    )


def all_shapes():
    shapes = _shapes()
    shape = F.col("doc_id") % len(shapes)
    return F.coalesce(*[F.when(shape == i, raw) for i, raw in enumerate(shapes)])


_V2_PROMPT = """CASE doc_id % 19 WHEN 2 THEN source WHEN 3 THEN sp WHEN 7 THEN 'user: ' || text
  WHEN 8 THEN 'human: ' || text WHEN 9 THEN 'system_event: ' || text WHEN 10 THEN 'user: ' || text
  WHEN 11 THEN text || chr(10) || chr(10) || 'Context: ' || lang WHEN 14 THEN source WHEN 15 THEN sp
  WHEN 16 THEN mp WHEN 18 THEN 'human: ' || text ELSE text END"""
_V2_RESPONSE = """CASE doc_id % 19 WHEN 2 THEN text WHEN 3 THEN sr WHEN 7 THEN '[assistant]: ' || source
  WHEN 8 THEN '[gpt]: ' || source WHEN 9 THEN '[agent_action]: ' || source WHEN 10 THEN 'completed'
  WHEN 14 THEN text WHEN 15 THEN sr WHEN 16 THEN mr WHEN 18 THEN '[gpt]: ' || source ELSE source END"""
_V2_RULE = """CASE doc_id % 19 WHEN 0 THEN 'zh_qa' WHEN 1 THEN 'q_a' WHEN 2 THEN 'abstract_body'
  WHEN 3 THEN CASE WHEN n > 10 THEN 'text_split' END WHEN 4 THEN 'translation' WHEN 5 THEN 'prompt_completion'
  WHEN 6 THEN 'current_prompt' WHEN 11 THEN 'instruction' WHEN 12 THEN 'prompt_response'
  WHEN 13 THEN 'question_answer' WHEN 14 THEN 'role_content' WHEN 15 THEN CASE WHEN n > 10 THEN 'text_split' END
  WHEN 16 THEN CASE WHEN n > 10 THEN 'longest_string' END WHEN 17 THEN 'q_a' ELSE 'conversation' END"""


@query(
    "normalize_pairs_v2",
    f"""WITH {SQL_CUT_DOCS} SELECT doc_id, {_V2_PROMPT} AS prompt, {_V2_RESPONSE} AS response,
        {_V2_RULE} AS rule FROM cut_docs""",
)
def normalize_pairs_v2(spark, sf_dir):
    return _from_docs(spark, sf_dir, all_shapes())


_V1_LEAF = "doc_id % 19 IN (0, 1, 2, 7, 8, 10, 14, 16)"
_V1_TEXT = "doc_id % 19 IN (3, 15)"
_J = """'{"Q":' || cast(to_json(text) AS VARCHAR) || ',"A":"' || source || '"}'"""


@query(
    "normalize_pairs_v1",
    f"""WITH {SQL_CUT_DOCS}, j AS (SELECT *, {_J} AS packed FROM cut_docs)
    SELECT doc_id,
      CASE WHEN {_V1_LEAF} OR {_V1_TEXT} THEN mp WHEN doc_id % 19 = 9 THEN lang
        WHEN doc_id % 19 = 11 THEN text || chr(10) || chr(10) || 'Context: ' || lang
        WHEN doc_id % 19 = 17 THEN substring(packed, 1, length(packed) // 2)
        WHEN doc_id % 19 = 18 THEN 'human: ' || text ELSE text END AS prompt,
      CASE WHEN {_V1_LEAF} OR {_V1_TEXT} THEN mr WHEN doc_id % 19 = 9 THEN lang
        WHEN doc_id % 19 = 17 THEN substring(packed, length(packed) // 2 + 1) ELSE source END AS response,
      CASE WHEN {_V1_LEAF} THEN CASE WHEN n > 10 THEN 'longest_string' END
        WHEN {_V1_TEXT} THEN CASE WHEN n > 10 THEN 'text_split' END
        WHEN doc_id % 19 = 4 THEN 'translation' WHEN doc_id % 19 = 5 THEN 'prompt_completion'
        WHEN doc_id % 19 = 6 THEN 'current_prompt' WHEN doc_id % 19 IN (9, 11) THEN 'instruction'
        WHEN doc_id % 19 = 12 THEN 'prompt_response' WHEN doc_id % 19 = 13 THEN 'question_answer'
        WHEN doc_id % 19 = 17 THEN 'text_split' ELSE 'conversation' END AS rule
    FROM j""",
)
def normalize_pairs_v1(spark, sf_dir):
    return _from_docs(spark, sf_dir, all_shapes(), "v1")


# ------------------------------------------------------------------ declared structs


def typed_shapes():
    """The same shapes as fields of one declared struct, NULL where a shape lacks them."""
    T, S, L = _cols()
    shape = F.col("doc_id") % len(_shapes())

    def only(value, *shapes):
        return F.when(shape.isin(*shapes), value)

    def pair(role, content, *messages):
        return _turns(*[{role: F.lit(r), content: c} for r, c in messages])

    opened = pair("role", "content", ("user", T), ("assistant", S))
    fields = {
        "问": only(T, 0),
        "答": only(S, 0),
        "Q": only(T, 1),
        "A": only(S, 1),
        "abstract": F.when(shape == 2, S).when(shape == 3, F.lit("")),
        "full_text": only(T, 2),
        "text": F.when(shape == 2, L).when(shape.isin(3, 15), T).when(shape == 17, _object(Q=T, A=S)),
        "zh": only(T, 4),
        "en": only(S, 4),
        "prompt": only(T, 5, 12),
        "completion": only(S, 5),
        "current_prompt": only(T, 6),
        "responses_create_params": only(F.struct(opened.alias("input")), 7),
        "turns": only(pair("from", "value", ("Human", T), ("gpt", S)), 8),
        "tags": only(F.array(T, S), 9),
        "info": only(F.struct(F.struct(pair("role", "content", ("user", T)).alias("messages")).alias("inner")), 10),
        "instruction": F.when(shape == 9, L).when(shape == 11, T),
        "input": only(L, 11),
        "output": F.when(shape == 9, L).when(shape == 11, S),
        "response": only(S, 6, 12),
        "question": only(T, 13),
        "answer": only(S, 13),
        "role": only(S, 14),
        "content": only(T, 14),
        "body": only(F.struct(T.alias("main"), S.alias("side")), 16),
        "conversations": only(pair("from", "value", ("human", T), ("gpt", S)), 18),
    }
    return F.struct(*[value.alias(name) for name, value in fields.items()])


def _from_structs(spark, sf_dir, version):
    docs = documents(spark, sf_dir).select("doc_id", typed_shapes().alias("row"))
    made = norm.pair_columns(norm.normalize_struct(docs, "row", version))
    return made.select("doc_id", "prompt", "response", "rule")


@query("normalize_struct_v2", ORACLES["normalize_pairs_v2"])
def normalize_struct_v2(spark, sf_dir):
    return _from_structs(spark, sf_dir, "v2")


@query("normalize_struct_v1", ORACLES["normalize_pairs_v1"])
def normalize_struct_v1(spark, sf_dir):
    return _from_structs(spark, sf_dir, "v1")
