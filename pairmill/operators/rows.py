"""Two views of a raw row with the same questions: JSON text, or a declared struct.

A row view answers, with plain columns, which named value a row has, whether that value is a
string, whether it counts as filled, and where the row keeps its message list. The pair rules
in ``normalize`` are written once against these answers. A JSON null counts as missing.

Messages always take the form ``ARRAY<STRUCT<pos INT, role STRING, content STRING>>``; a list
element that is neither a string nor an object keeps its position but yields no message.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmill.functions.text import SHORT_TEXT, WHITESPACE, let
from pairmill.operators.once import compute_once

MESSAGE_TYPE = "array<struct<pos:int,role:string,content:string>>"
# Message keys in order of preference, and the stand-ins for missing ones.
ROLE_KEYS = ("role", "from", "uid")
CONTENT_KEYS = ("content", "value", "text")
DEFAULT_ROLE = "turn"
STRING_ROLES = ("system_event", "agent_action")
NESTED_KEYS = ("messages", "conversations", "trajectory")

STRICT = {"allowSingleQuotes": "false"}
_TEXTS = "map<string,string>"
_KINDS = "map<string,variant>"
_EMPTY_VALUES = ("0", "0.0", "-0.0", "false", "[]", "{}")


def _message(pos: Column, role: Column, content: Column) -> Column:
    return F.struct(pos.cast("int").alias("pos"), role.alias("role"), content.alias("content"))


def _string_message(pos: Column, text: Column) -> Column:
    role = F.when(pos % 2 == 0, STRING_ROLES[0]).otherwise(STRING_ROLES[1])
    return _message(pos, role, text)


def _from_keys(lookup, keys, default: str) -> Column:
    return F.coalesce(*[lookup(k) for k in keys], F.lit(default))


# --------------------------------------------------------------------------- JSON text


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _opens(value: Column) -> Column:
    kind = _kind(value)
    return (kind == "STRING") | kind.startswith("OBJECT")


def object_texts(text: Column) -> Column:
    """Values of a JSON object as texts, in row order; NULL unless ``text`` is one object.

    The reader stops after one value and does not see what follows it, so the text is read as
    the only element of a list. A tail that closes the list would pass; texts with a closing
    bracket are therefore read as the only member of an object too, which such a tail breaks.
    """
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<{_TEXTS}>", STRICT)
    member = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "map<string,string>", STRICT)
    whole = F.when(F.contains(text, F.lit("]")), F.size(member) == 1).otherwise(True)
    return let(listed, lambda a: F.when((F.size(a) == 1) & whole, F.get(a, F.lit(0))))


def _kinds_of(text: Column) -> Column:
    return F.from_json(text, _KINDS, STRICT)


def _opens_object(text: Column) -> Column:
    return F.ltrim(text, F.lit(WHITESPACE)).startswith("{")


def spelled_object(text: Column) -> Column:
    """``text`` where it is a JSON object from end to end, else NULL."""
    return F.when(_opens_object(text), F.when(object_texts(text).isNotNull(), text))


def json_messages(list_text: Column) -> Column:
    """Message list held as the text of a JSON array."""
    keys = dict.fromkeys(ROLE_KEYS + CONTENT_KEYS)
    fields = T.StructType([T.StructField(k, T.StringType()) for k in keys])
    texts = F.from_json(list_text, "array<string>", STRICT)
    kinds = F.from_json(list_text, "array<variant>", STRICT)
    opened = F.transform(
        F.arrays_zip(texts.alias("text"), kinds.alias("kind")),
        lambda e: F.struct(
            e["text"].alias("text"),
            _kind(e["kind"]).alias("kind"),
            F.from_json(e["text"], fields, STRICT).alias("obj"),
        ),
    )

    def message(e: Column, pos: Column) -> Column:
        role = F.lower(_from_keys(lambda k: e["obj"][k], ROLE_KEYS, DEFAULT_ROLE))
        content = _from_keys(lambda k: e["obj"][k], CONTENT_KEYS, "")
        return F.when(e["kind"] == "STRING", _string_message(pos, e["text"])).when(
            e["kind"].startswith("OBJECT"), _message(pos, role, content)
        )

    return F.filter(F.transform(opened, message), lambda m: m.isNotNull())


def _first_nested(value, key):
    """First non-null ``key`` in document order; a level's own key beats the ones below it."""
    pending = [value]
    while pending:
        here = pending.pop()
        if isinstance(here, dict):
            if here.get(key) is not None:
                return here[key]
            pending.extend(reversed(here.values()))
        elif isinstance(here, list):
            pending.extend(reversed(here))
    return None


def _longest_string(value):
    best, pending = None, [value]
    while pending:
        here = pending.pop()
        if isinstance(here, str):
            if best is None or len(here) > len(best):
                best = here
        elif isinstance(here, dict):
            pending.extend(reversed(here.values()))
        elif isinstance(here, list):
            pending.extend(reversed(here))
    return best


_NESTED_TYPE = T.StructType(
    [
        T.StructField("found", T.BooleanType()),
        T.StructField("list_text", T.StringType()),
        T.StructField("longest", T.StringType()),
    ]
)


def _encodable(text):
    return None if text is None else text.encode("utf-8", "replace").decode("utf-8")


@F.pandas_udf(_NESTED_TYPE)
def _nested_parts(raw: pd.Series, keys: pd.Series) -> pd.DataFrame:
    """Values at any depth of a JSON text. Only rows no flat rule settles send text here.

    A text that only a laxer reader takes, or that is nested too deeply, has none and so no pair;
    half a surrogate pair is a question mark, as Spark's own reader has it.
    """
    out = []
    for text, wanted in zip(raw, keys):
        if text is None:
            out.append((None, None, None))
            continue
        try:
            row = json.loads(text)
        except (ValueError, RecursionError):
            out.append((None, None, None))
            continue
        hit = next(filter(None, (_first_nested(row, k) for k in wanted.split(","))), None)
        listed = json.dumps(hit, ensure_ascii=False, separators=(",", ":")) if isinstance(hit, list) else None
        out.append((hit is not None, _encodable(listed), _encodable(_longest_string(row))))
    return pd.DataFrame(out, columns=["found", "list_text", "longest"])


class JsonRow:
    """Rows kept as JSON text. ``attach`` adds the parsed columns the answers refer to."""

    texts, kinds, body, nested = "_row_texts", "_row_kinds", "_row_body", "_row_nested"
    columns = (texts, kinds, body, nested)

    @classmethod
    def attach(cls, df: DataFrame, raw: str, unpack: bool) -> DataFrame:
        row = cls()
        df = compute_once(df, {cls.texts: object_texts(F.col(raw))})
        df = df.withColumn(cls.body, F.when(F.col(cls.texts).isNotNull(), F.col(raw)))
        df = compute_once(df, {cls.kinds: F.when(row._kinds_matter(), _kinds_of(F.col(cls.body)))})
        if not unpack:
            return df
        inner = row.text("text")
        packed = F.when(row.is_string("text"), object_texts(inner))
        df = compute_once(df, {"_packed": F.when(_opens_object(inner), packed)})
        fresh = F.col("_packed").isNotNull()
        return compute_once(
            df,
            {
                cls.body: F.when(fresh, inner).otherwise(F.col(cls.body)),
                cls.texts: F.when(fresh, F.col("_packed")).otherwise(F.col(cls.texts)),
                cls.kinds: F.when(fresh, _kinds_of(inner)).otherwise(F.col(cls.kinds)),
            },
        ).drop("_packed")

    def _kinds_matter(self) -> Column:
        """Whether any rule can ask what kind a value has: not for plain texts with scalars."""
        nested = F.exists(F.map_values(self.texts), lambda v: v.startswith("[") | v.startswith("{"))
        asked = self.text("abstract").isNotNull() | self.text("input").isNotNull()
        no_text = F.coalesce(F.length(self.text("text")), F.lit(0)) <= SHORT_TEXT
        spelled = F.coalesce(_opens_object(self.text("text")), F.lit(False))
        return asked | nested | no_text | spelled

    @classmethod
    def attach_nested(cls, df: DataFrame, unsettled: Column, keys: tuple[str, ...]) -> DataFrame:
        text = F.when(unsettled & F.col(cls.texts).isNotNull(), F.col(cls.body))
        df = compute_once(df, {"_nested_text": text})
        found = _nested_parts(F.col("_nested_text"), F.lit(",".join(keys)))
        return df.withColumn(cls.nested, found).drop("_nested_text")

    def text(self, key: str) -> Column:
        return F.try_element_at(F.col(self.texts), F.lit(key))

    def _variant(self, key: str) -> Column:
        return F.try_element_at(F.col(self.kinds), F.lit(key))

    def is_string(self, key: str) -> Column:
        return _kind(self._variant(key)) == "STRING"

    def filled(self, key: str) -> Column:
        text = self.text(key)
        nothing = (text == "") | (text.isin(*_EMPTY_VALUES) & ~self.is_string(key))
        return text.isNotNull() & ~nothing

    def _params(self, path: str) -> Column:
        return F.try_variant_get(self._variant("responses_create_params"), path, "variant")

    def parameter_input(self) -> tuple[Column, Column]:
        """Whether the parameter block names a filled input, and its text when that is a list."""
        kind = _kind(self._params("$.input"))
        text = F.get_json_object(self.text("responses_create_params"), "$.input")
        nothing = (text == "") | (text.isin(*_EMPTY_VALUES) & (kind != "STRING"))
        return text.isNotNull() & ~nothing, F.when(kind.startswith("ARRAY"), text)

    def params_open(self) -> Column:
        return F.coalesce(_opens(self._params("$.input[0]")), F.lit(False))

    def first_list(self) -> Column:
        """Text of the first listed value, in row order, that opens with a string or an object."""
        listed = F.filter(
            F.arrays_zip(
                F.map_values(self.texts).alias("text"), F.map_values(self.kinds).alias("kind")
            ),
            lambda e: e["text"].startswith("[")
            & _opens(F.try_variant_get(e["kind"], "$[0]", "variant")),
        )
        return F.get(listed, F.lit(0))["text"]

    def may_nest(self, keys: tuple[str, ...]) -> Column:
        """False only when no object at any depth can hold one of ``keys``."""
        body = F.col(self.body)
        hint = F.contains(body, F.lit("\\u"))
        for key in keys:
            hint = hint | F.contains(body, F.lit(f'"{key}"'))
        return hint

    def is_flat(self) -> Column:
        return ~F.exists(
            F.map_values(self.texts), lambda v: v.startswith("{") | v.startswith("[")
        )

    def flat_longest(self) -> Column:
        """Longest string of a row without nesting, the first of equals."""
        pairs = F.arrays_zip(
            F.map_values(self.texts).alias("text"), F.map_values(self.kinds).alias("kind")
        )
        sized = F.transform(
            pairs,
            lambda e, i: F.when(
                _kind(e["kind"]) == "STRING",
                F.struct(F.length(e["text"]).alias("n"), (-i).alias("at"), e["text"].alias("text")),
            ),
        )
        return F.array_max(F.filter(sized, lambda s: s.isNotNull()))["text"]

    def nested_found(self) -> Column:
        return F.coalesce(F.col(self.nested)["found"], F.lit(False))

    def nested_list(self) -> Column:
        return F.col(self.nested)["list_text"]

    def longest(self) -> Column:
        return F.when(self.is_flat(), self.flat_longest()).otherwise(F.col(self.nested)["longest"])


# --------------------------------------------------------------------------- declared struct


def _as_text(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(value)
    return value.cast("string")


def stringify(df: DataFrame, column: str) -> Column:
    """A value as text: strings as they are, containers as compact JSON, the rest as printed."""
    return _as_text(F.col(column), df.schema[column].dataType)


def _is_filled(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return value.isNotNull() & (value != "")
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return value.isNotNull() & (F.size(value) > 0)
    if isinstance(dtype, T.NumericType):
        return value.isNotNull() & (value != 0)
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(value, F.lit(False))
    return value.isNotNull()


def typed_messages(value: Column, dtype: T.DataType) -> Column:
    """Message list held as an array of structs or strings."""
    none = F.lit(None).cast(MESSAGE_TYPE)
    if not isinstance(dtype, T.ArrayType):
        return none
    element = dtype.elementType
    if isinstance(element, T.StringType):
        made = F.transform(
            value, lambda x, i: F.when(x.isNotNull(), _string_message(i, x))
        )
    elif isinstance(element, T.StructType):

        def lookup(x: Column, key: str) -> Column:
            if key in element.names:
                return _as_text(x[key], element[key].dataType)
            return F.lit(None).cast("string")

        made = F.transform(
            value,
            lambda x, i: F.when(
                x.isNotNull(),
                _message(
                    i,
                    F.lower(_from_keys(lambda k: lookup(x, k), ROLE_KEYS, DEFAULT_ROLE)),
                    _from_keys(lambda k: lookup(x, k), CONTENT_KEYS, ""),
                ),
            ),
        )
    else:
        return F.when(value.isNotNull(), F.array().cast(MESSAGE_TYPE))
    return F.filter(made, lambda m: m.isNotNull())


def _found(value: Column, dtype: T.DataType) -> Column:
    return F.when(
        value.isNotNull(),
        F.struct(
            _is_filled(value, dtype).alias("filled"), typed_messages(value, dtype).alias("messages")
        ),
    )


def _search(value: Column, dtype: T.DataType, key: str) -> Column | None:
    """First non-null field ``key`` below ``value``, spelled out from the schema at plan time."""
    if isinstance(dtype, T.StructType):
        tries = [_found(value[key], dtype[key].dataType)] if key in dtype.names else []
        below = (_search(value[f.name], f.dataType, key) for f in dtype.fields if f.name != key)
        tries += [t for t in below if t is not None]
        return F.coalesce(*tries) if tries else None
    if isinstance(dtype, T.ArrayType) and _search(F.lit(0), dtype.elementType, key) is not None:
        hits = F.transform(value, lambda x: _search(x, dtype.elementType, key))
        return F.get(F.filter(hits, lambda h: h.isNotNull()), F.lit(0))
    return None


def _strings(value: Column, dtype: T.DataType) -> Column | None:
    """All string leaves below ``value``, in schema order."""
    if isinstance(dtype, T.StringType):
        return F.array(value)
    if isinstance(dtype, T.StructType):
        parts = [_strings(value[f.name], f.dataType) for f in dtype.fields]
        parts = [F.coalesce(p, F.array().cast("array<string>")) for p in parts if p is not None]
        return F.concat(*parts) if parts else None
    if isinstance(dtype, T.ArrayType) and _strings(F.lit(""), dtype.elementType) is not None:
        return F.flatten(F.transform(value, lambda x: _strings(x, dtype.elementType)))
    return None


class StructRow:
    """Rows with a declared schema: every answer is generated from it, nothing is parsed."""

    columns: tuple[str, ...] = ()

    def __init__(self, schema: T.StructType, at: Column):
        self.schema, self.at = schema, at

    def _has(self, key: str) -> bool:
        return key in self.schema.names

    def _value(self, key: str) -> tuple[Column, T.DataType]:
        return self.at[key], self.schema[key].dataType

    def text(self, key: str) -> Column:
        return _as_text(*self._value(key)) if self._has(key) else F.lit(None).cast("string")

    def is_string(self, key: str) -> Column:
        return F.lit(self._has(key) and isinstance(self.schema[key].dataType, T.StringType))

    def filled(self, key: str) -> Column:
        return _is_filled(*self._value(key)) if self._has(key) else F.lit(False)

    def parameter_input(self) -> tuple[Column, Column]:
        none = F.lit(None).cast(MESSAGE_TYPE)
        if not self._has("responses_create_params"):
            return F.lit(False), none
        value, dtype = self._value("responses_create_params")
        if not isinstance(dtype, T.StructType) or "input" not in dtype.names:
            return F.lit(False), none
        inner = dtype["input"].dataType
        return _is_filled(value["input"], inner), typed_messages(value["input"], inner)

    def first_list_messages(self) -> Column:
        tries = []
        for field in self.schema.fields:
            dtype = field.dataType
            if isinstance(dtype, T.ArrayType) and isinstance(
                dtype.elementType, (T.StringType, T.StructType)
            ):
                value = self.at[field.name]
                opens = F.get(value, F.lit(0)).isNotNull()
                tries.append(F.when(opens, typed_messages(value, dtype)))
        return F.coalesce(*tries) if tries else F.lit(None).cast(MESSAGE_TYPE)

    def _nested(self, keys: tuple[str, ...]) -> Column | None:
        tries = []
        for key in keys:
            hit = _search(self.at, self.schema, key)
            if hit is not None:
                tries.append(let(hit, lambda h: F.when(h["filled"], h)))
        return F.coalesce(*tries) if tries else None

    def nested(self, keys: tuple[str, ...]) -> tuple[Column, Column]:
        hit = self._nested(keys)
        if hit is None:
            return F.lit(False), F.lit(None).cast(MESSAGE_TYPE)
        return hit.isNotNull(), hit["messages"]

    def longest(self) -> Column:
        leaves = _strings(self.at, self.schema)
        if leaves is None:
            return F.lit(None).cast("string")
        sized = F.transform(
            leaves,
            lambda s, i: F.struct(F.length(s).alias("n"), (-i).alias("at"), s.alias("text")),
        )
        return F.array_max(F.filter(sized, lambda s: s["text"].isNotNull()))["text"]
