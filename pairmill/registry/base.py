"""Named queries over the test tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmill.functions.text import BREAK_CHARS, WHITESPACE
from pairmill.operators.layout import spread
from pairmill.operators.tokens import TOKEN_PATTERN, split_tokens

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents on all cores, for work that is heavy per row."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def token_lengths(text: str = "text") -> Column:
    """Stand-in ids: the length of every token of a text."""
    return F.transform(split_tokens(F.col(text)), lambda t: F.length(t))


def docs_as_rows(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    """Documents under the names shards use: language as domain, source as source."""
    docs = documents(spark, sf_dir) if heavy else table(spark, sf_dir, "documents")
    return docs.select(
        F.col("lang").alias("domain"), "source", F.col("doc_id").alias("row_pos"), "text"
    )


# ------------------------------------------------------------------ SQL building blocks


def _sql_text(chars: str) -> str:
    return "||".join(f"chr({ord(c)})" for c in chars)


SQL_WS = _sql_text(WHITESPACE)
SQL_TOKENS = f"regexp_extract_all(text, '{TOKEN_PATTERN}')"
SQL_LENGTHS = f"list_transform({SQL_TOKENS}, lambda t: length(t))"


def sql_tokens(column: str) -> str:
    return f"regexp_extract_all({column}, '{TOKEN_PATTERN}')"


def sql_strip(expression: str) -> str:
    return f"trim({expression}, {SQL_WS})"


_SQL_CUT = " ".join(
    f"WHEN instr(win, chr({ord(c)})) > 0 THEN lo + instr(win, chr({ord(c)}))" for c in BREAK_CHARS
)
# cut_docs: documents with both halves (sp, sr), NULL for texts of ten characters or fewer
SQL_CUT_DOCS = f"""
sized AS (SELECT *, length(text) AS n, length(text) // 2 AS mid,
                 greatest(0, length(text) // 2 - 150) AS lo FROM documents),
framed AS (SELECT *, substring(text, lo + 1, least(n, mid + 150) - lo) AS win FROM sized),
placed AS (SELECT *, CASE WHEN n > 100 THEN CASE {_SQL_CUT} ELSE mid END ELSE mid END AS cut FROM framed),
cut_docs AS (SELECT *,
    CASE WHEN n > 10 THEN {sql_strip('substring(text, 1, cut)')} END AS sp,
    CASE WHEN n > 10 THEN {sql_strip('substring(text, cut + 1)')} END AS sr,
    CASE WHEN n > 10 THEN substring(text, 1, mid) END AS mp,
    CASE WHEN n > 10 THEN substring(text, mid + 1) END AS mr
  FROM placed)"""

_OPENS = "i = 0 OR (i = 1 AND role IN ('user', 'human', 'prompter'))"
SQL_FOLDED = f"""
numbered AS (SELECT conv_id, lower(role) AS role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
folded AS (SELECT conv_id,
    string_agg(role || ': ' || text, chr(10) ORDER BY i) FILTER (WHERE {_OPENS}) AS prompt,
    coalesce(string_agg('[' || role || ']: ' || text, chr(10) ORDER BY i)
      FILTER (WHERE NOT ({_OPENS})), 'completed') AS response
  FROM numbered GROUP BY conv_id)"""
