"""Conversations of any length to token sides, without ever holding one as a text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmill.functions.arrays import TOKEN_LIMIT
from pairmill.operators.normalize import NO_RESPONSE, OPENING_ROLES_V2
from pairmill.operators.numbering import SPAN, number_rows, running_total
from pairmill.operators.rows import DEFAULT_ROLE
from pairmill.operators.tokens import split_tokens


def label_turns(
    turns: DataFrame, key: str = "conv_id", order: str = "turn", span: int = SPAN
) -> DataFrame:
    """Side and text of each turn as the pair will hold it; one row per turn, no group is built.

    A turn without a role is a ``turn``; one without a text is empty.
    """
    made = number_rows(turns, [key], order, "_at", span)
    role = F.coalesce(F.lower("role"), F.lit(DEFAULT_ROLE))
    text = F.coalesce("text", F.lit(""))
    opens = (F.col("_at") == 0) | ((F.col("_at") == 1) & role.isin(*OPENING_ROLES_V2))
    part = F.when(opens, F.concat(role, F.lit(": "), text)).otherwise(
        F.concat(F.lit("["), role, F.lit("]: "), text)
    )
    return made.select(
        key, order, F.when(opens, "prompt").otherwise("response").alias("side"), part.alias("part")
    )


def fold_to_tokens(
    turns: DataFrame,
    key: str = "conv_id",
    order: str = "turn",
    limit: int = TOKEN_LIMIT,
    span: int = SPAN,
) -> DataFrame:
    """Both sides of each conversation as tokens, cut to ``limit``.

    Parts are joined by a line break, which is never inside a token, so the tokens of a side are
    those of its parts in a row. The running token count of a side tells which parts begin below
    the limit. A part has at least the tokens of its own marks, so no more than ``limit`` parts
    remain to be put together, however long the conversation was.
    """
    parts = label_turns(turns, key, order, span).select(
        key, order, "side", split_tokens(F.col("part")).alias("tokens")
    )
    parts = parts.withColumn("n", F.size("tokens"))
    parts = running_total(parts, [key, "side"], order, "n", "_from", span)
    kept = parts.where(F.col("_from") < limit).select(
        key,
        "side",
        F.struct(
            order, F.slice("tokens", F.lit(1), (F.lit(limit) - F.col("_from")).cast("int")).alias("tokens")
        ).alias("piece"),
    )

    def side(name: str):
        pieces = F.array_sort(F.collect_list(F.when(F.col("side") == name, F.col("piece"))))
        return F.flatten(pieces["tokens"])

    folded = kept.groupBy(key).agg(side("prompt").alias("prompt"), side("response").alias("response"))
    filler = F.array(F.lit(NO_RESPONSE))
    return folded.withColumn("response", F.when(F.size("response") > 0, F.col("response")).otherwise(filler))
