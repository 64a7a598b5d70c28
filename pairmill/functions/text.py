"""String columns: cleaning, splitting, fenced code, shard names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space when a text is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Characters a long text may be cut after, best first.
BREAK_CHARS = ("\n", "。", "！", "？", ".", "!", "?")
BREAK_REACH = 150
LONG_TEXT = 100
SHORT_TEXT = 10
TO_THE_END = 2**31 - 1
# Fixed pattern: a fenced block with an optional language tag.
CODE_FENCE = "(?is)```(?:rust)?\\n(.*?)```"
# Fixed text: what a failed attempt adds to its prompt.
RETRY_TEXT = "\n\nThe previous attempt failed with:\n{error}\nPlease fix the architectural logic."
SHARD_SUFFIX = ".pt"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a name inside one expression, so that it is computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def sanitize_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-zA-Z0-9_]", "_")


def safe_source(dataset: Column, config: Column, split: Column) -> Column:
    return sanitize_name(F.concat_ws("_", dataset, config, split))


def shard_name(domain: Column, safe: Column, chunk_id: Column) -> Column:
    return F.concat(domain, F.lit("_"), safe, F.lit("_"), chunk_id.cast("string"), F.lit(SHARD_SUFFIX))


def shard_chunk_id(name: Column) -> Column:
    """Chunk number at the end of a shard name; NULL when the name carries none."""
    return F.regexp_extract(name, r"_(\d+)\.pt$", 1).try_cast("int")


def _halves(c: Column, cut: Column, clean: bool) -> Column:
    left = F.substring(c, F.lit(1), cut)
    right = F.substring(c, cut + 1, F.lit(TO_THE_END))
    if clean:
        left, right = strip(left), strip(right)
    return F.struct(left.alias("prompt"), right.alias("response"))


def _half(n: Column) -> Column:
    return F.shiftright(n, 1)


def split_mid(c: Column) -> Column:
    """Two halves of a text longer than ten characters, else NULL."""
    return let(F.length(c), lambda n: F.when(n > SHORT_TEXT, _halves(c, _half(n), clean=False)))


def split_break(c: Column) -> Column:
    """Cut a long text after the best break character near its middle; short ones in half.

    Finding the length of a text reads all of it, so the length is bound before it is used.
    """

    def after_break(window: Column) -> Column:
        return F.coalesce(*[F.nullif(F.instr(window, ch), F.lit(0)) for ch in BREAK_CHARS])

    def cut(n: Column) -> Column:
        start = F.greatest(F.lit(0), _half(n) - BREAK_REACH)
        stop = F.least(n, _half(n) + BREAK_REACH)
        found = let(F.substring(c, start + 1, stop - start), after_break)
        return F.when(n > LONG_TEXT, F.coalesce(start + found, _half(n))).when(
            n > SHORT_TEXT, _half(n)
        )

    place = let(F.length(c), cut)
    return let(place, lambda at: F.when(at.isNotNull(), _halves(c, at, clean=True)))


def code_block(c: Column) -> Column:
    """Body of the first fenced block; the whole text when there is none."""
    fenced = F.regexp_extract(c, CODE_FENCE, 0) != ""
    return strip(F.when(fenced, F.regexp_extract(c, CODE_FENCE, 1)).otherwise(c))


def retry_prompt(prompt: Column, error: Column) -> Column:
    before, after = RETRY_TEXT.split("{error}")
    return F.concat(prompt, F.lit(before), error, F.lit(after))


def preview(c: Column, width: int) -> Column:
    return F.concat(F.substring(c, 1, width), F.lit("..."))
