"""Fill-in-middle transformation: documents cut at two places, found by repeated-capture matching.

One full match of ``(unit)*`` keeps the end of every repetition of its group: their number is the length
of the text in units, and the ends are all offsets at which it may be cut, so neither a loop nor a second
look at the text is needed. A unit is a code point unless the caller gives another pattern of which every
text is a sequence (words with the space after them, lines).

Where a document is cut, and in which form, follows from its id and the seed alone, so any task that runs
again gives the same output. The forms: ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix, middle),
and ``plain``, which an empty text, a text that holds a marker and a share of all others keep.

Cases: a null text is empty, hence plain; a null id is hashed as the empty string; rows of one id are cut
at the same draws, repeated rows alike; texts of any length are cut whole, at some 60 bytes of a worker's
memory a unit; a text that is no sequence of the caller's units stays plain; an empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmill.llm.textblock import kept_ddl, map_blocks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CODE_POINT = "(?s:.)"
SEED = 1
#: Of a hundred documents so many are cut, and of those so many take the suffix first.
CUT_SHARE, SUFFIX_FIRST_SHARE = 90, 20
PLAIN, PSM, SPM = "plain", "psm", "spm"


def draws(doc_id: str, seed: int = SEED) -> Column:
    """Four unsigned 32-bit integers: the first groups of eight digits of the hex sha256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)])


def cut(text: str, first: int, second: int, unit: regex.Pattern) -> tuple[int, int, int, int, int] | None:
    """Number of units, the two cuts in units, and both in code points; None if the text is no sequence of units."""
    match = unit.fullmatch(text)
    if match is None:
        return None
    ends = match.ends(1)
    n = len(ends)
    low, high = sorted((first % (n + 1), second % (n + 1)))
    return n, low, high, ends[low - 1] if low else 0, ends[high - 1] if high else 0


def written(text: str, begin: int, end: int, form: str) -> str:
    prefix, middle, suffix = text[:begin], text[begin:end], text[end:]
    if form == PLAIN:
        return text
    if form == PSM:
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text that an output of this form was made of. A cut text holds no marker, so each is found once."""
    if form == PLAIN:
        return output
    head, _, middle = output.partition(MIDDLE)
    if form == PSM:
        prefix, _, suffix = head.removeprefix(PREFIX).partition(SUFFIX)
    else:
        suffix, _, prefix = head.removeprefix(SUFFIX).partition(PREFIX)
    return prefix + middle + suffix


def fill_in_middle(
    df: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text", unit: str = CODE_POINT, seed: int = SEED
) -> DataFrame:
    """The kept columns with n (units), form, prefix_units, middle_units (null if plain), output and restored."""
    schema = f"{kept_ddl(df, keep)}, n bigint, form string, prefix_units bigint, middle_units bigint, output string, restored string"
    pattern = f"({unit})*"
    drawn = df.select(*[F.col(f"`{k}`") for k in keep], draws(doc_id, seed).alias("__draws"), F.col(text).alias("__whole"))

    def work(part, texts: list[str]) -> Iterator[dict]:
        units = regex.compile(pattern)
        numbers = np.asarray(part.column(len(keep)).flatten()).reshape(-1, 4).tolist()
        rows = []
        for whole, (h1, h2, h3, h4) in zip(texts, numbers):
            found = cut(whole, h1, h2, units)
            n, low, high, begin, end = found or (0, 0, 0, 0, 0)
            marked = PREFIX in whole or SUFFIX in whole or MIDDLE in whole
            plain = not found or not whole or marked or h3 % 100 >= CUT_SHARE
            form = PLAIN if plain else SPM if h4 % 100 < SUFFIX_FIRST_SHARE else PSM
            output = written(whole, begin, end, form)
            rows.append((n, form, None if plain else low, None if plain else high - low, output, restored(output, form)))
        names = ("n", "form", "prefix_units", "middle_units", "output", "restored")
        yield {k: part.column(i) for i, k in enumerate(keep)} | dict(zip(names, zip(*rows)))

    return map_blocks(drawn, [*keep, "__draws"], "__whole", schema, work)
