"""Licence scans: one Aho-Corasick pass over a text's words, then expressions by a shunting yard.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z. The automaton holds notice phrases
and the words of identifier tags and of tags in prose ("licensed under"); where a tag is found, the expression behind it in the raw text is
parsed (AND before OR, WITH binds closest, brackets) and evaluated to the least obligation among the
choices of OR, the greatest among the parts of AND, one level lower under an exception. A name outside
the tables is an operand of obligation UNKNOWN, the greatest. Expressions go on over line ends and the
comment marks behind them. Behind words of prose only a whole expression of known names counts.

Cases: a null or empty text has no words, labels or places; an expression that breaks off or does not
parse is listed with "? " before it, its names are labels and its obligation is UNKNOWN; repeated rows each get their row; further columns are not read.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame

from pairmill.llm.textblock import kept_ddl, map_texts

#: Phrases of the base scan and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notice phrases and their labels.
NOTICE_PHRASES = {
    "apache license": "apache-2.0",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "eclipse public license": "epl",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons zero": "cc0",
    "public domain": "public-domain",
    "boost software license": "bsl-1.0",
    "isc license": "isc",
    "mit license": "mit",
    "bsd license": "bsd",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "lesser general public license version 2 1": "lgpl-2.1",
    "lesser general public license version 3": "lgpl-3.0",
    "affero general public license version 3": "agpl-3.0",
}
#: The words of identifier tags.
TAGS = ("spdx license identifier", "license expression")
#: Words in prose behind which an expression may stand.
PROSE_TAGS = ("licensed under", "licenced under", "released under", "distributed under", "available under")
#: Identifiers and their obligation (0 none, 1 notice, 2 file, 3 library, 4 whole work, 5 network use).
IDENTIFIERS = {
    "0bsd": 0, "cc0-1.0": 0, "unlicense": 0, "mit": 1, "mit-0": 0, "isc": 1, "bsd-2-clause": 1, "bsd-3-clause": 1,
    "apache-2.0": 1, "bsl-1.0": 1, "zlib": 1, "cc-by-4.0": 1, "cc-by-sa-4.0": 4, "python-2.0": 1, "mpl-2.0": 2,
    "epl-2.0": 2, "cddl-1.0": 2, "lgpl-2.1-only": 3, "lgpl-2.1-or-later": 3, "lgpl-3.0-only": 3, "lgpl-3.0-or-later": 3,
    "gpl-2.0-only": 4, "gpl-2.0-or-later": 4, "gpl-2.0": 4, "gpl-3.0-only": 4, "gpl-3.0-or-later": 4, "gpl-3.0": 4,
    "agpl-3.0-only": 5, "agpl-3.0-or-later": 5, "agpl-3.0": 5,
    "gpl-1.0": 4, "gpl-1.0-only": 4, "gpl-1.0-or-later": 4, "lgpl-2.0": 3, "lgpl-2.0-only": 3, "lgpl-2.0-or-later": 3,
    "lgpl-2.1": 3, "lgpl-3.0": 3, "agpl-1.0": 5, "agpl-1.0-only": 5, "agpl-1.0-or-later": 5, "sspl-1.0": 5, "eupl-1.1": 5,
    "eupl-1.2": 5, "osl-3.0": 5, "mpl-1.1": 2, "epl-1.0": 2, "cddl-1.1": 2, "artistic-2.0": 2, "bsd-4-clause": 1, "apache-1.1": 1,
    "cc-by-2.0": 1, "cc-by-2.5": 1, "cc-by-3.0": 1, "cc-by-sa-2.0": 4, "cc-by-sa-2.5": 4, "cc-by-sa-3.0": 4, "ncsa": 1,
    "x11": 1, "postgresql": 1, "psf-2.0": 1, "ofl-1.1": 2, "wtfpl": 0, "blueoak-1.0.0": 1,
}
#: The obligation of what is not known, above all others.
UNKNOWN = 6
#: Exceptions that may follow WITH.
EXCEPTIONS = ("classpath-exception-2.0", "gcc-exception-3.1", "llvm-exception", "linux-syscall-note", "autoconf-exception-3.0")

_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_TAG_IN_TEXT = re.compile(r"(?:spdx[^0-9A-Za-z]+)?license[^0-9A-Za-z]+(?:identifier|expression)[ \t]*[:=][ \t]*", re.I)
_PROSE_TAG = re.compile(r"\b(?:licen[sc]ed|released|distributed|available)\s+under\s+(?:either\s+(?:of\s+)?)?(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?)?", re.I)
_TOKEN = re.compile(r"[()]|DocumentRef-[A-Za-z0-9.-]+:[A-Za-z0-9][A-Za-z0-9.+-]*|[A-Za-z0-9][A-Za-z0-9.+-]*", re.I)
_BLANK = re.compile(r"[ \t]*")
#: A line end, and the mark of a comment that goes on.
_WRAP = re.compile(r"[ \t]*\r?\n[ \t]*(?:(?:[*#;%!>]+|//+|--+|dnl\b)[ \t]*)?")
#: What may stand before a further name in a list that is no expression.
_LISTED = re.compile(r"[ \t]*[,;/|&]*[ \t]*")
_BINDING = {"or": 1, "and": 2, "with": 3}
_automata: list[ahocorasick.Automaton] = []


def _automaton() -> ahocorasick.Automaton:
    if not _automata:
        built = ahocorasick.Automaton()
        for phrases, kind in ((NOTICE_PHRASES, "notice"), (dict.fromkeys(TAGS, ""), "tag"), (dict.fromkeys(PROSE_TAGS, ""), "prose"), (BASE_PHRASES, "base")):
            for phrase, label in phrases.items():
                built.add_word(f" {phrase} ", (kind, label, len(phrase) + 1))
        built.make_automaton()
        _automata.append(built)
    return _automata[0]


def shunt(tokens: list[str]) -> list[str] | None:
    """Reverse Polish form of an expression, or None if its brackets or operands do not fit."""
    out: list[str] = []
    held: list[str] = []
    operand_next = True
    for token in tokens:
        word = token.lower()
        if word == "(":
            if not operand_next:
                return None
            held.append(word)
        elif word == ")":
            if operand_next:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif word in _BINDING:
            if operand_next:
                return None
            while held and held[-1] != "(" and _BINDING[held[-1]] >= _BINDING[word]:
                out.append(held.pop())
            held.append(word)
            operand_next = True
        else:
            if not operand_next:
                return None
            out.append(word)
            operand_next = False
    if operand_next or "(" in held:
        return None
    return out + held[::-1]


def evaluate(polish: list[str]) -> tuple[int, frozenset[str]] | None:
    """Obligation and identifiers of a parsed expression; None where an exception stands wrong."""
    stack: list[tuple[int, frozenset[str]] | str] = []
    for token in polish:
        if token == "with":
            exception, licence = stack.pop(), stack.pop()
            if isinstance(licence, str):
                return None
            if isinstance(exception, str):
                stack.append((licence[0] if licence[0] == UNKNOWN else max(licence[0] - 1, 0), licence[1]))
            elif len(exception[1]) == 1 and not _known(*exception[1]):
                stack.append((UNKNOWN, licence[1] | exception[1]))
            else:
                return None
        elif token in _BINDING:
            right, left = stack.pop(), stack.pop()
            if isinstance(left, str) or isinstance(right, str):
                return None
            level = min(left[0], right[0]) if token == "or" else max(left[0], right[0])
            stack.append((level, left[1] | right[1]))
        elif token in EXCEPTIONS:
            stack.append(token)
        else:
            stack.append((IDENTIFIERS.get(token.rstrip("+"), UNKNOWN), frozenset([token])))
    return stack[0] if len(stack) == 1 and not isinstance(stack[0], str) else None


def _known(word: str) -> bool:
    return word.rstrip("+") in IDENTIFIERS or word in EXCEPTIONS


def _goes_on(text: str, at: int, tokens: list[str], operand_next: bool) -> re.Match | None:
    """The token after a line end, if the expression goes on there."""
    wrap = _WRAP.match(text, at)
    found = wrap and _TOKEN.match(text, wrap.end())
    if not found:
        return None
    word = found.group().lower().rstrip(".")
    if not tokens:  # nothing stands behind the tag: only what looks like a name
        return found if word == "(" or _known(word) or (word not in _BINDING and re.search("[0-9-]", word)) else None
    if operand_next or tokens.count("(") > tokens.count(")"):
        return found
    if word not in _BINDING:
        return None
    after = _TOKEN.match(text, _BLANK.match(text, found.end()).end())
    sure = found.group().isupper() or (after and (after.group() == "(" or _known(after.group().lower().rstrip("."))))
    return found if sure else None


def expression_at(text: str, begin: int) -> tuple[str, int, frozenset[str]] | None:
    """The whole expression that starts here: its normal form, obligation and names. It ends where no
    operator follows an operand; None if there is no operand at all."""
    tokens: list[str] = []
    at, depth, operand_next = begin, 0, True
    while True:
        found = _TOKEN.match(text, _BLANK.match(text, at).end()) or _goes_on(text, at, tokens, operand_next)
        if not found:
            break
        word = found.group().lower()
        if word == "(":
            if not operand_next:
                break
            depth += 1
        elif word == ")":
            if operand_next or not depth:
                break
            depth -= 1
        elif operand_next != (word not in _BINDING):
            break
        else:
            operand_next = word in _BINDING
        at = found.end()
        tokens.append(word.rstrip("."))
        if word.endswith("."):
            break  # a sentence ends
    names = frozenset(t for t in tokens if t not in "()" and t not in _BINDING and t not in EXCEPTIONS)
    if not names:
        return None
    form = " ".join(t.upper() if t in _BINDING else t for t in tokens).replace("( ", "(").replace(" )", ")")
    polish = shunt(tokens)
    value = evaluate(polish) if polish else None
    listed = _TOKEN.match(text, _LISTED.match(text, at).end())
    if value is None or (listed and text[at - 1] != "." and _known(listed.group().lower().rstrip("."))):
        return f"? {form}", UNKNOWN, names
    return form, value[0], value[1]


def scan(text: str) -> dict:
    words = text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()
    line = f" {b' '.join(words).decode('latin-1')} "
    base, labels, base_labels, tagged, in_prose = [], set(), set(), False, False
    noted = position = counted = 0
    for last, (kind, label, length) in _automaton().iter(line):
        if kind == "tag":
            tagged = True
            continue
        if kind == "prose":
            in_prose = True
            continue
        labels.add(label)
        if kind == "notice":
            noted += 1
            continue
        begin = last - length  # the blank before the phrase
        # places come in the order of their ends; phrases overlap, so the count may step back a little
        position += line.count(" ", counted, begin) if begin >= counted else -line.count(" ", begin, counted)
        counted = begin
        base.append(position)
        base_labels.add(label)
    expressions, obligation = [], None
    tags = {tag.end() for tag in _TAG_IN_TEXT.finditer(text)} if tagged else set()
    # in prose only what is whole and of known names is taken for an expression
    loose = {tag.end() for tag in _PROSE_TAG.finditer(text)} if in_prose else set()
    for at in sorted(loose.union(tags)):
        found = expression_at(text, at)
        if found and (at in tags or (found[0][0] != "?" and all(_known(name) for name in found[2]))):
            expressions.append(found[0])
            labels |= found[2]
            obligation = found[1] if obligation is None else max(obligation, found[1])
    score = 1.0 if expressions else 1.0 - 0.5 ** (len(base) + noted)
    return {
        "n_words": len(words), "n_base": len(base), "first_word": min(base, default=None), "last_word": max(base, default=None),
        "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(labels)), "score": score,
        "expressions": expressions, "obligation": obligation,
    }


COLUMNS = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
    "score double, expressions array<string>, obligation int"
)


def scan_licences(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns with places of base phrases, all labels, parsed expressions and their obligation."""
    kept = kept_ddl(df, keep)

    def work(part, texts):
        rows = [scan(t) for t in texts]
        yield {k: part.column(i) for i, k in enumerate(keep)} | {k: [r[k] for r in rows] for k in rows[0]}

    return map_texts(df, keep, text, f"{kept}, {COLUMNS}", work)
