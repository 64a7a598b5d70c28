"""Personal data: base patterns, and what their contexts reveal. DataFrame functions only.

Base spans are the leftmost non-overlapping matches of one pattern a kind; those that fail the kind's
test are dropped. They seed a graph of patterns (words before and after) and instances (values); long
mixed runs that a text assigns, quoted, to a name for secrets are seeds of a fifth kind, ``secret``. A
pattern's confidence for a kind is the smoothed share of its instances that are of the kind, an unseen
instance's the chance that not all its patterns are wrong; both are worked out in turns, and values that
are sure in one turn support patterns without seeds in the next. Values of confident patterns that look
like identifiers become further spans of the pattern's kind: tokens with digits, digit runs joined over
blanks, brackets and dashes (not as e-mail, and with as many digits as the kind's seeds have), names with
a substitute for the at-sign (as e-mail only), and long runs of letters and digits (as secret only).

Positions are code points, ends exclusive. The patterns are possessive and begin only where a run of
their characters begins or the last match ended, so they find the same matches without retrying. Places
are running sums of the lengths of matches and of what lies between, where contexts are read too; sums
and overlaps are worked out in blocks, so that a text of n matches takes no n * n steps.

Cases: a null or empty text has no spans; repeated rows each get their row, and add no weight to a
pattern, which counts distinct values; a table without any seed gets base spans only; further columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmill.operators.once import compute_once
from pairmill.storage import staged

KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
PLACES = (*KINDS, SECRET)
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character without which there is no match, if any: texts without it are not searched.
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: A token with a digit, from its start.
TOKEN = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"
#: Two to ten digit runs joined over blanks, brackets, dots and dashes.
JOINED = r"(?<!\S)\(?[0-9]++(?:[\x20().-]{1,3}+[0-9]++){1,9}+(?![\x20().-]{0,3}[0-9])(?![\w@])"
_OPEN, _CLOSE = r"\x20?+[(\[{<]\x20?+", r"\x20?+[)\]}>]\x20?+"
#: An address whose at-sign, and perhaps dots, are spelled out.
SPELLED = (
    rf"(?<!\S){_LOCAL}++(?:{_OPEN}(?i:at){_CLOSE}|\x20(?i:at)\x20|[\uFF20\uFE6B]|&#64;)"
    rf"[A-Za-z0-9-]++(?:(?:\.|{_OPEN}(?i:dot){_CLOSE}|\x20(?i:dot)\x20)[A-Za-z0-9-]++)++"
)
#: A whole run of the characters of keys and tokens, in hex or base64.
RUN = r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+={0,2}+"
#: Letters and digits that a run must hold to be a value, and that a seed must.
LEAST_MIXED, SEED_MIXED, SEED_CHARS = 2, 4, 20
#: What names of secrets hold.
SECRET_NAMES = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "private_key", "auth_key", "credential")
#: What stands before a seed of a secret: a name, an assignment and a quote.
ASSIGNED = rf"(?i)(?:{'|'.join(SECRET_NAMES)})[A-Za-z0-9_]*+[\"']?\s*+[:=]{{1,2}}>?\s*+[\"'`]$"
#: The word before a match, in what lies before it, and the word after.
_BEFORE = r"(?<![\p{L}\p{N}_])([\p{L}\p{N}_]++)[^\p{L}\p{N}_]*+$"
_AFTER = r"^[^\p{L}\p{N}_]*+([\p{L}\p{N}_]++)"
#: Matches of one text are summed and compared in blocks of so many.
BLOCK = 256
TURNS = 3
#: A pattern counts from so many distinct seeds, so high a confidence; an instance from so high a one.
LEAST_SEEDS, SURE_PATTERN, SURE_INSTANCE = 5, 0.8, 0.8
#: Digits that an unseen value must have to look like an identifier.
LEAST_DIGITS = 6
#: Digits that joined runs must have: a number without its area code, and the longest card.
JOINED_DIGITS = (7, 19)
#: Digits of a country code, which an unseen phone number may lack.
CODE_DIGITS = 3
#: Rows of hot patterns are dealt over so many groups when scores are joined back.
SALTS = 16


def _running(lengths: str) -> str:
    """SQL of the running sums of an array column: of each block from the sum of all blocks before it."""
    block = f"slice({lengths}, b * {BLOCK} + 1, {BLOCK})"
    blocks = f"sequence(0, (size({lengths}) - 1) div {BLOCK})"
    nothing = "cast(array() as array<int>)"
    totals = f"transform({blocks}, b -> aggregate({block}, 0, (a, x) -> a + x))"
    starts = f"aggregate({totals}, struct(0 as at, {nothing} as out), (a, x) -> struct(a.at + x as at, concat(a.out, array(a.at)) as out), a -> a.out)"
    inside = f"aggregate({block}, struct(s as at, {nothing} as out), (a, x) -> struct(a.at + x as at, concat(a.out, array(a.at + x)) as out), a -> a.out)"
    return f"flatten(transform({starts}, (s, b) -> {inside}))"


def _matches(df: DataFrame, text: str, patterns: dict[str, tuple[str, str | None]]) -> DataFrame:
    """With a column for each name, an array of (begin, end, value, i) of all matches; ``name_found`` holds
    the values and ``name_gaps`` what lies before each and behind the last."""
    none = F.array().cast("array<string>")
    found = {}
    for name, (pattern, needed) in patterns.items():
        every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        found[f"{name}_found"] = F.when(F.instr(text, needed) > 0, every).otherwise(none) if needed else every
    df = compute_once(df, found)
    some = lambda name, value, other: F.when(F.size(f"{name}_found") > 0, value).otherwise(other)
    df = compute_once(df, {f"{n}_gaps": some(n, F.split(text, p, -1), none) for n, (p, _) in patterns.items()})
    both = "transform({0}_found, (v, i) -> length(get({0}_gaps, i)) + length(v))"
    ints = F.array().cast("array<int>")
    df = compute_once(df, {f"{n}_sizes": F.expr(both.format(n)) for n in patterns})
    df = compute_once(df, {f"{n}_ends": some(n, F.expr(_running(f"{n}_sizes")), ints) for n in patterns})
    span = "transform({0}_found, (v, i) -> struct(get({0}_ends, i) - length(v) as begin, get({0}_ends, i) as end, v as value, i as i))"
    return compute_once(df, {n: F.expr(span.format(n)) for n in patterns}).drop(*[f"{n}_{x}" for n in patterns for x in ("sizes", "ends")])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the last digit fits: every second one from the right is doubled."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, "[.]"), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    digits = _digits(value)
    if kind == "card":
        return F.length(digits).between(14, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _tested(kind: str, place: int) -> Column:
    right = F.filter(f"__{kind}", lambda s: _passes(kind, s["value"]))
    return F.transform(
        right,
        lambda s: F.struct(
            s["begin"].alias("begin"), F.lit(place).alias("place"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value"),
            *_context(f"__{kind}", s),
        ),
    )


def base_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """The table with ``base``: array of (begin, place, kind, end, value, before, after), sorted."""
    df = _matches(df, text, {f"__{kind}": (PATTERNS[kind], NEEDED[kind]) for kind in KINDS})
    kept = [_tested(kind, place) for place, kind in enumerate(KINDS)]
    df = compute_once(df, {"base": F.array_sort(F.concat(*kept))})
    return df.drop(*[f"__{kind}{x}" for kind in KINDS for x in ("", "_found", "_gaps")])


def _place(s: Column) -> list[Column]:
    return [s[c].alias(c) for c in ("begin", "end", "value")]


def _left(name: str, s: Column) -> Column:
    """What lies before a match, from the start of the match before it."""
    return F.concat(F.coalesce(F.get(F.col(f"{name}_found"), s["i"] - 1), F.lit("")), F.get(F.col(f"{name}_gaps"), s["i"]))


def _context(name: str, s: Column) -> list[Column]:
    """The word before and the word after, lower-case letters only; empty where there is none."""
    right = F.concat(F.get(F.col(f"{name}_gaps"), s["i"] + 1), F.coalesce(F.get(F.col(f"{name}_found"), s["i"] + 1), F.lit("")))
    word = lambda x: F.lower(F.regexp_replace(x, r"[^\p{L}]+", ""))
    return [
        word(F.regexp_extract(_left(name, s), _BEFORE, 1)).alias("before"),
        word(F.regexp_extract(right, _AFTER, 1)).alias("after"),
    ]


def _free(spans: str) -> Column:
    """The spans of a sorted column that overlap no base span: those of a block against the base spans near it."""
    near = f"filter(base, s -> s.end > get({spans}, b * {BLOCK}).begin AND s.begin < last.end)"
    some = f"transform(array(element_at(slice({spans}, b * {BLOCK} + 1, {BLOCK}), -1)), last -> struct(slice({spans}, b * {BLOCK} + 1, {BLOCK}) as c, {near} as n))[0]"
    clear = f"transform(array({some}), z -> filter(z.c, c -> NOT exists(z.n, s -> s.begin < c.end AND c.begin < s.end)))[0]"
    blocks = f"flatten(transform(sequence(0, (size({spans}) - 1) div {BLOCK}), b -> {clear}))"
    return F.expr(f"if(size({spans}) = 0 OR size(base) = 0, {spans}, {blocks})")


def _mixed_run(value: Column, least: int) -> Column:
    """Whether a value holds so many letters and so many digits."""
    return (F.length(_digits(value)) >= least) & (F.length(F.regexp_replace(value, "[^A-Za-z]", "")) >= least)


def _with_occurrences(df: DataFrame, text: str) -> DataFrame:
    """``seen``: base spans, seeds of secrets, and what may be an identifier outside base spans, with contexts."""
    names = {"__token": (TOKEN, None), "__joined": (JOINED, None), "__spelled": (SPELLED, None), "__run": (RUN, None)}
    df = _matches(df, text, names)
    holds_run = lambda v: v.rlike(r"[A-Za-z0-9_+/-]{16}") & v.rlike("[A-Za-z]")
    seed = lambda c: (F.length(c["value"]) >= SEED_CHARS) & _mixed_run(c["value"], SEED_MIXED) & _left("__run", c).rlike(ASSIGNED)
    df = compute_once(
        df,
        {
            "__token": F.filter("__token", lambda c: (F.length(_digits(c["value"])) >= LEAST_DIGITS) & ~holds_run(c["value"])),
            "__joined": F.filter("__joined", lambda c: F.contains(c["value"], F.lit(" ")) & F.length(_digits(c["value"])).between(*JOINED_DIGITS)),
            "__run": F.filter("__run", lambda c: _mixed_run(c["value"], LEAST_MIXED) & ~seed(c)),
            "__seed": F.filter("__run", seed),
        },
    )

    def listed(spans: Column, name: str, form: str, kind: str | None) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct(*_place(s), F.lit(kind).cast("string").alias("kind"), F.lit(form).alias("form"), *_context(name, s)),
        )

    own = F.transform("base", lambda s: F.struct(*_place(s), s["kind"].alias("kind"), F.lit("base").alias("form"), *[s[c].alias(c) for c in ("before", "after")]))
    others = [listed(_free(f"__{form}"), f"__{form}", form, None) for form in ("token", "joined", "spelled", "run")]
    seen = F.concat(own, listed(F.col("__seed"), "__run", "run", SECRET), *others)
    return compute_once(df, {"seen": seen}).drop("__seed", *[f"{n}{x}" for n in names for x in ("", "_found", "_gaps")])


def _patterns(occurrences: DataFrame) -> DataFrame:
    """One row for each lexical pattern of an occurrence: the word before, and both words."""
    both = F.when(F.col("after") != "", F.concat_ws(" ", F.lit("<"), "before", F.lit(">"), "after"))
    names = F.array_compact(F.array(F.concat(F.lit("< "), "before"), both))
    return occurrences.filter("before <> ''").withColumn("pattern", F.explode(names))


def _of_form() -> Column:
    """Whether a value's form goes with the kind: runs and secrets with one another, spelled names with e-mail."""
    run, spelled, joined = F.col("form") == "run", F.col("form") == "spelled", F.col("form") == "joined"
    kind = F.col("kind")
    return F.when(run, kind == SECRET).when(spelled, kind == "email").when(joined, ~kind.isin("email", SECRET)).otherwise(kind != SECRET)


def _fits(edges: DataFrame, values: DataFrame) -> DataFrame:
    """The values with as many digits as the seeds of their kind, where digit runs were joined."""
    n = F.length(_digits(F.col("value")))
    seeds = edges.filter("kind IS NOT NULL").groupBy("kind").agg(F.min(n).alias("least"), F.max(n).alias("most"))
    least = F.col("least") - F.when(F.col("kind") == "phone", CODE_DIGITS).otherwise(0)
    return values.join(F.broadcast(seeds), "kind").filter((F.col("form") != "joined") | n.between(least, F.col("most"))).drop("least", "most")


def discover(occurrences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pattern, kind, confidence) that are sure, and (value, form, kind) that they reveal.

    ``occurrences``: value, kind (null: unseen), form, before, after. The graph keeps each edge once, counts are
    made before edges are shuffled, and scores go back to edges by salted keys. From the second turn on, a
    pattern counts from LEAST_SEEDS seeds and values that were sure in the turn before.
    """
    edges = staged(_patterns(occurrences).select("pattern", "value", "form", "kind").distinct(), "pii-edges")
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("size"))
    seeds = edges.filter("kind IS NOT NULL").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds"))
    unseen = edges.filter("kind IS NULL").select("pattern", "value", "form")
    by_value = unseen.withColumn("salt", F.pmod(F.hash("value"), F.lit(SALTS)))
    by_pattern = unseen.withColumn("salt", F.pmod(F.hash("pattern"), F.lit(SALTS)))
    salts = F.explode(F.array(*[F.lit(k) for k in range(SALTS)]))
    mass, sure, found = seeds.withColumn("mass", F.col("seeds").cast("double")), None, None
    for turn in range(TURNS):
        scored = mass.filter(F.col("seeds") >= LEAST_SEEDS).join(sizes, "pattern")
        confidence = F.col("mass") / (F.col("size") + 1)
        sure = staged(scored.select("pattern", "kind", confidence.alias("confidence")).filter(F.col("confidence") >= 0.5), "pii-patterns")
        reached = by_value.join(sure.withColumn("salt", salts), ["pattern", "salt"]).filter(_of_form())
        chance = 1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))
        values = reached.groupBy("value", "form", "kind").agg(chance.alias("chance"), F.max("confidence").alias("best"))
        found = staged(_fits(edges, values), "pii-values")
        if turn + 1 < TURNS:
            again = by_pattern.join(found.withColumn("salt", salts), ["value", "form", "salt"])
            certain = F.count_if((F.col("chance") >= SURE_INSTANCE) & (F.col("best") >= SURE_PATTERN))
            more = again.groupBy("pattern", "kind").agg(F.sum("chance").alias("more"), certain.alias("certain"))
            both = seeds.join(more, ["pattern", "kind"], "full")
            own = F.coalesce("seeds", F.lit(0))
            mass = both.select(
                "pattern", "kind", (own + F.coalesce("certain", F.lit(0))).alias("seeds"), (own + F.coalesce("more", F.lit(0.0))).alias("mass")
            )
    one = F.max(F.struct("chance", "kind")).alias("top")
    certain = found.filter((F.col("chance") >= SURE_INSTANCE) & (F.col("best") >= SURE_PATTERN)).groupBy("value", "form").agg(one)
    return sure.filter(F.col("confidence") >= SURE_PATTERN), certain.select("value", "form", F.col("top.kind").alias("kind"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")


def find_pii(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns with ``base`` and ``spans``: arrays of (begin, place, kind, end), sorted."""
    rows = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    rows = _with_occurrences(base_spans(rows, "__text"), "__text").drop("__text")
    rows = staged(rows.withColumn("__row", F.monotonically_increasing_id()), "pii-rows")
    occurrences = rows.select("__row", F.explode("seen").alias("s")).select("__row", "s.*")
    _, certain = discover(occurrences)
    unseen = occurrences.filter("kind IS NULL").select("__row", "begin", "end", "value", "form", F.pmod(F.hash("__row"), F.lit(SALTS)).alias("salt"))
    salts = F.explode(F.array(*[F.lit(k) for k in range(SALTS)]))
    hits = unseen.join(certain.withColumn("salt", salts), ["value", "form", "salt"])
    place = F.array_position(F.array(*[F.lit(k) for k in PLACES]), F.col("kind")).cast("int") - 1
    span = F.struct("begin", place.alias("place"), "kind", "end")
    more = hits.groupBy("__row").agg(F.collect_list(span).alias("more"))
    assigned = F.filter("seen", lambda s: s["kind"] == SECRET)
    seeds = F.transform(assigned, lambda s: F.struct(s["begin"].alias("begin"), F.lit(len(KINDS)).alias("place"), F.lit(SECRET).alias("kind"), s["end"].alias("end")))
    plain = F.transform("base", lambda s: F.struct(s["begin"].alias("begin"), s["place"].alias("place"), s["kind"].alias("kind"), s["end"].alias("end")))
    kept = rows.select("__row", *keep, plain.alias("base"), seeds.alias("__seeds")).join(more, "__row", "left")
    spans = F.array_sort(F.concat("base", "__seeds", F.coalesce("more", F.array())))
    return kept.select(*keep, "base", spans.alias("spans"))


def digest(found: DataFrame, keep: list[str]) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    counts = [count(kind).alias(f"n_{kind}") for kind in KINDS]
    more = (F.size("spans") - F.size("base")).cast("bigint").alias("n_revealed")
    return found.select(*keep, *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), more)


def redact(text: Column, spans: Column) -> Column:
    """The text with every span, or run of overlapping ones, replaced by its first kind in brackets."""
    start = F.struct(F.lit(0).alias("upto"), F.array().cast("array<string>").alias("parts"))

    def add(acc: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, acc["upto"] + 1, s["begin"] - acc["upto"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(
            F.greatest(acc["upto"], s["end"]).alias("upto"),
            F.when(s["begin"] < acc["upto"], acc["parts"]).otherwise(F.concat(acc["parts"], F.array(piece))).alias("parts"),
        )

    whole = F.aggregate(spans, start, add, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["upto"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
