"""Every dealt operator against brute force, on a fixture of awkward rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from pairmill.llm import bpe, interpolated_lm, langid, licences, neardup, pii, templates, toxicity, weighted_sampling, winnowing
from pairmill.llm.textblock import SPACES, Block, Words

SCHEMA = "doc_id bigint, text string, lang string, score double, row string"
LONG = " ".join(f"w{i % 977}x" for i in range(20_000))
BASE = " ".join(f"a{i}" for i in range(120))
NEAR = BASE.replace("a60 ", "other ")
TEXTS = [
    (1, BASE), (2, NEAR), (3, BASE), (3, BASE), (4, None), (5, ""), (6, " \t\n"), (7, "one two"), (8, "One  two"), (9, LONG),
    (10, LONG), (11, "Été ß 中文  x y"), (None, "no id here at all"), (12, "mail a.b@c.d.e x_y@z.org, 1.2.3.4 999.1.1.1 4111 1111 1111 1111 +1 (555) 123-4567"),
]


def words(text, pattern):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(pattern, lower)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if i and i % 2 else None, 0.5, "x") for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_language_ids(spark, docs, empty):
    english, french = "the house of the people and the law", "le chat de la maison est sur la table"
    taught = spark.createDataFrame([(english, "en")] * 3 + [(french, "fr")] * 3 + [("der hund", None)], "text string, lang string")
    model = langid.fit(taught)
    rows = langid.predict(taught, model, ["lang"]).collect()
    assert all(r.lang_pred == r.lang for r in rows if r.lang) and all(0 <= r.score <= 1 for r in rows)
    found = {r.doc_id: r for r in langid.predict(docs, model, ["doc_id"]).collect()}
    assert all(found[k].lang_pred == "und" and found[k].ambiguous for k in (4, 5, 6))
    nothing = langid.fit(empty)
    assert {r.lang_pred for r in langid.predict(docs, nothing, ["doc_id"]).collect()} == {"und"}
    assert langid.predict(empty, model, ["doc_id"]).count() == 0


@pytest.mark.parametrize("n", [2, 4, 5, 6, 20])
def test_codewords_differ(n):
    code = langid.codewords(n)
    assert min((code[a] != code[b]).sum() for a in range(n) for b in range(a)) >= 1


def test_bpe_as_tiktoken(spark, docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    vocabulary = bpe.Vocabulary(open(path, "rb").read())
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    draw = np.random.default_rng(3)
    parts = ["'", "s", "re", "r", "ll", "ve", " ", "  ", "\n", "\t", "a", "Z", "é", "1", "²", "!", " ", "\x1c", "\x85", "中", "'S", "😀", "​", "ab" * 200]
    texts = ["".join(draw.choice(parts, draw.integers(0, 12))) for _ in range(3000)]
    for text, (ids, starts, firsts) in zip(texts, bpe.encode_texts(texts, vocabulary)):
        assert np.frombuffer(ids, "<u4").tolist() == known.encode_ordinary(text)
        assert vocabulary.decode(ids).decode() == text
        if len(text) > 4:
            assert text[2:4] in bpe.decode_range(vocabulary, ids, starts, firsts, 2, 4).decode()
    ranks = bpe.send_ranks(spark, path)
    rows = bpe.decode(bpe.encode(docs, ranks, ["doc_id", "text"]), ranks, ["doc_id", "text"]).collect()
    assert len(rows) == len(TEXTS) and all(bytes(r.decoded).decode() == (r.text or "") for r in rows)


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def passes(kind, value):
        d = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(x) <= 255 for x in value.split("."))
        if kind == "card":
            return 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else (2 * int(c) - 1) % 9 + 1 if int(c) else 0 for i, c in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 10 <= len(d) <= 15

    return sorted((m.start(), place, kind, m.end()) for place, (kind, p) in enumerate(PII.items()) for m in re.finditer(p, text) if passes(kind, m.group()))


def test_base_spans(spark):
    draw = np.random.default_rng(5)
    parts = ["a", "b.", "@", ".c", "-", "1", "22", "255", "256", " ", ".", "+", "(", ")", "é", "😀", "4111111111111111", "x@y.z"]
    texts = ["".join(draw.choice(parts, draw.integers(0, 30))) for _ in range(400)] + [t for _, t in TEXTS] + ["1 " * 20_000, "a" * 50_000]
    rows = pii.find_pii(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string"), ["k"]).collect()
    for r in rows:
        assert [(s.begin, s.place, s.kind, s.end) for s in r.base] == base_spans(texts[r.k] or "")


def test_contexts_reveal_unseen_identifiers(spark):
    rows = [(k, f"foo serial user{k}@mail.example.com bar") for k in range(12)] + [(99, "foo serial 77-AB-991234 bar"), (100, "other 77-AB-001234 end")]
    found = {r.k: r for r in pii.find_pii(spark.createDataFrame(rows, "k int, text string"), ["k"]).collect()}
    assert [s.kind for s in found[99].spans] == ["email"] and not found[99].base
    assert not found[100].spans and found[3].spans == found[3].base
    df = spark.createDataFrame([(1, "to a@b.c, or 1.2.3.4")], "k int, text string")
    clean = pii.find_pii(df, ["k", "text"]).select(pii.redact(pii.F.col("text"), pii.F.col("spans"))).first()[0]
    assert clean == "to [EMAIL], or [IP]"


def test_contexts_reveal_spaced_numbers_and_spelled_addresses(spark):
    rows = [(k, f"please call +1 (555) 123-45{k} now") for k in range(10, 40)] + [(100 + k, f"please mail user{k}@mail.example.com today") for k in range(30)]
    unseen = {
        201: ("please call ", "017 555 7713", " now", "phone"), 202: ("please call ", "(017) 555-77 13", " now", "phone"),
        203: ("please mail ", "jane(at)mail.example", " today", "email"), 204: ("please mail ", "jane [at] mail [dot] example", " today", "email"),
        205: ("please call ", "joe(at)mail.example", " now", None), 206: ("other ", "017 555 7714", " end", None),
    }
    rows += [(k, "".join(v[:3])) for k, v in unseen.items()]
    found = {r.k: r for r in pii.find_pii(spark.createDataFrame(rows, "k int, text string"), ["k"]).collect()}
    for k, (before, value, _, kind) in unseen.items():
        assert [(s.begin, s.end, s.kind) for s in found[k].spans] == ([(len(before), len(before) + len(value), kind)] if kind else [])


def test_secrets_seed_patterns_and_sure_values_further_ones(spark):
    """Assigned secrets make the word before them a pattern; what it reveals makes the next word one."""
    run = lambda k: f"{k:04x}c0ffee{k * 19:06d}ab12de{k:03d}"
    rows = [(k, f'set token = "{run(k)}" here') for k in range(60)]
    rows += [(100 + k, f"the token {run(100 + k)} and bearer {run(100 + k)} there") for k in range(10)]
    rows += [(200, f"a bearer {run(200)} only"), (201, f"commit {run(201)} only"), (202, 'checksum = "' + run(202) + '"')]
    found = {r.k: [(s.begin, s.end, s.kind) for s in r.spans] for r in pii.find_pii(spark.createDataFrame(rows, "k int, text string"), ["k"]).collect()}
    size = len(run(1))
    assert all(found[k] == [(13, 13 + size, "secret")] for k in range(60))
    assert all(("secret" in {s[2] for s in found[100 + k]}) and len(found[100 + k]) == 2 for k in range(10))
    assert found[200] == [(9, 9 + size, "secret")] and not found[201] and not found[202]


def test_places_and_overlaps_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(pii, "BLOCK", 3)
    text = "é 12-345678 x@y.zz 77.1.2.3 555-1234567 😀 4111111111111111 A1234567 " * 5
    row = pii._with_occurrences(pii.base_spans(spark.createDataFrame([(text,)], "text string")), "text").first()
    assert [(s.begin, s.place, s.kind, s.end) for s in row.base] == base_spans(text)
    assert all(text[s.begin : s.end] == s.value for s in row.seen)
    taken = [(s.begin, s.end) for s in row.base]
    tokens = [(m.start(), m.end()) for m in re.finditer(r"\S+", text) if sum(c in "0123456789" for c in m.group()) >= pii.LEAST_DIGITS]
    free = {t for t in tokens if not any(a < t[1] and t[0] < b for a, b in taken)}
    assert {(s.begin, s.end) for s in row.seen if s.form == "token"} == free


def test_personal_data_of_no_rows_and_clashing_names(spark):
    kinds = "doc_id bigint, text string, begin int, kind string, __run string"
    assert not pii.find_pii(spark.createDataFrame([], kinds), ["doc_id", "kind"]).collect()
    df = spark.createDataFrame([(1, "a@b.c", 5, "k", "z"), (None, None, None, None, None)], kinds)
    assert {(r.doc_id, r.kind, len(r.spans)) for r in pii.find_pii(df, ["doc_id", "kind"]).collect()} == {(1, "k", 1), (None, None, 0)}


def test_licences(docs):
    tag = "x SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0. End"
    found = licences.scan(tag)
    assert found["expressions"] == ["(mit OR gpl-2.0-only WITH classpath-exception-2.0) AND apache-2.0"] and found["obligation"] == 1
    assert licences.shunt(["a", "or", "b", "and", "c"]) == ["a", "b", "c", "and", "or"] and licences.shunt(["(", "a"]) is None
    draw = np.random.default_rng(2)
    for _ in range(300):
        text = " ".join(draw.choice(["CC", "by", "General", "public license", "All rights", "reserved", "é", "x-y"], 25))
        w, got = words(text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), licences.scan(text)
        at = sorted(i for p in licences.BASE_PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"]) == (len(w), len(at), at[0] if at else None, at[-1] if at else None)
    assert licences.scan_licences(docs, ["doc_id"]).count() == len(TEXTS)


@pytest.mark.parametrize(
    "text, form, obligation",
    [
        ("MIT AND LGPL-3.0", "mit AND lgpl-3.0", 3),
        ("MIT AND LicenseRef-Own", "mit AND licenseref-own", 6),
        ("Own-1.0 OR MIT", "own-1.0 OR mit", 1),
        ("Own-1.0", "own-1.0", 6),
        ("Own-1.0 WITH LLVM-exception", "own-1.0 WITH llvm-exception", 6),
        ("GPL-2.0 WITH Own-exception", "gpl-2.0 WITH own-exception", 6),
        ("MIT AND DocumentRef-a:LicenseRef-b", "mit AND documentref-a:licenseref-b", 6),
        ("(MIT OR\n * Apache-2.0)\n * AND GPL-2.0+\n * more", "(mit OR apache-2.0) AND gpl-2.0+", 4),
        ("\n// MIT\n// and so on", "mit", 1),
        ("MIT AND", "? mit AND", 6),
        ("(MIT AND GPL-3.0", "? (mit AND gpl-3.0", 6),
        ("MIT, AGPL-3.0", "? mit", 6),
        ("MIT*/ int main", "mit", 1),
        ("MIT. GPL-3.0 is another", "mit", 1),
    ],
)
def test_whole_licence_expressions(text, form, obligation):
    found = licences.scan(f"# SPDX-License-Identifier: {text}")
    assert found["expressions"] == [form] and found["obligation"] == obligation
    names = set(re.findall(r"[a-z0-9][a-z0-9.+:-]*", form)) - set(licences.EXCEPTIONS)
    assert set(found["labels"].split(",")) == names


@pytest.mark.parametrize(
    "text, labels, expressions",
    [
        ("Released under the MIT License.", "mit", ["mit"]),
        ("Licensed under the Apache License, Version 2.0.", "apache-2.0", []),
        ("licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0", []),
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc", []),
        ("All rights reserved.", "reserved", []),
        ("dual-licensed under either MIT OR (Apache-2.0 AND ISC).", "apache-2.0,isc,mit", ["mit OR (apache-2.0 AND isc)"]),
        ("released under a grey sky and MIT", "", []),
    ],
)
def test_licence_lines_in_prose(text, labels, expressions):
    found = licences.scan(text)
    assert (found["labels"], found["expressions"]) == (labels, expressions)


def test_no_licence_expression():
    for text in ("", "\n\nint", "\nint main", "AND MIT"):
        found = licences.scan(f"SPDX-License-Identifier: {text}")
        assert found["expressions"] == [] and found["obligation"] is None


def test_lm_counts(spark, docs, empty):
    rows = interpolated_lm.score_texts(docs).collect()
    held = {r.doc_id for r in rows if r.held_out}
    counts = Counter()
    for i, t in TEXTS:
        if i not in held:
            counts.update([*words(t, r"[^\x20\x09-\x0D]+"), None])
    total, types = sum(counts.values()), len(counts)
    base = lambda t: sum(np.log10((counts[w] + 0.1) / (total + 0.1 * (types + 1))) for w in [*words(t, r"[^\x20\x09-\x0D]+"), None])
    text_of = dict(TEXTS)
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert r.train_tokens == total and r.base_score == pytest.approx(base(text_of[r.doc_id])) and r.score < 0
    assert interpolated_lm.score_texts(empty).count() == 0


def test_weights_prefer_what_predicts():
    n = np.array([90.0, 10.0])
    weights = interpolated_lm.learn_weights(np.array([5 * 128 * 128 + 9, 5 * 128 * 128]), n, n * [0.9, 0.0], n * 0.01, 1e-6)
    assert weights[5].argmax() == 0 and np.allclose(weights.sum(1), 1)


def jaccard(a, b):
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / max(1, sum(max(a[k], b[k]) for k in keys))


def test_weighted_sampling(spark, docs, empty):
    draw = np.random.default_rng(1)
    texts = [" ".join(f"t{k}" for k in draw.integers(0, 60, 200)) for _ in range(60)]
    marks = weighted_sampling.fingerprints(texts)
    bags = [Counter(t.split()) for t in texts]
    error = [weighted_sampling.likeness(marks[a], marks[b]) - jaccard(bags[a], bags[b]) for a in range(60) for b in range(a)]
    # all pairs draw from the same 64 places, so their errors move together
    assert abs(np.mean(error)) < 0.04 and np.std(error) < 0.08
    rows = weighted_sampling.compare_with_edits(docs).collect()
    order = sorted(TEXTS, key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = Counter()
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        want[i, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == want
    assert weighted_sampling.compare_with_edits(empty).count() == 0


def test_toxicity_swaps_keep_scores(spark, empty):
    rows = [(k, "you muslim idiot go away" if k % 2 else "the christian people of the town") for k in range(80)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id bigint, toxic int")
    texts = [(k, f"{t} number{k}") for k, t in rows]
    docs = spark.createDataFrame(texts + [(500, None), (501, "")], "doc_id bigint, text string")
    model = toxicity.fit(docs, labels)
    insult, neutral, swapped = model.scores(["you idiot go away", "the christian people of the town", "the muslim people of the town"])
    assert insult >= 0.7 > 0.5 > swapped and abs(neutral - swapped) < 0.1
    assert toxicity.score(docs, model, ["doc_id"]).count() == 82
    assert toxicity.fit(empty, labels).scores(["x"])[0] < 1e-6


def test_swaps_as_swapped_texts():
    """Features lost and gained, against the features of the sentence written out with another term."""
    texts = ["Old men and old women", "The elderly blind man met a blind woman. Then a white, whitish citizen! None here", "\u017fikh \u0130ndian sikh", ""]
    names = np.unique(np.concatenate([h for t in [*texts, *toxicity._GROUP_OF] for h, _ in toxicity.features([t]) for h in [h]]))
    for text in texts:
        expected = Counter()
        for sentence in toxicity._SENTENCE.findall(text):
            seen = set()
            for found in toxicity._TERM.finditer(sentence):
                term = found.group().lower()
                if term not in toxicity._GROUP_OF or term in seen:
                    continue
                seen.add(term)
                for other in set(toxicity._GROUP_OF[term]) - {term}:
                    new = sentence[: found.start()] + other + sentence[found.end() :]
                    a, b = (set(toxicity._known([t], names)[1].tolist()) for t in (sentence, new))
                    if a != b:
                        expected[tuple(sorted(a - b)), tuple(sorted(b - a))] += 1
        assert toxicity.swaps(text, names) == expected


def test_swaps_of_a_long_sentence_are_few():
    names = np.unique(np.concatenate([h for t in toxicity._GROUP_OF for h, _ in toxicity.features([t])]))
    assert sum(toxicity.swaps("men women black white " * 50_000, names).values()) <= 2 + 4


def test_the_penalty_moves_scores_of_swapped_sentences(spark):
    """A group named in insults only: without the penalty its name alone counts as toxic, with it it does not."""
    texts = [(k, f"you muslim idiot go away number{k}" if k % 2 else f"the christian people of the town number{k}") for k in range(80)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id bigint, toxic int")
    pair = ["a christian came", "a muslim came"]  # no other word that the model knows
    gap = {c: float(np.subtract(*toxicity.fit(docs, labels, penalty=c).scores(pair))) for c in (0.0, 1.0)}
    assert gap[0.0] < -0.1 and abs(gap[1.0]) < abs(gap[0.0]) / 4


def test_lm_scores_do_not_depend_on_the_partitions(spark):
    draw = np.random.default_rng(12)
    texts = [" ".join(f"w{min(x, 60)}" for x in draw.geometric(0.05, draw.integers(0, 60))) for _ in range(400)]
    df = spark.createDataFrame([(k if k % 50 else None, t) for k, t in enumerate(texts)], "doc_id bigint, text string").cache()
    found = []
    for n in (1, 5, 16):
        rows = interpolated_lm.score_texts(df.repartition(n)).collect()
        found.append(sorted((str(r.doc_id), r.n_tokens, round(r.base_score, 9), round(r.score, 9)) for r in rows))
    assert found[0] == found[1] == found[2] and len(found[0]) == 400


def test_near_duplicates(docs, empty):
    rows = neardup.near_duplicates(docs).collect()
    found = {r.doc_id: r for r in rows}
    assert len(rows) == len(TEXTS) and found[None].kept and found[None].component_id is None
    assert [found[k].component_id for k in (1, 2, 3, 7, 8, 9, 10)] == [1, 1, 1, 7, 7, 9, 9]
    assert all(found[k].n_shingles == 0 and found[k].kept for k in (4, 5, 6)) and found[7].n_shingles == 1
    assert neardup.near_duplicates(empty).count() == 0


def test_rows_of_one_id_are_one_node(spark):
    a, b = ("alpha beta gamma delta epsilon zeta", "one two three four five six")
    df = spark.createDataFrame([(1, a), (5, a), (5, b), (7, b), (9, b + " seven eight"), (9, "x y z")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(df).collect()) == [(1, 1), (5, 1), (5, 1), (7, 1), (9, 9), (9, 9)]


@pytest.mark.parametrize("rounds, block, ids", [(3, 500, 1_000_000), (1, 2, 0)])
def test_near_duplicates_as_brute_force(spark, monkeypatch, rounds, block, ids):
    """Random texts with repeated ids and copies, against all pairs; large buckets in blocks, ids joined or sent."""
    monkeypatch.setattr(neardup, "HUB_ROUNDS", rounds)
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", block)
    monkeypatch.setattr(neardup, "BROADCAST_IDS", ids)
    draw = np.random.default_rng(11)
    texts = [" ".join(draw.choice(list("abcdefghijklmnop"), draw.integers(0, 40))) for _ in range(30)]
    rows = []
    for _ in range(160):
        w = texts[draw.integers(30)].split()
        if w and draw.random() < 0.5:
            w[draw.integers(len(w))] = "q"
        rows.append((int(draw.integers(120)), " ".join(w)))
    sets = [(k, {tuple(w[i : i + 3]) for i in range(max(len(w) - 2, 1))} if w else set()) for k, t in rows for w in [t.split()]]
    label = {k: k for k, _ in rows}
    for _ in rows:
        for (i, x) in sets:
            for (j, y) in sets:
                if i != j and x and y and label[i] != label[j] and 100 * len(x & y) >= 85 * len(x | y):
                    label[i] = label[j] = min(label[i], label[j])
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    some = {k for k, x in sets if x} - {k for k, x in sets if not x}
    assert {(r.doc_id, r.component_id) for r in found if r.doc_id in some} == {(k, label[k]) for k in some}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 90)], "a bigint, b bigint")
    assert {r.node: r.label for r in neardup.components(edges).collect()} == {**{k: 1 for k in range(1, 41)}, 90: 90, 100: 90}


def test_winnowing(spark, docs, empty):
    draw = np.random.default_rng(8)
    texts = [" ".join(draw.choice(list("abc"), draw.integers(0, 60))) for _ in range(120)]
    items = [" ".join(draw.choice(list("abc"), n)) for n in (3, 5, 9, 10, 11, 14, 25)] + ["", None, " ".join("abc" * 5)]
    left = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    right = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    for r in winnowing.decontaminate(left, right).collect():
        w, hit, names = texts[r.doc_id].split(), set(), set()
        for i, item in enumerate(items):
            own = (item or "").split()
            n = min(10, len(own))
            for s in range(len(own) - n + 1 if n else 0):
                for k in range(len(w) - n + 1):
                    if w[k : k + n] == own[s : s + n]:
                        hit |= set(range(k, k + n))
                        names.add(str(i))
        assert (r.n_words, r.n_hit, r.items) == (len(w), len(hit), sorted(names))
    assert winnowing.decontaminate(docs, right).count() == len(TEXTS)
    assert {r.n_hit for r in winnowing.decontaminate(docs, empty.selectExpr("doc_id AS item_id", "text")).collect()} == {0}


def test_templates(spark):
    page = '<html><head><title>t</title></head><body><div>Same on all</div><nav>menu</nav><div id="x">Own {k}<p>Part &amp; {k}<br>end<p>Two {k}</div><div class="user comments">c</div><script>if (a<b) x("</p>")</script></body></html>'
    marked = "<body><article><h1>Head</h1><p><b>One<br><p>Two&nbsp; 2</article><footer>f</footer>"
    rows = [(k, "https://A.example.com/p", page.format(k=k)) for k in range(6)] + [(9, None, marked), (10, "x", None), (11, "http://b.c", "")]
    found = {r.page_id: r for r in templates.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert found[3].text == "Own 3\nPart & 3 end\nTwo 3" and found[9].text == "Head\nOne\nTwo 2"
    assert found[10].text == "" and found[11].n_chars == 0 and len(found) == 9


@pytest.mark.parametrize(
    "page",
    [
        '<html class="no-search"><body class="single has-sidebar"><p>Own text</p></body></html>',
        '<body class="search-enabled"><main id="menu-open"><p>Own text</p></main>',
        '<nav>much more words than the text has</nav><article class="post comments-open"><p>Own text</p></article>',
        '<nav>much more words than the text has</nav><div class="with-sidebar"><div class="menu-open"><p>Own text</p></div><div class="sidebar">s</div></div>',
    ],
)
def test_class_words_do_not_take_the_page(page):
    assert templates.main_text(templates.parse(page), frozenset()) == "Own text"


@pytest.mark.parametrize(
    "page, text",
    [
        ('<article><p>Hello <span class="share">x</span> world</p></article>', "Hello world"),
        ('<article><p id="search-algorithms">On search</p><h2 id="menu">Menus</h2></article>', "On search\nMenus"),
        ('<article><p class="advert">Buy</p><p>Read</p></article>', "Read"),
        ("<p>a" + "<b>" * 30_000 + "</i>" * 30_000 + "z", "az"),
    ],
)
def test_inline_elements_ids_and_stray_ends(page, text):
    assert templates.main_text(templates.parse(page), frozenset()) == text


def test_templates_count_distinct_pages(spark, monkeypatch):
    copy = "<body><div>Same <p>in all copies</div>{}</body>"
    inside = "<body><article><div><p>Copied article</p></div></article></body>"
    rows = [(k, "http://copies.com/", copy.format("")) for k in range(6)] + [(10 + k, "http://inside.com/", inside) for k in range(6)]
    # a menu on 100 of 12,000 distinct pages, less than one in a hundred
    rows += [(1000 + k, "http://large.com/", f"<body>{'<div>Section menu</div>' if k < 100 else ''}<div>Own {k}</div></body>") for k in range(12_000)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")

    def check():
        found = {r.page_id: r.text for r in templates.extract(df).collect()}
        assert len(found) == len(rows) and found[0] == "Same\nin all copies" and found[10] == "Copied article"
        assert found[1000] == "Own 0" and found[12_999] == "Own 11999"

    check()
    monkeypatch.setattr(templates, "BROADCAST_KEYS", 0)  # by joins
    check()


def test_templates_inside_articles(spark, monkeypatch):
    quote, advert = "<p>Quoted by some", "<p>Read our letter</p><div><p>Advert</p></div>"
    page = "<body><article><h1>Head {k}</h1>{quote}<div><p>Own {k}</div>{advert}</article></body>"
    rows = [(k, "http://a.com/", page.format(k=k, quote=quote if k < 6 else "", advert=advert)) for k in range(40)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")

    def check():
        for r in templates.extract(df).collect():
            assert r.text == f"Head {r.page_id}\n" + ("Quoted by some\n" if r.page_id < 6 else "") + f"Own {r.page_id}"

    check()
    monkeypatch.setattr(templates, "BROADCAST_KEYS", 0)  # by joins
    check()


def test_words_of_a_block():
    words = Words(Block(["a B", "", "b a"]), SPACES)
    assert words.counts().tolist() == [2, 0, 2] and words.hashes[0] == words.hashes[3] and words.hashes[1] == words.hashes[2]
