"""Fill-in-middle against its definition, and round trips for other units."""

import hashlib
import re

import regex
import duckdb
import pytest

from pairmill.llm import infill, queries


def expected_row(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    form = "plain" if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
    p, m, s = text[:a], text[a:b], text[b:]
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, n, form, None if form == "plain" else a, None if form == "plain" else b - a, sha(out), sha(text))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("infill")
    rows = [(k, ("é😀 a\nb\r\n\x00中" * (k % 7))[: k % 41]) for k in range(300)]
    rows += [(k, f"x{m}y") for k, m in zip(range(300, 360), ["<P>", "<S>", "<M>", "<p>", "< P>"] * 12)]
    rows += [(400, None), (401, ""), (None, "no id"), (None, None), (7, rows[7][1]), (402, "ab\n" * 300_000)]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id bigint, text string, `__whole` int, `__draws` int, `a.b` int")
    df.repartition(3).write.parquet(f"{root}/documents.parquet")
    return str(root), rows


def test_query_against_its_definition_and_sql(spark, tables):
    root, rows = tables
    order = lambda r: tuple((x is not None, x) for x in r)
    df = queries.fill_in_middle(spark, root)
    found = sorted((tuple(r) for r in df.collect()), key=order)
    assert found == sorted((expected_row(*r) for r in rows), key=order)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{root}/documents.parquet/*.parquet'")
    other = con.execute(queries.FILL_IN_MIDDLE_SQL)
    assert [d[0] for d in other.description] == df.columns
    assert sorted(other.fetchall(), key=order) == found


@pytest.mark.parametrize("unit", [infill.CODE_POINT, r"\s*\S+\s*", r"[^\n]*\n|[^\n]+", r"\X"])
def test_other_units_cut_between_units(unit):
    text, compiled = "one  two\nthrée\n👩‍🚀 x", regex.compile(f"({unit})*")
    units = [m.group() for m in regex.finditer(unit, text)]
    for first in range(30):
        n, low, high, begin, end = infill.cut(text, first, 17, compiled)
        assert n == len(units) and text[:begin] == "".join(units[:low]) and text[begin:end] == "".join(units[low:high])
        for form in (infill.PLAIN, infill.PSM, infill.SPM):
            assert infill.restored(infill.written(text, begin, end, form), form) == text


def test_text_that_is_no_sequence_of_units_stays(spark):
    df = spark.createDataFrame([(k, "no digits") for k in range(20)], "doc_id bigint, text string")
    rows = infill.fill_in_middle(df, ["doc_id"], unit=r"\d").collect()
    assert all(r.form == "plain" and r.output == r.restored == "no digits" for r in rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, output string")
    assert infill.fill_in_middle(empty, ["doc_id"]).collect() == []
