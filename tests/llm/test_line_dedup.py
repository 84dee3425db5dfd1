from collections import defaultdict

import duckdb

from memspark.llm.line_dedup import MIN_SITES, REPORT_SQL, dedup_lines, line_report

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, k1 string, kept string"


def rows():
    out = []
    for k in range(40):
        lines = [f"own line {k}", "common  line" if k % 2 else " common  line\t", ""]
        if k % 8 < 5:
            lines.append("almost common")  # five sites
        if k % 8 < 6:
            lines.insert(0, "just common")  # six sites
        if k % 3 == 0:
            lines.append("common  line")
        out.append((k, "\n".join(lines), "en", f"s{k % 8}"))
    out += [(100, None, "en", "s1"), (101, "", None, "s1"), (102, "common  line", "en", None), (102, "common  line", "en", None), (103, "only " + "x" * 300000, "en", "s3"), (None, "own line 3\nno id", "en", "s2")]
    return [(d, t, lang, s, len(t or ""), "clash", "clash") for d, t, lang, s in out]


def expected(data, least=MIN_SITES):
    sites, first = defaultdict(set), {}
    for d, t, _, s, *_ in data:
        for pos, line in enumerate((t or "").split("\n") if t is not None else []):
            body = line.strip(" \t\r")
            if body:
                sites[body].add(s or "")
                place = (-1 if d is None else d, pos)
                first[body] = min(first.get(body, place), place)
    out = []
    for d, t, *_ in data:
        lines = t.split("\n") if t is not None else []
        kept = [x for p, x in enumerate(lines) if not (b := x.strip(" \t\r")) or len(sites[b]) < least or first[b] == (-1 if d is None else d, p)]
        out.append((d, len(lines), len(lines) - len(kept), t if len(kept) == len(lines) else "\n".join(kept)))
    return out


def test_report_equals_brute_force(spark):
    import hashlib

    data = rows()
    got = sorted(((r.doc_id, r.n_lines, r.n_removed, r.text_sha256) for r in line_report(spark.createDataFrame(data, SCHEMA)).collect()), key=str)
    want = sorted(((d, n, k, hashlib.sha256((t or "").encode()).hexdigest()) for d, n, k, t in expected(data)), key=str)
    assert got == want
    assert sum(r[2] for r in got) > 40


def test_sql_agrees(spark):
    import pandas as pd

    data = [r for r in rows() if r[0] is not None and r[0] != 102]
    documents = pd.DataFrame(data, columns=["doc_id", "text", "lang", "source", "n_chars", "k1", "kept"])  # noqa: F841
    want = sorted(duckdb.sql(REPORT_SQL).fetchall())
    assert sorted(tuple(r) for r in line_report(spark.createDataFrame(data, SCHEMA)).collect()) == want


def test_texts_after_removal(spark):
    data = rows()
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(data, SCHEMA)).collect()}
    for d, n, k, t in expected(data):
        assert (d in got) == (k == 0 or bool(t.strip()))
        if d in got:
            assert got[d] == t
    assert 102 not in got and 100 in got and 101 in got


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert line_report(empty).count() == 0 and dedup_lines(empty).count() == 0


def test_hot_lines_and_equal_rows(spark):
    """A line on all rows and one row that makes up half of the table take the broadcast way."""
    data = [(k, f"own {k}\nshared by all", "en", f"s{k % 20}", 0) for k in range(1500)] + [(5000, "shared by all\nmore text", "en", "s1", 0)] * 1500
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {(r.doc_id, r.text) for r in dedup_lines(docs).collect()}
    assert dedup_lines(docs).count() == 3000
    assert got == {(0, "own 0\nshared by all"), (5000, "more text")} | {(k, f"own {k}") for k in range(1, 1500)}
