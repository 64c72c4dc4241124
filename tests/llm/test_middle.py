from __future__ import annotations

import hashlib
import re

from comparing import DATA, rows, tables
from conftest_llm import ODD, frame, prose
from pyspark.sql import functions as F

from tallyspark.llm import middle, queries
from tallyspark.llm.common import table
from tallyspark.llm.oracles import SQL

CUT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def expected(doc_id: int | None, text: str | None, seed: int = 42, percent: int = 50, suffix_first: int = 80) -> tuple:
    text = text or ""
    pieces = CUT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(pieces) + 1) for x in h[:2])
    p, m, s = "".join(pieces[:a]), "".join(pieces[a:b]), "".join(pieces[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= percent:
        return doc_id, len(pieces), "plain", None, None, text, text
    if h[3] % 100 < suffix_first:
        return doc_id, len(pieces), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, len(pieces), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def transformed(docs, **options) -> list[tuple]:
    found = middle.fill_in_middle(docs, **options)
    return sorted((tuple(r) for r in found.withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()), key=str)


def test_tables_against_brute_force(spark):
    docs = table(spark, str(DATA / "sf0.01"), "documents")
    found = transformed(docs)
    assert found == sorted((expected(r.doc_id, r.text) for r in docs.collect()), key=str)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}


def test_query_equals_sql(spark):
    found = queries.op11_marker_injection(spark, str(DATA / "sf0.001")).toPandas()
    assert rows(found) == rows(tables("sf0.001").execute(SQL["op11_marker_injection"]).df())


def test_odd_rows_and_nothing(odd, none):
    for options in ({}, {"percent": 100, "suffix_first_percent": 0}, {"percent": 100, "suffix_first_percent": 100, "seed": 7}):
        want = sorted((expected(i, t, options.get("seed", 42), options.get("percent", 50), options.get("suffix_first_percent", 80)) for i, t, _ in ODD), key=str)
        assert transformed(odd, **options) == want
    assert transformed(none) == []


def test_delimiters_sentinels_and_borders(spark):
    texts = ["\x01\x02m \x02e\x01 \x02", "a <", "<S", "S> <P x", "b <P> c", "<M>", "😀 é x  \n", "  ", "a\x01", "\x02", "x <S y> <", "< P> <S", "\t\x0b\x0c\r\n w"]
    docs = [(i, t, "a") for i, t in enumerate(texts * 40)]
    want = sorted((expected(i, t, percent=100, suffix_first=50) for i, t, _ in docs), key=str)
    assert transformed(frame(spark, docs), percent=100, suffix_first_percent=50) == want
    assert all(r[5] == r[6] for r in want if r[2] == "plain")


def test_long_text_and_no_shuffle(spark):
    docs = [(i, prose(3, 120_000) + " " * 5000, "a") for i in range(8)]
    assert transformed(frame(spark, docs), percent=100) == sorted((expected(i, t, percent=100) for i, t, _ in docs), key=str)
    plan = middle.fill_in_middle(frame(spark, docs))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
