from __future__ import annotations

import random
import re

import duckdb
import pytest
from comparing import rows
from pyspark.sql import functions as F

from tallyspark.operators import index, retrieval
from tallyspark.plans import oracles, queries, views
from tallyspark.sources.staging import fresh_path


def made(spark, n: int = 400):
    draw = random.Random(5)
    words = [f"w{int(draw.paretovariate(0.8)) % 90}" for _ in range(n * 20)]
    rows = [(i, "s", "t", " ".join(words[i * 20 : i * 20 + draw.randint(0, 20)])) for i in range(n)]
    rows += [(n, None, None, None), (n + 1, None, None, ""), (n + 2, "s", "t", "w1 w1 w1 w2"), (n + 3, "s", "t", "w1 w1 w1 w2"), (n + 4, "s", "t", "lonely " * 500)]
    return spark.createDataFrame(rows, "chunk_id long, section_name string, section_type string, text string")


def ranked(found) -> list[tuple]:
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in found.collect())


def test_search_equals_a_full_scan(spark):
    chunks = made(spark)
    asked = spark.createDataFrame([(1, "w1"), (2, "w3 w3 w7"), (3, "w2 w40 w41 lonely"), (4, "absent"), (5, ""), (6, "s t w88 w89 w5")], "query_id long, query string")
    for block_chunks in (8, 64, 10_000):
        kept = index.build(chunks, fresh_path(spark, "bm25"), block_chunks)
        assert kept.n == chunks.count()
        for top_n in (1, 5, 1000):
            assert ranked(index.search(kept, asked, top_n)) == ranked(retrieval.bm25(chunks, asked, top_n))
    again = index.opened(spark, kept.path)
    assert (again.n, again.mean) == (kept.n, kept.mean)


def test_bounds_skip_blocks(spark):
    rows = [(i, "", "", "common " * 5 + "filler " * (i % 7)) for i in range(2000)] + [(9000 + i, "", "", "rare common") for i in range(5)]
    chunks = spark.createDataFrame(rows, "chunk_id long, section_name string, section_type string, text string")
    kept = index.build(chunks, fresh_path(spark, "bm25"), 20)
    asked = spark.createDataFrame([(1, "rare")], "query_id long, query string")
    assert {r.chunk_id for r in index.search(kept, asked, 5).collect()} == set(range(9000, 9005))
    assert kept.heads().filter("term = 'rare'").count() <= 5
    assert kept.heads().filter(F.col("term") == "common").agg(F.max("n")).first()[0] < 60


def test_many_terms_and_nothing(spark, monkeypatch):
    chunks = made(spark, 60)
    asked = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(90)))], "query_id long, query string")
    kept = index.build(chunks, fresh_path(spark, "bm25"), 16)
    monkeypatch.setattr(index, "PUSHED_TERMS", 3)
    assert ranked(index.search(kept, asked, 7)) == ranked(retrieval.bm25(chunks, asked, 7))
    empty = index.build(chunks.limit(0), fresh_path(spark, "bm25"))
    assert empty.n == 0 and index.search(empty, asked, 3).count() == 0


def test_heads_need_no_second_shuffle(spark):
    kept = index.build(made(spark, 60), fresh_path(spark, "bm25"), 16)
    by_hand = kept.postings().groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("n_tokens"), F.max("tf").alias("max_tf"), F.min("length").alias("min_length"))
    columns = ["term", "block", "n", "n_tokens", "max_tf", "min_length"]
    assert sorted(map(tuple, kept.heads().select(columns).collect())) == sorted(map(tuple, by_hand.select(columns).collect()))
    written = spark.read.parquet(f"{kept.path}/postings")
    assert written.filter("head IS NOT NULL").count() == kept.heads().count() < written.count()


def test_scan_reads_the_texts_once(spark, monkeypatch):
    chunks = made(spark, 60).filter("chunk_id < 60")
    asked = spark.createDataFrame([(1, "w1 w1 w7"), (2, "w3 absent s"), (3, "")], "query_id long, query string")
    found = retrieval.bm25(chunks, asked, 7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all(coalesce(concat_ws" not in plan and "section_name" not in plan
    expected = ranked(found)
    monkeypatch.setattr(retrieval, "SCANNED_TERMS", 1)
    assert len(expected) == 14 and ranked(retrieval.bm25(chunks, asked, 7)) == expected
    assert retrieval.bm25(chunks, asked.filter("query_id = 3"), 7).count() == 0


def test_fused_lists_need_no_index(spark, monkeypatch):
    monkeypatch.setattr(views, "kept_index", None)
    assert queries.post_filter(spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("scanned_terms", [10_000, 1])
def test_benchmark_deals_counts_and_no_pairs(spark, tmp_path, monkeypatch, scanned_terms):
    """Over rows with repeated ids, of equal and of other lengths, and long queries that share their terms."""
    duck = duckdb.connect()
    duck.execute("""COPY (SELECT i % 150 AS doc_id, 'src' || i % 3 AS source, CASE WHEN i % 4 > 0 THEN 'en' END AS lang, CASE WHEN i % 11 > 0 THEN
      list_aggregate(list_transform(range(0, 5 + i % 150 % 9 + (i // 150 % 2)), lambda k: 'w' || hash(i * 31 + k) % 60), 'string_agg', ' ') END AS text FROM range(0, 450) t(i)) TO '{0}/documents.parquet'""".format(tmp_path))
    duck.execute("""COPY (SELECT i AS item_id, list_aggregate(list_transform(range(0, i % 25), lambda k: 'w' || hash(i + k) % 70), 'string_agg', ' ') AS text FROM range(0, 30) t(i)) TO '{0}/benchmark.parquet'""".format(tmp_path))
    for name in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    expected = rows(duck.execute(oracles.SQL["bm25_benchmark"]).df())
    monkeypatch.setattr(retrieval, "SCORED_PAIRS", 1000)
    monkeypatch.setattr(retrieval, "SCANNED_TERMS", scanned_terms)
    found = queries.bm25_benchmark(spark, str(tmp_path))
    dealt = re.findall(r"Exchange hashpartitioning\((.*?), (\d+)\)", re.sub(r"#\d+L?", "", found._jdf.queryExecution().executedPlan().toString()))
    assert ("chunk_id", "13") in dealt and {by for by, _ in dealt} <= {"chunk_id", "query_id", "term"}
    assert len(expected) > 60 and rows(found.toPandas()) == expected
