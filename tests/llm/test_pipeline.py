from __future__ import annotations

import public_tokenizers
from comparing import DATA
from conftest_llm import frame
from pyspark.sql import functions as F

import corpus_pipeline
from tallyspark.llm.common import table


def test_stages_in_order_and_columns(spark):
    docs = table(spark, str(DATA / "sf0.001"), "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "near_duplicates", "personal_data", "packing"]
    kept = {docs.count()}
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(DATA / "sf0.001")).cache()
        assert at.columns == docs.columns
        kept.add(at.count())
    assert min(kept) > 0 and len(kept) > 2
    packed = corpus_pipeline.run(spark, str(DATA / "sf0.001"))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in at.collect()}
    assert public_tokenizers.path("word_bpe_49k.json")


def test_stages_on_nothing(spark, none, odd):
    """No rows give no rows; of the odd ones those of 50 varied words or more stay, one of them for the equal texts 5 and 6."""
    ended = {}
    for name, docs in (("none", none), ("odd", odd)):
        at = docs
        for _, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, str(DATA / "sf0.001"))
        ended[name] = at.groupBy("doc_id").agg(F.sum("length").alias("tokens"), F.max("doc_tokens").alias("of")).collect()
    assert ended["none"] == [] and frame(spark, []).count() == 0
    assert sorted((r.doc_id for r in ended["odd"]), key=str) == [5, 7, 8, None]
    assert all(r.tokens == r.of > 50 for r in ended["odd"])
