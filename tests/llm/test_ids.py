"""Ids above 2^53 beside a null id in one partition: every operator keeps them to the last digit."""

from __future__ import annotations

import public_tokenizers
import pytest
from conftest_llm import frame, prose

import corpus_pipeline
from tallyspark.llm import bytebpe, dedup, licenses, packing, privacy, quality, sharding, toxicity
from tallyspark.llm.common import stage

IDS = [2**53 + 1, 2**53 + 3, None, 2**53 + 5]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"{prose(n, 90)}\nmail me a.b{n}@example.com now\n{prose(70 + n, 90)}", "a") for n, i in enumerate(IDS)]
    return stage(frame(spark, rows).coalesce(1), "ids")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(2**53 + 1, 1, 1), (2**53 + 3, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "licences": lambda d, _: licenses.licences(d),
    "personal_data": lambda d, _: privacy.personal_data(d),
    "redacted": lambda d, _: privacy.redacted(d),
    "line_rules": lambda d, _: quality.line_rules(d),
    "cleaned": lambda d, _: quality.cleaned(d),
    "pack": lambda d, _: packing.pack(d, public_tokenizers.path("word_bpe_49k.json")),
    "toxicity": lambda d, labels: toxicity.toxicity(d, labels),
    "shards": lambda d, _: sharding.with_slots(sharding.kd_shards(d)),
    "bytes": lambda d, _: bytebpe.encode(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
    "near_duplicates": lambda d, _: dedup.near_duplicates(d),
    "one_of_each": lambda d, _: dedup.one_of_each(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_are_exact(docs, labels, name):
    found = [r.doc_id for r in OPERATORS[name](docs, labels).select("doc_id").distinct().collect()]
    assert sorted(found, key=str) == sorted(IDS, key=str)


def test_components_are_not_merged(docs):
    found = {r.doc_id: r for r in dedup.near_duplicates(docs).collect()}
    assert all(r.component_id == i and r.kept for i, r in found.items())


def test_every_row_is_redacted(docs):
    for r in privacy.redacted(docs).collect():
        assert "@" not in r.text and "mail me [EMAIL] now" in r.text


def test_pipeline_stages(spark, docs, labels, tmp_path):
    labels.filter("doc_id IS NULL").write.parquet(f"{tmp_path}/labels.parquet")
    rows = docs
    for _, function in corpus_pipeline.STAGES[:-1]:
        rows = stage(function(spark, rows, str(tmp_path)), "ids")
        assert sorted((r.doc_id for r in rows.collect()), key=str) == sorted(IDS, key=str)
    assert not rows.filter("text LIKE '%@%'").count()
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path))
    assert sorted((r.doc_id for r in packed.collect()), key=str) == sorted(IDS, key=str)
