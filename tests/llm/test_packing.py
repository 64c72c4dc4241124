from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from comparing import DATA
from conftest_llm import ODD, frame, prose
from tokenizers import Tokenizer

from tallyspark.llm import packing, queries
from tallyspark.llm.common import table

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)  # as it loads: strings of special tokens are special tokens


def check(rows, texts: dict, tokenizer, capacity: int = 4096) -> float:
    """Every id lies in one piece, pieces fill sequences without gaps; the share of the padded room that is filled."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for group in by_sequence.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return sum(r.length for r in rows) / (capacity * len(by_sequence))


def test_query(spark, tokenizer):
    texts = {r.doc_id: r.text for r in table(spark, str(DATA / "sf0.001"), "documents").collect()}
    assert check(queries.op5_column_generation(spark, str(DATA / "sf0.001")).collect(), texts, tokenizer) > 0.95


def test_odd_rows(spark, odd, none, tokenizer):
    found = packing.pack(odd, PATH).collect()
    assert {r.doc_id for r in found} == {i for i, _, _ in ODD}
    own = {i: t for i, t, _ in ODD if i not in (None, 5)}
    for i, text in own.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert sum(r.length for r in found if r.doc_id == i) == len(ids) + 1
    assert sum(r.doc_id == 5 for r in found) == 2  # repeated rows are packed each
    assert packing.pack(none, PATH).count() == 0


def test_small_capacity_cuts_documents(spark, tokenizer):
    docs = [(i, prose(i, 10 + 7 * i), "a") for i in range(40)]
    texts = {i: t for i, t, _ in docs}
    assert check(packing.pack(frame(spark, docs), PATH, capacity=128, grain=4).collect(), texts, tokenizer, 128) > 0.93


def test_word_parts_give_the_texts_ids(tokenizer):
    encoder = packing.WordEncoder(PATH)
    assert encoder.fast is not None
    for text in ["İstanbul ΣΑΣ don't it's WE'LL x'S 12³ ½ ǅ ﬁ Å nbsp x \x1c y\x1fz \x85 q", "<|endoftext|> </w> a</w> ÿþ", "a <|endoftext|> b", "x<|startoftext|>y<|END|><|endoftext|>", "naïve co\u00adop ¿qué? ´` ¨ ª º ʰ", "日本語😀👍🏽", "\ufeffbom a\tb\rc\x0bd", "", " \n ", "a" * 3000, prose(3, 500)]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_cutting_stock_places_everything_and_is_tight():
    draw = np.random.RandomState(0)
    demand = np.zeros(64, np.int64)
    np.add.at(demand, draw.randint(5, 40, 4000), 1)
    plan = packing.cutting_stock(demand, 64)
    assert (sum(p * n for p, n in plan) == demand).all() and all((p * np.arange(1, 65)).sum() <= 64 for p, _ in plan)
    used, least = sum(n for _, n in plan), (demand * np.arange(1, 65)).sum() / 64
    assert used <= 1.02 * least + 5
    assert packing.cutting_stock(np.zeros(64, np.int64), 64) == []


def test_knapsack_against_enumeration():
    from itertools import product

    prices = np.array([0.11, 0.25, 0.31, 0.52])
    best = max(sum(n * p for n, p in zip(c, prices)) for c in product(range(10), repeat=4) if sum(n * w for n, w in zip(c, (1, 2, 3, 4))) <= 9)
    pattern, value = packing.best_pattern(np.concatenate([prices, np.zeros(5)]), 9)
    assert value == pytest.approx(best) and (pattern * np.arange(1, 10)).sum() <= 9
