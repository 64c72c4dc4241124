from __future__ import annotations

import hashlib

import public_tokenizers
from comparing import DATA
from conftest_llm import ODD, frame, prose

from tallyspark.llm import bytebpe, queries
from tallyspark.llm.common import table

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def expected(text: str | None) -> tuple[int, str, str]:
    ids = bytebpe.encoding(RANKS, PATTERN).encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def rows(df) -> list[tuple]:
    return sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect()), key=str)


def test_query_on_whole_table(spark):
    docs = table(spark, str(DATA / "sf0.001"), "documents").collect()
    assert rows(queries.op9_chunked_bpe(spark, str(DATA / "sf0.001"))) == sorted(((r.doc_id, *expected(r.text)) for r in docs), key=str)


def test_odd_rows_whole_and_in_chunks(odd, none):
    whole = sorted(((i, *expected(t)) for i, t, _ in ODD), key=str)
    assert rows(bytebpe.encode(odd, RANKS, PATTERN)) == whole
    assert rows(bytebpe.encode(odd, RANKS, PATTERN, chunk=200, overlap=40)) == whole
    assert bytebpe.encode(none, RANKS, PATTERN).count() == 0


def test_chunks_resynchronise_or_stay_together(spark):
    texts = [prose(1, 900), "x" * 700, " " * 900 + "a", "a  b   c\n\n\n" * 90, "don't it's we'll " * 70, "é😀 " * 200, ("z" * 130 + " ") * 9, "1234567 " * 100 + "!" * 300, "\n" * 333 + "end"]
    docs = [(i, t, "a") for i, t in enumerate(texts)]
    for chunk, overlap in ((100, 20), (128, 60), (50, 3)):
        assert rows(bytebpe.encode(frame(spark, docs), RANKS, PATTERN, chunk, overlap)) == sorted(((i, *expected(t)) for i, t, _ in docs), key=str)
