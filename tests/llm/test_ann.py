from __future__ import annotations

import numpy as np
import pytest
from comparing import DATA, rows, tables
from pyspark.sql import functions as F

from tallyspark.llm import ann, oracles, queries
from tallyspark.llm.common import table


def plain(ids: np.ndarray, x: np.ndarray, k: int) -> dict[int, list[int]]:
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        out[int(ids[i])] = [int(ids[j]) for j in np.lexsort((ids, -score)) if j != i][:k]
    return out


def recall(found, expected: dict[int, list[int]]) -> float:
    got: dict[int, set[int]] = {}
    for r in found:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    return sum(len(set(v) & got.get(q, set())) for q, v in expected.items()) / sum(map(len, expected.values()))


def test_query_recall_scores_and_order(spark):
    given = table(spark, str(DATA / "sf0.1"), "embeddings").collect()
    ids, x = np.array([r.vec_id for r in given]), np.array([r.embedding for r in given], float)
    found = queries.op4_anisotropic(spark, str(DATA / "sf0.1")).collect()
    assert recall(found, plain(ids, x, 20)) >= 0.9 and len(found) == 20 * (ids % 20 == 0).sum()
    at = {int(i): v for i, v in zip(ids, x)}
    by: dict[int, list] = {}
    for r in found:
        assert r.score == pytest.approx(at[r.query_id] @ at[r.vec_id], abs=1e-12)
        by.setdefault(r.query_id, []).append(r)
    for group in by.values():
        group.sort(key=lambda r: r.rank)
        assert [r.rank for r in group] == list(range(1, 21))
        assert all((-a.score, a.vec_id) < (-b.score, b.vec_id) for a, b in zip(group, group[1:]))


def test_query_equals_sql(spark):
    found = queries.op4_anisotropic(spark, str(DATA / "sf0.01")).toPandas()
    assert rows(found) == rows(tables("sf0.01").execute(oracles.SQL["op4_anisotropic"]).df())


def test_blocks_give_the_same_as_one_block(spark):
    vectors = table(spark, str(DATA / "sf0.01"), "embeddings")
    one, many = (sorted((r.query_id, r.rank, r.vec_id) for r in ann.search(vectors, F.col("vec_id") % 20 == 0, **blocks).collect()) for blocks in ({}, {"query_block": 7, "row_block": 60}))
    assert one == many


def shifted(draw: np.random.RandomState) -> np.ndarray:
    return 5 + 0.1 * draw.randn(4000, 24)


def clustered(draw: np.random.RandomState) -> np.ndarray:
    return draw.randn(8, 24)[draw.randint(0, 8, 4000)] + 0.02 * draw.randn(4000, 24)


def of_uneven_length(draw: np.random.RandomState) -> np.ndarray:
    return draw.randn(4000, 24) * np.exp(2 * draw.randn(4000, 1))


def on_a_grid(draw: np.random.RandomState) -> np.ndarray:
    return np.concatenate([np.ones((4000, 1)), draw.permutation(4000)[:, None] * (np.arange(4000)[:, None] % 20 != 0)], axis=1)


@pytest.mark.parametrize("made", [shifted, clustered, of_uneven_length, on_a_grid])
@pytest.mark.parametrize("blocks", [{}, {"row_block": 700, "query_block": 90}])
def test_other_rows_lose_no_neighbour(spark, made, blocks):
    ids, x = np.arange(4000), made(np.random.RandomState(5))
    given = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    found = ann.search(given, F.col("vec_id") % 20 == 0, **blocks).collect()
    product = np.zeros((200, 4000))
    for d in range(x.shape[1]):
        product += x[::20, d, None] * x[None, :, d]
    expected = {(int(20 * a), r, int(b)) for a, score in enumerate(product) for r, b in enumerate([j for j in np.lexsort((ids, -score)) if j != 20 * a][:20], 1)}
    assert {(r.query_id, r.rank, r.vec_id) for r in found} == expected


def test_bounds_hold_for_every_pair():
    draw = np.random.RandomState(4)
    x, q = draw.randn(500, 7) * np.exp(3 * draw.randn(500, 1)), draw.randn(40, 7)
    books, eta = ann.train(x[:100], 2, 0.2)
    padded = np.pad(x, ((0, 0), (0, 1)))
    codes = ann.assign(padded, books, eta)
    unit = q / np.linalg.norm(q, axis=1, keepdims=True)
    luts, bytes_ = ann.tables(unit, books), ann.packed(codes)
    near = sum(luts[:, b][:, bytes_[:, b]] for b in range(bytes_.shape[1]))
    assert (np.abs(near - unit @ x.T) <= ann.slack(padded, codes, books)[None]).all()


def test_many_equal_vectors_go_by_id(spark):
    draw = np.random.RandomState(3)
    given = [(i, [1.0, 0.0, 0.0, 1.0, 0.5] if i % 3 == 0 else draw.randn(5).tolist()) for i in range(600)]
    found = ann.search(spark.createDataFrame(given, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5).collect()
    x = np.array([r[1] for r in given])
    expected = plain(np.arange(600), x, 5)
    assert recall(found, expected) >= 0.95
    top = [r.vec_id for r in sorted((r for r in found if r.query_id == 60), key=lambda r: r.rank)]
    assert top == expected[60]


def test_odd_vectors(spark):
    given = [(0, [1.0, 2.0]), (20, None), (40, []), (60, [0.0, 0.0]), (80, [float("nan"), 1.0]), (100, [float("inf"), 1.0]), (120, [None, 1.0]), (140, [3.0, 1.0]), (140, [3.0, 1.0]), (1, [1.0, 1.0]), (None, [1.0, 1.0]), (2, [1.0, 2.0, 3.0])]
    vectors = spark.createDataFrame(given, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("code", "qb", "rb", "near", "r", "class_id")})
    found = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(vectors, F.col("vec_id") % 20 == 0).collect())
    assert found == [(0, 1, 140, 5.0), (0, 2, 1, 3.0), (140, 1, 0, 5.0), (140, 2, 1, 4.0)]
    assert ann.search(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_tables_equal_products_with_the_codes():
    draw = np.random.RandomState(1)
    x, q = draw.randn(200, 7), draw.randn(3, 7)
    books, eta = ann.train(x, 2, 0.2)
    padded = np.pad(x, ((0, 0), (0, 1)))
    codes = ann.assign(padded, books, eta)
    rebuilt = np.concatenate([books[s][codes[:, s]] for s in range(4)], axis=1)[:, :7]
    luts, bytes_ = ann.tables(q, books), ann.packed(codes)
    assert np.allclose(sum(luts[:, b][:, bytes_[:, b]] for b in range(bytes_.shape[1])), q @ rebuilt.T, atol=1e-4)


def test_parallel_error_weighs_more():
    draw = np.random.RandomState(2)
    x = draw.randn(500, 8)
    books, _ = ann.train(x, 2, 0.2)

    def parallel(eta: float) -> float:
        codes = ann.assign(x, books, eta)
        r = x - np.concatenate([books[s][codes[:, s]] for s in range(4)], axis=1)
        return float(((r * x / np.linalg.norm(x, axis=1, keepdims=True)).sum(axis=1) ** 2).mean())

    assert parallel(6.0) < parallel(1.0)
