from __future__ import annotations

import numpy as np
from comparing import DATA
from conftest_llm import ODD, frame, prose

from tallyspark.llm import toxicity
from tallyspark.llm.common import table

BAD = ["vileword", "nastyterm", "cruelthing", "grimxa", "grimxo", "grimxu", "grimxe"]


def corpus(n: int, start: int = 0) -> tuple[list[tuple], list[tuple]]:
    docs, labels = [], []
    for i in range(start, start + n):
        words = prose(i, 80).split(" ")
        draw = np.random.RandomState(i)
        toxic = int(i % 4 == 0)
        for at in draw.choice(len(words), 3 * toxic, replace=False):
            words[at] += " " + BAD[draw.randint(len(BAD))]
        docs.append((i, " ".join(words), "a"))
        labels.append((i, 1, toxic))
    return docs, labels


def test_held_out_documents(spark):
    (train, labels), (test, truth) = corpus(600), corpus(200, 5000)
    more = [(9000, prose(1, 50) + " grimxyz grimxq word", "a")]  # unseen words of a known stem
    found = {r.doc_id: r for r in toxicity.toxicity(frame(spark, train + test + more), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    right = [found[i].toxic == bool(t) for i, _, t in truth]
    assert np.mean(right) > 0.97 and found[9000].toxic
    assert all(0 <= found[i][f"p_{c}"] <= 1 for i, _, _ in truth for c in toxicity.CATEGORIES)


def test_held_out_half_of_the_tables(spark):
    docs, labels = (table(spark, str(DATA / "sf0.1"), t) for t in ("documents", "labels"))
    found = {r.doc_id: r.toxic for r in toxicity.toxicity(docs, labels.filter("doc_id % 2 = 0")).collect()}
    truth = [(found[r.doc_id], r.toxic) for r in labels.filter("doc_id % 2 = 1").collect()]
    caught = np.mean([f for f, t in truth if t])
    spared = np.mean([not f for f, t in truth if not t])
    assert caught > 0.9 and spared > 0.98


def test_odd_rows_and_labels(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (4, None, None), (None, 1, 1), (99, 1, 1), (5, 1, 1), (5, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(odd, labels).count() == len(ODD)
    empty = labels.limit(0)
    assert not any(r.toxic for r in toxicity.toxicity(odd, empty).collect())
    assert toxicity.toxicity(none, labels).count() == 0
    kept = toxicity.without_toxic(odd, empty)
    assert kept.columns == odd.columns and kept.count() == len(ODD)


def test_near_copies_count_once():
    rows = [toxicity.probes_of(toxicity.features_of(prose(i // 5, 100) + f" own{i}")) for i in range(20)]
    assert toxicity.families(np.array(rows)).tolist() == [i % 5 == 0 for i in range(20)]


def test_features_are_bounded(spark):
    """Each model takes the features of greatest odds, ties to the smaller hash; texts of many telling words still fit."""
    held = [np.flatnonzero(np.random.RandomState(i).rand(300) < 0.3) for i in range(80)]
    docs = [(i, prose(i, 40) + "".join(f" {'bad' if i % 2 else 'good'}{chr(97 + j // 26)}{chr(97 + j % 26)}x" for j in at), "a") for i, at in enumerate(held)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(80)], "doc_id long, quality int, toxic int")
    sample = toxicity.training_rows(frame(spark, docs), labels, 2000, toxicity.CATEGORIES)
    counted = toxicity.feature_counts(sample, 3).cache()
    known = sample.select("fold", "y").toPandas()
    y, folds = np.stack(known["y"].to_numpy()), known["fold"].to_numpy()
    chosen = toxicity.most_telling(counted, y, folds, 2.5, 25).toPandas()
    assert (chosen.groupby("variant").size() == 25).all() and len(chosen) == 25 * (toxicity.FOLDS + 1)
    for v, fold in enumerate([None, *range(toxicity.FOLDS)]):
        every = counted.select("feature", toxicity.odds_without(fold, y, folds, 2.5).alias("o")).filter("o IS NOT NULL").toPandas()
        want = sorted(zip(-every["o"], every["feature"], strict=True))[:25]
        assert set(chosen.loc[chosen["variant"] == v, "feature"]) == {f for _, f in want}
    assert len(toxicity.fit(sample, 3, max_features=25).columns) == 25
    assert len(toxicity.fit(sample, 3).columns) > 25


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1) -> np.ndarray:
    """Ridge logistic regression by gradient and Hessian in full; the bias comes last and bears no penalty."""
    w, ridge = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, penalty), 1e-6]
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
    return w


def test_registered_query_equals_brute_force(spark):
    """Sample, features, folds and chain anew, on words and dictionaries instead of hashes and tables."""
    import math
    import re
    from collections import Counter

    from pyspark.sql import functions as F

    from tallyspark.llm import queries

    sf = str(DATA / "sf0.01")
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    said = {r.doc_id: (int(r.quality == 0), int(r.toxic == 1 and r.quality == 0), int(r.toxic == 1)) for r in table(spark, sf, "labels").collect()}
    folds = {r.doc_id: r.f for r in table(spark, sf, "labels").select("doc_id", F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("fold")), F.lit(5)).alias("f")).collect()}

    def features(text: str) -> set:
        words = set(re.findall(r"[^\W\d_]+", text.lower()))
        return words | {(n, w[:n]) for w in words for n in (4, 5, 6) if len(w) > n}

    ids = sorted(i for i in said if i in texts)  # fewer than the bound of the sample
    probes = np.array([toxicity.probes_of(toxicity.features_of(texts[i])) for i in ids])
    ids = [i for i, first in zip(ids, toxicity.families(probes), strict=True) if first]
    held = {i: features(texts[i]) for i in ids}

    def telling(rows: list) -> list:
        found = set()
        for c in range(3):
            n_with = sum(said[i][c] for i in rows)
            n_without = len(rows) - n_with
            n = Counter(f for i in rows for f in held[i])
            hit = Counter(f for i in rows if said[i][c] for f in held[i])
            found |= {f for f, h in hit.items() if h >= min(max(n_with // 100, 3), 8) and math.log((h + 0.5) / (n_with + 1)) - math.log((n[f] - h + 0.5) / (n_without + 1)) >= 2.5}
        return sorted(found, key=str)

    def matrix(rows: list, names: list) -> np.ndarray:
        return np.array([[f in features_of[i] for f in names] for i in rows], float).reshape(len(rows), len(names))

    features_of = {i: features(t) for i, t in texts.items()}
    logit = lambda p: np.log(np.clip(p, 1e-3, 1 - 1e-3) / (1 - np.clip(p, 1e-3, 1 - 1e-3)))
    every, names = sorted(texts), telling(ids)
    out_of_fold, scores = np.empty((len(ids), 0)), np.empty((len(every), 0))
    for c in range(3):
        y = np.array([said[i][c] for i in ids], float)
        w = logistic(np.c_[matrix(ids, names), logit(out_of_fold), np.ones(len(ids))], y)
        scores = np.c_[scores, 1 / (1 + np.exp(-np.c_[matrix(every, names), logit(scores), np.ones(len(every))] @ w))]
        fold_p = np.empty(len(ids))
        for f in range(5):
            out = np.array([folds[i] == f for i in ids])
            own = telling([i for i, o in zip(ids, out, strict=True) if not o])
            z = np.c_[matrix(ids, own), logit(out_of_fold), np.ones(len(ids))]
            fold_p[out] = 1 / (1 + np.exp(-z[out] @ logistic(z[~out], y[~out])))
        out_of_fold = np.c_[out_of_fold, fold_p]
    found = {r.doc_id: r for r in queries.op6_classifier_chain(spark, sf).collect()}
    assert len(found) == len(texts)
    for i, p in zip(every, scores, strict=True):
        assert np.allclose([found[i][f"p_{c}"] for c in toxicity.CATEGORIES], p, atol=1e-4)
    assert {found[i].toxic for i in every} == {True, False}
