"""Toxicity by a classifier chain over categories with out-of-fold probabilities (operator 6)."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.llm.common import stage

WORD = re.compile(r"[^\W\d_]+")
STEM_LENGTHS = (4, 5, 6)
#: The chain's order: category and what labels say of it. The last decides. What the tables label besides toxicity is
#: quality, so the earlier links are those of poor text and of text that is both.
CATEGORIES = {"low_quality": "quality = 0", "toxic_low_quality": "toxic = 1 AND quality = 0", "toxic": "toxic = 1"}
FOLDS = 5
PROBES = 8


def features_of(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct words and of their first 4 to 6 letters. A hash's last bit is 1 for a stem."""
    words = set(WORD.findall((text or "").lower()))
    stems = {(n, w[:n]) for w in words for n in STEM_LENGTHS if len(w) > n}
    h = [xxhash.xxh3_64_intdigest(w) & ~1 for w in words] + [xxhash.xxh3_64_intdigest(f"{n}:{s}") | 1 for n, s in stems]
    return np.unique(np.array(h, np.uint64))


@dataclass(frozen=True)
class Chain:
    """Features (hash to column) and, for each category, weights of the columns, of earlier probabilities, and a bias."""

    columns: dict[int, int]
    weights: list[np.ndarray]
    limit: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        made = np.empty((len(x), 0))
        for w in self.weights:
            made = np.column_stack([made, expit(np.column_stack([x, logit(made), np.ones(len(x))]) @ w)])
        return made

    def of_texts(self, texts: Sequence) -> np.ndarray:
        """A row of probabilities for each text."""
        x = np.zeros((len(texts), len(self.columns)))
        known: dict[str, tuple[int, ...]] = {}
        for i, text in enumerate(texts):
            if len(known) > 100_000:
                known.clear()
            for w in set(WORD.findall((text or "").lower())):
                at = known.get(w)
                if at is None:
                    at = known[w] = tuple(self.columns[h] for h in features_of(w).tolist() if h in self.columns)
                if at:
                    x[i, at] = 1
        return self.probabilities(x)


def expit(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def linear(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, steps: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last column is the bias and bears no penalty."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = expit(x @ w)
        h = (x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def probes_of(features: np.ndarray) -> np.ndarray:
    """Minwise features of a text; 0 without any."""
    draw = np.random.RandomState(11).randint(1, 2**62, PROBES).astype(np.uint64) | np.uint64(1)
    return np.array([(features * d).min() for d in draw], np.uint64) if len(features) else np.zeros(PROBES, np.uint64)


def families(probes: np.ndarray) -> np.ndarray:
    """For each row, whether it is the first of its near copies: fewer than 5 of 8 minwise features are an earlier first row's."""
    seen: dict[tuple[int, int], list[int]] = {}
    first = np.ones(len(probes), bool)
    for i, p in enumerate(probes):
        met = {j for t in range(PROBES) for j in seen.get((t, int(p[t])), ())}
        if any((probes[j] == p).sum() >= 5 for j in met):
            first[i] = False
        else:
            for t in range(PROBES):
                seen.setdefault((t, int(p[t])), []).append(i)
    return first


def link(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of one link of the chain from the rows it is labelled for (y is 0 or 1, -1 without a label)."""
    known = y >= 0
    share = float(y[known].mean()) if known.any() else 0.0
    if share in (0.0, 1.0):  # nothing to tell apart
        return np.concatenate([np.zeros(x.shape[1] - 1), [logit(np.array(share))]])
    return linear(x[known], y[known].astype(float))


def training_rows(docs: DataFrame, labels: DataFrame, rows_each: int, categories: dict[str, str]) -> DataFrame:
    """doc_id, fold, y (1, 0, or -1 without a label, for each category) and text of the sample.

    These are at most rows_each documents that have the last category and as many that have it not, those of smallest
    hashed doc_id. Of several labels of a document the greatest counts, of several texts that of smallest hash.
    """
    present = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"))
    said = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max(F.expr(says).cast("int")).alias(f"y{i}") for i, says in enumerate(categories.values())))
    last = f"y{len(categories) - 1}"
    one = said.filter(F.col(last).isNotNull()).join(present, "doc_id", "left_semi")
    order = [F.xxhash64("doc_id", F.lit("toxicity")), "doc_id"]
    chosen = [r for v in (1, 0) for r in one.filter(F.col(last) == v).orderBy(*order).limit(rows_each).collect()]
    rows = [(r["doc_id"], [-1 if r[f"y{i}"] is None else r[f"y{i}"] for i in range(len(categories))]) for r in chosen]
    ids = docs.sparkSession.createDataFrame(rows, "doc_id long, y array<int>")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = own.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))  # at most 2 * rows_each ids
    return stage(texts.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"), "y", F.col("t.text").alias("text")), "toxicity")


def feature_counts(rows: DataFrame, n_categories: int) -> DataFrame:
    """For each feature and fold f: n{c}_{f} rows that are labelled for category c and hold it, hit{c}_{f} of them with the category."""

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                some = batch.iloc[at : at + 500]
                for fold, part in some.groupby("fold"):
                    found = [features_of(t) for t in part["text"]]
                    names, inverse = np.unique(np.concatenate(found), return_inverse=True)
                    y = np.repeat(np.stack(part["y"].to_numpy()), [len(f) for f in found], axis=0)
                    sums = {f"{name}{c}": np.bincount(inverse, weight, len(names)).astype(np.int64) for c in range(n_categories) for name, weight in (("n", y[:, c] >= 0), ("hit", y[:, c] == 1))}
                    yield pd.DataFrame({"feature": names.view(np.int64), "fold": fold, **sums})

    names = [f"{name}{c}" for c in range(n_categories) for name in ("n", "hit")]
    counted = rows.mapInPandas(counts, "feature long, fold int, " + ", ".join(f"{n} long" for n in names))
    return counted.groupBy("feature").agg(*(F.sum(F.when(F.col("fold") == f, F.col(n)).otherwise(0)).alias(f"{n}_{f}") for n in names for f in range(FOLDS)))


def odds_without(fold: int | None, y: np.ndarray, folds: np.ndarray, min_odds: float) -> Column:
    """The greatest log odds ratio with which a feature tells of some category by the rows outside a fold (None: by all rows); null if it tells of none."""
    outside = [f for f in range(FOLDS) if f != fold]
    rows = y[np.isin(folds, outside)]
    told = [F.lit(None).cast("double")] * 2  # greatest() takes two or more
    for c in range(y.shape[1]):
        n_with, n_without = int((rows[:, c] == 1).sum()), int((rows[:, c] == 0).sum())
        if n_with and n_without:
            n, hit = (sum((F.col(f"{name}{c}_{f}") for f in outside), F.lit(0)) for name in ("n", "hit"))
            odds = F.log((hit + 0.5) / (n_with + 1)) - F.log((n - hit + 0.5) / (n_without + 1))
            told.append(F.when((hit >= int(np.clip(n_with // 100, 3, 8))) & (odds >= min_odds), odds))
    return F.greatest(*told)


def most_telling(counted: DataFrame, y: np.ndarray, folds: np.ndarray, min_odds: float, max_features: int) -> DataFrame:
    """variant (0: all rows, f + 1: without fold f) and feature: the max_features of greatest odds of each variant, ties to the smaller feature."""
    odds = F.array(*(odds_without(v, y, folds, min_odds) for v in (None, *range(FOLDS))))
    told = counted.select("feature", F.posexplode(odds).alias("variant", "odds")).filter("odds IS NOT NULL")
    order = Window.partitionBy("variant").orderBy(F.desc("odds"), "feature")
    return told.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max_features).select("variant", "feature")


def fit(sample: DataFrame, n_categories: int, min_odds: float = 2.5, max_features: int = 2000) -> Chain:
    """Fit the chain on a bounded sample (doc_id, fold, y, text).

    A feature tells of a category if enough rows of the category hold it (a hundredth of them, from 3 to 8) and its log odds
    ratio is min_odds or more; of these, each model takes at most max_features, those of greatest odds, which bounds its
    matrices whatever the texts hold. Out-of-fold probabilities come from models whose features, too, are chosen without the fold.
    Texts and their features stay on the executors. To the driver go each row's minwise features, the
    telling features and each row's places among them.
    """

    def minwise_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "probes": [probes_of(features_of(t)).view(np.int64) for t in batch["text"]]})

    constant = Chain({}, [np.concatenate([np.zeros(i), [logit(np.array(0.0))]]) for i in range(n_categories)], 0.5)
    probed = sample.mapInPandas(minwise_rows, "doc_id long, probes array<long>").toPandas().sort_values("doc_id", kind="stable")
    if not len(probed):
        return constant
    first = families(np.array(probed["probes"].tolist(), np.int64).reshape(-1, PROBES).view(np.uint64))
    spark = sample.sparkSession
    distinct = sample.join(F.broadcast(spark.createDataFrame([(int(i),) for i in probed["doc_id"][first]], "doc_id long")), "doc_id")  # ids of the sample
    known = distinct.select("doc_id", "fold", "y").toPandas().sort_values("doc_id", kind="stable")
    y, folds = np.stack(known["y"].to_numpy()), known["fold"].to_numpy()
    telling = most_telling(feature_counts(distinct, n_categories), y, folds, min_odds, max_features).toPandas()
    names = np.unique(telling["feature"].to_numpy(np.int64))
    features = {int(f): i for i, f in enumerate(names.view(np.uint64))}
    chosen = np.zeros((len(names), FOLDS + 1), bool)
    chosen[np.searchsorted(names, telling["feature"]), telling["variant"]] = True

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "places": [[features[h] for h in features_of(t).tolist() if h in features] for t in batch["text"]]})

    placed = distinct.mapInPandas(places, "doc_id long, places array<int>").toPandas().sort_values("doc_id", kind="stable")
    x = np.zeros((len(placed), len(features)), np.uint8)
    for i, at in enumerate(placed["places"]):
        x[i, np.asarray(at, int)] = 1
    out_of_fold = np.empty((len(x), 0))
    weights = []
    for c in range(n_categories):
        earlier = np.column_stack([logit(out_of_fold), np.ones(len(x))])
        weights.append(link(np.column_stack([x[:, chosen[:, 0]], earlier]), y[:, c]))
        held = np.empty(len(x))
        for f in range(FOLDS):
            z, out = np.column_stack([x[:, chosen[:, f + 1]], earlier]), folds == f
            held[out] = expit(z[out] @ link(z[~out], y[~out, c]))
        out_of_fold = np.column_stack([out_of_fold, held])
    p, has = out_of_fold[:, -1], y[:, -1] == 1
    if has.all() or not has.any():
        limit = 0.5
    else:
        grid = np.arange(0.2, 0.91, 0.05)
        scores = [2 * ((p >= g) & has).sum() / max(1, (p >= g).sum() + has.sum()) for g in grid]
        best = np.flatnonzero(np.array(scores) >= max(scores) - 1e-9)
        limit = float(grid[best[len(best) // 2]])
    order = [h for h, i in features.items() if chosen[i, 0]]
    return Chain({h: i for i, h in enumerate(order)}, weights, limit)


def toxicity(docs: DataFrame, labels: DataFrame, rows_each: int = 2000, categories: dict[str, str] | None = None) -> DataFrame:
    """doc_id, th (hash of the text), a probability p_<name> for each category, toxic for every row of docs.

    docs: doc_id, text; labels: doc_id and the columns that categories read; other columns are ignored. The chain is fitted on
    at most 2 * rows_each labelled documents, see training_rows; near copies count once there. Whole texts, however long, are
    scored by the presence of telling words and stems. Null or empty texts have no features; a category that all or
    none of the sample has gets the share of its labels, so without labels nothing is toxic. A null doc_id is
    carried through; rows with one doc_id are each scored; an empty table gives no rows.
    """
    categories = CATEGORIES if categories is None else categories
    chain = fit(training_rows(docs, labels, rows_each, categories), len(categories))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = chain.of_texts(batch.column("text").to_pylist())
            made = [*(pa.array(p[:, c]) for c in range(p.shape[1])), pa.array(p[:, -1] >= chain.limit)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), *made], names=["doc_id", "th", *(f"p_{c}" for c in categories), "toxic"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    return rows.mapInArrow(score, "doc_id long, th long, " + ", ".join(f"p_{c} double" for c in categories) + ", toxic boolean")


def without_toxic(docs: DataFrame, labels: DataFrame, rows_each: int = 2000, categories: dict[str, str] | None = None) -> DataFrame:
    """The rows of docs that are not judged toxic, in the columns of docs; judged where they are read.

    The verdict is that of toxicity(): null and empty texts, null doc_ids and several rows of one doc_id are
    each judged by their own text; columns of any name are carried; an empty table gives no rows.
    """
    categories = CATEGORIES if categories is None else categories
    chain = fit(training_rows(docs, labels, rows_each, categories), len(categories))
    at = docs.columns.index("text")

    def spared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(chain.of_texts(batch.column(at).to_pylist())[:, -1] < chain.limit))

    return docs.mapInArrow(spared, docs.schema)  # not a filter by a function: the optimiser may move that to where no Python can be called
