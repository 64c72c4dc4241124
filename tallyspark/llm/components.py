"""Connected components over a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import discard, stage


#: A key with more rows than these is dealt over SALTS tasks; at most 2 * HOT_KEYS keys can be as large.
HOT_ROWS, HOT_KEYS, SALTS = 10_000, 1000, 64


def _with_least(rows: DataFrame, key: str, other: str, n: int) -> DataFrame:
    """Add m, the least of other in each key, to rows, splitting the keys that hold many of the n rows."""
    counted = rows.groupBy(key).agg(F.min(other).alias("m"), F.count(F.lit(1)).alias("size"))
    limit = max(HOT_ROWS, n // HOT_KEYS)
    hot = F.broadcast(counted.filter(F.col("size") > limit).select(key, F.lit(True).alias("hot")))  # at most n / limit rows
    dealt = rows.join(hot, key, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(other), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")).drop("hot")
    copied = counted.withColumn("salt", F.explode(F.when(F.col("size") > limit, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("size")
    return dealt.join(copied, [key, "salt"]).drop("salt")


def _toward_least(edges: DataFrame, n: int) -> DataFrame:
    """Large star: link every larger neighbour of u to the least of u and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    linked = _with_least(both, "u", "v", 2 * n).filter("v > u")
    return linked.select(F.col("v").alias("a"), F.least("u", "m").alias("b")).filter("a <> b").groupBy("a", "b").agg(F.lit(1).alias("one")).drop("one")


def _to_star(edges: DataFrame, n: int) -> DataFrame:
    """Small star: link u and its smaller neighbours to the least of them. edges hold a > b."""
    kept = _with_least(edges, "a", "b", n)
    moved = kept.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    return moved.groupBy("a", "b").agg(F.lit(1).alias("one")).drop("one")


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every a has one b, and no b is an a: then each star is a component, and its centre the least id."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("child").alias("children"), F.max("parent").alias("parent")).filter("children > 1 OR (children = 1 AND parent = 1)").isEmpty()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, label) for every id with a link; label is the least id reachable. links: a, b with a <> b."""
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    before = None
    for _ in range(rounds):
        n = edges.count()
        large = stage(_toward_least(edges, n), "components")
        edges = stage(_to_star(large, large.count()), "components")
        discard(large, *([] if before is None else [before]))
        before = edges
        if _is_star_forest(edges):
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("label"))
