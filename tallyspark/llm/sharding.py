"""K-d tree sharding by distributed weighted medians (operator 7, DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.llm.common import discard, rank_in_groups, stage

#: Order key of a null doc_id.
NO_ID = -(2**63)


def unit_hash(value: Column) -> Column:
    """A point in [0, 1) for a categorical value; null is a value of its own."""
    return F.pmod(F.xxhash64(F.coalesce(value, F.lit("\u0000"))), F.lit(1 << 31)) / F.lit(float(1 << 31))


def by_node(of: dict[int, object], make) -> Column:
    """A column that picks make(entry) for the row's node; null for other nodes."""
    found = None
    for node, entry in of.items():
        found = (F.when if found is None else found.when)(F.col("node") == node, make(entry))
    return found if found is not None else F.lit(None)


def split_level(t: DataFrame, leaves: dict[int, int], dims: list[str], tolerance: float, leaf_bytes: float) -> tuple[DataFrame, dict[int, int], DataFrame]:
    """Split every node that stands for two leaves or more at its weighted median; one level of the tree, and what it staged."""
    stats = t.groupBy("node").agg(F.sum("size").alias("total"), *(F.max(d).alias(f"hi_{d}") for d in dims), *(F.min(d).alias(f"lo_{d}") for d in dims)).collect()  # a row per node
    open_nodes = {r["node"]: r for r in stats if leaves[r["node"]] > 1}
    widest = {n: max(dims, key=lambda d: r[f"hi_{d}"] - r[f"lo_{d}"]) for n, r in open_nodes.items()}
    left_leaves = {n: (leaves[n] + 1) // 2 for n in open_nodes}
    target = {n: r["total"] * left_leaves[n] / leaves[n] for n, r in open_nodes.items()}
    key = F.coalesce(by_node(widest, F.col), F.lit(0.0))
    ranged = stage(t.withColumn("key", key).repartitionByRange("node", "key", "th", "id_key").withColumn("part", F.spark_partition_id()), "kd")
    sums = ranged.groupBy("node", "part").agg(F.sum("size").alias("part_size"))
    before = sums.select("node", "part", F.coalesce(F.sum("part_size").over(Window.partitionBy("node").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    run = Window.partitionBy("node", "part").orderBy("key", "th", "id_key").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("run", F.sum("size").over(run)).join(before, ["node", "part"]).withColumn("end", F.col("run") + F.col("before"))
    want = by_node(target, F.lit).cast("double")
    ties = placed.groupBy("node", "key", "th").agg(F.min(F.col("end") - F.col("size")).alias("begin"), F.max("end").alias("end"), F.min(F.when(F.col("end") - F.col("size") / 2 >= want, F.col("id_key"))).alias("first_right"))
    crossing = {r["node"]: r for r in ties.filter((F.col("begin") < want) & (want <= F.col("end"))).collect()}  # one row per node

    def goes_right(node: int) -> Column:
        c = crossing[node]
        to_begin, to_end = target[node] - c["begin"], c["end"] - target[node]
        if min(to_begin, to_end) <= tolerance * leaf_bytes:  # keep the texts of this group together
            first = NO_ID if to_begin < to_end else None
        else:
            first = c["first_right"]
        here = F.lit(False) if first is None else F.col("id_key") >= first
        same_key, same_text = F.col("key") == c["key"], F.col("th") == c["th"]
        return (F.col("key") > c["key"]) | (same_key & (F.col("th") > c["th"])) | (same_key & same_text & here)

    new_leaves = {n: k if n in open_nodes else 1 for n, k in leaves.items()}  # a node without rows needs no split
    for n in open_nodes:
        new_leaves[n], new_leaves[n + left_leaves[n]] = left_leaves[n], leaves[n] - left_leaves[n]
    right = F.coalesce(by_node({n: n for n in crossing}, goes_right), F.lit(False))
    shift = F.coalesce(by_node(left_leaves, F.lit), F.lit(0))
    return ranged.withColumn("node", F.when(right, F.col("node") + shift).otherwise(F.col("node")).cast("int")).drop("key", "part"), new_leaves, ranged


def kd_shards(docs: DataFrame, shards: int = 16, tolerance: float = 0.0025) -> DataFrame:
    """Deal documents into shards of near equal bytes: doc_id, size, text_crc32, shard.

    Dimensions are source, lang (each hashed to [0, 1)) and the logarithm of the size, scaled to [0, 1].
    A node is split along the dimension of widest range at the weighted median of (value, text hash,
    doc_id); a group of equal texts at the cut stays whole where that moves the cut by no more than
    tolerance of a shard. Rows equal in text and doc_id stay together. A null text has size 1; a null
    source or lang is a value of its own; a null doc_id sorts first. An empty table gives no rows, and
    with fewer rows than shards some shards stay empty. To the driver goes one row per tree node.
    """
    text = F.col("text")
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"),
        unit_hash(F.col("source")).alias("d_source"),
        unit_hash(F.col("lang")).alias("d_lang"),
    )
    t = staged = stage(base.withColumns({"id_key": F.coalesce("doc_id", F.lit(NO_ID)), "d_size": F.log1p("size") / F.lit(24.0), "node": F.lit(0)}), "kd")
    total = t.agg(F.sum("size")).first()[0] or 0
    leaves = {0: shards}
    while max(leaves.values()) > 1 and total:
        before = staged
        t, leaves, staged = split_level(t, leaves, ["d_source", "d_lang", "d_size"], tolerance, total / shards)
        discard(before)
    return t.select("doc_id", "size", "text_crc32", "th", F.col("node").alias("shard"))


def with_slots(sharded: DataFrame) -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    Null and repeated doc_ids, equal texts and rows equal in every column each get a slot; no rows, no slots.
    """
    return rank_in_groups(stage(sharded, "kd"), ["shard"], ["doc_id", "th", "size"], name="slot").drop("th")
