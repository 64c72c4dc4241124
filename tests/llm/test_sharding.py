from __future__ import annotations

import zlib
from collections import defaultdict

from comparing import DATA
from conftest_llm import ODD, frame, prose

from tallyspark.llm import queries, sharding
from tallyspark.llm.common import table


def check(rows, texts: dict, shards: int) -> list[int]:
    """Sizes and slots hold; the bytes of each shard."""
    slots, sizes = defaultdict(list), [0] * shards
    for r in rows:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        if r.doc_id in texts:
            data = (texts[r.doc_id] or "").encode()
            assert r.size == len(data) + 1 and r.text_crc32 == zlib.crc32(data)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_query(spark):
    texts = {r.doc_id: r.text for r in table(spark, str(DATA / "sf0.01"), "documents").collect()}
    rows = queries.op7_kd_tree(spark, str(DATA / "sf0.01")).collect()
    sizes = check(rows, texts, 16)
    assert len(rows) == len(texts) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    assert max(sizes) < 1.05 * sum(sizes) / 16 and min(sizes) > 0.95 * sum(sizes) / 16


def test_a_group_of_copies_over_half_the_bytes_is_split_by_id(spark):
    docs = [(i, prose(1, 100) if i % 2 else prose(i, 100), "hot") for i in range(600)]
    sizes = check(sharding.with_slots(sharding.kd_shards(frame(spark, docs), 8)).collect(), {i: t for i, t, _ in docs}, 8)
    assert max(sizes) < 1.05 * sum(sizes) / 8


def test_odd_rows_and_uneven_counts(spark, odd, none):
    rows = sharding.with_slots(sharding.kd_shards(odd, 5)).collect()
    assert len(rows) == len(ODD)
    check(rows, {i: t for i, t, _ in ODD if i is not None}, 5)
    assert sharding.with_slots(sharding.kd_shards(none)).count() == 0
    docs = [(i, prose(i, 30), f"s{i % 3}") for i in range(300)]
    sizes = check(sharding.with_slots(sharding.kd_shards(frame(spark, docs), 6)).collect(), {}, 6)
    assert max(sizes) < 1.08 * sum(sizes) / 6


def test_no_python_in_the_plan(spark):
    plan = queries.op7_kd_tree(spark, str(DATA / "sf0.001"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def brute_shards(rows: list, shards: int, tolerance: float) -> dict:
    """doc_id to shard by splitting lists at weighted medians. rows: (doc_id, size, text hash, values of the dimensions)."""
    leaf_bytes, found = sum(r[1] for r in rows) / shards, {}

    def split(part: list, node: int, leaves: int) -> None:
        if leaves == 1 or not part:
            found.update({r[0]: node for r in part})
            return
        spread = [max(r[3 + d] for r in part) - min(r[3 + d] for r in part) for d in range(3)]
        d = 3 + spread.index(max(spread))
        left = (leaves + 1) // 2
        want, at, cut = sum(r[1] for r in part) * left / leaves, 0, 0
        part.sort(key=lambda r: (r[d], r[2], r[0]))
        while at + part[cut][1] / 2 < want:
            at, cut = at + part[cut][1], cut + 1
            if cut == len(part):
                break
        near = max(0, cut - 1) if cut == len(part) or (cut and at >= want) else cut  # the row in which the cut falls
        group = [i for i, r in enumerate(part) if (r[d], r[2]) == (part[near][d], part[near][2])]
        begin, end = sum(r[1] for r in part[: group[0]]), sum(r[1] for r in part[: group[-1] + 1])
        if min(want - begin, end - want) <= tolerance * leaf_bytes:
            cut = group[0] if want - begin < end - want else group[-1] + 1
        split(part[:cut], node, left)
        split(part[cut:], node + left, leaves - left)

    split(rows, 0, shards)
    return found


def test_cuts_equal_brute_force(spark):
    from pyspark.sql import functions as F

    docs = table(spark, str(DATA / "sf0.01"), "documents")
    sizes = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    rows = docs.select("doc_id", sizes.cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))), sharding.unit_hash(F.col("source")), sharding.unit_hash(F.col("lang")), F.log1p(sizes.cast("long")) / F.lit(24.0)).collect()
    expected = brute_shards([tuple(r) for r in rows], 16, 0.0025)
    found = {r.doc_id: r.shard for r in sharding.kd_shards(docs, 16).collect()}
    assert found == expected
