"""Keyed state, the trace log, and numbers with their places."""

from __future__ import annotations

import os
import random
import re

from pyspark.sql import functions as F

from tallyspark.functions import rules
from tallyspark.functions.text import matches, prefix_sums
from tallyspark.streaming import state

MEMORY = "company string, theme string, sections array<string>, last_updated string"


def memory(spark, tmp_path, **options) -> state.KeyedState:
    return state.KeyedState(spark, str(tmp_path / "memory"), ["company", "theme"], ["sections"], **options)


def held(kept: state.KeyedState, spark) -> list[tuple]:
    schema = spark.createDataFrame([], MEMORY).schema
    return sorted((tuple(r) for r in kept.read(schema).collect()), key=str)


def test_only_touched_buckets_are_rewritten_and_old_versions_go(spark, tmp_path):
    kept = memory(spark, tmp_path, buckets=16, keep=2)
    assert held(kept, spark) == []
    first = [(f"c{i}", "debt", [f"s{i}"], "1") for i in range(60)]
    kept.merge(spark.createDataFrame(first, MEMORY))
    touched = kept.merge(spark.createDataFrame([("c5", "debt", ["new", None], "2"), ("c5", "debt", None, None)], MEMORY))
    assert len(touched) == 1 and len(os.listdir(tmp_path / "memory" / "version-2")) - len([n for n in os.listdir(tmp_path / "memory" / "version-2") if n[0] in "._"]) == 1
    found = {r[0]: r for r in held(kept, spark)}
    assert len(found) == 60 and set(found["c5"][2]) >= {"new", "s5"} and found["c5"][3] == "2" and found["c6"][2] == ["s6"]
    assert kept.merge(spark.createDataFrame([], MEMORY)) == []
    for n in range(3):
        kept.merge(spark.createDataFrame([(f"c{i}", "debt", [f"n{n}"], "3") for i in range(60)], MEMORY))
    names = sorted(n for n in os.listdir(tmp_path / "memory"))
    assert [n for n in names if n.startswith("manifest")] == ["manifest-4", "manifest-5"] and [n for n in names if n.startswith("version")] == ["version-4", "version-5"]


def test_replays_and_late_batches_give_the_same_rows(spark, tmp_path):
    batches = [spark.createDataFrame([(f"c{i % 7}", "t", [f"b{n}", f"x{i % 3}"], str(n))for i in range(20)], MEMORY) for n in range(3)]
    one, other = memory(spark, tmp_path / "a", buckets=4), memory(spark, tmp_path / "b", buckets=4)
    for n in (0, 1, 2):
        one.merge(batches[n])
    for n in (2, 0, 0, 1, 2):
        other.merge(batches[n])
    assert held(one, spark) == held(other, spark) and len(held(one, spark)) == 7


def test_half_written_batches_do_not_count(spark, tmp_path):
    kept = memory(spark, tmp_path, buckets=4)
    kept.merge(spark.createDataFrame([("a", "t", ["x"], "1")], MEMORY))
    before = held(kept, spark)
    os.makedirs(tmp_path / "memory" / "version-2" / "bucket=0")
    os.makedirs(tmp_path / "memory" / "manifest-2")
    assert held(kept, spark) == before
    kept.merge(spark.createDataFrame([("b", "t", ["y"], "2")], MEMORY))
    assert [r[0] for r in held(kept, spark)] == ["a", "b"]


def test_trace_log_with_replays_failures_and_terminal_rows(spark, tmp_path):
    path, append = str(tmp_path / "log"), state.trace_sink(str(tmp_path / "log"))
    steps = spark.createDataFrame([("r", 1, "plan", "2024-01-01 00:00:00", False), ("r", 2, "rewrite", "2024-01-01 00:00:02", False), ("q", 1, "plan", "2024-01-01 00:00:00", False), ("o", 1, "plan", None, None)], "run string, pos long, state string, ts string, failed boolean").withColumn("ts", F.to_timestamp("ts"))
    for batch in (0, 0):
        append(steps, batch)
    append(steps.filter("pos = 2"), 1)  # the same step in another batch
    append(state.failure_step(spark.createDataFrame([("q", 2, "tool", None)], "run string, pos long, state string, ts timestamp"), F.lit("ValueError: x")), 2)
    log = state.trace_log(spark, path)
    assert log.count() == 5 and log.filter("failed").first().error == "ValueError: x"
    append(state.final_steps(log.filter("run = 'r'")), 3)
    found = {r.run: tuple(r)[1:] for r in state.run_rows(state.trace_log(spark, path)).collect()}
    assert found == {"r": (2, 0, "completed", 1, 2_000_000), "q": (2, 1, "failed", None, 0), "o": (1, 0, "open", None, None)}


def test_places_of_numbers(spark):
    draw = random.Random(8)
    parts = ["$ 1,234.5 million", "-3.25%", "plain", " ", "é😀", "$5B", "+7%", "\x01", "12", "\n", "$", "%"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 400))) for _ in range(60)] + ["", None, "x" * 500, "$1" * 900]
    docs = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    found = {r.i: r.m for r in docs.select("i", matches(F.col("text"), rules.FINANCIAL_NUMBER).alias("m")).collect()}
    for i, text in enumerate(texts):
        want = None if text is None else [(m[0], m.start(), m.end()) for m in re.finditer(rules.FINANCIAL_NUMBER, text, re.ASCII)]
        assert (None if found[i] is None else [tuple(x) for x in found[i]]) == want or (text is None and not found[i])


def test_prefix_sums(spark):
    for n in (0, 1, 63, 64, 65, 1000):
        row = spark.range(1).select(prefix_sums(F.transform(F.slice(F.sequence(F.lit(0), F.lit(n)), 1, n), lambda x: x % 7), 8).alias("s")).first()
        assert row.s == [sum(k % 7 for k in range(i)) for i in range(n)]
