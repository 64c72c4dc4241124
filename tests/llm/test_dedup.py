from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from comparing import DATA, rows, tables
from conftest_llm import ODD, frame, prose

from tallyspark.llm import dedup, oracles, queries
from tallyspark.llm.common import table
from tallyspark.llm.components import components
from tallyspark.llm.shingles import shingle_set


def plain(docs: list[tuple[int, str | None]], width: int = 4) -> dict[int, tuple[int, int]]:
    """n_shingles and component of each document, comparing all pairs that share a shingle."""
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    label = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
            lo, hi = sorted((label[a], label[b]))
            label = {i: lo if x == hi else x for i, x in label.items()}
    return {i: (len(s), label[i]) for i, s in sets.items()}


def check(docs: list[tuple], found) -> None:
    expected = plain([(d[0], d[1]) for d in docs])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found}
    assert got == {i: (n, c, i == c) for i, (n, c) in expected.items()}


def family(base: str, start: int, n: int, edits: int) -> list[tuple]:
    out = []
    for i in range(n):
        words, draw = base.split(" "), np.random.RandomState(start + i)
        for at in draw.choice(len(words), draw.randint(0, edits + 1), replace=False):
            words[at] = f"edit{start + i}x{at}"
        out.append((start + i, " ".join(words), "a"))
    return out


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, str(DATA / "sf0.001"), "documents").collect()]
    check(docs, queries.op10_chosen_path(spark, str(DATA / "sf0.001")).collect())


def test_query_equals_sql(spark):
    found = queries.op10_chosen_path(spark, str(DATA / "sf0.001")).toPandas()
    assert rows(found) == rows(tables("sf0.001").execute(oracles.SQL["op10_chosen_path"]).df())


def test_families_near_the_limit(spark):
    base = prose(1, 150).replace("\n", " ")
    docs = family(base, 0, 90, 9) + family(prose(2, 60).replace("\n", " "), 100, 40, 3) + [(200 + i, prose(50 + i, 40), "a") for i in range(40)]
    check(docs, dedup.near_duplicates(frame(spark, docs)).collect())


def test_large_nodes_branch_and_meet_in_blocks(spark):
    base = prose(1, 150).replace("\n", " ")
    docs = family(base, 0, 60, 8) + [(100 + i, base[:300] + " " + prose(60 + i, 100), "a") for i in range(40)]
    for levels in (0, 3):
        check(docs, dedup.near_duplicates(frame(spark, docs), leaf=10, levels=levels).collect())
    check(docs, dedup.near_duplicates(frame(spark, docs), leaf_shingles=400, levels=1).collect())


def test_odd_rows_and_one_of_each(spark, odd, none):
    found = dedup.near_duplicates(odd).collect()
    assert len(found) == len(ODD)
    by = {r.doc_id: r for r in found}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[4].n_shingles == 1 and by[6].component_id == 5 and not by[6].kept
    assert all(r.kept and r.component_id is None for r in found if r.doc_id is None)
    kept = dedup.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([None, None, 1, 2, 3, 4, 5, 7, 8, 9, 10], key=str)
    assert dedup.near_duplicates(none).count() == 0 and dedup.one_of_each(none).count() == 0


def test_a_hot_class_of_copies(spark):
    docs = [(i, prose(3, 50) if i % 3 == 0 else prose(100 + i, 50), "a") for i in range(120)]
    check(docs, dedup.near_duplicates(frame(spark, docs)).collect())


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(500, i) for i in range(501, 540)] + [(9000, 7000)]
    found = {r.id: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[i] == 1 for i in range(2, 61)) and all(found[i] == 500 for i in range(501, 540)) and found[9000] == 7000
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_runs_are_never_cut():
    keys = np.sort(np.random.RandomState(0).randint(0, 40, 300))
    frames = [pd.DataFrame({"cell": keys[i : i + 7]}) for i in range(0, 300, 7)]
    seen: list[int] = []
    for run in dedup.whole_runs(iter(frames), "cell"):
        assert not set(run["cell"]) & set(seen)
        seen += run["cell"].tolist()
    assert seen == keys.tolist()


def test_shingles_lower_only_ascii_and_split_only_ascii_blanks():
    assert len(shingle_set("A\x0bb c D e", 4)) == 2 and len(shingle_set("a b", 4)) == 1
    assert np.array_equal(shingle_set("AB cd ef gh", 4), shingle_set("ab CD ef gh", 4)) and not np.array_equal(shingle_set("É", 4), shingle_set("é", 4))
    assert not np.array_equal(shingle_set("a b c", 4), shingle_set("a b c d", 4)) and not len(shingle_set(None, 4))
