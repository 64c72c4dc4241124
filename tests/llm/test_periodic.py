from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from comparing import DATA
from conftest_llm import ODD, frame, prose

from tallyspark.llm import periodic, queries
from tallyspark.llm.common import table
from tallyspark.llm.periodic import Limits


def brute(words: list, least: int, times: int) -> list[tuple[int, int, int]]:
    """Stretches of equal words for each period; the smallest period of a stretch names the run."""
    codes = np.array([hash(w) for w in words], dtype=np.int64)
    found: dict[tuple[int, int], int] = {}
    for p in range(1, len(words) // 2 + 1):
        equal = np.concatenate(([0], (codes[p:] == codes[:-p]).astype(np.int8), [0]))
        begins, ends = np.flatnonzero(np.diff(equal) == 1), np.flatnonzero(np.diff(equal) == -1)
        for i, j in zip(begins.tolist(), ends.tolist()):
            if j - i >= p:
                found.setdefault((i, j - i + p), p)
    return sorted((i, n, p) for (i, n), p in found.items() if n >= max(least, times * p))


def planted(words: list[str], doc_id: int | None) -> list[str]:
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def digest(doc_id: int | None, text: str | None) -> tuple:
    words = planted(re.findall(r"[^\x20\x09-\x0D]+", text or ""), doc_id)
    runs = brute(words, 24, 3)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + n for s, n, p in runs)]
    described = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
    return doc_id, len(runs), *described, sha, hashlib.sha256(" ".join(kept).encode()).hexdigest()


def test_runs_against_brute_force():
    draw, seen = random.Random(12), 0
    for _ in range(1500):
        limits = Limits(*draw.choice([(2, 2), (6, 2), (6, 3), (24, 3), (3, 3)]))
        texts = []
        for _ in range(draw.randint(1, 4)):
            n, k = draw.randint(0, 70), draw.randint(1, 4)
            w = [draw.randrange(k) for _ in range(n)]
            if n and draw.random() < 0.5:
                a = draw.randrange(n)
                w = w[:a] + [w[a + i % (1 + (n - a) // 5)] for i in range(n - a)]
            texts.append(w + [9] + w if draw.random() < 0.3 else w)
        found = list(periodic.runs_of_texts(texts, limits))
        assert found == [brute(w, limits.min_length, limits.min_exponent) for w in texts]
        seen += sum(map(len, found))
    assert seen > 5000


def test_known_words():
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 400:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for word in (fibonacci[-1], "a" * 300, "ab" * 150 + "a", ("abc" * 9 + "d") * 9, "x"):
        assert list(periodic.runs_of_texts([list(word)], Limits(2, 2))) == [brute(list(word), 2, 2)]


def test_query_against_brute_force(spark):
    docs = table(spark, str(DATA / "sf0.001"), "documents").collect()
    found = sorted(tuple(r) for r in queries.op12_lpf_runs(spark, str(DATA / "sf0.001")).collect())
    assert found == sorted(digest(r.doc_id, r.text) for r in docs)
    assert sum(r[1] > 0 for r in found) > 10


def test_odd_rows_and_nothing(odd, none):
    found = sorted((tuple(r) for r in queries.runs_digest(periodic.periodic_runs(odd, planted=True)).collect()), key=str)
    assert found == sorted((digest(i, t) for i, t, _ in ODD), key=str)
    assert periodic.periodic_runs(none).count() == 0


def test_groups_and_long_texts(spark, monkeypatch):
    texts = [prose(1, 300) + " a b c" * 40, "x " * 100_000, prose(2, 30_000) + " " + prose(2, 30_000), " ".join("ab c d e".split() * 9) + " " + prose(3, 50), ""]
    docs = [(2 * i + 1, t, "a") for i, t in enumerate(texts)]
    found = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic.periodic_runs(frame(spark, docs)).collect()}
    assert found[3] == [(0, 100_000, 1)] and found[5] == [] and found[9] == []
    assert found[1] == brute(texts[0].split(), 24, 3) and found[7] == brute(texts[3].split(), 24, 3) != []
    monkeypatch.setattr(periodic, "GROUP_WORDS", 10)
    assert list(periodic.runs_of_texts([t.split() for t in texts[:1]], Limits()))[0] == found[1]


def test_repeats_go_but_for_the_first(spark):
    row = periodic.periodic_runs(frame(spark, [(1, "start " + "one two three " * 20 + "end", "a")])).collect()[0]
    assert row.collapsed == "start one two three end" and tuple(row.strongest) == (1, 60, 3)
