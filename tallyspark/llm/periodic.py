"""Periodic runs of words: longest previous factors, LZ blocks, boundary extensions, bucketed copies (operator 12).

Texts are worked on in groups of a bounded number of words, laid end to end with an alphabet for each
text, so that no repeat crosses from one text to the next. Suffix sorting and common prefixes are
array operations over a group; what follows is linear in its words.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words of the texts that are sorted together; a longer text is a group of its own.
GROUP_WORDS = 1 << 17


@dataclass(frozen=True)
class Limits:
    """A run is kept if it has min_length words or more, and at least min_exponent times its period (2 or more)."""

    min_length: int = 24
    min_exponent: int = 3


def sorted_suffixes(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array, and for each k the ranks of all suffixes by their first 2**k symbols.

    Prefix doubling: a round sorts only the suffixes that the last one left together.
    """
    n = len(symbols)
    sa = np.argsort(symbols, kind="stable").astype(np.int64)
    ordered = symbols[sa]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    slots = np.arange(n, dtype=np.int64)
    rank = np.zeros(n + 1, dtype=np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, slots, 0)) + 1
    levels, step = [rank[:n].copy()], 1
    open_slots = slots[~(new & np.append(new[1:], True))]
    while len(open_slots):
        at = sa[open_slots]
        key = rank[at] * (n + 2) + rank[np.minimum(at + step, n)]
        order = np.argsort(key)
        at, key = at[order], key[order]
        sa[open_slots] = at
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[at] = np.maximum.accumulate(np.where(new, open_slots, 0)) + 1
        levels.append(rank[:n].copy())
        open_slots = open_slots[~(new & np.append(new[1:], True))]
        step *= 2
    return sa, levels


def common_prefixes(sa: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """For each suffix in order, the length of what it shares with the one before it; the levels' ranks are equal where 2**k symbols are."""
    n = len(sa)
    lcp = np.zeros(n, dtype=np.int64)
    left, right = sa[:-1].copy(), sa[1:].copy()
    together, pairs = [], np.arange(n - 1)
    for ranks in levels:
        pairs = pairs[ranks[left[pairs]] == ranks[right[pairs]]]
        together.append(pairs)
    for k in range(len(levels) - 1, -1, -1):
        some = together[k][right[together[k]] < n] if n else together[k]
        some = some[left[some] < n]
        equal = some[levels[k][left[some]] == levels[k][right[some]]]
        left[equal] += 1 << k
        right[equal] += 1 << k
        lcp[equal + 1] += 1 << k
    return lcp


def previous_factors(sa: np.ndarray, lcp: np.ndarray) -> tuple[list[int], list[int]]:
    """For each place, the length of its longest factor that begins earlier, too, and where.

    Places leave a list in suffix order from the last to the first, so the neighbours of a place are then the
    nearest suffixes that begin earlier.
    """
    n = len(sa)
    before, after, shared = np.full(n + 1, n), np.full(n + 1, n), np.zeros(n + 1, dtype=np.int64)
    before[sa[1:]], after[sa[:-1]], shared[sa] = sa[:-1], sa[1:], lcp
    alone = (shared[:n] == 0) & (shared[after[:n]] == 0)
    prev, following, common = before.tolist(), after.tolist(), shared.tolist()
    length, source = [0] * n, [0] * n
    for i in np.flatnonzero(~alone)[::-1].tolist():
        p, q = prev[i], following[i]
        a, b = common[i], common[q]
        if a >= b:
            length[i], source[i] = a, p
            common[q] = b
        else:
            length[i], source[i] = b, q
            common[q] = a
        following[p] = q
        prev[q] = p
    return length, source


def z_lengths(s: list[int]) -> list[int]:
    """For each place, how far the sequence from there agrees with its beginning."""
    n = len(s)
    z = [0] * n
    z[0] = n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k > right - i:
                k = right - i
            if i + k < right:
                z[i] = k
                continue
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def at_border(s: list[int], low: int, border: int, high: int) -> dict[tuple[int, int], int]:
    """Repetitions [first, last] of s[low:high] with their smallest period that hold or touch the border, by boundary extensions.

    For each period, what lies to the right of the border is compared with itself shifted (or with what lies
    to its left), and so is what lies to the left; both extensions together must reach the period.
    """
    t, v = s[low:border], s[border:high]
    back, width, reach = t[::-1], len(v), len(t)
    ahead = np.array(z_lengths([*v, -1, *t, *v]))
    behind = np.array(z_lengths([*back, -2, *(t + v)[::-1]]))
    found: dict[tuple[int, int], int] = {}

    def add(firsts: np.ndarray, lasts: np.ndarray, periods: np.ndarray) -> None:
        for first, last, p in zip(firsts.tolist(), lasts.tolist(), periods.tolist()):
            if found.get((first, last), p) >= p:
                found[first, last] = p

    if width:
        p = np.arange(1, width + 1)
        right = np.append(ahead[1:width], 0)
        left = behind[reach + 1 + width - p]
        ok = right + left >= p
        add(border - left[ok], border + p[ok] + right[ok] - 1, p[ok])
    if reach:
        p = np.arange(1, reach + 1)
        right = np.minimum(ahead[width + 1 + reach - p], width)
        left = np.append(behind[1:reach], 0)
        ok = right + left >= p
        add(border - p[ok] - left[ok], border + right[ok] - 1, p[ok])
    return found


def runs_of(s: list[int], start: int, end: int, length: list[int], source: list[int], limits: Limits) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of the text s[start:end] within the limits, by start and period; places count from start.

    The text is cut into LZ blocks, each the longest factor that begins earlier. A run that begins at or before the
    start of the block that holds its end reaches back less than twice the block before and this block; one that ends with
    a block is met at the next border; any other lies inside a block and is copied from the block's earlier place,
    where runs are kept in buckets by their start. A window of two blocks before and two like this one that is shorter
    than min_length holds no run that counts.
    """
    buckets: dict[int, dict[int, int]] = {}  # first -> {last: period}
    least, times = limits.min_length, limits.min_exponent

    def keep(first: int, last: int, period: int) -> None:
        if last - first + 1 >= least and last - first + 1 >= times * period:
            buckets.setdefault(first, {})[last] = period

    def at_block(at: int, previous: int, size: int) -> None:
        low = max(start, at - 2 * previous - max(size, 1))
        if at + size - low >= least:
            for (first, last), period in at_border(s, low, at, at + size).items():
                whole_left = first == start or s[first - 1] != s[first - 1 + period]
                whole_right = last + 1 == end or s[last + 1] != s[last + 1 - period]
                if whole_left and whole_right:
                    keep(first, last, period)
        if size >= least and length[at]:
            shift = at - source[at]
            for first in range(source[at] + 1, source[at] + size - least + 1):
                for last, period in buckets.get(first, {}).items():
                    if last < source[at] + size - 1:
                        keep(first + shift, last + shift, period)

    at, previous = start, 0
    while at < end:
        size = length[at] or 1
        if 2 * (previous + size) >= least:
            at_block(at, previous, size)
        at, previous = at + size, size
    at_block(end, previous, 0)
    return sorted((first - start, last - first + 1, period) for first, ends in buckets.items() for last, period in ends.items())


def runs_of_texts(texts: list[list], limits: Limits) -> Iterator[list[tuple[int, int, int]]]:
    """The runs of each text, a list of words; the texts are sorted together.

    No window of a text whose factors are all shorter than a quarter of min_length reaches min_length.
    """
    sizes = [len(words) for words in texts]
    if not sum(sizes):
        yield from ([] for _ in texts)
        return
    words = np.empty(sum(sizes), dtype=object)
    words[:] = [w for text in texts for w in text]
    codes, known = pd.factorize(words)
    symbols = np.repeat(np.arange(len(texts), dtype=np.int64), sizes) * len(known) + codes
    sa, levels = sorted_suffixes(symbols)
    length, source = previous_factors(sa, common_prefixes(sa, levels))
    del sa, levels, words, known
    s, start = symbols.tolist(), 0
    for size in sizes:
        end = start + size
        short = 4 * max(length[start:end], default=0) < limits.min_length and limits.min_length > 4
        yield [] if short else runs_of(s, start, end, length, source, limits)
        start = end


def without_repeats(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words without those that a run holds after its first period."""
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for first, length, period in runs:
        gone[first + period] += 1
        gone[first + length] -= 1
    covered = np.cumsum(gone[:-1]) > 0
    return words if not covered.any() else [words[i] for i in np.flatnonzero(~covered).tolist()]


def made_periodic(words: list[str], doc_id: int | None) -> list[str]:
    """Every tenth document, by a checksum of its id, repeats a stretch of its words to the end."""
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, compared exactly; ties go to the smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def periodic_runs(docs: DataFrame, limits: Limits = Limits(), planted: bool = False) -> DataFrame:
    """All runs of words in each whole text, and the text without their repeats.

    docs: doc_id, text; other columns, of any name, are ignored. Returns one row per input row: doc_id, runs (array of
    start, length, period in words, by start, then period), strongest (the one with the greatest length / period; null
    without a run) and collapsed (the kept words, joined by a space). planted first lets every tenth document repeat
    itself, see made_periodic. Null and empty texts have no words and no runs; a null doc_id is carried through (and
    planted as an empty id); equal rows give equal rows; an empty table gives no rows. A very long text is worked on alone, with memory in
    proportion to its words. Nothing is shuffled.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            group: list[tuple[int | None, list[str]]] = []
            held = 0
            for i, doc_id in enumerate(ids):
                words = WORD.findall(texts[i].as_py() or "")
                group.append((doc_id, made_periodic(words, doc_id) if planted else words))
                held += len(words)
                if held >= GROUP_WORDS:
                    yield described(group)
                    group, held = [], 0
            if group:
                yield described(group)

    def described(group: list[tuple[int | None, list[str]]]) -> pa.RecordBatch:
        out: dict[str, list] = {"doc_id": [], "n_words": [], "runs": [], "strongest": [], "collapsed": []}
        for (doc_id, words), runs in zip(group, runs_of_texts([w for _, w in group], limits)):
            out["doc_id"].append(doc_id)
            out["n_words"].append(len(words))
            out["runs"].append([dict(zip(("start", "length", "period"), r)) for r in runs])
            best = strongest(runs)
            out["strongest"].append(None if best is None else dict(zip(("start", "length", "period"), best)))
            out["collapsed"].append(" ".join(without_repeats(words, runs)))
        return pa.RecordBatch.from_pydict(out, schema=ROWS)

    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    ROWS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("strongest", run), ("collapsed", pa.string())])
    plain = "struct<start:long,length:long,period:long>"
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(found, f"doc_id long, n_words long, runs array<{plain}>, strongest {plain}, collapsed string")
