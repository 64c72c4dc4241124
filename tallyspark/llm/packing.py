"""Packing documents into token sequences by cutting-stock column generation (operator 5)."""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.llm.common import rank_in_groups, stage

#: Bytes of encoded parts, about, that make a generation; a worker keeps two, and none beyond its partition.
CACHE_BYTES = 64 << 20

#: Parts in these characters bear no normalisation but lower-casing, so their pre-tokens can be encoded one by one.
PLAIN = regex.compile(r"[!-~\u00a1-\u012f\u0131-\u024f]*")


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, others from U+0100 on."""
    own = [b for b in range(256) if chr(b).isprintable() and b != 0x20 and b != 0xAD]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class Parts(dict):
    """Encoded parts in two generations; a missing one is taken over from the older generation, or made."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make, self.bytes, self.older = make, 0, {}

    def __missing__(self, part: str) -> bytes:
        found = self.older.get(part)
        if found is None:
            found = self.make(part)
        self[part] = found
        self.bytes += 200 + len(part) + len(found)
        return found

    def age(self) -> None:
        """Begin a new generation; what nobody asked for in the last one goes."""
        self.older, self.bytes = dict(self), 0
        super().clear()

    def clear(self) -> None:
        super().clear()
        self.bytes, self.older = 0, {}


class WordEncoder:
    """Ids of whole texts from ids of their blank-separated parts.

    The tokenizer drops white space, looks at no character beyond a part and changes none across a blank,
    so the parts' ids, joined, are the text's ids; parts repeat, so most are found in the cache. New parts
    of plain characters are encoded by their pre-tokens' bytes with a rank table built from the tokenizer's own
    vocabulary and merges (byte 0xFF, which no text holds, ends a word); all others, and those that hold
    the string of a special token, by the tokenizer as its file loads.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path = path
        self.known = Parts(self.part)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special)) or "(?!)")
        self.fast = None if any(" " in t or "\n" in t or t.isalpha() for t in special) else self.rank_table(spec)
        if self.fast is not None:
            pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
            self.pretoken, self.letters_are_one = regex.compile(pattern), "|[\\p{L}]+|" in pattern

    @cached_property
    def tokenizer(self):
        """Loaded when a part first needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @staticmethod
    def rank_table(spec: dict) -> tiktoken.Encoding | None:
        """Ranks that are the ids, if ids follow the order of merges; else none, and the tokenizer does it all."""
        vocabulary, suffix, byte = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or "", byte_of_char()
        kinds = [n["type"] for n in spec["normalizer"].get("normalizers", [])] if spec.get("normalizer") else []
        added = {t["content"] for t in spec["added_tokens"]}
        ranks: dict[bytes, int] = {}
        for token, i in vocabulary.items():
            if token in added:
                continue
            body, end = (token[: -len(suffix)], b"\xff") if suffix and token.endswith(suffix) and token != suffix else (token, b"")
            if any(c not in byte for c in body):
                return None
            ranks[bytes(byte[c] for c in body) + end] = i
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        ordered = all(vocabulary[m] == 512 + i for i, m in enumerate(merged))
        if not suffix or kinds != ["NFC", "Replace", "Lowercase"] or not ordered:
            return None
        ranks.setdefault(b"\xff", len(vocabulary) + 1)  # never left over: every byte joins it first
        return tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})

    def part(self, p: str) -> bytes:
        plain = self.fast is not None and ((p.isascii() and p.isprintable()) or PLAIN.fullmatch(p))
        if plain and self.letters_are_one and p.isalpha():
            ids = self.fast._encode_single_piece(p.lower().encode() + b"\xff")
        elif plain and not self.special.search(p):
            piece = self.fast._encode_single_piece
            ids = [i for t in self.pretoken.findall(p.lower()) for i in piece(t.encode() + b"\xff")]
        else:
            ids = self.tokenizer.encode(p, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.fast is None:  # nothing is known of how its parts join
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if self.known.bytes > CACHE_BYTES:
            self.known.age()
        known = self.known
        return b"".join([known[p] for p in text.replace("\n", " ").split(" ")])


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """One for each worker."""
    return WordEncoder(path)


PIECE = "doc_id long, row_hash long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, row_hash, start, length, ids_crc32, doc_tokens: full sequences of each document, then its rest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        try:
            for batch in batches:
                row, made = [], []
                for i, text in enumerate(batch.column("text")):
                    ids = memoryview(encoder.encode(text.as_py()) + end)
                    n = len(ids) // 4
                    row += [i] * -(-n // capacity)
                    made += [(s, min(capacity, n - s), zlib.crc32(ids[4 * s : 4 * min(n, s + capacity)]), n) for s in range(0, n, capacity)]
                numbers = np.array(made, np.int64).reshape(-1, 4)
                carried = [batch.column(c).take(pa.array(row, pa.int64())) for c in ("doc_id", "row_hash")]
                yield pa.RecordBatch.from_arrays([*carried, *map(pa.array, numbers.T.copy())], names=["doc_id", "row_hash", "start", "length", "ids_crc32", "doc_tokens"])
        finally:
            encoder.known.clear()

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("row_hash"))
    return rows.mapInArrow(cut, PIECE)


def best_pattern(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The knapsack filling of greatest price: prices[i] for an item of width i + 1, any number of each."""
    value = np.zeros(capacity + 1)
    took = np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        offers = value[c - 1 :: -1][: len(prices)] + prices[:c]
        best = int(offers.argmax())
        if offers[best] > value[c - 1] + 1e-12:
            value[c], took[c] = offers[best], best + 1
        else:
            value[c] = value[c - 1]
    pattern, c = np.zeros(len(prices), np.int64), capacity
    while c > 0:
        if took[c]:
            pattern[took[c] - 1] += 1
            c -= took[c]
        else:
            c -= 1
    return pattern, float(value[capacity])


def cutting_stock(demand: np.ndarray, capacity: int, rounds: int = 3000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, so that every demanded item has a place.

    demand[i] counts the items of width i + 1. The linear program over patterns is solved by a revised
    simplex whose columns the knapsack prices; the solution is rounded down, and what is left is packed by
    knapsacks bounded by the items left.
    """
    widths = np.flatnonzero(demand) + 1
    m = len(widths)
    if not m:
        return []
    need = demand[widths - 1].astype(float)
    basis = [np.eye(m, dtype=np.int64)[i] * (capacity // w) for i, w in enumerate(widths)]
    inverse = np.diag([1.0 / (capacity // w) for w in widths])
    x = inverse @ need
    for _ in range(rounds):
        dual = inverse.sum(axis=0)  # every pattern costs 1
        prices = np.zeros(capacity)
        prices[widths - 1] = np.maximum(dual, 0)
        full, value = best_pattern(prices, capacity)
        if value <= 1 + 1e-7:
            break
        column = full[widths - 1]
        direction = inverse @ column
        ahead = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        leave = int(ahead.argmin())
        step = ahead[leave]
        if not np.isfinite(step):
            break
        x = x - step * direction
        x[leave] = step
        row = inverse[leave] / direction[leave]
        inverse -= np.outer(direction, row)
        inverse[leave] = row
        basis[leave] = column
    left = demand.astype(np.int64).copy()
    plan: list[tuple[np.ndarray, int]] = []

    def use(pattern: np.ndarray, times: int) -> None:
        if times > 0 and pattern.any():
            plan.append((pattern.copy(), times))
            left[:] -= pattern * times

    for column, amount in zip(basis, x, strict=True):
        pattern = np.zeros(capacity, np.int64)
        pattern[widths - 1] = column
        use(pattern, int(np.floor(amount + 1e-9)))
        if (left < 0).any():  # more places than items: the rest is planned again below
            pattern, times = plan.pop()
            left[:] += pattern * times
    while left.any():  # at most about one pattern for each width remains
        fill, room = np.zeros(capacity, np.int64), capacity
        for w in widths[::-1]:
            k = min(int(left[w - 1]), room // int(w))
            fill[w - 1], room = k, room - k * int(w)
        use(fill, int(min(left[w - 1] // fill[w - 1] for w in widths if fill[w - 1])))
    return plan


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 4096, grain: int = 16) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece of every document.

    A document of more than capacity tokens gives full sequences and a rest. Rests are items, their
    lengths rounded up to grain tokens; the histogram of at most capacity / grain widths is all that the driver sees.
    Column generation chooses the patterns, and the ranked items of each width take the places of that
    width. docs: doc_id, text; other columns are ignored. A null text counts as empty and gives the end id
    alone. Rows with one doc_id are each packed; a null doc_id is carried through.
    """
    units = capacity // grain
    cut = pieces(docs, tokenizer_path, end_id, capacity).withColumn("width", F.ceil(F.col("length") / grain).cast("int"))
    cut = stage(cut, "packing")
    demand = np.zeros(units, np.int64)
    for row in cut.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect():  # at most units rows
        demand[row["width"] - 1] = row["n"]
    plan = cutting_stock(demand, units)
    # For each width: where, in the rank order of its items, each pattern's items begin.
    begins: dict[int, list[int]] = {w: [] for w in range(1, units + 1)}
    places: dict[int, list[tuple[int, int]]] = {w: [] for w in range(1, units + 1)}
    taken, sequence = np.zeros(units, np.int64), 0
    for pattern, times in plan:
        for i in np.flatnonzero(pattern):
            begins[i + 1].append(int(taken[i]))
            places[i + 1].append((sequence, int(pattern[i])))
            taken[i] += pattern[i] * times
        sequence += times
    starts = {w: np.array(b, np.int64) for w, b in begins.items()}
    firsts = {w: np.array([p[0] for p in v], np.int64) for w, v in places.items()}
    counts = {w: np.array([p[1] for p in v], np.int64) for w, v in places.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width, item = batch.column("width").to_numpy(zero_copy_only=False), batch.column("item").to_numpy(zero_copy_only=False)
            sequence_id = np.zeros(len(width), np.int64)
            for w in np.unique(width).tolist():
                rows = np.flatnonzero(width == w)
                k = np.searchsorted(starts[w], item[rows], "right") - 1
                sequence_id[rows] = firsts[w][k] + (item[rows] - starts[w][k]) // counts[w][k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(sequence_id)], names=[*carried, "sequence_id"])

    ranked = rank_in_groups(cut, ["width"], ["doc_id", "start", "row_hash"], name="item")
    carried = ["doc_id", "row_hash", "start", "length", "ids_crc32", "doc_tokens"]
    placed = ranked.select(*carried, "width", "item").mapInArrow(place, f"{PIECE}, sequence_id long")
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "row_hash").rowsBetween(Window.unboundedPreceding, -1)  # a sequence holds at most capacity pieces
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset"))
