"""Byte-level BPE encoding in overlapping chunks, and decoding (operator 9)."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters of a chunk, and of what it shares with the next one.
CHUNK, OVERLAP = 32_768, 1_024


@lru_cache(maxsize=1)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The vocabulary file is read once in each worker."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def digests(parts: Iterable[np.ndarray], decoder: tiktoken.Encoding) -> tuple[int, str, str]:
    """Count, SHA-256 of the decimal ids joined by spaces, SHA-256 of the decoded bytes; by slices, so memory stays bounded."""
    ids_sha, bytes_sha, n = hashlib.sha256(), hashlib.sha256(), 0
    for ids in parts:
        for at in range(0, len(ids), 1 << 16):
            part = ids[at : at + (1 << 16)].tolist()
            ids_sha.update(((" " if n else "") + " ".join(map(str, part))).encode())
            bytes_sha.update(decoder.decode_bytes(part))
            n += len(part)
    return n, ids_sha.hexdigest(), bytes_sha.hexdigest()


def chunks(long_docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """doc_id, th, i, start, piece: overlapping pieces of long texts, dealt evenly over tasks."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                starts = range(0, max(1, len(row.text) - overlap), chunk)
                for i, s in enumerate(starts):
                    end = len(row.text) if i == len(starts) - 1 else s + chunk + overlap
                    yield pd.DataFrame({"row_id": [row.row_id], "i": [i], "start": [s], "piece": [row.text[s:end]]})

    cut_up = long_docs.mapInPandas(cut, "row_id string, i int, start long, piece string")
    return cut_up.repartition("row_id", "i")


def pretoken_edges(pieces: DataFrame, pattern: str, overlap: int, chunk: int) -> DataFrame:
    """Add head and tail: starts of pre-tokens in what a chunk shares with the one before and the one after.

    Absolute character positions. The last pre-token of a chunk that is not the text's last may go on
    beyond it, so neither its end nor a start after it is used.
    """

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split = compiled(pattern)
        for batch in batches:
            heads, tails = [], []
            for start, piece in zip(batch["start"], batch["piece"], strict=True):
                at = [m.start() for m in split.finditer(piece)]
                heads.append([start + p for p in at if p < overlap])
                tails.append([start + p for p in at[:-1] if p >= chunk])
            yield batch.assign(head=heads, tail=tails)

    return pieces.mapInPandas(edges, "row_id string, i int, start long, piece string, head array<long>, tail array<long>")


def stitched(edged: DataFrame) -> DataFrame:
    """row_id, first, text: pieces between positions where neighbouring chunks agree on a pre-token's start.

    From such a position on, both chunks' pre-tokens are the same. Where two neighbours share no start,
    their chunks stay in one piece.
    """
    order = Window.partitionBy("row_id").orderBy("i")
    cut = F.array_min(F.array_intersect("head", F.lag("tail").over(order)))
    with_cut = edged.withColumn("cut", F.when(F.col("i") == 0, F.lit(0).cast("long")).otherwise(cut))
    follow = with_cut.withColumns({"next_cut": F.lead("cut").over(order), "next_start": F.lead("start").over(order), "group": F.count("cut").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    # A chunk gives what lies from its own cut (else from its start) to the next chunk's cut (else the next start).
    begin = F.coalesce("cut", "start")
    end = F.coalesce("next_cut", "next_start", F.col("start") + F.length("piece"))
    own = follow.select("row_id", "group", "i", begin.alias("begin"), F.col("piece").substr((begin - F.col("start") + 1).cast("int"), (end - begin).cast("int")).alias("part"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "part"))), lambda x: x["part"]), "")
    return own.groupBy("row_id", "group").agg(F.min("begin").alias("first"), joined.alias("text")).repartition("row_id", "first")


def encode(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs (doc_id, text; other columns are ignored).

    Texts of up to chunk + overlap characters are one chunk and are encoded where they are read. Longer
    ones are cut into overlapping chunks that are pre-tokenised in parallel, stitched and encoded in
    pieces, and only those are shuffled. A null text counts as empty: no ids, the digests of nothing. Rows with
    one doc_id are each encoded; a null doc_id is carried through.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    is_long = F.length("text") > chunk + overlap

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(ranks_path, pattern)
        for batch in batches:
            found = [digests([np.array(coder.encode_ordinary(t.as_py()), np.uint32)], coder) for t in batch.column("text")]
            made = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    def encode_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoding(ranks_path, pattern)
        for batch in batches:
            yield pd.DataFrame({"row_id": batch["row_id"], "first": batch["first"], "ids": [np.array(coder.encode_ordinary(t), "<u4").tobytes() for t in batch["text"]]})

    def finish(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("first").sort_values("first")
        n, ids_sha, bytes_sha = digests((np.frombuffer(ids, "<u4") for ids in group["ids"]), encoding(ranks_path, pattern))
        return pd.DataFrame({"row_id": [key[0]], "n_tokens": [n], "ids_sha256": [ids_sha], "decoded_sha256": [bytes_sha]})

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    short = rows.filter(~is_long).mapInArrow(whole, f"doc_id long, {schema}")
    # Equal long texts are encoded once, whatever their ids.
    keyed = rows.filter(is_long).withColumn("row_id", F.sha2(F.col("text"), 256))
    long_docs = keyed.groupBy("row_id").agg(F.first("text").alias("text"))
    edged = pretoken_edges(chunks(long_docs, chunk, overlap), pattern, overlap, chunk)
    pieces = stitched(edged).mapInPandas(encode_pieces, "row_id string, first long, ids binary")
    encoded = pieces.groupBy("row_id").applyInPandas(finish, f"row_id string, {schema}")
    long_rows = keyed.select("doc_id", "row_id").join(encoded, "row_id").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    return short.union(long_rows)
