"""Near-duplicate detection by a chosen-path set similarity join over minwise tokens (operator 10)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType
from pyspark.sql.window import Window

from tallyspark.llm.common import column, discard, fresh, stage
from tallyspark.llm.components import components
from tallyspark.llm.shingles import COORDINATES, minwise, shingle_set

#: The chance that a pair at the limit of similarity fails one of the tests on tokens, at most.
CHANCE = 1e-9
BATCH_SHINGLES = 400_000


def least_agreeing(share: float) -> int:
    """So many of the tokens agree, each with the probability share, but for CHANCE."""
    below = 0.0
    for n in range(COORDINATES + 1):
        below += math.comb(COORDINATES, n) * share**n * (1 - share) ** (COORDINATES - n)
        if below > CHANCE:
            return n
    return COORDINATES


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, two hashes of the whole set, two bits of each token, the tokens."""

    def sign(ids: list, hashes: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        full = [i for i, s in enumerate(sets) if len(s)]
        n = len(sets)
        h1, h2, bits0, bits1 = (np.zeros(n, np.int64) for _ in range(4))
        tokens: list = [np.empty(0, np.int32)] * n
        if full:
            lengths = np.array([len(sets[i]) for i in full])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            flat = np.concatenate([sets[i] for i in full])
            t = minwise(flat, starts)
            h1[full] = np.add.reduceat(flat, starts).view(np.int64)
            h2[full] = np.bitwise_xor.reduceat(flat * np.uint64(0xC2B2AE3D27D4EB4F) ^ (flat >> np.uint64(31)), starts).view(np.int64)
            for k, plane in enumerate((bits0, bits1)):
                plane[full] = (((t >> k) & 1).astype(np.uint64) << np.arange(COORDINATES, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)
            for i, row in zip(full, t.view(np.int32), strict=True):
                tokens[i] = row
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "th": pa.array(hashes, pa.int64()), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "h1": h1, "h2": h2, "bits0": bits0, "bits1": bits1, "tokens": pa.array(tokens, pa.list_(pa.int32()))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        hashes: list = []
        sets: list[np.ndarray] = []
        total = 0
        for batch in batches:
            for doc_id, th, text in zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), batch.column("text"), strict=True):
                ids.append(doc_id)
                hashes.append(th)
                sets.append(shingle_set(text.as_py(), width))
                total += len(sets[-1])
                if total > BATCH_SHINGLES or len(ids) >= 5000:
                    yield sign(ids, hashes, sets)
                    ids, hashes, sets, total = [], [], [], 0
        if ids:
            yield sign(ids, hashes, sets)

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return columns.mapInArrow(run, "doc_id long, th long, n_shingles long, h1 long, h2 long, bits0 long, bits1 long, tokens array<int>")


def texts_as_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """id and the full shingle set (sorted hashes) of its text. ids: id, th."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                some = batch.iloc[at : at + 500]
                yield pd.DataFrame({"id": some["id"], "shingles": [shingle_set(t, width).view(np.int64) for t in some["text"]]})

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"), "text").join(ids.hint("merge"), ["id", "th"], "left_semi")
    return rows.groupBy("id", "th").agg(F.min("text").alias("text")).mapInPandas(read, "id long, shingles array<long>")


def whole_runs(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The rows of batches that are sorted by key, re-cut so that no key is split."""
    kept: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        k = batch[key].to_numpy()
        last = int(np.searchsorted(k, k[-1]))  # where the last run begins
        if last or (kept and kept[-1][key].iloc[-1] != k[-1]):
            yield pd.concat([*kept, batch.iloc[:last]], ignore_index=True)
            kept = [batch.iloc[last:]]
        else:
            kept.append(batch)
    if kept:
        yield pd.concat(kept, ignore_index=True)


def runs(rows: pd.DataFrame, key: str) -> Iterator[pd.DataFrame]:
    k = rows[key].to_numpy()
    edges = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        if hi - lo > 1:
            yield rows.iloc[lo:hi]


def responsible(x: np.ndarray, y: np.ndarray, small_x: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """For each (x, y): no earlier tree has both in one small node. So a pair is compared in one tree only.

    x, y: the trees' tokens, broadcast against each other; small_x: for each x, a bit for each tree whose
    node of x is small. tree: the tree of the cell, or the number of trees for cells below the first level.
    """
    met = np.zeros(np.broadcast_shapes(x.shape[:-1], y.shape[:-1]), bool)
    for t in range(int(tree)):
        met |= (x[..., t] == y[..., t]) & ((small_x >> t) & 1).astype(bool)
    return ~met


def with_partner(cells: DataFrame, percent: int, tasks: int) -> DataFrame:
    """The rows of cells that have a partner there: alike by the token bits and not met in an earlier tree."""
    similar = percent / 100
    least = least_agreeing(similar + (1 - similar) / 4)  # two bits agree by chance, too

    def flag(rows: pd.DataFrame) -> np.ndarray:
        b0, b1 = (rows[b].to_numpy().view(np.uint64) for b in ("bits0", "bits1"))
        hit = np.zeros(len(rows), bool)
        trees = small = None
        for at in range(0, len(rows), 256):
            here = slice(at, at + 256)
            alike = COORDINATES - np.bitwise_count((b0[here, None] ^ b0[None]) | (b1[here, None] ^ b1[None])).astype(np.int16) >= least
            alike[np.arange(alike.shape[0]), np.arange(at, at + alike.shape[0])] = False
            i, j = np.nonzero(alike)
            if len(i):
                if trees is None:
                    trees, small = np.stack(rows["trees"].to_numpy()), rows["small"].to_numpy()
                good = responsible(trees[at + i], trees[j], small[at + i], rows["tree"].iloc[0])
                hit[at + i[good]] = True
        return hit

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_runs(batches, "cell"):
            found = [r[["cell", "tree", "id"]][flag(r)] for r in runs(rows, "cell")]
            if found:
                yield pd.concat(found)

    placed = cells.repartition(tasks, "cell").sortWithinPartitions("cell")
    return placed.mapInPandas(run, "cell long, tree int, id long")


def links_in_cells(flagged: DataFrame, sets: DataFrame, signed: DataFrame, percent: int, trees: int, tasks: int) -> DataFrame:
    """Links (a, b) between rows of a cell, confirmed on full sets; enough to connect what is connected there."""
    least = least_agreeing(percent / 100)

    def join(rows: pd.DataFrame) -> list[tuple[int, int]]:
        ids, shingles = rows["id"].to_numpy(), [np.asarray(x).view(np.uint64) for x in rows["shingles"]]  # sorted as unsigned
        tokens, small, sizes = np.stack(rows["tokens"].to_numpy()), rows["small"].to_numpy(), np.array([len(x) for x in shingles])
        label, found = np.arange(len(ids)), []
        for i in range(len(ids)):
            other = np.flatnonzero((label != label[i]) & (np.arange(len(ids)) > i) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])))
            other = other[(tokens[other] == tokens[i]).sum(axis=1) >= least]
            other = other[responsible(tokens[i : i + 1, :trees], tokens[other, :trees], small[i : i + 1], rows["tree"].iloc[0])]
            for at in range(0, len(other), 256):
                some = other[at : at + 256]
                flat = np.concatenate([shingles[j] for j in some])
                place = np.minimum(np.searchsorted(shingles[i], flat), sizes[i] - 1)
                both = np.add.reduceat((shingles[i][place] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[some])[:-1]]))
                for j in some[100 * both >= percent * (sizes[i] + sizes[some] - both)]:
                    if label[j] != label[i]:
                        found.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
                        label[label == label[j]] = label[i]
        return found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_runs(batches, "cell"):
            found = [x for r in runs(rows, "cell") for x in join(r)]
            yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    known = sets.join(signed.select("id", "tokens", "small"), "id")
    full = flagged.join(known, "id").repartition(tasks, "cell").sortWithinPartitions("cell", "id")
    return full.select("cell", "tree", "id", "tokens", "small", "shingles").mapInPandas(run, "a long, b long")


def in_blocks(rows: DataFrame, block: int, weight: int) -> DataFrame:
    """Cells for nodes of any size: rows are dealt into blocks, and each two blocks meet in a cell."""
    sizes = rows.groupBy("path").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n_shingles") / weight)).cast("int").alias("blocks"))
    dealt = rows.join(sizes, "path").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    sent = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return sent.withColumn("cell", F.xxhash64("path", F.least("mine", "other"), F.greatest("mine", "other")))


def branch(rows: DataFrame, chance: float) -> DataFrame:
    """Send each row down one or two children of its path; the path alone picks the coordinates, the row's token the child."""
    first = F.pmod(F.xxhash64("path", F.lit("first")), F.lit(COORDINATES)).cast("int")
    second = F.pmod(first + 1 + F.pmod(F.xxhash64("path", F.lit("second")), F.lit(COORDINATES - 1)).cast("int"), F.lit(COORDINATES))
    two = F.pmod(F.xxhash64("path", F.lit("two")), F.lit(1000)) < int(chance * 1000)
    chosen = F.when(two, F.array(first, second)).otherwise(F.array(first))
    down = rows.withColumn("c", F.explode(chosen))
    return down.withColumn("path", F.xxhash64("path", "c", F.get("tokens", F.col("c")))).drop("c")


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80, trees: int | None = None, leaf: int = 1024, leaf_shingles: int = 2_000_000, levels: int = 6, two_children: float = 0.5, rows_per_task: int = 20_000) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text; other columns are ignored).

    1. Texts with equal shingle sets form a class; its smallest doc_id stands for it.
    2. Each of the independent trees deals the representatives by one minwise token. Small nodes (at most
       leaf rows and leaf_shingles shingles) are compared exhaustively: bits of the tokens first, which
       leaves rows with a likely partner, then these rows' full sets. A pair is compared in the first tree in
       which it shares a small node.
    3. Larger nodes branch by further tokens, which parts unlike texts and keeps like ones together. What is
       still large after the last level is compared block by block, so nothing is cut off.
    4. The confirmed links are closed to components.
    Unless given, there are so many trees that a pair at the limit shares no first node with a probability of
    1e-8 at most (twelve for 80 percent); a pair whose first nodes are large in all of twelve trees is parted
    by every branching with about 2e-4, where no other member of its component holds it together.

    Null and empty texts have no shingles and stay alone; a null doc_id stays alone and is kept. Rows with
    one doc_id count as one document, whose text is the worded one of smallest hash; long texts are compared
    whole. Ties go to the smaller doc_id; an empty table gives no rows.
    """
    if trees is None:
        trees = math.ceil(math.log(1e-8) / math.log1p(-min(percent, 99) / 100))
    if not 1 <= trees < COORDINATES:
        raise ValueError(f"{trees} trees: give a percent of 26 or more, or fewer trees")
    signed = stage(signatures(docs, width), "dedup")
    one_text = F.min(F.struct("th", "h1", "h2", "n_shingles", "bits0", "bits1", "tokens")).alias("x")
    usable = stage(signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(one_text).select("doc_id", "x.*"), "dedup")
    least = F.min(F.struct(F.col("doc_id").alias("id"), "th", "n_shingles", "bits0", "bits1", "tokens")).alias("x")  # combined on the map side, so many copies cost a row per task
    reps = stage(usable.groupBy("h1", "h2").agg(least).select("h1", "h2", "x.*"), "dedup")
    classes = reps.select("h1", "h2", "id")
    paths = F.array(*(F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), F.col("tokens")[t]).alias("path")) for t in range(trees)))
    members = reps.select("id", "n_shingles", F.explode(paths).alias("p")).select("id", "n_shingles", "p.*")
    is_small = (F.count(F.lit(1)) <= leaf) & (F.sum("n_shingles") <= leaf_shingles)
    nodes = members.groupBy("path").agg(F.count(F.lit(1)).alias("n"), is_small.alias("is_small"))
    met_rows = stage(members.drop("n_shingles").join(nodes, "path"), "dedup")
    shared = met_rows.filter("n > 1").drop("n")  # rows that meet another text in some tree
    small = shared.groupBy("id").agg(F.bit_or(F.when(F.col("is_small"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("tree"))).otherwise(F.lit(0).cast("long"))).alias("small"))
    marked = stage(reps.drop("h1", "h2").join(small, "id"), "dedup")
    facts = marked.select("id", "bits0", "bits1", F.slice("tokens", 1, trees).alias("trees"), "small")
    cells = [shared.filter("is_small").select(F.col("path").alias("cell"), "tree", "id")]
    rows = shared.filter(~F.col("is_small")).select("path", "id").join(marked.select("id", "n_shingles", "tokens"), "id")
    level = 0
    while level < levels and not rows.isEmpty():
        down = stage(branch(rows, two_children), "dedup")
        sizes = down.groupBy("path").agg(F.count(F.lit(1)).alias("n"), is_small.alias("is_small")).filter("n > 1").drop("n")
        down = down.join(sizes, "path")
        cells.append(down.filter("is_small").select(F.col("path").alias("cell"), F.lit(trees).alias("tree"), "id"))
        rows = stage(down.filter(~F.col("is_small")).drop("is_small"), "dedup")
        level += 1
    if not rows.isEmpty():
        cells.append(in_blocks(rows.drop("tokens"), leaf // 2, leaf_shingles // 2).select("cell", F.lit(trees).alias("tree"), "id"))
    met = cells[0]
    for more in cells[1:]:
        met = met.union(more)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = stage(met, "dedup")
    flagged = stage(with_partner(met.join(facts, "id"), percent, max(partitions, met.count() // rows_per_task)), "dedup")
    discard(met, met_rows)
    ids = flagged.groupBy("id").agg(F.lit(1).alias("one")).drop("one")
    sets = stage(texts_as_sets(docs, ids.join(reps.select("id", "th"), "id"), width), "dedup")
    links = stage(links_in_cells(flagged, sets, marked, percent, trees, max(partitions, flagged.count() // (rows_per_task // 10))), "dedup")
    discard(flagged, sets, marked)
    labels = components(links)

    named = classes.join(labels, "id", "left").select("h1", "h2", F.coalesce("label", "id").alias("class_component"))
    of_id = usable.select("doc_id", "h1", "h2").join(named, ["h1", "h2"]).select("doc_id", F.col("class_component").alias("component"))
    s, o = signed.alias("s"), of_id.alias("o")
    out = s.join(o, F.col("s.doc_id") == F.col("o.doc_id"), "left")
    component = F.coalesce("o.component", "s.doc_id")
    return out.select(F.col("s.doc_id").alias("doc_id"), F.col("s.n_shingles").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("s.doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, **parameters: int) -> DataFrame:
    """The rows of docs that are kept, in its columns.

    Of several rows with one doc_id the one whose text has the smallest hash stays, a null text last; between
    equal texts the other columns decide. Null ids stay; empty and null texts stay.
    """
    found = near_duplicates(docs, **parameters).filter("kept").select("doc_id").distinct()
    id_, hash_, place = fresh(docs, "id", "hash", "place")
    own = docs.withColumns({id_: F.col("doc_id").cast("long"), hash_: F.xxhash64("text")})
    same = own.filter(F.col(id_).isNotNull()).join(found.select(F.col("doc_id").alias(id_)).hint("merge"), id_, "left_semi")
    plain = [f.name for f in docs.schema.fields if isinstance(f.dataType, AtomicType) and f.name != "text"]
    order = Window.partitionBy(id_).orderBy(F.col("text").isNull(), hash_, "text", *map(column, plain))
    first = same.withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1)
    columns = list(map(column, docs.columns))
    return first.select(*columns).union(own.filter(F.col(id_).isNull()).select(*columns))
