"""WARC archives: a deterministic sharded writer and its reader (operator 13)."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.llm.common import discard, salted_join, stage

VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Five hexadecimal digits in base 32 as Java writes them, and as RFC 4648 does.
DIGITS, LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: What a record without an id sorts as: before all others.
NO_ID = -(1 << 63)
READ_BYTES = 1 << 16
MANIFEST = "name string, temporary string, segment long, roll int, records long, bytes long, sha256 string"
RECORDS = "page_id long, url string, record_id string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, file string"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a payload in base 32, 32 letters."""
    hexed = F.upper(F.sha1(payload))
    return F.translate(F.concat(*(F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8))), DIGITS, LETTERS)


def storage(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


def described(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (UTF-8 of the html; null: empty), its bytes and digest, and a hash that orders the records of one id."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    known = base.withColumns({"size": F.length("payload").cast("long"), "digest": base32_sha1(F.col("payload"))})
    return known.withColumns({"key": F.coalesce("page_id", F.lit(NO_ID)), "tie": F.xxhash64("url", "digest")})


def with_first(known: DataFrame, heads: DataFrame, min_bytes: int) -> DataFrame:
    """Add first (page_id and url of the first of several records with one payload of min_bytes or more; else null).

    heads: the rows of known without their payloads, staged, so that digests are worked out once for all passes over them.
    Records of a payload are combined on the map side before they meet; only payloads with several records are joined back.
    """
    alike = heads.filter((F.col("size") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("digest", "size")
    firsts = alike.agg(F.min(F.struct("page_id", "url")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = salted_join(heads.select("key", "tie", "url", "digest", "size"), firsts, ["digest", "size"]).filter(F.col("key") > F.col("first.page_id"))
    revisits = stage(later.groupBy("key", "tie", "url", "digest").agg(F.first("first").alias("first")), "warc")
    k, r = known.alias("k"), revisits.alias("r")
    same = (F.col("k.key") == F.col("r.key")) & (F.col("k.tie") == F.col("r.tie")) & (F.col("k.digest") == F.col("r.digest")) & F.col("k.url").eqNullSafe(F.col("r.url"))
    return k.join(r, same, "left").select("k.*", "r.first")


def segment_starts(known: DataFrame, segment_bytes: int) -> list[tuple[int, int]]:
    """The first (key, tie) of each segment: records in order, cut where their bytes pass multiples of segment_bytes.

    Sums run over the records' sizes alone, in ranges whose totals are then put one after the other, so the cuts do not
    depend on how the table was dealt. There is one for each segment_bytes of input.
    """
    sizes = known.select("key", "tie", (F.col("size") + 512).alias("w"))
    ranged = stage(sizes.repartitionByRange("key", "tie").withColumn("part", F.spark_partition_id()), "warc")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").agg(F.sum("w").alias("w")).select("part", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("part").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("inside", F.coalesce(F.sum("w").over(within), F.lit(0))).join(offsets, "part")
    segment = F.floor((F.col("inside") + F.col("offset")) / segment_bytes)
    starts = sorted((r.start.key, r.start.tie) for r in placed.groupBy(segment.alias("segment")).agg(F.min(F.struct("key", "tie")).alias("start")).collect())
    discard(ranged)
    return starts


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    named = hashlib.sha1(f"{page_id}\n{url}\n{digest}".encode()).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=named[:16], version=5)}>"


def block_digest(block: bytes) -> str:
    return base64.b32encode(hashlib.sha1(block).digest()).decode()


def uri(url: str) -> str:
    """The address with control characters and spaces escaped, so that it stays on its header line."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record, compressed as a gzip member of its own that holds no time."""
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers if v is not None), f"WARC-Block-Digest: sha1:{block_digest(block)}", f"Content-Length: {len(block)}"]
    squeezed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeezed.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeezed.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, first: dict | None, date: str) -> bytes:
    """A response with its payload, or a revisit of first with the headers alone; all headers and digests are made anew."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    digest = digest if first else block_digest(payload)
    headers = [
        ("WARC-Type", "revisit" if first else "response"), ("WARC-Record-ID", record_id(page_id, url, digest)), ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else uri(url)), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"), ("Page-Id", None if page_id is None else str(page_id)),
    ]
    if first:
        headers += [
            ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(first["page_id"], first["url"], digest)),
            ("WARC-Refers-To-Target-URI", None if first["url"] is None else uri(first["url"])), ("Refers-To-Page-Id", str(first["page_id"])),
        ]
    return record(headers, head if first else head + payload)


def write(pages: DataFrame, folder: str, segment_bytes: int = 1 << 28, roll_bytes: int = 1 << 26, min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write one WARC record per row into compressed archives below folder, and return the manifest's rows.

    pages: page_id, url, html; other columns, of any name, are ignored. Records are sorted by page_id over ranges of about
    segment_bytes, each the work of one task; within it a file is closed before it would pass roll_bytes compressed bytes
    (a larger record has a file of its own). Of records with one payload of at least min_revisit_bytes the one with
    the smallest page_id is the response, the others revisit it. The same rows give the same files, however they are dealt.

    Each try of a task writes under names of its own in folder/_temporary; the manifest staged by Spark names the
    files of the tries that counted, these are renamed (again, if a rename's task is lost), and the manifest in folder is written
    last: archives without it do not count. A folder with a manifest is refused.

    A null html is an empty payload; a null page_id sorts first, is a response and nothing refers to it; a null url has no target line.
    Rows with the smallest page_id of their payload are responses, also when there are several; equal rows give equal records.
    Records may be of any length, and lie in memory one at a time; an empty table gives a manifest without rows.
    """
    spark = pages.sparkSession
    system, root = storage(folder)
    if system.get_file_info(f"{root}/manifest/_SUCCESS").type != pafs.FileType.NotFound:
        raise FileExistsError(f"{folder} holds archives")
    system.create_dir(f"{root}/_temporary", recursive=True)
    known = described(pages)
    heads = stage(known.drop("payload"), "warc")
    starts = segment_starts(heads, segment_bytes)
    chosen = with_first(known, heads, min_revisit_bytes)
    discard(heads)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64).to_pylist()
                members = [page_record(r["page_id"], r["url"], r["payload"], r["size"], r["digest"], r["first"], date) for r in rows]
                segments = [bisect_right(starts, (r["key"], r["tie"])) - 1 for r in rows]
                yield pa.RecordBatch.from_pydict({"segment": segments, "key": [r["key"] for r in rows], "tie": [r["tie"] for r in rows], "member": members}, schema=pa.schema([("segment", pa.int64()), ("key", pa.int64()), ("tie", pa.int64()), ("member", pa.binary())]))

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_file: Archive | None = None
        for batch in batches:
            for segment, member in zip(batch.column("segment").to_pylist(), batch.column("member")):
                member = member.as_py()
                if open_file and (open_file.segment != segment or open_file.bytes + len(member) > roll_bytes):
                    yield open_file.closed()
                    open_file = Archive(folder, segment, open_file.roll + 1 if open_file.segment == segment else 0, date)
                open_file = open_file or Archive(folder, segment, 0, date)
                open_file.add(member)
        if open_file:
            yield open_file.closed()

    payload = F.when(F.col("first").isNull(), F.col("payload")).otherwise(F.lit(b""))
    narrow = chosen.select("page_id", "url", payload.alias("payload"), "size", "digest", "key", "tie", "first")
    members = narrow.mapInArrow(squeeze, "segment long, key long, tie long, member binary")
    dealt = members.repartition(max(1, len(starts)), "segment").sortWithinPartitions("segment", "key", "tie", "member")
    tried = stage(dealt.mapInArrow(roll, MANIFEST), "warc")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = storage(folder)
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    system.move(f"{root}/_temporary/{row['temporary']}", f"{root}/{row['name']}")
                except OSError:  # an earlier try of this task moved it
                    pass
                if system.get_file_info(f"{root}/{row['name']}").size != row["bytes"]:
                    raise OSError(f"{row['name']} is not whole")
            yield batch

    tried.repartition(max(1, min(len(starts), 1000))).mapInArrow(commit, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    discard(tried)
    system.delete_dir(f"{root}/_temporary")
    return manifest(spark, folder)


class Archive:
    """A file being written under the name of this try; it begins with a record that describes it."""

    def __init__(self, folder: str, segment: int, roll: int, date: str) -> None:
        system, root = storage(folder)
        self.segment, self.roll, self.records, self.bytes = segment, roll, 0, 0
        self.name = f"pages-{segment:08d}-{roll:05d}.warc.gz"
        self.temporary = f"{self.name}.{uuid.uuid4().hex}"
        self.sha = hashlib.sha256()
        self.out = system.open_output_stream(f"{root}/_temporary/{self.temporary}", compression=None)
        info = b"format: WARC File Format 1.1\r\nconformsTo: http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/\r\n"
        self.put(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, self.name, "")), ("WARC-Date", date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info))

    def put(self, member: bytes) -> None:
        self.out.write(member)
        self.sha.update(member)
        self.bytes += len(member)

    def add(self, member: bytes) -> None:
        self.put(member)
        self.records += 1

    def closed(self) -> pa.RecordBatch:
        self.out.close()
        row = {"name": [self.name], "temporary": [self.temporary], "segment": [self.segment], "roll": [self.roll], "records": [self.records], "bytes": [self.bytes], "sha256": [self.sha.hexdigest()]}
        types = {"name": pa.string(), "temporary": pa.string(), "segment": pa.int64(), "roll": pa.int32(), "records": pa.int64(), "bytes": pa.int64(), "sha256": pa.string()}
        return pa.RecordBatch.from_pydict(row, schema=pa.schema(list(types.items())))


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """name, segment, roll, records, bytes and sha256 of the archives in folder."""
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").drop("temporary")


def members(stream: pa.NativeFile, seen: hashlib._Hash) -> Iterator[bytes]:
    """The records of an archive, one gzip member at a time; seen takes in all bytes read."""
    rest = b""
    while True:
        unpacked, parts = zlib.decompressobj(31), []
        while not unpacked.eof:
            if not rest:
                rest = stream.read(READ_BYTES)
                seen.update(rest)
                if not rest and parts:
                    raise ValueError("the archive ends inside a record")
                if not rest:
                    return
            parts.append(unpacked.decompress(rest))
            rest = unpacked.unused_data
        yield b"".join(parts)


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record, held against its length and digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(headers["Content-Length"])]
    if version != VERSION or rest[len(block) :] != b"\r\n\r\n" or headers["WARC-Block-Digest"] != f"sha1:{block_digest(block)}":
        raise ValueError(f"record {headers.get('WARC-Record-ID')} is damaged")
    return headers, block


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """One row per response or revisit of the archives that the manifest in folder names.

    Returns page_id, url (as written in the archive), record_id, record_type, refers_to (page_id of the response, for revisits), payload_bytes and payload_digest (of the
    full payload), payload (null for revisits, and throughout without payloads) and file. Lengths, block and payload digests, each
    file's SHA-256 and number of records must agree, else the read fails. An empty manifest gives no rows.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = storage(folder)
        for batch in batches:
            for entry in batch.to_pylist():
                seen, n, held = hashlib.sha256(), 0, []
                with system.open_input_stream(f"{root}/{entry['name']}", compression=None) as stream:
                    for raw in members(stream, seen):
                        row = page_row(*parsed(raw), entry["name"])
                        if row is not None:
                            n += 1
                            held.append(row)
                        if len(held) == 64:
                            yield pa.RecordBatch.from_pylist(held, schema=ROWS)
                            held = []
                if seen.hexdigest() != entry["sha256"] or n != entry["records"]:
                    raise ValueError(f"{entry['name']} differs from its manifest")
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=ROWS)

    def page_row(headers: dict[str, str], block: bytes, name: str) -> dict | None:
        if headers["WARC-Type"] not in ("response", "revisit"):
            return None
        head, _, payload = block.partition(b"\r\n\r\n")
        response = headers["WARC-Type"] == "response"
        size = int(dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])["Content-Length"])
        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        if response and (len(payload) != size or block_digest(payload) != digest):
            raise ValueError(f"record {headers['WARC-Record-ID']} has another payload than it says")
        numbers = {k: int(headers[h]) if h in headers else None for k, h in (("page_id", "Page-Id"), ("refers_to", "Refers-To-Page-Id"))}
        described = {"url": headers.get("WARC-Target-URI"), "record_id": headers["WARC-Record-ID"], "record_type": headers["WARC-Type"], "payload_bytes": size, "payload_digest": digest}
        return {**numbers, **described, "payload": payload if payloads and response else None, "file": name}

    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    ROWS = pa.schema([(name, types[kind]) for name, kind in (c.split() for c in RECORDS.split(", "))])
    listed = manifest(spark, folder)
    return listed.repartition(max(1, min(listed.count(), 100_000))).mapInArrow(rows, RECORDS)
