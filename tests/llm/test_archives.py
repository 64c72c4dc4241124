from __future__ import annotations

import base64
import gzip
import hashlib
import os
import uuid

import pytest
from comparing import DATA, rows, tables

from tallyspark.llm import archives, queries
from tallyspark.llm.common import table
from tallyspark.llm.oracles import SQL

ODD_PAGES = [
    (5, "http://a/x", "same"), (3, "http://b/y", "same"), (9, None, "same"), (None, "http://c", "same"), (3, "http://a", "same"), (7, "u v\r\nX: y", "é😀"),
    (8, "", None), (2, None, ""), (None, None, None), (1, "http://long", "long " * 300_000), (11, "http://long/2", "long " * 300_000), (12, "http://a", "once"), (12, "http://a", "once"),
]


def pages(spark, given, parts: int = 3):
    frame = spark.createDataFrame(given, "page_id long, url string, html string")
    return frame.selectExpr("*", "'clash' AS key", "'clash' AS tie", "'clash' AS payload", "'clash' AS segment", "'clash' AS first").repartition(parts)


def folder(spark) -> str:
    return f"{spark.conf.get('spark.checkpoint.dir')}/archives-{uuid.uuid4().hex}"


def expected(given, least: int = 0) -> list[tuple]:
    first: dict[str, int] = {}
    for i, _, html in given:
        if i is not None and len((html or "").encode()) >= least:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html in given:
        body = (html or "").encode()
        to = first.get(html or "")
        revisit = i is not None and len(body) >= least and i != to
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


def found(spark, place: str) -> list[tuple]:
    return sorted((tuple(r) for r in archives.read(spark, place).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def files(place: str) -> dict[str, str]:
    return {n: hashlib.sha256(open(f"{place}/{n}", "rb").read()).hexdigest() for n in os.listdir(place) if n.endswith(".warc.gz")}


def test_query_equals_sql(spark):
    got = queries.op13_sharded_writer(spark, str(DATA / "sf0.001")).toPandas()
    assert rows(got) == rows(tables("sf0.001").execute(SQL["op13_sharded_writer"]).df())


@pytest.mark.parametrize("least", [0, 5, 1 << 30])
def test_odd_pages_round_trip(spark, least):
    place = folder(spark)
    archives.write(pages(spark, ODD_PAGES), place, segment_bytes=4000, roll_bytes=700, min_revisit_bytes=least)
    assert found(spark, place) == expected(ODD_PAGES, least)
    payloads = {(r.page_id, bytes(r.payload)) for r in archives.read(spark, place).filter("record_type = 'response'").collect()}
    assert {(i, (h or "").encode()) for i, _, h in ODD_PAGES} >= payloads and (1, ("long " * 300_000).encode()) in payloads
    known = {r.record_id for r in archives.read(spark, place).collect()}
    assert all(r.record_id in known for r in archives.read(spark, place).collect())


def test_same_files_however_dealt(spark):
    given = [(r.page_id, r.url, r.html) for r in table(spark, str(DATA / "sf0.001"), "pages").collect()]
    places = [folder(spark) for _ in range(2)]
    for place, parts in zip(places, (1, 7)):
        archives.write(pages(spark, given, parts), place, segment_bytes=100_000, roll_bytes=20_000)
    assert files(places[0]) == files(places[1]) and len(files(places[0])) > 4
    listed = archives.manifest(spark, places[0]).orderBy("name").collect()
    assert [r.name for r in listed] == sorted(files(places[0])) and {r.name: r.sha256 for r in listed} == files(places[0])
    assert sum(r.records for r in listed) == len(given)
    assert all(r.bytes <= 20_000 or r.records == 1 for r in listed)
    ids = [int(x.split(b": ")[1]) for n in sorted(files(places[0])) for x in gzip.open(f"{places[0]}/{n}").read().split(b"\r\n") if x.startswith(b"Page-Id: ")]
    assert ids == sorted(i for i, _, _ in given)
    assert not os.path.exists(f"{places[0]}/_temporary")


def test_manifest_is_what_counts(spark):
    place = folder(spark)
    archives.write(pages(spark, ODD_PAGES), place)
    with pytest.raises(FileExistsError):
        archives.write(pages(spark, ODD_PAGES), place)
    name = next(iter(files(place)))
    open(f"{place}/left-behind.warc.gz", "wb").write(b"not in the manifest")
    assert found(spark, place) == expected(ODD_PAGES)
    whole = open(f"{place}/{name}", "rb").read()
    for broken in (whole[:-20], whole[: len(whole) // 2] + b"?" + whole[len(whole) // 2 + 1 :]):
        open(f"{place}/{name}", "wb").write(broken)
        with pytest.raises(Exception):
            archives.read(spark, place).collect()


def test_nothing(spark):
    place = folder(spark)
    assert archives.write(pages(spark, []), place).count() == 0
    assert archives.read(spark, place).count() == 0


def test_many_equal_payloads(spark):
    given = [(i, f"http://h/{i}", "hot" if i % 3 else f"own {i}") for i in range(3000)]
    place = folder(spark)
    archives.write(pages(spark, given), place, segment_bytes=100_000)
    assert found(spark, place) == expected(given)


def test_payloads_are_not_read_to_find_the_first_ones(spark, tmp_path, monkeypatch):
    plans, whole = [], archives.with_first

    def seen(known, heads, min_bytes):
        plans.append(heads._jdf.queryExecution().optimizedPlan().toString())
        return whole(known, heads, min_bytes)

    monkeypatch.setattr(archives, "with_first", seen)
    pages = spark.createDataFrame([(1, "u", "<p>"), (2, "v", "<p>")], "page_id long, url string, html string")
    archives.write(pages, str(tmp_path / "w"))
    assert len(plans) == 1 and "sha1" not in plans[0].lower() and "html" not in plans[0]
    assert sorted((r.page_id, r.record_type) for r in archives.read(spark, str(tmp_path / "w")).collect()) == [(1, "response"), (2, "revisit")]
