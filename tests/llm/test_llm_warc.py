import gzip
import hashlib
import io
import json
import zlib
from pathlib import Path

import pytest
from compare import connect, difference

from voxtable.llm import rows, warc
from voxtable.session import fresh_path

SF = "/root/testdata/sf0.001"
BIG = "<p>" + "x" * 2000


def brute(pages, least=1000):
    kept = {}
    for page_id, html in pages:
        p = (html or "").encode()
        if len(p) >= least and page_id is not None:
            kept[p] = max(kept.get(p, page_id), page_id)
    out = []
    for page_id, html in pages:
        p = (html or "").encode()
        to = kept.get(p, page_id)
        revisit = to is not None and page_id != to
        out.append((page_id, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=repr)


def result(df):
    got = df.collect()
    for r in got:
        assert r["payload"] == b"" or r["record_type"] == "response"
    number = lambda x: None if x is None else int(x)
    return sorted(((number(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], number(r["refers_to"])) for r in got), key=repr)


PAGES = [
    (1, "u1", BIG), (2, "u2", BIG), (7, "u 7\r\nX: y", BIG), (3, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (8, "u", "é" * 500), (9, "u", "é" * 500),
    (10, "u", "é" * 499), (11, "u", "é" * 499), (12, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 40), (13, "u", "a\0b\n\r\n\n"), (None, "u", BIG), (None, "u", "only null " * 200), (None, "u", "only null " * 200),
    (14, "u", "tail " * 300), (14, "u", "tail " * 300), (15, "u", "long " * 1_000_000),
]


def test_against_brute_force(spark):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").repartition(3)
    extra = df.selectExpr("*", *[f"concat('{c}', coalesce(page_id, 0)) AS {c}" for c in ("payload", "archive", "offset", "kept", "payload_digest", "record_type", "value")])
    want = brute([(i, h) for i, _, h in PAGES])
    assert result(warc.archived(df)) == want == result(warc.archived(extra, records_a_file=2))
    assert result(warc.archived(df, min_bytes=0)) == brute([(i, h) for i, _, h in PAGES], 0)
    assert result(warc.archived(df.where("false"))) == []


def test_same_rows_as_sql(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        assert difference(warc.op13(spark, sf), connect(sf), warc.SQL) is None


def test_files_are_normalised(spark):
    """Before: one gzip member a file. After: one a record, each readable by its offset alone, all readable as one stream."""
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").repartition(2)
    whole, single = fresh_path(spark, "monolithic"), fresh_path(spark, "warc")
    warc.write_monolithic(warc.records(warc.with_roles(df)), whole)
    raw = {p.name: p.read_bytes() for p in Path(whole.removeprefix("file:")).glob("*.gz")}
    for data in raw.values():
        one = zlib.decompressobj(31)
        one.decompress(data)
        assert one.eof and not one.unused_data
    done = warc.normalise(spark, whole, single)
    assert done.count() == len(raw) and done.groupBy().sum("records").first()[0] == len(PAGES)
    assert not [p for p in Path(single).iterdir() if "attempt" in p.name]
    for name, data in raw.items():
        stem = name.removesuffix(".txt.gz")
        archive = Path(single, f"{stem}.warc.gz").read_bytes()
        assert gzip.decompress(archive) == gzip.decompress(data)
        entries = [json.loads(x) for x in Path(single, f"{stem}.index.json").read_text().splitlines()]
        assert [e["offset"] for e in entries] == [0, *[e["offset"] + e["length"] for e in entries[:-1]]]
        assert sum(e["length"] for e in entries) == len(archive)
        for e in entries:
            record = gzip.decompress(archive[e["offset"] : e["offset"] + e["length"]])
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and f"WARC-Record-ID: {e['record_id']}".encode() in record
            assert b"u%207%0D%0AX:%20y" in record or e["page_id"] != "7"
    # Twice normalised gives the same bytes: members are read like one stream.
    again = fresh_path(spark, "warc")
    warc.normalise(spark, single, again)
    for p in Path(single).glob("*.warc.gz"):
        assert Path(again, p.name).read_bytes() == p.read_bytes()


def test_broken_archives():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    packed = gzip.compress(record * 3)
    assert [b for _, _, b in warc.parsed(warc.Stream(io.BytesIO(packed)))] == [b"hello"] * 3
    for bad in (packed[:-12], gzip.compress(record[:-7]), gzip.compress(b"WARC/1.1\r\nWARC-Ty"), gzip.compress(b"HTTP/1.1 200\r\n\r\n")):
        with pytest.raises(ValueError):
            list(warc.parsed(warc.Stream(io.BytesIO(bad))))


def test_wrong_record_is_an_error(spark):
    df = spark.createDataFrame(PAGES[:5], "page_id bigint, url string, html string").coalesce(1)
    whole, single = fresh_path(spark, "monolithic"), fresh_path(spark, "warc")
    warc.write_monolithic(warc.records(warc.with_roles(df)), whole)
    warc.normalise(spark, whole, single)
    for change in ("'<urn:uuid:0>' AS record_id", "CASE WHEN record_type = 'response' THEN 'ff' END AS payload_digest"):
        name = change.split()[-1]
        wrong = warc.index_of(spark, single).selectExpr(*[change if c == name else c for c in (f.split(" ")[0] for f in warc.INDEX.split(", "))])
        with pytest.raises(Exception, match="another record|not that of its digest"):
            warc.read_back(wrong).collect()
