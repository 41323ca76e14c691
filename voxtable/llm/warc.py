"""WARC archives: monolithic gzip files, normalised to one member a record with a sidecar index of offsets.

Writing: each row becomes a record; records with equal payloads of at least ``min_bytes`` bytes share one response, the others are
revisits of it. Spark writes the records as gzip-compressed text files, each of them one gzip stream over all its records. Such a file is
monolithic: no record can be reached without inflating all before it.

Normalising: a task inflates the stream of a file once, piece by piece, cuts it into records by their lengths, writes each record as a
gzip member of its own, and next to the archive an index with the offset and length of every member. Memory holds one record. A file is written under
a name of its attempt and renamed when it is whole, so a lost executor leaves no half archive behind; the same input gives the same bytes.

Reading: rows of the index are dealt in stretches of an archive; a task seeks to a member, inflates it alone, and checks its digest.

Archives lie in the shared folder. Tasks reach it by its URI through Arrow's file systems (local and mounted folders, HDFS, object stores).
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtable.llm import rows
from voxtable.llm.registry import query
from voxtable.session import fresh_path, staged

#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
END = "\r\n\r\n"
INDEX = "archive string, offset bigint, length bigint, record_id string, record_type string, page_id string, payload_bytes bigint, payload_digest string, refers_to string"
_PIECE = 1 << 20


def _located(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a URI as Spark gives it; a plain path is local."""
    if uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + unquote(uri[5:]).lstrip("/")
    return pa.fs.FileSystem.from_uri(uri)


def with_roles(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """``page_id``, ``url``, ``html``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.

    Of rows with equal payloads of at least ``min_bytes`` the largest ``page_id`` is the response and the others revisit it. Rows
    that repeat that id and payload are responses too. A null id revisits like any other; rows of null ids only are all responses.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    held = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumns({"payload_bytes": F.octet_length("html").cast("bigint"), "payload_digest": F.sha1(body.cast("binary"))})
    # A payload is known by its digest; groups are counted before the shuffle, and only those with copies meet the pages again.
    large = held.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("copies"))
    # Written first, so that its size is known: Spark sends it to the pages while it is below the session's broadcast threshold. Beyond
    # that both sides are shuffled, and a payload that many pages have is split (adaptive skew join).
    several = staged(large.where("copies > 1 AND kept IS NOT NULL").select("payload_digest", "kept"), "payloads")
    joined = held.join(several, "payload_digest", "left")
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return joined.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("kept")).alias("refers_to"))


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("-")), digest))
    return F.concat(F.lit("<urn:uuid:"), *[p for i, j in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for p in ([F.lit("-")] if i > 1 else []) + [F.substring(h, i, j)]], F.lit(">"))


def records(roles: DataFrame, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """One WARC record a row, as text, without its last line feed. Control characters and blanks of a URL are percent-encoded."""
    http = F.concat(F.lit(HTTP), F.col("payload_bytes").cast("string"), F.lit(END))
    response = F.col("record_type") == "response"
    # A revisit keeps the head of the response and leaves the payload out.
    block = F.concat(http, F.when(response, F.col("html")).otherwise(F.lit("")))
    url = encoded = F.coalesce("url", F.lit("urn:page:"))
    for c in [*range(0x21), 0x7F]:
        encoded = F.replace(encoded, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    url = F.when(url.rlike(r"[\x00-\x20\x7F]"), encoded).otherwise(url)
    page_id = F.col("page_id").cast("string")
    lines = [
        F.lit(VERSION), F.concat(F.lit("WARC-Type: "), "record_type"), F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("payload_digest"))),
        F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), url), F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_digest"),
        F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
        F.concat(F.lit("Page-ID: "), page_id),
        F.when(~response, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _record_id(F.col("refers_to"), F.col("payload_digest")), F.lit("\r\nRefers-To-Page-ID: "), F.col("refers_to").cast("string"))),
    ]
    return roles.select(F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block, F.lit("\r\n\r")).alias("value"))


def write_monolithic(lines: DataFrame, path: str, records_a_file: int = 50_000) -> None:
    """Gzip files of one stream each, written and committed by Spark; the line separator is a record's last line feed."""
    lines.write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", records_a_file).text(path)


class Stream:
    """Inflates a gzip stream, of one member or several, and hands out lines and byte counts; holds no more than is asked for."""

    def __init__(self, source) -> None:
        self.source, self.held, self.at = source, b"", 0
        self.inflate = zlib.decompressobj(31)
        self.raw = b""
        self.open = False  # inside of a member

    def _more(self) -> bool:
        while True:
            if self.inflate.eof:
                self.raw, self.inflate, self.open = self.inflate.unused_data, zlib.decompressobj(31), False
            elif self.inflate.unconsumed_tail:
                self.raw = self.inflate.unconsumed_tail
            if not self.raw:
                self.raw = self.source.read(_PIECE)
                if not self.raw and not self.open:
                    return False
                ended = not self.raw
            else:
                ended = False
            got = self.inflate.decompress(self.raw, _PIECE)
            self.raw, self.open = b"", True
            if ended and not got and not self.inflate.eof:
                raise ValueError("the gzip stream ends inside of a member")
            if got:
                self.held, self.at = self.held[self.at :] + got, 0
                return True

    def line(self) -> bytes | None:
        """The next line without its end; None behind the last one."""
        looked = self.at
        while (end := self.held.find(b"\n", looked)) < 0:
            looked = len(self.held) - self.at
            if not self._more():
                if self.at < len(self.held):
                    raise ValueError("the stream ends inside of a line")
                return None
        got, self.at = self.held[self.at : end], end + 1
        return got.removesuffix(b"\r")

    def take(self, size: int) -> bytes:
        parts, need = [], size
        while need:
            if self.at == len(self.held) and not self._more():
                raise ValueError("the stream ends inside of a record")
            parts.append(self.held[self.at : self.at + need])
            self.at += len(parts[-1])
            need -= len(parts[-1])
        return b"".join(parts)


def parsed(stream: Stream) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Each record's header fields (names lower-cased), its head as bytes, and its block."""
    while (first := stream.line()) is not None:
        if not first:
            continue
        if not re.fullmatch(rb"WARC/\d\.\d", first):
            raise ValueError(f"no WARC record begins with {first[:40]!r}")
        head, fields = [first], {}
        while line := stream.line():
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
            head.append(line)
        yield fields, b"\r\n".join(head) + b"\r\n\r\n", stream.take(int(fields["content-length"]))


def _entry(archive: str, offset: int, length: int, fields: dict[str, str], block: bytes) -> dict:
    told = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", block.partition(b"\r\n\r\n")[0])
    return {
        "archive": archive, "offset": offset, "length": length, "record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "page_id": fields.get("page-id"),
        "payload_bytes": int(told[1]) if told else None, "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, "refers_to": fields.get("refers-to-page-id")}


def normalise_file(source, sink: Callable[[str], object], archive: str, level: int = 6) -> int:
    """Rewrite one archive as one gzip member a record and write its index; the number of records."""
    count = offset = 0
    with sink(".warc.gz") as out, sink(".index.json") as index:
        for fields, head, block in parsed(Stream(source)):
            member = gzip.compress(head + block + b"\r\n\r\n", level, mtime=0)
            out.write(member)
            index.write(json.dumps(_entry(archive, offset, len(member), fields, block)).encode() + b"\n")
            offset += len(member)
            count += 1
    return count


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Normalise every archive below ``source`` into ``target``; ``source`` (file) and ``records`` of each. Runs at once."""
    _, folder = _located(target)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path", "length")  # contents are not read

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                # Named by the file's name below the folder, so that every attempt ends at the same names.
                name = re.sub(r"\.gz$", "", path.rsplit("/", 1)[-1]).removesuffix(".txt").removesuffix(".warc")
                files, place = _located(path)
                out, base = _located(f"{target.rstrip('/')}/{name}")
                attempt = f"{base}.attempt-{TaskContext.get().taskAttemptId()}"
                out.create_dir(base.rsplit("/", 1)[0], recursive=True)
                with files.open_input_stream(place, compression=None) as stream:
                    n = normalise_file(stream, lambda end: out.open_output_stream(attempt + end, compression=None), f"{target.rstrip('/')}/{name}.warc.gz")
                for end in (".warc.gz", ".index.json"):  # the index comes last: what it lists is there
                    out.move(attempt + end, base + end)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["source", "records"])

    # A file a task: paths are few bytes, so a plain shuffle of them would be put into one task.
    dealt = found.select("path").repartitionByRange(max(1, found.count()), "path")
    return staged(dealt.mapInArrow(work, "source string, records bigint"), "normalised")


def index_of(spark: SparkSession, target: str) -> DataFrame:
    """The sidecar indexes below ``target``, one row a record."""
    return spark.read.schema(INDEX).option("pathGlobFilter", "*.index.json").json(target)


def read_back(index: DataFrame, stretch: int = 1 << 26) -> DataFrame:
    """The index with ``payload`` (binary, empty for a revisit), each record read by its own offset and length.

    A record that is not the one its index names, or a response whose payload is not that of its digest, is an error.
    """
    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, 2 * size // stretch)
    dealt = index.withColumn("__stretch", F.floor(F.col("offset") / stretch)).repartition(tasks, "archive", "__stretch").sortWithinPartitions("archive", "offset").drop("__stretch")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, name = None, None
        try:
            for batch in batches:
                payloads, held, since = [], 0, 0
                for at, row in enumerate(batch.select(["archive", "offset", "length", "record_id", "record_type", "payload_digest"]).to_pylist()):
                    if row["archive"] != name:
                        if open_ is not None:
                            open_.close()
                        files, place = _located(row["archive"])
                        open_, name = files.open_input_file(place), row["archive"]
                    open_.seek(row["offset"])
                    (fields, _, block), = parsed(Stream(pa.BufferReader(open_.read(row["length"]))))
                    payload = block.partition(b"\r\n\r\n")[2]
                    if fields.get("warc-record-id") != row["record_id"]:
                        raise ValueError(f"{name} holds another record at {row['offset']}")
                    if row["record_type"] == "response" and hashlib.sha1(payload).hexdigest() != row["payload_digest"]:
                        raise ValueError(f"payload of {row['record_id']} is not that of its digest")
                    payloads.append(payload)
                    held += len(payload)
                    if held > 1 << 23:
                        yield rows.with_columns(batch.slice(since, at + 1 - since), batch.schema.names, payload=pa.array(payloads, pa.binary()))
                        payloads, held, since = [], 0, at + 1
                yield rows.with_columns(batch.slice(since), batch.schema.names, payload=pa.array(payloads, pa.binary()))
        finally:
            if open_ is not None:
                open_.close()

    return dealt.mapInArrow(work, rows.widened(index, payload="binary"))


def archived(pages: DataFrame, *, min_bytes: int = 1000, records_a_file: int = 50_000) -> DataFrame:
    """Write ``pages`` to monolithic archives, normalise them, and read every record back (see :func:`read_back`).

    Null and empty ``html`` are empty payloads, a null ``url`` is ``urn:page:``, every row is a record. Only ``page_id``, ``url`` and
    ``html`` are read, so other columns may have any name. ``page_id`` and ``refers_to`` come back as text. No pages: no records.
    """
    spark = pages.sparkSession
    whole, single = fresh_path(spark, "monolithic"), fresh_path(spark, "warc")
    write_monolithic(records(with_roles(pages, min_bytes)), whole, records_a_file)
    done = normalise(spark, whole, single)
    if done.isEmpty():
        return read_back(spark.createDataFrame([], INDEX))
    return read_back(index_of(spark, single))


SQL = """
SELECT page_id, strlen(p) AS payload_bytes, sha1(p) AS payload_digest, CASE WHEN page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM (SELECT page_id, p, CASE WHEN strlen(p) >= 1000 THEN max(page_id) OVER (PARTITION BY p) ELSE page_id END AS kept
  FROM (SELECT page_id, coalesce(html, '') AS p FROM pages))
"""


@query("op13_warc_archives", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = archived(rows.table(spark, sf_dir, "pages"))
    size = F.when(F.col("record_type") == "response", F.octet_length("payload").cast("bigint")).otherwise(F.col("payload_bytes"))
    return back.select(F.col("page_id").cast("bigint").alias("page_id"), size.alias("payload_bytes"), "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to"))
