"""Operator 1: WARC archives as a Spark data source, ``spark.read.format("warc")``.

Every record is a gzip member of its own, whose extra field ``sl`` holds the member's length and
that of its content; so a reader inflates the headers of a record alone, and goes on to the next
record without reading a payload nobody wants. Plain archives and members without ``sl`` are read
as well. Scans plan one partition a file, and writers begin a new file after ``ROLL`` bytes.
Filters (equal, in, and ranges of page_id) on record_type, target_uri, page_id and payload_digest
are tested on the headers (``spark.sql.python.filterPushdown.enabled``); the payload is read, and
its check sum tested, if the schema has it. An archive that ends inside a record, or a record
that is shorter than it says, is an error that names the place; option ``mode`` DROPMALFORMED
leaves such records out instead. Copies of one payload meet by digest in a join that adaptive
execution splits where they are many.

Writers write under a name of the attempt; the commit renames the files of successful tasks.

Defined results: null payloads are empty; null ids and addresses have no header and come back as
null; control characters in addresses are percent-encoded. Equal rows are equal records. An empty
table writes no file and reads as no rows. Of further columns nothing is written.
"""

from __future__ import annotations

import operator
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from hodos.llm.common import table
from hodos.session import scratch

SCHEMA = "record_type string, target_uri string, page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary"
ROLL = 1 << 26
#: Payloads from this size on are written once.
LEAST = 100
FILTERED = {"record_type", "target_uri", "page_id", "payload_digest"}
COMPARED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
#: Bytes read at once.
PIECE = 4_096


def record(row: dict) -> bytes:
    """One record as bytes: headers, blank line, payload, two line ends."""
    heads = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<urn:page:{row['page_id']}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if row["target_uri"] is not None:
        heads.append(("WARC-Target-URI", "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in row["target_uri"])))
    if row["record_type"] == "revisit":
        heads += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{row['refers_to']}>"), ("X-Refers-To-Page", row["refers_to"])]
    body = b"" if row["record_type"] == "revisit" else row["payload"] or b""
    heads += [("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"), ("X-Payload-Length", row["payload_bytes"]), ("X-Page", row["page_id"]), ("Content-Type", "text/html"), ("Content-Length", len(body))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads if v is not None) + "\r\n").encode() + body + b"\r\n\r\n"


def member(content: bytes) -> bytes:
    """``content`` as a gzip member that names its own length."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(content) + deflate.flush()
    whole = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, whole, len(content))
    return head + body + struct.pack("<II", zlib.crc32(content), len(content) & 0xFFFFFFFF)


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if ":" in x)}


def _parsed(heads: dict[str, str]) -> dict:
    number = lambda k: int(heads[k]) if k in heads else None
    digest = heads.get("warc-payload-digest", "").partition(":")[2] or None
    return {"record_type": heads.get("warc-type"), "target_uri": heads.get("warc-target-uri"), "page_id": number("x-page"), "refers_to": number("x-refers-to-page"), "payload_bytes": number("x-payload-length"), "payload_digest": digest}


class DamagedArchive(ValueError):
    """An archive that ends inside a record, or holds something else than its record says."""


class _Member:
    """A gzip member, inflated as far as it is asked for; its check sum is tested at its end."""

    def __init__(self, source, at: int, left: int):
        self.source, self.at, self.left, self.taken = source, at, left, 0
        self.inflate, self.content = zlib.decompressobj(31), bytearray()
        source.seek(at)

    def more(self) -> bool:
        """Inflates a further piece; False at the end of the member."""
        if self.inflate.eof:
            return False
        piece = self.inflate.unconsumed_tail
        if not piece:
            piece = self.source.read(min(PIECE, self.left - self.taken))
            self.taken += len(piece)
        try:
            found = self.inflate.decompress(piece, 1 << 20)
        except zlib.error as error:
            raise DamagedArchive(f"the member at byte {self.at} cannot be inflated: {error}") from error
        if not piece and not found and not self.inflate.eof:
            raise DamagedArchive(f"the archive ends inside the member at byte {self.at}")
        self.content += found
        return True

    def headers(self) -> int:
        """Where the headers end."""
        seen = 0
        while (end := self.content.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(self.content)
            if not self.more():
                raise DamagedArchive(f"the record at byte {self.at} has no end of headers")
        return end

    def rest(self) -> int:
        """The length of the member, which is inflated to its end."""
        while self.more():
            pass
        return self.taken - len(self.inflate.unused_data)


def _payload(content, at: int, end: int, heads: dict[str, str]) -> bytes:
    length = int(heads.get("content-length", 0))
    if len(content) < end + 4 + length:
        raise DamagedArchive(f"the record at byte {at} holds {max(0, len(content) - end - 4)} of {length} bytes")
    return bytes(content[end + 4 : end + 4 + length])


def records(source, wanted, payload: bool, drop: bool = False) -> Iterator[dict]:
    """The records of an open archive whose parsed headers ``wanted`` accepts. What is damaged
    raises DamagedArchive or, with ``drop``, is left out: an own member alone, as the place of
    the next is known, otherwise all that follows. Check sums of payloads not asked for are not
    looked at."""
    at, size = 0, source.size()
    while at < size:
        following = None
        try:
            source.seek(at)
            start = source.read(min(PIECE, size - at))
            if start[:2] != b"\x1f\x8b":  # plain
                if not start.strip():
                    at += len(start)
                    continue
                while b"\r\n\r\n" not in start and at + len(start) < size:
                    start += source.read(1 << 16)
                end = start.find(b"\r\n\r\n")
                if end < 0:
                    raise DamagedArchive(f"the record at byte {at} has no end of headers")
                heads = _headers(start[:end])
                length = int(heads.get("content-length", 0))
                if at + end + 4 + length > size:
                    raise DamagedArchive(f"the archive ends inside the record at byte {at}")
                following = at + end + 4 + length + 4
                row = _parsed(heads)
                if wanted(row):
                    if payload:
                        source.seek(at + end + 4)
                        row["payload"] = source.read(length)
                    yield row
                at = following
                continue
            named = len(start) >= 24 and start[3] == 4 and start[12:14] == b"sl"
            if named:
                following = at + struct.unpack_from("<I", start, 16)[0]
                if not at < following <= size:
                    following = None
                    raise DamagedArchive(f"the archive ends inside the member at byte {at}")
            member = _Member(source, at, (following or size) - at)
            end = member.headers()
            heads = _headers(bytes(member.content[:end]))
            row = _parsed(heads)
            taken = wanted(row)
            if not named or (taken and payload):
                length = member.rest()
                following = following or at + length
            if taken:
                if payload:
                    row["payload"] = _payload(member.content, at, end, heads)
                yield row
            at = following
        except DamagedArchive:
            if not drop:
                raise
            if following is None:
                return
            at = following


@dataclass
class Archive(InputPartition):
    path: str

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


@dataclass
class Written(WriterCommitMessage):
    files: list = field(default_factory=list)


class WarcReader(DataSourceReader):
    def __init__(self, folder: str, columns: list[str], schema: pa.Schema, drop: bool = False):
        self.folder, self.columns, self.schema, self.drop, self.tests = folder, columns, schema, drop, []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            known = len(getattr(f, "attribute", ())) == 1 and f.attribute[0] in FILTERED
            if known and isinstance(f, In):
                self.tests.append((f.attribute[0], operator.contains, frozenset(f.value)))
            elif known and type(f) in COMPARED and (isinstance(f, EqualTo) or f.attribute[0] == "page_id"):
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def wanted(self, row: dict) -> bool:
        return all(row[c] is not None and (row[c] in value if test is operator.contains else COMPARED[test](row[c], value)) for c, test, value in self.tests)

    def partitions(self):
        files, base = fs.FileSystem.from_uri(self.folder)
        found = files.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        return [Archive(f.path) for f in sorted(found, key=lambda f: f.path) if f.path.endswith((".warc", ".warc.gz"))]

    def read(self, partition):
        if partition is None:
            return
        files, _ = fs.FileSystem.from_uri(self.folder)
        rows, held = [], 0
        with files.open_input_file(partition.path) as source:
            for row in records(source, self.wanted, "payload" in self.columns, self.drop):
                rows.append(row)
                held += len(row.get("payload") or b"") + 200
                if held > 1 << 23:
                    yield pa.RecordBatch.from_pylist(rows, self.schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, self.schema)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator):
        files, base = fs.FileSystem.from_uri(self.folder)
        files.create_dir(base, recursive=True)
        task = TaskContext.get()
        names, out, held = [], None, ROLL
        for batch in iterator:
            for row in batch.to_pylist():
                if held >= ROLL:
                    if out is not None:
                        out.close()
                    names.append(f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(names):04d}.warc.gz")
                    out, held = files.open_output_stream(f"{base}/{names[-1]}.writing", compression=None), 0
                held += out.write(member(record(row)))
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages):
        files, base = fs.FileSystem.from_uri(self.folder)
        for name in (n for m in messages if m is not None for n in m.files):
            files.move(f"{base}/{name}.writing", f"{base}/{name}")

    def abort(self, messages):
        files, base = fs.FileSystem.from_uri(self.folder)
        for name in (n for m in messages if m is not None for n in m.files):
            files.delete_file(f"{base}/{name}.writing")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        from pyspark.sql.pandas.types import to_arrow_schema

        mode = self.options.get("mode", "FAILFAST").upper()
        if mode not in ("FAILFAST", "DROPMALFORMED"):
            raise ValueError(f"mode is FAILFAST or DROPMALFORMED, not {mode}")
        return WarcReader(self.options["path"], schema.names, to_arrow_schema(schema), mode == "DROPMALFORMED")

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"])


def archived(pages: DataFrame, folder: str) -> None:
    """Writes a record of every row of ``pages`` (page_id, url, html) below ``folder``: of equal
    payloads of ``LEAST`` bytes or more the one of the smallest id whole, the others as revisits.
    Repeated rows of that id are all whole; rows without an id are whole only if no equal has one."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.length("payload").cast("long"))
    firsts = rows.filter(F.col("payload_bytes") >= LEAST).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("times"))
    firsts = firsts.filter((F.col("times") > 1) & F.col("first").isNotNull()).select(F.col("payload_digest").alias("twice"), "first")
    # short payloads match nothing; a key of their own keeps them from meeting in one task
    key = F.when(F.col("payload_bytes") >= LEAST, F.col("payload_digest")).otherwise(F.xxhash64("page_id", "target_uri").cast("string"))
    met = rows.withColumn("key", key).join(firsts, F.col("key") == F.col("twice"), "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    out = met.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri", "page_id", F.when(again, F.col("first")).alias("refers_to"),
        "payload_bytes", "payload_digest", F.when(~again, F.col("payload")).alias("payload"),
    )
    out.write.format("warc").mode("append").save(folder)


def read_archives(spark: SparkSession, folder: str, schema: str = SCHEMA) -> DataFrame:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").schema(schema).load(folder)


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from
    the archives; those of responses are taken from the payload read back."""
    folder = scratch(spark, "warc")
    archived(table(spark, sf_dir, "pages"), folder)
    back = read_archives(spark, folder)
    whole = F.col("record_type") == "response"
    return back.select(
        "page_id", F.when(whole, F.length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to",
    )


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE octet_length(b) >= 100 GROUP BY h)
SELECT page_id, octet_length(b) AS payload_bytes, sha256(p.h) AS payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.h = f.h
"""
