"""WARC archives as a PySpark data source, and page archives with revisit records.

Reading plans one partition per bounded group of files.  Filters on header columns are pushed into the scan: a record's
headers are parsed first, and where they don't match, or no payload is asked for, the reader moves on by the record's
length without decoding the rest.  Compressed records are gzip members whose extra field ``sl`` holds the compressed
and the plain length, so they are passed over as well; members without it are decoded to find their end.

Writing rolls files at a size; each commit lists the files of the tasks that succeeded, and a reader of the folder reads
what the commits list, so a task may be lost and run again, and a second write adds to the first (or replaces it, if it
overwrites).

Defined results: null payloads are empty; repeated pages keep records of their own; every page that has its payload's
smallest page_id is a response; a null page_id never stands for others and its page is always a response; an empty table
gives an archive without records; columns but page_id, url and html are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from taplight.llm.common import filesystem, shared_dir, small_batches, table

FILE_BYTES, PARTITION_BYTES, BATCH_BYTES = 32 << 20, 64 << 20, 8 << 20
#: Payloads of fewer bytes are stored again rather than revisited.
REVISIT_BYTES = 100
SCHEMA = "record_id string, record_type string, target_uri string, date string, content_length long, payload_length long, payload_digest string, refers_to string, headers map<string,string>, payload binary"
HEADER_OF = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
#: A commit lists its files under a name that begins so.
FILES = "_files-"


# -- records -------------------------------------------------------------------------------------------------------


def record(headers: dict[str, str], body: bytes, compress: bool) -> bytes:
    """A record's bytes: version, headers, block and the two empty lines; a gzip member of its own if compressed."""
    lines = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in headers.items())
    plain = f"WARC/1.1\r\n{lines}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    if not compress:
        return plain
    packer = zlib.compressobj(4, zlib.DEFLATED, -15)
    packed = packer.compress(plain) + packer.flush()
    size = 10 + 2 + 12 + len(packed) + 8
    extra = b"sl" + struct.pack("<HII", 8, size, len(plain)) if max(size, len(plain)) < 1 << 32 else b""
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + packed + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def http_response(payload: bytes | None, length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode() + (payload or b"")


def parse_headers(head: bytes) -> dict[str, str]:
    """Named fields in lower case; a folded line continues the one before."""
    fields: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
    return fields


class _Member:
    """Plain bytes of the record at ``at``, decoded no further than asked."""

    STEP = 16 << 10

    def __init__(self, file, at: int, size: int) -> None:
        self.file, self.at, self.size = file, at, size
        first = file.read_at(min(self.STEP, size - at), at)
        self.packed = first[:2] == b"\x1f\x8b"
        self.plain, self.read, self.next_at = b"", at + len(first), None
        if self.packed:
            if first[3] & 4 and first[12:14] == b"sl" and struct.unpack_from("<H", first, 14)[0] == 8:
                self.next_at = at + struct.unpack_from("<I", first, 16)[0]
            self.decoder = zlib.decompressobj(31)
            self.plain = self.decoder.decompress(first)
        else:
            self.plain = first

    def more(self) -> bool:
        if self.read >= self.size or (self.packed and self.decoder.eof):
            return False
        data = self.file.read_at(min(self.STEP * 4, self.size - self.read), self.read)
        self.read += len(data)
        self.plain += self.decoder.decompress(data) if self.packed else data
        return True

    def head(self) -> tuple[dict[str, str], int]:
        """The record's fields and where its block begins."""
        while (end := self.plain.find(b"\r\n\r\n")) < 0:
            if not self.more():
                raise ValueError(f"a record's headers are cut off at byte {self.at}")
        return parse_headers(self.plain[:end]), end + 4

    def block(self, start: int, n: int) -> bytes:
        if not self.packed and len(self.plain) < start + n:
            missing = start + n - len(self.plain)
            self.plain += self.file.read_at(missing, self.read)
            self.read += missing
        while len(self.plain) < start + n and self.more():
            pass
        if len(self.plain) < start + n:
            raise ValueError(f"a record's block is cut off at byte {self.at}")
        return self.plain[start : start + n]

    def block_until(self, start: int, n: int, mark: bytes) -> bytes:
        """The block up to the mark and perhaps beyond, or all of it."""
        size = 4096
        while mark not in (found := self.block(start, min(n, size))) and size < n:
            size *= 4
        return found

    def end(self, start: int, n: int) -> int:
        """Where the next record begins."""
        if self.next_at is not None:
            return self.next_at
        if not self.packed:
            return self.at + start + n + 4
        while not self.decoder.eof and self.more():
            self.plain = b""
        return self.read - len(self.decoder.unused_data)


def records(file, wanted, payload: bool) -> Iterator[tuple]:
    """Rows of SCHEMA for the records whose headers are ``wanted``."""
    at, size = 0, file.size()
    while at < size:
        member = _Member(file, at, size)
        fields, start = member.head()
        n = int(fields.get("content-length", 0))
        if wanted(fields):
            kind, block, length = fields.get("warc-type"), None, None
            is_http = fields.get("content-type", "").startswith("application/http")
            if payload and kind != "revisit":
                block = member.block(start, n)
            elif is_http:
                block = member.block_until(start, n, b"\r\n\r\n")
            if is_http and block is not None:
                head, _, block = block.partition(b"\r\n\r\n")
                length = int(parse_headers(head + b"\r\n").get("content-length", len(block)))
            body = block if payload and kind != "revisit" else None
            yield (*(fields.get(HEADER_OF[c]) for c in ("record_id", "record_type", "target_uri", "date")), n, length if length is not None else n, fields.get("warc-payload-digest"), fields.get("warc-refers-to"), fields, body)
        at = member.end(start, n)


# -- the data source -----------------------------------------------------------------------------------------------


def manifests(fs: pafs.FileSystem, base: str) -> list[str]:
    """The lists of files that commits have left in a folder, one each."""
    if fs.get_file_info(base).type != pafs.FileType.Directory:
        return []
    found = fs.get_file_info(pafs.FileSelector(base))
    return sorted(x.path for x in found if x.base_name.startswith(FILES) and x.base_name.endswith(".json"))


@dataclass
class _Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.predicates: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take what header fields decide; Spark evaluates the rest."""
        for f in filters:
            name = HEADER_OF.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if name and isinstance(f, EqualTo):
                self.predicates.append((name, "in", (f.value,)))
            elif name and isinstance(f, In):
                self.predicates.append((name, "in", tuple(f.value)))
            elif name and isinstance(f, StringStartsWith):
                self.predicates.append((name, "prefix", (f.value,)))
            elif name and isinstance(f, IsNotNull):
                self.predicates.append((name, "present", ()))
            else:
                yield f

    def _wanted(self, fields: dict[str, str]) -> bool:
        for name, kind, values in self.predicates:
            value = fields.get(name)
            if value is None or (kind == "in" and value not in values) or (kind == "prefix" and not value.startswith(values[0])):
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        fs, base = filesystem(self.path)
        if lists := manifests(fs, base):
            files = []
            for path in lists:
                with fs.open_input_stream(path) as f:
                    files += [(f"{base}/{name}", n) for name, n in json.loads(f.read())]
        elif (info := fs.get_file_info(base)).type == pafs.FileType.File:
            files = [(base, info.size)]
        else:
            found = fs.get_file_info(pafs.FileSelector(base, recursive=True))
            files = sorted((x.path, x.size) for x in found if x.path.endswith((".warc", ".warc.gz")))
        out: list[InputPartition] = []
        held: list[str] = []
        total = 0
        for path, n in files:
            if held and total + n > PARTITION_BYTES // 4:
                out.append(_Files(held))
                held, total = [], 0
            held.append(path)
            total += n
        return [*out, _Files(held)] if held or not out else out

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.path)
        rows: list[tuple] = []
        size = 0
        for path in partition.paths:
            with fs.open_input_file(path) as file:
                for row in records(file, self._wanted, self.payload):
                    rows.append(row)
                    size += 400 + len(row[-1] or b"")
                    if size >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)


_KINDS = [pa.string()] * 4 + [pa.int64()] * 2 + [pa.string()] * 2 + [pa.map_(pa.string(), pa.string()), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = [list(c) for c in zip(*rows, strict=True)]
    cols[8] = [list(x.items()) for x in cols[8]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceArrowWriter):
    """Rows of (record_id, record_type, target_uri, date, payload_length, payload_digest, refers_to, payload)."""

    def __init__(self, options: dict[str, str], overwrite: bool = False) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.compress = options.get("compression", "gzip") == "gzip"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, base = filesystem(self.path)
        fs.create_dir(base)
        done: list[tuple[str, int]] = []
        held: list[bytes] = []
        size = 0

        def close() -> None:
            name = f"part-{uuid.uuid4().hex}.warc{'.gz' * self.compress}"
            with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
                for data in held:
                    f.write(data)
            done.append((name, size))

        for batch in iterator:
            for row in batch.to_pylist():
                if not held:
                    held = [record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": row["date"] or "", "Content-Type": "application/warc-fields"}, b"software: taplight\r\n", self.compress)]
                    size = len(held[0])
                held.append(self._record(row))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    close()
                    held, size = [], 0
        if held:
            close()
        return _Written(done)

    def _record(self, row: dict) -> bytes:
        names = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "date": "WARC-Date", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
        headers = {h: row[c] for c, h in names.items() if row[c] is not None}
        headers["Content-Type"] = "application/http; msgtype=response"
        if row["record_type"] == "revisit":
            headers["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        return record(headers, http_response(row["payload"], row["payload_length"]), self.compress)

    def commit(self, messages: list[WarcWriter | None]) -> None:
        """List the files of this write, beside those of earlier ones unless it overwrites them."""
        fs, base = filesystem(self.path)
        fs.create_dir(base)
        before = manifests(fs, base) if self.overwrite else []
        files = sorted(x for m in messages if m for x in m.files)
        with fs.open_output_stream(f"{base}/{FILES}{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(files).encode())
        for path in before:
            fs.delete_file(path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Files that no commit lists are never read."""


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options, overwrite)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of an archive, a folder of archives or a written folder."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


# -- page archives -------------------------------------------------------------------------------------------------


def archive(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", compression: str = "gzip", mode: str = "append") -> None:
    """A record per page: the first of equal payloads (of REVISIT_BYTES or more) is the response that others revisit."""
    spark = pages.sparkSession
    small_batches(spark)
    spark.dataSource.register(WarcSource)
    body = F.encode(F.coalesce(pages["html"], F.lit("")), "utf-8")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("target_uri"), body.alias("body"))
    rows = rows.withColumn("payload_digest", F.sha2("body", 256)).withColumn("payload_length", F.octet_length("body").cast("long"))
    firsts = rows.where(F.col("payload_length") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("page_id").alias("pages")).where("pages > 1").drop("pages")
    revisits = F.col("page_id") != F.col("first_id")
    urn = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">")))
    out = rows.join(firsts, "payload_digest", "left").select(
        F.coalesce(urn("page_id"), F.lit("<urn:page:none>")).alias("record_id"),
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.lit(date).alias("date"),
        "payload_length",
        F.concat(F.lit("sha256:"), "payload_digest").alias("payload_digest"),
        F.when(revisits, urn("first_id")).alias("refers_to"),
        F.when(F.coalesce(revisits, F.lit(False)), None).otherwise(F.col("body")).alias("payload"),
    )
    out.write.format("warc").mode(mode).option("compression", compression).save(path)


def _payload_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = batch.column("payload").to_pylist()
        cols = [batch.column("record_id"), pa.array([len(p) for p in payloads], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in payloads])]
        yield pa.RecordBatch.from_arrays(cols, ["record_id", "payload_bytes", "payload_digest"])


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """What the archive says of each page; a response's length and digest are those of the payload read back."""
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)")
    responses = read_warc(spark, path).where("record_type = 'response'").select("record_id", "payload").mapInArrow(_payload_digests, "record_id string, payload_bytes long, payload_digest string")
    revisits = read_warc(spark, path, payload=False).where("record_type = 'revisit'")
    return responses.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(
        revisits.select(page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))
    )


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    path = shared_dir(spark, "warc")
    archive(table(spark, sf_dir, "pages"), path)
    return page_records(spark, path)


OP9_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN d.page_id <> f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN d.page_id <> f.first_id THEN f.first_id END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest
"""
