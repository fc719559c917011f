"""WARC records in ZIP-packaged archives: written by tasks, read back by byte ranges.

An archive is a ZIP whose members are stored: ``archive/data.warc.gz`` with one gzip member per
record, and ``indexes/index.cdx`` with a line per record (offset, length, record id). A reader
finds both through the central directory and fetches records by range; nothing is extracted.

Archives lie in a folder that all executors reach, addressed by any URI that Arrow's file
systems know. A task writes under a name of its own and reports it only when the file is
complete, so a lost executor leaves at most files that no list names.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zipfile
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardwarden.llm.common import SLICE, batch_column, quoted, written
from cardwarden.llm.zipped import data_start, members, read_range
from cardwarden.session import scratch_path

#: Payloads from this size on are replaced by revisits when they repeat.
REVISIT_FROM = 1000
#: A task begins a new archive after so many bytes of records.
ARCHIVE_BYTES = 256 << 20
#: Records fetched by one range read, and by one task.
RANGE_BYTES = 4 << 20
TASK_BYTES = 64 << 20

_DATA, _INDEX = "archive/data.warc.gz", "indexes/index.cdx"

ARCHIVES = T.StructType([T.StructField("archive", T.StringType()), T.StructField("records", T.LongType()),
                         T.StructField("bytes", T.LongType())])
RECORDS = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("target_uri", T.StringType()), T.StructField("refers_to", T.StringType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload", T.BinaryType())])


def with_originals(pages: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """Adds ``original``: the largest key among the rows with an equal payload of ``least`` bytes
    or more if that is another row's key, else null.

    Input: ``key, uri, payload, digest, n``. Payloads are equal when SHA-1 and length are. Rows
    that share the largest key are all originals; null keys are below any other.
    """
    repeated = written(
        pages.filter(F.col("n") >= least).groupBy("digest", "n")
        .agg(F.max("key").alias("original"), F.count("*").alias("copies"))
        .filter("copies > 1").select("digest", "n", "original"), "originals")
    return pages.join(repeated, ["digest", "n"], "left").withColumn(
        "original", F.when(~F.col("key").eqNullSafe(F.col("original")), F.col("original")))


def _record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [f"{name}: {value}" for name, value in headers if value is not None]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""])
    return head.encode() + block + b"\r\n\r\n"


def encode_record(key, uri: str | None, payload: bytes, digest: str, original,
                  date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response with its payload, or a revisit with the response's HTTP head alone."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    revisit = original is not None
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _urn(key)), ("WARC-Date", date),
        ("WARC-Target-URI", None if uri is None else re.sub(r"[\r\n]+", " ", uri)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("WARC-Refers-To", _urn(original) if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return _record(headers, http if revisit else http + payload)


def _urn(key) -> str:
    return f"<urn:record:{'' if key is None else key}>"


def _key(urn: str | None) -> str | None:
    return (urn or "").removeprefix("<urn:record:").removesuffix(">") or None


def decode_record(data: bytes, with_payload: bool = True) -> tuple:
    """One row of ``RECORDS`` from an inflated record; the digest of a held payload is verified."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.lower()] = value.strip()
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
    response = fields["warc-type"] == "response"
    if response and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    return (_key(fields["warc-record-id"]), fields["warc-type"], fields.get("warc-target-uri"),
            _key(fields.get("warc-refers-to")), digest, size,
            payload if response and with_payload else None)


class _Writer:
    """One archive under way: records go straight into the stored data member."""

    def __init__(self, folder: str):
        self.uri = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.wacz"
        where, path = fs.FileSystem.from_uri(self.uri)
        where.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.sink = where.open_output_stream(path)
        self.zip = zipfile.ZipFile(_Forward(self.sink), "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(_DATA), "w", force_zip64=True)
        self.index = io.StringIO()
        self.at = self.records = 0

    def add(self, key, record: bytes) -> None:
        deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
        member = deflate.compress(record) + deflate.flush()
        self.data.write(member)
        self.index.write(f"{self.at} {len(member)} {'' if key is None else key}\n")
        self.at += len(member)
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(_INDEX), self.index.getvalue())
        self.zip.close()
        self.sink.close()
        return self.uri, self.records, self.at


class _Forward:
    """A write-only stream for ``zipfile``, which then puts sizes behind the members."""

    def __init__(self, sink):
        self.sink = sink

    def write(self, data) -> int:
        self.sink.write(data)
        return len(data)

    def flush(self) -> None:
        pass


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``key, uri, payload, digest, original`` rows into archives and returns their list
    (``ARCHIVES``), itself a written table, so the archives are made once."""

    def stage(batches):
        writer = None

        def done():
            return pa.RecordBatch.from_pylist([dict(zip(ARCHIVES.names, writer.close()))], pa.schema(
                [("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for row in batch.slice(at, SLICE).to_pylist():
                    writer = writer or _Writer(folder)
                    writer.add(row["key"], encode_record(**row))
                    if writer.at >= archive_bytes:
                        yield done()
                        writer = None
        if writer:
            yield done()

    source = pages.select("key", "uri", "payload", "digest", "original")
    return written(source.mapInArrow(stage, ARCHIVES), "archives")


def _open(uri: str):
    where, path = fs.FileSystem.from_uri(uri)
    return where.open_input_file(path)


def record_places(file) -> list[tuple[int, int]]:
    """``(offset in the archive, bytes)`` of every record, from the stored index of each data member.

    A data member without an index is walked once, gzip member by gzip member.
    """
    listed = members(file, file.size())
    data = [m for m in listed if m.name.startswith("archive/") and m.name.endswith(".warc.gz")]
    index = [m for m in listed if m.name.startswith("indexes/") and m.stored]
    if any(not m.stored for m in data):
        raise ValueError("records can only be read by range from stored members")
    if len(data) == 1 and len(index) == 1:
        start = data_start(file, data[0])
        lines = read_range(file, data_start(file, index[0]), index[0].size).decode().splitlines()
        return [(start + int(a), int(n)) for a, n in (line.split(" ")[:2] for line in lines)]
    places = []
    for member in data:
        start = data_start(file, member)
        at, end = start, start + member.size
        while at < end:
            inflate, n = zlib.decompressobj(31), 0
            while not inflate.eof:
                part = read_range(file, at + n, min(1 << 16, end - at - n))
                inflate.decompress(part)
                n += len(part) - len(inflate.unused_data)
            places.append((at, n))
            at += n
    return places


def locate_records(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(archive, offset, lengths)``: consecutive records of about ``range_bytes`` per row."""
    schema = T.StructType([T.StructField("archive", T.StringType()), T.StructField("offset", T.LongType()),
                           T.StructField("lengths", T.ArrayType(T.LongType()))])

    def stage(batches):
        for batch in batches:
            for uri in batch_column(batch, "archive").to_pylist():
                rows = []
                with _open(uri) as file:
                    for at, n in record_places(file):
                        last = rows[-1] if rows else None
                        if last and last[1] + sum(last[2]) == at and last[3] + n <= range_bytes:
                            last[2].append(n)
                            last[3] += n
                        else:
                            rows.append([uri, at, [n], n])
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
                         pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=schema.names)

    return archives.select("archive").mapInArrow(stage, schema)


def read_records(places: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records (``RECORDS``) at ``(archive, offset, lengths)``, each range fetched once.

    Rows may come from ``locate_records`` or name single records. The ranges are dealt out by
    what they fetch, which the size of the rows that name them does not show.
    """
    schema = RECORDS if with_payload else T.StructType(RECORDS.fields[:-1])

    def stage(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with _open(row["archive"]) as file:
                    data = read_range(file, row["offset"], sum(row["lengths"]))
                at, rows = 0, []
                for n in row["lengths"]:
                    rows.append(decode_record(zlib.decompress(data[at:at + n], 31), with_payload))
                    at += n
                for lo in range(0, len(rows), SLICE):
                    columns = list(zip(*rows[lo:lo + SLICE]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64() if f.name == "payload_bytes" else
                                  pa.binary() if f.name == "payload" else pa.string())
                         for c, f in zip(columns, schema.fields)], names=schema.names)

    ranges = written(places.select("archive", "offset", "lengths"), "ranges")
    size = ranges.agg(F.count("*").alias("n"), F.sum(F.aggregate(
        "lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("bytes")).first()
    cores = places.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(size["n"], max(cores, -(-(size["bytes"] or 0) // TASK_BYTES))))
    return ranges.repartition(tasks, F.xxhash64("archive", "offset")).mapInArrow(stage, schema)


def archive_pages(pages: DataFrame, folder: str | None = None, key: str = "page_id", uri: str = "url",
                  html: str = "html", least: int = REVISIT_FROM) -> DataFrame:
    """Archives (``ARCHIVES``) of all pages: a response or revisit record per row.

    The payload is the html in UTF-8, null counts as empty. Repeated rows give repeated
    records; other columns are ignored; an empty table gives no archives.
    """
    folder = folder or scratch_path(pages.sparkSession, "llm-warc")
    body = F.coalesce(quoted(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(quoted(key).alias("key"), quoted(uri).cast("string").alias("uri"),
                        body.alias("payload"), F.sha1(body).alias("digest"), F.octet_length(body).alias("n"))
    if "://" not in folder:
        folder = f"file://{folder}"
    return write_archives(with_originals(rows, least), re.sub("^file:/(?!/)", "file:///", folder))
