"""WARC archives of pages: writing with revisit records, a monolithic-gzip normaliser with an offset index, reading.

``write_archives`` turns pages into archives that are one gzip stream each. ``normalise`` inflates such a file once, from
start to end, whatever its members are, rewrites every record as a gzip member of its own, and writes a sidecar index
(JSON lines: offset, length and the named fields of each record). ``read_records`` takes the sidecars as a Spark table
and reads each record by its offset. Files go to the shared folder, through the file system that its URI names; a task
that is run again writes under a new name, and only files of tasks that succeeded are listed.

Revisits: of the records with equal payloads of at least ``least`` bytes, the one with the smallest id is a response and
the others refer to it. Equal means the same sha256 and length.

Defined results: a null html is an empty payload; a null or repeated id is written as a response and is not referred to
if null; rows with the same id and payload are all responses if it is the smallest id; a null url leaves its header out;
line ends in a url are escaped; an empty table gives empty results; columns other than the three are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.base import arrow_rows, cut, remove, scratch

#: Bytes of payload after which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
#: Repeated payloads up to which their table is broadcast.
BROADCAST_ROWS = 200_000
DATE = "2000-01-01T00:00:00Z"
_END = b"\r\n\r\n"
INDEX = "archive string, offset long, length long, type string, id string, uri string, digest string, refers_to string"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit, of which the HTTP head stays and tells the payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    fields.append(("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"))
    if refers_to is not None:
        fields.append(("WARC-Refers-To", f"<urn:page:{refers_to}>"))
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + _END


def fields_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields, whole record) of an inflated archive that comes in chunks; memory is bound by one record."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        at = 0
        while (end := held.find(_END, at)) >= 0:
            named = fields_of(bytes(held[at:end]))
            stop = end + 4 + int(named["content-length"]) + 4
            if stop > len(held):
                break
            yield named, bytes(held[at:stop])
            at = stop
        del held[:at]
    if held:
        raise ValueError("an archive ends inside a record")


def inflated(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, in chunks of at most ``size`` bytes.

    A file that ends before a member's end mark raises, at a record's edge too.
    """
    inflater, begun = zlib.decompressobj(31), False
    while data := stream.read(size):
        begun = True
        while data:
            if inflater.eof:
                inflater = zlib.decompressobj(31)
            yield inflater.decompress(data, size)
            data = inflater.unused_data if inflater.eof else inflater.unconsumed_tail
    while not inflater.eof and (rest := inflater.decompress(b"", size)):
        yield rest
    if begun and not inflater.eof:
        raise ValueError("a gzip stream ends before its end mark")


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    key = rows.select("page_id", F.sha2("payload", 256).alias("sha"), F.length("payload").alias("size")).where(F.col("size") >= least)
    first = key.groupBy("sha", "size").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1").select("sha", "size", "first")
    first = cut(first, "repeated")
    if first.count() <= BROADCAST_ROWS:
        first = F.broadcast(first)
    rows = rows.withColumn("sha", F.sha2("payload", 256)).withColumn("size", F.length("payload"))
    joined = rows.join(first, ["sha", "size"], "left")
    return joined.select("page_id", "url", "payload", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of the rows (page_id, url, payload, refers_to), each one gzip stream; returns their paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        out, path, packer, size = None, "", None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = f"{top}/{uuid.uuid4().hex}.warc.gz"
                    out, packer, size = store.open_output_stream(path, compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0
                out.write(packer.compress(record(row["page_id"], row["url"], row["payload"], row["refers_to"])))
                size += len(row["payload"])
                if size >= archive_bytes:
                    out.write(packer.flush())
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"archive": [path]})
        if out is not None:
            out.write(packer.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [path]})

    return rows.mapInArrow(run, "archive string")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive with a member for each record, and its sidecar index; returns the new archives' paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        for batch in batches:
            for source in batch.column(0).to_pylist():
                name = uuid.uuid4().hex
                path, index, at = f"{top}/{name}.warc.gz", f"{top}/{name}.index.json", 0
                with store.open_input_stream(source, compression=None) as stream, store.open_output_stream(path, compression=None) as out, store.open_output_stream(index, compression=None) as side:
                    for named, whole in records(inflated(stream)):
                        packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                        member = packer.compress(whole) + packer.flush()
                        out.write(member)
                        entry = {"archive": path, "offset": at, "length": len(member), "type": named.get("warc-type"), "id": named.get("warc-record-id"), "uri": named.get("warc-target-uri"), "digest": named.get("warc-payload-digest"), "refers_to": named.get("warc-refers-to")}
                        side.write(json.dumps(entry).encode() + b"\n")
                        at += len(member)
                yield pa.RecordBatch.from_pydict({"archive": [path]})

    return archives.mapInArrow(run, "archive string")


def _number(urn: str | None) -> int | None:
    found = re.search(r"urn:page:(-?\d+)", urn or "")
    return int(found[1]) if found else None


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """page_id, url, payload (null for a revisit), payload_bytes, payload_digest, record_type, refers_to, by the index.

    The digest is computed again from a response's payload; a mismatch with its header raises. Without ``payloads`` these
    are read and digested as well, but stay in the task: the column is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        held, file = "", None
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")}
            for row in batch.to_pylist():
                if row["archive"] != held:
                    if file is not None:
                        file.close()
                    held, file = row["archive"], store.open_input_file(row["archive"])
                file.seek(row["offset"])
                whole = zlib.decompress(file.read(row["length"]), 31)
                head, _, block = whole.partition(_END)
                named = fields_of(head)
                http, _, body = block.partition(_END)
                payload = body[:-4] if named["warc-type"] == "response" else None
                digest = named["warc-payload-digest"].removeprefix("sha1:")
                if payload is not None and payload_digest(payload) != digest:
                    raise ValueError(f"digest of {named['warc-record-id']} differs")
                values = (_number(named["warc-record-id"]), named.get("warc-target-uri"), payload if payloads else None, int(fields_of(http)["content-length"]), digest, named["warc-type"], _number(named.get("warc-refers-to")))
                for k, v in zip(out, values, strict=True):
                    out[k].append(v)
            types = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))
        if file is not None:
            file.close()

    return index.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def read_index(archives: DataFrame, folder: str) -> DataFrame:
    """The sidecars of the listed archives; what a lost task left behind in the folder is not listed."""
    every = archives.sparkSession.read.schema(INDEX).option("pathGlobFilter", "*.index.json").json(folder)
    return every.join(archives, "archive", "left_semi")


def round_trip(pages: DataFrame, least: int = 0, archive_bytes: int = ARCHIVE_BYTES, payloads: bool = True) -> DataFrame:
    """Write the pages as archives, normalise them, and read the records back by their index, with or without payloads."""
    spark = pages.sparkSession
    arrow_rows(spark)
    whole, own = scratch(spark, "warc-whole"), scratch(spark, "warc")
    archives = cut(write_archives(with_revisits(pages, least), whole, archive_bytes), "archives")
    if archives.isEmpty():
        return spark.createDataFrame([], "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")
    tasks = max(1, min(archives.count(), spark.sparkContext.defaultParallelism * 8))
    listed = cut(normalise(archives.repartition(tasks), own), "normalised")
    remove(spark, whole)
    index = read_index(listed, own)
    return read_records(index, own, payloads)
