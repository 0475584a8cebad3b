"""WARC archives compressed record by record with a dictionary of their own.

Every archive is one file: a skippable Zstandard frame that holds a dictionary built from the
archive's records, then one frame for each record, compressed with that dictionary. A reader
needs nothing but the file, and can decompress any record from its offset alone.

Records with equal payloads (by SHA-1) of at least `least` bytes: the one with the largest id is
a response, the others are revisit records that refer to it and carry no payload. Which it is
comes from one row per digest, joined to the pages before they are written.

Archives are named by the attempt of their task and renamed when complete; the table of files names
those of the attempts that were committed. So a task that is run again, or twice at once, may cut its records
elsewhere without harm: files of other attempts stay unnamed. Archives hold up to `archive_bytes` of payload
and one more record; a task keeps only the archive it is writing in memory.

Defined results: NULL payloads are empty; a page without an id or URL is archived with an empty
one; rows that repeat an id and its payload are records of one type; an empty table gives no
archives and no rows. Columns other than id, URL and payload are ignored, whatever their names. A response whose payload does not have its digest raises an error.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairkit.session import materialize, scratch_path

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"

FILES = "file string, records long, bytes long, dictionary_bytes long"
RECORDS = ("file string, offset long, record_type string, record_id string, uri string, page_id long, "
           "refers_to long, payload_bytes long, payload_digest string, payload binary")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record_bytes(page_id, url, payload: bytes, refers_to, refers_url=None) -> bytes:
    """One WARC record. The digest and length of the full payload stand in the headers of revisits too."""
    # line breaks would end a header
    url = "".join(c if c.isprintable() else "%{:02X}".format(ord(c)) for c in url or "")
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", urn(page_id)),
            ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", "sha1:" + payload_digest(payload)),
            ("WARC-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        head += [("WARC-Refers-To", urn(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
        payload = b""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head)
    return VERSION + b"\r\n" + lines + b"\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[:int(fields["Content-Length"])]
    number = lambda x: int(x[10:-1]) if x and x[10:-1] else None
    return {"record_type": fields["WARC-Type"], "record_id": fields["WARC-Record-ID"], "uri": fields["WARC-Target-URI"],
            "page_id": number(fields["WARC-Record-ID"]), "refers_to": number(fields.get("WARC-Refers-To")),
            "payload_bytes": int(fields["WARC-Payload-Length"]),
            "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
            "payload": body.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None}


def build_dictionary(records: list[bytes], size: int, sample_bytes: int) -> bytes:
    """Dictionary of evenly spaced records; empty where there are too few to build one."""
    step = max(1, -(-sum(map(len, records)) // sample_bytes))
    sample = [r[: 1 << 17] for r in records[::step]]
    if len(sample) < 16 or sum(map(len, sample)) < 8 * size:
        size = max(256, sum(map(len, sample)) // 16)
    try:
        return zstandard.train_dictionary(size, sample).as_bytes() if len(sample) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def write_archive(records: list[bytes], level: int, dictionary_size: int, sample_bytes: int) -> tuple[bytes, int]:
    content = build_dictionary(records, dictionary_size, sample_bytes)
    packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(content) if content else None)
    out = io.BytesIO()
    out.write(struct.pack("<II", SKIPPABLE, len(content)) + content)
    for record in records:
        out.write(packer.compress(record))
    return out.getvalue(), len(content)


def read_archive(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of every record, in order."""
    kind, size = struct.unpack_from("<II", data)
    if kind != SKIPPABLE:
        raise ValueError("archive without a dictionary frame")
    content, at = data[8:8 + size], 8 + size
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content) if content else None)
    view, piece = memoryview(data), 1 << 16
    while at < len(data):
        one, parts, to = unpacker.decompressobj(), [], at
        while not one.eof:
            if to >= len(data):
                raise ValueError(f"record at {at} is cut off")
            parts.append(one.decompress(view[to:to + piece]))
            to += piece
        to = min(to, len(data)) - len(one.unused_data)
        yield at, b"".join(parts)
        at = to


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               least: int = 0, archive_bytes: int = 16 << 20, level: int = 3, dictionary_size: int = 64 << 10,
               sample_bytes: int = 4 << 20) -> DataFrame:
    """Write the archives below `folder` (any file system pyarrow opens) and return the table of files."""
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    keyed = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    large = F.octet_length("payload") >= least
    responses = materialize(keyed.filter(large).groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n"))
                            .filter("n > 1").select("digest", "keep"), "warc-responses")
    # A plain scan on either side: AQE can split the partition of a payload that very many pages share.
    marked = keyed.join(responses, "digest", "left").withColumn(
        "refers_to", F.when(large & ~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(folder)
        system.create_dir(root, recursive=True)
        task = TaskContext.get()
        stem = f"part-{task.partitionId():06d}-{uuid.uuid4().hex}"
        done, records, size = 0, [], 0

        def close():
            data, used = write_archive(records, level, dictionary_size, sample_bytes)
            name = f"{stem}-{done:05d}.warc.zst"
            with system.open_output_stream(f"{root}/.{name}", compression=None) as out:
                out.write(data)
            system.move(f"{root}/.{name}", f"{root}/{name}")
            return pa.RecordBatch.from_pylist([{"file": f"{folder.rstrip('/')}/{name}", "records": len(records), "bytes": len(data), "dictionary_bytes": used}])

        for batch in batches:
            for page_id, url, body, refers_to in zip(*(batch.column(i) for i in range(4))):
                body = body.as_py() or b""
                records.append(record_bytes(page_id.as_py(), url.as_py(), body, refers_to.as_py()))
                size += len(body)
                if size >= archive_bytes:
                    yield close()
                    done, records, size = done + 1, [], 0
        if records:
            yield close()

    columns = marked.select("page_id", "url", "payload", "refers_to")
    return materialize(columns.mapInArrow(write, FILES), "warc-files")


def read_warc(files: DataFrame) -> DataFrame:
    """Records of the archives named in column `file`."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [n for b in batches for n in b.column(0).to_pylist()]
        schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()),
                            ("uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
                            ("payload_digest", pa.string()), ("payload", pa.binary())])
        for name in names:
            system, path = filesystem(name)
            with system.open_input_stream(path, compression=None) as source:
                data = source.read()
            rows, size = [], 0
            for offset, record in read_archive(data):
                row = parse_record(record)
                if row["payload"] is not None and payload_digest(row["payload"]) != row["payload_digest"]:
                    raise ValueError(f"{name}: the payload at {offset} does not have its digest")
                rows.append({"file": name, "offset": offset} | row)
                size += len(record)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    spread = files.select("file").repartition("file")
    return spread.mapInArrow(read, RECORDS)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written, then every record read back; payloads read are held against their digests."""
    files = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch_path(spark, "warc"))
    records = read_warc(files)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
