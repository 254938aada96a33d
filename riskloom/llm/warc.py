"""WARC: archives of one gzip member per record, and a splittable reader.

The writer stores each task's records in a file of its own. Attempts never share a file
name and only the files of successful attempts are listed, so a repeated task leaves no
record twice. The reader gives tasks byte ranges. A task looks for the gzip magic in its
range, takes a place for a record only if a WARC header can be decoded there, owns the
records that start inside its range, and reads the last of them beyond its end.

Archives go through ``pyarrow.fs``, so ``folder`` may be on any file system it knows; every
executor must reach it.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from riskloom.llm.common import only
from riskloom.plans.lineage import materialise, scratch_path

#: Equal payloads of at least so many bytes are stored once.
LEAST_REVISIT = 100
#: Bytes of an archive that one reading task owns.
RANGE_BYTES = 4 << 20
#: A file is closed at the first record that ends beyond this size.
FILE_BYTES = 256 << 20
READ_BYTES = 1 << 18
#: Fixed values of the formats.
GZIP_MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = ("page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
           "payload_digest string, payload binary, archive string, position bigint")


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or plain path, and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def _one_line(value: str | None) -> str:
    """A header value without line breaks; percent signs and breaks are escaped."""
    return re.sub(r"[%\r\n]", lambda m: f"%{ord(m.group()):02X}", value or "")


def _whole(value: str) -> str:
    return re.sub(r"%(25|0D|0A)", lambda m: chr(int(m.group(1), 16)), value)


def encode_record(page_id: int | None, url: str | None, kind: str, refers_to: int | None, digest: str,
                  payload: bytes) -> bytes:
    """One record as a gzip member. A revisit has no block, but tells the payload's length and digest."""
    block = payload if kind == "response" else b""
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha256:{digest}",
        "X-Payload-Length": str(len(payload)),
    }
    if page_id is not None:
        head["X-Page-ID"] = str(page_id)
    if url is not None:
        head["WARC-Target-URI"] = _one_line(url)
    if kind == "revisit":
        head["WARC-Profile"] = PROFILE
        head["X-Refers-To-Page-ID"] = str(refers_to)
    head["Content-Type"] = "text/html"
    head["Content-Length"] = str(len(block))
    text = "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode()
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(VERSION + text + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def decode_record(data: bytes) -> dict | None:
    """The header fields and block of a decompressed record, or None if it is none."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(VERSION) or end < 0:
        return None
    head = dict(line.split(": ", 1) for line in data[len(VERSION):end].decode("utf-8", "replace").split("\r\n"))
    size = int(head["Content-Length"])
    block = data[end + 4:end + 4 + size]
    if len(block) != size or data[end + 4 + size:] != b"\r\n\r\n":
        return None
    return head | {"block": block}


def plan_records(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, digest, kind, refers_to`` for every row of ``pages(page_id, url, html)``.

    Null html is an empty payload. Of equal payloads of at least ``LEAST_REVISIT`` bytes the
    rows with the smallest page_id are responses, all of them if the id is repeated, and the
    others revisit it. A group whose ids are all null has only responses.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = only(pages, "page_id", "url", "html").withColumns(
        {"digest": F.sha2(payload, 256), "size": F.length(payload)})
    # Only groups of two and more are kept, and stored, so that the join sees their real size
    # and a group with a large part of all rows can be split.
    firsts = materialise(
        rows.where(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(
            F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n"),
        "firsts")
    joined = rows.join(firsts, "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    return joined.select(
        "page_id", "url", "html", "digest", F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record per row of ``pages`` and returns the stored list ``archive, bytes, records``."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        out, written = None, []  # the open file; its name, size and number of records

        def closed(name: str, size: int, records: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": [name], "bytes": [size], "records": [records]})

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "kind", "refers_to", "digest", "html")]
            for i in range(batch.num_rows):
                page_id, url, kind, refers_to, digest, html = (c[i].as_py() for c in columns)
                if out is None:
                    fs.create_dir(path, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    written = [f"{folder}/{name}", 0, 0]
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                record = encode_record(page_id, url, kind, refers_to, digest, (html or "").encode())
                out.write(record)
                written[1:] = written[1] + len(record), written[2] + 1
                if written[1] >= FILE_BYTES:
                    out.close()
                    out = None
                    yield closed(*written)
        if out is not None:
            out.close()
            yield closed(*written)

    return materialise(
        plan_records(pages).mapInArrow(write, "archive string, bytes bigint, records bigint"), "archives")


def records_in(source, size: int, start: int, end: int) -> Iterator[tuple[int, dict]]:
    """Position and content of every record of an open archive that starts in ``[start, end)``."""
    position = start
    while position < end:
        position = _next_magic(source, size, position, end)
        if position is None:
            return
        found = _member(source, size, position)
        if found is None:
            position += 1
        else:
            length, record = found
            yield position, record
            position += length


def _next_magic(source, size: int, start: int, end: int) -> int | None:
    """The first place of the gzip magic in ``[start, end)``; its bytes may reach beyond ``end``."""
    while start < end:
        source.seek(start)
        part = source.read(min(READ_BYTES, end - start) + len(GZIP_MAGIC) - 1)
        at = part.find(GZIP_MAGIC)
        if 0 <= at and start + at < end:
            return start + at
        if start + len(part) >= size:
            return None
        start += max(len(part) - len(GZIP_MAGIC) + 1, 1)
    return None


def _member(source, size: int, start: int) -> tuple[int, dict] | None:
    """Length and content of the record at ``start``, or None if no whole WARC record is there."""
    unpacker, parts, position, checked = zlib.decompressobj(31), [], start, False
    source.seek(start)
    while not unpacker.eof:
        part = source.read(min(READ_BYTES, size - position))
        if not part:
            return None
        position += len(part)
        try:
            parts.append(unpacker.decompress(part))
        except zlib.error:
            return None
        if not checked and (len(parts[0]) >= len(VERSION) or unpacker.eof):
            if not parts[0].startswith(VERSION):
                return None
            checked = True
    record = decode_record(b"".join(parts))
    return None if record is None else (position - len(unpacker.unused_data) - start, record)


def read_archives(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of ``archives(archive, bytes, ...)``, one row each, as in ``RECORDS``.

    Length and digest of a response are those of the payload that was read; a revisit has
    what its header says and no payload.
    """
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes)))
    ranges = only(archives, "archive", "bytes").where("bytes > 0").select("archive", "bytes", starts.alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORDS.split(", ")]
        schema = pa.schema([(n, pa.binary() if n == "payload" else pa.int64() if t == "bigint" else pa.string())
                            for n, t in (c.split() for c in RECORDS.split(", "))])
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = open_folder(row["archive"])
                rows, held = [], 0
                with fs.open_input_file(path) as source:
                    end = min(row["start"] + range_bytes, row["bytes"])
                    for position, r in records_in(source, row["bytes"], row["start"], end):
                        answer = r["WARC-Type"] == "response"
                        block, page, old = r["block"], r.get("X-Page-ID"), r.get("X-Refers-To-Page-ID")
                        url = r.get("WARC-Target-URI")
                        rows.append((
                            int(page) if page is not None else None, _whole(url) if url is not None else None,
                            r["WARC-Type"], int(old) if old is not None else None,
                            len(block) if answer else int(r["X-Payload-Length"]),
                            hashlib.sha256(block).hexdigest() if answer else r["WARC-Payload-Digest"][7:],
                            block if answer else None, row["archive"], position))
                        held += len(block)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema)

    tasks = max(1, min(100_000, ranges.count()))
    return ranges.repartition(tasks, "archive", "start").mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to archives in the shared scratch folder and reads their records back."""
    return read_archives(write_archives(pages, scratch_path(pages.sparkSession, "warc")))
