"""WARC records in ZIP-packaged archives: written as stored members with an index, read back by byte ranges.

An archive is a ZIP file with two stored (not compressed) members: ``archive/data.warc.gz``, records each in a gzip
member of its own, and ``indexes/index.cdxj``, a line per record with its offset and length. The reader takes the end of
the file, follows the central directory (and the ZIP64 one where sizes ask for it) to the members, reads the index, and
then ranges of records; nothing is extracted. Files are reached through ``pyarrow.fs``, so the folder may be in any store
it knows.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlewise.llm.common import broadcast_if_small, shared_folder, sliced, stored

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
LEAST_REVISIT_BYTES, ARCHIVE_BYTES = 100, 128 << 20
_END, _END64, _LOCATOR64 = struct.Struct("<4s4H2IH"), struct.Struct("<4sQ2H2I4Q"), struct.Struct("<4sIQI")
_ENTRY, _LOCAL = struct.Struct("<4s6H3I5H2I"), struct.Struct("<4s5H3I2H")
_RECORD = "page_id {kind}, url string, record_type string, refers_to {kind}, payload_digest string, payload_bytes long, payload binary"


def _file(path: str):
    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, inner


# -- reading ----------------------------------------------------------------------------------------------------------


def members(source) -> dict[str, tuple[int, int]]:
    """Offset and length of the bytes of each stored member of an open ZIP file.

    ``source`` has ``size``, ``seek`` and ``read``. Raises ValueError for what is no ZIP file, or for a damaged one.
    Members stored in another way are left out, as their bytes can't be read by ranges.
    """
    size = source.size()
    tail_at = max(0, size - _END.size - 0xFFFF - _LOCATOR64.size)
    tail = _range(source, tail_at, size - tail_at)
    at = tail.rfind(b"PK\5\6")
    while at >= 0 and (at + _END.size > len(tail) or at + _END.size + _END.unpack_from(tail, at)[7] != len(tail)):
        at = tail.rfind(b"PK\5\6", 0, at)  # these bytes were part of a comment
    if at < 0:
        raise ValueError("no end of a ZIP directory")
    *_, length, start, _ = _END.unpack_from(tail, at)
    count = _END.unpack_from(tail, at)[4]
    if at >= _LOCATOR64.size and tail[at - _LOCATOR64.size :][:4] == b"PK\6\7":
        end64 = _range(source, _LOCATOR64.unpack_from(tail, at - _LOCATOR64.size)[2], _END64.size)
        if end64[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 directory where its locator points")
        *_, count, length, start = _END64.unpack(end64)
    directory, found, at = _range(source, start, length), {}, 0
    for _ in range(count):
        entry = _ENTRY.unpack_from(directory, at)
        if entry[0] != b"PK\1\2":
            raise ValueError("damaged ZIP directory")
        method, packed, plain, name_n, extra_n, note_n, local = entry[4], entry[8], entry[9], *entry[10:13], entry[16]
        at += _ENTRY.size
        name, extra = directory[at : at + name_n], directory[at + name_n : at + name_n + extra_n]
        at += name_n + extra_n + note_n
        plain, packed, local = _zip64(extra, plain, packed, local)
        if method == 0:
            head = _LOCAL.unpack(_range(source, local, _LOCAL.size))
            found[name.decode("utf-8", "replace")] = (local + _LOCAL.size + head[9] + head[10], plain)
    return found


def _zip64(extra: bytes, *values: int) -> list[int]:
    """The three values with those that are all ones taken from the ZIP64 field, where they stand in this order."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, at + 4))
            return [next(wide) if value == 0xFFFFFFFF else value for value in values]
        at += 4 + length
    return list(values)


def _range(source, offset: int, length: int) -> bytes:
    source.seek(offset)
    data = source.read(length)
    if len(data) < length:
        raise ValueError("the file ends early")
    return data


def index_entries(archives: DataFrame) -> DataFrame:
    """(path, offset, length) of every record of the archives in ``archives.path``, in file order; offsets count from
    the start of the ZIP file. Null paths are skipped."""

    def run(batches):
        for batch in batches:
            for path in filter(None, batch.column(0).to_pylist()):
                system, inner = _file(path)
                with system.open_input_file(inner) as source:
                    found = members(source)
                    base = found[DATA][0]
                    lines = [json.loads(line.split(b" ", 2)[2]) for line in _range(source, *found[INDEX]).splitlines()]
                for k in range(0, len(lines), 10_000):
                    some = lines[k : k + 10_000]
                    yield pa.RecordBatch.from_pydict(
                        {"path": [path] * len(some), "offset": [base + x["offset"] for x in some], "length": [x["length"] for x in some]}
                    )

    return archives.select("path").mapInArrow(run, "path string, offset long, length long")


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one WARC record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def records(entries: DataFrame, kind: str = "bigint") -> DataFrame:
    """The records that ``entries`` (path, offset, length) point to, each read by its own range.

    Digest and length of a response are computed from the payload that was read; a revisit has no payload, and its
    headers give both for the payload it stands for.
    """

    def run(batches):
        path, source, rows, held = None, None, [], 0
        for batch in batches:
            for at, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if at != path:
                    if source:
                        source.close()
                    system, inner = _file(at)
                    path, source = at, system.open_input_file(inner)
                headers, payload = parsed(gzip.decompress(_range(source, offset, length)))
                revisit = headers["warc-type"] == "revisit"
                number = lambda name, h=headers: int(h[name]) if name in h else None
                rows.append(
                    (
                        number("page-id"),
                        headers.get("warc-target-uri"),
                        headers["warc-type"],
                        number("refers-to-page-id"),
                        headers["warc-payload-digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest(),
                        number("payload-length") if revisit else len(payload),
                        None if revisit else payload,
                    )
                )
                held += len(payload)
                if held > 4 << 20:
                    yield _batch(rows, kind)
                    rows, held = [], 0
        if rows:
            yield _batch(rows, kind)
        if source:
            source.close()

    return entries.mapInArrow(run, _RECORD.format(kind=kind))


def _batch(rows: list[tuple], kind: str) -> pa.RecordBatch:
    number = {"bigint": pa.int64(), "int": pa.int32()}[kind]
    types = (number, pa.string(), pa.string(), number, pa.string(), pa.int64(), pa.binary())
    names = [x.split(" ")[0] for x in _RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)


# -- writing ----------------------------------------------------------------------------------------------------------


def record(page_id, url, payload: bytes, digest: str, refers_to, written: str) -> bytes:
    """One WARC record. A revisit (``refers_to`` given) has no block, only the digest and length of what it repeats."""
    revisit = refers_to is not None
    headers = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>",
        f"WARC-Date: {written}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {0 if revisit else len(payload)}",
    ]
    if url is not None:
        headers.append("WARC-Target-URI: " + " ".join(url.split()))
    if page_id is not None:
        headers.append(f"Page-Id: {page_id}")
    if revisit:
        headers.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        headers.append(f"Refers-To-Page-Id: {refers_to}")
    return "\r\n".join(headers).encode() + b"\r\n\r\n" + (b"" if revisit else payload) + b"\r\n\r\n"


class _Archive:
    """One archive being written, record by record. Python's own ZIP writer switches to ZIP64 where sizes ask for it."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        system, inner = _file(folder)
        system.create_dir(inner, recursive=True)
        self.sink = system.open_output_stream(f"{inner}/{self.path.rpartition('/')[2]}")
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data, self.at, self.lines = self.zip.open(DATA, "w", force_zip64=True), 0, []

    def add(self, key: str, data: bytes) -> None:
        packed = gzip.compress(data, 5, mtime=0)
        self.data.write(packed)
        self.lines.append(f"{key} - {json.dumps({'offset': self.at, 'length': len(packed)})}")
        self.at += len(packed)

    def close(self) -> tuple[str, int]:
        self.data.close()
        self.zip.writestr(INDEX, "\n".join(self.lines))
        self.zip.close()
        self.sink.close()
        return self.path, len(self.lines)


def classed(pages: DataFrame) -> DataFrame:
    """``pages`` as (page_id, url, payload, payload_digest, refers_to): which page each repeated payload points to.

    Of equal payloads of at least LEAST_REVISIT_BYTES bytes, all rows with the smallest page_id are responses and the
    others refer to it. Null html is empty; smaller payloads, and rows without an id, are always responses. Only digests
    are grouped; a payload with a third of all pages is one row per task in the grouping. Repeated digests are joined where
    the pages are while they are few enough to be broadcast; pages move to them only beyond that.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    source = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= LEAST_REVISIT_BYTES
    first = (
        source.where(large).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1").select("payload_digest", "first_id")
    )
    return source.join(broadcast_if_small(stored(first, "warc-repeated")), "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_digest", F.expr("if(page_id > first_id, first_id, null)").alias("refers_to")
    )


def written(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the records and return (path, records) of the archives, read from a stored list.

    A task writes archives under names of its own and reports them; the list is committed with its job. So archives of
    failed or repeated attempts are never read. An empty table writes none.
    """

    def run(batches):
        now = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        archive, done = None, []
        for batch in sliced(batches, 2):
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                archive = archive or _Archive(folder)
                archive.add(f"{page_id}", record(page_id, url, payload, digest, refers_to, now))
                if archive.at >= archive_bytes:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_pydict({"path": [p for p, _ in done], "records": [n for _, n in done]})

    return stored(rows.mapInArrow(run, "path string, records long"), "warc-list")


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all ``pages`` to archives and read every record back: page_id, url, record_type, refers_to, payload_digest,
    payload_bytes and payload (null for revisits), one row per row of ``pages``."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    kind = pages.schema["page_id"].dataType.simpleString()
    archives = written(classed(pages), folder)
    tasks = max(1, archives.count())
    return records(index_entries(archives.repartition(tasks)), kind)


def rows_of(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of one archive, for tests and small tools."""
    system, inner = _file(path)
    with system.open_input_file(inner) as source:
        found = members(source)
        for line in _range(source, *found[INDEX]).splitlines():
            x = json.loads(line.split(b" ", 2)[2])
            yield parsed(gzip.decompress(_range(source, found[DATA][0] + x["offset"], x["length"])))
