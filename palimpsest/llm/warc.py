"""WARC archives: one Zstandard frame per record, and in front a dictionary built from the archive's records."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import scratch, stored
from .words import slices

#: Little-endian magic numbers: of the skippable frame that holds the dictionary, of a dictionary, of a frame.
DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_MAGIC = 0xEC30A437
FRAME_MAGIC = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-page:"
_PIECE = 16 << 10


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: str, url: str, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """A response record, or a revisit record of the response of page ``refers_to``, without payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_ID}{page}>", f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(records: list[bytes], size: int) -> bytes:
    """A dictionary of all of ``records``, of ``size`` bytes at most and a fiftieth of theirs. None where there are
    under 8 of them, or too little or too uniform data."""
    size = min(size, sum(map(len, records)) // 50)
    if len(records) < 8 or size < 256:
        return b""
    try:
        return zstandard.train_dictionary(size, records, k=1024 if size > 4096 else 64, d=8, f=20, accel=1).as_bytes()
    except zstandard.ZstdError:
        return b""


class Archive:
    """Records of one archive. It is spelled when it is full: a dictionary of all its records in a skippable frame, then
    a frame for each record."""

    def __init__(self, dictionary_bytes: int, level: int):
        self.dictionary_bytes, self.level = dictionary_bytes, level
        self.records: list[bytes] = []
        self.size = 0

    def add(self, data: bytes) -> None:
        self.records.append(data)
        self.size += len(data)

    def parts(self) -> Iterator[bytes]:
        dictionary = train_dictionary(self.records, self.dictionary_bytes)
        if dictionary:
            yield struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compressor = zstandard.ZstdCompressor(level=self.level, dict_data=known, write_checksum=True, write_content_size=True)
        for data in self.records:
            yield compressor.compress(data)


def read_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive."""
    at, view = 0, memoryview(content)
    reader = zstandard.ZstdDecompressor()
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", content, 4)[0]
        dictionary = content[8 : 8 + size]
        if struct.unpack_from("<I", dictionary)[0] == FRAME_MAGIC:  # the dictionary itself may be compressed
            dictionary = reader.decompress(dictionary)
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        at = 8 + size
    while at < len(content):
        step, parts = reader.decompressobj(), []
        while not step.eof:  # in pieces: what a frame leaves unused is copied
            piece = view[at : at + _PIECE]
            if not len(piece):
                raise ValueError("the archive ends within a record")
            parts.append(step.decompress(piece))
            at += len(piece)
        at -= len(step.unused_data)
        data = b"".join(parts)
        head, _, rest = data.partition(b"\r\n\r\n")
        version, *lines = head.decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record before byte {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        n = int(headers["Content-Length"])
        if rest[n:] != b"\r\n\r\n":
            raise ValueError(f"the record before byte {at} does not end where its length says")
        yield headers, rest[:n]


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _header(value: str | None) -> str:
    """A header value on one line."""
    return " ".join((value or "").split())


def write_archives(pages: DataFrame, to: str, dictionary_bytes: int = 64 << 10, level: int = 3, roll_bytes: int = 32 << 20, revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each row of ``pages`` to archives under ``to`` (a folder that executors share)
    and return ``path, records, bytes`` of each archive.

    Of records with equal payloads of at least ``revisit_bytes`` bytes, that with the smallest id is the
    response and the others revisit it (also repeated rows of that id: equal id and payload are one
    response for each row); smaller ones are all responses. Null html is an empty payload; a null url an
    empty target; a null id is never referred to while its payload has another. An archive is full at
    ``roll_bytes`` of records, which its task holds until then: its dictionary, of ``dictionary_bytes`` at most, is built from all of them. A very long
    page is one record like others; an empty table gives no archive. A task writes under a name of its own attempt, so that one that is run again
    leaves whole archives; only those returned count. Other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    keys = rows.select("id", "sha", (F.octet_length("html") >= revisit_bytes).alias("large"))
    first = keys.where("large").groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    # revisits alone: few columns, each (id, payload) once, so that no payload is gathered in one task
    revisits = keys.where("large").join(first, "sha").where("not id <=> first").select("id", "sha", "first").distinct()
    rows = rows.join(revisits.withColumnsRenamed({"id": "id_", "sha": "sha_"}), F.expr("id <=> id_ and sha = sha_"), "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, folder = _file_system(to)
        store.create_dir(folder, recursive=True)
        done: list[tuple[str, int, int]] = []
        archive = Archive(dictionary_bytes, level)

        def close() -> None:
            size, name = 0, f"{task.partitionId():06d}-{len(done):04d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.zst"
            with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
                for part in archive.parts():
                    out.write(part)
                    size += len(part)
            done.append((f"{to}/{name}", len(archive.records), size))

        for batch in (part for whole in batches for part in slices(whole)):
            for page, url, html, sha, refers in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "html", "sha", "first"))):
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                archive.add(record("null" if page is None else str(page), _header(url), html.encode(), digest, None if refers is None else str(refers), date))
                if archive.size >= roll_bytes:
                    close()
                    archive = Archive(dictionary_bytes, level)
        if archive.records:
            close()
        columns = [list(c) for c in zip(*done)] or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["path", "records", "bytes"])

    return stored(rows.select("id", "url", "html", "sha", "first").mapInArrow(write, "path string, records long, bytes long"), "archives")


def read_archives(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """``page, url, record_type, payload_bytes, payload_digest, refers_to, payload`` of every record in the
    archives of ``write_archives``. A response's length and digest are taken from its payload, and must be
    those in its headers; a revisit has those of the payload it stands for."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = _file_system(path)
                with store.open_input_stream(name, compression=None) as source:
                    content = source.read()
                rows: list[tuple] = []
                size = 0
                for headers, block in read_archive(content):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    declared = int(http.rpartition(b"Content-Length: ")[2])
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = headers["WARC-Type"]
                    if kind == "response" and (len(payload) != declared or digest_of(payload) != digest):
                        raise ValueError(f"{path}: a payload does not match its headers")
                    name_of = lambda h: None if headers.get(h) in (None, f"<{_ID}null>") else headers[h][len(_ID) + 1 : -1]  # noqa: B023, E731
                    rows.append((name_of("WARC-Record-ID"), headers["WARC-Target-URI"], kind, declared, digest, name_of("WARC-Refers-To"), payload))
                    size += len(payload)
                    if size > 8 << 20:
                        yield _rows(rows)
                        rows, size = [], 0
                yield _rows(rows)

    paths = archives.select("path").repartition(max(1, min(archives.count(), 10_000)), "path")
    return paths.mapInArrow(read, "page string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary")


_KINDS = {"page": pa.string(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.string(), "payload": pa.binary()}


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS.values())], names=list(_KINDS))


def archive_round_trip(pages: DataFrame, to: str | None = None, id_col: str = "page_id", **options) -> DataFrame:
    """Archive all of ``pages``, read the archives back, and return ``id_col, payload_bytes,
    payload_digest, record_type, refers_to`` of each record."""
    spark = pages.sparkSession
    archives = write_archives(pages, to or scratch(spark, "warc"), id_col=id_col, **options)
    kind = pages.schema[id_col].dataType.simpleString()
    out = read_archives(spark, archives)
    return out.select(F.col("page").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
