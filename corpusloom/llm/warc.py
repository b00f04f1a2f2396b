"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with whole WARC
records, and a closing skippable frame with the seek table. A record is found by
its frame and its place in the unpacked frame, without reading the rest.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import materialize, shared_path
from corpusloom.settings import MAX_BROADCAST_BYTES

# Unpacked bytes after which a frame ends, and packed bytes after which a bundle does.
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 128 << 20
# Unpacked bytes that a task reads back.
TASK_BYTES = 16 << 20
# What a shared digest takes in a broadcast table, and more; tasks that rows of one digest are dealt over otherwise.
SHARED_ROW_BYTES = 128
SALTS = 16
# Payloads below this are always stored whole.
REVISIT_BYTES = 1000

# The seekable Zstandard format and WARC 1.1.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
WARC_VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_DATE = "1970-01-01T00:00:00Z"
RECORD_NAMESPACE = uuid.NAMESPACE_URL


def record_id(key: str) -> str:
    """The same urn for the same record in every run."""
    return f"urn:uuid:{uuid.uuid5(RECORD_NAMESPACE, key)}"


def warc_record(key: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record: a response with its payload, or a revisit that names the response instead."""
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id(key)}>",
        f"WARC-Date: {WARC_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Record-Key: {_one_line(key)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_one_line(url)}")
    if refers_to is not None:
        lines += [
            f"WARC-Refers-To: <{record_id(refers_to)}>",
            f"X-Refers-To-Key: {_one_line(refers_to)}",
            f"WARC-Profile: {REVISIT_PROFILE}",
        ]
    body = payload if refers_to is None else b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return WARC_VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _one_line(value: str) -> str:
    """Header values hold no line ends: percent signs and control characters are percent-coded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or c == "%" else c for c in value)


def _plain(value: str) -> str:
    parts = value.split("%")
    return parts[0] + "".join(chr(int(p[:2], 16)) + p[2:] for p in parts[1:])


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and content of the record at ``at``, and where the next one starts."""
    if not data.startswith(WARC_VERSION, at):
        raise ValueError(f"no WARC record at byte {at}")
    end = data.index(b"\r\n\r\n", at)
    headers = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
    start = end + 4
    stop = start + int(headers["Content-Length"])
    return headers, data[start:stop], stop + 4


class BundleWriter:
    """Writes records to one bundle; memory holds one frame."""

    def __init__(self, stream, frame_bytes: int = FRAME_BYTES):
        self.stream, self.frame_bytes = stream, frame_bytes
        self.packer = zstandard.ZstdCompressor()
        self.frame = bytearray()
        self.frames: list[tuple[int, int]] = []
        self.size = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame number of the record and its offset in the unpacked frame."""
        if self.frame and len(self.frame) + len(record) > self.frame_bytes:
            self._end_frame()
        place = len(self.frames), len(self.frame)
        self.frame += record
        return place

    def _end_frame(self) -> None:
        packed = self.packer.compress(bytes(self.frame))
        self.stream.write(packed)
        self.frames.append((len(packed), len(self.frame)))
        self.size += len(packed)
        self.frame = bytearray()

    def close(self) -> None:
        if self.frame:
            self._end_frame()
        entries = b"".join(struct.pack("<II", packed, plain) for packed, plain in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
        self.stream.close()


def read_seek_table(source) -> list[tuple[int, int, int]]:
    """``(offset, packed bytes, plain bytes)`` of every frame, from the end of an open bundle."""
    total = source.size()
    source.seek(total - 9)
    count, _, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("not a seekable bundle")
    source.seek(total - 9 - 8 * count)
    entries = struct.iter_unpack("<II", source.read(8 * count))
    frames, at = [], 0
    for packed, plain in entries:
        frames.append((at, packed, plain))
        at += packed
    return frames


def read_frame(source, frame: tuple[int, int, int]) -> bytes:
    offset, packed, plain = frame
    source.seek(offset)
    return zstandard.ZstdDecompressor().decompress(source.read(packed), max_output_size=plain)


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def with_responses(pages: DataFrame) -> DataFrame:
    """``(key, url, payload, digest, refers_to)`` of ``(key, url, payload)`` rows.

    Of equal payloads of at least ``REVISIT_BYTES`` the row with the largest key
    is the response. Digests are counted on the map side, and only digests that
    occur twice are joined back: broadcast if their number allows it, so that
    payloads stay where they are. Beyond that payloads are shuffled, and each
    digest is dealt over ``SALTS`` tasks, as many rows may share one.
    """
    marked = pages.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload"))
    shared = materialize(
        marked.where(F.col("bytes") >= REVISIT_BYTES)
        .groupBy("digest", "bytes")
        .agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("last"))
        .where("n > 1")
        .select("digest", "bytes", "last"),
        "shared-digests",
    )
    joined_on = ["digest", "bytes"]
    if shared.count() * SHARED_ROW_BYTES <= MAX_BROADCAST_BYTES:
        shared = F.broadcast(shared)
    else:
        joined_on = ["digest", "bytes", "_salt"]
        marked = marked.withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
        shared = shared.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    refers_to = F.when(F.col("last").isNotNull() & ~F.col("key").eqNullSafe(F.col("last")), F.col("last"))
    return marked.join(shared, joined_on, "left").select(
        "key", "url", "payload", "digest", refers_to.alias("refers_to")
    )


@dataclass(frozen=True)
class Archive:
    """Written bundles: ``index`` has one row per record, ``(key, file, frame, offset)``."""

    folder: str
    index: DataFrame


def write_archive(
    pages: DataFrame,
    folder: str | None = None,
    key_col: str = "page_id",
    url_col: str = "url",
    text_col: str = "html",
    frame_bytes: int = FRAME_BYTES,
    bundle_bytes: int = BUNDLE_BYTES,
) -> Archive:
    """Write one record per row into bundles under ``folder`` (in the shared folder by default).

    The payload is the text in UTF-8. Of records with equal payloads of at least
    1000 bytes the one with the largest key is a response and the others revisit
    it; all others are responses. A task that is run again writes new files, and
    the index, which is written as a table, names the files of the run that
    counted.

    A null text is an empty payload, a null url has no target header, a row with
    a null key is stored and is a response unless an equal payload has a key.
    Repeated rows give repeated records; those with the largest key are all
    responses. Other columns are not read; an empty table gives no file.
    """
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    rows = pages.select(
        F.col(key_col).alias("key"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("payload"),
    )
    key_type = pages.schema[key_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _file_system(folder)
        system.create_dir(base, recursive=True)
        name, writer = None, None
        for batch in batches:
            index: list[tuple] = []
            for row in range(batch.num_rows):
                key, url, payload, digest, refers_to = (batch.column(i)[row].as_py() for i in range(5))
                if writer is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(system.open_output_stream(f"{base}/{name}", compression=None), frame_bytes)
                record = warc_record(
                    _text(key), url, payload, digest, None if refers_to is None else _text(refers_to)
                )
                index.append((key, name, *writer.add(record)))
                if writer.size >= bundle_bytes:
                    writer.close()
                    writer = None
            keys, files, frames, offsets = zip(*index) if index else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, batch.schema.field(0).type), pa.array(files, pa.string()), pa.array(frames, pa.int32()), pa.array(offsets, pa.int32())],
                names=["key", "file", "frame", "offset"],
            )
        if writer is not None:
            writer.close()

    schema = T.StructType(
        [
            T.StructField("key", key_type),
            T.StructField("file", T.StringType()),
            T.StructField("frame", T.IntegerType()),
            T.StructField("offset", T.IntegerType()),
        ]
    )
    return Archive(folder, materialize(with_responses(rows).mapInArrow(run, schema), "warc-index"))


def _text(key) -> str:
    return "\\N" if key is None else str(key)


RECORD = "key string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, file string, frame int, offset int, content binary"


def read_archive(spark: SparkSession, archive: Archive, content: bool = True) -> DataFrame:
    """All records of the indexed bundles, parsed: one row per record.

    Tasks read frames, by the seek tables, not whole bundles; a task gets about
    ``TASK_BYTES`` of unpacked frames, however few bytes name them. Keys are text. A
    revisit has no content of its own. ``content=False`` leaves payloads out.
    """
    folder = archive.folder

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _file_system(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_file(f"{base}/{name}") as source:
                    table = read_seek_table(source)
                columns = list(zip(*table)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(table), pa.string()), pa.array(range(len(table)), pa.int32()), *(pa.array(c, pa.int64()) for c in columns)],
                    names=["file", "frame", "start", "packed", "plain"],
                )

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{base}/{row['file']}") as source:
                    data = read_frame(source, (row["start"], row["packed"], row["plain"]))
                yield _parsed(data, row["file"], row["frame"], content)

    files = archive.index.select("file").distinct()
    listed = materialize(files.mapInArrow(frames, "file string, frame int, start long, packed long, plain long"), "frames")
    unpacked = listed.agg(F.sum("plain")).first()[0] or 0
    # A number that is given is not lowered by the optimizer, which sees the size of the pointers only.
    return listed.repartition(max(1, -(-unpacked // TASK_BYTES)), "file", "frame").mapInArrow(records, RECORD)


def _parsed(data: bytes, file: str, frame: int, content: bool) -> pa.RecordBatch:
    rows, at = [], 0
    while at < len(data):
        headers, body, after = parse_record(data, at)
        refers_to = headers.get("X-Refers-To-Key")
        url = headers.get("WARC-Target-URI")
        whole = refers_to is None
        rows.append(
            (
                _plain(headers["X-Record-Key"]), None if url is None else _plain(url), headers["WARC-Type"],
                None if whole else _plain(refers_to),
                len(body) if whole else int(headers["X-Payload-Length"]),
                hashlib.sha1(body).hexdigest() if whole else headers["WARC-Payload-Digest"].removeprefix("sha1:"),
                file, frame, at, body if whole and content else None,
            )
        )
        at = after
    names = ("key", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "file", "frame", "offset", "content")
    kinds = (*[pa.string()] * 4, pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=list(names))


def read_record(archive: Archive, key) -> tuple[dict[str, str], bytes]:
    """Headers and content of one record, unpacking its frame only."""
    row = archive.index.where(F.col("key") == key).first()
    system, base = _file_system(archive.folder)
    with system.open_input_file(f"{base}/{row['file']}") as source:
        data = read_frame(source, read_seek_table(source)[row["frame"]])
    headers, body, _ = parse_record(data, row["offset"])
    return headers, body
