"""Zstandard-compressed WARC archives: one frame per record, the dictionary in a leading skippable frame.

An archive begins with a skippable frame that holds the dictionary of all its record frames (itself compressed or not, or nothing). Each
record is one zstandard frame. Spark's own writer commits the files, so that a lost executor leaves no half archive: each frame is a
row, and the writer ends each row with an empty skippable frame, which every zstandard reader passes over.

Equal payloads are stored once: of their records one is a ``response``, the others are ``revisit`` records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession, functions as F

from planloom.llm.packing import handed, tidy
from planloom.llm.token_store import open_shard
from planloom.session import scratch_path

# Frames and dictionaries of the archive format.
DICT_MAGIC = 0x184D2A5D
_SKIP_FIRST, _SKIP_LAST = 0x184D2A50, 0x184D2A5F
_FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
_DICT_HEAD = b"\x37\xa4\x30\xec"
# Names of the record format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESPONSE, REVISIT = "response", "revisit"
_URN = "urn:page:"

#: An empty skippable frame, the writer's line separator.
_BETWEEN = "\x50\x2a\x4d\x18\x00\x00\x00\x00"
#: A dictionary of this size is trained on the first records of an archive, of about this many bytes.
DICT_BYTES = 64 << 10
SAMPLE_BYTES = 2 << 20
LEVEL = 3
_READ = 1 << 20
_HEAD_LIMIT = 64 << 10
#: Without a date of its own a record has this one, so that equal tables give equal archives.
DATE = "2000-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\r\n]+", " ", value)


def _urn(page_id: int | None) -> str:
    return f"<{_URN}{'null' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    found = re.fullmatch(rf"<{_URN}(null|-?\d+)>", urn)
    if found is None:
        raise ValueError(f"WARC: not a record id of a page: {urn[:80]}")
    return None if found[1] == "null" else int(found[1])


def record_of(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One record. A revisit has the head of the response only; digest and length stay those of the whole payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [VERSION, f"WARC-Type: {REVISIT if revisit else RESPONSE}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}",
             *([] if url is None else [f"WARC-Target-URI: {_clean(url)}"]), f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
             f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
             *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"] if revisit else []),
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_of(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary, or nothing if there is too little to train on."""
    try:
        return zstd.train_dictionary(size, samples).as_bytes()
    except zstd.ZstdError:
        return b""


def leading_frame(dictionary: bytes) -> bytes:
    """The skippable frame that holds a dictionary, compressed."""
    data = zstd.ZstdCompressor(level=19).compress(dictionary) if dictionary else b""
    return DICT_MAGIC.to_bytes(4, "little") + len(data).to_bytes(4, "little") + data


def archive_frames(records: Iterator[bytes], level: int = LEVEL) -> Iterator[bytes]:
    """The frames of an archive; only its first ``SAMPLE_BYTES`` are held."""
    first: list[bytes] = []
    size = 0
    for record in records:
        first.append(record)
        size += len(record)
        if size >= SAMPLE_BYTES:
            break
    if not first:
        return
    dictionary = dictionary_of(first)
    yield leading_frame(dictionary)
    used = {"dict_data": zstd.ZstdCompressionDict(dictionary)} if dictionary else {}
    packer = zstd.ZstdCompressor(level=level, write_checksum=True, write_content_size=True, **used)
    for part in (first, records):
        for record in part:
            yield packer.compress(record)


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write ``pages`` (page_id, url, html), an archive per partition, to the new folder ``path``.

    * A null html is an empty payload; a null url has no target header.
    * Of equal payloads of at least ``least`` bytes that with the largest ``page_id`` is the response; rows that share that id are all
      responses. A null ``page_id`` is below all others. Shorter payloads are responses.
    * A payload is found equal by its SHA-1 and length. A payload that most pages share is one row of the small side of a join, so that
      adaptive execution may split it. Further columns are not looked at.
    """
    rows = handed(pages).select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                                F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    key = [F.sha1("html").alias("sha1"), F.octet_length("html").alias("size")]
    keepers = (rows.select("page_id", *key).where(F.col("size") >= least).groupBy("sha1", "size")
               .agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n"))
    known = rows.select("*", *key).join(keepers, ["sha1", "size"], "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    given = known.select("page_id", "url", F.col("html").cast("binary").alias("payload"), "keeper", revisit.alias("revisit"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for page_id, url, payload, keeper, again in zip(*(c.to_pylist() for c in batch.columns)):
                    yield record_of(page_id, url, payload, keeper, again)
        for some in _gathered(archive_frames(records())):
            yield pa.record_batch([pa.array(some, pa.binary())], ["frame"])

    (given.mapInArrow(run, "frame binary").select(F.col("frame").cast("string")).write
     .option("lineSep", _BETWEEN).option("compression", "none").text(path))


def _gathered(frames: Iterator[bytes], size: int = 4 << 20) -> Iterator[list[bytes]]:
    held: list[bytes] = []
    total = 0
    for frame in frames:
        held.append(frame)
        total += len(frame)
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


class _Stream:
    """Bytes of a file with a look ahead."""

    def __init__(self, file: BinaryIO):
        self.file, self.held, self.at = file, b"", 0

    def peek(self, n: int) -> bytes:
        while len(self.held) < n and (more := self.file.read(_READ)):
            self.held += more
        return self.held[:n]

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        if len(out) < n:
            raise ValueError(f"WARC archive: cut off at byte {self.at}")
        self.held = self.held[n:]
        self.at += n
        return out

    def frame(self, packer: zstd.ZstdDecompressor) -> bytes:
        """The contents of the zstandard frame that begins here."""
        one, out, at = packer.decompressobj(), [], self.at
        while not one.eof:
            if not self.peek(1):
                raise ValueError(f"WARC archive: the frame at byte {at} is cut off")
            try:
                out.append(one.decompress(self.held))
            except zstd.ZstdError as error:
                raise ValueError(f"WARC archive: the frame at byte {at} is damaged: {error}") from None
            self.at += len(self.held) - len(one.unused_data)
            self.held = one.unused_data
        return b"".join(out)


def _skipped(stream: _Stream) -> bytes | None:
    """The contents of the skippable frame that begins here; None if another frame does."""
    if not _SKIP_FIRST <= int.from_bytes(stream.peek(4), "little") <= _SKIP_LAST:
        return None
    return stream.take(int.from_bytes(stream.take(8)[4:], "little"))


def archive_records(file: BinaryIO) -> Iterator[bytes]:
    """The decoded frames of an archive, each one record; one record is held at a time."""
    stream, used = _Stream(file), {}
    if int.from_bytes(stream.peek(4), "little") == DICT_MAGIC:
        data = _skipped(stream)
        if data.startswith(_FRAME_MAGIC):
            data = zstd.ZstdDecompressor().decompressobj().decompress(data)
        if data:
            if not data.startswith(_DICT_HEAD):
                raise ValueError("WARC archive: the leading frame holds no dictionary")
            used = {"dict_data": zstd.ZstdCompressionDict(data)}
    packer = zstd.ZstdDecompressor(**used)
    while stream.peek(1):
        if _skipped(stream) is None:
            if not stream.peek(4).startswith(_FRAME_MAGIC):
                raise ValueError(f"WARC archive: no frame at byte {stream.at}")
            yield stream.frame(packer)


def _fields(head: bytes, what: str) -> tuple[str, dict[str, str]]:
    """The first line, and the named fields by lower-case name."""
    first, *lines = head.decode("utf-8", "surrogateescape").split("\r\n")
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise ValueError(f"{what}: not a header line: {line[:80]!r}")
        if name.lower() in out:
            raise ValueError(f"{what}: {name} is given twice")
        out[name.lower()] = value.strip()
    return first, out


def _length(fields: dict[str, str], what: str) -> int:
    value = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]+", value):
        raise ValueError(f"{what}: no Content-Length")
    return int(value)


def parsed(record: bytes) -> dict:
    """Type, ids, payload and its digest of one record; whatever its headers and lengths say is checked against what it holds."""
    end = record.find(b"\r\n\r\n", 0, _HEAD_LIMIT)
    if end < 0:
        raise ValueError("WARC record: its header has no end")
    version, fields = _fields(record[:end], "WARC record")
    what = f"WARC record {fields.get('warc-record-id', '?')}"
    if not re.fullmatch(r"WARC/1\.[01]", version):
        raise ValueError(f"{what}: not a version: {version[:40]!r}")
    for name in ("warc-type", "warc-record-id", "warc-date"):
        if not fields.get(name):
            raise ValueError(f"{what}: no {name}")
    size = _length(fields, what)
    block = record[end + 4:end + 4 + size]
    if len(record) != end + 4 + size + 4 or record[-4:] != b"\r\n\r\n":
        raise ValueError(f"{what}: Content-Length is {size}, the frame holds {len(record) - end - 8}")
    if "warc-block-digest" in fields and fields["warc-block-digest"] != "sha1:" + base32_sha1(block):
        raise ValueError(f"{what}: the block has another digest")
    kind = fields["warc-type"]
    if kind not in (RESPONSE, REVISIT):
        raise ValueError(f"{what}: unexpected type {kind[:40]!r}")
    cut = block.find(b"\r\n\r\n")
    if cut < 0 or not block.startswith(b"HTTP/"):
        raise ValueError(f"{what}: the block is no HTTP response")
    payload_bytes = _length(_fields(block[:cut], what)[1], what)
    payload, digest = block[cut + 4:], fields.get("warc-payload-digest", "")
    if kind == RESPONSE:
        if len(payload) != payload_bytes:
            raise ValueError(f"{what}: a payload of {len(payload)} bytes, its header says {payload_bytes}")
        if digest and digest != "sha1:" + base32_sha1(payload):
            raise ValueError(f"{what}: the payload has another digest")
        digest = digest or "sha1:" + base32_sha1(payload)
    elif payload or not fields.get("warc-refers-to") or fields.get("warc-profile") != PROFILE or not digest.startswith("sha1:"):
        raise ValueError(f"{what}: not a revisit of an identical payload")
    return {"page_id": _page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": kind,
            "refers_to": _page(fields["warc-refers-to"]) if kind == REVISIT else None, "payload_bytes": payload_bytes,
            "payload_digest": digest.removeprefix("sha1:"), "payload": payload if kind == RESPONSE else None}


_COLUMNS = [("page_id", pa.int64(), "bigint"), ("url", pa.string(), "string"), ("payload_bytes", pa.int64(), "bigint"),
            ("payload_digest", pa.string(), "string"), ("record_type", pa.string(), "string"), ("refers_to", pa.int64(), "bigint"),
            ("payload", pa.binary(), "binary")]


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """A row for each record of the archives in ``path``, in any file system that Arrow knows; each is read as a stream, in one task.

    Every record is decoded and checked; a damaged archive ends the query with an error that names the place. A revisit
    has no payload of its own. Without ``payload`` that column is left out.
    """
    columns = [c for c in _COLUMNS if payload or c[0] != "payload"]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("path")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[dict]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[name] for r in rows], kind) for name, kind, _ in columns], [c[0] for c in columns])
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows, size = [], 0
                with open_shard(file) as opened:
                    for record in archive_records(opened):
                        rows.append(parsed(record))
                        size += 200 + (len(record) if payload else 0)
                        if size > 4 << 20:
                            yield made(rows)
                            rows, size = [], 0
                yield made(rows)
    # a task for each archive: their paths are so few bytes that adaptive execution would put them all into one
    return files.repartition(max(1, files.count())).mapInArrow(run, ", ".join(f"{name} {kind}" for name, _, kind in columns))


def archived(pages: DataFrame, path: str | None = None, least: int = 0) -> DataFrame:
    """Write ``pages`` as archives and read them back: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to``.

    Cases as in ``write_archives``: one row per row of ``pages``; a payload of any length is one record; an empty table gives no rows.
    """
    path = path or scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, least)
    return read_archives(pages.sparkSession, path, payload=False)
