"""WARC archives in Zstandard: one frame per record behind a dictionary frame; writing, reading, checking.

An archive starts with a skippable frame that holds the dictionary (itself a Zstandard
frame), then has one frame per record. Pages of equal payload are written once: the smallest
page_id is the response, the others are revisit records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, pick, scratch_path, shuffle_partitions

#: Magic number of the skippable frame that holds a dictionary (fixed value of the archive format).
DICTIONARY_MAGIC = 0x184D2A5D
CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
ROLL_BYTES = 64 << 20
DICTIONARY_PAGES, DICTIONARY_PAGE_BYTES, DICTIONARY_BYTES = 200, 16_384, 65_536


def page_urn(page_id) -> str:
    return f"<urn:page:{page_id}>"


def _page_id(urn: str):
    value = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "None" else int(value)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """The bytes of one response or revisit record. A revisit keeps the HTTP head, whose Content-Length is the full payload's."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    uri = "".join(c if "!" <= c <= "~" else "".join(f"%{x:02X}" for x in c.encode("utf-8", "surrogatepass")) for c in url or "urn:unknown")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {page_urn(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {page_urn(refers_to)}"]
    return "\r\n".join(head).encode() + CRLF * 2 + block + CRLF * 2


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"bad header line {line[:80]!r}")
        out[name.decode().lower()] = value.strip().decode()
    return out


def parse_record(data: bytes) -> dict:
    """A checked record: type, page_id, url, payload_bytes, payload_digest, refers_to, payload (None for a revisit)."""
    head, gap, rest = data.partition(CRLF * 2)
    lines = head.split(CRLF)
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC record")
    h = _headers(lines[1:])
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in h:
            raise ValueError(f"no {name}")
    size = int(h["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != CRLF * 2:
        raise ValueError("block doesn't have the length of its header")
    if h.get("warc-block-digest", "").removeprefix("sha1:") not in ("", base32_sha1(block)):
        raise ValueError("block digest differs")
    http, gap, payload = block.partition(CRLF * 2)
    if not gap:
        raise ValueError("no HTTP head")
    length = int(_headers(http.split(CRLF)[1:])["content-length"])
    digest, revisit = h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"] == "revisit"
    if revisit and payload:
        raise ValueError("revisit with a payload")
    if not revisit and (len(payload) != length or base32_sha1(payload) != digest):
        raise ValueError("payload differs from its header")
    return {
        "record_type": h["warc-type"], "page_id": _page_id(h["warc-record-id"]), "url": h.get("warc-target-uri"), "payload_bytes": length,
        "payload_digest": digest, "refers_to": _page_id(h["warc-refers-to"]) if revisit else None, "payload": None if revisit else payload,
    }


class ArchiveWriter:
    """One archive file at ``path``: complete only once ``close`` has put it in place."""

    def __init__(self, path: str, dictionary: bytes | None):
        self.path, self.part = path, f"{path}.part"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        self.file, self.records, self.bytes = open(self.part, "wb"), 0, 0  # noqa: SIM115
        d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compress = zstandard.ZstdCompressor(level=3, dict_data=d, write_checksum=True).compress
        if dictionary:
            packed = zstandard.ZstdCompressor(level=9).compress(dictionary)
            self._put(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.bytes += len(data)

    def add(self, data: bytes) -> None:
        self._put(self.compress(data))
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.file.close()
        os.replace(self.part, self.path)
        return self.path, self.records, self.bytes


def read_archive(path: str, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records' bytes, frame by frame; memory holds a chunk and a record."""
    with open(path, "rb") as f:
        head = f.read(8)
        dictionary = None
        if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_MAGIC:
            raw = f.read(struct.unpack("<I", head[4:])[0])
            if raw[:4] == b"\x28\xb5\x2f\xfd":
                raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
            dictionary, head = zstandard.ZstdCompressionDict(raw), b""
        engine = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
        data, frame, out = head, None, []
        while True:
            data = data or f.read(chunk)
            if not data:
                break
            frame = frame or engine.decompressobj()
            out.append(frame.decompress(data))
            data = b""
            if frame.eof:
                data, frame = frame.unused_data, None
                yield b"".join(out)
                out = []
        if frame is not None:
            raise ValueError(f"{path} ends within a frame")


def local_path(uri: str) -> str:
    """Archives are written by Python, so the shared folder has to be a mounted one."""
    if "://" in uri and not uri.startswith("file://"):
        raise ValueError(f"archives need a mounted shared folder, not {uri}")
    return "/" + uri.removeprefix("file://").removeprefix("file:").lstrip("/")


def train_dictionary(pages: DataFrame) -> bytes | None:
    """From the heads of DICTIONARY_PAGES pages at most; it bears on size alone. None if there is too little text."""
    rows = pages.where("html is not null").limit(DICTIONARY_PAGES).select(F.substring(F.col("html").cast("binary"), 1, DICTIONARY_PAGE_BYTES).alias("h")).collect()
    samples = [bytes(r.h) for r in rows if r.h]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 16 else None
    except zstandard.ZstdError:
        return None


def classify(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, revisit, refers_to``: which pages repeat a payload of at least ``least_bytes``."""
    src = pick(pages, "page_id", "url", "html").select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    src = src.withColumn("digest", F.sha1("payload"))
    first = src.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("least"))
    joined = src.join(first, "digest", "left")
    revisit = F.coalesce(F.col("page_id") != F.col("least"), F.col("page_id").isNull() & F.col("least").isNotNull())
    return joined.select("page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("least")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write every page as a record; the manifest ``path, records, bytes`` of the archives that count.

    A task writes files under names of its own attempt and reports them in the manifest, so
    what a lost or repeated attempt leaves is never read.
    """
    dictionary, root = train_dictionary(pick(pages, "html")), local_path(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done = None, []
        for b in batches:
            for page_id, url, payload, revisit, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    out = ArchiveWriter(f"{root}/{uuid.uuid4().hex}.warc.zst", dictionary)
                out.add(record(page_id, url, payload, base32_sha1(payload), refers_to, revisit))
                if out.bytes >= ROLL_BYTES:
                    done.append(out.close())
                    out = None
        if out is not None:
            done.append(out.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["path", "records", "bytes"])

    return materialise(classify(pages, least_bytes).mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """A row per record of the archives in a manifest, each checked; a damaged one raises ValueError."""
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()} | ({"payload": pa.binary()} if payloads else {})

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                for data in read_archive(path):
                    rows.append(parse_record(data))
                    if len(rows) >= 500:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return manifest.select("path").repartition(shuffle_partitions(manifest.sparkSession), "path").mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder, read them back: a row per page.

    page_id, payload_bytes, payload_digest (bare upper-case base32 SHA-1), record_type,
    refers_to. Null html is an empty payload, and empty payloads count as equal. Rows that
    repeat a page's id and payload are a record each, of the same type. A null page_id is a
    revisit where its payload has a page with an id, else a response. A null url becomes
    ``urn:unknown``. Other columns play no part. No pages, no archives, no rows.
    """
    manifest = write_archives(pages, scratch_path(pages.sparkSession, "warc"), least_bytes)
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
