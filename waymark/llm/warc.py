"""WARC archives with Zstandard: one frame a record, dictionary in a leading skippable frame.

``write_archives`` writes records into the session's shared folder and returns the list of files;
``read_archives`` reads such files: it loads the dictionary from the leading skippable frame,
decodes one frame for each record and validates the version line, the named headers, the lengths
and the digests.

Defined results: a null html is an empty payload; a null url leaves out WARC-Target-URI; rows with
a null page_id are all responses that nothing refers to; of rows that repeat both page_id and
payload of the response one is the response and the others revisit it; empty tables give no
archives and no records. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import heavy_join, materialize, shared_dir

SKIPPABLE = 0x184D2A5D
DICTIONARY_BYTES = 16_384
#: Records from which an archive's dictionary is trained.
SAMPLE_RECORDS = 128
#: An archive ends after so many bytes of records; the next record begins another.
ARCHIVE_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_KNOWN, _NAMELESS = 0x776179, 0x6E616D  # the first three bytes of record ids
_READ = 1 << 20

FILES = "path string, records long, bytes long"
RECORDS = "page_id long, url string, record_type string, record_id string, refers_to_id string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, copy: int, digest: str, url: str | None = None) -> str:
    """A urn whose lower half is the page_id; its upper half tells payloads and copies of one page_id apart."""
    mark, lower = (_KNOWN, page_id) if page_id is not None else (_NAMELESS, int.from_bytes(hashlib.sha1(f"{digest} {url}".encode()).digest()[:8], "big"))
    turn = f" {copy // 256}" if copy >= 256 else ""
    upper = mark << 40 | int.from_bytes(hashlib.sha1(f"{digest}{turn}".encode()).digest()[:4], "big") << 8 | copy % 256
    return f"<urn:uuid:{uuid.UUID(int=upper << 64 | lower % (1 << 64))}>"


def page_of(urn: str) -> int | None:
    """The page_id within a record id; None if it had none."""
    value = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int
    if value >> 104 != _KNOWN:
        return None
    low = value % (1 << 64)
    return low - (1 << 64) if low >> 63 else low


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, copy: int = 0) -> bytes:
    """The bytes of one response record, or of a revisit if refers_to is given."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, copy, digest, url)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, 0, digest)}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(record: bytes) -> dict:
    """The parts of one record; ValueError where a header is missing or a length or digest is wrong."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError("not a WARC record")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"not a header: {line[:80]!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"no {name} header")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("the record's length differs from Content-Length")
    block = rest[:-4]
    if (told := headers.get("warc-block-digest")) and told != f"sha1:{base32_sha1(block)}":
        raise ValueError("the block's digest differs")
    http, gap, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if headers["warc-type"] == "response" and (not gap or digest and digest != base32_sha1(payload) or length and int(length[1]) != len(payload)):
        raise ValueError("the payload's length or digest differs")
    return {"type": headers["warc-type"], "id": headers["warc-record-id"], "url": headers.get("warc-target-uri"), "refers_to": headers.get("warc-refers-to"), "digest": digest, "payload": payload, "payload_bytes": int(length[1]) if length else len(payload)}


def _dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:  # too little to train on: the samples themselves
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(out, records: Iterator[bytes]) -> tuple[int, int]:
    """Write a dictionary frame and a frame for each record until ARCHIVE_BYTES; records and bytes written."""
    samples, done, size = [], 0, 0
    for r in records:
        samples.append(r)
        size += len(r)
        if len(samples) >= SAMPLE_RECORDS or size >= ARCHIVE_BYTES:
            break
    trained = _dictionary(samples)
    data = trained.as_bytes()
    out.write(struct.pack("<II", SKIPPABLE, len(data)) + data)
    squeeze = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True, write_content_size=True)

    written = 8 + len(data)
    total = 0
    # chain() has no close(): leaving the loop must not end the caller's iterator, which the next archive reads on.
    for r in chain(samples, records if size < ARCHIVE_BYTES else ()):
        written += out.write(squeeze.compress(r)) or 0
        done += 1
        total += len(r)
        if total >= ARCHIVE_BYTES and done >= len(samples):
            break
    return done, written


def read_archive(source) -> Iterator[bytes]:
    """The records of one archive, one frame each; holds one record at a time."""
    head = source.read(8)
    if not head:
        return
    magic, size = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame leads the archive")
    data = source.read(size)
    if len(data) != size:
        raise ValueError("the dictionary frame is cut short")
    if data[:4] == b"\x28\xb5\x2f\xfd":
        data = zstandard.ZstdDecompressor().decompress(data)
    expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
    left = source.read(_READ)
    while left:
        frame, parts = expand.decompressobj(), []
        while True:
            parts.append(frame.decompress(left))
            if frame.eof:
                left = frame.unused_data or source.read(_READ)
                break
            if not (left := source.read(_READ)):
                raise ValueError("the last frame is cut short")
        yield b"".join(parts)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def with_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, refers_to (null for a response), same (rows with this page_id and payload).

    Which rows share a payload is found on digests alone; each html moves once, by its own page_id,
    so that a payload that many pages share spreads over all tasks.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    ids = materialize(rows.where("page_id is not null").groupBy("digest", "page_id").agg(F.count("*").alias("same")), "digests")
    firsts = ids.groupBy("digest").agg(F.max("page_id").alias("first"), F.sum("same").alias("n"), F.count("*").alias("ids")).where("n > 1")
    shared = heavy_join(ids, materialize(firsts, "shared-digests"), "digest", "ids").select("digest", "page_id", "same", "first")
    # Co-partitioned by hand, so that repeats of one row stay in one task and no split parts them.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["page_id", "digest"]
    met = rows.repartition(parts, *keys).join(shared.repartition(parts, *keys), keys, "left")
    return met.select("page_id", "url", "html", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"), F.coalesce("same", F.lit(1)).alias("same"))


def write_archives(rows: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the rows of with_verdicts() as archives; one row for each file: path, records, bytes.

    A task that is run again writes files of new names, and only the names that its last run
    returned count; the list itself is kept in the shared folder.
    """
    folder = folder or f"{shared_dir(rows.sparkSession)}/waymark/warc-{uuid.uuid4().hex}"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _open(folder)
        seen: dict[tuple[int, str], int] = {}
        read = written = 0

        def records() -> Iterator[bytes]:
            nonlocal read
            for pdf in batches:
                read += len(pdf)
                for page, url, html, refers, same in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["refers_to"], pdf["same"], strict=True):
                    payload = html.encode("utf-8", "surrogatepass")
                    page = None if pd.isna(page) else int(page)
                    refers, copy = None if pd.isna(refers) else int(refers), 0
                    if same > 1 and page is not None:  # repeats of one page_id and payload
                        key = (page, hashlib.sha1(payload).hexdigest())
                        copy = seen[key] = seen.get(key, -1) + 1
                        refers = page if refers is None and copy else refers
                    yield encode_record(page, url, payload, refers, copy)

        stream = records()
        for first in stream:
            store.create_dir(base, recursive=True)
            name = f"{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{base}/{name}.part", compression=None) as out:
                done, size = write_archive(out, chain([first], stream))
            store.move(f"{base}/{name}.part", f"{base}/{name}")
            written += done
            yield pd.DataFrame({"path": [f"{folder}/{name}"], "records": [done], "bytes": [size]})
        if written != read or next(batches, None) is not None:
            raise RuntimeError(f"{written} records were written of {read} rows read")

    typed = rows.withColumn("page_id", F.col("page_id").cast("string")).withColumn("refers_to", F.col("refers_to").cast("string"))
    return materialize(typed.mapInPandas(write, FILES), "archives")


def read_archives(files: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives listed in column path; without payloads that column is null."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        for pdf in batches:
            for path in pdf["path"]:
                store, at = _open(path)
                rows: list[tuple] = []
                held = 0
                with store.open_input_stream(at, compression=None) as source:
                    for record in read_archive(source):
                        r = decode_record(record)
                        page, refers = page_of(r["id"]), r["refers_to"]
                        rows.append((page, r["url"], r["type"], r["id"], refers, refers and page_of(refers), r["payload_bytes"], r["digest"], r["payload"] if payloads else None))
                        held += len(r["payload"]) if payloads else 300
                        if held > 16 << 20:
                            yield _frame(rows, names)
                            rows, held = [], 0
                if rows:
                    yield _frame(rows, names)

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path").repartition(parts, "path").mapInPandas(read, RECORDS)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    for c in ("page_id", "refers_to", "payload_bytes"):
        out[c] = pd.array(list(out[c]), dtype="Int64")
    return out


def resolve_revisits(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; a revisit's payload is that of its response.

    The archives are decoded once. Revisits are gathered by what they say of their response before
    they meet it, so that a response with any number of revisits meets one row. A revisit whose
    response was not read, or has another digest or length, raises ValueError.
    """
    records = materialize(records.drop("payload"), "records")
    told = ["payload_digest", "payload_bytes"]
    asked = records.where("record_type = 'revisit'").groupBy(F.col("refers_to_id").alias("record_id"), *told).agg(F.min("page_id").alias("page_id"))
    answers = records.where("record_type = 'response'").select("record_id", *told)
    if bad := asked.join(answers, ["record_id", *told], "left_anti").take(1):
        raise ValueError(f"the revisit of page {bad[0].page_id} does not match its response")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as archives and read them back: one row for each page."""
    files = write_archives(with_verdicts(pages))
    return resolve_revisits(read_archives(files, payloads=False))
