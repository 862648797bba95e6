"""WARC archives whose records are Zstandard frames that share a dictionary.

Every archive is one complete ``.warc.zst`` file: a skippable frame (magic 0x184D2A5D) that holds the dictionary, then one
frame for each record. The dictionary is built once, on the driver, from a bounded sample of the records to be archived
(``SAMPLE`` rows, of each payload at most ``SAMPLE_BYTES`` bytes). Where the samples are too few or too alike to train
on, the dictionary is their own bytes. Only a table without rows has none, and no archive either.

Of pages with equal payloads of at least ``least`` bytes the one with the largest page_id is a response and the others
are revisits that refer to it and carry no payload; smaller payloads are always responses. The plan is a written table of
the digests that repeat: pages meet it by broadcast while it is small, else in a join whose hot digests Spark can split,
as both sides are plain. Payloads below ``least`` bytes take no part in that.

Archives are rows (name, bytes) of a table in the shared folder, each of about ``ARCHIVE`` bytes, so any file system that
Spark writes can hold them and a lost executor costs only its tasks; ``export`` writes them as files.

Payload: the text column in UTF-8, null as empty. Rows that repeat are records of their own: those that repeat the
response's page_id are responses too. A null page_id is kept, never refers to itself, and where all page_ids of a payload
are null, all are responses. Urls are percent-encoded where a header line could not hold them; a null url becomes
``urn:page:<page_id>``. Extra columns are ignored. An empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

ARCHIVE, LEAST = 8 << 20, 1000
SAMPLE, SAMPLE_BYTES, DICTIONARY = 1000, 32_000, 64 << 10
#: Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
_UNSAFE = re.compile(r"[\x00-\x20\x7f-￿<>\"]")


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id, url, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC record. A revisit holds the response's HTTP header, whose Content-Length is the full payload's."""
    target = _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "surrogatepass")), url) if url else f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}"]
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers, HTTP headers and payload of a record's bytes."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


class Writer:
    """Gathers records of one archive."""

    def __init__(self, dictionary: bytes | None, level: int = 3):
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compress = zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=True).compress
        self.lead = struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary if dictionary else b""
        self.reset()

    def reset(self) -> None:
        self.parts, self.size = [self.lead], 0

    def add(self, raw: bytes) -> None:
        self.parts.append(self.compress(raw))
        self.size += len(self.parts[-1])

    def bytes(self) -> bytes:
        return b"".join(self.parts)


def records(archive: bytes):
    """The bytes of each record of an archive."""
    at, data = 0, None
    if archive[:4] == struct.pack("<I", SKIPPABLE):
        size = struct.unpack("<I", archive[4:8])[0]
        data, at = zstandard.ZstdCompressionDict(archive[8 : 8 + size]), 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=data)
    view = memoryview(archive)
    while at < len(archive):
        frame = reader.decompressobj()
        parts = [frame.decompress(view[at : at + 65536])]
        seen = min(65536, len(archive) - at)
        while not frame.eof and at + seen < len(archive):
            parts.append(frame.decompress(view[at + seen : at + seen + 65536]))
            seen += min(65536, len(archive) - at - seen)
        if not frame.eof:
            raise ValueError("an archive ends within a frame")
        yield b"".join(parts)
        at += seen - len(frame.unused_data)


def dictionary(rows: DataFrame, size: int = DICTIONARY) -> bytes | None:
    """Built from the records of a bounded sample of rows (id, url, payload, digest); None without rows."""
    # by a hash below a bound that lets about twice the sample through, so tasks never hand on more than that together
    near = F.pmod(F.xxhash64("digest", "id"), F.lit(1 << 40))
    bound = (1 << 40) * (2 * SAMPLE + 16) // max(1, rows.count())
    some = rows.where(near < F.lit(min(bound, 1 << 40))).withColumn("payload", F.substring("payload", 1, SAMPLE_BYTES)).orderBy(near, "id").limit(SAMPLE).collect()
    return trained([record(r["id"], r["url"], bytes(r["payload"]), r["digest"]) for r in some], size)


def trained(samples: list[bytes], size: int = DICTIONARY) -> bytes | None:
    """A dictionary trained on the samples, or their own last bytes where the trainer finds too little in them."""
    whole = sum(map(len, samples))
    if not whole:
        return None
    try:
        return zstandard.train_dictionary(min(size, max(1024, whole // 10)), samples, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _write(trained, level: int, archive_bytes: int):
    def run(batches):
        from pyspark import TaskContext

        name, n, writer = f"part-{TaskContext.get().partitionId():06d}", 0, Writer(trained, level)

        def full():
            return pa.RecordBatch.from_arrays([pa.array([f"{name}-{n:05d}.warc.zst"]), pa.array([writer.bytes()], pa.binary())], names=["name", "bytes"])

        for batch in batches:
            ids, urls, digests, refers, again = (batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5))
            for i in range(batch.num_rows):
                writer.add(record(ids[i], urls[i], batch.column(2)[i].as_py(), digests[i], refers[i], again[i]))
                if writer.size >= archive_bytes:
                    yield full()
                    writer.reset()
                    n += 1
        if writer.size:
            yield full()

    return run


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = LEAST, level: int = 3, archive_bytes: int = ARCHIVE) -> tuple[DataFrame, str]:
    """A table (name, bytes) of archives with a record for each page, and its path."""
    shared.prepared(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= least)
    plan = large.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null").drop("n")
    plan, _ = shared.written(plan, "plan")
    met = large.join(plan, "digest", "left").select("id", "url", "payload", "digest", "refers_to")
    met = met.union(rows.where(F.octet_length("payload") < least).select("id", "url", "payload", "digest", F.lit(None).cast("long")))
    again = F.col("refers_to").isNotNull() & ~F.col("id").eqNullSafe(F.col("refers_to"))
    made = met.withColumn("again", again).mapInArrow(_write(dictionary(rows), level, archive_bytes), "name string, bytes binary")
    return shared.written(made, "warc", codec="none")


_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(with_payload: bool):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                out = []
                for raw in records(batch.column(1)[i].as_py()):
                    fields, http, payload = parse(raw)
                    said = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    page = fields.get("X-Page-Id")
                    again = fields["WARC-Type"] == "revisit"
                    if not again and hashlib.sha1(payload).hexdigest() != said:
                        raise ValueError("a payload doesn't have its record's digest")
                    size = int(http["Content-Length"]) if again else len(payload)
                    out.append((None if page is None else int(page), size, said, fields["WARC-Type"], int(fields["X-Refers-To-Page-Id"]) if again else None, fields["WARC-Target-URI"], None if again else payload))
                columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                if with_payload:
                    columns += [pa.array([r[5] for r in out], pa.string()), pa.array([r[6] for r in out], pa.binary())]
                    names += ["target_uri", "payload"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def read(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row for each record of a table (name, bytes) of archives; payload digests are checked."""
    shared.prepared(archives.sparkSession)
    return archives.select("name", "bytes").mapInArrow(_read(with_payload), _RECORD + (", target_uri string, payload binary" if with_payload else ""))


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Write the archives as files to a folder that all executors mount; returns (name, size). A repeated task rewrites alike."""
    shared.prepared(archives.sparkSession)

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
                with open(part, "wb") as out:
                    out.write(raw)
                os.replace(part, os.path.join(folder, name))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(raw)], pa.int64())], names=["name", "size"])

    return archives.select("name", "bytes").mapInArrow(run, "name string, size long")
