"""Questions from batches of documents to buckets of keys, and answers back, in packed rows.

``stage`` writes documents as batches: one row holds the ids, lengths and compressed text of up to 2 MB of documents. A
batch asks about its distinct keys: for each bucket that these hash to, it sends one packed row. A bucket sees at most
one question about a key from each batch, however many documents hold the key, so a key that a third of all documents
share weighs no more than the number of batches. Answers return to the batch, which meets its own text again in a
cogroup by batch; batches are bounded, so nothing there is skewed.

Rows are few, and what is in them is sorted and counted by NumPy; the number of buckets grows with the text. A packed row
holds about batch * bucket / (text * 14 bytes) keys, so both sizes grow with the root of the text: 2 and 6 MB up to 16 GB
of text, 16 MB at 1 TB, 160 MB at 100 TB. That also bounds how often a key that every batch holds reaches its bucket.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, text

#: Bytes of text in a batch, and for each bucket of keys.
BATCH_BYTES = 2 << 20
BUCKET_BYTES = 6 << 20
#: Keys that a packed row shall hold, times the bytes of text for each key.
ROW = 256
_BATCH = "batch long, n_bytes long, ids binary, lengths binary, text binary"
ANSWER = "batch long, kind int, bucket int, blob binary"


def squeeze(raw: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(raw)


def expand(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def _staged(most: int):
    """Batches of up to ``most`` bytes of documents, or of one longer document, across the record batches that come."""

    def run(batches):
        base, n = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def whole() -> pa.RecordBatch:
            ids, lengths, data = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort(ids.T[::-1])
            if (np.diff(order) < 0).any():  # documents lie in the order of their ids
                ends = np.cumsum(lengths)
                data = np.concatenate([data[ends[k] - lengths[k] : ends[k]] for k in order.tolist()])
                ids, lengths = ids[order], lengths[order]
            row = (base + n, len(data), ids.astype("<i8").tobytes(), lengths.astype("<i8").tobytes(), squeeze(data.tobytes(), 3))
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["batch", "n_bytes", "ids", "lengths", "text"])

        for rows, data, offsets in text.documents(batches, 0, most):
            if held and sum(len(x[2]) for x in held) + len(data) > most:
                yield whole()
                n += 1
                held.clear()
            ids = np.stack([np.asarray(rows.column(k)) for k in range(1, rows.num_columns)], axis=1)
            held.append((ids, np.diff(offsets), data.copy()))
        if held:
            yield whole()

    return run


def stage(docs: DataFrame, *more: str, like: DataFrame | None = None) -> tuple[DataFrame, str, int]:
    """Batches of (id, text) rows whose ids are not null, their path, and how many buckets keys go to.

    With further long columns (``more``) a batch's ids are rows of (id, *more). ``like``, if given, is the table whose size
    as Spark estimates it sizes the batches: a scan has one, what was joined on the way has not.
    """
    size = int(str((docs if like is None else like)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    most = max(BATCH_BYTES, math.isqrt(ROW * size) if size < 1 << 55 else 0)  # beyond that it is unknown
    staged, path = shared.written(docs.select("text", "id", *more).mapInArrow(_staged(most), _BATCH), "batches", codec="none")
    total = staged.agg(F.sum("n_bytes")).first()[0] or 0
    return staged, path, max(1, -(-total // max(BUCKET_BYTES, math.isqrt(ROW * total))))


def opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, bytes and offsets of a batch's documents."""
    lengths, ids = np.frombuffer(row["lengths"], "<i8"), np.frombuffer(row["ids"], "<i8")
    if len(ids) > len(lengths):
        ids = ids.reshape(len(lengths), -1)
    return ids, np.frombuffer(expand(row["text"]), np.uint8), np.concatenate([[0], np.cumsum(lengths)])


def ask(staged: DataFrame, n: int, question) -> DataFrame:
    """Questions (bucket, batch, blob) of every batch; ``question(ids, data, offsets, n)`` yields (bucket, blob)."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):  # a row is megabytes: one at a time
                row = batch.slice(k, 1).to_pylist()[0]
                out = list(question(*opened(row), n))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([row["batch"]] * len(out), pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "batch", "blob"])

    return staged.mapInArrow(run, "bucket int, batch long, blob binary")


def answer(questions: DataFrame, kind: int, respond) -> DataFrame:
    """``respond(blobs)`` takes a bucket's blobs and returns one answer or None for each."""

    def run(group: pa.Table) -> pa.Table:
        got = respond(group["blob"].to_pylist())
        keep = [(b, x) for b, x in zip(group["batch"].to_pylist(), got, strict=True) if x is not None]
        bucket = group["bucket"][0].as_py()
        return pa.table({"batch": pa.array([b for b, _ in keep], pa.int64()), "kind": pa.array([kind] * len(keep), pa.int32()), "bucket": pa.array([bucket] * len(keep), pa.int32()), "blob": pa.array([x for _, x in keep], pa.binary())})

    return questions.groupBy("bucket").applyInArrow(run, ANSWER)


def meet(staged: DataFrame, answers: DataFrame, act, schema: str) -> DataFrame:
    """``act(batch, ids, data, offsets, answers)`` yields tables of ``schema``; answers[kind][bucket] is a blob."""

    def run(batch: pa.Table, got: pa.Table) -> pa.Table:
        by: dict[int, dict[int, bytes]] = {}
        for kind, bucket, blob in zip(*(got[k].to_pylist() for k in ("kind", "bucket", "blob")), strict=True):
            by.setdefault(kind, {})[bucket] = blob
        tables = [t for row in batch.to_pylist() for t in act(row["batch"], *opened(row), by)]
        return pa.concat_tables(tables) if tables else pa.Table.from_batches([], empty)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    empty = to_arrow_schema(StructType.fromDDL(schema))
    return staged.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(run, schema)


# -- which keys lie in two documents or more ---------------------------------------------------------------------------


def split_keys(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit keys as bucket << 32 | low half, sorted, and the place of each key among them."""
    return np.unique(((keys >> np.uint64(32)) % np.uint64(n)) << np.uint64(32) | (keys & np.uint64(0xFFFFFFFF)), return_inverse=True)


def by_bucket(found: np.ndarray):
    """(bucket, from, to) over sorted bucket << 32 | low keys."""
    bucket = (found >> np.uint64(32)).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(bucket[a]), int(a), int(b)


def low_halves(found: np.ndarray):
    for bucket, a, b in by_bucket(found):
        yield bucket, (found[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()


def in_two_batches(blobs: list[bytes]) -> list[bytes | None]:
    """For each blob of distinct low halves, the bits of those that another blob has too."""
    sizes = [len(b) // 4 for b in blobs]
    keys = np.frombuffer(b"".join(blobs), "<u4")
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    out, at = [], 0
    for size in sizes:
        bits = twice[at : at + size]
        out.append(np.packbits(bits).tobytes() if bits.any() else None)
        at += size
    return out


def shared_keys(found: np.ndarray, back: np.ndarray, doc: np.ndarray, bits: dict[int, bytes]) -> np.ndarray:
    """Whether each distinct key lies in another batch (by the answers' bits) or in two documents of this one."""
    out = np.zeros(len(found), bool)
    for bucket, a, b in by_bucket(found):
        if bucket in bits:
            out[a:b] = np.unpackbits(np.frombuffer(bits[bucket], np.uint8), count=b - a).astype(bool)
    low, high = np.full(len(found), np.iinfo(np.int64).max), np.full(len(found), -1)
    np.minimum.at(low, back, doc)
    np.maximum.at(high, back, doc)
    return out | (low < high)
