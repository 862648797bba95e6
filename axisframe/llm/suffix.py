"""Exact removal of repeated byte strings by sparse suffix arrays in a logarithmic index family.

Every byte that a ``LENGTH``-byte string covers which also starts in a document with a smaller doc_id goes. Strings never
cross documents and are judged on the input.

A suffix is indexed only where it can matter. Each window of 50 bytes has an anchor, its leftmost smallest ``K``-byte
string by hash, which depends on the window's bytes alone; so equal windows have equal anchors. A run is a row of windows
with one anchor, at most ``SPAN``. Texts are read in pieces of ``PIECE`` bytes that overlap by a window, so what a task
holds beside the text itself doesn't grow with a text's length.

1. Batches ask which anchors lie in two documents or more; most text ends here, exactly, as a window whose anchor is in
   no other document is in no other document.
2. For the other runs, batches send the runs' distinct bytes with the smallest document that has them. A bucket takes
   them in the order of documents, in batches of at most ``BATCH`` suffixes. Each batch gets a suffix array: its window
   starts in the lexicographic order of the bytes from there (the order is decided within 50 bytes, as equal windows
   are one entry). The array is merge-scanned against each level that exists, by comparing bytes, and becomes a
   level; levels merge as soon as the older is no longer than the younger, so sizes grow geometrically. The answer is a
   bit for each window of each run: it starts in a smaller document.
3. Batches lay the bits over their text.

``remove_repeats`` works on one table and drops the levels. ``extend`` keeps them in a shared folder: a new batch of
documents meets the levels of all batches before it, and only the levels that it makes are written. There every run is
sent, as a later batch may hold what no document so far has twice.

Nulls and empty texts: 0 bytes, the digest of nothing. A null doc_id is smaller than none and larger than none: it is
returned and loses nothing. Rows that share a doc_id are not smaller than each other. Other columns are ignored. An empty
table gives no rows. A single document larger than a batch is a batch of its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange, shared, text

LENGTH, K = 50, 24
SPAN = LENGTH - K + 1
#: Window starts in one suffix array as it enters the family, and bytes of text whose windows are sought at once.
BATCH, PIECE = 1 << 17, 1 << 18
_U = np.uint64


def _piece(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, contents: bool):
    """``runs`` of the windows that start in lo to hi - 1."""
    part = data[lo : hi + LENGTH - 1]
    n = hi - lo
    rolling = text.Rolling(part)
    full = rolling.every(K)
    low = (full >> _U(32)).astype(np.uint32)
    at = np.arange(len(low), dtype=np.int32)
    width = 1
    while width < SPAN:  # the leftmost minimum of the next `width` anchors, doubled
        step = min(width, SPAN - width)
        first = low[:-step] <= low[step:]
        at = np.where(first, at[:-step], at[step:])
        low = np.where(first, low[:-step], low[step:])
        width += step
    at = at[:n]
    valid = np.ones(n, bool)
    a, b = np.searchsorted(offsets, [lo + 1, hi + LENGTH - 1])
    for edge in offsets[a:b].tolist():  # windows that would cross into the next document
        valid[max(0, edge - LENGTH + 1 - lo) : max(0, edge - lo)] = False
    turn = at[1:] != at[:-1]
    begins, ends = valid.copy(), valid.copy()
    begins[1:] &= turn | ~valid[:-1]
    ends[:-1] &= turn | ~valid[1:]
    starts = np.flatnonzero(begins)
    count = np.flatnonzero(ends) - starts + 1
    key = full[at[starts]]
    content = rolling.of(starts, starts + count + LENGTH - 1) if contents else key
    starts = starts + lo
    return starts, count, key, np.searchsorted(offsets, starts, side="right") - 1, content


def runs(data: np.ndarray, offsets: np.ndarray, contents: bool = False):
    """First window start, number of windows, anchor's hash, document and hash of the bytes of each run."""
    n = len(data) - LENGTH + 1
    parts = [_piece(data, offsets, lo, min(n, lo + PIECE), contents) for lo in range(0, n, PIECE)]
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none, none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _anchors(ids, data, offsets, n):
    _, _, key, *_ = runs(data, offsets)
    yield from exchange.low_halves(exchange.split_keys(key, n)[0])


def _alike(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether data[a[i] : a[i] + length[i]] and data[b[i] : b[i] + length[i]] are equal; lengths are over 0."""
    out = np.zeros(len(a), bool)
    for lo, hi in text.slices(np.concatenate([[0], np.cumsum(length)]), PIECE):
        size = length[lo:hi]
        same = data[text.ragged(a[lo:hi], size)] == data[text.ragged(b[lo:hi], size)]
        out[lo:hi] = np.logical_and.reduceat(same, np.cumsum(size) - size)
    return out


def _grouped(data: np.ndarray, start: np.ndarray, length: np.ndarray, keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Runs sorted by ``keys`` (the last first; the second is a hash of the bytes), and where other bytes than before begin."""
    order = np.lexsort(keys)
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.diff(length[order]) != 0
    for key in keys[1:]:
        fresh[1:] |= key[order][1:] != key[order][:-1]
    near = np.flatnonzero(~fresh)
    fresh[near] = ~_alike(data, start[order[near]], start[order[near - 1]], length[order[near]])
    return order, fresh


def _selected(ids, data, offsets, n, bits):
    """Runs whose anchors are shared (all runs where ``bits`` is None), as distinct bytes: bucket of each, the entry of each, and each entry's first run."""
    starts, count, key, doc, content = runs(data, offsets, True)
    if bits is not None:
        found, back = exchange.split_keys(key, n)
        keep = exchange.shared_keys(found, back, doc, bits)[back]
        starts, count, key, doc, content = (x[keep] for x in (starts, count, key, doc, content))
    bucket = ((key >> _U(32)) % _U(n)).astype(np.int64)
    order, fresh = _grouped(data, starts, count + LENGTH - 1, (ids[doc], content, bucket))
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(fresh) - 1
    first = order[fresh]  # the run of each distinct content that is in the smallest document
    return starts, count, bucket, which, first, ids[doc]


def _cuts(bucket: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)


def _contents(n, whole: bool):
    def act(batch, ids, data, offsets, got):
        starts, count, bucket, _, first, owner = _selected(ids, data, offsets, n, None if whole else got.get(1, {}))
        out = []
        at = _cuts(bucket[first])
        for a, b in zip(at[:-1], at[1:], strict=True):
            part = first[a:b]
            raw = data[text.ragged(starts[part], count[part] + LENGTH - 1)].tobytes()
            blob = np.array([len(part)], "<i8").tobytes() + owner[part].astype("<i8").tobytes() + count[part].astype(np.uint8).tobytes() + raw
            out.append((int(bucket[part[0]]), exchange.squeeze(blob, 3)))
        yield pa.table({"bucket": pa.array([b for b, _ in out], pa.int32()), "batch": pa.array([batch] * len(out), pa.int64()), "blob": pa.array([x for _, x in out], pa.binary())})

    return act


# -- the family --------------------------------------------------------------------------------------------------------


def _heads(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first 8 bytes from each place as a number whose order is theirs."""
    return np.ndarray((max(0, len(data) - 7),), ">u8", data, 0, (1,))[at].astype(np.uint64)


def _prefixes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The LENGTH bytes from each place, as fixed-length strings: these compare byte by byte."""
    return np.ndarray((max(0, len(data) - LENGTH + 1),), f"S{LENGTH}", data, 0, (1,))[at]


class Level:
    """A suffix array: places in ``data`` in the order of the bytes from there, each prefix once, with its smallest document."""

    def __init__(self, data: np.ndarray, at: np.ndarray, doc: np.ndarray, head: np.ndarray | None = None, name: int | None = None):
        self.data, self.at, self.doc, self.name = data, at, doc, name
        self.head = _heads(data, at) if head is None else head

    def __len__(self) -> int:
        return len(self.at)

    def prefixes(self, which=slice(None)) -> np.ndarray:
        return _prefixes(self.data, self.at[which])

    def places(self, other: "Level") -> tuple[np.ndarray, np.ndarray]:
        """Where each suffix of ``other`` would stand in this array, and whether the one there has the same LENGTH bytes."""
        lo, hi = np.searchsorted(self.head, other.head, "left"), np.searchsorted(self.head, other.head, "right")
        hit = np.zeros(len(lo), bool)
        met = np.flatnonzero(lo < hi)
        key = other.prefixes(met)
        todo = np.arange(len(met))
        low, high = lo[met], hi[met]
        while len(todo):  # a binary search among those that share 8 bytes
            mid = (low[todo] + high[todo]) >> 1
            less = self.prefixes(mid) < key[todo]
            low[todo] = np.where(less, mid + 1, low[todo])
            high[todo] = np.where(less, high[todo], mid)
            todo = todo[low[todo] < high[todo]]
        lo[met] = low
        inside = np.flatnonzero(low < hi[met])
        hit[met[inside]] = self.prefixes(low[inside]) == key[inside]
        return lo, hit

    def merged(self, young: "Level", places=None) -> "Level":
        """One array of this and a younger one's suffixes."""
        lo, hit = self.places(young) if places is None else places
        doc = self.doc.copy()
        np.minimum.at(doc, lo[hit], young.doc[hit])
        new = np.flatnonzero(~hit)
        at = np.insert(self.at, lo[new], young.at[new] + len(self.data))
        return Level(np.concatenate([self.data, young.data]), at, np.insert(doc, lo[new], young.doc[new]), np.insert(self.head, lo[new], young.head[new]))

    def packed(self) -> bytes:
        m = np.array([len(self.at), len(self.data)], "<i8").tobytes()
        return exchange.squeeze(m + self.at.astype("<i8").tobytes() + self.doc.astype("<i8").tobytes() + self.data.tobytes(), 3)

    @staticmethod
    def unpacked(blob: bytes, name: int | None = None) -> "Level":
        raw = exchange.expand(blob)
        m, size = np.frombuffer(raw, "<i8", 2).tolist()
        return Level(np.frombuffer(raw, np.uint8, size, 16 + 16 * m), np.frombuffer(raw, "<i8", m, 16), np.frombuffer(raw, "<i8", m, 16 + 8 * m), name=name)


def suffix_array(data: np.ndarray, at: np.ndarray, doc: np.ndarray) -> tuple[Level, np.ndarray]:
    """The array of the suffixes that begin at ``at``, and the entry of each of them."""
    head = _heads(data, at)
    order = np.argsort(head, kind="stable")
    same = head[order][1:] == head[order][:-1]
    tied = np.zeros(len(order), bool)
    tied[1:] |= same
    tied[:-1] |= same
    spot = np.flatnonzero(tied)  # groups of equal heads stay where they are, as the heads are part of the prefixes
    order[spot] = order[spot][np.argsort(_prefixes(data, at[order[spot]]), kind="stable")]
    key = _prefixes(data, at[order[spot]])
    fresh = np.ones(len(order), bool)
    if len(spot):
        fresh[spot[1:]] = (key[1:] != key[:-1]) | (np.diff(spot) != 1)
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(fresh) - 1
    cut = np.flatnonzero(fresh)
    least = np.minimum.reduceat(doc[order], cut) if len(cut) else doc
    return Level(data, at[order[cut]], least, head[order[cut]]), entry


class Family:
    """Suffix arrays of document-ordered batches, in levels of geometrically growing size."""

    def __init__(self, levels: list[Level] | None = None):
        self.levels = levels or []

    def add(self, data: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Take in the suffixes of ``data`` that begin at ``at``; which of them start in a document smaller than their own (``doc``)?"""
        young, entry = suffix_array(data, at, doc)
        least, places = young.doc.copy(), None
        for level in self.levels:  # merge-scan
            places = level.places(young)
            lo, hit = places
            least[hit] = np.minimum(least[hit], level.doc[lo[hit]])
        self.levels.append(young)
        while len(self.levels) > 1 and len(self.levels[-2]) <= len(self.levels[-1]):
            young = self.levels.pop()
            self.levels[-1] = self.levels[-1].merged(young, places)
            places = None  # those were of the youngest level
        return least[entry] < doc


def _starts_earlier(blobs: list[bytes], family: Family) -> list[bytes | None]:
    docs, counts, raws, sizes = [], [], [], []
    for blob in blobs:
        raw = exchange.expand(blob)
        m = int(np.frombuffer(raw, "<i8", 1)[0])
        sizes.append(m)
        docs.append(np.frombuffer(raw, "<i8", m, 8))
        counts.append(np.frombuffer(raw, np.uint8, m, 8 + 8 * m).astype(np.int64))
        raws.append(np.frombuffer(raw, np.uint8, -1, 8 + 9 * m))
    doc, count, data = np.concatenate(docs), np.concatenate(counts), np.concatenate(raws)
    del raws
    length = count + LENGTH - 1
    start = np.cumsum(length) - length
    # a run's bytes enter once, with their smallest document; the same bytes in a larger document go whole
    content = np.concatenate([text.Rolling(data[start[a] : start[b - 1] + length[b - 1]]).of(start[a:b] - start[a], start[a:b] - start[a] + length[a:b]) for a, b in text.slices(np.concatenate([[0], np.cumsum(length)]), PIECE)])
    order, fresh = _grouped(data, start, length, (doc, content))
    first = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
    rep = np.empty(len(order), np.int64)
    rep[order] = first
    own = np.flatnonzero(rep == np.arange(len(rep)))
    own = own[np.argsort(doc[own], kind="stable")]
    bits = np.zeros(len(doc), np.uint32)
    ends = np.cumsum(count[own])
    lo = 0
    while lo < len(own):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BATCH, side="right")))
        part = own[lo:hi]
        begin = np.cumsum(length[part]) - length[part]
        turn = text.ragged(np.zeros(len(part), np.int64), count[part])
        entry = np.repeat(part, count[part])
        earlier = family.add(data[text.ragged(start[part], length[part])], np.repeat(begin, count[part]) + turn, doc[entry])
        hit = np.flatnonzero(earlier)
        np.bitwise_or.at(bits, entry[hit], np.left_shift(np.uint32(1), turn[hit].astype(np.uint32)))
        lo = hi
    bits = np.where(doc > doc[rep], np.uint32(0xFFFFFFFF), bits[rep])
    out, at = [], 0
    for m in sizes:
        out.append(exchange.squeeze(bits[at : at + m].astype("<u4").tobytes()))
        at += m
    return out


def _covered(n, whole: bool):
    """The mask of removed bytes of a batch, from both answers."""

    def cover(ids, data, offsets, got):
        starts, count, bucket, which, first, owner = _selected(ids, data, offsets, n, None if whole else got.get(1, {}))
        if not len(starts):
            return np.zeros(len(data), bool)
        answers = got.get(2, {})
        bits = np.zeros(len(first), np.uint32)
        at = _cuts(bucket[first])
        for a, b in zip(at[:-1], at[1:], strict=True):
            bits[a:b] = np.frombuffer(exchange.expand(answers[int(bucket[first[a]])]), "<u4")
        # a run in a larger document than the smallest with its bytes goes whole
        mine = np.where(owner > owner[first][which], np.uint32(0xFFFFFFFF), bits[which])
        change = np.zeros(len(data) + 1, np.int8)  # a window starts once at a place
        every = np.flatnonzero(mine)
        for lo in range(0, len(every), PIECE // SPAN):
            hit = every[lo : lo + PIECE // SPAN]
            turn = text.ragged(np.zeros(len(hit), np.int64), count[hit])
            row = np.repeat(hit, count[hit])
            go = (mine[row] >> turn.astype(np.uint32)) & np.uint32(1) == 1
            window = starts[row[go]] + turn[go]
            change[window] += 1
            change[window + LENGTH] -= 1
        return np.cumsum(change[:-1], dtype=np.int8) > 0

    return cover


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _digests(ids, data, offsets, mask, keep_text):
    removed, spans, kept, digest = [], [], [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        go = mask[a:b]
        removed.append(int(np.count_nonzero(go)))
        spans.append(int(np.count_nonzero(go[1:] & ~go[:-1])) + int(go[0]) if removed[-1] else 0)
        left = data[a:b][~go] if removed[-1] else data[a:b]
        digest.append(hashlib.sha256(left.data if left.flags.c_contiguous else left.tobytes()).hexdigest())
        if keep_text:
            kept.append(left.tobytes())
    columns = {"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
    if keep_text:
        columns["kept"] = pa.array(kept, pa.binary())
    return pa.table(columns)


def _finished(rows: DataFrame, staged: DataFrame, answers: DataFrame, n: int, whole: bool, keep_text: bool) -> DataFrame:
    cover = _covered(n, whole)

    def act(batch, ids, data, offsets, got):
        yield _digests(ids, data, offsets, cover(ids, data, offsets, got), keep_text)

    schema = RESULT + (", kept binary" if keep_text else "")
    out = exchange.meet(staged, answers, act, schema)
    nobody = rows.where("id is null").select(F.col("id").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("kept"))
    nobody = nobody.select("doc_id", F.octet_length("kept").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "kept")
    return out.unionByName(nobody if keep_text else nobody.drop("kept"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    shared.prepared(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row; with ``keep_text`` also the remaining bytes (kept)."""
    rows = _rows(docs, id_col, text_col)
    staged, _, n = exchange.stage(rows.where("id is not null"), like=docs)
    asked = exchange.ask(staged, n, _anchors)
    first, _ = shared.written(exchange.answer(asked, 1, exchange.in_two_batches), "answers")
    sent = exchange.meet(staged, first, _contents(n, False), "bucket int, batch long, blob binary")
    second, _ = shared.written(exchange.answer(sent, 2, lambda blobs: _starts_earlier(blobs, Family())), "answers")
    return _finished(rows, staged, first.union(second), n, False, keep_text)


# -- an index that new batches meet ------------------------------------------------------------------------------------

LEVEL = "n int, version long, bucket int, name long, merged array<long>, blob binary"


def _levels_met(version: int):
    """Answers (kind 2) of a bucket to its questions and the levels that these made (kind 3, batch: its name)."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        levels = sorted((Level.unpacked(b, m) for b, m in zip(held["blob"].to_pylist(), held["name"].to_pylist(), strict=True)), key=lambda x: -len(x))
        old = {x.name for x in levels}
        out = []
        if asked.num_rows:
            bucket, family = asked["bucket"][0].as_py(), Family(levels)
            got = _starts_earlier(asked["blob"].to_pylist(), family)
            out = [(b, 2, bucket, x, None) for b, x in zip(asked["batch"].to_pylist(), got, strict=True)]
            gone = sorted(old - {x.name for x in family.levels})
            for k, level in enumerate(x for x in family.levels if x.name is None):
                out.append((version << 16 | k, 3, bucket, level.packed(), gone if not k else []))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
        names = ("batch", "kind", "bucket", "blob", "merged")
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=list(names))

    return run


def extend(docs: DataFrame, index: str, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, buckets: int | None = None) -> DataFrame:
    """``remove_repeats`` of a new batch of documents against themselves and all batches before, whose levels lie in the folder ``index``.

    The folder must be one that driver and executors share; it is made by the first batch, which also fixes the number of
    buckets (``buckets``, else by that batch's size). Documents of earlier batches are not judged again, so batches that come in
    the order of doc_id give what one run over all of them gives. Only levels that a batch makes are written; each names those
    that it replaces.
    """
    spark = docs.sparkSession
    rows = _rows(docs, id_col, text_col)
    staged, _, n = exchange.stage(rows.where("id is not null"), like=docs)
    n, version = buckets or n, 0
    held = spark.createDataFrame([], LEVEL)
    if shared.exists(spark, index):
        held = spark.read.schema(LEVEL).parquet(index)
        last = held.agg(F.max("n").alias("n"), F.max("version").alias("v")).first()
        if last["n"] is not None:
            n, version = last["n"], last["v"] + 1
    gone = held.select("bucket", F.explode("merged").alias("name"))
    alive = held.select("bucket", "name", "blob").join(gone, ["bucket", "name"], "left_anti")
    none = spark.createDataFrame([], exchange.ANSWER)
    sent = exchange.meet(staged, none, _contents(n, True), "bucket int, batch long, blob binary")
    both = sent.groupBy("bucket").cogroup(alive.groupBy("bucket")).applyInArrow(_levels_met(version), exchange.ANSWER + ", merged array<long>")
    second, _ = shared.written(both, "answers")
    made = second.where("kind = 3").select(F.lit(n).alias("n"), F.lit(version).cast("long").alias("version"), "bucket", F.col("batch").alias("name"), "merged", "blob")
    made.write.mode("append").parquet(index)
    return _finished(rows, staged, second.where("kind = 2").drop("merged"), n, True, keep_text)
