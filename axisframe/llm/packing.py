"""Packing of token sequences into windows, bounded-space online best-fit.

Every partition keeps a fixed number of open windows. A document's ids (by a public tokenizer, then one end id) first
fill whole windows; what is left goes to the open window that it fits most tightly. If it fits none, a new window is
opened while there are fewer than ``OPEN``; else the fullest is filled up with the head of the document (or left with
padding if fewer than ``LEAST`` places are free) and emitted. At its end a partition hands on its open windows, at most
OPEN of them, and those of ``MERGE`` partitions at a time are merged: pieces are laid end to end and cut at the window
size, and what is left in the end forms windows of falling powers of two, which need no padding.

Ids are made once, in the pass that packs. Words are tokenized one by one (the tokenizer drops white space and no token
spans it) and kept in a bounded cache of each Python worker.

A null or empty text is its end id alone. Rows that repeat, or share a doc_id, are documents of their own; a null doc_id
stays null. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, text

WINDOW, OPEN, LEAST, MERGE = 2048, 64, 8, 64
#: Cached words of a Python worker; beyond it the cache starts anew.
CACHE_WORDS = 800_000


class Tokens:
    """Ids of whole texts, by a cache from the hash of a word to its ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the documents (uint32) and the offsets of each document's."""
        n_docs = len(offsets) - 1
        raw = data.tobytes()
        if b"<|" not in raw:  # the tokenizer lower-cases, but names of special tokens are read as they stand
            data = text.LOWER[data]
            raw = data.tobytes()
        starts, ends, doc = text.words(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(n_docs + 1, np.int64)
        starts, ends, doc = _without_marks(data, starts, ends, doc)
        found, first, back = np.unique(text.Rolling(data).of(starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > CACHE_WORDS:
            self.clear()
        at = np.searchsorted(self.known, found)
        new = np.flatnonzero(at == len(self.known)) if not len(self.known) else np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] != found)
        if len(new):
            words = [raw[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            lists = [x.ids for x in self.encode.encode_batch_fast(words, add_special_tokens=False)]
            length = np.fromiter(map(len, lists), np.int64, len(lists))
            start = len(self.pool) + np.cumsum(length) - length
            self.pool = np.concatenate([self.pool, np.fromiter((i for x in lists for i in x), np.uint32, int(length.sum()))])
            # both sides are sorted, so they are merged by place
            where = np.searchsorted(self.known, found[new])
            self.known, self.start, self.length = (np.insert(x, where, y) for x, y in ((self.known, found[new]), (self.start, start), (self.length, length)))
            at = np.searchsorted(self.known, found)
        start, length = self.start[at][back], self.length[at][back]
        ids = self.pool[text.ragged(start, length)]
        total = np.concatenate([[0], np.cumsum(length)])
        return ids, total[text.spans_of(doc, n_docs)]


_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[list(b".,!?")] = True


def _without_marks(data, starts, ends, doc):
    """Words with a mark behind an ASCII letter at their end as two items: the tokenizer cuts there too, and fewer are distinct."""
    two = (ends - starts > 1) & _MARK[data[ends - 1]] & _LETTER[data[np.maximum(ends - 2, 0)]]
    item = np.repeat(np.arange(len(starts)), 1 + two)
    mark = np.cumsum(1 + two)[two] - 1
    starts, ends, doc = starts[item], ends[item], doc[item]
    ends[mark - 1] -= 1
    starts[mark] = ends[mark] - 1
    return starts, ends, doc


_tokens: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


class Packer:
    """Open windows of one partition. ``done`` gathers (window number or -1, document, start, ids, tokens of the document)."""

    def __init__(self, window: int = WINDOW, most: int = OPEN, least: int = LEAST):
        self.window, self.most, self.least = window, most, least
        self.free = np.zeros(0, np.int64)
        self.held: list[list[tuple]] = []
        self.emitted = 0
        self.done: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        self.done.extend((self.emitted, *p) for p in pieces)
        self.emitted += 1

    def _close(self, k: int) -> None:
        self._emit(self.held[k])
        self.held[k] = self.held[-1]
        self.free[k] = self.free[-1]
        self.held.pop()
        self.free = self.free[:-1]

    def _put(self, k: int, piece: tuple) -> None:
        self.held[k].append(piece)
        self.free[k] -= len(piece[2])
        if not self.free[k]:
            self._close(k)

    def add(self, doc, ids: np.ndarray) -> None:
        start, n = 0, len(ids)
        while n - start >= self.window:
            self._emit([(doc, start, ids[start : start + self.window], n)])
            start += self.window
        if start == n:
            return
        room = np.where(self.free >= n - start, self.free, self.window + 1)
        if len(room) and room.min() <= self.window:
            self._put(int(room.argmin()), (doc, start, ids[start:], n))
            return
        if len(self.held) >= self.most:
            k = int(self.free.argmin())
            if (cut := int(self.free[k])) >= self.least:
                self._put(k, (doc, start, ids[start : start + cut], n))
                self._place_rest(doc, ids, start + cut, n)
                return
            self._close(k)
        self._open(doc, ids, start, n)

    def _place_rest(self, doc, ids, start, n) -> None:
        room = np.where(self.free >= n - start, self.free, self.window + 1)
        if len(room) and room.min() <= self.window:
            self._put(int(room.argmin()), (doc, start, ids[start:], n))
        else:
            self._open(doc, ids, start, n)

    def _open(self, doc, ids, start, n) -> None:
        self.held.append([])
        self.free = np.append(self.free, self.window)
        self._put(len(self.held) - 1, (doc, start, ids[start:], n))


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _rows(pieces: list[tuple], base: int) -> list[pa.Array]:
    """Columns of _PIECE for (window, doc, start, ids, tokens), in order within each window."""
    out, last, offset = [], None, 0
    for window, doc, start, ids, total in pieces:
        offset = 0 if window != last else offset
        out.append((doc, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4")), total, base + window, offset))
        last, offset = window, offset + len(ids)
    return [pa.array([r[k] for r in out], pa.int64()) for k in range(7)]


def _packed(path: str, window: int, most: int, end_id: int):
    def run(batches):
        base = TaskContext.get().partitionId() << 33
        packer, encode = Packer(window, most), tokens(path)
        for rows, data, offsets in text.documents(batches, 1):
            ids, at = encode.ids(data, offsets)
            for doc, a, b in zip(rows.column(0).to_pylist(), at[:-1], at[1:], strict=True):
                packer.add(doc, np.append(ids[a:b], np.uint32(end_id)))
            done, packer.done = packer.done, []
            if done:
                yield pa.RecordBatch.from_arrays([*_rows(done, base), pa.nulls(len(done), pa.binary())], names=[*_NAMES, "ids"])
        # what is still open goes on with its ids
        left = [(k, *p) for k, held in enumerate(packer.held) for p in held]
        if left:
            blobs = pa.array([np.ascontiguousarray(x[3], "<u4").tobytes() for x in left], pa.binary())
            yield pa.RecordBatch.from_arrays([*_rows(left, base), blobs], names=[*_NAMES, "ids"])

    return run


def _merged(window: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        base = (int(group["part"][0].as_py()) << 33) | 1 << 32
        whole = [(d, s, np.frombuffer(x, "<u4"), t) for d, s, x, t in zip(*(group[k].to_pylist() for k in ("doc_id", "start", "ids", "doc_tokens")), strict=True)]
        left = sum(len(p[2]) for p in whole)
        sizes = [window] * (left // window) + [1 << k for k in range(window.bit_length(), -1, -1) if (left % window) >> k & 1]
        out, k, free = [], 0, sizes[0]
        for doc, start, ids, total in whole:
            at = 0
            while at < len(ids):
                cut = min(free, len(ids) - at)
                out.append((k, doc, start + at, ids[at : at + cut], total))
                at, free = at + cut, free - cut
                if not free and k + 1 < len(sizes):
                    k += 1
                    free = sizes[k]
        return pa.table(_rows(out, base), names=_NAMES)

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, most: int = OPEN, end_id: int = 1) -> DataFrame:
    """One row for each piece of each document: where it starts there, and its place in a sequence.

    ``tokenizer`` is the path of a tokenizer file that every executor has. Sequences are as long as their pieces; they are
    to be padded to ``window``, except those whose length is a power of two.
    """
    shared.prepared(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    done, _ = shared.written(rows.mapInArrow(_packed(tokenizer, window, most, end_id), _PIECE + ", ids binary"), "packed")
    left = done.where("ids is not null").withColumn("part", F.shiftright("sequence_id", 33)).withColumn("part", F.expr(f"part - part % {MERGE}"))
    merged = left.groupBy("part").applyInArrow(_merged(window), _PIECE)
    return done.where("ids is null").drop("ids").union(merged)
