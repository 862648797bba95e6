"""Fuzzy repeated passages by collinear chaining of shared k-mer seeds.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Seeds are all ``K``-word strings: a passage that
is equal in more than 80 percent of its places has ``K`` equal words in a row, but for few.

1. Batches ask which seeds lie in two documents or more; the rest are dropped. So are the ``LEAST``-word windows with a
   seed that was dropped, which can't lie in two documents.
2. They ask for each shared seed's pivot: its first place in the document with the smallest id, and for that of each
   window left. A seed in a document larger than its pivot's is a match of the two. So matches grow with the text, not
   with the square of a group. Pieces of a passage may have pivots of their own that hold no more of it; its windows'
   pivots hold all of a window.
3. Matches of a pair of documents that lie on one diagonal are joined to blocks, and blocks are chained: a chain's score
   is its words less ``GAP`` for each word skipped on either side, and the best chain to end in a block comes from a
   Fenwick tree of prefix maxima over places in the pivot's document.
4. Each chain, with its words and some to either side, meets the words it needs of the pivot's document, which gives out
   segments, each once however many chains need it; a chain that seeds cover from end to end needs none. Chains are aligned: blocks are extended word by
   word, in gaps between them as many words as can be are paired in order (a longest common subsequence, in a band where
   a gap is long), and the stretches of best score, with +1 for an equal and -4 for an unequal place, are the passages.
   Such a stretch is equal in more than 80 percent of its places. Those of at least ``LEAST`` words are returned. Windows
   that match are joined on their diagonals, too; where no chain's passage holds such an exact one, it is a passage of
   its own.

So every word of ``LEAST`` equal words in a row that also lie in a smaller document is in some row.

A row is a passage: doc_id, start and end (words) and where it lies in source_doc_id, a smaller document. Documents
without one have no row. Of several places that hold the same words, the first in the smallest document is the source.
Nulls and empty texts have no words; rows with a null id take no part. Rows that repeat an id with other texts are texts
of one document: each is compared with smaller documents, none with another of its own; equal passages of theirs are one
row. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange, shared, text

K, JOIN, GAP = 5, 11, 0.25
LEAST, SCORE, MARGIN = 45, 8.0, 96
WRONG = 4
#: Places to either side in which long gaps are aligned, and cells up to which they are.
BAND, CELLS = 64, 1 << 22
_U = np.uint64


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word, and the offsets of each document's words."""
    low = text.LOWER[data]
    starts, ends, doc = text.words(low, offsets)
    word = text.Rolling(low).of(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return word, starts, ends, text.spans_of(doc, len(offsets) - 1)


def grams(word: np.ndarray, k: int = K) -> np.ndarray:
    """Hash of the k words from each place."""
    n = max(0, len(word) - k + 1)
    out = word[:n]
    for i in range(1, k):
        out = text.mix(out * _U(0xA24BAED4963EE407) ^ word[i : n + i])
    return text.mix(out)


def seeds(word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and place in it of each seed; none crosses documents."""
    h = grams(word)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    pick = np.flatnonzero(doc[: len(h)] == doc[len(doc) - len(h) :])
    return h[pick], doc[pick], pick - at[doc[pick]]


def windows(word: np.ndarray, at: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and place in it of each window of LEAST words in one document, all of whose seeds are ``ok``."""
    n = len(word) - LEAST + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    bad = np.concatenate([[0], np.cumsum(~ok[: len(word) - K + 1])])
    pick = np.flatnonzero((bad[LEAST - K + 1 :] == bad[:n]) & (doc[:n] == doc[LEAST - 1 :]))
    sums = np.zeros(len(word) + 1, np.uint64)
    np.cumsum(word * text.powers(text._BASE, len(word)), dtype=np.uint64, out=sums[1:])
    key = text.mix((sums[pick + LEAST] - sums[pick]) * text.powers(text._INVERSE, len(word))[pick] ^ _U(0x632BE59BD9B4E019))
    return key, doc[pick], pick - at[doc[pick]]


def _of_batch(data, offsets):
    word, starts, ends, at = hashed_words(data, offsets)
    return (*seeds(word, at), word, starts, ends, at)


def _which(keys, data, offsets, n):
    key, *_ = _of_batch(data, offsets)
    for bucket, raw in exchange.low_halves(exchange.split_keys(key, n)[0]):
        yield bucket, _packed(np.frombuffer(raw, "<u4").astype(np.int64))


def _in_two_batches(blobs: list[bytes]) -> list[bytes | None]:
    return exchange.in_two_batches([_unpacked(x, 1)[0].astype("<u4").tobytes() for x in blobs])


def _shared(keys, data, offsets, n, bits):
    """The batch's seeds that lie in two documents, then its windows of such seeds; the first of each distinct one, by bucket and place."""
    ids = keys[:, 0]
    key, doc, place, word, starts, ends, at = _of_batch(data, offsets)
    found, back = exchange.split_keys(key, n)
    keep = exchange.shared_keys(found, back, ids[doc], bits)[back]
    key, doc, place = key[keep], doc[keep], place[keep]
    ok = np.zeros(len(word), bool)
    ok[at[doc] + place] = True
    n_seeds = len(key)
    key, doc, place = (np.concatenate(x) for x in zip((key, doc, place), windows(word, at, ok), strict=True))
    bucket = ((key >> _U(32)) % _U(n)).astype(np.int64)
    # documents of a batch lie in the order of their ids, so a stable sort leaves the first place of each key first
    order = np.argsort(key, kind="stable")
    fresh = np.ones(len(order), bool)
    fresh[1:] = key[order][1:] != key[order][:-1]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(fresh) - 1
    first = order[fresh]
    by_place = np.argsort(first)
    by_place = by_place[np.argsort(bucket[first[by_place]], kind="stable")]
    rank = np.empty(len(first), np.int64)
    rank[by_place] = np.arange(len(first))
    return key, doc, place, bucket, rank[which], first[by_place], n_seeds, (word, starts, ends, at)


def _cuts(bucket: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)


def _packed(*columns: np.ndarray) -> bytes:
    """Integers of slow change: differences, byte by byte."""
    return exchange.squeeze(b"".join(np.diff(x, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for x in columns))


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    """The n columns of ``_packed``."""
    planes = np.frombuffer(exchange.expand(raw), np.uint8).reshape(n, 8, -1)
    return np.cumsum(np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<i8")[..., 0], axis=1)


def _places(n):
    def act(batch, keys, data, offsets, got):
        key, doc, place, bucket, _, first, *_ = _shared(keys, data, offsets, n, got.get(1, {}))
        out = []
        at = _cuts(bucket[first])
        for a, b in zip(at[:-1], at[1:], strict=True):
            p = first[a:b]
            blob = np.array([len(p)], "<i8").tobytes() + key[p].astype("<u8").tobytes() + _packed(keys[doc[p], 0], keys[doc[p], 1], place[p])
            out.append((int(bucket[p[0]]), blob))
        yield pa.table({"bucket": pa.array([b for b, _ in out], pa.int32()), "batch": pa.array([batch] * len(out), pa.int64()), "blob": pa.array([x for _, x in out], pa.binary())})

    return act


def _pivots(blobs: list[bytes]) -> list[bytes | None]:
    sizes, keys, spots = [], [], []
    for raw in blobs:
        m = int(np.frombuffer(raw, "<i8", 1)[0])
        sizes.append(m)
        keys.append(np.frombuffer(raw, "<u8", m, 8))
        spots.append(_unpacked(raw[8 + 8 * m :], 3))
    key, (doc, sub, place) = np.concatenate(keys), np.concatenate(spots, axis=1)
    order = np.lexsort((place, sub, doc, key))
    fresh = np.ones(len(order), bool)
    fresh[1:] = key[order][1:] != key[order][:-1]
    first = order[fresh]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    doc, sub, shift = doc[first][group], sub[first][group], place[first][group] - place
    out, at = [], 0
    for m in sizes:
        out.append(_packed(doc[at : at + m], sub[at : at + m], shift[at : at + m]))
        at += m
    return out


# -- chaining ----------------------------------------------------------------------------------------------------------


class Fenwick:
    """Prefix maxima of (score, item)."""

    def __init__(self, size: int):
        self.best = [(float("-inf"), -1)] * (size + 1)

    def put(self, at: int, value: tuple[float, int]) -> None:
        at += 1
        while at < len(self.best):
            if value > self.best[at]:
                self.best[at] = value
            at += at & -at

    def top(self, upto: int) -> tuple[float, int]:
        """The best of places 0 to upto."""
        out, at = (float("-inf"), -1), upto + 1
        while at > 0:
            if self.best[at] > out:
                out = self.best[at]
            at -= at & -at
        return out


def blocks(pair: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches (places of seeds on both sides, of each pair of documents) joined to blocks on a diagonal.

    Returns the order of the matches by pair, diagonal and place, where in it blocks begin (with its end), and each block's
    length in seed places.
    """
    order = np.lexsort((a, a - b, pair))
    pair, a, b = pair[order], a[order], b[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (np.diff(pair) != 0) | (np.diff(a - b) != 0) | (np.diff(a) > JOIN)
    at = np.append(np.flatnonzero(fresh), len(a))
    return order, at, a[at[1:] - 1] - a[at[:-1]] + 1


def chains(a: np.ndarray, b: np.ndarray, size: np.ndarray, gap: float = GAP, least: float = SCORE) -> list[list[int]]:
    """Collinear chains of blocks (starts a and b, seed places covered), best first; a block is in one chain at most."""
    n = len(a)
    if n == 1:
        return [[0]] if size[0] + K - 1 >= least else []
    a, b, size = (x.tolist() for x in (a, b, size))
    rank = {x: r for r, x in enumerate(sorted({y + s for y, s in zip(b, size, strict=True)}))}
    ends = list(rank)
    starts = sorted(range(n), key=lambda i: (a[i], b[i]))
    closing = sorted(range(n), key=lambda i: a[i] + size[i])
    tree, score, back, done = Fenwick(len(ends)), [0.0] * n, [-1] * n, 0
    for i in starts:
        while done < n and a[closing[done]] + size[closing[done]] <= a[i]:
            j = closing[done]
            tree.put(rank[b[j] + size[j]], (score[j] + gap * (a[j] + b[j] + 2 * size[j]), j))
            done += 1
        score[i] = size[i] + K - 1
        upto = bisect.bisect_right(ends, b[i]) - 1
        if upto >= 0:
            value, j = tree.top(upto)
            if j >= 0 and (gain := value - gap * (a[i] + b[i])) > 0:
                score[i] += gain - (K - 1)
                back[i] = j
    out, used = [], [False] * n
    for i in sorted(range(n), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = back[i]
        if chain and a[chain[0]] + size[chain[0]] + K - 1 - a[chain[-1]] >= least:
            out.append(chain[::-1])
    return out


def exact(doc: np.ndarray, pivot: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matches of windows joined on their diagonals: rows (document, pivot, start in both, words), as few as cover what all do."""
    order = np.lexsort((a, a - b, pivot, doc))
    doc, pivot, a, b = (x[order] for x in (doc, pivot, a, b))
    fresh = np.ones(len(a), bool)
    fresh[1:] = (np.diff(doc) != 0) | (np.diff(pivot) != 0) | (np.diff(a - b) != 0) | (np.diff(a) > LEAST)
    at = np.flatnonzero(fresh)
    last = np.append(at[1:], len(a)) - 1
    found = np.stack([doc[at], pivot[at], a[at], b[at], a[last] - a[at] + LEAST], axis=1) if len(a) else np.zeros((0, 5), np.int64)
    out: list = []
    for row in found[np.lexsort((-found[:, 4], found[:, 2], found[:, 0]))].tolist():
        d, _, start, _, n = row
        if out and out[-1][0] == d:
            if start + n <= out[-1][2] + out[-1][4]:
                continue
            if len(out) > 1 and out[-2][0] == d and start <= out[-2][2] + out[-2][4]:
                out.pop()
        out.append(row)
    return np.array(out, np.int64).reshape(-1, 5)


CHAIN = "doc_id long, sub long, source_doc_id long, source_sub long, start long, source_start long, source_end long, words binary, anchors binary, equal binary, level int"
#: A word of a chain that its seeds have found equal; it need not be sent nor compared.
KNOWN = 0


def _short(word: np.ndarray) -> np.ndarray:
    """Words as alignments compare them: half of a hash, never KNOWN."""
    return np.maximum(word >> _U(32), _U(1)).astype("<u4")


def _chained(n):
    def act(batch, keys, data, offsets, got):
        key, doc, place, bucket, which, first, n_seeds, (word, _, _, at) = _shared(keys, data, offsets, n, got.get(1, {}))
        answers = got.get(2, {})
        told = np.zeros((3, len(first)), np.int64)
        cuts = _cuts(bucket[first])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            told[:, a:b] = _unpacked(answers[int(bucket[first[a]])], 3)
        told[2] += place[first]
        if told[1].any():
            sources, pivot = np.unique(told[:2].T, axis=0, return_inverse=True)  # (doc_id, sub), and which of them
        else:
            sources, pivot = np.unique(told[0], return_inverse=True)
            sources = np.stack([sources, np.zeros_like(sources)], axis=1)
        pivot, where = pivot.reshape(-1)[which], told[2][which]
        later = np.flatnonzero(sources[pivot, 0] < keys[doc, 0]) if len(which) else np.zeros(0, np.int64)
        whole = later[later >= n_seeds]
        whole = exact(doc[whole], pivot[whole], place[whole], where[whole])
        by_pair: dict = {}
        for row in whole.tolist():
            by_pair.setdefault((row[0], row[1]), []).append(tuple(row[2:]))
        later = later[later < n_seeds]
        out, short = [], _short(word)
        base, named, sourced = at.tolist(), keys.tolist(), sources.tolist()

        def put(d: int, source: int, anchors: list, seeds_at: np.ndarray | None) -> None:
            """A chain (blocks: start on both sides, seed places) with its words; ``seeds_at`` has the places of its seeds where it is one block."""
            (x0, y0, _), (x1, y1, m1) = anchors[0], anchors[-1]
            start, stop = max(0, x0 - MARGIN), min(base[d + 1] - base[d], x1 + m1 + K - 1 + MARGIN)
            src_start, src_stop = max(0, y0 - MARGIN), y1 + m1 + K - 1 + MARGIN
            held = []
            if (d, source) in by_pair:
                rest = []
                for x, y, m in by_pair[d, source]:
                    (held if start <= x and x + m <= stop and src_start <= y and y + m <= src_stop else rest).append((x, y, m))
                by_pair[d, source] = rest
            words = short[base[d] + start : base[d] + stop].copy()
            if seeds_at is not None and all(x - y == x0 - y0 for x, y, _ in held):
                if len(seeds_at) == m1:
                    words[x0 - start : x0 - start + m1 + K - 1] = KNOWN
                else:
                    for k in range(K):
                        words[seeds_at + (k - start)] = KNOWN
                for x, _, m in held:
                    words[x - start : x - start + m] = KNOWN
            level = -1  # the source need not be asked
            if words.any():  # segments of 2 ** (level + 1) words, from every 2 ** level-th, so that one holds what is needed
                level = max(6, (src_stop - src_start - 1).bit_length())
            out.append((*named[d], *sourced[source], start, src_start, src_stop, words.tobytes(), np.array(anchors, "<i4").tobytes(), np.array(held, "<i4").tobytes() if held else b"", level))

        if len(later):
            order, cut, size = blocks(doc[later] * len(sources) + pivot[later], place[later], where[later])
            later = later[order]
            a, b = place[later], where[later]
            a0, b0, whose, whence = a[cut[:-1]], b[cut[:-1]], doc[later][cut[:-1]], pivot[later][cut[:-1]]
            edge = np.flatnonzero(np.diff(whose) | np.diff(whence)) + 1
            edge = np.concatenate([[0], edge, [len(size)]])
            enough = np.add.reduceat(size + K - 1, edge[:-1]) >= SCORE
            for lo, hi in zip(edge[:-1][enough].tolist(), edge[1:][enough].tolist(), strict=True):
                d, source = int(whose[lo]), int(whence[lo])
                if hi == lo + 1:
                    put(d, source, [(int(a0[lo]), int(b0[lo]), int(size[lo]))], a[cut[lo] : cut[hi]])
                    continue
                spots = list(zip(a0[lo:hi].tolist(), b0[lo:hi].tolist(), size[lo:hi].tolist(), strict=True))
                for chain in chains(a0[lo:hi], b0[lo:hi], size[lo:hi]):
                    one = lo + chain[0]
                    put(d, source, [spots[k] for k in chain], a[cut[one] : cut[one + 1]] if len(chain) == 1 else None)
        for (d, source), rows in by_pair.items():
            while by_pair[d, source]:
                x, y, m = by_pair[d, source][0]
                put(d, source, [(x, y, m - K + 1)], np.arange(x, x + m - K + 1))
        columns = list(zip(*out, strict=True)) or [()] * 11
        kinds = [pa.int64()] * 7 + [pa.binary()] * 3 + [pa.int32()]
        names = [x.split()[0] for x in CHAIN.split(", ")]
        yield pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return act


# -- alignment ---------------------------------------------------------------------------------------------------------


def paired(a: np.ndarray, b: np.ndarray, band: int = BAND) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of two gaps; where they are long, of one within ``band`` places of the straight way.

    None where the two differ in length so much that even the band is over CELLS cells.
    """
    n, m = len(a), len(b)
    if n > m:
        return [(i, j) for j, i in paired(b, a, band)]
    width = m if n * m <= 16 * band * band else min(m, m - n + 2 * band)
    if not n or n * width > CELLS:
        return []
    lows = [min(m - width, max(0, i * m // n - width // 2)) for i in range(n)]
    rows, row = [], np.zeros(width + 1, np.int32)  # row[k]: pairs among the words of a so far and the first lows[i] + k of b
    for i, lo in enumerate(lows):
        if i and (move := min(lo - lows[i - 1], width)):
            row = np.concatenate([row[move:], np.full(move, row[-1], np.int32)])
        new = row.copy()
        np.maximum(new[1:], row[:-1] + (b[lo : lo + width] == a[i]), out=new[1:])
        row = np.maximum.accumulate(new)
        rows.append(row)
    out, j = [], m
    for i in range(n - 1, -1, -1):
        lo, row = lows[i], rows[i]
        k = int(np.searchsorted(row, row[min(j - lo, width)]))  # the first place with as many pairs
        above = int(rows[i - 1][min(k + lo - lows[i - 1], width)]) if i else 0
        if row[k] > above:  # only a pair that ends here can have added one
            j = lo + k - 1
            out.append((i, j))
        else:
            j = lo + k
    return out[::-1]


def _gap(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """Equal runs (start in both, words) that align a gap better than place by place does."""
    if not len(a) or not len(b) or (len(a) == len(b) and len(a) < 3):
        return []
    pairs = paired(a, b)
    ends = [(-1, -1), *pairs, (len(a), len(b))]
    unlike = sum(max(x - p, y - q) - 1 for (p, q), (x, y) in zip(ends[:-1], ends[1:], strict=True))
    both = min(len(a), len(b))
    straight = int((a[:both] == b[:both]).sum())
    if len(pairs) - WRONG * unlike <= straight - WRONG * (max(len(a), len(b)) - straight):
        return []
    out: list = []
    for p, q in pairs:
        if out and (out[-1][0] + out[-1][2], out[-1][1] + out[-1][2]) == (p, q):
            out[-1][2] += 1
        else:
            out.append([p, q, 1])
    return out


def align(a: np.ndarray, b: np.ndarray, anchors: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """Passages (start and end in a, start and end in b, equal places, places) along a chain of blocks (a, b, seeds).

    Words of ``a`` that are KNOWN are equal on the chain's diagonal; only a chain of one block has such.
    """
    i0, j0 = int(anchors[0][0]), int(anchors[0][1])
    back = min(i0, j0)
    cols_a, cols_b, same = [], [], []

    def straight(i: int, j: int, n: int) -> None:
        cols_a.append(np.arange(i, i + n)), cols_b.append(np.arange(j, j + n)), same.append((a[i : i + n] == b[j : j + n]) | (a[i : i + n] == KNOWN))

    straight(i0 - back, j0 - back, back)

    def between(i: int, j: int, x: int, y: int) -> None:
        """Place by place; then what one side has more is unequal, each word of it."""
        both = min(x - i, y - j)
        straight(i, j, both)
        if more := max(x - i, y - j) - both:
            cols_a.append(np.minimum(np.arange(i + both, i + both + more), x - 1 if x > i else i)), cols_b.append(np.minimum(np.arange(j + both, j + both + more), y - 1 if y > j else j)), same.append(np.zeros(more, bool))

    i, j = i0, j0
    for x, y, seeds_here in anchors.tolist():
        skip = max(i - x, j - y, 0)
        x, y, n = x + skip, y + skip, seeds_here + K - 1 - skip
        if n <= 0:
            continue
        for p, q, run in [(i + p, j + q, run) for p, q, run in _gap(a[i:x], b[j:y])]:
            between(i, j, p, q)
            straight(p, q, run)
            i, j = p + run, q + run
        between(i, j, x, y)
        straight(x, y, n)
        i, j = x + n, y + n
    straight(i, j, min(len(a) - i, len(b) - j))
    out = _stretches(np.concatenate(cols_a), np.concatenate(cols_b), np.concatenate(same))
    # seeds of a text that repeats itself have their first place as pivot; its own diagonal may then align better
    x, y, _ = anchors[int(np.argmax(anchors[:, 2]))].tolist()
    lo, n = -min(x, y), min(len(a) - x, len(b) - y)
    if len(anchors) > 1 and n + min(x, y) >= LEAST:
        for new in _stretches(np.arange(x + lo, x + n), np.arange(y + lo, y + n), a[x + lo : x + n] == b[y + lo : y + n]):
            if not any(o[0] <= new[0] and new[1] <= o[1] for o in out):
                out = [o for o in out if not (new[0] <= o[0] and o[1] <= new[1])] + [new]
    return out


def with_exact(out: list[tuple[int, int, int, int, int, int]], a: np.ndarray, b: np.ndarray, runs: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """The passages of a chain with those equal runs (start in both, words) that lie in none of them."""
    for x, y, n in runs.tolist():
        if not any(o[0] <= x and x + n <= o[1] for o in out) and ((a[x : x + n] == b[y : y + n]) | (a[x : x + n] == KNOWN)).all():
            out = [o for o in out if not (x <= o[0] and o[1] <= x + n)] + [(x, x + n, y, y + n, n, n)]
    return out


def _stretches(ca: np.ndarray, cb: np.ndarray, eq: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """The best-scoring stretches of aligned places that have LEAST words or more, none overlapping another."""
    out, todo = [], [(0, len(eq))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < LEAST:
            continue
        sums = np.concatenate([[0], np.cumsum(np.where(eq[lo:hi], 1, -WRONG))])
        low = np.minimum.accumulate(sums)
        end = int((sums - low).argmax())
        if sums[end] - low[end] < LEAST // 4:
            continue
        start = int(np.flatnonzero(sums[: end + 1] == low[end])[-1])
        s, e = _wider(eq, lo, lo + start, lo + end, hi)
        if ca[e - 1] + 1 - ca[s] >= LEAST:
            out.append((int(ca[s]), int(ca[e - 1]) + 1, int(cb[s]), int(cb[e - 1]) + 1, int(eq[s:e].sum()), e - s))
        todo += [(lo, s), (e, hi)]
    return out


def _wider(eq: np.ndarray, lo: int, s: int, e: int, hi: int) -> tuple[int, int]:
    """A core of best score with what lies beside it, where changes happen to be denser, as long as the whole stays similar."""
    value = np.where(eq, 1, -2)
    left, right = np.cumsum(value[lo:s][::-1]), np.cumsum(value[e:hi])
    s2 = s - (int(left.argmax()) + 1 if len(left) and left.max() > 0 else 0)
    e2 = e + (int(right.argmax()) + 1 if len(right) and right.max() > 0 else 0)
    return (s2, e2) if (WRONG + 1) * eq[s2:e2].sum() > WRONG * (e2 - s2) else (s, e)


PASSAGE = "doc_id long, start long, end long, source_doc_id long, source_start long, source_end long, n_equal long, n_places long"
FOUND = PASSAGE + ", sub long"


def _aligned(batches):
    names = [x.split()[0] for x in FOUND.split(", ")]
    for batch in batches:
        out = []
        for r in range(batch.num_rows):
            doc, sub, source, start, s_start, s_end, words, anchors, equal_runs, first, theirs = (batch.column(k)[r].as_py() for k in range(11))
            a = np.frombuffer(words, "<u4")
            b = np.zeros(s_end - s_start, "<u4") if theirs is None else np.frombuffer(theirs, "<u4")[s_start - first : s_end - first]
            shift = np.array([start, s_start, 0])
            spots, runs = (np.frombuffer(x, "<i4").reshape(-1, 3).astype(np.int64) - shift for x in (anchors, equal_runs))
            for x, y, p, q, equal, places in with_exact(align(a, b, spots), a, b, runs):
                out.append((doc, start + x, start + y, source, s_start + p, s_start + q, equal, places, sub))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)


def _segments(batches):
    """The segments that are asked for of each document: (source_doc_id, source_sub, level, seg, theirs)."""
    for batch in batches:
        for rows, data, offsets in text.documents([batch], 2):
            word, _, _, at = hashed_words(data, offsets)
            short, out = _short(word), []
            for r, wanted in enumerate(rows.column(3).to_pylist()):
                mine = short[at[r] : at[r + 1]]
                out += [(r, x["level"], x["seg"], mine[x["seg"] << x["level"] : (x["seg"] + 2) << x["level"]].tobytes()) for x in wanted]
            which = pa.array([x[0] for x in out], pa.int64())
            columns = [rows.column(0).take(which), rows.column(1).take(which), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["source_doc_id", "source_sub", "level", "seg", "theirs"])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with __id and __sub, which tells texts of a repeated id apart: their hash, or 0 for an id that occurs once."""
    shared.prepared(docs.sparkSession)
    keyed = docs.withColumn("__id", F.col(id_col).cast("long"))
    again = keyed.where("__id is not null").groupBy("__id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("__id").alias("__again"))
    again, _ = shared.written(again, "again")
    return keyed.join(again, F.col("__id") == F.col("__again"), "left").withColumn("__sub", F.when(F.col("__again").isNotNull(), F.xxhash64(text_col)).otherwise(F.lit(0).cast("long"))).drop("__again")


def _found(keyed: DataFrame, text_col: str, docs: DataFrame) -> DataFrame:
    """Passages with the sub of their row (FOUND) of ``_rows``."""
    spark = keyed.sparkSession
    rows = keyed.select(F.col("__id").alias("id"), F.col("__sub").alias("sub"), F.col(text_col).alias("text")).where("id is not null")
    staged, staged_at, n = exchange.stage(rows, "sub", like=docs)
    first, first_at = shared.written(exchange.answer(exchange.ask(staged, n, _which), 1, _in_two_batches), "answers")
    asked = exchange.meet(staged, first, _places(n), "bucket int, batch long, blob binary")
    second, second_at = shared.written(exchange.answer(asked, 2, _pivots), "answers")
    found, found_at = shared.written(exchange.meet(staged, first.union(second), _chained(n), CHAIN), "chains")
    shared.removed(spark, staged_at, first_at, second_at)
    # a source gives out each segment that some chain needs of it, and only those travel on
    asking = found.where("level >= 0").withColumn("seg", F.expr("shiftright(source_start, level)"))
    place = ["source_doc_id", "source_sub", "level", "seg"]
    wanted, wanted_at = shared.written(asking.select(*place).distinct().groupBy("source_doc_id", "source_sub").agg(F.collect_list(F.struct("level", "seg")).alias("segs")), "wanted")
    sources = rows.join(wanted, (F.col("id") == F.col("source_doc_id")) & (F.col("sub") == F.col("source_sub"))).select("id", "sub", "text", "segs")
    cut = sources.mapInArrow(_segments, "source_doc_id long, source_sub long, level int, seg long, theirs binary")
    names = ["doc_id", "sub", "source_doc_id", "start", "source_start", "source_end", "words", "anchors", "equal"]
    met = asking.join(cut, place).select(*names, F.expr("shiftleft(seg, level)").alias("first"), "theirs")
    alone = found.where("level < 0").select(*names, F.lit(0).cast("long").alias("first"), F.lit(None).cast("binary").alias("theirs"))
    out, _ = shared.written(met.union(alone).mapInArrow(_aligned, FOUND).distinct(), "passages")
    shared.removed(spark, wanted_at, found_at)
    return out


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages of documents that, exactly or nearly, also lie in a document with a smaller id (PASSAGE)."""
    return _found(_rows(docs, id_col, text_col), text_col, docs).drop("sub").distinct()


def _cut(at: int, size_at: int | None):
    """Rows with the spans (the last column) cut out of the text, column ``at``; those without a word left go."""

    def run(batches):
        for batch in batches:
            data, offsets = text.buffers(batch.column(at))
            starts, ends, doc = text.words(data, offsets)
            words = text.spans_of(doc, len(offsets) - 1)
            lists = batch.column(batch.num_columns - 1)
            out = []
            for r in range(batch.num_rows):
                raw = data[offsets[r] : offsets[r + 1]]
                keep = np.ones(len(raw), bool)
                s, e = starts[words[r] : words[r + 1]] - offsets[r], ends[words[r] : words[r + 1]] - offsets[r]
                for x in lists[r].as_py():
                    keep[s[x["start"]] : e[x["end"] - 1]] = False
                out.append(raw[keep].tobytes().decode())
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            columns[at] = pa.array(out, pa.string())
            if size_at is not None:
                columns[size_at] = pa.array([len(x) for x in out], columns[size_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1]).filter(pa.array([bool(x.strip(" \t\n\v\f\r")) for x in out]))

    return run


def without_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with its repeated passages cut out of the text; a document that is nothing but such passages goes.

    Only documents with a passage pass through Python. Each row loses the passages of its own text; null ids stay as they
    are. ``size_col``, if ``docs`` has it, becomes the new text's number of characters.
    """
    keyed = _rows(docs, id_col, text_col)
    spans = _found(keyed, text_col, docs).groupBy(F.col("doc_id").alias("__doc"), F.col("sub").alias("__text_of")).agg(F.collect_set(F.struct("start", "end")).alias("__spans"))
    spans, _ = shared.written(spans, "spans")
    met = keyed.join(spans, (F.col("__id") == F.col("__doc")) & (F.col("__sub") == F.col("__text_of")), "left")
    names, fields = docs.columns, {f.name: f for f in docs.schema}
    met, _ = shared.written(met.select(*(F.col(f"`{c}`") for c in names), "__spans"), "spans")
    schema = ", ".join(f"`{c}` {'string' if c == text_col else fields[c].dataType.simpleString()}" for c in names)
    cut = met.where("__spans is not null").mapInArrow(_cut(names.index(text_col), names.index(size_col) if size_col in names else None), schema)
    return met.where("__spans is null").drop("__spans").union(cut)
