"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union-find grouping.

A document's set is its distinct shingles of ``length`` words (2) over words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a
shorter document has all its words as its only element; one without words has the empty set and is linked with nothing. Two documents
are linked if 100 * |A & B| >= 80 * |A | B| (``similarity``), and a component is what links reach.

SuperMinHash gives every element its own random permutation of the m components and a rank for each: component k of the
signature is the smallest ``rank + fraction`` of any element there. Ranks are dealt one level at a time by a lazy
Fisher-Yates shuffle, and dealing stops at the level above every component's value, since no later rank can lower one.

Steps, none of which holds a group in one task:

1. one pass over the text makes each document's set size, set digest (128 bits) and band keys;
2. documents with equal sets are one class, by digest;
3. for each band key the smallest class is the pivot; every other class is verified against it on full sets;
4. components of those links; then components that share a band key are held against each other, block by block,
   through inverted indexes of full sets, and the links found join them. Pairs within a component need no more work.

With 28 bands of 4 rows a pair at the threshold misses every band with probability (1 - 0.8**4)**28 < 4e-7.

Nulls and empty texts: n_shingles 0, a component of their own. Rows that repeat a doc_id are one node of the graph, linked
by any of their texts, and each row is returned with its own n_shingles. A null doc_id has no component to name: it is returned with component_id null and kept true.
Columns other than ``id_col`` and ``text_col`` are ignored, so names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import shared, text
from .components import PART, components, hung, lowest

SIZE, BANDS, ROWS = 112, 28, 4
#: Classes in a block of each side where components are held against each other, and shingles for each of these places.
BLOCK, CHUNK, WEIGHT = 2000, 500, 500
#: Rows of a link's size that a text counts as where parts are cut.
TEXT = 50
_U = np.uint64
_FRACTION = _U(0xFFFFFFFF)


def shingles(data: np.ndarray, offsets: np.ndarray, length: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each document, sorted within it, and the offsets of each document's."""
    n_docs = len(offsets) - 1
    low = text.LOWER[data]
    starts, ends, doc = text.words(low, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    word = text.Rolling(low).of(starts, ends)
    at = text.spans_of(doc, n_docs)

    def joined(first: np.ndarray, n: int) -> np.ndarray:
        out = word[first]
        for i in range(1, n):
            out = text.mix(out * _U(0xA24BAED4963EE407) ^ text.mix(word[first + i]))
        return out

    n = max(0, len(word) - length + 1)
    same = np.flatnonzero(doc[:n] == doc[len(doc) - n :])
    short = [np.flatnonzero(np.diff(at) == k) for k in range(1, length)]
    owner = np.concatenate([doc[same], *short])
    value = np.concatenate([joined(same, length), *(text.mix(joined(at[d], k) + _U(k)) for k, d in enumerate(short, 1))])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return value[fresh], text.spans_of(owner[fresh], n_docs)


def signature(elements: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The SuperMinHash signature (uint64: rank in the high, fraction in the low 32 bits) of distinct 64-bit elements."""
    out = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    if not len(elements):
        return out
    draw = text.mix(elements + _U(0x632BE59BD9B4E019))
    place = ((draw >> _U(32)) * _U(size) >> _U(32)).astype(np.intp)
    np.minimum.at(out, place, draw & _FRACTION)
    if int(out.max()) < 1 << 32:
        return out
    n = len(elements)
    row = np.arange(n)
    dealt = np.tile(np.arange(size, dtype=np.int16), (n, 1))
    dealt[row, place] = 0
    dealt[:, 0] = place
    for level in range(1, size):
        draw = text.mix(elements ^ _U((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        pick = level + ((draw >> _U(32)) * _U(size - level) >> _U(32)).astype(np.intp)
        place = dealt[row, pick].astype(np.intp)
        dealt[row, pick] = dealt[:, level]
        dealt[:, level] = place
        np.minimum.at(out, place, (draw & _FRACTION) | _U(level << 32))
        if int(out.max()) < (level + 1) << 32:
            break
    return out


def band_keys(sketch: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    key = np.arange(bands, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
    for part in sketch[: bands * rows].reshape(bands, rows).T:
        key = text.mix(key ^ part)
    return key.view(np.int64)


_SKETCHED = "id long, th long, n_shingles long, d1 long, d2 long, bands array<long>"


def _sketch(length: int):
    def sketch(batches):
        for rows, data, offsets in text.documents(batches, 1):
            values, at = shingles(data, offsets, length)
            sizes = np.diff(at)
            sums = [np.zeros(len(values) + 1, np.uint64) for _ in range(2)]
            for total, salt in zip(sums, (_U(0x8CB92BA72F3D8DD7), _U(0xD6E8FEB86659FD93)), strict=True):
                np.cumsum(text.mix(values ^ salt), dtype=np.uint64, out=total[1:])
            d1, d2 = ((s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums)
            keys = [band_keys(signature(values[a:b])) if b > a else None for a, b in zip(at[:-1], at[1:], strict=True)]
            flat = np.concatenate([k for k in keys if k is not None] or [np.zeros(0, np.int64)])
            ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(sizes), pa.array(d1), pa.array(d2), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "th", "n_shingles", "d1", "d2", "bands"])

    return sketch


def _linked(percent: int, length: int):
    def verified(batches):
        for batch in batches:
            sizes = sum(np.diff(text.buffers(batch.column(k))[1]) for k in (2, 3))
            for lo, hi in text.slices(np.concatenate([[0], np.cumsum(sizes)])):
                part = batch.slice(lo, hi - lo)
                sides = [shingles(*text.buffers(part.column(k)), length) for k in (2, 3)]
                keep = np.zeros(hi - lo, bool)
                for i in range(hi - lo):
                    a, b = (v[at[i] : at[i + 1]] for v, at in sides)
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    keep[i] = both > 0 and 100 * both >= percent * (len(a) + len(b) - both)
                yield pa.RecordBatch.from_arrays([part.column(k).filter(pa.array(keep)) for k in (0, 1)], names=["u", "v"])

    return lambda batches: hung(verified(batches))


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, length: int) -> DataFrame:
    """Of pairs of classes (u, ut) and (v, vt), the links (u, v) whose full sets are similar enough, as each task's stars of them."""
    # merge joins at every size: a hot pivot's pairs are split where they are many, and plans don't change with the input
    sides = [texts.withColumnsRenamed({"id": k, "th": f"{k}t", "text": t}) for k, t in (("u", "a"), ("v", "b"))]
    met = pairs.hint("merge").join(sides[0], ["u", "ut"]).hint("merge").join(sides[1], ["v", "vt"])
    return met.select("u", "v", "a", "b").mapInArrow(_linked(percent, length), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = 80, length: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``; see the module's docstring."""
    spark = shared.prepared(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    seen = Observation()
    sketch, _ = shared.written(source.mapInArrow(_sketch(length), _SKETCHED).observe(seen, F.count(F.lit(1)).alias("n")), "sketch")
    docs_n = seen.get["n"]
    full = sketch.where("n_shingles > 0 and id is not null")
    # aggregates are written before they are joined: Spark then knows their sizes and can split a hot key of the other side
    # a class is named by its smallest id and by that row's text, as an id may have several texts; its band keys come from that row
    classes = full.groupBy("d1", "d2").agg(F.min(F.struct("id", "th", "n_shingles", "bands")).alias("r"))
    classes, classes_at = shared.written(_packed(classes.select("d1", "d2", F.col("r.id").alias("rep"), F.col("r.th").alias("rt"), F.col("r.n_shingles").alias("n"), F.col("r.bands").alias("bands")), docs_n, BANDS), "classes")
    keyed = classes.select("rep", "rt", "n", F.explode("bands").alias("band"))
    pivots = keyed.groupBy("band").agg(F.min(F.struct("rep", "rt", "n")).alias("p"), F.count(F.lit(1)).alias("k")).where("k > 1").select("band", "p")
    shared_keys, shared_at = shared.written(_packed(pivots, docs_n * BANDS), "pivots")
    met, met_at = shared.written(_packed(keyed.join(shared_keys, "band").where("rep <> p.rep"), docs_n * BANDS), "met")
    near = f"100 * least(n, m) >= {similarity} * greatest(n, m)"
    first = met.select(F.col("p.rep").alias("u"), F.col("p.rt").alias("ut"), F.col("rep").alias("v"), F.col("rt").alias("vt"), "n", F.col("p.n").alias("m"))
    pairs, pairs_at = shared.written(_packed(first.where(near).select("u", "ut", "v", "vt").distinct(), docs_n * BANDS), "pairs")
    ids = pairs.select(F.col("u").alias("id"), F.col("ut").alias("th")).union(pairs.select("v", "vt")).distinct()
    texts, texts_at = shared.written(_packed(_texts(source, ids), docs_n, TEXT), "texts")
    # rows that repeat an id are one node: it is linked with the class of each of them
    again = sketch.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("id")
    one = full.join(again, "id").join(classes.select("d1", "d2", "rep"), ["d1", "d2"]).where("id <> rep").select(F.col("rep").alias("u"), F.col("id").alias("v")).distinct()
    one, one_at = shared.written(_packed(one, docs_n), "again")
    comps, comps_at = components(_verified(pairs, texts, similarity, length).union(one))
    shared.removed(spark, pairs_at, texts_at, one_at)
    more, more_at = _across(source, classes.select("rep", "rt", "n"), met, comps, docs_n, similarity, length)
    if more is not None:
        old = comps_at
        comps, comps_at = components(comps.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))
        shared.removed(spark, *old, *more_at)
    shared.removed(spark, shared_at, met_at)
    named = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    named, _ = shared.written(_packed(named, docs_n), "named")
    # a row without words stands where other rows of its id do
    hollow, _ = shared.written(sketch.where("n_shingles = 0 and id is not null").select("id").distinct().join(comps.withColumnRenamed("node", "id"), "id").select(F.col("id").alias("hollow_id"), F.col("component").alias("own")), "hollow")
    shared.removed(spark, classes_at, *comps_at)
    out = sketch.withColumn("known", F.expr("n_shingles > 0 and id is not null"))
    out = out.join(named.withColumn("known", F.lit(True)), ["d1", "d2", "known"], "left")
    out = out.join(hollow, (F.col("n_shingles") == 0) & (F.col("id") == F.col("hollow_id")), "left")
    where = F.coalesce("component_id", "own", "id")
    return out.select(F.col("id").alias("doc_id"), "n_shingles", where.alias("component_id"), F.coalesce(where == F.col("id"), F.lit(True)).alias("kept"))


def _texts(source: DataFrame, ids: DataFrame) -> DataFrame:
    """The text of each (id, th); rows that repeat both are one. A merge join at every size, as in _verified."""
    return source.where("id is not null").join(ids.hint("merge"), ["id", "th"], "left_semi").groupBy("id", "th").agg(F.min("text").alias("text"))


def _packed(rows: DataFrame, most: int, weight: int = 1) -> DataFrame:
    """``rows``, at most ``most`` of them, in parts of about ``PART``, to be written: small tables in many files cost more than their rows."""
    return rows.coalesce(max(8, -(-most * weight // PART)))


def _across(source: DataFrame, reps: DataFrame, met: DataFrame, comps: DataFrame, docs_n: int, percent: int, length: int):
    """Links between components that share a band key, lazily, and the paths they read, or None twice if none share one.

    Components that share keys form a cluster. All of a cluster's classes outside its largest component are held against
    all of its classes. Both sides are cut into blocks of bounded numbers of classes and shingles, each pair of blocks is a task's work, and only
    links are emitted: no row is made for a pair.
    """
    spark = source.sparkSession
    in_comp = comps.withColumnRenamed("node", "rep")
    # a band's components all touch that of its pivot
    placed = met.select("rep", F.col("p.rep").alias("top")).join(in_comp, "rep", "left").select("top", F.coalesce("component", "rep").alias("u"))
    placed = placed.join(in_comp.withColumnRenamed("rep", "top"), "top", "left").select("u", F.coalesce("component", "top").alias("v"))
    clusters, clusters_at = components(_packed(placed, docs_n * BANDS).where("u <> v").mapInArrow(hung, "u long, v long"))
    if clusters.isEmpty():
        shared.removed(spark, *clusters_at)
        return None, None
    members = reps.join(in_comp, "rep", "left").select("rep", "rt", "n", F.coalesce("component", "rep").alias("c")).join(clusters.select(F.col("node").alias("c"), F.col("component").alias("cluster")), "c")
    members, members_at = shared.written(_packed(members, docs_n), "members")
    sizes = members.groupBy("cluster", "c").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    sizes = sizes.groupBy("cluster").agg(F.sum("k").alias("k"), F.sum("n").alias("n"), F.max(F.struct("k", "n", "c")).alias("top"))
    parts = lambda k, n, most, weight: F.ceil(F.greatest(k / most, n / weight)).cast("int")
    loose = (F.col("k") - F.col("top.k"), F.col("n") - F.col("top.n"))
    sizes = sizes.select("cluster", F.col("top.c").alias("top"), parts(F.col("k"), F.col("n"), BLOCK, BLOCK * WEIGHT).alias("nb"), parts(*loose, CHUNK, CHUNK * WEIGHT).alias("nc"))
    sizes, sizes_at = shared.written(_packed(sizes, docs_n), "sizes")
    texts = _texts(source, members.select(F.col("rep").alias("id"), F.col("rt").alias("th")))
    rows = members.join(sizes, "cluster").join(texts.withColumnsRenamed({"id": "rep", "th": "rt"}), ["rep", "rt"])
    every = rows.select("cluster", F.expr("cast(pmod(xxhash64(rep, rt), nb) as int)").alias("block"), F.explode(F.expr("sequence(0, nc - 1)")).alias("chunk"), F.lit(False).alias("open"), "rep", "c", "text")
    loose = rows.where("c <> top").select("cluster", F.explode(F.expr("sequence(0, nb - 1)")).alias("block"), F.expr("cast(pmod(xxhash64(rep, rt, 1), nc) as int)").alias("chunk"), F.lit(True).alias("open"), "rep", "c", "text")
    links = every.union(loose).groupBy("cluster", "block", "chunk").applyInArrow(_block_links(percent, length), "u long, v long")
    return links, [*clusters_at, members_at, sizes_at]


def _block_links(percent: int, length: int):
    def sets(rows: pa.Table):
        values, ends = [], [0]
        for lo, hi in text.slices(text.buffers(rows["text"])[1]):
            got, at = shingles(*text.buffers(rows["text"].slice(lo, hi - lo)), length)
            values.append(got)
            ends.extend(ends[-1] + at[1:])
        return np.concatenate(values or [np.zeros(0, np.uint64)]), np.array(ends)

    def find(group: pa.Table) -> pa.Table:
        is_open = np.asarray(group["open"])
        held, loose = group.filter(pa.array(~is_open)), group.filter(pa.array(is_open))
        u, v = [], []
        if held.num_rows and loose.num_rows:
            values, at = sets(held)
            size = np.diff(at)
            owner = np.repeat(np.arange(len(size)), size)
            order = np.argsort(values, kind="stable")
            token, owner = values[order], owner[order]
            comp, rep = np.asarray(held["c"]), np.asarray(held["rep"])
            theirs, own = sets(loose)
            for i, (r, c) in enumerate(zip(loose["rep"].to_pylist(), loose["c"].to_pylist(), strict=True)):
                mine = theirs[own[i] : own[i + 1]]
                lo, hi = np.searchsorted(token, mine), np.searchsorted(token, mine, side="right")
                both = np.bincount(owner[text.ragged(lo, hi - lo)], minlength=len(size))
                hit = np.flatnonzero((both > 0) & (100 * both >= percent * (size + len(mine) - both)) & (comp != c))
                for k in hit[np.unique(comp[hit], return_index=True)[1]]:  # one link to each component is enough
                    u.append(r)
                    v.append(int(rep[k]))
        node, low = lowest(np.array(u, np.int64), np.array(v, np.int64))
        return pa.table({"u": node[node != low], "v": low[node != low]})

    return find
