"""Exact top-k search by inner product with block-at-a-time pruning.

A component x of a vector becomes floor(1024 * x); the terms of a query are its components. Candidates are put in an order
in which neighbours are alike (by the nearest of ``PIVOTS`` vectors, a sample by hash, then by id), cut into ranges, and
each range into blocks of ``BLOCK`` vectors. For every term a block keeps the largest and smallest component of its
vectors, so the sum over a query's terms of the larger product bounds every score in the block. Per query, blocks are
taken in falling order of their bounds, in growing steps, and scored whole through the block's forward index (its rows),
until a bound falls below the k-th score so far.

A query is first searched in the range it lies in itself; the k-th score there is a floor that goes with it to all other
ranges: blocks bounded below the floor are not scored, and scores below it are not returned. Then queries, in chunks of
about ``CHUNK``, meet candidates in groups of ``GROUP`` ranges, one task for each pair of a chunk and a group; a task
carries each query's best from block to block through the whole group. Both sides of a task are bounded, nothing is
broadcast but the pivots, and a query set that grows with the table adds chunks. The best k of all groups are taken by a
ranked window, which Spark limits to k rows of a query in each task before it shuffles.

Bounds only cut where blocks are alike: on vectors that point anywhere, at 64 dimensions, every block's bound is above any
k-th score, and all are scored (``scored`` counts them).

Scores are exact: products are summed in doubles where 2**53 bounds them, else in 64-bit integers; a component that has
no exact integer (2**53 or more) and scores that 64 bits may not hold raise an error. Ties go to the smaller id. Vectors
that are null or empty, or hold null or non-finite components, take no part, nor do rows with a null id. A row that
repeats an id is a vector of its own, but a query never meets a row with its own id; rows that repeat a query's id are each
searched and ranked together, so a candidate may occur once for each. Vectors of unlike lengths count as padded with
zeros. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

BLOCK, RANGE, GROUP, CHUNK, PIVOTS = 64, 4096, 2, 2048, 64
_EXACT = float(1 << 53)
_WORST = np.iinfo(np.int64).min


def search(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, block: int = BLOCK, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and ids of each query's best k rows (the least 64-bit score where there are fewer), and blocks scored.

    Rows are in any order; all components are integers held as doubles or 64-bit integers. Scores below ``floors`` may be missing.
    """
    n, nq = len(rows), len(queries)
    starts = np.arange(0, n, block)
    high, low = np.maximum.reduceat(rows, starts), np.minimum.reduceat(rows, starts)
    pos, neg = np.maximum(queries, 0), np.minimum(queries, 0)
    bound = pos @ high.T + neg @ low.T
    order = np.argsort(-bound, axis=1, kind="stable")
    last = np.iinfo(np.int64).max
    best = np.full((nq, k), _WORST, np.int64)
    who = np.full((nq, k), -1, np.int64)
    floor = np.full(nq, _WORST, np.int64) if floors is None else floors
    active, scored, turn, step = np.arange(nq), 0, 0, 1
    while turn < len(starts) and len(active):
        # the next blocks of every query that is still going: one, one, two, four, ... so that later blocks meet many queries at once
        pick = order[active, turn : turn + step]
        going = np.take_along_axis(bound[active], pick, 1).astype(np.int64) >= np.maximum(best[active, -1], floor[active])[:, None]  # an equal score may still win a tie
        who_goes, _ = np.nonzero(going)
        q_of, b_of = active[who_goes], pick[going]
        by_block = np.argsort(b_of, kind="stable")
        for part in np.split(by_block, np.flatnonzero(np.diff(b_of[by_block])) + 1) if len(b_of) else ():
            q, a = q_of[part], starts[b_of[part[0]]]
            found = ids[a : a + block]
            score = (queries[q] @ rows[a : a + block].T).astype(np.int64)
            scored += len(q)
            score[(found[None, :] == query_ids[q][:, None]) | (score < np.maximum(best[q, -1], floor[q])[:, None])] = _WORST
            some = np.flatnonzero((score > _WORST).any(1))
            if not len(some):
                continue
            q, score = q[some], score[some]
            both_s = np.concatenate([best[q], score], axis=1)
            both_i = np.concatenate([who[q], np.broadcast_to(found, score.shape)], axis=1)
            none = both_s == _WORST
            top = np.lexsort((np.where(none, last, both_i), np.where(none, last, -both_s)), axis=1)[:, :k]
            best[q], who[q] = np.take_along_axis(both_s, top, 1), np.take_along_axis(both_i, top, 1)
        active = active[going[:, -1]] if pick.shape[1] else active[:0]  # bounds fall: one that is too low ends its query
        turn, step = turn + step, max(1, min(64, turn + step))
    return best, who, scored


def _dense(widths: np.ndarray, value: np.ndarray, wide: int) -> np.ndarray:
    out = np.zeros((len(widths), wide), np.int64)
    out[np.arange(wide)[None, :] < widths[:, None]] = value
    return out


def _exact(queries: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both padded to one width, as doubles if no sum of products can pass 2**53."""
    wide = max(queries.shape[1], rows.shape[1])
    queries, rows = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (queries, rows))
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, wide)
    if most >= 2.0**63:
        raise OverflowError("inner products may pass 64 bits")
    return (queries.astype(np.float64), rows.astype(np.float64)) if most < _EXACT else (queries, rows)


def _lists(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of a column of lists."""
    lists = batch.column(column)
    return np.diff(np.asarray(lists.offsets).astype(np.int64)), np.asarray(lists.flatten()).astype(np.int64)


def _keyed(pivots: np.ndarray):
    """(id, asked, near, v): each vector with the pivot that points most its way."""

    def run(batches):
        for batch in batches:
            width, value = _lists(batch, 2)
            if len(value) and float(np.abs(value.astype(np.float64)).max()) >= _EXACT:
                raise ValueError("a component times 1024 is 2**53 or more: it has no exact integer")
            near = np.zeros(batch.num_rows, np.int32)
            if len(pivots) and batch.num_rows:
                wide = max(int(width.max()), pivots.shape[1])
                at = np.pad(pivots, ((0, 0), (0, wide - pivots.shape[1])))
                near = (_dense(width, value, wide).astype(np.float64) @ at.T).argmax(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near), batch.column(2)], names=["id", "asked", "near", "v"])

    return run


_PACKED = "part int, asked boolean, ids binary, widths binary, items binary, floors binary"


def _packed(k: int, per_row: int, scored):
    """Rows of up to ``per_row`` candidates, and one of the queries among them, which are searched there for their floors."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for batch in batches:
            for lo in range(0, batch.num_rows, per_row):
                piece = batch.slice(lo, per_row)
                ids, asked = np.asarray(piece.column(0)).astype(np.int64), np.asarray(piece.column(1))
                width, value = _lists(piece, 2)
                small = len(value) == 0 or int(np.abs(value).max()) < 1 << 31

                def row(pick, values, floors, is_query, ids=ids, width=width, small=small):
                    blobs = (ids[pick].astype("<i8"), width[pick].astype("<i4"), values.astype("<i4" if small else "<i8"), floors.astype("<i8"))
                    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([is_query]), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], names=[x.split()[0] for x in _PACKED.split(", ")])

                yield row(slice(None), value, np.zeros(0), False)
                if asked.any():
                    rows = _dense(width, value, int(width.max()))
                    queries, held = _exact(rows[asked], rows)
                    best, _, n = search(queries, ids[asked], held, ids, k)
                    if scored is not None:
                        scored.add(n)
                    yield row(asked, value[np.repeat(asked, width)], best[:, -1], True)

    return run


def _opened(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, components and floors of packed rows, in the order of their parts."""
    parts = []
    for ids, widths, items, floors in zip(*(table[c].to_pylist() for c in ("ids", "widths", "items", "floors")), strict=True):
        width = np.frombuffer(widths, "<i4")
        size = len(items) // max(1, int(width.sum()))
        parts.append((np.frombuffer(ids, "<i8"), width, np.frombuffer(items, f"<i{size}"), np.frombuffer(floors, "<i8")))
    wide = max(int(p[1].max()) for p in parts)
    return np.concatenate([p[0] for p in parts]), np.concatenate([_dense(w, v, wide) for _, w, v, _ in parts]), np.concatenate([p[3] for p in parts])


def _meet(k: int, scored):
    names = ["query_id", "vec_id", "score"]

    def run(chunk: pa.Table, group: pa.Table) -> pa.Table:
        if not chunk.num_rows or not group.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names=names)
        query_ids, queries, floors = _opened(chunk)
        ids, rows, _ = _opened(group)
        queries, rows = _exact(queries, rows)
        best, who, n = search(queries, query_ids, rows, ids, k, floors=floors)
        if scored is not None:
            scored.add(n)
        q, r = np.nonzero(best > _WORST)
        return pa.table([pa.array(x, pa.int64()) for x in (query_ids[q], who[q, r], best[q, r])], names=names)

    return run


def top_k(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scored: Accumulator | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` (a condition on the id column) the best k others.

    ``scored``, an accumulator, counts pairs of a query and a block that was scored for it.
    """
    spark = shared.prepared(vectors.sparkSession)
    good = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col(id_col).isNotNull() & good).withColumn(id_col, F.col(id_col).cast("long"))
    # a component is held to 2**60, far over what is refused, so that the cast itself never fails or wraps
    held = lambda x: F.greatest(F.lit(-(2.0**60)), F.least(F.lit(2.0**60), x.cast("double") * 1024))
    rows = rows.select(F.col(id_col).alias("id"), F.coalesce(is_query, F.lit(False)).alias("asked"), F.transform(vector_col, lambda x: F.floor(held(x)).cast("long")).alias("v"))
    sample = [x["v"] for x in rows.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()]
    pivots = np.zeros((len(sample), max(map(len, sample), default=0)))
    for at, x in zip(pivots, sample, strict=True):
        at[: len(x)] = x
    pivots /= np.maximum(1, np.linalg.norm(pivots, axis=1, keepdims=True))
    whole, _ = shared.written(rows.mapInArrow(_keyed(pivots), "id long, asked boolean, near int, v array<long>"), "vectors")
    counts = whole.agg(F.count(F.lit(1)).alias("n"), F.count_if("asked").alias("q")).first()
    n = max(1, -(-counts["n"] // RANGE))
    salted = whole.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))  # parts rows that repeat an id
    ordered = salted.repartitionByRange(n, "near", "id", "salt").sortWithinPartitions("near", "id").select("id", "asked", "v")
    packed, _ = shared.written(ordered.mapInArrow(_packed(k, RANGE, scored), _PACKED), "ranges")
    groups, chunks = -(-n // GROUP), max(1, -(-counts["q"] // CHUNK))
    every = lambda upto: F.explode(F.sequence(F.lit(0), F.lit(upto - 1)))
    held = packed.where("not asked").withColumn("g", F.floor(F.col("part") / GROUP).cast("int") % groups).withColumn("c", every(chunks))
    asked = packed.where("asked").withColumn("c", F.floor(F.col("part") * chunks / n).cast("int") % chunks).withColumn("g", every(groups))
    found = asked.groupBy("g", "c").cogroup(held.groupBy("g", "c")).applyInArrow(_meet(k, scored), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
