"""Connected components of a graph given as a table of links, by local stars and alternating large-star and small-star steps.

``hung`` lets the task that makes links hang each ``PART`` of them on the smallest nodes they reach, before anything is
written. If no more than ``PART`` links are written, one task ends the job, in 4 MB of links. Otherwise steps follow that are one
aggregate and one join each, so no task or driver ever holds more than ``PART`` links; a node with very many links is the
many side of a join whose other side has one row for each node, which adaptive execution splits. The aggregate that opens
a round also tells whether the links are stars already, so no further round is run to see that nothing changes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import shared


#: Links in a part of a written table, and links that a task holds at a time.
PART = 250_000


def lowest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links, sorted, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at.reshape(2, -1)
    low = np.arange(len(nodes))
    while True:
        x, y = low[a], low[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[low]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while ((up := low[low]) != low).any():
            low = up


def hung(batches, most: int = PART, tops: bool = False):
    """Each ``most`` links (u, v) of a task as stars of (node, smallest node reached); tops: with each smallest node on itself."""

    def stars(held):
        links = pa.Table.from_batches(held)
        node, low = lowest(*(links.column(k).to_numpy() for k in (0, 1)))
        keep = slice(None) if tops else node != low
        return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(low[keep])], names=["u", "v"])

    held, n = [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, most):
            part = batch.slice(lo, most)
            if n and n + part.num_rows > most:
                yield stars(held)
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if n:
        yield stars(held)


def _ended(batches):
    """(node, component) of at most ``PART`` links."""
    for batch in hung(batches, tops=True):
        yield batch.rename_columns(["node", "component"])


def _lows(edges: DataFrame, large: bool, parts: int) -> tuple[DataFrame, DataFrame, str, int]:
    """The sides of links (u > v) whose neighbourhoods count, their smallest nodes, written, and the path of these.

    Also counts the nodes that have a smaller neighbour and another one: if there is none of both sides (large), all links
    are stars. The smallest nodes are written before they are joined: a join with a table can be broadcast, or split at a
    node with very many links. Tables have about ``parts`` parts, by the number of links.
    """
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select("u", "v")
    seen = Observation()
    low = both.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("w")).observe(seen, F.sum(F.expr("cast(v < u and v < w as long)")).alias("bent"))
    low, path = shared.written(low.select("u", F.least("v", "u").alias("m")).coalesce(parts), "low")
    return both, low, path, seen.get["bent"] or 0


def _star(both: DataFrame, low: DataFrame, large: bool, parts: int) -> DataFrame:
    """Hang neighbours on the smallest node of each neighbourhood: the larger ones (large) or the others (small)."""
    met = both.join(low, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct().coalesce(parts)


def _written(edges: DataFrame) -> tuple[DataFrame, str, int]:
    """The written links, their path and their number, taken as they are written."""
    seen = Observation()
    out, path = shared.written(edges.observe(seen, F.count(F.lit(1)).alias("n")), "links")
    return out, path, seen.get["n"]


def components(edges: DataFrame) -> tuple[DataFrame, list[str]]:
    """(node, component) for each node that has a link to another node, where component is the smallest node reachable.

    ``edges`` has long columns u and v; repeated links, links to itself and either direction are fine. It is read once, so
    it need not be written. Also returns the shared paths that the result reads.
    """
    spark = edges.sparkSession
    now, path, n = _written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    if n <= PART:
        nodes, at = shared.written(now.coalesce(1).mapInArrow(_ended, "node long, component long"), "low")
        shared.removed(spark, path)
        return nodes, [at]
    while True:
        parts = max(8, -(-n // PART))
        both, low, low_at, bent = _lows(now, True, parts)
        if not bent:
            shared.removed(spark, low_at)
            break
        step, at = shared.written(_star(both, low, True, parts), "links")
        both, low, more, _ = _lows(step, False, parts)
        nxt, new, n = _written(_star(both, low, False, parts))
        shared.removed(spark, path, low_at, at, more)
        now, path = nxt, new
    # links that no round has met may be repeated
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    nodes, at = shared.written(nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct(), "components")
    shared.removed(spark, path)
    return nodes, [at]
