"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A word is a run of ASCII letters, digits and bytes from 0x80 on, with A-Z lower-cased. A text's features are the distinct
hashes (``BITS`` bits) of its words, pairs of neighbours and pairs one word apart. Training visits a bounded sample
(``per_label`` rows of each label, of each text a stretch of at most ``train_chars`` characters) a few times on the
driver, which is sent the features of these rows only: 12 bytes for each word, so at most 2 * ``per_label`` *
``train_chars`` * 6 bytes whatever the tables' sizes. Per-coordinate rates and the L1 term leave few weights that are not
zero, and those are broadcast (at most 2 ** BITS floats, 1 MB).

Null or empty texts get the score of the intercept. Null ids are kept (held_out false). Labels that are null, or ids
without a document, are not learned from; a doc_id with several labels counts with each. With no label at all every
score is 0.5. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, text
from .sampling import bounded_rows, fold, ranked, stretch

BITS = 18
_U = np.uint64
_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Bytes that are in no word become spaces, and A-Z lower-case letters.
_FOLD = np.where(_GAP, 32, text.LOWER).astype(np.uint8)


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each document (sorted within it) and the offsets of each document's."""
    n_docs = len(offsets) - 1
    low = _FOLD[data]
    starts, ends, doc = text.words(low, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(n_docs + 1, np.int64)
    word = text.Rolling(low).of(starts, ends)
    owners, values = [doc], [word]
    for apart, salt in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        if len(word) > apart:
            same = doc[:-apart] == doc[apart:]
            owners.append(doc[:-apart][same])
            values.append(text.mix(word[:-apart] * _U(salt) ^ text.mix(word[apart:] + _U(apart)))[same])
    key = np.unique((np.concatenate(owners).astype(np.uint64) << _U(bits)) | (np.concatenate(values) >> _U(64 - bits)))
    owner = (key >> _U(bits)).astype(np.int64)
    return (key & _U((1 << bits) - 1)).astype(np.int64), text.spans_of(owner, n_docs)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, alpha: float = 0.2, beta: float = 1.0, l1: float = 3.0, l2: float = 1.0, epochs: int = 6, seed: int = 7) -> np.ndarray:
    """Weights (the last is the intercept) after ``epochs`` visits of the rows in a seeded order."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    rng = np.random.default_rng(seed)

    def weight(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            i = np.append(rows[k], size - 1)
            w = weight(i)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - labels[k]
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weight(np.arange(size)).astype(np.float32)


def _featured(batches):
    for rows, data, offsets in text.documents(batches, 1):
        values, at = features(data, offsets)
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.astype(np.int32)))], names=["label", "features"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = 3000, train_chars: int = 20_000, held_out=None) -> np.ndarray:
    """Weights learned from at most ``per_label`` rows of each label for which ``held_out`` (over labels) is false."""
    known = labels.where(F.col(label_col).isin(0, 1))
    if held_out is not None:
        known = known.where(~held_out)
    chosen = bounded_rows(known.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")), "id", "label", per_label)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    met = texts.join(F.broadcast(chosen), "id").withColumn("key", F.xxhash64("id", "text")).withColumn("text", stretch("text", "id", train_chars))
    shared.prepared(docs.sparkSession)
    got = ranked(met, "key", "label", per_label).select("label", "text").mapInArrow(_featured, "label int, features array<int>").toArrow()
    got = got.combine_chunks()
    if not got.num_rows:
        return np.zeros((1 << BITS) + 1, np.float32)
    lists = got.column(1).combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat, at = np.asarray(lists.values).astype(np.int64), np.asarray(lists.offsets)
    y = np.asarray(got.column(0), dtype=float)
    rows = [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    order = sorted(range(len(rows)), key=lambda k: (y[k], len(rows[k]), int(rows[k].sum())))  # the order of arrival doesn't matter
    return ftrl([rows[k] for k in order], y[order])


def _scorer(held):
    def score(batches):
        index, value, bias = held.value
        weight = np.zeros(1 << BITS, np.float64)
        weight[index] = value
        for rows, data, offsets in text.documents(batches, 2):
            values, at = features(data, offsets)
            sums = np.concatenate([[0.0], np.cumsum(weight[values])])
            p = 1 / (1 + np.exp(-np.clip(sums[at[1:]] - sums[at[:-1]] + bias, -35, 35)))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return score


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", held_out=None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row's whole text."""
    index = np.flatnonzero(weights[:-1]).astype(np.int32)
    held = shared.prepared(docs.sparkSession).sparkContext.broadcast((index, weights[index], float(weights[-1])))
    flag = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), flag.alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scorer(held), "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels whose fold is not 0 and score every document."""
    held_out = fold("doc_id", 5) == 0
    return score(docs, fit(docs, labels, held_out=held_out), held_out=held_out)
