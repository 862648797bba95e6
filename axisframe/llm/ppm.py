"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts of up to three bytes with symbol counts. A context predicts a seen symbol with
n / (N + D) and escapes with D / (N + D), N being its total and D its number of distinct symbols; after an escape the
next shorter context predicts among the symbols that are not excluded (those seen in the longer one). The counts are
frozen after training, so the exact code length of every symbol in every context is a table; a text costs the sum of its
bytes' entries, and the language with the shortest code wins.

The alphabet is all 256 byte values. The ``own_symbols`` most frequent have symbols of their own; the others are coded as
one symbol that escapes to a table of their own, in which every byte value, seen or not, has a code. So code lengths are
exact over any bytes.

Bounds, all parameters of ``fit``: training takes at most ``docs_per_lang`` documents of each language, of each a stretch
of at most ``train_chars`` characters, and at most ``labels`` languages (more are an error); the context tree is cut to
contexts of two and three bytes that were seen ``least_seen`` times, to the ``max_contexts`` most frequent, and to fewer
if the table of code lengths would pass ``table_bytes``, which bounds what is broadcast. What is cut falls back to the
shorter context.

A text that is null or has no letter is ``und`` with score 0. ``score`` is the winner's share of the likelihoods, at the
text's mean code length over at most 64 bytes. Null ids are kept (held_out is then false). With no labelled row every
text is ``und``. Ties go to the language that sorts first. Other columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, text
from .sampling import bounded_rows, fold, ranked, stretch

ORDER = 3
_SPACE_BYTE = 10


class Model:
    """Code lengths: ``node_of`` maps the last three symbols to a context, ``cost`` a context and a symbol to bits by language.

    Symbol 0 is the escape; ``rest`` has the further bits, by language, of each byte value that it stands for.
    """

    def __init__(self, langs, symbol, node_of, cost, rest):
        self.langs, self.symbol, self.node_of, self.cost, self.rest = langs, symbol, node_of, cost, rest

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each document under each language."""
        n_docs, n = len(offsets) - 1, len(data)
        out = np.zeros((n_docs, len(self.langs)))
        if not n:
            return out
        size = self.cost.shape[1]
        sym = self.symbol[data].astype(np.int32)
        edge = offsets[:-1][offsets[:-1] < n]
        code = np.zeros(n, np.int32)
        for back in range(ORDER, 0, -1):
            prev = np.empty(n, np.int32)
            prev[back:] = sym[:-back] if back < n else 0
            prev[:back] = self.symbol[_SPACE_BYTE]
            for k in range(back):
                prev[np.minimum(edge + k, n - 1)[edge + k < n]] = self.symbol[_SPACE_BYTE]
            code = code * size + prev
        at = self.node_of[code] * size + sym
        flat = self.cost.reshape(-1, len(self.langs))
        full = np.flatnonzero(np.diff(offsets) > 0)
        for k in range(len(self.langs)):
            out[full, k] = np.add.reduceat(flat[:, k][at], offsets[full], dtype=np.float64)
        rare = np.flatnonzero(sym == 0)
        if len(rare):
            np.add.at(out, np.searchsorted(offsets, rare, side="right") - 1, self.rest[data[rare]])
        return out


class Fitted(Model):
    """A model packed by the task that trained it: the driver sends it on, and holds its tables only if they are asked for."""

    def __init__(self, packed: bytes):
        self.packed = packed

    def __reduce__(self):
        return Fitted, (self.packed,)

    @cached_property
    def model(self) -> Model:
        return pickle.loads(zlib.decompress(self.packed))

    def __getattr__(self, name: str):
        if name in ("langs", "symbol", "node_of", "cost", "rest"):
            return getattr(self.model, name)
        raise AttributeError(name)


def packed(model: Model) -> Fitted:
    return Fitted(zlib.compress(pickle.dumps(model, pickle.HIGHEST_PROTOCOL), 1))


def train(samples: dict[str, list[bytes]], max_contexts: int = 16000, own_symbols: int = 127, least_seen: int = 2, table_bytes: int = 24_000_000) -> Model:
    langs = sorted(samples)
    if not langs:
        return Model([], np.zeros(256, np.uint8), np.zeros(1, np.int32), np.zeros((1, 1, 0), np.float32), np.zeros((256, 0)))
    each = np.array([sum((np.bincount(np.frombuffer(x, np.uint8), minlength=256) for x in samples[lang]), np.zeros(256, np.int64)) for lang in langs])
    sums = each.sum(0)
    sums[_SPACE_BYTE] += 1
    own = np.sort(np.argsort(-sums, kind="stable")[: min(own_symbols, 255, int((sums > 0).sum()))])
    symbol = np.zeros(256, np.uint8)
    symbol[own] = np.arange(1, len(own) + 1)
    others = symbol == 0
    rest = np.zeros((256, len(langs)))
    rest[others] = -np.log2((each[:, others] + 1) / (each[:, others] + 1).sum(1, keepdims=True)).T
    size = len(own) + 1
    room = max(size, min(max_contexts, table_bytes // (4 * size * len(langs))))
    pad = np.full(ORDER, symbol[_SPACE_BYTE], np.int64)
    counts: list[tuple[np.ndarray, np.ndarray]] = [[] for _ in range(ORDER + 1)]
    for k, lang in enumerate(langs):
        for order in range(ORDER + 1):
            keys = []
            for x in samples[lang]:
                s = np.concatenate([pad, symbol[np.frombuffer(x, np.uint8)]]).astype(np.int64)
                code = np.zeros(len(s) - ORDER, np.int64)
                for back in range(order, -1, -1):
                    code = code * size + s[ORDER - back : len(s) - back]
                keys.append(code)
            found, n = np.unique(np.concatenate(keys or [np.zeros(0, np.int64)]), return_counts=True)
            counts[order].append((found, n))
    prob = np.full((1, len(langs), size), 1.0 / size)
    table = np.zeros(size**ORDER, np.int32)
    lower = np.zeros(1, np.int64)  # the node of each context of the order below, by its code
    nodes, parts = 0, []
    for order in range(ORDER + 1):
        total = np.concatenate([f // size for f, _ in counts[order]])
        weight = np.concatenate([n for _, n in counts[order]])
        ctx, where = np.unique(total, return_inverse=True)
        often = np.bincount(where, weights=weight, minlength=len(ctx))
        left = room - nodes
        keep = np.sort(np.argsort(-often, kind="stable")[: max(0, left)]) if len(ctx) > left else np.arange(len(ctx))
        keep = keep[(often[keep] >= least_seen) | (order < 2)]
        ctx = ctx[keep]
        cnt = np.zeros((len(ctx), len(langs), size), np.float32)
        for k, (f, n) in enumerate(counts[order]):
            row = np.searchsorted(ctx, f // size)
            ok = (row < len(ctx)) & (ctx[np.minimum(row, len(ctx) - 1)] == f // size) if len(ctx) else np.zeros(len(f), bool)
            cnt[row[ok], k, f[ok] % size] = n[ok]
        parent = lower[ctx % (size ** max(0, order - 1))] if order else np.zeros(len(ctx), np.int64)
        above = prob[parent] if order else np.broadcast_to(prob, (len(ctx), *prob.shape[1:]))
        new = _escape(cnt, above)
        prob = np.concatenate([prob, new]) if order else new
        here = np.tile(lower, size) if order else np.zeros(1, np.int64)  # contexts that are not kept use the shorter one
        if len(ctx):
            here[ctx] = nodes + np.arange(len(ctx)) if order else 0
        lower = here
        nodes += len(ctx)
        parts.append(new)
    table = lower.astype(np.int32)
    cost = -np.log2(np.maximum(prob, 1e-12)).astype(np.float32)
    return Model(langs, symbol, table, np.ascontiguousarray(cost.transpose(0, 2, 1)), rest)


def _escape(cnt: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Probabilities of each context and language from its counts and those of the shorter context."""
    seen = cnt > 0
    total, kinds = cnt.sum(-1, keepdims=True), seen.sum(-1, keepdims=True)
    rest = np.where(seen, 0, above)
    left = rest.sum(-1, keepdims=True)
    whole = total + np.where(left > 0, kinds, 0)
    out = np.divide(cnt, whole, out=np.zeros_like(rest), where=whole > 0)
    out += np.divide(rest * kinds, left * whole, out=np.zeros_like(rest), where=(left > 0) & (whole > 0))
    return np.where(total > 0, out, above)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 256, train_chars: int = 20_000, labels: int = 64, held_out=None, **bounds) -> Fitted:
    """Train, in a task, on a bounded sample of the labelled rows for which ``held_out`` is false; ``bounds`` are those of ``train``."""
    shared.prepared(docs.sparkSession)
    fit_on = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if held_out is not None:
        fit_on = fit_on.where(~held_out)
    rows = fit_on.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    chosen = bounded_rows(rows, "id", "lang", docs_per_lang, labels)  # at most docs_per_lang * labels rows
    texts = fit_on.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).join(F.broadcast(chosen), ["id", "lang"], "left_semi")
    cut = texts.withColumn("key", F.xxhash64("id", "text")).withColumn("text", stretch("text", "id", train_chars))
    found = ranked(cut, "key", "lang", docs_per_lang).select("lang", "text").repartition(1).mapInArrow(_trainer(bounds), "model binary").collect()
    return Fitted(bytes(found[0][0])) if found else packed(train({}, **bounds))


def _trainer(bounds: dict):
    """One row, the model of all rows of a task."""

    def fitted(batches):
        samples: dict[str, list[bytes]] = {}
        for rows in batches:
            for lang, x in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                samples.setdefault(lang, []).append(x.encode())
        model = packed(train({k: sorted(v) for k, v in samples.items()}, **bounds))
        yield pa.RecordBatch.from_arrays([pa.array([model.packed], pa.binary())], names=["model"])

    return fitted


def _scorer(held, at: int):
    """Adds lang_pred and score to each row; column ``at`` is the text, the next whether it has a letter."""

    def score(batches):
        model = held.value.model
        for rows, data, offsets in text.documents(batches, at):
            n = rows.num_rows
            letters = np.asarray(rows.column(at + 1).fill_null(False))
            if not model.langs:
                best, share, letters = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool)
                names = np.array(["und"], object)
            else:
                bits = model.bits(data, offsets)
                best = bits.argmin(1)
                length = np.maximum(1, np.diff(offsets))[:, None]
                gap = (bits - bits.min(1, keepdims=True)) * np.minimum(length, 64) / length
                share = 1 / np.exp2(-gap).sum(1)
                names = np.array(model.langs, object)
            told = [pa.array(np.where(letters, names[best], "und"), pa.string()), pa.array(np.where(letters, share, 0.0))]
            yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in range(at)), *told], names=[*rows.schema.names[:at], "lang_pred", "score"])

    return score


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_out=None, keep: bool = False) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row's whole text; with ``keep`` every column of ``docs``, then those two."""
    held = shared.prepared(docs.sparkSession).sparkContext.broadcast(model if isinstance(model, Fitted) else packed(model))
    texts = [F.col(text_col).alias("__text"), F.col(text_col).rlike("\\p{L}").alias("__letters")]
    if keep:
        kept = docs.drop("lang_pred", "score")
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema]
        return kept.select("*", *texts).mapInArrow(_scorer(held, len(fields)), ", ".join([*fields, "lang_pred string", "score double"]))
    flag = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), flag.alias("held_out"), *texts)
    return rows.mapInArrow(_scorer(held, 2), "doc_id long, held_out boolean, lang_pred string, score double")


def languages(docs: DataFrame, **names) -> DataFrame:
    """Train on the documents whose fold is not 2 and identify every document."""
    held_out = fold(names.get("id_col", "doc_id"), 4) == 2
    model = fit(docs, held_out=held_out, **names)
    names.pop("lang_col", None)
    return identify(docs, model, held_out=held_out, **{k: v for k, v in names.items() if k in ("id_col", "text_col")})
