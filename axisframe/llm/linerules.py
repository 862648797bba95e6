"""Line-first cleaning: judge every line, drop those that fail, then reject documents that lose too much.

Words are ``[^\\x20\\x09-\\x0D]+``, lines are split at \\n. A line with a word fails if any of these holds:

* punctuation: none of its words ends in one of ``. ! ? " ' : ; )`` or ``” ’ … » 。`` (prose that is cut off within a
  sentence still holds earlier ends);
* symbols: twice its characters of ``[#*$%&|<>]`` are more than its words;
* navigation: at least two of its words are ``|`` or ``>``, and they are a fifth of its words or more;
* boilerplate: with A-Z lower-cased it holds a phrase of ``PHRASES``, or more than half of its ASCII letters, of ten or
  more, are capitals.

Lines without a word neither fail nor count. Base rules over the whole text: base_failed if n_words < 50 or
100 * n_repeat_words > 50 * n_words. A document is kept if it passes these and at most ``loss`` percent of its words are
in failing lines.

A null text has no words: all counts 0, base_failed true, kept false, cleaned text null. Rows that repeat are judged
alone, null ids are kept as null, other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, text

#: Phrases of boilerplate lines.
PHRASES = (
    "all rights reserved",
    "cookie policy",
    "enable javascript",
    "licensed under the",
    "privacy policy",
    "released under the",
    "subscribe to our",
    "terms of service",
    "terms of use",
    "use of this source code is governed",
)
ENDS = (".", "!", "?", '"', "'", ":", ";", ")", "”", "’", "…", "»", "。")
MIN_WORDS, REPEAT, LOSS = 50, 50, 30

_U = np.uint64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_PHRASE = re.compile(b"|".join(re.escape(x.encode()) for x in PHRASES))
_FINAL = np.zeros(256, bool)
_FINAL[[ord(x) for x in ENDS if ord(x) < 128]] = True
_FINAL_LONG = [x.encode() for x in ENDS if ord(x) >= 128]


def _repeated_words(word: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each word lies in a 3-word window that its document has twice or more."""
    out = np.zeros(len(word), bool)
    if len(word) < 3:
        return out
    window = text.mix(text.mix(word[:-2] * _U(0xA24BAED4963EE407) ^ word[1:-1]) * _U(0x9FB21C651E98DF25) ^ word[2:])
    start = np.flatnonzero(doc[:-2] == doc[2:])
    order = np.lexsort((window[start], doc[start]))
    at = start[order]
    same = (window[at][1:] == window[at][:-1]) & (doc[at][1:] == doc[at][:-1])
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = at[twice]
    for k in range(3):
        out[hit + k] = True
    return out


def _sums(index: np.ndarray, n: int, weights=None) -> np.ndarray:
    return np.bincount(index, weights=weights, minlength=n)[:n].astype(np.int64)


def judge(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each document, and of each line its span and whether it fails."""
    n_docs, n = len(offsets) - 1, len(data)
    starts, ends, doc = text.words(data, offsets)
    word = text.Rolling(data).of(starts, ends) if n else np.zeros(0, np.uint64)
    inside = ~text.SPACE[data]
    points = np.concatenate([[0], np.cumsum(inside & ((data & 0xC0) != 0x80))])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    # lines: each document's start, and the byte after each \n
    begin = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(data == 10) + 1]))
    begin = begin[begin < n]
    owner = np.searchsorted(offsets, begin, side="right") - 1
    finish = np.append(begin[1:], n)
    line = np.searchsorted(begin, starts, side="right") - 1
    n_lines = len(begin)
    count = _sums(line, n_lines)
    some = count > 0
    # the line's text without its \n decides whether it repeats an earlier one
    close = finish - ((finish > begin) & (data[np.maximum(finish - 1, 0)] == 10)) if n else finish
    same_as = text.Rolling(data).of(begin, close) if n else np.zeros(0, np.uint64)
    full = np.flatnonzero(some)
    order = full[np.lexsort((full, same_as[full], owner[full]))]
    again = np.zeros(n_lines, bool)
    again[order[1:]] = (same_as[order][1:] == same_as[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    failed = np.zeros(n_lines, bool)
    if len(full):
        final = _FINAL[data[ends - 1]]
        for mark in _FINAL_LONG:
            fits = ends - starts >= len(mark)
            for k, byte in enumerate(mark):
                fits &= data[np.maximum(ends - len(mark) + k, 0)] == byte
            final |= fits
        good = _sums(line, n_lines, final)[full] > 0
        marks = symbols[finish[full]] - symbols[begin[full]]
        bar = (ends - starts == 1) & ((data[starts] == ord("|")) | (data[starts] == ord(">")))
        bars = _sums(line, n_lines, bar)[full]
        upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
        alpha = np.concatenate([[0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122))])
        caps, letters = (x[finish[full]] - x[begin[full]] for x in (upper, alpha))
        failed[full] = ~good | (2 * marks > count[full]) | ((bars >= 2) & (5 * bars >= count[full])) | ((letters >= 10) & (2 * caps > letters))
        low = text.LOWER[data].tobytes()
        for m in _PHRASE.finditer(low):
            k = int(np.searchsorted(begin, m.start(), side="right")) - 1
            failed[k] |= bool(some[k] and m.end() <= finish[k])
    n_words = _sums(doc, n_docs)
    return {
        "n_words": n_words,
        "word_chars": points[offsets[1:]] - points[offsets[:-1]],
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": _sums(owner[again], n_docs),
        "n_repeat_words": _sums(doc, n_docs, _repeated_words(word, doc)),
        "n_failed_words": _sums(owner, n_docs, np.where(failed, count, 0)),
        "n_failed_lines": _sums(owner[failed], n_docs),
        "lines": (begin, finish, owner, failed),
    }


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_failed_lines long, n_failed_words long"


def _judged(loss: int, cleaned: bool):
    def run(batches):
        for rows, data, offsets in text.documents(batches, 1):
            got = judge(data, offsets)
            base = (got["n_words"] < MIN_WORDS) | (100 * got["n_repeat_words"] > REPEAT * got["n_words"])
            kept = ~base & (100 * got["n_failed_words"] <= loss * got["n_words"])
            columns = [rows.column(0), *(pa.array(got[k]) for k in _COUNTS), pa.array(base), pa.array(kept), pa.array(got["n_failed_lines"]), pa.array(got["n_failed_words"])]
            names = ["doc_id", *_COUNTS, "base_failed", "kept", "n_failed_lines", "n_failed_words"]
            if cleaned:
                begin, finish, owner, failed = got["lines"]
                raw, parts = data.tobytes(), [[] for _ in range(rows.num_rows)]
                for a, b, d in zip(begin[~failed], finish[~failed], owner[~failed], strict=True):
                    parts[d].append(raw[a:b])
                valid = rows.column(1).is_valid().to_pylist()
                columns.append(pa.array(["".join(x.decode() for x in p) if ok else None for p, ok in zip(parts, valid, strict=True)], pa.string()))
                names.append("clean_text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def line_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", loss: int = LOSS, cleaned: bool = False) -> DataFrame:
    """Counts and verdict of each document; with ``cleaned`` also its text without the failing lines (clean_text)."""
    shared.prepared(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_judged(loss, cleaned), _SCHEMA + (", clean_text string" if cleaned else ""))
