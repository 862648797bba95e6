"""Registered queries against their SQL, and without extra columns or rows."""

import os
import re
import zlib

import numpy as np
import pytest

from axisframe.llm import queries
from tests.oracle import connect, same

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_agrees_with_sql(spark, name):
    same(connect(FOLDER), queries.SQL[name], queries.QUERIES[name](spark, FOLDER))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_covers_the_table(spark, name):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id")
    out = queries.QUERIES[name](spark, FOLDER)
    if name.startswith("op10"):
        assert out.join(docs, "doc_id", "left_anti").count() == 0
    else:
        assert docs.join(out, "doc_id", "left_anti").count() == 0


def _documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def test_op3_is_right_on_held_out_documents(spark):
    docs, out = _documents(spark), queries.QUERIES["op3_ppm"](spark, FOLDER).collect()
    assert len(out) == len(docs)
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    told = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in out if r["held_out"] and docs[r["doc_id"]]["lang"] and r["lang_pred"] != "und"]
    assert len(told) > 20 and sum(told) >= 0.95 * len(told)


def test_op4_lays_out_every_token(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    docs, out = _documents(spark), queries.QUERIES["op4_bounded_space"](spark, FOLDER).collect()
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, d in docs.items():
        ids = np.array([*tok.encode(d["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        padding += 0 if at & (at - 1) == 0 else 2048 - at
        assert at <= 2048
    assert padding <= 0.02 * 2048 * len(by_sequence)


def test_op7_is_right_on_held_out_labels(spark):
    out = {r["doc_id"]: r for r in queries.QUERIES["op7_ftrl"](spark, FOLDER).collect()}
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()]
    assert set(out) == set(_documents(spark))
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for i, r in out.items())
    told = [out[i]["predicted"] == t for i, t in labels if out[i]["held_out"]]
    assert sum(told) >= 0.9 * len(told)


def test_op10_holds_every_exact_passage(spark):
    words = {i: re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (d["text"] or "").encode())) for i, d in _documents(spark).items()}
    got = {}
    for r in queries.QUERIES["op10_chaining"](spark, FOLDER).collect():
        assert r["source_doc_id"] < r["doc_id"] and r["end"] - r["start"] >= 45 and r["n_equal"] > 0.8 * r["n_places"]
        assert 0 <= r["start"] < r["end"] <= len(words[r["doc_id"]]) and 0 <= r["source_start"] < r["source_end"] <= len(words[r["source_doc_id"]])
        got.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - 44):
            if first.setdefault(tuple(words[i][j : j + 45]), i) < i:
                assert set(range(j, j + 45)) <= got[i], (i, j)
