"""Every operator against a brute-force version or a round trip, on texts made to be awkward."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from axisframe.llm import chaining, exchange, linerules, mixing, packing, ppm, sampling, shared, suffix, superminhash, text, topk, toxicity, warc
from axisframe.llm.components import components, hung, lowest

RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefghiklmnorstu") for _ in range(RNG.randint(2, 8))) for _ in range(600)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(words, share, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + "x" if r.random() < share else w for w in words.split(" "))


AWKWARD = [None, "", " \n\t ", "a", "A", "a b", "é", "über alles 日本", "x" * 400, "ab " * 300, "\x00 b", "<|endoftext|> it's a test", "no-break space here"]


@pytest.fixture(scope="module")
def corpus():
    """Awkward texts, exact and near copies, shared passages, a very long text, repeated rows and null ids."""
    base = [prose(120, k) for k in range(25)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(100 + k, edited(base[0], 0.01 * (k % 9), k)) for k in range(40)]
    rows += [(200 + k, base[1]) for k in range(12)]
    passage = prose(70, 999)
    rows += [(300 + k, f"{prose(40, 5000 + k)} {passage} {prose(30, 6000 + k)}") for k in range(10)]
    rows += [(400 + k, t) for k, t in enumerate(AWKWARD)]
    rows += [(500, " ".join(base[:20]) * 6), (501, base[2] + "\n" + base[2]), (7, base[7]), (None, base[3]), (None, None), (502, base[0].upper())]
    return rows


def shingle_set(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    return set(zip(w, w[1:])) if len(w) > 1 else set(w)


# -- kernels -------------------------------------------------------------------------------------------------------------


def test_words_and_hashes():
    import pyarrow as pa

    texts = [t for t in AWKWARD] + [prose(30, 1)]
    data, offsets = text.buffers(pa.array(texts, pa.string()))
    starts, ends, doc = text.words(data, offsets)
    raw = data.tobytes()
    got = [[] for _ in texts]
    for a, b, d in zip(starts, ends, doc):
        got[d].append(raw[a:b])
    assert got == [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    h = text.Rolling(data).of(starts, ends)
    by = collections.defaultdict(set)
    for a, b, x in zip(starts, ends, h):
        by[raw[a:b]].add(int(x))
    assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == len(by)
    assert list(text.slices(np.array([0, 5, 5, 20, 21]), 6)) == [(0, 2), (2, 3), (3, 4)]


def test_superminhash_signature_is_unbiased():
    r = np.random.default_rng(3)
    for share in (0.5, 0.8):
        close = []
        for _ in range(60):
            both = r.integers(1, 1 << 62, 400, dtype=np.uint64)
            n = int(400 * share)
            only = (400 - n) // 2
            a, b = both[: n + only], np.concatenate([both[:n], both[n + only :]])
            j = n / len(set(a) | set(b))
            close.append((superminhash.signature(a) == superminhash.signature(b)).mean() - j)
        assert abs(np.mean(close)) < 0.03
    one = superminhash.signature(np.array([5], np.uint64))
    assert sorted((one >> np.uint64(32)).tolist()) == list(range(superminhash.SIZE))  # each rank once


def test_fenwick_and_chains():
    tree = chaining.Fenwick(8)
    best = {}
    r = random.Random(1)
    for _ in range(50):
        at, v = r.randrange(8), r.random()
        tree.put(at, (v, at))
        best[at] = max(best.get(at, -1), v)
        k = r.randrange(8)
        assert tree.top(k)[0] == max([b for p, b in best.items() if p <= k], default=float("-inf"))
    a, b, size = np.array([0, 12, 30, 14]), np.array([100, 112, 131, 40]), np.array([8, 8, 10, 3])
    assert chaining.chains(a, b, size)[0] == [0, 1, 2]


def test_family_levels_are_geometric():
    f = suffix.Family()
    r = np.random.default_rng(0)
    seen = {}
    for doc in range(40):
        key = np.unique(r.integers(0, 3000, 200))
        texts = [b"".join(bytes([k % 256, 0, k // 256, 255]) for _ in range(14))[: 50 + k % 7] for k in key.tolist()]
        at = np.cumsum([0] + [len(t) for t in texts])[:-1]
        data = np.frombuffer(b"".join(texts), np.uint8)
        got = f.add(data, at, np.full(len(key), doc))
        assert got.tolist() == [t[:50] in seen for t in texts]
        for t in texts:
            seen.setdefault(t[:50], doc)
        sizes = [len(x) for x in f.levels]
        assert all(x > y for x, y in zip(sizes, sizes[1:]))
        for level in f.levels:  # each is in the order of its bytes, and each prefix once
            raw = level.data.tobytes()
            inside = [raw[a : a + 50] for a in level.at.tolist()]
            assert all(x < y for x, y in zip(inside, inside[1:])) and all(seen[x] <= d for x, d in zip(inside, level.doc.tolist()))
            again = suffix.Level.unpacked(level.packed())
            assert (again.at == level.at).all() and (again.doc == level.doc).all() and (again.head == level.head).all()
    assert {x.data.tobytes()[a : a + 50] for x in f.levels for a in x.at.tolist()} == set(seen)


def test_suffix_array_order():
    """Window starts of repetitive bytes, with zeros and bytes over 127, in the order of Python's own comparison."""
    r = np.random.default_rng(4)
    data = r.choice(np.array([0, 1, 200], np.uint8), 3000, p=[0.9, 0.05, 0.05])
    at = r.permutation(len(data) - 49)[:2000]
    doc = r.integers(0, 50, len(at))
    level, entry = suffix.suffix_array(data, at, doc)
    raw = data.tobytes()
    want = sorted({raw[a : a + 50] for a in at.tolist()})
    assert [raw[a : a + 50] for a in level.at.tolist()] == want
    assert [want[e] for e in entry.tolist()] == [raw[a : a + 50] for a in at.tolist()]
    other, _ = suffix.suffix_array(data, np.setdiff1d(np.arange(len(data) - 49), at), np.zeros(len(data) - 49 - len(at), int))
    lo, hit = level.places(other)
    keys = [raw[a : a + 50] for a in other.at.tolist()]
    import bisect

    assert lo.tolist() == [bisect.bisect_left(want, k) for k in keys] and hit.tolist() == [k in set(want) for k in keys]


# -- operators -----------------------------------------------------------------------------------------------------------


def test_near_duplicates(make, corpus):
    got = superminhash.near_duplicates(make(corpus)).collect()
    assert len(got) == len(corpus)
    sets = {i: shingle_set(t) for i, t in corpus if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]), find(r["doc_id"]) == r["doc_id"])


def test_near_duplicates_of_repeated_ids(spark, make):
    """An id with several texts is linked by any of them; empty tables and links to itself give no graph."""
    a, b, c, d = (prose(80, 700 + k) for k in range(4))
    rows = [(5, a), (5, b), (8, b + " word"), (3, c), (6, c), (6, d), (4, d + " word"), (6, ""), (9, None), (9, ""), (2, a + " x"), (None, a), (None, a)]
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in superminhash.near_duplicates(make(rows)).collect() if r["doc_id"] is not None)
    assert got == [(2, 2, True), (3, 3, True), (4, 3, False), (5, 2, False), (5, 2, False), (6, 3, False), (6, 3, False), (6, 3, False), (8, 2, False), (9, 9, True), (9, 9, True)]
    assert superminhash.near_duplicates(make(rows).where("false")).count() == 0
    assert superminhash.near_duplicates(make([(1, None), (2, "")])).count() == 2
    for links in ([], [(1, 1)], [(1, 2), (2, 1), (2, 2), (7, 3), (3, 7), (3, 2)]):
        found, _ = components(spark.createDataFrame(links, "u long, v long"))
        assert {(r["node"], r["component"]) for r in found.collect()} == ({(1, 1), (2, 1), (3, 1), (7, 1)} if len(links) > 1 else set())


def test_components_of_graphs_of_many_shapes_end_as_they_are_stars(spark, monkeypatch):
    """Chains, trees, rings, stars and random links against a union by hand; stars take no round, and no round only looks."""
    r = random.Random(77)
    chain = [(k, k + 1) for k in range(40)]
    ring = [(100 + k, 100 + (k + 1) % 9) for k in range(9)]
    tree = [(200 + k, 200 + (k - 1) // 2) for k in range(1, 31)]
    star = [(300, 301 + k) for k in range(30)]
    loose = [(400 + r.randrange(60), 400 + r.randrange(60)) for _ in range(45)]
    tags = []
    written = shared.written
    monkeypatch.setattr(shared, "written", lambda df, tag, *a: (tags.append(tag), written(df, tag, *a))[1])
    for links in (star, chain + ring + tree + star + loose):
        top = {x: x for pair in links for x in pair if pair[0] != pair[1]}
        for _ in top:
            for u, v in links:
                if u != v:
                    top[u] = top[v] = min(top[u], top[v])
        tags.clear()
        found, _ = components(spark.createDataFrame(links, "u long, v long"))
        assert sorted((x["node"], x["component"]) for x in found.collect()) == sorted(top.items())
        assert len(tags) % 4 == 2 and (links is not star or tags == ["links", "low"])


@pytest.mark.parametrize("part", [250_000, 20])
def test_components_by_one_task_and_by_rounds(spark, monkeypatch, part):
    """Graphs of at most PART links take two tables, larger ones rounds; repeats and directions don't matter, hung links keep what they reach."""
    r = random.Random(78)
    links = [(k, k + 1) for k in range(60)] + [(100, 101 + k) for k in range(20)] * 2 + [(200 + r.randrange(90), 200 + r.randrange(90)) for _ in range(60)]
    stars = [(400, 401 + k) for k in range(30)]
    top = {x: x for pair in links + stars for x in pair if pair[0] != pair[1]}
    for _ in top:
        for u, v in links + stars:
            if u != v:
                top[u] = top[v] = min(top[u], top[v])
    tags = []
    written = shared.written
    monkeypatch.setattr(shared, "written", lambda df, tag, *a: (tags.append(tag), written(df, tag, *a))[1])
    monkeypatch.setattr("axisframe.llm.components.PART", part)
    for some in (links + stars, stars * 2):
        edges = spark.createDataFrame(r.sample(some, len(some)), "u long, v long").repartition(3)
        for frame in (edges, edges.mapInArrow(hung, "u long, v long")):
            tags.clear()
            found, _ = components(frame)
            assert sorted((x["node"], x["component"]) for x in found.collect()) == sorted((k, top[k]) for k in {x for p in some for x in p} & set(top))
            assert (tags == ["links", "low"]) == (part > 20) and (part > 20 or some != stars * 2 or len(tags) == 3)
    nodes = pa.record_batch({"u": [1, 2, 3], "v": [2, 3, 4]}), pa.record_batch({"u": [9], "v": [1]})
    assert [b.to_pydict() for b in hung(nodes, 2)] == [{"u": [2, 3], "v": [1, 1]}, {"u": [4, 9], "v": [3, 1]}]
    assert lowest(np.array([7, 3, 9]), np.array([3, 8, 9]))[1].tolist() == [3, 3, 3, 9]


def test_near_duplicates_take_few_tables_of_few_files(spark, make, monkeypatch):
    """Many shuffle partitions make no small tables of many files, and links no rounds: each file and each round costs more than its rows."""
    words = prose(400, 79).split(" ")
    rows = [(k, " ".join(f"v{k}w{i}" if 0 <= i - 12 * (k - 1) < 12 else w for i, w in enumerate(words))) for k in range(12)]
    tables = []
    written = shared.written

    def noted(df, tag, *a):
        out, path = written(df, tag, *a)
        tables.append((tag, len(out.inputFiles())))
        return out, path

    monkeypatch.setattr(shared, "written", noted)
    many = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    held = {k: spark.conf.get(k) for k in many}
    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        got = {r["doc_id"]: r["component_id"] for r in superminhash.near_duplicates(make(rows)).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert set(got.values()) == {0}
    assert len(tables) <= 17 and all(n <= 8 for tag, n in tables if tag not in ("links", "hollow")), tables


def test_a_write_leaves_no_freed_memory_in_the_driver(spark):
    """What plans took and freed outside the heap goes back to the system as a table is written."""
    if shared.given_back(spark) is None:
        pytest.skip("this JVM can't")
    for k in range(30):  # plans that were not compiled before
        frame = spark.range(100).selectExpr("id", *(f"id * {k} + {i} as c{i}" for i in range(20))).groupBy("c0").agg(*(F.sum(f"c{i}") for i in range(1, 20)))
        frame.collect()
    shared.written(frame.toDF(*(f"c{i}" for i in range(20))), "compiled")
    said = shared.given_back(spark)
    left = re.search(r"\(([+-]\d+)([BKMG])\)", said)
    assert left and int(left[1]) * 1024 ** "BKMG".index(left[2]) > -(16 << 20), said


def test_near_duplicates_of_repeated_ids_in_the_pipeline(spark, make):
    pipeline = pytest.importorskip("corpus_pipeline")
    a, b = prose(80, 710), prose(80, 711)
    rows = [(1, a), (1, b), (1, a), (2, a), (3, b + " x"), (4, prose(60, 712)), (None, a), (None, a), (5, None), (5, None), (6, "")]
    docs = make(rows).select("doc_id", "text", "lang", "source", "n_chars")
    out = pipeline.one_of_each_group(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(1, a), (1, b), (4, rows[5][1]), (5, None), (6, ""), (None, a), (None, a)], key=str)
    assert pipeline.one_of_each_group(spark, docs.where("false"), "").count() == 0


def test_near_duplicates_by_five_words(spark, make, corpus):
    """A pair that 2-word shingles link and 5-word shingles don't stays in the pipeline; sets of five words against brute force."""
    pipeline = pytest.importorskip("corpus_pipeline")
    words = [f"w{k}" for k in range(100)]
    between = " ".join(f"{w}x" if k % 20 == 10 else w for k, w in enumerate(words))
    rows = [(3000, " ".join(words)), (3001, between), (3002, " ".join([*words[:98], "y", "z"])), (3003, "a b c"), (3004, "a B c"), (3005, "a b c d"), (3006, "b c d e f"), (3007, "a")]
    docs = make(rows)
    two = {r["doc_id"]: r["component_id"] for r in superminhash.near_duplicates(docs).collect()}
    assert two[3001] == two[3002] == 3000
    ids = {r["doc_id"] for r in pipeline.one_of_each_group(spark, docs, "").collect()}
    assert ids == {3000, 3001, 3003, 3005, 3006, 3007}
    rows += [r for r in corpus if r[0] is not None and r[0] != 7]

    def five(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()

    sets = {i: five(t) for i, t in rows}
    low = {i: i for i in sets}
    for _ in sets:
        before = dict(low)
        for i in sets:
            low[i] = min(low[j] for j in sets if i == j or (sets[i] & sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])))
        if low == before:
            break
    got = superminhash.near_duplicates(make(rows), length=5).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(i, len(sets[i]), low[i]) for i in sets}


def test_chain_of_links_across_blocks(make):
    """Neighbours are linked, far ones aren't: the component must still be one."""
    words = prose(400, 77).split(" ")
    rows = [(k, " ".join(f"v{k}w{i}" if 0 <= i - 12 * (k - 1) < 12 else w for i, w in enumerate(words))) for k in range(12)]
    rows += [(50 + k, " ".join(f"{w}{'q' if i % 5 == k else ''}" for i, w in enumerate(words))) for k in range(5)]
    got = {r["doc_id"]: r["component_id"] for r in superminhash.near_duplicates(make(rows)).collect()}
    assert {got[k] for k in range(12)} == {0} and all(got[50 + k] == 50 + k for k in range(5))


def test_warc_round_trip(spark):
    body = prose(300, 3)
    rows = [(k, f"http://h/{k}", body) for k in range(5)] + [(10, None, None), (11, "http://h/a b\r\nc", ""), (12, "u", "small"), (13, "u", "small"), (None, "u", body), (4, "v", body), (20, "u", "é" * 900)]
    rows += [(100 + k, f"http://h/{k}", prose(200, k)) for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    archives, _ = warc.write(pages, archive_bytes=4000)
    held = archives.collect()
    assert len(held) > 2 and all(a["bytes"][:4] == b"\x5d\x2a\x4d\x18" for a in held)
    got = warc.read(archives, with_payload=True).collect()
    assert len(got) == len(rows)
    for i, _, t in rows:
        raw = (t or "").encode()
        mine = [r for r in got if r["page_id"] == i and r["payload_digest"] == hashlib.sha1(raw).hexdigest()]
        again = t == body and i != 4
        assert mine and all(r["payload_bytes"] == len(raw) and r["record_type"] == ("revisit" if again else "response") and r["refers_to"] == (4 if again else None) for r in mine)
        assert all(r["payload"] == (None if again else raw) for r in mine)
    empty, _ = warc.write(pages.where("false"))
    assert warc.read(empty).count() == 0


def test_warc_dictionaries_and_long_pages(spark):
    """Pages over the reader's steps of 64 KB, dictionaries from few or equal samples, and a join whose plan isn't broadcast."""
    r = random.Random(9)
    long = "".join(r.choice("abcdefghijklmnop ") for _ in range(300_000))
    rows = [(1, "u", long), (2, "u", long), (3, "u", long + "."), (4, "u", None)]
    schema = "page_id long, url string, html string, refers_to string, n int, digest string"
    pages = spark.createDataFrame([(*x, "x", 1, "y") for x in rows], schema)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for limit in (threshold, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            archives, _ = warc.write(pages)
            got = {x["page_id"]: x for x in warc.read(archives, with_payload=True).collect()}
            assert len(got) == 4 and all(a["bytes"][:4] == b"\x5d\x2a\x4d\x18" for a in archives.collect())
            assert (got[1]["record_type"], got[1]["refers_to"], got[1]["payload_bytes"], got[1]["payload"]) == ("revisit", 2, 300_000, None)
            assert got[2]["payload"] == long.encode() and got[3]["payload"] == long.encode() + b"." and got[4]["payload"] == b""
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert warc.trained([]) is None
    for samples in ([b"a"], [b"same record"] * 3, [b"x" * 40] * 50, [prose(50, k).encode() for k in range(200)]):
        writer = warc.Writer(warc.trained(samples))
        for x in samples:
            writer.add(x)
        assert writer.lead and list(warc.records(writer.bytes())) == samples
    plain = warc.Writer(None)
    plain.add(long.encode())
    assert list(warc.records(plain.bytes())) == [long.encode()]
    only_null = spark.createDataFrame([(None, "u", "z" * 2000)] * 3, "page_id long, url string, html string")
    assert {(x["record_type"], x["refers_to"]) for x in warc.read(warc.write(only_null)[0]).collect()} == {("response", None)}


def test_warc_files(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", prose(100, k)) for k in range(30)], "page_id long, url string, html string")
    archives, _ = warc.write(pages)
    written = warc.export(archives, str(tmp_path)).collect()
    raw = [r for w in written for r in warc.records((tmp_path / w["name"]).read_bytes())]
    assert len(raw) == 30 and sorted(int(warc.parse(r)[0]["X-Page-Id"]) for r in raw) == list(range(30))


def test_languages(spark, make):
    kinds = {"aa": "the and of with this that from", "bb": "der die und nicht ein mit sich", "cc": "que los para con una del por"}
    r = random.Random(2)
    rows = [(k, " ".join(r.choice(kinds[(lang := sorted(kinds)[k % 3])].split()) for _ in range(30)), lang) for k in range(300)]
    rows += [(1000 + k, t, None) for k, t in enumerate(AWKWARD)] + [(None, "the and of", "aa"), (1, rows[1][1], "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = {(g["doc_id"], g["lang_pred"], g["held_out"]): g["score"] for g in ppm.languages(docs).collect()}
    for i, t, lang in rows:
        mine = [(k, s) for k, s in got.items() if k[0] == i]
        assert mine and all(0 <= s <= 1 for _, s in mine)
        if i is not None:
            assert mine[0][0][2] == (zlib.crc32(str(i).encode()) % 4 == 2)
        if lang:
            assert mine[0][0][1] == lang
        if not re.search(r"[^\W\d_]", t or ""):
            assert mine[0][0][1] == "und" and mine[0][1] == 0
    nothing = ppm.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {g["lang_pred"] for g in nothing} == {"und"}
    assert ppm.languages(docs.where("false")).count() == 0


def test_languages_train_in_a_task(spark):
    """The driver neither trains nor unpacks the model: its tables would be a third of its memory in the pipeline."""
    docs = spark.createDataFrame([(k, f"{'the and of' if k % 2 else 'der die und'} {k}", "ab"[k % 2]) for k in range(40)], "doc_id long, text string, lang string")
    own, driver = ppm.train, os.getpid()

    def elsewhere(*args, **bounds):
        assert os.getpid() != driver
        return own(*args, **bounds)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(ppm, "train", elsewhere)
        model = ppm.fit(docs)
        assert {x["lang_pred"] for x in ppm.identify(docs, model).collect()} == {"a", "b"}
    assert list(vars(model)) == ["packed"] and len(model.packed) < 1_000_000
    want = ppm.train({c: sorted(f"{'the and of' if k % 2 else 'der die und'} {k}".encode() for k in range(40) if "ab"[k % 2] == c) for c in "ab"})
    assert model.langs == want.langs and (model.cost == want.cost).all() and (model.node_of == want.node_of).all() and (model.rest == want.rest).all()


def test_ppm_code_lengths_are_probabilities():
    model = ppm.train({"a": [b"abracadabra " * 20], "b": [b"banana bandana " * 20]}, max_contexts=60)
    assert np.allclose(np.exp2(-model.cost.astype(float)).sum(1), 1, atol=1e-3)
    data = np.frombuffer(b"abra" + b"banana", np.uint8)
    both = model.bits(data, np.array([0, 4, 4, 10]))
    assert both[0].argmin() == 0 and both[2].argmin() == 1 and not both[1].any()
    assert np.allclose(both[2], model.bits(data[4:], np.array([0, 6]))[0])


def test_ppm_against_a_plain_coder():
    """Every code length of an uncut model equals a plain coder's, one symbol and one dictionary at a time."""
    r = random.Random(21)
    own = {"a": [b"abracadabra banana " * 3, bytes(r.randrange(90, 120) for _ in range(200))], "b": [b"the cat sat on the mat. " * 4, b"\xc3\xa9t\xc3\xa9 \x00\xff" * 5], "c": [b""]}
    model = ppm.train(own, max_contexts=10**6, own_symbols=255, least_seen=1, table_bytes=1 << 40)
    texts = [b"abra the mat \xc3\xa9", b"q", bytes(r.randrange(256) for _ in range(60)), b"banana sat zzz\x00\xff"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    got = model.bits(data, offsets)
    for k, lang in enumerate(model.langs):
        counts = collections.defaultdict(collections.Counter)
        for x in own[lang]:
            x = bytes([10]) * 3 + x
            for at in range(3, len(x)):
                for o in range(4):
                    counts[x[at - o : at]][int(model.symbol[x[at]])] += 1
        counts = {bytes(int(model.symbol[b]) for b in c): n for c, n in counts.items()}
        size = model.cost.shape[1]
        for t, found in zip(texts, got[:, k]):
            s = bytes(int(model.symbol[b]) for b in bytes([10]) * 3 + t)
            want = 0.0
            for at in range(3, len(s)):
                out = np.full(size, 1 / size)
                for o in range(4):
                    seen = counts.get(s[at - o : at])
                    if not seen:
                        continue
                    total, kinds = sum(seen.values()), len(seen)
                    left = sum(out[b] for b in range(size) if b not in seen)
                    out = np.array([seen[b] / (total + (kinds if left else 0)) if b in seen else kinds / (total + kinds) * out[b] / left for b in range(size)])
                want -= np.log2(out[s[at]])
                if s[at] == 0:
                    want += model.rest[t[at - 3], k]
            assert abs(found - want) < 1e-3 * max(1, want), (lang, t)


def test_ppm_codes_every_byte():
    """With few symbols of their own, many byte values and a cut tree, all 256 bytes after any others have codes that sum to one."""
    r = random.Random(22)
    model = ppm.train({"a": [bytes(r.randrange(256) for _ in range(5000))], "b": [b"plain text " * 40]}, own_symbols=20, max_contexts=50)
    for before in (b"", b"pla", bytes([200, 3, 250])):
        data = np.frombuffer(b"".join(before + bytes([b]) for b in range(256)), np.uint8)
        step = len(before) + 1
        whole = model.bits(data, np.arange(0, len(data) + 1, step))
        start = model.bits(np.frombuffer(before, np.uint8), np.array([0, len(before)]))
        assert np.allclose(np.exp2(start - whole).sum(0), 1, atol=1e-3)


def test_languages_of_long_texts_and_many_labels(spark):
    long = "the and of with this that from " * 4000
    rows = [(k, long[k:], "aa") for k in range(6)] + [(10 + k, "der die und nicht ein mit sich " * 3000, "bb") for k in range(6)] + [(30, "die und nicht ein", None), (31, "the and of with", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x["lang_pred"] for x in ppm.languages(docs).collect()}
    assert all(got[k] == "aa" for k in range(6)) and all(got[10 + k] == "bb" for k in range(6)) and (got[30], got[31]) == ("bb", "aa")
    with pytest.raises(ValueError, match="labels"):
        ppm.fit(docs, labels=1)


def test_packing(spark, make, corpus):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    rows = [r for r in corpus if r[0] is None or r[0] != 7] + [(900 + k, prose(1 + 97 * k % 900, k)) for k in range(80)]
    got = packing.pack(make(rows).repartition(5), path, window=256, most=4).collect()
    tok = Tokenizer.from_file(path)
    want = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in rows if i is not None}
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i, ids in want.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
        padding += 0 if at & (at - 1) == 0 else 256 - at
    assert padding < 0.02 * 256 * len(by_seq)
    assert packing.pack(make(rows).where("false"), path).count() == 0


def covered(pieces, texts, tok):
    """Whether pieces (of one doc_id) lay out every token of its texts, each once, in whatever windows."""
    want = collections.Counter()
    for t in texts:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.update((k, int(x), len(ids)) for k, x in enumerate(ids))
    sums = collections.defaultdict(set)
    for t in texts:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for r in pieces:
            if r["doc_tokens"] == len(ids) and zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]:
                sums[r["start"], r["length"], r["doc_tokens"], r["ids_crc32"]].add(tuple((k, int(ids[k]), len(ids)) for k in range(r["start"], r["start"] + r["length"])))
    got = collections.Counter()
    for r in pieces:
        same = sums[r["start"], r["length"], r["doc_tokens"], r["ids_crc32"]]
        assert len(same) == 1, r
        got.update(next(iter(same)))
    return got == want


def test_packing_of_repeated_and_null_ids(spark, make, corpus):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = corpus + [(7, prose(300, 5)), (7, None), (None, prose(90, 6)), (None, ""), (400, "x")]
    got = packing.pack(make(rows).repartition(3), path, window=128, most=3).collect()
    for i in {i for i, _ in rows}:
        assert covered([r for r in got if r["doc_id"] == i], [t for j, t in rows if j == i], tok), i
    places = collections.defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sum(n for _, n in p) <= 128 and [o for o, _ in sorted(p)] == np.cumsum([0] + [n for _, n in sorted(p)])[:-1].tolist() for p in places.values())


def test_mixing(spark, make):
    rows = [(k, prose(5, k)) for k in range(3000)] + [(None, None), (1, ""), (1, "")]
    docs = make(rows).withColumn("copy", F.lit("x")).withColumn("source", F.when(F.col("doc_id") < 1500, "big").when(F.col("doc_id") < 2500, "mid"))
    out = mixing.mix(docs, {"big": 1.0, "mid": 2.0}, default_weight=1.0)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["mid"] / out.count() - 0.5) < 0.05 and abs(n["big"] / out.count() - 0.25) < 0.05 and n[None] > 0
    assert out.count() == mixing.mix(docs.repartition(7), {"big": 1.0, "mid": 2.0}).count()
    assert out.groupBy("doc_id", "text", "copy").count().where("count > 1 and text is not null and text <> ''").isEmpty()
    assert mixing.mix(docs, {"big": 0.0, "mid": 0.0}, default_weight=0.0).count() == 0
    assert mixing.mix(docs.where("false")).count() == 0
    many = mixing.mix(docs.where("doc_id < 100"), total=10_000).count()  # a mean of 100 is the sum of smaller draws
    assert abs(many - 10_000) < 500


def test_poisson_inverts_the_distribution(spark):
    from math import exp, factorial

    for mean in (0.1, 2.5, 8.0):
        got = spark.range(1000).select(mixing.poisson(mixing.thresholds(F.lit(mean)), (F.col("id") + 0.5) / 1000).alias("k"), ((F.col("id") + 0.5) / 1000).alias("u")).collect()
        for r in got:
            k, total = 0, exp(-mean)
            while total <= r["u"]:
                k += 1
                total += exp(-mean) * mean**k / factorial(k)
            assert r["k"] == k


def brute_removed(rows):
    first, out = {}, {}
    for i in sorted({i for i, _ in rows if i is not None}):
        for _, t in [r for r in rows if r[0] == i]:
            for j in range(len(b := (t or "").encode()) - 49):
                first.setdefault(b[j : j + 50], i)
    for k, (i, t) in enumerate(rows):
        b = (t or "").encode()
        mask = np.zeros(len(b), bool)
        for j in range(len(b) - 49):
            if i is not None and first[b[j : j + 50]] < i:
                mask[j : j + 50] = True
        spans = int((mask & ~np.concatenate([[False], mask[:-1]])).sum()) if len(b) else 0
        out[k] = (len(b), int(mask.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~mask])).hexdigest())
    return out


def test_suffix_removal(spark, make, corpus, monkeypatch):
    monkeypatch.setattr(exchange, "BUCKET_BYTES", 20_000)
    rows = corpus + [(600, "y" * 49), (601, "y" * 50), (602, "y" * 51 + "z" * 60), (603, "z" * 120)]
    docs = make(rows).repartition(3)
    got = suffix.remove_repeats(docs, keep_text=True).collect()
    want = brute_removed(rows)
    assert sorted((str(rows[k][0]), *want[k]) for k in want) == sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)
    assert suffix.remove_repeats(docs.where("false")).count() == 0


def test_suffix_removal_across_pieces(make, monkeypatch):
    """Long texts are read in pieces: the windows at their seams, and whole texts of one byte."""
    monkeypatch.setattr(suffix, "PIECE", 256)
    monkeypatch.setattr(suffix, "BATCH", 300)
    monkeypatch.setattr(exchange, "BATCH_BYTES", 3000)
    long = prose(900, 31)
    rows = [(1, long), (2, "q" + long[:-3]), (3, long[200:700]), (4, prose(20, 5) + long[100:150] + "!"), (5, "0" * 3000), (6, "0" * 2000 + "1"), (5, long[:60]), (7, None)]
    got = suffix.remove_repeats(make(rows).repartition(2)).collect()
    want = brute_removed(rows)
    assert sorted((rows[k][0], *want[k]) for k in want) == sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got)


def test_suffix_index_meets_new_batches(spark, make, corpus, tmp_path, monkeypatch):
    """Batches in the order of doc_id against a kept family give what one run over all rows gives."""
    monkeypatch.setattr(exchange, "BUCKET_BYTES", 20_000)
    rows = sorted((r for r in corpus if r[0] is not None), key=lambda r: r[0])
    want = brute_removed(rows)
    index = f"file://{tmp_path}/levels"
    got, sizes = [], []
    for a, b in ((0, 120), (120, 130), (130, 310), (310, 10_000)):
        part = [r for r in rows if a <= r[0] < b]
        got += suffix.extend(make(part), index, buckets=3).collect()
        held = spark.read.parquet(index)
        gone = {(r["bucket"], m) for r in held.collect() for m in r["merged"]}
        levels = [(r["bucket"], r["name"], suffix.Level.unpacked(r["blob"])) for r in held.collect()]
        alive = sorted((k, len(x)) for k, m, x in levels if (k, m) not in gone)
        sizes.append(alive)
    assert sorted((rows[k][0], *want[k]) for k in want) == sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got)
    assert all(len({n for k2, n in s if k2 == k}) == sum(k2 == k for k2, _ in s) for s in sizes for k in range(3))
    assert suffix.extend(make(rows[:1]).where("false"), index).count() == 0


def test_toxicity(spark, make):
    r = random.Random(4)
    rows = [(k, prose(60, k) + (" you utter Nitwit!! dunce " if k % 5 == 0 else " fine ") + prose(20, 9000 + k)) for k in range(900)]
    docs = make(rows + [(2000 + k, t) for k, t in enumerate(AWKWARD)] + [(None, "dunce")])
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(900)] + [(3, 1, None), (None, 1, 1), (99999, 0, 1)], "doc_id long, quality int, toxic int")
    got = {g["doc_id"]: g for g in toxicity.toxicity(docs, labels).collect()}
    held = [k for k in range(900) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k]["held_out"] == (k in set(held)) for k in range(900))
    assert np.mean([got[k]["predicted"] == (k % 5 == 0) for k in held]) > 0.95
    assert all(0 <= g["score"] <= 1 for g in got.values()) and got[2000]["score"] == got[2001]["score"]
    nothing = toxicity.toxicity(docs, labels.where("false"))
    assert {g["score"] for g in nothing.collect()} == {0.5}
    assert r is not None


def test_top_k(spark):
    r = np.random.default_rng(6)
    vectors = [(int(k), [float(x) for x in r.normal(size=8).round(1)]) for k in range(700)]
    rows = vectors + [(800, None), (900, [1.0, None] + [0.0] * 6), (1000, [float("nan")] * 8), (1100, [float("inf")] * 8), (1200, []), (701, vectors[5][1]), (702, vectors[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("at", F.lit(1))
    got = [tuple(x) for x in topk.top_k(df, F.col("vec_id") % 100 == 0, 10).orderBy("query_id", "rank").collect()]
    whole = {i: np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in sorted(i for i in whole if i % 100 == 0):
        best = sorted((-int(whole[q] @ whole[c]), c) for c in whole if c != q)[:10]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == want
    assert topk.top_k(df.where("vec_id < 3"), F.col("vec_id") % 100 == 0).count() == 2
    assert topk.top_k(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def plain_ftrl(rows, labels, order, alpha=0.2, beta=1.0, l1=3.0, l2=1.0):
    """FTRL-proximal as published, one coordinate at a time in dictionaries; the intercept is coordinate -1."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * l1) / ((beta + n[i] ** 0.5) / alpha + l2)

    for k in order:
        at = [*rows[k], -1]
        w = {i: weight(i) for i in at}
        p = 1 / (1 + np.exp(-max(-35, min(35, sum(w.values())))))
        g = p - labels[k]
        for i in at:
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w[i]
            n[i] += g * g
    return {i: weight(i) for i in list(z)}


def test_ftrl_against_a_plain_loop():
    r = np.random.default_rng(8)
    rows = [np.unique(r.integers(0, 200, 30)) for _ in range(150)]
    labels = np.array([float((x < 8).any()) for x in rows])
    order = [k for rng in [np.random.default_rng(7)] for _ in range(6) for k in rng.permutation(len(rows))]
    want = plain_ftrl([x.tolist() for x in rows], labels, order)
    got = toxicity.ftrl(rows, labels, bits=8)
    assert got[-1] == pytest.approx(want.pop(-1), abs=1e-6) and got[:-1] == pytest.approx([want.get(i, 0.0) for i in range(256)], abs=1e-6)
    assert 0 < np.count_nonzero(got[:-1]) < 200  # the L1 term leaves some at zero


def test_features_are_the_words_and_pairs():
    import pyarrow as pa

    texts = ["You, nit-wit! you nit wit", "", None, "a", "a b", "a b a b c", "Été à l'été", "x" * 3000, prose(300, 1)]
    data, offsets = text.buffers(pa.array(texts, pa.string()))
    values, at = toxicity.features(data, offsets, bits=40)
    number = {}
    for k, t in enumerate(texts):
        w = [x for x in re.split(rb"[^0-9A-Za-z\x80-\xff]+", (t or "").encode()) if x]
        w = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), x) for x in w]
        want = {(x,) for x in w} | {(1, x, y) for x, y in zip(w, w[1:])} | {(2, x, y) for x, y in zip(w, w[2:])}
        mine = values[at[k] : at[k + 1]].tolist()
        assert len(mine) == len(set(mine)) == len(want), t
        number[k] = (want, set(mine))
    for want, mine in number.values():  # what two texts share has one number in both
        for other, theirs in number.values():
            assert len(want & other) == len(mine & theirs)


def test_toxicity_of_long_texts_and_repeated_ids(spark, make):
    rows = [(k, prose(3000, k) + (" dunce nitwit" * 400 if k % 2 else "")) for k in range(40)]
    rows += [(k, prose(40, 800 + k) + (" dunce nitwit" if k % 2 else "")) for k in range(40, 240)] + [(41, "dunce nitwit here"), (41, None), (41, "")]
    labels = spark.createDataFrame([(k, k % 2) for k in range(240)] + [(41, 1), (41, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(make(rows), labels).collect()
    assert len(got) == len(rows) and np.mean([g["predicted"] == g["doc_id"] % 2 for g in got if g["held_out"]]) > 0.9


def brute_top(rows, k=10):
    whole = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None]
    out = []
    for q in sorted({i for i, _ in whole if i % 100 == 0}):
        found = [(-sum(a * b for a, b in zip(v, w)), c) for i, v in whole if i == q for c, w in whole if c != q]
        out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(sorted(found)[:k])]
    return out


def test_top_k_in_groups_and_chunks(spark, monkeypatch):
    """Clusters over many ranges, groups and chunks: floors are carried, most blocks are not scored, and results are exact."""
    for name, value in (("RANGE", 300), ("GROUP", 2), ("CHUNK", 7), ("PIVOTS", 24)):
        monkeypatch.setattr(topk, name, value)
    r = np.random.default_rng(16)
    centres = r.normal(size=(20, 12))
    rows = [(int(k), [float(x) for x in centres[k % 20] + r.normal(size=12) / 100]) for k in range(3000)]
    rows += [(50, rows[50][1][:5]), (50, rows[50][1]), (3100, [1.5, -2.0]), (3100, [0.5]), (3101, rows[0][1]), (3102, rows[0][1]), (None, rows[3][1])]
    scored = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("part", F.lit("x")).withColumn("asked", F.lit(1))
    got = [tuple(x) for x in topk.top_k(df.repartition(5), F.col("vec_id") % 100 == 0, scored=scored).orderBy("query_id", "rank").collect()]
    assert got == brute_top(rows)
    assert scored.value < 0.5 * 32 * 3000 / topk.BLOCK, scored.value


def test_top_k_refuses_what_it_can_not_hold(spark):
    for big in (1e300, -1e300, 2.0**43):
        with pytest.raises(Exception, match="no exact integer"):
            topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [big])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(spark.createDataFrame([(0, [2.0**42]), (1, [2.0**42])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    rows = [(0, [2.0**20 + 1, 1.0]), (1, [2.0**20 - 1, 3.0]), (2, [-(2.0**20), 0.5])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert [tuple(x) for x in got] == brute_top(rows)


def test_top_k_prunes_and_stays_exact_for_large_components():
    r = np.random.default_rng(1)
    centres = r.normal(size=(40, 16)) * 50
    rows = np.floor(np.repeat(centres, 64, axis=0) + r.normal(size=(2560, 16)))
    best, who, scored = topk.search(rows[:3], np.array([0, 1, 2]), rows, np.arange(2560), 10)
    assert scored < 3 * 20  # of 3 * 40 blocks
    big = (rows * 2**40).astype(np.int64)
    b2, w2, _ = topk.search(big[:2] >> 30, np.array([0, 1]), big >> 20, np.arange(2560), 10)
    assert (np.diff(b2.astype(object), axis=1) <= 0).all() and w2.shape == (2, 10)


def brute_rules(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen, dup, failed = set(), 0, 0
    for line in (t or "").split("\n"):
        w = re.findall(r"[^\x20\x09-\x0D]+", line)
        if not w:
            continue
        dup += line in seen
        seen.add(line)
        marks = len(re.findall(r"[#*$%&|<>]", line))
        bars = sum(x in ("|", ">") for x in w)
        caps, letters = len(re.findall("[A-Z]", line)), len(re.findall("[A-Za-z]", line))
        low = re.sub("[A-Z]", lambda m: m[0].lower(), line)
        bad = not any(x.endswith(linerules.ENDS) for x in w) or 2 * marks > len(w) or (bars >= 2 and 5 * bars >= len(w)) or (letters >= 10 and 2 * caps > letters) or any(p in low for p in linerules.PHRASES)
        failed += bad * len(w)
    at = collections.Counter(zip(words, words[1:], words[2:]))
    mark = {j for k in range(len(words) - 2) if at[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    base = len(words) < 50 or 100 * len(mark) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(mark), base, not base and 100 * failed <= linerules.LOSS * len(words))


def test_line_rules(make, corpus):
    good = ".\n".join(prose(12, k) for k in range(8)) + "."
    more = [good, good + "\n" + good, good + "\nHome | About | Contact", good + "\nPRIVACY POLICY and more.", "\n\n" + good + "\r\n", good.upper(), re.sub(" ", "## ", good), good.replace(".", "”"), good.replace(".", "…\n\n"), "x y z " * 40 + "."]
    rows = corpus + [(700 + k, t) for k, t in enumerate(more)]
    got = linerules.line_rules(make(rows), cleaned=True).collect()
    assert sorted((str(i), *brute_rules(t)) for i, t in rows) == sorted((str(r["doc_id"]), *(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))) for r in got)
    assert linerules.line_rules(make(rows).where("false"), cleaned=True).count() == 0
    by = {r["doc_id"]: r for r in got}
    assert by[700]["kept"] and by[702]["kept"] and by[702]["clean_text"].strip() == good and not by[705]["kept"] and by[400]["clean_text"] is None


def test_repeated_passages(make, corpus, monkeypatch):
    monkeypatch.setattr(exchange, "BUCKET_BYTES", 20_000)
    fuzzy = prose(80, 321)
    rows = corpus + [(800 + k, f"{prose(60, 7000 + k)} {edited(fuzzy, 0.05 * (k > 0), k)} {prose(25, 8000 + k)}") for k in range(6)]
    rows += [(900 + k, prose(150, 12_000 + k)) for k in range(20)]
    got = chaining.repeated_passages(make(rows).repartition(3)).collect()
    found = collections.defaultdict(list)
    texts = {i: (t or "").lower().split(" ") for i, t in rows}
    for r in got:
        assert r["source_doc_id"] < r["doc_id"] and r["end"] - r["start"] >= chaining.LEAST and r["n_equal"] > 0.8 * r["n_places"]
        found[r["doc_id"]].append((r["start"], r["end"]))
    for i in range(301, 310):  # an exact passage of 70 words from word 40
        assert any(s <= 42 and e >= 108 for s, e in found[i]), (i, found[i])
    for i in range(801, 806):  # with some words changed, from word 60
        assert any(s <= 66 and e >= 134 for s, e in found[i]), (i, found[i])
    assert all(i in found for i in range(201, 212))  # whole copies
    assert not any(i in found for i in [*range(25), 300, 800, *range(900, 920)])
    assert texts
    assert chaining.repeated_passages(make(rows).where("false")).count() == 0


def test_gaps_are_aligned():
    r = np.random.default_rng(2)

    def longest(a, b):
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = max(t[i, j + 1], t[i + 1, j], t[i, j] + (x == y))
        return int(t[-1, -1])

    for n, m in ((0, 3), (1, 1), (1, 5), (7, 4), (12, 12), (30, 19), (40, 70)):
        for _ in range(8):
            a, b = r.integers(0, 4, n), r.integers(0, 4, m)
            got = chaining.paired(a, b)
            assert len(got) == longest(a, b) and all(a[i] == b[j] for i, j in got)
            assert all(x < p and y < q for (x, y), (p, q) in zip(got, got[1:]))
    long = r.integers(0, 10_000, 900)
    cut = np.delete(long, [100, 101, 350, 700])
    assert len(chaining.paired(long, cut)) == 896 == len(chaining.paired(cut, long))
    # an insertion and a deletion within one gap, whose ends alone are seeds
    a = np.concatenate([np.arange(30), [900], np.arange(31, 35), [901], np.arange(36, 70)])
    b = np.concatenate([np.arange(30), [800, 801], np.arange(31, 35), np.arange(36, 70)])
    got = chaining.align(a, b, np.array([[0, 0, 26], [36, 36, 30]]))
    assert [(x[0], x[1], x[4]) for x in got] == [(0, 70, 68)]


def brute_windows(rows, least=chaining.LEAST):
    """Of each document, the places of words in a window of ``least`` words that also lies in a smaller document."""
    first, out = {}, collections.defaultdict(set)
    words = [(i, re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))) for i, t in rows if i is not None]
    for i, w in sorted(words):
        for j in range(len(w) - least + 1):
            key = tuple(w[j : j + least])
            if first.setdefault(key, i) < i:
                out[i].update(range(j, j + least))
    return out


def test_exact_passages_of_frequent_lines(spark, make, corpus, monkeypatch):
    """Passages whose pieces lie apart in smaller documents still meet a document that holds all of them."""
    monkeypatch.setattr(exchange, "BUCKET_BYTES", 20_000)
    r = random.Random(8)
    left, right = prose(30, 61), prose(30, 62)
    rows = [(1, f"{prose(40, 63)} {left} {prose(40, 64)}"), (2, f"{prose(40, 65)} {right} {prose(40, 66)}")]
    rows += [(k, f"{prose(20 + k, 70 + k)} {left} {right} {prose(30, 90 + k)}") for k in (10, 20)]
    lines = [prose(r.randint(4, 30), 100 + k) for k in range(30)]
    rows += [(1000 + k, " ".join(r.choice(lines) for _ in range(r.randint(2, 12)))) for k in range(250)]
    rows += [(2000 + k, f"{prose(7, 300 + k)} {prose(m, 400)} {prose(9, 500 + k)}") for k, m in enumerate((44, 45, 45, 46, 44))]
    pieces = prose(60, 880).split(" ")  # a passage of which smaller documents hold pieces of 14 words
    rows += [(3000 + k, f"{prose(20, 881 + k)} {' '.join(pieces[5 * k : 5 * k + 14])} {prose(20, 900 + k)}") for k in range(10)]
    rows += [(3100 + k, f"{prose(20, 921 + k)} {' '.join(pieces)} {prose(20, 941 + k)}") for k in range(2)]
    rows += corpus
    got = collections.defaultdict(set)
    texts = {i: (t or "").lower().split() for i, t in rows}
    for p in chaining.repeated_passages(make(rows).repartition(3)).collect():
        assert p["source_doc_id"] < p["doc_id"] and p["end"] <= len(texts[p["doc_id"]]) and p["source_end"] <= len(texts[p["source_doc_id"]])
        got[p["doc_id"]].update(range(p["start"], p["end"]))
    want = brute_windows(rows)
    assert set(range(40, 100)) <= got[20] and set(range(20, 80)) <= got[3101] and len(want) > 100
    assert all(places <= got[i] for i, places in want.items()), [i for i, places in want.items() if not places <= got[i]]


def test_passages_of_regular_changes(make):
    """Passages with every 6th to 8th word changed (83 to 88 percent equal) are found, each of them."""
    rows, near = [], {}
    for k in range(60):
        every, n = 6 + k % 3, 60 if k < 45 else 200
        words = prose(n, 20_000 + k).split(" ")
        rows.append((k, f"{prose(50, 21_000 + k)} {' '.join(words)} {prose(50, 22_000 + k)}"))
        changed = [f"{w}x{k}" if i % every == k % every else w for i, w in enumerate(words)]
        rows.append((100 + k, f"{prose(30, 23_000 + k)} {' '.join(changed)} {prose(30, 24_000 + k)}"))
        near[100 + k] = n
    got = {}
    for r in chaining.repeated_passages(make(rows)).collect():
        assert r["source_doc_id"] == r["doc_id"] - 100 and r["n_equal"] > 0.8 * r["n_places"]
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["end"] - r["start"]
    assert {i for i, n in near.items() if got.get(i, 0) < 0.85 * n} == set()


def brute_passages(rows, least=chaining.LEAST):
    """Of each document, the words in a stretch of ``least`` or more places that aligns, with over 80 percent of its places equal, with one in a smaller document: every pair, every diagonal, then what a diagonal shifts to within 5 places."""
    words = sorted((i, (t or "").lower().split()) for i, t in rows)
    out = collections.defaultdict(set)
    for x, (i, a) in enumerate(words):
        for j, b in words[:x]:
            if j == i or len(a) < least or len(b) < least:
                continue
            code = {w: k for k, w in enumerate(set(a) | set(b))}
            p, q = np.array([code[w] for w in a]), np.array([code[w] for w in b])
            for shift in range(-len(q) + least, len(p) - least + 1):
                lo, hi = max(0, shift), min(len(p), len(q) + shift)
                eq = p[lo:hi] == q[lo - shift : hi - shift]
                if eq.sum() < 0.8 * least:
                    continue
                sums = np.concatenate([[0], np.cumsum(np.where(eq, 1, -4))])
                for s in range(len(eq) - least + 1):  # stretches that begin and end equal
                    if eq[s]:
                        ends = np.flatnonzero((sums[s + least :] > sums[s]) & eq[s + least - 1 :])
                        if len(ends):
                            out[i].update(range(lo + s, lo + s + least + int(ends[-1])))
    return out


def test_passages_against_exhaustive_search(make, monkeypatch):
    """Random edits of every kind: what an exhaustive search finds is found, at least nine words in ten of it, and nothing else."""
    monkeypatch.setattr(exchange, "BUCKET_BYTES", 20_000)
    r = random.Random(12)
    rows = []
    for k in range(90):
        if k < 30 or r.random() < 0.3:
            rows.append((k, prose(r.randint(0, 160), 30_000 + k)))
            continue
        out = prose(r.randint(5, 60), 31_000 + k).split(" ")
        for _ in range(r.randint(1, 2)):
            source = r.choice(rows)[1].split(" ")
            start = r.randint(0, max(0, len(source) - 50))
            share = r.choice([0, 0, 0.02, 0.05, 0.1, 0.15])
            out += [r.choice(WORDS) if r.random() < share else w for w in source[start : start + r.randint(46, 120)]] + prose(r.randint(3, 40), 32_000 + k).split(" ")
        rows.append((k, " ".join(out)))
    want = brute_passages(rows)
    got = collections.defaultdict(set)
    texts = {i: t.lower().split() for i, t in rows}
    for p in chaining.repeated_passages(make(rows).repartition(3)).collect():
        assert p["n_equal"] > 0.8 * p["n_places"] and p["source_doc_id"] < p["doc_id"]
        a, b = texts[p["doc_id"]][p["start"] : p["end"]], texts[p["source_doc_id"]][p["source_start"] : p["source_end"]]
        assert len(a) >= chaining.LEAST and sum((collections.Counter(a) & collections.Counter(b)).values()) >= p["n_equal"]
        got[p["doc_id"]].update(range(p["start"], p["end"]))
    found = sum(len(got[i] & places) for i, places in want.items())
    total = sum(map(len, want.values()))
    assert len(want) > 30 and found >= 0.9 * total, (found, total)
    assert sum(len(places - want[i]) for i, places in got.items()) <= 0.05 * total
    print("recall in words", found / total)


def test_passages_of_repeated_ids(make):
    """Texts of one id are compared with smaller documents, each cut by its own passages; no row is lost or multiplied."""
    p, q = prose(60, 51), prose(60, 52)
    rows = [(1, p + " " + prose(30, 53)), (2, prose(20, 54) + " " + q), (1, prose(30, 55)), (3, prose(25, 56) + " " + p), (3, q + " " + prose(40, 57)), (3, prose(25, 56) + " " + p), (4, q), (4, p), (4, prose(50, 58)), (None, p), (None, p), (5, ""), (5, ""), (2, prose(20, 59) + " " + q)]
    docs = make(rows)
    got = {(x["doc_id"], x["start"], x["end"], x["source_doc_id"], x["source_start"], x["source_end"]) for x in chaining.repeated_passages(docs).collect()}
    assert {(3, 25, 85, 1, 0, 60), (4, 0, 60, 1, 0, 60)} <= got and {g[0] for g in got} == {3, 4}
    assert (3, 0, 60, 2, 20, 80) in got and (4, 0, 60, 2, 20, 80) in got and len(got) == 4
    left = sorted(((x["doc_id"], " ".join(x["text"].split())) for x in chaining.without_passages(docs).collect()), key=str)
    assert left == sorted([*rows[:3], (3, prose(25, 56)), (3, prose(40, 57)), (3, prose(25, 56)), rows[8], (None, p), (None, p), (5, ""), (5, ""), rows[13]], key=str)
    none = chaining.without_passages(docs.where("false"))
    assert none.count() == 0 and none.columns == docs.columns


def test_without_passages(make):
    passage = prose(60, 42)
    rows = [(1, prose(50, 1) + " " + passage), (2, passage + "\n" + prose(50, 2)), (3, passage), (4, prose(50, 4)), (None, passage), (5, None)]
    docs = make(rows)
    got = {r["doc_id"]: r for r in chaining.without_passages(docs).collect()}
    assert set(got) == {1, 2, 4, None, 5} and got[1]["text"] == rows[0][1]
    assert got[2]["text"].split() == prose(50, 2).split() and got[2]["n_chars"] == len(got[2]["text"]) and chaining.without_passages(docs).columns == docs.columns


def test_written_tables(spark):
    """They are read again as they were, lie in the application's folder, and leave the session's settings alone."""
    before = spark.conf.get(shared._CLEAN, None)
    df = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()
    for _ in range(2):
        out, path = shared.written(df, "some")
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect())) and path.startswith(shared.home(spark)) and shared.exists(spark, path)
        shared.removed(spark, path)
        assert not shared.exists(spark, path) and spark.conf.get(shared._CLEAN, None) == before


def test_bounded_rows(spark):
    df = spark.range(5000).selectExpr("id", "if(id < 4000, 'a', 'b') as k")
    got = sampling.bounded_rows(df, "id", "k", 20).collect()
    assert collections.Counter(r["k"] for r in got) == {"a": 20, "b": 20}
    assert got and {r["id"] for r in got} == {r["id"] for r in sampling.ranked(df, "id", "k", 20).collect()}
    texts = spark.createDataFrame([(1, "abcdef"), (2, "ab"), (3, None), (4, "é" * 50)], "id long, t string")
    cut = {r["id"]: r["s"] for r in texts.select("id", sampling.stretch("t", "id", 4).alias("s")).collect()}
    assert cut[1] in "abcdef" and len(cut[1]) == 4 and cut[2] == "ab" and cut[3] is None and cut[4] == "é" * 4


def test_pipeline(spark, make, corpus, tmp_path):
    pytest.importorskip("public_tokenizers")
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = corpus + [(7, prose(80, 9001)), (None, prose(50, 9002))]
    make(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    texts = dict(rows)
    kept = pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    assert collections.Counter((r["doc_id"], r["text"]) for r in kept.collect()) == collections.Counter((i, t) for i, t in rows if re.search(r"[^\W\d_]", t or ""))
    one = pipeline.STAGES[1][1](spark, docs, str(tmp_path))
    ids = collections.Counter(r["doc_id"] for r in one.collect())
    assert not set(ids) & set(range(201, 212)) and one.columns == docs.columns and ids[7] == 2 and ids[None] == sum(i is None for i, _ in rows) and all(n == 1 for i, n in ids.items() if i not in (7, None))
    cut = {r["doc_id"]: r["text"] for r in pipeline.STAGES[2][1](spark, docs, str(tmp_path)).collect()}
    assert all(len(cut[i].split()) < len(texts[i].split()) - 60 for i in range(301, 310)) and cut[300] == texts[300]
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert out and {"doc_id", "sequence_id", "ids_crc32"} <= set(out[0].asDict())
    docs.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage on its own input: language by a plain coder's argmin, groups by 5-word sets, cuts by 45-word windows, draws by their hashes, packing by the tokenizer."""
    public = pytest.importorskip("public_tokenizers")
    pipeline = pytest.importorskip("corpus_pipeline")
    from tokenizers import Tokenizer

    r = random.Random(40)
    kinds = {"aa": "bcdf", "bb": "lmnp"}

    def unique(n, seed, lang):  # words that occur once: a fuzzy passage is an exact one
        q = random.Random(seed)
        return ["".join(q.choice(kinds[lang]) + q.choice("aeiou") for _ in range(5)) for _ in range(n)]

    rows, passages = [], [unique(60, 90 + k, "aa") for k in range(3)]
    for k in range(60):
        lang = "aa" if k % 3 else "bb"
        words = unique(r.randint(60, 120), 1000 + k, lang)
        if lang == "aa" and k % 4 == 0:
            at = r.randint(0, len(words))
            words[at:at] = passages[k % 3]
        rows.append((k, " ".join(words), lang if k % 5 else None, f"src{k % 4}"))
    for k in range(8):  # near copies, one word in forty changed at the end
        words = rows[k][1].split(" ")
        rows.append((100 + k, " ".join([*words[:-1], "zz"]), None, "src0"))
    rows += [(200, None, "aa", "src1"), (201, "12 34", None, "src1"), (3, rows[3][1], rows[3][2], "src3")]
    full = [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    got = pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    model = ppm.fit(docs)
    want = []
    for i, t, lang, s, n in full:
        if t is None or not re.search(r"[^\W\d_]", t):
            continue
        raw = np.frombuffer(t.encode(), np.uint8)
        bits = [float(model.bits(raw, np.array([0, len(raw)]))[0, k]) for k in range(len(model.langs))]
        gap = [(b - min(bits)) * min(len(raw), 64) / len(raw) for b in bits]
        if 1 / sum(2.0**-g for g in gap) >= pipeline.LEAST_CERTAIN:
            want.append((i, t, lang or model.langs[int(np.argmin(bits))], s, n))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) >= 67

    docs = got.persist()
    got = pipeline.STAGES[1][1](spark, docs, str(tmp_path))
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((x[0], x[1].split(" ")) for x in want)}
    low = {i: min(j for j in sets if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])) for i in sets}
    want = sorted({x for x in want if low[x[0]] == x[0]})
    assert sorted(map(tuple, got.collect())) == want and not any(x[0] >= 100 for x in want)

    docs = got.persist()
    got = pipeline.STAGES[2][1](spark, docs, str(tmp_path))
    gone = brute_windows([x[:2] for x in want])
    left = []
    for i, t, lang, s, n in want:
        words = t.split(" ")
        kept = [w for k, w in enumerate(words) if k not in gone.get(i, ())]
        if kept:
            left.append((i, kept, lang, s))
    assert sorted((x["doc_id"], x["text"].split(), x["lang"], x["source"]) for x in got.collect()) == sorted(left) and len(gone) > 3
    assert all(x["n_chars"] == len(x["text"]) for x in got.collect())

    docs = got.persist()
    got = pipeline.STAGES[3][1](spark, docs, str(tmp_path))
    now = [tuple(x) for x in docs.collect()]
    size = collections.Counter(x[3] for x in now)
    weight = {s: pipeline.MIX_WEIGHTS.get(s, 1.0) for s in size}
    want = collections.Counter()
    for x in now:
        rate = weight[x[3]] * len(now) / sum(weight.values()) / size[x[3]]
        parts = max(1, int(np.ceil(rate / 8)))
        key = f"17|{x[0]}|{hashlib.md5(x[1].encode()).hexdigest()}"
        for k in range(1, parts + 1):
            u, n, p = int(hashlib.md5(f"{key}|{k}".encode()).hexdigest()[:13], 16) / 2**52, 0, np.exp(-rate / parts)
            total = p
            while total <= u and n < 40:
                n += 1
                p = p * (rate / parts) / n
                total += p
            want[x] += n
    assert collections.Counter(map(tuple, got.collect())) == +want and sum(want.values()) > 20

    pieces = pipeline.STAGES[4][1](spark, got.persist(), str(tmp_path)).collect()
    tok = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    for i in {x[0] for x in want}:
        assert covered([p for p in pieces if p["doc_id"] == i], [x[1] for x, n in want.items() if x[0] == i for _ in range(n)], tok)
