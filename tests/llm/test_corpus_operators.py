"""WARC audit, suffix dedup, nearest neighbours, n-gram join, decontamination, pipeline: brute force and edge cases."""

from __future__ import annotations

import collections
import gzip
import hashlib
import io
import itertools
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from diamondlake.llm import common, decontamination, neighbours, ngram_join, shingles, suffix_dedup, warc_audit

# WARC ---------------------------------------------------------------------------------------------


def record(body: bytes) -> bytes:
    return b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_warc_files(spark, tmp_path):
    bodies = [b"", b"a\r\n\r\nb", b"x" * 100_000, b"a\r\n\r\nb"]
    (tmp_path / "one.warc").write_bytes(b"".join(map(record, bodies)))
    (tmp_path / "two.warc.gz").write_bytes(b"".join(gzip.compress(record(b)) for b in bodies))
    (tmp_path / "torn.warc").write_bytes(b"WARC/1.1\r\nContent-Length: 999999\r\n\r\nabc\r\n\r\n" + record(b"z"))
    (tmp_path / "none.warc").write_bytes(b"")
    rows = collections.defaultdict(list)
    for r in warc_audit.index_warc(spark, str(tmp_path / "*.warc*")).collect():
        rows[r["archive"].rsplit("/", 1)[1]].append((r["offset"], r["length"], r["digest"]))
    want, at = [], 0
    for b in map(record, bodies):
        want.append((at, len(b), hashlib.sha256(b).hexdigest()))
        at += len(b)
    assert sorted(rows["one.warc"]) == want == sorted(rows["two.warc.gz"])
    assert len(rows["torn.warc"]) == 2 and not rows["none.warc"]


def test_a_large_archive_is_read_in_pieces():
    bodies = [b"x" * 60_000_000, b"", b"y" * 100]
    packed = gzip.compress(b"".join(map(record, bodies)), 1)
    tracemalloc.start()
    rows = list(warc_audit.records(gzip.GzipFile(fileobj=io.BytesIO(packed))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [n for _, n, _ in rows] == [len(record(b)) for b in bodies] and peak < 20 << 20
    assert [d for *_, d in rows] == [hashlib.sha256(record(b)).hexdigest() for b in bodies]


@pytest.mark.parametrize("cut", [0, 1, 7, 40, 100, 180, 400])
def test_damaged_archives(cut):
    """Every byte is in one record, whatever was cut out or written over."""
    whole = b"".join(record(b) for b in (b"one" * 20, b"two" * 30, b"\r\n\r\nWARC/1.1\r\nnested", b"four" * 9))
    for raw in (whole[:cut] + whole[cut + 30 :], whole[:cut] + b"#" * 30 + whole[cut + 30 :], whole[:cut]):
        rows = list(warc_audit.records(io.BytesIO(raw)))
        assert [r[0] for r in rows] == [sum(n for _, n, _ in rows[:i]) for i in range(len(rows))] and sum(n for _, n, _ in rows) == len(raw)
        assert all(hashlib.sha256(raw[at : at + n]).hexdigest() == d for at, n, d in rows)


def test_audit_equals_full_compare(spark):
    rng = random.Random(1)
    rows, other, want = [], [], set()
    for a in range(3):
        at = 0
        for i in range(400):
            n, digest = rng.randint(1, 9000), f"{a}-{i}"
            rows.append((f"a{a}", at, n, 1, digest))
            kind = rng.random() if a else 1
            if kind < 0.01:
                want.add((f"a{a}", at, "missing"))
            elif kind < 0.02:
                other.append((f"a{a}", at, n, 1, digest + "!"))
                want.add((f"a{a}", at, "corrupt"))
            else:
                other.append((f"a{a}", at, n, 1, digest))
            at += n
    other.append(("a9", 0, 5, 1, "new"))
    want.add(("a9", 0, "extra"))
    left, right = (spark.createDataFrame(x, warc_audit.INDEX).withColumn("node", F.lit(3)) for x in (rows, other))
    assert {(r["archive"], r["offset"], r["status"]) for r in warc_audit.audit(left, right).collect()} == want
    assert warc_audit.audit(left, left).count() == 0 and warc_audit.audit(left.limit(0), left.limit(0)).count() == 0


def test_page_records_edges(spark):
    pages = spark.createDataFrame([(1, "u", "h"), (1, "u", "h"), (None, None, None), (2, "", "x" * 200_000)], "page_id long, url string, html string")
    rows = warc_audit.page_records(pages).collect()
    assert len(rows) == 3 and {r["copies"] for r in rows} == {1, 2}
    assert warc_audit.page_records(pages.limit(0)).count() == 0


# Suffix dedup -------------------------------------------------------------------------------------


def brute_removal(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(b), runs, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


def repeated_texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, base = prose(80), prose(300)
    near = []
    for _ in range(8):
        w = base.split()
        for _ in range(3):
            w[rng.randrange(len(w))] = word()
        near.append(" ".join(w))
    texts = [None, "", "short", "a" * 900, "ab" * 500, prose(400), base, base, *near, *[prose(30) + shared[rng.randint(0, 60) :] + prose(30) for _ in range(40)]]
    return texts + [shared + shared, "x" * 200, "x" * 199, prose(5000)]


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 3])
def test_suffix_dedup(spark, group):
    texts = repeated_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"h": F.lit(1), "kept": F.lit("q")})
    got = {r["doc_id"]: (r["n_bytes"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.without_repeats(docs, group=group).collect()}
    assert got == dict(enumerate(brute_removal(texts, suffix_dedup.LENGTH)))


def test_suffix_dedup_edges(spark):
    long = "".join(random.Random(1).choice("abcdefgh ") for _ in range(400))
    docs = spark.createDataFrame([(1, long), (1, long), (None, long[50:350]), (None, None)], "doc_id long, text string")
    rows = suffix_dedup.without_repeats(docs).collect()
    assert sorted(len(r["kept"]) for r in rows) == [0, 0, 0, 0] and len(rows) == 4
    assert suffix_dedup.without_repeats(docs.limit(0)).count() == 0


def test_transform_kernel():
    rng = random.Random(9)
    for length in (3, 17):
        for _ in range(40):
            parts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 50))) for _ in range(5)]
            raw = "\xff".join(parts[rng.randrange(5)] + parts[rng.randrange(5)] for _ in range(6)).encode("latin1") + b"\xff\xfe"
            text = np.frombuffer(raw, np.uint8)
            assert suffix_dedup.suffix_order(text).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
            seen = collections.Counter(raw[i : i + length] for i in range(len(raw) - length + 1))
            flags = suffix_dedup.repeated(text, length)
            for i in range(len(raw) - length + 1):
                if b"\xff" not in raw[i : i + length]:
                    assert flags[i] == (seen[raw[i : i + length]] > 1)


# Nearest neighbours -------------------------------------------------------------------------------


def exact(ids, vecs, asked, k):
    out = {}
    for q in asked:
        score = (vecs * vecs[q]).sum(axis=1)
        keep = [i for i in range(len(ids)) if i != q]
        out[ids[q]] = sorted(((-score[i], ids[i]) for i in keep))[:k]
    return out


def test_neighbours_reach_recall(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16)) * 3
    vecs = np.concatenate([centres[rng.integers(20, size=1500)] + rng.normal(size=(1500, 16)), np.repeat(centres[:1], 500, axis=0)]).astype(np.float32).astype(float)
    ids = rng.permutation(len(vecs))
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vecs, strict=True)], "id long, vec array<double>")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(rows, rows.where("id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((-r["score"], r["vec_id"]))
    want = exact(ids, vecs, [i for i in range(len(ids)) if ids[i] % 20 == 0], 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = sum(len({x[1] for x in got[q]} & {x[1] for x in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    common_ids = sorted(ids[1500:])
    asked = next(q for q in want if q in common_ids)
    assert [x[1] for x in got[asked]] == [x[1] for x in want[asked]]


def test_candidate_share_and_recall(spark):
    """On vectors that are nearly uniform on a sphere, which is the hardest case."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    vecs = np.array(rows["embedding"].tolist(), float)
    hashes = neighbours.fitted(vecs, float(np.linalg.norm(vecs, axis=1).max()), len(vecs), 20)
    asked = np.flatnonzero(rows["vec_id"] % 20 == 0)
    score = vecs[asked] @ vecs.T
    score[np.arange(len(asked)), asked] = -np.inf
    hit, _ = hashes.visits(vecs[asked], vecs)
    recall = np.take_along_axis(hit, np.argpartition(-score, 20, axis=1)[:, :20], axis=1).mean()
    print("candidate share", hit.mean(), "recall", recall)
    assert hit.mean() < 0.3 and recall >= 0.9


def test_groups_are_visited_likeliest_first():
    rng = np.random.default_rng(6)
    for bits in range(7):
        costs = rng.random(bits)
        every = sorted(range(1 << bits), key=lambda m: sum(c for i, c in enumerate(costs) if m >> i & 1))
        for wanted in (1, 3, 1 << bits):
            assert neighbours._cheapest(costs, wanted)[0].tolist() == every[:wanted]


def test_neighbours_over_many_groups(spark, monkeypatch):
    """Groups, parts and tables as a large table has them."""
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 24)) * 2
    vecs = centres[rng.integers(40, size=3000)] + rng.normal(size=(3000, 24)) * 0.7
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, vec array<double>")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(rows, rows.where("id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    want = exact(np.arange(3000), vecs, range(0, 3000, 20), 20)
    assert all(len(v) == 20 == len(set(v)) for v in got.values()) and set(got) == set(want)
    assert sum(len(set(got[q]) & {x[1] for x in want[q]}) for q in want) / (20 * len(want)) >= 0.9
    hashes = neighbours.fitted(vecs, float(np.linalg.norm(vecs, axis=1).max()), len(vecs), 20)
    hit, _ = hashes.visits(vecs[::20], vecs)
    assert hashes.bits == 6 and hit.mean() < 0.2


def test_queries_go_by_the_length_of_the_table(spark):
    table = [(i, [float(i), 1.0]) for i in range(1, 8)] + [(20, [1.0, 1.0])]
    rows = spark.createDataFrame([*table, (40, [1.0, 2.0, 3.0]), (60, [1.0, 2.0, 4.0])], "id long, vec array<double>")
    got = neighbours.nearest(rows, rows.where("id % 20 = 0"), k=2).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(20, 1, 7, 8.0), (20, 2, 6, 7.0)]


def test_neighbours_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (40, None), (60, []), (80, [0.0, 0.0]), (100, [nan, 1.0]), (120, [None, 1.0]), (140, [1.0, 2.0, 3.0]), (None, [3.0, 3.0])]
    frame = spark.createDataFrame(rows, "id long, vec array<double>").where("id IS NOT NULL").withColumns({"t": F.lit(9), "row": F.lit("x")})
    got = [tuple(r) for r in neighbours.nearest(frame, frame.where("id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (0, 4, 20, 0.0), (20, 1, 1, 2.0), (20, 2, 1, 2.0), (20, 3, 2, 2.0), (20, 4, 0, 0.0)]
    twice = neighbours.nearest(frame, frame.where("id = 1"), k=2).orderBy("rank").collect()
    assert [tuple(r) for r in twice] == [(1, 1, 1, 2.0)] * 2 + [(1, 2, 2, 2.0)] * 2 or [r["vec_id"] for r in twice] == [1, 1, 2, 2]
    assert neighbours.nearest(frame.limit(0), frame.limit(0)).count() == 0


# N-gram join --------------------------------------------------------------------------------------


def brute_components(texts, words, percent):
    sets = []
    for t in texts:
        lowered = "".join(c.lower() if c.isascii() else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((root[i], root[j]))
            root = [a if x == b else x for x in root]
    return [(len(s), root[i]) for i, s in enumerate(sets)]


def near_texts():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=20)
    texts = [None, "", " \t\n", "one", "One", "one two three", "ONE  two\nthree", "É é", "é É"]
    for size in (6, 30, 120, 900):
        base = rng.choices(vocabulary, k=size)
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randint(0, max(1, size // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w[: len(w) - rng.randint(0, max(1, size // 12))]))
    return texts + [" ".join(rng.choices(vocabulary, k=30) + passage + rng.choices(vocabulary, k=30)) for _ in range(40)] + texts[-5:]


@pytest.mark.parametrize(("words", "percent", "tile", "dense"), [(4, 85, 2048, 8), (5, 80, 16, 0), (4, 85, 8, 1)])
def test_components_equal_brute_force(spark, monkeypatch, words, percent, tile, dense):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "DENSE", dense)
    texts = near_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"sid": F.lit(1), "root": F.lit("q")})
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs, words, percent).collect()}
    assert got == dict(enumerate(brute_components(texts, words, percent)))


def test_one_of_each(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(5, text, "a"), (3, text + " more", "b"), (3, text + " more", "b"), (None, text, "c"), (7, None, "d"), (8, "", "e"), (9, "another text of its own here", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 string")
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["k1"]) for r in kept.collect()) == [(3, "b"), (7, "d"), (8, "e"), (9, "f")]
    assert ngram_join.one_of_each(docs.limit(0)).count() == 0


def test_signature_bound_holds():
    rng = np.random.default_rng(3)
    for n, m in ((50, 45), (760, 800), (3000, 3100)):
        both = rng.integers(1 << 63, size=min(n, m) - 5, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(1 << 63, size=x - len(both), dtype=np.uint64) + np.uint64(1 << 63)])) for x in (n, m))
        differ = ngram_join.least_difference([ngram_join.signature(a).tobytes()], [ngram_join.signature(b).tobytes()])[0]
        assert differ <= len(np.setxor1d(a, b))


def test_component_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 201), (202, 201)]
    found = {r["id"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {201: 200, 202: 200}


def test_shingle_words():
    assert len(shingles.shingle_set("a b c d a b c d", 4)) == 4 and len(shingles.shingle_set("A\x0bb\x0cc", 4)) == 1
    assert shingles.shingle_set("A b", 4).tolist() == shingles.shingle_set("a\t\tB ", 4).tolist()
    assert shingles.shingle_set("É", 4).tolist() != shingles.shingle_set("é", 4).tolist()


# Decontamination ----------------------------------------------------------------------------------


def leak_tables(spark):
    rng = random.Random(3)
    vocabulary = [f"term{i}" for i in range(3000)] + ["the", "of", "and"] * 400
    prose = lambda n: rng.choices(vocabulary, k=n)
    items = [prose(rng.randint(12, 90)) for _ in range(25)] + [["the", "of"], []]
    docs, want = [(0, None), (1, ""), (2, "the of and")], set()
    for i in range(3, 160):
        w = prose(rng.randint(20, 400))
        if i % 4 == 0:
            item, at = rng.randrange(25), rng.randrange(len(w))
            told = list(items[item])
            if i % 8 == 0:
                for _ in range(len(told) // 8):
                    told[rng.randrange(len(told) - 5)] = rng.choice(vocabulary)
            text = " ".join(w[:at]) + " " + (" ".join(told).upper() if i % 12 == 0 else ", ".join(told)) + "! " + " ".join(w[at:])
            want.add((i, item))
        else:
            text = " ".join(w)
        docs.append((i, text))
    return docs, [(i, " ".join(w)) for i, w in enumerate(items)] + [(99, None)], want


def test_leaks_are_found_and_clean_documents_kept(spark):
    docs, items, want = leak_tables(spark)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("number", F.lit("x"))
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(d, b).collect()}
    real = {(i, j) for i, j in found if j < 25}
    assert real == want
    kept = decontamination.without_leaks(d, b.where("item_id < 25"))
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_leaks_of_more_passages_than_the_rank(spark):
    rng = random.Random(11)
    vocabulary, odds = [f"w{i}" for i in range(400)], [1 / (i + 3) for i in range(400)]
    prose = lambda n: rng.choices(vocabulary, odds, k=n)
    items = [prose(32) for _ in range(600)]
    docs = []
    for i in range(150):
        told = list(items[i])
        for at in rng.sample(range(27), 6):
            told[at] = "changed"
        docs.append((i, " ".join(prose(rng.randint(1, 90)) + told + prose(40))))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(d, b).collect()}
    assert {(i, i) for i in range(150)} <= found


def test_short_items_are_found_beside_other_terms(spark):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [rng.choices(vocabulary, k=n) for n in range(3, 12) for _ in range(12)]
    others = [rng.choices(vocabulary, k=40) for _ in range(100)]
    docs = []
    for i, w in enumerate(items):
        host = rng.choices(vocabulary, k=rng.randint(60, 200))
        at = rng.randrange(len(host) + 1)
        docs.append((i, " ".join(host[:at] + w + host[at:])))
    far = [items[0][0], *["x"] * 12, *items[0][1:]]
    docs.append((-1, " ".join(far)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items + others)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(d, b).collect()}
    assert {(i, i) for i in range(len(items))} <= found and (-1, 0) not in found


def test_leak_edges(spark):
    d = spark.createDataFrame([(None, "a b c d e f g h i j k l"), (1, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (2, None)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(d, b).collect()] == [(None, 1)]
    assert decontamination.find_leaks(d.limit(0), b).count() == 0 and decontamination.find_leaks(d, b.limit(0)).count() == 0
    assert [r["doc_id"] for r in decontamination.without_leaks(d, b).collect()] == [1]


def test_a_leak_takes_no_row_that_shares_its_id(spark):
    leak = "a b c d e f g h i j k l"
    d = spark.createDataFrame([(None, leak), (None, "clean"), (2, leak), (2, "clean too"), (3, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, leak)], "item_id long, text string")
    kept = decontamination.without_leaks(d, b)
    assert kept.columns == d.columns and {r["text"] for r in kept.collect()} == {"clean", "clean too", None}


def test_svd_spans_the_matrix():
    rng = np.random.default_rng(1)
    dense = rng.normal(size=(30, 4)) @ rng.normal(size=(4, 40))
    right = decontamination.randomised_svd(dense, 4)
    assert right.shape == (40, 4) and np.allclose(dense @ right @ right.T, dense, atol=1e-6)
    whole = decontamination.randomised_svd(rng.normal(size=(6, 50)), decontamination.RANK)
    assert whole.shape[1] == 6 and np.allclose(whole.T @ whole, np.eye(6), atol=1e-8)


def brute_leaks(docs, items):
    """Every region of every document against every passage, weights from plain sets of words."""
    split = {i: decontamination.words(t or "") for i, t in docs}
    seen = collections.Counter(x for w in split.values() for x in set(w.tolist()))
    idf = lambda x: np.log1p(len(docs) / (seen[x] + 0.5))
    cut = [(i, p, decontamination.words(t or "")) for i, t in items for p in decontamination.passages(decontamination.words(t or ""))]
    used = {x for x in {x for _, p, _ in cut for x in p.tolist()} if seen[x] <= decontamination.COMMON * len(docs)}
    for _, p, _ in cut:
        used |= set(sorted(set(p.tolist()), key=lambda x: (-idf(x), x))[: decontamination.KEPT])
    found = {}
    for item, p, whole in cut:
        own = np.array(sorted(x for x in set(p.tolist()) if x in used), np.uint64)
        held = decontamination.Passage(item, p, len(whole), whole[-decontamination.ANSWER_WORDS :])
        step = decontamination.stride(p)
        for i, w in split.items():
            for begin in range(-step, len(w), step):
                said = decontamination.judged(held, (own, np.array([idf(x) ** 2 for x in own.tolist()])), w, begin, step)
                if said:
                    found[i, item] = max(found.get((i, item), 0), said[0])
    return found


@pytest.mark.parametrize(("seed", "passes", "rank"), [(1, 2048, 128), (2, 40, 8)])
def test_leaks_equal_brute_force(spark, monkeypatch, seed, passes, rank):
    monkeypatch.setattr(decontamination, "PASSES", passes)
    monkeypatch.setattr(decontamination, "RANK", rank)
    rng = random.Random(seed)
    vocabulary, odds = [f"w{i}" for i in range(900)], [1 / (i + 4) for i in range(900)]
    prose = lambda n: rng.choices(vocabulary, odds, k=n)
    items = [(i, " ".join(prose(rng.choice([3, 6, 9, 20, 32, 45, 80])))) for i in range(60)] + [(60, None), (61, "w0 w1")]
    docs = [(-1, None), (-2, "")]
    for i in range(70):
        told = items[rng.randrange(60)][1].split()
        for _ in range(rng.randint(0, len(told) // 3)):
            told[rng.randrange(len(told))] = rng.choice(vocabulary)
        for _ in range(rng.randint(0, 3)):
            told.insert(rng.randrange(len(told) + 1), rng.choice(vocabulary))
        docs.append((i, " ".join(prose(rng.randint(0, 120)) + told + prose(rng.randint(0, 60)))))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["overlap"] for r in decontamination.find_leaks(d, b).collect()}
    want = brute_leaks(docs, items)
    assert len(want) > 30 and got == want


def test_very_long_texts_and_equal_items(spark):
    leak = " ".join(f"rare{i}" for i in range(40))
    d = spark.createDataFrame([(1, "filler words " * 60_000 + leak), (2, leak + " x" * 200_000), (3, "filler")], "doc_id long, text string")
    b = spark.createDataFrame([(1, leak), (2, leak), (3, " ".join(f"long{i}" for i in range(50_000)))], "item_id long, text string")
    found = sorted((r["doc_id"], r["item_id"], r["overlap"], r["at"]) for r in decontamination.find_leaks(d, b).collect())
    assert [(x[0], x[1], x[2]) for x in found] == [(1, 1, 1.0), (1, 2, 1.0), (2, 1, 1.0), (2, 2, 1.0)] and found[2][3] == 0


def test_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert decontamination.common_subsequence(np.array(a), np.array(b)) == table[-1][-1]


# Pipeline -----------------------------------------------------------------------------------------


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "decontamination", "secrets", "packing"]
    held, sizes = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = common.stored(stage(spark, held, sf), name)
        assert held.columns == docs.columns
        sizes.append(held.count())
    english = docs.where("lang = 'en'").count()
    assert sizes == sorted(sizes, reverse=True) and 0.97 * english <= sizes[1] <= english + 0.1 * (sizes[0] - english) and sizes[-1] > 0.7 * sizes[1]
    assert held.where(F.col("text").rlike(r"AKIA[A-Z0-9]{16}")).isEmpty()
    packed = corpus_pipeline.run(spark, sf)
    assert packed.select("doc_id").distinct().count() == sizes[-1]
