"""The pipeline against a brute-force version of its stages, and on odd tables."""

from __future__ import annotations

import random
import zlib

import corpus_pipeline
import pytest
from test_corpus_operators import brute_components, brute_leaks
from test_small_operators import all_spans, check_pieces, plain_bayes

from diamondlake.llm import common, language_id, secret_scan

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, words, n):
    return " ".join(rng.choices(words, k=n))


def corpus():
    """Documents in two languages with copies, benchmark passages and secrets, and the benchmark."""
    rng = random.Random(5)
    english = ["the", "of", "and", "water", "house", "think", "which", "bright", "window", "through", *(f"word{c}" for c in "bcdfgh")]
    german = ["der", "und", "über", "zwölf", "straße", "nicht", "schön", "größe", "für", "zeit", *(f"wört{c}" for c in "bcdfgh")]
    items = [(i, " ".join(f"{rng.choice(english)}{rng.randint(10, 99)}" for _ in range(24))) for i in range(6)]
    rows: list[tuple] = [(0, None, "en"), (1, "", "de"), (2, "12 34 !", "en"), (3, "the", None)]
    for i in range(4, 90):
        lang = "de" if i % 3 == 0 else "en"
        text = prose(rng, german if lang == "de" else english, rng.randint(15, 80))
        if i % 7 == 0:
            text += " " + items[i % 6][1] + " " + prose(rng, english, 10)
        if i % 5 == 0:
            text += " token=abcdefgh0123 " + prose(rng, english, 5)
        rows.append((i, text, lang if i % 11 else None))
    near = [(100 + j, rows[20 + j][1] + " water", rows[20 + j][2]) for j in range(12)]
    rows += near + rows[30:34] + [(200, rows[40][1], "en"), (None, prose(rng, english, 40), "en"), (None, rows[41][1], "de")]
    return [(i, t, lang, "s", len(t or "")) for i, t, lang in rows], items


def after_language(rows):
    held = lambda r: zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 4 == 2
    learnt = [(r[2], r[1]) for r in rows if not held(r) and r[2] is not None and r[1] is not None]
    said = list(plain_bayes(learnt, [r[1] or "" for r in rows]))
    lettered = [any(map(str.isalpha, r[1] or "")) for r in rows]
    share = lambda label, p: p if label == "en" else 1 - p  # noqa: E731  (of two languages)
    return [r for r, (label, p), ok in zip(rows, said, lettered, strict=True) if ok and share(label, p) >= language_id.LEAST]


def after_copies(rows):
    """The least id of each component, nulls last; documents without a shingle all stay."""
    groups: dict[int, list] = {}
    out = []
    for r, (n, root) in zip(rows, brute_components([r[1] for r in rows], 5, 80), strict=True):
        groups.setdefault(root, []).append(r) if n else out.append(r)
    return out + [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def masked(text):
    out, at = "", 0
    for start, kind, stop in all_spans(text):
        if secret_scan.KINDS[kind] in secret_scan.SHOWN:
            continue
        out += text[at:start] + "[REDACTED]" if start >= at else ""
        at = max(at, stop)
    return out + text[at:]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows, items = corpus()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def test_stages_equal_brute_force(spark, tables):
    path, rows, items = tables
    docs, want = spark.createDataFrame(rows, DOCS), rows
    leaking = lambda held: {i for i, _ in brute_leaks([(n, r[1]) for n, r in enumerate(held)], items)}
    steps = [after_language, after_copies, lambda held: [r for n, r in enumerate(held) if n not in leaking(held)], lambda held: [(r[0], masked(r[1]), *r[2:]) for r in held]]
    sizes = [len(rows)]
    for (name, stage), step in zip(corpus_pipeline.STAGES[:-1], steps, strict=True):
        docs, want = common.stored(stage(spark, docs, path), name), step(want)
        assert sorted(map(str, map(tuple, docs.collect()))) == sorted(map(str, want)), name
        sizes.append(len(want))
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == 4
    packed = corpus_pipeline.run(spark, path).collect()
    told = {r[0]: r[1] for r in want}
    assert len(told) == len(want)
    check_pieces(packed, [told.get(i, "") for i in sorted(told, key=lambda i: (i is None, i or 0))], names=sorted(told, key=lambda i: (i is None, i or 0)))


def test_odd_tables(spark, tmp_path):
    """Nulls in any column, repeated rows, ties, a very long text, columns named like the operators' own."""
    long = "bright window through the house " * 40_000
    rows = [(1, None, None), (1, None, None), (None, None, None), (None, "the house", "en"), (2, "", "en"), (3, long, "en"), (3, long, "en"), (4, "token=abcdefgh " * 3000, None)]
    docs = spark.createDataFrame([(*r, "x", 1, "y", 2, "z", 3.0) for r in rows], "doc_id long, text string, lang string, k1 string, sid int, row string, number int, base string, score double")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None), (None, "no such words"), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = common.stored(stage(spark, held, str(tmp_path)), name)
        assert held.columns == docs.columns
    left = sorted((str(r["doc_id"]), len(r["text"]), r["text"][:10]) for r in held.collect())
    assert left == [("3", len(long), "bright win"), ("4", 11 * 3000, "[REDACTED]"), ("None", 9, "the house")]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == {3, 4, None}
    for i in (3, 4, None):
        assert sum(r["length"] for r in pieces if r["doc_id"] == i) == next(r["doc_tokens"] for r in pieces if r["doc_id"] == i)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
