"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages of at most 32 words. Passages are TF-IDF vectors (a word counts once, document
frequencies over all documents); a randomised SVD of each block of ``RANK`` passages, one task a block, gives a latent
space into which passages and the regions of every document are folded. A region is a candidate for a passage if its
cosine reaches ``WEIGHT`` |p| / |x|, for their lengths |p| and |x| there: then it may hold that share of the passage's
squared weight, which a leak must. A block has no more passages than the space has dimensions, so the space is full:
the projection onto it changes no product with a passage, and the search misses no region that holds the share. What
the projection saves is size: a region is ``RANK`` numbers a block, whatever the vocabulary.

The longest common subsequence of words then decides, and for paraphrases the item's answer (its last words) too. A
region is twice as long as a window that holds the passage, and regions begin at every half of a window.

Defined results: null or wordless texts and items match nothing; repeated rows come back once a pair (doc_id, item);
equal items each have their row; of regions that match equally well the first is reported; texts and items of any length
are cut in passages and regions, none is dropped; empty tables give an empty result; other columns are ignored. Words
are runs of characters other than ASCII punctuation and white space, lower-cased. What is broadcast has a bound: the
passages of a pass (``PASSES``) with their vectors, at most 33 MB, or ``TERMS`` words whose documents are counted; a
larger benchmark takes more passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, row_key, slices, stored, table, unused_name
from .shingles import PUNCTUATION, word_hashes

WINDOW, STRIDE = 32, 16
#: Passages of a block, and dimensions of its latent space; passages of a pass over the documents, about.
RANK, PASSES = 128, 2048
OVERSAMPLE, POWER, SEED = 8, 2, 7
#: Words whose documents are counted in one pass.
TERMS = 1 << 22
#: Share of a passage's squared TF-IDF weight that a leak must hold.
WEIGHT = 0.4
SAME, PARAPHRASE, ANSWER_WORDS, ANSWER = 0.8, 0.6, 5, 0.6
#: Items of fewer words must occur whole.
SHORT = 8
#: A term of more than this share of the documents is left out, but for a passage's rarest ``KEPT``.
COMMON, KEPT = 0.1, 8

PASSAGE = "number long, at int, words binary, length int, answer binary"
FOUND = "number long, cosine double, overlap double, answered boolean, at long"


def words(text: str) -> np.ndarray:
    return word_hashes(text.lower(), PUNCTUATION)


def passages(w: np.ndarray) -> list[np.ndarray]:
    """Windows over an item's words; the last one ends with the item."""
    last = max(0, len(w) - WINDOW)
    return [w[i : i + WINDOW] for i in [*range(0, last, STRIDE), last]] if len(w) else []


def stride(passage: np.ndarray) -> int:
    """Half of a window that is as long as the passage, or up to twice as long: a power of two."""
    return min(STRIDE, 1 << max(0, (len(passage) - 1).bit_length() - 1))


@dataclass
class Passage:
    number: int
    words: np.ndarray
    length: int
    answer: np.ndarray

    @property
    def least(self) -> float:
        """The share of its words, in order, that a leak of this passage has at least."""
        return 1.0 if self.length < SHORT else PARAPHRASE


@dataclass
class Block:
    """Passages of one stride. ``local`` maps the pass's terms to the block's own (-1: none); ``squares`` has their
    squared weights, ``vectors`` their weighted latent vectors; ``folded`` and ``norms`` are those of the passages."""

    stride: int
    passages: list[Passage]
    weights: list[tuple[np.ndarray, np.ndarray]]
    local: np.ndarray
    squares: np.ndarray
    vectors: np.ndarray
    folded: np.ndarray
    norms: np.ndarray


@dataclass
class Space:
    """The terms of a pass, sorted, and its blocks."""

    terms: np.ndarray
    blocks: list[Block]


def _passage_rows(benchmark: DataFrame) -> DataFrame:
    """``PASSAGE`` rows of (number, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[list] = [[], [], [], [], []]
            for number, text in zip(b.column("number").to_pylist(), b.column("text").to_pylist(), strict=True):
                w = words(text)
                for at, p in enumerate(passages(w)):
                    for column, x in zip(out, (number, at, p.tobytes(), len(w), w[-ANSWER_WORDS:].tobytes()), strict=True):
                        column.append(x)
            types = (pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], [c.split()[0] for c in PASSAGE.split(", ")])

    return benchmark.select("number", "text").mapInArrow(run, PASSAGE)


def _terms(cut: DataFrame) -> DataFrame:
    """The distinct words of passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = np.unique(np.frombuffer(b"".join(b.column("words").to_pylist()), np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(every.view(np.int64))], ["term"])

    return cut.select("words").mapInArrow(run, "term long").distinct()


def _frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): in how many documents each term occurs; a null term has the number of documents. All terms are counted
    in one pass over the documents, or one for every ``TERMS`` of them."""
    n = terms.count()
    parts = max(1, -(-n // TERMS))
    out = None
    for part in range(parts):
        held = terms.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == part).toPandas()["term"].to_numpy(np.int64)
        shared = docs.sparkSession.sparkContext.broadcast(np.sort(held.view(np.uint64)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known, n = shared.value, 0
            counts = np.zeros(len(known), np.int64)
            for b in slices(batches):
                for t in b.column("text").to_pylist():
                    n += 1
                    w = words(t)
                    if len(known) and len(w):
                        at = np.minimum(np.searchsorted(known, w), len(known) - 1)
                        counts[np.unique(at[known[at] == w])] += 1
            some = np.flatnonzero(counts)
            found = pa.array(np.append(known[some].view(np.int64), 0), mask=np.append(np.zeros(len(some), bool), True))
            yield pa.RecordBatch.from_arrays([found, pa.array(np.append(counts[some], n))], ["term", "n"])

        counted = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        counted = counted if not part else counted.where("term IS NOT NULL")
        out = counted if out is None else out.unionByName(counted)
    return out


def randomised_svd(matrix: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors [columns, rank or fewer]: the range of a random block of columns, sharpened by powers."""
    width = min(*matrix.shape, rank + OVERSAMPLE)
    basis = np.linalg.qr(matrix.T @ np.random.default_rng(SEED).standard_normal((matrix.shape[0], width)))[0]
    for _ in range(POWER):
        basis = np.linalg.qr(matrix.T @ (matrix @ basis))[0]
    _, _, right = np.linalg.svd(matrix @ basis, full_matrices=False)
    return (basis @ right.T)[:, :rank]


def _latent(rows: DataFrame) -> dict[int, np.ndarray]:
    """Right singular vectors of each block's matrix, of (block, row, column, weight, columns) cells: one task a block,
    whose size is bounded by its passages."""

    def solve(cells: pd.DataFrame) -> pd.DataFrame:
        matrix = np.zeros((int(cells["row"].max()) + 1, int(cells["columns"].iloc[0])))
        matrix[cells["row"], cells["column"]] = cells["weight"]
        right = randomised_svd(matrix, RANK).astype(np.float32)
        return pd.DataFrame({"block": [cells["block"].iloc[0]], "rank": [right.shape[1]], "vectors": [right.tobytes()]})

    found = rows.groupBy("block").applyInPandas(solve, "block int, rank int, vectors binary").collect()
    return {r["block"]: np.frombuffer(r["vectors"], np.float32).reshape(-1, r["rank"]) for r in found}


def build_space(spark, held: list[Passage], terms: np.ndarray, df: np.ndarray, n: int) -> Space:
    """The latent spaces of a pass's passages; ``df`` counts the documents, of ``n``, that have each of the terms."""
    idf = np.log1p(n / (df + 0.5))
    used = df <= COMMON * max(n, 1)
    own = [np.searchsorted(terms, np.unique(p.words)) for p in held]
    for at in own:
        used[at[np.argsort(-idf[at], kind="stable")[:KEPT]]] = True
    own = [at[used[at]] for at in own]
    classes: dict[int, list[int]] = {}
    for i, p in enumerate(held):
        classes.setdefault(stride(p.words), []).append(i)
    parts = [(step, of[lo : lo + RANK]) for step, of in sorted(classes.items()) for lo in range(0, len(of), RANK)]
    cells, mine = [], []
    for number, (_, of) in enumerate(parts):
        columns = np.unique(np.concatenate([own[i] for i in of]))
        mine.append(columns)
        for row, i in enumerate(of):
            at = np.searchsorted(columns, own[i])
            cells.append(pd.DataFrame({"block": number, "row": row, "column": at, "weight": idf[own[i]], "columns": len(columns)}))
    schema = "block int, row int, column int, weight double, columns int"
    right = _latent(spark.createDataFrame(pd.concat(cells, ignore_index=True), schema)) if cells else {}
    blocks = []
    for number, (step, of) in enumerate(parts):
        columns = mine[number]
        local = np.full(len(terms), -1, np.int32)
        local[columns] = np.arange(len(columns))
        vectors = idf[columns][:, None] * right[number]
        folded = np.stack([vectors[np.searchsorted(columns, own[i])].sum(axis=0) for i in of])
        weights = [(terms[own[i]], idf[own[i]] ** 2) for i in of]
        norms = np.array([w.sum() for _, w in weights])
        blocks.append(Block(step, [held[i] for i in of], weights, local, idf[columns] ** 2, vectors.astype(np.float32), folded.astype(np.float32), norms))
    return Space(terms, blocks)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        hit = row & masks.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _candidates(block: Block, term: np.ndarray, doc: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    """(document, region, passage, cosine) of all regions that may hold the least share of a passage's weight; the hits
    are the block's ``term``s in ``doc`` at word ``place``. Region w spans the steps w - 1 to w + 2."""
    step = place // block.stride
    steps = int(step.max()) + 4
    least = WEIGHT * block.norms.min() * (1 - 1e-3)
    within = step[:, None] + np.array([1, 0, -1, -2])
    region = (doc[:, None] * steps + within)[within >= 0]
    term = np.repeat(term, (within >= 0).sum(axis=1))
    # No region whose words together weigh too little can hold the share, counted with repeats or without.
    names, region = np.unique(region, return_inverse=True)
    heavy = np.bincount(region, weights=block.squares[term]) >= least
    pairs = np.unique((region * len(block.squares) + term)[heavy[region]])
    region, term = pairs // len(block.squares), pairs % len(block.squares)
    first = np.flatnonzero(np.diff(region, prepend=-1))
    if not len(first):
        return
    weight = np.add.reduceat(block.squares[term], first)
    sizes = np.diff(np.append(first, len(region)))
    strong = weight >= least
    term, sizes, names = term[np.repeat(strong, sizes)], sizes[strong], names[region[first]][strong]
    ends = np.cumsum(sizes)
    for lo in range(0, len(names), 2048):
        own = slice(lo, min(lo + 2048, len(names)))
        begin = int(ends[lo] - sizes[lo])
        x = np.add.reduceat(block.vectors[term[begin : int(ends[own.stop - 1])]], ends[own] - sizes[own] - begin, axis=0)
        product = x @ block.folded.T
        length = np.linalg.norm(x, axis=1)
        for r, p in zip(*np.nonzero(product >= WEIGHT * block.norms[None, :] * (1 - 1e-3)), strict=True):
            k = int(names[lo + r])
            yield k // steps, k % steps, int(p), float(product[r, p] / max(length[r] * np.sqrt(block.norms[p]), 1e-12))


def judged(p: Passage, weights: tuple[np.ndarray, np.ndarray], doc: np.ndarray, begin: int, step: int) -> tuple[float, bool] | None:
    """(overlap, answered) if the region of four steps from ``begin`` leaks the passage."""
    region = doc[max(0, begin) : begin + 4 * step]
    terms, weight = weights
    if weight[np.isin(terms, region)].sum() < WEIGHT * weight.sum() or np.isin(p.words, region).mean() < p.least:
        return None
    overlap = common_subsequence(p.words, region) / len(p.words)
    near = doc[max(0, begin) : begin + 3 * step + p.length]
    answered = common_subsequence(p.answer, near) >= ANSWER * len(p.answer)
    return (overlap, answered) if overlap >= max(p.least, 0 if answered else SAME) else None


def matches(space: Space, docs: list[np.ndarray]) -> dict[tuple[int, int], tuple[float, float, bool, int]]:
    """(document, item) -> best (overlap, cosine, answered, first word of the region's window)."""
    best: dict[tuple[int, int], tuple[float, float, bool, int]] = {}
    every, sizes = np.concatenate(docs), np.array([len(d) for d in docs])
    if not len(every) or not len(space.terms):
        return best
    at = np.minimum(np.searchsorted(space.terms, every), len(space.terms) - 1)
    hit = np.flatnonzero(space.terms[at] == every)
    doc = np.repeat(np.arange(len(docs)), sizes)[hit]
    place = hit - (np.cumsum(sizes) - sizes)[doc]
    for block in space.blocks:
        term = block.local[at[hit]]
        mine = term >= 0
        if not mine.any():
            continue
        for d, region, number, cosine in _candidates(block, term[mine], doc[mine], place[mine]):
            p = block.passages[number]
            found = judged(p, block.weights[number], docs[d], (region - 1) * block.stride, block.stride)
            if found:
                new = (found[0], cosine, found[1], region * block.stride)
                old = best.get((d, p.number))
                if old is None or (new[:3], -new[3]) > (old[:3], -old[3]):
                    best[d, p.number] = new
    return best


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, cosine, overlap, answered, at`` for each document and item that it holds, (doc_id, text)
    against (item_id, text). ``at`` is the first word of the closest window."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    named = benchmark.select("item_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    named = stored(named.withColumn("number", F.monotonically_increasing_id()), "leak-items")
    cut = stored(_passage_rows(named), "leak-passages")
    terms = stored(_terms(cut), "leak-terms")
    counts = stored(_frequencies(rows, terms), "leak-frequencies")
    n = (counts.where("term IS NULL").first() or [0, 0])[1]
    passes = max(1, -(-cut.count() // PASSES))
    kind = f"doc_id {dict(rows.dtypes)['doc_id']}, {FOUND}"
    out = spark.createDataFrame([], kind)
    for i in range(passes):
        own = cut.where(F.pmod(F.xxhash64("number", "at"), F.lit(passes)) == i)
        read = lambda raw: np.frombuffer(raw, np.uint64)
        held = [Passage(r["number"], read(r["words"]), r["length"], read(r["answer"])) for r in own.orderBy("number", "at").collect()]
        if not held:
            continue
        known = _terms(own).join(counts, "term", "left").toPandas()
        hashes = known["term"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(hashes)
        space = build_space(spark, held, hashes[order], known["n"].fillna(0).to_numpy(np.int64)[order], n)
        shared = spark.sparkContext.broadcast(space)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, 128):
                found = matches(shared.value, [words(t) for t in part.column("text").to_pylist()])
                keys, values = list(found), list(found.values())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array([d for d, _ in keys], pa.int64())),
                        pa.array([number for _, number in keys], pa.int64()),
                        pa.array([v[1] for v in values], pa.float64()),
                        pa.array([v[0] for v in values], pa.float64()),
                        pa.array([bool(v[2]) for v in values], pa.bool_()),
                        pa.array([v[3] for v in values], pa.int64()),
                    ],
                    ["doc_id", "number", "cosine", "overlap", "answered", "at"],
                )

        out = out.unionByName(rows.mapInArrow(run, kind))
    forget(terms)
    best = F.max(F.struct("overlap", "cosine", "answered", (-F.col("at")).alias("back"))).alias("x")
    joined = out.groupBy("doc_id", "number").agg(best).join(named.select("number", "item_id"), "number")
    return joined.select("doc_id", "item_id", "x.cosine", "x.overlap", "x.answered", (-F.col("x.back")).alias("at"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns as they were. Rows go by id and text, so
    that a leak takes no other row with its id, or without one."""
    mark = unused_name(docs.columns, "leak")
    keyed = docs.withColumn(mark, row_key("doc_id", "text"))
    leaks = stored(find_leaks(keyed.select(F.col(mark).alias("doc_id"), "text"), benchmark).select("doc_id").distinct(), "leaks")
    return keyed.join(leaks.select(F.col("doc_id").alias(mark)), mark, "left_anti").drop(mark)


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (table(spark, sf_dir, n) for n in ("documents", "benchmark"))
    return find_leaks(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))
