"""Lexical retrieval packing: a sharded BM25 index orders documents into full token windows.

Documents are tokenised once and written. Document frequencies, their number and mean length are counted over all of
them. Each document is named by its heaviest BM25 terms that another document has too, and documents are dealt to tasks
and shards in the order of these names, so documents that share their heaviest term meet at any size of the corpus.
A shard is an inverted index over token ids with the corpus's statistics; each window starts from a seed (what is left
of the last document, else the next unused one), all of whose terms query the index, and unused neighbours, best first,
fill the window greedily. The document at the window's end is cut there. A window that a shard cannot fill is carried
into the task's next shard; a task's last, partial window is cut into sequences whose lengths are powers of two, so
nothing is padded.

Defined results: null text counts as empty, and such a document is its end id alone; repeated rows are packed as often
as they occur, and a name that many rows share is dealt on by their place; an empty table gives an empty result; ties
in score go to the earlier document of the shard; other columns are ignored; a text of any length spans as many windows
as it needs, and a ``doc_id`` that is no integer is null.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, table

WINDOW = 2048
END_ID = 1
#: Token ids of a shard, about: it ends with the document that reaches them.
SHARD_IDS = 3 << 18
#: Heaviest terms in a document's name.
NAMED_BY = 4
K1, B = 1.2, 0.75

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@functools.cache
def _slow(path: str):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return model


@functools.cache
def encoder(path: str):
    """text -> array of ids, as ``tokenizers`` gives them. A plain byte-level BPE runs in the faster library, same vocabulary; a
    text that its regular expressions give up on (a run of some hundred thousand blanks) goes to the slower one."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    made = [model["vocab"].get(a + b, -1) for a, b in merges]
    level = (pre.get("type"), pre.get("use_regex"), pre.get("add_prefix_space")) == ("ByteLevel", True, False)
    plain = level and spec["normalizer"] is None and not model.get("continuing_subword_prefix") and not model.get("ignore_merges")
    ordered = all(a < b for a, b in zip([-1, *made], made, strict=False))
    simple = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"])
    if not (plain and ordered and simple):
        return lambda text: np.array(_slow(path).encode(text, add_special_tokens=False).ids, np.uint32)
    import tiktoken

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        except ValueError:
            return np.array(_slow(path).encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


@dataclass
class Corpus:
    """Statistics of all documents: their number, mean length, and the inverse document frequency of each id."""

    n: int
    mean: float
    df: np.ndarray

    @functools.cached_property
    def idf(self) -> np.ndarray:
        return np.log1p((self.n - self.df + 0.5) / (self.df + 0.5))

    def weights(self, tf: np.ndarray, terms: np.ndarray, length: np.ndarray) -> np.ndarray:
        """BM25 weight of a term that occurs ``tf`` times in a document of ``length`` ids."""
        return self.idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(self.mean, 1e-9)))


@dataclass(eq=False)
class Doc:
    doc_id: int | None
    ids: np.ndarray

    @property
    def terms(self) -> np.ndarray:
        """All but the end id."""
        return self.ids[:-1]


class Bm25:
    """Inverted index of a shard. Terms that many of its documents have are kept as dense rows, so a query of any
    number of terms is one product and some short lists."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus):
        n = self.n = len(docs)
        sizes = np.array([len(d) for d in docs])
        owner = np.repeat(np.arange(n), sizes)
        pairs, tf = np.unique(np.concatenate(docs).astype(np.int64) * n + owner, return_counts=True)
        term, self.doc = pairs // n, (pairs % n).astype(np.int32)
        self.weight = corpus.weights(tf, term, sizes[self.doc]).astype(np.float32)
        self.terms, first, df = np.unique(term, return_index=True, return_counts=True)
        self.first, self.df = first, df
        often = df * 16 > n
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        dense = np.repeat(often, df)
        self.dense = np.zeros((int(often.sum()), n), np.float32)
        self.dense[np.repeat(self.row, df)[dense], self.doc[dense]] = self.weight[dense]

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """BM25 score of every document for a query of the distinct ids."""
        asked = np.unique(ids).astype(np.int64)
        if not len(self.terms) or not len(asked):
            return np.zeros(self.n)
        at = np.minimum(np.searchsorted(self.terms, asked), len(self.terms) - 1)
        at = at[self.terms[at] == asked]
        rows = self.row[at]
        out = self.dense[rows[rows >= 0]].sum(axis=0, dtype=np.float64)
        short = at[rows < 0]
        size = self.df[short]
        place = np.arange(size.sum()) + np.repeat(self.first[short] - (np.cumsum(size) - size), size)
        return out + np.bincount(self.doc[place], weights=self.weight[place], minlength=self.n)


Piece = tuple[Doc, int, int]


class Packer:
    """Windows of one task. ``add`` takes a shard and yields the windows that it fills; ``rest`` ends the task. Each id
    of each document lies in exactly one piece."""

    def __init__(self, corpus: Corpus, window: int = WINDOW):
        self.corpus, self.window = corpus, window
        self.held: list[Piece] = []
        self.room = window
        self.left: tuple[Doc, int] | None = None

    def add(self, docs: list[Doc]) -> Iterator[list[Piece]]:
        index: Bm25 | None = None
        unused, first = np.ones(len(docs), bool), 0
        ranked: Iterator[int] | None = None
        while self.left or unused.any():
            if self.left is None:
                if not self.held:
                    while not unused[first]:
                        first += 1
                    pick = first
                else:
                    if ranked is None:
                        index = index or Bm25([d.terms for d in docs], self.corpus)
                        order = np.argsort(-index.scores(self.held[0][0].terms), kind="stable")
                        ranked = iter(order[unused[order]].tolist())
                    pick = next(i for i in ranked if unused[i])
                unused[pick] = False
                self.left = (docs[pick], 0)
            doc, start = self.left
            take = min(self.room, len(doc.ids) - start)
            self.held.append((doc, start, take))
            self.room -= take
            self.left = (doc, start + take) if start + take < len(doc.ids) else None
            if not self.room:
                yield self.held
                self.held, self.room, ranked = [], self.window, None

    def rest(self) -> Iterator[list[Piece]]:
        yield from _cut(self.held, self.window - self.room)


def _cut(pieces: list[Piece], total: int) -> Iterator[list[Piece]]:
    """The pieces dealt to sequences whose lengths are the powers of two that sum to ``total``."""
    rest = list(reversed(pieces))
    for bit in reversed(range(total.bit_length())):
        if not total >> bit & 1:
            continue
        room, held = 1 << bit, []
        while room:
            doc, start, length = rest.pop()
            take = min(room, length)
            held.append((doc, start, take))
            room -= take
            if take < length:
                rest.append((doc, start + take, length - take))
        yield held


@functools.cache
def width(path: str) -> str:
    """The narrowest number that holds every id of the vocabulary."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    most = max([END_ID, *spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    return "<u2" if most < 1 << 16 else "<u4"


def _encoded(docs: DataFrame, tokenizer: str, kind: str) -> DataFrame:
    """(doc_id, ids, place, counts): a document's ids with the end id, as numbers of the given kind, and a number of its
    row. It is written, so a task that runs again finds the same numbers. Each task adds one row of ``counts``: in how
    many of its documents each id occurs (64-bit numbers), then its documents and their ids without the end ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        df = np.zeros(0, np.int64)
        n = total = 0

        def made(names: pa.Array, ids: list[bytes | None], counts: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([names, pa.array(ids, pa.binary()), pa.array([counts] * len(ids))], ["doc_id", "ids", "counts"])

        for b in slices(batches):
            held = []
            for text in b.column("text").to_pylist():
                ids = encode(text)
                seen = np.unique(ids)
                if len(seen) and seen[-1] >= len(df):
                    df = np.concatenate([df, np.zeros(int(seen[-1]) + 1 - len(df), np.int64)])
                df[seen] += 1
                n += 1
                total += len(ids)
                held.append(np.append(ids, np.uint32(END_ID)).astype(kind).tobytes())
            yield made(b.column("doc_id"), held, False)
        yield made(pa.nulls(1, pa.int64()), [np.append(df, [n, total]).tobytes()], True)

    rows = docs.select(F.expr("try_cast(doc_id AS bigint)").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, counts boolean").withColumn("place", F.monotonically_increasing_id())


def _corpus(counts: DataFrame) -> Corpus:
    """The tasks' counts as one. What reaches the driver has a row for each id of the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(2, np.int64)
        for b in batches:
            for raw in b.column("ids").to_pylist():
                own = np.frombuffer(raw, np.int64)
                wide = np.zeros(max(len(df), len(own)), np.int64)
                for x in (df, own):
                    wide[: len(x) - 2] += x[:-2]
                    wide[-2:] += x[-2:]
                df = wide
        some = np.flatnonzero(df[:-2])
        terms, sums = np.append(some, [-1, -2]), np.append(df[some], df[-2:])
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(sums)], ["term", "n"])

    rows = counts.select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    sums = dict(zip(rows["term"].tolist(), rows["n"].tolist(), strict=True))
    n, total = sums.pop(-1, 0), sums.pop(-2, 0)
    df = np.zeros(max(sums, default=-1) + 1, np.int64)
    df[list(sums)] = list(sums.values())
    return Corpus(n, total / max(n, 1), df)


def name(ids: np.ndarray, corpus: Corpus) -> bytes:
    """A document's heaviest terms that it shares with another one, heaviest first, as bytes that sort."""
    terms, tf = np.unique(ids, return_counts=True)
    shared = corpus.df[terms] > 1
    terms, tf = terms[shared], tf[shared]
    weight = corpus.weights(tf, terms, np.float64(len(ids)))
    return terms[np.argsort(-weight, kind="stable")[:NAMED_BY]].astype(">u4").tobytes()


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, shard_ids: int = SHARD_IDS) -> DataFrame:
    """One row per piece (``PIECES``). ``sequence_id`` holds the task's number in its upper 32 bits."""
    spark, kind = docs.sparkSession, width(tokenizer)
    encoded = stored(_encoded(docs, tokenizer, kind), "packing-ids", "counts")
    shared = spark.sparkContext.broadcast(_corpus(encoded.where("counts")))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus = shared.value
        for b in slices(batches):
            names = [name(np.frombuffer(raw, kind)[:-1], corpus) for raw in b.column("ids").to_pylist()]
            yield b.append_column("name", pa.array(names, pa.binary()))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number = Packer(shared.value, window), TaskContext.get().partitionId() << 32
        held: list[Doc] = []
        size = 0

        def written(sequences: Iterator[list[Piece]]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            out: list[list[int | None]] = [[] for _ in range(7)]
            for sequence in sequences:
                offset = 0
                for doc, start, length in sequence:
                    crc = zlib.crc32(doc.ids[start : start + length].astype("<u4").tobytes())
                    for column, value in zip(out, (doc.doc_id, start, length, crc, len(doc.ids), number, offset), strict=True):
                        column.append(value)
                    offset += length
                number += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], [c.split()[0] for c in PIECES.split(", ")])

        for b in slices(batches):
            for doc_id, raw in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
                held.append(Doc(doc_id, np.frombuffer(raw, kind)))
                size += len(held[-1].ids)
                if size >= shard_ids:
                    yield from written(packer.add(held))
                    held, size = [], 0
        yield from written(packer.add(held))
        yield from written(packer.rest())

    rows = encoded.where("NOT counts").select("doc_id", "ids", "place").mapInArrow(named, "doc_id long, ids binary, place long, name binary")
    # The row's place keeps a name that many rows share from filling one task.
    dealt = rows.repartitionByRange("name", "place").sortWithinPartitions("name", "place")
    return dealt.select("doc_id", "ids").mapInArrow(fill, PIECES)


def op3_lexical_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
