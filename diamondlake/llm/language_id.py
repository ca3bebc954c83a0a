"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of one to three characters per label, each task summing its own rows before the shuffle. Every
label is learnt. The log-probability matrix (buckets x labels) is broadcast, ``LABELS`` labels at a time: so many are
the bound of what is sent, and a corpus of more labels takes a pass over its texts for each such part, whose results
are joined by the probabilities' sums. Texts are scored whole, in numpy, by gathering matrix rows for all n-grams of a
block and summing them per text.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is everything when no row can be
learnt from. Ties go to the label that sorts first. Null labels are not learnt. A null ``doc_id`` counts as the empty
text for the split. Repeated rows come back as often. Other columns are ignored, or passed through by ``identified``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, table, unused_name

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Labels whose columns are broadcast together, and are counted together by a task: 17 MB.
LABELS = 64
ALPHA = 0.5
#: Characters in one numpy block; a longer text is cut into pieces that overlap by the longest n-gram less one.
BLOCK = 1 << 18
#: Matrix cells gathered at once.
CELLS = 1 << 21
UND = "und"
#: What the pipeline keeps: texts that may be in one of these languages, if it learnt any of them, with at least this
#: probability. A text must be clearly of another language to go.
WANTED, LEAST = ("en",), 0.1


def _fold() -> np.ndarray:
    """ASCII characters that are not letters become blanks."""
    table_ = np.arange(128, dtype=np.uint32)
    return np.where([chr(i).isalpha() for i in range(128)], table_, 32).astype(np.uint32)


_ASCII = _fold()


def blocks(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(code points, text index of each piece, piece starts, n-gram starts in each piece)."""
    pieces: list[str] = []
    owner: list[int] = []
    own: list[int] = []
    held = 0

    def out():
        points = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        low = points < 128
        points[low] = _ASCII[points[low]]
        sizes = np.array([len(p) for p in pieces])
        return points, np.array(owner), np.concatenate([[0], np.cumsum(sizes)]), np.array(own)

    reach = max(ORDERS) - 1
    for i, t in enumerate(texts):
        t = t.lower()
        for at in range(0, len(t), BLOCK):
            piece = t[at : at + BLOCK + reach]
            pieces.append(piece)
            owner.append(i)
            own.append(min(BLOCK, len(t) - at))
            held += len(piece)
            if held >= BLOCK:
                yield out()
                pieces, owner, own, held = [], [], [], 0
    if pieces:
        yield out()


def grams(points: np.ndarray, starts: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per order: bucket of the n-gram at each position, and whether it lies in its piece and belongs to it."""
    size = np.diff(starts)
    place = np.arange(len(points)) - np.repeat(starts[:-1], size)
    left, mine = np.repeat(size, size) - place, place < np.repeat(own, size)
    wide = points.astype(np.uint64)
    state = np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        moved = np.zeros(len(points), np.uint64)
        moved[: len(points) - n + 1] = wide[n - 1 :]
        state = (state * np.uint64(0x100000001B3)) ^ (moved + np.uint64(n))
        if n in ORDERS:
            mixed = state * np.uint64(0x9E3779B97F4A7C15)
            yield (mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), mine & (left >= n)


def count_grams(labelled: DataFrame) -> DataFrame:
    """(label, text) -> (label, bucket, n); bucket -1 counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for label, total in sums.items():
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([label] * len(some), pa.string()), pa.array(np.where(some == BUCKETS, -1, some)), pa.array(total[some])],
                    ["label", "bucket", "n"],
                )
            sums.clear()

        for b in slices(batches):
            by: dict[str, list[str]] = {}
            for label, text in zip(b.column("label").to_pylist(), b.column("text").to_pylist(), strict=True):
                by.setdefault(label, []).append(text)
            for label, texts in by.items():
                if label not in sums and len(sums) == LABELS:
                    yield from out()
                total = sums.setdefault(label, np.zeros(BUCKETS + 1, np.int64))
                total[BUCKETS] += len(texts)
                for points, _, starts, own in blocks(texts):
                    for bucket, valid in grams(points, starts, own):
                        total[:BUCKETS] += np.bincount(bucket[valid], minlength=BUCKETS)
        yield from out()

    counted = labelled.select("label", "text").mapInArrow(run, "label string, bucket long, n long")
    return counted.groupBy("label", "bucket").agg(F.sum("n").alias("n"))


#: Labels in order, and the matrix [bucket, label] of log probabilities with the log priors as its last row.
Part = tuple[list[str], np.ndarray]


def train(labelled: DataFrame, at_once: int = LABELS) -> list[Part]:
    """The model in parts of at most ``at_once`` labels, in the order of labels. Every labelled row is counted; a part's
    counts, at most its labels x buckets rows, reach the driver at a time."""
    counts = stored(count_grams(labelled), "language-counts")
    sizes = counts.where("bucket = -1").orderBy("label").select("label", "n").toPandas()
    labels, texts = sizes["label"].tolist(), sizes["n"].to_numpy(float)
    parts: list[Part] = []
    for lo in range(0, len(labels), at_once):
        own = labels[lo : lo + at_once]
        held = counts.where(F.col("label").isin(own) & (F.col("bucket") >= 0)).toPandas()
        matrix = np.zeros((BUCKETS + 1, len(own)))
        matrix[held["bucket"].to_numpy(np.int64), held["label"].map({x: i for i, x in enumerate(own)}).to_numpy(np.int64)] = held["n"].to_numpy()
        seen = matrix[:-1].sum(axis=0)
        matrix[:-1] = np.log((matrix[:-1] + ALPHA) / (seen + ALPHA * BUCKETS))
        matrix[-1] = np.log(texts[lo : lo + at_once] / texts.sum())
        parts.append((own, matrix))
    return parts


def log_joint(texts: list[str], matrix: np.ndarray) -> np.ndarray:
    """[text, label]: log prior and log probability of all n-grams of the text."""
    total = np.repeat(matrix[-1][None, :], len(texts), axis=0)
    if not matrix.shape[1]:
        return total
    step = max(1, CELLS // matrix.shape[1])
    for points, owner, starts, own in blocks(texts):
        whole = np.repeat(owner, np.diff(starts))
        for bucket, valid in grams(points, starts, own):
            for lo in range(0, len(bucket), step):
                some = slice(lo, lo + step)
                rows = matrix[np.where(valid[some], bucket[some], 0)] * valid[some, None]
                turns = np.flatnonzero(np.diff(whole[some], prepend=-1))
                np.add.at(total, whole[some][turns], np.add.reduceat(rows, turns, axis=0))
    return total


STATE = "best double, label string, every double, wanted double, lettered boolean"


def _joined(state: pd.DataFrame | None, texts: list[str], labels: list[str], joint: np.ndarray, wanted: frozenset[str]) -> pd.DataFrame:
    """The best label and log sums over all labels and the wanted ones, of this part and those before it."""
    if state is None:
        low = np.full(len(joint), -np.inf)
        lettered = np.fromiter((any(map(str.isalpha, t)) for t in texts), bool, len(texts))
        state = pd.DataFrame({"best": low, "label": None, "every": low, "wanted": low, "lettered": lettered})
    if not labels:
        return state
    at = joint.argmax(axis=1)
    top = joint[np.arange(len(joint)), at]
    better = top > state["best"].to_numpy(float)
    mine = np.array([x in wanted for x in labels])
    over = lambda x: np.logaddexp.reduce(x, axis=1) if x.shape[1] else np.full(len(x), -np.inf)
    return pd.DataFrame(
        {
            "best": np.where(better, top, state["best"].to_numpy(float)),
            "label": np.where(better, np.array(labels, object)[at], state["label"].to_numpy(object)),
            "every": np.logaddexp(state["every"].to_numpy(float), over(joint)),
            "wanted": np.logaddexp(state["wanted"].to_numpy(float), over(joint[:, mine])),
            "lettered": state["lettered"].to_numpy(bool),
        }
    )


def _part_scores(spark, part: Part, wanted: frozenset[str], first: bool):
    shared = spark.sparkContext.broadcast(part)

    def of(text: pd.Series, state: pd.DataFrame | None) -> pd.DataFrame:
        labels, matrix = shared.value
        found = []
        for lo in range(0, len(text), 512):
            own = slice(lo, lo + 512)
            texts = text.iloc[own].tolist()
            found.append(_joined(None if state is None else state.iloc[own], texts, labels, log_joint(texts, matrix), wanted))
        return pd.concat(found, ignore_index=True) if found else _joined(None, [], [], np.zeros((0, 0)), wanted)

    if first:

        @F.pandas_udf(STATE)
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for text in parts:
                yield of(text, None)
    else:

        @F.pandas_udf(STATE)
        def run(parts: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
            for text, state in parts:
                yield of(text, state)

    return run


def with_language(docs: DataFrame, model: list[Part], into: str, wanted: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` and a struct column ``into``: lang_pred, score (its probability) and wanted (that of the wanted labels
    together, 1 where no such label is in the model; both 0 for a text without a letter)."""
    spark, text = docs.sparkSession, F.coalesce(F.col("text"), F.lit(""))
    named = frozenset(wanted)
    known = any(x in named for labels, _ in model for x in labels)
    state = unused_name([*docs.columns, into], "state")
    # A model of nothing is one part without labels.
    parts = model or [([], np.zeros((BUCKETS + 1, 0)))]
    for i, part in enumerate(parts):
        run = _part_scores(spark, part, named, not i)
        docs = docs.withColumn(state, run(text) if not i else run(text, F.col(state)))
        docs = stored(docs, "language-part") if i + 1 < len(parts) else docs
    lettered = F.col(state)["lettered"]
    share = lambda c: F.least(F.exp(F.col(state)[c] - F.col(state)["every"]), F.lit(1.0))
    found = F.struct(
        F.when(lettered & F.col(state)["label"].isNotNull(), F.col(state)["label"]).otherwise(UND).alias("lang_pred"),
        F.when(lettered & F.col(state)["label"].isNotNull(), share("best")).otherwise(0.0).alias("score"),
        F.when(lettered, share("wanted") if known else F.lit(1.0)).otherwise(0.0).alias("wanted"),
    )
    return docs.withColumn(into, found).drop(state)


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that may be learnt from: the split is by ``doc_id`` alone."""
    return docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").alias("label"), "text")


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identified(docs: DataFrame, wanted: tuple[str, ...] = WANTED, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` whose text is in a wanted language with probability ``least`` or more, with their columns as
    they were. Texts without a letter go. Where the model knows no wanted language (nothing is labelled, say), all others
    stay, as there is nothing to reject them by."""
    into = unused_name(docs.columns, "language")
    said = with_language(docs, train(training_rows(docs)), into, wanted)
    return said.where((F.col(into)["wanted"] >= least) & (F.col(into)["wanted"] > 0)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    said = with_language(docs, train(training_rows(docs)), "p")
    return said.select("doc_id", held_out().alias("held_out"), "p.lang_pred", "p.score")
