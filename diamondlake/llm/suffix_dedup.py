"""Exact removal of byte strings that occur more than once, by a Burrows-Wheeler transform in shards.

Every 200-byte window of a text is assigned to one anchor, the leftmost k-mer in it with the least hash. Equal windows
have equal anchors, so windows need comparing only within an anchor hash. Neighbouring windows of one anchor form a
segment. Hashes seen once are dropped; where all segments of a hash are equal, all their windows repeat. The other
hashes are dealt to shards: a shard's segments, one of each content, are joined to one text, its transform is built,
and intervals are extended backwards, breadth first, which sets the common prefix of neighbouring suffixes by rising
value and stops at the minimum length: what is then unset, repeats.

Bytes that no other segment of the hash shares, counted from the anchor to either side, lie in no repeated window and
are left out of the shard's text.

A hash with more than ``GROUP`` different segments does not fit one shard. Its windows are taken apart by how far they
reach to the left of the anchor, in steps of ``STEPS`` bytes: all windows of a step have a middle part in common, so
equal ones have equal middles, and the segments' clips are dealt by the digest of their middle. Clips of one middle are
again settled by equality or go to a shard; those still too many are taken apart by the next, finer step, down to the
window itself, whose clips are all equal. No group is gathered, and all that is not equal outright meets the transform.

Defined results: null text counts as empty and nothing is removed from it; texts shorter than the minimum are kept;
equal rows are different documents and lose each other's strings; an empty table gives an empty result; other columns
are ignored; a null ``doc_id`` is an id like any other.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, slices, stored, table

LENGTH = 200
KMER = 32
#: Different segments of one anchor hash that a shard takes at most.
GROUP = 4096
#: Widths of the steps in which larger groups are taken apart. The last one leaves one window a clip.
STEPS = (24, 4, 1)
#: Bytes of a shard's text, about.
SHARD_BYTES = 1 << 20
#: Bytes in no UTF-8 text: between segments, and at a shard's end.
BETWEEN, END = 0xFF, 0xFE

#: Texts handled together.
ROWS = 256
ANCHORS = "h long, sd long, k1 long, k2 long, span long"


def anchors(text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, number of windows) of each anchor; the windows are dealt to them without a gap."""
    starts = len(text) - length + 1
    if starts < 1:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none
    factor = np.array([0xBF58476D1CE4E5B9], np.uint64)
    x = (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    span = 1
    while span < KMER:
        x = x[:-span] * factor + x[span:]
        x ^= x >> np.uint64(31)
        factor = factor * np.uint64(0x94D049BB133111EB) | np.uint64(1)
        span *= 2
    x *= np.uint64(0x9E3779B97F4A7C15)
    wide, least, span = length - KMER + 1, x, 1
    while span * 2 <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:starts], least[wide - span :][:starts])
    # The same least hash may belong to two k-mers in turn: the window where the first one leaves starts an anchor.
    first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (least[:-1] == x[: starts - 1])]))
    found = least[first]
    low = np.flatnonzero(x <= found.max())
    low = low[np.argsort(x[low], kind="stable")]
    at = np.searchsorted(x[low], found)
    while (early := low[at] < first).any():
        at += early
    return found, low[at], first, np.diff(np.append(first, starts))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _anchored(docs: DataFrame, length: int) -> DataFrame:
    """(k1, k2, text) -> one row per anchor; ``span`` holds its first window, their number and its place in the first
    window (10 bits each for the last two)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, ROWS):
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for k1, k2, t in zip(*(part.column(c).to_pylist() for c in ("k1", "k2", "text")), strict=True):
                raw = t.encode()
                h, place, first, n = anchors(np.frombuffer(raw, np.uint8), length)
                ends = first + n + length - 1
                sd = [xxhash.xxh3_64_intdigest(raw[i:j]) for i, j in zip(first.tolist(), ends.tolist(), strict=True)]
                for column, x in zip(out, (_signed(h), _signed(np.array(sd, np.uint64)), np.full(len(h), k1), np.full(len(h), k2), first << 20 | n << 10 | place - first), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], ["h", "sd", "k1", "k2", "span"])

    return docs.select("k1", "k2", "text").mapInArrow(run, ANCHORS)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start of each suffix in order, by prefix doubling; the text ends with a byte that occurs nowhere else."""
    n = len(text)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key <<= np.uint64(8)
        key[: n - i] |= text[i:]
    order = np.argsort(key).astype(np.int32)
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    del key
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    reach = 8
    while True:
        open_ = np.flatnonzero(~(new & np.append(new[1:], True))).astype(np.int32)
        if not len(open_):
            return order
        at = order[open_]
        after = at + reach
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        both = rank[at].astype(np.int64) << 32 | second
        by = np.argsort(both)
        at, both = at[by], both[by]
        order[open_] = at
        fresh = np.concatenate([[True], both[1:] != both[:-1]])
        new[open_] = fresh
        rank[at] = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(at), dtype=np.int32), 0))]
        reach *= 2


def repeated(text: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each position whether its next ``length`` bytes start elsewhere too.

    ``edge[i]`` says that suffixes i-1 and i differ within the bytes read so far. A level's intervals hold the suffixes
    that share a prefix of its size; the bytes before them extend each interval, and an extension whose right edge was
    not known is one of the next level.
    """
    order = suffix_order(text)
    n = len(text)
    bwt = text[order - 1]
    by_byte = np.argsort(bwt, kind="stable").astype(np.int32)
    step = np.empty(n, np.int32)
    step[by_byte] = np.arange(n, dtype=np.int32)
    column = bwt[by_byte]
    turn = np.concatenate([[True], column[1:] != column[:-1], [True]])
    edge = np.zeros(n + 1, bool)
    edge[[0, n]] = True
    owner = np.full(n + 2, -1, np.int32)
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        size = high - low
        place = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        to = step[place]
        owner[to + 1] = np.repeat(np.arange(len(low)), size)
        mine = owner[to + 1]
        last = np.sort(to[(owner[to + 2] != mine) | turn[to + 1]]) + 1
        first = np.sort(to[(owner[to] != mine) | turn[to]])
        owner[to + 1] = -1
        news = ~edge[last]
        if not size.sum() or not (news.any() or len(low) == 1 and size[0] == n):
            break
        edge[last] = True
        low, high = first[news], last[news]
        if not len(low):
            break
    found = np.zeros(n, bool)
    found[order] = ~edge[:-1] | ~edge[1:]
    return found


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "little") ^ int.from_bytes(b[:n], "little")
    return ((differ & -differ).bit_length() - 1) // 8


def _reaches(sides: list[bytes]) -> list[int]:
    """For each string the longest prefix that it shares with another one."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    out = [0] * len(sides)
    for i, j in itertools.pairwise(order):
        n = _shared(sides[i], sides[j])
        out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


def trimmed(group: list[tuple[int, int, bytes, int]], length: int) -> Iterator[tuple[int, int, bytes, int, int]]:
    """Segments of one hash without the bytes that cannot lie in a repeated window: (h, sd, bytes, windows cut off in
    front, windows in all). Those with no possible window are left out."""
    left = _reaches([s[:at][::-1] for _, _, s, at in group])
    right = _reaches([s[at:] for _, _, s, at in group])
    for (h, sd, s, at), a, b in zip(group, left, right, strict=True):
        if a + b >= length:
            yield h, sd, s[at - a : at + b], at - a, len(s) - length + 1


def _shards(segments: DataFrame, length: int) -> DataFrame:
    """(h, sd, segment, place), one row per content -> (h, sd, mask): a bit for each window that repeats in its hash;
    no row where none does."""

    def solve(held: list[tuple[int, int, bytes, int, int]]) -> pa.RecordBatch:
        text = np.frombuffer(bytes([BETWEEN]).join(x[2] for x in held) + bytes([BETWEEN, END]), np.uint8)
        flags = repeated(text, length)
        rows, at = [], 0
        for h, sd, s, cut, windows in held:
            own = flags[at : at + len(s) - length + 1]
            if own.any():
                mask = np.zeros(windows, bool)
                mask[cut : cut + len(own)] = own
                rows.append((h, sd, np.packbits(mask).tobytes()))
            at += len(s) + 1
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, ["h", "sd", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple[int, int, bytes, int]] = []
        held: list[tuple[int, int, bytes, int, int]] = []
        size = 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("h", "sd", "segment", "place")), strict=True):
                if group and row[0] != group[-1][0]:
                    held += (new := list(trimmed(group, length)))
                    size += sum(len(x[2]) + 1 for x in new)
                    group = []
                    if size > SHARD_BYTES:
                        yield solve(held)
                        held, size = [], 0
                group.append(row)
        held += trimmed(group, length)
        if held:
            yield solve(held)

    dealt = segments.select("h", "sd", "segment", "place").repartition("h").sortWithinPartitions("h", "sd")
    return dealt.mapInArrow(run, "h long, sd long, mask binary")


CLIPS = "h long, sd long, segment binary, place int, h0 long, sd0 long, first int, windows int"


def _clips(segments: DataFrame, width: int, length: int) -> DataFrame:
    """Segments taken apart: those windows that reach from ``at`` up to ``at + width`` bytes to the left of the anchor
    are a clip. ``h`` is the digest of the bytes that all of them have, ``first`` the clip's first window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, ROWS):
            out: list[list] = [[] for _ in range(8)]
            for h0, sd0, s, place in zip(*(b.column(c).to_pylist() for c in ("h", "sd", "segment", "place")), strict=True):
                most = len(s) - length
                for at in range(0, length - KMER + 1, width):
                    first, last = max(0, place - at - width + 1), min(most, place - at)
                    if first > last:
                        continue
                    # The middle of the whole step, also where this segment holds only some of its windows.
                    middle = s[max(0, place - at) : place - at - width + 1 + length]
                    clip = s[first : last + length]
                    row = (xxhash.xxh3_64_intdigest(middle, at + 1), xxhash.xxh3_64_intdigest(clip), clip, place - first, h0, sd0, first, last - first + 1)
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
            columns = [pa.array(np.array(out[i], np.uint64).view(np.int64)) for i in (0, 1)]
            types = (pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            columns += [pa.array(c, t) for c, t in zip(out[2:], types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in CLIPS.split(", ")])

    return segments.select("h", "sd", "segment", "place").mapInArrow(run, CLIPS)


def _solved(segments: DataFrame, length: int, group: int, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """(h, sd, segment, place), one row per content -> (h, sd, mask) as ``_shards`` gives it, for groups of any size."""
    sizes = stored(segments.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"), "suffix-sizes")
    found = _shards(segments.join(sizes.where(F.col("m") <= group), "h"), length)
    large = sizes.where(F.col("m") > group)
    if not steps or large.isEmpty():
        return found
    clips = stored(_clips(segments.join(large.select("h"), "h"), steps[0], length), "suffix-clips")
    one = [F.any_value(c).alias(c) for c in ("segment", "place")]
    contents = stored(clips.groupBy("h", "sd").agg(F.count("*").alias("n"), *one), "suffix-clip-contents")
    inner = _solved(contents.select("h", "sd", "segment", "place"), length, group, steps[1:])
    masks = contents.select("h", "sd", "n").join(inner, ["h", "sd"], "left").where("n > 1 OR mask IS NOT NULL")
    # A clip that occurs twice repeats whole: its mask is null.
    masks = stored(masks.select("h", "sd", F.when(F.col("n") == 1, F.col("mask")).alias("mask")), "suffix-clip-masks")
    hit = clips.select("h", "sd", "h0", "sd0", "first", "windows").join(masks, ["h", "sd"])
    lists = hit.groupBy("h0", "sd0").agg(F.collect_list(F.struct("first", "windows", "mask")).alias("parts"))

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, ROWS):
            masks = []
            for parts in b.column("parts").to_pylist():
                flags = np.zeros(max(p["first"] + p["windows"] for p in parts), bool)
                for p in parts:
                    own = np.ones(p["windows"], np.uint8) if p["mask"] is None else np.unpackbits(np.frombuffer(p["mask"], np.uint8))[: p["windows"]]
                    flags[p["first"] : p["first"] + len(own)] |= own.astype(bool)
                masks.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("h0"), b.column("sd0"), pa.array(masks, pa.binary())], ["h", "sd", "mask"])

    return found.unionByName(lists.mapInArrow(united, "h long, sd long, mask binary"))


def _segments(keyed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Bytes of the wanted anchors (k1, k2, h, sd, span)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, ROWS):
            rows = b.column("rows")
            flat, sizes = rows.flatten(), rows.value_lengths().to_numpy()
            texts = [t.encode() for t in b.column("text").to_pylist()]
            span = flat.field("span").to_numpy()
            first, n = span >> 20, span >> 10 & 1023
            ends = zip(np.repeat(np.arange(len(texts)), sizes).tolist(), first.tolist(), (first + n + length - 1).tolist(), strict=True)
            segments = pa.array([texts[i][lo:hi] for i, lo, hi in ends], pa.binary())
            yield pa.RecordBatch.from_arrays([flat.field("h"), flat.field("sd"), segments, pa.array(span & 1023, pa.int32())], ["h", "sd", "segment", "place"])

    lists = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "sd", "span")).alias("rows"))
    return keyed.select("k1", "k2", "text").join(lists, ["k1", "k2"]).select("text", "rows").mapInArrow(run, "h long, sd long, segment binary, place int")


def kept(raw: bytes, spans: np.ndarray, masks: list[bytes | None], length: int = LENGTH) -> tuple[bytes, int]:
    """The bytes outside every repeated window, and the number of maximal runs removed. A mask None is all ones."""
    first, n = spans >> 20, spans >> 10 & 1023
    whole = np.array([m is None for m in masks], bool)
    change = np.bincount(first[whole], minlength=len(raw) + 1) - np.bincount((first + n + length - 1)[whole], minlength=len(raw) + 1)
    for i in np.flatnonzero(~whole).tolist():
        starts = first[i] + np.flatnonzero(np.unpackbits(np.frombuffer(masks[i], np.uint8))[: n[i]])
        change[starts] += 1
        change[starts + length] -= 1
    gone = np.cumsum(change[:-1]) > 0
    runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), runs


def without_repeats(docs: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``doc_id, n_bytes, n_spans, kept`` (binary) per row of (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    number = F.coalesce(F.expr("try_cast(doc_id AS bigint)"), F.lit(-1).cast("long"))
    keyed = docs.select("doc_id", text.alias("text"), F.xxhash64(F.col("doc_id").cast("string"), text).alias("k1"), number.alias("k2"))
    every = stored(_anchored(keyed, length), "suffix-windows")
    kind = F.when(F.col("low") == F.col("high"), "equal").otherwise("mixed")
    hashes = every.groupBy("h").agg(F.count("*").alias("n"), F.min("sd").alias("low"), F.max("sd").alias("high")).where("n > 1")
    # Written, so that the join has an exchange on both sides and Spark can split a hash with very many anchors.
    hashes = stored(hashes.select("h", kind.alias("kind")), "suffix-hashes")
    marks = stored(every.join(hashes, "h"), "suffix-anchors")
    forget(every, hashes)
    rep = F.min(F.struct("k1", "k2", "span")).alias("r")
    differ = marks.where("kind <> 'equal'").groupBy("h", "sd").agg(F.count("*").alias("n"), rep)
    differ = stored(differ.select("h", "sd", "n", "r.*"), "suffix-contents")
    found = _solved(stored(_segments(keyed, differ, length), "suffix-segments"), length, group)
    # A content that occurs twice repeats whole, whatever the rest of its hash holds.
    masks = differ.select("h", "sd", "n").join(found, ["h", "sd"], "left").where("n > 1 OR mask IS NOT NULL")
    masks = stored(masks.select("h", "sd", F.when(F.col("n") == 1, F.col("mask")).alias("mask")), "suffix-masks")
    equal = marks.where("kind = 'equal'").select("k1", "k2", "span", F.lit(None).cast("binary").alias("mask"))
    rest = marks.where("kind <> 'equal'").join(masks, ["h", "sd"]).select("k1", "k2", "span", "mask")
    by_doc = equal.unionByName(rest).groupBy("k1", "k2").agg(F.collect_list(F.struct("span", "mask")).alias("marks"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, ROWS):
            marks = b.column("marks")
            flat, sizes = marks.flatten(), marks.value_lengths().fill_null(0).to_numpy()
            spans, masks, out, lo = flat.field("span").to_numpy(), flat.field("mask").to_pylist(), [], 0
            for t, n in zip(b.column("text").to_pylist(), sizes.tolist(), strict=True):
                raw = t.encode()
                out.append((len(raw), *(kept(raw, spans[lo : lo + n], masks[lo : lo + n], length) if n else (raw, 0))))
                lo += n
            types = (pa.int64(), pa.binary(), pa.int64())
            columns = [pa.array([o[i] for o in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), columns[0], columns[2], columns[1]], ["doc_id", "n_bytes", "n_spans", "kept"])

    joined = keyed.join(by_doc, ["k1", "k2"], "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(finish, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_spans long, kept binary")


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    done = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        "n_spans",
        F.sha2("kept", 256).alias("kept_sha256"),
    )
