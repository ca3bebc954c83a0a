"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

Documents with equal shingle sets are one class. Shingles are ordered, the common ones last, and two sets that reach
the threshold share a shingle in the first part of both: the classes that share such a shingle are a tile. A tile is
sorted by size; each set meets the larger ones within its size band only. The bits in which two signatures differ
bound the overlap from above, and only pairs that may still link are intersected exactly, as sorted arrays.

Links are needed for their components only. Tiles where most pairs pass the bound (large groups of near copies) are
not listed pair by pair: those that share classes are one cluster. A cluster's sets are compared within blocks, then a
few representatives of each component found, in blocks again, until a round joins nothing; so a group of m near copies
costs about m comparisons. Tiles that then still hold two components are compared whole, in pairs of blocks, where a
pair that is joined already is passed over: no pair that could join two components is left out. A tile of more than
``TILE`` classes is split into pairs of blocks.

Defined results: null or wordless texts have no shingle and link with nothing, each its own component; repeated rows
are one class and come back as often; an empty table gives an empty result; other columns are ignored. Component ids
are the least ``doc_id`` reached, nulls apart. Sets are told apart by 128-bit hashes of their 64-bit shingles, and then
numbered in a written table.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import components, forget, slices, stored, table
from .shingles import shingle_set

#: Bits of a signature by size of the set: up to so many shingles, so many bits. Wider ones fold to narrower ones.
SIGNATURES = ((768, 1024), (3072, 2048), (1 << 62, 4096))
TILE = 2048
#: Passing pairs a row at which a tile counts as dense.
DENSE = 8
#: Representatives of a component in a round.
REPRESENTATIVES = 4
#: Shingles counted together by a task; one that occurs in ``FREQUENT`` of every such lot's sets is reported.
LOT, FREQUENT = 1 << 21, 6
#: Common shingles that move to the order's end, the commonest first. It bounds what is broadcast, and only the order
#: depends on it: any order finds every link.
MAX_COMMON = 1 << 16
#: Pairs listed, and bytes of signatures compared, at a time.
PAIRS_AT_ONCE, AT_ONCE = 1 << 16, 1 << 22


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def signature(s: np.ndarray) -> np.ndarray:
    """The bits named by the top digits of each hash, packed."""
    wide = next(bits for most, bits in SIGNATURES if len(s) <= most)
    bits = np.zeros(wide, np.uint8)
    bits[(s >> np.uint64(65 - wide.bit_length())).astype(np.int64)] = 1
    return np.packbits(bits)


#: For each byte, its four pairs of bits as one bit each: whether either is set.
_PAIRS = np.array([sum(((b >> 2 * i & 3) > 0) << i for i in range(4)) for b in range(256)], np.uint8)


def folded(packed: np.ndarray) -> np.ndarray:
    """Packed signatures [row, byte] at half the width: neighbouring bits joined by or."""
    x = _PAIRS[packed].reshape(len(packed), -1, 2)
    return x[:, :, 0] << 4 | x[:, :, 1]


def least_difference(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """For each pair of signatures the number of bits in which they differ, at the narrower width."""
    sizes = np.stack([np.fromiter(map(len, x), np.int64, len(x)) for x in (left, right)], axis=1)
    out = np.zeros(len(left), np.int64)
    for pair in np.unique(sizes, axis=0):
        every, narrow, step = np.flatnonzero((sizes == pair).all(axis=1)), pair.min(), max(1, AT_ONCE // int(pair.max()))
        for at in (every[i : i + step] for i in range(0, len(every), step)):
            sides = [np.frombuffer(b"".join(x[i] for i in at), np.uint8).reshape(len(at), -1) for x in (left, right)]
            for i in range(2):
                while sides[i].shape[1] > narrow:
                    sides[i] = folded(sides[i])
            words = [np.ascontiguousarray(x).view(np.uint64) for x in sides]
            out[at] = np.bitwise_count(words[0] ^ words[1]).sum(axis=1)
    return out


def common_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Sorted hashes of shingles in very many sets, by a count over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            some = n >= FREQUENT
            return pa.RecordBatch.from_arrays([pa.array(_signed(found[some])), pa.array(n[some])], ["g", "n"])

        for b in slices(batches):
            for t in b.column("text").to_pylist():
                held.append(shingle_set(t, words))
                size += len(held[-1])
                if size >= LOT:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    counted = docs.select("text").mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "g").limit(MAX_COMMON).select("g").toPandas()["g"]
    return np.sort(rows.to_numpy(np.int64).view(np.uint64))


def _prepared(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(k1, k2, doc_id, text) -> (k1, k2, doc_id, d1, d2, n, bits, prefix); d1 and d2 are the set's digest."""
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        for b in slices(batches):
            out: list[list] = [[], [], [], [], []]
            for t in b.column("text").to_pylist():
                s = shingle_set(t, words)
                n = len(s)
                late = np.zeros(n, bool)
                if len(last):
                    late = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
                ordered = np.concatenate([s[~late], s[late]])[: n - (percent * n + 99) // 100 + 1]
                digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                for column, x in zip(out, (*digest.tolist(), n, signature(s).tobytes(), _signed(ordered)), strict=True):
                    column.append(x)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            made = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("k1", "k2", "doc_id")), *made], ["k1", "k2", "doc_id", "d1", "d2", "n", "bits", "prefix"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("k1", "k2", "doc_id", "text").mapInArrow(run, f"k1 long, k2 long, doc_id {kind}, d1 long, d2 long, n long, bits binary, prefix array<long>")


def _block_pairs():
    """The pairs of blocks in which a row of a group split into ``blocks`` takes part."""
    own = F.pmod(F.xxhash64("sid"), F.col("blocks"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    return F.transform(every, lambda o: F.struct(F.least(o, own).alias("x"), F.greatest(o, own).alias("y")))


def _tiled(classes: DataFrame, percent: int) -> DataFrame:
    """(g, x, y, sid, n): classes that share the prefix shingle g with one of their size band; x and y name a pair of
    blocks. Sizes need no signature, so rows without a neighbour in size are gone before signatures move."""
    rows = classes.select("sid", "n", F.explode("prefix").alias("g"))
    shared = rows.groupBy("g").agg(F.count("*").alias("m")).where("m > 1")
    blocks = F.ceil(2 * F.col("m") / F.lit(TILE)).cast("long")
    met = rows.join(shared.select("g", F.when(F.col("m") > TILE, blocks).otherwise(1).alias("blocks")), "g")
    placed = met.select("g", "sid", "n", F.explode(_block_pairs()).alias("b")).select("g", "b.x", "b.y", "sid", "n")
    by_size = W.Window.partitionBy("g", "x", "y").orderBy("n", "sid")
    near = (F.lead("n").over(by_size) * percent <= F.col("n") * 100) | (F.col("n") * percent <= F.lag("n").over(by_size) * 100)
    return placed.withColumn("near", near).where("near").drop("near")


def _units(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], least: int) -> Iterator[pa.Table]:
    """Whole groups of consecutive rows with equal keys, small groups together, from sorted batches."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not len(b):
            continue
        where = np.stack([b.column(c).to_numpy() for c in keys], axis=1)
        turns = np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1
        if held and tuple(held[-1].column(c)[-1].as_py() for c in keys) != tuple(where[0]):
            turns = np.append(0, turns)
        if size + len(b) > least and len(turns):
            cut = int(turns[-1])
            if held or cut:
                yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held, size, b = [], 0, b.slice(cut)
        held.append(b)
        size += len(b)
    if held:
        yield pa.Table.from_batches(held)


def _bounded(tiles: DataFrame, percent: int) -> DataFrame:
    """Pairs of a tile whose signatures allow a link, as (a, b, null); a dense tile is one row (null, null, g)."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        where = np.stack([rows.column(c).to_numpy() for c in ("g", "x", "y")], axis=1)
        tile = np.concatenate([[0], np.cumsum((where[1:] != where[:-1]).any(axis=1))])
        sid, n = (rows.column(c).to_numpy() for c in ("sid", "n"))
        bits = np.array(rows.column("bits").to_pylist(), object)
        band = tile * (1 << 40)
        reach = np.searchsorted(band + n, band + n * 100 // percent, side="right") - np.arange(len(n)) - 1
        ends = np.cumsum(reach)
        left, right = [], []
        at = 0
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
            count = reach[at:to]
            a = np.repeat(np.arange(at, to), count)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
            if len(a):
                most = (n[a] + n[b] - least_difference(bits[a], bits[b])) // 2
                ok = (100 + percent) * most >= percent * (n[a] + n[b])
                left.append(a[ok])
                right.append(b[ok])
            at = to
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        many = np.bincount(tile[a], minlength=tile[-1] + 1) > DENSE * np.bincount(tile)
        crowded = np.unique(where[many[tile], 0])
        a, b = a[~many[tile[a]]], b[~many[tile[a]]]
        pairs, none = pa.nulls(len(a), pa.int64()), pa.nulls(len(crowded), pa.int64())
        low, high = np.minimum(sid[a], sid[b]), np.maximum(sid[a], sid[b])
        columns = [pa.concat_arrays([pa.array(low), none]), pa.concat_arrays([pa.array(high), none]), pa.concat_arrays([pairs, pa.array(crowded, pa.int64())])]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "g"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(solve, _units(batches, ("g", "x", "y"), TILE))

    dealt = tiles.select("g", "x", "y", "sid", "n", "bits").repartition("g", "x", "y").sortWithinPartitions("g", "x", "y", "n", "sid")
    return dealt.mapInArrow(run, "a long, b long, g long")


def joined(sets: list[np.ndarray], comp: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join the sets' components, none twice. Every pair of sets in different components is judged."""
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    wide = max(2048, 1 << int(8 * n.max()).bit_length()) if len(n) else 2048
    wide = min(wide, 1 << 15)
    bits = np.zeros((len(sets), wide // 8), np.uint8)
    for i, s in enumerate(sets):
        own = np.zeros(wide, np.uint8)
        own[(s >> np.uint64(65 - wide.bit_length())).astype(np.int64)] = 1
        bits[i] = np.packbits(own)
    bits, root, out = bits.view(np.uint64), comp.copy(), []
    for place, i in enumerate(order):
        to = np.searchsorted(n[order], n[i] * 100 // percent, side="right")
        others = order[place + 1 : to]
        others = others[root[others] != root[i]]
        if not len(others):
            continue
        most = (n[i] + n[others] - np.bitwise_count(bits[i] ^ bits[others]).sum(axis=1, dtype=np.int64)) // 2
        for j in others[(100 + percent) * most >= percent * (n[i] + n[others])]:
            if root[j] != root[i] and linked(sets[i], sets[j], percent):
                out.append((int(i), int(j)))
                root[root == root[j]] = root[i]
    return out


def _compared(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) that join components, among the rows (sid, comp, packed) of each (cluster, x, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for unit in _units(batches, ("cluster", "x", "y"), 1):
            where = np.stack([unit.column(c).to_numpy() for c in ("cluster", "x", "y")], axis=1)
            cuts = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1), len(where)]
            for lo, hi in itertools.pairwise(cuts):
                part = unit.slice(lo, hi - lo)
                sets = [shingle_set(z.decompress(raw).decode(), words) for raw in part.column("packed").to_pylist()]
                sid = part.column("sid").to_numpy()
                pairs = np.array(joined(sets, part.column("comp").to_numpy(), percent), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(sid[pairs[:, 0]]), pa.array(sid[pairs[:, 1]])], ["a", "b"])

    dealt = rows.select("cluster", "x", "y", "sid", "comp", "packed").repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y", "sid")
    return dealt.mapInArrow(run, "a long, b long")


def _members(dense: DataFrame) -> DataFrame:
    """(cluster, sid) of the classes of dense tiles. Tiles that share a class are one cluster."""
    hubs = dense.groupBy("g").agg(F.min("sid").alias("b"))
    found = components(dense.join(hubs, "g").select(F.col("sid").alias("a"), "b"))
    alone = dense.select("sid").distinct().join(found, F.col("sid") == F.col("id"), "left")
    return stored(alone.select("sid", F.coalesce("root", "sid").alias("cluster")), "join-members")


def _labelled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members`` with the component that each class is in so far."""
    labels = roots.select(F.col("id").alias("sid"), F.col("root").alias("comp"))
    return members.join(labels, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))


def _blocks(count: str):
    return F.when(F.col(count) > TILE, F.ceil(2 * F.col(count) / F.lit(TILE)).cast("long")).otherwise(1)


def _with_links(roots: DataFrame, links: DataFrame) -> DataFrame:
    return components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(links))


def _represented(members: DataFrame, texts: DataFrame, roots: DataFrame, words: int, percent: int) -> DataFrame:
    """``roots`` with the links that representatives of components have within their clusters."""
    number = 0
    while True:
        labelled = _labelled(members, roots)
        firsts = [F.min(F.struct(F.xxhash64("sid", F.lit(number * REPRESENTATIVES + i)), "sid"))["sid"] for i in range(REPRESENTATIVES)]
        some = labelled.groupBy("cluster", "comp").agg(F.array_distinct(F.array(*firsts)).alias("sids"))
        some = stored(some.select("cluster", "comp", F.explode("sids").alias("sid")), "join-representatives")
        sizes = some.groupBy("cluster").agg(F.count("*").alias("m"), F.count_distinct("comp").alias("comps")).where("comps > 1")
        sizes = sizes.select("cluster", _blocks("m").alias("blocks"))
        links = None
        if not sizes.isEmpty():
            own = F.pmod(F.xxhash64("sid", F.lit(-number - 1)), F.col("blocks"))
            rows = some.join(sizes, "cluster").withColumns({"x": own, "y": own}).join(texts, "sid")
            links = stored(_compared(rows, words, percent), "join-links")
        forget(some)
        if links is None or links.isEmpty():
            return roots
        roots, number = _with_links(roots, links), number + 1
        forget(links)


def _cluster_links(dense: DataFrame, texts: DataFrame, roots: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) among all classes of the tiles, in pairs of blocks of a cluster."""
    members = _members(dense)
    sizes = members.groupBy("cluster").agg(F.count("*").alias("m")).select("cluster", _blocks("m").alias("blocks"))
    placed = members.join(sizes, "cluster").select("cluster", "sid", F.explode(_block_pairs()).alias("b")).select("cluster", "b.x", "b.y", "sid")
    links = stored(_compared(_labelled(placed, roots).join(texts, "sid"), words, percent), "join-links")
    forget(members)
    return links


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted arrays reach the threshold."""
    if not len(a) or not len(b):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, packed) of the classes ``wanted`` (sid, k1, k2). Texts are compressed before they move."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in slices(batches):
            texts = [z.compress(t.encode()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), pa.array(texts, pa.binary())], ["k1", "k2", "packed"])

    packed = docs.select("k1", "k2", "text").mapInArrow(pack, "k1 long, k2 long, packed binary")
    return packed.join(wanted, ["k1", "k2"]).groupBy("sid").agg(F.any_value("packed").alias("packed"))


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by exact intersection."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        read = functools.lru_cache(maxsize=64)(lambda raw: shingle_set(z.decompress(raw).decode(), words))
        for b in slices(batches):
            both = zip(b.column("left").to_pylist(), b.column("right").to_pylist(), strict=True)
            ok = pa.array([linked(read(x), read(y), percent) for x, y in both], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], ["a", "b"])

    left = texts.select(F.col("sid").alias("a"), F.col("packed").alias("left"))
    right = texts.select(F.col("sid").alias("b"), F.col("packed").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(check, "a long, b long")


def _keyed(docs: DataFrame, *more) -> DataFrame:
    """Rows of (doc_id, text), null as empty, with a key made from both."""
    text = F.coalesce(F.col("text"), F.lit(""))
    number = F.coalesce(F.expr("try_cast(doc_id AS bigint)"), F.lit(-1).cast("long"))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(F.col("doc_id").cast("string"), text).alias("k1"), number.alias("k2"), *more)


def _rooted(keyed: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, k1, k2, n, root) per row: rows with the same root, a class, are one component."""
    prepared = stored(_prepared(keyed, words, percent), "join-prepared")
    rows = stored(prepared.select("doc_id", "k1", "k2", "d1", "d2", "n"), "join-rows")
    first = F.min(F.struct("k1", "k2")).alias("k")
    grouped = prepared.where("n > 0").groupBy("d1", "d2").agg(first, *[F.any_value(c).alias(c) for c in ("n", "bits", "prefix")])
    classes = stored(grouped.withColumn("sid", F.monotonically_increasing_id()), "join-classes")
    forget(prepared)
    tiles = stored(_tiled(classes, percent), "join-tiles")
    names = stored(classes.select("sid", "d1", "d2", "k.k1", "k.k2", "bits"), "join-names")
    forget(classes)
    bounded = stored(_bounded(tiles.join(names.select("sid", "bits"), "sid"), percent), "join-bounded")
    tested = stored(bounded.where("a IS NOT NULL").select("a", "b").distinct(), "join-pairs")
    crowded = bounded.where("a IS NULL").select("g").distinct()
    dense = stored(tiles.select("g", "sid").join(crowded, "g", "left_semi").distinct(), "join-dense")
    forget(tiles, bounded)
    named = tested.select(F.explode(F.array("a", "b")).alias("sid")).unionByName(dense.select("sid")).distinct()
    texts = stored(_texts(keyed, names.join(named, "sid").select("sid", "k1", "k2")), "join-texts")
    links = stored(_verified(tested, texts, words, percent), "join-links")
    forget(tested)
    roots = components(links)
    if not dense.isEmpty():
        members = _members(dense)
        roots = _represented(members, texts, roots, words, percent)
        forget(members)
        parted = _labelled(dense, roots).groupBy("g").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
        rest = stored(dense.join(parted.select("g"), "g", "left_semi"), "join-rest")
        if not rest.isEmpty():
            roots = _with_links(roots, _cluster_links(rest, texts, roots, words, percent))
        forget(rest)
    rooted = names.select("sid", "d1", "d2").join(roots.withColumnRenamed("id", "sid"), "sid", "left")
    rooted = stored(rooted.select("d1", "d2", F.coalesce("root", "sid").alias("root")), "join-rooted")
    forget(dense, names, texts, links)
    owned = stored(rows.join(rooted, ["d1", "d2"], "left").select("doc_id", "k1", "k2", "n", "root"), "join-owned")
    forget(rows, rooted)
    return owned


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of (doc_id, text)."""
    owned = _rooted(_keyed(docs), words, percent)
    least = stored(owned.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least")), "join-least")
    out = owned.join(least, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component does, with their columns as they were.

    The least id stays (a null one only where there is no other), among equal ids the row with the least key, and of
    equal rows one. Documents without a shingle are no one's copy: all stay.
    """
    owned = _rooted(_keyed(docs.select("doc_id", "text")), words, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("r")
    keepers = owned.where("n > 0").groupBy("root").agg(first).select("r.k1", "r.k2", F.lit(True).alias("one"))
    alone = owned.where("n = 0").select("k1", "k2", F.lit(False).alias("one")).distinct()
    rows = _keyed(docs, F.struct(*[F.col(c) for c in docs.columns]).alias("row")).select("row", "k1", "k2")
    kept = rows.join(keepers.unionByName(alone), ["k1", "k2"])
    place = F.row_number().over(W.Window.partitionBy("k1", "k2").orderBy("k1"))
    return kept.withColumn("place", place).where("place = 1 OR NOT one").select("row.*")


def op6_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=85)
