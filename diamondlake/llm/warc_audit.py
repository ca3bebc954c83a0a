"""WARC fixity audit with Merkle trees over ordered offset ranges.

Each record is a leaf entry (offset, length, digest); entries whose offsets fall in one range hash to a leaf node, and
every ``FANOUT`` neighbouring nodes hash to one above, up to one root an archive. Two replicas are compared at their
roots, and only the children of nodes that differ are compared next, down to the records.

Defined results: null fields of a page count as empty; equal records are one entry with their number of copies, so a
record repeated without end is still one row; empty tables, or equal replicas, give an empty result; columns beyond
those named are ignored; a record of any length is one entry in the range where it starts. In ``page_records`` ties
cannot occur: entries of an archive are ordered by page and digest, and equal ones are merged. Records are compared by
archive and offset: a replica that lost a record and closed the gap differs from there to the archive's end, and is
reported so. ``index_warc`` unpacks a file a piece at a time, and holds it packed, as Spark hands it over: up to 2 GB.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import itertools
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import forget, stored, table

RANGE_BYTES = 1 << 16
FANOUT = 16
LEVELS = 3
#: Bytes of an archive read at once, and of a record's header at most.
CHUNK, HEADER = 1 << 20, 1 << 20
ARCHIVE_BYTES = 1 << 26
INDEX = "archive string, offset long, length long, copies long, digest string"


def index_warc(spark, path: str) -> DataFrame:
    """``INDEX`` rows of the WARC files (plain, or gzip by record or whole) that match ``path``; offsets are unpacked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path"), b.column("content"), strict=True):
                packed = io.BytesIO(content.as_buffer())
                stream = gzip.GzipFile(fileobj=packed) if packed.getbuffer()[:2] == b"\x1f\x8b" else packed
                found = records(stream)
                while rows := list(itertools.islice(found, 4096)):
                    columns = [[name.as_py()] * len(rows), *zip(*rows, strict=True)]
                    at, length, digest = columns[1:]
                    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                    made = [pa.array(c, t) for c, t in zip((columns[0], at, length, [1] * len(rows), digest), types, strict=True)]
                    yield pa.RecordBatch.from_arrays(made, ["archive", "offset", "length", "copies", "digest"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, INDEX)


def _until(stream: BinaryIO, mark: bytes, most: int | None = None) -> int:
    """Bytes from the stream's place up to the mark's start; -1 where it does not come, or not within ``most``."""
    tail, read = b"", 0
    while most is None or read < most:
        chunk = stream.read(CHUNK if most is None else min(CHUNK, most - read))
        if not chunk:
            break
        found = (tail + chunk).find(mark)
        if found >= 0:
            return read - len(tail) + found
        read += len(chunk)
        tail = (tail + chunk)[-len(mark) + 1 :]
    return -1


def _digest(stream: BinaryIO, at: int, size: int) -> str | None:
    """SHA-256 of ``size`` bytes from ``at``; None where the stream ends before."""
    stream.seek(at)
    said = hashlib.sha256()
    while size:
        chunk = stream.read(min(CHUNK, size))
        if not chunk:
            return None
        said.update(chunk)
        size -= len(chunk)
    return said.hexdigest()


def records(stream: BinaryIO) -> Iterator[tuple[int, int, str]]:
    """(offset, length, digest) of each record, read a piece at a time. A damaged header ends its record at the next
    version line, or the end; so does a length that the file does not hold."""
    at = 0
    while True:
        stream.seek(at)
        head = _until(stream, b"\r\n\r\n", HEADER)
        stream.seek(at)
        fields = stream.read(head if head >= 0 else HEADER).split(b"\r\n")
        if fields == [b""] and not stream.read(1):
            return
        size = next((f.split(b":", 1)[1].strip() for f in fields if f.lower().startswith(b"content-length:")), b"")
        length = head + 8 + int(size) if head >= 0 and size.isdigit() else 0
        digest = _digest(stream, at, length) if length else None
        if digest is None:
            stream.seek(at + 1)
            gap = _until(stream, b"\r\n\r\nWARC/")
            end = at + 1 + gap + 4 if gap >= 0 else stream.seek(0, io.SEEK_END)
            length = end - at
            digest = _digest(stream, at, length)
        yield at, length, digest
        at += length


def page_records(pages: DataFrame, replica: Column | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Pages as WARC records laid out in archives: ``INDEX`` columns, ``page_id``, and ``replica_digest`` if asked for.

    The archive comes from the digest, so no page, host or copy can fill one; ``replica`` is the payload as another
    copy holds it.
    """

    def record(html: Column) -> Column:
        blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
        head = ["WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:", ">\r\nWARC-Target-URI: ", "\r\nContent-Length: "]
        return F.concat(
            F.lit(head[0]), blank("page_id"), F.lit(head[1]), blank("url"), F.lit(head[2]), F.octet_length(html).cast("string"),
            F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"),
        )

    html = F.coalesce(F.col("html"), F.lit(""))
    columns = {"digest": F.sha2(record(html), 256), "length": F.octet_length(record(html)).cast("long")}
    if replica is not None:
        columns["replica_digest"] = F.sha2(record(F.coalesce(replica, F.lit(""))), 256)
    names = ["page_id", *columns]
    entries = pages.select("page_id", *[c.alias(n) for n, c in columns.items()]).groupBy(*names).agg(F.count("*").alias("copies"))
    entries = stored(entries, "warc-entries")
    total = entries.agg(F.sum(F.col("length") * F.col("copies"))).first()[0] or 0
    archives = max(1, -(-total // archive_bytes))
    place = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") % archives
    order = W.Window.partitionBy("archive").orderBy(F.asc_nulls_first("page_id"), "digest")
    before = F.coalesce(F.sum(F.col("length") * F.col("copies")).over(order.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    return entries.withColumn("archive", place.cast("string")).withColumn("offset", before)


def _nodes(index: DataFrame) -> list[DataFrame]:
    """Nodes (archive, node, hash) of each level, ranges first and roots last."""

    def hashed(rows: DataFrame, node: Column, at: str, *fields: str) -> DataFrame:
        entry = F.struct(F.col(at).alias("at"), F.concat_ws(":", at, *fields).alias("text"))
        gathered = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["text"]), ",")
        return rows.groupBy("archive", node.alias("node")).agg(F.sha2(gathered, 256).alias("hash"))

    ranges = F.floor(F.col("offset") / RANGE_BYTES).cast("long")
    found = [stored(hashed(index, ranges, "offset", "length", "copies", "digest"), "merkle-ranges")]
    for _ in range(LEVELS - 1):
        found.append(stored(hashed(found[-1], F.floor(F.col("node") / FANOUT).cast("long"), "node", "hash"), "merkle-nodes"))
    return [*found, stored(hashed(found[-1], F.lit(0).cast("long"), "node", "hash"), "merkle-roots")]


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Records that differ: ``archive, offset, length, status, primary_digest, replica_digest``.

    status is ``corrupt``, ``missing`` (the replica lacks it) or ``extra``. Only ranges under nodes that differ at
    every level above them are opened.
    """
    names = [c.split()[0] for c in INDEX.split(", ")]
    sides = [d.select(*names) for d in (primary, replica)]
    trees = [_nodes(s) for s in sides]

    def differing(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.withColumnRenamed("hash", "left_hash").join(b.withColumnRenamed("hash", "right_hash"), ["archive", "node"], "full_outer")
        return both.where(~F.col("left_hash").eqNullSafe(F.col("right_hash"))).select("archive", "node")

    open_ = stored(differing(trees[0][-1], trees[1][-1]), "merkle-open")
    for level in reversed(range(LEVELS)):
        up = F.lit(0).cast("long") if level == LEVELS - 1 else F.floor(F.col("node") / FANOUT).cast("long")
        above = open_.select("archive", F.col("node").alias("up"))
        below = [t[level].withColumn("up", up).join(above, ["archive", "up"], "left_semi").drop("up") for t in trees]
        last, open_ = open_, stored(differing(*below), "merkle-open")
        forget(last)
    forget(*itertools.chain(*trees))
    within = [
        s.withColumn("node", F.floor(F.col("offset") / RANGE_BYTES).cast("long")).join(open_, ["archive", "node"], "left_semi").drop("node")
        for s in sides
    ]
    entry = F.struct("length", "copies", "digest")
    a, b = (w.select("archive", "offset", entry.alias(n)) for w, n in zip(within, ("a", "b"), strict=True))
    both = a.join(b, ["archive", "offset"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("corrupt")
    return both.select(
        "archive", "offset", F.coalesce("a.length", "b.length").alias("length"), status.alias("status"),
        F.col("a.digest").alias("primary_digest"), F.col("b.digest").alias("replica_digest"),
    )


def op1_warc_audit(spark, sf_dir: str) -> DataFrame:
    """``pages`` as WARC archives against a replica with known damage: page ids 7 mod 101 altered, 11 mod 499 lost."""
    altered = F.when((F.col("page_id") % 101 == 7) & (F.length("html") > 0), F.concat(F.lit("#"), F.expr("substring(html, 2)")))
    laid = stored(page_records(table(spark, sf_dir, "pages"), F.coalesce(altered, F.col("html"))), "warc-layout")
    held = laid.where(~F.coalesce(F.col("page_id") % 499 == 11, F.lit(False)))
    found = audit(laid, held.drop("digest").withColumnRenamed("replica_digest", "digest"))
    return found.join(laid.select("archive", "offset", "page_id"), ["archive", "offset"], "left")


OP1_SQL = r"""
WITH parts AS (
  SELECT page_id, coalesce(html, '') AS html,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
      || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
      || chr(13) || chr(10) || 'Content-Length: ' AS head, chr(13) || chr(10) || chr(13) || chr(10) AS gap
  FROM pages
), texts AS (
  SELECT page_id, head || strlen(html) || gap || html || gap AS record,
    head || strlen(other) || gap || other || gap AS other
  FROM (SELECT *, CASE WHEN page_id % 101 = 7 AND html <> '' THEN '#' || substr(html, 2) ELSE html END AS other FROM parts)
), entries AS (
  SELECT page_id, sha256(record) AS digest, sha256(other) AS replica_digest, strlen(record) AS length, count(*) AS copies
  FROM texts GROUP BY ALL
), dealt AS (
  SELECT *, (('0x' || substr(digest, 1, 8))::BIGINT % (SELECT greatest(1, ceil(sum(length * copies) / 67108864.0))::BIGINT FROM entries)) AS archive
  FROM entries
), laid AS (
  SELECT *, coalesce(sum(length * copies) OVER (PARTITION BY archive ORDER BY page_id NULLS FIRST, digest
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM dealt
)
SELECT archive::VARCHAR AS archive, "offset", length::BIGINT AS length,
  CASE WHEN page_id % 499 = 11 THEN 'missing' ELSE 'corrupt' END AS status, digest AS primary_digest,
  CASE WHEN page_id % 499 = 11 THEN NULL ELSE replica_digest END AS replica_digest, page_id
FROM laid WHERE page_id % 499 = 11 OR digest <> replica_digest
"""
