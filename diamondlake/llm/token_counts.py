"""Token counts through a digest cache.

Content and tokenizer file are each reduced to a SHA-256 digest; stored counts are joined on both, only distinct
contents without a stored count are encoded, and their counts are appended to the cache.

Defined results: null text counts as empty (0 tokens); repeated rows come back as often as they went in; an empty
table gives an empty result; columns beyond ``doc_id`` and ``text`` are ignored. Normalisation is the identity on
UTF-8 bytes, since any folding of case or line ends could change a count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, write

CACHE_SCHEMA = "tokenizer string, digest binary, n_bytes long, n_tokens long"
#: Characters handed to the library at once; a longer text goes alone.
BATCH_CHARS = 1 << 20


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _encoder(path: str):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def _slices(texts: list[str]) -> Iterator[list[str]]:
    held, chars = [], 0
    for t in texts:
        if held and chars + len(t) > BATCH_CHARS:
            yield held
            held, chars = [], 0
        held.append(t)
        chars += len(t)
    if held:
        yield held


def encode_counts(texts: DataFrame, path: str) -> DataFrame:
    """(digest, n_bytes, content) -> (digest, n_bytes, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for b in batches:
            content = b.column("content").to_pylist()
            counts = [n for part in _slices(content) for n in encode(part)]
            yield pa.RecordBatch.from_arrays(
                [b.column("digest"), b.column("n_bytes"), pa.array(counts, pa.int64())], ["digest", "n_bytes", "n_tokens"]
            )

    return texts.select("digest", "n_bytes", "content").mapInArrow(run, "digest binary, n_bytes long, n_tokens long")


def _read_cache(spark, cache: str, tokenizer: str) -> DataFrame:
    try:
        found = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], CACHE_SCHEMA)
    return found.where(F.col("tokenizer") == tokenizer).select("digest", "n_tokens").dropDuplicates(["digest"])


def count_tokens(docs: DataFrame, path: str, cache: str, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row of ``docs``; ``cache`` is a Parquet folder that grows.

    The digest stands for the content in every exchange but one: the distinct misses move once, reduced to one copy
    a task before they do, so a text that holds a third of all rows does not gather in one place.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(path)
    keyed = docs.select(
        "doc_id",
        F.coalesce(F.col("text"), F.lit("")).alias("content"),
    ).withColumns(
        {
            "digest": F.unhex(F.sha2(F.col("content").cast("binary"), 256)),
            "n_bytes": F.octet_length("content").cast("long"),
        }
    )
    known = _read_cache(spark, cache, version)
    distinct = keyed.groupBy("digest").agg(F.any_value("content").alias("content"), F.any_value("n_bytes").alias("n_bytes"))
    misses = distinct.join(known.select("digest"), "digest", "left_anti")
    fresh = encode_counts(misses, path).select(F.lit(version).alias("tokenizer"), "digest", "n_bytes", "n_tokens")
    write(fresh, cache, mode="append")
    counts = _read_cache(spark, cache, version)
    return keyed.select("doc_id", "digest", "n_bytes").join(counts, "digest", "left").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), scratch(spark, "token-cache"))
