"""Token counts through a cache of digests.

The cache is a Parquet table (digest, n_tokens), partitioned by tokenizer, in a shared
folder. A run joins the digests of all texts to it, encodes each distinct text that is
missing once, appends the counts and joins again. If there are no counts for the tokenizer
yet, nothing is joined first; else texts only meet the digests that are missing. The key is the digest of the normalised content; normalising
turns null into the empty text and nothing else, as any stronger form could join texts of
different counts. The tokenizer's digest covers the library, its version and the model's
bytes, so that another model never finds these counts.

Null and empty text: 0 bytes, 0 tokens. Repeated rows each get a row, but are encoded once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from importlib.metadata import version

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.bpe import by_size
from tidewater.llm.common import exists, raw, slices, tidy, written

CACHE = "tokenizer string, digest binary, n_tokens bigint"


def library(path: str) -> str:
    return "tokenizers" if path.endswith(".json") else "sentencepiece"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as model:
        return hashlib.sha256(f"{library(path)} {version(library(path))}\n".encode() + model.read()).hexdigest()


def counter(path: str):
    """Function from texts to their numbers of tokens, without begin, end or added special tokens."""
    if library(path) == "tokenizers":
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(x) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]


def content_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops rows whose digest the task has seen; forgets what it has seen when that grows large, so copies may be left."""
    seen: set[bytes] = set()
    for batch in slices(batches):
        keep = []
        for digest in batch.column(0).to_pylist():
            keep.append(digest not in seen)
            seen.add(digest)
        if len(seen) > 500_000:
            seen.clear()
        yield batch.filter(pa.array(keep, pa.bool_()))


def count_tokens(df: DataFrame, path: str, cache: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 4096) -> DataFrame:
    """The kept columns with n_bytes, n_tokens and over_limit. cache: folder of the cache, made if it is missing."""
    spark = df.sparkSession
    name = tokenizer_digest(path)
    known = lambda: spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == name).select("digest", "n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for batch in _first_of_each(batches):
            count = count or counter(path)
            texts = raw(batch.column(1))
            for start, end in by_size(texts):
                found = count([x.decode("utf-8", "replace") for x in texts[start:end]])
                digests = batch.column(0).slice(start, end - start)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), digests, pa.array(found, pa.int64())], ["tokenizer", "digest", "n_tokens"])

    content = df.select(content_digest(df[text]).alias("digest"), F.coalesce(df[text], F.lit("")).alias("text"))
    if exists(spark, f"{cache}/tokenizer={name}"):
        missing = written(spark, content.select("digest").distinct().join(known().select("digest"), "digest", "left_anti"), "token-misses")
        content = content.join(missing, "digest", "left_semi")
    once = content.mapInArrow(tidy(_first_of_each), "digest binary, text string").repartition("digest")
    once.mapInArrow(tidy(run), CACHE).write.mode("append").partitionBy("tokenizer").parquet(cache)

    # two runs at a time may both append a text; a table, so that the join can split a text of many rows
    counts = written(spark, known().groupBy("digest").agg(F.max("n_tokens").alias("__n")), "token-counts")
    size = F.octet_length(F.coalesce(df[text], F.lit(""))).cast("bigint")
    rows = df.select(*[df[c] for c in keep], size.alias("__bytes"), content_digest(df[text]).alias("digest"))
    return rows.join(counts, "digest").select(*keep, F.col("__bytes").alias("n_bytes"), F.col("__n").alias("n_tokens"), (F.col("__n") > limit).alias("over_limit"))
