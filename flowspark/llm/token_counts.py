"""Token counts through a digest cache.

A count depends only on the text and the tokenizer, so it is stored under the SHA-256 of the
content (null is the empty text; nothing else is normalised away, as white space changes counts)
and the SHA-256 of the model file with the library's version.  A run joins its digests to the
stored counts, encodes each distinct missing text once, appends those counts to the cache (a
Parquet folder, append only) and joins again.  Repeated texts, however many, are encoded once.

Digests travel before texts: the distinct digests of the rows are written first, the cache gives only what they ask for (a
semi join, so what a run writes and shuffles follows its rows and not the cache), and only the texts of missing digests are dealt.

Defined cases: null text counts as empty (0 bytes, 0 tokens); repeated rows each get their count;
counts that two concurrent runs both appended agree and are merged when read; an empty table
appends nothing; texts of any length are whole; columns named ``n_bytes`` or ``n_tokens`` are replaced, all others stay, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import if_small, materialize, numbered, restored

ENCODE_AT_ONCE = 256
CACHE = "digest binary, tokenizer string, n_tokens long"


def version_digest(model_file: str) -> str:
    """Names the tokenizer: its file's bytes and the library that runs it."""
    if model_file.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    return hashlib.sha256(Path(model_file).read_bytes() + library.__version__.encode()).hexdigest()


def counter(model_file: str):
    """A function from texts to token counts, without begin, end or added special tokens."""
    if model_file.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(model_file)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch(texts, add_special_tokens=False)]


def _exists(df: DataFrame, path: str) -> bool:
    jvm = df.sparkSession._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(place)


def token_counts(docs: DataFrame, model_file: str, cache: str, text_col: str = "text") -> DataFrame:
    """``docs`` with n_bytes and n_tokens of ``text_col``; ``cache`` is the folder of stored counts."""
    spark, version = docs.sparkSession, version_digest(model_file)
    work, column, kept = numbered(docs, ("n_bytes", "n_tokens"))
    text = F.coalesce(F.col(column(text_col)).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(text, 256)).alias("digest")
    asked = materialize(work.select(digest).distinct(), "token-digests")
    n = asked.count()

    def stored() -> DataFrame:
        """The stored counts of the digests that are asked for."""
        found = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version).join(if_small(asked, n), "digest", "left_semi")
        return materialize(found.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(model_file)
        for part in parts:
            for k in range(0, len(part), ENCODE_AT_ONCE):
                some = part.iloc[k : k + ENCODE_AT_ONCE]
                yield pd.DataFrame({"digest": some["digest"], "tokenizer": version, "n_tokens": count(some["text"].tolist())})

    missing = asked
    if _exists(docs, cache):
        missing = materialize(asked.join(stored(), "digest", "left_anti"), "token-misses")
    m = missing.count()
    if m:
        texts = work.select(digest, text.alias("text")).join(if_small(missing, m), "digest", "left_semi")
        texts.dropDuplicates(["digest"]).mapInPandas(encode, CACHE).write.mode("append").parquet(cache)
    # both sides of the join are read from written tables or sources, so that Spark may split a digest that
    # a third of all rows share
    counts = stored() if n else spark.createDataFrame([], "digest binary, n_tokens long")
    out = work.withColumns({"digest": digest, "n_bytes": F.octet_length(text).cast("long")}).join(counts, "digest")
    return restored(out, kept, ("n_bytes", "n_tokens"))
