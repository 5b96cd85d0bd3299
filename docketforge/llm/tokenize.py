"""Problem 7: encoding of the whole corpus with a public tokenizer, and token counts."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder
from .common import TOKENIZER_DIR, spread, table

#: Texts encoded at once: bounds the memory of a task, not what is encoded.
STEP = 256


def vocabulary_path(tokenizer: str, folder: str | None = None) -> str:
    """The ranks file of a byte-level BPE of the folder."""
    return os.path.join(folder or TOKENIZER_DIR, f"{tokenizer}.tiktoken")


def _steps(texts: list):
    for i in range(0, len(texts), STEP):
        yield [t or "" for t in texts[i : i + STEP]]


def encode_column(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, ids array<int>) for every row of df, without special tokens.

    Null and empty texts give an empty list; text that looks like a special token is ordinary
    text. Rows that repeat are encoded each; columns besides key and text are not looked at, so
    they may bear any name. Each Python worker inserts the distinct words it meets into a trie
    and walks it depth first (bpe.TrieEncoder), so no shuffle is needed at any size.
    """
    path = vocabulary_path(tokenizer, folder)

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                part = batch.slice(i, STEP)
                out = enc.encode([t or "" for t in part.column(1).to_pylist()])
                ends = np.zeros(len(out) + 1, dtype="int32")
                np.cumsum([len(b) // 4 for b in out], out=ends[1:])
                values = pa.array(np.frombuffer(b"".join(out), dtype="int32"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], names=["k", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def count_column(df: DataFrame, keep: list[str], text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """The columns keep and n_tokens int of every row; null and empty texts have 0."""
    path = vocabulary_path(tokenizer, folder)
    src = df.select(*keep, F.col(text).alias("__text"))

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                part = batch.slice(i, STEP)
                n = enc.count([t or "" for t in part.column(part.num_columns - 1).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(n, pa.int32())], names=[*keep, "n_tokens"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return src.mapInArrow(run, f"{kinds}, n_tokens int")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_column(spread(docs, "doc_id"))


def p7_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, tokens and the mean length by language, counted over all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    counts = count_column(spread(docs, "doc_id"), ["lang"])
    return counts.groupBy("lang").agg(
        F.count("*").alias("n_docs"), F.sum("n_tokens").cast("bigint").alias("n_tokens"), F.max("n_tokens").cast("bigint").alias("max_tokens")
    )
