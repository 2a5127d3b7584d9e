"""Problem 6: encoding of a whole corpus, and token counts."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from taintgauge.sources.tables import table

#: Folder of the public vocabularies; a parameter of every function here.
TOKENIZERS = os.environ.get("TAINTGAUGE_TOKENIZERS", "/opt/tokenizers")


def vocabulary_bytes(folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> bytes:
    """The vocabulary's definition (1.6 MB, a fixed file), read by the driver and sent to the executors once."""
    with open(os.path.join(folder, f"{name}.json"), "rb") as f:
        return f.read()


def encode(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(key, ids array<int>): one row per input row, ids of the whole text without special tokens.

    NULL and empty texts give the empty list, a NULL key stays NULL, repeated rows are repeated, an empty table
    gives no rows; other columns of `df`, whatever their names, are pruned before the Python stage.
    One narrow stage without shuffle; memory per worker is bounded by the Arrow batch and the memo tables.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary_bytes(folder, name))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from taintgauge.llm.bpe import encoder_of

        enc = encoder_of(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                packed = [enc.packed(t) for t in part.column(1).to_pylist()]
                ends = np.zeros(len(packed) + 1, dtype=np.int64)
                np.cumsum([len(p) // 4 for p in packed], out=ends[1:])
                values = pa.array(np.frombuffer(b"".join(packed), dtype=np.int32))
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    narrow = df.select(key, text)
    return narrow.mapInArrow(run, f"`{key}` {narrow.schema[key].dataType.simpleString()}, ids array<int>")


def token_counts(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(key, n_tokens bigint): sizes of whole texts; NULL and empty texts have size 0."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary_bytes(folder, name))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from taintgauge.llm.bpe import encoder_of

        enc = encoder_of(shared.value)
        for batch in batches:
            sizes = [len(enc.packed(t)) // 4 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=[key, "n_tokens"])

    narrow = df.select(key, text)
    return narrow.mapInArrow(run, f"`{key}` {narrow.schema[key].dataType.simpleString()}, n_tokens bigint")


def decode(df: DataFrame, key: str, ids: str, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(key, text): inverse of `encode` by the offset table; a NULL list gives NULL, the empty list the empty text."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary_bytes(folder, name))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from taintgauge.llm.bpe import encoder_of

        vocabulary = encoder_of(shared.value).vocabulary
        for batch in batches:
            texts = [None if x is None else vocabulary.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    narrow = df.select(key, ids)
    return narrow.mapInArrow(run, f"`{key}` {narrow.schema[key].dataType.simpleString()}, text string")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and ids of every document by byte_bpe_50k."""
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id of every document whose ids don't decode to its own text: no rows are expected."""
    from pyspark.sql import functions as F

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = decode(encode(docs, "doc_id", "text"), "doc_id", "ids").select("doc_id", F.xxhash64("text").alias("back"))
    return docs.select("doc_id", F.xxhash64("text").alias("want")).join(back, "doc_id").where("want <> back").select("doc_id")


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, SHA-256 of the text that the ids of each document decode to, and whether it has any ids."""
    from pyspark.sql import functions as F

    ids = encode(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("n", F.size("ids"))
    back = decode(ids.withColumn("doc", F.struct("doc_id", "n")), "doc", "ids")
    return back.select("doc.doc_id", F.sha2("text", 256).alias("digest"), (F.col("doc.n") > 0).alias("has_ids"))
