"""Signed feature-hash vectors, kept sparse."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import text as X
from ..functions.digest import hex_word

TEXTS = 4096             # texts of a task, on average


def sparse_hash_embedding(docs: DataFrame, key: str, text: str, dim: int = 512) -> DataFrame:
    """(key, bucket, v): unigrams and bigrams hashed into ``dim`` signed buckets, zeros dropped.

    Integer weights; divide by the L2 norm when comparing. Texts are dealt out by key, about ``TEXTS`` to a task however many there are, and
    brought into the order of the keys; a task adds up one key after the other and holds one vector, not all sums of its texts.
    """
    parts = max(1, math.ceil(docs.count() / TEXTS), docs.sparkSession.sparkContext.defaultParallelism)
    dealt = docs.select(key, text).repartition(parts, key).sortWithinPartitions(key)
    toks = dealt.select(key, X.tokens(F.col(text)).alias("__tk"))
    feats = toks.select(key, F.explode(F.concat(F.col("__tk"), X.bigrams(F.col("__tk")))).alias("f")).select(key, F.md5("f").alias("h"))
    signed = feats.select(key, (hex_word(F.col("h")) % dim).alias("bucket"), F.when(F.substring("h", 16, 1) >= "8", 1).otherwise(-1).alias("s"))
    bucket, total = signed.schema["bucket"].dataType, "bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None                              # the key whose features may go on in the next batch, as an array of one; its sums
        names = [key, "bucket", "v"]

        def rows(keys: pa.Array, sums: np.ndarray) -> pa.RecordBatch:
            at, b = np.nonzero(sums)
            return pa.RecordBatch.from_arrays([keys.take(pa.array(at)), pa.array(b, pa.int64()), pa.array(sums[at, b], pa.int64())], names)
        for b in batches:
            if not b.num_rows:
                continue
            code = b.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            start = np.concatenate([[0], np.nonzero(code[1:] != code[:-1])[0] + 1])
            run_of = np.repeat(np.arange(len(start)), np.diff(np.append(start, b.num_rows)))
            at = run_of * dim + b.column(1).to_numpy(zero_copy_only=False)
            sums = np.bincount(at, b.column(2).to_numpy(zero_copy_only=False), len(start) * dim).astype(np.int64).reshape(-1, dim)
            keys = b.column(0).take(pa.array(start))
            if last is not None:
                if last.equals(keys[:1]):
                    sums[0] += held
                else:
                    yield rows(last, held[None])
            yield rows(keys[:-1], sums[:-1])
            last, held = keys[-1:], sums[-1]
        if last is not None:
            yield rows(last, held[None])
    return signed.withColumn("bucket", F.col("bucket").cast("long")).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, bucket long, v {total}").withColumn("bucket", F.col("bucket").cast(bucket))
