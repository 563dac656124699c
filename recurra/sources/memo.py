"""A memo table: compute values only for keys not yet stored."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

NAME, KEY, VALUE = "name", "key", "value"


def memo_key(name: str, content: Column) -> Column:
    return F.sha2(F.concat(F.lit(name), F.lit("\n"), content), 256)


def split_requests(requests: DataFrame, memo: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of distinct requested keys against the memo."""
    wanted = requests.dropDuplicates([KEY])
    known = memo.select(KEY)
    return wanted.join(known, KEY, "left_semi"), wanted.join(known, KEY, "left_anti")


def extend_memo(requests: DataFrame, memo: DataFrame, compute: Column) -> DataFrame:
    """All requested keys with their value and ``status``; only misses are computed."""
    hits, misses = split_requests(requests, memo)
    old = hits.select(KEY).join(memo, KEY).select(KEY, VALUE, F.lit("hit").alias("status"))
    new = misses.select(KEY, compute.alias(VALUE), F.lit("miss").alias("status"))
    return old.unionByName(new)


def append_misses(requests: DataFrame, memo: DataFrame, compute: Column, path: str) -> None:
    """Append the newly computed rows to the memo folder."""
    _, misses = split_requests(requests, memo)
    misses.select(KEY, compute.alias(VALUE)).write.mode("append").parquet(path)
