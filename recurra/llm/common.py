"""What the operators share: input columns, learning rows, written intermediates, Arrow batch sizes."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialise as write_and_read

WORD = r"[^\x20\x09-\x0D]+"          # fixed value: the word pattern of the contracts
BATCH_BYTES = 4 << 20
LONG_KEY = 64
MEMO_LIMIT = 400_000                 # entries of a generation of a task's memo: bounds memory (about 300 bytes each, two generations), not results


class Memo(dict):
    """A memo of two generations: when the young one is full it becomes the old one, and what is used again is taken over. Keys of over
    ``LONG_KEY`` characters are made anew each time, so that entries, and with them memory, are bounded."""

    def __init__(self, make, limit: int = MEMO_LIMIT) -> None:
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: str) :
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > LONG_KEY:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def materialise(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Cut lineage by a written table. While it is written, batches for Python are bounded by ``BATCH_BYTES``; the session's setting is put back."""
    spark = spark or df.sparkSession
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)                            # None: not set, the default holds
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        return write_and_read(df, spark)
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3 (NULL for a NULL id)."""
    return F.crc32(doc_id.cast("string")) % 3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 1, F.lit(False))


def draw(*key: Column) -> Column:
    """A uniform number in [0, 1) that depends on the key columns alone."""
    return (F.xxhash64(*key, F.lit(17)).bitwiseAND(F.lit((1 << 40) - 1))) / F.lit(float(1 << 40))


def bounded_sample(rows: DataFrame, by: str, id_col: str, bound: int) -> DataFrame:
    """About ``bound`` rows of each value of ``by``, chosen by hash of the id: the share follows from the
    counts, so nothing is sorted and no group meets in one task. Copies of an id stay together."""
    counts = rows.groupBy(by).count().withColumn("share", F.lit(float(bound)) / F.col("count")).drop("count")
    counts = counts.withColumnRenamed(by, "__by")
    return (rows.join(counts, rows[by].eqNullSafe(F.col("__by")))
            .filter(draw(F.col(id_col).cast("string")) < F.col("share")).drop("__by", "share"))


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def batches_of(fn):
    """A function for ``mapInArrow`` that applies ``fn`` to slices of bounded size. Arrow keeps NULL ids and long
    ids exact, which pandas does not."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield fn(b)
    return run


def slices(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that none holds more than about ``most`` bytes, nor is empty: memory follows from bytes, whatever the session's batch sizes."""
    for b in batches:
        if b.num_rows:
            step = max(1, int(b.num_rows * most / max(1, b.nbytes)))
            stack = [(i, min(step, b.num_rows - i)) for i in range(0, b.num_rows, step)][::-1]
            while stack:
                at, n = stack.pop()
                part = b.slice(at, n)
                if n > 1 and part.nbytes > 2 * most:
                    stack += [(at + n // 2, n - n // 2), (at, n // 2)]
                else:
                    yield part


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def salted_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str, salt_by: Column, salts: int = 16) -> DataFrame:
    """An equi-join of a table with hot keys (left) and one with a row per key (right): the left side is spread over ``salts``
    tasks a key, the right side is repeated for each. The right side's columns must not clash with the left's."""
    l = left.withColumn("__salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    r = right.withColumn("__rsalt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return l.join(r, (F.col(left_key) == F.col(right_key)) & (F.col("__salt") == F.col("__rsalt")), how).drop("__salt", "__rsalt")


def hot_join(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], salt_by: Column, buckets: int = 4096, salts: int = 32) -> DataFrame:
    """An inner equi-join of a written table with hot keys (left) and one with a row per key (right). Keys are counted by hash bucket (a bounded
    number of counts); only in buckets with over four times the mean is the left side spread over ``salts`` tasks and the right side repeated."""
    bucket = lambda keys: F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")           # noqa: E731
    counts = left.groupBy(bucket(left_keys).alias("b")).count().collect()
    mean = sum(r["count"] for r in counts) / max(1, buckets)
    hot = [r["b"] for r in counts if r["count"] > 4 * mean + 1000]                        # fewer than a quarter of the buckets
    in_hot = (lambda keys: bucket(keys).isin(hot)) if hot else (lambda keys: F.lit(False))
    l = left.withColumn("__salt", F.when(in_hot(left_keys), F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int")).otherwise(0))
    r = right.withColumn("__rsalt", F.explode(F.when(in_hot(right_keys), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    on = F.col("__salt") == F.col("__rsalt")
    for a, b in zip(left_keys, right_keys):
        on &= F.col(a) == F.col(b)
    return l.join(r, on).drop("__salt", "__rsalt")
