"""Embedding whitening with MLlib's BlockMatrix.

Entries become integers, so sums, means and deviations are exact: a centred entry is (n * x - S) / n, subtracted before anything
is rounded. Centred rows are numbered, indexed into a distributed BlockMatrix, and multiplied by their transpose for the
scatter matrix, which is as wide as a vector and goes to the driver for its eigenvectors. A second BlockMatrix product with the
whitening matrix (eigenvectors over root eigenvalues) projects all rows. The product of a matrix with its transpose has a single result
block: its middle dimension is split (``numMidDimSplits``), so each split adds up its own row blocks and only dim x dim partial sums meet.

Rows without vector, or with a NULL or non-finite entry, are dropped. Defined results: shorter vectors count as padded with entries
of 0; scaled entries beyond 9e18 are cut to it; rows keep their vec_id, NULL and repeated ones too; a component without variance (rank
deficient or single rows) has whitened NULL and takes no part in identity_error; a deviation beyond 64 bits is NULL; explained is NULL
if the trace is 0; an empty table, or one of empty vectors, gives no rows.
"""
from __future__ import annotations

from decimal import Decimal

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialise

ROWS_PER_BLOCK, COLS_PER_BLOCK = 2048, 1024
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
WHOLE = "decimal(38,0)"


def integers(entries: Column, scale: float, offset: int) -> Column:
    """floor(scale * entry) + offset as longs."""
    return F.transform(entries, lambda c: F.floor(F.greatest(F.least(c * F.lit(scale), F.lit(9e18)), F.lit(-9e18))) + F.lit(offset))


def usable(table: DataFrame) -> DataFrame:
    """vec_id and entries as doubles of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull())
    return rows.filter(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``index`` 0, 1, 2, ...: positions inside written partitions, plus the rows of the partitions before (one row each)."""
    at = F.monotonically_increasing_id()
    held = materialise(rows.withColumn("part", F.shiftright(at, 33)).withColumn("pos", at.bitwiseAND(F.lit((1 << 33) - 1))))
    before = F.coalesce(F.sum("count").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = held.groupBy(F.col("part").alias("p")).count().select("p", before.alias("start"))
    return held.join(starts, F.col("part") == F.col("p")).select((F.col("start") + F.col("pos")).alias("index"), *rows.columns)


def block_matrix(rows: DataFrame, column: str, n: int, dim: int, rows_per_block: int) -> BlockMatrix:
    """The array column of numbered rows as a BlockMatrix."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector(column).alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, dim).toBlockMatrix(rows_per_block, min(COLS_PER_BLOCK, dim))


def product(left: BlockMatrix, right: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """``left.multiply(right)`` with the middle dimension in ``splits`` parts, an argument the Python wrapper leaves out."""
    out = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(out, left.rowsPerBlock, right.colsPerBlock)


def scatter(matrix: BlockMatrix, n: int, rows_per_block: int) -> np.ndarray:
    """transpose x matrix, dim x dim, as a local array."""
    splits = max(1, min(-(-n // rows_per_block), 4 * matrix.blocks.getNumPartitions()))
    local = product(matrix.transpose(), matrix, splits).toLocalMatrix()
    return local.toArray()


def whiten(table: DataFrame, scale: float = 64.0, offset: int = 1_000_000, components: int = 32,
           rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every remaining row and component."""
    spark = table.sparkSession
    rows = usable(table).select("vec_id", integers(F.col("v"), scale, offset).alias("x"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    n, dim = size["n"], size["d"] or 0
    if not n or not dim:
        return spark.createDataFrame([], SCHEMA)
    rows = numbered(rows.select("vec_id", F.concat("x", F.array_repeat(F.lit(offset).cast("long"), F.lit(dim) - F.size("x"))).alias("x")))
    sums = dict(rows.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.sum(F.col("v").cast("decimal(20,0)"))).collect())     # one row a dimension
    total = F.array(*[F.lit(Decimal(int(sums[d]))).cast(WHOLE) for d in range(dim)])
    times_n = F.zip_with("x", total, lambda x, s: x.cast("decimal(20,0)") * F.lit(Decimal(n)).cast("decimal(18,0)") - s)
    apart = rows.withColumn("d", times_n)
    centred = apart.select("index", F.transform("d", lambda x: x.cast("double") / F.lit(float(n))).alias("c"))

    x = block_matrix(centred, "c", n, dim, rows_per_block)
    v = scatter(x, n, rows_per_block) / n
    e, u = np.linalg.eigh((v + v.T) / 2)
    keep = min(components, dim)
    e, u = e[::-1][:keep], u[:, ::-1][:, :keep]
    trace = float(np.trace(v))
    alive = e > max(e[0], 0.0) * dim * 1e-15                        # below this an eigenvalue is rounding
    w = np.where(alive, u / np.sqrt(np.where(alive, e, 1.0)), 0.0)
    local = spark.createDataFrame([(i, [float(a) for a in row]) for i, row in enumerate(w)], "index long, c array<double>")
    projected = product(x, block_matrix(local, "c", dim, keep, min(COLS_PER_BLOCK, dim)))
    by_row = callMLlibFunc("getIndexedRows", projected.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    white = materialise(by_row.select("index", vector_to_array("vector").alias("w")))

    error = None
    if alive.any():
        mean = dict(white.select(F.posexplode("w").alias("k", "v")).groupBy("k").agg(F.avg("v")).collect())
        means = F.array(*[F.lit(float(mean[k])) for k in range(keep)])
        again = block_matrix(white.select("index", F.zip_with("w", means, lambda a, m: a - m).alias("c")), "c", n, keep, rows_per_block)
        gap = np.abs(scatter(again, n, rows_per_block) / n - np.eye(keep))
        error = float(gap[np.ix_(alive, alive)].max())

    squares = F.aggregate("d", F.lit(0).cast(WHOLE), lambda a, x: F.try_add(a, F.try_multiply(x, x)).cast(WHOLE))
    deviation = apart.select(F.col("index").alias("i"), "vec_id", squares.try_cast("long").alias("deviation"))
    out = deviation.join(white, F.col("i") == F.col("index")).select("vec_id", "deviation", F.posexplode("w").alias("k", "w"))
    share = F.array(*[F.lit(float(a / trace) if trace > 0 else None).cast("double") for a in e])
    has = F.array(*[F.lit(bool(a)) for a in alive])
    return out.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
                      F.when(has[F.col("k")], F.col("w")).alias("whitened"), share[F.col("k")].alias("explained"), F.lit(error).cast("double").alias("identity_error"))
