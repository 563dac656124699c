"""Reading, validating, de-duplicating and writing record collections."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..session import materialise

CORRUPT = "_corrupt_record"
CSV_OPTIONS = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}

TASK_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in (
        "instance_id", "repo", "base_commit", "created_at", "problem_statement", "patch",
        "test_patch", "environment_setup_commit", "hints_text", "FAIL_TO_PASS", "PASS_TO_PASS")])


def read_records(spark: SparkSession, path: str, schema: T.StructType, fmt: str | None = None) -> DataFrame:
    """JSON array (``.json``), JSON lines, CSV with header, Parquet or ORC with an explicit schema.

    Broken JSON rows are kept, their text in ``_corrupt_record``.
    """
    kind = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("json", "jsonl"):
        full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        return (spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
                .option("multiLine", kind == "json").json(path))
    reader = spark.read.schema(schema)
    if kind == "csv":
        return reader.options(**CSV_OPTIONS, multiLine=True).csv(path)
    return reader.format(kind).load(path)


def check_required(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Add ``ok`` and ``reason`` (the missing names); empty text counts as missing."""
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(c)) for c in required]))
    out = df.withColumn("__missing", missing)
    return (out.withColumn("ok", F.size("__missing") == 0)
            .withColumn("reason", F.when(~F.col("ok"), F.concat(F.lit("missing "), F.array_join("__missing", ","))).otherwise(F.lit("")))
            .drop("__missing"))


def keep_first(df: DataFrame, ids: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per id in source order plus ``n_dropped``.

    An aggregate over a struct, not a window: copies of one id are combined map-side.
    """
    rest = [c for c in df.columns if c not in ids and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("__first")
    out = df.groupBy(*ids).agg(first, (F.count("*") - 1).alias("n_dropped"))
    return out.select(*ids, *[F.col(f"__first.{c}").alias(c) for c in [*order, *rest]], "n_dropped")


def union_splits(splits: Sequence[tuple[str, DataFrame]], ids: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Concatenate named splits; the earliest named split wins an id."""
    all_rows = None
    for i, (name, df) in enumerate(splits):
        part = df.withColumn("split_ord", F.lit(i)).withColumn("split", F.lit(name))
        all_rows = part if all_rows is None else all_rows.unionByName(part)
    return keep_first(all_rows, ids, ["split_ord", *order])


def write_sorted_json(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Globally ordered JSON lines: range-partitioned files, each sorted."""
    df.orderBy(*order).write.json(path)


def write_with_verdicts(data: DataFrame, verdict_columns: Sequence[str], admitted: Column, path: str) -> None:
    """Accepted rows and the full verdict table side by side, both from one evaluation of ``data``."""
    data = materialise(data)
    data.filter(admitted).drop(*[c for c in verdict_columns if c not in ("instance_id", "task_id")]).write.json(f"{path}/accepted")
    data.select(*verdict_columns).write.json(f"{path}/verdicts")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.options(**CSV_OPTIONS).csv(path)


def explode_arms(nested: DataFrame, task: str, arms: str = "arms") -> DataFrame:
    """Nested ``map<arm, array<key>>`` per task -> (arm, task, rank, key) rows."""
    per_arm = nested.select(task, F.explode(arms).alias("arm", "keys"))
    return per_arm.select("arm", task, F.posexplode("keys").alias("pos", "fkey")).select("arm", task, (F.col("pos") + 1).alias("rank"), "fkey")


def corpus_from_changes(changes: DataFrame, reasons: Sequence[tuple[str, Column]]) -> DataFrame:
    """Mark each change with the first drop reason that applies (NULL = kept)."""
    reason = F.lit(None).cast("string")
    for name, cond in reversed(list(reasons)):
        reason = F.when(cond, F.lit(name)).otherwise(reason)
    return changes.withColumn("drop_reason", reason)
