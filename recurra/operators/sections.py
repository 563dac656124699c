"""Unified-diff sections, parsed inside the row: no shuffle, whole texts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.keys import has_suffix, is_test_path, is_test_path_strict

# The line shapes of a unified diff.
HEADER = "diff --git "
HEADER_FILE = r"^a/.+? b/([^\n]+)"
PLUS_FILE = r"(?m)^\+\+\+ b/([^\n]+)$"
MINUS_FILE = r"(?m)^--- a/([^\n]+)$"
HUNK = r"(?m)^@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@"


def _sections(patch: Column) -> Column:
    """Sections begin at header lines or, in a diff that has none, at ``+++ b/`` lines."""
    text = F.concat(F.lit("\n"), patch)
    parts = F.when(F.contains(text, F.lit("\n" + HEADER)), F.split(text, "\n" + HEADER)).otherwise(F.split(text, r"\n(?=\+\+\+ b/)"))
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def _file(section: Column) -> Column:
    """The ``+++ b/`` name wins over the header's, which covers renames."""
    plus = F.btrim(F.regexp_extract(section, PLUS_FILE, 1))
    return F.when(plus != "", plus).otherwise(F.regexp_extract(section, HEADER_FILE, 1))


def patch_files(patches: DataFrame, task: str, patch: str) -> DataFrame:
    """(task, path) of every section, once each."""
    files = F.array_distinct(F.transform(_sections(F.col(patch)), _file))
    return patches.select(task, F.explode(files).alias("path"))


def patch_hunks(patches: DataFrame, task: str, patch: str) -> DataFrame:
    """(task, path, start_line, end_line) of pre-image hunks; no length means 1, width at least 1."""
    secs = patches.select(task, F.explode(_sections(F.col(patch))).alias("s")).select(task, _file(F.col("s")).alias("path"), "s")
    both = secs.select(task, "path", F.explode(F.arrays_zip(
        F.regexp_extract_all("s", F.lit(HUNK), F.lit(1)).alias("a"), F.regexp_extract_all("s", F.lit(HUNK), F.lit(2)).alias("b"))).alias("h"))
    start = F.col("h.a").cast("int")
    length = F.when(F.col("h.b") == "", 1).otherwise(F.col("h.b").cast("int"))
    return both.filter(~F.endswith("path", F.lit("/dev/null"))).select(task, "path", start.alias("start_line"), (start + F.greatest(length, F.lit(1)) - 1).alias("end_line"))


def gold_keys(patches: DataFrame, task: str, patch: str, suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """(task, keys): sorted non-test files; with a suffix rule a task left with none is NULL, without one empty."""
    keep = lambda p: ~is_test_path(p) & (has_suffix(p, suffixes) if suffixes else F.lit(True))
    files = F.sort_array(F.filter(F.array_distinct(F.transform(_sections(F.col(patch)), _file)), keep))
    return patches.select(task, (F.when(F.size(files) > 0, files) if suffixes else files).alias("keys"))


def independent_files(patches: DataFrame, task: str, patch: str) -> DataFrame:
    """The second extractor: names on ``+++ b/`` and ``--- a/`` lines, its own test rule."""
    p = F.col(patch)
    names = F.concat(F.regexp_extract_all(p, F.lit(PLUS_FILE), F.lit(1)), F.regexp_extract_all(p, F.lit(MINUS_FILE), F.lit(1)))
    clean = F.filter(F.transform(names, F.btrim), lambda x: ~F.endswith(x, F.lit("/dev/null")) & ~is_test_path_strict(x))
    return patches.select(task, F.sort_array(F.array_distinct(clean)).alias("keys"))


def source_sections(patch: Column, suffixes: tuple[str, ...]) -> Column:
    """The patch with only its non-test source sections."""
    kept = F.filter(_sections(patch), lambda s: has_suffix(_file(s), suffixes) & ~is_test_path(_file(s)))
    return F.array_join(F.transform(kept, lambda s: F.concat(F.lit(HEADER), s)), "\n")


def lines_under_headers(texts: DataFrame, key: str, text: str, every: int) -> DataFrame:
    """(key, pos, header, line): each line with the header of its block, the first of every ``every`` lines.

    A text is one row, so the header is looked up in the row itself; nothing is shuffled.
    """
    lines = F.split(F.col(text), "\n")
    x = texts.select(key, lines.alias("__ls")).select(key, "__ls", F.posexplode("__ls").alias("pos", "line"))
    header = F.get(F.col("__ls"), (F.floor(F.col("pos") / every) * every).cast("int"))
    return x.select(key, "pos", header.alias("header"), "line")
