"""Keys of the form ``path::Class.method`` and path classification."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

LEVELS = ("file", "class", "function")

# What makes a path a test path.
TEST_DIRS = ("tests", "test", "__tests__", "e2e")
TEST_NAME_PREFIXES = ("test_", "playwright.config")
TEST_PATH_SUFFIXES = ("_test.py", "conftest.py")
TEST_NAME_PARTS = (".test.", ".spec.")
# The second, independent rule.
STRICT_TEST_DIRS = ("test", "tests", "testing")


def file_of(key: Column) -> Column:
    return F.substring_index(key, "::", 1)


def symbol_of(key: Column) -> Column:
    """Text after the first ``::`` (empty when there is none)."""
    return F.regexp_extract(key, r"^[\s\S]*?::([\s\S]*)$", 1)


def class_of(key: Column) -> Column:
    return F.concat(file_of(key), F.lit("::"), F.substring_index(symbol_of(key), ".", 1))


def dir_of(key: Column) -> Column:
    """File of a function key, else parent directory, else ``.``."""
    return (F.when(F.instr(key, "::") > 0, file_of(key))
            .when(F.instr(key, "/") > 0, F.regexp_replace(key, r"/[^/]*$", ""))
            .otherwise(F.lit(".")))


def key_at(level: str, key: Column) -> Column:
    return {"file": file_of, "class": class_of, "function": lambda k: k}[level](key)


def is_test_path(path: Column) -> Column:
    p = F.lower(path)
    name = F.substring_index(p, "/", -1)
    hit = F.contains(F.substring_index(p, "/", 1), F.lit("test"))
    for d in TEST_DIRS:
        hit = hit | F.contains(F.concat(F.lit("/"), p), F.lit(f"/{d}/"))
    for x in TEST_NAME_PREFIXES:
        hit = hit | F.startswith(name, F.lit(x))
    for x in TEST_PATH_SUFFIXES:
        hit = hit | F.endswith(p, F.lit(x))
    for x in TEST_NAME_PARTS:
        hit = hit | F.contains(name, F.lit(x))
    return hit


def is_test_path_strict(path: Column) -> Column:
    """The second rule: a directory called exactly test/tests/testing, or a test file name."""
    parts = F.split(F.lower(path), "/")
    name = F.element_at(parts, -1)
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return (F.exists(dirs, lambda d: d.isin(*STRICT_TEST_DIRS)) | F.startswith(name, F.lit("test_"))
            | F.endswith(name, F.lit("_test.py")) | (name == "conftest.py"))


def has_suffix(path: Column, suffixes: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for s in suffixes:
        hit = hit | F.endswith(path, F.lit(s))
    return hit


def image_name(instance_id: Column) -> Column:
    return F.lower(F.replace(instance_id, F.lit("__"), F.lit("_1776_")))


def group_from_file(name: Column) -> Column:
    """First ``__`` back to ``/``."""
    return F.regexp_replace(name, r"^((?:(?!__)[\s\S])*)__", "$1/")
