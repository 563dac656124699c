"""The corpus pipeline: documents of a recognised language, without repeated lines and near duplicates, mixed to target
weights, as token ids.

Every stage takes (spark, docs, sf_dir), works on all rows it is given and returns the columns of documents; the last returns
tokens. ``n_chars`` follows the text. Stages may be run one by one, each from the Parquet the one before has written.

The last stage writes its table itself: batches are bounded by bytes only while ``materialise`` writes. The others return a plan, which ``run``
writes: one more copy of the texts would not fit the disk beside the intermediates of near duplicates.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from recurra.llm import automaton, langid, lines, mixing, parity
from recurra.llm.common import materialise, table

TOKENIZER = "byte_bpe_50k.json"


def _measured(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.select(*[F.length("text").cast(kind).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in no language that the given documents teach, go."""
    return langid.keep_identified(docs, langid.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of lines go; so do documents of which nothing is left."""
    runs = "deleted_runs"
    while runs in docs.columns:
        runs += "_"
    done = lines.dedup_lines(docs, runs_name=runs)
    return _measured(done.filter(F.col(runs).isNull() | (F.col("text") != "")).drop(runs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays."""
    return parity.keep_one(docs, width=5, per=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are cut to the words the mix takes; documents of which nothing is taken go."""
    return _measured(mixing.apply_mix(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests of every document that is left."""
    return materialise(automaton.encode_decode(docs, public_tokenizers.path(TOKENIZER), keep_ids=True, memo=150_000))        # its executors hold the other stages' memory too


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mix", mix), ("tokens", tokens)]

ORACLE_SQL = None            # Bloom filters and a tokenizer: see tests/llm for the brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
