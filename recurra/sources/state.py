"""Saving and restoring a consolidation state."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import ledger

META = "meta"
STORED = "ledger_ends"


def save_state(tables: Mapping[str, DataFrame], config_digest: str, path: str, chain: str = "chain_id") -> None:
    """Each table as Parquet, plus the digest of the settings that made it. A ``ledger`` needs its ``ledger_heads`` (the levels above
    it) beside it; the head and length of each chain are stored with them."""
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    if "ledger" in tables:
        back = [spark.read.parquet(f"{path}/{n}") for n in ("ledger", "ledger_heads")]
        ledger.chain_heads(*back, chain).write.parquet(f"{path}/{STORED}")
    spark.createDataFrame([(config_digest,)], "config_digest string").coalesce(1).write.parquet(f"{path}/{META}")


def load_state(spark: SparkSession, names: list[str], config_digest: str, path: str, chain: str = "chain_id", segment: int = ledger.SEGMENT) -> dict[str, DataFrame]:
    """Read the tables back; refuse other settings or a ledger that does not verify against its stored heads."""
    stored = spark.read.parquet(f"{path}/{META}").head()[0]
    if stored != config_digest:
        raise ValueError("settings differ from the saved ones")
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in names}
    if "ledger" in names:
        heads, ends = (spark.read.parquet(f"{path}/{n}") for n in ("ledger_heads", STORED))
        bad = ledger.verify(tables["ledger"], heads, ends, chain, segment).filter(~F.col("ok")).orderBy(chain).head()
        if bad:
            raise ValueError(f"ledger of {chain} {bad[chain]} fails at entry {bad['first_bad_seq']}")
    return tables
