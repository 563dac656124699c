"""Content digests that need no ordering and no collected group."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_WORDS = ((1, 15), (16, 15), (31, 15), (46, 15))


def canonical(*cols: str) -> Column:
    """Compact JSON of the named columns, keys sorted."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(cols)]), {"ignoreNullFields": "false"})


def content_digest(*cols: str) -> Column:
    return F.sha2(canonical(*cols), 256)


def hex_word(hex_text: Column, start: int = 1, length: int = 15) -> Column:
    """60 bits of a hex digest as a non-negative long."""
    return F.conv(F.substring(hex_text, start, length), 16, 10).cast("long")


def set_digest(member: Column, keep: Column | None = None) -> Column:
    """Aggregate: digest of a set of distinct strings, whatever their order.

    Four 60-bit words of each member's sha256 are added up (decimal, exact)
    and the count and sums hashed. Partial sums combine map-side, so a set of
    any size costs one small row per task, unlike sorting it in one place.
    """
    h = F.sha2(member, 256)
    parts = [F.coalesce(F.sum(F.when(keep if keep is not None else F.lit(True), hex_word(h, s, n).cast("decimal(38,0)"))), F.lit(0).cast("decimal(38,0)")).cast("string")
             for s, n in _WORDS]
    n = F.count(F.when(keep if keep is not None else F.lit(True), member)).cast("string")
    return F.sha2(F.concat_ws(":", n, *parts), 256)


def set_digest_sql(member: str, keep: str = "true") -> str:
    """The same aggregate as SQL text (for the oracle queries)."""
    sums = ", ".join(
        f"coalesce(sum(CASE WHEN {keep} THEN ('0x'||substr(sha256({member}),{s},{n}))::HUGEINT END),0)::VARCHAR" for s, n in _WORDS)
    return f"sha256(concat_ws(':', count(CASE WHEN {keep} THEN {member} END)::VARCHAR, {sums}))"


def draw(seed: Column | str, *parts: Column | str) -> Column:
    """Counter-based pseudo-random long, the same on every partitioning."""
    cols = [F.lit(seed) if isinstance(seed, str) else seed, *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]]
    return hex_word(F.md5(F.concat_ws(":", *cols)))


PRIME = 2 ** 31 - 1
# Round constants of the counter-based generator.
ROUNDS = (911382323, 1442695041, 362436069)


def with_counter_draw(df: DataFrame, key: Column, counter: Column, name: str) -> DataFrame:
    """Add a pseudo-random long in [0, PRIME) made from a key and a counter, integer arithmetic only.

    x -> x^5 permutes the residues of this prime; three rounds with added constants mix the
    counter. Much cheaper per draw than a digest, and the same in any SQL engine. Every step is
    its own column, so no step is computed twice.
    """
    out = df.withColumn(name, F.pmod(key + counter, F.lit(PRIME)))
    x, y, y2 = F.col(name), F.col("__y"), F.col("__y2")
    for c in ROUNDS:
        out = out.withColumn("__y", (x + F.lit(c)) % PRIME).withColumn("__y2", (y * y) % PRIME).withColumn(name, (((y2 * y2) % PRIME) * y) % PRIME)
    return out.drop("__y", "__y2")


def counter_draw_sql(key: str, counter: str) -> str:
    """The same draw as SQL text (for the oracle queries)."""
    rounds = ", ".join(str(c) for c in ROUNDS)
    fold = f"lambda x, c: ((((((x + c) % {PRIME}) * ((x + c) % {PRIME})) % {PRIME}) * ((((x + c) % {PRIME}) * ((x + c) % {PRIME})) % {PRIME})) % {PRIME}) * ((x + c) % {PRIME}) % {PRIME}"
    return f"list_reduce([({key} + {counter}) % {PRIME}, {rounds}]::BIGINT[], {fold})"
