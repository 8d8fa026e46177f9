"""Repeatable randomness: a value depends on seed and id only, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HASH_RANGE = float(1 << 60)


def h(seed: Column | int | str, ident: Column | str) -> Column:
    """60-bit hash of (seed, id) as BIGINT."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    ident = ident if isinstance(ident, Column) else F.col(ident)
    text = F.concat(seed.cast("string"), F.lit("|"), ident.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def u01(seed: Column | int | str, ident: Column | str) -> Column:
    """Uniform double in [0, 1)."""
    return h(seed, ident).cast("double") / F.lit(HASH_RANGE)

