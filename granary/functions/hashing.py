"""Identifiers, shards and seeded order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_shard(key: Column, shards: int) -> Column:
    """First eight bytes of SHA-256, little-endian, modulo the number of shards."""
    h = F.sha2(key.cast("string"), 256)
    back = F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(7, -1, -1)])
    return F.pmod(F.conv(back, 16, 10).cast("decimal(20,0)"), F.lit(shards)).cast("int")


def short_hash(*parts: Column, digits: int = 16) -> Column:
    """Leading hex digits of SHA-256 of the parts joined by line ends."""
    return F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, digits)


def seeded(key: Column, seed: int) -> Column:
    """A fixed pseudo-random order of keys."""
    return F.sha2(F.concat(key.cast("string"), F.lit(f"|{seed}")), 256)
