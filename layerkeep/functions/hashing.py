"""The stable hash that deals keys to shards, unsigned 64-bit keys, and checksums.

The hash is a 64-bit mixer (the public SplitMix64 finaliser) of the key, a seed
and a version. As a Column it works on the bit pattern of the key in a long,
with wrap-around arithmetic: the expression is built while ANSI overflow checks
are off, which fixes its evaluation, and the setting is restored at once.
"""

from __future__ import annotations

import threading
from decimal import Decimal

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArgument

MASK = 2**64 - 1
# The mixer's constants and the multiplier of the version.
STEP, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
VERSION_STEP = 0xD6E8FEB86659FD93
# FNV-1a, 64 bits.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3

_conf_lock = threading.Lock()


def signed(x: int) -> int:
    """The long that has the same bits."""
    x &= MASK
    return x - 2**64 if x >= 2**63 else x


def unsigned(x: int) -> int:
    return x & MASK


def stable_hash(key: int, seed: int = 0, version: int = 1) -> int:
    x = (key ^ seed ^ (version * VERSION_STEP)) & MASK
    x = (x + STEP) & MASK
    x = ((x ^ (x >> 30)) * FIRST) & MASK
    x = ((x ^ (x >> 27)) * SECOND) & MASK
    return x ^ (x >> 31)


def is_power_of_two(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def check_shard_count(n: int) -> int:
    if not is_power_of_two(n) or n > 2**31:
        raise InvalidArgument(f"shard count {n} is no power of two")
    return n


def shard_for(key: int, shards: int, seed: int = 0, version: int = 1) -> int:
    return stable_hash(key, seed, version) & (check_shard_count(shards) - 1)


def tag(hashed: int) -> int:
    """The top seven bits of a hash."""
    return unsigned(hashed) >> 57


def index_capacity(rows: int) -> int:
    """The least power of two, 16 at least, that is no more than 7/8 full."""
    need = max(16, -(-8 * rows // 7))
    return 1 << (need - 1).bit_length()


def fnv1a(data: bytes) -> int:
    out = FNV_BASIS
    for b in data:
        out = ((out ^ b) * FNV_PRIME) & MASK
    return out


def whole(x: int) -> Column:
    """A literal that no long holds."""
    return F.lit(Decimal(x))


def key_bits(key: Column) -> Column:
    """The long with the bits of an unsigned decimal key."""
    wide = key.cast("decimal(20,0)")
    return F.when(wide > whole(2**63 - 1), (wide - whole(2**64)).cast("long")).otherwise(wide.cast("long"))


def key_unsigned(bits: Column) -> Column:
    """The unsigned decimal key of a bit pattern."""
    wide = bits.cast("decimal(20,0)")
    return F.when(bits < 0, wide + whole(2**64)).otherwise(wide).cast("decimal(20,0)")


def unsigned_order(bits: Column) -> Column:
    """A long that orders bit patterns as unsigned numbers."""
    return bits.bitwiseXOR(F.lit(-(2**63)))


def _mixed(x: Column, seed: int, version: int) -> Column:
    lit = lambda v: F.lit(signed(v)).cast("long")
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    x = x.bitwiseXOR(lit(seed ^ (version * VERSION_STEP))) + lit(STEP)
    x = let(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 30)) * lit(FIRST))
    x = let(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 27)) * lit(SECOND))
    return let(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 31)))


def with_hash(df, key: str = "pk", out: str = "hash", seed: int = 0, version: int = 1):
    """``df`` with the stable hash (bit pattern) of a long column of key bits."""
    spark: SparkSession = df.sparkSession
    with _conf_lock:
        held = spark.conf.get("spark.sql.ansi.enabled")
        spark.conf.set("spark.sql.ansi.enabled", "false")
        try:
            made = df.withColumn(out, _mixed(F.col(key).cast("long"), seed, version))
            made.schema  # noqa: B018  analysed while the checks are off
            return made
        finally:
            spark.conf.set("spark.sql.ansi.enabled", held)


def with_shard(df, shards: int, key: str = "pk", out: str = "shard_id", seed: int = 0, version: int = 1):
    """``df`` with the shard of each key."""
    check_shard_count(shards)
    hashed = with_hash(df, key, "__hash", seed, version)
    return hashed.withColumn(out, F.col("__hash").bitwiseAND(F.lit(shards - 1).cast("long")).cast("int")).drop("__hash")
