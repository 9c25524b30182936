"""Hashes and partition numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 64-bit FNV-1a (fixed values)
FNV_OFFSET = 14695981039346656037
FNV_PRIME = 1099511628211

_LOW = 0xFFFFFFFF


def xxhash64(text: Column, seed: int | None = None) -> Column:
    """64-bit xxHash of the text; with a seed, of the seed and the text."""
    return F.xxhash64(text) if seed is None else F.xxhash64(F.lit(seed).cast("long"), text)


def xxhash3(text: Column) -> Column:
    """A second, independent 64-bit hash; only stability and range are promised, not the bits of any library."""
    return F.xxhash64(F.lit("3"), text)


def partition_hash(text: Column, partitions: int) -> Column:
    """A number from 0 to below ``partitions``."""
    if partitions < 1:
        raise ValueError("partitions must be positive")
    return F.pmod(F.xxhash64(text), F.lit(partitions))


def stream_partition(store: str, stream: Column, partitions: int) -> Column:
    """Partition of a stream within a store; equal stream ids of two stores may part."""
    return F.pmod(F.xxhash64(F.concat(F.lit(store), F.lit("\0"), stream)), F.lit(partitions))


def partition_hash_batch(texts: Column, partitions: int) -> Column:
    """``partition_hash`` of each item of an array."""
    return F.transform(texts, lambda t: partition_hash(t, partitions))


def fast_phash(value: Column, size: int) -> Column:
    return F.pmod(F.hash(value), F.lit(size))


def fnv1a(text: Column) -> Column:
    """64-bit FNV-1a of the text's bytes, unsigned as DECIMAL(20,0); null for null.

    The state is kept as two halves of 32 bits, so that no product leaves the long range:
    times the prime, which is 2^40 + 435, is a product by 435 and a shift of the low half.
    """
    digits = F.hex(text.cast("binary"))
    octets = F.transform(F.filter(F.sequence(F.lit(0), (F.length(digits) / 2).cast("int")), lambda i: i >= 1), lambda i: F.conv(F.substring(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("long"))
    start = F.struct(F.lit(FNV_OFFSET >> 32).cast("long").alias("hi"), F.lit(FNV_OFFSET & _LOW).cast("long").alias("lo"))
    small = FNV_PRIME - (1 << 40)

    def step(h: Column, octet: Column) -> Column:
        low = h["lo"].bitwiseXOR(octet)
        product = low * small
        carry = F.shiftright(product, 32)
        high = h["hi"] * small + carry + F.shiftleft(low, 8).bitwiseAND(F.lit(_LOW))
        return F.struct(high.bitwiseAND(F.lit(_LOW)).alias("hi"), product.bitwiseAND(F.lit(_LOW)).alias("lo"))

    whole = F.aggregate(octets, start, step, lambda h: h["hi"].cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(20,0)") + h["lo"].cast("decimal(20,0)"))
    return F.when(text.isNotNull(), whole.cast("decimal(20,0)"))
