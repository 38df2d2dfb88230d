"""Key hashing: the partition a keyed message goes to, and reproducible random draws."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters of 32-bit MurmurHash2 as used to place keyed messages.
MURMUR_SEED = 0x9747B28C
MURMUR_MULTIPLIER = 0x5BD1E995
MASK32 = 0xFFFFFFFF
MASK31 = 0x7FFFFFFF


def _hash_udf():
    # a local function travels to the workers by value, so they need not have this package
    def hash_batch(keys: pa.Array) -> pa.Array:
        """MurmurHash2 of every key of an Arrow batch, all keys at once, four bytes per step."""
        data = keys.cast(pa.binary())
        ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset:][: len(data) + 1].astype(np.int64)
        body = data.buffers()[2]
        raw = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
        raw = np.append(raw, np.zeros(4, np.uint8)).astype(np.uint64)
        start, size = ends[:-1], np.diff(ends)
        multiplier, mask = np.uint64(MURMUR_MULTIPLIER), np.uint64(MASK32)

        def times(x):
            return x * multiplier & mask

        def fold(x, bits):
            return x ^ x >> np.uint64(bits)

        def word(at, count):
            return sum(raw[at + i] << np.uint64(8 * i) for i in range(count))

        h = np.uint64(MURMUR_SEED) ^ size.astype(np.uint64)
        words = size // 4
        for w in range(int(words.max(initial=0))):
            rows = np.flatnonzero(words > w)
            h[rows] = times(h[rows]) ^ times(fold(times(word(start[rows] + 4 * w, 4)), 24))
        for left in (1, 2, 3):
            rows = np.flatnonzero(size % 4 == left)
            h[rows] = times(h[rows] ^ word(start[rows] + 4 * words[rows], left))
        h = fold(times(fold(h, 13)), 15)
        return pa.array(h.astype(np.int64), pa.int64(), mask=keys.is_null().to_numpy(zero_copy_only=False))

    return F.arrow_udf(hash_batch, "bigint")


def murmur2(key: Column) -> Column:
    """Unsigned MurmurHash2 of the key's UTF-8 bytes, as a bigint; null for a null key.

    Spark has no such function.  Whole Arrow batches are hashed at once, which is
    several times faster than the same arithmetic over SQL byte functions.
    """
    return _hash_udf()(key)


def topic_partition(key: Column, partitions: int) -> Column:
    """Partition of a keyed message; null for a null key."""
    return (murmur2(key).bitwiseAND(F.lit(MASK31)) % partitions).cast("int")


def draw(salt: str, *identity: Column) -> Column:
    """A number in [0, 2^32) that depends only on the salt and the row's identity."""
    text = F.concat_ws(":", F.lit(salt), *[c.cast("string") for c in identity])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def chance(salt: str, rate: float, *identity: Column) -> Column:
    """True for about ``rate`` of the rows, always the same ones."""
    return draw(salt, *identity) < F.lit(int(rate * 2**32)).cast("bigint")
