"""Hashes of keys and values, and the segments of hash trees.

A key's MD5 gives a 16-bit segment, 32 more bits for larger trees and 32 bits to mix with a value's hash.
Values without a hash of their own get the first 32 bits of the MD5 of their text. All results are longs >= 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The number of branches of a tree by the name of its size; a branch has 256 leaves.
TREE_SIZES = {"xxsmall": 16, "xsmall": 64, "small": 256, "medium": 1024, "large": 4096, "xlarge": 16384}
LEAVES = 256


def _bits(digest: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def segment_hash(key: Column) -> Column:
    """struct(seg16, extra32, alt32) of a canonical key."""
    digest = F.md5(key.cast("binary"))
    return F.struct(_bits(digest, 1, 4).alias("seg16"), _bits(digest, 5, 8).alias("extra32"), _bits(digest, 13, 8).alias("alt32"))


def segment32(h: Column) -> Column:
    """The 32-bit segment: the low half of extra32 above seg16."""
    return F.shiftleft(h["extra32"].bitwiseAND(65_535), 16).bitwiseOR(h["seg16"])


def tree_segment(seg32: Column, size: str) -> Column:
    """The leaf of a tree of that size."""
    return seg32.bitwiseAND(TREE_SIZES[size] * LEAVES - 1)


def value_hash(value: Column) -> Column:
    return _bits(F.md5(value.cast("binary")), 1, 8)


def change_hash(h: Column, of_value: Column) -> Column:
    """What a key and its value's hash add to a leaf."""
    return h["alt32"].bitwiseXOR(of_value)


def magic_hash(codes: Column) -> Column:
    """The 32-bit multiply-and-xor hash (start 5381, factor 33) of an array of bytes as integers."""
    return F.aggregate(codes, F.lit(5381).cast("long"), lambda a, b: (a * 33).bitwiseAND(0xFFFFFFFF).bitwiseXOR(b.cast("long")))
