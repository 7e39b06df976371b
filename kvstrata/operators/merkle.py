"""XOR hash trees over states: sparse tables of (segment, leaf), where a leaf that is absent is zero.

A leaf is the XOR of what its keys add, so trees build by partial aggregation, merge by XOR, and change in place.
"""

from __future__ import annotations

import base64
import json
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvstrata.functions import hashing, tags
from kvstrata.functions.hashing import LEAVES, TREE_SIZES
from kvstrata.operators.state import KEYS


def tree(rows: DataFrame, size: str, key: Column, of_value: Column) -> DataFrame:
    """The tree of rows by their canonical key and the hash of their value. The shuffle carries at most one row per leaf and task."""
    h = hashing.segment_hash(key)
    hashed = rows.select(h.alias("h"), of_value.cast("long").alias("v"))
    return hashed.groupBy(hashing.tree_segment(hashing.segment32(F.col("h")), size).cast("int").alias("segment")).agg(F.bit_xor(hashing.change_hash(F.col("h"), F.col("v"))).alias("leaf")).filter("leaf <> 0")


def object_tree(state: DataFrame, size: str = "small") -> DataFrame:
    """The tree of heads by their object hashes."""
    return tree(state, size, tags.canonical_keys(F.col("tag"), *[F.col(k) for k in KEYS[1:]]), F.col("hash"))


def index_tree(postings: DataFrame, size: str = "small") -> DataFrame:
    """The tree of postings: key by hash of its term."""
    term = F.coalesce(F.col("term_s"), F.col("term_i").cast("string"))
    return tree(postings, size, F.col("key"), hashing.value_hash(term))


def root(of: DataFrame) -> DataFrame:
    """The hash of each branch: the XOR of its leaves."""
    return of.groupBy(F.shiftright("segment", 8).alias("branch")).agg(F.bit_xor("leaf").alias("hash"))


def leaves(of: DataFrame, branches: list[int]) -> DataFrame:
    return of.filter(F.shiftright("segment", 8).isin(branches))


def _differences(a: DataFrame, b: DataFrame, on: str, value: str) -> DataFrame:
    x, y = a.select(on, F.col(value).alias("x")), b.select(on, F.col(value).alias("y"))
    zero = F.lit(0).cast("long")
    return x.join(y, on, "full_outer").filter(F.coalesce("x", zero) != F.coalesce("y", zero)).select(on)


def dirty_branches(a: DataFrame, b: DataFrame) -> DataFrame:
    return _differences(root(a), root(b), "branch", "hash")


def dirty_leaves(a: DataFrame, b: DataFrame, sizes: tuple[str, str] | None = None) -> DataFrame:
    """Segments whose leaves differ; both trees must be of one size. ``sizes``, if they are given, are checked."""
    if sizes is not None and sizes[0] != sizes[1]:
        raise ValueError(f"trees of sizes {sizes[0]} and {sizes[1]} don't compare")
    return _differences(a, b, "segment", "leaf")


def new_tree(spark: SparkSession) -> DataFrame:
    """A tree without keys."""
    return spark.sql("SELECT 0 AS segment, 0L AS leaf WHERE false")


def merge(*trees: DataFrame) -> DataFrame:
    """The tree of the union of disjoint sets of keys."""
    whole = trees[0]
    for t in trees[1:]:
        whole = whole.unionByName(t)
    return whole.groupBy("segment").agg(F.bit_xor("leaf").alias("leaf")).filter("leaf <> 0")


def alter(of: DataFrame, changes: DataFrame) -> DataFrame:
    """The tree with the leaves of ``changes`` (segment, leaf) in place of its own; a zero empties a leaf."""
    return of.join(changes.select("segment"), "segment", "left_anti").unionByName(changes.select("segment", "leaf")).filter("leaf <> 0")


def valid_size(size: str) -> bool:
    return size in TREE_SIZES


def export_tree(of: DataFrame, size: str) -> str:
    """A tree as text. What is gathered is at most one number per leaf of its size."""
    if not valid_size(size):
        raise ValueError(f"unknown tree size {size}")
    rows = sorted((r["segment"], r["leaf"]) for r in of.collect())
    return json.dumps({"size": size, "leaves": base64.b64encode(zlib.compress(json.dumps(rows).encode())).decode()})


def import_tree(spark: SparkSession, text: str) -> tuple[str, DataFrame]:
    data = json.loads(text)
    rows = [tuple(r) for r in json.loads(zlib.decompress(base64.b64decode(data["leaves"])))]
    return data["size"], spark.createDataFrame(rows, "segment int, leaf long")


def segment_filter(segments: list[int], size: str) -> list[int] | None:
    """Segments of a tree as a filter on 16-bit segments; None where a filter would not pay.

    The smallest trees leave too many bits open; of the second smallest up to four segments are spelled out.
    """
    if size == "xxsmall":
        return None
    if size != "xsmall":
        return list(segments)
    if len(segments) > 4:
        return None
    return [s + high for s in segments for high in (0, 1 << 14, 1 << 15, (1 << 14) + (1 << 15))]


def adjust_segments(segments: list[int], compared: str, stored: str) -> list[int]:
    """The segments of the stored, larger tree that fall into segments of the compared one."""
    small, large = TREE_SIZES[compared] * LEAVES, TREE_SIZES[stored] * LEAVES
    return sorted(segments) if small >= large else sorted(s + k * small for s in segments for k in range(large // small))


def match_segment(a: tuple[int, str], b: tuple[int, str]) -> bool:
    """Whether segments of two trees are the same under the smaller of both."""
    mask = min(TREE_SIZES[a[1]], TREE_SIZES[b[1]]) * LEAVES - 1
    return a[0] & mask == b[0] & mask


def join_segment(branch: int, leaf: int) -> int:
    return (branch << 8) + leaf
