"""Scans of the state, as lazy DataFrames: indexes, buckets, keys, heads, objects, and named aggregates over them.

A bucket is a name, or a tuple of type and name; a plain name never finds typed buckets. Rows come in no order unless
``ordered`` asks for the order of the scan, which costs a sort.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvstrata.operators import reads
from kvstrata.operators.state import KEYS, Bucket, as_of, bucket_is, index, key_order, ledger, modified_within, same

#: More segments than these are joined, not spelled out in the condition; there are 65,536 at most.
SEGMENTS = 256


def _range(tag: str, bucket: Bucket | None, start: str | None, end: str | None) -> Column:
    where = F.col("tag") == tag
    for cond in (None if bucket is None else bucket_is(bucket), None if start is None else F.col("key") >= start, None if end is None else F.col("key") <= end):
        where = where if cond is None else where & cond
    return where


def index_range(journal: DataFrame, bucket: Bucket, field: str, start, end, *, start_key: str | None = None, regex: str | None = None, return_terms: bool = True, ordered: bool = False, **at) -> DataFrame:
    """Postings of terms in [start, end], both included; once for each term that a key has.

    ``start_key`` is where the scan starts: it holds back keys of the first term only. ``regex`` is searched anywhere
    in string terms. ``end`` may be None for an open end. ``ordered`` sorts by term and key.
    """
    numeric = isinstance(start, int)
    if numeric and regex is not None:
        raise TypeError("a regular expression needs string terms")
    term = "term_i" if numeric else "term_s"
    where = bucket_is(bucket) & (F.col("field") == field) & (F.col(term) >= start)
    if end is not None:
        where &= F.col(term) <= end
    if start_key is not None:
        where &= (F.col(term) > start) | (F.col("key") >= start_key)
    if regex is not None:
        where &= F.col(term).rlike(regex)
    found = index(journal, where=where, **at).select(F.col(term).alias("term"), "key")
    found = found.orderBy("term", "key") if ordered else found
    return found if return_terms else found.select("key")


def bucket_list(journal: DataFrame, tag: str, *, first: bool = False, ordered: bool = False, **at) -> DataFrame:
    """Buckets with a visible object; in order, typed ones first, then by name."""
    found = ledger(journal, where=F.col("tag") == tag, **at).select("bucket_type", "bucket").distinct()
    found = found.orderBy(*key_order()[:3]) if ordered or first else found
    return found.limit(1) if first else found


def key_list(journal: DataFrame, tag: str, bucket: Bucket | None = None, *, start: str | None = None, end: str | None = None, regex: str | None = None, ordered: bool = False, **at) -> DataFrame:
    """Keys of a tag, of a bucket, of a range of keys, or of those that match: bucket_type, bucket, key, subkey."""
    where = _range(tag, bucket, start, end)
    if regex is not None:
        where &= F.col("key").rlike(regex)
    found = ledger(journal, where=where, **at).select(*KEYS[1:])
    return found.orderBy(*key_order()) if ordered else found


def _in_segments(journal: DataFrame, segments: list[int]) -> tuple[Column, Callable[[DataFrame], DataFrame]]:
    """A condition on seg16 for few segments, or a join for many: one of both does nothing."""
    low = sorted({s & 0x7FFF for s in segments})
    both = [*low, *(s | 0x8000 for s in low)]
    if len(low) <= SEGMENTS:
        return F.col("seg16").isin(both), lambda state: state
    wanted = journal.sparkSession.createDataFrame([(s,) for s in both], "w_seg long")
    return F.lit(True), lambda state: state.join(F.broadcast(wanted), F.col("seg16") == F.col("w_seg"), "left_semi")


def head_fold(
    journal: DataFrame, tag: str, *, buckets: list[Bucket] | None = None, start: str | None = None, end: str | None = None, segments: list[int] | None = None,
    modified: tuple[int, int | None] | None = None, check_presence: bool = False, max_count: int | None = None, ordered: bool = False, **at,
) -> DataFrame:
    """Heads, with all limits applied in the order in which they count.

    ``segments`` compares 15 bits, so more may come back than was asked for. ``max_count`` counts before
    ``check_presence``, in the order of keys, or of the given buckets; the first so many entries remain. Heads of batches have
    no body, so ``check_presence`` leaves none of them.
    """
    where = _range(tag, None, start, end)
    place = None
    if buckets is not None:
        some = F.lit(False)
        for k, b in enumerate(buckets):
            some |= bucket_is(b)
            place = F.when(bucket_is(b), k) if place is None else place.when(bucket_is(b), k)
        where &= some
    narrow = lambda state: state
    if segments is not None:
        cond, narrow = _in_segments(journal, segments)
        where &= cond
    out = narrow(ledger(journal, where=where, **at)).drop("seg16")
    if modified is not None:
        out = out.filter(modified_within(*modified))
    if max_count is not None or ordered:
        out = out.orderBy(*([] if place is None else [place]), *key_order())
        out = out if max_count is None else out.limit(max_count)
    return reads.present(out, as_of(journal, at.get("sqn"))) if check_presence else out


def remaining(found: DataFrame, max_count: int) -> DataFrame:
    """How much of a maximum is left, and how much was found."""
    return found.agg((F.lit(max_count) - F.count(F.lit(1))).alias("remaining"), F.count(F.lit(1)).alias("found"))


def object_fold(journal: DataFrame, tag: str, *, order: str = "key_order", bucket: Bucket | None = None, start: str | None = None, end: str | None = None, ordered: bool = False, **at) -> DataFrame:
    """Objects with their bodies. In ``sqn_order`` current writes are read from the journal and expiry is not looked at."""
    columns = ["sqn", "bucket_type", "bucket", "key", "value"]
    if order == "sqn_order":
        seen = as_of(journal, at.get("sqn")).filter(F.col("tag") == tag)
        now = ledger(seen, all_versions=True, base=at.get("base"), where=F.col("tag") == tag).select(*reads.BODY)
        found = seen.filter(F.col("jtype") == "stnd").alias("s").join(now.alias("n"), same("s", "n", reads.BODY), "left_semi").select(*columns)
        return found.orderBy("sqn") if ordered else found
    found = reads.fetch(ledger(journal, where=_range(tag, bucket, start, end), **at), as_of(journal, at.get("sqn"))).select(*columns)
    return found.orderBy(*key_order()[:4]) if ordered else found


def object_fold_by_index(journal: DataFrame, tag: str, bucket: Bucket, field: str, start, end, *, version: str = "as_indexed", ordered: bool = False, **at) -> DataFrame:
    """Objects by index: the version that wrote the posting (``as_indexed``), or the current one (``current``)."""
    term = "term_i" if isinstance(start, int) else "term_s"
    where = (F.col("tag") == tag) & bucket_is(bucket) & (F.col("field") == field) & F.col(term).between(start, end)
    found = index(journal, where=where, **at)
    if version == "current":
        state = ledger(journal, where=(F.col("tag") == tag) & bucket_is(bucket), **at)
        key = reads.BODY[:-1]
        found = found.alias("i").join(state.alias("s"), same("i", "s", key)).select(*[f"i.{k}" for k in key], "s.sqn", F.col(f"i.{term}").alias(term))
    found = reads.fetch(found.select(*reads.BODY, F.col(term).alias("term")), as_of(journal, at.get("sqn"))).select("term", "key", "sqn", "value")
    return found.orderBy("term", "key") if ordered else found


def bucket_stats(journal: DataFrame, tag: str, bucket: Bucket | None = None, **at) -> DataFrame:
    """Total size in bytes and number of objects, of one bucket or of each."""
    return ledger(journal, where=_range(tag, bucket, None, None), **at).groupBy("bucket_type", "bucket").agg(F.sum("size").alias("total_size"), F.count(F.lit(1)).alias("n_objects"))


def hash_list(journal: DataFrame, tag: str, *, check_presence: bool = False, **at) -> DataFrame:
    """Keys with the hashes of their objects; with ``check_presence`` of those whose body is there (all are checked)."""
    found = ledger(journal, where=F.col("tag") == tag, **at)
    found = reads.present(found, as_of(journal, at.get("sqn"))) if check_presence else found
    return found.select(*KEYS[1:], "hash")


def estimate_count(journal: DataFrame, tag: str, segments: list[int], **at) -> DataFrame:
    """An estimate of the number of keys from those in some of the 2^15 segments."""
    n = len({s & 0x7FFF for s in segments})
    return head_fold(journal, tag, segments=segments, **at).agg(F.count(F.lit(1)).alias("in_segments"), (F.count(F.lit(1)) * F.lit(32_768 / n)).cast("long").alias("estimate"))


#: Aggregates by name: what a fold gathers, as columns over the rows of a scan.
AGGREGATES = {
    "count": lambda **_: [F.count(F.lit(1)).alias("count")],
    "sum": lambda value, **_: [F.sum(value).alias("sum")],
    "sum_count": lambda value, **_: [F.sum(value).alias("sum"), F.count(F.lit(1)).alias("count")],
    "xor_count": lambda value, **_: [F.bit_xor(value).alias("xor"), F.count(F.lit(1)).alias("count")],
    "min_max_key": lambda **_: [F.min("key").alias("min_key"), F.max("key").alias("max_key")],
    "last_key_count": lambda **_: [F.max("key").alias("last_key"), F.count(F.lit(1)).alias("count")],
    "bucket_set": lambda **_: [F.sort_array(F.collect_set("bucket")).alias("buckets")],
}


def aggregate(found: DataFrame, name: str, by: tuple[str, ...] = (), value: Column | None = None) -> DataFrame:
    """A named aggregate over a scan, of all its rows or by columns."""
    return found.groupBy(*by).agg(*AGGREGATES[name](value=value))


def fold(found: DataFrame, order: tuple[str, ...], step, acc):
    """An arbitrary sequential fold on the driver, row by row in order; StopIteration from ``step`` ends it early."""
    for row in found.orderBy(*order).toLocalIterator():
        try:
            acc = step(row, acc)
        except StopIteration as e:
            return acc if e.value is None else e.value
    return acc


def fold_groups(found: DataFrame, by: tuple[str, ...], order: tuple[str, ...], step, init, schema: str) -> DataFrame:
    """An arbitrary sequential fold of each group on the executors: ``step(row, acc)`` over rows (dicts) in order.

    ``schema`` names the columns of ``by`` and of the dict that the last accumulator must be. StopIteration ends a
    group early. A group must fit into a task's memory; groups that need not can use ``aggregate``.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame, acc = frame.sort_values(list(order)), init()
        for row in frame.to_dict("records"):
            try:
                acc = step(row, acc)
            except StopIteration as e:
                acc = acc if e.value is None else e.value
                break
        return pd.DataFrame([{c: frame[c].iloc[0] for c in by} | acc])

    return found.groupBy(*by).applyInPandas(run, schema)


def page(found: DataFrame, order: tuple[str, ...], size: int) -> DataFrame:
    """The first ``size`` rows in a total order."""
    return found.orderBy(*order).limit(size)


def latest_versions(journal: DataFrame, n: int) -> DataFrame:
    """The newest n writes of every key, with their place."""
    key = reads.BODY[:-1]
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("sqn")))
    return journal.filter(F.col("jtype").isin("stnd", "tomb")).select(*key, "sqn", "jtype", place.alias("place")).filter(F.col("place") <= n)
