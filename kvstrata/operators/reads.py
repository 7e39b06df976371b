"""Reads of single keys and of sets of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvstrata.operators.state import KEYS, Bucket, bucket_is, ledger, same

#: What names the body of an entry.
BODY = ("tag", "bucket_type", "bucket", "key", "sqn")
_KEY = BODY[:-1]


def _is(tag: str, bucket: Bucket, key: str):
    return (F.col("tag") == tag) & bucket_is(bucket) & (F.col("key") == key)


def head(journal: DataFrame, tag: str, bucket: Bucket, key: str, **at) -> DataFrame:
    """Metadata of one key; no row if it is not there. The key's condition reaches the scan, and bodies are not read."""
    return ledger(journal, where=_is(tag, bucket, key), **at)


def _bodies(journal: DataFrame, *more: str) -> DataFrame:
    return journal.filter(F.col("jtype") == "stnd").select(*BODY, *more)


def fetch(state: DataFrame, journal: DataFrame) -> DataFrame:
    """The state with the body that each entry's sequence number wrote; entries without a body go."""
    return state.alias("s").join(_bodies(journal, "value").alias("b"), same("s", "b", BODY)).select("s.*", "b.value")


def proxies(state: DataFrame) -> DataFrame:
    """The state with ``proxy``, a handle of each entry's body: what names it, and its size."""
    return state.withColumn("proxy", F.struct(*BODY, "size"))


def fetch_proxies(rows: DataFrame, journal: DataFrame) -> DataFrame:
    """Any rows with a column ``proxy``, with the bodies that the handles name."""
    named = rows.select("*", *[F.col("proxy").getField(c).alias(f"p_{c}") for c in BODY])
    bodies = _bodies(journal, "value").toDF(*[f"b_{c}" for c in BODY], "value")
    on = F.expr(" AND ".join(f"p_{c} {'<=>' if c == 'bucket_type' else '='} b_{c}" for c in BODY))
    return named.join(bodies, on).drop(*[f"{x}_{c}" for x in "pb" for c in BODY])


def get(journal: DataFrame, tag: str, bucket: Bucket, key: str, **at) -> DataFrame:
    """The object of one key."""
    return fetch(ledger(journal, where=_is(tag, bucket, key), **at), journal.filter(_is(tag, bucket, key)))


def _typed(keys: DataFrame) -> DataFrame:
    """Keys with a bucket type; without such a column it is null."""
    return keys if "bucket_type" in keys.columns else keys.withColumn("bucket_type", F.lit(None).cast("string"))


def multi_get(journal: DataFrame, keys: DataFrame, **at) -> DataFrame:
    """The objects of many keys (tag, bucket, key, and perhaps bucket_type); keys that are not there have no row."""
    wanted = _typed(keys).select(*_KEY).distinct()
    own = journal.alias("j").join(wanted.alias("w"), same("j", "w", _KEY), "left_semi")
    return fetch(ledger(own, **at), own)


def currency(journal: DataFrame, asked: DataFrame) -> DataFrame:
    """For rows (tag, bucket, key, asked_sqn, and perhaps bucket_type): current, replaced or missing. A tombstone counts as a version."""
    state = ledger(journal, all_versions=True).filter(F.col("subkey").isNull()).select(*_KEY, F.col("sqn").alias("found"))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("found") > F.col("asked_sqn"), "replaced").otherwise("current")
    joined = _typed(asked).alias("a").join(state.alias("s"), same("a", "s", _KEY), "left")
    return joined.select(*[f"a.{k}" for k in _KEY], "asked_sqn", status.alias("status"))


def present(state: DataFrame, journal: DataFrame) -> DataFrame:
    """The entries whose body is still in the journal."""
    return state.alias("s").join(_bodies(journal).alias("b"), same("s", "b", BODY), "left_semi")


def is_empty(journal: DataFrame, tag: str, **at) -> bool:
    return ledger(journal, where=F.col("tag") == tag, **at).isEmpty()


def next_key(journal: DataFrame, tag: str, bucket: Bucket | None = None, start: str | None = None, **at) -> DataFrame:
    """The first visible key of a tag, or of a bucket, at or after ``start``."""
    where = F.col("tag") == tag
    if bucket is not None:
        where &= bucket_is(bucket)
    if start is not None:
        where &= F.col("key") >= start
    found = ledger(journal, where=where, **at).select(*KEYS, "sqn")
    return found.orderBy(F.col("bucket_type").isNull(), "bucket_type", "bucket", "key", "subkey").limit(1)
