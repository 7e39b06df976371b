"""From the journal to the latest state of keys, heads and index postings.

The order of steps is fixed: conditions on keys, then the latest version of each key, then visibility, then conditions
on values. A condition on values before the second step would bring an older version back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvstrata.functions import hashing, tags

KEYS = ("tag", "bucket_type", "bucket", "key", "subkey")
POSTING = ("bucket_type", "bucket", "field", "term_s", "term_i", "key")


@dataclass(frozen=True)
class Base:
    """A stored state: versions of objects and postings up to a sequence number. Of a key there may be several; the latest counts."""

    ledger: DataFrame
    index: DataFrame
    sqn: int


def same(a: str, b: str, keys: tuple[str, ...]) -> Column:
    """Equal keys under two aliases; of bucket types and subkeys null equals null."""
    return F.expr(" AND ".join(f"{a}.{k} {'<=>' if k in ('bucket_type', 'subkey') else '='} {b}.{k}" for k in keys))


#: A bucket is a name, or a type and a name.
Bucket = str | tuple[str, str]


def bucket_is(bucket: Bucket) -> Column:
    kind, name = (None, bucket) if isinstance(bucket, str) else bucket
    return (F.col("bucket") == name) & (F.col("bucket_type").isNull() if kind is None else F.col("bucket_type") == kind)


def key_order() -> list[Column]:
    """The order of keys: typed buckets first."""
    return [F.col("bucket_type").isNull(), F.col("bucket_type"), F.col("bucket"), F.col("key"), F.col("subkey")]


def as_of(journal: DataFrame, sqn: int | None) -> DataFrame:
    """The journal as a snapshot at that sequence number sees it."""
    return journal if sqn is None else journal.filter(F.col("sqn") <= sqn)


def _seg16() -> Column:
    return hashing.segment_hash(tags.canonical_keys(F.col("tag"), *[F.col(k) for k in KEYS[1:]]))["seg16"].alias("seg16")


def object_changes(journal: DataFrame) -> DataFrame:
    """One row per object write or delete: keys, seg16, sqn, is_tomb, expires_at and the fields of the head. Bodies are not read on."""
    head = tags.heads_of_values(F.col("tag"), {c: F.col(c) for c in ("value", "user_md", "lmd", "vclock", "siblings")})
    return journal.filter(F.col("jtype").isin("stnd", "tomb")).select(*KEYS, _seg16(), "sqn", (F.col("jtype") == "tomb").alias("is_tomb"), "expires_at", *[c.alias(f) for f, c in head.items()])


def head_changes(journal: DataFrame) -> DataFrame:
    """One row per head of each batch; the value lies in the ledger itself. Of a key repeated in one batch the first counts."""
    spec = F.posexplode("object_specs").alias("place", "s")
    rows = journal.filter(F.col("jtype") == "mput").select("tag", "sqn", "expires_at", spec)
    once = rows.groupBy("tag", "sqn", "expires_at", *[F.col(f"s.{k}").alias(k) for k in KEYS[1:]]).agg(F.min_by("s", "place").alias("s"))
    head = {"hash": hashing.value_hash(F.col("s.value")), "size": F.octet_length("s.value").cast("long"), "lmd": F.array_max("s.lmds")}
    fields = [head.get(f, F.lit(None)).cast(t).alias(f) for f, t in tags.HEAD.items()]
    return once.select(*KEYS, _seg16(), "sqn", (F.col("s.op") == "remove").alias("is_tomb"), "expires_at", *fields, F.col("s.value").alias("head_value"))


def key_changes(journal: DataFrame) -> DataFrame:
    """The changes of objects and of heads. ``head_value`` is the value of a head and null for an object, whose body is in the journal."""
    return object_changes(journal).withColumn("head_value", F.lit(None).cast("binary")).unionByName(head_changes(journal))


def index_changes(journal: DataFrame) -> DataFrame:
    """One row per index spec: posting, sqn, is_tomb (of a remove), expires_at."""
    rows = journal.filter(F.col("jtype").isin("stnd", "tomb", "keyd")).select("tag", "bucket_type", "bucket", "key", "sqn", "expires_at", F.explode("index_specs").alias("s"))
    return rows.select("tag", "bucket_type", "bucket", F.col("s.field").alias("field"), F.col("s.term_s").alias("term_s"), F.col("s.term_i").alias("term_i"), "key", "sqn", (F.col("s.op") == "remove").alias("is_tomb"), F.when(F.col("s.op") == "add", F.col("expires_at")).alias("expires_at"))


def latest(changes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The change of the highest sequence number of each key; where one write both adds and removes a posting, the add.

    Each column has an aggregate of its own, so what a query does not use is pruned down to the scan, and while only
    numbers are left the aggregation is by hash, with map-side combining.
    """
    order = F.col("sqn") * 2 + F.when(F.col("is_tomb"), 0).otherwise(1)
    rest = [c for c in changes.columns if c not in keys and c not in ("sqn", "seg16")]
    # a key has one segment, so any will do
    segment = [F.max("seg16").alias("seg16")] if "seg16" in changes.columns else []
    return changes.groupBy(*keys).agg(F.max("sqn").alias("sqn"), *segment, *[F.max_by(c, order).alias(c) for c in rest]).select(changes.columns)


def visible(now: int | None) -> Column:
    """Active at ``now`` (gregorian seconds): no tombstone, and not expired before it."""
    alive = ~F.col("is_tomb")
    return alive if now is None else alive & (F.col("expires_at").isNull() | (F.col("expires_at") >= now))


def modified_within(lo: int, hi: int | None) -> Column:
    """Last modified in the range, both ends included; entries without a date pass."""
    upper = F.lit(True) if hi is None else F.col("lmd") <= hi
    return F.col("lmd").isNull() | ((F.col("lmd") >= lo) & upper)


def _changes(journal: DataFrame, of, stored: DataFrame | None, base: Base | None, where: Column | None, sqn: int | None) -> DataFrame:
    """The changes up to a snapshot; from a stored state, where it is no newer, and the journal after it."""
    if base is not None and (sqn is None or sqn >= base.sqn):
        fresh = of(as_of(journal, sqn).filter(F.col("sqn") > base.sqn))
        changes = stored.select(fresh.columns).unionByName(fresh)  # levels of the base and what is newer
    else:
        changes = of(as_of(journal, sqn))
    return changes if where is None else changes.filter(where)


def ledger(journal: DataFrame, *, where: Column | None = None, sqn: int | None = None, now: int | None = None, all_versions: bool = False, base: Base | None = None) -> DataFrame:
    """The visible state of every key, of objects and heads. ``where`` may look at key columns and seg16 only; it reaches the scans."""
    state = latest(_changes(journal, key_changes, base and base.ledger, base, where, sqn), KEYS)
    return state if all_versions else state.filter(visible(now))


def heads(journal: DataFrame, *, where: Column | None = None, sqn: int | None = None, now: int | None = None, base: Base | None = None) -> DataFrame:
    """The visible state of head-only keys, with their values."""
    return latest(_changes(journal, head_changes, base and base.ledger, base, where, sqn), KEYS).filter(visible(now)).withColumnRenamed("head_value", "value")


def index(journal: DataFrame, *, where: Column | None = None, sqn: int | None = None, now: int | None = None, all_versions: bool = False, base: Base | None = None) -> DataFrame:
    """The visible postings. ``where`` may look at the columns of a posting only."""
    state = latest(_changes(journal, index_changes, base and base.index, base, where, sqn), ("tag", *POSTING))
    return state if all_versions else state.filter(visible(now))


def with_segment(state: DataFrame) -> DataFrame:
    """The state with ``segment``, the struct of hashes of its canonical key."""
    canonical = tags.canonical_keys(F.col("tag"), *[F.col(k) for k in KEYS[1:]])
    return state.withColumn("segment", hashing.segment_hash(canonical))
