"""What a tag decides: the canonical key, the metadata of an object, the head it shows, and how index terms differ."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from kvstrata.functions.hashing import value_hash

STANDARD, SIBLINGS, HEAD_ONLY = "o", "o_rkv", "h"


#: What an object is made of, as its tag's functions see it.
Record = dict[str, Column]
#: A sibling of an object without its value.
SIBLING = "struct<vtag:string,deleted:boolean,lmd:bigint,index:array<struct<field:string,term_s:string,term_i:bigint>>>"
CLOCK = "array<struct<actor:string,n:bigint>>"


def plain_key(bucket_type: Column, bucket: Column, key: Column, subkey: Column) -> Column:
    """Bucket type, bucket, key and subkey joined; nulls are left out. Other borders between the parts give the same key."""
    return F.concat_ws("", bucket_type, bucket, key, subkey)


def framed_key(*parts: Column) -> Column:
    """The parts with their lengths, so that only equal parts give equal keys; a null part is a dash."""
    return F.concat(*[F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts])


def value_metadata(record: Record) -> Record:
    """Hash and size (in bytes) of the value, and what the record says of itself."""
    value = record["value"]
    return {"hash": value_hash(value), "size": F.octet_length(value).cast("long"), "user_md": record["user_md"], "lmd": record["lmd"]}


def sibling_metadata(record: Record) -> Record:
    """Of an object of siblings: the hash of its clock, the latest date of all siblings, the clock, and the siblings without values.

    An object without a clock is hashed by its value, one without siblings has the date of its record.
    """
    plain = value_metadata(record)
    dates = last_modified(F.transform(record["siblings"], lambda s: s["lmd"]))
    return plain | {"hash": F.coalesce(clock_hash(record["vclock"]), plain["hash"]), "lmd": F.coalesce(dates, record["lmd"]), "vclock": record["vclock"], "siblings": record["siblings"]}


def build_head(metadata: Record) -> Record:
    """The head of an object, as its metadata are."""
    return metadata


def term_difference(new: Column, old: Column) -> Column:
    """Specs that turn the terms ``old`` into ``new``: array of struct(op, field, term_s, term_i)."""
    none = F.array().cast("array<struct<field:string,term_s:string,term_i:bigint>>")
    new, old = F.coalesce(new, none), F.coalesce(old, none)
    spec = lambda op: lambda t: F.struct(F.lit(op).alias("op"), t["field"].alias("field"), t["term_s"].alias("term_s"), t["term_i"].alias("term_i"))
    return F.concat(F.transform(F.array_except(old, new), spec("remove")), F.transform(F.array_except(new, old), spec("add")))


@dataclass(frozen=True)
class TagSpec:
    """The four column functions of a tag, and how compaction treats it (retain, recovr or recalc)."""

    tag: str
    canonical_key: Callable[..., Column] = framed_key
    extract_metadata: Callable[[Record], Record] = value_metadata
    build_head: Callable[[Record], Record] = build_head
    diff_terms: Callable[[Column, Column], Column] = term_difference
    strategy: str = "retain"


_REGISTRY = {STANDARD: TagSpec(STANDARD), SIBLINGS: TagSpec(SIBLINGS, plain_key, sibling_metadata), HEAD_ONLY: TagSpec(HEAD_ONLY, plain_key)}


def spec(tag: str) -> TagSpec:
    """The functions of a tag; a tag that nobody registered behaves like the standard one."""
    return _REGISTRY.get(tag) or TagSpec(tag)


def register(tag: str, **functions) -> TagSpec:
    """Set functions or the strategy of a tag."""
    _REGISTRY[tag] = replace(spec(tag), **functions)
    return _REGISTRY[tag]


def registered() -> list[TagSpec]:
    return list(_REGISTRY.values())


def _by_tag(tag: Column, default: Column, own: dict[str, Column]) -> Column:
    """The column of each row's tag; only tags with functions of their own add a case."""
    for name, column in own.items():
        default = F.when(tag == name, column).otherwise(default)
    return default


def canonical_keys(tag: Column, *parts: Column) -> Column:
    """The canonical key of rows of any tags."""
    return _by_tag(tag, framed_key(*parts), {s.tag: s.canonical_key(*parts) for s in registered() if s.canonical_key is not framed_key})


#: The fields of a head, with their types.
HEAD = {"hash": "bigint", "size": "bigint", "user_md": "map<string,string>", "vclock": CLOCK, "siblings": f"array<{SIBLING}>", "lmd": "bigint"}


def heads_of_values(tag: Column, record: Record) -> Record:
    """The fields of the heads of records of any tags. Fields that a tag's functions leave out are null."""
    heads = {s.tag: s.build_head(s.extract_metadata(record)) for s in registered() if s.extract_metadata is not value_metadata or s.build_head is not build_head}
    plain, none = value_metadata(record), F.lit(None)
    return {f: _by_tag(tag, plain.get(f, none).cast(t), {name: head.get(f, none).cast(t) for name, head in heads.items()}) for f, t in HEAD.items()}


def sibling_terms(siblings: Column) -> Column:
    """The index terms of all siblings that are not deleted, each once."""
    return F.array_distinct(F.flatten(F.transform(F.filter(siblings, lambda s: ~F.coalesce(s["deleted"], F.lit(False))), lambda s: s["index"])))


def last_modified(lmds: Column) -> Column:
    """The latest of an array of last-modified dates; null for none."""
    return F.array_max(lmds)


def clock_hash(vclock: Column) -> Column:
    """A 32-bit hash of a vector clock, an array of struct(actor, n), that does not depend on its order."""
    ordered = F.array_sort(F.transform(vclock, lambda c: F.concat_ws(":", c["actor"], c["n"].cast("string"))))
    return F.conv(F.substring(F.md5(F.array_join(ordered, ",").cast("binary")), 1, 8), 16, 10).cast("long")
