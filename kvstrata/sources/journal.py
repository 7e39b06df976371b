"""The journal: one row per write, in the order of sequence numbers. Written and read as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvstrata.functions.tags import CLOCK, SIBLING

SPECS = "array<struct<op:string,field:string,term_s:string,term_i:bigint>>"
HEADS = "array<struct<op:string,bucket_type:string,bucket:string,key:string,subkey:string,lmds:array<bigint>,value:binary>>"
#: Record types: stnd an object, tomb a delete, keyd index changes only, mput a batch of heads. Objects of siblings carry a clock
#: and their siblings.
COLUMNS = {
    "sqn": "bigint", "jtype": "string", "tag": "string", "bucket_type": "string", "bucket": "string", "key": "string", "subkey": "string", "value": "binary",
    "user_md": "map<string,string>", "lmd": "bigint", "index_specs": SPECS, "object_specs": HEADS, "expires_at": "bigint", "vclock": CLOCK, "siblings": f"array<{SIBLING}>",
}
SCHEMA = ", ".join(f"{c} {t}" for c, t in COLUMNS.items())


def conform(df: DataFrame) -> DataFrame:
    """The journal's columns in their order; missing ones are null, a missing type is stnd. Values may be strings."""
    missing = {"jtype": F.lit("stnd")}
    return df.select(*[(F.col(c).cast(t) if c in df.columns else missing.get(c, F.lit(None)).cast(t)).alias(c) for c, t in COLUMNS.items()])


def read_journal(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(*paths)


def _write(df: DataFrame, keys: list[str], path: str, mode: str, codec: str | None) -> None:
    writer = df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(mode)
    (writer.option("compression", codec) if codec else writer).parquet(path)


def write_journal(df: DataFrame, path: str, mode: str = "append", codec: str | None = None) -> None:
    """Add rows, clustered by sequence number so that ranges of it skip files and row groups. ``codec`` is one of Parquet's."""
    _write(conform(df), ["sqn"], path, mode, codec)


def write_ledger(df: DataFrame, path: str, mode: str = "overwrite", codec: str | None = None) -> None:
    """A ledger or index clustered by key, so that key ranges skip files and row groups."""
    _write(df, [c for c in ("tag", "bucket_type", "bucket", "field", "term_s", "term_i", "key", "subkey") if c in df.columns], path, mode, codec)
