"""Streams over a journal: a ledger and a hash tree kept up by micro-batches, recent changes, and keys that expire."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kvstrata.functions import hashing, tags
from kvstrata.operators import merkle
from kvstrata.operators.state import KEYS, key_changes, latest
from kvstrata.sources.journal import SCHEMA, write_ledger
from kvstrata.sources.manifest import Files

#: Micro-batches after which their ledgers are merged into one.
MERGE = 16


def journal_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _ledgers(spark: SparkSession, path: str, before: int | None) -> list[str]:
    """The newest merged ledger before a batch and the ledgers of the batches after it."""
    files = Files(spark)
    done = [n for n in files.names(path) if n[0] in "mb" and n[1:].isdigit() and files.exists(f"{path}/{n}/_SUCCESS") and (before is None or int(n[1:]) < before)]
    merged = max((int(n[1:]) for n in done if n[0] == "m"), default=-1)
    return [f"{path}/{n}" for n in done if n[0] == "m" and int(n[1:]) == merged or n[0] == "b" and int(n[1:]) > merged]


def _versions(spark: SparkSession, path: str, before: int | None) -> DataFrame:
    """The rows of the ledgers of all batches, or those before one. Of a key there may be several; the latest counts."""
    found = _ledgers(spark, path, before)
    rows = key_changes(spark.createDataFrame([], SCHEMA))
    return spark.read.schema(rows.schema).parquet(*found) if found else rows


def read_ledger(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The latest versions (tombstones included) of a ledger that ``maintain_ledger`` keeps, of all batches or those before one."""
    return latest(_versions(spark, path, before), KEYS)


def _write_changes(batch: DataFrame, number: int, path: str) -> None:
    """Write the ledger of one batch under its number. A batch that runs again gives the same."""
    write_ledger(latest(key_changes(batch), KEYS), f"{path}/b{number:012d}")


def _merge(spark: SparkSession, number: int, path: str) -> None:
    """Every MERGE batches, write all ledgers as one."""
    if number % MERGE == MERGE - 1:
        write_ledger(read_ledger(spark, path, number + 1), f"{path}/m{number:012d}")


def maintain_ledger(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Fold the stream into the ledger under ``path``: a batch writes its own changes only. ``read_ledger`` reads it."""

    def upsert(batch: DataFrame, number: int) -> None:
        _write_changes(batch, number, path)
        _merge(batch.sparkSession, number, path)

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _tree_changes(old: DataFrame, changes: DataFrame, size: str) -> DataFrame:
    """What the changes of some keys do to the tree of the ledger ``old``: (segment, leaf), to be merged with it.

    One aggregation by key finds the version that a change replaces and the one that is then the latest. Only numbers are
    aggregated, and a key is hashed once.
    """
    side = lambda rows, fresh: rows.select(*KEYS, "sqn", "is_tomb", "hash", F.lit(fresh).alias("fresh"))
    shown = F.when(~F.col("is_tomb"), F.col("hash"))
    order = F.col("sqn") * 2 + F.when(F.col("is_tomb"), 0).otherwise(1)  # as in latest
    was, now = F.max_by(shown, F.when(~F.col("fresh"), order)), F.max_by(shown, order)
    keys = side(old, False).unionByName(side(changes, True)).groupBy(*KEYS).agg(was.alias("old"), now.alias("new"), F.max("fresh").alias("fresh"))
    touched = keys.filter(F.col("fresh") & ~F.col("old").eqNullSafe(F.col("new")))
    both = touched.select(*KEYS, F.explode(F.array("old", "new")).alias("hash")).filter("hash IS NOT NULL")
    return merkle.object_tree(both, size)


def maintain_tree(stream: DataFrame, path: str, checkpoint: str, size: str = "small") -> StreamingQuery:
    """Keep a ledger under ``path``/ledger and the hash tree of its state under ``path``/tree: what a batch replaces is taken out by XOR, and what it writes put in.

    A batch reads keys, numbers and hashes of the ledger before it, and its own changes as it wrote them; a tree has a bounded number of leaves. ``read_tree`` reads it.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark, ledger = batch.sparkSession, f"{path}/ledger"
        _write_changes(batch, number, ledger)
        old = _versions(spark, ledger, number)
        delta = _tree_changes(old, spark.read.schema(old.schema).parquet(f"{ledger}/b{number:012d}"), size)
        merkle.merge(read_tree(spark, path, number), delta).write.mode("overwrite").parquet(f"{path}/tree/b{number:012d}")
        _merge(spark, number, ledger)

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_tree(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The tree after the newest batch, or after the last one before a batch."""
    files = Files(spark)
    done = [n for n in files.names(f"{path}/tree") if files.exists(f"{path}/tree/{n}/_SUCCESS") and (before is None or int(n[1:]) < before)]
    return spark.read.schema("segment int, leaf long").parquet(f"{path}/tree/{done[-1]}") if done else merkle.new_tree(spark)


def running_tree(stream: DataFrame, size: str = "small") -> DataFrame:
    """A hash tree over all writes of a stream (not of the state: nothing is taken out) by sequence number: (segment, leaf)."""
    h = hashing.segment_hash(tags.canonical_keys(F.col("tag"), *[F.col(k) for k in KEYS[1:]]))
    rows = stream.filter(F.col("jtype").isin("stnd", "tomb")).select(h.alias("h"), "sqn")
    return rows.groupBy(hashing.tree_segment(hashing.segment32(F.col("h")), size).alias("segment")).agg(F.bit_xor(hashing.change_hash(F.col("h"), F.col("sqn"))).alias("leaf"))


def recent_changes(stream: DataFrame, keep: str) -> DataFrame:
    """The first change of each key within ``keep`` of its date: an index of recent changes that forgets older ones."""
    changes = stream.filter(F.col("jtype").isin("stnd", "tomb")).select(*KEYS, "sqn", F.timestamp_seconds("lmd").alias("at"))
    return changes.withWatermark("at", keep).dropDuplicatesWithinWatermark(list(KEYS))


def expiring(stream: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Keys as their state changes: (bucket, key, sqn, status), where status is active, deleted or expired.

    Time is that of the records' dates. A key whose expiry the watermark has passed is put out as expired, and its state is
    dropped; so is that of a deleted key.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        bucket, name = key
        row = lambda sqn, status: pd.DataFrame({"bucket": [bucket], "key": [name], "sqn": [sqn], "status": [status]})
        if held.hasTimedOut:
            sqn, _ = held.get
            held.remove()
            yield row(sqn, "expired")
            return
        best, ends, status = held.get[0] if held.exists else -1, None, None
        for frame in frames:
            newest = frame.loc[frame["sqn"].idxmax()]
            if newest["sqn"] > best:
                best, status = int(newest["sqn"]), "deleted" if newest["jtype"] == "tomb" else "active"
                ends = None if pd.isna(newest["ends"]) else int(newest["ends"])
        if status is None:
            return
        now = held.getCurrentWatermarkMs()
        if status == "active" and ends is not None and ends * 1000 <= now:
            status = "expired"
        if status == "active":
            held.update((best, ends or -1))
            if ends is not None:
                held.setTimeoutTimestamp(ends * 1000)
        elif held.exists:
            held.remove()
        yield row(best, status)

    rows = stream.filter(F.col("jtype").isin("stnd", "tomb")).select("bucket", "key", "sqn", "jtype", (F.col("expires_at") - F.lit(62_167_219_200)).alias("ends"), F.timestamp_seconds("lmd").alias("at"))
    return rows.withWatermark("at", late).groupBy("bucket", "key").applyInPandasWithState(run, "bucket string, key string, sqn long, status string", "sqn long, ends long", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_writes(stream: DataFrame, ts: str, late: str, width: str) -> DataFrame:
    """Writes per bucket and window of event time; rows later than ``late`` are left out."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), "bucket").agg(F.count(F.lit(1)).alias("writes"))
