"""Upkeep of a journal: compaction, replay, recalculation of index changes, reaping, backup and comparison of stores."""

from __future__ import annotations

import random
import statistics
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvstrata.functions import tags
from kvstrata.operators.state import KEYS, as_of, key_changes, latest, same
from kvstrata.sources.journal import SPECS, read_journal, write_journal


def _with_newest(journal: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """The records with ``newest``, the highest number of a write of their key, here or among ``others``: one shuffle and sort, without a join.

    A record without a tag, bucket or key is no object and has none; batches of heads are such, so they stay out of the shuffle.
    """
    keyed, put = F.col("tag").isNotNull() & F.col("bucket").isNotNull() & F.col("key").isNotNull(), F.col("jtype").isin("stnd", "tomb")
    rows = journal.filter(keyed).withColumn("own", F.lit(True))
    if others is not None:
        rows = rows.unionByName(others.filter(keyed & put).select(*KEYS, "sqn", "jtype", F.lit(False).alias("own")), allowMissingColumns=True)
    rows = rows.withColumn("newest", F.max(F.when(put, F.col("sqn"))).over(Window.partitionBy(*KEYS))).filter("own").drop("own")
    return rows.unionByName(journal.filter(~keyed).withColumn("newest", F.lit(None).cast("long")))


def _with_newest_of(journal: DataFrame, whole: DataFrame) -> DataFrame:
    """The records of a part with ``newest``, the highest number of a write of their key in the whole journal."""
    newest = whole.filter(F.col("jtype").isin("stnd", "tomb")).groupBy(*KEYS).agg(F.max("sqn").alias("newest"))
    return journal.alias("j").join(newest.alias("n"), same("j", "n", KEYS), "left").select("j.*", "n.newest")


def decisions(journal: DataFrame, *, strategies: dict[str, str] | None = None, persisted: int | None = None, whole: DataFrame | None = None, others: DataFrame | None = None) -> DataFrame:
    """Every record with what compaction does to it: keep, convert (to key deltas) or discard.

    A record is kept if it is the current one of its key, or newer than the last persisted sequence number. Else
    a tag under ``retain`` converts objects and keeps other records; ``recovr`` and ``recalc`` discard. Batches of
    heads follow their tag like other records and are never current by key. ``whole`` is the journal that says what is
    current, if ``journal`` is a part of it, and ``others`` is that without the part; of both only keys and numbers are read.
    """
    strategies = {s.tag: s.strategy for s in tags.registered()} | (strategies or {})
    rows = _with_newest(journal, others) if whole is None else _with_newest_of(journal, whole)
    pairs = [x for t, s in strategies.items() for x in (F.lit(t), F.lit(s))]
    strategy = F.coalesce(F.element_at(F.create_map(*pairs), F.col("tag")), F.lit("retain"))
    current = F.coalesce(F.col("newest") <= F.col("sqn"), F.lit(False))
    if persisted is not None:
        current |= F.col("sqn") > persisted
    what = F.when(current, "keep").when(strategy != "retain", "discard").when(F.col("jtype") == "stnd", "convert").otherwise("keep")
    return rows.withColumn("decision", what).drop("newest")


def compact(journal: DataFrame, **options) -> DataFrame:
    """The journal after compaction: converted records lose their bodies, discarded ones go."""
    found = decisions(journal, **options).filter(F.col("decision") != "discard")
    turned = F.col("decision") == "convert"
    return found.withColumn("jtype", F.when(turned, "keyd").otherwise(F.col("jtype"))).withColumn("value", F.when(~turned, F.col("value"))).drop("decision")


def scores(journal: DataFrame, by: Column | int, **options) -> DataFrame:
    """For each file the share (in hundredths) of bytes that compaction would keep: file, active_bytes, total_bytes, score.

    ``by`` says what a file is: a column, or a number of sequence numbers. A file without any bytes scores nothing.
    """
    size = F.coalesce(F.octet_length("value"), F.lit(0)).cast("long")
    kept = F.when(F.col("decision") == "keep", F.col("bytes")).otherwise(0)
    file = F.floor(F.col("sqn") / by) if isinstance(by, int) else by
    rows = decisions(journal.withColumn("file", file).withColumn("bytes", size), **options).groupBy("file")
    found = rows.agg(F.sum(kept).alias("active_bytes"), F.sum("bytes").alias("total_bytes"))
    return found.withColumn("score", F.when(F.col("total_bytes") == 0, 0.0).otherwise(100.0 * F.col("active_bytes") / F.col("total_bytes")))


def best_run(by_file: list[float], *, longest: int = 8, single_target: float = 30.0, run_target: float = 70.0) -> tuple[int, int, float] | None:
    """The run of files (first, length, gain) whose mean score lies furthest under the target for its length.

    The target rises from that of a single file to that of the longest run. Of equal gains the longer run wins, then
    the earlier; without any gain there is no run.
    """
    step = (run_target - single_target) / (longest - 1) if longest > 1 else 0.0
    best = None
    for n in range(min(longest, len(by_file)), 0, -1):
        for first in range(len(by_file) - n + 1):
            # the mean is exact, so that runs of equal scores gain the same
            gain = single_target + step * (n - 1) - statistics.mean(by_file[first : first + n])
            if gain > 0 and (best is None or gain > best[2]):
                best = (first, n, gain)
    return best


def next_run(hours: list[int], per_day: int, now: datetime, rnd: random.Random) -> int:
    """Seconds until the next compaction: of ``per_day`` random quarters of an hour in the allowed hours the first that is still to come, today or else tomorrow."""
    chosen = sorted((rnd.choice(hours), rnd.randrange(4)) for _ in range(per_day))
    today = [c for c in chosen if c > (now.hour, now.minute // 15)]
    hour, quarter = today[0] if today else chosen[0]
    start = now.replace(hour=hour, minute=quarter * 15, second=0, microsecond=0) + timedelta(days=0 if today else 1)
    return int((start - now).total_seconds()) + rnd.randrange(15 * 60)


def terms_of_versions(journal: DataFrame) -> DataFrame:
    """Objects with ``terms`` (array of struct(field, term_s, term_i)) and ``old_terms``, those of the version before; a delete has none."""
    order = Window.partitionBy(*KEYS).orderBy("sqn")
    terms = F.when(F.col("jtype") == "stnd", F.col("terms"))
    return journal.withColumn("terms", terms).withColumn("old_terms", F.lag("terms").over(order))


def recalculate(journal: DataFrame, tag: str) -> DataFrame:
    """The journal of a tag with index specs derived anew from the full terms (column ``terms``) of each version."""
    diff = tags.spec(tag).diff_terms
    found = terms_of_versions(journal.filter(F.col("tag") == tag))
    return found.withColumn("index_specs", diff(F.col("terms"), F.col("old_terms")).cast(SPECS)).drop("terms", "old_terms")


def replay(journal: DataFrame, state: DataFrame, after: int) -> DataFrame:
    """The ledger (all versions resolved) from a stored one and the records after its last sequence number."""
    changes = key_changes(journal.filter(F.col("sqn") > after))
    return latest(state.select(changes.columns).unionByName(changes), KEYS)


def reap(state: DataFrame, now: int) -> DataFrame:
    """A whole ledger without tombstones and entries that expired before ``now``."""
    return state.filter(~F.col("is_tomb") & (F.col("expires_at").isNull() | (F.col("expires_at") >= now)))


def trim(journal: DataFrame, persisted: int) -> DataFrame:
    """A head-only journal without the records that the ledger has persisted."""
    return journal.filter(F.col("sqn") > persisted)


def backup(journal: DataFrame, path: str, sqn: int | None = None) -> None:
    """A copy of the journal as a snapshot at that sequence number sees it."""
    write_journal(as_of(journal, sqn), path, "overwrite")


def restore(spark: SparkSession, path: str) -> DataFrame:
    return read_journal(spark, path)


def store_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys of two states that are missing in one or differ: bucket_type, bucket, key, subkey, and in_a, in_b, the hashes."""
    x = a.select(*KEYS, F.col("hash").alias("in_a"), F.lit(True).alias("has_a"))
    y = b.select(*KEYS, F.col("hash").alias("in_b"), F.lit(True).alias("has_b"))
    joined = x.alias("x").join(y.alias("y"), same("x", "y", KEYS), "full_outer")
    differ = ~F.expr("in_a <=> in_b") | F.col("has_a").isNull() | F.col("has_b").isNull()
    return joined.filter(differ).select(*[F.coalesce(f"x.{k}", f"y.{k}").alias(k) for k in KEYS[1:]], "in_a", "in_b")


def hand_off(journal: DataFrame, tag: str, path: str, keep=None) -> None:
    """Copy the current objects of a tag into another journal, all or those of a condition on keys."""
    own = journal.filter(F.col("tag") == tag)
    own = own if keep is None else own.filter(keep)
    current = decisions(own).filter((F.col("decision") == "keep") & (F.col("jtype") == "stnd")).drop("decision")
    write_journal(current, path)
