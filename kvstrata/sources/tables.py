"""Journals made from relational tables, so that every query of the engine can run over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvstrata.functions.clocks import GREGORIAN_EPOCH, unix_seconds
from kvstrata.sources.journal import HEADS, SPECS, conform


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spec(op, field: str, term_s=None, term_i=None):
    return F.struct(op.alias("op"), F.lit(field).alias("field"), (F.lit(None).cast("string") if term_s is None else term_s).alias("term_s"), (F.lit(None).cast("long") if term_i is None else term_i.cast("long")).alias("term_i"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard objects by priority, written once, with indexes of date, customer and status."""
    add = F.lit("add")
    specs = F.array(_spec(add, "o_orderdate_bin", F.date_format("o_orderdate", "yyyyMMdd")), _spec(add, "o_custkey_int", None, F.col("o_custkey")), _spec(add, "o_orderstatus_bin", F.col("o_orderstatus")))
    return conform(
        _table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("sqn"), F.lit("o").alias("tag"), F.col("o_orderpriority").alias("bucket"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("key"),
            F.concat_ws("|", "o_orderstatus", F.col("o_custkey").cast("string")).alias("value"), unix_seconds(F.col("o_orderdate")).alias("lmd"), specs.cast(SPECS).alias("index_specs"),
        )
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects by event type and user, rewritten over and over; every seventh write is a delete, every third expires after ten days."""
    tomb = F.col("event_id") % 7 == 0
    lmd = unix_seconds(F.col("ts"))
    spec = _spec(F.when(tomb, "remove").otherwise("add"), "value_int", None, F.floor("value"))
    return conform(
        _table(spark, sf_dir, "events").select(
            (F.col("event_id") + 1).alias("sqn"), F.when(tomb, "tomb").otherwise("stnd").alias("jtype"), F.lit("o_rkv").alias("tag"), F.col("event_type").alias("bucket"), F.lpad(F.col("user_id").cast("string"), 8, "0").alias("key"),
            F.when(~tomb, F.concat_ws("|", F.col("event_id").cast("string"), "props")).alias("value"), lmd.alias("lmd"), F.array(spec).cast(SPECS).alias("index_specs"),
            F.when((F.col("event_id") % 3 == 0) & ~tomb, lmd + GREGORIAN_EPOCH + 864_000).alias("expires_at"),
        )
    )


def event_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with all terms of each version in ``terms``, for recalculation: an event's one spec is its term."""
    terms = F.when(F.col("jtype") == "stnd", F.transform("index_specs", lambda s: F.struct(s["field"].alias("field"), s["term_s"].alias("term_s"), s["term_i"].alias("term_i"))))
    return events(spark, sf_dir).withColumn("terms", terms)


def baskets(spark: SparkSession, sf_dir: str, tag: str = "o") -> DataFrame:
    """Customers' last orders, rewritten order by order, in plain buckets and in typed ones of the same name, with metadata, clocks, siblings and values beyond ASCII."""
    date = unix_seconds(F.col("o_orderdate"))
    status = F.col("o_orderstatus")
    term = lambda field: F.struct(F.lit(field).alias("field"), F.lit(None).cast("string").alias("term_s"), F.col("o_custkey").cast("long").alias("term_i"))
    sibling = lambda tag, deleted, lmd: F.struct(F.lit(tag).alias("vtag"), deleted.alias("deleted"), lmd.alias("lmd"), F.array(term(f"{tag}_int")).alias("index"))
    tick = lambda actor, n: F.struct(F.lit(actor).alias("actor"), n.cast("long").alias("n"))
    return conform(
        _table(spark, sf_dir, "orders").select(
            (F.col("o_orderkey") + 1).alias("sqn"), F.lit(tag).alias("tag"), F.when(status == "F", "typed").alias("bucket_type"), F.col("o_orderpriority").alias("bucket"), F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("key"),
            F.concat(F.lit("€ "), status, F.lit("|"), F.col("o_orderkey").cast("string")).alias("value"), F.create_map(F.lit("status"), status).alias("user_md"), date.alias("lmd"),
            F.array(_spec(F.lit("add"), "year_bin", F.concat(F.lit("é"), F.date_format("o_orderdate", "yyyy")))).cast(SPECS).alias("index_specs"),
            F.array(tick("b", F.col("o_orderkey") % 5), tick("a", F.col("o_custkey") % 7)).alias("vclock"),
            F.array(sibling("x", F.lit(False), date), sibling("y", status == "F", date + 60)).alias("siblings"),
        )
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head-only objects by market segment: a batch adds all, a second one removes every ninth."""
    head = lambda op: F.struct(F.lit(op).alias("op"), F.lit(None).cast("string").alias("bucket_type"), F.col("c_mktsegment").alias("bucket"), F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("key"), F.lit(None).cast("string").alias("subkey"), F.lit(None).cast("array<bigint>").alias("lmds"), F.col("c_name").alias("value"))
    rows = _table(spark, sf_dir, "customer")
    adds = rows.select(F.lit(1).alias("sqn"), F.array(head("add")).cast(HEADS).alias("object_specs"))
    removes = rows.filter(F.col("c_custkey") % 9 == 0).select(F.lit(2).alias("sqn"), F.array(head("remove")).cast(HEADS).alias("object_specs"))
    return conform(adds.unionByName(removes).withColumn("jtype", F.lit("mput")).withColumn("tag", F.lit("h")))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head-only objects with subkeys: conversations by turn."""
    head = F.struct(F.lit("add").alias("op"), F.lit(None).cast("string").alias("bucket_type"), F.col("role").alias("bucket"), F.lpad(F.col("conv_id").cast("string"), 8, "0").alias("key"), F.lpad(F.col("turn").cast("string"), 4, "0").alias("subkey"), F.array(F.col("conv_id"), F.col("turn")).alias("lmds"), F.col("text").alias("value"))
    return conform(_table(spark, sf_dir, "conversations").select(F.lit(1).alias("sqn"), F.lit("mput").alias("jtype"), F.lit("h").alias("tag"), F.array(head).cast(HEADS).alias("object_specs")))
