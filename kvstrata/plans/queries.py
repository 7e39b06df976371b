"""Every operator as a query over the test tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvstrata.functions import hashing, tags
from kvstrata.functions.clocks import GREGORIAN_EPOCH, gregorian, unix_seconds
from kvstrata.operators import folds, maintain, merkle, reads, state
from kvstrata.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
#: Gregorian seconds of 2024-01-15, the clock of all queries over events.
NOW = 1_705_276_800 + GREGORIAN_EPOCH
_AT = 6_000

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

_HEX = "CAST('0x' || substr(md5({0}), {1}, {2}) AS BIGINT)".format
_FRAMED = "'-' || strlen(bucket) || ':' || bucket || strlen(key) || ':' || key || '-'"
_PRE = f"""WITH o AS (
  SELECT o_orderkey AS sqn, o_orderpriority AS bucket, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS key, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS lmd,
    strftime(o_orderdate, '%Y%m%d') AS dterm, o_custkey AS cterm, o_orderstatus AS sterm, o_orderstatus || '|' || CAST(o_custkey AS VARCHAR) AS value FROM orders),
oh AS (SELECT *, {_HEX("value", 1, 8)} AS hash, strlen(value) AS size, {_HEX(_FRAMED, 1, 4)} AS seg16, {_HEX(_FRAMED, 5, 8)} AS extra32, {_HEX(_FRAMED, 13, 8)} AS alt32 FROM o),
e AS (
  SELECT event_id + 1 AS sqn, event_id % 7 = 0 AS is_tomb, event_type AS bucket, lpad(CAST(user_id AS VARCHAR), 8, '0') AS key, CAST(floor(epoch(ts)) AS BIGINT) AS lmd,
    CASE WHEN event_id % 7 <> 0 THEN CAST(event_id AS VARCHAR) || '|' || props END AS value, CAST(floor(value) AS BIGINT) AS term,
    CASE WHEN event_id % 3 = 0 AND event_id % 7 <> 0 THEN CAST(floor(epoch(ts)) AS BIGINT) + {GREGORIAN_EPOCH + 864_000} END AS expires_at FROM events),
el AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY bucket, key ORDER BY sqn DESC) = 1),
ev AS (SELECT * FROM el WHERE NOT is_tomb AND (expires_at IS NULL OR expires_at >= {NOW})),
es AS (SELECT * FROM (SELECT * FROM e WHERE sqn <= {_AT} QUALIFY row_number() OVER (PARTITION BY bucket, key ORDER BY sqn DESC) = 1) WHERE NOT is_tomb AND (expires_at IS NULL OR expires_at >= {NOW})),
ei AS (SELECT * FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY bucket, term, key ORDER BY sqn DESC) = 1) WHERE NOT is_tomb AND (expires_at IS NULL OR expires_at >= {NOW})),
h AS (SELECT c_mktsegment AS bucket, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS key, c_name AS value FROM customer WHERE c_custkey % 9 <> 0),
b AS (
  SELECT o_orderkey + 1 AS sqn, CASE WHEN o_orderstatus = 'F' THEN 'typed' END AS bucket_type, o_orderpriority AS bucket, lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS key, '€ ' || o_orderstatus || '|' || CAST(o_orderkey AS VARCHAR) AS value,
    o_orderstatus AS status, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS lmd, 'é' || strftime(o_orderdate, '%Y') AS term, o_custkey, o_orderkey FROM orders),
bl AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY bucket_type, bucket, key ORDER BY sqn DESC) = 1),
bi AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY bucket_type, bucket, key, term ORDER BY sqn DESC) = 1)
"""
_SEG32 = "((extra32 & 65535) << 16) | seg16"


def _add(name: str, query: Query, sql: str | None) -> None:
    _QUERIES[name] = query
    if sql is not None:
        _SQL[name] = _PRE + sql


_o, _e = tables.orders, tables.events
_TEXT = "CAST(value AS STRING) AS value"
_LOW, _HIGH = "19960101", "19960331"
_BUCKET = "2-HIGH"

_add("index_range_terms", lambda s, d: folds.index_range(_o(s, d), _BUCKET, "o_orderdate_bin", _LOW, _HIGH), f"SELECT dterm AS term, key FROM o WHERE bucket = '{_BUCKET}' AND dterm BETWEEN '{_LOW}' AND '{_HIGH}'")
_add("index_range_keys", lambda s, d: folds.index_range(_o(s, d), _BUCKET, "o_orderdate_bin", _LOW, _HIGH, return_terms=False), f"SELECT key FROM o WHERE bucket = '{_BUCKET}' AND dterm BETWEEN '{_LOW}' AND '{_HIGH}'")
_add("index_open_end", lambda s, d: folds.index_range(_o(s, d), _BUCKET, "o_orderdate_bin", "20010101", None), f"SELECT dterm AS term, key FROM o WHERE bucket = '{_BUCKET}' AND dterm >= '20010101'")
_add("index_seek_page", lambda s, d: folds.page(folds.index_range(_o(s, d), _BUCKET, "o_orderdate_bin", _LOW, _HIGH, start_key="0000001000"), ("term", "key"), 100), f"SELECT dterm AS term, key FROM o WHERE bucket = '{_BUCKET}' AND dterm BETWEEN '{_LOW}' AND '{_HIGH}' AND (dterm > '{_LOW}' OR key >= '0000001000') ORDER BY 1, 2 LIMIT 100")
_add("index_regex", lambda s, d: folds.index_range(_o(s, d), _BUCKET, "o_orderdate_bin", "19950101", "20011231", regex="^199[67]0[13]"), f"SELECT dterm AS term, key FROM o WHERE bucket = '{_BUCKET}' AND regexp_matches(dterm, '^199[67]0[13]')")
_add("index_int_range", lambda s, d: folds.index_range(_o(s, d), _BUCKET, "o_custkey_int", 10, 60), f"SELECT cterm AS term, key FROM o WHERE bucket = '{_BUCKET}' AND cterm BETWEEN 10 AND 60")
_add("index_all_versions", lambda s, d: folds.index_range(_e(s, d), "purchase", "value_int", 10, 40, now=NOW), "SELECT term, key FROM ei WHERE bucket = 'purchase' AND term BETWEEN 10 AND 40")
_add("index_term_counts", lambda s, d: state.index(_e(s, d), now=NOW).groupBy("bucket", F.col("term_i").alias("term")).agg(F.count(F.lit(1)).alias("n")), "SELECT bucket, term, count(*) AS n FROM ei GROUP BY ALL")
_add("bucket_list", lambda s, d: folds.bucket_list(_e(s, d), "o_rkv", now=NOW).select("bucket"), "SELECT DISTINCT bucket FROM ev")
_add("bucket_first", lambda s, d: folds.bucket_list(_e(s, d), "o_rkv", first=True, now=NOW).select("bucket"), "SELECT min(bucket) AS bucket FROM ev")
_add("key_list_tag", lambda s, d: folds.key_list(_e(s, d), "o_rkv", now=NOW).select("bucket", "key"), "SELECT bucket, key FROM ev")
_add("key_list_bucket", lambda s, d: folds.key_list(_o(s, d), "o", _BUCKET).select("bucket", "key"), f"SELECT bucket, key FROM o WHERE bucket = '{_BUCKET}'")
_add("key_list_range", lambda s, d: folds.key_list(_o(s, d), "o", _BUCKET, start="0000000123", end="0000000779").select("bucket", "key"), f"SELECT bucket, key FROM o WHERE bucket = '{_BUCKET}' AND key BETWEEN '0000000123' AND '0000000779'")
_add("key_list_regex", lambda s, d: folds.key_list(_o(s, d), "o", _BUCKET, start="0000000000", end="0000009999", regex="7.3").select("bucket", "key"), f"SELECT bucket, key FROM o WHERE bucket = '{_BUCKET}' AND key <= '0000009999' AND regexp_matches(key, '7.3')")
_add("get_latest", lambda s, d: reads.get(_e(s, d), "o_rkv", "click", "00000042", now=NOW).selectExpr("bucket", "key", "sqn", _TEXT), "SELECT bucket, key, sqn, value FROM ev WHERE bucket = 'click' AND key = '00000042'")
_add("head_latest", lambda s, d: reads.head(_e(s, d), "o_rkv", "click", "00000042", now=NOW).select("bucket", "key", "sqn", "hash", "size", "lmd"), f"SELECT bucket, key, sqn, {_HEX('value', 1, 8)} AS hash, strlen(value) AS size, lmd FROM ev WHERE bucket = 'click' AND key = '00000042'")
_add("sqn_current", lambda s, d: state.ledger(_e(s, d), now=NOW).select("bucket", "key", "sqn"), "SELECT bucket, key, sqn FROM ev")


def _customer_keys(s: SparkSession, d: str) -> DataFrame:
    customers = s.read.parquet(f"{d}/customer.parquet")
    return customers.select(F.lit("o_rkv").alias("tag"), F.lit("purchase").alias("bucket"), F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("key"))


_add("multi_get", lambda s, d: reads.multi_get(_e(s, d), _customer_keys(s, d), now=NOW).selectExpr("bucket", "key", "sqn", _TEXT), "SELECT bucket, key, sqn, value FROM ev WHERE (bucket, key) IN (SELECT 'purchase', lpad(CAST(c_custkey AS VARCHAR), 8, '0') FROM customer)")
_add("currency_check", lambda s, d: reads.currency(_e(s, d), _e(s, d).select("tag", "bucket", "key", F.col("sqn").alias("asked_sqn"))).select("bucket", "key", "asked_sqn", "status"), "SELECT e.bucket, e.key, e.sqn AS asked_sqn, CASE WHEN el.sqn IS NULL THEN 'missing' WHEN el.sqn > e.sqn THEN 'replaced' ELSE 'current' END AS status FROM e LEFT JOIN el ON e.bucket = el.bucket AND e.key = el.key")
_add("tombstones_hidden", lambda s, d: state.ledger(_e(s, d)).select("bucket", "key", "sqn"), "SELECT bucket, key, sqn FROM el WHERE NOT is_tomb")
_add("ttl_visible", lambda s, d: state.ledger(_e(s, d), now=NOW).select("bucket", "key", "sqn", F.coalesce("expires_at", F.lit(0).cast("long")).alias("expires_at")), "SELECT bucket, key, sqn, coalesce(expires_at, 0) AS expires_at FROM ev")
_add("as_of_snapshot", lambda s, d: state.ledger(_e(s, d), sqn=_AT, now=NOW).select("bucket", "key", "sqn"), "SELECT bucket, key, sqn FROM es")
_add("version_history", lambda s, d: folds.latest_versions(_e(s, d), 3).select("bucket", "key", "sqn", "jtype", "place"), "SELECT bucket, key, sqn, CASE WHEN is_tomb THEN 'tomb' ELSE 'stnd' END AS jtype, CAST(row_number() OVER (PARTITION BY bucket, key ORDER BY sqn DESC) AS INTEGER) AS place FROM e QUALIFY place <= 3")
_add("head_lmd_range", lambda s, d: folds.head_fold(_e(s, d), "o_rkv", modified=(1_706_400_000, 1_706_600_000), now=NOW).select("bucket", "key", "lmd"), "SELECT bucket, key, lmd FROM ev WHERE lmd BETWEEN 1706400000 AND 1706600000")
_add("head_bucket_list", lambda s, d: folds.head_fold(_o(s, d), "o", buckets=["5-LOW", "1-URGENT"]).select("bucket", "key", "size"), "SELECT bucket, key, size FROM oh WHERE bucket IN ('5-LOW', '1-URGENT')")
_add("head_max_count", lambda s, d: folds.head_fold(_o(s, d), "o", buckets=["5-LOW", "1-URGENT"], max_count=2_000).select("bucket", "key"), "SELECT bucket, key FROM o WHERE bucket IN ('5-LOW', '1-URGENT') ORDER BY CASE bucket WHEN '5-LOW' THEN 0 ELSE 1 END, key LIMIT 2000")
_add("head_remaining", lambda s, d: folds.remaining(folds.head_fold(_o(s, d), "o", buckets=["3-MEDIUM"], start="0000000100", end="0000002000", max_count=5_000), 5_000), "SELECT 5000 - count(*) AS remaining, count(*) AS found FROM o WHERE bucket = '3-MEDIUM' AND key BETWEEN '0000000100' AND '0000002000'")
_SEGMENTS = list(range(0, 32_768, 16))
_add("head_segment_filter", lambda s, d: folds.head_fold(_o(s, d), "o", segments=_SEGMENTS).select("bucket", "key"), "SELECT bucket, key FROM oh WHERE (seg16 & 32767) % 16 = 0")
_add("head_presence", lambda s, d: reads.present(state.index(_e(s, d), now=NOW), maintain.compact(_e(s, d))).select("bucket", "key", "sqn"), "SELECT ei.bucket, ei.key, ei.sqn FROM ei JOIN el ON ei.bucket = el.bucket AND ei.key = el.key AND ei.sqn = el.sqn")
_add("estimate_count_segments", lambda s, d: folds.estimate_count(_o(s, d), "o", _SEGMENTS), "SELECT count(*) AS in_segments, count(*) * 16 AS estimate FROM oh WHERE (seg16 & 32767) % 16 = 0")
_add("object_fold_key", lambda s, d: folds.object_fold(_e(s, d), "o_rkv", now=NOW).selectExpr("sqn", "bucket", "key", _TEXT), "SELECT sqn, bucket, key, value FROM ev")
_add("object_fold_range", lambda s, d: folds.object_fold(_e(s, d), "o_rkv", bucket="view", start="00000010", end="00000090", now=NOW).selectExpr("sqn", "bucket", "key", _TEXT), "SELECT sqn, bucket, key, value FROM ev WHERE bucket = 'view' AND key BETWEEN '00000010' AND '00000090'")
_add("object_fold_sqn", lambda s, d: folds.object_fold(_e(s, d), "o_rkv", order="sqn_order").selectExpr("sqn", "bucket", "key", _TEXT), "SELECT sqn, bucket, key, value FROM el WHERE NOT is_tomb")
_add("object_fold_index", lambda s, d: folds.object_fold_by_index(_e(s, d), "o_rkv", "view", "value_int", 5, 30, now=NOW).selectExpr("term", "key", "sqn", _TEXT), "SELECT term, key, sqn, value FROM ei WHERE bucket = 'view' AND term BETWEEN 5 AND 30")
_add("object_fold_index_current", lambda s, d: folds.object_fold_by_index(_e(s, d), "o_rkv", "view", "value_int", 5, 30, version="current", now=NOW).selectExpr("term", "key", "sqn", _TEXT), "SELECT ei.term, ev.key, ev.sqn, ev.value FROM ei JOIN ev ON ei.bucket = ev.bucket AND ei.key = ev.key WHERE ei.bucket = 'view' AND ei.term BETWEEN 5 AND 30")
_add("bucket_stats", lambda s, d: folds.bucket_stats(_e(s, d), "o_rkv", now=NOW).drop("bucket_type"), "SELECT bucket, CAST(sum(strlen(value)) AS BIGINT) AS total_size, count(*) AS n_objects FROM ev GROUP BY bucket")
_add("hash_list", lambda s, d: folds.hash_list(_e(s, d), "o_rkv", now=NOW).select("bucket", "key", "hash"), f"SELECT bucket, key, {_HEX('value', 1, 8)} AS hash FROM ev")
_add("fold_sum", lambda s, d: folds.aggregate(state.index(_o(s, d), where=F.col("field") == "o_custkey_int"), "sum_count", ("bucket",), F.col("term_i")), "SELECT bucket, CAST(sum(cterm) AS BIGINT) AS sum, count(*) AS count FROM o GROUP BY bucket")
_add("fold_minmax_bucket", lambda s, d: folds.aggregate(state.ledger(_o(s, d)), "min_max_key", ("bucket",)), "SELECT bucket, min(key) AS min_key, max(key) AS max_key FROM o GROUP BY bucket")
_add("fold_xor_count", lambda s, d: folds.aggregate(state.ledger(_o(s, d)), "xor_count", ("bucket",), F.col("hash")), 'SELECT bucket, bit_xor(hash) AS "xor", count(*) AS count FROM oh GROUP BY bucket')
_add("fold_last_key", lambda s, d: folds.aggregate(folds.head_fold(_o(s, d), "o", max_count=5_000), "last_key_count"), "SELECT max(key) AS last_key, count(*) AS count FROM (SELECT bucket, key FROM o ORDER BY bucket, key LIMIT 5000)")
_TREE = f"SELECT CAST(({_SEG32}) & {{mask}} AS INTEGER) AS segment, bit_xor(xor(alt32, hash)) AS leaf FROM oh {{where}} GROUP BY 1 HAVING leaf <> 0"


def _tree_sql(size: str, where: str = "") -> str:
    return _TREE.format(mask=hashing.TREE_SIZES[size] * 256 - 1, where=where)


_add("tree_objects", lambda s, d: merkle.object_tree(state.ledger(_o(s, d)), "small"), _tree_sql("small"))
_IK = "SELECT key, {0} AS alt32, ((({1}) & 65535) << 16) | ({2}) AS seg32, {3} AS hash FROM o".format(_HEX("key", 13, 8), _HEX("key", 5, 8), _HEX("key", 1, 4), _HEX("dterm", 1, 8))
_add("tree_index", lambda s, d: merkle.index_tree(state.index(_o(s, d), where=F.col("field") == "o_orderdate_bin"), "xsmall"), f"SELECT CAST(seg32 & {64 * 256 - 1} AS INTEGER) AS segment, bit_xor(xor(alt32, hash)) AS leaf FROM ({_IK}) GROUP BY 1 HAVING leaf <> 0")
_add("tree_root", lambda s, d: merkle.root(merkle.object_tree(state.ledger(_o(s, d)), "xsmall")), f"SELECT segment >> 8 AS branch, bit_xor(leaf) AS hash FROM ({_tree_sql('xsmall')}) GROUP BY 1")
_add("tree_leaves", lambda s, d: merkle.leaves(merkle.object_tree(state.ledger(_o(s, d)), "xsmall"), [1, 7, 33]), f"SELECT * FROM ({_tree_sql('xsmall')}) WHERE (segment >> 8) IN (1, 7, 33)")


def _without(s: SparkSession, d: str) -> DataFrame:
    return merkle.object_tree(state.ledger(_o(s, d).filter("sqn <> 77 AND sqn <> 1234")), "small")


_add("tree_dirty", lambda s, d: merkle.dirty_leaves(merkle.object_tree(state.ledger(_o(s, d)), "small"), _without(s, d)), f"SELECT DISTINCT CAST(({_SEG32}) & 65535 AS INTEGER) AS segment FROM oh WHERE sqn IN (77, 1234)")
_add("tree_dirty_branches", lambda s, d: merkle.dirty_branches(merkle.object_tree(state.ledger(_o(s, d)), "small"), _without(s, d)), f"SELECT DISTINCT CAST((({_SEG32}) & 65535) >> 8 AS INTEGER) AS branch FROM oh WHERE sqn IN (77, 1234)")
_add("tree_merge", lambda s, d: merkle.merge(*[merkle.object_tree(state.ledger(_o(s, d).filter(f"sqn % 3 = {i}")), "small") for i in range(3)]), _tree_sql("small"))
_add("tree_alter", lambda s, d: merkle.alter(merkle.object_tree(state.ledger(_o(s, d)), "xxsmall"), s.sql("SELECT * FROM VALUES (5, 99L), (6, 0L) AS t(segment, leaf)")), f"SELECT * FROM ({_tree_sql('xxsmall')}) WHERE segment NOT IN (5, 6) UNION ALL SELECT 5, 99")
_add("segment_keys", lambda s, d: state.with_segment(state.ledger(_o(s, d))).filter(hashing.tree_segment(hashing.segment32(F.col("segment")), "xxsmall").isin(merkle.adjust_segments([3, 9], "xxsmall", "xxsmall"))).select("bucket", "key"), f"SELECT bucket, key FROM oh WHERE (({_SEG32}) & 4095) IN (3, 9)")
_add("segment_resize", lambda s, d: state.with_segment(state.ledger(_o(s, d))).filter(hashing.tree_segment(hashing.segment32(F.col("segment")), "small").isin(merkle.adjust_segments([3, 9], "xsmall", "small"))).select("bucket", "key"), f"SELECT bucket, key FROM oh WHERE (({_SEG32}) & 16383) IN (3, 9)")
_add("store_diff", lambda s, d: maintain.store_difference(state.ledger(_e(s, d), now=NOW), state.ledger(_e(s, d), sqn=_AT, now=NOW)).fillna(-1, ["in_a", "in_b"]).select("bucket", "key", "in_a", "in_b"), f"SELECT coalesce(a.bucket, b.bucket) AS bucket, coalesce(a.key, b.key) AS key, coalesce({_HEX('a.value', 1, 8)}, -1) AS in_a, coalesce({_HEX('b.value', 1, 8)}, -1) AS in_b FROM ev a FULL JOIN es b ON a.bucket = b.bucket AND a.key = b.key WHERE a.value IS DISTINCT FROM b.value")
_add("index_diff_recalc", lambda s, d: maintain.recalculate(tables.event_terms(s, d), "o_rkv").select("bucket", "key", "sqn", F.explode("index_specs").alias("x")).select("bucket", "key", "sqn", "x.op", F.col("x.term_i").alias("term")), """, v AS (SELECT *, CASE WHEN NOT is_tomb THEN term END AS new, lag(CASE WHEN NOT is_tomb THEN term END) OVER (PARTITION BY bucket, key ORDER BY sqn) AS old FROM e)
SELECT bucket, key, sqn, 'add' AS op, new AS term FROM v WHERE new IS NOT NULL AND new IS DISTINCT FROM old UNION ALL SELECT bucket, key, sqn, 'remove', old FROM v WHERE old IS NOT NULL AND old IS DISTINCT FROM new""")
_DECIDED = """, d AS (SELECT e.*, CASE WHEN el.sqn <= e.sqn OR e.sqn > 9000 THEN 'keep' WHEN NOT e.is_tomb THEN 'convert' ELSE 'keep' END AS decision FROM e JOIN el ON e.bucket = el.bucket AND e.key = el.key)
"""
_add("compaction_decisions", lambda s, d: maintain.decisions(_e(s, d), persisted=9_000).select("sqn", "jtype", "decision"), _DECIDED + "SELECT sqn, CASE WHEN is_tomb THEN 'tomb' ELSE 'stnd' END AS jtype, decision FROM d")
_add("compaction_discard", lambda s, d: maintain.compact(_e(s, d), strategies={"o_rkv": "recovr"}).select("sqn", "jtype"), "SELECT sqn, CASE WHEN is_tomb THEN 'tomb' ELSE 'stnd' END AS jtype FROM el")
_add("compaction_score", lambda s, d: maintain.scores(_e(s, d), 1_000, persisted=9_000), _DECIDED + "SELECT sqn // 1000 AS file, CAST(sum(CASE WHEN decision = 'keep' THEN coalesce(strlen(value), 0) ELSE 0 END) AS BIGINT) AS active_bytes, CAST(sum(coalesce(strlen(value), 0)) AS BIGINT) AS total_bytes, CASE WHEN total_bytes = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE * active_bytes / total_bytes END AS score FROM d GROUP BY 1")
_add("compaction_keeps_answers", lambda s, d: state.index(maintain.compact(_e(s, d)), now=NOW).select("bucket", F.col("term_i").alias("term"), "key", "sqn"), "SELECT bucket, term, key, sqn FROM ei")
_add("replay_ledger", lambda s, d: maintain.replay(_e(s, d), state.latest(state.key_changes(_e(s, d).filter(f"sqn <= {_AT}")), state.KEYS), _AT).select("bucket", "key", "sqn", "is_tomb"), "SELECT bucket, key, sqn, is_tomb FROM el")
_add("reap_ledger", lambda s, d: maintain.reap(state.ledger(_e(s, d), all_versions=True), NOW).select("bucket", "key", "sqn"), "SELECT bucket, key, sqn FROM ev")
_add("trim_journal", lambda s, d: maintain.trim(tables.customers(s, d), 1).select("sqn", F.explode("object_specs").alias("x")).select("sqn", "x.op", "x.key"), "SELECT CAST(2 AS BIGINT) AS sqn, 'remove' AS op, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS key FROM customer WHERE c_custkey % 9 = 0")
_add("heads_latest", lambda s, d: state.heads(tables.customers(s, d)).selectExpr("bucket", "key", _TEXT), "SELECT bucket, key, value FROM h")
_add("heads_subkeys", lambda s, d: state.heads(tables.turns(s, d)).select("bucket", "key", "subkey", "lmd", "size"), "SELECT role AS bucket, lpad(CAST(conv_id AS VARCHAR), 8, '0') AS key, lpad(CAST(turn AS VARCHAR), 4, '0') AS subkey, greatest(conv_id, turn) AS lmd, strlen(text) AS size FROM conversations")
_add("heads_xor_count", lambda s, d: folds.aggregate(state.heads(tables.customers(s, d)), "xor_count", ("bucket",), F.col("hash")), f'SELECT bucket, bit_xor({_HEX("value", 1, 8)}) AS "xor", count(*) AS count FROM h GROUP BY bucket')
_add("sibling_terms", lambda s, d: _e(s, d).groupBy("bucket", "key").agg(F.collect_list(F.struct((F.col("jtype") == "tomb").alias("deleted"), F.transform("index_specs", lambda x: x["term_i"]).alias("index"))).alias("siblings")).select("bucket", "key", F.explode(tags.sibling_terms(F.col("siblings"))).alias("term")), "SELECT DISTINCT bucket, key, term FROM e WHERE NOT is_tomb")


# buckets with types, metadata, bytes beyond ASCII and rewritten keys
_b = tables.baskets
_TYPED = ("typed", "1-URGENT")
_KIND = "coalesce(bucket_type, '') AS bucket_type"
_BKEY = "CASE WHEN bucket_type IS NULL THEN '-' ELSE strlen(bucket_type) || ':' || bucket_type END || strlen(bucket) || ':' || bucket || strlen(key) || ':' || key || '-'"
_add("head_fold_typed", lambda s, d: folds.head_fold(_b(s, d), "o", buckets=[_TYPED, "2-HIGH"]).selectExpr(_KIND, "bucket", "key", "sqn", "size", "hash", "user_md['status'] AS status"), f"SELECT {_KIND}, bucket, key, sqn, strlen(value) AS size, {_HEX('value', 1, 8)} AS hash, status FROM bl WHERE bucket_type = 'typed' AND bucket = '1-URGENT' OR bucket_type IS NULL AND bucket = '2-HIGH'")
_add("key_list_typed", lambda s, d: folds.key_list(_b(s, d), "o", _TYPED, start="00000100", end="00000900", ordered=True).select("bucket_type", "bucket", "key"), "SELECT bucket_type, bucket, key FROM bl WHERE bucket_type = 'typed' AND bucket = '1-URGENT' AND key BETWEEN '00000100' AND '00000900'")
_add("bucket_list_typed", lambda s, d: folds.bucket_list(_b(s, d), "o", ordered=True).selectExpr(_KIND, "bucket"), f"SELECT DISTINCT {_KIND}, bucket FROM bl")
_add("bucket_first_typed", lambda s, d: folds.bucket_list(_b(s, d), "o", first=True), "SELECT DISTINCT bucket_type, bucket FROM bl WHERE bucket_type = 'typed' ORDER BY bucket LIMIT 1")
_add("bucket_stats_typed", lambda s, d: folds.bucket_stats(_b(s, d), "o").selectExpr(_KIND, "bucket", "total_size", "n_objects"), f"SELECT {_KIND}, bucket, CAST(sum(strlen(value)) AS BIGINT) AS total_size, count(*) AS n_objects FROM bl GROUP BY ALL")
_add("index_range_typed", lambda s, d: folds.index_range(_b(s, d), _TYPED, "year_bin", "é1996", "é1998", ordered=True), "SELECT term, key FROM bi WHERE bucket_type = 'typed' AND bucket = '1-URGENT' AND term BETWEEN 'é1996' AND 'é1998'")
_add("hash_list_typed", lambda s, d: folds.hash_list(_b(s, d), "o", check_presence=True).selectExpr(_KIND, "bucket", "key", "hash"), f"SELECT {_KIND}, bucket, key, {_HEX('value', 1, 8)} AS hash FROM bl")
_add("object_fold_typed", lambda s, d: folds.object_fold(_b(s, d), "o", bucket=_TYPED, ordered=True).selectExpr("sqn", _KIND, "bucket", "key", _TEXT), f"SELECT sqn, {_KIND}, bucket, key, value FROM bl WHERE bucket_type = 'typed' AND bucket = '1-URGENT'")
_add("object_fold_index_typed", lambda s, d: folds.object_fold_by_index(_b(s, d), "o", _TYPED, "year_bin", "é1995", "é1997").selectExpr("term", "key", "sqn", _TEXT), "SELECT term, key, sqn, value FROM bi WHERE bucket_type = 'typed' AND bucket = '1-URGENT' AND term BETWEEN 'é1995' AND 'é1997'")
_add("currency_typed", lambda s, d: reads.currency(_b(s, d), _b(s, d).select("tag", "bucket_type", "bucket", "key", F.col("sqn").alias("asked_sqn"))).selectExpr(_KIND, "bucket", "key", "asked_sqn", "status"), "SELECT coalesce(b.bucket_type, '') AS bucket_type, b.bucket, b.key, b.sqn AS asked_sqn, CASE WHEN bl.sqn > b.sqn THEN 'replaced' ELSE 'current' END AS status FROM b JOIN bl ON b.bucket_type IS NOT DISTINCT FROM bl.bucket_type AND b.bucket = bl.bucket AND b.key = bl.key")
_add("multi_get_typed", lambda s, d: reads.multi_get(_b(s, d), _customer_keys(s, d).withColumn("tag", F.lit("o")).withColumn("bucket", F.lit("1-URGENT")).withColumn("bucket_type", F.lit("typed"))).selectExpr("bucket", "key", "sqn", _TEXT), "SELECT bucket, key, sqn, value FROM bl WHERE bucket_type = 'typed' AND bucket = '1-URGENT'")
_add("tree_typed", lambda s, d: merkle.object_tree(state.ledger(_b(s, d)), "small"), f"SELECT CAST(((({_HEX(_BKEY, 5, 8)} & 65535) << 16) | {_HEX(_BKEY, 1, 4)}) & 65535 AS INTEGER) AS segment, bit_xor(xor({_HEX(_BKEY, 13, 8)}, {_HEX('value', 1, 8)})) AS leaf FROM bl GROUP BY 1 HAVING leaf <> 0")
_add("tree_partition", lambda s, d: merkle.object_tree(state.ledger(_b(s, d), where=F.col("key") < "00000700"), "xsmall"), f"SELECT CAST(((({_HEX(_BKEY, 5, 8)} & 65535) << 16) | {_HEX(_BKEY, 1, 4)}) & 16383 AS INTEGER) AS segment, bit_xor(xor({_HEX(_BKEY, 13, 8)}, {_HEX('value', 1, 8)})) AS leaf FROM bl WHERE key < '00000700' GROUP BY 1 HAVING leaf <> 0")
_add("next_key", lambda s, d: reads.next_key(_b(s, d), "o", _TYPED, "00000200").select("bucket_type", "bucket", "key", "sqn"), "SELECT bucket_type, bucket, key, sqn FROM bl WHERE bucket_type = 'typed' AND bucket = '1-URGENT' AND key >= '00000200' ORDER BY key LIMIT 1")
_add("proxy_fetch", lambda s, d: reads.fetch_proxies(reads.proxies(state.ledger(_b(s, d))).select("key", "proxy"), _b(s, d)).selectExpr("key", "proxy.sqn AS sqn", "proxy.size AS size", _TEXT), "SELECT key, sqn, strlen(value) AS size, value FROM bl")
_add("journal_values", lambda s, d: _b(s, d).selectExpr("sqn", _TEXT, "octet_length(value) AS size", "crc32(value) AS crc"), None)
_CLOCK = _HEX("'a:' || (o_custkey % 7) || ',b:' || (o_orderkey % 5)", 1, 8)
_add("head_siblings", lambda s, d: folds.head_fold(_b(s, d, "o_rkv"), "o_rkv").selectExpr(_KIND, "bucket", "key", "hash", "lmd", "size(siblings) AS n_siblings", "vclock[1].n AS ticks"), f"SELECT {_KIND}, bucket, key, {_CLOCK} AS hash, lmd + 60 AS lmd, 2 AS n_siblings, o_custkey % 7 AS ticks FROM bl")
_add("sibling_index_terms", lambda s, d: state.ledger(_b(s, d, "o_rkv")).select("bucket_type", "bucket", "key", F.explode(tags.sibling_terms(F.col("siblings"))).alias("t")).selectExpr(_KIND, "bucket", "key", "t.field AS field", "t.term_i AS term"), f"SELECT {_KIND}, bucket, key, field, o_custkey AS term FROM bl, (VALUES ('x_int', true), ('y_int', false)) AS f(field, always) WHERE always OR status <> 'F'")
_add("head_lmd_siblings", lambda s, d: folds.head_fold(_b(s, d, "o_rkv"), "o_rkv", modified=(820_454_400 + 60, 852_076_800)).selectExpr(_KIND, "bucket", "key"), f"SELECT {_KIND}, bucket, key FROM bl WHERE lmd BETWEEN 820454400 AND 852076740")

# folds over heads of batches
_c = tables.customers
_add("head_fold_heads", lambda s, d: folds.head_fold(_c(s, d), "h", buckets=["BUILDING", "MACHINERY"]).selectExpr("bucket", "key", "size", "CAST(head_value AS STRING) AS value"), "SELECT bucket, key, strlen(value) AS size, value FROM h WHERE bucket IN ('BUILDING', 'MACHINERY')")
_add("key_list_heads", lambda s, d: folds.key_list(_c(s, d), "h").select("bucket", "key"), "SELECT bucket, key FROM h")
_add("bucket_list_heads", lambda s, d: folds.bucket_list(_c(s, d), "h").select("bucket"), "SELECT DISTINCT bucket FROM h")
_add("bucket_stats_heads", lambda s, d: folds.bucket_stats(_c(s, d), "h").drop("bucket_type"), "SELECT bucket, CAST(sum(strlen(value)) AS BIGINT) AS total_size, count(*) AS n_objects FROM h GROUP BY bucket")
_add("hash_list_heads", lambda s, d: folds.hash_list(_c(s, d), "h").select("bucket", "key", "hash"), f"SELECT bucket, key, {_HEX('value', 1, 8)} AS hash FROM h")
_add("tree_heads", lambda s, d: merkle.object_tree(state.ledger(_c(s, d)), "xsmall"), f"SELECT CAST(((({_HEX('bucket || key', 5, 8)} & 65535) << 16) | {_HEX('bucket || key', 1, 4)}) & 16383 AS INTEGER) AS segment, bit_xor(xor({_HEX('bucket || key', 13, 8)}, {_HEX('value', 1, 8)})) AS leaf FROM h GROUP BY 1 HAVING leaf <> 0")
_add("head_segments_heads", lambda s, d: folds.head_fold(_c(s, d), "h", segments=_SEGMENTS).select("bucket", "key"), f"SELECT bucket, key FROM h WHERE ({_HEX('bucket || key', 1, 4)} & 32767) % 16 = 0")
_add("head_only_get", lambda s, d: state.heads(_c(s, d), where=(F.col("tag") == "h") & state.bucket_is("BUILDING") & (F.col("key") >= "00000100")).selectExpr("bucket", "key", _TEXT), "SELECT bucket, key, value FROM h WHERE bucket = 'BUILDING' AND key >= '00000100'")
_add("is_empty", lambda s, d: s.createDataFrame([(t, reads.is_empty(_c(s, d), t)) for t in ("h", "o")], "tag string, empty boolean"), "SELECT 'h' AS tag, count(*) = 0 AS empty FROM h UNION ALL SELECT 'o', true")

# what folds gather
_add("fold_bucket_set", lambda s, d: folds.aggregate(state.ledger(_e(s, d), now=NOW), "bucket_set").select(F.explode("buckets").alias("bucket")), "SELECT DISTINCT bucket FROM ev")


def _until(row: dict, acc: dict) -> dict:
    if row["key"] > "00000080":
        raise StopIteration
    return {"n": acc["n"] + 1, "last": row["key"]}


_add("fold_early_stop", lambda s, d: folds.fold_groups(folds.key_list(_e(s, d), "o_rkv", now=NOW).select("bucket", "key"), ("bucket",), ("key",), _until, lambda: {"n": 0, "last": ""}, "bucket string, n long, last string"), "SELECT bucket, count(*) FILTER (WHERE key <= '00000080') AS n, coalesce(max(key) FILTER (WHERE key <= '00000080'), '') AS last FROM ev GROUP BY bucket")
_add("fold_sequential", lambda s, d: s.createDataFrame([(folds.fold(folds.bucket_list(_e(s, d), "o_rkv", now=NOW), ("bucket",), lambda row, acc: f"{acc}/{row['bucket']}", ""),)], "buckets string"), "SELECT '/' || string_agg(bucket, '/' ORDER BY bucket) AS buckets FROM (SELECT DISTINCT bucket FROM ev)")

# trees and segments
_add("tree_export", lambda s, d: merkle.import_tree(s, merkle.export_tree(merkle.object_tree(state.ledger(_o(s, d)), "xsmall"), "xsmall"))[1], _tree_sql("xsmall"))
_add("tree_sizes", lambda s, d: s.createDataFrame([(n, hashing.TREE_SIZES.get(n, 0) * 256, merkle.valid_size(n)) for n in ("xxsmall", "xsmall", "small", "medium", "large", "xlarge", "huge")], "size string, leaves long, valid boolean"), "SELECT * FROM (VALUES ('xxsmall', 4096::BIGINT, true), ('xsmall', 16384, true), ('small', 65536, true), ('medium', 262144, true), ('large', 1048576, true), ('xlarge', 4194304, true), ('huge', 0, false)) AS t(size, leaves, valid)")
_add("tree_new", lambda s, d: merkle.merge(merkle.new_tree(s), merkle.object_tree(state.ledger(_o(s, d)), "xxsmall")), _tree_sql("xxsmall"))
_add("segment_filters", lambda s, d: s.createDataFrame([(size, n, x) for size in ("xxsmall", "xsmall", "small") for n in (2, 5) for x in merkle.segment_filter(list(range(n)), size) or []], "size string, n long, segment long"), "SELECT size, n, segment FROM (SELECT 'xsmall' AS size, 2::BIGINT AS n, a.range + b.x AS segment FROM range(2) a, (VALUES (0), (16384), (32768), (49152)) AS b(x) UNION ALL SELECT 'small', n.n, r.range FROM (VALUES (2::BIGINT), (5)) AS n(n), range(5) r WHERE r.range < n.n)")
_add("segment_match", lambda s, d: s.createDataFrame([(a, b, merkle.match_segment((a, "xxsmall"), (b, "xsmall"))) for a in range(0, 4_096, 512) for b in range(0, 16_384, 512)], "a long, b long, same boolean"), "SELECT a.range AS a, b.range AS b, a.range & 4095 = b.range & 4095 AS same FROM range(0, 4096, 512) a, range(0, 16384, 512) b")
_add("segment_join", lambda s, d: s.createDataFrame([(b, l, merkle.join_segment(b, l)) for b in range(0, 64, 3) for l in range(0, 256, 17)], "branch long, leaf long, segment long"), "SELECT b.range AS branch, l.range AS leaf, b.range * 256 + l.range AS segment FROM range(0, 64, 3) b, range(0, 256, 17) l")

# scalar functions
_add("magic_hash", lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", hashing.magic_hash(F.transform(F.filter(F.split("c_name", ""), lambda c: c != ""), lambda c: F.ascii(c))).alias("hash")), "SELECT c_custkey, list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(c_name, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor((a * 33) & 4294967295, b)) AS hash FROM customer")
_add("clocks", lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", unix_seconds(F.col("ts")).alias("unix"), gregorian(unix_seconds(F.col("ts"))).alias("gregorian")), f"SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS unix, CAST(floor(epoch(ts)) AS BIGINT) + {GREGORIAN_EPOCH} AS gregorian FROM events")
_add("canonical_keys", lambda s, d: state.ledger(_b(s, d)).selectExpr("*").select(tags.canonical_keys(F.col("tag"), *[F.col(k) for k in state.KEYS[1:]]).alias("canonical"), "sqn"), f"SELECT {_BKEY} AS canonical, sqn FROM bl")


def _own_tag(s: SparkSession, d: str) -> DataFrame:
    tags.register("recovered", strategy="recovr")
    return maintain.decisions(_e(s, d).withColumn("tag", F.lit("recovered"))).select("sqn", "decision")


_add("compaction_registered_tag", _own_tag, "SELECT e.sqn, CASE WHEN el.sqn = e.sqn THEN 'keep' ELSE 'discard' END AS decision FROM e JOIN el ON e.bucket = el.bucket AND e.key = el.key")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
