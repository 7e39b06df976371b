"""Queries over stores on disk: what is written, kept up and read back there, with the same in DuckDB's SQL.

Each call makes a store of its own from the test tables in the scratch folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvstrata.operators import maintain, merkle, reads, state
from kvstrata.plans import queries as queries_
from kvstrata.plans.queries import _PRE, NOW, Query
from kvstrata.sources import scratch, tables
from kvstrata.sources.journal import conform, read_journal, write_journal
from kvstrata.store import Store
from kvstrata.streaming import ingest

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_TEXT = "CAST(value AS STRING) AS value"
_KIND = "coalesce(bucket_type, '') AS bucket_type"


def _add(name: str, query: Query, sql: str) -> None:
    _QUERIES[name] = query
    _SQL[name] = _PRE + sql


def _store(s: SparkSession, name: str, **options) -> Store:
    return Store(s, scratch.folder(s, name), now=lambda: NOW, **options)


def _in_parts(s: SparkSession, rows: DataFrame, name: str, parts: int = 4, **options) -> Store:
    """A store of a journal, loaded in ranges of numbers; each range is a closed part."""
    store = _store(s, name, part_records=1, **options)
    last = rows.agg(F.max("sqn")).first()[0] or 0
    step = -(-last // parts) or 1
    for k in range(parts):
        # what was loaded ends at the last number, so a row keeps its own
        range_ = rows.filter((F.col("sqn") > k * step) & (F.col("sqn") <= (k + 1) * step))
        if not range_.isEmpty():
            store.load(range_.withColumn("sqn", F.col("sqn") - store.last_sqn()))
    return store


def _objects(store: Store, tag: str = "o") -> DataFrame:
    return store.query("object_fold", tag=tag).selectExpr("sqn", _KIND, "bucket", "key", _TEXT)


_BL = f"SELECT sqn, {_KIND}, bucket, key, value FROM bl"


def _puts(s: SparkSession, d: str) -> DataFrame:
    store = _store(s, "puts")
    store.put("o", "b", "k1", "old", [("add", "f_int", 1)])
    with store.batch():
        store.put("o", "b", "k1", "neu €", [("remove", "f_int", 1), ("add", "f_int", 2)], user_md={"a": "b"}, lmd=5)
        store.put("o", ("t", "b"), "k1", "typed")
        store.put("o", "b", "gone", "x")
        store.delete("o", "b", "gone")
        store.put("o", "b", "short", "expired", expires_at=NOW - 1)
        store.put("o", "b", "long", "not yet", expires_at=NOW)
    store.put("o", "b", "held", "back", sync=False)
    return _objects(store)


_add("store_puts", _puts, "SELECT * FROM (VALUES (2::BIGINT, '', 'b', 'k1', 'neu €'), (3, 't', 'b', 'k1', 'typed'), (7, '', 'b', 'long', 'not yet'), (8, '', 'b', 'held', 'back')) AS t(sqn, bucket_type, bucket, key, value)")


def _mputs(s: SparkSession, d: str) -> DataFrame:
    store = _store(s, "mputs", head_only=True)
    store.mput([("add", ("t", "b"), "k", f"s{i}", f"v{i}", [i, 10 - i]) for i in range(4)])
    store.mput([("remove", ("t", "b"), "k", "s1", None), ("add", ("t", "b"), "k", "s0", "again")])
    found = store.headonly(("t", "b"), "k", "s0")
    for sub in ("s1", "s2", "s3"):
        found = found.unionByName(store.headonly(("t", "b"), "k", sub))
    return found.selectExpr("bucket_type", "bucket", "key", "subkey", _TEXT)


_add("store_mputs", _mputs, "SELECT * FROM (VALUES ('t', 'b', 'k', 's0', 'again'), ('t', 'b', 'k', 's2', 'v2'), ('t', 'b', 'k', 's3', 'v3')) AS t(bucket_type, bucket, key, subkey, value)")


def _loaded(s: SparkSession, d: str) -> DataFrame:
    store = _in_parts(s, tables.baskets(s, d), "loaded", codec="zstd")
    return _objects(store)


_add("store_journal", _loaded, _BL)


def _settled(s: SparkSession, d: str) -> DataFrame:
    """The keys of a store whose state was stored twice, with writes after that."""
    rows = tables.baskets(s, d)
    store = _in_parts(s, rows.filter("sqn <= 3000"), "settled", 2)
    store.settle()
    for lo, hi in ((3000, 4000), (4000, 1 << 60)):
        more = rows.filter((F.col("sqn") > lo) & (F.col("sqn") <= hi))
        if not more.isEmpty():
            store.load(more.withColumn("sqn", F.col("sqn") - store.last_sqn()))
        if hi == 4000:
            store.settle()
    return _objects(store)


_add("store_settled", _settled, _BL)
_add("store_settled_index", lambda s, d: (lambda store: (store.settle(), store.query("index_range", bucket=("typed", "1-URGENT"), field="year_bin", start="é1996", end="é1998"))[1])(_in_parts(s, tables.baskets(s, d), "index")), "SELECT term, key FROM bi WHERE bucket_type = 'typed' AND bucket = '1-URGENT' AND term BETWEEN 'é1996' AND 'é1998'")


def _compacted(run: dict, then: Callable[[Store], DataFrame]) -> Query:
    def query(s: SparkSession, d: str) -> DataFrame:
        store = _in_parts(s, tables.baskets(s, d), "compacted")
        store.compact(**run)
        return then(store)

    return query


_add("store_compacted", _compacted({"single_target": 60.0, "run_target": 99.0}, _objects), _BL)
_add("compaction_run", _compacted({"single_target": 101.0, "run_target": 101.0, "longest": 4}, lambda x: x.journal().groupBy("jtype").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("bodies"))), """, runs AS (
  SELECT s, e FROM (SELECT s.range AS s, e.range AS e FROM range(4) s, range(4) e WHERE s.range <= e.range)),
p AS (SELECT b.sqn, b.value, (b.sqn - 1) // (((SELECT max(sqn) FROM b) + 3) // 4) AS part, bl.sqn = b.sqn AS active
  FROM b JOIN bl ON b.bucket_type IS NOT DISTINCT FROM bl.bucket_type AND b.bucket = bl.bucket AND b.key = bl.key),
sc AS (SELECT part, 100.0 * sum(CASE WHEN active THEN strlen(value) ELSE 0 END) / sum(strlen(value)) AS score FROM p GROUP BY part),
best AS (SELECT s, e FROM runs JOIN sc ON part BETWEEN s AND e GROUP BY s, e ORDER BY 101.0 - avg(score) DESC, e - s DESC, s LIMIT 1)
SELECT CASE WHEN active OR part NOT BETWEEN s AND e THEN 'stnd' ELSE 'keyd' END AS jtype, count(*) AS n, CAST(sum(CASE WHEN active OR part NOT BETWEEN s AND e THEN 1 ELSE 0 END) AS BIGINT) AS bodies FROM p, best GROUP BY 1""")


def _backup(s: SparkSession, d: str) -> DataFrame:
    store = _in_parts(s, tables.baskets(s, d), "origin", 2)
    path = scratch.folder(s, "backup")
    store.backup(path)
    store.put("o", "b", "later", "not in the copy")
    return _objects(Store(s, path, now=store.now))


_add("store_backup", _backup, _BL)


def _snapshot(s: SparkSession, d: str) -> DataFrame:
    store = _in_parts(s, tables.baskets(s, d), "snapshot", 2)
    seen, runner = store.snapshot(), store.runner(lambda x: x.query("key_list", tag="o"))
    store.delete("o", "1-URGENT", "00000001")
    store.put("o", "new", "k", "v")
    return seen.query("key_list", tag="o").selectExpr(_KIND, "bucket", "key").withColumn("how", F.lit("snapshot")).unionByName(runner.run().selectExpr(_KIND, "bucket", "key").withColumn("how", F.lit("runner")))


_add("store_snapshot", _snapshot, f"SELECT {_KIND}, bucket, key, how FROM bl, (VALUES ('snapshot'), ('runner')) AS h(how)")


def _trimmed(s: SparkSession, d: str) -> DataFrame:
    store = _store(s, "trimmed", head_only=True, part_records=1)
    store.load(tables.customers(s, d))
    store.settle()
    store.trim()
    return store.query("head_fold", tag="h").selectExpr("bucket", "key", "CAST(head_value AS STRING) AS value", "sqn")


_add("store_trimmed_heads", _trimmed, "SELECT bucket, key, value, CAST(1 AS BIGINT) AS sqn FROM h")


def _handed_off(s: SparkSession, d: str) -> DataFrame:
    path = scratch.folder(s, "handed")
    maintain.hand_off(tables.baskets(s, d), "o", path)
    other = read_journal(s, path)
    return state.ledger(other).selectExpr("sqn", _KIND, "bucket", "key", "hash")


_add("store_hand_off", _handed_off, f"SELECT sqn, {_KIND}, bucket, key, CAST('0x' || substr(md5(value), 1, 8) AS BIGINT) AS hash FROM bl")


def _replayed(s: SparkSession, d: str) -> DataFrame:
    """The ledger from the journal of a compacted store, without any stored state."""
    store = _in_parts(s, tables.events(s, d), "replayed")
    store.settle()
    store.compact(whole=True)
    return state.index(Store(s, store.path, now=store.now).journal(), now=NOW).select("bucket", F.col("term_i").alias("term"), "key", "sqn")


_add("store_replay", _replayed, "SELECT bucket, term, key, sqn FROM ei")
_add("store_tree", lambda s, d: (lambda store: (store.settle(), store.query("object_tree", size="small", check_presence=True))[1])(_in_parts(s, tables.events(s, d), "tree")), "SELECT CAST((((CAST('0x' || substr(md5(bucket || key), 5, 8) AS BIGINT) & 65535) << 16) | CAST('0x' || substr(md5(bucket || key), 1, 4) AS BIGINT)) & 65535 AS INTEGER) AS segment, bit_xor(xor(CAST('0x' || substr(md5(bucket || key), 13, 8) AS BIGINT), CAST('0x' || substr(md5(value), 1, 8) AS BIGINT))) AS leaf FROM ev GROUP BY 1 HAVING leaf <> 0")


def _streamed(s: SparkSession, d: str, then: Callable[[str], DataFrame]) -> DataFrame:
    path = scratch.folder(s, "stream")
    rows = tables.events(s, d)
    for k in range(3):
        write_journal(conform(rows.filter(F.pmod(F.floor(F.col("sqn") / 500), F.lit(3)) == k)), f"{path}/journal")
    return then(path)


def _stream_ledger(s: SparkSession, path: str) -> DataFrame:
    ingest.maintain_ledger(ingest.journal_stream(s, f"{path}/journal", 2), f"{path}/ledger", f"{path}/checkpoint").awaitTermination()
    return ingest.read_ledger(s, f"{path}/ledger").select("bucket", "key", "sqn", "is_tomb")


def _stream_tree(s: SparkSession, path: str) -> DataFrame:
    ingest.maintain_tree(ingest.journal_stream(s, f"{path}/journal", 4), f"{path}/kept", f"{path}/checkpoint", "xsmall").awaitTermination()
    return ingest.read_tree(s, f"{path}/kept")


_add("stream_ledger", lambda s, d: _streamed(s, d, lambda path: _stream_ledger(s, path)), "SELECT bucket, key, sqn, is_tomb FROM el")
_add("stream_tree", lambda s, d: _streamed(s, d, lambda path: _stream_tree(s, path)), "SELECT CAST((((CAST('0x' || substr(md5(bucket || key), 5, 8) AS BIGINT) & 65535) << 16) | CAST('0x' || substr(md5(bucket || key), 1, 4) AS BIGINT)) & 16383 AS INTEGER) AS segment, bit_xor(xor(CAST('0x' || substr(md5(bucket || key), 13, 8) AS BIGINT), CAST('0x' || substr(md5(value), 1, 8) AS BIGINT))) AS leaf FROM el WHERE NOT is_tomb GROUP BY 1 HAVING leaf <> 0")
_add("store_presence", lambda s, d: (lambda store: (store.compact(whole=True), reads.present(state.index(store.journal(), now=NOW), store.journal()).select("bucket", "key", "sqn"))[1])(_in_parts(s, tables.events(s, d), "presence")), "SELECT ei.bucket, ei.key, ei.sqn FROM ei JOIN el ON ei.bucket = el.bucket AND ei.key = el.key AND ei.sqn = el.sqn")
_add("store_merged_trees", lambda s, d: (lambda store: merkle.merge(*[store.query("object_tree", size="small", where=c) for c in (F.col("bucket_type").isNull(), F.col("bucket_type").isNotNull())]))(_in_parts(s, tables.baskets(s, d), "merged", 2)), queries_.oracle_sql()["tree_typed"].removeprefix(_PRE))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
