"""The store: writes, visibility, snapshots, folds, upkeep and streams."""

import pytest
from pyspark.sql import functions as F

from kvstrata.functions import hashing, tags
from kvstrata.functions.clocks import GREGORIAN_EPOCH
from kvstrata.operators import folds, maintain, merkle, reads, state
from kvstrata.sources.journal import SCHEMA, conform, read_journal, write_journal
from kvstrata.store import Store, UnsupportedMessage
from kvstrata.streaming import ingest


class Clock:
    def __init__(self, at):
        self.at = at

    def __call__(self):
        return self.at


def rows(df, *cols):
    """The rows in order; byte values as text."""
    df = df.select(*cols)
    text = [F.col(f.name).cast("string").alias(f.name) if f.dataType.simpleString() == "binary" else F.col(f.name) for f in df.schema.fields]
    return sorted(tuple(r) for r in df.select(*text).collect())


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), now=Clock(GREGORIAN_EPOCH + 1_000))


def test_put_get_delete(store):
    assert store.is_empty("o")
    store.put("o", "b", "k1", "v1", [("add", "f_bin", "t1")])
    store.put("o", "b", "k1", "v2", [("remove", "f_bin", "t1"), ("add", "f_bin", "t2")])
    store.put("o", "b", "k2", "w", [("add", "n_int", 7)])
    assert rows(store.get("o", "b", "k1"), "value", "sqn") == [("v2", 2)]
    assert store.sqn("o", "b", "k1") == 2
    assert rows(store.query("index_range", bucket="b", field="f_bin", start="a", end=None), "term", "key") == [("t2", "k1")]
    assert rows(store.query("index_range", bucket="b", field="n_int", start=1, end=9), "term", "key") == [(7, "k2")]
    store.delete("o", "b", "k1")
    assert store.get("o", "b", "k1").count() == 0
    # a delete does not reach into the index
    assert store.query("index_range", bucket="b", field="f_bin", start="a", end="z").count() == 1
    store.delete("o", "b", "k2")
    assert store.is_empty("o") and store.query("bucket_list", tag="o").count() == 0


def test_expiry(store):
    now = store.now()
    store.put("o", "b", "k", "old", [("add", "f_int", 1)])
    store.put("o", "b", "k", "new", [("add", "f_int", 2)], expires_at=now + 10)
    assert rows(store.get("o", "b", "k"), "value") == [("new",)]
    store.now.at = now + 10
    assert store.get("o", "b", "k").count() == 1
    store.now.at = now + 11
    assert store.get("o", "b", "k").count() == 0  # the older version does not come back
    assert rows(store.query("index_range", bucket="b", field="f_int", start=0, end=9), "term") == [(1,)]
    assert store.query("object_fold", tag="o", order="sqn_order").count() == 1  # write order does not look at expiry


def test_snapshot_and_runner(store):
    store.put("o", "b", "k1", "v1")
    before, at_request = store.snapshot(), store.runner(lambda s: s.query("key_list", tag="o"))
    at_run = store.runner(lambda s: s.query("key_list", tag="o"), at_run=True)
    store.put("o", "b", "k2", "v2")
    store.put("o", "b", "k1", "v3")
    assert rows(before.get("o", "b", "k1"), "value") == [("v1",)] and before.get("o", "b", "k2").count() == 0
    assert at_request.run().count() == 1 and at_run.run().count() == 2
    with pytest.raises(UnsupportedMessage):
        before.put("o", "b", "k", "v")


def test_stored_state(store):
    for i in range(6):
        store.put("o", "b", f"k{i % 4}", f"v{i}", [("add", "f_int", i)])
    assert store.stored() is None and store.settle() == 6 and store.stored().sqn == 6
    early = Store(store.spark, store.path, now=store.now, at=3)
    assert early.stored() is None and early.query("key_list", tag="o").count() == 3
    store.delete("o", "b", "k0", [("remove", "f_int", 4)])
    store.put("o", "b", "new", "n")
    with_base, without = store._at(), store._when()
    for ask in (lambda at: folds.key_list(store.journal(), "o", **at), lambda at: folds.index_range(store.journal(), "b", "f_int", 0, 9, **at), lambda at: folds.object_fold(store.journal(), "o", **at).select("key", "value"), lambda at: folds.object_fold(store.journal(), "o", order="sqn_order", **at).select("key", "value")):
        assert rows(ask(with_base), "*") == rows(ask(without), "*")
    assert store.settle() == 8 and store.stored().ledger.filter("is_tomb").count() == 0  # levels became one
    plan = folds.key_list(store.journal(), "o", "b", start="k1", end="k2", base=store.stored())._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(sqn,8)" in plan and "GreaterThanOrEqual(key,k1)" in plan


def test_head_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "heads"), head_only=True, now=Clock(GREGORIAN_EPOCH))
    store.mput([("add", "b", "k", "s1", "v1", [5, 9]), ("add", "b", "k", "s2", "v2"), ("add", "b", "k", "s1", "repeated")])
    assert rows(store.headonly("b", "k", "s1"), "value") == [("v1",)]
    store.mput([("remove", "b", "k", "s1", None)])
    assert store.headonly("b", "k", "s1").count() == 0 and store.headonly("b", "k", "s2").count() == 1
    assert store.last_sqn() == 2
    for refused in (lambda: store.put("o", "b", "k", "v"), lambda: store.get("o", "b", "k")):
        with pytest.raises(UnsupportedMessage):
            refused()
    with pytest.raises(UnsupportedMessage):
        Store(spark, str(tmp_path / "x")).mput([])


def test_folds_of_heads(spark, tmp_path):
    """Folds, trees and is_empty see the heads of a head-only store, also over a stored state."""
    store = Store(spark, str(tmp_path / "folded"), head_only=True, now=Clock(GREGORIAN_EPOCH))
    store.mput([("add", b, f"k{i}", None, f"v{i}", [i]) for b in ("a", "b", "c") for i in range(4)])
    store.mput([("remove", "a", "k0", None, None)])
    left = [(b, f"k{i}") for b in ("a", "b", "c") for i in range(4) if (b, i) != ("a", 0)]
    for settled in (False, True):
        if settled:
            store.settle()
            store.mput([("add", "c", "k9", None, "v9")])
            left.append(("c", "k9"))
        assert rows(store.query("head_fold", tag="h"), "bucket", "key") == left == rows(store.query("key_list", tag="h"), "bucket", "key")
        assert rows(store.query("head_fold", tag="h", buckets=["a", "b"], modified=(2, 9)), "bucket", "key") == [(b, k) for b, k in left if b < "c" and k > "k1"]
        assert rows(store.query("head_fold", tag="h", max_count=5), "bucket", "key") == left[:5]
        segment = state.with_segment(store.query("head_fold", tag="h", buckets=["b"])).filter("key = 'k2'").select("segment.seg16").first()[0]
        assert ("b", "k2") in rows(store.query("head_fold", tag="h", segments=[segment]), "bucket", "key")
        assert rows(store.query("bucket_stats", tag="h"), "bucket", "n_objects") == [(b, sum(x == b for x, _ in left)) for b in "abc"]
        assert store.query("hash_list", tag="h").count() == len(left) and store.query("object_tree").count() > 0
        assert not store.is_empty("h") and store.is_empty("o")


def test_functions_of_a_registered_tag(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tags, "_REGISTRY", dict(tags._REGISTRY))
    store = Store(spark, str(tmp_path / "own"), now=Clock(GREGORIAN_EPOCH))
    for value in ("old", "new value"):
        for tag in ("mine", "o"):
            store.put(tag, "b", "k", value)
    plain = rows(store.query("object_tree", where=F.col("tag") == "mine"), "segment")
    size = lambda record: {"hash": F.lit(7), "size": F.octet_length(record["value"]) * 2}
    head = lambda md: md | {"user_md": F.create_map(F.lit("by"), F.lit("me"))}
    tags.register("mine", strategy="recovr", extract_metadata=size, build_head=head, canonical_key=lambda t, b, k, s: F.concat(F.lit("own"), k))
    assert rows(store.query("head_fold", tag="mine"), "hash", "size") == [(7, 18)]
    assert store.query("head_fold", tag="mine").first()["user_md"] == {"by": "me"} and store.query("head_fold", tag="o").first()["size"] == 9
    assert rows(store.query("object_tree", where=F.col("tag") == "mine"), "segment") != plain
    assert rows(maintain.decisions(store.journal()), "tag", "sqn", "decision") == [("mine", 1, "discard"), ("mine", 3, "keep"), ("o", 2, "convert"), ("o", 4, "keep")]


def many(spark, n, **more):
    rows = spark.range(1, n + 1).select(F.col("id").alias("sqn"), F.lit("o").alias("tag"), (F.col("id") % 3).cast("string").alias("bucket"), F.lpad(F.col("id").cast("string"), 6, "0").alias("key"), F.concat(F.lit("v"), "id").alias("value"), F.when(F.col("id") % 4 > 0, F.col("id") * 10).alias("lmd"))
    for c, v in more.items():
        rows = rows.withColumn(c, v)
    return conform(rows)


def test_head_folds(spark):
    journal = many(spark, 300)
    assert folds.head_fold(journal, "o", buckets=["2", "0"]).count() == 200
    found = folds.head_fold(journal, "o", buckets=["2", "0"], max_count=120)
    assert [r["n"] for r in found.groupBy("bucket").agg(F.count("*").alias("n")).orderBy(F.desc("bucket")).collect()] == [100, 20]
    assert folds.remaining(folds.head_fold(journal, "o", buckets=["1"], max_count=130), 130).first()[:] == (30, 100)
    # entries without a date pass every range, and both ends count
    assert folds.head_fold(journal, "o", modified=(10, 30)).count() == 75 + 3
    wanted = state.with_segment(state.ledger(journal)).filter("key = '000042'").first()["segment"]["seg16"]
    near = folds.head_fold(journal, "o", segments=[wanted ^ 0x8000])
    assert "000042" in [r["key"] for r in near.collect()]
    assert folds.head_fold(journal, "o", check_presence=True).count() == 300
    assert folds.fold(folds.key_list(journal, "o"), ("key",), lambda r, acc: acc + 1, 0) == 300

    def until_ten(row, acc):
        if acc == 10:
            raise StopIteration(acc)
        return acc + 1

    assert folds.fold(folds.key_list(journal, "o"), ("key",), until_ten, 0) == 10


def test_typed_buckets_sort_first(spark):
    journal = conform(spark.createDataFrame([(1, "o", None, "a", "k"), (2, "o", "t", "z", "k")], "sqn long, tag string, bucket_type string, bucket string, key string"))
    assert folds.bucket_list(journal, "o", first=True).first()["bucket"] == "z"
    assert folds.bucket_list(journal, "o").count() == 2


def test_index_seek_and_regex(spark):
    specs = F.array(F.struct(F.lit("add").alias("op"), F.lit("f").alias("field"), F.lpad((F.col("id") % 10).cast("string"), 2, "0").alias("term_s"), F.lit(None).cast("long").alias("term_i")))
    journal = conform(spark.range(1, 101).select(F.col("id").alias("sqn"), F.lit("o").alias("tag"), F.lit("b").alias("bucket"), F.lpad(F.col("id").cast("string"), 3, "0").alias("key"), specs.alias("index_specs")))
    whole = folds.index_range(journal, "b", "f", "03", "05")
    assert whole.count() == 30
    after = folds.index_range(journal, "b", "f", "03", "05", start_key="050")
    assert after.count() == 5 + 20  # keys of the first term only are held back
    assert folds.index_range(journal, "b", "f", "00", "99", regex="[12]$").count() == 20
    with pytest.raises(TypeError):
        folds.index_range(journal, "b", "f", 1, 2, regex="1")


def test_trees(spark):
    journal = many(spark, 500)
    whole = merkle.object_tree(state.ledger(journal), "xsmall")
    part = merkle.object_tree(state.ledger(journal.filter("sqn <> 77")), "xsmall")
    dirty = [r[0] for r in merkle.dirty_leaves(whole, part).collect()]
    own = state.with_segment(state.ledger(journal)).filter("key = '000077'").select(hashing.tree_segment(hashing.segment32(F.col("segment")), "xsmall")).first()[0]
    assert dirty == [own]
    assert merkle.dirty_branches(whole, part).count() == 1
    with pytest.raises(ValueError):
        merkle.dirty_leaves(whole, part, ("xsmall", "small"))
    thirds = [merkle.object_tree(state.ledger(journal.filter(f"sqn % 3 = {i}")), "xsmall") for i in range(3)]
    assert merkle.dirty_leaves(whole, merkle.merge(*thirds)).count() == 0
    size, again = merkle.import_tree(spark, merkle.export_tree(whole, "xsmall"))
    assert size == "xsmall" and merkle.dirty_leaves(whole, again).count() == 0
    old = whole.filter(F.col("segment") == own).select("segment", "leaf")
    assert merkle.dirty_leaves(whole, merkle.alter(part, old)).count() == 0


def test_segments_of_trees():
    assert merkle.segment_filter([1], "xxsmall") is None and merkle.segment_filter([1], "small") == [1]
    assert len(merkle.segment_filter([1, 2], "xsmall")) == 8 and merkle.segment_filter([1, 2, 3, 4, 5], "xsmall") is None
    assert merkle.adjust_segments([5], "xxsmall", "xsmall") == [5, 5 + 4096, 5 + 8192, 5 + 12288]
    assert merkle.match_segment((5, "xxsmall"), (5 + 4096, "xsmall")) and not merkle.match_segment((5, "small"), (6, "small"))
    assert merkle.join_segment(3, 7) == 775 and merkle.valid_size("large") and not merkle.valid_size("huge")


def test_md5_segments_are_big_endian(spark):
    import hashlib

    d = hashlib.md5(b"abc").digest()
    got = spark.range(1).select(hashing.segment_hash(F.lit("abc")).alias("h")).first()["h"]
    assert (got["seg16"], got["extra32"], got["alt32"]) == (int.from_bytes(d[:2]), int.from_bytes(d[2:6]), int.from_bytes(d[6:10]))
    acc = 5381
    for b in b"key":
        acc = ((acc * 33) & 0xFFFFFFFF) ^ b
    assert spark.range(1).select(hashing.magic_hash(F.array(*[F.lit(b) for b in b"key"]))).first()[0] == acc


def test_compaction(store, spark):
    for i in range(4):
        store.put("o", "b", "k", f"v{i}", [("add", "f_int", i)])
    store.delete("o", "b", "gone")
    store.put("o", "b", "gone", "back")
    kinds = {r["sqn"]: r["decision"] for r in maintain.decisions(store.journal()).collect()}
    assert kinds == {1: "convert", 2: "convert", 3: "convert", 4: "keep", 5: "keep", 6: "keep"}
    assert {r["sqn"] for r in maintain.compact(store.journal(), strategies={"o": "recovr"}).collect()} == {4, 6}
    assert {r["decision"] for r in maintain.decisions(store.journal(), persisted=0).collect()} == {"keep"}
    before = rows(store.query("index_range", bucket="b", field="f_int", start=0, end=9), "term", "key")
    assert len(store.compact(whole=True)) == 1
    assert rows(store.query("index_range", bucket="b", field="f_int", start=0, end=9), "term", "key") == before
    assert rows(store.get("o", "b", "k"), "value") == [("v3",)]
    # the posting of an older version has no body any more
    assert rows(store.query("object_fold_by_index", tag="o", bucket="b", field="f_int", start=0, end=9), "term") == [(3,)]


def test_best_run():
    assert maintain.best_run([100.0, 100.0]) is None
    assert maintain.best_run([0.0, 90.0, 90.0])[:2] == (0, 1) and maintain.best_run([]) is None
    assert maintain.best_run([50.0, 50.0], longest=2, single_target=60.0, run_target=60.0) == (0, 2, 10.0)  # of equal gains the longer run
    first, n, gain = maintain.best_run([60.0] * 10)
    assert (first, n) == (0, 8) and gain == pytest.approx(10)


def test_backup_hand_off_and_difference(spark, tmp_path):
    journal = many(spark, 50)
    maintain.backup(journal, str(tmp_path / "copy"), 40)
    assert maintain.restore(spark, str(tmp_path / "copy")).count() == 40
    maintain.hand_off(journal, "o", str(tmp_path / "other"))
    other = read_journal(spark, str(tmp_path / "other"))
    assert maintain.store_difference(state.ledger(journal), state.ledger(other)).count() == 0
    assert maintain.store_difference(state.ledger(journal), state.ledger(other.filter("sqn > 3"))).count() == 3


def test_tag_functions(spark):
    tags.register("mine", strategy="recalc")
    assert tags.spec("mine").strategy == "recalc" and tags.spec("unknown").strategy == "retain"
    clock = "array(named_struct('actor', '{}', 'n', 1), named_struct('actor', '{}', 'n', 2))"
    a, b = (spark.range(1).select(tags.clock_hash(F.expr(x))).first()[0] for x in ("array(named_struct('actor','x','n',1), named_struct('actor','y','n',2))", "array(named_struct('actor','y','n',2), named_struct('actor','x','n',1))"))
    assert a == b and clock


def test_currency(spark):
    journal = many(spark, 5)
    asked = spark.createDataFrame([("o", "1", "000001", 1), ("o", "2", "000002", 1), ("o", "9", "x", 1)], "tag string, bucket string, key string, asked_sqn long")
    assert sorted(r["status"] for r in reads.currency(journal, asked).collect()) == ["current", "missing", "replaced"]


def test_a_batch_of_a_tree_joins_nothing(spark, tmp_path, monkeypatch):
    """One aggregation finds what a batch changes; versions replaced, deleted, back again and late ones add up to the tree of the state."""
    path, plans, merge = str(tmp_path / "j"), [], merkle.merge
    monkeypatch.setattr(merkle, "merge", lambda *trees: [merge(*trees), plans.append(merge(*trees)._jdf.queryExecution().optimizedPlan().toString())][0])
    versions = [[(1, "a", "x", "stnd"), (2, "b", "x", "stnd"), (3, "c", "x", "stnd")], [(5, "a", "y", "stnd"), (6, "b", None, "tomb"), (7, "d", "z", "stnd")], [(4, "a", "late", "stnd"), (8, "b", "x", "stnd"), (9, "c", None, "tomb")]]
    for data in versions:
        df = spark.createDataFrame([(n, "o", "b", k, v, t) for n, k, v, t in data], "sqn long, tag string, bucket string, key string, value string, jtype string")
        write_journal(df.coalesce(1), path)
    ingest.maintain_tree(ingest.journal_stream(spark, path, 1), str(tmp_path / "t"), str(tmp_path / "cp"), "xsmall").awaitTermination()
    assert plans and not any("Join" in plan for plan in plans)
    whole = merkle.object_tree(state.ledger(read_journal(spark, path)), "xsmall")
    assert sorted(map(tuple, ingest.read_tree(spark, str(tmp_path / "t")).collect())) == sorted(map(tuple, whole.collect()))


def test_streams_equal_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "MERGE", 2)
    path, at = str(tmp_path / "j"), F.lit(1_000)
    for k in range(3):
        write_journal(many(spark, 200).filter(f"sqn % {2 * k + 1} = 0").withColumn("sqn", F.col("sqn") + 200 * k).withColumn("value", F.lit(f"again {k}").cast("binary")), path)
    write_journal(conform(spark.createDataFrame([(700 + i, "tomb", "o", str(i % 3), f"{i:06d}") for i in range(1, 20)], "sqn long, jtype string, tag string, bucket string, key string")), path)
    journal = read_journal(spark, path)
    whole = state.ledger(journal, all_versions=True)
    ingest.maintain_ledger(ingest.journal_stream(spark, path, 1), str(tmp_path / "ledger"), str(tmp_path / "cp")).awaitTermination()
    kept = ingest.read_ledger(spark, str(tmp_path / "ledger"))
    columns = ["key", "sqn", "is_tomb", "hash"]
    assert rows(kept, *columns) == rows(whole, *columns) and kept.count() == 200
    assert any(p.name.startswith("m") for p in (tmp_path / "ledger").iterdir())
    # a tree of the state: old versions are taken out
    ingest.maintain_tree(ingest.journal_stream(spark, path, 2), str(tmp_path / "t"), str(tmp_path / "cp2"), "xxsmall").awaitTermination()
    assert merkle.dirty_leaves(ingest.read_tree(spark, str(tmp_path / "t")), merkle.object_tree(state.ledger(journal), "xxsmall")).count() == 0
    query = ingest.running_tree(ingest.journal_stream(spark, path), "xxsmall").writeStream.outputMode("complete").format("memory").queryName("tree").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = merkle.tree(state.object_changes(journal), "xxsmall", tags.framed_key(*[F.col(k) for k in state.KEYS[1:]]), F.col("sqn"))
    assert merkle.dirty_leaves(spark.table("tree").select(F.col("segment").cast("int").alias("segment"), "leaf"), batch).count() == 0 and at is not None


def test_recent_and_expiring_keys(spark, tmp_path):
    path, spec = str(tmp_path / "j"), "sqn long, jtype string, tag string, bucket string, key string, lmd long, expires_at long"
    write = lambda *data: write_journal(conform(spark.createDataFrame(list(data), spec)).coalesce(1), path)
    write((1, "stnd", "o", "b", "k", 1_000, GREGORIAN_EPOCH + 1_050), (2, "stnd", "o", "b", "k2", 1_001, None), (3, "stnd", "o", "b", "k", 1_002, GREGORIAN_EPOCH + 1_060))
    stream = ingest.journal_stream(spark, path, 1)
    run = lambda df, name: df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True)
    run(ingest.recent_changes(stream, "1 minute"), "recent").start().awaitTermination()
    assert len({r["key"] for r in spark.table("recent").collect()}) == 2
    write((4, "stnd", "o", "b", "late", 5_000, None), (5, "tomb", "o", "b", "k2", 5_001, None))
    write((6, "stnd", "o", "b", "last", 5_002, None))
    run(ingest.expiring(stream), "expiring").start().awaitTermination()
    found = {(r["key"], r["sqn"], r["status"]) for r in spark.table("expiring").collect()}
    assert ("k", 3, "active") in found and ("k", 3, "expired") in found and ("k2", 5, "deleted") in found


def test_empty_store(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert state.ledger(none).count() == state.index(none).count() == state.heads(none).count() == 0
    assert merkle.object_tree(state.ledger(none)).count() == 0


def test_typed_buckets_are_their_own(store):
    """A bucket with a type shares nothing with a plain one of its name."""
    for bucket, value in (("b", "plain"), (("t", "b"), "typed"), (("u", "b"), "other")):
        store.put("o", bucket, "k", value, [("add", "f_int", 1)])
    store.put("o", ("t", "b"), "k2", "typed too", [("add", "f_int", 2)])
    assert rows(store.get("o", "b", "k"), "value") == [("plain",)] and rows(store.get("o", ("t", "b"), "k"), "value") == [("typed",)]
    assert rows(store.query("index_range", bucket=("t", "b"), field="f_int", start=0, end=9), "term", "key") == [(1, "k"), (2, "k2")]
    assert store.query("index_range", bucket="b", field="f_int", start=0, end=9).count() == 1
    assert rows(store.query("key_list", tag="o", bucket=("u", "b")), "bucket_type", "key") == [("u", "k")]
    assert [tuple(r)[:2] for r in store.query("head_fold", tag="o", buckets=["b", ("t", "b")], ordered=True).select("bucket_type", "key").collect()] == [(None, "k"), ("t", "k"), ("t", "k2")]
    assert rows(store.query("object_fold", tag="o", bucket=("t", "b")), "value") == [("typed",), ("typed too",)]
    assert rows(store.query("object_fold_by_index", tag="o", bucket="b", field="f_int", start=0, end=9, version="current"), "value") == [("plain",)]
    assert store.query("bucket_stats", tag="o").count() == 3 and store.query("bucket_list", tag="o").count() == 3
    assert [r["bucket_type"] for r in store.query("key_list", tag="o", ordered=True).collect()] == ["t", "t", "u", None]
    assert store.query("next_key", tag="o", bucket=("t", "b"), start="k1").first()["key"] == "k2" and store.query("next_key", tag="o", bucket="x").count() == 0
    asked = store.spark.createDataFrame([("o", None, "b", "k", 1), ("o", "t", "b", "k", 1), ("o", "v", "b", "k", 1)], "tag string, bucket_type string, bucket string, key string, asked_sqn long")
    assert sorted(r["status"] for r in reads.currency(store.journal(), asked).collect()) == ["current", "missing", "replaced"]
    assert rows(reads.multi_get(store.journal(), asked), "value") == [("plain",), ("typed",)]
    with pytest.raises(UnsupportedMessage):
        store.query("Column")


def test_bytes_count(store):
    store.put("o", "b", "k", "é€")
    store.put("o", "b", "raw", b"\xff\x00\xfe")
    assert rows(store.query("bucket_stats", tag="o"), "total_size", "n_objects") == [(8, 2)]
    assert bytes(store.get("o", "b", "raw").first()["value"]) == b"\xff\x00\xfe"


def test_objects_of_siblings(store):
    clock, index = [("b", 2), ("a", 1)], lambda n: [("f_int", None, n)]
    store.put("o_rkv", "b", "k", "v", vclock=clock, siblings=[("x", False, 10, index(1)), ("y", True, 30, index(2)), ("z", False, 20, index(3))])
    head = store.head("o_rkv", "b", "k").first()
    assert head["lmd"] == 30 and [s["vtag"] for s in head["siblings"]] == ["x", "y", "z"] and [(c["actor"], c["n"]) for c in head["vclock"]] == clock
    again = Store(store.spark, store.path + "2", now=store.now)
    again.put("o_rkv", "b", "k", "other value", vclock=clock[::-1])
    assert again.head("o_rkv", "b", "k").first()["hash"] == head["hash"]
    terms = store.head("o_rkv", "b", "k").select(F.explode(tags.sibling_terms(F.col("siblings"))).alias("t")).select("t.term_i")
    assert rows(terms, "term_i") == [(1,), (3,)]


def test_proxies_fetch_late(store):
    store.put("o", "b", "k", "v1")
    store.put("o", ("t", "b"), "k", "v2")
    handles = reads.proxies(store.query("head_fold", tag="o")).select("size", "proxy")
    store.put("o", "b", "k", "v3")
    assert rows(reads.fetch_proxies(handles, store.journal()), "value") == [("v1",), ("v2",)]


def test_held_back_writes(store):
    """Writes without sync are seen at once by their store, and by others when they are flushed; a batch is one file."""
    other = Store(store.spark, store.path, now=store.now)
    with store.batch():
        for i in range(5):
            assert store.put("o", "b", f"k{i}", "v") == i + 1
        assert store.query("key_list", tag="o").count() == 5 and other.query("key_list", tag="o").count() == 0
    assert other.query("key_list", tag="o").count() == 5 and other.last_sqn() == 5
    store.delete("o", "b", "k0", sync=False)
    assert store.query("key_list", tag="o").count() == 4 and other.query("key_list", tag="o").count() == 5
    store.flush()
    assert other.query("key_list", tag="o").count() == 4
    assert store.stats["put"][0] == 5 and store.stats["delete"][0] == 1 and store.headstatus() == (False, False)


def filled(spark, path, n=30, **options):
    """A store of n writes over 5 keys, in parts of ten."""
    store = Store(spark, path, now=Clock(GREGORIAN_EPOCH), part_records=10, codec="zstd", **options)
    for k in range(0, n, 10):
        with store.batch():
            for i in range(k, k + 10):
                store.put("o", "b", f"k{i % 5}", f"v{i:03d}", [("add", "f_int", i)])
    return store


def test_compaction_of_runs(spark, tmp_path):
    store = filled(spark, str(tmp_path / "s"), waste_seconds=100)
    entry = store._entry()
    assert [(p["lo"], p["hi"]) for p in entry["parts"]] == [(1, 10), (11, 20), (21, 30)]
    before = rows(store.query("object_fold", tag="o"), "key", "value")
    replaced = store.compact(single_target=10.0, run_target=40.0, longest=2)
    after = store._entry()
    assert replaced == [p["dir"] for p in entry["parts"][:2]] and [(p["lo"], p["hi"]) for p in after["parts"]] == [(1, 20), (21, 30)]
    assert after["parts"][1]["score"] == 50.0 and after["parts"][1]["dir"] == entry["parts"][2]["dir"]
    assert rows(store.query("object_fold", tag="o"), "key", "value") == before
    assert {r["jtype"] for r in store.journal().filter("sqn <= 20").collect()} == {"keyd"}
    # the waste stays for its time
    assert all((tmp_path / "s" / d).is_dir() for d in replaced)
    store.now.at += 101
    assert store.compact(single_target=-1.0, run_target=-1.0) == [] and not any((tmp_path / "s" / d).exists() for d in replaced)
    assert not store.is_compaction_pending()
    (tmp_path / "s" / "compacting").write_text("other")
    assert store.is_compaction_pending() and store.compact(whole=True) == []


def test_scores_move_half_way(spark, tmp_path):
    store = filled(spark, str(tmp_path / "s"), 20)
    store.compact(single_target=-1.0, run_target=-1.0)
    assert [p["score"] for p in store._entry()["parts"]] == [0.0, 50.0]
    store.put("o", "b", "k0", "again")
    seen = set()
    for _ in range(4):
        store.compact(single_target=-1.0, run_target=-1.0, score_onein=2)
        seen.add(store._entry()["parts"][1]["score"])
    assert 45.0 in seen and all(40.0 <= s <= 50.0 for s in seen)


def test_runs_of_equal_scores_gain_the_same():
    score = 100.0 * 155 / 286
    assert maintain.best_run([95.5] + [score] * 3, longest=4, single_target=101.0, run_target=101.0)[:2] == (1, 3)


def test_compaction_of_a_part_joins_nothing(spark):
    """What is current in a part is the same by the whole journal and by the rest of it; records without a key are kept."""
    spec = "sqn long, jtype string, tag string, bucket string, key string, value string"
    data = [(1, "stnd", "o", "b", "x", "1"), (2, "stnd", "o", "b", "y", "2"), (3, "mput", "h", None, None, None), (4, "tomb", "o", "b", "y", None), (5, "stnd", "o", "b", None, "5"), (6, "stnd", "o", "b", "x", "6"), (7, "stnd", "o", "b", "z", "7")]
    journal = conform(spark.createDataFrame(data, spec))
    part, rest = journal.filter("sqn <= 4 OR sqn = 7"), journal.filter("sqn > 4 AND sqn < 7")
    found = maintain.decisions(part, others=rest)
    assert rows(found, "sqn", "decision") == rows(maintain.decisions(part, whole=journal), "sqn", "decision") == [(1, "convert"), (2, "convert"), (3, "keep"), (4, "keep"), (7, "keep")]
    assert rows(maintain.decisions(journal), "sqn", "decision") == rows(maintain.decisions(journal, whole=journal), "sqn", "decision")
    for df in (found, maintain.scores(journal, 2), maintain.compact(part, others=rest)):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_a_crash_in_compaction_loses_nothing(spark, tmp_path, monkeypatch):
    store = filled(spark, str(tmp_path / "s"))
    before = rows(store.query("object_fold", tag="o"), "key", "value")

    def crash(*_):
        raise OSError("gone")

    for name in ("write", "_numbers"):
        with monkeypatch.context() as m:
            m.setattr(type(store._manifest), name, crash)
            with pytest.raises(OSError):
                store.compact(whole=True)
        assert rows(Store(spark, store.path, now=store.now).query("object_fold", tag="o"), "key", "value") == before and store.last_sqn() == 30
    # a part that is missing is an error, not an empty store
    import shutil

    shutil.rmtree(tmp_path / "s" / store._entry()["parts"][0]["dir"])
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        store.journal()


def test_two_writers_of_a_manifest(spark, tmp_path):
    store = filled(spark, str(tmp_path / "s"), 10)
    entry = store._entry()
    store._manifest.write(entry)
    with pytest.raises(RuntimeError):
        store._manifest.write(entry)


def test_levels_of_the_stored_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("kvstrata.store.FANOUT", 0)
    store = filled(spark, str(tmp_path / "s"), 10)
    store.settle()
    store.delete("o", "b", "k0")
    store.put("o", "b", "k9", "new", [("add", "f_int", 99)])
    assert store.settle() == 12 and len(store._entry()["levels"]) == 2
    for kind, options in (("key_list", {"tag": "o"}), ("index_range", {"bucket": "b", "field": "f_int", "start": 0, "end": 99}), ("object_fold", {"tag": "o"})):
        asked = store.query(kind, **options)
        monkeypatch.setattr(Store, "stored", lambda self: None)
        assert rows(asked, "key") == rows(store.query(kind, **options), "key")
        monkeypatch.undo()
        monkeypatch.setattr("kvstrata.store.FANOUT", 0)
    monkeypatch.setattr("kvstrata.store.FANOUT", 100)
    store.put("o", "b", "k1", "newer")
    assert store.settle() == 13 and len(store._entry()["levels"]) == 1 and store.stored().ledger.filter("is_tomb").count() == 0
    assert rows(store.query("key_list", tag="o"), "key") == [("k1",), ("k2",), ("k3",), ("k4",), ("k9",)]


def test_trim_and_backup(spark, tmp_path):
    heads = Store(spark, str(tmp_path / "h"), head_only="no_lookup", now=Clock(GREGORIAN_EPOCH), part_records=1)
    for i in range(3):
        heads.mput([("add", ("t", "b"), f"k{i}", None, f"v{i}")])
    assert heads.trim() == [] and heads.settle() == 3
    assert len(heads.trim()) == 3 and heads.journal().count() == 0
    assert rows(heads.query("head_fold", tag="h"), "bucket_type", "key", "head_value") == [("t", f"k{i}", f"v{i}") for i in range(3)]
    assert heads.last_sqn() == 3 and heads.headstatus() == (True, False)
    with pytest.raises(UnsupportedMessage):
        heads.headonly("b", "k0")
    found = Store(spark, heads.path, head_only=True, now=heads.now)
    assert rows(found.headonly(("t", "b"), "k1"), "value") == [("v1",)] and found.headstatus() == (True, True)
    store = filled(spark, str(tmp_path / "s"))
    copy = Store(spark, str(tmp_path / "copy"), now=store.now)
    assert store.backup(copy.path) == 30
    before = rows(store.query("object_fold", tag="o"), "key", "value")
    assert rows(copy.query("object_fold", tag="o"), "key", "value") == before
    store.compact(whole=True)
    store.put("o", "b", "k0", "later")
    assert store.backup(copy.path) == 31 and len(list((tmp_path / "copy" / "journal").iterdir())) == 2
    assert rows(copy.query("object_fold", tag="o"), "key", "value") == rows(store.query("object_fold", tag="o"), "key", "value") != before
    copy.destroy()
    assert not (tmp_path / "copy").exists()


def test_next_compaction():
    import random
    from datetime import datetime

    now = datetime(2024, 1, 1, 12, 20)
    for seed in range(50):
        seconds = maintain.next_run([0, 1, 23], 2, now, random.Random(seed))
        at = (now.hour * 3600 + now.minute * 60 + seconds) % 86_400
        assert seconds > 0 and at // 3600 in (0, 1, 23)


def test_folds_of_groups(spark):
    def step(row, acc):
        if row["key"] > "000100":
            raise StopIteration
        return {"n": acc["n"] + 1, "last": row["key"]}

    found = folds.fold_groups(folds.key_list(many(spark, 300), "o").select("bucket", "key"), ("bucket",), ("key",), step, lambda: {"n": 0, "last": ""}, "bucket string, n long, last string")
    assert rows(found, "bucket", "n", "last") == [("0", 33, "000099"), ("1", 34, "000100"), ("2", 33, "000098")]


def test_many_segments_are_joined(spark):
    journal = many(spark, 300)
    some = sorted({r["seg16"] & 0x7FFF for r in state.ledger(journal).limit(40).collect()})
    few = rows(folds.head_fold(journal, "o", segments=some), "key")
    more = folds.head_fold(journal, "o", segments=[*some, *range(0, 32_768, 2)])
    want = [(r["key"],) for r in state.ledger(journal).orderBy("key").collect() if (r["seg16"] & 0x7FFF) in some or r["seg16"] % 2 == 0]
    assert len(few) >= 40 and rows(more, "key") == want


def test_canonical_keys_tell_borders_apart(spark):
    keys = spark.createDataFrame([(None, "ab", "c", None), (None, "a", "bc", None), ("a", "b", "c", None)], "a string, b string, c string, d string")
    assert keys.select(tags.framed_key(*map(F.col, "abcd")).alias("k")).distinct().count() == 3
    assert keys.select(tags.plain_key(*map(F.col, "abcd")).alias("k")).distinct().count() == 1
