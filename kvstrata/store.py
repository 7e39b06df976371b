"""A store: a journal on disk, an explicit clock, and every query as a lazy DataFrame over it.

The journal lies in parts, folders of Parquet for ranges of sequence numbers. The manifest names them; the last, the active
part, takes the writes and is closed at ``part_records`` numbers. ``settle`` stores the state of keys in levels: a new level
holds what the journal has since the last one, and levels are merged while the older is not much larger, so the cost of
keeping it up is in proportion to what is written. Whatever upkeep replaces stays as waste for ``waste_seconds``.
"""

from __future__ import annotations

import contextlib
import logging
import time
import uuid
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvstrata.functions.clocks import GREGORIAN_EPOCH
from kvstrata.operators import folds, maintain, merkle, reads, state
from kvstrata.operators.state import Bucket
from kvstrata.sources.journal import COLUMNS, SCHEMA, conform, read_journal, write_journal, write_ledger
from kvstrata.sources.manifest import Files, Manifest

log = logging.getLogger("kvstrata")

#: Levels are merged while the older one has at most so many times the rows of the newer.
FANOUT = 8
#: Writes that are held back at most by puts that don't wait.
BUFFER = 10_000
_FOLDS = {f.__name__: f for f in (folds.index_range, folds.bucket_list, folds.key_list, folds.head_fold, folds.object_fold, folds.object_fold_by_index, folds.bucket_stats, folds.hash_list, folds.estimate_count, reads.next_key)}


class UnsupportedMessage(Exception):
    """An operation that the store's mode does not have."""


@dataclass(frozen=True)
class Runner:
    """A query to run later. It sees the store as of the request, or with ``at_run`` as of the run."""

    build: Callable[[], DataFrame]

    def run(self) -> DataFrame:
        return self.build()


@dataclass
class Store:
    """One database. ``now`` gives gregorian seconds; ``at`` is the sequence number of a snapshot, None for the newest.

    One writer at a time appends; readers take any snapshot. ``head_only`` is False, "with_lookup" (or True) or "no_lookup":
    then values live in the ledger and only batches of heads are written. ``codec`` compresses new files,
    ``strategies`` says how compaction treats tags. ``stats`` counts operations and seconds by name.
    """

    spark: SparkSession
    path: str
    head_only: bool | str = False
    now: Callable[[], int] = field(default=lambda: int(time.time()) + GREGORIAN_EPOCH)
    at: int | None = None
    taken: int | None = None
    codec: str | None = None
    part_records: int = 1_000_000
    waste_seconds: int = 0
    strategies: dict[str, str] | None = None
    log_level: str | None = None
    stats: dict[str, list[float]] = field(default_factory=lambda: defaultdict(lambda: [0, 0.0]), repr=False)
    _pending: list[dict] = field(default_factory=list, repr=False)
    _holding: bool = field(default=False, repr=False)

    def __post_init__(self) -> None:
        self._manifest, self._files = Manifest(self.spark, self.path), Files(self.spark)
        if self.log_level:
            log.setLevel(self.log_level)

    @contextlib.contextmanager
    def _timed(self, what: str) -> Iterator[None]:
        began = time.perf_counter()
        yield
        self.stats[what][0] += 1
        self.stats[what][1] += time.perf_counter() - began
        log.debug("%s took %.3f s", what, time.perf_counter() - began)

    # what is there
    def _entry(self) -> dict:
        return self._manifest.read() or dict(Manifest.EMPTY)

    def _folders(self, entry: dict) -> list[str]:
        """The parts that a snapshot sees. A part that the manifest names must be there, but for an active one without writes."""
        closed = [p["dir"] for p in entry["parts"] if self.at is None or p["lo"] <= self.at]
        active = entry["active"]
        return closed + ([active] if active and self._files.exists(f"{self.path}/{active}/_SUCCESS") else [])

    def journal(self) -> DataFrame:
        folders = self._folders(self._entry())
        whole = read_journal(self.spark, *[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], SCHEMA)
        if self._pending:
            whole = whole.unionByName(self._frame(self._pending))
        return state.as_of(whole, self.at)

    def _frame(self, rows: list[dict]) -> DataFrame:
        return self.spark.createDataFrame([tuple(r.get(c) for c in COLUMNS) for r in rows], SCHEMA)

    def last_sqn(self) -> int:
        """The last sequence number; of the parts only the active one is read."""
        if self._pending:
            last = self._pending[-1]["sqn"]
        else:
            entry = self._entry()
            active = entry["active"] if entry["active"] in self._folders(entry) else None
            found = read_journal(self.spark, f"{self.path}/{active}").agg(F.max("sqn")).first()[0] if active else None
            last = found or entry["active_lo"] - 1
        return last if self.at is None else min(last, self.at)

    def _when(self) -> dict:
        return {"now": self.taken if self.taken is not None else self.now()}

    def _at(self) -> dict:
        """The clock, and the stored state if there is one that this snapshot may use."""
        return self._when() | {"base": self.stored()}

    def stored(self) -> state.Base | None:
        """The stored state, if it is no newer than this snapshot."""
        levels, now = self._entry()["levels"], self._when()["now"]
        if not levels or self.at is not None and levels[-1]["hi"] > self.at or any(x["reaped"] and x["reaped"] > now for x in levels):
            return None
        return state.Base(*[self.spark.read.parquet(*[f"{self.path}/{x['dir']}/{part}" for x in levels]) for part in ("ledger", "index")], levels[-1]["hi"])

    def settle(self) -> int:
        """Store the state of keys up to now, so that later queries read it and only newer records of the journal.

        When all levels become one, tombstones and what has expired are left out.
        """
        self.flush()
        with self._timed("settle"):
            entry, last, now = self._entry(), self.last_sqn(), self._when()["now"]
            levels = entry["levels"]
            if last == (levels[-1]["hi"] if levels else 0):
                return last
            fresh = self.journal().filter(F.col("sqn") > (levels[-1]["hi"] if levels else 0))
            level = self._level(state.ledger(fresh, all_versions=True), state.index(fresh, all_versions=True), levels[-1]["hi"] + 1 if levels else 1, last)
            waste = []
            while levels and levels[-1]["rows"] <= FANOUT * level["rows"]:
                both, whole = [levels[-1], level], len(levels) == 1
                ledger, index = (self.spark.read.parquet(*[f"{self.path}/{x['dir']}/{part}" for x in both]) for part in ("ledger", "index"))
                ledger, index = state.latest(ledger, state.KEYS), state.latest(index, ("tag", *state.POSTING))
                if whole:
                    ledger, index = maintain.reap(ledger, now), maintain.reap(index, now)
                levels, level = levels[:-1], self._level(ledger, index, both[0]["lo"], last, now if whole else None)
                waste += [x["dir"] for x in both]
            self._manifest.write(self._wasted(entry, waste) | {"levels": [*levels, level]})
            return last

    def _level(self, ledger: DataFrame, index: DataFrame, lo: int, hi: int, reaped: int | None = None) -> dict:
        folder = f"state/{uuid.uuid4().hex}"
        for part, rows in (("ledger", ledger), ("index", index)):
            write_ledger(rows, f"{self.path}/{folder}/{part}", codec=self.codec)
        rows = sum(self.spark.read.parquet(f"{self.path}/{folder}/{part}").count() for part in ("ledger", "index"))
        return {"dir": folder, "lo": lo, "hi": hi, "rows": rows, "reaped": reaped}

    def _wasted(self, entry: dict, folders: list[str]) -> dict:
        """The entry with more waste and without what has waited long enough, which is deleted."""
        now = self.now()
        gone = [w for w in entry["waste"] if w["since"] + self.waste_seconds <= now]
        for w in gone:
            self._files.delete(f"{self.path}/{w['dir']}")
        return entry | {"waste": [w for w in entry["waste"] if w not in gone] + [{"dir": f, "since": now} for f in folders]}

    def _need(self, head_only: bool, what: str) -> None:
        if bool(self.head_only) != head_only or what == "headonly" and self.head_only == "no_lookup":
            raise UnsupportedMessage(what)
        if self.at is not None and what in ("put", "delete", "mput"):
            raise UnsupportedMessage("a snapshot is read only")

    def headstatus(self) -> tuple[bool, bool]:
        """Whether the store has heads only, and whether single heads can be looked up."""
        return bool(self.head_only), self.head_only in (True, "with_lookup")

    # writes
    def put(
        self, tag: str, bucket: Bucket, key: str, value: str | bytes | None, specs: list[tuple] = (), *, user_md: dict | None = None, lmd: int | None = None,
        expires_at: int | None = None, vclock: list[tuple] | None = None, siblings: list[tuple] | None = None, sync: bool = True,
    ) -> int:
        """Write one object. Specs are (op, field, term); its expiry holds for the postings it adds as well.

        Without ``sync`` the write is seen by this store at once and becomes durable with the next ``flush``.
        """
        self._need(False, "put")
        row = {"jtype": "stnd", "tag": tag, **_named(bucket), "key": key, "value": _bytes(value), "user_md": user_md, "lmd": lmd, "index_specs": _specs(specs), "expires_at": expires_at, "vclock": vclock, "siblings": siblings}
        return self._append([row], sync, "put")

    def delete(self, tag: str, bucket: Bucket, key: str, specs: list[tuple] = (), *, sync: bool = True) -> int:
        """Write a tombstone. Postings go only by remove specs."""
        self._need(False, "delete")
        return self._append([{"jtype": "tomb", "tag": tag, **_named(bucket), "key": key, "index_specs": _specs(specs)}], sync, "delete")

    def mput(self, specs: list[tuple], *, tag: str = "h", expires_at: int | None = None, sync: bool = True) -> int:
        """Write heads (op, bucket, key, subkey, value[, lmds]) under one sequence number."""
        self._need(True, "mput")
        heads = [(op, *_named(b).values(), k, s, list(rest[1]) if len(rest) > 1 and rest[1] else None, _bytes(rest[0])) for op, b, k, s, *rest in specs]
        return self._append([{"jtype": "mput", "tag": tag, "object_specs": heads, "expires_at": expires_at}], sync, "mput")

    def load(self, rows: DataFrame) -> int:
        """Append many rows of a journal that carry their own order in ``sqn``; they are numbered on after the last. Their types are the caller's choice."""
        self.flush()
        last = self.last_sqn()
        self._write(conform(rows).withColumn("sqn", F.col("sqn") + last))
        last = self.last_sqn()
        self._close(last)
        return last

    @contextlib.contextmanager
    def batch(self) -> Iterator[Store]:
        """Writes in this block become durable together, as one file, at its end."""
        self._holding = True
        try:
            yield self
        finally:
            self._holding = False
            self.flush()

    def _append(self, rows: list[dict], sync: bool, what: str) -> int:
        with self._timed(what):
            sqn = self.last_sqn()
            self._pending += [{**r, "sqn": sqn + i} for i, r in enumerate(rows, 1)]
            if sync and not self._holding or len(self._pending) >= BUFFER:
                self.flush()
            return sqn + len(rows)

    def flush(self) -> None:
        """Make held back writes durable."""
        if self._pending:
            self._write(self._frame(self._pending).coalesce(1))
            last = self._pending[-1]["sqn"]
            self._pending.clear()
            self._close(last)

    def _write(self, rows: DataFrame) -> None:
        entry = self._entry()
        if entry["active"] is None:
            entry = self._manifest.write(entry | {"active": f"journal/{uuid.uuid4().hex}"})
        write_journal(rows, f"{self.path}/{entry['active']}", codec=self.codec)

    def roll(self) -> None:
        """Close the active part, if it has any record."""
        self.flush()
        self._close(self.last_sqn(), at_once=True)

    def _close(self, last: int, at_once: bool = False) -> None:
        entry = self._entry()
        if entry["active"] and last - entry["active_lo"] + 1 >= (1 if at_once else self.part_records):
            part = {"dir": entry["active"], "lo": entry["active_lo"], "hi": last, "score": None}
            self._manifest.write(entry | {"parts": [*entry["parts"], part], "active": f"journal/{uuid.uuid4().hex}", "active_lo": last + 1})

    # snapshots
    def snapshot(self) -> Store:
        """The store as it is now; later writes and the passing of time do not change it."""
        self.flush()
        return Store(self.spark, self.path, self.head_only, self.now, self.last_sqn() if self.at is None else self.at, self._when()["now"], stats=self.stats)

    def runner(self, query: Callable[[Store], DataFrame], *, at_run: bool = False) -> Runner:
        bound = self if at_run else self.snapshot()
        return Runner(lambda: query(bound.snapshot() if at_run else bound))

    # reads
    def get(self, tag: str, bucket: Bucket, key: str) -> DataFrame:
        self._need(False, "get")
        with self._timed("get"):
            return reads.get(self.journal(), tag, bucket, key, **self._at())

    def head(self, tag: str, bucket: Bucket, key: str) -> DataFrame:
        self._need(False, "head")
        with self._timed("head"):
            return reads.head(self.journal(), tag, bucket, key, **self._at())

    def headonly(self, bucket: Bucket, key: str, subkey: str | None = None, tag: str = "h") -> DataFrame:
        self._need(True, "headonly")
        where = (F.col("tag") == tag) & state.bucket_is(bucket) & (F.col("key") == key) & F.col("subkey").eqNullSafe(F.lit(subkey))
        with self._timed("headonly"):
            return state.heads(self.journal(), where=where, **self._at()).select("bucket_type", "bucket", "key", "subkey", "value")

    def sqn(self, tag: str, bucket: Bucket, key: str) -> int | None:
        row = self.head(tag, bucket, key).select("sqn").first()
        return row[0] if row else None

    def is_empty(self, tag: str) -> bool:
        return reads.is_empty(self.journal(), tag, **self._at())

    def query(self, kind: str, **options) -> DataFrame:
        """Any scan by name: index_range, bucket_list, key_list, head_fold, object_fold, object_fold_by_index, bucket_stats, hash_list, estimate_count, next_key, object_tree, index_tree.

        Trees take ``where``, a condition on keys, and object trees ``check_presence``.
        """
        with self._timed(kind):
            if kind in ("object_tree", "index_tree"):
                size, check = options.pop("size", "small"), options.pop("check_presence", False)
                rows = (state.ledger if kind == "object_tree" else state.index)(self.journal(), **options, **self._at())
                return getattr(merkle, kind)(reads.present(rows, self.journal()) if check else rows, size)
            if kind not in _FOLDS:
                raise UnsupportedMessage(kind)
            return _FOLDS[kind](self.journal(), **options, **self._at())

    # upkeep
    def compact(self, *, whole: bool = False, longest: int = 8, single_target: float = 30.0, run_target: float = 70.0, score_onein: int = 1) -> list[str]:
        """Rewrite the run of parts that gains most, or with ``whole`` all of them; the parts that were replaced.

        Scores are kept in the manifest. With ``score_onein`` above one, a part that has a score is scored again in one
        of so many runs and its score moves half the way. A crash leaves the old parts in place.
        """
        self.flush()
        with self._timed("compact"):
            if not self._files.create(f"{self.path}/compacting", str(self.now())):
                log.info("a compaction of %s is pending", self.path)
                return []
            try:
                self.roll()
                return self._compact(whole, longest, single_target, run_target, score_onein)
            finally:
                self._files.delete(f"{self.path}/compacting")

    def is_compaction_pending(self) -> bool:
        return self._files.exists(f"{self.path}/compacting")

    def _compact(self, whole: bool, longest: int, single_target: float, run_target: float, score_onein: int) -> list[str]:
        entry = self._entry()
        parts, runs = entry["parts"], entry["runs"] + 1
        journal, options = self.journal(), {"strategies": self.strategies}
        due = [p for p in parts if p["score"] is None or score_onein == 1 or (zlib.crc32(p["dir"].encode()) + runs) % score_onein == 0]
        if due and not whole:
            part = F.regexp_extract(F.col("_metadata.file_path"), r"/(journal/[0-9a-f]+)/[^/]*$", 1)
            rows = read_journal(self.spark, *[f"{self.path}/{p['dir']}" for p in due]).withColumn("part", part)
            found = {r["file"]: r["score"] for r in maintain.scores(rows, F.col("part"), whole=None if len(due) == len(parts) else journal, **options).collect()}  # a row for each part
            for p in due:
                score = found.get(p["dir"], 0.0)
                p["score"] = score if p["score"] is None or score_onein == 1 else (p["score"] + score) / 2
        run = (0, len(parts), 0.0) if whole and parts else maintain.best_run([p["score"] or 0.0 for p in parts], longest=longest, single_target=single_target, run_target=run_target)
        if run is None or not parts:
            self._manifest.write(self._wasted(entry, []) | {"parts": parts, "runs": runs})
            return []
        first, n, _ = run
        chosen = parts[first : first + n]
        fresh = {"dir": f"journal/{uuid.uuid4().hex}", "lo": chosen[0]["lo"], "hi": chosen[-1]["hi"], "score": None}
        beside = [f for f in self._folders(entry) if f not in {p["dir"] for p in chosen}]
        rest = read_journal(self.spark, *[f"{self.path}/{f}" for f in beside]) if beside else None
        rows = maintain.compact(read_journal(self.spark, *[f"{self.path}/{p['dir']}" for p in chosen]), others=rest, **options)
        write_journal(rows, f"{self.path}/{fresh['dir']}", codec=self.codec)
        old = [p["dir"] for p in chosen]
        self._manifest.write(self._wasted(entry, old) | {"parts": [*parts[:first], fresh, *parts[first + n :]], "runs": runs})
        log.info("compacted %d parts of %s", n, self.path)
        return old

    def trim(self) -> list[str]:
        """Drop the parts of a head-only store's journal that the stored state covers; they become waste."""
        self._need(True, "trim")
        entry = self._entry()
        persisted = entry["levels"][-1]["hi"] if entry["levels"] else 0
        old = [p["dir"] for p in entry["parts"] if p["hi"] <= persisted]
        if old:
            self._manifest.write(self._wasted(entry, old) | {"parts": [p for p in entry["parts"] if p["hi"] > persisted]})
        return old

    def backup(self, path: str) -> int:
        """Copy the closed parts into a store at ``path``, file by file and only those it does not have; what it has beyond them goes."""
        self.roll()
        entry, target, files = self._entry(), Manifest(self.spark, path), self._files
        have, want = set(files.names(f"{path}/journal")), {p["dir"].removeprefix("journal/") for p in entry["parts"]}
        for name in want - have:
            files.copy(f"{self.path}/journal/{name}", f"{path}/journal/.{name}")
            files.rename(f"{path}/journal/.{name}", f"{path}/journal/{name}")
        target.write((target.read() or {}) | Manifest.EMPTY | {"parts": entry["parts"], "active_lo": entry["active_lo"]})
        for name in have - want:
            files.delete(f"{path}/journal/{name}")
        return entry["active_lo"] - 1

    def destroy(self) -> None:
        self._pending.clear()
        self._files.delete(self.path)


def _named(bucket: Bucket) -> dict:
    kind, name = (None, bucket) if isinstance(bucket, str) else bucket
    return {"bucket_type": kind, "bucket": name}


def _bytes(value: str | bytes | None) -> bytearray | None:
    return None if value is None else bytearray(value.encode() if isinstance(value, str) else value)


def _specs(specs: list[tuple]) -> list[tuple] | None:
    return [(op, f, None if isinstance(t, int) else t, t if isinstance(t, int) else None) for op, f, t in specs] or None
