"""Near-duplicate classes: ProbMinHash sketches of weighted word shingles, banding, and exact verification.

A document is the multiset of its runs of five white-space separated words. Sketches estimate the probability Jaccard
similarity: every shingle is a Poisson process whose rate is its weight, each arrival falls into one of the slots,
and a slot keeps the shingle that arrived first; a document's processes end once no arrival can be first any more.

Exact copies are one text from the start. Texts that share a band meet in rounds. In the first rounds each bucket has one
row for each class it still holds, and every class verifies the few pairs with rows of a bucket's largest class that
agree best by their sketches. Then every text outside of a bucket's largest class meets all texts of other classes there,
in blocks of bounded size; pairs that agree are verified on the spot, in the first band they share, and only links
leave the block. So a bucket's largest class is never compared with itself, no list of pairs is made of a group,
and no candidate is left out. Pairs whose sketches agree in fewer than LEAST of the slots are not verified; at a
true similarity of 0.8 fewer than one pair in two thousand is so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvstrata.llm.bpe import groups
from kvstrata.llm.common import materialize, release, ship

WORDS = 5
SIMILARITY = 0.8
#: Slots of a sketch; bands are runs of a fixed shuffle of them, and two in a row share none.
SLOTS = 192
BANDS, ROWS = 48, 8
#: Share of equal slots below which a pair is not read.
LEAST = 0.7
#: Rounds in which a bucket compares its classes with the largest of them only.
EARLY = 2
#: Pairs that a class verifies in one of these rounds.
TRIES = 3
#: Rows of a block in a bucket.
BLOCK = 256
#: Links of which one task finds the classes; more are joined in rounds.
LINKS = 1_000_000
#: Rows of two numbers that are broadcast.
BROADCAST_ROWS = 400_000
#: Documents compared with one pivot in one task.
PIVOT = 64
#: Rows of one key that a join leaves to one task, at least.
SHARE = 512
#: Words kept hashed in a worker.
CACHE = 500_000
_U = np.uint64
_MIX = tuple(_U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


#: The slots of each band.
_PLACES = np.concatenate([np.random.default_rng(k).permutation(SLOTS) for k in range(BANDS * ROWS // SLOTS)]).reshape(BANDS, ROWS)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _MIX[1]
    x = (x ^ (x >> _U(27))) * _MIX[2]
    return x ^ (x >> _U(31))


class Hashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(texts: list[str], hashes: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (text number, shingle, weight), sorted by text and shingle.

    A text of one to four words has one shingle of all its words; a text without words has none.
    """
    if len(hashes) > CACHE:
        hashes.clear()
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    flat = np.fromiter((h for w in split for h in map(hashes.__getitem__, w)), np.uint64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(texts)), sizes)
    ends = np.cumsum(sizes)
    windows = np.zeros(0, np.uint64)
    where = np.zeros(0, np.int64)
    if len(flat) >= WORDS:
        n = len(flat) - WORDS + 1
        at = np.flatnonzero(np.arange(n) + WORDS <= ends[doc[:n]])
        total = np.zeros(len(at), np.uint64)
        for k in range(WORDS):
            total = mix(total * _MIX[0] + flat[at + k])
        windows, where = total, doc[at]
    short = np.flatnonzero((sizes > 0) & (sizes < WORDS))
    if len(short):
        extra = []
        for i in short.tolist():
            total = np.array([sizes[i]], np.uint64)
            for h in flat[ends[i] - sizes[i] : ends[i]]:
                total = mix(total * _MIX[0] + h)
            extra.append(total[0])
        windows, where = np.r_[windows, np.array(extra, np.uint64)], np.r_[where, short]
    order = np.lexsort((windows, where))
    windows, where = windows[order], where[order]
    first = np.ones(len(windows), bool)
    first[1:] = (windows[1:] != windows[:-1]) | (where[1:] != where[:-1])
    starts = np.flatnonzero(first)
    return where[starts], windows[starts], np.diff(np.r_[starts, len(windows)]).astype(float)


def sketch(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """ProbMinHash: for each of n texts the shingle that arrives first in each slot (0 for a text without shingles)."""
    best, winner = np.full(n * slots, np.inf), np.zeros(n * slots, np.uint64)
    time, state, where, item, rate = np.zeros(len(doc)), shingle.copy(), doc, shingle, weight
    while len(where):
        state = mix(state + _MIX[0])
        time = time - np.log1p(-((state >> _U(11)).astype(float) * 2.0**-53)) / rate
        slot = where * slots + (mix(state ^ _MIX[3]) % _U(slots)).astype(np.int64)
        nearer = np.flatnonzero(time < best[slot])
        at, t = slot[nearer], time[nearer]
        np.minimum.at(best, at, t)
        won = best[at] == t
        winner[at[won]] = item[nearer][won]
        # a process ends when its next arrival comes after the last of the first arrivals
        alive, back = np.unique(where, return_inverse=True)
        last = best.reshape(n, slots)[alive].max(axis=1)
        on = time < last[back]
        time, state, where, item, rate = time[on], state[on], where[on], item[on], rate[on]
    return winner.reshape(n, slots)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two weighted sets, each as sorted items and weights; 0 if either is empty."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    x, y = a[1][i], b[1][j]
    rest_x, rest_y = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    total = 0.0
    ratio, back = np.unique(y / x, return_inverse=True)
    for k, r in enumerate(ratio):  # sum over e of max(x_e / x_d, y_e / y_d) depends on d by x_d and y_d / x_d alone
        whole = rest_x + rest_y / r + np.maximum(x, y / r).sum()
        total += (x[back == k] / whole).sum()
    return float(total)


def hashes(text: str) -> list[Column]:
    """Two longs that stand for a text."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def sketches(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """Per row with an identifier and a text: id, hash of the text (two longs), bands (one long each; null without shingles)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for a, b in groups(texts):
                part = texts[a:b]
                doc, item, weight = shingles(part, known)
                won = sketch(doc, item, weight, len(part))
                some = np.zeros(len(part), bool)
                some[doc] = True
                bands = np.zeros((len(part), BANDS), np.uint64)
                for k in range(ROWS):
                    bands = mix(bands * _MIX[0] + won[:, _PLACES[:, k]])
                bands = mix(bands + np.arange(BANDS, dtype=np.uint64) * _MIX[4]).view(np.int64)
                own = pa.array([bands[i] if s else None for i, s in enumerate(some)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(3)), own], names=["id", "h1", "h2", "bands"])

    rows = docs.filter(F.col(text).isNotNull() & F.col(ident).isNotNull())
    return rows.select(F.col(ident).cast("long").alias("id"), *hashes(text), F.col(text).alias("text")).mapInArrow(run, "id long, h1 long, h2 long, bands array<long>")


def sets(texts: DataFrame) -> DataFrame:
    """For rows (id, text): id, slots (four bytes each), items (sorted shingles, eight bytes each) and weights (doubles; null if all are one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in batches:
            every = batch.column(1).to_pylist()
            for a, b in groups(every):
                doc, item, weight = shingles(every[a:b], known)
                won = sketch(doc, item, weight, b - a).astype("<u4")
                cut = np.searchsorted(doc, np.arange(b - a + 1)).tolist()
                own = [slice(i, j) for i, j in zip(cut, cut[1:], strict=False)]
                columns = [[w.tobytes() for w in won], [item[s].tobytes() for s in own], [None if (weight[s] == 1).all() else weight[s].tobytes() for s in own]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(c, pa.binary()) for c in columns)], names=["id", "slots", "items", "weights"])

    return texts.select("id", "text").mapInArrow(run, "id long, slots binary, items binary, weights binary")


def _set(items: bytes, weights: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    items = np.frombuffer(items, np.uint64)
    return items, np.ones(len(items)) if weights is None else np.frombuffer(weights)


def _agreeing(pairs: DataFrame, slots: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches agree in LEAST of the slots, with that share as ``agree``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u4").reshape(-1, SLOTS) for k in (2, 3))
                share = (x == y).mean(axis=1)
                keep = pa.array(share >= LEAST)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).filter(keep) for k in (0, 1)), pa.array(share).filter(keep)], names=["a", "b", "agree"])

    left, right = (slots.select(F.col("id").alias(k), F.col("slots").alias(f"s_{k}")) for k in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long, agree double")


def across(rows: DataFrame) -> DataFrame:
    """The links (a, b) between texts of different classes in a bucket, of rows (key, band, id, class, slots, items, weights).

    Within a bucket rows are dealt into blocks; every block of rows outside of the largest class meets each
    block at or after it and each block of the largest class, and nothing else meets.
    """
    per = rows.groupBy("key", "class").agg(F.count(F.lit(1)).alias("k"))
    largest = per.groupBy("key").agg(F.max(F.struct(F.col("k"), (-F.col("class")).alias("c"))).alias("top"), F.sum("k").alias("all"))
    largest = largest.filter(F.col("all") > F.col("top.k")).select("key", (-F.col("top.c")).alias("top"), F.ceil(F.col("top.k") / BLOCK).cast("int").alias("n_top"), F.ceil((F.col("all") - F.col("top.k")) / BLOCK).cast("int").alias("n_rest"))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("class") == F.col("top"), F.col("n_top")).otherwise(F.col("n_rest"))).cast("int")
    dealt = rows.join(largest, "key").withColumn("own", own)
    # a task is (left block, right block); right blocks of the largest class have numbers below zero
    side = lambda left, l, r: F.struct(F.lit(left).alias("left"), l.alias("l"), r.alias("r"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    of_top = F.transform(upto(F.col("n_rest")), lambda t: side(False, t, -1 - F.col("own")))
    of_rest = F.concat(
        F.transform(upto(F.col("n_top")), lambda s: side(True, F.col("own"), -1 - s)),
        F.transform(F.sequence(F.col("own"), F.col("n_rest") - 1), lambda u: side(True, F.col("own"), u)),
        F.transform(F.sequence(F.lit(0), F.col("own")), lambda t: side(False, t, F.col("own"))),
    )
    placed = dealt.withColumn("at", F.explode(F.when(F.col("class") == F.col("top"), of_top).otherwise(of_rest)))
    placed = placed.select("key", F.col("at.l").alias("l"), F.col("at.r").alias("r"), F.col("at.left").alias("left"), "class", "id", "band", "slots", "items", "weights")
    placed = placed.repartition("key", "l", "r").sortWithinPartitions("key", "l", "r")

    def links(rows: list, out: list) -> None:
        left, right = [r for r in rows if r[3]], [r for r in rows if not r[3]]
        if not left or not right:
            return
        x, y = (np.frombuffer(b"".join(r[7] for r in part), "<u4").reshape(-1, SLOTS) for part in (left, right))
        cy, iy = (np.array([r[k] for r in right]) for k in (4, 5))
        ready: dict[int, tuple] = {}
        for i, one in enumerate(left):
            same = y == x[i]
            near = np.flatnonzero((same.mean(axis=1) >= LEAST) & (cy != one[4]) & ((iy < one[5]) | (one[2] != one[1])))
            if not len(near):
                continue
            # a pair is verified in the first band that both share
            near = near[same[near][:, _PLACES].all(axis=2).argmax(axis=1) == one[6]]
            own = _set(one[8], one[9])
            for j in near.tolist():
                if j not in ready:
                    ready[j] = _set(right[j][8], right[j][9])
                if similarity(own, ready[j]) >= SIMILARITY:
                    out.append((max(one[5], right[j][5]), min(one[5], right[j][5])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

        held: list = []
        for batch in batches:
            out: list = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(10)), strict=True):
                if held and row[:3] != held[0][:3]:
                    links(held, out)
                    held = []
                held.append(row)
            yield batch_of(out)
        out = []
        links(held, out) if held else None
        yield batch_of(out)

    return placed.mapInArrow(run, "a long, b long").distinct()


def _by_key(left: DataFrame, right: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """``left`` (that many rows) joined with ``right``, which has one row for each of its keys and the number of its left rows as ``n``.

    Frequent keys are joined by broadcast, so no task gets all rows of one. At most BROADCAST_ROWS keys are frequent, as each
    has more rows than this share of all; any other has so few that they fit into a task.
    """
    most = max(SHARE, rows // BROADCAST_ROWS)
    frequent = right.filter(F.col("n") > most).select(*keys, *[F.col(c).alias(f"f_{c}") for c in right.columns if c not in keys])
    first = left.join(F.broadcast(frequent), keys, "left")
    done = first.filter("f_n IS NOT NULL").select(*left.columns, *[F.col(f"f_{c}").alias(c) for c in right.columns if c not in keys])
    rest = first.filter("f_n IS NULL").select(*left.columns).join(right.filter(F.col("n") <= most), keys)
    return done.unionByName(rest.select(done.columns))


def _small(df: DataFrame) -> DataFrame:
    """The written table for a join: broadcast up to BROADCAST_ROWS rows, as it is beyond."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def verify(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) whose similarity is SIMILARITY or more; ``known`` has the sets of their ids.

    Sets are dealt out by b, the pivot, in shares of PIVOT, each share with a copy of the pivot's set; a task streams
    its rows and holds one pivot at a time.
    """
    shares = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PIVOT).cast("int").alias("shares"))
    rows = pairs.join(shares, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("kind"))
    pivots = shares.select(F.col("b").alias("a"), "b", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("kind"))
    dealt = rows.unionByName(pivots).join(known.select(F.col("id").alias("a"), "items", "weights"), "a")
    dealt = dealt.repartition("b", "share").sortWithinPartitions("b", "share", "kind").select("a", "b", "share", "kind", "items", "weights")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, at = None, None
        for batch in batches:
            found = []
            for i, (_, b, share, kind, items, weights) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True)):
                if kind == 0:
                    pivot, at = _set(items, weights), (b, share)
                elif at == (b, share) and similarity(_set(items, weights), pivot) >= SIMILARITY:
                    found.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(found, pa.int64())) for k in (0, 1)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def top(i: int) -> int:
        while (up := parent.setdefault(i, i)) != i:
            parent[i] = i = parent[up]
        return i

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = sorted((top(a), top(b)))
            parent[b] = a
    yield pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array([top(i) for i in list(parent)], pa.int64())], names=["id", "class"])


def components(links: DataFrame, most: int = LINKS) -> DataFrame:
    """For every end of a link (a, b): id and the smallest id it is connected to, as ``class``.

    Up to ``most`` links go to one task. Beyond, each round takes the smallest class among neighbours and then the
    class of that class, so that a path halves in each.
    """
    ship(links.sparkSession)
    if links.count() <= most:
        return materialize(links.select("a", "b").coalesce(1).mapInArrow(_union, "id long, class long"), "classes")
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    now = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("class")), "classes")
    while True:
        near = both.join(now.select(F.col("id").alias("b"), F.col("class").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        step = now.join(near, now["id"] == near["a"]).select("id", F.col("class").alias("was"), F.least("class", "c").alias("to"))
        step = materialize(step, "step")
        up = step.select(F.col("id").alias("to"), F.col("to").alias("up"))
        after = materialize(step.join(up, "to", "left").select("id", "was", F.least("to", F.coalesce("up", "to")).alias("class")), "classes")
        release(step)
        changed = not after.filter(F.col("class") != F.col("was")).isEmpty()
        release(now)
        now = after
        if not changed:
            release(both)
            return now.select("id", "class")


def _classes(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """id, h1, h2 and class_id of every row with an identifier and a text. Classes are of texts; each is named by its smallest identifier."""
    base = materialize(sketches(docs, ident, text).withColumn("row", F.monotonically_increasing_id()), "sketches")
    rows = base.count()
    # of equal texts the row of the smallest identifier stands for all
    first = base.groupBy("h1", "h2").agg(F.min(F.struct("id", "row")).alias("first"), F.count(F.lit(1)).alias("n"))
    copies = materialize(first.filter("n > 1").select("h1", "h2", F.col("first.row").alias("rep"), "n"), "copies")
    again = _by_key(base.select("row", "id", "h1", "h2").join(_small(copies.select("h1", "h2")), ["h1", "h2"], "left_semi"), copies, ["h1", "h2"], rows).select("row", "rep")
    again = materialize(again.filter("row != rep"), "again")
    reps = base.join(again.select("row"), "row", "left_anti").filter("bands IS NOT NULL").select("row", "id", "h1", "h2", "bands")
    banded = reps.select("row", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("key").agg(F.min("row").alias("first"), F.max("row").alias("last")).filter(F.col("first") < F.col("last")).select("key")
    buckets = materialize(banded.join(shared, "key").select("key", "band", F.col("row").alias("id")), "buckets")
    near = materialize(reps.join(buckets.select(F.col("id").alias("row")).distinct(), "row", "left_semi").select("row", "id", "h1", "h2"), "near")
    # only a text that shares a band with another is read again; equal rows of one identifier are one text
    texts = docs.filter(F.col(text).isNotNull()).select(F.col(ident).cast("long").alias("id"), *hashes(text), F.col(text).alias("text"))
    texts = texts.join(_small(near), ["id", "h1", "h2"]).select(F.col("row").alias("id"), "text")
    repeated = not base.groupBy("id", "h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    known = materialize(sets(texts.dropDuplicates(["id"]) if repeated else texts), "sets")
    release(copies, near)
    links = None
    classes = components(docs.sparkSession.sql("SELECT 0L AS a, 0L AS b WHERE false"))
    for turn in range(EARLY + 1):
        sizes = classes.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
        named = materialize(classes.join(sizes, "class"), "named")
        of = buckets.join(_small(named), "id", "left").select("key", "band", "id", F.coalesce("class", "id").alias("class"), F.coalesce("n", F.lit(1)).alias("n"))
        used = [named]
        if turn < EARLY:
            # one row for each class of a bucket, beside the one of the largest class
            heads = materialize(of.groupBy("key", "class").agg(F.min("id").alias("id"), F.max("n").alias("size")), "heads")
            top = heads.groupBy("key").agg(F.max(F.struct(F.col("size"), (-F.col("id")).alias("id"))).alias("top"), F.count(F.lit(1)).alias("n"))
            top = materialize(top.filter("n > 1").select("key", (-F.col("top.id")).alias("q"), "n"), "top")
            beside = _by_key(heads.join(_small(top.select("key")), "key", "left_semi"), top, ["key"], buckets.count()).filter("id <> q")
            pairs = materialize(beside.groupBy(F.greatest("id", "q").alias("a"), F.least("id", "q").alias("b")).agg(F.min("class").alias("side")), "pairs")
            good = _agreeing(pairs.select("a", "b"), known.select("id", "slots")).join(pairs, ["a", "b"])
            best = F.row_number().over(Window.partitionBy("side").orderBy(F.desc("agree"), "a", "b"))
            chosen = materialize(good.withColumn("r", best).filter(F.col("r") <= TRIES).select("a", "b"), "chosen")
            found = verify(chosen, known)
            used += [heads, top, pairs, chosen]
        else:
            many = of.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter(F.col("lo") < F.col("hi")).select("key")
            left = materialize(of.join(many, "key").select("key", "band", "id", "class"), "left")
            found = across(left.join(known, "id"))
            used.append(left)
        found = materialize(found, "found")
        if not found.isEmpty():
            before = [links, classes]
            links = materialize(found if links is None else links.unionByName(found), "links")
            classes = components(links)
            used += before
        release(*used, found)
    release(buckets, known, links)
    # from rows to the texts that stand for them, to classes, to the smallest identifier of each class
    placed = base.select("row", "id", "h1", "h2").join(again, "row", "left").withColumn("rep", F.coalesce("rep", "row"))
    named = placed.join(classes.select(F.col("id").alias("rep"), "class"), "rep", "left") if classes.count() > BROADCAST_ROWS else placed.join(F.broadcast(classes.select(F.col("id").alias("rep"), "class")), "rep", "left")
    named = materialize(named.select("id", "h1", "h2", F.coalesce("class", "rep").alias("class")), "classed")
    release(base, again, classes)
    smallest = materialize(named.groupBy("class").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "smallest")
    alone = named.join(_small(smallest.select("class")), "class", "left_anti").withColumn("class_id", F.col("id"))
    together = _by_key(named.join(_small(smallest.select("class")), "class", "left_semi"), smallest, ["class"], rows)
    return alone.select("id", "h1", "h2", "class_id").unionByName(together.select("id", "h1", "h2", "class_id"))


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of documents: ident and class_id, the smallest identifier of its class (its own, if it has no duplicate).

    Equal texts are one class, and texts of a similarity of SIMILARITY or more are linked. A row with a null text or
    a text without words is alone, but for equal texts; a null identifier has a null class. Repeated rows stay. Where an
    identifier has several texts, each is of its own class. Very long texts are whole, in a task's memory one by one; an
    empty table gives an empty one; other columns are not looked at.
    """
    found = _classes(docs, ident, text).select(F.col("id").cast(docs.schema[ident].dataType).alias(ident), "class_id")
    rest = docs.filter(F.col(text).isNull() | F.col(ident).isNull()).select(F.col(ident), F.col(ident).cast("long").alias("class_id"))
    return found.unionByName(rest)


def keep_one(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of documents without those whose class has a smaller identifier; of equal rows of one identifier and text one stays.

    Rows without an identifier or a text all stay. Other columns come along.
    """
    found = materialize(_classes(docs, ident, text), "kept")
    dropped = found.filter("class_id < id").select(F.col("id").alias("d_id"), F.col("h1").alias("d_h1"), F.col("h2").alias("d_h2")).distinct()
    same = (docs[ident].cast("long") == F.col("d_id")) & (F.xxhash64(docs[text]) == F.col("d_h1")) & (F.xxhash64(F.lit(1), docs[text]) == F.col("d_h2"))
    named = F.col(ident).isNotNull() & F.col(text).isNotNull()
    kept = docs.filter(named).join(dropped, same, "left_anti")
    repeated = not found.groupBy("id", "h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    return (kept.dropDuplicates([ident, text]) if repeated else kept).unionByName(docs.filter(~named))
