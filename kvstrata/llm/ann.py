"""Nearest neighbours by additive quantisation.

A vector's direction is approximated by a sum of one codeword from each of several full-dimensional codebooks; its norm
is stored beside the codes. Codebooks start as k-means of what earlier ones leave over; then, in turn, codes are found anew and
all codewords are fitted together by least squares. Codes are found by beam search. A query makes a table of its products
with all codewords, scores codes by adding up table entries, and the best of each batch are ranked again by exact
products. An exact search then holds all products of the batch against the least of those found, so it misses none.

Every valid row is indexed, and the index is written once. Queries and index are dealt into blocks and slices of bounded
size; one job lets every block meet every slice, and merges the best of the slices. Vectors are compared with those of
their own length; the codebooks have as many dimensions as the longest of the sample, and shorter vectors use the first ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvstrata.llm.common import materialize, ship

#: Vectors from which the codebooks are learned, at most.
SAMPLE = 16_384
BOOKS, WORDS, BEAM = 16, 256, 4
#: Times that codes are found and codewords fitted in turn, and steps of conjugate gradients of a fit.
ROUNDS, STEPS = 2, 12
#: Candidates of each batch that are scored exactly, for each query; never fewer than four times the neighbours asked for.
SHORTLIST = 320
#: Queries of one block, about; indexed vectors of one slice, about.
QUERIES, SLICE = 8_192, 8_192
_TABLE = 512
#: Pairs of one step of an exact check.
_PAIRS = 65_536


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
        if (~full).any():
            centres[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return centres


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (n, books) of the sums that come nearest, keeping ``beam`` partial sums from book to book; 1,024 rows at a time."""
    parts = [_encode(x[a : a + 1024], books, beam) for a in range(0, len(x), 1024)]
    return np.concatenate(parts) if parts else np.zeros((0, len(books)), np.uint8)


def _encode(x: np.ndarray, books: np.ndarray, beam: int) -> np.ndarray:
    n, (_, k, d) = len(x), books.shape
    rest, codes = x[:, None, :].astype(np.float32), np.zeros((n, 1, 0), np.uint8 if k <= 256 else np.uint16)
    for book in books.astype(np.float32):
        width = rest.shape[1]
        gain = (book**2).sum(1) - 2 * rest.reshape(-1, d) @ book.T
        error = (gain.reshape(n, width, k) + (rest**2).sum(2)[:, :, None]).reshape(n, width * k)
        keep = min(beam, width * k)
        best = np.argpartition(error, keep - 1, axis=1)[:, :keep] if keep < width * k else np.tile(np.arange(width * k), (n, 1))
        parent, word = best // k, best % k
        row = np.arange(n)[:, None]
        rest = rest[row, parent] - book[word]
        codes = np.concatenate([codes[row, parent], word[:, :, None].astype(codes.dtype)], axis=2)
    return codes[np.arange(n), (rest**2).sum(2).argmin(axis=1)]


def fit(x: np.ndarray, codes: np.ndarray, books: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """The codewords of all books (books, words, d) that together come nearest to x by least squares, with the codes held.

    Conjugate gradients on the normal equations, from the given codewords on; a codeword that no code uses stays.
    """
    m, k, d = books.shape
    order = [np.argsort(codes[:, j], kind="stable") for j in range(m)]
    used = [np.unique(codes[o, j], return_index=True) for j, o in enumerate(order)]

    def sums(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((m, k, d))
        for j in range(m):
            out[j][used[j][0]] = np.add.reduceat(rows[order[j]], used[j][1], axis=0)
        return out

    decoded = lambda words: sum(words[j][codes[:, j]] for j in range(m))
    words = books.astype(np.float64)
    rest = sums(x - decoded(words))
    step, size = rest.copy(), (rest**2).sum()
    for _ in range(steps):
        if size <= 1e-12:
            break
        moved = sums(decoded(step))
        share = size / (step * moved).sum()
        words += share * step
        rest -= share * moved
        size, before = (rest**2).sum(), size
        step = rest + size / before * step
    return words


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Codebooks (books, words, d) learned from the rows of x."""
    rng, n = np.random.default_rng(seed), len(x)
    k, rest, found = min(words, n), x.astype(np.float64), []
    for _ in range(books):
        centres = _kmeans(rest, k, rng)
        rest = rest - centres[np.argmin((centres**2).sum(1) - 2 * rest @ centres.T, axis=1)]
        found.append(centres)
    out = np.stack(found)
    for _ in range(rounds):
        out = fit(x, encode(x, out).astype(np.int64), out)
    return out.astype(np.float32)


def scan(queries: np.ndarray, books: np.ndarray, codes: np.ndarray, norms: np.ndarray, most: int) -> np.ndarray:
    """For each query the places of the ``most`` best rows by table scores, ties to the earlier."""
    m, k, _ = books.shape
    out = np.empty((len(queries), min(most, len(codes))), np.int64)
    for a in range(0, len(queries), _TABLE):
        q = queries[a : a + _TABLE].astype(np.float32)
        score = np.zeros((len(codes), len(q)), np.float32)
        for j in range(m):
            score += (books[j] @ q.T)[codes[:, j]]  # the table of book j: words by queries
        score *= norms[:, None].astype(np.float32)
        if most < len(codes):
            out[a : a + _TABLE] = np.argpartition(-score.T, most - 1, axis=1)[:, :most]
        else:
            out[a : a + _TABLE] = np.arange(len(codes))
    return out


def _valid(vec: str):
    x = F.col(vec)
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(F.exists(x, bad), F.lit(False)) & F.exists(x, lambda v: v != 0)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """The stretches of equal neighbouring rows."""
    change = np.zeros(len(columns[0]), bool)
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    cut = [0, *np.flatnonzero(change).tolist(), len(change)]
    return list(zip(cut, cut[1:], strict=False)) if len(change) else []


def build(df: DataFrame, ident: str, vec: str) -> tuple[DataFrame, np.ndarray] | None:
    """The index (row, id, vec, codes, norm) of all valid rows, and the codebooks; None if there is no valid row.

    A null identifier takes no part. Repeated rows are rows of their own, with different numbers ``row``.
    """
    spark = df.sparkSession
    ship(spark)
    valid = df.filter(F.col(ident).isNotNull() & _valid(vec)).select(F.col(ident).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    rows = materialize(valid.withColumn("row", F.monotonically_increasing_id()), "vectors")
    sample = rows.orderBy(F.xxhash64("id", "row"), "row").limit(SAMPLE).select("vec").toPandas()["vec"]
    if not len(sample):
        return None
    x = np.zeros((len(sample), max(map(len, sample))))
    for to, v in zip(x, sample, strict=True):
        to[: len(v)] = v
    books = train(x / np.linalg.norm(x, axis=1, keepdims=True))
    shared = spark.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, norms = np.zeros((batch.num_rows, len(shared.value)), np.uint8), np.zeros(batch.num_rows)
            for a, b in _runs(batch.column(2).value_lengths().to_numpy()):
                part = batch.column(2).slice(a, b - a)
                d = len(part[0])
                v = _matrix(part, d)
                norms[a:b] = np.linalg.norm(v, axis=1)
                width = min(d, shared.value.shape[2])
                codes[a:b] = encode(v[:, :width] / norms[a:b, None], shared.value[:, :, :width])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms)], names=["row", "id", "vec", "codes", "norm"])

    return materialize(rows.select("row", "id", "vec").mapInArrow(run, "row long, id long, vec array<double>, codes binary, norm double"), "index"), books


def _products(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The products of columns i of x with columns j of y, added up component by component, so their last bits are those of SQL."""
    out = np.zeros(np.broadcast_shapes(i.shape, j.shape))
    for a, b in zip(x, y, strict=True):
        out += a[i] * b[j]
    return out


class _Best:
    """The best candidates of a block of queries so far."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, exact: bool = False):
        self.rows, self.ids, self.vectors, self.k, self.exact = rows, ids, vectors, k, exact
        self.found, self.scores = np.full((len(ids), k), -1, np.int64), np.full((len(ids), k), -np.inf)

    def meet(self, ids: np.ndarray, v: np.ndarray, codes: np.ndarray, norms: np.ndarray, books: np.ndarray) -> None:
        """Score a batch of candidates by the tables, and its best ones exactly.

        Of equal vectors only those of the k + 1 smallest identifiers are scored: no other can be an answer.
        """
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], np.ascontiguousarray(v[order])
        _, same = np.unique(v.view(np.dtype((np.void, v.dtype.itemsize * v.shape[1]))).reshape(-1), return_inverse=True)
        by = np.argsort(same, kind="stable")
        group, names = same[by], ids[by]
        first = np.r_[True, group[1:] != group[:-1]]
        different = np.cumsum(first | np.r_[True, names[1:] != names[:-1]])
        place = np.empty(len(by), np.int64)
        place[by] = different - different[np.flatnonzero(first)[np.cumsum(first) - 1]]
        live = place <= self.k
        ids, v, codes, norms = ids[live], v[live], codes[order][live], norms[order][live]
        width = min(v.shape[1], books.shape[2])
        near = scan(self.vectors[:, :width], books[:, :, :width], codes, norms, max(SHORTLIST, 4 * self.k))
        components = np.ascontiguousarray(v.T)
        for a in range(0, len(self.ids), _TABLE):
            part = slice(a, a + _TABLE)
            at, asked = near[part], np.ascontiguousarray(self.vectors[part].T)
            score = _products(asked, components, np.arange(len(at))[:, None], at)
            score[ids[at] == self.ids[part, None]] = -np.inf
            i, s = np.concatenate([self.found[part], ids[at]], 1), np.concatenate([self.scores[part], score], 1)
            best = np.lexsort((i, -s), axis=1)[:, : self.k]
            self.found[part], self.scores[part] = np.take_along_axis(i, best, 1), np.take_along_axis(s, best, 1)
            if self.exact and at.shape[1] < len(ids):
                self._check(part, at, ids, asked, components)

    def _check(self, part: slice, at: np.ndarray, ids: np.ndarray, asked: np.ndarray, components: np.ndarray) -> None:
        """Score exactly whatever of a batch, beyond the places ``at``, may reach the k best found."""
        found, scores = self.found[part], self.scores[part]  # views
        rough = asked.T @ components
        # more than the rounding of both ways to add up the products
        slack = 4 * len(asked) * np.finfo(float).eps * np.linalg.norm(asked, axis=0)[:, None] * np.linalg.norm(components, axis=0)
        reach = rough + slack >= scores[:, -1:]
        np.put_along_axis(reach, at, False, axis=1)
        reach &= ids != self.ids[part, None]
        q, n = np.nonzero(reach)
        if not len(q):
            return
        exact = np.concatenate([_products(asked, components, q[a : a + _PAIRS], n[a : a + _PAIRS]) for a in range(0, len(q), _PAIRS)])
        # the pairs of a query and its k best so far, as one list
        rows = np.unique(q)
        q, i, s = np.r_[q, np.repeat(rows, self.k)], np.r_[ids[n], found[rows].reshape(-1)], np.r_[exact, scores[rows].reshape(-1)]
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        first = np.searchsorted(q, rows)
        best = first[:, None] + np.arange(self.k)
        found[rows], scores[rows] = i[best], s[best]

    def batch(self) -> pa.RecordBatch:
        some = np.isfinite(self.scores)
        wide = lambda x: pa.array(np.broadcast_to(x[:, None], some.shape)[some])
        return pa.RecordBatch.from_arrays([wide(self.rows), wide(self.ids), pa.array(self.found[some]), pa.array(self.scores[some])], names=["row", "query_id", "vec_id", "score"])


def search(index: DataFrame, books: np.ndarray, queries: DataFrame, k: int, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: for each row (row, id, vec) of queries the k best rows found of its length with another id.

    Scores are exact products in double precision, ties go to the smaller id. With ``exact`` the k best of all are found.
    """
    spark = index.sparkSession
    ship(spark)
    slices, blocks = max(1, -(-index.count() // SLICE)), max(1, -(-queries.count() // QUERIES))
    shared = spark.sparkContext.broadcast(books)
    size, none = F.size("vec").alias("d"), F.lit(None)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    asked = queries.select(size, each(slices).alias("slice"), place(blocks).alias("block"), F.lit(0).alias("kind"), "row", "id", "vec", none.cast("binary").alias("codes"), none.cast("double").alias("norm"))
    table = index.select(size, place(slices).alias("slice"), each(blocks).alias("block"), F.lit(1).alias("kind"), "row", "id", "vec", "codes", "norm")
    key = ["d", "slice", "block"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), slices * blocks)
    dealt = asked.unionByName(table).repartition(tasks, *key).sortWithinPartitions(*key, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        held: list[tuple] = []  # the queries of the block, until its candidates come
        best: _Best | None = None
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(6)]
            for a, b in _runs(*columns[:4]):
                d, slice_, block, kind = (int(c[a]) for c in columns[:4])
                if (d, slice_, block) != at:
                    if best is not None:
                        yield best.batch()
                    at, held, best = (d, slice_, block), [], None
                rows, ids, v = columns[4][a:b], columns[5][a:b], _matrix(batch.column(6).slice(a, b - a), d)
                if kind == 0:
                    held.append((rows, ids, v))
                    continue
                if best is None and held:
                    best = _Best(*(np.concatenate([h[c] for h in held]) for c in range(3)), k, exact)
                    held = []
                if best is not None:
                    codes = np.frombuffer(b"".join(batch.column(7).slice(a, b - a).to_pylist()), np.uint8).reshape(b - a, -1)
                    best.meet(ids, v, codes, batch.column(8).slice(a, b - a).to_numpy(), shared.value)
        if best is not None:
            yield best.batch()

    part = dealt.mapInArrow(run, "row long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return part.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(embeddings: DataFrame, k: int = 20, every: int = 20, exact: bool = False) -> DataFrame:
    """The k nearest of each row whose vec_id is divisible by ``every``, among all rows with another vec_id and a vector of its length.

    Rows with a null vec_id or an invalid vector take no part; without a valid row, or for a query without a candidate, there is
    no answer. Rows that repeat a vec_id stay rows: each is a candidate, and each that asks is answered. Other columns
    are not looked at. With ``exact`` no nearer row is missed.
    """
    built = build(embeddings, "vec_id", "embedding")
    if built is None:
        return embeddings.sparkSession.sql("SELECT 0L AS query_id, 0 AS rank, 0L AS vec_id, 0D AS score WHERE false")
    index, books = built
    return search(index, books, index.filter(F.col("id") % every == 0), k, exact)
