"""Byte-level BPE by numpy: pieces of like length form padded matrices, in which every row merges its leftmost
pair of minimum rank in each round. Ranks of pairs come from an open-addressing hash table, and a merged column is
squeezed out of each row at once, so a matrix gets one column narrower per round; finished rows leave it.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvstrata.llm.common import ship, tokenizer_path

#: No pair: larger than any rank.
_NONE = np.int32(2**31 - 1)
#: Entries of one matrix at most.
CELLS = 1 << 20
#: Pieces of more bytes are merged row by row.
LONG = 512
#: Pieces kept encoded in a worker.
CACHE = 300_000
#: Characters of text encoded together.
BATCH = 1 << 20


class PairTable:
    """Ranks of pairs of ids, looked up for whole arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        bits = max(4, (2 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int32)
        keys = np.array([(a << 32) | b for a, b in pairs], np.int64).reshape(-1)
        ranks = np.array(list(pairs.values()), np.int32).reshape(-1)
        slots = self._slots(keys)
        self.probes, left = 0, np.arange(len(keys))
        while len(left):  # all keys of this distance at once; the first of each free slot gets it
            self.probes += 1
            at = slots[left]
            free = self.keys[at] == -1
            _, first = np.unique(at[free], return_index=True)
            won = left[free][first]
            self.keys[slots[won]], self.ranks[slots[won]] = keys[won], ranks[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slots[left] = (slots[left] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; where a part is negative (padding) or the pair is unknown, the largest number."""
        out = np.full(a.shape, _NONE, np.int32)
        live = np.flatnonzero((a >= 0) & (b >= 0))
        keys = (a.reshape(-1)[live].astype(np.int64) << 32) | b.reshape(-1)[live]
        slots, flat = self._slots(keys), out.reshape(-1)
        for _ in range(self.probes):
            found = self.keys[slots]
            hit = found == keys
            flat[live[hit]] = self.ranks[slots[hit]]
            on = ~hit & (found != -1)
            if not on.any():
                break
            live, keys, slots = live[on], keys[on], (slots[on] + 1) & self.mask
        return out


class Encoder:
    """Ids of pieces under a vocabulary of ranks, as a byte-pair library gives them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.pairs = PairTable(pairs)
        #: Ids whose pairs may have a smaller rank than their own, so that several merges at once could go wrong.
        self.unsafe = {x for (a, b), r in pairs.items() for x in (a, b) if r < x}
        self.words = {r: t for t, r in ranks.items()}

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each piece."""
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (r := self.ranks.get(p)) is not None:
                out[i] = struct.pack("<I", r)
            elif len(p) > LONG:
                out[i] = self._long(p)
            elif p:
                buckets.setdefault((len(p) - 1).bit_length(), []).append(i)
        for bits, rows in buckets.items():
            step = max(1, CELLS >> bits)
            for k in range(0, len(rows), step):
                self._matrix(pieces, rows[k : k + step], 1 << bits, out)
        return out

    def _matrix(self, pieces: list[bytes], rows: list[int], width: int, out: list[bytes]) -> None:
        lengths = np.array([len(pieces[i]) for i in rows])
        ids = np.full((len(rows), width), -1, np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.single[np.frombuffer(b"".join(pieces[i] for i in rows), np.uint8)]
        names, ranks = np.array(rows), self.pairs(ids[:, :-1], ids[:, 1:])
        while True:
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(ids), np.int64)
            best = ranks[np.arange(len(ids)), at] if ranks.shape[1] else np.full(len(ids), _NONE)
            ended = best == _NONE
            if ended.any():
                rows_out = ids[ended]
                full = rows_out >= 0
                ends, flat = (4 * full.sum(axis=1).cumsum()).tolist(), rows_out[full].astype("<u4").tobytes()
                for i, a, b in zip(names[ended].tolist(), [0, *ends], ends, strict=False):
                    out[i] = flat[a:b]
                live = ~ended
                names, ids, ranks, at, best = names[live], ids[live], ranks[live], at[live], best[live]
            if not len(ids):
                return
            n, width = ids.shape
            row, columns = np.arange(n), np.arange(width)
            ids[row, at] = best
            ids = ids[columns != (at + 1)[:, None]].reshape(n, width - 1)
            ranks = ranks[columns[:-1] != at[:, None]].reshape(n, width - 2)
            if ranks.shape[1]:
                for place in (at - 1, at):  # the pairs on both sides of the new id
                    ok = (place >= 0) & (place < ranks.shape[1])
                    ranks[row[ok], place[ok]] = self.pairs(ids[row[ok], place[ok]], ids[row[ok], place[ok] + 1])

    def _long(self, piece: bytes) -> bytes:
        """One long piece: each round merges all places of the best pair, from the left, where that gives the same."""
        ids = self.single[np.frombuffer(piece, np.uint8)]
        ranks = self.pairs(ids[:-1], ids[1:])
        while len(ranks) and (best := ranks.min()) != _NONE:
            places = np.flatnonzero(ranks == best)
            if len(places) > 1:  # of adjoining places every second one
                start = np.r_[True, np.diff(places) > 1]
                run = np.arange(len(places)) - np.flatnonzero(start)[np.cumsum(start) - 1]
                places = places[run % 2 == 0]
                if int(best) in self.unsafe and self._earlier(ids, places, best):
                    places = places[:1]
            ids[places] = best
            keep = np.ones(len(ids), bool)
            keep[places + 1] = False
            ids = ids[keep]
            changed = np.flatnonzero(np.isin(ids, best))
            keep = np.ones(len(ranks), bool)
            keep[places] = False
            ranks = ranks[keep]
            for place in (changed - 1, changed):
                place = place[(place >= 0) & (place < len(ranks))]
                ranks[place] = self.pairs(ids[place], ids[place + 1])
        return ids.astype("<u4").tobytes()

    def _earlier(self, ids: np.ndarray, places: np.ndarray, best: np.int32) -> bool:
        """Whether merging at these places, from the left, would on the way form a pair that comes before ``best``."""
        left = ids[np.maximum(places - 1, 0)].copy()
        left[1:][np.diff(places) == 2] = best
        new = np.full(len(places), best)
        right = ids[np.minimum(places + 2, len(ids) - 1)]
        first, last = places > 0, places + 2 < len(ids)
        return bool((self.pairs(left[first], new[first]) < best).any() or (self.pairs(new[last], right[last]) < best).any())

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(2)
def encoder(path: str) -> tuple[Encoder, dict[str, bytes]]:
    """The encoder of a file of ranks and its pieces encoded so far; one of each per worker."""
    return Encoder(load_ranks(path)), {}


def encode_texts(texts: list[str], pattern, enc: Encoder, cache: dict[str, bytes]) -> list[bytes]:
    """Ids of each text; ``cache`` holds at most CACHE pieces besides those of these texts."""
    split = [pattern.findall(t) for t in texts]
    used = set().union(*split)
    if len(cache) > CACHE:
        keep = {p: cache[p] for p in used & cache.keys()}
        cache.clear()
        cache.update(keep)
    new = list(used - cache.keys())
    cache.update(zip(new, enc.encode([p.encode() for p in new]), strict=True))
    out = [b"".join(map(cache.__getitem__, ps)) for ps in split]
    for p in new:
        if len(p) > 64:  # long pieces are not remembered
            del cache[p]
    return out


def groups(texts: list[str], most: int = BATCH) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters together, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def encode(df: DataFrame, ident: str, text: str, path: str, pattern: str) -> DataFrame:
    """Per row: ident, ids (little-endian unsigned 32-bit), and the bytes that the ids decode to. A null text is empty."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(pattern)
        enc, cache = encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in groups(texts):
                ids = encode_texts(texts[a:b], split, enc, cache)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.binary()), pa.array([enc.decode(x) for x in ids], pa.binary())], names=["ident", "ids", "decoded"])

    kind = df.schema[ident].dataType.simpleString()
    return df.select(ident, text).mapInArrow(run, f"ident {kind}, ids binary, decoded binary").withColumnRenamed("ident", ident)


def digest(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, the number of tokens, and digests of the ids and of what they decode to.

    A null text is empty and has no ids. Very long texts are coded whole, one at a time in a task. Repeated rows are coded
    alike, a null identifier stays null, an empty table gives an empty one, and other columns are not looked at.
    """
    import public_tokenizers

    path, pattern = path or tokenizer_path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(pattern)
        enc, cache = encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, back = [], []
            counts = []
            for a, b in groups(texts):
                for x in encode_texts(texts[a:b], split, enc, cache):
                    counts.append(len(x) // 4)
                    ids.append(hashlib.sha256(x).hexdigest())
                    back.append(hashlib.sha256(enc.decode(x)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
