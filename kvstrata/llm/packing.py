"""Cost-balanced packing of tokenised documents into sequences of fixed length.

Every task tokenises its rows and packs them in windows of a bounded number of tokens, so nothing is shuffled and no
group of documents meets in one task. In a window, whole sequences are cut off long documents first; what is left of
each document goes, in descending order of its cost, to the sequence of the lowest cost that still has room for it.
A piece for which no sequence has room is cut: the largest room is filled and the rest goes on in the same way.
A window opens just as many sequences as its tokens need, so at most one sequence's worth of padding arises in it.
"""

from __future__ import annotations

import functools
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvstrata.llm.common import ship, tokenizer_path

#: Tokens packed together; the memory of a task is some bytes for each.
WINDOW = 4_000_000
#: Cost of n tokens of one document: LINEAR * n for the dense layers and n * n for attention.
LINEAR = 4096
#: Sequences of one task at most, as a power of two.
_TASK_BITS = 40


class Tokenizer:
    """Ids of the ``tokenizers`` library for a byte-level BPE file, by a faster library where both are known to agree.

    They differ only in special tokens and in how some newer characters are classed, so a text with any of
    these goes to ``tokenizers`` itself; the classes of characters are compared when a character is first met.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer as Library

        from kvstrata.llm.bpe import load_ranks

        self.library = Library.from_file(json_path)
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(ranks_path), special_tokens={})
        self.split, self.pattern = self.library.pre_tokenizer.pre_tokenize_str, regex.compile(pattern)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.agrees: dict[str, bool] = {}
        self.beyond = regex.compile(r"[^\x00-\x7f]")

    def _agree(self, c: str) -> bool:
        if (known := self.agrees.get(c)) is None:
            probe = f"a{c}a1{c}1!{c}! {c} \n{c}\n{c}"
            known = self.agrees[c] = self.pattern.findall(probe) == [probe[a:b] for _, (a, b) in self.split(probe)]
        return known

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special) or not (text.isascii() or all(map(self._agree, set(self.beyond.findall(text))))):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


@functools.lru_cache(1)
def tokenizer(json_path: str, ranks_path: str, pattern: str) -> Tokenizer:
    return Tokenizer(json_path, ranks_path, pattern)


def assign(lengths: list[int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths, and the number of sequences."""
    pieces, rests, used = [], [], 0
    for i, n in enumerate(lengths):
        whole = n // capacity
        pieces += [(i, k * capacity, capacity, used + k, 0) for k in range(whole)]
        used += whole
        if n % capacity:
            rests.append((n % capacity, i, whole * capacity))
    rests.sort(key=lambda r: (-r[0], r[1]))  # the cost grows with the length
    opened = -(-sum(r[0] for r in rests) // capacity)
    rooms: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    rooms[capacity] = [(0, used + k) for k in range(opened)]
    lowest = np.full(capacity + 1, np.inf)
    if opened:
        lowest[capacity] = 0
    for n, i, start in rests:
        while n:
            room = n + int(lowest[n:].argmin())
            if lowest[room] == np.inf:  # none has room: fill the largest room
                room = int(np.flatnonzero(lowest[1:n] < np.inf)[-1]) + 1
            size = min(n, room)
            cost, seq = heapq.heappop(rooms[room])
            lowest[room] = rooms[room][0][0] if rooms[room] else np.inf
            pieces.append((i, start, size, seq, capacity - room))
            if left := room - size:
                cost += LINEAR * size + size * size
                heapq.heappush(rooms[left], (cost, seq))
                lowest[left] = rooms[left][0][0]
            n, start = n - size, start + size
    return pieces, used + opened


def pack(docs: DataFrame, ident: str = "doc_id", text: str = "text", *, capacity: int = 1024, end_id: int = 0, json_path: str | None = None, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per piece: ident, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and then ``end_id``; a null text is that alone. Each repeated row is a document of its own. Very long
    texts are cut into whole sequences first; documents of one length keep the order of their rows; an empty table gives an
    empty one; other columns are not looked at. Which documents share a sequence depends on how the rows are dealt to tasks.
    Sequence numbers tell the task and the sequence in it; they are the same if a task runs again.
    """
    import public_tokenizers

    paths = (json_path or tokenizer_path("byte_bpe_50k.json"), ranks_path or tokenizer_path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(*paths)
        first = TaskContext.get().partitionId() << _TASK_BITS
        names, ids, waiting = [], [], 0

        def window() -> pa.RecordBatch:
            nonlocal first
            pieces, used = assign([len(x) for x in ids], capacity)
            doc, start, length, seq, offset = (np.array(c, np.int64) for c in zip(*pieces, strict=True))
            crc = [zlib.crc32(ids[i][a : a + n]) for i, a, n, _, _ in pieces]
            tokens = np.array([len(x) for x in ids], np.int64)[doc]
            out = [pa.array(names, kind).take(pa.array(doc)), *map(pa.array, (start, length)), pa.array(crc, pa.int64()), *map(pa.array, (tokens, seq + first, offset))]
            first += used
            return pa.RecordBatch.from_arrays(out, names=["ident", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = np.append(encode.ids(t.as_py() or ""), np.uint32(end_id)).astype("<u4", copy=False)
                names.append(name)
                ids.append(found)
                waiting += len(found)
                if waiting >= WINDOW:
                    yield window()
                    names, ids, waiting = [], [], 0
        if ids:
            yield window()

    kind = docs.schema[ident].dataType.simpleString()
    schema = f"ident {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col(ident).alias("ident"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("ident", ident)
