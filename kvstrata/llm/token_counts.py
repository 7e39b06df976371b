"""Token counts by a finite-state transducer compiled from a byte-level BPE tokenizer file.

Two deterministic machines stand behind it.

* The splitter decides from the classes of a few neighbouring characters where a piece starts. Its class table
  is asked from the tokenizer library, character by character, so both agree on every version of Unicode.
* The counter reads the bytes of a piece. A state holds, for every suffix of what was read that may still grow
  into a token, its trie node, the last token before it, and the difference in counts; each transition is
  annotated with the number of tokens it adds (less than zero where a byte joins earlier tokens into one).
  States and transitions are compiled when first met; both are bounded. A piece starts in state 0.

Every text is cut into chunks of CHUNK characters. A chunk is a map of the counter's states: from the state at its start to
that at its end and the tokens added on the way. Where a piece starts in the chunk the end state is one and the same, and
only the bytes before it act on the state that comes in. The maps of a text compose by an associative operation, pairs of
neighbours at a time; no text is read twice, as composition lets a chunk's first bytes act on the state before them.
Counts of whole pieces, sums of annotations from state 0, are remembered.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvstrata.llm.bpe import groups
from kvstrata.llm.common import ship, tokenizer_path

#: Characters of a chunk.
CHUNK = 4096
#: Characters split together, about; a longer text is split in strips, with _HALO characters on both sides.
STRIP = 1 << 19
#: States compiled at most; then compiling starts anew.
STATES = 400_000
#: Counts of pieces kept in a worker.
CACHE = 600_000
_LETTER, _NUMBER, _OTHER, _SPACE, _BLANK, _END, _UNKNOWN = 1, 2, 3, 4, 5, 6, 0
_HALO = 4


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, by character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Splitter:
    """Starts of pieces under the pattern of byte-level tokenizers (contractions, letters, numbers, others, blanks)."""

    def __init__(self, tokenizer):
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        self.classes = np.zeros(0x110000, np.uint8)

    def _probe(self, code: int) -> int:
        c = chr(code)
        if c == " ":
            return _SPACE
        for around, kind in (("a", _LETTER), ("1", _NUMBER), ("!", _OTHER)):
            if len(self.split(around + c + around)) == 1:
                return kind
        return _BLANK

    def classify(self, codes: np.ndarray) -> np.ndarray:
        out = self.classes[codes]
        if not out.all():
            for code in np.unique(codes[out == _UNKNOWN]).tolist():
                self.classes[code] = self._probe(code)
            out = self.classes[codes]
        return out

    def starts(self, codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """True where a piece starts; ``kinds`` are the classes, with _END where a text ends."""
        n = len(codes)
        prev, after = np.r_[np.uint8(_END), kinds[:-1]], np.r_[kinds[1:], np.uint8(_END)]
        blank, prev_blank = (kinds == _SPACE) | (kinds == _BLANK), (prev == _SPACE) | (prev == _BLANK)
        after_solid = (after != _SPACE) & (after != _BLANK) & (after != _END)
        start = np.where(blank, ~prev_blank | after_solid, np.where(prev_blank, prev != _SPACE, prev != kinds))
        start |= (prev == _END) | (kinds == _END)
        for i in np.flatnonzero((codes == 39) & start & (kinds == _OTHER)).tolist():
            near = codes[i + 1 : i + 3].tolist()
            if near and near[0] in _ONE:
                size = 2
            elif tuple(near) in _TWO:
                size = 3
            else:
                continue
            if kinds[i + 1 : i + size].min() == _END or (kinds[i + 1 : i + size] == _END).any():
                continue
            start[i + 1 : i + size] = False
            if i + size < n:
                follow = kinds[i + size]
                start[i + size] = True if follow not in (_SPACE, _BLANK) else start[i + size]
        return start


#: The letters after an apostrophe that make a piece with it.
_ONE = {ord(c) for c in "stmd"}
_TWO = {tuple(map(ord, s)) for s in ("re", "ve", "ll")}


class Counter:
    """The transducer that counts the tokens of a piece."""

    def __init__(self, merges: list[tuple[bytes, bytes]], alphabet: list[bytes]):
        never = len(merges)
        self.rank = {a + b: i for i, (a, b) in reversed(list(enumerate(merges)))}
        self.pair = {p: i for i, p in reversed(list(enumerate(merges)))}
        halves = {t: merges[i] for t, i in self.rank.items()}
        tokens = [*alphabet, *self.rank]
        # the tokens that stand at a token's right (left) edge while it is being made, and the rank at which each is joined
        self.right = {t: self._spine(t, halves, 1, never) for t in tokens}
        self.left = {t: self._spine(t, halves, 0, never) for t in tokens}
        reached: set[bytes] = set(alphabet)
        for t in sorted(self.rank, key=self.rank.__getitem__):
            a, b = halves[t]
            if a in reached and b in reached and self._apart(a, b, self.rank[t]):
                reached.add(t)
        self.children: list[dict[int, int]] = [{}]
        self.token: list[bytes | None] = [None]
        for t in reached:
            node = 0
            for b in t:
                if b not in self.children[node]:
                    self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token.append(None)
                node = self.children[node][b]
            self.token[node] = t
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.states: list[tuple] = [((0, None, 0),)]
        self.number = {self.states[0]: 0}
        self.moves: list[dict[int, tuple[int, int]]] = [{}]

    def _spine(self, t: bytes, halves: dict, side: int, never: int) -> list[tuple[bytes, int]]:
        out, joined = [(t, never)], never
        while t in halves:
            joined, t = self.rank[t], halves[t][side]
            out.append((t, joined))
        return out

    def _apart(self, a: bytes, b: bytes, before: int) -> bool:
        """Whether no merge of a rank under ``before`` joins the right edge of ``a`` to the left edge of ``b``."""
        for x, by in self.right[a]:
            for y, to in self.left[b]:
                z = self.pair.get((x, y))
                # equal pairs merge from the left: the one that ends in x comes before this one, the one that starts with y after it
                if z is not None and z < before and z < by and z <= to:
                    return False
        return True

    def _fit(self, a: bytes | None, b: bytes) -> bool:
        if a is None:
            return True
        if (known := self.fits.get((a, b))) is None:
            if len(self.fits) > 4 * STATES:
                self.fits.clear()
            known = self.fits[a, b] = self._apart(a, b, len(self.pair) + 1)
        return known

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        grown, last, added = [], None, 0
        for node, before, lag in self.states[state]:
            child = self.children[node].get(byte)
            if child is None:
                continue
            token = self.token[child]
            if last is None and token is not None and self._fit(before, token):
                last, added = token, lag + 1
            if self.children[child]:
                grown.append((child, before, lag))
        entry = (*((c, t, lag - added) for c, t, lag in grown), (0, last, 0))
        if (number := self.number.get(entry)) is None:
            number = self.number[entry] = len(self.states)
            self.states.append(entry)
            self.moves.append({})
        move = self.moves[state][byte] = (number, added)
        return move

    def act(self, state: int, word: bytes) -> tuple[int, int]:
        """The state that a word leads to, and the sum of the annotations on the way."""
        total, moves = 0, self.moves
        for byte in word:
            state, added = moves[state].get(byte) or self._compile(state, byte)
            total += added
        return state, total

    def renew(self, state: int = 0) -> int:
        """Start compiling anew if there are too many states; the number that the given state has then."""
        if len(self.states) <= STATES:
            return state
        entry = self.states[state]
        self._clear()
        if entry not in self.number:
            self.number[entry] = len(self.states)
            self.states.append(entry)
            self.moves.append({})
        return self.number[entry]


class StateMap(NamedTuple):
    """What a stretch of text does to a state: ``head`` acts on it; then, if a piece starts, it counts ``count`` and ends in the state ``exit`` (-1: no piece starts)."""

    head: bytes
    count: int
    exit: int


class Compiled:
    """Splitter and counter of a tokenizer file, with the counts of pieces met so far."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        letters = byte_letters()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        raw = lambda s: bytes(letters[c] for c in s)
        merges = [tuple(raw(x) for x in (m if isinstance(m, list) else m.split(" "))) for m in file["model"]["merges"]]
        self.special = [t["content"] for t in file["added_tokens"]]
        self.splitter = Splitter(Tokenizer.from_file(path))
        self.counter = Counter(merges, [bytes([b]) for b in range(256)])
        self.known: dict[str, int] = {"": 0}

    def compose(self, f: StateMap, g: StateMap) -> StateMap:
        """The map that does f and then g."""
        if f.exit < 0:
            return StateMap(f.head + g.head, g.count, g.exit)
        state, added = self.counter.act(f.exit, g.head)
        return StateMap(f.head, f.count + added + g.count, state if g.exit < 0 else g.exit)

    def scan(self, maps: list[StateMap]) -> StateMap:
        """All maps composed in order, pairs of neighbours at a time."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def maps(self, windows: list[tuple[str, int, int]], chunk: int) -> list[StateMap]:
        """The map of each window (text, start, end), all split together."""
        parts, begin, end, at = [], [], [], 0
        for text, a, b in windows:
            lo, hi = max(0, a - _HALO), min(len(text), b + _HALO)
            parts.append(text[lo:hi])
            begin.append(at + a - lo)
            end.append(at + b - lo)
            at += hi - lo + 1
        whole = "\n".join([*parts, ""])
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        kinds = self.splitter.classify(codes)
        kinds[np.cumsum([len(x) + 1 for x in parts]) - 1] = _END  # a text ends there
        starts = np.flatnonzero(self.splitter.starts(codes, kinds))
        edges = [x for a, b in zip(begin, end, strict=True) for x in [*range(a, b, chunk), b]]
        first = np.searchsorted(starts, edges).tolist()
        bounds = [*starts.tolist(), len(whole)]
        pieces = [whole[x:y] for x, y in zip(bounds, bounds[1:], strict=False)]
        counts = np.concatenate([[0], np.cumsum(self._counts(pieces))])
        out, k = [], 0
        for a, b in zip(begin, end, strict=True):
            own = []
            for x in range(a, b, chunk):
                y, i, j = min(x + chunk, b), first[k], first[k + 1]
                k += 1
                if i == j:
                    own.append(StateMap(whole[x:y].encode(), 0, -1))
                else:
                    state, added = self.counter.act(0, whole[bounds[j - 1] : y].encode())
                    own.append(StateMap(whole[x : bounds[i]].encode(), int(counts[j - 1] - counts[i]) + added, state))
            k += 1
            out.append(self.scan(own) if own else StateMap(b"", 0, -1))
        return out

    def _counts(self, pieces: list[str]) -> np.ndarray:
        known, act = self.known, self.counter.act
        new = set(pieces) - known.keys()
        if len(known) + len(new) > CACHE:
            keep = {p: known[p] for p in set(pieces) & known.keys() if len(p) <= 64}
            known.clear()
            known.update(keep)
        for p in new:
            known[p] = act(0, p.encode())[1]
        counts = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
        for p in new:
            if len(p) > 64:  # long pieces are not remembered
                del known[p]
        return counts

    def count(self, texts: list[str], chunk: int = CHUNK, strip: int = STRIP) -> list[int]:
        """Tokens of each text; a special token's string in a text is one token."""
        out = [0] * len(texts)
        held: list[tuple[int, str, int, int]] = []
        size, open_ = 0, StateMap(b"", 0, -1)  # of the segment whose end is still to come

        def flush() -> None:
            nonlocal size, open_
            if not held:
                return
            state = self.counter.renew(max(open_.exit, 0))
            if open_.exit >= 0:
                open_ = open_._replace(exit=state)
            for (i, text, _, b), found in zip(held, self.maps([h[1:] for h in held], chunk), strict=True):
                open_ = self.compose(open_, found)
                if b == len(text):
                    out[i] += self.counter.act(0, open_.head)[1] + open_.count
                    open_ = StateMap(b"", 0, -1)
            held.clear()
            size = 0

        for i, t in enumerate(texts):
            segments = [t]
            for s in self.special:
                if s in t:
                    segments = [y for x in segments for y in x.split(s)]
            out[i] = len(segments) - 1
            for x in segments:
                for a in range(0, len(x), strip):
                    b = min(a + strip, len(x))
                    held.append((i, x, a, b))
                    size += b - a
                    if size >= strip:
                        flush()
        flush()
        return out


@functools.lru_cache(1)
def compiled(path: str) -> Compiled:
    return Compiled(path)


def count_tokens(df: DataFrame, ident: str, text: str, path: str, limit: int) -> DataFrame:
    """Per row: ident, n_bytes, n_tokens, over_limit.

    A null text is empty and has no tokens. Very long texts are split in strips, so a task holds some bytes for each character
    of a text; each is counted whole. Repeated rows stay, an empty table gives an empty one, a null identifier stays null, and
    other columns are not looked at.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = pa.array([n for a, b in groups(texts) for n in machine.count(texts[a:b])], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), counts], names=["ident", "n_bytes", "n_tokens"])

    kind = df.schema[ident].dataType.simpleString()
    counted = df.select(F.col(ident).alias("ident"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")).mapInArrow(run, f"ident {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("ident").alias(ident), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than 512 tokens) of every document, as ``count_tokens`` gives them."""
    return count_tokens(docs, "doc_id", "text", path or tokenizer_path("byte_bpe_50k.json"), 512)
