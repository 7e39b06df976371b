"""Token counting, coding and packing against the libraries, on whole texts."""

import collections
import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from kvstrata.llm import bpe, packing, token_counts  # noqa: E402

DOCS = "doc_id long, text string, ids string, known string, n_tokens int"
JSON, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def texts(n=150):
    rnd = random.Random(11)
    out = [None, "", " ", "  \n ", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "a" * 6_000, "1" * 3_000, "ab" * 3_000, " " * 2_000 + "x", "it's we'll 're ''s 'sx", "\u0558\u058b \ua7ce", "x\u0085y\u00a0z", "same", "same"]
    out += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0x80, 0x3000), rnd.randrange(0x10000, 0x1FFFF)])) for _ in range(rnd.randrange(60))) for _ in range(n)]
    out += ["".join(rnd.choice(["'s", "'re", "'", "'ll", " ", "  ", "\n", "a", "the", "ing", "1", "!", "é", "\t"]) for _ in range(rnd.randrange(80))) for _ in range(n)]
    out += ["".join(rnd.choice("abcdefghnt") for _ in range(rnd.randrange(400, 1500))) for _ in range(5)]
    return out


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path(JSON))


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path(RANKS)), special_tokens={})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(texts())], DOCS)


def test_counts(docs, library):
    every = texts()
    for r in token_counts.digest(docs).collect():
        t = every[r["doc_id"]] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 512), t[:80]


@pytest.mark.parametrize(("chunk", "strip"), [(1, 50), (2, 3), (7, 10_000), (64, 100), (64, 1 << 19)])
def test_chunk_maps_compose(chunk, strip, library):
    machine = token_counts.compiled(P.path(JSON))
    every = [x or "" for x in texts(30)]
    assert machine.count(every, chunk, strip) == [len(library.encode(t, add_special_tokens=False).ids) for t in every]


def test_small_chunks_on_the_registered_path(docs, library, monkeypatch):
    """With chunks of 64 characters nearly every text of the query is a composition of maps."""
    monkeypatch.setattr(token_counts.Compiled.count, "__defaults__", (64, 200))
    machine = token_counts.Compiled(P.path(JSON))
    seen = []
    compose = machine.compose
    machine.compose = lambda f, g: seen.append(1) or compose(f, g)
    every = [t or "" for t in texts()]
    assert machine.count(every) == [len(library.encode(t, add_special_tokens=False).ids) for t in every]
    assert len(seen) > sum(len(t) // 64 for t in every)


def test_compose_is_associative():
    machine = token_counts.compiled(P.path(JSON))
    text = "we'll see  if it's\n\n fine 123abc, or not " + "unbroken" * 9
    maps = machine.maps([(text, a, min(a + 5, len(text))) for a in range(0, len(text), 5)], 5)
    assert any(m.exit < 0 for m in maps) and any(m.exit >= 0 for m in maps)
    left = maps[0]
    for m in maps[1:]:
        left = machine.compose(left, m)
    right = maps[-1]
    for m in reversed(maps[:-1]):
        right = machine.compose(m, right)
    assert left == right == machine.scan(list(maps)) == machine.maps([(text, 0, len(text))], 5)[0]


def test_few_states(monkeypatch, library):
    monkeypatch.setattr(token_counts, "STATES", 50)
    machine = token_counts.Compiled(P.path(JSON))
    for t in ("internationalisation of thoughtfulness", "abcdefghijklmnop qrstuv", "antidisestablishmentarianism" * 20):
        assert machine.count([t, t], 4, 9) == [len(library.encode(t, add_special_tokens=False).ids)] * 2


def test_encoding(docs, tik):
    every = texts()
    for r in bpe.digest(docs).collect():
        t = every[r["doc_id"]] or ""
        ids = tik.encode_ordinary(t)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), t[:80]
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_general_encoding(docs):
    every = texts()
    for r in bpe.encode(docs, "doc_id", "text", P.path(RANKS), P.PATTERN).collect():
        assert bytes(r["decoded"]) == (every[r["doc_id"]] or "").encode()


def test_pair_table():
    rnd = random.Random(4)
    pairs = {(rnd.randrange(900), rnd.randrange(900)): i for i in range(5_000)}
    table = bpe.PairTable(pairs)
    a, b = np.array([rnd.randrange(-1, 900) for _ in range(20_000)], np.int32), np.array([rnd.randrange(-1, 900) for _ in range(20_000)], np.int32)
    assert table(a, b).tolist() == [pairs.get((x, y), 2**31 - 1) for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def test_packing(docs, library):
    every = texts()
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in enumerate(every)}
    rows = packing.pack(docs).collect()
    per, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        per[r["doc_id"]].append((r["start"], r["length"]))
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(per) == set(ids)
    for pieces, whole in [*((p, len(ids[i])) for i, p in per.items()), *((s, None) for s in seqs.values())]:
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
        assert at == whole if whole is not None else at <= 1024
    tasks = {s >> 40 for s in seqs}
    assert 1024 * len(seqs) - sum(map(len, ids.values())) < 1024 * len(tasks)


def plain_assign(lengths, capacity):
    """Every rest, in descending order, goes to the sequence of the lowest cost with room; without any, the largest room is filled."""
    used = sum(n // capacity for n in lengths)
    rests = sorted(((n % capacity, i, n - n % capacity) for i, n in enumerate(lengths) if n % capacity), key=lambda r: (-r[0], r[1]))
    opened = -(-sum(r[0] for r in rests) // capacity)
    cost, room, out = [0] * opened, [capacity] * opened, []
    for n, i, start in rests:
        while n:
            fits = [k for k in range(opened) if room[k] >= n]
            k = min(fits, key=lambda k: (cost[k], room[k], k)) if fits else max((k for k in range(opened) if room[k]), key=lambda k: (room[k], -cost[k], -k))
            size = min(n, room[k])
            out.append((i, start, size, used + k, capacity - room[k]))
            cost[k], room[k] = cost[k] + packing.LINEAR * size + size * size, room[k] - size
            n, start = n - size, start + size
    return out


@pytest.mark.parametrize("seed", range(6))
def test_lowest_cost_sequences(seed):
    rnd = random.Random(seed)
    lengths = [rnd.choice([rnd.randrange(1, 400), rnd.randrange(1, 64), 64, 128]) for _ in range(120)]
    pieces, _ = packing.assign(lengths, 64)
    whole = [(i, k * 64, 64) for i, n in enumerate(lengths) for k in range(n // 64)]
    got = [p for p in pieces if p[:3] not in set(whole)]
    assert sorted(p[:3] for p in pieces if p not in got) == sorted(whole) and got == plain_assign(lengths, 64)


def test_packing_windows(monkeypatch, spark):
    lengths = [random.Random(i).randrange(1, 3_000) for i in range(3_000)]
    pieces, used = packing.assign(lengths, 1024)
    assert sum(p[2] for p in pieces) == sum(lengths) and used == -(-sum(lengths) // 1024) or used - sum(lengths) / 1024 < 1.001
    costs = collections.Counter()
    for _, _, n, s, _ in pieces:
        costs[s] += n
    assert max(costs.values()) <= 1024
    assert packing.assign([], 1024) == ([], 0)
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert token_counts.digest(none).count() == bpe.digest(none).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the test tables are not here")
def test_documents(spark, library, tik):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    every = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.digest(df).collect()}
    coded = {r["doc_id"]: r["n_tokens"] for r in bpe.digest(df).collect()}
    packed = {r["doc_id"]: r["doc_tokens"] - 1 for r in packing.pack(df).collect()}
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in every.items()}
    assert counts == packed == want == coded and F is not None
