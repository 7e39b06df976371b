"""Sharding, personal data, chat formatting and quality rules against plain Python."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from kvstrata.llm import chat, pii, quality, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


def odd_texts():
    return [None, "", " ", "a", "same text", "same text", "x" * 20_000, "word " * 5_000, "line\n" * 3_000, "\n\n\t", "ünïcödé 😀 text"]


def clashing(df):
    """The same rows with more columns, named like those that operators make."""
    names = ["size", "shard", "kept", "q_text", "key", "node", "keys", "ident", "spans", "text_crc32", "conv", "body", "words"]
    return df.withColumns({n: F.lit("x") for n in names})


# sharding
def sharded(spark, texts, n=8, frame=None):
    return sharding.shard_documents(documents(spark, texts) if frame is None else frame, n).collect()


def test_shards_are_even_and_gapless(spark):
    rnd = random.Random(3)
    texts = ["hot" * 40] * 700 + ["".join(rnd.choice("abcé ") for _ in range(rnd.randrange(400))) for _ in range(1300)] + [None, ""]
    rows = sharded(spark, texts)
    assert {r["doc_id"] for r in rows} == set(range(len(texts)))
    total, per = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        t = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(t) + 1 and r["text_crc32"] == zlib.crc32(t) and r["law"] == "bytes" and r["grown_shard"] is None
        total[r["shard"]] += r["size"]
        per[r["shard"]].append(r["slot"])
    assert set(total) == set(range(8))
    assert max(total.values()) - min(total.values()) <= 0.03 * sum(total.values()) / 8
    assert all(sorted(s) == list(range(len(s))) for s in per.values())
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, sharded(spark, texts)), key=str)


def test_shards_of_odd_rows(spark):
    assert len(sharded(spark, odd_texts())) == len(odd_texts())
    assert len(sharded(spark, None, frame=clashing(documents(spark, odd_texts())))) == len(odd_texts())
    assert sharded(spark, [], frame=spark.createDataFrame([], DOCS)) == []
    same = documents(spark, ["t"]).unionAll(documents(spark, ["t"])).unionAll(documents(spark, ["t"]))
    assert len({(r["shard"], r["slot"]) for r in sharding.shard_documents(same).collect()}) == 3
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 4, DOCS)
    assert len(sharding.shard_documents(nulls).collect()) == 4


def test_target_bytes(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("a"))
    out = sharding.kd_shard(df, "id", F.lit(10), [F.col("a"), F.col("id")], F.lit(0), target_bytes=1000)
    sizes = [r["w"] for r in out.groupBy("shard").agg(F.sum("size").alias("w")).collect()]
    assert sum(sizes) == 10_000 and max(sizes) <= 1250


@pytest.mark.parametrize("n", [1, 3, 6, 8, 11])
def test_any_number_of_shards(spark, n):
    """Rows that repeat, all of them here, are spread over all shards, of which there may be any number."""
    same = documents(spark, ["t"]).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(1_000)))).drop("k")
    rows = sharding.shard_documents(same, n).groupBy("shard").count().collect()
    assert sorted(r["shard"] for r in rows) == list(range(n)) and max(r["count"] for r in rows) - min(r["count"] for r in rows) <= 0.05 * 1_000


def plain_tree(rows, share):
    """Shards of rows (keys, size, name) by exact weighted medians of the widest dimension, left to right."""
    if share == 1 or not rows:
        return [rows]
    dims = range(len(rows[0][0]))
    extent = lambda i: (max(r[0][i] for r in rows), min(r[0][i] for r in rows))
    dim = max(dims, key=lambda i: ((extent(i)[0] >> 32) - (extent(i)[1] >> 32), extent(i)[0] - extent(i)[1], -i))
    half, below = sum(r[1] for r in rows) * (share // 2) / share, 0
    ordered = sorted(rows, key=lambda r: r[0][dim])
    for k, r in enumerate(ordered):
        if below + r[1] >= half or k == len(ordered) - 1:
            n = k + 1 if abs(below + r[1] - half) <= abs(half - below) else k
            break
        below += r[1]
    n = min(max(n, 1), len(ordered) - 1)
    return plain_tree(ordered[:n], share // 2) + plain_tree(ordered[n:], share - share // 2)


@pytest.mark.parametrize("n", [5, 8])
def test_cuts_of_a_plain_tree(spark, monkeypatch, n):
    monkeypatch.setattr(sharding, "TOLERANCE", 0.0)
    rnd = random.Random(4)
    a, b = rnd.sample(range(1_000_000), 300), rnd.sample(range(50_000), 300)
    data = [(i, a[i], b[i], rnd.randrange(1, 900)) for i in range(300)]
    out = sharding.kd_shard(spark.createDataFrame(data, "id long, a long, b long, s long"), "id", F.col("s"), [F.col("a"), F.col("b")], F.lit(0), n_shards=n)
    place = lambda v, vs: int((v - min(vs)) / (max(vs) - min(vs)) * ((1 << 30) - 1)) << 32
    want = plain_tree([((place(x, a), place(y, b)), s, i) for i, x, y, s in data], n)
    got = collections.defaultdict(set)
    for r in out.collect():
        got[r["shard"]].add(r["id"])
    assert [got[k] for k in range(n)] == [{r[2] for r in rows} for rows in want]


# personal data
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def confirmed(kind, span):
    digits = [int(c) for c in span if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in span.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits[::-1])) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text or "") if confirmed(k, m[0])]


def test_base_spans(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("a@1 .-+()0123456789%_b.@4111 é😀\n") for _ in range(rnd.randrange(120))) for _ in range(1500)]
    texts += [*odd_texts(), "a@b.c_x@d.e", "4111-1111-1111-1111 and 4111 1111 1111 1112", "1.2.3.4.5.6.7.8.9 256.1.1.1 0001.2.3.004", "+1 (415) 555-2671 +12-", "1 " * 400, "1." * 400, "a@b.c " * 700]
    rows = pii.digest(clashing(documents(spark, texts))).collect()
    for r in rows:
        spans = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest(), texts[r["doc_id"]]
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(s.startswith(k) for s in spans) for k in PLAIN)
        assert [s for s in r["spans"].split(",") if s.split(":")[0] in PLAIN] == spans
    assert pii.digest(spark.createDataFrame([], DOCS)).count() == 0


def test_checksums_and_context(spark):
    texts = ["DE89 3704 0044 0532 0130 00", "DE88 3704 0044 0532 0130 00", "my ssn is 123-45-6789", "code 123-45-6789 here", "ssn 000-45-6789"]
    assert [r["spans"] for r in pii.digest(documents(spark, texts)).orderBy("doc_id").collect()] == ["iban:0:27", "", "ssn:10:21", "", ""]


def test_secrets_need_context_and_mixed_signs(spark):
    value = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [f'x token = "{value}" y', f"see commit {value}", f"password: {'a' * 40}", f"token {value[:19]}", f"API_KEY={value}, ip 1.2.3.4", f"token = {value} {value}"]
    spans = [r["spans"] for r in pii.digest(documents(spark, texts)).orderBy("doc_id").collect()]
    assert spans == ["secret:11:51", "", "", "", "ip:53:60,secret:8:48", "secret:8:48"]  # the second of the last is out of the word's reach
    assert documents(spark, texts[:1]).select(pii.redact(F.col("text"))).first()[0] == 'x token = "[SECRET]" y'


def test_redaction(spark):
    texts = [None, "", "nothing here", "mail a@b.org now", "é a@1.2.3.4 x", "+1 (415) 555-2671, 4111 1111 1111 1111."]
    out = [r[0] for r in documents(spark, texts).orderBy("doc_id").select(pii.redact(F.col("text"))).collect()]
    assert out == [None, "", "nothing here", "mail [EMAIL] now", "é [EMAIL] x", "[PHONE], [CARD]."]


# chat formatting
TURNS = "conv_id long, turn long, role string, text string"


def test_conversations_read_back(spark):
    hostile = ["\\", "#", "###", "</turn>", "\\### Assistant: </turn> ok", "<image>", ": ", "a\nb", "", None, "é😀", "\\\\<"]
    rnd = random.Random(5)
    data = [(c, t, rnd.choice(["user", "assistant", "system", "we:ird#<role"]), rnd.choice(hostile)) for c in range(40) for t in range(rnd.randrange(1, 7))]
    rows = {r["conv_id"]: r for r in chat.digest(clashing(spark.createDataFrame(data, TURNS))).collect()}
    data += [(-7, 0, "user", hostile[4]), (-7, 1, "assistant", hostile[4])]
    assert set(rows) == {d[0] for d in data}
    for c, r in rows.items():
        own = [(role, text or "") for k, _, role, text in data if k == c]
        loss = "".join(t for role, t in own if role == "assistant")
        assert r["n_turns"] == len(own) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_odd_conversations(spark):
    assert [r["conv_id"] for r in chat.digest(spark.createDataFrame([], TURNS)).collect()] == [-7]
    rows = spark.createDataFrame([(None, None, None, None), (None, None, None, None), (1, 0, "user", "x" * 50_000), (1, 0, "user", "x" * 50_000)], TURNS)
    assert {r["conv_id"]: r["n_turns"] for r in chat.digest(rows).collect()} == {None: 2, 1: 2, -7: 2}


def test_attachments(spark):
    parts = "array<struct<type:string,text:string,uri:string,units:int>>"
    data = [(1, 0, "user", [("text", "see <image>", None, None), ("image", None, "u1", 2), ("audio", None, "u2", 10), ("odd", "t", None, None)]), (1, 1, "assistant", [("document", None, "u3", None), ("text", "ok", None, None)]), (1, 2, "user", None), (1, 3, "user", [])]
    out = chat.format_conversations(spark.createDataFrame(data, f"conv_id long, turn long, role string, parts {parts}"), F.col("parts")).first()
    assert out["formatted"] == "### user: see \\<image><image><audio>t</turn>\n### assistant: <document>ok</turn>\n### user: </turn>\n### user: </turn>\n"
    assert [(a["turn"], a["type"], a["uri"], a["tokens"]) for a in out["attachments"]] == [(0, "image", "u1", 512), (0, "audio", "u2", 250), (1, "document", "u3", 512)]
    assert out["expanded_tokens"] == 1274
    odd = spark.createDataFrame([(1, 0, "user", [("video", None, "u9", 2), ("text", "<file>", None, None)])], f"conv_id long, turn long, role string, parts {parts}")
    kept = chat.format_conversations(odd, F.col("parts"))
    assert kept.first()["formatted"] == "### user: <file>\\<file></turn>\n" and [(a["type"], a["uri"], a["tokens"]) for a in kept.first()["attachments"]] == [("video", "u9", 512)]
    (m,) = out["mask"]
    assert out["formatted"][m["start"] : m["start"] + m["length"]] == "<document>ok"


# quality rules
def base_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, covered = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n


def test_quality_numbers(spark):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("a b c dd e# f|g \n <h> ü\t \x0b \xa0x".split(" ")) for _ in range(rnd.randrange(200))) for _ in range(300)] + odd_texts()
    rows = quality.digest(clashing(documents(spark, texts))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base_quality(texts[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])
    assert quality.digest(spark.createDataFrame([], DOCS)).count() == 0


def test_lines_and_documents(spark):
    prose = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) + "." for i in range(8))
    menu = "Home | About | Contact\n"
    texts = [prose, menu + prose + "\nAll rights reserved.", "$$$%%% &&&*** ### |||\n" * 40 + prose, "\n".join("##".join(f"a{i}b{j}" for j in range(9)) + " z" for i in range(60))]
    rows = quality.measure(documents(spark, texts)).orderBy("doc_id").collect()
    assert [r["kept"] for r in rows] == [True, True, False, False]
    assert rows[0]["cleaned"] == rows[1]["cleaned"] == prose
    cleaned = quality.clean(clashing(documents(spark, texts))).orderBy("doc_id")
    assert [r["n_chars"] for r in cleaned.collect()] == [len(prose)] * 2 and cleaned.columns == clashing(documents(spark, texts)).columns


def line_fails(line):
    """The rules of a line in plain Python."""
    space = "[\\x20\\x09-\\x0D]+"
    solid = re.sub(space, "", line)
    symbols = len(re.sub(r"[^#*$%&|<>{}\\\\~^=_!]+", "", solid))
    parts = re.split(r"\||»|›|>|·|•", line)
    words = [w for w in re.split(space, line) if w]
    entries, rest = sorted(quality.MENU, key=len, reverse=True), line.lower().strip()
    count = 0
    while rest and (hit := next((m for m in entries if rest == m or re.match(re.escape(m) + space, rest)), None)):
        rest, count = re.sub("^" + space, "", rest[len(hit) :]), count + 1
    return (
        symbols > 3 and symbols > 0.15 * len(solid)
        or re.search(r"(?:\.\.\.|…)\]?\s*$", line) is not None
        or len(parts) >= 3 and len(words) <= 3 * len(parts) + len(parts) - 1
        or not rest and count >= 2
        or any(re.search(r"(?<![a-zß-ÿ])" + re.escape(p), line.lower()) for p in quality.BOILERPLATE)
    )


def test_verdict_and_cleaned_text(spark):
    rnd = random.Random(6)
    clean = lambda: " ".join(f"w{rnd.randrange(9_999)}" for _ in range(rnd.randrange(4, 30))) + rnd.choice([".", "", "?"])
    bad = ["Home | About | Contact", "All rights reserved.", "Alle Rechte vorbehalten", "Abonnieren Sie unseren Brief", "Tous droits réservés", "Todos los derechos reservados", "$$$ %%% ### a", "read on in the next part ...", "and so on…", "Home About Contact", "Startseite Kontakt Impressum", "Accueil » Aide » Recherche", "long " * 80 + "privacy policy " + "text " * 60, ""]
    texts = ["\n".join(rnd.choice(bad) if rnd.random() < share else clean() for _ in range(rnd.randrange(1, 40))) for share in (0, 0.1, 0.5, 0.9) for _ in range(60)] + ["about time we met\n" + clean(), "home alone\n" + "next of kin"]
    rows = quality.measure(documents(spark, texts)).collect()
    for r in rows:
        text = texts[r["doc_id"]]
        left = [x for x in text.split("\n") if not line_fails(x)]
        chars = lambda t: sum(map(len, t.split()))
        lost = chars(text) - chars("\n".join(left))
        assert r["cleaned"] == "\n".join(left), [x for x in text.split("\n") if (x in left) != (x in r["cleaned"].split("\n"))]
        assert r["kept"] == (not r["base_failed"] and lost <= 0.5 * chars(text))
    assert {r["kept"] for r in rows} == {True, False}


@pytest.mark.parametrize("operator", [sharding.shard_documents, pii.digest, quality.digest, lambda df: chat.digest(df.selectExpr("doc_id AS conv_id", "n_chars AS turn", "'user' AS role", "text"))])
def test_no_python_in_native_plans(spark, operator):
    plan = operator(documents(spark, ["a", "b"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
