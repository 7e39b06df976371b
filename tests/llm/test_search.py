"""Neighbours, near duplicates, page text and the pipeline against brute force."""

import collections
import html
import json
import os
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kvstrata.llm import ann, html_wrappers, near_dup

SF = "/root/testdata/sf0.001"
VECS = "vec_id long, embedding array<float>, label int, id string, vec string, score string"


# neighbours
def exact(vectors, k):
    out = {}
    for q, x in vectors.items():
        if q % 20 == 0:
            scored = sorted(((-float(np.dot(x, y)), i) for i, y in vectors.items() if i != q))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def found(df):
    out = collections.defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "", "", "") for i, v in rows], VECS)


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    vectors = {i: v for i, v in enumerate((rng.normal(size=(3_000, 16)) * rng.uniform(0.5, 2, size=(3_000, 1))).astype(np.float32).astype(float))}
    got, want = found(ann.neighbours(frame(spark, vectors.items()))), exact(vectors, 20)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    assert all(s == pytest.approx(float(np.dot(vectors[q], vectors[i])), abs=1e-12) for q, rows in got.items() for i, s in rows)


def test_one_common_vector(spark):
    rng = np.random.default_rng(2)
    vectors = {i: (np.ones(8) if i % 3 == 0 else rng.normal(size=8).round(3)) for i in range(900)}
    vectors = {i: v.astype(np.float32).astype(float) for i, v in vectors.items()}
    got, want = found(ann.neighbours(frame(spark, vectors.items()))), exact(vectors, 20)
    for q in want:
        assert [round(s, 9) for _, s in got[q]] == [round(s, 9) for _, s in want[q]]
        if q % 3 == 0:
            assert [i for i, _ in got[q]] == [i for i, _ in want[q]]


def test_vectors_without_part(spark):
    rows = [(0, [1, 0]), (1, [0.5, 0.5]), (2, None), (3, [0, 0]), (4, [None, 1]), (5, [float("nan"), 1]), (6, [float("inf"), 1]), (7, [2, 0]), (20, [1, 1]), (None, [1, 2]), (8, [])]
    got = found(ann.neighbours(frame(spark, rows)))
    assert got == {0: [(7, 2.0), (20, 1.0), (1, 0.5)], 20: [(7, 2.0), (0, 1.0), (1, 1.0)]}
    assert ann.neighbours(frame(spark, [])).count() == 0
    assert ann.neighbours(frame(spark, [(0, [0, 0])])).count() == 0
    assert ann.neighbours(frame(spark, [(0, [1, 0])])).count() == 0


def test_every_length_is_answered(spark):
    """Vectors meet those of their own length, however few they are."""
    rng = np.random.default_rng(5)
    of = lambda n, d, at: {at + i: v for i, v in enumerate(rng.normal(size=(n, d)).astype(np.float32).astype(float))}
    groups = [of(400, 8, 0), of(41, 3, 1_000), of(25, 12, 2_000), of(1, 5, 3_000)]
    got = found(ann.neighbours(frame(spark, [x for g in groups for x in g.items()])))
    want = {q: rows for g in groups for q, rows in exact(g, 20).items() if rows}
    assert set(got) == set(want) and all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in want if q >= 1_000)


def test_repeated_rows_are_rows(spark):
    rows = [(0, [1, 0]), (1, [3, 0]), (1, [3, 0]), (1, [2, 0]), (0, [9, 9])]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.neighbours(frame(spark, rows)).collect())
    first, second = [(0, r, 1, s) for r, s in enumerate([3.0, 3.0, 2.0], 1)], [(0, r, 1, s) for r, s in enumerate([27.0, 27.0, 18.0], 1)]
    assert got == sorted(first + second)
    assert len(ann.neighbours(frame(spark, [(0, [1, 0])] + [(1, [1, 0])] * 30 + [(2, [1, 0])] * 30)).collect()) == 20


def test_recall_at_ten_thousand(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(10_000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(float)
    got = found(ann.neighbours(frame(spark, list(enumerate(x)))))
    best = np.argsort(-(x[::20] @ x.T), axis=1)[:, :21]
    hits = sum(len({i for i, _ in got[q * 20]} & ({*row.tolist()} - {q * 20})) for q, row in enumerate(best))
    assert hits >= 0.95 * 20 * 500


def test_exact_search_is_its_sql(spark, tmp_path):
    """Vectors that the codes tell apart badly, copies with ties, and rows that repeat a vec_id."""
    import duckdb

    from kvstrata.llm import queries

    rng = np.random.default_rng(9)
    x = rng.normal(size=(2_500, 200))
    x[1_000:1_040] = x[0]
    rows = [(i, v) for i, v in enumerate(x)] + [(20, x[7]), (33, x[33])]
    frame(spark, rows).select("vec_id", "embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [tuple(r) for r in queries.queries()["search_exact"](spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(got) == sorted(db.execute(queries.oracle_sql()["search_exact"]).fetchall())


def test_more_neighbours_than_the_shortlist(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHORTLIST", 2)
    rows = [(i, [1.0, i / 100]) for i in range(60)]
    assert [i for i, _ in found(ann.neighbours(frame(spark, rows), k=50))[20]] == [i for i in range(59, 8, -1) if i != 20][:50]


def test_codewords_are_fitted_together():
    rng = np.random.default_rng(8)
    x, codes = rng.normal(size=(300, 5)), rng.integers(0, 4, size=(300, 3))
    books = ann.fit(x, codes, np.zeros((3, 4, 5)), 60)
    hot = np.concatenate([np.eye(4)[codes[:, j]] for j in range(3)], axis=1)
    best = hot @ np.linalg.lstsq(hot, x, rcond=None)[0]
    assert np.allclose(sum(books[j][codes[:, j]] for j in range(3)), best, atol=1e-6)


def test_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = {i: v for i, v in enumerate(rng.normal(size=(600, 4)).astype(np.float32).astype(float))}
    whole = found(ann.neighbours(frame(spark, vectors.items())))
    monkeypatch.setattr(ann, "QUERIES", 7)
    monkeypatch.setattr(ann, "SLICE", 50)
    parts = found(ann.neighbours(frame(spark, vectors.items())))
    assert {q: [i for i, _ in r] for q, r in parts.items()} == {q: [i for i, _ in r] for q, r in whole.items()}


def test_beam_is_no_worse_than_greedy():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 8))
    books = ann.train(x, books=3, words=16, rounds=1)
    error = lambda codes: sum(((x - sum(books[j][codes[:, j]] for j in range(3))) ** 2).sum(1))
    assert error(ann.encode(x, books, 8)) <= error(ann.encode(x, books, 1)) < (x**2).sum()


# near duplicates
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def weights(text):
    w = (text or "").split()
    if len(w) < 5:
        return collections.Counter([tuple(w)] if w else [])
    return collections.Counter(zip(*[w[k:] for k in range(5)], strict=False))


def probability_jaccard(x, y):
    return sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys())


def classes(texts):
    parent = {i: i for i in texts}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = {i: weights(t) for i, t in texts.items()}
    for i in texts:
        for j in texts:
            if i < j and texts[i] is not None and texts[j] is not None and (texts[i] == texts[j] or (sets[i] and sets[j] and probability_jaccard(sets[i], sets[j]) >= 0.8)):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: top(i) for i in texts}


def family(rnd, n, words=80, edits=2):
    base = [f"w{rnd.randrange(3_000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = base.copy()
        for _ in range(rnd.randrange(edits + 1)):
            w[rnd.randrange(words)] = f"e{rnd.randrange(10_000)}"
        out.append(" ".join(w))
    return out


def test_classes(spark):
    rnd = random.Random(8)
    texts = [t for _ in range(12) for t in family(rnd, 6)] + family(rnd, 40, edits=3) + ["x y z", "x y z", "x y", "", "", None, None, "  ", "same words here and there " * 400, "same words here and there " * 401]
    data = dict(enumerate(texts))
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in data.items()], DOCS).withColumns({c: F.lit(1) for c in ("id", "class", "rep", "a", "b")})
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(frame).collect()}
    assert got == classes(data)


def test_odd_documents(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = spark.createDataFrame([(1, "a b c d e f", "en", "s", 1)] * 3 + [(2, "a b c d e f", "de", "t", 1), (None, "a b c d e f", "de", "t", 1), (3, None, None, None, None)], DOCS)
    got = sorted(map(tuple, near_dup.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(1, 1)] * 3 + [(2, 1), (3, 3), (None, None)], key=str)
    kept = near_dup.keep_one(rows.unionAll(rows.filter("doc_id IS NULL")))
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 3, None, None] and kept.columns == rows.columns
    several = spark.createDataFrame([(1, "a b c d e f", "", "", 1), (1, "g h i j k l", "", "", 1), (2, "g h i j k l", "", "", 1), (3, "a b c d e f", "", "", 1), (4, "m n o p q", "", "", 1)], DOCS)
    assert sorted(map(tuple, near_dup.near_duplicates(several).collect())) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]
    assert sorted((r["doc_id"], r["text"]) for r in near_dup.keep_one(several).collect()) == [(1, "a b c d e f"), (1, "g h i j k l"), (4, "m n o p q")]


def test_frequent_keys_and_long_texts(spark, monkeypatch):
    """Copies and buckets of more rows than a task's share are joined apart; very long texts are whole."""
    monkeypatch.setattr(near_dup, "SHARE", 4)
    monkeypatch.setattr(near_dup, "BROADCAST_ROWS", 10)
    rnd = random.Random(10)
    long = " ".join(f"w{rnd.randrange(900)}" for _ in range(60_000))
    texts = ["the hot text of many rows here"] * 60 + family(rnd, 30, edits=1) + [f"alone number {i} x y z {i}" for i in range(20)]
    rnd.shuffle(texts)
    data = dict(enumerate(texts))
    more = {1_000 + i: f"{long} tail {i}" for i in range(3)}
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in (data | more).items()], DOCS)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(frame).collect()}
    assert got == classes(data) | dict.fromkeys(more, 1_000)


def test_intermediate_tables_are_deleted(spark, tmp_path, monkeypatch):
    from kvstrata.llm import common

    monkeypatch.setattr(common, "scratch_dir", lambda _: "file://" + str(tmp_path))
    frame = spark.createDataFrame([(i, t, "", "", 1) for i, t in enumerate(family(random.Random(3), 20) + ["x"] * 5)], DOCS)
    assert len({r["class_id"] for r in near_dup.near_duplicates(frame).collect()}) < 25
    assert {p.name.split("-")[0] for p in (tmp_path / "kvstrata").iterdir()} == {"classed", "smallest"}


def test_sketches_estimate_probability_jaccard():
    rnd = random.Random(9)
    hashes = near_dup.Hashes()
    for _ in range(5):
        words = [f"w{rnd.randrange(60)}" for _ in range(200)]
        other = words[:140] + [f"v{rnd.randrange(60)}" for _ in range(60)]
        pair = [" ".join(words), " ".join(other)]
        doc, item, weight = near_dup.shingles(pair, hashes)
        slots = near_dup.sketch(doc, item, weight, 2, 4_000)
        true = probability_jaccard(*map(weights, pair))
        assert (slots[0] == slots[1]).mean() == pytest.approx(true, abs=0.04)
        cut = np.searchsorted(doc, 1)
        assert near_dup.similarity((item[:cut], weight[:cut]), (item[cut:], weight[cut:])) == pytest.approx(true)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 101)], "a long, b long")
    for most in (near_dup.LINKS, 5):
        got = {r["id"]: r["class"] for r in near_dup.components(links, most).collect()}
        assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# pages
PAGES = "page_id long, url string, html string"


def text_of(spark, pages):
    return {r["page_id"]: r["text"] for r in html_wrappers.main_text(spark.createDataFrame(pages, PAGES).withColumns({c: F.lit("") for c in ("host", "wrapper", "n_pages", "stream")})).collect()}


def page(body, menu="One Two", tail=""):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">{menu}</a></li></ul></nav><!-- x --><div class="ad">Buy</div>{body}<footer>&copy; F</footer>{tail}'


def test_articles(spark):
    pages = [(i, "http://h.org/x", page(f"<article><h1>Title {i} &amp; more</h1><p><b>First {i}<br><p>Second\n  <i>line</i></p><ul><li>a</li><li>b</li></ul><form>no</form><div class='comments'><p>no</p></div></article>")) for i in range(5)]
    pages += [(90, None, None), (91, "", ""), (92, "no host", "plain text"), (93, "http://h.org", page("<main><p>m &lt;x&gt; 😀</p></main>")), (94, "http://h.org/y", "<p>" + "long text " * 5_000), (93, "http://h.org", page("<main><p>m &lt;x&gt; 😀</p></main>"))]
    got = text_of(spark, pages)
    for i in range(5):
        assert got[i] == f"Title {i} & more\nFirst {i}\nSecond line\na\nb"
    assert got[90] == got[91] == "" and got[92] == "plain text" and got[93] == "m <x> 😀" and got[94] == ("long text " * 5_000).strip()
    assert html_wrappers.main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_wrapper_without_article(spark):
    """What all pages of a host share is no content, though no element says so."""
    pages = [(i, f"http://plain.org/{i}", f"<html><body><div id='top'><p>Always the same line</p></div><div id='text'><p>Own words of page number {i}, which go on for a while.</p><p>And more {i}.</p></div></body></html>") for i in range(6)]
    assert text_of(spark, pages) == {i: f"Own words of page number {i}, which go on for a while.\nAnd more {i}." for i in range(6)}


def test_fixed_texts_need_most_different_pages(spark):
    """A block of one page only, the text of copies, and a second region of text stay."""
    body = "<html><body><div id='top'><p>Always the same line</p></div><div id='text'><h1>Title {0}</h1><p>Own words of page number {0}.</p>{1}</div><div id='more'><p>Second region {0}</p></div></body></html>"
    pages = [(i, f"http://plain.org/{i}", body.format(i, "<blockquote>Only here</blockquote>" if i == 2 else "")) for i in range(6)]
    pages += [(10 + i, f"http://copies.org/{i}", "<html><body><h1>Copied title</h1><p>Copied text</p></body></html>") for i in range(4)]
    expected = {i: f"Title {i}\nOwn words of page number {i}." + ("\nOnly here" if i == 2 else "") + f"\nSecond region {i}" for i in range(6)}
    assert text_of(spark, pages) == expected | {10 + i: "Copied title\nCopied text" for i in range(4)}


def test_fixed_text_within_article(spark):
    """Inside of article a line in a place of its own that the host's pages share is no content; texts of a repeated group stay."""
    body = "<article><h1>Title {0}</h1><div class='x'>Read this in our app</div><p>First {0}</p><p>The same for all</p></article>"
    pages = [(i, f"http://host.org/{i}", body.format(i) if i else "<article><h1>Title 0</h1><p>The same for all</p></article>") for i in range(6)]
    assert text_of(spark, pages) == {i: f"Title {i}\n" + (f"First {i}\n" if i else "") + "The same for all" for i in range(6)}


def test_slugs_are_no_noise(spark):
    """An id or class that only contains a telling word, and an attribute that only ends like one, drop nothing; whole classes do."""
    body = "<article class='w-1/2 x'><h2 id='related-work'>A</h2><h2 id='comments'>B</h2><section id='social-policy'><p id='share-prices'>C</p></section><div class='header-compression'>D</div><div data-id='menu'>E</div><div title='a class=menu'>F</div><div class='x share'>no</div><div id=menu>no</div></article>"
    assert text_of(spark, [(1, "http://s.org", body)]) == {1: "A\nB\nC\nD\nE\nF"}


def wrapper_of(found):
    items = html_wrappers.stream(found)
    return html_wrappers._filled(json.loads(json.dumps(list(map(html_wrappers._plain, items)))), [html_wrappers.counted(found, leaf[1]) for leaf in html_wrappers.leaves(items)])


def test_alignment():
    a = wrapper_of([("p", "x", 0), ("div", "same", 0), ("li", "1", 1), ("li", "2", 0), ("li", "3", 0)])
    b = wrapper_of([("div", "same", 0), ("li", "4", 0), ("h1", "© t", 0)])
    assert a == [["p", [1, 1, 0, 0]], ["div", [1, 4, 0, 0]], ["+", [["li", [3, 3, 1, 0]]]]]
    both = [["?", [["p", [1, 1, 0, 0]]]], ["div", [2, 8, 0, 0]], ["+", [["li", [4, 4, 1, 0]]]], ["?", [["h1", [1, 3, 0, 1]]]]]
    assert html_wrappers.align(a, b) == both
    assert html_wrappers.fold([[k, [i]] for i, k in enumerate("ababcaabbaabb")]) == [["+", [["a", [0, 2]], ["b", [1, 3]]]], ["c", [4]], ["+", [["+", [["a", [5, 6, 9, 10]]]], ["+", [["b", [7, 8, 11, 12]]]]]]]
    assert html_wrappers.infer(iter([])) == []


def test_every_stream_has_its_places():
    """A wrapper of any streams has a leaf of the same path for every block of each, by either way of alignment."""
    rnd = random.Random(12)
    for exact in (1 << 16, 0):
        html_wrappers.EXACT = exact
        try:
            for _ in range(60):
                pages = [[(rnd.choice("abcd"), "t", 0) for _ in range(rnd.randrange(14))] for _ in range(5)]
                wrapper = json.dumps(html_wrappers.infer(map(wrapper_of, pages)))
                assert all(p is not None for found in pages for p in html_wrappers.match(found, wrapper))
        finally:
            html_wrappers.EXACT = 1 << 16


def test_pages_without_telling_elements(spark):
    """With all elements that tell what they are renamed, the wrapper alone finds the article: menus are links, owners' lines say so, shared lines are literals."""
    rnd = random.Random(13)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    pages, want = [], {}
    for i in range(12):
        menu = "".join(f"<li><a href='/{word()}'>{word()}</a></li>" for _ in range(rnd.randrange(2, 7)))
        paragraphs = [" ".join(word() for _ in range(30)) for _ in range(rnd.randrange(1, 6))]
        title = f"{word()} {word()}"
        pages.append((i, "http://plain.org/x", f"<html><body class='has-sidebar'><div><ul>{menu}</ul></div><div>Sign in to read more</div><div class='page header-fixed'><h1>{title}</h1>{''.join(f'<p>{p}' for p in paragraphs)}</div><div>&copy; plain.org &middot; {word()} {word()}</div></body></html>"))
        want[i] = "\n".join([title, *paragraphs])
    assert text_of(spark, pages) == want


def test_text_comes_from_the_wrapper():
    """Without a wrapper there is no text, and what the wrapper counts decides which of equal paths are content."""
    found = html_wrappers.blocks("<article><h1>T</h1><p>x</p></article>")
    wrapper = json.dumps(wrapper_of(found))
    assert html_wrappers.extract(found, wrapper, frozenset()) == "T\nx" and html_wrappers.extract(found, "[]", frozenset()) == ""
    found = html_wrappers.blocks("<div>one</div><hr><p>two</p>")
    links = json.dumps([["div", [4, 40, 40, 0]], ["p", [4, 40, 0, 0]]])
    assert html_wrappers.extract(found, links, frozenset()) == "two"


def test_what_holds_the_text_is_no_noise(spark):
    pages = [(i, f"http://n.org/{i}", f"<body class='sidebar'><div class='header'><article><h1>T{i}</h1><p>Text {i}</p></article></div><nav>no</nav></body>") for i in range(3)]
    assert text_of(spark, pages) == {i: f"T{i}\nText {i}" for i in range(3)}


def test_two_pages_like_three(spark):
    """A line that both or all pages of a host share outside of content is a literal; one page alone has none."""
    body = "<div id='top'>Shared line</div><p>Own words {0}</p>"
    for n in (1, 2, 3):
        got = text_of(spark, [(i, "http://few.org/x", body.format(i)) for i in range(n)])
        assert got == {i: ("Shared line\n" if n == 1 else "") + f"Own words {i}" for i in range(n)}


def test_titles_of_near_copies_stay(spark):
    body = "<article><h1>One title</h1><p>{0} words</p></article>"
    assert text_of(spark, [(i, "http://copy.org", body.format(i)) for i in range(2)]) == {i: f"One title\n{i} words" for i in range(2)}


def test_very_long_pages():
    began = time.perf_counter()
    one = html_wrappers.blocks("".join(f"<div id=x{i}><p>t{i}</p></div>" for i in range(20_000)))
    two = html_wrappers.blocks("".join(f"<div id=x{i}><p>t{i}</p></div>" for i in range(20_000) if i % 7) + "".join(f"<ol id=y{i}><p>t{i}</p></ol>" for i in range(10_000)))
    wrapper = json.dumps(html_wrappers.infer([wrapper_of(one), wrapper_of(two)]))
    assert html_wrappers.extract(one, wrapper, frozenset()) == "\n".join(f"t{i}" for i in range(20_000))
    assert len(html_wrappers.extract(two, wrapper, frozenset()).split("\n")) == len(two)
    assert time.perf_counter() - began < 20


def test_a_hot_host_in_many_shares(spark, monkeypatch):
    """A host of many different streams is aligned in rounds; every page keeps its whole article."""
    monkeypatch.setattr(html_wrappers, "SHARE", 3)
    rnd = random.Random(14)
    pages, want = [], {}
    for i in range(60):
        tags = [rnd.choice(["p", "h2", "blockquote", "pre"]) for _ in range(rnd.randrange(1, 7))]
        parts = [f"{i} {k} {rnd.random()}" for k in range(len(tags))]
        pages.append((i, "http://hot.org", "<article>" + "".join(f"<{t}>{x}</{t}>" for t, x in zip(tags, parts, strict=True)) + "</article><footer>no</footer>"))
        want[i] = "\n".join(parts)
    assert text_of(spark, pages) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    rows = html_wrappers.main_text(pages).collect()
    assert len(rows) == len(source)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", source[r["page_id"]], re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


# the pipeline
@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
def test_pipeline(spark):
    import corpus_pipeline
    from kvstrata.llm import pii, quality
    from kvstrata.llm.common import materialize

    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    first = {r["doc_id"]: r["cleaned"] for r in quality.measure(spark.read.parquet(f"{SF}/documents.parquet")).filter("kept").collect()}
    assert seen[0] == first
    top = classes(seen[0])
    assert set(seen[1]) == {i for i, c in top.items() if i == c}
    assert set(seen[2]) == set(seen[1])
    assert pii.digest(docs).filter("n_email + n_ip + n_card + n_phone > 0").count() == 0
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in pieces} == set(seen[2])
    # the ids of the pieces are those of the redacted texts
    from tokenizers import Tokenizer

    from kvstrata.llm.common import tokenizer_path

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    whole = collections.defaultdict(int)
    for r in pieces:
        ids = np.array([*library.encode(seen[2][r["doc_id"]] or "", add_special_tokens=False).ids, 0], "<u4")
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        whole[r["doc_id"]] += r["length"]
    assert all(whole[r["doc_id"]] == r["doc_tokens"] for r in pieces)


def test_pipeline_of_odd_rows(spark):
    """Nulls in every column, repeated rows, empty and long texts, and columns named like those of the operators."""
    import corpus_pipeline

    prose = lambda k: "\n".join(" ".join(f"w{k}x{i}y{j}" for j in range(12)) + "." for i in range(8))
    texts = [None, "", prose(1), prose(1), prose(2) + " a@b.org", "long " + " ".join(f"v{i}" for i in range(50_000))]
    data = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(2, prose(1), None, None, None), (None, prose(3), "en", "s", 1), (None, prose(3), "en", "s", 1)]
    docs = spark.createDataFrame(data, DOCS).withColumns({c: F.lit("z") for c in ("id", "row", "class", "kept", "q_row", "spans", "ident", "h1", "n")})
    columns, seen = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == columns
        seen.append(sorted((r["doc_id"] for r in docs.collect()), key=str))
    assert seen[0] == sorted([2, 2, 3, 4, 5, None, None], key=str) and seen[1] == seen[2] == sorted([2, 4, 5, None, None], key=str)
    assert "[EMAIL]" in docs.filter("doc_id = 4").first()["text"]
    assert sorted({str(r["doc_id"]) for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()}) == ["2", "4", "5", "None"]


def test_pipeline_of_nothing(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
