"""Main text of web pages by wrappers: union-free regular expressions inferred from pages of one host.

A page is a stream of blocks of text, each named by the path of its open elements. Streams of a host are aligned one after
another: equal paths match, a stretch that only one side has becomes an optional group ``( )?``, and a stretch that
repeats itself becomes a repeated group ``( )+``. The outcome is a wrapper whose leaves are the places of a host's
texts. A leaf counts its blocks, their characters, those inside of links, and the blocks that begin with a copyright sign.
Streams are folded to their groups first, so a host has few different ones however many pages it has; equal streams are
added up before they meet, and the different ones are aligned in shares, round by round.

A leaf whose text is the same in most different pages of the host, two at least, is a literal there; any other leaf is
a slot. Pages that agree in all text outside of noise are one page here, so copies fix nothing.

Extraction matches a page's stream with its host's wrapper, which gives every block a leaf, and returns the blocks in
content slots. A leaf is content by its wrapper: inside of ``article`` or ``main`` if there is no noise between, and
elsewhere if no element marks it as noise, most of its characters are no links, and most of its blocks begin
with no copyright sign. A page with leaves of the first sort takes only those. A literal is no content, unless
it is a heading of the first rank or one of a repeated group inside of ``article`` or ``main``.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvstrata.llm.common import materialize, release, ship

#: Different streams of one host that are aligned in one task, about.
SHARE = 64
#: Blocks of a repeated group at most; longer stretches that repeat themselves stay as they are.
GROUP = 256
#: Streams are aligned by a longest common subsequence up to so many pairs of items, and beyond by what is unique in both.
EXACT = 1 << 16
#: Wrappers are broadcast up to so many bytes of them, and joined beyond.
BROADCAST_BYTES = 16 << 20
#: Elements whose text is never content.
SKIPPED = frozenset("aside button dialog footer form head header iframe input label menu nav noscript option script select style svg template textarea".split())
#: Elements whose content is no markup.
_RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe"))
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that end a block of text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Whole classes, ids and roles that mark an element as no content.
_NOISE = re.compile(r"ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|header|menu|modal|nav\w*|newsletter|notice|popup|promo\w*|related|share|sharing|side-?bar|social|sponsor\w*|subscribe|widget", re.I)
#: Elements whose id says what they are for; that of others is mostly made from a heading.
_NAMED = frozenset("div ol table ul".split())
_CONTENT = frozenset(("article", "main"))
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")
#: The beginning of a line that says who owns the page.
_LEGAL = re.compile(r"(?:©|\(c\)\s|copyright\b)", re.I)
#: A leaf outside of content elements is a menu if a larger share of its characters lies in links.
LINKS = 0.6


def tokens(page: str) -> list[tuple[str, str, str]]:
    """The stream of a page: (kind, name, value), where kind is open, close or text; raw elements have no content."""
    out, at, end = [], 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            out.append(("text", "", page[at:]))
            break
        if m.start() > at:
            out.append(("text", "", page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            out.append(("close", name, ""))
            continue
        out.append(("open", name, _marks(name, m[3]) if m[3] else ""))
        if name in _RAW and not m[3].endswith("/"):
            stop = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = stop.end() if stop else end
            out.append(("close", name, ""))
    return out


def _marks(name: str, attributes: str) -> str:
    """Classes, roles and ids of an element; an id counts where it names a purpose."""
    found = [(key.lower(), x or y or z) for key, x, y, z in _ATTRIBUTE.findall(attributes)]
    kept = [value for key, value in found if key in ("class", "role") or key == "id" and (name in _NAMED or value.lower() == "main")]
    return " ".join(" ".join(kept).replace("/", "|").split())


def blocks(page: str) -> list[tuple[str, str, int]]:
    """Blocks of text in page order: (path, text, characters in links), where the path names the open elements and their marks.

    Character references are decoded, white space inside a block is one space, and the ends are trimmed.
    """
    out: list[tuple[str, str, int]] = []
    open_: list[tuple[str, str]] = []
    parts: list[str] = []
    path = where = ""
    linked = links = 0  # open links, characters in links

    def flush() -> None:
        nonlocal links
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append((where, text, min(links, len(text))))
            parts.clear()
        links = 0

    for kind, name, value in tokens(page):
        if kind == "text":
            if not parts:
                where = path
            parts.append(value)
            if linked:
                links += len(value)
            continue
        if name == "br":
            parts.append("\n")
            continue
        if name in BLOCKS or name in SKIPPED:
            flush()
        if kind == "open":
            if name in _VOID:
                continue
            while open_ and name in _CLOSED_BY.get(open_[-1][0], ()):
                open_.pop()
            if name in BLOCKS:  # inline elements left open end with their block
                k = len(open_)
                while k and open_[k - 1][0] not in BLOCKS and open_[k - 1][0] not in SKIPPED:
                    k -= 1
                if k and open_[k - 1][0] in _CLOSED_BY and name in _CLOSED_BY[open_[k - 1][0]]:
                    del open_[k - 1 :]
            mark = name + ("." + value if value else "")
            open_.append((name, mark))
        else:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    del open_[k:]
                    break
        path = "/".join(m for n, m in open_ if n in BLOCKS or n in SKIPPED or n == "title")
        linked = sum(n == "a" for n, _ in open_)
    flush()
    return out


# An item of a stream or wrapper is a leaf [path, payload] or a group ["+" or "?", items]. The payload of a page's
# leaf lists the places of its blocks; that of a wrapper's leaf counts blocks, characters, characters in links, legal lines.


def _key(item: list):
    """What an item is, without payloads."""
    return (item[0], tuple(map(_key, item[1]))) if item[0] in "+?" else item[0]


def _bare(item: list) -> list:
    """The items of a group, or the item itself."""
    return item[1] if item[0] in "+?" else [item]


def _shape(item: list) -> tuple:
    """What two items must share to match: once, perhaps and many are alike."""
    return tuple(map(_key, _bare(item)))


def _many(items: list[list]) -> list:
    """One item for items of the same key whose payloads are lists of places."""
    first = items[0]
    if first[0] in "+?":
        return [first[0], [_many(list(x)) for x in zip(*(i[1] for i in items), strict=True)]]
    return [first[0], [p for i in items for p in i[1]]]


def fold(items: list[list]) -> list[list]:
    """A stream with every run of equal neighbouring stretches folded into one repeated group.

    Short stretches go first, and a folded stream is folded again. Every length costs one pass over the stream.
    """
    numbers: dict = {}
    while True:
        before = len(items)
        size = 1
        while size <= min(GROUP, len(items) // 2):
            ids = np.fromiter((numbers.setdefault(_key(x), len(numbers)) for x in items), np.int64, len(items))
            same = ids[:-size] == ids[size:]
            if np.count_nonzero(same) >= size:
                edges = np.flatnonzero(np.diff(np.r_[0, same, 0]))
                runs = [(a, 1 + (b - a) // size) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= size]
                out, at = [], 0
                for a, n in runs:
                    a = max(a, at)
                    out += items[at:a]
                    parts = [items[a + k * size : a + (k + 1) * size] for k in range(n)]
                    if len(parts[-1]) < size or any(list(map(_key, x)) != list(map(_key, parts[0])) for x in parts[1:]):
                        at = a
                        continue
                    body = [_many(list(x)) for x in zip(*parts, strict=True)]
                    out.append(body[0] if size == 1 and body[0][0] == "+" else ["+", body])
                    at = a + n * size
                items = out + items[at:]
            size += 1
        if len(items) == before:
            return items


def stream(found: list[tuple[str, str, int]]) -> list[list]:
    """The folded stream of a page's blocks, by their paths; leaves hold the places of their blocks."""
    return fold([[path or "-", [i]] for i, (path, _, _) in enumerate(found)])


def leaves(items: list[list]) -> Iterator[list]:
    """The leaves of a stream or wrapper in order."""
    for item in items:
        if item[0] in "+?":
            yield from leaves(item[1])
        else:
            yield item


def counted(found: list[tuple[str, str, int]], places: list[int]) -> list[int]:
    """What a leaf counts of the blocks at these places."""
    own = [found[i] for i in places]
    return [len(own), sum(len(text) for _, text, _ in own), sum(links for _, _, links in own), sum(_LEGAL.match(text) is not None for _, text, _ in own)]


def _subsequence(a: list, b: list) -> list[tuple[int, int]]:
    """The longest common subsequence of two lists, as pairs of places."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i] == b[j] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _anchors(a: list, b: list) -> list[tuple[int, int]]:
    """Places of what is unique in both lists, in the longest rising order."""
    once = Counter(a), Counter(b)
    at = {x: j for j, x in enumerate(b) if once[1][x] == 1}
    pairs = [(i, at[x]) for i, x in enumerate(a) if once[0][x] == 1 and x in at]
    ends: list[int] = []
    back: list[int | None] = []
    heads: list[int] = []
    for k, (_, j) in enumerate(pairs):
        place = bisect_left(ends, j)
        back.append(heads[place - 1] if place else None)
        ends[place : place + 1], heads[place : place + 1] = [j], [k]
    out, k = [], heads[-1] if heads else None
    while k is not None:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def pairs(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a common subsequence: the longest one within EXACT, beyond that one through what is unique in both."""
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        i, n, j, m = work.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if i == n or j == m:
            continue
        if (n - i) * (m - j) <= EXACT:
            out += [(i + x, j + y) for x, y in _subsequence(a[i:n], b[j:m])]
            continue
        found = [(i + x, j + y) for x, y in _anchors(a[i:n], b[j:m])]
        if not found:  # what comes next in both, from the left
            following: dict = {}
            for y in range(m - 1, j - 1, -1):
                following.setdefault(b[y], []).append(y)
            at = j
            for x in range(i, n):
                later = following.get(a[x], [])
                while later and later[-1] < at:
                    later.pop()
                if later:
                    at = later.pop() + 1
                    out.append((x, at - 1))
            continue
        out += found
        for (x, y), (u, v) in zip([(i - 1, j - 1), *found], [*found, (n, m)], strict=True):
            work.append((x + 1, u, y + 1, v))
    return sorted(out)


def embed(own: list, wrapper: list) -> list[tuple[int, int]]:
    """Places of a stream's items in the wrapper of its host, which has them all in this order."""
    if len(own) * len(wrapper) <= EXACT:
        return pairs(own, wrapper)
    out, at = [], 0
    for i, x in enumerate(own):
        while at < len(wrapper) and wrapper[at] != x:
            at += 1
        if at == len(wrapper):
            return pairs(own, wrapper)
        out.append((i, at))
        at += 1
    return out


def _join(a: list, b: list) -> list:
    """One item that stands for both: counts are added, once and many become many."""
    if a[0] not in "+?" and b[0] not in "+?":
        return [a[0], [x + y for x, y in zip(a[1], b[1], strict=True)]]
    body = [_join(x, y) for x, y in zip(_bare(a), _bare(b), strict=True)]
    return ["+" if "+" in (a[0], b[0]) else "?", body]


def align(a: list[list], b: list[list]) -> list[list]:
    """The wrapper that covers both: matched items joined, the rest optional."""
    out, i, j = [], 0, 0
    for x, y in [*pairs(list(map(_shape, a)), list(map(_shape, b))), (len(a), len(b))]:
        for part in (a[i:x], b[j:y]):
            out += [p if p[0] in "+?" else ["?", [p]] for p in part]
        if x < len(a):
            out.append(_join(a[x], b[y]))
        i, j = x + 1, y + 1
    return out


def infer(streams: Iterator[list[list]]) -> list[list]:
    wrapper: list[list] | None = None
    for s in streams:
        wrapper = s if wrapper is None else align(wrapper, s)
    return wrapper or []


@lru_cache(1 << 14)
def _role(path: str, spared: frozenset[str] = frozenset()) -> str:
    """Whether a path lies in content, in something that is never content, or in neither. The marks of ``spared`` prefixes don't count."""
    role, prefix = "open", ""
    for step in path.split("/"):
        name, _, marks = step.partition(".")
        prefix += "/" + step
        if name in _CONTENT or marks.lower() == "main":
            role = "content"
        elif name in SKIPPED or name == "title" or prefix not in spared and _marked(marks):
            return "noise"
    return role


def _marked(marks: str) -> bool:
    return any(_NOISE.fullmatch(x) for x in marks.split())


def _spared(found: list[tuple[str, int]]) -> frozenset[str]:
    """The prefixes of paths (with characters) that hold most of a host's text and so are no noise, whatever they are called."""
    own: Counter = Counter()
    for path, size in found:
        steps = path.split("/")
        if not any(x.partition(".")[0] in SKIPPED for x in steps):
            own.update({"/" + "/".join(steps[: k + 1]): size for k in range(len(steps))})
    most = max(own.values(), default=0)
    return frozenset(p for p, n in own.items() if 2 * n > most)


def mark(*parts: str) -> int:
    """A 64-bit hash of strings, the same in every process."""
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def texts(found: list[tuple[str, str, int]]) -> list[int]:
    """What a page says outside of noise: the hashes of path and text, in page order."""
    return [mark(path, text) for path, text, _ in found if _role(path) != "noise"]


class Place(NamedTuple):
    """A leaf of a wrapper: content (inside of a content element), open or noise; in a repeated group or not; a first heading or not."""

    role: str
    repeated: bool
    title: bool


@lru_cache(1024)
def ready(wrapper: str) -> tuple[list[tuple], list[list[Place]]]:
    """The shapes of a wrapper's items, and the places of each item's leaves. Where all would be noise, most of the text is not."""
    items = json.loads(wrapper)
    every = [(path, counts[1]) for path, counts in leaves(items)]
    spared = frozenset() if any(_role(path) != "noise" for path, _ in every) else _spared(every)

    def place(item: list, repeated: bool) -> Iterator[Place]:
        if item[0] in "+?":
            for x in item[1]:
                yield from place(x, repeated or item[0] == "+")
            return
        path, (n, size, links, legal) = item
        role, last = _role(path, spared), path.rsplit("/", 1)[-1].partition(".")[0]
        heading = len(last) == 2 and last[0] == "h"
        if role == "open" and (2 * legal > n or links > LINKS * size and not heading):
            role = "noise"
        yield Place(role, repeated, last == "h1")

    return list(map(_shape, items)), [list(place(x, False)) for x in items]


def match(found: list[tuple[str, str, int]], wrapper: str) -> list[Place | None]:
    """The leaf of each block of a page in the wrapper (JSON) of its host; None where the wrapper has no place for it."""
    shapes, places = ready(wrapper)
    own = stream(found)
    out: list[Place | None] = [None] * len(found)
    for x, y in embed(list(map(_shape, own)), shapes):
        for leaf, to in zip(leaves([own[x]]), places[y], strict=True):
            for i in leaf[1]:
                out[i] = to
    return out


def extract(found: list[tuple[str, str, int]], wrapper: str, fixed: frozenset[int]) -> str:
    """The main text of a page's blocks: those in content slots. ``fixed`` holds the hashes of its host's literals."""
    placed = match(found, wrapper)
    region = "content" if any(p is not None and p.role == "content" for p in placed) else "open"
    out = []
    for (path, text, _), p in zip(found, placed, strict=True):
        if p is None or p.role != region:
            continue
        if fixed and mark(path, text) in fixed and not (region == "content" and (p.repeated or p.title)):
            continue
        out.append(text)
    return "\n".join(out)


def host(url: Column) -> Column:
    """The host of a URL, lower case, without user and port; empty if it has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON) and fixed (hashes of the host's literals) for every host of pages (url, html)."""
    ship(pages.sparkSession)

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # equal streams of a host within a batch are one row for each of their leaves
            seen: dict[tuple[str, str], list] = {}
            said: dict[tuple[str, int], list[int]] = {}
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = blocks(page or "")
                s = stream(found)
                counts = np.array([counted(found, leaf[1]) for leaf in leaves(s)], np.int64).reshape(-1, 4)
                key = h, json.dumps([_plain(x) for x in s])
                known = seen.setdefault(key, [0, np.zeros_like(counts)])
                known[0] += 1
                known[1] += counts
                own = texts(found)
                if own:
                    said[h, mark(*map(str, own))] = sorted(set(own))
            rows = [(h, mark(s), k, s if k == 0 else None, n, *c, None, None) for (h, s), (n, counts) in seen.items() for k, c in enumerate(counts.tolist() or [[0] * 4])]
            rows += [(h, *[None] * 8, page, own) for (h, page), own in said.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(_ROW)], names=[n for n, _ in _ROW])

    rows = materialize(pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(streams, "host string, sid long, leaf int, stream string, n long, blocks long, chars long, links long, legal long, page long, texts array<long>"), "streams")
    by_leaf = rows.filter(F.col("sid").isNotNull()).groupBy("host", "sid", "leaf").agg(F.max("stream").alias("stream"), *[F.sum(c).alias(c) for c in ("n", *_COUNTS)])
    # at most as many entries as a stream has leaves
    each = by_leaf.groupBy("host", "sid").agg(F.max("stream").alias("stream"), F.max("n").alias("n"), F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("leaf", *_COUNTS))), lambda x: F.array(*[x[c] for c in _COUNTS]))).alias("counts"))

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        # most pages first, so that what is common shapes the wrapper
        frame = frame.sort_values(["n", "sid"], ascending=[False, True])
        wrapper = infer(_filled(json.loads(s), None if c is None else json.loads(c)) for s, c in zip(frame["stream"], frame["counts"], strict=True))
        return pd.DataFrame({"host": frame["host"].iloc[:1].to_numpy(), "sid": [int(frame["sid"].min())], "stream": [json.dumps(wrapper)], "n": [int(frame["n"].sum())], "counts": [None]})

    each = materialize(each, "each")
    while True:
        per = each.groupBy("host").agg(F.count(F.lit(1)).alias("different"))
        most = per.agg(F.max("different")).first()[0] or 0
        if most <= SHARE:
            merged = each.groupBy("host").applyInPandas(merge, each.schema)
            break
        share = F.pmod(F.xxhash64("sid"), F.ceil(F.col("different") / SHARE))
        dealt = each.join(per, "host").withColumn("share", share).drop("different")
        rest = materialize(dealt.groupBy("host", "share").applyInPandas(lambda f: merge(f), each.schema), "each")
        release(each)
        each = rest
    different = rows.filter(F.col("page").isNotNull()).select("host", "page", "texts").dropDuplicates(["host", "page"])
    # a page is the text null here, so one aggregation counts both the pages and the texts of a host
    counts = different.select("host", F.explode(F.concat("texts", F.array(F.lit(None).cast("long")))).alias("text")).groupBy("host", "text").agg(F.count(F.lit(1)).alias("n"))
    total = counts.filter(F.col("text").isNull()).select("host", F.col("n").alias("pages"))
    often = counts.filter(F.col("text").isNotNull() & (F.col("n") >= 2)).join(total, "host").filter(F.col("n") * 2 > F.col("pages"))
    fixed = often.groupBy("host").agg(F.sort_array(F.collect_list("text")).alias("fixed"))
    return merged.join(fixed, "host", "left").select("host", F.col("stream").alias("wrapper"), "fixed")


_COUNTS = ("blocks", "chars", "links", "legal")
_ROW = [("host", pa.string()), ("sid", pa.int64()), ("leaf", pa.int32()), ("stream", pa.string()), ("n", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("page", pa.int64()), ("texts", pa.list_(pa.int64()))]


def _plain(item: list) -> list:
    return [item[0], list(map(_plain, item[1]))] if item[0] in "+?" else [item[0], 0]


def _filled(items: list[list], counts: list[list[int]] | None) -> list[list]:
    """A stream with its leaves' counts, given in order; a wrapper has them already."""
    if counts is not None:
        for leaf, own in zip(leaves(items), counts, strict=False):
            leaf[1] = own
    return items


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page.

    A null or empty page, and one without content, has an empty text. A null URL belongs to the host "". Repeated rows
    stay repeated, equal pages get equal texts, and an empty table gives an empty one. Very long pages are taken whole:
    the cost of folding and matching grows in proportion to their blocks. Other columns of the table are not looked at.
    """
    rows = pages.select("page_id", "url", "html")
    found = materialize(wrappers(rows), "wrappers")
    size = found.agg(F.sum(F.length("wrapper") + 8 * F.coalesce(F.size("fixed"), F.lit(0)) + 64)).first()[0] or 0
    found = found.select(F.col("host").alias("w_host"), "wrapper", "fixed")
    keyed = rows.withColumn("host", host(F.col("url")))
    joined = keyed.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, F.col("host") == F.col("w_host"), "left").select("page_id", "url", "html", "wrapper", "fixed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(k).to_pylist() for k in (2, 3, 4))
            out = [extract(blocks(page or ""), wrapper or "[]", frozenset(fixed or ())) for page, wrapper, fixed in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
