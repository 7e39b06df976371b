"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust a score.

Native column expressions, no shuffle. Offsets are code points, ends exclusive.

The patterns below match what their plain forms match, leftmost and without overlaps, but start only where a
match can start and never give characters back, so that long runs of letters or digits cost linear time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvstrata.llm.common import let

_LOCAL = r"[A-Za-z0-9._%+-]"
_BLOCK = 256


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: its pattern, a cheap test of the text, the score of a valid span and context words."""

    name: str
    pattern: str
    gate: str
    score: float
    context: str
    base: bool = True


#: A span of a kind that is not ``base`` needs this score.
THRESHOLD = 0.8
#: Context words count within so many characters of a span.
REACH = 48

KINDS = (
    # plain form: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, r"\b(?:e-?mail|contact|write to|address|courriel|correo)\b"),
    # plain form: [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.7, r"\b(?:ip|host|server|address|login|ping)\b"),
    # plain form: [0-9]([\x20-]?[0-9])+ of 13 to 19 digits: whole runs of that many digits
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])", "", 0.8, r"\b(?:card|credit|debit|visa|mastercard|amex|karte|carte|tarjeta)\b"),
    # plain form: \+[0-9][\x20().0-9-]+[0-9]
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, r"\b(?:phone|call|tel|mobile|fax|telefon|t[eé]l[eé]phone|tel[eé]fono)\b"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", "", 0.9, r"\b(?:iban|account|bank|konto|compte|cuenta)\b", base=False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.6, r"\b(?:ssn|social security)\b", base=False),
    Kind("secret", r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+", "", 0.5, r"\b(?:access[ _-]?key|api[ _-]?key|auth|bearer|credentials?|passwd|password|secret|token)\b", base=False),
)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(span: Column) -> Column:
    def total(digits: Column) -> Column:
        def value(i: Column) -> Column:
            d = F.substring(digits, i, F.lit(1)).cast("int")
            return F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

        return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i))

    return let(F.reverse(_digits(span)), total) % 10 == 0


def _mod97(span: Column) -> Column:
    plain = F.regexp_replace(span, " ", "")
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return (F.length(plain) >= 15) & (F.length(plain) <= 34) & (F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1)


def _valid(kind: str, span: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(span, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    if kind == "card":
        return _luhn(span)
    if kind == "phone":
        return F.length(_digits(span)).between(9, 15)
    if kind == "iban":
        return _mod97(span)
    if kind == "ssn":
        return ~span.rlike(r"^(?:000|666|9)|-00-|-0000$")
    if kind == "secret":
        return (F.length(_digits(span)) >= 3) & (F.length(F.regexp_replace(span, "[^A-Za-z]", "")) >= 3)
    return F.lit(True)


def _running(lengths: Column) -> Column:
    """Sums of all earlier elements, in blocks so that the cost stays linear but for one entry per block."""
    grow = lambda start, xs: F.aggregate(xs, F.array(start), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)))

    def from_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
        return let(grow(F.lit(0), totals), lambda starts: F.flatten(F.transform(blocks, lambda b, i: F.slice(grow(F.get(starts, i), b), F.lit(1), F.size(b)))))

    return let(cut, from_blocks)


def _spans(text: Column, kind: Kind) -> Column:
    """The valid spans of one kind: array of struct(kind, start, end, score)."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)
    pieces = F.zip_with(gaps, found, lambda g, s: F.struct(F.length(g).alias("gap"), s.alias("span")))

    def scored(p: Column) -> Column:
        n = F.length(p["span"])
        near = F.concat(F.substring(text, F.greatest(p["start"] - REACH + 1, F.lit(1)), F.least(p["start"], F.lit(REACH))), F.lit(" "), F.substring(text, p["start"] + n + 1, F.lit(REACH)))
        score = F.lit(kind.score) + F.when(near.rlike("(?iu)" + kind.context), 0.3).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), p["start"].alias("start"), (p["start"] + n).alias("end"), F.least(score, F.lit(1.0)).alias("score"))

    def from_pieces(ps: Column) -> Column:
        before = _running(F.transform(ps, lambda p: p["gap"] + F.coalesce(F.length(p["span"]), F.lit(0))))
        placed = let(before, lambda at: F.transform(ps, lambda p, i: F.struct((F.get(at, i) + p["gap"]).alias("start"), p["span"].alias("span"))))
        return F.transform(F.filter(placed, lambda p: p["span"].isNotNull() & _valid(kind.name, p["span"])), scored)

    out = let(pieces, from_pieces)
    if not kind.base:
        out = F.filter(out, lambda s: s["score"] >= THRESHOLD)
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    gate = F.contains(text, F.lit(kind.gate)) & text.rlike(kind.pattern) if kind.gate else text.rlike(kind.pattern)
    return F.when(gate, out).otherwise(none)


def find_spans(text: Column) -> Column:
    """All spans of a text in the order of KINDS, then by start: array of struct(kind, start, end, score).

    Spans of base kinds (email, ip, card, phone) that pass their checks always stay; the score of others (iban, ssn, secret) must
    reach THRESHOLD. A null text counts as empty, and an empty text has no spans.
    """
    text = F.coalesce(text, F.lit(""))
    return F.concat(*[_spans(text, k) for k in KINDS])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The identifier, the text and its spans; one row per input row, whatever other columns there are."""
    return docs.select(F.col(ident), F.col(text), find_spans(F.col(text)).alias("pii_spans"))


def _of(kind: str):
    return lambda s: s["kind"] == kind


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, a digest of their spans, and all spans as text.

    A null text has no spans. Very long texts are searched whole in linear time. Repeated rows are judged alike, an
    empty table gives an empty one, and other columns are not looked at.
    """
    base = [k.name for k in KINDS if k.base]
    spans = F.col("pii_spans")
    return detect(docs).select(
        "doc_id",
        *[F.size(F.filter(spans, _of(k))).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(_joined(F.filter(spans, lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
    )


def redact(text: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named by the first.

    Null stays null, and a text without spans stays as it is.
    """
    spans = F.array_sort(F.transform(find_spans(text), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    init = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= acc["at"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.concat(acc["parts"], gap).alias("parts"), F.greatest(acc["at"], s["end"]).alias("at"))

    rest = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return let(spans, lambda s: F.when(F.size(s) > 0, F.aggregate(s, init, step, rest)).otherwise(text))
