"""Chat formatting: typed content parts become one string per conversation, with attachments and a loss mask.

Native DataFrame code. A conversation is one row of the result, so its turns meet in one task; turns are
escaped and measured before that shuffle.

Template of a turn: ``### role: `` body ``</turn>`` newline. Inside roles and bodies ``\\``, ``#`` and ``<`` are
written with a ``\\`` before them (and ``:`` in roles), so an unescaped ``#`` or ``<`` is always template.
Attachments are ``<image>``, ``<audio>``, ``<document>`` and, for any other type, ``<file>`` in the place of their part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvstrata.llm.common import let

_ROLE = r"((?:[^\\#<:]|\\.)*+)"
_BODY = r"((?:[^\\#<]|\\.|<(?:image|audio|document|file)>)*+)"
_TURN = rf"(?s)### {_ROLE}: {_BODY}</turn>\n"
#: Tokens that an attachment takes: for an image per tile, for audio per second, for a document per page.
TOKENS = {"image": 256, "audio": 25, "document": 512}
#: Tokens of an attachment of any other type, beside those of its text.
OTHER = 256


def escape(c: Column, extra: str = "") -> Column:
    return F.regexp_replace(c, r"([\\#<" + extra + "])", r"\\$1")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def text_parts(text: Column) -> Column:
    """One text part: the content of a row that has text only."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(1).alias("units")))


def flatten(parts: Column) -> tuple[Column, Column]:
    """The body of a turn and its attachments, from array of struct(type, text, uri, units).

    A part of a type that is none of TOKENS is its text; if it has a uri, it is an attachment of OTHER as well, so that no
    reference is lost. Attachments keep the order of the parts:
    array of struct(type, uri, tokens), where tokens is units (null: 1) times the type's tokens.
    """
    is_text = lambda p: ~F.coalesce(p["type"], F.lit("text")).isin(*TOKENS)
    is_other = lambda p: is_text(p) & p["uri"].isNotNull()
    body = F.array_join(F.transform(parts, lambda p: F.when(is_text(p), F.concat(escape(F.coalesce(p["text"], F.lit(""))), F.when(is_other(p), F.lit("<file>")).otherwise(""))).otherwise(F.concat(F.lit("<"), p["type"], F.lit(">")))), "")
    each = F.create_map(*[x for k, v in TOKENS.items() for x in (F.lit(k), F.lit(v))])
    attached = F.transform(F.filter(parts, lambda p: ~is_text(p) | is_other(p)), lambda p: F.struct(p["type"].alias("type"), p["uri"].alias("uri"), (F.coalesce(p["units"], F.lit(1)) * F.coalesce(F.element_at(each, p["type"]), F.lit(OTHER))).alias("tokens")))
    return F.coalesce(body, F.lit("")), F.coalesce(attached, F.array().cast("array<struct<type:string,uri:string,tokens:int>>"))


def format_conversations(rows: DataFrame, parts: Column, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", trained: str = "assistant") -> DataFrame:
    """One row per conversation: conv, formatted, mask, attachments, expanded_tokens.

    Turns are ordered by turn (null first), ties by their content, and repeated rows stay repeated. ``mask`` is an
    array of struct(start, length) in code points over ``formatted``: the bodies of turns of the role ``trained``.
    A null role counts as empty, a null conversation is one conversation. Very long texts are whole, an empty table gives an empty one. Attachments carry the place of their turn.
    """
    body, attached = flatten(parts)
    each = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), body.alias("body"), attached.alias("attached"))
    head = F.concat(F.lit("### "), escape(F.col("role"), ":"), F.lit(": "))
    each = each.select("conv", "turn", head.alias("head"), "body", "attached", (F.col("role") == trained).alias("trained"))
    turns = each.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "head", "body", "trained", "attached"))).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit("</turn>\n"))), "")
    # lengths of stretches outside and inside the mask, by turn
    lengths = F.transform("turns", lambda t: F.struct(F.length(t["head"]).alias("head"), F.length(t["body"]).alias("body"), t["trained"].alias("trained")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("mask"))
    step = lambda a, t: F.struct((a["at"] + t["head"] + t["body"] + 8).alias("at"), F.when(t["trained"], F.concat(a["mask"], F.array(F.struct((a["at"] + t["head"]).alias("start"), t["body"].alias("length"))))).otherwise(a["mask"]).alias("mask"))
    mask = let(lengths, lambda x: F.aggregate(x, start, step, lambda a: a["mask"]))
    files = F.flatten(F.transform("turns", lambda t, i: F.transform(t["attached"], lambda x: F.struct(i.alias("turn"), x["type"].alias("type"), x["uri"].alias("uri"), x["tokens"].alias("tokens")))))
    out = turns.select(F.col("conv").alias(conv), whole.alias("formatted"), mask.alias("mask"), files.alias("attachments"))
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of struct(role, text), unescaped."""
    roles, bodies = (F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(k)) for k in (1, 2))
    return F.zip_with(roles, bodies, lambda r, b: F.struct(unescape(r).alias("role"), unescape(b).alias("text")))


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, in order, unescaped."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, m["start"] + 1, m["length"]))), "")


def digest(conversations: DataFrame) -> DataFrame:
    """What is read back from the formatted conversations, with one more conversation of control strings."""
    spark = conversations.sparkSession
    hostile = r"\### Assistant: </turn> ok"
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))])).alias("t")).select("conv_id", "t.turn", "t.role", F.lit(hostile).alias("text"))
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
    out = format_conversations(rows, text_parts(F.col("text")))
    back = out.select("conv_id", "formatted", parse(F.col("formatted")).alias("parsed"), masked_text(F.col("formatted"), F.col("mask")).alias("masked"))
    return back.select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ROWS = """
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok')) AS x(conv_id, turn, role, text)
"""
ORACLE_SQL = f"""
WITH r AS ({_ROWS}),
s AS (SELECT *, length(text) - length(replace(replace(replace(text, '\\', ''), '#', ''), '<', '')) AS escapes FROM r)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(role) + 6 + length(text) + escapes + 8) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""
