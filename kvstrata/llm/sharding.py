"""K-d tree sharding: leaves of near-equal bytes, cut at weighted medians of the widest metadata dimension.

Native DataFrame code. The text is read once, to measure it; everything after that runs on a slim
table of sizes and dimension keys. What the driver holds is one row per tree node.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvstrata.llm.common import materialize

#: Buckets of one histogram round of the median search, per node.
BUCKETS = 4096
#: The median search of a node ends when the bucket that holds the median has this share of the node's bytes.
TOLERANCE = 0.0005
#: Up to so many nodes (about 64 bytes each) the table of cuts is broadcast.
BROADCAST_NODES = 65_536
#: Documents move between shards whose bytes differ by more than this share of their mean; a move takes a tenth off it at least.
EVEN, GAIN = 0.01, 0.1
_TIE_BITS = 32
_VALUE_BITS = 30


def string_ordinal(c: Column) -> Column:
    """The first seven bytes of a string as a number, in the order of the strings; null gives -1."""
    return F.coalesce(F.conv(F.hex(F.substring(F.rpad(F.encode(c, "UTF-8"), 7, F.lit(b"\0")), 1, 7)), 16, 10).cast("double"), F.lit(-1.0))


def _cuts(spark, rows: list[tuple], names: str) -> DataFrame:
    values = ", ".join("(" + ", ".join(f"{v}L" for v in r) + ")" for r in rows)
    df = spark.sql(f"SELECT * FROM VALUES {values} AS cuts({names})")
    return F.broadcast(df) if len(rows) <= BROADCAST_NODES else df


def _cut_bucket(hist: Column, need: Column) -> Column:
    """Of a node's histogram, sorted structs (b, w, n), the bucket with which the weight reaches ``need``, or the last: struct(b, w, n, below)."""
    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("w"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("below"))

    def step(acc: Column, x: Column) -> Column:
        reached = (acc["b"] >= 0) & (acc["below"] + acc["w"] >= need)
        following = F.struct(x["b"].alias("b"), x["w"].cast("long").alias("w"), x["n"].cast("long").alias("n"), (acc["below"] + acc["w"]).alias("below"))
        return F.when(reached, acc).otherwise(following)

    return F.aggregate(hist, start, step)


def _median_cuts(nodes: DataFrame, active: list[dict]) -> dict[int, int]:
    """For each active node the key after which its left part ends.

    ``active`` holds node, dim, lo, hi (the extent of the keys), weight and half, the weight that the left part should have.
    Each round counts bytes in equal buckets of the open interval of every node at once and goes on inside the bucket that
    holds the cut. The bucket is found where the histogram is; the driver gets one row of each node.
    """
    spark, done = nodes.sparkSession, {}
    state = {a["node"]: a | {"below": 0, "first": a["lo"], "last": a["hi"]} for a in active}
    while state:
        steps = {n: max(1, -(-(s["hi"] - s["lo"] + 1) // BUCKETS)) for n, s in state.items()}
        rows = [(n, s["dim"], s["lo"], s["hi"], steps[n], math.ceil(s["half"] - s["below"])) for n, s in state.items()]
        cuts = _cuts(spark, rows, "c_node, c_dim, c_lo, c_hi, c_step, c_need")
        key = F.element_at("keys", (F.col("c_dim") + 1).cast("int"))
        buckets = (
            nodes.join(cuts, F.col("node") == F.col("c_node"))
            .withColumn("key", key)
            .filter((F.col("key") >= F.col("c_lo")) & (F.col("key") <= F.col("c_hi")))
            .groupBy("node", "c_need", ((F.col("key") - F.col("c_lo")) / F.col("c_step")).cast("long").alias("b"))
            .agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"))
        )
        # at most BUCKETS entries in the list of a node
        listed = buckets.groupBy("node", "c_need").agg(F.sort_array(F.collect_list(F.struct("b", "w", "n"))).alias("hist"))
        for node, found in listed.select("node", _cut_bucket(F.col("hist"), F.col("c_need")).alias("found")).collect():
            s, step = state[node], steps[node]
            below, w = s["below"] + found["below"], found["w"]
            lo = s["lo"] + found["b"] * step
            hi = min(lo + step - 1, s["hi"])
            if step == 1 or found["n"] == 1 or w <= TOLERANCE * s["weight"]:
                cut = hi if abs(below + w - s["half"]) <= abs(s["half"] - below) else lo - 1
                done[node] = min(max(cut, s["first"]), s["last"] - 1)
                del state[node]
            else:
                state[node] = s | {"lo": lo, "hi": hi, "below": below}
    return done


def _even(nodes: DataFrame, weights: dict[int, int], even: float) -> DataFrame:
    """The nodes, with single rows moved from heavy leaves to light ones until their sizes differ by ``even`` of their mean, or no move helps.

    The heaviest leaf gives to the lightest, the second to the second lightest, and so on: of each pair the row nearest to half
    of its difference. The driver gets one row of each pair a round; leaves of many rows are even from their cuts on.
    """
    moves: dict[int, int] = {}
    weights, limit, settled = dict(weights), even * sum(weights.values()) / max(1, len(weights)), set()
    placed = nodes
    while True:
        order = sorted(weights, key=lambda n: (weights[n], n))
        pairs = {h: low for low, h in zip(order[: len(order) // 2], reversed(order), strict=False) if weights[h] - weights[low] > limit and (h, low) not in settled}
        if not pairs:
            return placed
        wants = _cuts(nodes.sparkSession, [(h, (weights[h] - weights[low]) // 2) for h, low in pairs.items()], "c_node, c_want")
        near = placed.join(wants, F.col("node") == F.col("c_node")).groupBy("node").agg(F.min(F.struct(F.abs(F.col("size") - F.col("c_want")), "row", "size")).alias("near"))
        for h, found in near.collect():
            low = pairs[h]
            apart = weights[h] - weights[low]
            if abs(apart - 2 * found["size"]) > (1 - GAIN) * apart:
                settled.add((h, low))
                continue
            moves[found["row"]] = low
            weights[h], weights[low] = weights[h] - found["size"], weights[low] + found["size"]
        if moves:
            to = _cuts(nodes.sparkSession, list(moves.items()), "c_row, c_to")
            placed = nodes.join(to, F.col("row") == F.col("c_row"), "left").withColumn("node", F.coalesce("c_to", "node")).drop("c_row", "c_to")


def kd_shard(df: DataFrame, ident: str, size: Column, dims: list[Column], tie: Column, *, n_shards: int | None = None, target_bytes: int | None = None, even: float | None = None, carry: dict[str, Column] | None = None) -> DataFrame:
    """Deal rows into shards 0..k-1 of near-equal bytes.

    ``dims`` are numeric metadata columns (nulls sort first). Every node is split at the median of ``size``
    along the dimension whose extent is largest, measured against the extent over all rows. With ``n_shards``, any number,
    a node for an odd number of shards is cut at the share that the smaller half of them should have, and shards may be
    empty only if there are fewer rows; with ``even`` as well, single rows then move between shards that differ by more than
    this share of their mean. With ``target_bytes`` a node at or under 1.25 times the target is a leaf.
    Ties in a dimension are ordered by ``tie`` and then by a hash of the row, so rows of one hot value, and rows that
    repeat, are split wherever the median falls.
    Returns ident, size, the columns of ``carry``, shard (int) and slot (long, gapless from 0 within the shard).
    An empty table gives an empty result. Repeated rows each get their own slot. Texts are only measured, however long
    they are; other columns are not looked at.
    """
    spark = df.sparkSession
    carry = carry or {}
    slim = df.select(
        F.col(ident).alias("ident"),
        size.cast("long").alias("size"),
        (tie.cast("long").bitwiseAND(0xFFFF)).alias("tie"),
        *[c.cast("double").alias(f"d{i}") for i, c in enumerate(dims)],
        *[c.alias(f"carry_{k}") for k, c in carry.items()],
    )
    slim = materialize(slim.withColumn("row", F.monotonically_increasing_id()), "kd-sizes")
    extent = slim.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("w"), *[f(f"d{i}").alias(f"{f.__name__}{i}") for i in range(len(dims)) for f in (F.min, F.max)]).first()
    rows, total = extent["n"], extent["w"] or 0
    target = target_bytes or 1
    depth = math.ceil(math.log2(n_shards)) if n_shards else 62
    shares = {0: n_shards}  # the shards that each node is for

    def key(i: int) -> Column:
        lo, hi = extent[f"min{i}"], extent[f"max{i}"]
        value = F.coalesce((F.col(f"d{i}") - F.lit(lo)) / F.lit(hi - lo), F.lit(0.0)) if lo is not None and hi > lo else F.lit(0.0)
        ordinal = (value * ((1 << _VALUE_BITS) - 1)).cast("long")
        return F.shiftleft(ordinal, _TIE_BITS).bitwiseOR(F.shiftleft(F.col("tie"), 16)).bitwiseOR(F.xxhash64("ident", "row").bitwiseAND(0xFFFF))

    nodes = slim.select("ident", "size", "row", *[f"carry_{k}" for k in carry], F.array(*[key(i) for i in range(len(dims))]).alias("keys"), F.lit(0).cast("long").alias("node"))
    leaves: set[int] = set()
    for level in range(depth):
        if not rows:
            break
        per_dim = [f(F.element_at("keys", i + 1)).alias(f"{f.__name__}{i}") for i in range(len(dims)) for f in (F.min, F.max)]
        stats = [r for r in nodes.groupBy("node").agg(F.sum("size").alias("w"), *per_dim).collect() if r["node"] not in leaves]
        active = []
        for r in stats:
            width = lambda i: (r[f"max{i}"] >> _TIE_BITS) - (r[f"min{i}"] >> _TIE_BITS)
            dim = max(range(len(dims)), key=lambda i: (width(i), r[f"max{i}"] - r[f"min{i}"], -i))
            share = shares.get(r["node"]) if n_shards else 2
            if (r["w"] <= 1.25 * target if n_shards is None else share == 1) or r[f"max{dim}"] == r[f"min{dim}"]:
                leaves.add(r["node"])
            else:
                active.append({"node": r["node"], "dim": dim, "lo": r[f"min{dim}"], "hi": r[f"max{dim}"], "weight": r["w"], "half": r["w"] * (share // 2) / share})
                if n_shards:
                    shares[2 * r["node"] + 1], shares[2 * r["node"] + 2] = share // 2, share - share // 2
        if not active:
            break
        at = _median_cuts(nodes, active)
        cuts = _cuts(spark, [(a["node"], a["dim"], at[a["node"]]) for a in active], "c_node, c_dim, c_cut")
        right = (F.element_at("keys", (F.col("c_dim") + 1).cast("int")) > F.col("c_cut")).cast("long")
        split = F.when(F.col("c_node").isNull(), F.col("node")).otherwise(F.col("node") * 2 + 1 + right)
        nodes = nodes.join(cuts, F.col("node") == F.col("c_node"), "left").withColumn("node", split).drop("c_node", "c_dim", "c_cut")
        if level % 4 == 3:  # a plan of many joins is read again from a table
            nodes = materialize(nodes, "kd-level")
    weights = {r["node"]: r["w"] for r in nodes.groupBy("node").agg(F.sum("size").alias("w")).collect()} if rows else {}
    found = sorted(weights)
    if even is not None and n_shards:
        nodes = _even(nodes, weights, even)
    # leaves in the order of the tree, from left to right
    place = lambda node: bin(node + 1)[3:].ljust(64, "0")
    numbered = _cuts(spark, [(n, i) for i, n in enumerate(sorted(found, key=place))] or [(0, 0)], "c_node, shard")
    placed = nodes.join(numbered, F.col("node") == F.col("c_node")).select("ident", "size", *[f"carry_{k}" for k in carry], F.col("shard").cast("int").alias("shard"))
    # slots: ranks within small hashed groups of a shard, after the rows of the groups before
    groups = max(1, rows // 8192)
    order = ["ident", "size", *[f"carry_{k}" for k in carry]]
    from pyspark.sql import Window

    grouped = placed.withColumn("g", F.pmod(F.xxhash64(*order), F.lit(groups)))
    counts = grouped.groupBy("shard", "g").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("shard").alias("o_shard"), F.col("g").alias("o_g"), before.alias("o_before"))
    rank = F.row_number().over(Window.partitionBy("shard", "g").orderBy(*order))
    return (
        grouped.withColumn("rank", rank)
        .join(offsets, (F.col("shard") == F.col("o_shard")) & (F.col("g") == F.col("o_g")))
        .select(F.col("ident").alias(ident), "size", *[F.col(f"carry_{k}").alias(k) for k in carry], "shard", (F.col("o_before") + F.col("rank") - 1).cast("long").alias("slot"))
    )


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """All documents in ``n_shards`` shards of near-equal bytes, by language, source, length and identifier.

    Where documents are few, or long beside a shard, single ones leave their k-d cell to keep sizes within EVEN of their mean.

    A null text counts one byte and has the checksum of the empty text. Rows that repeat are spread like others.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    dims = [F.log2(size), string_ordinal(F.col("source")), string_ordinal(F.col("lang")), F.col("doc_id")]
    crc = F.crc32(F.encode(text, "UTF-8"))
    placed = kd_shard(docs, "doc_id", size, dims, crc, n_shards=n_shards, even=EVEN, carry={"text_crc32": crc})
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
