"""Prefix trie of conversations by the Euler-tour technique.

A node is a distinct sequence of first turns. Every row of a conversation knows its node by a
fingerprint of its prefix, the exclusive or of two 64-bit digests of (place, turn), taken over the
places up to its own; a running sum needs no order of tasks, so a long conversation is spread.

Each node gets an arc that enters it and one that leaves it. The entering arc is followed by that of
the first child, or by the leaving arc where there is none; the leaving arc by the entering arc of
the next sibling, or by the parent's leaving arc. This list is ranked in a distributed way: in each
round the arcs whose hash is less than those of both neighbours are taken out, about a third, and
their weights handed on; when few are left they are ranked at once, and the rounds are undone. The
prefix sums at a node's two arcs give the leaves and the savings of its subtree.

A conversation, a node or a parent may hold a third of all rows. So nothing is gathered or ordered by
such a key in one task: rows are sorted by ranges, and what passes from one range to the next is a
row for each range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartulary.llm.common import stored

#: Turns shared at most, and how many conversations have one to share them with.
SHARED, BLOCK = 4, 20
#: Arcs that are ranked at once when no more are left.
FEW_ARCS = 1 << 14
#: Characters of conversation ids in one row before they are digested.
CHUNK = 1 << 16

_WORD = r"[^\\x20\\x09-\\x0D]+"


def in_ranges(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``df`` dealt by ranges of ``by`` and written, with its range as ``part``.

    Rows that are equal in all of ``by`` are told apart by ``tie``, so they too are spread.
    """
    tied = df.withColumn("tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(*by, "tie").withColumn("part", F.spark_partition_id())
    return stored(dealt, "ranges")


def _ordered(group: str | Sequence[str], by: Sequence[str]) -> Window:
    keys = [group] if isinstance(group, str) else list(group)
    return Window.partitionBy(*keys, "part").orderBy(*by, "tie")


def numbered(rows: DataFrame, group: str, by: Sequence[str], *digests: str) -> DataFrame:
    """Adds ``place``, from 1 in the order ``by`` of each group, and running exclusive ors.

    A digest is an SQL expression that may use ``place``; its running value up to and with the row is
    ``f1``, ``f2`` and so on, its own value ``g1``, ``g2``. Rows of a group in one range are numbered
    there; the counts and sums of a group's earlier ranges are added.
    """
    placed = in_ranges(rows, [group, *by])
    sizes = placed.groupBy(group, "part").agg(F.count(F.lit(1)).alias("size"))
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begin = sizes.select(group, "part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("begin"))
    own = placed.withColumn("nth", F.row_number().over(_ordered(group, by)))
    out = own.join(begin, [group, "part"]).withColumn("place", F.col("nth") + F.col("begin"))
    for k, digest in enumerate(digests, start=1):
        out = out.withColumn(f"g{k}", F.expr(digest))
    out = stored(out.drop("nth", "begin"), "numbered")
    if not digests:
        return out.drop("part", "tie")
    names = range(1, len(digests) + 1)
    whole = out.groupBy(group, "part").agg(*(F.bit_xor(f"g{k}").alias(f"x{k}") for k in names))
    before = [F.coalesce(F.bit_xor(f"x{k}").over(earlier), F.lit(0)).alias(f"x{k}") for k in names]
    joined = out.join(whole.select(group, "part", *before), [group, "part"])
    running = _ordered(group, by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.select(
        *[x for x in out.columns if x not in ("part", "tie")],
        *(F.col(f"x{k}").bitwiseXOR(F.bit_xor(f"g{k}").over(running)).alias(f"f{k}") for k in names),
    )


def _digests(place: str) -> tuple[str, str]:
    return tuple(f"xxhash64({salt}, {place}, said)" for salt in (1, 2))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv, d, f1, f2, p1, p2, n_words``: each turn of each rebuilt conversation.

    ``f`` is the fingerprint of the first ``d`` turns, ``p`` that of the turns before the last one.
    Of conversation c the first h turns are those of conversation c - c % 20 (what it has of them),
    h = crc32(c) % 4, then follow c's own turns after its first h. % has the sign of c.
    """
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # A turn from here on is a digest; its length keeps a role apart from the text after it.
    turns = rows.select(
        "conv",
        "turn",
        F.expr("sha2(concat(CAST(length(role) AS STRING), ' ', role, text), 256)").alias("said"),
        F.expr(f"CAST(regexp_count(text, '{_WORD}') AS BIGINT)").alias("n_words"),
    )
    own = numbered(turns, "conv", ["turn", "said"])
    held = "CAST(pmod(crc32(CAST(CAST(conv AS STRING) AS BINARY)), 4) AS BIGINT)"
    base = f"conv - conv % {BLOCK}"
    heads = (
        own.where(f"place < {SHARED} AND conv % {BLOCK} = 0")
        .groupBy(F.col("conv").alias("base"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "said", "n_words"))).alias("head"))
    )
    all_convs = turns.select("conv").distinct().select("conv", F.expr(base).alias("base"))
    started = (
        all_convs.join(heads, "base", "left")
        .withColumn("head", F.expr(f"slice(coalesce(head, array()), 1, CAST({held} AS INT))"))
        .select("conv", "head", F.expr("CAST(size(head) AS BIGINT)").alias("n_head"))
    )
    first = started.select("conv", F.explode("head").alias("h")).select("conv", "h.*")
    # A hot conversation meets one row here; adaptive execution splits its partition.
    later = (
        own.where(f"place > {held}")
        .join(started.select("conv", "n_head"), "conv")
        .select("conv", F.expr(f"place - {held} + n_head").alias("place"), "said", "n_words")
    )
    both = first.unionByName(later.select(*first.columns))
    marked = numbered(both, "conv", ["place"], *_digests("place"))
    before = [F.col(f"f{k}").bitwiseXOR(F.col(f"g{k}")).alias(f"p{k}") for k in (1, 2)]
    return marked.select("conv", F.col("place").alias("d"), "f1", "f2", *before, "n_words")


def trie_nodes(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """``id, d, f1, f2, p1, p2, conv_id, n_convs, n_words`` of all nodes, the root among them."""
    deep = turns.groupBy("d", "f1", "f2").agg(
        F.min("p1").alias("p1"),
        F.min("p2").alias("p2"),
        F.min("conv").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.max("n_words").alias("n_words"),
    )
    members = conversations.select(F.col("conv_id").cast("long").alias("conv")).where("conv IS NOT NULL").distinct()
    zero = F.lit(0).cast("long")
    root = members.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(*(zero.alias(x) for x in ("d", "f1", "f2", "p1", "p2", "n_words")), "conv_id", "n_convs")
    nodes = deep.unionByName(root.select(*deep.columns))
    return stored(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")


def families(nodes: DataFrame) -> DataFrame:
    """Each node as a parent and as a child, with what follows it among its family.

    ``id, parent_id, parent_conv, is_child, next_id, n_children``: a family is a node and its
    children. In it the parent comes first; ``next_id`` is the next child, null for the last one.
    """
    as_parent = nodes.select("d", "f1", "f2", F.lit(0).alias("is_child"), "id", "conv_id")
    as_child = nodes.where("d > 0").select(
        (F.col("d") - 1).alias("d"), F.col("p1").alias("f1"), F.col("p2").alias("f2"),
        F.lit(1).alias("is_child"), "id", "conv_id",
    )
    key = ["d", "f1", "f2"]
    sorted_rows = in_ranges(as_parent.unionByName(as_child), [*key, "is_child", "conv_id"])
    order = _ordered(key, ["is_child", "conv_id"])
    inside = sorted_rows.withColumn("after", F.lead("id").over(order))
    # What a range has of a family: its first row, the parent if it is there, and its children.
    first = F.min_by("id", F.struct("is_child", "conv_id", "tie")).alias("first")
    is_parent = F.col("is_child") == 0
    edges = sorted_rows.groupBy(*key, "part").agg(
        first,
        F.max(F.when(is_parent, F.col("id"))).alias("parent_id"),
        F.max(F.when(is_parent, F.col("conv_id"))).alias("parent_conv"),
        F.sum("is_child").alias("n"),
    )
    parts = Window.partitionBy(*key)
    across = edges.select(
        *key,
        "part",
        F.lead("first").over(parts.orderBy("part")).alias("then"),
        F.max("parent_id").over(parts).alias("parent_id"),
        F.max("parent_conv").over(parts).alias("parent_conv"),
        F.sum("n").over(parts).alias("n_children"),
    )
    return inside.join(across, [*key, "part"]).select(
        "id", "parent_id", "parent_conv", "is_child", F.coalesce("after", "then").alias("next_id"), "n_children"
    )


_WEIGHTS = ("place", "leaves", "saved")


def tour(family: DataFrame, nodes: DataFrame) -> DataFrame:
    """``arc, after, before`` and weights: node x is entered by arc 2x and left by arc 2x + 1."""
    enter = F.expr("shiftleft(id, 1)")
    leave = F.expr("shiftleft(id, 1) + 1")
    follows = family.select(
        F.when(F.col("is_child") == 0, enter).otherwise(leave).alias("arc"),
        F.expr("coalesce(shiftleft(next_id, 1), shiftleft(parent_id, 1) + 1)").alias("after"),
        F.when(F.col("is_child") == 0, F.expr("IF(n_children = 0, 1, 0)")).otherwise(0).alias("leaves"),
    )
    saved = nodes.select(enter.alias("arc"), F.expr("(n_convs - 1) * n_words").alias("saved"))
    none = F.lit(None).cast("long")
    messages = (
        follows.select("arc", "after", none.alias("before"), "leaves", none.alias("saved"))
        .unionByName(follows.select(F.col("after").alias("arc"), none.alias("after"),
                                    F.col("arc").alias("before"), F.lit(0).alias("leaves"), none.alias("saved")))
        .unionByName(saved.select("arc", none.alias("after"), none.alias("before"), F.lit(0).alias("leaves"), "saved"))
    )
    return messages.groupBy("arc").agg(
        F.max("after").alias("after"),
        F.max("before").alias("before"),
        F.lit(1).cast("long").alias("place"),
        F.sum("leaves").cast("long").alias("leaves"),
        F.coalesce(F.sum("saved"), F.lit(0)).cast("long").alias("saved"),
    )


def ranked(arcs: DataFrame, few: int = FEW_ARCS) -> DataFrame:
    """``arc`` and the sums of the weights from the start of the list up to and with it.

    ``arcs(arc, after, before, place, leaves, saved)`` is one list, linked both ways. An arc's weight
    here is that of itself and of the arcs taken out just before it.
    """
    now = stored(arcs, "arcs")
    taken = []
    n = now.count()
    while n > few:
        own, left, right = (f"xxhash64({len(taken)}, {x})" for x in ("arc", "before", "after"))
        # Both ends stay. Equal hashes only keep an arc for another round.
        inner = "before IS NOT NULL AND after IS NOT NULL"
        out = now.withColumn("leaves_now", F.expr(f"{inner} AND {own} < {left} AND {own} < {right}"))
        out = stored(out, "arcs")
        gone, stay = out.where("leaves_now").drop("leaves_now"), out.where("NOT leaves_now").drop("leaves_now")
        taken.append(gone)
        null = F.lit(None).cast("long")
        zero = [F.lit(0).cast("long").alias(x) for x in _WEIGHTS]
        sent = gone.select(F.col("before").alias("arc"), F.col("after").alias("new_after"),
                           null.alias("new_before"), *zero)
        sent = sent.unionByName(gone.select(F.col("after").alias("arc"), null.alias("new_after"),
                                            F.col("before").alias("new_before"), *_WEIGHTS))
        sent = sent.groupBy("arc").agg(
            F.max("new_after").alias("new_after"), F.max("new_before").alias("new_before"),
            *(F.sum(x).alias(f"more_{x}") for x in _WEIGHTS),
        )
        now = stored(
            stay.join(sent, "arc", "left").select(
                "arc",
                F.coalesce("new_after", "after").alias("after"),
                F.coalesce("new_before", "before").alias("before"),
                *((F.col(x) + F.coalesce(f"more_{x}", F.lit(0))).alias(x) for x in _WEIGHTS),
            ),
            "arcs",
        )
        n = now.count()
    known = _walked(now)
    for gone in reversed(taken):
        # Sums at the arc before it, plus its own weight.
        above = known.select(F.col("arc").alias("before"), *(F.col(x).alias(f"sum_{x}") for x in _WEIGHTS))
        back = gone.join(above, "before").select("arc", *((F.col(x) + F.col(f"sum_{x}")).alias(x) for x in _WEIGHTS))
        known = stored(known.unionByName(back), "sums")
    return known


def _walked(arcs: DataFrame) -> DataFrame:
    """The sums of a list of at most ``few`` arcs, on the driver."""
    rows = {r.arc: r for r in arcs.collect()}
    at = next((x for x, r in rows.items() if r.before is None), None)
    out, sums = [], (0, 0, 0)
    while at is not None:
        r = rows[at]
        sums = tuple(a + r[x] for a, x in zip(sums, _WEIGHTS, strict=True))
        out.append((at, *sums))
        at = r.after
    return arcs.sparkSession.createDataFrame(out, "arc long, place long, leaves long, saved long")


def end_digests(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """``d, f1, f2, ends_sha256`` of the nodes at which a conversation ends.

    The ids are sorted by ranges and joined to chunks there; the chunks of a node, in order, are then
    digested one by one in the memory of a chunk, as the digest of a sequence is itself sequential.
    """
    last = turns.groupBy("conv").agg(F.max_by(F.struct("d", "f1", "f2"), "d").alias("at"))
    ends = conversations.select(F.col("conv_id").cast("long").alias("conv")).where("conv IS NOT NULL").distinct()
    zero = F.lit(0).cast("long")
    root = F.struct(zero.alias("d"), zero.alias("f1"), zero.alias("f2"))
    ended = ends.join(last, "conv", "left").select("conv", F.coalesce("at", root).alias("at")).select("at.*", "conv")
    key = ["d", "f1", "f2"]
    spread = ended.repartitionByRange(*key, "conv").sortWithinPartitions(*key, "conv")
    made = "d long, f1 long, f2 long, first long, ids string"

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, size = None, [], 0
        for pdf in batches:
            rows = []
            for d, f1, f2, conv in zip(*(pdf[x].tolist() for x in (*key, "conv")), strict=True):
                if at != (d, f1, f2) or size > CHUNK:
                    if ids:
                        rows.append((*at, int(ids[0]), ",".join(ids)))
                    at, ids, size = (d, f1, f2), [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            yield pd.DataFrame(rows, columns=[*key, "first", "ids"])
        if ids:
            yield pd.DataFrame([(*at, int(ids[0]), ",".join(ids))], columns=[*key, "first", "ids"])

    def digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, digest = None, None
        for pdf in batches:
            rows = []
            for d, f1, f2, ids in zip(*(pdf[x].tolist() for x in (*key, "ids")), strict=True):
                if at == (d, f1, f2):
                    digest.update(b",")
                else:
                    if at is not None:
                        rows.append((*at, digest.hexdigest()))
                    at, digest = (d, f1, f2), hashlib.sha256()
                digest.update(ids.encode())
            yield pd.DataFrame(rows, columns=[*key, "ends_sha256"])
        if at is not None:
            yield pd.DataFrame([(*at, digest.hexdigest())], columns=[*key, "ends_sha256"])

    chunks = spread.mapInPandas(joined, made)
    in_order = chunks.repartition(*key).sortWithinPartitions(*key, "first")
    return in_order.select(*key, "ids").mapInPandas(digested, "d long, f1 long, f2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, few: int = FEW_ARCS) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``,
    ``n_children``, ``n_leaves`` and ``saved_tokens`` of the subtree, ``ends_sha256``. Turns are in the
    order of ``turn``, null first, then of a digest of role and text; repeated rows are turns each.
    A null role or text is empty. Rows without a ``conv_id`` belong to no conversation and are left
    out; an empty table has no root and no rows. Other columns are not read.
    """
    turns = stored(rebuilt(conversations), "turns")
    nodes = trie_nodes(turns, conversations)
    family = stored(families(nodes), "families")
    sums = ranked(tour(family, nodes), few)
    # Of the two arcs of a node the entering one comes first and is counted with the subtree.
    subtree = sums.groupBy(F.expr("shiftright(arc, 1)").alias("id")).agg(
        *((F.max(x) - F.min(x)).alias(x) for x in _WEIGHTS[1:])
    )
    up = family.where("is_child = 1").select("id", F.col("parent_conv").alias("parent_conv_id"))
    down = family.where("is_child = 0").select("id", "n_children")
    empty = hashlib.sha256(b"").hexdigest()
    return (
        nodes.join(down, "id")
        .join(up, "id", "left")
        .join(subtree, "id")
        .join(end_digests(turns, conversations), ["d", "f1", "f2"], "left")
        .select(
            "conv_id",
            F.col("d").alias("depth"),
            "parent_conv_id",
            "n_convs",
            "n_children",
            # The entering arc's own weights are in its own sum.
            F.expr("leaves + IF(n_children = 0, 1, 0)").alias("n_leaves"),
            F.expr("saved + (n_convs - 1) * n_words").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
        )
    )
