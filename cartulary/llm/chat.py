"""Chat formatting of reply trees.

Messages name their parent. Every message learns its ancestors by self-joins that double their
reach: after k joins it has met 2^k of them, so a tree of depth d takes log2(d) rounds. The sum of
scores along the way gives each leaf the score of its branch; branches are ranked in their tree,
and the paths of the chosen leaves are written out, each as one conversation.

In the output, ``### role: text</turn>`` is one turn. A backslash goes before each backslash, ``#``
and ``<`` of a text, and before ``:`` too in a role, so control strings stand in texts only escaped
and reading back is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartulary.llm.common import stored

HEAD, MIDDLE, END = "### ", ": ", "</turn>\n"
TURN = re.compile(
    r"### ([^\\:#<]*(?:\\.[^\\:#<]*)*): ([^\\#<]*(?:\\.[^\\#<]*)*)</turn>\n", re.DOTALL
)
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)


def escaped(text: str, role: bool = False) -> str:
    return re.sub(r"([\\#<:])" if role else r"([\\#<])", r"\\\1", text)


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def format_turn(role: str, text: str) -> str:
    return f"{HEAD}{escaped(role, role=True)}{MIDDLE}{escaped(text)}{END}"


def read_turns(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """Role, text, and the bounds of the escaped text, of each turn; the whole must be turns."""
    at = 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        yield unescaped(m[1]), unescaped(m[2]), m.start(2), m.end(2)
        at = m.end()


def chosen_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """``tree, leaf, branch_rank, depth, node`` of the best branches of each tree.

    ``messages(tree, node, parent, score)`` has a string tree, long nodes and unique
    ``(tree, node)``, neither of them null. A message whose parent is
    null or not there is a root. Branches rank by the sum of their scores, null as 0, ties by the
    smaller leaf. ``branches`` is the feature: how many paths of a tree are written. Messages on a
    cycle have no root and are on no path.
    """
    # Ancestors at a distance of a power of two are kept; sums run up to, not with, the next one.
    nodes = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    there = nodes.select("tree", F.col("node").alias("parent"), F.lit(1).alias("known"))
    joined = nodes.join(there, ["tree", "parent"], "left")
    parent = F.when(F.col("known") == 1, F.col("parent"))
    hop = joined.select("tree", "node", parent.alias("up"), F.col("score").alias("total"),
                        F.lit(1).cast("long").alias("reach"))
    # Those at their root are done; they are met by others but climb no more.
    hop = stored(hop, "hops")
    done, going = hop.where("up IS NULL"), hop.where("up IS NOT NULL")
    hops = [going]
    limit = messages.groupBy("tree").count().agg(F.max("count").alias("n")).first()["n"] or 0
    reach = 1
    while reach < limit and not going.isEmpty():
        above = done.unionByName(going).select("tree", F.col("node").alias("up"), F.col("up").alias("far"),
                           F.col("total").alias("more"), F.col("reach").alias("further"))
        hop = going.join(above, ["tree", "up"], "left").select(
            "tree",
            "node",
            F.col("far").alias("up"),
            (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"),
            (F.col("reach") + F.coalesce("further", F.lit(0))).alias("reach"),
        )
        hop = stored(hop, "hops")
        done, going = done.unionByName(hop.where("up IS NULL")), hop.where("up IS NOT NULL")
        reach *= 2
        hops.append(going)
    parents = nodes.select("tree", F.col("parent").alias("node")).distinct()
    leaves = done.join(parents, ["tree", "node"], "left_anti")
    best = Window.partitionBy("tree").orderBy(F.col("total").desc(), "node")
    ranked = leaves.withColumn("branch_rank", F.row_number().over(best)).where(
        F.col("branch_rank") <= branches
    )
    # From the leaf, the longest hops first: each round doubles the places that are filled in.
    path = ranked.select("tree", F.col("node").alias("leaf"), "branch_rank",
                         F.col("reach").alias("depth"), "node")
    for i in range(len(hops) - 1, -1, -1):
        step = hops[i].select("tree", "node", F.col("up").alias("__up"))
        more = path.join(step, ["tree", "node"]).select(
            "tree", "leaf", "branch_rank", (F.col("depth") - (1 << i)).alias("depth"),
            F.col("__up").alias("node"),
        )
        path = stored(path.unionByName(more), "paths")
    return path


def chains(rows: DataFrame, tree: str, order: str) -> DataFrame:
    """Messages of plain conversations: each turn answers the one before it.

    ``tree`` becomes the column's text, the empty text for null.
    Rows are numbered by ``order``, then role and text, nulls first, so repeated rows follow each
    other.
    """
    w = Window.partitionBy(tree).orderBy(order, "role", "text")
    numbered = rows.withColumn("node", F.row_number().over(w).cast("long"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return numbered.select(
        F.coalesce(F.col(tree).cast("string"), F.lit("")).alias("tree"),
        "node",
        parent.alias("parent"),
        F.lit(0.0).alias("score"),
        "role",
        "text",
    )


def format_paths(messages: DataFrame, branches: int = 1, trained: str = "assistant") -> DataFrame:
    """``tree, leaf, depth, formatted, trained`` for each turn of each chosen path.

    A conversation is the concatenation of its turns by ``depth``; turns stay rows, so a very long
    conversation is never one value. ``trained`` marks the turns under the loss mask. A null text
    is empty, a null role is the empty role; other columns are not read.
    """
    path = chosen_paths(messages, branches)
    said = messages.select("tree", "node", "role", "text")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    formatted = F.concat(
        F.lit(HEAD),
        F.regexp_replace(role, r"([\\#<:])", r"\\$1"),
        F.lit(MIDDLE),
        F.regexp_replace(text, r"([\\#<])", r"\\$1"),
        F.lit(END),
    )
    return path.join(said, ["tree", "node"]).select(
        "tree", "leaf", "depth", formatted.alias("formatted"), (role == trained).alias("trained")
    )


_READ = (
    "tree string, leaf long, n_turns long, turns_sha256 string, loss_chars long,"
    " loss_sha256 string, formatted_chars long"
)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, read from its formatted turns in order.

    Turns come sorted and are digested one by one, so a conversation of any length needs the
    memory of a turn.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        names = [x.split()[0] for x in _READ.split(", ")]

        def done() -> tuple:
            n, turns, chars, loss, total = state
            return (*key, n, turns.hexdigest(), chars, loss.hexdigest(), total)

        for pdf in batches:
            rows = []
            for tree, leaf, whole, trained in zip(
                pdf["tree"], pdf["leaf"], pdf["formatted"], pdf["trained"], strict=True
            ):
                if (tree, leaf) != key:
                    if key is not None:
                        rows.append(done())
                    key, state = (tree, leaf), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[4] += len(whole)
                for role, text, _, _ in read_turns(whole):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    if trained:
                        state[2] += len(text)
                        state[3].update(text.encode())
            yield pd.DataFrame(rows, columns=names)
        if key is not None:
            yield pd.DataFrame([done()], columns=names)

    ordered = formatted.repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "depth")
    return ordered.select("tree", "leaf", "formatted", "trained").mapInPandas(run, _READ)
