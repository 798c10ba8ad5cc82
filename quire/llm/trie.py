"""Prefix trie of conversations by the Euler-tour technique.

Every distinct sequence of first turns is a node. Its subtree figures come from the
tour of the tree: each node has an arc that enters and one that leaves it, every arc
knows the next one from its node's parent, children and siblings, and ranking that
list gives each arc its position. Running sums over the positions then hold, between
the two arcs of a node, what lies below it. No step depends on the depth of the tree
or on the number of children of a node.

* Turns are named by 128-bit digests where they are read; texts do not move.
* A prefix is named by the exclusive-or of 128-bit digests of (depth, turn), a running
  total, so a conversation with very many turns is no task of its own.
* The list is ranked by contraction: an arc whose priority is lower than that of both
  neighbours leaves the list, which loses a third each round; the rest, ``SMALL``
  arcs at most, is walked, and the rounds are undone. Work is linear in all.

Rows without conv_id are left out. A null turn comes first, null role and text count
as empty, turns of equal number are ordered by their digests, and repeated rows are
turns of their own. A text of any length is one digest and a number of characters. No
conversations, no nodes. Other columns are left alone, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.ordered import cut, neighbours, running
from quire.session import materialise

#: Arcs that one task walks when the list has been contracted.
SMALL = 100_000
#: Conversation ids whose texts are joined in one row: 2^12 at most.
RUN = 12
NAME = ["depth", "f1", "f2"]


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv, r, d1, d2, chars): every turn, its place in its conversation (from 0), the
    digest of (role, text) and the number of characters of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn"),
        F.xxhash64(F.lit(1), role, text).alias("d1"),
        F.xxhash64(F.lit(2), role, text).alias("d2"),
        F.length(text).cast("long").alias("chars"),
    )
    order = ["turn", "d1", "d2"]
    placed = running(cut(turns, ["conv"], order, "turns"), ["conv"], order, r=("sum", F.lit(1)))
    return materialise(placed.select("conv", (F.col("r") - 1).alias("r"), "d1", "d2", "chars"), "numbered")


def with_common_heads(turns: DataFrame, most: int = 5, every: int = 100) -> DataFrame:
    """Turns (conv, r, ...) of conversations that begin alike: the first h turns of
    conversation c are those of conversation c - c % ``every`` (fewer, if it has fewer),
    its own follow from the h-th on; h = crc32(c) % (``most`` + 1)."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)
    heads = turns.where((F.col("conv") % every == 0) & (F.col("r") < most)).withColumnRenamed("conv", "base")
    convs = turns.where("r = 0").select("conv", (F.col("conv") - F.col("conv") % every).alias("base"), h.alias("h"))
    given = convs.join(heads, "base").where("r < h").select(*turns.columns)
    return turns.where(F.col("r") >= h).unionByName(given)


def _steps(turns: DataFrame) -> DataFrame:
    """(conv, depth, f1, f2, p1, p2, chars): the prefix that ends with each turn (f) and
    the one before it (p)."""
    placed = running(cut(turns, ["conv"], ["r"], "rebuilt"), ["conv"], ["r"], depth=("sum", F.lit(1)))
    named = placed.withColumns(
        {f"h{k}": F.xxhash64(F.lit(k), F.col("depth"), F.col("d1"), F.col("d2")) for k in (1, 2)}
    )
    summed = running(named, ["conv"], ["r"], f1=("xor", F.col("h1")), f2=("xor", F.col("h2")))
    before = [F.col(f"f{k}").bitwiseXOR(F.col(f"h{k}")).alias(f"p{k}") for k in (1, 2)]
    return materialise(summed.select("conv", *NAME, *before, "chars"), "steps")


def _nodes(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """(no, depth, f1, f2, p1, p2, conv_id, n_convs, saved): all nodes, numbered in no order."""
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    below = steps.groupBy(*NAME).agg(
        F.min("p1").alias("p1"),
        F.min("p2").alias("p2"),
        F.min("conv").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.min("chars").alias("chars"),
    )
    root = (
        convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"))
        .where("n_convs > 0")
        .select(*[zero.alias(c) for c in NAME], none.alias("p1"), none.alias("p2"), "conv_id", "n_convs", zero.alias("chars"))
    )
    nodes = below.unionByName(root).withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")).drop("chars")
    # Numbers hold once they are written; nothing is computed from the plan again.
    return materialise(nodes.withColumn("no", F.monotonically_increasing_id()), "nodes")


def _family(nodes: DataFrame) -> DataFrame:
    """Nodes with parent, parent_conv, previous, next, first, last and n_children.

    Parents and their children are brought together by sorting: a parent's row comes
    before those of its children, and its number runs on through them.
    """
    none = F.lit(None).cast("long")
    parents = nodes.select(*NAME, none.alias("child"), F.col("no").alias("_no"), F.col("conv_id").alias("_conv"))
    children = nodes.where("depth > 0").select(
        (F.col("depth") - 1).alias("depth"),
        F.col("p1").alias("f1"),
        F.col("p2").alias("f2"),
        F.col("no").alias("child"),
        none.alias("_no"),
        none.alias("_conv"),
    )
    placed = cut(parents.unionByName(children), NAME, ["child"], "families")
    known = running(placed, NAME, ["child"], parent=("max", F.col("_no")), parent_conv=("max", F.col("_conv")))

    def sibling(side: str) -> Column:
        same = [F.col(f"{side}.{c}") == F.col(c) for c in NAME]
        return F.when(same[0] & same[1] & same[2], F.col(f"{side}.child"))

    siblings = materialise(
        neighbours(known, [*NAME, "child"])
        .where("child IS NOT NULL")
        .select(
            F.col("child").alias("no"),
            "parent",
            "parent_conv",
            sibling("before").alias("previous"),
            sibling("after").alias("next"),
        ),
        "siblings",
    )
    kids = siblings.groupBy(F.col("parent").alias("no")).agg(
        F.min("no").alias("first"), F.max("no").alias("last"), F.count("*").alias("n_children")
    )
    return materialise(
        nodes.join(siblings, "no", "left")
        .join(kids, "no", "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))),
        "family",
    )


def tour(family: DataFrame) -> DataFrame:
    """(id, prev, next): the arcs of the Euler tour, 2 * no into and 2 * no + 1 out of a node."""
    enter = lambda c: F.col(c) * 2
    leave = lambda c: F.col(c) * 2 + 1
    into = F.struct(
        enter("no").alias("id"),
        F.coalesce(leave("previous"), enter("parent")).alias("prev"),
        F.coalesce(enter("first"), leave("no")).alias("next"),
    )
    out = F.struct(
        leave("no").alias("id"),
        F.coalesce(leave("last"), enter("no")).alias("prev"),
        F.coalesce(enter("next"), leave("parent")).alias("next"),
    )
    return family.select(F.inline(F.array(into, out)))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions in a short list (id, prev, next, w)."""
    held = list(batches)
    if not sum(b.num_rows for b in held):
        return
    ids, prev, follow, w = (
        np.concatenate([b.column(k).fill_null(-1).to_numpy(zero_copy_only=False) for b in held]) for k in range(4)
    )
    rows = np.argsort(ids)
    after = np.where(follow < 0, -1, rows[np.minimum(np.searchsorted(ids[rows], follow), ids.size - 1)]).tolist()
    weights = w.tolist()
    at, place = int(np.flatnonzero(prev < 0)[0]), 0
    places = np.empty(ids.size, np.int64)
    while at >= 0:
        place += weights[at]
        places[at] = place
        at = after[at]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(places)], names=["id", "pos"])


def list_rank(links: DataFrame, small: int = SMALL) -> DataFrame:
    """(id, pos): the position, from 0, of every element of a doubly linked list
    (id, prev, next) of longs from 0 on."""
    weight = F.when(F.col("prev").isNull(), 0).otherwise(1).cast("long")
    level = materialise(links.select("id", "prev", "next", weight.alias("w")), "list")
    taken: list[DataFrame] = []
    while level.count() > small:
        own, before, after = (F.xxhash64(F.lit(len(taken)), F.col(c)) for c in ("id", "prev", "next"))
        inner = F.col("prev").isNotNull() & F.col("next").isNotNull()
        goes = inner & (own < before) & (own < after)
        gone, stay = level.where(goes), level.where(~goes)
        taken.append(gone.select("id", "prev", "w"))
        none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
        told = (
            stay.select("id", "prev", "next", none.alias("p"), none.alias("n"), "w")
            .unionByName(gone.select(F.col("next").alias("id"), none.alias("prev"), none.alias("next"), F.col("prev").alias("p"), none.alias("n"), "w"))
            .unionByName(gone.select(F.col("prev").alias("id"), none.alias("prev"), none.alias("next"), none.alias("p"), F.col("next").alias("n"), zero.alias("w")))
        )
        level = materialise(
            told.groupBy("id").agg(
                F.coalesce(F.max("p"), F.max("prev")).alias("prev"),
                F.coalesce(F.max("n"), F.max("next")).alias("next"),
                F.sum("w").alias("w"),
            ),
            "list",
        )
    known = materialise(level.select("id", "prev", "next", "w").coalesce(1).mapInArrow(_walk, "id long, pos long"), "ranks")
    for gone in reversed(taken):
        at = known.select(F.col("id").alias("prev"), F.col("pos").alias("from"))
        known = materialise(
            known.unionByName(gone.join(at, "prev").select("id", (F.col("from") + F.col("w")).alias("pos"))), "ranks"
        )
    return known


def _below(family: DataFrame, small: int) -> DataFrame:
    """(no, enter, exit, n_leaves, saved_tokens): positions and subtree sums of every node."""
    leaf = (F.col("n_children") == 0).cast("long")
    ranks = list_rank(tour(family), small).withColumn("no", F.shiftright("id", 1))
    entering = F.col("id") % 2 == 0
    weighted = ranks.join(family.select("no", leaf.alias("leaf"), "saved"), "no").select(
        "no", "pos", entering.alias("entering"), "leaf", "saved"
    )
    placed = running(
        cut(weighted, [], ["pos"], "arcs"),
        [],
        ["pos"],
        leaves=("sum", F.when(F.col("entering"), F.col("leaf")).otherwise(0)),
        spared=("sum", F.when(F.col("entering"), F.col("saved")).otherwise(0)),
    )
    sign = F.when(F.col("entering"), -1).otherwise(1)
    return placed.groupBy("no").agg(
        F.min("pos").alias("enter"),
        F.max("pos").alias("exit"),
        (F.sum(sign * F.col("leaves")) + F.min("leaf")).alias("n_leaves"),
        (F.sum(sign * F.col("spared")) + F.min("saved")).alias("saved_tokens"),
    )


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node of texts that arrive in order; only the state of the hash is held."""
    now, state = None, None

    def row() -> pa.RecordBatch:
        values = [[v] for v in (*now, state.hexdigest())]
        types = [pa.int64()] * 3 + [pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(values, types, strict=True)], names=[*NAME, "ends_sha256"]
        )

    for batch in batches:
        for *name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if name != now:
                if now is not None:
                    yield row()
                now, state = name, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
    if now is not None:
        yield row()


def _ends(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """(depth, f1, f2, ends_sha256) of the nodes at which conversations end.

    Up to 2^RUN neighbouring ids make one text. A node with several texts needs one
    hash over all of them, in order: they run through it one after the other.
    """
    last = steps.groupBy("conv").agg(F.max(F.struct(*NAME)).alias("end"))
    zero = F.lit(0).cast("long")
    ends = convs.join(last, "conv", "left").select("conv", *[F.coalesce(f"end.{c}", zero).alias(c) for c in NAME])
    texts = materialise(
        ends.groupBy(*NAME, F.shiftright("conv", RUN).alias("run")).agg(
            F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("text")
        ),
        "ends",
    )
    runs = texts.groupBy(*NAME).agg(F.count("*").alias("runs"))
    counted = texts.join(runs, NAME)
    single = counted.where("runs = 1").select(*NAME, F.sha2("text", 256).alias("ends_sha256"))
    several = (
        counted.where("runs > 1")
        .repartition(*NAME)
        .sortWithinPartitions(*NAME, "run")
        .select(*NAME, "text")
        .mapInArrow(_hash_runs, "depth long, f1 long, f2 long, ends_sha256 string")
    )
    return single.unionByName(several)


def prefix_trie(turns: DataFrame, convs: DataFrame, small: int = SMALL) -> DataFrame:
    """One row per node of the trie of the sequences in ``turns`` (conv, r, d1, d2, chars;
    r orders a conversation's turns) of the conversations ``convs`` (conv).

    conv_id is the smallest member, parent_conv_id the parent's; enter and exit are the
    positions of the node's arcs in the tour.
    """
    steps = _steps(turns)
    family = _family(_nodes(steps, convs))
    return (
        family.join(_below(family, small), "no")
        .join(_ends(steps, convs), NAME, "left")
        .select(
            "conv_id",
            "depth",
            F.col("parent_conv").alias("parent_conv_id"),
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
            "enter",
            "exit",
        )
    )
