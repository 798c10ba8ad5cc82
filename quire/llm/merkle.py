"""Merkle manifest of a dataset: digests by group, proofs and their check.

The rows of a group, in the order of an id, are the leaves of a tree in which every
``fan_out`` consecutive nodes have the digest of their digests as parent; the last run
of a level may be shorter. The roots of all groups are the leaves of one more tree.

Levels are built by windows with fixed offsets: on the first leaf below a node the
siblings of that node stand ``k * fan_out^level`` rows away, so ``lag`` and ``lead``
columns, masked by the node's slot in its run and by the length of the run, supply
them, and first children hash parents. Windows run over blocks of
``fan_out^STOREY`` leaves, which no run crosses; the digests of the blocks are the
leaves of the next storey. No group is gathered, and a group of any size is worked on
by as many tasks as it has blocks.

Nulls: a null value counts as ``-``, a null group is a group of its own and comes
first, null ids come first in their group. Rows of one id are ordered by their leaf;
repeated rows are leaves of their own. Empty texts have length 0; a text of any
length is hashed where it is read and only its digest moves. An empty table has an
empty manifest. Other columns are left alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.ordered import cut, running
from quire.session import materialise

#: Levels of one block: 2^8 leaves in a window.
STOREY = 8


def field(value: Column) -> Column:
    """A value of a record: ``-`` for null, else its UTF-8 byte count, ``:`` and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def record(*values: Column) -> Column:
    """Digest of a record, as lowercase hexadecimal text."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _levels(nodes: DataFrame, keys: list[str], fan_out: int, storey: int) -> DataFrame:
    """Add ``block``, ``top`` (the digest of the block, on its first row, else null) and
    ``path``, the siblings left and right of every level of the block that exists.

    ``nodes`` has the keys, ``pos`` and ``digest``. A level with a single node does not
    exist: its node is the first of its key and has no sibling.
    """
    width = fan_out**storey
    block = Window.partitionBy(*keys, "block").orderBy("pos")
    upto = block.rowsBetween(Window.unboundedPreceding, 0)
    df = nodes.withColumn("block", F.expr(f"pos div {width}")).withColumn("top", F.col("digest"))
    for level in range(storey):
        step = fan_out**level
        first = F.col("pos") % step == 0
        slot = F.expr(f"(pos div {step}) % {fan_out}")
        others = range(1, fan_out)
        left = [F.when(slot >= k, F.lag("top", k * step).over(block)) for k in reversed(others)]
        right = [F.when(slot + k < fan_out, F.lead("top", k * step).over(block)) for k in others]
        df = df.withColumn(
            "found",
            F.when(first, F.struct(F.concat_ws("", *left).alias("left"), F.concat_ws("", *right).alias("right"))),
        )
        alone = (F.col("pos") < step) & (F.col("found.right") == "")
        df = df.withColumn("alone", F.when(first, alone)).withColumn(
            f"s{level}", F.when(first & ~F.col("alone"), F.col("found"))
        )
        df = df.withColumn("top", F.when(
            F.col("pos") % (step * fan_out) == 0,
            F.when(F.col("alone"), F.col("top")).otherwise(F.sha2(F.concat("top", "found.right"), 256)),
        ))
        if level:
            # Leaves that are not the first below a node have the node's siblings from there.
            df = df.withColumn(f"s{level}", F.last(f"s{level}", ignorenulls=True).over(upto))
    steps = [f"s{level}" for level in range(storey)]
    return df.withColumn("path", F.array_compact(F.array(*steps))).drop("found", "alone", *steps)


def _tree(leaves: DataFrame, keys: list[str], fan_out: int, storey: int) -> tuple[list[DataFrame], DataFrame]:
    """(the storeys from the leaves up, the root of every key)."""
    storeys = [leaves]
    while True:
        found = _levels(storeys[-1], keys, fan_out, storey).where("top IS NOT NULL")
        nodes = materialise(
            found.select(*keys, F.col("block").alias("pos"), F.col("top").alias("digest")), "storey"
        )
        if not (nodes.agg(F.max("pos")).first()[0] or 0):
            return storeys, nodes
        storeys.append(nodes)


def _paths(
    storeys: list[DataFrame], above: DataFrame, keys: list[str], fan_out: int, storey: int, carried: list[str]
) -> DataFrame:
    """The leaves with ``path`` up to the end of ``above`` and its ``carried`` columns.

    ``above`` has the keys, ``pos``, ``path`` and the carried columns of the blocks over
    the last storey; every row of it belongs to one block of leaves.
    """
    for height, nodes in reversed(list(enumerate(storeys))):
        upper = above.select(
            *keys, F.col("pos").alias("block"), F.col("path").alias("_above"), *carried
        )
        joined = _levels(nodes, keys, fan_out, storey).join(upper, [*keys, "block"])
        above = joined.withColumn("path", F.concat("path", "_above")).drop("_above", "block", "top")
        if height:
            above = materialise(above, "paths")
    return above


def manifest(
    records: DataFrame,
    id_col: str = "doc_id",
    group_col: str = "lang",
    leaf_col: str = "leaf",
    claim_col: str = "claim",
    fan_out: int = 2,
    storey: int = STOREY,
) -> DataFrame:
    """(id, leaf, claim, subroot, root, path) of every record.

    ``leaf`` is the digest that the tree is built from, ``claim`` the one that a holder
    of the record presents (null: the leaf). ``path`` lists, level by level from the leaf
    to the root, the digests of the siblings left and right of the node.
    """
    # A text key that sorts nulls first and all others as the group does.
    named = records.select(
        F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("_group"),
        F.col(id_col).alias("_id"),
        F.col(leaf_col).alias("digest"),
        F.col(claim_col).alias("_claim"),
    )
    order = ["_id", "digest"]
    placed = running(cut(named, ["_group"], order, "records"), ["_group"], order, pos=("sum", F.lit(1)))
    leaves = materialise(placed.withColumn("pos", F.col("pos") - 1).drop("part"), "leaves")
    storeys, subroots = _tree(leaves, ["_group"], fan_out, storey)

    ordered = running(
        cut(subroots.select("_group", "digest"), [], ["_group"], "subroots"), [], ["_group"], pos=("sum", F.lit(1))
    )
    tops = materialise(ordered.withColumn("pos", F.col("pos") - 1).drop("part"), "tops")
    top_storeys, root = _tree(tops, [], fan_out, storey)
    end = root.select("pos", F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
    of_group = _paths(top_storeys, end, [], fan_out, storey, ["root"])
    above = materialise(
        of_group.select("_group", F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root"),
        "groups",
    )
    found = _paths(storeys, above, ["_group"], fan_out, storey, ["subroot", "root"])
    return found.select(
        F.col("_id").alias(id_col),
        F.col("digest").alias("leaf"),
        F.coalesce("_claim", "digest").alias("claim"),
        "subroot",
        "root",
        "path",
    )


_PATH = "array<struct<left:string,right:string>>"


def proof(path: Column) -> Column:
    """Digest of all siblings of a path."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(path: Column, leaf: Column) -> Column:
    """The root that follows from a leaf and the siblings of its path."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))
