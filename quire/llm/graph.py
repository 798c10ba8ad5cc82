"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, root): every node of the links (a, b) with the smallest one it reaches.

    Each round takes the smallest label among neighbours and then the label of
    that label, so the number of rounds is about the logarithm of the longest
    chain. Labels are written after each round; nothing is gathered.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialise(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
            "node", F.least("node", "m").alias("root")
        ),
        "labels",
    )
    while True:
        seen = both.join(labels.withColumnsRenamed({"node": "b"}), "b").select(
            F.col("a").alias("node"), "root"
        )
        lower = labels.unionByName(seen).groupBy("node").agg(F.min("root").alias("root"))
        of_root = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = materialise(
            lower.join(of_root, "root", "left").select(
                "node", F.least("root", F.coalesce("next", "root")).alias("root")
            ),
            "labels",
        )
        changed = jumped.join(labels.select("node", F.col("root").alias("old")), "node").where("root <> old")
        if changed.isEmpty():
            return jumped
        labels = jumped
