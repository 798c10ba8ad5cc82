"""Places and running totals in the order of a key, however large a key's group is.

A table is cut by range of (key, order) into parts and written. Totals run inside
each (part, key) first; what a key holds in earlier parts is then added. A part
starts in the middle of one key at most, so there are fewer such additions than
parts, and they are sent to every task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import materialise

_TOTAL = {"sum": F.sum, "xor": F.bit_xor, "max": F.max}


def _joined(kind: str, here: Column, earlier: Column) -> Column:
    if kind == "sum":
        return here + F.coalesce(earlier, F.lit(0))
    if kind == "xor":
        return here.bitwiseXOR(F.coalesce(earlier, F.lit(0)))
    return F.greatest(here, earlier)


def cut(df: DataFrame, key: list[str], order: list[str], label: str) -> DataFrame:
    """``df`` written in parts that follow each other by (key, order), nulls first;
    ``part`` is the number of a row's part."""
    return materialise(
        df.repartitionByRange(*key, *order).withColumn("part", F.spark_partition_id()), label
    )


def running(
    rows: DataFrame, key: list[str], order: list[str], **totals: tuple[str, Column]
) -> DataFrame:
    """Add totals that run through each key in the given order, the row itself included.

    ``rows`` is from ``cut`` by the same key and order. A total is (kind, value) with the
    kinds sum, xor (of longs) and max; values are not null but for max, where nulls count
    for nothing. Rows of one place get their totals in any order. An empty ``key`` means
    one run through the whole table.
    """
    inside = Window.partitionBy("part", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.groupBy("part", *key).agg(
        *[_TOTAL[kind](value).alias(name) for name, (kind, value) in totals.items()]
    )
    earlier = whole.select(
        F.col("part").alias("_part"),
        *[F.col(k).alias(f"_{k}") for k in key],
        *[_TOTAL[kind](name).over(before).alias(f"_{name}") for name, (kind, _) in totals.items()],
        F.count("*").over(before).alias("_parts"),
    ).where("_parts > 0")
    here = rows.select("*", *[_TOTAL[kind](value).over(inside).alias(name) for name, (kind, value) in totals.items()])
    same = reduce(
        Column.__and__,
        [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key],
        F.col("part") == F.col("_part"),
    )
    given = [c for c in rows.columns if c not in totals]
    return here.join(F.broadcast(earlier), same, "left").select(
        *given, *[_joined(kind, F.col(name), F.col(f"_{name}")).alias(name) for name, (kind, _) in totals.items()]
    )


def neighbours(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``before`` and ``after``: structs of the ``order`` columns of the rows next to
    each row of a table from ``cut``, across parts too; null at both ends."""
    inside = Window.partitionBy("part").orderBy(*order)
    own = F.struct(*order)
    edges = rows.groupBy("part").agg(F.min(own).alias("low"), F.max(own).alias("high"))
    # One row per part.
    parts = Window.orderBy("part")
    beyond = edges.select(
        F.col("part").alias("_part"),
        F.lag("high").over(parts).alias("_before"),
        F.lead("low").over(parts).alias("_after"),
    )
    here = rows.select("*", F.lag(own).over(inside).alias("before"), F.lead(own).over(inside).alias("after"))
    return here.join(F.broadcast(beyond), F.col("part") == F.col("_part")).select(
        *rows.columns,
        F.coalesce("before", "_before").alias("before"),
        F.coalesce("after", "_after").alias("after"),
    )
