"""Positions, cut-offs, splits, samples and batches without a single-task sort.

Row identity is always an explicit id column; position means place in id order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.constants import TEST_SEED, TEST_SHARE
from quire.session import materialise

_PREFIX = 4  # hexadecimal digits of the hash that name one of 65,536 slices


def id_hash(id_col: str | Column, seed: int) -> Column:
    """Reproducible pseudo-random order key: md5 of seed and id."""
    value = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), value.cast("string")))


def hash_cutoff(df: DataFrame, id_col: str, seed: int, wanted) -> Column:
    """The ``wanted(total)``-th smallest id hash, as a scalar subquery.

    Hashes are uniform, so counting them per leading digits gives 65,536 even
    slices; only the one slice that holds the cut-off is ranked. No row of
    ``df`` besides its id is moved. Null ids have no hash and are not counted.
    """
    hashed = df.where(F.col(id_col).isNotNull()).select(id_hash(id_col, seed).alias("h"))
    slices = hashed.groupBy(F.left("h", F.lit(_PREFIX)).alias("slice")).agg(
        F.count("*").alias("n")
    )
    # At most 65,536 rows reach these two windows, whatever the input size.
    running = slices.select(
        "slice",
        "n",
        F.sum("n").over(Window.orderBy("slice")).alias("upto"),
        F.sum("n").over(Window.partitionBy()).alias("total"),
    ).withColumn("wanted", wanted(F.col("total")).cast("bigint"))
    cut = running.where(
        (F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("n") < F.col("wanted"))
    ).select("slice", (F.col("wanted") - F.col("upto") + F.col("n")).alias("place"))
    place = (
        hashed.join(F.broadcast(cut), F.left("h", F.lit(_PREFIX)) == F.col("slice"))
        .withColumn("r", F.row_number().over(Window.partitionBy("slice").orderBy("h")))
        .where("r = place")
    )
    return place.agg(F.max("h")).scalar()


def split_flag(
    df: DataFrame, id_col: str = "id", test: float = TEST_SHARE, seed: int = TEST_SEED
) -> DataFrame:
    """Add ``is_test``: true for exactly ``ceil(test * rows)`` of the rows with an id.
    Rows with a null id can't be drawn and stay in the training part.

    The rows with the smallest id hashes form the test part, so the split does
    not depend on partitioning and both parts together are the whole table.
    """
    cutoff = hash_cutoff(df, id_col, seed, lambda n: F.ceil(n * F.lit(test)))
    return df.withColumn(
        "is_test", F.coalesce(id_hash(id_col, seed) <= cutoff, F.lit(False))
    )


def split(
    df: DataFrame, id_col: str = "id", test: float = TEST_SHARE, seed: int = TEST_SEED
) -> tuple[DataFrame, DataFrame]:
    """(train, test), disjoint and complete."""
    flagged = split_flag(df, id_col, test, seed)
    return (
        flagged.where(~F.col("is_test")).drop("is_test"),
        flagged.where("is_test").drop("is_test"),
    )


def sample_n(df: DataFrame, n: int, seed: int, id_col: str = "id") -> DataFrame:
    """``n`` random rows without replacement (all if there are fewer) of those with an id."""
    cutoff = hash_cutoff(df, id_col, seed, lambda total: F.least(total, F.lit(n)))
    return df.where(id_hash(id_col, seed) <= cutoff)


def first_n(df: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    """The ``n`` rows with the smallest ids; null ids come last and are never taken.

    Only ids take part in the top-n; wide rows are filtered where they are. If
    the last id is repeated, only as many of its rows are taken as are wanted: those
    with the smallest hashes of the whole row, so that a rerun takes the same.
    """
    ids = df.where(F.col(id_col).isNotNull()).select(id_col).orderBy(id_col).limit(n)
    last = ids.groupBy(id_col).agg(F.count("*").alias("n")).orderBy(F.desc(id_col)).first()
    if last is None:
        return df.limit(0)
    whole = F.xxhash64(*[F.to_json(F.struct(f"`{c}`")) for c in df.columns])
    at_last = df.where(F.col(id_col) == last[0]).orderBy(whole).limit(last["n"])
    return df.where(F.col(id_col) < last[0]).unionByName(at_last)


def head(df: DataFrame, n: int = 5, id_col: str = "id") -> DataFrame:
    return df.orderBy(id_col).limit(n)


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    """Rows in a random order."""
    return df.orderBy(F.rand(seed))


#: Steps after which a place must lie in the range (see ``epoch_place``).
_WALK = 64


def epoch_place(position: str, n: int, epoch: int, seed: int = 5, rounds: int = 4) -> Column:
    """The place of a row in the order of an epoch: a permutation of 0 .. n - 1.

    A keyed Feistel network on pairs of digits (of bases a and b, both about the root of n)
    turns each dense position into its place without moving a row, so an epoch needs no sort;
    equal arguments give the same order. Pairs beyond n are sent on until they fall inside;
    there are fewer than a of them, so small n need at most a steps, and with large n a
    row needs more than ``_WALK`` with a chance of 1 in n^32 (it would raise an error).
    """
    if n <= 1:
        return F.col(position) * 0
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)

    def turned(x: Column) -> Column:
        left, right = F.floor(x / b).cast("long"), x % b
        for k in range(rounds):
            if k % 2:
                right = F.pmod(right + F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), F.lit(k), left), F.lit(b)), F.lit(b))
            else:
                left = F.pmod(left + F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), F.lit(k), right), F.lit(a)), F.lit(a))
        return left * b + right

    steps = F.sequence(F.lit(1), F.lit(max(1, min(a, _WALK))))
    start = turned(F.col(position).cast("long"))
    place = F.aggregate(steps, start, lambda x, _: F.when(x < n, x).otherwise(turned(x)))
    return F.when(place < n, place).otherwise(F.raise_error(F.lit("no place found")).cast("long"))


def epoch_order(df: DataFrame, id_col: str, epoch: int, seed: int = 5, name: str = "place") -> DataFrame:
    """Add the place of each row in a random order of the epoch, by dense positions."""
    placed = materialise(dense_position(df, id_col, "_position"), "positions")
    return placed.withColumn(name, epoch_place("_position", placed.count(), epoch, seed)).drop("_position")


def bucket_of(value: str, borders: str, most: int) -> Column:
    """How many of the sorted ``borders``, ``most`` at most, do not exceed the value.

    A search by halving steps: with 2,000 borders a row takes 11 comparisons.
    Declared free of nulls, or a join on the bucket would make the planner test
    it for null on every input row.
    """
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(most, 1).bit_length()))])
    found = F.aggregate(
        steps,
        F.lit(0),
        lambda place, step: F.when(
            F.get(borders, place + step - 1) <= F.col(value), place + step
        ).otherwise(place),
    )
    return F.coalesce(found, F.lit(0))


def dense_position(df: DataFrame, key: str, name: str = "position") -> DataFrame:
    """Add the zero-based place of each row in the order of a unique ``key``.

    A few keys, picked by hash, cut the key range into as many buckets as there
    are shuffle partitions. Rows are numbered inside their bucket and shifted by
    the number of rows in the buckets before; the cut keys affect only balance.
    """
    cuts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1
    picked = df.select(key).orderBy(F.xxhash64(key)).limit(max(cuts, 1))
    borders = picked.agg(F.sort_array(F.collect_set(key))).scalar()
    bucketed = (
        df.withColumn("_borders", borders)
        .withColumn("_bucket", bucket_of(key, "_borders", cuts))
        .drop("_borders")
    )
    # One row per bucket, so this window stays small. A map and not a join on the bucket: the
    # planner would move a filter on the bucket's expression to a side without the key.
    shifts = (
        bucketed.groupBy("_bucket")
        .agg(F.count("*").alias("_n"))
        .select(
            "_bucket",
            (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_shift"),
        )
        .agg(F.map_from_entries(F.collect_list(F.struct("_bucket", "_shift"))))
        .scalar()
    )
    placed = bucketed.withColumn(
        "_row", F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    )
    return (
        placed.withColumn("_shifts", shifts)
        .withColumn(name, F.element_at("_shifts", F.col("_bucket")) + F.col("_row") - 1)
        .drop("_bucket", "_row", "_shifts")
    )


def assign_batch(df: DataFrame, size: int = 8, id_col: str = "id") -> DataFrame:
    """Add ``batch``: consecutive groups of ``size`` rows in id order."""
    return (
        dense_position(df, id_col, "_position")
        .withColumn("batch", F.floor(F.col("_position") / size).cast("bigint"))
        .drop("_position")
    )


def top_n_per_group(
    df: DataFrame, group: str, value: str, tie: str, n: int | None = None, name: str = "rank"
) -> DataFrame:
    """Rank rows inside each group by falling ``value``; keep ``n`` if given.

    With a limit Spark cuts each task's rows to ``n`` per group before the
    shuffle, so a group with a third of all rows costs no more than another.
    """
    order = Window.partitionBy(group).orderBy(F.desc(value), F.asc(tie))
    ranked = df.withColumn(name, F.row_number().over(order))
    return ranked if n is None else ranked.where(F.col(name) <= n)


def extreme_terms(
    weights: DataFrame,
    group: str,
    term: str,
    value: str,
    n: int = 10,
    skip_max: bool = False,
) -> DataFrame:
    """The ``n`` largest and ``n`` smallest values of each group.

    ``skip_max`` leaves the single largest out and takes the ``n`` after it, as a
    slice that ends before the last does. Ties go to the smaller term.
    """
    down = Window.partitionBy(group).orderBy(F.desc(value), F.asc(term))
    up = Window.partitionBy(group).orderBy(F.asc(value), F.asc(term))
    low_rank = 2 if skip_max else 1
    top = (
        weights.withColumn("rank", F.row_number().over(down))
        .where(F.col("rank").between(low_rank, n + low_rank - 1))
        .withColumn("side", F.lit("top"))
    )
    bottom = (
        weights.withColumn("rank", F.row_number().over(up))
        .where(F.col("rank") <= n)
        .withColumn("side", F.lit("bottom"))
    )
    return top.unionByName(bottom)
