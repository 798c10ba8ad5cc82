"""Joins from a large table to a dictionary with one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import materialise

BROADCAST_LIMIT = 256 * 1024 * 1024


def at_most(dictionary: DataFrame, limit: int) -> int:
    """The limit of the session, if that is set, or else the given one."""
    return int(dictionary.sparkSession.conf.get("spark.quire.broadcastLimit", str(limit)))


def fits_broadcast(
    dictionary: DataFrame, row_bytes: int = 64, limit: int | None = None
) -> bool:
    """Whether a written dictionary is small enough to send to every executor.

    Text is measured, not assumed: the bytes of its string columns plus
    ``row_bytes`` a row. The limit is ``spark.quire.broadcastLimit`` if the
    session sets it.
    """
    if limit is None:
        limit = at_most(dictionary, BROADCAST_LIMIT)
    texts = [F.coalesce(F.octet_length(n), F.lit(0)) for n, kind in dictionary.dtypes if kind == "string"]
    size = F.lit(row_bytes).cast("long")
    for text in texts:
        size = size + text
    return (dictionary.agg(F.sum(size)).first()[0] or 0) <= limit


def hot_keys(facts: DataFrame, key: str, tasks: int) -> DataFrame:
    """(key, _salts): keys with more rows than an even task would get, and the
    number of tasks they need. Fewer than ``tasks`` keys can be hot, and the
    salts of all of them add up to less than twice ``tasks``."""
    counts = materialise(
        facts.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")), "key_counts"
    )
    load = F.col("_n") * tasks / F.col("_total")
    return (
        counts.withColumn("_total", counts.agg(F.sum("_n")).scalar())
        .where(load > 1)
        .select(key, F.ceil(load).cast("int").alias("_salts"))
    )


def lookup(
    facts: DataFrame,
    dictionary: DataFrame,
    key: str,
    spread_by: str,
    row_bytes: int = 64,
    how: str = "inner",
    limit: int | None = None,
) -> DataFrame:
    """Join ``facts`` to ``dictionary`` on ``key``.

    Up to ``limit`` bytes (see ``fits_broadcast``) the dictionary is broadcast and the facts stay where
    they are. Beyond that both sides shuffle. One key may hold a third of the
    facts, so keys are counted first and each hot key is spread over as many
    salts as its share of the tasks: a fact takes the salt of its ``spread_by``
    value, the dictionary row of a hot key goes to every salt. Facts without a
    key, which match nothing, are spread over all tasks.
    """
    if fits_broadcast(dictionary, row_bytes, limit):
        return facts.join(F.broadcast(dictionary), key, how)
    tasks = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = materialise(hot_keys(facts, key, tasks), "hot_keys")
    salts = F.when(F.col(key).isNull(), F.lit(tasks)).otherwise(F.coalesce("_salts", F.lit(1)))
    salted = facts.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(spread_by), salts).cast("int")
    )
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    spread = dictionary.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(copies))
    joined = salted.drop("_salts").join(spread.drop("_salts"), [key, "_salt"], how)
    return joined.drop("_salt")
