"""Exact numeric and categorical profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.ordering import bucket_of

QUARTILES = (0.25, 0.5, 0.75)


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float] = QUARTILES) -> DataFrame:
    """Quantiles with linear interpolation, as (prob, value) rows.

    Approximate quantiles cut the value range into buckets, and rows are counted
    per bucket before anything moves. That tells which few buckets hold the
    wanted ranks; only their values are counted and ranked. The rough cuts only
    decide how even the buckets are, and no other row is shuffled.
    """
    parts = max(256, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = F.col(column).cast("double")
    values = df.select(x.alias("x")).where(x.isNotNull() & ~F.isnan(x))
    cut_points = [i / parts for i in range(1, parts)]
    borders = values.agg(F.percentile_approx("x", cut_points, 10 * parts)).scalar()
    bucketed = values.withColumn("_borders", borders).select(
        "x", bucket_of("x", "_borders", parts - 1).alias("bucket")
    )
    # One row per bucket.
    whole = Window.partitionBy()
    shifts = (
        bucketed.groupBy("bucket")
        .agg(F.count("*").alias("b"))
        .select(
            "bucket",
            "b",
            (F.sum("b").over(Window.orderBy("bucket")) - F.col("b")).alias("shift"),
            F.sum("b").over(whole).alias("total"),
        )
    )
    held = F.lit(False)
    for p in probs:
        at = F.lit(float(p)) * (F.col("total") - 1)
        for rank in (F.floor(at), F.ceil(at)):
            held = held | rank.between(F.col("shift"), F.col("shift") + F.col("b") - 1)
    running = Window.partitionBy("bucket").orderBy("x")
    ranked = (
        bucketed.join(F.broadcast(shifts.where(held).select("bucket", "shift", "total")), "bucket")
        .groupBy("bucket", "x", "shift", "total")
        .agg(F.count("*").alias("n"))
        .withColumn("upto", F.sum("n").over(running))
        .select(
            "x",
            "total",
            (F.col("shift") + F.col("upto") - F.col("n")).alias("first"),
            (F.col("shift") + F.col("upto") - 1).alias("last"),
        )
    )
    probes = F.array(*[F.lit(float(p)) for p in probs])
    wanted = ranked.select(
        "x", "first", "last", "total", F.explode(probes).alias("prob")
    ).withColumn("at", F.col("prob") * (F.col("total") - 1))
    low, high = F.floor("at"), F.ceil("at")
    return (
        wanted.withColumn("low", F.when(low.between(F.col("first"), F.col("last")), F.col("x")))
        .withColumn("high", F.when(high.between(F.col("first"), F.col("last")), F.col("x")))
        .where(F.col("low").isNotNull() | F.col("high").isNotNull())
        .groupBy("prob")
        .agg(
            F.max("low").alias("low"),
            F.max("high").alias("high"),
            F.max(F.col("at") - low).alias("share"),
        )
        .select("prob", (F.col("low") + (F.col("high") - F.col("low")) * F.col("share")).alias("value"))
    )


def _profile_columns(round_to: int | None, columns: dict) -> list:
    return [
        (value if round_to is None or name == "count" else F.bround(value, round_to)).alias(name)
        for name, value in columns.items()
    ]


def describe_num(df: DataFrame, column: str, round_to: int | None = 2) -> DataFrame:
    """One row: count, mean, sample deviation, min, quartiles, max of any
    numeric column. Nulls are left out."""
    q = exact_quantiles(df, column)
    x = F.col(column).cast("double")
    quartiles = q.agg(
        F.struct(
            *[
                F.max(F.when(F.col("prob") == p, F.col("value"))).alias(f"p{int(p * 100)}")
                for p in QUARTILES
            ]
        )
    ).scalar()
    stats = df.agg(
        F.count(x).alias("count"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )
    columns = {name: F.col(name) for name in ("count", "mean", "std", "min")}
    columns |= {f"p{int(p * 100)}": F.col(f"q.p{int(p * 100)}") for p in QUARTILES}
    columns |= {"max": F.col("max")}
    return stats.withColumn("q", quartiles).select(*_profile_columns(round_to, columns))


def describe_counts(df: DataFrame, column: str, round_to: int | None = 2) -> DataFrame:
    """The same profile for a column of counts (words per text, papers per
    category). Such a column has few distinct values, so they are counted first
    and the quartiles come from one weighted aggregate over those."""
    x = F.col(column)
    weighted = df.where(x.isNotNull()).groupBy(x.cast("double").alias("x")).agg(
        F.count("*").alias("n")
    )
    n, total = F.sum("n"), F.sum(F.col("x") * F.col("n"))
    square = F.sum(F.col("x") * F.col("x") * F.col("n"))
    quartile = F.percentile("x", list(QUARTILES), F.col("n"))
    stats = weighted.agg(
        n.alias("count"),
        (total / n).alias("mean"),
        F.when(n > 1, F.sqrt(F.greatest((square - total * total / n) / (n - 1), F.lit(0.0)))).alias("std"),
        F.min("x").alias("min"),
        quartile.alias("q"),
        F.max("x").alias("max"),
    )
    columns = {name: F.col(name) for name in ("count", "mean", "std", "min")}
    columns |= {f"p{int(p * 100)}": F.get("q", F.lit(i)) for i, p in enumerate(QUARTILES)}
    columns |= {"max": F.col("max")}
    return stats.select(*_profile_columns(round_to, columns))


def describe_cat(df: DataFrame, column: str) -> DataFrame:
    """One row: non-null count, distinct values, most frequent value (the
    smallest on a tie) and its count."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    # The most frequent value is the smallest (-n, value).
    first = F.min(F.struct((-F.col("n")).alias("minus"), F.col(column).alias("top")))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("count"), F.count("*").alias("unique"), first.alias("first")
    ).select("count", "unique", F.col("first.top").alias("top"), (-F.col("first.minus")).alias("freq"))
