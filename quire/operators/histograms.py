"""Histograms as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.scalars import clip


def hist_density(df: DataFrame, column: str, bins: int = 149) -> DataFrame:
    """(bin, left, right, n, density) over equal bins from minimum to maximum.

    Bins are closed on the left, the last one on both sides; empty bins stay.
    A value next to a border goes where a comparison with the border puts it,
    and a constant column gets a range of one around its value.
    """
    x = F.col(column).cast("double")
    values = df.select(x.alias("x")).where(x.isNotNull())
    span = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    flat = F.when(F.col("lo") == F.col("hi"), F.lit(0.5)).otherwise(F.lit(0.0))
    span = span.select(
        F.struct((F.col("lo") - flat).alias("lo"), (F.col("hi") + flat).alias("hi"), "n").alias("span")
    ).scalar()

    def border(i, low=F.col("lo"), width=F.col("width")):
        return low + i * width

    located = (
        values.withColumn("span", span)
        .select("x", "span.lo", "span.hi")
        .withColumn("width", (F.col("hi") - F.col("lo")) / bins)
        .withColumn(
            "guess",
            F.least(
                F.lit(bins - 1),
                F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins),
            ),
        )
        .withColumn(
            "bin",
            F.when(F.col("x") < border(F.col("guess")), F.col("guess") - 1)
            .when(
                (F.col("guess") < bins - 1) & (F.col("x") >= border(F.col("guess") + 1)),
                F.col("guess") + 1,
            )
            .otherwise(F.col("guess")),
        )
    )
    # The bin is worked out row by row, so a task hands on one row per bin.
    counts = located.groupBy("bin").agg(F.count("*").alias("n"))
    grid = (
        df.sparkSession.range(bins)
        .select(F.col("id").alias("bin"), span.alias("span"))
        .select("bin", "span.lo", "span.hi", F.col("span.n").alias("total"))
    )
    width = (F.col("hi") - F.col("lo")) / bins
    return (
        grid.withColumn("width", width)
        .join(counts, "bin", "left")
        .select(
            "bin",
            border(F.col("bin")).alias("left"),
            F.when(F.col("bin") == bins - 1, F.col("hi"))
            .otherwise(border(F.col("bin") + 1))
            .alias("right"),
            F.coalesce("n", F.lit(0)).alias("n"),
            (F.coalesce("n", F.lit(0)) / F.col("total") / F.col("width")).alias("density"),
        )
    )


def hist_clipped(df: DataFrame, column: str, top: int = 400, last: int = 300, width: int = 50) -> DataFrame:
    """Counts in bins of ``width`` from 0 to ``last`` after clipping to [0, top].

    The last bin is closed, so what lies above ``last`` falls out, as the chart
    it feeds shows it.
    """
    bins = last // width
    x = clip(F.col(column), 0, top)
    counts = (
        df.where(F.col(column).isNotNull())
        .select(x.alias("x"))
        .where(F.col("x") <= last)
        .select(F.least(F.floor(F.col("x") / width), F.lit(bins - 1)).alias("bin"))
        .groupBy("bin")
        .agg(F.count("*").alias("n"))
    )
    grid = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return grid.join(counts, "bin", "left").select(
        (F.col("bin") * width).alias("left"),
        ((F.col("bin") + 1) * width).alias("right"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def edge_scale(hist: DataFrame) -> DataFrame:
    """Bin edges with their distance from the first, in population deviations."""
    last = hist.agg(F.max("right").alias("edge"))
    edges = hist.select(F.col("left").alias("edge")).unionByName(last)
    lowest, spread = edges.agg(F.min("edge")).scalar(), edges.agg(F.stddev_pop("edge")).scalar()
    return edges.select("edge", ((F.col("edge") - lowest) / spread).alias("scaled"))
