"""Yearly counts, top lists per year and the series behind the trend charts.

The functions on counts read them several times: pass a written table (see
``quire.session.materialise``), so that the corpus is cleaned and counted once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire import constants as K
from quire.functions import scalars
from quire.operators.joins import select_series
from quire.operators.ordering import top_n_per_group
from quire.operators.papers import exploded_authors, with_trend_year
from quire.operators.tokens import exploded


def year_categories(papers: DataFrame) -> DataFrame:
    return (
        with_trend_year(papers)
        .where(F.col("general_category") != "")
        .groupBy("year", "general_category")
        .agg(F.count("*").alias("count"))
    )


def year_authors(papers: DataFrame) -> DataFrame:
    return (
        exploded_authors(with_trend_year(papers), "year")
        .groupBy("year", "author")
        .agg(F.count("*").alias("count"))
    )


def year_words(papers: DataFrame) -> DataFrame:
    """Occurrences of each abstract word per year, case kept."""
    return (
        exploded(with_trend_year(papers), scalars.words(F.col("abstract")), "year", name="word")
        .groupBy("year", "word")
        .agg(F.count("*").alias("count"))
    )


def top_authors_per_year(counts: DataFrame, k: int = K.TOP_AUTHORS) -> DataFrame:
    """The ``k`` most frequent authors of each year, ties by name.

    A year with fewer than ``k`` authors gives fewer rows: no author with a count
    of 0 is listed to fill it up.
    """
    return top_n_per_group(counts, "year", "count", "author", k)


def rank_categories_per_year(counts: DataFrame) -> DataFrame:
    """Every category in every year; one that is absent counts as 0."""
    filled = complete_series(counts, "general_category").withColumn(
        "count", F.coalesce("count", F.lit(0))
    )
    return top_n_per_group(filled, "year", "count", "general_category")


def pooled_top(counts: DataFrame, k: int = K.TOP_AUTHORS) -> DataFrame:
    """Authors that are among the top ``k`` of at least one year."""
    return top_authors_per_year(counts, k).select("author").distinct()


def complete_series(counts: DataFrame, key: str) -> DataFrame:
    """(year, key, count) for every year and key that occur; absent is null.

    The list of years is short, so each key carries it as an array.
    """
    years = counts.select("year").distinct().agg(F.sort_array(F.collect_list("year"))).scalar()
    grid = counts.select(key).distinct().withColumn("_years", years).select(
        key, F.explode("_years").alias("year")
    )
    return grid.join(counts, ["year", key], "left").select("year", key, "count")


def top_author_series(counts: DataFrame, k: int = K.TOP_AUTHORS) -> DataFrame:
    """The series behind the author chart: pooled top authors in all years.

    Every year has a top author, so the chosen rows alone name all years.
    """
    chosen = select_series(counts, pooled_top(counts, k), "author")
    return complete_series(chosen, "author").orderBy("year", "author")


def category_series(counts: DataFrame) -> DataFrame:
    """The series behind the category chart, in year order."""
    return complete_series(counts, "general_category").orderBy("year", "general_category")
