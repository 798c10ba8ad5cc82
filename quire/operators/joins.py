"""Membership joins, label lookups and row alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.constants import NON_PERSON_NAMES
from quire.operators.lookup import lookup
from quire.operators.ordering import dense_position
from quire.session import materialise


def known_categories(papers: DataFrame, dimension: DataFrame) -> DataFrame:
    return papers.join(
        dimension.select(F.col("code").alias("categories")), "categories", "left_semi"
    )


def unknown_categories(papers: DataFrame, dimension: DataFrame) -> DataFrame:
    """Codes in the data that the dimension lacks."""
    found = papers.select(F.col("categories").alias("code")).distinct()
    return found.join(dimension.select("code"), "code", "left_anti")


def unused_categories(papers: DataFrame, dimension: DataFrame) -> DataFrame:
    """Codes of the dimension that no paper carries."""
    found = papers.select(F.col("categories").alias("code")).distinct()
    return dimension.select("code").distinct().join(found, "code", "left_anti")


def exclude_names(
    df: DataFrame,
    excluded: Sequence[str] = tuple(NON_PERSON_NAMES),
    column: str = "author",
    strict: bool = False,
) -> DataFrame:
    """Drop rows whose name is listed.

    ``strict`` fails when a listed name does not occur, as dropping a missing
    row label does. The list is a parameter held in the driver, so it travels
    as a broadcast.
    """
    spark = df.sparkSession
    listed = spark.createDataFrame([(name,) for name in excluded], f"{column} string")
    if strict:
        missing = listed.join(df.select(column), column, "left_anti").orderBy(column).take(1)
        if missing:
            raise KeyError(missing[0][0])
    return df.join(F.broadcast(listed), column, "left_anti")


def label_dim(df: DataFrame, label: str) -> DataFrame:
    """(label, idx): place of each class in the sorted list, for any number of classes."""
    # Numbering reads its input several times, so the classes are written first.
    distinct = materialise(df.select(F.col(label).alias("label")).where("label IS NOT NULL").distinct(), "classes")
    return dense_position(distinct, "label", "idx").select("label", F.col("idx").cast("int").alias("idx"))


def label_index(
    df: DataFrame, label: str, fitted_on: DataFrame, name: str = "label_idx", spread_by: str | None = None
) -> DataFrame:
    """Add the class index; a class that ``fitted_on`` lacks is an error.

    The classes are a dictionary: sent to every task while it is small, joined by a
    shuffle beyond that, where a class with very many rows is spread by the values
    of ``spread_by`` (the first column if not given).
    """
    dim = materialise(label_dim(fitted_on, label), "labels").select(
        F.col("label").alias(label), F.col("idx").alias("_place")
    )
    found = lookup(df, dim, label, spread_by or df.columns[0], how="left")
    place = F.when(
        F.col(label).isNotNull() & F.col("_place").isNull(),
        F.raise_error(F.concat(F.lit("unknown class: "), F.col(label).cast("string"))).cast("int"),
    ).otherwise(F.col("_place"))
    return found.select(*df.columns, place.alias(name))


def align(left: DataFrame, right: DataFrame, id_col: str = "id") -> DataFrame:
    """Put the columns of two tables side by side by row id, keeping all rows."""
    return left.join(right, id_col, "full")


def select_series(counts: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return counts.join(keys.select(key), key, "left_semi")


def pair(predictions: DataFrame, truth: DataFrame, id_col: str = "id") -> DataFrame:
    """Predictions next to the true labels of the same row."""
    return predictions.join(truth, id_col)


def all_labels(left: DataFrame, right: DataFrame, label: str) -> DataFrame:
    """Distinct classes of two tables."""
    return left.select(label).distinct().unionByName(right.select(label).distinct()).distinct()


def union_batches(*batches: DataFrame) -> DataFrame:
    result = batches[0]
    for batch in batches[1:]:
        result = result.unionByName(batch)
    return result


def fitted_labels(df: DataFrame, label: str) -> DataFrame:
    """A written copy of the label dimension, for use with later data."""
    return materialise(label_dim(df, label), "labels")
