"""Projections, filters and derived columns of the papers table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire import constants as K
from quire.functions import names, scalars
from quire.schemas import PAPER_COLUMNS


def project_papers(raw: DataFrame) -> DataFrame:
    """Rename the record fields and add the general category."""
    return raw.withColumnsRenamed({"authors": "author", "journal-ref": "journal"}).withColumn(
        "general_category", scalars.general_category(F.col("categories"))
    ).select(*PAPER_COLUMNS)


def ingest_filter(
    papers: DataFrame,
    dimension: DataFrame,
    after: int = K.INGEST_AFTER,
    before: int = K.INGEST_BEFORE,
) -> DataFrame:
    """Keep papers whose whole category text is a known code and whose year lies
    strictly between the bounds; a date without a year drops the row."""
    year = scalars.year_of(F.col("update_date"))
    in_range = papers.where((year > after) & (year < before))
    return in_range.join(
        dimension.select(F.col("code").alias("categories")), "categories", "left_semi"
    )


def with_authors(papers: DataFrame) -> DataFrame:
    """Add ``author_clean`` (array of names)."""
    return papers.withColumn("author_clean", names.author_list(F.col("author")))


def with_doi(papers: DataFrame) -> DataFrame:
    return papers.where(F.col("doi").isNotNull())


def with_journal(papers: DataFrame) -> DataFrame:
    return papers.where(F.col("journal").isNotNull())


def with_abstract(papers: DataFrame) -> DataFrame:
    return papers.where(F.col("abstract").isNotNull())


def doi_journal_counts(papers: DataFrame) -> DataFrame:
    has_doi, has_journal = F.col("doi").isNotNull(), F.col("journal").isNotNull()
    return papers.agg(
        F.count("*").alias("n_papers"),
        F.count_if(has_doi).alias("n_doi"),
        F.count_if(has_journal).alias("n_journal"),
        F.count_if(has_doi & has_journal).alias("n_both"),
    )


def min_words(papers: DataFrame, n: int = K.MIN_ABSTRACT_WORDS, text: str = "abstract") -> DataFrame:
    counted = papers.withColumn("n_words", scalars.word_count(F.col(text), null_as_word=True))
    return counted.where(F.col("n_words") >= n)


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def blank_nulls(df: DataFrame) -> DataFrame:
    """Null text becomes empty text; other types stay null, as a text stored in
    a number column would break the declared schema."""
    return df.fillna("")


def training_text(
    papers: DataFrame, columns: Sequence[str] = ("title", "abstract"), name: str = "training_text"
) -> DataFrame:
    """Join text columns without a separator; one null makes the result null."""
    return papers.withColumn(name, F.concat(*columns))


def features_and_label(df: DataFrame, label: str, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Everything but the label, and the label with its row id."""
    return df.drop(label), df.select(id_col, label)


def authors_per_paper(papers: DataFrame) -> DataFrame:
    return with_authors(papers).select("id", F.col("author_clean").alias("authors"))


def exploded_authors(papers: DataFrame, *keep: str) -> DataFrame:
    """One row per paper and author; ``keep`` names further columns to carry.

    The outer form with a filter behind it: with the plain one the planner would
    clean every author string again to test for empty lists."""
    rows = with_authors(papers).select(*keep, F.explode_outer("author_clean").alias("author"))
    return rows.where(F.col("author").isNotNull())


def category_slice(df: DataFrame, category: str, column: str = "general_category") -> DataFrame:
    return df.where(F.col(column) == F.lit(category))


def binary_target(df: DataFrame, category: str, column: str = "general_category") -> DataFrame:
    return df.withColumn("target", (F.col(column) == F.lit(category)).cast("int"))


def cluster_slice(df: DataFrame, cluster: int, column: str = "cluster") -> DataFrame:
    return df.where(F.col(column) == F.lit(cluster))


def with_trend_year(papers: DataFrame, low: int = K.TREND_FROM, high: int = K.TREND_TO) -> DataFrame:
    """Add ``year`` and keep ``low <= year < high``."""
    dated = papers.withColumn("year", scalars.year_matched(F.col("update_date")))
    return dated.where((F.col("year") >= low) & (F.col("year") < high))


def rename_columns(df: DataFrame, names_in_order: Sequence[str]) -> DataFrame:
    return df.toDF(*names_in_order)


def shape(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("n_rows"), F.lit(len(df.columns)).cast("bigint").alias("n_cols")
    )


def peek(df: DataFrame) -> DataFrame:
    """The first record in id order as key and value rows, values as text."""
    first = df.orderBy("id").limit(1)
    as_text = [
        (F.col(f"`{name}`") if kind == "string" else F.to_json(F.col(f"`{name}`"))
         if kind.startswith(("array", "struct", "map")) else F.col(f"`{name}`").cast("string"))
        .alias(name)
        for name, kind in df.dtypes
    ]
    return first.select(*as_text).unpivot([], [f"`{c}`" for c in df.columns], "key", "value")
