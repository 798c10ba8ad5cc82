"""Counts, distinct values and per-group summaries of the corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import scalars
from quire.operators.papers import exploded_authors, with_doi


def distinct_authors(papers: DataFrame) -> DataFrame:
    return exploded_authors(papers).agg(F.count_distinct("author").alias("n_authors"))


def papers_per_author(papers: DataFrame) -> DataFrame:
    """Occurrences of each author; partial counts are made before the shuffle."""
    return exploded_authors(papers).groupBy("author").agg(F.count("*").alias("n_papers"))


def distinct_journals(papers: DataFrame) -> DataFrame:
    """Journals told apart by DOI prefix."""
    return with_doi(papers).agg(
        F.count_distinct(scalars.doi_prefix(F.col("doi"))).alias("n_journals")
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def n_distinct(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.agg(F.count_distinct(column).alias(name))


def value_counts(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Frequency table, most frequent first; ``n`` keeps the top rows."""
    counts = (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), column)
    )
    return counts if n is None else counts.limit(n)


def group_non_null(df: DataFrame, key: str) -> DataFrame:
    """Non-null values of every other column per group."""
    return df.groupBy(key).agg(*[F.count(c).alias(c) for c in df.columns if c != key])


def group_sum(df: DataFrame, key: str, value: str, *more_keys: str) -> DataFrame:
    return df.groupBy(key, *more_keys).agg(F.sum(value).alias(value))


def authors_by_category(papers: DataFrame) -> DataFrame:
    """The author set of each category, one row per member.

    A category may hold a third of all papers, so its set is kept as rows
    rather than gathered into a single array value.
    """
    return exploded_authors(papers, "general_category").distinct()


def authors_per_category(papers: DataFrame) -> DataFrame:
    return (
        authors_by_category(papers)
        .groupBy("general_category")
        .agg(F.count("*").alias("n_authors"))
    )


#: log2 of a sketch's registers; the standard error of a count is about 1.04 / 2^(LOG / 2).
LOG_REGISTERS = 12


def author_sketches(papers: DataFrame, log_registers: int = LOG_REGISTERS) -> DataFrame:
    """(year, general_category, sketch): mergeable sketches of the authors, one small row per
    group, however many papers it has. Write them once; later papers add their own rows.
    Null years and categories are groups of their own."""
    authors = exploded_authors(papers, "update_date", "general_category")
    return (
        authors.withColumn("year", scalars.year_of(F.col("update_date")))
        .groupBy("year", "general_category")
        .agg(F.hll_sketch_agg("author", F.lit(log_registers)).alias("sketch"))
    )


def sketched_authors(sketches: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_authors): estimated distinct authors per group, or over all without keys, from
    sketches alone. Sketches of one author in several groups count that author once."""
    merged = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    return sketches.groupBy(*keys).agg(merged.alias("n_authors"))


def label_counts(df: DataFrame, label: str, part: str = "split") -> DataFrame:
    return df.groupBy(part, label).agg(F.count("*").alias("n"))


def max_tokens(df: DataFrame, tokens: str) -> DataFrame:
    return df.agg(F.max(F.size(tokens)).alias("max_tokens"))


def mean_metrics(batches: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Plain mean over batches, whatever their size."""
    return batches.agg(*[F.avg(m).alias(m) for m in metrics])


def to_wide(counts: DataFrame, key: str, columns: Sequence, column: str = "year", value: str = "count") -> DataFrame:
    """One row per key, one value column per listed ``columns`` entry; absent
    pairs are null."""
    return counts.groupBy(key).pivot(column, list(columns)).agg(F.sum(value))


def to_long(wide: DataFrame, key: str, column: str = "year", value: str = "count") -> DataFrame:
    """The reverse; nulls are kept."""
    return wide.unpivot([key], [c for c in wide.columns if c != key], column, value)


def transpose(wide: DataFrame, key: str, keys: Sequence, column: str = "year") -> DataFrame:
    """Swap rows and columns; ``keys`` are the row labels that become columns."""
    return to_wide(to_long(wide, key, column), column, keys, key)
