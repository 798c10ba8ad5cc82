"""TF-IDF with smoothed idf and unit-length rows.

``idf = ln((1 + n) / (1 + df)) + 1``, so a term in every document keeps weight 1,
and each document's weights have Euclidean length 1.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.grams import bits_of, gram_frequencies, weigh
from quire.operators.lookup import fits_broadcast, lookup
from quire.operators.ordering import dense_position, top_n_per_group
from quire.operators.tokens import exploded, term_counts
from quire.session import discard, materialise, settled


@dataclass
class TfidfModel:
    """``terms`` is a written table (term, idx, df, idf) of n-grams of ``ngrams`` tokens."""

    terms: DataFrame
    id_col: str = "id"
    tokens: str = "tokens"
    ngrams: tuple[int, int] = (1, 1)

    def transform(self, docs: DataFrame) -> DataFrame:
        """(id, term, idx, tfidf) in long form; unseen terms have no row."""
        terms = self.terms.select("term", "idx", "idf")
        if self.ngrams != (1, 1):
            return weigh(docs, terms, self.tokens, self.id_col, self.ngrams)
        # The tokens are dealt out by document once, as arrays; counting, the norm and (if
        # the terms are sent to every task) the lookup then find them where they are.
        docs = docs.select(self.id_col, self.tokens).repartition(self.id_col)
        if fits_broadcast(terms):
            known = lookup(exploded(docs, self.tokens, self.id_col), terms, "term", self.id_col)
            counts = known.groupBy(self.id_col, "term", "idx", "idf").agg(F.count("*").alias("tf"))
        else:
            counted = term_counts(docs, self.tokens, self.id_col)
            counts = lookup(counted, terms, "term", self.id_col)
        raw = counts.withColumn("raw", F.col("tf") * F.col("idf"))
        length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(self.id_col)))
        return raw.select(self.id_col, "term", "idx", (F.col("raw") / length).alias("tfidf"))

    def vectorizer(self, out: str = "features") -> PipelineModel:
        """The same weights as MLlib vectors, row by row and without a shuffle.

        For model training only: a linear model's coefficients live in the
        driver, and so does this vocabulary. ``min_df`` sets its size.
        """
        rows = self.terms.orderBy("idx").select("term", "idf").collect()
        count = CountVectorizerModel.from_vocabulary(
            [row.term for row in rows], inputCol=self.tokens, outputCol="_tf"
        )
        scale = ElementwiseProduct(
            scalingVec=Vectors.dense([row.idf for row in rows]), inputCol="_tf", outputCol="_raw"
        )
        unit = Normalizer(p=2.0, inputCol="_raw", outputCol=out)
        return PipelineModel(stages=[count, scale, unit])


def _frequencies(docs: DataFrame, tokens: str, sizes: tuple[int, int], enough) -> DataFrame:
    """(term, df) of the n-grams; of longer ones only those that can pass ``enough``.

    An n-gram is in no more documents than its first and its last n - 1 tokens. So sizes are
    counted one after the other, and an n-gram is only counted if both its parts may be
    frequent, which is looked up in place before anything is moved.
    """
    low, high = sizes
    found = exploded(docs, F.array_distinct(tokens)).groupBy("term").agg(F.count("*").alias("df"))
    if high == 1:
        return found
    levels = [materialise(enough(found).select("term", "df"), "frequent")]
    for size in range(2, high + 1):
        found = gram_frequencies(docs, tokens, size, bits_of(levels[-1]))
        levels.append(materialise(enough(found).select("term", "df"), "frequent"))
    out = levels[low - 1]
    for level in levels[low:]:
        out = out.unionByName(level)
    return out


def fit_tfidf(
    docs: DataFrame,
    min_df: int | float = 1,
    max_df: int | float = 1.0,
    id_col: str = "id",
    tokens: str = "tokens",
    ngrams: tuple[int, int] = (1, 1),
) -> TfidfModel:
    """Learn vocabulary and idf from (id, tokens).

    ``min_df`` and ``max_df`` are counts if they are ints and shares of the
    documents if they are floats; both bounds are kept. With ``ngrams`` (low, high) the
    terms are runs of so many tokens. The result is written to the scratch folder.
    """
    n_docs = docs.agg(F.count("*")).scalar()

    def bound(value):
        return F.lit(value) if isinstance(value, int) else F.lit(value) * F.col("n_docs")

    def kept() -> DataFrame:
        freq = _frequencies(docs, tokens, ngrams, lambda df: df.withColumn("n_docs", n_docs).where(F.col("df") >= bound(min_df)))
        return (
            freq.withColumn("n_docs", n_docs)
            .where((F.col("df") >= bound(min_df)) & (F.col("df") <= bound(max_df)))
            .select(
                "term",
                "df",
                (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"),
            )
        )

    # Numbering reads its input several times, so the counts are written first.
    counted = settled(kept, "frequencies")
    terms = materialise(dense_position(counted, "term", "idx").select("term", "idx", "df", "idf"), "tfidf")
    discard(counted)
    return TfidfModel(terms, id_col, tokens, ngrams)


def matrix_minimum(weights: DataFrame, docs: DataFrame) -> DataFrame:
    """(n_docs, n_terms, min_tfidf): smallest cell of the dense matrix, which is
    never built: it is 0 as soon as one document lacks one term."""
    stats = weights.agg(
        F.count("*").alias("cells"),
        F.count_distinct("term").alias("n_terms"),
        F.min("tfidf").alias("low"),
    )
    n_docs = docs.agg(F.count("*")).scalar()
    return stats.withColumn("n_docs", n_docs).select(
        "n_docs",
        "n_terms",
        F.when(F.col("cells") < F.col("n_docs") * F.col("n_terms"), F.lit(0.0))
        .otherwise(F.col("low"))
        .alias("min_tfidf"),
    )


def top_terms(weights: DataFrame, n: int) -> DataFrame:
    """The ``n`` terms with the largest summed weight."""
    return (
        weights.groupBy("term")
        .agg(F.sum("tfidf").alias("weight"))
        .orderBy(F.desc("weight"), "term")
        .limit(n)
    )


def cluster_terms(
    weights: DataFrame, clusters: DataFrame, n: int = 15, id_col: str = "id"
) -> DataFrame:
    """(cluster, term, weight, rank): top terms per cluster by summed weight."""
    sums = (
        lookup(weights, clusters.select(id_col, "cluster"), id_col, "term")
        .groupBy("cluster", "term")
        .agg(F.sum("tfidf").alias("weight"))
    )
    return top_n_per_group(sums, "cluster", "weight", "term", n)
