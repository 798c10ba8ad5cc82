"""Queries over vectors: neighbours, and models checked by rows."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import joins, lowrank, models, neighbours, ordering, tfidf
from quire.plans.corpus import SPLIT
from quire.plans.registry import query, table
from quire.plans.textual import documents, stemmed_weights
from quire.session import discard, materialise, scratch_path, settled

NEIGHBOURS = (
    "WITH "
    + SPLIT.format(seed=5, share=0.25, id="vec_id", source="embeddings")
    + """, near AS (SELECT q.vec_id AS query_id, b.vec_id AS base_id, b.label AS vote,
  list_distance(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance
  FROM split q JOIN split b ON q.is_test AND NOT b.is_test),
best AS (SELECT * FROM (SELECT *,
  (row_number() OVER (PARTITION BY query_id ORDER BY distance, base_id))::INTEGER AS rank FROM near)
  WHERE rank <= 5)
"""
)


#: Width of the hash buckets for the given vectors, which have unit variance in 64 places.
WIDTH = 60.0


def _vector_split(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"
    )
    return ordering.split(vectors, "id", 0.25, 5)


@query("J8", NEIGHBOURS + "SELECT query_id, base_id, round(distance, 6) AS distance, rank FROM best")
def knn_join(spark, sf_dir):
    base, queries = _vector_split(spark, sf_dir)
    return neighbours.knn_join(queries, base).withColumn("distance", F.round("distance", 6))


@query(
    "J8 T8",
    NEIGHBOURS
    + """SELECT query_id AS id, vote AS prediction FROM (SELECT query_id, vote,
  row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, vote) AS r
  FROM best GROUP BY query_id, vote) WHERE r = 1""",
)
def knn_classify(spark, sf_dir):
    base, queries = _vector_split(spark, sf_dir)
    return neighbours.knn_classify(queries, base, "label")


@query(
    "J8",
    NEIGHBOURS
    + """SELECT query_id, count(*) AS n_exact, TRUE AS distances_are_true, TRUE AS recall_is_high FROM best GROUP BY query_id""",
)
def knn_approximate(spark, sf_dir):
    """Neighbours by hash tables beside the exact ones: true distances, none nearer than the
    exact neighbour of the same rank, and nine in ten of all found. The vectors have no
    clusters, so the buckets are wide."""
    base, queries = _vector_split(spark, sf_dir)
    exact = materialise(neighbours.knn_join(queries, base), "exact")
    found = materialise(neighbours.knn_approximate(queries, base, width=WIDTH), "found")
    high = neighbours.recall(found, exact).select(F.col("recall") >= 0.9).scalar()
    given = found.select("query_id", "rank", F.col("distance").alias("there"))
    return (
        exact.join(given, ["query_id", "rank"], "left")
        .groupBy("query_id")
        .agg(
            F.count("*").alias("n_exact"),
            F.min(F.coalesce(F.col("there") >= F.col("distance") - 1e-9, F.lit(True))).alias("distances_are_true"),
        )
        .withColumn("recall_is_high", high)
    )


# Models on texts, with the language as the class --------------------------------


def text_features(spark, sf_dir):
    """(train, test, terms) with ``features`` and ``label``, split 75/25.

    The tokens are written once, since the vocabulary and both parts read them.
    """
    docs = documents(spark, sf_dir)
    tokens = docs.select("id", "lang", text.word_tokens(F.col("text")).alias("tokens"))
    labelled = joins.label_index(tokens, "lang", docs, "label")
    written = materialise(labelled, "tokens")
    train, test = ordering.split(written, "id", 0.25, 5)
    model = tfidf.fit_tfidf(train, min_df=0.05)
    rows = models.features(model, ordering.split_flag(written, "id", 0.25, 5), "label", ["is_test"])
    rows = materialise(rows, "features")
    return rows.where("NOT is_test").drop("is_test"), rows.where("is_test").drop("is_test"), model.terms


def _scored(model, test):
    return models.score(model, test).select("id", "label", "prediction")


@query("T9 T20")
def logistic_regression(spark, sf_dir):
    train, test, _ = text_features(spark, sf_dir)
    return _scored(models.logistic_regression(train), test)


@query("T7")
def support_vectors(spark, sf_dir):
    train, test, _ = text_features(spark, sf_dir)
    return _scored(models.support_vectors(train), test)


@query("T10 T11 O7")
def class_terms(spark, sf_dir):
    train, _, terms = text_features(spark, sf_dir)
    return models.class_terms(models.binary_models(train), terms)


@query("T19")
def perceptron(spark, sf_dir):
    """On the given vectors; their labels are unrelated to them."""
    train, test = (
        models.dense_features(part, "vector").withColumn("label", F.col("label").cast("double"))
        for part in _vector_split(spark, sf_dir)
    )
    return _scored(models.perceptron(train, 64, 10), test)


@query("T22")
def training_history(spark, sf_dir):
    train, _, _ = text_features(spark, sf_dir)
    return models.training_history(models.logistic_regression(train))


@query("S13")
def saved_model(spark, sf_dir):
    """Scores of a model that was saved and loaded in between."""
    train, test, _ = text_features(spark, sf_dir)
    path = scratch_path(spark, "model")
    models.logistic_regression(train).write().save(path)
    return _scored(LogisticRegressionModel.load(path), test)


@query(
    "T21",
    """SELECT doc_id AS id, CASE WHEN lang = 'de' THEN 1.0::DOUBLE ELSE 0 END AS de,
  CASE WHEN lang = 'en' THEN 1.0::DOUBLE ELSE 0 END AS en, CASE WHEN lang = 'es' THEN 1.0::DOUBLE ELSE 0 END AS es,
  CASE WHEN lang = 'fr' THEN 1.0::DOUBLE ELSE 0 END AS fr FROM documents""",
)
def one_hot(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    hot = models.one_hot(joins.label_index(docs, "lang", docs, "label"))
    return hot.select("id", *[F.get("one_hot", F.lit(i)).alias(c) for i, c in enumerate(["de", "en", "es", "fr"])])


# Clusters and projections -------------------------------------------------------


def weight_tiles(spark, sf_dir):
    """(ids of the documents, model, written weights, their tiles)."""
    docs, model = stemmed_weights(spark, sf_dir)
    weights = settled(lambda: model.transform(docs).select("id", "idx", "term", "tfidf"), "weights")
    ids = materialise(docs.select("id"), "ids")
    discard(docs)
    return ids, model, weights, lowrank.tiles(weights, ids)


@query("T13 T14")
def kmeans_terms(spark, sf_dir):
    _, _, weights, tiles = weight_tiles(spark, sf_dir)
    _, clusters = lowrank.kmeans(tiles, rounds=2, max_iter=8, tol=1e-3)
    return tfidf.cluster_terms(weights, clusters)


@query("T15 T16")
def svd_terms(spark, sf_dir):
    _, model, _, tiles = weight_tiles(spark, sf_dir)
    basis, _ = lowrank.svd(tiles, 50, tol=1e-3, max_iter=12)
    return lowrank.component_terms(basis, model.terms, 15)


@query("T15 T17")
def project_2d(spark, sf_dir):
    docs, _, weights, tiles = weight_tiles(spark, sf_dir)
    basis, _ = lowrank.svd(tiles, 2, tol=1e-3, max_iter=12)
    _, clusters = lowrank.kmeans(tiles, rounds=2, max_iter=8, tol=1e-3)
    return models.project_2d(models.svd_scores(weights, basis, docs), clusters)
