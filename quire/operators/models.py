"""Classifiers, clusters and low-rank projections on MLlib.

Training data has ``features`` (vector) and ``label`` (class index as double).
Three of these stand in for solvers Spark does not have and say so.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
from pyspark.ml import Model
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    LogisticRegressionModel,
    MultilayerPerceptronClassifier,
    OneVsRest,
    OneVsRestModel,
)
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import OneHotEncoder
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.constants import CLUSTERS
from quire.operators.ordering import extreme_terms, sample_n, top_n_per_group
from quire.operators.tfidf import TfidfModel
from quire.operators.vectors import vector_width, weighted_sums
from quire.session import materialise


ROWS_PER_TASK = 5_000


@contextmanager
def _training_rows(df: DataFrame) -> Iterator[tuple[DataFrame, int]]:
    """Cached training rows and their number.

    Every step of a solver is one job, so tasks with a handful of rows would
    cost more than they compute: small inputs are merged to ``ROWS_PER_TASK``.
    """
    kept = df.persist()
    rows = kept.count()
    tasks = max(1, -(-rows // ROWS_PER_TASK))
    try:
        yield (kept.coalesce(tasks) if tasks < kept.rdd.getNumPartitions() else kept), rows
    finally:
        kept.unpersist()


def features(
    model: TfidfModel, docs: DataFrame, label: str | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """(id, features[, label]) for MLlib from tokenised documents; ``keep`` names
    further columns to carry."""
    vectors = model.vectorizer().transform(docs)
    columns = [model.id_col, "features", *keep]
    if label is not None:
        vectors = vectors.withColumn("label", F.col(label).cast("double"))
        columns.append("label")
    return vectors.select(*columns)


def dense_features(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))


def logistic_regression(train: DataFrame, max_iter: int = 5000, tol: float = 1e-4) -> LogisticRegressionModel:
    """Multinomial, L2 with inverse strength 1 over the whole sum of losses,
    which is ``1 / rows`` for a mean of losses."""
    with _training_rows(train) as (data, rows):
        return LogisticRegression(
            family="multinomial",
            regParam=1.0 / rows,
            standardization=False,
            maxIter=max_iter,
            tol=tol,
        ).fit(data)


def support_vectors(train: DataFrame, max_iter: int = 100) -> OneVsRestModel:
    """One linear support-vector machine per class. A linear stand-in: Spark has
    no kernel solver, so boundaries differ from an RBF machine's."""
    with _training_rows(train) as (data, rows):
        base = LinearSVC(regParam=1.0 / rows, standardization=False, maxIter=max_iter)
        return OneVsRest(classifier=base, parallelism=4).fit(data)


def binary_models(train: DataFrame, max_iter: int = 5000, tol: float = 1e-4) -> OneVsRestModel:
    """One yes/no logistic model per class, in label order (``.models``)."""
    with _training_rows(train) as (data, rows):
        base = LogisticRegression(
            family="binomial",
            regParam=1.0 / rows,
            standardization=False,
            maxIter=max_iter,
            tol=tol,
        )
        return OneVsRest(classifier=base, parallelism=4).fit(data)


def perceptron(
    train: DataFrame, n_features: int, n_classes: int, hidden: Sequence[int] = (50,), seed: int = 5,
    max_iter: int = 100,
) -> Model:
    """A classifier head with hidden layers on fixed document vectors. The
    encoder below the head is not trained; a head without hidden layers is
    ``logistic_regression``."""
    with _training_rows(train) as (data, _):
        return MultilayerPerceptronClassifier(
            layers=[n_features, *hidden, n_classes], seed=seed, maxIter=max_iter
        ).fit(data)


def score(model: Model, df: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, label, prediction[, scores]) of held-out rows."""
    out = model.transform(df)
    columns = [F.col(id_col)]
    if "label" in out.columns:
        columns.append(F.col("label").cast("int").alias("label"))
    columns.append(F.col("prediction").cast("int").alias("prediction"))
    for name in ("probability", "rawPrediction"):
        if name in out.columns:
            columns.append(vector_to_array(name).alias("scores"))
            break
    return out.select(*columns)


def training_history(model: Model) -> DataFrame:
    """(iteration, loss) of an iterative fit."""
    summary = model.summary() if callable(model.summary) else model.summary
    losses = [(i, float(loss)) for i, loss in enumerate(summary.objectiveHistory)]
    spark = summary.predictions.sparkSession
    return spark.createDataFrame(losses, "iteration int, loss double")


def validated_history(
    train: DataFrame, valid: DataFrame, rounds: Sequence[int] = (1, 2, 4, 8, 16, 32)
) -> DataFrame:
    """(epoch, loss, valid_loss, valid_accuracy) of a logistic regression that is
    stopped after each of these numbers of passes.

    The solver has no randomness, so the stopped fits lie on one path; each costs
    as many passes as it is long.
    """
    rows = []
    for epoch in rounds:
        model = logistic_regression(train, max_iter=epoch, tol=0.0)
        given = F.get(vector_to_array("probability"), F.col("label").cast("int"))
        scored = model.transform(valid).agg(
            F.avg(-F.log(F.greatest(given, F.lit(1e-15)))).alias("loss"),
            F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"),
        )
        history, found = model.summary.objectiveHistory, scored.first()
        rows.append((epoch, float(history[-1]), found["loss"], found["accuracy"]))
    return train.sparkSession.createDataFrame(
        rows, "epoch int, loss double, valid_loss double, valid_accuracy double"
    )


def coefficients(model: OneVsRestModel, terms: DataFrame) -> DataFrame:
    """(cls, term, coef) of every class model and vocabulary term."""
    stacked = np.stack([m.coefficients.toArray() for m in model.models], axis=1)
    spark = terms.sparkSession
    rows = spark.createDataFrame(
        [(i, [float(c) for c in row]) for i, row in enumerate(stacked)],
        "idx bigint, coefs array<double>",
    )
    per_term = terms.select("idx", "term").join(rows, "idx")
    return per_term.select("term", F.posexplode("coefs").alias("cls", "coef"))


def class_terms(
    model: OneVsRestModel, terms: DataFrame, n: int = 10, skip_max: bool = False
) -> DataFrame:
    """(cls, term, coef, positive): the strongest terms for and against."""
    return extreme_terms(coefficients(model, terms), "cls", "term", "coef", n, skip_max).select(
        "cls", "term", "coef", (F.col("coef") > 0).alias("positive")
    )


def kmeans(df: DataFrame, k: int = CLUSTERS, seed: int = 5, max_iter: int = 300) -> tuple[KMeansModel, DataFrame]:
    """Model and (id, cluster) of the training rows."""
    with _training_rows(df) as (data, _):
        model = KMeans(k=k, seed=seed, maxIter=max_iter).fit(data)
    return model, model.transform(df).select("id", F.col("prediction").alias("cluster"))


def one_hot(df: DataFrame, index: str = "label") -> DataFrame:
    """Add ``one_hot``: one place per class, no class left out."""
    encoder = OneHotEncoder(inputCol=index, outputCol="_hot", dropLast=False)
    return encoder.fit(df).transform(df).withColumn("one_hot", vector_to_array("_hot")).drop("_hot")


def svd_basis(df: DataFrame, k: int = 50) -> tuple[DataFrame, list[float]]:
    """((idx, loadings), singular values) of the feature rows, not centred.

    Each component's sign is set so that its largest loading is positive.
    """
    vectors = MLUtils.convertVectorColumnsFromML(df.select("features"), "features")
    with _training_rows(vectors) as (data, _):
        result = RowMatrix(data).computeSVD(k, computeU=False)
        basis = result.V.toArray()
    largest = np.abs(basis).argmax(axis=0)
    signs = np.sign(basis[largest, np.arange(basis.shape[1])])
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(basis * signs)]
    spark = df.sparkSession
    table = spark.createDataFrame(rows, "idx bigint, loadings array<double>")
    return materialise(table, "basis"), [float(v) for v in result.s]


def svd_scores(
    weights: DataFrame, basis: DataFrame, docs: DataFrame, id_col: str = "id"
) -> DataFrame:
    """(id, scores): each document's weights times the loadings of its terms.
    ``docs`` names all documents; one without terms scores 0 everywhere."""
    width = vector_width(basis, "loadings")
    sums = weighted_sums(weights, basis, id_col, "loadings", "tfidf", width)
    zeros = F.array_repeat(F.lit(0.0), width)
    return docs.select(id_col).join(sums, id_col, "left").select(
        id_col, F.coalesce("loadings", zeros).alias("scores")
    )


def component_terms(basis: DataFrame, terms: DataFrame, n: int = 15) -> DataFrame:
    """(component, term, loading, rank): largest loadings of each component."""
    loadings = basis.select("idx", F.posexplode("loadings").alias("component", "loading"))
    named = loadings.join(terms.select("idx", "term"), "idx")
    return top_n_per_group(named.drop("idx"), "component", "loading", "term", n)


def project_2d(
    scores: DataFrame, clusters: DataFrame, n: int = 1000, seed: int = 5, id_col: str = "id"
) -> DataFrame:
    """(id, x, y, cluster) of ``n`` random documents. The plane is that of the
    first two components; no neighbour-embedding solver is run."""
    plane = scores.select(
        id_col, F.get("scores", F.lit(0)).alias("x"), F.get("scores", F.lit(1)).alias("y")
    )
    return sample_n(plane, n, seed, id_col).join(clusters.select(id_col, "cluster"), id_col)
