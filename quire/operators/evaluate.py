"""Scores of predictions. Inputs have (label, prediction) and where needed an
id, a batch or class probabilities."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.ordering import assign_batch


def _hit():
    return (F.col("label") == F.col("prediction")).cast("double")


def accuracy(pred: DataFrame) -> DataFrame:
    return pred.agg(F.avg(_hit()).alias("accuracy"))


def hamming_loss(pred: DataFrame) -> DataFrame:
    return pred.agg(F.avg(1.0 - _hit()).alias("hamming_loss"))


def _cells(pred: DataFrame, *keys: str) -> DataFrame:
    """Counts per (label, prediction); everything else here works on these."""
    return pred.groupBy(*keys, "label", "prediction").agg(F.count("*").alias("n"))


def _by_class(cells: DataFrame, *keys: str) -> DataFrame:
    """True, predicted and correctly predicted rows of every class that occurs
    on either side."""
    n = F.col("n")
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(
            F.col("label").alias("cls"),
            n.alias("is_label"),
            zero.alias("is_pred"),
            F.when(F.col("label") == F.col("prediction"), n).otherwise(zero).alias("both"),
        ),
        F.struct(
            F.col("prediction").alias("cls"), zero.alias("is_label"), n.alias("is_pred"), zero.alias("both")
        ),
    )
    return (
        cells.select(*keys, F.inline(sides))
        .groupBy(*keys, "cls")
        .agg(
            F.sum("is_label").alias("support"),
            F.sum("is_pred").alias("predicted"),
            F.sum("both").alias("correct"),
        )
    )


def _ratio(top, bottom):
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def classification_report(pred: DataFrame) -> DataFrame:
    """(place, class, precision, recall, f1, support): one row per class, then
    accuracy, macro average and weighted average. A zero denominator gives 0."""
    support, predicted, correct = F.col("support"), F.col("predicted"), F.col("correct")
    classes = _by_class(_cells(pred)).select(
        F.col("cls").cast("string").alias("class"),
        _ratio(correct, predicted).alias("precision"),
        _ratio(correct, support).alias("recall"),
        _ratio(2 * correct, predicted + support).alias("f1"),
        support,
        correct,
    )
    scores = ("precision", "recall", "f1")
    total = F.sum("support")
    summary = classes.agg(
        total.alias("support"),
        (F.sum("correct") / total).alias("accuracy"),
        *[F.avg(s).alias(f"macro_{s}") for s in scores],
        *[(F.sum(F.col(s) * support) / total).alias(f"weighted_{s}") for s in scores],
    )

    def line(name: str, values) -> list:
        return F.struct(
            F.lit(name).alias("class"),
            *[F.col(v).alias(s) for s, v in zip(scores, values, strict=True)],
            F.col("support"),
        )

    footer = summary.select(
        F.inline(
            F.array(
                line("accuracy", ["accuracy"] * 3),
                line("macro avg", [f"macro_{s}" for s in scores]),
                line("weighted avg", [f"weighted_{s}" for s in scores]),
            )
        )
    )
    footers = F.array(F.lit("accuracy"), F.lit("macro avg"), F.lit("weighted avg"))
    body = classes.select(F.lit(0).alias("part"), "class", *scores, "support")
    ends = footer.select(F.array_position(footers, F.col("class")).cast("int").alias("part"), "class", *scores, "support")
    # A few rows per class: one sort places them.
    return (
        body.unionByName(ends)
        .withColumn("place", F.row_number().over(Window.orderBy("part", "class")))
        .select("place", "class", *scores, "support")
    )


def confusion_cells(pred: DataFrame) -> DataFrame:
    """(label, prediction, n) of the pairs that occur, for any number of classes."""
    return _cells(pred)


def confusion_matrix(pred: DataFrame) -> DataFrame:
    """(label, prediction, n) for every pair of classes, zeros included.

    For display: the square grid is as large as its definition says. With many
    classes use ``confusion_cells``, which has the pairs that occur.
    """
    cells = _cells(pred)
    classes = _by_class(cells).select("cls")
    listed = classes.agg(F.sort_array(F.collect_list("cls"))).scalar()
    grid = (
        classes.withColumn("_all", listed)
        .select(F.col("cls").alias("label"), F.explode("_all").alias("prediction"))
    )
    return grid.join(cells, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("n", F.lit(0)).alias("n")
    )


def mcc(pred: DataFrame, *keys: str) -> DataFrame:
    """Multi-class Matthews correlation per group of ``keys``; 0 where one side
    has a single class."""
    sums = _by_class(_cells(pred, *keys), *keys).groupBy(*keys).agg(
        F.sum("correct").cast("double").alias("c"),
        F.sum("support").cast("double").alias("s"),
        F.sum(F.col("support") * F.col("predicted")).cast("double").alias("tp"),
        F.sum(F.col("predicted") * F.col("predicted")).cast("double").alias("pp"),
        F.sum(F.col("support") * F.col("support")).cast("double").alias("tt"),
    )
    square = F.col("s") * F.col("s")
    spread = (square - F.col("pp")) * (square - F.col("tt"))
    return sums.select(
        *keys,
        F.when(spread > 0, (F.col("c") * F.col("s") - F.col("tp")) / F.sqrt(spread))
        .otherwise(F.lit(0.0))
        .alias("mcc"),
    )


def mcc_by_batch(pred: DataFrame, size: int = 8, id_col: str = "id") -> DataFrame:
    """(batch, mcc) over consecutive batches of ``size`` rows in id order."""
    narrow = pred.select(id_col, "label", "prediction")
    # Placed by batch once; the three groupings inside need no further shuffle.
    return mcc(assign_batch(narrow, size, id_col).repartition("batch"), "batch")


def _row_loss(label: str, probabilities: str):
    given = F.get(F.col(probabilities), F.col(label))
    return -F.log(F.least(F.greatest(given, F.lit(1e-15)), F.lit(1.0)))


def log_loss(pred: DataFrame, label: str = "label", probabilities: str = "scores") -> DataFrame:
    """Mean cross-entropy; ``label`` is the place in the probability array."""
    return pred.agg(F.avg(_row_loss(label, probabilities)).alias("log_loss"))


def batch_metrics(
    pred: DataFrame, size: int = 8, id_col: str = "id", probabilities: str = "scores"
) -> DataFrame:
    """(batch, n, loss, accuracy) over consecutive batches in id order."""
    rows = pred.select(
        id_col, _hit().alias("hit"), _row_loss("label", probabilities).alias("loss")
    )
    return assign_batch(rows, size, id_col).groupBy("batch").agg(
        F.count("*").alias("n"), F.avg("loss").alias("loss"), F.avg("hit").alias("accuracy")
    )


def metrics_table(preds_by_model: Mapping[str, DataFrame]) -> DataFrame:
    """(model, accuracy, hamming): one row per model, scored in one pass."""
    tagged = [
        pred.select(F.lit(name).alias("model"), "label", "prediction")
        for name, pred in preds_by_model.items()
    ]
    stacked = tagged[0]
    for more in tagged[1:]:
        stacked = stacked.unionByName(more)
    return stacked.groupBy("model").agg(
        F.avg(_hit()).alias("accuracy"), F.avg(1.0 - _hit()).alias("hamming")
    )
