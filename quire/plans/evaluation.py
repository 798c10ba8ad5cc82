"""Queries over predictions. A fixed rule on the document number takes the place
of a model, so that every score has an exact twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import scalars
from quire.operators import evaluate, joins, profile
from quire.plans.registry import query, table
from quire.session import scratch_path
from quire.sources import writers

CLASSES = 4


def predictions(spark, sf_dir):
    """(id, label, prediction, scores): four class scores from the number."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    d = F.col("id")
    points = F.transform(
        F.sequence(F.lit(0), F.lit(CLASSES - 1)),
        lambda c: 1 + (d * 7 + c * 3 + F.floor(d / 5)) % 11,
    )
    rows = joins.label_index(docs, "lang", docs, "label").withColumn("points", points)
    total = F.aggregate("points", F.lit(0).cast("bigint"), lambda a, p: a + p)
    scored = rows.withColumn("total", total).withColumn(
        "scores", F.transform("points", lambda p: p / F.col("total"))
    )
    return scored.select("id", "label", scalars.argmax(F.col("scores")).alias("prediction"), "scores")


PRED = """WITH raw AS (SELECT doc_id AS id, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END AS label,
  list_transform(range(4), lambda c: 1 + (doc_id * 7 + c * 3 + doc_id // 5) % 11) AS points FROM documents),
pred AS (SELECT id, label::INTEGER AS label, (list_position(points, list_max(points)) - 1)::INTEGER AS prediction,
  list_transform(points, lambda p: p / list_sum(points)) AS scores FROM raw),
classes AS (SELECT label AS c FROM pred UNION SELECT prediction FROM pred),
per_class AS (SELECT c, (SELECT count(*) FROM pred WHERE label = c) AS support,
  (SELECT count(*) FROM pred WHERE prediction = c) AS predicted,
  (SELECT count(*) FROM pred WHERE label = c AND prediction = c) AS correct FROM classes),
scores AS (SELECT c, support, correct, CASE WHEN predicted > 0 THEN correct / predicted ELSE 0 END AS p,
  CASE WHEN support > 0 THEN correct / support ELSE 0 END AS r,
  CASE WHEN predicted + support > 0 THEN 2 * correct / (predicted + support) ELSE 0 END AS f FROM per_class)
"""


@query("F23 J7", PRED + "SELECT id, label, prediction, round(scores[label + 1], 9) AS score FROM pred")
def paired_predictions(spark, sf_dir):
    pred = predictions(spark, sf_dir)
    paired = joins.pair(pred.select("id", "prediction", "scores"), pred.select("id", "label"))
    return paired.select(
        "id", "label", "prediction", F.round(F.get("scores", F.col("label")), 9).alias("score")
    )


@query("E1", PRED + "SELECT round(avg((label = prediction)::INTEGER), 9) AS accuracy FROM pred")
def accuracy(spark, sf_dir):
    return evaluate.accuracy(predictions(spark, sf_dir)).select(F.round("accuracy", 9).alias("accuracy"))


REPORT = PRED + """, lines AS (
  SELECT 0 AS part, CAST(c AS VARCHAR) AS class, p, r, f, support FROM scores
  UNION ALL SELECT 1, 'accuracy', sum(correct) / sum(support), sum(correct) / sum(support),
    sum(correct) / sum(support), sum(support) FROM scores
  UNION ALL SELECT 2, 'macro avg', avg(p), avg(r), avg(f), sum(support) FROM scores
  UNION ALL SELECT 3, 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
    sum(f * support) / sum(support), sum(support) FROM scores)
"""


@query(
    "E2",
    REPORT
    + """SELECT (row_number() OVER (ORDER BY part, class))::INTEGER AS place, class, round(p, 6) AS precision,
  round(r, 6) AS recall, round(f, 6) AS f1, support::BIGINT AS support FROM lines""",
)
def classification_report(spark, sf_dir):
    report = evaluate.classification_report(predictions(spark, sf_dir))
    scores = [F.round(s, 6).alias(s) for s in ("precision", "recall", "f1")]
    return report.select("place", "class", *scores, "support")


CONFUSION = """SELECT a.c AS label, b.c AS prediction, count(p.id) AS n FROM classes a CROSS JOIN classes b
LEFT JOIN pred p ON p.label = a.c AND p.prediction = b.c GROUP BY a.c, b.c"""


@query("E3", PRED + CONFUSION)
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(predictions(spark, sf_dir))


@query(
    "S11",
    REPORT
    + f""", cells AS ({CONFUSION})
SELECT 'Classification Report' AS line UNION ALL SELECT 'Confusion Matrix'
UNION ALL SELECT printf('%14s %9s %9s %9s %9s', 'class', 'precision', 'recall', 'f1', 'support')
UNION ALL SELECT repeat(' ', 14) || string_agg(printf(' %6s', CAST(c AS VARCHAR)), '' ORDER BY c) FROM classes
UNION ALL SELECT printf('%14s %9.4f %9.4f %9.4f %9d', class, p::DOUBLE, r::DOUBLE, f::DOUBLE, support::BIGINT) FROM lines
UNION ALL SELECT printf('%14s', CAST(label AS VARCHAR)) || string_agg(printf(' %6d', n), '' ORDER BY prediction)
  FROM cells GROUP BY label""",
)
def text_report(spark, sf_dir):
    """Written as text and read back."""
    pred = predictions(spark, sf_dir)
    report, confusion = evaluate.classification_report(pred), evaluate.confusion_matrix(pred)
    path = scratch_path(spark, "report")
    writers.write_report(writers.report_lines(report, confusion, list(range(CLASSES))), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("E4", PRED + "SELECT round(avg((label <> prediction)::INTEGER), 9) AS hamming_loss FROM pred")
def hamming_loss(spark, sf_dir):
    loss = evaluate.hamming_loss(predictions(spark, sf_dir))
    return loss.select(F.round("hamming_loss", 9).alias("hamming_loss"))


@query(
    "E5 W3",
    PRED
    + """, batched AS (SELECT *, ((row_number() OVER (ORDER BY id) - 1) // 8)::BIGINT AS batch FROM pred),
sides AS (SELECT batch, c, sum(t) AS t, sum(p) AS p FROM (
  SELECT batch, label AS c, 1 AS t, 0 AS p FROM batched UNION ALL SELECT batch, prediction, 0, 1 FROM batched) GROUP BY ALL),
sums AS (SELECT batch, sum(t * p) AS tp, sum(p * p) AS pp, sum(t * t) AS tt FROM sides GROUP BY batch),
hits AS (SELECT batch, count(*) AS s, count(*) FILTER (label = prediction) AS c FROM batched GROUP BY batch)
SELECT batch, round(CASE WHEN (s * s - pp) * (s * s - tt) > 0
  THEN (c * s - tp) / sqrt((s * s - pp) * (s * s - tt)) ELSE 0 END, 9) AS mcc FROM hits JOIN sums USING (batch)""",
)
def mcc_by_batch(spark, sf_dir):
    scores = evaluate.mcc_by_batch(predictions(spark, sf_dir))
    return scores.select("batch", F.round("mcc", 9).alias("mcc"))


@query("E6", PRED + "SELECT round(avg(-ln(least(greatest(scores[label + 1], 1e-15), 1))), 9) AS log_loss FROM pred")
def log_loss(spark, sf_dir):
    loss = evaluate.log_loss(predictions(spark, sf_dir))
    return loss.select(F.round("log_loss", 9).alias("log_loss"))


BATCHES = PRED + """, batched AS (SELECT *, ((row_number() OVER (ORDER BY id) - 1) // 8)::BIGINT AS batch FROM pred),
batches AS (SELECT batch, count(*) AS n, avg(-ln(least(greatest(scores[label + 1], 1e-15), 1))) AS loss,
  avg((label = prediction)::INTEGER) AS accuracy FROM batched GROUP BY batch)
"""


@query("E6 E8", BATCHES + "SELECT batch, n, round(loss, 9) AS loss, round(accuracy, 9) AS accuracy FROM batches")
def batch_metrics(spark, sf_dir):
    rows = evaluate.batch_metrics(predictions(spark, sf_dir))
    return rows.select("batch", "n", F.round("loss", 9).alias("loss"), F.round("accuracy", 9).alias("accuracy"))


@query("A24", BATCHES + "SELECT round(avg(loss), 9) AS loss, round(avg(accuracy), 9) AS accuracy FROM batches")
def mean_metrics(spark, sf_dir):
    means = profile.mean_metrics(evaluate.batch_metrics(predictions(spark, sf_dir)), ["loss", "accuracy"])
    return means.select(F.round("loss", 9).alias("loss"), F.round("accuracy", 9).alias("accuracy"))


@query(
    "E7 S15 U5",
    PRED
    + """SELECT 'rule' AS model, round(avg((label = prediction)::INTEGER), 9) AS accuracy,
  round(avg((label <> prediction)::INTEGER), 9) AS hamming FROM pred
UNION ALL SELECT 'constant', round(avg((label = 1)::INTEGER), 9), round(avg((label <> 1)::INTEGER), 9) FROM pred""",
)
def metrics_table(spark, sf_dir):
    pred = predictions(spark, sf_dir).select("id", "label", "prediction")
    by_model = {"rule": pred, "constant": pred.withColumn("prediction", F.lit(1))}
    rows = evaluate.metrics_table(by_model)
    return rows.select("model", F.round("accuracy", 9).alias("accuracy"), F.round("hamming", 9).alias("hamming"))
