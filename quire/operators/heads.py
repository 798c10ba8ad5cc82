"""A classifier head trained by mini-batch gradient descent, with validation after each
epoch, that can go on after a break.

A step is one job: every task adds up the gradient over its rows of the mini-batch, a few
tasks add those up, the driver updates the parameters (layers x widths, whatever the
number of rows). After each epoch parameters, moments and history are written.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import materialise, scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_LAST = 8
_TINY = 1e-15


@dataclass
class Head:
    """Layers as one vector of parameters; tanh between them, softmax at the end."""

    widths: list[int]
    values: np.ndarray

    def layers(self, values: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        values, out, at = self.values if values is None else values, [], 0
        for a, b in zip(self.widths, self.widths[1:], strict=False):
            out.append((values[at : at + a * b].reshape(a, b), values[at + a * b : at + (a + 1) * b]))
            at += (a + 1) * b
        return out

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        """Outputs of every layer, the input first and probabilities last."""
        out = [x]
        layers = self.layers()
        for k, (w, b) in enumerate(layers):
            z = out[-1] @ w + b
            if k + 1 < len(layers):
                out.append(np.tanh(z))
            else:
                z = np.exp(z - z.max(axis=1, keepdims=True))
                out.append(z / z.sum(axis=1, keepdims=True))
        return out

    def gradient(self, x: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, float]:
        """Gradient of the summed cross-entropy, and that sum."""
        outs = self.forward(x)
        given = outs[-1][np.arange(label.size), label]
        delta = outs[-1].copy()
        delta[np.arange(label.size), label] -= 1
        parts = []
        for k, (w, _) in reversed(list(enumerate(self.layers()))):
            parts.append(np.concatenate(((outs[k].T @ delta).ravel(), delta.sum(axis=0))))
            if k:
                delta = (delta @ w.T) * (1 - outs[k] ** 2)
        return np.concatenate(parts[::-1]), float(-np.log(np.maximum(given, _TINY)).sum())


def new_head(n_features: int, n_classes: int, hidden: Sequence[int] = (50,), seed: int = 5) -> Head:
    rng = np.random.default_rng(seed)
    widths = [n_features, *hidden, n_classes]
    parts = []
    for a, b in zip(widths, widths[1:], strict=False):
        parts += [rng.normal(scale=1 / np.sqrt(a), size=a * b), np.zeros(b)]
    return Head(widths, np.concatenate(parts))


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)


def _gradient(rows: DataFrame, head: Head) -> tuple[np.ndarray, float, int]:
    """(summed gradient, summed loss, rows) of a mini-batch."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(head.values.size + 2)
        for batch in batches:
            if batch.num_rows:
                g, loss = head.gradient(_rows(batch), batch.column(1).to_numpy().astype(np.int64))
                total += np.concatenate((g, [loss, batch.num_rows]))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(head.values.size + 2)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                total += np.frombuffer(part, np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    parts = rows.select("x", "label").mapInArrow(add, "part binary")
    last = parts.repartition(_LAST).mapInArrow(merge, "part binary").collect()
    total = np.sum([np.frombuffer(r.part, np.float64) for r in last], axis=0)
    return total[:-2], float(total[-2]), int(total[-1])


def predict(head: Head, rows: DataFrame, *keep: str) -> DataFrame:
    """(kept columns, scores) of rows with the vector ``x``."""
    schema = rows.select(*keep).schema.add("scores", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = pa.array(list(head.forward(_rows(batch))[-1]), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], scores], names=[*keep, "scores"])

    return rows.select("x", *keep).mapInArrow(run, schema)


def score_head(head: Head, df: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, label, prediction, scores); the first of equal scores wins."""
    rows = df.withColumn("x", vector_to_array("features"))
    best = (F.array_position("scores", F.array_max("scores")) - 1).cast("int")
    return predict(head, rows, id_col, "label").select(
        id_col, F.col("label").cast("int").alias("label"), best.alias("prediction"), "scores"
    )


def _checked(head: Head, valid: DataFrame) -> tuple[float, float]:
    """(mean loss, accuracy) over the validation rows."""
    found = predict(head, valid, "label")
    given = F.get("scores", F.col("label").cast("int"))
    hit = F.array_position("scores", F.array_max("scores")) - 1 == F.col("label")
    row = found.agg(F.avg(-F.log(F.greatest(given, F.lit(_TINY)))).alias("loss"), F.avg(hit.cast("double")).alias("hits"))
    return tuple(row.first())


def train_head(
    train: DataFrame,
    valid: DataFrame,
    n_classes: int,
    hidden: Sequence[int] = (50,),
    epochs: int = 4,
    steps: int = 8,
    rate: float = 0.02,
    seed: int = 5,
    id_col: str = "id",
    path: str | None = None,
) -> tuple[Head, DataFrame]:
    """(head, history) from rows with ``features`` (vector) and ``label`` (class index).

    The history (epoch, loss, valid_loss, valid_accuracy, seconds) is of one run: loss is
    the mean over the epoch's mini-batches as they were met. Each epoch deals the rows to
    ``steps`` mini-batches anew, by a hash of id and epoch; steps follow Adam's rule.
    ``hidden=()`` is a linear head. With a ``path`` a later call goes on after the last
    epoch written there. Without rows the head stays as drawn.
    """
    spark = train.sparkSession
    train, valid = (
        materialise(df.select(id_col, "label", vector_to_array("features").alias("x")), "head-rows") for df in (train, valid)
    )
    path = path or scratch_path(spark, "head")
    one = train.unionByName(valid).select(F.size("x").alias("n")).first()
    head = new_head(one.n if one else 0, n_classes, hidden, seed)
    state = {"values": head.values, "first": np.zeros(head.values.size), "second": np.zeros(head.values.size)}
    history: list[tuple] = []
    saved = _last(spark, path)
    if saved is not None:
        history = [tuple(r) for r in saved.history]
        state = {k: np.array(saved[k]) for k in state}
        head = Head(head.widths, state["values"])
    for epoch in range(len(history) + 1, epochs + 1):
        began = time.perf_counter()
        loss, rows = 0.0, 0
        batch = F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), id_col), F.lit(steps))
        for step in range(steps):
            g, own, n = _gradient(train.where(batch == step), head)
            if not n:
                continue
            loss, rows = loss + own, rows + n
            g, t = g / n, (epoch - 1) * steps + step + 1
            state["first"] = 0.9 * state["first"] + 0.1 * g
            state["second"] = 0.999 * state["second"] + 0.001 * g * g
            move = state["first"] / (1 - 0.9**t) / (np.sqrt(state["second"] / (1 - 0.999**t)) + 1e-8)
            state["values"] = state["values"] - rate * move
            head = Head(head.widths, state["values"])
        seconds = time.perf_counter() - began
        history.append((epoch, loss / rows if rows else None, *_checked(head, valid), seconds))
        _save(spark, path, epoch, state, history)
    return head, spark.createDataFrame(history, _HISTORY)


_HISTORY = "epoch int, loss double, valid_loss double, valid_accuracy double, seconds double"
_STATE = f"epoch int, values array<double>, first array<double>, second array<double>, history array<struct<{_HISTORY.replace(' ', ':').replace(',:', ',')}>>"


def _save(spark, path: str, epoch: int, state: dict, history: list) -> None:
    """One row: what training needs to go on, and what has been reported."""
    row = (epoch, *[state[k].tolist() for k in ("values", "first", "second")], history)
    spark.createDataFrame([row], _STATE).write.mode("append").parquet(path)


def _last(spark, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.schema(_STATE).parquet(path).orderBy(F.desc("epoch")).first()
