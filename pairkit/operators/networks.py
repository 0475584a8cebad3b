"""Feed-forward networks with row weights, trained by gradients that tasks sum.

A round broadcasts the parameters, each task sums loss and gradient over its rows, the sums are added
in two steps, the first in tasks, and the driver takes one step. So the driver holds parameters and
about the square root of the number of tasks gradients, whatever the number of rows. A hold-out is
scored in the same pass; training ends when its loss has not fallen for `patience` rounds, and the
best parameters are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairkit.session import dropped, materialize
from pairkit.sources import stores

KEY = ("qid1", "qid2")
SUMS = "held boolean, loss double, weight double, sums binary"


def shapes(sizes: Sequence[int]) -> list[tuple[int, ...]]:
    return [s for a, b in zip(sizes, sizes[1:]) for s in ((a, b), (b,))]


def unpack(flat: np.ndarray, sizes: Sequence[int]) -> list[np.ndarray]:
    """Matrices and offsets of the layers, as parts of one flat array."""
    out, at = [], 0
    for shape in shapes(sizes):
        n = math.prod(shape)
        out.append(flat[at:at + n].reshape(shape))
        at += n
    return out


def initial(sizes: Sequence[int], seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.concatenate([(rng.normal(0, math.sqrt(2.0 / s[0]), s) if len(s) == 2 else np.zeros(s)).ravel() for s in shapes(sizes)])


def scores(flat: np.ndarray, sizes: Sequence[int], x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Log odds of each row, and what went into each layer."""
    layers, inputs = unpack(flat, sizes), [x]
    for k in range(0, len(layers), 2):
        x = x @ layers[k] + layers[k + 1]
        if k + 2 < len(layers):
            x = np.maximum(x, 0.0)
            inputs.append(x)
    return x[:, 0], inputs


def loss_and_gradient(flat: np.ndarray, sizes: Sequence[int], x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Sums over the rows of weight * logistic loss, and its gradient."""
    odds, inputs = scores(flat, sizes, x)
    loss = float(weight @ (np.logaddexp(0.0, odds) - y * odds))
    layers, parts = unpack(flat, sizes), []
    error = (weight * ((1.0 / (1.0 + np.exp(-np.clip(odds, -500, 500)))) - y))[:, None]
    for k in range(len(layers) - 2, -1, -2):
        before = inputs[k // 2]
        parts += [error.sum(axis=0).ravel(), (before.T @ error).ravel()]
        if k:
            error = (error @ layers[k].T) * (before > 0)
    return loss, np.concatenate(parts[::-1])


def _features(batch: pa.RecordBatch, column: int, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return (flat.reshape(batch.num_rows, -1) - mean) / scale


def _added(parts: DataFrame, tasks: int) -> dict[bool, tuple[float, float, np.ndarray]]:
    """Sums of the tasks' rows, for held-out and other rows; most are added in tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            for held, loss, weight, sums in zip(*(batch.column(c).to_pylist() for c in range(4))):
                had = found.get(held, (0.0, 0.0, 0.0))
                found[held] = had[0] + loss, had[1] + weight, had[2] + np.frombuffer(sums)
        rows = [(held, loss, weight, sums.tobytes()) for held, (loss, weight, sums) in found.items()]
        kinds = [pa.bool_(), pa.float64(), pa.float64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 4, kinds)], ["held", "loss", "weight", "sums"])

    fan = math.isqrt(max(1, tasks - 1)) + 1
    out: dict = {}
    for r in parts.repartition(fan).mapInArrow(run, SUMS).collect():  # two rows of each of `fan` tasks
        had = out.get(r["held"], (0.0, 0.0, 0.0))
        out[r["held"]] = had[0] + r["loss"], had[1] + r["weight"], had[2] + np.frombuffer(r["sums"])
    return out


@dataclass
class FittedNetwork:
    """Parameters and the scaling of the features they expect."""

    sizes: tuple[int, ...]
    flat: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    names: Sequence[str] = ()
    losses: list[float] = field(default_factory=list)
    held_losses: list[float] = field(default_factory=list)

    def predict_proba(self, matrix: DataFrame) -> DataFrame:
        """(qid1, qid2, label, proba)."""
        sent = matrix.sparkSession.sparkContext.broadcast((self.flat, self.mean, self.scale))
        sizes = self.sizes

        @F.arrow_udf("double")
        def score(features: pa.Array) -> pa.Array:
            flat, mean, scale = sent.value
            x = (features.flatten().to_numpy(zero_copy_only=False).reshape(len(features), -1) - mean) / scale
            return pa.array(1.0 / (1.0 + np.exp(-np.clip(scores(flat, sizes, x)[0], -500, 500))))

        return matrix.select(*KEY, "label", score(vector_to_array("features")).alias("proba"))

    def save(self, spark: SparkSession, path: str) -> None:
        doc = {"sizes": list(self.sizes), "names": list(self.names), **{n: getattr(self, n).tolist() for n in ("flat", "mean", "scale")}}
        stores.write_document(spark, doc, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FittedNetwork:
        doc = stores.read_document(spark, path)
        return cls(tuple(doc["sizes"]), *(np.array(doc[n]) for n in ("flat", "mean", "scale")), tuple(doc["names"]))


def fit_network(matrix: DataFrame, hidden: Sequence[int], rounds: int = 100, rate: float = 0.01, decay: float = 0.0,
                patience: int = 10, tolerance: float = 1e-4, seed: int = 42) -> FittedNetwork:
    """Network over `features` of rows with `label`, and, where there are any, `weight` and `is_validation`.

    Steps are Adam's on the mean weighted loss. Rows of weight 2 count as two rows. Without rows to
    learn from, every pair gets the same probability.
    """
    spark = matrix.sparkSession
    weight = F.col("weight").cast("double") if "weight" in matrix.columns else F.lit(1.0)
    held = F.col("is_validation") if "is_validation" in matrix.columns else F.lit(False)
    rows = materialize(matrix.select(F.col("label").cast("double").alias("label"), weight.alias("weight"), held.alias("held"),
                                     vector_to_array("features").alias("x")), "network-rows")
    first = rows.select(F.size("x").alias("n")).first()
    if first is None:
        dropped(rows)
        return FittedNetwork((1, 1), np.zeros(2), np.zeros(1), np.ones(1))
    width, tasks = first["n"], rows.select(F.spark_partition_id().alias("p")).distinct().count()
    zero, one = np.zeros(width), np.ones(width)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, sums = 0.0, np.zeros(2 * width)
        for batch in batches:
            x, w = _features(batch, 3, zero, one), batch.column(1).to_numpy()
            whole += w.sum()
            sums += np.concatenate([w @ x, w @ (x * x)])
        yield pa.RecordBatch.from_arrays([pa.array([False]), pa.array([0.0]), pa.array([whole]), pa.array([sums.tobytes()], pa.binary())],
                                         ["held", "loss", "weight", "sums"])

    found = _added(rows.filter("NOT held").select("label", "weight", "held", "x").mapInArrow(moments, SUMS), tasks).get(False)
    whole, sums = (found[1], found[2]) if found else (0.0, np.zeros(2 * width))
    mean = sums[:width] / max(whole, 1e-12)
    scale = np.sqrt(np.maximum(sums[width:] / max(whole, 1e-12) - mean * mean, 0.0))
    scale = np.where(scale > 1e-9, scale, 1.0)
    sizes = (width, *hidden, 1)
    flat = initial(sizes, seed)
    fitted = FittedNetwork(sizes, flat, mean, scale)
    best, worse = (math.inf, flat), 0
    first_moment, second_moment = np.zeros_like(flat), np.zeros_like(flat)
    for step in range(1, rounds + 1):
        sent = spark.sparkContext.broadcast(flat)

        def gradients(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            parameters, parts = sent.value, {}
            for batch in batches:
                x, y, w = _features(batch, 3, mean, scale), batch.column(0).to_numpy(), batch.column(1).to_numpy()
                apart = batch.column(2).to_numpy(zero_copy_only=False)
                for side in (False, True):
                    at = np.flatnonzero(apart == side)
                    if not len(at):
                        continue
                    if side:
                        odds = scores(parameters, sizes, x[at])[0]
                        loss, slope = float(w[at] @ (np.logaddexp(0.0, odds) - y[at] * odds)), np.zeros(0)
                    else:
                        loss, slope = loss_and_gradient(parameters, sizes, x[at], y[at], w[at])
                    had = parts.get(side, (0.0, 0.0, 0.0))
                    parts[side] = had[0] + loss, had[1] + w[at].sum(), had[2] + slope
            rows = [(side, loss, total, np.asarray(slope, float).tobytes()) for side, (loss, total, slope) in parts.items()]
            kinds = [pa.bool_(), pa.float64(), pa.float64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 4, kinds)], ["held", "loss", "weight", "sums"])

        parts = _added(rows.select("label", "weight", "held", "x").mapInArrow(gradients, SUMS), tasks)
        sent.destroy()
        if False not in parts:
            break
        loss, total, slope = parts[False]
        fitted.losses.append(loss / total)
        judged = fitted.losses[-1]
        if True in parts:
            judged = parts[True][0] / parts[True][1]
            fitted.held_losses.append(judged)
        if judged < best[0] - tolerance:
            best, worse = (judged, flat), 0
        else:
            worse += 1
            if worse >= patience:
                break
        slope = slope / total + decay * flat
        first_moment = 0.9 * first_moment + 0.1 * slope
        second_moment = 0.999 * second_moment + 0.001 * slope * slope
        flat = flat - rate * (first_moment / (1 - 0.9 ** step)) / (np.sqrt(second_moment / (1 - 0.999 ** step)) + 1e-8)
    fitted.flat = best[1]
    dropped(rows)
    return fitted
