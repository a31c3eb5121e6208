"""A trained text classifier with the life of one: built, trained with patience on a validation split, evaluated, saved, loaded, and
applied in batches. It stands where a pretrained network would be plugged in, behind the same steps.

The model is a softmax over hashed words. Its weights have a fixed size (FEATURES x classes), so they may be broadcast; rows
never leave their tasks: an epoch is one pass that sums each task's gradient, and sums of tasks meet by feature.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

FEATURES = 1 << 14


def hashed(text: str | None, features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a text's words: their counts damped by the square root, of length one. A blank text has none."""
    words = (text or "").lower().split()
    at, n = np.unique(np.array([zlib.crc32(w.encode("utf-8", "replace")) % features for w in words], np.int64), return_counts=True)
    value = np.sqrt(n)
    return at, value / max(1e-12, np.sqrt((value**2).sum()))


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@dataclass
class TextModel:
    """``history``: the validation loss of each epoch. The last row of the weights is the bias."""

    classes: list[str]
    weights: np.ndarray = None
    features: int = FEATURES
    history: list[float] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.weights is None:
            self.weights = np.zeros((self.features + 1, len(self.classes)))

    def probabilities(self, text: str | None) -> np.ndarray:
        at, value = hashed(text, self.features)
        return _softmax(value @ self.weights[at] + self.weights[-1])

    def train(self, rows: DataFrame, validation: DataFrame, text: str = "text", label: str = "class", epochs: int = 20, patience: int = 3, rate: float = 20.0, least: float = 1e-4) -> TextModel:
        """Gradient steps over all of ``rows``; ends when the loss of ``validation`` has not fallen by ``least`` for ``patience`` epochs,
        and keeps the weights of the best one. Rows of other classes, or without one, do not count; without rows the model
        stays as it is."""
        best, waited = self.weights.copy(), 0
        for epoch in range(epochs):
            grad, _, n = self._pass(rows, text, label, True)
            if not n:
                break
            self.weights -= rate / np.sqrt(1 + epoch) * grad / n
            _, loss, m = self._pass(validation, text, label, False)
            self.history.append(loss / max(1, m))
            if self.history[-1] < min(self.history[:-1], default=np.inf) - least:
                best, waited = self.weights.copy(), 0
            else:
                waited += 1
                if waited >= patience:
                    break
        self.weights = best
        return self

    def _pass(self, rows: DataFrame, text: str, label: str, gradient: bool) -> tuple[np.ndarray | None, float, int]:
        model, place = self, {c: i for i, c in enumerate(self.classes)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grad, loss, n = np.zeros_like(model.weights), 0.0, 0
            for b in batches:
                for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if y not in place:
                        continue
                    at, value = hashed(t, model.features)
                    p = _softmax(value @ model.weights[at] + model.weights[-1])
                    loss, n = loss - float(np.log(max(p[place[y]], 1e-12))), n + 1
                    if gradient:
                        p[place[y]] -= 1
                        grad[at] += value[:, None] * p
                        grad[-1] += p
            used = np.flatnonzero(np.abs(grad).sum(1)) if gradient else np.zeros(0, np.int64)
            at = np.r_[used, -1]
            sums = [*grad[used].tolist(), [loss, float(n), *[0.0] * len(model.classes)][: max(2, len(model.classes))]]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums, pa.list_(pa.float64()))], names=["at", "sums"])

        parts = rows.select(F.col(text).cast("string"), F.col(label).cast("string")).mapInArrow(run, "at long, sums array<double>")
        width = max(2, len(self.classes))
        total = parts.groupBy("at").agg(F.array(*[F.sum(F.get("sums", i)) for i in range(width)]).alias("sums")).collect()  # at most a row per feature
        grad, loss, n = np.zeros_like(self.weights), 0.0, 0
        for r in total:
            if r["at"] < 0:
                loss, n = r.sums[0], int(r.sums[1])
            else:
                grad[r["at"]] = r.sums[: len(self.classes)]
        return grad, loss, n

    def predict(self, rows: DataFrame, text: str = "text", batch: int = 512) -> DataFrame:
        """Adds ``probs``, map of class to probability; null where the text is null or blank."""
        classes, weights, features = self.classes, self.weights, self.features

        def load() -> Callable[[np.ndarray], np.ndarray]:
            model = TextModel(classes, weights, features)  # once a worker
            return lambda texts: np.stack([model.probabilities(t) for t in texts])

        scored = predict_batch_udf(load, return_type=ArrayType(DoubleType()), batch_size=batch)
        shares = scored(F.coalesce(F.col(text), F.lit("")))
        names = F.array(*[F.lit(c) for c in classes])
        return rows.withColumn("__p", shares).withColumn("probs", F.when(F.trim(text) != "", F.map_from_arrays(names, F.col("__p")))).drop("__p")

    def evaluate(self, rows: DataFrame, text: str = "text", label: str = "class") -> DataFrame:
        """(n, accuracy, loss), one row."""
        known = self.predict(rows.where(F.col(label).isin(self.classes)), text).where("probs IS NOT NULL")
        own = F.col("probs")[F.col(label)]
        right = own == F.array_max(F.map_values("probs"))
        return known.agg(F.count("*").alias("n"), F.avg(right.cast("double")).alias("accuracy"), F.avg(-F.log(F.greatest(own, F.lit(1e-12)))).alias("loss"))

    def save(self, spark: SparkSession, path: str, overwrite: bool = False) -> None:
        """One Parquet row per feature in use, one for what else there is."""
        used = np.flatnonzero(np.abs(self.weights).sum(1))
        about = json.dumps({"classes": self.classes, "features": self.features, "history": self.history})
        rows = [(int(i), self.weights[i].tolist(), None) for i in used] + [(None, None, about)]
        spark.createDataFrame(rows, "at long, weights array<double>, about string").coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextModel:
        rows = spark.read.parquet(path).collect()  # at most a row per feature
        about = json.loads(next(r.about for r in rows if r.about))
        model = cls(about["classes"], features=about["features"], history=about["history"])
        for r in rows:
            if r["at"] is not None:
                model.weights[r["at"]] = r.weights
        return model


def scorer_of(model: TextModel) -> Callable[[DataFrame], DataFrame]:
    """The model as a scorer, to register or to pass to ``classify_set``."""
    return model.predict
