"""Quality classifier: naive Bayes support vectors.

The features are indicators of hashed n-grams: of characters, and of the shapes of words (capitals, last sign,
whether the word before is the same). Each indicator is scaled by the log-ratio of its smoothed counts in the two
classes; a linear hinge-loss model on the scaled indicators is fitted by dual coordinate descent, and a
logistic curve, fitted on rows that the model hasn't seen, turns its margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierloom.llm.ngrams import Presence, batches, sums
from tierloom.llm.shared import first_by_hash, fold, held_out, small_batches

BITS = 16


class Grams:
    """Indexes of a text's character n-grams, then those of its word shapes; never empty, as one index is a constant."""

    def __init__(self):
        self.chars, self.shapes = Presence(range(1, 4), BITS, False), Presence(range(1, 5), BITS, False)

    @staticmethod
    def shape(text: str) -> str:
        out, before = [], ""
        for w in text.split():
            kind = 4 if w == before else 3 if w.isupper() and len(w) > 1 else 2 if w[0].isupper() else 1 if w.islower() else 0
            sign = ord(w[-1]) if not w[-1].isalnum() and w[-1] < "\x7f" else 0
            out.append(chr(0x100 + (kind << 7) + sign))
            before = w
        return "".join(out)

    def __call__(self, text: str) -> np.ndarray:
        return np.concatenate([self.chars(text), self.shapes(self.shape(text)) + (1 << BITS), [2 << BITS]]).astype(np.int32)


WIDTH = (2 << BITS) + 1


def log_ratios(grams: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    counts = [np.bincount(np.concatenate([g for g, k in zip(grams, y) if k == c] or [np.zeros(0, int)]), minlength=WIDTH) + smooth for c in (1, 0)]
    out = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
    out[-1] = 1
    return out


def dual_descent(grams: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: float, passes: int = 12) -> np.ndarray:
    """Weights of the L2-regularised hinge-loss model on unit-length scaled indicators; the rarer class costs more."""
    rng = np.random.default_rng(0)
    values = [scale[g] for g in grams]
    values = [v / max(1e-12, np.sqrt(v @ v)) for v in values]
    sign = np.where(y == 1, 1.0, -1.0)
    upper = np.where(y == 1, cost * len(y) / (2 * max(1, y.sum())), cost * len(y) / (2 * max(1, (1 - y).sum())))
    w, alpha = np.zeros(WIDTH), np.zeros(len(y))
    for _ in range(passes):
        for i in rng.permutation(len(y)):
            gradient = sign[i] * (values[i] @ w[grams[i]]) - 1
            new = min(max(alpha[i] - gradient, 0.0), upper[i])
            if new != alpha[i]:
                w[grams[i]] += (new - alpha[i]) * sign[i] * values[i]
                alpha[i] = new
    return w


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton's method with Platt's targets."""
    n1 = y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        s = p * (1 - p) + 1e-9
        g = np.array([(p - t) @ margin, (p - t).sum()]) + 1e-3 * np.array([a, 0])
        h = np.array([[s @ margin**2 + 1e-3, s @ margin], [s @ margin, s.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
    return float(a), float(b)


class QualityModel:
    def __init__(self, weights: np.ndarray, scale: np.ndarray, slope: float, offset: float):
        self.both = np.stack([weights * scale, scale**2], 1).astype(np.float32)
        self.slope, self.offset = slope, offset

    @classmethod
    def fit(cls, grams: list[np.ndarray], y: np.ndarray, cost: float = 1.0) -> QualityModel:
        if len(set(y.tolist())) < 2:
            return cls(np.zeros(WIDTH), np.zeros(WIDTH), 0.0, 0.0 if not len(y) else 4.0 if y[0] else -4.0)
        margins = np.zeros(len(y))
        for part in (0, 1):
            fit, rest = [np.flatnonzero(np.arange(len(y)) // 2 % 2 == k) for k in (part, 1 - part)]
            if len(set(y[fit].tolist())) == 2:
                some = [grams[i] for i in fit]
                scale = log_ratios(some, y[fit])
                margins[rest] = cls(dual_descent(some, scale, y[fit], cost), scale, 1.0, 0.0).margins([grams[i] for i in rest])
        scale = log_ratios(grams, y)
        return cls(dual_descent(grams, scale, y, cost), scale, *logistic(margins, y))

    def margins(self, grams: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([(s := sums(self.both, part))[:, 0] / np.sqrt(np.maximum(s[:, 1], 1e-12)) for part in batches(iter(grams), 64)] or [np.zeros(0)])

    def scores(self, grams: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(grams) + self.offset, -30, 30)))


def _features(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams = Grams()
    for batch in rows:
        found = [grams(t or "") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["y", "grams"])


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fit on `sample` labelled rows at most of those that aren't held out, half of each class as far as there are so many.

    The rows of a class are those whose hashes of the id come first, of equal hashes the smaller ids. This bound is the only one.
    Of labels that repeat an id the largest counts, of its texts the greatest; null ids and labels other than 0 and 1 take no
    part, null texts are empty. Texts are read whole, however long. Other columns of both tables are ignored, whatever their names.
    """
    y = labels.where(F.col(label_col).isin(0, 1) & (fold(id_col) != 0)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    y = first_by_hash(y.withColumn("hash", F.xxhash64("id")), "y", sample // 2, ["hash", "id"]).drop("hash")
    small_batches(docs.sparkSession)
    # at most `sample` ids, so the broadcast is bounded
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(y), "id")
    found = rows.groupBy("id", "y", "k").agg(F.max("text").alias("text")).orderBy("k", "y").select("y", "text").mapInArrow(_features, "y int, grams array<int>").toArrow()
    return QualityModel.fit([np.asarray(g) for g in found["grams"].to_numpy()], found["y"].to_numpy())


def quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score of each whole text: (id, held_out, score, predicted).

    Whole texts are scored, however long; null texts as empty ones, which have a score of their own. Null ids aren't held out. Without labels all scores are 0.5, with one class alone near 0 or 1. Rows that
    repeat are scored alike, an empty table gives an empty result, other columns are ignored.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 131,073 weights

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, model = Grams(), sent.value
        for batch in rows:
            score = np.concatenate([model.scores([grams(t or "") for t in part]) for part in batches(iter(batch.column(2).to_pylist()), 64)] or [np.zeros(0)])
            cols = [batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype("i4"))]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), held_out(id_col).alias("_held"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")
