"""Language identification by a string kernel.

Two texts are as similar as the character n-grams of 1 to 4 letters that both have (the presence kernel of the
blended spectrum), divided by the root of the product of their numbers of n-grams. Landmark texts span a Nyström
approximation of that kernel, in which one ridge regression for each language, against all others, is
solved. A text's kernel with the landmarks and the regression weights are one linear map of its n-gram presence, so
a batch is scored by one product of its presence matrix with the matrix of n-gram weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierloom.llm.ngrams import Presence, batches, sums
from tierloom.llm.shared import first_by_hash, fold, held_out, small_batches

BITS, LENGTHS = 16, range(1, 5)
UNKNOWN = "und"


def _features(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    presence = Presence(LENGTHS, BITS, True)
    for batch in rows:
        found = [presence(t or "") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["lang", "grams"])


class LanguageModel:
    """A text's kernel with the landmarks, `basis`, times the weights of each language; both as one matrix where that is smaller.

    So the model never has more than 65,536 x landmarks numbers and landmarks x languages, however many languages there are.
    """

    def __init__(self, langs: list[str], basis: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        folded = weights.shape[1] <= weights.shape[0]
        self.langs, self.bias = langs, bias
        self.grams, self.weights = ((basis @ weights).astype(np.float32), None) if folded else (basis, weights)

    @classmethod
    def solve(cls, labels: list[str], grams: list[np.ndarray], landmarks: int, ridge: float) -> LanguageModel:
        langs = sorted(set(labels))
        if not langs:
            return cls([], np.zeros((1 << BITS, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
        marks = np.unique(np.linspace(0, len(grams) - 1, min(landmarks, len(grams))).astype(int))  # rows alternate between the languages
        basis = np.zeros((1 << BITS, len(marks)), np.float32)
        for j, i in enumerate(marks):
            basis[grams[i], j] = 1 / np.sqrt(max(1, len(grams[i])))
        size = np.sqrt([max(1, len(g)) for g in grams])
        kernel = np.concatenate([sums(basis, part) for part in batches(iter(grams), 32)]) / size[:, None]
        values, vectors = np.linalg.eigh(kernel[marks] + kernel[marks].T)
        values /= 2
        good = values > 1e-6 * values.max()
        whiten = vectors[:, good] / np.sqrt(values[good])
        phi = kernel @ whiten
        target = np.where(np.array(labels)[:, None] == np.array(langs), 1.0, -1.0)
        mean, bias = phi.mean(0), target.mean(0)
        solved = np.linalg.solve((phi - mean).T @ (phi - mean) + ridge * np.eye(phi.shape[1]), (phi - mean).T @ (target - bias))
        return cls(langs, basis, whiten @ solved, bias - mean @ solved)

    def scores(self, grams: list[np.ndarray]) -> np.ndarray:
        size = np.sqrt([max(1, len(g)) for g in grams])
        kernel = sums(self.grams, grams) / size[:, None]
        return (kernel if self.weights is None else kernel @ self.weights) + self.bias


def fit_language(docs: DataFrame, sample: int = 2000, landmarks: int = 200, ridge: float = 0.1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on `sample` labelled rows at most, as many of each language, of those that aren't held out.

    The rows of a language are those whose hashes of id and text come first, of equal hashes those whose texts do. Should
    there be more labels than `sample`, those with most rows (of equally many the first in order) are learned, by a row each.
    These bounds are the only ones: scoring covers all rows and whole texts. Null texts and labels, repeated rows and other
    columns are no matter; without labelled rows the model knows no language.
    """
    spark = docs.sparkSession
    rows = docs.where((fold(id_col) != 0) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.xxhash64(id_col, text_col).alias("hash"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    langs = [r.lang for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample).collect()]
    known = spark.createDataFrame([(x,) for x in langs], "lang string")  # `sample` labels at most
    chosen = first_by_hash(rows.join(F.broadcast(known), "lang"), "lang", max(1, sample // max(1, len(langs))), ["hash", "text"])
    small_batches(spark)
    found = chosen.select("lang", "text", "k").orderBy("k", "lang").select("lang", "text").mapInArrow(_features, "lang string, grams array<int>").toArrow()
    return LanguageModel.solve(found["lang"].to_pylist(), [np.asarray(g) for g in found["grams"].to_numpy()], landmarks, ridge)


def language(docs: DataFrame, model: LanguageModel, temperature: float = 4.0, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Language of each whole text: (id, held_out, lang_pred, score, has_letter, *keep).

    `score` is the softmax of the languages' regression values, between 0 and 1; of languages with equal values the
    first in order is predicted. A text that is null or has no letter is `und` with score 0, and so is every text if there was no
    labelled row. Rows that repeat are scored alike, null ids aren't held out, an empty table gives an empty result, other
    columns are ignored. `keep` may not have names of this result.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the landmarks

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presence, model = Presence(LENGTHS, BITS, True), sent.value
        for batch in rows:
            lang, score, letter = [], [], []
            for texts in batches(iter(batch.column(2).to_pylist()), 64):
                has = [any(map(str.isalpha, t or "")) for t in texts]
                letter += has
                known = [bool(model.langs) and h for h in has]
                values = iter(model.scores([presence(t) for t, k in zip(texts, known) if k]))
                for k in known:
                    if k:
                        odds = np.exp(temperature * (v := next(values)) - temperature * v.max())
                        lang.append(model.langs[int(v.argmax())])
                        score.append(float(odds.max() / odds.sum()))
                    else:
                        lang.append(UNKNOWN)
                        score.append(0.0)
            cols = [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(letter, pa.bool_()), *batch.columns[3:]]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "held_out", "lang_pred", "score", "has_letter", *keep])

    rows = docs.select(F.col(id_col).alias("_id"), held_out(id_col).alias("_held"), F.col(text_col).cast("string").alias("_text"), *keep)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    shape = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return rows.mapInArrow(run, f"`{id_col}` {kinds[id_col]}, held_out boolean, lang_pred string, score double, has_letter boolean" + (f", {shape}" if keep else ""))
