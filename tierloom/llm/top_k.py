"""Exact top-k inner products by norm order and partial sums.

Vectors are rotated by the right singular vectors of the candidates (from their Gram matrix, which is summed
in parts), so that the first dimensions hold most of a product. A task goes through its candidates by
descending length. A query whose length times that of the next candidate is below its k-th score is done; for
others the partial sum over the first dimensions plus the product of the residual lengths (Cauchy-Schwarz)
bounds the score, and only candidates whose bound reaches the k-th score are multiplied out, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierloom.llm.shared import Scratch

#: Queries of one pass over the candidates: so many bytes of them are broadcast at once, whatever their number.
QUERY_BYTES = 32 << 20
#: Candidates multiplied at once.
BATCH = 2048
#: Beyond this bound on an inner product floats of 64 bits aren't exact, and Python's integers are used.
EXACT = 2**52
LONG = 2**63 - 1


def quantised(embedding: str = "embedding", factor: int = 1024) -> Column:
    """floor(factor * x) of each component; null for vectors that are null or hold null, NaN or infinite components."""
    col = F.col(embedding)
    bad = F.exists(col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(~bad, F.transform(col, lambda x: F.floor(x.cast("double") * factor)))


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    """Rows as integers, shorter vectors padded with zeros."""
    flat, ends = np.asarray(col.flatten()), np.diff(np.asarray(col.offsets))
    if len(col) and (ends == width).all():
        return flat.reshape(len(col), width).astype(np.int64)
    out = np.zeros((len(col), width), np.int64)
    for i, v in enumerate(np.split(flat, np.cumsum(ends)[:-1])):
        out[i, : len(v)] = v
    return out


def sortable(score: int) -> bytes | None:
    """Bytes that sort as the scores do that are beyond a long; null for others, which their longs order."""
    return None if -LONG - 1 < score < LONG else (score + (1 << 159)).to_bytes(20, "big")


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(float) ** 2).sum(1))


class Queries:
    """A block of queries and their k best candidates so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, basis: np.ndarray, head: int, k: int, floor: np.ndarray | None = None):
        self.ids, self.vectors, self.basis, self.head, self.k = ids, vectors, basis, head, k
        turned = vectors.astype(float) @ basis
        self.first, self.rest, self.norms = turned[:, :head], _norms(turned[:, head:]), _norms(vectors)
        self.most = int(np.abs(vectors).max(initial=0))
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, vec_id), best first

    def threshold(self) -> np.ndarray:
        own = np.array([-b[-1][0] if len(b) == self.k else -np.inf for b in self.best], dtype=float)
        return np.maximum(self.floor, own)

    def shortest(self) -> float:
        """Shorter candidates can't reach the k-th score of any query."""
        least = self.threshold() * (1 - 1e-9) - 2
        if not np.isfinite(least).all() or (least <= 0).any():
            return 0.0
        return float((least / np.maximum(self.norms, 1e-300)).min(initial=np.inf))

    def offer(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Candidates in descending order of length."""
        for at in range(0, len(ids), BATCH):
            self._offer(ids[at : at + BATCH], vectors[at : at + BATCH])

    def _offer(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        norms = _norms(vectors)
        slack = 1 + 1e-9 * self.norms * norms.max(initial=0)  # far more than what rounding can take from a bound
        least = self.threshold() - slack
        active = np.flatnonzero(self.norms * norms.max(initial=0) >= least)
        if not len(active):
            return  # nothing is rotated for queries that are done
        turned = vectors.astype(float) @ self.basis
        exact = self.most * int(np.abs(vectors).max(initial=0)) * vectors.shape[1] < EXACT
        bound = self.first[active] @ turned[:, : self.head].T + np.outer(self.rest[active], _norms(turned[:, self.head :]))
        open_ = bound >= least[active, None]
        if exact and open_.mean() > 0.05:
            scores = self.vectors[active].astype(float) @ vectors.astype(float).T
        else:
            scores = None
        floats = vectors.astype(float) if exact else None
        for row, q in enumerate(active):
            found = np.flatnonzero(open_[row] & (ids != self.ids[q]))
            if not len(found):
                continue
            if scores is not None:
                score = scores[row, found]
            elif exact:
                score = floats[found] @ self.vectors[q].astype(float)
            else:
                score = np.array([sum(int(a) * int(b) for a, b in zip(v, self.vectors[q])) for v in vectors[found]], dtype=object)
            if len(self.best[q]) == self.k:
                good = score >= -self.best[q][-1][0]
                score, found = score[good], found[good]
            if len(found) > self.k and exact:
                order = np.lexsort((ids[found], -score))[: self.k]
                score, found = score[order], found[order]
            self.best[q] = sorted(self.best[q] + [(-int(s), int(i)) for s, i in zip(score, ids[found])])[: self.k]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, share: float = 0.7, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k candidates of the highest integer inner product for each query: (query_id, rank, vec_id, score).

    Candidates are all rows of `vectors` but those with the query's own id. Ties go to the smaller id. Rows with null ids
    and vectors that are null or have null or non-finite components take no part; shorter vectors are padded with
    zeros. Scores beyond a long are ordered exactly and given as the largest or smallest long. Repeated rows are candidates of their own; of repeated query ids one, with the smallest vector, is asked. Queries
    are taken in blocks of QUERY_BYTES: a block is broadcast, its results are written, and its broadcast is destroyed before the
    next one is read, so what is held on the driver and the executors doesn't grow with the input. Row groups of candidates too
    short for all of a block's queries aren't read. An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    work = Scratch(spark, "topk")
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(vec_col).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = work.save(rows.withColumn("norm", length).sortWithinPartitions(F.desc("norm")), "candidates")
    asked = queries.select(F.col(id_col).cast("long").alias("id"), quantised(vec_col).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    asked = asked.groupBy("id").agg(F.min("v").alias("v"))
    asked, seen = work.measured(asked, "asked", F.struct(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")))
    width = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 0, seen["width"] or 0)
    n_blocks = -(-seen["n"] // max(1, QUERY_BYTES // (8 * width)))
    asked = work.save(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, n_blocks)))), "queries")
    shape = "query_id long, rank int, vec_id long, score long"

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column(0), width).astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["g"])

    parts = rows.select("v").mapInArrow(gram, "g array<double>")
    summed = parts.select(F.posexplode("g").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()  # width x width sums
    cov = np.zeros(width * width)
    for r in summed:
        cov[r.i] = r.x
    values, basis = np.linalg.eigh(cov.reshape(width, width))
    values, basis = np.maximum(values[::-1], 0), basis[:, ::-1].copy()
    head = int(np.searchsorted(np.cumsum(values), share * values.sum()) + 1)

    seed = rows.orderBy(F.desc("norm"), "id").limit(BATCH).select("id", "v").toArrow().combine_chunks()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("exact"), "vec_id"))
    paths = []
    for b in range(n_blocks):
        part = asked.where(F.col("block") == b).select("id", "v").toArrow().combine_chunks()
        if not len(part):
            continue
        ids, q = np.asarray(part["id"].combine_chunks()), _matrix(part["v"].combine_chunks(), width)
        # the k-th score among a fixed number of the longest candidates is a lower bound for every task
        first = Queries(ids, q, basis, head, k)
        first.offer(np.asarray(seed["id"].combine_chunks()), _matrix(seed["v"].combine_chunks(), width))
        sent = spark.sparkContext.broadcast((ids, q, first.threshold()))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q, floor = sent.value
            block = Queries(ids, q, basis, head, k, floor)
            for batch in batches:
                block.offer(np.asarray(batch.column(0)), _matrix(batch.column(1), width))
            found = [(i, c, -s) for i, best in zip(ids.tolist(), block.best) for s, c in best]
            query, vec, score = zip(*found) if found else [()] * 3
            cols = [pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array([min(max(x, -LONG - 1), LONG) for x in score], pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(map(sortable, score), pa.binary())], names=["query_id", "vec_id", "score", "exact"])

        long_enough = rows.where(F.col("norm") >= first.shortest() ** 2)  # reaches the scan: row groups of sorted lengths
        found = long_enough.select("id", "v").mapInArrow(search, "query_id long, vec_id long, score long, exact binary")
        work.save(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), f"found{b}")
        paths.append(work.path(f"found{b}"))
        sent.destroy()
    work.drop("candidates", "asked", "queries")
    return spark.read.schema(shape).parquet(*paths) if paths else spark.createDataFrame([], shape)
